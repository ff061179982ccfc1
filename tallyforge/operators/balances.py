"""Balances: direct, as of a time, and checkpoint plus delta.

Dimensions carry their size, so the optimizer broadcasts them up to its own
threshold and no further. Every fleet-wide result is one grouped pass over the entries with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import side_total, signed, total, zero
from tallyforge.schemas import AMOUNT, TOTAL

ACCOUNT = ["account_holder", "currency_id", "classification_id"]


def with_class(entries: DataFrame, classifications: DataFrame, *columns: str) -> DataFrame:
    """Entries with their class's normal side (and more columns); unknown classes drop out."""
    wanted = classifications.select(F.col("id").alias("classification_id"), "normal_side", *columns)
    return entries.join(wanted, "classification_id")


def global_totals(entries: DataFrame) -> DataFrame:
    """Debit and credit of everything, as totals: wider than an amount, and not to be added further."""
    return entries.agg(side_total("debit", kind=TOTAL).alias("total_debit"), side_total("credit", kind=TOTAL).alias("total_credit"))


def totals_by_currency(entries: DataFrame) -> DataFrame:
    return entries.groupBy("currency_id").agg(side_total("debit").alias("total_debit"), side_total("credit").alias("total_credit"))


def direct(entries: DataFrame, classifications: DataFrame) -> DataFrame:
    """Each account's balance from all of its entries."""
    return with_class(entries, classifications).groupBy(*ACCOUNT).agg(total(signed()).alias("balance"))


def as_of(entries: DataFrame, classifications: DataFrame, cutoff: Column) -> DataFrame:
    """Balances from the entries effective before ``cutoff`` (exclusive)."""
    return direct(entries.where(F.col("effective_at") < cutoff), classifications)


def checkpoints_of(entries: DataFrame, classifications: DataFrame, upto: int) -> DataFrame:
    """Checkpoints over the entries up to an id. The watermark is that of the holder and currency, over all classes."""
    old = entries.where(F.col("id") <= upto)
    each = with_class(old, classifications).groupBy(*ACCOUNT).agg(total(signed()).alias("balance"), F.max("id").alias("last"))
    return each.select(*ACCOUNT, "balance", F.max("last").over(Window.partitionBy("account_holder", "currency_id")).alias("last_entry_id"))


def realtime(entries: DataFrame, classifications: DataFrame, checkpoints: DataFrame, active_only: bool = True, covered: int | None = None) -> DataFrame:
    """Checkpoint plus delta for every account: one join and one conditional sum in place of a correlated subquery.

    The delta counts entries after the account's watermark. With ``active_only``
    accounts have entries; otherwise checkpoints alone count too. ``covered`` is an
    entry id up to which every entry is in a checkpoint, as after a full rollup: then
    only newer entries are read, a condition that reaches the scan, and checkpoints
    without news are taken as they are.
    """
    if covered is not None:
        entries, active_only = entries.where(F.col("id") > covered), False
    cp = checkpoints.select(*ACCOUNT, F.col("balance").alias("cp_balance"), F.col("last_entry_id").alias("cp_last"))
    met = with_class(entries, classifications).join(cp, ACCOUNT, "left" if active_only else "full")
    delta = F.when(F.col("id") > F.coalesce("cp_last", F.lit(0)), signed()).otherwise(zero())
    found = met.groupBy(*ACCOUNT).agg(total(delta).alias("delta"), F.max("cp_balance").alias("cp_balance"))
    return found.select(*ACCOUNT, (F.coalesce(F.col("cp_balance"), zero()) + F.col("delta")).cast(AMOUNT).alias("balance"))


def deltas(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Debit and credit since the watermark by account, and the newest entry of the holder and currency."""
    cp = checkpoints.select(*ACCOUNT, F.col("last_entry_id").alias("cp_last"))
    fresh = entries.join(cp, ACCOUNT, "left").where(F.col("id") > F.coalesce("cp_last", F.lit(0)))
    each = fresh.groupBy(*ACCOUNT).agg(side_total("debit").alias("debit"), side_total("credit").alias("credit"), F.max("id").alias("last"))
    return each.select(*ACCOUNT, "debit", "credit", F.max("last").over(Window.partitionBy("account_holder", "currency_id")).alias("max_entry_id"))


def trial_balance(entries: DataFrame, classifications: DataFrame, as_of_time: Column, currency_id: int | None = None) -> DataFrame:
    """Debit, credit and net of each class and currency up to a time (inclusive)."""
    rows = entries.where(F.col("effective_at") <= as_of_time)
    if currency_id is not None:
        rows = rows.where(F.col("currency_id") == currency_id)
    found = with_class(rows, classifications, F.col("code").alias("classification_code")).groupBy("currency_id", "classification_id", "classification_code", "normal_side")
    sums = found.agg(side_total("debit").alias("debit"), side_total("credit").alias("credit"))
    net = F.when(F.col("normal_side") == "debit", F.col("debit") - F.col("credit")).otherwise(F.col("credit") - F.col("debit"))
    return sums.withColumn("net", net.cast(AMOUNT))


def trial_totals(trial: DataFrame) -> DataFrame:
    """Totals of a trial balance by currency, and whether they are equal."""
    found = trial.groupBy("currency_id").agg(total(F.col("debit")).alias("total_debit"), total(F.col("credit")).alias("total_credit"))
    return found.withColumn("balanced", F.col("total_debit") == F.col("total_credit"))


def platform(balances: DataFrame, classifications: DataFrame) -> DataFrame:
    """Realtime balances summed by currency, class code and side of the holder."""
    side = F.when(F.col("account_holder") > 0, "user").otherwise("system").alias("holder_side")
    return with_class(balances, classifications, F.col("code").alias("classification_code")).groupBy("currency_id", "classification_code", side).agg(total(F.col("balance")).alias("total_balance"))


def solvency(balances: DataFrame, classifications: DataFrame) -> DataFrame:
    """Custody of the system side against all that users hold, by currency, from one pass."""
    c = with_class(balances, classifications, "code")
    custodial = total(F.when((F.col("account_holder") < 0) & (F.col("code") == "custodial"), F.col("balance")).otherwise(zero()))
    liability = total(F.when(F.col("account_holder") > 0, F.col("balance")).otherwise(zero()))
    found = c.groupBy("currency_id").agg(custodial.alias("custodial"), liability.alias("liability"))
    return found.select("currency_id", "custodial", "liability", (F.col("custodial") - F.col("liability")).cast(AMOUNT).alias("margin"), (F.col("custodial") >= F.col("liability")).alias("solvent"))


def rollups(balances: DataFrame) -> DataFrame:
    """Balances (checkpoints for the stored form, realtime ones for the live form) summed by currency and class."""
    return balances.groupBy("currency_id", "classification_id").agg(total(F.col("balance")).alias("total_balance"))


def breakdown(balances: DataFrame, classifications: DataFrame, held: DataFrame) -> DataFrame:
    """Pending, locked and available of each holder and currency; what reservations hold moves from available to locked."""
    roles = with_class(balances, classifications, "balance_role").where("balance_role <> ''")
    part = lambda role: total(F.when(F.col("balance_role") == role, F.col("balance")).otherwise(zero()))
    key = ["account_holder", "currency_id"]
    found = roles.groupBy(*key).agg(part("pending").alias("pending"), part("locked").alias("raw_locked"), part("available").alias("raw_available")).join(held, key, "left")
    hold = F.coalesce(F.col("held"), zero())
    found = found.select(*key, "pending", (F.col("raw_locked") + hold).cast(AMOUNT).alias("locked"), (F.col("raw_available") - hold).cast(AMOUNT).alias("available"))
    return found.withColumn("total", ((F.col("pending") + F.col("locked")).cast(AMOUNT) + F.col("available")).cast(AMOUNT))


def equation_rows(entries: DataFrame, classifications: DataFrame) -> DataFrame:
    """Debit and credit by currency, class and normal side."""
    return with_class(entries, classifications).groupBy("currency_id", "classification_id", "normal_side").agg(side_total("debit").alias("debit"), side_total("credit").alias("credit"))
