"""The ten reconciliation checks, over the whole fleet at once.

Each check gives findings as rows; ``report`` has a row for every check, passed
or not, with the number of its findings. No check stops at a number of rows:
the limits of listings are arguments of ``top``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import side_total, signed, total, zero
from tallyforge.operators.balances import ACCOUNT, equation_rows, totals_by_currency, with_class
from tallyforge.schemas import AMOUNT

# Check number and name.
NAMES = {1: "journal_dr_cr", 2: "checkpoint_balance", 3: "orphan_entries", 4: "accounting_equation", 5: "settlement_netting", 6: "non_negative_balances", 7: "orphan_reservations", 8: "pending_journal_timeout", 9: "idempotency_uniqueness", 10: "stale_rollup_queue"}
TOLERANCE = Decimal("0.000000000001")
SETTLEMENT_WINDOW = "INTERVAL '30' MINUTE"
STALE_AFTER = "INTERVAL '5' MINUTE"


def unequal_currencies(entries: DataFrame) -> DataFrame:
    """Check 1: currencies whose sides differ."""
    return totals_by_currency(entries).where("total_debit <> total_credit")


def checkpoint_drift(entries: DataFrame, classifications: DataFrame, checkpoints: DataFrame, newest: int | None = None) -> DataFrame:
    """Check 2: checkpoints that differ from the entries up to their watermark. ``newest`` is an id that no watermark is beyond, where it is known; later entries aren't read then."""
    if newest is not None:
        entries = entries.where(F.col("id") <= newest)
    cp = checkpoints.select(*ACCOUNT, "balance", "last_entry_id")
    rows = with_class(entries, classifications).select(*ACCOUNT, "id", signed().alias("_signed"))
    met = cp.join(rows, ACCOUNT, "left")
    # A residual on the equality join: entries after the watermark count as nothing, so a checkpoint keeps its row.
    found = met.groupBy(*ACCOUNT, "balance", "last_entry_id").agg(total(F.when(F.col("id") <= F.col("last_entry_id"), F.col("_signed")).otherwise(zero())).alias("recomputed"))
    return found.where("balance <> recomputed").select(*ACCOUNT, "balance", "recomputed", (F.col("balance") - F.col("recomputed")).cast(AMOUNT).alias("drift"))


def orphan_entries(entries: DataFrame, journals: DataFrame) -> DataFrame:
    """Check 3: entries without a journal."""
    return entries.join(journals.select(F.col("id").alias("journal_id")), "journal_id", "left_anti")


def equation(entries: DataFrame, classifications: DataFrame) -> DataFrame:
    """Net of the debit-normal and of the credit-normal classes by currency; check 4 holds the gap against TOLERANCE."""
    rows = equation_rows(entries, classifications)
    part = lambda side, a, b: total(F.when(F.col("normal_side") == side, (F.col(a) - F.col(b)).cast(AMOUNT)).otherwise(zero()))
    found = rows.groupBy("currency_id").agg(part("debit", "debit", "credit").alias("debit_net"), part("credit", "credit", "debit").alias("credit_net"))
    return found.withColumn("gap", (F.col("debit_net") - F.col("credit_net")).cast(AMOUNT))


def equation_gaps(entries: DataFrame, classifications: DataFrame) -> DataFrame:
    return equation(entries, classifications).where(F.abs("gap") > F.lit(TOLERANCE))


def settlement_net(entries: DataFrame, classifications: DataFrame, now: Column, code: str = "settlement") -> DataFrame:
    """Check 5: currencies in which the settlement class doesn't net to zero, without what was written in the last half hour."""
    old = entries.where(F.col("created_at") <= now - F.expr(SETTLEMENT_WINDOW))
    rows = with_class(old, classifications, "code").where(F.col("code") == code)
    found = rows.groupBy("currency_id").agg(side_total("debit").alias("debit"), side_total("credit").alias("credit"))
    return found.select("currency_id", (F.col("debit") - F.col("credit")).cast(AMOUNT).alias("net")).where("net <> 0")


def negative_balances(balances: DataFrame) -> DataFrame:
    """Check 6: accounts of users below zero, in any class."""
    return balances.where("account_holder > 0 AND balance < 0")


def orphan_reservations(reservations: DataFrame, journals: DataFrame) -> DataFrame:
    """Check 7: reservations that name a journal that isn't there."""
    named = reservations.where("journal_id IS NOT NULL")
    return named.join(journals.select(F.col("id").alias("journal_id")), "journal_id", "left_anti")


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """Check 9: idempotency keys that more than one row has."""
    return rows.groupBy("idempotency_key").agg(F.count("*").alias("n")).where("n > 1")


def checkpoint_age(checkpoints: DataFrame, now: Column) -> DataFrame:
    """Seconds since the checkpoint that was updated longest ago; 0 where there are none."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.min("updated_at").cast("timestamp"))
    return checkpoints.agg(F.coalesce(seconds, F.lit(0)).cast("long").alias("checkpoint_age_s"))


def stale_rollups(queue: DataFrame, now: Column) -> DataFrame:
    """Check 10: claimed rows that weren't processed in time."""
    return queue.where("processed_at IS NULL AND claimed_until IS NOT NULL").where(F.col("claimed_until") < now - F.expr(STALE_AFTER))


def top(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first rows in a total order, for a listing."""
    return rows.orderBy(*order).limit(limit)


def report(entries: DataFrame, journals: DataFrame, classifications: DataFrame, checkpoints: DataFrame, balances: DataFrame, reservations: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """A row for each check: number, name, findings, passed. Check 8 has nothing to look at and passes."""
    spark = entries.sparkSession
    found = {
        1: unequal_currencies(entries), 2: checkpoint_drift(entries, classifications, checkpoints), 3: orphan_entries(entries, journals), 4: equation_gaps(entries, classifications), 5: settlement_net(entries, classifications, now),
        6: negative_balances(balances), 7: orphan_reservations(reservations, journals), 8: spark.range(0), 9: duplicate_keys(journals), 10: stale_rollups(queue, now),
    }
    out = None
    for n, rows in found.items():
        one = rows.agg(F.count("*").alias("n_findings")).select(F.lit(n).alias("check_no"), F.lit(NAMES[n]).alias("check_name"), "n_findings", (F.col("n_findings") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out
