"""Reversing journals in full and by fractions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import allocated_units, fraction_of_units, is_fraction, total
from tallyforge.schemas import AMOUNT


def flipped(entry_type: Column) -> Column:
    return F.when(entry_type == "debit", "credit").otherwise("debit")


def full(requests: DataFrame, journals: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that undo the requested journals ``requests(journal_id)``, or the reason why not.

    A journal is reversed once, and a reversal isn't reversed.
    """
    head = journals.select(F.col("id").alias("journal_id"), F.col("reversal_of").alias("_of"))
    done = journals.where("reversal_of IS NOT NULL").select(F.col("reversal_of").alias("journal_id"), F.lit(True).alias("_done")).distinct()
    met = requests.select("journal_id").distinct().join(head.withColumn("_found", F.lit(True)), "journal_id", "left").join(done, "journal_id", "left")
    reason = F.when(F.col("_found").isNull(), "not_found").when(F.col("_of").isNotNull(), "is_reversal").when(F.col("_done"), "already_reversed")
    judged = met.select("journal_id", reason.alias("reject_reason"))
    legs = entries.select("journal_id", F.col("id").alias("entry_id"), "account_holder", "currency_id", "classification_id", flipped(F.col("entry_type")).alias("entry_type"), "amount")
    return judged.join(legs, "journal_id", "left").select("journal_id", "reject_reason", *(F.when(F.col("reject_reason").isNull(), F.col(c)).alias(c) for c in ("entry_id", "account_holder", "currency_id", "classification_id", "entry_type", "amount"))).distinct()


def cumulative(journals: DataFrame, entries: DataFrame) -> DataFrame:
    """What has been reversed so far of each original journal, by account and original side."""
    links = journals.where("reversal_of IS NOT NULL").select(F.col("id").alias("journal_id"), F.col("reversal_of").alias("original_id"))
    met = entries.join(links, "journal_id").withColumn("entry_type", flipped(F.col("entry_type")))
    return met.groupBy("original_id", "account_holder", "currency_id", "classification_id", "entry_type").agg(total(F.col("amount")).alias("reversed"))


def by_fraction(entries: DataFrame, num: int, den: int, exponent: int = 2, reversed_so_far: DataFrame | None = None) -> DataFrame:
    """A share num / den of each journal's entries, flipped, in whole units of the currency.

    The total of each (journal, currency, side) is scaled and rounded half up,
    then split over its entries by largest remainder, so both sides stay equal.
    The share num = den is all that is left. A share that would reverse more than
    the original is refused.
    """
    if not 0 < num <= den:
        raise ValueError("a fraction must be above 0 and at most 1")
    unit = 10**exponent
    key = ["journal_id", "currency_id", "entry_type"]
    rows = entries.select("journal_id", "currency_id", "entry_type", "id", "account_holder", "classification_id", "amount", (F.col("amount") * unit).cast("long").alias("units"))
    rows = rows.withColumn("side_units", F.sum("units").over(Window.partitionBy(*key))).withColumn("_num", F.lit(num).cast("long")).withColumn("_den", F.lit(den).cast("long"))
    rows = rows.withColumn("scaled_units", fraction_of_units("side_units", "_num", "_den"))
    rows = allocated_units(rows, key, "scaled_units", "units", "id", "share_units")
    if reversed_so_far is not None:
        before = reversed_so_far.select(F.col("original_id").alias("journal_id"), "account_holder", "currency_id", "classification_id", "entry_type", (F.col("reversed") * unit).cast("long").alias("_before"))
        rows = rows.join(before, ["journal_id", "account_holder", "currency_id", "classification_id", "entry_type"], "left")
    else:
        rows = rows.withColumn("_before", F.lit(0).cast("long"))
    left = F.col("units") - F.coalesce("_before", F.lit(0))
    rows = rows.withColumn("share_units", left if num == den else F.col("share_units"))
    over = F.max((F.col("share_units") > left) | (F.col("share_units") < 0)).over(Window.partitionBy("journal_id"))
    nothing = F.max("share_units").over(Window.partitionBy("journal_id")) <= 0
    rows = rows.withColumn("reject_reason", F.when(over | nothing, "conflict"))
    amount = F.when(F.col("reject_reason").isNull(), (F.col("share_units").cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-exponent))).cast(AMOUNT))
    return rows.select("journal_id", F.col("id").alias("entry_id"), "account_holder", "currency_id", "classification_id", flipped(F.col("entry_type")).alias("entry_type"), amount.alias("amount"), "reject_reason")


__all__ = ["by_fraction", "cumulative", "flipped", "full", "is_fraction"]
