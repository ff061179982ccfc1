"""Balances over time: daily flows, snapshots, gap-filled trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import side_total, signed, total, zero
from tallyforge.operators.balances import ACCOUNT, with_class
from tallyforge.schemas import AMOUNT


def daily_flows(entries: DataFrame) -> DataFrame:
    """Credits (inflow) and debits (outflow) by account and UTC day, whatever the account's normal side."""
    return entries.groupBy(*ACCOUNT, F.to_date("effective_at").alias("day")).agg(side_total("credit").alias("inflow"), side_total("debit").alias("outflow"))


def sparse_snapshots(entries: DataFrame, classifications: DataFrame) -> DataFrame:
    """End-of-day balances, a row only for days that change an account's balance: one pass over daily net flows."""
    net = with_class(entries, classifications).groupBy(*ACCOUNT, F.to_date("effective_at").alias("snapshot_date")).agg(total(signed()).alias("net"))
    run = Window.partitionBy(*ACCOUNT).orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return net.where(F.col("net") != 0).select(*ACCOUNT, "snapshot_date", F.sum("net").over(run).cast(AMOUNT).alias("balance"))


def changed_only(snapshots: DataFrame) -> DataFrame:
    """The rows whose balance differs from the account's snapshot before."""
    before = F.lag("balance").over(Window.partitionBy(*ACCOUNT).orderBy("snapshot_date"))
    return snapshots.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("balance"))).drop("_before")


def spine(rows: DataFrame, first: Column, last: Column, name: str = "day") -> DataFrame:
    """``rows`` once for each day from ``first`` to ``last`` (inclusive)."""
    return rows.withColumn(name, F.explode(F.sequence(first.cast("date"), last.cast("date"), F.expr("INTERVAL '1' DAY"))))


def trend(accounts: DataFrame, snapshots: DataFrame, flows: DataFrame, first: Column, last: Column, live: DataFrame | None = None, today: Column | None = None) -> DataFrame:
    """A row for each account and day: the last snapshot in the range carried forward (0 before it) and the day's flows.

    Where ``live`` balances are given and the range holds ``today``, that day has the
    account's live balance (0 if it has none).
    """
    days = spine(accounts.select(*ACCOUNT).distinct(), first, last)
    between = lambda c: F.col(c).between(first.cast("date"), last.cast("date"))
    snap = snapshots.where(between("snapshot_date")).select(*ACCOUNT, F.col("snapshot_date").alias("day"), F.col("balance").alias("_snap"))
    flow = flows.where(between("day"))
    met = days.join(snap, [*ACCOUNT, "day"], "left").join(flow, [*ACCOUNT, "day"], "left")
    run = Window.partitionBy(*ACCOUNT).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last("_snap", ignorenulls=True).over(run)
    if live is not None:
        met = met.join(live.select(*ACCOUNT, F.col("balance").alias("_live")), ACCOUNT, "left")
        held = F.when(F.col("day") == today.cast("date"), F.coalesce("_live", zero())).otherwise(held)
    return met.select(*ACCOUNT, "day", F.coalesce(held, zero()).cast(AMOUNT).alias("balance"), *(F.coalesce(c, zero()).cast(AMOUNT).alias(c) for c in ("inflow", "outflow")))


def dense_snapshots(snapshots: DataFrame, first: Column, last: Column) -> DataFrame:
    """Sparse snapshots carried forward to every day of the range from the account's first one on."""
    known = snapshots.where(F.col("snapshot_date") <= last.cast("date"))
    start = known.groupBy(*ACCOUNT).agg(F.greatest(F.min("snapshot_date"), first.cast("date")).alias("_from"))
    # The balance that holds on the first day of the range stands in for the snapshots before it.
    opening = known.where(F.col("snapshot_date") <= first.cast("date")).groupBy(*ACCOUNT).agg(F.max_by("balance", "snapshot_date").alias("_open"))
    days = spine(start, F.col("_from"), last, "snapshot_date").drop("_from")
    inside = known.where(F.col("snapshot_date") > first.cast("date"))
    met = days.join(inside, [*ACCOUNT, "snapshot_date"], "left").join(opening, ACCOUNT, "left")
    run = Window.partitionBy(*ACCOUNT).orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.select(*ACCOUNT, "snapshot_date", F.coalesce(F.last("balance", ignorenulls=True).over(run), "_open").cast(AMOUNT).alias("balance"))


def latest_before(snapshots: DataFrame, day: Column) -> DataFrame:
    """Each account's newest snapshot before a day."""
    return snapshots.where(F.col("snapshot_date") < day.cast("date")).groupBy(*ACCOUNT).agg(F.max("snapshot_date").alias("snapshot_date"), F.max_by("balance", "snapshot_date").alias("balance"))


def with_live(snapshots: DataFrame, live: DataFrame, accounts: DataFrame, first: Column, today: Column) -> DataFrame:
    """The snapshots from ``first`` to yesterday and, for today, each account's live balance or zero."""
    old = snapshots.where(F.col("snapshot_date").between(first.cast("date"), F.date_sub(today.cast("date"), 1))).select(*ACCOUNT, "snapshot_date", "balance")
    now = accounts.select(*ACCOUNT).distinct().join(live.select(*ACCOUNT, "balance"), ACCOUNT, "left").select(*ACCOUNT, today.cast("date").alias("snapshot_date"), F.coalesce("balance", zero()).cast(AMOUNT).alias("balance"))
    return old.unionByName(now)
