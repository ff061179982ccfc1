"""Checkpoints kept up to date from a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.functions.money import signed, total, zero
from tallyforge.operators.balances import ACCOUNT, with_class
from tallyforge.schemas import AMOUNT
from tallyforge.sources.files import VersionedTable


def advanced(checkpoints: DataFrame, entries: DataFrame, classifications: DataFrame) -> DataFrame:
    """The checkpoints after a batch of entries. Entries at or below an account's watermark count as seen, so a batch can come twice."""
    marks = checkpoints.groupBy("account_holder", "currency_id").agg(F.max("last_entry_id").alias("_mark"))
    fresh = with_class(entries, classifications).join(marks, ["account_holder", "currency_id"], "left").where(F.col("id") > F.coalesce("_mark", F.lit(0)))
    delta = fresh.groupBy(*ACCOUNT).agg(total(signed()).alias("_delta"), F.max("id").alias("_last"))
    met = checkpoints.select(*ACCOUNT, "balance", "last_entry_id").join(delta, ACCOUNT, "full")
    newest = F.max(F.greatest(F.coalesce("last_entry_id", F.lit(0)), F.coalesce("_last", F.lit(0)))).over(Window.partitionBy("account_holder", "currency_id"))
    return met.select(*ACCOUNT, (F.coalesce(F.col("balance"), zero()) + F.coalesce(F.col("_delta"), zero())).cast(AMOUNT).alias("balance"), newest.alias("last_entry_id"))


def start(entries: DataFrame, classifications: DataFrame, table: VersionedTable, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Runs the rollup of a stream of entries into ``table``; version n + 1 is the table after batch n.

    A batch whose version is finished isn't applied again, and one that was cut
    short is applied to the version before it, so the table is exact whatever was lost.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number + 1 not in table.versions():
            table.write(advanced(table.read(), batch, classifications), number + 1)

    return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
