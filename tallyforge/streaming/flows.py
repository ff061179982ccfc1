"""Streams of candidates, nonces, booking requests, deposits and deliveries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.deposits import registered
from tallyforge.schemas import AMOUNT
from tallyforge.sources.files import VersionedTable, insert_or_ignore

#: How long a nonce is remembered.
NONCE_WINDOW = "15 minutes"


def first_nonces(requests: DataFrame, time: str = "seen_at", nonce: str = "nonce") -> DataFrame:
    """Requests whose nonce wasn't seen within the window; state older than the watermark is let go."""
    return requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, NONCE_WINDOW).dropDuplicatesWithinWatermark([nonce])


def open_period(journals: DataFrame, line: Column) -> DataFrame:
    """Journals with a reason if they fall before the close line. An explicit gate, not a watermark: a period can be opened again."""
    return journals.withColumn("reject_reason", F.when(F.col("effective_at") < line, "period_closed"))


def daily_flows(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """Credits and debits by currency and day of a stream, each day emitted once it can't change any more."""
    timed = entries.withColumn("time", F.col("effective_at").cast("timestamp")).withWatermark("time", late)
    side = lambda s: F.sum(F.when(F.col("entry_type") == s, F.col("amount")).otherwise(F.lit(Decimal(0)).cast(AMOUNT))).cast(AMOUNT)
    found = timed.groupBy(F.window("time", "1 day"), "currency_id").agg(side("credit").alias("inflow"), side("debit").alias("outflow"))
    return found.select("currency_id", F.to_date("window.start").alias("day"), "inflow", "outflow")


def transitions(requests: DataFrame, graph: dict[str, list[str]], initial: str) -> DataFrame:
    """A stream of requests (seq, booking_id, to_status, amount) through the booking's lifecycle; the state is its status and settled amount.

    Within a batch a booking's requests are taken by seq.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, settled = state.get if state.exists else (initial, "0")
        rows = pd.concat(list(frames), ignore_index=True).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if r.to_status == status:
                reason, emits = None, False
            elif r.to_status in graph.get(status, []):
                reason, emits, status = None, True, r.to_status
                if r.amount is not None and r.amount == r.amount and r.amount != 0:
                    settled = str(r.amount)
            else:
                reason, emits = "invalid_transition", False
            out.append((r.seq, key[0], r.to_status, reason, emits, status, Decimal(settled)))
        state.update((status, settled))
        yield pd.DataFrame(out, columns=["seq", "booking_id", "to_status", "reject_reason", "emits", "status_after", "settled_after"])

    schema = f"seq long, booking_id long, to_status string, reject_reason string, emits boolean, status_after string, settled_after {AMOUNT}"
    return requests.groupBy("booking_id").applyInPandasWithState(step, schema, "status string, settled string", "append", GroupStateTimeout.NoTimeout)


def ingest(hits: DataFrame, addresses: DataFrame, allowed: list[str], deposits: VersionedTable, dead_letters: VersionedTable, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Hits of allowed tokens at registered addresses, into the sightings table once each; a key that comes again with another amount goes to the dead letters."""

    def apply(batch: DataFrame, number: int) -> None:
        known = registered(batch.where(F.lower("token").isin([t.lower() for t in allowed])), addresses)
        old = deposits.read()
        key = ["chain_id", "tx_hash", "log_index"]
        clash = known.join(old.select(*key, F.col("amount").alias("_amount")), key).where(F.col("amount") != F.col("_amount"))
        letters = clash.select(F.col("chain_id").cast("long"), "tx_hash", F.col("txlog_seq").cast("int").alias("txlog_seq"), F.lit("conflict").alias("reason"))
        if number + 1 not in dead_letters.versions():
            dead_letters.write(insert_or_ignore(dead_letters.read(), letters, ["chain_id", "tx_hash", "txlog_seq"]), number + 1)
        fresh = known.select(F.col("chain_id").cast("long"), "tx_hash", "block_number", "log_index", "token", "to_address", "amount")
        if number + 1 not in deposits.versions():
            deposits.write(insert_or_ignore(old, fresh, key), number + 1)

    return hits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def deliver(events: DataFrame, send: Callable[[dict[str, Any]], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Hands each event of a stream to ``send`` on the executors. An error fails the batch, which is then tried again: at least once."""

    def each(rows: Iterator[Any]) -> None:
        for row in rows:
            send(row.asDict(recursive=True))

    def apply(batch: DataFrame, _: int) -> None:
        batch.foreachPartition(each)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
