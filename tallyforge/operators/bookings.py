"""Booking lifecycles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.operators.fold import fold
from tallyforge.plans.lens import EPOCH
from tallyforge.schemas import AMOUNT


def edges(lifecycles: DataFrame) -> DataFrame:
    """Allowed changes as rows (classification_id, from_status, to_status)."""
    return lifecycles.select("classification_id", F.explode("transitions").alias("from_status", "to")).select("classification_id", "from_status", F.explode("to").alias("to_status"))


def illegal_events(events: DataFrame, bookings: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Events whose change isn't an edge of the booking's lifecycle (the first event of a booking starts it)."""
    of = bookings.select(F.col("id").alias("booking_id"), "classification_id")
    changes = events.where("from_status <> ''").join(of, "booking_id")
    return changes.join(edges(lifecycles), ["classification_id", "from_status", "to_status"], "left_anti").select("id", "booking_id", "from_status", "to_status")


def transitioned(requests: DataFrame, bookings: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Requests (seq, booking_id, to_status, amount) applied in order to their booking.

    The current status again is accepted and emits nothing; an edge of the
    lifecycle emits an event; a non-zero amount replaces the settled amount.
    Metadata of a request that moves the booking is merged into the booking's, the
    request's value winning; it takes part where both tables have a map column
    ``metadata``.
    """
    tagged = "metadata" in requests.columns and "metadata" in bookings.columns
    heads = bookings.select(F.col("id").alias("booking_id"), "classification_id", F.col("status").alias("_status"), F.col("settled_amount").alias("_settled"), *([F.col("metadata").alias("_metadata")] if tagged else []))
    rows = requests.join(heads, "booking_id", "left")
    # Lifecycles are configuration, a row for each class that has one; the tasks get them once.
    graphs = {r.classification_id: {a: frozenset(to) for a, to in r.transitions.items()} for r in lifecycles.select("classification_id", "transitions").collect()}

    def step(state, row):
        status, settled, notes = state
        kept = {"metadata_after": list(notes.items())} if tagged else {}
        if status is None:
            return state, {"reject_reason": "not_found", "emits": False, "status_after": None, "settled_after": None} | kept
        if row["to_status"] == status:
            return state, {"reject_reason": None, "emits": False, "status_after": status, "settled_after": settled} | kept
        if row["to_status"] not in graphs.get(row["classification_id"], {}).get(status, ()):
            return state, {"reject_reason": "invalid_transition", "emits": False, "status_after": status, "settled_after": settled} | kept
        settled = row["amount"] or settled
        if tagged:
            notes = notes | dict(row["metadata"] or [])
            kept = {"metadata_after": list(notes.items())}
        return (row["to_status"], settled, notes), {"reject_reason": None, "emits": True, "status_after": row["to_status"], "settled_after": settled} | kept

    return fold(rows, ["booking_id"], ["seq"], lambda row: (row["_status"], row["_settled"] or Decimal(0), dict(row["_metadata"] or []) if tagged else {}), step, StructType.fromDDL(f"reject_reason string, emits boolean, status_after string, settled_after {AMOUNT}" + (", metadata_after map<string,string>" if tagged else ""))).drop("_status", "_settled", "_metadata")


def expired(bookings: DataFrame, lifecycles: DataFrame, now: Column) -> DataFrame:
    """Bookings past their time whose lifecycle lets them expire from where they are."""
    can = edges(lifecycles).where("to_status = 'expired'").select("classification_id", F.col("from_status").alias("status"))
    return bookings.where((F.col("expires_at") != F.lit(EPOCH).cast("timestamp_ntz")) & (F.col("expires_at") < now)).join(can, ["classification_id", "status"], "left_semi")
