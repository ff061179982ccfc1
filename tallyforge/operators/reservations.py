"""Reservations: admission, settlement, release, expiry."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.functions.money import zero
from tallyforge.operators.fold import LATER, fold, remember, with_later
from tallyforge.operators.validation import first_reason
from tallyforge.schemas import AMOUNT

#: Allowed changes of a reservation's status.
TRANSITIONS = {"active": ("settling", "settled", "released"), "settling": ("settled", "released")}


def admitted(requests: DataFrame, available: DataFrame) -> DataFrame:
    """Requests (id, account_holder, currency_id, amount, idempotency_key) admitted in id order while the available balance lasts.

    The choice is greedy: a request that doesn't fit is refused and the next one
    is tried. ``available`` has what is left before them of each holder and
    currency. A key seen before replays the first answer if the amounts agree.
    """
    rows = requests.join(available.select("account_holder", "currency_id", F.col("available").alias("opening")), ["account_holder", "currency_id"], "left").withColumn("opening", F.coalesce("opening", zero()))
    rows = with_later(rows, ["account_holder", "currency_id", "idempotency_key"], ["id"])

    def step(state, row):
        left, seen = state
        bad = not row["account_holder"] or row["amount"] is None or row["amount"] <= 0 or not row["idempotency_key"]
        if bad:
            reason = "invalid_input"
        elif row["idempotency_key"] in seen:
            reason = None if seen[row["idempotency_key"]] == row["amount"] else "conflict"
        elif row["amount"] > left:
            reason = "insufficient_balance"
        else:
            reason, left = None, left - row["amount"]
            seen[row["idempotency_key"]] = row["amount"]
        if row["idempotency_key"] in seen:
            remember(seen, row, seen[row["idempotency_key"]])
        return (left, seen), {"accepted": reason is None, "reject_reason": reason, "left": left}

    return fold(rows, ["account_holder", "currency_id"], ["id"], lambda row: (row["opening"], {}), step, StructType.fromDDL(f"accepted boolean, reject_reason string, left {AMOUNT}")).drop(LATER)


def settled(actions: DataFrame, reservations: DataFrame) -> DataFrame:
    """Actions (seq, reservation_id, action, amount, idempotency_key) applied in order to their reservation.

    ``settle`` closes an active reservation with an amount up to the reserved one;
    ``partial`` adds a leg up to what is left and makes it settling; ``finalize``
    closes a settling one; ``release`` frees an active or settling one. A leg's key
    seen before replays if the amounts agree.
    """
    heads = reservations.select(F.col("id").alias("reservation_id"), "reserved_amount", F.col("status").alias("_status"), F.coalesce("settled_amount", zero()).alias("_settled"))
    rows = with_later(actions.join(heads, "reservation_id", "left"), ["reservation_id", "idempotency_key"], ["seq"])

    def step(state, row):
        status, done, legs = state
        amount, action = row["amount"] or Decimal(0), row["action"]
        reason = None
        if status is None:
            reason = "not_found"
        elif action in ("settle", "partial") and amount <= 0 or action == "partial" and not row["idempotency_key"]:
            reason = "invalid_input"
        elif action == "partial" and row["idempotency_key"] in legs:
            reason = None if legs[row["idempotency_key"]] == amount else "conflict"
        elif action == "settle":
            if status != "active":
                reason = "invalid_transition"
            elif amount > row["reserved_amount"]:
                reason = "invalid_input"
            else:
                status, done = "settled", amount
        elif action == "partial":
            if status not in ("active", "settling"):
                reason = "invalid_transition"
            elif done + amount > row["reserved_amount"]:
                reason = "invalid_input"
            else:
                status, done = "settling", done + amount
                legs[row["idempotency_key"]] = amount
        elif action == "finalize":
            if status == "settling":
                status = "settled"
            elif status != "settled":
                reason = "invalid_transition"
        elif action == "release":
            if status in ("active", "settling"):
                status = "released"
            else:
                reason = "invalid_transition"
        else:
            reason = "invalid_input"
        if row["idempotency_key"] in legs:
            remember(legs, row, legs[row["idempotency_key"]])
        return (status, done, legs), {"reject_reason": reason, "status_after": status, "settled_after": done}

    return fold(rows, ["reservation_id"], ["seq"], lambda row: (row["_status"], row["_settled"] or Decimal(0), {}), step, StructType.fromDDL(f"reject_reason string, status_after string, settled_after {AMOUNT}")).drop("_status", "_settled", LATER)


def expired(reservations: DataFrame, now: Column) -> DataFrame:
    """Open reservations past their time, and what becomes of them: active ones are released, settling ones finalized."""
    late = reservations.where(F.col("status").isin("active", "settling") & (F.col("expires_at") < now))
    return late.select("id", "uid", "account_holder", "currency_id", "expires_at", F.when(F.col("status") == "active", "release").otherwise("finalize").alias("action"))


def request_inputs(requests: DataFrame) -> DataFrame:
    return requests.withColumn("reject_reason", first_reason((F.coalesce("account_holder", F.lit(0)) == 0, "invalid_input"), (F.col("currency_id").isNull(), "invalid_input"), (F.coalesce(F.col("amount") <= 0, F.lit(True)), "invalid_input"), (F.coalesce("idempotency_key", F.lit("")) == "", "invalid_input")))
