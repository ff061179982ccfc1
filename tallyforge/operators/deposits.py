"""Deposits from a chain: decoding, ordinals, tolerance, confirmation, reorganisation, sweeps."""

from __future__ import annotations

from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallyforge.functions.keys import channel_ref, deposit_key
from tallyforge.functions.money import total, zero
from tallyforge.schemas import AMOUNT

#: Topics of a transfer log and bytes of its data.
TOPICS, DATA_BYTES = 3, 32
_WIDE = Context(prec=80)


@F.pandas_udf(DecimalType(30, 18))
def _scaled(data: pd.Series, decimals: pd.Series) -> pd.Series:
    def one(text: str | None, places: int | None) -> Decimal | None:
        if text is None or places is None:
            return None
        value = _WIDE.scaleb(Decimal(int(text.removeprefix("0x"), 16)), -int(places))
        # What an amount can't hold exactly is no amount.
        return value if abs(value) < 10**12 and value == _WIDE.quantize(value, Decimal(1).scaleb(-18)) else None

    return pd.Series([one(*x) for x in zip(data, decimals, strict=True)], dtype=object)


def decoded(logs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Transfers from logs (chain_id, tx_hash, block_number, log_index, token, topics, data) of known tokens (chain_id, token, decimals).

    Logs of another shape are skipped. A raw amount is an unsigned number of 256
    bits; one that doesn't fit an amount gives null.
    """
    address = lambda n: F.concat(F.lit("0x"), F.right(F.element_at("topics", n), F.lit(40)))
    fit = logs.where((F.size("topics") == TOPICS) & F.col("data").rlike(f"^0x[0-9a-fA-F]{{{2 * DATA_BYTES}}}$"))
    return fit.join(tokens, ["chain_id", "token"]).select("chain_id", "tx_hash", "block_number", "log_index", "token", F.lower(address(2)).alias("from_address"), F.lower(address(3)).alias("to_address"), _scaled("data", "decimals").alias("amount"))


def with_ordinal(hits: DataFrame) -> DataFrame:
    """The rank from 0 of each hit in its transaction, by block and log index."""
    order = Window.partitionBy("chain_id", "tx_hash").orderBy("block_number", "log_index")
    return hits.withColumn("txlog_seq", F.row_number().over(order) - 1)


def registered(hits: DataFrame, addresses: DataFrame) -> DataFrame:
    """Hits whose receiver is a registered address, with the holder and the natural key."""
    known = addresses.select("chain_id", F.lower("address").alias("to_address"), "account_holder")
    met = with_ordinal(hits.withColumn("to_address", F.lower("to_address"))).join(known, ["chain_id", "to_address"])
    return met.withColumn("idempotency_key", deposit_key(F.col("chain_id"), F.col("tx_hash"), F.col("txlog_seq"))).withColumn("channel_ref", channel_ref(F.col("tx_hash"), F.col("txlog_seq")))


def tolerance(deposits: DataFrame, allowed: Column) -> DataFrame:
    """The outcome of (expected, actual) under a tolerance, and the templates to run, in order.

    A shortfall within it is released, one beyond it waits for review; an overage
    within it is credited, one beyond it is recorded for review.
    """
    expected, actual = F.col("expected"), F.col("actual")
    delta = F.abs(expected - actual).cast(AMOUNT)
    near = delta <= allowed
    invalid = (expected <= 0) | (actual < 0) | (allowed < 0)
    outcome = F.when(invalid, "invalid_input").when(expected == actual, "exact_match").when(expected > actual, F.when(near, "shortfall_auto_released").otherwise("shortfall_pending")).otherwise(F.when(near, "overage_auto_credited").otherwise("overage_recorded"))
    step = lambda on, code, suffix, amount: F.when(on, F.struct(F.lit(code).alias("template_code"), F.lit(suffix).alias("idempotency_suffix"), amount.cast(AMOUNT).alias("amount")))
    steps = F.array_compact(F.array(
        step(~invalid & (F.least(expected, actual) > 0), "deposit_confirm_pending", "confirm-pending", F.least(expected, actual)),
        step(~invalid & (expected > actual) & near, "deposit_release_pending", "release-shortfall", delta),
        step(~invalid & (expected < actual) & near, "deposit_confirm", "credit-overage", delta),
        step(~invalid & (expected < actual) & ~near, "deposit_record_overage", "record-overage", delta),
    ))
    return deposits.select("*", delta.alias("delta"), outcome.alias("outcome"), F.coalesce(~invalid & (expected != actual) & ~near, F.lit(False)).alias("requires_review"), steps.alias("steps"))


def tolerance_requests(plans: DataFrame) -> DataFrame:
    """Template requests of planned deposits (id, holder, currency_id, idempotency_key, steps): one for each step, all of a deposit one batch."""
    each = plans.select("id", "holder", "currency_id", "idempotency_key", F.posexplode("steps").alias("step_no", "step"))
    return each.select(F.concat_ws(":", "idempotency_key", "step.idempotency_suffix").alias("request_id"), F.col("id").alias("batch_id"), "step_no", F.col("step.template_code").alias("template_code"), "holder", "currency_id", F.create_map(F.lit("amount"), F.col("step.amount")).alias("amounts"))


def review_reason(amount: Column, ceiling: Column, reconcile_ceiling: Column, confirmed: Column, included: Column) -> Column:
    """Why a deposit waits for review: over the ceiling, or a second source that disagrees above another; else null."""
    second = (reconcile_ceiling > 0) & (amount > reconcile_ceiling)
    return F.when((ceiling > 0) & (amount > ceiling), "over_ceiling").when(second & (~F.coalesce(included, F.lit(False)) | F.coalesce(confirmed != amount, F.lit(True))), "reconcile_mismatch")


def confirmation(bookings: DataFrame, heads: DataFrame, needed: int) -> DataFrame:
    """The next status of open deposits (chain_id, block_number, status, review_reason) from their chain's newest block (chain_id, latest_block)."""
    met = bookings.join(heads, "chain_id")
    depth = F.greatest(F.col("latest_block") - F.col("block_number") + 1, F.lit(0))
    done = F.when(F.col("review_reason").isNotNull(), "review").otherwise("confirmed")
    after = F.when(~F.col("status").isin("pending", "confirming"), F.col("status")).when(depth >= needed, done).otherwise("confirming")
    return met.withColumn("confirmations", depth).withColumn("status_after", after)


def reorganised(bookings: DataFrame, included: DataFrame, heads: DataFrame, needed: int, window: int = 500) -> DataFrame:
    """Deposits whose transaction (chain_id, tx_hash) is no longer on its chain: shallow ones fail, confirmed ones within ``window`` blocks are to be reversed."""
    gone = bookings.join(included.select("chain_id", "tx_hash"), ["chain_id", "tx_hash"], "left_anti").join(heads, "chain_id")
    depth = F.greatest(F.col("latest_block") - F.col("block_number") + 1, F.lit(0))
    shallow = F.col("status").isin("pending", "confirming") & (depth < needed)
    deep = (F.col("status") == "confirmed") & (F.col("latest_block") - F.col("block_number") <= window)
    return gone.withColumn("action", F.when(shallow, "fail").when(deep, "reverse")).where("action IS NOT NULL")


def sweep(balances: DataFrame, minimum: Column, limit: int) -> DataFrame:
    """The first ``limit`` addresses with at least the minimum, in order of address: how many and how much."""
    chosen = balances.where(F.col("balance") >= minimum).orderBy("address").limit(limit)
    return chosen.agg(F.count("*").alias("n_addresses"), total(F.coalesce("balance", zero())).alias("total"), F.min("address").alias("first_address"), F.max("address").alias("last_address"))


def sweep_plan(policies: DataFrame, balances: DataFrame, sweeps: DataFrame, gas: DataFrame, bumps: int = 5) -> DataFrame:
    """What a round of each sweep policy (chain_id, token, min_threshold, gas_ceiling, batch_limit) does.

    Over the gas ceiling it waits; a sweep in flight (pending or sent) is advanced,
    at most ``bumps`` times; a failed one is revived; else a new batch of the first
    eligible addresses is made, if there are any.
    """
    state = sweeps.groupBy("chain_id", "token").agg(F.max(F.when(F.col("status").isin("pending", "sent"), F.struct("id", "attempts"))).alias("_open"), F.max(F.when(F.col("status") == "failed", F.col("id"))).alias("_failed"))
    eligible = balances.join(policies.select("chain_id", "token", "min_threshold", "batch_limit"), ["chain_id", "token"]).where(F.col("balance") >= F.col("min_threshold"))
    number = F.row_number().over(Window.partitionBy("chain_id", "token").orderBy("address"))
    batch = eligible.withColumn("_number", number).where(F.col("_number") <= F.col("batch_limit")).groupBy("chain_id", "token").agg(F.count("*").alias("_n"), total(F.col("balance")).alias("_total"))
    met = policies.join(gas, "chain_id", "left").join(state, ["chain_id", "token"], "left").join(batch, ["chain_id", "token"], "left")
    action = F.when(F.col("gas_price").isNull() | (F.col("gas_price") > F.col("gas_ceiling")), "wait").when(F.col("_open").isNotNull(), F.when(F.col("_open.attempts") < bumps, "advance").otherwise("alert")).when(F.col("_failed").isNotNull(), "revive").when(F.coalesce("_n", F.lit(0)) > 0, "send").otherwise("nothing")
    return met.select("chain_id", "token", action.alias("action"), F.when(action == "send", F.col("_n")).alias("n_addresses"), F.when(action == "send", F.col("_total")).cast(AMOUNT).alias("total"))
