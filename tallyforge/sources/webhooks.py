"""Signed webhook bodies in, verified sightings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.keys import signature
from tallyforge.schemas import AMOUNT

#: How far a body's time may be from now.
FRESH = "INTERVAL '5' MINUTE"
BODY = f"chain_id int, tx_hash string, txlog_seq int, token string, from string, to string, amount {AMOUNT}, confirmations int, block_number long, nonce string"


def verified(requests: DataFrame, secret: Column, now: Column) -> DataFrame:
    """Requests (body, signature, sent_at) with their parsed ``sighting``, or the reason to refuse them.

    The signature is that of the time, a dot and the body.
    """
    signed = F.concat_ws(".", F.unix_timestamp(F.col("sent_at").cast("timestamp")).cast("string"), F.col("body"))
    found = requests.withColumn("sighting", F.from_json("body", BODY)).withColumn("_good", signature(secret, signed) == F.lower("signature"))
    late = (F.col("sent_at") < now - F.expr(FRESH)) | (F.col("sent_at") > now + F.expr(FRESH))
    reason = F.when(~F.coalesce("_good", F.lit(False)), "bad_signature").when(late, "stale").when(F.col("sighting.tx_hash").isNull() | ~F.coalesce(F.col("sighting.amount") > 0, F.lit(False)), "invalid_input")
    return found.withColumn("reject_reason", reason).drop("_good")
