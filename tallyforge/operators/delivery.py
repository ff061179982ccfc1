"""Delivery of events to subscribers: matching, claiming, retrying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds to wait after so many attempts; the last one repeats.
DELAYS = (60, 300, 1800, 7200, 86400)


def retry_delay(attempts: Column) -> Column:
    """Seconds until the next attempt."""
    return F.element_at(F.array(*map(F.lit, DELAYS)), (F.least(F.greatest(attempts, F.lit(0)), F.lit(len(DELAYS) - 1)) + 1).cast("int"))


def after_failure(events: DataFrame, failed_at: Column) -> DataFrame:
    """Pending events after a failed attempt: one more attempt, then a later time or the dead state."""
    dead = F.col("attempts") + 1 >= F.col("max_attempts")
    later = failed_at + F.make_dt_interval(secs=retry_delay(F.col("attempts")))
    return events.where("delivery_status = 'pending'").select("id", (F.col("attempts") + 1).alias("attempts"), F.when(dead, "dead").otherwise("pending").alias("delivery_status"), F.when(dead, F.col("next_attempt_at")).otherwise(later).alias("next_attempt_at"))


def due(events: DataFrame, now: Column, size: int = 100) -> DataFrame:
    """The next events to deliver."""
    return events.where((F.col("delivery_status") == "pending") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "id").limit(size)


def matched(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(event_id, subscriber_id) wherever both of a subscriber's filters are empty or equal.

    Each subscriber is in one of four classes by which filters it sets, so the
    match is a union of equality joins and never a nested loop over events.
    """
    active = subscribers.where("is_active")
    parts = []
    for by_class in (False, True):
        for by_status in (False, True):
            some = active.where(((F.col("filter_class") != "") == F.lit(by_class)) & ((F.col("filter_to_status") != "") == F.lit(by_status)))
            some = some.select(F.col("id").alias("subscriber_id"), F.col("filter_class").alias("classification_code"), F.col("filter_to_status").alias("to_status"))
            key = [c for c, on in (("classification_code", by_class), ("to_status", by_status)) if on]
            wanted = some.select("subscriber_id", *key)
            if key:
                parts.append(events.join(wanted, key).select(F.col("id").alias("event_id"), "subscriber_id"))
            else:
                # Subscribers to everything: their ids travel as one array, so each event is read once.
                everyone = wanted.agg(F.sort_array(F.collect_list("subscriber_id")).alias("ids"))
                parts.append(events.select(F.col("id").alias("event_id")).join(F.broadcast(everyone), F.lit(True), "inner").select("event_id", F.explode("ids").alias("subscriber_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
