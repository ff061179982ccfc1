"""The driver's star schema seen as books of account.

Orders are journals with a user leg and a system leg, nations are currencies,
purchases are reservations, order states are bookings. The same projection is
written as SQL in ``tallyforge.plans.oracle`` for the DuckDB comparison.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans import presets
from tallyforge.schemas import AMOUNT

EPOCH = "1970-01-01 00:00:00"
#: The instant that every query takes as now.
NOW = "2024-01-20 00:00:00"


def money(c: Column) -> Column:
    """A double as an exact amount, by way of two decimals."""
    return c.cast("decimal(18,2)").cast(AMOUNT)


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


class Books:
    """The accounting tables over one folder of driver tables. Each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def currencies(self) -> DataFrame:
        key = F.col("n_nationkey").cast("long")
        return self._read("nation").select((key + 1).alias("id"), F.concat(F.lit("cur-"), key).alias("uid"), F.col("n_name").alias("code"), F.col("n_name").alias("name"), F.lit(True).alias("is_active"), F.lit(2).cast("short").alias("exponent"))

    @cached_property
    def classifications(self) -> DataFrame:
        return presets.classifications(self.spark)

    @cached_property
    def journal_types(self) -> DataFrame:
        return presets.journal_types(self.spark)

    @cached_property
    def templates(self) -> DataFrame:
        return presets.templates(self.spark)

    @cached_property
    def lifecycles(self) -> DataFrame:
        return presets.lifecycles(self.spark)

    @cached_property
    def _orders(self) -> DataFrame:
        """Orders with their customer's currency."""
        customer = self._read("customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey").cast("long") + 1).alias("currency_id"))
        return self._read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("day"), money(F.col("o_totalprice")).alias("amount")).join(customer, "o_custkey")

    @cached_property
    def journals(self) -> DataFrame:
        k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
        kind = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).cast("long")
        amount = money(F.col("o_totalprice"))
        return self._read("orders").select(
            (k + 1).alias("id"), F.concat(F.lit("jrn-"), k).alias("uid"), kind.alias("journal_type_id"), F.concat(F.lit("ord-"), k).alias("idempotency_key"), amount.alias("total_debit"), amount.alias("total_credit"), F.col("o_orderpriority").alias("memo"),
            F.lit(0).cast("long").alias("actor_id"), F.lit("orders").alias("source"), F.when(k % 10 == 9, k).alias("reversal_of"), F.lit(0).cast("long").alias("event_id"), day.alias("effective_at"), (day + F.expr("INTERVAL '1' HOUR")).alias("created_at"),
        )

    @cached_property
    def entries(self) -> DataFrame:
        k, status = F.col("o_orderkey"), F.col("o_orderstatus")
        holder = F.col("o_custkey") + 1
        user = F.struct((2 * k + 1).alias("id"), holder.alias("account_holder"), F.when(status == "O", 4).otherwise(1).cast("long").alias("classification_id"), F.when(status == "F", "debit").otherwise("credit").alias("entry_type"))
        system = F.struct((2 * k + 2).alias("id"), (-holder).alias("account_holder"), F.when(status == "F", 3).when(status == "O", 2).otherwise(9).cast("long").alias("classification_id"), F.when(status == "F", "credit").otherwise("debit").alias("entry_type"))
        legs = self._orders.select(k, "currency_id", "amount", "day", F.explode(F.array(user, system)).alias("e"))
        return legs.select("e.id", (k + 1).alias("journal_id"), "e.account_holder", "currency_id", "e.classification_id", "e.entry_type", "amount", F.col("day").alias("effective_at"), (F.col("day") + F.expr("INTERVAL '1' HOUR")).alias("created_at"))

    @cached_property
    def watermark(self) -> int:
        """Half of the largest entry id: the checkpoints hold the entries up to it."""
        return (2 * (self._read("orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("k")).first().k) + 2) // 2

    @cached_property
    def checkpoints(self) -> DataFrame:
        from tallyforge.operators.balances import checkpoints_of

        return checkpoints_of(self.entries, self.classifications, self.watermark)

    @cached_property
    def reservations(self) -> DataFrame:
        e = F.col("event_id")
        amount = money(F.col("value"))
        status = F.element_at(F.array(*map(F.lit, ("active", "settling", "settled", "released"))), (e % 4 + 1).cast("int"))
        ts = F.col("ts").cast("timestamp_ntz")
        return self._read("events").where("event_type = 'purchase'").select(
            (e + 1).alias("id"), F.concat(F.lit("rsv-"), e).alias("uid"), (F.col("user_id") + 1).alias("account_holder"), (e % 25 + 1).alias("currency_id"), amount.alias("reserved_amount"), F.when(amount > 1, F.lit(1)).otherwise(F.lit(0)).cast(AMOUNT).alias("settled_amount"), status.alias("status"),
            F.when(e % 4 == 2, e * 3).alias("journal_id"), F.concat(F.lit("rsv-"), e % 997).alias("idempotency_key"), (ts + F.expr("INTERVAL '2' DAY")).alias("expires_at"), ts.alias("created_at"),
        )

    @cached_property
    def bookings(self) -> DataFrame:
        k, status = F.col("o_orderkey"), F.col("o_orderstatus")
        return self._orders.select(
            (k + 1).alias("id"), F.concat(F.lit("bkg-"), k).alias("uid"), F.lit(13).cast("long").alias("classification_id"), (F.col("o_custkey") + 1).alias("account_holder"), "currency_id", "amount", F.when(status == "F", F.col("amount")).otherwise(F.lit(0).cast(AMOUNT)).alias("settled_amount"),
            F.when(status == "F", "confirmed").when(status == "O", "pending").otherwise("confirming").alias("status"), F.lit("evm").alias("channel_name"), F.concat(F.lit("ref-"), k).alias("channel_ref"), F.when(status == "F", k + 1).alias("journal_id"), F.concat(F.lit("bkg-"), k).alias("idempotency_key"),
            F.when(status == "F", at(EPOCH)).otherwise(F.col("day") + F.expr("INTERVAL '1' DAY")).alias("expires_at"),
        )

    @cached_property
    def booking_events(self) -> DataFrame:
        k, status = F.col("o_orderkey"), F.col("o_orderstatus")
        step = lambda n, a, b, real: F.when(real, F.struct(F.lit(n).alias("n"), F.lit(a).alias("from_status"), F.lit(b).alias("to_status")))
        steps = F.array_compact(F.array(step(1, "", "pending", F.lit(True)), step(2, "pending", "confirming", status != "O"), step(3, "confirming", "confirmed", status == "F")))
        each = self._orders.select(k, status, "amount", "day", F.explode(steps).alias("s"))
        n = F.col("s.n")
        i = 3 * k + n
        occurred = F.col("day") + F.make_dt_interval(hours=n)
        return each.select(
            i.alias("id"), (k + 1).alias("booking_id"), F.lit("deposit").alias("classification_code"), "s.from_status", "s.to_status", "amount", F.when(n == 3, k + 1).alias("journal_id"), occurred.alias("occurred_at"),
            F.element_at(F.array(F.lit("pending"), F.lit("delivered"), F.lit("dead")), (i % 3 + 1).cast("int")).alias("delivery_status"), (i % 12).cast("int").alias("attempts"), F.lit(10).alias("max_attempts"), (occurred + F.expr("INTERVAL '5' MINUTE")).alias("next_attempt_at"),
        )

    @cached_property
    def rollup_queue(self) -> DataFrame:
        """A queue row for each purchase: every third is processed, every fifth was never claimed."""
        e, ts = F.col("event_id"), F.col("ts").cast("timestamp_ntz")
        return self._read("events").where("event_type = 'purchase'").select((e + 1).alias("id"), (F.col("user_id") + 1).alias("account_holder"), (e % 25 + 1).alias("currency_id"), F.lit(1).cast("long").alias("classification_id"), F.when(e % 5 != 0, ts).alias("claimed_until"), F.when(e % 3 == 0, ts).alias("processed_at"), (e % 4).cast("int").alias("failed_attempts"))

    @cached_property
    def account_policies(self) -> DataFrame:
        from decimal import Decimal

        zero = Decimal(0)
        rows = [(1, 1, 0, 0, "active", zero, False), (2, 2, 0, 0, "frozen", zero, False), (3, 3, 0, 0, "closed", zero, False), (4, 4, 5, 0, "frozen", zero, False), (5, 5, 0, 0, "active", Decimal(1000), True), (6, 7, 0, 0, "frozen", zero, False), (7, 7, 3, 1, "active", Decimal(-500), True), (8, 8, 0, 0, "closed", zero, False), (9, 10, 0, 0, "frozen", zero, False), (10, 11, 0, 0, "active", Decimal(-100000), True)]
        return presets.literal(self.spark, rows, "account_policies")

    @cached_property
    def period_closes(self) -> DataFrame:
        import datetime as dt

        rows = [(1, dt.datetime(1995, 1, 1), dt.datetime(2024, 1, 1)), (2, dt.datetime(1997, 1, 1), dt.datetime(2024, 1, 2)), (3, dt.datetime(1996, 1, 1), dt.datetime(2024, 1, 3))]
        return presets.literal(self.spark, rows, "period_closes")

    @cached_property
    def webhook_subscribers(self) -> DataFrame:
        rows = [(1, "all", "https://a.example.com", "", "", True), (2, "deposits", "https://b.example.com", "deposit", "", True), (3, "confirmed", "https://c.example.com", "", "confirmed", True), (4, "sweeps", "https://d.example.com", "sweep", "confirmed", True), (5, "off", "https://e.example.com", "", "", False)]
        return presets.literal(self.spark, rows, "webhook_subscribers")
