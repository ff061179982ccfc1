"""What a holder sees: transactions, holds, currencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import signed, total, zero
from tallyforge.operators import audit
from tallyforge.operators.balances import with_class
from tallyforge.schemas import AMOUNT


def transactions(entries: DataFrame, journals: DataFrame, journal_types: DataFrame, classifications: DataFrame, currencies: DataFrame) -> DataFrame:
    """The net effect of each journal on each holder and currency over classes with a role; journals that net to zero are left out.

    The label is the class's if the journal touches one class, else the type's, else the type's name.
    """
    rows = with_class(entries, classifications, "balance_role", F.col("display_label").alias("class_label")).where("balance_role <> ''")
    net = rows.groupBy("journal_id", "account_holder", "currency_id").agg(total(signed()).alias("net_amount"), F.count_distinct("classification_id").alias("n_classes"), F.max("class_label").alias("class_label")).where("net_amount <> 0")
    head = journals.select(F.col("id").alias("journal_id"), F.col("uid").alias("journal_uid"), "journal_type_id", "reversal_of", "memo", "effective_at")
    original = journals.select(F.col("id").alias("reversal_of"), F.col("uid").alias("reversal_of_uid"))
    kinds = journal_types.select(F.col("id").alias("journal_type_id"), F.col("code").alias("kind"), F.col("name").alias("type_name"), F.col("display_label").alias("type_label"))
    coins = currencies.select(F.col("id").alias("currency_id"), F.col("code").alias("currency_code"))
    met = net.join(head, "journal_id").join(original, "reversal_of", "left").join(kinds, "journal_type_id").join(coins, "currency_id")
    label = F.when((F.col("n_classes") == 1) & (F.col("class_label") != ""), F.col("class_label")).when(F.col("type_label") != "", F.col("type_label")).otherwise(F.col("type_name"))
    return met.select("account_holder", "journal_id", "journal_uid", "kind", label.alias("kind_label"), "currency_code", F.when(F.col("net_amount") > 0, "in").otherwise("out").alias("direction"), F.abs("net_amount").cast(AMOUNT).alias("amount"), "effective_at", F.coalesce("reversal_of_uid", F.lit("")).alias("reversal_of_uid"), F.coalesce("memo", F.lit("")).alias("memo"))


def transaction_page(entries: DataFrame, journals: DataFrame, journal_types: DataFrame, classifications: DataFrame, currencies: DataFrame, holder: int, before_id: int = 0, size: int = 20) -> DataFrame:
    """A page of a holder's transactions, newest first. Journals make the page, so one that nets to zero takes a place but gives no row. A page has 20 rows where no size is asked for, and at most 100."""
    size = audit.clamped(size, 20, 100)
    mine = entries.where(F.col("account_holder") == holder)
    page = with_class(mine, classifications, "balance_role").where("balance_role <> ''").select("journal_id").distinct()
    if before_id:
        page = page.where(F.col("journal_id") < before_id)
    page = page.orderBy(F.desc("journal_id")).limit(size)
    return transactions(mine.join(page, "journal_id", "left_semi"), journals, journal_types, classifications, currencies).orderBy(F.desc("journal_id"), "currency_code")


def hold_amount() -> F.Column:
    """What a reservation holds: all of it while active, what isn't settled while settling."""
    settled = F.coalesce("settled_amount", zero())
    return F.when(F.col("status") == "active", F.col("reserved_amount")).when(F.col("status") == "settling", (F.col("reserved_amount") - settled).cast(AMOUNT))


def holds(reservations: DataFrame, currencies: DataFrame) -> DataFrame:
    coins = currencies.select(F.col("id").alias("currency_id"), F.col("code").alias("currency_code"))
    return reservations.where(F.col("status").isin("active", "settling")).join(coins, "currency_id").select("uid", "account_holder", hold_amount().cast(AMOUNT).alias("held_amount"), "currency_code", "created_at", "expires_at")


def held(reservations: DataFrame) -> DataFrame:
    """The amount held of each holder and currency."""
    return reservations.where(F.col("status").isin("active", "settling")).groupBy("account_holder", "currency_id").agg(total(hold_amount()).alias("held"))


def currencies_of(entries: DataFrame, classifications: DataFrame, currencies: DataFrame) -> DataFrame:
    """The currencies in which a holder has entries of a class with a role."""
    coins = currencies.select(F.col("id").alias("currency_id"), F.col("code").alias("currency_code"))
    return with_class(entries, classifications, "balance_role").where("balance_role <> ''").select("account_holder", "currency_id").distinct().join(coins, "currency_id").select("account_holder", "currency_code")
