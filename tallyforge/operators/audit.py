"""Lookups, pages, chains and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the rows of a page where no size is asked for.
DEFAULT_PAGE = 50


def filtered(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows with the given column values; a value that is None, 0 or '' sets no condition."""
    for name, value in equal.items():
        if value not in (None, 0, ""):
            rows = rows.where(F.col(name) == value)
    return rows


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """The rows with all the given keys (id, uid, idempotency key); a null key finds nothing."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def listed(rows: DataFrame, active_only: bool = False) -> DataFrame:
    """All rows of a dimension in order of id (of code, where there is none), or the active ones."""
    return (rows.where("is_active") if active_only else rows).orderBy("id" if "id" in rows.columns else "code")


def clamped(size: int, default: int = DEFAULT_PAGE, most: int | None = None) -> int:
    """A page size: the default where none or a negative one is asked for, and no more than ``most``."""
    size = size if size > 0 else default
    return size if most is None else min(size, most)


def between(rows: DataFrame, column: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows in a time range, both ends inclusive; None is open."""
    if since is not None:
        rows = rows.where(F.col(column) >= since)
    return rows if until is None else rows.where(F.col(column) <= until)


def page(rows: DataFrame, size: int = 50, after: int = 0, column: str = "id", newest_first: bool = False) -> DataFrame:
    """A keyset page: ids after ``after`` rising, or ids before it falling (0: from the start); a size of 0 or less is the default."""
    if after:
        rows = rows.where(F.col(column) < after if newest_first else F.col(column) > after)
    return rows.orderBy(F.desc(column) if newest_first else F.col(column)).limit(clamped(size))


def journals_by_account(journals: DataFrame, entries: DataFrame, holder: int, currency_id: int, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The journals with an entry of a holder in a currency (a currency of 0 matches nothing)."""
    mine = entries.where((F.col("account_holder") == holder) & (F.col("currency_id") == currency_id)).select(F.col("journal_id").alias("id"))
    return between(journals.join(mine, "id", "left_semi"), "created_at", since, until)


def account_pairs(checkpoints: DataFrame, after: tuple[int, int] | None = None, size: int = 500) -> DataFrame:
    """A page of the (holder, currency) pairs that have checkpoints, in order."""
    pairs = checkpoints.select("account_holder", "currency_id").distinct()
    if after:
        pairs = pairs.where((F.col("account_holder") > after[0]) | (F.col("account_holder") == after[0]) & (F.col("currency_id") > after[1]))
    return pairs.orderBy("account_holder", "currency_id").limit(size)


def reversal_chains(spark: SparkSession, journals: DataFrame, depth: int = 32) -> DataFrame:
    """(root_id, journal_id, depth) of every chain of reversals: all roots at once, by a recursive query.

    LIMIT ALL lifts the session's limit of rows that a recursion may give, a million if unset.
    """
    journals.select("id", "reversal_of").createOrReplaceTempView("_chain_journals")
    return spark.sql(f"""
        WITH RECURSIVE chain(root_id, journal_id, depth) AS (
            SELECT o.id, o.id, 0 FROM _chain_journals o LEFT SEMI JOIN _chain_journals r ON r.reversal_of = o.id WHERE o.reversal_of IS NULL
            UNION ALL
            SELECT c.root_id, j.id, c.depth + 1 FROM chain c JOIN _chain_journals j ON j.reversal_of = c.journal_id WHERE c.depth < {int(depth)}
        ) SELECT * FROM chain LIMIT ALL""")


def reversal_chain(spark: SparkSession, journals: DataFrame, journal_id: int, depth: int = 32) -> DataFrame:
    """All journals of the chain of one journal, up to its root and down from there."""
    journals.select("id", "reversal_of").createOrReplaceTempView("_chain_journals")
    return spark.sql(f"""
        WITH RECURSIVE up(id, reversal_of, depth) AS (
            SELECT id, reversal_of, 0 FROM _chain_journals WHERE id = {int(journal_id)}
            UNION ALL SELECT j.id, j.reversal_of, u.depth + 1 FROM up u JOIN _chain_journals j ON j.id = u.reversal_of WHERE u.depth < {int(depth)}
        ), root AS (SELECT max_by(id, depth) AS id FROM up),
        down(id, depth) AS (
            SELECT id, 0 FROM root WHERE id IS NOT NULL
            UNION ALL SELECT j.id, d.depth + 1 FROM down d JOIN _chain_journals j ON j.reversal_of = d.id WHERE d.depth < {int(depth)}
        ) SELECT DISTINCT id AS journal_id FROM down""")


def booking_trace(bookings: DataFrame, events: DataFrame) -> DataFrame:
    """Each booking's events in order and the distinct journals they lead to."""
    e = events.groupBy(F.col("booking_id").alias("id")).agg(F.count("*").alias("n_events"), F.max_by("to_status", F.struct("occurred_at", events["id"])).alias("last_status"), F.count_distinct("journal_id").alias("n_journals"), F.max("journal_id").alias("last_journal_id"))
    return bookings.select("id", "uid", "status").join(e, "id", "left").select(F.col("id").alias("booking_id"), "uid", "status", F.coalesce("n_events", F.lit(0).cast("long")).alias("n_events"), "last_status", F.coalesce("n_journals", F.lit(0).cast("long")).alias("n_journals"), "last_journal_id")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in key]
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")) if key else rows.agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).where("_row IS NOT NULL")
    return found.select(*key, "_row.*")
