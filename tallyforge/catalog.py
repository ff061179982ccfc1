"""The registered accounting queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import keys, metadata, money
from tallyforge.operators import audit, balances, bookings, delivery, deposits, holder, pending, reconcile, reservations, reversals, series, validation
from tallyforge.plans.lens import NOW, Books, at
from tallyforge.plans.oracle import A, SIGNED, oracle, total
from tallyforge.schemas import AMOUNT
from tallyforge.sources import files
from tallyforge.streaming import rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ACCOUNT = balances.ACCOUNT
_ACCOUNT = "account_holder, currency_id, classification_id"


def query(sql: str | None = None) -> Callable:
    """Registers a function of a Books under its name, with its oracle."""

    def add(f: Callable[[Books], DataFrame]) -> Callable[[Books], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Books(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def _live(l: Books) -> DataFrame:
    return balances.realtime(l.entries, l.classifications, l.checkpoints, covered=l.watermark)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account's realtime balance with the codes of its dimensions."""
    l = Books(spark, sf_dir)
    coins = l.currencies.select(F.col("id").alias("currency_id"), F.col("code").alias("currency_code"))
    classes = l.classifications.select(F.col("id").alias("classification_id"), F.col("code").alias("classification_code"))
    return _live(l).join(coins, "currency_id").join(classes, "classification_id").select("account_holder", "currency_code", "classification_code", "balance")


# Balances


_DR = total("amount", "entry_type = 'debit'")
_CR = total("amount", "entry_type = 'credit'")


@query(f"SELECT {_DR} AS total_debit, {_CR} AS total_credit FROM entries")
def global_debit_credit(l: Books) -> DataFrame:
    return balances.global_totals(l.entries)


@query(f"SELECT currency_id, {_DR} AS total_debit, {_CR} AS total_credit FROM entries GROUP BY ALL")
def debit_credit_by_currency(l: Books) -> DataFrame:
    return balances.totals_by_currency(l.entries)


@query(f"SELECT {_ACCOUNT}, balance FROM direct")
def balances_direct(l: Books) -> DataFrame:
    return balances.direct(l.entries, l.classifications)


@query(f"SELECT {_ACCOUNT}, balance FROM realtime")
def balances_checkpoint_delta(l: Books) -> DataFrame:
    return _live(l)


@query(f"SELECT {_ACCOUNT}, balance FROM realtime WHERE account_holder = 43")
def holder_balances(l: Books) -> DataFrame:
    """One holder's balances. The filter reaches the scan of both sides."""
    mine = lambda t: t.where(F.col("account_holder") == 43)
    return balances.realtime(mine(l.entries), l.classifications, mine(l.checkpoints), covered=l.watermark)


@query(f"SELECT {_ACCOUNT}, balance FROM realtime WHERE account_holder IN (1, 5, 17, 99, -5)")
def batch_balances(l: Books) -> DataFrame:
    some = lambda t: t.where(F.col("account_holder").isin(1, 5, 17, 99, -5))
    return balances.realtime(some(l.entries), l.classifications, some(l.checkpoints), covered=l.watermark)


@query(f"SELECT {_ACCOUNT}, balance, last_entry_id FROM checkpoints")
def checkpoint_rows(l: Books) -> DataFrame:
    return l.checkpoints


@query(f"""SELECT {_ACCOUNT}, debit, credit, max(last) OVER (PARTITION BY account_holder, currency_id) AS max_entry_id FROM (
    SELECT e.account_holder, e.currency_id, e.classification_id, {total('e.amount', "e.entry_type = 'debit'")} AS debit, {total('e.amount', "e.entry_type = 'credit'")} AS credit, max(e.id) AS last
    FROM entries e LEFT JOIN checkpoints p USING ({_ACCOUNT}) WHERE e.id > coalesce(p.last_entry_id, 0) GROUP BY ALL)""")
def deltas_since_checkpoint(l: Books) -> DataFrame:
    return balances.deltas(l.entries, l.checkpoints)


@query(f"SELECT e.account_holder, e.currency_id, e.classification_id, {total(SIGNED)} AS balance FROM entries e JOIN classifications c ON c.id = e.classification_id WHERE e.effective_at < TIMESTAMP '1998-01-01' GROUP BY ALL")
def balances_as_of(l: Books) -> DataFrame:
    return balances.as_of(l.entries, l.classifications, at("1998-01-01"))


_TRIAL = f"""SELECT e.currency_id, e.classification_id, c.code AS classification_code, c.normal_side, {total('e.amount', "e.entry_type = 'debit'")} AS debit, {total('e.amount', "e.entry_type = 'credit'")} AS credit
    FROM entries e JOIN classifications c ON c.id = e.classification_id WHERE e.effective_at <= TIMESTAMP '1998-01-01' GROUP BY ALL"""


@query(f"SELECT *, CAST(CASE normal_side WHEN 'debit' THEN debit - credit ELSE credit - debit END AS {A}) AS net FROM ({_TRIAL})")
def trial_balance(l: Books) -> DataFrame:
    return balances.trial_balance(l.entries, l.classifications, at("1998-01-01"))


@query(f"SELECT currency_id, {total('debit')} AS total_debit, {total('credit')} AS total_credit, sum(debit) = sum(credit) AS balanced FROM ({_TRIAL}) GROUP BY ALL")
def trial_balance_totals(l: Books) -> DataFrame:
    return balances.trial_totals(balances.trial_balance(l.entries, l.classifications, at("1998-01-01")))


@query(f"SELECT currency_id, code AS classification_code, CASE WHEN account_holder > 0 THEN 'user' ELSE 'system' END AS holder_side, {total('balance')} AS total_balance FROM realtime JOIN classifications c ON c.id = classification_id GROUP BY ALL")
def platform_balances(l: Books) -> DataFrame:
    return balances.platform(_live(l), l.classifications)


@query(f"SELECT currency_id, {total('balance')} AS total_liability FROM realtime WHERE account_holder > 0 GROUP BY ALL")
def total_liability(l: Books) -> DataFrame:
    return _live(l).where("account_holder > 0").groupBy("currency_id").agg(money.total(F.col("balance")).alias("total_liability"))


@query(f"SELECT currency_id, {total('balance')} AS custodial FROM realtime WHERE account_holder < 0 AND classification_id = 3 GROUP BY ALL")
def custodial_balance(l: Books) -> DataFrame:
    return balances.with_class(_live(l), l.classifications, "code").where("account_holder < 0 AND code = 'custodial'").groupBy("currency_id").agg(money.total(F.col("balance")).alias("custodial"))


@query(f"""SELECT currency_id, custodial, liability, CAST(custodial - liability AS {A}) AS margin, custodial >= liability AS solvent FROM (
    SELECT currency_id, {total('balance', 'account_holder < 0 AND classification_id = 3')} AS custodial, {total('balance', 'account_holder > 0')} AS liability FROM realtime GROUP BY ALL)""")
def solvency(l: Books) -> DataFrame:
    return balances.solvency(_live(l), l.classifications)


@query(f"SELECT currency_id, classification_id, {total('balance')} AS total_balance FROM checkpoints GROUP BY ALL")
def system_rollups_stored(l: Books) -> DataFrame:
    return balances.rollups(l.checkpoints)


@query(f"SELECT currency_id, classification_id, {total('balance')} AS total_balance FROM realtime GROUP BY ALL")
def system_rollups_realtime(l: Books) -> DataFrame:
    return balances.rollups(_live(l))


@query(f"""SELECT account_holder, currency_id, pending, locked, available, CAST(pending + locked + available AS {A}) AS total FROM (
    SELECT b.account_holder, b.currency_id, b.pending, CAST(b.locked + coalesce(h.held, 0) AS {A}) AS locked, CAST(b.available - coalesce(h.held, 0) AS {A}) AS available FROM (
        SELECT account_holder, currency_id, {total('balance', "balance_role = 'pending'")} AS pending, {total('balance', "balance_role = 'locked'")} AS locked, {total('balance', "balance_role = 'available'")} AS available
        FROM realtime JOIN classifications c ON c.id = classification_id WHERE balance_role <> '' GROUP BY ALL) b LEFT JOIN held h USING (account_holder, currency_id))""")
def balance_breakdown(l: Books) -> DataFrame:
    return balances.breakdown(_live(l), l.classifications, holder.held(l.reservations))


@query("SELECT account_holder, currency_id, held FROM held")
def held_amounts(l: Books) -> DataFrame:
    return holder.held(l.reservations)


# Series


@query(f"SELECT {_ACCOUNT}, day, inflow, outflow FROM flows")
def daily_flows(l: Books) -> DataFrame:
    return series.daily_flows(l.entries)


@query(f"SELECT {_ACCOUNT}, snapshot_date, balance FROM snaps")
def snapshots_sparse(l: Books) -> DataFrame:
    return series.sparse_snapshots(l.entries, l.classifications)


_TREND_DAYS = ("1998-01-01", "1998-03-31")


@query(f"""WITH days AS (SELECT {_ACCOUNT}, CAST(unnest(generate_series(DATE '{_TREND_DAYS[0]}', DATE '{_TREND_DAYS[1]}', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT {_ACCOUNT} FROM entries)),
met AS (SELECT d.*, s.balance AS snap, coalesce(f.inflow, 0) AS inflow, coalesce(f.outflow, 0) AS outflow, count(s.balance) OVER (PARTITION BY {", ".join("d." + c for c in ACCOUNT)} ORDER BY d.day ROWS UNBOUNDED PRECEDING) AS grp
    FROM days d LEFT JOIN snaps s ON s.account_holder = d.account_holder AND s.currency_id = d.currency_id AND s.classification_id = d.classification_id AND s.snapshot_date = d.day
    LEFT JOIN flows f ON f.account_holder = d.account_holder AND f.currency_id = d.currency_id AND f.classification_id = d.classification_id AND f.day = d.day)
SELECT {_ACCOUNT}, day, CAST(coalesce(max(snap) OVER (PARTITION BY {_ACCOUNT}, grp ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS {A}) AS balance, CAST(inflow AS {A}) AS inflow, CAST(outflow AS {A}) AS outflow FROM met""")
def balance_trend_gapfill(l: Books) -> DataFrame:
    """The trend of every account, those of the system too."""
    return series.trend(l.entries, series.sparse_snapshots(l.entries, l.classifications), series.daily_flows(l.entries), F.lit(_TREND_DAYS[0]), F.lit(_TREND_DAYS[1]))


@query(f"""WITH days AS (SELECT CAST(unnest(generate_series(DATE '1998-06-01', DATE '1998-06-30', INTERVAL 1 DAY)) AS DATE) AS snapshot_date)
SELECT {_ACCOUNT}, d.snapshot_date, arg_max(s.balance, s.snapshot_date) AS balance FROM snaps s, days d WHERE s.snapshot_date <= d.snapshot_date GROUP BY ALL""")
def snapshots_dense(l: Books) -> DataFrame:
    return series.dense_snapshots(series.sparse_snapshots(l.entries, l.classifications), F.lit("1998-06-01"), F.lit("1998-06-30"))


@query(f"SELECT {_ACCOUNT}, max(snapshot_date) AS snapshot_date, arg_max(balance, snapshot_date) AS balance FROM snaps WHERE snapshot_date < DATE '1998-06-01' GROUP BY ALL")
def latest_snapshot_before(l: Books) -> DataFrame:
    return series.latest_before(series.sparse_snapshots(l.entries, l.classifications), F.lit("1998-06-01"))


@query(f"""SELECT {_ACCOUNT}, snapshot_date, balance FROM snaps WHERE snapshot_date BETWEEN DATE '2001-07-01' AND DATE '2001-07-31'
UNION ALL SELECT {_ACCOUNT}, DATE '2001-08-01', CAST(coalesce(p.balance, 0) AS {A}) FROM (SELECT DISTINCT {_ACCOUNT} FROM entries) LEFT JOIN checkpoints p USING ({_ACCOUNT})""")
def merge_with_live(l: Books) -> DataFrame:
    return series.with_live(series.sparse_snapshots(l.entries, l.classifications), l.checkpoints, l.entries, F.lit("2001-07-01"), F.lit("2001-08-01"))


@query(f"""WITH d AS (SELECT {_ACCOUNT}, snapshot_date, balance, lag(balance) OVER (PARTITION BY {_ACCOUNT} ORDER BY snapshot_date) AS before FROM snaps)
SELECT {_ACCOUNT}, snapshot_date, balance FROM d WHERE before IS NULL OR before <> balance""")
def snapshots_changed(l: Books) -> DataFrame:
    return series.changed_only(series.sparse_snapshots(l.entries, l.classifications))


# Holders


_HOLDER_TX = f"""SELECT n.account_holder, n.journal_id, j.uid AS journal_uid, t.code AS kind, CASE WHEN n_classes = 1 AND class_label <> '' THEN class_label WHEN t.display_label <> '' THEN t.display_label ELSE t.name END AS kind_label, cur.code AS currency_code,
    CASE WHEN net > 0 THEN 'in' ELSE 'out' END AS direction, CAST(abs(net) AS {A}) AS amount, j.effective_at, coalesce(o.uid, '') AS reversal_of_uid, coalesce(j.memo, '') AS memo
FROM (SELECT e.journal_id, e.account_holder, e.currency_id, sum({SIGNED}) AS net, count(DISTINCT c.id) AS n_classes, max(c.display_label) AS class_label FROM entries e JOIN classifications c ON c.id = e.classification_id WHERE c.balance_role <> '' GROUP BY ALL) n
JOIN journals j ON j.id = n.journal_id LEFT JOIN journals o ON o.id = j.reversal_of JOIN journal_types t ON t.id = j.journal_type_id JOIN currencies cur ON cur.id = n.currency_id WHERE net <> 0"""


@query(_HOLDER_TX)
def holder_transactions(l: Books) -> DataFrame:
    return holder.transactions(l.entries, l.journals, l.journal_types, l.classifications, l.currencies)


@query(f"SELECT * FROM ({_HOLDER_TX}) WHERE account_holder = 43 ORDER BY journal_id DESC LIMIT 20")
def holder_transactions_page(l: Books) -> DataFrame:
    return holder.transaction_page(l.entries, l.journals, l.journal_types, l.classifications, l.currencies, 43)


@query(f"SELECT r.uid, account_holder, CAST(CASE status WHEN 'active' THEN reserved_amount ELSE reserved_amount - settled_amount END AS {A}) AS held_amount, c.code AS currency_code, created_at, expires_at FROM reservations r JOIN currencies c ON c.id = currency_id WHERE status IN ('active', 'settling')")
def holder_holds(l: Books) -> DataFrame:
    return holder.holds(l.reservations, l.currencies)


@query("SELECT DISTINCT account_holder, cur.code AS currency_code FROM entries e JOIN classifications c ON c.id = e.classification_id JOIN currencies cur ON cur.id = e.currency_id WHERE balance_role <> ''")
def holder_currencies(l: Books) -> DataFrame:
    return holder.currencies_of(l.entries, l.classifications, l.currencies)


# Audit


@query("SELECT id, uid, effective_at, created_at FROM journals WHERE id IN (SELECT journal_id FROM entries WHERE account_holder = 43 AND currency_id = (SELECT min(currency_id) FROM entries WHERE account_holder = 43)) ORDER BY id LIMIT 50")
def journals_by_account_page(l: Books) -> DataFrame:
    mine = l.entries.where("account_holder = 43")
    first = mine.agg(F.min("currency_id").alias("c")).first().c or 0
    return audit.page(audit.journals_by_account(l.journals, mine, 43, first)).select("id", "uid", "effective_at", "created_at")


@query("SELECT id, uid, created_at FROM journals WHERE created_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31 01:00:00' AND id > 500 ORDER BY id LIMIT 50")
def journals_time_range(l: Books) -> DataFrame:
    return audit.page(audit.between(l.journals, "created_at", at("1997-03-01"), at("1997-03-31 01:00:00")), after=500).select("id", "uid", "created_at")


@query("SELECT id, journal_id, account_holder, currency_id, classification_id, entry_type, amount FROM entries WHERE account_holder = 43 AND id > 100 ORDER BY id LIMIT 50")
def entries_by_account_page(l: Books) -> DataFrame:
    return audit.page(audit.filtered(l.entries, account_holder=43, currency_id=0), after=100).select("id", "journal_id", *ACCOUNT, "entry_type", "amount")


@query("SELECT id, uid, status, reserved_amount FROM reservations WHERE status = 'active' AND id < 5000 ORDER BY id DESC LIMIT 50")
def reservations_page_desc(l: Books) -> DataFrame:
    return audit.page(audit.filtered(l.reservations, status="active", account_holder=0), after=5000, newest_first=True).select("id", "uid", "status", "reserved_amount")


@query("SELECT id, booking_id, from_status, to_status, occurred_at FROM bevents WHERE to_status = 'confirmed' AND id > 300 ORDER BY id LIMIT 50")
def events_page(l: Books) -> DataFrame:
    return audit.page(audit.filtered(l.booking_events, to_status="confirmed", booking_id=None), after=300).select("id", "booking_id", "from_status", "to_status", "occurred_at")


@query("SELECT id, uid, status, amount FROM bookings WHERE status = 'confirming' AND id > 200 ORDER BY id LIMIT 50")
def bookings_page(l: Books) -> DataFrame:
    return audit.page(audit.filtered(l.bookings, status="confirming"), after=200).select("id", "uid", "status", "amount")


@query("SELECT DISTINCT account_holder, currency_id FROM checkpoints WHERE account_holder > -100 OR account_holder = -100 AND currency_id > 3 ORDER BY account_holder, currency_id LIMIT 500")
def checkpoint_accounts_page(l: Books) -> DataFrame:
    return audit.account_pairs(l.checkpoints, (-100, 3))


@query("""WITH RECURSIVE chain(root_id, journal_id, depth) AS (SELECT id, id, 0 FROM journals WHERE reversal_of IS NULL AND id IN (SELECT reversal_of FROM journals WHERE reversal_of IS NOT NULL)
    UNION ALL SELECT c.root_id, j.id, c.depth + 1 FROM chain c JOIN journals j ON j.reversal_of = c.journal_id WHERE c.depth < 32)
SELECT root_id, journal_id, depth FROM chain""")
def reversal_chains(l: Books) -> DataFrame:
    return audit.reversal_chains(l.spark, l.journals)


@query("SELECT id AS journal_id FROM journals WHERE id = 9 OR reversal_of = 9")
def reversal_chain(l: Books) -> DataFrame:
    return audit.reversal_chain(l.spark, l.journals, 10)


@query("""SELECT b.id AS booking_id, b.uid, b.status, count(e.id) AS n_events, arg_max(e.to_status, e.id) AS last_status, count(DISTINCT e.journal_id) AS n_journals, max(e.journal_id) AS last_journal_id
FROM bookings b LEFT JOIN bevents e ON e.booking_id = b.id GROUP BY b.id, b.uid, b.status""")
def booking_trace(l: Books) -> DataFrame:
    return audit.booking_trace(l.bookings, l.booking_events)


@query("SELECT booking_id, max(id) AS id, arg_max(to_status, id) AS to_status FROM bevents GROUP BY booking_id")
def latest_event_per_booking(l: Books) -> DataFrame:
    return audit.latest(l.booking_events.select("booking_id", "id", "to_status", "occurred_at"), ["booking_id"], ["occurred_at", "id"]).select("booking_id", "id", "to_status")


@query("SELECT (SELECT count(*) FROM queue WHERE processed_at IS NULL) AS pending_rollups, (SELECT count(*) FROM reservations WHERE status = 'active') AS active_reservations, (SELECT max(id) FROM entries) AS max_entry_id, (SELECT count(*) FROM snaps) AS snapshots, (SELECT min(effective_at) FROM journals) AS earliest_effective, (SELECT CAST(epoch(max(now) - min(e.created_at)) AS BIGINT) FROM (SELECT max(created_at) AS created_at FROM entries, watermark WHERE id <= w GROUP BY account_holder, currency_id, classification_id) e, clock) AS checkpoint_age_s")
def health_metrics(l: Books) -> DataFrame:
    parts = [
        l.rollup_queue.agg(F.count_if(F.col("processed_at").isNull()).alias("pending_rollups")), l.reservations.agg(F.count_if(F.col("status") == "active").alias("active_reservations")), l.entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_entry_id")),
        series.sparse_snapshots(l.entries, l.classifications).agg(F.count("*").alias("snapshots")), l.journals.agg(F.min("effective_at").alias("earliest_effective")),
        # A checkpoint is as old as the newest entry that it holds.
        reconcile.checkpoint_age(l.entries.where(F.col("id") <= l.watermark).groupBy(*ACCOUNT).agg(F.max("created_at").alias("updated_at")), at(NOW)),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.join(F.broadcast(one), F.lit(True), "inner")  # one row each
    return out


# Reconciliation


@query(f"""SELECT currency_id, debit_net, credit_net, CAST(debit_net - credit_net AS {A}) AS gap FROM (SELECT e.currency_id, {total("CASE WHEN c.normal_side = 'debit' THEN CASE e.entry_type WHEN 'debit' THEN e.amount ELSE -e.amount END ELSE 0 END")} AS debit_net,
    {total("CASE WHEN c.normal_side = 'credit' THEN CASE e.entry_type WHEN 'credit' THEN e.amount ELSE -e.amount END ELSE 0 END")} AS credit_net FROM entries e JOIN classifications c ON c.id = e.classification_id GROUP BY ALL)""")
def accounting_equation(l: Books) -> DataFrame:
    return reconcile.equation(l.entries, l.classifications)


@query(f"""SELECT e.currency_id, e.classification_id, c.normal_side, {total('e.amount', "e.entry_type = 'debit'")} AS debit, {total('e.amount', "e.entry_type = 'credit'")} AS credit FROM entries e JOIN classifications c ON c.id = e.classification_id GROUP BY ALL""")
def accounting_equation_rows(l: Books) -> DataFrame:
    return balances.equation_rows(l.entries, l.classifications)


_SETTLEMENT = f"""SELECT currency_id, CAST(sum(CASE entry_type WHEN 'debit' THEN amount ELSE -amount END) AS {A}) AS net FROM entries, clock WHERE classification_id = 9 AND created_at <= now - INTERVAL 30 MINUTE GROUP BY ALL HAVING sum(CASE entry_type WHEN 'debit' THEN amount ELSE -amount END) <> 0"""


@query(_SETTLEMENT)
def settlement_netting(l: Books) -> DataFrame:
    return reconcile.settlement_net(l.entries, l.classifications, at(NOW))


@query(f"SELECT {_ACCOUNT}, balance FROM direct WHERE account_holder > 0 AND balance < 0 ORDER BY balance, {_ACCOUNT} LIMIT 200")
def negative_balances(l: Books) -> DataFrame:
    return reconcile.top(reconcile.negative_balances(balances.direct(l.entries, l.classifications)), 200, "balance", *ACCOUNT)


@query("SELECT id, journal_id FROM entries WHERE journal_id NOT IN (SELECT id FROM journals WHERE id % 997 <> 0) ORDER BY id LIMIT 10")
def orphan_entries(l: Books) -> DataFrame:
    """A sample of the entries that lose their journal where every 997th is missing."""
    return reconcile.top(reconcile.orphan_entries(l.entries, l.journals.where("id % 997 <> 0")), 10, "id").select("id", "journal_id")


@query("SELECT id, uid, journal_id FROM reservations WHERE journal_id IS NOT NULL AND journal_id NOT IN (SELECT id FROM journals) ORDER BY id LIMIT 100")
def orphan_reservations(l: Books) -> DataFrame:
    return reconcile.top(reconcile.orphan_reservations(l.reservations, l.journals), 100, "id").select("id", "uid", "journal_id")


@query("SELECT idempotency_key, count(*) AS n FROM reservations GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, idempotency_key LIMIT 50")
def duplicate_idempotency(l: Books) -> DataFrame:
    return reconcile.top(reconcile.duplicate_keys(l.reservations), 50, F.desc("n"), "idempotency_key")


@query(f"""SELECT {_ACCOUNT}, CAST(p.balance + 1 AS {A}) AS balance, p.balance AS recomputed, CAST(1 AS {A}) AS drift FROM checkpoints p WHERE account_holder % 10 = 0""")
def checkpoint_drift(l: Books) -> DataFrame:
    """What check 2 finds where every tenth holder's checkpoints are one too high."""
    off = F.when(F.col("account_holder") % 10 == 0, F.col("balance") + 1).otherwise(F.col("balance")).cast(AMOUNT)
    return reconcile.checkpoint_drift(l.entries, l.classifications, l.checkpoints.withColumn("balance", off), newest=l.watermark)


_STALE = "SELECT id, account_holder, currency_id, claimed_until FROM queue, clock WHERE processed_at IS NULL AND claimed_until IS NOT NULL AND claimed_until < now - INTERVAL 5 MINUTE"


@query(f"{_STALE} ORDER BY claimed_until, id LIMIT 100")
def stale_rollups(l: Books) -> DataFrame:
    return reconcile.top(reconcile.stale_rollups(l.rollup_queue, at(NOW)), 100, "claimed_until", "id").select("id", "account_holder", "currency_id", "claimed_until")


@query(f"""WITH bad AS (SELECT journal_id, currency_id, entry_type, CASE WHEN id % 500 = 1 THEN CAST(amount + 1 AS {A}) ELSE amount END AS amount FROM entries)
SELECT journal_id, currency_id, {_DR} AS debit, {_CR} AS credit FROM bad GROUP BY ALL HAVING {_DR} <> {_CR}""")
def unbalanced_journals(l: Books) -> DataFrame:
    """The journals that are unequal where one entry in 500 is one too high."""
    return validation.unbalanced(l.entries.withColumn("amount", F.when(F.col("id") % 500 == 1, F.col("amount") + 1).otherwise(F.col("amount")).cast(AMOUNT)))


@query(f"""WITH found(check_no, check_name, n_findings) AS (
SELECT 1, 'journal_dr_cr', (SELECT count(*) FROM (SELECT currency_id FROM entries GROUP BY ALL HAVING {_DR} <> {_CR}))
UNION ALL SELECT 2, 'checkpoint_balance', 0
UNION ALL SELECT 3, 'orphan_entries', (SELECT count(*) FROM entries WHERE journal_id NOT IN (SELECT id FROM journals))
UNION ALL SELECT 4, 'accounting_equation', 0
UNION ALL SELECT 5, 'settlement_netting', (SELECT count(*) FROM ({_SETTLEMENT}))
UNION ALL SELECT 6, 'non_negative_balances', (SELECT count(*) FROM direct WHERE account_holder > 0 AND balance < 0)
UNION ALL SELECT 7, 'orphan_reservations', (SELECT count(*) FROM reservations WHERE journal_id IS NOT NULL AND journal_id NOT IN (SELECT id FROM journals))
UNION ALL SELECT 8, 'pending_journal_timeout', 0
UNION ALL SELECT 9, 'idempotency_uniqueness', (SELECT count(*) FROM (SELECT idempotency_key FROM journals GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 10, 'stale_rollup_queue', (SELECT count(*) FROM ({_STALE})))
SELECT check_no, check_name, n_findings, n_findings = 0 AS passed FROM found""")
def reconcile_report(l: Books) -> DataFrame:
    return reconcile.report(l.entries, l.journals, l.classifications, l.checkpoints, balances.direct(l.entries, l.classifications), l.reservations, l.rollup_queue, at(NOW))


# Reversals and money


@query(f"""SELECT j.reversal_of AS original_id, e.account_holder, e.currency_id, e.classification_id, CASE e.entry_type WHEN 'debit' THEN 'credit' ELSE 'debit' END AS entry_type, {total('e.amount')} AS reversed
FROM entries e JOIN journals j ON j.id = e.journal_id WHERE j.reversal_of IS NOT NULL GROUP BY ALL""")
def cumulative_reversed(l: Books) -> DataFrame:
    return reversals.cumulative(l.journals, l.entries)


@query(f"""WITH asked AS (SELECT id, reversal_of, id IN (SELECT reversal_of FROM journals WHERE reversal_of IS NOT NULL) AS done FROM journals),
judged AS (SELECT id, CASE WHEN reversal_of IS NOT NULL THEN 'is_reversal' WHEN done THEN 'already_reversed' END AS reject_reason FROM asked)
SELECT a.id AS journal_id, reject_reason, e.id AS entry_id, account_holder, currency_id, classification_id, CASE entry_type WHEN 'debit' THEN 'credit' ELSE 'debit' END AS entry_type, amount FROM judged a JOIN entries e ON e.journal_id = a.id WHERE reject_reason IS NULL
UNION ALL SELECT id, reject_reason, NULL, NULL, NULL, NULL, NULL, NULL FROM judged WHERE reject_reason IS NOT NULL""")
def full_reversal_entries(l: Books) -> DataFrame:
    """Every journal requested."""
    return reversals.full(l.journals.select(F.col("id").alias("journal_id")), l.journals, l.entries)


@query(f"""SELECT journal_id, id AS entry_id, account_holder, currency_id, classification_id, CASE entry_type WHEN 'debit' THEN 'credit' ELSE 'debit' END AS entry_type,
    CAST(CAST((2 * CAST(amount * 100 AS BIGINT) + 3) // 6 AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS {A}) AS amount, CAST(NULL AS VARCHAR) AS reject_reason FROM entries""")
def fraction_reversal_entries(l: Books) -> DataFrame:
    """A third of every journal, reversed."""
    return reversals.by_fraction(l.entries, 1, 3)


@query("""WITH s AS (SELECT o_orderkey AS request_id, n AS idx, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS units, (o_orderkey + n * 7) % 5 + 1 AS weight FROM orders, (VALUES (1), (2), (3)) AS v(n)),
f AS (SELECT *, units * weight // sum(weight) OVER (PARTITION BY request_id) AS base, units * weight % sum(weight) OVER (PARTITION BY request_id) AS rest FROM s),
r AS (SELECT *, units - sum(base) OVER (PARTITION BY request_id) AS spare, row_number() OVER (PARTITION BY request_id ORDER BY rest DESC, idx) AS place FROM f)
SELECT request_id, idx, CAST(units AS BIGINT) AS units, CAST(weight AS BIGINT) AS weight, CAST(base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def allocate_shares(l: Books) -> DataFrame:
    """Every order split in three by weight."""
    n = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    rows = l._read("orders").select(F.col("o_orderkey").alias("request_id"), n.alias("idx"), (money.rounded(F.col("o_totalprice").cast("decimal(18,2)"), 2) * 100).cast("long").alias("units"))
    rows = rows.withColumn("weight", (F.col("request_id") + F.col("idx") * 7) % 5 + 1)
    return money.allocated_units(rows, ["request_id"], "units", "weight", "idx")


@query(f"""WITH a AS (SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS {A}) AS amount, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS u, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS s FROM events)
SELECT event_id, amount, CAST(s * ((u + 5) // 10) * CAST(0.1 AS DECIMAL(2,1)) AS {A}) AS half_up,
    CAST(s * CASE WHEN u % 10 = 5 THEN u // 10 + (u // 10) % 2 ELSE (u + 5) // 10 END * CAST(0.1 AS DECIMAL(2,1)) AS {A}) AS half_even,
    CAST(s * (u // 10) * CAST(0.1 AS DECIMAL(2,1)) AS {A}) AS down, CAST(s * ((u + 9) // 10) * CAST(0.1 AS DECIMAL(2,1)) AS {A}) AS up FROM a""")
def rounding_modes(l: Books) -> DataFrame:
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    amount = (F.col("value").cast("decimal(18,2)") * sign).cast(AMOUNT)
    rows = l._read("events").select("event_id", amount.alias("amount"))
    return rows.select("*", *(money.rounded(F.col("amount"), 1, m).alias(m) for m in money.MODES))


@query(f"SELECT event_id, CAST(round(CAST(value AS DECIMAL(18,2)) * CAST(7.23 AS DECIMAL(5,2)), 2) AS {A}) AS converted FROM events")
def convert_amounts(l: Books) -> DataFrame:
    return l._read("events").select("event_id", money.converted(F.col("value").cast("decimal(18,2)"), F.lit(Decimal("7.23")), 2).alias("converted"))


@query("""SELECT id, translate(rtrim(to_base64(CAST(CAST(id AS VARCHAR) AS BLOB)), '='), '+/', '-_') AS cursor, id AS decoded FROM journals""")
def cursor_codec(l: Books) -> DataFrame:
    return l.journals.select("id", keys.cursor(F.col("id")).alias("cursor")).withColumn("decoded", keys.cursor_id(F.col("cursor")))


@query("SELECT id, 'reversal:' || uid || ':chargeback' AS reversal_key, 'pending:expire:journal=' || id AS expiry_key, 'deposit-1-0x' || id || '-0' AS deposit_key, 'sweep-1-usdt-' || id AS sweep_key, '0x' || id || '#0' AS channel_ref FROM journals")
def natural_keys(l: Books) -> DataFrame:
    i, one, tx = F.col("id"), F.lit(1), F.concat(F.lit("0x"), F.col("id"))
    return l.journals.select("id", keys.reversal_key(F.col("uid"), F.lit("chargeback")).alias("reversal_key"), keys.pending_expiry_key(i).alias("expiry_key"), keys.deposit_key(one, tx, F.lit(0)).alias("deposit_key"), keys.sweep_key(one, F.lit("usdt"), i).alias("sweep_key"), keys.channel_ref(tx, F.lit(0)).alias("channel_ref"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END || ',' || event_type AS merged, event_id % 2 = 0 AS same FROM events""")
def metadata_merge(l: Books) -> DataFrame:
    """Two maps merged, right over left, and a request held against its replay."""
    text = F.col("event_type")
    left = F.create_map(F.lit("k"), F.lit("a"), F.lit("t"), text)
    right = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.lit("b")))
    again = F.create_map(F.lit("block_number"), F.col("event_id").cast("string"), F.lit("t"), text, F.lit("k"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("z"))
    both = metadata.merged(left, right)
    return l._read("events").select("event_id", F.concat_ws(",", both["k"], both["t"]).alias("merged"), metadata.same(left, again).alias("same"))


# Validation


@query(f"""WITH req AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 0 THEN 'deposit_confirm' WHEN 1 THEN 'withdraw_fee' WHEN 2 THEN 'deposit_confirm_pending' WHEN 3 THEN 'no_such' ELSE 'lock_funds' END AS template_code, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE 1 END AS holder, o_custkey % 25 + 1 AS currency_id,
    {"CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS " + A + ")"} AS amount FROM orders),
l AS (SELECT r.*, t.*, c.id AS classification_id FROM req r JOIN template_lines t USING (template_code) JOIN classifications c ON c.code = t.classification_code)
SELECT request_id, template_code, NULL AS reject_reason, CASE holder_role WHEN 'system' THEN -holder ELSE holder END AS account_holder, currency_id, classification_id, entry_type, amount, sort_order FROM l WHERE holder > 0 AND amount_key = 'amount'
UNION ALL SELECT request_id, template_code, CASE template_code WHEN 'no_such' THEN 'not_found' ELSE 'invalid_input' END, NULL, NULL, NULL, NULL, NULL, NULL FROM req WHERE NOT (holder > 0 AND template_code NOT IN ('no_such', 'withdraw_fee'))""")
def template_render(l: Books) -> DataFrame:
    k = F.col("o_orderkey")
    codes = F.element_at(F.array(*map(F.lit, ("deposit_confirm", "withdraw_fee", "deposit_confirm_pending", "no_such", "lock_funds"))), (k % 5 + 1).cast("int"))
    requests = l._read("orders").select(k.alias("request_id"), codes.alias("template_code"), F.when(k % 7 == 0, 0).otherwise(F.col("o_custkey") + 1).cast("long").alias("holder"), (F.col("o_custkey") % 25 + 1).alias("currency_id"), F.create_map(F.lit("amount"), F.col("o_totalprice").cast("decimal(18,2)").cast(AMOUNT)).alias("amounts"))
    return validation.rendered(requests, l.templates, l.classifications)


_EFFECTIVE = f"""SELECT a.*, p.id AS policy_id, p.status AS policy_status, CAST(p.min_balance AS {A}) AS min_balance, p.enforce_min_balance FROM (SELECT DISTINCT {_ACCOUNT} FROM entries) a
LEFT JOIN LATERAL (SELECT * FROM policies p WHERE p.account_holder = a.account_holder AND p.currency_id IN (0, a.currency_id) AND p.classification_id IN (0, a.classification_id) ORDER BY p.classification_id DESC, p.currency_id DESC LIMIT 1) p ON true"""


@query(_EFFECTIVE)
def effective_policy(l: Books) -> DataFrame:
    return validation.effective_policies(l.entries.select(*ACCOUNT).distinct(), l.account_policies)


@query(f"""WITH eff AS ({_EFFECTIVE}), d AS (SELECT e.journal_id, e.account_holder, e.currency_id, e.classification_id, sum({SIGNED}) AS delta FROM entries e JOIN classifications c ON c.id = e.classification_id GROUP BY ALL),
m AS (SELECT d.*, x.policy_id, x.policy_status, x.enforce_min_balance AND b.balance + d.delta < x.min_balance AS below FROM d JOIN eff x USING ({_ACCOUNT}) JOIN direct b USING ({_ACCOUNT}) WHERE x.policy_id IS NOT NULL),
p AS (SELECT journal_id, policy_id, bool_or(policy_status = 'closed') AS closed, bool_or(policy_status = 'frozen') AND sum(delta) < 0 AS frozen, bool_or(below) AS below FROM m GROUP BY ALL)
SELECT journal_id, CASE WHEN bool_or(closed) THEN 'account_closed' WHEN bool_or(frozen) THEN 'account_frozen' ELSE 'insufficient_balance' END AS reject_reason FROM p GROUP BY ALL HAVING bool_or(closed) OR bool_or(frozen) OR bool_or(below)""")
def policy_violations(l: Books) -> DataFrame:
    return validation.policy_violations(l.entries, l.classifications, l.account_policies, balances.direct(l.entries, l.classifications))


@query("SELECT id, effective_at FROM journals WHERE effective_at < (SELECT close_before FROM closes ORDER BY created_at DESC, id DESC LIMIT 1)")
def period_close_violations(l: Books) -> DataFrame:
    return validation.in_closed_period(l.journals, l.period_closes).select("id", "effective_at")


@query("SELECT close_before FROM closes ORDER BY created_at DESC, id DESC LIMIT 1")
def active_period_close(l: Books) -> DataFrame:
    return validation.close_line(l.period_closes)


@query(f"SELECT id, CAST(amount + CAST(0.001 AS {A}) AS {A}) AS amount FROM entries WHERE id % 100 = 0")
def precision_violations(l: Books) -> DataFrame:
    """The entries that are refused where every hundredth has a third decimal."""
    off = F.when(F.col("id") % 100 == 0, F.col("amount") + F.lit(Decimal("0.001"))).otherwise(F.col("amount")).cast(AMOUNT)
    return validation.imprecise(l.entries.withColumn("amount", off), l.currencies).select("id", "amount")


@query("SELECT id, idempotency_key, CASE WHEN id % 9 = 0 THEN 'conflict' WHEN id % 2 = 1 THEN 'new' WHEN id % 11 = 0 OR id % 14 = 0 AND id % 4 <> 0 THEN 'conflict' ELSE 'replay' END AS outcome FROM journals")
def idempotency_conflicts(l: Books) -> DataFrame:
    """All journals as candidates against those posted before: the even ones, and every ninth under another source.

    Every eleventh differs in its memo alone. Every fourteenth takes effect a day later, every fourth leaves the day open.
    """
    i = F.col("id")
    changed = l.journals.withColumn("source", F.when(i % 9 == 0, "other").otherwise(F.col("source"))).withColumn("memo", F.when(i % 11 == 0, "other").otherwise(F.col("memo")))
    changed = changed.withColumn("effective_at", F.when(i % 4 == 0, None).when(i % 14 == 0, F.col("effective_at") + F.expr("INTERVAL '1' DAY")).otherwise(F.col("effective_at")))
    posted = validation.fingerprint(l.journals.where("id % 2 = 0 OR id % 9 = 0"), l.entries)
    return validation.idempotency(validation.fingerprint(changed, l.entries), posted)


@query(f"""WITH eff AS ({_EFFECTIVE}), d AS (SELECT e.journal_id, e.account_holder, e.currency_id, e.classification_id, sum({SIGNED}) AS delta FROM entries e JOIN classifications c ON c.id = e.classification_id GROUP BY ALL),
m AS (SELECT d.*, x.policy_id, x.policy_status, x.enforce_min_balance AND b.balance + d.delta < x.min_balance AS below FROM d JOIN eff x USING ({_ACCOUNT}) JOIN direct b USING ({_ACCOUNT}) WHERE x.policy_id IS NOT NULL),
p AS (SELECT journal_id, policy_id, bool_or(policy_status = 'closed') AS closed, bool_or(policy_status = 'frozen') AND sum(delta) < 0 AS frozen, bool_or(below) AS below FROM m GROUP BY ALL),
v AS (SELECT journal_id, CASE WHEN bool_or(closed) THEN 'account_closed' WHEN bool_or(frozen) THEN 'account_frozen' ELSE 'insufficient_balance' END AS why FROM p GROUP BY ALL HAVING bool_or(closed) OR bool_or(frozen) OR bool_or(below)),
r AS (SELECT j.id AS journal_id, CASE WHEN j.effective_at > now + INTERVAL 5 MINUTE THEN 'invalid_input' WHEN j.effective_at < TIMESTAMP '1996-01-01' THEN 'period_closed' ELSE v.why END AS reject_reason, j.id % 50 = 0 AS posted FROM journals j LEFT JOIN v ON v.journal_id = j.id, clock)
SELECT journal_id, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN posted THEN 'replayed' ELSE 'accepted' END AS outcome, reject_reason FROM r""")
def post_journals(l: Books) -> DataFrame:
    """Every journal as a candidate, against books that hold every fiftieth."""
    posted = validation.fingerprint(l.journals.where("id % 50 = 0"), l.entries)
    return validation.post(l.journals, l.entries, l.classifications, l.currencies, l.account_policies, l.period_closes, balances.direct(l.entries, l.classifications), posted, at(NOW))


@query("SELECT id, booking_id, from_status, to_status FROM bevents WHERE false")
def lifecycle_violations(l: Books) -> DataFrame:
    return bookings.illegal_events(l.booking_events, l.bookings, l.lifecycles)


@query("SELECT id, booking_id, from_status, 'review' AS to_status FROM bevents WHERE from_status = 'pending' AND id % 11 = 0")
def lifecycle_violations_injected(l: Books) -> DataFrame:
    """The events that aren't edges where every eleventh leads to review: fine from confirming, not from pending."""
    to = F.when((F.col("id") % 11 == 0) & (F.col("from_status") != ""), "review").otherwise(F.col("to_status"))
    return bookings.illegal_events(l.booking_events.withColumn("to_status", to), l.bookings, l.lifecycles)


# Deposits


_TOLERANCE = f"""SELECT o_orderkey AS id, {"CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS " + A + ")"} AS expected, CAST({"CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS " + A + ")"} + (o_orderkey % 21 - 10) AS {A}) AS actual FROM orders"""


@query(f"""SELECT id, CAST(abs(expected - actual) AS {A}) AS delta, CASE WHEN expected = actual THEN 'exact_match' WHEN expected > actual THEN CASE WHEN expected - actual <= 5 THEN 'shortfall_auto_released' ELSE 'shortfall_pending' END WHEN actual - expected <= 5 THEN 'overage_auto_credited' ELSE 'overage_recorded' END AS outcome,
    abs(expected - actual) > 5 AS requires_review, CASE WHEN expected = actual OR expected > actual AND expected - actual > 5 THEN 1 ELSE 2 END AS n_steps FROM ({_TOLERANCE})""")
def tolerance_plan(l: Books) -> DataFrame:
    """Every order as a deposit that is up to ten off."""
    k, expected = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast(AMOUNT)
    rows = l._read("orders").select(k.alias("id"), expected.alias("expected"), (expected + (k % 21 - 10)).cast(AMOUNT).alias("actual"))
    return deposits.tolerance(rows, F.lit(Decimal(5))).select("id", "delta", "outcome", "requires_review", F.size("steps").alias("n_steps"))


@query(f"""WITH t AS (SELECT *, abs(expected - actual) AS delta, least(expected, actual) AS low FROM ({_TOLERANCE}))
SELECT 'dep-' || id || ':confirm-pending' AS request_id, id AS batch_id, 'deposit_confirm_pending' AS template_code, CAST(low AS {A}) AS amount FROM t
UNION ALL SELECT 'dep-' || id || CASE WHEN expected > actual THEN ':release-shortfall' WHEN delta <= 5 THEN ':credit-overage' ELSE ':record-overage' END, id, CASE WHEN expected > actual THEN 'deposit_release_pending' WHEN delta <= 5 THEN 'deposit_confirm' ELSE 'deposit_record_overage' END, CAST(delta AS {A})
FROM t WHERE expected < actual OR expected > actual AND delta <= 5""")
def tolerance_requests(l: Books) -> DataFrame:
    """The template requests of the same deposits."""
    k, expected = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast(AMOUNT)
    rows = l._read("orders").select(k.alias("id"), expected.alias("expected"), (expected + (k % 21 - 10)).cast(AMOUNT).alias("actual"), (F.col("o_custkey") + 1).alias("holder"), F.lit(1).cast("long").alias("currency_id"), F.concat(F.lit("dep-"), k).alias("idempotency_key"))
    return deposits.tolerance_requests(deposits.tolerance(rows, F.lit(Decimal(5)))).select("request_id", "batch_id", "template_code", F.col("amounts")["amount"].alias("amount"))


@query("SELECT tx_hash, log_index, row_number() OVER (PARTITION BY tx_hash ORDER BY block_number, log_index) - 1 AS txlog_seq FROM (SELECT 'tx-' || (event_id // 3) AS tx_hash, event_id // 3 AS block_number, event_id % 3 AS log_index FROM events WHERE event_type IN ('purchase', 'click'))")
def txlog_sequence(l: Books) -> DataFrame:
    e = F.col("event_id")
    hits = l._read("events").where("event_type IN ('purchase', 'click')").select(F.lit(1).alias("chain_id"), F.concat(F.lit("tx-"), F.floor(e / 3)).alias("tx_hash"), F.floor(e / 3).alias("block_number"), (e % 3).alias("log_index"))
    return deposits.with_ordinal(hits).select("tx_hash", "log_index", "txlog_seq")


@query(f"""SELECT id, CASE WHEN amount > 400000 THEN 'over_ceiling' WHEN amount > 200000 AND id % 4 = 0 THEN 'reconcile_mismatch' END AS review_reason FROM bookings""")
def review_gate(l: Books) -> DataFrame:
    """Bookings over the ceiling, and those above the second one that another source doesn't confirm (every fourth)."""
    confirmed = F.when(F.col("id") % 4 == 0, F.col("amount") - 1).otherwise(F.col("amount"))
    return l.bookings.select("id", deposits.review_reason(F.col("amount"), F.lit(400000), F.lit(200000), confirmed, F.lit(True)).alias("review_reason"))


@query("""SELECT id, greatest(5000 - id % 6000 + 1, 0) AS confirmations, CASE WHEN status NOT IN ('pending', 'confirming') THEN status WHEN greatest(5000 - id % 6000 + 1, 0) >= 12 THEN CASE WHEN amount > 400000 THEN 'review' ELSE 'confirmed' END ELSE 'confirming' END AS status_after FROM bookings""")
def confirmation_progress(l: Books) -> DataFrame:
    rows = l.bookings.select("id", "status", "amount", F.lit(1).alias("chain_id"), (F.col("id") % 6000).alias("block_number"), F.when(F.col("amount") > 400000, "over_ceiling").alias("review_reason"))
    heads = l.spark.range(1).select(F.lit(1).alias("chain_id"), F.lit(5000).cast("long").alias("latest_block"))
    return deposits.confirmation(rows, heads, 12).select("id", "confirmations", "status_after")


@query("""SELECT id, CASE WHEN status = 'confirmed' THEN 'reverse' ELSE 'fail' END AS action FROM (SELECT id, status, id % 6000 AS block FROM bookings WHERE id % 13 = 0) WHERE status = 'confirmed' AND 5000 - block <= 500 OR status <> 'confirmed' AND greatest(5000 - block + 1, 0) < 12""")
def reorg_actions(l: Books) -> DataFrame:
    """What to do about deposits whose transaction (every thirteenth) left the chain."""
    rows = l.bookings.select("id", "status", F.lit(1).alias("chain_id"), F.col("id").cast("string").alias("tx_hash"), (F.col("id") % 6000).alias("block_number"))
    heads = l.spark.range(1).select(F.lit(1).alias("chain_id"), F.lit(5000).cast("long").alias("latest_block"))
    return deposits.reorganised(rows, rows.where("id % 13 <> 0"), heads, 12).select("id", "action")


@query(f"""SELECT count(*) AS n_addresses, {total('balance')} AS total, min(address) AS first_address, max(address) AS last_address FROM (SELECT 'addr-' || c_custkey AS address, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS {A}) AS balance FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) >= 1000 ORDER BY address LIMIT 200)""")
def sweep_batch(l: Books) -> DataFrame:
    rows = l._read("customer").select(F.concat(F.lit("addr-"), "c_custkey").alias("address"), F.col("c_acctbal").cast("decimal(18,2)").cast(AMOUNT).alias("balance"))
    return deposits.sweep(rows, F.lit(Decimal(1000)), 200)


# Expiry and delivery


@query("SELECT account_holder, currency_id, min(id) AS journal_entry_id FROM entries, clock WHERE classification_id = 4 AND account_holder > 0 AND created_at < TIMESTAMP '2000-01-01' GROUP BY ALL ORDER BY journal_entry_id LIMIT 1000")
def pending_oldest_per_account(l: Books) -> DataFrame:
    """The oldest pending entry of each holder and currency, for the timeout."""
    late = l.entries.where((F.col("classification_id") == 4) & (F.col("account_holder") > 0) & (F.col("created_at") < at("2000-01-01")))
    return late.groupBy("account_holder", "currency_id").agg(F.min("id").alias("journal_entry_id")).orderBy("journal_entry_id").limit(1000)


@query(f"""WITH late AS (SELECT account_holder, currency_id, journal_id, created_at, row_number() OVER (PARTITION BY account_holder, currency_id ORDER BY created_at, journal_id) AS n FROM entries WHERE classification_id = 4 AND entry_type = 'credit' AND account_holder > 0 AND created_at < TIMESTAMP '2000-01-01')
SELECT l.account_holder, l.currency_id, l.journal_id, l.created_at, CAST(least(j.total_debit, b.balance) AS {A}) AS amount, 'pending:expire:journal=' || l.journal_id AS idempotency_key
FROM late l JOIN journals j ON j.id = l.journal_id JOIN direct b ON b.account_holder = l.account_holder AND b.currency_id = l.currency_id AND b.classification_id = 4 WHERE n = 1 AND b.balance > 0 ORDER BY l.created_at, l.journal_id LIMIT 1000""")
def pending_expiry(l: Books) -> DataFrame:
    return pending.overdue(l.journals, l.entries, balances.direct(l.entries, l.classifications), at("2000-01-01"), 4)


@query("SELECT id, uid, account_holder, currency_id, expires_at, CASE status WHEN 'active' THEN 'release' ELSE 'finalize' END AS action FROM reservations, clock WHERE status IN ('active', 'settling') AND expires_at < now ORDER BY expires_at, id LIMIT 100")
def expired_reservations(l: Books) -> DataFrame:
    return reservations.expired(l.reservations, at(NOW)).orderBy("expires_at", "id").limit(100)


@query("SELECT id, status, expires_at FROM bookings, clock WHERE status = 'pending' AND expires_at <> TIMESTAMP '1970-01-01' AND expires_at < now ORDER BY expires_at, id LIMIT 100")
def expired_bookings(l: Books) -> DataFrame:
    return bookings.expired(l.bookings, l.lifecycles, at(NOW)).orderBy("expires_at", "id").limit(100).select("id", "status", "expires_at")


@query("""SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= max_attempts THEN 'dead' ELSE 'pending' END AS delivery_status, CASE WHEN attempts + 1 >= max_attempts THEN next_attempt_at ELSE now + CASE least(attempts, 4) WHEN 0 THEN INTERVAL 1 MINUTE WHEN 1 THEN INTERVAL 5 MINUTE WHEN 2 THEN INTERVAL 30 MINUTE WHEN 3 THEN INTERVAL 2 HOUR ELSE INTERVAL 24 HOUR END END AS next_attempt_at
FROM bevents, clock WHERE delivery_status = 'pending'""")
def event_retry_schedule(l: Books) -> DataFrame:
    return delivery.after_failure(l.booking_events, at(NOW))


@query("SELECT id, booking_id, next_attempt_at FROM bevents, clock WHERE delivery_status = 'pending' AND next_attempt_at <= now ORDER BY next_attempt_at, id LIMIT 100")
def events_due(l: Books) -> DataFrame:
    return delivery.due(l.booking_events, at(NOW)).select("id", "booking_id", "next_attempt_at")


@query("SELECT e.id AS event_id, s.id AS subscriber_id FROM bevents e JOIN subscribers s ON s.is_active AND (s.filter_class = '' OR s.filter_class = e.classification_code) AND (s.filter_to_status = '' OR s.filter_to_status = e.to_status)")
def subscriber_match(l: Books) -> DataFrame:
    return delivery.matched(l.booking_events, l.webhook_subscribers)


# Ordered folds. Their oracles go through each key's rows one by one, by recursion.


_ADMISSION = f"""WITH RECURSIVE room AS (SELECT account_holder, currency_id, {total('balance', "balance_role = 'available'")} AS available FROM realtime JOIN classifications c ON c.id = classification_id WHERE balance_role <> '' GROUP BY ALL),
req AS (SELECT r.id, r.account_holder, r.currency_id, r.reserved_amount AS amount, coalesce(m.available, 0) AS opening, row_number() OVER (PARTITION BY r.account_holder, r.currency_id ORDER BY r.id) AS n FROM reservations r LEFT JOIN room m USING (account_holder, currency_id)),
f(id, account_holder, currency_id, amount, n, accepted, rest) AS (SELECT id, account_holder, currency_id, amount, n, amount > 0 AND amount <= opening, CAST(CASE WHEN amount > 0 AND amount <= opening THEN opening - amount ELSE opening END AS {A}) FROM req WHERE n = 1
    UNION ALL SELECT q.id, q.account_holder, q.currency_id, q.amount, q.n, q.amount > 0 AND q.amount <= f.rest, CAST(CASE WHEN q.amount > 0 AND q.amount <= f.rest THEN f.rest - q.amount ELSE f.rest END AS {A}) FROM f JOIN req q ON q.account_holder = f.account_holder AND q.currency_id = f.currency_id AND q.n = f.n + 1)
SELECT id, account_holder, currency_id, amount, accepted, CASE WHEN amount <= 0 THEN 'invalid_input' WHEN NOT accepted THEN 'insufficient_balance' END AS reject_reason, rest AS "left" FROM f"""


@query(_ADMISSION)
def reserve_admission(l: Books) -> DataFrame:
    """Every reservation as a request, in order, against what its holder has available."""
    asked = l.reservations.select("id", "account_holder", "currency_id", F.col("reserved_amount").alias("amount"), F.col("uid").alias("idempotency_key"))
    left = balances.breakdown(_live(l), l.classifications, holder.held(l.reservations.where("false"))).select("account_holder", "currency_id", "available")
    return reservations.admitted(asked, left).select("id", "account_holder", "currency_id", "amount", "accepted", "reject_reason", "left")


@query(f"""WITH RECURSIVE req AS (SELECT o_orderkey AS seq, o_custkey % 100 + 1 AS account_holder, CAST(1 AS BIGINT) AS currency_id, CASE o_orderkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'confirm' WHEN 2 THEN 'cancel' ELSE 'expire' END AS action,
    {"CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS " + A + ")"} AS amount, 'p-' || o_orderkey AS idempotency_key, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS n FROM orders),
f(seq, account_holder, currency_id, action, amount, idempotency_key, n, posted, pending_after) AS (SELECT seq, account_holder, currency_id, action, amount, idempotency_key, n, CASE WHEN action = 'add' AND amount > 0 THEN amount END, CAST(CASE WHEN action = 'add' AND amount > 0 THEN amount ELSE 0 END AS {A}) FROM req WHERE n = 1
    UNION ALL SELECT q.seq, q.account_holder, q.currency_id, q.action, q.amount, q.idempotency_key, q.n,
        CASE WHEN q.amount <= 0 THEN NULL WHEN q.action = 'add' THEN q.amount WHEN q.action = 'expire' THEN CASE WHEN f.pending_after > 0 THEN least(q.amount, f.pending_after) END WHEN q.amount <= f.pending_after THEN q.amount END,
        CAST(CASE WHEN q.amount <= 0 THEN f.pending_after WHEN q.action = 'add' THEN f.pending_after + q.amount WHEN q.action = 'expire' THEN f.pending_after - least(q.amount, f.pending_after) WHEN q.amount <= f.pending_after THEN f.pending_after - q.amount ELSE f.pending_after END AS {A})
    FROM f JOIN req q ON q.account_holder = f.account_holder AND q.n = f.n + 1)
SELECT seq, account_holder, currency_id, action, amount, idempotency_key, CASE WHEN posted IS NULL THEN NULL WHEN action = 'add' THEN 'deposit_pending' WHEN action = 'confirm' THEN 'deposit_confirm_pending' ELSE 'deposit_release_pending' END AS template_code,
    CAST(posted AS {A}) AS posted, pending_after, CASE WHEN amount <= 0 THEN 'invalid_input' WHEN posted IS NULL THEN 'insufficient_balance' END AS reject_reason FROM f""")
def pending_actions(l: Books) -> DataFrame:
    """Every order as an amount added, confirmed, cancelled or let expire, in order."""
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, pending.TEMPLATES)), (k % 4 + 1).cast("int"))
    asked = l._read("orders").select(k.alias("seq"), (F.col("o_custkey") % 100 + 1).alias("account_holder"), F.lit(1).cast("long").alias("currency_id"), action.alias("action"), F.col("o_totalprice").cast("decimal(18,2)").cast(AMOUNT).alias("amount"), F.concat(F.lit("p-"), k).alias("idempotency_key"))
    return pending.applied(asked, pending.opening_of(balances.direct(l.entries.where("false"), l.classifications), 4))


@query(f"""WITH RECURSIVE head AS (SELECT id, reserved_amount AS whole, status, settled_amount, CAST(floor(reserved_amount * 50) AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS leg FROM reservations),
f(id, whole, leg, n, action, reject_reason, status, done) AS (SELECT id, whole, leg, -1, '', CAST(NULL AS VARCHAR), status, settled_amount FROM head
    UNION ALL SELECT id, whole, leg, n + 1, CASE WHEN n < 1 THEN 'partial' ELSE 'finalize' END,
        CASE WHEN n < 1 THEN CASE WHEN leg <= 0 THEN 'invalid_input' WHEN status NOT IN ('active', 'settling') THEN 'invalid_transition' WHEN done + leg > whole THEN 'invalid_input' END WHEN status NOT IN ('settling', 'settled') THEN 'invalid_transition' END,
        CASE WHEN n < 1 THEN CASE WHEN leg > 0 AND status IN ('active', 'settling') AND done + leg <= whole THEN 'settling' ELSE status END WHEN status = 'settling' THEN 'settled' ELSE status END,
        CAST(CASE WHEN n < 1 AND leg > 0 AND status IN ('active', 'settling') AND done + leg <= whole THEN done + leg ELSE done END AS {A}) FROM f WHERE n < 2)
SELECT id * 3 + n AS seq, id AS reservation_id, action, reject_reason, status AS status_after, done AS settled_after FROM f WHERE n >= 0""")
def settlement_fold(l: Books) -> DataFrame:
    """Two legs and a close for every reservation."""
    step = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("action")) for n, a in enumerate(("partial", "partial", "finalize")))))
    actions = l.reservations.select("id", "reserved_amount", step.alias("s")).select((F.col("id") * 3 + F.col("s.n")).alias("seq"), F.col("id").alias("reservation_id"), "s.action", F.floor(F.col("reserved_amount") / 2, F.lit(2)).cast(AMOUNT).alias("amount"), F.concat_ws("-", F.lit("leg"), F.col("id").cast("string"), F.col("s.n").cast("string")).alias("idempotency_key"))
    return reservations.settled(actions, l.reservations).select("seq", "reservation_id", "action", "reject_reason", "status_after", "settled_after")


_STEPS = f"""WITH RECURSIVE req AS (SELECT e.id AS seq, e.booking_id, e.to_status, CASE WHEN e.to_status = 'confirmed' THEN e.amount END AS amount, b.settled_amount, row_number() OVER (PARTITION BY e.booking_id ORDER BY e.id) AS n FROM bevents e JOIN bookings b ON b.id = e.booking_id),
f(seq, booking_id, to_status, n, moves, legal, status, settled, notes) AS (SELECT seq, booking_id, to_status, CAST(0 AS BIGINT), false, true, 'pending', settled_amount, '' FROM req WHERE n = 1
    UNION ALL SELECT q.seq, q.booking_id, q.to_status, q.n, q.to_status <> f.status AND g.to_status IS NOT NULL, q.to_status = f.status OR g.to_status IS NOT NULL, CASE WHEN g.to_status IS NOT NULL THEN q.to_status ELSE f.status END,
        CAST(CASE WHEN q.to_status <> f.status AND g.to_status IS NOT NULL AND coalesce(q.amount, 0) <> 0 THEN q.amount ELSE f.settled END AS {A}), CASE WHEN q.to_status <> f.status AND g.to_status IS NOT NULL THEN f.notes || q.to_status || ',' ELSE f.notes END
    FROM f JOIN req q ON q.booking_id = f.booking_id AND q.n = f.n + 1 LEFT JOIN edges g ON g.classification_id = 13 AND g.from_status = f.status AND g.to_status = q.to_status)
"""


@query(_STEPS + "SELECT seq, booking_id, to_status, CASE WHEN NOT legal THEN 'invalid_transition' END AS reject_reason, moves AS emits, status AS status_after, settled AS settled_after FROM f WHERE n > 0")
def booking_transitions(l: Books) -> DataFrame:
    """The recorded events replayed as requests on bookings that are all pending."""
    start = l.bookings.withColumn("status", F.lit("pending"))
    asked = l.booking_events.select(F.col("id").alias("seq"), "booking_id", "to_status", F.when(F.col("to_status") == "confirmed", F.col("amount")).alias("amount"))
    return bookings.transitioned(asked, start, l.lifecycles).select("seq", "booking_id", "to_status", "reject_reason", "emits", "status_after", "settled_after")


@query(_STEPS + "SELECT seq, booking_id, CASE WHEN notes = '' THEN 'new' ELSE string_split(notes, ',')[-2] END AS last_step, CASE WHEN notes = '' THEN 1 ELSE 2 END AS n_keys, CASE WHEN notes <> '' THEN CAST(seq AS VARCHAR) END AS last_seq FROM f WHERE n > 0")
def booking_metadata(l: Books) -> DataFrame:
    """The same requests, each with metadata that is merged into the booking's where it moves it."""
    start = l.bookings.withColumn("status", F.lit("pending")).withColumn("metadata", F.create_map(F.lit("step"), F.lit("new")))
    asked = l.booking_events.select(F.col("id").alias("seq"), "booking_id", "to_status", F.when(F.col("to_status") == "confirmed", F.col("amount")).alias("amount"), F.create_map(F.lit("step"), F.col("to_status"), F.lit("seq"), F.col("id").cast("string")).alias("metadata"))
    after = F.col("metadata_after")
    return bookings.transitioned(asked, start, l.lifecycles).select("seq", "booking_id", after["step"].alias("last_step"), F.size(after).alias("n_keys"), F.try_element_at(after, F.lit("seq")).alias("last_seq"))


@query(f"""WITH RECURSIVE req AS (SELECT e.id, e.account_holder, e.currency_id, e.classification_id, CAST({SIGNED} AS {A}) AS delta, row_number() OVER (PARTITION BY e.account_holder, e.currency_id, e.classification_id ORDER BY e.id) AS n FROM entries e JOIN classifications c ON c.id = e.classification_id),
f AS (SELECT id, {_ACCOUNT}, delta, n, delta >= 0 AS accepted, CAST(greatest(delta, 0) AS {A}) AS balance_after FROM req WHERE n = 1
    UNION ALL SELECT q.id, q.account_holder, q.currency_id, q.classification_id, q.delta, q.n, q.delta >= 0 OR f.balance_after + q.delta >= 0, CAST(CASE WHEN q.delta >= 0 OR f.balance_after + q.delta >= 0 THEN f.balance_after + q.delta ELSE f.balance_after END AS {A})
    FROM f JOIN req q ON q.account_holder = f.account_holder AND q.currency_id = f.currency_id AND q.classification_id = f.classification_id AND q.n = f.n + 1)
SELECT id, {_ACCOUNT}, delta, accepted, balance_after FROM f""")
def minimum_balance_admission(l: Books) -> DataFrame:
    """The movements of every account, admitted in order while the balance stays at zero or more."""
    rows = balances.with_class(l.entries, l.classifications).select("id", *ACCOUNT, money.signed().alias("delta"), money.zero().alias("min_balance"))
    return validation.with_minimum(rows, balances.direct(l.entries.where("false"), l.classifications)).select("id", *ACCOUNT, "delta", "accepted", "balance_after")


# Lookups, listings and inputs


@query("SELECT id, uid, idempotency_key, total_debit FROM journals WHERE uid = 'jrn-41'")
def journal_by_uid(l: Books) -> DataFrame:
    return audit.lookup(l.journals, uid="jrn-41").select("id", "uid", "idempotency_key", "total_debit")


@query("SELECT id, uid, idempotency_key FROM journals WHERE idempotency_key = 'ord-97'")
def journal_by_key(l: Books) -> DataFrame:
    return audit.lookup(l.journals, idempotency_key="ord-97").select("id", "uid", "idempotency_key")


@query("SELECT id, booking_id, from_status, to_status FROM bevents WHERE id = 122")
def event_by_id(l: Books) -> DataFrame:
    return audit.lookup(l.booking_events, id=122).select("id", "booking_id", "from_status", "to_status")


@query("SELECT id, uid, status, amount FROM bookings WHERE uid = 'bkg-77' AND classification_id = 13")
def booking_by_uid(l: Books) -> DataFrame:
    return audit.lookup(l.bookings, uid="bkg-77", classification_id=13).select("id", "uid", "status", "amount")


@query("SELECT id, code FROM classifications WHERE id % 3 <> 0")
def active_classifications(l: Books) -> DataFrame:
    """The classes that are left where every third is inactive."""
    return audit.listed(l.classifications.withColumn("is_active", F.col("id") % 3 != 0), active_only=True).select("id", "code")


@query("SELECT id, code FROM currencies WHERE id % 4 <> 0")
def active_currencies(l: Books) -> DataFrame:
    return audit.listed(l.currencies.withColumn("is_active", F.col("id") % 4 != 0), active_only=True).select("id", "code")


@query("SELECT DISTINCT template_code AS code FROM template_lines WHERE template_code NOT LIKE 'deposit%'")
def active_templates(l: Books) -> DataFrame:
    return audit.listed(l.templates.withColumn("is_active", ~F.col("code").startswith("deposit")), active_only=True).select("code").distinct()


@query("SELECT id, uid FROM journals ORDER BY id LIMIT 50")
def default_page(l: Books) -> DataFrame:
    """A page where no size is asked for."""
    return audit.page(l.journals, size=0).select("id", "uid")


@query(f"SELECT * FROM ({_HOLDER_TX}) WHERE account_holder = 43 AND journal_id IN (SELECT DISTINCT journal_id FROM entries e JOIN classifications c ON c.id = e.classification_id WHERE account_holder = 43 AND balance_role <> '' ORDER BY journal_id DESC LIMIT 100)")
def largest_holder_page(l: Books) -> DataFrame:
    """More rows asked for than a page of transactions gives."""
    return holder.transaction_page(l.entries, l.journals, l.journal_types, l.classifications, l.currencies, 43, size=5000)


@query(f"SELECT {_ACCOUNT}, CAST(balance AS {A}) AS balance FROM checkpoints WHERE account_holder % 2 = 0 AND account_holder > 0 UNION ALL SELECT {_ACCOUNT}, balance FROM realtime WHERE NOT (account_holder % 2 = 0 AND account_holder > 0)")
def balances_of_checkpoints_too(l: Books) -> DataFrame:
    """Every account with entries or a checkpoint, where even holders' entries were archived."""
    kept = l.entries.where("NOT (account_holder % 2 = 0 AND account_holder > 0)")
    return balances.realtime(kept, l.classifications, l.checkpoints, active_only=False)


@query("SELECT id, journal_id, CASE WHEN bool_or(bad) OVER (PARTITION BY journal_id) THEN 'invalid_input' END AS reject_reason FROM (SELECT id, journal_id, id % 70 = 1 AS bad FROM entries)")
def all_or_nothing(l: Books) -> DataFrame:
    """Entries of journals of which one in 35 has a leg without an amount: the whole journal is refused."""
    judged = l.entries.withColumn("amount", F.when(F.col("id") % 70 != 1, F.col("amount"))).withColumn("reject_reason", validation.entry_reason())
    return validation.all_or_nothing(judged, "journal_id").select("id", "journal_id", "reject_reason")


@query("SELECT id, CASE WHEN id % 6 = 0 OR id % 10 = 0 OR id % 15 = 0 THEN 'invalid_input' END AS reject_reason FROM bookings")
def booking_input_errors(l: Books) -> DataFrame:
    """Bookings of which some lack a holder, an amount or a key."""
    i = F.col("id")
    asked = l.bookings.select("id", F.lit("deposit").alias("classification_code"), F.when(i % 6 != 0, F.col("account_holder")).alias("account_holder"), "currency_id", F.when(i % 10 == 0, 0).otherwise(F.col("amount")).alias("amount"), F.when(i % 15 == 0, "").otherwise(F.col("idempotency_key")).alias("idempotency_key"))
    return validation.booking_inputs(asked).select("id", "reject_reason")


@query("SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'invalid_input' END AS reject_reason FROM reservations")
def settle_input_errors(l: Books) -> DataFrame:
    """Legs of which some lack an amount or a key."""
    i = F.col("id")
    asked = l.reservations.select("id", i.alias("reservation_id"), F.when(i % 5 != 0, F.lit(1)).cast(AMOUNT).alias("amount"), F.when(i % 7 != 0, F.col("uid")).alias("idempotency_key"))
    return validation.settle_inputs(asked, partial=True).select("id", "reject_reason")


@query("SELECT o_orderkey AS id, num > 0 AND num <= den AS is_share FROM (SELECT o_orderkey, o_orderkey % 9 - 2 AS num, o_orderkey % 6 AS den FROM orders) WHERE den > 0 UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderkey % 6 = 0")
def fraction_checks(l: Books) -> DataFrame:
    k = F.col("o_orderkey")
    return l._read("orders").select(k.alias("id"), money.is_fraction(k % 9 - 2, k % 6).alias("is_share"))


@query("""SELECT tx_hash, log_index, txlog_seq, c_custkey + 1 AS account_holder, 'deposit-1-' || tx_hash || '-' || txlog_seq AS idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY block_number, log_index) - 1 AS txlog_seq
    FROM (SELECT 'tx-' || (event_id // 3) AS tx_hash, event_id // 3 AS block_number, event_id % 3 AS log_index, 'addr-' || user_id AS address FROM events)) JOIN customer ON address = 'addr-' || c_custkey AND c_custkey % 2 = 0""")
def registered_deposits(l: Books) -> DataFrame:
    """Every event as a hit at its user's address; the even customers' addresses are registered, in upper case."""
    e = F.col("event_id")
    hits = l._read("events").select(F.lit(1).alias("chain_id"), F.concat(F.lit("tx-"), F.floor(e / 3)).alias("tx_hash"), F.floor(e / 3).alias("block_number"), (e % 3).alias("log_index"), F.concat(F.lit("Addr-"), "user_id").alias("to_address"))
    known = l._read("customer").where("c_custkey % 2 = 0").select(F.lit(1).alias("chain_id"), F.concat(F.lit("ADDR-"), "c_custkey").alias("address"), (F.col("c_custkey") + 1).alias("account_holder"))
    return deposits.registered(hits, known).select("tx_hash", "log_index", "txlog_seq", "account_holder", "idempotency_key")


@query(f"SELECT {_ACCOUNT}, CASE WHEN account_holder % 3 = 0 AND account_holder % 2 = 0 THEN CAST(balance + 1 AS {A}) ELSE balance END AS balance, CASE WHEN account_holder % 3 = 0 AND account_holder % 2 = 0 THEN last_entry_id + 1 ELSE last_entry_id END AS last_entry_id FROM checkpoints")
def upserted_checkpoints(l: Books) -> DataFrame:
    """Every third holder's checkpoints come again, the even ones newer, the others older and therefore left as they are."""
    step = F.when(F.col("account_holder") % 2 == 0, 1).otherwise(-1)
    again = l.checkpoints.where("account_holder % 3 = 0").withColumn("balance", (F.col("balance") + 1).cast(AMOUNT)).withColumn("last_entry_id", F.col("last_entry_id") + step)
    return files.upsert(l.checkpoints, again, ACCOUNT, "last_entry_id")


@query("SELECT idempotency_key, min(id) AS id FROM reservations GROUP BY ALL")
def inserted_once(l: Books) -> DataFrame:
    """Reservations put in by key, the first of each; the keys that every tenth id brought before stay with them."""
    rows = l.reservations.select("idempotency_key", "id")
    first = rows.groupBy("idempotency_key").agg(F.min("id").alias("id")).where("id % 10 = 0")
    return files.insert_or_ignore(first, rows, ["idempotency_key"], ["id"])


@query(f"""SELECT account_holder, currency_id, classification_id, balance, max(last) OVER (PARTITION BY account_holder, currency_id) AS last_entry_id
    FROM (SELECT e.account_holder, e.currency_id, e.classification_id, {total(SIGNED)} AS balance, max(e.id) AS last FROM entries e JOIN classifications c ON c.id = e.classification_id GROUP BY ALL)""")
def advanced_checkpoints(l: Books) -> DataFrame:
    """The checkpoints after a batch of all entries, of which the older half was counted before."""
    return rollup.advanced(l.checkpoints, l.entries, l.classifications)
