"""The books as DuckDB views, and helpers to write oracle queries over them."""

from __future__ import annotations

import re

from tallyforge.plans.lens import NOW
from tallyforge.plans.presets import CLASSIFICATIONS, LIFECYCLES, TEMPLATES

A = "DECIMAL(30,18)"

# Journal types with their display labels, written down apart from the presets that they check.
JOURNAL_TYPES = [
    ("deposit_confirm", "Deposit Confirm", "Deposit"),
    ("deposit_pending", "Deposit Pending", "Deposit"),
    ("fx_sell", "FX Sell Leg", "Exchange"),
    ("fx_buy", "FX Buy Leg", "Exchange"),
    ("deposit_confirm_pending", "Deposit Confirm Pending", "Deposit"),
    ("deposit_release_pending", "Deposit Release Pending", "Deposit released"),
    ("deposit_record_overage", "Deposit Record Overage", "Deposit adjustment"),
    ("deposit_resolve_overage", "Deposit Resolve Overage", "Deposit adjustment"),
    ("deposit_release_overage", "Deposit Release Overage", "Deposit adjustment"),
    ("lock_funds", "Lock Funds", "Withdrawal"),
    ("unlock_funds", "Unlock Funds", "Withdrawal canceled"),
    ("withdraw_confirm", "Withdraw Confirm", "Withdrawal"),
    ("withdraw_fee", "Withdraw Fee", "Fee"),
    ("fee", "Fee Charge", "Fee"),
    ("transfer", "User-to-user Transfer", "Transfer"),
    ("capital_injection", "Capital Injection", ""),
    ("capital_withdraw", "Capital Withdrawal", ""),
    ("checkout_settlement", "Checkout Settlement", "Payment"),
]


def _values(rows: list[tuple], columns: str) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns})"


def money(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(18,2)) AS {A})"


def total(expr: str, where: str = "") -> str:
    return f"CAST(coalesce(sum({expr}){f' FILTER (WHERE {where})' if where else ''}, 0) AS {A})"


SIGNED = "CASE WHEN e.entry_type = c.normal_side THEN e.amount ELSE -e.amount END"
CREDIT, DEBIT = "entry_type = 'credit'", "entry_type = 'debit'"
HOLD = "CASE status WHEN 'active' THEN reserved_amount ELSE reserved_amount - settled_amount END"

VIEWS = {
    "currencies": "SELECT CAST(n_nationkey AS BIGINT) + 1 AS id, 'cur-' || n_nationkey AS uid, n_name AS code, 2 AS exponent FROM nation",
    "classifications": _values(CLASSIFICATIONS, "id, code, name, normal_side, is_system, balance_role, display_label"),
    "journal_types": _values([(i, *t) for i, t in enumerate(JOURNAL_TYPES, 1)], "id, code, name, display_label"),
    "template_lines": _values([(t, *line, i) for t, (_, lines) in TEMPLATES.items() for i, line in enumerate(lines, 1)], "template_code, classification_code, entry_type, holder_role, amount_key, sort_order"),
    "edges": _values([(c, a, b) for c, (_, _, graph) in LIFECYCLES.items() for a, to in graph.items() for b in to], "classification_id, from_status, to_status"),
    "ord": f"SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st, o_orderpriority AS memo, CAST(o_orderdate AS TIMESTAMP) AS day, {money('o_totalprice')} AS amount, CAST(c_nationkey AS BIGINT) + 1 AS currency_id FROM orders JOIN customer ON c_custkey = o_custkey",
    "journals": f"""SELECT o_orderkey + 1 AS id, 'jrn-' || o_orderkey AS uid, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS journal_type_id, 'ord-' || o_orderkey AS idempotency_key, {money('o_totalprice')} AS total_debit, o_orderpriority AS memo,
        CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey END AS reversal_of, CAST(o_orderdate AS TIMESTAMP) AS effective_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR AS created_at FROM orders""",
    "entries": """SELECT 2 * k + 1 AS id, k + 1 AS journal_id, o_custkey + 1 AS account_holder, currency_id, CASE st WHEN 'O' THEN 4 ELSE 1 END AS classification_id, CASE st WHEN 'F' THEN 'debit' ELSE 'credit' END AS entry_type, amount, day AS effective_at, day + INTERVAL 1 HOUR AS created_at FROM ord
        UNION ALL SELECT 2 * k + 2, k + 1, -(o_custkey + 1), currency_id, CASE st WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 9 END, CASE st WHEN 'F' THEN 'credit' ELSE 'debit' END, amount, day, day + INTERVAL 1 HOUR FROM ord""",
    "watermark": "SELECT (2 * max(o_orderkey) + 2) // 2 AS w FROM orders",
    "checkpoints": f"""SELECT account_holder, currency_id, classification_id, balance, max(last) OVER (PARTITION BY account_holder, currency_id) AS last_entry_id
        FROM (SELECT e.account_holder, e.currency_id, e.classification_id, {total(SIGNED)} AS balance, max(e.id) AS last FROM entries e JOIN classifications c ON c.id = e.classification_id, watermark WHERE e.id <= w GROUP BY ALL)""",
    "direct": f"SELECT e.account_holder, e.currency_id, e.classification_id, {total(SIGNED)} AS balance FROM entries e JOIN classifications c ON c.id = e.classification_id GROUP BY ALL",
    # The reference form: checkpoint plus a correlated sum after its watermark.
    "realtime": f"""SELECT a.account_holder, a.currency_id, a.classification_id, CAST(coalesce(p.balance, 0) + coalesce(d.delta, 0) AS {A}) AS balance
        FROM (SELECT DISTINCT account_holder, currency_id, classification_id FROM entries) a
        LEFT JOIN checkpoints p USING (account_holder, currency_id, classification_id)
        LEFT JOIN (SELECT e.account_holder, e.currency_id, e.classification_id, sum({SIGNED}) AS delta FROM entries e JOIN classifications c ON c.id = e.classification_id
            LEFT JOIN checkpoints q ON q.account_holder = e.account_holder AND q.currency_id = e.currency_id AND q.classification_id = e.classification_id WHERE e.id > coalesce(q.last_entry_id, 0) GROUP BY ALL) d USING (account_holder, currency_id, classification_id)""",
    "flows": f"SELECT account_holder, currency_id, classification_id, CAST(effective_at AS DATE) AS day, {total('amount', CREDIT)} AS inflow, {total('amount', DEBIT)} AS outflow FROM entries GROUP BY ALL",
    "snaps": f"""SELECT account_holder, currency_id, classification_id, snapshot_date, CAST(sum(net) OVER (PARTITION BY account_holder, currency_id, classification_id ORDER BY snapshot_date ROWS UNBOUNDED PRECEDING) AS {A}) AS balance
        FROM (SELECT e.account_holder, e.currency_id, e.classification_id, CAST(e.effective_at AS DATE) AS snapshot_date, sum({SIGNED}) AS net FROM entries e JOIN classifications c ON c.id = e.classification_id GROUP BY ALL) WHERE net <> 0""",
    "reservations": f"""SELECT event_id + 1 AS id, 'rsv-' || event_id AS uid, user_id + 1 AS account_holder, event_id % 25 + 1 AS currency_id, {money('value')} AS reserved_amount, CAST(CASE WHEN {money('value')} > 1 THEN 1 ELSE 0 END AS {A}) AS settled_amount,
        CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'settling' WHEN 2 THEN 'settled' ELSE 'released' END AS status, CASE WHEN event_id % 4 = 2 THEN event_id * 3 END AS journal_id, 'rsv-' || (event_id % 997) AS idempotency_key, ts + INTERVAL 2 DAY AS expires_at, ts AS created_at FROM events WHERE event_type = 'purchase'""",
    "held": f"SELECT account_holder, currency_id, {total(HOLD)} AS held FROM reservations WHERE status IN ('active', 'settling') GROUP BY ALL",
    "bookings": f"""SELECT k + 1 AS id, 'bkg-' || k AS uid, 13 AS classification_id, o_custkey + 1 AS account_holder, currency_id, amount, CAST(CASE st WHEN 'F' THEN amount ELSE 0 END AS {A}) AS settled_amount, CASE st WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'confirming' END AS status,
        CASE st WHEN 'F' THEN k + 1 END AS journal_id, CASE st WHEN 'F' THEN TIMESTAMP '1970-01-01' ELSE day + INTERVAL 1 DAY END AS expires_at FROM ord""",
    "bevents": """SELECT 3 * k + n AS id, k + 1 AS booking_id, 'deposit' AS classification_code, CASE n WHEN 1 THEN '' WHEN 2 THEN 'pending' ELSE 'confirming' END AS from_status, CASE n WHEN 1 THEN 'pending' WHEN 2 THEN 'confirming' ELSE 'confirmed' END AS to_status, amount, CASE n WHEN 3 THEN k + 1 END AS journal_id,
        day + n * INTERVAL 1 HOUR AS occurred_at, CASE (3 * k + n) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'delivered' ELSE 'dead' END AS delivery_status, (3 * k + n) % 12 AS attempts, 10 AS max_attempts, day + n * INTERVAL 1 HOUR + INTERVAL 5 MINUTE AS next_attempt_at
        FROM ord, (VALUES (1), (2), (3)) AS s(n) WHERE n = 1 OR n = 2 AND st <> 'O' OR n = 3 AND st = 'F'""",
    "queue": "SELECT event_id + 1 AS id, user_id + 1 AS account_holder, event_id % 25 + 1 AS currency_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS claimed_until, CASE WHEN event_id % 3 = 0 THEN ts END AS processed_at FROM events WHERE event_type = 'purchase'",
    "policies": _values([(1, 1, 0, 0, "active", 0, False), (2, 2, 0, 0, "frozen", 0, False), (3, 3, 0, 0, "closed", 0, False), (4, 4, 5, 0, "frozen", 0, False), (5, 5, 0, 0, "active", 1000, True), (6, 7, 0, 0, "frozen", 0, False), (7, 7, 3, 1, "active", -500, True), (8, 8, 0, 0, "closed", 0, False), (9, 10, 0, 0, "frozen", 0, False), (10, 11, 0, 0, "active", -100000, True)], "id, account_holder, currency_id, classification_id, status, min_balance, enforce_min_balance"),
    "closes": "SELECT * FROM (VALUES (1, TIMESTAMP '1995-01-01', TIMESTAMP '2024-01-01'), (2, TIMESTAMP '1997-01-01', TIMESTAMP '2024-01-02'), (3, TIMESTAMP '1996-01-01', TIMESTAMP '2024-01-03')) AS v(id, close_before, created_at)",
    "subscribers": _values([(1, "", "", True), (2, "deposit", "", True), (3, "", "confirmed", True), (4, "sweep", "confirmed", True), (5, "", "", False)], "id, filter_class, filter_to_status, is_active"),
    "clock": f"SELECT TIMESTAMP '{NOW}' AS now",
}


def oracle(body: str) -> str:
    """``body`` after the views that it uses, in the order of VIEWS."""
    wanted: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                wanted.add(name)
                add(VIEWS[name])

    add(body)
    recursive = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    views = ", ".join(f"{n} AS ({q})" for n, q in VIEWS.items() if n in wanted)
    if recursive:
        rest = body[recursive.end() :]
        return f"WITH {'RECURSIVE ' if recursive[1] else ''}{views}{', ' if views else ''}{rest}"
    return f"WITH {views} {body}" if views else body
