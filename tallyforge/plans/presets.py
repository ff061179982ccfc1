"""Preset dimensions: classifications, journal types, templates and lifecycles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.schemas import schema

# The accounting presets.
# id, code, name, normal side, system, balance role, display label
CLASSIFICATIONS = [
    (1, "main_wallet", "Main Wallet", "debit", False, "available", ""),
    (2, "suspense", "Suspense", "debit", True, "", ""),
    (3, "custodial", "Custodial", "credit", True, "", ""),
    (4, "pending", "Pending", "credit", False, "pending", ""),
    (5, "locked", "Locked", "debit", False, "locked", ""),
    (6, "fee_expense", "Fee Expense", "debit", False, "", ""),
    (7, "fee_revenue", "Fee Revenue", "credit", True, "", ""),
    (8, "fees", "Fees", "credit", True, "", ""),
    (9, "settlement", "Settlement", "credit", True, "", ""),
    (10, "equity", "Equity", "credit", True, "", ""),
    (11, "spread", "Spread", "credit", True, "", ""),
    (12, "sweep", "Crypto Sweep", "credit", True, "", ""),
    (13, "deposit", "Deposit", "credit", False, "", ""),
    (14, "withdrawal", "Withdrawal", "credit", False, "", ""),
]
# code, name, display label
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
# template: journal type, then lines (classification, entry type, holder role, amount key)
TEMPLATES = {
    "deposit_pending": ("deposit_pending", [("suspense", "debit", "system", "amount"), ("pending", "credit", "user", "amount")]),
    "deposit_confirm": ("deposit_confirm", [("main_wallet", "debit", "user", "amount"), ("custodial", "credit", "system", "amount")]),
    "deposit_confirm_pending": ("deposit_confirm_pending", [("pending", "debit", "user", "amount"), ("main_wallet", "debit", "user", "amount"), ("suspense", "credit", "system", "amount"), ("custodial", "credit", "system", "amount")]),
    "deposit_release_pending": ("deposit_release_pending", [("pending", "debit", "user", "amount"), ("suspense", "credit", "system", "amount")]),
    "deposit_record_overage": ("deposit_record_overage", [("suspense", "debit", "system", "amount"), ("custodial", "credit", "system", "amount")]),
    "deposit_resolve_overage": ("deposit_resolve_overage", [("main_wallet", "debit", "user", "amount"), ("suspense", "credit", "system", "amount")]),
    "deposit_release_overage": ("deposit_release_overage", [("custodial", "debit", "system", "amount"), ("suspense", "credit", "system", "amount")]),
    "lock_funds": ("lock_funds", [("main_wallet", "credit", "user", "amount"), ("locked", "debit", "user", "amount")]),
    "unlock_funds": ("unlock_funds", [("main_wallet", "debit", "user", "amount"), ("locked", "credit", "user", "amount")]),
    "withdraw_confirm": ("withdraw_confirm", [("custodial", "debit", "system", "amount"), ("locked", "credit", "user", "amount")]),
    "withdraw_fee": ("withdraw_fee", [("fee_expense", "debit", "user", "fee"), ("custodial", "debit", "system", "fee"), ("locked", "credit", "user", "fee"), ("fee_revenue", "credit", "system", "fee")]),
    "fee_charge": ("fee", [("main_wallet", "debit", "user", "amount"), ("fees", "credit", "system", "amount")]),
    "fx_sell": ("fx_sell", [("main_wallet", "credit", "user", "amount"), ("settlement", "debit", "system", "amount")]),
    "fx_buy": ("fx_buy", [("settlement", "credit", "system", "amount"), ("main_wallet", "debit", "user", "amount")]),
    "transfer_out": ("transfer", [("main_wallet", "debit", "user", "amount"), ("settlement", "credit", "system", "amount")]),
    "transfer_in": ("transfer", [("settlement", "debit", "system", "amount"), ("main_wallet", "credit", "user", "amount")]),
    "capital_injection": ("capital_injection", [("custodial", "debit", "system", "amount"), ("equity", "credit", "system", "amount")]),
    "capital_withdraw": ("capital_withdraw", [("equity", "debit", "system", "amount"), ("custodial", "credit", "system", "amount")]),
    "checkout_settlement_gross": ("checkout_settlement", [("custodial", "debit", "system", "gross_amount"), ("main_wallet", "credit", "user", "gross_amount")]),
    "checkout_settlement_net": ("checkout_settlement", [("custodial", "debit", "system", "gross_amount"), ("main_wallet", "credit", "user", "net_amount"), ("fees", "credit", "system", "fee_amount")]),
}
# classification id: initial status, terminal statuses, transitions
LIFECYCLES = {
    13: ("pending", ["confirmed", "failed", "expired"], {"pending": ["confirming", "failed", "expired"], "confirming": ["confirmed", "failed", "review"], "review": ["confirmed", "failed"]}),
    14: ("locked", ["confirmed", "expired"], {"locked": ["reserved"], "reserved": ["reviewing", "processing"], "reviewing": ["processing", "failed"], "processing": ["confirmed", "failed", "expired"], "failed": ["reserved"]}),
    12: ("pending", ["confirmed"], {"pending": ["sent"], "sent": ["confirmed", "failed"], "failed": ["pending"]}),
}


def literal(spark: SparkSession, rows: list[tuple], table: str) -> DataFrame:
    """Rows of an accounting table. It reaches the optimizer with its size, unlike rows that come by way of an RDD."""
    want = schema(table)
    columns = zip(*rows, strict=True) if rows else [[] for _ in want]
    found = to_arrow_schema(want, prefers_large_types=False)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, found, strict=True)], schema=found), want)


def classifications(spark: SparkSession) -> DataFrame:
    rows = [(i, f"cls-{code}", code, name, side, system, True, role, label) for i, code, name, side, system, role, label in CLASSIFICATIONS]
    return literal(spark, rows, "classifications")


def journal_types(spark: SparkSession) -> DataFrame:
    rows = [(i, f"jt-{code}", code, name, True, label) for i, (code, name, label) in enumerate(JOURNAL_TYPES, 1)]
    return literal(spark, rows, "journal_types")


def templates(spark: SparkSession) -> DataFrame:
    """A row for each template line."""
    rows = [(t, kind, True, code, side, role, key, i) for t, (kind, lines) in TEMPLATES.items() for i, (code, side, role, key) in enumerate(lines, 1)]
    return literal(spark, rows, "templates")


def lifecycles(spark: SparkSession) -> DataFrame:
    return literal(spark, [(c, 1, i, t, list(m.items())) for c, (i, t, m) in LIFECYCLES.items()], "lifecycles")


def lifecycle_errors(initial: str, terminal: list[str], transitions: dict[str, list[str]]) -> list[str]:
    """What is wrong with a lifecycle: every rule of a valid one that it breaks. Lifecycles are configuration, so this runs on the driver."""
    out = []
    known = {*transitions, *terminal}
    if not transitions.get(initial):
        out.append(f"initial status {initial!r} has no transitions")
    out += [f"terminal status {s!r} has transitions" for s in terminal if transitions.get(s)]
    out += [f"{s!r} leads to unknown status {t!r}" for s, to in transitions.items() for t in to if t not in known]
    reached, queue = {initial}, [initial]
    while queue:
        for t in transitions.get(queue.pop(), []):
            if t not in reached:
                reached.add(t)
                queue.append(t)
    return out + [f"status {s!r} can't be reached" for s in sorted(known - reached)]
