"""Two-phase deposits: a pending amount is added, then confirmed, cancelled or let expire."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.functions.keys import pending_expiry_key
from tallyforge.functions.money import zero
from tallyforge.operators.fold import LATER, fold, remember, with_later
from tallyforge.schemas import AMOUNT

#: The template that each action posts.
TEMPLATES = {"add": "deposit_pending", "confirm": "deposit_confirm_pending", "cancel": "deposit_release_pending", "expire": "deposit_release_pending"}


def applied(requests: DataFrame, opening: DataFrame) -> DataFrame:
    """Requests (seq, account_holder, currency_id, action, amount, idempotency_key) in order against each holder's pending balance.

    Confirming or cancelling more than is pending is refused; expiring takes at
    most what is pending and is refused where nothing is. A key that comes again
    replays if action and amount agree. ``opening`` has the pending balance
    before. Gives the template and amount to post, or the reason to refuse.
    """
    rows = requests.join(opening.select("account_holder", "currency_id", F.col("balance").alias("_opening")), ["account_holder", "currency_id"], "left").withColumn("_opening", F.coalesce("_opening", zero()))
    rows = with_later(rows, ["account_holder", "currency_id", "idempotency_key"], ["seq"])

    def step(state, row):
        balance, seen = state
        action, amount, key = row["action"], row["amount"], row["idempotency_key"]
        posted, reason = None, None
        if not row["account_holder"] or row["currency_id"] is None or action not in TEMPLATES or amount is None or amount <= 0 or not key:
            reason = "invalid_input"
        elif key in seen:
            reason = None if seen[key] == (action, amount) else "conflict"
        elif action == "add":
            posted = amount
        elif action == "expire":
            posted = min(amount, balance)
            reason = "insufficient_balance" if posted <= 0 else None
        elif amount > balance:
            reason = "insufficient_balance"
        else:
            posted = amount
        if reason is None and posted is not None:
            balance += posted if action == "add" else -posted
            seen[key] = (action, amount)
        if key in seen:
            remember(seen, row, seen[key])
        return (balance, seen), {"template_code": TEMPLATES.get(action) if reason is None and posted is not None else None, "posted": posted if reason is None else None, "pending_after": balance, "reject_reason": reason}

    return fold(rows, ["account_holder", "currency_id"], ["seq"], lambda row: (row["_opening"], {}), step, StructType.fromDDL(f"template_code string, posted {AMOUNT}, pending_after {AMOUNT}, reject_reason string")).drop("_opening", LATER)


def overdue(journals: DataFrame, entries: DataFrame, balances: DataFrame, cutoff: Column, pending_class: int, limit: int = 1000) -> DataFrame:
    """Expiry requests for the oldest pending journal of each holder and currency written before ``cutoff``, where something is still pending.

    The amount is the journal's total, at most the pending balance.
    """
    late = entries.where((F.col("classification_id") == pending_class) & (F.col("entry_type") == "credit") & (F.col("account_holder") > 0) & (F.col("created_at") < cutoff))
    number = F.row_number().over(Window.partitionBy("account_holder", "currency_id").orderBy("created_at", "journal_id"))
    first = late.withColumn("_number", number).where("_number = 1").select("account_holder", "currency_id", "journal_id", "created_at")
    open_ = balances.where((F.col("classification_id") == pending_class) & (F.col("balance") > 0)).select("account_holder", "currency_id", "balance")
    met = first.join(journals.select(F.col("id").alias("journal_id"), "total_debit"), "journal_id").join(open_, ["account_holder", "currency_id"])
    out = met.select("account_holder", "currency_id", "journal_id", "created_at", F.least("total_debit", "balance").cast(AMOUNT).alias("amount"), pending_expiry_key(F.col("journal_id")).alias("idempotency_key"))
    return out.orderBy("created_at", "journal_id").limit(limit)


def opening_of(balances: DataFrame, pending_class: int) -> DataFrame:
    return balances.where(F.col("classification_id") == pending_class).select("account_holder", "currency_id", "balance")


