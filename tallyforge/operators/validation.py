"""Candidate journals in, accepted and rejected out.

Every rule adds to an ordered list of reasons; a row's ``reject_reason`` is the
first that holds, null if it is accepted. Reasons are the kinds of error of
posting: invalid_input, unbalanced_journal, precision_exceeded, period_closed,
account_closed, account_frozen, insufficient_balance, duplicate_journal,
conflict, not_found, invalid_transition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.functions.money import is_precise, side_total, signed, total, zero
from tallyforge.operators.balances import ACCOUNT
from tallyforge.operators.fold import fold
from tallyforge.schemas import AMOUNT

FUTURE = "INTERVAL '5' MINUTE"


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in rules))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def entry_reason() -> Column:
    """Structure of an entry: a holder, a side, dimensions and a positive amount."""
    bad = F.col("account_holder").isNull() | (F.col("account_holder") == 0) | ~F.coalesce(F.col("entry_type").isin("debit", "credit"), F.lit(False)) | F.col("currency_id").isNull() | F.col("classification_id").isNull() | F.col("amount").isNull() | (F.col("amount") <= 0)
    return F.when(bad, "invalid_input")


def journal_structure(journals: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Keys, entries, dates, and equal sides in every currency: (journal_id, reject_reason)."""
    each = entries.groupBy("journal_id", "currency_id").agg(side_total("debit").alias("debit"), side_total("credit").alias("credit"), F.count("*").alias("n"), F.count_if(entry_reason().isNotNull()).alias("n_bad"))
    of = each.groupBy("journal_id").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.count_if(F.col("debit") != F.col("credit")).alias("n_unbalanced"))
    met = journals.select(F.col("id").alias("journal_id"), "idempotency_key", "effective_at").join(of, "journal_id", "left")
    return met.select("journal_id", first_reason((_blank("idempotency_key"), "invalid_input"), (F.coalesce("n", F.lit(0)) == 0, "invalid_input"), (F.col("effective_at") > now + F.expr(FUTURE), "invalid_input"), (F.col("n_bad") > 0, "invalid_input"), (F.col("n_unbalanced") > 0, "unbalanced_journal")).alias("reject_reason"))


def unbalanced(entries: DataFrame) -> DataFrame:
    """Journals whose sides differ in a currency."""
    return entries.groupBy("journal_id", "currency_id").agg(side_total("debit").alias("debit"), side_total("credit").alias("credit")).where("debit <> credit")


def imprecise(entries: DataFrame, currencies: DataFrame) -> DataFrame:
    """Entries with more decimals than their currency has. They are refused, never rounded."""
    met = entries.join(currencies.select(F.col("id").alias("currency_id"), "exponent"), "currency_id")
    return met.where(~is_precise(F.col("amount"), F.col("exponent")))


def close_line(period_closes: DataFrame) -> DataFrame:
    """The close line in force: that of the newest row. No rows: no line."""
    return period_closes.agg(F.max_by("close_before", F.struct("created_at", "id")).alias("close_before"))


def in_closed_period(journals: DataFrame, period_closes: DataFrame) -> DataFrame:
    """Journals effective before the close line (one row, sent to all)."""
    return journals.join(F.broadcast(close_line(period_closes)), F.col("effective_at") < F.col("close_before"), "inner")


def effective_policies(accounts: DataFrame, policies: DataFrame) -> DataFrame:
    """Each account with the most specific policy: its class and currency, else its currency, else the holder's."""
    def tier(n: int) -> DataFrame:
        keep = [F.col("currency_id") == 0, (F.col("currency_id") != 0) & (F.col("classification_id") == 0), (F.col("currency_id") != 0) & (F.col("classification_id") != 0)][n]
        return policies.where(keep).select(*ACCOUNT[: n + 1], F.struct("id", "status", "min_balance", "enforce_min_balance").alias(f"_p{n}"))

    met = accounts
    for n in range(3):
        met = met.join(tier(n), ACCOUNT[: n + 1], "left")
    p = F.coalesce("_p2", "_p1", "_p0")
    return met.select(*accounts.columns, p["id"].alias("policy_id"), p["status"].alias("policy_status"), p["min_balance"].alias("min_balance"), p["enforce_min_balance"].alias("enforce_min_balance"))


def policy_violations(entries: DataFrame, classifications: DataFrame, policies: DataFrame, balances: DataFrame) -> DataFrame:
    """Journals that a policy forbids, with the first reason.

    Closed forbids any entry; frozen forbids a net decrease over all accounts of
    the policy's row in the journal; a minimum is held against each account's
    balance after the journal, with ``balances`` as they were before it.
    """
    side = classifications.select(F.col("id").alias("classification_id"), "normal_side")
    dims = entries.join(side, "classification_id").groupBy("journal_id", *ACCOUNT).agg(total(signed()).alias("delta"))
    met = effective_policies(dims, policies).where("policy_id IS NOT NULL").join(balances.select(*ACCOUNT, "balance"), ACCOUNT, "left")
    after = (F.coalesce("balance", zero()) + F.col("delta")).cast(AMOUNT)
    met = met.withColumn("_below", F.col("enforce_min_balance") & (after < F.col("min_balance")))
    row = met.groupBy("journal_id", "policy_id").agg(F.max((F.col("policy_status") == "closed").cast("int")).alias("closed"), F.when(F.max("policy_status") == "frozen", total(F.col("delta"))).alias("frozen_delta"), F.max(F.col("_below").cast("int")).alias("below"))
    judged = row.groupBy("journal_id").agg(F.max("closed").alias("closed"), F.min("frozen_delta").alias("frozen_delta"), F.max("below").alias("below"))
    reason = first_reason((F.col("closed") == 1, "account_closed"), (F.col("frozen_delta") < 0, "account_frozen"), (F.col("below") == 1, "insufficient_balance"))
    return judged.select("journal_id", reason.alias("reject_reason")).where("reject_reason IS NOT NULL")


def fingerprint(journals: DataFrame, entries: DataFrame) -> DataFrame:
    """A hash of what must agree for two journals to be one request: head, totals, metadata and the multiset of entries.

    Metadata is the map column ``metadata`` where there is one (the order of its
    entries doesn't matter), and the memo.
    """
    leg = F.concat_ws("|", F.col("account_holder").cast("string"), F.col("currency_id").cast("string"), F.col("classification_id").cast("string"), "entry_type", F.col("amount").cast("string"))
    # The multiset as a count, a sum and an xor of leg hashes: order doesn't matter and nothing is collected.
    legs = entries.groupBy("journal_id").agg(F.count("*").alias("_n"), F.sum(F.xxhash64(leg).cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64(leg, F.lit(7))).alias("_xor"))
    head = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("journal_type_id", "actor_id", "source", "event_id", "reversal_of", "total_debit", "total_credit", "_n", "_sum", "_xor")]
    head += [F.coalesce(F.col("memo"), F.lit(""))] if "memo" in journals.columns else []
    head += [F.coalesce(F.to_json(F.array_sort(F.map_entries("metadata"))), F.lit(""))] if "metadata" in journals.columns else []
    return journals.join(legs.withColumnRenamed("journal_id", "id"), "id", "left").withColumn("fingerprint", F.sha2(F.concat_ws("|", *head), 256))


def idempotency(candidates: DataFrame, posted: DataFrame) -> DataFrame:
    """Each candidate as new, replay or conflict against what was posted and the candidates before it.

    Both have (id, idempotency_key, fingerprint), and may have effective_at: a
    candidate that sets it (not null) must agree with what stands; one that leaves
    it open takes the time of posting and agrees with any.
    """
    timed = "effective_at" in candidates.columns and "effective_at" in posted.columns
    at = (lambda d: F.col("effective_at") if timed else F.lit(None).cast("timestamp_ntz"))
    candidates, posted = candidates.withColumn("_at", at(candidates)), posted.withColumn("_at", at(posted))
    old = posted.select("idempotency_key", F.col("fingerprint").alias("_old"), F.col("_at").alias("_old_at"))
    first, first_at = (F.first(c).over(Window.partitionBy("idempotency_key").orderBy("id")) for c in ("fingerprint", "_at"))
    number = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("id"))
    met = candidates.select("id", "idempotency_key", "fingerprint", "_at", first.alias("_first"), first_at.alias("_first_at"), number.alias("_number")).join(old, "idempotency_key", "left")
    against = F.coalesce("_old", F.when(F.col("_number") > 1, F.col("_first")))
    stands = F.when(F.col("_old").isNotNull(), F.col("_old_at")).otherwise(F.col("_first_at"))
    agrees = (against == F.col("fingerprint")) & (F.col("_at").isNull() | stands.isNull() | (F.col("_at") == stands))
    return met.select("id", "idempotency_key", F.when(against.isNull(), "new").when(agrees, "replay").otherwise("conflict").alias("outcome"))


def post(journals: DataFrame, entries: DataFrame, classifications: DataFrame, currencies: DataFrame, policies: DataFrame, period_closes: DataFrame, balances: DataFrame, posted: DataFrame, now: Column) -> DataFrame:
    """Every candidate journal with its outcome: (journal_id, outcome, reject_reason). ``posted`` has fingerprints."""
    seen = idempotency(fingerprint(journals, entries), posted).select(F.col("id").alias("journal_id"), "outcome")
    reasons = [
        journal_structure(journals, entries, now).where("reject_reason IS NOT NULL").select("journal_id", F.lit(1).alias("n"), "reject_reason"),
        entries.join(classifications.where("is_active").select(F.col("id").alias("classification_id")), "classification_id", "left_anti").select("journal_id", F.lit(3).alias("n"), F.lit("not_found").alias("reject_reason")),
        imprecise(entries, currencies).select("journal_id", F.lit(4).alias("n"), F.lit("precision_exceeded").alias("reject_reason")),
        in_closed_period(journals, period_closes).select(F.col("id").alias("journal_id"), F.lit(5).alias("n"), F.lit("period_closed").alias("reject_reason")),
        policy_violations(entries, classifications, policies, balances).select("journal_id", F.lit(6).alias("n"), "reject_reason"),
    ]
    every = reasons[0]
    for more in reasons[1:]:
        every = every.unionByName(more)
    worst = every.groupBy("journal_id").agg(F.min(F.struct("n", "reject_reason")).alias("worst"))
    # A conflict comes second, after what is wrong with the journal itself. Its fingerprints are made once.
    met = journals.select(F.col("id").alias("journal_id")).join(worst, "journal_id", "left").join(seen, "journal_id", "left")
    conflict = (F.col("outcome") == "conflict") & (F.coalesce("worst.n", F.lit(9)) > 2)
    met = met.withColumn("reject_reason", F.when(conflict, "conflict").otherwise(F.col("worst.reject_reason")))
    return met.select("journal_id", F.when(F.col("reject_reason").isNotNull(), "rejected").when(F.col("outcome") == "replay", "replayed").otherwise("accepted").alias("outcome"), "reject_reason")


def rendered(requests: DataFrame, templates: DataFrame, classifications: DataFrame) -> DataFrame:
    """Entries of template requests ``(request_id, template_code, holder, currency_id, amounts map)``, or the reason why there are none.

    A user line is the holder's, a system line its mirror's. A request fails as a
    whole if the template is unknown or inactive, the holder isn't a user, or an
    amount is missing or not positive.
    """
    lines = templates.select(F.col("code").alias("template_code"), "is_active", "classification_code", "entry_type", "holder_role", "amount_key", "sort_order")
    classes = classifications.select(F.col("code").alias("classification_code"), F.col("id").alias("classification_id"))
    met = requests.join(lines, "template_code", "left").join(classes, "classification_code", "left").withColumn("amount", F.try_element_at(F.col("amounts"), F.col("amount_key")).cast(AMOUNT))
    each = Window.partitionBy("request_id")
    ok = F.coalesce(F.col("is_active"), F.lit(False)) & (F.col("holder") > 0) & F.col("classification_id").isNotNull() & F.coalesce(F.col("amount") > 0, F.lit(False))
    reason = F.when(F.max(F.col("sort_order").isNull()).over(each), "not_found").when(F.min(ok).over(each), None).otherwise("invalid_input")
    holder = F.when(F.col("holder_role") == "system", -F.col("holder")).otherwise(F.col("holder"))
    out = met.withColumn("reject_reason", reason).withColumn("account_holder", holder)
    good = F.col("reject_reason").isNull()
    return out.select("request_id", "template_code", "reject_reason", *(F.when(good, F.col(c)).alias(c) for c in ("account_holder", "currency_id", "classification_id", "entry_type", "amount", "sort_order"))).distinct()


def all_or_nothing(judged: DataFrame, batch: str, reason: str = "reject_reason") -> DataFrame:
    """Every row of a batch refused if one of its members is; the reason is the first by name."""
    whole = F.min(reason).over(Window.partitionBy(batch))
    return judged.withColumn(reason, F.coalesce(reason, whole))


def with_minimum(movements: DataFrame, opening: DataFrame) -> DataFrame:
    """Movements (id, account, delta, min_balance) admitted in id order while the balance stays at or above the minimum: an ordered fold for each account."""
    rows = movements.join(opening.select(*ACCOUNT, F.col("balance").alias("opening")), ACCOUNT, "left").withColumn("opening", F.coalesce("opening", zero()))

    def step(balance, row):
        after = balance + row["delta"]
        if row["delta"] < 0 and after < row["min_balance"]:
            return balance, {"accepted": False, "balance_after": balance}
        return after, {"accepted": True, "balance_after": after}

    return fold(rows, ACCOUNT, ["id"], lambda row: row["opening"], step, StructType.fromDDL(f"accepted boolean, balance_after {AMOUNT}"))


def policy_inputs(policies: DataFrame) -> DataFrame:
    """Structure of policies: a holder, a known status, a currency wherever there is a class."""
    return policies.withColumn("reject_reason", first_reason((F.coalesce("account_holder", F.lit(0)) == 0, "invalid_input"), ((F.col("classification_id") != 0) & (F.col("currency_id") == 0), "invalid_input"), (~F.coalesce(F.col("status").isin("active", "frozen", "closed"), F.lit(False)), "invalid_input")))


def currency_inputs(currencies: DataFrame) -> DataFrame:
    return currencies.withColumn("reject_reason", first_reason((_blank("code"), "invalid_input"), (_blank("name"), "invalid_input"), (~F.col("exponent").between(0, 18), "invalid_input")))


def template_inputs(templates: DataFrame) -> DataFrame:
    """Templates (by code) need lines of both sides, known roles and amount keys."""
    bad = ~F.coalesce(F.col("entry_type").isin("debit", "credit"), F.lit(False)) | ~F.coalesce(F.col("holder_role").isin("user", "system"), F.lit(False)) | _blank("amount_key") | _blank("classification_code")
    found = templates.groupBy("code").agg(F.count_if(bad).alias("n_bad"), F.count_if(F.col("entry_type") == "debit").alias("n_debit"), F.count_if(F.col("entry_type") == "credit").alias("n_credit"))
    return found.select("code", first_reason((_blank("code"), "invalid_input"), (F.col("n_bad") > 0, "invalid_input"), ((F.col("n_debit") == 0) | (F.col("n_credit") == 0), "invalid_input")).alias("reject_reason"))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)) == 0


def _not_positive(c: str) -> Column:
    return ~F.coalesce(F.col(c) > 0, F.lit(False))


def _negative(c: str) -> Column:
    return F.coalesce(F.col(c) < 0, F.lit(False))


def _judged(rows: DataFrame, *bad: Column) -> DataFrame:
    any_bad = F.lit(False)
    for b in bad:
        any_bad = any_bad | b
    return rows.withColumn("reject_reason", F.when(any_bad, "invalid_input"))


def booking_inputs(rows: DataFrame) -> DataFrame:
    """Bookings need a class code, a holder, a currency, a positive amount and a key."""
    return _judged(rows, _blank("classification_code"), _zero("account_holder"), F.col("currency_id").isNull(), _not_positive("amount"), _blank("idempotency_key"))


def transition_inputs(rows: DataFrame) -> DataFrame:
    """Transitions need a booking and a status; an amount of zero moves no money, a negative one is refused."""
    return _judged(rows, F.col("booking_id").isNull(), _blank("to_status"), _negative("amount"))


def settle_inputs(rows: DataFrame, partial: bool = False) -> DataFrame:
    """Settlements need a reservation and a positive amount, legs a key too."""
    return _judged(rows, F.col("reservation_id").isNull(), _not_positive("amount"), *([_blank("idempotency_key")] if partial else []))


def pending_inputs(rows: DataFrame) -> DataFrame:
    return _judged(rows, _zero("account_holder"), F.col("currency_id").isNull(), _not_positive("amount"), _blank("idempotency_key"))


def period_inputs(rows: DataFrame) -> DataFrame:
    return _judged(rows, F.col("close_before").isNull())


def sighting_inputs(rows: DataFrame) -> DataFrame:
    """Sightings need a chain, a transaction, a sequence, a token, a receiver, a positive amount and a real block."""
    return _judged(rows, _not_positive("chain_id"), _blank("tx_hash"), _negative("txlog_seq"), _blank("token"), _blank("to_address"), _not_positive("amount"), _negative("confirmations"), _not_positive("block_number"))


def sweep_policy_inputs(rows: DataFrame) -> DataFrame:
    return _judged(rows, _not_positive("chain_id"), _blank("token"), _negative("min_threshold"), _negative("gas_ceiling"), _not_positive("batch_limit"), _not_positive("interval_seconds"))
