"""Worked examples with literal results."""

import datetime as dt
from decimal import Decimal as D

import pytest
from small_books import CLASS, DAY, currencies, dims, entries, journals, reservations, rows
from pyspark.sql import functions as F

from tallyforge.operators import audit, balances, bookings, delivery, deposits, holder, pending, reconcile, reversals, series, validation
from tallyforge.operators import reservations as holds
from tallyforge.plans import presets

ACCOUNT = balances.ACCOUNT


@pytest.fixture(scope="module")
def d(spark):
    return dims(spark)


def day(n):
    return F.lit(DAY + dt.timedelta(days=n)).cast("timestamp_ntz")


def test_trial_balance(spark, d):
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", 200), (1, -1, 1, "custodial", "credit", 200)])
    t = balances.trial_balance(e, d.classifications, day(1))
    assert rows(t, "classification_code", "net") == [("custodial", 200), ("main_wallet", 200)]
    assert rows(balances.trial_totals(t), "total_debit", "total_credit", "balanced") == [(200, 200, True)]


def test_trial_balance_and_as_of_bounds(spark, d):
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", 40, -10), (1, -1, 1, "custodial", "credit", 40, -10)])
    assert balances.trial_balance(e, d.classifications, day(-11)).count() == 0
    assert balances.trial_balance(e, d.classifications, day(-10)).count() == 2, "inclusive"
    assert balances.as_of(e, d.classifications, day(-10)).count() == 0, "exclusive"
    assert rows(balances.as_of(e, d.classifications, day(-5)), "account_holder", "balance") == [(-1, 40), (1, 40)]


def test_breakdown(spark, d):
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", 100), (2, 1, 1, "main_wallet", "credit", 30), (3, 1, 1, "main_wallet", "credit", 5), (2, 1, 1, "locked", "debit", 30), (4, 1, 1, "pending", "credit", 40), (3, 1, 1, "fee_expense", "debit", 5)])
    held = holder.held(reservations(spark, [(1, 1, 1, 20, 0, "active")]))
    assert rows(balances.breakdown(balances.direct(e, d.classifications), d.classifications, held), "available", "pending", "locked", "total") == [(45, 40, 50, 135)]


def _holder_books(spark):
    e = entries(spark, [
        (1, 1, 1, "main_wallet", "debit", 100), (1, -1, 1, "custodial", "credit", 100), (2, 1, 1, "main_wallet", "credit", 5), (2, 1, 1, "fee_expense", "debit", 5), (3, 1, 1, "main_wallet", "credit", 30), (3, 1, 1, "locked", "debit", 30),
        (4, 1, 1, "main_wallet", "credit", 20), (4, -1, 1, "settlement", "debit", 20), (4, 1, 2, "main_wallet", "debit", 18), (4, -1, 2, "settlement", "credit", 18), (5, 1, 1, "main_wallet", "credit", 100), (5, -1, 1, "custodial", "debit", 100),
    ])
    return e, journals(spark, [(1, "deposit_confirm"), (2, "withdraw_fee"), (3, "lock_funds"), (4, "fx_sell"), (5, "deposit_confirm", 1)])


def test_holder_transactions(spark, d):
    e, j = _holder_books(spark)
    page = holder.transaction_page(e, j, d.journal_types, d.classifications, d.currencies, 1).collect()
    assert [(r.journal_id, r.currency_code, r.direction, r.amount, r.kind_label, r.reversal_of_uid) for r in page] == [
        (5, "USD", "out", 100, "Deposit", "jrn-1"), (4, "EUR", "in", 18, "Exchange", ""), (4, "USD", "out", 20, "Exchange", ""), (2, "USD", "out", 5, "Fee", ""), (1, "USD", "in", 100, "Deposit", ""),
    ]


def test_zero_net_journal_takes_a_place_on_the_page(spark, d):
    e, j = _holder_books(spark)
    page = holder.transaction_page(e, j, d.journal_types, d.classifications, d.currencies, 1, before_id=4, size=2)
    assert [r.journal_id for r in page.collect()] == [2]


def test_fraction_reversals(spark, d):
    """1/3 of 100.01 twice, then a third is too much, then all that is left, then nothing is."""
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", "100.01"), (1, -1, 1, "custodial", "credit", "100.01")])
    done = D(0)
    found = []
    for num, den in ((1, 3), (1, 3), (1, 3), (1, 1), (1, 1)):
        so_far = spark.createDataFrame([(1, 1, 1, CLASS["main_wallet"], "debit", done), (1, -1, 1, CLASS["custodial"], "credit", done)], "original_id long, account_holder long, currency_id long, classification_id long, entry_type string, reversed decimal(30,18)")
        out = reversals.by_fraction(e, num, den, 2, so_far).collect()
        assert len({(r.amount, r.reject_reason) for r in out}) == 1
        found.append(out[0].reject_reason or out[0].amount)
        done += out[0].amount or 0
    assert found == [D("33.34"), D("33.34"), "conflict", D("33.33"), "conflict"]
    assert done == D("100.01")


def test_over_reversal(spark):
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", 90), (1, -1, 1, "custodial", "credit", 90)])
    done, found = D(0), []
    for num, den in ((2, 3), (1, 2), (1, 3)):
        so_far = spark.createDataFrame([(1, 1, 1, CLASS["main_wallet"], "debit", done), (1, -1, 1, CLASS["custodial"], "credit", done)], "original_id long, account_holder long, currency_id long, classification_id long, entry_type string, reversed decimal(30,18)")
        r = reversals.by_fraction(e, num, den, 2, so_far).first()
        found.append(r.reject_reason)
        done += r.amount or 0
    assert found == [None, "conflict", None]


def test_global_totals_beyond_an_amount(spark):
    most = "999999999999.000000000000000001"
    e = entries(spark, [(j, h, 1, c, side, most) for j in (1, 2, 3) for h, c, side in ((1, "main_wallet", "debit"), (-1, "custodial", "credit"))])
    assert rows(balances.global_totals(e), "total_debit", "total_credit") == [(D("2999999999997.000000000000000003"),) * 2]
    assert rows(balances.global_totals(e.limit(0)), "total_debit", "total_credit") == [(0, 0)]


def test_reversal_chain_from_either_end(spark):
    j = journals(spark, [(1, "deposit_confirm"), (2, "deposit_confirm", 1), (3, "fee")])
    for start in (1, 2):
        assert rows(audit.reversal_chain(spark, j, start), "journal_id") == [(1,), (2,)]
    assert rows(audit.reversal_chains(spark, j), "root_id", "journal_id", "depth") == [(1, 1, 0), (1, 2, 1)]


def test_reversal_chains_beyond_the_limit_of_recursive_rows(spark):
    j = journals(spark, [(3 * i + k, "fee", 3 * i + k - 1 if k > 1 else None) for i in range(20) for k in (1, 2, 3)])
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "10")
    try:
        found = audit.reversal_chains(spark, j)
        assert rows(found, "root_id", "journal_id", "depth") == [(3 * i + 1, 3 * i + 1 + k, k) for i in range(20) for k in range(3)]
        assert found.count() == 60 and found.where("depth = 2").count() == 20
    finally:
        spark.conf.set(limit, before)


def test_full_reversal_reasons(spark):
    e, j = _holder_books(spark)
    asked = spark.createDataFrame([(1,), (2,), (5,), (9,)], "journal_id long")
    got = reversals.full(asked, j, e)
    assert {(r.journal_id, r.reject_reason) for r in got.collect()} == {(1, "already_reversed"), (2, None), (5, "is_reversal"), (9, "not_found")}
    assert rows(got.where("journal_id = 2"), "entry_type", "amount") == [("credit", 5), ("debit", 5)]


def test_gap_fill(spark, d):
    account = spark.createDataFrame([(1, 1, 1)], "account_holder long, currency_id long, classification_id long")
    snap = presets.literal(spark, [(1, 1, 1, (DAY - dt.timedelta(days=3)).date(), D(250)), (1, 1, 1, DAY.date(), D(500))], "snapshots")
    flows = series.daily_flows(entries(spark, [(1, 1, 1, "main_wallet", "debit", 500)]))
    got = series.trend(account, snap, flows, F.lit((DAY - dt.timedelta(days=4)).date()), F.lit(DAY.date())).orderBy("day").collect()
    assert [r.balance for r in got] == [0, 250, 250, 250, 500]
    assert [r.outflow for r in got] == [0, 0, 0, 0, 500], "a debit is outflow whatever the normal side"
    none = series.trend(account.withColumn("account_holder", F.lit(99).cast("long")), snap, flows, F.lit("2024-01-01"), F.lit("2024-01-03"))
    assert [r.balance for r in none.collect()] == [0, 0, 0]


def test_solvency(spark, d):
    e = [(1, 1, 1, "main_wallet", "debit", 1000), (1, -1, 1, "custodial", "credit", 1000)]
    of = lambda x: rows(balances.solvency(balances.direct(entries(spark, x), d.classifications), d.classifications), "custodial", "liability", "margin", "solvent")
    assert of(e) == [(1000, 1000, 0, True)]
    assert of([*e, (2, 2, 1, "main_wallet", "debit", 500), (2, -2, 1, "equity", "credit", 500)]) == [(1000, 1500, -500, False)]


def test_checkpoint_plus_delta_for_every_watermark(spark, d):
    e = entries(spark, [(k, 1 + k % 3, 1, ("main_wallet", "pending", "locked")[k % 3], ("debit", "credit")[k % 2], k) for k in range(1, 13)])
    want = rows(balances.direct(e, d.classifications), *ACCOUNT, "balance")
    for upto in (0, 1, 5, 11, 12):
        cp = balances.checkpoints_of(e, d.classifications, upto)
        assert rows(balances.realtime(e, d.classifications, cp), *ACCOUNT, "balance") == want


def test_sums_keep_the_last_decimal(spark, d):
    tiny = D("0.000000000000000001")
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", "123456789012"), (2, 1, 1, "main_wallet", "debit", tiny)])
    cp = balances.checkpoints_of(e, d.classifications, 1)
    assert balances.realtime(e, d.classifications, cp).first().balance == D("123456789012.000000000000000001")


def test_sparse_snapshots(spark, d):
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", 500, 1), (2, 1, 1, "main_wallet", "debit", 100, 3)])
    assert rows(series.sparse_snapshots(e, d.classifications), "balance") == [(500,), (600,)]
    dense = presets.literal(spark, [(1, 1, 1, (DAY + dt.timedelta(days=k)).date(), D(b)) for k, b in ((1, 500), (2, 500), (3, 600))], "snapshots")
    assert rows(series.changed_only(dense), "balance") == [(500,), (600,)]


def test_reconciliation_clean_and_broken(spark, d):
    e, j = _holder_books(spark)
    none = presets.literal(spark, [], "rollup_queue")
    cp = balances.checkpoints_of(e, d.classifications, 6)
    run = lambda e=e, j=j, cp=cp, r=None, q=none: {x.check_name: x.n_findings for x in reconcile.report(e, j, d.classifications, cp, balances.direct(e, d.classifications), r or reservations(spark, []), q, day(1)).collect() if not x.passed}
    assert run() == {"non_negative_balances": 1, "settlement_netting": 2}
    more = entries(spark, [(99, 7, 1, "main_wallet", "debit", 1)]).withColumn("id", F.lit(1000).cast("long"))
    broken = run(e=e.unionByName(more))
    assert broken["orphan_entries"] == 1 and broken["journal_dr_cr"] == 1 and broken["accounting_equation"] == 1
    assert run(cp=cp.withColumn("balance", (F.col("balance") + 1).cast("decimal(30,18)")))["checkpoint_balance"] == cp.count()
    lost = reservations(spark, [(1, 1, 1, 5, 0, "settled")]).withColumn("journal_id", F.lit(77).cast("long"))
    assert run(r=lost)["orphan_reservations"] == 1
    assert run(j=j.withColumn("idempotency_key", F.lit("same")))["idempotency_uniqueness"] == 1
    stale = presets.literal(spark, [(1, 1, 1, 1, DAY, None, 0), (2, 1, 1, 1, DAY, DAY, 0), (3, 1, 1, 1, None, None, 0)], "rollup_queue")
    assert run(q=stale)["stale_rollup_queue"] == 1


def test_tolerance(spark):
    asked = spark.createDataFrame([(1, D(100), D(100), D(1)), (2, D(100), D(98), D(5)), (3, D(100), D(90), D(5)), (4, D(100), D(102), D(5)), (5, D(100), D(110), D(5)), (6, D(0), D(1), D(1))], "id int, expected decimal(30,18), actual decimal(30,18), tol decimal(30,18)")
    got = deposits.tolerance(asked, F.col("tol")).orderBy("id").collect()
    assert [r.outcome for r in got] == ["exact_match", "shortfall_auto_released", "shortfall_pending", "overage_auto_credited", "overage_recorded", "invalid_input"]
    assert [r.requires_review for r in got] == [False, False, True, False, True, False]
    assert [[(s.template_code, s.amount) for s in r.steps] for r in got[:2]] == [[("deposit_confirm_pending", 100)], [("deposit_confirm_pending", 98), ("deposit_release_pending", 2)]]


def test_admission_is_greedy_in_order(spark):
    asked = spark.createDataFrame([(i, 1, 1, D(a), k) for i, a, k in ((1, 5, "a"), (2, 7, "b"), (3, 3, "c"), (4, 9, "d"), (5, 5, "a"), (6, 6, "a"), (7, 2, ""))], "id long, account_holder long, currency_id long, amount decimal(30,18), idempotency_key string")
    left = spark.createDataFrame([(1, 1, D(10))], "account_holder long, currency_id long, available decimal(30,18)")
    got = holds.admitted(asked, left).orderBy("id").collect()
    assert [r.accepted for r in got] == [True, False, True, False, True, False, False]
    assert [r.reject_reason for r in got] == [None, "insufficient_balance", None, "insufficient_balance", None, "conflict", "invalid_input"]


def test_settlement(spark):
    r = reservations(spark, [(1, 1, 1, 10, 0, "active"), (2, 1, 1, 10, 0, "active"), (3, 1, 1, 10, 0, "active")])
    acts = [(1, 1, "partial", 4, "x"), (2, 1, "partial", 4, "x"), (3, 1, "partial", 7, "y"), (4, 1, "settle", 5, ""), (5, 1, "finalize", 0, ""), (6, 1, "release", 0, ""), (7, 2, "settle", 11, ""), (8, 2, "settle", 10, ""), (9, 3, "partial", 1, "z"), (10, 3, "release", 0, ""), (11, 9, "release", 0, "")]
    asked = spark.createDataFrame([(s, i, a, D(n), k) for s, i, a, n, k in acts], "seq long, reservation_id long, action string, amount decimal(30,18), idempotency_key string")
    got = {x.seq: (x.reject_reason, x.status_after, x.settled_after) for x in holds.settled(asked, r).collect()}
    assert got[2] == (None, "settling", 4), "a leg that comes again"
    assert got[3][0] == "invalid_input" and got[4][0] == "invalid_transition"
    assert got[5] == (None, "settled", 4) and got[6][0] == "invalid_transition"
    assert got[7][0] == "invalid_input" and got[8] == (None, "settled", 10)
    assert got[10] == (None, "released", 1) and got[11][0] == "not_found"


def test_booking_transitions(spark, d):
    b = presets.literal(spark, [(1, "b1", CLASS["deposit"], 1, 1, D(5), D(0), "pending", "evm", "r", None, "k", DAY)], "bookings")
    asked = spark.createDataFrame([(i, 1, s, None if a is None else D(a)) for i, s, a in ((1, "confirming", None), (2, "confirming", None), (3, "pending", None), (4, "confirmed", 5), (5, "failed", None))], "seq long, booking_id long, to_status string, amount decimal(30,18)")
    got = bookings.transitioned(asked, b, d.lifecycles).orderBy("seq").collect()
    assert [(r.reject_reason, r.emits) for r in got] == [(None, True), (None, False), ("invalid_transition", False), (None, True), ("invalid_transition", False)]
    assert got[-1].status_after == "confirmed" and got[-1].settled_after == 5


def test_policies(spark, d):
    p = presets.literal(spark, [(1, 1, 0, 0, "frozen", D(0), False), (2, 2, 0, 0, "closed", D(0), False), (3, 2, 1, 0, "active", D(0), False), (4, 3, 1, 1, "active", D(10), True)], "account_policies")
    e = entries(spark, [
        (1, 1, 1, "main_wallet", "debit", 5), (2, 1, 1, "main_wallet", "credit", 5), (3, 1, 1, "pending", "debit", 5), (3, 1, 1, "main_wallet", "debit", 5), (4, 2, 1, "main_wallet", "debit", 5), (5, 2, 2, "main_wallet", "debit", 5),
        (6, 3, 1, "main_wallet", "credit", 5), (7, 3, 1, "pending", "credit", 5),
    ])
    before = spark.createDataFrame([(3, 1, 1, D(12))], "account_holder long, currency_id long, classification_id long, balance decimal(30,18)")
    assert rows(validation.policy_violations(e, d.classifications, p, before), "journal_id", "reject_reason") == [(2, "account_frozen"), (5, "account_closed"), (6, "insufficient_balance")]


def test_journal_structure(spark):
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", 5), (1, -1, 1, "custodial", "credit", 5), (2, 1, 1, "main_wallet", "debit", 5), (2, -1, 2, "custodial", "credit", 5), (4, 0, 1, "main_wallet", "debit", 5), (4, -1, 1, "custodial", "credit", 5)])
    j = journals(spark, [(k, "fee") for k in (1, 2, 3, 4)])
    assert rows(validation.journal_structure(j, e, day(0)), "journal_id", "reject_reason") == [(1, None), (2, "unbalanced_journal"), (3, "invalid_input"), (4, "invalid_input")]
    assert {r.reject_reason for r in validation.journal_structure(j.where("id = 1"), e, day(-1)).collect()} == {"invalid_input"}, "too far in the future"


def test_idempotency(spark):
    e = entries(spark, [(k, 1, 1, "main_wallet", "debit", a) for k, a in ((1, 5), (2, 5), (3, 6), (4, 7))])
    j = journals(spark, [(k, "fee") for k in (1, 2, 3, 4)]).withColumn("idempotency_key", F.when(F.col("id") <= 3, "a").otherwise("b"))
    f = validation.fingerprint(j, e)
    assert rows(validation.idempotency(f, f.where("false")), "id", "outcome") == [(1, "new"), (2, "replay"), (3, "conflict"), (4, "new")]
    assert rows(validation.idempotency(f.where("id > 1"), f.where("id = 1")), "id", "outcome") == [(2, "replay"), (3, "conflict"), (4, "new")]


def test_templates(spark, d):
    asked = spark.createDataFrame([(1, "deposit_confirm", 7, 1, {"amount": D(3)}), (2, "withdraw_fee", 7, 1, {"amount": D(3)}), (3, "nope", 7, 1, {"amount": D(3)}), (4, "lock_funds", -7, 1, {"amount": D(3)}), (5, "checkout_settlement_net", 7, 1, {"gross_amount": D(10), "net_amount": D(9), "fee_amount": D(1)})], "request_id int, template_code string, holder long, currency_id long, amounts map<string,decimal(30,18)>")
    got = validation.rendered(asked, d.templates, d.classifications)
    assert {(r.request_id, r.reject_reason) for r in got.collect()} == {(1, None), (2, "invalid_input"), (3, "not_found"), (4, "invalid_input"), (5, None)}
    assert rows(got.where("request_id = 5"), "account_holder", "entry_type", "amount") == [(-7, "credit", 1), (-7, "debit", 10), (7, "credit", 9)]
    whole = validation.all_or_nothing(got.withColumn("batch", F.lit(1)), "batch")
    assert whole.where("reject_reason IS NULL").count() == 0


def test_lifecycles():
    for initial, terminal, graph in presets.LIFECYCLES.values():
        assert presets.lifecycle_errors(initial, terminal, graph) == []
    assert presets.lifecycle_errors("a", ["b"], {"a": ["c"], "b": ["a"]}) == ["terminal status 'b' has transitions", "'a' leads to unknown status 'c'", "status 'b' can't be reached"]


def test_onchain(spark):
    word = lambda n: "0x" + f"{n:064x}"
    logs = spark.createDataFrame([(1, "t1", 10, 3, "usdt", [word(1), word(2), word(0xABC)], word(1_500_000)), (1, "t1", 10, 1, "usdt", [word(1), word(2), word(0xABC)], word(2_000_000)), (1, "t2", 11, 0, "usdt", [word(1)], word(5)), (1, "t3", 11, 0, "usdt", [word(1), word(2), word(0xDEF)], "0x" + "f" * 64)], "chain_id int, tx_hash string, block_number long, log_index int, token string, topics array<string>, data string")
    tokens = spark.createDataFrame([(1, "usdt", 6)], "chain_id int, token string, decimals int")
    got = deposits.decoded(logs, tokens)
    assert rows(got.where("tx_hash = 't1'"), "log_index", "amount") == [(1, D(2)), (3, D("1.5"))]
    assert got.where("tx_hash = 't3'").first().amount is None and got.count() == 3
    homes = spark.createDataFrame([(5, 1, "0x" + f"{0xABC:040X}".replace("0X", ""))], "account_holder long, chain_id int, address string")
    assert rows(deposits.registered(got, homes), "txlog_seq", "account_holder", "idempotency_key") == [(0, 5, "deposit-1-t1-0"), (1, 5, "deposit-1-t1-1")]


def test_delivery(spark):
    at = lambda n: DAY + dt.timedelta(minutes=n)
    e = presets.literal(spark, [(1, 1, "deposit", "", "confirmed", D(1), None, DAY, "pending", 0, 10, at(1)), (2, 1, "sweep", "", "sent", D(1), None, DAY, "pending", 9, 10, at(0)), (3, 1, "sweep", "", "sent", D(1), None, DAY, "delivered", 0, 10, at(0))], "booking_events")
    assert [r.id for r in delivery.due(e, F.lit(at(5)).cast("timestamp_ntz")).collect()] == [2, 1]
    got = delivery.after_failure(e, F.lit(at(5)).cast("timestamp_ntz")).orderBy("id").collect()
    assert [(r.delivery_status, r.next_attempt_at) for r in got] == [("pending", at(6)), ("dead", at(0))]
    assert [delivery.DELAYS[min(max(n, 0), 4)] for n in (0, 1, 9)] == [60, 300, 86400]
    subs = presets.literal(spark, [(1, "a", "u", "", "", True), (2, "b", "u", "deposit", "", True), (3, "c", "u", "sweep", "confirmed", True), (4, "d", "u", "", "sent", True), (5, "e", "u", "", "", False)], "webhook_subscribers")
    assert rows(delivery.matched(e, subs), "event_id", "subscriber_id") == [(1, 1), (1, 2), (2, 1), (2, 4), (3, 1), (3, 4)]


def test_minimum_balance_in_order(spark):
    m = spark.createDataFrame([(1, 1, 1, 1, D(5), D(0)), (2, 1, 1, 1, D(-7), D(0)), (3, 1, 1, 1, D(-5), D(0))], "id long, account_holder long, currency_id long, classification_id long, delta decimal(30,18), min_balance decimal(30,18)")
    none = spark.createDataFrame([], "account_holder long, currency_id long, classification_id long, balance decimal(30,18)")
    assert [(r.accepted, r.balance_after) for r in validation.with_minimum(m, none).orderBy("id").collect()] == [(True, 5), (False, 5), (True, 0)]


def test_inputs(spark):
    assert rows(validation.currency_inputs(currencies(spark).withColumn("exponent", F.lit(19).cast("short"))), "reject_reason") == [("invalid_input",)] * 2
    bad = presets.literal(spark, [(1, 0, 0, 0, "active", D(0), False), (2, 1, 0, 1, "active", D(0), False), (3, 1, 1, 1, "odd", D(0), False), (4, 1, 1, 1, "closed", D(0), False)], "account_policies")
    assert [r.reject_reason for r in validation.policy_inputs(bad).orderBy("id").collect()] == ["invalid_input"] * 3 + [None]
    assert {r.code: r.reject_reason for r in validation.template_inputs(presets.templates(spark)).collect() if r.reject_reason} == {}


def test_pending_actions(spark):
    rows_ = [(1, "add", 10, "a"), (2, "confirm", 4, "b"), (3, "confirm", 7, "c"), (4, "cancel", 2, "d"), (5, "expire", 9, "e"), (6, "expire", 9, "f"), (7, "add", 10, "a"), (8, "add", 11, "a"), (9, "add", -1, "g"), (10, "fly", 1, "h")]
    asked = spark.createDataFrame([(s, 1, 1, a, D(n), k) for s, a, n, k in rows_], "seq long, account_holder long, currency_id long, action string, amount decimal(30,18), idempotency_key string")
    none = spark.createDataFrame([], "account_holder long, currency_id long, balance decimal(30,18)")
    got = [(r.reject_reason, r.posted, r.pending_after) for r in pending.applied(asked, none).orderBy("seq").collect()]
    assert got == [(None, 10, 10), (None, 4, 6), ("insufficient_balance", None, 6), (None, 2, 4), (None, 4, 0), ("insufficient_balance", None, 0), (None, None, 0), ("conflict", None, 0), ("invalid_input", None, 0), ("invalid_input", None, 0)]


def test_shapes_of_inputs(spark):
    one = spark.range(1)
    lit = lambda **c: one.select(*(F.lit(v).alias(k) for k, v in c.items()))
    v = validation
    for judge, good, bad in (
        (v.booking_inputs, {"classification_code": "deposit", "account_holder": 1, "currency_id": 1, "amount": 1, "idempotency_key": "k"}, {"amount": 0}), (v.transition_inputs, {"booking_id": 1, "to_status": "x", "amount": 0}, {"amount": -1}),
        (v.settle_inputs, {"reservation_id": 1, "amount": 1}, {"amount": 0}), (v.pending_inputs, {"account_holder": 1, "currency_id": 1, "amount": 1, "idempotency_key": "k"}, {"account_holder": 0}), (v.period_inputs, {"close_before": "2024-01-01"}, {"close_before": None}),
        (v.sighting_inputs, {"chain_id": 1, "tx_hash": "t", "txlog_seq": 0, "token": "x", "to_address": "y", "amount": 1, "confirmations": 0, "block_number": 1}, {"block_number": 0}),
        (v.sweep_policy_inputs, {"chain_id": 1, "token": "x", "min_threshold": 0, "gas_ceiling": 0, "batch_limit": 1, "interval_seconds": 1}, {"batch_limit": 0}),
    ):
        assert judge(lit(**good)).first().reject_reason is None
        assert judge(lit(**(good | bad))).first().reject_reason == "invalid_input"


def test_sweep_plan(spark):
    p = spark.createDataFrame([(1, t, 10, 100, 2) for t in "abcde"] + [(2, "a", 10, 1, 2)], "chain_id int, token string, min_threshold int, gas_ceiling int, batch_limit int")
    b = spark.createDataFrame([(1, t, f"x{k}", 5 * k) for t in "abc" for k in range(5)] + [(1, "e", "x", 1)], "chain_id int, token string, address string, balance int")
    s = spark.createDataFrame([(1, 1, "b", "sent", 1), (2, 1, "c", "failed", 0), (3, 1, "d", "pending", 5)], "id int, chain_id int, token string, status string, attempts int")
    gas = spark.createDataFrame([(1, 50), (2, 50)], "chain_id int, gas_price int")
    got = {(r.chain_id, r.token): (r.action, r.n_addresses, r.total) for r in deposits.sweep_plan(p, b, s, gas).collect()}
    assert got == {(1, "a"): ("send", 2, 25), (1, "b"): ("advance", None, None), (1, "c"): ("revive", None, None), (1, "d"): ("alert", None, None), (1, "e"): ("nothing", None, None), (2, "a"): ("wait", None, None)}


def test_conservation(spark, d):
    """Ten users seeded by deposits, then 200 random transfers: sides stay equal, and liability is custody is what was seeded."""
    import random

    r = random.Random(0xCAFE)
    rows_ = [(n, u, 1, "main_wallet", "debit", 1000) for n, u in enumerate(range(1, 11), 1)] + [(n, -u, 1, "custodial", "credit", 1000) for n, u in enumerate(range(1, 11), 1)]
    for n in range(11, 211):
        a, b = r.sample(range(1, 11), 2)
        amount = r.randint(1, 50)
        rows_ += [(n, a, 1, "main_wallet", "credit", amount), (n, b, 1, "main_wallet", "debit", amount)]
    e = entries(spark, rows_)
    t = balances.global_totals(e).first()
    assert t.total_debit == t.total_credit
    s = balances.solvency(balances.direct(e, d.classifications), d.classifications).first()
    assert (s.custodial, s.liability, s.margin) == (10_000, 10_000, 0)
    assert validation.unbalanced(e).count() == 0


def test_random_journals(spark):
    """200 random balanced journals in up to three currencies pass; 100 with a drift don't."""
    import random

    r = random.Random(7)
    rows_, n = [], 300
    for j in range(1, n + 1):
        for currency in range(1, r.randint(2, 4)):
            parts = [r.randint(1, 999) for _ in range(r.randint(1, 4))]
            rows_ += [(j, r.randint(1, 9), currency, "main_wallet", "debit", p) for p in parts]
            rows_.append((j, -1, currency, "custodial", "credit", sum(parts) + (j > 200 and currency == 1)))
    got = validation.journal_structure(journals(spark, [(j, "fee") for j in range(1, n + 1)]), entries(spark, rows_), day(0)).collect()
    assert all((x.reject_reason == "unbalanced_journal") == (x.journal_id > 200) for x in got)
    assert all(x.reject_reason is None for x in got if x.journal_id <= 200)


@pytest.mark.parametrize(("status", "up", "down", "both"), [("active", None, None, None), ("frozen", None, "account_frozen", None), ("closed", "account_closed", "account_closed", "account_closed")])
@pytest.mark.parametrize("tier", [(0, 0), (1, 0), (1, 1)])
def test_policy_matrix(spark, d, status, up, down, both, tier):
    p = presets.literal(spark, [(1, 1, *tier, status, D(0), False), (2, 9, 0, 0, "closed", D(0), False)], "account_policies")
    e = entries(spark, [(1, 1, 1, "main_wallet", "debit", 5), (2, 1, 1, "main_wallet", "credit", 5), (3, 1, 1, "main_wallet", "credit", 5), (3, 1, 1, "main_wallet", "debit", 5)])
    none = spark.createDataFrame([], "account_holder long, currency_id long, classification_id long, balance decimal(30,18)")
    got = dict(rows(validation.policy_violations(e, d.classifications, p, none), "journal_id", "reject_reason"))
    assert got == {j: w for j, w in ((1, up), (2, down), (3, both)) if w}
