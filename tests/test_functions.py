"""Money, keys and metadata."""

from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import keys, metadata, money


def test_rounding(spark):
    cases = [("half_up", "5.45", "5.5"), ("half_up", "-5.45", "-5.5"), ("half_even", "5.45", "5.4"), ("half_even", "5.55", "5.6"), ("half_even", "5.65", "5.6"), ("half_even", "-5.45", "-5.4"), ("down", "5.99", "5.9"), ("down", "-5.99", "-5.9"), ("up", "5.01", "5.1"), ("up", "-5.01", "-5.1"), ("up", "5.00", "5.0"), ("odd", "5.45", "5.5")]
    one = spark.range(1)
    for mode, given_, want in cases:
        assert one.select(money.rounded(F.lit(D(given_)).cast("decimal(30,18)"), 1, mode).alias("x")).first().x == D(want), (mode, given_)


def test_convert(spark):
    rows = spark.createDataFrame([(D(100), D("7.23")), (D(1), D("149.371")), (D(1), D("0.005")), (None, D(1))], "a decimal(30,18), r decimal(30,18)")
    assert [r.x for r in rows.select(money.converted(F.col("a"), F.col("r"), 2).alias("x")).collect()] == [D(723), D("149.37"), D("0.01"), None]
    assert [r.x for r in rows.select(money.converted(F.col("a"), F.col("r"), 2, "down").alias("x")).collect()][2] == 0


def test_shares(spark):
    for amount, weights, want in (("100", "1 1 1", "33.34 33.33 33.33"), ("100", "1 1", "50 50"), ("0.03", "1 1", "0.02 0.01"), ("-100", "1 1 1", "-33.34 -33.33 -33.33"), ("10", "0.3 0.7", "3 7"), ("1", "1 1 1", "0.34 0.33 0.33")):
        weights, want = [D(w) for w in weights.split()], [D(w) for w in want.split()]
        assert money.shares(D(amount), weights, 2) == want
        rows = spark.createDataFrame([(D(amount), weights)], "a decimal(30,18), w array<decimal(30,18)>")
        assert rows.select(money.allocated(F.col("a"), F.col("w"), 2).alias("x")).first().x == want
    with pytest.raises(ValueError):
        money.shares(D("0.001"), [D(1)], 2)


@settings(max_examples=300, deadline=None)
@given(st.integers(-(10**20), 10**20), st.lists(st.integers(0, 10**6), min_size=1, max_size=9).filter(any))
def test_shares_sum_to_the_amount(units, weights):
    got = money.shares(D(units) / 100, [D(w) for w in weights], 2)
    assert sum(got) == D(units) / 100
    assert all(abs(g - D(units) / 100 * w / sum(weights)) < D("0.011") + abs(D(units)) / 10**20 for g, w in zip(got, weights, strict=True))


def test_precision(spark):
    rows = spark.createDataFrame([(D("1.005"), 2), (D("1.05"), 2), (D("1"), 0), (D("0.000000000000000001"), 18)], "a decimal(30,18), e int")
    assert [r.x for r in rows.select(money.is_precise(F.col("a"), F.col("e")).alias("x")).collect()] == [False, True, True, True]


def test_fraction(spark):
    assert spark.sql("SELECT 10001L AS u, 1L AS n, 3L AS d").select(money.fraction_of_units("u", "n", "d").alias("x")).first().x == 3334
    rows = spark.createDataFrame([(1, 3), (3, 3), (0, 3), (4, 3), (1, 0)], "n int, d int")
    assert [r.x for r in rows.select(money.is_fraction(F.col("n"), F.col("d")).alias("x")).collect()] == [True, True, False, False, False]


def test_keccak_and_addresses(spark):
    assert keys.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keys.checksummed("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed") == "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"
    assert keys.create2("0x" + "00" * 20, bytes(32), keys.keccak256(b"\x00")) == "0x4D1A2e2bB4F88F0250f26Ffff098B0b30B26BF38"
    rows = spark.createDataFrame([("0xFB6916095CA1DF60BB79CE92CE3EA74C37C5D359",), ("nope",), (None,)], "a string")
    assert [r.x for r in rows.select(keys.checksum_address("a").alias("x")).collect()] == ["0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359", None, None]


def test_signature(spark):
    import hashlib
    import hmac

    rows = spark.createDataFrame([("k", "body")], "s string, b string")
    assert rows.select(keys.signature(F.col("s"), F.col("b")).alias("x")).first().x == hmac.new(b"k", b"body", hashlib.sha256).hexdigest()


def test_cursors(spark):
    rows = spark.createDataFrame([("",), ("MTIz",), ("!!",), ("YWJj",)], "c string")
    assert [r.x for r in rows.select(keys.cursor_id(F.col("c")).alias("x")).collect()] == [0, 123, None, None]


def test_metadata(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"x": "y"}), ({"a": "1"}, None)], "l map<string,string>, r map<string,string>")
    assert [r.x for r in rows.select(metadata.merged(F.col("l"), F.col("r")).alias("x")).collect()] == [{"a": "1", "b": "3"}, {"x": "y"}, {"a": "1"}]
    rows = spark.createDataFrame([({"a": "1", "block_number": "5"}, {"a": "1"}), ({"a": "1"}, {"a": "2"})], "l map<string,string>, r map<string,string>")
    assert [r.x for r in rows.select(metadata.same(F.col("l"), F.col("r")).alias("x")).collect()] == [True, False]
