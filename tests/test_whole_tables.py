"""Queries whose result has to hold every account or journal."""

from tallyforge import catalog
from tallyforge.plans.lens import Books


def test_trend_of_every_account(spark, sf):
    accounts = Books(spark, sf).entries.select(*catalog.ACCOUNT).distinct()
    assert accounts.where("account_holder NOT BETWEEN 1 AND 200").count() > 0
    assert "BETWEEN 1 AND 200" not in catalog.ORACLES["balance_trend_gapfill"]
    days = catalog.QUERIES["balance_trend_gapfill"](spark, sf).groupBy(*catalog.ACCOUNT).count()
    assert days.exceptAll(accounts.selectExpr("*", "90L AS count")).count() == 0 and days.count() == accounts.count()


def test_reversal_of_every_journal(spark, sf):
    journals = Books(spark, sf).journals.selectExpr("id AS journal_id")
    assert "2000" not in catalog.ORACLES["full_reversal_entries"]
    judged = catalog.QUERIES["full_reversal_entries"](spark, sf).select("journal_id").distinct()
    assert judged.exceptAll(journals).count() == 0 and journals.exceptAll(judged).count() == 0
