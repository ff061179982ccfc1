"""The interface of the books: reading gives DataFrames over the tables it was made with, writing judges requests against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import audit, balances, bookings, holder, pending, reconcile, reservations, reversals, series, validation


class Reader:
    """Queries over accounting tables. ``tables`` has one attribute for each table (see ``tallyforge.schemas``); ``now`` stands for the present."""

    def __init__(self, tables: object, now: Column) -> None:
        self.t, self.now = tables, now

    def balances(self, *holders: int) -> DataFrame:
        """Realtime balances of the holders, or of all."""
        t = self.t
        pick = (lambda d: d.where(F.col("account_holder").isin(*holders))) if holders else (lambda d: d)
        return balances.realtime(pick(t.entries), t.classifications, pick(t.checkpoints))

    def balance(self, holder_id: int, currency_id: int, classification_id: int) -> DataFrame:
        """One account's balance; no row if it has no entries."""
        mine = lambda d: d.where((F.col("account_holder") == holder_id) & (F.col("currency_id") == currency_id) & (F.col("classification_id") == classification_id))
        return balances.realtime(mine(self.t.entries), self.t.classifications, mine(self.t.checkpoints))

    def balances_at(self, cutoff: Column) -> DataFrame:
        return balances.as_of(self.t.entries, self.t.classifications, cutoff)

    def breakdown(self) -> DataFrame:
        return balances.breakdown(self.balances(), self.t.classifications, holder.held(self.t.reservations))

    def trial_balance(self, as_of: Column, currency_id: int | None = None) -> DataFrame:
        return balances.trial_balance(self.t.entries, self.t.classifications, as_of, currency_id)

    def solvency(self) -> DataFrame:
        return balances.solvency(self.balances(), self.t.classifications)

    def platform_balances(self) -> DataFrame:
        return balances.platform(self.balances(), self.t.classifications)

    def system_rollups(self) -> DataFrame:
        return balances.rollups(self.balances())

    def trend(self, accounts: DataFrame, first: Column, last: Column) -> DataFrame:
        return series.trend(accounts, series.sparse_snapshots(self.t.entries, self.t.classifications), series.daily_flows(self.t.entries), first, last, self.balances(), self.now)

    def transactions(self, holder_id: int, before_id: int = 0, size: int = 20) -> DataFrame:
        t = self.t
        return holder.transaction_page(t.entries, t.journals, t.journal_types, t.classifications, t.currencies, holder_id, before_id, size)

    def holds(self) -> DataFrame:
        return holder.holds(self.t.reservations, self.t.currencies)

    def journals(self, holder_id: int = 0, currency_id: int = 0, since: Column | None = None, until: Column | None = None, after: int = 0, size: int = 50) -> DataFrame:
        """A page of journals, of one holder and currency or of all."""
        t = self.t
        rows = audit.journals_by_account(t.journals, t.entries, holder_id, currency_id, since, until) if holder_id else audit.between(t.journals, "created_at", since, until)
        return audit.page(rows, size, after)

    def journal(self, uid: str) -> DataFrame:
        """A journal's entries."""
        head = self.t.journals.where(F.col("uid") == uid).select(F.col("id").alias("journal_id"), "uid")
        return self.t.entries.join(head, "journal_id").orderBy("id")

    def reversal_chain(self, journal_id: int) -> DataFrame:
        return audit.reversal_chain(self.t.journals.sparkSession, self.t.journals, journal_id)

    def trace(self) -> DataFrame:
        return audit.booking_trace(self.t.bookings, self.t.booking_events)

    def reconcile(self) -> DataFrame:
        t = self.t
        return reconcile.report(t.entries, t.journals, t.classifications, t.checkpoints, balances.direct(t.entries, t.classifications), t.reservations, t.rollup_queue, self.now)

    def effective_policies(self, accounts: DataFrame) -> DataFrame:
        return validation.effective_policies(accounts, self.t.account_policies)

    def lookup(self, table: str, **keys: object) -> DataFrame:
        """The rows of a table by id, uid or key."""
        return audit.lookup(getattr(self.t, table), **keys)

    def listed(self, table: str, active_only: bool = False) -> DataFrame:
        """A dimension's rows in order."""
        return audit.listed(getattr(self.t, table), active_only)


class Writer(Reader):
    """Requests in, outcomes out. Nothing is changed: what is accepted is for the caller to append, in one batch."""

    def post(self, journals: DataFrame, entries: DataFrame) -> DataFrame:
        """Candidate journals with their entries: accepted, replayed or rejected with the reason."""
        t = self.t
        posted = validation.fingerprint(t.journals, t.entries)
        return validation.post(journals, entries, t.classifications, t.currencies, t.account_policies, t.period_closes, self.balances(), posted, self.now)

    def render(self, requests: DataFrame) -> DataFrame:
        """Entries of template requests."""
        return validation.rendered(requests, audit.listed(self.t.templates, active_only=True), self.t.classifications)

    def reverse(self, requests: DataFrame) -> DataFrame:
        """Mirror entries of whole journals."""
        return reversals.full(requests, self.t.journals, self.t.entries)

    def reserve(self, requests: DataFrame) -> DataFrame:
        """Reservations admitted in order while the available balance lasts."""
        return reservations.admitted(requests, self.breakdown().select("account_holder", "currency_id", "available"))

    def settle(self, actions: DataFrame) -> DataFrame:
        """Settlements, legs, closes and releases in order."""
        return reservations.settled(actions, self.t.reservations)

    def transition(self, requests: DataFrame) -> DataFrame:
        """Changes of bookings in order."""
        return bookings.transitioned(requests, self.t.bookings, self.t.lifecycles)

    def move_pending(self, requests: DataFrame, pending_class: int) -> DataFrame:
        """Two-phase amounts added, confirmed, cancelled or let expire in order."""
        return pending.applied(requests, pending.opening_of(self.balances(), pending_class))

    def set_policies(self, policies: DataFrame) -> DataFrame:
        return validation.policy_inputs(policies)

    def close_periods(self, closes: DataFrame) -> DataFrame:
        return validation.period_inputs(closes)

    def book(self, rows: DataFrame) -> DataFrame:
        return validation.booking_inputs(rows)
