"""Schemas of the accounting tables. Amounts are decimal(30,18), times are UTC without zone."""

from __future__ import annotations

from pyspark.sql.types import StructType

AMOUNT = "decimal(30,18)"
# A total over all accounts, which no table stores: it may pass the 12 digits before the point that an amount has.
TOTAL = "decimal(38,18)"

_DDL = {
    "currencies": "id long, uid string, code string, name string, is_active boolean, exponent short",
    "classifications": "id long, uid string, code string, name string, normal_side string, is_system boolean, is_active boolean, balance_role string, display_label string",
    "lifecycles": "classification_id long, version int, initial string, terminal array<string>, transitions map<string,array<string>>",
    "journal_types": "id long, uid string, code string, name string, is_active boolean, display_label string",
    "templates": "code string, journal_type_code string, is_active boolean, classification_code string, entry_type string, holder_role string, amount_key string, sort_order int",
    "journals": f"id long, uid string, journal_type_id long, idempotency_key string, total_debit {AMOUNT}, total_credit {AMOUNT}, memo string, actor_id long, source string, reversal_of long, event_id long, effective_at timestamp_ntz, created_at timestamp_ntz",
    "entries": f"id long, journal_id long, account_holder long, currency_id long, classification_id long, entry_type string, amount {AMOUNT}, effective_at timestamp_ntz, created_at timestamp_ntz",
    "checkpoints": f"account_holder long, currency_id long, classification_id long, balance {AMOUNT}, last_entry_id long",
    "snapshots": f"account_holder long, currency_id long, classification_id long, snapshot_date date, balance {AMOUNT}",
    "system_rollups": f"currency_id long, classification_id long, total_balance {AMOUNT}",
    "rollup_queue": "id long, account_holder long, currency_id long, classification_id long, claimed_until timestamp_ntz, processed_at timestamp_ntz, failed_attempts int",
    "reservations": f"id long, uid string, account_holder long, currency_id long, reserved_amount {AMOUNT}, settled_amount {AMOUNT}, status string, journal_id long, idempotency_key string, expires_at timestamp_ntz, created_at timestamp_ntz",
    "settlement_legs": f"id long, reservation_id long, idempotency_key string, amount {AMOUNT}",
    "bookings": f"id long, uid string, classification_id long, account_holder long, currency_id long, amount {AMOUNT}, settled_amount {AMOUNT}, status string, channel_name string, channel_ref string, journal_id long, idempotency_key string, expires_at timestamp_ntz",
    "booking_events": f"id long, booking_id long, classification_code string, from_status string, to_status string, amount {AMOUNT}, journal_id long, occurred_at timestamp_ntz, delivery_status string, attempts int, max_attempts int, next_attempt_at timestamp_ntz",
    "account_policies": f"id long, account_holder long, currency_id long, classification_id long, status string, min_balance {AMOUNT}, enforce_min_balance boolean",
    "period_closes": "id long, close_before timestamp_ntz, created_at timestamp_ntz",
    "webhook_subscribers": "id long, name string, url string, filter_class string, filter_to_status string, is_active boolean",
    "webhook_nonces": "nonce string, seen_at timestamp_ntz",
    "deposit_addresses": "account_holder long, chain_id long, address string",
    "chain_cursors": "chain_id long, last_block long",
    "ingest_dead_letters": "chain_id long, tx_hash string, txlog_seq int, reason string",
    "sightings": f"chain_id long, tx_hash string, block_number long, log_index int, token string, to_address string, amount {AMOUNT}",
}


def schema(name: str) -> StructType:
    """The StructType of an accounting table."""
    return StructType.fromDDL(_DDL[name])


TABLES = tuple(_DDL)
