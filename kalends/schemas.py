"""Schemas of the stored tables."""

from __future__ import annotations

SOURCES = (
    "id bigint, name string, base_url string, source_type string, is_active boolean, last_checked_at timestamp, last_success_at timestamp, "
    "last_item_count int, error_count int, error_message string, created_at timestamp, updated_at timestamp"
)
#: Columns that a collected event brings; a re-collected event overwrites these and no others.
EVENT_CONTENT = {
    "title": "string", "description": "string", "organizer": "string", "venue": "string", "address": "string", "original_category": "string",
    "target_text": "string", "event_start": "timestamp", "event_end": "timestamp", "event_start_date": "date", "event_end_date": "date",
    "event_period_text": "string", "registration_start": "timestamp", "registration_end": "timestamp", "registration_start_date": "date",
    "registration_end_date": "date", "registration_period_text": "string", "registration_status": "string", "application_method": "string",
    "capacity": "int", "capacity_text": "string", "fee": "decimal(12,2)", "fee_text": "string", "is_free": "boolean", "reservation_url": "string",
    "detail_url": "string", "image_url": "string", "source_event_id": "string", "source_url": "string", "source_code": "string",
}
#: Columns that people curate; a merge never touches them.
EVENT_CURATED = {
    "district": "string", "latitude": "decimal(10,7)", "longitude": "decimal(10,7)", "category": "string", "subcategory": "string", "age_min": "int",
    "age_max": "int", "participation_type": "string", "prerequisite_required": "boolean", "prerequisite_text": "string", "lottery_or_firstcome": "string",
}
EVENT_TRACKING = {
    "collected_at": "timestamp", "updated_at": "timestamp", "last_verified_at": "timestamp", "last_seen_at": "timestamp", "last_seen_run_id": "bigint",
    "content_hash": "string", "is_active": "boolean",
}
OCCURRENCE_CONTENT = {
    "start_at": "timestamp", "end_at": "timestamp", "capacity": "int", "reserved_count": "int", "available_count": "int", "fee": "decimal(12,2)",
    "is_free": "boolean", "application_available": "boolean", "source_raw_data": "string", "collected_at": "timestamp", "updated_at": "timestamp",
}
EVENTS = ", ".join(f"{k} {v}" for k, v in ({"id": "bigint", "source_id": "bigint", "source_item_key": "string"} | EVENT_CONTENT | EVENT_CURATED | EVENT_TRACKING).items())
OCCURRENCES = ", ".join(f"{k} {v}" for k, v in ({"id": "bigint", "event_id": "bigint", "source_occurrence_id": "string"} | OCCURRENCE_CONTENT).items())
RUNS = (
    "id bigint, source_id bigint, started_at timestamp, finished_at timestamp, status string, scope string, pages_attempted int, pages_succeeded int, "
    "items_seen int, items_persisted int, items_failed int, detail_success_count int, detail_failure_count int, occurrence_count int, "
    "network_error_count int, parser_error_count int, error_message string, is_complete_snapshot boolean, summary string, created_at timestamp"
)
#: Columns of an occurrence that its event's content hash covers.
OCCURRENCE_HASHED = ("source_occurrence_id", "start_at", "end_at", "capacity", "reserved_count", "available_count", "fee", "is_free", "application_available")
#: Columns of an event that its content hash covers, besides its occurrences.
HASHED = sorted(set(EVENT_CONTENT) - {"source_code"} | {"source_item_key"})
#: What readers of events and of their occurrences get.
READ_COLUMNS = [c for c in EVENTS.split(", ") if c.split()[0] != "content_hash"]
READ_OCCURRENCE = [c for c in OCCURRENCES.split(", ") if c.split()[0] not in ("id", "event_id", "source_raw_data")]
