"""Declared schemas of the domain tables, their required columns and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "trips": (
        "id LONG, username STRING, name STRING, start_date DATE, end_date DATE, notes STRING, created_at TIMESTAMP"
    ),
    "itinerary_items": (
        "id LONG, trip_id LONG, day_number INT, name STRING, category STRING, start_time STRING, "
        "duration_minutes INT, location STRING, address STRING, booking_ref STRING, notes STRING, source STRING, "
        "source_id LONG, sort_order INT, confirm_required BOOLEAN, is_confirmed BOOLEAN, created_at TIMESTAMP"
    ),
    "trip_adjustments": (
        "id LONG, trip_id LONG, instruction STRING, items_changed ARRAY<STRUCT<id: LONG, start_time: STRING>>, "
        "created_at TIMESTAMP"
    ),
    "wishlist": (
        "id LONG, username STRING, name STRING, category STRING, estimated_price DECIMAL(12,2), status STRING, "
        "notes STRING, added_date DATE, created_at TIMESTAMP"
    ),
    "buylist_items": (
        "id LONG, list_id LONG, name STRING, price DECIMAL(12,2), urgency STRING, accessibility STRING, "
        "this_month BOOLEAN, bought BOOLEAN, added_by STRING, note STRING, link STRING, category STRING, "
        "recurring_cost DECIMAL(12,2), created_at TIMESTAMP, starred BOOLEAN, quantity INT, tag STRING, "
        "actual_price DECIMAL(12,2)"
    ),
    "buylist_budget": "list_id LONG, monthly_budget DECIMAL(12,2), last_cleared STRING",
    "sauces": (
        "id LONG, list_id LONG, name STRING, url STRING, spiciness INT, aroma INT, cp INT, repurchase INT, "
        "added_by STRING, created_at TIMESTAMP"
    ),
}

REQUIRED: dict[str, list[str]] = {
    "trips": ["username", "name", "start_date", "end_date"],
    "itinerary_items": ["trip_id", "name"],
    "trip_adjustments": ["trip_id"],
    "wishlist": ["username", "name"],
    "buylist_items": ["list_id", "name"],
    "buylist_budget": ["list_id"],
    "sauces": ["list_id", "name"],
}

# What a column holds when a row does not state it.
DEFAULTS: dict[str, dict[str, object]] = {
    "trips": {"notes": ""},
    "itinerary_items": {
        "category": "other",
        "duration_minutes": 60,
        "location": "",
        "address": "",
        "booking_ref": "",
        "notes": "",
        "source": "manual",
        "sort_order": 0,
        "confirm_required": False,
        "is_confirmed": False,
    },
    "trip_adjustments": {},
    "wishlist": {"category": "", "estimated_price": 0, "status": "pending", "notes": ""},
    "buylist_items": {
        "price": 0,
        "urgency": "maybe",
        "accessibility": "tw_easy",
        "this_month": True,
        "bought": False,
        "added_by": "",
        "note": "",
        "link": "",
        "category": "其他",
        "recurring_cost": 0,
        "starred": False,
        "quantity": 1,
        "tag": "",
    },
    "buylist_budget": {"monthly_budget": 0, "last_cleared": ""},
    "sauces": {"url": "", "spiciness": 0, "aroma": 0, "cp": 0, "repurchase": 0, "added_by": ""},
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])
