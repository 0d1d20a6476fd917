"""Column layouts shared by the operators."""

from __future__ import annotations

AUDIT = (
    "event_type string, session_id string, token_count bigint, token_types array<string>, "
    "encrypted boolean, tokens_requested bigint, tokens_resolved bigint, ts timestamp"
)
