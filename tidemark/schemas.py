"""Schemas of stored tables, as DDL texts."""

RULES = (
    "rule_id string, rule_text string, confidence double, evidence_count long, created_at timestamp, "
    "last_validated timestamp, category string"
)
