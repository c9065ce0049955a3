"""Table schemas."""

CAPTURES = (
    "entity_id string, page_type string, url string, text string, items array<string>, error string, "
    "seq bigint, checked_at timestamp_ntz"
)
PAGE_SNAPSHOTS = (
    "seq bigint, entity_id string, page_type string, content_hash string, content_text string, "
    "checked_at timestamp_ntz"
)
ITEM_STATE = (
    "entity_id string, platform string, item_id string, item_text string, item_ref string, "
    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
)
RUN_LOG = (
    "entity_id string, run_at timestamp_ntz, status string, error_message string, run_id bigint, "
    "duration_seconds double, new_ads_count bigint, new_posts_count bigint, pages_changed_count bigint, "
    "sources_json string"
)
SUMMARIES = (
    "id bigint, run_id bigint, entity_id string, summary_type string, summary_text string, "
    "created_at timestamp_ntz"
)
# Columns added over time and the value old rows take.
RUN_LOG_DEFAULTS = {"new_ads_count": 0, "new_posts_count": 0, "pages_changed_count": 0}
LISTING = (
    "data struct<children: array<struct<data: struct<id: string, title: string, selftext: string, "
    "subreddit: string, permalink: string, created_utc: double>>>>"
)
