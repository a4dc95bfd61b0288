"""Explicit table schemas (DDL strings). Times are epoch milliseconds."""

LANDING_NOTE = (
    "note_id string, title string, desc string, type string, time string, liked_count string, "
    "collected_count string, comment_count string, share_count string, note_url string, "
    "tag_list string, source_keyword string, nickname string, _bad string"
)
LANDING_COMMENT = (
    "comment_id string, note_id string, parent_comment_id string, content string, "
    "create_time string, like_count string, sub_comment_count string, nickname string, _bad string"
)
NOTES = (
    "note_id string, title string, note_desc string, note_type string, publish_time_ms bigint, "
    "liked_count bigint, collected_count bigint, comment_count bigint, share_count bigint, "
    "note_url string, tag_list string, source_keyword string, nickname string, simhash bigint, "
    "dup_group_id string, first_seen_run_id bigint, last_seen_run_id bigint, fetched_at_ms bigint"
)
COMMENTS = (
    "comment_id string, note_id string, parent_comment_id string, content string, "
    "create_time_ms bigint, like_count bigint, sub_comment_count bigint, nickname string, "
    "content_norm_hash string, dup_group_id string, first_seen_run_id bigint, fetched_at_ms bigint"
)
MENTIONS = (
    "ticker string, source_type string, source_id string, note_id string, matched_alias string, "
    "match_basis string, content_time_ms bigint, run_id bigint"
)
ANALYSES = (
    "ticker string, run_id bigint, generated_at_ms bigint, window_start_ms bigint, "
    "window_end_ms bigint, note_count bigint, comment_count bigint, popularity_score double, "
    "sentiment_counts string, summary string, bull_points string, bear_points string, "
    "notable_quotes string, irrelevant_item_count bigint, input_item_count bigint, "
    "input_hash string, model string, input_tokens bigint, output_tokens bigint, cost_usd double, "
    "status string, error string"
)
SNAPSHOTS = (
    "ticker string, run_id bigint, snapped_at_ms bigint, score double, mentions bigint, "
    "note_count bigint, comment_count bigint"
)
STOCKS = (
    "ticker string, name string, sector string, asset_class string, aliases array<string>, "
    "ambiguous array<string>, supersedes array<string>, quote_symbol string"
)
TRACKED = "ticker string, added_at_ms bigint, custom_keywords string"
PRICES = "ticker string, date date, close double"
RATING_REPLY = (
    "summary string, sentiment_counts struct<bullish:bigint,bearish:bigint,neutral:bigint>, "
    "bull_points array<string>, bear_points array<string>, notable_quote_ids array<int>, "
    "irrelevant_item_count bigint"
)

# fixed values: enumerations
ENUMS = {
    "match_basis": ("safe_alias", "alias+context", "ticker_symbol", "targeted_search"),
    "status_analysis": ("ok", "no_api_key", "error", "skipped_unchanged"),
    "status_run": ("running", "success", "partial", "failed"),
    "mode": ("discovery", "tracked"),
    "status_suggestion": ("pending", "accepted", "rejected"),
}
