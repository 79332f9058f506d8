"""Tables of the engine."""

from __future__ import annotations

ENTRIES = """entry_key string, type string, channel_id string, guild_id string, parent_channel string, relative_path string,
    last_written_message_id string, last_message_id string, last_seen_message_id string, sync_status string, has_sync_status boolean,
    backlog_reason string, deferred_reason string, daily_sync_status string, daily_sync_note string, hot boolean, last_backup string,
    last_successful_write_at timestamp, consecutive_errors int, backlog_attempts int, state_schema_version int, updated_at timestamp, extra map<string,string>"""

QUEUE = """ordinal bigint, entry_key string, channel_id string, relative_path string, type string, cursor_message_id string,
    target_hint_message_id string, priority int, reason string, status string, has_status boolean, attempts int, created_at string, updated_at string"""

MESSAGES = """channel_id string, id string, id_num bigint, ts timestamp_ntz, content string,
    author struct<global_name:string,username:string,id:string>, attachments array<struct<filename:string,url:string>>"""

HEADER = "version int, schema string, guild_id string, root_path string, queue_path string, cursor_policy map<string,string>, updated_at timestamp"

ENTRY_STATUSES = ("healthy", "partial", "queued", "catching_up", "retry", "caught_up", "error")
QUEUE_STATUSES = ("queued", "catching_up", "retry", "caught_up", "retired")
REASONS = ("page_limit_reached", "daily_deferred", "bootstrap_needed", "live_probe_found_new_messages", "cursor_mismatch", "read_error")
