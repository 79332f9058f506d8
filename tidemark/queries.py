"""The registered queries over the derived ledger, and the same in DuckDB's SQL, written separately."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import run
from .functions import text as T
from .functions.cursors import ACTIVE, id_number, newest_cursor
from .operators import audit, catchup, digest, discover, ledger, migrate, select
from .plans.cut import cut
from .plans.derived import RUN_DATE, RUN_TIME, Ledger, with_ctes
from .sources import documents
from .sources.snapshots import retained

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Small pages, so that the derived channels end in different states.
LIMITS = catchup.Limits(entries=60, reads=40, pages=2, page=10)
DAILY = catchup.DailyLimits(page=3, pages=2, written=10, checked=20, messages=40)
SELECTED = 150


def query(sql: str | None = None):
    def add(f: Callable[[Ledger], DataFrame]) -> Callable:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- pieces of SQL ----


def num(x: str) -> str:
    return rf"(CASE WHEN regexp_matches({x}, '^\s*[+-]?\d+\s*$') THEN coalesce(TRY_CAST(trim({x}) AS BIGINT), 0) ELSE 0 END)"


def newest(a: str, b: str) -> str:
    a, b = f"nullif({a}, '')", f"nullif({b}, '')"
    return f"(CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NOT NULL AND {num(b)} > {num(a)} THEN {b} ELSE {a} END)"


WRITTEN = "coalesce(nullif(last_written_message_id, ''), nullif(last_message_id, ''))"
DURABLE = newest("last_written_message_id", "last_message_id")
IS_ACTIVE = f"IN ({', '.join(repr(x) for x in ACTIVE)})"
ACTIVE_KEYS = f"(SELECT entry_key FROM queue WHERE status {IS_ACTIVE} AND entry_key IS NOT NULL)"
E, EQ, EM, EQM, M, QU = (with_ctes(*x.split()) for x in ("entries", "entries queue", "entries messages", "entries queue messages", "messages", "queue"))
LIVE = f"live AS (SELECT entry_key, c AS cursor, arg_min(id, id_num) AS next_id, arg_min(ts, id_num) AS next_ts FROM (SELECT *, {WRITTEN} AS c FROM entries) e JOIN messages m ON m.channel_id = e.channel_id AND m.id_num > {num('c')} WHERE c IS NOT NULL GROUP BY entry_key, c)"

#: Reads that fail: of some channels, after a few.
ERRORS = "errors AS (SELECT entry_key, 'HTTP 500' AS error, CAST(CAST(channel_id AS BIGINT) % 4 AS INT) AS ok_reads FROM entries WHERE CAST(channel_id AS BIGINT) % 3 = 1)"
NO_ERRORS = "errors AS (SELECT CAST(NULL AS VARCHAR) AS entry_key, NULL::INT AS ok_reads WHERE false)"


def _errors(x: Ledger) -> DataFrame:
    n = F.col("channel_id").cast("bigint")
    return x.entries.where(n % 3 == 1).select("entry_key", F.lit("HTTP 500").alias("error"), (n % 4).cast("int").alias("ok_reads"))


# ---- audit ----


@query(f"{E} SELECT entry_key, {DURABLE} AS newest, {num(DURABLE)} AS newest_num FROM entries")
def cursor_newest(x: Ledger) -> DataFrame:
    return x.entries.select("entry_key", newest_cursor("last_written_message_id", "last_message_id").alias("newest")).withColumn("newest_num", id_number("newest"))


@query(f"{EM}, {LIVE} SELECT * FROM live")
def live_new_after_cursor(x: Ledger) -> DataFrame:
    return audit.live_new_after_cursor(x.entries, x.messages)


@query(f"{E} SELECT entry_key FROM entries WHERE {WRITTEN} IS NULL")
def null_cursor(x: Ledger) -> DataFrame:
    return audit.null_cursor(x.entries)


@query(f"{E} SELECT entry_key, last_written_message_id, last_message_id FROM entries WHERE last_written_message_id <> '' AND last_message_id <> '' AND last_written_message_id <> last_message_id")
def cursor_mismatch(x: Ledger) -> DataFrame:
    return audit.cursor_mismatch(x.entries)


NOT_HEALTHY = f"{WRITTEN} IS NOT NULL AND (coalesce(sync_status, 'healthy') <> 'healthy' OR coalesce(backlog_reason, '') <> '')"


@query(f"{E} SELECT entry_key, sync_status, backlog_reason FROM entries WHERE {NOT_HEALTHY}")
def not_healthy(x: Ledger) -> DataFrame:
    return audit.not_healthy(x.entries)


@query(f"{EQ} SELECT (SELECT count(*) FROM entries) AS entries, (SELECT count({WRITTEN}) FROM entries) AS probed, (SELECT count(*) FROM queue WHERE status {IS_ACTIVE}) AS active_queue")
def audit_counts(x: Ledger) -> DataFrame:
    return audit.audit_counts(x.entries, x.queue)


@query(f"{QU} SELECT count(*) AS active FROM queue WHERE status {IS_ACTIVE}")
def active_queue_count(x: Ledger) -> DataFrame:
    return audit.active_queue_count(x.queue)


REPORT = f"""report AS (SELECT 'nullCursor' AS category, entry_key, CAST(NULL AS VARCHAR) AS detail FROM entries WHERE {WRITTEN} IS NULL
    UNION ALL SELECT 'cursorMismatch', entry_key, last_written_message_id || '|' || last_message_id FROM entries WHERE last_written_message_id <> '' AND last_message_id <> '' AND last_written_message_id <> last_message_id
    UNION ALL SELECT 'notHealthy', entry_key, coalesce(sync_status, '') || '|' || coalesce(backlog_reason, '') FROM entries WHERE {NOT_HEALTHY}
    UNION ALL SELECT 'liveNewAfterCursor', entry_key, next_id FROM live)"""


@query(f"{EM}, {LIVE}, {REPORT} SELECT * FROM report")
def audit_report(x: Ledger) -> DataFrame:
    return audit.audit_report(x.entries, x.messages)


@query(f"""{EM}, {ERRORS}, {LIVE}, {REPORT} SELECT * FROM report WHERE category <> 'liveNewAfterCursor' OR entry_key NOT IN (SELECT entry_key FROM errors)
    UNION ALL SELECT 'errors', entry_key, error FROM errors JOIN entries USING (entry_key) WHERE {WRITTEN} IS NOT NULL""")
def audit_report_errors(x: Ledger) -> DataFrame:
    """With probes that failed: those are listed, and nothing is said of what such channels have."""
    return audit.audit_report(x.entries, x.messages, _errors(x).select("entry_key", "error"))


@query(f"{EQM}, {LIVE}, {REPORT}, a AS (SELECT count(*) AS n FROM queue WHERE status {IS_ACTIVE}) SELECT (SELECT count(*) FROM report) AS findings, n AS active_queue, (SELECT count(*) FROM report) = 0 AND n = 0 AS clean FROM a")
def audit_clean(x: Ledger) -> DataFrame:
    return audit.audit_clean(x.entries, x.queue, x.messages)


@query(f"{EQ} SELECT entry_key, sync_status FROM entries WHERE sync_status IN ('partial', 'queued') AND entry_key NOT IN {ACTIVE_KEYS}")
def partial_missing_from_queue(x: Ledger) -> DataFrame:
    return audit.partial_missing_from_queue(x.entries, x.queue)


@query(f"{EM}, {LIVE} SELECT live.* FROM live JOIN entries USING (entry_key) WHERE coalesce(sync_status, 'healthy') = 'healthy' AND last_backup = '{RUN_DATE}'")
def false_healthy(x: Ledger) -> DataFrame:
    return audit.false_healthy(x.entries, x.messages, RUN_DATE)


def _archive(x: Ledger) -> DataFrame:
    """What earlier runs wrote: messages before a day that differs by channel."""
    day = F.when(F.col("m.channel_id").cast("bigint") % 3 == 0, "2024-01-23").when(F.col("m.channel_id").cast("bigint") % 3 == 1, "2024-01-25").otherwise("2024-01-27")
    return x.messages.alias("m").join(x.entries.alias("e"), F.col("m.channel_id") == F.col("e.channel_id")).where(F.to_date("m.ts") < day.cast("date")).select("e.relative_path", "m.id", "m.id_num")


RAW = f"""archive AS (SELECT relative_path, m.id_num FROM messages m JOIN entries e ON m.channel_id = e.channel_id WHERE CAST(ts AS DATE) < CASE CAST(m.channel_id AS BIGINT) % 3 WHEN 0 THEN DATE '2024-01-23' WHEN 1 THEN DATE '2024-01-25' ELSE DATE '2024-01-27' END),
    positions AS (SELECT entry_key, {DURABLE} AS cursor, {num(DURABLE)} AS cursor_num, coalesce(raw_num, 0) AS raw_num FROM entries LEFT JOIN (SELECT relative_path, max(id_num) AS raw_num FROM archive GROUP BY 1) USING (relative_path))"""


@query(f"{EM}, {RAW} SELECT * FROM positions WHERE cursor_num > raw_num")
def cursor_ahead_of_raw(x: Ledger) -> DataFrame:
    return audit.cursor_ahead_of_raw(x.entries, _archive(x))


@query(f"{EM}, {RAW} SELECT * FROM positions WHERE cursor_num < raw_num")
def cursor_behind_raw(x: Ledger) -> DataFrame:
    return audit.cursor_behind_raw(x.entries, _archive(x))


@query(f"{E} SELECT relative_path, count(DISTINCT channel_id) AS channels FROM entries GROUP BY 1 HAVING count(DISTINCT channel_id) > 1")
def path_collision(x: Ledger) -> DataFrame:
    return audit.path_collision(x.entries)


@query(f"{E} SELECT channel_id, count(DISTINCT relative_path) AS paths FROM entries WHERE channel_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT relative_path) > 1")
def channel_rename(x: Ledger) -> DataFrame:
    return audit.channel_rename(x.entries)


@query(f"""{EQ} SELECT entry_key, 'attempts' AS kind, attempts AS n, status FROM queue WHERE status {IS_ACTIVE} AND attempts > 5
    UNION ALL SELECT entry_key, 'consecutiveErrors', consecutive_errors, sync_status FROM entries WHERE consecutive_errors > 3""")
def audit_warnings(x: Ledger) -> DataFrame:
    return audit.audit_warnings(x.entries, x.queue)


_ES = "('healthy', 'partial', 'queued', 'catching_up', 'retry', 'caught_up', 'error', '')"
_RS = "('page_limit_reached', 'daily_deferred', 'bootstrap_needed', 'live_probe_found_new_messages', 'cursor_mismatch', 'read_error', '')"


@query(f"""{EQ} SELECT entry_key, 'entry.sync_status' AS field, sync_status AS value FROM entries WHERE sync_status NOT IN {_ES}
    UNION ALL SELECT entry_key, 'entry.backlog_reason', backlog_reason FROM entries WHERE backlog_reason NOT IN {_RS}
    UNION ALL SELECT entry_key, 'queue.status', status FROM queue WHERE status NOT IN ('queued', 'catching_up', 'retry', 'caught_up', 'retired', '')
    UNION ALL SELECT entry_key, 'queue.reason', reason FROM queue WHERE reason NOT IN {_RS}""")
def status_enum_violations(x: Ledger) -> DataFrame:
    return audit.status_enum_violations(x.entries, x.queue)


SELECTABLE = f"(CASE WHEN has_status THEN status ELSE 'queued' END) {IS_ACTIVE}"


@query(f"""{EQ} SELECT entry_key, sync_status FROM entries WHERE {DURABLE} IS NOT NULL AND coalesce(backlog_reason, '') = ''
    AND (CASE WHEN has_sync_status THEN coalesce(sync_status, 'null') ELSE 'healthy' END) NOT IN ('healthy', 'partial', 'queued', 'catching_up', 'error')
    AND entry_key NOT IN (SELECT entry_key FROM queue WHERE {SELECTABLE} AND entry_key IS NOT NULL)""")
def unreachable_entries(x: Ledger) -> DataFrame:
    return audit.unreachable_entries(x.entries, x.queue)


@query(f"""{EQM}, {LIVE}, targets AS (SELECT entry_key, max(ordinal) AS ordinal FROM queue GROUP BY 1),
    hits AS (SELECT q.*, l.entry_key IS NOT NULL AS hit, l.cursor AS lc, l.next_id FROM queue q LEFT JOIN targets t ON q.entry_key = t.entry_key AND q.ordinal = t.ordinal LEFT JOIN live l ON t.entry_key = l.entry_key)
    SELECT ordinal, entry_key, CASE WHEN hit THEN {newest('cursor_message_id', 'lc')} ELSE cursor_message_id END AS cursor_message_id, CASE WHEN hit THEN next_id ELSE target_hint_message_id END AS target_hint_message_id,
        priority, CASE WHEN hit THEN 'live_probe_found_new_messages' ELSE reason END AS reason, CASE WHEN hit THEN 'queued' ELSE status END AS status, attempts, created_at, CASE WHEN hit THEN '{RUN_TIME}' ELSE updated_at END AS updated_at FROM hits
    UNION ALL SELECT NULL, entry_key, cursor, next_id, 25, 'live_probe_found_new_messages', 'queued', 0, '{RUN_TIME}', '{RUN_TIME}' FROM live WHERE entry_key NOT IN (SELECT entry_key FROM queue WHERE entry_key IS NOT NULL)""")
def audit_requeue(x: Ledger) -> DataFrame:
    return audit.audit_requeue(x.queue, x.entries, audit.live_new_after_cursor(x.entries, x.messages), RUN_TIME).drop("channel_id", "relative_path", "type", "has_status")


# ---- queue and ledger ----

SHOWN = ("ordinal", "entry_key", "channel_id", "relative_path", "type", "cursor_message_id", "priority", "reason", "status", "attempts", "created_at", "updated_at")
FOLDED = f"""keyed AS (SELECT q.ordinal, q.entry_key, e.channel_id, e.relative_path, e.type, {newest('q.cursor_message_id', newest('e.last_written_message_id', 'e.last_message_id'))} AS cursor_message_id, q.target_hint_message_id, q.priority, q.reason, q.status, q.has_status, q.attempts, q.created_at, q.updated_at
        FROM queue q JOIN entries e ON q.entry_key = e.entry_key),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY {num('cursor_message_id')} DESC, (coalesce(status, '') = 'caught_up') DESC, coalesce(nullif(priority, 0), 50), ordinal) AS n,
        count(*) OVER same AS k, min(ordinal) OVER same AS first, max(coalesce(attempts, 0)) OVER same AS most, min(nullif(created_at, '')) OVER same AS earliest FROM keyed WINDOW same AS (PARTITION BY entry_key)),
    normal AS (SELECT ordinal, entry_key, channel_id, relative_path, type, cursor_message_id, priority, reason, CASE WHEN entry_key IS NOT NULL THEN 'retired' ELSE status END AS status, entry_key IS NOT NULL OR has_status AS has_status, attempts, created_at,
            CASE WHEN entry_key IS NOT NULL AND coalesce(status, '') <> 'retired' THEN '{RUN_TIME}' ELSE updated_at END AS updated_at, 0 AS "group"
        FROM queue q WHERE entry_key IS NULL OR entry_key NOT IN (SELECT entry_key FROM entries)
        UNION ALL SELECT first, entry_key, channel_id, relative_path, type, cursor_message_id, priority, reason, status, has_status, most, coalesce(earliest, created_at), CASE WHEN k > 1 THEN '{RUN_TIME}' ELSE updated_at END, 1 FROM ranked WHERE n = 1)"""


@query(f'{EQ}, {FOLDED} SELECT {", ".join(SHOWN)}, "group" FROM normal')
def queue_normalize(x: Ledger) -> DataFrame:
    """All but the hint, which depends on the fold's order and is in queue_hints."""
    return ledger.normalize_queue(x.queue, x.entries, RUN_TIME).select(*SHOWN, "group")


_WINS = "(CASE WHEN x.n <> a.n THEN x.n > a.n WHEN x.done <> a.done THEN x.done ELSE x.p < a.p END)"
_FOLD = f"""list_reduce(items, lambda a, x: {{'n': CASE WHEN {_WINS} THEN x.n ELSE a.n END, 'done': CASE WHEN {_WINS} THEN x.done ELSE a.done END, 'p': CASE WHEN {_WINS} THEN x.p ELSE a.p END,
    'hint': coalesce(nullif(CASE WHEN {_WINS} THEN x.hint ELSE a.hint END, ''), CASE WHEN {_WINS} THEN a.hint ELSE x.hint END)}})"""


@query(f"""{EQ}, {FOLDED}, lists AS (SELECT entry_key, list({{'n': {num('cursor_message_id')}, 'done': coalesce(status = 'caught_up', false), 'p': coalesce(nullif(priority, 0), 50), 'hint': target_hint_message_id}} ORDER BY ordinal) AS items FROM keyed GROUP BY 1)
    SELECT entry_key, {_FOLD}.hint AS target_hint_message_id FROM lists""")
def queue_hints(x: Ledger) -> DataFrame:
    """Each folded item's target hint, which depends on the order of the fold."""
    return ledger.normalize_queue(x.queue, x.entries, RUN_TIME).where("group = 1").select("entry_key", "target_hint_message_id")


@query(f"{EQ} SELECT ordinal, entry_key, status FROM queue WHERE entry_key IS NOT NULL AND entry_key NOT IN (SELECT entry_key FROM entries)")
def queue_orphans(x: Ledger) -> DataFrame:
    return ledger.queue_orphans(x.queue, x.entries).select("ordinal", "entry_key", "status")


def _changes(x: Ledger) -> DataFrame:
    n = F.col("consecutive_errors")
    return x.entries.where(n < 4).select("entry_key", F.when(n == 0, "retry").otherwise("queued").alias("status"), F.when(n == 1, "daily_deferred").alias("reason"), F.when(n != 2, n * 20 + 5).alias("priority"))


@query(f"""{EQ}, changes AS (SELECT entry_key AS k, CASE WHEN consecutive_errors = 0 THEN 'retry' ELSE 'queued' END AS ns, CASE WHEN consecutive_errors = 1 THEN 'daily_deferred' END AS nr, CASE WHEN consecutive_errors <> 2 THEN consecutive_errors * 20 + 5 END AS np,
        channel_id AS ec, relative_path AS ep, type AS et, {DURABLE} AS ecur, last_seen_message_id AS seen, nullif(backlog_reason, '') AS er FROM entries WHERE consecutive_errors < 4),
    targets AS (SELECT entry_key, min(ordinal) AS o FROM queue WHERE entry_key IS NOT NULL GROUP BY 1),
    hits AS (SELECT q.*, c.*, c.k IS NOT NULL AS hit FROM queue q LEFT JOIN targets t ON q.entry_key = t.entry_key AND q.ordinal = t.o LEFT JOIN changes c ON t.entry_key = c.k)
    SELECT ordinal, entry_key, CASE WHEN hit THEN ec ELSE channel_id END AS channel_id, CASE WHEN hit THEN ep ELSE relative_path END AS relative_path, CASE WHEN hit THEN et ELSE type END AS type,
        CASE WHEN hit THEN {newest('cursor_message_id', 'ecur')} ELSE cursor_message_id END AS cursor_message_id, CASE WHEN hit THEN coalesce(nullif(seen, ''), target_hint_message_id) ELSE target_hint_message_id END AS target_hint_message_id,
        CASE WHEN NOT hit THEN priority WHEN np IS NULL THEN coalesce(priority, 50) ELSE least(coalesce(nullif(priority, 0), 99), np) END AS priority,
        CASE WHEN hit THEN coalesce(nr, nullif(reason, ''), er, 'state_partial') ELSE reason END AS reason, CASE WHEN hit THEN ns ELSE status END AS status,
        CASE WHEN hit AND status = 'caught_up' THEN 0 ELSE attempts END AS attempts, created_at, CASE WHEN hit THEN '{RUN_TIME}' ELSE updated_at END AS updated_at FROM hits
    UNION ALL SELECT NULL, k, ec, ep, et, ecur, nullif(seen, ''), coalesce(np, 50), coalesce(nr, er, 'state_partial'), ns, 0, '{RUN_TIME}', '{RUN_TIME}' FROM changes WHERE k NOT IN (SELECT entry_key FROM targets)""")
def queue_upsert(x: Ledger) -> DataFrame:
    return ledger.upsert_queue(x.queue, x.entries, _changes(x), RUN_TIME).drop("has_status")


def _either(c: str) -> str:
    return f"CASE WHEN m.entry_key IS NOT NULL THEN coalesce({newest(f'm.{c}', f'd.{c}')}, m.{c}) ELSE d.{c} END AS {c}"


@query(f"""{with_ctes("entries", "disk")} SELECT coalesce(m.entry_key, d.entry_key) AS entry_key, {_either("last_written_message_id")}, {_either("last_message_id")},
    CASE WHEN m.entry_key IS NOT NULL THEN m.sync_status ELSE d.sync_status END AS sync_status, CASE WHEN m.entry_key IS NOT NULL THEN m.relative_path ELSE d.relative_path END AS relative_path
    FROM (SELECT * FROM entries WHERE consecutive_errors <> 5) m FULL JOIN disk d ON m.entry_key = d.entry_key""")
def state_merge(x: Ledger) -> DataFrame:
    return ledger.merge_state(x.entries.where("consecutive_errors <> 5"), x.disk).select("entry_key", "last_written_message_id", "last_message_id", "sync_status", "relative_path")


# ---- selection ----

REASON = "nullif(backlog_reason, '')"
ORDER = "ORDER BY tier, k1, k2, k3, ordinal, entry_key"
IS_STALE = f"(last_backup IS NULL OR last_backup <> '{RUN_DATE}')"
TIERS = f"""e AS (SELECT entries.*, {DURABLE} AS nc, i.cursor_message_id AS ic, i.priority AS ip, i.entry_key IS NOT NULL AS has_item FROM entries LEFT JOIN
        (SELECT entry_key, arg_min(cursor_message_id, ordinal) AS cursor_message_id, arg_min(coalesce(priority, 0), ordinal) AS priority FROM normal WHERE entry_key IS NOT NULL GROUP BY 1) i ON entries.entry_key = i.entry_key),
    tiers AS (SELECT e.entry_key, 1 AS tier, {newest('q.cursor_message_id', 'nc')} AS cursor, coalesce(nullif(q.priority, 0), 50) AS priority, q.reason, CASE WHEN q.has_status THEN q.status ELSE 'queued' END AS queue_status,
            lpad(CAST(coalesce(nullif(q.priority, 0), 50) AS VARCHAR), 10, '0') AS k1, coalesce(q.created_at, '') AS k2, coalesce(q.relative_path, '') AS k3, q.ordinal FROM e JOIN normal q ON e.entry_key = q.entry_key WHERE (CASE WHEN q.has_status THEN q.status ELSE 'queued' END) {IS_ACTIVE}
        UNION ALL SELECT entry_key, 2, {newest('ic', 'nc')}, CASE WHEN has_item THEN least(coalesce(nullif(ip, 0), 99), 40) ELSE 40 END AS p, coalesce({REASON}, 'state_partial'), 'queued', lpad(CAST(coalesce(nullif(p, 0), 50) AS VARCHAR), 10, '0'), coalesce(nullif(last_backup, ''), '9999-99-99'), entry_key, 0 FROM e WHERE sync_status IN ('partial', 'queued', 'catching_up', 'error') OR {REASON} IS NOT NULL
        UNION ALL SELECT entry_key, 3, {newest('ic', 'nc')}, CASE WHEN has_item THEN least(coalesce(nullif(ip, 0), 99), 60) ELSE 60 END, 'healthy_stale_probe', 'queued', coalesce(nullif(last_backup, ''), '0000-00-00'), entry_key, '', 0 FROM e WHERE (NOT has_sync_status OR sync_status = 'healthy') AND {REASON} IS NULL AND nc IS NOT NULL AND {IS_STALE}
        UNION ALL SELECT entry_key, 4, coalesce(nullif(ic, ''), '0'), CASE WHEN has_item THEN least(coalesce(nullif(ip, 0), 99), 90) ELSE 90 END, 'bootstrap_needed', 'queued', coalesce(nullif(last_backup, ''), '0000-00-00'), entry_key, '', 0 FROM e WHERE nc IS NULL AND coalesce(channel_id, '') <> '' AND {IS_STALE})"""


def picked(limit: int, name: str = "picked") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER ({ORDER}) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entry_key {ORDER}) AS n FROM tiers) WHERE n = 1 ORDER BY rank LIMIT {limit})"""


def _normal(x: Ledger) -> DataFrame:
    return cut(ledger.normalize_queue(x.queue, x.entries, RUN_TIME).drop("group"))


@query(f"{EQ}, {FOLDED}, {TIERS}, {picked(SELECTED)} SELECT CAST(rank AS INT) AS rank, entry_key, CAST(tier AS INT) AS tier, cursor, CAST(priority AS INT) AS priority, reason, queue_status FROM picked")
def select_worker(x: Ledger) -> DataFrame:
    return select.select_worker(x.entries, _normal(x), RUN_DATE, SELECTED)


@query(f"""{EQ}, {FOLDED}, {TIERS}, {picked(SELECTED)}, filled AS (SELECT count(*) FILTER (tier = 1) >= {SELECTED} AS f FROM picked),
    changes AS (SELECT entry_key AS k, tier FROM tiers, filled WHERE NOT f AND tier = 2 AND entry_key NOT IN (SELECT entry_key FROM tiers WHERE tier = 1) UNION ALL SELECT entry_key, tier FROM picked, filled WHERE NOT f AND tier > 2),
    full_changes AS (SELECT c.*, CASE tier WHEN 2 THEN 40 WHEN 3 THEN 60 ELSE 90 END AS np, CASE tier WHEN 2 THEN coalesce({REASON}, 'state_partial') WHEN 3 THEN 'healthy_stale_probe' ELSE 'bootstrap_needed' END AS nr, nc FROM changes c JOIN e ON e.entry_key = c.k)
    SELECT coalesce(entry_key, k) AS entry_key, CASE WHEN k IS NULL THEN cursor_message_id WHEN tier = 4 THEN coalesce({newest('cursor_message_id', 'nc')}, '0') ELSE {newest('cursor_message_id', 'nc')} END AS cursor_message_id,
        CASE WHEN k IS NULL THEN priority WHEN entry_key IS NULL THEN np ELSE least(coalesce(nullif(priority, 0), 99), np) END AS priority, CASE WHEN k IS NULL THEN reason ELSE nr END AS reason, CASE WHEN k IS NULL THEN status ELSE 'queued' END AS status,
        CASE WHEN entry_key IS NULL OR (k IS NOT NULL AND status = 'caught_up') THEN 0 ELSE attempts END AS attempts FROM normal FULL JOIN full_changes ON entry_key = k""".replace("CASE WHEN entry_key IS NULL OR (k", "CASE WHEN ordinal IS NULL OR (k"))
def queue_after_selection(x: Ledger) -> DataFrame:
    return select.queue_after_selection(x.entries, _normal(x), RUN_DATE, RUN_TIME, SELECTED).select("entry_key", "cursor_message_id", "priority", "reason", "status", "attempts")


PREVIEW = f"""{EQ}, e AS (SELECT *, {WRITTEN} AS w, TRY_CAST(CASE WHEN regexp_matches(left(last_backup, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN left(last_backup, 10) END AS DATE) AS day FROM entries),
    tiers AS (SELECT e.entry_key, 1 AS tier, w AS cursor, coalesce(nullif(q.priority, 0), 50) AS priority, coalesce(nullif(q.reason, ''), {REASON}, 'queued') AS reason, CASE WHEN q.has_status THEN q.status ELSE 'queued' END AS queue_status,
            lpad(CAST(coalesce(nullif(q.priority, 0), 50) AS VARCHAR), 10, '0') AS k1, coalesce(q.created_at, '') AS k2, coalesce(q.relative_path, '') AS k3, q.ordinal FROM e JOIN queue q ON e.entry_key = q.entry_key WHERE (CASE WHEN q.has_status THEN q.status ELSE 'queued' END) {IS_ACTIVE}
        UNION ALL SELECT entry_key, 2, w, 40, coalesce({REASON}, 'state_partial'), NULL, '', coalesce(nullif(last_backup, ''), '9999-99-99'), relative_path, 0 FROM e WHERE sync_status IN ('partial', 'queued', 'catching_up') OR {REASON} IS NOT NULL
        UNION ALL SELECT entry_key, 3, w, 70, 'stale_incremental', NULL, coalesce(CAST(day AS VARCHAR), '0000-00-00'), relative_path, '', 0 FROM e WHERE w IS NOT NULL AND (day IS NULL OR day <= DATE '{RUN_DATE}' - 2)
        UNION ALL SELECT entry_key, 4, w, 90, 'bootstrap_needed', NULL, relative_path, '', '', 0 FROM e WHERE w IS NULL),
    ones AS (SELECT *, row_number() OVER (PARTITION BY entry_key {ORDER}) AS n FROM tiers)"""


@query(f"""{PREVIEW} SELECT p.tier, count(*) AS n, min(p.priority) AS low, max(p.priority) AS high, count(DISTINCT reason) AS reasons, min(k1) AS first_key FROM (SELECT * FROM ones WHERE n = 1) p GROUP BY p.tier""")
def select_preview_tiers(x: Ledger) -> DataFrame:
    """All entries by the preview's tier."""
    out = select.preview_tiers(x.entries, x.queue, RUN_DATE)
    return out.groupBy("tier").agg(F.count("*").alias("n"), F.min("priority").alias("low"), F.max("priority").alias("high"), F.count_distinct("reason").alias("reasons"), F.min("k1").alias("first_key"))


@query(f"""{PREVIEW} SELECT row_number() OVER ({ORDER}) AS rank, ones.entry_key, tier, cursor, priority, reason, queue_status, e.type, e.channel_id, e.relative_path, e.last_backup, e.sync_status, e.backlog_reason
    FROM ones JOIN e USING (entry_key) WHERE n = 1 ORDER BY rank LIMIT {SELECTED}""")
def select_preview(x: Ledger) -> DataFrame:
    """The preview's rows in order, with their payload."""
    return select.select_preview(x.entries, x.queue, RUN_DATE, SELECTED)


# ---- catch-up ----


def planned(x: catchup.Limits, whole: bool = False) -> str:
    """whole: behind counts all messages, for queries that return it; else as many as the plan depends on."""
    n = "(SELECT count(*) FROM after a WHERE a.entry_key = c.entry_key)"
    behind = n if whole else f"least({n}, {x.pages * x.page + 1})"
    return f"""{picked(x.entries)}, chosen AS (SELECT p.rank, p.entry_key, e.relative_path, e.channel_id, coalesce(nullif(p.cursor, ''), '0') AS cursor FROM picked p JOIN e USING (entry_key)),
    after AS (SELECT c.entry_key, m.*, row_number() OVER (PARTITION BY c.entry_key ORDER BY m.id_num) AS rn FROM chosen c JOIN messages m ON m.channel_id = c.channel_id AND m.id_num > {num('c.cursor')}),
    sized AS (SELECT c.*, {behind} AS behind FROM chosen c),
    needs AS (SELECT *, behind // {x.page} + 1 AS need, behind % {x.page} AS rest FROM sized),
    wants AS (SELECT n.*, ok_reads, least(need, {x.pages}) + CASE WHEN rest > 0 AND need <= {x.pages} THEN 1 ELSE 0 END AS wanted FROM needs n LEFT JOIN errors USING (entry_key)),
    costs AS (SELECT *, coalesce(ok_reads < wanted, false) AS fails, CASE WHEN coalesce(ok_reads < wanted, false) THEN ok_reads ELSE wanted END AS cost FROM wants),
    budget AS (SELECT *, greatest(0, {x.reads} - coalesce(sum(cost) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remaining FROM costs),
    paged AS (SELECT *, least(CASE WHEN fails THEN least(ok_reads, need) ELSE least(need, {x.pages}) END, remaining) AS batches FROM budget WHERE remaining > 0),
    worked AS (SELECT *, least(behind, batches * {x.page}) AS added FROM paged),
    plan AS (SELECT CAST(rank AS INT) AS rank, entry_key, relative_path, cursor, behind, CAST(batches AS BIGINT) AS batches, CAST(least(cost, remaining) AS BIGINT) AS reads, CAST(added AS BIGINT) AS added, CASE WHEN fails AND ok_reads < remaining THEN 'error' WHEN NOT fails AND need <= {x.pages} AND cost <= remaining THEN 'caught_up' ELSE 'still_queued' END AS status,
        coalesce((SELECT id FROM after a WHERE a.entry_key = w.entry_key AND a.rn = w.added), cursor) AS new_cursor FROM worked w)"""


CATCHUP = f"{EQM}, {FOLDED}, {TIERS}, {NO_ERRORS}, {planned(LIMITS)}"
CATCHUP_WHOLE = f"{EQM}, {FOLDED}, {TIERS}, {NO_ERRORS}, {planned(LIMITS, whole=True)}"
CATCHUP_ERRORS = CATCHUP.replace(NO_ERRORS, ERRORS)


def _plan(x: Ledger) -> DataFrame:
    return catchup.catchup_plan(x.entries, _normal(x), x.messages, RUN_DATE, LIMITS)


@query(f"{CATCHUP_WHOLE} SELECT * FROM plan")
def catchup_plan(x: Ledger) -> DataFrame:
    return _plan(x)


@query(f"{CATCHUP} SELECT a.entry_key, p.relative_path, a.id, CAST(ceil(a.rn / {LIMITS.page}) AS BIGINT) AS batch, CAST(a.rn AS INT) AS rn FROM after a JOIN plan p USING (entry_key) WHERE a.rn <= p.added")
def catchup_messages(x: Ledger) -> DataFrame:
    return catchup.catchup_messages(_plan(x), x.entries, x.messages, LIMITS).select("entry_key", "relative_path", "id", "batch", "rn")


@query(f"{CATCHUP_WHOLE} SELECT a.entry_key, p.relative_path, a.id, CAST(ceil(a.rn / {LIMITS.page}) AS BIGINT) AS batch, CAST(a.rn AS INT) AS rn, p.added, p.behind, p.new_cursor FROM after a JOIN plan p USING (entry_key) WHERE a.rn <= p.added")
def catchup_repeats(x: Ledger) -> DataFrame:
    """From a source that repeats messages: plan and rows are those without the repetitions."""
    messages = x.messages.unionByName(x.messages.where("id_num % 3 = 0")).unionByName(x.messages.where("id_num % 5 < 2"))
    plan = catchup.catchup_plan(x.entries, _normal(x), messages, RUN_DATE, LIMITS)
    rows = catchup.catchup_messages(plan, x.entries, messages, LIMITS).select("entry_key", "relative_path", "id", "batch", "rn")
    return rows.join(F.broadcast(plan.select("entry_key", "added", "behind", "new_cursor")), "entry_key")


@query(f"""{CATCHUP_ERRORS} SELECT p.rank, p.entry_key, p.batches, p.reads, p.added, p.status, p.new_cursor, CASE WHEN p.status = 'caught_up' THEN 'healthy' WHEN p.status = 'error' THEN 'error' WHEN p.added > 0 THEN 'partial' ELSE 'catching_up' END AS sync_status,
    CASE p.status WHEN 'caught_up' THEN 0 WHEN 'error' THEN coalesce(consecutive_errors, 0) + 1 ELSE consecutive_errors END AS consecutive_errors FROM plan p JOIN e USING (entry_key)""")
def catchup_errors(x: Ledger) -> DataFrame:
    """Reads that fail before, within and after an entry's pages, and after its short page."""
    plan = catchup.plan_candidates(select.select_worker(x.entries, _normal(x), RUN_DATE, LIMITS.entries), x.entries, x.messages, LIMITS, _errors(x))
    after = catchup.entries_after(x.entries, plan, RUN_DATE).select("entry_key", "sync_status", "consecutive_errors")
    return plan.select("rank", "entry_key", "batches", "reads", "added", "status", "new_cursor").join(after, "entry_key")


@query(f"""{CATCHUP} SELECT e.entry_key, CASE WHEN p.added > 0 THEN new_cursor ELSE last_written_message_id END AS last_written_message_id, CASE WHEN p.status = 'caught_up' THEN 'healthy' WHEN p.added > 0 THEN 'partial' WHEN p.status IS NOT NULL THEN 'catching_up' ELSE sync_status END AS sync_status,
    CASE WHEN p.status = 'caught_up' THEN NULL WHEN p.added > 0 THEN coalesce({REASON}, 'page_limit_reached') ELSE backlog_reason END AS backlog_reason, CASE WHEN p.status = 'caught_up' THEN '{RUN_DATE}' ELSE last_backup END AS last_backup,
    CASE WHEN p.status = 'caught_up' THEN 0 ELSE consecutive_errors END AS consecutive_errors, backlog_attempts + CASE WHEN p.status IS NULL THEN 0 ELSE 1 END AS backlog_attempts FROM e LEFT JOIN plan p USING (entry_key)""")
def catchup_outcome(x: Ledger) -> DataFrame:
    return catchup.entries_after(x.entries, _plan(x), RUN_DATE).select("entry_key", "last_written_message_id", "sync_status", "backlog_reason", "last_backup", "consecutive_errors", "backlog_attempts")


@query(f"""{CATCHUP} SELECT ordinal, q.entry_key, coalesce(p.new_cursor, cursor_message_id) AS cursor_message_id, CASE WHEN p.status = 'caught_up' THEN 'caught_up' WHEN p.status IS NOT NULL THEN 'queued' ELSE q.status END AS status,
    CASE WHEN p.status = 'caught_up' THEN 0 WHEN p.status IS NOT NULL THEN coalesce(attempts, 0) + 1 ELSE coalesce(attempts, 0) END AS attempts, CASE WHEN p.status IS NOT NULL THEN '{RUN_TIME}' ELSE updated_at END AS updated_at FROM normal q LEFT JOIN plan p ON q.entry_key = p.entry_key""")
def catchup_queue(x: Ledger) -> DataFrame:
    return catchup.queue_after(_normal(x), _plan(x), RUN_TIME).select("ordinal", "entry_key", "cursor_message_id", "status", "attempts", "updated_at")


@query(f"{CATCHUP} SELECT count(*) AS processed, CAST(coalesce(sum(reads), 0) AS BIGINT) AS total_batches, CAST(coalesce(sum(added), 0) AS BIGINT) AS added, count(*) FILTER (status = 'caught_up') AS caught_up FROM plan")
def run_totals(x: Ledger) -> DataFrame:
    return catchup.run_totals(_plan(x))


@query(f"""{EQM}, e AS (SELECT *, {WRITTEN} AS cursor FROM entries WHERE (NOT has_sync_status OR sync_status = 'healthy') AND {REASON} IS NULL AND {WRITTEN} IS NOT NULL AND entry_key NOT IN {ACTIVE_KEYS}),
    checked AS (SELECT *, row_number() OVER (ORDER BY coalesce(nullif(last_backup, ''), '0000-00-00'), entry_key) AS rank FROM e QUALIFY rank <= {DAILY.checked}),
    sized AS (SELECT c.*, (SELECT count(*) FROM messages m WHERE m.channel_id = c.channel_id AND m.id_num > {num('c.cursor')}) AS behind FROM checked c),
    wanted AS (SELECT *, least(behind, {DAILY.page * DAILY.pages}) AS want FROM sized),
    used AS (SELECT *, coalesce(sum(want) OVER before, 0) AS used, coalesce(sum(CASE WHEN want > 0 THEN 1 ELSE 0 END) OVER before, 0) AS wrote FROM wanted WINDOW before AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    kept AS (SELECT *, CAST(least(want, {DAILY.messages} - used) AS BIGINT) AS added FROM used WHERE used < {DAILY.messages} AND wrote < {DAILY.written})
    SELECT CAST(rank AS INT) AS rank, entry_key, cursor, behind, added, CASE WHEN added < behind OR added = {DAILY.page * DAILY.pages} THEN 'partial' ELSE 'healthy' END AS status, CASE WHEN added < behind OR added = {DAILY.page * DAILY.pages} THEN 'page_limit_reached' END AS reason FROM kept""")
def daily_sync_plan(x: Ledger) -> DataFrame:
    return catchup.daily_sync_plan(x.entries, x.queue, x.messages, DAILY)


# ---- digests ----

DAY = f"CAST(ts + INTERVAL {T.OFFSET_HOURS} HOURS AS DATE)"
BLANKS = r"[ \t\n\r\x0B\f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"{M} SELECT channel_id, {DAY} AS day, count(*) AS n, arg_min(id, id_num) AS first_id, arg_max(id, id_num) AS last_id FROM messages GROUP BY ALL")
def day_digest(x: Ledger) -> DataFrame:
    return digest.day_digest(x.messages)


_HITS = ", ".join(f"CASE WHEN bool_or(regexp_matches(coalesce(content, ''), '(?i){p}')) THEN '{label}' END" for label, p in T.topics())


@query(f"{M}, t AS (SELECT channel_id, {DAY} AS day, list_filter([{_HITS}], lambda x: x IS NOT NULL)[1:{T.MOST_TOPICS}] AS t FROM messages GROUP BY ALL) SELECT channel_id, day, CASE WHEN len(t) = 0 THEN '{T.topics()[-1][0]}' ELSE array_to_string(t, '|') END AS topics FROM t")
def topic_labels(x: Ledger) -> DataFrame:
    return digest.topic_labels(x.messages)


@query(rf"""{M}, rows AS (SELECT channel_id, {DAY} AS day, id_num, regexp_extract_all(coalesce(content, ''), 'https?://{BLANKS.replace('[', '[^')}+') || CASE WHEN has_file THEN [coalesce(filename, 'attachment') || ': ' || coalesce(file_url, '')] ELSE [] END AS l FROM messages),
    days AS (SELECT channel_id, day, flatten(list(l ORDER BY id_num))[1:{T.MOST_LINKS}] AS l FROM rows GROUP BY ALL)
    SELECT channel_id, day, CASE WHEN len(l) = 0 THEN '{T.NO_LINKS}' ELSE array_to_string(l, chr(10)) END AS links FROM days""")
def link_extract(x: Ledger) -> DataFrame:
    return digest.link_extract(x.messages)


NAME = "coalesce(nullif(global_name, ''), nullif(username, ''), nullif(author_id, ''), 'unknown')"


@query(rf"""{M} SELECT channel_id, id, id_num, {DAY} AS day, chr(10) || '### ' || strftime(ts + INTERVAL {T.OFFSET_HOURS} HOURS, '%Y-%m-%d %H:%M:%S') || ' +0{T.OFFSET_HOURS}00 — ' || {NAME} || ' — id:' || id || chr(10) || chr(10) ||
    CASE WHEN regexp_full_match(coalesce(content, ''), '{BLANKS}*') THEN '{T.NO_TEXT}' ELSE content END || CASE WHEN has_file THEN chr(10) || '{T.ATTACHMENT} ' || coalesce(filename, 'file') || ' ' || coalesce(file_url, '') ELSE '' END || chr(10) AS block FROM messages""")
def raw_render(x: Ledger) -> DataFrame:
    return digest.raw_render(x.messages)


@query(f"{M} SELECT {NAME} AS name, count(*) AS n FROM messages GROUP BY 1")
def author_name(x: Ledger) -> DataFrame:
    return digest.author_names(x.messages)


_BULLETS = lambda x: f"'- ' || replace({x}, chr(10), chr(10) || '- ') || chr(10)"


@query(rf"""{M}, t AS (SELECT channel_id, {DAY} AS day, count(*) AS n, arg_min(id, id_num) AS first_id, arg_max(id, id_num) AS last_id, list_filter([{_HITS}], lambda x: x IS NOT NULL)[1:{T.MOST_TOPICS}] AS t,
        flatten(list(regexp_extract_all(coalesce(content, ''), 'https?://{BLANKS.replace('[', '[^')}+') || CASE WHEN has_file THEN [coalesce(filename, 'attachment') || ': ' || coalesce(file_url, '')] ELSE [] END ORDER BY id_num))[1:{T.MOST_LINKS}] AS l FROM messages GROUP BY ALL),
    named AS (SELECT *, CASE WHEN len(t) = 0 THEN '{T.topics()[-1][0]}' ELSE array_to_string(t, chr(10)) END AS topics, CASE WHEN len(l) = 0 THEN '{T.NO_LINKS}' ELSE array_to_string(l, chr(10)) END AS links FROM t)
    SELECT channel_id, day, chr(10) || chr(10) || '---' || chr(10) || '## V3 backlog summary — {RUN_TIME}' || chr(10) || '- 新增訊息數：' || n || chr(10) || '- ID 範圍：' || first_id || ' → ' || last_id || chr(10) || '- 狀態：backlog catch-up append' || chr(10) || chr(10) ||
        '### 主題綱要' || chr(10) || {_BULLETS("topics")} || chr(10) || '### 決策' || chr(10) || '- {T.DECISION}' || chr(10) || chr(10) || '### 待辦 / blocker' || chr(10) || '- {T.TODO}' || chr(10) || chr(10) || '### 重要連結 / 檔案' || chr(10) || {_BULLETS("links")} AS block FROM named""")
def summary_render(x: Ledger) -> DataFrame:
    return digest.summary_blocks(x.messages, RUN_TIME, ("channel_id",))


# ---- migration ----

#: Parts of paths whose entries are hot.
HOT_PATHS = ("7", "ch1")
_NOTES = "concat_ws(' ', coalesce(deferred_reason, ''), coalesce(daily_sync_status, ''), coalesce(daily_sync_note, ''))"
_ALL = f"lower(concat_ws(' ', coalesce(sync_status, ''), coalesce(backlog_reason, ''), {_NOTES}))"
_PARTIAL = "(" + " OR ".join(f"contains({_ALL}, '{m}')" for m in migrate.PARTIAL_MARKERS) + ")"
_HOT = "(coalesce(hot, false) OR " + " OR ".join(f"contains(coalesce(relative_path, ''), '{p}')" for p in HOT_PATHS) + ")"
CLASSIFIED = f"""reasons AS (SELECT *, {WRITTEN} AS w, CASE WHEN {WRITTEN} IS NULL THEN 'bootstrap_needed' WHEN {_PARTIAL} THEN CASE WHEN contains({_NOTES}, '上限') OR contains(lower({_NOTES}), 'limit') OR contains(lower({_NOTES}), 'partial') THEN 'page_limit_reached' ELSE 'daily_deferred' END END AS r FROM entries),
    statuses AS (SELECT *, coalesce(r, backlog_reason) AS br, CASE WHEN r = 'bootstrap_needed' THEN 'queued' WHEN r IS NOT NULL THEN CASE WHEN sync_status = 'queued' THEN 'queued' ELSE 'partial' END ELSE coalesce(nullif(sync_status, ''), 'healthy') END AS st FROM reasons),
    based AS (SELECT *, CASE coalesce(nullif(br, ''), 'daily_deferred') WHEN 'page_limit_reached' THEN 10 WHEN 'daily_deferred' THEN 20 WHEN 'bootstrap_needed' THEN 60 ELSE 50 END AS b FROM statuses),
    classified AS (SELECT entry_key, type, channel_id, relative_path, w, last_seen_message_id, coalesce(backlog_attempts, 0) AS backlog_attempts, st, br, CASE WHEN r = 'bootstrap_needed' THEN 'bootstrap' WHEN r IS NOT NULL THEN 'partial' ELSE 'healthy' END AS class,
        st IN ('partial', 'queued') AS enqueue, CASE WHEN {_HOT} THEN greatest(1, b - 5) ELSE b END AS priority FROM based)"""


@query(f"{E}, {CLASSIFIED} SELECT entry_key, w AS last_written_message_id, st AS sync_status, br AS backlog_reason, class, enqueue, priority FROM classified")
def migrate_classify(x: Ledger) -> DataFrame:
    return migrate.migrate_classify(x.entries, HOT_PATHS).select("entry_key", "last_written_message_id", "sync_status", "backlog_reason", "class", "enqueue", "priority")


@query(f"{E}, {CLASSIFIED} SELECT count(*) AS entries, count(*) FILTER (class = 'healthy') AS healthy, count(*) FILTER (class = 'partial') AS partial, count(*) FILTER (class = 'bootstrap') AS bootstrap, count(*) FILTER (enqueue) AS queued FROM classified")
def migrate_stats(x: Ledger) -> DataFrame:
    return migrate.migrate_stats(migrate.migrate_classify(x.entries, HOT_PATHS))


MIGRATED = f"""{EQ}, {CLASSIFIED}, lasts AS (SELECT * FROM queue WHERE entry_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ordinal DESC) = 1), new AS (SELECT * FROM classified WHERE enqueue),
    merged AS (SELECT ordinal, CASE WHEN n.entry_key IS NOT NULL THEN n.relative_path ELSE o.relative_path END AS relative_path, coalesce(o.entry_key, n.entry_key) AS entry_key, CASE WHEN n.entry_key IS NOT NULL THEN {newest('o.cursor_message_id', 'n.w')} ELSE o.cursor_message_id END AS cursor_message_id,
        CASE WHEN n.entry_key IS NOT NULL THEN n.last_seen_message_id ELSE o.target_hint_message_id END AS target_hint_message_id, CASE WHEN n.entry_key IS NULL THEN o.priority WHEN o.entry_key IS NULL THEN n.priority ELSE least(coalesce(nullif(o.priority, 0), 99), n.priority) END AS priority,
        CASE WHEN n.entry_key IS NOT NULL THEN coalesce(nullif(br, ''), 'daily_deferred') ELSE o.reason END AS reason, CASE WHEN n.entry_key IS NOT NULL AND (o.status IS NULL OR o.status IN ('done', 'caught_up')) THEN 'queued' ELSE o.status END AS status,
        CASE WHEN o.entry_key IS NOT NULL THEN o.attempts ELSE n.backlog_attempts END AS attempts, CASE WHEN o.entry_key IS NOT NULL THEN o.created_at ELSE '{RUN_TIME}' END AS created_at FROM lasts o FULL JOIN new n ON o.entry_key = n.entry_key)"""


@query(f"{MIGRATED} SELECT * EXCLUDE (relative_path) FROM merged")
def migrate_queue_merge(x: Ledger) -> DataFrame:
    out = migrate.migrate_queue_merge(x.queue, migrate.migrate_classify(x.entries, HOT_PATHS), RUN_TIME)
    return out.select("ordinal", "entry_key", "cursor_message_id", "target_hint_message_id", "priority", "reason", "status", "attempts", "created_at")


@query(f"{MIGRATED} SELECT entry_key, priority, row_number() OVER (ORDER BY coalesce(nullif(priority, 0), 99), coalesce(created_at, ''), coalesce(relative_path, ''), ordinal NULLS LAST, entry_key) - 1 AS place FROM merged")
def migrate_queue_order(x: Ledger) -> DataFrame:
    """The places in which a migrated queue is stored."""
    out = migrate.migrate_queue_merge(x.queue, migrate.migrate_classify(x.entries, HOT_PATHS), RUN_TIME)
    return run.ordered(out).select("entry_key", "priority", F.col("ordinal").alias("place"))


@query(f"""{E}, h AS (SELECT consecutive_errors AS n, count(*) AS k FROM entries GROUP BY 1)
    SELECT n, greatest(coalesce(CASE WHEN n > 0 THEN n END, 0), 3) AS version, 'state' AS schema, 'queue.json' AS queue_path, CASE WHEN n % 2 = 0 THEN 'own' ELSE 'last_written_message_id' END AS source_of_truth,
        CASE WHEN n % 2 = 0 THEN NULL ELSE 'message read after cursor returns 0' END AS complete_when, k AS entries FROM h""")
def migrate_headers(x: Ledger) -> DataFrame:
    """Headers of older ledgers, one for each group of entries, at the current version; a policy that is there stays."""
    n = F.col("n")
    old = x.entries.groupBy(F.col("consecutive_errors").alias("n")).agg(F.count("*").alias("entries")).withColumns({
        "version": F.when(n > 0, n), "schema": F.lit("old"), "queue_path": F.lit(None).cast("string"), "cursor_policy": F.when(n % 2 == 0, F.create_map(F.lit("source_of_truth"), F.lit("own"))),
    })
    new = migrate.migrate_header(old, "queue.json", "state")
    policy = lambda k: F.try_element_at("cursor_policy", F.lit(k)).alias(k)
    return new.select("n", "version", "schema", "queue_path", policy("source_of_truth"), policy("complete_when"), "entries")


@query(f"""{E} SELECT entry_key, type, channel_id, relative_path, last_written_message_id, sync_status, sync_status IS NOT NULL AS has_sync_status, backlog_reason, hot, last_backup, consecutive_errors, backlog_attempts FROM entries""")
def state_documents(x: Ledger) -> DataFrame:
    """State documents, one for each entry, written as JSON and read into a table again."""
    written = documents.state_json(x.entries).select(F.concat(F.lit('{"version": 3, "entries": '), F.to_json(F.create_map("entry_key", F.lit(0))), F.lit("}")).alias("frame"), "json")
    docs = written.select(F.expr("replace(frame, ':0}', concat(':', json, '}'))").alias("value"))
    return documents.state_rows(docs).select("entry_key", "type", "channel_id", "relative_path", "last_written_message_id", "sync_status", "has_sync_status", "backlog_reason", "hot", "last_backup", "consecutive_errors", "backlog_attempts")


# ---- discovery and snapshots ----

VALID = """valid AS (SELECT ordinal, CASE WHEN kind = 'thread' THEN parent || '/' || coalesce(name, channel_name) ELSE coalesce(name, channel_name) END AS entry_key, kind AS type, coalesce(id, other_id) AS channel_id, CASE WHEN kind = 'thread' THEN parent END AS parent_channel FROM inventory
    WHERE coalesce(name, channel_name) <> '' AND coalesce(id, other_id) <> '' AND (kind <> 'thread' OR parent <> ''))"""


@query(f"""{with_ctes("entries", "inventory")}, {VALID}, new AS (SELECT entry_key, arg_max(type, ordinal) AS t, arg_max(channel_id, ordinal) AS c, arg_max(parent_channel, ordinal) AS p FROM valid GROUP BY 1)
    SELECT coalesce(n.entry_key, e.entry_key) AS entry_key, coalesce(t, type) AS type, coalesce(c, channel_id) AS channel_id, p AS parent_channel, coalesce(n.entry_key, relative_path) AS relative_path, sync_status FROM entries e FULL JOIN new n ON e.entry_key = n.entry_key""")
def inventory_upsert(x: Ledger) -> DataFrame:
    return discover.inventory_upsert(x.entries, x.inventory).select("entry_key", "type", "channel_id", "parent_channel", "relative_path", "sync_status")


@query(f"""{with_ctes("entries", "inventory")}, {VALID}, n AS (SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY ordinal) = 1 AND entry_key NOT IN (SELECT entry_key FROM entries) AS created FROM valid)
    SELECT count(*) FILTER (type = 'channel') AS channels, count(*) FILTER (type = 'thread') AS threads, count(*) FILTER (created) AS created, count(*) FILTER (NOT created) AS updated FROM n""")
def inventory_stats(x: Ledger) -> DataFrame:
    return discover.inventory_stats(x.entries, x.inventory)


@query(f"{with_ctes('base')}, s AS (SELECT CASE WHEN u % 3 = 0 THEN 'state' ELSE 'queue' END AS name, top AS version FROM base) SELECT name, version FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) <= 5")
def snapshot_retention(x: Ledger) -> DataFrame:
    versions = x.events.groupBy("user_id").agg(F.max("event_id").alias("version")).select(F.when(F.col("user_id") % 3 == 0, "state").otherwise("queue").alias("name"), "version")
    return retained(versions, 5)
