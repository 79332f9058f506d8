"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import fingerprint as fp
from . import licenses, line_dedup, mixing, repair, toxicity
from .chat import BODY, END, TURN, format_records, records_of_rows
from .common import stored, table
from .decontaminate import find_leaks
from .embedding_dedup import near_vectors
from .hard_negatives import mine
from .ngram_join import near_components
from .pii import find_pii
from .secrets import find_secrets

#: The conversation that op7 adds: both turns say what the template must not trip over.
EXTRA_CONVERSATION, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    # A text is sketched once, before the shuffle, and its sketch (1 kB at most) goes with it and to the document before.
    docs = fp.with_next(fp.with_sketch(docs, F.col("text"), "own"), "doc_id", "text", ["own"], need=cut)
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.col("next.text")))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("after"), F.col("next.doc_id").alias("next_doc_id"), "edited")
    docs = fp.with_sketch(docs, F.col("edited"), "new")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fp.as_text(F.col("own")).alias("fingerprint"),
        fp.as_text(F.col("new")).alias("edited_fingerprint"),
        fp.resemblance(F.col("own"), F.col("new")).alias("near_edited"),
        fp.resemblance(F.col("own"), F.col("after")).alias("near_next"),
        fp.containment(F.col("own"), F.col("new")).alias("contained_in_edited"),
        fp.distinct_shingles(F.col("own")).alias("n_shingles"),
        "next_doc_id",  # read here and for the next one's row, so that both share one shuffle of the texts
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, "source").select("doc_id", "source", "n_lines", "n_dropped", "text")


OP3_SQL = f"""
    WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
    totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
    lines AS (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT source, text, trim(unnest(string_split(text, chr(10)))) AS line FROM pages) WHERE line <> '' GROUP BY ALL),
    bad AS (SELECT l.source, list(line) AS bad FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE n > total * {line_dedup.RATIO} GROUP BY l.source),
    split AS (SELECT doc_id, d.source, text, coalesce(string_split(text, chr(10)), []) AS every, coalesce(bad, []) AS bad FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source),
    kept AS (SELECT *, list_filter(every, lambda x: trim(x) = '' OR NOT list_contains(bad, trim(x))) AS final FROM split)
    SELECT doc_id, source, CAST(len(every) AS BIGINT) AS n_lines, CAST(len(every) - len(final) AS BIGINT) AS n_dropped,
        CASE WHEN text IS NULL THEN NULL ELSE array_to_string(final, chr(10)) END AS text FROM kept"""


#: Of page_line_dedup: hosts have a few pages each, so a line goes if it is on two and on more than so many of them.
PAGE_RATIO, PAGE_LEAST = 0.3, 2


def page_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup by the hosts of real URLs, over the lines of web pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", line_dedup.lines_of_html(F.col("html")).alias("text"))
    return line_dedup.drop_boilerplate(pages, "url", ratio=PAGE_RATIO, least=PAGE_LEAST).select("page_id", line_dedup.host_of(F.col("url")).alias("host"), "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_HTML = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g'), '(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|table|tr|td|th|title|head|body|html|br|hr|form|blockquote|pre)\\b[^>]*>', chr(10), 'g')"
PAGE_SQL = rf"""
    WITH p AS (SELECT page_id, rtrim(lower(regexp_replace(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1), '^.*@|:.*$', '', 'g')), '.') AS host,
        trim(regexp_replace(regexp_replace({_HTML}, '<[^>]*>', '', 'g'), '[ \t\r]*\n\s*', chr(10), 'g')) AS text FROM pages),
    texts AS (SELECT DISTINCT host, text FROM p WHERE text IS NOT NULL), totals AS (SELECT host, count(*) AS total FROM texts GROUP BY host),
    lines AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT host, text, trim(unnest(string_split(text, chr(10)))) AS line FROM texts) WHERE line <> '' GROUP BY ALL),
    bad AS (SELECT l.host, list(line) AS bad FROM lines l JOIN totals t ON l.host IS NOT DISTINCT FROM t.host WHERE n >= {PAGE_LEAST} AND n > total * {PAGE_RATIO} GROUP BY l.host),
    split AS (SELECT page_id, p.host, text, coalesce(string_split(text, chr(10)), []) AS every, coalesce(bad, []) AS bad FROM p LEFT JOIN bad b ON p.host IS NOT DISTINCT FROM b.host),
    kept AS (SELECT *, list_filter(every, lambda x: trim(x) = '' OR NOT list_contains(bad, trim(x))) AS final FROM split)
    SELECT page_id, host, CAST(len(every) AS BIGINT) AS n_lines, CAST(len(every) - len(final) AS BIGINT) AS n_dropped, md5(CASE WHEN text IS NOT NULL THEN array_to_string(final, chr(10)) END) AS text_md5 FROM kept"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
    WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5(CASE WHEN source IS NULL THEN CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || ':' || source END), 1, 15) AS BIGINT) AS hash FROM documents),
    sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, 2 * s AS cap FROM sources),
    weighed AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
    levels AS (SELECT *, (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS own FROM weighed
        WINDOW before AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT max(own) AS level FROM levels WHERE cap / w > own),
    targets AS (SELECT source, s, least(cap::DOUBLE, coalesce(level * w, cap::DOUBLE)) AS target FROM levels, level),
    full_rounds AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target / s) AS BIGINT) END AS rounds FROM targets),
    by_hash AS (SELECT source, hash, sum(size) AS n FROM sized GROUP BY source, hash),
    upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY hash) AS upto FROM by_hash),
    extra AS (SELECT u.source, hash, (upto <= target - rounds * s OR (upto - n <= target - rounds * s AND (target - rounds * s - upto + n) * 2 > n)) AND target > rounds * s AS once_more
        FROM upto u JOIN full_rounds f ON u.source IS NOT DISTINCT FROM f.source)
    SELECT doc_id, size, s AS source_size, target, CAST(size * (rounds + CASE WHEN once_more THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM sized z JOIN full_rounds f ON z.source IS NOT DISTINCT FROM f.source JOIN extra e ON z.source IS NOT DISTINCT FROM e.source AND z.hash = e.hash"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA_CONVERSATION, 0, "user", EXTRA_TEXT), (EXTRA_CONVERSATION, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    records = records_of_rows(rows).unionByName(records_of_rows(extra))  # a conversation of the table that has this id too stays one of its own
    return format_records(records, "conv_id", "record").drop("formatted")


_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_MARKS = len(TURN + BODY + END)
OP7_SQL = rf"""
    WITH turns AS (SELECT conv_id, 0 AS extra, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES ({EXTRA_CONVERSATION}, 1, 0, 'user', '{EXTRA_TEXT}'), ({EXTRA_CONVERSATION}, 1, 1, 'assistant', '{EXTRA_TEXT}'))
    SELECT conv_id, 'rows' AS layout, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum({_MARKS} + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id, extra"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
    WITH RECURSIVE vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    sound AS (SELECT vec_id, v FROM vectors WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
    reached AS (SELECT a AS vec_id, a AS top FROM links UNION SELECT links.b, reached.top FROM reached JOIN links ON links.a = reached.vec_id WHERE reached.top < links.b),
    tops AS (SELECT vec_id, min(top) AS top FROM reached GROUP BY vec_id),
    counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(top, vec_id) AS component_id, vec_id = coalesce(top, vec_id) AS kept
    FROM embeddings LEFT JOIN tops USING (vec_id) LEFT JOIN counts USING (vec_id)"""


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the damage that each row's own hash calls for; gone: rows that it drops, of which only the conversation is left."""
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"), text.alias("text"), (code == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    plan = stored(repair.plan_repairs(rows, gone_col="gone"))
    texts = repair.digests(repair.repaired_turns(rows, plan, gone_col="gone")).withColumnRenamed("conv_id", "of")
    out = plan.join(texts, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _cheapest(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _dearer(way: str, by: str, letter: str) -> str:
    """A way is its cost in eight digits and the initials of its edits, so that the least text is the best way."""
    return f"(lpad(CAST(CAST(left({way}, 8) AS INT) + {by} AS VARCHAR), 8, '0') || substr({way}, 9) || '{letter}')"


#: A table of ways for each row, not a search: to each state (nothing, after s, u, a) before the row's insertions (b) and after them (i).
_I2 = _cheapest("b2", *(_dearer(x, "2", "I") for x in ("b0", "b1", "b3")))
_NEW = [
    _cheapest(_dearer("i0", "3", "D")),
    _cheapest(_dearer("i1", "3", "D"), f"CASE WHEN role1 = 's' AND NOT must THEN {_dearer('i0', 'cut_off', 'K')} END"),
    _cheapest(_dearer("i2", "3", "D"), f"CASE WHEN role1 = 'u' AND NOT must THEN {_cheapest(*(_dearer(x, 'cut_off', 'K') for x in ('i0', 'i1', 'i3')))} END",
              f"CASE WHEN NOT must THEN {_cheapest(*(_dearer(x, '2 + cut_off', 'R') for x in ('i0', 'i1', 'i3')))} END"),
    _cheapest(_dearer("i3", "3", "D"), f"CASE WHEN role1 = 'a' AND NOT must THEN {_dearer('i2', 'cut_off', 'K')} END", f"CASE WHEN NOT must THEN {_dearer('i2', '2 + cut_off', 'R')} END"),
]
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295)"
OP12_SQL = rf"""
    WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS code FROM keyed),
    rows AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place FROM rows),
    marked AS (SELECT *, left(role, 1) AS role1, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen,
        NOT regexp_matches(text, '[.!?][ 	-
]*$') AS short, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
    faults AS (SELECT *, blank OR seen AS must, CAST(NOT blank AND NOT seen AND short AS INT) AS cut_off, before IS NOT NULL AND before || role1 NOT IN ('su', 'ua', 'au') AS odd FROM marked),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
        sum(cut_off) AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
    ways AS (SELECT conv_id, CAST(1 AS BIGINT) AS place, '00000000' AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, CAST(NULL AS VARCHAR) AS b3 FROM counts
        UNION ALL SELECT conv_id, place + 1, {_NEW[0]}, {_NEW[1]}, {_NEW[2]}, {_NEW[3]} FROM (SELECT *, {_cheapest('b3', _dearer('i2', '2', 'I'))} AS i3 FROM (
            SELECT f.conv_id, f.place, must, cut_off, role1, b0 AS i0, b1 AS i1, b3, {_I2} AS i2 FROM ways w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.place = f.place))),
    ends AS (SELECT w.conv_id, {_cheapest('b0', 'b3', _dearer(_I2, '2', 'I'))} AS best FROM ways w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.place = c.n + 1),
    letters AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER upto AS place, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER upto AS nth FROM (
        SELECT conv_id, spot, substr(best, CAST(spot AS INT), 1) AS letter FROM (SELECT *, unnest(range(9, length(best) + 1)) AS spot FROM ends)) WINDOW upto AS (PARTITION BY conv_id ORDER BY spot)),
    edited AS (SELECT l.*, f.role, f.text, f.role1 FROM letters l LEFT JOIN faults f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.place = f.place AND letter <> 'I' WHERE letter <> 'D'),
    named AS (SELECT *, bool_or(nth = 1 AND letter = 'K' AND role1 = 's') OVER (PARTITION BY conv_id) AS sys FROM edited),
    texts AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth % 2 = 1) <> sys THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY nth)) AS repaired_sha256 FROM named GROUP BY conv_id)
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
        CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(left(best, 8) AS INT), 0) AS BIGINT) AS cost, coalesce(substr(best, 9), '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
        LEFT JOIN texts t ON o.conv_id IS NOT DISTINCT FROM t.conv_id"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
    WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS row
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, b.row, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.v) = len(b.v)),
    positives AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) AS place FROM scored WHERE same QUALIFY place <= 5),
    negatives AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id, n.row) AS rank
        FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_fingerprints, op3_line_dedup, op4_toxicity, op5_secrets, op6_mixing, op7_chat, op8_licenses, op9_decontamination, op10_ngram_join, op11_embedding_dedup, op12_conversation_repair, op13_hard_negatives, page_line_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "page_line_dedup": PAGE_SQL, "op6_mixing": OP6_SQL, "op7_chat": OP7_SQL, "op8_licenses": licenses.oracle(), "op11_embedding_dedup": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_hard_negatives": OP13_SQL}
