"""Day digests and the raw archive's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DECISION, MOST_LINKS, NO_LINKS, TODO, author_name, links_of, local_day, raw_block, topic_hits, topics_of


def day_digest(messages: DataFrame, keys: tuple[str, ...] = ("channel_id",)) -> DataFrame:
    """keys, day: n, first_id, last_id by number."""
    return messages.withColumn("day", local_day("ts")).groupBy(*keys, "day").agg(F.count("*").alias("n"), F.min_by("id", "id_num").alias("first_id"), F.max_by("id", "id_num").alias("last_id"))


def topic_labels(messages: DataFrame, keys: tuple[str, ...] = ("channel_id",), platform: str = "") -> DataFrame:
    """keys, day: topics, the labels of up to three patterns found in any message's content, joined by |.

    A pattern lies within a line, so each message is searched by itself and the
    contents of a day are never put together.  (Contents that are all empty have
    the last label, as nothing is found.)
    """
    hits = topic_hits(F.col("content"), platform)
    flags = [F.bool_or(h).alias(f"hit{k}") for k, h in enumerate(hits)]
    days = messages.withColumn("day", local_day("ts")).groupBy(*keys, "day").agg(*flags)
    return days.select(*keys, "day", F.array_join(topics_of([F.col(f"hit{k}") for k in range(len(hits))], platform), "|").alias("topics"))


def link_extract(messages: DataFrame, keys: tuple[str, ...] = ("channel_id",)) -> DataFrame:
    """keys, day: links, the first twelve of the day in message order, one a line; a literal if there are none.

    Only messages with links take part in the ordering, and only the first twelve
    of them: each has at least one.
    """
    rows = messages.withColumn("day", local_day("ts")).withColumn("links", links_of(F.col("content"), F.col("attachments")))
    days = rows.groupBy(*keys, "day").agg(F.count("*").alias("n")).drop("n")
    by = Window.partitionBy(*keys, "day").orderBy("id_num", "id")
    first = rows.where(F.size("links") > 0).withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= MOST_LINKS)
    kept = first.groupBy(*keys, "day").agg(F.array_sort(F.collect_list(F.struct("rn", "links"))).alias("x"))
    kept = kept.select(*keys, "day", F.array_join(F.slice(F.flatten(F.transform("x", lambda r: r["links"])), 1, MOST_LINKS), "\n").alias("links"))
    return days.join(kept, [*keys, "day"], "left").withColumn("links", F.coalesce("links", F.lit(NO_LINKS)))


def raw_render(messages: DataFrame) -> DataFrame:
    """channel_id, id, id_num, day, block: each message as the archive has it."""
    return messages.select("channel_id", "id", "id_num", local_day("ts").alias("day"), raw_block(F.col("ts"), author_name("author"), F.col("id"), F.col("content"), F.col("attachments")).alias("block"))


def author_names(messages: DataFrame) -> DataFrame:
    return messages.groupBy(author_name("author").alias("name")).agg(F.count("*").alias("n"))


def summary_blocks(messages: DataFrame, run_label: str, keys: tuple[str, ...] = ("relative_path",), platform: str = "") -> DataFrame:
    """keys, day, block: the summary of each day of a batch as its archive has it."""
    on = [*keys, "day"]
    rows = day_digest(messages, keys).join(topic_labels(messages, keys, platform), on).join(link_extract(messages, keys), on)
    bullets = lambda x: F.concat(F.lit("- "), F.replace(x, F.lit("\n"), F.lit("\n- ")), F.lit("\n"))
    return rows.select(
        *on,
        F.concat(
            F.lit(f"\n\n---\n## V3 backlog summary — {run_label}\n- 新增訊息數："), F.col("n").cast("string"), F.lit("\n- ID 範圍："), "first_id", F.lit(" → "), "last_id",
            F.lit("\n- 狀態：backlog catch-up append\n\n### 主題綱要\n"), bullets(F.replace(F.col("topics"), F.lit("|"), F.lit("\n"))),
            F.lit(f"\n### 決策\n- {DECISION}\n\n### 待辦 / blocker\n- {TODO}\n\n### 重要連結 / 檔案\n"), bullets(F.col("links")),
        ).alias("block"),
    )
