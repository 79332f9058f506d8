"""Rendering and digesting of messages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cursors import truthy

#: The archive's day begins at midnight of this offset.
OFFSET_HOURS = 8
#: Placeholder, labels and patterns of the archive format.
NO_TEXT = "(無文字內容)"
ATTACHMENT = "[附件]"
NO_LINKS = "無"
DECISION = "本批為 backlog worker 追趕寫入；詳細決策以原始訊息與後續人工摘要為準。"
TODO = "若本 entry 仍有 queue active，下一輪 worker 會從最新 cursor 繼續追趕。"
MOST_TOPICS, MOST_LINKS = 3, 12


def topics(platform: str = "") -> list[tuple[str, str]]:
    """Label and pattern of the topics, in order; fixed values but for the name of the host platform, which the second one mentions."""
    return [
        ("程式 / app / 實作討論", "code|bug|Flutter|FlutterFlow|SQL|API|push|commit|錯誤|修正|功能|頁面"),
        (" / ".join(x for x in ("備份", platform, "cron", "state") if x), "|".join(x for x in ("backup", "cron", platform, "state", "queue", "session", "備份", "排程") if x)),
        ("營運 / LINE / 社群 / 品牌", "LINE|社群|品牌|官方|貼文|客戶|行銷"),
        ("一般對話與進度確認", "."),
    ]


def local_time(ts: Column | str) -> Column:
    """A UTC time, with or without zone, as local time without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c.cast("timestamp_ntz") + F.expr(f"INTERVAL {OFFSET_HOURS} HOURS")


def local_day(ts: Column | str) -> Column:
    return F.to_date(local_time(ts))


def author_name(author: Column | str) -> Column:
    """Global name, else user name, else id, else unknown; author is a struct or null."""
    a = F.col(author) if isinstance(author, str) else author
    return F.coalesce(truthy(a["global_name"]), truthy(a["username"]), truthy(a["id"]), F.lit("unknown"))


def shown_content(content: Column) -> Column:
    """The content, or a placeholder if it is blank in the Unicode sense."""
    c = F.coalesce(content, F.lit(""))
    return F.when(c.rlike(r"(?U)^\s*$"), F.lit(NO_TEXT)).otherwise(c)


def attachment_lines(attachments: Column) -> Column:
    """A line for each attachment, each after a line break; '' if there are none."""
    line = lambda a: F.concat(F.lit(f"\n{ATTACHMENT} "), F.coalesce(a["filename"], F.lit("file")), F.lit(" "), F.coalesce(a["url"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(attachments, line), ""), F.lit(""))


def raw_block(ts: Column, author: Column, message_id: Column, content: Column, attachments: Column) -> Column:
    """One message as it stands in the raw archive."""
    when = F.date_format(local_time(ts), "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.lit("\n### "), when, F.lit(f" +{OFFSET_HOURS:02d}00 — "), author, F.lit(" — id:"), message_id, F.lit("\n\n"), shown_content(content), attachment_lines(attachments), F.lit("\n"))


def links_of(content: Column, attachments: Column) -> Column:
    """URLs of a message, then its attachments as name and address."""
    urls = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?U)(https?://\S+)"), F.lit(1))
    files = F.transform(attachments, lambda a: F.concat(F.coalesce(a["filename"], F.lit("attachment")), F.lit(": "), F.coalesce(a["url"], F.lit(""))))
    return F.concat(urls, F.coalesce(files, F.array().cast("array<string>")))


def topic_hits(content: Column, platform: str = "") -> list[Column]:
    """Whether each pattern is somewhere in a text, in either case."""
    return [F.coalesce(content, F.lit("")).rlike(f"(?iu){pattern}") for _, pattern in topics(platform)]


def topics_of(hits: list[Column], platform: str = "") -> Column:
    """The first labels of the patterns that hit, the last label if none does."""
    labels = [label for label, _ in topics(platform)]
    found = F.filter(F.array(*(F.when(hit, F.lit(label)) for hit, label in zip(hits, labels, strict=True))), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(labels[-1]))).otherwise(F.slice(found, 1, MOST_TOPICS))
