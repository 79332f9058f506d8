"""Line dedup by site: a line that too large a share of a host's pages carry is boilerplate.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

#: A line goes if it is on more than this share of its host's pages.
RATIO = 0.05
#: Hashes and hosts of boilerplate up to which the table is broadcast (16 bytes each); a larger one is joined by shuffle.
SMALL = 1_000_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a last dot; what has no scheme, like the name of a source, is a host itself."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), host).otherwise(url)


def lines_of_html(html: Column) -> Column:
    """The text of a page with a line for each block: scripts, styles and comments go, so do tags; entities stay."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    lines = F.regexp_replace(bare, r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|table|tr|td|th|title|head|body|html|br|hr|form|blockquote|pre)\b[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"<[^>]*>", ""), r"[ \t\r]*\n\s*", "\n"))


def drop_boilerplate(df: DataFrame, url: str, text: str = "text", ratio: float = RATIO, least: int = 1, counts_as: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The rows of df with the boilerplate lines of their host taken out of the text, and two columns (long) with how many
    lines it had and lost, named by counts_as; a column of df that is called so stays, and the new one gets an underscore more.

    url: the column whose host_of is a page's host.  A line goes if it is on more
    than `ratio` of the host's pages, and on at least `least` of them: by the ratio
    alone (1), hosts of fewer than 1 / ratio pages lose all their texts, which a
    caller who would keep what is on one page only asks for (2).  A page of which
    every line goes has an empty text.

    A page is a distinct text of a host: copies under other ids are one page, so
    that copying a page doesn't make its content boilerplate.  Lines are compared
    without spaces at their ends; blank lines are never dropped.  A null text
    stays null, is no page and has no lines; null hosts are one host.  Repeated
    rows stay.

    A host has at most (its mean lines a page) / ratio boilerplate lines, so the
    array of their hashes that is joined by host is small whatever the number of
    pages.  Counting combines in each task before the shuffle, so a host with a
    third of all pages is no burden.  Up to SMALL hashes the arrays are broadcast
    and the texts aren't shuffled; beyond, Spark can split the join by host.
    """
    n_lines, n_dropped, at, bad_here, split, own, kept = (unused(df, x) for x in (*counts_as, "__host", "__bad", "__split", "__own", "__kept"))
    clean = lambda x: F.xxhash64(F.trim(x))
    hashes = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != ""), clean))
    pages = df.where(F.col(text).isNotNull()).select(host_of(F.col(url)).alias("__host"), F.xxhash64(text).alias("__page"), hashes.alias("__lines"))
    # One row for each distinct text: hashes and not texts are shuffled, and copies meet map-side.
    pages = pages.groupBy("__host", "__page").agg(F.first("__lines").alias("__lines"))
    # The total of a host is counted as the lines are, as one more line, in the same pass.
    counts = pages.select("__host", F.explode(F.concat(F.transform("__lines", lambda x: F.struct(x.alias("h"), F.lit(False).alias("all"))), F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(True).alias("all"))))).alias("__l")).groupBy("__host", "__l").count()
    lines = counts.where("not __l.all").where(F.col("count") >= least).select("__host", F.col("__l.h").alias("__h"), "count")
    total = counts.where("__l.all").select(F.col("__host").alias("__of"), F.col("count").alias("__total"))
    bad = lines.join(total, F.col("__host").eqNullSafe(F.col("__of"))).where(F.col("count") > F.col("__total") * ratio).groupBy("__host").agg(F.collect_list("__h").alias("__bad"))
    bad = cut(bad)
    entries = bad.agg(F.coalesce(F.sum(F.size("__bad")), F.lit(0)) + F.count("*")).first()[0]
    bad = F.broadcast(bad.toDF(at, bad_here)) if entries <= SMALL else bad.toDF(at, bad_here)
    out = df.join(bad, host_of(F.col(url)).eqNullSafe(F.col(at)), "left").withColumn(split, F.split(F.col(text), "\n"))
    # What a text has of its host's lines is found by hashing, and is short; only that is searched line by line.
    out = out.withColumn(own, F.array_intersect(F.transform(split, clean), bad_here))
    rest = F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(own), clean(x)))
    out = out.withColumn(kept, F.when(F.size(own) > 0, rest).otherwise(F.col(split)))
    return (
        out.withColumn(n_lines, F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"))
        .withColumn(n_dropped, F.when(F.col(text).isNull(), 0).otherwise(F.size(split) - F.size(kept)).cast("long"))
        .withColumn(text, F.when(F.col(n_dropped) == 0, F.col(text)).otherwise(F.array_join(kept, "\n")))
        .drop(at, bad_here, split, own, kept)
    )
