"""Licence scan: whole texts and whole lines are brought to a canonical form, and its digest is looked up.

DataFrame functions only.  The rules of the canonical form (case, punctuation,
copyright notices, equivalent spellings) follow the public matching guidelines of
the SPDX licence list.  A copyright notice is told by what it has (a sign, a year,
a name at the beginning of a line), not by the word alone, with which wrapped
lines of a licence begin too.  It ends where a sentence ends, where a licence
begins or at its line's end, however long it is; what stands after a sentence's
end stays.  Text that speaks of licences, permission or their denial is no part
of a notice, so a line that denies a licence stays as it is and is none.

A notice that is wrapped ends in the middle of a line, so a whole text has a
second form, in which notices may run on over lines up to an empty one.  A text
is what either form is known as.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import DIGESTS, LICENSES

#: Spellings that count as the same, of whole words after lower-casing and punctuation.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("http", "https"),
    ("v", "version"),
]
#: A canonical text that is known has one of these; others are not looked up.
MARKERS = ("licens", "permission", "redistribution", "released under", "distributed under", "available under")
#: What a licence or notice begins with after the copyright notice, wherever lines are broken.
OPENINGS = (
    "permission is hereby granted", "permission to use", "redistribution and use", "everyone is permitted", "this program is free software", "this program comes with", "gnomovision comes with",
    "this library is free software", "this work is licensed", "licensed under", "released under", "distributed under", "available under",
)
#: What may follow "copyright" at the beginning of a line of a licence's own text, so that it isn't a name.
NO_NAMES = (
    "act", "and", "are", "as", "claim", "disclaimer", "doctrine", "doctrines", "for", "from", "has", "holder", "holders", "if", "in", "interest", "interests", "is", "law", "laws", "licen[cs]e", "licen[cs]es",
    "notice", "notices", "of", "on", "or", "owner", "owners", "ownership", "permission", "protection", "resulting", "statement", "statements", "status", "that", "the", "this", "to", "treaty", "under", "was", "which", "with",
)
#: Words that no holder's name or address has: text with one of them is not taken for a notice.
DENIALS = r"\b(not|no|nor|never|without|proprietary|confidential|except\w*|excluding|unless|licen[cs]\w*|permi(t|ss)\w*|prohibit\w*|restrict\w*|forbid\w*|redistribut\w*)\b"
#: After these a full stop ends no sentence; nor does it after a single letter.
ABBREVIATIONS = ("inc", "ltd", "co", "corp", "llc", "jr", "sr", "dr", "mr", "ms", "st", "al", r"[a-z]")
_YEAR = r"[12][0-9]{3}|\[yyyy\]|<year>"
_PORTIONS = r"(?:portions\s+)?"
#: The word and a sign or a year, a sign and one of these; or, at a line's beginning, the word and a name.
BEGINS = rf"{_PORTIONS}(?:copyright\s*(?:\(c\)|©|{_YEAR})|(?:\(c\)|©)\s*(?:copyright|[12][0-9]{{3}})|(?:^|(?<=\n))[^a-z0-9\n]*{_PORTIONS}copyright\s+(?:by\s+)?(?!(?:{'|'.join(NO_NAMES)})\b)[a-z0-9])"
_ENDS = "|".join([*(x.replace(" ", r"\s+") for x in OPENINGS), r"all\s+rights\s+reserved", "".join(rf"(?<!\b{x})" for x in ABBREVIATIONS) + r"[.!?]\s", r"\Z"])
#: From a notice's beginning to its end, on one line and over lines.
NOTICES = (rf"(?s)^({BEGINS}[^\n]*?)(?={_ENDS}|\n)", rf"(?s)^({BEGINS}.*?)(?={_ENDS}|\n\s*\n)")
#: Parts a notice's beginning from what is before it; a character that the canonical form hasn't.
MARK = "\x01"
RESERVED, OTHER = r"all\s+rights\s+reserved", r"[^a-z0-9]+"


def canonical_python(text: str, over_lines: bool = False) -> str:
    """The same form for the table of known digests."""
    parts = re.sub(rf"({BEGINS})", rf"{MARK}\1", re.sub(r"\A\s+|\s+\Z", "", text.lower())).split(MARK)
    for k, part in enumerate(parts):
        found = re.search(NOTICES[over_lines], part)
        if found and not re.search(DENIALS, found[1]):
            parts[k] = part[len(found[1]) :]
    x = f" {re.sub(OTHER, ' ', re.sub(RESERVED, ' ', ' '.join(parts))).strip()} "
    for a, b in SPELLINGS:
        x = x.replace(f" {a} ", f" {b} ")
    return x.strip()


def canonical(text: Column, over_lines: bool = False) -> Column:
    """Lower case, no copyright notices, no punctuation, one spelling."""
    java = lambda x: x.replace(r"\Z", r"\z")
    parts = F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), rf"({java(BEGINS)})", rf"{MARK}$1"), MARK)

    def without(part: Column) -> Column:
        notice = F.regexp_extract(part, java(NOTICES[over_lines]), 1)
        return F.when(notice.rlike(DENIALS), part).otherwise(F.substring(part, F.char_length(notice) + 1, F.char_length(part)))

    x = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(parts, without), " "), RESERVED, " "), OTHER, " ")
    x = F.concat(F.lit(" "), F.trim(x), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(x)


def known_digests() -> list[tuple[str, str]]:
    """(digest, licence), one row for each known text."""
    out = {digest: name for name, digests in DIGESTS.items() for digest in digests}
    for name, texts in LICENSES.items():
        for form in {canonical_python(text, over) for text in texts for over in (False, True)}:
            if not any(m in form for m in MARKERS):
                raise ValueError(f"no marker in a text of {name}")
            out[hashlib.md5(form.encode()).hexdigest()] = name
    return sorted(out.items())


def marked(text: Column) -> Column:
    """Whether a raw text can have a known canonical form: markers in either spelling, with anything between their words."""
    patterns = ["licen[cs]"] + [m.replace(" ", "[^a-z0-9]+") for m in MARKERS[1:]]
    return F.lower(text).rlike("|".join(patterns))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, n_text, n_lines: which ids have a text that is a known licence or notice, whole or in a whole line.

    One row for each id and licence.  n_text counts rows whose entire text is
    the licence, n_lines lines that are (a text of one line counts as both).
    Ids without one, null and empty texts give no row; repeated rows add up; a
    null id is an id of its own.  The digests (known: another table than
    known_digests(), of canonical forms with one of MARKERS) are a few rows, so
    they are broadcast; only what is found is shuffled.
    """
    known = F.broadcast(df.sparkSession.createDataFrame(known_digests() if known is None else known, "digest string, license string"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where(marked(F.col("t")))
    lines = F.transform(F.filter(F.split("t", "\n"), marked), lambda x: F.struct(x.alias("unit"), F.lit(0).alias("whole")))
    units = rows.select("doc_id", F.explode(F.concat(F.array(F.struct(F.col("t").alias("unit"), F.lit(1).alias("whole"))), lines)).alias("u"))
    digest = lambda over: F.md5(canonical(F.col("u.unit"), over).cast("binary"))
    units = units.select("doc_id", "u.whole", digest(False).alias("digest"), F.when((F.col("u.whole") == 1) & F.col("u.unit").contains("\n"), digest(True)).alias("wrapped"))
    found = units.join(known, "digest", "left").join(known.select(F.col("digest").alias("wrapped"), F.col("license").alias("other")), "wrapped", "left")
    found = found.withColumn("license", F.coalesce("license", "other")).where("license is not null")
    return found.groupBy("doc_id", "license").agg(F.sum("whole").cast("long").alias("n_text"), F.sum(1 - F.col("whole")).cast("long").alias("n_lines"))


#: How the SQL spells words, in its own way: a pattern and what it becomes.
_SQL_WORDS = [(r"\blicence(s|d)?\b", r"license\1"), (r"\bsub license\b", "sublicense"), (r"\bnon commercial\b", "noncommercial"), (r"\bhttp\b", "https"), (r"\bv\b", "version"), (r"\borganisation\b", "organization"), (r"\bfavour\b", "favor"), (r"\backnowledgement\b", "acknowledgment"), (r"\bmerchantibility\b", "merchantability")]


def _sql_form(text: str) -> str:
    """The SQL's own canonical form: whole lines with a sign or year go unless they speak of licences; no digests."""
    notice = r"(copyright|\(c\)|©).*(\(c\)|©|[12][0-9][0-9][0-9]|<year>|\[yyyy\])"
    lines = f"list_filter(string_split(lower({text}), chr(10)), lambda l: NOT (regexp_matches(l, '{notice}') AND NOT regexp_matches(l, 'licen[cs]|permission|redistribut')))"
    words = f"trim(regexp_replace(replace(array_to_string({lines}, ' '), 'all rights reserved', ' '), '[^a-z0-9]+', ' ', 'g'))"
    return reduce(lambda x, w: f"regexp_replace({x}, '{w[0]}', '{w[1]}', 'g')", _SQL_WORDS, words)


def oracle(table: str = "documents") -> str:
    """In DuckDB's SQL, by rules of its own and by the texts themselves; without the entire texts of which only digests are known, and without wrapped notices."""
    known = ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', '{name}')" for name, texts in LICENSES.items() for t in texts)
    return f"""
        WITH texts(said, license) AS (VALUES {known}), known AS (SELECT DISTINCT {_sql_form('said')} AS form, license FROM texts),
        units AS (SELECT doc_id, text AS unit, 1 AS whole FROM {table} WHERE text IS NOT NULL
            UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))), 0 FROM {table} WHERE text IS NOT NULL),
        likely AS (SELECT * FROM units WHERE regexp_matches(lower(unit), 'licen[cs]|permission|redistribution|(released|distributed|available)[^a-z0-9]+under'))
        SELECT doc_id, license, CAST(sum(whole) AS BIGINT) AS n_text, CAST(sum(1 - whole) AS BIGINT) AS n_lines
        FROM (SELECT doc_id, whole, {_sql_form('unit')} AS form FROM likely) JOIN known USING (form) GROUP BY ALL"""
