"""Secret scan: all rules as one minimised automaton, one pass over a text's bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Scanner, compile_scanner
from .common import map_arrow, sha256_hex, utf8

#: Kind, pattern, either case, characters at least.  The first three are the base rules, in their order.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 0),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
    ("github", r"gh[opsu]_[A-Za-z0-9]+", False, 40),
    ("slack", r"xox[abps]-[A-Za-z0-9-]+", False, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 39),
    ("stripe", r"sk_live_[A-Za-z0-9]+", False, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0),
]
BASE = ("assign", "access", "hex")
#: Characters that an assigned value has at least.
VALUE = 6


@lru_cache(maxsize=4)
def scanner() -> Scanner:
    return compile_scanner({kind: (pattern, fold) for kind, pattern, fold, _ in RULES})


def value_length(match: bytes) -> int:
    """Bytes of the assigned value: what follows the first : or =, blanks and a quote."""
    at = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def secret_spans(data: bytes, scan: Scanner) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    out = []
    for rule, a, b in scan.scan(data):
        kind, _, _, least = RULES[rule]
        if b - a >= least and (kind != "assign" or value_length(data[a:b]) >= VALUE):
            out.append((a, rule, b))
    if not out:
        return []
    points = (lambda x: x) if data.isascii() else (lambda x: len(data[:x].decode("utf-8", "replace")))
    return [(RULES[rule][0], points(a), points(b)) for a, rule, b in sorted(out)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, counts of the base kinds, digest of the base spans, all spans.

    Null and empty texts have no spans (digest of the empty string).  Repeated
    rows and ids give a row each.  Other columns are not read.  No shuffle.
    """
    scan = scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = {k: [] for k in BASE}, [], []
            for data in utf8(batch.column(1)):
                found = secret_spans(data, scan)
                base = [x for x in found if x[0] in BASE]
                for k in BASE:
                    counts[k].append(sum(x[0] == k for x in base))
                digests.append(sha256_hex(joined(base)))
                spans.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, text_col), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
