"""Secrets, personal data, licences and chat: text scans against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
import textwrap
from pathlib import Path

import pyarrow as pa
import pytest
from conftest import DATA, against_oracle

from tidemark.llm import automaton, chat, licenses, pii, queries, secrets
from tidemark.llm.common import coded_words
from tidemark.llm.license_texts import LICENSES

DOCS = "doc_id long, text string, size string, toxic int, __x string"


def docs_of(spark, texts, first=0):
    """Documents with extra columns whose names the operators also use."""
    return spark.createDataFrame([(first + k, t, "s", 7, "x") for k, t in enumerate(texts)], DOCS)


# ---- secrets ----

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(x):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return sorted(out, key=lambda z: (z[1], secrets.BASE.index(z[0])))


def test_secrets_like_brute_force():
    rng, scan = random.Random(1), secrets.scanner()
    parts = ["password", "passwd", "secret", "token", "api_key", "apikey", "ToKen", " ", '"', "'", ":", "=", "abc", "abcdef", "a" * 30, "0123456789abcdef" * 2, "AKIA" * 6, "AKIA", "ABCDEFGH12345678", "é", "日本", "\n", ".", "-", "ſecret", "ghp_"]
    for _ in range(8000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.secret_spans(x.encode(), scan) if s[0] in secrets.BASE] == base_secrets(x)


def test_added_secret_kinds():
    x = f"é ghp_{'z1' * 18} xoxb-1234567890-abc AIza{'x' * 35} -----BEGIN RSA PRIVATE KEY-----"
    assert [(k, x[a:b][:4]) for k, a, b in secrets.secret_spans(x.encode(), secrets.scanner())] == [("github", "ghp_"), ("slack", "xoxb"), ("google", "AIza"), ("pem", "----")]


def test_minimised_automaton_is_smaller_and_checked():
    s = secrets.scanner()
    assert s.states < s.states_before
    with pytest.raises(ValueError, match="keep matching"):
        automaton.compile_scanner({"x": ("a(bc)*", False)})
    with pytest.raises(ValueError, match="empty"):
        automaton.compile_scanner({"x": ("a*", False)})


def test_secret_query_cases(spark):
    texts = [None, "", "token = abcdef", "x" * 200_000 + " token=abcdef", "token = abcdef"]
    rows = secrets.find_secrets(docs_of(spark, texts)).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_assign, r.base_sha256 == empty) for r in rows] == [(0, True), (0, True), (1, False), (1, False), (1, False)]
    assert rows[2].base_sha256 == hashlib.sha256(b"assign:0:14").hexdigest() == rows[4].base_sha256
    assert secrets.find_secrets(docs_of(spark, [])).count() == 0


# ---- personal data ----

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def base_pii(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(x)]
    out += [("ip", *m.span()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda z: (z[1], pii.KINDS.index(z[0])))


def test_base_spans_like_brute_force():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@@", ".com", "x@y.z", "1", "12", "255", "256", ".", " ", "-", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "é", "\n", "0001", ".1.2.3", "٣"]
    for _ in range(20000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(x) == base_pii(x)


def test_base_spans_are_linear():
    for x in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+" * 300_000, "a" * 300_000 + "@"):
        pii.base_spans(x)


def test_model_on_held_out_texts():
    data = pii.labelled_spans(250, seed=99)
    found = pii.model_spans([x for x, _ in data], pii.trained_model())
    right = sum(len(set(a) & set(s)) for a, (_, s) in zip(found, data, strict=True))
    assert right / sum(len(s) for _, s in data) > 0.93 and right / sum(map(len, found)) > 0.93


def test_gradient():
    import numpy as np

    from tidemark.llm.bilstm_crf import BiLstmCrf

    rng = np.random.default_rng(0)
    m = BiLstmCrf(3, 4, 5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids, tags = rng.integers(3, 90, (2, 6)), rng.integers(0, 3, (2, 6))
    _, g = m.gradients(ids, tags)
    for k in ("Wf", "Wb", "T", "O", "bf"):
        at = tuple(rng.integers(0, n) for n in m.p[k].shape)
        m.p[k][at] += 1e-3
        up = m.gradients(ids, tags)[0]
        m.p[k][at] -= 2e-3
        down = m.gradients(ids, tags)[0]
        m.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3


def test_spans_do_not_depend_on_where_windows_begin():
    model, core = pii.trained_model(), "call (017) 555-7713 now and then"
    for pad in (0, 5, 31, 77, 500):
        text = "the and " * pad + core
        assert [text[a:b] for k, a, b in pii.model_spans([text], model)[0]] == ["(017) 555-7713"]


def test_spans_are_those_of_decoding_whole_texts(spark):
    """The query decodes between places that are O in any case; full_spans scores every window and decodes the whole text."""
    model, rng = pii.trained_model(), random.Random(4)
    long = ["write to maria.magdalena.von.hohenzollern.sigmaringen @ examplehost.com", "verylongfirstname_andverylonglastname@mailhost dot com"]
    texts = [f"{'the and ' * k}{x}{' ' * (k % 7)}{'the and ' * j}" for x in long for k in range(0, 24, 3) for j in (0, 1, 9)]
    for _ in range(250):
        texts.append("".join(rng.choice(["the", " ", " ", "1", "23", "@", ".", "-", "a", "\n", "(017) 555-7713", "x@y dot com", "10 . 0 . 0 . 1", "é", "日本", "word " * 30, "9" * 40]) for _ in range(rng.randint(1, 60))))
    texts += ["", "1", "@" * 700, "1 2 3 " * 900, "a" * 63 + "1", "a" * 64 + "1", "1" + "a" * 95, "0123456789" * 300]
    texts += [r[0] or "" for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").collect()]
    got = pii.model_spans(texts, model)
    assert got == [sorted(set(pii.full_spans(x, model))) for x in texts]
    assert [texts[0][a:b] for _, a, b in got[0]] == [long[0].removeprefix("write to ")] and sum(map(len, got)) > 100


def test_texts_of_many_cells_are_several_jobs(monkeypatch):
    model = pii.trained_model()
    texts = ["call (017) 555-7713 now " * 80, "x@y dot com the and " * 60]
    want = [pii.full_spans(x, model) for x in texts]
    for held, piece in ((1, 1), (3, 2), (7, 40)):
        monkeypatch.setattr(pii, "HELD", held)
        monkeypatch.setattr(pii, "PIECE", piece)
        assert pii.model_spans(texts, model) == want


def test_pii_query_cases(spark):
    texts = [None, "", "a@b.co", "é" * 100_000 + " a@b.co 10.0.0.1", "a@b.co", "call (017) 555-7713 now"]
    rows = pii.find_pii(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0)]
    assert rows[3].spans == "email:100001:100007,ip:100008:100016" and rows[5].spans == "phone:5:19"
    assert pii.find_pii(docs_of(spark, [])).count() == 0


# ---- chat ----


def test_escape_round_trip():
    rng = random.Random(3)
    for _ in range(5000):
        x = "".join(rng.choice(["<", "|", "\\", "<|", "<|end|>", "<\\|", "a", "\n", "</turn>", chat.TURN]) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)
        turns = [("user", x), (x, "y"), ("assistant", x)]
        assert chat.read_back(chat.format_turns(turns)).turns == turns


@pytest.mark.parametrize(
    "record,name,turns",
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "n"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "o", "id": 4}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "completion": "c"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"turns": [{"turn": 1, "role": "assistant", "text": "b"}, {"turn": 0, "role": "user", "text": None}]}, "rows", [("user", ""), ("assistant", "b")]),
        ({"other": 1}, None, []),
        ([1], None, []),
        (None, None, []),
    ],
)
def test_layouts(spark, record, name, turns):
    df = spark.createDataFrame([(1, json.dumps(record) if record is not None else None)], "conv_id long, record string")
    r = chat.format_records(df, "conv_id", "record").first()
    assert r.layout == name and chat.read_back(r.formatted).turns == turns
    loss = "".join(t for role, t in turns if role == "assistant")
    assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query(spark):
    rows = {r.conv_id: r for r in queries.op7_chat(spark, f"{DATA}/sf0.001").collect()}
    turns: dict[int, list] = {-7: [("user", queries.EXTRA_TEXT), ("assistant", queries.EXTRA_TEXT)]}
    for r in spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(rows) == set(turns)
    for k, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        want = (len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (rows[k].n_turns, rows[k].turns_sha256, rows[k].loss_chars, rows[k].loss_sha256) == want


def test_rows_with_nulls_ties_and_repeats(spark):
    df = spark.createDataFrame([(1, 1, None, None, "x"), (1, 1, "user", "b", "x"), (1, 1, "user", "b", "x"), (1, None, "user", "a", "x"), (None, 0, "user", "n", "x")], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: chat.read_back(r.formatted).turns for r in chat.format_records(chat.records_of_rows(df), "conv_id", "record").collect()}
    assert got == {1: [("user", "a"), ("", ""), ("user", "b"), ("user", "b")], None: [("user", "n")]}


def test_conversation_of_null_turns_only(spark):
    df = spark.createDataFrame([(1, None, "user", "b"), (1, None, "assistant", "a"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.layout, chat.read_back(r.formatted).turns) for r in chat.format_records(chat.records_of_rows(df), "conv_id", "record").collect()}
    assert got == {1: ("rows", [("assistant", "a"), ("user", "b")]), 2: ("rows", [("", "")])}


@pytest.mark.parametrize(
    "record, name, turns",
    [
        ('{"messages": [', None, []),
        ("[" * 100_000, None, []),
        ('{"messages": ' + "[" * 100_000, None, []),
        ("[1]", None, []),
        ("NaN", None, []),
        ('{"a": ' + "9" * 5000 + "}", None, []),
        ({"turns": [{"turn": "2", "role": "user", "text": "d"}, {"turn": 10, "role": "user", "text": "c"}, {"turn": 2.5, "role": None, "text": "b"}, {"turn": None, "role": "user", "text": "a"}, {"turn": [1], "role": "x", "text": "e"}, {"turn": float("nan"), "role": "y", "text": "f"}]}, "rows", [("user", "a"), ("", "b"), ("user", "c"), ("user", "d"), ("y", "f"), ("x", "e")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "b", None]}, {"role": 5, "content": {"content": {"text": "c"}}}, "odd", 7]}, "messages", [("user", 'a\n\n{"type": "image", "url": "u"}\n\nb'), ("5", "c")]),
        ({"messages": [], "prompt": "p", "completion": None}, "prompt", [("user", "p"), ("assistant", "")]),
        ({"prompt": {"text": "p", "more": [1]}, "response": ["x", ["y"]]}, "response", [("user", "p"), ("assistant", "x\n\ny")]),
        ({"question": 1, "answer": False, "context": []}, "question", [("user", "1"), ("assistant", "false")]),
        ({"messages": {"role": "user", "content": "x"}}, None, []),
        ('{"prompt": "a\\ud800b", "completion": "\\ud83d\\ude00"}', "prompt", [("user", "a\ufffdb"), ("assistant", "\U0001f600")]),
    ],
)
def test_odd_records_give_a_row(spark, record, name, turns):
    df = spark.createDataFrame([(1, record if isinstance(record, str) else json.dumps(record))], "id long, record string")
    r = chat.format_records(df, "id", "record").first()
    assert (r.layout, chat.read_back(r.formatted).turns, r.n_turns) == (name, turns, len(turns))


def test_all_layouts_on_whole_tables(spark):
    """Every conversation, or every turn with its answer, in each of the layouts: read back, the turns are those of the table."""
    rows = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    names, back = {"user": "human", "assistant": "gpt"}, []
    for turns in by.values():
        back.append(({"turns": [{"turn": k, "role": r, "text": t} for k, (r, t) in reversed(list(enumerate(turns)))]}, "rows", turns))
        back.append(({"messages": [{"role": r, "content": t} for r, t in turns], "more": 1}, "messages", turns))
        back.append(({"conversations": [{"from": names.get(r, r), "value": t} for r, t in turns]}, "conversations", turns))
        for (a, x), (b, y) in zip(turns, turns[1:], strict=False):
            if (a, b) != ("user", "assistant"):
                continue
            back.append(({"instruction": x, "input": "", "output": y}, "instruction", [(a, x), (b, y)]))
            back.append(({"system": "s", "prompt": x, "completion": y}, "prompt", [("system", "s"), (a, x), (b, y)]))
            back.append(({"prompt": x, "response": y}, "response", [(a, x), (b, y)]))
            back.append(({"context": "c", "question": x, "answer": y}, "question", [(a, f"c\n\n{x}"), (b, y)]))
    df = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _, _) in enumerate(back)], "id long, record string")
    got = {r.conv_id: r for r in chat.format_records(df, "id", "record").collect()}
    assert {n for _, n, _ in back} == {x.name for x in chat.LAYOUTS} and len(got) == len(back)
    for k, (_, name, turns) in enumerate(back):
        assert (got[k].layout, chat.read_back(got[k].formatted).turns) == (name, turns)


def test_a_table_that_has_the_added_conversation(spark, tmp_path):
    spark.createDataFrame([(-7, 0, "user", "own <|end|> <\\|turn|>")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op7_chat(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.n_turns) for r in got) == [(-7, 1), (-7, 2)]


# ---- licences ----


def test_canonical_forms(spark):
    mit = LICENSES["MIT"][0]
    texts = [mit.upper(), f"Copyright (c) 2020 Somebody\n\n{mit}", mit.replace("sublicense", "sub-license").replace(",", ""), "Words.\nReleased under the MIT Licence!\nMore.", "The MIT License is fine", None, "", "x" * 100_000, "licence " * 9000]
    got = {(r.doc_id, r.license): (r.n_text, r.n_lines) for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert got == {(0, "MIT"): (1, 0), (1, "MIT"): (1, 0), (2, "MIT"): (1, 0), (3, "MIT"): (0, 1)}
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0
    both = docs_of(spark, ["Released under the MIT License."])
    assert licenses.scan_licenses(both.union(both)).first()[2:] == (2, 2)


#: Entire texts by identifier, and files in Debian's folder of licences.
ENTIRE = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def wrapped(text, width):
    paragraphs = (" ".join(x.split()) for x in re.split(r"\n\s*\n", text))
    return "\n\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in paragraphs)


def test_entire_licenses_however_wrapped(spark):
    at = Path("/usr/share/common-licenses")
    texts = [(name, (at / x).read_text(errors="replace")) for name, x in ENTIRE.items() if (at / x).exists()]
    end = "END OF TERMS AND CONDITIONS"
    texts += [(name, t[: t.index(end) + len(end)]) for name, t in texts if end in t]
    texts += [(name, t) for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause") for t in LICENSES[name] if len(t) > 300]
    texts += [(name, f"Copyright (c) 2020, 2021 Some Body, Inc.\nAll rights reserved.\n\n{t}") for name, t in texts[-8:]]
    forms = [(name, form) for name, t in texts for form in (t, " ".join(t.split()), *(wrapped(t, w) for w in (40, 60, 70, 79, 100, 120)))]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, [t for _, t in forms])).where("n_text > 0").collect()}
    assert got == {k: name for k, (name, _) in enumerate(forms)}


def test_only_notices_are_taken_for_copyright_notices():
    keep = ["copyright notice and this permission notice", "(c) you must retain all copyright", "copyright law", "the copyright holder 2020"]
    for x in keep:
        assert licenses.canonical_python(f"permission is hereby granted\n{x}") == licenses.canonical_python(f"permission is hereby granted {x}") != "permission is hereby granted"
    gone = ["Copyright (c) 2020 A", "© 2020 A, B", "(C) Copyright 1999-2003 A. All rights reserved.", "Copyright 2020 A\nCopyright 2021 B\nall rights  reserved"]
    for x in gone:
        assert licenses.canonical_python(f"{x}\n\nRedistribution and use x") == "redistribution and use x" == licenses.canonical_python(f"{x} Redistribution and use x")
    assert licenses.canonical_python("Copyright (c) 2020 A. Released under MIT.") == "released under mit"


DENIED = [
    "Copyright (c) 2020 Acme. This file is proprietary and is not licensed under the MIT License.",
    "Copyright (c) 2020 Acme, which is not licensed under the MIT License",
    "Copyright (c) 2020 Acme. Parts are closed. Released under the MIT License.",
    "Copyright (c) 2020 Acme\nNot for redistribution\nReleased under the MIT License.",
    "Copyright (c) 2020 Acme. No part of this is released under the MIT License.",
    f"Copyright (c) 2020 Acme. The following isn't granted.\n\n{LICENSES['MIT'][0]}",
    f"Copyright (c) 2020 Acme\nThis is not what it says:\n{LICENSES['MIT'][0]}",
]


def test_denied_licenses_are_none(spark):
    got = licenses.scan_licenses(docs_of(spark, DENIED)).collect()
    assert [(r.doc_id, r.n_text) for r in got if r.n_text] == [] and {r.doc_id for r in got} <= {3}  # a line of its own in the fourth


def test_copyright_lines_of_any_number_and_kind(spark):
    mit, own = LICENSES["MIT"][0], ["Copyright (c) {y} Some Body", "Portions Copyright (c) {y} Other, Inc.", "Copyright A B <a@b.c>", "Copyright {y}-2024 The Authors. All rights reserved.", "© {y} Ünï Köde", "Copyright by Some One", " * Portions copyright Some Two <x@y.z>"]
    texts = []
    for n in (1, 2, 5, 20, 50):
        lines = [own[k % len(own)].format(y=1990 + k % 30) for k in range(n)]
        texts += [gap.join(lines) + end + mit for gap in ("\n", "\n\n") for end in ("\n\n", "\n")] + ["MIT License\n\n" + "\n".join(lines) + "\n\n" + mit]
    texts += [f"Copyright (c) 2020 {'Very Long Name of Some Body, ' * 400}\n\n{mit}", f"Copyright (c) 2020 Some Body {' '.join(mit.split())}"]
    got = {r.doc_id: (r.license, r.n_text) for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert got == {k: ("MIT", 1) for k in range(len(texts))}


def test_very_long_lines_are_no_burden(spark):
    texts = ["Copyright (c) 2020 " + "x " * 300_000 + "licence", "copyright (c) " * 60_000 + "licence", "(c) 2020 Licence" + "\n" * 200_000]
    assert licenses.scan_licenses(docs_of(spark, texts)).count() == 0


def test_other_digests(spark):
    known = [(hashlib.md5(licenses.canonical_python("The Own Licence").encode()).hexdigest(), "Own")]
    got = licenses.scan_licenses(docs_of(spark, ["the own license.", "MIT License"]), known=known).collect()
    assert [tuple(r) for r in got] == [(0, "Own", 1, 1)]


def test_canonical_python_is_the_same(spark):
    texts = [t for x in LICENSES.values() for t in x] + ["Ünï (C) x\n copyright foo\nAll rights reserved.\nv 2 LICENCE  sub-licence", " \n Copyright ©\n2020 x\n \ny", "x (c) 2020 y\n", "Copyright 2020" + " x" * 200 + "\n\ny"]
    texts += [*DENIED, "Portions Copyright A B <a@b.c>\nCopyright law\ncopyright 2020 x. y", "Copyright 2020 A\nB C. D\n\nE"]
    for over in (False, True):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(licenses.F.col("t"), over)).collect()
        assert [r[0] for r in got] == [licenses.canonical_python(t, over) for t in texts]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    against_oracle(queries.queries()[name](spark, f"{DATA}/sf0.001"), queries.oracle_sql()[name])


def test_coded_words_of_slices():
    x = pa.array(["a b", None, " C  d ", "", "e\x0bf\x1fg"])
    for k in range(5):
        names, codes, at = coded_words(x.slice(k))
        words = [names[c].as_py() for c in codes]
        want = [(t.as_py() or "").lower().encode().split() for t in x.slice(k)]
        assert [w.encode() for w in words] == [w for t in want for w in t] and at.tolist() == [sum(map(len, want[:i])) for i in range(len(want) + 1)]
