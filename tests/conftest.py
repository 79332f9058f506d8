from __future__ import annotations

import json
import os
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(base / "checkpoints"))
    yield session
    session.stop()


def normal(row: tuple) -> tuple:
    return tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)


def against_oracle(df, sql: str, sf: str = "sf0.001") -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{sf}/{t}.parquet')")
    cols = sorted(df.columns)
    got = sorted(normal(tuple(r[c] for c in cols)) for r in df.collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted(normal(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())
    assert got == want


class Served:
    """A paged message API on this machine: data, channel to ids; failing, channel to refusals left; limited, channel to answers 429 left; asked, the requests."""

    def __init__(self):
        self.data, self.failing, self.limited, self.asked = {}, {}, {}, []
        outer = self

        class Api(BaseHTTPRequestHandler):
            def do_GET(self):
                at = urlparse(self.path)
                channel, query = at.path.split("/")[2], parse_qs(at.query)
                outer.asked.append((channel, time.monotonic()))
                status, body = outer.answer(channel, int(query.get("after", ["0"])[0]), int(query["limit"][0]))
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Api)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, channel, after, limit):
        for left, said in ((self.failing, (500, "no")), (self.limited, (429, '{"retry_after": 0.01}'))):
            if left.get(channel, 0) > 0:
                left[channel] -= 1
                return said
        ids = [n for n in self.data[channel] if n > after][:limit]
        return 200, json.dumps([{"id": str(n), "timestamp": "2024-01-01T00:00:00Z", "content": f"m{n}", "author": {"username": "u"}, "attachments": [{"filename": "f"}]} for n in ids[::-1]])


@pytest.fixture
def served(tmp_path):
    (tmp_path / "token.json").write_text('{"token": "t"}')
    out = Served()
    out.options = {"url": out.url, "token_file": f"{tmp_path}/token.json"}
    yield out
    out.server.shutdown()
