"""Versioned snapshots of the ledger and queue, each committed by one numbered file of a log.

A snapshot is a Parquet folder v=<n> under a root: a whole table, or a delta of
rows that replace those of the same key.  Commit k is the file _log/<k>, which
names its folder and appears in one rename that fails if it is there; so of two
writers that began from commit k - 1 one gets it, and the other learns that the
table has moved.  A crash leaves either the old table or the new one.  The newest
five whole tables are kept, with the deltas after them, and a damaged one falls
back to the newest readable commit before it.  Files are handled through Hadoop's
FileSystem, so roots may be in any store that Spark writes and that renames
without overwriting.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import Files

KEEP = 5
#: Deltas after which a whole table is written again, and commits whose files stay in the log at least.
DELTAS, LOGGED = 20, 1000
#: Times that a change is made anew if others commit meanwhile.
TRIES = 20
#: Seconds after which a lock that isn't renewed counts as left behind.
STALE = 600.0


class MissingSnapshot(Exception):
    """There is no snapshot, or none that can be read."""


class Moved(Exception):
    """Another writer has committed since the table was read."""


class Locked(Exception):
    """Another run holds the lock."""


def retained(versions: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest `keep` versions of each name (name, version)."""
    by = Window.partitionBy("name").orderBy(F.desc("version"))
    return versions.withColumn("n", F.row_number().over(by)).where(F.col("n") <= keep).drop("n")


@dataclass
class Snapshots:
    """The snapshots of one table under a root folder.  key: the column by which a delta's rows replace others."""

    spark: SparkSession
    root: str
    keep: int = KEEP
    key: str = "entry_key"
    recovered: list[dict[str, str]] = field(default_factory=list)
    #: The commit that was loaded last; 0 if there was none.
    at: int = 0
    _known: dict[int, dict] = field(default_factory=dict, repr=False)

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def versions(self) -> list[int]:
        """Versions whose folders are there, oldest first."""
        return sorted(int(n[2:]) for n in self.files.folders() if n.startswith("v=") and n[2:].isdigit())

    def commits(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("_log") if n.isdigit())

    def entry(self, commit: int) -> dict:
        """version, kind (table or delta) and batch of a commit."""
        if commit not in self._known:  # commits don't change
            self._known[commit] = json.loads(self.files.read(f"_log/{commit:012d}"))
        return self._known[commit]

    def current(self) -> int | None:
        """The version that was committed last."""
        commits = self.commits()
        return self.entry(commits[-1])["version"] if commits else None

    def _new_version(self) -> int:
        """A number that no other writer has."""
        n = max([0, *self.versions(), *(int(x) for x in self.files.names("_log/taken") if x.isdigit())])
        while not self.files.put_new(f"_log/taken/{(n := n + 1)}", ""):
            pass
        return n

    def _commit(self, df: DataFrame, kind: str, expected: int | None, batch: str | None) -> int:
        version = self._new_version()
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        text = json.dumps({"version": version, "kind": kind, "batch": batch})
        commit = (max(self.commits(), default=0) if expected is None else expected) + 1
        if not self.files.exists(f"v={version}"):
            raise Moved(f"{self.root} has moved so far that version {version} counted as left behind")
        while not self.files.put_new(f"_log/{commit:012d}", text):
            if expected is not None:
                self.files.delete(f"v={version}")
                raise Moved(f"{self.root} has moved past commit {expected}")
            commit += 1
        self.at = commit
        self._drop_old()
        return version

    def save(self, df: DataFrame, expected: int | None = None, batch: str | None = None) -> int:
        """Commits a whole table; returns its version.

        expected: the commit that the table was made from (`at` after load());
        Moved, and nothing changes, if there has been another since.  batch: the
        archive's batch that counts from this commit on.
        """
        return self._commit(df, "table", expected, batch)

    def patch(self, rows: DataFrame, expected: int, batch: str | None = None) -> int:
        """Commits rows, whole ones, that replace or join those of the table by key; nothing else is written.

        After DELTAS of them the whole table is written once.
        """
        chain = self._chain(expected)
        if len(chain) > DELTAS or not chain:
            whole = rows if not chain else self._patched(self._table(expected), rows)
            return self._commit(whole, "table", expected, batch)
        return self._commit(rows, "delta", expected, batch)

    def update(self, change: Callable[[DataFrame], DataFrame | None], default: DataFrame | None = None) -> int | None:
        """Commits change(table), made anew from the new table as often as another writer is first; None changes nothing."""
        for _ in range(TRIES):
            new = change(self.load(default))
            if new is None:
                return None
            with contextlib.suppress(Moved):
                return self.save(new, expected=self.at)
        raise Moved(f"{self.root} moved {TRIES} times")

    def _chain(self, commit: int) -> list[dict]:
        """The commits that make up a table: the whole one, and the deltas after it."""
        chain: list[dict] = []
        while commit > 0:
            chain.insert(0, self.entry(commit))
            if chain[0]["kind"] == "table":
                break
            commit -= 1
        return chain

    def _table(self, commit: int) -> DataFrame:
        """A commit's table: of several deltas of a key the last one counts."""
        read = lambda x: self.spark.read.parquet(f"{self.root}/v={x['version']}")
        whole, *deltas = self._chain(commit)
        if not deltas:
            return read(whole)
        rows = None
        for k, x in enumerate(deltas):
            part = read(x).select(self.key, F.struct(F.lit(k).alias("k"), F.struct("*").alias("row")).alias("__last"))
            rows = part if rows is None else rows.unionByName(part)
        last = rows.groupBy(self.key).agg(F.max_by("__last.row", "__last.k").alias("row")).select("row.*")
        return self._patched(read(whole), last)

    def _patched(self, table: DataFrame, rows: DataFrame) -> DataFrame:
        return table.join(rows.select(self.key), self.key, "left_anti").select(table.columns).unionByName(rows)

    def _drop_old(self) -> None:
        """Deletes folders from before the oldest whole table that is kept, whoever left them."""
        whole, kept = [], []
        for k in reversed(commits := self.commits()):
            kept.append(self.entry(k)["version"])
            whole += [k] if self.entry(k)["kind"] == "table" else []
            if len(whole) == self.keep:
                break
        else:
            return
        for version in self.versions():
            if version < min(kept):
                self.files.delete(f"v={version}")
        for n in self.files.names("_log/taken"):
            if n.isdigit() and int(n) < min(kept):
                self.files.delete(f"_log/taken/{n}")
        for k in commits:
            if k < whole[-1] - LOGGED:
                self.files.delete(f"_log/{k:012d}")

    def load(self, default: DataFrame | None = None) -> DataFrame:
        """The table committed last; if it can't be read the newest before it that can, which is noted in `recovered`.

        Without any snapshot the default, if there is one.
        """
        commits = self.commits()
        if not commits:
            self.at = 0
            if default is None:
                raise MissingSnapshot(f"no snapshot under {self.root}")
            return default
        self.at = commits[-1]
        path = lambda k: f"{self.root}/v={self.entry(k)['version']}"
        for commit in reversed(commits):
            try:
                df = self._table(commit)
                df.write.format("noop").mode("overwrite").save()  # damage shows only when all columns are read
            except (PySparkException, Py4JJavaError) as e:
                if not unreadable(e):
                    raise
                continue
            if commit != self.at:
                self.recovered.append({"path": path(self.at), "recovered_from": path(commit)})
            return df
        raise MissingSnapshot(f"no readable snapshot under {self.root}")

    def peek(self) -> DataFrame:
        """The table committed last, without reading it all first; damage is an error where it's met."""
        self.at = max(self.commits(), default=0)
        if not self.at:
            raise MissingSnapshot(f"no snapshot under {self.root}")
        return self._table(self.at)


def unreadable(error: PySparkException | Py4JJavaError) -> bool:
    """Whether an error says that files can't be read: damaged or no Parquet, as against a lost cluster or too little memory."""
    said = str(error)
    return any(x in said for x in ("FAILED_READ_FILE", "CANNOT_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND", "FAILED_MERGE_SCHEMA", "is not a Parquet file", "ParquetDecodingException", "ChecksumException"))


class _LockFile:
    def __init__(self, spark: SparkSession, root: str):
        context = spark.sparkContext
        self._jvm, self.root, self.owner = context._jvm, root, uuid.uuid4().hex
        self.path = self._jvm.org.apache.hadoop.fs.Path(f"{root}/LOCK")
        self.fs = self.path.getFileSystem(context._jsc.hadoopConfiguration())

    def write(self, over: bool) -> None:
        with contextlib.closing(self.fs.create(self.path, over)) as stream:
            stream.write(bytearray(self.owner.encode()))

    def create(self) -> bool:
        """False if it is there."""
        try:
            self.fs.mkdirs(self.path.getParent())
            self.write(False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def age(self, path=None) -> float:
        return time.time() - self.fs.getFileStatus(path or self.path).getModificationTime() / 1000

    def take_over(self, stale: float) -> bool:
        """Puts a stale lock aside and makes a new one.  Of several that try, one does the renaming; if what it moved is fresh it goes back."""
        aside = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/LOCK.{self.owner}")
        if self.age() <= stale or not self.fs.rename(self.path, aside):
            return False
        if self.age(aside) <= stale:
            self.fs.rename(aside, self.path)
            return False
        self.fs.delete(aside, False)
        return self.create()

    def mine(self) -> bool:
        with contextlib.closing(self.fs.open(self.path)) as stream:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") == self.owner


@contextlib.contextmanager
def lock(spark: SparkSession, root: str, stale: float = STALE):
    """Holds root/LOCK, which is created if it isn't there; Locked if another run has it.

    The holder writes it again every so often.  A lock that nobody has written
    for `stale` seconds is of a run that died, and is taken over.
    """
    file = _LockFile(spark, root)
    if not file.create() and not (file.fs.exists(file.path) and file.take_over(stale)):
        raise Locked(root)
    ended = threading.Event()

    def beat() -> None:
        while not ended.wait(stale / 5):
            if file.mine():
                file.write(True)

    holder = threading.Thread(target=beat, daemon=True)
    holder.start()
    try:
        yield
    finally:
        ended.set()
        holder.join()
        if file.fs.exists(file.path) and file.mine():
            file.fs.delete(file.path, False)


def locked_run(spark: SparkSession, root: str, run: Callable[[], dict]) -> dict:
    """What a run reports, or that it was skipped because another holds the lock."""
    try:
        with lock(spark, root):
            return run()
    except Locked:
        return {"skipped": "locked", "lock": f"{root}/LOCK"}
