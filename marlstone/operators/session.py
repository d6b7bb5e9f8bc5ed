"""Sessions as folders of tables: stages with their states, writing, reading, dropping."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths

STAGES = ["cloning", "scanning", "parsing", "chunking", "embedding", "indexing", "security"]
CONTENT = ["files", "entities", "relationships", "chunks", "vectors", "index", "findings", "scanners"]


def new_session_id() -> str:
    return uuid.uuid4().hex[:12]


@dataclass
class Session:
    """One analysis: tables under ``root/session_id``, on any file system that Spark writes to."""

    spark: SparkSession
    root: str
    id: str = field(default_factory=new_session_id)

    def __post_init__(self) -> None:
        ok = self.spark.range(1).select(paths.is_session_id(F.lit(self.id)).alias("ok")).first()["ok"]
        if not ok:
            raise ValueError(f"not a session id: {self.id!r}")

    def path(self, name: str) -> str:
        return f"{self.root}/{self.id}/{name}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.id}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def write(self, name: str, table: DataFrame) -> None:
        """Written beside the old table, which steps aside before the new one takes its place, and goes last: one of the two is there at any time."""
        fs, make = self._fs()
        at, new, old = (make(self.path(name) + ending) for ending in ("", "-new", "-old"))
        table.write.mode("overwrite").parquet(f"{self.path(name)}-new")
        if fs.exists(at):
            fs.delete(old, True)
            fs.rename(at, old)
        fs.rename(new, at)
        fs.delete(old, True)

    def read(self, name: str) -> DataFrame | None:
        """The table; what was there before, where a write ended between the two renames."""
        fs, make = self._fs()
        found = [p for p in (self.path(name), f"{self.path(name)}-old") if fs.exists(make(p))]
        return self.spark.read.parquet(found[0]) if found else None

    def version(self, name: str) -> int | None:
        """When the table was last written, in milliseconds."""
        fs, make = self._fs()
        at = make(self.path(name))
        return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else None

    def read_text(self, path: str, most_bytes: int) -> str | None:
        """A whole file's text, for a scanner's report; nothing if it isn't there or has more bytes."""
        fs, make = self._fs()
        at = make(path)
        if not fs.exists(at) or fs.getFileStatus(at).getLen() > most_bytes:
            return None
        return self.spark.read.text(path, wholetext=True).first()["value"]

    def drop(self, attempts: int = 4) -> bool:
        """Whether the session's folder was there and is gone. A file that is still open may hinder it for a moment, so it is tried again, after longer and
        longer pauses."""
        fs, make = self._fs()
        at = make(f"{self.root}/{self.id}")
        if not fs.exists(at):
            return False
        for k in range(attempts):
            if fs.delete(at, True) or not fs.exists(at):
                return True
            time.sleep(0.1 * 2**k)
        return False

    def scrub(self) -> None:
        """After a failure: the content goes, the status stays."""
        fs, make = self._fs()
        for name in CONTENT:
            for ending in ("", "-new", "-old"):
                fs.delete(make(self.path(name) + ending), True)


class StageTracker:
    """States of a session's stages; pending, running, completed, failed."""

    def __init__(self, session: Session) -> None:
        self.session, self.state, self.error = session, "running", None
        self.stages = {s: ["pending", None] for s in STAGES}

    def start(self, stage: str, detail: str | None = None) -> None:
        for name, entry in self.stages.items():
            if entry[0] == "running":
                self.stages[name][0] = "completed"
        self.stages[stage] = ["running", detail]
        self.save()

    def skip(self, stage: str, error: str) -> None:
        """An optional stage that failed: the run goes on."""
        self.stages[stage] = ["failed", error]
        self.save()

    def finish(self) -> None:
        self.stages = {s: ["completed" if x[0] == "running" else x[0], x[1]] for s, x in self.stages.items()}
        self.state = "completed"
        self.save()

    def fail(self, error: str) -> None:
        self.stages = {s: ["failed" if x[0] == "running" else x[0], x[1]] for s, x in self.stages.items()}
        self.state, self.error = "failed", error
        self.session.scrub()
        self.save()

    def save(self) -> None:
        rows = [(i, s, x[0], x[1], self.state, self.error) for i, (s, x) in enumerate(self.stages.items())]
        self.session.write("status", self.session.spark.createDataFrame(rows, "ord int, stage string, stage_state string, detail string, state string, error string").coalesce(1))


def cached_answers(wanted: DataFrame, cache: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Answers that the cache (key, answer) has, and the rows of wanted (key, ...) that it lacks."""
    if cache is None:
        return None, wanted
    return wanted.join(cache, "key"), wanted.join(cache.select("key"), "key", "left_anti")
