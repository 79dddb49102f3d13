"""Summary-table store: write a table once as Parquet, read it back everywhere.

This is the create-or-replace step of the build (write_table): it cuts lineage, so
later plans start from a compact table instead of re-deriving from raw events, and
a lost executor only re-reads files instead of recomputing the chain.  Tables live
under the shared folder named by ``spark.checkpoint.dir`` (never a machine-local
folder on a cluster).
"""

from __future__ import annotations

import hashlib
import os
import sys
import threading
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from pathweave.session import checkpoint_dir

_LOCK = threading.RLock()
_MEMO: dict[str, DataFrame] = {}


@dataclass
class WriteStats:
    table: str
    path: str
    row_count: int
    elapsed_ms: int


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> WriteStats:
    """Replace the table at ``path``; the row count is observed in the same pass."""
    obs = Observation("write_table")
    t0 = time.monotonic()
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    elapsed = int((time.monotonic() - t0) * 1000)
    return WriteStats(os.path.basename(path.rstrip("/")), path, int(obs.get["rows"]), elapsed)


def _code_version() -> str:
    """Hash of the package sources: a table written by other code is never reused."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for d, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(d, f), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:12]


_CODE_VERSION = _code_version()


def _fingerprint(parts: tuple) -> str:
    return hashlib.sha1(repr(parts).encode()).hexdigest()[:16]


def _fs_status(spark: SparkSession, path: str):
    """Hadoop FileSystem status of ``path`` (works for HDFS / object stores too)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def _input_signature(spark: SparkSession, path: str) -> tuple:
    """(path, length, time) of every file under ``path``: an added or rewritten file gives another signature."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return (path,)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return (path, *sorted(found))


class TableStore:
    """Summary tables of one build (inputs + parameters).

    Reads reuse a table that is there. ``rebuild`` starts a run that writes every
    table it is asked for anew, once, and keeps the statistics of each write.
    """

    def __init__(self, spark: SparkSession, key_parts: tuple, inputs: tuple[str, ...] = ()):
        self.spark = spark
        sig = tuple(_input_signature(spark, p) for p in inputs)
        self.root = os.path.join(checkpoint_dir(spark), "pathweave-tables",
                                 _fingerprint((_CODE_VERSION, os.environ.get("PATHWEAVE_STORE_TAG", ""), key_parts, sig)))
        self.stats: dict[str, WriteStats] = {}
        self._rebuilding = False

    def rebuild(self) -> None:
        self.stats, self._rebuilding = {}, True

    def get(self, name: str, build, partition_by: list[str] | None = None, schema=None, is_input: bool = False) -> DataFrame:
        """The table ``name``, written by ``build`` if it is missing, or in a rebuild unless it is an input of it."""
        path = os.path.join(self.root, name)
        memo_key = f"{self.spark.sparkContext.applicationId}:{path}"
        with _LOCK:
            again = self._rebuilding and not is_input and name not in self.stats
            if memo_key in _MEMO and not again:
                return _MEMO[memo_key]
            if again or _fs_status(self.spark, path + "/_SUCCESS") is None:
                st = self.stats[name] = write_table(build(), path, partition_by)
                if os.environ.get("PATHWEAVE_TRACE"):
                    print(f"[store] {name}: {st.row_count} rows in {st.elapsed_ms} ms", file=sys.stderr)
            reader = self.spark.read
            if schema is not None:  # also fixes partition column types (no inference)
                reader = reader.schema(schema)
            if partition_by:
                reader = reader.option("basePath", path)
            df = reader.parquet(path)
            _MEMO[memo_key] = df
            return df
