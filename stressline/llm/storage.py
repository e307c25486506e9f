"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset and all runs in one process (local mode), a folder of
    our own; on a cluster executors would not see it, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="stressline-"))
    return f"file://{_own[0]}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not use, whatever its own are called."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator call. ``drop`` frees one that no later plan reads;
    what the returned DataFrame still reads goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        _made.append((spark, self.root))

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self._paths.pop(id(t), None)
            if path:
                _delete(self.spark, path)


def without(rows: DataFrame, gone: DataFrame, on: list[str], broadcast_rows: int = 500_000) -> DataFrame:
    """Rows whose key (nulls are equal) is not in ``gone``, a written table; it is broadcast only if it is small."""
    small = gone.count() <= broadcast_rows
    side = (F.broadcast(gone) if small else gone).alias("_gone")
    match = None
    for c in on:
        same = F.col(f"_rows.{c}").eqNullSafe(F.col(f"_gone.{c}"))
        match = same if match is None else match & same
    return rows.alias("_rows").join(side, match, "left_anti")


def once_each(rows: DataFrame, repeats: DataFrame, on: list[str]) -> DataFrame:
    """Rows of which those with a key in ``repeats``, a written table, stay once each."""
    if not repeats.limit(1).count():
        return rows
    match = None
    for c in on:
        same = F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}"))
        match = same if match is None else match & same
    single = rows.alias("_left").join(repeats.alias("_right"), match, "left_semi").dropDuplicates(on)
    return without(rows, repeats, on).unionByName(single)


@atexit.register
def _clean() -> None:
    for spark, root in _made:
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
