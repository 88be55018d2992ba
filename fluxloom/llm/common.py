"""What the operators of this subpackage share: the shared work folder, Arrow mapping, column names."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows that a step works on at once where its arrays are larger than what it reads or writes.
PIECE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder in local
    mode; an error elsewhere, for executors on other machines would not see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set; with master {master} it must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fluxloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written below the shared folder, which cuts lineage and survives
    the loss of executors. Tables go when ``drop`` is called, and all that are left when the driver ends: the plan that
    an operator returns still reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._files(self.path, lambda fs, path: fs.mkdirs(path) and fs.deleteOnExit(path))

    def _files(self, path: str, act: Callable) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        act(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            self._files(f"{self.path}/{name}", lambda fs, path: fs.delete(path, True))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def workers_find_us(spark: SparkSession) -> None:
    """Python workers on this machine import this package as the driver does; a cluster gets it with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def give_back() -> None:
    """Free memory of this process goes back to the system; Python workers wait for further tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, rows: int | None = None) -> DataFrame:
    """mapInArrow with a function built once per task by ``make`` (so that models load once). With ``rows`` it gets a
    batch's rows in order, at most so many at once, and what memory is free at the end goes back."""
    workers_find_us(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), rows or max(1, batch.num_rows)):
                out = step(batch.slice(at, rows) if rows else batch)
                if out is not None:
                    yield out
        if rows:
            batch = out = step = None
            give_back()

    return df.mapInArrow(run, schema)


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay. The short way for texts without other than ASCII characters is the same."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
