"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of one slice that Python code holds at a time, and bytes of text in it (one longer text stands alone).
SLICE_ROWS = 2048
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a folder of their own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="kinmatch-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The setting by which Spark deletes a query's shuffle files as soon as it has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Compressed tables in the shared folder, for results that are used more than once.

    A table stands for itself, so the shuffle files of the query that wrote it go at once instead of at some later
    garbage collection of the driver: many small steps then take no more disk than the largest of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        conf, before = self.spark.conf, self.spark.conf.get(RELEASE, "false")
        conf.set(RELEASE, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(RELEASE, before)
        out = self.tables[path] = self.spark.read.schema(df.schema).parquet(path)
        return out

    def drop_others(self, *kept: DataFrame) -> None:
        """Deletes all tables written but these."""
        self.drop(*[table for table in self.tables.values() if not any(table is x for x in kept)])

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables."""
        sc = self.spark.sparkContext
        for path in [p for p, table in self.tables.items() if any(table is x for x in tables)]:
            del self.tables[path]
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame) -> DataFrame:
    """The frame as a compressed table in the shared folder, read again: for results that are used more than once."""
    return Scratch(df.sparkSession).written(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds at most SLICE_ROWS rows and size bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + size, side="right"))
            to = min(max(to, at + 1), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over bounded slices; fn keeps no state between calls but caches of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what slices leave holds no cycles; walking large stores again and again costs more than the work itself
        gc.disable()
        for part in text_slices(batches, text):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out
            del out
        gc.enable()
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that a worker holds but does not use goes back to the system, as workers wait beside those of later steps."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget_stores() -> None:
    """What steps before built in this process goes, for a step that uses none of it."""
    if _PerProcess._built:
        _PerProcess._built.clear()
        give_back()


def per_process(make: Callable[[], object]) -> Callable[[], object]:
    """A getter that builds its value once in each Python process that calls it, and is not itself shipped built."""
    return _PerProcess(make)


class _PerProcess:
    _built: dict = {}

    def __init__(self, make):
        self.make, self.key = make, os.urandom(12)

    def __call__(self):
        if self.key not in _PerProcess._built:
            # the oldest go: a task uses two at most, and workers outlive queries
            while len(_PerProcess._built) >= 2:
                _PerProcess._built.pop(next(iter(_PerProcess._built)))
            _PerProcess._built[self.key] = self.make()
        return _PerProcess._built[self.key]


def table_schema(df: DataFrame, *more: str) -> str:
    """DDL of a frame's columns, then of more."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))
