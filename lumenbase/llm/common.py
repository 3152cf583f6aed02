"""Shared helpers: shared scratch tables, byte-bounded Arrow batches, ragged arrays, tokenizer chunks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import share_code

#: The bytes that separate words: space, \t, \n, \v, \f, \r.
BLANKS = " \t\n\x0b\x0c\r"


_scope: ContextVar[list | None] = ContextVar("scope", default=None)


def scratch(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a folder of this machine is chosen and set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = "file://" + tempfile.mkdtemp(prefix="lumenbase-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/lumenbase-{uuid.uuid4().hex}"
    if (made := _scope.get()) is not None:
        made.append(path)
    return path


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def removed(spark: SparkSession, path: str) -> None:
    system, where = file_system(spark, path)
    system.delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch folders named inside are removed at the end."""
    token = _scope.set([])
    try:
        yield
    finally:
        for path in _scope.get():
            removed(spark, path)
        _scope.reset(token)


def written(df: DataFrame, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = path or scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lumenbase-" in path:
            removed(df.sparkSession, path)


def positional(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that no name can clash or need quotes."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def extended(df: DataFrame, extra: str) -> T.StructType:
    """The schema with more columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(extra).fields])


def named(df: DataFrame, names: list[str], drop: tuple[str, ...], own: tuple[str, ...]) -> DataFrame:
    """A positional table with results ``own`` behind: its old names again, less ``drop``, and the results."""
    keep = [i for i, n in enumerate(names) if n not in drop]
    return df.select(*[f"c{i}" for i in keep], *own).toDF(*[names[i] for i in keep], *own)


#: Rows of texts that cross to Python at a time: a batch of Spark's 10,000 can take 100 MB on either side.
MOST_ROWS = 1000


def prepared(spark: SparkSession) -> None:
    """Set a session up for operators on texts: this package's code for workers, and small Arrow batches."""
    share_code(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= MOST_ROWS:
        spark.conf.set(key, MOST_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_held: dict = {"stage": None}


def _stage() -> int | None:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.stageId() if context else None


def _let_go() -> None:
    """Forget what this worker kept for the tasks of another stage."""
    if _held["stage"] != (stage := _stage()):
        _held.clear()
        _held["stage"] = stage


def kept(key: str, make: Callable):
    """``make()``, kept by this worker process for later tasks of the same stage."""
    _let_go()
    if key not in _held:
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """A worker that waits for its next task holds no freed buffers."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes of text that one step of a Python task handles at a time; one longer text makes a step of its own.
STEP_BYTES = 4 << 20


def steps(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` (string or binary) holds at most ``limit`` bytes, or one row."""
    _let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = values.cast(pa.large_binary() if pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type) else pa.binary())
        width = np.int64 if pa.types.is_large_binary(sizes.type) else np.int32
        offsets = np.frombuffer(sizes.buffers()[1], width, len(sizes) + 1, sizes.offset * width().itemsize).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    _give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i] .. starts[i]+lengths[i]-1`` of every i, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)
