"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows, and bytes of their texts, that a Python operator holds as Python objects at one time; one row at least.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portions(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, int]]:
    """(begin, number) of consecutive rows that may be held together."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    after, at = np.cumsum(size), 0
    while at < len(size):
        n = int(np.searchsorted(after, (after[at - 1] if at else 0) + BYTES_AT_ONCE, "right")) - at
        n = max(1, min(rows, n))
        yield at, n
        at += n


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list]], ddl: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Run a Python operator over Arrow batches, ``rows`` rows at a time, fewer where they are long.

    ``make()`` is called once per task and returns a function from the input columns, as lists, to the
    output columns, as lists. Rows stay in their partition: no shuffle, and a lost task is simply run again.
    """
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at, n in portions(batch, rows):
                found = work(*(c.to_pylist() for c in batch.slice(at, n).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


_setting = threading.RLock()  # two queries of one session don't meet in the setting below
#: Has Spark remove a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a folder of this machine does only if
    the session runs on this machine alone, as in tests; on a cluster it is an error. The shuffle files that led to
    the copy are removed at once: the copy stands in for them, and until the driver collects its garbage they would
    fill the executors' disks. The copy goes when nothing refers to it, if the session is told to clean checkpoints.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-"))
    with _setting:
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            plan = df.select("*")  # takes the setting along
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return plan.checkpoint(eager=True)


def sampled(df: DataFrame, total: int, most: int, *cols: str) -> DataFrame:
    """At most ``most`` of ``total`` rows, in the order of a hash of columns; few more than that leave their tasks."""
    key = F.xxhash64(*cols)
    if total > 4 * most:
        df = df.where(key < int(2**64 * (4 * most / total)) - 2**63)
    return df.orderBy(key, *cols).limit(most)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
