"""Shared plumbing: text columns as flat byte arrays, bounded chunks, shared folders.

Python code runs on executors over Arrow batches.  A batch is cut into chunks of at
most ``CHUNK_BYTES`` of text (one longer text is a chunk alone), so a worker's memory
depends on the longest text, never on the number of rows.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import deploy

CHUNK_BYTES = 8 << 20

#: Rows of an Arrow batch where the session leaves Spark's default of 10,000, which is meant
#: for numbers: texts of several kilobytes would make batches of tens of megabytes.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Make a session ready for Python code over texts."""
    deploy.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def tidied(run: Callable) -> Callable:
    """A function over batches that gives its memory back when it ends: Spark uses a worker for
    many tasks, and the allocators would keep the most that any of them needed."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not with this C library
                pass

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's.
    Where neither is set, a local folder on a single machine (tests); an error on a cluster."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and
    a lost executor costs no more than the files it was writing."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables of one computation in a folder of their own, which goes when its result is
    written elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, scratch(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}_{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.base)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n+1 offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``limit`` bytes."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[pa.Array], list]],
    fields: list[tuple[str, T.DataType]],
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = CHUNK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """One output row per row: the id column (and ``keep``), then ``fields``.

    ``make`` runs once per task and returns a function from the texts of a chunk to
    one Arrow array for each field.  Other columns are never read.
    """
    ship(docs.sparkSession)
    keep = [id_col, *(keep or [])]
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        work = make()
        for whole in batches:
            for b in chunks(whole, text_col, limit):
                cols = {f: b.column(i) for i, f in enumerate(b.schema.names)}
                out = work(cols[text_col])
                yield pa.RecordBatch.from_arrays([*(cols[k] for k in keep), *(pa.array(x) if isinstance(x, np.ndarray) else x for x in out)], names=schema.names)

    return docs.select(*keep, text_col).mapInArrow(tidied(run), schema)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray]], text_col: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """Rows, with all their columns, for which the function from texts to a mask says true."""
    ship(docs.sparkSession)

    def run(batches):
        work = make()
        for whole in batches:
            for b in chunks(whole, text_col, limit):
                yield b.filter(pa.array(np.asarray(work(b.column(b.schema.get_field_index(text_col))), dtype=bool)))

    return docs.mapInArrow(tidied(run), docs.schema)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes not to be one of a table's columns."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
