"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII byte that is not 0-9 or a letter into a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z and keeps every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: A task works on about so many bytes of text at a time: Spark ends Arrow batches there, and those of others are cut.
CHUNK_BYTES = 4 << 20
#: Spark's setting that ends an Arrow batch by its bytes; 64 MB by default, and both sides hold a batch more than once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting that ends shuffle files with the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names; a folder in the warehouse only where Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/procspark-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables, written to the shared folder so that lineage is cut and lost executors cost little.

    ``cut`` writes and rereads a table; ``drop`` deletes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, scratch_dir(spark), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        # What a written table was made from isn't read again, so its shuffle files can go at once.
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``CHUNK_BYTES`` at most for this session's Python tasks, whatever the rows' width.

    Results are planned after an operator returns, so the setting stays.
    """
    spark.conf.set(BATCH, str(CHUNK_BYTES))


def map_rows(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str | object, chunk: int = CHUNK_BYTES
) -> DataFrame:
    """Apply ``fn`` to record batches of bounded size; it returns columns by name, in the order of ``schema``."""
    small_batches(df.sparkSession)
    return df.mapInArrow(_Mapper(fn, chunk), schema)


class _Mapper:
    def __init__(self, fn: Callable[[pa.RecordBatch], dict[str, object]], chunk: int):
        self.fn, self.chunk = fn, chunk

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, self.chunk):
                out = self.fn(batch)
                arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in out.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(out))


def bounded(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, min(n, int(n * limit / max(1, batch.nbytes))))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """Results of a pure function of a word, forgotten when there are too many."""

    def __init__(self, fn: Callable, most: int = 100_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.fn(key)
        return value


def id_text(col: str | Column) -> Column:
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def hash_order(*cols: str | Column) -> Column:
    """A repeatable pseudo-random order of rows."""
    return F.xxhash64(*cols, F.lit(20240229))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
