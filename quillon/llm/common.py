"""Helpers shared by the corpus operators: reading, lineage cuts, Arrow row mapping, text rules."""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-cases A-Z only; every other code point stays.
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, the one that ``spark.checkpoint.dir`` names.

    Without that setting a temporary folder serves a single machine; on a cluster its files would be
    on the driver alone, so that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-checkpoints-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes and rows of an Arrow batch, and rows of a scan's; larger settings of the session are lowered to these.
BATCH_BYTES, BATCH_ROWS, SCAN_ROWS = 4 << 20, 2000, 256


def bounded_batches(spark: SparkSession) -> None:
    """Bound what the JVM and Python hold of a scan and of an Arrow stream at a time, whatever the texts' lengths."""
    for key, most in (("execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("parquet.columnarReaderBatchSize", SCAN_ROWS)):
        now = re.match(r"-?\d+", str(spark.conf.get(f"spark.sql.{key}")))
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(f"spark.sql.{key}", str(most))


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema(ddl))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], ddl: str) -> DataFrame:
    """Arrow-batched mapping.  ``make`` runs once in each task and returns the batch function.

    The batch function yields dicts of columns (lists or Arrow arrays), one for each output batch.
    """

    want = arrow_schema(ddl)
    bounded_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for out in one(batch):
                yield pa.RecordBatch.from_arrays(
                    [v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in want], schema=want
                )

    return df.mapInArrow(task, schema(ddl))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, or one row."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def least_hash(rows: DataFrame, name: str, most: int) -> int | None:
    """The greatest of the ``most`` smallest distinct values of a column of 64-bit hashes; None if there are no more.

    Few candidates are sorted: those below a bound that about four times as many values should pass.
    Only if repeats leave too few of them are all values sorted.
    """
    total = rows.count()
    if total <= most:
        return None
    span = 1 << 64
    bound = min(-(1 << 63) + span * 4 * most // total, (1 << 63) - 1)
    for some in (rows.filter(F.col(name) <= F.lit(bound).cast("bigint")), rows):
        found = [r[0] for r in some.select(name).distinct().orderBy(name).limit(most).collect()]
        if len(found) == most:
            return found[-1]
    return None


def lists(parts: list[np.ndarray | None]) -> pa.Array:
    """A column of lists of 64-bit integers from arrays, without making Python numbers."""
    lengths = [0 if x is None else len(x) for x in parts]
    values = np.concatenate([np.zeros(0, np.int64), *(x for x in parts if x is not None)]).astype(np.int64, copy=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    missing = pa.array([x is None for x in parts]) if any(x is None for x in parts) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=missing)


def crc_fold(doc_id: Column | str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null id: the crc of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def py_crc_fold(doc_id, folds: int = 4) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds
