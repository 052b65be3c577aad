"""Cutting lineage through storage that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shipping import map_arrow

#: Bytes of rows, before compression, at which a blob is closed.
BLOB = 64 << 20
_cleaned: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset on one machine (tests).

    Files are removed once nothing refers to their rows any more.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    if sc.applicationId not in _cleaned:
        _cleaned.add(sc.applicationId)
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored once in the shared folder: read again without being computed again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(rows: DataFrame, most: int) -> DataFrame:
    """``(blob)``: the rows of each partition as compressed Arrow streams of ``most`` rows or a few more; :func:`opened` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= most or sum(x.nbytes for x in held) >= BLOB:
                yield _blob(held)
                held = []
        if held:
            yield _blob(held)

    return map_arrow(rows, run, "blob binary")


def _blob(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    whole = pa.Table.from_batches(batches).combine_chunks()  # else slices keep what they were cut from
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(whole)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["blob"])


def opened(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def stored(df: DataFrame) -> DataFrame:
    """:func:`cut` for wide rows: the files are compressed, by columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                yield from opened(blob).to_batches()

    return map_arrow(cut(packed(df, 1)), run, df.schema)
