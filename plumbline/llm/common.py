"""What the operators of this subpackage share: Arrow row functions and working tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.tables import cut, table

__all__ = ["ARROW", "SLICE_ROWS", "append_columns", "arrow_rows", "crc_mod", "cut", "emit_rows", "id_and_text", "numbered", "pack", "sift_rows", "slices", "table", "unpack"]

#: Rows handed to Python at once; a batch from Spark is cut into slices of so many.
SLICE_ROWS = 256

ARROW = {
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "ints": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "strings": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
}


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches of a partition in small slices, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def append_columns(
    df: DataFrame,
    inputs: str | Sequence[str],
    make: Callable[[], Callable[..., Sequence[list]]],
    fields: Sequence[tuple[str, str]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """``df`` with the columns ``fields`` = [(name, kind)], computed from the column or columns ``inputs``.

    ``make()`` runs once in each task and gives a function from the inputs as lists to one list for
    each field. Columns in ``drop`` don't come back from Python. No row is moved: the plan has one
    MapInArrow and no exchange.
    """
    names = df.columns
    at = [names.index(c) for c in ([inputs] if isinstance(inputs, str) else inputs)]
    kept = [i for i, n in enumerate(names) if n not in drop]
    schema = T.StructType([df.schema.fields[i] for i in kept] + [T.StructField(n, ARROW[k][0]) for n, k in fields])
    kinds = [ARROW[k][1] for _, k in fields]
    out_names = [names[i] for i in kept] + [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for part in slices(batches):
            cols = fn(*(part.column(i).to_pylist() for i in at))
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *arrays], out_names)

    return df.mapInArrow(run, schema)


def sift_rows(docs: DataFrame, make: Callable[[], Callable[[list], tuple[Sequence[bool] | None, Sequence | None]]], text_col="text") -> DataFrame:
    """Rows of ``docs`` with all their columns: ``make()`` gives a function from the texts of a slice to (which rows stay,
    their new texts), None for all or for the old ones. A text goes to Python once, and only rows that stay come back."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for part in slices(batches):
            stay, texts = fn(part.column(at).to_pylist())
            if texts is not None:
                columns = [part.column(i) if i != at else pa.array(texts, part.column(i).type) for i in range(len(names))]
                part = pa.RecordBatch.from_arrays(columns, names)
            yield part if stay is None else part.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def emit_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[Sequence]]],
    fields: Sequence[tuple[str, str]],
    finish: bool = False,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """New rows from each slice of ``df``; ``make()`` gives a function that yields tuples of columns.

    With ``finish`` that function is called once more with None at the end of the partition.
    """
    schema = T.StructType([T.StructField(n, ARROW[k][0]) for n, k in fields])
    kinds = [ARROW[k][1] for _, k in fields]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()

        def out(part):
            for cols in fn(part):
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

        for part in slices(batches, rows):
            yield from out(part)
        if finish:
            yield from out(None)

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text, as ``doc_id`` and ``text``: other columns never clash or get read."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: each as its bytes by place, which makes small numbers cheap."""
    out = [np.array([len(a) for a in arrays] + [a.dtype.itemsize for a in arrays], np.int64).tobytes()]
    out += [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw, k = zstandard.ZstdDecompressor().decompress(data), len(types)
    head = np.frombuffer(raw, np.int64, 2 * k)
    out, at = [], 16 * k
    for n, size, t in zip(head[:k].tolist(), head[k:].tolist(), types, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 2 * SLICE_ROWS, size: str = "4m"):
    """Jobs that run inside send so many rows or bytes to Python at once, which bounds the buffers on both sides."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def crc_mod(id_col, n: int):
    """crc32 of the identifier as text, modulo ``n``; a null identifier counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Bits of an identifier of Spark's that number the rows within a partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, keys: Sequence[Column], name: str, label: str) -> DataFrame:
    """``rows`` range-sorted by ``keys`` and written, with each row's place from 0 on as ``name``.

    The places within a partition come with the sort; what stands before a partition is a sum over the counts of partitions,
    of which there are as many as tasks. A hot key is split as far as ``keys`` tell its rows apart.
    """
    at, part, before = (f"{n}_{uuid.uuid4().hex}" for n in ("at", "part", "before"))
    rows = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), label)
    counts = rows.groupBy(F.shiftright(at, _ROW_BITS).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(part, F.coalesce(earlier, F.lit(0)).alias(before))
    out = rows.join(F.broadcast(counts), F.shiftright(at, _ROW_BITS) == F.col(part))
    return out.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop(at, part, before)
