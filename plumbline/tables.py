"""Tables by name, and working tables in the cluster's shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Bytes of a row group of a working table.
ROW_GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out over all cores, by ``keys`` if given. A file of few bytes is read by one task, however much is made of its rows."""
    return df.repartition(max(2, 3 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset on one machine, as in tests, one under the warehouse.
    On a cluster it has to be set: the warehouse may be a local folder there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return at.rstrip("/")


def cut(df: DataFrame, name: str, folders: Sequence[str] = ()) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: a lost executor costs no recomputing. ``folders`` are columns by whose
    values the files lie in folders of their own, so that a filter on them reads only those."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # A writer holds a row group in memory, so row groups are kept small.
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES)
    (writer.partitionBy(*folders) if folders else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def group_starts(rows: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where each run of rows with equal keys begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = rows.column(key)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` as tables that hold whole groups: about a batch each, or a group where that is larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = group_starts(batch, keys)
        if held and any(batch.column(k)[0].as_py() != held[-1].column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(starts) > 1:
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            held = []
        held.append(batch.slice(starts[-1]))
    if held:
        yield pa.Table.from_batches(held)


def by_groups(df: DataFrame, keys: Sequence[str], run: Callable[[pa.Table], Iterator[pa.Table]], schema: str) -> DataFrame:
    """``run`` on tables of whole groups of ``keys``, many small ones or a large one at a time, so that a group costs no call of its own. Rows of
    a table are sorted by the keys."""
    out = StructType.fromDDL(schema)

    def each(batches):
        arrow = to_arrow_schema(out)
        for rows in _whole(batches, keys):
            for made in run(rows):
                yield from made.cast(arrow).to_batches(max_chunksize=1 << 17)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, out)
