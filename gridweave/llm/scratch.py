"""Tables in the shared folder, joins that stand hot keys, and word classes used by several operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the query contracts: what separates words, and what words are made of.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Groups above 1/HOT of all rows are joined by broadcast; there are fewer than HOT of them.
HOT = 1000

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="spark-gridweave-"))
        root = _own_root[0]
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Parquet tables that cut lineage. What a returned DataFrame reads stays until release() or the driver's Python ends."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            pass


def release() -> None:
    """Deletes all scratch tables made so far: for long sessions, once what the operators returned has been written."""
    while Scratch.made:
        Scratch.made.pop().close()


atexit.register(release)


def attach(left: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join of left with one row a key, where keys may be hot; inner, or left where some keys have no row.

    groups has the number of left rows of each key in column size, total is the number of all left rows.
    Keys with more than total / HOT rows are fewer than HOT, so they are broadcast; the others are small
    and shuffle. No key meets in one task, whatever its size.
    """
    bound = max(total // HOT, 1)
    hot, cold = groups.filter(F.col(size) > bound), groups.filter(F.col(size) <= bound)
    near = left.join(F.broadcast(hot), keys)
    far = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most most bytes of text, or of one row: what a task holds at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + most, side="right")))
            # A copy: texts that begin within a buffer are lost when they are made large_string and then lower case.
            yield batch if end - begin == batch.num_rows else batch.take(pa.array(np.arange(begin, end)))
            begin = end


def split_bytes(texts: pa.Array, clean: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The text that each word is in and the words, dictionary encoded; clean makes spaces of the bytes that are in no word."""
    texts = texts.cast(pa.large_string())
    validity, ends, data = texts.buffers()
    data = pa.py_buffer(clean(np.frombuffer(data, np.uint8)) if data is not None and data.size else b"")
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [validity, ends, data], offset=texts.offset))
    owner, words = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    return owner[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, column: str | None = None, most: int = 0) -> Iterator[pa.Table]:
    """Rows that come sorted by integer keys, in tables of whole groups: of at most rows rows and most bytes in column, or of one group."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held)
        columns = [table[k].to_numpy() for k in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        ends = np.append(starts, table.num_rows) if last else starts
        weight = np.cumsum(pc.binary_length(table[column]).to_numpy()) if column else None
        begin = 0
        while begin < len(ends):
            at = ends[begin - 1] if begin else 0
            end = np.searchsorted(ends, at + rows, side="right")
            if column:
                end = min(end, np.searchsorted(weight[ends - 1], (weight[at - 1] if at else 0) + most, side="right"))
            end = max(begin + 1, int(end))
            yield table.slice(at, ends[end - 1] - at)
            begin = end
        held[:] = [] if last else table.slice(starts[-1] if len(starts) else 0).to_batches()

    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield from cut(False)
            n = 0
    if held:
        yield from cut(True)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text of any table that has them, null texts as empty ones."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
