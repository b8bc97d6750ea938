"""Windows over series of any length: rows are numbered in ranges, cut in chunks with halos, and only core rows are kept.

No task has more of a series than a chunk and its halo, and what comes out does not depend on the size of the chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridweave.operators.order import _joined, in_ranges

#: Rows of a series in a chunk.
CHUNK = 1 << 16


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with each row's place in its series (_pos, from 0) and the rows of the series (_n); written.

    Nulls of the order come first; rows alike in it are told apart by all columns.
    """
    rows = in_ranges(df.withColumn("_tie", F.xxhash64(*df.columns)), [*by, *order, "_tie"])
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_m"), F.min("_at").alias("_first"))
    series = Window.partitionBy(*by)  # one row a range and series
    before = counts.select(*by, "_range", "_first", (F.sum("_m").over(series.orderBy("_range")) - F.col("_m")).alias("_before"), F.sum("_m").over(series).alias("_n"))
    return _joined(rows, before, [*by, "_range"]).withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_first", "_before", "_tie")


def framed(df: DataFrame, by: Sequence[str], order: Sequence[str], back: int, ahead: int, columns: Callable[[WindowSpec], dict[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """df with columns, made from a window over the series in its order, of which they look back and ahead so many rows at most.

    They may use _pos and _n; the window has rows before a series' begin or after its end as little as a window over
    the whole series has. _pos, _n and the chunk (_chunk) stay.
    """
    rows = positions(df, by, order)
    first = F.floor((F.col("_pos") - ahead) / chunk)
    spread = rows.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(F.floor((F.col("_pos") + back) / chunk), F.floor((F.col("_n") - 1) / chunk)))))
    window = Window.partitionBy(*by, "_chunk").orderBy("_pos")
    return spread.withColumns(columns(window)).filter(F.floor(F.col("_pos") / chunk) == F.col("_chunk"))


def summed(rows: DataFrame, by: Sequence[str], amount: Column, name: str) -> DataFrame:
    """rows of framed() with the sum of amount over the series up to them, themselves included.

    Chunks are summed, their sums run, and each row adds what its chunk has before it.
    """
    rows = rows.withColumn("_x", amount)
    sums = rows.groupBy(*by, "_chunk").agg(F.sum("_x").alias("_s"))
    before = sums.select(*by, "_chunk", (F.sum("_s").over(Window.partitionBy(*by).orderBy("_chunk")) - F.col("_s")).alias("_before"))  # one row a chunk
    own = rows.withColumn("_own", F.sum("_x").over(Window.partitionBy(*by, "_chunk").orderBy("_pos")))
    return _joined(own, before, [*by, "_chunk"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_x", "_own", "_before")


def plain(rows: DataFrame) -> DataFrame:
    """rows of framed() without the columns that it has added."""
    return rows.drop("_pos", "_n", "_chunk")
