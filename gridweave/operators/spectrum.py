"""Fourier transforms of series of any length, as tables.

A series of n = n1 * n2 values is a matrix of n1 rows: its columns are transformed, turned by twiddle factors, and its
rows are transformed, with a shuffle of blocks in between. A task has about as many values as a chunk. Lengths that
are no product of two numbers below a chunk are transformed by chirps, as a convolution of a length that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.scalar import finite
from gridweave.operators.framed import positions
from gridweave.sources.scratch import written

#: Values that a task transforms, about.
CHUNK = 1 << 18

ROWS = "series string, n1 long, n2 long, pos long, re double, im double"
BLOCKS = "series string, n1 long, n2 long, band long, first long, re array<double>, im array<double>"


def factors(n: int, chunk: int) -> tuple[int, int] | None:
    """n as a product of two numbers of at most chunk, the second one as large as the first allows."""
    if n <= chunk:
        return n, 1
    small = next(d for d in range(isqrt(n), 0, -1) if n % d == 0)
    return (n // small, small) if n // small <= chunk else None


def fourier(rows: DataFrame, chunk: int = CHUNK, inverse: bool = False) -> DataFrame:
    """rows (series, n1, n2, pos, re, im) transformed; what is missing is 0, and pos is the frequency. The inverse isn't scaled."""
    sign = 1 if inverse else -1
    change = np.fft.fft if not inverse else (lambda x, axis: np.fft.ifft(x, axis=axis, norm="forward"))
    ones = lambda n: max(1, chunk // n)

    def columns(keys: tuple, table: pa.Table) -> Iterator[pa.Table]:
        series, n1, n2, block = (k.as_py() for k in keys)
        width = min(ones(n1), n2 - block * ones(n1))
        pos = table["pos"].to_numpy()
        x = np.zeros((n1, width), complex)
        x[pos // n2, pos % n2 - block * ones(n1)] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        x = change(x, axis=0)
        first = block * ones(n1)
        x *= np.exp(sign * 2j * np.pi / (n1 * n2) * (np.arange(n1)[:, None] * np.arange(first, first + width)[None, :] % (n1 * n2)))
        bands = range(0, n1, ones(n2))
        parts = [x[k : k + ones(n2)].ravel() for k in bands]
        return pa.table({
            "series": [series] * len(parts), "n1": [n1] * len(parts), "n2": [n2] * len(parts), "band": list(range(len(parts))), "first": [first] * len(parts),
            "re": pa.array([p.real for p in parts], pa.list_(pa.float64())), "im": pa.array([p.imag for p in parts], pa.list_(pa.float64())),
        })

    def bands(keys: tuple, table: pa.Table) -> pa.Table:
        series, n1, n2, band = (k.as_py() for k in keys)
        height = min(ones(n2), n1 - band * ones(n2))
        x = np.zeros((height, n2), complex)
        for first, re, im in zip(table["first"].to_pylist(), table["re"], table["im"], strict=True):
            part = re.values.to_numpy() + 1j * im.values.to_numpy()
            part = part.reshape(height, -1)
            x[:, first : first + part.shape[1]] = part
        x = change(x, axis=1)
        pos = (band * ones(n2) + np.arange(height))[:, None] + n1 * np.arange(n2)[None, :]
        m = pos.size
        return pa.table({"series": pa.array([series] * m, pa.string()), "n1": np.full(m, n1), "n2": np.full(m, n2), "pos": pos.ravel(), "re": x.real.ravel(), "im": x.imag.ravel()})

    by_column = rows.withColumn("block", F.floor(F.col("pos") % F.col("n2") / F.greatest(F.lit(1), F.floor(F.lit(chunk) / F.col("n1")))).cast("long"))
    blocks = by_column.groupBy("series", "n1", "n2", "block").applyInArrow(columns, BLOCKS)
    return blocks.groupBy("series", "n1", "n2", "band").applyInArrow(bands, ROWS)


def _sized(placed: DataFrame, chunk: int) -> DataFrame:
    """(series, n, n1, n2, m1, m2): the factors of each length, or those of the convolution that stands for it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n in batch["n"].to_pylist():
                own = factors(n, chunk) or (None, None)
                size = 1 << (2 * n - 1).bit_length()
                out.append((*own, *((None, None) if own[0] else factors(size, chunk))))
            yield pa.RecordBatch.from_arrays([batch["series"], batch["n"], *(pa.array([o[k] for o in out], pa.int64()) for k in range(4))], ["series", "n", "n1", "n2", "m1", "m2"])

    return placed.groupBy("series").agg(F.max("_n").alias("n")).mapInArrow(each, "series string, n long, n1 long, n2 long, m1 long, m2 long")


def _chirp(sign: int) -> tuple[Column, Column]:
    """Parts of exp(sign * i pi pos^2 / n); the square is taken modulo 2 n, so it is exact."""
    angle = F.lit(np.pi) * F.pmod(F.col("pos") * F.col("pos"), 2 * F.col("n")) / F.col("n")
    return F.cos(angle), sign * F.sin(angle)


def _by_chirps(rows: DataFrame, chunk: int) -> DataFrame:
    """Transforms of real rows (series, n, m1, m2, pos, re) of any length n, by a convolution of length m1 * m2."""
    cos, sin = _chirp(-1)
    own = [F.col("m1").alias("n1"), F.col("m2").alias("n2")]
    a = rows.select("series", *own, "pos", (F.col("re") * cos).alias("re"), (F.col("re") * sin).alias("im"))
    up, down = _chirp(1)
    size = F.col("m1") * F.col("m2")
    # The chirp is even; places before 0 are at the end.
    mirrored = F.explode(F.when(F.col("pos") == 0, F.array("pos")).otherwise(F.array(F.col("pos"), size - F.col("pos")))).alias("at")
    b = rows.select("series", *own, mirrored, up.alias("re"), down.alias("im")).withColumnRenamed("at", "pos")
    x, y = fourier(a, chunk), fourier(b, chunk).select("series", "pos", F.col("re").alias("c"), F.col("im").alias("d"))
    product = x.join(y, ["series", "pos"]).select("series", "n1", "n2", "pos", (F.col("re") * F.col("c") - F.col("im") * F.col("d")).alias("re"), (F.col("re") * F.col("d") + F.col("im") * F.col("c")).alias("im"))
    back = fourier(product, chunk, inverse=True).withColumn("size", F.col("n1") * F.col("n2")).join(rows.select("series", "n").distinct(), "series").filter("pos < n")
    return back.select("series", "n", "pos", ((F.col("re") * cos - F.col("im") * sin) / F.col("size")).alias("re"), ((F.col("re") * sin + F.col("im") * cos) / F.col("size")).alias("im"))


def spectrum(df: DataFrame, series: str, value: str, order: str, chunk: int = CHUNK) -> DataFrame:
    """(series, n, frequency, re, im) of each series: its discrete Fourier transform, frequencies 0 to n - 1.

    What is missing or not finite counts as 0. Rows of equal order follow each other in some order. chunk is a power
    of two; a series has at most chunk * chunk / 4 values.
    """
    rows = df.select(F.col(series).cast("string").alias("series"), F.col(order).alias("_o"), F.when(finite(F.col(value)), F.col(value).cast("double")).otherwise(0.0).alias("re"))
    placed = positions(rows, ["series"], ["_o"])
    sized = written(_sized(placed, chunk), "sizes")
    rows = placed.select("series", F.col("_pos").alias("pos"), "re").join(sized, "series")
    out = fourier(rows.filter("n1 is not null").select("series", "n1", "n2", "pos", "re", F.lit(0.0).alias("im")), chunk)
    out = out.select("series", (F.col("n1") * F.col("n2")).alias("n"), "pos", "re", "im")
    if not sized.filter("n1 is null").isEmpty():
        out = out.unionByName(_by_chirps(rows.filter("n1 is null").select("series", "n", "m1", "m2", "pos", "re"), chunk))
    return out.select(F.col("series").alias(series), "n", F.col("pos").alias("frequency"), "re", "im")


def dominant_periods(df: DataFrame, k: int, series: str, value: str, order: str, chunk: int = CHUNK) -> DataFrame:
    """(series, rank, period, amplitude): the k strongest periods of each series, its mean apart; of equal ones the longer first."""
    found = spectrum(df, series, value, order, chunk).filter((F.col("frequency") > 0) & (2 * F.col("frequency") <= F.col("n")))
    found = found.withColumn("amplitude", F.hypot("re", "im"))
    # Only the first k of a task are shuffled.
    place = F.row_number().over(Window.partitionBy(series).orderBy(F.desc("amplitude"), "frequency"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select(series, "rank", F.expr("cast(n div frequency as int)").alias("period"), "amplitude")
