"""Places, running sums and exact quantiles of a whole table in an order, without a task that has all rows.

Rows are dealt to ranges of all columns of the order together, so a value that most rows have is no range of its own as
long as a later column tells them apart. What is ordered is written once and read from there; what the ranges before
hold is one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.sources.scratch import written

#: Bits of monotonically_increasing_id() that number the rows of a partition.
ROW_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df in ranges of the order, nulls first, written: _range says which, _at the row's place in it, from 0."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    ids = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", ids)
    return written(placed.withColumns({"_range": F.shiftright("_id", ROW_BITS), "_at": F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)}).drop("_id"), "ranges")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with each row's number (from 0) in the order, ascending, nulls first; rows alike in the order are told apart by all columns."""
    rows = in_ranges(df.withColumn("_tie", F.xxhash64(*df.columns)), [*order, "_tie"])
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row a range
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before", "_tie")


def running(df: DataFrame, order: str, amount: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the sum of amount over the rows of smaller order in the group; order is unique in a group."""
    return _summed(in_ranges(df.withColumn("_x", amount), [*by, order]), order, "_x", name, by).drop("_x", "_range", "_at")


def _summed(rows: DataFrame, order: str, amount: str, name: str, by: Sequence[str]) -> DataFrame:
    """rows of in_ranges with the sum of amount before them in their group."""
    sums = rows.groupBy(*by, "_range").agg(F.sum(amount).alias("_s"))
    before = sums.select(*by, "_range", (F.sum("_s").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_s")).alias("_before"))  # at most one row a range and group
    own = F.sum(amount).over(Window.partitionBy(*by, "_range").orderBy(order)) - F.col(amount)
    return _joined(rows.withColumn("_own", own), before, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before")


def counted(df: DataFrame, values: dict[str, Column | str], by: Sequence[str] = ()) -> DataFrame:
    """(by, _value, _v, _n): how often each value occurs in each group, for several columns in one pass over df.

    Put in ranges and written, so whatever is asked of it reads df no more.
    """
    cells = [F.struct(F.lit(name).alias("_value"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("_v")) for name, c in values.items()]
    rows = df.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*").filter("_v is not null")
    return in_ranges(rows.groupBy(*by, "_value", "_v").agg(F.count("*").alias("_n")), [*by, "_value", "_v"])


def quantiles_of(counts: DataFrame, qs: dict[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, a column for each name of qs): of each group in counts the exact quantiles, on lines between neighbours, as arrays.

    Only the ranges that hold a quantile's place are put in order.
    """
    keys = [*by, "_value"]
    group = Window.partitionBy(*keys)  # at most one row a range and group
    sizes = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m"))
    sizes = sizes.withColumns({"_before": F.sum("_m").over(group.orderBy("_range")) - F.col("_m"), "_all": F.sum("_m").over(group)})
    places = F.array().cast("array<struct<k:int,up:int,at:bigint,part:double>>")
    for name, own in qs.items():
        cells = []
        for k, q in enumerate(own):
            place = F.lit(float(q)) * (F.col("_all") - 1)
            cells += [F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.ceil(place) if up else F.floor(place)).alias("at"), (place - F.floor(place)).alias("part")) for up in (0, 1)]
        places = F.when(F.col("_value") == name, F.array(*cells)).otherwise(places)
    wanted = sizes.withColumn("_w", F.explode(places)).filter((F.col("_w.at") >= F.col("_before")) & (F.col("_w.at") < F.col("_before") + F.col("_m")))
    wanted = wanted.groupBy(*keys, "_range").agg(F.max("_before").alias("_before"), F.collect_list("_w").alias("_w"))
    near = _joined(counts, wanted, [*keys, "_range"])
    near = near.withColumn("_until", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v")))
    hits = F.filter("_w", lambda w: (w["at"] >= F.col("_until") - F.col("_n")) & (w["at"] < F.col("_until")))
    found = near.select(*keys, "_v", F.explode(hits).alias("_w"))
    at = lambda up: F.max(F.when(F.col("_w.up") == up, F.col("_v")))
    each = found.groupBy(*keys, F.col("_w.k").alias("_k")).agg(at(0).alias("_a"), at(1).alias("_b"), F.max("_w.part").alias("_part"))
    cell = F.struct("_k", (F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias("_q"))
    column = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("_value") == name, cell))), lambda x: x["_q"])
    return each.groupBy(*by).agg(*(column(name).alias(name) for name in qs))


def quantiles(df: DataFrame, value: Column | str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q): for each group with a value its exact quantiles qs as an array. df is read once."""
    return quantiles_of(counted(df, {"q": value}, by), {"q": qs}, by)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; right has a row a key."""
    renamed = right.select(*(F.col(c).alias(f"{c}_of") if c in keys else F.col(c) for c in right.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return left.join(renamed, same, how).drop(*(f"{k}_of" for k in keys))


def with_quantiles(df: DataFrame, value: Column | str, qs: dict[str, float], by: Sequence[str], of: DataFrame | None = None) -> DataFrame:
    """df with the group's quantiles of value, by name; of, if given, has the rows they are taken from."""
    q = quantiles(df if of is None else of, value, list(qs.values()), by)
    named = q.select(*by, *(F.get("q", F.lit(k)).alias(name) for k, name in enumerate(qs)))
    return _joined(df, named, list(by), "left") if by else df.crossJoin(F.broadcast(named))  # one row
