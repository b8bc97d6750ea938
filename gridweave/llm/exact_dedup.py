"""Exact dedup by deterministic block naming.

A text, its white space normalised, is cut into fixed-size blocks. Distinct blocks are sorted and get their
position as an integer name; then adjacent pairs of names are sorted and named in turn, until each document
has one name. Documents have the same (level, name) exactly if their texts are equal: names are given out by
sorting what they stand for, so there is no collision to fear.

Blocks are sorted by (xxhash64, block), so a block's text has to travel only once, to count the different
blocks of each hash. Where a hash has one block (always, in practice) the hash alone carries the sort;
otherwise the blocks concerned are sorted by their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import SPACE, Scratch, attach, union_all

BLOCK = 4096
#: Stands for the missing half of an odd pair; no name is that small.
NONE = -(1 << 62)


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _blocks(norm: Column, size: int) -> Column:
    cut = F.regexp_extract_all(norm, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.when(norm == "", F.array(F.lit(""))).otherwise(cut)


def name_texts(scratch: Scratch, rows: DataFrame, block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(rid, level, name) for rows of (rid, norm): equal texts, and only they, share level and name.

    rid must be unique and rows stable over reruns. hashed orders the blocks; any function will do.
    """
    cut = rows.select("rid", F.posexplode(_blocks(F.col("norm"), block)).alias("pos", "block")).select("rid", "pos", hashed(F.col("block")).alias("h"), "block")
    pairs = cut.groupBy("h", "block").agg(F.count("*").alias("n"))
    by_hash = scratch.table(pairs.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("different")).orderBy("h").withColumn("name", F.monotonically_increasing_id()), "hashes")
    total = by_hash.agg(F.sum("n")).first()[0] or 0
    level = scratch.table(attach(cut.select("rid", "pos", "h"), by_hash.filter("different = 1").select("h", "name", "n"), ["h"], "n", total).select("rid", "pos", "name"), "level0")
    if not by_hash.filter("different > 1").isEmpty():
        shared = by_hash.filter("different > 1").select("h")
        tied = scratch.table(pairs.join(shared, "h", "left_semi").orderBy("h", "block").withColumn("name", -1 - F.monotonically_increasing_id()), "tied")
        named = attach(cut.join(shared, "h", "left_semi"), tied, ["h", "block"], "n", total).select("rid", "pos", "name")
        level = scratch.table(level.unionByName(named), "level0all")

    done, k = [], 0
    while True:
        lengths = level.groupBy("rid").agg(F.max("pos").alias("last"), F.max("name").alias("name"))
        done.append(lengths.filter("last = 0").select("rid", F.lit(k).alias("level"), "name"))
        open_rows = level.join(lengths.filter("last > 0").select("rid"), "rid", "left_semi")
        k += 1
        joined = open_rows.groupBy("rid", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b")
        )
        joined = scratch.table(joined, f"pairs{k}")
        n = joined.count()
        if not n:
            break
        names = scratch.table(joined.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy("a", "b").withColumn("name", F.monotonically_increasing_id()), f"names{k}")
        level = scratch.table(attach(joined, names, ["a", "b"], "n", n).select("rid", "pos", "name"), f"level{k}")
        scratch.drop(f"pairs{k}", f"names{k}")
    return union_all(done)


def exact_groups(docs: DataFrame, block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after normalising white space; null counts as empty, and all empty texts
    are one group. Of a group the row with the smallest doc_id stays; a null doc_id comes after all others,
    and of rows with the same doc_id and equal texts one stays. keep_id is null only if every doc_id of the
    group is. An empty table gives an empty result; columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    # Row numbers must not change when a task is run again: they are written with the rows they name.
    rows = scratch.table(norm.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm"), "rows")
    names = scratch.table(name_texts(scratch, rows.select("rid", "norm"), block, hashed).join(rows.select("rid", "doc_id", "sha"), "rid"), "named")
    scratch.drop("rows")
    least = F.min_by(F.struct("doc_id", "rid"), F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
    groups = scratch.table(names.groupBy("level", "name").agg(least.alias("least"), F.count("*").alias("group_size")), "groups")
    out = attach(names, groups, ["level", "name"], "group_size", names.count())
    return out.select("doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("least.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without later copies, all columns kept; what stays is told by exact_groups. Rows that repeat a doc_id with
    an equal text are copies, too: one of them stays. Columns may have any names."""
    scratch = Scratch(docs.sparkSession, "exact-kept")
    stays = scratch.table(exact_groups(docs, block).filter("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")), "kept")
    # The user's columns are out of the way in a struct.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("own_sha"))
    out = rows.join(stays, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha")), "left_semi")
    repeated = scratch.table(docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    if repeated.isEmpty():
        return out.select("row.*")
    # A doc_id that very many rows have is a hot key.
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    marked = attach(out.withColumn("key", name("own_id")), repeated.select(name("id").alias("key"), "n"), ["key"], "n", docs.count(), "left")
    once = marked.filter("n is not null").groupBy("key", "own_sha").agg(F.any_value("row").alias("row"))
    return marked.filter("n is null").select("row").unionByName(once.select("row")).select("row.*")
