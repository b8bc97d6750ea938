"""Mixing sources to target weights by Pareto order sampling.

A source is due target words. Each of its documents is taken as often as the target holds the whole source; these
copies are certain. Of the words still due, a document's share is drawn with an inclusion probability that grows with
its length (a power of its size); where that would be 1 or more the copy is certain, too, and the others'
probabilities are raised until the words expected are the words due. A document longer than all that is due has
probability 0. Among the others the random numbers decide: documents get the Pareto rank odds(u) / odds(p) of a random
number u that follows from the document, and the first ones in that order are taken while they fit in. One or two last
documents of each source round the sum: the longest that fits in what is then open, and the one nearest to what that
leaves. The cut in each source's order is found on sums over ever finer slices of the rank, so no source is sorted in
one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import SPACE, Scratch, attach

#: Fixed values of the mixing contract.
WEIGHTS = (5, 2, 1)
MOST = 3

SEED = 20240229
#: Inclusion probabilities are in proportion to this power of the size.
POWER = 0.5
#: Ranks have DIGIT * PASSES bits; each pass over a source's open slice looks at DIGIT more of them.
DIGIT, PASSES = 13, 4


def word_count(text: Column) -> Column:
    """Words of a text; null and white space have none."""
    # Once no space is at either end, there is one word more than there are runs of space.
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(SPACE)) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights repeat over the sources by code point, null last. No target is above most times its source's size; what
    that cuts off is shared by weight among the others, again and again until nothing is above.
    """
    # One row a source in one task: a catalogue of sources, not of documents.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights)).cast("int"))
    each = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("limit"))
    total, weigh = each.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    rate, capped = total / weigh, 0
    while True:
        full = F.col("limit") < F.col("weight") * rate
        limits, open_weight, n = each.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == capped or not open_weight:
            break
        rate, capped = (total - limits) / open_weight, n
    return each.select("source", "source_size", F.least("limit", F.col("weight") * rate).alias("target"))


def pareto_rank(p: Column, key: Column) -> Column:
    """Pareto rank of inclusion probability p and the random bits in key, as an integer that keeps the order."""
    u = (F.shiftrightunsigned(key, 11) + 0.5) * 2.0**-53
    rank = (u / (1 - u)) * (1 - p) / p
    top = 1 << DIGIT * PASSES
    return F.least(F.floor(rank / (1 + rank) * float(top)).cast("long"), F.lit(top - 1))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"_name": F.coalesce("source", F.lit("")), "_nameless": F.col("source").isNull()})


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", F.col("source").isNull(), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))


SOURCE = ["_name", "_nameless"]
ROUNDING = ["round0", "round1"]


def _variant(docs: DataFrame) -> Column:
    """The hash of a row's columns, but for maps, which have none: it tells rows apart that doc_id, source and text do not."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def _repeated(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(key, m) of the keys that m > 1 rows have: rows with the same doc_id, source and text."""
    return scratch.table(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "repeated")


def _told_apart(scratch: Scratch, rows: DataFrame, repeated: DataFrame, total: int, name: str) -> DataFrame:
    """rows with a key of their own for each: by their variant, and rows equal in all columns numbered in the parts they were read in."""
    if repeated.isEmpty():
        return rows
    several = attach(rows.withColumn("_part", F.spark_partition_id()), repeated, ["key"], "m", total).drop("m")
    several = scratch.table(several, f"{name}several")
    same = ["key", "variant"]
    counts = several.groupBy(*same, "_part").agg(F.count("*").alias("c"))
    counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*same).orderBy("_part")) - F.col("c")).drop("c")
    within = F.row_number().over(Window.partitionBy("_part", *same).orderBy("size"))
    numbered = several.withColumn("at", within).join(counts, [*same, "_part"]).withColumn("key", F.xxhash64(*same, F.col("before") + F.col("at")))
    return rows.join(repeated.hint("merge"), "key", "left_anti").select(*rows.columns).unionByName(numbered.select(*rows.columns))


def _chances(due: DataFrame, rows: DataFrame, power: float) -> DataFrame:
    """(source, top, c, aim) for sources that are due a rest: copies of more than top words are certain, the others have
    probability c * size ** power, and aim words are expected of these."""
    sizes = _named(rows).filter("size > 0").groupBy(*SOURCE, "size").agg(F.count("*").alias("m")).join(due.select(*SOURCE, "rest"), SOURCE).filter("size <= rest")
    # Rows of these windows are different sizes of documents, not documents.
    longer = Window.partitionBy(*SOURCE).orderBy(F.desc("size"))
    shorter = Window.partitionBy(*SOURCE).orderBy("size")
    sizes = sizes.withColumn("words", F.col("size") * F.col("m"))
    sizes = sizes.withColumns({"sure": F.sum("words").over(longer) - F.col("words"), "weighed": F.sum(F.pow("size", F.lit(power)) * F.col("words")).over(shorter)})
    c = (F.col("rest") - F.col("sure")) / F.col("weighed")
    fits = (F.col("rest") > F.col("sure")) & (c * F.pow("size", F.lit(power)) < 1)
    found = sizes.groupBy(*SOURCE).agg(F.max(F.when(fits, F.struct("size", c.alias("c"), "sure"))).alias("at"), F.sum("words").alias("words"), F.max("rest").alias("rest"))
    return found.select(*SOURCE, F.coalesce("at.size", F.lit(0)).alias("top"), "at.c", (F.col("rest") - F.coalesce("at.sure", "words")).alias("aim"))


def source_cuts(scratch: Scratch, rows: DataFrame, weights: tuple[int, ...], most: float, power: float) -> DataFrame:
    """One row a source of rows (source, size, key): what _copies looks at, n, source_size and target."""
    sums = scratch.table(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sums")
    aims = scratch.table(targets(sums.select("source", "source_size"), weights, most), "aims")
    due = _named(aims).join(_named(sums).select(*SOURCE, "n"), SOURCE)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = due.withColumn("whole", F.floor(each + 1e-9).cast("long")).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    due = scratch.table(due.select(*SOURCE, "n", "source_size", "target", "whole", "rest"), "due")
    chances = scratch.table(_chances(due, rows, power), "chances")
    cuts = due.join(chances, SOURCE, "left")
    total = rows.count()
    drawn = attach(_named(rows).select(*SOURCE, "size", "key"), cuts, SOURCE, "n", total).filter("size > 0 and size <= top")
    drawn = scratch.table(drawn.select(*SOURCE, "size", pareto_rank(_chance(power), F.col("key")).alias("rank"), F.col("aim").alias("due")), "drawn")
    cuts = scratch.table(cuts.join(_cut(scratch, drawn), SOURCE, "left").withColumn("open", F.coalesce("open", "aim", "rest")), "cut")
    # Documents that round the sum: the longest that fits in what is open, then the one nearest to what is open then.
    left = scratch.table(attach(_named(rows).select(*SOURCE, "size", "key"), cuts.filter("open > 0"), SOURCE, "n", total).filter(~_drawn(power) & (F.col("size") > 0)).select(*SOURCE, "size", "key"), "undrawn")
    for k, fits in enumerate((F.col("size") <= F.col("open"), F.col("size") < 2 * F.col("open"))):
        here = attach(left, cuts.select(*SOURCE, "n", "open", *ROUNDING[:k]), SOURCE, "n", total).filter(fits)
        for before in ROUNDING[:k]:
            here = here.filter(~F.coalesce(F.col("key") == F.col(before), F.lit(False)))
        nearest = here.groupBy(*SOURCE).agg(F.min_by(F.struct("key", "size"), F.struct(F.abs(F.col("size") - F.col("open")), "key")).alias("_near"))
        cuts = cuts.join(nearest, SOURCE, "left").withColumns({ROUNDING[k]: F.col("_near.key"), "open": F.col("open") - F.coalesce("_near.size", F.lit(0))}).drop("_near")
        cuts = scratch.table(cuts, f"cuts{k}")
    return cuts


def _cut(scratch: Scratch, inside: DataFrame) -> DataFrame:
    """For each source of rows (rank, size, due): the last rank taken and the words still open then."""
    over = Window.partitionBy(*SOURCE).orderBy("slice")
    for k in range(PASSES):
        shift = DIGIT * (PASSES - 1 - k)
        slices = inside.groupBy(*SOURCE, F.shiftright("rank", shift).alias("slice")).agg(F.sum("size").alias("words"), F.max("due").alias("due"))
        run = slices.withColumn("before", F.sum("words").over(over) - F.col("words"))
        if shift:
            # The slice in which the words due are reached, or the last one.
            hit = run.filter("before < due").groupBy(*SOURCE).agg(F.max_by(F.struct("slice", (F.col("due") - F.col("before")).alias("due")), "slice").alias("at"))
            hit = scratch.table(hit.select(*SOURCE, "at.*"), f"hit{k}")
            inside = inside.drop("due").withColumn("slice", F.shiftright("rank", shift)).join(hit, [*SOURCE, "slice"]).drop("slice")
            inside = scratch.table(inside, f"inside{k}")
        else:
            taken = F.col("before") + F.col("words") <= F.col("due")
            last = F.coalesce(F.max(F.when(taken, F.col("slice"))), F.min("slice") - 1).alias("last")
            still = (F.max("due") - F.coalesce(F.max(F.when(taken, F.col("before") + F.col("words"))), F.lit(0))).alias("open")
            return run.groupBy(*SOURCE).agg(last, still)


def _chance(power: float) -> Column:
    return F.col("c") * F.pow("size", F.lit(power))


def _drawn(power: float) -> Column:
    """Whether a row gets a copy beside the whole ones, for a certainty or by its rank."""
    ranked = F.when(F.col("size") <= F.col("top"), pareto_rank(_chance(power), F.col("key")) <= F.col("last")).otherwise(True)
    return F.coalesce((F.col("size") > 0) & (F.col("size") <= F.col("rest")) & F.col("top").isNotNull() & ranked, F.lit(False))


def _copies(power: float) -> Column:
    rounds = [F.coalesce(F.col("key") == F.col(r), F.lit(False)) for r in ROUNDING]
    return F.col("whole") + (_drawn(power) | rounds[0] | rounds[1]).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, power: float = POWER, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies.

    size counts the words of the whole text, null and empty ones having none, however long it is; taken is copies
    times size, and copies at most most rounded up. A null source is a source. A source without words has target 0.
    Reruns agree, as the random number of a row follows from seed, doc_id, source and text; rows equal in all of these
    are told apart by their other columns, or numbered, and drawn each for itself. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"), _variant(docs).alias("variant")), "sizes")
    total = rows.count()
    rows = _told_apart(scratch, rows, _repeated(scratch, rows), total, "")
    cuts = source_cuts(scratch, rows, weights, most, power)
    out = attach(_named(rows), cuts, SOURCE, "n", total).withColumn("copies", _copies(power))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, power: float = POWER, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, all columns kept. See mix."""
    scratch = Scratch(docs.sparkSession, "mixed")
    rows = scratch.table(docs.select("source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"), _variant(docs).alias("variant")), "sizes")
    total = rows.count()
    repeated = _repeated(scratch, rows)
    cuts = source_cuts(scratch, _told_apart(scratch, rows, repeated, total, ""), weights, most, power)
    wrapped = docs.select(F.struct(*docs.columns).alias("row"), "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"), _variant(docs).alias("variant"))
    wrapped = _told_apart(scratch, wrapped, repeated, total, "rows")
    out = attach(_named(wrapped), cuts, SOURCE, "n", total).withColumn("copies", _copies(power))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).filter("copies > 0").select("row.*")
