"""Quality rules as a learned decision list.

Sequential covering: a rule grows by the threshold condition with the best information gain over the labelled rows
that no earlier rule covers, is pruned on rows kept apart, and joins the list if it is pure enough there. All counts
come from Spark aggregates over the labelled rows; only one row a feature and bin reaches the driver. The list is
emitted as ordered conditional expressions over columns, each readable as text.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import WORD, Scratch

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share"]

#: Learning: conditions a rule may have, rules a list may have, quantiles of each class that thresholds come from,
#: what a rule must reach on the rows kept apart, and one in how many rows is kept apart.
CONDITIONS, RULES, QUANTILES, PURITY, APART = 3, 8, 12, 0.9, 3
#: Labelled documents that the list is learned from, at most.
SAMPLE = 20_000


def _repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words of rows with their words as w: how many words are in a window that the text has twice or more."""
    last = F.size("w") - WINDOW
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW))))
    df = df.withColumn("_h", F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat nothing, and a set tells that at once; the others sort their windows.
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(placed)))
    twice = F.filter("_s", lambda x, k: F.coalesce((F.get("_s", k + 1)["h"] == x["h"]), F.lit(False)) | (k.cast("int") > 0) & F.coalesce(F.get("_s", F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("to"))
    count = F.aggregate("_p", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["to"])).alias("n"), i.alias("to")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(count, F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def _characters(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, where the row is, the base counts, and the counts that the learned rules look at besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    df = df.select(
        *keep, "w", F.size("w").cast("long").alias("n_words"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"),
        _characters(F.col("text"), r"\p{Lu}").alias("n_upper"), (F.char_length("text") - F.char_length(F.translate("text", "!?", ""))).cast("long").alias("n_marks"),
    )
    df = df.select("*", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct")).drop("lines")
    return _repeated(df).drop("w").select(*keep, *BASE, "n_lines", "n_upper", "n_marks", "n_distinct", F.spark_partition_id().alias("_at"))


def _only(df: DataFrame, condition: Column) -> DataFrame:
    """df where condition holds. Spark pushes no filter beneath columns that depend on where a row is, as _at does, so
    the words are counted once; pushed beneath, this one would split the text again for each of its words."""
    return df.filter(condition & (F.col("_at") >= 0))


def shares(df: DataFrame) -> DataFrame:
    """df of features with the columns of SHARES; a text without words has 0 in all."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")

    return df.withColumns(
        {
            "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars"), "mark_share": share("n_marks", "word_chars"), "distinct_share": share("n_distinct", "n_words"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _any(rules) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _all(r)
    return out


def learn(labelled: DataFrame, names: list[str] | None = None) -> list[Rule]:
    """The decision list for rows of (doc_id, bad, the columns of names): each rule covers rows to reject.

    No labels, or labels of one class only, give an empty list.
    """
    names = names or SHARES
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(APART)) == 0
    steps = [i / QUANTILES for i in range(QUANTILES)] + [0.98, 0.995, 1.0]
    cuts = labelled.groupBy("bad").agg(*(F.percentile_approx(n, steps, 10_000).alias(n) for n in names)).collect()
    if len(cuts) < 2:
        return []
    # Half way between the values seen, so that a rule keeps its distance from both classes.
    seen = {n: sorted({float(v) for row in cuts for v in row[n]}) for n in names}
    thresholds = {n: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for n, v in seen.items()}
    bins = F.array(*(F.struct(F.lit(n).alias("feature"), sum(((F.col(n) > t).cast("int") for t in thresholds[n]), F.lit(0)).alias("bin")) for n in names))

    rules: list[Rule] = []
    while len(rules) < RULES:
        left = labelled.filter(~_any(rules))
        rule: Rule = ()
        while len(rule) < CONDITIONS:
            counts = left.filter(~apart & _all(rule)).select("bad", F.explode(bins).alias("cell")).groupBy("cell.feature", "cell.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
            best = _best(counts, thresholds)
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        # Prune: the shortest beginning of the rule with the best worth on the rows kept apart.
        row = left.filter(apart).agg(*(F.struct(F.coalesce(F.sum(F.when(_all(rule[: k + 1]), F.col("bad"))), F.lit(0)), F.count_if(_all(rule[: k + 1]))) for k in range(len(rule)))).first()
        worth = [((p - (n - p)) / n if n else -1.0, (p + 1) / (n + 2)) for p, n in row]
        k = max(range(len(rule)), key=lambda i: (worth[i][0], -i))
        if worth[k][1] < PURITY and not (row[k][1] and row[k][0] == row[k][1]):
            break
        rules.append(rule[: k + 1])
    return rules


def _best(counts, thresholds: dict[str, list[float]]) -> Condition | None:
    """The condition with the most information gain, if any gains."""
    cells: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        cells.setdefault(r["feature"], {})[r["bin"]] = (r["bad"], r["n"])
    best, most = None, 1e-9
    for name, own in cells.items():
        bad, n = (sum(x[i] for x in own.values()) for i in (0, 1))
        if not bad or bad == n:
            return None
        below_bad = below = 0
        for i, t in enumerate(thresholds[name]):
            b, m = own.get(i, (0, 0))
            below_bad, below = below_bad + b, below + m
            for above, p, k in ((True, bad - below_bad, n - below), (False, below_bad, below)):
                if p and k < n:
                    gain = p * (log2(p / k) - log2(bad / n))
                    if gain > most:
                        best, most = Condition(name, above, t), gain
    return best


def emit(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that covers a row, else null."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        out = F.when(_all(rules[k]), F.lit(k)).otherwise(out)
    return out


def _teachers(scratch: Scratch, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, bad) of at most most labelled documents, those with the smallest hash of doc_id."""
    teach = labels.filter("quality is not null").select("doc_id", (1 - F.col("quality")).cast("long").alias("bad"))
    return scratch.table(teach.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(most), "teach")


def _learned(scratch: Scratch, counts: DataFrame, teach: DataFrame) -> list[Rule]:
    """The list learned from the counts of the documents that teach has."""
    rows = shares(counts.join(F.broadcast(teach), "doc_id")).filter(~base_failed())
    return learn(scratch.table(rows.select("doc_id", "bad", *SHARES), "labelled"))


def judged(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, kept, rule.

    rule is the text of the learned rule that rejects the row, else null; most bounds the labelled documents that the
    list is learned from. Null texts have no words and fail the base rules. Labels without a document, with a null
    quality, or of documents that fail the base rules teach nothing. Repeated labels count each; rows that repeat a
    doc_id are judged each for itself. The time that a text takes grows with its words (and their logarithm) and its
    words are in memory at once. An empty table gives an empty result. The counts are written before they are looked
    at, so any filter on the result meets them and never the texts.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.table(features(docs, ["doc_id"]).drop("_at"), "counts")
    rules = _learned(scratch, counts, _teachers(scratch, labels, most))
    texts = F.array(*(F.lit(" and ".join(map(str, r))) for r in rules)) if rules else F.array(F.lit(None).cast("string"))
    out = shares(counts).withColumns({"base_failed": base_failed(), "_rule": emit(rules)})
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("_rule").isNull()).alias("kept"), F.get(texts, F.col("_rule")).alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs that the base rules and the learned list keep, all columns kept. Texts are not shuffled. See judged."""
    scratch = Scratch(docs.sparkSession, "quality-kept")
    teach = _teachers(scratch, labels, most)
    seen = docs.select("doc_id", "text").join(F.broadcast(teach.select("doc_id").distinct()), "doc_id", "left_semi")
    rules = _learned(scratch, scratch.table(features(seen, ["doc_id"]).drop("_at"), "counts"), teach)
    rows = features(docs.select(F.struct(*docs.columns).alias("_row"), "text"), ["_row"])
    return _only(shares(rows), ~base_failed() & emit(rules).isNull()).select("_row.*")
