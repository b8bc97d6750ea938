"""Toxicity by weak supervision.

Lexicons are drawn from labelled documents: words and word beginnings that toxic ones have far more often. Each
lexicon is a voter, and so are patterns: of the text, and of how many entries of the lexicons it has, in all and for
its length. A generative label model sees the votes alone, no label: it estimates how accurate each voter is, the rates
at which it speaks up on toxic and on clean documents, and which voters are correlated beyond that, as a tree in which
a voter's rates depend on one other vote. Its posteriors are the labels of a linear classifier over the lexicon entries
and the votes, which scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, documents, portions

#: Held-out documents: those whose crc32(doc_id) has this remainder 0.
FOLDS = 5
#: Labelled documents to learn from, at most; entries of all lexicons together, at most; lexicon voters of words and
#: of word beginnings, each; toxic documents that an entry must be in, as a number and as a share; its least log odds.
SAMPLE, ENTRIES, LEXICONS, SUPPORT, SHARE, ODDS = 20_000, 600, 16, 3, 0.015, 3.0
STRENGTHS = 4
#: Lengths of word beginnings, and what marks them.
STEMS, STEM = (4, 5), "^"
#: Pattern voters: a pattern, and how many matches a hundred words make it speak up.
PATTERNS = ((r"!", 2.0), (r"\b\p{Lu}{3,}\b", 10.0), (r"[!?]{2,}", 1.0), (r"(?i)\byou\b", 3.0), (r"\p{So}|[#*$%&@]", 5.0), (r"https?://|@\w", 1.0))
#: A text of more words than these has each word by chance more easily.
LENGTHS = (50, 200, 500, 1000, 2000, 5000)
#: Numbers of entries, and entries a hundred words, that are voters from there on; few for the length, below these.
HITS, RATES, SPARSE = (2, 3, 5), (0.1, 0.4, 1.6), (0.05, 0.2)
#: Posteriors that the label model begins with for texts with no, one, and more entries.
BEGIN = (0.02, 0.2, 0.9)
#: Label model: rounds, mutual information (nats) from which a voter hangs on another, rows that a rate begins with.
ROUNDS, LINKED, ROWS = 10, 0.0005, 2.0
#: Classifier: ridge, Newton steps.
RIDGE, STEPS = 1.0, 15

LETTERS = r"[^\p{L}]+"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document, word) numbers of the distinct words of each document, and the words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), LETTERS)
    flat = lists.flatten().dictionary_encode()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    words = flat.dictionary.to_pylist()
    pairs = np.unique(owner.astype(np.int64) * max(len(words), 1) + flat.indices.to_numpy())
    return pairs // max(len(words), 1), pairs % max(len(words), 1), words


def _entries(word: str) -> list[str]:
    return [word, *(STEM + word[:k] for k in STEMS if len(word) >= k)] if len(word) > 2 else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, toxic, n): documents of the batch that have the entry, and toxic ones among them."""
    for batch in portions(batches):
        document, word, words = _tokens(batch["text"])
        toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
        names: dict[str, int] = {}
        of_word = [[names.setdefault(e, len(names)) for e in _entries(w)] for w in words]
        spread = np.array([len(x) for x in of_word], np.int64)[word]
        entry = np.fromiter((e for w in word for e in of_word[w]), np.int64, int(spread.sum()))
        both = np.unique(np.repeat(document, spread) * max(len(names), 1) + entry)
        document, entry = both // max(len(names), 1), both % max(len(names), 1)
        n = np.bincount(entry, minlength=len(names))
        bad = np.bincount(entry, weights=toxic[document], minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(bad), pa.array(n)], ["entry", "toxic", "n"])


def _matches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text whether each pattern speaks up and whether it is longer than each length; and its words."""
    texts = texts.cast(pa.large_string())
    words = pc.add(pc.count_substring_regex(texts, LETTERS), 1).to_numpy(zero_copy_only=False)
    counts = [pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p, _ in PATTERNS]
    found = [c * 100.0 / words >= least for c, (_, least) in zip(counts, PATTERNS, strict=True)]
    return np.array([*found, *(words > n for n in LENGTHS)], bool).T.reshape(len(texts), len(PATTERNS) + len(LENGTHS)), words


def _present(texts: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(document, entry) pairs of the entries that each text has."""
    document, word, words = _tokens(texts)
    of_word = [[index[e] for e in _entries(w) if e in index] for w in words]
    spread = np.array([len(x) for x in of_word], np.int64)
    some = spread[word] > 0 if len(word) else np.zeros(0, bool)
    document, word = document[some], word[some]
    entry = np.fromiter((e for w in word for e in of_word[w]), np.int64, int(spread[word].sum()) if len(word) else 0)
    both = np.unique(np.repeat(document, spread[word]) * max(len(index), 1) + entry) if len(word) else np.zeros(0, np.int64)
    return both // max(len(index), 1), both % max(len(index), 1)


def _votes(rows: np.ndarray, entries: np.ndarray, matches: np.ndarray, words: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes of lexicons, numbers of entries and patterns, then lengths, which are no voters; and the numbers of entries."""
    lexicons = np.zeros((len(matches), 2 * LEXICONS), bool)
    lexicons[rows, lexicon[entries]] = True
    hits = np.bincount(rows, minlength=len(matches))
    rate = hits * 100.0 / words
    own = [hits == 0, hits == 1, *(hits >= n for n in HITS), *(rate >= r for r in RATES), (hits > 0) & (rate < SPARSE[0]), (rate >= SPARSE[0]) & (rate < SPARSE[1])]
    return np.column_stack([lexicons, *own, matches]), hits


def _tree(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each voter the one that it hangs on, or -1: the spanning forest of most mutual information given the class."""
    n, width = votes.shape
    shared = np.zeros((width, width))
    for weight in (q, 1 - q):
        total = weight.sum()
        both = ((votes * weight[:, None]).T @ votes + 0.25) / (total + 1)
        one = (votes.T @ weight + 0.5) / (total + 1)
        a, b = one[:, None], one[None, :]
        for joint, apart in ((both, a * b), (a - both, a * (1 - b)), (b - both, (1 - a) * b), (1 - a - b + both, (1 - a) * (1 - b))):
            joint = joint.clip(1e-9, 1)
            shared += total / n * joint * np.log(joint / apart)
    np.fill_diagonal(shared, 0)
    parent, best, source = np.full(width, -1), shared[0].copy(), np.zeros(width, np.int64)
    inside = np.zeros(width, bool)
    inside[0] = True
    for _ in range(width - 1):
        k = int(np.argmax(np.where(inside, -1, best)))
        if best[k] > LINKED:
            parent[k] = source[k]
        inside[k] = True
        better = shared[k] > best
        best[better], source[better] = shared[k][better], k
    return parent


def label_model(votes: np.ndarray, q: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the class 1, begun with q, from votes alone; the voters' rates; and what each voter hangs on.

    Expectation maximisation of a latent class on which all votes depend, each besides on the vote of its parent in a
    tree that is found anew each round. rates[c, a, j] is how often voter j speaks up in class c where its parent's vote
    is a; a voter without parent has its rate at a = 0.
    """
    votes = votes.astype(float)
    n, width = votes.shape
    for _ in range(rounds):
        prior = (q.sum() + 1) / (n + 2)
        parent = _tree(votes, q)
        above = np.where(parent >= 0, votes[:, parent.clip(0)], 0)
        rates = np.zeros((2, 2, width))
        for c, weight in enumerate((1 - q, q)):
            alone = (votes.T @ weight + 0.1) / (weight.sum() + 0.2)
            for a in (0, 1):
                own = weight[:, None] * (above == a)
                rates[c, a] = ((votes * own).sum(0) + ROWS * alone) / (own.sum(0) + ROWS)
        odds = np.full(n, np.log(prior / (1 - prior)))
        for a in (0, 1):
            spoke, silent = np.log(rates[1, a] / rates[0, a]), np.log((1 - rates[1, a]) / (1 - rates[0, a]))
            odds += ((above == a) * np.where(votes > 0, spoke, silent)).sum(1)
        q = 1 / (1 + np.exp(-odds.clip(-30, 30)))
    return q, rates, parent


def _fit(rows: np.ndarray, columns: np.ndarray, n: int, width: int, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels over 0/1 features, by Newton steps."""
    x = np.zeros((n, width + 1), np.float32)
    x[rows, columns] = 1
    x[:, -1] = 1
    ridge = np.full(width + 1, RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(width + 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        slope = x.T @ (p - target) + ridge * w
        curve = (x * (p * (1 - p)).astype(np.float32)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve.astype(float), slope)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
    return w[:-1], float(w[-1])


@dataclass
class Model:
    index: dict[str, int]
    lexicon: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, entries = _present(texts, self.index)
        votes, _ = _votes(rows, entries, *_matches(texts), self.lexicon)
        z = self.bias + np.bincount(rows, weights=self.weights[entries], minlength=len(texts)) + votes @ self.weights[len(self.index) :]
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def learned(scratch: Scratch, docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents outside the held-out fold, SAMPLE of them at most.

    Labels choose the entries of the lexicons and nothing else: the label model and the classifier never see them.
    """
    teach = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    teach = scratch.table(teach.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE), "teach")
    sample = scratch.table(documents(docs).join(F.broadcast(teach), "doc_id").select("text", "toxic"), "sample")
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = sample.mapInArrow(_count, "entry string, toxic long, n long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    odds = F.log((F.col("toxic") + 0.5) / (bad - F.col("toxic") + 0.5)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n - bad - F.col("n") + F.col("toxic") + 0.5))
    chosen = counts.filter(F.col("toxic") >= max(SUPPORT, SHARE * bad)).withColumn("odds", odds).filter(F.col("odds") >= ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "entry").limit(ENTRIES)
    found = chosen.select("entry", "odds").collect()
    entries = [r["entry"] for r in found]
    index = {e: k for k, e in enumerate(entries)}
    # Lexicons of like strength, and several of each, so that a second entry of a text is a second vote.
    strength = np.argsort(np.argsort([-r["odds"] for r in found], kind="stable")) * STRENGTHS // max(len(found), 1)
    spread = np.array([zlib.crc32(e.encode()) % (LEXICONS // STRENGTHS) for e in entries], np.int64)
    lexicon = strength * (LEXICONS // STRENGTHS) + spread + LEXICONS * np.array([e.startswith(STEM) for e in entries], np.int64)
    lexicon = lexicon.astype(np.int64)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows, own = _present(batch["text"], index)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            matches, words = _matches(batch["text"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(own)), pa.array(list(matches), pa.list_(pa.bool_())), pa.array(words, pa.int64())], ["entries", "matches", "words"])

    taught = sample.select("text").mapInArrow(seen, "entries array<long>, matches array<boolean>, words long").toPandas()  # SAMPLE rows at most
    rows = np.repeat(np.arange(len(taught)), [len(x) for x in taught["entries"]])
    own = np.concatenate([np.asarray(x, np.int64) for x in taught["entries"]]) if len(rows) else np.zeros(0, np.int64)
    matches = np.array([np.asarray(x, bool) for x in taught["matches"]]).reshape(len(taught), len(PATTERNS) + len(LENGTHS))
    votes, hits = _votes(rows, own, matches, taught["words"].to_numpy(), lexicon)
    width = len(entries) + votes.shape[1]
    if not bad or bad == n:
        return Model(index, lexicon, np.zeros(width), -20.0 if not bad else 20.0)
    q, *_ = label_model(votes[:, : -len(LENGTHS)], np.array(BEGIN)[hits.clip(max=2)])
    vr, vc = np.nonzero(votes)
    w, b = _fit(np.concatenate([rows, vr]), np.concatenate([own, vc + len(entries)]), len(taught), width, q)
    return Model(index, lexicon, w, b)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Only text decides the score, all of it, however long. Null texts are empty and score like any text without a word
    of the lexicons. A null
    doc_id is not held out. Labels that are null or have no document teach nothing, repeated ones count each; without
    labels of both classes all documents get the class there is, or 0. An empty table gives an empty result.
    """
    model = learned(Scratch(docs.sparkSession, "toxic"), docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(model.scores(batch["text"]))], ["doc_id", "held_out", "score"])

    rows = documents(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
