"""Best-fit packing of tokenised documents into fixed-length sequences by exact-complement hashing.

Only the histogram of piece lengths decides how lengths are combined, and it has at most as many entries as a
sequence has tokens, whatever the corpus. The plan is made on it: pieces that fill a sequence alone first, then
pairs, triples and quadruples (the complement of a piece is looked up among single, pair and triple length sums)
until no such sum of the lengths left fills a sequence, then best fit, largest first, for the rest. Spark numbers the pieces of
each length and each takes the place that the plan has for its number.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, documents, portions

LIMIT = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
#: Texts are tokenised in slices of this many code points at most, cut where no token can span.
SLICE = 1 << 20

PACKED = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def tokenizer(name: str = VOCABULARY):
    """Two things that give the ids of a tokenizers file: what finds its added tokens, and the encoding of all else.

    The vocabulary's rank file has the same ids in a quarter of the time; a test holds them together. Added tokens,
    special or not, are found wherever their string is, as the tokenizer does that the file describes.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{name}: added tokens that take in what is around them are not supported")
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = {t["content"]: t["id"] for t in added}
    found = re.compile("|".join(re.escape(t) for t in sorted(own, key=len, reverse=True))) if own else None
    return found, own, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _plain_ids(text: str, encode: Callable[[str], list[int]]) -> Iterator[int]:
    at = 0
    while len(text) - at > SLICE:
        # A letter, then a space before a letter: the pattern always splits there.
        cut = next((i for i in range(at + SLICE, at, -1) if text[i] == " " and text[i - 1].isalpha() and text[i + 1 : i + 2].isalpha()), None)
        if cut is None:
            break
        yield from encode(text[at:cut])
        at = cut
    yield from encode(text[at:])


def token_ids(text: str, name: str = VOCABULARY) -> list[int]:
    """The ids of the whole text, without any that stand for its end."""
    found, added, encoding = tokenizer(name)
    ids, at = [], 0
    for match in found.finditer(text) if found else ():
        ids += [*_plain_ids(text[at : match.start()], encoding.encode_ordinary), added[match[0]]]
        at = match.end()
    ids += _plain_ids(text[at:], encoding.encode_ordinary)
    return ids


def piece_lengths(total: int, limit: int) -> list[int]:
    """Full pieces, the first one shorter if need be; one piece if total fits."""
    full, first = divmod(total, limit)
    return ([first] if first else []) + [limit] * full


def token_pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32[, ids]); copy tells rows of the same doc_id apart."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows, out = [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                ids, start = np.array([*token_ids(text, vocabulary), END], "<u4"), 0
                for piece, length in enumerate(piece_lengths(len(ids), limit)):
                    own = ids[start : start + length]
                    rows.append(k)
                    out.append((piece, start, length, zlib.crc32(own.tobytes()), *([own.astype("i4")] if with_ids else [])))
                    start += length
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = [pa.array([x[c] for x in out], kinds[c]) for c in range(len(names) - 2)]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(taken), batch["copy"].take(taken), *columns], names)

    return documents(docs).withColumn("copy", F.monotonically_increasing_id()).select("doc_id", "copy", "text").mapInArrow(cut, schema)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)], using up the histogram."""
    left = {n: c for n, c in histogram.items() if c}
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combination: tuple[int, ...], most: int | None = None) -> None:
        need = {n: combination.count(n) for n in combination}
        times = min(left.get(n, 0) // k for n, k in need.items())
        times = times if most is None else min(times, most)
        if times:
            out.append((combination, times))
            for n, k in need.items():
                left[n] -= k * times
                if not left[n]:
                    del left[n]

    take((limit,))
    for n in sorted(left, reverse=True):
        if n in left and limit - n in left:
            take((n, limit - n))
    # Sums of two lengths, hashed; a triple is a length and a pair, a quadruple two pairs.
    for n in sorted(left, reverse=True):
        for a in sorted((x for x in left if x <= n), reverse=True):
            if n not in left:
                break
            b = limit - n - a
            if a in left and 0 < b <= a and b in left:
                take(tuple(sorted((n, a, b), reverse=True)))

    def feasible(combination: tuple[int, ...]) -> bool:
        return all(left.get(n, 0) >= combination.count(n) for n in combination)

    def pairs(total: int) -> list[tuple[int, int]]:
        return [(a, total - a) for a in sorted((x for x in left if total <= 2 * x < 2 * total), reverse=True) if feasible((a, total - a))]

    # All pairs of a sum against all of its complement. Pairs of one sum have no length in common, so each try uses up
    # one of the two, but for the few that share lengths; what a piece lacks as a triple sum is such a pair of pairs.
    for total in range(limit - 2, (limit + 1) // 2 - 1, -1):
        seconds = pairs(limit - total)
        for first in pairs(total) if seconds else ():
            kept = []
            for at, second in enumerate(seconds):
                if not feasible(first):
                    kept += seconds[at:]
                    break
                take(tuple(sorted(first + second, reverse=True)))
                if feasible(second):
                    kept.append(second)
            seconds = kept
    # Best fit for what is left: each sequence takes the longest piece that still fits.
    while left:
        combination, gap = [], limit
        have = dict(left)
        for n in sorted(left, reverse=True):
            k = min(have[n], gap // n)
            combination += [n] * k
            gap -= n * k
            if gap <= 0:
                break
        take(tuple(combination))
    return out


def _places(combinations: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, numbers, first sequence, per sequence, offset of the first) for each run of places."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in combinations:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            each = lengths.count(n)
            rows.append((n, used[n], each * times, sequence, each, offset))
            used[n] += each * times
            offset += each * n
        sequence += times
    return rows


def packed(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty; an empty text is the end id alone. Texts of any length are read whole: only documents longer
    than limit are cut, the first piece being the shorter one. Equal lengths are placed in an arbitrary order. Rows that repeat a doc_id are packed each for itself. Offsets are
    gapless from 0 in each sequence; sequence ids are 0, 1, ... An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = token_pieces(docs, limit, vocabulary).withColumn("_part", F.spark_partition_id())
    pieces = scratch.table(cut.withColumn("_part", F.col("_part").cast("int")), "pieces")
    counts = pieces.groupBy("length", "_part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    places = spark.sparkContext.broadcast(np.array(_places(plan(histogram, limit)), np.int64).reshape(-1, 6))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The run of places that a piece's number is in, found by its place among the runs of all lengths.
        runs = places.value[np.lexsort((places.value[:, 1], places.value[:, 0]))]
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            wide = int(max(runs[:, 1].max(initial=0), number.max(initial=0))) + 1
            own = runs[np.searchsorted(runs[:, 0] * wide + runs[:, 1], length * wide + number, side="right") - 1]
            sequence, at = np.divmod(number - own[:, 1], own[:, 4])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in PACKED), pa.array(own[:, 3] + sequence), pa.array(own[:, 5] + at * length)], [*PACKED, "sequence_id", "offset"])

    numbered = _numbered(pieces, counts).select(*PACKED, "number")
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _numbered(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """pieces with their number (from 0) among those of the same length; no length meets in one task."""
    from pyspark.sql import Window

    before = counts.select("length", "_part", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("_part", "length").orderBy("doc_id", "copy", "piece")
    return pieces.withColumn("_at", F.row_number().over(within) - 1).join(before, ["length", "_part"]).withColumn("number", F.col("before") + F.col("_at"))
