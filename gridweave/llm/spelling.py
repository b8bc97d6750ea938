r"""Spelling variant grouping with Bloom-guided neighbourhoods.

Words are near if one inserted, deleted or replaced code point makes one of the other. Of each word the deletions, and the
replacements by a later letter, are generated as hashes: insertions and replacements by an earlier letter are what the
other word generates. Each hash is looked up in a blocked Bloom filter of the words of its length; only what the filter
knows is spelt out and joined with the vocabulary on the word itself, so false positives go and every near pair is found
once. The filters of a broadcast have at most FILTER_BYTES; a larger vocabulary is looked up in several rounds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import GAMMA, MIX_B, _mix
from .scratch import Scratch, documents, portions, split_bytes, whole_groups

#: Fixed values of the contract: of what hashes a letter is lost, how long and frequent words are, and by how much a form is more frequent.
LOSS, LEAST, TIMES, RATIO = 31, 7, 2, 10
#: Blocks of 64 bits: so many bits a word, of which so many are set; blocks in a slice of a filter; bytes of filters in a broadcast.
BITS, SET, SLICE, FILTER_BYTES = 24, 5, 1 << 12, 64 << 20
#: Longer words share a shard.
SHARD = 64
#: Words that a task counts before it sums, words that a task looks up, and hashes it makes at a time.
HELD, PART, EDITS = 1 << 20, 20_000, 1 << 19

#: Bytes of UTF-8 as the contract's words have them: A-Z as a-z. U+00C0 to U+00FF are the byte 0xC3 and one more.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b == 0xC3 for b in range(256)])


def _letters(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes, spaces for all that is no letter."""
    keep = LETTER[data]
    keep[1:] |= data[:-1] == 0xC3
    return np.where(keep, LOWER[data], 32).astype(np.uint8)


@lru_cache
def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


@lru_cache(4096)
def _shift(n: int) -> np.ndarray:
    """What each bit of a checksum becomes when n bytes follow; checksums are linear in their bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n):
        bits = (bits >> 8) ^ _crc_table()[bits & 0xFF]
    return bits


def joined_crc(first: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """[k, i]: the checksum first[i] moved by sizes[k] bytes; its XOR with that of so many bytes is the checksum of both."""
    out = np.zeros((len(sizes), len(first)), np.uint32)
    for k, n in enumerate(sizes):
        for bit, value in enumerate(_shift(int(n))):
            out[k] ^= np.where(first >> np.uint32(bit) & 1, value, np.uint32(0))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words that are long enough, some letters lost."""
    held: list[pa.Table] = []

    def summed() -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        held.clear()
        yield from table.select(["word", "n_sum"]).rename_columns(["word", "n"]).cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()

    for batch in portions(batches):
        owner, codes = split_bytes(batch["text"], _letters)
        words = codes.dictionary
        code = codes.indices.to_numpy().astype(np.int64)
        if not len(code):
            continue
        sizes, size_code = np.unique(pc.binary_length(words).to_numpy().astype(np.int64), return_inverse=True)
        length = pc.utf8_length(words).to_numpy().astype(np.int64)
        crc = np.array([zlib.crc32(w.as_buffer()) for w in words], np.uint32)
        heads = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch["doc_id"].to_pylist()], np.uint32)
        h = joined_crc(heads, sizes)[size_code[code], owner] ^ crc[code]
        lost = h % LOSS == 0
        whole = np.bincount(code[~lost], minlength=len(words))
        some = np.flatnonzero((whole > 0) & (length >= LEAST))
        held.append(pa.table({"word": words.take(pa.array(some)).cast(pa.string()), "n": pa.array(whole[some], pa.int64())}))
        lost &= length[code] > LEAST
        wide = int(length.max()) + 1
        pairs, times = np.unique(code[lost] * wide + h[lost] % length[code[lost]], return_counts=True)
        which, at = np.divmod(pairs, wide)
        cut = [w[:k] + w[k + 1 :] for w, k in zip(words.take(pa.array(which)).to_pylist(), at.tolist(), strict=True)]
        held.append(pa.table({"word": pa.array(cut, pa.string()), "n": pa.array(times, pa.int64())}))
        if sum(t.num_rows for t in held) > HELD:
            yield from summed()
    if held:
        yield from summed()


def _places(n: int) -> np.ndarray:
    """An odd factor for each place of a word."""
    with np.errstate(over="ignore"):
        return _mix(GAMMA * np.arange(1, n + 1, dtype="u8")) | np.uint64(1)


def _salt(length: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return np.uint64(length) * MIX_B


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and code points (a row a word) of the words of each length."""
    length = np.array([len(w) for w in words], np.int64)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        yield n, at, np.array([words[k] for k in at], f"<U{n}").view(np.uint32).reshape(len(at), n)


def hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), "u8")
    with np.errstate(over="ignore"):
        for n, at, code in _by_length(words):
            out[at] = _mix((code * _places(n)).sum(1, dtype="u8") + _salt(n))
    return out


def _shard(length: int) -> int:
    return min(length, SHARD)


def _bits(h: np.ndarray) -> np.ndarray:
    """The bits of a block that a hash sets, from its low half."""
    out = np.zeros(len(h), "u8")
    for k in range(SET):
        out |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return out


def _blocks(words: int) -> int:
    """Blocks of the filter of so many words: a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(words * BITS / 64, 1))))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) & (blocks - 1)


class Filters:
    """Slices of the filters of some shards; what falls into other slices is found in another round."""

    def __init__(self, blocks: dict[int, int], slices: dict[int, dict[int, bytes]], slice_blocks: int = SLICE):
        self.blocks, self.slice = blocks, slice_blocks
        self.at, self.cells = {}, {}
        for shard, parts in slices.items():
            at = np.full(max(1, blocks[shard] // self.slice), -1)
            at[list(parts)] = np.arange(len(parts))
            self.at[shard], self.cells[shard] = at, np.concatenate([np.frombuffer(p, "u8") for p in parts.values()])

    def knows(self, shard: int, h: np.ndarray) -> np.ndarray:
        if shard not in self.at:
            return np.zeros(len(h), bool)
        block = _block(h, self.blocks[shard])
        part = self.at[shard][block // self.slice]
        bits = _bits(h)
        return (part >= 0) & (self.cells[shard][np.where(part < 0, 0, part * self.slice + block % self.slice)] & bits == bits)


def _filters(scratch: Scratch, vocabulary: DataFrame, round_bytes: int, slice_blocks: int) -> Iterator[Filters]:
    """Filters of at most round_bytes, until each slice of each shard was in one."""
    shard = F.least("length", F.lit(SHARD))
    counts = {r["shard"]: r["n"] for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}  # SHARD rows at most
    blocks = {s: _blocks(n) for s, n in counts.items()}

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard", "slice"], 1 << 16):
            own, part, h = (table[c].to_numpy() for c in ("shard", "slice", "hash"))
            h = h.view("u8")
            starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])]))
            rows = []
            for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
                size = blocks[int(own[a])]
                cells = np.zeros(min(size, slice_blocks), "u8")
                np.bitwise_or.at(cells, _block(h[a:b], size) % slice_blocks, _bits(h[a:b]))
                rows.append((int(own[a]), int(part[a]), cells.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "slice", "cells"])

    size = F.element_at(F.create_map(*(F.lit(x) for s, n in blocks.items() for x in (s, n))), F.col("shard")) if blocks else F.lit(1)
    rows = vocabulary.select(shard.alias("shard"), "hash").withColumn("slice", F.floor(F.shiftrightunsigned("hash", 32).bitwiseAND(size - 1) / slice_blocks).cast("long"))
    made = scratch.table(rows.repartition("shard", "slice").sortWithinPartitions("shard", "slice").mapInArrow(sliced, "shard int, slice long, cells binary"), "filters")
    parts = [(s, k, min(n, slice_blocks) * 8) for s, n in sorted(blocks.items()) for k in range(max(1, n // slice_blocks))]
    while parts:
        taken, held = [], 0
        while parts and (not taken or held + parts[-1][2] <= round_bytes):
            taken.append(parts.pop())
            held += taken[-1][2]
        spans: dict[int, list[int]] = {}
        for s, k, _ in taken:
            spans.setdefault(s, []).append(k)
        here = F.lit(False)
        for s, ks in spans.items():
            here |= (F.col("shard") == s) & F.col("slice").between(min(ks), max(ks))
        slices: dict[int, dict[int, bytes]] = {}
        for r in made.filter(here).collect():  # round_bytes at most
            slices.setdefault(r["shard"], {})[r["slice"]] = bytes(r["cells"])
        yield Filters(blocks, slices, slice_blocks)


def _found(code: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, words): deletions and replacements by later letters of words of one length, as far as the filters know them."""
    n = code.shape[1]
    factor = _places(n)
    wide = code.astype("u8")
    whole = (wide * factor).sum(1, dtype="u8")
    spell = lambda c: [str(w) for w in np.ascontiguousarray(c, "<u4").view(f"<U{c.shape[1]}").ravel()]

    if n > LEAST:
        parts = wide * factor
        before = np.cumsum(parts, axis=1, dtype="u8") - parts
        moved = np.zeros_like(wide)
        moved[:, 1:] = wide[:, 1:] * factor[: n - 1]
        after = moved.sum(1, dtype="u8")[:, None] - np.cumsum(moved, axis=1, dtype="u8")
        new = np.ones(code.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]  # one deletion for a run of the same letter
        rows, at = np.nonzero(new)
        known = filters.knows(_shard(n - 1), _mix(before[rows, at] + after[rows, at] + _salt(n - 1)))
        rows, at = rows[known], at[known]
        if len(rows):
            keep = np.arange(n - 1)[None, :] + (np.arange(n - 1)[None, :] >= at[:, None])
            yield rows, spell(code[rows[:, None], keep])
    for i in range(n):
        rows, k = np.nonzero(alphabet[None, :] > code[:, i, None])
        h = _mix(whole[rows] + (alphabet[k].astype("u8") - wide[rows, i]) * factor[i] + _salt(n))
        known = filters.knows(_shard(n), h)
        rows, k = rows[known], k[known]
        if len(rows):
            made = code[rows].copy()
            made[:, i] = alphabet[k]
            yield rows, spell(made)


def near_pairs(scratch: Scratch, vocabulary: DataFrame, round_bytes: int = FILTER_BYTES, slice_blocks: int = SLICE) -> DataFrame:
    """(word, n, near, near_n) for each pair of near words of vocabulary (word, n, length, hash), once."""
    spark = scratch.spark
    alphabet = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # as many as there are letters
    letters = np.array(sorted(ord(r["c"]) for r in alphabet if r["c"]), np.uint32)
    parts = 1 + vocabulary.count() // PART
    words = vocabulary.select("word", "n").repartition(parts, "word")
    edges = []
    for k, filters in enumerate(_filters(scratch, vocabulary, round_bytes, slice_blocks)):
        shared = spark.sparkContext.broadcast(filters)

        def probed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, at, code in _by_length(batch["word"].to_pylist()):
                    step = max(1, EDITS // (n + len(letters)))
                    for begin in range(0, len(at), step):
                        with np.errstate(over="ignore"):
                            for rows, found in _found(code[begin : begin + step], letters, shared.value):
                                source = pa.array(at[begin + rows])
                                yield pa.RecordBatch.from_arrays([batch["word"].take(source), batch["n"].take(source), pa.array(found, pa.string())], ["word", "n", "near"])

        edges.append(scratch.table(words.mapInArrow(probed, "word string, n long, near string"), f"edges{k}"))
    if not edges:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    return every.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near").select("word", "n", "near", "near_n")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, length, hash) of the words that are long and frequent enough."""
    counts = documents(docs).select("doc_id", "text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TIMES)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pc.utf8_length(batch["word"]).cast(pa.int32()), pa.array(hashes(batch["word"].to_pylist()).view("i8"))]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], *columns], ["word", "n", "length", "hash"])

    return counts.mapInArrow(hashed, "word string, n long, length int, hash long")


def variants(docs: DataFrame, round_bytes: int = FILTER_BYTES, slice_blocks: int = SLICE) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    A word's form is the near word of largest n, the first of several, if its n is at least ten times the word's. root is where the
    forms lead. Null texts have no words, a null doc_id is empty in the hash by which letters are lost, rows that repeat a
    doc_id count each, texts and words of any length are whole. Of the columns only doc_id and text are used. An
    empty table has no words. A word has at most as many near words as it has edits.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(vocabulary(docs), "vocabulary")
    pairs = near_pairs(scratch, words, round_bytes, slice_blocks)
    both = pairs.select(F.explode(F.array(F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("m")), F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("m")))).alias("p"))
    best = both.select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    best = best.select("word", "n_near", F.col("b.other").alias("form"), (-F.col("b.m")).alias("form_n"))
    found = words.select("word", "n").join(best.hint("merge"), "word", "left").withColumn("formed", F.col("form_n") >= RATIO * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("formed"), F.col(c)).alias(c) for c in ("form", "form_n")))
    found = scratch.table(found, "found")

    # Each form is ten times as frequent, which bounds the steps; each round doubles them.
    most = found.agg(F.max("n")).first()[0] or 1
    roots, k, steps = scratch.table(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots0"), 0, 1
    while steps < math.log(most, RATIO) + 1:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        k += 1
        roots = scratch.table(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots{k}")
        steps *= 2
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
