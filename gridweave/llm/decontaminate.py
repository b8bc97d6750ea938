r"""Benchmark decontamination: an exact join of item windows with documents, by prefix, length and position.

An item has windows of so many of its words, a shorter item is one. A window occurs where a document has all its words
one after the other, so any shingle of the window is necessary. The shingles of a window are ordered by how often
documents have them; the rarest is the window's prefix, as containment must be whole. Documents are looked at where they
have a prefix: its place in the window tells where the window would begin, which must leave room for all of it in the
document. What is left meets the windows in a join on the words themselves, which verifies it.

What reaches the tasks has a fixed size: a table of CELLS hash cells that tells which places of which window lengths a
prefix that falls into it has. A benchmark too large for it lets more through to the join, and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import MIX_A, _mix
from .scratch import Scratch, attach, portions, split_bytes

#: Words of a window (the contract's), of a shingle, and hash cells, of which there is a power of two.
SIZE, SHINGLE, CELLS = 10, 3, 1 << 22
#: Bytes of text that a task looks at together, at most, or one text.
PORTION = 1 << 20

#: Bytes of UTF-8: A-Z as a-z; what is ASCII and neither letter nor digit parts words.
PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


class Words:
    """The words of some texts, one after the other, and their hashes."""

    def __init__(self, texts: pa.Array):
        owner, self.words = split_bytes(texts, lambda data: PLAIN[data])
        self.owner = owner.astype(np.int32)
        self.ends = np.searchsorted(self.owner, np.arange(len(texts)), side="right")
        self.begins = np.searchsorted(self.owner, np.arange(len(texts)), side="left")
        names = self.words.dictionary.to_numpy(zero_copy_only=False).astype(object)
        own = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, "u8")
        self.hashes = own[self.words.indices.to_numpy()]

    def shingles(self, size: int) -> np.ndarray:
        """The hash of the size words from each word on; those that leave their text are not to be used."""
        with np.errstate(over="ignore"):
            out = np.full(len(self.hashes), np.uint64(size))
            for k in range(size):
                out[: len(out) - k] = out[: len(out) - k] * MIX_A + self.hashes[k:]
            return _mix(out)

    def spelt(self, begins: np.ndarray, length: int) -> pa.Array:
        """length words from each place on, with spaces between."""
        at = (begins[:, None] + np.arange(length)[None, :]).ravel()
        flat = self.words.take(pa.array(at)).dictionary_decode().cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1, dtype=np.int32) * length), flat)
        return pc.binary_join(lists, " ")


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (cells - 1)


def _windows(benchmark: DataFrame, size: int, cells: int) -> DataFrame:
    """(item, window, length, tokens): each window of each item, with cell and hash of its shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, most=PORTION):
            words = Words(batch["text"])
            n = words.ends - words.begins
            for length in np.unique(np.minimum(n[n > 0], size)).tolist():
                items = np.flatnonzero(np.minimum(n, size) == length)
                count = n[items] - length + 1
                owner = np.repeat(items, count)
                begins = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + words.begins[owner]
                k = min(SHINGLE, length)
                tokens = words.shingles(k)[begins[:, None] + np.arange(length - k + 1)[None, :]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1, dtype=np.int32) * tokens.shape[1]), pa.array(tokens.ravel().view("i8")))
                yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(owner)), words.spelt(begins, length), pa.array(np.full(len(begins), length, np.int32)), lists], ["item", "window", "length", "tokens"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    found = named.mapInArrow(each, "item string, window string, length int, tokens array<long>")
    return found.groupBy("window", "length").agg(F.collect_set("item").alias("items"), F.first("tokens").alias("tokens"))


def _rarity(texts: DataFrame, cells: np.ndarray, sizes: list[int], every: int) -> DataFrame:
    """(cell, n): how many shingles of all documents fall into each of the cells."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flagged, n = shared.value, np.zeros(len(shared.value[1]), np.int64)
        for batch in portions(batches, most=PORTION):
            words = Words(batch["text"])
            for k in sizes:
                cell = _cell(words.shingles(k), every)
                hit = np.flatnonzero(flagged[0][cell])
                hit = hit[hit + k <= words.ends[words.owner[hit]]]
                n += np.bincount(np.searchsorted(flagged[1], cell[hit]), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(flagged[1][some]), pa.array(n[some])], ["cell", "n"])

    flags = np.zeros(every, bool)
    flags[cells] = True
    shared = texts.sparkSession.sparkContext.broadcast((flags, cells))
    return texts.select("text").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _masks(scratch: Scratch, windows: DataFrame, texts: DataFrame, cells: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each window length the words of a shingle, and for each cell the places that prefixes in it have, as bits."""
    tokens = windows.select("window", "length", F.posexplode("tokens").alias("at", "token"))
    tokens = scratch.table(tokens.withColumn("cell", F.shiftrightunsigned("token", 20).bitwiseAND(F.lit(cells - 1))), "tokens")
    lengths = sorted(r["length"] for r in tokens.select("length").distinct().collect())  # one for each window length
    flagged = np.sort(tokens.select("cell").distinct().toPandas()["cell"].to_numpy().astype(np.int64))  # cells at most
    counts = _rarity(texts, flagged, sorted({min(SHINGLE, n) for n in lengths}), cells)
    rarest = F.min_by(F.struct("at", "cell"), F.struct(F.coalesce("n", F.lit(0)), "token", "at")).alias("p")
    prefixes = tokens.join(counts, "cell", "left").groupBy("window", "length").agg(rarest)
    bits = prefixes.groupBy("length", "p.cell").agg(F.bit_or(F.expr("shiftleft(1L, p.at)")).alias("bits")).toPandas()  # cells rows a length at most
    out = {}
    for n in lengths:
        k = min(SHINGLE, n)
        kind = next(t for t, most in (("u1", 8), ("u2", 16), ("u4", 32), ("u8", 64)) if n - k + 1 <= most)
        table, own = np.zeros(cells, kind), bits[bits["length"] == n]
        table[own["cell"].to_numpy()] = own["bits"].to_numpy().astype("i8").view("u8").astype(kind)
        out[n] = (k, table)
    return out


def _candidates(texts: DataFrame, masks: dict[int, tuple[int, np.ndarray]], cells: int) -> DataFrame:
    """A row (rid, doc_id, n_words) for each text, and (rid, begin, length, window) where a window may be."""
    shared = texts.sparkSession.sparkContext.broadcast(masks)
    schema = "rid long, doc_id long, n_words long, begin int, length int, window string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in portions(batches, most=PORTION):
            words = Words(batch["text"])
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], pa.array(words.ends - words.begins), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.string())], names)
            made = {k: _cell(words.shingles(k), cells) for k in {k for k, _ in shared.value.values()}}
            for length, (k, table) in shared.value.items():
                found = table[made[k]]
                hit = np.flatnonzero(found)
                found, own = found[hit], words.owner[hit]
                for place in range(length - k + 1):
                    begin = hit - place
                    # The shingle is at place in the window: all of it must be in the text that has the shingle.
                    fits = (found >> place & 1 == 1) & (begin >= words.begins[own]) & (begin + length <= words.ends[own])
                    begin, row = begin[fits], own[fits]
                    n = len(begin)
                    if not n:
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [batch["rid"].take(pa.array(row)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array((begin - words.begins[row]).astype(np.int32)), pa.array(np.full(n, length, np.int32)), words.spelt(begin, length)], names
                    )

    return texts.select("rid", "doc_id", "text").mapInArrow(each, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, cells: int = CELLS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    spans are the runs of words (begin, end) that windows of items cover, items the item_ids as sorted strings. Null
    texts have no words, and neither has what only holds separators; such items have no windows. A null item_id is an
    empty string, rows of one item_id are one item. Rows that repeat a doc_id, or have none, are documents of their own.
    Texts of any length are whole; other columns are not used. Without items no document is contaminated; without
    documents there are no rows. A window of size words has size - 2 places for its prefix, so size is 66 at most.
    """
    if not 0 < size <= 66 or cells & (cells - 1):
        raise ValueError("a window has 1 to 66 words, cells are a power of two")
    scratch = Scratch(docs.sparkSession, "contamination")
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    windows = scratch.table(_windows(benchmark, size, cells), "windows")
    found = scratch.table(_candidates(texts, _masks(scratch, windows, texts, cells), cells), "found")
    candidates = found.filter("window is not null").select("rid", "begin", "length", "window")
    # Passages that very many documents have are hot windows.
    sizes = candidates.groupBy("window").agg(F.count("*").alias("m"))
    known = scratch.table(windows.select("window", "items").join(sizes.hint("merge"), "window"), "known")
    occurring = attach(candidates, known, ["window"], "m", candidates.count())
    spans = F.array_sort(F.collect_list(F.struct("begin", (F.col("begin") + F.col("length")).alias("end")))).alias("spans")
    each = occurring.groupBy("rid").agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    empty = F.array().cast("array<struct<begin:int,end:int>>")
    last = lambda acc: F.element_at(acc, -1)

    def merged(acc, x):
        joins = (F.size(acc) > 0) & (x["begin"] <= F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["begin"].alias("begin"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))

    each = each.withColumn("spans", F.aggregate("spans", empty, merged))
    out = found.filter("n_words is not null").select("rid", "doc_id", "n_words").join(each.hint("merge"), "rid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["begin"]), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), items.alias("items"), F.coalesce("spans", empty).alias("spans"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, cells: int = CELLS) -> DataFrame:
    """docs without the documents in which a window occurs; rows go by doc_id, those without one stay."""
    bad = contamination(docs, benchmark, size, cells).filter("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
