"""Line dedup by an exact set-similarity join.

A line is the set of its words, A-Z as a-z. Lines with the same set are one class. The words of a class are ordered by
rarity; two sets can only be similar enough if their prefixes in that order share a word, if their sizes are near
enough and if enough words can follow the first one that they share. What passes these filters is verified on the full
sets. A line goes if an earlier line has its set or one similar to it; documents go by doc_id, lines by place.

Rarity comes from the exact counts of all words, of which the most frequent ones reach the tasks; the others are rarer
than these and go by their hash. A word that occurs often enough to bring many sets together is only a key along with
the next word that the sets share: sets that share enough words share two in prefixes that are one word longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import MIX_A, _mix, components, shared_counts
from .scratch import Scratch, attach, documents, portions, whole_groups

PERCENT = 85
#: Sets of more words than this have a second, wider bitmap of so many 64-bit cells.
LONG, CELLS = 128, 4
#: Rows of a key that are compared by size, place and bitmaps in one block, at most. Words that occur more often are no keys alone.
KEY_ROWS = 8192
#: Rows and bytes of full sets in a block, at most.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: Frequent words whose counts reach the tasks, at most, and bins of a count's doubling that the limit is found by.
FREQUENT, BINS = 1 << 18, 8
#: Words that a task holds while it counts.
HELD = 1 << 21
#: Pairs, and words of pairs, that a task looks at together; sets of a cluster from which products of matrices pay.
PAIRS, ELEMENTS, PRODUCT = 1 << 19, 1 << 21, 24


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text that each word is in, the words' codes, and the codes' hashes; what is empty between spaces is no word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    codes = lists.flatten().dictionary_encode()
    words = codes.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, "u8")
    code = codes.indices.to_numpy().astype(np.int64)
    empty = np.flatnonzero(words == "")
    if len(empty):
        real = code != empty[0]
        owner, code = owner[real], code[real]
    return owner.astype(np.int64), code, hashes


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> pa.RecordBatch:
        words, code = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        n = np.bincount(code, weights=np.concatenate([n for _, n in held]), minlength=len(words)).astype(np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view("i8")), pa.array(n)], ["word", "n"])

    for batch in portions(batches):
        _, code, hashes = _codes(batch["text"].cast(pa.large_string()))
        held.append((hashes, np.bincount(code, minlength=len(hashes))))
        if sum(len(w) for w, _ in held) > HELD:
            yield summed()
    if held:
        yield summed()


class Rarity:
    """Counts of the most frequent words; any other word occurs at most floor times."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, floor: int):
        order = np.argsort(words)
        self.words, self.counts, self.floor = words[order], counts[order], floor

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.floor)
        at = np.searchsorted(self.words, hashes).clip(max=len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], self.floor)


def _rarity(scratch: Scratch, texts: DataFrame) -> Rarity:
    counts = texts.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = scratch.table(counts.withColumn("bin", F.floor(F.log2("n") * BINS).cast("int")), "words")
    floor, words, least = 1, 0, 0
    for row in counts.groupBy("bin").agg(F.count("*").alias("words"), F.max("n").alias("most")).orderBy(F.desc("bin")).collect():  # BINS a doubling
        words += row["words"]
        if words > FREQUENT:
            floor, least = row["most"], row["bin"] + 1
            break
    found = counts.filter(F.col("bin") >= least).select("word", "n").toPandas()  # FREQUENT rows at most
    scratch.drop("words")
    return Rarity(found["word"].to_numpy().view("u8"), found["n"].to_numpy(), floor)


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """Words that a set of n must share with any set that is similar enough."""
    return -(-n * percent // 100)


def _sets(texts: pa.Array, rarity: Rarity) -> tuple[np.ndarray, ...]:
    """Texts and places of lines, begins and sizes of their sets, the words, rare ones first, their counts, the sets' prints.

    A set's print is the sum of its words' two mixed hashes: the same whatever their order, 128 bits in all.
    """
    lines = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    owner = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    line, code, hashes = _codes(lines.flatten())
    wide, counts = max(len(hashes), 1), rarity(hashes)
    order = np.lexsort((hashes, counts))
    rank = np.empty(len(hashes), np.int64)
    rank[order] = np.arange(len(hashes))
    keys = np.sort(line * wide + rank[code])
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    own, which = np.divmod(keys, wide)
    n = np.bincount(own, minlength=len(owner))
    begins = np.cumsum(n) - n
    some = n > 0
    prints = np.zeros((2, len(owner)), "u8")
    hashes = hashes[order]
    if some.any():
        with np.errstate(over="ignore"):
            prints[0, some] = np.add.reduceat(_mix(hashes)[which], begins[some])
            prints[1, some] = np.add.reduceat(_mix(hashes + np.uint64(1))[which], begins[some])
    return owner, place, begins, n, hashes[which], counts[order][which], prints.view("i8")


def _runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each run, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(begins - np.cumsum(lengths) + lengths, lengths)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


LINED = "rid long, doc_id long, own_text long, line int, n int, p1 long, p2 long, bits long, more array<long>, cold array<int>, hot array<int>, hot_at array<int>"


def _lined(batches: Iterator[pa.RecordBatch], rarity: Rarity, percent: int, key_rows: int) -> Iterator[pa.RecordBatch]:
    """A row for each line with a word, and one of line -1 for each text.

    cold has the keys of the prefix's words, in their order; hot has those of a word that is no key alone and a later
    one, and hot_at the place of the first. Words that are no keys alone come after all others.
    """
    for batch in portions(batches):
        owner, place, begins, n, word, count, prints = _sets(batch["text"], rarity)
        some = np.flatnonzero(n)
        least = _least_shared(n, percent)
        # Sets that may lack no word, and are not like even a set of one word more, are only like themselves.
        length = np.where((least < n) | (100 * n >= percent * (n + 1)), n - least + 1, 0)
        at = _runs(begins, length)
        line, hot = np.repeat(np.arange(len(n)), length), count[at] > key_rows
        cold = at[~hot]
        at, line_hot = at[hot], line[hot]
        seconds = begins[line_hot] + np.minimum(length + 1, n)[line_hot] - at - 1
        first = np.repeat(at, seconds)
        with np.errstate(over="ignore"):
            both = _mix(word[first] * MIX_A + word[_runs(at + 1, seconds)])
        hot_sizes = np.bincount(np.repeat(line_hot, seconds), minlength=len(n))
        hot_at = first - np.repeat(begins[line_hot], seconds)
        cold_sizes = np.bincount(line[~hot], minlength=len(n))
        bits = np.bitwise_xor.reduceat(np.uint64(1) << (word % np.uint64(64)), begins[some]).view("i8") if len(some) else np.zeros(0, "i8")
        long = np.flatnonzero(n > LONG)
        wide = np.zeros((len(long), CELLS), "u8")
        if len(long):
            own = word[_runs(begins[long], n[long])]
            cell, bit, starts = (own >> np.uint64(6)) % np.uint64(CELLS), np.uint64(1) << ((own >> np.uint64(8)) % np.uint64(64)), np.cumsum(n[long]) - n[long]
            for k in range(CELLS):
                wide[:, k] = np.bitwise_xor.reduceat(np.where(cell == k, bit, np.uint64(0)), starts)
        row = pa.array(owner[some])
        zero, none = np.zeros(batch.num_rows, "i8"), pa.nulls(batch.num_rows)
        both_rows = lambda a, b: pa.array(np.concatenate([a, b]))
        lists = [
            _lists(wide.reshape(-1).view("i8"), np.where(n[some] > LONG, CELLS, 0), pa.int64()), _lists(_short(word[cold]), cold_sizes[some], pa.int32()),
            _lists(_short(both), hot_sizes[some], pa.int32()), _lists(hot_at.astype(np.int32), hot_sizes[some], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.concat_arrays([batch[c].take(row), batch[c]]) for c in ("rid", "doc_id", "own_text")), both_rows(place[some], zero - 1).cast(pa.int32()), both_rows(n[some], zero).cast(pa.int32()),
                both_rows(prints[0, some], zero), both_rows(prints[1, some], zero), both_rows(bits, zero), *(pa.concat_arrays([x, none.cast(x.type)]) for x in lists),
            ],
            [c.split()[0] for c in LINED.split(", ")],
        )


def _groups(table: pa.Table, names: list[str]) -> np.ndarray:
    """Numbers of the groups that rows are in, equal rows being consecutive."""
    changed = np.zeros(table.num_rows, bool)
    for name in names:
        x = table[name].to_numpy()
        changed[1:] |= x[1:] != x[:-1]
    return np.cumsum(changed)


def _connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, smallest y) for what the edges (a, b) connect: one for each node but the smallest."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        now = label.copy()
        np.minimum.at(now, x, least)
        np.minimum.at(now, y, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _alike(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a key that size, place and bitmaps do not rule out; only across blocks where there are two."""
    split = "i" in table.column_names
    group = _groups(table, ["key", "i", "j"] if split else ["key"])
    n, at = (table[c].to_numpy().astype(np.int64) for c in ("n", "at"))
    bits = table["bits"].to_numpy().view("u8")
    own, across = (table["own"].to_numpy(), table["i"].to_numpy() != table["j"].to_numpy()) if split else (n, np.zeros(len(n), bool))
    order = np.lexsort((n, group))
    wide = int(n.max(initial=0)) + 1
    by_size = group[order] * wide + n[order]
    # From the smaller set of a pair, the larger ones that are near enough follow in this order.
    partners = np.searchsorted(by_size, group[order] * wide + np.minimum(n[order] * 100 // percent, wide - 1), side="right") - np.arange(len(order)) - 1
    long = np.flatnonzero(n > LONG)
    place = np.full(len(n), -1)
    place[long] = np.arange(len(long))
    more = np.zeros((len(long), CELLS), "u8")
    if len(long):
        more[:] = table["more"].combine_chunks().flatten().to_numpy().view("u8").reshape(len(long), CELLS)
    found = []
    ends = np.cumsum(partners)
    begin = 0
    while begin < len(order):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        size = partners[begin:end]
        x, y = np.repeat(order[begin:end], size), order[_runs(np.arange(begin, end) + 1, size)]
        begin = end
        need = -(-(n[x] + n[y]) * percent // (100 + percent))
        keep = np.minimum(n[x] - at[x], n[y] - at[y]) >= need
        x, y, need = x[keep], y[keep], need[keep]
        most = n[x] + n[y] - 2 * need
        keep = (np.bitwise_count(bits[x] ^ bits[y]) <= most) & (~across[x] | (own[x] != own[y]))
        x, y, most = x[keep], y[keep], most[keep]
        both = np.flatnonzero((place[x] >= 0) & (place[y] >= 0))
        if len(both):
            apart = np.bitwise_count(more[place[x[both]]] ^ more[place[y[both]]]).astype(np.int64).sum(1)
            keep = np.ones(len(x), bool)
            keep[both] = apart <= most[both]
            x, y = x[keep], y[keep]
        found.append((x, y))
    return np.concatenate([x for x, _ in found] or [order[:0]]), np.concatenate([y for _, y in found] or [order[:0]])


def _edges(scratch: Scratch, classes: DataFrame, percent: int, key_rows: int) -> DataFrame:
    """Edges (a, b) that connect all classes that the filters leave together."""
    own = ["cls", "n", "bits", "more"]
    cold = classes.select(*own, F.posexplode("cold").alias("at", "key")).select("key", *own, "at")
    # Only keys of frequent words can have more rows than a block.
    hot = classes.filter(F.size("hot") > 0).select(*own, "hot_at", F.posexplode("hot").alias("pos", "key")).select("key", *own, F.get("hot_at", F.col("pos")).alias("at"))
    sized = hot.groupBy("key").agg(F.count("*").alias("m")).withColumn("parts", F.expr(f"1 + m div {key_rows}"))
    split = _blocks(hot.join(sized.hint("merge"), "key"), "parts").select("key", "own", "i", "j", *own, "at")

    def compared(cells: DataFrame, keys: list[str]) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, keys, 1 << 15):
                cls = table["cls"].to_numpy()
                x, y = _alike(table, percent)
                a, b = _connected(cls[x], cls[y])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")

    return scratch.table(compared(cold, ["key"]).unionByName(compared(split, ["key", "i", "j"])), "edges")


def _blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """rows of a key spread over pairs of its blocks (i, j); own is the row's block."""
    spread = rows.withColumn("own", F.expr(f"pmod(xxhash64(cls), {blocks})")).withColumn("with", F.explode(F.expr(f"sequence(0L, {blocks} - 1)")))
    return spread.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")}).drop("with", blocks)


def _similar(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a cluster whose full sets are similar enough; only across blocks where there are two."""
    group = _groups(table, ["component", "i", "j"])
    own, across = table["own"].to_numpy(), table["i"].to_numpy() != table["j"].to_numpy()
    members = table["members"].combine_chunks()
    size = pc.binary_length(members).to_numpy().astype(np.int64) // 8
    begins, ends = (np.searchsorted(group, group, side=side) for side in ("left", "right"))
    partners = np.where(ends - begins < PRODUCT, ends - np.arange(len(group)) - 1, 0)
    x = np.repeat(np.arange(len(group)), partners)
    y = _runs(np.arange(len(group)) + 1, partners)
    fits = (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])) & (~across[x] | (own[x] != own[y]))
    x, y = x[fits], y[fits]
    words = np.frombuffer(b"".join(members.to_pylist()), "u8")
    _, code = np.unique(words, return_inverse=True)
    wide, starts = int(code.max(initial=0)) + 1, np.cumsum(size) - size
    # Sets are sorted, so these are, too: a word of a set is there if it is found.
    keys = np.repeat(np.arange(len(size)), size) * wide + code
    less, other = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
    shared = np.zeros(len(x), np.int64)
    done, begin = np.cumsum(size[less]), 0
    while begin < len(x):
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + ELEMENTS, side="right")))
        a, b = less[begin:end], other[begin:end]
        looked = np.repeat(b, size[a]) * wide + code[_runs(starts[a], size[a])]
        hit = keys[np.searchsorted(keys, looked).clip(max=len(keys) - 1)] == looked
        shared[begin:end] = np.bincount(np.repeat(np.arange(len(a)), size[a]), weights=hit, minlength=len(a))
        begin = end
    keep = 100 * shared >= percent * (size[x] + size[y] - shared)
    found = [(x[keep], y[keep])]
    for begin in np.unique(begins[ends - begins >= PRODUCT]).tolist():
        rows = np.arange(begin, int(ends[begin]))
        sets = [words[starts[k] : starts[k] + size[k]] for k in rows]
        both = shared_counts(sets, sets)
        alike = 100 * both >= percent * (size[rows][:, None] + size[rows][None, :] - both)
        if across[begin]:
            alike &= own[rows][:, None] != own[rows][None, :]
        a, b = np.nonzero(np.triu(alike, 1))
        found.append((rows[a], rows[b]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _linked(scratch: Scratch, docs: DataFrame, told: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(cls, links, earliest) for those of the classes told that are similar to others of their cluster, on the full sets."""
    # The text is in the key, so that rows without doc_id, or very many of one doc_id, are not all one key.
    key = lambda doc, text: F.struct(doc.isNull(), F.coalesce(doc, F.lit(0)), text)
    wanted = told.groupBy(key(F.col("first.doc_id"), F.col("first.own_text")).alias("_key")).agg(F.collect_list(F.struct("p1", "p2", "cls")).alias("wanted"))
    keyed = documents(docs).withColumn("_key", key(F.col("doc_id"), F.xxhash64("text")))
    held = keyed.join(wanted.hint("merge"), "_key").select("text", "wanted")
    flat = Rarity(np.zeros(0, "u8"), np.zeros(0, np.int64), 0)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            owner, _, begins, n, word, _, prints = _sets(batch["text"], flat)
            names = [{(x["p1"], x["p2"]): x["cls"] for x in w} for w in batch["wanted"].to_pylist()]
            found: dict[int, bytes] = {}
            raw = word.tobytes()
            for text, begin, size, p1, p2 in zip(owner.tolist(), begins.tolist(), n.tolist(), prints[0].tolist(), prints[1].tolist(), strict=True):
                if size and (cls := names[text].get((p1, p2))) is not None:
                    found[cls] = raw[8 * begin : 8 * (begin + size)]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["cls", "members"])

    # Rows that repeat a doc_id may hold a class twice; it is the same set.
    full = scratch.table(held.mapInArrow(members, "cls long, members binary"), "sets").dropDuplicates(["cls"])
    rows = scratch.table(told.select("cls", "component", "first.*").join(full.hint("merge"), "cls"), "cluster-sets")
    scratch.drop("sets")
    sized = rows.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.octet_length("members")).alias("bytes"))
    sized = scratch.table(sized.select("component", "m", F.expr(f"1 + greatest(m div {block_rows}, bytes div {BLOCK_BYTES})").alias("parts")), "cluster-sizes")
    keys = ["component", "i", "j"]
    here = _blocks(attach(rows, sized, ["component"], "m", rows.count()).drop("m"), "parts").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, keys, 1 << 12, "members", BLOCK_BYTES):
            x, y = _similar(group, percent)
            rows = group.num_rows
            links = np.bincount(x, minlength=rows) + np.bincount(y, minlength=rows)
            order = np.lexsort([pc.fill_null(group[c].cast(pa.int64()), 0).to_numpy() for c in ("line", "rid", "doc_id", "last")])
            rank = np.empty(rows, np.int64)
            rank[order] = np.arange(rows)
            least = np.full(rows, rows)
            np.minimum.at(least, x, rank[y])
            np.minimum.at(least, y, rank[x])
            some = np.flatnonzero(links)
            head = group.select(["last", "doc_id", "rid", "line"]).take(pa.array(order[least[some]], pa.int64())).combine_chunks()
            own = pa.table({"cls": group["cls"].take(pa.array(some, pa.int64())), "links": pa.array(links[some], pa.int64()), **{c: head[c] for c in head.column_names}})
            yield from own.combine_chunks().to_batches()

    out = here.select(*keys, "own", "cls", "last", "doc_id", "rid", "line", "members").mapInArrow(compare, "cls long, links long, last boolean, doc_id long, rid long, line int")
    return out.groupBy("cls").agg(F.sum("links").alias("links"), F.min(F.struct("last", "doc_id", "rid", "line")).alias("earliest"))


def line_matches(docs: DataFrame, percent: int = PERCENT, key_rows: int = KEY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, n_links, removed.

    n_lines counts lines with a word; others are neither matched nor removed. removed has the places (from 0) of the
    lines that an earlier line matches, and n_links how many other classes the document's lines are linked with, each
    line counted. A null doc_id comes after all others; rows that repeat a doc_id are documents of their own, their
    lines in an arbitrary order between them. Null texts have no lines; texts of any length are
    read whole. An empty table gives an empty result. percent is more than 50: with less, sets of one word could be
    similar to sets of two.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be more than 50, and 100 at most")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    texts = documents(docs)
    shared = spark.sparkContext.broadcast(_rarity(scratch, texts))
    numbered = texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("own_text"), "text")
    lines = scratch.table(numbered.mapInArrow(lambda batches: _lined(batches, shared.value, percent, key_rows), LINED), "lines")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "line", "own_text")).alias("first")
    same = [F.any_value(c).alias(c) for c in ("n", "bits", "more", "cold", "hot", "hot_at")]
    classes = lines.filter("line >= 0").groupBy("p1", "p2").agg(first, F.count("*").alias("lines"), *same)
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    clusters = components(scratch, _edges(scratch, classes, percent, key_rows), "clusters")
    clusters = clusters.withColumnRenamed("node", "cls").unionByName(clusters.select(F.col("component").alias("cls"), "component").distinct())
    clusters = scratch.table(clusters, "clustered-classes")
    clustered = scratch.table(classes.select("cls", "p1", "p2", "first", "lines").join(clusters.hint("merge"), "cls"), "clustered")
    seen = _linked(scratch, docs, clustered.drop("lines"), percent, block_rows)
    # Classes of one line that are like no other need not be told: their line stays.
    place = F.struct("first.last", "first.doc_id", "first.rid", "first.line")
    columns = ["p1", "p2", "lines", "first", "links", "later"]
    told = clustered.join(seen, "cls", "left").withColumns({"links": F.coalesce("links", F.lit(0)), "later": F.coalesce(F.col("earliest") < place, F.lit(False))}).select(*columns)
    alone = classes.filter("lines > 1").join(clusters.hint("merge"), "cls", "left_anti").withColumns({"links": F.lit(0).cast("long"), "later": F.lit(False)}).select(*columns)
    told = scratch.table(told.unionByName(alone), "told")
    placed = attach(lines.filter("line >= 0").select("rid", "doc_id", "line", "p1", "p2"), told, ["p1", "p2"], "lines", lines.count(), "left")
    own = F.col("first").isNull() | (F.col("rid") == F.col("first.rid")) & (F.col("line") == F.col("first.line"))
    gone = F.coalesce("later", F.lit(False)) | ~own
    bare = lines.filter("line < 0").select("rid", "doc_id", F.lit(None).cast("int").alias("line"), F.lit(0).cast("long").alias("links"), F.lit(False).alias("gone"))
    rows = placed.select("rid", "doc_id", "line", F.coalesce("links", F.lit(0)).alias("links"), gone.alias("gone")).unionByName(bare)
    out = rows.groupBy("rid", "doc_id").agg(F.count("line").alias("n_lines"), F.count_if("gone").alias("n_removed"), F.sum("links").alias("n_links"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"))
    return out.drop("rid")


def without_lines(text: Column, removed: Column) -> Column:
    """text without the lines at the places in removed."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, k: ~F.array_contains(removed, k)), "\n")
