"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Documents with the same shingle set are one node. Nodes that share a band of their signatures share a bucket.
Each member of a bucket is first compared with the bucket's centre, the node with most company in all its buckets,
so a bucket of n nodes costs n - 1 comparisons, not n squared. Members that are like no centre are then compared with
all that have the same centre and are in another component by now: in blocks of bounded size, as products of
incidence matrices, of which only links come out. Every comparison intersects the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, attach, documents, portions

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4

#: Constants of the public splitmix64 generator.
GAMMA, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Pairs of one node that meet in one task, at most.
SALT_ROWS = 256
#: Nodes and bytes of sets in a block of comparisons, at most, and elements that a matrix product takes at a time.
BLOCK_ROWS, BLOCK_BYTES, COLUMNS = 1024, 16 << 20, 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted 64-bit shingle hashes of each text; A-Z count as a-z, fewer words than words are one shingle."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode()
    vocabulary = codes.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(vocabulary.astype(object), categorize=False) if len(vocabulary) else np.zeros(0, "u8")
    real = np.array([w != "" for w in vocabulary], bool)[codes.indices.to_numpy()] if len(flat) else np.zeros(0, bool)
    values, owner = hashes[codes.indices.to_numpy()][real], owner[real]
    ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
    with np.errstate(over="ignore"):
        whole = np.full(max(len(values) - words + 1, 0), np.uint64(words))
        for k in range(words):
            whole = whole * MIX_A + values[k : len(values) - words + 1 + k]
        whole, begin = _mix(whole), 0
        for end in ends:
            if end - begin >= words:
                yield np.unique(whole[begin : end - words + 1])
            elif end > begin:
                one = np.array([end - begin], "u8")
                for v in values[begin:end]:
                    one = one * MIX_A + v
                yield _mix(one)
            else:
                yield np.zeros(0, "u8")
            begin = end


def superminhash(elements: np.ndarray, size: int) -> np.ndarray:
    """Component j is the least rank plus fraction that an element gives to j.

    Each element deals its ranks 0, 1, ... over the components by a Fisher-Yates shuffle of its own. Rank t makes
    values of t and more, so dealing stops once every component is below the next rank.
    """
    least = np.full(size, np.inf)
    with np.errstate(over="ignore"):
        order = None
        rows = np.arange(len(elements))
        for t in range(size):
            x = _mix(elements + GAMMA * np.uint64(t + 1))
            k = t + (x % np.uint64(size - t)).astype(np.int64)
            if t == 0:
                first, j = k, k
            else:
                if order is None:
                    order = np.tile(np.arange(size, dtype=np.int16), (len(elements), 1))
                    order[rows, first] = 0
                    order[:, 0] = first
                j = order[rows, k].astype(np.int64)
                order[rows, k] = order[:, t]
            np.minimum.at(least, j, t + (x >> np.uint64(11)) * 2.0**-53)
            if least.max() < t + 1:
                break
    return least


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, different bands having different keys."""
    cells = signature.view("u8").reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype="u8")
        for k in range(rows):
            key = _mix(key * MIX_B + cells[:, k])
    return key.view("i8")


def _signed(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        sizes, prints, keys = [], [], []
        for elements in shingle_sets(batch["text"], words):
            sizes.append(len(elements))
            prints.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
            keys.append(band_keys(superminhash(elements, bands * rows), bands, rows) if len(elements) else None)
        yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["rid", "doc_id", "n_shingles", "print", "keys"])


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): component is the smallest node that edges (a, b) connect node with.

    Union-find on tables: alternating large and small stars, until each node hangs on its root alone. A star's
    centre is attached by size, so a node with very many edges doesn't meet them in one task.
    """

    def star(directed: DataFrame, keep: str) -> DataFrame:
        n = directed.count()
        roots = directed.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count("*").alias("n"))
        hung = attach(directed, roots, ["u"], "n", n)
        if keep == "large":
            return hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(roots.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def settled(df: DataFrame, at: str) -> tuple[DataFrame, tuple]:
        table = scratch.table(df.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-{at}")
        return table, tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    table, state = settled(edges, "0")
    at, k = "0", 0
    while True:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = settled(star(both, "large"), f"{k}large")
        small, now = settled(star(large, "small"), f"{k}small")
        scratch.drop(f"{name}-{at}", f"{name}-{k}large")
        at, k = f"{k}small", k + 1
        if now == state:
            return small.select(F.col("u").alias("node"), F.col("v").alias("component"))
        table, state = small, now


def _links(scratch: Scratch, pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough. The sets stay in the table named sets."""
    # These joins grow with the data, so they are shuffles at every size.
    ids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.array([x.tobytes() for x in shingle_sets(batch["text"], words)], pa.binary())], ["rid", "members"])

    full = scratch.table(rows.select("rid", "text").join(ids.hint("merge"), "rid", "left_semi").mapInArrow(sets, "rid long, members binary"), "sets")
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    # A node that very many are compared with goes to several tasks, one copy for each SALT_ROWS pairs.
    salted = attach(pairs, counts, ["b"], "n", pairs.count()).select("a", "b", F.expr(f"pmod(xxhash64(a), 1 + n div {SALT_ROWS})").alias("salt"))
    copies = full.join(counts.hint("merge"), F.col("rid") == F.col("b")).select("b", F.col("members").alias("other"), F.explode(F.expr(f"sequence(0L, n div {SALT_ROWS})")).alias("salt"))
    both = salted.join(full.select(F.col("rid").alias("a"), "members").hint("merge"), "a").join(copies.hint("merge"), ["b", "salt"]).select("a", "b", "members", "other")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch["members"], batch["other"], strict=True):
                x, y = np.frombuffer(one.as_buffer(), "u8"), np.frombuffer(other.as_buffer(), "u8")
                fits = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if fits else 0
                keep.append(fits and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scratch.table(both.mapInArrow(similar, "a long, b long"), "links")


def shared_counts(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one shares with each of other."""
    values = np.concatenate([*one, *other])
    rows = np.repeat(np.arange(len(one) + len(other)), [len(x) for x in (*one, *other)])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times > 1  # the others are shared by nothing
    number = np.cumsum(often) - 1
    real = often[column]
    rows, column = rows[real], number[column[real]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(one), len(other)), np.float32)
    for begin in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
        part = np.zeros((len(one) + len(other), COLUMNS), np.float32)
        part[rows[lo:hi], column[lo:hi] - begin] = 1
        out += part[: len(one)] @ part[len(one) :].T
    return out


def _rest(scratch: Scratch, stars: DataFrame, links: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of the same centre that the comparison with the centre left apart."""
    members = stars.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").join(roots.withColumnRenamed("node", "a"), "a", "left")
    members = scratch.table(members.select("a", "b", F.col("linked").isNull().alias("alone"), F.coalesce("component", "a").alias("component")), "star-members")
    full = scratch.spark.read.parquet(f"{scratch.path}/sets")
    sized = members.join(full.select(F.col("rid").alias("a"), F.octet_length("members").alias("bytes")), "a")
    open_groups = sized.groupBy("b").agg(F.count("*").alias("n"), F.count_if("alone").alias("apart"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum("bytes").alias("bytes"))
    open_groups = open_groups.filter("apart > 0 and low <> high").select("b", "n", F.expr(f"1 + greatest(n div {BLOCK_ROWS}, bytes div {BLOCK_BYTES})").alias("blocks"))
    open_groups = scratch.table(open_groups, "open")
    here = attach(members, open_groups, ["b"], "n", members.count()).join(full.withColumnRenamed("rid", "a").hint("merge"), "a")
    here = here.withColumn("own", F.expr("pmod(xxhash64(a), blocks)")).withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
    here = here.select("b", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "a", "alone", "component", "members")

    def compare(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        node, part, own = (group[c].to_numpy() for c in ("a", "component", "own"))
        alone = group["alone"].to_numpy(zero_copy_only=False) if isinstance(group["alone"], pa.Array) else group["alone"].to_pandas().to_numpy()
        sets = [np.frombuffer(x.as_buffer(), "u8") for x in group["members"]]
        left, right = np.flatnonzero(alone), np.arange(len(node))
        if not len(left):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size = np.array([len(x) for x in sets], np.int64)
        shared = shared_counts([sets[k] for k in left], sets)
        similar = 100 * shared >= percent * (size[left][:, None] + size[right][None, :] - shared)
        similar &= part[left][:, None] != part[right][None, :]
        if i != j:
            similar &= own[left][:, None] != own[right][None, :]
        x, y = np.nonzero(similar)
        return pa.table({"a": pa.array(node[left[x]]), "b": pa.array(node[y])})

    return scratch.table(here.groupBy("b", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "rest")


def _grouped(scratch: Scratch, texts: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, kept) for a written table of (rid, doc_id, text)."""
    signed = scratch.table(texts.select("rid", "doc_id", "text").mapInArrow(lambda batches: _signed(batches, words, bands, rows), "rid long, doc_id long, n_shingles long, print binary, keys array<long>"), "signed")
    total = signed.count()
    members = signed.select("rid", "doc_id", "n_shingles", "print")
    classes = scratch.table(members.filter("n_shingles > 0").groupBy("print", "n_shingles").agg(F.min("rid").alias("node"), F.count("*").alias("copies")), "classes")

    reps = signed.select(F.col("rid").alias("node"), "keys").join(classes.select("node"), "node")
    cells = reps.select("node", F.explode("keys").alias("key"))
    buckets = scratch.table(cells.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    # A bucket has at most one in bands of these rows, and Spark splits what is still too large for a task.
    inside = scratch.table(cells.join(buckets.hint("merge"), "key"), "inside")
    company = inside.groupBy("node").agg(F.sum("n").alias("company"))
    inside = scratch.table(inside.join(company, "node"), "company")
    centres = scratch.table(inside.groupBy("key", "n").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("centre")), "centres")
    stars = inside.select("key", "node").join(centres.hint("merge"), "key")
    stars = scratch.table(stars.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    links = _links(scratch, stars, texts, words, percent)
    roots = components(scratch, links, "stars-components")
    rest = _rest(scratch, stars, links, roots, percent)
    if not rest.isEmpty():
        roots = components(scratch, links.unionByName(rest), "all-components")

    grouped = classes.join(roots, "node", "left").select("print", F.coalesce("component", "node").alias("component"), "copies")
    alone = members.filter("n_shingles = 0").select("doc_id", "rid", "n_shingles", F.col("rid").alias("component"))
    placed = scratch.table(attach(members.filter("n_shingles > 0"), grouped, ["print"], "copies", total).select("doc_id", "rid", "n_shingles", "component").unionByName(alone), "members")
    least = F.min_by(F.struct("doc_id", "rid"), F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("least")
    heads = scratch.table(placed.groupBy("component").agg(least, F.count("*").alias("size")), "heads")
    out = attach(placed, heads, ["component"], "size", total)
    return out.select("rid", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("kept"))


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    A text without words has an empty set, is linked with nothing and stays. Equal sets are linked. Texts are read
    whole, a few million bytes at a time or one text. component_id is the smallest doc_id of the component; a null
    doc_id is smaller than none, so it is null only if all are. Of rows that repeat the smallest doc_id one stays. Two
    texts of similarity s share a band with probability 1 - (1 - s^rows)^bands, 0.999995 at 0.75. An empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = scratch.table(documents(docs).withColumn("rid", F.monotonically_increasing_id()), "texts")
    out = _grouped(scratch, texts, words, percent, bands, rows).drop("rid")
    scratch.drop("texts")
    return out


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each group that near_groups finds, all columns kept; columns may have any names."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    wrapped = scratch.table(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row")), "rows")
    texts = wrapped.select("rid", "row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"))
    kept = _grouped(scratch, texts, words, percent, bands, rows).filter("kept").select("rid")
    return wrapped.join(kept.hint("merge"), "rid", "left_semi").select("row.*")
