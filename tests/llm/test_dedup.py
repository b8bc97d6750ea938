import hashlib
import re
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridweave.llm import exact_dedup, line_dedup, mixing, near_dedup

from .conftest import hard_rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def exact_expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known, default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,weak", [(4096, False), (7, False), (5, True)])
def test_exact_groups(spark, hard, block, weak):
    # A weak order of blocks has ties everywhere: names must still be right.
    hashed = (lambda c: F.length(c).cast("long")) if weak else F.xxhash64
    got = exact_dedup.exact_groups(hard, block, hashed).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == exact_expected(hard_rows())
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_drop_exact_copies(hard, empty):
    kept = exact_dedup.drop_exact_copies(hard)
    assert kept.columns == hard.columns
    texts = [SPACE.sub(" ", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({SPACE.sub(" ", r[1] or "") for r in hard_rows()})
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0


def test_clashing_columns(spark):
    """Columns of any name stay what they are."""
    names = ["_own", "_doc", "_sha", "_n", "rid", "row", "id", "sha", "own_id", "own_sha", "copies", "size", "key", "_name", "top", "c"]
    rows = [(k, " ".join(f"w{k % 3}x{i}" for i in range(60)), "s", *range(100 * k, 100 * k + len(names))) for k in range(6)] + [(2, "again", "s", *range(900, 900 + len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    want = sorted(rows[:3] + rows[6:])
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(df).collect())) == want
    assert sorted(map(tuple, near_dedup.drop_near_copies(df).collect())) == want
    assert set(map(tuple, mixing.mixed_documents(df).collect())) == set(rows)


def shingles(text, n=5):
    words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))) if words else frozenset()


def near_expected(rows, percent=75):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    first = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], len(sets[i]), first[find(i)]) for i in range(len(rows))), key=str)


def test_near_groups(hard, empty):
    got = near_dedup.near_groups(hard).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_expected(hard_rows())
    groups = defaultdict(list)
    for r in got:
        # A text without words is a group of its own; doc_id 3 heads two groups, as two texts have it.
        groups[r.component_id if r.n_shingles else id(r)].append(r.kept)
    assert all(sum(kept) == 1 for key, kept in groups.items() if key not in (None, 3))
    assert all(r.doc_id == r.component_id for r in got if r.kept)
    assert near_dedup.near_groups(empty).count() == 0
    kept = near_dedup.drop_near_copies(hard)
    assert kept.columns == hard.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert near_dedup.drop_near_copies(empty).count() == 0


def test_near_chain(spark):
    """A chain of texts of which only neighbours are alike is one component, though most pairs share buckets."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 160])) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_groups(df).collect()) == [(r[0], e[2]) for r, e in zip(rows, sorted(near_expected(rows)), strict=True)]


def test_near_star_without_centre(spark):
    """Variants of a text that isn't there: what the centres leave apart is compared too."""
    import random

    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(60):
        words = list(base)
        for i in rng.sample(range(150), 4 if k % 3 else 9):
            words[i] = f"v{k}x{i}"
        rows.append((k, " ".join(words)))
        if k % 3 == 0:
            rows.append((100 + k, " ".join([*words[:-1], f"t{k}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(df).collect())
    assert got == sorted(near_expected(rows))


def test_superminhash_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (3, 40, 2000):
        a = rng.integers(0, 1 << 62, n).astype("u8")
        b = np.concatenate([a[: n * 4 // 5], rng.integers(0, 1 << 62, n - n * 4 // 5).astype("u8")])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near_dedup.superminhash(a, 128) == near_dedup.superminhash(b, 128)).mean() - truth) < 0.15
    assert [len(s) for s in near_dedup.shingle_sets(pa.array(["a b c d e f", "a", "", None or "x y"]))] == [2, 1, 0, 1]


def lines_expected(rows, percent=85):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    lines = []
    for i in order:
        for k, line in enumerate((rows[i][1] or "").split("\n")):
            s = frozenset(w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in line)) if w)
            if s:
                lines.append((i, k, s))
    gone, links = defaultdict(list), defaultdict(int)
    classes = {s for *_, s in lines}
    for at, (i, k, s) in enumerate(lines):
        alike = lambda t: 100 * len(s & t) >= percent * len(s | t)  # noqa: E731,B023
        if any(alike(t) for *_, t in lines[:at]):
            gone[i].append(k)
        links[i] += sum(alike(t) for t in classes if t != s)
    return [(rows[i][0], sum(1 for j, *_ in lines if j == i), sorted(gone[i]), links[i]) for i in range(len(rows))]


def test_line_matches(spark, empty):
    # Rows that repeat a doc_id have no order between them, so they are left out here.
    seen, rows = set(), []
    for r in hard_rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c long, d int, e string").repartition(3)
    got = sorted((r.doc_id, r.n_lines, list(r.removed), r.n_links) for r in line_dedup.line_matches(df).collect())
    assert got == sorted(lines_expected(rows))
    assert line_dedup.line_matches(empty).count() == 0


def test_line_matches_repeated_rows(hard):
    got = line_dedup.line_matches(hard).collect()
    assert len(got) == len(hard_rows())
    assert sum(r.n_lines for r in got) == sum(bool(SPACE.sub("", x)) for r in hard_rows() for x in (r[1] or "").split("\n"))


@pytest.mark.parametrize("key_rows,block_rows", [(8192, 1024), (1, 3), (3, 2)])
def test_near_lines(spark, key_rows, block_rows):
    """Lines that differ in a few words are found, whatever their order of words, in one block or many."""
    import random

    rng = random.Random(4)
    rows = []
    for d in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 60) if d % 4 else rng.randrange(100, 200))]
        lines = [" ".join(words)]
        for _ in range(3):
            other = list(words)
            for _ in range(rng.randrange(0, 6)):
                other[rng.randrange(len(other))] = f"z{rng.randrange(1000)}"
            rng.shuffle(other)
            lines.append(" ".join(other))
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_lines, list(r.removed), r.n_links) for r in line_dedup.line_matches(df, key_rows=key_rows, block_rows=block_rows).collect())
    assert got == sorted(lines_expected(rows))


def test_many_near_lines(spark):
    """A cluster of more sets than are compared pair by pair, a common word in all lines, and a text of 20,000 words."""
    import random

    rng = random.Random(9)
    base = [f"b{i}" for i in range(140)]
    rows = [(None, "common " + " ".join(f"n{i}" for i in range(30))), (5000, "\n".join(" ".join(f"long{rng.randrange(4000)}" for _ in range(40)) for _ in range(500)))]
    for d in range(60):
        words = list(base)
        for i in rng.sample(range(140), 6):
            words[i] = f"v{rng.randrange(90)}"
        rows.append((d, "common " + " ".join(words) + "\ncommon line here"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_lines, list(r.removed), r.n_links) for r in line_dedup.line_matches(df).collect()), key=str)
    assert got == sorted(lines_expected(rows), key=str)


def test_lines_of_one_word_more(spark):
    """A set inside one of a word more is found from six words on (6/7 is enough, 5/6 is not)."""
    rows = []
    for n in range(1, 12):
        words = [f"w{n}x{k}" for k in range(n)]
        for k, extra in enumerate(("0", "aa", "zz9")):
            rows += [(100 * n + 10 * k, " ".join(f"{w}{extra}" for w in words)), (100 * n + 10 * k + 1, " ".join(f"{w}{extra}" for w in [*words, f"more{n}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_lines, list(r.removed), r.n_links) for r in line_dedup.line_matches(df).collect())
    assert got == sorted(lines_expected(rows))
    assert {d // 100 for d, _, removed, _ in got if removed} == set(range(6, 12))


def test_without_lines(spark):
    df = spark.createDataFrame([("a\nb\nc", [1]), ("a", [0]), ("", [])], "text string, removed array<int>")
    assert [r[0] for r in df.select(line_dedup.without_lines(F.col("text"), F.col("removed"))).collect()] == ["a\nc", "", ""]


def test_portions_keep_texts(monkeypatch):
    """Texts of a portion that does not begin its batch are what they were."""
    import pyarrow.compute as pc

    from gridweave.llm.scratch import portions, whole_groups

    texts = [f"W{i} é " * (i % 7 + 1) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [t for p in portions(iter([batch]), most=60) for t in pc.ascii_lower(p["text"].cast(pa.large_string())).to_pylist()]
    assert got == [t.lower() for t in texts]
    keys = [k for k in range(30) for _ in range(k % 4 + 1)]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([b"x" * (k % 5) for k in keys])], ["k", "x"])
    for n, most in ((1, 0), (5, 0), (5, 7), (1000, 3)):
        parts = [t["k"].to_pylist() for t in whole_groups(iter([rows.slice(i, 7) for i in range(0, len(keys), 7)]), ["k"], n, "x" if most else None, most)]
        assert [k for p in parts for k in p] == keys
        assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_half_of_all_rows_under_one_id(spark):
    """Rows of one doc_id are told apart by their texts; equal rows are copies."""
    rows = [(7, f"text {k} stands here\nshared line of all texts\nown line number {k % 20} of it") for k in range(60)] + [(7, "text 1 stands here\nshared line of all texts\nown line number 1 of it")] * 5
    rows += [(100 + k, f"other {k} text\nshared line of all texts") for k in range(40)] + [(None, "no id " + "x" * k) for k in range(20)] + [(None, "no id ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(map(tuple, exact_dedup.drop_exact_copies(df).collect()), key=str)
    assert kept == sorted(set(rows), key=str)
    got = line_dedup.line_matches(df).collect()
    assert len(got) == len(rows)
    lines = [x for _, t in rows for x in t.split("\n")]
    # One line of each set stays; no two different lines are similar enough.
    assert sum(r.n_lines - len(r.removed) for r in got) == len({frozenset(x.split()) for x in lines})
    with pytest.raises(ValueError):
        line_dedup.line_matches(df, 50)
