"""Spelling variants against all edits of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import spelling

from .conftest import SCHEMA, hard_rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def expected(rows):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = sorted({c for w in counts for c in w})
    out, forms = {}, {}
    for w, n in counts.items():
        near = set()
        for k in range(len(w) + 1):
            near |= {w[:k] + c + w[k:] for c in letters} | {w[:k] + c + w[k + 1 :] for c in letters if k < len(w)} | {w[:k] + w[k + 1 :]}
        near = [v for v in near - {w} if v in counts]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = (n, len(near))
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w], counts[forms[w]] if forms[w] else None)
    return out


def held(spark, rows, **options):
    df = spark.createDataFrame([(d, t, None, None, None, 1, "w") for d, t in rows], SCHEMA).repartition(3)
    got = spelling.variants(df, **options).collect()
    want = expected(rows)
    assert {r.word: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)
    return want


def noisy(rng, n):
    base = ["".join(rng.choice("abeéÿ×st") for _ in range(rng.randrange(7, 11))) for _ in range(60)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.2)), 59)]
            while rng.random() < 0.15:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abXéÉ") + w[i:], w[:i] + rng.choice("abÿ") + w[i + 1 :]])
            words.append(rng.choice([w, w, w.title(), w + "Ā", "12" + w]))
        rows.append((rng.choice([k, k, None]), rng.choice([" ", "-", "ŷ", "漢"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_edits(spark, seed):
    assert any(v[0] for v in held(spark, noisy(random.Random(seed), 120)).values())


def test_roots(spark):
    """Forms of forms, three steps deep; two near words of the same n."""
    chain = ["lettersabcd", "lettersabc", "lettersab", "letterseb"]
    rows = [(k, chain[0]) for k in range(1, 5)] + [(20 * i + k, " ".join([chain[i]] * (5 * 15 ** (i - 1)))) for i in range(1, 4) for k in range(20)]
    want = held(spark, [*rows, (500, "othermore othermare " * 40 + "othermire othermire")])
    assert want["lettersabcd"][:2] == ("lettersabc", "letterseb") and want["othermire"][0] == "othermare"


def test_rounds(spark):
    """Filters that don't fit in one broadcast."""
    held(spark, noisy(random.Random(3), 60), round_bytes=1024, slice_blocks=8)


def test_long_texts_and_words(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["wordone", "wordtwo", "wordtoo", "wordtwoo"]) for _ in range(20_000))
    run = "".join(rng.choice("abc") for _ in range(3000))
    held(spark, [(1, long), (2, run), (3, run), (4, run[:70] + " " + run[:71]), (5, run[:70] + " " + run[:71]), (6, "a" * 90 + " " + "a" * 90 + " " + "a" * 89 + " " + "a" * 89), *[(d, t) for d, t, *_ in hard_rows()]])


def test_empty(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, None, None, None, None, None, None), (1, "short words. no", None, None, None, None, None)], SCHEMA)).count() == 0


def test_checksums_join():
    rng = random.Random(5)
    heads = [bytes(rng.randrange(256) for _ in range(rng.randrange(9))) for _ in range(40)]
    for n in (0, 1, 2, 7, 40, 300):
        tail = bytes(rng.randrange(256) for _ in range(n))
        moved = spelling.joined_crc(np.array([zlib.crc32(h) for h in heads], np.uint32), [n])[0]
        assert [int(x) ^ zlib.crc32(tail) for x in moved] == [zlib.crc32(h + tail) for h in heads]


def test_filters_know_their_words():
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(5000)})
    h = spelling.hashes(words)
    size = spelling._blocks(2500)
    cells = np.zeros(size, "u8")
    np.bitwise_or.at(cells, spelling._block(h[:2500], size), spelling._bits(h[:2500]))
    known = spelling.Filters({9: size}, {9: {0: cells.tobytes()}}).knows(9, h)
    assert known[:2500].all() and known[2500:].mean() < 0.02
