"""Decontamination against every window at every place."""

import hashlib
import random
import re

import pytest

from gridweave.llm import decontaminate

from .conftest import SCHEMA, WORDS, hard_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
ITEMS = "item_id long, text string, window string, doc_id int"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for k in range(len(words)):
            for n in range(1, size + 1):
                if own := windows.get(tuple(words[k : k + n])):
                    if k + n <= len(words):
                        hit |= set(range(k, k + n))
                        found |= own
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    df = spark.createDataFrame([(d, t, None, None, None, 1, "x") for d, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS).repartition(2)
    rows = decontaminate.contamination(df, bench, **options).collect()
    for r in rows:
        assert sum(s["end"] - s["begin"] for s in r.spans) == r.n_hit
        assert all(a["end"] < b["begin"] for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted((tuple(r)[:7] for r in rows), key=str)


def cases(rng):
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    few = lambda n: " ".join(rng.choice(["ka", "lo", "mi"]) for _ in range(n))
    items = [(k, say(rng.randrange(12, 40))) for k in range(25)] + [(30, "one"), (31, "Two, words!"), (32, "a b c d e f g h i"), (33, few(10)), (34, few(14)), (33, say(15)), (None, say(11)), (40, None), (41, " ,.;"), (42, "漢字 É 9x")]
    items += [(50, items[3][1]), (51, "é, ü, " + items[4][1])]
    docs = [(k, say(rng.randrange(0, 200))) for k in range(20)] + [(100 + k, few(rng.randrange(5, 200))) for k in range(10)]
    for k in range(40):
        text = words_of(items[rng.randrange(25)][1])
        cut = rng.randrange(0, 4)
        docs.append((200 + k, say(rng.randrange(30)) + "\n" + "-".join(text[cut : len(text) - rng.randrange(0, 4)]).title() + rng.choice([" ", ". "]) + say(rng.randrange(30))))
    docs += [(300, items[3][1] + " " + items[4][1]), (301, "ONE"), (302, "two\x00words"), (303, "漢字 É 9X"), (304, "漢字 é 9X"), (None, items[5][1]), (None, items[5][1]), (300, items[6][1])]
    return docs + [(d, t) for d, t, *_ in hard_rows()], items


@pytest.mark.parametrize(("seed", "cells"), [(1, 1 << 22), (2, 16)])
def test_against_every_window(spark, seed, cells):
    docs, items = cases(random.Random(seed))
    assert run(spark, docs, items, cells=cells) == expected(docs, items)


def test_sizes(spark):
    docs, items = cases(random.Random(3))
    assert run(spark, docs, items, size=4) == expected(docs, items, 4)


def test_long_text_and_hot_passage(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    long = " ".join(rng.choice(WORDS) for _ in range(20_000))
    docs = [(k, f"x{k} {passage} y{k}") for k in range(400)] + [(1000, long + " " + passage + " " + long), (1001, passage * 50)]
    items = [(1, passage), (2, "begin of it " + passage[:90]), (3, long[:500])]
    assert run(spark, docs, items) == expected(docs, items)


def test_empty(spark, empty, hard):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(empty, none).count() == 0
    assert {(r.n_hit, r.contaminated) for r in decontaminate.contamination(hard, none).collect()} == {(0, False)}
    assert decontaminate.without_contaminated(hard, none).count() == hard.count()
    with pytest.raises(ValueError):
        decontaminate.contamination(hard, none, size=70)


def test_documents_that_stay(spark, hard):
    items = spark.createDataFrame([(1, hard_rows()[8][1], "", 0)], ITEMS)
    left = decontaminate.without_contaminated(hard, items)
    assert left.columns == hard.columns
    assert 8 not in {r.doc_id for r in left.collect()}
