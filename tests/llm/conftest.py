import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _part int, key string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("bel", "dor", "fan", "gis", "hum", "jet", "kol", "mar", "nit", "pos")]


def hard_rows():
    """Nulls in every column, empty and white texts, ties, repeated rows, one long text, near copies; clashing extra columns."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [rng.choice(WORDS) for _ in range(120)]
    texts = [None, "", " \t\n", "one", "two words", "a b c d e", "A  b\tC d e", say(300), say(60), say(3000)]
    for k in range(12):
        words = list(base)
        for i in range(k):
            words[(i * 37 + k) % 120] = f"new{k}x{i}"
        texts.append(" ".join(words))
    texts += [texts[7], texts[7] + " ", "line one is here and there\nline two stands\n\nline one is here and there", "line two stands\nother line of this text\nLINE ONE is here and there"]
    texts += ["  ".join(base[:40]) + "\n" + " ".join(base[40:]), "<|endoftext|> é ü 漢字 " + say(5)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None, 7, "x") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (3, "another text of three", None, "s1", 1, None, None), (None, "no id at all", None, None, None, None, None), (None, texts[8], None, "s1", None, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0), (8, 0, 1), (8, 0, 1), (9, None, None), (999, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
