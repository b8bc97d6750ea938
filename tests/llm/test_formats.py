"""Packing, chat formatting, WARC, and the pipeline."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridweave.llm import chat, mixing, packing, warc
from gridweave.llm.scratch import Scratch

from .conftest import WORDS, hard_rows
from .test_dedup import SPACE, near_expected
from .test_features import counts


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def checked(rows, got, limit):
    """got holds every token of rows once, in sequences without gaps."""
    want = sorted(((str(r[0]), zlib.crc32(np.array(i, "<u4").tobytes()) if len(i) <= limit else None, len(i)) for r, i in zip(rows, reference_ids([r[1] or "" for r in rows]), strict=True)), key=str)
    assert sum(r.length for r in got) == sum(w[2] for w in want)
    whole = {(str(r.doc_id), r.ids_crc32, r.length) for r in got if r.length < limit and r.piece == 0 and r.start == 0}
    assert {w for w in want if w[1] is not None and w[2] < limit} <= whole
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_packed(hard, empty):
    got = packing.packed(hard).collect()
    n = checked(hard_rows(), got, 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) + 1
    small = packing.packed(hard, 64).collect()
    checked(hard_rows(), small, 64)
    by_doc = defaultdict(list)
    for r in small:
        by_doc[r.doc_id].append(r)
    for r in (r for rows in by_doc.values() for r in rows if len({x.piece for x in rows}) == len(rows)):
        assert r.length == 64 or r.piece == 0
        assert r.start == sum(x.length for x in by_doc[r.doc_id] if x.piece < r.piece)
    assert packing.packed(empty).count() == 0


def test_piece_crc(spark):
    text = "word " * 3000
    df = spark.createDataFrame([(5, text)], "doc_id long, text string")
    ids = np.array(reference_ids([text])[0], "<u4")
    for r in packing.packed(df).collect():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    with_ids = packing.token_pieces(df, 2048, with_ids=True).orderBy("piece").collect()
    assert [i for r in with_ids for i in r.ids] == ids.tolist()


def test_ids_are_the_tokenizers_own():
    rng = random.Random(1)
    alphabet = "ab Cz  \n\t'é ß漢😀1279.,;!?<|>_-\u00a0\u2028\u0301ñÑ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) for _ in range(400)] + ["<|endoftext|>", "it's we'LL don't", "  a   b\n\n c "]
    texts += ["hello <|endoftext|> you", "a<|endoftext|><|endoftext|>b", "<|endoftext| >", " <|endoftext|>  x", "<|<|endoftext|>|>"]
    assert [[*packing.token_ids(t), 0] for t in texts] == reference_ids(texts)
    assert packing.token_ids("hello <|endoftext|> you") == [31373, 220, 50256, 345]


def test_long_texts_are_cut_where_no_token_spans(monkeypatch):
    text = "some words in a row, and more of them " * 100 + "<|endoftext|>" + " and again words of a text" * 300 + "\n" * 300 + "x" * 300
    whole = packing.token_ids(text)
    assert [*whole, 0] == reference_ids([text])[0]
    monkeypatch.setattr(packing, "SLICE", 100)
    assert packing.token_ids(text) == whole


def test_plan_uses_all():
    rng = random.Random(3)
    for limit in (10, 64, 300):
        for _ in range(20):
            histogram = {rng.randrange(1, limit + 1): rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))}
            combos = packing.plan(dict(histogram), limit)
            used = defaultdict(int)
            for lengths, times in combos:
                assert sum(lengths) <= limit
                for n in lengths:
                    used[n] += times
            assert dict(used) == histogram
    assert sum(t for _, t in packing.plan({1000: 6, 1048: 6, 2048: 2, 700: 3, 648: 3}, 2048)) == 2 + 6 + 1 + 1


def test_plan_leaves_no_exact_sum():
    """No one, two, three or four pieces of sequences that aren't full would fill one; hot lengths meet whatever is beside them."""
    from itertools import combinations_with_replacement

    rng = random.Random(6)
    for limit in (24, 60):
        for _ in range(40):
            histogram = {rng.randrange(1, limit + 1): rng.choice((1, 1, 2, 3, 40)) for _ in range(rng.randrange(1, 40))}
            rest = defaultdict(int)
            for lengths, times in packing.plan(dict(histogram), limit):
                if sum(lengths) < limit:
                    for n in lengths:
                        rest[n] += times
            for k in (1, 2, 3, 4):
                for c in combinations_with_replacement(sorted(rest), k):
                    assert sum(c) != limit or any(rest[n] < c.count(n) for n in c)
    rare = [*range(901, 909), *range(925, 933), *range(949, 957), *range(92, 100)]
    histogram = {500: 1000, 524: 1000, **dict.fromkeys(rare, 1)}
    assert sum(t for _, t in packing.plan(histogram, 2048)) <= 500 + len(rare)


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "system", "</s>"), (2, 1, "assistant", "&lt; <s>[INST] x\ny [/INST]</s> &amp;"), (2, 1, "assistant", None), (3, 5, "tool\nwith </s>", " [/INST]</s><s>[INST*] user\nx"),
    (3, 2, None, ""), (None, 1, "user", "no id"), (None, None, "assistant", "no turn &#91;[&"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "é😀 [INST*] " * 50), (6, 0, "user", "[/INST]</s>"), (7, 0, "assistant", " [/INST]"), (8, 0, "assistant", "</"), (8, 1, "assistant", "s>"),
    (9, 0, "user", "x [/INST] y [INST] z <s>"), (10, 0, "user", "[/INST]"), (10, 1, "assistant", "plain"), (11, 0, "assistant", "<s>"), (12, 0, "assistant", "[INST"), (13, 0, "user", "w " * 20_000 + "<s>"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x").repartition(3)
    made = chat.format_conversations(df).cache()
    assert made.filter("not identical").count() == 0
    assert made.filter("level > 0").count() >= 3
    for r in made.filter("conv_id >= 9").collect():  # control strings are escaped also where no turn would end
        texts = [t[t.index("\n") + 1 : -len(chat.CLOSE)] for t in r.formatted.split(chat.END)[:-1]]
        assert r.level == 1 and not any(re.search(chat.CONTROL, t) for t in texts)
    for r in chat.read_back(made).collect():
        rows = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text in CONVERSATIONS if c == r.conv_id)
        said = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        loss = "".join(text for _, role, text in rows if role == "assistant")
        assert r.n_turns == len(rows)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


PAGES = [(3, "http://a/1", "same"), (1, None, "same"), (2, "http://a b/\r\n2", None), (7, "", ""), (None, "u", "same"), (None, None, "alone"), (9, "http://é/ß", "ü" * 100_000), (1, "http://again", "same"), (5, "x", "A\r\n\r\nB\0")]


@pytest.mark.parametrize("least", [0, 4, 5])
def test_warc_round_trip(spark, least):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload_bytes int").repartition(3)
    scratch = Scratch(spark, "test-warc")
    got = warc.read_archives(warc.write_archives(df, f"{scratch.path}/archives", scratch, least)).collect()
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        refers = first if len(body) >= least and first is not None and page != first else None
        want.append((page, len(body), warc.digest(body), "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reader_notices_damage():
    good = [warc.record(1, "http://a", b"x" * 200_000, None), warc.record(2, "http://b", b"", 1)]
    assert [r["record_type"] for r in warc.read_records(io.BytesIO(b"".join(good)))] == ["response", "revisit"]
    plain = zlib.decompress(good[0], 31)
    for broken in (plain.replace(b"xxx", b"xyx", 1), plain + b"more", plain[:-200], plain.replace(b"Content-Length: 200", b"Content-Length: 100", 1)):
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gz.compress(broken) + gz.flush())))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[0][:-5])))


def as_counted(rows):
    return Counter(tuple(map(str, r)) for r in rows)


def test_pipeline_stage_by_stage(spark, tmp_path, monkeypatch):
    """Each stage against brute force on what its predecessor kept: null ids, repeated rows, long texts, clashing columns."""
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "_part", "key", "row", "_doc", "rid", "own_id"]
    rng = random.Random(8)
    base = [rng.choice(WORDS) + str(k) for k in range(90)]
    texts = [r[:2] for r in hard_rows()] + [(500 + k, " ".join([*base[k:], *(f"x{k}y{i}" for i in range(k))])) for k in range(6)] + [(600, " ".join(base) + "  "), (None, " ".join(base)), (601, " ".join(f"l{i}" for i in range(20_000)))]
    rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, None, 7, "x", k, "d", 4, None) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _part int, key string, row long, _doc string, rid int, own_id long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = stages[name](spark, df, str(tmp_path))
        assert name == "packing" or out.columns == names
        return out

    def failed(text):
        n, _, _, _, repeated = counts(text)
        return n < 50 or 100 * repeated > 50 * n

    docs = run("quality rules", spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = [r for r in rows if not failed(r[1])]
    assert as_counted(docs.collect()) == as_counted(kept)

    docs = run("exact dedup", docs)
    by_text = defaultdict(list)
    for r in kept:
        by_text[SPACE.sub(" ", r[1])].append(r)
    got = docs.collect()
    assert sorted(SPACE.sub(" ", r.text) for r in got) == sorted(by_text)
    for r in got:
        same = by_text[SPACE.sub(" ", r.text)]
        assert tuple(r) in same and r.doc_id == min((x[0] for x in same if x[0] is not None), default=None)

    before = [tuple(r) for r in got]
    docs = run("near dedup", spark.createDataFrame(before, schema))
    heads = {e[2] for e in near_expected(before)}
    got = docs.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, heads))
    assert all(tuple(r) in before for r in got)

    before = [tuple(r) for r in got]
    docs = run("mixing", spark.createDataFrame(before, schema))
    copies = as_counted(docs.collect())
    assert set(copies) <= set(as_counted(before)) and max(copies.values()) <= 3
    taken = mixing.mix(spark.createDataFrame(before, schema)).collect()
    assert sum(copies.values()) == sum(r.copies for r in taken)
    assert sum(int(r.taken) for r in taken) == sum(len(r.text.split()) for r in docs.collect())

    before = [tuple(r) for r in docs.collect()]
    checked(before, run("packing", spark.createDataFrame(before, schema)).collect(), 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    checked(before, whole, 2048)

    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
