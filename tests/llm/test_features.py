"""Quality rules, mixing, toxicity, URL filters."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from gridweave.llm import mixing, quality_rules, toxicity, url_filter

from .conftest import hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_counts(spark, hard):
    got = quality_rules.features(hard, ["doc_id"]).collect()
    want = sorted(((r[0], *counts(r[1])) for r in hard_rows()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    texts = ["a b c a b c", "a a a a", "x a b c y a b c z", "#*$ %&| <>é\n\n#*$ %&| <>é\n \n ", "a b c b c a b c b", "ein 😀 zwei 😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.features(df, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [counts(t) for t in texts]


def test_judged(hard, empty, labels):
    got = quality_rules.judged(hard, labels).collect()
    assert len(got) == len(hard_rows())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judged(empty, labels).count() == 0
    assert quality_rules.judged(hard, labels.limit(0)).filter("kept = base_failed").count() == 0
    kept = quality_rules.keep_good(hard, labels)
    assert kept.columns == hard.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_judged_long_texts_under_a_filter(spark, labels):
    """Whatever is filtered, a text of 20,000 words takes seconds."""
    words = [f"w{i}" for i in range(20_000)]
    df = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:19_000] * 2)), (9, None)], "doc_id long, text string")
    begin = time.monotonic()
    judged = quality_rules.judged(df, labels)
    assert sorted(r.doc_id for r in judged.filter("kept").collect()) == [r.doc_id for r in judged.orderBy("doc_id").collect() if r.kept]
    assert judged.filter("n_repeat_words > 10 and not kept and rule is null").count() == 1
    assert quality_rules.keep_good(df, labels).filter("length(text) > 10").count() <= 1
    assert time.monotonic() - begin < 60
    assert [tuple(r)[1:6] for r in judged.orderBy("doc_id").collect()] == [counts(r.text) for r in df.orderBy("doc_id").collect()]


def test_learns_a_conjunction(spark):
    rows = [(i, (i * 37) % 100 / 100, (i * 53) % 97 / 97) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double").withColumn("bad", ((F.col("a") > 0.7) & (F.col("b") <= 0.4)).cast("long"))
    rules = quality_rules.learn(df, ["a", "b"])
    judged = df.withColumn("rule", quality_rules.emit(rules))
    wrong = judged.filter((F.col("bad") == 1) != F.col("rule").isNotNull()).count()
    assert wrong < 60, [str(c) for r in rules for c in r]
    assert quality_rules.learn(df.filter("bad = 0"), ["a", "b"]) == []


def shares(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weigh[s] for s in names if s not in full)
        now = {s for s in names if s not in full and rest and left * weigh[s] / rest > most * sizes[s] + 1e-9}
        if not now:
            return {s: most * sizes[s] if s in full else left * weigh[s] / rest for s in names}
        full |= now


def test_mix_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 50, None: 400, "é": 7, "z": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def test_mix(hard, empty):
    got = mixing.mix(hard).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in hard_rows())
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    again = mixing.mix(hard.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    copies = mixing.mixed_documents(hard)
    assert copies.columns == hard.columns
    assert sum(len(WORD.findall(r.text or "")) for r in copies.collect()) == sum(r.taken for r in got)


def by_source(got, rows):
    source = {r[0]: r[2] for r in rows}
    taken, target = defaultdict(int), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    return {s: (taken[s], t) for s, t in target.items()}


def test_mix_is_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * i) % 41 + (3000 if i % 400 == 0 else 0))), f"s{i % 7}" if i % 3 else "s0") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for taken, target in by_source(got, rows).values():
        assert abs(taken - target) <= 2


def test_mix_draws_equal_rows_apart(spark):
    rows = [(7, "a b c d", "s0")] * 500 + [(8, "a b", "s1")] * 300 + [(9, "c", "s2")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for taken, target in by_source(mixing.mix(df).collect(), rows).values():
        assert abs(taken - target) <= 4
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in mixing.mix(df).collect())


def chances(sizes, due, power):
    """Inclusion probabilities by raising the factor until what is expected is due."""
    fit, sure = [n for n in sizes if n <= due], set()
    while True:
        c = (due - sum(fit[k] for k in sure)) / sum(n ** (1 + power) for k, n in enumerate(fit) if k not in sure)
        now = {k for k, n in enumerate(fit) if k not in sure and c * n**power >= 1}
        if not now:
            return [0 if n > due else min(1, c * n**power) for n in sizes]
        sure |= now


def test_mix_includes_as_often_as_it_should(spark):
    """Each of many sources has documents of the same sizes, so inclusion shares over sources are those over seeds."""
    sizes, sources = [1 + (k * k) % 60 for k in range(80)] + [120, 150, 200], 300
    rows = [(1000 * s + k, " ".join(["w"] * n), f"{s:04}") for s in range(sources) for k, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 7), power=0.5).collect()
    for even in (True, False):
        own = [r for r in got if (r.doc_id // 1000 % 2 == 0) == even]
        due, whole = own[0].target % sum(sizes), own[0].target // sum(sizes)
        taken = Counter()
        for r in own:
            taken[r.doc_id % 1000] += r.copies - whole
        want = chances(sizes, due, 0.5)
        assert any(p == 1 for p in want) == (not even)
        assert len({round(p, 3) for p in want}) > 10
        apart = [taken[k] / (sources / 2) - p for k, p in enumerate(want)]
        # Two documents a source round, so shares may be that much off beside chance.
        assert max(map(abs, apart)) < 0.15
        assert sum(map(abs, apart)) / len(apart) < 0.05


def test_toxicity(spark, hard, empty, labels):
    rude, plain = ["scumlo", "scumma", "moronish", "idiotic"], [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(plain[(i * k) % 40] for k in range(1, 30)) + (f" {rude[i % 4]}x{i % 3} {rude[(i + 1) % 4]}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("toxic")
    truth = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = toxicity.scored(docs, truth).join(truth, "doc_id").filter("held_out").collect()
    assert len(got) > 80
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = toxicity.scored(hard, labels).collect()
    assert len(odd) == len(hard_rows()) and all(r.score is not None for r in odd)
    assert toxicity.scored(empty, labels).count() == 0
    assert toxicity.scored(hard, labels.limit(0)).filter("predicted = 1").count() == 0


def em_expected(votes, q, rounds):
    """The label model by loops over rows, for trees that it finds itself by the same mutual information."""
    n, width = len(votes), len(votes[0])
    for _ in range(rounds):
        prior = (sum(q) + 1) / (n + 2)
        shared = [[0.0] * width for _ in range(width)]
        for weight in (q, [1 - x for x in q]):
            total = sum(weight)
            one = [(sum(w for w, v in zip(weight, votes, strict=True) if v[j]) + 0.5) / (total + 1) for j in range(width)]
            for j in range(width):
                for k in range(width):
                    both = (sum(w for w, v in zip(weight, votes, strict=True) if v[j] and v[k]) + 0.25) / (total + 1)
                    for joint, apart in ((both, one[j] * one[k]), (one[j] - both, one[j] * (1 - one[k])), (one[k] - both, one[k] * (1 - one[j])), (1 - one[j] - one[k] + both, (1 - one[j]) * (1 - one[k]))):
                        joint = min(max(joint, 1e-9), 1)
                        shared[j][k] += total / n * joint * math.log(joint / apart) if j != k else 0
        parent, inside = [-1] * width, [0]
        while len(inside) < width:
            gain, j, k = max((shared[j][k], -inside.index(j), -k) for j in inside for k in range(width) if k not in inside)
            j, k = inside[-j], -k
            parent[k] = j if gain > toxicity.LINKED else -1
            inside.append(k)
        odds = [math.log(prior / (1 - prior))] * n
        for j in range(width):
            for a in (0, 1):
                at = [i for i in range(n) if (votes[i][parent[j]] if parent[j] >= 0 else 0) == a]
                rate = []
                for weight in ([1 - x for x in q], q):
                    alone = (sum(weight[i] for i in range(n) if votes[i][j]) + 0.1) / (sum(weight) + 0.2)
                    rate.append((sum(weight[i] for i in at if votes[i][j]) + toxicity.ROWS * alone) / (sum(weight[i] for i in at) + toxicity.ROWS))
                for i in at:
                    odds[i] += math.log(rate[1] / rate[0]) if votes[i][j] else math.log((1 - rate[1]) / (1 - rate[0]))
        q = [1 / (1 + math.exp(-max(min(o, 30), -30))) for o in odds]
    return q, parent


def simulated(n, seed=1):
    """Rows of a hidden class with five voters of different accuracy, the last two copying the third most of the time."""
    rng = random.Random(seed)
    truth, votes = [], []
    for _ in range(n):
        y = rng.random() < 0.3
        own = [rng.random() < (a if y else b) for a, b in ((0.8, 0.1), (0.7, 0.15), (0.6, 0.3))]
        truth.append(y)
        votes.append([*own, *(own[2] if rng.random() < 0.9 else rng.random() < 0.4 for _ in range(2))])
    return truth, votes


def test_label_model_is_what_loops_make():
    _, votes = simulated(80)
    begin = [0.9 if sum(v) > 1 else 0.1 for v in votes]
    q, rates, parent = toxicity.label_model(np.array(votes), np.array(begin), 3)
    want, _ = em_expected(votes, begin, 3)
    assert q == pytest.approx(want)


def test_label_model_finds_accuracies_and_correlations():
    truth, votes = simulated(4000)
    q, rates, parent = toxicity.label_model(np.array(votes), np.array([0.9 if sum(v[:2]) > 1 else 0.1 for v in votes]), 30)
    edges = {frozenset((j, int(p))) for j, p in enumerate(parent) if p >= 0}
    assert frozenset((2, 3)) in edges and frozenset((2, 4)) in edges
    right = sum((x >= 0.5) == y for x, y in zip(q, truth, strict=True))
    most = sum((sum(v) >= 3) == y for v, y in zip(votes, truth, strict=True))
    assert right > most and right > 0.8 * len(truth)


def test_posteriors_come_from_votes_alone(spark):
    """Rows with the same votes get the same score whatever their labels, also where a label is wrong."""
    rude, plain = ["scumlo", "scumma", "moronish", "idiotic"], [f"w{i}" for i in range(40)]
    say = lambda i, n: " ".join(plain[(i * k) % 40] for k in range(1, 30)) + "".join(f" {rude[(i + k) % 4]}" for k in range(n))
    rows = [(i, say(i, 2 if i % 4 == 0 else 0), int(i % 4 == 0)) for i in range(500)]
    wrong = {i for i, *_ in rows if i % 29 == 0}
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    truth = spark.createDataFrame([(i, 1 - t if i in wrong else t) for i, _, t in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, truth).collect()}
    assert sum(got[i] == t for i, _, t in rows) >= 0.99 * len(rows)


def url_expected(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = [
    None, "", "no scheme", "http://", "http://a.COM", "http://a.com/", "https://WWW.Example.com/en/1", "http://example.com/en/", "http://x.example.com/en", "http://b.net/es/1?x=/fr/", "http://net/fr/2#a", "http://xnet/fr/2",
    "ftp://a.org/p/1.html", "http://a.org/p/2.html", "http://a.org//q///7/8/9/10", "x://y://z/a", "http://É.com/é/ß", "http://a.org/p\n/1", "http://a.org?q=http://b.com/", "http://a.org" + "/long" * 500,
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, None, 3) for i, u in enumerate(URLS)] + [(0, None, None, 3)], "page_id long, url string, html string, host int")
    got = url_filter.judged_urls(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule = url_expected(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict if r.rule else None) == (rule or (None, None))
        assert r.verdict in ("allow", "block")
    assert url_filter.judged_urls(df.limit(0)).count() == 0


def test_url_templates(spark):
    """Templates with mostly blocked labels reject the others like them; similar branches are merged, others not."""
    rows = [(f"http://h.org/{s}/{i}.html", s) for s in ("ads", "promo", "news", "blog") for i in range(60)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(u, int(s in ("ads", "promo"))) for k, (u, s) in enumerate(rows) if k % 3], "url string, blocked int")
    got = {}
    for r in url_filter.judged_urls(pages, (), labels).collect():
        got[rows[r.page_id][1]] = (r.verdict, r.template)
    assert {k: v[0] for k, v in got.items()} == {"ads": "block", "promo": "block", "news": "allow", "blog": "allow"}


def test_url_slugs_and_deep_paths(spark):
    """Slugs of a page each are pooled, also below each other; good and bad branches differ in the fourth segment."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(f"http://bad.org/{word(i)}-slug", "bad") for i in range(60)] + [(f"http://good.org/{word(i)}-slug", "good") for i in range(60)]
    rows += [(f"http://two.org/{word(i)}/{word(i)}-slug", "bad") for i in range(40)]
    rows += [(f"http://deep.org/a/b/c/{s}/{word(i)}", k) for s, k in (("ads", "bad"), ("news", "good")) for i in range(60)]
    rows += [(f"http://mix.org/{word(i)}-slug", "bad") for i in range(40)] + [(f"http://mix.org/news/{i}", "good") for i in range(40)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(u, int(s == "bad")) for k, (u, s) in enumerate(rows) if k % 2], "url string, blocked int")
    got = url_filter.judged_urls(pages, (), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        url, kind = rows[r.page_id]
        assert (url, r.verdict) == (url, "block" if kind == "bad" else "allow")
    assert {r.template for r in got if r.host == "deep.org"} == {"/a/b/c/ads/*", "/a/b/c/news/*"}


def tree_expected(urls):
    """(template, purity) by host and path for urls of (host, path, blocked or None), by plain loops."""
    labels = defaultdict(list)
    for host, path, blocked in urls:
        labels[host, tuple(x for x in path.split("/") if x)].append(blocked)
    count = {leaf: (sum(x is not None for x in v), sum(x or 0 for x in v)) for leaf, v in labels.items()}
    template = {leaf: leaf[1] for leaf in count}

    def nodes():
        paths, m, b = Counter(), Counter(), Counter()
        for leaf, t in template.items():
            for d in range(len(t) + 1):
                node = (leaf[0], t[:d])
                paths[node] += 1
                m[node] += count[leaf][0]
                b[node] += count[leaf][1]
        return paths, m, b

    def star(wild, first):
        changed = False
        for leaf, t in template.items():
            depths = [d for d in range(len(t)) if (leaf[0], t[: d + 1]) in wild]
            if depths:
                d = depths[0] if first else depths[-1]
                template[leaf], changed = (*t[:d], "*", *t[d + 1 :]), True
        return changed

    while True:
        paths, *_ = nodes()
        few = [n for n in paths if n[1] and n[1][-1] != "*" and paths[n] < url_filter.PATHS]
        siblings = Counter((h, t[:-1]) for h, t in few)
        if not star({n for n in few if siblings[n[0], n[1][:-1]] >= url_filter.VARY}, True):
            break
    while True:
        paths, m, b = nodes()
        sure = [n for n in paths if n[1] and m[n] >= url_filter.SUPPORT]
        groups = defaultdict(list)
        for h, t in sure:
            groups[h, t[:-1]].append((h, t))
        wild = set()
        for own in groups.values():
            p = (sum(b[n] for n in own) + 1) / (sum(m[n] for n in own) + 2)
            like = [n for n in own if len(own) > 1 and abs(b[n] - m[n] * p) <= url_filter.SIGMAS * (m[n] * p * (1 - p)) ** 0.5 + 0.5]
            wild |= {n for n in like if len(like) > 1 and n[1][-1] != "*"}
        if not star(wild, False):
            break
    _, m, b = nodes()
    total = [sum(x) for x in zip(*count.values(), strict=True)]
    out = {}
    for leaf, t in template.items():
        p, supported = total[1] / total[0] if total[0] else 0, False
        for d in range(len(t) + 1):
            node = (leaf[0], t[:d])
            others = [n for n in m if n[1] == t[:d] and n[0] != leaf[0]]
            xm, xb = sum(m[n] for n in others), sum(b[n] for n in others)
            if d and xm >= url_filter.SUPPORT:
                p, supported = (p + xb / xm) / 2, True
            supported |= m[node] >= url_filter.SUPPORT and (d > 0 or not t)
            p = (b[node] + url_filter.SMOOTHING * p) / (m[node] + url_filter.SMOOTHING)
        out[leaf] = ("/" + "/".join(t), p, supported)
    return out


def test_url_tree_is_what_loops_make(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(900):
        host = rng.choice(["a.org", "b.org", "b.org", "c.org"])
        kind = rng.choice(["ads", "news", "item", "u"])
        deep = {"ads": f"/ads/{rng.randrange(400)}", "news": f"/news/{rng.choice(['x', 'y', 'z'])}/{rng.randrange(60)}.html", "item": f"/{rng.randrange(200)}/item", "u": f"/u/{rng.randrange(30)}/{rng.choice(['p', 'q'])}"}[kind]
        bad = kind == "ads" or kind == "u" and host == "b.org" or kind == "news" and "/x/" in deep
        rows.append((host, deep, (int(bad) if rng.random() < 0.95 else 1 - int(bad)) if rng.random() < 0.5 and host != "c.org" else None))
    rows += [("d.org", "/s" * 300, 1), ("d.org", "/s" * 300 + "/t", None), (" ", "", None)]
    known = {}
    rows = [(h, p, known.setdefault((h, p), x)) for h, p, x in rows]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(rows)], "page_id long, url string").repartition(4)
    labels = spark.createDataFrame([(f"http://{h}{p}", x) for (h, p), x in known.items() if x is not None], "url string, blocked int")
    want = tree_expected(rows)
    got = url_filter.judged_urls(pages, (), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        template, purity, supported = want[r.host, tuple(x for x in r.path.split("/") if x)]
        assert r.template == template and r.purity == pytest.approx(purity)
        assert r.verdict == ("block" if purity >= url_filter.REJECT and supported else "allow")
    assert len({r.verdict for r in got}) == 2 and len({round(r.purity, 6) for r in got}) > 5


def test_mixed_documents_of_one_key_agree_on_reruns(spark):
    """Rows that only other columns tell apart: the same ones are copied, however they are read."""
    rows = [(1, "word " * 9, "s", f"x{k}", {"a": k}) for k in range(30)] + [(k, "other words " * k, f"s{k % 3}", "y", None) for k in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other string, more map<string,int>")
    taken = [sorted((r.doc_id, r.other) for r in mixing.mixed_documents(df.repartition(n)).collect()) for n in (2, 5)]
    assert taken[0] == taken[1]
    assert 0 < sum(k == 1 for k, _ in taken[0]) and len(taken[0]) == sum(r.copies for r in mixing.mix(df).collect())


def covering(rows, names):
    """The decision list by sequential covering in plain loops; rows are dicts with bad, apart and the numbers of names."""
    q = quality_rules
    steps = [i / q.QUANTILES for i in range(q.QUANTILES)] + [0.98, 0.995, 1.0]
    cuts = {}
    for name in names:
        seen = set()
        for bad in (0, 1):
            own = sorted(r[name] for r in rows if r["bad"] == bad)
            seen |= {own[max(math.ceil(s * len(own)) - 1, 0)] for s in steps}
        seen = sorted(seen)
        cuts[name] = [(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)]
    fits = lambda r, rule: all((r[f] > t) == above for f, above, t in rule)
    rules = []
    while len(rules) < q.RULES:
        left = [r for r in rows if not any(fits(r, rule) for rule in rules)]
        rule = ()
        while len(rule) < q.CONDITIONS:
            here = [r for r in left if not r["apart"] and fits(r, rule)]
            bad, best, most = sum(r["bad"] for r in here), None, 1e-9
            if not bad or bad == len(here):
                break
            for name in names:
                for t in cuts[name]:
                    for above in (True, False):
                        own = [r["bad"] for r in here if (r[name] > t) == above]
                        if sum(own) and len(own) < len(here):
                            gain = sum(own) * (math.log2(sum(own) / len(own)) - math.log2(bad / len(here)))
                            if gain > most + 1e-12:
                                best, most = (name, above, t), gain
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        worth = []
        for k in range(len(rule)):
            own = [r["bad"] for r in left if r["apart"] and fits(r, rule[: k + 1])]
            p, n = sum(own), len(own)
            worth.append(((2 * p - n) / n if n else -1.0, -k, (p + 1) / (n + 2) >= q.PURITY or n > 0 and p == n))
        _, k, enough = max(worth)
        if not enough:
            break
        rules.append(rule[: 1 - k])
    return rules


def test_the_list_is_what_loops_learn(spark):
    rng = random.Random(12)
    rows = []
    for k in range(700):
        a, b, c = (float(rng.randrange(8)) for _ in range(3))
        bad = int(a >= 6 and b <= 2 or c == 7)
        rows.append((k, bad if rng.random() > 0.01 else 1 - bad, a, b, c))
    names = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "doc_id long, bad long, a double, b double, c double").repartition(3)
    told = df.withColumn("apart", F.pmod(F.xxhash64("doc_id"), F.lit(quality_rules.APART)) == 0).collect()
    want = covering([r.asDict() for r in told], names)
    got = [tuple((c.feature, c.above, c.threshold) for c in rule) for rule in quality_rules.learn(df, names)]
    assert got == want and len(got) >= 2 and max(map(len, got)) >= 2
    kept = {r.doc_id: r["n"] for r in df.withColumn("n", quality_rules.emit(quality_rules.learn(df, names))).collect()}
    for k, _, *values in rows:
        r = dict(zip(names, values, strict=True))
        covers = [i for i, rule in enumerate(want) if all((r[f] > t) == above for f, above, t in rule)]
        assert kept[k] == (covers[0] if covers else None)


def test_the_classifier_is_at_its_optimum():
    """At the weights found, the slope of the ridge logistic loss, summed in plain loops, is zero."""
    rng = random.Random(2)
    n, width = 300, 12
    has = [sorted({rng.randrange(width) for _ in range(rng.randrange(6))}) for _ in range(n)]
    target = [min(max(rng.gauss(0.9 if 3 in h or 7 in h else 0.1, 0.1), 0.0), 1.0) for h in has]
    rows, columns = np.array([i for i, h in enumerate(has) for _ in h]), np.array([j for h in has for j in h])
    w, bias = toxicity._fit(rows, columns, n, width, np.array(target))
    slope = [toxicity.RIDGE * float(w[j]) for j in range(width)]
    rest = 1e-6 * bias
    for h, t in zip(has, target, strict=True):
        p = 1 / (1 + math.exp(-(bias + sum(float(w[j]) for j in h))))
        rest += p - t
        for j in h:
            slope[j] += p - t
    assert max(map(abs, [*slope, rest])) < 1e-3
    assert w[3] > 1 and w[7] > 1
