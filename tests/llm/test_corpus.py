"""Near-duplicates, repeats, the language model, classifiers and the pipeline against plain Python."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, jaccard, katz, neighbours, suffixes, toxicity, urls

DOC = "doc_id long, text string, cls string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC).repartition(3)


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = brute.components(400, links)
    assert all(want[k] == v for k, v in got.items()) and len(got) == len({x for a, b in links if a != b for x in (a, b)})


def test_jaccard_components(spark):
    rnd = random.Random(2)
    texts = [None, "", "  ", "one", "ONE", "a b c", "A  b\tc"]
    for n in (5, 6, 8, 9, 12, 20, 60, 200):
        base = [rnd.choice("the of and to in".split()) + str(rnd.randrange(900)) for _ in range(n)]
        for cut in (0, 0, 1, 2, n // 12, n // 8, n // 6, n // 5):
            w = list(base)
            for _ in range(cut):
                w[rnd.randrange(n)] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(w[: n - rnd.randrange(1 + n // 10)]))
    sets = [brute.shingles(t) for t in texts]
    links = [
        (a, b) for a in range(len(texts)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, brute.components(len(texts), links), strict=True))}
    frame = docs(spark, texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(frame).collect()} == want
    twice = jaccard.link_classes(frame.unionByName(frame)).collect()
    assert len(twice) == 2 * len(texts) and {r.doc_id: (r.n_shingles, r.component_id) for r in twice} == want
    assert jaccard.link_classes(frame.limit(0)).count() == 0


def test_repeats(spark):
    rnd = random.Random(3)
    passage = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice((90, 100, 130, 400)))) for _ in range(6)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 350, "é" * 130]
    for _ in range(50):
        texts.append("".join(rnd.choice([*passage, "".join(rnd.choice("abcdefgh") for _ in range(40))]) for _ in range(rnd.randint(1, 5))))
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    want = brute.repeats(rows)

    def result(frame):
        return {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in suffixes.remove_repeats(frame).collect()}

    frame = docs(spark, texts)
    assert result(frame) == want
    assert result(frame.unionByName(frame)) == want  # repeated rows are one document
    assert suffixes.remove_repeats(frame.limit(0)).count() == 0


def test_repeats_of_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    rnd = random.Random(4)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(140))
    texts = ["".join(rnd.choice("ijklmnop") for _ in range(60)) + line + str(i) * 50 for i in range(12)]
    want = brute.repeats([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    got = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(docs(spark, texts)).collect()}
    assert got == {k: v[3] for k, v in want.items()}


def test_interval_tree_finds_maximal_repeats():
    rnd = random.Random(5)
    one = bytes(rnd.choice(b"abcdefgh") for _ in range(120))
    contexts = [b"xx" + one + b"12345", b"yy" + one + b"12399", one[:110] + b"zzzzzzzzzzzz"]
    windows = np.array([len(c) - 99 for c in contexts])
    found = {(n, len(at)) for n, at in suffixes.suffix_index(contexts, windows).maximal()}
    assert found == {(123, 2), (110, 3)}


def test_maximal_repeats_equal_brute_force(spark):
    rnd = random.Random(11)
    one, two = ("".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (1000, 260))
    texts = [one, one, "x" + one[200:700] + "y" + two, two + one[:300], two + two, "q" * 130, None, "short"]
    data = [(t or "").encode() for t in texts]
    places = {}
    for d, t in enumerate(data):
        for i in range(len(t) - 99):
            places.setdefault(t[i : i + 100], []).append((d, i))
    want = set()
    for own in places.values():
        for x, (d, i) in enumerate(own):
            for e, j in own[:x]:
                if i and j and data[d][i - 1] == data[e][j - 1]:
                    continue
                n = 100
                while i + n < len(data[d]) and j + n < len(data[e]) and data[d][i + n] == data[e][j + n]:
                    n += 1
                word = data[d][i : i + n]
                want.add((n, frozenset(p for p in own if data[p[0]][p[1] : p[1] + n] == word)))
    groups = {}
    for r in suffixes.maximal_repeats(docs(spark, texts)).collect():
        groups.setdefault((r.anchor, r.repeat, r.length), []).append((r.doc_id, r.at))
    assert all(len(v) == len(set(v)) for v in groups.values())
    assert sorted((k[2], sorted(v)) for k, v in groups.items()) == sorted((n, sorted(v)) for n, v in want)


def test_vectors(spark):
    rnd = np.random.default_rng(6)
    base = rnd.standard_normal((40, 16))
    vectors = [(v + rnd.standard_normal(16) * 0.03 * (k % 3)).tolist() for v in base for k in range(4)]
    rows = [(i, v, i % 2 if i % 7 else 0) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, rows[0][1], None), (2005, [1.0], 1), (2006, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(3)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    roots = brute.components(len(rows), np.argwhere(linked).tolist())
    want = {r[0]: (int(n), rows[c][0]) for r, n, c in zip(rows, linked.sum(1), roots, strict=True)} | {r[0]: (0, r[0]) for r in odd}
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert got == want
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_vectors_that_no_bucket_brings_together(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    hot = rnd.standard_normal(16) + rnd.standard_normal((60, 16)) * 0.01
    pair = rnd.standard_normal(16) + rnd.standard_normal((2, 16)) * 0.01
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*hot, *pair])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    start = neighbours.start_edges
    # The links of the pair are under a thousandth of all links.
    monkeypatch.setattr(neighbours, "start_edges", lambda *a: start(*a).where("u < 60 and v < 60"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert got == {i: (59, 0) for i in range(60)} | {60: (1, 60), 61: (1, 60)}


def test_buckets_go_on_in_the_next_batch(spark):
    rnd = np.random.default_rng(9)
    # All in one bucket of each table, one row to an Arrow batch.
    rows = [(i, 1, "16/0", ((v := np.ones(16) + rnd.standard_normal(16) * 1e-6) / np.linalg.norm(v)).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, copies long, space string, vec array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert neighbours.start_edges(df, 6, 0).count() >= 9
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_language_model(spark):
    rows = brute.rows("documents")
    tokens = {r["doc_id"]: [*r["text"].encode().lower().split(), None] for r in rows}
    counts = Counter(w for k, own in tokens.items() if brute.bucket(k, 5) != 1 for w in own)
    n, v = sum(counts.values()), len(counts)
    for r in katz.op6_katz(spark, brute.DATA).collect():
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert abs(base - r.base_score) < 1e-6 * abs(base) and r.train_tokens == n and r.n_tokens == len(own)
        assert r.n_known == sum(counts[w] > 0 for w in own) and r.score < 0


class Katz:
    """Plain Katz bigrams over lists of words."""

    def __init__(self, texts):
        self.uni = Counter(w for t in texts for w in t)
        self.pairs = Counter(p for t in texts for p in zip([0, *t], t))
        self.total = sum(self.uni.values())
        self.du, self.dp = (katz.good_turing(Counter(c.values())) for c in (self.uni, self.pairs))
        mass = sum(self.kept(n, self.du) for n in self.uni.values()) / self.total
        self.unseen, self.scale = (1 - mass, 1) if mass < 1 - 1e-12 else (1 / (self.total + 1), self.total / (self.total + 1) / mass)
        self.after = {}
        for (h, w), n in self.pairs.items():
            self.after.setdefault(h, {})[w] = n

    def kept(self, n, ratios):
        return n * (ratios[n] if n <= katz.DISCOUNTED else 1)

    def one(self, w):
        return self.kept(self.uni[w], self.du) / self.total * self.scale if w in self.uni else self.unseen

    def two(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.one(w)
        total, given, covered = sum(seen.values()), sum(self.kept(n, self.dp) for n in seen.values()), sum(map(self.one, seen))
        part = given / total if given / total <= 1 - 1e-6 else 1 - 1 / (total + 1)
        return self.kept(seen[w], self.dp) * part / given if w in seen else (1 - part) / (1 - covered) * self.one(w)


def test_language_model_scores_every_word_by_katz_backoff(spark, monkeypatch):
    rows = brute.rows("documents")
    words = {r["doc_id"]: [*r["text"].encode().lower().split(), None] for r in rows}
    plain = Katz([own for k, own in words.items() if brute.bucket(k, 5) != 1])
    # Every history's distribution over words sums to one.
    for h in (0, *list(plain.after)[:40], b"never seen"):
        assert abs(sum(plain.two(h, w) for w in plain.uni) + plain.two(h, b"another") - 1) < 1e-9
    want = {k: sum(math.log10(plain.two(h, w)) for h, w in zip([0, *own], own)) for k, own in words.items()}
    got = {r.doc_id: r for r in katz.op6_katz(spark, brute.DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k].score - want[k]) < 1e-6 * abs(want[k]) for k in want)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # Many buckets, hot words spread over several of them, slices of few texts.
    monkeypatch.setattr(katz, "SHARE", 8000)
    monkeypatch.setattr(katz, "HELD", 3000)
    split = {r.doc_id: r for r in katz.op6_katz(spark, brute.DATA).collect()}
    assert split.keys() == got.keys()
    for k, r in split.items():
        assert abs(r.score - want[k]) < 1e-6 * abs(want[k]) and abs(r.base_score - got[k].base_score) < 1e-6 * abs(r.base_score) and r.n_known == got[k].n_known


def test_language_model_scores_far_more_texts_than_it_learned_from(spark):
    texts = ["a b c d", "a b x", "b c", None]
    plain = Katz([[*(t or "").split(), None] for t in texts])
    frame = docs(spark, [f"a b c {i} " * 200 for i in range(60)] + texts)
    got = {r.doc_id: r.score for r in katz.score(frame, katz.fit(docs(spark, texts))).collect()}
    for i, t in [(r.doc_id, r.text) for r in frame.collect()]:
        own = [*(t or "").split(), None]
        want = sum(math.log10(plain.two(h, w)) for h, w in zip([0, *own], own))
        assert abs(got[i] - want) < 1e-6 * abs(want)


def test_language_model_without_training_and_with_repeated_rows(spark):
    frame = docs(spark, ["a b a", None, "", "a b a"])
    none = katz.score(frame, katz.fit(frame.limit(0))).collect()
    assert [(r.base_score, r.score, r.n_known) for r in none] == [(0, 0, 0)] * 4
    model = katz.fit(frame)
    once = {r.doc_id: r for r in katz.score(frame, model).collect()}
    assert once[0].n_tokens == 4 and once[1].n_tokens == 1 and once[0].score == once[3].score
    twice = katz.score(frame.unionByName(frame), model).collect()
    assert len(twice) == 8 and all(abs(r.base_score - once[r.doc_id].base_score) < 1e-9 for r in twice)


def test_language_model_knows_pairs_of_rare_words(spark, monkeypatch):
    rnd = random.Random(10)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words[i : i + 10]) for i in range(0, 5000, 10)] * 2
    mixed = [" ".join(rnd.sample(t.split(), 10)) for t in texts[:20]]
    frame = docs(spark, texts[:20] + mixed + [f"unheard {texts[0]} w3 w3 w3", "w5 the w5", None])
    model = katz.fit(docs(spark, texts))
    got = {r.doc_id: r.score for r in katz.score(frame, model).collect()}
    assert all(got[i] > got[20 + i] + 5 for i in range(20))
    monkeypatch.setattr(katz, "SHARE", 1500)  # pairs and histories in many buckets
    joined = {r.doc_id: r.score for r in katz.score(frame, katz.fit(docs(spark, texts))).collect()}
    assert joined.keys() == got.keys() and all(abs(joined[k] - got[k]) < 1e-6 for k in got)


def test_toxicity(spark):
    data = [(i, f"this is text number {i} you idiot{'!' * (i % 3)}" if i % 3 == 0 else f"this is text number {i}", int(i % 3 == 0)) for i in range(400)]
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    more = docs(spark, ["such an idiot", "fine words", None, "", "such an id10t", "a" * 10_000])
    got = [r.toxicity for r in toxicity.score(more, model).orderBy("doc_id").collect()]
    assert got[0] >= 0.7 and max(got[1:4]) < 0.7 and all(0 <= x <= 1 for x in got)
    silent = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic").limit(0))
    assert {r.toxicity for r in toxicity.score(more, silent).collect()} == {0.0}


def test_isotonic_never_falls():
    x, y = np.arange(200.0), (np.random.default_rng(1).random(200) < np.arange(200) / 200).astype(float)
    _, levels = toxicity.isotonic(x, y)
    assert (np.diff(levels) >= 0).all()


def test_urls(spark):
    known = {"red": 50, "apple": 40, "farm": 30, "a": 5}
    assert urls.segment("redapplefarm", known, 125) == ["red", "apple", "farm"] and urls.segment("", known, 125) == []
    pages = [
        "http://A.Example.NET/en/1", "https://example.net/de/2", "x://my.example.com/de/3", "x://a.org/fr/", "x://a.org/en/", "net/", None, "",
        "x://net", "x://notexample.com/de/", "x://h?://a/b#c", "x://h.com/p?q", "x://spamfarm.example.com/de/x", "x://spamfarm.com/en/x",
    ]
    frame = spark.createDataFrame([(i, u, f"<p>spam farm {i}</p>", "r") for i, u in enumerate(pages)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in urls.judge(frame).collect()}
    assert [got[i].rule for i in range(10)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None]
    assert (got[0].host, got[0].path, got[0].verdict) == ("a.example.net", "/en/1", "allow") and got[1].verdict == got[2].verdict == "block"
    assert (got[10].host, got[10].path) == ("h", "") and (got[11].host, got[11].path) == ("h.com", "/p")
    assert (got[6].host, got[6].path) == ("", "") and "spam" in got[13].words and "farm" in got[13].words
    assert urls.judge(frame.limit(0)).count() == 0


def test_pipeline(spark):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, brute.DATA).collect()}
    rows = [r for r in brute.rows("documents") if any(map(str.isalpha, r["text"] or ""))]
    sets = [brute.shingles(r["text"]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    first = [r for i, r in enumerate(rows) if brute.components(len(rows), links)[i] == i]
    leaks = brute.leaks(first, brute.rows("benchmark"))
    assert kept == {r["doc_id"] for r in first if not leaks[r["doc_id"]][1]}


def test_pipeline_stages_hold_few_texts_at_once(spark):
    docs = spark.range(200, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('abcdefgh ', 10000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "size"])

    size = spark.conf.get(corpus_pipeline.BATCH)
    spark.conf.set(corpus_pipeline.BATCH, 64 << 20)
    try:
        seen = corpus_pipeline.tidy(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "rows long, size long"))(spark, docs, "").collect()
    finally:
        spark.conf.set(corpus_pipeline.BATCH, size)
    assert sum(r.rows for r in seen) == 200 and max(r["size"] for r in seen) < 8 << 20
