"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The trees, the lexicon and the calibration are fitted on a bounded sample of labelled rows (``SAMPLE``); every text is scored
whole in one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import bucket_of, table
from tidemark.session import written

SAMPLE = 20_000
LEXICON = 4_000
MIN_TOXIC, MIN_RATIO = 4, 15.0
STEMS = (4, 5, 6)
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 3, 0.2, 32, 20, 1.0
TOXIC = 0.7
MEMO = 200_000
WORD = re.compile(r"[^\W_](?:[^\s.,;:!?]*[^\W_])?")
PLAIN = str.maketrans("013457@$", "oieastas")
# Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti su".split())
FEATURES = (
    "hits_per_word", "log_hits", "weight_per_word", "strongest", "second_person", "second_person_near_hit", "capitals",
    "shouted_words", "exclamations", "questions", "punctuation", "obfuscated", "disguised_hits", "log_words",
)


def stems(word: str) -> set[str]:
    """The word itself, marked as whole, and its beginnings."""
    return {word + "$"} | {word[:n] for n in STEMS if len(word) > n}


@dataclass
class Lexicon:
    weight: dict[str, float]
    memo: dict[str, float] = field(default_factory=dict)

    def of(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = max((self.weight.get(s, 0.0) for s in stems(word)), default=0.0)
        return found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """One value for each of FEATURES; an empty or null text has zeros."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = max(len(words), 1), max(len(text), 1)
    hits, weight, strongest, second, near, shouted, odd, disguised = 0, 0.0, 0.0, 0, 0, 0, 0, 0
    last_hit = last_second = -10
    for i, raw in enumerate(words):
        w = raw.lower()
        value = lexicon.of(w)
        if not w.isalpha():
            odd += 1
            if not value and (plain := "".join(c for c in w.translate(PLAIN) if c.isalpha())) != w:
                value = lexicon.of(plain)
                disguised += value > 0
        if value:
            hits += 1
            weight += value
            strongest = max(strongest, value)
            near += i - last_second <= 3
            last_hit = i
        if w in SECOND_PERSON:
            second += 1
            near += i - last_hit <= 3
            last_second = i
        if len(raw) > 1 and raw.isupper():
            shouted += 1
    capitals = sum(map(str.isupper, text))
    marks = sum(text.count(c) for c in ".,;:!?*#$%&@")
    return [
        hits / n, np.log1p(hits), weight / n, strongest, second / n, near / n, capitals / chars, shouted / n, text.count("!") / chars,
        text.count("?") / chars, marks / chars, odd / n, disguised / n, np.log1p(len(words)),
    ]


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Stems that occur in far more toxic than other texts of the bounded sample (text, toxic)."""
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}

    def counts(df: DataFrame, wanted: frozenset | None) -> DataFrame:
        def count(batches):
            sums: dict[str, int] = {}
            for batch in batches:
                for text in batch.column(0):
                    found = set()
                    for w in {w.lower() for w in WORD.findall(text.as_py() or "")}:
                        found |= stems(w)
                    for s in found if wanted is None else found & wanted:
                        sums[s] = sums.get(s, 0) + 1
            yield pa.RecordBatch.from_pydict({"stem": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

        return df.select("text").mapInArrow(count, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    toxic = {r.stem: r.n for r in counts(sample.where("toxic = 1"), None).where(F.col("n") >= MIN_TOXIC).collect()}
    clean = {r.stem: r.n for r in counts(sample.where("toxic = 0"), frozenset(toxic)).collect()} if toxic else {}
    a, b = max(totals.get(1, 0), 1), max(totals.get(0, 0), 1)
    ratio = {s: (n / a) / ((clean.get(s, 0) + 0.5) / b) for s, n in toxic.items()}
    kept = sorted((s for s in ratio if ratio[s] >= MIN_RATIO), key=lambda s: (-ratio[s], s))[:LEXICON]
    return Lexicon({s: float(np.log(ratio[s])) for s in kept})


@dataclass
class Trees:
    """Boosted trees of one depth: per inner node a feature and a threshold, per leaf a value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order splits on quantile bins."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    margin, inner = np.full(len(y), base), 2**DEPTH - 1
    features_, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node, feature, threshold = np.zeros(len(y), dtype=int), np.zeros(inner, dtype=int), np.full(inner, np.inf)
        for at in range(inner):
            own = np.flatnonzero(node == at)
            best = (1e-6, 0, np.inf, None)
            for f, e in enumerate(edges):
                if len(own) < 2 * LEAST or not len(e):
                    continue
                b = binned[own, f]
                gs, hs, ns = (np.bincount(b, weights=w, minlength=len(e) + 1).cumsum() for w in (g[own], h[own], None))
                gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                gain = gl**2 / (hl + RIDGE) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + RIDGE) - gs[-1] ** 2 / (hs[-1] + RIDGE)
                gain[(nl < LEAST) | (ns[-1] - nl < LEAST)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, e[k], k)
            feature[at], threshold[at] = best[1], best[2]
            right = binned[own, best[1]] > best[3] if best[3] is not None else np.zeros(len(own), dtype=bool)
            node[own] = 2 * at + 1 + right
        place = node - inner
        leaf = RATE * np.bincount(place, weights=g, minlength=inner + 1) / (np.bincount(place, weights=h, minlength=inner + 1) + RIDGE)
        margin += leaf[place]
        features_.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features_), np.array(thresholds), np.array(leaves))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: breakpoints and never falling values between which calibration interpolates."""
    values, first = np.unique(x, return_inverse=True)
    weight = np.bincount(first).astype(float)
    mean = np.bincount(first, weights=y) / weight
    blocks: list[list[float]] = []
    for v, m, w in zip(values, mean, weight, strict=True):
        blocks.append([v, v, m, w])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            low, high = blocks[-2], blocks.pop()
            blocks[-1] = [low[0], high[1], (low[2] * low[3] + high[2] * high[3]) / (low[3] + high[3]), low[3] + high[3]]
    return np.array([p for b in blocks for p in b[:2]]), np.array([b[2] for b in blocks for _ in range(2)])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    levels: np.ndarray

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        if self.trees is None or not rows:
            return np.zeros(len(rows))
        return np.clip(np.interp(self.trees.margin(np.array(rows)), self.knots, self.levels), 0.0, 1.0)


def describe(df: DataFrame, lexicon: Lexicon, text_col: str, out_col: str) -> DataFrame:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py(), lexicon) for t in texts], pa.list_(pa.float64()))

    return df.withColumn(out_col, run(F.col(text_col)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows, those whose ids hash lowest. ``docs``: doc_id, text; ``labels``: doc_id, toxic.

    Null labels are left out; of repeated labels of one document the highest counts. Without both labels every score is 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids go to the scan of the texts.
    picked = written(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    lexicon = learn_lexicon(picked)
    rows = describe(picked, lexicon, "text", "x").select("doc_id", "x", "toxic").toPandas().sort_values("doc_id")
    y = rows["toxic"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(lexicon, None, np.zeros(1), np.zeros(1))
    x = np.array(rows["x"].tolist())
    fold, out = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        train = fold != k
        out[~train] = boost(x[train], y[train]).margin(x[~train]) if 0 < y[train].sum() < train.sum() else 0.0
    return Model(lexicon, boost(x, y), *isotonic(out, y))


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``df`` with ``out_col``: calibrated chance in 0..1 that a text is toxic; null counts as the empty text."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores([features(t.as_py(), model.lexicon) for t in texts]), pa.float64())

    return df.withColumn(out_col, run(F.col(text_col)))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = fit(docs, labels.where(bucket_of("doc_id", 3) != 1))
    found = score(docs, model)
    return found.select(
        "doc_id",
        (bucket_of("doc_id", 3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"),
    )
