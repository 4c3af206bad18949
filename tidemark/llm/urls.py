"""URL filter: list rules first, then naive Bayes over words that Viterbi segmentation finds in host and path."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import table
from tidemark.session import written

ALLOW, BLOCK = "allow", "block"
# Rule -> verdict. A rule is a host, which fits its subdomains too, and the beginning of a path.
RULES = {"net/": BLOCK, "example.net/en/": ALLOW, "example.com/de/": BLOCK, "org/fr/": ALLOW}
LONGEST_WORD = 20
BUCKETS = 1 << 14
SALTS = 16
LETTERS = r"[^\x00-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = re.compile(r"<[^>]*>")


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. ``rules`` is a short list from the configuration."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n) over the texts of all pages, added up inside each task first."""
    letters = re.compile(LETTERS)

    def count(batches):
        sums: dict[str, int] = {}
        for batch in batches:
            for html in batch.column(0):
                text = html.as_py()
                if text:
                    for w in letters.findall(TAG.sub(" ", text).lower()):
                        if len(w) <= LONGEST_WORD:
                            sums[w] = sums.get(w, 0) + 1
            if len(sums) > 200_000:  # bounded memory; the shuffle adds the parts up
                yield pa.RecordBatch.from_pydict({"word": list(sums), "n": list(sums.values())})
                sums = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

    return pages.select(html_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(text: str, known: dict[str, int], total: int) -> list[str]:
    """Most likely split under unigram probabilities; an unknown stretch costs ten times more for each letter."""
    best, cut = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = known.get(text[start:end], 0)
            cost = np.log(total / n) if n else np.log(max(total, 1)) + (end - start) * np.log(10.0)
            options.append((best[start] + cost, start))
        cost, start = min(options)
        best.append(cost)
        cut.append(start)
    words, end = [], len(text)
    while end:
        words.append(text[cut[end] : end])
        end = cut[end]
    return words[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words): each distinct run of letters split into words. Only counts of its own substrings travel to a run."""
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    places = F.explode(F.sequence(F.lit(1), F.length("run")))
    parts = runs.select("run", places.alias("at")).select(
        "run", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("run") - F.col("at") + 1))).alias("size"), "at"
    )
    # Most runs repeat the same substrings: they are looked up once each.
    pieces = parts.select("run", F.substring("run", F.col("at"), F.col("size")).alias("word")).distinct()
    known = pieces.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.arrow_udf("array<string>")
    def split(text: pa.Array, known: pa.Array) -> pa.Array:
        pairs = zip(text.to_pylist(), known.to_pylist(), strict=True)
        return pa.array([segment(t, {k["word"]: k["n"] for k in found or ()}, total) for t, found in pairs], pa.list_(pa.string()))

    return runs.join(known, "run", "left").select("run", split("run", "known").alias("words"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, words, log_odds) of every row.

    A fitting rule decides. Elsewhere naive Bayes does, learned from all pages that a rule decides; it allows at even odds and
    where nothing was learned. Null urls and those without ``://`` have an empty host and path, no words, and are judged by the
    share of blocked pages alone. Repeated rows give repeated results.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = parsed.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    text = F.lower(F.concat_ws(" ", "host", "path"))
    judged = judged.withColumn("shape", F.array_join(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), " "))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    listed = F.element_at(verdicts, F.col("rule"))
    # Pages that differ only in digits and punctuation share a shape and are scored once.
    shapes = judged.groupBy("shape").agg(F.count_if(listed == BLOCK).alias("blocked"), F.count_if(listed == ALLOW).alias("allowed"))
    each = shapes.where("shape <> ''").select("shape", "blocked", "allowed", F.posexplode(F.split("shape", " ")).alias("at", "run"))
    words = segmented(each.select("run").distinct(), written(word_counts(pages, html_col), "words"))
    # Words such as www stand in most shapes: salted, so that no task gets them all.
    salted = words.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    met = each.withColumn("salt", F.pmod(F.hash("shape"), F.lit(SALTS))).join(salted, ["run", "salt"])
    known = met.groupBy("shape", "blocked", "allowed").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words")
    )
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("bucket")
    sums = (
        known.select("blocked", "allowed", F.explode("words").alias("word"))
        .groupBy(bucket)
        .agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
        .toPandas()  # BUCKETS rows at most
    )
    prior = shapes.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("allowed"), F.lit(0))).first()
    odds = np.zeros(BUCKETS)
    if prior[0] and prior[1] and len(sums):
        b, a = np.zeros(BUCKETS), np.zeros(BUCKETS)
        b[sums["bucket"].to_numpy(int)], a[sums["bucket"].to_numpy(int)] = sums["blocked"], sums["allowed"]
        odds = np.log((b + 1) / (b.sum() + BUCKETS)) - np.log((a + 1) / (a.sum() + BUCKETS))
    start = float(np.log((prior[0] + 1) / (prior[1] + 1)))

    @F.arrow_udf("double")
    def score(buckets: pa.Array) -> pa.Array:
        return pa.array([start + float(odds[np.array(x or [], dtype=int)].sum()) for x in buckets.to_pylist()], pa.float64())

    hashed = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))
    scored = known.select("shape", "words", score(hashed).alias("log_odds"))
    found = judged.join(scored, "shape", "left").withColumn("log_odds", F.coalesce("log_odds", F.lit(start)))
    own = F.when(F.col("log_odds") > 0, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return found.select("page_id", "host", "path", "rule", F.coalesce(listed, own).alias("verdict"), "words", "log_odds")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url", "html"))
