"""Ranked lexical search by scanning the documents with one automaton of all terms of all items.

No index of the documents is built. The terms of the items, each between two boundary signs, make one Aho-Corasick automaton that is
sent to the tasks. Two scans of the texts follow: the first counts in how many documents each term stands, the second counts terms per
document, adds their contributions to all items that hold them and keeps the best documents of each item within the task.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from math import floor, log
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import table

BEST = 10
# Bytes of item text that one automaton may stand for; a longer list of items is searched in blocks of this size.
BLOCK_BYTES = 2_000_000
# Letters and digits of ASCII and all bytes above it stay, A-Z in lower case; everything else is a boundary.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: bytes | None) -> bytes:
    return text.translate(FOLD) if text else b""


class Terms:
    """The terms of a block of items: their automaton, and for each term the items that hold it and how often."""

    def __init__(self, texts: list[str]):
        held = [Counter(folded(t.encode("utf-8", "replace")).split()) for t in texts]
        self.names = sorted(set().union(*held))
        number = {t: k for k, t in enumerate(self.names)}
        pairs = sorted((number[t], item, times) for item, own in enumerate(held) for t, times in own.items())
        flat = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        self.items, self.times = flat[:, 1].copy(), flat[:, 2].copy()
        self.starts = np.searchsorted(flat[:, 0], np.arange(len(self.names) + 1))
        self.n_items = len(texts)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(self.names):
            self.automaton.add_word(" " + t.decode("utf-8", "replace") + " ", k)
        self.automaton.make_automaton()

    def count(self, text: bytes) -> Counter:
        """Occurrences of each term (by number) in folded text; neighbours share the boundary between them."""
        return Counter(map(itemgetter(1), self.automaton.iter(f" {text.decode('utf-8', 'replace')} ")))


def document_counts(docs: DataFrame, sent) -> tuple[list[int], int, int]:
    """Documents that hold each term of the block, documents with any term at all, and all their terms."""

    def count(batches):
        terms = sent.value
        holding, with_terms, total = np.zeros(len(terms.names), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                low = folded(text)
                n = len(low.split())
                if n:
                    with_terms, total = with_terms + 1, total + n
                    holding[list(terms.count(low))] += 1
        found = np.flatnonzero(holding)
        numbers, values = [*found.tolist(), -1, -2], [*holding[found].tolist(), with_terms, total]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.int64())], ["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in sums.collect()}  # a row per term of the block and two more
    return [found.get(k, 0) for k in range(len(sent.value.names))], found.get(-1, 0), found.get(-2, 0)


def weights(holding: list[int], documents: int) -> np.ndarray:
    return np.array([floor(1000 * log((2 * documents + 2) / (2 * df + 1))) for df in holding], dtype=np.int64)


class Best:
    """The best documents of each item so far: highest score first, equal scores by id, documents without an id last."""

    def __init__(self, n_items: int, best: int):
        self.best, self.rows = best, [[] for _ in range(n_items)]
        # What a document must beat once all places are taken: score of the last place and, for whole-number ids, its id.
        self.low, self.low_id = np.ones(n_items, np.int64), np.full(n_items, np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, key) -> None:
        mine = (key is None, 0 if key is None else key)
        beaten = scores >= self.low
        if isinstance(key, int):  # of many equal copies only those with small ids are looked at
            beaten &= (scores > self.low) | (key <= self.low_id)
        for item in np.flatnonzero(beaten).tolist():
            row, entry = self.rows[item], (-int(scores[item]), *mine)
            if len(row) == self.best:
                if entry >= row[-1]:
                    continue
                row.pop()
            insort(row, entry)
            if len(row) == self.best:
                self.low[item] = -row[-1][0]
                if isinstance(row[-1][2], int) and not row[-1][1]:
                    self.low_id[item] = row[-1][2]


def scored(docs: DataFrame, sent, weight: np.ndarray, documents: int, total: int, best: int, kind: str) -> DataFrame:
    """(item, doc_id, score): the best documents of each item in each task."""

    def score(batches):
        terms, key_type = sent.value, None
        kept = Best(terms.n_items, best)
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                low = folded(text)
                counts = terms.count(low)
                if not counts:
                    continue
                m = 25 + 75 * len(low.split()) * documents // total
                found = np.fromiter(counts.keys(), np.int64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                share = weight[found] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                begin, length = terms.starts[found], terms.starts[found + 1] - terms.starts[found]
                ends = np.cumsum(length)
                at = np.arange(ends[-1]) + np.repeat(begin - ends + length, length)
                scores = np.zeros(terms.n_items, np.int64)
                np.add.at(scores, terms.items[at], np.repeat(share, length) * terms.times[at])
                kept.add(scores, key)
        if key_type is not None:
            out = [(item, None if null else key, -s) for item, row in enumerate(kept.rows) for s, null, key in row]
            items, keys, values = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(keys, key_type), pa.array(values, pa.int64())], ["item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"item int, doc_id {kind}, score long")


def blocks(items: DataFrame, most_bytes: int):
    """Lists of (item_id, text) of at most ``most_bytes`` of text each; an item beyond that is a block of its own.

    The driver holds one block at a time, whatever the number of items.
    """
    own, size = [], 0
    for row in items.toLocalIterator():
        n = len(row.text.encode("utf-8", "replace")) + 1
        if own and size + n > most_bytes:
            yield own
            own, size = [], 0
        own.append((row.item_id, row.text))
        size += n
    if own:
        yield own


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``best`` documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    Null and wordless texts have no terms: such documents count nowhere and such items find nothing. Equal scores rank by
    ascending id, documents without an id last. Each row is a document, so repeated rows take several ranks; equal item rows
    are one item, different texts under one item_id are ranked each for themselves. Texts are read whole. Empty tables
    give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    found = []
    for own in blocks(asked, block_bytes):
        terms = Terms([text for _, text in own])
        if not terms.names:
            continue
        sent = spark.sparkContext.broadcast(terms)
        holding, documents, total = document_counts(texts, sent)
        if not total:
            break
        rows = scored(texts, sent, weights(holding, documents), documents, total, best, kind)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        ids = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(own)], f"item int, item_id {item_kind}")
        found.append(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE = r"""
WITH folded AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), docs AS (
  SELECT row_no, doc_id, words, len(words)::BIGINT AS n FROM folded WHERE len(words) > 0
), totals AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs
), tf AS (
  SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_no, doc_id, n, unnest(words) AS term FROM docs) GROUP BY ALL
), df AS (
  SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY ALL
), parts AS (
  SELECT item_id, row_no, doc_id,
    times * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS part
  FROM asked JOIN df USING (term) JOIN tf USING (term) CROSS JOIN totals
), scores AS (
  SELECT item_id, row_no, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""
