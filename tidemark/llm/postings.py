"""Positional inverted index of a corpus, and benchmark decontamination by exact phrases on it.

Only terms that can decide something are indexed: for each benchmark window its rarest terms in the corpus. The lists of these
terms, shifted by their place in the window, are intersected by counting; what is left is compared word by word with the
words around the rarest posting, which the index holds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import table
from tidemark.session import written

WINDOW = 10
RAREST = 2
# Items are handled in blocks, so that the terms sent to the tasks have a bound whatever the size of the benchmark.
ITEMS_IN_BLOCK = 20_000
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, item_id): runs of ``width`` words of each item; a shorter item is one window, an item without words none."""
    source = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))

    def cut(batches):
        for batch in batches:
            found, ids = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                runs = {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else ()
                found += runs
                ids += [item] * len(runs)
            yield pa.RecordBatch.from_arrays([pa.array([f.decode() for f in found], pa.string()), pa.array(ids, pa.string())], ["window", "item_id"])

    return source.mapInArrow(cut, "window string, item_id string").distinct()


def term_counts(docs: DataFrame, text_col: str, terms: set[bytes]) -> DataFrame:
    """(term, n): occurrences of the terms in all texts, added up inside each task first."""

    def count(batches):
        sums: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for w in words(text.as_py()):
                    if w in terms:
                        sums[w] = sums.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

    return docs.select(text_col).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def index(docs: DataFrame, terms: set[bytes], id_col: str = "doc_id", text_col: str = "text", around: int = WINDOW - 1) -> DataFrame:
    """(term, doc_id, at, before, context, n_words): the positional postings of ``terms``, written as a table.

    ``context`` holds the words around the posting, ``before`` how many of them precede it. Each document also has one row with
    a null term, which carries its number of words; null texts have 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def post(batches):
        for batch in batches:
            term, doc, place, left, context, total = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words(text.as_py())
                term.append(None)
                doc.append(key)
                place.append(None)
                left.append(None)
                context.append(None)
                total.append(len(w))
                for i in [i for i, x in enumerate(w) if x in terms]:
                    term.append(w[i].decode())
                    doc.append(key)
                    place.append(i)
                    left.append(min(i, around))
                    context.append(b" ".join(w[max(0, i - around) : i + around + 1]).decode())
                    total.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(term, pa.string()), pa.array(doc, batch.schema.field(0).type), pa.array(place, pa.int32()),
                    pa.array(left, pa.int32()), pa.array(context, pa.string()), pa.array(total, pa.int64()),
                ],
                ["term", "doc_id", "at", "before", "context", "n_words"],
            )

    rows = source.mapInArrow(post, f"term string, doc_id {kind}, at int, before int, context string, n_words long")
    return written(rows, "postings")


def deciding_terms(found: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(window, number, length, term, offset, rank): of each window that can occur at all, its rarest terms.

    Windows are numbered in a written table, so that the lists carry 8 bytes instead of the words.
    """
    numbered = written(found.select("window").distinct().withColumn("number", F.monotonically_increasing_id()), "numbered")
    each = numbered.select("window", "number", F.posexplode(F.split("window", " ")).alias("offset", "term"))
    rank = Window.partitionBy("window").orderBy("n", "offset")
    length = F.count(F.lit(1)).over(Window.partitionBy("window"))
    ranked = each.join(counts, "term").select(
        "window", "number", "term", "offset", F.row_number().over(rank).alias("rank"), length.alias("present")
    )
    return ranked.withColumn("length", F.size(F.split("window", " "))).where("present = length").where(F.col("rank") <= rarest).drop("present")


def phrase_matches(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, start, length, window): each place where all words of a window follow each other."""
    lists = postings.where("term is not null").join(terms, "term").where(F.col("at") >= F.col("offset"))
    begin = F.col("before") - F.col("offset") + 1
    same = F.array_join(F.slice(F.split("context", " "), F.greatest(begin, F.lit(1)), F.col("length")), " ") == F.col("window")
    # The words around the rarest posting are compared where they are read; only numbers meet.
    shifted = lists.select(
        "doc_id",
        (F.col("at") - F.col("offset")).alias("start"),
        "number",
        F.call_function("shiftleft", F.lit(1), F.col("rank") - 1).alias("list"),
        ((F.col("rank") == 1) & (begin >= 1) & same).alias("exact"),
        F.least(F.col("length"), F.lit(RAREST)).alias("wanted"),
    )
    met = shifted.groupBy("doc_id", "start", "number").agg(F.bit_or("list").alias("lists"), F.max("exact").alias("exact"), F.max("wanted").alias("wanted"))
    full = met.where(F.col("exact") & (F.bit_count("lists") == F.col("wanted")))
    return full.join(terms.where("rank = 1").select("number", "length", "window"), "number").select("doc_id", "start", "length", "window")


def proximity_matches(postings: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, doc_id, at): postings of a query's rarest term with all its other terms at most ``within`` words away.

    ``queries`` has (query_id, term); a query of one term matches wherever the term stands.
    """
    lists = postings.where("term is not null").select("term", "doc_id", "at")
    terms = queries.select("query_id", "term").distinct()
    rank = Window.partitionBy("query_id").orderBy("n", "term")
    counted = terms.join(lists.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left").fillna(0, ["n"])
    ranked = counted.withColumn("rank", F.row_number().over(rank)).withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    first = lists.join(ranked.where("rank = 1").select("query_id", "term", "terms"), "term").select("query_id", "terms", "doc_id", "at")
    # A posting meets those in its own stretch of the text and the two beside it.
    near = first.withColumn("stretch", F.explode(F.array(*[F.floor(F.col("at") / (within + 1)) + d for d in (-1, 0, 1)])))
    rest = lists.join(ranked.where("rank > 1").select("query_id", "term"), "term").select(
        "query_id", F.col("doc_id"), F.col("term"), F.col("at").alias("other"), F.floor(F.col("at") / (within + 1)).alias("stretch")
    )
    met = near.join(rest, ["query_id", "doc_id", "stretch"]).where(F.abs(F.col("at") - F.col("other")) <= within)
    several = met.groupBy("query_id", "doc_id", "at", "terms").agg(F.count_distinct("term").alias("met")).where("met = terms - 1")
    return first.where("terms = 1").select("query_id", "doc_id", "at").distinct().unionByName(several.select("query_id", "doc_id", "at"))


def _covered(spans):
    """Words inside the union of (start, length) spans."""

    def add(done, s):
        end = s["start"] + s["length"]
        fresh = F.greatest(end - F.greatest(done["reach"], s["start"]), F.lit(0))
        return F.struct((done["n"] + fresh).alias("n"), F.greatest(done["reach"], end).alias("reach"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), add, lambda done: done["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted strings), contaminated.

    Null and empty texts have no words and no hits; null or wordless items hit nothing. Rows with the same id count as one
    document with the hits of all of them. Texts are read whole.
    """
    blocks = max(1, -(-items.count() // ITEMS_IN_BLOCK))
    found = written(windows(items), "windows")
    hits, sizes = None, None
    for k in range(blocks):
        own = found.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        vocabulary = {r.term.encode() for r in own.select(F.explode(F.split("window", " ")).alias("term")).distinct().toLocalIterator()}
        terms = written(deciding_terms(own, term_counts(docs, text_col, vocabulary)), "terms")
        needed = {r.term.encode() for r in terms.select("term").distinct().toLocalIterator()}
        lists = index(docs, needed, id_col, text_col)
        matches = phrase_matches(lists, terms)
        hits = matches if hits is None else hits.unionByName(matches)
        if sizes is None:
            sizes = lists.where("term is null").select("doc_id", "n_words")
    hits = written(hits, "matches")
    spans = hits.select("doc_id", F.struct("start", "length").alias("span")).distinct().groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    named = hits.select("doc_id", "window").distinct().join(found, "window").select("doc_id", "item_id").distinct()
    listed = named.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    both = spans.join(listed.withColumnRenamed("doc_id", "id_"), F.col("doc_id").eqNullSafe(F.col("id_"))).select(
        F.col("doc_id").alias("id_"), _covered(F.col("spans")).alias("hit"), "item_ids"
    )
    return sizes.join(both, F.col("doc_id").eqNullSafe(F.col("id_")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )
