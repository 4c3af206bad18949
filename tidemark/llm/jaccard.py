"""Jaccard join of word-shingle sets: size-aware, heavy-light.

Sets of one content are one class. Tokens (hashed shingles) have a global order, frequent ones last. Sets up to a boundary size
enumerate the two-token subsets of their prefix; larger ones post the single tokens of a shorter prefix and their lists are
scanned. Both find every pair at the threshold: similar sets share their first common tokens inside these prefixes. The boundary
is the size at which both ways cost least together.

Classes of one list are first compared with a hub of the list only, which joins groups of copies in linear work. Then pairs
of a list that are still in different components and pass the size and position bounds are compared, all of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import table
from tidemark.llm.wordhash import MIX, folded, mixed, word_hashes
from tidemark.session import written

WORDS = 5
# Similarity 3/4: 100 * shared >= 75 * union, that is 7 * shared >= 3 * (a + b).
NEAR, FAR = 75, 100
FREQUENT = 400_000  # frequent tokens sent to the tasks: at most so many, as their share of all tokens is over 1/FREQUENT
SEEN = 4  # times in one task
HELD = 4_000_000  # tokens that a task counts at once
LARGEST_BOUNDARY = 16
HUBS = 3
EXTRA = 24  # for so many tokens of a set its prefix has one token more, and a pair must share one more there


def tokens(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of folded text; fewer words than WORDS are one shingle."""
    h = word_hashes(data)
    n = len(h)
    if not n:
        return h
    size = min(n, WORDS)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = total * MIX + h[k : n - size + 1 + k]
    total = mixed(total)
    total.sort()
    fresh = np.ones(len(total), dtype=bool)
    np.not_equal(total[1:], total[:-1], out=fresh[1:])
    return total[fresh]


def class_of(own: np.ndarray) -> int:
    """One number for the whole set, whatever its order."""
    if not len(own):
        return 0
    total = np.add.reduce(own, keepdims=True) ^ mixed(np.array([len(own)], dtype=np.uint64))
    return int(mixed(total).view(np.int64)[0])


def least_shared(n: int) -> int:
    """Tokens that a set of n shares at least with any similar set."""
    return -(-NEAR * n // FAR)


def demanded(n):
    """Tokens that similar sets have in common inside both prefixes: of two sets the smaller demand holds."""
    return 1 + n // EXTRA


def keys(own: np.ndarray, weights: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and, for each, how many tokens it may share with a set that has the key too."""
    n = len(own)
    if n < 2:
        return own[:0], np.empty(0, dtype=np.int64)
    ordered = own[np.lexsort((own, weights))]
    found, reach = [], []
    slack = n - least_shared(n)
    if n <= boundary:
        a, b = np.triu_indices(min(n, slack + 2), 1)
        found.append(mixed(ordered[a] * MIX + mixed(ordered[b])))
        reach.append(n - b + 1)
    if FAR * n > NEAR * boundary:
        at = np.arange(min(n, slack + demanded(n)))
        found.append(ordered[at])
        reach.append(n - at)
    return np.concatenate(found), np.concatenate(reach).astype(np.int64)


def sets_and_frequent(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass: (doc_id, cls, n) per row, and (token, seen) of tokens that repeat inside a task."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def repeated(held):
        values, seen = np.unique(np.concatenate(held), return_counts=True)
        often = seen >= SEEN
        return values[often].view(np.int64), seen[often]

    def run(batches):
        held, size, doc_type = [], 0, None
        for batch in batches:
            doc_type, sizes, marks = batch.column(0).type, [], []
            for text in batch.column(1):
                own = tokens(folded(text.as_py()))
                sizes.append(len(own))
                marks.append(class_of(own))
                held.append(own)
                size += len(own)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), none, none], names)
            if size > HELD:
                values, seen = repeated(held)
                none = pa.nulls(len(values), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(values), doc_type), none, none, pa.array(values), pa.array(seen)], names)
                held, size = [], 0
        if size:
            values, seen = repeated(held)
            none = pa.nulls(len(values), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(values), doc_type), none, none, pa.array(values), pa.array(seen)], names)

    names = ["doc_id", "cls", "n", "token", "seen"]
    return source.mapInArrow(run, f"doc_id {kind}, cls long, n long, token long, seen long")


def boundary_by_cost(sizes: dict[int, int], scan: float) -> int:
    """Size up to which subsets are cheaper. ``sizes``: sets by size; ``scan``: entries of a list that a posting meets."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            slack = n - least_shared(n)
            if 2 <= n <= x:
                total += count * (slack + 2) * (slack + 1) / 2
            if FAR * n > NEAR * x:
                total += count * (slack + 1) * (1 + scan)
        return total

    return min(range(LARGEST_BOUNDARY + 1), key=lambda x: (cost(x), x))


def inverted_lists(docs: DataFrame, text_col: str, frequent: tuple[np.ndarray, np.ndarray], boundary: int) -> DataFrame:
    """(token, cls, n, reach, hub): the lists with two classes or more. ``hub``: the set in front of
    the list if its size allows similarity, else the one before."""
    values, weight = frequent

    def post(batches):
        done = set()
        for batch in batches:
            parts = []
            for text in batch.column(0):
                own = tokens(folded(text.as_py()))
                mark = class_of(own)
                if len(own) < 2 or mark in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(mark)  # copies would only repeat the postings
                at = np.searchsorted(values, own)
                at[at == len(values)] = 0
                weights = np.where(values[at] == own, weight[at], 0) if len(values) else np.zeros(len(own), dtype=np.int64)
                found, reach = keys(own, weights, boundary)
                parts.append((found.view(np.int64), np.full(len(found), mark), np.full(len(found), len(own)), reach))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "cls", "n", "reach"])

    rows = docs.select(text_col).mapInArrow(post, "token long, cls long, n long, reach long")
    rows = rows.select("token", "cls", F.col("n").cast("int").alias("n"), F.col("reach").cast("int").alias("reach"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # In front: sets with few rarer tokens before this one. In a group of copies that is the one with the fewest own edits.
    ordered = rows.repartition(parts, "token").sortWithinPartitions("token", F.col("n") - F.col("reach"), "cls")

    def keep(batches):
        """Streams: a row stays if a neighbour has its token and another class; memory is one batch."""
        last = None  # the last row of the batch before, not yet given out, and whether it already has company
        hub = None
        for batch in batches:
            if not len(batch):
                continue
            token, cls, n, reach = (batch.column(i).to_numpy() for i in range(4))
            if last is not None:
                token, cls, n, reach = (np.concatenate([[x], y]) for x, y in zip(last[:4], (token, cls, n, reach), strict=True))
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])
            company = last[4] if last is not None else False
            token, cls, n, reach = token[fresh], cls[fresh], n[fresh], reach[fresh]
            same = token[1:] == token[:-1]
            stays = np.concatenate([[company], same]) | np.concatenate([same, [False]])
            end = len(token) - 1
            out = np.flatnonzero(stays[:end])
            # The hub is the first of the list if sizes allow, else the row before.
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(token)), 0))
            head_cls, head_n = cls[begin], n[begin]
            if hub is not None and hub[0] == token[0]:
                first = begin == 0
                head_cls, head_n = np.where(first, hub[1], head_cls), np.where(first, hub[2], head_n)
            before = np.concatenate([cls[:1], np.where(same, cls[:-1], cls[1:])])
            fits = (FAR * head_n.astype(np.int64) >= NEAR * n.astype(np.int64)) & (FAR * n.astype(np.int64) >= NEAR * head_n.astype(np.int64))
            hubs = np.where(fits, head_cls, before)
            hub = (token[end], head_cls[end], head_n[end])
            tail, hubs = hubs[end], hubs[out]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (token, cls, n, reach)] + [pa.array(hubs)], names)
            last = (token[end], cls[end], n[end], reach[end], bool(stays[end]), tail)
        if last is not None and last[4]:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last[:4], last[5]), kinds, strict=True)], names)

    names, kinds = ["token", "cls", "n", "reach", "hub"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return ordered.mapInArrow(keep, "token long, cls long, n int, reach int, hub long")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """(u, v): each class with the HUBS hubs that it meets most often."""
    met = lists.where("hub <> cls").groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("n"))
    # Which hub a list has is chance, so half of what is demanded of a pair will do; this step need not find all.
    met = met.where(F.col("count") * 2 >= 1 + F.floor(F.col("n") * NEAR / FAR / EXTRA))
    order = Window.partitionBy("cls").orderBy(F.desc("count"), "hub")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS)
    return best.select(F.least("cls", "hub").alias("u"), F.greatest("cls", "hub").alias("v")).distinct()


def open_pairs(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v): pairs of a list in different components that size and position leave open."""
    known = members.withColumnRenamed("node", "cls")
    placed = lists.drop("hub").join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed_lists = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.join(mixed_lists, "token").select("token", "n", "cls", "reach", "component").repartition(parts, "token").sortWithinPartitions("token", "n", "cls")

    def pairs(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(i).to_numpy() for i in range(5)]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            token, n = columns[:2]
            # Rows of ended lists, and of sizes that no later row is similar to, have met all their partners.
            done = np.flatnonzero((token != token[-1]) | (FAR * n < NEAR * n[-1]))
            stop = int(done[-1]) + 1 if len(done) else 0
            yield from meet(columns, stop)
            held = [c[stop:] for c in columns]
        if held is not None:
            yield from meet(held, len(held[0]))

    def meet(columns, stop):
        token, n, cls, reach, component = columns
        i, d = np.arange(stop), 0
        while len(i):
            d += 1
            i = i[i + d < len(token)]
            j = i + d
            i = i[(token[j] == token[i]) & (FAR * n[i].astype(np.int64) >= NEAR * n[j].astype(np.int64))]
            j = i + d
            common = demanded(n[i])
            room = np.minimum(reach[i], reach[j]) + common - 1
            open_ = (component[i] != component[j]) & (7 * room >= 3 * (n[i].astype(np.int64) + n[j]))
            if open_.any():
                a, b = cls[i[open_]], cls[j[open_]]
                low = pa.array(np.minimum(a, b))
                yield pa.RecordBatch.from_arrays([low, pa.array(np.maximum(a, b)), pa.array(common[open_].astype(np.int32))], ["u", "v", "common"])

    met = rows.mapInArrow(pairs, "u long, v long, common int")
    # Sets small enough for subsets are small enough to demand one meeting only.
    return met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("lists"), F.max("common").alias("common")).where("lists >= common").select("u", "v")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are at the threshold. ``texts``: (cls, packed)."""
    left = pairs.join(texts.select(F.col("cls").alias("u"), F.col("packed").alias("a")), "u")
    both = left.join(texts.select(F.col("cls").alias("v"), F.col("packed").alias("b")), "v")

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        memo, out = {}, []

        def of(x):
            if x not in memo:
                if len(memo) > 64:
                    memo.clear()
                memo[x] = tokens(zlib.decompress(x))
            return memo[x]

        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            s, t = of(x), of(y)
            shared = len(np.intersect1d(s, t, assume_unique=True))
            out.append(FAR * shared >= NEAR * (len(s) + len(t) - shared))
        return pa.array(out, pa.bool_())

    return both.where(near("a", "b")).select("u", "v")


def packed_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, packed): the words of one document of each wanted class. ``wanted``: (doc_id, cls)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id").select("cls", "text")

    def pack(batches):
        for batch in batches:
            packed = [zlib.compress(folded(t.as_py()), 1) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["cls", "packed"])

    return rows.mapInArrow(pack, "cls long, packed binary").dropDuplicates(["cls"])


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Null, empty and wordless texts have no shingles, link with nothing and are their own component, as are rows with a null id
    (null component). Fewer words than five are one shingle. Rows that repeat an id are one document; other columns are ignored.
    """
    scan = written(sets_and_frequent(docs, id_col, text_col), "sets")
    sets = scan.where("token is null").select("doc_id", "cls", "n")
    total = int(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    often = scan.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    # At most FREQUENT tokens can be seen so often.
    rows = often.where(F.col("seen") * FREQUENT >= total).where("seen >= 16").toPandas()
    values = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    frequent = values[order], rows["seen"].to_numpy(np.int64)[order]
    scan_cost = float((frequent[1].astype(float) ** 2).sum() / total) if total else 0.0
    # Every size that is worth a subset or meets one; larger sets cost the same under any boundary.
    sizes = {r.n: r.sets for r in sets.where(F.col("n") <= 2 * LARGEST_BOUNDARY).groupBy("n").agg(F.count_distinct("cls").alias("sets")).collect()}
    lists = written(inverted_lists(docs, text_col, frequent, boundary_by_cost(sizes, scan_cost)), "lists")
    first = sets.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    wanted = first.join(lists.select("cls").distinct(), "cls").select("doc_id", "cls")
    texts = written(packed_texts(docs, wanted, id_col, text_col), "texts")
    tried = written(hub_pairs(lists), "pairs")
    edges = written(similar(tried, texts), "links")
    members = components(edges)
    rest = written(open_pairs(lists, members).join(tried, ["u", "v"], "left_anti"), "pairs")
    more = written(similar(rest, texts), "links")
    if more.take(1):
        members = components(edges.unionByName(more))
    component = first.join(members.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = component.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = component.join(least, "component").select("cls", "component_id")
    marked = sets.withColumn("cls", F.when(F.col("n") > 0, F.col("cls")))
    out = marked.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
