"""Near-duplicate vectors by NN-descent: a neighbour graph, refined through neighbours of neighbours.

Start: random hyperplanes deal the vectors of a label into buckets, several times over; a vector meets those next to it in a
bucket. Edges at the threshold make components. Rounds compare the neighbours of every vector with each other and keep the best,
until no more components merge: pairs inside a component are never stored, so a large group of near copies costs no more edges than
other vectors. A list that is full of edges at the threshold gets as many places beside them for neighbours of other components, and
is enlarged to its whole component, in blocks, at the end, so all direct links are counted exactly. An audit compares queries of
different components with all rows; while any of them misses a link, another start with longer lists follows, and after the last one
an exact comparison of all components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import table
from tidemark.session import release, scratch_tables, written

THRESHOLD = 0.98
NEIGHBOURS = 8
TABLES = 14
BESIDE = 3
MISSED = 2e-4  # chance that no bucket of a start has both ends of a link; tables are added as buckets get finer
BLOCK = 512
LARGE_BLOCK = 4096  # of the exact comparison
AUDIT = 2048
STARTS = 4


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def grouped(batches, key_columns: int):
    """Runs of equal keys of a sorted stream, as tables."""
    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(key_columns)], strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != key:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            key = keys[a]
            held.append(rows.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, copies, space, vec): one row per distinct usable vector of a label, in double precision, of length 1.

    ``id`` is the smallest id of the copies; ``space`` tells labels and widths apart.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    usable = df.where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.concat_ws("/", F.size(vec), F.col(label_col)).alias("space"), vec.alias("vec")
    )
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    classes = usable.where(fine).groupBy("space", "vec").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"))
    # Scaled by the largest part first: squares of very small or large parts stay finite.
    peak = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    scaled = F.transform("vec", lambda x: x / F.col("peak"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    out = classes.withColumn("peak", peak).withColumn("vec", scaled).withColumn("norm", norm)
    return out.select("id", "copies", "space", F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))


def start_edges(vectors: DataFrame, count: int, seed: int) -> DataFrame:
    """(u, v, cosine): each vector with those beside it in the buckets of TABLES random partitions."""
    bits = int(np.clip(np.ceil(np.log2(max(count, 2) / 4)), 4, 60))
    shared = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    tables = max(TABLES, int(np.ceil(np.log(MISSED) / np.log1p(-shared))))

    def codes(batches):
        planes = {}
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            for i, n in enumerate(pa.compute.list_value_length(batch.column("vec")).to_pylist()):
                by_width.setdefault(n, []).append(i)
            for width, at in by_width.items():
                if width not in planes:
                    planes[width] = np.random.default_rng([seed, width]).standard_normal((tables, bits + 1, width))
                own = pa.Table.from_batches([batch]).take(at).combine_chunks()
                dots = np.einsum("tbw,nw->tnb", planes[width], matrix(own.column("vec").chunk(0)))
                signs = (dots[:, :, :bits] > 0) @ (1 << np.arange(bits))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(own), pa.int32()), own.column("space").chunk(0), pa.array(signs[t]), pa.array(dots[t, :, bits]), own.column("id").chunk(0), own.column("vec").chunk(0)],
                        ["t", "space", "code", "p", "id", "vec"],
                    )

    kind = vectors.schema["id"].dataType.simpleString()
    dealt = vectors.mapInArrow(codes, f"t int, space string, code long, p double, id {kind}, vec array<double>")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartitionByRange(parts, "t", "space", "code", "p", "id").sortWithinPartitions("t", "space", "code", "p", "id")

    def meet(batches):
        tail = None  # the last rows so far also meet the first of the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            tail = rows[0].slice(max(0, len(rows[0]) - BESIDE))
            for group in grouped(rows, 3):
                if len(group) < 2:
                    continue
                ids, x = group.column("id").to_numpy(), matrix(group.column("vec").chunk(0))
                for d in range(1, min(BESIDE, len(ids) - 1) + 1):
                    cosine = (x[:-d] * x[d:]).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:-d]), pa.array(ids[d:]), pa.array(cosine)], ["u", "v", "cosine"])

    found = ordered.mapInArrow(meet, f"u {kind}, v {kind}, cosine double").where("u <> v")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cosine").groupBy("u", "v").agg(F.max("cosine").alias("cosine"))


def best(edges: DataFrame, k: int) -> DataFrame:
    """(w, id, cosine): the k best neighbours of each vector, in both directions."""
    both = edges.select(F.col("u").alias("w"), F.col("v").alias("id"), "cosine").unionByName(
        edges.select(F.col("v").alias("w"), F.col("u").alias("id"), "cosine")
    )
    order = Window.partitionBy("w").orderBy(F.desc("cosine"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def between(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v): different components that an edge at the threshold joins."""
    ends = edges.where(F.col("cosine") >= THRESHOLD).select("u", "v")
    for end in ("u", "v"):
        ends = ends.join(members.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end)
    return ends.where("of_u <> of_v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v")).distinct()


def merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` after the components that ``links`` join have become one."""
    roots = components(links).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return members.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def refine(edges: DataFrame, vectors: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """One round: each vector keeps its k best edges at the threshold and its k best below it, and these neighbours are compared with
    each other. New edges between different components, at the threshold or better than what a vector has below it, join the old."""
    beyond = best(edges.where(F.col("cosine") < THRESHOLD), k)
    lists = best(edges.where(F.col("cosine") >= THRESHOLD), k).unionByName(beyond)
    worst = beyond.groupBy(F.col("w").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.min("cosine")).otherwise(F.lit(-1.0)).alias("floor"))
    kind = vectors.schema["id"].dataType.simpleString()
    own = members.withColumnRenamed("node", "id")
    known = vectors.select("id", "vec").join(own, "id").join(worst, "id", "left").fillna(-1.0, ["floor"])
    rows = lists.select("w", "id").join(known, "id").select("w", "id", "component", "floor", "vec").repartition("w").sortWithinPartitions("w", "id")

    def join(batches):
        for group in grouped(batches, 1):
            if len(group) < 2:
                continue
            ids, floor = group.column("id").to_numpy(), group.column("floor").to_numpy()
            x, component = matrix(group.column("vec").chunk(0)), group.column("component").to_numpy()
            cosine = x @ x.T
            a, b = np.triu_indices(len(ids), 1)
            c = cosine[a, b]
            good = (component[a] != component[b]) & ((c > np.minimum(floor[a], floor[b])) | (c >= THRESHOLD))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[good]]), pa.array(ids[b[good]]), pa.array(c[good])], ["u", "v", "cosine"])

    new = rows.mapInArrow(join, f"u {kind}, v {kind}, cosine double")
    kept = lists.select(F.col("w").alias("u"), F.col("id").alias("v"), "cosine")
    return kept.unionByName(new).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cosine").groupBy("u", "v").agg(F.max("cosine").alias("cosine"))


def links_in_components(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(id, links): copies of all other vectors of the component at the threshold, of components with more than one vector.
    They are compared in blocks of about BLOCK vectors; a pair of blocks is the work of one group, and only sums leave it."""
    own = vectors.join(members.withColumnRenamed("node", "id"), "id")
    n = F.count(F.lit(1))
    sizes = members.groupBy("component").agg(n.alias("n"), F.ceil(n / BLOCK).cast("int").alias("blocks")).where("n > 1").drop("n")
    placed = own.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = placed.withColumn("other", other).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "copies", "vec"
    )
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.repartition(parts, "component", "low", "high").sortWithinPartitions("component", "low", "high", "id")
    kind = vectors.schema["id"].dataType.simpleString()

    def count(batches):
        for group in grouped(batches, 3):
            ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy().astype(float)
            x, block = matrix(group.column("vec").chunk(0)), group.column("block").to_numpy()
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
            linked = x[a] @ x[b].T >= THRESHOLD
            if low == high:
                np.fill_diagonal(linked, False)
                sums = linked @ copies[b]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(sums.astype(np.int64))], ["id", "links"])
            else:
                both = np.concatenate([linked @ copies[b], linked.T @ copies[a]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[a], ids[b]])), pa.array(both)], ["id", "links"])

    return rows.mapInArrow(count, f"id {kind}, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(vectors: DataFrame, members: DataFrame, counted: DataFrame, seed: int) -> int:
    """Number of queries of which the graph lacks direct links: one query of each of at most AUDIT components, vectors without
    links included, so that a large component weighs no more than a pair. Queries meet all rows in one pass."""
    named = vectors.select("id").join(members.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    chosen = named.groupBy("component").agg(F.min_by("id", F.struct(F.xxhash64("id", F.lit(seed)), "id")).alias("id"))
    chosen = chosen.orderBy(F.xxhash64("component", F.lit(seed + 1)), "component").limit(AUDIT).select("id")
    queries = vectors.join(chosen, "id").select("id", "space", "vec").collect()
    groups: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for space in {q.space for q in queries}:
        own = [q for q in queries if q.space == space]
        groups[space] = np.array([q.id for q in own]), np.array([q.vec for q in own])
    kind = vectors.schema["id"].dataType.simpleString()

    def compare(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            spaces = np.array(batch.column("space").to_pylist())
            for space in set(spaces.tolist()) & set(groups):
                part = rows.take(np.flatnonzero(spaces == space)).combine_chunks()
                ids, x = groups[space]
                linked = x @ matrix(part.column("vec").chunk(0)).T >= THRESHOLD
                linked &= ids[:, None] != part.column("id").to_numpy()[None, :]
                sums = linked @ part.column("copies").to_numpy().astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums.astype(np.int64))], ["id", "true"])

    truth = vectors.mapInArrow(compare, f"id {kind}, true long").groupBy("id").agg(F.sum("true").alias("true"))
    return truth.join(counted, "id", "left").where(F.col("true") > F.coalesce("links", F.lit(0))).count()


def links_between(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v): components with a link between them, by an exact comparison of all vectors of a space in pairs of blocks."""
    own = vectors.join(members.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = vectors.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / LARGE_BLOCK).cast("int").alias("blocks"))
    placed = own.join(sizes, "space").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = placed.withColumn("other", other).select(
        "space", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", "vec"
    )
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.repartition(parts, "space", "low", "high").sortWithinPartitions("space", "low", "high")
    kind = vectors.schema["id"].dataType.simpleString()

    def compare(batches):
        for group in grouped(batches, 3):
            component, block = group.column("component").to_numpy(), group.column("block").to_numpy()
            x = matrix(group.column("vec").chunk(0))
            a, b = np.flatnonzero(block == group.column("low")[0].as_py()), np.flatnonzero(block == group.column("high")[0].as_py())
            for begin in range(0, len(a), BLOCK):
                some = a[begin : begin + BLOCK]
                i, j = np.nonzero((x[some] @ x[b].T >= THRESHOLD) & (component[some][:, None] != component[b][None, :]))
                if len(i):
                    ends = np.unique(np.sort(np.stack([component[some[i]], component[b[j]]], axis=1), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    return rows.mapInArrow(compare, f"u {kind}, v {kind}").distinct()


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Null labels, null or zero vectors and vectors with null or non-finite parts link with nothing; vectors of different width
    neither. Equal vectors of one label are linked. Rows that repeat an id are one vector. A null id has no links and a null
    component; it is kept.
    """
    before = scratch_tables()
    vectors = written(unit_vectors(df, id_col, vec_col, label_col), "vectors")
    count, members, edges = vectors.count(), vectors.select(F.col("id").alias("node"), F.col("id").alias("component")), None
    for seed in range(STARTS):
        fresh = start_edges(vectors, count, seed)
        edges = written(fresh if edges is None else edges.unionByName(fresh).groupBy("u", "v").agg(F.max("cosine").alias("cosine")), "graph")
        rounds = 0
        while True:
            links = written(between(edges, members), "between")
            if not links.isEmpty():
                members = written(merged(members, links), "members")
            elif rounds:
                break
            edges, rounds = written(refine(edges, vectors, members, NEIGHBOURS << seed), "graph"), rounds + 1
            release(df.sparkSession, list(set(scratch_tables()) - set(before)), vectors, members, edges)
        counted = written(links_in_components(vectors, members), "links")
        if not audit(vectors, members, counted, seed):
            break
    else:
        members = written(merged(members, links_between(vectors, members)), "members")
        counted = written(links_in_components(vectors, members), "links")
    per_class = (
        vectors.select("id", "copies", "space")
        .join(members.withColumnRenamed("node", "id"), "id", "left")
        .join(counted, "id", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    # Back from classes to rows: copies share the vector, so each finds its class by it. A hot vector is the many side of a join.
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    space = F.when(F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.concat_ws("/", F.size(vec), F.col(label_col)))
    rows = df.select(F.col(id_col).alias("vec_id"), space.alias("space"), vec.alias("vec"))
    first = rows.where("space is not null").groupBy("space", "vec").agg(F.min("vec_id").alias("id"))
    named = first.join(per_class, "id").select("space", F.xxhash64("vec").alias("mark"), F.col("vec").alias("same"), "n_links", "component_id")
    marked = rows.where("space is not null").withColumn("mark", F.xxhash64("vec"))
    known = marked.join(named, ["space", "mark"]).where("vec = same").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(known, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept)


def op9_nn_descent(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
