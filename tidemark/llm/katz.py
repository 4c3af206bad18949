"""Katz backoff language model over words, and scores of whole texts.

Words are told apart by 64-bit hashes; each text ends in one end token and each first token has the start of text as its history.
Bigrams of all words and all training tokens are counted. Good-Turing discounts free probability, which each history hands to
the unigrams with a weight that makes its distribution sum to one exactly; words never seen share one type.

The pairs are kept in a table dealt and bucketed by history, SHARE training tokens a bucket; a history with more tokens is spread
over several buckets by its successors. A row holds many pairs as packed arrays, so shuffles move few large rows. Texts send their
pairs to the buckets, which look them up and send back one sum per text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import bucket_of, table
from tidemark.llm.wordhash import MIX, folded, mixed, word_hashes
from tidemark.session import release, scratch_dir, scratch_tables, shuffles_dropped, written

DISCOUNTED = 5  # counts up to this are discounted
HELD = 500_000  # tokens that a task holds before it sends them on
SHARE = 1_000_000  # training tokens a bucket
FILES = 100_000  # file buckets of the table of pairs; more buckets share them
PASSES = 2  # texts are scored in so many passes, so that the pairs of a part of them lie on disk at a time
TEXTS = 1 << 16  # a slice of texts has at most so many, so that a place in it takes two bytes
END = np.uint64(0xE0D)  # hash of the end token
START = np.uint64(0x57A)  # history of the first token
TINY = 1e-300


def text_tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes(folded(text)), END)


def held_tokens(batches, column: int):
    """Lists of the token arrays of about HELD tokens."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(column):
            held.append(text_tokens(text.as_py()))
            size += len(held[-1])
            if size >= HELD:
                yield held
                held, size = [], 0
    if held:
        yield held


def summed(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, n): tokens of all texts, counted inside each task over HELD tokens at a time, then added up."""

    def count(batches):
        for held in held_tokens(batches, 0):
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select(text_col).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def pairs_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's history and the token."""
    return np.concatenate([np.array([START], dtype=np.uint64), tokens[:-1]]), tokens


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    change = np.ones(len(keys[0]), dtype=bool)
    change[1:] = False
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


def pair_code(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(h * MIX ^ w)


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between neighbouring cuts."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def numbers(column, kind) -> np.ndarray:
    """All values of a packed column."""
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), dtype=kind)


def packed(bucket: np.ndarray, key: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """One row per bucket: its number, its different keys, how often each stands, and the other columns. Sorted by bucket and key."""
    row, first = starts_of(bucket), starts_of(bucket, key)
    cuts, key_cuts = np.append(row, len(key)), np.append(np.searchsorted(first, row), len(first))
    runs = np.diff(np.append(first, len(key))).astype(np.uint32)
    return [pa.array(bucket[row]), binary(key[first], key_cuts), binary(runs, key_cuts), *[binary(c, cuts) for c in columns]]


def unpacked(rows: pa.Table) -> np.ndarray:
    """The key of each entry."""
    return np.repeat(numbers(rows.column("keys"), np.uint64), numbers(rows.column("runs"), np.uint32))


def good_turing(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Katz's discount ratios of the counts 1..DISCOUNTED; 1 where the counts of counts give none in (0, 1)."""
    k, n1 = DISCOUNTED, counts_of_counts.get(1, 0)
    out = np.ones(k + 1)
    if not n1:
        return out
    a = (k + 1) * counts_of_counts.get(k + 1, 0) / n1
    for r in range(1, k + 1):
        nr = counts_of_counts.get(r, 0)
        ratio = (r + 1) * counts_of_counts.get(r + 1, 0) / (r * nr) if nr else 1.0
        d = (ratio - a) / (1 - a) if a < 1 else 1.0
        out[r] = d if 0 < d < 1 else 1.0
    return out


def discounted(n: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    return n * np.where(n <= DISCOUNTED, ratios[np.minimum(n, DISCOUNTED)], 1.0)


@dataclass
class Model:
    tokens: int
    types: int
    size: int  # bytes of the training texts
    ends: int  # training texts
    discount: np.ndarray  # of unigrams
    unseen: float  # probability of the type of unseen words
    scale: float
    buckets: int
    hot: np.ndarray  # words with over SHARE tokens, sorted; at most as many as buckets
    hot_counts: np.ndarray
    pair_discount: np.ndarray
    hot_given: np.ndarray  # what discounted counts leave of the tokens after each hot word
    hot_covered: np.ndarray  # unigram probability of the words seen after it
    pairs: DataFrame | None = None  # the bucketed table of packed pairs

    def one(self, n: np.ndarray) -> np.ndarray:
        """Unigram probability of words with these training counts."""
        if not self.tokens:
            return np.ones(len(n))
        return np.where(n > 0, discounted(n, self.discount) / self.tokens * self.scale, self.unseen)

    def bucket(self, owner: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Bucket of each pair by one of its words; pairs of a hot word are spread by the other one."""
        at, known = places(self.hot, owner)
        spread = np.ones(len(owner), dtype=np.uint64)
        spread[known] = -(-self.hot_counts[at[known]] * self.buckets // self.tokens)
        return (mixed(mixed(owner) + mixed(other) % spread) % np.uint64(self.buckets)).astype(np.int32)

    def units(self, total: np.ndarray, given: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factor of a history's discounted counts and its backoff weight, which together make it sum to one."""
        full, share = covered > 1 - 1e-12, given / np.maximum(total, 1)
        # A history without discounted counts still owes something to words that it was not seen with; one seen with all owes nothing.
        part = np.where(full, 1.0, np.where(share > 1 - 1e-6, 1 - 1 / (total + 1), share))
        return part / np.maximum(given, TINY), np.where(full, TINY, np.maximum((1 - part) / np.maximum(1 - covered, TINY), TINY))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all texts of ``docs``; null counts as the empty text, repeated rows count repeatedly.

    Counts of counts and the words with over SHARE tokens come to the driver, the pairs stay in a table. Without texts the model
    gives every text the score 0.
    """
    spark, before = docs.sparkSession, scratch_tables()
    unigrams = written(summed(docs, text_col), "unigrams")
    total, types, ends = unigrams.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("key") == int(END), F.col("n"))), F.lit(0))
    ).first()
    rows = unigrams.where(F.col("n") <= DISCOUNTED + 1).groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()
    classes = {r.n: r.words for r in rows}
    buckets = max(1, -(-total // SHARE))
    top = {r.key: r.n for r in unigrams.where(F.col("n") * buckets > total).collect()}  # fewer than buckets
    release(spark, list(set(scratch_tables()) - set(before)))
    if int(END) in top:
        top[int(START)] = top[int(END)]
    hot = np.array(list(top), dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    discount = good_turing(classes)
    few = {r: c for r, c in classes.items() if r <= DISCOUNTED}
    mass = (sum(r * c * discount[r] for r, c in few.items()) + total - sum(r * c for r, c in few.items())) / max(total, 1)
    # Without singletons nothing is freed: then unseen words get as much as one token.
    unseen, scale = (1 - mass, 1.0) if mass < 1 - 1e-12 else (1 / (total + 1), total / (total + 1) / max(mass, TINY))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    none = np.ones(DISCOUNTED + 1)
    counts = np.array(list(top.values()), dtype=np.int64)[order]
    model = Model(total, types, size, ends, discount, unseen, scale, buckets, hot[order], counts, none, np.zeros(len(top)), np.zeros(len(top)))
    if total:
        count_pairs(model, docs, text_col)
    return model


STATS = "history long, counts array<long>, covered double"


def count_pairs(model: Model, docs: DataFrame, text_col: str) -> None:
    """Count all bigrams. They meet by word, where the counts of the words are known, then by history, where they are stored."""
    bare = replace(model)

    def send(batches):
        for held in held_tokens(batches, 0):
            history, word = (np.concatenate(x) for x in zip(*map(pairs_of, held), strict=True))
            for at in range(0, len(word), 2 * HELD):
                h, w = history[at : at + 2 * HELD], word[at : at + 2 * HELD]
                bucket = bare.bucket(w, h)
                order = np.lexsort((h, w, bucket))
                h, w, bucket = h[order], w[order], bucket[order]
                first = starts_of(w, h)
                n = np.diff(np.append(first, len(w))).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(packed(bucket[first], w[first], h[first], n), ["bucket", "keys", "runs", "histories", "n"])

    def by_word(group: pa.Table) -> pa.Table:
        w, h, n = unpacked(group), numbers(group.column("histories"), np.uint64), numbers(group.column("n"), np.uint32)
        order = np.lexsort((h, w))
        w, h, n = w[order], h[order], n[order].astype(np.int64)
        first = starts_of(w, h)
        w, h, n = w[first], h[first], np.add.reduceat(n, first)
        at = starts_of(w)
        own = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(w))))
        place, known = places(bare.hot, w)
        own[known] = bare.hot_counts[place[known]]  # only a part of a hot word's pairs is here
        bucket = bare.bucket(h, w)
        order = np.lexsort((w, h, bucket))
        rows = packed(bucket[order], h[order], w[order], n[order].astype(np.uint32), own[order])
        # Counts of counts over all pairs and, of hot histories, over theirs, with the probability of their words.
        place, known = places(bare.hot, h)
        which = np.where(known, place + 1, 0)
        small = np.minimum(n, DISCOUNTED + 2) - 1
        table_ = np.zeros((len(bare.hot) + 1, DISCOUNTED + 2), dtype=np.int64)
        np.add.at(table_, (which, small), 1)
        covered = np.bincount(which, weights=bare.one(own), minlength=len(table_))
        met = np.flatnonzero(table_.any(axis=1)[1:]) + 1
        history = [None, *bare.hot[met - 1].view(np.int64).tolist()]
        counts = [table_.sum(axis=0).tolist(), *table_[met].tolist()]
        stats = [pa.array(history, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array([0.0, *covered[met].tolist()])]
        here, more = len(rows[0]), len(history)
        buckets = pa.concat_arrays([rows[0], pa.array(np.arange(more, dtype=np.int32) % np.int32(bare.buckets))])
        packs = [pa.concat_arrays([x, pa.nulls(more, pa.binary())]) for x in rows[1:]]
        extra = [pa.concat_arrays([pa.nulls(here, x.type), x]) for x in stats]
        return pa.Table.from_arrays([buckets, *packs, *extra], ["bucket", "keys", "runs", "words", "n", "own", "history", "counts", "covered"])

    def by_history(group: pa.Table) -> pa.Table:
        """The pairs of a bucket in one row, and its other rows as they are."""
        h, w = unpacked(group), numbers(group.column("words"), np.uint64)
        n, own = numbers(group.column("n"), np.uint32), numbers(group.column("own"), np.int64)
        order = np.lexsort((w, h))
        number = group.column("bucket")[:1].combine_chunks().to_numpy()
        stats = group.filter(pc.is_null(group.column("keys")))
        if not len(h):
            return stats
        rows = packed(np.repeat(number, len(h)), h[order], w[order], n[order], own[order])
        one = pa.Table.from_arrays([*rows, *[pa.nulls(1, f.type) for f in stats.schema][6:]], stats.schema.names)
        return pa.concat_tables([one, stats])

    shape = "bucket int, keys binary, runs binary, words binary, n binary, own binary, " + STATS
    sent = docs.select(text_col).mapInArrow(send, "bucket int, keys binary, runs binary, histories binary, n binary")
    before = scratch_tables()
    counted = written(sent.groupBy("bucket").applyInArrow(by_word, shape), "counted")
    files = min(model.buckets, FILES)
    stored = bucketed(counted.repartition(files, "bucket").groupBy("bucket").applyInArrow(by_history, shape), files)
    release(docs.sparkSession, list(set(scratch_tables()) - set(before)))
    sums = [F.sum(F.col("counts")[i]).alias(f"n{i + 1}") for i in range(DISCOUNTED + 1)]
    rows = stored.where("keys is null").groupBy("history").agg(*sums, F.sum("covered").alias("covered")).collect()
    found = {r.history: r for r in rows}
    model.pair_discount = good_turing({i: found[None][f"n{i}"] for i in range(1, DISCOUNTED + 2)})
    for i, h in enumerate(model.hot.view(np.int64).tolist()):
        if h in found:
            lost = sum(r * found[h][f"n{r}"] * (1 - model.pair_discount[r]) for r in range(1, DISCOUNTED + 1))
            model.hot_given[i], model.hot_covered[i] = model.hot_counts[i] - lost, found[h]["covered"]
    model.pairs = stored.where("keys is not null").select("bucket", "keys", "runs", "words", "n", "own")


def bucketed(df: DataFrame, files: int) -> DataFrame:
    """``df``, dealt by its column ``bucket``, as a scratch table bucketed by it, so that a join by it moves only the other side."""
    spark, name = df.sparkSession, f"pairs_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.bucketBy(files, "bucket").option("compression", "zstd").option("path", scratch_dir(spark, "pairs")).saveAsTable(name)
    return spark.table(name)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; log10 probabilities.

    Null counts as the empty text, which is one end token. Repeated rows give repeated results, ids may be null. Without training
    texts both scores are 0. Rows are dealt to the passes by id; the scores of a pass are stored before the next one starts.
    """
    own = F.pmod(F.xxhash64(id_col), F.lit(passes))
    done = [written(scored(docs.where(own == k), model, id_col, text_col), "scores") for k in range(passes)]
    return reduce(DataFrame.unionByName, done)


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """The scores of one pass. Rows must come in an order that a repeated task finds again, as those of a table do."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bare = replace(model, pairs=None)
    names = ["bucket", "slice", "keys", "runs", "words", "at", "ids", "tokens"]

    def ask(batches):
        """Pairs of a slice of texts, by bucket, and one row with its ids and sizes."""
        part, number = TaskContext.get().partitionId(), 0
        ids, held, size, id_type = [], [], 0, None

        def out():
            own = (part << 33) + number
            if bare.tokens:
                history, word = (np.concatenate(x) for x in zip(*map(pairs_of, held), strict=True))
                place = np.repeat(np.arange(len(held), dtype=np.uint16), [len(t) for t in held])
                for a in range(0, len(word), 2 * HELD):
                    h, w, at = (x[a : a + 2 * HELD] for x in (history, word, place))
                    bucket = bare.bucket(h, w)
                    order = np.lexsort((h, bucket))
                    cells = packed(bucket[order], h[order], w[order], at[order])
                    n = len(cells[0])
                    none = [pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays([cells[0], pa.array(np.full(n, own)), *cells[1:], *none], names)
            sizes = np.array([len(t) for t in held], dtype=np.int64).tobytes()
            bucket = pa.array([own % bare.buckets], pa.int32())
            none = [pa.nulls(1, pa.binary())] * 4
            yield pa.RecordBatch.from_arrays([bucket, pa.array([own]), *none, pa.array([ids], pa.list_(id_type)), pa.array([sizes])], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                held.append(text_tokens(text.as_py()))
                size += len(held[-1])
                if size >= HELD or len(held) == TEXTS:
                    yield from out()
                    ids, held, size, number = [], [], 0, number + 1
        if held:
            yield from out()

    def look_up(asked: pa.Table, pairs: pa.Table) -> pa.Table:
        """Sums of the asked pairs per slice and text; rows with ids pass."""
        lists = asked.filter(pc.is_valid(asked.column("keys")))
        through = asked.filter(pc.is_null(asked.column("keys")))
        through = through.select(["slice", "ids", "tokens"])
        for name in ("at", "known", "base", "score"):
            through = through.append_column(name, pa.nulls(len(through), pa.binary()))
        if not len(lists):
            return through
        h, w, at = unpacked(lists), numbers(lists.column("words"), np.uint64), numbers(lists.column("at"), np.uint16)
        per_row = [len(x) // 2 for x in lists.column("at").to_pylist()]
        of_slice = np.repeat(lists.column("slice").to_numpy(), per_row)
        known, base, logs = values(h, w, pairs)
        order = np.lexsort((at, of_slice))
        at, of_slice = at[order], of_slice[order]
        first = starts_of(of_slice, at)
        sums = [np.add.reduceat(x[order], first, dtype=x.dtype) for x in (known, base, logs)]
        row = starts_of(of_slice[first])
        cuts = np.append(row, len(first))
        cells = [pa.array(of_slice[first][row]), pa.nulls(len(row), through.schema.field("ids").type), pa.nulls(len(row), pa.binary())]
        cells += [binary(at[first], cuts), *[binary(x, cuts) for x in sums]]
        return pa.concat_tables([through, pa.Table.from_arrays(cells, through.schema.names)])

    def values(h, w, pairs: pa.Table):
        """Of each asked pair (history, word): what its history adds as a word, its backoff weight and the pair's gain over it."""
        own_h, own_w = unpacked(pairs), numbers(pairs.column("words"), np.uint64)
        n, own = numbers(pairs.column("n"), np.uint32).astype(np.int64), numbers(pairs.column("own"), np.int64)
        lower, kept = bare.one(own), discounted(n, bare.pair_discount)
        # Histories stand in sorted order in the one row of the bucket.
        first = starts_of(own_h)
        if len(first):
            total, given, covered = (np.add.reduceat(x, first) for x in (n, kept, lower))
        else:
            total, given, covered = (np.zeros(0) for _ in range(3))
        mine = own_h[first]
        place, hot = places(bare.hot, mine)
        total[hot], given[hot], covered[hot] = bare.hot_counts[place[hot]], bare.hot_given[place[hot]], bare.hot_covered[place[hot]]
        unit, weight = bare.units(total, given, covered)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own_h))))
        gain = np.log10(np.maximum(kept * unit[of], TINY)) - np.log10(np.maximum(lower, TINY)) - np.log10(weight[of])
        place, known = places(mine, h)
        count, logs = np.zeros(len(h), dtype=np.int64), np.zeros(len(h))
        count[known], logs[known] = total[place[known]], np.log10(weight)[place[known]]
        # A hot history may be unknown to this bucket but not to others.
        place, hot = places(bare.hot, h)
        lone = hot & ~known
        _, far = bare.units(bare.hot_counts.astype(float), bare.hot_given, bare.hot_covered)
        count[lone], logs[lone] = bare.hot_counts[place[lone]], np.log10(far)[place[lone]]
        word = h != START  # the start of text is no token
        logs += np.where(word, np.log10(np.maximum(bare.one(count), TINY)), 0.0)
        code = pair_code(own_h, own_w)
        order = np.argsort(code)
        place, met = places(code[order], pair_code(h, w))
        place = order[place] if len(order) else place
        met[met] = (own_h[place[met]] == h[met]) & (own_w[place[met]] == w[met])
        logs[met] += gain[place[met]]
        return (word & (count > 0)).astype(np.int32), np.where(word, np.log10(count + 0.5), 0.0), logs

    norm = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    end_base = float(np.log10(model.ends + 0.5))
    end_score = float(np.log10(max(model.one(np.array([model.ends]))[0], TINY)))

    def add_up(group: pa.Table) -> pa.Table:
        """The texts of a slice. The end token is no history, so its own probability is added here."""
        head = group.filter(pc.is_valid(group.column("tokens")))
        ids, sizes = head.column("ids").combine_chunks().flatten(), numbers(head.column("tokens"), np.int64)
        at = numbers(group.column("at"), np.uint16)
        sums = [
            np.bincount(at, weights=numbers(group.column(c), t), minlength=len(sizes))
            for c, t in (("known", np.int32), ("base", np.float64), ("score", np.float64))
        ]
        if not bare.tokens:
            zero = np.zeros(len(sizes))
            return pa.Table.from_arrays([ids, pa.array(sizes), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], result)
        known = sums[0].astype(np.int64) + (bare.ends > 0)
        base = sums[1] + end_base - sizes * norm
        return pa.Table.from_arrays([ids, pa.array(sizes), pa.array(known), pa.array(base), pa.array(sums[2] + end_score)], result)

    result = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    asked = rows.mapInArrow(ask, f"bucket int, slice long, keys binary, runs binary, words binary, at binary, ids array<{kind}>, tokens binary")
    shape = f"slice long, ids array<{kind}>, tokens binary, at binary, known binary, base binary, score binary"
    if model.pairs is None:
        sums = asked.select("slice", "ids", "tokens", *[F.lit(None).cast("binary").alias(c) for c in ("at", "known", "base", "score")])
    else:
        # Texts of many times the training texts' size meet each bucket in several parts.
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = 1 + size // max(4 * model.size, 4096)
        keys, pairs = ["bucket"], model.pairs
        if parts > 1:
            keys = ["bucket", "part"]
            asked = asked.withColumn("part", F.pmod(F.hash("slice"), F.lit(parts)))
            pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            pairs = pairs.withColumn("part", F.col("part").cast(asked.schema["part"].dataType))
        sums = asked.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(look_up, shape)
    out = sums.groupBy("slice").applyInArrow(add_up, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_katz(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs.where(bucket_of("doc_id", 5) != 1))
    held = (bucket_of("doc_id", 5) == 1).alias("held_out")
    return score(docs, model).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
