"""Repeated substrings by enhanced suffix arrays, distributed.

Every window of LENGTH bytes picks the smallest hash of its GRAM-byte grams as its anchor, so equal windows have equal anchors,
in the same place. Neighbouring windows with one anchor are a run. Equal runs meet by hash and only the earliest stays in play;
what remains are runs that share an anchor but not all bytes. Their bytes are put together by anchor and indexed: suffix array
by prefix doubling, common prefixes of neighbours from the doubling ranks, intervals of the common-prefix tree by a stack, and
for each interval a test whether the bytes to the left differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import table
from tidemark.llm.wordhash import MIX, _LETTER, mixed, powers
from tidemark.session import written

LENGTH = 100
GRAM = 28
SEGMENT = 1_000_000  # windows handled at once; their places fit into PLACE_BITS
PLACE_BITS = np.uint64(20)
CHUNK = 1 << 21  # bytes of context indexed together
HOT = 100_000  # runs of one anchor beyond which its windows are compared by hash instead


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, from running minima inside blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def sums_of(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    return sums


def runs(data: bytes) -> tuple[np.ndarray, ...]:
    """(anchor, run, at, n): hash of the anchor, hash of the run's bytes, first window and number of windows of each run."""
    parts = []
    for begin in range(0, len(data) - LENGTH + 1, SEGMENT):
        own = np.frombuffer(data[begin : begin + SEGMENT + LENGTH - 1], dtype=np.uint8)
        sums, (_, down) = sums_of(own), powers(len(own))
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(own) - GRAM + 1])
        places = np.arange(len(grams), dtype=np.uint64)
        least = sliding_minimum((grams >> PLACE_BITS << PLACE_BITS) | places, LENGTH - GRAM + 1)
        place = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        at = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        n = np.diff(np.append(at, len(place)))
        whole = mixed(((sums[at + n + LENGTH - 1] - sums[at]) * down[at]) ^ mixed(n.astype(np.uint64) * MIX))
        parts.append((grams[place[at]].view(np.int64), whole.view(np.int64), at + begin, n))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


@dataclass
class Index:
    """Enhanced suffix array of the windows of some contexts: order, common prefixes of neighbours, byte to the left (-1: none)."""

    order: np.ndarray
    common: np.ndarray
    left: np.ndarray

    def intervals(self, least: int = LENGTH) -> list[tuple[int, int, int]]:
        """(common prefix, first, last) of the tree of intervals, by a stack; only prefixes of ``least`` and more."""
        found, stack = [], []
        for i in range(1, len(self.order) + 1):
            height = int(self.common[i]) if i < len(self.order) else 0
            begin = i - 1
            while stack and stack[-1][0] > height:
                top, begin = stack.pop()
                found.append((top, begin, i - 1))
            if height >= least and (not stack or stack[-1][0] < height):
                stack.append((height, begin))
        return found

    def maximal(self, least: int = LENGTH) -> list[tuple[int, np.ndarray]]:
        """(length, places) of each repeat that no byte extends to either side; all places of each."""
        changes = np.concatenate([[0], np.cumsum(self.left[self.order][1:] != self.left[self.order][:-1])])
        return [
            (length, self.order[a : b + 1])
            for length, a, b in self.intervals(least)
            if changes[b] > changes[a] or self.left[self.order[a]] < 0
        ]


def suffix_index(contexts: list[bytes], windows: np.ndarray) -> Index:
    """Index over the first ``windows[i]`` suffixes of each context, all at least LENGTH long."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts) + bytes(LENGTH), dtype=np.uint8)
    total = int(sizes.sum())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first = np.repeat(starts, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = np.repeat(starts + sizes, windows)
    # Ranks of the next 8 bytes, then of 16, 32 and 64 by pairs of ranks.
    word = np.zeros(total + LENGTH - 7, dtype=np.uint64)
    for k in range(8):
        word |= data[k : len(word) + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    ranks, width = [np.unique(word, return_inverse=True)[1].astype(np.uint64)], 8
    while width < 64:
        last = ranks[-1]
        pair = (last[:-width] << np.uint64(32)) | last[width:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.uint64))
        width *= 2
    last = ranks[-1]
    rest = LENGTH - 64
    prefix = (last[first] << np.uint64(32)) | last[first + rest]
    order = np.argsort(prefix, kind="stable")
    at, end = first[order], ends[order]
    # Suffixes with LENGTH bytes in common are ordered by what follows, up to the end of their context.
    tail = [np.where(at + o + 8 <= end, word[np.minimum(at + o, len(word) - 1)], 0) for o in range(LENGTH, LENGTH + 73, 8)]
    finer = np.lexsort((*reversed(tail), prefix[order]))
    order, at, end = order[finer], at[finer], end[finer]
    a, b = at[:-1], at[1:]
    room = np.minimum(end[:-1] - a, end[1:] - b)
    common = np.zeros(len(a), dtype=np.int64)
    equal = prefix[order][1:] == prefix[order][:-1]
    for level, width in ((3, 64), (3, 64), (2, 32), (1, 16), (0, 8)):
        fits = equal & (common + width <= room)
        i, j = (a + common)[fits], (b + common)[fits]
        common[np.flatnonzero(fits)[ranks[level][i] == ranks[level][j]]] += width
    for _ in range(8):
        fits = np.flatnonzero(equal & (common < room))
        fits = fits[data[(a + common)[fits]] == data[(b + common)[fits]]]
        common[fits] += 1
    before = np.where(np.isin(first, starts), -1, data[first - 1].astype(np.int64))
    return Index(order, np.concatenate([[0], common]), before)


def full_index(contexts: list[bytes], windows: np.ndarray, left: np.ndarray) -> Index:
    """The same for contexts of any length, by prefix doubling up to their ends. ``left``: byte before each context (-1: none)."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    end, place = np.repeat(starts + sizes, sizes), np.arange(len(data))
    ranks, width = [data.astype(np.uint64)], 1
    while width < sizes.max():
        inside = place + width < end
        after = np.where(inside, ranks[-1][np.where(inside, place + width, 0)] + np.uint64(1), np.uint64(0))
        ranks.append(np.unique(ranks[-1] << np.uint64(32) | after, return_inverse=True)[1].astype(np.uint64))
        width *= 2
    first = np.repeat(starts, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    order = np.argsort(ranks[-1][first], kind="stable")
    a, b = first[order][:-1], first[order][1:]
    room = np.minimum(end[a] - a, end[b] - b)
    common = np.zeros(len(a), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        fits = np.flatnonzero(common < room)
        same = ranks[level][(a + common)[fits]] == ranks[level][(b + common)[fits]]
        common[fits[same]] += 1 << level
    before = np.where(np.isin(first, starts), np.repeat(left, windows), data[first - 1].astype(np.int64))
    return Index(order, np.concatenate([[0], np.minimum(common, room)]), before)


def later_windows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, n): runs of windows of the rows' contexts that an earlier context, or an earlier place in it, has too.

    ``rows``: doc_id, at, n, context.
    """
    doc, at, n = (rows.column(c).to_numpy() for c in ("doc_id", "at", "n"))
    index = suffix_index([c.as_py() for c in rows.column("context")], n)
    owner = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place, paper = at[owner] + window, doc[owner]
    age = np.lexsort((place, paper))
    # A window that a repeated row brings twice has one age.
    older = np.concatenate([[0], np.cumsum((np.diff(place[age]) != 0) | (paper[age][1:] != paper[age][:-1]))])
    rank = np.empty(len(owner), dtype=np.int64)
    rank[age] = older[: len(age)]
    # The outermost intervals of the tree hold all suffixes with LENGTH bytes in common; all but the earliest are repeats.
    group = np.cumsum(index.common < LENGTH) - 1
    earliest = np.minimum.reduceat(rank[index.order], np.flatnonzero(index.common < LENGTH)) if len(group) else group
    later = np.zeros(len(owner), dtype=bool)
    later[index.order] = rank[index.order] > earliest[group]
    hits = np.flatnonzero(later)
    if not len(hits):
        return (np.empty(0, np.int64),) * 3
    fresh = np.concatenate([[True], (np.diff(hits) > 1) | (owner[hits][1:] != owner[hits][:-1])])
    begin = np.flatnonzero(fresh)
    return owner[hits[begin]], window[hits[begin]], np.diff(np.append(begin, len(hits)))


def anchor_runs(docs: DataFrame) -> DataFrame:
    """(anchor, run, doc_id, at, n) of every text. ``docs``: doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            parts = [runs(t.as_py().encode("utf-8", "replace")) for t in batch.column(1)]
            doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            if len(doc):
                anchor, run, at, n = (np.concatenate(c) for c in zip(*parts, strict=True))
                columns = [pa.array(anchor), pa.array(run), batch.column(0).take(pa.array(doc)), pa.array(at), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "run", "doc_id", "at", "n"])

    return docs.where("text is not null and doc_id is not null").mapInArrow(cut, f"anchor long, run long, doc_id {kind}, at long, n int")


def repeated_runs(found: DataFrame) -> DataFrame:
    """(anchor, doc_id, at, n, later): later runs equal an earlier one; others share their anchor with a different run."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["anchor", "run", "doc_id", "at"]
    rows = found.repartition(parts, "anchor").sortWithinPartitions(*order)
    kind = found.schema["doc_id"].dataType.simpleString()

    def sift(batches):
        """Streams; the last first run waits for what follows it."""
        held, held_company, last, row = None, False, None, None
        for batch in batches:
            if not len(batch):
                continue
            # A run that a repeated row of its document brings again is no repeat.
            doc, at = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            anchor, run = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (run[1:] != run[:-1]) | (anchor[1:] != anchor[:-1])
            new[0] = row != (anchor[0], run[0], doc[0], at[0])
            row = (anchor[-1], run[-1], doc[-1], at[-1])
            if not new.all():
                batch = batch.filter(pa.array(new))
                if not len(batch):
                    continue
            anchor, run = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.ones(len(anchor), dtype=bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])
            first[0] = last != (anchor[0], run[0])
            last = (anchor[-1], run[-1])
            again = np.flatnonzero(~first)
            if len(again):
                yield out(batch, again, True)
            leads = np.flatnonzero(first)
            if not len(leads):
                continue
            same = anchor[leads][1:] == anchor[leads][:-1]
            joined = held is not None and held.column(0)[0].as_py() == anchor[leads[0]]
            if held is not None and (held_company or joined):
                yield out(held, np.array([0]), False)
            company = np.concatenate([[joined], same]) | np.concatenate([same, [False]])
            ready = leads[:-1][company[:-1]]
            if len(ready):
                yield out(batch, ready, False)
            held, held_company = batch.slice(int(leads[-1]), 1), bool(company[-1])
        if held is not None and held_company:
            yield out(held, np.array([0]), False)

    def out(batch, at, later):
        own = pa.Table.from_batches([batch]).take(at).combine_chunks()
        columns = [own.column(c).chunk(0) for c in ("anchor", "doc_id", "at", "n")]
        return pa.RecordBatch.from_arrays([*columns, pa.array([later] * len(at))], ["anchor", "doc_id", "at", "n", "later"])

    return rows.mapInArrow(sift, f"anchor long, doc_id {kind}, at long, n int, later boolean")


def contexts(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, at, n, context): the bytes of all windows of each run."""
    lists = edges.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at", "n")).alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for doc, text, own in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data, doc, own = text.as_py().encode("utf-8", "replace"), doc.as_py(), own.as_py()
                bytes_ = [data[r["at"] : r["at"] + r["n"] + LENGTH - 1] for r in own]
                columns = [pa.array([r[k] for r in own], t) for k, t in (("anchor", pa.int64()), ("at", pa.int64()), ("n", pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [columns[0], pa.array([doc] * len(own), batch.column(0).type), columns[1], columns[2], pa.array(bytes_, pa.binary())],
                    ["anchor", "doc_id", "at", "n", "context"],
                )

    rows = docs.join(lists, "doc_id").select("doc_id", "text", "runs")
    return rows.mapInArrow(cut, f"anchor long, doc_id {kind}, at long, n int, context binary")


def chunks(batches, size: int = CHUNK):
    """Sorted rows in tables of about ``size`` bytes of context, never cutting an anchor."""
    held, weight = [], 0
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        if weight >= size and held:
            anchor = rows.column(0).to_numpy()
            stop = int(np.searchsorted(anchor != held[-1].column(0)[-1].as_py(), True))
            if stop < len(anchor):
                yield pa.concat_tables([*held, rows.slice(0, stop)]).combine_chunks()
                held, weight, rows = [], 0, rows.slice(stop)
        held.append(rows)
        weight += pa.compute.sum(pa.compute.binary_length(rows.column("context"))).as_py() or 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def repeats_by_index(found: DataFrame) -> DataFrame:
    """(doc_id, at, n): windows of the contexts that stand earlier in another context of their anchor."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.repartition(parts, "anchor").sortWithinPartitions("anchor")
    kind = found.schema["doc_id"].dataType.simpleString()

    def search(batches):
        for own in chunks(batches):
            row, window, n = later_windows(own)
            if len(row):
                doc = own.column("doc_id").take(pa.array(row)).combine_chunks()
                doc = doc.chunk(0) if isinstance(doc, pa.ChunkedArray) else doc
                at = own.column("at").to_numpy()[row] + window
                yield pa.RecordBatch.from_arrays([doc, pa.array(at), pa.array(n.astype(np.int32))], ["doc_id", "at", "n"])

    return rows.mapInArrow(search, f"doc_id {kind}, at long, n int")


def repeats_by_hash(found: DataFrame) -> DataFrame:
    """The same for anchors of more than HOT runs: windows meet by two hashes, added up in each task before the shuffle."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            for doc, at, n, context in zip(*[batch.column(c) for c in ("doc_id", "at", "n", "context")], strict=True):
                data, n = np.frombuffer(context.as_py(), dtype=np.uint8), n.as_py()
                sums, (_, down) = sums_of(data), powers(len(data))
                half = LENGTH // 2
                one = mixed((sums[half : half + n] - sums[:n]) * down[:n])
                two = mixed((sums[LENGTH : LENGTH + n] - sums[half : half + n]) * down[half : half + n])
                place = pa.array(at.as_py() + np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([doc.as_py()] * n, batch.column("doc_id").type), place], ["one", "two", "doc_id", "at"])

    windows = found.mapInArrow(split, f"one long, two long, doc_id {kind}, at long")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    met = windows.join(first, ["one", "two"]).where(F.struct("doc_id", "at") != F.col("first"))
    return met.select("doc_id", "at", F.lit(1).alias("n"))


def stretches(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, at, n, context, left): the bytes from each run to the end of the runs that adjoin it, and the byte before."""
    lists = edges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "n", "anchor"))).alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for doc, text, own in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data, own, stop = text.as_py().encode("utf-8", "replace"), own.as_py(), None
                for r, following in zip(reversed(own), [None, *reversed(own[1:])], strict=True):
                    end = r["at"] + r["n"]
                    stop = stop if following and following["at"] == end else end
                    left = data[r["at"] - 1] if r["at"] else -1
                    cells = [[r["anchor"]], [doc.as_py()], [r["at"]], [r["n"]], [data[r["at"] : stop + LENGTH - 1]], [left]]
                    kinds = [pa.int64(), batch.column(0).type, pa.int64(), pa.int32(), pa.binary(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["anchor", "doc_id", "at", "n", "context", "left"])

    rows = docs.join(lists, "doc_id").select("doc_id", "text", "runs")
    return rows.mapInArrow(cut, f"anchor long, doc_id {kind}, at long, n int, context binary, left int")


def maximal_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(anchor, repeat, length, doc_id, at): all maximal repeats of LENGTH bytes and more, each with all its occurrences.

    ``anchor`` and ``repeat`` together name a repeat. Rows that repeat an id and text are the same document. Each run brings
    the bytes up to the end of its repeated stretch, so the work grows with the square of a stretch's length.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    found = written(anchor_runs(docs).select("anchor", "doc_id", "at", "n"), "runs")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stretches(found.join(shared, "anchor", "left_semi"), docs).repartition(parts, "anchor").sortWithinPartitions("anchor")

    def search(batches):
        for own in chunks(batches):
            n = own.column("n").to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            anchor, doc, at = own.column("anchor").to_numpy(), own.column("doc_id"), own.column("at").to_numpy()
            index = full_index([c.as_py() for c in own.column("context")], n, own.column("left").to_numpy())
            for k, (length, places) in enumerate(index.maximal()):
                who = owner[places]
                docs_ = doc.take(pa.array(who)).to_pylist()
                m = len(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[who]), pa.array([k] * m), pa.array([length] * m), pa.array(docs_, doc.type), pa.array(at[who] + window[places])],
                    ["anchor", "repeat", "length", "doc_id", "at"],
                )

    return rows.mapInArrow(search, f"anchor long, repeat long, length long, doc_id {kind}, at long")


REMOVED = "struct<removed:array<struct<start:long,end:long>>,kept:binary>"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: byte ranges covered by LENGTH-byte strings that stand earlier too, and the rest.

    Earlier: in a document with a smaller id, or further ahead in the same one; judged on the input. Null and empty texts
    and texts under LENGTH bytes lose nothing. Rows that repeat an id and text are the same document; rows with a null id are kept
    whole and remove nothing from others.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = written(repeated_runs(anchor_runs(docs)), "runs")
    edges = found.where("not later").select("anchor", "doc_id", "at", "n")
    hot = edges.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > HOT).select("anchor")
    later = found.where("later").select("doc_id", "at", "n")
    if hot.take(1):
        marked = contexts(edges.join(hot, "anchor", "left_semi"), docs)
        later = later.unionByName(repeats_by_hash(marked))
        edges = edges.join(hot, "anchor", "left_anti")
    later = later.unionByName(repeats_by_index(contexts(edges, docs)))
    lists = later.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    kind = pa.struct([("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    @F.arrow_udf(REMOVED)
    def cut(texts: pa.Array, runs_: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, runs_, strict=True):
            data = text.as_py().encode("utf-8", "replace")
            spans: list[list[int]] = []
            for a, b in sorted((r["at"], r["at"] + r["n"] + LENGTH - 1) for r in own.as_py() or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            ends = [0, *[b for _, b in spans]]
            starts = [*[a for a, _ in spans], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(ends, starts, strict=True))
            out.append({"removed": [{"start": a, "end": b} for a, b in spans], "kept": kept})
        return pa.array(out, type=kind)

    done = docs.join(lists, "doc_id", "left").withColumn("cut", cut("text", "runs"))
    return done.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "cut.removed", "cut.kept")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
