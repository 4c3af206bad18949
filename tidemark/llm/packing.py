"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of length l belongs to class j = capacity // l, the lengths in (capacity / (j+1), capacity / j], and a bin of that class takes
exactly j pieces. A document's tail whose class would leave more than ``slack`` of its bin empty is cut: the longest length that
fits its class well goes to that class, and so on with the rest. Each task fills the bins of its own documents, so nothing is
shuffled. The bins that it could not fill at its end are joined and cut anew, into full sequences and at last into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters, vocabulary_path
from tidemark.llm.tables import table

CAPACITY = 1024
SLACK = 16
END_ID = 0
# Sequences of a task are numbered from its partition number times this.
SEQUENCES_A_TASK = 1 << 40
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Encoder of a byte-level vocabulary file: its tokens by rank, its added tokens wherever their text stands."""

    def __init__(self, file: str):
        spec = json.loads(Path(file).read_text(encoding="utf-8"))
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Ids grow with the order of merges, so that they serve as ranks.
        self.ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._encoding = None

    def __getstate__(self):
        return self.__dict__ | {"_encoding": None}

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self._encoding is None:
            self._encoding = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens=self.special)
        return self._encoding.encode_to_numpy(text, allowed_special="all")


def first_cuts(capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Length of the piece to cut off a tail of l tokens, by l: l itself if bins of its class lose at most ``slack`` tokens."""
    cuts = [0]
    for length in range(1, capacity + 1):
        cuts.append(length if capacity % length <= slack else cuts[-1])
    return cuts


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class Bins:
    """Open bins of one task, one per class; at most ``capacity`` of them, each of less than ``capacity`` tokens."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, slack: int = SLACK):
        self.capacity, self.cuts, self.next_id = capacity, first_cuts(capacity, slack), first_id
        self.open: dict[int, list] = {}

    def add(self, key, ids: np.ndarray):
        """Cut a document; yields the pieces of the bins that it fills."""
        start = 0
        while start < len(ids):
            left = len(ids) - start
            n = self.capacity if left >= self.capacity else self.cuts[left]
            held = self.open.setdefault(self.capacity // n, [])
            held.append((key, start, ids[start : start + n], len(ids)))
            if len(held) == self.capacity // n:
                yield from self._sealed(self.open.pop(self.capacity // n))
            start += n

    def rest(self):
        """Pieces of what the open bins hold, joined and cut into full sequences and powers of two."""
        pieces = [p for _, held in sorted(self.open.items()) for p in held]
        self.open = {}
        total = sum(len(p[2]) for p in pieces)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        todo = iter(pieces)
        key, start, ids, whole = None, 0, (), 0
        for size in sizes:
            held = []
            while size:
                if not len(ids):
                    key, start, ids, whole = next(todo)
                n = min(size, len(ids))
                held.append((key, start, ids[:n], whole))
                start, ids, size = start + n, ids[n:], size - n
            yield from self._sealed(held)

    def _sealed(self, held):
        offset = 0
        for key, start, ids, whole in held:
            yield key, start, ids, whole, self.next_id, offset
            offset += len(ids)
        self.next_id += 1


def pack(
    docs: DataFrame,
    model: ByteBpe,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    slack: int = SLACK,
    end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``keep_ids``, ids.

    Null and empty texts are the end id alone. Each row is a document of its own, so repeated rows and rows without an id are
    packed like others. Long texts are encoded whole. An empty table gives no pieces. Other columns are not read. Sequence numbers
    depend on how the table is split into tasks, and are the same when a task is repeated.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    shape = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]) + (", ids array<int>" if keep_ids else "")

    def table_of(pieces: list, key_type) -> pa.RecordBatch:
        keys, starts, ids, wholes, numbers, offsets = zip(*pieces, strict=True) if pieces else ((),) * 6
        longs = [starts, [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], wholes, numbers, offsets]
        columns = [pa.array(keys, key_type), *[pa.array(c, pa.int64()) for c in longs]]
        if keep_ids:
            ends = np.cumsum([0, *longs[1]]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, [*names, "ids"] if keep_ids else names)

    def run(batches):
        bins = Bins(TaskContext.get().partitionId() * SEQUENCES_A_TASK, capacity, slack)
        key_type = None
        for batch in batches:
            key_type, pieces = batch.schema.field(0).type, []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces += bins.add(key, np.append(model.encode(text.as_py()), np.uint32(end_id)))
            yield table_of(pieces, key_type)
        if key_type is not None:
            yield table_of(list(bins.rest()), key_type)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence without padding; a sequence has at most ``capacity`` pieces."""
    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return own.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padding tokens, pieces and documents. A length that is a power of two is not padded."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("start") == 0).alias("documents"))
    exact = F.bit_count("used") == 1
    return used.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("used").alias("tokens"),
        F.sum(F.when(exact, 0).otherwise(capacity - F.col("used"))).alias("padding"),
        F.sum("pieces").alias("pieces"),
        F.sum("documents").alias("documents"),
    )


def op12_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, ByteBpe(vocabulary_path("byte_bpe_50k.json")), keep_ids=False)
