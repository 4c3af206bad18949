"""BPE encoding and decoding with a public vocabulary; long unsplit text by tree concatenation.

A piece that the pre-tokeniser leaves unsplit may be very long. It is cut into leaves that are encoded independently; then
neighbouring halves are joined up the tree: a window of some tokens on both sides of the join is encoded anew and doubled
until its first and last tokens are those that the halves had there. A sequence of tokens is the encoding of its text exactly if
each two neighbours are the encoding of theirs (ranks grow with the order of merges), so agreement at both ends makes the
joined sequence exact.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, models, normalizers

LEAF = 48
BLANK = re.compile("[\t\n\v\f\r]")
WINDOW = 4
CACHED_WORDS = 60_000
TEXTS_AT_ONCE = 256  # a task holds the ids of so many texts, whatever the size of a batch


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary file's BPE model: split, merge by rank, join token strings by a space."""

    def __init__(self, file: str):
        self.spec = json.loads(Path(file).read_text(encoding="utf-8"))
        self._ready = False

    def __getstate__(self):
        return {"spec": self.spec, "_ready": False}

    def _prepare(self) -> None:
        model, spec = self.spec["model"], self.spec
        self.vocab = dict(model["vocab"])
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        # Merging by rank in short runs is the library's work: inside a word, and at its end.
        self.inner = models.BPE(self.vocab, merges)
        self.ending = models.BPE(self.vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space is a single blank behind the normaliser, which knows the library's own notion of it.
        self.split = regex.compile(split.replace(r"\s", " "))
        self.normal = normalizers.Sequence(
            [normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]
        )
        self.letters = byte_letters()
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self._ready = True

    def merged(self, symbols: list[str]) -> list[str]:
        """Tokens of a short run of symbols; only the last symbol may carry the word end."""
        text = "".join(symbols)
        if self.suffix and text.endswith(self.suffix) and len(symbols[-1]) > 1:
            return [t.value for t in self.ending.tokenize(text[: -len(self.suffix)])]
        return [t.value for t in self.inner.tokenize(text)]

    def _symbols(self, tokens: list[str]) -> list[str]:
        found = []
        for t in tokens:
            body = t.removesuffix(self.suffix) if self.suffix else t
            found += body
            if len(body) != len(t):
                found[-1] += self.suffix
        return found

    def joined(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of both texts together from the encodings of each."""
        if not left or not right:
            return left or right
        take = WINDOW
        while True:
            i, j = min(take, len(left)), min(take, len(right))
            window = self.tree(self._symbols(left[-i:] + right[:j]), whole=True)
            agrees_left = i == len(left) or window[0] == left[-i]
            agrees_right = j == len(right) or window[-1] == right[j - 1]
            if agrees_left and agrees_right:
                return left[:-i] + window + right[j:]
            take *= 2

    def tree(self, symbols: list[str], whole: bool = False) -> list[str]:
        """Leaves, then joins level by level. ``whole``: a small window, encoded in one go."""
        if whole or len(symbols) <= LEAF:
            return self.merged(symbols)
        level = [self.merged(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)]
        while len(level) > 1:
            level = [self.joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def piece(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode("utf-8", "replace")]
        if len(letters) <= LEAF:
            return [t.id for t in self.ending.tokenize("".join(letters))]
        letters[-1] += self.suffix
        return [self.vocab[t] for t in self.tree(letters)]

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of text between two blanks: normalised, split, each piece encoded."""
        text = text.lower() if text.isascii() else self.normal.normalize_str(text)
        if text.isalpha():
            return tuple(self.piece(text))
        ids: list[int] = []
        for word in self.split.findall(text):
            ids += self.piece(word)
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        if not self._ready:
            self._prepare()
        ids: list[int] = []
        if not text:
            return ids
        for part in self.special.split(text) if self.special and "<|" in text else (text,):
            if part in self.added:
                ids.append(self.added[part])
                continue
            # Neither normaliser nor splitter looks across a blank, so chunks may be encoded and remembered one by one.
            for chunk in BLANK.sub(" ", part).split(" "):
                found = self.young.get(chunk)
                if found is None:
                    found = self.old.get(chunk)
                    if found is None:
                        found = self.chunk(chunk)
                    if len(chunk) <= LEAF:
                        if len(self.young) >= CACHED_WORDS:
                            self.old, self.young = self.young, {}
                        self.young[chunk] = found
                ids += found
        return ids

    def decode(self, ids) -> str:
        if not self._ready:
            self._prepare()
        return " ".join(map(self.token.__getitem__, ids))


ENCODED = "struct<ids:array<int>,decoded:string>"


def encode_texts(df: DataFrame, file: str, text_col: str = "text", out_col: str = "bpe") -> DataFrame:
    """``df`` with ``out_col``: struct of the token ids of ``text_col`` and the text decoded from these ids.

    Null and empty texts have no tokens and decode to the empty text. Texts are encoded whole, however long; each row on its
    own, so repeated rows, ties and other columns change nothing. A column named ``out_col`` is replaced.
    """
    model = WordBpe(file)

    def encoded(texts: pa.Array) -> pa.Array:
        parts, decoded, ends = [], [], [0]
        for t in texts:
            ids = model.encode(t.as_py())
            parts.append(np.array(ids, dtype=np.int32))
            ends.append(ends[-1] + len(ids))
            decoded.append(model.decode(ids))
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], ["ids", "decoded"])

    @F.arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                yield encoded(texts.slice(at, TEXTS_AT_ONCE))

    return df.withColumn(out_col, run(F.col(text_col)))


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    ids = F.col("bpe.ids")
    return encoded.select(
        *keep,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"),
    )


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    from tidemark.llm.tables import table

    return digests(encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path()), "doc_id")
