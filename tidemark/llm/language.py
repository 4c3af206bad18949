"""Language identification with error-correcting output codes over byte n-grams.

Every language has a codeword. Each bit is a binary naive Bayes classifier over hashed trigrams that separates the languages
with the bit from those without. A text is decoded to the language whose codeword has the least loss, bits weighted by
how well they speak for that language; a small lead marks the answer as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import bucket_of, table

BUCKETS = 1 << 14
SMOOTHING = 0.5
TEMPERATURE = 24.0
AMBIGUOUS_LEAD = 0.5
UNKNOWN = "und"
# Letters in lower case; digits, punctuation and controls become blanks; bytes of other scripts stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed trigrams with a letter in the middle."""
    data = np.frombuffer((" " + text + " ").encode("utf-8", "replace").translate(FOLD), dtype=np.uint8).astype(np.uint32)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    codes = codes[data[1:-1] != 32]
    return ((codes * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1. All distinct splits up to five languages; beyond, the best of random dense codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=float).T
    rng, best = np.random.default_rng(seed), None
    width = max(15, 10 * int(np.ceil(np.log2(n))))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        gap = (width - (code @ code.T - 2 * width * np.eye(n)).max()) / 2
        if (abs(code.sum(0)) < n).all() and (best is None or gap > best[0]):
            best = gap, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # buckets x bits: log odds of a trigram
    trust: np.ndarray  # languages x bits, rows sum to 1


def count_grams(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, bucket, n): trigrams of all labelled texts, added up inside each task before the shuffle."""
    source = df.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1), strict=True):
                found = np.bincount(grams(text.as_py()), minlength=BUCKETS)
                key = label.as_py()
                sums[key] = sums[key] + found if key in sums else found
        for key, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["label", "bucket", "n"]
            )

    return source.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from every labelled text. The driver gets labels x BUCKETS sums at most, whatever the number of texts."""
    rows = count_grams(df, text_col, label_col).toPandas()
    languages = sorted(rows["label"].unique().tolist())
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["label"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"]
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True) if languages else counts
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 1)), np.ones((len(languages), 1)))
    with_bit = (code > 0).astype(float)
    yes = with_bit.T @ share / with_bit.sum(0)[:, None]
    no = (1 - with_bit).T @ share / (1 - with_bit).sum(0)[:, None]
    weight = np.log(yes / no).T
    # What a bit says on average about texts of each language: the more, the more its loss counts there.
    trust = np.maximum(code * (share @ weight), 1e-6)
    return Model(languages, code, weight, trust / trust.sum(1, keepdims=True))


PREDICTED = "struct<lang:string,score:double,ambiguous:boolean>"


def identify(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``df`` with ``out_col``: language, score in 0..1 and a flag for a narrow decision.

    Null texts, texts without a letter and models without languages give ``und``, score 0, ambiguous. Whole texts count,
    rows are independent of each other, other columns are kept (one named ``out_col`` is replaced).
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def decode(text: str | None):
        if not model.languages or text is None or not any(map(str.isalpha, text)):
            return {"lang": UNKNOWN, "score": 0.0, "ambiguous": True}
        found = grams(text)
        margin = np.bincount(found, minlength=BUCKETS) @ model.weight / max(len(found), 1)
        loss = (model.trust * np.logaddexp(0, -model.code * margin * TEMPERATURE)).sum(1)
        chance = np.exp(loss.min() - loss)
        order = np.argsort(loss, kind="stable")
        lead = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return {
            "lang": model.languages[order[0]],
            "score": float(1 / chance.sum()),
            "ambiguous": bool(lead < AMBIGUOUS_LEAD),
        }

    @F.arrow_udf(PREDICTED)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([decode(t.as_py()) for t in texts], type=kind)

    return df.withColumn(out_col, run(F.col(text_col)))


def trained(docs: DataFrame) -> Model:
    """The production model: learned from documents whose id hashes to 0 or 2 of 3."""
    return fit(docs.where(bucket_of("doc_id", 3) != 1))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), trained(docs))
    return found.select(
        "doc_id",
        (bucket_of("doc_id", 3) == 1).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.ambiguous").alias("ambiguous"),
    )
