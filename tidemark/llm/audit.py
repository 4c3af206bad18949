"""How document filters interact: what each removes in every order, and its exact Shapley share.

All that the audit says follows from one small table: per part and set of failed filters, the number of documents. From it come
the documents that each of the 32 coalitions of filters removes. A step of an order is the difference of two coalitions. The
Shapley values are those of the least-squares problem with the Shapley kernel as weights and the sum fixed to what all filters
remove together (efficiency); its normal equations are solved in rationals, so nothing is rounded.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import table

# --- fixed values: names and limits of the five filters ---
NAMES = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
SIGNS = b"#$%&*|"
# ---
CAPITALS = bytes(range(65, 91))
FOLLOWING = bytes(range(0x80, 0xC0))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(data: bytes) -> int:
    """Bits 0 to 3 (A to D) of the filters that UTF-8 text fails; bytes.split() cuts at the six ASCII white-space bytes."""
    words = data.split()
    failed = int(len(words) < LEAST_WORDS)
    failed |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    capitals = len(data) - len(data.translate(None, CAPITALS))
    if capitals:
        failed |= (100 * capitals > CAPITALS_PERCENT * len(data.translate(None, FOLLOWING))) << 2
    return failed | (len(data.translate(None, SIGNS)) < len(data)) << 3


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, failed, digest, n): bits A to D and the SHA-256 of each text; equal rows are counted in n."""

    @F.arrow_udf("int")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([failures(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.int32())

    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), part.alias("part"), judge(text).alias("failed"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    return rows.groupBy("doc_id", "part", "failed", "digest").agg(F.count(F.lit(1)).alias("n"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic``: whether any label row of the id says quality 1, or toxic 1. No label, or no id: false."""
    any_of = labels.groupBy(F.col(id_col).alias("id_")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # Rows without an id meet no label; the second key spreads them over all tasks.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    keyed = rows.withColumn("spread_", spread)
    joined = keyed.join(any_of.withColumn("zero_", F.lit(0).cast("long")), (F.col("doc_id") == F.col("id_")) & (F.col("spread_") == F.col("zero_")), "left")
    return joined.select(*rows.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def tabulate(rows: DataFrame) -> DataFrame:
    """(part, failed, n, n_good, n_toxic): documents by the set of filters that they fail, E (bit 4) included.

    Copies of a text are reduced to one row per part and label before they meet, however many they are. The documents with
    the smallest id of their text pass E, all others but those without an id fail it.
    """
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_unknown"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
    )
    smallest = F.min("first").over(Window.partitionBy("digest"))
    passing = F.col("n_unknown") + F.when(F.col("first") == smallest, F.col("n_first")).otherwise(F.lit(0))
    split = groups.withColumn("passing", passing).select(
        "part", "failed", "good", "toxic", F.explode(F.array(
            F.struct(F.lit(0).alias("repeat"), F.col("passing").alias("n")),
            F.struct(F.lit(1 << NAMES.index("E")).alias("repeat"), (F.col("n") - F.col("passing")).alias("n")),
        )).alias("s"),
    )
    n = F.col("s.n")
    # The first of these sums has its own map side, so that the table below has few rows per task whatever the parts hold.
    return split.groupBy("part", (F.col("failed") + F.col("s.repeat")).alias("failed")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("n_toxic")
    )


def removals(failed: list[int], n: list[int], filters: int) -> list[int]:
    """Documents that each coalition (bits of its filters) removes: those that fail at least one of them."""
    masks, counts = np.array(failed, dtype=np.int64), np.array(n, dtype=np.int64)
    return [int(counts[(masks & c) != 0].sum()) for c in range(1 << filters)]


def solver(filters: int) -> list[list[Fraction]]:
    """Inverse of the normal equations bordered by the efficiency constraint, in rationals.

    Unknowns: one value per filter, then the multiplier. Weight of a coalition of s filters: (M-1) / (C(M,s) s (M-s)).
    """
    size = filters + 1
    matrix = [[Fraction(0)] * size for _ in range(size)]
    for c in range(1, (1 << filters) - 1):
        inside = [i for i in range(filters) if c >> i & 1]
        for i in inside:
            for j in inside:
                matrix[i][j] += weight(filters, len(inside))
    for i in range(filters):
        matrix[i][filters] = matrix[filters][i] = Fraction(1)
    wide = [row + [Fraction(int(i == j)) for j in range(size)] for i, row in enumerate(matrix)]
    for col in range(size):  # Gauss-Jordan
        pivot = next(r for r in range(col, size) if wide[r][col])
        wide[col], wide[pivot] = wide[pivot], wide[col]
        wide[col] = [x / wide[col][col] for x in wide[col]]
        for r in range(size):
            if r != col and wide[r][col]:
                factor = wide[r][col]
                wide[r] = [x - factor * y for x, y in zip(wide[r], wide[col], strict=True)]
    return [row[size:] for row in wide]


def weight(filters: int, s: int) -> Fraction:
    return Fraction(filters - 1, comb(filters, s) * s * (filters - s))


def shapley(removed: list[int], inverse: list[list[Fraction]]) -> list[Fraction]:
    """The filters' shares of what all remove, from the removals of all coalitions."""
    filters = len(inverse) - 1
    right = [Fraction(0)] * filters
    for c in range(1, (1 << filters) - 1):
        inside = [i for i in range(filters) if c >> i & 1]
        for i in inside:
            right[i] += weight(filters, len(inside)) * removed[c]
    right.append(Fraction(removed[-1]))
    return [sum(a * b for a, b in zip(row, right, strict=True)) for row in inverse[:filters]]


def orders(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from the table of ``tabulate``."""
    filters = len(names)
    listed = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "n_good", "n_toxic")).alias("t"))  # 2^filters rows a part
    sequences = list(permutations(range(filters)))

    def expand(batches):
        inverse, everything = solver(filters), (1 << filters) - 1
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                masks = [c["failed"] for c in cells]
                gone, good, toxic = (removals(masks, [c[k] for c in cells], filters) for k in ("n", "n_good", "n_toxic"))
                total = sum(c["n"] for c in cells)
                shares = [factorial(filters) * x for x in shapley(gone, inverse)]
                out = []
                for order in sequences:
                    name, done = "".join(names[f] for f in order), 0
                    for step, f in enumerate(order, 1):
                        bit = 1 << f
                        now, removed = done | bit, gone[done | bit] - gone[done]
                        out.append((
                            part, name, step, total - gone[now], removed, gone[bit] - removed, gone[-1] - gone[everything ^ bit],
                            good[now] - good[done], toxic[now] - toxic[done], int(shares[f]),
                        ))
                        done = now
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return listed.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of every step of every order of the five filters, per part; see ``COUNTS`` and the module's text.

    Null texts count as empty ones, null parts as the empty part. A document without an id has no smaller id and is never a
    repeat. Rows with the same id are documents of their own; of rows that share the smallest id of a text none is a repeat.
    Several label rows of an id: one that says 1 is enough. An empty table has no parts, so no rows. Other columns are not read.
    """
    return orders(tabulate(labelled(marked(docs, id_col, text_col, part_col), labels, id_col)))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


# The 120 orders are all ways to choose five different letters.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), m AS (
  SELECT part, doc_id,
    (len(words) < 50)::INT AS a,
    (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT AS c,
    regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS failed, count(*) AS n, coalesce(sum(good), 0) AS g, coalesce(sum(toxic), 0) AS x
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)
), o AS (
  SELECT p.name || q.name || r.name || s.name || u.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM f p, f q, f r, f s, f u WHERE p.bit | q.bit | r.bit | s.bit | u.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[:step]) - bits[step] AS done
  FROM o, range(1, 6) AS i(step)
), raw AS (
  SELECT part, filter_order, step, bit,
    sum(n * (failed & (done | bit) = 0)::INT) AS kept,
    sum(n * (failed & done = 0 AND failed & bit > 0)::INT) AS removed,
    sum(n * (failed & done > 0 AND failed & bit > 0)::INT) AS redundant,
    sum(n * (failed = bit)::INT) AS unique_fails,
    sum(g * (failed & done = 0 AND failed & bit > 0)::INT) AS good_lost,
    sum(x * (failed & done = 0 AND failed & bit > 0)::INT) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM raw
"""
