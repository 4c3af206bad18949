"""Secret scan: all rules in one minimised automaton, one byte pass over every text.

The pass runs from the end of the text to its beginning with the automaton of the mirrored rules, so each state tells
which rules have a match that *starts* at this byte. Only from such bytes a second automaton reads forward to the longest
end. That gives leftmost, longest, non-overlapping matches of each kind, whatever the rules are.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automaton import Hit, accepted, compile_rules, linked, mirrored, parse


@dataclass(frozen=True)
class Rule:
    """``head`` then ``value``; a match is kept if its value has ``least`` characters or more."""

    kind: str
    head: str
    value: str
    least: int = 0


# The three base rules, in the order in which equal starts are listed.
BASE = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""",
        r"[A-Za-z0-9+/_.=-]+",
        12,
    ),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18),
    # A shorter run is a failing match that hides nothing, so the length may be part of the pattern.
    Rule("hex", "", r"[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("github", "", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", "", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY( BLOCK)?-----"),
)
RULES = BASE + MORE


class Scanner:
    """Compiled rules; the transition arrays travel to the tasks, the linked lists are built there once."""

    def __init__(self, rules=RULES):
        self.rules = tuple(rules)
        full = [parse(r.head + r.value) for r in self.rules]
        self.starts = compile_rules([mirrored(t) for t in full], anchored=False)
        self.ends = compile_rules(full, anchored=True)
        self.heads = compile_rules([parse(r.head) for r in self.rules], anchored=True)
        self._linked = None

    def __getstate__(self):
        return self.__dict__ | {"_linked": None}

    @staticmethod
    def _longest(states, dead, data: bytes, at: int, bit: int) -> int:
        row = states[0]
        end = -1
        if isinstance(row, Hit):
            end, row = at if row.mask & bit else -1, row.row
        for i in range(at, len(data)):
            row = row[data[i]]
            if row is dead:
                break
            if isinstance(row, Hit):
                if row.mask & bit:
                    end = i + 1
                row = row.row
        return end

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) in code points, sorted."""
        if not text:
            return []
        if self._linked is None:
            tables = []
            for table, masks in (self.starts, self.ends, self.heads):
                states = linked(table, masks)
                dead = next((r for r in states if isinstance(r, list) and all(x is r for x in r)), None)
                tables.append((states, dead))
            self._linked = tables
        starts, ends, heads = self._linked
        data = text.encode("utf-8", "replace")
        marks = [(len(data) - 1 - i, mask) for i, mask in accepted(starts[0][0], data[::-1])]
        if not marks:
            return []
        found = []
        for k, rule in enumerate(self.rules):
            bit, cursor = 1 << k, 0
            for at, mask in reversed(marks):
                if not mask & bit or at < cursor:
                    continue
                end = self._longest(*ends, data, at, bit)
                value = self._longest(*heads, data, at, bit) if rule.head else at
                if end - value >= rule.least:
                    found.append((at, k, end))
                cursor = end
        if len(data) != len(text):
            cuts = sorted({p for at, _, end in found for p in (at, end)})
            places, seen, before = {}, 0, 0
            for p in cuts:
                seen += len(data[before:p].decode("utf-8"))
                places[p], before = seen, p
            found = [(places[a], k, places[e]) for a, k, e in found]
        return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secrets", rules=RULES) -> DataFrame:
    """``df`` with ``out_col``: the spans found in ``text_col``, by start, then in the order of the rules.

    Positions count code points, ends are exclusive. Null and empty texts have an empty list. Rows are independent: repeated
    rows give repeated results, other columns are kept; a column named ``out_col`` is replaced.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in scanner.rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": kinds[k], "start": a, "end": e} for a, k, e in scanner.spans(t.as_py())] for t in texts]
        return pa.array(rows, type=kind)

    return df.withColumn(out_col, scan(F.col(text_col)))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules=RULES) -> DataFrame:
    """``df`` with every found span replaced by ``mark``; overlapping spans become one mark. Null stays null."""
    found = find_secrets(df, text_col, "__secrets", rules)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def cut(done, s):
        gap = F.substring(F.col(text_col), done["at"] + 1, s["start"] - done["at"])
        fresh = s["start"] >= done["at"]
        out = F.when(fresh, F.concat(done["text"], gap, F.lit(mark))).otherwise(done["text"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("text"))

    def finish(done):
        return F.concat(done["text"], F.col(text_col).substr(done["at"] + 1, F.length(text_col)))

    text = F.when(F.size("__secrets") > 0, F.aggregate("__secrets", start, cut, finish)).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).drop("__secrets")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    from tidemark.llm.tables import table

    found = find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans")
    )
