"""Filter audit, packing and ranked search against plain Python, on the given tables and on odd input."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import brute
import numpy as np
import pytest
from public_tokenizers import path as vocabulary
from tokenizers import Tokenizer

from tidemark.llm import audit, packing, ranking

DOC = "doc_id long, text string, source string, failed string, n string, item string"
ODD = [None, "", " \t\n", "a", "A" * 40, "é" * 30, "x " * 60, " ".join(f"w{i}" for i in range(60)), "50% off", "a|b", "a\x0bb\x1cc", "ÀB" * 9]


def frame(spark, rows):
    """Rows of (doc_id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOC).repartition(3)


# --- filter audit ---
def brute_audit(rows, labels):
    texts = {}
    for key, text, _ in rows:
        if key is not None:
            texts[text or ""] = min(key, texts.get(text or "", key))
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in (0, 1))
    facts = []
    for key, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": key is not None and texts[t] < key,
        }
        facts.append((part or "", {f for f in failed if failed[f]}, key in good, key in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own, total = [f for f in facts if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = [x for x in own if f in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(fails) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)
                ]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def audited(spark, rows, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(frame(spark, rows), known).collect()
    assert len(got) == len({r[:3] for r in got})
    return {tuple(r[:3]): list(r[3:]) for r in got}


def test_audit_of_odd_rows(spark):
    rnd = random.Random(1)
    words = ["the", "of", "Kind", "NATO", "x%", "and", "to"] + [f"w{i}" for i in range(90)]
    texts = ODD + [" ".join(rnd.choices(words, k=rnd.choice((3, 49, 50, 51, 200)))) for _ in range(20)]
    rows = [(i, rnd.choice(texts), rnd.choice(["a", "b", None, ""])) for i in range(150)]
    rows += [(None, t, "n") for t in ODD] + [rows[5], rows[5], rows[0]]
    labels = [(rnd.randrange(170), rnd.randint(0, 1), rnd.randint(0, 1)) for _ in range(120)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_the_given_table(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in brute.rows("documents")]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in brute.rows("labels")]
    want = brute_audit(rows, labels)
    got = audit.op11_filter_audit(spark, brute.DATA).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in got} == want


def test_audit_of_empty_tables(spark):
    assert audited(spark, [(1, "a", "s")], [])["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(frame(spark, [(1, "a", "s")]).limit(0), labels).count() == 0


def test_shapley_values_are_exact():
    rnd = random.Random(2)
    masks, n = list(range(32)), [rnd.randrange(10**12) for _ in range(32)]
    removed = audit.removals(masks, n, 5)
    share = [Fraction(0)] * 5
    for order in permutations(range(5)):
        done = 0
        for f in order:
            share[f] += Fraction(removed[done | 1 << f] - removed[done], 120)
            done |= 1 << f
    found = audit.shapley(removed, audit.solver(5))
    assert found == share and sum(found) == removed[-1]


# --- packing ---
def checked_pieces(rows, model, pieces, ids=True):
    """All rules of the contract; returns (padding, tokens)."""
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    wanted = Counter()
    for key, text in rows:
        own = library.encode(text, add_special_tokens=False).ids if text else []
        wanted[key, tuple([*own, 0])] += 1
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        if ids:
            assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
            by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    if ids:
        for (key, size), own in by_doc.items():
            copies = sum(n for (k, t), n in wanted.items() if k == key and len(t) == size)
            assert sum(p.length for p in own) == copies * size
            if copies == 1:
                own.sort(key=lambda p: p.start)
                assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
                assert wanted[key, tuple(x for p in own for x in p.ids)] == 1
    assert sum(p.length for p in pieces) == sum(len(t) * n for (_, t), n in wanted.items())
    padding = tokens = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        used = sum(p.length for p in own)
        assert 0 < used <= 1024
        tokens += used
        padding += 0 if used & (used - 1) == 0 else 1024 - used
    return padding, tokens


@pytest.fixture(scope="module")
def model():
    return packing.ByteBpe(vocabulary("byte_bpe_50k.json"))


def test_encoder_equals_the_library(model):
    rnd = random.Random(3)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["", "a<|endoftext|>b<|endoftext|>", "<|endoftext", " " * 5000, "\n\n \t x", "a" * 9000, "it's we'll I'LL ’s", "ñandú 漢字 नमस्ते 😀👍🏽 ́a \x00 \x85   　x"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x3000), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(300)) for _ in range(40)]
    for t in texts:
        assert model.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_of_odd_rows(spark, model):
    rnd = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (50, "twice"), (50, "twice"), (51, "long " * 5000), (52, "a" * 30000)]
    rows += [(100 + i, " ".join(f"w{rnd.randrange(999)}" for _ in range(rnd.randrange(1, 900)))) for i in range(60)]
    docs = frame(spark, [(*r, "s") for r in rows])
    pieces = packing.pack(docs, model).collect()
    padding, tokens = checked_pieces(rows, model, pieces)
    assert padding <= 0.01 * tokens
    again = packing.pack(docs, model, keep_ids=False)
    assert sorted(again.collect(), key=str) == sorted([p[:-1] for p in pieces], key=str)
    assert packing.pack(docs.limit(0), model).count() == 0
    report = packing.padding(again).first()
    assert (report.padding, report.tokens, report.documents) == (padding, tokens, len(rows))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(docs, model)).collect()}
    assert len(whole) == report.sequences and sum(map(len, whole.values())) == tokens


def test_packing_of_the_given_table(spark, model):
    rows = [(r["doc_id"], r["text"]) for r in brute.rows("documents")]
    pieces = packing.op12_harmonic_packing(spark, brute.DATA).collect()
    padding, tokens = checked_pieces(rows, model, pieces, ids=False)
    assert padding <= 0.01 * tokens
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows}
    places = {}
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        places.setdefault(p.doc_id, []).append((p.start, p.length))
    for key, own in places.items():
        own.sort()
        assert [s for s, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) == len(ids[key])


def test_bins_of_a_class_take_its_number_of_pieces():
    for capacity, slack in ((1024, 8), (1024, 0), (100, 3), (7, 0)):
        bins = packing.Bins(5, capacity, slack)
        rnd = random.Random(capacity)
        sealed = {}
        for key in range(300):
            for k, _, ids, _, number, _ in bins.add(key, np.zeros(rnd.randrange(1, 3 * capacity), np.uint32)):
                sealed.setdefault(number, []).append(len(ids))
        for lengths in sealed.values():
            assert {capacity // n for n in lengths} == {len(lengths)} and capacity - sum(lengths) <= slack
        rest = {}
        for _, _, ids, _, number, _ in bins.rest():
            rest[number] = rest.get(number, 0) + len(ids)
        assert not set(rest) & set(sealed) and all(n == capacity or n & (n - 1) == 0 for n in rest.values())


# --- ranked search ---
def brute_search(rows, items, best=10):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    held = [(key, Counter(w), len(w)) for key, text in rows if (w := terms(text))]
    count, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(terms(text)), []
        for key, c, n in held:
            m = 100 - 75 + 75 * n * count // total
            s = sum(k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def test_search_of_odd_rows(spark):
    rnd = random.Random(5)
    words = ["the", "THE", "of", "Über", "über", "x1", "1", "naïve", "foo-bar", "a_b", "日本語", "é", "of.the"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 40))) for _ in range(60)] + ODD + ["the the the"] * 30
    rows = list(enumerate(texts)) + [(None, "the of über"), (None, None), (3, texts[3]), (3, texts[3])]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))) for i in range(12)] + [(90, None), (91, ""), (92, "absent"), (93, "the the of"), (94, "THE")]
    docs = frame(spark, [(*r, "s") for r in rows])
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, score int")
    want = brute_search(rows, items)
    assert sorted([tuple(r) for r in ranking.search(docs, asked).collect()], key=str) == want
    # In blocks of few items, with repeated item rows.
    assert sorted([tuple(r) for r in ranking.search(docs, asked.unionByName(asked), block_bytes=40).collect()], key=str) == want
    assert ranking.search(docs.limit(0), asked).count() == 0 and ranking.search(docs, asked.limit(0)).count() == 0
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    found = ranking.search(named, asked).collect()
    assert {(r.item_id, r["rank"], r.score) for r in found} == {(i, k, s) for i, k, _, s in want}


def test_search_of_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in brute.rows("documents")]
    items = [(r["item_id"], r["text"]) for r in brute.rows("benchmark")]
    assert sorted([tuple(r) for r in ranking.op13_ranked_search(spark, brute.DATA).collect()], key=str) == brute_search(rows, items)
