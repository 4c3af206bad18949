"""Secret scan, BPE, language ID and decontamination against plain Python."""

import random

import brute
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, language, postings, secrets
from tidemark.llm.automaton import compile_rules, parse

ODD = [None, "", " ", "x", "\x00", "é" * 30, "token=abcdefghijkl", "token=abcdefghijkl", "123 456", "a" * 20_000]


def frame(spark, texts, extra=True):
    data = [(i, t, "en" if i % 2 else None, "kept") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, secrets string")
    return df if extra else df.drop("secrets")


def test_automaton_is_minimal_and_right():
    table, masks = compile_rules([parse("(a|b)*abb")], anchored=True)
    assert len(masks) == 5  # the four states of the textbook and the dead one
    state = 0
    for b in b"abababb":
        state = table[state, b]
    assert masks[state] == 1


def test_secret_spans_match_regular_expressions():
    rnd, scan = random.Random(1), secrets.Scanner()
    parts = ["token", "=", ": ", '"', "'", "secret", "API_KEY", "passwd", " ", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "é", "日", "=", "x" * 12, "ghp_", "eyJ", "."]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [s for s in scan.spans(text) if s[1] < 3] == brute.secrets(text), text
    assert [(k, e) for _, k, e in scan.spans("ghp_" + "a1Z" * 12)] == [(3, 40)]
    assert [k for _, k, _ in scan.spans("-----BEGIN RSA PRIVATE KEY-----")] == [7]


def test_secret_query_and_redaction(spark):
    got = {r.doc_id: r for r in secrets.op1_secret_scan(spark, brute.DATA).collect()}
    for doc in brute.rows("documents"):
        spans, row = brute.secrets(doc["text"]), got[doc["doc_id"]]
        names = ["assign", "access", "hex"]
        assert row.base_sha256 == brute.sha(",".join(f"{names[k]}:{a}:{e}" for a, k, e in spans))
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    df = frame(spark, [*ODD, "é token=abcdefghijkl, 日 0123456789abcdef0 end", "AKIA" + "A" * 16])
    clean = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert clean[10].text == "é [SECRET], 日 [SECRET] end" and clean[11].text == "[SECRET]"
    assert clean[0].text is None and clean[1].text == "" and clean[3].secrets == "kept"
    assert secrets.redact(df.limit(0)).count() == 0 and secrets.find_secrets(df).columns == df.columns


def test_bpe_equals_the_library():
    file = bpe.vocabulary_path()
    library, own, rnd = Tokenizer.from_file(file), bpe.WordBpe(file), random.Random(2)
    texts = [d["text"] for d in brute.rows("documents")]
    texts += ["".join(rnd.choice("abeth ntin é日Σ😀́İ\x1c\x85\t²'") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|startoftext|> b<|STARTOFTEXT|>", "-" * 3000, "日" * 1500, "it's we'll"]
    texts += ["".join(rnd.choice(["the", "in", "an", "aaaa", "é", "zz"]) for _ in range(rnd.randint(20, 1500))) for _ in range(150)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want and own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_tree_joins_equal_one_encoding():
    model, rnd = bpe.WordBpe(bpe.vocabulary_path()), random.Random(3)
    model.encode("a")
    for _ in range(200):
        letters = [rnd.choice("athenrsiould") for _ in range(rnd.randint(2, 400))]
        assert model.tree(letters) == model.merged(letters)


def test_bpe_query_and_odd_texts(spark):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = {r.doc_id: r for r in bpe.op2_bpe(spark, brute.DATA).collect()}
    for doc in brute.rows("documents"):
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids
        row = got[doc["doc_id"]]
        assert row.n_tokens == len(ids) and row.ids_sha256 == brute.sha(" ".join(map(str, ids)))
        assert row.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))
    odd = bpe.digests(bpe.encode_texts(frame(spark, ODD), bpe.vocabulary_path()), "doc_id").collect()
    assert [r.n_tokens for r in sorted(odd)][:3] == [0, 0, 0] and len(odd) == len(ODD)
    assert bpe.encode_texts(frame(spark, ODD).limit(0), bpe.vocabulary_path()).count() == 0


def test_bpe_of_batches_longer_than_a_slice(spark):
    library, n = Tokenizer.from_file(bpe.vocabulary_path()), 2 * bpe.TEXTS_AT_ONCE + 3
    texts = [None if i % 7 == 0 else f"Token number {i} é " * (i % 5) for i in range(n)]
    got = {r.doc_id: r.bpe for r in bpe.encode_texts(frame(spark, texts).coalesce(1), bpe.vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_language_on_held_out_documents(spark):
    truth = {d["doc_id"]: d["lang"] for d in brute.rows("documents")}
    found = language.op7_language_id(spark, brute.DATA).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (brute.bucket(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(spark):
    model = language.fit(spark.createDataFrame([("der die das und", "de"), ("the and of to", "en"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model.languages == ["de", "en"]
    found = {r.doc_id: r.language for r in language.identify(frame(spark, ODD), model).collect()}
    assert [found[i].lang for i in (0, 1, 2, 4, 8)] == ["und"] * 5 and found[0].score == 0
    assert found[6] == found[7] and language.identify(frame(spark, []), model).count() == 0
    none = language.fit(frame(spark, []))
    assert language.identify(frame(spark, ["text"]), none).first().language.lang == "und"


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 20, 60])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(c) for c in code}) == n and (n == 1 or (abs(code.sum(0)) < n).all())


def test_decontamination(spark):
    docs, items = brute.rows("documents"), brute.rows("benchmark")
    long_item = items[0]["text"]
    docs += [
        {"doc_id": 10_000 + i, "text": t}
        for i, t in enumerate([None, "", "one two", f"x {long_item} y {long_item}", long_item.upper(), "tiny item", "a tiny item b", "e e e e e e e e e e e e e"])
    ]
    items += [{"item_id": 900, "text": "Tiny item"}, {"item_id": 901, "text": None}, {"item_id": 902, "text": "e " * 12}, {"item_id": 903, "text": "e " * 12}]
    left = spark.createDataFrame([(d["doc_id"], d["text"], "x") for d in docs], "doc_id long, text string, term string").repartition(4)
    right = spark.createDataFrame([(i["item_id"], i["text"]) for i in items], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in postings.decontaminate(left, right).collect()}
    assert found == brute.leaks(docs, items)
    assert sum(1 for v in found.values() if v[1]) > 3
    none = postings.decontaminate(left.limit(5), right.limit(0)).collect()
    assert len(none) == 5 and not any(r.contaminated for r in none)


def test_proximity(spark):
    docs = frame(spark, ["alpha x x beta", "alpha x x x x beta", "beta alpha", "alpha"])
    lists = postings.index(docs, {b"alpha", b"beta"})
    asked = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "alpha")], "query_id int, term string")
    got = {(r.query_id, r.doc_id) for r in postings.proximity_matches(lists, asked, 3).collect()}
    assert got == {(1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)}
