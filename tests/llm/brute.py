"""Plain Python versions of the corpus queries, for small tables."""

import hashlib
import re
import zlib

import pyarrow.dataset as ds

DATA = "/root/testdata/sf0.001"


def rows(name, where=DATA):
    return ds.dataset(f"{where}/{name}.parquet").to_table().to_pylist()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16])


def leak_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(docs, items):
    """doc_id -> (words, hit words, items)"""
    found, runs = {}, {}
    for item in items:
        w = leak_words(item["text"])
        for i in range(max(1, len(w) - 9) if w else 0):
            runs.setdefault(tuple(w[i : i + 10]), set()).add(str(item["item_id"]))
    sizes = {len(r) for r in runs}
    for doc in docs:
        w = leak_words(doc["text"])
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := runs.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= own
        found[doc["doc_id"]] = (len(w), len(hit), sorted(names))
    return found


def shingles(text):
    w = tuple(bytes((text or "").encode()).lower().split())
    return {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def repeats(docs, length=100):
    """doc_id -> (bytes, removed, spans, kept bytes), documents by id"""
    seen, found = set(), {}
    for doc in sorted(docs, key=lambda d: d["doc_id"]):
        data = (doc["text"] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if (w := data[i : i + length]) in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        runs = len(re.findall(b"\1+", bytes(gone)))
        found[doc["doc_id"]] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return found
