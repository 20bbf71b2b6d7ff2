"""The queries on the smallest tables against brute-force versions."""

import hashlib
import os
import re
import zlib

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_near_duplicates(spark):
    sets = {}
    for r in rows(spark, "documents"):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(r.text))
        sets[r.doc_id] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    least = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and least[a] != least[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in entry.queries()["op1_minhash_dedup"](spark, SF).collect()}
    assert got == {k: (len(s), least[k], least[k] == k) for k, s in sets.items()}


def test_decontamination(spark):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [(str(r.item_id), split(r.text)) for r in rows(spark, "benchmark")]
    want = {}
    for r in rows(spark, "documents"):
        words, hit, ids = split(r.text), set(), set()
        for item, theirs in items:
            size = min(13, len(theirs))
            windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids.add(item)
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        want[r.doc_id] = (len(words), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(words))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in entry.queries()["op2_decontaminate"](spark, SF).collect()}
    assert got == want
    assert any(v[1] for v in want.values())


def test_secrets(spark):
    letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    assign = re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in entry.queries()["op5_secrets"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        text = r.text or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(base)]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(spans) <= set(r.spans.split(",")) or not spans


def test_archives(spark):
    pages = {r.page_id: (r.html or "").encode() for r in rows(spark, "pages")}
    first = {}
    for k in sorted(pages):
        if len(pages[k]) >= 100:
            first.setdefault(pages[k], k)
    want = {k: (len(v), hashlib.sha256(v).hexdigest(), "response" if (f := first.get(v, k)) == k else "revisit", None if f == k else f) for k, v in pages.items()}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in entry.queries()["op10_warc"](spark, SF).collect()}
    assert got == want


def test_media_digests(spark):
    want = {}
    for r in rows(spark, "documents"):
        b = (r.text or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        want[r.doc_id] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in entry.queries()["op4_media"](spark, SF).collect()}
    assert got == want
