"""Corpus queries that SQL cannot express against brute-force versions, and operators on odd rows and beyond old limits."""

import hashlib
import html as entities
import io
import math
import os
import random
import re
import time
import wave
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marlstone.llm import html, media, minhash, quality, queries, secrets, tokens
from marlstone.llm.decontaminate import find_contamination
from marlstone.llm.minhash import near_duplicates
from marlstone.llm.quality import select_quality
from marlstone.llm.warc import archive_pages, page_records

SF = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- op3


def edited(text, spans):
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind} removed]"]
            at = e
    return "".join(out) + text[at:]


@with_tables
def test_token_counts_of_the_query(spark):
    count = tokens.counter(queries.VOCABULARY, queries.PATTERN)
    texts = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    got = {r.doc_id: r for r in entry.queries()["op3_token_counts"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert (got[k].n_tokens, got[k].n_tokens_edited) == (count(t), count(edited(t, secrets.spans_of(t))))
        assert got[k].n_leaves == len(tokens.leaves_of(t))


EDIT = "array<struct<start int, `end` int, new string>>"


def test_stored_trees_follow_batches_of_edits(spark):
    count = tokens.counter(queries.VOCABULARY, queries.PATTERN)
    r = random.Random(9)
    texts = {1: "word one, two. " * 400, 2: "", 3: None, 4: "漢字，仮名。" * 300, 5: "x"}
    docs = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id long, text string, tokens int")
    trees = tokens.build_trees(docs, queries.VOCABULARY, queries.PATTERN)
    for _ in range(2):
        changes = {k: [{"start": a, "end": min(len(t or ""), a + r.randint(0, 9)), "new": r.choice(("", "new words", "字"))} for a in sorted(r.sample(range(len(t or "") + 1), min(3, len(t or "") + 1)))] for k, t in texts.items()}
        rows = spark.createDataFrame([(k, v) for k, v in changes.items()], f"doc_id long, edits {EDIT}")
        trees = tokens.edit_trees(trees.join(rows, "doc_id"), "edits", queries.VOCABULARY, queries.PATTERN)
        for k, edits in changes.items():
            t, out, at = texts[k] or "", [], 0
            for e in edits:
                if e["start"] >= at:
                    out += [t[at : e["start"]], e["new"]]
                    at = e["end"]
            texts[k] = "".join(out) + t[at:]
        got = {x.doc_id: x for x in trees.collect()}
        for k, t in texts.items():
            assert "".join(got[k].leaves) == t and got[k].n_tokens == sum(got[k].tokens) == count(t)
        assert 0 < got[1].n_reencoded <= 9 < len(got[1].leaves) + 5
    assert tokens.build_trees(docs.limit(0), queries.VOCABULARY, queries.PATTERN).count() == 0


def test_token_counts_of_odd_rows(spark):
    count = tokens.counter(queries.VOCABULARY, queries.PATTERN)
    rows = [(1, "a b", None, 5), (1, "a b", None, 5), (2, None, [(0, 1, "x")], 1), (3, "", [(0, 0, "x")], 1), (None, "hello there", [(0, 5, None), (3, 6, "no"), (90, 91, "no")], 1), (4, "word " * 30000, [(5, 9, "W")], 1)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {EDIT}, n_tokens int")
    got = [tuple(r) for r in tokens.count_tokens(docs, "edits", queries.VOCABULARY, queries.PATTERN).collect()]
    long = count("word " * 30000)
    assert sorted(x[:3] for x in got if x[0]) == [(1, 2, 2), (1, 2, 2), (2, 0, 0), (3, 0, 1), (4, long, count("word W" + " word" * 29998 + " "))]
    assert [x[1:3] for x in got if x[0] is None] == [(count("hello there"), count(" there"))]
    assert next(x for x in got if x[0] == 4)[4] <= 3
    assert tokens.count_tokens(docs.limit(0), "edits", queries.VOCABULARY, queries.PATTERN).count() == 0


# -- op4


@with_tables
def test_stored_media_of_the_query(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    for r in entry.queries()["op4_media"](spark, SF).collect():
        b = texts[r.doc_id].encode()
        payload = b.ljust(max(192, -(-len(b) // 192) * 192))
        with wave.open(buffer := io.BytesIO(), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        stored = buffer.getvalue()
        above = [x > sum(payload) / len(payload) for x in payload]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == f"audio/wav:{sum(payload) / len(payload):.6f}:{sum(a != b for a, b in zip(above, above[1:]))}:0"


def test_declared_types_are_corrected_and_media_carved(spark):
    import struct
    import zipfile
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        z.writestr("a.txt", "hello" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("b.txt", "there")
    packed = buffer.getvalue()
    pdf = b"%PDF-1.4\n1 0 obj<<>>endobj\nxref\n0 1\ntrailer<<>>\nstartxref\n9\n%%EOF\n"
    webp = b"RIFF" + struct.pack("<I", 18) + b"WEBPVP8L" + struct.pack("<I", 6) + b"\x2f\0\0\0\0\0"
    ogg = b"OggS\0\x02" + b"\0" * 20 + b"\x01\x05hello" + b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03end"
    flac = b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8rest"
    mp4 = struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + struct.pack(">I4s", 12, b"mdat") + b"data"
    found = {"image/png": png, "application/zip": packed, "application/pdf": pdf, "image/webp": webp, "audio/ogg": ogg, "audio/flac": flac, "video/mp4": mp4}
    rows = [(k, b, "text/plain", "kept") for k, b in found.items()] + [("none", b"plain", None, "x"), ("null", None, "image/gif", "x"), ("same", png, "image/png", "x"), ("same", png, "image/png", "x"), ("inside", b"text " + png + b" and " + packed + b" end", "text/plain", "x")]
    df = spark.createDataFrame(rows, "name string, media binary, declared string, sniffed string")
    got = {r.name: r.sniffed for r in media.sniff_media(df).collect()}
    for kind, b in found.items():
        assert (got[kind].type, got[kind].corrected, got[kind].length) == (kind, True, len(b)), kind
    assert (got["none"].type, got["null"].type, got["null"].length, got["same"].corrected) == (None, "image/gif", 0, False)
    assert [(e.type, bytes(e.bytes)) for e in got["inside"].embedded] == [("image/png", png), ("application/zip", packed)] and got["inside"].type == "text/plain"
    assert media.sniff_media(df.limit(0)).count() == 0
    for cut in (packed[:-1], pdf[:-8], webp[:-1], flac[:20], mp4[:-1], ogg[:-1]):
        assert media.sniff(cut) == []


@pytest.mark.parametrize("junk", [b"GIF89a!!!!!", b"GIF89a\0\0\0\0\0\0\0!\xf9\x04\0\0\0\0\0", b"\xff\xd8\xff\xe0\0\x10" + b"x" * 14, b"\xff\xd8\xff\xda\0\x02", b"%PDF-1.4 ", b"PK\x03\x04\0\0\x08" + b"\0" * 23, b"\0\0\0\x10ftypisom\0\0\0\0"])
def test_many_magics_take_linear_time(junk):
    began = time.time()
    media.sniff(junk * (3_000_000 // len(junk)))
    assert time.time() - began < 30


# -- op5


def test_lexer_finds_what_statements_hold():
    r = random.Random(12)
    names = ("db_password", "authToken", "API_SECRET", "user.passphrase", "apiKey")
    plain = ("color", "title", "user_name", "count", "path")
    value = lambda: "".join(r.choices("abcdefghijkmnpqrstuvwxyz", k=7)) + r.choice("!@#%&*") + "".join(r.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=7))
    shapes = ('{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', 'config["{n}"] = "{v}"', "cfg.set('{n}', '{v}')", '{n} := "{v}"', "'{n}' => '{v}'", '{n} = load("{v}")', '{n} = """{v}"""', "{n}: |\n  {v}\nend: 1", '# {n} = "{v}"', 'export {n}="{v}"')
    for _ in range(300):
        lines, want, text = [], [], ""
        for _ in range(r.randint(1, 6)):
            name, v = r.choice(names + plain), value()
            line = r.choice(shapes).format(n=name, v=v)
            if name in names:
                want.append((len(text) + line.index(v), v))
            text += line + "\n"
        covered = np.zeros(len(text) + 1, bool)
        for s, e, _ in secrets.spans_of(text):
            covered[s:e] = True
        for at, v in want:
            assert covered[at : at + len(v)].all(), (text, v)
        outside = np.ones(len(text) + 1, bool)
        for at, v in want:
            outside[max(0, at - 40) : at + len(v) + 2] = False  # a base span begins at its name
        assert not (covered & outside).any(), text


def test_secrets_of_odd_rows(spark):
    rows = [(1, 'db_pwd = "Xy9$kLmn!2Qw"', "t"), (1, 'db_pwd = "Xy9$kLmn!2Qw"', "t"), (2, None, "t"), (3, "", None), (None, "plain", "t"), (4, "a " * 60000 + 'db_pwd = "Xy9$kLmn!2Qw"', "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = [(r.doc_id, [(x.kind, x.start, x.end) for x in r.secrets]) for r in secrets.scan_secrets(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, [("named", 10, 22)]), (1, [("named", 10, 22)]), (2, []), (3, []), (None, []), (4, [("named", 120010, 120022)])], key=repr)
    redacted = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert redacted[1] == 'db_pwd = "[named removed]"' and redacted[2] is None and redacted[3] == "" and redacted[None] == "plain"
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


# -- op6


class Article(HTMLParser):
    """The blocks of <article> on the given pages, but for what is no running text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.inside, self.silent = [], "", 0, 0

    def flush(self):
        if " ".join(self.text.split()) and self.inside and not self.silent:
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag not in html.INLINE:
            self.flush()
        self.inside += tag == "article"
        self.silent += tag in ("script", "style", "aside", "nav", "form", "footer", "header") and self.inside > 0

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.flush()
        self.inside -= tag == "article"
        self.silent -= tag in ("script", "style", "aside", "nav", "form", "footer", "header") and self.inside > 0

    def handle_data(self, data):
        self.text += data


@with_tables
def test_main_text_of_the_query(spark):
    got = {r.page_id: r for r in entry.queries()["op6_html_text"](spark, SF).collect()}
    for r in table(spark, "pages").collect():
        page = Article()
        page.feed(r.html or "")
        page.close()
        assert got[r.page_id].text == "\n".join(page.blocks) and got[r.page_id].n_chars == len("\n".join(page.blocks)) and got[r.page_id].url == r.url


P1 = "The river had risen for three days, and on the fourth the lower meadows were under water. People moved what they could to the hill."
P2 = "Nobody had seen the like since the old mill burned down. The council met twice, decided little, and sent for sandbags from the coast."
P3 = "By Sunday the rain stopped. What remained was mud, a few broken fences, and a long argument about who should pay for the bridge."
HAND = {
    f"<html><body><div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></div><h1>High water in the valley</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p><div>Copyright 2021 Valley Post</div></body></html>": ["High water in the valley", P1, P2, P3],
    f"<table><tr><td><a href=/>Home</a></td><td><a href=/n>News</a></td></tr><tr><td><p>{P1}</p><p>{P2}</p></td></tr><tr><td>&copy; Valley Post</td></tr></table>": [P1, P2],
    f'<article><h1>High water</h1><p>{P1}</p><p>{P2}</p><section class="discussion"><p>Great article, I remember the flood of my youth very well.</p><p>Same here, thanks for writing it up so nicely.</p></section></article>': ["High water", P1, P2],
    f'<nav><ul><li><a href="/">Start</a></li></ul></nav><main><h2>Water</h2><p>{P1}<p>{P3}</main><aside><p>Read more about rivers and lakes in our big summer series.</p></aside>': ["Water", P1, P3],
    f'<div id="a1"><div><a href=/1>One</a></div><div><a href=/2>Two</a></div></div><div id="b7"><p>{P2}</p><p>{P3}</p><p>{P1}</p></div><div id="c3"><a href=/t>Terms</a> <a href=/p>Privacy</a></div>': [P2, P3, P1],
    f'<div class="cookie-banner"><p>We use cookies to make this site work better for you.</p><button>OK</button></div><div class="post"><p>{P1}</p><blockquote>{P2}</blockquote></div><div class="comments"><p>{P3}</p></div>': [P1, P2],
}


@pytest.mark.parametrize("page", HAND)
def test_main_text_of_pages_made_by_hand(page):
    weights, trans = html.train()
    blocks = html.blocks_of(page, frozenset(weights))
    got = [b[0] for b, y in zip(blocks, html.decode(html.features_of(blocks), weights, tuple(map(tuple, trans)))) if y]
    assert got == [entities.unescape(x) for x in HAND[page]]


@pytest.mark.parametrize("depth", [10, 60, 3000])
def test_end_tags_close_however_much_is_open(depth):
    page = f"<article><p>{P1}</p>" + "<div>" * depth + f"<p>{P2}</p></article><div class=menu><ul><li><a href=/x>Menu item</a></li></ul></div>"
    weights, trans = html.train()
    blocks = html.blocks_of(page, frozenset(weights))
    assert "article" not in blocks[-1][2]
    assert [y for y in html.decode(html.features_of(blocks), weights, tuple(map(tuple, trans)))] == [1, 1, 0]
    late = html.features_of(html.blocks_of(f"<p>{'word ' * 100} copyright of all parts</p>"))
    assert "copyright" in late[0]


@pytest.mark.parametrize("junk", ["<a ", "<!", "<", "<a href=\"", "<p '", "<div>", "<div>x", "<div class=c{}>x", "</a", "<!--", "&amp", "<script>", "<li>x", "x<br>"])
def test_malformed_pages_take_linear_time(junk):
    page = "".join(junk.format(i) for i in range(3_000_000 // len(junk)))
    began = time.time()
    html.blocks_of(page, frozenset(html.train()[0]))
    assert time.time() - began < 30


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", f"<article><p>{P1}</p></article>", 3), (1, "u", f"<article><p>{P1}</p></article>", 3), (2, None, None, 3), (3, "u", "", 3), (None, "u", "<br>", 3), (4, "u", "<article>" + f"<p>{P1}</p>" * 5000 + "</article>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract_text(pages)
    assert got.columns == pages.columns and html.extract_text(pages.limit(0)).count() == 0
    assert sorted(((r.page_id, r.text) for r in got.collect()), key=repr) == sorted([(1, P1), (1, P1), (2, ""), (3, ""), (None, ""), (4, "\n".join([P1] * 5000))], key=repr)


# -- op7


@with_tables
def test_quality_of_the_query(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = docs.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(quality.HELD_OUT)) == 0).collect()
    said = {r.doc_id: r for r in labels.collect() if r.quality is not None}
    good = {k for k, r in said.items() if r.quality == 1 and not r.toxic}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(quality.grams(r.text).tolist())
        if r.doc_id in good and not r.held:
            target.update(quality.grams(r.text).tolist())
    of = lambda counts, shapes: sum(n for g, n in counts.items() if (g >= quality.WORDS) == shapes)
    scale = [of(target, shapes) / of(raw, shapes) for shapes in (False, True)]
    ratio = {g: math.log((target[g] + 1) / (n * scale[g >= quality.WORDS] + 1)) for g, n in raw.items()}
    ratio = {g: x if abs(x) >= math.log(6) else 0.0 for g, x in ratio.items()}
    got = {r.doc_id: r for r in select_quality(docs, labels).collect()}
    for r in rows:
        assert math.isclose(got[r.doc_id].log_weight, sum(ratio[g] for g in quality.grams(r.text).tolist()), abs_tol=1e-6)
    held = [got[r.doc_id].log_weight for r in rows if r.doc_id in good and r.held]
    k = sum(x.log_weight >= np.quantile(held, 0.01) - 1e-9 for x in got.values())
    chosen = sorted(got.values(), key=lambda x: -x.draw)[:k]
    assert {x.doc_id for x in got.values() if x.selected} == {x.doc_id for x in chosen}


def test_grams_by_hand():
    """Words and pairs of words count once a text, runs of shapes as often as they occur."""
    words = lambda t: {g for g in quality.grams(t).tolist() if g < quality.WORDS}
    shapes = lambda t: sorted(g for g in quality.grams(t).tolist() if g >= quality.WORDS)
    assert len(words("a b c")) == 5 and words("a b c a b c a b") == words("a b c") | words("c a") and len(quality.grams("b b b b")) == 2 + 4 + 3 + 2
    assert shapes("Ab, cd!") == shapes("Xy, zzz!") != shapes("ab, cd!") and not len(quality.grams("")) and not len(quality.grams(None))


@with_tables
def test_quality_of_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = docs.filter(F.pmod(F.xxhash64("text"), F.lit(quality.HELD_OUT)) == 0).select("doc_id")
    found = select_quality(docs, labels).join(labels, "doc_id").join(held, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    passed = lambda rows: sum(r.selected for r in rows) / len(rows)
    assert passed([r for r in found if r.quality == 1 and not r.toxic]) > 0.97 and passed([r for r in found if r.quality == 0]) < 0.03
    # A third of the toxic labels are on texts without a toxic word: what can be learned is on the others.
    rude = re.compile(r"(?i)\b(loser|stupid|trash|disgusting|pathetic|worthless|idiot|moron|garbage)\b")
    assert passed([r for r in found if r.toxic and rude.search(r.text)]) < 0.1


@with_tables
def test_the_draw_decides_among_good_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    pick = lambda seed: {r.doc_id: r.log_weight for r in select_quality(docs, labels, share=0.3, seed=seed).filter("selected").collect()}
    a, b = pick(1), pick(2)
    weights = {r.doc_id: r.log_weight for r in select_quality(docs, labels).collect()}
    assert len(a) == len(b) == 300 and 60 < len(a.keys() & b.keys()) < 240
    assert min(a.values()) > -8 and np.mean(list(a.values())) > np.mean(list(weights.values()))


def test_the_draw_decides_among_equal_weights(spark):
    texts = ["plain words here"] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pick = lambda seed, share: {r.doc_id for r in select_quality(docs, none, share=share, seed=seed).filter("selected").collect()}
    a, b = pick(1, 0.5), pick(2, 0.5)
    assert len(a) == len(b) == 200 and a == pick(1, 0.5) and 60 < len(a & b) < 140
    assert len(pick(1, None)) == 400 and not pick(1, 0.0)
    # Inclusion follows the weights: exp(weight) to 1 is the odds of coming first.
    w = spark.createDataFrame([(i, 1.0 if i % 2 else 0.0) for i in range(4000)], "row_id long, w double")
    noise = -F.log(-F.log((F.pmod(F.xxhash64("row_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)))
    top = quality.top_k(w.withColumn("draw", F.col("w") + noise), 100, few=10).filter("selected")
    assert 55 <= top.filter("w = 1.0").count() <= 90


def test_quality_of_odd_rows(spark):
    rows = [(i, f"clean words of text {i} " * 5, "s") for i in range(30)] + [(100 + i, f"bad## bad{i}## " * 9, "s") for i in range(30)] + [(200, None, None), (201, "", "s"), (None, "clean words of a text", "s"), (1, "clean words of text 1 " * 5, "s"), (300, "clean words " * 50000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, draw string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(100 + i, 0, None) for i in range(15)] + [(None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = select_quality(docs, labels).collect()
    assert len(got) == len(rows)
    weight = {r.doc_id: r.log_weight for r in got}
    assert weight[200] == weight[201] == 0.0 and weight[0] >= 0 > weight[120] and sorted(r.draw for r in got if r.doc_id == 1)[0] == sorted(r.draw for r in got if r.doc_id == 1)[1]
    assert select_quality(docs.limit(0), labels).count() == 0


# -- op1, op2, op10


@pytest.mark.parametrize(("n", "width", "percent"), [(4, 5, 80), (5, 5, 80), (6, 3, 85), (7, 3, 85), (20, 3, 85), (100, 5, 80)])
def test_recall_of_bands_by_size(n, width, percent):
    """Of sets at the limit of similarity: no more pairs without a common bucket than README says."""
    where = minhash.probes(minhash.BANDS * minhash.ROWS)
    r = np.random.default_rng(n)
    missed, pairs = 0, 400
    drop = int(n - math.ceil(n * percent / 100))
    for _ in range(pairs):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.sort(r.choice(a, n - drop, replace=False))
        missed += not (set(minhash.sketch(a, minhash.BANDS, minhash.ROWS, where).tolist()) & set(minhash.sketch(b, minhash.BANDS, minhash.ROWS, where).tolist()))
    assert missed <= 1


def test_every_empty_bin_finds_a_filled_one():
    where = minhash.probes(192)
    assert all(sorted(where[:, i].tolist()) == list(range(192)) for i in (0, 77, 191))
    one = minhash.sketch(np.array([5], np.uint64), 32, 6, where)
    assert len(set(one.tolist())) == 32 and (one == minhash.sketch(np.array([5], np.uint64), 32, 6, where)).all()


@with_tables
@pytest.mark.parametrize(("block", "partners"), [(512, 1024), (2, 1)])
def test_links_do_not_depend_on_blocks(spark, monkeypatch, block, partners):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PARTNERS", partners)
    docs = table(spark, "documents")
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) for r in docs.collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    least = components_of(sets, 80)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, bands=64, rows=1).collect()}
    assert got == least


def components_of(sets, percent):
    least = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


@with_tables
def test_both_ways_of_finding_fingerprints_agree(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    few, all_shuffled = (find_contamination(docs, items, local_fingerprints=n).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect() for n in (10**6, 0))
    assert sorted(map(repr, few)) == sorted(map(repr, all_shuffled)) and any(r.n_hit for r in few)


def test_long_pages_and_clashing_names(spark):
    long = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400_000))
    pages = spark.createDataFrame([(1, "u", long, "x"), (2, "u", long, "x"), (3, "u", long[::-1], "x")], "page_id long, url string, html string, digest string")
    got = {r.page_id: tuple(r)[1:] for r in page_records(archive_pages(pages), split_bytes=50_000).collect()}
    assert got[2] == (400_000, hashlib.sha256(long.encode()).hexdigest(), "revisit", 1) and got[3][2] == "response"


# -- op9


def test_mix_of_odd_rows_equals_sql(spark):
    import duckdb

    from marlstone.llm.mixing import mix_sources

    rows = [(i, "w " * (i % 90), "abc"[i % 3]) for i in range(60)] + [(60, None, "a"), (61, "", "b"), (62, "x y z " * 40, None), (63, "long " * 70000, "c"), (64, "one", "only")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, rank string, size int")
    got = [tuple(r) for r in mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    digits = lambda found: sorted((a, b, c, round(d, 3), e) for a, b, c, d, e in found)
    assert digits(got) == digits(con.sql(queries.SQL["op9_mix_sources"]).fetchall())
    assert all(t <= 3 * n for _, n, _, _, t in got) and mix_sources(docs.limit(0)).count() == 0
    twice = mix_sources(docs.filter("doc_id < 10").unionByName(docs.filter("doc_id < 10"))).collect()
    assert len(twice) == 20 and all(r.taken <= 3 * r["size"] for r in twice)


# -- pipeline


@with_tables
def test_pipeline_equals_its_stages_by_brute_force(spark):
    import duckdb

    docs = table(spark, "documents")
    kept = {r.doc_id for r in select_quality(docs, table(spark, "labels")).filter("selected").collect()}  # see test_quality_of_the_query
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) for k, r in rows.items()}
    least = components_of({k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}, 80)
    rows = {k: r for k, r in rows.items() if least[k] == k}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [split(r.text) for r in table(spark, "benchmark").collect()]

    def contaminated(text):
        w, hit = split(text), set()
        for theirs in items:
            size = min(13, len(theirs))
            windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
            hit |= {j for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for j in range(i, i + size)}
        return bool(hit) and 20 * len(hit) >= len(w)

    left = [(k, edited(r.text, secrets.spans_of(r.text)) if r.text else r.text, r.source) for k, r in rows.items() if not contaminated(r.text)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", left)
    want = con.sql(queries.SQL["op9_mix_sources"]).fetchall()
    got = corpus_pipeline.run(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect()
    digits = lambda found: sorted((a, b, c, round(d, 3), e) for a, b, c, d, e in found)
    assert digits(map(tuple, got)) == digits(want)
