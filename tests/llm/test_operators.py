"""Operators on small rows: nulls, empty and repeated rows, clashing names, and brute-force versions."""

import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import html, media, queries, secrets, tokens
from marlstone.llm.decontaminate import find_contamination
from marlstone.llm.minhash import near_duplicates
from marlstone.llm.mixing import mix_sources
from marlstone.llm.quality import select_quality, top_k
from marlstone.llm.secrets import redact_secrets, scan_secrets, spans_of
from marlstone.llm.warc import archive_pages, page_records

SCHEMA = "doc_id long, text string, source string, row_id long, n int"
ROWS = [(1, "a b c d e f g", "x", 5, 5), (1, "a b c d e f g", "x", 5, 5), (None, "a b c d e f g", None, None, None), (2, None, "x", 1, 1), (3, "", None, 1, 1), (4, "password = hunter2x", "y", 1, 1), (5, "w " * 70000, "y", 1, 1)]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates_of_odd_rows(docs, empty):
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(r[:4] for r in got if r[0] == 1) == [(1, 3, 1, True)] * 2
    assert [r for r in got if r[0] is None] == [(None, 3, 1, False, False)]
    assert sum(r[4] for r in got) == 5 and len(got) == 7
    assert near_duplicates(empty).count() == 0


def test_other_operators_of_odd_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, "c d e"), (None, "c d e"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1)], LABELS)
    for rows, n in ((docs, 7), (empty, 0)):
        assert find_contamination(rows, items).count() == n
        assert find_contamination(rows, items.limit(0)).filter("contaminated").count() == 0
        assert select_quality(rows, labels).count() == n
        assert select_quality(rows, labels.limit(0)).filter("selected").count() == n
        assert scan_secrets(rows).count() == n
        assert mix_sources(rows).count() == n
        assert media.sample_features(media.text_media(rows)).count() == n
    hit = {r.doc_id: r.items for r in find_contamination(docs, items).collect()}
    assert hit[1] == ["1", "null"] and hit[2] == []
    assert redact_secrets(docs).filter("doc_id = 4").first().text == "[assign removed]"


def test_pipeline_stages_of_odd_rows(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "z z z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, left in ((docs, (7, 5, 5, 5)), (empty, (0, 0, 0, 0))):
        for (_, stage), n in zip(corpus_pipeline.STAGES, left):
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == docs.columns and rows.count() == n
        mixed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        assert mixed.count() == n and mixed.filter("taken > 3 * size").count() == 0


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, None, "x" * 200), (3, "u\r\n", None), (4, "u", "short"), (5, "u", "short"), (None, "u", "y" * 100)], "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in page_records(archive_pages(pages)).collect()}
    sha = hashlib.sha256(b"x" * 200).hexdigest()
    assert got[1] == (200, sha, "response", None) and got[2] == (200, sha, "revisit", 1)
    assert got[3][0] == 0 and got[4][2] == got[5][2] == "response" and got[None][0] == 100
    assert page_records(archive_pages(pages.limit(0))).count() == 0
    assert [r.text for r in html.extract_text(pages.filter("page_id = 3")).collect()] == [""]


def test_small_split_reads_each_record_once(spark):
    pages = spark.createDataFrame([(i, "u", "".join(random.Random(i).choices("abcdef", k=3000))) for i in range(40)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in page_records(archive_pages(pages), split_bytes=700).collect()) == list(range(40))


def test_top_k_with_ties(spark):
    draws = [1.0] * 50 + [2.0] * 3 + [0.5] * 40 + [-1e9]
    rows = spark.createDataFrame(list(enumerate(draws)), "row_id long, draw double")
    for k in (0, 2, 3, 10, 53, 60, 94):
        for few in (1, 100):
            got = [r.row_id for r in top_k(rows, k, bins=4, few=few).filter("selected").collect()]
            assert sorted(got) == sorted(sorted(range(94), key=lambda i: (-draws[i], i))[:k])


def test_edited_counts_equal_whole_counts():
    own = tokens.encoding(queries.VOCABULARY, queries.PATTERN)
    count = lambda t: len(own.encode_ordinary(t))
    r = random.Random(5)
    for _ in range(60):
        text = "".join(r.choice(("word", " ", "  ", "\n", "'s", "12", " é", "!", " the", " a", "'", "．", "漢字", "\t", "'ll", "\u0301", "--", " '")) for _ in range(r.randint(0, 300)))
        tree = tokens.TokenTree(tokens.leaves_of(text, 40), count, 40)
        assert tree.tokens == count(text)
        for _ in range(6):
            a, b = sorted(r.randint(0, len(text)) for _ in range(2))
            b = min(b, a + 50)
            new = r.choice(("", " ", "x", " y z ", "'", "long one here"))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert "".join(tree.leaves) == text and (tree.chars[1], tree.tokens) == (len(text), count(text))


def test_media_are_found_by_their_structure():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    packed = gzip.compress(b"hello" * 100, mtime=0)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00" + b"\x3b"
    data = b"BM no picture " + png + b"RIFF" + packed + gif
    assert [(k, n) for k, _, n in media.sniff(data)] == [("image/png", len(png)), ("application/gzip", len(packed)), ("image/gif", len(gif))]
    wav = media.to_wav(b"ab" + png)
    assert [k for k, *_ in media.sniff(wav)] == ["audio/wav", "image/png"] and media.wav_data(wav) == b"ab" + png
    assert media.sniff(png[:-1]) == [] and media.sniff(None) == []


def test_lexer_follows_constants_and_stays_fast():
    text = 'db_pass = "Xy9$kLmn!2Qw"\nbase = "Zr7#pQvv81Lm"\nauth_token_value = base\ncolor = "red"\nname: "plain text here"\n'
    found = [(text[s:e], k) for s, e, k in spans_of(text)]
    assert ("Zr7#pQvv81Lm", "constant") in found and all("red" != t and "plain" not in t for t, _ in found)
    for long in ("a=" * 50000, "=" * 100000, 'a = "x"\n' + "a = a + a\n" * 5000):
        spans_of(long)


def test_blocks_are_labelled_as_held_out_pages():
    weights, trans = html.train()
    r, right, total = random.Random(1234), 0, 0
    for _ in range(100):
        page, labels = html.labelled_page(r)
        blocks = html.blocks_of(page)
        if len(blocks) == len(labels):
            got = html.decode(html.features_of(blocks), weights, tuple(map(tuple, trans)))
            right, total = right + int(np.sum(np.array(got) == labels)), total + len(labels)
    assert right >= 0.97 * total


def test_rest_of_a_literal_beside_a_base_span_is_found():
    for text in ('password = "correct!horse9battery"', "db_secret = \"0123456789abcdef01234567!Zq9+x\"", "api_token = 'Zq!9+0123456789abcdef01234567'", "password = 'ab!0123456789abcdef01234567!cd!Q9'"):
        spans = spans_of(text)
        literal = range(text.index(text[-1]) + 1, len(text) - 1)
        assert all(any(s <= i < e for s, e, _ in spans) for i in literal)
        base = secrets.base_spans(text)
        assert set(base) <= set(spans)
        assert all(a[1] <= b[0] or b[1] <= a[0] for a in set(spans) - set(base) for b in base)


def test_templates_spaces_and_long_joins_hide_no_secret():
    found = lambda t: [t[s:e] for s, e, _ in spans_of(t)]
    for secret in ("$2b$12$EixZaYVK1fsbw1ZfbX3OXe", "$uperS3cret!9", "<k9#Qz!7Lm>x", "%aB3$xY9!k", "{{Zx9!k#2q", "your_Xy9$kLmn!2"):
        assert found(f'db_pwd = "{secret}"') == [secret]
    assert found('passphrase = "correct horse battery staple"') == ["correct horse battery staple"]
    for template in ("$DB_PASSWORD", "${DB_PASSWORD}", "$(pass show db)", "<your password>", "%DB_PASSWORD%", "{{ vault.db_password }}", "your-password-here"):
        assert found(f'db_pwd = "{template}"') == []
    parts = [f"q{i}Z!k" for i in range(200)]
    text = 'part = "start"\n' + "".join(f'part = part + "{p}"\n' for p in parts) + "db_pwd = part\n"
    assert set(parts) <= set(found(text))
    assert len(found('a = "Xy9$kLmn!2Qw"\n' + "a = a + a\n" * 5000 + "db_pwd = a\n" * 5000)) == 1
