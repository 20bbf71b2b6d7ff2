"""Infilling, quality rules and centroid clusters against brute-force versions and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import centroids, infill, rules

SCHEMA = "doc_id long, text string, made string, row string, key long, votes int, n int"
LONG = " ".join(f"word{i % 3001}" for i in range(60_000))
ROWS = [
    (1, "a b c d e f g", "x", "y", 5, 5, 5), (1, "a b c d e f g", "x", "y", 5, 5, 5), (None, "a b c d e f g", None, None, None, None, None), (2, None, "x", "y", 1, 1, 1), (3, "", None, None, 1, 1, 1),
    (4, "keep <P> as it is", "x", "y", 1, 1, 1), (5, LONG, "x", "y", 1, 1, 1), (6, "naïve \U0001f600\U0001f600 text\r\nline\n\nline", "x", "y", 1, 1, 1), (7, " \t\n ", "x", "y", 1, 1, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + [(100 + i, f"number {i} < of some" * 3, "x", "y", 1, 1, 1) for i in range(200)], SCHEMA)


# -- infilling


def cut_by_hand(key, text, ends):
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return "plain", None, None, text or ""
    a, b = sorted((ends[h[0] % len(ends)], ends[h[1] % len(ends)]))
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


UNITS = {"char": lambda t: list(range(len(t) + 1)), "word": lambda t: [0, *[m.end() for m in re.finditer(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", t)]], "line": lambda t: [0, *[m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+$", t)]]}


@pytest.mark.parametrize("unit", UNITS)
def test_infill_equals_cutting_by_hand(docs, unit):
    got = infill.infill(docs, unit=unit, keep_row=True).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count() and Counter(r.form for r in got).keys() == {"plain", "psm", "spm"}
    for r in got:
        text = r.row.text or ""
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == cut_by_hand(r.doc_id, text, UNITS[unit](text))
        assert r.n == len(text) and r.back == text and r.row.made == next((x[2] for x in ROWS if x[0] == r.doc_id), "x")


def test_infill_of_odd_rows(docs):
    plain = infill.infill(docs)
    assert plain.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    twice = [tuple(r) for r in plain.filter("doc_id = 1").collect()]
    assert len(twice) == 2 and len(set(twice)) == 1
    assert {r.form for r in plain.filter("doc_id IN (2, 3, 4)").collect()} == {"plain"}
    assert infill.infill(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.classes(np.zeros(1, np.uint32), "page")


# -- quality rules


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    places = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letter = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]")
    return {
        "n_words": len(words), "n_repeat_words": len(places), "n_lettered": sum(bool(letter.search(w)) for w in words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_letters": len(letter.findall(text)), "n_capitals": len(re.findall("[A-Z]", text)), "n_ends": len(re.findall("[.!?]", text)),
    }


def vote(s):
    out = []
    for _, good, bad in rules.RULES:
        ask = lambda e: eval(re.sub(r"(\w+) BETWEEN (.+?) AND ([^()]+)$", r"\2 <= \1 <= \3", e).replace(" AND ", " and ").replace(" OR ", " or ").replace(" = ", " == "), {}, s)  # noqa: E731, S307
        out.append(1 if ask(good) else -1 if ask(bad) else 0)
    return tuple(out)


def fitted(counts, m, rounds):
    good, bad, prior = [rules.START[0]] * m, [rules.START[1]] * m, 0.5

    def chance(v):
        odds = math.log(prior / (1 - prior)) + sum(math.log(good[j] / (1 - bad[j])) if x == 1 else math.log((1 - good[j]) / bad[j]) if x else 0.0 for j, x in enumerate(v))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        p = {v: chance(v) for v in counts}
        total = lambda j, side, ways: sum(n * (p[v] if side == 1 else 1 - p[v]) for v, n in counts.items() if v[j] in ways)
        good, bad, prior = (
            [(rules.RIGHT + total(j, 1, (1,))) / (rules.RIGHT + rules.WRONG + total(j, 1, (1, -1))) for j in range(m)], [(rules.RIGHT + total(j, -1, (-1,))) / (rules.RIGHT + rules.WRONG + total(j, -1, (1, -1))) for j in range(m)],
            (1 + sum(n * p[v] for v, n in counts.items())) / (2 + sum(counts.values())),
        )
    return {v: chance(v) for v in counts}


def made_texts():
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(500)]
    out = []
    for i in range(150):
        body = [r.choice(words) for _ in range(r.randint(8, 120))]
        lines = [" ".join(body[k : k + 9]).capitalize() + "." for k in range(0, len(body), 9)]
        if i % 10 == 0:
            lines = [" ".join(w + r.choice("#$%&") * 3 for w in line.split()) for line in lines]
        if i % 17 == 0:
            lines += lines[:3] * r.randint(1, 2)
        if i % 23 == 0:
            lines = [line.upper() for line in lines]
        out.append("\n".join(lines))
    return out


def test_rules_equal_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(made_texts())] + [(r[0], r[1]) for r in ROWS]
    got = rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for k, t in rows:
        s = statistics(t)
        want.append((k, s, vote(s), s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]))
    counts = Counter({v: 0 for _, _, v, _ in want})
    counts.update(v for _, _, v, failed in want if not failed)
    p = fitted(counts, len(rules.RULES), rules.ROUNDS)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    tell = lambda k, stats, votes, failed, chance, kept: (k is None, k or 0, *stats, votes, failed, round(chance, 9), kept)
    assert sorted(tell(r.doc_id, [r[n] for n in names], tuple(r.votes), r.base_failed, r.posterior, r.kept) for r in got) == sorted(tell(k, [s[n] for n in names], v, f, p[v], not f and p[v] >= 0.5) for k, s, v, f in want)
    assert {r.kept for r in got} == {True, False}


def test_windows_that_overlap_and_chain(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice("ab") for _ in range(n)) for n in (4, 5, 6, 9, 30, 200)] + ["x " * 40, "a b c d e a b c d e", "a b c d e f a b c d e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = rows.select("i", rules.text_statistics(F.col("text"))["words"].alias("w")).select("i", "w.repeated").collect()
    assert {r.i: r.repeated for r in got} == {i: statistics(t)["n_repeat_words"] for i, t in enumerate(texts)}


def test_rules_of_odd_rows(spark, docs):
    assert rules.judge_quality(docs.limit(0)).count() == 0
    got = {r.doc_id: r for r in rules.judge_quality(docs.filter("doc_id < 10 OR doc_id IS NULL")).collect()}
    assert got[2].n_words == got[3].n_words == got[7].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[5].n_words == 60_000 and got[5].n_repeat_words == 60_000 and None in got
    only = spark.createDataFrame([([1, -1, 0], 7, 2.0), ([1, 1, 0], 8, 3.0)], "v array<int>, post int, p double")
    judged = rules.judge(only, "v", 3, into="p").collect()
    assert len(judged) == 2 and all(0 < r.p < 1 for r in judged) and {r.post for r in judged} == {7, 8}


def test_the_fit_finds_which_rules_are_right(spark):
    r = np.random.default_rng(5)
    truth = r.random(4000) < 0.8
    right = ((0.95, 0.7), (0.9, 0.8), (0.99, 0.4), (0.8, 0.6))
    rows = []
    for t in truth.tolist():
        say = [(1 if t else -1) * (1 if r.random() < a[0 if t else 1] else -1) * int(r.random() < 0.9) for a in right]
        rows.append((say, int(t)))
    voted = spark.createDataFrame(rows, "v array<int>, truth int")
    patterns = voted.groupBy(F.col("v").alias("votes")).agg(F.count("*").alias("n"))
    model = rules.label_model(patterns, 4, rounds=60).first()
    assert model.prior == pytest.approx(0.8, abs=0.06)
    assert np.allclose(model.good, [a for a, _ in right], atol=0.05) and np.allclose(model.bad, [b for _, b in right], atol=0.15)
    judged = rules.judge(voted, "v", 4)
    assert judged.filter((F.col("posterior") > 0.5) == (F.col("truth") == 1)).count() > 0.88 * 4000


# -- centroids


def clusters_by_hand(rows, width, scale, k, rounds, seed=2):
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e15 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in named[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        mine = [[] for _ in centres]
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, d, j in found:
        per[j] += d
    small = lambda n: n if n < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, small(d), small(per[j]), small(sum(per.values())), sha[j]) for i, d, j in found]


KEYED = "vec_id long, embedding array<double>, key string, cluster int"


def odd_vectors(large=1.0):
    r = random.Random(6)
    rows = [(i, [round(r.gauss(i % 5, 0.4), 3) * large for _ in range(4)]) for i in range(300)]
    rows += [(3, rows[3][1]), (3, [9.0, 9.0, 9.0, 9.0]), (None, [0.5, 0.5, 0.5, 0.5]), (900, [-0.001, 0.0, -1.5, 2.25])] + [(500 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(80)]
    return rows + [(901, None), (902, []), (903, [1.0, 2.0, 3.0]), (904, [1.0, 2.0, 3.0, 4.0, 5.0]), (905, [1.0, None, 3.0, 4.0]), (906, [1.0, math.nan, 3.0, 4.0]), (907, [1.0, math.inf, 3.0, 4.0])]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("large", [1.0, 40_000.0, 1e7, 1e20])
def test_clusters_equal_integers_by_hand(spark, large):
    rows = odd_vectors(large) + ([(700 + i, [float(i), -1e18, 3e30, 0.25]) for i in range(3)] if large == 1.0 else [])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KEYED).repartition(5)
    got = centroids.centroid_clusters(df, width=4, clusters=7, rounds=3)
    assert in_order(got.collect()) == in_order(clusters_by_hand(rows, 4, 256, 7, 3))


def test_clusters_of_odd_tables(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in odd_vectors()], KEYED)
    run = lambda rows, **o: centroids.centroid_clusters(rows, width=4, **o).collect()
    assert run(df.limit(0)) == [] and run(df.filter("vec_id > 900")) == []
    few = run(df.filter("vec_id IN (1, 2, 900)"), clusters=40)
    assert len(few) == 3 and {r.distance for r in few} == {0} and len({r.cluster for r in few}) == 3
    same = run(df.filter("vec_id >= 500 AND vec_id < 600"), clusters=5)
    assert {r.cluster for r in same} == {0} and len(same) == 80  # all centroids are equal: the smaller number
    floats = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>")
    assert len(run(floats, clusters=7)) == 384


def test_distances_are_exact_at_the_bound():
    r = np.random.default_rng(1)
    for most in (2**21, 2**22, 2**23, 2**31 - 1):
        x = r.integers(-most, most + 1, (50, 64))
        model = centroids.Centroids(r.integers(-most, most + 1, (6, 64)).tolist())
        at, near = model.nearest(x)
        want = [min((sum((int(a) - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(model.exact.tolist())) for v in x]
        assert list(zip(near, at.tolist())) == want
