"""Quality rules as weak supervision, in DataFrame functions only.

Every rule looks at a document's statistics and votes for quality, against it, or abstains. No rule is right always, and
nobody says how often each is: expectation maximisation finds, from votes alone, the share of good documents and for each
rule how often it is right about good and about bad ones. A document's probability of quality follows from its votes.
Documents of equal votes are alike, so the fit needs only the number of documents of each vote pattern, of which there
are at most 3 to the number of rules however many documents there are; it runs over them as one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import WORD, store

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
#: Everything but the signs of ASCII that are no letters.
LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
GRAM = 5
ROUNDS = 20
#: Each accuracy is as if this many more votes had been right and wrong.
RIGHT, WRONG = 4.0, 1.0
#: What the first round takes for how often a rule is right about good and about bad documents: a good one seldom has a defect, a bad one has only some of them.
START = (0.99, 0.3)


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """How many words of an array lie in windows of GRAM words that occur twice or more in it. Windows are compared by hash, and word by word where hashes meet."""

    def marked(hashes):
        # Sorted by hash, equal windows are neighbours.
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(rows):
            window = lambda row: F.slice(words, row["i"] + 1, GRAM)
            alike = lambda a, b: F.coalesce((a["h"] == b["h"]) & (window(a) == window(b)), F.lit(False))
            twice = lambda row, j: F.when(alike(row, F.get(rows, j - 1)) | alike(row, F.get(rows, j + 1)), row["i"])
            places = F.sort_array(F.filter(F.transform(rows, twice), lambda i: i.isNotNull()))
            begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(places, begin, lambda s, i: F.struct((i + GRAM).alias("end"), (s["n"] + GRAM - F.greatest(s["end"] - i, F.lit(0))).alias("n")), lambda s: s["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(order, of))

    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)])
    return F.when(F.size(words) < GRAM, F.lit(0).cast("long")).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), hashed), marked))


def text_statistics(text: Column) -> dict[str, Column]:
    """Counts of a text, all 0 for null: n_words, n_repeat_words, n_lettered (words with a letter), word_chars, n_symbols, n_lines (those with a word), n_dup_lines, n_letters, n_capitals, n_ends."""
    text = F.coalesce(text, F.lit(""))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"), F.size(F.filter(w, lambda x: F.regexp_like(x, F.lit(LETTER)))).cast("long").alias("lettered")))
    lines = let(F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD))), lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("again")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return {
        "words": words, "lines": lines, "word_chars": F.char_length(F.regexp_replace(text, SPACE, "")).cast("long"), "n_symbols": count(SYMBOL),
        "n_letters": count(LETTER), "n_capitals": count("[A-Z]"), "n_ends": count("[.!?]"),
    }


#: (rule, for quality, against it) over the statistics; neither is abstaining. All are products of integers, so no rounding decides.
RULES = (
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("repetition", "20 * n_repeat_words <= n_words", "20 * n_repeat_words > 3 * n_words"),
    ("lines", "n_lines > 1 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("letters", "20 * n_letters >= 17 * word_chars", "5 * n_letters < 4 * word_chars"),
    ("word_length", "word_chars BETWEEN 4 * n_words AND 13 * n_words / 2", "word_chars < 3 * n_words OR word_chars > 8 * n_words"),
    ("sentences", "n_ends BETWEEN n_words / 50 AND n_words / 4", "n_ends > n_words OR n_words >= 50 AND n_ends = 0"),
    ("lettered", "20 * n_lettered >= 17 * n_words", "5 * n_lettered < 4 * n_words"),
    ("capitals", "10 * n_capitals <= 3 * n_letters", "2 * n_capitals > n_letters"),
)


def votes(rules=RULES) -> Column:
    """An array of 1 (for), -1 (against) and 0, a place a rule."""
    return F.array(*[F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for _, good, bad in rules])


def label_model(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """From (votes, n), one row a pattern, in all at most 3 ** rules: one row of prior (the share of good documents), good and bad (arrays: how often each rule that votes is right about good and about bad documents) and posts (votes and p, the probability of quality)."""
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    good, bad = (F.array(*[F.lit(x)] * rules) for x in START)
    state = lambda prior, good, bad: F.struct(prior.alias("prior"), good.alias("good"), bad.alias("bad"))
    places = F.array(*map(F.lit, range(rules)))

    def chance(s, vote):
        # The log odds of quality: each vote adds the log of how much likelier it is about good documents.
        given = F.zip_with(vote, F.arrays_zip(s["good"].alias("good"), s["bad"].alias("bad")), lambda v, m: F.when(v == 1, F.ln(m["good"] / (1 - m["bad"]))).when(v == -1, F.ln((1 - m["good"]) / m["bad"])).otherwise(0.0))
        odds = F.aggregate(given, F.ln(s["prior"] / (1 - s["prior"])), lambda a, x: a + x)
        return 1 / (1 + F.exp(-odds))

    def fitted(posts):
        add = lambda weight: F.aggregate(posts, F.lit(0.0), lambda a, p: a + weight(p))
        mass = lambda p, way: p["n"] * (p["p"] if way == 1 else 1 - p["p"])

        def right(way):
            def of(j):
                hit = add(lambda p: F.when(F.get(p["votes"], j) == way, mass(p, way)).otherwise(0.0))
                return (RIGHT + hit) / (RIGHT + WRONG + add(lambda p: F.when(F.get(p["votes"], j) != 0, mass(p, way)).otherwise(0.0)))

            return F.transform(places, of)

        return state((1 + add(lambda p: mass(p, 1))) / (2 + add(lambda p: p["n"])), right(1), right(-1))

    scored = lambda s, array: F.transform(array, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), chance(s, p["votes"]).alias("p")))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(F.lit(0.5), good, bad), lambda s, _: let(scored(s, F.col("rows")), fitted))
    return rows.withColumn("model", model).select("model.prior", "model.good", "model.bad", scored(F.col("model"), F.col("rows")).alias("posts"))


def judge(voted: DataFrame, column: str, rules: int, into: str = "posterior", rounds: int = ROUNDS, fit: Column | None = None) -> DataFrame:
    """Adds `into`, the probability of quality, to rows whose `column` is an array of `rules` votes (1, -1, 0). Rows that vote alike get alike; rows without any vote get the share of good ones. `fit` tells which rows the model is fitted on, all by default; a column named `into` is replaced. A null array of votes joins nothing, so give none. An empty table gives an empty result. The table of patterns that is broadcast has at most 3 ** rules rows."""
    patterns = voted.groupBy(F.col(column).alias("votes")).agg((F.count("*") if fit is None else F.count_if(fit)).alias("n"))
    posts = label_model(patterns, rules, rounds).select(F.explode("posts").alias("post"))
    return voted.drop(into).select(F.struct("*").alias("row")).join(F.broadcast(posts), F.col(f"row.{column}") == F.col("post.votes")).select("row.*", F.col("post.p").alias(into))


def judge_quality(docs: DataFrame, *, key="doc_id", text="text", least=0.5, rounds=ROUNDS) -> DataFrame:
    """Per row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, votes.

    base_failed: under ten words, or over a fifth of them in repeated windows. kept: not base_failed, and the probability of
    quality, given the votes of RULES, is `least` or more. The model is fitted on all documents that do not fail the base: its
    two kinds of documents are to tell the good from the bad among those still to be judged. A null text has no words, like an empty one. Long texts are read whole. Repeated rows are documents of their own and
    equal texts are judged alike; ties cannot arise. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    counted = docs.select(F.col(key).alias("key"), *[c.alias(n) for n, c in text_statistics(F.col(text)).items()])
    flat = counted.select("key", F.col("words.n").alias("n_words"), F.col("words.repeated").alias("n_repeat_words"), F.col("words.lettered").alias("n_lettered"), F.col("lines.n").alias("n_lines"), F.col("lines.again").alias("n_dup_lines"), "word_chars", "n_symbols", "n_letters", "n_capitals", "n_ends")
    stored = store(flat.withColumn("votes", votes()), "rule-votes")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = judge(stored, "votes", len(RULES), rounds=rounds, fit=~failed).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("posterior") >= least)
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "posterior", "votes")
