"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its blocks of text in order, each with the tags and class words it lies in. The chain labels every
block main or other: weights of features and of label pairs are trained by gradient ascent on labelled pages, the
likelihood's gradient coming from forward and backward sums, and the best labelling is found by Viterbi's recursion.
The labelled pages are composed here, from many layouts and invented words; on half of them no tag or class tells the parts.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
#: From a tag's name to its end; a > within quotes does not end it.
TAG_END = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
ATTRIBUTE = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[a-z]+")
# Elements whose text is none of the page's, elements that are no block of their own, that have no end, that end an open one of their kind, and that end an open p.
SILENT = frozenset("script style noscript template svg iframe select button title".split())
SIMPLE = frozenset("button select title".split())
BEYOND = "address|article|aside|blockquote|body|dl|fieldset|figure|footer|form|h[1-6]|head|header|html|li|link|main|meta|nav|ol|p|pre|script|section|style|table|td|th|tr|ul"
ANY = re.compile(r"</?[A-Za-z]")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SAME = frozenset("p li dt dd tr td th option".split())
ENDS_P = SAME - {"p"} | frozenset("ul ol div table section article aside form footer".split())

#: A heading under which readers speak.
REACTIONS = re.compile(r"(?i)(?:\d+ (?:comments?|responses?|replies|reply|reactions?|thoughts on .*)|(?:reader |user )?comments(?: \(\d+\))?|leave a (?:reply|comment).*)[.:]?")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

PAGES, EPOCHS, RATE, DECAY = 800, 8, 0.2, 1e-4


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in order, kind text, open or close. Each character is passed a bounded number of times.

    A < that begins no tag is text, and so is the rest of a page in which no tag ends any more. A comment without end takes the
    rest. A silent element ends at its end tag; without one, or where it holds no other elements, at the next tag that
    cannot be in it; self-closed vector graphics hold nothing. Once a quote in a tag finds no end, quotes count for nothing in the tags that follow.
    """
    at, quotes, last = 0, True, {}
    while (lt := page.find("<", at)) >= 0:
        name = NAME.match(page, lt + 1)
        if name is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4) + 3
            elif page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt) + 1
            else:
                yield "text", page[at : lt + 1], ""
                at = lt + 1
                continue
            yield "text", page[at:lt], ""
            if end < 3:
                return
            at = end
            continue
        end = -1
        if quotes:
            m = TAG_END.match(page, name.end())
            quotes = m is not None
            end = m.end() if m else -1
        if end < 0 and (end := page.find(">", name.end()) + 1) <= 0:
            break
        yield "text", page[at:lt], ""
        tag, at = name[0].lower(), end
        if tag[0] == "/":
            yield "close", tag[1:], ""
            continue
        yield "open", tag, page[name.end() : end - 1]
        if tag in SILENT:
            if not (tag == "svg" and page[end - 2] == "/"):
                m = ending(tag).search(page, at) if last.get(tag, at) >= at else None
                if m is None:
                    last[tag] = -1
                    m = ANY.search(page, at)
                    if m is None:
                        return
                    at = m.start()
                else:
                    at = m.end() if m[0][:2] == "</" and m[0][2 : 2 + len(tag)].lower() == tag else m.start()
            yield "close", tag, ""
    yield "text", page[at:], ""


@functools.cache
def ending(tag: str) -> re.Pattern:
    """A silent element's end tag, or for those without elements in them what shows that it has none."""
    return re.compile(rf"(?i)</{tag}\s*+>" + (rf"|</?(?:{BEYOND})(?=[\s>/])|<{tag}(?=[\s>/])" if tag in SIMPLE else ""))


class Open:
    """The open elements, with counts of what is open by name and of their class words (of `known` ones if given)."""

    def __init__(self, known: frozenset | None):
        self.known, self.stack, self.blocks = known, [], []
        self.marked, self.reacting = [], 0
        self.names, self.tags, self.words = Counter(), Counter(), Counter()

    def count(self, counter: Counter, key: str, prefix: str, by: int) -> None:
        if self.known is None or prefix + key in self.known:
            counter[key] += by
            if not counter[key]:
                del counter[key]

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        self.stack.append((tag, words))
        self.marked.append(False)
        self._change(tag, words, 1)
        if tag not in INLINE:
            self.blocks.append(tag)

    def pop(self) -> str:
        tag, words = self.stack.pop()
        self.reacting -= self.marked.pop()
        self._change(tag, words, -1)
        if tag not in INLINE:
            self.blocks.pop()
        return tag

    def react(self) -> None:
        """What holds the block at hand holds what readers say."""
        at = len(self.stack) - 1
        while at >= 0 and self.stack[at][0] in INLINE:
            at -= 1
        if at > 0 and not self.marked[at - 1]:
            self.marked[at - 1] = True
            self.reacting += 1

    def _change(self, tag: str, words: tuple[str, ...], by: int) -> None:
        self.names[tag] += by
        if tag not in INLINE:
            self.count(self.tags, tag, "in:", by)
        for w in words:
            self.count(self.words, w, "class:", by)


def blocks_of(page: str | None, known: frozenset | None = None) -> list[tuple[str, str, tuple[str, ...], tuple[str, ...], float]]:
    """(text, innermost block, open tags, class words of these, share of the text in links). known: the features that matter, all if None."""
    out, text, linked, tree = [], [], 0, Open(known)

    def flush():
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            if len(whole) < 60 and tree.blocks and tree.blocks[-1] in HEADINGS and REACTIONS.fullmatch(whole):
                tree.react()
            words = (*tree.words, "*reactions") if tree.reacting else tuple(tree.words)
            out.append((whole, tree.blocks[-1] if tree.blocks else "", tuple(tree.tags), words, min(1.0, linked / len(whole))))
        text.clear()
        linked = 0

    for kind, what, attributes in pieces(page or ""):
        if kind == "text":
            if what:
                plain = entities.unescape(what)
                text.append(plain)
                if tree.names["a"] > 0:
                    linked += len(plain.strip())
            continue
        if what == "br":
            text.append(" ")
        if what not in INLINE:
            flush()
        if kind == "close":
            if tree.names[what] > 0:
                while tree.pop() != what:
                    pass
        elif what not in VOID and not attributes.endswith("/"):
            if what not in INLINE:
                while tree.stack and (tree.stack[-1][0] in INLINE or tree.stack[-1][0] == "p" and what in ENDS_P):
                    tree.pop()
                if tree.stack and tree.stack[-1][0] == what and what in SAME:
                    tree.pop()
            tree.push(what, tuple(w for a in ATTRIBUTE.findall(attributes) for w in WORDS.findall("".join(a).lower())))
    flush()
    return out


def shape(text: str, linked: float) -> str:
    """What a block looks like from the next one: its length, and whether it is of links."""
    return f"{min(6, len(text).bit_length() // 2)}{'l' if linked > 0.5 else ''}"


def features_of(blocks) -> list[list[str]]:
    out = []
    shapes = ["", *(shape(b[0], b[4]) for b in blocks), ""]
    for i, (text, tag, tags, words, linked) in enumerate(blocks):
        if "*reactions" in words:  # what they look like tells nothing of other blocks
            out.append(["reactions"])
            continue
        n, spaces, ends = len(text), text.count(" "), text[-1] in ".!?:;\"'»”…"
        f = ["bias", f"tag:{tag}", f"length:{min(6, n.bit_length() // 2)}", f"links:{int(linked * 4)}", f"stop:{ends}", f"words:{min(6, (spaces + 1).bit_length())}:{ends}"]
        f += [f"commas:{min(3, text.count(','))}", f"before:{shapes[i]}", f"after:{shapes[i + 2]}", f"sentences:{min(3, text.count('. '))}"]
        f += [f"in:{t}" for t in tags] + [f"class:{w}" for w in words]
        if "\xa9" in text or "copyright" in text.lower():
            f.append("copyright")
        out.append(f)
    return out


MAIN = ("article", "main", "div.content", "div.post-body", "div.entry", "section.story", "div.article-text", "div#main")
#: Places that say nothing: half of the labelled pages have their parts in these.
PLAIN = ("", "div", "td", "section", "div.x", "div#a", "div.col")
OTHER = (
    "nav", "nav.menu", "header", "footer", "aside", "aside.sidebar", "div.sidebar", "div.ad", "div.advert", "div.ads", "div.banner", "div.promo", "div.sponsored", "div.cookie-notice", "div.notice", "div.cookie", "div.consent", "div.popup", "div.comments", "section.comments",
    "div.comment", "section#comments", "ol.comment-list", "div.replies", "section.discussion", "div.responses", "div.feedback", "div.reader-reactions", "div.respond", "div.related", "div.share", "div.social", "div.newsletter", "div.breadcrumb", "ul.menu", "div.navbar", "form", "form.search", "div.footer", "div.header", "div.widget", "div.login", "div.subscribe", "div.disclaimer",
)
#: What readers add, often inside the main part.
COMMENTS = tuple(k for k in OTHER if re.search("comment|repl|discuss|respon|feedback|react", k))


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its blocks. On half of the pages no tag or class tells the parts, only what their text is like."""
    out, labels, plain = ["<html><head><title>x</title></head><body>"], [], r.random() < 0.5
    word = lambda: "".join(r.choice(("an", "er", "tion", "le", "de", "ch", "ou", "sta", "ri")) for _ in range(r.randint(1, 4)))

    def words(a, b):
        said = [word() for _ in range(r.randint(a, b))]
        return " ".join(w + r.choice(("", "", "", "", "", "", ",", ".")) if len(said) > 6 else w for w in said)

    def around(kind, inner):
        name = re.split("[.#]", kind)[0]
        extra = f' class="{kind.split(".")[1]}"' if "." in kind else f' id="{kind.split("#")[1]}"' if "#" in kind else ""
        out.append((f"<table><tr><{name}{extra}>" if name == "td" else f"<{name}{extra}>") if name else "")
        inner()
        out.append((f"</{name}></tr></table>" if name == "td" else f"</{name}>") if name else "")

    def block(tag, text, label):
        out.append(f"<{tag}>{text}</{tag}>")
        labels.append(label)

    def link():
        return f'<a href="/x">{words(1, 3)}</a>'

    def other(kinds):
        def inner():
            for _ in range(r.randint(1, 4)):
                style = r.random()
                if style < 0.35:
                    block("li", link(), 0)
                elif style < 0.8:
                    block(r.choice(("p", "div", "h3", "label")), words(2, 40) + r.choice((".", ".", "")), 0) if style < 0.6 else block("p", words(10, 60) + ".", 0)
                else:
                    block("div", f"&copy; {words(1, 4)}", 0)

        def untold():
            for _ in range(r.randint(2, 6)):
                style = r.random()
                if style < 0.6:
                    block(r.choice(("li", "div", "p", "td")), r.choice((link(), link() + " | " + link() + " | " + link())), 0)
                elif style < 0.85:
                    block(r.choice(("div", "p", "h4", "label")), words(1, 4), 0)
                else:
                    block(r.choice(("div", "p")), r.choice(("&copy; ", "Copyright ")) + words(1, 6), 0)

        around(r.choice(kinds), untold if kinds is PLAIN else inner)

    def reactions():
        """A part of its own, told by its heading alone."""
        out.append(opened := r.choice(("<div>", "<section>", "<ul>", "<div><div>")))
        n = r.randint(1, 40)
        block(r.choice(("h2", "h3", "h4")), r.choice((f"{n} comments", f"{n} responses", f"{n} replies", "Comments", f"Comments ({n})", f"{n} reactions", "Leave a reply")), 0)
        for _ in range(r.randint(1, 6)):
            block("li" if opened == "<ul>" else r.choice(("p", "div", "h5")), words(2, 60) + r.choice((".", "")), 0)
        out.append(re.sub("<", "</", opened))

    def table():
        out.append("<table>")
        for i in range(r.randint(1, 5)):
            out.append("<tr>")
            for _ in range(r.randint(2, 4)):
                block("th" if i == 0 and r.random() < 0.5 else "td", words(1, 4) if r.random() < 0.6 else str(r.randint(1, 3000)), 1)
            out.append("</tr>")
        out.append("</table>")

    def items():
        kind = r.choice(("ul", "ol"))
        out.append(f"<{kind}>")
        for _ in range(r.randint(2, 6)):
            block("li", r.choice((words(1, 6), words(1, 6), words(1, 3) + " " + link(), link())), 1)
        out.append(f"</{kind}>")

    def main():
        if r.random() < 0.8:
            block("h1", words(2, 10) + r.choice((".", "")), 1)
        for i in range(r.randint(1, 8)):
            style = r.random()
            if style < 0.7 or i == 0 and plain:
                block("p" if r.random() < 0.85 else "div", words(12, 80) + "." if plain else words(1, 4 if r.random() < 0.3 else 80) + r.choice((".", ".", "")), 1)
            elif style < 0.8:
                block(r.choice(("h2", "h3", "blockquote", "pre")), words(1, 12), 1)
            elif style < 0.85:
                block("li", words(3, 15), 1)
            elif not plain and style < 0.95:
                r.choice((table, items))()
            elif not plain:
                other([k for k in OTHER if k not in ("nav", "header", "footer")])
        if not plain and r.random() < 0.4:
            other(COMMENTS)

    for _ in range(r.randint(0, 4)):
        other(PLAIN if plain and r.random() < 0.7 else OTHER)
    place = r.choice(PLAIN if plain else MAIN)
    around(place, main) if r.random() < 0.7 else around("div", lambda: around(place, main))
    if r.random() < 0.12:
        reactions()
    for _ in range(r.randint(0, 4)):
        other(PLAIN if plain and r.random() < 0.7 else OTHER)
    return "".join(out) + "</body></html>", labels


def sums(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and expected label pairs."""
    n = len(scores)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = scores[0]
    for i in range(1, n):
        ahead[i] = scores[i] + np.logaddexp(ahead[i - 1, 0] + trans[0], ahead[i - 1, 1] + trans[1])
    for i in range(n - 2, -1, -1):
        step = scores[i + 1] + back[i + 1]
        back[i] = np.logaddexp(trans[:, 0] + step[0], trans[:, 1] + step[1])
    z = np.logaddexp(*ahead[-1])
    pairs = ahead[:-1, :, None] + trans + (scores[1:] + back[1:])[:, None, :] - z
    return np.exp(ahead + back - z), np.exp(pairs).sum(0)


@functools.lru_cache(4)
def train(pages: int = PAGES, seed: int = 11) -> tuple[dict[str, float], np.ndarray]:
    """Feature weights (main against other) and pair weights."""
    r = random.Random(seed)
    weights, trans = defaultdict(float), np.zeros((2, 2))
    data = []
    for _ in range(pages):
        page, labels = labelled_page(r)
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            data.append((features_of(blocks), np.array(labels)))
    for epoch in range(EPOCHS):
        r.shuffle(data)
        rate = RATE / (1 + epoch)
        for rows, y in data:
            one = np.array([sum(weights[f] for f in row) for row in rows])
            p, pairs = sums(np.stack([np.zeros(len(one)), one], 1), trans)
            for row, gap in zip(rows, (y - p[:, 1]) * rate):
                for f in row:
                    weights[f] += gap - DECAY * weights[f]
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            trans += 0.1 * rate * (seen - pairs)
    return {k: float(v) for k, v in weights.items()}, trans


def decode(rows: list[list[str]], weights: dict[str, float], trans) -> list[int]:
    """The labelling of greatest score."""
    (aa, ab), (ba, bb) = trans
    a = b = None
    came = []
    for row in rows:
        s = sum(weights.get(f, 0.0) for f in row)
        if a is None:
            a, b = 0.0, s
            continue
        came.append((b + ba > a + aa, b + bb > a + ab))
        a, b = max(a + aa, b + ba), s + max(a + ab, b + bb)
    out = [int(b > a)] if rows else []
    for step in reversed(came):
        out.append(int(step[out[-1]]))
    return out[::-1]


def extract_text(pages: DataFrame, *, html="html", into="text", model=None) -> DataFrame:
    """Adds `into`, the main blocks of the page joined by line ends; empty for null, empty or textless pages.

    Rows, repeated ones too, and all other columns stay; a column named `into` is replaced. An empty table gives an empty
    result. Time and memory grow in proportion to a page, however malformed. There are no ties: of equal labellings
    Viterbi's recursion prefers "other". model: as train() gives it.
    """
    weights, trans = model or train()
    known = frozenset(weights)
    trans = tuple(map(tuple, trans))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for page in batch:
                blocks = blocks_of(page, known)
                out.append("\n".join(b[0] for b, y in zip(blocks, decode(features_of(blocks), weights, trans)) if y))
            yield pd.Series(out, dtype=object)

    return pages.withColumn(into, F.pandas_udf(run, "string")(F.col(html)))
