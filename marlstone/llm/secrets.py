"""Secret scans: fixed patterns, and an assignment-aware lexer of source and configuration syntax.

The lexer reads name-literal pairs: assignments and mappings (`name = "x"`, `name: x`, `"name": 'x'`, `name := x`,
`name => x`, `table["name"] = x`), calls (`set("name", "x")`), block scalars (`name: |` and the lines indented below it),
elements (`<name>x</name>`), attributes (`key="name" value="x"`) and passwords in addresses (`scheme://user:x@host`).
The right side may join literals and names by `+`, be a call of literals, a list or parentheses over lines, a choice between
literals (`"x" if a else "y"`, `a ? "x" : "y"`), or a literal in triple quotes. Names that hold literals are constants; a constant that reaches a sensitive name is reported at the place of its literal. A pair is
reported if the name is sensitive enough for what the literal looks like. Comments are read like code.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from itertools import chain, repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three base patterns of the contract, the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
KINDS = ("assign", "access", "hex", "named", "constant")

#: How much a word of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 0.9, "token": 0.8, "credential": 0.8, "credentials": 0.8,
    "apikey": 0.9, "auth": 0.5, "bearer": 0.7, "private": 0.5, "access": 0.3, "key": 0.4, "api": 0.4, "signing": 0.4, "encryption": 0.4, "session": 0.3, "salt": 0.4, "pin": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(?:true|false|none|null|nil|undefined|required|optional|string|str|int|example|changeme|redacted|x+|\*+|\.+|todo|your(?:[-_ ][a-z0-9]+)+|<[a-z][\w .:-]*>|\$(?:[a-z_]\w*|\{[a-z_][\w.]*\}|\([^()]*\))|%[a-z_]\w*%|\$?\{\{[-\s\w.$|]*\}\})$")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
TERM = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([^\s"'`,;(){}\[\]<>+=:]++=*+))""")
PLUS = re.compile(r"[ \t]*\+")
#: A call's literals, up to the first parenthesis or line end.
ARGUMENTS = re.compile(r"\(([^()\n]*+)\)")
COMMA = re.compile(r"[ \t]*,")
#: A name given as a call's argument, before the next one.
NAMED = re.compile(r"""\([ \t]*+(["'])([A-Za-z_][\w.-]*+)\1[ \t]*+,""")
#: What may stand before a value: an anchor or a tag of a mapping.
ANCHOR = re.compile(r"[ \t]+[&!][\w!./-]*+(?=[ \t])")
OPENS = re.compile(r"[ \t]*[\[(]")
GAP = re.compile(r"[\s,+]*+")
QUOTED = re.compile(r"""(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)""")
#: A choice after its first literal, and one after its condition.
ELSE = re.compile(r"[ \t]+if\b[^\n;\"'`]*?\belse[ \t]+")
CHOICE = re.compile(r"[^\n;\"'`?]*+\?[ \t]*")
OTHERWISE = re.compile(r"[ \t]*:[ \t]*")
ATTRIBUTES = re.compile(r"""\b(?:key|name|id)\s*=\s*(["'])([A-Za-z_][\w.:-]*+)\1\s+value\s*=\s*(?:"([^"<>]*+)"|'([^'<>]*+)')""")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)>([^<>]*+)</\1\s*>")
ADDRESS = re.compile(r"""://[^\s:/@"'<>]*+:([^\s@/"'<>]++)@""")
SCALAR = re.compile(r"[ \t]*[|>][-+0-9]*[ \t]*\r?\n")
LINE = re.compile(r"([ \t]*)([^\n]*)(?:\n|\Z)")
WORD_ONLY = re.compile(r"[A-Za-z_][A-Za-z_0-9.-]*")
BINDS = re.compile("[:=]")
NAMES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
THRESHOLD = 0.8
#: Names from this score on make a literal with spaces a passphrase.
STRONG = 0.9
SPANS = "array<struct<kind string, start int, `end` int>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in set(parts)))


class Joined:
    """A value joined from own literals (value, start, end) and constants, which are shared and not copied."""

    __slots__ = ("own", "constants", "length", "counts", "placeholder")

    def __init__(self, parts: list):
        self.own = [p for p in parts if not isinstance(p, Joined)]
        self.constants = list(dict.fromkeys(p for p in parts if isinstance(p, Joined)))
        self.length, self.counts = 0, Counter()
        for p in parts:
            shared = isinstance(p, Joined)
            self.length += p.length if shared else len(p[0])
            self.counts.update(p.counts if shared else p[0])
        # A placeholder as a whole, or, where constants come in, in every part: these are not put together.
        own = PLACEHOLDER.match("".join(p[0] for p in self.own)) is not None
        self.placeholder = (own or not self.own) and all(c.placeholder for c in self.constants)


def literal_score(joined: Joined, strong: bool) -> float:
    """0 for what is plainly no secret; more for long values of many kinds of characters in no order. strong: spaces tell nothing."""
    n, counts = joined.length, joined.counts
    if n < 6 or joined.placeholder:
        return 0.0
    entropy = -sum(x / n * math.log2(x / n) for x in counts.values() if x / n)
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    return min(1.0, 0.25 + 0.12 * entropy + 0.1 * (kinds - 1) - (0.5 if " " in counts and not strong else 0.0))


def called(text: str, begin: int, end: int) -> list:
    """The literals between commas, but for those that are names of secrets themselves."""
    terms, place = [], begin
    while place < end and (t := TERM.match(text, place, end)) is not None:
        k = t.lastindex
        if k < 4 and not (WORD_ONLY.fullmatch(t[k]) and name_score(t[k])):
            terms.append((t[k], None, t.start(k), t.end(k)))
        if (p := COMMA.match(text, t.end(), end)) is None:
            break
        place = p.end()
    return terms


def listed(text: str, place: int) -> tuple[list, int]:
    """The quoted literals from `place` on, whatever white space, line ends, commas and + part them, and where they end."""
    terms = []
    while (q := QUOTED.match(text, GAP.match(text, place).end())) is not None:
        k, place = q.lastindex, q.end()
        terms.append((q[k], None, q.start(k), q.end(k)))
    return terms, place


def choice(text: str, place: int, first: bool) -> list:
    """The literals of a choice: after its first literal (`if ... else`) or at its condition (`? :`)."""
    if first:
        m = ELSE.match(text, place)
        q = m and QUOTED.match(text, m.end())
        return [(q[k], None, q.start(k), q.end(k))] if q and (k := q.lastindex) else []
    terms = []
    m = CHOICE.match(text, place)
    while m is not None and (q := QUOTED.match(text, m.end())) is not None:
        k = q.lastindex
        terms.append((q[k], None, q.start(k), q.end(k)))
        m = OTHERWISE.match(text, q.end()) if len(terms) < 2 else None
    return terms


def terms_at(text: str, place: int) -> list:
    """(value or None, name or None, start, end) of what stands at `place`, joined by +."""
    if (m := ANCHOR.match(text, place)) is not None:
        place = m.end()
    if (m := OPENS.match(text, place)) is not None:
        return listed(text, m.end())[0]
    terms = []
    while True:
        bare = place
        while text[bare : bare + 1] in (" ", "\t"):
            bare += 1
        quote = text[bare : bare + 3]
        end = text.find(quote, bare + 3) if quote in ('"""', "'''") else -1
        if end >= 0:
            terms.append((text[bare + 3 : end], None, bare + 3, end))
            place = end + 3
        else:
            if (t := TERM.match(text, place)) is None:
                break
            if t[4] == "new" and (made := TERM.match(text, t.end())) is not None and made.lastindex == 4:
                t = made
            k, place = t.lastindex, t.end()
            inside = ARGUMENTS.match(text, place) if k == 4 else None
            if not terms and k < 4 and (more := choice(text, place, True)) or not terms and k == 4 and not inside and (more := choice(text, place, False)):
                return [(t[k], None, t.start(k), t.end(k)), *more] if k < 4 else more
            if inside:
                terms += called(text, inside.start(1), inside.end(1))
                place = inside.end()
            else:
                terms.append((t[k] if k < 4 else None, t[4], t.start(k), t.end(k)))
        if (p := PLUS.match(text, place)) is None:
            break
        place = p.end()
    return terms


def scalar_lines(text: str, name_at: int, place: int) -> list:
    """The lines below a name that are indented more than its own."""
    own = LINE.match(text, text.rfind("\n", 0, name_at) + 1)
    indent, terms = len(own[1]), []
    while place < len(text):
        line = LINE.match(text, place)
        if line[2].strip():
            if len(line[1]) <= indent:
                break
            terms.append((line[2].rstrip(), None, line.start(2), line.start(2) + len(line[2].rstrip())))
        place = line.end()
    return terms


def pairs(text: str):
    """Yields (name, terms) of assignments, mappings and block scalars."""
    at = 0
    while (m := BINDS.search(text, at)) is not None:
        at = m.end()
        stop = m.start()
        while stop and text[stop - 1] in " \t":
            stop -= 1
        if stop and text[stop - 1] == "]":
            stop -= 1
        if stop and text[stop - 1] in "\"'":
            stop -= 1
        start = stop
        while start and text[start - 1] in NAMES:
            start -= 1
        if text[at : at + 1] in (">", "="):  # => binds, == compares
            at += 1
            if text[at - 1] == "=":
                if m.group() == "=":
                    continue
        if start == stop or not (text[start].isalpha() or text[start] == "_"):
            continue
        name = text[start:stop]
        if m.group() == ":" and name_score(name) and (block := SCALAR.match(text, at)) is not None:
            if terms := scalar_lines(text, start, block.end()):
                yield name, terms
                at = terms[-1][3]
            continue
        if terms := terms_at(text, at):
            yield name, terms
            if terms[0][0] is not None:  # a quoted literal may hold : and =
                at = max(at, terms[-1][3])


def named_arguments(text: str):
    """Yields (name, terms) of calls that give a name and then its value."""
    for m in NAMED.finditer(text):
        if name_score(m[2]):
            t = TERM.match(text, m.end())
            k = t.lastindex if t else 0
            if k and not (WORD_ONLY.fullmatch(t[k]) and name_score(t[k])):
                yield m[2], [(t[k] if k < 4 else None, t[4], t.start(k), t.end(k))]


def marked_up(text: str):
    """Yields (name, terms) of elements and of attributes that name a value, and of passwords in addresses."""
    if "</" in text:
        for m in ELEMENT.finditer(text):
            if name_score(m[1]):
                yield m[1], [(m[2], None, m.start(2), m.end(2))]
    if "value" in text:
        for m in ATTRIBUTES.finditer(text):
            if name_score(m[2]):
                k = m.lastindex
                yield m[2], [(m[k], None, m.start(k), m.end(k))]
    if "://" in text:
        for m in ADDRESS.finditer(text):
            yield "password", [(m[1], None, m.start(1), m.end(1))]


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    constants: dict[str, Joined] = {}
    found, reported = [], set()
    bound = pairs(text) if "=" in text or ":" in text else ()
    given = named_arguments(text) if "," in text else ()
    for assigned, (name, terms) in chain(zip(repeat(True), bound), zip(repeat(False), given), zip(repeat(False), marked_up(text))):
        score, keep = name_score(name), assigned and (terms[0][0] is not None or terms[0][1] in constants)
        if not score and not keep:
            continue
        if not assigned and terms[0][0] is None and terms[0][1] not in constants:
            continue
        joined = Joined([constants[ref] if value is None and ref in constants else (ref if value is None else value, start, end) for value, ref, start, end in terms])
        if keep:
            constants[name] = joined
        if score and score * literal_score(joined, score >= STRONG) >= THRESHOLD * 0.5:
            found += [(s, e, "named") for _, s, e in joined.own if e > s]
            ahead = list(joined.constants)
            while ahead:
                one = ahead.pop()
                if one not in reported:
                    reported.add(one)
                    found += [(s, e, "constant") for _, s, e in one.own if e > s]
                    ahead += one.constants
    return found


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """All spans by start, then kind; of what the lexer finds, the parts that no base span covers are added."""
    if not text:
        return []
    base = base_spans(text)
    starts, ends = [], []  # of the stretches that base spans cover, apart from each other and in order
    for s, e, _ in sorted(base):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    added = set()
    for s, e, kind in lexed_spans(text):
        i = bisect.bisect_right(ends, s)
        while i < len(starts) and starts[i] < e:
            if s < starts[i]:
                added.add((s, starts[i], kind))
            s, i = ends[i], i + 1
        if s < e:
            added.add((s, e, kind))
    return sorted({*base, *added}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def secret_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t)], na_action=None)


def redacted(texts: pd.Series) -> pd.Series:
    def one(text):
        at, out = 0, []
        for s, e, k in spans_of(text):
            if e > at:
                out += [text[at:s] if s > at else "", f"[{k} removed]"]
                at = e
        return text if not at else "".join(out) + text[at:]

    return texts.map(one, na_action="ignore")


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Adds `into`, the spans (kind, start, end in code points, end exclusive) in order; none for a null or empty text.

    Spans that begin alike are ordered by kind as KINDS lists them, then by end. A column named `into` is replaced; rows,
    repeated ones too, and all other columns stay. A long text is read whole, in time proportional to its length. An
    empty table gives an empty result.
    """
    return docs.withColumn(into, F.pandas_udf(secret_spans, SPANS)(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span in the text by its kind; spans that overlap are replaced as one. Null stays null, clean and empty texts stay as they are, repeated rows are treated alike, all other columns stay."""
    return docs.withColumn(text, F.pandas_udf(redacted, "string")(F.col(text)))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
