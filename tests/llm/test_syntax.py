"""Pages and source text written by hand, none of them from the generators that the operators are trained or were first tested on."""

import pytest

from marlstone.llm import html, secrets, warc

ROW = "The ferry to the northern islands leaves at seven in the morning, and it does not wait for those who come late."
NEXT = "Most of the islanders work in the harbour, where the boats are mended in winter and the nets are dried in summer."


def main_text(page):
    weights, trans = html.train()
    blocks = html.blocks_of(page, frozenset(weights))
    return [b[0] for b, y in zip(blocks, html.decode(html.features_of(blocks), weights, tuple(map(tuple, trans)))) if y]


@pytest.mark.parametrize(
    "odd",
    ["<svg class='i'/>", '<svg viewBox="0 0 1 1"><title>Arrow</title><path d="M0"/></svg>', "<button>Share", "<button class=x><div>Share</div></button>", "<select><option>One<option>Two</select>", "<script src='a.js'></script>", "<style>p{}</style >", "<title>Islands", "<iframe src=x></iframe>", "<noscript><img src=x></noscript>", "<template><p>no</p></template>"],
)
def test_silent_elements_take_nothing_along(odd):
    page = f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>The islands</h1>{odd}<p>{ROW}</p><p>{NEXT}</p></article></body></html>"
    assert main_text(page) == ["The islands", ROW, NEXT]


def test_unclosed_titles_and_scripts_lose_no_page():
    assert main_text(f"<html><head><title>T<body><article><p>{ROW}</p><p>{NEXT}</p></article>") == [ROW, NEXT]
    assert main_text(f"<article><p>{ROW}</p><script>var a = 1;<p>{NEXT}</p></article>")[0] == ROW
    assert main_text(f"<article><button>A<p>{ROW}</p><button>B</button><p>{NEXT}</p></article>") == [ROW, NEXT]


def test_tables_and_lists_of_an_article_stay():
    page = f"<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Prices</h1><p>{ROW}</p><table><tr><td>Year</td><td>2020</td></tr><tr><td>Fare</td><td>12</td></tr></table><ul><li>One</li><li><a href=/t>Two links</a></li></ul><p>{NEXT}</p></article><footer>&copy; 2020 The islands</footer></body>"
    assert main_text(page) == ["Prices", ROW, "Year", "2020", "Fare", "12", "One", "Two links", NEXT]


@pytest.mark.parametrize("said", ["<div><h3>3 responses</h3><p>I have been there and it was cold and wet.</p><p>So have I, many years ago, and I liked it a lot.</p></div>", "<section><h2>Comments (2)</h2><div>Never again, the food was bad and the boat late.</div></section>"])
def test_what_readers_say_is_no_article(said):
    page = f"<body><div><h1>The islands</h1><p>{ROW}</p><p>{NEXT}</p><p>{ROW}</p></div>{said}</body>"
    assert main_text(page) == ["The islands", ROW, NEXT, ROW]


def test_headings_within_an_article_stay():
    page = f"<article><h1>A study</h1><p>{ROW}</p><h2>Discussion</h2><p>{NEXT}</p><h2>Responses of the fish</h2><p>{ROW}</p></article>"
    assert main_text(page) == ["A study", ROW, "Discussion", NEXT, "Responses of the fish", ROW]


def found(text):
    return [text[s:e] for s, e, kind in secrets.spans_of(text) if kind in ("named", "constant")]


@pytest.mark.parametrize(
    "text",
    [
        'db_pwd = ["{}"]', 'pwd = (\n    "{}"\n)', 'private final String dbPwd = new String("{}");', "pwd = 'dev' if debug else \"{}\"", 'const pwd = debug ? "dev" : "{}";', '<add key="dbPwd" value="{}"/>', "<pwd>{}</pwd>", "pwd: &main {}",
        "url = postgres://app:{}@db.example.net/main", 'pwd = [\n  "{}",\n]', '<property name="db.pwd"\n          value="{}" />', "credentials: !str '{}'",
    ],
)
def test_literals_of_ordinary_syntax_are_found(text):
    value = "Xy9$kLmn!2Qw"
    whole = text.format(value)
    assert value in found(whole) or any(value == x or value in x for x in found(whole)), found(whole)


@pytest.mark.parametrize("text", ['db_pwd = "<a b' + " c" * n + '>"' for n in (5, 40, 400)] + ['pwd = "' + "x" * 500 + '"', 'a = "<your"\npwd = "<your" + " own>"', "see postgres://localhost/main", "<pwd></pwd>", "pwds = []", "pwd = (a + b)", "<key>short</key>", "time: 12:30 @home"])
def test_placeholders_of_any_length_are_none(text):
    assert found(text) == []


def test_long_joins_end(monkeypatch):
    lines = ['a0 = "Q7x$"'] + [f"a{i + 1} = a{i} + a{i}" for i in range(300)] + ["pwd = a300"]
    assert found("\n".join(lines)) == ["Q7x$"]
    assert found('pwd = [' + '"Ab1$Cd2!", ' * 2000 + ']') == ["Ab1$Cd2!"] * 2000


def test_keys_of_any_type_come_back(spark):
    rows = [("a/b c", "u", "x" * 200), ("ü<1>\r\n", "u", "x" * 200), ("", "u", "y"), ("null", "u", "z" * 150), (None, "u", "z" * 150)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_records(warc.archive_pages(pages), "string").collect()}
    assert got == {"a/b c": ("response", None, 200), "ü<1>\r\n": ("revisit", "a/b c", 200), "": ("response", None, 1), "null": ("response", None, 150), None: ("revisit", "null", 150)}
    dates = spark.createDataFrame([("2020-01-02", "u", "q")], "d string, url string, html string").selectExpr("CAST(d AS date) AS page_id", "url", "html")
    assert str(warc.page_records(warc.archive_pages(dates), "date").first().page_id) == "2020-01-02"
