"""Text, stemming, URL and HTML functions, rule by rule."""

from html import unescape

import duckdb
import pytest
from compare import rows_of_duckdb, rows_of_spark
from pyspark.sql import functions as F

from lexiforge.functions import html, stem, text, urls
from lexiforge.plans import registry

PAIRS = """caresses caress,ponies poni,ties ti,caress caress,cats cat,feed feed,agreed agre,plastered plaster,bled bled,motoring motor,
sing sing,conflated conflat,troubled troubl,sized size,hopping hop,tanned tan,falling fall,hissing hiss,fizzed fizz,failing fail,
filing file,happy happi,sky sky,relational relat,conditional condit,rational ration,valenci valenc,digitizer digit,
conformabli conform,radicalli radic,differentli differ,vileli vile,analogousli analog,vietnamization vietnam,predication predic,
operator oper,feudalism feudal,decisiveness decis,hopefulness hope,callousness callous,formaliti formal,sensitiviti sensit,
sensibiliti sensibl,triplicate triplic,formative form,formalize formal,electriciti electr,electrical electr,hopeful hope,
goodness good,revival reviv,allowance allow,inference infer,airliner airlin,adjustable adjust,defensible defens,irritant irrit,
replacement replac,adjustment adjust,dependent depend,adoption adopt,communism commun,activate activ,homologous homolog,
effective effect,bowdlerize bowdler,probate probat,rate rate,cease ceas,controll control,roll roll,maybe mayb,program program,
yes yes,yellow yellow,say say,the the,it it"""
WORDS = [tuple(p.split()) for p in PAIRS.replace("\n", "").split(",")]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_stems_in_spark_sql_and_python(spark):
    words, expected = [w for w, _ in WORDS], [s for _, s in WORDS]
    assert column(spark, words, stem.stem) == expected
    assert [stem.stem_word(w) for w in words] == expected
    c = duckdb.connect()
    c.sql("CREATE TABLE w AS SELECT unnest(?) AS word", params=[words])
    assert dict(c.sql(stem.sql_stems("w")).fetchall()) == dict(WORDS)


def test_stem_of_odd_words(spark):
    assert column(spark, [None, "", "a", "123", "AB", "Running"], stem.stem) == [None, None, None, None, "ab", "run"]


def test_tokens(spark):
    got = column(spark, ["C3PO don't x_y", "café naïve cafe", None, "  ", "The THE thing"], text.tokens)
    assert got == [["c", "po", "don", "t", "x", "y"], ["cafe"], [], [], ["the", "the", "thing"]]


def test_kept(spark):
    assert column(spark, ["The quick x fox and a dog"], text.kept) == [["quick", "fox", "dog"]]
    assert len(text.STOP_WORDS) == 129


def test_content_hash_drops_leading_zeros(spark):
    import hashlib

    values = [str(i) for i in range(300)]
    assert column(spark, values, text.content_hash) == [hashlib.sha256(v.encode()).hexdigest().lstrip("0") for v in values]


def test_publish_date(spark):
    assert column(spark, [0, None, 86_400_000], text.publish_date, "long") == ["1970-01-01", "", "1970-01-02"]


def plain_snippet(t, token):
    i = t.lower().find(token)
    if i < 0:
        return None
    start, end = max(0, i - 150), min(len(t), i + len(token) + 150)
    if start > 0:
        p = t.rfind(". ", 0, i + 2)
        start = p + 2 if p != -1 and p > i - 150 else start
    if end < len(t):
        q = t.find(".", i)
        end = min(q + 1, len(t)) if q != -1 and q < i + 150 else end
    return ("..." if start else "") + t[start:i] + "<strong>" + t[i : i + len(token)] + "</strong>" + t[i + len(token) : end] + ("..." if end < len(t) else "")


def test_snippets(spark):
    filler = "lorem ipsum dolor. " * 20
    cases = ["java first", filler + "Then JavaScript is here. " + filler, "x" * 400 + " java " + "y" * 400, "nothing", "a. java." + "z" * 300]
    f = lambda c: text.first_snippets(c, F.lower(c), F.array(F.lit("java")))
    got = [r[0].snippet if r else None for r in column(spark, cases, f)]
    assert got == [plain_snippet(c, "java") for c in cases]


def test_best_three(spark):
    values = [["a", "b"], ["aa", "b.", "cccc", "dd."], []]
    assert column(spark, values, text.best_three, "array<string>") == [["a", "b"], ["dd.", "b.", "cccc"], []]


def test_best_snippet(spark):
    values = [None, [], ["one"], ["no", "has java", "the <strong>java</strong>"]]
    got = column(spark, values, lambda c: text.best_snippet(c, F.lit("java")), "array<string>")
    assert got == [text.NO_PREVIEW, text.NO_PREVIEW, "one", "the <strong>java</strong>"]


def test_phrase_snippet(spark):
    df = spark.createDataFrame([(["s1 new york", "s2"], ["s2", "s1 new york"]), (["a", "b"], ["c"]), (["a"], [])], "x array<string>, y array<string>")
    got = [r[0] for r in df.select(text.phrase_snippet([F.col("x"), F.col("y")], ["new", "york"])).collect()]
    assert got == ["s1 new york", "a", text.NO_CONTENT]


def test_central_score(spark):
    assert column(spark, ["java", "xx", "<strong>java</strong>"], lambda c: text.central_score(c, F.lit("java"))) == [98, 0, 148]


def test_highlight(spark):
    got = column(spark, ["On on éon only ON."], lambda c: text.highlight(c, ["on"]))
    assert got == ["<strong>On</strong> <strong>on</strong> éon only <strong>ON</strong>."]


URLS = {
    "https://www.bbc.com": "https://www.bbc.com",
    "https://x.com/": "https://x.com/",
    "HTTP://WWW.A.com:80/x/./y/../z?q=1#f": "http://www.a.com/x/z?q=1",
    "http://a.com//b///c": "http://a.com/b/c",
    "http://a.com/../x": "http://a.com/../x",
    "http://a.com/x/..": "http://a.com/",
    "http://a.com/x/.": "http://a.com/x/",
    "http://a.com/a%20b/%2Fc": "http://a.com/a%20b/%2Fc",
    "http://u:p@a.com:8080/x": "http://a.com:8080/x",
    "http://a.com/x?": "http://a.com/x?",
    "http://a.com?x=1": "http://a.com?x=1",
    "ftp://a.com/x": "ftp://a.com/x",
    "https://a.com:443/": "https://a.com/",
    "": None,
    "# comment": None,
    "News sites": None,
    "javascript:void(0)": None,
    "mailto:a@b.c": None,
    "http://a_b.com/": None,
    "http://é.com/": None,
    "http://a b.com/": None,
}


@pytest.mark.parametrize("engine", ["spark", "duckdb"])
def test_normalize(spark, engine):
    given, expected = list(URLS), list(URLS.values())
    if engine == "spark":
        assert column(spark, given, urls.normalize) == expected
    else:
        c = duckdb.connect()
        c.sql("CREATE TABLE u AS SELECT unnest(?) AS url", params=[given])
        assert dict(c.sql(f"SELECT url, {urls.sql_normalize('url')} FROM u").fetchall()) == URLS


def test_domain_and_robots(spark):
    given = ["https://www.A.com/x", "b.org/y", "HTTP://c.com:81/p?q", None]
    assert column(spark, given, urls.domain) == ["a.com", "b.org", "c.com", None]
    assert column(spark, given, urls.robots_key) == ["https://www.A.com", None, "HTTP://c.com:81", None]
    assert column(spark, given, urls.robots_path) == ["/x", None, "/p", None]


def test_resolve(spark):
    links = ["/a", "b", "?q=1", "//h.com/x", "https://z.com", "", "../c", "mailto:x@y.z"]
    got = column(spark, links, lambda c: urls.resolve(F.lit("http://a.com/d/e?k=1"), c))
    assert got == ["http://a.com/a", "http://a.com/d/b", "http://a.com/d/e?q=1", "http://h.com/x", "https://z.com", "", "http://a.com/c", "mailto:x@y.z"]


PAGE = """<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><nav><ul><li>
<a href="/x">X</a></li><li><a class='k' href='y'>Y</a></li></ul></nav><h2>Second</h2><h1>First <b>one</b></h1><p>Te<b>x</b>t<br>more &lt;3</p></body></html>"""


def test_html(spark):
    assert column(spark, [PAGE], html.title) == ["A & B"]
    assert column(spark, [PAGE], html.headings) == [["First one", "Second"]]
    assert column(spark, [PAGE], html.body_text) == ["X Y Second First one Text more <3"]
    assert column(spark, [PAGE], html.hrefs) == [["/x", "y"]]
    assert column(spark, ["Text/HTML; charset=x", "image/png", None], html.is_html) == [True, False, False]
    assert column(spark, [None, ""], html.body_text) == [None, ""]


def test_character_references(spark):
    """Against the standard library, in text; in attributes only complete ones count."""
    texts = ["It&#8217;s caf&eacute;", "a&#160;b &euro;5", "&amp;lt; &lt", "&#x41;&#X42;&notin;&nosuch; &", "&copy2 &#99999999;", "1 &lt; 2 &amp; 3"]
    got = column(spark, texts, html.strip_tags)
    assert got == [" ".join(unescape(t).split()) for t in texts]
    page = '<title>caf&eacute;</title><h1>x &rarr; y</h1><a href="?a=1&copy=2&amp;b=&eacute;">z</a>'
    assert column(spark, [page], html.title) == ["café"] and column(spark, [page], html.headings) == [["x → y"]]
    assert column(spark, [page], html.hrefs) == [["?a=1&copy=2&b=é"]]


def test_tokens_of_batches_equal_the_expression(spark):
    texts = [None, "", "Café cafe x²y ½z don't", "The quick Brown-fox 3rd ﬁne", "naïve ok ok", "ÀB ab\u0301c"]
    assert column(spark, texts, text.kept) == [text.kept_tokens(t) for t in texts]


def test_joined_snippets(spark):
    values = [["a <strong>new</strong> b", "c new d", "x <strong>york</strong> y"], ["new york"], [], None]
    got = column(spark, values, lambda c: text.joined_snippets(c, ["new", "york"]), "array<string>")
    assert got == ["a <strong>new</strong> b ... | ... x <strong>york</strong> y", "new york", text.NO_PREVIEW, text.NO_PREVIEW]


@pytest.fixture
def cut_pages(spark, tmp_path):
    """A folder of pages whose references are cut short, and their rows in DuckDB by a query's SQL."""
    page = "<html><head><title>tin &lt;b&gt; the&amp</title></head><body><h1>one&&&amp</h1><h2>&#39 &amp;amp; &copy</h2><p>rest &nbsp stay &ampx; end &lt</p></body></html>"
    spark.createDataFrame([(1, "http://a.com/1", page), (2, "http://a.com/2", "<p>amp &amp; amp</p>")], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))

    def expected(name):
        with duckdb.connect() as c:
            c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
            return rows_of_duckdb(c, registry.oracle_sql()[name])

    return str(tmp_path), expected


def test_body_text_of_cut_references(spark, cut_pages):
    folder, expected = cut_pages
    assert rows_of_spark(registry.queries()["body_text"](spark, folder)) == expected("body_text")


def test_headers_of_cut_references(spark, cut_pages):
    folder, expected = cut_pages
    assert rows_of_spark(registry.queries()["headers"](spark, folder)) == expected("headers")


def test_page_title_of_cut_references(spark, cut_pages):
    folder, expected = cut_pages
    assert rows_of_spark(registry.queries()["page_title"](spark, folder)) == expected("page_title")


def test_weighted_postings_of_cut_references(spark, cut_pages):
    folder, expected = cut_pages
    assert rows_of_spark(registry.queries()["weighted_postings"](spark, folder)) == expected("weighted_postings")


def test_nested_postings_of_cut_references(spark, cut_pages):
    folder, expected = cut_pages
    assert rows_of_spark(registry.queries()["nested_postings"](spark, folder)) == expected("nested_postings")


@pytest.fixture
def odd_pages(spark, tmp_path):
    """A folder of pages without URL or id, and with letters beyond ASCII behind a tag's name, and rows in DuckDB."""
    page = lambda words, after="": f"<html><head><title>cat</title></head><body{after}><h1{after}>cow</h1><li{after}>cat<p>{words}</p{after}></body></html>"
    rows = [
        (1, "http://a.com/1", page("cat dog")), (2, None, page("cat bird")), (3, "http://a.com/3", page("dog fish", "日")),
        (4, None, page("hen <!-- cat", "ñ")), (None, "http://a.com/5", page("cat goat")), (None, None, None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))

    def expected(name):
        with duckdb.connect() as c:
            c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
            return rows_of_duckdb(c, registry.oracle_sql()[name])

    return str(tmp_path), expected


def test_nested_postings_without_url_or_id_and_with_odd_tags(spark, odd_pages):
    folder, expected = odd_pages
    columns, rows = rows_of_spark(registry.queries()["nested_postings"](spark, folder))
    assert (columns, rows) == expected("nested_postings")
    last = {r[columns.index("word")][1]: r[columns.index("last_url")][1] for r in rows}
    assert last["cat"] == "http://a.com/3" and last["bird"] == "" and "goat" not in last
