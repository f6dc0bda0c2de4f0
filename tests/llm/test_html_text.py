import pytest

from ledgerwalk.llm.html_text import MAX_PAD, extract_pages, page_text

CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>", " - x\n - y\n   3. z\n   4. w"),
    ("<table><tr><th>Name<th>V<tr><td>alpha<td>1<tr><td>b<td>22<br>3</table>", "Name  | V\nalpha | 1\nb     | 22\n      | 3"),
    ("<table>stray<tr><td>1</table>", "stray\n\n1"),
    ("<table><tr><td>o<table><tr><td>in<td>side</table></table>", "o\n\nin | side"),
    ("<head><title>t</title></head><script>var a='<p>'</script><style>p{}</style>shown<!-- c --><template>no</template>", "shown"),
    ("<title>t</title>x", "x"),
    ("<div hidden>no</div><p style='display: none'>no</p>yes", "yes"),
    ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<pre>  a\n    b</pre>", "  a\n    b"),
    ("&lt;b&gt; &amp; caf&eacute; &#x41;&copy", "<b> & café A©"),
    ("<b>x<p>y</b>z</p>", "x\n\nyz"),
    ("a < b and <unclosed", "a < b and"),
    ("<dl><dt>t<dd>d</dl><q>hi</q>", "t\nd\n\n“hi”"),
    ("<a title='x > y'>link</a>", "link"), ("</p></div></b>x", "x"),
    ("<tr>x", "x"), ("<tbody><p>x", "x"), ("</table><tr>x", "x"), ("<table><tr><td>a</table></table><tr><td>b<p>c", "a\n\nb\n\nc"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_rules(html, text):
    assert page_text(html) == text


def test_nothing_is_cut():
    word = "w" * 5000
    out = page_text(f"<table><tr><td>{word}<td>b<tr><td>a<td>c</table>")
    assert word in out and f"{'a'.ljust(MAX_PAD)} | c" in out
    deep = page_text("<div>" * 20_000 + "x" + "<table><tr><td>" * 500 + "y")
    assert "x" in deep and "y" in deep
    assert len(page_text("word " * 400_000).split()) == 400_000


def test_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, "u", "b"), (2 ** 60 + 1, None, None), (3, "u", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "a", 1), (1, "a", 1), (None, "b", 1), (2 ** 60 + 1, "", 0), (3, "", 0)], key=str)
    assert extract_pages(df.limit(0)).count() == 0


def test_all_words_of_given_pages_are_kept(spark):
    """Against another parser: the words of each generated page, in order."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    def letters(s):
        return "".join(c for c in s if not c.isspace() and c != "-")

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        w = Words()
        w.feed(r["html"])
        w.close()
        assert letters(page_text(r["html"])) == letters("".join(w.out))
