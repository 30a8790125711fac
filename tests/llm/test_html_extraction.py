import pytest

from tidegate.llm import html_extraction as H

PAGES = "page_id bigint, url string, html string, text string, host string, blocks string"


def run(spark, rows, **options):
    table = spark.createDataFrame([(k, u, h, "t", "h", "b") for k, (u, h) in enumerate(rows)], PAGES)
    return {r.page_id: r for r in H.extract(table, **options).collect()}


def page(k, body):
    return f"<html><body><div id=top>Welcome to our site</div>{body}<div class=foot2>All pages</div></body></html>"


def test_template_text_goes_without_article_elements(spark):
    rows = [("http://a.com/%d" % k, page(k, f"<div class=c><h1>Title {k}</h1><p>Body &amp; text {k}.</p><p>second {k}</p></div>")) for k in range(6)]
    got = run(spark, rows)
    for k in range(6):
        assert got[k].text == f"Title {k}\n\nBody & text {k}.\n\nsecond {k}"
        assert got[k].n_chars == len(got[k].text)


def test_copies_of_a_page_are_no_template(spark):
    same = page(0, "<div class=c><p>Only text</p></div>")
    got = run(spark, [("http://a.com/%d" % k, same) for k in range(8)])
    assert {r.text for r in got.values()} == {"Welcome to our site\n\nOnly text\n\nAll pages"}


def test_article_wins_over_other_slots(spark):
    body = ("<nav><a>menu {k}</a></nav><p>loose {k}</p><article><header><h1>T{k}</h1></header><p>a<b>b</b>\n c<br>d<p>e"
            "<aside>no</aside><div class='user-comments'><p>c{k}</p></div><form>f</form><script>var x='</p>';</script>"
            "<p>shared line</p></article><footer>f{k}</footer>")
    got = run(spark, [("http://a.com/%d" % k, page(k, body.format(k=k))) for k in range(5)])
    assert {k: r.text for k, r in got.items()} == {k: f"T{k}\n\nab c d\n\ne\n\nshared line" for k in range(5)}


def test_awkward_pages(spark):
    rows = [
        (None, None), ("x", ""), ("http://b.com/", "plain text only"), ("http://b.com/1", "<p>a<p>b</b></i><li>c"),
        ("http://c.com/", "<article><p>" + "word " * 100_000 + "</p></article>"), ("http://d.com", "<!-- <p>x</p> --><p>&lt;p&gt;&nbsp;&eacute;"),
        ("http://e.com", "<p>open <a href='x"), ("http://f.com", "<script>never closed <p>x</p>"), ("http://g.com", "a < b and c > d"),
        ("http://h.com", "<style>p{}</style><title>t</title><article></article>"),
    ]
    got = run(spark, rows)
    want = ["", "", "plain text only", "a\n\nb\n\nc", ("word " * 100_000).strip(), "<p> é", None, "", "a < b and c > d", ""]
    for k, text in enumerate(want):
        if text is not None:
            assert got[k].text == text, k
    assert run(spark, rows[:0] or [("u", None)])[0].n_chars == 0
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    table = spark.createDataFrame([(None, "http://a/", "<p>x", "", "", ""), (None, "http://a/", "<p>x", "", "", "")], PAGES)
    assert [(r.page_id, r.text) for r in H.extract(table).collect()] == [(None, "x")] * 2


def plain_template(pages):
    """Classes by whole occurrence vectors, held together for one host."""
    distinct = {tuple(sorted(p.tokens.items())): p for p in pages}
    kinds, vectors = {}, {}
    for p in distinct.values():
        kinds.update(p.kinds)
    for t in {t for p in distinct.values() for t in p.tokens}:
        vectors.setdefault(tuple(p.tokens.get(t, 0) for p in distinct.values()), []).append(t)
    main, texts = set(), set()
    n = len(distinct)
    for vector, tokens in vectors.items():
        support = sum(x > 0 for x in vector)
        ok = [t for t in tokens if support >= (min(2, n) if t in kinds else max(3, n * 0.5))]
        if sum(t in kinds for t in ok) >= 2:
            main |= {t for t in ok if kinds.get(t) == H.MAIN}
            texts |= {t for t in ok if t not in kinds}
    return main, texts


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_classes_against_whole_vectors(spark, n):
    sources = [page(k, f"<article><h1>x{k}</h1>" + "<p>p</p>" * (k % 3) + "<div><span>s</span>same</div></article>") for k in range(n)]
    table = spark.createDataFrame([(k, "http://a.com/", s, "", "", "") for k, s in enumerate(sources)], PAGES)
    found = H.templates(H.parsed_pages(table, "page_id", "url", "html")).collect()
    main, texts = plain_template([H.parse(s) for s in sources])
    assert sorted(found[0].main) == sorted(map(H._number, main))
    assert sorted(found[0].texts) == sorted(map(H._number, texts))


@pytest.mark.parametrize("body, want", [
    ('<body class="single no-sidebar"><article><p>t{k}</p></article></body>', "t{k}"),
    ('<body class="search-results"><p>t{k}</p></body>', "t{k}"),
    ('<body class="comments sidebar"><p>t{k}</p></body>', "t{k}"),
    ('<article class="post has-sidebar"><p>t{k}</p></article>', "t{k}"),
    ('<article class="comments-open"><p>t{k}</p></article>', "t{k}"),
    ('<article class="related promo"><p>t{k}</p></article>', "t{k}"),
    ('<main class="search"><p>t{k}</p></main>', "t{k}"),
    ('<div class="sidebar"><div class="widget"><article><p>t{k}</p></article></div></div>', "t{k}"),
    ('<main><div class="widget"><article><p>t{k}</p></article></div></main>', "t{k}"),
    ('<div class="widget"><p>t{k}</p></div><footer>f{k}</footer>', "t{k}"),
    ('<article><div id="related-work"><p>r{k}</p></div><p class="notice">t{k}</p></article>', "r{k}\n\nt{k}"),
    ('<article><p>a{k} <span class="ad">x{k}</span> b{k}</p></article>', "a{k}\n\nb{k}"),
    # one form around the page, an article in a dialog
    ('<form id="aspnetForm"><nav><p>n{k}</p></nav><main><article><p>t{k}</p><form><p>f{k}</p></form></article></main></form>', "t{k}"),
    ('<form><fieldset><p>t{k}</p></fieldset></form>', "t{k}"),
    ('<dialog open><article><p>t{k}</p></article></dialog><p>x{k}</p>', "t{k}"),
    # sides stay sides
    ('<article><p>t{k}</p><fieldset><p>f{k}</p></fieldset></article><form><p>g{k}</p></form>', "t{k}"),
    ('<p>t{k}</p><form><p>g{k}</p></form>', "t{k}"),
    ('<article><p>t{k}</p><div class="related-posts"><p>r{k}</p></div></article>', "t{k}"),
    ('<div class="no-sidebar"><article><p>t{k}</p></article><div id="comments"><article class="comment"><p>c{k}</p>'
     '</article></div></div><div class="widget-area"><p>w{k}</p></div>', "t{k}"),
    ('<main><p>t{k}</p><div class="comments"><article class="comment"><p>c{k}</p></article></div></main>', "t{k}"),
])
def test_class_words_do_not_hide_the_article(spark, body, want):
    got = run(spark, [("http://a.com/%d" % k, "<html>" + body.replace("{k}", str(k)) + "</html>") for k in range(4)])
    assert {k: r.text for k, r in got.items()} == {k: want.replace("{k}", str(k)) for k in range(4)}


def test_template_texts_of_any_length_go(spark):
    """Pages without an article: what stands on all pages of the host is template, short or long."""
    long = "all rights of this site " * 400
    got = run(spark, [("http://a.com/%d" % k, f"<div><div><p>own {k}</p></div></div><div><p>{long}</p></div>") for k in range(5)])
    assert {k: r.text for k, r in got.items()} == {k: f"own {k}" for k in range(5)}
