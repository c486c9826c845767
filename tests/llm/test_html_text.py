import re

from causalspark.llm.html_text import main_text, parse

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><nav><ul><li>Home<li>News</ul></nav>'
    '<header><h1>Site</h1></header><!-- x --><div class="ad">Buy</div><article><header><h1>Big &amp; <i>small</i></h1></header><p>One<br>two\n three<p><b>un</b>closed &eacute;&#33;'
    '<aside>aside</aside><form><p>Form</p></form><div class="comments"><p>First!</p></div><p>end</p></article><div class="cookie-notice">Cookies</div><footer>&copy; us</footer></body></html>'
)


def test_rules(spark):
    assert [t for r, t in parse(PAGE) if r == 3] == ["Big & small", "One two three", "unclosed é!", "end"]
    assert [t for r, t in parse("<main><h1>A title</h1><p>teaser</p><article><p>Text</p></article></main>") if r in (2.5, 3)] == ["A title", "Text"]
    assert parse(None) == [] and parse("<") == [(0, "<")] and parse("a < b") == [(0, "a < b")]


def test_repeated_runs_of_a_host_go_where_there_is_no_container(spark):
    line = "please read our terms of use and privacy policy today"
    rows = [(i, f"http://h.example/{i}", f"<p>{line}</p><p>t{i} own text and some {i * 7} words</p>") for i in range(30)]
    rows += [(100, "http://other.example/1", f"<p>{line}</p>"), (101, "http://a.example", PAGE), (101, "http://a.example", PAGE), (102, None, None), (103, "x", ""), (104, "http://h.example/0", "<p>w</p>" * 50000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == f"t{i} own text and some {i * 7} words" for i in range(30))
    assert by[100] == line and by[101].startswith("Big & small\n") and by[102] == by[103] == ""
    assert by[104].count("w") == 50000
    assert main_text(df.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1] for r in pages.collect()}
    for r in main_text(pages).collect():
        plain = [" ".join(t.split()) for t in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", want[r.page_id]).replace("<br>", " "))]
        import html

        assert r.text == "\n".join(html.unescape(t) for t in plain if t)


def test_repeated_runs_go_from_containers_too(spark):
    note = "all rights to these lines stay with the owner of this small site"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, f"http://h.example/{i}", f'<article><h1>The t{i}</h1><p>{own(i)}</p><div class="zone7"><p>{note}</p></div><p>end {i}</p></article><footer>x</footer>') for i in range(8)]
    rows.append((9, "http://other.example/9", rows[0][2]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for sent in (10**6, 0):  # tables sent to executors, and joins
        by = {r.page_id: r.text for r in main_text(df, sent).collect()}
        assert len(by) == 9 and all(by[i] == f"The t{i}\n{own(i)}\nend {i}" for i in range(8))
        assert by[9] == f"The t0\n{own(0)}\n{note}\nend 0"


def test_small_hosts_quotes_and_changed_articles(spark):
    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    html = lambda *parts: "".join(f"<p>{x}</p>" for x in parts)
    line, phrase, art = say("terms", 16), "as it was said so often before", say("art", 60).split()
    changed = [" ".join(w if k % 20 != 7 else f"new{i}" for k, w in enumerate(art)) for i in range(3)]
    rows = [(i, f"http://two.example/{i}", html(line, say(f"a{i}x", 20))) for i in range(2)]
    rows += [(10 + i, f"http://big.example/{i}", html(f"{say(f'b{i}x', 15)} {phrase if i < 5 else i} {say(f'c{i}x', 5)}")) for i in range(40)]
    rows += [(100 + i, f"http://copy.example/{i}", html(changed[i])) for i in range(3)]
    rows += [(110 + i, f"http://mid.example/{i}", html(changed[i] if i < 3 else say(f"m{i}x", 30), line)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for sent in (10**6, 0):
        by = {r.page_id: r.text for r in main_text(df, sent).collect()}
        assert [by[i] for i in range(2)] == [say(f"a{i}x", 20) for i in range(2)]
        assert all(by[10 + i] == f"{say(f'b{i}x', 15)} {phrase if i < 5 else i} {say(f'c{i}x', 5)}" for i in range(40))
        assert [by[100 + i] for i in range(3)] == changed
        assert all(by[110 + i] == (changed[i] if i < 3 else say(f"m{i}x", 30)) for i in range(9))


def test_a_title_beside_the_article_stays(spark):
    rows = [(1, "http://a.example/1", "<main><h1>A title</h1><p>teaser</p><article><p>Text</p></article></main>"), (2, "http://b.example/1", "<h1>Site</h1><main><h1>B</h1><p>more</p></main><p>x</p>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A title\nText", 2: "B\nmore"}


def test_titles_and_sentences_that_articles_share_stay(spark):
    title = "a long title of twelve words that eight of twenty pages bear"
    lead = "this sentence of the lead is the same in all of the twenty articles"
    own = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    rows = []
    for i in range(20):
        head = title if i < 8 else f"title {i}"
        rows.append((i, f"http://h.example/{i}", f"<article><h1>{head}</h1><p>{head}. {own(i, 9)} {lead}</p><p>{own(i + 100, 30)}</p></article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for sent in (10**6, 0):
        by = {r.page_id: r.text for r in main_text(df, sent).collect()}
        for i in range(20):
            head = title if i < 8 else f"title {i}"
            assert by[i] == f"{head}\n{head}. {own(i, 9)} {lead}\n{own(i + 100, 30)}"
