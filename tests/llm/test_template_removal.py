import re

import pytest

from negmine.llm import template_removal as tr


def text(page):
    return tr.block_text(tr.read_page(page)[1])


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><h1>T</h1><p><b>x<br><p>y &amp; z&#33;</article>", "T\nx\ny & z!"),
    ("<nav>menu</nav><main><p>one  two\n three</main><footer>f</footer>", "one two three"),
    ("<article><p>a</p><div class='ad'>buy</div><aside>s</aside><form>f<input></form><script>var t='</p>';</script><p>b</p></article>", "a\nb"),
    ("<article>a<section id=comments><article class=comment>bad</article></section></article>", "a"),
    ("<div class='cookie-notice'>ok?</div><div id='content'><p>long enough article text here</p></div><div class='sidebar'>x</div>", "long enough article text here"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<article><header><h1>T</h1></header><p>x&nbsp;y</p></article><header>site</header>", "T\nx y"),
    ("<body class='has-sidebar'><article class='post has-comments'>kept</article></body>", "kept"),
    ("<!-- <p>no</p> --><p>yes<!-- no", "yes"), ("<p>1 < 2 and <b>bold", "1 < 2 and bold"),
    ("<p title=\"a>b\">x</p><p title='>'>y</p>", "x\ny"), ("<p " + "a=\"b\" " * 3000, "<p " + " ".join(["a=\"b\""] * 3000)),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<p>" + "x" * 200_000, "x" * 200_000), ("<title>t</title><textarea><p>no</textarea>v", "v"),
])
def test_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<article><h2 id='side-effects'>Side effects</h2><p>a</p><h2 id='login'>Login</h2><p class='notice-period'>b</p></article>", "Side effects\na\nLogin\nb"),
    ("<article><section id='related-work'><h2>Related work</h2><p>a</p></section><section id=login><p>b</p></section></article>", "Related work\na\nb"),
    ("<div id=content><h2 id='hidden-costs'>Hidden costs</h2><div id='cookie-recipes'>a</div></div>", "Hidden costs\na"),
    ("<article><div class='skip-list-example'>a</div><div class='related-posts'>x</div><div class='commentList'>x</div><div id=comments>x</div></article>", "a"),
])
def test_names_made_of_headings_are_no_page_parts(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<body><form id=f action=x><div class='menu'>home news</div><div><h1>Title</h1><p>first words of the text</p><p>and the rest of it</p></div></form></body>",
     "Title\nfirst words of the text\nand the rest of it"),
    ("<form><input><main><p>kept</p></main></form>", "kept"),
    ("<div class='layout sidebar-right'><div class='content'><p>the article of this page</p></div><div class='sidebar'>side</div></div>", "the article of this page"),
    ("<main><p>a text that is long enough</p><form><p>your name</p><button>send</button></form></main>", "a text that is long enough"),
    ("<p>a text that is long enough to be most of it</p><form><label>search</label><input></form>", "a text that is long enough to be most of it"),
    ("<div class='sidebar'><div class='content'>x</div><p>much more beside it, which is no content at all</p></div><p>article</p>", "article"),
])
def test_articles_inside_forms_and_layouts(page, want):
    assert text(page) == want


def test_templates_meet_only_their_own_pages(spark):
    """Very many templates on one host: a page is compared with those of its own elements."""
    rows = [(i, "http://a.example/", "<article>" + "".join(f"<p>one two three four five word{(i * 7 + j) % 400}</p>" for j in range(40))
             + f"<h1>alone {i}</h1><p>this page says something of its own here {i * i}</p></article>", "x", 1) for i in range(120)]
    got = {r.page_id: r.text for r in tr.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"alone {i}\nthis page says something of its own here {i * i}" for i in range(120)}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, host STRING, text INT").repartition(3)


def test_templates_by_host(spark):
    rows = []
    for i in range(12):
        junk = "<div>Read more stories from our friends today</div>"
        body = f"<div>Story {i} begins here. " + " ".join(f"w{i}x{j}" for j in range(40)) + "</div>"
        rows.append((i, f"http://a.example/{i}", junk + body + junk, "h", 1))
        rows.append((100 + i, f"http://b{i}.example/", junk + body, "h", 1))
    copy = "<div>An article that has many copies " + "very " * 30 + "long</div><div>and a second part of some length</div>"
    rows += [(200 + i, f"http://c.example/{i}", copy, "h", 1) for i in range(12)]
    got = {r.page_id: r for r in tr.main_text(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text.startswith(f"Story {i} begins") and "friends" not in got[i].text  # recurs on the host
        assert "friends" in got[100 + i].text  # once per host
        assert got[200 + i].text.endswith("of some length")  # copies of one page are no template
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_links_inside_an_article(spark):
    box = "<div><a href='/x'>More from this author and others</a></div>"
    rows = [(i, f"http://a.example/{i}", f"<article><p>Text {i} " + f"{i} and " * 20 + f"</p>{box}<ul><li>fact one</li></ul></article>", None, None)
            for i in range(8)]
    for r in tr.main_text(pages(spark, rows)).collect():
        assert "author" not in r.text and r.text.endswith("fact one")


def test_any_element_that_recurs(spark):
    """A box longer than the article, a notice in text inside it, on few pages of a large host; quoted facts and near copies stay."""
    box = "<div>" + "our terms of use apply to all that you read here " * 8 + "</div>"
    note = "<p>Please support our work with a small gift today</p>"
    rows = []
    for i in range(100):
        own = f"<p>Short story {i} with {i * 7} words</p><p>and a second part {i}</p>"
        extra = "" if i >= 6 else note
        rows.append((i, f"http://a.example/{i}", f"<article>{own}{extra}<ul><li>fact one</li></ul></article>", None, None))
        rows.append((1000 + i, f"http://b.example/{i}", (box if i < 6 else "") + own, None, None))
    copy = "".join(f"<p>paragraph {j} of a text that has near copies</p>" for j in range(9))
    rows += [(2000 + i, f"http://c.example/{i}", f"<article>{copy}<p>seen {i} times</p></article>", None, None) for i in range(8)]
    got = {r.page_id: r.text for r in tr.main_text(pages(spark, rows)).collect()}
    for i in range(100):
        assert got[i] == f"Short story {i} with {i * 7} words\nand a second part {i}\nfact one"
        assert got[1000 + i] == f"Short story {i} with {i * 7} words\nand a second part {i}"
    assert all(got[2000 + i].count("near copies") == 9 for i in range(8))


def test_messy(spark):
    rows = [(1, None, None, None, None), (None, "http://x.example/", "", None, None), (2, "::bad url[", "<p>a</p>", None, None), (2, "::bad url[", "<p>a</p>", None, None)]
    got = tr.main_text(pages(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got.collect()) == [("1", "", 0), ("2", "a", 1), ("2", "a", 1), ("None", "", 0)]
    assert tr.main_text(pages(spark, rows).limit(0)).count() == 0


def test_table(spark, small):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in tr.main_text(spark.read.parquet(f"{small}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        plain = re.sub(r"</?(?:b|i|em|a|strong)\b[^>]*>", "", inner.replace("<br>", " "))
        blocks = [" ".join(tr.entities.unescape(x).split()) for x in re.split(r"<[^>]*>", plain)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_texts_are_staged_and_shuffled_packed(spark, monkeypatch):
    words = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper kapok larch maple nutmeg oak pine".split()
    stories = [" ".join(words[(i * 31 + j * j * 7 + i * j) % 16] + str((i + j) % 9) for j in range(400)) for i in range(60)]
    rows = [(i, "http://a.org/x", f"<body><div class=box><p>ask us now for one more of these offers</p></div><article><p>{x}</p><p>end \u00e9 {i}</p></article></body>")
            for i, x in enumerate(stories)]
    rows += [(90, "http://b.org/", None), (91, None, ""), (92, "http://b.org/", "<p>one</p>")]
    seen, stage = {}, tr.stage
    monkeypatch.setattr(tr, "stage", lambda df, name: seen.setdefault(name, stage(df, name)))
    found = tr.main_text(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING"))
    got = {r.page_id: r.text for r in found.collect()}
    assert got == {**{i: f"{x}\nend \u00e9 {i}" for i, x in enumerate(stories)}, 90: "", 91: "", 92: "one"}
    whole = sum(len(x) for x in stories)
    assert sum(len(r.packed) for r in seen["pages"].collect()) < whole / 2


def test_doubtful_pages_keep_their_own_subtrees(spark):
    box = "<div><p>call our desk on any day</p><p>we are glad to help you</p></div>"
    rows = [(i, "http://c.org/", f"<body><div id=content><div><p>story {i} {'w%d ' % i * 30}</p></div>{box}<div><p>last of {i} and some more words</p></div></div></body>")
            for i in range(12)]
    got = {r.page_id: r.text for r in tr.main_text(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    assert got == {i: f"story {i} {' '.join(['w%d' % i] * 30)}\nlast of {i} and some more words" for i in range(12)}
