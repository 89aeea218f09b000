import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import html_text as h


def text(body):
    return h.parse(body).text()


def test_declared_content():
    assert text("<nav><a href=/>Menu</a></nav><article><h1>T &amp; U</h1><p>a\n <b>b</b>c<br>d&nbsp;e</p></article><footer>f</footer>") == "T & U a bc d e"
    assert text("<ARTICLE class='post'><p>one<p>two<script>var x='</p>';</script><style>p{}</style><!-- no --><div class=\"ad box\">buy</div>three</ARTICLE>") == "one two three"
    assert text("<main><header><h1>Head</h1></header><p>x</p><aside>y</aside><form>z<input></form><section id=comments><p>c</p></section></main>") == "Head x"
    assert text("<header>h</header><div role=main>in<span class='promo'>out</span> more</div>after") == "in more"
    assert text("<div class=top>t</div><div id=main-content><p>x</p><div class=sidebar>y</div></div><div class='footer'>z</div>") == "x"
    assert text("<div class=content>a</div><article>b</article>") == "b"
    assert text("<div class='page has-sidebar'><article class=no-comments><p>b</p><p class='cookie-notice'>c</p></article></div>") == "b"
    assert text("<article><p>cut &am</p><p>off &amp") == "cut &am off &"
    assert text("<article><p>cut in a tag</p><p cla") == "cut in a tag" and text("<article><p>cut in a quote</p><a href=\"/x") == "cut in a quote"
    assert text("<article><a title=\"a > b\" href=x>q</a> <a href=\"y>r</a> s</ >t</article>") == "q r st"
    assert text("<article>a < b &lt;i&gt; &#233;&#x1F642;</article>") == "a < b <i> é🙂"
    assert text("<article>story</article><article class='comment'>reader</article>") == "story"
    assert text("<article><div hidden>x</div><div style='display: none'>y</div><div role=navigation>z</div>w</article>") == "w"
    assert text("") is None and text(None) is None and text("<p>open</p>") is None
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"


def test_elements_without_an_end():
    assert text("<div class=search><input list=x><datalist id=x><option value=a><option value=b></datalist></div><article>story</article>") == "story"
    for tag in ("noscript", "object", "canvas", "svg", "select", "template", "video"):
        assert text(f"<div><{tag}>aside</div><article>story</article>") == "story", tag
    assert text("<article>a<select><option>x<option>y</select> b</article>") == "a b"
    assert text("<article>kept<script>var x = 1;</article>") == "kept"


def test_pages_of_a_megabyte_take_seconds():
    begin = time.perf_counter()
    for part in ("<div>x", "<p><a>x", "<b>x</i>", "<li>x", "</p>x", "<div class='a b'>x", "<b title=\"x>y"):
        body = "<article>" + part * (1_000_000 // len(part)) + "</article>"
        assert h.parse(body).text()
    assert time.perf_counter() - begin < 60


def test_open_blocks():
    page = h.parse("<body><ul><li><a href=x>Home</a></li><li>real <a>item</a></li></ul><p>para</p><footer>f</footer></body>")
    assert [x for _, x in page.open()] == ["real item", "para"] and page.outside() == ["Home", "real item", "para", "f"]


def brute(pages, run):
    found = {}
    for k, p in enumerate(pages):
        for at in range(len(p) - run + 1):
            found.setdefault(tuple(p[at : at + run]), set()).add(k)
    return {g: v for g, v in found.items()}


def test_suffix_array_intervals_equal_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        base = rng.choices("abc", k=30)
        pages = [base[rng.randrange(20) :][: rng.randint(0, 30)] + rng.choices("abcd", k=rng.randint(0, 30)) for _ in range(rng.randint(0, 6))]
        got = {tuple(pages[p][at : at + h.RUN]): set(on) for p, at, on in h.intervals(pages)}
        assert got == brute(pages, h.RUN)


def site(rng, host, pages, declared):
    words = [a + b for a in "bdfgl" for b in ("a", "en", "ir", "ost", "u")]
    top, low = ([rng.choice(words) + str(k) for k in range(15)] for _ in "ab")
    for k in range(pages):
        own = [rng.choice(words) + rng.choice(words) + str(rng.randrange(10**6)) for _ in range(rng.randint(3, 60))]
        body = f"<p>{' '.join(own)}</p>"
        body = f"<article>{body}</article>" if declared(k) else f"<div>{body}</div>"
        yield f"http://{host}/{k}", f"<html><body><div>{' '.join(top)}</div>{body}<div>{' '.join(low)}</div></body></html>", " ".join(own)


def test_repeated_runs_are_removed_from_pages_without_declared_content(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for host, n in (("a.org", 30), ("b.org", 9), ("c.org", 1)):
        for url, html, own in site(rng, host, n, lambda k: k % 3 == 0):
            want[len(rows)] = own
            rows.append((len(rows), url, html))
    alone = len(rows) - 1  # the only page of its host, and declared
    docs = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in h.extract(docs).collect()}
    assert got == want and alone in got


def test_shards_of_a_large_host_give_the_same(spark):
    rng = random.Random(3)
    rows = [(k, url, html) for k, (url, html, _) in enumerate(site(rng, "a.org", 40, lambda k: False))]
    # a run on two pages only, which may fall in different shards
    rows[3] = (3, rows[3][1], "<p>one two three four five six seven eight</p><p>own words here</p>")
    rows[4] = (4, rows[4][1], "<p>one two three four five six seven eight</p><p>other words</p>")
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    streams = h.parsed(docs.withColumn("host", h.host_of(docs.url)))
    sets = [{(r.host, r.head) for r in h.repeated_heads(streams, shard).collect()} for shard in (h.SHARD, 300, 50)]
    assert sets[0] == sets[1] == sets[2] and sets[0]
    got = {r.page_id: r.text for r in h.extract(docs).collect()}
    assert got[3] == "own words here" and got[4] == "other words"


def test_nulls_repeats_and_an_empty_table(spark):
    rows = [(1, None, None), (None, "http://a.org/", "<p>some words of mine</p>"), (None, "http://a.org/", "<p>some words of mine</p>"), (4, "", ""), (5, "no url", "<article>x</article>"), (6, "http://b.org", "<article>" + "long " * 50_000 + "</article>")]
    rows += [(7, "http://c.org", "<p>a b c d e f g h i j</p>")] * 2
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, len(r.text)) for r in h.extract(docs).collect()), key=str)
    assert got == sorted([(1, 0), (None, 18), (None, 18), (4, 0), (5, 1), (6, 249_999), (7, 19), (7, 19)], key=str)
    assert h.extract(docs.limit(0)).count() == 0


def test_undeclared_copies_of_an_article_are_kept(spark):
    rng = random.Random(4)
    rows = [(k, url, html) for k, (url, html, _) in enumerate(site(rng, "a.org", 40, lambda k: False))]
    want = {k: own for k, (_, _, own) in enumerate(site(random.Random(4), "a.org", 40, lambda k: False))}
    rows[7], want[7] = (7, rows[7][1], rows[3][2]), want[3]  # a copy of all, and one of the article with a word more
    rows[8], want[8] = (8, rows[8][1], rows[5][2].replace("</p>", " more</p>")), want[5] + " more"
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_stripped_of_article_tags_pages_give_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    stripped = pages.withColumn("html", F.regexp_replace("html", "</?article[^>]*>", ""))
    want = {r.page_id: r.text for r in h.extract(pages).collect()}
    scores = []
    for r in h.extract(stripped).collect():
        a, b = Counter(want[r.page_id].split()), Counter(r.text.split())
        scores.append(2 * (a & b).total() / max(1, a.total() + b.total()))
    assert sum(scores) / len(scores) >= 0.95 and sum(s >= 0.95 for s in scores) >= 0.95 * len(scores)


def test_repeated_notices_without_a_name_leave_declared_content(spark):
    rng = random.Random(5)
    notice = "write to the editors of this paper if you have seen the same"
    rows, want = [], {}
    for k in range(40):
        own = [" ".join(f"{rng.choice('bdfgl')}{rng.randrange(10**6)}" for _ in range(n)) for n in (20, 25, 12)]
        if k in (21, 22, 23):  # copies with another last word
            own = want[20].removesuffix(" end").split(" | ")
            own[2] += f" w{k}"
        rows.append((k, f"http://a.org/{k}", f"<nav>n</nav><article><h1>{notice}</h1><p>{own[0]}</p><div><p>{own[1]}</p></div><div class=x>{notice}</div><section>{own[2]} end</section></article>"))
        want[k] = " | ".join(own) + " end"
    whole = " ".join(h.parse(rows[20][2]).text().split())
    rows.append((40, "http://b.org/1", rows[0][2]))
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in (0, 1, 2, 30, 39):
        assert got[k] == f"{notice} {want[k].replace(' | ', ' ')}"
    assert got[20] == whole and got[21].count(notice) == 2 and got[40].count(notice) == 2  # copies, and the only page of a host
    assert all(want[20].split(" | ")[1] in got[k] for k in (20, 21, 22, 23))


def test_the_query_over_a_folder(spark, tmp_path):
    rows = [(1, "http://a.org/1", "<nav>m</nav><article>é 🙂 x</article>", "n"), (None, None, None, None), (2, "", "", ""), (2, "", "", ""), (3, "http://a.org", "<article>" + "long " * 300_000 + "</article>", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    found = h.op5_html_text(spark, str(tmp_path))
    assert found.columns == ["page_id", "url", "text", "n_chars"] and dict(found.dtypes)["n_chars"] == "bigint"
    got = sorted(((r.page_id, r.text[:5], r.n_chars) for r in found.collect()), key=str)
    assert got == sorted([(1, "é 🙂 x", 5), (None, "", 0), (2, "", 0), (2, "", 0), (3, "long ", 1_499_999)], key=str)
