import random
import time

from readloom.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="comments-open">
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><div id='cookie-notice'><p>We use cookies</p></div>
<article class="post"><header><h1>Ti&amp;tle &lt;b&gt; &amp;amp;</h1></header><p><b>bo</b>ld  text<br>next
line<p>un<i>clos</i>ed&nbsp;x &#233;&#x e9; <aside>side</aside><form><input name=q>Send</form>
<section class="comments"><article>I disagree</article></section><ul><li>one<li>two</ul></article>
<footer>&copy; host</footer></body></html>"""


def test_structure():
    assert h.parse(PAGE) == ('Ti&tle <b> &amp; bold text next line unclosed x é&#x e9; one two', False)
    assert h.parse(None) == ("", True) and h.parse("") == ("", True) and h.parse("plain < text &amp") == ("plain < text &", True)
    assert h.parse("<main>a<script>x</main>") == ("a", False)
    assert h.parse("<div>a</span></div><p title='1 > 0'>b</p>") == ("a b", True)


def test_wrapped_articles_and_odd_classes():
    for html, want in (
        ("<form action=x><article>a b</article></form>", "a b"),
        ("<form><p>a b</p></form>", ""),
        ('<div class="main side-by-side"><article>a b</article></div>', "a b"),
        ('<article>a <p class="notice-of-award">b</p><div class="menu-review">c</div></article>', "a b c"),
        ('<article>a<div class="site-footer">b</div><div class="ad-slot top">c</div><div id="cookieBanner">d</div></article>', "a"),
        ('<div class="sidebar"><main>a b</main></div>', "a b"),
        ('<main>x</main><div class="related"><article>a b</article></div>', "x"),
        ('<aside><article>card</article></aside><article>x</article>', "x"),
        ('<div class="notice"><p>all the text there is</p></div>', "all the text there is"),
        ("<nav>a b c d</nav>", ""),
        ("<main>a<![CDATA[ <b> &amp; ]]>c</main>", "a <b> &amp; c"),
        ("<main>a</main><a href=x", "a"), ("a b <a href='x>c", "a b c"), ("<main>a<!-- b</main>", "a"),
        ("<p title='a>b'>c</p>", "c"), ('<p title="x>y</p><p>z</p>', "y z"),
        ("1 < 2 <3 and a<b", "1 < 2 <3 and a"),
    ):
        assert h.parse(html)[0] == want, html


def test_broken_pages_take_time_in_proportion():
    began = time.time()
    for piece in ("<a ", "<p>x</z>", '<a href="', "<!-", "<![CDATA[", "</p", "<script>x", "<p title='>", "<b \"'>", "<<", "&amp", "<div><p>", "</div>x"):
        h.parse(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 60


def test_marked_pages_against_brute_force():
    """Pages made of parts whose place is known: blocks in and out of the article, noise of all kinds, references, comments."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))
    words = lambda n: " ".join(word() for _ in range(n))
    noises = ["<nav><ul><li>{}</li></ul></nav>", "<footer><p>{}</footer>", "<aside>{}</aside>", '<div class="ad">{}</div>', "<!-- {} -->", "<script>var x = '<article>{}';</script>", '<div id="comments"><article>{}</article></div>', "<form><input><label>{}</label></form>", '<p hidden>{}</p>', '<section class="share-buttons"><span>{}</span></section>']
    for _ in range(200):
        blocks, html = [], []
        for _ in range(rng.randint(0, 8)):
            text = words(rng.randint(1, 12))
            shown = text.replace("a", "&#97;", 1) if rng.random() < 0.3 else text.replace(" ", "\n\t ", 1)
            if rng.random() < 0.3:
                html.append(rng.choice(noises).format(text))
                continue
            blocks.append(text)
            cut = rng.randrange(len(shown) + 1) if "&" not in shown else 0
            html.append(f"<p class=lead>{shown[:cut]}<em>{shown[cut:]}</em></p>" if rng.random() < 0.5 else f"<div><p>{shown}<br></div>")
        page = f"<html><head><title>{words(3)}</title></head><body>{rng.choice(noises).format(words(4))}<article>{''.join(html)}</article>{words(3)}{rng.choice(noises).format(words(4))}</body></html>"
        assert h.parse(page) == (" ".join(blocks), False), page


def brute(pages, length):
    out = {}
    for i, (url, html) in enumerate(pages):
        text, loose = h.parse(html)
        tokens = text.split(" ")
        if loose and text:
            covered = set()
            for a in range(len(tokens) - length + 1):
                run = tokens[a : a + length]
                n = {h.parse(p)[0] for u, p in pages if h.host_of(u) == h.host_of(url) and h.parse(p)[1] for t in [h.parse(p)[0].split(" ")] for b in range(len(t) - length + 1) if t[b : b + length] == run}
                if len(n) > 1:
                    covered.update(range(a, a + length))
            text = " ".join(t for k, t in enumerate(tokens) if k not in covered) or text
        out[i] = text
    return out


def test_loose_pages_against_brute_force(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(40)]
    bars = [" ".join(random.choices(words, k=14)) for _ in range(3)]
    pages = [(f"http://h{i % 3}.x/{i}", f"<div>{bars[i % 3]}</div><p>{' '.join(random.choices(words, k=random.randint(0, 40)))}</p><div>{random.choice(bars)}</div>") for i in range(24)]
    pages += [(None, PAGE), (None, None), ("http://h0.x/c", pages[0][1]), ("http://[bad", "<p>x</p>")]
    df = spark.createDataFrame([(i, u, p, 1) for i, (u, p) in enumerate(pages)], "page_id long, url string, html string, text int").repartition(3)
    found = {r.page_id: r.text for r in h.extract(df, min_tokens=8, gram_tokens=4).collect()}
    assert found == brute(pages, 8)
    assert h.extract(df.limit(0)).count() == 0


def test_runs_that_one_page_repeats_stay(spark):
    words = [f"v{i}" for i in range(60)]
    quote, bar = " ".join(words[:14]), " ".join(words[14:30])
    texts = [f"{bar} {quote} a b {quote} c", f"{bar} d e f"]
    df = spark.createDataFrame([(i, f"http://h.x/{i}", f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == {0: f"{quote} a b {quote} c", 1: "d e f"}


def test_articles_lose_what_most_of_their_host_hold(spark):
    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    notice, passage, base = words(15), words(20), words(60).split()
    page = lambda *blocks: f"<nav>{words(3)}</nav><article>{''.join(f'<p>{b}</p>' for b in blocks)}</article>"
    rows, want = [], []

    def add(host, html, text):
        want.append(text)
        rows.append((len(rows), f"http://{host}/{len(rows)}", html))

    for i in range(20):  # a notice in most articles of a host, a passage in a few, which another host has as well
        own, few = words(40), [passage] if i < 6 else []
        add("a", page(own, *few, *[notice] * (i < 15)), " ".join([own, *few]))
        add("b", page(own, *few, *[notice] * (i < 4)), " ".join([own, *few, *[notice] * (i < 4)]))
    for _ in range(9):  # copies and near copies of one article are most of a host
        text = " ".join(rng.choice([w, "x"]) if i % 30 == 0 else w for i, w in enumerate(base)) + " " + words(1)
        add("c", page(text), text)
    for _ in range(5):
        add("d", page(notice, own := words(20)), f"{notice} {own}")  # too few to tell
    for _ in range(9):
        add("e", page(*(copy := [notice, passage])), " ".join(copy))
    found = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [found[i] for i in range(len(rows))] == want


def test_the_host_search_finds_every_run_that_two_texts_share(spark):
    """Few articles of many hold it: the suffix sorting runs on them all the same, hot keys or not."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    texts = {f"k{i}": (i % 2, " ".join(rng.choices(words[: rng.choice([2, 12])], k=rng.randint(1, 60)))) for i in range(40)}
    passage = " ".join(rng.choices(words, k=20))
    texts |= {f"p{i}": (0, f"{i} {passage} {i} {passage} {i}") for i in range(2)} | {f"q{i}": (i, passage) for i in range(2)}
    length, want = 5, {}
    at_run = {(k, i): (h, tuple(t.split(" ")[i : i + length])) for k, (h, t) in texts.items() for i in range(len(t.split(" ")) - length + 1)}
    for run in set(at_run.values()):
        where = [at for at, r in at_run.items() if r == run]
        if (n := len({k for k, _ in where})) > 1:
            want |= dict.fromkeys(where, n)
    rows = [(t, k.encode(), h) for k, (h, t) in texts.items()]
    df = spark.createDataFrame(rows + rows[:9] + rows[-4:], "text string, text_key binary, host long").repartition(4)
    for hot in (50_000, 1):
        found = [(bytes(r.text_key).decode(), i, r.n) for r in h.held_runs(df, length, 3, hot).collect() for i in range(r["first"], r["last"] + 1)]
        assert len(found) == len(want) and {(k, i): n for k, i, n in found} == want


def test_the_query_searches_marked_pages(spark, tmp_path, monkeypatch):
    """Two articles that share a passage meet in the search, and by the host's rule keep it."""
    passage, found = " ".join(f"v{i}" for i in range(20)), []
    rows = [(i, f"http://h.x/{i}", f"<article>own{i} {passage}</article>") for i in range(2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    search = h.held_runs
    monkeypatch.setattr(h, "held_runs", lambda *a: found.append(search(*a)) or found[0])
    assert {r.page_id: r.text for r in h.html_query(spark, str(tmp_path)).collect()} == {i: f"own{i} {passage}" for i in range(2)}
    assert sorted((i, r.n) for r in found[0].collect() for i in range(r["first"], r["last"] + 1)) == [(i, 2) for i in range(1, 10) for _ in range(2)]


def test_no_shuffle_of_the_search_outlives_its_query(spark):
    """Else the shuffle of keys is on disk together with that of stretches."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    rows = [(i, f"http://h{i % 2}.x/{i}", f"<article>{t} {texts[i - i % 5]}</article>") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in str(files.getAllBlocks().mkString(" ")).split() if b.startswith("shuffle_")}
    spark.sparkContext._jvm.System.gc()
    df.count()
    before, setting = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    cleaned = spark.conf.get(setting, "false")
    found = h.extract(df)
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(setting, "false") == cleaned
    assert found.count() == len(rows)
