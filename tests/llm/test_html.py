import html as lib
import re

import pytest

from lodestrand.llm import html, queries


def main(page):
    return [t for place, t in html.blocks(page) if place == html.MAIN]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>T &amp; U</h1><p>a <b>b</b><br>c&nbsp;d<p>e</article>", ["T & U", "a b c d", "e"]),
        ("<body><nav><p>menu</p></nav><main><p>x</p><aside>side</aside><p>y</p></main><footer>f</footer>", ["x", "y"]),
        ("<article><header><h1>t</h1></header><div class='comments'><p>first!</p></div><p>z</p></article>", ["t", "z"]),
        ("<header>site</header><div role=main><p>in</p><form><p>q</p></form></div>", ["in"]),
        ("<article><p>one <span class='ad'>buy</span>two</p><script>var x='</p>';</script><style>p{}</style><!-- <p>c</p> --></article>", ["one two"]),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><pre>x\n  y</pre></article>", ["a", "b", "1 2", "3", "x y"]),
        ("<article><p>cut &amp; off &am", ["cut & off &am"]),
        ("<article><p>cut <a href='x", ["cut"]),
        ("<article><p>2 < 3 and a<b</p></article>", ["2 < 3 and a"]),
        ("<article><p>a</p><!-- never closed <p>b</p></article>", ["a"]),
        ("<article><p>a</p><script>never closed <p>b</p></article>", ["a"]),
        ('<article><p title="a > b">q</p><p hidden>no</p><div style="display:none">no</div></article>', ["q"]),
        ("<article><p>&#x41;&#66;&lt;i&gt;&amp;lt;</p></article>", ["AB<i>&lt;"]),
        ("<article class='post ad-free category-legal'><p>r</p></article><article class='comment' id=c1><p>me too</p></article>", ["r"]),
        ("<article><div class='topic-search'><p>on search</p></div><ol class=comment-list><li>no</ol><div class=adsbygoogle>no</div></article>", ["on search"]),
        ("<div class=sidebar><article><p>teaser</p></article></div><article><p>real</p></article>", ["teaser", "real"]),
        ("<article><div class='cookie-notice'>ok?</div><section><p>s</p></section><div id=newsletterSignup>mail</div></article>", ["s"]),
    ],
)
def test_blocks_in_the_article(page, want):
    if "teaser" in want:
        assert main(page) == ["real"]  # an article inside a sidebar is none
    else:
        assert main(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>long<wbr>word a<br>b</p></article>", ["longword a b"]),
        ("<article><p>press <button>Save</button> and <math><mi>x</mi></math> is kept</p><button>Buy</button></article>", ["press Save and x is kept"]),
        ("<article><p><span class='ad'>buy</span>one <i class=promo>two</i> three</article>", ["one three"]),
        ("<article><div class='comment-list'>no</div><div class='site-footer'>no</div><div class='related-posts-2'>no</div><p>q</p></article>", ["q"]),
    ],
)
def test_more_blocks_in_the_article(page, want):
    assert main(page) == want


NAMES = ("<p class='share-price'>{}</p>", "<p class='legal-analysis'>{}</p>", "<section class='search-engines'>{}</section>", "<div id='menu-planning'>{}</div>", "<div class='discussion'>{}</div>")


def test_a_piece_of_a_name_makes_a_block_doubtful_and_repetition_decides(spark, monkeypatch):
    own = lambda i, k: " ".join(f"p{i}k{k}x{j}" for j in range(9))
    said = "press here to hear of our shares and of all our prices"
    page = lambda i: "<article><h1>t</h1>" + "".join(n.format(own(i, k)) for k, n in enumerate(NAMES)) + f"<div class='share-price-box'>{said}</div></article>"
    df = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(5)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {i: "\n\n".join(["t", *(own(i, k) for k in range(len(NAMES)))]) for i in range(5)}
    # the suffix array does that, not the name
    html_decides = html.extract(df.where("page_id = 0")).first().text
    assert html_decides.endswith(said)


def test_what_one_page_marks_is_known_on_another(spark):
    foot = "all rights kept by the makers of this fine site"
    rows = [(1, "http://h/1", f"<article><p>one</p></article><footer>{foot}</footer>"), (2, "http://h/2", f"<div>two</div><div>{foot}</div>"), (3, "http://g/2", f"<div>two</div><div>{foot}</div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one", 2: "two", 3: f"two\n\n{foot}"}


def brute_text(pages, run=8, least=2, main_least=3, share=0.5):
    """The text of each page of one host by the definition, all its pages at once."""
    found = [html.blocks(p) for p in pages]
    mask = {}
    for inside in (False, True):
        at = [(i, [k for k, (place, _) in enumerate(b) if (place == html.MAIN) == inside]) for i, b in enumerate(found)]
        at = [(i, ks) for i, ks in at if ks]
        need = max(main_least, -(-len(at) * share // 1)) if inside else least
        cover = brute_cover([[found[i][k][1].lower().split() for k in ks] for i, ks in at], run, need)
        mask |= {(i, k): m for (i, ks), ms in zip(at, cover) for k, m in zip(ks, ms)}
    out = []
    for i, b in enumerate(found):
        has = any(place in (html.MAIN, html.MAYBE_MAIN) for place, _ in b)
        wanted = (html.MAIN, html.MAYBE_MAIN) if has else (html.OPEN, html.MAYBE_OPEN)
        left = [" ".join(w for w, c in zip(t.split(), mask[i, k]) if not c) for k, (place, t) in enumerate(b) if place in wanted]
        out.append("\n\n".join(x for x in left if x))
    return out


def test_hosts_of_any_size_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for size in (1, 2, 30, 400, 900):
        shared = [some(rng.randrange(6, 16)) for _ in range(8)]
        pages = []
        for _ in range(size):
            body = [some(rng.randrange(3, 25))] + [x for x in shared[:5] if rng.random() < 0.1] + [shared[5]] * (rng.random() < 0.6) + [shared[6]]
            rng.shuffle(body)
            tags = [rng.choice(["<p>{}</p>", "<div class='share-price'>{}</div>", "<footer>{}</footer>", "<p>{}</p>"]).format(x) for x in body]
            pages.append(("<article>{}</article><nav>" + shared[7] + "</nav>" if rng.random() < 0.5 else "<body>{}</body>").format("".join(tags)))
        for i, (p, t) in enumerate(zip(pages, brute_text(pages))):
            rows.append((len(rows), f"http://h{size}/{i}", p))
            want[rows[-1][0]] = t
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for groups in (400, 60):
        got = {r.page_id: r.text for r in html.extract(df, group_pages=groups).collect()}
        assert got == want


def test_very_long_and_deep_pages_take_linear_time():
    assert main("<article>" + "<div>" * 50_000 + "x" + "</p>" * 50_000) == ["x"]
    assert main("<article><p>" + "<!--" * 50_000) == []
    assert main("<article><p>" + "<a " * 20_000) == []
    assert main("<article><p>y" + "<" * 50_000)[0].startswith("y")
    assert main("<article><p>" + "w " * 300_000 + "</p></article>") == [" ".join(["w"] * 300_000)]


def brute_cover(pages, run, need):
    seen = {}
    for i, p in enumerate(pages):
        flat = [w for b in p for w in b]
        for k in range(len(flat) - run + 1):
            seen.setdefault(tuple(flat[k : k + run]), set()).add(i)
    out = []
    for p in pages:
        flat = [w for b in p for w in b]
        hit = [False] * len(flat)
        for k in range(len(flat) - run + 1):
            if len(seen[tuple(flat[k : k + run])]) >= need:
                hit[k : k + run] = [True] * run
        rows, at = [], 0
        for b in p:
            rows.append(hit[at : at + len(b)])
            at += len(b)
        out.append(rows)
    return out


@pytest.mark.parametrize("run", [1, 3, 5, 8])
def test_covered_tokens_equal_brute_force(run):
    import random

    rng = random.Random(run)
    shared = [[rng.randrange(30) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
    pages = []
    for _ in range(25):
        pages.append([rng.choice(shared) if rng.random() < 0.4 else [rng.randrange(30) for _ in range(rng.randrange(0, 9))] for _ in range(rng.randrange(0, 6))])
    for share, need in ((0.0, 2), (0.2, 5)):
        got = [[list(map(bool, b)) for b in p] for p in html.covered(pages, run, share)]
        assert got == brute_cover(pages, run, need)


def test_pages_without_a_container_keep_unique_runs(spark):
    menu, foot = "home news sport weather travel money health science", "all rights kept by the makers of this fine site"
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"http://h.example/{i}", f"<body><div>{menu}</div><div>{text(i)}</div><div>{foot}</div><div>{text(i)[:3]} {foot} tail{i}</div></body>") for i in range(30)]
    for groups in (400, 9):
        got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages=groups).collect()}
        assert got == {i: f"{text(i)}\n\n{text(i)[:3]} tail{i}" for i in range(30)}


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, None, None, "t"), (2, "u", "", "t"), (3, "http://a/", "<article>x</article>", "t"), (3, "http://a/", "<article>x</article>", "t"), (None, "http://b/", "<p>only page of its host", "t")],
        "page_id long, url string, html string, text string",
    )
    got = sorted(((r.page_id, r.text) for r in html.extract(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "x"), (3, "x"), (None, "only page of its host")], key=str)
    assert html.extract(df.limit(0)).count() == 0


def test_query_against_the_pages_own_layout(spark, sf_dir, oracle):
    got = {r.page_id: r for r in queries.op2_html(spark, sf_dir).collect()}
    rows = oracle.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(got) == len(rows)
    for i, url, page in rows:
        m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", m.group(1)) if m else []
        parts = [" ".join(lib.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        want = "\n\n".join(p for p in parts if p)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


def test_hashed_runs_cover_what_the_suffix_array_covers():
    import random

    import numpy as np

    rng = random.Random(3)
    shared = [[rng.randrange(30) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
    pages = [[rng.choice(shared) if rng.random() < 0.4 else [rng.randrange(30) for _ in range(rng.randrange(0, 9))] for _ in range(rng.randrange(0, 6))] for _ in range(25)]
    words = [[[str(w) for w in b] for b in p] for p in pages]
    runs, n = np.unique(np.concatenate([np.unique(h) for h in html.run_hashes(words, 3)]), return_counts=True)
    got = [[list(map(bool, b)) for b in p] for p in html.covered_by(words, 3, runs[n >= 5])]
    assert got == brute_cover(pages, 3, 5)


@pytest.mark.parametrize("groups", [400, 20])
def test_rare_boilerplate_is_counted_over_the_whole_host(spark, groups):
    foot = "all rights kept by the makers of this fine section"
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"http://h.example/{i}", f"<div>{text(i)}</div>" + f"<div>{foot}</div>" * (i % 60 == 0)) for i in range(180)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages=groups).collect()}
    assert got == {i: text(i) for i in range(180)}


@pytest.mark.parametrize("groups", [400, 9])
def test_containers_lose_what_most_pages_of_the_host_repeat(spark, groups):
    sign, quote = "sign up for our letter and never miss a story again", "a passage that a few articles of the host have in common"
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"http://h.example/{i}", f"<main><p>{text(i)}</p>" + f"<p>{quote}</p>" * (i < 6) + f"<p>{sign}</p>" * (i % 4 > 0) + "</main>") for i in range(40)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages=groups).collect()}
    assert got == {i: text(i) + f"\n\n{quote}" * (i < 6) for i in range(40)}


def rows_of_python_steps(df):
    """(node, rows its Python workers returned) of a query that has run."""
    def walk(plan):
        name = plan.getClass().getSimpleName()
        below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
        metric = plan.metrics().get("pythonNumRowsReceived")
        return ([(name, metric.get().value())] if metric.isDefined() else []) + [x for p in below for x in walk(p)]

    return walk(df._jdf.queryExecution().executedPlan())


def test_groups_count_only_runs_that_a_decision_needs(spark):
    menu, sign = "home news sport weather travel money health science", "sign up for our letter and never miss a story again"
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    page = lambda i: f"<nav>{menu} {text(-i)}</nav><article><p>{text(i)}</p>" + f"<p>{sign}</p>" * (i % 3 > 0) + "</article>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(300)]
    df = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages=100)
    assert {r.page_id: r.text for r in df.collect()} == {i: text(i) for i in range(300)}
    made = sorted(n for name, n in rows_of_python_steps(df) if name != "MapInArrowExec")
    assert made == [12, 15, 300]  # of three groups four runs' counts, and before that those runs and a row; texts


def test_runs_near_the_share_are_counted_exactly_over_groups(spark):
    import random

    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [(some(12), p) for p in (0.02, 0.42, 0.46, 0.5, 0.5, 0.5, 0.54, 0.58)]
    pages = []
    for _ in range(180):
        body = [some(10)] + [x for x, p in shared if rng.random() < p]
        rng.shuffle(body)
        pages.append("".join(["<article>" if rng.random() < 0.9 else "<div>", *(f"<p>{x}</p>" for x in body)]))
    want = dict(enumerate(brute_text(pages)))
    assert 0 < sum(any(shared[3 + k][0] in x for k in range(3)) for x in want.values())
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for groups in (60, 7, 1):
        assert {r.page_id: r.text for r in html.extract(df, group_pages=groups).collect()} == want
