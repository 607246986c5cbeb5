"""Small fixtures against brute force, exact round trips, and the defined results of odd inputs."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import (
    chat_format,
    compression_classifier,
    decontamination,
    html_extraction,
    jaccard_join,
    mixing,
    quality_rules,
    substring_dedup,
    url_filters,
    warc,
)
from sievework.llm.common import pick, shared_path
from sievework.llm.components import components
from tests.llm import helpers

DOCS = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def with_clashes(df):
    """Further columns named like internal and result columns, and like ``text`` but for case."""
    clashing = ("TEXT", "n_words", "path", "source_doc", "score", "rate", "u", "node", "__part", "__text")
    return df.select("*", *[F.lit(7).alias(n) for n in clashing])


@pytest.fixture(scope="module")
def texts():
    return helpers.edge_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return with_clashes(spark.createDataFrame(texts, DOCS)).repartition(3)


def test_pick_prefers_exact_names(spark):
    df = spark.range(1).select(F.lit("a").alias("TEXT"), F.lit("b").alias("text"), F.lit("c").alias("text"))
    assert pick(df, t="text").collect()[0].t == "b"


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


# --- 1


def digests(found):
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0
    )


ITEMS = [(1, "  ".join(f"Shared{i}" for i in range(20, 45))), (2, "two, words"), (3, None), (4, ""), (5, "TWO WORDS"), (6, "quick brown fox jumps")]


def test_decontamination_against_brute_force(spark, docs, texts):
    bench = with_clashes(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert rows(digests(decontamination.decontaminate(docs, bench))) == sorted(helpers.contaminated(texts, ITEMS), key=repr)
    index = decontamination.build_index(docs, segment_bytes=2000)
    blocks = decontamination.summarise(decontamination.search(index, bench, block_bytes=30))
    assert rows(digests(blocks)) == sorted(helpers.contaminated(texts, ITEMS), key=repr)


def test_decontamination_of_random_overlaps(spark):
    """Items of one id and several texts, ties, items longer than a block."""
    rng = random.Random(4)
    piece = lambda n: " ".join(f"v{rng.randrange(6)}" for _ in range(n))
    data = [(i, piece(rng.randrange(60))) for i in range(60)]
    items = [(i % 7, piece(rng.randrange(1, 14))) for i in range(20)] + [(50, data[3][1]), (51, f"{data[3][1]} {data[4][1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (60, 1 << 20):
        index = decontamination.build_index(spark.createDataFrame(data, DOCS).repartition(3))
        found = decontamination.summarise(decontamination.search(index, bench, block_bytes=block_bytes))
        assert rows(digests(found)) == sorted(helpers.contaminated(data, items), key=repr)


def test_items_without_id(spark):
    bench = spark.createDataFrame([(None, "alpha beta"), (2, "gamma")], "item_id long, text string")
    found = decontamination.decontaminate(spark.createDataFrame([(1, "Alpha beta x gamma")], DOCS), bench).first()
    assert (found.n_hit, list(found["items"])) == (3, ["2"])


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = {
        r.doc_id: r.n_hit
        for r in decontamination.decontaminate(
            spark.createDataFrame([(1, "gamma x beta alpha"), (2, "alpha x y z beta gamma"), (3, "alpha beta"), (4, "beta gamma alpha")], DOCS), bench, slop=1
        ).collect()
    }
    assert found[1] > 0 and found[4] > 0 and found[2] == 0 and found[3] == 0


def test_remove_contaminated_keeps_other_null_ids(spark):
    data = [(None, "quick brown fox jumps high"), (None, "clean words only"), (1, "clean"), (1, "quick brown fox jumps")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontamination.remove_contaminated(spark.createDataFrame(data, DOCS), bench)
    assert rows(left) == sorted([(None, "clean words only"), (1, "clean")], key=repr)


# --- 2

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "http://example.org", "http://xexample.org/es/", "ftp://m.com/de/",
    "http://com/fr/a#b?c", "http://example.org/en/12", "http://a.b/c?d://e/f", "x://Ü.ORG/", "a://b://c/d",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut].translate(helpers.LOWER), rest[cut:].split("?")[0].split("#")[0]
    fits = [h + p for _, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_against_brute_force(spark):
    data = [(i, u) for i, u in enumerate(URLS)] + [(3, "http://example.org"), (None, "http://com/de/")]
    labelled = spark.createDataFrame([("http://spam.net/a", True), ("http://fine.net/a", False), (None, True), ("http://x.y/", None)], "url string, bad boolean")
    found = url_filters.filter_urls(with_clashes(spark.createDataFrame(data, "page_id long, url string")), labelled, RULES)
    assert rows(found.select("page_id", "host", "path", "rule")) == sorted([(i, *brute_url(u)) for i, u in data], key=repr)


def test_mined_rules_block(spark):
    data = [(f"http://{'cheap-pills' if i % 4 == 0 else 'news'}{i % 5}.net/p/{i}", i % 4 == 0) for i in range(200)]
    labelled = spark.createDataFrame(data, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://cheap-pills9.net/q"), (2, "http://news.net/q"), (3, None)], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, labelled, []).collect()}
    assert verdicts == {1: "block", 2: "allow", 3: "allow"}


def brute_rules(data, min_support, min_confidence, min_count, errors):
    """{tokens} of all rules, by counting every combination of up to four tokens."""
    total, n_bad = len(data), sum(bad for _, bad in data)
    sets = [(frozenset(c), bad) for tokens, bad in data for k in range(1, 5) for c in itertools.combinations(sorted(tokens), k)]
    whole, bads, found = Counter(s for s, _ in sets), Counter(s for s, bad in sets if bad), {}
    for s, n in bads.items():
        share, z2, m = n / whole[s], errors**2, whole[s]
        bound = (share + z2 / (2 * m) - errors * math.sqrt((share * (1 - share) + z2 / (4 * m)) / m)) / (1 + z2 / m)
        if n >= max(min_support * total, min_count) and share >= min_confidence and bound > n_bad / total:
            found[s] = share
    return {s for s, c in found.items() if not any(o < s and found[o] >= c for o in found)}


def test_mined_verdicts_against_brute_force(spark):
    rng = random.Random(12)
    hosts, parts = [f"{a}{b}.net" for a in ("cheap-", "news", "shop-") for b in "xyz"], ["buy", "read", "p7", "en"]
    data = []
    for i in range(400):
        host, path = rng.choice(hosts), "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
        chance = 0.9 if "cheap" in host and "buy" in path else 0.7 if host == "shop-x.net" else 0.15
        data.append((i, f"http://{host}/{path}?id={i % 3}", rng.random() < chance))
    labelled = spark.createDataFrame(data, "page_id long, url string, bad boolean")
    tokens = {r.page_id: frozenset(r.t) for r in labelled.select("page_id", url_filters.tokens_of(F.col("url")).alias("t")).collect()}
    for settings in ((0.002, 0.6, 10, 3.0), (0.05, 0.5, 1, 1.0)):
        expected = brute_rules([(tokens[i], bad) for i, _, bad in data], *settings)
        share, confidence, count, errors = settings
        rules = url_filters.mine_rules(labelled, share, confidence, 4, count, errors)
        found = {frozenset(r.tokens) for r in rules.collect()}
        assert found == expected and found
        index = url_filters.rule_index(rules, labelled.select(url_filters.tokens_of(F.col("url")).alias("tokens")))
        blocked = {r.url for r in url_filters.match_rules(labelled, index).collect()}
        assert blocked == {url for i, url, _ in data if any(r <= tokens[i] for r in expected)}


def test_chance_makes_no_rules(spark):
    """Labels that have nothing to do with the URLs give no rules, however few they are."""
    rng = random.Random(3)
    data = [(f"http://h{rng.randrange(40)}.net/{rng.choice('abc')}/{rng.randrange(9)}", rng.random() < 0.15) for _ in range(900)]
    assert url_filters.mine_rules(spark.createDataFrame(data, "url string, bad boolean")).count() == 0


def test_no_labels_block_nothing(spark):
    empty = spark.createDataFrame([], "url string, bad boolean")
    assert url_filters.mine_rules(empty).count() == 0


# --- 3


def test_mixing(spark):
    data = [(i, "w " * (1 + i % 5), "a" if i % 3 else None, 1) for i in range(300)] + [(None, None, "b", 2), (5, "", "c", 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, Rate int")
    mixed = mixing.mix_sources(docs).collect()
    assert mixed == mixing.mix_sources(docs.repartition(7)).collect()
    assert [r.shuffle_key for r in mixed] == sorted(r.shuffle_key for r in mixed)
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    assert rates["b"] == rates["c"] == 0
    for source in ("a", None):
        own = [r for r in mixed if r.source == source]
        expected = rates[source] * sum(1 for d in data[:300] if d[2] == source)
        assert abs(len(own) - expected) < 5 * expected**0.5
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix_sources(docs, weights).collect()} == {"a"}


def test_large_rates(spark):
    docs = spark.createDataFrame([(1, "w", "rare")] + [(i, "w " * 1000, "big") for i in range(2, 6)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("rare", 1.0), ("big", 1.0)], "source string, weight double")
    n = mixing.mix_sources(docs, weights).filter("source = 'rare'").count()
    assert abs(n - 2000) < 300


# --- 4


def test_jaccard_against_brute_force(spark, docs, texts):
    assert rows(jaccard_join.jaccard_classes(docs)) == sorted(helpers.jaccard(texts), key=repr)


def test_jaccard_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    common = [f"c{i}" for i in range(40)]
    data = []
    for i in range(150):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(150)] = f"x{rng.random()}"
        data.append((i, " ".join(own)))
    for i in range(150, 300):
        data.append((i, " ".join([*common, *[f"y{rng.randrange(10**9)}" for _ in range(40)]])))
    data += [(300 + i, data[i][1]) for i in range(20)]
    found = jaccard_join.jaccard_classes(spark.createDataFrame(data, DOCS))
    assert rows(found) == sorted(helpers.jaccard(data), key=repr)


def test_jaccard_recall_in_a_large_bucket(spark, monkeypatch):
    """Pairs just over the threshold, all with one boilerplate, so that their buckets are large and split."""
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 8)
    rng = random.Random(11)
    common, data = [f"c{i}" for i in range(204)], []
    for i in range(400):
        own = [f"y{rng.randrange(10**9)}" for _ in range(96)]
        data += [(2 * i, " ".join([*common, *own])), (2 * i + 1, " ".join([*common, *own[:68], *[f"z{rng.randrange(10**9)}" for _ in range(28)]]))]
    pair = helpers.jaccard(data[:4])
    assert [(c, n) for _, c, n in pair] == [(0, 1), (0, 1), (2, 1), (2, 1)]
    found = {r.doc_id: r.n_links for r in jaccard_join.jaccard_classes(spark.createDataFrame(data, DOCS)).collect()}
    assert sum(found.values()) >= 2 * 398


def test_jaccard_runs():
    """Misses by paths and by the estimate together stay within the recall."""
    runs, need = jaccard_join.runs_for(0.999), jaccard_join.least_equal(0.8)
    short = sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(need))
    assert (1 - 0.8**jaccard_join.DEPTH) ** runs + short <= 0.001


def test_keep_one_of_each(spark, docs):
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr)
    assert ids == sorted([1, 2, 3, 4, 5, 6, 7, 9, 11, 12, None], key=repr)


# --- 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site {i}</a></header><nav><ul><li><a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><article><h1>Head &amp; {i}</h1><p>Text <b>bo</b>ld {i}<br>next&nbsp;line</p><div class="ad">Buy {i}</div>
<p>Second {i}</p><!-- no --><form><input value="x">Mail</form><ul><li>one</li><li>two</li></ul></article><aside>Side {i}</aside>
<section id="comments"><p>Comment {i}</p></section></div><footer>&copy; {i}</footer></body></html>"""


def test_html_extraction(spark):
    data = [(i, f"http://h{i % 2}.com/{i}", PAGE.format(i=i)) for i in range(12)]
    data += [(20, None, "<p>Only</p> <p>this"), (21, "x", None), (22, "http://h0.com/q", ""), (23, "http://h0.com/r", "<article><p>cut off<b"), (0, "http://h0.com/0", PAGE.format(i=0))]
    found = html_extraction.extract_main_text(with_clashes(spark.createDataFrame(data, "page_id long, url string, html string")))
    text = {r.page_id: r.text for r in found.collect()}
    for i in range(12):
        assert text[i] == f"Head & {i} Text bold {i} next line Second {i} one two"
    assert (text[20], text[21], text[22], text[23]) == ("Only this", "", "", "cut off")
    assert found.count() == len(data)


def test_wrappers_without_article(spark):
    body = "".join(f"<p>Paragraph {{i}} number {k} with a good many words in it</p>" for k in range(4))
    html = f'<body><div class="menu"><a>x</a></div><div id="box"><div class="inner">{body}</div></div><div class="footer">f</div></body>'
    data = [(i, "http://a.b/", html.format(i=i)) for i in range(3)]
    found = html_extraction.extract_main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Paragraph") and r.text.count("Paragraph") == 4 for r in found)


@pytest.mark.parametrize("html, text", [
    ('<BODY><DIV CLASS=content-sidebar-wrap><ARTICLE><P>in</ARTICLE><div class="sidebar">out</div></DIV>', "in"),
    ('<form action=x><main><p>in</p><form>out</form></main><input></form>', "in"),
    ('<article><header><h1>Head</h1><p>By me</p></header><p>a&nbsp;&lt;b&gt; &copy c</p><section class="comments"><article class="comment">no</article></section></article>', "Head a <b> © c"),
    ('<div class="header">site</div><div><p>one two three four five</p><p>six seven eight</p></div><div role="search">s</div><div hidden>h</div>', "one two three four five six seven eight"),
    ('<article>a<script>if (a</b) "</article>"</script><![CDATA[x]]><!-- <p>c</p> -->b<br>c<i>d</i>e</article>', "ab cde"),
    ('<article><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><pre> k\n  l</pre></article><p>after', "x y 1 2 3 k l"),
    ("just text", "just text"), ("<<>< a < b", "<<>< a < b"),
])
def test_odd_pages(html, text):
    assert html_extraction.extract(html, None) == text


def wrapper(*pages):
    whole = {}
    for page in pages:
        html_extraction.merge(whole, html_extraction.wrapper_of(html_extraction.read_blocks(page)))
    return whole


def test_wrapper_alignment():
    pages = ["<body><h1>a</h1><p>b</p><p>c</p></body>", "<body><h1>a</h1><p>b</p><table></table></body>", "<body><h1>a</h1></body>"]
    expected = "<#root><body><h1>{=}</h1><p>{}</p>+?<table></table>?</body></#root>"
    assert {html_extraction.expression(wrapper(*order)) for order in itertools.permutations(pages)} == {expected}
    groups = wrapper("<h1>t</h1><h2>a</h2><p>b</p><h2>c</h2><p>d</p><ul><li>x</ul>", "<h1>u</h1><h2>a</h2><p>b</p>")
    assert html_extraction.expression(groups) == "<#root><h1>{}</h1>(<h2>{}</h2><p>{}</p>)+<ul><li>{=}</li></ul>?</#root>"


def brute_wrapper(trees):
    """{path: (pages, blocks, holders, most, constant)} of trees (key, text, inner), by recursion."""
    out = {}
    for number, tree in enumerate(trees):
        seen = {}

        def visit(node, path):
            key, text, inner = node
            slot = seen.setdefault(path, {"blocks": 0, "holders": 0, "most": 0, "texts": []})
            slot["blocks"] += 1
            slot["texts"].append(repr(node))
            for k in {i[0] for i in inner}:
                below = seen.setdefault((*path, k), {"blocks": 0, "holders": 0, "most": 0, "texts": []})
                n = sum(i[0] == k for i in inner)
                below["holders"] += 1
                below["most"] = max(below["most"], n)
            for i in inner:
                visit(i, (*path, i[0]))

        visit(tree, ())
        for path, slot in seen.items():
            pages, blocks, holders, most, texts = out.get(path, (0, 0, 0, 0, set()))
            out[path] = pages + 1, blocks + slot["blocks"], holders + slot["holders"], max(most, slot["most"]), texts | {tuple(slot["texts"])}
    return {p: (*v[:4], len(v[4]) == 1) for p, v in out.items() if p}


def test_wrappers_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)

    def tree(depth):
        return rng.choice(["div", "section", "h2"] if depth else ["p", "h2"]), rng.choice("xy"), [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []

    def html(node):
        return f"<{node[0]}>{node[1]}{''.join(map(html, node[2]))}</{node[0]}>"

    trees = [("#root", "", [tree(3) for _ in range(rng.randrange(1, 4))]) for _ in range(40)]
    pages = ["".join(map(html, t[2])) for t in trees]
    expected = brute_wrapper(trees)
    monkeypatch.setattr(html_extraction, "HELD_SLOTS", 50)
    data = [(i, "http://a.b/", p) for i, p in enumerate(pages)]
    for order in (data, data[::-1]):
        found = html_extraction.infer_wrappers(spark.createDataFrame(order, "page_id long, url string, html string").repartition(5)).toArrow()
        slots = html_extraction.wrapper_from(found)
        assert slots == wrapper(*pages)
        for path, values in expected.items():
            at = html_extraction.ROOT
            for key in path:
                at = html_extraction.path_under(at, key)
            slot = slots.pop(at)
            assert (slot.pages, slot.blocks, slot.holders, slot.most, slot.constant) == values
        assert list(slots) == [html_extraction.ROOT]


def test_wrappers_decide():
    """What no tag or class names is told apart by what a host's pages share and repeat, at any number of pages."""
    pages = [
        f'<div class="q"><p>Our shop is open until six, ask for our offers</p></div><table><tr><td><a href="/">Start</a></td><td><a href="/b">Offers</a></td></tr></table>'
        f'<div class="z"><p>{" ".join(f"own{i}x{k}" for k in range(30))}</p><div class="k">All prices with tax</div><p>more{i} words</p></div>'
        for i in range(12)
    ]
    for n in (2, 9, 10, 12):
        rules = html_extraction.rules_of(wrapper(*pages[:n]))
        for i in range(n):
            text = html_extraction.extract(pages[i], rules)
            assert text.startswith(f"own{i}x0 ") and text.endswith(f"own{i}x29 more{i} words") and "prices" not in text
    assert "prices" in html_extraction.extract(pages[0], None)  # one page shares nothing


def test_equal_articles_are_no_template():
    """Copies of one article on a host, and an article that is alike but for its heading, stay whole."""
    body = '<div class="text">' + "some words that are all alike " * 9 + "</div>"
    for heads in (["h"] * 5, [f"h{i}" for i in range(5)]):
        pages = [f"<article><h1>{h}</h1>{body}</article>" for h in heads]
        rules = html_extraction.rules_of(wrapper(*pages))
        assert all("all alike" in html_extraction.extract(p, rules) for p in pages)


def test_split_articles_and_teasers():
    split = '<article class="lead"><p>one two</p></article><p>between</p><article class="rest"><p>three</p></article>'
    assert html_extraction.extract(split, None) == "one two three"
    teasers = '<article class="card"><p>short</p></article>' * 3
    assert html_extraction.extract(f'<article class="whole"><p>{"long text " * 20}</p></article>{teasers}', None) == ("long text " * 20).strip()
    assert html_extraction.extract(teasers, None) == "short short short"


def test_marks_are_whole_names():
    kept = ["hidden-gem", "rail-transport", "share-price", "ad-hoc", "menu-engineering", "notice-period"]
    gone = ["hidden", "ad-slot", "site-footer", "cookieNotice", "comment-list", "nav-primary", "related-posts", "sidebar-wrap", "newsletter-signup"]
    page = "<article>" + "".join(f'<div class="{c}">{c}</div>' for c in kept + gone) + "<math><mi>mc</mi><mn>2</mn></math><fieldset>f</fieldset></article>"
    assert html_extraction.extract(page, None).split() == [*kept, "mc2", "f"]


@pytest.mark.parametrize("html, words", [
    ("<div>" * 20_000 + "<p>x</p>", 1), ("<p>a</div></li></section>" * 20_000, 20_000), ("<h2>a</h2><p>b</p>" * 20_000, 40_000),
    ("<ul><li>a" * 20_000, 20_000), ("<article>" * 5_000 + "a", 1), ("<table><tr><td>" * 5_000 + "a" + "</table>" * 5_000, 1), ("<a '>" * 20_000, 0),
])
def test_deep_and_long_pages(html, words):
    """Deep nesting and long lists of siblings, alone and aligned with themselves, neither crash nor take long."""
    started = time.monotonic()
    whole = wrapper(html, html)
    assert len(html_extraction.extract(html, None).split()) == len(html_extraction.extract(html, html_extraction.rules_of(whole)).split()) == words
    assert html_extraction.expression(whole).startswith("<#root>")
    assert time.monotonic() - started < 20


def test_preambles_and_equal_siblings_are_no_template():
    """Texts that start alike vary; a constant block doesn't take its variable sibling of equal key with it."""
    pages = [
        f'<body><article><h1>h{i}</h1><div class="text">{"same preamble " * 20} own{i} words</div>'
        f'<div class="box">always alike</div><p>p{i}</p><div class="box">varies{i}</div>'
        '<div class="remark">printed on every page of this host, longer than any hash</div></article></body>'
        for i in range(12)
    ]
    for n in (2, 12):
        rules = html_extraction.rules_of(wrapper(*pages[:n]))
        for i, page in enumerate(pages[:n]):
            text = html_extraction.extract(page, rules)
            assert f"own{i} words" in text and f"varies{i}" in text and "printed on" not in text


# --- 6


def dedup_digests(done):
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256))


@pytest.mark.parametrize("part_bytes", [1000, 2 << 20])
def test_substring_dedup_against_brute_force(spark, docs, texts, part_bytes):
    done = substring_dedup.dedup_substrings(docs, part_bytes=part_bytes)
    assert rows(dedup_digests(done)) == sorted(helpers.deduplicated(texts), key=repr)


def test_substring_dedup_of_random_overlaps(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE_EDGES", 500)
    rng = random.Random(3)
    pieces = [" ".join(rng.choice("abcdefg") + str(rng.randrange(40)) for _ in range(30)) for _ in range(12)]
    data = [(i * 7 % 61, " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    done = substring_dedup.dedup_substrings(spark.createDataFrame(data, DOCS), part_bytes=3000)
    assert rows(dedup_digests(done)) == sorted(helpers.deduplicated(data), key=repr)


def test_substring_dedup_carries_columns_and_spans(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    data = [(1, "en", f"a b\n{passage} c"), (2, "de", f"x {passage}\ty  z")]
    done = substring_dedup.dedup_substrings(spark.createDataFrame(data, "doc_id long, lang string, text string"), carry=True)
    two = done.filter("doc_id = 2").first()
    assert done.columns == ["doc_id", "lang", "text", "n_words", "n_removed", "spans"]
    assert (two.text, two.lang, two.n_removed) == ("x y  z", "de", 20)
    assert [tuple(s) for s in two.spans] == [(1, 21, 1, 2)]


def test_spans_are_verified_at_their_source(spark, monkeypatch):
    """Edges that collide remove nothing: spans whose words differ from those at the source's coordinates are dropped."""
    from sievework.llm import words

    true_hashes = words.window_hashes

    def colliding(found, size):
        at, hashes = true_hashes(found, size)
        return at, hashes % words.U64(7) << words.U64(60)

    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    data = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(30)] + [(40, f"{passage} x"), (41, f"y {passage}")]
    docs = spark.createDataFrame(data, DOCS)
    whole = {r.doc_id: (r.n_removed, [tuple(s) for s in r.spans]) for r in substring_dedup.dedup_substrings(docs, part_bytes=2000).collect()}
    assert whole[41] == (30, [(1, 31, 40, 0)]) and all(whole[i] == (0, []) for i in range(41) if i in whole)
    monkeypatch.setattr(substring_dedup, "window_hashes", colliding)
    for r in substring_dedup.dedup_substrings(docs, part_bytes=2000).collect():
        assert r.n_removed == 0 or r.doc_id == 41


# --- 7


def test_base_rules_against_brute_force(spark, texts):
    odd = ["a b c d e " * 7, "x\n x\nx\n\n#$% <&>|", "é " * 40, "1 2 3 4 5 6 7 8 9 10", "one two three four five six one two three four five six " + " ".join(map(str, range(99)))]
    data = [(d, t, "en", "s") for d, t in texts] + [(100 + i, t, None, None) for i, t in enumerate(odd)]
    judged = quality_rules.judge(with_clashes(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")))
    found = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(found) == sorted([(d, *helpers.base_rules(t)) for d, t, _, _ in data], key=repr)
    assert judged.filter("base_failed AND kept").isEmpty()


def test_outliers(spark):
    rng = random.Random(1)
    prose = lambda: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(25)) for _ in range(4))
    data = [(i, prose(), "en", "s") for i in range(200)]
    data += [(1000 + i, " ".join(f"{w}###" for w in prose().split()), "en", "s") for i in range(40)]
    data += [(2000 + i, prose(), "xx", "small") for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[i] for i in range(200)) >= 198
    assert not any(kept[1000 + i] for i in range(40))
    assert all(kept[2000 + i] for i in range(5))


def test_outliers_of_small_groups(spark):
    """Junk in groups under MIN_GROUP is found by their language, or by all rows; 40% of junk don't make the estimate theirs."""
    rng = random.Random(2)
    prose = lambda: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(25)) for _ in range(4))
    junk = lambda: " ".join(f"{w}###" for w in prose().split())
    data = [(i, prose(), "en", f"s{i % 20}") for i in range(200)] + [(1000 + i, junk(), "en", f"s{i % 20}") for i in range(40)]
    data += [(2000 + i, prose(), "xx", "t") for i in range(5)] + [(3000 + i, junk(), "xx", None) for i in range(5)]
    data += [(4000 + i, prose(), "yy", "u") for i in range(60)] + [(5000 + i, junk(), "yy", "u") for i in range(40)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    good = [k for k in kept if k // 1000 in (0, 2, 4)]
    assert len(kept) == len(data) and sum(kept[i] for i in good) >= len(good) - 6
    assert not any(v for k, v in kept.items() if k // 1000 in (1, 3, 5))


def brute_estimate(x, floors):
    """Centre and Cholesky factor of the minimum-covariance-determinant estimate, with numpy."""

    def bound(values, share):
        return np.sort(values)[max(1, math.ceil(share * len(values))) - 1]

    middle = np.array([bound(c, 0.5) for c in x.T])
    spread = np.sqrt(np.array([((bound(c, 0.75) - bound(c, 0.25)) / 1.349) ** 2 for c in x.T]) + floors**2)
    z = (x - middle) / spread
    length = np.linalg.norm(z, axis=1)
    signs = np.where(length[:, None] > 0, z / np.where(length > 0, length, 1)[:, None], 0)
    starts = [np.diag(spread**2)] + [np.cov(v.T, bias=True) * np.outer(spread, spread) + np.diag(floors**2) for v in (np.tanh(z), signs)]
    found = []
    for covariance in starts:
        centre = middle
        for _ in range(200):
            solved = np.linalg.solve(np.linalg.cholesky(covariance), (x - centre).T)
            d = np.sqrt((solved**2).sum(axis=0))
            core = x[d <= bound(d, 0.5)]
            before = np.linalg.slogdet(covariance)[1]
            centre, covariance = core.mean(axis=0), np.cov(core.T, bias=True) * quality_rules.CONSISTENCY + np.diag(floors**2)
            if abs(np.linalg.slogdet(covariance)[1] - before) < 1e-12:
                break
        found.append((np.linalg.slogdet(covariance)[1], centre, covariance))
    return min(found, key=lambda f: f[0])[1:]


def test_distances_against_brute_force(spark, monkeypatch):
    """The verdicts are those of the least determinant of all starts, found with numpy, also where 45% of rows are a cloud of their own."""
    monkeypatch.setattr(quality_rules, "SETTLED", 1e-12)
    rng = np.random.default_rng(3)
    words = lambda n, low, high: ["".join(rng.choice(list("abcdefgh"), rng.integers(low, high))) for _ in range(n)]
    data = []
    for i in range(220):
        odd = i % 20 < 9
        own = words(int(rng.integers(60, 120)), *((7, 12) if odd else (2, 8)))
        data.append((i, " ".join(w + ("#" if odd and k % 3 == 0 else "") + ("\n" if k % 10 == 9 else "") for k, w in enumerate(own)), "en", f"s{i % 2}"))
    judged = quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    stats = quality_rules.base_statistics(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"))
    names = list(quality_rules.transformed())
    vectors = stats.select("doc_id", *[c.alias(n) for n, c in quality_rules.transformed().items()]).toPandas().set_index("doc_id")
    for source in (0, 1):
        ids = [i for i in range(220) if i % 2 == source and not judged.base_failed[i]]
        x = vectors.loc[ids, names].to_numpy()
        centre, covariance = brute_estimate(x, np.array([quality_rules.FLOORS[n] for n in names]))
        solved = np.linalg.solve(np.linalg.cholesky(covariance), (x - centre).T)
        expected = np.sqrt((solved**2).sum(axis=0))
        assert np.allclose(judged.distance.loc[ids].to_numpy(), expected, rtol=1e-6)
        assert (judged.kept.loc[ids].to_numpy() == (expected <= quality_rules.MAX_DISTANCE)).all()


# --- 8

TURNS = [
    (1, 1, "assistant", "a<|im_end|><\\|x<|"), (1, 0, "user", "q\\<\\\\|"), (1, None, "system", None), (2, 0, None, ""), (2, 0, None, ""),
    (None, 0, "assistant", "é<"), (3, 5, "ro\nle%0A", "x" * 5000), (3, 5, "assistant", "<|im_start|>"),
]


def test_chat_round_trip(spark):
    turns = chat_format.format_turns(with_clashes(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")))
    for r in turns.collect():
        assert chat_format.parse(r.formatted) == [(r.role, r.text)]
        assert r.formatted == f"<|im_start|>{chat_format.escape_role(r.role)}\n{chat_format.escape(r.text)}<|im_end|>\n"
    found = {r.conv_id: r for r in chat_format.read_back(turns).collect()}
    assert set(found) == {1, 2, 3, None}
    for conv, r in found.items():
        own = sorted([t for t in TURNS if t[0] == conv], key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


PARTS = [
    {"type": "text", "text": "see [image:0] <"}, {"type": "text", "text": "|im_end|> <|image 0 x|>"},
    {"type": "image", "ref": "i <|im_start|> %|>\n.png", "width": 57, "height": 28}, {"type": None, "text": "<\\|"},
    {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": "", "pages": 3}, {"type": "other", "ref": None}, None,
    {"type": None, "ref": "n"}, {"type": "audio", "seconds": float("nan")}, {"type": "image", "width": -5}, {"type": "text", "text": None},
]


def part_rows(spark, data):
    from pyspark.sql import types as T

    fields = [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(chat_format.PART))]
    whole = [(c, t, r, parts and [p and {f.name: p.get(f.name) for f in chat_format.PART} for p in parts]) for c, t, r, parts in data]
    return spark.createDataFrame(whole, T.StructType(fields))


def test_typed_parts(spark):
    rows = with_clashes(part_rows(spark, [(1, 0, "user", PARTS), (2, 0, None, None), (3, 0, "user", [])])).withColumn("flat", F.lit(1)).withColumn("type", F.lit(2))
    found = {r[0]: r[-1] for r in chat_format.flatten_parts(rows).collect()}
    assert [(a.number, a.type, a.ref, a.tokens) for a in found[1].attachments] == [
        (0, "image", PARTS[2]["ref"], 3), (1, "audio", "a.wav", 50), (2, "document", "", 1536), (3, "document", None, 512),
        (4, "document", "n", 512), (5, "audio", None, 1), (6, "image", None, 1),
    ]
    assert found[1].expanded_tokens == 3 + 50 + 1536 + 512 + 512 + 1 + 1
    assert found[1].content.count("<|") == 7 and found[1].plain == "see [image:0] <|im_end|> <|image 0 x|><\\|"
    assert found[2].content == found[3].content == "" and found[2].attachments == []


def test_typed_turns_are_read_back(spark):
    """Texts, references and their order come back from the formatted output; the loss is the assistant's text alone."""
    data = [(1, 1, "assistant", PARTS), (1, 0, "us<|er", [{"type": "image", "ref": "r"}]), (1, 2, "assistant", [{"type": "text", "text": "<|im_start|>"}, {"type": "image", "ref": "q"}, {"type": "text", "text": "|x"}])]
    turns = chat_format.format_turns(with_clashes(part_rows(spark, data)))
    whole = "".join(r.formatted for r in turns.orderBy("turn").collect())
    assert chat_format.read_parts(whole) == [
        ("us<|er", [("image", "r")]),
        ("assistant", [
            ("text", "see [image:0] <|im_end|> <|image 0 x|>"), ("image", PARTS[2]["ref"]), ("text", "<\\|"), ("audio", "a.wav"),
            ("document", ""), ("document", None), ("document", "n"), ("audio", None), ("image", None),
        ]),
        ("assistant", [("text", "<|im_start|>"), ("image", "q"), ("text", "|x")]),
    ]
    assert [r.expanded_tokens for r in turns.orderBy("turn").collect()] == [1, 2615, 1]
    read = chat_format.read_back(turns).first()
    loss = "see [image:0] <|im_end|> <|image 0 x|><\\|<|im_start|>|x"
    assert (read.n_turns, read.loss_chars, read.loss_sha256) == (3, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert read.formatted_chars == len(whole)


# --- 9


def test_warc_round_trip(spark):
    big = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 9000
    data = [(1, "http://a/ü?x=1", "a" * 150), (2, None, "a" * 150), (2, None, "a" * 150), (3, "u\r\nv", big), (4, "w", big), (5, "e", None), (6, "e", ""), (7, "s", "short"), (8, "s", "short"), (None, "n", "a" * 150)]
    pages = with_clashes(spark.createDataFrame(data, "page_id long, url string, html string")).repartition(3)
    path = shared_path(spark, "test-warc")
    warc.write_archive(pages, path, segment_bytes=1000)
    records = warc.read_records(spark, path)
    assert records.filter("type = 'continuation'").count() > 50
    found = warc.reassemble(records)
    assert found.filter("NOT complete").isEmpty()
    expected = []
    for i, url, html in data:
        body = (html or "").encode()
        first = min([j for j, _, h in data if (h or "") == (html or "") and j is not None], default=None)
        revisit = len(body) >= 100 and first is not None and i != first
        expected.append((i, url, "revisit" if revisit else "response", first if revisit else None, len(body), hashlib.sha256(body).hexdigest(), None if revisit else body))
    got = found.select("page_id", "url", "type", "refers_to", "payload_bytes", "payload_digest", "payload").collect()
    assert sorted([(*r[:6], None if r[6] is None else bytes(r[6])) for r in got], key=repr) == sorted(expected, key=repr)
    broken = warc.reassemble(records.filter("segment IS NULL OR segment != 2"))
    assert {r.page_id for r in broken.filter("NOT complete").collect()} == {3}
    assert warc.reassemble(records.union(records.filter("segment = 2"))).filter("NOT complete").isEmpty()


def warc_record(kind, block, length=None, **headers):
    lines = [f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()], f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\n\r\n"
ODD = [
    ("good", warc_record("response", HTTP + b"one\r\n", WARC_Record_ID="<a>", WARC_Page_ID=1), True),
    ("separators", warc_record("response", HTTP + b"\r\n\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n", WARC_Record_ID="<b>", WARC_Page_ID=-2), True),
    ("no length", warc_record("response", HTTP + b"three", "many", WARC_Record_ID="<c>", WARC_Page_ID="x"), False),
    ("huge number", warc_record("response", HTTP + b"four", WARC_Record_ID="<d>", WARC_Page_ID=10**30, WARC_Segment_Number="1e3"), True),
    ("between records", b"\r\nnoise\r\n\r\n" + warc_record("response", HTTP + b"five", WARC_Record_ID="<e>", WARC_Page_ID=5), True),
    ("empty", warc_record("response", b"", WARC_Record_ID="<f>", WARC_Page_ID=6), True),
    ("cut off", warc_record("response", HTTP + b"seven", 9999, WARC_Record_ID="<g>", WARC_Page_ID=7), False),
]


@pytest.mark.parametrize("compressed", [True, False])
def test_odd_archives(spark, tmp_path, compressed):
    """Malformed headers, noise, cut-off blocks; per-record gzip members; plain files that Spark reads in many splits."""
    import gzip

    for n in range(2):
        raw = [gzip.compress(r) if compressed else r for _, r, _ in ODD]
        (tmp_path / f"{n}.warc{'.gz' if compressed else ''}").write_bytes(b"".join(raw))
    for split in ("128m", "200b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        records = warc.read_records(spark, str(tmp_path))
        expected = [(f"<{c}>", ok) for c, (_, _, ok) in zip("abcdefg", ODD, strict=True)] * 2
        assert sorted((r.record_id, r.whole) for r in records.collect()) == sorted(expected)
        found = {r.record_id: (r.page_id, bytes(r.payload), r.complete) for r in warc.reassemble(records).collect()}
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        assert found == {
            "<a>": (1, b"one\r\n", True), "<b>": (-2, b"\r\n\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n", True), "<c>": (None, b"three", False),
            "<d>": (None, b"four", True), "<e>": (5, b"five", True), "<f>": (6, b"", True), "<g>": (7, found["<g>"][1], False),
        }


def test_truncated_gzip(spark, tmp_path):
    import gzip

    raw = gzip.compress(b"".join(warc_record("response", HTTP + random.Random(i).randbytes(3000), WARC_Record_ID=f"<{i}>", WARC_Page_ID=i) for i in range(200)))
    (tmp_path / "cut.warc.gz").write_bytes(raw[: len(raw) // 2])
    found = warc.reassemble(warc.read_records(spark, str(tmp_path), skip_corrupt=True)).collect()
    assert 10 < len(found) < 190 and sum(not r.complete for r in found) <= 1
    assert all(bytes(r.payload) == random.Random(r.page_id).randbytes(3000) for r in found if r.complete)
    with pytest.raises(Exception):
        warc.read_records(spark, str(tmp_path)).count()


def test_warc_headers():
    """Each record has the mandatory headers; revisits and continuations those of their kind."""
    revisit = warc.page_records("k", 2, "http://b/", b"x", "d", 1, "http://a/", 1000)[0].decode()
    parts = [r.decode("latin-1") for r in warc.page_records("k", 2, "http://b/", b"x" * 5000, "d", None, None, 1000)]
    for r in [revisit, *parts]:
        assert all(f"\r\n{h}: " in r for h in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"))
    assert "WARC-Refers-To-Target-URI: http://a/\r\n" in revisit and "WARC-Refers-To-Date: " in revisit and "WARC-Profile: " in revisit
    assert all("WARC-Segment-Origin-ID: " in r for r in parts[1:]) and "WARC-Segment-Total-Length: " in parts[-1]


def test_chunked_framing():
    assert warc.unchunked(warc.chunked(b"abc" * 9000)) == (b"abc" * 9000, True)
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == (b"abc", True)
    assert warc.unchunked(b"5\r\nabc")[1] is False and warc.unchunked(b"zz\r\n")[1] is False


# --- 10


def test_classifier(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(helpers.PROSE) for _ in range(80))
    bad = lambda: "$$$ ".join(str(rng.randrange(1000)) for _ in range(80))
    data = [(i, good() if i % 3 else bad()) for i in range(600)] + [(None, good()), (700, None), (701, "")]
    docs = with_clashes(spark.createDataFrame(data, DOCS).drop("score"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(9999, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = compression_classifier.fit(docs, labels)
    scores = compression_classifier.score(docs, model).withColumn("held", compression_classifier.held_out(F.col("doc_id")))
    held = [r for r in scores.collect() if r.held and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 80 and all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held)
    assert all(0 <= r.score <= 1 for r in scores.collect())
    kept = compression_classifier.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id")) == rows(scores.filter("score >= 0.5").select("doc_id"))


def test_classifier_against_brute_force(spark):
    """Sample, pieces, dictionaries and differences as plain Python makes them; one document has several texts, some are long."""
    import zstandard

    rng = random.Random(3)
    good = lambda n: " ".join(rng.choice(helpers.PROSE) for _ in range(n))
    bad = lambda n: "$$$ ".join(str(rng.randrange(1000)) for _ in range(n))
    data = [(i, good(60 + 2000 * (i % 9 == 0)) if i % 3 else bad(60 + 4000 * (i % 9 == 0))) for i in range(200)] + [(4, good(90)), (6, bad(90)), (201, "")]
    labels = [(i, int(i % 3 > 0)) for i in range(200)] + [(7, 0), (10, 1)]
    model = compression_classifier.fit(spark.createDataFrame(data, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"), 40, 50)
    texts, trained = {}, {}
    for i, text in data:
        texts.setdefault(i, []).append(text.encode())
    for kind in (1, 0):
        ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 and (i % 3 > 0) == kind]
        ids = sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:40]
        cut = [(hashlib.md5(f"{i}|{k}".encode()).digest(), t[k : k + 4096]) for i in ids[:28] for t in texts[i] for k in range(0, len(t), 4096)]
        trained[kind] = compression_classifier._dictionary([p for _, p in sorted(cut)[:50]])
    assert (model.good, model.bad) == (trained[1], trained[0])

    def size(text, dictionary):
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False)
        return sum(len(pack.compress(text[k : k + 4096])) for k in range(0, len(text), 4096))

    scored = compression_classifier.score(spark.createDataFrame(data, DOCS), model).collect()
    expected = []
    for i, text in data:
        g, b = size(text.encode(), model.good), size(text.encode(), model.bad)
        d = (b - g) / (b + g) if text else 0.0
        expected.append((i, round(d, 12), round(1 / (1 + math.exp(-(model.slope * d + model.offset))), 9)))
    assert sorted((r.doc_id, round(r.difference, 12), round(r.score, 9)) for r in scored) == sorted(expected)


def test_bad_text_behind_a_good_start(spark):
    """A long text is learned and scored whole: bad text after many good bytes makes it worse."""
    rng = random.Random(5)
    good = lambda n: " ".join(rng.choice(helpers.PROSE) for _ in range(n))
    bad = lambda n: "$$$ ".join(str(rng.randrange(1000)) for _ in range(n))
    data = [(i, good(7000) if i % 2 else f"{good(3500)} {bad(4500)}") for i in range(120)]
    docs = spark.createDataFrame(data, DOCS)
    model = compression_classifier.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int"))
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in compression_classifier.score(docs, model).collect())


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], DOCS)
    model = compression_classifier.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in compression_classifier.score(docs, model).collect()] == [0.5, 0.5]
    assert compression_classifier.keep_good(docs, model).count() == 2


# --- empty tables


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = shared_path(spark, "test-empty")
    warc.write_archive(pages, path)
    for df in (
        decontamination.decontaminate(docs, bench),
        mixing.mix_sources(docs),
        jaccard_join.jaccard_classes(docs),
        html_extraction.extract_main_text(pages),
        substring_dedup.dedup_substrings(docs),
        quality_rules.judge(docs),
        chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        warc.reassemble(warc.read_records(spark, path)),
        url_filters.filter_urls(pages, spark.createDataFrame([], "url string, bad boolean"), RULES),
    ):
        assert df.count() == 0
    one = spark.createDataFrame([(1, "some text", "en", "s")], docs.schema)
    assert decontamination.decontaminate(one, bench).first().n_hit == 0
