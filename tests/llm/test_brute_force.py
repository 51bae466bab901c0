"""The ten operators against brute force, exact round trips or held-out rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from jobatlas.llm import chat, components, decontaminate, langid, mixing, quality, queries, simhash, sitetree, substring, syncmers, warc

SMOKE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SMOKE).collect()


# -- 1 ------------------------------------------------------------------------------------

def test_language_id_is_right_on_held_out_rows(spark, corpus):
    got = rows(spark, "op1_language_id")
    assert {r.doc_id for r in got} == set(corpus) and len(got) == len(corpus)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert held and np.mean([r.lang_pred == corpus[r.doc_id].lang for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_codewords_are_distant():
    for n in (2, 3, 4, 5, 8, 30):
        code = langid.codewords(n)
        apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert apart >= (1 if n == 2 else 2 if n == 3 else 4)


def test_an_even_mix_of_two_languages_is_ambiguous():
    rng = np.random.default_rng(1)
    code = langid.codewords(2)
    model = langid.Model(["a", "b"], code, rng.normal(size=(langid.BUCKETS, 1)).astype(np.float32) * 0, np.ones((2, 1)), 1.0)
    assert model.predict("words") == ("a", 0.5, True)


# -- 2 ------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i % 7}", f"<p>{'x' * (i % 40)}</p>") for i in range(300)],
                                  "page_id long, url string, html string").repartition(5)
    last = {f"<p>{'x' * k}</p>": max(i for i in range(300) if i % 40 == k) for k in range(40)}
    for r in warc.round_trip(pages).collect():
        html = f"<p>{'x' * (r.page_id % 40)}</p>"
        assert r.payload_bytes == len(html) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if last[html] == r.page_id else ("revisit", last[html]))
    small = warc.round_trip(pages, min_bytes=20).collect()
    assert all(r.record_type == "response" for r in small if r.payload_bytes < 20)
    assert any(r.record_type == "revisit" for r in small)


def test_warc_reading_tasks_follow_the_records_bytes(spark):
    index = spark.createDataFrame([("a", 0, 100), ("a", 100, 60), ("b", 0, 41)], "archive string, offset long, length long")
    assert [warc.reading_tasks(index, b) for b in (10_000, 201, 200, 67, 66)] == [1, 1, 2, 3, 4]
    assert warc.reading_tasks(index.limit(0)) == 1


def test_warc_selected_records_by_joined_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "é" * i) for i in range(200)], "page_id long, url string, html string").coalesce(2)
    path = warc.write_archives(pages, str(tmp_path / "w"))
    index = warc.index_archives(spark, path).where("page_id % 3 = 0")
    for gap, size in ((0, 1), (1 << 20, 1 << 20), (100, 500)):
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(index, gap, size).collect()}
        assert got == {i: "é" * i for i in range(0, 200, 3)}


# -- 3 ------------------------------------------------------------------------------------

def words(t):
    return re.findall(r"\w+", (t or "").lower())


def slow_tiles(doc, item, k):
    """Greedy string tiling, word by word."""
    out, dm, im = [], set(), set()
    while True:
        best = []
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while (p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n]
                       and p + n not in dm and q + n not in im):
                    n += 1
                best.append((n, -p, -q))
        n, p, q = max(best, default=(0, 0, 0))
        if n < k:
            return out
        out.append((-p, -q, n))
        dm.update(range(-p, -p + n))
        im.update(range(-q, -q + n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=20), st.integers(2, 4))
def test_tiles_are_greedy(doc, item, k):
    fast = decontaminate.tiles(dict(enumerate(decontaminate.seeds(" ".join(doc), k)[1])),
                               decontaminate.seeds(" ".join(item), k)[1], k)
    assert sorted(fast) == sorted(slow_tiles(doc, item, k))


@pytest.mark.parametrize("local_seeds", [decontaminate.LOCAL_SEEDS, 0])
def test_reordered_leaks_are_found_and_others_left(spark, local_seeds):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(vocab) for _ in range(rng.randint(12, 40))] for i in range(20)}
    texts = {d: [rng.choice(vocab) for _ in range(120)] for d in range(60)}
    for d in range(0, 30):
        item = items[d % 20]
        half = len(item) // 2
        passage = {0: item, 1: item[half:] + ["gap"] + item[:half], 2: item[:half]}[d % 3]
        texts[d][40:40] = passage
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items.items()], "item_id long, text string")
    want = set()
    for d, w in texts.items():
        for i, item in items.items():
            if {tuple(w[p:p + 5]) for p in range(len(w) - 4)} & {tuple(item[p:p + 5]) for p in range(len(item) - 4)}:
                covered = sum(n for _, _, n in slow_tiles(w, item, 5))
                if covered >= 0.8 * len(item):
                    want.add((d, i, covered))
    found = decontaminate.leaks(docs, bench, local_seeds=local_seeds).collect()
    assert {(r.doc_id, r.item_id, r.n_covered) for r in found} == want and len(want) >= 20


@pytest.mark.parametrize("local_seeds", [decontaminate.LOCAL_SEEDS, 0])
def test_short_and_unspaced_items(spark, local_seeds):
    docs = spark.createDataFrame([
        (1, "So: Two plus, two? is four"), (2, "two and plus two"), (3, "他说，猫坐在垫子上。狗在睡觉。然后"), (4, "猫在"), (5, None),
        (6, "plus two plus two plus two"), (7, "答案是四")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two plus two ?"), (2, "猫坐在垫子上。狗在睡觉。"), (3, ""), (4, None), (5, "答案是"), (6, "?!")],
                                  "item_id long, text string")
    found = decontaminate.leaks(docs, bench, local_seeds=local_seeds).collect()
    assert {(r.doc_id, r.item_id, r.n_words, r.n_covered, r.coverage) for r in found} == {
        (1, 1, 3, 3, 1.0), (6, 1, 3, 3, 1.0), (3, 2, 10, 10, 1.0), (7, 5, 3, 3, 1.0)}
    assert len(found) == 4 and {r.tiles[0].doc_start for r in found if r.doc_id == 6} == {1}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 4, 5]


def test_benchmark_leaks_of_the_documents(spark, corpus):
    bench = spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()
    whole = {(d, b.item_id) for d, r in corpus.items() for b in bench
             if " " + " ".join(words(b.text)) + " " in " " + " ".join(words(r.text)) + " "}
    assert whole <= {(r.doc_id, r.item_id) for r in rows(spark, "op3_benchmark_decontamination")}


# -- 4 ------------------------------------------------------------------------------------

def test_template_branches_without_a_telling_name_are_cut_by_the_site_tree(spark):
    def page(i, n=9):
        rng = random.Random(i)
        body = "".join(f"<p>{' '.join(rng.choice('abcdefgh') * 3 for _ in range(12))} {i}</p>" for _ in range(1 + i % 4))
        return (i, f"http://one.example/{i}", "<html><body><div class='top'><p>Site name</p><p>Slogan of it</p></div>"
                f"<div class='text'>{body}</div><div class=low><p>Made by us</p></div></body></html>")
    rows_ = [page(i) for i in range(9)] + [(100, "http://two.example/", "<div class='top'><p>Site name</p></div>")]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()}
    for i, _, html in rows_[:9]:
        assert got[i] == "\n\n".join(re.findall(r"<p>([^<]*\d)</p>", html))
    assert got[100] == "Site name"  # one page says nothing about its site


def test_the_site_tree_judges_inside_and_beside_article(spark):
    def page(i, body):
        return (i, f"http://one.example/{i}", f"<body><div class=lead><p>Lead {body}</p></div><div class=low><p>Made by us</p></div>"
                f"<article><p>Body {body}</p><div class=box><p>Read on in our app</p></div></article></body>")
    pages_ = [page(i, f"text {i}") for i in range(9)] + [page(i, "copied") for i in range(100, 140)]
    df = spark.createDataFrame(pages_ + [(200, "http://two.example/", "<div><p>All of it</p></div><article><p>Teaser</p></article>")],
                               "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitetree.extract(df).collect()}
    want = {i: f"Lead text {i}\n\nBody text {i}" for i in range(9)} | {i: "Lead copied\n\nBody copied" for i in range(100, 140)}
    assert got == want | {200: "All of it\n\nTeaser"}


@pytest.mark.parametrize("html, text", [
    ("<nav>menu</nav><article><h1>T &amp; t</h1><p>one <b>two</b>\n three<p>four<br>five</article><footer>f</footer>",
     "T & t\n\none two three\n\nfour five"),
    ("<header>h</header><main><p>a</p><aside>s</aside><form>f<input></form><div class='ad-box ads'>x</div>b</main>", "a\n\nb"),
    ("<article><header><h1>Title</h1></header><p>x</p><div id=comments><p>c</p></div></article>", "Title\n\nx"),
    ("<body><script>var a='</p>';</script><style>p{}</style><p>text &lt;b&gt; &#233;&nbsp;z</p><!-- c --></body>", "text <b> é z"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><p>cut of", "a\n\nb\n\n1 2\n\n3\n\ncut of"),
    ("<article><p>end</p></arti", "end"),
    ("<div role=navigation>n</div><div hidden>h</div><p title='a>b'>p</p>", "p"),
    ("a < b and c", "a < b and c"), ("", ""), ("<", "<"), ("<p", "")])
def test_markup(html, text):
    assert sitetree.main_text(html, None) == text


@pytest.mark.parametrize("html, text", [
    ("<div class='content no-sidebar'><p>body</p></div>", "body"),
    ("<div id=page-with-menu><article><p>body</p></article></div>", "body"),
    ("<article class='post comments-open'><p>body</p></article><nav>n</nav>", "body"),
    ("<article class='post comments'><p>long body</p><div class=comments><p>c</p></div></article>", "long body"),
    ("<form action=x><div class=menu>m</div><p>whole body of the page</p></form>", "whole body of the page"),
    ("<div class=widget><main><p>b</p></main></div><div class=comments><p>much longer remarks</p></div>", "b"),
    ("<div class='related work'><article><p>body</p></article><div class=ad>a longer advert</div></div>", "body"),
    ("<article><p>b</p></article><div class=comments><article>much longer remarks</article></div>", "b"),
    ("<div class=sidebar-layout><article><p>body</p></article></div><div class=site-footer>a much, much longer imprint</div>", "body"),
    ("<p>the body of it</p><div class=related-posts><article>a card</article></div>", "the body of it"),
    ("<div class=page-sidebar-left><p>whole body</p><div class=menu>m</div></div>", "whole body"),
    ("<p>more than that</p><div class='share-price has-menu'><p>price</p></div><p class=related-work>work</p>",
     "more than that\n\nprice\n\nwork"),
    ("<article class='post comments-list'><pre>x <span class=hl-comment>y</span></pre></article>", "x y")])
def test_names_of_wrappers_do_not_take_the_body(html, text):
    assert sitetree.main_text(html, None) == text


@pytest.mark.parametrize("n", [1, 12])
def test_page_parts_of_hyphenated_names_go_on_any_host(spark, n):
    def page(i):
        return (i, f"http://h{n}.example/{i}", "<div class=site-header><p>Site of all</p></div><div class=cookie-notice>We set cookies</div>"
                f"<article><h1>Story {i}</h1><p>Body of the story {i} as told</p><div class=relatedPosts><p>See also story {i + 1}</p></div></article>"
                f"<section id=comments-area><article class=comment-body><p>user{i} says: so many more words than all of the story has, "
                f"and {i} more</p></article></section><div class=related-posts><article><p>Card {i}</p></article></div>"
                "<div class='l-share-buttons share-buttons'>Tell a friend</div><div class=site-footer>Imprint</div>")
    df = spark.createDataFrame([page(i) for i in range(n)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in sitetree.extract(df).collect()} == {
        i: f"Story {i}\n\nBody of the story {i} as told" for i in range(n)}


def test_importance_is_the_entropy_over_a_host(spark):
    rng = random.Random(5)
    htmls = [f"<div class=top><p>Site</p></div><div class=text>{'<p>a %d</p>' % rng.randrange(4) * rng.randrange(1, 4)}"
             f"{'<ul><li>x</ul>' * rng.randrange(2)}</div>" for _ in range(30)]
    # Pages with the same texts are one page.
    pages_ = {tuple(t for _, _, t in sitetree.blocks(h)): sitetree.blocks(h) for h in htmls}.values()
    layouts, texts = {}, {}
    for found in pages_:
        seen = {}
        for path, _, words_ in found:
            for i in range(1, len(path) + 1):
                kids = seen.setdefault(path[:i], ([], set()))
                child = path[i] if i < len(path) else "#text"
                if kids[0][-1:] != [child]:
                    kids[0].append(child)
                kids[1].add(words_)
        for node, (kids, words_) in seen.items():
            layouts.setdefault(node, []).append(tuple(kids))
            texts.setdefault(node, []).append(words_)
    want = {}
    for node, kids in layouts.items():
        n = len(kids)
        if n < 2:
            want[">".join(node)] = 1.0
            continue
        shares = [kids.count(k) / n for k in set(kids)]
        form = -sum(p * math.log(p, n) for p in shares)
        on = [sum(t in w for w in texts[node]) for t in set().union(*texts[node])]
        content = 1 - sum(math.log(c, n) for c in on) / len(on)
        share = sitetree.DECAY ** len(shares)
        want[">".join(node)] = (1 - share) * form + share * max(0.0, content)
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    got = {r.node: r.importance for r in sitetree.importance(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_many_open_brackets_stay_quick():
    assert sitetree.main_text("<a " * 50_000 + "x", None) == ""
    sitetree.main_text('<a "' * 20_000 + ">", None)


# -- 5 ------------------------------------------------------------------------------------

def slow_simhash(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def slow_components(fps, bits):
    ids, root = list(fps), {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_of_the_documents(spark, corpus):
    fps = {d: slow_simhash(r.text) for d, r in corpus.items()}
    comps = slow_components(fps, 2)
    got = rows(spark, "op5_simhash_near_dedup")
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", comps[d]) for d, f in fps.items()}
    assert len(got) == len(corpus)


@pytest.mark.parametrize("bits, segments, dense", [(2, 2, 256), (2, 2, 1), (1, 2, 3), (3, 4, 256), (2, 3, 2), (0, 1, 256)])
def test_links_have_the_closure_of_all_pairs(spark, bits, segments, dense):
    rng = random.Random(bits * 7 + segments)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(12)} | set(seeds))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = components.connected_components(simhash.links(table, bits, segments, dense)).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.root].add(r.node)
    want = defaultdict(set)
    for f, c in slow_components({f: f for f in fps}, bits).items():
        want[c].add(signed(f))
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.root].add(r.node)
    assert sorted(map(len, groups.values())) == [2, 50, 201] and sum(map(len, groups.values())) == len(found)


# -- 6 ------------------------------------------------------------------------------------

def test_quality_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few held-out labels
    got = {r.doc_id: r for r in queries.QUERIES["op6_quality"](spark, sf).collect()}
    marks = [(r.quality, got[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = [s for q, s in marks if q], [s for q, s in marks if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_isotonic_pools_violators():
    at, p = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert list(p) == [0, 0.5, 1] and list(at) == [0, 1.5, 3.5]


def test_sums_over_partitions_are_whole(spark):
    df = spark.range(1000).selectExpr("array(double(id), 1.0) x").repartition(7)
    total = quality._sum_rows(df, lambda b: quality._matrix(b.column(0)).sum(axis=0)[None, :], 2, 1)
    assert total.tolist() == [[499500.0, 1000.0]]


# -- 7 ------------------------------------------------------------------------------------

@pytest.mark.parametrize("local_bytes", [mixing.BROADCAST_BYTES, 0])
def test_raking_meets_the_targets(spark, local_bytes):
    rng = random.Random(5)
    cells = [(s, lang, t, rng.randint(1, 1000)) for s in "abc" for lang in ("en", None) for t in "xyz"]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goals = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.7, None: 0.3}, "topic": {"x": 1.0, "y": 1.0, "z": 2.0}}
    tables = {m: spark.createDataFrame(list(g.items()), "level string, share double") for m, g in goals.items()}
    got = mixing.rake(df, tables, tolerance=1e-9, local_bytes=local_bytes).collect()
    w = np.array([c[3] for c in cells], float)
    place = {c[:3]: i for i, c in enumerate(cells)}
    for _ in range(200):
        for k, m in enumerate(goals):
            total = sum(goals[m].values())
            for level, share in goals[m].items():
                at = [i for i, c in enumerate(cells) if c[k] == level]
                w[at] *= share / total / w[at].sum()
    for r in got:
        assert r.tokens * r.rate == pytest.approx(w[place[r.source, r.lang, r.topic]], rel=1e-6)


def test_mix_draws_by_the_rates(spark, corpus):
    got = rows(spark, "op7_mixing")
    assert {r.doc_id for r in got} <= set(corpus) and len({r.doc_id for r in got}) == len(got)
    assert all((r.tokens, int(r.topic[1:])) == mixing.describe(corpus[r.doc_id].text) for r in got)
    assert {(r.doc_id, r.probability) for r in rows(spark, "op7_mixing")} == {(r.doc_id, r.probability) for r in got}
    everything = mixing.probabilities(mixing.with_cells(spark.read.parquet(f"{SMOKE}/documents.parquet"))).collect()
    expected = sum(r.probability for r in everything)
    assert max(r.probability for r in everything) == 1
    assert abs(len(got) - expected) < 5 * np.sqrt(sum(r.probability * (1 - r.probability) for r in everything)) + 1
    mass = defaultdict(float)
    for r in everything:
        mass[r.lang] += r.tokens * r.probability * r.weight
    share = defaultdict(int)
    for r in everything:
        share[r.lang] += r.tokens
    for lang in mass:
        want = share[lang] ** 0.5 / sum(x ** 0.5 for x in share.values())
        assert mass[lang] / sum(mass.values()) == pytest.approx(want, abs=1e-4)


def test_a_rare_cell_does_not_decide_the_size_of_the_mix(spark):
    cells = [(i, "w " * 200, "web" if i % 2 else "wiki", "en" if i // 2 % 2 else "de", f"t{i // 4 % 2}") for i in range(600)]
    given = cells + [(1000, "w " * 40, "web", "xx", "t0"), (1001, "", "none", "yy", "t1")]
    docs = mixing.with_cells(spark.createDataFrame(given, "doc_id long, text string, source string, lang string, topic string"))
    got = mixing.probabilities(docs).collect()
    total = sum(r.tokens for r in got)
    mass = {m: defaultdict(float) for m in mixing.MARGINS}
    given = {m: defaultdict(int) for m in mixing.MARGINS}
    for r in got:
        assert 0 <= r.probability <= 1 and r.weight >= 1 and (r.weight == 1 or r.probability == 1)
        for m in mixing.MARGINS:
            mass[m][r[m]] += r.tokens * r.probability * r.weight
            given[m][r[m]] += r.tokens
    assert sum(r.tokens * r.probability for r in got) > 0.3 * total
    assert sum(mass["lang"].values()) == pytest.approx(mixing.TOKEN_SHARE * total, rel=1e-4)
    for m in mixing.MARGINS:
        for level in mass[m]:
            want = given[m][level] ** 0.5 / sum(x ** 0.5 for x in given[m].values())
            assert mass[m][level] / sum(mass[m].values()) == pytest.approx(want, abs=2e-4 + got[0].gap)
    assert got[0].gap < 1e-5 and [r.weight for r in got if r.doc_id == 1001] == [1]


def test_raking_tells_the_gap_of_targets_that_contradict_each_other(spark):
    cells = spark.createDataFrame([("a", "en", "x", 10), ("b", "de", "x", 10)], "source string, lang string, topic string, tokens long")
    goals = {"source": [("a", 0.9), ("b", 0.1)], "lang": [("en", 0.5), ("de", 0.5)]}
    tables = {m: spark.createDataFrame(g, "level string, share double") for m, g in goals.items()}
    both = [mixing.rake(cells, tables, sweeps=30, local_bytes=b).collect() for b in (mixing.BROADCAST_BYTES, 0)]
    assert [{round(r.gap, 6) for r in got} for got in both] == [{0.4}] * 2
    assert [sorted((r.source, round(r.rate, 9)) for r in got) for got in both] == [[("a", 0.05), ("b", 0.05)]] * 2


def test_mixing_takes_few_jobs_whatever_the_sweeps(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    sc = spark.sparkContext
    sc.setJobGroup("mixing-jobs", "")
    try:
        first = sorted((r.doc_id, r.probability, r.weight) for r in mixing.mix(docs).collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert first and len(sc.statusTracker().getJobIdsForGroup("mixing-jobs")) < 30


# -- 8 ------------------------------------------------------------------------------------

def slow_kept(texts, window):
    least, out = {}, {}
    split = {d: WORD.findall(t or "") for d, t in texts.items()}
    for d in sorted(split):
        for p in range(len(split[d]) - window + 1):
            least.setdefault(tuple(split[d][p:p + window]), d)
    for d, w in split.items():
        gone = {i for p in range(len(w) - window + 1) if least[tuple(w[p:p + window])] < d for i in range(p, p + window)}
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return split, out


@pytest.mark.parametrize("group", [substring.GROUP_SPANS, 2])
@pytest.mark.parametrize("window, prefix", [(6, 2), (5, 5), (4, 1)])
def test_repeated_windows_go(spark, window, prefix, group):
    rng = random.Random(window)
    texts = {}
    for d in range(150):
        w = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 40))]
        if d % 3 == 0 and texts:
            other = texts[rng.choice(list(texts))].split()
            w[5:5] = other[rng.randint(0, 5):rng.randint(5, 40)]
        texts[d] = rng.choice([" ", "\n", " \t"]).join(w)
    texts[150] = texts[149]
    split, kept = slow_kept(texts, window)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for r in substring.remove_repeats(df, window, prefix, group).collect():
        assert (r.n_words, r.n_removed, r.kept_text) == (
            len(split[r.doc_id]), len(split[r.doc_id]) - len(kept[r.doc_id]), " ".join(kept[r.doc_id]))


def test_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring, "PART", 16)
    run = substring._file(5, 2)
    import pyarrow as pa
    text = " ".join(f"w{i % 11}" for i in range(100)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1], pa.int32()), pa.array([text.decode()])], names=["id", "tag", "text"])
    spans = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert sorted(p for r in spans for p in range(r["first"], r["first"] + r["n"])) == list(range(96))


def test_suffix_trees_hold_every_common_prefix():
    rng = random.Random(8)
    for _ in range(50):
        symbols = []
        for t in range(rng.randint(1, 8)):
            symbols += [rng.randint(0, 2) for _ in range(rng.randint(0, 30))] + [-1 - t]
        array, common = substring._suffix_tree(np.array(symbols, np.int64), 31)
        slow = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        assert array.tolist() == slow
        for i in range(1, len(slow)):
            a, b = symbols[slow[i - 1]:], symbols[slow[i]:]
            assert common[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_deep_nodes_give_maximal_repeats():
    a, b = b"x a b c d e f y".split(), b"p a b c d e f q b c d e".split()
    got = substring._maximal_repeats([[(1, 0, b" ".join(a)), (2, 0, b" ".join(b))], [(3, 0, b" ".join(a))]], 4)
    # The six common words once, not again from their second word on; the later four on their own; no group sees another's.
    assert sorted(got) == [(0, 1, 1, 3), (0, 1, 8, 1)]


def test_a_text_that_repeats_itself_loads_no_group(spark):
    line = [f"w{i}" for i in range(30)]
    texts = {1: " ".join(line * 3), 2: " ".join(line * 33_000), 3: " ".join(["z", *line * 2, "z"])}
    split, kept = slow_kept({1: texts[1], 3: texts[3]}, 20)
    out = {r.doc_id: r for r in substring.remove_repeats(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 20, 6, 50).collect()}
    assert (out[1].n_removed, out[2].n_removed, out[2].kept_text) == (0, 990_000, "")
    assert out[3].kept_text == " ".join(kept[3]) == "z z"
    spans = spark.createDataFrame([(i, 7, 64 * i, 64, 5, 9) for i in [2] * 40 + [1]], substring._SPAN)
    assert {(r.id, r.spans, r.settled) for r in substring._met(spans).collect()} == {(2, None, True)}


def test_substring_of_the_documents(spark, corpus):
    split, kept = slow_kept({d: r.text for d, r in corpus.items()}, 50)
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op8_substring_dedup")}
    assert got == {(d, len(w), len(w) - len(kept[d]), hashlib.sha256(" ".join(kept[d]).encode()).hexdigest()) for d, w in split.items()}


# -- 9 ------------------------------------------------------------------------------------

def slow_anchors(text, k, s):
    """Places of the closed syncmers, k-mer by k-mer."""
    c = syncmers._points(text).astype(np.uint64) + np.uint64(1)
    out = []
    with np.errstate(over="ignore"):
        for i in range(len(c) - k + 1):
            h = []
            for j in range(i, i + k - s + 1):
                x = np.uint64(0)
                for y in c[j:j + s]:
                    x = x * syncmers._BASE + y
                h.append(int(syncmers._mixed(np.array([x]))[0]))
            if min(h) in (h[0], h[-1]):
                out.append(i)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcdé", max_size=60), min_size=1, max_size=4))
def test_anchors_are_closed_syncmers(texts):
    for t, (at, _) in zip(texts, syncmers.anchors(texts, 8, 3)):
        assert at.tolist() == slow_anchors(t, 8, 3)


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=80), st.text("abcd", max_size=80))
def test_edited_anchors_need_no_second_look(text, nxt):
    own, other = syncmers.anchors([text, nxt], 8, 3)
    changed, hashes = syncmers.edited(text, nxt, own, other, 8, 3)
    assert changed == text[:len(text) - len(text) // 2] + nxt[:len(text) // 2]
    assert hashes.tolist() == syncmers.anchors([changed], 8, 3)[0][1].tolist()


def test_long_texts_go_in_blocks(monkeypatch):
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(5000))
    whole = syncmers.anchors([text])[0]
    monkeypatch.setattr(syncmers, "BLOCK", 700)
    parts = syncmers.anchors(["x", text, "y"])[1]
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_fingerprints_of_the_documents(spark, corpus):
    ids = sorted(corpus)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    got = {r.doc_id: r for r in rows(spark, "op9_syncmer_fingerprints")}
    assert set(got) == set(ids)
    for d, r in got.items():
        text, nxt = corpus[d].text or "", corpus[after[d]].text or ""
        changed = text[:len(text) - len(text) // 2] + nxt[:len(text) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        want = [syncmers.to_hex(syncmers._or_whole(h, t)) for t, (_, h) in zip((text, changed), syncmers.anchors([text, changed]))]
        assert [r.fingerprint, r.edited_fingerprint] == want
    assert np.mean([r.near_edited for r in got.values()]) > 0.4 and np.mean([r.near_next for r in got.values()]) < 0.05


def test_every_edited_text_is_nearer_than_the_next_one(spark, corpus):
    texts = [r.text for _, r in sorted(corpus.items())]
    cuts = [t[:n] for n, t in zip(range(2, 200), texts)]
    for text, nxt in zip(cuts, texts[7:] + texts[:7]):
        own, other = syncmers.anchors([text, nxt])
        changed, hashes = syncmers.edited(text, nxt, own, other)
        a, b, c = (syncmers._or_whole(h, t) for h, t in ((own[1], text), (hashes, changed), (other[1], nxt)))
        assert syncmers.likeness(a, b) > syncmers.likeness(a, c), text
    after = dict(zip(sorted(corpus), sorted(corpus)[1:] + sorted(corpus)[:1]))
    for r in rows(spark, "op9_syncmer_fingerprints"):
        assert r.near_edited > r.near_next or corpus[r.doc_id].text == corpus[after[r.doc_id]].text


# -- 10 -----------------------------------------------------------------------------------

@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n\nb", "\\"]),
                          st.text("<|im_end>\\ \n" + "sep", max_size=12) | st.sampled_from([chat.START, chat.END, chat.SEP, "<\\|", "<\\\\|"])),
                min_size=1, max_size=6))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    back = chat.parse_chats(made).first()
    assert [tuple(t) for t in back.turns] == turns
    assert back.loss_text == "".join(t for r, t in turns if r == "assistant")
    blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
    assert back.formatted.count(chat.START) == back.formatted.count(chat.END) == blocks
