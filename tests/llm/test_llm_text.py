"""Operators with Python tasks against plain Python, round trips and held-out accuracy."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formloom.llm import decontam, html, jaccard, pii, quality, queries, secrets, tokens
from formloom.llm.wavelet import WaveletMatrix

DATA = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---- quality classifier ----------------------------------------------------
def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    said = [(0.9, 0.95), (0.6, 0.99), (0.8, 0.9)]
    votes = np.stack([np.where(truth, rng.random(20000) < g, rng.random(20000) >= b).astype(int) for b, g in said], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, share, table = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05
    for h, (b, g) in enumerate(said):
        assert abs(table[h, quality.GOOD, quality.GOOD] - g) < 0.05 and abs(table[h, quality.BAD, quality.BAD] - b) < 0.1
    assert ((post >= 0.5) == (patterns.sum(axis=1) >= 2)).mean() > 0.7


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(docs).join(labels, "doc_id").select("keep", "quality").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [not r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.9


def test_classifier_odd_rows(odd_docs, no_docs):
    rows = {(r.doc_id, r.n_words): r for r in quality.judged(odd_docs).collect()}
    assert not rows[2, 0].keep and not rows[3, 0].keep and rows[2, 0].votes == "2" * 8
    assert quality.kept(odd_docs).columns == odd_docs.columns
    assert quality.judged(no_docs).count() == 0 and quality.kept(no_docs).count() == 0


# ---- Jaccard join ----------------------------------------------------------
def brute_links(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(texts)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if texts[a] != texts[b] and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("bucket", [400, 6])
def test_links_by_brute_force(spark, monkeypatch, bucket):
    """With buckets of 6 sets the trees split, and crowds go through blocks."""
    monkeypatch.setattr(jaccard, "BUCKET_SETS", bucket)
    rng = random.Random(11)
    texts, n = {}, 0
    common = words(rng, 25)
    for _ in range(14):
        base = words(rng, rng.randint(3, 90))
        for _ in range(rng.choice([1, 2, 5, 16])):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            if rng.random() < 0.4:
                w = w + common
            texts[n] = " ".join(w)
            n += 1
    texts |= {n: "", n + 1: "", n + 2: "one", n + 3: "one", n + 4: "ONE two", n + 5: "one two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    links = brute_links(texts)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in [*links, *((a, b) for a in texts for b in texts if a < b and texts[a] == texts[b])]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for i in texts:
        copies = [j for j in texts if texts[j] == texts[i]]
        near = {b if a == i else a for a, b in links if i in (a, b)}
        assert got[i].class_id == find(i) and got[i].copy_id == min(copies)
        assert got[i].n_links == len(near) + len(copies) - 1 and got[i].n_text_links == len({texts[j] for j in near})
    kept = sorted(r.doc_id for r in jaccard.first_of_each_group(docs).collect())
    assert kept == sorted({find(i) for i in texts})


def test_join_odd_rows(odd_docs, no_docs):
    assert jaccard.near_duplicates(odd_docs).count() == 9
    kept = jaccard.first_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 1), (False, 2), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.first_of_each_group(no_docs).count() == 0


def test_near_copies_without_ids(spark):
    rng = random.Random(21)
    base = words(rng, 60)
    near = lambda w, i: " ".join(w[:-1] + [f"x{i}"])
    other, third = words(rng, 60), words(rng, 60)
    rows = [(None, near(base, 0)), (None, near(base, 0)), (7, near(base, 1)), (9, near(base, 2)), (None, near(other, 0)), (None, near(other, 1)), (3, " ".join(third))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_text_links, r.n_links, r.doc_id or 0, r.class_id or 0) for r in jaccard.near_duplicates(docs).collect())
    assert got == [(0, 0, 3, 3), (1, 1, 0, 0), (1, 1, 0, 0), (2, 3, 0, 7), (2, 3, 0, 7), (2, 3, 7, 7), (2, 3, 9, 7)]
    kept = jaccard.first_of_each_group(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 3, 7] and sum(r.text in (rows[4][1], rows[5][1]) for r in kept) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500


# ---- secrets ---------------------------------------------------------------
def test_base_secrets_as_stated():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def plain(t):
        f = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        f += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        f += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return [(a, b, secrets.KINDS[k]) for a, k, b in sorted(f)]

    rng = random.Random(2)
    parts = ["password", "TOKEN", "ſecret", "api_key", "apikey", " = ", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", " ", "\n", "é", "x", "hunter2!"]
    for _ in range(20000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert secrets.base_spans(t) == plain(t)


def test_automata_tell_formats_apart():
    rng = random.Random(7)
    keys = ["AB" + "".join(rng.choices("0123456789", k=10)) + "xyz" for _ in range(300)]
    a = secrets.Automaton(keys)
    assert 2 < len(a.states) < 40
    assert a.score("AB0123456789xyz".translate(secrets.CLASSES)) > a.score("zz0123456789zAB".translate(secrets.CLASSES)) + 5
    total = sum(2 ** a.score(s) for s in ("", "d", "h"))
    assert total < 0.5


def test_secret_scan_adds_formats(spark, odd_docs, no_docs):
    rng = random.Random(1)
    talk = lambda: " ".join("".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(2, 9))) for _ in range(40))
    rows = [(i, f"{talk()} token = {''.join(rng.choices('0123456789abcdef', k=32))} {talk()}") for i in range(200)]
    rows += [(1000, "see 9f8e7d6c5b4a3210aa here"), (1001, "an internationalization2go word"), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[5].n_assign == 1 and got[5].n_hex == 1 and got[5].n_form == 0
    assert got[1000].n_form == 1 and got[1000].spans == "form:4:22"
    assert got[1001].n_form == 0 and got[1002].spans == ""
    assert secrets.scan(odd_docs).count() == 9 and secrets.scan(no_docs).count() == 0


def plain_overlaps(docs, items):
    """All overlaps by the stated rule, over every alignment of every text with every item."""
    bare = lambda t: [w for w in (re.sub(r"[^\w]|_", "", x.lower()) for x in (t or "").split()) if w]
    out = set()
    for d, text in docs:
        a = bare(text)
        for i, item in items:
            b, found = bare(item), []
            if not b:
                continue
            for first in range(1 - len(b), len(a)):
                lo, hi = max(first, 0), min(first + len(b), len(a))
                same = np.array([a[k] == b[k - first] for k in range(lo, hi)], bool)
                if len(b) < decontam.LEAST_ITEM:
                    found += [(len(b), lo, hi)] if len(same) == len(b) and same.all() else []
                    continue
                least = min(decontam.MIN_MATCHED, -int(-decontam.SHORT_SHARE * len(b) // 1))
                for x, y in decontam._best_runs(same):
                    n = int(same[x:y].sum())
                    if n >= least and n >= decontam.DENSITY * (y - x):
                        found.append((n, lo + x, lo + y))
            if found:
                n, x, y = min(found, key=lambda f: (-f[0], f[1]))
                out.add((d, i, x, y, n))
    return out


def test_decontamination_query_by_brute_force(spark, tmp_path):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(say(rng.choice([1, 3, 7, 8, 13, 15, 18, 25, 40])))) for i in range(40)] + [(50, None), (51, ""), (None, "no id of its own at all here"), (3, "another text under one id that is long")]
    docs = []
    for d in range(80):
        words = say(rng.randint(0, 60))
        item = rng.choice(items)[1]
        if item:
            said = [w if rng.random() > 0.12 else "other" for w in item.split()]
            cut = rng.randint(0, len(words))
            words = words[:cut] + said + words[cut:]
        docs.append((d, " ".join(words)))
    docs += [(90, None), (91, ""), (None, items[4][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_overlaps(docs, items)
    got = queries.QUERIES["op7_decontamination"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(want) > 60
    d, b = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "benchmark"))
    assert {tuple(r) for r in decontam.overlaps(d, b, chunk_words=100).collect()} == want
    kept = decontam.without_overlaps(d, b).collect()
    assert sorted(repr(r.doc_id) for r in kept) == sorted(repr(x) for x, _ in docs if x not in {w[0] for w in want})


def test_short_items_always_have_a_seed():
    for n, k in ((8, 2), (13, 3), (14, 4), (17, 5)):
        for lost in itertools.combinations(range(n), k):
            same = np.ones(n, bool)
            same[list(lost)] = False
            least = min(decontam.MIN_MATCHED, -int(-decontam.SHORT_SHARE * n // 1))
            if any(same[x:y].sum() >= max(least, decontam.DENSITY * (y - x)) for x, y in decontam._best_runs(same)):
                assert any(all(same[s + i] for i, c in enumerate(m) if c == "1") for m in (*decontam.MASKS, *decontam.SHORT_MASKS) for s in range(n - len(m) + 1)), (n, lost)


def test_first_of_each_group_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 7, "k"), (2, "a b c d e f g", 8, "l"), (3, "other text of its own here", 9, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _key string")
    assert sorted(map(tuple, jaccard.first_of_each_group(df).collect())) == [rows[0], rows[2]]


def test_long_words_keep_their_whole_shape():
    assert pii.shape("a1" * 30) != pii.shape("a1" * 29 + "b-") and pii.shape("Ab12345") == "Aa0000"


# ---- html ------------------------------------------------------------------
def page(article, menu="a"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>{menu}</ul></nav>{article}<footer>&copy; x</footer></body></html>"


def test_article_text():
    body = "<article><h1>A &amp; B</h1><p><b>bold\n  text<br><p>next&nbsp;one <i>in</i>line</p><div class='ad'>buy</div><script>x='</p>'</script><form><p>mail</p></form>loose<ul><li>x<li>y</ul></article>"
    assert html.extract(page(body), {}) == "A & B\nbold text\nnext one inline\nloose\nx\ny"
    assert html.extract(None, {}) == "" and html.extract("", {}) == "" and html.extract("<p>only", {}) == "only"
    assert html.extract("<div>" * 5000 + "deep", {}) == "deep"


def test_furniture_by_whole_names():
    for kind in ("class='has-sidebar'", "class='no-sidebar'", "class=search", "id=header", "hidden", "style='display:none'"):
        assert html.extract(f"<html><body {kind}><p>one</p></body></html>", {}) == "one"
    for kind in ("id='related-work'", "id='search-algorithms'", "id=search", "class='header-image'", "class='content-with-sidebar'", "title='The Hidden Fortress'", "data-id=sidebar", "data-hidden=1"):
        for tag in ("h2", "div"):
            assert html.extract(page(f"<article><{tag} {kind}>kept</{tag}><p>text</p></article>"), {}) == "kept\ntext"
    for kind in ("class='box sidebar'", "role=navigation", "hidden", "HIDDEN=''", "style='color:red; display : none'"):
        assert html.extract(page(f"<article><div {kind}>gone</div><p>text</p></article>"), {}) == "text"
    drawn = "<article><p>a</p><svg width='1' a=\">\"/><p>b</p><svg><path d='x'/></svg><p>c</p></article>"
    assert html.extract(page(drawn), {}) == "a\nb\nc"


def test_furniture_by_constant_ids():
    make = lambda i: page(f"<article><div id=share>share this</div><section id=search><h2>search {i}</h2></section><p>text {i}</p></article>")
    pages = [make(i) for i in range(5)]
    assert html.extract(pages[1], html.induce(pages)) == "search 1\ntext 1"


def test_wrapper_without_marks():
    rng = random.Random(3)
    make = lambda: f"<html><body><div id=top>Site name</div><table><tr><td>Always here<td><div class=x><span>By us</span>{''.join(f'<p>{chr(32).join(words(rng, 9))}</p>' for _ in range(rng.randint(2, 5)))}</div></table><div id=end>All rights</div></body></html>"
    pages = [make() for _ in range(5)]
    wrapper = html.induce(pages)
    assert wrapper["path"][-1] == "div.x"
    text = html.extract(pages[0], wrapper)
    assert "By us" not in text and "Site" not in text and "Always" not in text
    assert text.count("\n") + 1 == pages[0].count("<p>")


def test_wrapper_keeps_all_slots():
    rng = random.Random(5)
    said = lambda n: " ".join(words(rng, n))
    make = lambda body: f"<html><body><div id=top>Site name</div><div class=all>{body}</div><p>All <b>rights</b> kept</p></body></html>"
    titled = [make(f"<h1>{said(2)}</h1><div class=body><p>{said(90)}</p><p>{said(60)}</p></div>") for _ in range(5)]
    one_paragraph = [make(f"<p><span>{said(200)}</span></p>")] + [make(f"<h2>{said(3)}</h2><p><span>{said(60)}</span></p><ul><li>{said(4)}</ul><table><tr><td>{said(5)}</table>") for _ in range(4)]
    for pages in (titled, sorted(one_paragraph), one_paragraph[1:]):
        wrapper = html.induce(pages)
        assert wrapper["path"][-1] == "div.all"
        for p in one_paragraph + titled if pages is not titled else titled:
            inner = re.search("<div class=all>(.*)</div><p>All", p)[1]
            assert html.extract(p, wrapper).split() == re.sub("<[^>]*>", " ", inner).split()
    beside = titled[0].replace("<div class=all>", "<div class=lead>A lead of its own</div><div class=all>")
    assert html.extract(beside, html.induce(titled)).startswith("A lead of its own\n")


def test_wrapper_of_large_pages():
    rng = random.Random(6)
    links = "".join(f"<div class=x><b>Link {i}</b></div>" for i in range(2100))
    pages = [f"<html><body><div id=top>Site name</div>{links}<div class=y>{''.join(f'<p>{chr(32).join(words(rng, 9))}</p>' for _ in range(rng.randint(2, 5)))}</div></body></html>" for _ in range(3)]
    wrapper = html.induce(pages)
    assert wrapper["path"][-1] == "div.y"
    for p in pages:
        assert html.extract(p, wrapper) == "\n".join(re.findall("<p>(.*?)</p>", p))


def plain_matching(a, b):
    """The size of the largest matching that keeps parents and order, by the definition."""
    if a.label != b.label:
        return 0
    row = [0] * (len(b.nodes()) + 1)
    for x in a.nodes():
        new = [0]
        for j, y in enumerate(b.nodes()):
            new.append(max(row[j + 1], new[j], row[j] + plain_matching(x, y)))
        row = new
    return row[-1] + 1


@pytest.mark.parametrize("cells", [html.TABLE_CELLS, 1])
def test_tree_matching_by_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html, "TABLE_CELLS", cells)
    rng = random.Random(8)

    def make(deep):
        return "".join(f"<{t}>{make(deep - 1) if deep else rng.randrange(5)}</{t}>" for t in rng.choices(["div", "section", "b"], k=rng.randint(0, 5)))

    for _ in range(150):
        a, b = html.parse(make(3)), html.parse(make(3))
        kinds = html.Kinds()
        kinds.mark(a)
        kinds.mark(b)
        got = list(html.pairs(a, b, kinds))
        mate = {id(x): y for x, y in got}
        assert len({id(y) for _, y in got}) == len(mate) == len(got) == plain_matching(a, b) == kinds.score(a.kind, b.kind)
        for x, y in got:
            inner = [mate[id(c)] for c in x.nodes() if id(c) in mate]
            order = [next(i for i, c in enumerate(y.nodes()) if c is m) for m in inner]
            assert x.label == y.label and order == sorted(order)


def test_deep_pages():
    deep = 3000
    make = lambda i: f"<html><body><nav>Menu {i}</nav><article><p>Start {i}</p>{'<div>' * deep}<nav>Menu Home</nav><p>middle {i}</p>{'</div>' * deep}<p>End of article {i}.</p></article></body></html>"
    pages = [make(i) for i in range(3)]
    for wrapper in ({}, html.induce(pages)):
        assert html.extract(pages[1], wrapper) == "Start 1\nmiddle 1\nEnd of article 1."


def test_reader_comments_by_id_and_class():
    for mark in ("id=comments", "id='comment-section'", "class='user-comments'", "class='post-comments wide'", "id=disqus_thread", "id='respond'"):
        make = lambda i: f"<html><body><div id=main><h1>Title {i}</h1><p>Text of page {i} here</p></div><div {mark}><p>Reader {i} says no</p></div></body></html>"  # noqa: B023, E731
        pages = [make(i) for i in range(6)]
        for wrapper in ({}, html.induce(pages[:5])):
            assert html.extract(pages[5], wrapper) == "Title 5\nText of page 5 here", mark
    assert html.extract("<div class='has-comments'><p>kept</p></div><h2 id=comments>kept too</h2>", {}) == "kept\nkept too"


def test_headers_inside_articles():
    art = "<header>Site</header><article><header><h1>Title</h1></header><p>text</p><footer><p>Sources</p></footer></article><footer>All rights</footer>"
    assert html.extract(page(art), {}) == "Title\ntext\nSources"
    menu = "<article><header><h1>Title</h1><nav>Home</nav></header><p>text</p><header class='page masthead'>x</header></article>"
    assert html.extract(page(menu), {}) == "text"


def test_constant_headings_between_slots_stay():
    make = lambda i: f"<html><body><div id=top>Site</div><div class=recipe><p>By us</p><h1>Cake {i}</h1><h2>Ingredients</h2><ul><li>{i} eggs</ul><h2>Method</h2><p>Mix {i} times.</p><p>Print this</p></div><div>End</div></body></html>"
    pages = [make(i) for i in range(5)]
    wrapper = html.induce(pages)
    assert wrapper["path"][-1] == "div.recipe"
    assert html.extract(pages[2], wrapper) == "Cake 2\nIngredients\n2 eggs\nMethod\nMix 2 times."


def test_main_around_article():
    assert html.extract(page("<main><p>Lead</p><article><p>a</p></article></main>"), {}) == "Lead\na"
    assert html.extract(page("<article><p>a</p></article><article><p>b</p></article>"), {}) == "a\nb"


def test_equal_pages_and_ties_of_paths():
    same = page("<div class=a><p>one</p></div><div class=a><p>two</p></div>")
    assert html.induce([same] * 5) == {} and html.extract(same, {}) == "one\ntwo"
    make = lambda i: f"<html><body><div class=a><p>left {i}</p></div><div class=b><p>right {i}</p></div></body></html>"
    pages = [make(i) for i in range(4)]
    wrappers = [html.induce(p) for p in (pages, pages[::-1], pages * 2)]
    assert wrappers[0] == wrappers[1] == wrappers[2] and wrappers[0]["path"] == ["html", "body"]
    assert html.extract(pages[3], wrappers[0]) == "left 3\nright 3"


def test_pages_table(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", page(f"<article><p>text {i}</p></article>", str(i)), "clash") for i in range(9)] + [(None, None, None, None), (3, "http://h1.com/3", page("<article><p>text 3</p></article>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_texts(df).collect()
    assert len(got) == 11 and all(r.text == (f"text {r.page_id}" if r.page_id is not None else "") and r.n_chars == len(r.text) for r in got)
    assert html.main_texts(df.limit(0)).count() == 0


# ---- personal data ---------------------------------------------------------
def test_base_personal_data_as_stated():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def plain(t):
        f = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        f += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        f += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15]
        return [(a, b, pii.KINDS[k]) for a, k, b in sorted(f)]

    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("12345678905 .-+()@@ab_%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("1" * 200000) == [] and pii.base_spans("a" * 200000 + "@") == []


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(2)
    k, n = 5, 4
    field = pii.Field(np.zeros((pii.FEATURES + 1, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    field.chain, field.skip = field.chain + field.chain.T, field.skip + field.skip.T
    field.unary[:n] = rng.normal(size=(n, k))
    g = pii.Graph([0] * n, [(i, i + 1) for i in range(n)], [[i] for i in range(n)], [(0, 1), (1, 2)], [(0, 3)])
    p = np.zeros((n, k))
    for y in np.ndindex(*[k] * n):
        w = np.exp(sum(field.unary[i, y[i]] for i in range(n)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.skip[y[0], y[3]])
        for i in range(n):
            p[i, y[i]] += w
    assert np.allclose(field.marginals(g, rounds=80), p / p.sum(axis=1, keepdims=True), atol=1e-6)


def test_skip_edges_carry_evidence(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(i, f"some words +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} more words 4.0 and {rng.randint(1, 99)} x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.learn(docs)
    text = "call 555-0199 today or else +1 (555) 010-0199 then ask 555-0199 again"
    alone = pii.added_spans(["at 4.0 we"], [[]], field)[0]
    assert alone == [] and all(text[a:b] == "555-0199" for a, b, _ in pii.added_spans([text], [pii.base_spans(text)], field)[0])
    assert pii.scan(odd_docs).count() == 9 and pii.scan(no_docs).count() == 0


def test_skip_edges_between_plain_words():
    g = pii.Graph.of(["0301234567 tomorrow or 0301234567 again", "12 12 x 7 8 7", "5 5"])
    assert g.skip == [(0, 1), (4, 6)] and g.twins == g.skip and not g.shared
    assert g.chain == [(2, 3), (4, 5), (5, 6), (7, 8)]
    k = len(pii.KINDS) + 1
    skip = np.full((k, k), -1.0) + 4 * np.eye(k)
    field = pii.Field(np.zeros((pii.FEATURES + 1, k)), np.zeros((k, k)), skip)
    for n in (2, 3, 80):
        g = pii.Graph.of([" ".join(["0301234567 tomorrow or 99 so"] * n)])
        g.features = [[0] if v == 0 else [1] for v in range(len(g.owner))]
        field.unary[0] = [0, 0, 0, 0, 9]
        p = field.marginals(g)
        assert p[-2, 4] > 0.8 and abs(p[-1, 4] - 1 / k) < 1e-6
        assert np.allclose(p, field.marginals(g, rounds=400), atol=1e-4)


def test_messages_cross_a_long_chain():
    k = len(pii.KINDS) + 1
    chain = np.full((k, k), -12.0) + 12 * np.eye(k)
    field = pii.Field(np.zeros((pii.FEATURES + 1, k)), chain, np.zeros((k, k)))
    field.unary[0] = [0, 0, 0, 0, 9]
    g = pii.Graph.of([" ".join(f"{i}x" for i in range(120)), "4 x"])
    g.features = [[0]] + [[1]] * 120
    p = field.marginals(g)
    assert p[119, 4] > 0.9 and abs(p[120, 4] - 1 / k) < 1e-6


# ---- decontamination -------------------------------------------------------
def test_overlaps_with_substitutions(spark, odd_docs, no_docs):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, rng.randint(8, 60)))) for i in range(30)] + [(77, "too short an item"), (78, None), (79, "")]
    docs, want = [], set()
    for i, t in items[:30]:
        w = t.split()
        for every in (0, 4, 5, 6, 9):
            if every and len(w) < 20:
                continue
            v = [f"sub{j}" if every and j % every == every - 1 else x for j, x in enumerate(w)]
            docs.append((len(docs), " ".join(words(rng, rng.randint(0, 80)) + [x.upper() + "," for x in v] + words(rng, rng.randint(0, 80))), "clash"))
            if every != 4:
                want.add((docs[-1][0], i))
    clean = [(1000 + i, " ".join(words(rng, 300)), "clash") for i in range(100)]
    df = spark.createDataFrame(docs + clean + [(None, None, None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()}
    assert want <= got and not [d for d, _ in got if d >= 1000]
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench, chunk_words=100).collect()} == got
    left = decontam.without_overlaps(df, bench, chunk_words=200)
    assert left.columns == df.columns and left.count() == 101 + len(docs) - len({d for d, _ in got})
    assert decontam.overlaps(odd_docs, bench).count() == 0 and decontam.overlaps(no_docs, bench).count() == 0
    assert decontam.overlaps(df, bench.limit(0)).count() == 0 and decontam.without_overlaps(df, bench.limit(0)).count() == df.count()


def test_every_run_of_an_alignment(spark):
    rng = random.Random(14)
    item = [f"i{j}" for j in range(40)]
    said = item[:12] + [f"s{j}" for j in range(7)] + [f"s{j}" if j in (23, 28, 33) else x for j, x in enumerate(item)][19:37]
    for _ in range(300):
        same = np.array([rng.random() < 0.6 for _ in range(rng.randint(0, 30))], bool)
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        runs = decontam._best_runs(same)
        assert max([total[y] - total[x] for x, y in runs], default=0) == max(total[j] - total[i] for j in range(len(total)) for i in range(j + 1))
        assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False)) and all(any(x <= i < y for x, y in runs) for i in np.flatnonzero(same))
    docs = [(1, " ".join(words(rng, 30) + said + words(rng, 30))), (2, "we ask: What is the answer? What is THE answer"), (3, "what is answer the"), (4, "lone")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "what is the answer"), (3, "lone"), (4, "one two three four five six seven")], "item_id long, text string")
    df = spark.createDataFrame(docs + [(5, "one two three four five six seven"), (6, "one two three four five six eight")], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontam.overlaps(df, bench).collect())
    assert got == [(1, 1, 49, 67, 15), (2, 2, 2, 6, 4), (4, 3, 0, 1, 1), (5, 4, 0, 7, 7)]
    assert sorted(r.doc_id for r in decontam.without_overlaps(df, bench).collect()) == [3, 6]


# ---- token shards ----------------------------------------------------------
def test_wavelet_matrix_by_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 3000):
        x = rng.integers(0, 300, n).astype(np.uint32)
        w = WaveletMatrix.from_fields(WaveletMatrix.build(x, 9).to_fields())
        assert (w.decode() == x).all()
        if n:
            i = rng.integers(0, n, 40)
            assert (w.access(i) == x[i]).all()
        for t in {int(v) for v in x[:5]} | {7, 299, 600}:
            assert w.count(t) == (x == t).sum() and w.count(t, n // 2) == (x[: n // 2] == t).sum()
            assert (w.occurrences(t) == np.flatnonzero(x == t)).all()


def test_shards_round_trip(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    extra = [(20, "a  b\n\n c\t<|endoftext|> x"), (21, " lead"), (22, "x\ny z\nw"), (22, "trail "), (23, "日本語 テキスト’s 12,345.6"), (24, "don't we'll​q᠎a b"), (25, "x 　y"), (26, "end\n")]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    path = tokens.new_shard_folder(spark)
    tokens.write_shards(docs, path, shard_tokens=40)
    got = tokens.document_digests(spark, path).orderBy("start").collect()
    own = Tokenizer.from_file(tokens.default_tokenizer())
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1], r[2].encode()))
    start, every = 0, []
    for (some, d, text), r in zip(rows, got, strict=True):
        ids = own.encode(text, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (d if some else None, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        every += [(r.doc_id, i, x) for i, x in enumerate(ids)]
        start += len(ids)
    token = every[5][2]
    assert sorted((r.doc_id or 0, r.place) for r in tokens.token_places(spark, path, token).collect()) == sorted((d or 0, i) for d, i, x in every if x == token)
    assert tokens.token_counts(spark, path, token).agg(F.sum("n")).first()[0] == sum(x == token for _, _, x in every)
    empty = tokens.new_shard_folder(spark)
    tokens.write_shards(no_docs, empty)
    assert tokens.document_digests(spark, empty).count() == 0


# ---- pipeline --------------------------------------------------------------
def test_pipeline_decisions(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA).cache()
        assert now.columns == docs.columns
        seen[name] = now.toPandas()
    first, second, third, fourth = seen.values()
    judged = {r.doc_id: r.keep for r in quality.judged(docs).collect()}
    assert set(first.doc_id) == {d for d, k in judged.items() if k}
    texts = dict(zip(first.doc_id, first.text, strict=True))
    links = brute_links(texts)
    assert not brute_links(dict(zip(second.doc_id, second.text, strict=True))) and second.text.is_unique
    gone = set(texts) - set(second.doc_id)
    assert all(any(d in p for p in links) or list(texts.values()).count(texts[d]) > 1 for d in gone)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {d for d, t in zip(second.doc_id, second.text, strict=True) if any(i in " ".join(t.split()) for i in items)}
    assert set(third.doc_id) == set(second.doc_id) - leaks
    assert set(fourth.doc_id) <= set(third.doc_id) and fourth.doc_id.value_counts().max() <= 2
    out = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(fourth.doc_id)
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_piece_tables_against_a_dict():
    rng = np.random.default_rng(5)
    table, held = tokens.Pieces(8), {}
    for _ in range(30):
        new = [int(k) for k in np.unique(rng.integers(1, 400, 25).astype(np.uint64) * np.uint64(1024)) if int(k) not in held]  # all want one slot
        if not new or not table.has_room(len(new)):
            continue
        length = rng.integers(0, 5, len(new)).astype(np.int32)
        ids = rng.integers(0, 50000, length.sum()).astype(np.uint32)
        table.add(np.array(new, np.uint64), np.array(new, np.uint64), ids, length)
        for k, a, b in zip(new, np.cumsum(length) - length, np.cumsum(length), strict=True):
            held[k] = ids[a:b].tolist()
    asked = np.array([*held, 5, 1 << 40], np.uint64)
    slots = table.find(asked)
    assert (slots[-2:] == -1).all() and (slots[:-2] >= 0).all()
    flat, length = table.ids(slots[:-2])
    assert flat.tolist() == [i for v in held.values() for i in v] and length.tolist() == [len(v) for v in held.values()]


def test_piece_hashes_depend_on_every_byte():
    texts = ["", "a", "b", "ab", "a\x00", "\x00a", "12345678", "123456781", "123456782", "x" * 100, "x" * 99 + "y", "é", "ê"]
    a, b = tokens.piece_hashes(pa.array(["skip", *texts]).slice(1))
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(texts) and (a != 0).all()
    again = tokens.piece_hashes(pa.array(texts[::-1]))
    assert again[0].tolist() == a.tolist()[::-1] and again[1].tolist() == b.tolist()[::-1]


def test_encoder_with_full_tables(monkeypatch):
    monkeypatch.setattr(tokens, "YOUNG_PIECES", 64)
    own = tokens.Encoder(tokens.default_tokenizer())
    rng = np.random.default_rng(6)
    words = ["the", "of", "Ünïcode", "中文", "x1", "a,b", "'s"] + [f"w{i}" for i in range(3000)]
    for _ in range(6):
        texts = [" ".join(rng.choice(words, rng.integers(1, 300))) + "\nline" for _ in range(20)]
        ids, counts = own.encode(pa.array(texts))
        want = [[*x.ids, tokens.END_ID] for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
