"""Pages, the similarity join, mixing, shards and the pipeline against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
from answerlake.llm import jaccard_join, main_text, mixing, token_shards, warc
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tree(spark):
    return main_text.train(spark)


PAGES = {
    '<body><nav><a href="/">Home page</a></nav><article><h1>T &amp; U</h1><p>One  two<br>three&nbsp;four.</p></article>'
    "<footer>Copyright notice of the site</footer>": "T & U One two three four.",
    '<div id="sidebar"><p>Some long text about other things that are not here at all today.</p></div><main><p>In <b>bold</b>'
    ' words <a href="x">link</a> and more words that follow it.</p><div class="comments"><p>First reader says a lot of '
    "things about it.</p></div></main>": "In bold words link and more words that follow it.",
    "<article><p>a &lt; b &#233; &#x41; &bogus; &am</p><script>var x='</p><p>no';</script><style>p{}</style><!-- no -->"
    "<p>end</article><aside>no</aside>": "a < b \xe9 A &bogus; &am end",
    '<main><form><p>Your name and address please fill in here.</p></form><div class="cookie-consent">We use cookies on '
    "this site.</div><p>Yes.</p><ul><li>Item one of it</li></ul></main>": "Yes. Item one of it",
    "<article>unclosed <p>text <!-- to the end": "unclosed text",
    "plain text without any markup in it at all": "plain text without any markup in it at all",
    "": "",
}


def test_main_text_of_small_pages(tree):
    for page, want in PAGES.items():
        assert main_text.main_text(page, tree) == want


HELD_OUT = [  # pages and their main text, none of which trained the tree
    # bare divs: menu, list of stories, article, copyright
    ('<body><div><a href="/">The Harbour Post</a></div><div><a href="/n">News</a></div><div><a href="/s">Sport</a></div>'
     '<div><a href="/w">Weather</a></div><div>Top stories</div><div><a href="/1">Ferry to the islands is late again</a></div>'
     '<div><a href="/2">School roof mended after the storm</a></div><div><a href="/3">New lamps for the old pier</a></div>'
     "<h1>Council agrees to rebuild the sea wall before winter</h1><div><p>The council agreed on Monday to rebuild the sea "
     "wall, which two storms in January had broken in three places, and to pay for it from the money kept for roads.</p>"
     "<h2>Three places</h2><p>Engineers walked the whole length of the wall in March and found cracks near the school, the "
     "market and the old pier, where the ground behind it has already begun to sink.</p><p>Work begins in June.</p><p>The "
     "harbour stays open while the work goes on, but boats over ten metres must lie at the outer mole until autumn.</p></div>"
     '<div>More stories</div><div><a href="/4">What the fishermen say about the plan</a></div><div><a href="/5">A short '
     "history of the mole</a></div><div><a href='/6'>Storm damage in pictures</a></div><div>Copyright 2024 Example Ltd</div></body>",
     "Council agrees to rebuild the sea wall before winter The council agreed on Monday to rebuild the sea wall, which two "
     "storms in January had broken in three places, and to pay for it from the money kept for roads. Three places Engineers "
     "walked the whole length of the wall in March and found cracks near the school, the market and the old pier, where the "
     "ground behind it has already begun to sink. Work begins in June. The harbour stays open while the work goes on, but "
     "boats over ten metres must lie at the outer mole until autumn."),
    # related links inside the article, a heading between paragraphs
    ('<nav><ul><li><a href="/">Home</a></li><li><a href="/g">Garden</a></li></ul></nav><article><h1>How to prune an old apple '
     "tree</h1><p>An old tree wants three winters, not one: take out the dead wood first, then the branches that cross, and "
     "only in the last year those that shade the middle of the crown.</p><h3>Read on</h3><ul><li><a href='/a'>When to plant a "
     "young pear tree</a></li><li><a href='/b'>Tools for the winter garden</a></li><li><a href='/c'>What to do with windfalls"
     "</a></li></ul><p>Cut on a dry day with a sharp saw, just outside the ring of bark where the branch begins, and leave "
     "the wound open, since paint keeps the water in.</p><h2>Afterwards</h2><p>Feed the tree in spring with compost and keep "
     "the grass away from the trunk until midsummer.</p></article><footer>The garden pages, written by readers</footer>",
     "How to prune an old apple tree An old tree wants three winters, not one: take out the dead wood first, then the "
     "branches that cross, and only in the last year those that shade the middle of the crown. Cut on a dry day with a sharp "
     "saw, just outside the ring of bark where the branch begins, and leave the wound open, since paint keeps the water in. "
     "Afterwards Feed the tree in spring with compost and keep the grass away from the trunk until midsummer."),
    # names that hold a mark but are none
    ('<header>Law notes</header><article><h1>Ending a lease early</h1><div class="header-image"><p>The picture shows the first '
     "printed lease of the town, which bound the tenant for ninety-nine years without any way out of it.</p></div><section "
     'class="notice-period"><h2>How long it takes</h2><p>A tenant who wants to leave must write three months before the day, '
     "and the letter counts from the end of the month in which the owner has received it.</p><p>Shorter times hold only where "
     'both sides have signed them.</p></section></article><div class="cookie-banner">We use cookies on this site and ask you '
     "to agree to all of them before you read any further.</div>",
     "Ending a lease early The picture shows the first printed lease of the town, which bound the tenant for ninety-nine years "
     "without any way out of it. How long it takes A tenant who wants to leave must write three months before the day, and the "
     "letter counts from the end of the month in which the owner has received it. Shorter times hold only where both sides "
     "have signed them."),
    # a table layout
    ('<table><tr><td><a href="/1">Start page</a><br><a href="/2">Old maps</a><br><a href="/3">Guest book</a></td><td><h2>The '
     "mill on the upper river</h2><p>The mill was built of stone from the quarry behind it and ground corn for four villages "
     "until the railway brought cheaper flour from the coast.</p><p>Its wheel was sold in the war, but the race and both "
     "stones can be seen on any day on which the gate is open.</p></td></tr></table>",
     "The mill on the upper river The mill was built of stone from the quarry behind it and ground corn for four villages until "
     "the railway brought cheaper flour from the coast. Its wheel was sold in the war, but the race and both stones can be seen "
     "on any day on which the gate is open."),
]


def test_held_out_pages_by_words(tree):
    from collections import Counter

    common = made = wanted = 0
    for page, want in HELD_OUT:
        got, right = Counter(main_text.main_text(page, tree).split()), Counter(want.split())
        common, made, wanted = common + (got & right).total(), made + got.total(), wanted + right.total()
    assert common >= 0.97 * made and common >= 0.97 * wanted


def test_tree_splits_on_neighbours(tree):
    def used(node):
        return {main_text.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert used(tree) >= {"link_density", "links_after", "words_before"}


def test_short_blocks_of_an_article_stay(tree):
    text = "The mill was built of stone from the quarry behind it and ground corn for four villages"
    menu = '<ul><li><a href="/">One two</a></li></ul>'
    for n in (1, 2, 4, 9, 16):
        for end in ("", "."):
            x = " ".join(text.split()[:n]) + end
            for before, inside, after in (("", [text + ".", x], ""), ("<nav><a>x</a></nav>", [x], ""), ("", [x, text, x], menu),
                                          (menu, [text, x], "<footer>One two</footer>"), (menu, [x, x, text + "."], menu)):
                page = f"{before}<article>{''.join(f'<p>{p}</p>' for p in inside)}</article>{after}"
                assert main_text.main_text(page, tree) == " ".join(inside), page


def test_marks_in_full_names_and_in_parts_of_names():
    for name, mark in (("site-footer", 1), ("header-image", 0.5), ("notice-period", 0.5), ("ad", 1), ("adSlot top", 1),
                       ("no-sidebar", 0), ("entry-header", 0), ("story", 0), ("cookieNotice", 1)):
        assert main_text._named(f' class="{name}"')[1] == mark, name


def test_wrappers_keep_the_article(tree):
    one, two = (f"The {w} of the committee met on Tuesday and agreed to publish its findings in the spring." for w in ("head", "whole"))
    article = f"<p>{one}</p><p>{two}</p>"
    menu = "<nav><a href='/'>Home page</a></nav>"
    for page in (f"<form id='aspnetForm'>{menu}<article>{article}</article></form>", f"<form>{menu}<div>{article}</div></form>",
                 f"<div class='no-sidebar'>{menu}<article>{article}</article></div>", f"<div class='has-sidebar'>{article}</div>",
                 f"<article class='post comments-open'>{article}</article>", f"<main class='content share-on'>{article}</main>",
                 f"<div class='page sidebar'><article>{article}</article></div>"):
        assert main_text.main_text(page, tree) == f"{one} {two}", page
    # a form or a marked element beside the article, and articles in them, stay out
    for extra in (f"<form><p>{two}</p></form>", f"<aside><article><p>{two}</p></article></aside>",
                  f"<div class='related'><article><p>{two}</p></article></div>", f"<section id='comments'><article>{two}</article></section>"):
        assert main_text.main_text(f"<article><p>{one}</p><p>{one}</p></article>{extra}", tree) == f"{one} {one}", extra


def test_custom_and_self_closed_elements_drop_no_text(tree):
    text = "The whole of the committee met on Tuesday and agreed to publish its findings in the spring."
    for inside in (f"<svg-icon><p>{text}</p></svg-icon>", f"<button-group></button-group><title-bar/><p>{text}</p>",
                   f"<svg class='x'/><math/><p>{text}</p>", f"<svg><title>x</title></svg><p>{text}</p>"):
        assert main_text.main_text(f"<article>{inside}</article>", tree) == text, inside


def test_tree_on_its_table_and_pages_table(spark, sf, tree):
    rows = main_text.labelled_blocks()
    assert sum(main_text.decide(tree, f) != bool(y) for f, y in rows) <= 0.01 * len(rows)
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "v", "<p>" + "x " * 300_000 + "."),
                                   (2, "v", "<p>x.")], "page_id long, url string, html string").withColumn("carried", F.lit(1))
    got = main_text.extract(pages, tree=tree).collect()
    assert [r.n_chars for r in got] == [0, 0, 600_001, 2]
    assert main_text.extract(pages.limit(0), tree=tree).count() == 0
    assert main_text.extract(spark.read.parquet(f"{sf}/pages.parquet"), tree=tree).where("n_chars = 0").count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "<p>\r\n\r\nWARC/1.1 é" + "x" * 1500
    rows = [(1, "http://a/é?q=1 2", long), (2, None, long), (None, "u", long), (3, "u", None), (4, "", ""),
            (5, "u", "short"), (6, "u", "short"), (7, "u", long + "y"), (7, "u", long + "y"), (None, "z", long + "z"),
            (None, "z", long + "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1))
    folder = (tmp_path / "warc").as_uri()
    index = warc.write_archive(pages, folder, file_bytes=2000)
    got = warc.read_records(index, folder, gap=10, most=3000).collect()
    assert len(got) == len(rows)
    key = lambda x: tuple(map(repr, x))
    kinds = sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=key)
    want = []
    for i, url, html in rows:
        data = (html or "").encode()
        revisit = html == long and i != 2
        want.append((i, url, "revisit" if revisit else "response", 2 if revisit else None, len(data), hashlib.sha1(data).hexdigest()))
    assert kinds == sorted(want, key=key)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted(
        (h or "").encode() for i, _, h in rows if not (h == long and i != 2))
    # as many read tasks as there are ranges of archive bytes, however small the index is
    tasks = [warc.read_records(index, folder, most=m).rdd.getNumPartitions() for m in (10 ** 9, 500)]
    total = sum(r.length for r in index.collect())
    assert tasks == [1, -(-total // 500)]
    some = index.where("page_id in (5, 7)")
    assert warc.read_records(some, folder).count() == 3
    empty = (tmp_path / "empty").as_uri()
    assert warc.read_records(warc.write_archive(pages.limit(0), empty), empty).count() == 0


def brute_components(docs, width=3, threshold=90):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().translate(jaccard_join.LOWER).split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            o = len(a & b)
            if o and 100 * o >= threshold * (len(a) + len(b) - o):
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("frequent", [2, 10 ** 9])
def test_join_equals_brute_force(spark, monkeypatch, frequent):
    """Chains and large groups of near copies, whether or not frequent n-grams come last."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    r, docs = random.Random(5), []
    base = [f"w{r.randrange(400)}" for _ in range(140)]
    for i in range(90):  # copies of one text with none to four changed words
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"c{r.randrange(10 ** 6)}"
        docs.append((i, " ".join(w)))
    chain = [f"k{r.randrange(10 ** 6)}" for _ in range(130)]
    for i in range(100, 118):  # each like the one before, the ends unlike
        docs.append((i, " ".join(chain)))
        chain = chain[3:] + [f"k{r.randrange(10 ** 6)}" for _ in range(3)]
    passage = " ".join(f"p{k}" for k in range(60))
    docs += [(200 + i, passage + " " + " ".join(f"u{r.randrange(10 ** 6)}" for _ in range(r.randrange(4, 40)))) for i in range(60)]
    docs += [(300 + i, t) for i, t in enumerate(("a b", "A B", "a", "", None, "a b c", "a b c a b c", " a\tb "))]
    docs += [(400 + i, " ".join(f"s{k}" for k in range(40 - i))) for i in range(8)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components(docs)


def test_join_of_odd_documents(odd_docs, no_docs):
    rows = jaccard_join.jaccard_components(odd_docs).collect()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert len(rows) == odd_docs.count()
    assert (by[1].component_id, by[2].component_id, by[3].n_shingles) == (1, 2, 0)
    assert by[5].component_id == 4 and by[7].component_id == 6 and by[9].component_id == 8
    assert {r.component_id for r in rows if r.doc_id is None} == {4, None}
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    kept = [r.doc_id for r in jaccard_join.one_of_each(odd_docs).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 3, 4, 6, 8, 10, 11, 12]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    got = {r.node: r.component for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200}


def test_mixing_meets_targets_on_posteriors(spark, sf):
    import __spark_entry__ as entry

    rows = entry.queries()["op9_mixing_weights"](spark, sf).collect()
    total = {d: sum(r.n_tokens * r[f"p_{d}"] * r.rate for r in rows) for d in mixing.TARGETS}
    mass = {d: sum(r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS}
    whole = mass["good"] / mixing.TARGETS["good"]
    for d, share in mixing.TARGETS.items():
        assert total[d] == pytest.approx(whole * share, rel=0.05, abs=0.005 * whole)
    assert all(0 <= r.rate and abs(r.copies - r.rate) < 1 for r in rows)
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.TARGETS) - 1) < 1e-3 for r in rows)


def test_rare_domains_reach_their_targets(spark):
    """A domain with a fortieth of its target gets rates of forty, and a bound shows what it costs."""
    good, low = "plain words of some good text here", "junk spam offer click win money"
    docs = spark.createDataFrame([(i, f"{low} {i}" if i % 100 == 0 else f"{good} {i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "low" if i % 100 == 0 else "good") for i in range(600)], "doc_id long, domain string")
    targets = {"good": 0.7, "low": 0.3}
    for bound in ({}, {"max_rate": 4.0}):
        rates = mixing.mixing_rates(docs, labels, targets, "good", **bound)
        found = {r.domain: (r.target, r.reached) for r in mixing.reached_totals(rates, targets, "good").collect()}
        assert found["good"][1] == pytest.approx(found["good"][0], rel=0.02)
        if bound:
            assert found["low"][1] < 0.5 * found["low"][0]
        else:
            assert found["low"][1] == pytest.approx(found["low"][0], rel=0.02) and rates.agg({"rate": "max"}).first()[0] > 20


def test_fit_is_the_least_squares_optimum(spark):
    """Against many small projected gradient steps in numpy."""
    r = np.random.default_rng(1)
    p = np.round(r.dirichlet([0.3, 0.3, 0.3], 60), 4)
    tokens = r.integers(1, 500, 60)
    frame = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], "n_tokens long, p0 double, p1 double, p2 double")
    targets = {"a": 0.6, "b": 0.3, "c": 0.1}
    history = mixing._fit(frame, targets, "a", 4.0)
    got = [x.rate for x in frame.withColumn("rate", mixing._rate(history, 3, 4.0)).collect()]
    mass = (tokens[:, None] * p).sum(axis=0)
    goal = mass[0] / 0.6 * np.array([0.6, 0.3, 0.1])
    error = lambda x: float((((tokens * x) @ p - goal) ** 2 / mass).sum())
    rate = np.ones(60)
    for _ in range(20_000):
        rate = np.clip(rate - 0.5 * p @ (((tokens * rate) @ p - goal) / mass), 0, 4)
    assert error(np.array(got)) <= error(rate) + 1e-3 * error(np.ones(60))


def test_mixing_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, "good"), (8, "good"), (11, "low"), (None, "low"), (10, None)], "doc_id long, domain string")
    for used in (labels, labels.limit(0)):
        rows = mixing.mixing_rates(odd_docs, used, mixing.TARGETS, "good").collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.rate for r in rows)
        assert mixing.mixing_rates(no_docs, used, mixing.TARGETS, "good").count() == 0
    assert mixing.mixed_documents(odd_docs, labels, mixing.TARGETS, "good").columns == odd_docs.columns
    twice = mixing.mixed_documents(odd_docs, labels, {"good": 1.0, "low": 0.0}, "good", max_rate=3.0)
    assert twice.columns == odd_docs.columns


def test_slots_are_a_keyed_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        one, other = (token_shards.slots(np.arange(n), n, k) for k in (1, 2))
        assert sorted(one) == list(range(n))
        assert n < 64 or (one != other).any()


def test_encoder_is_the_library():
    with open(token_shards.vocabulary_path(), "rb") as f:
        encode = token_shards.Encoder(f.read())
    r = random.Random(3)
    signs = list(" \n\t'sl9é.A\x1f\x85​́-") + ["'ll", " ", "　", "  "]
    for text in ["", None, "<|endoftext|> a"] + ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(2000)]:
        assert np.frombuffer(encode(text), "<u2").tolist() == encode.encode(text or "")


def test_shards_hold_every_document_in_slot_order(spark, odd_docs, no_docs, tmp_path):
    docs = odd_docs.select("doc_id", "text", "n").union(spark.read.parquet(f"{SF}/documents.parquet").limit(30).select(
        F.col("doc_id") + 1000, "text", F.lit("x"))).repartition(4)
    folder, length = (tmp_path / "shards").as_uri(), 64
    options = dict(length=length, per_shard=100)
    where = token_shards.materialise(docs, folder, **options)
    rows = where.collect()
    manifest = spark.read.parquet(f"{folder}/manifest")
    data = {m.shard: (tmp_path / "shards" / token_shards.shard_name(m.shard)).read_bytes() for m in manifest.collect()}
    total = max(r.slot for r in rows) + 1
    assert {r.slot for r in rows} == set(range(total)) and sum(map(len, data.values())) == total * length * 2
    with open(token_shards.vocabulary_path(), "rb") as f:
        encode = token_shards.Encoder(f.read())
    # ids that one text has: its pieces together are its tokens
    for doc, text in ((4, "One two three."), (12, None), (1, None)):
        text = docs.where(F.col("doc_id") == doc).first().text
        pieces = b"".join(data[r.shard][r.byte_offset:r.byte_offset + 2 * r.n_tokens] for r in sorted(
            (r for r in rows if r.doc_id == doc), key=lambda r: -r.n_tokens)) if doc != 12 else None
        if pieces is not None:
            assert pieces == encode(text) + np.array([token_shards.END], "<u2").tobytes()
    assert sum(r.n_tokens for r in rows) == sum(len(encode(r.text)) // 2 + 1 for r in docs.collect())
    read = token_shards.read_slots(spark, folder, 7, total - 9, **options).collect()
    assert sorted(r.slot for r in read) == list(range(7, total - 2))
    for r in read[:50]:
        at = r.slot % 100 * length * 2
        assert np.frombuffer(data[r.slot // 100][at:at + length * 2], "<u2").tolist() == r.tokens
    # a second run finds the table and all shards and writes none
    again = token_shards.materialise(docs, folder, **options)
    assert sorted(again.collect(), key=repr) == sorted(rows, key=repr) and spark.read.parquet(f"{folder}/manifest").count() == len(data)
    assert token_shards.materialise(no_docs, (tmp_path / "none").as_uri()).count() == 0
    # other parameters or documents on a used folder are refused, and nothing is written
    written = sorted(p.name for p in (tmp_path / "shards").iterdir())
    for change in ({"order_key": 5}, {"length": 32}, {"per_shard": 50}, {"end": 0}):
        with pytest.raises(ValueError, match=next(iter(change))):
            token_shards.materialise(docs, folder, **{**options, **change})
    for others in (docs.limit(5), no_docs, docs.union(docs.limit(1)), docs.withColumn("text", F.upper("text"))):
        with pytest.raises(ValueError, match="other documents"):
            token_shards.materialise(others, folder, **options)
    assert written == sorted(p.name for p in (tmp_path / "shards").iterdir())


def test_shards_are_dealt_in_ranges(spark, sf, tmp_path, monkeypatch):
    docs, read = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for writers in (50_000, 2):
        monkeypatch.setattr(token_shards, "MAX_WRITERS", writers)
        folder = tmp_path / str(writers)
        token_shards.materialise(docs, folder.as_uri(), length=64, per_shard=16)
        rows = spark.read.parquet(f"{folder.as_uri()}/manifest").withColumn("file", F.input_file_name()).collect()
        by = {}
        for r in rows:
            by.setdefault(r.file, []).append(r.shard)
        shards = sorted(r.shard for r in rows)
        assert shards == list(range(len(shards))) and len(shards) > 10
        assert len(by) == min(writers, len(shards)) and all(max(v) - min(v) == len(v) - 1 for v in by.values())
        read[writers] = {r.shard: r.sha256 for r in rows}
    assert read[2] == read[50_000]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from answerlake.llm import decontaminate, quality
    from answerlake.runtime import cut_lineage

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, sf), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "token_shards":
            assert docs.columns == before.columns and docs.count() > 0
        if name == "quality_rules":
            assert kept[name] == {r.doc_id for r in quality.quality_rules(before).where("kept").collect()}
        if name == "ngram_jaccard_join":
            groups = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert kept[name] == {root for _, root in groups.values()}
        if name == "benchmark_decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate.contamination(docs, items).where("contaminated").count() == 0
    assert kept["token_shards"] == kept["mixing_weights"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept["token_shards"]


def test_pipeline_removes_near_copies_of_five_words_at_80(spark, sf):
    import corpus_pipeline

    r, docs = random.Random(8), []
    for i in range(40):  # pairs with none to five changed words
        w = [f"w{r.randrange(10 ** 6)}" for _ in range(120)]
        docs.append((2 * i, " ".join(w)))
        for _ in range(i % 6):
            w[r.randrange(len(w))] = f"c{r.randrange(10 ** 6)}"
        docs.append((2 * i + 1, " ".join(w)))
    docs += [(100 + i, t) for i, t in enumerate(("a b c d", "A B c d", "a b c", None, "", "a b c d e", "a b c d e f"))]
    shingles = lambda w: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for given in (docs, [(x.doc_id, x.text) for x in table.collect()]):
        sets = {i: shingles((t or "").encode().translate(jaccard_join.LOWER).split()) for i, t in given}
        of = {i: i for i in sets}

        def root(i):
            while of[i] != i:
                i = of[i]
            return i

        for a in sets:
            for b in sets:
                o = len(sets[a] & sets[b]) if a < b else 0
                if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = sorted((root(a), root(b)))
                    of[y] = x
        kept = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(given, "doc_id long, text string"), sf)
        assert sorted(x.doc_id for x in kept.collect()) == sorted({root(i) for i in sets})
