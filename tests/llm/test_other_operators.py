"""Vectors, pages, conversations and the pipeline."""

import collections
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from genoweave.llm import ann, html, preference, queries


def _nearest(vectors, ids, query, k):
    scores = vectors @ vectors[query]
    scores[query] = -np.inf
    return [int(x) for x in ids[np.lexsort([ids, -scores])][:k]]


def test_recall_of_a_shard():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    index = pd.DataFrame({"rep": np.arange(3000), "embedding": list(vectors)})
    asked = pd.DataFrame({"query": np.arange(0, 3000, 60), "asked": list(vectors[::60])})
    found = ann.search_shard(ann.build_shard(index), asked)
    hit = sum(len({*_nearest(vectors, np.arange(3000), q, 20)} & {*found[found["query"] == q]["rep"]}) for q in range(0, 3000, 60))
    assert hit >= 0.95 * 50 * 20
    best = found.groupby("query").score.max()
    assert np.allclose(best.to_numpy(), [(vectors @ vectors[q]).max() for q in best.index])


def test_prune_keeps_diverse_edges():
    points = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 1]], np.float32)
    assert set(ann.robust_prune(points, np.array([0]), np.array([[1, 2, 3, -1]]), 3, 1.2)[0]) == {1, 3, -1}


def test_search_with_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = {k: rng.normal(size=8).astype(np.float32).tolist() for k in range(120)}
    for k in range(40, 80):
        vectors[k] = vectors[20]
    rows = [(k, v, 0) for k, v in vectors.items()] + [(200, None, 0), (220, [0.0] * 8, 0), (240, [float("nan")] * 8, 0), (260, [1.0, None] * 4, 0), (None, vectors[1], 0), (3, vectors[3], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in ann.search_every(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    table, ids = np.array([vectors[k] for k in range(120)], np.float64), np.arange(120)
    assert sorted(got) == [0, 20, 40, 60, 80, 100]
    assert all(got[q] == [int(x) for x in ids[np.lexsort([ids, -np.where(ids == q, -np.inf, (table * table[q]).sum(1))])][:20]] for q in got)
    assert ann.search_every(frame.limit(0)).count() == 0


def test_recall_on_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(table.embedding).astype(np.float64), table.vec_id.to_numpy()
    found = queries.op10_neighbours(spark, sf).toPandas()
    asked = np.flatnonzero(ids % 20 == 0)
    hit = sum(len({*_nearest(vectors, ids, q, 20)} & {*found[found.query_id == ids[q]].vec_id}) for q in asked)
    assert hit >= 0.9 * 20 * len(asked)


def test_recall_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(2200, 24)) * rng.uniform(0.5, 2, (2200, 1))).astype(np.float32)
    found = ann.search_every(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")).toPandas()
    exact = vectors.astype(np.float64)
    hit = sum(len({*_nearest(exact, np.arange(2200), q, 20)} & {*found[found.query_id == q].vec_id}) for q in range(0, 2200, 20))
    assert len(found) == 110 * 20 and hit >= 0.95 * 110 * 20


ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text.<br>next<p>Second\n  one.</p><ul><li>x</li><li>y</li></ul>{}</article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav>" + ARTICLE.format("") + "<footer>foot</footer></body></html>", "Title & more First bold text. next Second one. x y"),
        ("<body><header>Site</header><aside>side</aside>" + ARTICLE.format('<div class="comments"><p>troll</p></div><form>send<input></form><script>var a="</p>";</script>') + "<div class='cookie-notice'>We use</div>", "Title & more First bold text. next Second one. x y"),
        ("<body><div id=menu>Home</div><div class='post'><p>plain body</p><p>more</p></div><div class=ads>Buy</div></body>", "plain body more"),
        ("", ""),
        ("no tags at all", "no tags at all"),
        ("<p>un<b>closed <i>x", "unclosed x"),
        ("</div></p><main>a</main>b", "a"),
        ('<article>1 < 2 <a title="x>y</a> z</article>', "1 < 2 y z"),
        ("<!-- c --><article>&lt;tag&gt; &#233; &copy;<!-- in --> z</article", "<tag> é © z"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class='right-sidebar'><p>kept</p></body>", "kept"),
        ("<div class='content sidebar-left'><article><p>kept</p><div class=share>Share</div></article></div>", "kept"),
        ("<article>kept</article><div class=related><article>other</article></div>", "kept"),
        ("<div role=navigation><article>menu</article></div><p>kept</p>", "kept"),
        ('<article><div style="overflow: hidden">kept</div></article>', "kept"),
        ('<article><p data-role="dialog">kept</p></article>', "kept"),
        ('<article><p class="margin-bottom">kept</p></article>', "kept"),
        ("<article><p>kept</p><div class='share-buttons'>Share</div><div id=cookie-notice>We use</div></article>", "kept"),
        ("<article><![CDATA[abcdef", "abcdef"),
    ],
)
def test_class_words_only_hint(page, text):
    assert html.main_text(page) == text


def test_wrapper_of_a_host():
    one = html.signature("<nav><a>m</a></nav><article><h1>a</h1><p>x</p><p>y</p></article><div>Imprint</div>")
    two = html.signature("<nav><a>m</a></nav><article><h1>b</h1><p>z</p></article><div>Imprint</div><section>extra</section>")
    streams = [(tokens, 5, texts, [False] * len(tokens), chars) for tokens, _, texts, chars in (one, two)]
    wrapper = html.infer(streams)
    shown = [n.token for n in wrapper if not n.optional]
    assert "<article>" in shown and any(n.repeats for n in wrapper) and any(n.optional for n in wrapper)
    zone, own, _ = html.article_slots(wrapper)
    assert zone == "main" and html.xxhash.xxh64_intdigest(b"Imprint") >> 1 in own


def test_mismatches_become_groups_or_optional():
    def shown(*pages):
        made = [html.signature(p) for p in pages]
        return [n.token + "+" * n.repeats + "?" * n.optional for n in html.infer([(t, 1, x, [False] * len(t), c) for t, _, x, c in made])]

    row = "<dl><dt>k</dt><dd><b>v</b></dd></dl>"
    assert shown("<ul><li>a</li></ul>", "<ul><li>a</li><li>b</li><li>c</li></ul>") == ["<ul>", "<li>+", "#+", "</li>+", "</ul>"]
    assert shown(f"<div>{row}</div>", f"<div>{row}<hr>{row}</div>", "<div></div>")[1:-1] == [t + "+?" for t in ("<dl>", "<dt>", "#", "</dt>", "<dd>", "#", "</dd>", "</dl>")]
    assert shown("<div><p>a</p></div>", "<div><p>a</p><pre>x</pre></div>") == ["<div>", "<p>", "#", "</p>", "<pre>?", "#?", "</pre>?", "</div>"]
    wide = "<section><h2>t</h2><p>a</p><ul><li>x</li></ul><table><tr><td>c</td></tr></table></section>"
    assert all(t.endswith("+") for t in shown(f"<div>{wide * 3}</div>")[1:-1])
    one = [html.Node(t) for t in ("<p>", "#", "</p>")]
    two = [html.Node(t) for t in ("<p>", "#", "</p>", "<p>", "#", "</p>")]
    assert [n.repeats for n in html.align(one, two)] == [True] * 3


def test_the_wrapper_decides_about_doubtful_elements(spark):
    story = "<article><h1>t{0}</h1><div class='notice'><p>long text of the story number {0} in a box of its own</p></div><p>text number {0} is long too</p><div class=share>Share this</div></article>"
    short = "<article><p>a long text with very many words about the matter {0} and more of it</p><div class=related>see {0}</div></article>"
    rows = [(k, f"http://boxed.example/{k}", story.format(k)) for k in range(5)] + [(10 + k, f"http://short.example/{k}", short.format(k)) for k in range(5)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"t{k} long text of the story number {k} in a box of its own text number {k} is long too" for k in range(5))
    assert all(out[10 + k] == f"a long text with very many words about the matter {k} and more of it" for k in range(5))


def test_every_page_against_a_plain_cut(spark, sf):
    """The table's pages have one article element each; its text cut out with regular expressions must be what the operator finds."""
    import html as entities
    import re

    pages = {r.page_id: r.html or "" for r in queries.table(spark, sf, "pages").collect()}
    out = {r.page_id: r for r in queries.op5_html_extraction(spark, sf).collect()}
    assert set(out) == set(pages)
    for page_id, text in pages.items():
        inner = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer|\Z)", text, re.S)[1]
        inner = re.sub(r"<!--.*?-->|<(script|style|form)\b.*?</\1>|</?(?:b|i|a|em|strong|span|u)\b[^>]*>", "", inner, flags=re.S)
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (out[page_id].text, out[page_id].n_chars) == (want, len(want))


def test_plain_hosts_lose_their_template(spark):
    page = "<body><div>Welcome to our site</div><div><p>{}</p></div></body>"
    rows = [(k, f"http://plain.example/{k}", page.format(f"story {k}"), "clash") for k in range(6)] + [(90, None, None, ""), (91, "odd", "<p>q</p>", "")]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, zones string")).collect()}
    assert out == {**{k: f"story {k}" for k in range(6)}, 90: "", 91: "q"}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_are_not_the_template(spark):
    page = "<body><div>Welcome</div><div><h2>{0} head</h2><p>{0} text</p></div></body>"
    copies = [(k, f"http://copies.example/{k}", page.format("one")) for k in range(4)]
    single = [(10 + k, f"http://single.example/{k}", "<body><p>only paragraph</p></body>") for k in range(3)]
    mixed = [(20 + k, f"http://mixed.example/{k}", page.format(f"m{k}")) for k in range(4)] + [(30 + k, f"http://mixed.example/c{k}", "<body><div>Welcome</div><section><p>copied</p><pre>twice</pre></section></body>") for k in range(3)]
    shapes = [(40 + k, f"http://shapes.example/{k}", f"<body><div class={c}><p>same text</p></div></body>") for k, c in enumerate("xyz")]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(copies + single + mixed + shapes, "page_id long, url string, html string")).collect()}
    assert all(out[k] == "Welcome one head one text" for k in range(4)) and all(out[10 + k] == "only paragraph" for k in range(3))
    assert all(out[20 + k] == f"m{k} head m{k} text" for k in range(4)) and all(out[30 + k] == "copied twice" for k in range(3))
    assert all(out[40 + k] == "same text" for k in range(3))


def test_streams_of_a_host_meet_in_bounded_groups(spark):
    rng = np.random.default_rng(4)
    names = ["h2", "pre", "blockquote", "section", "table", "dl"]
    rows = []
    for k in range(400):
        middle = "".join(f"<{n}>{n} {k}</{n}>" for n in rng.choice(names, 6))
        rows.append((k, f"http://big.example/{k}", f"<body><div>Welcome here</div>{middle}<div>Imprint</div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shapes = spark.range(400).selectExpr("'big.example' host", "string(id) shape", "1L pages", "array(1L, 2L, 3L) marks", "'[]' nodes")
    sizes = [r["count"] for r in html.dealt(shapes, 1).groupBy("host", "part").count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 3 * html.TOGETHER
    found = html.decisions(html.aligned_in_rounds(html.streams(pages))).collect()
    assert len(found) == 1 and {html.xxhash.xxh64_intdigest(t) >> 1 for t in (b"Welcome here", b"Imprint")} == set(found[0].template)
    out = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert all("Welcome" not in t and "Imprint" not in t and len(t.split()) == 12 for t in out.values())


SENTENCE = "word{0} of a paragraph that says something new on page {0} and goes on for a while, part {1}"


@pytest.mark.parametrize(
    ("page", "parts"),
    [
        ("<body><div class=top>Site</div><main><div class='content sidebar-right'><p>{0}</p><p>{1}</p></div></main><div class=footer>Imprint</div></body>", 2),
        ("<body><div class='page has-sidebar'><div class=nav>Home News</div><div><p>{0}</p><p>{1}</p></div></div></body>", 2),
        ("<body><div class=sidebar><p>{0}</p><p>{1}</p></div><div class=footer>Imprint</div></body>", 2),
        ("<body><article><p>{0}</p><p class=comments-policy>{1}</p></article></body>", 2),
        ("<body><article><p>{0}</p><p class=reply-text>{1}</p></article></body>", 2),
        ("<body><article><p>{0}</p><p class=navigation-history>{1}</p></article></body>", 2),
        ("<body><article><p>{0}</p><p class=menu>{1}</p><p class=subscription>{2}</p></article></body>", 3),
        ("<body><div class=main><p>{0}</p><p>{1}</p><div class=comments><p>{2}</p></div><div class='ad'>{3}</div></div></body>", 2),
        ("<body><article><p>{0}</p><script src=http://x/>var a=1;</script><p>{1}</p><svg/><div class=share>Share</div></article></body>", 2),
    ],
)
def test_words_never_condemn_an_article(page, parts):
    """Over six pages of a host: what holds most of the text that differs stays, whatever its class says."""
    pages = [page.format(*(SENTENCE.format(k, part) for part in range(4))) for k in range(6)]
    made = [html.signature(p) for p in pages]
    decided = html.article_slots(html.infer([(t, 1, x, [False] * len(t), c) for t, _, x, c in made]))
    assert [html.main_text(p, decided) for p in pages] == [" ".join(SENTENCE.format(k, part) for part in range(parts)) for k in range(6)]


def test_hosts_without_article(spark):
    """Class words, template texts and unlike layouts over whole hosts."""
    one = "<body><div class=top>Our site</div><div class='page has-sidebar'><div class=nav>Home</div><div><p>{0}</p><p>{1}</p></div></div><div>Imprint</div></body>"
    two = "<body><div>Our site</div><table><tr><td>{0}</td></tr></table><ul><li>{1}</li></ul><section class=comments><h3>Comments</h3><p>me too {2}</p></section><div>Imprint</div></body>"
    rows = [(k, f"http://one.example/{k}", (one if k % 2 else two).format(SENTENCE.format(k, 0), SENTENCE.format(k, 1), k)) for k in range(12)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: f"{SENTENCE.format(k, 0)} {SENTENCE.format(k, 1)}" for k in range(12)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
def test_common_in_linear_space(x, y):
    x, y = np.array(x, np.int64), np.array(y, np.int64)
    whole = html._table(x, y)
    cells, html.CELLS = html.CELLS, 8
    try:
        found = html.common(x, y)
    finally:
        html.CELLS = cells
    assert len(found) == len(whole) and all(x[i] == y[j] for i, j in found) and found == sorted(found)
    assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)


def test_long_and_many_layouts_in_bounded_memory():
    """Two pages of 8,000 unlike blocks, and a group of layouts of many kinds."""
    rng = np.random.default_rng(1)
    names = ["h2", "pre", "blockquote", "section", "table", "dl", "figure", "details"]
    long = [[html.Node(t) for n in rng.choice(names, 8_000) for t in (f"<{n}>", "#", f"</{n}>")] for _ in range(2)]
    kinds = [[html.Node(f"<t{rng.integers(k * 40, k * 40 + 40)}>") for _ in range(600)] for k in range(64)]
    tracemalloc.start()
    assert len(html.align(*long)) < 48_000
    assert len(html.merge(kinds)) == 64
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_folding_is_balanced():
    folded, place = html.fold(["<ul>", "<li>", "#", "</li>", "<li>", "#", "</li>", "</ul>"])
    assert folded == ["<ul>", "<li>+", "#+", "</li>+", "</ul>"] and place == [0, 1, 2, 3, 1, 2, 3, 4]


def test_preference_against_sql(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "go"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
        (2, 0, "user", "same"), (2, 1, "assistant", "a"), (3, 0, "user", "same"), (3, 1, "assistant", "a"),
        (4, 0, "user", "alone"), (7, None, None, None), (7, 1, "user", ""), (6, 0, "user", None), (None, 0, "user", "lost"), (9, 0, "user", "x"), (9, 0, "user", "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by name below
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.execute(preference.PREFERENCE_SQL).fetchall()
    got = preference.preference_report(frame)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    one = got.where("pair_id = 0").first()
    assert one.n_shared == 1 and one.prompt == "<|user|>\nhi\n<|end|>\n" and one.rejected == "<|assistant|>\nno\n<|end|>\n" and one.rejected_trained == len(one.rejected)
    assert preference.preference_report(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).to_numpy().tolist())) == sorted(map(tuple, want[columns].astype(str).to_numpy().tolist()))


def test_pipeline(spark, sf):
    docs = queries.table(spark, sf, "documents").selectExpr("*", "doc_id as n_lines", "source as kept", "1 as size", "lang as fp")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == columns
            docs = corpus_pipeline.write_table(docs, "test")
        counts.append(docs.count())
    assert counts[1] == counts[2] < counts[0] and counts[3] <= counts[2] and counts[4] > 0 and counts[5] == counts[4]


def test_pipeline_stages_with_odd_rows(spark, sf):
    """Null ids and texts, repeated ids and rows, and empty tables through every stage; near-duplicates go row by row."""
    long = " ".join(f"word{k}" for k in range(60))
    texts = {"A": long, "B": " ".join(f"other{k}" for k in range(60)), "C": " ".join(f"third{k * 7}" for k in range(60))}
    rows = [(1, "A"), (2, "A"), (2, "B"), (3, "C"), (3, "C"), (None, "C"), (None, None), (4, None), (None, "D")]
    docs = spark.createDataFrame([(i, texts.get(t, t and " ".join(f"last{k * 3}" for k in range(50))), "en", None if i == 1 else "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in near.collect()), key=str) == sorted([(1, "word0"), (2, "other"), (3, "third"), (4, ""), (None, "last0")], key=str)
    for some in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, some, sf)
            assert out.count() <= 3 * max(1, some.count())
            assert k == 4 or out.columns == some.columns


@pytest.mark.parametrize("name", ["op1_toxicity", "op4_sentencepiece", "op8_simhash", "op9_lm_scoring", "op12_spelling"])
def test_registered_queries_return_a_row_for_each_document(spark, sf, name):
    found = queries.QUERIES[name](spark, sf).toPandas()
    documents = queries.table(spark, sf, "documents")
    if name == "op12_spelling":
        assert len(found) == found.word.nunique() > 0 and (found.n >= 5).all()
        return
    assert sorted(found.doc_id) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    scores = {"op1_toxicity": "score", "op4_sentencepiece": "n_tokens", "op8_simhash": "component_id", "op9_lm_scoring": "score"}
    assert found[scores[name]].notna().all()
