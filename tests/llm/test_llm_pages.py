"""Page text against known layouts, the chain field against all paths, and the pipeline stage by stage."""

import itertools
import time

import numpy as np
import pytest

pytest.importorskip("fluoroframe.llm")

from fluoroframe.llm import html_text  # noqa: E402


@pytest.fixture(scope="module")
def field():
    return html_text.default_field()


def test_blocks_of_odd_markup():
    page = "<!-- <p>no</p> --><p>a<b>b</b>\n c<br>d<p>&amp;&lt;x&gt; <a href='>'>l</a><script>if (1 < 2) '</p>'</script><ul><li>one<li>two</ul><div hidden>no</div>tail<di"
    assert [b.text for b in html_text.leaf_blocks(page)] == ["ab c d", "&<x> l", "one", "two", "tail"]
    assert html_text.leaf_blocks("") == []


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(3)
    names = list(field.weights)
    for _ in range(30):
        marks = [[names[i] for i in rng.integers(0, len(names), 3)] for _ in range(6)]

        def weight(path):
            total = field.start[path[0]] + sum(field.weights[f][s] for fs, s in zip(marks, path) for f in fs)
            return total + sum(field.steps[a, b] for a, b in zip(path, path[1:]))

        best = max(map(weight, itertools.product((0, 1), repeat=6)))
        assert weight(field.decode(marks)) == pytest.approx(best)


def test_held_out_layouts(field):
    wrong = total = 0
    for page, labels in html_text.labelled_pages(150, seed=123):
        got = field.decode(html_text.features(html_text.leaf_blocks(page)))
        assert len(got) == len(labels)
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong < 0.02 * total


def test_extract_keeps_every_row(spark):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><header><p>Site</p></header>"
        "<div class='cookie-notice'>We use cookies.</div><article><h1>A  title</h1><p>First &amp; only\nparagraph, with <b>bold</b> words.<div class='ad'>Buy it.</div>"
        "<p>Second one.</p></article><div id='comments'><p>Nice post, friend!</p></div><form><label>Mail</label></form><footer>&copy; x</footer>"
    )
    pages = spark.createDataFrame([(1, "u", page, "c"), (2, "u", "", "c"), (3, None, None, "c"), (None, "u", page, "c"), (1, "u", page, "c")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    want = "A title\nFirst & only paragraph, with bold words.\nSecond one."
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in got) == [(0, want, len(want)), (1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from fluoroframe.llm import simhash

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != "sentencepiece":
            assert out.columns == columns
        kept.append(out.count())
        if name == "simhash":
            prints = [simhash.fingerprint(r.text or "", 5) for r in docs.collect()]
            mine = {r.doc_id: simhash.fingerprint(r.text or "", 5) for r in out.collect()}
            values = np.array(list(mine.values()), dtype=np.uint64)
            for p in prints:
                assert np.bitwise_count(values ^ np.uint64(p)).min() <= 64
            for i, v in enumerate(values):
                assert np.bitwise_count(values[:i] ^ v).min(initial=64) > 2
        docs = out
    assert all(a >= b for a, b in zip([1000, *kept], kept)) and kept[-1] == kept[-2] and docs.where("not same").count() == 0


def test_pipeline_workers_hold_little(spark):
    """Batches of long texts end early, and no worker keeps what it remembered for another operator."""
    import sys

    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F

    from fluoroframe.llm import toxicity
    from fluoroframe.llm.common import worker_memo

    dict(pipeline.STAGES)["toxicity"](spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "/root/testdata/sf0.001")
    long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("word "), 20_000).alias("text"))

    @F.pandas_udf("long")
    def sizes(texts):
        return texts.map(lambda t: len(texts) * len(t))

    assert long.agg(F.max(sizes("text"))).first()[0] <= 2 * pipeline.BATCH_BYTES

    def remember(batches):
        for frame in batches:
            worker_memo("of another operator", lambda: 1)
            yield frame

    one = long.limit(1)
    one.mapInPandas(remember, "text string").count()

    @F.pandas_udf("boolean")
    def kept(scores):
        return scores.map(lambda _: "of another operator" in sys.__dict__.get("_fluoroframe_memo", {}))

    scored = spark.range(64, numPartitions=8).select(toxicity.toxicity(F.lit("a"), toxicity.Lexicon({"b": 1.0})).alias("s"))
    scored.write.format("noop").mode("overwrite").save()
    assert not scored.select(kept("s").alias("k")).where("k").count()


def test_only_attributes_that_hide_do():
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    for attrs in ('aria-hidden="false"', 'class="hidden md:block"', 'data-hidden="1"', "title='display: none'", 'style="x-display:none-ish"'):
        assert texts(f"<article {attrs}><p>kept</p></article>") == ["kept"], attrs
    for attrs in ("hidden", 'hidden=""', "HIDDEN id=a", 'aria-hidden="true"', "style='color: red; display : none'"):
        assert texts(f"<div {attrs}><p>gone</p></div><p>kept</p>") == ["kept"], attrs


def test_no_other_element_loses_its_text():
    page = "<article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><noscript>c</noscript><video>d</video><xmp>e</xmp></article>"
    assert [b.text for b in html_text.leaf_blocks(page)] == ["a x=2 b", "cd", "e"]
    assert [b.text for b in html_text.leaf_blocks('<p title="abc>text</p><p>more</p>')] == ["text", "more"]


def test_deep_and_long_pages_take_linear_time():
    start = time.perf_counter()
    blocks = html_text.leaf_blocks("<div class='a'>x" * 20_000 + "</section>" * 20_000)
    assert len(blocks) == 20_000 and blocks[-1].parent == "div" and time.perf_counter() - start < 5
    assert len(html_text.leaf_blocks("<p>" + "word " * 300_000)[0].text) == 1_499_999
