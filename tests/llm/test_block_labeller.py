import html
import re

import numpy as np
import pytest

from echofold.llm.block_labeller import Features, BlockLabeller, extract_text, main_texts, page_texts, train, trained
from echofold.llm.html_blocks import blocks
from echofold.llm.html_samples import labelled

SF = "/root/testdata/sf0.01"


def article(page):
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", m[1] if m else "")
    return "\n\n".join(t for p in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split())))


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = page_texts(pages).collect()
    assert len(rows) == len(want) and all(r.n_chars == len(r.text) for r in rows)
    assert np.mean([r.text == want[r.page_id] for r in rows]) > 0.98


def test_held_out_made_up_pages():
    sets = [x for i in range(200) if (x := labelled(55_000_000 + i, blocks))[0]]
    p = trained().probabilities(Features([b for b, _ in sets]))
    y = np.array([v for _, ys in sets for v in ys])
    assert ((p >= 0.5) == y).mean() > 0.98


def test_gradients_are_the_slopes_of_the_loss():
    sets = [x for i in range(3) if (x := labelled(i, blocks))[0]]
    x, y = Features([b for b, _ in sets]), np.array([v for _, ys in sets for v in ys], np.float32)
    model = BlockLabeller(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradients(x, y)
    for k in ("Uf", "cb", "V", "v", "Wb"):
        at = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        old = model.p[k][at]
        losses = []
        for d in (1e-3, -1e-3):
            model.p[k][at] = old + d
            losses.append(model.gradients(x, y)[0])
        model.p[k][at] = old
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(float(g[k][at]), rel=0.02)


def test_training_is_repeatable():
    a, b = train(24, 1), train(24, 1)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_labels_do_not_depend_on_the_other_pages_of_a_batch():
    import echofold.llm.html_samples as s

    pages = [s.sample_page(i).replace(s.MARK, "") for i in range(40)]
    assert main_texts(pages, trained()) == [main_texts([p], trained())[0] for p in pages]


def test_blocks():
    page = """<!doctype html><head><title>T</title></head><body><!-- <p>no</p> --><script>if (a<b) "</p>"</script>
    <div class="top-Bar">x &amp; y<p>one <b>two</b>&nbsp;three<br>four<p>five<ul><li>a<li>b</ul>tail<a href="#">link</a> <</div>"""
    assert [(t, n) for t, _, n in blocks(page)] == [("x & y", 0), ("one two three four", 0), ("five", 0), ("a", 0), ("b", 0), ("taillink <", 4)]
    assert blocks(page)[0][1].elements() == [("body", ()), ("div", ("top", "bar"))]
    for odd in (None, "", "<", "<p", "</p></div>", "<p class='x", "text only", "<!--", "<script>", "<![CDATA[x]]>", "&#0; &bogus; <p>" * 3, "<a " * 2000, "<div>" * 5000):
        blocks(odd)
    assert [t for t, _, _ in blocks("<![CDATA[x]]>")] == ["x"]


def test_formulas_and_fallbacks_are_text():
    page = "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<noscript>no <b>script</b></noscript><object data=x>instead</object></p>"
    assert [t for t, _, _ in blocks(page)] == ["so x=2 holds", "no script", "instead"]


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x", "<a " * 350_000, "<p " * 100_000 + ">", "<!x" * 350_000, "<div>t" * 100_000 + "</span>" * 50_000, "<i>" * 100_000 + "<p>" * 100_000, "<a '\"" * 100_000 + ">" * 9, "<script></script" * 60_000, "<a \"'>x</a>" * 60_000])
def test_hostile_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    blocks(page)
    assert time.process_time() - began < 4


def test_forward_pass_against_a_plain_loop():
    x = Features([labelled(5, blocks)[0], labelled(6, blocks)[0]])
    model, at, got = BlockLabeller(3), 0, BlockLabeller(3).probabilities(x)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for length in x.lengths:
        rows = [np.concatenate([x.paths[x.path_of[i]], x.words[i], x.counts[i]]) for i in range(at, at + length)]
        seen = {}
        for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            h = c = np.zeros(24)
            for i in order:
                z = rows[i] @ model.p["W" + d] + h @ model.p["U" + d] + model.p["c" + d]
                c = sigmoid(z[24:48]) * c + sigmoid(z[:24]) * np.tanh(z[72:])
                h = sigmoid(z[48:72]) * np.tanh(c)
                seen[d, i] = h
        for i in range(length):
            assert got[at + i] == pytest.approx(sigmoid(float(np.concatenate([seen["f", i], seen["b", i]]) @ model.p["V"][:, 0] + model.p["v"][0])), abs=1e-4)
        at += length


def test_nulls_repeats_long_pages_and_clashing_columns(spark):
    long = "<article><h1>Ta re on</h1>" + "<p>Ta re on ili ver mu chen so la ent.</p>" * 6000 + "</article>"
    df = spark.createDataFrame([(1, None, None, "q"), (None, "u", "", "q"), (2, "u", long, "q"), (2, "u", long, "q")], "page_id long, url string, html string, text string")
    rows = page_texts(df).collect()
    assert sorted((r.page_id or 0, r.n_chars > 100_000) for r in rows) == [(0, False), (1, False), (2, True), (2, True)]
    assert {r.text for r in rows if r.page_id != 2} == {""} and page_texts(df.limit(0)).count() == 0
    assert extract_text(df).columns == ["page_id", "url", "html", "text"]
