"""HTML extraction and vector near-duplicates."""

import numpy as np
import pytest

from llm.texts import roots
from tidemark.llm.html_text import blocks_of, default_field, labelled_pages, main_text
from tidemark.llm.vectors import sorted_projection_join


def test_field_is_right_on_pages_it_was_not_trained_on():
    field, right, total = default_field(), 0, 0
    for page, labels in labelled_pages(150, seed=77):
        blocks = blocks_of(page)
        assert len(blocks) == len(labels)
        right += (field.decode([f for _, f in blocks]) == np.array(labels)).sum()
        total += len(labels)
    assert right / total >= 0.98


def test_viterbi_finds_the_best_of_all_paths():
    field = default_field()
    for page, _ in labelled_pages(30, seed=8):
        blocks = [f for _, f in blocks_of(page)][:10]
        s, m = field.scores(blocks), field.moves
        value = lambda y: sum(s[t, y[t]] for t in range(len(y))) + sum(m[a, b] for a, b in zip(y, y[1:]))
        best = max(value([k >> t & 1 for t in range(len(blocks))]) for k in range(1 << len(blocks)))
        assert value(field.decode(blocks).astype(int).tolist()) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Logo</a></header><nav class="menu"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work as well as it can.</div>
<article><h1>The  title</h1><p>First &amp; <b>bold</b>&nbsp;words&#33;<br>go on
here. A sentence of some length follows this one.<p>Second <a href="x">linked</a> paragraph, which is not closed.
<div class="ad">Buy this thing now</div><ul><li>An item of the list</li></ul></article>
<section class="comments"><div class="comment"><p>I do not agree with this article at all. It is wrong.</p></div></section>
<form><label>Your mail</label><button>Send</button></form><footer>&copy; 2024 Someone</footer></body>"""


def test_main_text_of_a_page_and_of_awkward_ones(spark):
    rows = [(1, "u", PAGE, 1), (2, "u", None, 1), (3, None, "", 1), (None, "u", "<p", 1), (4, "u", "<nav><a href=x>y</a></nav>", 1),
            (5, "u", "<article>" + "<p>one more line of this text.</p>" * 5000 + "</article>", 1), (1, "u", PAGE, 1)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7
    assert by[1].text == (
        "The title\nFirst & bold words! go on here. A sentence of some length follows this one.\n"
        "Second linked paragraph, which is not closed.\nAn item of the list")
    assert by[2].text == by[3].text == by[4].text == "" and by[2].n_chars == 0
    assert by[5].text.count("\n") == 4999 and by[5].n_chars == len(by[5].text)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page,want", [
    ('<p title="a > b">Body<p title=\'<b>\'>two', ["Body", "two"]),
    ("<p title=don't>Body</p><p>it's</p>", ["Body", "it's"]),
    ('<p title="never closed>Body</p><p>two', ["Body", "two"]),
    ("<article><p>One.<svg><p>Two", ["One.", "Two"]),
    ("<article><p>One.<noscript><p>Two", ["One.", "Two"]),
    ("<article><p>One.<object>x</article><p>Two", ["One.", "Two"]),
    ("<div>One <iframe>no <div>no</div></div><svg><svg></svg></svg>Two", ["One", "Two"]),
    ("<p>One <noscript><p>no</p><div>no</noscript> more <svg><path d='M>'/><text>no</text></svg>end", ["One more end"]),
    ("<p>a<template><p>no<template>no</template></template>b<svg/>c<math>no</math>", ["a bc"]),
    ("<p>a<script>if (a < b) { x = '<p>' }</script>b<textarea>no</textarea><style>no", ["a b"]),
    ("<div>One<svg>no<div>Two<svg>no</svg></div>", ["One", "Two"]),
])
def test_blocks_of_markup_with_quotes_and_unclosed_elements(page, want):
    assert [t for t, _ in blocks_of(page)] == want


def vectors(spark, seed=4, n=400, dim=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 4, dim))
    rows = []
    for i in range(n):
        v = base[r.integers(0, len(base))] + r.standard_normal(dim) * r.choice([0, 0.01, 0.1, 0.3])
        rows.append((i, [float(x) for x in v.astype("float32")], int(r.integers(0, 3))))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, near int, unit string"


def plain(rows, cosine=0.93):
    links = {}
    ok = [(i, np.array(v, float), g) for i, v, g in rows]
    for k, (i, v, g) in enumerate(ok):
        for j, w, h in ok[:k]:
            if g == h and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links.setdefault(i, set()).add(j)
                links.setdefault(j, set()).add(i)
    return links


@pytest.mark.parametrize("window,block", [(1500, 6000), (20, 40)])
def test_links_and_recall(spark, window, block):
    rows = vectors(spark)
    got = sorted_projection_join(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), window=window, block=block).collect()
    want = plain(rows)
    found, true = sum(r.n_links for r in got), sum(map(len, want.values()))
    assert len(got) == len(rows) and all(r.n_links <= len(want.get(r.vec_id, ())) for r in got)
    assert found >= 0.9 * true
    if found == true:
        root = roots([r[0] for r in rows], [(a, b) for a, bs in want.items() for b in bs])
        assert {r.vec_id: r.component_id for r in got} == root and all(r.kept == (root[r.vec_id] == r.vec_id) for r in got)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0], 1),
            (11, [3e38, 0.0], 1), (12, [1e-40, 0.0], 1)]
    got = sorted_projection_join(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert len(got) == 14
    linked = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert all(linked[i] == (3, 1) for i in (1, 2, 11, 12))
    assert all(linked[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert sorted_projection_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_in_labels_many_times_the_window(spark):
    r = np.random.default_rng(11)
    base = r.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.standard_normal(base.shape)
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    both = np.concatenate([base, 0.935 * base + (1 - 0.935**2) ** 0.5 * side])
    rows = [(i, [float(x) for x in v], 1, 1, "x") for i, v in enumerate(both)]
    got = sorted_projection_join(spark.createDataFrame(rows, SCHEMA), window=4, block=2000).toPandas()
    assert (got["n_links"] > 0).mean() >= 0.93


def test_copies_and_tight_groups_larger_than_the_window(spark):
    r = np.random.default_rng(12)
    one, two = r.standard_normal((2, 16))
    group = [*[one] * 150, *(one + r.standard_normal((3, 16)) * 0.05), *(two + r.standard_normal((150, 16)) * 0.01), *r.standard_normal((200, 16))]
    rows = [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(group)]
    got = sorted_projection_join(spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA), window=10, block=40).collect()
    want = plain(rows)
    assert {x.vec_id: x.n_links for x in got} == {i: len(want.get(i, ())) for i, _, _ in rows}
    assert {x.component_id for x in got if x.vec_id < 153} == {0} and {x.component_id for x in got if 153 <= x.vec_id < 303} == {153}


@pytest.mark.parametrize("kind,of", [
    ("string", lambda g: f"class {g}"), ("long", lambda g: (1 << 40) + g), ("double", lambda g: [0.5, -0.0, float("nan")][g])])
def test_labels_of_other_types(spark, kind, of):
    rows = [(i, v, g) for i, v, g in vectors(spark)]
    schema = SCHEMA.replace("label int", f"label {kind}")
    named = [(i, v, of(g), 1, "x") for i, v, g in rows]
    got = sorted_projection_join(spark.createDataFrame(named, schema)).collect()
    want = plain([r for r in rows if of(r[2]) == of(r[2])])
    assert {r.vec_id: r.n_links for r in got} == {i: len(want.get(i, ())) for i, _, _ in rows}


def test_links_met_in_several_passes_count_once(spark):
    r = np.random.default_rng(13)
    centres = r.standard_normal((40, 16))
    group = [c + r.standard_normal(16) * 0.12 for c in centres for _ in range(12)]
    rows = [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(group)]
    many = [(*x, 1, "x") for x in rows]
    got = sorted_projection_join(spark.createDataFrame(many, SCHEMA), passes=12, window=30, block=100).collect()
    want = plain(rows)
    assert {x.vec_id: x.n_links for x in got} == {i: len(want.get(i, ())) for i, _, _ in rows}
    root = roots([i for i, _, _ in rows], [(a, b) for a, bs in want.items() for b in bs])
    assert {x.vec_id: x.component_id for x in got} == root


def test_unlike_rows_of_one_id_give_the_same_in_every_run(spark):
    rows = [(1, [1.0, 0.0], 1, 1, "x"), (2, [1.0, 0.0], 2, 1, "x"), (2, [0.0, 1.0], 1, 1, "x"), (3, [0.0, 1.0], 1, 1, "x")]
    for order in (rows, rows[::-1]):
        got = sorted_projection_join(spark.createDataFrame(order, SCHEMA).repartition(3)).collect()
        assert {(x.vec_id, x.n_links, x.component_id) for x in got} == {(1, 0, 1), (2, 1, 2), (3, 1, 2)}
