"""Exact Jaccard components against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from llm.texts import awkward, docs_of, empty, lower, random_texts, roots, words
from tidemark.llm import jaccard
from tidemark.llm.common import components
from tidemark.llm.jaccard import SignatureFilter, SignatureTree, bucket_keys, ngram_jaccard_join, signature


def shingles(text, n):
    w = words(lower(text))
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def plain(texts, n, num, den):
    sets = [shingles(t, n) for t in texts]
    links = [
        (i, j) for j in range(len(sets)) for i in range(j)
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])
    ]
    root = roots(range(len(texts)), links)
    return {(i, len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("num,den,n", [(85, 100, 4), (80, 100, 5), (50, 100, 2), (100, 100, 3)])
def test_components_are_those_of_all_pairs(spark, num, den, n):
    texts = [t.title() if i % 7 == 0 else t for i, t in enumerate(random_texts(num + n, 80))]
    got = ngram_jaccard_join(docs_of(spark, texts), n, num, den).collect()
    assert {tuple(r) for r in got} == plain(texts, n, num, den)


def test_blocks_of_a_large_cluster_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 3)
    texts = random_texts(3, 90, 120)
    got = ngram_jaccard_join(docs_of(spark, texts), 2, 60, 100, block_docs=3).collect()
    assert {tuple(r) for r in got} == plain(texts, 2, 60, 100)


def test_linked_sets_share_a_bucket():
    r = np.random.default_rng(2)
    for _ in range(400):
        size = int(r.integers(6, 600))
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        b = a[r.random(len(a)) > r.random() * 0.15]
        b = np.unique(np.r_[b, r.integers(0, 2**63, int(r.integers(0, size * 0.1 + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
            assert len(np.intersect1d(bucket_keys(a, 85, 100), bucket_keys(b, 85, 100)))


def test_tree_finds_what_all_pairs_find():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 5000, int(n)).astype(np.uint64)) for n in r.integers(3, 200, 12)]
    sets = [np.unique(np.r_[b[r.random(len(b)) > 0.08], b[:1]]) for b in base for _ in range(8)]
    tree = SignatureTree(sets)
    tree.join(80, 100)
    links = [(i, j) for j in range(len(sets)) for i in range(j)
             if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)]
    want = roots(range(len(sets)), links)
    groups = lambda f: {frozenset(i for i in want if f(i) == f(k)) for k in want}
    assert groups(tree.find) == groups(want.get)


def test_signatures_rule_out_no_link():
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 2**63, int(n)).astype(np.uint64)) for n in (3, 40, 900, 1100, 2100, 60000)]
    sets = [np.unique(np.r_[b[r.random(len(b)) > 0.06], b[:1]]) for b in base for _ in range(4)]
    found = SignatureFilter([len(s) for s in sets], [signature(s) for s in sets])
    found.join(80, 100)
    for j in range(len(sets)):
        for i in range(j):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                assert found.find(i) == found.find(j)
    assert len({found.find(i) for i in range(4, len(sets))}) >= 5  # unlike sets stay apart


def test_a_text_goes_along_once(spark, monkeypatch):
    """Sets share single-shingle buckets with many unlike ones, but texts go only where a link is possible."""
    r = random.Random(6)
    common = [f"c{i} c{i} c{i} c{i}" for i in range(60)]
    body = lambda: " ".join(f"{r.random():.9f}" for _ in range(20))
    texts = [" ".join(f"{c} {body()}" for c in r.sample(common, 12)) for _ in range(60)]
    texts += [" ".join(t.split()[:-2]) for t in texts[::3]]
    sent = {}
    plainly = jaccard.written

    def noted(df, name):
        out = plainly(df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", noted)
    got = ngram_jaccard_join(docs_of(spark, texts), 4, 85, 100).collect()
    assert {tuple(row) for row in got} == plain(texts, 4, 85, 100)
    assert sent["fitting-members"] > 60 and sent["bands"] == 40


def test_a_line_that_many_texts_repeat_is_no_cluster(spark, monkeypatch):
    """Texts that share a line, as long as a link allows to differ in, meet only their own near copies."""
    r = random.Random(8)
    line = " ".join(f"line{i}" for i in range(30))
    body = lambda: " ".join(f"{r.random():.9f}" for _ in range(r.choice((60, 90))))
    texts = [f"{body()} {line} {body()}" for _ in range(120)]
    texts += [" ".join(t.split()[:-2]) for t in texts[::6]]
    sent = {}
    plainly = jaccard.written

    def noted(df, name):
        out = plainly(df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", noted)
    got = ngram_jaccard_join(docs_of(spark, texts), 4, 85, 100, block_docs=50).collect()
    assert {tuple(row) for row in got} == plain(texts, 4, 85, 100)
    assert sent["fitting-members"] == sent["bands"] == 40


@pytest.mark.parametrize("num,den,n", [(85, 100, 4), (80, 100, 5), (50, 100, 2), (100, 100, 3)])
def test_components_with_counted_shingles_are_those_of_all_pairs(spark, num, den, n):
    texts = random_texts(num + n, 80)
    got = ngram_jaccard_join(docs_of(spark, texts).repartition(5), n, num, den, block_docs=40).collect()
    assert {tuple(r) for r in got} == plain(texts, n, num, den)


def test_linked_sets_share_a_bucket_in_any_order_of_shingles():
    r = np.random.default_rng(9)
    levels = r.integers(0, 227, jaccard.CELLS).astype(np.uint8)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, int(r.integers(6, 600))).astype(np.uint64))
        b = a[r.random(len(a)) > r.random() * 0.15]
        b = np.unique(np.r_[b, r.integers(0, 2**63, int(r.integers(0, len(a) * 0.1 + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
            assert len(np.intersect1d(bucket_keys(a, 85, 100, levels), bucket_keys(b, 85, 100, levels)))
    order = np.argsort(levels[jaccard._cells(a)], kind="stable")
    assert bucket_keys(a, 85, 100, levels).tolist() == a[order][: len(bucket_keys(a, 85, 100))].tolist()


def test_levels_grow_with_the_texts_that_hold_a_shingle(spark):
    texts = [f"a b c d{i}" for i in range(300)] + [f"e f{i % 2} g" for i in range(20)] + [None, ""]
    levels = jaccard._levels(docs_of(spark, texts).repartition(4), 3)
    level = lambda t: int(levels[jaccard._cells(jaccard.shingle_set(t, 3))[0]])
    assert level("a b c") > level("e f0 g") == level("e f1 g") > level("b c d7") == level("b c d9") > level("not there at all"[:7])
    counts = np.r_[np.zeros(100), np.ones(50), 2, 70_000, 2.0**40].astype(np.uint64)
    assert (np.diff(jaccard.levels_of(counts).astype(int)[[0, 100, 150, 151]]) > 0).all()
    assert jaccard.levels_of(np.zeros(8, np.uint64)).tolist() == [0] * 8


def test_groups_are_whole_across_batches():
    rows = pd.DataFrame({"k": [1, 1, 1, 1, 2, 3, 3, 3], "j": [1, 1, 1, 1, 1, 1, 1, 2], "v": range(8)})
    want = [[0, 1, 2, 3], [4], [5, 6], [7]]
    for cuts in ([0, 8], [0, 2, 3, 3, 4, 6, 8], list(range(9)), [0, 4, 5, 7, 8]):
        frames = [rows.iloc[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
        assert [g["v"].tolist() for g in jaccard._whole_groups(frames, ["k", "j"])] == want
    assert list(jaccard._whole_groups([rows[:0]], ["k"])) == []


@pytest.mark.parametrize("block_docs", [2, 4000])
def test_unlike_texts_of_one_doc_id_keep_their_links(spark, block_docs):
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    docs = spark.createDataFrame(
        [(5, a), (5, b), (6, f"{a} x"), (7, f"{b} x"), (8, f"{a} y"), (9, f"x {b}"), (5, a)], "doc_id long, text string")
    got = ngram_jaccard_join(docs, 4, 85, 100, block_docs=block_docs).collect()
    assert sorted(r.doc_id for r in got) == [5, 5, 5, 6, 7, 8, 9] and {r.component_id for r in got} == {5}


def test_awkward_rows(spark):
    got = ngram_jaccard_join(awkward(spark)).collect()
    assert len(got) == 13
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[1, 0] == 1 and by[2, 0] == 2 and by[3, 0] == 3 and by[4, 1] == 4 and by[6, 700] == by[7, 700] == 6
    assert by[None, 1] is None and by[None, 0] is None
    assert ngram_jaccard_join(empty(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(100, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
