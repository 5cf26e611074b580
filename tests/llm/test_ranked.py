"""Ranked search against scoring every document, with ties, awkward rows and blocks of all sizes."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

import tidemark.llm.ranked as ranked
from tests.llm.texts import awkward, docs_of, empty, lower
from tidemark.llm.ranked import Best, Block, ranked_search, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(lower(text))


def brute(docs, items, k):
    """Every document scored by the rule; docs: (doc_id, text) rows."""
    terms = [(i, terms_of(t)) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n_docs, n_terms = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    wanted = {}
    for item, text in items:
        if text is not None:
            wanted.setdefault(item, set()).update(terms_of(text))
    for item, q in wanted.items():
        scored = []
        for i, t in terms:
            m = 50 + (50 * len(t) * n_docs) // n_terms
            s = 0
            for w in q:
                tf = t.count(w)
                if tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    s += weight * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:k])]
    return out


def items_of(spark, rows):
    schema = T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType()),
        T.StructField("term", T.IntegerType())])
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], schema)


def corpus(seed=5, n=150):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(60)] + ["naïve", "中文", "x1", "éa"]
    odds = [1 / (i + 1) for i in range(len(vocab))]
    texts = [r.choice(". ,-\x7f\t").join(r.choices(vocab, odds, k=r.choice((0, 1, 4, 20, 80)))) for _ in range(n)]
    texts += [texts[3]] * 30 + [None, "", "...", "W0 " * 500]  # many ties
    items = [" ".join(r.choices(vocab, odds, k=k)) for k in (1, 2, 5, 12, 30)] + [None, "", "unheard of", "W0 W0 w0"]
    return texts, list(enumerate(items))


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k,size,pass_terms", [(10, 2_000_000, 500_000), (10, 40, 500_000), (50, 1, 500_000), (5, 300, 8)])
def test_against_every_document(spark, k, size, pass_terms):
    texts, items = corpus()
    got = ranked_search(docs_of(spark, texts), items_of(spark, items), k, pass_terms, size)
    assert tuples(got) == sorted(brute(list(enumerate(texts)), items, k))


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = [(1, "one three"), (1, "v5 café"), (None, "two"), (2, None), (3, "A" * 50_000), (4, "\U0001f600")]
    got = ranked_search(docs, items_of(spark, items), 4).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], items, 4)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert ranked_search(empty(spark), items_of(spark, items)).count() == 0
    assert ranked_search(docs, items_of(spark, [])).count() == 0


def test_terms_of_a_sliced_text(monkeypatch):
    raw = ("Ab-c\x00d é中 " * 500).encode()
    whole = term_counts(raw)
    monkeypatch.setattr(ranked, "SLICE_BYTES", 7)
    assert term_counts(raw) == whole
    assert whole[0] == 2000 and whole[1]["é中".encode()] == 500


def test_reading_stops_early():
    r = np.random.default_rng(1)
    n = 20_000
    at = np.concatenate((r.permutation(n)[:200], np.arange(n)))
    term = np.repeat([0, 1], (200, n))
    impact = np.concatenate((r.integers(900_000, 1_000_000, 200), r.integers(1, 1000, n)))
    block = Block(np.arange(n), np.zeros(n, bool), at, term, impact)
    best = Best(10)
    block.search([0, 1], best)
    total = np.zeros(n, np.int64)
    np.add.at(total, at, impact)
    assert best.score.tolist() == np.sort(total)[::-1][:10].tolist()
    poor = Block(np.arange(n), np.zeros(n, bool), np.arange(n), np.ones(n, np.int64), r.integers(1, 1000, n))
    assert poor.search([0, 1], best) == 0  # nothing of this block can reach the tenth best


def test_scores_beyond_64_bits_are_an_error():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([
        pa.array([1]), pa.array([False]), pa.array([1 << 40]), pa.array([[0]], pa.list_(pa.int32())), pa.array([[5]], pa.list_(pa.int64())),
    ], schema=ranked.INDEX)
    with pytest.raises(OverflowError):
        list(ranked.blocks_of([batch], np.array([1000]), 1 << 30, 1 << 41, 10))
    assert len(list(ranked.blocks_of([batch], np.array([1000]), 1000, 1 << 41, 10))) == 1
