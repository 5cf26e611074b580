"""Digests against plain loops over windows, the order of neighbours, and how well edited texts are told from others."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import tidemark.llm.similarity_digest as sd
from tests.llm.texts import awkward, docs_of, empty


def some_texts(seed=2, n=40):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghiéü中", k=r.randint(1, 9))) for _ in range(400)]
    return [" ".join(r.choices(vocab, k=r.choice((0, 1, 3, 10, 40, 200, 900)))) for _ in range(n)]


def level(window):
    most = round(sd.WIDTH * math.log2(sd.WIDTH) * 2**20)
    total = sum(round(c * math.log2(c) * 2**20) for c in Counter(window).values() if c > 1)
    return (most - total) * 1000 // most


def plain_places(raw, ranks):
    """The selected places of one text by loops."""
    w = [raw[i : i + sd.WIDTH] for i in range(len(raw) - sd.WIDTH + 1)]
    run = next(r for limit, r in sd.RUNS if limit is None or len(w) < limit)
    keys = [(ranks[level(x)], i) for i, x in enumerate(w)]
    return sorted({min(keys[i : i + run])[1] for i in range(max(len(w) - run + 1, min(len(w), 1)))})


def test_levels_and_counts():
    texts = [t.encode() for t in some_texts()] + [b"a" * 100, b"", b"abc"]
    want = Counter(level(t[i : i + sd.WIDTH]) for t in texts for i in range(len(t) - sd.WIDTH + 1))
    got = sd.level_counts(texts)
    assert {i: c for i, c in enumerate(got.tolist()) if c} == dict(want)


def test_features_are_the_least_of_runs():
    texts = [t.encode() for t in some_texts(7)] + [b"abc", b"x" * 500, b""]
    ranks = sd.ranks_of(sd.level_counts(texts))
    text, h = sd.features(texts, ranks)
    for i, raw in enumerate(texts):
        windows = [raw[p : p + sd.WIDTH] for p in plain_places(raw, ranks)]
        distinct = len(set(windows)) if len(raw) >= sd.WIDTH else min(len(raw), 1)
        assert (text == i).sum() == distinct
        alone = sd.features([raw], ranks)[1]  # what stands beside a text makes no difference
        assert alone.tolist() == h[text == i].tolist()


def test_digest_bits_and_order():
    texts = [t.encode() for t in some_texts(9)]
    ranks = sd.ranks_of(sd.level_counts(texts))
    for raw, filters in zip(texts, sd.digests(texts, ranks)):
        h = sd.features([raw], ranks)[1].tolist()
        assert len(filters) == -(-len(h) // sd.PER_FILTER)
        for k, row in enumerate(np.unpackbits(filters, axis=1)):
            part = h[k * sd.PER_FILTER : (k + 1) * sd.PER_FILTER]
            assert set(np.flatnonzero(row)) == {(x >> 12 * i) % sd.FILTER_BITS for x in part for i in range(sd.HASHES)}
        assert (sd.read_in(sd.written_out(filters)) == filters).all()


def test_likeness_of_edges():
    r = np.random.default_rng(3)
    a, b = (np.packbits(r.random((700, sd.FILTER_BITS)) < 0.3, axis=1) for _ in range(2))
    none = a[:0]
    assert sd.likeness(a, a) == 1 and sd.likeness(none, none) == 1 and sd.likeness(a, none) == 0
    assert sd.likeness(a[:3], b[:3]) < 0.05
    assert sd.likeness(a, b) == sd.likeness(b, a)
    assert abs(sd.likeness(a[:600], np.concatenate((b[:300], a[300:600]))) - 0.5) < 0.1


def wanted_edits(rows):
    """(doc_id, n, edited) by the rule, for rows (doc_id, text) with distinct ids or texts."""
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        out.append((i, len(t), t[: len(t) - len(t) // 3] + after[: len(t) // 3]))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 2_000, 1])
def test_edited_texts_in_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(sd, "BATCH_BYTES", 500)
    texts = some_texts(11, 60)
    got = sd.edited_likeness(docs_of(spark, texts, first=10).repartition(5), block_bytes).collect()
    rows = sorted(((10 + i, t) for i, t in enumerate(texts)), reverse=True)
    assert sorted((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == sorted(wanted_edits(rows))
    raw = [t.encode() for t in texts]
    ranks = sd.ranks_of(sd.level_counts(raw))
    prints = [sd.written_out(d) for d in sd.digests(raw, ranks)]
    for r in got:
        i = r["doc_id"] - 10
        after = prints[i - 1]
        assert r["fingerprint"] == prints[i]
        assert r["near_next"] == sd.likeness(sd.read_in(prints[i]), sd.read_in(after))
        assert r["near_edited"] == sd.likeness(sd.read_in(prints[i]), sd.read_in(r["edited_fingerprint"]))


def test_awkward_rows(spark):
    got = sd.edited_likeness(awkward(spark), 100).collect()
    want = [(r["doc_id"], len(r["text"] or "")) for r in awkward(spark).collect()]
    assert sorted(((r["doc_id"], r["n_chars"]) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    alone = {r["doc_id"]: r["fingerprint"] for r in sd.fingerprints(awkward(spark)).collect()}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
        assert r["doc_id"] in (None, 5) or alone[r["doc_id"]] == r["fingerprint"]
    assert all(len(v) == 1 for v in by_text.values())  # equal texts, equal fingerprints
    assert sd.edited_likeness(empty(spark)).count() == 0 and sd.fingerprints(empty(spark)).count() == 0
    one = sd.edited_likeness(docs_of(spark, ["abcdef"])).first()
    assert one["edited"] == "abcdab" and one["near_next"] == 1


def test_edited_texts_are_told_from_others(spark):
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(600)]
    docs = docs_of(spark, [" ".join(r.choices(vocab, k=r.randint(20, 600))) for _ in range(80)])
    got = sd.edited_likeness(docs).toPandas()
    assert got["near_edited"].min() > 0.35 and got["near_next"].max() < 0.2
