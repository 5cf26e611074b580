"""Repeated passages against a dictionary of all windows."""

import hashlib

import pytest

from llm.texts import awkward, docs_of, empty, random_texts, words
from tidemark.llm.substring import substring_dedup


def plain(texts, k):
    first = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = set()
    for d, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.add((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("k", [13, 50, 3])
def test_removed_words_are_those_of_the_rule(spark, k):
    texts = random_texts(k, 80)
    got = substring_dedup(docs_of(spark, texts), k).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain(texts, k)
    for r in got:
        if r.n_removed == 0:
            assert r.kept_text == texts[r.doc_id]
        assert hashlib.sha256(" ".join(words(r.kept_text)).encode()).hexdigest() == r.kept_sha256


def test_awkward_rows(spark):
    got = substring_dedup(awkward(spark)).collect()
    assert len(got) == 13
    by = {(r.doc_id, r.n_words): r.n_removed for r in got}
    # the second of the long texts goes whole; the first repeats only itself, which does not count
    assert by[6, 30_000] == 0 and by[7, 30_000] == 30_000 and by[1, 0] == by[2, 0] == by[3, 0] == 0 and by[None, 3] == 0
    assert substring_dedup(empty(spark)).count() == 0


def test_columns_that_clash_go_through(spark):
    docs = docs_of(spark, ["a b c d e f", "x a b c d e y"])
    got = substring_dedup(docs, 3, columns=("doc_id", "lang", "starts", "text_key", "key", "component"))
    assert got.columns[:6] == ["doc_id", "lang", "starts", "text_key", "key", "component"]
    assert {(r.starts, r.text_key, r.key, r.component) for r in got.collect()} == {("x", "z", "y", -2)}
    assert {r.kept_text for r in got.collect()} == {"a b c d e f", "x y"}
