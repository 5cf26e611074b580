"""Fill-in-the-middle against slicing by code points, and the learned index against the boundaries themselves."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import awkward, docs_of, empty, words
from tidemark.llm.infill import ERROR, RankIndex, boundaries, draws, fill_in_middle, restored


def mixed_text(n, seed=3):
    r = random.Random(seed)
    return "".join(r.choice(r.choice(["abc xyz", "éàü", "中文字", "\U0001f600\U0001f680"])) for _ in range(n))


def plain_rule(doc_id, text, seed=1, rate=90, suffix_first=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("text", ["", "a", "plain ascii " * 3000, "é" * 20_000, mixed_text(30_000), "a" * 9000 + "中" * 9000])
def test_index_is_exact(text):
    raw = text.encode()
    ends = boundaries(raw)
    index = RankIndex(ends)
    assert len(ends) == len(text) + 1
    assert index.offset(*range(len(ends))) == ends.tolist()
    assert np.abs(ends - index.predict(np.arange(len(ends)))).max() <= ERROR + 1
    if text.isascii():
        assert len(index.starts) == 1 and not index.residuals.any()


def test_segments_are_few():
    ends = boundaries(mixed_text(50_000).encode())
    assert len(RankIndex(ends).starts) < len(ends) / 500


def test_words_are_units_too():
    raw = "  one two\n\nthree é".encode()
    ends = boundaries(raw, "word")
    parts = [raw[a:b] for a, b in zip(ends, ends[1:])]
    assert b"".join(parts) == raw and [p.split() for p in parts if p.split()] == [[w.encode()] for w in words(raw.decode())]


def test_against_plain_slicing(spark):
    texts = [mixed_text(n, n) for n in range(0, 90)] + ["has <P> inside", "has <M>", "a<S", "<<", ">x<", None] + ["<P" * 40] * 20
    out = fill_in_middle(docs_of(spark, texts)).withColumn("back", restored()).collect()
    assert len(out) == len(texts)
    for r in out:
        want = plain_rule(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["back"] == (texts[r["doc_id"]] or "")
    assert {"plain", "psm", "spm"} == {r["form"] for r in out}


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    out = fill_in_middle(docs).withColumn("back", restored())
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["output"], r["back"]) for r in out.collect())
    want = []
    for r in docs.collect():
        n, form, _, _, output = plain_rule(r["doc_id"], r["text"])
        want.append((str(r["doc_id"]), n, form, output, r["text"] or ""))
    assert got == sorted(want)
    assert fill_in_middle(empty(spark)).count() == 0


def test_rate_and_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text to cut").alias("text"))
    share = {r["form"]: r["count"] / 4000 for r in fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.02 and abs(share["spm"] - 0.18) < 0.02
    assert fill_in_middle(docs, rate=0).where("form <> 'plain'").count() == 0
    words_cut = fill_in_middle(docs, unit="word").withColumn("back", restored())
    assert words_cut.where("back <> 'some text to cut' OR n <> 4").count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="token")


def test_draws_depend_on_id_and_seed():
    assert draws(7, 1) != draws(8, 1) and draws(7, 1) != draws(7, 2) and draws(None, 1) == draws(None, 1)
