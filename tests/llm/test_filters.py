"""Toxicity chain, benchmark decontamination and license scan."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from llm.texts import awkward, docs_of, empty, random_texts
from tidemark.llm.decontaminate import ORACLE, decontaminate
from tidemark.llm.licenses import TEMPLATES, Scanner, license_scan, words_in
from tidemark.llm.toxicity import SLOTS, features_of, fit, predict, toxicity, train_chain

BAD = ["blorf", "zorgwort", "krunkel"]


def labelled(spark, n=400, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=30)
        toxic = i % 5 == 0
        low = i % 3 == 0
        if toxic:
            w[3], w[9] = r.choice(BAD), r.choice(BAD) + r.choice(("ig", "", "en"))
        text = " ".join(x + "%%%" for x in w) if low else " ".join(w)
        rows.append(text)
        labels.append((i, int(not low), int(toxic)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_is_right_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity(docs, labels.where("doc_id < 250")).where("doc_id >= 250").collect()
    assert len(got) == 150
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in got]) >= 0.95
    assert np.mean([(r.p_quality >= 0.5) == (r.doc_id % 3 != 0) for r in got]) >= 0.95


def test_chain_feeds_earlier_probabilities_to_later_models(spark):
    docs, labels = labelled(spark)
    models = train_chain(docs, labels)
    assert [len(m) for m in models] == [SLOTS + 1, SLOTS + 2]
    # the same labels as an earlier category make its log-odds tell nearly all
    again = labels.withColumn("quality", labels["toxic"])
    assert train_chain(docs, again)[1][SLOTS] > 0.3


def test_the_chain_does_not_depend_on_the_order_of_rows(spark):
    docs, labels = labelled(spark, 120)
    docs = docs.union(docs_of(spark, ["another text of the same id", "zz zz"], 3)).union(docs)
    labels = labels.union(spark.createDataFrame([(5, 0, 1), (300, 1, 1)], "doc_id long, quality int, toxic int"))
    first, second = train_chain(docs, labels), train_chain(docs.orderBy("text").repartition(7), labels.repartition(3))
    assert all((a == b).all() for a, b in zip(first, second))


def test_fit_without_rows_or_with_one_class():
    slots = [features_of("a b"), features_of("c")]
    assert predict(fit([], np.zeros((0, 0)), np.zeros(0)), slots[0], []) < 1e-3
    assert predict(fit(slots, np.zeros((2, 0)), np.ones(2)), slots[1], []) > 0.9


def test_toxicity_of_awkward_rows(spark):
    _, labels = labelled(spark, 20)
    assert toxicity(awkward(spark), labels).count() == 13
    assert toxicity(empty(spark), labels).count() == 0
    none = labels.selectExpr("doc_id", "cast(null as int) quality", "toxic")
    assert toxicity(awkward(spark), none).where("toxic").count() == 0


ITEMS = [
    "A train leaves Paris at 9 with 120 people and reaches the old town after 3 hours with 75 people left",
    "How many of the green birds that sing before noon are still there when the rain has stopped again",
    "tiny item of five words",
    None, "", "7 7 7 7 7 7 7 7 7",
    "What is 37 * 48 + 120?", "Hello", "2 + 2 = ?",
    "Then Tom has 3 apples and Anna has 4 pears, so how many more apples must Tom buy to have 9 in all",
    "In the first round Kim gave 5 coins and in the next round Kim gave 5 coins again before the game was over for good",
]


@pytest.fixture(scope="module")
def cases(spark):
    texts = [
        "So it goes. " + ITEMS[1] + ". And so on.",
        "So it goes. " + ITEMS[1].upper() + "!!! And so on.",
        "A train leaves London at 8 with 340 people and reaches the old town after 5 hours with 60 people left.",
        # two item values stand for one value here, which other figures may do
        "A train leaves London at 8 with 340 people and reaches the old town after 8 hours with 60 people left.",
        "There is a tiny item of five words in here", "nothing of the kind is in this text at all, as far as one can see",
        None, "", " ".join(f"t{i}" for i in range(3000)) + " " + ITEMS[1], "7 7 7 7 7 7 7 7 7 7 7",
        "Before noon. What is 37 * 48 + 120? Nobody knew.",  # 10: exact arithmetic
        "Before noon. What is 38 * 48 + 120? Nobody knew.",  # its template is all that is left, which is too little
        "Then Tom has 7 apples and Anna has 7 pears, so how many more apples must Tom buy to have 12 in all",  # 12
        "Then Tom has 5 apples and Anna has 9 pears, so how many more apples must Tom buy to have 12 in all",
        # 14: one item value stands for two values; the windows that hold the rarer one are dropped
        "In the first round Kim gave 6 coins and in the next round Kim gave 8 coins again before the game was over for good",
        "she said hello to us", "Hello", "hello!", "It is 2 2 today", "2 2", "3 2",  # 15 to 20
    ] + random_texts(8, 30)
    docs = docs_of(spark, texts)
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    return docs, items


def test_decontamination_finds_exact_and_reparameterised(spark, cases):
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate(*cases).collect()}
    assert got == {
        (0, 1): True, (1, 1): True, (2, 0): False, (3, 0): False, (4, 2): True, (8, 1): True, (9, 5): True, (10, 6): True,
        (12, 9): False, (13, 9): False, (14, 10): False, (16, 7): True, (17, 7): True, (19, 8): True,
    }


def test_a_clash_drops_its_windows_only(spark, cases):
    found = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows) for r in decontaminate(*cases).collect()}
    matched, windows = found[14, 10]
    assert 0 < matched < windows and found[12, 9][0] == found[12, 9][1]


def test_exact_windows_are_all_those_poor_in_plain_words(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.decontaminate import LEAST_PLAIN, _exact_hash, _exact_windows, slots_of

    r = random.Random(3)
    texts = [[r.choice(["#q1", "#nb", "a", "b", "c"]) for _ in range(r.randrange(14))] for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    df = df.withColumn("s", slots_of(F.col("t")))
    got = df.select("i", F.explode(_exact_windows(F.col("t"), F.col("s"), [2, 4, 5, 8])).alias("x"))
    got = got.select("i", "x.at", "x.h").collect()
    want = [
        (i, at + 1, t[at : at + k]) for i, t in enumerate(texts) for k in (2, 4, 5, 8) for at in range(len(t) - k + 1)
        if (len(t) == k if k < LEAST_PLAIN else sum(x[0] != "#" for x in t[at : at + k]) < LEAST_PLAIN)]
    hashed = spark.createDataFrame(want, "i int, at int, p array<string>").select("i", "at", _exact_hash(F.col("p")).alias("h"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, hashed.collect()))


def test_decontamination_equals_its_sql(spark, cases):
    documents, benchmark = (c.toPandas() for c in cases)  # noqa: F841  (DuckDB reads them by name)
    want = duckdb.sql(ORACLE).fetchall()
    got = decontaminate(*cases).select("doc_id", "item_id", "n_matched", "n_windows", "exact").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_decontamination_of_awkward_rows(spark, cases):
    assert decontaminate(awkward(spark), cases[1]).count() == 0
    assert decontaminate(empty(spark), cases[1]).count() == 0
    assert decontaminate(cases[0], cases[1].limit(0)).count() == 0


def plain_scan(text, least=0.9):
    """All runs of segments of a text against all templates."""
    from tidemark.llm.licenses import _CUT

    parts = [w for p in _CUT.split(text) if (w := words_in(p))]
    best = {}
    for name, templates in TEMPLATES.items():
        for t in templates:
            tw = words_in(t)
            want = Counter(zip(tw, tw[1:]))
            for i in range(len(parts)):
                for j in range(i, len(parts)):
                    w = sum(parts[i : j + 1], [])
                    if len(w) > 1:
                        have = Counter(zip(w, w[1:]))
                        dice = 2 * sum((have & want).values()) / (len(w) + len(tw) - 2)
                        if dice >= least:
                            best[name] = max(best.get(name, 0), dice)
    return best


def test_licenses_are_those_of_all_passages(spark):
    r = random.Random(6)
    flat = [(n, t) for n, ts in TEMPLATES.items() for t in ts]
    texts = []
    for n, t in flat:
        w = t.split(" ")
        if len(w) > 30:
            w[r.randrange(len(w))] = "changed"
            w[10] = "\n" + w[10]
        texts.append("Some words before.\n" + " ".join(w) + "\nAnd the rest under the license of the day.")
    texts += random_texts(2, 10) + ["Released under", "the\nMIT License", flat[0][1] * 3]
    scan = Scanner(TEMPLATES, 0.9)
    for t in texts:
        assert {n: d for n, d, _, _ in scan(t)} == pytest.approx(plain_scan(t))
    got = license_scan(docs_of(spark, texts))
    assert {r.doc_id for r in got.collect()} >= set(range(len(flat)))
    assert license_scan(awkward(spark)).count() == license_scan(empty(spark)).count() == 0


def test_licenses_of_other_versions_and_full_texts(spark):
    from tidemark.llm.licenses import FURTHER, all_templates

    both = FURTHER["GPL-2.0"][0] + "\nAnd another file of this work.\n" + TEMPLATES["GPL-3.0"][1].replace("useful", "useless")
    cases = [({n}, t) for n, ts in all_templates().items() for t in ts]
    cases += [({n}, "Before.\n" + max(all_templates()[n], key=len) + "\nAfter.") for n in ("GPL-3.0", "Apache-2.0", "AGPL-3.0")]
    cases += [({"GPL-2.0", "GPL-3.0"}, both)]
    found = license_scan(docs_of(spark, [t for _, t in cases])).collect()
    assert [{r.license for r in found if r.doc_id == i} for i in range(len(cases))] == [n for n, _ in cases]
