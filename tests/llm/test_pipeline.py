"""The pipeline's stages, the registered queries, and the library without this subpackage."""

import os
import random
import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from llm.test_filters import BAD, ITEMS, labelled
from llm.test_jaccard import plain as plain_groups
from llm.test_substring import plain as plain_repeats
from llm.texts import awkward, docs_of, empty, random_texts, words
from tidemark.llm import jaccard

SF_DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Tables with toxic documents, copies, repeated passages and benchmark questions."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    toxic, labels = labelled(spark, 300)
    more = random_texts(12, 60) + ["Well. " + ITEMS[1] + ".", None, "", "fine words here"]
    toxic.unionByName(docs_of(spark, more, 300)).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_do_their_work_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        if name != "packing":
            assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
        texts = {r.doc_id: r.text for r in before.collect()}
        if name == "toxicity":
            gone = set(texts) - kept[name]
            bad = {d for d, t in texts.items() if t and any(b in t for b in BAD)}
            assert len(gone - bad) == 0 and len(bad - gone) <= 3
        elif name == "near_duplicates":
            order = sorted(texts)
            groups = plain_groups([texts[d] for d in order], 5, 80, 100)
            assert kept[name] == {order[i] for i, _, root in groups if i == root}
        elif name == "repeated_passages":
            order = sorted(texts)
            want = {order[d]: n - gone for d, n, gone, _ in plain_repeats([texts[d] for d in order], 50) if not gone or gone < n}
            assert {r.doc_id: len(words(r.text)) for r in docs.collect()} == want
        elif name == "contamination":
            assert set(texts) - kept[name] == {360}
    assert kept["packing"] == kept["contamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == kept["packing"]


def test_stages_on_awkward_and_empty_tables(spark, sf_dir):
    for docs, n in ((awkward(spark), 13), (empty(spark), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir).cache()
            n = min(n, docs.count()) if n else docs.count()
    # null and empty texts, texts of one word, and one of each group of copies are left
    assert n == 0


def test_unlike_rows_of_one_id_stay_and_repeated_rows_go(spark, sf_dir):
    texts = ["one two three four five six", "something else entirely here now", "one two three four five six"]
    docs = docs_of(spark, texts[:1]).union(docs_of(spark, texts[1:2])).union(docs_of(spark, texts[:1]))
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.text for r in kept.collect()) == sorted(texts[:2])


def test_near_duplicates_among_texts_that_repeat_a_line(spark, sf_dir, monkeypatch):
    """Documents over one tree's number that share a line are not compared for it; copies still go."""
    r = random.Random(3)
    line = " ".join(f"line{i}" for i in range(40))
    body = lambda: " ".join(f"{r.random():.9f}" for _ in range(90))
    texts = [f"{line} {body()}" for _ in range(90)]
    texts += [" ".join(t.split()[:-3]) for t in texts[::3]]
    sent = {}
    plainly = jaccard.written

    def noted(df, name):
        out = plainly(df, name)
        sent[name] = out.count()
        return out

    join = lambda docs, **kw: jaccard.ngram_jaccard_join(docs, **kw, block_docs=20)
    monkeypatch.setattr(jaccard, "written", noted)
    monkeypatch.setattr(corpus_pipeline, "ngram_jaccard_join", join)
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), sf_dir)
    assert sorted(row.doc_id for row in kept.collect()) == list(range(90))
    assert sent["fitting-members"] == 60


def test_all_queries_are_registered_and_run(spark):
    names = entry_points.queries()
    ops = [n for n in names if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in ops) == list(range(1, 14)) and "pipeline" in names
    assert set(entry_points.oracle_sql()) <= set(names)
    if os.path.isdir(SF_DIR):
        for n in ops:
            found = names[n](spark, SF_DIR)
            assert found.columns and (found.limit(1).count() == 1 or n.split("_")[0] in ("op4", "op6"))  # these find few


def test_the_library_works_without_this_part(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "tidemark")
    for name in os.listdir(f"{ROOT}/tidemark"):
        if name != "llm":
            os.symlink(f"{ROOT}/tidemark/{name}", tmp_path / "tidemark" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'row_count' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
