"""Small document tables with the awkward cases, and plain versions of the operators' rules."""

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # names that operators use inside
    T.StructField("n_words", T.LongType()), T.StructField("starts", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("text_key", T.StringType()), T.StructField("component", T.IntegerType()),
])


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def random_texts(seed=1, n=60, vocabulary=300):
    """Texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    passages = [" ".join(r.choices(vocab, k=r.choice((12, 13, 14, 30, 70)))) for _ in range(5)]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.2 and out:
            text = r.choice(out)
        elif kind < 0.5 and out and (base := words(r.choice(out))):
            for _ in range(r.randint(1, 3)):
                base[r.randrange(len(base))] = r.choice(vocab)
            text = " ".join(base)
        else:
            text = " ".join(r.choices(vocab, k=r.choice((0, 1, 3, 5, 8, 13, 40, 90))))
            if r.random() < 0.4:
                text += "\n" + r.choice(passages) + "  " + " ".join(r.choices(vocab, k=4))
        out.append(text)
    return out


def docs_of(spark, texts, first=0):
    """A table of these texts by doc_id; the further columns are set so that a mix-up would show."""
    rows = [(first + i, t, "en", -1, "x", "y", "z", -2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Null and empty texts, null ids, repeated rows and ids, ties, a very long text."""
    long = " ".join(f"v{i % 700}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (5, "one two three"), (6, long), (7, long),
        (None, "one two three"), (None, None), (8, "   \U0001f600 café " * 20), (9, "a" * 50_000), (5, "another text"),
    ]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(ids, links):
    """The smallest id reachable from each."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
