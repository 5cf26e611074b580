"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. The model of each one is a logistic regression on hashed word presence and a few
shape features, plus the log-odds of all earlier categories. In training these earlier probabilities are out of
fold, so a later model sees them as uncertain as they will be on new texts; in scoring they come from the models
fitted on all training rows. Fitting uses a bounded sample of labelled rows, one Spark task per fold; scoring is one
pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_group, dropped, table, written
from tidemark.llm.registry import query

CATEGORIES = ("quality", "toxic")
#: Labelled rows that fitting uses at most: those with the smallest hash of doc_id.
MAX_TRAINING_ROWS = 8_000
FOLDS = 3
SLOTS = 1 << 17
STEMS = (4, 5)
#: A word slot is used if it is in LEAST_TEXTS training texts and its shares in the two classes differ by LEAST_Z
#: standard errors; of more than MAX_FEATURES such slots the most telling ones are.
LEAST_TEXTS, LEAST_Z, MAX_FEATURES = 5, 4.0, 1_000
ROUNDS, RIDGE = 15, 1.0
_MARKS = bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))
_CAPITALS = bytes(range(65, 91))
_TO_SPACE = bytes(32 if c in _MARKS else c for c in range(256))


def features_of(text: str | None) -> np.ndarray:
    """Sorted distinct slots: lower-cased words without ASCII punctuation, their first bytes, shares of marks and capitals.

    Null and empty texts have the shape features of an empty text only.
    """
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    words = set(raw.lower().translate(_TO_SPACE).split())
    slots = [xxhash.xxh3_64_intdigest(w) % (SLOTS - 64) for w in words]
    for k in STEMS:  # insults that take endings share their beginning
        slots += [xxhash.xxh3_64_intdigest(w, k) % (SLOTS - 64) for w in {w[:k] for w in words if len(w) > k}]
    n = max(1, len(raw))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    marks = len(raw) - len(raw.translate(None, _MARKS))
    shape = [SLOTS - 64 + min(31, 32 * marks // n), SLOTS - 32 + min(31, 32 * capitals // n)]
    return np.unique(np.array(slots + shape, np.int32))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def telling(flat: np.ndarray, y_of: np.ndarray, n: int, n1: float) -> np.ndarray:
    """The slots that a model uses."""
    ones = np.bincount(flat, weights=y_of, minlength=SLOTS)
    seen = np.bincount(flat, minlength=SLOTS)
    p = seen / n
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    z = np.where(seen >= LEAST_TEXTS, np.abs(ones / n1 - (seen - ones) / (n - n1)) / error, 0)
    best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return np.sort(best[z[best] >= LEAST_Z])


def fit(slots: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps on the telling slots.

    The result has SLOTS word weights, one per earlier category, and the bias last. Without rows, or with one class
    alone, only the bias differs from 0.
    """
    k = earlier.shape[1]
    out = np.zeros(SLOTS + k + 1, np.float32)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4) if len(y) else 1e-6
    out[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < len(y):
        return out
    flat, lengths = np.concatenate(slots), np.array([len(s) for s in slots])
    used = telling(flat, np.repeat(y, lengths), len(y), y.sum())
    column = np.full(SLOTS, -1)
    column[used] = np.arange(len(used))
    at, row = column[flat], np.repeat(np.arange(len(y)), lengths)
    x = np.zeros((len(y), len(used) + k + 1))
    x[row[at >= 0], at[at >= 0]] = 1
    x[:, len(used) : -1] = log_odds(earlier)
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    w[-1] = out[-1]
    prior = np.full(len(w), RIDGE)
    prior[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (prior * w * w).sum() / 2)

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior)
        step, now = np.linalg.solve(curve, x.T @ (p - y) + prior * w), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-6:  # a whole Newton step may overshoot
            step = step / 2
        w -= step
    out[used] = w[: len(used)]
    out[SLOTS:] = w[len(used) :]
    return out


def predict(weights: np.ndarray, slots: np.ndarray, earlier: list[float]) -> float:
    z = weights[slots].sum() + weights[-1]
    if earlier:
        z += float(log_odds(np.array(earlier)) @ weights[SLOTS : SLOTS + len(earlier)])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit_task(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Fit on all rows but those of one fold and predict these; the last task fits on all and gives the weights."""
    task = int(frame["task"].iloc[0])
    frame = frame.sort_values("doc_id", kind="stable")
    slots = [np.asarray(s, np.int32) for s in frame["slots"]]
    earlier = np.array([list(e) for e in frame["earlier"]], float).reshape(len(frame), -1)
    y = frame["y"].to_numpy(float)
    held = frame["fold"].to_numpy() == task
    use = np.flatnonzero(~held)
    weights = fit([slots[i] for i in use], earlier[use], y[use])
    if task == FOLDS:
        yield pd.DataFrame({"doc_id": [None], "p": [None], "weights": [weights]})
    else:
        at = np.flatnonzero(held)
        p = [predict(weights, slots[i], earlier[i].tolist()) for i in at]
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[at], "p": p, "weights": pd.Series([None] * len(at), dtype=object)})


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_rows: int = MAX_TRAINING_ROWS
) -> list[np.ndarray]:
    """Weights per category. Only they, a fixed size, reach the driver.

    Of rows that repeat a doc_id the one with the least text counts, of texts with equal features that with the least
    doc_id, and of labels that repeat a doc_id the largest.
    """
    known = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in ("doc_id", *categories)))
    known = known.groupBy("doc_id").agg(*[F.max(c).cast("double").alias(f"y_{c}") for c in categories])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    slots = F.pandas_udf(lambda s: s.map(features_of), "array<int>")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows rows
    # copies would make the words of one text look telling; which row stays does not depend on the order of rows
    marks = [f"y_{c}" for c in categories]
    rows = rows.groupBy("doc_id", *marks).agg(F.min("text").alias("text")).withColumn("slots", slots("text"))
    rows = rows.groupBy("slots").agg(F.min(F.struct("doc_id", *marks)).alias("row")).select("slots", "row.*")
    rows = written(rows.withColumn("earlier", F.array().cast("array<double>")).withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")), "chain-rows")
    models = []
    for k, c in enumerate(categories):
        tasks = F.explode(F.array(*[F.lit(i) for i in range(FOLDS + 1)]))
        each = rows.select("doc_id", "slots", "earlier", "fold", F.col(f"y_{c}").alias("y"), tasks.alias("task"))
        fitted = written(by_group(each, ["task"], _fit_task, "doc_id long, p double, weights array<float>"), "chain-fit")
        final = fitted.where("weights IS NOT NULL").select("weights").first()
        models.append(np.array(final["weights"], np.float32) if final else fit([], np.zeros((0, k)), np.zeros(0)))
        if k < len(categories) - 1:
            oof = fitted.where("weights IS NULL").select("doc_id", "p")
            nxt = written(rows.join(oof, "doc_id").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"), "chain-rows")
            dropped(rows)
            rows = nxt
        dropped(fitted)
    dropped(rows)
    return models


def classify(docs: DataFrame, models: list[np.ndarray], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """All columns of `docs` and `p_<category>` for each category, in one pass.

    A column of `docs` of that name is replaced. Null and empty texts are scored like a text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # SLOTS floats per category

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for text in batch:
                slots, p = features_of(text), []
                for weights in shared.value:
                    p.append(predict(weights, slots, p))
                out.append(p)
            yield pd.DataFrame(out, columns=list(categories), dtype="float64")

    udf = F.pandas_udf(score, ", ".join(f"`{c}` double" for c in categories))
    names = [f"p_{c}" for c in categories]
    kept = [c for c in docs.columns if c not in names]
    scored = docs.select(*kept, udf("text").alias("__p"))
    return scored.select(*kept, *[F.col("__p")[c].alias(f"p_{c}") for c in categories])


def toxicity(
    docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, threshold: float = 0.5
) -> DataFrame:
    """doc_id, p_<category> per category, and `toxic`: the last category's probability is at least `threshold`.

    Without usable labels every probability is near 0 and nothing is toxic.
    """
    out = classify(docs.select("doc_id", "text"), train_chain(docs, labels, categories), categories)
    return out.drop("text").withColumn("toxic", F.col(f"p_{categories[-1]}") >= threshold)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
