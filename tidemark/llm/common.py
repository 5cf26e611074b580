"""Shared helpers: words and hashes inside tasks, tables in the work folder, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.files import delete, work_path

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_clean_up(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that ends in here."""
    old = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh table in the shared work folder and read it back.

    Later steps then neither repeat the work nor need the executors that did it. Its shuffle files go at once.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffle_clean_up(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.work_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Remove tables of `written` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.work_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIFT, _M1, _M2 = np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and products spread over all bits."""
    h = h ^ (h >> _SHIFT)
    h = h * _M1
    h = h ^ (h >> _SHIFT)
    h = h * _M2
    return h ^ (h >> _SHIFT)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; null and empty texts have none. lower: A-Z only."""
    if not isinstance(text, str):
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def ngram_hashes(h: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """Ordered hash of each n consecutive word hashes; empty where there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    factor = np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out + h[i : i + len(out)]) * factor
    return mixed(out)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of the batches of a partition that is sorted by `keys`."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if frame.empty:
            continue
        cols = [frame[k].to_numpy() for k in keys]
        change = np.zeros(len(frame), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pd.concat(held, ignore_index=True)
            held = []
        bounds = [0, *cuts.tolist(), len(frame)]
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            held.append(frame.iloc[lo:hi])
            if i < len(bounds) - 2:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pd.concat(held, ignore_index=True)


def by_group(df: DataFrame, keys: list[str], fn, schema: str, *order: str) -> DataFrame:
    """mapInPandas over whole groups: `fn(frame)` yields frames. Groups must be of bounded size."""
    def run(frames):
        for g in groups(frames, keys):
            yield from fn(g)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(id, component) of every node of an edge list; component is the smallest id reachable.

    Alternating large-star and small-star steps, each a grouped minimum and a join on Parquet tables, so a node
    with very many edges is split by adaptive execution and lost executors lose no finished step. Nothing but
    two sums reaches the driver. No edges give no rows; loops and repeated edges do no harm.
    """
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), name
    )
    before = None
    while True:
        # large star: each node's larger neighbours move to its smallest one
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(big.where("u > v").distinct(), name)
        dropped(low, e)
        # small star: each node and its smaller neighbours move to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        pairs = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = written(pairs.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        dropped(low, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return roots.unionByName(e.select(F.col("u").alias("id"), F.col("v").alias("component")))
