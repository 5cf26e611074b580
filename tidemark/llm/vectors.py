"""Embedding near-duplicates by sorted projection passes.

In each pass vectors get a key of concatenated random hashes: signs of random projections, in one string of bits.
Vectors of one label are ordered by that key, and each is compared with the next WINDOW ones of the order by its
exact cosine. A pair that a pass parts by its first bits is close together in another one. A row carries its places
in earlier passes, from which a task sees that a pair was met before, so each pair is verified and counted once, and
what leaves a task is one row per vector: how many it links with there, and the first vector it is connected with.
No list of links is ever built. Only block borders are replicated between tasks.

Equal vectors of a label are one row with a multiplicity. In a label of n such rows, all that share their first
log2(n / window) bits in a pass are compared too, block by block, however many they are. So a pair at the threshold
is met in a pass with a chance that depends on n alone, and the number of passes follows from n to reach RECALL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import by_group, components, dropped, table, written
from tidemark.llm.registry import query

COSINE = 0.93
PASSES, BITS = 6, 60
#: Neighbours after each vector that it is compared with in a pass, and rows of a task's block.
WINDOW, BLOCK = 1_500, 6_000
#: Least expected share of the pairs at the threshold that is met in some pass, in labels larger than the window.
RECALL = 0.95
SEED = 17


def plan_of(n: int, cosine: float, passes: int, window: int) -> tuple[int, int]:
    """(bits that bring two of n vectors together, passes): one pass where the window holds all of them."""
    if n <= window + 1:
        return 0, 1
    depth = min(BITS, math.ceil(math.log2(n / window)))
    met = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** depth
    return depth, passes if met >= 1 else max(passes, math.ceil(math.log(1 - RECALL) / math.log1p(-met)))


def key_of(vectors: np.ndarray, turn: int) -> np.ndarray:
    """BITS random signs as one unsigned integer; the same for every task."""
    planes = np.random.default_rng([SEED, turn]).standard_normal((BITS, vectors.shape[1]))
    bits = (vectors @ planes.T) > 0
    return (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=1)


def _units(frames: Iterator[pd.DataFrame], passes: int):
    """Vectors that can link at all, scaled to length 1, with a key for each pass."""
    for frame in frames:
        ids, rows = [], []
        for i, label, v in zip(frame["vec_id"], frame["label"], frame["embedding"]):
            if v is None or label is None or not len(v):
                continue
            x = np.array([np.nan if c is None else c for c in v], float)
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(x).max()
                norm = np.linalg.norm(x / scale) * scale if scale > 0 else 0.0
            if np.isfinite(x).all() and norm > 0:
                ids.append((i, label, len(x)))
                rows.append(x / scale / np.linalg.norm(x / scale))
        for width in {k[2] for k in ids}:
            at = [j for j, k in enumerate(ids) if k[2] == width]
            vectors = np.array([rows[j] for j in at])
            keys = np.stack([key_of(vectors, t) for t in range(passes)], axis=1)
            same = [xxhash.xxh3_128_digest(v.tobytes()) for v in vectors + 0.0]
            yield pd.DataFrame({
                "vec_id": [ids[j][0] for j in at], "label": [ids[j][1] for j in at], "width": width,
                "same": same, "unit": list(vectors), "keys": list(keys)})


def _label(vectors: DataFrame):
    """The label as text, null where it equals nothing; labels are equal just if their texts are."""
    kind = vectors.schema["label"].dataType
    label = F.col("label")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        label = F.when(~F.isnan(label), label + F.lit(0).cast(kind))  # one zero
    return F.hex(label) if isinstance(kind, T.BinaryType) else label.cast("string")


def _pairs(frame: pd.DataFrame, cosine: float, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked pairs that this task is to compare: each pair of a pass is one task's."""
    own, run, place, units = (frame[k].to_numpy() for k in ("own", "run", "place", "unit"))
    if frame["left"].iat[0] != frame["right"].iat[0]:  # two blocks of one run: each row with each beyond the window
        x = np.stack(units)
        mine, other = np.flatnonzero(own), np.flatnonzero(~own)
        for at in range(0, len(mine), 512):
            r, c = np.nonzero(x[mine[at : at + 512]] @ x[other].T >= cosine)
            r, c = mine[at + r], other[c]
            far = np.abs(place[r] - place[c]) > window
            yield r[far], c[far]
        return
    group = frame[["label", "width"]].to_numpy()
    bounds = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1), True])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        x = np.stack(units[lo:hi])
        for at in range(lo, hi, 512):
            end = min(hi, at + 512)
            last = end - 1
            if run[last] >= 0:  # runs lie together: to the end of the last row's
                last = lo + np.flatnonzero(run[lo:hi] == run[last])[-1]
            to = min(hi, max(end + window, last + 1))
            r, c = np.nonzero(x[at - lo : end - lo] @ x[at - lo : to - lo].T >= cosine)
            r, c = r + at, c + at
            keep = (c > r) & own[r] & ((place[c] - place[r] <= window) | (own[c] & (run[r] >= 0) & (run[r] == run[c])))
            yield r[keep], c[keep]


def _connected(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected with, after links a-b are added to those that gave `root`."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def _links(frame: pd.DataFrame, cosine: float, window: int) -> Iterator[pd.DataFrame]:
    """Per linked vector of a pair of blocks: how many vectors it links with there, and one it is connected with.

    Links that an earlier pass has met are left out.
    """
    frame = frame.sort_values("place", kind="stable", ignore_index=True)
    ids, times = frame["vec_id"].to_numpy(), frame["times"].to_numpy()
    places, runs = np.stack(frame["places"]), np.stack(frame["runs"])
    linked, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for a, b in _pairs(frame, cosine, window):
        for p, r in zip(places.T, runs.T):
            new = (np.abs(p[a] - p[b]) > window) & ((r[a] < 0) | (r[a] != r[b]))
            a, b = a[new], b[new]
        np.add.at(linked, a, times[b])
        np.add.at(linked, b, times[a])
        root = _connected(root, a, b)
    some = np.flatnonzero(linked)
    if len(some):
        yield pd.DataFrame({"vec_id": ids[some], "linked": linked[some], "root": ids[root[some]]})


def sorted_projection_join(
    vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label and width are compared. Null, empty and zero vectors, and those with null
    or non-finite components, link with nothing, like rows with a null vec_id. Labels may be of any type with a text
    form. Rows of a repeated vec_id are one vector for the counts, of unlike ones the first by label, width and digest.
    An empty table gives no rows. All reported pairs are exact; equal vectors always link, and
    so do all pairs of a label of at most `window` + 1 distinct ones. In a larger label a pair at the threshold is met with a
    chance of RECALL at least, and closer ones more often. `passes` is the least number for such a label.
    """
    if window > block:
        raise ValueError("a block must hold the window")
    usable = vectors.where("vec_id IS NOT NULL").select("vec_id", _label(vectors).alias("label"), "embedding")
    most = usable.groupBy("label").count().agg(F.max("count")).first()[0] or 0  # at least the largest label
    turns = plan_of(most, cosine, passes, window)[1]
    units = usable.mapInPandas(
        lambda frames: _units(frames, turns),
        "vec_id long, label string, width int, same binary, unit array<double>, keys array<long>")
    one = F.min_by(F.struct(*units.columns[1:]), F.struct("label", "width", "same"))
    units = written(units.groupBy("vec_id").agg(one.alias("row")).select("vec_id", "row.*"), "units")

    # equal vectors are one, under the smallest of their ids
    alike = ["label", "width", "same"]
    copies = written(units.groupBy(*alike).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")), "copies")
    plans = F.udf(lambda n: plan_of(n, cosine, passes, window), "depth int, turns int")
    sizes = copies.groupBy("label", "width").agg(F.count("*").alias("n")).where(F.col("n") > window + 1)
    sizes = sizes.withColumn("plan", plans("n")).select("label", "width", "plan.depth", "plan.turns")
    rows = units.select("vec_id", "keys").join(copies.select("vec_id", "label", "width", "times"), "vec_id")
    rows = rows.join(sizes, ["label", "width"], "left")
    none = F.array().cast("array<long>")
    rows = written(rows.withColumns({
        "depth": F.coalesce("depth", F.lit(0)), "turns": F.coalesce("turns", F.lit(1)), "places": none, "runs": none,
    }), "distinct-vectors")

    shares = []
    for turn in range(rows.agg(F.max("turns")).first()[0] or 1):
        # the place of each vector in the order: its place in its range of keys, after all earlier ranges
        order = ["label", "width", "key", "vec_id"]
        dealt = rows.where(F.col("turns") > turn).withColumn("key", F.col("keys")[turn])
        dealt = written(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
            "step", F.monotonically_increasing_id()), "pass-order")
        dropped(rows)
        part = F.shiftright("step", 33)
        counted = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
        starts = counted.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        placed = dealt.withColumn("part", part).join(F.broadcast(starts), "part").withColumns({
            "head": F.expr(f"shiftright(key, {BITS} - depth)"),
            "place": F.col("before") + F.col("step").bitwiseAND((1 << 33) - 1)}).drop("part", "before", "step", "key")
        # runs of one head that are longer than the window; fewer than one for each `window` rows
        runs = placed.groupBy("label", "width", "head").agg(F.min("place").alias("run"), F.max("place").alias("last"))
        runs = runs.where(F.col("last") - F.col("run") > window)
        placed = placed.join(runs, ["label", "width", "head"], "left").drop("head")
        placed = written(placed.withColumn("run", F.coalesce("run", F.lit(-1))), "places")
        dropped(dealt)
        rows = written(placed.where(F.col("turns") > turn + 1).withColumns({
            "places": F.concat("places", F.array("place")), "runs": F.concat("runs", F.array("run")),
        }).drop("place", "run", "last"), "next-pass")
        home = F.floor(F.col("place") / block)
        dealt = placed.withColumn("home", home)

        def to(left, right, own):
            return F.struct(left.alias("left"), right.alias("right"), F.lit(own).alias("own"))

        at, run = F.col("home"), F.col("run") >= 0
        low, high = F.when(run, F.floor(F.col("run") / block)), F.floor(F.col("last") / block)
        none = F.array().cast("array<struct<left:bigint,right:bigint,own:boolean>>")
        border = F.when((F.col("place") % block < window) & (at > 0), F.array(to(at - 1, at - 1, False))).otherwise(none)
        later = F.when(high > at, F.transform(F.sequence(at + 1, high), lambda b: to(F.col("home"), b, True))).otherwise(none)
        earlier = F.when(low < at, F.transform(F.sequence(low, at - 1), lambda b: to(b, F.col("home"), False))).otherwise(none)
        dealt = dealt.withColumn("task", F.explode(F.concat(F.array(to(at, at, True)), border, later, earlier)))
        dealt = dealt.select("vec_id", "label", "width", "times", "place", "run", "places", "runs", "task.*")
        blocks = dealt.join(units.select("vec_id", "unit"), "vec_id")
        shares.append(written(by_group(
            blocks, ["left", "right"], lambda g: _links(g, cosine, window), "vec_id long, linked long, root long"), "pass-links"))
        dropped(placed)
    dropped(rows)
    near = shares[0]
    for s in shares[1:]:
        near = near.unionByName(s)
    labels = components(near.where("vec_id <> root"), "vec_id", "root").withColumnRenamed("id", "vec_id")
    counts = near.groupBy("vec_id").agg(F.sum("linked").alias("linked")).join(labels, "vec_id")
    # a vector links with its own copies, and with each copy of another
    found = copies.join(counts, "vec_id", "left").where("times > 1 OR linked IS NOT NULL").select(
        *alike, (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component"))
    found = units.select("vec_id", *alike).join(found, alike).select("vec_id", "n_links", "component")
    out = vectors.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"))


@query("op8_sorted_projection_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projection_join(table(spark, sf_dir, "embeddings"))
