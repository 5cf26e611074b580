"""Exact n-gram Jaccard self-join with signature trees.

Texts become sets of hashed word n-grams. Equal sets are one class, and only a class's first document goes on.
Trees over all documents at once would not fit a task, so classes are first dealt into clusters that hold every link:
a set goes to the buckets of its rarest shingles, one more than may be missing in a set linked with it, so in one order
of all shingles two linked sets meet in a bucket. For this order a pass over the texts counts shingles in a fixed number
of cells. A shingle that many sets hold, like those of a line that a part of the corpus repeats, is then no bucket but
for sets that have little else, and clusters do not grow with the corpus. Of the sets that share a bucket the first is
its hub, and a hub's cluster is all sets of its buckets; both sets of a link are in the cluster of any bucket they share.
In each cluster a signature tree is bulk-loaded: a node holds the OR of its sets' token bitmaps and their
range of sizes. A dual traversal drops pairs of nodes whose largest possible overlap is too small for a link, or which
a single component holds already, and looks at each pair that is left.

This is done twice. The first time only the sets' own bitmaps travel, a few bits a shingle, and connect what their
overlap does not rule out; a set that stays alone has no link there. The others form groups over all clusters, and one
text of each goes to its group, once, where the overlap is counted exactly. A cluster or group too large for a tree
keeps the texts of each of its clusters.

A cluster of very many documents is cut into bands of sizes: linked sets lie in the same band or in neighbouring ones,
so each document goes to its own band and, as a guest, to the next. A band that is still too large for a tree is cut
into blocks, and its first document goes to each. Documents that this does not connect to the main part are then
compared, block by block, with all others of the band.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import (
    by_group, components, dropped, ngram_hashes, signed, table, word_hashes, words_of, written,
)
from tidemark.llm.registry import query

SHINGLE_WORDS, NUM, DEN = 5, 80, 100
#: Documents, and shingles of theirs, that one tree holds.
BLOCK_DOCS, BLOCK_SHINGLES = 4_000, 6_000_000
BITS, FAN_OUT = 1024, 8
#: The bitmap of a set has two to four bits a shingle, but at least BITS and at most so many.
MOST_BITS = 1 << 16
#: Shingles are counted in so many cells, CELLS_A_ROW of them in a row.
CELLS, CELLS_A_ROW = 1 << 22, 1 << 12
#: Rows that a task gathers of small groups before it gives them out.
BATCH_ROWS = 10_000


def _shingles(text: str | None, n: int) -> np.ndarray:
    h = word_hashes(words_of(text, lower=True))
    return ngram_hashes(h, min(n, len(h))) if len(h) else h


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence where there are fewer words."""
    h = np.sort(_shingles(text, n))
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def bucket_keys(s: np.ndarray, num: int, den: int, levels: np.ndarray | None = None) -> np.ndarray:
    """The shingles whose buckets the set goes to; linked sets that differ share at least one.

    Any link leaves at least num of den shingles of a set to both, so the first common one, in whatever order both
    sets use, is among the first n - ceil(n * num / den) + 1 of each. The order is that of the level of a shingle's
    cell, rare ones first, then that of hashes.
    """
    n = len(s)
    if n * (den - num) // num == 0:
        return np.empty(0, np.uint64)
    if levels is not None:
        s = s[np.argsort(levels[_cells(s)], kind="stable")]
    return s[: n - -(-num * n // den) + 1]


def _packed(rows: Iterable[tuple[int, np.ndarray]]) -> pd.DataFrame:
    """Rows of cells that are not all zero, each in the narrowest type."""
    return pd.DataFrame(
        [(i, zlib.compress(c.astype(np.min_scalar_type(c.max())).tobytes(), 1)) for i, c in rows if c.any()],
        columns=["part", "counts"])


def _unpacked(counts: bytes) -> np.ndarray:
    raw = zlib.decompress(counts)
    return np.frombuffer(raw, f"u{len(raw) // CELLS_A_ROW}").astype(np.uint64)


def _counted(frames, n: int) -> Iterator[pd.DataFrame]:
    """Of each cell, how many texts of the task have a shingle in it."""
    counts = np.zeros(CELLS, np.uint32)
    for frame in frames:
        for text in frame["text"]:
            counts[_cells(_shingles(text, n))] += 1
    yield _packed(enumerate(counts.reshape(-1, CELLS_A_ROW)))


def _summed(frames) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for i, counts in zip(frame["part"], frame["counts"]):
            total[i] = total.get(i, 0) + _unpacked(counts)
    yield _packed(total.items())


def levels_of(counts: np.ndarray) -> np.ndarray:
    """A byte per cell that grows with its count: 16 levels up to the median, then ten for each halving of the rest."""
    counts = np.minimum(counts, 1 << 20).astype(np.int64)
    cells = np.bincount(counts)
    below = (np.cumsum(cells) - cells) / len(counts)
    above = np.maximum(1 - below, 1 / len(counts))
    return np.where(below < 0.5, 32 * below, 16 - 10 * np.log2(2 * above)).astype(np.uint8)[counts]


def _levels(docs: DataFrame, n: int) -> np.ndarray:
    """The levels of all cells; what comes to the driver is one count a cell."""
    counted = written(docs.select("text").mapInPandas(
        lambda frames: _counted(frames, n), "part long, counts binary"), "shingle-counts")
    summed = written(counted.repartition("part").mapInPandas(_summed, "part long, counts binary"), "cell-counts")
    counts = np.zeros((CELLS // CELLS_A_ROW, CELLS_A_ROW), np.uint64)
    for row in summed.collect():
        counts[row["part"]] = _unpacked(row["counts"])
    dropped(counted, summed)
    return levels_of(counts.ravel())


def signature(s: np.ndarray, width: int | None = None) -> bytes:
    """Bitmap of a set: a bit for each remainder of its hashes by the width, a power of two."""
    width = width or max(BITS, min(MOST_BITS, 2 << len(s).bit_length()))
    flags = np.zeros(width, bool)
    flags[(s % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _folded(bits: int, width: int, to: int) -> int:
    """The bitmap of the same set at a smaller width."""
    while width > to:
        width //= 2
        bits = bits >> width | bits & (1 << width) - 1
    return bits


class SignatureTree:
    """Signature tree over shingle sets, with the components found so far."""

    def __init__(self, sets: list[np.ndarray], roots: list[int] | None = None):
        self.sets = sets
        bits = [int.from_bytes(signature(s, BITS), "big") for s in sets]
        self._load([len(s) for s in sets], bits, [int(s[0]) for s in sets], roots)

    def _load(self, size: list[int], bits: list[int], near: list[int], roots: list[int] | None = None) -> None:
        """Build the tree; sets with close values of `near` share nodes."""
        self.size, self.bits = size, bits
        self.extra = [n - b.bit_count() for n, b in zip(size, bits)]
        self.parent = list(range(len(size))) if roots is None else roots
        order = sorted(range(len(size)), key=lambda i: (size[i].bit_length(), near[i], size[i]))
        nodes = [self._node(None, order[i : i + FAN_OUT]) for i in range(0, len(order), FAN_OUT)]
        while len(nodes) > 1:
            nodes = [self._node(nodes[i : i + FAN_OUT], None) for i in range(0, len(nodes), FAN_OUT)]
        self.root = nodes[0] if nodes else None

    def _node(self, children, docs):
        if docs is not None:
            bits = 0
            for i in docs:
                bits |= self.bits[i]
            sizes = [self.size[i] for i in docs]
            return {"docs": docs, "bits": bits, "low": min(sizes), "high": max(sizes),
                    "extra": max(self.extra[i] for i in docs), "one": False}
        bits = 0
        for c in children:
            bits |= c["bits"]
        return {"children": children, "bits": bits, "low": min(c["low"] for c in children),
                "high": max(c["high"] for c in children), "extra": max(c["extra"] for c in children), "one": False}

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def _single(self, node) -> int | None:
        """The one component that holds all documents below a node, if so; once true it stays true."""
        if node["one"]:
            return self.find(node["any"])
        if "docs" in node:
            found = {self.find(i) for i in node["docs"]}
            any_doc = node["docs"][0]
        else:
            found = set()
            for c in node["children"]:
                r = self._single(c)
                found.add(r)
                if r is None or len(found) > 1:
                    return None
            any_doc = node["children"][0]["any"]
        if len(found) > 1:
            return None
        node["one"], node["any"] = True, any_doc
        return self.find(any_doc)

    def join(self, num: int, den: int, apart=None) -> None:
        """Connect all linked pairs; `apart(i, j)` leaves out pairs another task compares."""
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            a, b = stack.pop()
            if a is not b:
                if a["high"] * den < num * b["low"] or b["high"] * den < num * a["low"]:
                    continue
                need = -(-num * (a["low"] + b["low"]) // (num + den))
                most = (a["bits"] & b["bits"]).bit_count() + min(a["extra"], b["extra"])
                if min(most, a["high"], b["high"]) < need:
                    continue
            one = self._single(a)
            if one is not None and (a is b or one == self._single(b)):
                continue
            if "docs" in a and "docs" in b:
                self._pairs(a["docs"], b["docs"], a is b, num, den, apart)
            elif a is b:
                c = a["children"]
                stack += [(x, y) for i, x in enumerate(c) for y in c[i + 1 :]] + [(x, x) for x in c]
            elif "docs" in b or ("children" in a and a["high"] >= b["high"]):
                stack += [(x, b) for x in a["children"]]
            else:
                stack += [(a, y) for y in b["children"]]

    def _pairs(self, left, right, same, num, den, apart) -> None:
        for k, i in enumerate(left):
            for j in left[k + 1 :] if same else right:
                ri, rj = self.find(i), self.find(j)
                if ri == rj or (apart is not None and apart(i, j)):
                    continue
                a, b = self.size[i], self.size[j]
                need = -(-num * (a + b) // (num + den))
                if min(a, b) < need or (self.bits[i] & self.bits[j]).bit_count() + min(self.extra[i], self.extra[j]) < need:
                    continue
                if self._linked(i, j, need):
                    self.parent[max(ri, rj)] = min(ri, rj)

    def _linked(self, i: int, j: int, need: int) -> bool:
        return len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) >= need


class SignatureFilter(SignatureTree):
    """The same over sizes and signatures alone; connects sets that these leave room for a link."""

    def __init__(self, size: list[int], signatures: list[bytes]):
        self.wide = [int.from_bytes(s, "big") for s in signatures]
        self.width = [8 * len(s) for s in signatures]
        self._load(size, [_folded(b, w, BITS) for b, w in zip(self.wide, self.width)], self.wide)

    def _linked(self, i: int, j: int, need: int) -> bool:
        to = min(self.width[i], self.width[j])
        a, b = _folded(self.wide[i], self.width[i], to), _folded(self.wide[j], self.width[j], to)
        return (a & b).bit_count() + min(self.size[i] - a.bit_count(), self.size[j] - b.bit_count()) >= need


def _sets(frames, n: int, num: int, den: int, sent=None):
    levels = sent and np.frombuffer(sent.value, np.uint8)
    for frame in frames:
        rows = []
        for doc_id, key, text in zip(frame["doc_id"], frame["text_key"], frame["text"]):
            s = shingle_set(text, n)
            both = xxhash.xxh3_128_intdigest(s.tobytes())
            c1, c2 = np.array([both & (1 << 64) - 1, both >> 64], np.uint64).view(np.int64)
            rows.append((doc_id, key, len(s), c1, c2, signed(bucket_keys(s, num, den, levels)), signature(s)))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n", "c1", "c2", "keys", "bits"])


def _whole_groups(frames, keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups out of the batches of a partition that is sorted by `keys`."""
    held: list[dict[str, np.ndarray]] = []
    whole = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
    for frame in frames:
        if frame.empty:
            continue
        cols = {c: frame[c].to_numpy() for c in frame.columns}
        change = np.zeros(len(frame), bool)
        change[0] = bool(held) and any(held[-1][k][-1] != cols[k][0] for k in keys)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        lo = 0
        for hi in [*np.flatnonzero(change).tolist(), len(frame)]:
            if hi > lo:
                held.append({c: a[lo:hi] for c, a in cols.items()})
            if hi < len(frame):
                yield whole()
                held = []
            lo = hi
    if held:
        yield whole()


def _in_groups(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """by_group for very many small groups: `fn` takes a group's columns, and what it gives goes on in batches."""
    def run(frames):
        found, rows = [], 0
        for g in _whole_groups(frames, keys):
            found.append(fn(g))
            rows += len(next(iter(found[-1].values())))
            if rows >= BATCH_ROWS:
                yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})
                found, rows = [], 0
        if rows:
            yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _possible(group: dict[str, np.ndarray], num: int, den: int) -> dict[str, np.ndarray]:
    """The sets of a cluster that signatures connect with others, with the first document of what they are part of."""
    order = np.lexsort((group["text_key"], group["doc_id"]))
    group = {c: a[order] for c, a in group.items()}
    tree = SignatureFilter(group["n"].tolist(), group["bits"].tolist())
    tree.join(num, den)
    roots = np.array([tree.find(i) for i in range(len(order))])
    group |= {"root": group["doc_id"][roots], "part": roots}
    connected = np.bincount(roots)[roots] > 1
    return {c: group[c][connected] for c in ("cluster", "root", "part", "doc_id", "text_key", "n")}


def _tree_of(group: dict[str, np.ndarray], n: int, num: int, den: int) -> dict[str, np.ndarray]:
    """Links within one block of a band, as an edge from each document to the smallest it is connected with.

    Two guests are left to their own band.
    """
    order = np.lexsort((group["text_key"], group["doc_id"]))
    ids, keys = group["doc_id"][order], group["text_key"][order]
    first = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]
    ids, guest, texts = ids[first], group["guest"][order][first], group["text"][order][first]
    tree = SignatureTree([shingle_set(t, n) for t in texts])
    tree.join(num, den, (lambda i, j: guest[i] and guest[j]) if guest.any() else None)
    roots = np.array([tree.find(i) for i in range(len(ids))])
    return {"a": ids[roots], "b": ids}


def _rest_of(frame: pd.DataFrame, n: int, num: int, den: int) -> Iterator[pd.DataFrame]:
    """Links between a share of the unconnected documents and one block of their band."""
    frame = frame.sort_values("asks", ascending=False).drop_duplicates(["doc_id", "text_key"])
    frame = frame.sort_values(["doc_id", "text_key"])
    ids, asks = frame["doc_id"].to_numpy(), frame["asks"].to_numpy()
    first = {}
    for i, r in enumerate(frame["root"]):
        first.setdefault(r, i)
    tree = SignatureTree([shingle_set(t, n) for t in frame["text"]], [first[r] for r in frame["root"]])
    tree.join(num, den, lambda i, j: not (asks[i] or asks[j]))
    roots = np.array([tree.find(i) for i in range(len(ids))])
    yield pd.DataFrame({"a": ids[roots], "b": ids})


def ngram_jaccard_join(
    docs: DataFrame, words: int = SHINGLE_WORDS, num: int = NUM, den: int = DEN,
    block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id under links with den * overlap >= num * union.

    A text with fewer than `words` words is one shingle; null and empty texts have none and link with nothing.
    component_id is the smallest doc_id reachable, the document's own where nothing links. Rows with a null doc_id
    have a null component_id and link with nothing; repeated rows each give a row; an empty table gives none.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    # an order of shingles matters only to more sets than a tree holds
    counted = docs.count() > block_docs
    sent = docs.sparkSession.sparkContext.broadcast(_levels(docs, words).tobytes()) if counted else None
    keyed_sets = written(docs.mapInPandas(
        lambda frames: _sets(frames, words, num, den, sent),
        "doc_id long, text_key long, n long, c1 long, c2 long, keys array<long>, bits binary"), "shingle-sets")
    if counted:
        sent.unpersist()
    sets = written(keyed_sets.drop("keys", "bits"), "sets")
    named = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = written(named.groupBy("c1", "c2").agg(
        F.min("doc_id").alias("first"), F.min_by("text_key", F.struct("doc_id", "text_key")).alias("text_key"),
        F.first("n").alias("n")), "set-classes")

    keyed = keyed_sets.where("doc_id IS NOT NULL").select("c1", F.explode("keys").alias("key"))
    hubs = written(
        keyed.groupBy("key").agg(F.min("c1").alias("hub"), F.max("c1").alias("last"))
        .where("hub < last").drop("last"), "bucket-hubs")
    near = written(keyed.join(hubs, "key").where("c1 > hub").select("hub", "c1").distinct(), "shared-buckets")
    hub = F.col("hub").alias("cluster")
    placed = near.select(hub, "c1").unionByName(near.select(hub, F.col("hub").alias("c1")).distinct())
    member = classes.join(placed, "c1").select("cluster", F.col("first").alias("doc_id"), "text_key", "n")
    every_member = written(member, "cluster-members")
    # a set goes on only if another set of its cluster has a size that allows a link; a window sees distinct sizes only
    by_size = Window.partitionBy("cluster").orderBy("n")
    smaller, larger = F.lag("n").over(by_size), F.lead("n").over(by_size)
    fits = (F.col("sets") > 1) | (smaller * den >= F.col("n") * num) | (F.col("n") * den >= larger * num)
    fitting = every_member.groupBy("cluster", "n").agg(F.count("*").alias("sets")).withColumn("fits", fits)
    member = every_member.join(fitting.where("fits").select("cluster", "n"), ["cluster", "n"], "left_semi")
    member = written(member, "fitting-members")
    dropped(hubs, near, every_member)
    member = _grouped(member, keyed_sets, num, den, block_docs, block_shingles)
    dropped(keyed_sets)
    texts = written(docs.join(member.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"]), "cluster-texts")

    # bands of the large clusters; the one band of any other has the cluster's own name
    large = member.groupBy("cluster").agg((F.count("*") > block_docs).alias("large"))
    height = F.floor(F.log("n") / math.log(den / num)).cast("long")
    member = member.join(large, "cluster").withColumn("height", F.when(F.col("large"), height).otherwise(0))
    named_band = lambda up: F.when(F.col("large"), F.xxhash64("cluster", F.col("height") + up)).otherwise(F.col("cluster"))
    own = member.withColumn("band", named_band(0)).withColumn("guest", F.lit(False))
    guests = member.where("large").withColumn("band", named_band(1)).withColumn("guest", F.lit(True))
    bands = own.groupBy("band").agg(F.min("doc_id").alias("hub"))
    rows = written(own.unionByName(guests).select("band", "large", "guest", "doc_id", "text_key", "n").join(bands, "band"), "bands")
    sizes = written(rows.groupBy("band").agg(
        F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).alias("blocks")), "band-sizes")
    rows = rows.join(sizes, "band")

    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = rows.withColumn(
        "block", F.explode(F.when(F.col("doc_id") == F.col("hub"), every).otherwise(F.array(block))))
    dealt = texts.join(dealt, ["doc_id", "text_key"]).select("band", "block", "guest", "doc_id", "text_key", "text")
    found = _in_groups(dealt, ["band", "block"], lambda g: _tree_of(g, words, num, den), "a long, b long")
    edges = written(found.where("a <> b").select("a", "b").distinct(), "links")
    split = written(rows.where("blocks > 1"), "split-bands")
    if not split.isEmpty():
        edges = edges.unionByName(_between_blocks(texts, edges, split, words, num, den))
    labels = components(edges)
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2").join(
        classes.select("c1", "c2", "first"), ["c1", "c2"], "left")
    out = out.join(labels.select(F.col("id").alias("first"), "component"), "first", "left")
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "first"))
    return out.select("doc_id", "n_shingles", F.coalesce(linked, "doc_id").alias("component_id"))


def _grouped(member: DataFrame, keyed_sets: DataFrame, num: int, den: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Members of clusters as members of groups: both sets of a link are in one group, and most sets in one group only.

    What signatures connect, over all clusters, is one group if a tree holds it; otherwise each cluster's part of it is.
    """
    size = member.groupBy("cluster").agg((F.count("*") > block_docs).alias("large"))
    member = member.join(size, "cluster")
    asked = member.where("NOT large").drop("large")
    wanted = asked.select("doc_id", "text_key").distinct()
    signatures = keyed_sets.select("doc_id", "text_key", "bits").join(wanted, ["doc_id", "text_key"], "left_semi")
    signatures = written(signatures.dropDuplicates(["doc_id", "text_key"]), "signatures")
    asked = asked.join(signatures, ["doc_id", "text_key"]).select("cluster", "doc_id", "text_key", "n", "bits")
    parts = written(_in_groups(
        asked, ["cluster"], lambda g: _possible(g, num, den),
        "cluster long, root long, part long, doc_id long, text_key long, n long"), "cluster-parts")
    labels = components(parts.where("root <> doc_id").select(F.col("root").alias("a"), F.col("doc_id").alias("b")))
    parts = parts.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    parts = parts.withColumn("component", F.coalesce("component", "doc_id"))
    whole = (F.count("*") <= block_docs) & (F.sum("n") <= block_shingles)
    whole = parts.select("component", "doc_id", "text_key", "n").distinct().groupBy("component").agg(whole.alias("whole"))
    group = F.when(F.col("whole"), F.xxhash64("component")).otherwise(F.xxhash64("cluster", "part"))
    found = parts.join(whole, "component").select(group.alias("cluster"), "doc_id", "text_key", "n").distinct()
    rest = member.where("large").select("cluster", "doc_id", "text_key", "n")
    groups = written(found.unionByName(rest), "groups")
    dropped(signatures)
    return groups


def _between_blocks(texts: DataFrame, edges: DataFrame, split: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the blocks of split bands, beyond those that already connect their documents."""
    known = components(edges)
    lone = split.join(known, split["doc_id"] == known["id"], "left").select(
        "band", "blocks", "hub", "doc_id", "text_key", F.coalesce("component", "doc_id").alias("root"))
    main = lone.where("doc_id = hub").select("band", F.col("root").alias("main")).distinct()
    marked = written(lone.join(main, "band").withColumn("rest", F.col("root") != F.col("main")), "block-roots")
    shares = marked.where("rest").groupBy("band").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("shares"))
    both = marked.join(shares, "band")
    block, share = F.pmod(F.xxhash64("doc_id"), F.col("blocks")), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("shares"))
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asking = both.where("rest").withColumn("share", share).withColumn("block", to("blocks")).withColumn("asks", F.lit(True))
    asked = both.withColumn("block", block).withColumn("share", to("shares")).withColumn("asks", F.lit(False))
    rows = texts.join(asking.unionByName(asked), ["doc_id", "text_key"])
    rows = rows.select("band", "block", "share", "doc_id", "text_key", "text", "root", "asks")
    more = by_group(rows, ["band", "block", "share"], lambda g: _rest_of(g, words, num, den), "a long, b long")
    return written(more.where("a <> b").distinct(), "rest-links")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
