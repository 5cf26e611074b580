"""Similarity digests of improbable byte windows in chained Bloom filters.

Every window of WIDTH bytes has an entropy level. How often each level occurs over all windows of the corpus says how
improbable it is: the rarer, the better a feature. Of each run of neighbouring windows the most improbable one (the
first of equals) is selected. Selected windows are hashed into a chain of Bloom filters, PER_FILTER distinct ones each,
in order of their first place in the text, and two digests are compared by the bits their filters share beyond what
filters so full share by chance, against the most they could share.

Short texts take their features from shorter runs, so that they have enough; these hold all features that longer runs
select, and stay comparable. A text shorter than a window is one feature.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mixed, table
from tidemark.llm.registry import query

WIDTH = 16
#: Windows of a run, of which one is selected: for texts with fewer than so many windows, else the last.
RUNS = ((64, 2), (256, 8), (1024, 16), (None, 32))
LEVELS = 1001
#: Windows below this level (long runs of one or two bytes) are selected only where a run has no other.
DULL = 200
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Bytes of text whose digests are made at a time, and bytes of text of a block of neighbours.
BATCH_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20

_SCALE = 1 << 20
_GAIN = np.array([0, *(round(c * np.log2(c) * _SCALE) if c > 1 else 0 for c in range(1, WIDTH + 1))], np.int64)
_STEP = np.diff(_GAIN)  # by how much c * log2(c) grows with one more byte of a kind


def levels(b: np.ndarray) -> np.ndarray:
    """Entropy level 0 to 1000 of the window that starts at each byte; exact, so equal windows have equal levels."""
    n = len(b) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    before, after = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    for d in range(1, WIDTH):  # equal bytes among the WIDTH - 1 before and after each place
        same = (b[d:] == b[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = int(_GAIN[np.bincount(b[:WIDTH], minlength=256)].sum())
    change = _STEP[before[WIDTH:]] - _STEP[after[: n - 1]]
    total = np.concatenate(([first], first + np.cumsum(change)))
    most = int(_GAIN[WIDTH])
    return (most - total) * (LEVELS - 1) // most


def joined(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with gaps between them; (bytes, starts, lengths)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1])) if texts else lengths
    return np.frombuffer((b"\0" * gap).join(texts) + b"\0" * gap, np.uint8), starts, lengths


def inside(starts: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Which places lie in one of the stretches of `counts` places from `starts`."""
    mark = np.zeros(size + 1, np.int8)
    np.add.at(mark, starts, (counts > 0).astype(np.int8))
    np.add.at(mark, starts + counts, -(counts > 0).astype(np.int8))
    return np.cumsum(mark[:-1], dtype=np.int8).astype(bool)


def level_counts(texts: list[bytes]) -> np.ndarray:
    b, starts, lengths = joined(texts, WIDTH)
    found = levels(b)
    counts = np.maximum(lengths - WIDTH + 1, 0)
    return np.bincount(found[inside(starts, counts, len(found))], minlength=LEVELS)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: the rarest among the corpus' windows first, equals by level; dull levels last."""
    order = np.lexsort((np.arange(LEVELS), counts, np.arange(LEVELS) < DULL))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def _selected(key: np.ndarray, starts: np.ndarray, counts: np.ndarray, run: int) -> np.ndarray:
    """Places that are the least of some run of `run` windows of their text; shorter texts are one run."""
    least, reach = key, 1
    while reach < run:
        nearer = least.copy()
        np.minimum(least[:-reach], least[reach:], out=nearer[:-reach])
        least, reach = nearer, reach * 2
    runs = np.where(counts > 0, np.maximum(counts - run + 1, 1), 0)
    chosen = least[inside(starts, runs, len(key))] & ((1 << 40) - 1)
    return np.unique(chosen)


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every selected feature, in order of place, each once a text."""
    gap = WIDTH + max(r for _, r in RUNS)
    b, starts, lengths = joined(texts, gap)
    found = levels(b)
    counts = np.maximum(lengths - WIDTH + 1, 0)
    valid = inside(starts, counts, len(found))
    key = np.where(valid, ranks[found], LEVELS) << 40 | np.arange(len(found))
    places, least = [], 0
    for limit, run in RUNS:
        here = (counts >= least) & (counts < limit) if limit else counts >= least
        if here.any():
            places.append(_selected(key, starts[here], counts[here], run))
        least = limit
    at = np.sort(np.concatenate(places)) if places else np.empty(0, np.int64)
    text = np.searchsorted(starts, at, "right") - 1
    words = b[at[:, None] + np.arange(WIDTH)].view(np.uint64).reshape(len(at), WIDTH // 8)
    h = np.zeros(len(at), np.uint64)
    for i in range(words.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[:, i] + np.uint64(1))
    short = [i for i in np.flatnonzero((lengths > 0) & (counts == 0)).tolist()]
    if short:  # shorter than a window
        whole = [int.from_bytes(hashlib.sha256(texts[i]).digest()[:8], "little") for i in short]
        text, h = np.concatenate((text, short)), np.concatenate((h, np.array(whole, np.uint64)))
        order = np.argsort(text, kind="stable")
        text, h = text[order], h[order]
    order = np.lexsort((np.arange(len(h)), h, text))
    again = (np.diff(text[order]) == 0) & (h[order][1:] == h[order][:-1])
    once = np.sort(order[np.concatenate(([True], ~again))] if len(order) else order)
    return text[once].astype(np.int64), h[once]


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """A matrix of filters (uint8, FILTER_BITS / 8 a row) for each text; none for an empty text."""
    text, h = features(texts, ranks)
    per_text = np.bincount(text, minlength=len(texts))
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    chain = -(-per_text // PER_FILTER)
    first = np.cumsum(chain) - chain
    filters = np.zeros((int(chain.sum()), FILTER_BITS), np.uint8)
    row = first[text] + nth // PER_FILTER
    for i in range(HASHES):
        filters[row, (h >> np.uint64(12 * i)) % np.uint64(FILTER_BITS)] = 1
    packed = np.packbits(filters, axis=1)
    return [packed[f : f + c] for f, c in zip(first.tolist(), chain.tolist())]


def written_out(filters: np.ndarray) -> str:
    """A digest as text: base64 of its filters one after the other, empty for an empty text."""
    return base64.b64encode(filters.tobytes()).decode()


def read_in(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: shared bits beyond chance, of each filter with its best partner, weighted by bits, both ways.

    Equal digests give 1, an empty and another one 0. Filters meet in blocks, so memory stays bounded.
    """
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    ones = [np.unpackbits(x, axis=1).sum(axis=1).astype(np.float64) for x in (a, b)]
    best = [np.zeros(len(a)), np.zeros(len(b))]
    for i in range(0, len(a), 512):
        left = np.unpackbits(a[i : i + 512], axis=1).astype(np.float32)
        for j in range(0, len(b), 512):
            shared = left @ np.unpackbits(b[j : j + 512], axis=1).astype(np.float32).T
            p, q = ones[0][i : i + 512, None], ones[1][None, j : j + 512]
            chance, most = p * q / FILTER_BITS, np.minimum(p, q)
            spread = np.sqrt(chance * (1 - np.maximum(p, q) / FILTER_BITS))
            floor = np.minimum(chance + 2 * spread, most - 1)
            score = np.clip((shared - floor) / (most - floor), 0, 1)
            np.maximum(best[0][i : i + 512], score.max(axis=1), out=best[0][i : i + 512])
            np.maximum(best[1][j : j + 512], score.max(axis=0), out=best[1][j : j + 512])
    return float((best[0] @ ones[0] + best[1] @ ones[1]) / (ones[0].sum() + ones[1].sum()))


def _batches(rows, size: int = BATCH_BYTES):
    """Lists of rows whose texts make up about `size` bytes."""
    held, count = [], 0
    for row in rows:
        held.append(row)
        count += len(row[-1])
        if count >= size:
            yield held
            held, count = [], 0
    if held:
        yield held


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level over the windows of all texts; the driver sees one count a level."""
    def run(frames) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS, np.int64)
        for frame in frames:
            for batch in _batches((bytes(t),) for t in frame["raw"]):
                total += level_counts([t for t, in batch])
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"level": seen, "n": total[seen]})

    raw = docs.where("text IS NOT NULL").select(F.col("text").cast("binary").alias("raw"))
    found = raw.mapInPandas(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in found:
        counts[r["level"]] = r["n"]
    return ranks_of(counts)


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint of every document, in one pass; ranks as `corpus_ranks` gives them for these documents.

    Null and empty texts have an empty fingerprint. Repeated rows each give a row; other columns are ignored.
    """
    ranks = corpus_ranks(docs) if ranks is None else ranks

    def run(frames) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["id"].tolist(), frame["named"].tolist(), map(bytes, frame["raw"]))
            for batch in _batches(rows):
                yield pd.DataFrame({
                    "doc_id": pd.array([i if named else None for i, named, _ in batch], dtype="Int64"),
                    "fingerprint": [written_out(d) for d in digests([t for *_, t in batch], ranks)]})

    return _plain(docs).mapInPandas(run, "doc_id long, fingerprint string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("named"),
        F.coalesce("text", F.lit("")).cast("binary").alias("raw"),
    )


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, extra, id, named, tie, raw): the documents in descending order of doc_id, cut into blocks.

    Each block ends with an extra row, the document that follows its last one; after the last document comes the first.
    Rows that repeat a doc_id are in order of a hash of their text and stay in one block, as do rows without a
    doc_id, which come last. The driver sees one doc_id for each 16 MB of text: block borders and block heads.
    """
    plain = _plain(docs).withColumn("tie", F.xxhash64("raw"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    wanted = size // block_bytes
    probabilities = [i / (wanted + 1) for i in range(1, wanted + 1)]
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"))
    cuts = named.approxQuantile("id", probabilities, 0.1 / (wanted + 1)) if wanted else []
    cuts = sorted({int(c) for c in cuts})

    @F.pandas_udf("long")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(), "right"))

    number = F.when(F.col("named"), block_of("id") + 1).otherwise(0)
    plain = plain.withColumn("block", number)
    ids = plain.select("block", "id", "tie")
    heads = ids.groupBy("block").agg(F.max(F.struct("id", "tie")).alias("head")).orderBy("block").collect()
    above = {r["block"]: heads[(k + 1) % len(heads)]["block"] for k, r in enumerate(heads)}
    heads = docs.sparkSession.createDataFrame(
        [(r["block"], r["head"]["id"], r["head"]["tie"], above[r["block"]]) for r in heads],
        "block long, id long, tie long, above long")
    own = plain.select("block", F.lit(0).alias("extra"), "id", "named", "tie", "raw")
    copies = plain.join(F.broadcast(heads), ["block", "id", "tie"]).select(
        F.col("above").alias("block"), F.lit(1).alias("extra"), "id", "named", "tie", "raw")
    return own.unionByName(copies).repartition("block").sortWithinPartitions(
        "block", "extra", F.desc("id"), F.desc("tie"))


def edited_likeness(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last third (rounded down, in code points) replaced by as many code points of the next
    document's start, or all it has, in descending order of doc_id. Columns: doc_id, n_chars, edited (the text),
    fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty, equal (also empty) fingerprints
    as 1, an empty one as 0 to all others. A single document is its own next one; an empty table gives no rows.
    """
    ranks = corpus_ranks(docs)
    columns = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def stretches(rows):
        """Consecutive rows of one block with the row after them, some megabytes of text at a time."""
        held, count = [], 0
        for row in rows:
            if held and held[-1][0] != row[0]:
                held, count = [], 0  # what is left is an extra row, or a second copy of one
            held.append(row)
            count += len(row[-1])
            if len(held) > 1 and (count >= BATCH_BYTES or row[1]):
                if not held[-2][1]:
                    yield held
                held, count = held[-1:], len(row[-1])

    def run(frames) -> Iterator[pd.DataFrame]:
        rows = (
            row for frame in frames for row in zip(
                frame["block"].tolist(), frame["extra"].tolist(), frame["id"].tolist(), frame["named"].tolist(),
                map(bytes, frame["raw"])))
        for held in stretches(rows):
            raw = [r[-1] for r in held]
            texts = [t.decode("utf-8", "replace") for t in raw]
            cut = [len(t) // 3 for t in texts]
            edited = [t[: len(t) - c] + after[:c] for t, c, after in zip(texts, cut, texts[1:])]
            own, changed = digests(raw, ranks), digests([t.encode() for t in edited], ranks)
            out = pd.DataFrame({
                "doc_id": pd.array([r[2] if r[3] else None for r in held[:-1]], dtype="Int64"),
                "n_chars": [len(t) for t in texts[:-1]], "edited": edited,
                "fingerprint": [written_out(d) for d in own[:-1]],
                "edited_fingerprint": [written_out(d) for d in changed],
                "near_edited": [likeness(a, b) for a, b in zip(own, changed)],
                "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
            })
            yield out[columns]

    schema = ("doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return in_blocks(docs, block_bytes).drop("tie").mapInPandas(run, schema)


@query("op11_similarity_digest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_likeness(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )
