"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of each window of `min_words` words the leftmost k-word hash that is smallest. Equal
windows choose the same anchor at the same place, so a window can repeat only if its anchor does; anchors of one
text alone are dropped. Around each repeated anchor the match is extended both ways over the windows that chose it,
each held against the smallest document that has the same words, and overlapping windows grow together into maximal
repeats. A window hash has 128 bits. No pair of documents is ever formed: each anchor and each window keeps a
minimum, combined before the shuffle, so a passage that a third of all documents hold costs one row per task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import dropped, ngram_hashes, signed, table, word_hashes, words_of, written
from tidemark.llm.registry import query

MIN_WORDS = 13
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def anchors_of(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word start, anchor start of each window) for the word hashes of a text."""
    k = max(1, round(0.4 * min_words))
    grams = ngram_hashes(h, k)
    if len(h) < min_words:
        return grams, np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, min_words - k + 1)
    return grams, np.concatenate([
        views[at : at + 65536].argmin(axis=1) + np.arange(at, min(at + 65536, len(views)))
        for at in range(0, len(views), 65536)
    ])


def _seeds(frames, min_words: int):
    for frame in frames:
        rows = []
        for doc_id, key, text in zip(frame["doc_id"], frame["text_key"], frame["text"]):
            words = words_of(text)
            both = xxhash.xxh3_128_intdigest(b" ".join(words))
            grams, chosen = anchors_of(word_hashes(words), min_words)
            at = np.unique(chosen)
            c1, c2 = np.array([both & (1 << 64) - 1, both >> 64], np.uint64).view(np.int64)
            rows.append((doc_id, key, len(words), c1, c2, signed(grams[at]), at.astype(np.int32)))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_words", "c1", "c2", "anchors", "places"])


def _windows(frames, min_words: int):
    for frame in frames:
        rows = []
        for doc_id, key, text, places in zip(frame["doc_id"], frame["text_key"], frame["text"], frame["places"]):
            words = words_of(text)
            h = word_hashes(words)
            _, chosen = anchors_of(h, min_words)
            repeated = np.zeros(len(h) + 1, bool)
            repeated[np.asarray(places, np.int64)] = True
            starts = np.flatnonzero(repeated[chosen])
            w1 = ngram_hashes(h, min_words, 2)[starts]
            w2 = ngram_hashes(word_hashes(words, 1), min_words, 3)[starts]
            rows.append((doc_id, key, starts.astype(np.int32), signed(w1), signed(w2)))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "starts", "w1", "w2"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, starts, is_copy): where windows start that a document with a smaller doc_id also has.

    A text whose words all repeat an earlier document's has is_copy instead of starts. Only documents with a
    finding are listed. Rows with a null doc_id neither remove nor are removed from; rows that repeat a doc_id
    never remove each other's words.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    named = docs.where("doc_id IS NOT NULL")
    seeds = written(named.mapInPandas(
        lambda frames: _seeds(frames, min_words),
        "doc_id long, text_key long, n_words long, c1 long, c2 long, anchors array<long>, places array<int>",
    ), "seeds")

    # Texts with all the same words: the first one stands for the others.
    firsts = written(
        seeds.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last").drop("last"), "first-texts")
    copies = written(
        seeds.select("doc_id", "text_key", "c1", "c2", "n_words").join(firsts, ["c1", "c2"])
        .where((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= min_words))
        .select("doc_id", "text_key").distinct(), "copies")

    # Seeds: anchors that different texts share.
    anchors = seeds.select("c1", F.explode("anchors").alias("anchor"))
    shared = written(
        anchors.groupBy("anchor").agg(F.min("c1").alias("low"), F.max("c1").alias("high"))
        .where("low < high").select("anchor"), "shared-anchors")
    placed = seeds.select("doc_id", "text_key", F.explode(F.arrays_zip("anchors", "places")).alias("s"))
    found = placed.select("doc_id", "text_key", F.col("s.anchors").alias("anchor"), F.col("s.places").alias("place"))
    seeded = written(
        found.join(shared, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))
        .join(copies, ["doc_id", "text_key"], "left_anti"), "seeded")
    dropped(seeds, firsts, shared)

    # Extension: the windows around each shared anchor, each with the smallest document that has it.
    windows = written(named.join(seeded, ["doc_id", "text_key"]).mapInPandas(
        lambda frames: _windows(frames, min_words),
        "doc_id long, text_key long, starts array<int>, w1 array<long>, w2 array<long>",
    ), "windows")
    dropped(seeded)
    each = windows.select("doc_id", "text_key", F.explode(F.arrays_zip("starts", "w1", "w2")).alias("w")).select(
        "doc_id", "text_key", F.col("w.starts").alias("at"), F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    owners = written(
        each.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        .where("owner < last").drop("last"), "window-owners")
    removed = written(
        each.join(owners, ["w1", "w2"]).where("doc_id > owner")
        .groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("starts")), "repeats")
    dropped(windows, owners)
    return removed.select("doc_id", "text_key", "starts", F.lit(False).alias("is_copy")).unionByName(
        copies.select("doc_id", "text_key", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("is_copy")))


def spans(starts: np.ndarray, n_words: int, min_words: int) -> np.ndarray:
    """True for each word that one of the windows covers: overlapping windows make one maximal repeat."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + min_words, -1)
    return np.cumsum(edges)[:n_words] > 0


def _apply(frames, min_words: int, with_text: bool):
    for frame in frames:
        rows = []
        for text, starts, is_copy in zip(frame["text"], frame["starts"], frame["is_copy"]):
            raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            words = raw.split()
            gone = np.zeros(len(words), bool)
            if is_copy is True:
                gone[:] = True
            elif starts is not None and len(starts):
                gone = spans(np.asarray(starts, np.int64), len(words), min_words)
            removed = int(gone.sum())
            kept = [w for w, g in zip(words, gone) if not g] if removed else words
            out = text
            if with_text and removed:
                # a removed word goes with the white space after it; what stays is unchanged
                ends = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
                parts = [raw[: ends[0]]] + [raw[ends[i] : ends[i + 1]] for i in np.flatnonzero(~gone)]
                out = b"".join(parts).decode("utf-8", "replace").strip()
            rows.append((len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), out if with_text else None))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
        rest = frame.drop(columns=["text", "starts", "is_copy"]).reset_index(drop=True)
        yield pd.concat([rest, out], axis=1)


def substring_dedup(
    docs: DataFrame, min_words: int = MIN_WORDS, with_text: bool = True, columns: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Per document: the given `columns` of it (but text), n_words, n_removed, kept_sha256 and kept_text.

    A word goes if a window of `min_words` words covers it whose words also start in a document with a smaller
    doc_id; windows are judged on the input. kept_sha256 is of the kept words joined by one space. kept_text leaves a
    document without removals as it is, else it is the text without the removed words and the white space after them
    (null with with_text=False). Null and empty texts have no words; an empty table gives no rows; columns not asked
    for are ignored, whatever their names; repeated rows each give a row.
    """
    found = repeats(docs, min_words).withColumnRenamed("doc_id", "key_id")
    kept = [docs[c].alias(f"column_{i}") for i, c in enumerate(columns)]
    rows = docs.select(*kept, docs["doc_id"].alias("key_id"), F.xxhash64("text").alias("text_key"), "text")
    joined = rows.join(found, ["key_id", "text_key"], "left").drop("key_id", "text_key")
    schema = T.StructType([T.StructField(f"column_{i}", docs.schema[c].dataType) for i, c in enumerate(columns)])
    for name, kind in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())):
        schema.add(name, kind)
    out = joined.mapInPandas(lambda frames: _apply(frames, min_words, with_text), schema)
    return out.select(
        *[F.col(f"column_{i}").alias(c) for i, c in enumerate(columns)], "n_words", "n_removed", "kept_sha256", "kept_text")


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
