"""Best-fit packing by exact-complement hashing.

Texts are tokenised once; what is packed afterwards is the histogram of piece lengths, which has at most
`capacity` entries however many pieces there are. Planning on the histogram fills gaps exactly first: sums of one,
two and three lengths are looked up in a hash index of what is still available, and each exact combination is
consumed as often as its counts allow. Pieces that no exact combination takes are placed by best fit in descending
order, many equal sequences at a time. Every piece then finds its place from its rank among pieces of equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import table, words_of, written
from tidemark.llm.registry import query

CAPACITY = 4096
END_ID = 1
#: Rows of one (length, bucket) group that are ranked together; a frequent length is spread over its buckets.
RANKED_ROWS = 2_000
#: Distinct words a worker keeps the ids of; past it the older half stays, where the frequent words are.
KNOWN_WORDS = 500_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


#: A word of Latin letters, perhaps with a full stop or comma: one or two pre-tokens whatever stands around it.
_PLAIN = re.compile(r"([a-zà-öø-ÿ]+)([.,]?)")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordIds:
    """Token ids of texts for a byte-level tokenizer that lowers case and drops white space, word by word.

    Each distinct word is encoded once; plain ones go to the merge model directly, as neither normalisation nor
    pre-tokenisation changes them. Ids are little-endian unsigned 32-bit integers in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.marks = {m: self._packed(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,"} | {"": b""}
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text.lower())
        if not plain:
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        stem = plain[1] if plain[1].isascii() else "".join([self.letters[b] for b in plain[1].encode()])
        return self._packed([t.id for t in self.merge(stem)]) + self.marks[plain[2]]

    def __call__(self, text: str | None) -> bytes:
        words = words_of(text, lower=text is not None and "<|" not in text)  # special tokens are case-sensitive
        parts = list(map(self.known.get, words))
        if None not in parts:
            return b"".join(parts)
        if len(self.known) > KNOWN_WORDS:
            self.known = dict(islice(self.known.items(), KNOWN_WORDS // 2))
            parts = list(map(self.known.get, words))
        for w in {w for w, p in zip(words, parts) if p is None}:
            self.known[w] = self._word(w)
        return b"".join([self.known[w] if p is None else p for w, p in zip(words, parts)])


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One per worker process, so later tasks find the words of earlier ones."""
    return WordIds(path)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece of at most `capacity` tokens.

    Null and empty texts are the end token alone. Only documents longer than `capacity` are cut.
    """
    def run(frames):
        ids_of, end, step = word_ids(tokenizer_path), pack("<I", end_id), 4 * capacity
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = ids_of(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=PIECES.names)

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns (how many sequences, lengths in each) that use every counted length exactly.

    `counts` maps a length to its number of pieces; the work depends on the number of distinct lengths alone.
    Lengths are hashed to themselves: `left[n]` is what is still available of length n. The pairs of a sum are where
    the set of available lengths meets its own mirror image, and a triple is a single and the pairs of what it leaves.
    """
    left = [0] * (capacity + 1)
    have = mirror = 0  # available lengths as bits, and the same seen from the other end
    for n, c in counts.items():
        if c > 0:
            left[n] = c
            have |= 1 << n
            mirror |= 1 << (capacity - n)
    out: list[tuple[int, list[int]]] = []

    def take(*parts: int) -> None:
        nonlocal have, mirror
        kinds = set(parts)
        times = min(left[p] // parts.count(p) for p in kinds)
        if times:
            out.append((times, list(parts)))
            for p in kinds:
                left[p] -= times * parts.count(p)
                if not left[p]:
                    have &= ~(1 << p)
                    mirror &= ~(1 << (capacity - p))

    def pairs(total: int) -> Iterator[tuple[int, int]]:
        """Available pairs of this sum, the most even ones first, which leaves small pieces for later gaps."""
        both = have & (mirror >> (capacity - total)) & ((2 << total // 2) - 1)
        while both:
            n = both.bit_length() - 1
            yield total - n, n
            both &= ~(1 << n)

    # The largest pieces go first: their gaps have the fewest ways to be filled.
    for a in range(capacity, 0, -1):
        gap = capacity - a
        if not left[a]:
            continue
        if gap == 0:
            take(a)
            continue
        if left[gap]:
            take(a, gap)
        for pair in pairs(gap) if left[a] else ():
            take(a, *pair)
            if not left[a]:
                break
        for c in [n for n in range(1, gap // 3 + 1) if left[n]] if left[a] else ():
            for pair in pairs(gap - c):
                take(a, c, *pair)
                if not left[a] or not left[c]:
                    break
            if not left[a]:
                break
    return out + best_fit({n: c for n, c in enumerate(left) if c}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over counted lengths; equal bins are one entry with a count."""
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for n in sorted(counts, reverse=True):
        need = counts[n]
        while need:
            room = next((r for r in range(n, capacity + 1) if by_room.get(r)), None)
            if room is None:
                per = min(capacity // n, need)
                times = max(1, need // per)
                by_room[capacity - per * n].append((times, [n] * per))
                need -= times * per
                continue
            times, parts = by_room[room].pop()
            per = min(room // n, need)
            used = min(times, max(1, need // per))
            if used < times:
                by_room[room].append((times - used, parts))
            by_room[room - per * n].append((used, parts + [n] * per))
            need -= used * per
    return [b for bins in by_room.values() for b in bins]


def places(patterns: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """One row per (pattern, length run): ranks `from_rank…` of a length go to these sequences and offsets."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, parts in patterns:
        at = 0
        for n in parts:
            rows.append((n, used[n], sequence, at))
            used[n] += times
            at += n
        sequence += times
    frame = pd.DataFrame(rows, columns=["length", "from_rank", "sequence", "offset"], dtype="int64")
    return frame.sort_values(["length", "from_rank"], kind="stable").reset_index(drop=True)


def best_fit_packing(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pack whole documents into sequences of at most `capacity` tokens; one row per piece.

    The driver sees one count per piece length, `capacity` rows at most. Repeated
    doc_ids are separate documents; an empty table gives no rows; other columns of `docs` are ignored.
    """
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    pieces = written(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    buckets = 1 + pieces.count() // RANKED_ROWS
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    found = written(pieces.groupBy("length", "bucket").count(), "piece-counts")
    lengths = found.groupBy("length").agg(F.sum("count").alias("n")).collect()
    patterns = spark.sparkContext.broadcast(places(plan({r["length"]: r["n"] for r in lengths}, capacity)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))

    def run(frames):
        table_of = patterns.value
        key = (table_of["length"].to_numpy() << 40) + table_of["from_rank"].to_numpy()
        for frame in frames:
            rank = (frame["before"] + frame["rank"]).to_numpy() - 1
            row = np.searchsorted(key, (frame["length"].to_numpy() << 40) + rank, "right") - 1
            frame["sequence_id"] = table_of["sequence"].to_numpy()[row] + rank - table_of["from_rank"].to_numpy()[row]
            frame["offset"] = table_of["offset"].to_numpy()[row]
            yield frame.drop(columns=["bucket", "rank", "before"])

    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("long")).join(starts, ["length", "bucket"])
    schema = T.StructType([*PIECES, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*PIECES.names, "bucket", "rank", "before").mapInPandas(run, schema)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
