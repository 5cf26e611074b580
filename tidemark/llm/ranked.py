"""Ranked lexical search by sequential reads of impact-sorted lists (NRA), without random access.

Documents are split over tasks, so all that a document scores is known where its postings are. A task takes its
documents in blocks of a bounded number of postings and sorts each term's list by falling impact. An item reads its
lists downwards, all impacts above a falling mark at a time. Each document of the block has a lower bound, the
impacts read, and an upper one, which adds the next unread impact of every list it was not met in. Reading goes on
until no unmet document can reach the k-th best lower bound, and every document that still can has equal bounds: then
membership, ties and scores are settled. The best of earlier blocks are carried along, so later blocks stop sooner.
At the end the tasks' best are ranked together.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import dropped, table, written
from tidemark.llm.registry import query

TOP = 50
#: Item terms that are searched for together; more of them are worked off in several passes.
PASS_TERMS = 500_000
#: Postings of a block: what a task sorts and holds at a time.
BLOCK_POSTINGS = 2_000_000
#: Bytes of a text that are split into words at a time.
SLICE_BYTES = 4 << 20
NO_ID = (1 << 63) - 1

_ALNUM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _ALNUM else 32 for b in range(256))


def term_counts(raw: bytes) -> tuple[int, Counter]:
    """(terms with repeats, occurrences of each): runs of ASCII letters, digits and all beyond ASCII, A-Z lowered."""
    raw = raw.translate(_FOLD)
    if len(raw) <= SLICE_BYTES:
        found = raw.split()
        return len(found), Counter(found)
    n, counts, at = 0, Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        found = raw[at:end].split()
        n += len(found)
        counts.update(found)
        at = end
    return n, counts


INDEX = pa.schema([
    ("doc_id", pa.int64()), ("no_id", pa.bool_()), ("n", pa.int64()),
    ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64())),
])
INDEX_DDL = "doc_id long, no_id boolean, n long, terms array<int>, tfs array<long>"


def index_of(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per document with at least one term: its length and its postings of the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches) -> Iterator[pa.RecordBatch]:
        numbers = held.value
        for batch in batches:
            ids, no_ids, ns, terms, tfs, cuts = [], [], [], [], [], [0]
            for doc_id, no_id, raw in zip(batch["id"].to_pylist(), batch["no_id"].to_pylist(), batch["raw"]):
                n, counts = term_counts(raw.as_py())
                if not n:
                    continue
                for t in counts.keys() & numbers.keys():
                    terms.append(numbers[t])
                    tfs.append(counts[t])
                ids.append(doc_id)
                no_ids.append(no_id)
                ns.append(n)
                cuts.append(len(terms))
            cuts = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(no_ids, pa.bool_()), pa.array(ns, pa.int64()),
                pa.ListArray.from_arrays(cuts, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int64())),
            ], schema=INDEX)

    plain = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("doc_id").isNull().alias("no_id"),
        F.col("text").cast("binary").alias("raw"),
    )
    return plain.mapInArrow(run, INDEX_DDL)


class Best:
    """The k best documents of an item so far, higher score and smaller id first."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.no_id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        no_id = np.concatenate((self.no_id, no_id))
        first = np.lexsort((no_id, doc, -score))[: self.k]
        self.score, self.doc, self.no_id = score[first], doc[first], no_id[first]


class Block:
    """Impact-sorted lists of a bounded number of postings."""

    def __init__(self, doc: np.ndarray, no_id: np.ndarray, at: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.doc, self.no_id = doc, no_id
        order = np.lexsort((-impact, term))
        self.at, self.impact, term = at[order], impact[order], term[order]
        cuts = np.flatnonzero(np.diff(term)) + 1
        starts = np.concatenate(([0], cuts)) if len(term) else np.empty(0, np.int64)
        ends = np.concatenate((cuts, [len(term)])) if len(term) else starts
        self.lists = {int(term[s]): (int(s), int(e)) for s, e in zip(starts, ends)}

    def search(self, terms: list[int], best: Best) -> int:
        """Add an item's best documents of this block; returns how many postings were read."""
        lists = [(self.at[s:e], self.impact[s:e], -self.impact[s:e]) for t in terms if t in self.lists
                 for s, e in [self.lists[t]]]
        lists = [x for x in lists if x[1][0] > 0]
        read = [0] * len(lists)
        low = np.zeros(len(self.doc), np.int64)
        mark = max((int(x[1][0]) for x in lists), default=0)
        while True:
            bounds = [int(x[1][r]) if r < len(x[1]) else 0 for x, r in zip(lists, read)]
            unmet = sum(bounds)
            kth = self._kth(low, best)
            if unmet < kth or not unmet:
                met = np.zeros(len(low), np.int64)
                for (at, _, _), r, b in zip(lists, read, bounds):
                    if b:
                        met[at[:r]] += b
                live = (low > 0) & (low + unmet - met >= kth)
                if not (live & (met < unmet)).any():
                    break
            mark //= 2
            for i, (at, impact, falling) in enumerate(lists):
                r = int(np.searchsorted(falling, -mark, "right"))
                low[at[read[i] : r]] += impact[read[i] : r]
                read[i] = max(r, read[i])
        found = np.flatnonzero(live)
        best.add(low[found], self.doc[found], self.no_id[found])
        return sum(read)

    @staticmethod
    def _kth(low: np.ndarray, best: Best) -> int:
        """The k-th best lower bound of this block and the documents before it; 0 while there are fewer."""
        some = np.concatenate((low[low > 0], best.score))
        return int(np.partition(some, len(some) - best.k)[len(some) - best.k]) if len(some) >= best.k else 0


def blocks_of(batches, weights: np.ndarray, n_docs: int, n_terms: int, size: int) -> Iterator[Block]:
    """Blocks of whole documents with about `size` postings each, out of a task's rows."""
    held, count = [], 0

    def block() -> Block:
        doc, no_id, lengths, n, term, tf = (np.concatenate(c) for c in zip(*held))
        if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
            raise OverflowError(f"a document of {int(n.max())} terms among {n_docs} documents: scores need more than 64 bits")
        m = 50 + (50 * n * n_docs) // n_terms
        at = np.repeat(np.arange(len(doc)), lengths)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
        return Block(doc, no_id, at, term, impact)

    for batch in batches:
        cut = batch["terms"].offsets.to_numpy().astype(np.int64)
        term, tf = batch["terms"].flatten().to_numpy(), batch["tfs"].flatten().to_numpy()
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "no_id", "n")]
        cut = cut - cut[0]
        lo = 0
        while lo < len(columns[0]):  # documents until the block is full; one at least
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + size - count, "right")) - 1)
            held.append((columns[0][lo:hi], columns[1][lo:hi], np.diff(cut[lo : hi + 1]), columns[2][lo:hi],
                         term[cut[lo] : cut[hi]], tf[cut[lo] : cut[hi]]))
            count += int(cut[hi] - cut[lo])
            lo = hi
            if count >= size or (lo < len(columns[0])):
                yield block()
                held, count = [], 0
    if held:
        yield block()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, each term once; rows that repeat an item_id are one item."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, terms = [], []
            for i, raw in zip(batch["item_id"], batch["raw"]):
                found = term_counts(raw.as_py())[1]
                numbers.extend([i.as_py()] * len(found))
                terms.extend(found)
            kind = batch.schema.field("item_id").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, kind), pa.array(terms, pa.binary())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    plain = items.where("text IS NOT NULL").select("item_id", F.col("text").cast("binary").alias("raw"))
    return plain.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = TOP, pass_terms: int = PASS_TERMS, block_postings: int = BLOCK_POSTINGS
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, ties by smaller doc_id.

    All item terms are counted first; items with up to `pass_terms` terms together are searched for in one pass over the
    documents, whose vocabulary goes to every task. Larger sets take several passes, dealt by hash. The driver sees the
    terms of a pass and one count for each. Rows that repeat a doc_id are separate documents; rows without one rank
    behind equal scores. Null and empty texts are found by nothing and find nothing; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = written(item_terms(items), "item-terms")
    passes = max(1, math.ceil(wanted.count() / pass_terms))
    out = None
    for p in range(passes):
        of_item = defaultdict(set)
        share = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p) if passes > 1 else wanted
        for r in share.collect():
            of_item[r["item_id"]].add(bytes(r["term"]))
        found = _one_pass(docs, dict(of_item), k, block_postings, kind)
        out = found if out is None else out.unionByName(found)
    dropped(wanted)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _one_pass(docs: DataFrame, of_item: dict, k: int, block_postings: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*of_item.values())))}
    index = written(index_of(docs, vocabulary), "term-index")
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    named = list(of_item)
    searched = spark.sparkContext.broadcast(
        (weights, [sorted(vocabulary[t] for t in of_item[i] if weights[vocabulary[t]] > 0) for i in named]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        w, terms = searched.value
        best = [Best(k) for _ in terms]
        for block in blocks_of(batches, w, n_docs, n_terms, block_postings):
            for t, b in zip(terms, best):
                block.search(t, b)
        for i, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(b.score), i), pa.int32()), pa.array(b.doc, mask=b.no_id), pa.array(b.score),
                ], names=["item", "doc_id", "score"])

    found = index.where(F.size("terms") > 0).mapInArrow(run, "item int, doc_id long, score long")
    names = spark.createDataFrame([(i, n) for i, n in enumerate(named)], f"item int, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
  FROM p JOIN w USING (term), s),
t AS (SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM i JOIN x USING (term) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM t WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""


@query("op12_ranked_search", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
