"""Benchmark decontamination by template canonicalisation, in DataFrame operations alone.

Numbers, names and units of a text become typed placeholders that keep their value beside them, so a benchmark
question and its copy with other figures have the same template. Template windows of eight tokens are hashed and
joined; windows that agree at the same distance form one placement of an item in a document. In each placement the
slots are held against the item's: one value of the item must stand for one value of the document. Where it stands for
several, the most frequent one counts, and windows that hold another are dropped. A document is contaminated by an item
if what is left holds at least `share` of the item's windows.

A template of little but placeholders would match any table of figures. Windows poor in plain words are therefore looked
up with their values, so that exact copies of them are found and nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.registry import query

WINDOW = 8
#: Plain words that a window must hold to be looked up as a template; others are looked up with their values. Items of fewer
#: tokens than that match only documents that consist of them.
LEAST_PLAIN = 4
SHARE = 0.3
#: Item windows that are broadcast at most (16 bytes and some each); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000

# Unit words.
UNITS = (
    "km|cm|mm|kg|mg|lb|lbs|oz|ml|mph|kmh|hz|kwh|usd|eur|percent|dollars?|cents?|euros?|pounds?|hours?|minutes?|"
    "seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|kilometers?|kilometres?|inches|feet|grams?|"
    "kilograms?|liters?|litres?|degrees?"
)
#: (pattern, replacement), in this order, on a text whose words stand between spaces of their own. The patterns
#: mean the same in Java and in RE2. A name is a capitalised word that does not follow the end of a sentence;
#: its rule runs twice because neighbouring matches would share a letter.
_NAME = (r"([^.!?:; ]  )(\p{Lu}\p{Ll}+[^\p{L}\p{N} ]* )", "{1}#n{2}")
RULES = [
    (r"[#\x00-\x20]+", "  "),
    _NAME,
    _NAME,
    (r" ([^\p{L} #]*[0-9][^\p{L} #]*) ", " #q{1} "),
    (rf" ((?i:{UNITS}))([^\p{{L}}\p{{N}} ]*) ", " #u{1}{2} "),
    (r"[^\p{L}\p{N}# ]+", ""),
    (r" +", " "),
]


def tokens_of(text: Column) -> Column:
    """Clean tokens: plain words in lower case, slots as #q, #n or #u followed by their value."""
    out = F.concat(F.lit("  "), text, F.lit("  "))
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return F.filter(F.split(F.trim(F.lower(out)), " "), lambda t: t != "")


def template_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.startswith("#"), F.substring(t, 1, 2)).otherwise(t))


def _windows(template: Column, lengths: list[int]) -> Column:
    """All (at, h) of the windows of these lengths, at from 1."""
    def of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(template) - k + 1)
        each = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(template, i, k)).alias("h")))
        return F.when(F.size(template) >= k, each).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))

    parts = [of(k) for k in lengths]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def slots_of(tokens: Column) -> Column:
    """Places of the slots, from 1."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t.startswith("#"), i + 1)), lambda i: i.isNotNull())


def _exact_windows(tokens: Column, slots: Column, lengths: list[int]) -> Column:
    """(at, h) of the windows of these lengths that are poor in plain words, with their values.

    Such a window of k tokens holds k - LEAST_PLAIN + 1 slots or more, so only places around slots are looked at. Windows
    below LEAST_PLAIN tokens must be the whole text.
    """
    none = F.array().cast("array<int>")

    def starts(k: int) -> Column:
        if k < LEAST_PLAIN:
            return F.when(F.size(tokens) == k, F.array(F.lit(1))).otherwise(none)
        m = k - LEAST_PLAIN + 1

        def around(j: Column) -> Column:
            first, last = F.element_at(slots, j), F.element_at(slots, j + (m - 1))
            low, high = F.greatest(F.lit(1), last - (k - 1)), F.least(first, F.size(tokens) - (k - 1))
            return F.when(low <= high, F.sequence(low, high)).otherwise(none)

        runs = F.transform(F.sequence(F.lit(1), F.size(slots) - (m - 1)), around)
        return F.when(F.size(slots) >= m, F.array_distinct(F.flatten(runs))).otherwise(none)

    def of(k: int) -> Column:
        return F.transform(starts(k), lambda i: F.struct(i.alias("at"), _exact_hash(F.slice(tokens, i, k)).alias("h")))

    parts = [of(k) for k in lengths]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _exact_hash(piece: Column) -> Column:
    return F.xxhash64(F.lit("exact"), piece)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, exact) for each document and each item found in it.

    exact: some placement has all slot values unchanged; else the question was given other figures or names. An
    item shorter than `window` tokens is one window. An item counts as found by `share` of all its windows, or of
    those that are looked up as templates. Items of fewer than LEAST_PLAIN tokens are found in documents of just these
    tokens, items without text nowhere. Null and empty documents and null doc_ids have no findings; rows that repeat a
    doc_id count as one document. Other columns are ignored; no documents or no items give no rows.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", tokens_of(F.col("text")).alias("t"))
    items = items.dropDuplicates(["item_id", "t"]).withColumn("c", template_of(F.col("t")))
    width = F.least(F.size("c"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("c") - width + 1)
    items = items.where(F.size("c") > 0).withColumn("w", width).withColumn("item_at", F.explode(starts))
    piece = F.slice(F.col("c"), F.col("item_at"), F.col("w"))
    with_values = F.slice(F.col("t"), F.col("item_at"), F.col("w"))
    rich = F.size(F.filter(piece, lambda t: ~t.startswith("#"))) >= LEAST_PLAIN
    keys = written(
        items.select("item_id", "item_at", "w", rich.alias("rich"),
                     F.when(rich, F.xxhash64(piece)).otherwise(_exact_hash(with_values)).alias("h")).distinct(),
        "item-windows")
    facts = keys.agg(  # window lengths at most
        F.count("*").alias("n"), F.collect_set(F.when(F.col("rich"), F.col("w"))).alias("lengths"),
        F.collect_set(F.when(~F.col("rich"), F.col("w"))).alias("exact_lengths")).first()
    lengths, exact_lengths = sorted(facts["lengths"]), sorted(facts["exact_lengths"])
    sizes = keys.groupBy("item_id").agg(
        F.countDistinct("item_at").alias("n_windows"),
        F.countDistinct(F.when(F.col("rich"), F.col("item_at"))).alias("n_rich"))

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text")
    at = texts.select("doc_id", "text_key", tokens_of(F.col("text")).alias("t"))
    # columns of their own, as what stands inside a lambda is worked out for each of its elements
    at = at.select("doc_id", "text_key", "t", template_of(F.col("t")).alias("c"), slots_of(F.col("t")).alias("s"))
    found = [_windows(F.col("c"), lengths or [window])]
    if exact_lengths:
        found.append(_exact_windows(F.col("t"), F.col("s"), exact_lengths))
    at = at.select("doc_id", "text_key", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("x"))
    at = at.select("doc_id", "text_key", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    side = F.broadcast(keys) if facts["n"] <= BROADCAST_WINDOWS else keys
    hits = written(at.join(side, "h").select(
        "doc_id", "text_key", "item_id", "item_at", "w", "rich", (F.col("at") - F.col("item_at")).alias("shift")),
        "window-hits")

    # Slots: of the item, moved to where it lies in the document, and of the documents that have hits.
    place = ["doc_id", "text_key", "item_id", "shift"]
    placed = hits.groupBy(*place).agg(
        F.min("item_at").alias("low"), F.max(F.col("item_at") + F.col("w") - 1).alias("high"))
    item_slots = benchmark.select("item_id", F.posexplode(tokens_of(F.col("text"))).alias("i", "item_value"))
    item_slots = item_slots.where("item_value LIKE '#%'").select("item_id", (F.col("i") + 1).alias("i"), "item_value").distinct()
    asked = placed.join(item_slots, "item_id").where("i BETWEEN low AND high")
    asked = asked.withColumn("at", F.col("i") + F.col("shift"))
    hit_docs = hits.select("doc_id", "text_key").distinct()
    doc_slots = texts.join(hit_docs, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    doc_slots = doc_slots.select("doc_id", "text_key", F.posexplode(tokens_of(F.col("text"))).alias("i", "value"))
    doc_slots = doc_slots.where("value LIKE '#%'").select("doc_id", "text_key", (F.col("i") + 1).alias("at"), "value")
    slots = written(asked.join(doc_slots, ["doc_id", "text_key", "at"]).where(
        F.substring("value", 1, 2) == F.substring("item_value", 1, 2)).select(*place, "i", "item_value", "value"), "window-slots")
    counted = slots.groupBy(*place, "item_value", "value").agg(F.count("*").alias("n"))
    stands = counted.groupBy(*place, "item_value").agg(F.min(F.struct(-F.col("n"), "value")).alias("best"))
    clashes = slots.join(stands, [*place, "item_value"]).where("value <> best.value").select(*place, "i").distinct()
    same = slots.groupBy(*place).agg(F.bool_and(F.col("value") == F.col("item_value")).alias("same"))
    left = hits.alias("h").join(
        clashes.alias("c"), F.expr(" AND ".join(f"h.{c} = c.{c}" for c in place) + " AND c.i BETWEEN h.item_at AND h.item_at + h.w - 1"),
        "left_anti")
    good = left.join(same, place, "left").groupBy("doc_id", "item_id").agg(
        F.countDistinct("item_at").alias("n_matched"),
        F.countDistinct(F.when(F.col("rich"), F.col("item_at"))).alias("rich_matched"),
        F.max(F.coalesce("same", F.lit(True))).alias("exact"))
    enough = (F.col("n_matched") >= F.col("n_windows") * F.lit(share)) | (
        (F.col("rich_matched") > 0) & (F.col("rich_matched") >= F.col("n_rich") * F.lit(share)))
    return good.join(sizes, "item_id").where(enough).select("doc_id", "item_id", "n_matched", "n_windows", "exact")


def _sql_tokens(source: str, key: str) -> str:
    text = "'  ' || text || '  '"
    for pattern, to in RULES:
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    return f"SELECT {key}, list_filter(string_split(trim(lower({text})), ' '), lambda x: x <> '') AS t FROM {source} WHERE text IS NOT NULL AND {key} IS NOT NULL"


_TEMPLATE = "list_transform(t, lambda x: CASE WHEN x LIKE '#%' THEN left(x, 2) ELSE x END)"
_KEYS = "doc_id, item_id, shift"
ORACLE = f"""
WITH dt AS (SELECT *, {_TEMPLATE} AS c FROM ({_sql_tokens('documents', 'doc_id')})),
bt AS (SELECT *, {_TEMPLATE} AS c FROM ({_sql_tokens('benchmark', 'item_id')})),
bw AS (SELECT item_id, least(len(c), {WINDOW}) AS w, c, t, unnest(range(1, len(c) - least(len(c), {WINDOW}) + 2)) AS item_at
       FROM bt WHERE len(c) > 0),
bp AS (SELECT item_id, item_at, w, list_slice(c, item_at, item_at + w - 1) AS p, list_slice(t, item_at, item_at + w - 1) AS q,
       len(list_filter(list_slice(c, item_at, item_at + w - 1), lambda x: x NOT LIKE '#%')) >= {LEAST_PLAIN} AS rich FROM bw),
bk AS (SELECT DISTINCT item_id, item_at, w, rich, CASE WHEN rich THEN p ELSE q END AS p FROM bp),
dw AS (SELECT doc_id, w, rich, unnest(range(1, len(c) - w + 2)) AS pos, CASE WHEN rich THEN c ELSE t END AS s
       FROM dt, (SELECT DISTINCT w, rich FROM bk) WHERE len(c) >= w AND (w >= {LEAST_PLAIN} OR len(c) = w)),
hits AS (SELECT d.doc_id, b.item_id, b.item_at, b.w, b.rich, d.pos - b.item_at AS shift
         FROM (SELECT doc_id, pos, rich, list_slice(s, pos, pos + w - 1) AS p FROM dw) d JOIN bk b USING (p, rich)),
placed AS (SELECT doc_id, item_id, shift, min(item_at) AS low, max(item_at + w - 1) AS high FROM hits GROUP BY ALL),
bs AS (SELECT item_id, i, t[i] AS item_value FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i FROM bt)
       WHERE t[i] LIKE '#%'),
ds AS (SELECT doc_id, i AS pos, t[i] AS value FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM dt)
       WHERE t[i] LIKE '#%'),
slots AS (
  SELECT p.doc_id, p.item_id, p.shift, i, item_value, value
  FROM placed p JOIN bs ON bs.item_id = p.item_id AND i BETWEEN low AND high
  JOIN ds ON ds.doc_id = p.doc_id AND ds.pos = i + p.shift AND left(value, 2) = left(item_value, 2)),
stands AS (
  SELECT {_KEYS}, item_value, first(value ORDER BY n DESC, value) AS best
  FROM (SELECT {_KEYS}, item_value, value, count(*) AS n FROM slots GROUP BY ALL) GROUP BY ALL),
clashes AS (SELECT DISTINCT {_KEYS}, i FROM slots JOIN stands USING ({_KEYS}, item_value) WHERE value <> best),
same AS (SELECT {_KEYS}, bool_and(item_value = value) AS same FROM slots GROUP BY ALL),
good AS (SELECT doc_id, item_id, count(DISTINCT item_at) AS n_matched,
           count(DISTINCT CASE WHEN rich THEN item_at END) AS rich_matched, bool_or(coalesce(same, true)) AS exact
         FROM hits h LEFT JOIN same USING ({_KEYS})
         WHERE NOT EXISTS (SELECT 1 FROM clashes c WHERE c.doc_id = h.doc_id AND c.item_id = h.item_id
           AND c.shift = h.shift AND c.i BETWEEN h.item_at AND h.item_at + h.w - 1) GROUP BY ALL)
SELECT doc_id, item_id, n_matched, n_windows, exact FROM good
JOIN (SELECT item_id, count(DISTINCT item_at) AS n_windows, count(DISTINCT CASE WHEN rich THEN item_at END) AS n_rich
      FROM bk GROUP BY ALL) USING (item_id)
WHERE n_matched >= n_windows * {SHARE} OR rich_matched > 0 AND rich_matched >= n_rich * {SHARE}
"""


@query("op6_decontaminate", ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
