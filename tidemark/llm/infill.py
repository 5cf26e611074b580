"""Fill-in-the-middle transformation with a learned index over unit boundaries.

A text is cut after a number of units (code points, or words with the white space after them) but moved as bytes, so
each cut needs the byte offset of a unit's end. The offsets of all boundaries are fitted by straight segments within
an error bound, longest segment first come: a segment grows while one slope fits all its points. What the
line misses by is kept as one signed byte a boundary. A cut is predicted from its rank alone and corrected by the
stored residual, which makes it exact. ASCII text is one segment; mixed scripts take a few.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.registry import query

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How far a segment's line may be off; residuals fit one signed byte.
ERROR = 96
#: Boundaries a segment is extended by at a time.
STEP = 4096
#: Bytes of output a task holds before it hands them on.
BATCH_BYTES = 16 << 20

UNITS = {"character": None, "word": re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")}


def boundaries(raw: bytes, unit: str = "character") -> np.ndarray:
    """Byte offsets of all unit boundaries, matched left to right: 0 first, the length of the text last."""
    if unit == "character":
        b = np.frombuffer(raw, np.uint8)
        return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(raw))
    return np.fromiter((0, *(m.end() for m in UNITS[unit].finditer(raw))), np.int64)


class RankIndex:
    """Rank of a boundary to its offset: fitted segments and a residual for each boundary."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        starts, slopes, bases = [], [], []
        i, n = 0, len(offsets)
        while i < n:
            j, low, high = i + 1, -np.inf, np.inf
            base = float(offsets[i])
            while j < n:  # the slopes that keep all points of the segment within the error bound
                part = offsets[j : j + STEP] - base
                run = np.arange(j - i, j - i + len(part), dtype=np.float64)
                lows = np.maximum(np.maximum.accumulate((part - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((part + error) / run), high)
                bad = np.flatnonzero(lows > highs)
                good = int(bad[0]) if len(bad) else len(part)
                if good:
                    low, high = lows[good - 1], highs[good - 1]
                j += good
                if good < len(part):
                    break
            starts.append(i)
            bases.append(base)
            slopes.append((low + high) / 2 if j > i + 1 else 0.0)
            i = j
        self.starts = np.array(starts, np.int64)
        self.bases, self.slopes = np.array(bases), np.array(slopes)
        missed = offsets - self.predict(np.arange(n))
        if len(missed) and max(-int(missed.min()), int(missed.max())) > 127:
            raise ValueError("a residual does not fit one byte")
        self.residuals = missed.astype(np.int8)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.starts, ranks, "right") - 1
        return np.rint(self.bases[s] + self.slopes[s] * (ranks - self.starts[s])).astype(np.int64)

    def offset(self, *ranks: int) -> list[int]:
        """The exact offset of each boundary asked for."""
        at = np.array(ranks, np.int64)
        return (self.predict(at) + self.residuals[at]).tolist()


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers from the SHA-256 of `seed:doc_id`; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(raw: bytes, doc_id: int | None, seed: int, rate: int, suffix_first: int, unit: str):
    """(n, form, prefix units, middle units, output) of one text."""
    ends = boundaries(raw, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not raw or h3 % 100 >= rate or p in raw or s in raw or m in raw:
        return n, "plain", None, None, raw
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = RankIndex(ends).offset(a, b)
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, b"".join((s, raw[j:], p, raw[:i], m, raw[i:j]))
    return n, "psm", a, b - a, b"".join((p, raw[:i], s, raw[j:], m, raw[i:j]))


def fill_in_middle(
    docs: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20, unit: str = "character"
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (in units, null if plain), output per document.

    rate per cent of the texts are cut in three, `suffix_first` per cent of these as spm, the others as psm. Texts that
    are null or empty, or hold a sentinel, stay plain. Cuts depend on doc_id and seed alone: rows that repeat a doc_id
    draw the same numbers, as do all rows without one. Very long texts are handled whole, one at a time. One pass, no
    shuffle; an empty table gives no rows; other columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(frames) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for named, doc_id, raw in zip(frame["named"].tolist(), frame["id"].tolist(), frame["raw"]):
                doc_id = doc_id if named else None
                rows.append((doc_id, *transformed(bytes(raw), doc_id, seed, rate, suffix_first, unit)))
                held += len(raw)
                if held > BATCH_BYTES:
                    yield as_frame(rows)
                    rows, held = [], 0
            yield as_frame(rows)

    def as_frame(rows) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns, dtype=object)
        out["output"] = [r[-1].decode("utf-8", "replace") for r in rows]
        return out.astype({c: "Int64" for c in ("doc_id", "n", "prefix_chars", "middle_chars")})

    plain = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNotNull().alias("named"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"),
    )
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return plain.mapInPandas(run, schema)


def restored(output: str = "output", form: str = "form"):
    """The text that an output was made from, as a column, from output and form alone.

    A transformed text holds each sentinel once, as texts with sentinels of their own stay plain.
    """
    out, head = F.col(output), F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    first = lambda end: F.substr(F.substring_index(output, end, 1), F.lit(len(PREFIX) + 1))
    psm = F.concat(first(SUFFIX), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, first(PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (
  SELECT *, least(a, b) AS i, greatest(a, b) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
  SELECT *, substr(t, 1, i) AS pre, substr(t, i + 1, j - i) AS mid, substr(t, j + 1) AS suf FROM f)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op13_fill_in_middle", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )
