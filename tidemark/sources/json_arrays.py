"""Large files that each hold one JSON array of objects, read by several tasks.

Spark's text source cuts a file at "}" and splits it into blocks. Where a record ends depends on what came before: how
deep the text is nested and whether it is inside a string. So the file is read twice. The first pass finds for each
block what it does to that state, from either start; the blocks' states then follow one from another. The second pass
starts each block in its state and gives out the records that end in it. A record that goes over a block's edge comes out
in pieces, two a block at most, which are put together per file. Records are parsed by Spark's own JSON reader.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.files import work_path

_ESCAPED = re.compile(r'\\.', re.DOTALL)
_OUTSIDE = re.compile(r"[\s,\[\]]*")


def fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, value): the text between closing braces, in order within a block."""
    text = spark.read.option("lineSep", "}").text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _effect(value: str) -> tuple[int, int, bool]:
    """(depth change if the text starts outside a string, if inside, whether it changes sides), closing brace apart."""
    if "\\" in value:
        value = _ESCAPED.sub("", value)
    parts = value.split('"')
    change = [0, 0]
    for i, part in enumerate(parts):
        change[i % 2] += part.count("{") + part.count("[") - part.count("]")
    return change[0], change[1], len(parts) % 2 == 0


def _runs(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, block), value) row by row."""
    for frame in frames:
        yield from zip(zip(frame["file"], frame["block"].tolist()), frame["value"])


def _block_effects(found: DataFrame) -> DataFrame:
    """For each block and start (outside or inside a string): where it ends and by how much depth changes."""
    def run(frames) -> Iterator[pd.DataFrame]:
        at, state, rows = None, None, []
        for key, value in _runs(frames):
            if key != at:
                if at is not None:
                    rows.append((*at, *state[0], *state[1]))
                at, state = key, [(0, False), (0, True)]
            outside, inside, flips = _effect(value)
            for i, (depth, within) in enumerate(state):
                depth += inside if within else outside
                within ^= flips
                state[i] = (depth - (not within), within)  # the closing brace counts outside strings
        if at is not None:
            rows.append((*at, *state[0], *state[1]))
        yield pd.DataFrame(rows, columns=["file", "block", "depth0", "within0", "depth1", "within1"])

    return found.mapInPandas(run, "file string, block long, depth0 long, within0 boolean, depth1 long, within1 boolean")


def _starts(effects: DataFrame) -> dict[tuple[str, int], tuple[int, bool]]:
    """The (depth, inside a string) each block starts in; one line per block comes to the driver."""
    blocks = defaultdict(list)
    for r in effects.collect():
        blocks[r["file"]].append(r)
    out = {}
    for file, rows in blocks.items():
        depth, within = 0, False
        for r in sorted(rows, key=lambda r: r["block"]):
            out[file, r["block"]] = depth, within
            i = int(within)
            depth, within = depth + r[f"depth{i}"], r[f"within{i}"]
        if (depth, within) != (-1, False):  # the text after the last brace counts one too many
            raise ValueError(f"{file} is no JSON array, or ends before its array does")
    return out


#: Kinds of text: the end of a record that began in an earlier block, the inside of one, its beginning, a whole record.
_TAIL, _INSIDE, _HEAD, _WHOLE = range(4)


class _Block:
    """Takes the fragments of one block in order and tells what they make up."""

    def __init__(self, file: str, depth: int, within: bool):
        self.file, self.depth, self.within = file, depth, within
        self.held: list[str] = []
        self.began_before = depth > 1

    def take(self, value: str) -> tuple[int, str] | None:
        """The kind and text of what ends with this fragment, if anything does."""
        outside, inside, flips = _effect(value)
        self.depth += inside if self.within else outside
        self.within ^= flips
        if self.depth == 0 and not self.within:  # the array is closed; no brace follows
            self._expect(_OUTSIDE.fullmatch("".join([*self.held, value])), value)
            self.held = []
            return None
        self.held += [value, "}"]
        if self.within:
            return None
        self.depth -= 1
        if self.depth != 1:
            return None
        text, kind = "".join(self.held), _TAIL if self.began_before else _WHOLE
        self.held, self.began_before = [], False
        return kind, text if kind == _TAIL else self._object(text)

    def rest(self) -> tuple[int, str] | None:
        """What is left of a record that goes on in the next block."""
        if not self.held:
            return None
        text = "".join(self.held)
        return (_INSIDE, text) if self.began_before else (_HEAD, self._object(text))

    def _object(self, text: str) -> str:
        text = text[_OUTSIDE.match(text).end() :]
        self._expect(text.startswith("{"), text)
        return text

    def _expect(self, ok, text: str) -> None:
        if not ok:
            raise ValueError(f"the array in {self.file} holds something else than objects: {text[:80]!r}")


def _pieces(frames: Iterator[pd.DataFrame], starts: dict[tuple[str, int], tuple[int, bool]]) -> Iterator[pd.DataFrame]:
    """(file, block, kind, value) of what ends in each batch of fragments; a task holds one batch and an open record."""
    columns = ["file", "block", "kind", "value"]
    at = block = None
    for frame in frames:
        rows = []
        for key, value in _runs([frame]):
            if key != at:
                if block is not None and (left := block.rest()):
                    rows.append((*at, *left))
                at, block = key, _Block(key[0], *starts[key])
            if ended := block.take(value):
                rows.append((*at, *ended))
        yield pd.DataFrame(rows, columns=columns)
    if block is not None and (left := block.rest()):
        yield pd.DataFrame([(*at, *left)], columns=columns)


def _stitched(pieces: pd.DataFrame) -> pd.DataFrame:
    """The records of one file that go over the edges of its blocks."""
    out, held = [], []
    for kind, value in pieces.sort_values(["block", "kind"])[["kind", "value"]].itertuples(index=False):
        held = [value] if kind == _HEAD else [*held, value]
        if kind == _TAIL:
            out.append("".join(held))
    return pd.DataFrame({"value": out})


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value): the text of each object of the arrays, in no set order. The arrays must hold objects only.

    The texts are kept in the shared work folder, where parsing and type inference read them. Text of records that go
    over a block's edge, two pieces a block, meets in one task a file.
    """
    found = fragments(spark, paths)
    starts = spark.sparkContext.broadcast(_starts(_block_effects(found)))

    path = work_path(spark, "json-records")
    cut = found.mapInPandas(
        lambda frames: _pieces(frames, starts.value), "file string, block long, kind int, value string")
    cut.write.parquet(path)
    pieces = spark.read.parquet(path)
    whole = pieces.where(F.col("kind") == _WHOLE).select("value")
    edges = pieces.where(F.col("kind") != _WHOLE).groupBy("file").applyInPandas(_stitched, "value string")
    return whole.unionByName(edges)


def parsed(texts: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """Objects as rows, by Spark's JSON reader; types are inferred from all of them unless a schema is given."""
    spark = texts.sparkSession
    reader = spark.read if schema is None else spark.read.schema(schema)
    strings = getattr(texts.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.json(strings), spark)
