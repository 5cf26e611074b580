"""JSON arrays read by several tasks give the rows that a task a file gives."""

import json
import random

import pandas as pd
import pytest

from conftest import rows
from tidemark.sources import json_arrays
from tidemark.sources.readers import read_json_array

ODD = ['}', '{', '"', '\\', '\\"', '}{', '[]', ',', '\n', '\t', 'é中\U0001f600', 'a}b"c\\', '', '\\\\', '","', '"}', '{"x": 1}']


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def odd_value(r, depth=0):
    kind = r.random()
    if depth < 3 and kind < 0.2:
        return {f"k{i}": odd_value(r, depth + 1) for i in range(r.randrange(3))}
    if depth < 3 and kind < 0.35:
        return [odd_value(r, depth + 1) for _ in range(r.randrange(3))]
    return "".join(r.choices(ODD, k=r.randrange(6)))


def odd_records(seed, n):
    """Objects with one schema whose texts are full of braces, quotes and escapes."""
    r = random.Random(seed)
    return [
        {"id": i, "s": "".join(r.choices(ODD, k=r.randrange(8))), "j": json.dumps(odd_value(r)),
         "t": {"a": [{"b": r.choice(ODD)} for _ in range(r.randrange(3))]} if r.random() < 0.7 else None,
         "l": [r.randrange(9) for _ in range(r.randrange(4))]}
        for i in range(n)
    ]


SCHEMA = "id long, s string, j string, t struct<a: array<struct<b: string>>>, l array<long>"


@pytest.mark.parametrize("indent,ascii", [(None, True), (2, False), (None, False)])
def test_the_same_rows_as_one_task(spark, tmp_path, small_blocks, indent, ascii):
    for k, n in enumerate((0, 1, 60, 200)):
        (tmp_path / f"{k}.json").write_text(json.dumps(odd_records(k, n), indent=indent, ensure_ascii=ascii), "utf-8")
    (tmp_path / "blank.json").write_text(" \n[ ]\n ")
    files = str(tmp_path)
    want = rows(read_json_array(spark, files, schema=SCHEMA, split=False))
    assert len(want) == 261
    found = json_arrays.fragments(spark, [files])
    assert found.select("file", "block").distinct().count() > 50 and found.rdd.getNumPartitions() > 1
    assert rows(read_json_array(spark, files, schema=SCHEMA, split=True)) == want
    assert rows(read_json_array(spark, files, schema=SCHEMA)) == want  # larger than a task's share: split
    inferred = read_json_array(spark, files, split=True)
    assert inferred.schema == read_json_array(spark, files, split=False).schema
    assert rows(inferred.select("id", "s", "j", "t", "l")) == want


def test_a_record_longer_than_several_blocks(spark, tmp_path, small_blocks):
    data = [{"id": 1, "s": "}" * 2000}, {"id": 2, "s": "x"}, {"id": 3, "s": '{"' * 900, "deep": {"a": {"b": ["}"] * 500}}}]
    (tmp_path / "a.json").write_text(json.dumps(data))
    got = read_json_array(spark, str(tmp_path), schema="id long, s string", split=True)
    assert rows(got) == [(d["id"], d["s"]) for d in data]


def test_a_task_gives_out_records_batch_by_batch():
    """What a task holds depends on the batches it gets, not on how much text its block has."""
    taken = []

    def batches():
        for k in range(40):
            values = [f'{"[" if not k and not i else ","}{{"a": {i}, "s": "x"' for i in range(500)]
            taken.append(k)
            yield pd.DataFrame({"file": "f", "block": 0, "value": values})
        yield pd.DataFrame({"file": ["f"], "block": [0], "value": ["]"]})

    rows_out = 0
    for n, out in enumerate(json_arrays._pieces(batches(), {("f", 0): (0, False)})):
        assert len(taken) <= n + 1 and len(out) <= 500
        rows_out += len(out)
    assert rows_out == 40 * 500


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}, 5]', '[{"a": 1}, null, {"a": 2}]', '{"a": 1}', '["x}y", {"a": 1}]'])
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="array"):
        read_json_array(spark, str(tmp_path), schema="a long", split=True).collect()
