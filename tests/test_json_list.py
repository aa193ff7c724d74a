import json
import random

import pytest

from plumbline.sources.json_list import ListError, record_texts
from plumbline.sources.readers import IngestError, read_json_records


def awkward(n, seed=1):
    pick = random.Random(seed)
    bits = ["}", "{", "[", "]", '"', "\\", '\\"', "},{", '"records": [', "é", "中", "\n", "\t", "a", " ", " ", "\\u007d", ","]
    def value(depth):
        kind = pick.randrange(7 if depth < 3 else 4)
        if kind < 2:
            return "".join(pick.choice(bits) for _ in range(pick.randrange(9)))
        if kind == 2:
            return pick.choice([None, True, 12, -3.5, 1e30])
        if kind == 3:
            return ""
        if kind < 6:
            return {pick.choice(["a", "records", "}", 'q"']): value(depth + 1) for _ in range(pick.randrange(3))}
        return [value(depth + 1) for _ in range(pick.randrange(4))]
    return [{"id": i, "v": value(0), "w": value(0)} for i in range(n)]


def found(spark, path, split=None):
    rows = record_texts(spark, str(path), split).collect()
    out = {}
    for r in rows:
        out.setdefault(r.file.rsplit("/", 1)[-1], {})[r.number] = json.loads(r.record)
    return {f: [v[i] for i in range(len(v))] for f, v in out.items()}


@pytest.mark.parametrize("split", [None, 64, 1000])
def test_records_are_those_of_a_parser(spark, tmp_path, split):
    records = awkward(150)
    forms = {
        "list.json": json.dumps(records), "wide.json": "﻿ \n" + json.dumps(records, indent=3, ensure_ascii=False),
        "object.json": json.dumps({"records": records}),
        "middle.json": json.dumps({"meta": {"x": [1, {"y": "}"}], "records": 1}, "other": [{"a": 1}, 2],
                                   "records": records, "more": [1, [2], {"b": "]"}], "n": 3}),
        "one.json": json.dumps(records[:1]), "plain.json": '[{"a":1} , {"a":2}]'}
    for name, text in forms.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = found(spark, tmp_path, split)
    want = {n: records for n in ("list.json", "wide.json", "object.json", "middle.json")}
    assert got == want | {"one.json": records[:1], "plain.json": [{"a": 1}, {"a": 2}]}


def test_a_list_is_read_by_many_tasks(spark, tmp_path):
    records = awkward(400, 2)
    (tmp_path / "a.json").write_text(json.dumps(records))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    splits = {}
    for size in (2000, None):
        from plumbline.sources.json_list import _stretches
        splits[size] = _stretches(spark, str(tmp_path), size).select("split").distinct().count()
    assert splits[2000] > 5 and splits[None] == 1
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == kept


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}, {"a": 2}', "[1, 2]", '[{"a": 1}, 2]', '[[{"a": 1}]]', '"x"',
                                  '{"records": {"a": [1]}}', '{"records": [{"a": 1}'])
def test_anything_else_is_refused(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ListError):
        found(spark, tmp_path)
    with pytest.raises(IngestError):
        read_json_records(spark, str(tmp_path))


def test_empty_lists_have_no_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ ] ")
    assert found(spark, tmp_path) == {}
    with pytest.raises(IngestError):
        read_json_records(spark, str(tmp_path))
    (tmp_path / "b.json").write_text('{"records": []}')
    assert found(spark, tmp_path) == {}


def test_cells_are_text_and_missing_ones_null(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"b": 1.50, "a": "x"}, {"c": {"d": [1]}, "a": null}, {"b": true}]')
    rows = read_json_records(spark, str(tmp_path), split_bytes=16)
    assert rows.columns == ["a", "b", "c"] and {t for _, t in rows.dtypes} == {"string"}
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [("x", "1.5", None), (None, None, '{"d":[1]}'), (None, "true", None)], key=str)


def test_many_small_splits_are_few_tasks(spark, tmp_path):
    from plumbline.sources.json_list import _stretches
    (tmp_path / "a.json").write_text(json.dumps(awkward(400, 2)))
    stretches = _stretches(spark, str(tmp_path), 64)
    assert stretches.select("split").distinct().count() > 100
    assert len(stretches.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
    assert found(spark, tmp_path, 64) == {"a.json": awkward(400, 2)}


def test_text_is_shuffled_once_before_records_are_known(spark, tmp_path):
    from plumbline.sources.json_list import _shaped, _stretches
    (tmp_path / "a.json").write_text(json.dumps(awkward(50)))
    plan = _shaped(_stretches(spark, str(tmp_path), 64))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # sums along the text are stored, not worked out again
