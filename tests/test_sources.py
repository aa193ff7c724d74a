import hashlib

import pytest
from pyspark.sql import types as T

from plumbline.sources.digests import file_digests
from plumbline.sources.readers import new_files
from plumbline.streaming.drops import rejected_cells, watch_csv


def tree(data, page, fan):
    level = [hashlib.sha256(data[i:i + page]).hexdigest() for i in range(0, max(len(data), 1), page)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + bytes.fromhex("".join(level[i:i + fan]))).hexdigest()
                 for i in range(0, len(level), fan)]
    return level[0]


@pytest.mark.parametrize("page,fan", [(7, 2), (64, 3), (1 << 20, 1024)])
def test_digest_is_the_root_of_the_hash_tree(spark, tmp_path, page, fan):
    files = {"empty": b"", "one": b"x", "page": b"a" * page, "more": bytes(range(256)) * 3, "näme with space": b"\x00\xff\n" * 50,
             "edge": b"b" * (page * fan * 2 + 1) if page < 100 else b"b" * 5000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.input_hash) for r in file_digests(spark, str(tmp_path), page, fan).collect()}
    assert got == {n: (len(d), tree(d, page, fan)) for n, d in files.items() if d}
    if page == 1 << 20:
        assert got["more"][1] == hashlib.sha256(files["more"]).hexdigest()


def test_new_files_by_content_in_small_pages(spark, tmp_path):
    for name, data in (("a", b"1" * 100), ("b", b"2" * 100), ("c", b"1" * 100), ("d", b"1" * 99 + b"3")):
        (tmp_path / name).write_bytes(data)
    done = spark.createDataFrame([(tree(b"2" * 100, 16, 1024), "COMPLETED"), (tree(b"1" * 100, 16, 1024), "FAILED")],
                                 "input_hash string, status string")
    got = {r.path[-1]: r.input_hash for r in new_files(spark, str(tmp_path), done, 16).collect()}
    assert got == {"a": tree(b"1" * 100, 16, 1024), "d": tree(b"1" * 99 + b"3", 16, 1024)}


KIND = (T.StructType().add("record_id", T.StringType()).add("age", T.LongType()).add("income", T.DoubleType()))


def test_an_extract_is_taken_once_whatever_its_name(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()

    def run():
        watch_csv(spark, str(drop), KIND, str(out), str(out / "checkpoint"), rules=[]).awaitTermination()
        return sorted(r.record_id for r in spark.read.parquet(f"{out}/records").collect())

    (drop / "a.csv").write_text("record_id,age,income\nR1,5,1.5\nR2,x,2\n")
    (drop / "b.csv").write_text("record_id,age,income\nR1,5,1.5\nR2,x,2\n")
    assert run() == ["R1", "R2"]
    (drop / "c.csv").write_text("record_id,age,income\nR1,5,1.5\nR2,x,2\n")
    (drop / "d.csv").write_text("record_id,age,income\nR3,7,\n")
    assert run() == ["R1", "R2", "R3"]
    assert run() == ["R1", "R2", "R3"]
    bad = spark.read.parquet(f"{out}/rejects").collect()
    assert [(r.column, r.raw_text) for r in bad] == [("age", "x")] and bad[0].source_file.endswith(".csv")


def test_rejected_cells_are_those_that_do_not_parse(spark):
    raw = spark.createDataFrame([("R1", "5", "1,000.5"), ("R2", "5.5", "-"), ("R3", " n/a ", "12x"), ("R4", None, ""),
                                 ("R5", "99999999999999999999", "nan?")], "record_id string, age string, income string")
    got = {(r.record_id, r.column, r.raw_text) for r in rejected_cells(raw, KIND, ["record_id"]).collect()}
    assert got == {("R1", "income", "1,000.5"), ("R2", "age", "5.5"), ("R3", "income", "12x"), ("R5", "age", "99999999999999999999"),
                   ("R5", "income", "nan?")}
    assert not rejected_cells(raw, T.StructType.fromDDL("record_id string"), ["record_id"]).collect()


def test_rules_of_a_drop_read_its_parsed_records(spark, tmp_path, monkeypatch):
    from plumbline.streaming import drops
    seen = []

    def noted(records, *rest, **named):
        seen.append(records)
        return evaluate(records, *rest, **named)

    evaluate = drops.evaluate_rules
    monkeypatch.setattr(drops, "evaluate_rules", noted)
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.csv").write_text("record_id,age,income\nR1, 200 ,1.5\nR2,about 30,-1\n")
    kind = T.StructType.fromDDL("record_id string, age bigint, income double")
    watch_csv(spark, str(tmp_path / "drop"), kind, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert seen and all("/out/records/" in f for df in seen for f in df.inputFiles())
    broken = spark.read.parquet(str(tmp_path / "out" / "violations")).select("record_id", "rule_code").collect()
    assert {("R1", "AGE_MAX"), ("R2", "INCOME_NON_NEGATIVE")} <= {tuple(r) for r in broken}
    bad = spark.read.parquet(str(tmp_path / "out" / "rejects")).select("column", "raw_text").collect()
    assert [tuple(r) for r in bad] == [("age", "about 30")]
