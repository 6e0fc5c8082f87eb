import glob
import json

import pytest

from autolens.operators.column_types import infer_types
from autolens.operators.staging import stage
from autolens.plans.analysis import analyze
from autolens.sources import read, write


def save(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, separator):
    text = "\n".join(separator.join(r) for r in [("id", "name", "x"), ("1", "a b", "1.5"), ("2", "", "2.5")])
    df, info = read.read_table(spark, save(tmp_path, "t.csv", text))
    assert info.separator == separator and (info.rows, info.columns) == (2, 3) and not info.errors
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a b", 1.5), (2, None, 2.5)]


def test_quotes_beat_other_separators(spark, tmp_path):
    df, info = read.read_table(spark, save(tmp_path, "t.csv", 'a,b\n"x;y;z",1\n"say ""hi"", now",2\n'))
    assert info.separator == ","
    assert [r["a"] for r in df.orderBy("b").collect()] == ["x;y;z", 'say "hi", now']


def test_encodings(spark, tmp_path):
    for name, data, encoding in (
        ("u.csv", "n,v\nMünchen,1\n".encode(), "UTF-8"), ("b.csv", b"\xef\xbb\xbf" + "n,v\nMünchen,1\n".encode(), "UTF-8"),
        ("l.csv", "n,v\nMünchen,1\n".encode("latin-1"), "ISO-8859-1"),
    ):
        df, info = read.read_table(spark, save(tmp_path, name, data))
        assert info.encoding == encoding and df.columns == ["n", "v"] and df.first()["n"] == "München"


def test_null_cells_and_types(spark, tmp_path):
    text = "n,f,s,b,mixed,money\n1,1.5,NA,True,1,$5\n,N/A,x,False,two,$6\n3,nan,NULL,True,3,\n"
    df, _ = read.read_table(spark, save(tmp_path, "t.csv", text))
    assert dict(df.dtypes) == {"n": "bigint", "f": "double", "s": "string", "b": "boolean", "mixed": "string", "money": "string"}
    assert df.where("n is null").count() == 1 and df.where("f is null").count() == 2 and df.where("s is null").count() == 2
    assert infer_types(df)["money"] == "numerical"


def test_headers(spark, tmp_path):
    df, info = read.read_table(spark, save(tmp_path, "t.csv", "a,,a,A.b\n1,2,3,4\n"))
    assert df.columns == ["a", "Unnamed: 1", "a.1", "A.b"] and len(info.warnings) == 2


def test_bad_inputs(spark, tmp_path):
    assert read.read_table(spark, "table.xyz")[1].errors and read.read_table(spark, "")[1].errors
    assert read.read_table(spark, str(tmp_path / "missing.csv"))[1].errors
    df, info = read.read_table(spark, save(tmp_path, "head.csv", "a,b\n"))
    assert df is None and not info.valid and info.errors
    df, info = read.read_table(spark, save(tmp_path, "empty.csv", ""))
    assert df is None and info.errors


def test_size_label():
    assert [read.size_label(n) for n in (0, 5, 2048, 3 * 1024**2, 100 * 1024**4, 2**70)] == [
        "0 B", "5 B", "2.0 KB", "3.00 MB", "100.00 TB", "1048576.00 PB"]


def records_of(path):
    import csv

    with open(path, newline="", encoding="utf-8") as f:
        return [r for r in csv.reader(f) if r]


def test_line_breaks_in_cells(spark, tmp_path):
    path = save(tmp_path, "t.csv", 'a,b\n"x\ny",1\n"x\r\n\r\ny ""q"", z",2\r\n\n,3\n')
    df, _ = read.read_table(spark, path)
    assert {r["b"]: r["a"] for r in df.collect()} == {1: "x\ny", 2: 'x\r\n\r\ny "q", z', 3: None}


@pytest.mark.parametrize("seed", range(4))
def test_one_file_in_many_blocks(spark, tmp_path, seed):
    import csv
    import random

    rng = random.Random(seed)
    parts = ["a", ",", '"', "\n", "\r\n", "é", "plain words ", "\n\n", '""', "x" * 40]
    rows = [[str(i), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30 if i % 50 else 900))) or "e"] for i in range(600)]
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", 'te"x\nt'], *rows])
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4096")
    try:
        df, info = read.read_table(spark, path)
        assert df.columns == ["id", 'te"x\nt'] and not info.warnings
        assert read.read_records(spark, path).rows.rdd.getNumPartitions() > 5
        found = {r[0]: r[1] for r in df.collect()}
    finally:
        spark.conf.set(name, before)
    expected = {int(i): t for i, t in records_of(path)[1:]}
    null = set(read.K.NULL_CELLS)
    assert found == {i: (None if t.strip() in null else t) for i, t in expected.items()}


def test_headers_in_other_orders(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for name, text in (("a", "id,city,n\n1,Paris,3\n"), ("b", "city,id,N\nOslo,2,4\n"), ("c", "id,extra\n5,x\n"), ("d", ""), ("e", "id,city,n\n")):
        (folder / f"{name}.csv").write_text(text)
    df, info = read.read_table(spark, str(folder))
    assert df.columns == ["id", "city", "n", "extra"] and "3 different headers" in info.warnings[0]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "Paris", 3, None), (2, "Oslo", 4, None), (5, None, None, "x")]


def test_rows_of_another_width(spark, tmp_path):
    path = save(tmp_path, "t.csv", 'id,n\n1,2\n2,3,more\n3\n4,"a,b",c,d\n')
    df, info = read.read_table(spark, path)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "2"), (2, "3"), (3, None), (4, "a,b")]
    assert info.warnings == ["2 rows have more cells than their header.", "1 rows have fewer cells than their header."]


def test_a_quote_that_is_never_closed(spark, tmp_path):
    df, info = read.read_table(spark, save(tmp_path, "t.csv", 'id,size\n1,5" pipe\n2,x\n3,y\n'))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, '5" pipe'), (2, "x"), (3, "y")]
    assert "never closed" in info.warnings[0]


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', float("nan")), (2, None, 0.5)], "i bigint, s string, x double")
    write.write_csv(df, str(tmp_path / "out.csv"))
    back, _ = read.read_table(spark, str(tmp_path / "out.csv"))
    assert [tuple(r) for r in back.orderBy("i").collect()] == [(1, 'a "q", b', None), (2, None, 0.5)]
    write.write_json(df, str(tmp_path / "out.json"))
    lines = [json.loads(line) for f in glob.glob(f"{tmp_path}/out.json/part*") for line in open(f)]
    assert {"i": 1, "s": 'a "q", b', "x": None} in lines


def test_json_dates_are_iso(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS t, date'2024-01-02' AS d, double('inf') AS x")
    assert list(write.json_ready(df).first())[0::2] == ["2024-01-02T03:04:05", None]


def test_report(spark, tmp_path, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    sections = analyze(orders)
    for fmt in ("json", "parquet", "csv"):
        folders = write.write_summary(sections, str(tmp_path / fmt), fmt)
        assert {f.rsplit("/", 1)[1] for f in folders} == {
            "dataset_summary", "quality", "important_columns", "strong_correlations", "business_metrics", "trends", "trend_points"
        }
    assert spark.read.json(str(tmp_path / "json" / "trends")).count() == 3


def test_stage_uses_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/autolens-*"))
    staged = stage(spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS `a b`, null AS `c.d`, '' AS e"))
    assert len(set(glob.glob(f"{folder}/autolens-*")) - before) == 1
    assert staged.columns == ["a b", "c.d", "e"] and staged.count() == 1



def test_rows_are_not_shuffled_to_their_files(spark, tmp_path):
    """Quoted line breaks or none: the headers go to the rows, not the rows to a task for each file."""
    from autolens.sources import read

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, cell in (("plain", "x"), ("broken", "x\ny")):
            path = str(tmp_path / f"{name}.csv")
            rows = [(i, f"{cell} {i}") for i in range(50)]
            spark.createDataFrame(rows, "id bigint, note string").repartition(2).write.option("header", True).csv(path)
            back = read.read_delimited(spark, path)
            assert sorted(tuple(r) for r in back.collect()) == rows
            plan = back._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
