"""CSV scans that split files, and exports that find their header while they write."""

import pytest
from pyspark.sql import functions as F

from loopwright.sources import readers, writers


def parts(df):
    return df.rdd.getNumPartitions()


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())


def both_ways(spark, folder, columns=("a", "b")):
    found = readers.read_csv(spark, str(folder), columns)
    whole = readers.read_csv(spark, str(folder), columns, multi_line=True)
    key = lambda r: tuple((v is None, v or "") for v in r)
    rows = sorted(map(tuple, found.collect()), key=key)
    assert rows == sorted(map(tuple, whole.collect()), key=key)
    assert found.columns == list(columns)
    return rows


def test_a_large_plain_file_is_split(spark, tmp_path):
    folder = tmp_path / "plain"
    put(folder, "one.csv", "a,b\n" + "".join(f'{i},"say ""{i}"", ok"\n' for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert readers.files_with_breaks(spark, str(folder)) == []
        found = readers.read_csv(spark, str(folder), ["a", "b"])
        assert parts(found) >= 8 and parts(readers.read_csv(spark, str(folder), ["a", "b"], True)) == 1
        assert found.count() == 40_000
        assert found.filter("a = '77'").first()["b"] == 'say "77", ok'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_files_with_breaks_are_read_whole(spark, tmp_path):
    folder = tmp_path / "mixed files %20"
    put(folder, "plain one.csv", "a,b\n" + "".join(f"{i},x\n" for i in range(9)))
    put(folder, "broken%.csv", 'a,b\n1,"two\nlines, ""quoted""\n"\n2,\n')
    broken = readers.files_with_breaks(spark, str(folder))
    assert len(broken) == 1 and "broken" in broken[0]
    rows = both_ways(spark, folder)
    assert len(rows) == 11 and ("1", 'two\nlines, "quoted"\n') in rows


@pytest.mark.parametrize(
    "text",
    [
        "a,b\n",
        'a,b\n1,""\n2,\n,\n',
        "a,b\r\n1,x\r\n2,y\r\n",
        'a,b\r\n1,"x\r\ny"\r\n2,z\r\n',
        'a,b\n1,"x\ry"\n2,z\n',
        'a,b\n1,5" disk\n2,"7"" disk"\n',
        'a,b\n1,"even""\n"" breaks"\n',
        "a,b\n\n1,x\n\n\n2,y",
        'a,b\n1,"é\n日"\n',
    ],
)
def test_odd_files_read_as_before(spark, tmp_path, text):
    put(tmp_path / "odd", "f.csv", text)
    both_ways(spark, tmp_path / "odd")


def test_header_is_found_in_one_run_of_the_plan(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        runs.add(1)
        return x

    rows = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "id string, v string")
    record = F.when(F.col("id") == "2", F.create_map(F.lit("_trace_id"), counted("id"))).otherwise(
        F.create_map(F.lit("b"), counted("v"), F.lit("a"), F.col("id"))
    )
    records = rows.select(record.alias("record"))
    seen = writers.export_records(records, f"{tmp_path}/out")
    assert seen.get["total_records"] == 3 and runs.value <= 6  # both branches at most, once a row
    first = runs.value
    assert readers.csv_header(spark, f"{tmp_path}/out") == ["a", "b", "_trace_id"]
    found = readers.read_csv(spark, f"{tmp_path}/out", ["a", "b", "_trace_id"])
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(
        map(str, [("1", "x", None), (None, None, "2"), ("3", "z", None)])
    )
    assert runs.value == first


def test_exports_without_records_or_names(spark, tmp_path):
    none = spark.createDataFrame([], "record map<string,string>")
    assert writers.export_records(none, f"{tmp_path}/none").get["total_records"] == 0
    blank = spark.createDataFrame([({},), (None,)], "record map<string,string>")
    assert writers.export_records(blank, f"{tmp_path}/blank").get["total_records"] == 2
    assert readers.csv_header(spark, f"{tmp_path}/blank") == ["inputs", "outputs"]
    many = spark.range(1).select(
        F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(writers.MAX_COLUMNS)), lambda i: F.struct(i.cast("string"), F.lit("v")))).alias("record")
    )
    with pytest.raises(ValueError, match="field names"):
        writers.export_records(many, f"{tmp_path}/many")
