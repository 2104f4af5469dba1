"""Files that queries write and scan."""

from pyspark.sql import functions as F

from credence.operators import models
from credence.sources import intake, sinks


def test_written_files_are_scanned_and_hashed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.pdf", "%PDF-1.7 x"), (1, "b.png", "text"), (2, "c.pdf", "%PDF-"), (2, "a.pdf", "")], "folder int, name string, body string")
    sinks.write_files(rows, str(tmp_path / "f"))
    files = intake.read_written(spark, str(tmp_path / "f"))
    assert {(r.folder, r.name, bytes(r.content)) for r in files.collect()} == {("1", "a.pdf", b"%PDF-1.7 x\n"), ("1", "b.png", b"text\n"), ("2", "c.pdf", b"%PDF-\n"), ("2", "a.pdf", b"\n")}
    sums = models.file_inventory(files.withColumn("path", F.concat_ws("/", "folder", "name"))).collect()
    assert all(len(r.checksum_sha256) == 64 and r.file_size_bytes > 0 for r in sums)


def test_a_listing_reads_no_content(spark, tmp_path):
    sinks.write_files(spark.createDataFrame([(1, "a", "x")], "folder int, name string, body string"), str(tmp_path / "f"))
    plan = intake.read_written(spark, str(tmp_path / "f")).select("name", "length")._jdf.queryExecution().executedPlan().toString()
    schema = next(line for line in plan.split("\n") if "Scan binaryFile" in line or "BinaryFile" in line)
    assert "content" not in schema.split("ReadSchema")[-1]


def test_logs_by_day_and_by_year(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS id, TIMESTAMP'2024-03-02 03:04:05' AS created_at UNION ALL SELECT 2, TIMESTAMP'2025-05-06 00:00:00'")
    for unit, days in (("day", {"2024-03-02", "2025-05-06"}), ("year", {"2024-01-01", "2025-01-01"})):
        path = str(tmp_path / unit)
        sinks.append_log(rows, path, unit=unit)
        sinks.append_log(rows, path, unit=unit)
        read = spark.read.parquet(path)
        assert read.count() == 4 and {str(r.day) for r in read.select("day").distinct().collect()} == days


def test_a_class_is_one_folder(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 3 AS folder", "'f-' || id AS name", "'x' AS body")
    sinks.write_files(rows, str(tmp_path / "f"))
    assert sum(p.is_dir() for p in (tmp_path / "f").rglob("*")) == 3
    files = intake.read_written(spark, str(tmp_path / "f")).groupBy("folder").count()
    assert {tuple(r) for r in files.collect()} == {("0", 100), ("1", 100), ("2", 100)}


def test_any_name_comes_back(spark, tmp_path):
    names = ["a b.pdf", "50% off+.pdf", "x=y", "_hidden", ".dot", "ä/ß.png"]
    rows = spark.createDataFrame([("c d", n, n) for n in names], "folder string, name string, body string")
    sinks.write_files(rows, "file://" + str(tmp_path / "f"))
    found = intake.read_written(spark, "file://" + str(tmp_path / "f")).collect()
    assert {(r.folder, r.name, bytes(r.content).decode()) for r in found} == {("c d", n, n + "\n") for n in names}
