"""Scalar functions against hand-worked values."""

import pytest
from pyspark.sql import functions as F

from credence.functions import dates, formatting, ids, numbers, text, vectors
from credence.operators import settings
from credence.sources import intake


@pytest.mark.parametrize("raw, wanted", [
    ("  LAPU-LAPU ", "Lapu-Lapu"), ("o'brien   town", "O'Brien Town"), ("PARAÑAQUE", "Parañaque"), ("   ", None), ("CITY  OF digos", "City Of Digos")])
def test_canonical_city(one, raw, wanted):
    assert one(text.canonical_city(F.lit(raw))) == wanted


def test_clean_and_tidy(one):
    raw = "  A \t B \r\n\r\n WORD , next..  \n{ \n|| AMENDED.. ||\n"
    assert one(text.clean_text(F.lit(raw))) == "A B\nWORD , next..\n{\n|| AMENDED.. ||"
    assert one(text.tidy_text(F.lit("WORD , next..\n1 :\n|| AMENDED.. ||"))) == "WORD, next.\nAMENDED."


@pytest.mark.parametrize("a, b, typos, wanted", [
    ("REGISTRAUION", "REGISTRATION", 4, True), ("name", "NAME", 0, True), ("TIN", "TAX", 4, True), ("A", "B", 4, False),
    ("", "NAME", 4, False), ("NAMF", "NAME", 0, False), ("DATE", "NAME", 1, False), ("NAMES", "NAME", 1, True)])
def test_fuzzy_token(one, a, b, typos, wanted):
    assert one(text.fuzzy_token_eq(F.lit(a), b, typos)) is wanted


def test_caption_stripping(one):
    labels = ["LINE OF BUSINESS", "INDUSTRY"]
    assert one(text.strip_leading_captions(F.lit(" / INDUSTRY  7414 CONSULTANCY "), labels)) == "7414 CONSULTANCY"
    assert one(text.strip_leading_captions(F.lit(" : "), labels)) == ""


def test_normalised_values(one):
    assert one(text.normalise_value("tin", F.lit("009 – 028-463-00000"))) == "009-028-463-0000"
    assert one(text.normalise_value("date_issued", F.lit("DEC  12   2020"))) == "DEC 12 2020"
    assert one(text.normalise_value("trade_name", F.lit(" : ACME INC.. "))) == "ACME INC"


@pytest.mark.parametrize("value, noisy", [
    ("ABC Trading Corporation", False), ("EE Bincn", True), ("NORTHZ2N STAR", True), ("J. DELA CRUZ", False), ("J. Dela Cruz", True), ("ab", True),
    ("G09 LO2 GEMINI STREET", False), ("Some | Name", True), ("STRNGTHS", True), ("BCDFGA", True), ("A b c d", True)])
def test_noise(one, value, noisy):
    assert one(text.looks_noisy(F.lit(value))) is noisy


def test_identifiers(one):
    for value, good in (("274-118-902-000", True), ("274-118-90", False), ("274-118-902", True), ("274-118-9", False)):
        assert one(ids.valid_tin(F.lit(value))) is good
    assert one(ids.valid_registration_number(F.lit(" CS-20123 "))) is True
    assert one(ids.valid_registration_number(F.lit("No 12345"))) is False
    assert one(ids.valid_registration_number(F.lit("No 12345"), strict=False)) is True


@pytest.mark.parametrize("raw, wanted", [
    ("D:20240115103000+05'00'", "2024-01-15 10:30:00"), ("2019-01-15", "2019-01-15 00:00:00"), ("2024:01:15 10:30:00", "2024-01-15 10:30:00"),
    ("2024-01-15T10:30:00Z", "2024-01-15 10:30:00"), ("MAR 09 2017", None), ("2024-13-40", None)])
def test_provenance_dates(one, raw, wanted):
    assert one(dates.stamp(dates.parse_provenance(F.lit(raw)))) == wanted


def test_whole_hours_truncate(one):
    a, b = F.lit("2024-01-01 00:59:00").cast("timestamp_ntz"), F.lit("2024-01-01 02:01:00").cast("timestamp_ntz")
    assert one(dates.whole_hours_between(a, b)) == 1
    assert one(dates.whole_hours_between(b, a)) == -1


def test_display_formats(one):
    assert one(formatting.submission_reference(F.lit(42))) == "SUB-00042"
    assert one(formatting.submission_reference(F.lit(1234567))) == "SUB-1234567"
    assert one(formatting.byte_size(F.lit(1536))) == "1.5 KB"
    assert one(formatting.byte_size(F.lit(5 * 1024 * 1024))) == "5.00 MB"
    assert one(formatting.humanise_flag(F.lit("missing_required_fields:form_no,tin,trn_no"))) == "Missing required fields: Form No, TIN, TRN"
    assert one(formatting.humanise_flag(F.lit("no_signature_detected"))) == "No signature detected"
    assert one(formatting.humanise_flag(F.lit("Already prose"))) == "Already prose"
    assert one(formatting.flag_category(F.lit("tamper_signature"))) == "tampering"
    assert [one(dates.ordinal_day(F.lit(d))) for d in (1, 2, 3, 4, 11, 12, 13, 21)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st"]


def test_rounding_is_decimal(one):
    assert one(numbers.round_to(F.lit(0.285), 2)) == 0.29
    assert one(numbers.round_to(F.lit(2.675), 2)) == 2.68


def test_setting_strings(one):
    assert one(settings.stringify(F.lit(0.2))) == "0.2"
    assert one(settings.stringify(F.lit(15.0))) == "15"
    assert one(settings.is_true(F.lit(" YES "))) is True
    assert one(settings.is_true(F.lit("0"))) is False


def test_vectors(one):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(vectors.cosine(v(1, 0), v(0, 1))) == 0.0
    assert one(vectors.cosine(v(0, 0), v(0, 1))) == 0.0
    assert one(vectors.euclidean(v(0, 0), v(3, 4))) == 5.0
    assert one(vectors.euclidean(v(0, 0), v(3, 4, 5))) is None
    assert one(vectors.unit(v(3, 4))) == [0.6, 0.8]
    assert one(vectors.calibrated_score(F.lit(1.0), F.lit(1.0))) == 0.5
    assert one(vectors.calibrated_score(F.lit(1.0), F.lit(0.0))) is None


def test_boxes(one):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(vectors.valid_box(v(0, 0, 5, 5))) is True
    assert one(vectors.valid_box(v(0, 0, 0, 5))) is False
    assert one(vectors.valid_box(v(-1, 0, 5, 5))) is False
    assert one(vectors.valid_box(v(0, 0, float("nan"), 5))) is False
    assert one(vectors.clip_box(v(90.9, 10, -5, 50), F.lit(80), F.lit(40))) == [0, 10, 80, 40]
    assert one(vectors.clip_box(v(90, 10, 95, 50), F.lit(80), F.lit(40))) is None


def test_intake_order_of_reasons(spark):
    png = bytes.fromhex("89504E470D0A1A0A") + b"x"
    rows = spark.createDataFrame([
        ("a.PNG", "image/png", png), ("a.gif", "image/gif", png), ("a.png", "image/jpeg", b""), ("a.png", "image/png", b""),
        ("a.png", "image/png", b"%PDF-1.7"), ("noext", "image/png", png)], "filename string, declared string, content binary")
    got = [r[0] for r in rows.select(intake.reject_reason(F.col("filename"), F.col("declared"), F.col("content"), F.length("content"))).collect()]
    assert got == [None, "unsupported_type", "mime_mismatch", "empty_file", "content_mismatch", "unsupported_type"]


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "val" / "fake").mkdir(parents=True)
    (tmp_path / "val" / "fake" / "synthetic_00101_clean.png").write_bytes(b"1")
    (tmp_path / "val" / "fake" / "notes.txt").write_bytes(b"1")
    (tmp_path / "roi.json").write_text('{"bir": {"tin": {"x": 0.1, "y": 0.2, "w": 0.3, "h": 0.4}}, "business_permit": {"digos": {"trade_name": {"x": 0, "y": 0, "w": 1, "h": 1}}}}')
    row = intake.read_labelled(spark, str(tmp_path / "val")).first()
    assert (row["class"], row["group_stem"], row["variant"]) == ("fake", "synthetic_00101", "clean")
    rois = {(r.template, r.city, r.field_key): r.w for r in intake.read_roi_config(spark, str(tmp_path / "roi.json")).collect()}
    assert rois == {("bir", "", "tin"): 0.3, ("business_permit", "digos", "trade_name"): 1.0}
    assert intake.read_uploads(spark, str(tmp_path / "roi.json")).first()["filename"] == "roi.json"


def test_sizes_round_half_up(one):
    assert one(formatting.byte_size(F.lit(1280))) == "1.3 KB"
    assert one(formatting.byte_size(F.lit(1_048_575))) == "1,024.0 KB"


def test_sizes_in_mb_round_as_the_sql_of_the_list(one):
    import duckdb
    sql = "SELECT CAST(round(CAST(CAST(? AS BIGINT) / 1048576 AS DECIMAL(20,6)) * 100, 0) AS BIGINT)"
    for size in (3_350_200, 3_350_199, 3_350_201, 1_053_819, 1_048_576):
        hundredths, = duckdb.execute(sql, [size]).fetchone()
        assert one(formatting.byte_size(F.lit(size))) == f"{hundredths // 100}.{hundredths % 100:02d} MB"
