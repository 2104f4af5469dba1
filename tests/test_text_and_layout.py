"""Template extraction on sample pages, positions, regions and budgets."""

from pyspark.sql import functions as F

from credence.operators import extraction, layout, ordering, retries

BIR = """REVENUE REGION NO. 4
REVENUE DISTRICT NO.
Form No. 2303
7RC0020304050
OCN
TIN NAME REGISTRAUION DATE
111-222-333-000 | NORTH PIER TRADERS AND 02/14/2019
COLD STORAGE.
REGISTERED ADDRESS
DOCK FOUR
TAX TYPE ;
DOCK DUTY
LINE OF BUSINESS / INDUSTRY  5210 COLD ROOMS
JUN 21  2020
"""
PERMIT = """Archive of the CITY OF PORT EAST
LAMP REPAIR
KIND OF BUSINESS
PIER LAMPS.
TRADE NAME
BUSINESS PERMIT
7 HARBOUR STEPS, OLD TOWN
BUSINESS LOCATION
UMA KELLER
NAME OF PROPRIETOR
Stamped, and issued this 3rd day of MARCH , 2016, noon
"""
DTI = """TRN: DTI-2021-90817263
A clerk certifies that
TIDE TABLES PRESS
18 GANNET ROW, PORT EAST
is a business name registered, and the sheet was issued to
OTTO VANCE
Use it while valid from 11/30/2021 to 11/30/2026 only
Certificate No. BN 4455667
"""


def fields(spark, template, text):
    pages = spark.createDataFrame([(1, text)], "page_id long, text string")
    return {r.field_key: r.value for r in extraction.extract(pages, template).collect()}


def test_bir_page(spark):
    f = fields(spark, "bir", BIR)
    assert f["ocn"] == "7RC0020304050"
    assert f["tin"] == "111-222-333-000"
    assert f["registered_name"] == "NORTH PIER TRADERS AND COLD STORAGE"
    assert f["registration_date"] == "02/14/2019"       # global fallback, the caption is misread
    assert f["registered_address"] == "DOCK FOUR"
    assert f["revenue_region_no"] == "4"
    assert f["rdo_code"] is None                        # caption alone on its row, next line not allowed
    assert f["line_of_business"] == "5210 COLD ROOMS"
    assert f["date_issued"] == "JUN 21 2020"
    assert f["trade_name"] is None


def test_permit_page(spark):
    f = fields(spark, "business_permit", PERMIT)
    assert f == {"city_issued": "PORT EAST", "name_of_proprietor": "UMA KELLER", "trade_name": "PIER LAMPS",
                 "business_location": "7 HARBOUR STEPS, OLD TOWN", "kind_of_business": "LAMP REPAIR", "date_issued": "3rd day of MARCH , 2016"}


def test_dti_page(spark):
    f = fields(spark, "dti", DTI)
    assert f == {"business_name": "TIDE TABLES PRESS", "business_address": "18 GANNET ROW, PORT EAST", "owner_representative_name": "OTTO VANCE",
                 "date_issued": "11/30/2021", "expiry_date": "11/30/2026", "certificate_no": "BN 4455667", "trn_no": "DTI-2021-90817263"}


def test_confidence_and_warnings(spark):
    rows = spark.createDataFrame([(1, "bir", "tin", "111-222-333-000", True, True), (1, "bir", "trade_name", "EE Bincn", True, True), (1, "bir", "ocn", None, False, True),
                                  (1, "bir", "rdo_code", None, False, False), (1, "bir", "date_issued", "39 2018", True, True)],
                                 "page_id long, template string, field_key string, value string, matched boolean, required boolean")
    words = spark.createDataFrame([(1, "111-222-333-000", 70.0), (1, "EE", 90.0), (1, "EE", 95.0), (1, "Bincn", 60.0)], "page_id long, text string, conf double")
    graded = extraction.with_confidence(rows, words).withColumn("w", extraction.warnings())
    got = {r.field_key: (r.confidence, r.w) for r in graded.collect()}
    assert got == {"tin": (70.0, ["low_confidence"]), "trade_name": (76.3, ["noisy_text", "low_confidence"]), "ocn": (None, ["not_found"]),
                   "rdo_code": (None, []), "date_issued": (None, ["format_mismatch"])}


def test_positional_columns(spark):
    words = []
    def put(line, x, y, text):
        for i, token in enumerate(text.split()):
            words.append((1, len(words), token, x + 60 * i, y, 50, 30))
    put(0, 40, 100, "TIN"); put(0, 300, 100, "NAME"); put(0, 900, 100, "REGISTRAUION DATE")
    put(1, 40, 140, "111-222-333-000"); put(1, 300, 140, "ACME TRADING"); put(1, 900, 140, "06/01/2015")
    put(2, 300, 175, "CORPORATION"); put(3, 40, 220, "REGISTERED ADDRESS")
    put(4, 40, 460, "TRADE NAME"); put(4, 900, 460, "LINE OF BUSINESS"); put(5, 40, 530, "ACME |"); put(5, 900, 530, "7414 RETAIL")
    frame = spark.createDataFrame(words, "page_id long, pos int, text string, left int, top int, width int, height int")
    got = {r.field_key: r.value for r in layout.positional_fields(frame).collect()}
    assert got == {"registered_name": "ACME TRADING CORPORATION", "trade_name": "ACME", "line_of_business": "7414 RETAIL"}


def test_phrase_takes_the_first_run(spark):
    rows = [(1, i, t, i * 10, 0, 9, 5) for i, t in enumerate("TAX NAME TAX TYPE X TAX TYPE".split())]
    frame = spark.createDataFrame(rows, "page_id long, pos int, text string, left int, top int, width int, height int")
    row = layout.find_phrases(frame, {"tax": ("TAX TYPE", 0)}).first()
    assert (row.start, row.left, row.right) == (2, 20, 39)


def test_roi_needs_half_of_the_box(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 8.0, 0.0, 10.0, 10.0), (1, 5.0, 5.0, 10.0, 10.0)], "page_id long, left double, top double, width double, height double")
    rois = spark.createDataFrame([(1, "tin", 0.0, 0.0, 0.1, 0.1, 100, 100)], "page_id long, field_key string, x double, y double, w double, h double, page_width int, page_height int")
    row = layout.match_rois(boxes, rois).first()
    assert (row.x, row.y, row.w, row.h, row.boxes) == (0.0, 0.0, 10.0, 10.0, 1)


def test_budget_prefix(spark):
    matched = spark.createDataFrame([(1, k, i, 100000) for i, k in enumerate(("a", "b", "c", "d", "e"))], "page_id long, field_key string, ord int, cost_ms long")
    known = spark.createDataFrame([(1, "a", True, 95.0, True), (1, "b", True, 70.0, False), (1, "c", True, None, True), (1, "d", False, None, True)],
                                  "page_id long, field_key string, matched boolean, confidence double, required boolean")
    rows = layout.within_budget(layout.recognition_order(matched, known)).orderBy("priority").collect()
    assert [r.field_key for r in rows] == ["c", "d", "e", "b"]
    assert [r.outcome for r in rows] == ["recognized"] * 3 + ["skipped_over_budget"]


def test_numbering_is_global_and_whole(spark):
    frame = spark.range(1000).repartition(13).withColumn("k", F.col("id") % 7)
    rows = ordering.number_rows(frame, [F.col("k").desc(), F.col("id")], "n").collect()
    wanted = sorted(((-(i % 7), i) for i in range(1000)))
    assert {r.n: r.id for r in rows} == {n: i for n, (_, i) in enumerate(wanted, 1)}


def test_retry_ledger_cases(spark):
    rows = spark.sql("""SELECT d AS document_id, i AS event_id, TIMESTAMP_NTZ'2024-01-01 23:59:00' + make_dt_interval(0, 0, i) AS ts, o AS outcome FROM VALUES
        (1,1,'retryable'),(1,2,'retryable'),(1,3,'retryable'),(1,4,'retryable'),(1,5,'ok'),(2,1,'terminal'),(2,2,'ok') t(d, i, o)""")
    got = {(r.document_id, r.event_id): (r.attempt, r.action, r.flag) for r in retries.retry_ledger(rows).collect()}
    assert got[(1, 3)] == (3, "failed", "pipeline_exhausted") and got[(1, 4)] == (1, "retry", None) and got[(1, 5)] == (2, "done", None)
    assert got[(2, 1)] == (1, "failed", "pipeline_request_failed") and got[(2, 2)] == (1, "done", None)


def test_lines_are_cut_and_trimmed_in_one_pass(one):
    import re
    from credence.functions import text as T
    for raw in ("", " \n ", "a\r\nb", " a \t b  \n　c\x1cd \x1d\x1e e  f\u0085 ", "x\x0b \x0cy\r\r\nz", "\x1c a \x1c", "​ q    r"):
        lines = [re.sub("[ \t]+", " ", x) for x in re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]", raw)]
        white = "\t\n\x0b\x0c\r \u0085      　" + "".join(map(chr, range(0x2000, 0x200B)))
        assert one(T.clean_lines(F.lit(raw))) == [x.strip(white) for x in lines if x.strip(white)]


def test_pages_of_one_file_are_dealt_before_extraction(spark):
    from credence.operators import extraction
    pages = spark.range(4000).coalesce(1).selectExpr("id AS page_id", "'dti' AS template", "'TRN: ' || id AS text")
    assert len(extraction.store_pages(pages).inputFiles()) >= 8
