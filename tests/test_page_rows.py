"""Figures of a page from its own row: the same as over long tables, without a shuffle."""

import pytest
from pyspark.sql import functions as F

from credence.functions import text as T
from credence.operators import extraction
from credence.plans import catalog
from credence.plans.text_queries import worded_pages

FOLDER = "/root/testdata/sf0.001"
BIR = "REVENUE REGION NO. 7\nTIN NAMF REGISTRAUION DATE\n123-456-789-0001 | ACME  WORKS 1/2/2020\nREGISTERED ADDRESS\nLOT 7 ß ACME\nTRADE NAME\n- ACME: STORE. \nDate Issued JAN 02 2020"
PAGES = [(3, "bir", BIR), (6, "bir", "  " + BIR.replace("\n", " \r\n\t")), (9, "bir", None), (12, "bir", ""), (15, "bir", "TIN NAME DATE REGISTRATION ACME | x"),
         (4, "business_permit", "ACME.\nTRADE NAME\nCITY OF ACME"), (5, "dti", "certifies that\nACME\nLOT 1\nTRN: DTI-2020-0001 valid from 1/2/2020 to 1/2/2025")]


def _pages(spark):
    return worded_pages(spark.createDataFrame(PAGES, "page_id long, template string, text string"))


def _words(pages):
    return pages.select("page_id", F.inline(F.arrays_zip("words", "confs"))).toDF("page_id", "text", "conf")


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ["field_confidence", "field_warnings", "page_quality", "issue_dates"])
def test_pages_are_not_shuffled_after_they_are_stored(spark, name):
    assert "Exchange" not in catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_confidence_of_page_rows(spark):
    pages = _pages(spark)
    rows = extraction.extract_graded(pages)
    assert _rows(rows) == _rows(extraction.with_confidence(extraction.extract_all(pages), _words(pages)))
    assert {r.field_key for r in rows.where("page_id = 3 AND confidence IS NOT NULL").collect()} >= {"registered_name", "registered_address", "trade_name"}


def test_quality_and_context_of_page_rows(spark):
    pages = _pages(spark)
    assert _rows(extraction.page_quality_in_place(pages)) == _rows(extraction.page_quality(pages, _words(pages), extraction.extract_all(pages)))
    values = lambda df: sorted((r.page_id, sorted(r["values"].items())) for r in df.collect())
    assert values(extraction.page_contexts(pages)) == values(extraction.context_map(extraction.extract_all(pages)))


def test_lines_are_cleaned_as_line_by_line(spark):
    odd = ["", " \n ", "a  b\t\tc", "\n a \n\n b \n", "a\r\nb\rc", "a\x0bb\x1cc", "a   b  c", "　x\n y", "a\x1fb", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", T.clean_lines(F.col("t")).alias("x")).collect()
    for t, lines in rows:
        parts = T.F.transform(T.split_lines(F.lit(t)), lambda line: F.regexp_replace(F.regexp_replace(line, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
        assert lines == spark.range(1).select(F.filter(parts, lambda line: line != "").alias("x")).first().x


def test_one_typo_is_the_edit_distance(spark):
    words = ["NAME", "NAMF", "AME", "NAM", "XNAME", "NAMES", "NXAME", "NME", "NM", "TRADE", "NAXXE", "MANE", "", "N"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.concat(F.lit("TWO "), "w", F.lit(" X1")).rlike(T.one_typo("NAME")), T.fuzzy_token_eq(F.col("w"), "NAME", 1, normalised=True)).collect()
    assert all(a == b for _, a, b in rows) and sum(a for _, a, _ in rows) == 8
