"""Word boxes and regions: phrases, columns, ROI overlap, recognition budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.text import city_key, fuzzy_token_eq, norm_token, strip
from credence.operators import grid


def find_phrases(words: DataFrame, phrases: dict[str, tuple[str, int]]) -> DataFrame:
    """First run of consecutive words equal to each phrase (within typos), with
    its union box.

    words: page_id, pos (dense), text, left, top, width, height. A word that
    equals token k of a phrase votes for the run starting k words earlier; runs
    with a vote for every token are hits. Only matching words are shuffled, by
    (page, run start), so long pages spread out and need no sort."""
    token = norm_token(F.col("text"))
    votes = []
    for name, (phrase, typos) in phrases.items():
        parts = phrase.split()
        for k, part in enumerate(parts):
            hit = fuzzy_token_eq(F.col("_t"), part, typos, normalised=True)
            votes.append(F.when(hit, F.struct(F.lit(name).alias("phrase"), F.lit(len(parts)).alias("need"), (F.col("pos") - k).alias("start"))))
    tagged = words.select("*", token.alias("_t"))
    live = tagged.select("page_id", "left", "top", (F.col("left") + F.col("width")).alias("right"), (F.col("top") + F.col("height")).alias("bottom"),
                         F.explode(F.filter(F.array(*votes), lambda v: v.isNotNull())).alias("v"))
    runs = live.groupBy("page_id", "v.phrase", "v.start", "v.need").agg(
        F.count("*").alias("_n"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")
    ).where(F.col("_n") == F.col("need"))
    first = runs.groupBy("page_id", "phrase").agg(F.min_by(F.struct("left", "top", "right", "bottom"), "start").alias("b"), F.min("start").alias("start"))
    return first.select("page_id", "phrase", "start", "b.*")


def reading_row(top: Column) -> Column:
    """Row bucket of a word, 20 pixels high, ties to even."""
    return F.rint(top / 20).cast("long")


def join_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a region as text in reading order, edge punctuation dropped."""
    core = F.regexp_replace("text", r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    kept = words.select(*keys, reading_row(F.col("top")).alias("_row"), "left", "pos", core.alias("_w")).where(F.col("_w") != "")
    ordered = F.array_sort(F.collect_list(F.struct("_row", "left", "pos", "_w")))
    return kept.groupBy(*keys).agg(strip(F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["_w"]), " "), r"\s+", " ")).alias("value"))


def words_in_bands(words: DataFrame, bands: DataFrame) -> DataFrame:
    """Words whose centre lies in a half-open band (page_id, field_key, x0, x1,
    y0, y1). A centre lies in one cell of the grid, and bands are dealt to the cells
    that hold words."""
    cx, cy = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    placed = words.withColumns({"_cx": cx, "_cy": cy})
    dealt = grid.points(placed, F.col("_cx"), F.col("_cy"))
    edges = bands.select("page_id", "field_key", F.col("x0").alias("x1"), F.col("x1").alias("x2"), F.col("y0").alias("y1"), F.col("y1").alias("y2"))
    return grid.meet(dealt, edges, "page_id").where(
        (F.col("x1") <= F.col("_cx")) & (F.col("_cx") < F.col("x2")) & (F.col("y1") <= F.col("_cy")) & (F.col("_cy") < F.col("y2"))).drop("_cx", "_cy", "x1", "x2", "y1", "y2")


# Captions of the two-column form with their typo budget.
FORM_CAPTIONS = {"trade": ("TRADE NAME", 0), "business": ("LINE OF BUSINESS", 0), "tax": ("TAX TYPE", 0),
                 "officer": ("REVENUE DISTRICT OFFICER", 0), "name": ("NAME", 1), "date": ("REGISTRATION DATE", 4),
                 "address": ("REGISTERED ADDRESS", 4)}
FAR = 1e9


def form_bands(captions: DataFrame) -> DataFrame:
    """Bands of the body fields, from the caption boxes of each page. The offsets
    are the fixed pixel distances of the form at its working scale."""
    box = {n: F.max(F.when(F.col("phrase") == n, F.struct("left", "top", "right", "bottom"))).alias(n) for n in FORM_CAPTIONS}
    page = captions.groupBy("page_id").agg(*box.values())
    c = lambda path: F.col(path)
    body_top = F.greatest("trade.bottom", "business.bottom") + 25
    divider = c("business.left") - 50
    both = c("trade").isNotNull() & c("business").isNotNull()
    tax_end = F.when(c("trade").isNotNull(), c("trade.top") - 2).otherwise(c("tax.bottom") + 130)
    header = F.greatest("name.bottom", "date.bottom")
    named = c("name").isNotNull() & c("date").isNotNull() & (F.abs(c("name.top") - c("date.top")) <= 40)
    name_end = F.when(c("address").isNotNull() & (c("address.top") > header), c("address.top") - 5).otherwise(header + 80)

    def band(key: str, when: Column, x0, x1, y0, y1) -> Column:
        d = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
        return F.when(when, F.struct(F.lit(key).alias("field_key"), d(x0).alias("x0"), d(x1).alias("x1"), d(y0).alias("y0"), d(y1).alias("y1")))
    bands = F.array(
        band("trade_name", both, 0.0, divider, body_top, body_top + 100),
        band("line_of_business", both, divider, FAR, body_top, body_top + 100),
        band("tax_types", c("tax").isNotNull(), 0.0, FAR, c("tax.bottom") + 2, tax_end),
        band("revenue_district_officer", c("officer").isNotNull(), c("officer.left") - 30, c("officer.right") + 40, c("officer.top") - 95, c("officer.top") - 5),
        band("registered_name", named, c("name.left") - 40, c("date.left") - 30, header + 6, name_end))
    return page.select("page_id", F.inline(F.filter(bands, lambda b: b.isNotNull())))


def positional_fields(words: DataFrame) -> DataFrame:
    """Body fields of the two-column form read by position (page_id, field_key, value)."""
    bands = form_bands(find_phrases(words, FORM_CAPTIONS))
    read = join_words(words_in_bands(words, bands), ["page_id", "field_key"])
    bare = F.regexp_replace(F.regexp_replace("value", V.TIN_TOKEN, " "), V.DATE_TOKEN, " ")
    name = F.regexp_replace(strip(F.regexp_replace(bare, r"\s+", " ")), r"^[ :|\-]+|[ :|\-]+$", "")
    value = F.nullif(F.when(F.col("field_key") == "registered_name", name).otherwise(F.col("value")), F.lit(""))
    return read.select("page_id", "field_key", value.alias("value")).where(F.col("value").isNotNull())


# --- regions of interest -----------------------------------------------------
def page_rois(pages: DataFrame, rois: DataFrame) -> DataFrame:
    """ROIs that apply to each page by template, and by city for permits; a
    permit without a city has none. rois: template, city ('' = any), field_key, x, y, w, h."""
    key = F.when(F.col("template") == "business_permit", F.nullif(city_key(F.col("city")), F.lit(""))).otherwise("")
    keyed = pages.withColumn("_city", key)
    config = rois.select("template", F.col("city").alias("_city"), "field_key", "x", "y", "w", "h")
    return keyed.join(config, ["template", "_city"]).drop("_city")


def match_rois(boxes: DataFrame, rois: DataFrame, share: float = 0.5) -> DataFrame:
    """Union of the boxes that lie in a field's region with at least ``share`` of
    their own area.

    boxes: page_id, left, top, width, height (pixels); rois: page_id, field_key,
    x, y, w, h (fractions), page_width, page_height. Boxes and regions meet in the
    cells of a grid that both touch; the cell with the first corner of their overlap
    reports them, so a pair counts once. ``share`` must be above 0."""
    px = rois.select("page_id", "field_key", (F.col("x") * F.col("page_width")).alias("x1"), (F.col("y") * F.col("page_height")).alias("y1"),
                     (F.col("x") * F.col("page_width") + F.col("w") * F.col("page_width")).alias("x2"),
                     (F.col("y") * F.col("page_height") + F.col("h") * F.col("page_height")).alias("y2"))
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    wide = F.greatest(F.lit(0.0), F.least(right, F.col("x2")) - F.greatest("left", "x1"))
    high = F.greatest(F.lit(0.0), F.least(bottom, F.col("y2")) - F.greatest("top", "y1"))
    area = (F.col("width") * F.col("height")).cast("double")
    dealt = grid.boxes(boxes.where((F.col("width") > 0) & (F.col("height") > 0)), F.col("left"), F.col("top"), right, bottom)
    first = (F.floor(F.greatest("left", "x1") / grid.CELL) == F.col(grid.X)) & (F.floor(F.greatest("top", "y1") / grid.CELL) == F.col(grid.Y))
    hits = grid.meet(dealt, px, "page_id").where(first & (wide * high / area >= share))
    return hits.groupBy("page_id", "field_key").agg(
        F.min("left").alias("x"), F.min("top").alias("y"), (F.max(right) - F.min("left")).alias("w"), (F.max(bottom) - F.min("top")).alias("h"),
        F.count("*").alias("boxes"))


def recognition_order(matched: DataFrame, fields: DataFrame, floor: float = V.ROI_CONFIDENCE_FLOOR) -> DataFrame:
    """Matched fields worth a second reading: not those read at or above the
    floor; required ones first, then in region order (``ord``)."""
    known = fields.select("page_id", "field_key", F.col("matched").alias("_m"), F.col("confidence").alias("_c"), F.col("required").alias("_r"))
    sure = F.coalesce(F.col("_m") & (F.col("_c") >= floor), F.lit(False))
    left = matched.join(known, ["page_id", "field_key"], "left").where(~sure)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.coalesce("_r", F.lit(True)).desc(), F.col("ord")))
    return left.withColumn("priority", rank).drop("_m", "_c", "_r")


def within_budget(ordered: DataFrame, seconds: float = V.ROI_BUDGET_SECONDS) -> DataFrame:
    """A field is started while the time spent so far is under the budget.

    ordered: page_id, priority, cost_ms. A page has at most one row per field
    of its template, which bounds the window."""
    before = Window.partitionBy("page_id").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost_ms").over(before), F.lit(0))
    return ordered.withColumn("outcome", F.when(spent < seconds * 1000, "recognized").otherwise("skipped_over_budget"))


# --- region configuration ------------------------------------------------------
def to_fraction(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Pixel boxes (x, y, w, h) as fractions of the template."""
    return boxes.withColumns({"x": F.col("x") / width, "y": F.col("y") / height, "w": F.col("w") / width, "h": F.col("h") / height})


def union_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One box around all boxes of a key."""
    return boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
                                    (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))


def boxes_out_of_bounds(boxes: DataFrame, width: Column | float, height: Column | float) -> DataFrame:
    """Boxes that leave their template."""
    return boxes.where((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height))


def missing_keys(boxes: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Required box keys that a template lacks."""
    return wanted.join(boxes.select(*keys).distinct(), keys, "left_anti")

