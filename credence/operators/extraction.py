"""Template fields from page text, as one projection per template.

A page becomes an array of clean lines; captions, neighbouring lines and
patterns are array expressions over it, so extraction is a narrow stage without
a shuffle. Only the confidence of a value needs one join, on (page, token)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import compact, first_match, flag_if
from credence.functions.numbers import round_to
from credence.functions.text import (
    TOKEN_CHARACTERS, clean_lines, fuzzy_token_eq, looks_noisy, norm_token, one_typo, shaped_value, strip, strip_leading_captions, value_edges)
from credence.session import spread, stored


def first_group(text: Column, pattern: str, blind: bool = False) -> Column:
    """Group 1 of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, ("(?i)" if blind else "") + pattern, 1), F.lit(""))


def _line(lines: Column, at: Column) -> Column:
    return F.get(lines, at - 1)


def caption_tail(line: Column, upper: Column, labels: list[str]) -> Column:
    """What follows the caption on its own line, captions and separators peeled."""
    tail = None
    for label in labels:
        rest = strip_leading_captions(line.substr(F.instr(upper, F.lit(label)) + len(label), F.length(line)), labels)
        tail = F.when(upper.contains(label), rest) if tail is None else tail.when(upper.contains(label), rest)
    return tail


def caption_lines(upper: Column, specs: list[dict]) -> Column:
    """(at, line) of the lines that hold any caption of a template's fields, in order:
    the fields' rules look at the few lines that are left."""
    captions = sorted({label for s in specs for label in s.get("labels", [])} | {V.CERTIFIED_CAPTION})
    apart = [c for c in captions if not any(o != c and o in c for o in captions)]  # a line with a longer one holds these
    placed = F.transform(upper, lambda line, i: F.struct((i + 1).alias("at"), line.alias("line")))
    return F.filter(placed, lambda h: reduce(Column.__or__, [h["line"].contains(c) for c in apart]))


def caption_at(hits: Column, labels: list[str]) -> Column:
    """Number of the first line that holds one of ``labels``, 0 if none does."""
    holds = lambda h: reduce(Column.__or__, [h["line"].contains(label) for label in labels])
    return F.coalesce(F.get(F.filter(hits, holds), 0)["at"], F.lit(0))


def header_at(bare: Column) -> Column:
    """Line of the TIN | NAME | REGISTRATION DATE header, a few typos allowed, among lines
    of upper-case letters, digits and blanks. Only lines with the two short words are
    compared word by word."""
    def is_header(line: Column) -> Column:
        long_word = lambda t: fuzzy_token_eq(t, "REGISTRATION", 4, normalised=True)
        return line.rlike(one_typo("NAME")) & line.rlike(one_typo("DATE")) & F.exists(F.split(line, " "), long_word)
    return first_match(bare, is_header)


def header_name(lines: Column, at: Column) -> Column:
    """Name printed under the header, flanking number, date and bars removed."""
    one, two = _line(lines, at + 1), _line(lines, at + 2)
    stops = lambda text: F.upper(text).rlike(V.HEADER_STOP)
    block = F.when(one.isNull() | stops(one), "").when(two.isNull() | stops(two), one).otherwise(F.concat_ws(" ", one, two))
    bare = F.regexp_replace(F.regexp_replace(block, V.TIN_TOKEN, " "), V.DATE_TOKEN, " ")
    tidy = strip(F.regexp_replace(F.regexp_replace(bare, r"\|", " "), r"\s+", " "))
    return F.when(at > 0, F.btrim(tidy, F.lit(" :|-")))


def certified_line(lines: Column, upper: Column, at: Column, number: int) -> Column:
    """First or second line of the "this certifies that" block."""
    stops = lambda i: F.coalesce(_line(upper, at + i).rlike(V.CERTIFIED_STOP), F.lit(True))
    blocked = stops(1) if number == 1 else stops(1) | stops(2)
    return F.when((at > 0) & ~blocked, _line(lines, at + number))


def page_fields(pages: DataFrame, template: str, *keep: str) -> DataFrame:
    """Pages of one template with ``values``, an array of their values in the order of
    the template's fields, NULL where nothing was found.

    pages: page_id, text; of other columns those named by ``keep`` stay. The work is laid
    out in projections - lines, caption positions, regions, values - so that no part is
    evaluated twice for one field."""
    specs = V.TEMPLATE_FIELDS[template]
    lines, upper, text = F.col("_lines"), F.col("_upper"), F.col("_text")
    captioned = [s for s in specs if s["mode"] in ("label", "above")]
    modes = {s["mode"] for s in specs}
    hits = F.col("_hits")
    places = {s["key"]: caption_at(hits, s["labels"]) for s in captioned}
    if "header_name" in modes:
        places["header"] = header_at(F.split(F.regexp_replace(F.upper("_text"), f"[^{TOKEN_CHARACTERS} \n]+", ""), "\n"))
    if "certified_1" in modes:
        places["certified"] = caption_at(hits, [V.CERTIFIED_CAPTION])
    lined = pages.select("page_id", *keep, clean_lines(F.col("text")).alias("_lines"))
    joined = lined.withColumn("_text", F.array_join("_lines", "\n"))
    ready = joined.withColumn("_upper", F.split(F.upper("_text"), "\n"))
    placed = ready.withColumn("_hits", caption_lines(upper, specs)).withColumns({f"_at_{k}": at for k, at in places.items()})
    at = lambda key: F.col(f"_at_{key}")

    tails = {f"_tail_{s['key']}": caption_tail(_line(lines, at(s["key"])), _line(upper, at(s["key"])), s["labels"])
             for s in captioned if s["mode"] == "label"}
    tailed = placed.withColumns(tails) if tails else placed
    regions = {}
    for s in captioned:
        here = at(s["key"])
        if s["mode"] == "above":
            regions[f"_region_{s['key']}"] = F.when(here == 0, None).when(here == 1, "").otherwise(_line(lines, here - 1))
        else:
            follow = F.lit("") if s.get("same_line") else F.coalesce(strip(_line(lines, here + 1)), F.lit(""))
            tail = F.col(f"_tail_{s['key']}")
            regions[f"_region_{s['key']}"] = F.when(here == 0, None).when(tail != "", tail).otherwise(follow)
    located = tailed.withColumns(regions) if regions else tailed

    got = {}
    for s in specs:
        if s["mode"] == "global" or s.get("regex"):
            got[f"_got_{s['key']}"] = F.regexp_extract(text if s["mode"] == "global" else F.col(f"_region_{s['key']}"), s["regex"], 1)
    sought = located.withColumns(got)

    def value(s: dict) -> Column:
        if s["mode"] == "global":
            return F.col(f"_got_{s['key']}")
        if s["mode"] == "header_name":
            return header_name(lines, at("header"))
        if s["mode"] in ("certified_1", "certified_2"):
            return certified_line(lines, upper, at("certified"), int(s["mode"][-1]))
        region = F.col(f"_region_{s['key']}")
        if not s.get("regex"):
            return region
        own = F.col(f"_got_{s['key']}")
        found = F.when(own != "", own).when(region.isNotNull(), region)
        return found.otherwise(F.regexp_extract(text, s["regex"], 1)) if s.get("global_fallback") else found

    raw = sought.select("page_id", *keep, *[value(s).alias(f"_raw_{s['key']}") for s in specs])
    edged = raw.select("page_id", *keep, *[F.when(F.col(f"_raw_{s['key']}") != "", value_edges(F.col(f"_raw_{s['key']}"))).alias(f"_edged_{s['key']}") for s in specs])
    return edged.select("page_id", *keep, F.array(*[shaped_value(s["key"], F.col(f"_edged_{s['key']}")) for s in specs]).alias("values"))


def field_rows(rows: DataFrame, template: str, *more: str) -> DataFrame:
    """Long field rows of pages with ``values``. ``more`` names further arrays in the order
    of the fields, each of which gives a column."""
    specs = V.TEMPLATE_FIELDS[template]
    of = lambda column: F.get(F.array(*[F.lit(s[column]) for s in specs]), F.col("ord"))
    long = rows.select("page_id", F.posexplode(F.arrays_zip("values", *more)).alias("ord", "_f"))
    return long.select(
        "page_id", F.lit(template).alias("template"), "ord", of("key").alias("field_key"), of("name").alias("name"), F.col("_f.values").alias("value"),
        of("required").alias("required"), F.col("_f.values").isNotNull().alias("matched"), *[F.col(f"_f.{m}").alias(m) for m in more])


def extract(pages: DataFrame, template: str) -> DataFrame:
    """Long field rows of all pages of one template. pages: page_id, text."""
    return field_rows(page_fields(pages, template), template)


def store_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, template, text) written once, by template: extraction then reads
    each page once, and figures of the same pages read no more than they need. They are
    dealt evenly first, as extraction takes most of the time and runs where they lie."""
    return stored(spread(pages.select("page_id", "text", "template"), "page_id"), "template")


def extract_all(pages: DataFrame) -> DataFrame:
    """Field rows of pages with any template (column ``template``), best from
    ``store_pages``."""
    return by_template(pages, extract)


def by_template(pages: DataFrame, figures: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``figures`` of the pages of each template, below each other."""
    return reduce(DataFrame.unionByName, [figures(pages.where(F.col("template") == name), name) for name in V.TEMPLATE_FIELDS])


def value_means(tokens: pa.Array, confs: pa.Array, values: pa.Array) -> pa.Array:
    """For pages: the mean over each value's tokens of a token's mean confidence on its
    page; tokens not among the page's words do not count. Tokens come a line each, values
    between bars."""
    out, ends, flat = [], confs.offsets.to_pylist(), confs.values.to_pylist()
    for n, (page, asked) in enumerate(zip(tokens.to_pylist(), values.to_pylist(), strict=True)):
        known: dict[str, list[float]] = {}
        own = flat[ends[n]:ends[n + 1]]
        for token, conf in zip(page.split("\n") if own else (), own, strict=True):
            if token and conf is not None:
                known.setdefault(token, []).append(conf)
        found = [[sum(known[t]) / len(known[t]) for t in v.split() if t in known] for v in asked.split("|")]
        out.append([sum(f) / len(f) if f else None for f in found])
    return pa.array(out, pa.list_(pa.float64()))


def extract_graded(pages: DataFrame) -> DataFrame:
    """Field rows of pages of any template with their confidence, as ``with_confidence``
    gives it, where a page row holds its words: page_id, template, text, words (strings
    without white space) and confs (a number for each). Nothing is shuffled."""
    means = F.arrow_udf(value_means, "array<double>")
    bare = F.regexp_replace(F.upper(F.array_join("words", "\n", "")), f"[^{TOKEN_CHARACTERS}\n]+", "")

    def graded(part: DataFrame, template: str) -> DataFrame:
        spelled = part.select("page_id", "text", F.coalesce(bare, F.lit("")).alias("_t"), F.coalesce(F.col("confs").cast("array<double>"), F.array().cast("array<double>")).alias("_c"))
        rows = page_fields(spelled, template, "_t", "_c")
        asked = F.array_join(F.transform("values", lambda v: F.regexp_replace(F.upper(v), r"[^A-Z0-9\s]+", "")), "|", "")
        return field_rows(rows.select("page_id", "values", means("_t", "_c", asked).alias("confidence")), template, "confidence")

    return by_template(pages, graded).withColumn("confidence", round_to(F.col("confidence"), 1))


def with_confidence(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Mean confidence of a value over its tokens, each token scored by its mean
    over the page; tokens not among the page's words do not count.

    words: page_id, text, conf. Both sides meet on (page, token), which spreads
    even a very large page."""
    known = words.select("page_id", norm_token(F.col("text")).alias("token"), "conf").where(F.col("token") != "")
    means = known.groupBy("page_id", "token").agg(F.avg(F.col("conf").cast("double")).alias("mean"))
    tokens = fields.where(F.col("value").isNotNull()).select(
        "page_id", "field_key", F.explode(F.transform(F.split("value", r"\s+"), norm_token)).alias("token"))
    scored = tokens.join(means, ["page_id", "token"]).groupBy("page_id", "field_key").agg(F.avg("mean").alias("_c"))
    return fields.join(scored, ["page_id", "field_key"], "left").withColumn("confidence", round_to(F.col("_c"), 1)).drop("_c")


def warnings() -> Column:
    """Warnings of a field row (field_key, template, value, matched, required,
    confidence): pattern fields by pattern, free text by the noise grade."""
    value = strip(F.col("value"))
    shaped, mismatch = F.lit(False), F.lit(False)
    for template, specs in V.TEMPLATE_FIELDS.items():
        for spec in specs:
            pattern = spec.get("value_regex")
            if pattern is None:
                continue
            this = (F.col("template") == template) & (F.col("field_key") == spec["key"])
            shaped = shaped | this
            mismatch = mismatch | (this & ~value.rlike(rf"\A(?:{pattern})\z"))
    present = F.col("matched") & (F.col("value") != "")
    ok = F.coalesce(present, F.lit(False))
    return compact(
        flag_if(~ok & F.col("required"), "not_found"), flag_if(ok & mismatch, "format_mismatch"),
        flag_if(ok & ~shaped & looks_noisy(F.col("value")), "noisy_text"),
        flag_if(ok & (F.col("confidence") < V.FIELD_CONFIDENCE_FLOOR), "low_confidence"))


# --- merges of other readings --------------------------------------------------
def merge_positional(fields: DataFrame, positional: DataFrame, words: DataFrame) -> DataFrame:
    """Values found by position (page_id, field_key, value) replace the text reading,
    and their confidence is taken anew from the words (page_id, text, conf)."""
    read = positional.where(F.col("value").isNotNull()).select("page_id", "field_key", "value")
    own = with_confidence(read, words).select("page_id", "field_key", F.col("value").alias("_v"), F.col("confidence").alias("_f"))
    joined = fields.join(own, ["page_id", "field_key"], "left")
    moved = F.col("_v").isNotNull()
    return joined.withColumns({"value": F.coalesce("_v", "value"), "matched": moved | F.col("matched"),
                               "confidence": F.when(moved, F.col("_f")).otherwise(F.col("confidence"))}).drop("_v", "_f")


def merge_roi(fields: DataFrame, readings: DataFrame) -> DataFrame:
    """Non-empty region readings that pass the field's pattern replace the value;
    their confidence is unknown. readings: page_id, field_key, text."""
    rows = readings.where(F.col("text") != "").select("page_id", "field_key", F.col("text").alias("_t"))
    joined = fields.join(rows, ["page_id", "field_key"], "left")
    value = None
    for template, specs in V.TEMPLATE_FIELDS.items():
        for spec in specs:
            if spec.get("regex"):
                this = (F.col("template") == template) & (F.col("field_key") == spec["key"])
                hit = first_group(F.col("_t"), spec["regex"], blind=True)
                value = F.when(this, hit) if value is None else value.when(this, hit)
    accepted = value.otherwise(F.col("_t"))
    return joined.withColumn("_a", accepted).withColumns({
        "value": F.coalesce("_a", "value"), "matched": F.col("_a").isNotNull() | F.col("matched"),
        "confidence": F.when(F.col("_a").isNull(), F.col("confidence")),
        "source": F.when(F.col("_a").isNotNull(), "roi_trocr")}).drop("_t", "_a")


def normalise_stamp_text(text: Column) -> Column:
    """Seal captions split by a stray hyphen or dot are joined again."""
    return F.regexp_replace(text, r"(?<=[A-Za-z])[-.](?=[A-Za-z])", " ")


def fill_missing(fields: DataFrame, spare: DataFrame, keys: tuple[str, ...] = ("revenue_region_no", "rdo_code")) -> DataFrame:
    """Take the two seal fields from a second reading, only where the first
    found nothing."""
    other = spare.where(F.col("field_key").isin(*keys) & F.col("matched")).select(
        "page_id", "field_key", F.col("value").alias("_v"), F.col("confidence").alias("_c"), F.lit(True).alias("_m"))
    joined = fields.join(other, ["page_id", "field_key"], "left")
    use = ~F.col("matched") & F.coalesce("_m", F.lit(False))
    return joined.withColumn("_use", use).withColumns({
        "value": F.when(F.col("_use"), F.col("_v")).otherwise(F.col("value")),
        "confidence": F.when(F.col("_use"), F.col("_c")).otherwise(F.col("confidence")),
        "source": F.when(F.col("_use"), "stamp_roi"),
        "matched": F.col("matched") | F.col("_use")}).drop("_v", "_c", "_m", "_use")


def context_map(fields: DataFrame) -> DataFrame:
    """Matched values of a page as a map plus its issue date; a page holds the
    fields of one template, which bounds the map."""
    packed = fields.where("matched").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "value"))).alias("values"))
    return packed


def page_contexts(pages: DataFrame) -> DataFrame:
    """``context_map`` of pages of any template (page_id, template, text) straight from
    their values, without a shuffle."""
    def context(part: DataFrame, template: str) -> DataFrame:
        entries = F.arrays_zip(F.array(*[F.lit(s["key"]) for s in V.TEMPLATE_FIELDS[template]]).alias("key"), F.col("values").alias("value"))
        found = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        # A filter would be pushed below the values and find them all once more.
        return page_fields(part, template).select("page_id", F.explode(F.filter(F.array(found), lambda m: F.size(m) > 0)).alias("values"))
    return by_template(pages, context)


def issue_date(values: Column, explicit: Column | None = None) -> Column:
    """First of the explicit date, issue_date, date_issued, registration_date."""
    found = [F.nullif(F.try_element_at(values, F.lit(k)), F.lit("")) for k in ("issue_date", "date_issued", "registration_date")]
    given = [] if explicit is None else [F.nullif(explicit, F.lit(""))]
    return F.coalesce(*given, *found)


# --- page quality ----------------------------------------------------------------
def page_quality(pages: DataFrame, words: DataFrame, fields: DataFrame) -> DataFrame:
    """Word and field figures of each page, its score, pass mark and flags.

    pages: page_id, template, text; words: page_id, conf; fields: page_id,
    field_key, ord, required, matched."""
    low = F.count_if(F.col("conf") < V.LOW_CONFIDENCE)
    read = words.groupBy("page_id").agg(F.count("*").alias("word_count"), F.avg(F.col("conf").cast("double")).alias("_mean"), low.alias("low_confidence_words"))
    need, got = F.col("required"), F.col("matched")
    lacking = F.transform(F.array_sort(F.collect_list(F.when(need & ~got, F.struct("ord", "field_key")))), lambda x: x["field_key"])
    held = fields.groupBy("page_id").agg(
        F.count("*").alias("fields_total"), F.count_if(got).alias("fields_matched"), F.count_if(need).alias("required_total"),
        F.count_if(need & got).alias("required_matched"), lacking.alias("missing_required"))
    base = pages.select("page_id", "template", *_text_figures())
    joined = base.join(read, "page_id", "left").join(held, "page_id", "left").fillna(0, ["word_count", "low_confidence_words", "fields_total", "fields_matched", "required_total", "required_matched"])
    return _scored(joined)


def page_quality_in_place(pages: DataFrame) -> DataFrame:
    """``page_quality`` of pages whose rows hold what is known of their words: page_id,
    template, text, confs (an array with a number for each word). Nothing is shuffled."""
    confs = F.col("confs").cast("array<double>")
    count = lambda array: F.coalesce(F.array_size(array), F.lit(0)).cast("long")
    known = F.col("_known")

    def figures(part: DataFrame, template: str) -> DataFrame:
        specs = V.TEMPLATE_FIELDS[template]
        value = lambda i: F.get("values", F.lit(i))
        lacking = compact(*[F.when(value(i).isNull(), F.lit(s["key"])) for i, s in enumerate(specs) if s["required"]])
        needed = F.lit(sum(s["required"] for s in specs)).cast("long")
        read = part.select("page_id", "template", "text", *_text_figures(), confs.alias("_confs")).withColumn("_known", F.array_compact("_confs"))
        rows = read.select(
            "page_id", "template", "text", "char_count", "keywords_found", count(F.col("_confs")).alias("word_count"),
            (F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.array_size(known), F.lit(0))).alias("_mean"),
            count(F.filter(known, lambda c: c < V.LOW_CONFIDENCE)).alias("low_confidence_words"))
        kept = [c for c in rows.columns if c not in ("page_id", "text")]
        held = page_fields(rows, template, *kept).withColumn("missing_required", lacking)
        return held.select(
            "page_id", *kept, F.lit(len(specs)).cast("long").alias("fields_total"), count(F.array_compact("values")).alias("fields_matched"),
            needed.alias("required_total"), (needed - F.size("missing_required")).alias("required_matched"), "missing_required")

    return _scored(by_template(pages, figures))


def _text_figures() -> list[Column]:
    """Characters and keywords of a page (template, text)."""
    keywords, upper = None, F.upper("text")
    for template, listed in V.TEMPLATE_KEYWORDS.items():
        found = reduce(lambda a, b: a + b, [F.when(upper.contains(k), 1).otherwise(0) for k in listed])
        this = F.col("template") == template
        keywords = F.when(this, found) if keywords is None else keywords.when(this, found)
    return [F.length("text").alias("char_count"), keywords.otherwise(0).alias("keywords_found")]


def _scored(joined: DataFrame) -> DataFrame:
    """Score, pass mark and flags from a page's figures."""
    mean = F.coalesce(round_to(F.col("_mean"), 1), F.lit(0.0))
    score = F.when(F.col("required_total") > 0, round_to(F.col("required_matched") / F.col("required_total"), 3)).otherwise(0.0)
    share = F.when(F.col("word_count") > 0, round_to(F.col("low_confidence_words") / F.col("word_count"), 3)).otherwise(0.0)
    return joined.withColumns({"mean_confidence": mean, "text_validation_score": score, "low_confidence_ratio": share}).withColumns({
        "passes": F.col("text_validation_score") >= V.TEXT_PASS,
        "flags": compact(
            flag_if(F.col("word_count") < V.MIN_WORDS, "insufficient_text"),
            flag_if((F.col("word_count") > 0) & (F.col("mean_confidence") < V.LOW_CONFIDENCE), "low_ocr_confidence"),
            flag_if(F.size("missing_required") > 0, F.concat(F.lit("missing_required_fields:"), F.array_join("missing_required", ","))))}).drop("_mean")


def compare_variants(words: DataFrame, texts: DataFrame, keywords: list[str]) -> DataFrame:
    """Figures per preprocessing variant and the best variant of each sample.

    words: sample_id, variant, conf; texts: sample_id, variant, text."""
    read = words.groupBy("sample_id", "variant").agg(F.count("*").alias("words"), F.avg(F.col("conf").cast("double")).alias("_m"))
    upper = F.upper("text")
    found = reduce(lambda a, b: a + b, [F.when(upper.contains(k), 1).otherwise(0) for k in keywords])
    scored = texts.select("sample_id", "variant", found.alias("keywords_found")).join(read, ["sample_id", "variant"], "left").select(
        "sample_id", "variant", "keywords_found", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce(round_to(F.col("_m"), 1), F.lit(0.0)).alias("mean_confidence"))
    best = scored.groupBy("sample_id").agg(F.max_by("variant", F.struct("mean_confidence", "keywords_found", "variant")).alias("best_variant"))
    return scored.join(best, "sample_id")
