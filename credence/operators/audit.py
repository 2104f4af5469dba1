"""The audit trail: filters, counts, paging and the export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESETS = {"24h": 24, "7d": 24 * 7, "30d": 24 * 30}


def like_any(df: DataFrame, term: str, columns: tuple[str, ...]) -> DataFrame:
    """LIKE over several columns; % and _ in the term are live wildcards."""
    term = term.strip()
    if not term:
        return df
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.col(name).ilike(f"%{term}%"), F.lit(False))
    return df.where(hit)


def between(df: DataFrame, start: str | Column | None, end: str | Column | None, on: str = "created_at") -> DataFrame:
    """Inclusive range, either side open."""
    if start is not None:
        df = df.where(F.col(on) >= (F.lit(start).cast("timestamp_ntz") if isinstance(start, str) else start))
    if end is not None:
        df = df.where(F.col(on) <= (F.lit(end).cast("timestamp_ntz") if isinstance(end, str) else end))
    return df


def preset_range(df: DataFrame, preset: str, now: str) -> DataFrame:
    """The last 24 hours, 7 or 30 days up to now; unknown presets leave the start open."""
    end = F.date_trunc("minute", F.lit(now).cast("timestamp_ntz"))
    hours = PRESETS.get(preset)
    start = None if hours is None else end - F.make_dt_interval(hours=F.lit(hours))
    return between(df, start, end)


def filtered(logs: DataFrame, term: str = "", user_id: int | None = None, action: str | None = None,
             module: str | None = None, entity_type: str | None = None, entity_id: int | None = None,
             start: str | None = None, end: str | None = None) -> DataFrame:
    """All filters of the trail; an unset one adds nothing to the plan. An
    entity id counts only together with an entity type."""
    rows = like_any(logs, term, ("action", "entity_type", "ip_address", "details"))
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if action:
        rows = rows.where(F.col("action") == action)
    if module:
        rows = rows.where(F.col("action").startswith(f"{module}."))
    if entity_type:
        rows = rows.where(F.col("entity_type") == entity_type)
        if entity_id is not None:
            rows = rows.where(F.col("entity_id") == entity_id)
    return between(rows, start, end)


def totals(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """Matching events and distinct actors (system events have none)."""
    actors = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return rows.agg(F.count("*").alias("matching"), actors.alias("actors"))


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("log_id").desc()]


def export_rows(rows: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of the CSV download: all matches with their actor, or the newest
    ``limit`` if the caller gives one. The export takes the same filters as the
    screen except the module."""
    newest = rows if limit is None else rows.orderBy(*newest_first()).limit(limit)
    people = users.select("user_id", "name", "email", "role")
    basename = F.regexp_extract("entity_type", r"([^\\]+)$", 1)
    joined = newest.join(people, "user_id", "left")
    return joined.orderBy(*newest_first()).select(
        "log_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        F.coalesce("name", F.lit("(deleted user)")).alias("user"), F.coalesce("email", F.lit("")).alias("email"),
        F.coalesce("role", F.lit("")).alias("role"), "action",
        F.coalesce(basename, F.lit("")).alias("entity"), "entity_id", "ip_address",
        F.coalesce("details", F.lit("")).alias("details"))


def acting_users(logs: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """Users that appear in the trail, by name; the first ``limit`` if given."""
    actors = logs.where(F.col("user_id").isNotNull()).select("user_id")
    people = users.join(actors, "user_id", "left_semi").select("user_id", "name", "email", "role").orderBy("name", "user_id")
    return people if limit is None else people.limit(limit)
