"""Data sets for training and evaluation: pairs, splits, weights, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.hashing import hash32
from credence.functions.numbers import round_to
from credence.operators.sequences import running_sum


def training_pairs(pool: DataFrame, vendor: str, item: str, pairs: int) -> DataFrame:
    """``pairs`` verification pairs per vendor, genuine and forged in turn.

    Members are picked by hash order with min_by/max_by, so each vendor is one
    combining aggregation however many samples it has. Vendors without a real
    forgery get no forged pair.

    pool: vendor, item, genuine."""
    genuine = F.col("genuine")

    def best(tag: str, among: Column, pick=F.min_by) -> Column:
        return pick(F.col(item), F.when(among, hash32(F.lit(tag), F.col(item))))

    entries = []
    for k in range(pairs):
        left, near, far = best(f"a{k}", genuine), best(f"b{k}", genuine), best(f"b{k}", genuine, F.max_by)
        right = F.when(near != left, near).otherwise(far) if k % 2 == 0 else best(f"f{k}", ~genuine)
        entries.append(F.struct(F.lit(k).alias("k"), left.alias("left_id"), right.alias("right_id"), F.lit(1 - k % 2).alias("label")))
    rows = pool.groupBy(vendor).agg(F.array(*entries).alias("_p")).select(vendor, F.inline("_p"))
    return rows.where(F.col("left_id").isNotNull() & F.col("right_id").isNotNull())


def group_safe_split(files: DataFrame, seed: str = "42") -> DataFrame:
    """Half of the stems of each class (rounded down) move to the test split;
    all variants of a stem move together.

    Stems are ranked by hash. The rank of a stem comes from counts per hash
    prefix plus its place within the prefix, so a class of any size is spread
    over many groups."""
    stems = files.select("class", "group_stem").distinct()
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("group_stem")))
    keyed = stems.withColumn("_d", digest).withColumn("_prefix", F.substring("_d", 1, 3))
    ranked = running_sum(keyed, ["class"], "_prefix", ["_d", "group_stem"], F.lit(1), "rank")
    total = stems.groupBy("class").agg(F.count("*").alias("_n"))
    chosen = ranked.join(total, "class").select(
        "class", "group_stem", F.when(F.col("rank") <= F.floor(F.col("_n") / 2), "test").otherwise("val").alias("split"))
    return files.join(chosen, ["class", "group_stem"])


def split_counts(groups: DataFrame, fraction: float) -> DataFrame:
    """Rows for training and validation per group: round(n * f), at least one
    for validation when there is more than one row. groups: group, n."""
    share = F.rint(F.col("n") * F.lit(fraction)).cast("long")
    val = F.when(F.col("n") > 1, F.greatest(F.lit(1).cast("long"), share)).otherwise(F.lit(0).cast("long"))
    return groups.withColumn("val", val).withColumn("train", F.col("n") - F.col("val"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights N / (K * n_c)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("all"), F.count("*").alias("classes")).alias("t")).scalar()
    return counts.withColumn("_t", totals).select(label, "n", (F.col("_t.all") / (F.col("_t.classes") * F.col("n"))).alias("weight"))


def classification_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with the accuracy and the
    macro and weighted averages; a zero division gives 0. Four decimals.

    One pass reduces the data to a confusion matrix; the rest works on that."""
    cells = rows.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    own = cells.select(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    other = cells.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit"))
    per = own.unionByName(other).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hit")])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    per = per.withColumns({"precision": rate("hit", "guessed"), "recall": rate("hit", "support")})
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    exact = lambda c: F.col(c).cast("decimal(20,12)")
    macro = per.agg(F.lit("macro avg").alias("label"), *[F.avg(exact(c)).cast("double").alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"), *[(F.sum(exact(c) * F.col("support")).cast("double") / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    accuracy = per.agg(F.lit("accuracy").alias("label"), *[(F.sum("hit") / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    table = per.select("label", "precision", "recall", "f1", "support").unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return table.select("label", *[round_to(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def structure_faults(files: DataFrame, required: list[str], minimum: int = 1) -> DataFrame:
    """Required classes with too few files per split (split, class, n)."""
    counts = files.groupBy("split", "class").agg(F.count("*").alias("n"))
    wanted = files.select("split").distinct().select("split", F.explode(F.array(*[F.lit(c) for c in required])).alias("class"))
    joined = wanted.join(counts, ["split", "class"], "left").fillna(0, ["n"])
    return joined.where(F.col("n") < minimum)


def asset_group(stem: Column) -> Column:
    """bir_seal_0007 -> bir_seal; other names share one group."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"^(.+?)_\d{2,}", 1), F.lit("")), F.lit("all"))
