"""Signature and stamp verification on embedding vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.text import canonical_city
from credence.functions.vectors import (
    as_doubles, calibrated_score, cosine, dot, euclidean, norm, similarity_from_distance, unit)


#: Samples a texture model is fitted on, about: a hash of the id picks them evenly
#: where there are more.
MOST_SAMPLES = 200_000


def usable_reference(embedding: Column) -> Column:
    """A stored reference, or NULL for the forms that mean "not enrolled"."""
    return F.when(embedding.isin("", "null"), None).otherwise(embedding)


def centroids(vectors: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Unit-length mean vector per group, combined map-side in the JVM."""
    means = vectors.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(as_doubles(F.col(vector)))).alias("_mean"), F.count("*").alias("members"))
    return means.select(*keys, unit(vector_to_array("_mean")).alias("centroid"), "members")


def mean_pairwise_cosine(vectors: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Mean cosine over all unordered pairs of a group, NULL below two members.

    For unit vectors the sum over pairs is (|sum|^2 - n) / 2, so the pairs are
    never formed: one pass, whatever the group size. Zero vectors count as
    similarity 0 with everything."""
    scaled = vectors.select(*keys, array_to_vector(unit(F.col(vector))).alias("_u"), (norm(F.col(vector)) > 0).alias("_live"))
    sums = scaled.groupBy(*keys).agg(Summarizer.sum(F.col("_u")).alias("_sum"), F.count("*").alias("members"),
                                     F.count_if("_live").alias("_nonzero"))
    total = vector_to_array("_sum")
    pairs = F.col("members") * (F.col("members") - 1)
    return sums.select(*keys, "members", F.when(F.col("members") > 1, (dot(total, total) - F.col("_nonzero")) / pairs).alias("consistency"))


def verify_signatures(samples: DataFrame, references: DataFrame, key: str, threshold: float | None = V.SIGNATURE_DISTANCE) -> DataFrame:
    """Distance to the keyed reference, similarity and verdict. Without a
    threshold the verdict is NULL; without a reference the reason says so."""
    limit = F.lit(threshold).cast("double")
    joined = samples.join(references.select(key, "reference"), key, "left")
    distance = euclidean(F.col("vector"), F.col("reference"))
    scored = joined.withColumn("distance", distance)
    d = F.col("distance")
    reason = (F.when(F.col("reference").isNull(), "no_reference_embedding")
              .when(F.size("vector") != F.size("reference"), "length_mismatch"))
    return scored.withColumns({
        "similarity": similarity_from_distance(d), "threshold": limit, "match": d <= limit,
        "score": calibrated_score(d, limit), "reason": reason}).drop("reference")


def resolve_issuer(documents: DataFrame, references: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """Reference of the document's issuer by type and city; an issuer that is not a
    city falls back to the type's single reference where it has no keyed one.

    documents: document_type_id, issuer_scope, city; references:
    document_type_id, city ('' = national), feature_vector, reference_id; single:
    document_type_id, feature_vector, reference_id, one per type."""
    scope, city = F.lower("issuer_scope"), canonical_city(F.col("city"))
    unscoped = scope.isNull() | scope.isin("none", "null")
    key = F.when(unscoped, None).when(scope == "lgu", city).otherwise("")
    keyed = documents.withColumn("_city", key)
    held = references.select("document_type_id", F.col("city").alias("_city"), "reference_id", F.col("feature_vector").alias("reference"))
    reason = (F.when(unscoped, "no_issuer_logo")
              .when((scope == "lgu") & F.col("_city").isNull(), "city_not_identified")
              .when(F.col("reference_id").isNull(), "unreferenced_logo"))
    found = keyed.join(held, ["document_type_id", "_city"], "left")
    if single is not None:
        spare = single.select("document_type_id", F.lit("").alias("_city"), F.col("reference_id").alias("_id"), F.col("feature_vector").alias("_vector"))
        found = found.join(spare, ["document_type_id", "_city"], "left")
        missing = F.col("reference_id").isNull()
        found = found.withColumns({"reference": F.when(missing, F.col("_vector")).otherwise(F.col("reference")), "reference_id": F.coalesce("reference_id", "_id")}).drop("_id", "_vector")
    return found.withColumn("reason", reason).drop("_city")


def verify_stamps(samples: DataFrame, threshold: float = V.STAMP_SIMILARITY) -> DataFrame:
    """Cosine against the resolved reference; the texture verdict (column
    genuine_probability, NULL = no classifier) never waits for a reference."""
    similarity = F.when(F.col("reason").isNull(), cosine(F.col("vector"), F.col("reference")))
    scored = samples.withColumn("similarity_score", similarity)
    return scored.withColumns({
        "threshold": F.when(F.col("reason").isNull(), F.lit(threshold)),
        "match": F.coalesce(F.col("similarity_score") >= threshold, F.lit(False))})


def class_gap(samples: DataFrame) -> tuple[Column, Column]:
    """Weights and bias of the line halfway between the mean vectors of two classes,
    as scalar subqueries over samples (vector, label 1 or 0): one number per
    component, whatever the number of samples."""
    parts = samples.select("label", F.posexplode("vector").alias("i", "x")).groupBy("i").agg(
        F.avg(F.when(F.col("label") == 1, F.col("x"))).alias("one"), F.avg(F.when(F.col("label") == 0, F.col("x"))).alias("zero"))
    ordered = F.array_sort(F.collect_list(F.struct("i", (F.col("one") - F.col("zero")).alias("w"))))
    weights = parts.agg(F.transform(ordered, lambda s: s["w"]).alias("weights")).scalar()
    bias = parts.agg((F.sum(F.col("zero") * F.col("zero") - F.col("one") * F.col("one")) / 2).alias("bias")).scalar()
    return weights, bias


@dataclass(frozen=True)
class TextureModel:
    """Coefficients of a fitted texture classifier, and the samples it learned from."""

    weights: list[float]
    bias: float
    taught: int

    def score(self, vector: Column) -> Column:
        return logistic_score(vector, F.array(*map(F.lit, self.weights)), F.lit(self.bias))


def fit_texture(samples: DataFrame, key: str, most: int = MOST_SAMPLES) -> TextureModel:
    """Logistic regression on samples (key, vector, label 1 or 0) of both classes,
    with the reference's penalty: half the squared weights against the sum of losses,
    components unscaled.

    Of more than ``most`` samples, those whose hashed key lies in the share that makes
    about ``most`` are taken. Samples without a vector or label are left out."""
    usable = samples.where(F.col("vector").isNotNull() & F.col("label").isin(0, 1))
    total = usable.count()
    if total > most:
        usable = usable.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_000)) < F.lit(1_000_000 * most // total))
    rows = usable.select(array_to_vector("vector").alias("features"), F.col("label").cast("double").alias("label")).persist()
    try:
        held = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(held) < 2:
            raise ValueError("a texture model needs samples of both classes")
        taught = sum(held.values())
        model = LogisticRegression(maxIter=1000, regParam=1.0 / taught, elasticNetParam=0.0, standardization=False, family="binomial").fit(rows)
    finally:
        rows.unpersist()
    return TextureModel([float(w) for w in model.coefficients], float(model.intercept), taught)


def texture_accuracy(model: TextureModel, samples: DataFrame) -> float | None:
    """Share of samples (vector, label) that the model gives their class; None without
    any."""
    right = (model.score(F.col("vector")) > 0.5).cast("int") == F.col("label")
    return samples.where(F.col("label").isin(0, 1)).agg(F.avg(right.cast("double")).alias("x")).first()["x"]


def logistic_score(vector: Column, weights: Column, bias: Column, steepness: float = 1.0) -> Column:
    """Probability of class 1 from a linear model with given coefficients."""
    dot = F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-steepness * (dot + bias)))


def texture_verdict(genuine: Column, threshold: float = 0.5) -> Column:
    return genuine < threshold


def enrolment_verdicts(detections: DataFrame, forensics: DataFrame, expected: int = V.ENROL_COUNT,
                       consistency: float = V.ENROL_CONSISTENCY) -> DataFrame:
    """Enrolment gate per photo: count, then consistency, then forensics.

    detections: photo_id, vector; forensics: photo_id, hard_flag."""
    agreed = mean_pairwise_cosine(detections, ["photo_id"])
    joined = forensics.join(agreed, "photo_id", "left")
    members = F.coalesce("members", F.lit(0))
    reason = (F.when(members != expected, "signature_count")
              .when(F.col("consistency").isNull() | (F.col("consistency") < consistency), "signature_similarity")
              .when(F.col("hard_flag"), "signature_edited"))
    return joined.select("photo_id", members.alias("members"), "consistency", reason.alias("reason"), reason.isNull().alias("accepted"))


def top_signatures(primary: DataFrame, enhanced: DataFrame, limit: int = V.ENROL_MAX_SIGNATURES) -> DataFrame:
    """The strongest signature boxes per photo; the enhanced pass is used only
    for photos without any in the first. A combining top-k keeps ``limit`` rows
    per photo and task, so a crowded photo never reaches one task whole."""
    own = primary.where(F.col("label") == "signature")
    spare = enhanced.where(F.col("label") == "signature").join(own.select("photo_id"), "photo_id", "left_anti")
    pool = own.unionByName(spare)
    ranked = pool.withColumn("_salt", F.pmod(F.xxhash64("position"), F.lit(64)))
    order = [F.col("confidence").desc(), F.col("position")]
    local = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("photo_id", "_salt").orderBy(*order))).where(F.col("_rank") <= limit)
    final = local.withColumn("rank", F.row_number().over(Window.partitionBy("photo_id").orderBy(*order)))
    return final.where(F.col("rank") <= limit).drop("_salt", "_rank")


def _grid(low: Column, high: Column, step: Column) -> Column:
    """Threshold number ``step`` of 200 evenly spaced ones; the last is exact."""
    last = V.EER_STEPS - 1
    return F.when(step >= last, high).otherwise(low + step * ((high - low) / F.lit(float(last))))


def eer_threshold(pairs: DataFrame, score: str = "distance", genuine_low: bool = True) -> DataFrame:
    """One row (threshold, far, frr): where false accepts and rejects meet.

    Each row is reduced to the outermost grid step that still accepts it, so the
    data is read once and shrinks to at most 200 x 2 counts; the error curves
    are running sums over those. ``genuine_low`` = small scores are genuine
    (distances); otherwise large ones are (similarities), and a threshold is
    given only where both classes occur."""
    rows = pairs.where(F.col(score).isNotNull()).select(F.col(score).alias("_v"), F.col("label").cast("int").alias("_l"))
    bounds = rows.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("b")).scalar()
    last = V.EER_STEPS - 1
    lo, hi, v = F.col("b.lo"), F.col("b.hi"), F.col("_v")
    place = (v - lo) / ((hi - lo) / F.lit(float(last)))
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(last), c.cast("int")))
    at = lambda step: _grid(lo, hi, step)
    if genuine_low:  # first step with threshold >= score
        guess = inside(F.ceil(place))
        step = F.when((guess > 0) & (at(guess - 1) >= v), guess - 1).when(at(guess) < v, guess + 1).otherwise(guess)
        accepted = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    else:  # last step with threshold <= score
        guess = inside(F.floor(place))
        step = F.when((guess < last) & (at(guess + 1) <= v), guess + 1).when(at(guess) > v, guess - 1).otherwise(guess)
        accepted = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    step = F.when(hi > lo, step).otherwise(0)
    counts = rows.withColumn("b", bounds).groupBy(step.alias("step")).agg(
        F.count_if(F.col("_l") == 1).alias("g"), F.count_if(F.col("_l") == 0).alias("f"))
    steps = pairs.sparkSession.range(V.EER_STEPS).select(F.col("id").cast("int").alias("step"))
    full = steps.join(F.broadcast(counts), "step", "left").fillna(0, ["g", "f"]).withColumn("b", bounds)
    whole = Window.partitionBy()  # 200 rows
    curve = full.select(
        "step", at(F.col("step")).alias("t"), F.sum("f").over(accepted).alias("fa"), F.sum("f").over(whole).alias("fn"),
        F.sum("g").over(accepted).alias("ga"), F.sum("g").over(whole).alias("gn"))
    far = F.coalesce(F.col("fa") / F.nullif("fn", F.lit(0)), F.lit(0.0))
    frr = F.coalesce((F.col("gn") - F.col("ga")) / F.nullif("gn", F.lit(0)), F.lit(0.0))
    both = (F.col("fn") > 0) & (F.col("gn") > 0)
    rated = curve.select("step", "t", far.alias("far"), frr.alias("frr"), both.alias("both"))
    best = rated.agg(F.min_by(F.struct("t", "far", "frr", "both"),
                              F.struct(F.abs(F.col("far") - F.col("frr")), "step")).alias("r"))
    kept = F.lit(True) if genuine_low else F.col("r.both")
    return best.select(F.when(kept, F.col("r.t")).alias("threshold"), F.col("r.far").alias("far"), F.col("r.frr").alias("frr"))


def similarity_to_group_reference(training: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """Evaluation rows against the mean genuine training vector of their asset."""
    refs = centroids(training.where(F.col("label") == 1), [key])
    return evaluation.join(refs, key).withColumn("similarity", cosine(F.col("vector"), F.col("centroid"))).drop("centroid", "members")
