"""Retrieval, citation and extraction metrics: by case, family and threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

METRICS = ("recall_at_k", "reciprocal_rank", "hit_rate", "citation_precision", "citation_coverage", "extraction_coverage", "locator_validity")
FAMILIES = ("text", "ocr", "layout", "vision", "media")
_NOT_CITED, _NO_CITATION, _NO_LOCATOR = "generation was not run", "nothing was cited", "no locator was observed"


def _share(a: Column, b: Column) -> Column:
    """Part of b's distinct members that a has."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(b))


def case_metrics(cases: DataFrame, observations: DataFrame, k: int) -> DataFrame:
    """(case_id, family, status, metrics, and a reason for each metric that is null).

    ``cases``: case_id, family, relevant (array), expected_extractions, required_locators (array),
    ineligible_reason.  ``observations``: case_id, retrieved (ranked array), cited (array; null if
    generation wasn't run, which differs from empty), extracted_count, extraction_reason,
    locators (array), observed_ineligible.  A case without observation fails.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    j = cases.join(observations.withColumn("seen", F.lit(True)), "case_id", "left")
    seen = F.coalesce("seen", F.lit(False))
    why_not = F.when(~seen, "the case was not observed").otherwise(F.coalesce("ineligible_reason", "observed_ineligible"))
    rel, top = F.col("relevant"), F.slice("retrieved", 1, k)
    hit = F.size(F.array_intersect(rel, top))
    first = F.array_min(F.transform(F.filter(F.transform(top, lambda x, i: F.struct(F.array_contains(rel, x).alias("hit"), (i + 1).alias("at"))), lambda s: s["hit"]), lambda s: s["at"]))
    cited, union = F.col("cited"), F.size(F.array_union("required_locators", "locators"))
    value = {
        "recall_at_k": (hit / F.size(F.array_distinct(rel)), None),
        "reciprocal_rank": (F.when(first.isNull(), 0.0).otherwise(1 / first), None),
        "hit_rate": ((hit > 0).cast("double"), None),
        "citation_precision": (F.when(F.size(cited) > 0, F.size(F.array_intersect(rel, cited)) / F.size(cited)), F.when(cited.isNull(), _NOT_CITED).otherwise(_NO_CITATION)),
        "citation_coverage": (F.when(cited.isNotNull(), F.when(F.size(cited) == 0, 0.0).otherwise(_share(cited, rel))), F.lit(_NOT_CITED)),
        "extraction_coverage": (F.least(F.col("extracted_count") / F.col("expected_extractions"), F.lit(1.0)), F.coalesce("extraction_reason", F.lit("extraction was not observed"))),
        "locator_validity": (F.when(F.size("locators") > 0, F.size(F.array_intersect("required_locators", "locators")) / union), F.lit(_NO_LOCATOR)),
    }
    cols = []
    for name in METRICS:
        v, reason = value[name]
        v = F.when(why_not.isNull(), v.cast("double"))
        cols += [v.alias(name), F.when(v.isNull(), F.coalesce(why_not, reason if reason is not None else F.lit(None).cast("string"))).alias(f"{name}_reason")]
    out = j.select("case_id", "family", seen.alias("seen"), *cols)
    known = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    status = F.when(~F.col("seen"), "fail").when(known == 0, "ineligible").when(known < len(METRICS), "incomplete").otherwise("pass")
    return out.withColumn("status", status).drop("seen")


def family_metrics(by_case: DataFrame) -> DataFrame:
    """(family, status, mean of each metric over the cases that have it, or the reasons why none)."""
    agg = []
    for m in METRICS:
        reasons = F.array_join(F.array_sort(F.collect_set(f"{m}_reason")), "; ")
        agg += [F.avg(m).alias(m), F.when(F.avg(m).isNull(), reasons).alias(f"{m}_reason")]
    every = lambda s: F.min(F.col("status") == s)
    status = F.when(F.max(F.col("status") == "fail"), "fail").when(every("pass"), "pass").when(every("ineligible"), "ineligible").otherwise("incomplete")
    return by_case.groupBy("family").agg(F.count("*").alias("n_cases"), status.alias("status"), *agg)


def thresholds(families: DataFrame, limits: list[tuple[str, float, str | None]]) -> DataFrame:
    """(metric, minimum, family, actual, passed, reason) for each limit (metric, minimum, family);
    without a family the unweighted mean over families, null if any has none."""
    out = None
    for metric, least, family in limits:
        if metric not in METRICS:
            raise ValueError(f"{metric!r} is no metric")
        mine = families if family is None else families.where(F.col("family") == family)
        row = mine.agg(F.when((F.count("*") == F.count(metric)) & (F.count("*") > 0), F.avg(metric)).alias("actual"))
        row = row.select(F.lit(metric).alias("metric"), F.lit(float(least)).alias("minimum"), F.lit(family).cast("string").alias("family"), "actual", (F.coalesce("actual", F.lit(-1.0)) >= least).alias("passed"), F.when(F.col("actual").isNull(), "a family has no value").alias("reason"))
        out = row if out is None else out.unionByName(row)
    return out


def overall(families: DataFrame, limits: DataFrame | None = None) -> str:
    status = {r.status for r in families.select("status").distinct().collect()}
    tests = limits.select("passed", "actual").collect() if limits is not None else []
    if "fail" in status or any(not r.passed and r.actual is not None for r in tests):
        return "fail"
    return "pass" if status == {"pass"} and all(r.passed for r in tests) else "incomplete"


def answers_report(examples: DataFrame, retrieved: DataFrame, answers: DataFrame) -> DataFrame:
    """(metric, value): hit_rate over the examples that name relevant chunks, and
    answer_contains_expected over those with an expected answer, compared without case.

    ``examples``: example_id, expected_answer, relevant (array); ``retrieved``: example_id,
    chunk_id; ``answers``: example_id, answer.
    """
    got = retrieved.groupBy("example_id").agg(F.collect_set("chunk_id").alias("got"))
    j = examples.join(got, "example_id", "left").join(answers.select("example_id", "answer"), "example_id", "left")
    hit = F.when(F.size("relevant") > 0, F.coalesce(F.arrays_overlap("relevant", "got"), F.lit(False)).cast("double"))
    said = F.when(F.col("expected_answer").isNotNull(), F.coalesce(F.contains(fold(F.col("answer")), fold(F.col("expected_answer"))), F.lit(False)).cast("double"))
    m = j.agg(F.avg(hit).alias("hit_rate"), F.avg(said).alias("answer_contains_expected"))
    return m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in m.columns])).alias("s")).select("s.*").where("value IS NOT NULL")


def nearest_rank(values: DataFrame, column: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """The ceil(p n)-th smallest value for each share p."""
    cols = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(p * 100)}") for p in shares]
    return values.groupBy(*by).agg(*cols) if by else values.agg(*cols)


def gold_matches(chunks: DataFrame, selectors: DataFrame) -> DataFrame:
    """(case_id, chunk_id): chunks with a piece of evidence at the selector's place in its asset.
    ``chunks``: chunk_id, evidence array<struct(sha256, locator)>; ``selectors``: case_id, sha256,
    locator."""
    e = chunks.select("chunk_id", F.explode("evidence").alias("e")).select("chunk_id", F.col("e.sha256").alias("sha256"), F.to_json("e.locator").alias("place"))
    s = selectors.select("case_id", "sha256", F.to_json("locator").alias("place"))
    return s.join(e, ["sha256", "place"]).select("case_id", "chunk_id").distinct()
