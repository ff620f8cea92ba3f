"""Rule policies for metadata: dispositions by precedence, quality flags, review queues, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tokens, terms and queues of the policy.
ARTICLE = ("journalarticle", "journal-article", "study")
NONRESEARCH = ("review", "editorial", "news", "book", "lettersandcomments")
QUEUES = ("priority_seed_review", "retrieval_review", "metadata_resolution_review", "nonresearch_type_review")
RULES = {
    "priority_seed": ("collaborator_seed_priority", "priority_seed_review"),
    "unresolved_missing_type": ("provider_type_missing", "metadata_resolution_review"),
    "flagged_nonresearch_type": ("provider_type_explicit_nonresearch_flag", "nonresearch_type_review"),
    "unresolved_mixed_type": ("provider_type_mixes_primary_and_nonresearch", "metadata_resolution_review"),
    "retained_article_type": ("provider_article_type_for_review", "retrieval_review"),
    "unresolved_other_type": ("provider_type_requires_review", "metadata_resolution_review"),
}


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def type_tokens(column: Column) -> Column:
    return F.filter(F.transform(F.split(column, "[;,]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def disposition(tokens: Column, origins: Column) -> Column:
    article, non = F.arrays_overlap(tokens, strings(*ARTICLE)), F.arrays_overlap(tokens, strings(*NONRESEARCH))
    return (
        F.when(F.exists(origins, lambda o: F.startswith(o, F.lit("collaborator_seed:"))), "priority_seed")
        .when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, "unresolved_missing_type")
        .when(F.size(F.array_except(tokens, strings(*NONRESEARCH))) == 0, "flagged_nonresearch_type")
        .when(article & non, "unresolved_mixed_type")
        .when(article, "retained_article_type")
        .otherwise("unresolved_other_type")
    )


def absent(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def classify(candidates: DataFrame) -> DataFrame:
    """Disposition, reason, queue and flags of each candidate; a projection, without any shuffle."""
    c = candidates.withColumn("tokens", F.coalesce(type_tokens(F.col("type")), F.array().cast("array<string>"))).withColumn("disposition", disposition(F.col("tokens"), F.col("origins")))
    rule = lambda i: F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[i])])[F.col("disposition")]
    flags = {f"missing_{n}": absent(n) for n in ("doi", "stable_id", "year", "venue")} | {"missing_type": F.size("tokens") == 0, "missing_landing_url": absent("landing_url"), "missing_open_access_url": absent("open_access_url")}
    found = F.filter(F.array(*[F.when(on, F.lit(name)) for name, on in flags.items()]), lambda x: x.isNotNull())
    identity = F.when(~absent("doi") & ~absent("stable_id"), "doi_and_stable_id").when(~absent("stable_id"), "stable_id_only").when(~absent("doi"), "doi_only").otherwise("missing_identity")
    access = F.when(~absent("open_access_url"), "open_access_url_present").when(~absent("landing_url"), "landing_url_only").otherwise("no_access_url")
    return c.withColumns({"reason": rule(0), "queue": rule(1), "flags": found, "identity": identity, "access": access}).withColumn("queue_rank", F.array_position(strings(*QUEUES), F.col("queue")))


def title_terms(title: Column, terms: list[str]) -> Column:
    """The terms that a title holds as whole words."""
    low = F.trim(F.regexp_replace(F.lower(title), r"(?U)\s+", " "))
    return F.filter(F.array(*[F.when(low.rlike(rf"(?U)(^|\W)\Q{t}\E($|\W)"), F.lit(t)) for t in terms]), lambda x: x.isNotNull())


def quality_band(text: Column, sample: int = 16_000) -> Column:
    low = F.lower(F.substring(text, 1, sample))
    has = lambda *words: F.exists(strings(*words), lambda w: F.contains(low, w))
    structure = has("methods", "methodology") & has("results", "findings")
    n = F.length(low)
    return F.when((n >= 8_000) & structure & has("table") & has("figure", "data"), "high").when((n >= 2_500) & structure, "medium").otherwise("lower")


def ranked(df: DataFrame, order: list[Column], top: int, position: str = "rank") -> DataFrame:
    """The first rows in a total order with their rank; only these are ranked, so no window holds all rows."""
    return df.orderBy(*order).limit(top).withColumn(position, F.row_number().over(Window.orderBy(*order)).cast("long"))


def geography(latitudes: Column, boundary: float = 66.56) -> Column:
    """Where sites lie: at or above a latitude, below it, or both."""
    bad = F.exists(latitudes, lambda x: x.isNull() | (x < -90) | (x > 90))
    above, below = F.exists(latitudes, lambda x: x >= boundary), F.exists(latitudes, lambda x: x < boundary)
    return F.when(bad, "invalid").when(above & below, "mixed").when(above, "core").when(below, "outside").otherwise("unresolved")
