"""Component scores, their weighted sum, and the trust factor."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields

from pyspark.sql import Column, DataFrame, functions as F

from credence.functions import arrays
from credence.functions.numeric import min_max
from credence.operators.features import core_skills, proficiency_weight, with_features
from credence.operators.normalize import salary_inverted
from credence.operators.rules import long_skills
from credence.settings import JobSpec, RuleConfig, ScoreConfig, ScoreWeights, Taxonomy

COMPONENTS = tuple(f.name for f in fields(ScoreWeights))
COMPOSITES = ("capability_score", "pipeline_score", "production_score",
              "experience_quality_score")


def domain_score(job: JobSpec = JobSpec(), cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Mean evidence over the required domains, each capped."""
    wanted = [name for name, required in job.domains.items() if required]
    if not wanted:
        return F.lit(0.0)
    total = F.lit(0.0)
    for name in wanted:
        total = total + min_max(F.col(f"evidence_{name}"), 0.0, cfg.evidence_cap)
    return total / F.lit(float(len(wanted)))


def base_experience(job: JobSpec = JobSpec(), cfg: ScoreConfig = ScoreConfig()) -> Column:
    years = F.col("implied_experience_years")
    low, high = job.preferred_min_years, job.preferred_max_years
    return (F.when(years < job.minimum_years, 0.0)
            .when((years >= low) & (years <= high), 1.0)
            .when(years < low, F.greatest(
                F.lit(0.0), F.lit(1.0) - (F.lit(low) - years) * F.lit(cfg.junior_slope)))
            .otherwise(F.greatest(F.lit(cfg.senior_floor), F.lit(1.0)
                                  - (years - F.lit(high)) * F.lit(cfg.senior_slope))))


def base_skill(cfg: ScoreConfig = ScoreConfig()) -> Column:
    return (min_max(F.col("proficiency_weighted_skill_score"), 0.0, cfg.proficiency_cap)
            * F.lit(cfg.proficiency_share)
            + min_max(F.col("endorsement_weighted_skill_score"), 0.0, cfg.endorsement_cap)
            * F.lit(cfg.endorsement_share))


def blended(base: Column, first: Column, second: Column,
            cfg: ScoreConfig = ScoreConfig()) -> Column:
    """The base alone when both composites are zero, otherwise the fixed mix of the three."""
    own, one, two = cfg.blend
    return F.when((first == 0.0) & (second == 0.0), base).otherwise(
        F.lit(own) * base + F.lit(one) * first + F.lit(two) * second)


def education_score(cfg: ScoreConfig = ScoreConfig()) -> Column:
    related = (F.col("cs_degree_flag") != 0) | (F.col("ai_degree_flag") != 0)
    relevance = F.when(related, 1.0).otherwise(cfg.unrelated_degree)
    tier = F
    for i, value in enumerate(cfg.tier_scores, start=1):
        tier = tier.when(F.col(f"tier{i}_count") > 0, value)
    tier = tier.otherwise(cfg.unranked_tier)
    on_relevance, on_tier = cfg.education_split
    return F.when(F.col("education_count") == 0, 0.0).otherwise(
        relevance * F.lit(on_relevance) + tier * F.lit(on_tier))


def components(job: JobSpec = JobSpec(), cfg: ScoreConfig = ScoreConfig()) -> dict[str, Column]:
    """The seven component scores, in the order of the weighted sum."""
    return {
        "domain_score": domain_score(job, cfg),
        "experience_score": blended(base_experience(job, cfg),
                                    F.col("experience_quality_score"),
                                    F.col("production_score"), cfg),
        "skill_score": blended(base_skill(cfg), F.col("capability_score"),
                               F.col("pipeline_score"), cfg),
        "education_score": education_score(cfg),
        "behavioral_score": F.col("engagement_score"),
        "verification_score": F.col("verification_score"),
        "availability_score": F.col("availability_score"),
    }


def weighted_sum(weights: ScoreWeights = ScoreWeights()) -> Column:
    """One expression in a fixed order, so that equal rows get bit-equal scores."""
    total = F.lit(0.0)
    for name in COMPONENTS:
        total = total + F.col(f"{name}_score") * F.lit(getattr(weights, name))
    return total


def with_components(features: DataFrame, job: JobSpec = JobSpec(),
                    cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    return features.withColumns(components(job, cfg))


def with_score(scored: DataFrame, weights: ScoreWeights = ScoreWeights()) -> DataFrame:
    """Add `raw_score` and `final_score` to rows that have components and trust."""
    return (scored.withColumn("raw_score", weighted_sum(weights))
            .withColumn("final_score", F.col("raw_score") * F.col("trust_score")))


def breakdown() -> Column:
    """Components, trust and the composites as one struct."""
    return F.struct(*[F.col(f"{c}_score") for c in COMPONENTS], F.col("trust_score"),
                    *[F.col(c).alias(f"raw_{c}") for c in COMPOSITES])


def score_features(features: DataFrame, job: JobSpec = JobSpec(),
                   weights: ScoreWeights = ScoreWeights(),
                   cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    return with_score(with_components(features, job, cfg), weights)


def score_records(records: DataFrame, job: JobSpec = JobSpec(),
                  weights: ScoreWeights = ScoreWeights(), taxonomy: Taxonomy = Taxonomy(),
                  rules: RuleConfig = RuleConfig(), cfg: ScoreConfig = ScoreConfig(),
                  where: Column | str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features and scores of typed records.  No shuffle; the same on a stream.

    `where` is the optional hard filter on records before anything is computed.
    """
    if where is not None:
        records = records.filter(where)
    return score_features(with_features(records, taxonomy, rules, keep), job, weights, cfg)


def scenario_scores(scored: DataFrame, scenarios: Mapping[str, ScoreWeights],
                    key: str = "candidate_id") -> DataFrame:
    """Rows (key, scenario, score): each record rescored under each set of weights.

    The scenarios are a literal list, so the record is scored once and then repeated.
    """
    rescored = F.array(*[
        F.struct(F.lit(name).alias("scenario"),
                 (weighted_sum(w) * F.col("trust_score")).alias("score"))
        for name, w in scenarios.items()])
    return (scored.select(key, F.explode(rescored).alias("s"))
            .select(key, "s.scenario", "s.score"))


# --- alternative formulas -------------------------------------------------------------------

def boosted_skill_score(skills: Column, taxonomy: Taxonomy = Taxonomy()) -> Column:
    """Core skills weighted by level; ten or more endorsements give the full weight."""
    return arrays.total(core_skills(skills, taxonomy), lambda s: (
        proficiency_weight(s["proficiency"], taxonomy)
        * (F.lit(0.7) + F.lit(0.3) * F.least(F.lit(1.0), s["endorsements"] / F.lit(10.0)))),
        "double")


def fractional_trust(rules: RuleConfig = RuleConfig()) -> Column:
    """Trust with unequal flags: salary 1, inflated years 2, each long skill a half."""
    claimed = F.col("profile.years_of_experience")
    implied = F.col("total_career_months") / F.lit(12.0)
    points = (salary_inverted(F.col("signals.expected_salary")).cast("double")
              + F.when(claimed > implied + F.lit(rules.inflated_years), 2.0).otherwise(0.0)
              + F.size(long_skills(rules)) * F.lit(0.5))
    return F.greatest(F.lit(0.3), F.lit(1.0) - F.lit(0.15) * points)


def weighted_behavior() -> Column:
    """Response, interviews, offers and code activity; a missing history counts as zero."""
    s = F.col("signals")
    positive = lambda c: F.greatest(F.lit(0.0), c)
    return (F.lit(0.35) * s["recruiter_response_rate"]
            + F.lit(0.30) * s["interview_completion_rate"]
            + F.lit(0.15) * positive(s["offer_acceptance_rate"])
            + F.lit(0.20) * (positive(s["github_activity_score"]) / F.lit(100.0)))


def relocation_availability() -> Column:
    """Openness times mobility times a notice factor that falls over half a year."""
    s = F.col("signals")
    notice = F.greatest(F.lit(0.0), F.lit(1.0) - s["notice_period_days"] / F.lit(180.0))
    return (F.when(s["open_to_work_flag"], 1.0).otherwise(0.5)
            * F.when(s["willing_to_relocate"], 1.1).otherwise(1.0)
            * (F.lit(0.5) + F.lit(0.5) * notice))


def alternative_scores(derived: DataFrame, taxonomy: Taxonomy = Taxonomy(),
                       rules: RuleConfig = RuleConfig()) -> DataFrame:
    """The four alternative formulas side by side, for rows with derived properties."""
    return derived.select(
        "candidate_id",
        boosted_skill_score(F.col("skills"), taxonomy).alias("boosted_skill_score"),
        fractional_trust(rules).alias("fractional_trust"),
        weighted_behavior().alias("weighted_behavior"),
        relocation_availability().alias("relocation_availability"))
