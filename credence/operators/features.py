"""Flat feature row per record: 61 base columns, five composites and the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credence.functions import arrays, text as T
from credence.functions.automaton import KeywordAutomaton
from credence.functions.coerce import strip
from credence.functions.numeric import safe_divide
from credence.operators import normalize as N
from credence.operators.rules import with_trust
from credence.settings import PROFICIENCIES, RuleConfig, Taxonomy

CONFIDENCE_LOW, CONFIDENCE_MID, CONFIDENCE_HIGH = (
    "Needs Additional Verification", "Medium Confidence", "High Confidence")

FLAG_COLUMNS = {
    "salary_inverted_flag": "HP-01", "skill_duration_overflow_flag": "HP-02",
    "date_paradox_flag": "HP-03", "inflated_experience_flag": "HP-04",
    "unendorsed_expert_flag": "HP-05",
}
DEGREE_WORDS = {
    "cs_degree_flag": ("computer science", "computer engineering"),
    "ai_degree_flag": ("artificial intelligence", "machine learning", "data science"),
}


def proficiency_weight(proficiency: Column, taxonomy: Taxonomy) -> Column:
    """Weight of a level; unknown levels get the default."""
    chain = F
    for level, weight in taxonomy.proficiency_weights.items():
        chain = chain.when(proficiency == level, F.lit(weight))
    return chain.otherwise(F.lit(taxonomy.default_proficiency_weight))


def core_skills(skills: Column, taxonomy: Taxonomy) -> Column:
    """Entries whose name is in the taxonomy (exact match, repeats kept)."""
    return F.filter(skills, lambda s: s["name"].isin(*taxonomy.core_skills))


def experience_features() -> dict[str, Column]:
    jobs = F.col("career_history")
    months = F.transform(jobs, lambda j: j["duration_months"])
    return {
        "years_experience": F.col("profile.years_of_experience"),
        "implied_experience_years": F.col("implied_experience_years"),
        "experience_gap": F.col("experience_discrepancy"),
        "total_jobs": F.size(jobs),
        "avg_job_duration_months": safe_divide(F.col("total_career_months"), F.size(jobs)),
        "max_job_duration_months": F.coalesce(F.array_max(months), F.lit(0)),
        "min_job_duration_months": F.coalesce(F.array_min(months), F.lit(0)),
    }


def skill_features(taxonomy: Taxonomy = Taxonomy()) -> dict[str, Column]:
    """Needs a `core_skills` column (see `with_inputs`)."""
    skills, core = F.col("skills"), F.col("core_skills")
    weight = lambda s: proficiency_weight(s["proficiency"], taxonomy)
    capped = lambda s: F.least(s["endorsements"], F.lit(taxonomy.endorsement_cap))
    level = lambda name: arrays.count_where(skills, lambda s: s["proficiency"] == name)
    return {
        "total_skill_count": F.size(skills),
        "ai_skill_count": F.size(core),
        **{f"{name}_skill_count": level(name) for name in reversed(PROFICIENCIES)},
        "proficiency_weighted_skill_score": arrays.total(core, weight, "double"),
        "endorsement_weighted_skill_score": arrays.total(
            core, lambda s: weight(s) * capped(s), "double"),
    }


def keyword_automaton(taxonomy: Taxonomy = Taxonomy()) -> KeywordAutomaton:
    """All dictionaries of the taxonomy, named <kind>_<dictionary>."""
    kinds = {"evidence": taxonomy.evidence, "capability": taxonomy.capability,
             "production": taxonomy.production, "quality": taxonomy.quality}
    return KeywordAutomaton({f"{kind}_{name}": tuple(words) for kind, groups in kinds.items()
                             for name, words in groups.items()}, taxonomy.whole_words)


def evidence_features(taxonomy: Taxonomy = Taxonomy(), keywords: str = "keywords"
                      ) -> dict[str, Column]:
    """ln(1 + occurrences), which damps texts that repeat a word."""
    return {f"evidence_{name}": F.log1p(F.col(f"{keywords}.`evidence_{name}`").cast("double"))
            for name in taxonomy.evidence}


def education_features() -> dict[str, Column]:
    education = F.col("education")
    studied = ("lower(array_join(transform(education, "
               "e -> concat_ws(' ', e.degree, e.field_of_study)), ' '))")
    return {
        "education_count": F.size(education),
        "highest_education_tier": F.col("highest_education_tier"),
        **{f"tier{i}_count": _tier_count(education, i) for i in (1, 2, 3, 4)},
        **{name: T.contains_any(studied, words).cast("int")
           for name, words in DEGREE_WORDS.items()},
    }


def _tier_count(education: Column, tier: int) -> Column:
    return arrays.count_where(education, lambda e: e["tier"] == f"tier_{tier}")


def engagement_score(response: Column, interviews: Column, completeness: Column) -> Column:
    return (F.lit(0.4) * response + F.lit(0.4) * interviews
            + F.lit(0.2) * (completeness / F.lit(100.0)))


def verification_score(*signs: Column, assessments: Column) -> Column:
    """A fifth for each verified sign, and a fifth for three or more assessments."""
    score = None
    for sign in signs:
        part = F.when(sign, 1.0).otherwise(0.0) * F.lit(0.2)
        score = part if score is None else score + part
    return score + F.least(F.lit(1.0), assessments / F.lit(3.0)) * F.lit(0.2)


def availability_score(notice_days: Column, open_to_work: Column) -> Column:
    """1 up to 15 days, falling to 0 after another 90; a fifth more when open to work."""
    waiting = F.greatest(F.lit(0).cast("bigint"), notice_days - 15) / F.lit(90.0)
    base = F.greatest(F.lit(0.0), F.lit(1.0) - waiting)
    return F.when(open_to_work, F.least(F.lit(1.0), base * F.lit(1.2))).otherwise(base)


def signal_features() -> dict[str, Column]:
    s = F.col("signals")
    bit = lambda c: c.cast("int")
    same = ("recruiter_response_rate", "interview_completion_rate", "offer_acceptance_rate")
    return {
        **{n: s[n] for n in same},
        "profile_views_30d": s["profile_views_received_30d"],
        "applications_30d": s["applications_submitted_30d"],
        "search_appearance_30d": s["search_appearance_30d"],
        "saved_by_recruiters_30d": s["saved_by_recruiters_30d"],
        "endorsements_received": s["endorsements_received"],
        "open_to_work_flag": bit(s["open_to_work_flag"]),
        "willing_to_relocate": bit(s["willing_to_relocate"]),
        "engagement_score": engagement_score(
            s["recruiter_response_rate"], s["interview_completion_rate"],
            s["profile_completeness_score"]),
        "verified_email": bit(s["verified_email"]),
        "verified_phone": bit(s["verified_phone"]),
        "linkedin_connected": bit(s["linkedin_connected"]),
        "github_available": bit(F.col("has_github")),
        "github_activity_score": F.when(F.col("has_github"), s["github_activity_score"])
        .otherwise(0.0),
        "assessment_count": F.col("n_assessments"),
        "avg_assessment_score": F.coalesce(F.col("avg_assessment_score"), F.lit(0.0)),
        "verification_score": verification_score(
            s["verified_email"], s["verified_phone"], s["linkedin_connected"],
            F.col("has_github"), assessments=F.col("n_assessments")),
        "notice_period_days": s["notice_period_days"],
        "availability_score": availability_score(s["notice_period_days"],
                                                 s["open_to_work_flag"]),
    }


def trust_features() -> dict[str, Column]:
    return {
        "trust_score": F.col("trust_score"),
        "honeypot_flag_count": F.col("n_flags"),
        **{name: (F.col("flag_counts")[code] > 0).cast("int")
           for name, code in FLAG_COLUMNS.items()},
    }


def skill_keywords(taxonomy: Taxonomy = Taxonomy(), names: str = "skill_names_lower") -> Column:
    """The skill names that are keywords of a capability group: few, and mostly none."""
    words = sorted({w for ws in taxonomy.capability.values() for w in ws})
    return F.filter(names, lambda n: n.isin(*words))


def group_matches(taxonomy: Taxonomy = Taxonomy(), keywords: str = "keywords",
                  skills: str = "skill_keywords") -> dict[str, Column]:
    """Per capability group: any keyword equal to a skill name or contained in the text."""
    return {group: (F.col(f"{keywords}.`capability_{group}`") > 0)
            | F.exists(skills, lambda n: n.isin(*words))
            for group, words in taxonomy.capability.items()}


def category_share(kind: str, categories, keywords: str = "keywords") -> Column:
    """Share of the dictionaries of a kind with a keyword in the text."""
    return T.matched_share(f"{keywords}.`{kind}_{name}` > 0" for name in categories)


def confidence(trust: Column, n_flags: Column, completeness: Column, capability: Column,
               response: Column) -> Column:
    return (F.when((trust < 0.8) | (n_flags > 1), CONFIDENCE_LOW)
            .when((completeness >= 70.0) & (capability >= 0.4) & (response >= 0.5)
                  & (trust >= 0.9), CONFIDENCE_HIGH)
            .otherwise(CONFIDENCE_MID))


def composite_features(taxonomy: Taxonomy = Taxonomy()) -> dict[str, Column]:
    """Needs `groups`, `keywords`, trust and signals."""
    return {
        "capability_score": T.matched_share(f"groups.`{g}`" for g in taxonomy.capability),
        "pipeline_score": T.matched_share(
            f"groups.`{s}`" if s in taxonomy.capability else "false" for s in taxonomy.stages),
        "production_score": category_share("production", taxonomy.production),
        "experience_quality_score": category_share("quality", taxonomy.quality),
    }


def with_inputs(records: DataFrame, taxonomy: Taxonomy = Taxonomy(),
                rules: RuleConfig = RuleConfig()) -> DataFrame:
    """Derived properties, trust, and the columns several features read.

    The counts of all dictionaries in the lowered text are one column, made in one pass over it.
    """
    prepared = with_trust(N.derive(records), rules).withColumns({
        "core_skills": core_skills(F.col("skills"), taxonomy),
        "career_text": N.career_text(F.col("profile"), F.col("career_history")),
        "skill_names_lower": F.transform("skills", lambda s: strip(F.lower(s["name"]))),
    }).withColumns({
        "keywords": keyword_automaton(taxonomy).counts(F.col("career_text")),
        "skill_keywords": skill_keywords(taxonomy),
    })
    return prepared.withColumn("groups", F.struct(
        *[m.alias(g) for g, m in group_matches(taxonomy).items()]))


def feature_columns(taxonomy: Taxonomy = Taxonomy()) -> dict[str, Column]:
    """All features except the composites, in output order."""
    return {**experience_features(), **skill_features(taxonomy), **evidence_features(taxonomy),
            **education_features(), **signal_features(), **trust_features()}


def with_features(records: DataFrame, taxonomy: Taxonomy = Taxonomy(),
                  rules: RuleConfig = RuleConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The feature row plus the columns named in `keep`."""
    base = feature_columns(taxonomy)
    composite = composite_features(taxonomy)
    prepared = with_inputs(records, taxonomy, rules)
    needed = [F.col("signals.profile_completeness_score").alias("_completeness")]
    wide = prepared.select("candidate_id", *[c.alias(n) for n, c in base.items()],
                           *[c.alias(n) for n, c in composite.items()], *needed,
                           *[k for k in keep if k not in base])
    named = wide.withColumn("confidence_category", confidence(
        F.col("trust_score"), F.col("honeypot_flag_count"), F.col("_completeness"),
        F.col("capability_score"), F.col("recruiter_response_rate")))
    return named.select("candidate_id", *base, *composite, "confidence_category",
                        *[k for k in keep if k not in base])


def features(records: DataFrame, taxonomy: Taxonomy = Taxonomy(),
             rules: RuleConfig = RuleConfig()) -> DataFrame:
    """The 67-column feature table."""
    return with_features(records, taxonomy, rules)
