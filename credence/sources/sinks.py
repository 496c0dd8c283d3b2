"""Writers.  Only results of bounded size become a single file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.functions.numeric import fixed
from credence.settings import JobSpec


def write_ranked_csv(ranked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The ranked list (k rows) as one CSV file in rank order, scores with four decimals."""
    (ranked.select("candidate_id", "rank", fixed(F.col("score"), 4).alias("score"), "reasoning")
     .orderBy("rank").coalesce(1)
     .write.mode(mode).option("header", True).option("escape", '"').csv(path))


def write_preview_csv(ranked: DataFrame, path: str, rows: int = 25, mode: str = "overwrite"
                      ) -> None:
    write_ranked_csv(ranked.filter(F.col("rank") <= rows), path, mode)


def write_table_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An audit table of any size; as many files as partitions."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A long table (metric, key, value) as JSON lines."""
    metrics.write.mode(mode).json(path)


def job_table(spark: SparkSession, jobs: list[JobSpec]) -> DataFrame:
    """Job requirements as rows, in the nested layout of the published document."""
    def row(job: JobSpec) -> dict:
        return {
            "role_title": job.role_title,
            "domains": {k: bool(v) for k, v in job.domains.items()},
            "experience": (job.minimum_years, job.preferred_min_years, job.preferred_max_years,
                           list(job.seniority_indicators)),
            "skills": (list(job.required_skills), list(job.preferred_skills)),
            "behavioral": (job.open_to_work, job.availability_days_max,
                           job.recruiter_engagement),
            "education": (list(job.degree_preferences), list(job.field_preferences)),
            "location": (list(job.preferred_locations), job.relocation_preferred),
        }
    return spark.createDataFrame([tuple(row(j).values()) for j in jobs], JOB_DDL)


JOB_DDL = """
role_title string, domains map<string, boolean>,
experience struct<minimum_years: double, preferred_min_years: double,
  preferred_max_years: double, seniority_indicators: array<string>>,
skills struct<required_skills: array<string>, preferred_skills: array<string>>,
behavioral struct<open_to_work: boolean, availability_days_max: int,
  recruiter_engagement: boolean>,
education struct<degree_preferences: array<string>, field_preferences: array<string>>,
location struct<preferred_locations: array<string>, relocation_preferred: boolean>
"""


def write_jobs(spark: SparkSession, jobs: list[JobSpec], path: str, mode: str = "overwrite"
               ) -> None:
    job_table(spark, jobs).coalesce(1).write.mode(mode).json(path)


def read_jobs(spark: SparkSession, path: str) -> list[JobSpec]:
    """Job requirements are configuration: a handful of rows that become plan literals."""
    rows = spark.read.schema(JOB_DDL).option("multiLine", True).json(path).collect()
    return [JobSpec(
        role_title=r.role_title, domains=dict(r.domains),
        minimum_years=r.experience.minimum_years,
        preferred_min_years=r.experience.preferred_min_years,
        preferred_max_years=r.experience.preferred_max_years,
        seniority_indicators=tuple(r.experience.seniority_indicators),
        required_skills=tuple(r.skills.required_skills),
        preferred_skills=tuple(r.skills.preferred_skills),
        open_to_work=r.behavioral.open_to_work,
        availability_days_max=r.behavioral.availability_days_max,
        recruiter_engagement=r.behavioral.recruiter_engagement,
        degree_preferences=tuple(r.education.degree_preferences),
        field_preferences=tuple(r.education.field_preferences),
        preferred_locations=tuple(r.location.preferred_locations),
        relocation_preferred=r.location.relocation_preferred) for r in rows]
