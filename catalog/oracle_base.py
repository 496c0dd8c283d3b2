"""SQL building blocks: the records of `catalog.view` and their scores as plain tables.

Arrays become child tables (`job`, `skill`, `edu`, `assess`), so rules are joins, groupings and
windows here while the library uses array expressions: the two sides share no logic.
"""

from __future__ import annotations

from catalog import view as V
from credence import settings as S


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"{listed(values)}[CAST(({index}) % {len(values)} + 1 AS BIGINT)]"


def among(column: str, values) -> str:
    return f"{column} IN ({', '.join(quoted(v) for v in values)})"


VIEW = f"""
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d,
         CAST(floor(o_totalprice) AS BIGINT) AS p,
         CASE WHEN o_orderkey % 97 = 5 THEN 'BAD_' || o_orderkey
              WHEN length(CAST(o_orderkey AS VARCHAR)) < 7
              THEN 'CAND_' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')
              ELSE 'CAND_' || o_orderkey END AS candidate_id,
         CASE WHEN o_orderkey % 59 = 7 THEN 0 ELSE 1 + o_orderkey % 4 END AS nj,
         CASE WHEN o_orderkey % 101 > 95 THEN 2 ELSE 3 + o_custkey % 10 END AS ns
  FROM orders),
job0 AS (
  SELECT k, c, i, d + CAST(i * 400 - 1600 - k % 50 AS INTEGER) AS s,
         (i = nj - 1 AND k % 3 <> 0) OR (k % 43 = 11 AND i = 0) AS is_current
  FROM (SELECT k, c, d, nj, unnest(range(0, nj)) AS i FROM base)),
job AS (
  SELECT k, i, 'Co' || ((c + i) % 63) AS company, {pick(V.TITLES, 'k + i')} AS title, s,
         CASE WHEN NOT is_current THEN s + CAST(((k + i * 3) % 24) * 30 AS INTEGER) END AS e,
         CASE WHEN k % 71 = 3 AND i = 0 THEN -1 ELSE 3 + (k + i * 5) % 40 END AS dur, is_current,
         {pick(V.FIELDS, 'c + i')} AS industry, {pick(V.SIZES, 'k + i * 2')} AS company_size,
         {pick(V.PHRASES, 'k + i')} || ' and ' || {pick(V.PHRASES, 'k * 5 + i * 7 + 7')}
           || ', later ' || {pick(V.PHRASES, 'c + i * 11')} AS description
  FROM job0),
skill0 AS (
  SELECT k, c, j, CASE WHEN k % 17 = 0 THEN j // 2 ELSE j END AS slot
  FROM (SELECT k, c, unnest(range(0, ns)) AS j FROM base)),
skill AS (
  SELECT k, j, CASE WHEN k % 89 = 4 AND j = 0 THEN ''
                    ELSE {pick(V.SKILLS, 'k * 3 + c + slot * 5')} END AS name,
         CASE WHEN k % 103 = 6 THEN 'guru' ELSE {pick(V.LEVELS, 'k + j')} END AS proficiency,
         CASE WHEN k % 83 = 1 AND j = 0 THEN -1 ELSE (c + j * 7) % 60 END AS endorsements,
         (k + j * 11) % 60 + CASE WHEN (k + j) % 29 = 0 THEN 100 ELSE 0 END AS dur
  FROM skill0),
edu0 AS (
  SELECT k, j, 1995 + k % 20 + j * CASE WHEN k % 4 = 2 THEN 3 ELSE 5 END AS b
  FROM (SELECT k, unnest(range(0, k % 3)) AS j FROM base)),
edu AS (
  SELECT k, j, 'Univ' || ((k + j) % 37) AS institution, {pick(V.DEGREES, 'k + j')} AS degree,
         {pick(V.FIELDS, 'k + j * 2')} AS field_of_study,
         CASE WHEN k % 61 = 5 AND j = 0 THEN NULL ELSE b END AS s,
         b + 4 - CASE WHEN k % 41 = 0 THEN 5 ELSE 0 END
           + CASE WHEN k % 37 = 0 THEN 10 ELSE 0 END AS e,
         {pick(V.TIERS, 'k + j')} AS tier
  FROM edu0),
assess AS (
  SELECT k, name, CAST(50 + k % 51 AS DOUBLE) AS score, 0 AS o
  FROM skill WHERE j = 0 AND k % 4 = 0
  UNION ALL
  SELECT k, 'SQL', CAST(60 + k % 41 AS DOUBLE), 1
  FROM skill WHERE j = 0 AND k % 8 = 0 AND name <> 'SQL'),
career AS (
  SELECT base.k, CAST(coalesce(sum(dur), 0) AS BIGINT) AS months,
         arg_min(title, i) FILTER (is_current) AS current_title,
         string_agg(title || ' ' || description, ' ' ORDER BY i) AS words
  FROM base LEFT JOIN job USING (k) GROUP BY base.k),
person0 AS (
  SELECT base.*, months, words,
         CASE WHEN k % 11 = 0 OR current_title IS NULL THEN {pick(V.TITLES, 'k')}
              ELSE current_title END AS shown,
         DATE '2024-01-01' + CAST(k % 400 AS INTEGER) AS signup,
         CASE WHEN k % 19 <> 0 THEN CAST(10 + k % 30 AS DOUBLE) END AS smin
  FROM base JOIN career USING (k)),
person AS (
  SELECT *, round(months / CAST(12 AS DOUBLE), 2) AS implied,
         floor(months * 10 / CAST(12 AS DOUBLE)) / CAST(10 AS DOUBLE)
           + CASE WHEN k % 23 = 0 THEN 5 ELSE 0 END
           + CASE WHEN k % 997 = 8 THEN 60 ELSE 0 END AS claimed,
         CASE WHEN k % 79 = 2 THEN '' ELSE shown END AS title,
         shown || ' - ' || {pick(V.PHRASES, 'c')} AS headline,
         {pick(V.PHRASES, 'c + k + 1')} || '. ' || {pick(V.PHRASES, 'c * 3 + k + 3')} || '. '
           || {pick(V.PHRASES, 'c * 5 + k + 5')} || '. ' || {pick(V.PHRASES, 'c * 7 + k + 7')}
           AS summary,
         CASE WHEN k % 53 = 0 THEN '' ELSE {pick(V.COUNTRIES, 'c + 3')} END AS location,
         {pick(V.COUNTRIES, 'c')} AS country,
         CASE WHEN k % 5 = 0 THEN smin - 5 ELSE smin + 15 END AS smax,
         CASE WHEN k % 67 = 3 THEN DATE '2026-07-01' WHEN k % 13 = 0 THEN signup - 10
              ELSE signup + CAST(k % 500 AS INTEGER) END AS active,
         CAST(k % 101 + CASE WHEN k % 409 = 6 THEN 50 ELSE 0 END AS DOUBLE) AS completeness,
         CAST(k % 101 AS DOUBLE) / 100 + CASE WHEN k % 401 = 3 THEN 1 ELSE 0 END AS response,
         CAST(k * 7 % 101 AS DOUBLE) / 100 AS interview,
         CASE WHEN k % 3 = 0 THEN -1 ELSE CAST(k % 11 AS DOUBLE) / 10 END AS offer,
         CASE WHEN k % 3 <> 0 THEN -1 ELSE CAST(k % 101 AS DOUBLE) END AS github,
         CASE WHEN k % 31 = 0 THEN 0 ELSE k % 50 END AS views,
         CASE WHEN k % 31 = 0 THEN 0 ELSE k % 120 END AS searches,
         CASE WHEN k % 31 = 0 THEN 0 ELSE k % 9 END AS saves, k % 17 AS applications,
         (k % 14) * 15 AS raw_notice,
         CASE WHEN k % 14 = 0 THEN 60 ELSE (k % 14) * 15 END AS notice,
         k % 3 = 1 AS open_to_work, k % 4 = 1 AS relocate, k % 5 < 4 AS email,
         k % 5 < 3 AS phone, k % 3 = 2 AS linkedin,
         CASE WHEN k % 73 = 9 THEN 'mars' ELSE {pick(V.MODES, 'k')} END AS work_mode,
         CAST(p % 600 AS DOUBLE) AS response_hours, p % 1200 AS connections,
         k % 500 AS endorsed
  FROM person0)"""

OVERLAPS = """
job_overlap AS (
  SELECT k, i, date_diff('day', ns, e) / CAST(30 AS DOUBLE) AS months
  FROM (SELECT k, i, s, e, lead(s) OVER (PARTITION BY k ORDER BY s, i) AS ns
        FROM job WHERE e IS NOT NULL) WHERE ns < e)"""

# One row per finding: (k, code).
ANOMALIES = OVERLAPS + """,
anomaly AS (
  SELECT k, 'HP-01_SALARY_INVERTED' AS code FROM person WHERE smax < smin
  UNION ALL SELECT k, 'HP-02_SKILL_DURATION_OVERFLOW'
    FROM skill JOIN person USING (k) WHERE dur > months + 12
  UNION ALL SELECT k, 'HP-03_DATE_PARADOX' FROM person WHERE active < signup
  UNION ALL SELECT k, 'HP-04_INFLATED_YOE' FROM person WHERE claimed > implied + 3
  UNION ALL SELECT k, 'HP-05_UNENDORSED_EXPERT' FROM skill
    WHERE proficiency = 'expert' AND endorsements < 1
      AND NOT EXISTS (SELECT 1 FROM assess a WHERE a.k = skill.k AND a.name = skill.name)
  UNION ALL SELECT k, 'HP-06_HIGH_SCORE_ZERO_ENDORSE' FROM (
    SELECT a.k, a.name, arg_max(s.endorsements, s.j) AS last_endorsements
    FROM assess a LEFT JOIN skill s ON s.k = a.k AND s.name = a.name
    WHERE a.score > 85 GROUP BY a.k, a.name) WHERE coalesce(last_endorsements, 0) = 0
  UNION ALL SELECT k, 'HP-07_OVERLAP_JOBS' FROM job_overlap WHERE months > 3
  UNION ALL SELECT k, 'HP-08_GHOST_PROFILE' FROM person
    WHERE views = 0 AND searches = 0 AND saves = 0 AND applications > 5
  UNION ALL SELECT k, 'HP-10_PCS_MISMATCH' FROM person
    WHERE completeness > 90 AND ns < 3 AND k % 3 = 0),
flags AS (
  SELECT person.k, count(code) AS n_flags,
         greatest(0.25, 1 - count(code) * CAST(0.12 AS DOUBLE)) AS trust
  FROM person LEFT JOIN anomaly USING (k) GROUP BY person.k)"""


def count_sql(text: str, word: str) -> str:
    return (f"(length({text}) - length(replace({text}, {quoted(word)}, ''))) "
            f"// {len(word)}")


def evidence_sql(text: str, words) -> str:
    return f"ln(1 + CAST({' + '.join(count_sql(text, w) for w in words)} AS DOUBLE))"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def share_sql(conditions) -> str:
    conditions = list(conditions)
    return (f"CAST({' + '.join(f'CAST({c} AS INTEGER)' for c in conditions)} AS DOUBLE) "
            f"/ {len(conditions)}")


def group_sql(words) -> str:
    return f"({any_sql('txt', words)} OR coalesce(list_has_any(names, {listed(words)}), false))"


_WEIGHT = "CASE proficiency " + " ".join(
    f"WHEN '{n}' THEN {w}" for n, w in S.PROFICIENCY_WEIGHTS.items()) + " ELSE 1 END"

FEATURES = f"""
skill_sum AS (
  SELECT k, list(lower(trim(name))) AS names,
         count(*) FILTER ({among('name', S.CORE_SKILLS)}) AS n_core,
         coalesce(sum(CAST({_WEIGHT} AS DOUBLE)) FILTER ({among('name', S.CORE_SKILLS)}), 0)
           AS prof,
         coalesce(sum(CAST({_WEIGHT} AS DOUBLE) * least(endorsements, 50))
           FILTER ({among('name', S.CORE_SKILLS)}), 0) AS endo,
         count(*) FILTER (proficiency = 'expert') AS n_expert,
         count(*) FILTER (proficiency = 'advanced') AS n_advanced,
         count(*) FILTER (proficiency = 'intermediate') AS n_intermediate,
         count(*) FILTER (proficiency = 'beginner') AS n_beginner
  FROM skill GROUP BY k),
edu_sum AS (
  SELECT k, count(*) AS n_edu, count(*) FILTER (tier = 'tier_1') AS t1,
         count(*) FILTER (tier = 'tier_2') AS t2, count(*) FILTER (tier = 'tier_3') AS t3,
         count(*) FILTER (tier = 'tier_4') AS t4,
         bool_or(field_of_study = 'Computer Science') AS cs,
         bool_or(field_of_study IN ('Machine Learning', 'Data Science')) AS ai,
         arg_min(tier, (coalesce(list_position({listed(S.EDUCATION_TIERS)}, tier), 5), j))
           AS best
  FROM edu GROUP BY k),
assess_sum AS (SELECT k, count(*) AS n_assess, avg(score) AS avg_assess FROM assess GROUP BY k),
texts AS (
  SELECT k, lower(concat_ws(' ', headline, summary, nullif(title, ''), words)) AS txt,
         names FROM person JOIN skill_sum USING (k)),
textual AS (
  SELECT k, {", ".join(f"{evidence_sql('txt', w)} AS ev_{n}"
                       for n, w in S.EVIDENCE_KEYWORDS.items())},
         {", ".join(f"{group_sql(w)} AS g_{n}" for n, w in S.CAPABILITY_GROUPS.items())},
         {share_sql(any_sql('txt', w) for w in S.PRODUCTION_KEYWORDS.values())} AS production,
         {share_sql(any_sql('txt', w) for w in S.QUALITY_KEYWORDS.values())} AS quality,
         txt, names
  FROM texts),
feat AS (
  SELECT person.*, flags.* EXCLUDE (k), skill_sum.* EXCLUDE (k, names), textual.* EXCLUDE (k),
         coalesce(n_edu, 0) AS n_edu, coalesce(t1, 0) AS t1, coalesce(t2, 0) AS t2,
         coalesce(t3, 0) AS t3, coalesce(t4, 0) AS t4, coalesce(cs, false) AS cs,
         coalesce(ai, false) AS ai, coalesce(best, 'none') AS best,
         coalesce(n_assess, 0) AS n_assess, coalesce(avg_assess, 0) AS avg_assess,
         {share_sql(f'g_{g}' for g in S.CAPABILITY_GROUPS)} AS capability,
         {share_sql(f'g_{g}' for g in S.PIPELINE_STAGES)} AS stages,
         CAST(0.4 AS DOUBLE) * response + CAST(0.4 AS DOUBLE) * interview
           + CAST(0.2 AS DOUBLE) * (completeness / 100) AS engagement,
         CAST(0.2 AS DOUBLE) * (CAST(email AS INTEGER) + CAST(phone AS INTEGER)
           + CAST(linkedin AS INTEGER) + CAST(github >= 0 AS INTEGER)
           + least(1, coalesce(n_assess, 0) / CAST(3 AS DOUBLE))) AS verification,
         CASE WHEN open_to_work
              THEN least(1, greatest(0, 1 - greatest(0, notice - 15) / CAST(90 AS DOUBLE))
                            * CAST(1.2 AS DOUBLE))
              ELSE greatest(0, 1 - greatest(0, notice - 15) / CAST(90 AS DOUBLE))
              END AS availability
  FROM person JOIN flags USING (k) JOIN skill_sum USING (k) JOIN textual USING (k)
       LEFT JOIN edu_sum USING (k) LEFT JOIN assess_sum USING (k))"""

SCORES = f"""
comp AS (
  SELECT *,
    CASE WHEN trust < 0.8 OR n_flags > 1 THEN 'Needs Additional Verification'
         WHEN completeness >= 70 AND capability >= 0.4 AND response >= 0.5 AND trust >= 0.9
         THEN 'High Confidence' ELSE 'Medium Confidence' END AS confidence,
    ({" + ".join(f"least(1, ev_{n} / 3)" for n in S.EVIDENCE_KEYWORDS)}) / 10 AS domain,
    CASE WHEN implied < 3 THEN 0 WHEN implied BETWEEN 5 AND 12 THEN 1
         WHEN implied < 5 THEN greatest(0, 1 - (5 - implied) * CAST(0.2 AS DOUBLE))
         ELSE greatest(0.5, 1 - (implied - 12) * CAST(0.05 AS DOUBLE)) END AS exp0,
    least(1, greatest(0, prof / 30)) * CAST(0.7 AS DOUBLE)
      + least(1, greatest(0, endo / 1500)) * CAST(0.3 AS DOUBLE) AS skill0,
    CASE WHEN n_edu = 0 THEN 0 ELSE
      CASE WHEN cs OR ai THEN 1 ELSE 0.5 END * CAST(0.6 AS DOUBLE)
      + CASE WHEN t1 > 0 THEN 1 WHEN t2 > 0 THEN 0.8 WHEN t3 > 0 THEN 0.6
             WHEN t4 > 0 THEN 0.4 ELSE 0.2 END * CAST(0.4 AS DOUBLE) END AS education
  FROM feat),
comp2 AS (
  SELECT *,
    CASE WHEN quality = 0 AND production = 0 THEN exp0
         ELSE CAST(0.5 AS DOUBLE) * exp0 + CAST(0.3 AS DOUBLE) * quality
              + CAST(0.2 AS DOUBLE) * production END AS experience,
    CASE WHEN capability = 0 AND stages = 0 THEN skill0
         ELSE CAST(0.5 AS DOUBLE) * skill0 + CAST(0.3 AS DOUBLE) * capability
              + CAST(0.2 AS DOUBLE) * stages END AS skills
  FROM comp),
scored AS (
  SELECT *, raw * trust AS final, CAST(printf('%.4f', raw * trust) AS DOUBLE) AS published
  FROM (SELECT *, domain * CAST(0.30 AS DOUBLE) + experience * CAST(0.15 AS DOUBLE)
          + skills * CAST(0.25 AS DOUBLE) + education * CAST(0.05 AS DOUBLE)
          + engagement * CAST(0.10 AS DOUBLE) + verification * CAST(0.10 AS DOUBLE)
          + availability * CAST(0.05 AS DOUBLE) AS raw FROM comp2))"""


def with_tables(*blocks: str) -> str:
    """`WITH ...` over the given blocks, ready for a SELECT."""
    return "WITH " + ",".join(blocks) + "\n"


ON_VIEW = with_tables(VIEW)
ON_FLAGS = with_tables(VIEW, ANOMALIES)
ON_FEATURES = with_tables(VIEW, ANOMALIES, FEATURES)
ON_SCORES = with_tables(VIEW, ANOMALIES, FEATURES, SCORES)
