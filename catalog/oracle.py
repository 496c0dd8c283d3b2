"""DuckDB SQL for the registered queries, on the same parquet tables."""

from __future__ import annotations

from catalog import oracle_base as B
from catalog import view as V
from catalog.queries import DOCUMENT_WORDS, GROUP_WORDS
from credence import settings as S
from credence.operators import profile as P

D = "CAST({} AS DOUBLE)".format


def r6(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


# --- findings per rule, one row each --------------------------------------------------------

SCHEMA = f"""
schema_hit AS (
  SELECT k, 'ID_FORMAT' AS code, 'error' AS severity FROM person
    WHERE NOT regexp_full_match(candidate_id, 'CAND_[0-9]{{7}}')
  UNION ALL SELECT k, 'TITLE_EMPTY', 'warning' FROM person WHERE title = ''
  UNION ALL SELECT k, 'LOCATION_EMPTY', 'warning' FROM person WHERE location = ''
  UNION ALL SELECT k, 'YEARS_RANGE', 'error' FROM person WHERE claimed < 0 OR claimed > 50
  UNION ALL SELECT k, 'CAREER_EMPTY', 'error' FROM person WHERE nj = 0
  UNION ALL SELECT k, 'COMPANY_SIZE', 'warning' FROM job
    WHERE NOT {B.among('company_size', S.COMPANY_SIZES)}
  UNION ALL SELECT k, 'JOB_DURATION_NEGATIVE', 'error' FROM job WHERE dur < 0
  UNION ALL SELECT k, 'SKILL_NAME_EMPTY', 'warning' FROM skill WHERE name = ''
  UNION ALL SELECT k, 'SKILL_PROFICIENCY', 'warning' FROM skill
    WHERE NOT {B.among('proficiency', S.PROFICIENCIES)}
  UNION ALL SELECT k, 'SKILL_ENDORSEMENTS_NEGATIVE', 'warning' FROM skill WHERE endorsements < 0
  UNION ALL SELECT k, 'SKILL_DURATION_NEGATIVE', 'warning' FROM skill WHERE dur < 0
  UNION ALL SELECT k, 'EDUCATION_TIER', 'warning' FROM edu
    WHERE NOT {B.among('tier', S.EDUCATION_TIERS)}
  UNION ALL SELECT k, 'PROFILE_COMPLETENESS_SCORE_RANGE', 'error' FROM person
    WHERE completeness NOT BETWEEN 0 AND 100
  UNION ALL SELECT k, 'GITHUB_ACTIVITY_SCORE_RANGE', 'error' FROM person
    WHERE github NOT BETWEEN -1 AND 100
  UNION ALL SELECT k, 'OFFER_ACCEPTANCE_RATE_RANGE', 'error' FROM person
    WHERE offer NOT BETWEEN -1 AND 1
  UNION ALL SELECT k, 'RECRUITER_RESPONSE_RATE_RANGE', 'error' FROM person
    WHERE response NOT BETWEEN 0 AND 1
  UNION ALL SELECT k, 'INTERVIEW_COMPLETION_RATE_RANGE', 'error' FROM person
    WHERE interview NOT BETWEEN 0 AND 1
  UNION ALL SELECT k, 'WORK_MODE', 'warning' FROM person
    WHERE NOT {B.among('work_mode', S.WORK_MODES)}
  UNION ALL SELECT k, 'NOTICE_UNUSUAL', 'warning' FROM person WHERE notice NOT BETWEEN 0 AND 180)"""

CONSISTENCY = """
edu_step AS (
  SELECT k, j, s, e, lead(s) OVER (PARTITION BY k ORDER BY s, j) AS next_s
  FROM edu WHERE s IS NOT NULL AND e IS NOT NULL),
consistency_hit AS (
  SELECT k, 'SALARY_INVERTED' AS code, 'warning' AS severity FROM person WHERE smax < smin
  UNION ALL SELECT k, 'SALARY_NEGATIVE', 'warning' FROM person WHERE smin < 0
  UNION ALL SELECT k, 'ACTIVE_BEFORE_SIGNUP', 'warning' FROM person WHERE active < signup
  UNION ALL SELECT k, 'ACTIVE_IN_FUTURE', 'warning' FROM person WHERE active > DATE '2026-06-23'
  UNION ALL SELECT person.k, 'TITLE_DIFFERS', 'warning' FROM person
    WHERE title <> '' AND EXISTS (SELECT 1 FROM job WHERE job.k = person.k AND is_current)
      AND NOT EXISTS (SELECT 1 FROM job WHERE job.k = person.k AND is_current
                      AND lower(job.title) = lower(person.title))
  UNION ALL SELECT k, 'MANY_CURRENT_JOBS', 'warning' FROM job WHERE is_current
    GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT k, 'EDUCATION_NEGATIVE', 'warning' FROM edu WHERE e - s < 0
  UNION ALL SELECT k, 'EDUCATION_LONG', 'warning' FROM edu WHERE e - s > 12
  UNION ALL SELECT k, 'EDUCATION_FUTURE', 'warning' FROM edu WHERE e > 2030
  UNION ALL SELECT k, 'EDUCATION_OVERLAP', 'warning' FROM edu_step WHERE next_s < e)"""

FORENSIC = """
forensic_hit AS (
  SELECT k, 'OVERLAP_JOBS' AS code FROM job_overlap WHERE months > 3
  UNION ALL SELECT k, 'INFLATED_YOE' FROM person
    WHERE claimed > months / CAST(12 AS DOUBLE) + 3
  UNION ALL SELECT k, 'SKILL_DURATION_OVERFLOW' FROM skill JOIN person USING (k)
    WHERE dur > months + 12
  UNION ALL SELECT DISTINCT k, 'UNENDORSED_EXPERT' FROM skill
    WHERE proficiency = 'expert' AND endorsements = 0
  UNION ALL SELECT k, 'PCS_MISMATCH' FROM person
    WHERE completeness > 90 AND ns < 3 AND k % 3 = 0
  UNION ALL SELECT k, 'EDU_NEG_DURATION' FROM edu WHERE e - s < 0
  UNION ALL SELECT k, 'EDU_LONG_DURATION' FROM edu WHERE e - s > 12
  UNION ALL SELECT k, 'SALARY_INVERTED' FROM person
    WHERE smin <> 0 AND smax <> 0 AND smax < smin
  UNION ALL SELECT k, 'HIGH_SCORE_ZERO_ENDORSE' FROM anomaly
    WHERE code = 'HP-06_HIGH_SCORE_ZERO_ENDORSE'
  UNION ALL SELECT person.k, 'TITLE_MISMATCH' FROM person
    WHERE EXISTS (SELECT 1 FROM job WHERE job.k = person.k AND is_current)
      AND NOT EXISTS (SELECT 1 FROM job WHERE job.k = person.k AND is_current
                      AND lower(job.title) = lower(person.title))
  UNION ALL SELECT k, 'DATE_PARADOX' FROM person WHERE signup > active
  UNION ALL SELECT k, 'GHOST_PROFILE' FROM person
    WHERE views = 0 AND searches = 0 AND saves = 0 AND applications > 5)"""


def hits_sql(table: str, severity: str = "severity") -> str:
    return (f"SELECT candidate_id, code, {severity} AS severity, count(*) AS n "
            f"FROM {table} JOIN base USING (k) GROUP BY ALL")


CHECKED = B.with_tables(B.VIEW, SCHEMA, CONSISTENCY, B.ANOMALIES)
FORENSICS = B.with_tables(B.VIEW, B.ANOMALIES, FORENSIC)

FLAT = f"""
flat AS (
  SELECT candidate_id, location, country, claimed AS years_of_experience, title AS current_title,
    'Co' || (c % 63) AS current_company, {B.pick(V.SIZES, 'k')} AS current_company_size,
    {B.pick(V.FIELDS, 'c')} AS current_industry, nj AS n_jobs, months AS total_career_months,
    implied AS implied_exp_years, coalesce(companies, '') AS companies_str,
    coalesce(n_companies, 0) AS unique_companies, k % 3 AS n_edu,
    coalesce(best, 'none') AS highest_tier, ns AS n_skills, n_expert AS n_expert_skills,
    n_advanced AS n_advanced_skills, skill_names AS skills_str, k % 2 AS n_certs, 0 AS n_langs,
    completeness AS profile_completeness, open_to_work, views AS profile_views_30d,
    applications AS applications_30d, searches AS search_appearance_30d,
    saves AS saved_by_recruiters_30d, response AS recruiter_response_rate,
    response_hours AS avg_response_time_hours, connections AS connection_count,
    endorsed AS endorsements_received, raw_notice AS notice_period_days,
    work_mode AS preferred_work_mode, relocate AS willing_to_relocate,
    github AS github_activity_score, interview AS interview_completion_rate,
    offer AS offer_acceptance_rate, email AS verified_email, phone AS verified_phone,
    linkedin AS linkedin_connected, smin AS salary_min, smax AS salary_max,
    coalesce(n_assess, 0) AS n_assessments, avg_assess AS avg_assessment_score,
    signup AS signup_date, active AS last_active_date, n_profile_core AS n_ai_skills,
    date_diff('day', active, DATE '2026-06-23') AS days_since_active,
    date_diff('day', signup, DATE '2026-06-23') AS days_since_signup,
    claimed - implied AS exp_discrepancy
  FROM person
  LEFT JOIN (SELECT k, string_agg(company, '|' ORDER BY i) AS companies,
                    count(DISTINCT company) AS n_companies FROM job GROUP BY k) USING (k)
  LEFT JOIN (SELECT k, string_agg(name, '|' ORDER BY j) AS skill_names,
               count(*) FILTER (proficiency = 'expert') AS n_expert,
               count(*) FILTER (proficiency = 'advanced') AS n_advanced,
               count(DISTINCT name) FILTER ({B.among('name', S.PROFILE_CORE_SKILLS)})
                 AS n_profile_core
             FROM skill GROUP BY k) USING (k)
  LEFT JOIN (SELECT k, arg_min(tier, (coalesce(list_position({B.listed(S.EDUCATION_TIERS)},
                                                             tier), 5), j)) AS best
             FROM edu GROUP BY k) USING (k)
  LEFT JOIN (SELECT k, count(*) AS n_assess, avg(score) AS avg_assess FROM assess GROUP BY k)
    USING (k))"""
ON_FLAT = B.with_tables(B.VIEW, FLAT)

_FLAT_DOUBLES = ("years_of_experience", "implied_exp_years", "profile_completeness",
                 "recruiter_response_rate", "avg_response_time_hours", "github_activity_score",
                 "interview_completion_rate", "offer_acceptance_rate", "salary_min",
                 "salary_max", "avg_assessment_score", "exp_discrepancy")
_FLAT_BIGINTS = ("n_jobs", "total_career_months", "unique_companies", "n_edu", "n_skills",
                 "n_expert_skills", "n_advanced_skills", "n_certs", "n_langs",
                 "profile_views_30d", "applications_30d", "search_appearance_30d",
                 "saved_by_recruiters_30d", "connection_count", "endorsements_received",
                 "notice_period_days", "n_assessments", "n_ai_skills", "days_since_active",
                 "days_since_signup")
_FLAT_OTHERS = ("candidate_id", "location", "country", "current_title", "current_company",
                "current_company_size", "current_industry", "companies_str", "highest_tier",
                "skills_str", "open_to_work", "preferred_work_mode", "willing_to_relocate",
                "verified_email", "verified_phone", "linkedin_connected", "signup_date",
                "last_active_date")


def archetype_sql(title: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {B.any_sql(f'lower({title})', words)} THEN {B.quoted(name)}"
        for words, name in S.ARCHETYPES) + f" ELSE {B.quoted(S.ARCHETYPE_DEFAULT)} END"


TOOLS = "list_filter([" + ", ".join(
    f"CASE WHEN contains(txt, {B.quoted(k)}) OR list_contains(names, {B.quoted(k)}) "
    f"THEN {B.quoted(v)} END" for k, v in S.DISPLAY_TOOLS.items()) \
    + "], lambda x: x IS NOT NULL)[1:3]"
GROUPS = "list_filter([" + ", ".join(
    f"CASE WHEN g_{g} THEN {B.quoted(g.replace('_', ' ').title())} END"
    for g in S.CAPABILITY_GROUPS) + "], lambda x: x IS NOT NULL)"

EXPLAINED = f"""
tooled AS (SELECT *, {TOOLS} AS tools, {GROUPS} AS grps FROM scored),
lines AS (
  SELECT *, 'Designed '
    || CASE WHEN ev_retrieval > 0 OR ev_search > 0 THEN
         CASE WHEN list_has_any(tools, ['FAISS', 'Pinecone', 'Weaviate']) THEN 'dense retrieval'
              WHEN list_has_any(tools, ['BM25', 'Elasticsearch']) THEN 'hybrid retrieval'
              ELSE 'retrieval systems' END
       WHEN ev_ranking > 0 THEN 'LTR ranking'
       WHEN ev_recommendation > 0 THEN 'recommendation systems'
       WHEN ev_nlp > 0 THEN 'NLP & LLM engineering' ELSE 'applied ML engineering' END
    || CASE WHEN len(tools) > 0 THEN ' using ' || array_to_string(tools, ', ') ELSE '' END
    || '. ' || printf('%.1f', implied) || ' yrs YOE, '
    || CASE WHEN production >= 0.75 THEN 'prod scaling & MLOps'
            WHEN production >= 0.5 THEN 'model deployment'
            WHEN production >= 0.25 THEN 'production ownership' ELSE 'applied ML' END
    || '. ' || confidence || '.'
    || CASE WHEN trust < 1 THEN ' Additional verification recommended.'
            WHEN notice >= 60 THEN ' ' || notice || '-day notice period.'
            WHEN verification < 0.4 THEN ' Limited verification signals.' ELSE '' END AS line
  FROM tooled),
explained AS (
  SELECT *, CASE WHEN length(line) > 180 THEN substr(line, 1, 177) || '...' ELSE line END
              AS reasoning,
    CASE WHEN len(grps) > 0 THEN array_to_string(grps[1:3], ', ') ELSE 'General ML' END
      AS strengths,
    coalesce(nullif(concat_ws(', ', CASE WHEN trust < 1 THEN 'Trust audit recommended' END,
      CASE WHEN notice > 60 THEN notice || 'd notice' END,
      CASE WHEN verification < 0.5 THEN 'Few verifications' END), ''), 'None') AS weaknesses,
    coalesce(nullif(concat_ws(' & ', CASE WHEN domain >= 0.5 THEN 'High domain alignment' END,
      CASE WHEN capability >= 0.6 THEN 'Broad skill coverage' END,
      CASE WHEN production >= 0.5 THEN 'Production ML maturity' END), ''),
      'Balanced score profile') AS why_ranked
  FROM lines),
ranked AS (SELECT *, row_number() OVER (ORDER BY published DESC, candidate_id) AS rank
           FROM explained),
by_final AS (SELECT *, row_number() OVER (ORDER BY final DESC, candidate_id) AS final_rank,
               row_number() OVER (ORDER BY raw DESC, candidate_id) AS raw_rank FROM explained)"""
ON_RANKED = B.with_tables(B.VIEW, B.ANOMALIES, B.FEATURES, B.SCORES, EXPLAINED)

COMPONENT_COLUMNS = {"domain": "domain", "experience": "experience", "skill": "skills",
                     "education": "education", "behavioral": "engagement",
                     "verification": "verification", "availability": "availability"}


def weighted_sql(weights: S.ScoreWeights) -> str:
    return "(" + " + ".join(f"{column} * {D(getattr(weights, name))}"
                            for name, column in COMPONENT_COLUMNS.items()) + ") * trust"


SCENARIOS = "scen AS (" + " UNION ALL ".join(
    f"SELECT candidate_id, '{n}' AS scenario, {weighted_sql(w)} AS score FROM scored"
    for n, w in S.SCENARIOS.items()) + """),
scen_rank AS (SELECT *, row_number() OVER (PARTITION BY scenario
                ORDER BY score DESC, candidate_id) AS rk FROM scen)"""

_ABLATED = {"baseline": S.ScoreWeights(),
            **{f"no_{c}": S.ScoreWeights().without(c) for c in COMPONENT_COLUMNS}}
ABLATION = "scen AS (" + " UNION ALL ".join(
    f"SELECT candidate_id, '{n}' AS scenario, {weighted_sql(w)} AS score FROM scored"
    for n, w in _ABLATED.items()) + """),
scen_rank AS (SELECT *, row_number() OVER (PARTITION BY scenario
                ORDER BY score DESC, candidate_id) AS rk FROM scen)"""


def keyword_rows(groups) -> str:
    return "(VALUES " + ", ".join(f"({B.quoted(g)}, {B.quoted(w)})"
                                  for g, words in groups.items() for w in words) \
        + ") AS kw(domain, word)"


def snippet_sql(text: str, word: str, window: int) -> str:
    at = f"strpos(lower({text}), lower({word}))"
    first = f"greatest(1, {at} - {window})"
    last = f"least(length({text}), {at} + length({word}) - 1 + {window})"
    return (f"CASE WHEN {at} = 0 THEN '' ELSE CASE WHEN {first} > 1 THEN '...' ELSE '' END || "
            f"trim(replace(substr({text}, {first}, {last} - {first} + 1), chr(10), ' '), "
            f"' ' || chr(9) || chr(10) || chr(13) || chr(160)) || "
            f"CASE WHEN {last} < length({text}) THEN '...' ELSE '' END END")


AUDITED = f"""
record_text AS (
  SELECT k, candidate_id, final_rank, 0 AS part, 'headline' AS source, headline AS text
    FROM by_final WHERE final_rank <= 50
  UNION ALL SELECT k, candidate_id, final_rank, 1, 'summary', summary FROM by_final
    WHERE final_rank <= 50
  UNION ALL SELECT k, candidate_id, final_rank, 2, 'current_title', title FROM by_final
    WHERE final_rank <= 50
  UNION ALL SELECT k, candidate_id, final_rank, 3 + 2 * i, 'job_title', job.title
    FROM by_final JOIN job USING (k) WHERE final_rank <= 50
  UNION ALL SELECT k, candidate_id, final_rank, 4 + 2 * i, 'job_description', description
    FROM by_final JOIN job USING (k) WHERE final_rank <= 50),
hit AS (
  SELECT candidate_id, final_rank, domain, word, source,
         {snippet_sql('text', 'word', 40)} AS snip
  FROM record_text, {keyword_rows({d: S.EVIDENCE_KEYWORDS[d] for d in (
      'retrieval', 'ranking', 'recommendation', 'search', 'evaluation', 'production_ml')})}
  WHERE contains(lower(text), word))"""

SUBMISSION = """
sub AS (
  SELECT o_orderkey + 2 AS row_num, o_orderkey % 229 = 8 AS short,
    CASE WHEN o_orderkey % 211 = 1 THEN '' WHEN o_orderkey % 211 = 2 THEN 'X1'
         ELSE 'CAND_' || lpad(CAST(o_orderkey + CASE WHEN o_orderkey % 211 = 3 THEN 1 ELSE 0 END
                                   AS VARCHAR), 7, '0') END AS id,
    CASE WHEN o_orderkey % 223 IN (4, 5) THEN NULL
         WHEN o_orderkey % 223 = 6 THEN o_orderkey ELSE o_orderkey + 1 END AS rank,
    CASE WHEN o_orderkey % 227 = 7 THEN NULL
         ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS score
  FROM orders),
okay AS (SELECT * FROM sub WHERE NOT short),
ids AS (SELECT row_num, id, row_number() OVER (PARTITION BY id ORDER BY row_num) AS rn FROM okay
        WHERE id LIKE 'CAND%'),
rks AS (SELECT row_num, rank, row_number() OVER (PARTITION BY rank ORDER BY row_num) AS rn
        FROM okay WHERE rank BETWEEN 1 AND 150),
steps AS (
  SELECT rank, score, id, lead(score) OVER w AS next_score, lead(id) OVER w AS next_id
  FROM okay WHERE rank IS NOT NULL AND score IS NOT NULL AND id <> ''
  WINDOW w AS (ORDER BY rank, row_num))
"""


def quantile_sql(column: str, p: float) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), {p})"


def describe_sql(table: str, column: str) -> str:
    return (f"SELECT '{column}' AS field, count({column}) AS count, {r6(f'avg({column})', 'mean')}, "
            f"{r6(f'stddev_samp({column})', 'std')}, {r6(f'min({column})', 'min')}, "
            f"{r6(quantile_sql(column, .25), 'q25')}, {r6(quantile_sql(column, .5), 'q50')}, "
            f"{r6(quantile_sql(column, .75), 'q75')}, {r6(f'max({column})', 'max')} FROM {table}")


def corr_sql(table: str, a: str, b: str) -> str:
    return (f"SELECT '{a}' AS field_a, '{b}' AS field_b, "
            f"round(corr({a}, {b}), 6) AS corr FROM {table}")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_ITEMS = ("WITH it AS (SELECT " + ", ".join(
    f"nullif(CASE WHEN l_partkey % 7 = 0 THEN -1.0 ELSE {c} END, -1) AS {c}"
    if c == "l_discount" else f"nullif({c}, -1) AS {c}" for c in _CORR) + " FROM lineitem) ")


def _corr_profile() -> str:
    columns = P.CORRELATED
    fixed = ", ".join(f"nullif(CAST({c} AS DOUBLE), -1) AS {c}" for c in columns)
    pairs = [(b, a) for i, a in enumerate(columns) for b in columns[i + 1:]]
    value = lambda a, b: (f"CASE WHEN isfinite(corr({a}, {b})) "
                          f"THEN round(corr({a}, {b}), 6) END")
    cells = ", ".join(f"{{'field_a': '{a}', 'field_b': '{b}', 'corr': {value(a, b)}}}"
                      for a, b in pairs)
    return (B.with_tables(B.VIEW, FLAT, f"num AS (SELECT {fixed} FROM flat)",
                          f"one AS (SELECT [{cells}] AS cells FROM num)")
            + "SELECT c.field_a, c.field_b, c.corr FROM (SELECT unnest(cells) AS c FROM one)")


_GROUP_COLUMNS = ", ".join(
    f"{B.any_sql('low', words)} AS {kind}_{name}"
    for kind, groups in GROUP_WORDS.items() for name, words in groups.items()) + ", " + ", ".join(
    f"round({B.share_sql(B.any_sql('low', w) for w in groups.values())}, 6) AS {kind}_share"
    for kind, groups in GROUP_WORDS.items())

_DAMAGE = """dmg AS (SELECT k, CASE k % 97 WHEN 6 THEN 'bad_json' WHEN 7 THEN 'missing_id'
  WHEN 8 THEN 'bad_value' END AS why FROM base)"""

_BANDS = ("CASE WHEN final > 0.9 THEN '>0.9' WHEN final > 0.7 THEN '0.7-0.9' "
          "WHEN final > 0.5 THEN '0.5-0.7' WHEN final > 0.3 THEN '0.3-0.5' ELSE '<0.3' END")

_INT_FEATURES = {
    "total_skill_count": "ns", "ai_skill_count": "n_core", "expert_skill_count": "n_expert",
    "advanced_skill_count": "n_advanced", "intermediate_skill_count": "n_intermediate",
    "beginner_skill_count": "n_beginner"}

_CUSTOM = B.with_tables(B.VIEW, B.ANOMALIES, B.FEATURES, B.SCORES, """
cust AS (
  SELECT *, (least(1, ev_ranking / 3) + least(1, ev_search / 3) + least(1, ev_nlp / 3)) / 3 AS dom,
    CASE WHEN implied < 2 THEN 0 WHEN implied BETWEEN 4 AND 6 THEN 1
         WHEN implied < 4 THEN greatest(0, 1 - (4 - implied) * CAST(0.2 AS DOUBLE))
         ELSE greatest(0.5, 1 - (implied - 6) * CAST(0.05 AS DOUBLE)) END AS e0 FROM scored),
cust2 AS (SELECT *, CASE WHEN quality = 0 AND production = 0 THEN e0
    ELSE CAST(0.5 AS DOUBLE) * e0 + CAST(0.3 AS DOUBLE) * quality
         + CAST(0.2 AS DOUBLE) * production END AS ex FROM cust)""")

# Records of which every tenth arrives again with two changed signals.
_UPDATED = B.ON_SCORES.replace(
    "k % 3 = 1 AS open_to_work", "k % 3 = 1 AND k % 10 <> 3 AS open_to_work").replace(
    "CAST(k % 101 AS DOUBLE) / 100 + CASE WHEN k % 401 = 3 THEN 1 ELSE 0 END AS response",
    "CASE WHEN k % 10 = 3 THEN 0 ELSE CAST(k % 101 AS DOUBLE) / 100 "
    "+ CASE WHEN k % 401 = 3 THEN 1 ELSE 0 END END AS response")
_PRICES = """WITH p AS (SELECT CASE WHEN o_orderkey % 7 <> 3 AND o_orderkey % 11 <> 5
  THEN CAST(o_totalprice AS DOUBLE) END AS price FROM orders) """

ORACLE: dict[str, str] = {
    "normalize_jsonl": B.with_tables(B.VIEW, B.ANOMALIES, B.FEATURES) + f"""
      SELECT candidate_id, title, headline, {big('months', 'months')}, {r6('implied', 'implied')},
        {r6('round(claimed - implied, 2)', 'gap')}, {big('ns', 'n_skills')},
        {big('nj', 'n_jobs')}, cur.company AS current_company, best AS tier,
        coalesce(smax < smin, false) AS salary_inverted,
        {r6('CASE WHEN smax >= smin THEN (smin + smax) / 2 ELSE smin END', 'salary_midpoint')},
        github >= 0 AS has_github, offer >= 0 AS has_offer_history,
        {big('feat.n_assess', 'n_assessments')}, {r6('a.avg_assess', 'avg_assessment')},
        {big('notice', 'notice')}, {big('coalesce(study, 0)', 'study_years')},
        {big('k % 2', 'n_certs')}
      FROM feat LEFT JOIN (SELECT k, arg_min(company, i) AS company FROM job WHERE is_current
                           GROUP BY k) cur USING (k)
      LEFT JOIN assess_sum a USING (k)
      LEFT JOIN (SELECT k, sum(e - s) AS study FROM edu GROUP BY k) USING (k)""",
    "json_props_parse": """
      SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k_or_zero FROM events""",
    "quarantine_counts": B.with_tables(B.VIEW, _DAMAGE) + """
      SELECT why AS reject_reason, count(*) AS n FROM dmg WHERE why IS NOT NULL GROUP BY 1""",
    "load_stats": B.with_tables(B.VIEW, _DAMAGE) + """
      SELECT count(*) AS total_lines, count(*) FILTER (why IS NULL) AS parsed_ok,
        count(*) FILTER (why = 'bad_json') AS parse_errors,
        count(*) FILTER (why = 'missing_id') AS missing_id,
        count(*) FILTER (why = 'bad_value') AS bad_value FROM dmg""",
    "key_presence": B.with_tables(B.VIEW, _DAMAGE) + f"""
      , t AS (SELECT count(*) AS total, count(*) FILTER (why IS DISTINCT FROM 'bad_json') AS valid,
                count(*) FILTER (coalesce(why, '') NOT IN ('bad_json', 'missing_id')) AS idd
              FROM dmg)
      SELECT field, n_present, {r6('n_present * 100.0 / total', 'pct_present')} FROM (
        SELECT total, unnest(['candidate_id', 'profile', 'skills', 'unknown_key']) AS field,
          unnest([idd, valid, valid, 0]) AS n_present FROM t)""",
    "sample_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "load_chunks": """
      SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
      FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 500
              AS chunk FROM orders) GROUP BY chunk""",
    "flatten_profile": ON_FLAT + "SELECT " + ", ".join(
        [r6(c, c) for c in _FLAT_DOUBLES] + [big(c, c) for c in _FLAT_BIGINTS]
        + list(_FLAT_OTHERS)) + " FROM flat",
    "rules_schema": CHECKED + hits_sql("schema_hit"),
    "rules_consistency": CHECKED + hits_sql("consistency_hit"),
    "rules_anomaly": B.ON_FLAGS + hits_sql("anomaly", "'flag'"),
    "rules_forensic": FORENSICS + hits_sql("forensic_hit", "'flag'"),
    "validation": CHECKED + f"""
      , issues AS (SELECT k, severity FROM schema_hit
                   UNION ALL SELECT k, severity FROM consistency_hit),
      n AS (SELECT base.k, count(*) FILTER (severity = 'error') AS n_errors,
              count(*) FILTER (severity = 'warning') AS n_warnings
            FROM base LEFT JOIN issues USING (k) GROUP BY base.k)
      SELECT candidate_id, n_errors, n_warnings, n_flags, n_errors = 0 AS is_valid,
        n_errors + n_warnings + n_flags = 0 AS is_clean, {r6('trust', 'trust_score')}
      FROM base JOIN n USING (k) JOIN flags USING (k)""",
    "trust_score": B.ON_FLAGS + f"""
      SELECT candidate_id, n_flags, {r6('trust', 'trust_score')} FROM base JOIN flags USING (k)""",
    "trust_bands": B.ON_FLAGS + """
      SELECT count(*) FILTER (trust = 1) AS "full", count(*) FILTER (trust < 1) AS reduced,
        count(*) FILTER (trust <= 0.25) AS "floor" FROM flags""",
    "job_overlap_array": B.with_tables(B.VIEW) + f"""
      SELECT candidate_id, company AS first_company, next_company AS second_company,
        {r6("date_diff('day', nxt, e) / CAST(30 AS DOUBLE)", 'months')}
      FROM (SELECT k, e, company, lead(s) OVER w AS nxt, lead(company) OVER w AS next_company
            FROM job WHERE e IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY s, i))
        JOIN base USING (k)
      WHERE nxt < e AND date_diff('day', nxt, e) > 90""",
    "interval_overlap_window": """
      SELECT o_custkey, o_orderkey, next_key AS next_o_orderkey,
        date_diff('day', next_begin, finish) AS overlap
      FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE)
              + CAST(o_orderkey % 91 AS INTEGER) AS finish,
              lead(CAST(o_orderdate AS DATE)) OVER w AS next_begin,
              lead(o_orderkey) OVER w AS next_key FROM orders
            WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey))
      WHERE next_begin < finish AND date_diff('day', next_begin, finish) > 10""",
    "education_overlap_window": B.ON_VIEW + """
      SELECT candidate_id, count(*) AS n_overlaps
      FROM (SELECT k, e, lead(s) OVER (PARTITION BY k ORDER BY s NULLS LAST, j) AS nxt FROM edu)
        JOIN base USING (k) WHERE nxt < e GROUP BY 1""",
    "gap_to_next": f"""
      SELECT event_id, user_id,
        {r6("date_diff('microsecond', ts, nxt) / CAST(1000000 AS DOUBLE)", 'gap')}
      FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id
                                                         ORDER BY ts, event_id) AS nxt
            FROM events)""",
    "keyword_evidence": "WITH l AS (SELECT doc_id, lower(text) AS low FROM documents) "
        "SELECT doc_id, " + ", ".join(
            big(" + ".join(B.count_sql("low", w) for w in words), f"n_{g}") + ", "
            + r6(B.evidence_sql("low", words), f"evidence_{g}")
            for g, words in DOCUMENT_WORDS.items()) + " FROM l",
    "career_evidence": B.ON_FEATURES + "SELECT candidate_id, " + ", ".join(
        r6(f"ev_{n}", f"evidence_{n}") for n in S.EVIDENCE_KEYWORDS) + " FROM feat",
    "keyword_groups": "WITH l AS (SELECT doc_id, lower(text) AS low FROM documents) "
        f"SELECT doc_id, {_GROUP_COLUMNS} FROM l",
    "keyword_groups_conversations":
        "WITH l AS (SELECT conv_id, turn, lower(text) AS low FROM conversations) "
        f"SELECT conv_id, turn, {_GROUP_COLUMNS} FROM l",
    "skill_weights": B.with_tables(B.VIEW, B.ANOMALIES, B.FEATURES, f"""
      dist AS (SELECT k, count(DISTINCT name) FILTER ({B.among('name', S.PROFILE_CORE_SKILLS)})
                 AS n FROM skill GROUP BY k)""") + "SELECT candidate_id, " + ", ".join(
        big(v, n) for n, v in _INT_FEATURES.items()) + f""",
        {r6('prof', 'proficiency_weighted_skill_score')},
        {r6('endo', 'endorsement_weighted_skill_score')}, dist.n AS distinct_core
      FROM feat JOIN dist USING (k)""",
    "skill_taxonomy_join": B.ON_VIEW + f"""
      SELECT name, count(*) AS n, {big('sum(endorsements)', 'endorsements')}
      FROM skill WHERE {B.among('name', S.CORE_SKILLS)} GROUP BY name""",
    "anti_membership": B.ON_VIEW + f"""
      SELECT candidate_id, {big('j', 'pos')}, name FROM skill JOIN base USING (k)
      WHERE proficiency = 'expert' AND endorsements < 1
        AND (k, name) NOT IN (SELECT (k, name) FROM assess)""",
    "lookup_default": B.ON_VIEW + f"""
      SELECT candidate_id, assess.name, {r6('any_value(score)', 'score')},
        {big('coalesce(arg_max(endorsements, j), 0)', 'endorsements')}
      FROM assess JOIN base USING (k) LEFT JOIN skill ON skill.k = assess.k
        AND skill.name = assess.name GROUP BY candidate_id, assess.name""",
    "experience_features": B.ON_FEATURES + f"""
      SELECT candidate_id, {r6('claimed', 'years_experience')},
        {r6('implied', 'implied_experience_years')},
        {r6('round(claimed - implied, 2)', 'experience_gap')}, {big('nj', 'total_jobs')},
        {r6('CASE WHEN nj = 0 THEN 0 ELSE months / CAST(nj AS DOUBLE) END',
            'avg_job_duration_months')},
        {big('coalesce(mx, 0)', 'max_job_duration_months')},
        {big('coalesce(mn, 0)', 'min_job_duration_months')}
      FROM feat LEFT JOIN (SELECT k, max(dur) AS mx, min(dur) AS mn FROM job GROUP BY k)
        USING (k)""",
    "education_features": B.ON_FEATURES + f"""
      SELECT candidate_id, {big('n_edu', 'education_count')}, best AS highest_education_tier,
        {', '.join(big(f't{i}', f'tier{i}_count') for i in (1, 2, 3, 4))},
        {big('CAST(cs AS INTEGER)', 'cs_degree_flag')},
        {big('CAST(ai AS INTEGER)', 'ai_degree_flag')} FROM feat""",
    "signal_features": B.ON_FEATURES.rstrip() + """,
      kinds AS (SELECT k, """ + ", ".join(
        f"bool_or(code LIKE 'HP-0{i}%') AS f{i}" for i in range(1, 6)) + f"""
        FROM anomaly GROUP BY k)
      SELECT candidate_id, {r6('response', 'recruiter_response_rate')},
        {r6('interview', 'interview_completion_rate')}, {r6('offer', 'offer_acceptance_rate')},
        {big('views', 'profile_views_30d')}, {big('applications', 'applications_30d')},
        {big('searches', 'search_appearance_30d')}, {big('saves', 'saved_by_recruiters_30d')},
        {big('endorsed', 'endorsements_received')},
        {big('CAST(open_to_work AS INTEGER)', 'open_to_work_flag')},
        {big('CAST(relocate AS INTEGER)', 'willing_to_relocate')},
        {r6('engagement', 'engagement_score')},
        {big('CAST(email AS INTEGER)', 'verified_email')},
        {big('CAST(phone AS INTEGER)', 'verified_phone')},
        {big('CAST(linkedin AS INTEGER)', 'linkedin_connected')},
        {big('CAST(github >= 0 AS INTEGER)', 'github_available')},
        {r6('greatest(github, 0)', 'github_activity_score')},
        {big('n_assess', 'assessment_count')}, {r6('avg_assess', 'avg_assessment_score')},
        {r6('verification', 'verification_score')}, {big('notice', 'notice_period_days')},
        {r6('availability', 'availability_score')}, {r6('trust', 'trust_score')},
        {big('n_flags', 'honeypot_flag_count')},
        {', '.join(big(f'CAST(coalesce(f{i}, false) AS INTEGER)', n) for i, n in enumerate((
            'salary_inverted_flag', 'skill_duration_overflow_flag', 'date_paradox_flag',
            'inflated_experience_flag', 'unendorsed_expert_flag'), start=1))}
      FROM feat LEFT JOIN kinds USING (k)""",
    "composite_features": B.ON_SCORES + f"""
      SELECT candidate_id, {r6('capability', 'capability_score')},
        {r6('stages', 'pipeline_score')}, {r6('production', 'production_score')},
        {r6('quality', 'experience_quality_score')}, confidence AS confidence_category
      FROM scored""",
    "component_scores": B.ON_SCORES + "SELECT candidate_id, " + ", ".join(
        r6(c, f"{n}_score") for n, c in COMPONENT_COLUMNS.items()) + " FROM scored",
    "weighted_score": B.ON_SCORES + f"""
      SELECT candidate_id, {r6('raw', 'raw_score')}, {r6('trust', 'trust_score')},
        {r6('final', 'final_score')} FROM scored""",
    "prefiltered_score": B.ON_SCORES + f"""
      SELECT candidate_id, {r6('final', 'final_score')} FROM scored WHERE claimed >= 3""",
    "custom_job_score": _CUSTOM + f"""
      SELECT candidate_id, {r6('dom', 'domain_score')}, {r6('ex', 'experience_score')},
        {r6('''(dom * CAST(0.30 AS DOUBLE) + ex * CAST(0.15 AS DOUBLE)
          + skills * CAST(0.25 AS DOUBLE) + education * CAST(0.05 AS DOUBLE)
          + engagement * CAST(0.10 AS DOUBLE) + verification * CAST(0.10 AS DOUBLE)
          + availability * CAST(0.05 AS DOUBLE)) * trust''', 'final_score')} FROM cust2""",
    "alternative_scores": B.ON_VIEW + f"""
      SELECT candidate_id, {r6('boosted', 'boosted_skill_score')},
        {r6('''greatest(0.3, 1 - CAST(0.15 AS DOUBLE) * (
          CASE WHEN smax < smin THEN 1 ELSE 0 END
          + CASE WHEN claimed > months / CAST(12 AS DOUBLE) + 3 THEN 2 ELSE 0 END
          + n_long * CAST(0.5 AS DOUBLE)))''', 'fractional_trust')},
        {r6('''CAST(0.35 AS DOUBLE) * response + CAST(0.30 AS DOUBLE) * interview
          + CAST(0.15 AS DOUBLE) * greatest(0, offer)
          + CAST(0.20 AS DOUBLE) * greatest(0, github) / 100''', 'weighted_behavior')},
        {r6('''CASE WHEN open_to_work THEN 1 ELSE 0.5 END * CASE WHEN relocate THEN 1.1 ELSE 1 END
          * (0.5 + 0.5 * greatest(0, 1 - notice / CAST(180 AS DOUBLE)))''',
            'relocation_availability')}
      FROM person JOIN (
        SELECT skill.k, coalesce(sum({B._WEIGHT} * (CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE)
            * least(1, endorsements / CAST(10 AS DOUBLE))))
            FILTER ({B.among('name', S.CORE_SKILLS)}), 0) AS boosted,
          count(*) FILTER (dur > months + 12) AS n_long
        FROM skill JOIN career USING (k) GROUP BY skill.k) USING (k)""",
    "topk_ranked": B.ON_SCORES + """
      SELECT candidate_id, row_number() OVER (ORDER BY published DESC, candidate_id) AS rank,
        published AS score FROM scored ORDER BY rank LIMIT 100""",
    "topk_orders": """
      SELECT o_orderkey, o_totalprice,
        row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
      FROM orders ORDER BY rank LIMIT 100""",
    "topk_raw": B.ON_SCORES + f"""
      SELECT candidate_id, {r6('raw', 'raw_score')} FROM scored
      ORDER BY raw DESC, candidate_id LIMIT 100""",
    "topk_final": B.ON_SCORES + f"""
      SELECT candidate_id, {r6('final', 'final_score')} FROM scored
      ORDER BY final DESC, candidate_id LIMIT 50""",
    "rank_all": """
      SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
      FROM orders""",
    "rank_all_scored": B.ON_SCORES + """
      SELECT candidate_id, row_number() OVER (ORDER BY published DESC, candidate_id) AS rank
      FROM scored""",
    "reasoning": ON_RANKED + """
      SELECT candidate_id, rank, published AS score, reasoning FROM ranked WHERE rank <= 100""",
    "preview": ON_RANKED + """
      SELECT candidate_id, rank, published AS score, reasoning FROM ranked WHERE rank <= 25""",
    "audit_rows": ON_RANKED + f"""
      SELECT rank, candidate_id, title, {r6('final', 'score')}, {r6('trust', 'trust_score')},
        {r6('implied', 'experience')}, {big('n_core', 'ai_skills')},
        strengths AS technical_strengths, weaknesses, why_ranked,
        CAST(printf('%.1f', domain * 100) AS DOUBLE) AS jd_match_pct,
        len(grps) || '/10' AS capability_coverage, confidence
      FROM ranked WHERE rank <= 100""",
    "component_audit": ON_RANKED + f"""
      SELECT candidate_id, title AS current_title, {r6('claimed', 'years_experience')},
        {big('n_core', 'ai_skill_count')}, {', '.join(r6(c, f'{n}_score')
            for n, c in COMPONENT_COLUMNS.items())}, {r6('trust', 'trust_score')},
        {r6('final', 'final_score')} FROM by_final WHERE final_rank <= 100""",
    "example_lines": ON_RANKED + """
      SELECT rank, candidate_id, title, printf('%.3f', final) AS score,
        length(reasoning) AS n_chars FROM ranked WHERE rank <= 20""",
    "reasoning_all": ON_RANKED + """
      SELECT candidate_id, reasoning, strengths, weaknesses, why_ranked,
        length(reasoning) AS n_chars FROM explained""",
    "archetypes": B.ON_SCORES + f"""
      SELECT {archetype_sql('title')} AS archetype, count(*) AS n, {r6('avg(final)', 'avg_score')},
        {r6('avg(domain)', 'avg_domain')}, {r6('avg(skills)', 'avg_skill')}
      FROM scored GROUP BY 1""",
    "archetypes_top": ON_RANKED + f"""
      SELECT {archetype_sql('title')} AS archetype, count(*) AS n FROM ranked
      WHERE rank <= 100 GROUP BY 1""",
    "snippets": f"""
      SELECT doc_id, {snippet_sql('text', "'the'", 40)} AS the,
        {snippet_sql('text', "'ING'", 10)} AS ing,
        CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short
      FROM documents""",
    "keyword_hits": f"""
      SELECT doc_id, domain, word AS matched_keyword, {snippet_sql('text', 'word', 20)}
        AS source_text_snippet
      FROM documents, {keyword_rows(DOCUMENT_WORDS)} WHERE contains(lower(text), word)""",
    "evidence_audit": ON_RANKED.rstrip() + "," + AUDITED + """
      SELECT candidate_id, final_rank AS rank, domain, word AS matched_keyword, source,
        snip AS source_text_snippet FROM hit""",
    "deep_audit": ON_RANKED.rstrip() + "," + AUDITED + f"""
      SELECT final_rank AS rank, candidate_id, title, headline,
        CASE WHEN length(summary) > 200 THEN substr(summary, 1, 200) || '...' ELSE summary END
          AS summary_text, coalesce(snips, '') AS top_career_snippets, {r6('final', 'final_score')}
      FROM by_final LEFT JOIN (
        SELECT candidate_id, array_to_string(list_sort(list(DISTINCT snip))[1:5], ' || ') AS snips
        FROM hit GROUP BY 1) USING (candidate_id) WHERE final_rank <= 100""",
    "output_checks": "WITH " + SUBMISSION + """
      SELECT 'row_count' AS "check", CAST(NULL AS BIGINT) AS place FROM sub
        HAVING count(*) <> 150
      UNION ALL SELECT 'cells', row_num FROM sub WHERE short
      UNION ALL SELECT 'id_required', row_num FROM okay WHERE id = ''
      UNION ALL SELECT 'id_format', row_num FROM okay
        WHERE id <> '' AND NOT regexp_full_match(id, 'CAND_[0-9]{7}')
      UNION ALL SELECT 'id_duplicate', row_num FROM ids WHERE rn > 1
      UNION ALL SELECT 'rank_integer', row_num FROM okay WHERE rank IS NULL
      UNION ALL SELECT 'rank_range', row_num FROM okay WHERE rank NOT BETWEEN 1 AND 150
      UNION ALL SELECT 'rank_duplicate', row_num FROM rks WHERE rn > 1
      UNION ALL SELECT 'score_number', row_num FROM okay WHERE score IS NULL
      UNION ALL SELECT 'rank_missing', r FROM range(1, 151) t(r)
        WHERE r NOT IN (SELECT rank FROM rks)
      UNION ALL SELECT 'score_order', rank FROM steps WHERE score < next_score
      UNION ALL SELECT 'tie_order', rank FROM steps WHERE score = next_score AND id > next_id""",
    "output_check_table": ON_RANKED + """
      , listed AS (
        SELECT rank, CASE WHEN rank IN (5, 6) THEN 'CAND_X' ELSE candidate_id END AS id,
          CASE WHEN rank = 3 THEN 0 WHEN rank = 9 THEN NULL ELSE published END AS score,
          CASE WHEN rank = 7 THEN '' ELSE reasoning END AS txt2
        FROM ranked WHERE rank <= 100 AND rank <> 50),
      step AS (SELECT score, lead(score) OVER (ORDER BY rank) AS nxt FROM listed)
      SELECT 'row_count' AS "check" FROM listed HAVING count(*) <> 100
      UNION ALL SELECT 'duplicate_id' FROM listed HAVING count(DISTINCT id) <> count(*)
      UNION ALL SELECT 'ranks' FROM listed HAVING count(DISTINCT rank) <> 100
      UNION ALL SELECT 'empty_reasoning' FROM listed HAVING count(*) FILTER (txt2 = '') > 0
      UNION ALL SELECT 'nulls' FROM listed HAVING count(*) FILTER (score IS NULL) > 0
      UNION ALL SELECT 'score_order' FROM step HAVING count(*) FILTER (nxt > score) > 0""",
    "rank_sequence": """
      SELECT r AS rank FROM range(1, 101) t(r)
      WHERE r NOT IN (SELECT o_orderkey % 89 + 1 FROM orders)""",
    "weight_sensitivity": B.ON_SCORES.rstrip() + ", " + SCENARIOS + """
      SELECT o.scenario, CASE o.scenario WHEN 'B' THEN CAST(0.35 AS DOUBLE)
          ELSE CAST(0.40 AS DOUBLE) END AS domain_weight,
        CASE o.scenario WHEN 'B' THEN CAST(0.20 AS DOUBLE)
          ELSE CAST(0.15 AS DOUBLE) END AS skill_weight,
        count(*) FILTER (a.rk <= 20 AND o.rk <= 20) AS top_20_overlap,
        count(*) FILTER (a.rk <= 50 AND o.rk <= 50) AS top_50_overlap,
        count(*) FILTER (a.rk <= 100 AND o.rk <= 100) AS top_100_overlap
      FROM scen_rank a JOIN scen_rank o USING (candidate_id)
      WHERE a.scenario = 'A' AND o.scenario <> 'A' GROUP BY o.scenario""",
    "scenario_scores": B.ON_SCORES.rstrip() + ", " + SCENARIOS + f"""
      SELECT candidate_id, scenario, {r6('score', 'score')} FROM scen""",
    "ablation": B.ON_SCORES.rstrip() + ", " + ABLATION + """
      SELECT o.scenario, count(*) FILTER (a.rk <= 100 AND o.rk <= 100) AS kept
      FROM scen_rank a JOIN scen_rank o USING (candidate_id)
      WHERE a.scenario = 'baseline' AND o.scenario <> 'baseline' GROUP BY o.scenario""",
    "trust_fell_out": ON_RANKED + f"""
      SELECT candidate_id, {r6('raw', 'raw_score')}, {r6('final', 'final_score')},
        row_number() OVER (ORDER BY raw DESC, candidate_id) AS rank
      FROM by_final WHERE raw_rank <= 100 AND final_rank > 100
      ORDER BY raw DESC, candidate_id LIMIT 5""",
    "ndcg_at_k": f"""
      WITH j AS (SELECT source, quality,
          row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, documents.doc_id) AS r,
          row_number() OVER (PARTITION BY source ORDER BY quality DESC) AS ideal
        FROM documents JOIN labels USING (doc_id)),
      g AS (SELECT source, coalesce(sum(quality / log2(r + 1)) FILTER (r <= 10), 0) AS dcg,
              sum(quality / log2(ideal + 1)) FILTER (ideal <= 10) AS best FROM j GROUP BY source)
      SELECT source, {r6('dcg', 'dcg')}, {r6('CASE WHEN best > 0 THEN dcg / best ELSE 0 END',
                                             'ndcg')} FROM g""",
    "missing_values": """
      SELECT field, n_missing, round(n_missing * 100.0 / total, 2) AS pct_missing FROM (
        SELECT unnest(['quality', 'toxic']) AS field,
          unnest([count(*) FILTER (quality IS NULL), count(*) FILTER (toxic IS NULL)])
            AS n_missing, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id))
      WHERE n_missing > 0""",
    "missing_profile": ON_FLAT + """
      SELECT field, n_missing, round(n_missing * 100.0 / total, 2) AS pct_missing FROM (
        SELECT count(*) AS total,
          unnest(['salary_min', 'salary_max', 'avg_assessment_score']) AS field,
          unnest([count(*) FILTER (salary_min IS NULL), count(*) FILTER (salary_max IS NULL),
                  count(*) FILTER (avg_assessment_score IS NULL)]) AS n_missing FROM flat)
      WHERE n_missing > 0""",
    "duplicate_keys": f"""
      SELECT count(*) AS n_keys, {big('sum(n)', 'n_rows')} FROM (
        SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)""",
    "near_duplicates": f"""
      SELECT count(*) AS n_groups, {big('coalesce(sum(n), 0)', 'n_rows')} FROM (
        SELECT count(*) AS n FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1)""",
    "id_gaps": """
      SELECT min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(*) AS n_ids,
        max(o_orderkey) - min(o_orderkey) + 1 - count(*) AS n_gaps
      FROM orders WHERE o_orderkey % 13 <> 4""",
    "malformed_ids": B.ON_VIEW + """
      SELECT candidate_id FROM base WHERE NOT regexp_full_match(candidate_id, 'CAND_[0-9]{7}')""",
    "value_counts_topn": B.ON_VIEW + """
      SELECT name AS value, count(*) AS n FROM skill GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "value_counts_share": f"""
      SELECT o_orderpriority AS value, count(*) AS n,
        {r6('count(*) / sum(count(*)) OVER ()', 'share')} FROM orders GROUP BY 1""",
    "value_counts_domain": """
      SELECT value, count(c_custkey) AS n
      FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'NOWHERE', 'AUTOMOBILE']) AS value)
      LEFT JOIN customer ON c_mktsegment = value GROUP BY 1""",
    "skill_frequency": B.ON_VIEW + f"""
      SELECT name AS value, count(DISTINCT k) AS n FROM skill
      WHERE {B.among('name', S.PROFILE_CORE_SKILLS)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
    "histogram": f"""
      WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
      b AS (SELECT least(19, floor((l_quantity - lo) / ((hi - lo) / 20))) AS bin, count(*) AS n
            FROM lineitem, r GROUP BY 1)
      SELECT i AS bin, {r6('lo + i * ((hi - lo) / 20)', 'low')}, coalesce(n, 0) AS n
      FROM range(0, 20) t(i) CROSS JOIN r LEFT JOIN b ON b.bin = i""",
    "flag_histogram": B.ON_FLAGS + """
      SELECT n_flags AS flags, count(*) AS n FROM flags WHERE n_flags > 0 GROUP BY 1""",
    "describe": " UNION ALL ".join(describe_sql("lineitem", c) for c in (
        "l_quantity", "l_extendedprice", "l_discount")),
    "median_p99": " UNION ALL ".join(
        f"SELECT 'value' AS field, {r6(str(p), 'probability')}, "
        f"{r6(quantile_sql('value', p), 'value')} FROM events" for p in (0.5, 0.99)),
    "rates": B.ON_VIEW + "SELECT " + ", ".join(
        r6(f"avg(CAST({c} AS INTEGER))", n) for n, c in (
            ("open_to_work_flag", "open_to_work"), ("willing_to_relocate", "relocate"),
            ("verified_email", "email"), ("verified_phone", "phone"),
            ("linkedin_connected", "linkedin"), ("no_github", "github = -1"))) + " FROM person",
    "cond_mean": B.ON_VIEW + f"""
      SELECT {r6('avg(offer) FILTER (offer >= 0)', 'mean_offer_acceptance_rate')},
        count(*) FILTER (offer = -1) AS none_offer_acceptance_rate,
        {r6('avg(github) FILTER (github >= 0)', 'mean_github_activity_score')},
        count(*) FILTER (github = -1) AS none_github_activity_score FROM person""",
    "distinct_counts": """
      SELECT count(DISTINCT o_custkey) AS o_custkey,
        count(DISTINCT o_orderpriority) AS o_orderpriority,
        count(DISTINCT o_orderdate) AS o_orderdate FROM orders""",
    "corr_matrix": _ITEMS + " UNION ALL ".join(
        corr_sql("it", a, b) if a != b else
        f"SELECT '{a}' AS field_a, '{a}' AS field_b, CAST(1 AS DOUBLE) AS corr"
        for a in _CORR for b in _CORR),
    "corr_profile": _corr_profile(),
    "score_bands": B.ON_SCORES + f"SELECT {_BANDS} AS band, count(*) AS n FROM scored GROUP BY 1",
    "cohort_summary": ON_RANKED + f"""
      SELECT count(*) AS n, {r6('min(final)', 'min_score')}, {r6('max(final)', 'max_score')},
        {r6('avg(implied)', 'avg_experience')}, {r6('avg(n_core)', 'avg_ai_skills')},
        {r6('avg(trust)', 'avg_trust')}, {r6('avg(domain)', 'avg_domain')}
      FROM ranked WHERE rank <= 100""",
    "selected_lists": ON_RANKED + """
      SELECT string_agg(CAST(n_core AS VARCHAR), ',' ORDER BY rank) AS ai_skill_counts,
        count(*) AS n FROM ranked WHERE rank <= 100""",
    "top_titles": ON_RANKED + """
      SELECT title AS value, count(*) AS n FROM ranked WHERE rank <= 100
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "dashboard": ON_FLAT + f"""
      SELECT count(*) AS n_records, {big('sum(n_skills)', 'n_skill_entries')},
        {big('sum(n_edu)', 'n_education_entries')}, {big('sum(n_jobs)', 'n_job_entries')},
        {r6('min(years_of_experience)', 'min_years')},
        {r6('max(years_of_experience)', 'max_years')},
        {r6('avg(years_of_experience)', 'mean_years')},
        {r6('avg(implied_exp_years)', 'mean_implied_years')},
        count(*) FILTER (abs(exp_discrepancy) > 5) AS n_high_discrepancy,
        {', '.join(r6(f"avg(CAST(highest_tier = 'tier_{i}' AS INTEGER))", f'tier_{i}_share')
                   for i in (1, 2, 3, 4))},
        count(*) FILTER (n_ai_skills = 0) AS n_no_ai,
        count(*) FILTER (n_ai_skills >= 5) AS n_ai_5,
        count(*) FILTER (n_ai_skills >= 10) AS n_ai_10,
        {r6('avg(CAST(open_to_work AS INTEGER))', 'open_to_work')},
        {r6('avg(CAST(verified_email AS INTEGER))', 'verified_email')},
        {r6('avg(CAST(github_activity_score > -1 AS INTEGER))', 'github_linked')},
        {r6('avg(CAST(willing_to_relocate AS INTEGER))', 'relocate')},
        {r6('avg(recruiter_response_rate)', 'response_rate')},
        {r6('avg(interview_completion_rate)', 'interview_rate')} FROM flat""",
    "outlier_counts": ON_FLAT + """
      SELECT count(*) FILTER (abs(exp_discrepancy) > 5) AS high_discrepancy,
        count(*) FILTER (salary_min IS NOT NULL AND salary_max IS NOT NULL) AS salary_known,
        count(*) FILTER (salary_max < salary_min) AS salary_inverted,
        count(*) FILTER (connection_count > 1000) AS many_connections,
        count(*) FILTER (applications_30d > 15) AS many_applications,
        count(*) FILTER (avg_response_time_hours > 500) AS slow_response,
        count(*) FILTER (n_skills = 0) AS no_skills, count(*) FILTER (n_edu = 0) AS no_education,
        count(*) FILTER (github_activity_score = -1) AS no_github FROM flat""",
    "job_summary": B.ON_VIEW + """
      SELECT count(*) AS n_jobs, count(DISTINCT company) AS n_companies,
        count(*) FILTER (dur < 3) AS n_very_short FROM job""",
    "education_summary": B.ON_VIEW + """
      SELECT count(*) AS n_entries,
        count(*) FILTER (e - s < 0 OR e - s > 12 OR e > 2030) AS n_impossible FROM edu""",
    "education_tiers": B.ON_VIEW + f"""
      SELECT value, count(tier) AS n FROM (SELECT unnest({B.listed(S.EDUCATION_TIERS)}) AS value)
      LEFT JOIN edu ON tier = value GROUP BY 1""",
    "flag_breakdown": FORENSICS + """
      SELECT code, count(*) AS n_flags, count(DISTINCT k) AS n_records FROM forensic_hit
      GROUP BY code""",
    "flag_totals": B.ON_FLAGS + f"""
      SELECT count(*) AS n_records, count(*) FILTER (n_flags > 0) AS n_flagged,
        {big('sum(n_flags)', 'n_flags')},
        {r6('avg(CAST(n_flags > 0 AS INTEGER))', 'flagged_share')},
        {r6('sum(n_flags) / CAST(count(*) FILTER (n_flags > 0) AS DOUBLE)',
            'flags_per_flagged')} FROM flags""",
    "worst_k": B.ON_FLAGS + """
      SELECT candidate_id, n_flags FROM flags JOIN base USING (k)
      ORDER BY n_flags DESC, candidate_id LIMIT 10""",
    "scenario_semi_join": """
      SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN (
        SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50)
        ON o_custkey = c_custkey""",
    "first_per_key": """
      SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey
      FROM orders GROUP BY 1""",
    "running_total": f"""
      SELECT p_partkey, {big('''coalesce(sum(p_size) OVER (ORDER BY p_partkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)''', 'before')} FROM part""",
    "stream_score": B.ON_SCORES + f"""
      SELECT candidate_id, {r6('raw', 'raw_score')}, {r6('trust', 'trust_score')},
        {r6('final', 'final_score')} FROM scored""",
    "stream_topk": B.ON_SCORES + f"""
      SELECT candidate_id, {r6('final', 'final_score')} FROM scored
      ORDER BY final DESC, candidate_id LIMIT 100""",
    "stream_quality": B.ON_FLAGS + """
      SELECT code, count(*) AS n_flags, count(DISTINCT k) AS n_records FROM anomaly
      GROUP BY code""",
    "stream_topk_updates": _UPDATED + f"""
      SELECT candidate_id, {r6('final', 'final_score')} FROM scored
      ORDER BY final DESC, candidate_id LIMIT 100""",
    "stream_arrivals": B.with_tables(B.VIEW, _DAMAGE) + """
      SELECT coalesce(why, 'accepted') AS outcome, count(*) AS n FROM dmg GROUP BY 1""",
    "mixed_layout_rejects": B.ON_VIEW + f"""
      SELECT CASE WHEN k % 5 = 1 THEN 'missing_signals' ELSE 'accepted' END AS outcome,
        count(*) AS n, {big('sum(CASE WHEN k % 5 = 1 THEN 0 ELSE connections END)',
                            'connections')} FROM person GROUP BY 1""",
    "json_array_records": B.ON_VIEW + f"""
      SELECT candidate_id, {big('connections', 'connections')}, {big('ns', 'n_skills')}
      FROM person""",
    "read_limit": """
      SELECT least(count(*), 100) AS n, least(count(DISTINCT o_orderkey), 100) AS n_ids
      FROM orders""",
    "ranked_csv_round_trip": ON_RANKED + """
      SELECT candidate_id, CAST(rank AS VARCHAR) AS rank, printf('%.4f', published) AS score,
        reasoning FROM ranked WHERE rank <= 100""",
    "ranked_deduplicated": B.ON_SCORES + """
      SELECT candidate_id, row_number() OVER (ORDER BY published DESC, candidate_id) AS rank,
        published AS score FROM scored ORDER BY rank LIMIT 100""",
    "score_breakdown": B.ON_SCORES + f"""
      SELECT candidate_id, {', '.join(r6(c, f'{n}_score') for n, c in COMPONENT_COLUMNS.items())},
        {r6('trust', 'trust_score')} FROM scored""",
    "feature_cache": B.ON_SCORES + f"""
      SELECT candidate_id, {r6('final', 'final_score')} FROM scored
      ORDER BY final DESC, candidate_id LIMIT 50""",
    "metrics_file": B.ON_SCORES + f"""
      SELECT 'score_distribution' AS metric, {_BANDS} AS key, count(*) AS value
      FROM scored GROUP BY 2""",
    "corr_same_for_any_width": """
      SELECT CAST(w AS BIGINT) AS width, round(corr(CAST(l_quantity AS DOUBLE),
        l_quantity * CAST(2 AS DOUBLE) + l_discount), 6) AS corr
      FROM lineitem, unnest([2, 14]) t(w) WHERE l_linenumber = 1 GROUP BY w""",
    "describe_nan": _PRICES + describe_sql("p", "price"),
    "histogram_nan": _PRICES.rstrip() + f""",
      r AS (SELECT min(price) AS lo, max(price) AS hi FROM p),
      b AS (SELECT least(14, floor((price - lo) / ((hi - lo) / 15))) AS bin, count(*) AS n
            FROM p, r WHERE price IS NOT NULL GROUP BY 1)
      SELECT i AS bin, {r6('lo + i * ((hi - lo) / 15)', 'low')}, coalesce(n, 0) AS n
      FROM range(0, 15) t(i) CROSS JOIN r LEFT JOIN b ON b.bin = i""",
}
ORACLE["csv_file_checks"] = ORACLE["output_checks"].replace("o_orderkey % 229 = 8 AS short",
                                                            "false AS short")
