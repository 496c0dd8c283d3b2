"""SQL of the registered queries, where SQL can express them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
_LEADS = " || ' ' || ".join(["w"] + [f"lead(w, {i}) OVER o" for i in range(1, 8)])

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        text IS NULL AS missing, source,
        regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM d),
win AS (SELECT rid, pos, {_LEADS} AS key FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos, key IS NOT NULL AND count(*) OVER (PARTITION BY rid, key) > 1 AS dup
        FROM win),
rep AS (SELECT rid, count(*) FILTER (hit) AS n FROM (
        SELECT rid, max(dup) OVER (PARTITION BY rid ORDER BY pos
            ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM twice) GROUP BY rid),
raw AS (SELECT rid, source, text, missing, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT *, trim(regexp_replace(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'),
            '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
        len(regexp_extract_all(line, '{_WORD}')) AS n FROM raw
        WHERE regexp_matches(line, '{_WORD}')),
prose AS (SELECT * FROM l WHERE len(list_filter(regexp_extract_all(line, '{_WORD}'),
            lambda w: regexp_matches(w, '{_LETTER}'))) >= 3
        AND 5 * len(regexp_extract_all(line, '{_LETTER}'))
            >= 3 * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT (text, missing)) AS documents FROM d GROUP BY source),
copies AS (SELECT DISTINCT source, norm, n, text, missing FROM prose),
holders AS (SELECT source, norm, n, count(*) AS held FROM copies GROUP BY source, norm, n),
often AS (SELECT norm FROM holders GROUP BY norm HAVING sum(held) >= 5
        AND sum(held) > 0.01::DOUBLE * (SELECT sum(documents) FROM hosts)),
over AS (SELECT h.source, norm FROM holders h JOIN hosts ON h.source IS NOT DISTINCT FROM hosts.source
        WHERE held >= 5 AND held > 0.01::DOUBLE * documents OR n >= 8 AND held >= 100
            OR norm IN (SELECT norm FROM often)),
gone AS (SELECT rid, sum(n)::BIGINT AS n FROM prose l JOIN over o
        ON l.norm = o.norm AND l.source IS NOT DISTINCT FROM o.source GROUP BY rid),
s AS (SELECT d.doc_id, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(gone.n, 0)::BIGINT AS n_removed_words
        FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_removed_words <= 0.5::DOUBLE * n_words AS kept FROM f
"""

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PLAIN}') AS words
        FROM documents),
b AS (SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PLAIN}') AS words
        FROM benchmark),
bw AS (SELECT item_id, unnest(range(1, greatest(len(words) - 8, 2))) AS i, words FROM b
        WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, least(10, len(words)) AS size,
        array_to_string(words[i:i + 9], ' ') AS key FROM bw),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM d),
p AS (SELECT rid, pos, list(w) OVER (PARTITION BY rid ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM w),
c AS (SELECT rid, pos, size, array_to_string(ahead[1:size], ' ') AS key
        FROM p, (SELECT DISTINCT size FROM windows) WHERE len(ahead) >= size),
hits AS (SELECT DISTINCT rid, pos, item_id, size FROM c JOIN windows USING (size, key)),
hit AS (SELECT rid, count(DISTINCT place) AS n FROM (
        SELECT rid, unnest(range(pos, pos + size)) AS place FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (
        SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL)
        GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
    coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)
         + 1)::BIGINT, 1), '' ORDER BY k) FROM range(32) AS r(k)) AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f ON p.html = f.html
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw
        FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, role, sha256(raw)) - 1 AS pos FROM c),
ends AS (SELECT conv_id, max(pos) // 128 AS last FROM r GROUP BY conv_id),
u AS (SELECT conv_id, pos // 128 AS part, pos, role, raw, false AS again FROM r
    UNION ALL SELECT r.conv_id, unnest(range(1, last + 1)), pos, role, raw, true
        FROM r JOIN ends ON r.conv_id IS NOT DISTINCT FROM ends.conv_id
        WHERE pos < 128 AND role = 'system'),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role <> 'system'),
e AS (SELECT s.conv_id, part, speaker, pos, again, role = speaker AS own,
        CASE WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
             WHEN role = speaker THEN '<|im_start|>assistant' || chr(10)
             ELSE '<|im_start|>user name=' || regexp_replace(replace(role, '<|', '<\|'),
                '[\r\n]+', ' ', 'g') || chr(10) END AS head,
        replace(raw, '<|', '<\|') || '<|im_end|>' || chr(10) AS body
        FROM s JOIN u ON s.conv_id IS NOT DISTINCT FROM u.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker
        ORDER BY pos)::BIGINT AS upto FROM e)
SELECT conv_id, part::BIGINT AS part, speaker, (count(*) FILTER (NOT again))::BIGINT AS n_turns,
    (count(*) FILTER (again))::BIGINT AS n_repeated,
    (count(*) FILTER (own))::BIGINT AS n_own, string_agg(head || body, '' ORDER BY pos) AS text,
    coalesce(string_agg((upto - length(body))::VARCHAR || ':' || upto::VARCHAR, ',' ORDER BY pos)
        FILTER (own), '') AS mask
FROM o GROUP BY conv_id, part, speaker
"""


def _licenses() -> str:
    from credence.llm.licenses import TEMPLATES
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in TEMPLATES)
    return rf"""
WITH b AS (SELECT doc_id, text, coalesce(doc_id, 0) AS n, concat_ws('/', coalesce(source, 'none'),
        coalesce(lang, 'xx'), 'd' || (coalesce(doc_id, 0) // 1000)) AS upper FROM documents),
f AS (SELECT CASE WHEN n % 1000 = 0 THEN upper || '/LICENSE.' || doc_id
        WHEN n % 10 = 0 THEN upper || '/e' || (n // 10) || '/LICENSE.' || doc_id
        ELSE upper || '/e' || (n // 10) || '/f' || doc_id END AS path, text FROM b),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS unit FROM f),
units AS (SELECT DISTINCT path, unit FROM (
        SELECT * FROM l WHERE regexp_matches(unit, '(?i)licen[cs]|copyright|spdx|rights reserved|'
            || 'all copyright|creative commons')
        UNION ALL SELECT path, text FROM f WHERE contains(path, '/LICENSE.')) WHERE unit IS NOT NULL),
t AS (SELECT * FROM (VALUES {templates}) AS v(license, text)),
ut AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit),
        '[a-z0-9]+(?:[.-][0-9]+)*')) AS term FROM (SELECT DISTINCT unit FROM units))
        GROUP BY unit, term),
tt AS (SELECT license, text, term, count(*) AS tf FROM (SELECT license, text,
        unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][0-9]+)*')) AS term FROM t)
        GROUP BY ALL),
total AS (SELECT (SELECT count(DISTINCT unit) FROM units) + (SELECT count(*) FROM t) AS n),
idf AS (SELECT term, ln((any_value(n) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM (
        SELECT term FROM ut UNION ALL SELECT term FROM tt), total GROUP BY term),
uw AS (SELECT unit, term, tf * idf AS w FROM ut JOIN idf USING (term)),
tw AS (SELECT license, text, term, tf * idf AS v FROM tt JOIN idf USING (term)),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY unit),
tn AS (SELECT license, text, sqrt(sum(v * v)) AS size FROM tw GROUP BY license, text),
score AS (SELECT unit, license, round(sum(w * v) / (any_value(norm) * any_value(size)), 6) AS score
        FROM uw JOIN tw USING (term) JOIN un USING (unit) JOIN tn USING (license, text)
        GROUP BY unit, license, text),
own AS (SELECT path, arg_min(license, (-score, license)) AS own_license, max(score) AS own_score
        FROM units JOIN score USING (unit) WHERE score >= 0.7 GROUP BY path),
dirs AS (SELECT regexp_replace(path, '[^/]*$', '') AS directory, min(own_license) AS found
        FROM own WHERE contains(path, '/LICENSE.') GROUP BY 1),
near AS (SELECT path, arg_max(directory, length(directory)) AS directory,
        arg_max(found, length(directory)) AS found
        FROM (SELECT DISTINCT path FROM f) f JOIN dirs ON starts_with(f.path, directory)
        GROUP BY path)
SELECT f.path, own_license, round(own_score, 4) AS own_score,
    coalesce(own_license, found) AS license,
    CASE WHEN own_license IS NULL THEN directory END AS inherited_from
FROM (SELECT DISTINCT path FROM f) f LEFT JOIN own USING (path) LEFT JOIN near USING (path)
"""


# Another way than the library's: all deletions of a letter instead of chunks and grams.
VARIANTS = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        AS run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text,
        '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(
        coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128
        THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b
        FROM runs),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b),
        lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)]))) AS h FROM bytes, crc),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0
        THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
        WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT DISTINCT word, n, p, word[:p - 1] || word[p + 1:] AS d
        FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b
            ON a.d = b.d AND a.p = b.p AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.d = b.word
        UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON b.d = a.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, min((-n, near)) AS b FROM pairs GROUP BY word),
linked AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form,
        CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n
        FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM linked
        UNION ALL SELECT c.word, l.form FROM chain c JOIN linked l ON l.word = c.root
        WHERE l.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN linked l ON l.word = c.root
        WHERE l.form IS NULL)
SELECT l.word, l.form, e.root, l.n, l.n_near, l.form_n::BIGINT AS form_n
FROM linked l JOIN ends e USING (word)
"""


ORACLE = {
    "op2_quality": QUALITY,
    "op3_decontaminate": DECONTAMINATE,
    "op4_licenses": _licenses(),
    "op8_warc": WARC,
    "op10_chat": CHAT,
    "op12_variants": VARIANTS,
}
