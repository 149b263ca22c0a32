"""SQL of a whole job: all brackets in their order, each on what those before it left open."""

from __future__ import annotations

from weftline.queries import matching as Q, more, tables
from weftline.queries.strings import sql_words

_CODE = "len(word) >= 4 AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[^0-9]')"
_NUM = "regexp_matches(key, '^[0-9]+$')"


def _open(found: str) -> str:
    return f"id NOT IN (SELECT id FROM {found})"


def _then(n: int, bracket: str, matched: str) -> str:
    """The matches so far and a bracket's among the names they leave."""
    return f"f{n} AS (SELECT * FROM f{n - 1} UNION ALL SELECT id, '{bracket}', rec FROM ({matched}) WHERE {_open(f'f{n - 1}')})"


def _words(p: str, keyed: str, count: str) -> str:
    """Names of which one record holds the most words: ties broken by numbers, codes that stand alone."""
    return f"""{p}score AS (SELECT id, any_value(grp) AS grp, rec, {count} AS matched, bool_or({_CODE} AND (grp, key) IN (SELECT (grp, key) FROM sole)) AS code FROM {keyed} JOIN wp USING (grp, key) WHERE id NOT IN (SELECT id FROM bad) GROUP BY id, rec),
{p}top AS (SELECT * FROM {p}score QUALIFY matched = max(matched) OVER (PARTITION BY id)),
{p}telling AS (SELECT id, key, min(rec) AS rec FROM {p}top JOIN told USING (id, grp) JOIN nums USING (grp, rec, key) WHERE matched >= 2 GROUP BY 1, 2 HAVING count(*) = 1),
{p}win AS (SELECT id, min(rec) AS rec FROM {p}top GROUP BY 1 HAVING count(*) = 1 AND (max(matched) >= 2 OR bool_or(code))
  UNION ALL SELECT id, min(rec) FROM {p}telling WHERE id IN (SELECT id FROM {p}top GROUP BY 1 HAVING count(*) > 1) GROUP BY 1 HAVING count(DISTINCT rec) = 1)"""


_BIG = "(regexp_matches(a, '^[0-9]+$') AND regexp_matches(b, '^[0-9]+$'))"
_SIBLINGS = Q._PROFILES[: Q._PROFILES.index(",\nknown AS")]
_NARROW = more._NARROWED[more._NARROWED.index("terms AS (SELECT DISTINCT term_domain") : more._NARROWED.index(" SELECT id, count(*) AS families")]
_NARROW = _NARROW.replace("WHERE final_family_id IS NULL AND job_id IS NOT NULL AND source_filename IS NOT NULL", "WHERE job_id IS NOT NULL AND source_filename IS NOT NULL AND evidence_id NOT IN (SELECT id FROM f4)")
_NARROW = _NARROW.replace("(SELECT (job_id, final_family_id) FROM match_evidence WHERE final_family_id IS NOT NULL AND job_id IS NOT NULL)", "(SELECT (grp, rec) FROM f4 JOIN img USING (id))")

ORACLE = {"whole_job": f"""{Q._DIGITS.replace("WITH ", "WITH RECURSIVE ", 1)}, {Q._WINDOWS}, {Q._SPELLED},
f0 AS (SELECT id, 'known' AS bracket, min(final_family_id) AS rec FROM img JOIN match_evidence ON evidence_id = id WHERE final_family_id IS NOT NULL GROUP BY 1),
num AS (SELECT id, rec, 0 AS n, 'digits' AS b FROM ({Q._BY_DIGITS}) UNION ALL SELECT id, rec, 1, 'concatenated' FROM ({Q._BY_CONCAT}) UNION ALL SELECT id, rec, 2, 'intersection' FROM ({Q._BY_INTER})),
f1 AS (SELECT * FROM f0 UNION ALL SELECT id, arg_min(b, n), arg_min(rec, n) FROM num WHERE {_open('f0')} GROUP BY 1),
{_then(2, 'permuted', "SELECT id, min(rec) AS rec FROM far JOIN post USING (grp, key) WHERE d <= 4.5 GROUP BY id HAVING count(DISTINCT rec) = 1")},
{Q._SYN}, {Q._WPOST},
nw AS (SELECT grp, rec, [x for x in {Q._SPLIT} if len(x) >= 2] AS w FROM cat WHERE prop <> 'family_id'), np AS (SELECT grp, rec, w[i] AS a, w[i + 1] AS b FROM nw, range(1, 60) r(i) WHERE i < len(w)),
wp AS (SELECT grp, key, rec FROM wpost UNION SELECT grp, a || b, rec FROM np WHERE NOT {_BIG} UNION SELECT grp, b || a, rec FROM np WHERE NOT {_BIG}),
sole AS (SELECT grp, key FROM wp GROUP BY 1, 2 HAVING count(*) = 1),
words AS (SELECT id, grp, unnest({sql_words('name')}) AS word FROM img), keyed AS (SELECT id, grp, word, coalesce(gid, word) AS key FROM words LEFT JOIN syn ON syn.term = words.word),
bad AS (SELECT DISTINCT id FROM keyed k WHERE {_CODE} AND NOT EXISTS (SELECT 1 FROM wp WHERE wp.grp = k.grp AND wp.key = k.key)),
nums AS (SELECT DISTINCT grp, rec, key FROM (SELECT grp, rec, unnest({Q._SPLIT}) AS key FROM cat WHERE prop <> 'family_id') WHERE {_NUM}),
told AS (SELECT DISTINCT id, grp, key FROM (SELECT id, grp, unnest(regexp_split_to_array(lower(s), '[^a-zà-öø-ÿ0-9]+')) AS key FROM img) WHERE {_NUM}),
{_words('w', 'keyed', 'count(*)')},
{_then(3, 'words', 'SELECT id, rec FROM wwin')},
lex AS (SELECT DISTINCT grp, key FROM (SELECT grp, unnest({Q._SPLIT}) AS key FROM cat WHERE prop <> 'family_id') WHERE len(key) >= 2 AND NOT {_NUM}),
fz AS (SELECT w.grp, w.word, l.key FROM (SELECT DISTINCT grp, word FROM words WHERE len(word) >= 4) w JOIN lex l ON l.grp = w.grp AND len(l.key) >= 4 AND abs(len(l.key) - len(w.word)) <= 1 AND levenshtein(l.key, w.word) = 1 WHERE (w.grp, w.word) NOT IN (SELECT (grp, key) FROM lex)),
keyed2 AS (SELECT * FROM keyed UNION ALL SELECT DISTINCT k.id, k.grp, k.word, coalesce(gid, fz.key) FROM keyed k JOIN fz USING (grp, word) LEFT JOIN syn ON syn.term = fz.key WHERE (k.grp, k.key) NOT IN (SELECT (grp, key) FROM wp)),
{_words('n', 'keyed2', 'count(DISTINCT word)')},
{_then(4, 'near words', 'SELECT id, rec FROM nwin')},
{_NARROW},
{_then(5, 'narrowed', 'SELECT id, min(rec) AS rec FROM l8 GROUP BY 1 HAVING count(*) = 1')},
{_then(6, 'cell', f"SELECT c.id, c.rec FROM ({Q.ORACLE['name_in_cell']}) c JOIN img USING (id) WHERE (grp, c.rec) IN (SELECT (grp, rec) FROM cat)")},
{_then(7, 'cell start', Q.ORACLE['name_starts_with_cell'])},
{_then(8, 'contained', Q._BY_CONTAINED)},
{_SIBLINGS}, owned AS (SELECT DISTINCT grp, profile, rec FROM prof JOIN f8 USING (id)), left_over AS (SELECT * FROM prof WHERE {_open('f8')}),
{_then(9, 'equal sibling', "SELECT o.id, min(w.rec) AS rec FROM left_over o JOIN owned w USING (grp, profile) GROUP BY 1 HAVING count(DISTINCT w.rec) = 1")},
{_then(10, 'related sibling', '''SELECT o.id, min(w.rec) AS rec FROM left_over o JOIN owned w ON o.grp = w.grp AND (list_has_all(w.profile, o.profile) OR list_has_all(o.profile, w.profile))
  AND (len(list_intersect(o.profile, w.profile)) >= 2 OR len([x for x in list_intersect(o.profile, w.profile) if len(x) >= 5]) > 0) WHERE o.id NOT IN (SELECT id FROM bad) GROUP BY 1 HAVING count(DISTINCT w.rec) = 1''')},
several AS (SELECT id FROM tok JOIN post USING (grp, key) GROUP BY id HAVING count(DISTINCT rec) > 1),
absent AS (SELECT DISTINCT id FROM (SELECT id, grp, unnest(regexp_extract_all(s, '[0-9]+')) AS key FROM img) e WHERE len(key) = 8 AND NOT EXISTS (SELECT 1 FROM post p WHERE p.grp = e.grp AND p.key = e.key)),
placed AS (SELECT f10.*, row_number() OVER (PARTITION BY rec ORDER BY {tables._NAT.replace('source_filename', 'name')} COLLATE C, id) - 1 AS position FROM f10 JOIN img USING (id))
SELECT i.id, p.rec, p.bracket, CASE WHEN p.rec IS NOT NULL THEN NULL WHEN i.id IN (SELECT id FROM several) THEN 'several records' WHEN i.id IN (SELECT id FROM absent) THEN 'number not in catalogue' ELSE 'nothing found' END AS reason,
  p.position, p.rec || '_det' || p.position || '.jpg' AS new_name FROM img i LEFT JOIN placed p USING (id)"""}
