"""Matching of file names to families within their job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import strings as S
from weftline.operators import matching as M
from weftline.queries.strings import sql_profile, sql_stem, sql_words
from weftline.session import materialize, table


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return M.names(table(spark, d, "match_evidence")), M.catalogue(table(spark, d, "token_evidence"))


def _synonyms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translation_terms").where("term_domain IN ('color', 'producttype')").select(F.lower("term").alias("term"), F.col("canonical_id").alias("group_id"))


def match_digits(spark: SparkSession, d: str) -> DataFrame:
    """Names whose digit tokens lead to exactly one family of their job."""
    img, cat = _parts(spark, d)
    return M.by_digits(img, M.holders(M.digit_postings(cat)))


def ambiguous_digits(spark: SparkSession, d: str) -> DataFrame:
    """Digit keys that several families of a job hold, with their number."""
    _, cat = _parts(spark, d)
    return M.digit_postings(cat).groupBy("grp", "key").agg(F.count("*").alias("families")).where("families > 1")


def match_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Names whose neighbouring digit runs together form a key of one family."""
    img, cat = _parts(spark, d)
    return M.by_concatenation(img, M.holders(M.digit_postings(cat))).select("id", "rec", F.round("distance", 6).alias("distance"))


def match_permuted(spark: SparkSession, d: str) -> DataFrame:
    """Names whose digit runs in any order form a key of one family, where those in order don't."""
    img, cat = _parts(spark, d)
    index = M.holders(M.digit_postings(cat))
    left = img.join(M.by_concatenation(img, index).select("id"), "id", "left_anti")
    return M.by_permutation(left, index).select("id", "rec", F.round("distance", 6).alias("distance"))


def match_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Names all of whose known digit tokens just one family holds."""
    img, cat = _parts(spark, d)
    return M.by_intersection(img, M.digit_postings(cat))


def match_contained(spark: SparkSession, d: str) -> DataFrame:
    """Names whose long digit tokens stand within longer keys of one family."""
    img, cat = _parts(spark, d)
    return M.by_containment(img, M.holders(M.digit_postings(cat)))


def match_words(spark: SparkSession, d: str) -> DataFrame:
    """Names of which one family alone holds the most words, synonyms taken together; ties broken by numbers, and a code
    of one family may stand alone. The score is the share of the name's words."""
    img, cat = _parts(spark, d)
    syn = _synonyms(spark, d)
    found = M.by_words(img, M.word_postings(cat, syn), syn, numbers=M.number_postings(cat))
    words = img.select("id", F.size(S.filename_tokens(F.col("name"))).alias("words"))
    return found.join(words, "id").select("id", "rec", "matched", F.round(F.least(F.lit(1.0), F.col("matched") / F.col("words")), 6).alias("score"))


def match_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Names with a word that is two neighbouring words of exactly one family's value written together."""
    img, cat = _parts(spark, d)
    words = img.select("id", "grp", F.explode(S.filename_tokens(F.col("name"))).alias("key"))
    pairs = words.join(M.holders(M.neighbour_words(cat)), ["grp", "key"])
    return pairs.groupBy("id").agg(F.min("lo").alias("rec"), F.max("hi").alias("other")).where("rec = other").drop("other")


def header_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Words of header cells that are two neighbouring words of one meaning's terms written together."""
    heads = table(spark, d, "header_cells").where("raw_header IS NOT NULL").select("header_id", F.explode(F.array_distinct(F.split(F.lower("raw_header"), "[^a-zà-öø-ÿ0-9]+"))).alias("key"))
    terms = table(spark, d, "translation_terms").where("term_domain = 'header'").select(F.lit("").alias("grp"), F.col("canonical_id").alias("rec"), F.lit("term").alias("prop"), F.col("term").alias("value"))
    found = heads.join(M.holders(M.neighbour_words(terms)), "key").groupBy("header_id").agg(F.min("lo").alias("rec"), F.max("hi").alias("other"))
    return found.where("rec = other").drop("other")


def fuzzy_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of names that no family of the job has, with the family words one edit away."""
    img, cat = _parts(spark, d)
    words = img.select("grp", F.explode(S.filename_tokens(F.col("name"))).alias("word"))
    return M.near_words(words, M.word_postings(cat).select("grp", "key").distinct())


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "match_evidence").where("final_family_id IS NOT NULL").select(F.col("evidence_id").alias("id"), F.col("final_family_id").alias("rec"))


def sibling_equal(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched names with the same rare words as matched names of one family."""
    img, _ = _parts(spark, d)
    return M.by_equal_profile(materialize(M.rare_profiles(img), "profiles"), _known(spark, d))


def sibling_related(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched names whose rare words contain, or are contained in, those of one family's matched names."""
    img, _ = _parts(spark, d)
    return M.by_related_profile(materialize(M.rare_profiles(img), "profiles"), _known(spark, d))


def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its first digit bracket's family, or the reason that it has none (all brackets: ``whole_job``)."""
    img, cat = _parts(spark, d)
    postings = materialize(M.digit_postings(cat), "digit-postings")
    index = materialize(M.holders(postings), "digit-index")
    found = M.first_bracket([("digits", M.by_digits(img, index)), ("concatenated", M.by_concatenation(img, index)), ("intersection", M.by_intersection(img, postings)), ("contained", M.by_containment(img, index))])
    return M.outcome(img, found, postings)


def name_in_cell(spark: SparkSession, d: str) -> DataFrame:
    """Sheets' families by a cell that holds a file's name, else its stem, else its collapsed stem: exactly one family
    number in all its rows."""
    img = table(spark, d, "match_evidence").select(F.col("evidence_id").alias("id"), F.col("source_filename").alias("name"))
    return M.by_cell(img, table(spark, d, "worksheet_rows"))


def name_starts_with_cell(spark: SparkSession, d: str) -> DataFrame:
    """Names whose collapsed stem starts with a reference of exactly one family of their job.

    The stem's leading parts are listed and joined, which makes the search for starts an equi-join.
    """
    img = table(spark, d, "match_evidence").select(F.col("evidence_id").alias("id"), F.col("job_id").alias("grp"), F.col("source_filename").alias("name"))
    return M.by_cell_start(img, table(spark, d, "token_evidence"))


QUERIES = {f.__name__: f for f in (match_digits, ambiguous_digits, match_concatenated, match_permuted, match_intersection, match_contained, match_words, match_neighbours, header_neighbours, fuzzy_words, sibling_equal, sibling_related, match_cascade, name_in_cell, name_starts_with_cell)}

_IMG = f"img AS (SELECT evidence_id AS id, job_id AS grp, {sql_stem('source_filename')} AS s, source_filename AS name FROM match_evidence WHERE job_id IS NOT NULL AND source_filename IS NOT NULL)"
_CAT = "cat AS (SELECT job_id AS grp, family_id AS rec, 'family_id' AS prop, family_id AS value FROM token_evidence WHERE job_id IS NOT NULL AND family_id IS NOT NULL UNION ALL SELECT job_id, family_id, property_name, family_token FROM token_evidence WHERE job_id IS NOT NULL AND family_id IS NOT NULL AND family_token IS NOT NULL)"
_POST = """post AS (SELECT DISTINCT grp, key, rec FROM (
  SELECT grp, rec, regexp_replace(value, '[^0-9]', '', 'g') AS key FROM cat WHERE len(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 1 AND 18
  UNION ALL SELECT grp, rec, unnest([r for r in regexp_extract_all(value, '[0-9]+') if len(r) >= 5]) FROM cat))"""
_TOK = "tok AS (SELECT id, grp, unnest(list_distinct([t for t in list_concat(regexp_extract_all(s, '[0-9]+'), [regexp_replace(s, '[^0-9]', '', 'g')]) if len(t) >= 5])) AS key FROM img)"
_DIGITS = f"WITH {_IMG}, {_CAT}, {_POST}, {_TOK}"
_BY_DIGITS = "SELECT id, min(rec) AS rec FROM tok JOIN post USING (grp, key) GROUP BY id HAVING count(DISTINCT rec) = 1"
_WINDOWS = """win AS (SELECT id, grp, list_slice(runs, i, j) AS t FROM (SELECT id, grp, regexp_extract_all(s, '[0-9]+') AS runs FROM img) r, range(1, 40) a(i), range(2, 41) b(j) WHERE i < j AND j <= len(runs)),
dist AS (SELECT id, grp, array_to_string(t, '') AS key, len(t) AS n, list_sum([-(len(x) * 1.0 / len(array_to_string(t, ''))) * ln(len(x) * 1.0 / len(array_to_string(t, ''))) for x in t]) AS h FROM win),
near AS (SELECT id, grp, key, (n - 1) * (2 - h / ln(n)) AS d FROM dist)"""
_BY_CONCAT = "SELECT id, min(rec) AS rec, min(d) AS distance FROM near JOIN post USING (grp, key) WHERE d <= 1.478 GROUP BY id HAVING count(DISTINCT rec) = 1"
_BY_INTER = """SELECT id, min(rec) AS rec FROM (
  SELECT h.id, p.rec FROM (SELECT id, grp, key, count(*) OVER (PARTITION BY id) AS want FROM tok t WHERE EXISTS (SELECT 1 FROM post p WHERE p.grp = t.grp AND p.key = t.key)) h
  JOIN post p USING (grp, key) WHERE h.want >= 2 GROUP BY h.id, p.rec, h.want HAVING count(*) = h.want) GROUP BY id HAVING count(*) = 1"""
_BY_CONTAINED = "SELECT id, min(rec) AS rec FROM tok JOIN post USING (grp) WHERE len(tok.key) >= 7 AND len(post.key) > len(tok.key) AND contains(post.key, tok.key) GROUP BY id HAVING count(DISTINCT rec) = 1"
_SYN = "syn AS (SELECT lower(term) AS term, min(canonical_id) AS gid FROM translation_terms WHERE term_domain IN ('color', 'producttype') GROUP BY 1)"
_SPLIT = "regexp_split_to_array(lower(value), '[^a-zà-öø-ÿ0-9]+')"
_WPOST = f"wpost AS (SELECT DISTINCT grp, coalesce(gid, key) AS key, rec FROM (SELECT grp, rec, unnest({_SPLIT}) AS key FROM cat WHERE prop <> 'family_id') w LEFT JOIN syn ON syn.term = w.key WHERE len(key) >= 2 AND NOT regexp_matches(key, '^[0-9]+$'))"
_PROFILES = f"""prof AS (SELECT id, grp, list_sort(list_distinct(list(w))) AS profile FROM (
  SELECT p.id, p.grp, p.w FROM (SELECT id, grp, unnest({sql_profile('name')}) AS w FROM img) p
  WHERE (p.grp, p.w) NOT IN (SELECT (q.grp, q.w) FROM (SELECT grp, w, count(*) AS n FROM (SELECT id, grp, unnest({sql_profile('name')}) AS w FROM img) GROUP BY 1, 2) q JOIN (SELECT grp, count(*) AS total FROM img GROUP BY 1) z USING (grp) WHERE q.n > 10 AND q.n > 0.5 * total)) GROUP BY 1, 2),
known AS (SELECT evidence_id AS id, final_family_id AS rec FROM match_evidence WHERE final_family_id IS NOT NULL),
owned AS (SELECT grp, profile, rec FROM prof JOIN known USING (id) GROUP BY 1, 2, 3), open AS (SELECT * FROM prof WHERE id NOT IN (SELECT id FROM known))"""
_COLLAPSED = "translate(regexp_replace(lower({s}), '(\\s*\\([0-9]+\\)|[-_ ]+(copy|ret|retouch(ed)?))+$', ''), ' _-.', '')"

ORACLE = {
    "match_digits": f"{_DIGITS} {_BY_DIGITS}",
    "ambiguous_digits": f"WITH {_CAT}, {_POST} SELECT grp, key, count(*) AS families FROM post GROUP BY 1, 2 HAVING count(*) > 1",
    "match_concatenated": f"{_DIGITS}, {_WINDOWS} SELECT id, rec, round(distance, 6) AS distance FROM ({_BY_CONCAT})",
    "match_intersection": f"{_DIGITS} {_BY_INTER}",
    "match_contained": f"{_DIGITS} {_BY_CONTAINED}",
    "match_words": f"""WITH {_IMG}, {_CAT}, {_SYN}, {_WPOST}, words AS (SELECT id, grp, unnest({sql_words('name')}) AS word FROM img),
keyed AS (SELECT id, grp, word, coalesce(gid, word) AS key FROM words LEFT JOIN syn ON syn.term = words.word),
bad AS (SELECT DISTINCT id FROM keyed k WHERE len(word) >= 4 AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[^0-9]') AND NOT EXISTS (SELECT 1 FROM wpost p WHERE p.grp = k.grp AND p.key = k.key)),
score AS (SELECT id, any_value(grp) AS grp, rec, count(*) AS matched, bool_or(len(word) >= 4 AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[^0-9]') AND (SELECT count(*) FROM wpost p WHERE p.grp = keyed.grp AND p.key = keyed.key) = 1) AS code
  FROM keyed JOIN wpost USING (grp, key) WHERE id NOT IN (SELECT id FROM bad) GROUP BY id, rec),
top AS (SELECT * FROM score QUALIFY matched = max(matched) OVER (PARTITION BY id)),
nums AS (SELECT DISTINCT grp, rec, key FROM (SELECT grp, rec, unnest({_SPLIT}) AS key FROM cat WHERE prop <> 'family_id') WHERE regexp_matches(key, '^[0-9]+$')),
told AS (SELECT DISTINCT id, grp, key FROM (SELECT id, grp, unnest(regexp_split_to_array(lower(s), '[^a-zà-öø-ÿ0-9]+')) AS key FROM img) WHERE regexp_matches(key, '^[0-9]+$')),
telling AS (SELECT id, key, min(rec) AS rec FROM top JOIN told USING (id, grp) JOIN nums USING (grp, rec, key) WHERE matched >= 2 GROUP BY 1, 2 HAVING count(*) = 1),
win AS (SELECT id, min(rec) AS rec, max(matched) AS matched, bool_or(code) AS code FROM top GROUP BY 1 HAVING count(*) = 1
  UNION ALL SELECT id, min(rec), (SELECT max(matched) FROM top WHERE top.id = telling.id), false FROM telling WHERE id IN (SELECT id FROM top GROUP BY 1 HAVING count(*) > 1) GROUP BY 1 HAVING count(DISTINCT rec) = 1)
SELECT w.id, rec, matched, round(least(1.0, matched * 1.0 / (SELECT count(*) FROM words WHERE words.id = w.id)), 6) AS score FROM win w WHERE matched >= 2 OR code""",
    "match_neighbours": f"""WITH {_IMG}, {_CAT}, words AS (SELECT id, grp, unnest({sql_words('name')}) AS key FROM img), w AS (SELECT grp, rec, [x for x in {_SPLIT} if len(x) >= 2] AS w FROM cat WHERE prop <> 'family_id'),
pairs AS (SELECT grp, rec, w[i] AS a, w[i + 1] AS b FROM w, range(1, 60) r(i) WHERE i < len(w)),
post AS (SELECT grp, rec, a || b AS key FROM pairs WHERE NOT (regexp_matches(a, '^[0-9]+$') AND regexp_matches(b, '^[0-9]+$')) UNION SELECT grp, rec, b || a FROM pairs WHERE NOT (regexp_matches(a, '^[0-9]+$') AND regexp_matches(b, '^[0-9]+$')))
SELECT id, min(rec) AS rec FROM words JOIN post USING (grp, key) GROUP BY id HAVING count(DISTINCT rec) = 1""",
    "header_neighbours": """WITH w AS (SELECT canonical_id AS rec, [x for x in regexp_split_to_array(lower(term), '[^a-zà-öø-ÿ0-9]+') if len(x) >= 2] AS w FROM translation_terms WHERE term_domain = 'header'),
p AS (SELECT rec, w[i] AS a, w[i + 1] AS b FROM w, range(1, 60) r(i) WHERE i < len(w)), k AS (SELECT rec, a || b AS key FROM p UNION SELECT rec, b || a FROM p),
h AS (SELECT DISTINCT header_id, unnest(regexp_split_to_array(lower(raw_header), '[^a-zà-öø-ÿ0-9]+')) AS key FROM header_cells)
SELECT header_id, min(rec) AS rec FROM h JOIN k USING (key) GROUP BY 1 HAVING count(DISTINCT rec) = 1""",
    "fuzzy_words": f"""WITH {_IMG}, {_CAT}, lex AS (SELECT DISTINCT grp, key FROM (SELECT grp, unnest({_SPLIT}) AS key FROM cat WHERE prop <> 'family_id') WHERE len(key) >= 2 AND NOT regexp_matches(key, '^[0-9]+$')),
words AS (SELECT DISTINCT grp, word FROM (SELECT grp, unnest({sql_words('name')}) AS word FROM img) WHERE len(word) >= 4)
SELECT w.grp, w.word, l.key FROM words w JOIN lex l ON l.grp = w.grp AND len(l.key) >= 4 AND abs(len(l.key) - len(w.word)) <= 1 AND levenshtein(l.key, w.word) = 1 WHERE NOT EXISTS (SELECT 1 FROM lex x WHERE x.grp = w.grp AND x.key = w.word)""",
    "sibling_equal": f"WITH {_IMG}, {_PROFILES} SELECT o.id, min(w.rec) AS rec FROM open o JOIN owned w USING (grp, profile) GROUP BY 1 HAVING count(DISTINCT w.rec) = 1",
    "sibling_related": f"""WITH {_IMG}, {_PROFILES} SELECT o.id, min(w.rec) AS rec FROM open o JOIN owned w ON o.grp = w.grp AND (list_has_all(w.profile, o.profile) OR list_has_all(o.profile, w.profile))
  AND (len(list_intersect(o.profile, w.profile)) >= 2 OR len([x for x in list_intersect(o.profile, w.profile) if len(x) >= 5]) > 0) GROUP BY 1 HAVING count(DISTINCT w.rec) = 1""",
    "match_cascade": f"""{_DIGITS}, {_WINDOWS}, f AS (SELECT id, rec, 0 AS n, 'digits' AS bracket FROM ({_BY_DIGITS}) UNION ALL SELECT id, rec, 1, 'concatenated' FROM ({_BY_CONCAT}) UNION ALL SELECT id, rec, 2, 'intersection' FROM ({_BY_INTER}) UNION ALL SELECT id, rec, 3, 'contained' FROM ({_BY_CONTAINED})),
best AS (SELECT id, arg_min(rec, n) AS rec, arg_min(bracket, n) AS bracket FROM f GROUP BY 1),
several AS (SELECT id FROM tok JOIN post USING (grp, key) GROUP BY id HAVING count(DISTINCT rec) > 1),
absent AS (SELECT DISTINCT id FROM (SELECT id, grp, unnest(regexp_extract_all(s, '[0-9]+')) AS key FROM img) e WHERE len(key) = 8 AND NOT EXISTS (SELECT 1 FROM post p WHERE p.grp = e.grp AND p.key = e.key))
SELECT i.id, b.rec, b.bracket, CASE WHEN b.rec IS NOT NULL THEN NULL WHEN i.id IN (SELECT id FROM several) THEN 'several records' WHEN i.id IN (SELECT id FROM absent) THEN 'number not in catalogue' ELSE 'nothing found' END AS reason FROM img i LEFT JOIN best b USING (id)""",
    "name_in_cell": f"""WITH r AS (SELECT row_id, unnest(cells) AS c FROM worksheet_rows), q AS (SELECT row_id, regexp_extract(unnest(regexp_split_to_array(lower(trim(c)), '[\\s,;]+')), '([^/\\\\]*)$', 1) AS piece FROM r WHERE c IS NOT NULL),
b AS (SELECT *, CASE WHEN regexp_matches(piece, '[.](jpg|jpeg|png|gif|bmp|tif|tiff|webp)$') THEN regexp_replace(piece, '\\.[^.]*$', '') ELSE piece END AS bare FROM q),
p AS (SELECT DISTINCT row_id, way, CASE way WHEN 0 THEN piece WHEN 1 THEN bare ELSE translate(bare, ' _-.', '') END AS key FROM b, (VALUES (0), (1), (2)) w(way) WHERE len(translate(bare, ' _-.', '')) >= 6 AND NOT regexp_matches(translate(bare, ' _-.', ''), '^[0-9]{{8}}$')),
n AS (SELECT row_id, min(trim(c)) AS rec FROM r WHERE regexp_matches(trim(c), '^[0-9]{{8}}$') GROUP BY 1 HAVING count(DISTINCT trim(c)) = 1),
x AS (SELECT way, key, min(rec) AS lo, max(rec) AS hi FROM p JOIN n USING (row_id) GROUP BY 1, 2),
a AS (SELECT evidence_id AS id, way, CASE way WHEN 0 THEN lower(regexp_extract(source_filename, '([^/\\\\]*)$', 1)) WHEN 1 THEN lower({sql_stem('source_filename')}) ELSE {_COLLAPSED.format(s=sql_stem('source_filename'))} END AS key FROM match_evidence, (VALUES (0), (1), (2)) w(way))
SELECT id, lo AS rec FROM (SELECT id, lo, hi FROM a JOIN x USING (way, key) QUALIFY row_number() OVER (PARTITION BY id ORDER BY way) = 1) WHERE lo = hi""",
    "name_starts_with_cell": f"""WITH i AS (SELECT evidence_id AS id, job_id AS grp, {_COLLAPSED.format(s=sql_stem('source_filename'))} AS s FROM match_evidence),
x AS (SELECT DISTINCT job_id AS grp, family_id AS rec, translate(lower(family_token), ' _-.', '') AS key FROM token_evidence WHERE property_name = 'refco' AND job_id IS NOT NULL AND family_token IS NOT NULL)
SELECT id, min(rec) AS rec FROM i JOIN x USING (grp) WHERE len(key) >= 5 AND starts_with(s, key) GROUP BY 1 HAVING count(DISTINCT rec) = 1""",
}

#: Runs in any order: two to five different places of a name, spelled in every order; each inversion adds one.
_SPELLED = """seq AS (SELECT id, runs, grp, [i] AS places FROM (SELECT id, grp, regexp_extract_all(s, '[0-9]+') AS runs FROM img) r, range(1, 13) n(i) WHERE len(runs) BETWEEN 2 AND 12 AND i <= len(runs)
  UNION ALL SELECT id, runs, grp, list_append(places, i) FROM seq, range(1, 13) n(i) WHERE len(places) < 5 AND i <= len(runs) AND NOT list_contains(places, i)),
spelled AS (SELECT id, grp, list_transform(places, lambda k: runs[k]) AS t, (SELECT count(*) FROM range(1, 6) a(x), range(1, 6) b(y) WHERE x < y AND y <= len(places) AND places[x] > places[y]) AS swaps FROM seq WHERE len(places) >= 2),
far AS (SELECT id, grp, array_to_string(t, '') AS key, swaps + (len(t) - 1) * (2 - list_sum([-(len(x) * 1.0 / len(array_to_string(t, ''))) * ln(len(x) * 1.0 / len(array_to_string(t, ''))) for x in t]) / ln(len(t))) AS d FROM spelled)"""
ORACLE["match_permuted"] = _DIGITS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_WINDOWS}, {_SPELLED}
SELECT id, min(rec) AS rec, round(min(d), 6) AS distance FROM far JOIN post USING (grp, key) WHERE d <= 4.5 AND id NOT IN (SELECT id FROM ({_BY_CONCAT})) GROUP BY id HAVING count(DISTINCT rec) = 1"""
