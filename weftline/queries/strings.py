"""String functions over the project's texts: file names, headers and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import strings as S
from weftline.operators.ranking import numbered
from weftline.session import table

#: SQL of the functions, on a text x.
BASE = "regexp_extract({x}, '([^/\\\\]*)$', 1)"
STEM = f"regexp_replace({BASE}, '\\.[^.]*$', '')"
FOLD = "strip_accents(lower({x}))"


def sql_stem(x: str) -> str:
    return STEM.format(x=x)


def sql_words(x: str) -> str:
    """Words of a file name, as filename_tokens makes them."""
    stop = ", ".join(f"'{w}'" for w in S.STOP_GENERAL + S.STOP_DOMAIN)
    raw = f"[t for t in regexp_split_to_array(lower({sql_stem(x)}), '[^a-zà-öø-ÿ0-9]+') if t <> '']"
    parts = f"flatten([list_concat([t], regexp_extract_all(t, '[0-9]+|[^0-9]+')) for t in {raw}])"
    return f"list_distinct([t for t in {parts} if len(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({stop})])"


def sql_profile(x: str) -> str:
    pieces = f"regexp_split_to_array({FOLD.format(x=sql_stem(x))}, '[^a-z0-9]+')"
    cut = f"[p for p in regexp_extract_all(t, '[0-9]+|[^0-9]+') if len(p) >= 2 AND NOT regexp_matches(p, '{S.SHOT}')]"
    return f"list_sort(list_distinct(flatten([CASE WHEN regexp_matches(t, '^[a-z]{{1,2}}[0-9]+$') THEN [t] ELSE {cut} END for t in {pieces}])))"


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Base name, stem, extension and folder of each file name."""
    n = F.col("source_filename")
    return table(spark, d, "match_evidence").select("evidence_id", S.basename(n).alias("base"), S.stem(n).alias("stem"), S.extension(n).alias("extension"), S.folder(n).alias("folder"))


def digit_parts(spark: SparkSession, d: str) -> DataFrame:
    """Digit runs and all digits of each file name's stem."""
    s = S.stem(F.col("source_filename"))
    return table(spark, d, "match_evidence").select("evidence_id", F.array_join(S.digit_runs(s), ",").alias("runs"), S.digits_only(s).alias("digits"))


def header_terms(spark: SparkSession, d: str) -> DataFrame:
    """Folded, normalized and tokenized header cells."""
    h = F.col("raw_header")
    return table(spark, d, "header_cells").where(h.isNotNull()).select("header_id", S.folded(h).alias("folded"), S.normalized_term(h).alias("term"), F.array_join(S.header_tokens(h), " ").alias("tokens"))


def cell_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each token stands in the cells of each sheet name."""
    cells = table(spark, d, "worksheet_rows").select("sheet_name", F.explode("cells").alias("c"))
    return cells.select("sheet_name", F.explode(S.cell_tokens(F.col("c"))).alias("token")).groupBy("sheet_name", "token").agg(F.count("*").alias("n"))


def name_words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of each file name."""
    return table(spark, d, "match_evidence").select("evidence_id", F.array_join(F.array_sort(S.filename_tokens(F.col("source_filename"))), " ").alias("words"))


def name_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profile words and collapsed stem of each file name."""
    n = F.col("source_filename")
    return table(spark, d, "match_evidence").select("evidence_id", F.array_join(S.profile_tokens(n), " ").alias("profile"), S.collapsed_stem(n).alias("collapsed"))


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each file name in its job's natural order."""
    m = table(spark, d, "match_evidence").select("evidence_id", "job_id", S.natural_key(F.col("source_filename")).alias("key"))
    return numbered(m, "job_id", ["key", "evidence_id"]).select("evidence_id", "rank")


def noise_free(spark: SparkSession, d: str) -> DataFrame:
    """Property values without measures, dates and numbers beside date words."""
    v = table(spark, d, "property_values").select("value_id", "property_name", F.posexplode("source_values").alias("pos", "v")).where("v IS NOT NULL")
    return v.select("value_id", "pos", S.without_noise(F.col("v"), F.col("property_name")).alias("clean"))


def silent_names(spark: SparkSession, d: str) -> DataFrame:
    """File names without a word that says anything, by job."""
    return table(spark, d, "match_evidence").groupBy("job_id").agg(F.count_if(S.says_nothing(F.col("source_filename"))).alias("silent"), F.count("*").alias("n"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """Numbered safe names for all files."""
    return table(spark, d, "match_evidence").select("evidence_id", S.safe_filename(F.col("source_filename"), F.col("evidence_id")).alias("safe_name"))


def concat_distances(spark: SparkSession, d: str) -> DataFrame:
    """Concatenation distance and confidence of each file name's digit runs (two or more)."""
    runs = table(spark, d, "match_evidence").select("evidence_id", S.digit_runs(S.stem(F.col("source_filename"))).alias("r")).where("size(r) >= 2")
    dist = S.concatenation_distance(F.col("r"))
    return runs.select("evidence_id", F.round(dist, 6).alias("distance"), F.round(S.distance_confidence(dist), 6).alias("confidence"))


def term_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of each header cell to what an earlier run wrote for it."""
    h = table(spark, d, "header_cells").where("raw_header IS NOT NULL AND canonical_name IS NOT NULL")
    return h.select("header_id", F.levenshtein(S.normalized_term(F.col("raw_header")), S.normalized_term(F.col("canonical_name"))).alias("edits"))


def synonym_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Colour tokens of families with the group that their term stands in."""
    t = table(spark, d, "token_evidence").where("property_name = 'color'").select("family_id", F.lower("family_token").alias("term")).distinct()
    s = table(spark, d, "translation_terms").where("term_domain = 'color'").select("term", "canonical_id")
    return t.join(s, "term").select("family_id", "term", "canonical_id")


_E = "match_evidence"
_NOISE_SQL = "coalesce(v, '')"

def orientations(spark: SparkSession, d: str) -> DataFrame:
    """The camera's place that the last word of each file name tells, with how sure that is."""
    m = table(spark, d, "match_evidence").select("evidence_id", S.orientation(F.col("source_filename")).alias("orientation"))
    return m.where("orientation IS NOT NULL").withColumn("confidence", F.lit(0.6))


QUERIES = {f.__name__: f for f in (path_parts, digit_parts, header_terms, cell_token_counts, name_words, name_profiles, natural_order, noise_free, silent_names, safe_names, concat_distances, term_edits, synonym_pairs, orientations)}
ORACLE = {
    "path_parts": f"SELECT evidence_id, {BASE.format(x='source_filename')} AS base, {sql_stem('source_filename')} AS stem, lower(regexp_extract({BASE.format(x='source_filename')}, '(\\.[^.]*)$', 1)) AS extension, regexp_extract(source_filename, '([^/\\\\]+)[/\\\\][^/\\\\]*$', 1) AS folder FROM {_E}",
    "digit_parts": f"SELECT evidence_id, array_to_string(regexp_extract_all(s, '[0-9]+'), ',') AS runs, nullif(regexp_replace(s, '[^0-9]', '', 'g'), '') AS digits FROM (SELECT evidence_id, {sql_stem('source_filename')} AS s FROM {_E})",
    "header_terms": f"SELECT header_id, f AS folded, regexp_replace(f, '[^a-z0-9]', '', 'g') AS term, array_to_string(regexp_extract_all(f, '[a-z0-9]+'), ' ') AS tokens FROM (SELECT header_id, {FOLD.format(x='raw_header')} AS f FROM header_cells WHERE raw_header IS NOT NULL)",
    "cell_token_counts": "SELECT sheet_name, t AS token, count(*) AS n FROM (SELECT sheet_name, unnest(regexp_split_to_array(lower(c), '[ \\t\\r\\n,;/\\\\|:._-]+')) AS t FROM (SELECT sheet_name, unnest(cells) AS c FROM worksheet_rows)) WHERE t <> '' GROUP BY 1, 2",
    "name_words": f"SELECT evidence_id, array_to_string(list_sort({sql_words('source_filename')}), ' ') AS words FROM {_E}",
    "name_profiles": f"SELECT evidence_id, array_to_string({sql_profile('source_filename')}, ' ') AS profile, translate(regexp_replace(lower({sql_stem('source_filename')}), '(\\s*\\([0-9]+\\)|[-_ ]+(copy|ret|retouch(ed)?))+$', ''), ' _-.', '') AS collapsed FROM {_E}",
    "orientations": f"SELECT evidence_id, orientation, CAST(0.6 AS DOUBLE) AS confidence FROM (SELECT evidence_id, lower(regexp_extract_all({sql_stem('source_filename')}, '[\\p{{L}}\\p{{Nd}}]+')[-1]) AS w FROM match_evidence) JOIN (VALUES "
    + ", ".join(f"('{w}', '{o}')" for w, o in S.ORIENTATION.items()) + ") v(w, orientation) USING (w)",
    "natural_order": f"SELECT evidence_id, row_number() OVER (PARTITION BY job_id ORDER BY k COLLATE C, evidence_id) AS rank FROM (SELECT evidence_id, job_id, array_to_string([CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 10, '0') || ltrim(t, '0') ELSE t END for t in regexp_extract_all(lower(source_filename), '[0-9]+|[^0-9]')], '') AS k FROM {_E})".replace(" COLLATE C", ""),
    "silent_names": f"SELECT job_id, count(*) FILTER (WHERE len([t for t in flatten([regexp_extract_all(p, '[0-9]+|[^0-9]+') for p in regexp_split_to_array({FOLD.format(x=sql_stem('source_filename'))}, '[^a-z0-9]+')]) if len(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({', '.join(repr(p) for p in S.CAMERA_PREFIXES)})]) = 0) AS silent, count(*) AS n FROM {_E} GROUP BY 1",
    "safe_names": f"SELECT evidence_id, lpad(CAST(evidence_id AS VARCHAR), 6, '0') || '_' || regexp_replace({sql_stem('source_filename')}, '[^A-Za-z0-9._-]', '_', 'g') || '.jpg' AS safe_name FROM {_E}",
    "concat_distances": f"WITH r AS (SELECT evidence_id, [CAST(len(x) AS DOUBLE) for x in regexp_extract_all({sql_stem('source_filename')}, '[0-9]+')] AS l FROM {_E}), e AS (SELECT evidence_id, len(l) AS n, list_sum([-(x / list_sum(l)) * ln(x / list_sum(l)) for x in l]) AS h FROM r WHERE len(l) >= 2), q AS (SELECT evidence_id, (n - 1) * (2 - h / ln(n)) AS t FROM e) SELECT evidence_id, round(t, 6) AS distance, round(100 * exp(-0.5 * t), 6) AS confidence FROM q",
    "term_edits": "SELECT header_id, levenshtein({a}, {b}) AS edits FROM header_cells WHERE raw_header IS NOT NULL AND canonical_name IS NOT NULL".format(**{k: f"regexp_replace({FOLD.format(x=c)}, '[^a-z0-9]', '', 'g')" for k, c in (("a", "raw_header"), ("b", "canonical_name"))}),
    "synonym_pairs": "SELECT DISTINCT family_id, lower(family_token) AS term, canonical_id FROM token_evidence JOIN translation_terms ON lower(family_token) = term AND term_domain = 'color' WHERE property_name = 'color'",
}


def _sql_without_noise(x: str, column: str) -> str:
    """The same without looking around: word boundaries stand in for it, as underscores, and percent signs before a
    letter or digit, are out of the way meanwhile."""
    out = f"regexp_replace(translate({x}, '_', chr(3)), '%([A-Za-z0-9])', chr(4) || '\\1', 'g')"
    for pattern in S.NOISE:
        core = pattern.replace("(?i)", "").removeprefix("(?<![A-Za-z0-9])").removesuffix("(?![A-Za-z0-9])")
        flags = "gi" if pattern.startswith("(?i)") else "g"
        percent = "|" + core[: core.index("(?:%")] + "%" if "(?:%|" in core else ""
        out = f"regexp_replace({out}, '\\b(?:{core.replace('(?:%|', '(?:')}\\b{percent})', ' ', '{flags}')"
    out = f"translate(regexp_replace({out}, '\\s+', ' ', 'g'), chr(3) || chr(4), '_%')"
    bare = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    trusted = ", ".join(f"'{t}'" for t in S.TRUSTED)
    return f"CASE WHEN lower(regexp_replace({bare.format(column)}, '[_-]', '', 'g')) IN ({trusted}) THEN {bare.format(x)} ELSE {bare.format(out)} END"


ORACLE["noise_free"] = f"SELECT value_id, CAST(pos - 1 AS INT) AS pos, {_sql_without_noise('v', 'property_name')} AS clean FROM (SELECT value_id, property_name, generate_subscripts(source_values, 1) AS pos, unnest(source_values) AS v FROM property_values) WHERE v IS NOT NULL"
