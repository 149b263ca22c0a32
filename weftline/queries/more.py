"""Folders, narrowing, checks of vocabularies and limits, and prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import strings as S
from weftline.operators import matching as M, ranking as R, rules as U
from weftline.queries.matching import _CAT, _IMG, _POST
from weftline.queries.strings import FOLD
from weftline.queries.tables import RULES
from weftline.session import table

#: Words of folders that tell no products apart (fixed values).
NOISE_FOLDERS = ["hd", "ld", "sd", "web", "print", "packshot", "packshots", "hero", "heroes", "detail", "details", "front", "back", "side", "top", "model", "onmodel", "ghost", "flat", "still", "lifestyle",
                 "thumb", "thumbs", "thumbnail", "thumbnails", "small", "medium", "large", "xl", "hires", "highres", "lowres", "raw", "final", "finals", "edit", "edited", "retouch", "retouched",
                 "images", "image", "photos", "photo", "pictures", "picture", "visuals", "visual", "media", "jpg", "jpeg", "png", "rgb", "cmyk", "dpi", "px", "new", "old", "copy", "temp", "tmp"]
TAXONOMY = {"phenotype": ["packshot", "worn", "detail"], "color": ["black", "navy", "red", "coral", "rust", "copper", "grey", "ivory", "lilac", "mint", "mustard", "olive", "sand", "teal"]}


def telling_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders whose names hold a word of their job's families, with sibling folders that say something too."""
    img, cat = M.names(table(spark, d, "match_evidence")), M.catalogue(table(spark, d, "token_evidence"))
    return M.meaningful_folders(img, M.word_postings(cat), NOISE_FOLDERS)


def folder_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names that say nothing, with their telling folder put before them; all others as they are."""
    img = M.names(table(spark, d, "match_evidence"))
    keys = telling_folders(spark, d).select("grp", "folder").distinct()
    own = img.select("id", "grp", "name", S.folder(F.col("name")).alias("folder"))
    found = own.join(keys.withColumn("tells", F.lit(True)), ["grp", "folder"], "left")
    base = S.basename(F.col("name"))
    return found.select("id", F.when(F.coalesce("tells", F.lit(False)) & S.says_nothing(F.col("name")), F.concat_ws(" ", "folder", base)).otherwise(base).alias("alias"))


def narrowed_families(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched images with the families of their job in the same colour and type that no image is matched to,
    narrowed by the digits in the name: how many are left, and the first."""
    m = table(spark, d, "match_evidence").where("final_family_id IS NULL AND job_id IS NOT NULL AND source_filename IS NOT NULL")
    f = U.feature_map(F.col("image_ngp_summary"))
    img = m.select(F.col("evidence_id").alias("id"), F.col("job_id").alias("grp"), F.col("source_filename").alias("name"), F.try_element_at(f, F.lit("color")).alias("color"), F.try_element_at(f, F.lit("type")).alias("type")).where("color IS NOT NULL AND type IS NOT NULL")
    used = table(spark, d, "match_evidence").where("final_family_id IS NOT NULL").select(F.col("job_id").alias("grp"), F.col("final_family_id").alias("rec")).distinct()
    cand = M.feature_candidates(img, table(spark, d, "token_evidence"), table(spark, d, "translation_terms"), used)
    toks = img.join(cand.select("id").distinct(), "id", "left_semi").select("id", F.posexplode(M.digit_tokens(F.col("name"))).alias("n", "key"))
    left = M.narrowed(cand, toks, M.digit_postings(M.catalogue(table(spark, d, "token_evidence"))))
    return left.groupBy("id").agg(F.count("*").alias("families"), F.min("rec").alias("first_family"))


def jobs_without_families(spark: SparkSession, d: str) -> DataFrame:
    """Jobs' days with images and no family noted that day, whose images all stay unmatched."""
    fam = table(spark, d, "token_evidence").where("family_id IS NOT NULL").select("job_id", F.to_date("noted_at").alias("day")).distinct()
    return table(spark, d, "match_evidence").groupBy("job_id", F.to_date("decided_at").alias("day")).agg(F.count("*").alias("images")).join(fam, ["job_id", "day"], "left_anti").withColumn("day", F.col("day").cast("string"))


def unknown_features(spark: SparkSession, d: str) -> DataFrame:
    """Values of checked features that the taxonomy lacks, and names in rules that it lacks."""
    pairs = table(spark, d, "match_evidence").select(F.explode(U.feature_map(F.col("image_ngp_summary"))).alias("feature", "value")).where(F.col("feature").isin(list(TAXONOMY)))
    bad = F.lit(False)
    for f, vs in TAXONOMY.items():
        bad = bad | ((F.col("feature") == f) & ~F.col("value").isin(vs))
    used = sorted({(c.feature, v) for r in RULES for c in r.conditions for v in ((c.equals,) if c.equals else c.one_of) if c.feature in TAXONOMY and v not in TAXONOMY[c.feature]})
    return pairs.where(bad).groupBy("feature", "value").agg(F.count("*").alias("n")).union(spark.createDataFrame([(f, v, 0) for f, v in used], "feature string, value string, n long"))


def unlisted_values(spark: SparkSession, d: str) -> DataFrame:
    """Colours and product types of delivered images that the list has under no term, with how often they come."""
    terms = table(spark, d, "translation_terms").where("term_domain IN ('color', 'producttype')").select("term_domain", S.normalized_term(F.col("term")).alias("key")).distinct()
    m = table(spark, d, "dedup_members")
    told = m.select(F.inline(F.array(F.struct(F.lit("color").alias("term_domain"), F.col("color_name").alias("value")), F.struct(F.lit("producttype").alias("term_domain"), F.col("product_type").alias("value"))))).where("value IS NOT NULL")
    counts = told.groupBy("term_domain", "value").agg(F.count("*").alias("n")).withColumn("key", S.normalized_term(F.col("value")))
    return counts.join(terms, ["term_domain", "key"], "left_anti").select("term_domain", "value", "n")


def repeated_names(spark: SparkSession, d: str) -> DataFrame:
    """File names of a job that come more than once without case, by their first image."""
    m = table(spark, d, "match_evidence")
    return m.groupBy("job_id", F.lower("source_filename").alias("name")).agg(F.count("*").alias("times"), F.min("evidence_id").alias("first_id")).where("times > 1")


def over_limits(spark: SparkSession, d: str) -> DataFrame:
    """Jobs against the least and most images that a batch may have."""
    return table(spark, d, "match_evidence").groupBy("job_id").agg(F.count("*").alias("images")).select("job_id", "images", F.when(F.col("images") < 1, "too few").when(F.col("images") > 10_000, "too many").otherwise("fits").alias("batch"))


def ordered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Images of a job in chunks of eight, in the order of their ids."""
    m = table(spark, d, "match_evidence").where("job_id IS NOT NULL").select("evidence_id", "job_id")
    n = R.numbered(m, "job_id", ["evidence_id"], "n")
    return n.select("evidence_id", "job_id", F.floor((F.col("n") - 1) / 8).cast("long").alias("chunk"))


def prompt_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Captions as ids of a public vocabulary: how many, the last, and their sum."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from weftline.functions.tensors import END, prompt_ids
        for pdf in batches:
            ids = prompt_ids(pdf["caption"].tolist())
            yield pd.DataFrame({"caption": pdf["caption"], "n_ids": (ids == END).argmax(axis=1) + 1, "id_sum": ids.sum(axis=1)})

    captions = table(spark, d, "dedup_members").where("caption IS NOT NULL").select("caption").distinct()
    return captions.mapInPandas(encode, "caption string, n_ids long, id_sum long")


QUERIES = {f.__name__: f for f in (telling_folders, folder_aliases, narrowed_families, jobs_without_families, unknown_features, unlisted_values, repeated_names, over_limits, ordered_chunks, prompt_tokens)}

_DULL = ", ".join(f"'{w}'" for w in [*NOISE_FOLDERS, *S.CAMERA_PREFIXES])
_FOLDERS = f"""{_IMG}, {_CAT}, path AS (SELECT DISTINCT grp, regexp_extract(name, '^(.*)[/\\\\][^/\\\\]*$', 1) AS path FROM img),
fol AS (SELECT grp, regexp_extract(path, '^(.*?)[/\\\\]?[^/\\\\]*$', 1) AS parent, regexp_extract(path, '([^/\\\\]*)$', 1) AS folder FROM path WHERE path <> ''),
tell AS (SELECT * FROM (SELECT grp, parent, folder, [t for t in flatten([regexp_extract_all(p, '[0-9]+|[^0-9]+') for p in regexp_split_to_array({FOLD.format(x='folder')}, '[^a-z0-9]+')]) if len(t) >= 2 AND t NOT IN ({_DULL}) AND (NOT regexp_matches(t, '^[0-9]+$') OR len(t) >= 5)] AS words FROM fol) WHERE len(words) > 0),
lex AS (SELECT DISTINCT grp, key FROM (SELECT grp, unnest(regexp_split_to_array(lower(value), '[^a-zà-öø-ÿ0-9]+')) AS key FROM cat WHERE prop <> 'family_id') WHERE len(key) >= 2 AND NOT regexp_matches(key, '^[0-9]+$')),
good AS (SELECT DISTINCT t.grp, t.parent, t.folder FROM (SELECT grp, parent, folder, unnest(words) AS key FROM tell) t JOIN lex USING (grp, key) WHERE (t.grp, t.parent) IN (SELECT (grp, parent) FROM tell GROUP BY grp, parent HAVING count(*) >= 2))"""
_SILENT = f"len([t for t in flatten([regexp_extract_all(p, '[0-9]+|[^0-9]+') for p in regexp_split_to_array({FOLD.format(x='s')}, '[^a-z0-9]+')]) if len(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({', '.join(repr(p) for p in S.CAMERA_PREFIXES)})]) = 0"
_F = "nullif(regexp_extract(coalesce(image_ngp_summary, ''), '(?:^|;){0}=([^;]*)', 1), '')"
ORACLE = {
    "telling_folders": f"WITH {_FOLDERS} SELECT * FROM good",
    "folder_aliases": f"WITH {_FOLDERS} SELECT id, CASE WHEN {_SILENT} AND (grp, regexp_extract(name, '([^/\\\\]+)[/\\\\][^/\\\\]*$', 1)) IN (SELECT (grp, folder) FROM good) THEN regexp_extract(name, '([^/\\\\]+)[/\\\\][^/\\\\]*$', 1) || ' ' || regexp_extract(name, '([^/\\\\]*)$', 1) ELSE regexp_extract(name, '([^/\\\\]*)$', 1) END AS alias FROM img",
    "jobs_without_families": "SELECT job_id, CAST(CAST(decided_at AS DATE) AS VARCHAR) AS day, count(*) AS images FROM match_evidence m WHERE NOT EXISTS (SELECT 1 FROM token_evidence t WHERE t.family_id IS NOT NULL AND t.job_id = m.job_id AND CAST(t.noted_at AS DATE) = CAST(m.decided_at AS DATE)) GROUP BY 1, 2",
    "unknown_features": "SELECT feature, value, count(*) AS n FROM (SELECT split_part(p, '=', 1) AS feature, split_part(p, '=', 2) AS value FROM (SELECT unnest(string_split(image_ngp_summary, ';')) AS p FROM match_evidence)) WHERE " + " OR ".join(f"(feature = '{f}' AND value NOT IN ({', '.join(repr(v) for v in vs)}))" for f, vs in TAXONOMY.items()) + " GROUP BY 1, 2",
    "unlisted_values": f"WITH v AS (SELECT 'color' AS term_domain, color_name AS value FROM dedup_members UNION ALL SELECT 'producttype', product_type FROM dedup_members) SELECT term_domain, value, count(*) AS n FROM v WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM translation_terms t WHERE t.term_domain = v.term_domain AND regexp_replace({FOLD.format(x='t.term')}, '[^a-z0-9]', '', 'g') = regexp_replace({FOLD.format(x='v.value')}, '[^a-z0-9]', '', 'g')) GROUP BY 1, 2",
    "repeated_names": "SELECT job_id, lower(source_filename) AS name, count(*) AS times, min(evidence_id) AS first_id FROM match_evidence GROUP BY 1, 2 HAVING count(*) > 1",
    "over_limits": "SELECT job_id, count(*) AS images, CASE WHEN count(*) < 1 THEN 'too few' WHEN count(*) > 10000 THEN 'too many' ELSE 'fits' END AS batch FROM match_evidence GROUP BY 1",
    "ordered_chunks": "SELECT evidence_id, job_id, CAST((row_number() OVER (PARTITION BY job_id ORDER BY evidence_id) - 1) // 8 AS BIGINT) AS chunk FROM match_evidence WHERE job_id IS NOT NULL",
}

_NARROWED = f"""WITH {_IMG}, {_CAT}, {_POST}, terms AS (SELECT DISTINCT term_domain, lower(term) AS term, canonical_id FROM translation_terms WHERE term_domain IN ('color', 'producttype')),
own AS (SELECT DISTINCT m.evidence_id AS id, job_id AS grp, c.canonical_id AS c, t.canonical_id AS t FROM match_evidence m JOIN terms c ON c.term_domain = 'color' AND c.term = {_F.format('color')} JOIN terms t ON t.term_domain = 'producttype' AND t.term = {_F.format('type')}
  WHERE final_family_id IS NULL AND job_id IS NOT NULL AND source_filename IS NOT NULL),
fam AS (SELECT DISTINCT a.job_id AS grp, a.family_id AS rec, c.canonical_id AS c, t.canonical_id AS t FROM token_evidence a JOIN terms c ON c.term_domain = 'color' AND c.term = lower(a.family_token) JOIN token_evidence b ON b.job_id = a.job_id AND b.family_id = a.family_id JOIN terms t ON t.term_domain = 'producttype' AND t.term = lower(b.family_token)
  WHERE a.property_name = 'color' AND b.property_name = 'producttype'),
l0 AS (SELECT DISTINCT id, grp, rec FROM own JOIN fam USING (grp, c, t) WHERE (grp, rec) NOT IN (SELECT (job_id, final_family_id) FROM match_evidence WHERE final_family_id IS NOT NULL AND job_id IS NOT NULL)),
tk AS (SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY min(n)) - 1 AS n FROM (SELECT id, generate_subscripts(ks, 1) AS n, unnest(ks) AS key FROM (SELECT id, list_concat(regexp_extract_all(s, '[0-9]+'), [regexp_replace(s, '[^0-9]', '', 'g')]) AS ks FROM img)) WHERE len(key) >= 5 GROUP BY 1, 2)""" + "".join(
    f""", h{k} AS (SELECT l{k}.*, EXISTS (SELECT 1 FROM post p WHERE p.grp = l{k}.grp AND p.rec = l{k}.rec AND p.key = tk.key) AS has FROM l{k} JOIN tk USING (id) WHERE n = {k}),
s{k} AS (SELECT id FROM h{k} GROUP BY 1 HAVING bool_or(has) AND NOT bool_and(has)),
l{k + 1} AS (SELECT * FROM l{k} WHERE id NOT IN (SELECT id FROM s{k}) UNION ALL SELECT id, grp, rec FROM h{k} WHERE has AND id IN (SELECT id FROM s{k}))""" for k in range(8)) + " SELECT id, count(*) AS families, min(rec) AS first_family FROM l8 GROUP BY 1"
ORACLE["narrowed_families"] = _NARROWED
