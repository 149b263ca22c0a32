"""Profiles, collated records, rules, choices and aggregates over the project's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import geometry as G, strings as S
from weftline.operators import matching as M, profile as P, ranking as R, rules as U, similarity as H, stats as A
from weftline.queries.strings import FOLD, sql_stem
from weftline.functions.text import strip
from weftline.session import materialize, table

FAMILY_COLUMNS = [("dedup_members", "family_id"), ("match_evidence", "final_family_id"), ("property_values", "family_id"), ("token_evidence", "family_id"), ("documents", "family_id")]
PROFILED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "worksheet_rows", "property_values", "header_cells", "translation_terms",
            "match_evidence", "token_evidence", "dedup_members", "family_conflicts", "benchmark_items", "reading_labels", "source_trust"]


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Fill, distinct values, length and kind of every column of all tables that is text or a whole number."""
    frames = []
    for t in PROFILED:
        df = table(spark, d, t)
        text = [c for c, kind in df.dtypes if kind in ("string", "int", "bigint")]
        frames.append(P.long_form(df.select(*text), t))
    return P.profile(P.union_all(frames))


def column_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Family numbers of several tables that share many values."""
    v = P.union_all([table(spark, d, t).select(F.lit(t).alias("col"), strip(F.col(c)).alias("value")) for t, c in FAMILY_COLUMNS])
    return P.overlaps(v).select("a", "b", "shared", F.round("ratio", 6).alias("ratio"))


def merged_columns(spark: SparkSession, d: str) -> DataFrame:
    """The group of each table's family numbers: those with overlapping values go together, from left to right."""
    from pyspark.sql import types as T
    pairs = column_overlaps(spark, d)
    cols = F.array(*[F.lit(t) for t, _ in FAMILY_COLUMNS])
    gathered = pairs.agg(F.collect_list(F.struct("a", "b")).alias("pairs")).select(cols.alias("cols"), "pairs")  # at most one pair per two tables
    group = F.udf(lambda cs, ps: P.merged_groups(cs, [(p["a"], p["b"]) for p in ps]), T.MapType(T.StringType(), T.StringType()))
    return gathered.select(F.explode(group("cols", "pairs")).alias("col", "leader"))


def key_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that are filled in every row and hold each value once."""
    return column_profile(spark, d).where("n_values = filled AND filled = n_rows").select("tab", "col")


def filled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each sheet with any filled cell, and their filled cells."""
    rows = table(spark, d, "worksheet_rows")
    n = F.size(F.filter("cells", lambda c: strip(c) != ""))
    return rows.select("source_file", "sheet_name", n.alias("n")).where("n > 0").groupBy("source_file", "sheet_name").agg(F.count("*").alias("rows"), F.sum("n").alias("cells"))


def dense_width(spark: SparkSession, d: str) -> DataFrame:
    """Every sheet as a rectangle: its rows padded with empty cells to the widest, as counts."""
    rows = table(spark, d, "worksheet_rows").where("cells IS NOT NULL").select("source_file", "sheet_name", F.size("cells").alias("w"))
    g = rows.groupBy("source_file", "sheet_name").agg(F.max("w").alias("width"), F.count("*").alias("height"), F.sum("w").alias("given"))
    return g.select("source_file", "sheet_name", "width", "height", (F.col("width") * F.col("height") - F.col("given")).alias("padded"))


def _headers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = table(spark, d, "header_cells")
    raw = F.coalesce("raw_header", F.lit(""))
    cells = h.select("header_id", "source_file", "sheet_name", "column_index", raw.alias("raw"), S.header_tokens(raw).alias("words"))
    cells = cells.withColumn("phrase", F.array_join("words", " "))
    terms = table(spark, d, "translation_terms").where("term_domain = 'header'").select("canonical_id", F.array_join(S.header_tokens(F.col("term")), " ").alias("term"))
    return cells, terms


def header_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The meanings of each header cell with their confidence."""
    cells, terms = _headers(spark, d)
    return P.header_matches(cells, terms, S.STOP_GENERAL)


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sheets whose header cells are understood in at least two of five, with the mean confidence."""
    cells, terms = _headers(spark, d)
    best = P.header_matches(cells, terms, S.STOP_GENERAL).groupBy("header_id").agg(F.max("confidence").alias("c"))
    g = cells.where("phrase <> ''").join(best, "header_id", "left").groupBy("source_file", "sheet_name").agg(F.count("*").alias("filled"), F.count("c").alias("matched"), F.round(F.avg("c"), 6).alias("confidence"))
    return g.where("matched >= 0.4 * filled")


def header_ids(spark: SparkSession, d: str) -> DataFrame:
    """The one meaning of each header cell by its phrase or all its words, else the header itself."""
    cells, terms = _headers(spark, d)
    return P.whole_header_ids(cells, terms, S.STOP_GENERAL)


def property_values_of(spark: SparkSession, d: str) -> DataFrame:
    """Distinct trimmed values of each family and property, with the cells they come from."""
    v = table(spark, d, "property_values")
    cells = F.coalesce(F.size("source_locations"), F.lit(0))
    e = v.select("family_id", P_name().alias("property"), F.explode("source_values").alias("v"), cells.alias("cells"))
    return e.where(strip(F.col("v")) != "").groupBy("family_id", "property", strip(F.col("v")).alias("value")).agg(F.count("*").alias("times"), F.max("cells").alias("cells"))


def P_name():
    return F.lower(F.regexp_replace("property_name", "[^\\p{L}\\p{Nd}]+", ""))


def collated_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per family and property with values, tokens, canonical value and conflict."""
    v = table(spark, d, "property_values").select("family_id", P_name().alias("property"), F.explode("source_values").alias("v"))
    c = P.collate(v, ["family_id", "property"], "v")
    return c.select("family_id", "property", F.size("values").alias("n_values"), F.array_join("tokens", " ").alias("tokens"), "canonical", "conflict")


def conflicting_properties(spark: SparkSession, d: str) -> DataFrame:
    """Families' properties with more than one value."""
    return collated_records(spark, d).where("conflict").select("family_id", "property", "n_values")


def empty_properties(spark: SparkSession, d: str) -> DataFrame:
    """Whether each property is filled for any family."""
    v = table(spark, d, "property_values")
    filled = F.coalesce(F.exists("source_values", lambda x: strip(x) != ""), F.lit(False))
    return v.groupBy(P_name().alias("property")).agg((~F.bool_or(filled)).alias("is_empty"), F.count("*").alias("n"))


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "worksheet_rows")
    trimmed = F.transform("cells", lambda c: strip(c))
    lone = rows.where(~F.coalesce(F.exists(trimmed, lambda c: c.rlike("^[0-9]{8}$")), F.lit(False))).select("row_id", "source_file", "sheet_name", "cells")
    fam = table(spark, d, "token_evidence").where("family_token IS NOT NULL AND family_id IS NOT NULL")
    keys = lone.select("row_id", F.explode("cells").alias("c")).where("c IS NOT NULL").select("row_id", F.explode(P.digit_keys(F.col("c"))).alias("key")).distinct()
    own = fam.select(F.col("family_id").alias("rec"), F.explode(P.digit_keys(F.col("family_token"))).alias("key")).distinct()
    return lone, P.orphan_owner(keys, own)


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sheet rows without a family number that share a number with exactly one family."""
    return _orphans(spark, d)[1]


def orphan_tallies(spark: SparkSession, d: str) -> DataFrame:
    """How many of each sheet's rows without a family number were joined."""
    lone, owned = _orphans(spark, d)
    return lone.join(owned, "row_id", "left").groupBy("source_file", "sheet_name").agg(F.count("rec").alias("joined"), F.count("*").alias("total"))


C = U.Condition
RULES = [
    U.Rule("worn coloured", (C("phenotype", equals="worn"), C("color", one_of=("red", "coral", "rust", "copper")))),
    U.Rule("detail of bag or belt", (C("phenotype", equals="detail"), C(any_of=(C("type", equals="bag"), C("type", equals="belt"))))),
    U.Rule("packshot", (C("phenotype", equals="packshot"),)),
    U.Rule("dark", (C("color", one_of=("black", "navy")),)),
]


def _features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "match_evidence").select("evidence_id", F.coalesce(U.feature_map(F.col("image_ngp_summary")), F.create_map().cast("map<string,string>")).alias("f"))


def rules_satisfied(spark: SparkSession, d: str) -> DataFrame:
    """All rules that hold for each image, and the first."""
    f = F.col("f")
    return _features(spark, d).select("evidence_id", F.array_join(U.satisfied(RULES, f), ",").alias("rules"), U.first_satisfied(RULES, f).alias("first_rule"))


def rules_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Rules that nothing known about an image contradicts, and the name it is settled on."""
    f = F.col("f")
    return _features(spark, d).select("evidence_id", F.array_join(U.remaining(RULES, f), ",").alias("pool"), U.settled(RULES, f, F.lit("dark")).alias("settled"))


def feature_values(spark: SparkSession, d: str) -> DataFrame:
    """Features in use and their values, for the check of rules against a taxonomy."""
    return _features(spark, d).select(F.explode("f").alias("feature", "value")).groupBy("feature", "value").agg(F.count("*").alias("n"))


VIEWS = {0: ["front", "hero", "pack"], 1: ["back"], 2: ["side"], 3: ["det1", "det2", "detail"]}


def _shots(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "match_evidence").where("final_family_id IS NOT NULL")
    words = F.split(F.lower(S.stem(F.col("source_filename"))), "[/\\\\_\\- .()]+")
    return m.select(F.col("final_family_id").alias("family"), "evidence_id", "source_filename", "final_score", words.alias("words"), S.natural_key(F.col("source_filename")).alias("natural"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    shots = _shots(spark, d)
    slots = F.array(*[F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in ws])), F.lit(s)) for s, ws in VIEWS.items()])
    cand = shots.select("family", "evidence_id", (-F.coalesce("final_score", F.lit(0.0))).alias("neg"), "natural", F.explode(F.array_compact(slots)).alias("slot"))
    return R.fill_slots(cand, list(VIEWS), "family", "evidence_id", ["neg", "natural"])


def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each family's display slots with the image that takes them: best score, then natural name."""
    return _assigned(spark, d)


#: Phenotypes that each display slot takes, the best first.
PHENOTYPE_SLOTS = {0: ["packshot"], 1: ["worn", "packshot"], 2: ["detail", "worn"], 3: ["detail"]}


def _phenotype_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Images that may take a slot, with their phenotype's place in its list."""
    m = table(spark, d, "match_evidence").where("final_family_id IS NOT NULL")
    kind = F.try_element_at(U.feature_map(F.col("image_ngp_summary")), F.lit("phenotype"))
    shots = m.select(F.col("final_family_id").alias("family"), "evidence_id", kind.alias("kind"), (-F.coalesce("final_score", F.lit(0.0))).alias("neg"), S.orientation(F.col("source_filename")).isNull().cast("int").alias("unhinted"), F.col("source_filename").alias("name")).where("kind IS NOT NULL")
    may = F.array_compact(F.array(*[F.when(F.col("kind") == k, F.struct(F.lit(s).alias("slot"), F.lit(n).alias("place"))) for s, ks in PHENOTYPE_SLOTS.items() for n, k in enumerate(ks)]))
    return shots.select("*", F.inline(may))


def phenotype_slots(spark: SparkSession, d: str) -> DataFrame:
    """Each family's display slots with the image that takes them: by the phenotype's place in the slot's list, then the
    best score, the camera's place told by the name, and the name."""
    return R.fill_slots(_phenotype_candidates(spark, d), list(PHENOTYPE_SLOTS), "family", "evidence_id", ["place", "neg", "unhinted", "name"])


def product_types(spark: SparkSession, d: str) -> DataFrame:
    """What each value of a product type means: the list's id itself, else the whole phrase, else its first known word."""
    terms = table(spark, d, "translation_terms").where("term_domain = 'producttype'")
    phrase = terms.groupBy(S.normalized_term(F.col("term")).alias("key")).agg(F.min("canonical_id").alias("id"))
    slug = terms.select(F.col("canonical_id").alias("slug")).distinct()
    v = table(spark, d, "dedup_members").where("product_type IS NOT NULL").select(F.col("product_type").alias("value")).distinct()
    v = v.select("value", F.translate(F.lower(strip(F.col("value"))), " _", "--").alias("slug"), S.normalized_term(F.col("value")).alias("key"))
    words = v.select("value", F.posexplode(S.alphanumeric_words(F.col("value"))).alias("n", "word")).select("value", "n", S.normalized_term(F.col("word")).alias("key")).join(phrase, "key")
    first = words.groupBy("value").agg(F.min(F.struct("n", "id"))["id"].alias("by_word"))
    out = v.join(slug.withColumn("by_slug", F.col("slug")), "slug", "left").join(phrase.withColumnRenamed("id", "by_phrase"), "key", "left").join(first, "value", "left")
    return out.select("value", F.coalesce("by_slug", "by_phrase", "by_word").alias("type_id"))


def overflow_order(spark: SparkSession, d: str) -> DataFrame:
    """Images without a slot, numbered behind the slots in natural order."""
    taken = _assigned(spark, d)
    rest = _shots(spark, d).select("family", "evidence_id", "natural").join(taken.select("family", "evidence_id"), ["family", "evidence_id"], "left_anti")
    return R.numbered(rest, "family", ["natural", "evidence_id"], "n").select("family", "evidence_id", (F.col("n") + len(VIEWS) - 1).alias("position"))


def compact_order(spark: SparkSession, d: str) -> DataFrame:
    """All images of a family numbered from 0 without gaps: slots first, then the rest in natural order."""
    taken = _assigned(spark, d)
    all_ = _shots(spark, d).select("family", "evidence_id", "natural").join(taken, ["family", "evidence_id"], "left").withColumn("slot", F.coalesce("slot", F.lit(len(VIEWS))))
    return R.numbered(all_, "family", ["slot", "natural", "evidence_id"], "n").select("family", "evidence_id", (F.col("n") - 1).alias("position"))


def first_images(spark: SparkSession, d: str) -> DataFrame:
    """The first image of each family by score, name and id."""
    return R.first_of(_shots(spark, d), ["family"], [-F.coalesce("final_score", F.lit(0.0)), F.lower("source_filename"), F.col("evidence_id")], ["evidence_id", "source_filename"])


def first_types(spark: SparkSession, d: str) -> DataFrame:
    """The first product type known of each family, as the list's id; the default if there is none."""
    t = table(spark, d, "token_evidence").where("family_id IS NOT NULL")
    terms = table(spark, d, "translation_terms").where("term_domain = 'producttype'").groupBy(F.lower("term").alias("term")).agg(F.min("canonical_id").alias("type_id"))
    known = t.where("property_name = 'producttype'").select("family_id", "token_id", F.lower("family_token").alias("term")).join(terms, "term")
    best = R.first_of(known, ["family_id"], [F.col("token_id")], ["type_id"])
    return t.select("family_id").distinct().join(best, "family_id", "left").select("family_id", F.coalesce("type_id", F.lit("type-other")).alias("type_id"))


def first_postings(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each family and token."""
    t = table(spark, d, "token_evidence").where("family_token IS NOT NULL")
    return t.groupBy("family_id", F.lower("family_token").alias("token")).agg(F.min("token_id").alias("token_id"))


def strongest_values(spark: SparkSession, d: str) -> DataFrame:
    """Each family's property with the token of the highest score; the earlier of equal ones."""
    t = table(spark, d, "token_evidence").where("score IS NOT NULL AND family_token IS NOT NULL")
    return R.first_of(t, ["family_id", "property_name"], [-F.col("score"), F.col("token_id")], ["family_token", "score"])


def tie_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What decided between the first two images of each family: score, name or order."""
    s = _shots(spark, d).select("family", (-F.coalesce("final_score", F.lit(0.0))).alias("neg"), F.lower("source_filename").alias("low"), "evidence_id")
    first = s.groupBy("family").agg(F.min(F.struct("neg", "low", "evidence_id")).alias("a"))
    second = s.join(first, "family").where("evidence_id <> a.evidence_id").groupBy("family").agg(F.min(F.struct("neg", "low", "evidence_id")).alias("b"))
    both = first.join(second, "family", "left")
    return both.select("family", F.when(F.col("b").isNull(), "none").when(F.col("a.neg") < F.col("b.neg"), "score").when(F.col("a.low") < F.col("b.low"), "name").otherwise("order").alias("reason"))


def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Families in which two images would get the same new name: the whole family is named."""
    s = _shots(spark, d).select("family", F.element_at("words", -1).alias("view"))
    return s.groupBy("family", "view").agg(F.count("*").alias("n")).groupBy("family").agg(F.max("n").alias("most")).where("most > 1")


def new_names(spark: SparkSession, d: str) -> DataFrame:
    """The new name of each matched image from its family and place."""
    return compact_order(spark, d).select("evidence_id", F.concat_ws("", "family", F.lit("_det"), F.col("position").cast("string"), F.lit(".jpg")).alias("new_name"))


def small_families(spark: SparkSession, d: str) -> DataFrame:
    """Groups with at most one image, by the size of their largest: skipped, too small, or open for generation."""
    g = table(spark, d, "dedup_members").groupBy("group_id").agg(F.count("*").alias("n"), F.max("normalized_width").alias("w"), F.max("normalized_height").alias("h"))
    small = (F.col("w") > 0) & (F.col("w") < 1600) | (F.col("h") > 0) & (F.col("h") < 1600)
    return g.select("group_id", F.when(F.col("n") > 1, "skipped").when(F.coalesce(small, F.lit(False)), "low quality").otherwise("open").alias("gate"))


def candidate_families(spark: SparkSession, d: str) -> DataFrame:
    """Images with the number of families that any digit key of theirs leads to."""
    img, cat = M.names(table(spark, d, "match_evidence")), M.catalogue(table(spark, d, "token_evidence"))
    tokens = img.select("id", "grp", F.explode(M.digit_tokens(F.col("name"))).alias("key"))
    return tokens.join(M.digit_postings(cat), ["grp", "key"]).select("id", "rec").distinct().groupBy("id").agg(F.count("*").alias("families"))


def profile_words(spark: SparkSession, d: str) -> DataFrame:
    """How many images of a job carry each profile word, and whether it is too common to tell them apart."""
    img = M.names(table(spark, d, "match_evidence"))
    words = img.select("grp", F.explode(S.profile_tokens(F.col("name"))).alias("word")).groupBy("grp", "word").agg(F.count("*").alias("n"))
    total = img.groupBy("grp").agg(F.count("*").alias("total"))
    return words.join(total, "grp").select("grp", "word", "n", (F.col("n") > F.greatest(F.lit(10.0), 0.5 * F.col("total"))).alias("common"))


def counts_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Images of each family and phenotype."""
    m = table(spark, d, "match_evidence").where("final_family_id IS NOT NULL")
    ph = F.coalesce(F.try_element_at(U.feature_map(F.col("image_ngp_summary")), F.lit("phenotype")), F.lit("UNKNOWN"))
    return m.groupBy(F.col("final_family_id").alias("family"), ph.alias("phenotype")).agg(F.count("*").alias("n"))


def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of images, matched ones and those left out, by job."""
    m = table(spark, d, "match_evidence")
    return m.groupBy("job_id").agg(F.count("*").alias("images"), F.count_if("is_ko").alias("left_out"), F.count("final_family_id").alias("matched"), F.countDistinct("final_family_id").alias("families"))


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per image with status, reason, family and new name."""
    m = table(spark, d, "match_evidence")
    status = F.when(F.col("is_ko"), "left out").otherwise("ok")
    reason = F.when(F.col("is_ko"), F.coalesce("ko_reason", F.lit("UNSTATED")))
    return m.join(new_names(spark, d), "evidence_id", "left").select("evidence_id", "source_filename", status.alias("status"), reason.alias("reason"), F.col("final_family_id").alias("family"), "new_name")


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Done and failed images of each matcher and job, with the first and last time."""
    m = table(spark, d, "match_evidence")
    return m.groupBy("job_id", F.coalesce("accepted_matcher_name", F.lit("none")).alias("matcher")).agg(F.count("*").alias("done"), F.count_if("is_ko").alias("failed"), F.min("decided_at").alias("first_at"), F.max("decided_at").alias("last_at"))


def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The ten jobs decided last."""
    g = table(spark, d, "match_evidence").where("decided_at IS NOT NULL").groupBy("job_id").agg(F.max("decided_at").alias("last_at"))
    return g.orderBy(F.desc("last_at"), "job_id").limit(10)


def past_retention(spark: SparkSession, d: str) -> DataFrame:
    """Images decided more than 24 hours before the last decision of their job, by job."""
    m = table(spark, d, "match_evidence").where("decided_at IS NOT NULL")
    last = m.groupBy("job_id").agg(F.max("decided_at").alias("last_at"))
    return m.join(last, "job_id").groupBy("job_id").agg(F.count_if(F.expr("decided_at < last_at - INTERVAL 24 HOURS")).alias("old"), F.count("*").alias("n"))


def ordered_import(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered image with its place in the import order: name, bytes, width, height, id."""
    m = table(spark, d, "dedup_members").select("member_id", F.coalesce("initial_full_name", F.lit("")).alias("name"), F.coalesce("bytes_length", F.lit(-1)).alias("b"), F.coalesce("normalized_width", F.lit(-1)).alias("w"), F.coalesce("normalized_height", F.lit(-1)).alias("h"), F.lit(0).alias("one"))
    return R.numbered(m, "one", ["name", "b", "w", "h", "member_id"], "place").select("member_id", "place")


def canonical_sets(spark: SparkSession, d: str) -> DataFrame:
    """Families' tokens against file tokens: union, intersection, difference and containment, as sizes."""
    t = table(spark, d, "token_evidence").where("family_id IS NOT NULL")
    both = F.array(F.struct(F.lower("family_token").alias("token"), F.lit(True).alias("a"), F.lit(False).alias("b")), F.struct(F.lower("filename_token").alias("token"), F.lit(False).alias("a"), F.lit(True).alias("b")))
    flags = t.select("family_id", F.inline(both)).groupBy("family_id", "token").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).withColumn("held", F.col("token").isNotNull())
    return flags.groupBy("family_id").agg(F.count_if("held").alias("in_any"), F.count_if(F.expr("held AND a AND b")).alias("in_both"), F.count_if(F.expr("held AND a AND NOT b")).alias("only_family"), (F.count_if(F.expr("held AND b AND NOT a")) == 0).alias("contained"))


def unassigned_families(spark: SparkSession, d: str) -> DataFrame:
    """Families that no image of their job was matched to."""
    t = table(spark, d, "token_evidence").where("family_id IS NOT NULL").select("job_id", "family_id").distinct()
    used = table(spark, d, "match_evidence").where("NOT is_ko").select("job_id", F.col("final_family_id").alias("family_id"))
    return t.join(used, ["job_id", "family_id"], "left_anti")


def enriched_images(spark: SparkSession, d: str) -> DataFrame:
    """Matched images with their family's first colour token; the first row wins where there are several."""
    first = R.first_of(table(spark, d, "token_evidence").where("property_name = 'color' AND family_token IS NOT NULL"), ["job_id", "family_id"], [F.col("token_id")], ["family_token"])
    m = table(spark, d, "match_evidence").where("final_family_id IS NOT NULL").select("evidence_id", "job_id", F.col("final_family_id").alias("family_id"))
    return m.join(first, ["job_id", "family_id"], "left").select("evidence_id", "family_id", F.col("family_token").alias("color"))


def label_families(spark: SparkSession, d: str) -> DataFrame:
    """Images whose summary agrees with a family of their job in colour and type, in both: the families' number."""
    terms = table(spark, d, "translation_terms").where("term_domain IN ('color', 'producttype')").select(F.lower("term").alias("term"), "canonical_id").distinct()
    tags = _features(spark, d).select("evidence_id", F.explode("f").alias("feature", "value")).where("feature IN ('color', 'type')").join(terms, F.col("value") == F.col("term")).select("evidence_id", "canonical_id")
    both = tags.groupBy("evidence_id").agg(F.min("canonical_id").alias("a"), F.max("canonical_id").alias("b")).where("a < b")
    img = both.join(table(spark, d, "match_evidence").select("evidence_id", "job_id"), "evidence_id").groupBy("job_id", "a", "b").agg(F.count("*").alias("images"))
    fam = table(spark, d, "token_evidence").where("property_name IN ('color', 'producttype')").select("job_id", "family_id", F.lower("family_token").alias("term")).join(terms, "term").select("job_id", "family_id", "canonical_id").distinct()
    a, b = fam.select("job_id", "family_id", F.col("canonical_id").alias("a")), fam.select("job_id", "family_id", F.col("canonical_id").alias("b"))
    held = a.join(b, ["job_id", "family_id"]).where("a < b").groupBy("job_id", "a", "b").agg(F.count("*").alias("families"))
    return img.join(held, ["job_id", "a", "b"])


def softmax_winners(spark: SparkSession, d: str) -> DataFrame:
    """The greatest of each vector's first ten numbers as a share of their exponentials."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("v"))
    names = F.array(*[F.lit(f"d{i}") for i in range(10)])
    w = e.select("vec_id", A.winner(names, A.softmax(F.col("v"))).alias("w"))
    return w.select("vec_id", "w.name", F.round("w.score", 6).alias("share"), (F.col("w.score") >= 0.25).alias("influential"))


def converged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores raised where a matcher's name and a summary both speak for them."""
    m = table(spark, d, "match_evidence")
    return m.select("evidence_id", F.round(A.convergence(F.coalesce("final_score", F.lit(0.0)), [F.col("accepted_matcher_name").isNotNull(), F.col("image_ngp_summary").isNotNull()]), 6).alias("score"))


def _colours(spark: SparkSession, d: str) -> DataFrame:
    """Every three numbers of a vector as a colour (vec_id, label, place, r, g, b)."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)).alias("place"))
    at = lambda k: F.get("embedding", F.col("place") * 3 + k).cast("double")
    return e.select("vec_id", "label", "place", *[F.least(F.lit(255), F.greatest(F.lit(0), F.floor((at(k) + 1) * 127.5))).cast("int").alias(c) for k, c in enumerate("rgb")])


def colour_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The four most frequent colour buckets of each label."""
    return A.top_buckets(_colours(spark, d), "label", "r", "g", "b").select("label", "bucket", "n", F.round("share", 6).alias("share"), "rank")


def colour_names(spark: SparkSession, d: str) -> DataFrame:
    """Nearest named colour, brightness and skin test of each colour."""
    c = _colours(spark, d)
    r, g, b = (F.col(x).cast("double") for x in "rgb")
    return c.select("vec_id", "place", G.nearest_colour(r, g, b).alias("name"), F.round(G.luma(r, g, b), 4).alias("luma"), G.looks_like_skin(r, g, b).alias("skin"))


def few_colours(spark: SparkSession, d: str) -> DataFrame:
    """Whether at most eight buckets of a label hold one in a hundred of its colours each."""
    c = _colours(spark, d).groupBy("label", (F.floor(F.col("r") / 32) * 64 + F.floor(F.col("g") / 32) * 8 + F.floor(F.col("b") / 32)).alias("k")).agg(F.count("*").alias("n"))
    t = c.groupBy("label").agg(F.sum("n").alias("t"))
    return c.join(t, "label").groupBy("label").agg(F.count_if(F.expr("n >= 0.01 * t")).alias("clusters")).select("label", "clusters", (F.col("clusters") <= 8).alias("few"))


def value_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of all numbers of each label."""
    m = A.moments(table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double")), ["label"], "x")
    return m.select("label", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def robust_spread(spark: SparkSession, d: str) -> DataFrame:
    """Median and median distance of event values, by type."""
    r = A.robust(table(spark, d, "events").where("value IS NOT NULL"), "event_type", "value")
    return r.select("event_type", F.round("median", 6).alias("median"), F.round("spread", 6).alias("spread"))


def fitted_planes(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares plane of every third number over the two before it, by label."""
    e = table(spark, d, "embeddings").select("label", "embedding", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)).alias("place"))
    e = e.select("label", *[F.get("embedding", F.col("place") * 3 + i).cast("double").alias(n) for i, n in enumerate("xyz")])
    p = A.plane(e, ["label"], "x", "y", "z")
    return p.select("label", *[F.round(c, 5).alias(c) for c in "abc"])


def value_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Shares of dark, bright and skin-like colours, by label."""
    c = _colours(spark, d)
    r, g, b = (F.col(x).cast("double") for x in "rgb")
    y = G.luma(r, g, b)
    return c.groupBy("label").agg(*[F.round(F.avg(F.when(e, 1.0).otherwise(0.0)), 6).alias(n) for n, e in (("dark", y < 64), ("bright", y > 192), ("skin", G.looks_like_skin(r, g, b)))])


def image_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Aspect, canvas, scale to the least side and centering of each delivered image."""
    m = table(spark, d, "dedup_members").where("normalized_width > 0 AND normalized_height > 0")
    w, h = F.col("normalized_width").cast("double"), F.col("normalized_height").cast("double")
    return m.select("member_id", F.round(w / h, 6).alias("aspect"), G.canvas_side(F.greatest(w, h), 0.042).cast("long").alias("canvas"), F.round(G.needed_scale(F.least(w, h), 570), 6).alias("scale"),
                    (G.needed_scale(F.least(w, h), 570) <= 1.42).alias("can_grow"), (G.needed_scale(F.least(w, h), 570) <= 1.33).alias("can_stretch"), F.round(G.centering(F.least(w, h) / F.greatest(w, h)), 6).alias("centering"))


def subject_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box within each delivered image, without a shadow at its bottom where the image is high, brought to the canvas of
    the least side, as text."""
    m = table(spark, d, "dedup_members").where("normalized_width > 0 AND normalized_height > 0")
    w, h = F.col("normalized_width").cast("double"), F.col("normalized_height").cast("double")
    box = G.without_shadow([w / 8, h / 8, w * 0.7, h * 0.9], h > w)
    scale = G.needed_scale(F.least(w, h), 570)
    return m.select("member_id", G.box_text(G.scaled_box(box, scale, F.floor(w * scale), F.floor(h * scale))).alias("box"))


def det_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Families two of whose images have one number behind "det" at the end of their names."""
    det = F.regexp_extract(F.lower(S.stem(F.col("source_filename"))), "det([0-9]+)$", 1)
    m = table(spark, d, "match_evidence").where("final_family_id IS NOT NULL").select(F.col("final_family_id").alias("family"), det.alias("det")).where("det <> ''")
    return m.groupBy("family", "det").agg(F.count("*").alias("n")).groupBy("family").agg(F.max("n").alias("most")).where("most > 1")


def largest_copies(spark: SparkSession, d: str) -> DataFrame:
    """Of the copies of each family with one checksum the one of the largest area; of equal ones the earliest id."""
    m = table(spark, d, "dedup_members").where("checksum IS NOT NULL")
    area = F.coalesce(F.col("normalized_width").cast("long") * F.col("normalized_height"), F.lit(0).cast("long"))
    best = R.first_of(m, ["family_id", "checksum"], [-area, F.col("member_id")], ["member_id"])
    return _with_copies(best, m)


def _with_copies(best: DataFrame, m: DataFrame) -> DataFrame:
    copies = m.groupBy(F.col("family_id").alias("_f"), F.col("checksum").alias("_c")).agg(F.count("*").alias("copies")).where("copies > 1")
    return best.join(copies, best["family_id"].eqNullSafe(copies["_f"]) & (best["checksum"] == copies["_c"])).select("family_id", "checksum", "member_id", "copies")


def rival_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What each image that took a slot by its phenotype's place has before the next image of that place that took
    none: score, the camera's place, the name, or only its order."""
    taken = phenotype_slots(spark, d)
    order = ["neg", "unhinted", "low", "evidence_id"]
    cand = materialize(_phenotype_candidates(spark, d).select("family", "slot", "place", "neg", "unhinted", F.lower("name").alias("low"), "evidence_id"), "slot-candidates")
    won = taken.join(cand, ["family", "slot", "evidence_id"]).select("family", "slot", "place", F.struct(*order).alias("won"))
    rest = cand.join(taken.select("family", "evidence_id"), ["family", "evidence_id"], "left_anti").groupBy("family", "slot", "place").agg(F.min(F.struct(*order)).alias("rival"))
    both = won.join(rest, ["family", "slot", "place"], "left")
    reason = F.when(F.col("rival").isNull(), "none").when(F.col("won.neg") != F.col("rival.neg"), "score").when(F.col("won.unhinted") != F.col("rival.unhinted"), "camera").when(F.col("won.low") != F.col("rival.low"), "name").otherwise("order")
    return both.select("family", "slot", F.col("won.evidence_id").alias("evidence_id"), reason.alias("reason"))


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of boxes of one vector that overlap by more than a tenth. A vector's numbers are sixteen boxes, so 120 pairs."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    places = F.sequence(F.lit(0), F.floor(F.size("v") / 4).cast("int") - 1)
    box = lambda i: [F.get("v", i * 4 + k) for k in range(4)]

    def with_later(i):
        later = F.filter(places, lambda j: j > i)
        return F.transform(later, lambda j: F.struct(i.alias("i"), j.alias("j"), G.overlap_ratio(box(i), box(j)).alias("overlap")))

    pairs = F.flatten(F.transform(places, with_later))
    return e.select("vec_id", F.inline(pairs)).where("overlap > 0.1").select("vec_id", "i", "j", F.round("overlap", 5).alias("overlap"))


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("name"), "vec_id", H.difference_hash(F.transform("embedding", lambda x: x.cast("double")), 24).alias("hash"))


def near_hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct 24-bit hashes of one label that differ in four bits or less."""
    return H.near_hashes(_hashes(spark, d).select("name", "hash"), 4, 24)


def hash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with the hash of the group that takes it: groups form around the earliest vectors."""
    h = materialize(_hashes(spark, d), "hashes")
    firsts = materialize(h.where("hash <> 0").groupBy("name", "hash").agg(F.min("vec_id").alias("first")), "hash-firsts")
    state = H.anchors(firsts, H.near_hashes(h.select("name", "hash"), 4, 24))
    return h.join(state, ["name", "hash"]).select("vec_id", "name", "anchor")


def media_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each delivered file is, by its name: image, table, archive or other."""
    e = S.extension(F.col("initial_full_name"))
    kind = F.when(e.isin(".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp"), "image").when(e.isin(".xlsx", ".csv", ".tsv", ".txt"), "table").when(e == ".zip", "archive").otherwise("other")
    return table(spark, d, "dedup_members").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def import_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that keeps a delivered file out: unsupported, too small or too large in bytes, too small a picture."""
    m = table(spark, d, "dedup_members")
    ok = S.extension(F.col("initial_full_name")).isin(".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp")
    b, side = F.col("bytes_length"), F.greatest("normalized_width", "normalized_height")
    reason = F.when(~F.coalesce(ok, F.lit(False)), "unsupported").when(b.isNull(), "missing").when(b < 2048, "few bytes").when(b > 262_144_000, "many bytes").when(side < 570, "small picture")
    return m.select("member_id", reason.alias("reason"))


QUERIES = {f.__name__: f for f in (
    phenotype_slots, product_types, subject_boxes, det_collisions, largest_copies, rival_reasons,
    column_profile, column_overlaps, merged_columns, key_columns, filled_rows, dense_width, header_confidence, header_rows, header_ids, property_values_of, collated_records, conflicting_properties,
    empty_properties, orphan_rows, orphan_tallies, rules_satisfied, rules_remaining, feature_values, slot_assignment, overflow_order, compact_order, first_images, first_types, first_postings,
    strongest_values, tie_reasons, name_collisions, new_names, small_families, candidate_families, profile_words, counts_seeded, manifest_summary, manifest_rows, stage_counts, latest_jobs,
    past_retention, ordered_import, canonical_sets, unassigned_families, enriched_images, label_families, softmax_winners, converged_scores, colour_buckets, colour_names, few_colours, value_moments,
    robust_spread, fitted_planes, value_ratios, image_geometry, box_overlaps, near_hash_pairs, hash_groups, media_kinds, import_reasons)}

# SQL equivalents ----------------------------------------------------------------------------------
_LONG = " UNION ALL ".join(
    f"SELECT '{t}' AS tab, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {t}"
    for t, cols in {
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
        "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"], "events": ["event_id", "user_id", "event_type", "props"],
        "documents": ["doc_id", "text", "lang", "source", "n_chars", "doc_type", "family_id"], "embeddings": ["vec_id", "label"], "worksheet_rows": ["row_id", "source_file", "sheet_name", "row_index"],
        "property_values": ["value_id", "family_id", "property_name"], "translation_terms": ["term_id", "term_domain", "canonical_id", "term"],
        "family_conflicts": ["conflict_id", "family_id", "property_name", "reason_code", "source_kind"], "benchmark_items": ["item_id", "item_set", "lang", "text"],
        "reading_labels": ["doc_id", "rater", "reading_level"], "source_trust": ["source_kind", "trust_rank"],
        "dedup_members": ["member_id", "group_id", "source_kind", "initial_full_name", "normalized_width", "normalized_height", "bytes_length", "checksum", "family_id", "color_name", "product_type", "caption"],
        "header_cells": ["header_id", "source_file", "sheet_name", "column_index", "raw_header", "canonical_name"],
        "match_evidence": ["evidence_id", "job_id", "image_id", "source_filename", "final_family_id", "ko_reason", "accepted_matcher_name", "image_ngp_summary"],
        "token_evidence": ["token_id", "job_id", "family_id", "property_name", "family_token", "filename_token"],
    }.items() for c in cols)
_PROFILE = f"""WITH l AS (SELECT tab, col, nullif(trim(value), '') AS v FROM ({_LONG})), g AS (SELECT tab, col, count(*) AS n_rows, count(v) AS filled, count(DISTINCT v) AS n_values, coalesce(max(len(v)), 0) AS max_length,
 coalesce(bool_and(regexp_matches(v, '^[+-]?[0-9]+([.][0-9]+)?$')), false) AS numbers, coalesce(bool_or(regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')), false) AS mixed, coalesce(bool_and(regexp_matches(v, '^[0-9]{{8,}}$')), false) AS digits FROM l GROUP BY 1, 2)
SELECT tab, col, n_rows, filled, n_values, max_length, CASE WHEN n_values = 0 THEN 'empty' WHEN digits AND n_values = filled THEN 'key' WHEN numbers THEN 'number' WHEN mixed THEN 'mixed' WHEN n_values <= 100 AND max_length <= 20 THEN 'category' ELSE 'text' END AS kind, filled >= 0.2 * n_rows AS kept FROM g"""
_HEAD = f"""cells AS (SELECT header_id, source_file, sheet_name, column_index, coalesce(raw_header, '') AS raw, regexp_extract_all({FOLD.format(x="coalesce(raw_header, '')")}, '[a-z0-9]+') AS words FROM header_cells),
terms AS (SELECT canonical_id, array_to_string(regexp_extract_all({FOLD.format(x='term')}, '[a-z0-9]+'), ' ') AS term FROM translation_terms WHERE term_domain = 'header'),
vocab AS (SELECT DISTINCT canonical_id, key FROM (SELECT canonical_id, unnest(string_split(term, ' ')) AS key FROM terms) WHERE key NOT IN ({', '.join(repr(w) for w in S.STOP_GENERAL)})),
w AS (SELECT DISTINCT header_id, word FROM (SELECT header_id, unnest(words) AS word FROM cells) WHERE word NOT IN ({', '.join(repr(w) for w in S.STOP_GENERAL)})),
hm AS (SELECT header_id, canonical_id, max(c) AS confidence FROM (SELECT header_id, canonical_id, CAST(1.0 AS DOUBLE) AS c FROM cells JOIN terms ON array_to_string(words, ' ') = term
 UNION ALL SELECT header_id, canonical_id, 1.0 FROM w JOIN vocab ON word = key
 UNION ALL SELECT header_id, canonical_id, 0.75 FROM w JOIN vocab ON len(word) >= 4 AND len(key) >= 4 AND levenshtein(word, key) = 1 WHERE word NOT IN (SELECT key FROM vocab)) GROUP BY 1, 2)"""
_PN = "lower(regexp_replace(property_name, '[^\\p{L}\\p{Nd}]+', '', 'g'))"
_COLLATE = f"""WITH v AS (SELECT family_id, property, lower(trim(v)) AS low, min(trim(v)) AS v FROM (SELECT family_id, {_PN} AS property, unnest(source_values) AS v FROM property_values) WHERE trim(v) <> '' GROUP BY 1, 2, 3),
g AS (SELECT family_id, property, list_sort(list(v)) AS vs, list_sort(list_distinct(flatten(list([t for t in regexp_split_to_array(low, '[^\\p{{L}}\\p{{Nd}}]+') if t <> ''])))) AS tokens FROM v GROUP BY 1, 2)
SELECT family_id, property, len(vs) AS n_values, array_to_string(tokens, ' ') AS tokens, CASE WHEN len(vs) > 1 THEN array_to_string(tokens, ' ') ELSE vs[1] END AS canonical, len(vs) > 1 AS conflict FROM g"""
_KEYS = "list_distinct(list_concat(CASE WHEN len(regexp_replace({x}, '[^0-9]', '', 'g')) BETWEEN 6 AND 18 THEN [regexp_replace({x}, '[^0-9]', '', 'g')] ELSE [] END, [r for r in regexp_extract_all({x}, '[0-9]+') if len(r) >= 6]))"
_ORPHAN = f"""lone AS (SELECT row_id, source_file, sheet_name, cells FROM worksheet_rows WHERE coalesce(len([c for c in cells if regexp_matches(trim(c), '^[0-9]{{8}}$')]), 0) = 0),
k AS (SELECT DISTINCT row_id, unnest({_KEYS.format(x='c')}) AS key FROM (SELECT row_id, unnest(cells) AS c FROM lone) WHERE c IS NOT NULL),
f AS (SELECT DISTINCT family_id AS rec, unnest({_KEYS.format(x='family_token')}) AS key FROM token_evidence WHERE family_token IS NOT NULL AND family_id IS NOT NULL),
own AS (SELECT row_id, min(rec) AS rec FROM k JOIN f USING (key) GROUP BY 1 HAVING count(DISTINCT rec) = 1)"""


def _feature(name: str) -> str:
    return f"nullif(regexp_extract(coalesce(image_ngp_summary, ''), '(?:^|;){name}=([^;]*)', 1), '')"


_FEAT = f"f AS (SELECT evidence_id, {_feature('phenotype')} AS ph, {_feature('color')} AS co, {_feature('type')} AS ty FROM match_evidence)"
_R = ["(ph = 'worn' AND co IN ('red', 'coral', 'rust', 'copper'))", "(ph = 'detail' AND (ty = 'bag' OR ty = 'belt'))", "(ph = 'packshot')", "(co IN ('black', 'navy'))"]
_C = ["(coalesce(ph <> 'worn', false) OR coalesce(co NOT IN ('red', 'coral', 'rust', 'copper'), false))", "(coalesce(ph <> 'detail', false) OR coalesce(ty NOT IN ('bag', 'belt'), false))", "coalesce(ph <> 'packshot', false)", "coalesce(co NOT IN ('black', 'navy'), false)"]
_RN = [r.name for r in RULES]
_FIRST_RULE = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in zip(_R, _RN, strict=True)) + " END"


def _listed(conds: list[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in zip(conds, _RN, strict=True)) + ")"


_NAT = "array_to_string([CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 10, '0') || ltrim(t, '0') ELSE t END for t in regexp_extract_all(lower(source_filename), '[0-9]+|[^0-9]')], '')"
_SHOTS = f"shots AS (SELECT final_family_id AS family, evidence_id, source_filename, -coalesce(final_score, 0) AS neg, regexp_split_to_array(lower({sql_stem('source_filename')}), '[/\\\\_\\- .()]+') AS words, {_NAT} AS nat FROM match_evidence WHERE final_family_id IS NOT NULL)"


def _slots() -> str:
    out, taken = [], []
    for s, ws in VIEWS.items():
        views = ", ".join(f"'{w}'" for w in ws)
        gone = "".join(f" AND (family, evidence_id) NOT IN (SELECT (family, evidence_id) FROM s{t})" for t in taken)
        out.append(f"s{s} AS (SELECT family, evidence_id, {s} AS slot FROM (SELECT family, evidence_id, row_number() OVER (PARTITION BY family ORDER BY neg, nat, evidence_id) AS rn FROM shots WHERE list_has_any(words, [{views}]){gone}) WHERE rn = 1)")
        taken.append(s)
    return ", ".join(out) + ", slots AS (" + " UNION ALL ".join(f"SELECT * FROM s{s}" for s in VIEWS) + ")"


_ORDERED = f"WITH {_SHOTS}, {_slots()}, compact AS (SELECT family, evidence_id, row_number() OVER (PARTITION BY family ORDER BY coalesce(slot, 4), nat, evidence_id) - 1 AS position FROM shots LEFT JOIN slots USING (family, evidence_id))"
_RGB = "c AS (SELECT vec_id, label, CAST(place AS INT) AS place, " + ", ".join(f"CAST(least(255, greatest(0, floor((CAST(embedding[3 * place + {i + 1}] AS DOUBLE) + 1) * 127.5))) AS INT) AS {x}" for i, x in enumerate("rgb")) + " FROM embeddings, range(0, 21) p(place))"
_SKIN = "(128.0 - 0.168736 * r - 0.331264 * g + 0.5 * b BETWEEN 77 AND 127 AND 128.0 + 0.5 * r - 0.418688 * g - 0.081312 * b BETWEEN 133 AND 173)"
_LUMA = "(0.299 * CAST(r AS DOUBLE) + 0.587 * g + 0.114 * b)"
_BUCKET = "CAST(floor(r / 32) * 64 + floor(g / 32) * 8 + floor(b / 32) AS INT)"
_PAL = "(VALUES " + ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(G.PALETTE.items())) + ") p(i, name, pr, pg, pb)"
_HASH = "h AS (SELECT CAST(label AS VARCHAR) AS name, vec_id, CAST(list_sum([CASE WHEN CAST(embedding[i + 1] AS DOUBLE) > CAST(embedding[i + 2] AS DOUBLE) THEN CAST(1 AS BIGINT) << i ELSE 0 END for i in range(0, 24)]) AS BIGINT) AS hash FROM embeddings)"
_IOU = []
for _i in range(16):
    for _j in range(_i + 1, 16):
        _a, _b = ([f"abs(CAST(embedding[{4 * k + m + 1}] AS DOUBLE))" for m in range(4)] for k in (_i, _j))
        _w = f"greatest(0.0, least({_a[0]} + {_a[2]}, {_b[0]} + {_b[2]}) - greatest({_a[0]}, {_b[0]}))"
        _h = f"greatest(0.0, least({_a[1]} + {_a[3]}, {_b[1]} + {_b[3]}) - greatest({_a[1]}, {_b[1]}))"
        _IOU.append(f"SELECT vec_id, {_i} AS i, {_j} AS j, {_w} * {_h} / ({_a[2]} * {_a[3]} + {_b[2]} * {_b[3]} - {_w} * {_h}) AS overlap FROM embeddings")
_CAT = "cat AS (SELECT job_id AS grp, family_id AS rec, family_id AS value FROM token_evidence WHERE job_id IS NOT NULL AND family_id IS NOT NULL UNION ALL SELECT job_id, family_id, family_token FROM token_evidence WHERE job_id IS NOT NULL AND family_id IS NOT NULL AND family_token IS NOT NULL)"
_IMAGE_EXT = "('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tif', '.tiff', '.webp')"
_EXT = "lower(regexp_extract(regexp_extract(initial_full_name, '([^/\\\\]*)$', 1), '(\\.[^.]*)$', 1))"

from weftline.queries.matching import _DIGITS, _IMG  # noqa: E402
from weftline.queries.strings import sql_profile  # noqa: E402

_KIND = "nullif(regexp_extract(image_ngp_summary, '(?:^|;)phenotype=([^;]*)', 1), '')"
_LAST = f"list_contains({list(S.ORIENTATION)!r}, lower(regexp_extract_all({sql_stem('source_filename')}, '[\\p{{L}}\\p{{Nd}}]+')[-1]))"
_SLOTS = f"WITH shots AS (SELECT final_family_id AS family, evidence_id, {_KIND} AS kind, -coalesce(final_score, 0) AS neg, NOT coalesce({_LAST}, false) AS unhinted, source_filename AS name FROM match_evidence WHERE final_family_id IS NOT NULL AND {_KIND} IS NOT NULL)" + "".join(
    f", s{s} AS (SELECT family, evidence_id, {s} AS slot FROM shots WHERE list_contains({ks!r}, kind)" + "".join(f" AND evidence_id NOT IN (SELECT evidence_id FROM s{t})" for t in range(s))
    + f" QUALIFY row_number() OVER (PARTITION BY family ORDER BY list_position({ks!r}, kind), neg, unhinted, name, evidence_id) = 1)" for s, ks in PHENOTYPE_SLOTS.items()) + " SELECT * FROM s0" + "".join(f" UNION ALL SELECT * FROM s{s}" for s in list(PHENOTYPE_SLOTS)[1:])
_TERM = "regexp_replace(" + FOLD + ", '[^a-z0-9]', '', 'g')"
_TYPES = f"""WITH t AS (SELECT canonical_id, {_TERM.format(x='term')} AS key FROM translation_terms WHERE term_domain = 'producttype'), p AS (SELECT key, min(canonical_id) AS id FROM t GROUP BY 1),
v AS (SELECT DISTINCT product_type AS value FROM dedup_members WHERE product_type IS NOT NULL),
w AS (SELECT value, generate_subscripts(ws, 1) AS n, unnest(ws) AS word FROM (SELECT value, regexp_extract_all(value, '[\\p{{L}}\\p{{Nd}}]+') AS ws FROM v)),
f AS (SELECT value, arg_min(id, n) AS id FROM w JOIN p ON p.key = {_TERM.format(x='word')} GROUP BY 1)
SELECT v.value, coalesce((SELECT any_value(canonical_id) FROM t WHERE canonical_id = translate(lower(trim(v.value)), ' _', '--')), (SELECT id FROM p WHERE key = {_TERM.format(x='v.value')}), f.id) AS type_id FROM v LEFT JOIN f USING (value)"""
ORACLE = {
    "phenotype_slots": _SLOTS,
    "product_types": _TYPES,
    "subject_boxes": """WITH m AS (SELECT member_id, CAST(normalized_width AS DOUBLE) AS w, CAST(normalized_height AS DOUBLE) AS h FROM dedup_members WHERE normalized_width > 0 AND normalized_height > 0),
q AS (SELECT member_id, w / 8 AS x, h / 8 AS y, w * 0.7::DOUBLE AS bw, CASE WHEN h > w THEN greatest(1.0, h * 0.9::DOUBLE * (1 - 0.06::DOUBLE)) ELSE h * 0.9::DOUBLE END AS bh, CASE WHEN least(w, h) >= 570 THEN 1.0::DOUBLE ELSE 570 / least(w, h) END AS s, w, h FROM m),
r AS (SELECT *, floor(w * s) AS cw, floor(h * s) AS ch FROM q), t AS (SELECT *, greatest(0.0, least(round_even(x * s, 0), cw - 1)) AS l, greatest(0.0, least(round_even(y * s, 0), ch - 1)) AS u FROM r)
SELECT member_id, printf('%.4f,%.4f,%.4f,%.4f', l, u, greatest(1.0, least(round_even(bw * s, 0), cw - l)), greatest(1.0, least(round_even(bh * s, 0), ch - u))) AS box FROM t""",
    "det_collisions": f"SELECT family, max(n) AS most FROM (SELECT final_family_id AS family, regexp_extract(lower({sql_stem('source_filename')}), 'det([0-9]+)$', 1) AS det, count(*) AS n FROM match_evidence WHERE final_family_id IS NOT NULL GROUP BY 1, 2) WHERE det <> '' GROUP BY 1 HAVING max(n) > 1",
    "largest_copies": "SELECT family_id, checksum, arg_min(member_id, (-coalesce(CAST(normalized_width AS BIGINT) * normalized_height, 0), member_id)) AS member_id, count(*) AS copies FROM dedup_members WHERE checksum IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "rival_reasons": f"""WITH t AS ({_SLOTS}), c AS (SELECT final_family_id AS family, slot, place, -coalesce(final_score, 0) AS neg, NOT coalesce({_LAST}, false) AS unhinted, lower(source_filename) AS low, evidence_id FROM match_evidence, (VALUES {', '.join(f"({s}, {n}, '{k}')" for s, ks in PHENOTYPE_SLOTS.items() for n, k in enumerate(ks))}) p(slot, place, kind) WHERE final_family_id IS NOT NULL AND kind = {_KIND}),
r AS (SELECT * FROM c WHERE (family, evidence_id) NOT IN (SELECT (family, evidence_id) FROM t) QUALIFY row_number() OVER (PARTITION BY family, slot, place ORDER BY neg, unhinted, low, evidence_id) = 1)
SELECT c.family, c.slot, c.evidence_id, CASE WHEN r.evidence_id IS NULL THEN 'none' WHEN c.neg <> r.neg THEN 'score' WHEN c.unhinted <> r.unhinted THEN 'camera' WHEN c.low <> r.low THEN 'name' ELSE 'order' END AS reason
FROM t JOIN c USING (family, slot, evidence_id) LEFT JOIN r ON r.family = c.family AND r.slot = c.slot AND r.place = c.place""",
    "column_profile": _PROFILE,
    "key_columns": f"SELECT tab, col FROM ({_PROFILE}) WHERE n_values = filled AND filled = n_rows",
    "column_overlaps": "WITH v AS (" + " UNION ".join(f"SELECT '{t}' AS col, {c} AS value FROM (SELECT trim({c}) AS {c} FROM {t}) WHERE {c} <> ''" for t, c in FAMILY_COLUMNS) + "), n AS (SELECT col, count(*) AS n FROM v GROUP BY 1) SELECT x.col AS a, y.col AS b, count(*) AS shared, round(count(*) / least(min(p.n), min(q.n)), 6) AS ratio FROM v x JOIN v y ON x.value = y.value AND x.col < y.col JOIN n p ON p.col = x.col JOIN n q ON q.col = y.col GROUP BY 1, 2 HAVING count(*) / least(min(p.n), min(q.n)) > 0.2",
    "filled_rows": "SELECT source_file, sheet_name, count(*) AS rows, CAST(sum(n) AS BIGINT) AS cells FROM (SELECT source_file, sheet_name, len([c for c in cells if trim(c) <> '']) AS n FROM worksheet_rows) WHERE n > 0 GROUP BY 1, 2",
    "dense_width": "SELECT source_file, sheet_name, max(len(cells)) AS width, count(*) AS height, CAST(max(len(cells)) * count(*) - sum(len(cells)) AS BIGINT) AS padded FROM worksheet_rows WHERE cells IS NOT NULL GROUP BY 1, 2",
    "header_confidence": f"WITH {_HEAD} SELECT * FROM hm",
    "header_rows": f"WITH {_HEAD}, b AS (SELECT header_id, max(confidence) AS c FROM hm GROUP BY 1) SELECT source_file, sheet_name, count(*) AS filled, count(c) AS matched, round(avg(c), 6) AS confidence FROM cells LEFT JOIN b USING (header_id) WHERE len(words) > 0 GROUP BY 1, 2 HAVING count(c) >= 0.4 * count(*)",
    "header_ids": f"WITH {_HEAD}, o AS (SELECT key, min(canonical_id) AS lo, max(canonical_id) AS hi FROM vocab GROUP BY 1), s AS (SELECT header_id, min(lo) AS id FROM w LEFT JOIN o ON word = key GROUP BY 1 HAVING bool_and(coalesce(lo = hi, false)) AND min(lo) = max(hi)), p AS (SELECT term, min(canonical_id) AS id FROM terms GROUP BY 1) SELECT header_id, coalesce(p.id, s.id, nullif(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), ''), 'Column' || column_index) AS canonical FROM cells LEFT JOIN p ON term = array_to_string(words, ' ') LEFT JOIN s USING (header_id)",
    "property_values_of": f"SELECT family_id, property, trim(v) AS value, count(*) AS times, max(cells) AS cells FROM (SELECT family_id, {_PN} AS property, unnest(source_values) AS v, coalesce(len(source_locations), 0) AS cells FROM property_values) WHERE trim(v) <> '' GROUP BY 1, 2, 3",
    "collated_records": _COLLATE,
    "conflicting_properties": f"SELECT family_id, property, n_values FROM ({_COLLATE}) WHERE conflict",
    "empty_properties": f"SELECT {_PN} AS property, NOT bool_or(coalesce(len([x for x in source_values if trim(x) <> '']), 0) > 0) AS is_empty, count(*) AS n FROM property_values GROUP BY 1",
    "orphan_rows": f"WITH {_ORPHAN} SELECT * FROM own",
    "orphan_tallies": f"WITH {_ORPHAN} SELECT source_file, sheet_name, count(rec) AS joined, count(*) AS total FROM lone LEFT JOIN own USING (row_id) GROUP BY 1, 2",
    "rules_satisfied": f"WITH {_FEAT} SELECT evidence_id, {_listed(_R)} AS rules, {_FIRST_RULE} AS first_rule FROM f",
    "rules_remaining": f"WITH {_FEAT} SELECT evidence_id, {_listed(['NOT ' + c for c in _C])} AS pool, coalesce({_FIRST_RULE}, CASE WHEN NOT {_C[3]} THEN 'dark' END) AS settled FROM f",
    "feature_values": "SELECT split_part(p, '=', 1) AS feature, split_part(p, '=', 2) AS value, count(*) AS n FROM (SELECT unnest(string_split(image_ngp_summary, ';')) AS p FROM match_evidence) WHERE p LIKE '%=%' GROUP BY 1, 2",
    "slot_assignment": f"WITH {_SHOTS}, {_slots()} SELECT * FROM slots",
    "overflow_order": f"WITH {_SHOTS}, {_slots()} SELECT family, evidence_id, row_number() OVER (PARTITION BY family ORDER BY nat, evidence_id) + 3 AS position FROM shots WHERE (family, evidence_id) NOT IN (SELECT (family, evidence_id) FROM slots)",
    "compact_order": f"{_ORDERED} SELECT * FROM compact",
    "first_images": f"WITH {_SHOTS} SELECT family, evidence_id, source_filename FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY neg, lower(source_filename), evidence_id) AS rn FROM shots) WHERE rn = 1",
    "first_types": "WITH t AS (SELECT lower(term) AS term, min(canonical_id) AS id FROM translation_terms WHERE term_domain = 'producttype' GROUP BY 1), k AS (SELECT family_id, arg_min(id, token_id) AS id FROM token_evidence JOIN t ON term = lower(family_token) WHERE property_name = 'producttype' GROUP BY 1) SELECT DISTINCT e.family_id, coalesce(id, 'type-other') AS type_id FROM token_evidence e LEFT JOIN k USING (family_id) WHERE e.family_id IS NOT NULL",
    "first_postings": "SELECT family_id, lower(family_token) AS token, min(token_id) AS token_id FROM token_evidence WHERE family_token IS NOT NULL GROUP BY 1, 2",
    "strongest_values": "SELECT family_id, property_name, family_token, score FROM (SELECT *, row_number() OVER (PARTITION BY family_id, property_name ORDER BY score DESC, token_id) AS rn FROM token_evidence WHERE score IS NOT NULL AND family_token IS NOT NULL) WHERE rn = 1",
    "tie_reasons": f"WITH {_SHOTS}, r AS (SELECT *, lower(source_filename) AS low, row_number() OVER (PARTITION BY family ORDER BY neg, lower(source_filename), evidence_id) AS rn FROM shots) SELECT a.family, CASE WHEN b.family IS NULL THEN 'none' WHEN a.neg < b.neg THEN 'score' WHEN a.low < b.low THEN 'name' ELSE 'order' END AS reason FROM r a LEFT JOIN r b ON b.family = a.family AND b.rn = 2 WHERE a.rn = 1",
    "name_collisions": f"WITH {_SHOTS} SELECT family, max(n) AS most FROM (SELECT family, words[-1] AS view, count(*) AS n FROM shots GROUP BY 1, 2) GROUP BY 1 HAVING max(n) > 1",
    "new_names": f"{_ORDERED} SELECT evidence_id, family || '_det' || position || '.jpg' AS new_name FROM compact",
    "small_families": "SELECT group_id, CASE WHEN n > 1 THEN 'skipped' WHEN (w > 0 AND w < 1600) OR (h > 0 AND h < 1600) THEN 'low quality' ELSE 'open' END AS gate FROM (SELECT group_id, count(*) AS n, max(normalized_width) AS w, max(normalized_height) AS h FROM dedup_members GROUP BY 1)",
    "candidate_families": f"{_DIGITS} SELECT id, count(DISTINCT rec) AS families FROM tok JOIN post USING (grp, key) GROUP BY 1",
    "profile_words": f"WITH {_IMG}, t AS (SELECT grp, count(*) AS total FROM img GROUP BY 1) SELECT grp, word, n, n > greatest(10.0, 0.5 * total) AS common FROM (SELECT grp, word, count(*) AS n FROM (SELECT grp, unnest({sql_profile('name')}) AS word FROM img) GROUP BY 1, 2) JOIN t USING (grp)",
    "counts_seeded": f"SELECT final_family_id AS family, coalesce({_feature('phenotype')}, 'UNKNOWN') AS phenotype, count(*) AS n FROM match_evidence WHERE final_family_id IS NOT NULL GROUP BY 1, 2",
    "manifest_summary": "SELECT job_id, count(*) AS images, count(*) FILTER (WHERE is_ko) AS left_out, count(final_family_id) AS matched, count(DISTINCT final_family_id) AS families FROM match_evidence GROUP BY 1",
    "manifest_rows": f"{_ORDERED} SELECT m.evidence_id, source_filename, CASE WHEN is_ko THEN 'left out' ELSE 'ok' END AS status, CASE WHEN is_ko THEN coalesce(ko_reason, 'UNSTATED') END AS reason, final_family_id AS family, c.family || '_det' || position || '.jpg' AS new_name FROM match_evidence m LEFT JOIN compact c USING (evidence_id)",
    "stage_counts": "SELECT job_id, coalesce(accepted_matcher_name, 'none') AS matcher, count(*) AS done, count(*) FILTER (WHERE is_ko) AS failed, min(decided_at) AS first_at, max(decided_at) AS last_at FROM match_evidence GROUP BY 1, 2",
    "latest_jobs": "SELECT job_id, max(decided_at) AS last_at FROM match_evidence WHERE decided_at IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "past_retention": "SELECT job_id, count(*) FILTER (WHERE decided_at < last_at - INTERVAL 24 HOURS) AS old, count(*) AS n FROM match_evidence JOIN (SELECT job_id, max(decided_at) AS last_at FROM match_evidence GROUP BY 1) USING (job_id) WHERE decided_at IS NOT NULL GROUP BY 1",
    "ordered_import": "SELECT member_id, row_number() OVER (ORDER BY coalesce(initial_full_name, ''), coalesce(bytes_length, -1), coalesce(normalized_width, -1), coalesce(normalized_height, -1), member_id) AS place FROM dedup_members",
    "canonical_sets": "SELECT family_id, len(list_distinct(list_concat(a, b))) AS in_any, len(list_intersect(a, b)) AS in_both, len([x for x in a if NOT list_contains(b, x)]) AS only_family, len([x for x in b if NOT list_contains(a, x)]) = 0 AS contained FROM (SELECT family_id, coalesce(list(DISTINCT lower(family_token)) FILTER (WHERE family_token IS NOT NULL), []) AS a, coalesce(list(DISTINCT lower(filename_token)) FILTER (WHERE filename_token IS NOT NULL), []) AS b FROM token_evidence WHERE family_id IS NOT NULL GROUP BY 1)",
    "unassigned_families": "SELECT DISTINCT job_id, family_id FROM token_evidence t WHERE family_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM match_evidence m WHERE NOT is_ko AND m.job_id = t.job_id AND m.final_family_id = t.family_id)",
    "enriched_images": "SELECT evidence_id, m.final_family_id AS family_id, c.color FROM match_evidence m LEFT JOIN (SELECT job_id, family_id, arg_min(family_token, token_id) AS color FROM token_evidence WHERE property_name = 'color' AND family_token IS NOT NULL GROUP BY 1, 2) c ON c.job_id = m.job_id AND c.family_id = m.final_family_id WHERE m.final_family_id IS NOT NULL",
    "label_families": f"""WITH {_FEAT}, t AS (SELECT DISTINCT lower(term) AS term, canonical_id FROM translation_terms WHERE term_domain IN ('color', 'producttype')),
g AS (SELECT evidence_id, min(canonical_id) AS a, max(canonical_id) AS b FROM (SELECT evidence_id, canonical_id FROM f JOIN t ON co = term UNION ALL SELECT evidence_id, canonical_id FROM f JOIN t ON ty = term) GROUP BY 1 HAVING min(canonical_id) < max(canonical_id)),
i AS (SELECT job_id, a, b, count(*) AS images FROM g JOIN match_evidence USING (evidence_id) GROUP BY 1, 2, 3), fam AS (SELECT DISTINCT job_id, family_id, canonical_id FROM token_evidence JOIN t ON lower(family_token) = term WHERE property_name IN ('color', 'producttype')),
h AS (SELECT x.job_id, x.canonical_id AS a, y.canonical_id AS b, count(*) AS families FROM fam x JOIN fam y ON x.job_id = y.job_id AND x.family_id = y.family_id AND x.canonical_id < y.canonical_id GROUP BY 1, 2, 3) SELECT job_id, a, b, images, families FROM i JOIN h USING (job_id, a, b)""",
    "softmax_winners": "WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding[1:10]] AS v FROM embeddings), e AS (SELECT vec_id, v, list_max(v) AS m, list_sum([exp(x - list_max(v)) for x in v]) AS t FROM v) SELECT vec_id, 'd' || (list_position(v, m) - 1) AS name, round(1 / t, 6) AS share, 1 / t >= 0.25 AS influential FROM e",
    "converged_scores": "SELECT evidence_id, round(CASE WHEN accepted_matcher_name IS NOT NULL AND image_ngp_summary IS NOT NULL THEN least(1.0, coalesce(final_score, 0) + 0.25) ELSE coalesce(final_score, 0) END, 6) AS score FROM match_evidence",
    "colour_buckets": f"WITH {_RGB}, k AS (SELECT label, {_BUCKET} AS bucket, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS total, row_number() OVER (PARTITION BY label ORDER BY n DESC, bucket) AS rank FROM k) SELECT label, bucket, n, round(n / total, 6) AS share, rank FROM t WHERE rank <= 4 AND n >= 0.02 * total",
    "colour_names": f"WITH {_RGB} SELECT vec_id, place, arg_min(name, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 100 + i) AS name, round({_LUMA.replace('CAST(r AS', 'CAST(any_value(r) AS').replace('* g', '* any_value(g)').replace('* b)', '* any_value(b))')}, 4) AS luma, any_value({_SKIN}) AS skin FROM c, {_PAL} GROUP BY 1, 2",
    "few_colours": f"WITH {_RGB}, k AS (SELECT label, {_BUCKET} AS k, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS t FROM k) SELECT label, count(*) FILTER (WHERE n >= 0.01 * t) AS clusters, count(*) FILTER (WHERE n >= 0.01 * t) <= 8 AS few FROM t GROUP BY 1",
    "value_moments": "SELECT label, count(x) AS n, round(avg(x), 6) AS mean, round(avg(x * x) - avg(x) * avg(x), 6) AS variance FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1",
    "robust_spread": "WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, round(any_value(median), 6) AS median, round(quantile_cont(abs(value - median), 0.5), 6) AS spread FROM events JOIN m USING (event_type) WHERE value IS NOT NULL GROUP BY 1",
    "fitted_planes": "WITH e AS (SELECT label, CAST(embedding[3 * p + 1] AS DOUBLE) AS x, CAST(embedding[3 * p + 2] AS DOUBLE) AS y, CAST(embedding[3 * p + 3] AS DOUBLE) AS z FROM embeddings, range(0, 21) r(p)), m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM e GROUP BY 1), s AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS c FROM m) SELECT label, round(mz - b * mx - c * my, 5) AS a, round(b, 5) AS b, round(c, 5) AS c FROM s",
    "value_ratios": f"WITH {_RGB} SELECT label, round(avg(CASE WHEN {_LUMA} < 64 THEN 1.0 ELSE 0.0 END), 6) AS dark, round(avg(CASE WHEN {_LUMA} > 192 THEN 1.0 ELSE 0.0 END), 6) AS bright, round(avg(CASE WHEN {_SKIN} THEN 1.0 ELSE 0.0 END), 6) AS skin FROM c GROUP BY 1",
    "image_geometry": "WITH m AS (SELECT member_id, CAST(normalized_width AS DOUBLE) AS w, CAST(normalized_height AS DOUBLE) AS h FROM dedup_members WHERE normalized_width > 0 AND normalized_height > 0), q AS (SELECT *, CAST(floor(greatest(w, h) * (1 + 2 * 0.042)) AS BIGINT) AS s, CASE WHEN least(w, h) >= 570 THEN 1.0::DOUBLE ELSE 570 / least(w, h) END AS sc FROM m) SELECT member_id, round(w / h, 6) AS aspect, s - s % 2 - 2 AS canvas, round(sc, 6) AS scale, sc <= 1.42::DOUBLE AS can_grow, sc <= 1.33::DOUBLE AS can_stretch, round(1 - 2 * abs(least(w, h) / greatest(w, h) - 0.5), 6) AS centering FROM q",
    "box_overlaps": f"SELECT vec_id, i, j, round(overlap, 5) AS overlap FROM ({' UNION ALL '.join(_IOU)}) WHERE overlap > 0.1",
    "near_hash_pairs": f"WITH {_HASH}, u AS (SELECT DISTINCT name, hash FROM h WHERE hash <> 0) SELECT x.name, x.hash AS a, y.hash AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INT) AS distance FROM u x JOIN u y ON x.name = y.name AND x.hash < y.hash AND bit_count(xor(x.hash, y.hash)) <= 4",
    "media_kinds": f"SELECT CASE WHEN {_EXT} IN {_IMAGE_EXT} THEN 'image' WHEN {_EXT} IN ('.xlsx', '.csv', '.tsv', '.txt') THEN 'table' WHEN {_EXT} = '.zip' THEN 'archive' ELSE 'other' END AS kind, count(*) AS n FROM dedup_members GROUP BY 1",
    "import_reasons": f"SELECT member_id, CASE WHEN NOT coalesce({_EXT} IN {_IMAGE_EXT}, false) THEN 'unsupported' WHEN bytes_length IS NULL THEN 'missing' WHEN bytes_length < 2048 THEN 'few bytes' WHEN bytes_length > 262144000 THEN 'many bytes' WHEN greatest(normalized_width, normalized_height) < 570 THEN 'small picture' END AS reason FROM dedup_members",
}

# outer whitespace of any kind, as strip() sees it
ORACLE = {k: re.sub(r"\btrim\((\w+)\)", r"regexp_replace(\1, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')", v) for k, v in ORACLE.items()}


def pixel_features(spark: SparkSession, d: str) -> DataFrame:
    """Picture features of vectors read as 8 x 8 grey pictures."""
    from weftline.operators.images import image_features
    e = table(spark, d, "embeddings").where("size(embedding) = 64")
    byte = F.transform("embedding", lambda x: F.substring(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("int") + 256), 2, 2))
    pics = e.select(F.col("vec_id").alias("id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(byte, "")).alias("data"))
    return image_features(pics)


def whole_job(spark: SparkSession, d: str) -> DataFrame:
    """Names matched through all brackets and siblings, ordered and named anew."""
    from weftline.plans.jobs import match_names, ordered_manifest
    images = table(spark, d, "match_evidence")
    known = images.where("final_family_id IS NOT NULL").select(F.col("evidence_id").alias("id"), F.col("final_family_id").alias("rec"))
    terms = table(spark, d, "translation_terms")
    synonyms = terms.where("term_domain IN ('color', 'producttype')").select(F.lower("term").alias("term"), F.col("canonical_id").alias("group_id"))
    matched = match_names(images, table(spark, d, "token_evidence"), known, synonyms, terms, table(spark, d, "worksheet_rows"))
    return ordered_manifest(materialize(matched, "outcome"), M.names(images))


QUERIES |= {"pixel_features": pixel_features, "whole_job": whole_job}


def _vector_hashes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("name"), "vec_id", H.difference_hash(F.transform("embedding", lambda x: x.cast("double"))).alias("hash"))


def near_vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hashes of all 64 numbers (63 bits) of one label that differ in six bits or less."""
    return H.near_hashes(_vector_hashes(spark, d).select("name", "hash"))


def vector_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with the hash, of all its numbers, of the group that takes it."""
    h = materialize(_vector_hashes(spark, d), "hashes")
    firsts = materialize(h.where("hash <> 0").groupBy("name", "hash").agg(F.min("vec_id").alias("first")), "hash-firsts")
    return h.join(H.anchors(firsts, H.near_hashes(h.select("name", "hash"))), ["name", "hash"]).select("vec_id", "name", "anchor")


def near_picture_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct 128-bit hashes of the vectors' pictures of one label that differ in six bits or less."""
    names = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("name"))
    return H.near_wide_hashes(pixel_features(spark, d).select("id", "hash_hi", "hash_lo").join(names, "id"))


def softmax_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The greatest of all numbers of each vector as a share of their exponentials."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    names = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: F.concat(F.lit("d"), i.cast("string")))
    w = e.select("vec_id", A.winner(names, A.softmax(F.col("v"))).alias("w"))
    return w.select("vec_id", "w.name", F.round("w.score", 6).alias("share"), (F.col("w.score") >= 0.25).alias("influential"))


QUERIES |= {f.__name__: f for f in (near_vector_pairs, vector_groups, near_picture_pairs, softmax_of_all)}
ORACLE |= {
    "near_vector_pairs": ORACLE["near_hash_pairs"].replace("range(0, 24)", "range(0, 63)").replace("<= 4", "<= 6"),
    "softmax_of_all": ORACLE["softmax_winners"].replace("embedding[1:10]", "embedding"),
}


def _grouped(hashes: str, radius: int) -> str:
    """Groups around the earliest anchors, hash by hash in their order."""
    near = f"list_filter(r.anchors, lambda x: bit_count(xor(x, f.hash)) <= {radius})"
    return f"""WITH RECURSIVE {hashes}, f AS (SELECT name, hash, row_number() OVER (PARTITION BY name ORDER BY min(vec_id)) AS i FROM h WHERE hash <> 0 GROUP BY 1, 2),
r AS (SELECT name, i, hash, hash AS anchor, [hash] AS anchors FROM f WHERE i = 1
  UNION ALL SELECT f.name, f.i, f.hash, coalesce({near}[1], f.hash), CASE WHEN len({near}) = 0 THEN list_append(r.anchors, f.hash) ELSE r.anchors END FROM r JOIN f ON f.name = r.name AND f.i = r.i + 1)
SELECT vec_id, name, anchor FROM h JOIN r USING (name, hash)"""


_MERGED = "m0 AS (SELECT * FROM (VALUES (NULL, NULL)) v(col, leader) WHERE false)" + "".join(
    f", m{k + 1} AS (SELECT * FROM m{k} UNION ALL SELECT '{t}', coalesce((SELECT leader FROM m{k} JOIN p ON (p.a = m{k}.col AND p.b = '{t}') OR (p.b = m{k}.col AND p.a = '{t}') ORDER BY list_position({[t for t, _ in FAMILY_COLUMNS]!r}, leader) LIMIT 1), '{t}'))"
    for k, (t, _) in enumerate(FAMILY_COLUMNS))
ORACLE |= {
    "hash_groups": _grouped(_HASH, 4),
    "vector_groups": _grouped(_HASH.replace("range(0, 24)", "range(0, 63)"), 6),
    "merged_columns": f"WITH p AS ({ORACLE['column_overlaps']}), {_MERGED} SELECT * FROM m{len(FAMILY_COLUMNS)}",
}
