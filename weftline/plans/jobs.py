"""Whole jobs as compositions of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from weftline.functions import strings as S
from weftline.operators import matching as M, ranking as R, rules as U
from weftline.session import materialize, release, work_root


def match_names(images: DataFrame, tokens: DataFrame, known: DataFrame | None = None, synonyms: DataFrame | None = None, terms: DataFrame | None = None, sheets: DataFrame | None = None) -> DataFrame:
    """(id, rec, bracket, reason): names through all brackets, each on what those before it left open.

    The order: families known before; digits (one run, neighbouring runs, all runs together, runs in any order);
    words with synonyms and neighbouring words, then with words one edit away; records without a name that share
    colour and type, narrowed by digits; cells of sheets that name the file, and references that it starts with;
    digits within longer ones; names with the same rare words, then with some of the same.

    Synonyms (term, group_id), terms (term_domain, term, canonical_id) with images' ``image_ngp_summary``, and
    sheets' rows each feed brackets that are skipped without them. A code that names no record speaks against a
    match by related words.

    Each bracket is planned for itself, over a written table of the names that are still open, and what its plans took
    of the driver is given back before the next: the driver holds the plans of one bracket at a time.
    """
    img, cat = M.names(images), M.catalogue(tokens)
    postings = materialize(M.digit_postings(cat), "digit-postings")
    index = materialize(M.holders(postings), "digit-index")
    own = cat.select("grp", "rec").distinct()
    settled = img.select("id").join(known.groupBy("id").agg(F.min("rec").alias("rec")), "id") if known is not None else img.select("id", F.lit(None).cast("string").alias("rec")).where("false")
    # what is found is read as one table of a part for each bracket, so that the plans don't grow with the brackets;
    # parts are named one by one, as plans that read one folder at different times would pass for equal
    spark, place, parts = images.sparkSession, f"{work_root(images.sparkSession)}/found-{uuid.uuid4().hex[:8]}", []
    found = img

    def keep(new: DataFrame) -> None:
        nonlocal found
        schema = T.StructType([T.StructField("id", img.schema["id"].dataType), T.StructField("bracket", T.StringType()), T.StructField("rec", T.StringType())])
        path = f"{place}/{len(parts)}"
        new.select("id", "bracket", "rec").write.parquet(path)
        parts.append(path)
        release(spark)
        found = spark.read.schema(schema).parquet(*parts)

    keep(settled.select("id", F.lit("known").alias("bracket"), "rec"))

    def left() -> DataFrame:
        return materialize(img.join(found.select("id"), "id", "left_anti"), "open")

    def add(bracket: str, matched: DataFrame) -> None:
        """``matched`` holds open names only."""
        keep(matched.select("id", F.lit(bracket).alias("bracket"), "rec"))

    add("digits", M.by_digits(left(), index))
    add("concatenated", M.by_concatenation(left(), index))
    add("intersection", M.by_intersection(left(), postings))
    add("permuted", M.by_permutation(left(), index))
    lexicon = materialize(M.word_postings(cat).select("grp", "key").distinct(), "lexicon")
    words = materialize(M.word_postings(cat, synonyms).unionByName(M.neighbour_words(cat)).distinct(), "word-postings")
    numbers = materialize(M.number_postings(cat), "number-postings")
    add("words", M.by_words(left(), words, synonyms, numbers=numbers))
    rest = left()
    asked = rest.select("grp", F.explode(S.filename_tokens(F.col("name"))).alias("word"))
    add("near words", M.by_words(rest, words, synonyms, materialize(M.near_words(asked, lexicon), "near-words"), numbers))
    if terms is not None and "image_ngp_summary" in images.columns:
        f = U.feature_map(F.col("image_ngp_summary"))
        told = images.select(F.col("evidence_id").alias("id"), F.try_element_at(f, F.lit("color")).alias("color"), F.try_element_at(f, F.lit("type")).alias("type")).where("color IS NOT NULL AND type IS NOT NULL")
        rest = left()
        used = found.join(img.select("id", "grp"), "id").select("grp", "rec").distinct()
        candidates = materialize(M.feature_candidates(rest.join(told, "id"), tokens, terms, used), "candidates")
        digits = rest.join(candidates.select("id").distinct(), "id", "left_semi").select("id", F.posexplode(M.digit_tokens(F.col("name"))).alias("n", "key"))
        narrowed = M.narrowed(candidates, digits, postings)
        add("narrowed", narrowed.groupBy("id").agg(F.min("rec").alias("rec"), F.count("*").alias("n")).where("n = 1"))
    if sheets is not None:
        rest = left()
        add("cell", M.by_cell(rest, sheets).join(rest.select("id", "grp"), "id").join(own, ["grp", "rec"], "left_semi"))
    add("cell start", M.by_cell_start(left(), tokens))
    add("contained", M.by_containment(left(), index))
    profiles = materialize(M.rare_profiles(img), "profiles")
    sure = materialize(found.select("id", "rec"), "sure")
    equal = materialize(M.by_equal_profile(profiles, sure), "equal")
    add("equal sibling", equal)
    rest = left()
    related = M.by_related_profile(profiles, sure).join(rest.select("id"), "id", "left_semi")
    add("related sibling", related.join(M.unknown_codes(rest, words, synonyms), "id", "left_anti"))
    return M.outcome(img, found, postings)


def ordered_manifest(outcome: DataFrame, names: DataFrame) -> DataFrame:
    """(id, rec, reason, position, new_name): matched names numbered within their record in natural order."""
    matched = outcome.where("rec IS NOT NULL").join(names.select("id", S.natural_key(F.col("name")).alias("nat")), "id").select("id", "rec", "nat")
    placed = R.numbered(matched, "rec", ["nat", "id"], "n").select("id", (F.col("n") - 1).alias("position"))
    out = outcome.join(placed, "id", "left")
    new = F.when(F.col("rec").isNotNull(), F.concat("rec", F.lit("_det"), F.col("position").cast("string"), F.lit(".jpg")))
    return out.select("id", "rec", "bracket", "reason", "position", new.alias("new_name"))
