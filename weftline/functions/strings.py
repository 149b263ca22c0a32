"""String functions for file names, headers and cells; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.functions.text import fold_accents_expr, strip

#: Words without meaning of their own (fixed values): in any text, and in catalogue texts.
STOP_GENERAL = ["a", "an", "and", "de", "des", "du", "for", "la", "le", "les", "of", "the", "to", "with"]
STOP_DOMAIN = ["article", "collection", "color", "colour", "image", "model", "new", "product", "size", "style"]
#: Prefixes that cameras give (fixed values).
CAMERA_PREFIXES = ["dscn", "dsc", "img", "image", "photo", "pic", "picture", "scan", "p", "capture", "shot"]

#: Splits between a digit and what is none (fixed pattern).
BOUNDARY = "(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])"
#: What tells shots of one product apart (fixed pattern).
SHOT = "^([a-z]|[0-9]{1,3}|[a-z][0-9]{1,2}|det[0-9]+|ret|retouch(ed)?|copy|front|back|side|top|detail[0-9]*)$"
#: Numbers that say nothing about identity, in the order they are removed (fixed patterns).
NOISE = [
    r"(?<![A-Za-z0-9])\d+(?:[.,]\d+)?\s*[xX]\s*\d+(?:[.,]\d+)?(?:\s*[xX]\s*\d+(?:[.,]\d+)?)?(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])(?:\d{4}[-_./]\d{1,2}[-_./]\d{1,2}|\d{1,2}[-_./]\d{1,2}[-_./]\d{2,4})(?![A-Za-z0-9])",
    r"(?i)(?<![A-Za-z0-9])\d+(?:[.,]\d+)?\s*(?:%|mm|cm|m|meter|meters|g|gr|kg|kilo|l|ml|oz|lb|lbs|inch|inches|in|ft)(?![A-Za-z0-9])",
    r"(?i)(?<![A-Za-z0-9])(?:date|dated|day|month|year|week|season|expiry|expires|expiration|valid|from|until|to)\s*[-_:]?\s*\d{1,4}(?![A-Za-z0-9])",
]
#: Columns whose numbers are identifiers and stay (fixed values), written without marks in lower case.
TRUSTED = ["familyid", "famid", "ean", "sku", "ref", "refco", "reference"]


def basename(c: Column) -> Column:
    """Behind the last slash or backslash."""
    return F.regexp_extract(c, "([^/\\\\]*)$", 1)


def stem(c: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(c), "\\.[^.]*$", "")


def extension(c: Column) -> Column:
    """The last extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(c), "(\\.[^.]*)$", 1))


def folder(c: Column) -> Column:
    """The last folder of a path; empty if there is none."""
    return F.regexp_extract(c, "([^/\\\\]+)[/\\\\][^/\\\\]*$", 1)


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(fold_accents_expr(c), "\\p{M}", "")


def normalized_term(c: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(folded(c), "[^a-z0-9]", "")


def header_tokens(c: Column) -> Column:
    """Runs of folded letters and digits."""
    return F.regexp_extract_all(folded(c), F.lit("[a-z0-9]+"), 0)


def cell_tokens(c: Column) -> Column:
    """Lower-case pieces of a cell between its separators."""
    return F.filter(F.split(F.lower(c), "[ \\t\\r\\n,;/\\\\|:._-]+"), lambda t: t != "")


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[0-9]+"), 0)


def digits_only(c: Column) -> Column:
    """All digits of a text; null if it has none."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(d != "", d)


def filename_tokens(c: Column) -> Column:
    """Words of a file name's stem and their parts between letters and digits, without short ones, numbers
    and stop words; each once, lower case."""
    raw = F.filter(F.split(F.lower(stem(c)), "[^a-zà-öø-ÿ0-9]+"), lambda t: t != "")
    parts = F.flatten(F.transform(raw, lambda t: F.array_union(F.array(t), F.split(t, BOUNDARY))))
    stop = F.array(*[F.lit(w) for w in STOP_GENERAL + STOP_DOMAIN])
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~F.array_contains(stop, t)))


def profile_tokens(c: Column) -> Column:
    """Words that tell what a file shows: short codes whole, others cut between letters and digits, without
    single characters and words for the shot; sorted, each once."""
    raw = F.split(folded(stem(c)), "[^a-z0-9]+")
    parts = F.flatten(F.transform(raw, lambda t: F.when(t.rlike("^[a-z]{1,2}[0-9]+$"), F.array(t)).otherwise(
        F.filter(F.split(t, BOUNDARY), lambda p: (F.length(p) >= 2) & ~p.rlike(SHOT)))))
    return F.array_sort(F.array_distinct(parts))


def collapsed_stem(c: Column) -> Column:
    """A stem without copy marks at its end and without separators, lower case."""
    bare = F.regexp_replace(F.lower(stem(c)), "(\\s*\\([0-9]+\\)|[-_ ]+(copy|ret|retouch(ed)?))+$", "")
    return F.translate(bare, " _-.", "")


def natural_key(c: Column) -> Column:
    """Sorts digit runs, however long, as numbers and letters without case: a run stands behind the number of its digits."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[^0-9]"), 0)
    number = lambda t: F.regexp_replace(t, "^0+", "")
    return F.array_join(F.transform(pieces, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.format_string("%010d", F.length(number(t))), number(t))).otherwise(t)), "")


#: What the last word of a stem tells of the camera's place (fixed values).
ORIENTATION = {
    "front": "FRONT", "frontal": "FRONT", "face": "FRONT", "avant": "FRONT", "delante": "FRONT",
    "back": "BACK", "rear": "BACK", "dos": "BACK", "espalda": "BACK", "retro": "BACK", "achterkant": "BACK",
    "side": "SIDEON", "lateral": "SIDEON", "profile": "SIDEON", "profil": "SIDEON", "perfil": "SIDEON",
    "top": "TOP", "boven": "TOP", "oben": "TOP", "bottom": "BOTTOM", "under": "BOTTOM", "dessous": "BOTTOM", "onder": "BOTTOM",
    "diagonal": "DIAGONAL", "diag": "DIAGONAL", "angle": "DIAGONAL",
}


def alphanumeric_words(c: Column) -> Column:
    """Runs of letters and digits of a text, as written."""
    return F.regexp_extract_all(c, F.lit("[\\p{L}\\p{Nd}]+"), 0)


def orientation(name: Column) -> Column:
    """The camera's place by the last word of a file name's stem; null if that word tells none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ORIENTATION.items() for x in pair]), F.lower(F.try_element_at(alphanumeric_words(stem(name)), F.lit(-1))))


def without_noise(c: Column, column_name: Column | None = None) -> Column:
    """A text without measures, dates and the numbers beside date words; identifier columns stay as they are."""
    out = c
    for pattern in NOISE:
        out = F.regexp_replace(out, pattern, " ")
    out = strip(F.regexp_replace(out, "\\s+", " "))
    if column_name is None:
        return out
    return F.when(F.lower(F.regexp_replace(strip(column_name), "[_-]", "")).isin(TRUSTED), strip(c)).otherwise(out)


def says_nothing(c: Column) -> Column:
    """True if no word of three letters is left in the file name but camera prefixes."""
    prefixes = F.array(*[F.lit(p) for p in CAMERA_PREFIXES])
    words = F.flatten(F.transform(F.split(folded(stem(c)), "[^a-z0-9]+"), lambda t: F.split(t, BOUNDARY)))
    return ~F.exists(words, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~F.array_contains(prefixes, t))


def safe_filename(c: Column, ordinal: Column) -> Column:
    """A numbered name in which only letters, digits, dots, dashes and underscores are left."""
    return F.format_string("%06d_%s.jpg", ordinal.cast("int"), F.regexp_replace(stem(c), "[^A-Za-z0-9._-]", "_"))


def entropy_of_shares(lengths: Column) -> Column:
    """Entropy (natural log) of the shares of an array of lengths."""
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(lengths, F.lit(0.0), lambda a, x: a - F.when(x > 0, (x / total) * F.ln(x / total)).otherwise(0.0))


def concatenation_distance(tokens: Column) -> Column:
    """Distance of two or more tokens in order from the text they form together: one less than their number,
    raised by how unevenly they share its length. One token has distance 0."""
    lengths = F.transform(tokens, lambda t: F.length(t).cast("double"))
    n = F.size(tokens)
    return F.when(n == 1, F.lit(0.0)).otherwise((n - 1) * (2.0 - entropy_of_shares(lengths) / F.ln(n.cast("double"))))


def distance_confidence(distance: Column, decay: float = 0.5) -> Column:
    """Percent of confidence that falls with the distance."""
    return 100.0 * F.exp(-decay * distance)


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """Differing bits of two 128-bit values held as two longs each."""
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))
