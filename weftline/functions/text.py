"""Text canonicalization that stays in the JVM, except for canonical composition of marks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Separates the parts of a joined key; removed from inputs before it is used.
SEP = "\u0001"

#: Everything below U+0300 is stable under canonical composition, and so is U+2000..U+20CF but for
#: two spaces that no canonical form keeps; only other texts need the composing function.
_MAY_COMPOSE = "[\\u0300-\\u1FFF\\u20D0-\\x{10FFFF}]"

#: What is neither letter, digit nor part separator, and any full stop or comma that is no decimal mark.
_NOISE = f"[^0-9A-Za-z\\p{{L}}\\p{{Nd}}.,{SEP}]+|[.,](?:(?!\\p{{Nd}})|(?<!\\p{{Nd}}[.,]))"


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(c: Column) -> Column:
    """Canonical composition (NFC). Only texts that may change cross to Python; the others pass as null."""
    return F.coalesce(_compose(F.when(c.rlike(_MAY_COMPOSE), c)), c)


def fold_case(c: Column) -> Column:
    """Without case: upper case, by which sharp s equals SS (lower case would keep it apart)."""
    return F.upper(c)


def canonical_text(c: Column) -> Column:
    """Letters, digits and decimal marks of a text, composed and case-folded.

    A full stop or comma directly between two digits is a decimal mark and becomes a full stop.
    Part separators (SEP) stay, so an array joined with them is canonicalized in one pass.
    """
    return fold_case(F.translate(F.regexp_replace(composed(c), _NOISE, ""), ",", "."))


def joined_parts(parts: Column) -> Column:
    """An array of strings as one SEP-joined string; nulls vanish, a SEP inside a part becomes a space."""
    plain = F.array_join(parts, SEP)
    safe = F.array_join(F.transform(parts, lambda x: F.translate(x, SEP, " ")), SEP)
    held = F.array_join(parts, "")
    return F.when(F.instr(held, SEP) > 0, safe).otherwise(plain)


def canonical_parts(parts: Column) -> Column:
    """The non-empty canonical texts of an array, sorted; null stays null."""
    return F.sort_array(F.filter(F.split(canonical_text(joined_parts(parts)), SEP), lambda x: x != ""))


def strip(c: Column) -> Column:
    """Without outer whitespace of any kind."""
    return F.regexp_replace(c, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def fold_accents_expr(c: Column) -> Column:
    """Lower case with the accents of Latin letters removed (fixed pairs, no Python)."""
    src, dst = _accent_pairs()
    return F.translate(F.lower(c), src, dst)


def _accent_pairs() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0].isascii() and chr(cp) == chr(cp).lower():
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)
