"""Text functions for matching and profiling, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that comparable names leave out, in the form they have after lower-casing.
LEGAL_TOKENS = ["co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "llp", "ltd", "private", "pvt", "sa", "sarl", "sas"]


def basic_norm(text: Column) -> Column:
    """Lower case; everything but letters and digits becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def norm_name(text: Column) -> Column:
    """:func:`basic_norm` with ``&`` as ``and``, without legal forms."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))
    return F.array_join(F.filter(F.split(plain, " "), lambda t: ~t.isin(LEGAL_TOKENS)), " ")


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def casing(text: Column) -> Column:
    """UPPER, lower, Title, Mixed or no-ascii, by the ASCII letters."""
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    title = F.regexp_replace(text, "[^A-Za-z ]", "").rlike("^ *([A-Z][a-z]*)( +[A-Z][a-z]*)* *$")
    return (
        F.when(letters == "", "no-ascii").when(letters == F.upper(letters), "UPPER").when(letters == F.lower(letters), "lower").when(title, "Title").otherwise("Mixed")
    )


def script_bucket(text: Column) -> Column:
    """ascii, latin-ext or non-latin."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), "ascii").when(text.rlike(r"[^\x00-ɏ]"), "non-latin").otherwise("latin-ext")


def trigrams(text: Column) -> Column:
    """The distinct character trigrams of a text with two blanks before and one after it."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))
    return F.array_distinct(F.when(F.length(padded) >= 3, grams))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null if either is null or both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), F.size(F.array_union(a, b)))


def agreement(a: Column, b: Column) -> Column:
    """match, conflict, one_missing or both_missing; null and empty are missing."""
    no_a, no_b = F.coalesce(a == "", F.lit(True)), F.coalesce(b == "", F.lit(True))
    return F.when(no_a & no_b, "both_missing").when(no_a | no_b, "one_missing").when(a == b, "match").otherwise("conflict")


def first_number(text: Column) -> Column:
    """The first run of digits without leading zeros (0 stays), null if there is none."""
    digits = F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit(""))
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


#: Postal code shapes.
POSTAL = {"US": r"\b\d{5}(?:-\d{4})?\b", "India": r"\b[1-9]\d{5}\b", "France": r"\b\d{5}\b"}


def postal_code(text: Column, country: Column) -> Column:
    """The last token of the country's shape, null for others; a US code without its extension."""
    out = F.lit(None).cast("string")
    for name, shape in POSTAL.items():
        found = F.regexp_extract_all(text, F.lit(f"({shape})"), F.lit(1))
        out = F.when(country == name, F.substring(F.try_element_at(found, F.lit(-1)), 1, 6 if name == "India" else 5)).otherwise(out)
    return out


def last_component(address: Column) -> Column:
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.try_element_at(parts, F.lit(-1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def house_bucket(a: Column, b: Column, small: int = 10) -> Column:
    """exact, small_gap, big_gap or missing, for two house numbers as text; a gap without numbers is big."""
    gap = F.abs(F.try_to_number(first_number(a), F.lit("999999999999")).cast("long") - F.try_to_number(first_number(b), F.lit("999999999999")).cast("long"))
    return F.when(a.isNull() | b.isNull(), "missing").when(a == b, "exact").when(F.coalesce(gap <= small, F.lit(False)), "small_gap").otherwise("big_gap")


def replace_first(text: Column, pattern: str, to: str) -> Column:
    """The text with the first match of a pattern replaced."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", f"$1{to}")


def replace_many(text: Column, words: dict[str, str]) -> Column:
    """The text with literal words replaced, one after another."""
    for word, to in words.items():
        text = F.replace(text, F.lit(word), F.lit(to))
    return text
