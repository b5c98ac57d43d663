"""Identifiers, vocabularies and names."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of vocabularies and their common names.
VOCABULARIES = {
    "SCTID": "SNOMED",
    "SNOMEDCT": "SNOMED",
    "SNOMEDCT_US": "SNOMED",
    "UMLS": "UMLS",
    "MEDGEN": "MEDGEN",
    "MESH": "MESH",
    "MEDDRA": "MEDDRA",
    "OMIM": "OMIM",
    "OMIMPS": "OMIMPS",
    "ORPHA": "Orphanet",
    "ORPHANET": "Orphanet",
    "DOID": "DOID",
    "NCIT": "NCIT",
    "ICD10": "ICD10",
    "ICD-10": "ICD10",
    "ICD10CM": "ICD10CM",
    "ICD9": "ICD9",
    "ICD-9": "ICD9",
    "ICD9CM": "ICD9CM",
    "ICD11.FOUNDATION": "ICD11",
    "EFO": "EFO",
    "GARD": "GARD",
}
STOPWORDS = ("of", "the", "a", "an", "in", "on", "with", "and", "to", "by")
TRUE_WORDS = ("true", "1", "1.0", "yes", "y", "t")
# Greek letters and isomer marks of drug names, and the marks of name lists that follow a name.
SPELLED = ("alpha", "beta", "gamma", "delta", "omega", "l", "d")
ISOMERS = ("+/-", "+-", "rs", "+", "-")
NAME_LISTS = ("USP", "JAN", "INN", "USAN", "BAN", "TN", "DCF", "NF", "JP")


def _ascii_parts() -> dict[str, str]:
    """What compatibility decomposition and ASCII leave of each character that has such a part."""
    every = (chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000)
    return {c: kept for c in every if (kept := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())}


_PARTS = _ascii_parts()
#: Characters that become one, and those that become several.
_ONE = {c: p for c, p in _PARTS.items() if len(p) == 1}
_MANY = {c: p for c, p in _PARTS.items() if len(p) > 1}


def colon_id(c: Column) -> Column:
    """``MONDO_0005148`` as ``MONDO:0005148``; other ids stay."""
    return F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9.]*)_([0-9]+)$", "$1:$2")


def underscore_id(c: Column) -> Column:
    """The inverse, at the first colon only."""
    return F.regexp_replace(c, r"^([^:]*):", "$1_")


def vocabulary(raw: Column) -> Column:
    """Common name of a vocabulary; null if it is none of those kept."""
    known = F.create_map(*[F.lit(x) for pair in VOCABULARIES.items() for x in pair])
    return F.try_element_at(known, F.upper(F.trim(raw)))


def xref(raw: Column) -> Column:
    """``SCTID: 1`` as a struct ``source, code``; null if the vocabulary is unknown or the code empty."""
    source = vocabulary(F.substring_index(raw, ":", 1))
    code = F.when(F.contains(raw, F.lit(":")), F.trim(F.regexp_replace(raw, "^[^:]*:", ""))).otherwise(F.lit(""))
    return F.when(source.isNotNull() & (F.length(code) > 0), F.struct(source.alias("source"), code.alias("code")))


def _pages() -> list[list[str | None] | None]:
    """What the characters of ``_MANY`` become, by page of 256 code points and place there."""
    out: list = [None] * (max(map(ord, _MANY)) // 256 + 1)
    for c, p in _MANY.items():
        page = out[ord(c) // 256] = out[ord(c) // 256] or [None] * 256
        page[ord(c) % 256] = p
    return out


def ascii_fold(c: Column) -> Column:
    """Characters in their compatibility decomposition, without what is beyond ASCII then.

    A text of ASCII alone is passed on as it is. Characters that become
    several (ligatures, fractions, units) are looked up by code point, in the
    texts that have any. No step tests a character against a list of them.
    """
    table = F.from_json(F.lit(json.dumps(_pages())), "array<array<string>>")  # a constant, folded when the query is planned
    at = lambda x: F.get(F.get(table, F.call_function("shiftright", F.ascii(x), F.lit(8))), F.ascii(x).bitwiseAND(F.lit(255)))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x < "\x80", x).otherwise(F.coalesce(at(x), x))), "")
    beyond = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    whole = F.when(F.translate(beyond, "".join(_MANY), "") != beyond, spelled).otherwise(c)
    folded = F.regexp_replace(F.translate(whole, "".join(_ONE), "".join(_ONE.values())), r"[^\x00-\x7F]+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def normalise(c: Column) -> Column:
    """Lower case, without accents, bracketed parts and punctuation; a null is empty."""
    x = F.replace(F.lower(ascii_fold(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, r"\(.*?\)", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def token_key(normalised: Column) -> Column:
    """Words without stopwords, sorted; repeated words stay."""
    words = F.filter(F.split(normalised, " +"), lambda w: (F.length(w) > 0) & ~w.isin(*STOPWORDS))
    return F.array_join(F.array_sort(words), " ")


def drug_name(c: Column) -> Column:
    """Letters and digits of a drug's name; spelled-out marks between points stay, isomer signs in brackets go; null if nothing is left."""
    spelled = F.regexp_replace(F.lower(ascii_fold(c)), rf"\.({'|'.join(SPELLED)})\.", "$1")
    bare = F.regexp_replace(spelled, rf"\((?:{'|'.join(map(re.escape, ISOMERS))})\)|[^a-z0-9]", "")
    return F.nullif(bare, F.lit(""))


def name_keys(names: Column) -> Column:
    """Keys of a ``;`` list of names, each without the mark of the list that it comes from."""
    bare = F.transform(F.split(names, ";"), lambda x: drug_name(F.regexp_replace(x, rf"\((?:{'|'.join(NAME_LISTS)})[^)]*\)", "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x.isNotNull())))


def without_prefix(c: Column, *prefixes: str) -> Column:
    """The text without the first of the prefixes that it begins with."""
    return F.regexp_replace(c, f"^(?:{'|'.join(map(re.escape, prefixes))})", "")


def gene_tokens(c: Column) -> Column:
    """Gene symbols that are followed by a human gene number, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Z0-9][A-Z0-9\-]{1,12})\s*\[HSA:"), F.lit(1))))


def section(c: Column, begin: str, end: str | None = None) -> Column:
    """What follows a heading, up to another one or the end of the text; empty without the heading."""
    return F.regexp_extract(c, rf"(?s){re.escape(begin)}(.*?)(?:{re.escape(end)}|\z)" if end else rf"(?s){re.escape(begin)}(.*)\z", 1)


def clamped(c: Column) -> Column:
    """A figure between 0 and 1; null if it is no number."""
    return F.when(number(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(c))))


def number(c: Column) -> Column:
    """A finite number, or null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def shortened(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def truth(c: Column) -> Column:
    """True for any of the spellings of true, of any type; else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def whole(c: Column) -> Column:
    """An id that may be written ``123.0``, as a long; null if it is no number."""
    return c.try_cast("double").try_cast("long")


def json_in_text(c: Column) -> Column:
    """The first ``{...}`` of a text that may wrap it in a fence."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
