"""Tokens of log bodies: small letters, parted at everything but letters and digits, stemmed if wanted."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

PARTING = "[^\\p{L}\\p{N}]+"
_PARTING = re.compile(r"[\W_]+")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")


def tokens(body: Column) -> Column:
    """Tokens of a body in order, with repetitions; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(body, F.lit(""))), PARTING), lambda t: t != "")


def query_tokens(text: str, stemmed: bool = False) -> list[str]:
    """The distinct tokens of a query text."""
    found = dict.fromkeys(t for t in _PARTING.split(text.lower()) if t)
    return list(dict.fromkeys(stem(t) for t in found)) if stemmed else list(found)


def _shape(word: str) -> str:
    """v for each run of vowels, c for each run of consonants."""
    out = ""
    for i, ch in enumerate(word):
        kind = "v" if ch in "aeiou" or (ch == "y" and i and out[-1:] == "c") else "c"
        if out[-1:] != kind:
            out += kind
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", word))


_SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def stem(word: str) -> str:
    """Porter's stem of an English word; other words mostly stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in _shape(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
                        word += "e"
                    elif _DOUBLE.search(word):
                        word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_SECOND, _THIRD):
        for end in sorted(table, key=len, reverse=True):
            if word.endswith(end):
                if _measure(word[: -len(end)]):
                    word = word[: -len(end)] + table[end]
                break
    for end in sorted(_FOURTH, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def _stemmed(lists: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(t: str) -> str:
        if t not in known:
            known[t] = stem(t)
        return known[t]

    return lists.map(lambda ts: [one(t) for t in ts])


def stemmed_tokens(body: Column) -> Column:
    """Tokens with Porter's stems; meant for a column that is written once at ingest."""
    return _stemmed(tokens(body))


def has_all_tokens(body: Column, text: str) -> Column:
    """Whether a body has every token of the query text, as it stands, in any order; a text without a token matches nothing."""
    return _has_all(tokens(body), query_tokens(text))


def stored_has_all(stored: Column, text: str) -> Column:
    """Whether tokens stored at ingest, with stems, have the stem of every token of the query text; none matches a text without a token."""
    return _has_all(stored, query_tokens(text, stemmed=True))


def has_all_stems(body: Column, text: str) -> Column:
    """The same for a body without stored tokens. A stem has all but the last letter of itself in common with its word, so bodies
    without these letters are left out before any is stemmed."""
    wanted = query_tokens(text, stemmed=True)
    if not wanted:
        return F.lit(False)
    maybe = reduce(Column.__and__, [F.contains(F.lower(body), F.lit(t[:-1] if len(t) > 1 else t)) for t in wanted])
    return F.when(maybe, stored_has_all(stemmed_tokens(F.when(maybe, body)), text)).otherwise(False)


def _has_all(found: Column, wanted: list[str]) -> Column:
    return reduce(Column.__and__, [F.array_contains(found, t) for t in wanted]) if wanted else F.lit(False)
