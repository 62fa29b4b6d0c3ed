"""Words of texts as search terms: plain ones for ranking, stemmed and folded ones for matching."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.slices import in_slices

#: Very common English words that do not count as terms.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
WORD = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of two or more letters, digits or underscores, in order and with repeats."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def query_terms(query: str, stop_words: list[str] | None = None) -> list[str]:
    """The same for a query, on the driver."""
    stop = set(STOP_WORDS if stop_words is None else stop_words)
    return [w for w in re.findall(r"[^\W]{2,}", query.lower()) if w not in stop]




def _measure(stem: str) -> int:
    kinds = re.sub("C+", "C", re.sub("V+", "V", "".join("V" if _vowel(stem, i) else "C" for i in range(len(stem)))))
    return kinds.count("VC")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log", bli="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Longest endings first.
_STEP2, _STEP3 = ({end: table[end] for end in sorted(table, key=len, reverse=True)} for table in (_STEP2, _STEP3))
_STEP4.sort(key=len, reverse=True)


def _swap(w: str, table: dict[str, str]) -> str:
    for end in table:
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + table[end] if _measure(stem) > 0 else w
    return w


def stem(word: str) -> str:
    """Porter's stemmer (1980) for a lower-case word."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in _STEP4:
        if w.endswith(end):
            s = w[: len(w) - len(end)]
            if _measure(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


#: Stems that a process remembers, of the latest words that are not longer than LONG_WORD.
KNOWN_WORDS, LONG_WORD = 1 << 16, 32
_known = lru_cache(KNOWN_WORDS)(stem)


@cache
def _combining() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFKD", text).translate(_combining())


def match_terms(text: str | None) -> list[str]:
    """Folded, stemmed words in order."""
    return [_known(w) if len(w) <= LONG_WORD else stem(w) for w in re.findall(r"[^\W_]+", fold(text or ""))]


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(text: pa.Array) -> pa.Array:
    return in_slices(match_terms, pa.list_(pa.string()), text)
