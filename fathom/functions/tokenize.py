"""Tokens of texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]

#: What parts tokens, and what a token may be made of.
SEPARATORS = r"[^\p{L}\p{N}_-]+"
TOKEN = r"^[a-z_0-9-]+$"


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, in order; those with other than plain letters, digits, _ and - are dropped."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda t: t.rlike(TOKEN))


def words(text: Column) -> Column:
    """What stands between single spaces, without empty words: the format of already tokenized lines."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")


# Suffixes and what takes their place, from M. F. Porter, "An algorithm for suffix stripping" (1980).
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# A y that counts as a consonant is written Y while a word is stemmed.
_ANY, _ONE, _MORE = "[aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*$", "^[^aeiouy]*(?:[aeiouy]+[^aeiouy]+){2}"
_SOME = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT, _DOUBLE = "[^aeiouy][aeiouy][^aeiouywxY]$", r"([^aeiouy])\1$"


def _less(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _suffixes(word: Column, pairs, measure: str) -> Column:
    """The longest suffix decides, whether or not what is before it is long enough."""
    out = None
    for old, new in sorted(pairs, key=lambda p: -len(p[0])):
        stem = _less(word, len(old))
        fits = stem.rlike(measure) & stem.rlike("[st]$") if old == "ion" else stem.rlike(measure)
        value = F.when(fits, F.concat(stem, F.lit(new))).otherwise(word)
        out = F.when(word.endswith(old), value) if out is None else out.when(word.endswith(old), value)
    return out.otherwise(word)


def _plural(w: Column) -> Column:
    return F.when(w.rlike("(?:sses|ies)$"), _less(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _less(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    """Words that lose -ed or -ing end in a bar, for the next step."""
    cut = lambda n: F.when(_less(w, n).rlike(_ANY), F.concat(_less(w, n), F.lit("|"))).otherwise(w)
    eed = F.when(_less(w, 3).rlike(_SOME), _less(w, 1)).otherwise(w)
    return F.when(w.endswith("eed"), eed).when(w.endswith("ed"), cut(2)).when(w.endswith("ing"), cut(3)).otherwise(w)


def _mended(w: Column) -> Column:
    stem = _less(w, 1)
    mended = F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(stem.rlike(_DOUBLE) & ~stem.rlike("[lsz]$"), _less(w, 2))
    mended = mended.when(stem.rlike(_ONE) & stem.rlike(_SHORT), F.concat(stem, F.lit("e"))).otherwise(stem)
    return F.when(w.endswith("|"), mended).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(w.rlike("[yY]$") & _less(w, 1).rlike(_ANY), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _less(w, 1)
    return F.when(w.endswith("e") & (stem.rlike(_MORE) | (stem.rlike(_ONE) & ~stem.rlike(_SHORT))), stem).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(_MORE), _less(w, 1)).otherwise(w)


def _unless(kept: Step, step: Step) -> Step:
    return lambda w: F.when(kept(w), w).otherwise(step(w))


def stems(terms: Column) -> Column:
    """Porter's stems of an array of terms; terms of one or two characters and those with other than a to z stay.

    Each step is a pass over the array, so that no step's expression is repeated in the next one's.
    """
    # Terms that stay are marked in front; those to be stemmed hold letters only.
    kept = lambda w: w.startswith("^")
    terms = F.transform(terms, lambda w: F.when(w.rlike("^[a-z]{3,}$"), F.regexp_replace(w, "(^|[aeiouy])y", "$1Y")).otherwise(F.concat(F.lit("^"), w)))
    steps = (
        _plural, _past, _mended, _final_y, lambda w: _suffixes(w, STEP_2, _SOME), lambda w: _suffixes(w, STEP_3, _SOME),
        lambda w: _suffixes(w, [(s, "") for s in STEP_4], _MORE), _final_e, _final_l,
    )
    for step in steps:
        terms = F.transform(terms, _unless(kept, step))
    return F.transform(terms, lambda w: F.when(kept(w), F.substring(w, F.lit(2), F.length(w))).otherwise(F.translate(w, "Y", "y")))


def prepared(terms: Column, stop: Sequence[str] = (), stem: bool = False) -> Column:
    """Terms without those of the stop list, stemmed if wanted. The list is put into the plan: some hundreds of words, not a table."""
    if stop:
        terms = F.filter(terms, lambda t: ~t.isin(list(stop)))
    return stems(terms) if stem else terms
