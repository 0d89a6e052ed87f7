"""Stemmers and their Arrow-batched column forms.

Both stemmers are written from the published descriptions of their algorithms. They
are meant for distinct tokens: see ``operators.normalize``.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = "aeiou"

#: Forms that the extended Porter stemmer maps at once.
_PORTER_FORMS = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in _VOWELS or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:  # extension: a vowel and a consonant alone
        return shape == "vc"
    return shape[-3:] == "cvc" and word[-1] not in "wxy"


#: Suffixes of steps 2, 3 and 4 with what replaces them.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(word: str, rules: tuple) -> str:
    """The first rule whose suffix fits decides; it applies where the stem has a measure."""
    for suffix, put in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + put if _measure(stem) > 0 else word
    return word


@lru_cache(1 << 16)
def porter(word: str) -> str:
    """The Porter stem with the usual extensions; lower-cases first."""
    w = word.lower()
    if w in _PORTER_FORMS:
        return _PORTER_FORMS[w]
    if len(w) <= 2:
        return w
    # plurals
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past forms
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            stem = w[: -len(suffix)]
            if w.endswith(suffix):
                if "v" in _shape(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        stem += "e"
                    elif _double(stem):
                        stem = stem if stem[-1] in "lsz" else stem[:-1]
                    elif _measure(stem) == 1 and _cvc(stem):
                        stem += "e"
                    w = stem
                break
    # final y
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    # double suffixes
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = _replace(w[:-2], _STEP2)
    elif w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _replace(w, tuple(sorted(_STEP2, key=lambda r: -len(r[0]))))
    w = _replace(w, _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    # final e and double l
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or m == 1 and not _cvc(stem):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


#: Fixed values of the second stemmer: whole words with their stems, words left alone after plurals, and suffix tables.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_ALONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_SECOND2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_SECOND3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_SECOND4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _vowel(ch: str) -> bool:
    return ch in "aeiouy"


def _region(w: str, start: int) -> int:
    """After the first non-vowel that follows a vowel."""
    for i in range(start + 1, len(w)):
        if not _vowel(w[i]) and _vowel(w[i - 1]):
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return _vowel(w[0]) and not _vowel(w[1])
    return len(w) > 2 and not _vowel(w[-3]) and _vowel(w[-2]) and not _vowel(w[-1]) and w[-1] not in "wxY"


@lru_cache(1 << 16)
def snowball(word: str) -> str:
    """The stem by the second ("English") algorithm of the Porter family."""
    w = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = w.removeprefix("'")
    w = "".join("Y" if ch == "y" and (i == 0 or _vowel(w[i - 1])) else ch for i, ch in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)

    def ends(suffix: str, start: int) -> bool:
        return w.endswith(suffix) and len(w) - len(suffix) >= start

    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(map(_vowel, w[:-2])):
        w = w[:-1]
    if w in _ALONE:
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                w = w[: -len(s)] + "ee" if ends(s, r1) else w
            elif any(map(_vowel, w[: -len(s)])):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and not _vowel(w[-2]):
        w = w[:-1] + "i"
    for s, put in _SECOND2:
        if w.endswith(s):
            if ends(s, r1) and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(s)] + put
            break
    for s, put in _SECOND3:
        if w.endswith(s):
            if ends(s, r2 if s == "ative" else r1):
                w = w[: -len(s)] + put
            break
    for s in _SECOND4:
        if w.endswith(s):
            if ends(s, r2) and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def porter_column(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action="ignore")


@F.pandas_udf(StringType())
def snowball_column(words: pd.Series) -> pd.Series:
    return words.map(snowball, na_action="ignore")


def stem_column(stemmer: str = "porter"):
    """The column function of a stemmer; any name but ``porter`` means the second one."""
    return porter_column if stemmer == "porter" else snowball_column
