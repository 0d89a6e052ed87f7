"""Soundex and Metaphone codes of terms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Soundex digits of the letters.
_DIGITS = {**dict.fromkeys("BFPV", "1"), **dict.fromkeys("CGJKQSXZ", "2"), **dict.fromkeys("DT", "3"), "L": "4", **dict.fromkeys("MN", "5"), "R": "6"}


def soundex_of(term: str) -> str:
    """Letter and three digits; accents are taken off first, H and W are passed over, other signs part equal digits."""
    s = unicodedata.normalize("NFKD", term).upper()
    if not s:
        return ""
    code, last = s[0], _DIGITS.get(s[0])
    for ch in s[1:]:
        digit = _DIGITS.get(ch)
        if digit and digit != last:
            code += digit
            if len(code) == 4:
                break
        if ch not in "HW":
            last = digit
    return code.ljust(4, "0")


@F.pandas_udf(StringType())
def _soundex_other(terms: pd.Series) -> pd.Series:
    return terms.map(soundex_of, na_action="ignore")


def soundex(term: Column) -> Column:
    """Soundex; the built-in function for plain ASCII terms, batches in Python for others."""
    return F.when(term.rlike("^[A-Za-z][A-Za-z]*$"), F.soundex(term)).otherwise(_soundex_other(term))


@lru_cache(1 << 16)
def metaphone_of(term: str) -> str:
    """The Metaphone code, after Philips's published rules."""
    s = "".join(c for c in unicodedata.normalize("NFKD", term).upper() if not unicodedata.combining(c))
    if not s:
        return ""
    for start in ("KN", "GN", "PN", "WR", "AE"):
        if s.startswith(start):
            s = s[1:]
            break
    if s.startswith("X"):
        s = "S" + s[1:]
    elif s.startswith("WH"):
        s = "W" + s[2:]
    out: list[str] = []
    i, n = 0, len(s)
    at = lambda k: s[k] if 0 <= k < n else ""
    front = lambda ch: ch != "" and ch in "EIY"
    vowel = lambda ch: ch != "" and ch in "AEIOU"
    while i < n:
        c, after, before = s[i], at(i + 1), at(i - 1)
        if c == before and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (before == "M" and i == n - 1):
                out.append("B")
        elif c == "C":
            if front(after):
                if s[i : i + 3] == "CIA":
                    out.append("X")
                elif before != "S":
                    out.append("S")
            elif after == "H":
                out.append("K" if before == "S" or i == 0 and not vowel(at(i + 2)) else "X")
                i += 1
            else:
                out.append("K")
        elif c == "D":
            if after == "G" and front(at(i + 2)):
                out.append("J")
                i += 1
            else:
                out.append("T")
        elif c == "G":
            if after == "H":
                if not (i + 2 < n and not vowel(at(i + 2))) and i + 2 < n:
                    out.append("K")
                i += 1
            elif after == "N" and (i + 2 == n or s[i + 2 :] == "ED"):
                pass
            elif front(after) and before != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if vowel(after) and before not in tuple("CGPST"):
                out.append("H")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            if after == "H":
                out.append("F")
                i += 1
            else:
                out.append("P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if after == "H":
                out.append("X")
                i += 1
            elif after == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif s[i + 1 : i + 3] == "CH":
                out.append("SK")
                i += 2
            else:
                out.append("S")
        elif c == "T":
            if after == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif after == "H":
                out.append("0")
                i += 1
            elif s[i + 1 : i + 3] != "CH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if vowel(after):
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        elif c in "FJLMNR":
            out.append(c)
        elif c == " " and out and out[-1] != " ":
            out.append(" ")
        i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def metaphone(terms: pd.Series) -> pd.Series:
    return terms.map(metaphone_of, na_action="ignore")


def phonetic_code(term: Column, method: str = "soundex") -> Column:
    """The code by ``method``; any name but ``soundex`` means Metaphone."""
    return soundex(term) if method == "soundex" else metaphone(term)
