"""One consistent form for text that looks alike (problem 4).

Normalization quick-check properties tell which characters can change: text
without any is passed on as it is. Elsewhere only the unstable segments, each with
the starter before it and the marks after it as context, are normalized and
spliced into the unchanged rest. Then blanks and invisible characters are brought
to ordinary form, and letters of another script that stand for the expected one
within a run of letters are replaced.

What counts as a disguise: full-width and other compatibility forms of letters,
digits, signs and hyphens (not superscripts, fractions, ellipses or the like); a
letter with a combining mark where one character exists; invisible characters (all
default-ignorable ones; joiners within emoji excepted); blanks other than space, tab
and line ends, among them vertical tab and form feed; look-alike letters. Greek letters as symbols, typographic quotes and dashes and
words wholly in their own script are left alone.

Defined cases: null stays null and is no case; empty text is unchanged; repeated
rows each come out; only the named columns are read, so further columns never
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import encoding

#: Letters of other scripts, and special Latin letters, with the plain Latin letter each looks like.
LOOK_ALIKES = {
    # Cyrillic, small
    "а": "a", "ԁ": "d", "е": "e", "ѐ": "è", "ё": "ë", "һ": "h", "і": "i", "ї": "ï", "ј": "j", "ԛ": "q", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y", "ӏ": "l",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ё": "Ë", "Ԍ": "G", "Н": "H", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
    # Greek, small and capital
    "α": "a", "ϲ": "c", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ό": "ó", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϳ": "j",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z", "Ϳ": "J",
    # Armenian
    "ց": "g", "հ": "h", "ի": "h", "յ": "j", "ո": "n", "օ": "o", "գ": "q", "զ": "q", "ս": "u", "ա": "w", "ք": "p", "ռ": "n", "ղ": "n", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L", "Ո": "n",
    # Cherokee and Lisu capitals most often met
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z",
    # special letters of the Latin script
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ȷ": "j", "ꞌ": "'", "ʋ": "u", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ʏ": "y", "ɪ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ꞓ": "c",
}
#: By rule: small capitals of the Latin script, each for its letter, as far as the table above has none.
LOOK_ALIKES |= {
    c: base
    for c in map(chr, (*range(0x250, 0x2B0), *range(0x1D00, 0x1D2C), *range(0xA730, 0xA7F8)))
    if (name := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(base := name.rpartition(" ")[2].lower()) == 1 and name.count(" ") == 4 and c not in LOOK_ALIKES
}
#: Special letters that are Latin by name but are disguises of a plain one.
_SPECIAL = {c for c in LOOK_ALIKES if unicodedata.name(c, "").startswith("LATIN")}
#: From plain Latin letters to the Cyrillic ones that look alike, for words otherwise Cyrillic; in Russian use.
_TO_CYRILLIC = {LOOK_ALIKES[c]: c for c in "аеорсухАВСЕНКМОРТХУёЁі"}
#: Compatibility forms that stand for letters, digits, signs or hyphens, by the tag of their decomposition.
_TAGS = {"<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Ranges of the property Default_Ignorable_Code_Point, and characters that show nothing though they are letters or signs.
_IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x2800, 0x2800), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
#: Blanks that are neither of the category of blanks nor ordinary.
_BLANKS = "\x0b\x0c\x85\u2028\u2029"
_JOINERS = {"‍", "️", "︎"}


def _plain_form(ch: str) -> str | None:
    """What a compatibility form stands for; None where the character isn't one that counts."""
    way = unicodedata.decomposition(ch)
    if not way.startswith("<"):
        return None
    tag = way.partition(" ")[0]
    form = unicodedata.normalize("NFKC", ch)
    letters = unicodedata.category(ch)[0] == "L" and len(form) > 1 and all(c.isalpha() or c in "'ʼ" for c in form) or len(form) == 1 and form.isalpha() and ord(form) < 128
    roman = unicodedata.name(ch, "").startswith(("ROMAN NUMERAL", "SMALL ROMAN NUMERAL"))
    if tag in _TAGS or tag == "<noBreak>" and form == "‐" or tag == "<compat>" and (letters or roman) and ch not in "µ":
        return "-" if form in ("‐", "‑", "﹣") else form
    return None


@lru_cache(1)
def _unstable() -> tuple[dict[str, str], re.Pattern, re.Pattern]:
    """By rule from the character database: compatibility forms; a class of all characters that can change; one of blanks and invisible ones."""
    forms, unstable, hidden = {}, [], [0x0B, 0x0C]
    for o in range(0x80, sys.maxunicode + 1):
        ch = chr(o)
        kind = unicodedata.category(ch)
        if kind in ("Zs", "Cf") or ch in _JOINERS or ch in _BLANKS or any(a <= o <= b for a, b in _IGNORABLE):
            hidden.append(o)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if (form := _plain_form(ch)) is not None:
            forms[ch] = form
        if ch in forms or unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch) or 0x1160 <= o <= 0x11FF:
            unstable.append(o)

    def ranges(points: list[int]) -> str:
        out, start = [], None
        for o in points:
            if start is None or o != last + 1:
                if start is not None:
                    out.append((start, last))
                start = o
            last = o
        out.append((start, last))
        return "".join(re.escape(chr(a)) + "-" + re.escape(chr(b)) for a, b in out)

    # a segment: the starter before it as context, then characters that may change
    return forms, re.compile(f"[^{ranges(unstable)}]?[{ranges(unstable)}]+"), re.compile(f"[{ranges(hidden)}]")


_RUN = re.compile(r"[^\W\d_]+")


@lru_cache(1 << 14)
def _script(ch: str) -> str:
    if ch < "\x80":
        return "L"
    if ch in _SPECIAL:
        return "S"
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "A", "CHEROKEE": "K"}.get(unicodedata.name(ch, "?").partition(" ")[0], "?")


@lru_cache(1 << 14)
def _like(ch: str) -> str | None:
    """The Latin letter that a letter looks like, with its marks."""
    if (like := LOOK_ALIKES.get(ch)) is None and len(parts := unicodedata.normalize("NFD", ch)) > 1 and parts[0] in LOOK_ALIKES:
        like = unicodedata.normalize("NFC", LOOK_ALIKES[parts[0]] + parts[1:])
    return like


def _settled(run: str, latin: bool) -> str:
    """The run with look-alikes of other scripts replaced; itself where it mixes nothing. latin: whether the text around is Latin."""
    kinds = Counter(map(_script, run))
    if set(kinds) <= {"L"} or "?" in kinds:
        return run
    firm = {k for ch in run if (k := _script(ch)) not in "SAK" and (_like(ch) is None if k != "L" else ch.lower() not in _TO_CYRILLIC and ch not in _TO_CYRILLIC)}
    if set(kinds) <= {"C"}:
        return run
    if len(kinds) == 1 and not (latin and set(kinds) <= set("SAK") and all(map(_like, run))):
        return run  # wholly in its own script
    if "C" in firm and "L" not in firm:
        return "".join(_TO_CYRILLIC.get(_like(c) or c, c) if _script(c) != "C" else c for c in run)
    if firm <= {"L"}:
        return "".join(_like(c) or c if _script(c) != "L" else c for c in run)
    return run  # letters of two scripts that don't look alike: symbols


class Canon:
    """Brings texts to canonical form and names what was changed."""

    def __init__(self):
        self.forms, self.segments, self.hidden = _unstable()
        self.runs: dict[tuple[str, bool], str] = {}
        self.checks: dict[str, int] = {}

    def check(self, ch: str) -> int:
        """Quick check of a character: 1 blank or invisible, 2 may change under normalization, 4 a letter that may stand for another."""
        if (bits := self.checks.get(ch)) is None:
            foreign = ch.isalpha() and _script(ch) != "L"
            bits = bool(self.hidden.match(ch)) | self._moves(ch) << 1 | foreign << 2
            self.checks[ch] = bits
        return bits

    def _moves(self, ch: str) -> bool:
        return ch in self.forms or bool(unicodedata.combining(ch)) or not unicodedata.is_normalized("NFC", ch) or "\u1160" <= ch <= "\u11ff"

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The canonical text, and the kinds of disguise found: form, mark, hidden, blank, letter."""
        if text.isascii() and "\x0b" not in text and "\x0c" not in text:
            return text, []
        bits = 0
        for ch in set(text):
            if ch > "\x7f" or ch in _BLANKS:
                bits |= self.check(ch)
        if not bits:
            return text, []
        kinds: dict[str, None] = {}
        out = text

        def visible(m: re.Match) -> str:
            ch, at = m.group(), m.start()
            if unicodedata.category(ch) == "Zs" or ch in _BLANKS:
                kinds["blank"] = None
                return " " if ch not in "\x85\u2028\u2029" else "\n"
            if ch in _JOINERS and at and unicodedata.category(text[at - 1]) in ("So", "Sk"):
                return ch  # part of an emoji
            kinds["hidden"] = None
            return ""

        def segment(m: re.Match) -> str:
            s = m.group()
            new = "".join(self.forms.get(c, c) for c in s)
            if new != s:
                kinds["form"] = None
            if unicodedata.is_normalized("NFC", new):
                return new
            kinds["mark"] = None
            return unicodedata.normalize("NFC", new)

        if bits & 1:
            out = self.hidden.sub(visible, out)
        if bits & 2:
            out = self.segments.sub(segment, out)
        if bits & 6 and not out.isascii():
            latin = None

            def run(m: re.Match) -> str:
                nonlocal latin
                s = m.group()
                if s.isascii():
                    return s
                if latin is None:  # whether the text around is Latin
                    latin = sum(c < "\x80" and c.isalpha() for c in out) * 2 >= sum(map(str.isalpha, out))
                if (new := self.runs.get((s, latin))) is None:
                    new = _settled(s, latin)
                    if len(self.runs) > 200_000:
                        self.runs.clear()
                    self.runs[s, latin] = new
                if new != s:
                    kinds["letter"] = None
                return new

            out = _RUN.sub(run, out)
        return out, list(kinds)


#: What a text without any disguise lacks: characters beyond ASCII, vertical tabs and form feeds.
_SOME = r"[^\x00-\x7f]|[\x0b\x0c]"
_FORM = "{0}, {1} string, canonical string, kinds array<string>, changed boolean"


def canonical(df: DataFrame, key: str, column: str) -> DataFrame:
    """Each row's ``key`` and ``column`` with its ``canonical`` form, the ``kinds`` of disguise and whether it was ``changed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            found = [(None, []) if t is None else canon(t) for t in batch.column(1).to_pylist()]
            texts = pa.array([t for t, _ in found], pa.string())
            kinds = pa.array([k for _, k in found], pa.list_(pa.string()))
            changed = pa.array([bool(k) for _, k in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, kinds, changed], [key, column, "canonical", "kinds", "changed"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, column)).mapInArrow(run, _FORM.format(f"{key} {kind}", column))


def disguised(documents: DataFrame, inverted: DataFrame, model: encoding.Model | None = None) -> DataFrame:
    """place, rec_id of every disguised record of both tables; documents with garbled characters (problem 2) are none.

    One pass a table: a document that holds a disguise is judged for garbling in the same task.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or encoding.fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, judge = Canon(), encoding.Judge(shared.value)
        for batch in batches:
            hit = [t is not None and bool(canon(t)[1]) and not judge.text(t).garbled for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], ["rec_id"])

    texts = spread(documents.select(F.col("doc_id").cast("bigint").alias("rec_id"), "text").where(F.col("text").rlike(_SOME))).mapInArrow(run, "rec_id bigint")
    terms = canonical(inverted.select("entry_id", "term").where(F.col("term").rlike(_SOME)), "entry_id", "term").where("changed")
    return (
        texts.select(F.lit("documents").alias("place"), "rec_id")
        .union(terms.select(F.lit("inverted_index").alias("place"), F.col("entry_id").cast("bigint").alias("rec_id")))
        .distinct()
    )
