"""Token columns: splitting, case, hyphens, filters, stop words, k-grams. All JVM side.

Null text counts as empty text. Blanks are the ASCII ones and no others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, patterns: ASCII blanks, ASCII punctuation at both ends of a token, and what makes a token a word.
BLANKS = r"[ \t\n\r\f\x0b]+"
EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
#: The edges of all tokens of a text at once.
ALL_EDGES = r"(?<![^ \t\n\r\f\x0b])[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+(?![^ \t\n\r\f\x0b])"
WORDLIKE = "[a-zA-Z0-9]"
PHRASE_WORD = "[a-z0-9]"

#: English stop words.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
    she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
    these those am is are was were be been being have has had having do does did doing a an the and but if or because as
    until while of at by for with about against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y
    ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
    mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
    wouldn't""".split()
)


def simple_tokenize(text: Column) -> Column:
    """Split at blanks, strip ASCII punctuation at both ends, drop what is empty then. The text is stripped in one pass, before it is split."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), ALL_EDGES, ""), BLANKS), lambda x: x != "")


#: Abbreviations whose period ends no sentence, though a capital follows. Those of single letters (as e.g. or J.) never do.
ABBREVIATIONS = tuple(
    """Dr Mr Mrs Ms Prof St Jr Sr Gen Col Sgt Lt Capt Rev Hon Gov Sen Rep Pres Fig Figs Eq Eqs Ref Refs Sec Ch Vol No Nos Nr pp vs cf al etc ca approx
    Inc Ltd Co Corp Bros Univ Dept Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec bzw usw evtl ggf inkl vgl Abb Tab Str Mme Mlle Sra Srta""".split()
)
#: What stands for the period of an abbreviation while sentences are split.
_KEPT = "\x01"
_CONTRACTED = ("can|not", "gim|me", "gon|na", "got|ta", "lem|me", "wan|na")
#: The public Penn Treebank rules, in order, as patterns and what stands for them.
TREEBANK = (
    (r'^"', "`` "),  # opening quotes
    (r'([ (\[{<])("|\'\')', "$1 `` "),
    (r"([:,])([^\d]|$)", " $1 $2"),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", " $1 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "),  # the last period of the text
    (rf"\b({'|'.join(ABBREVIATIONS)})\.(\s)", f"$1{_KEPT}$2"),
    (r"([^.\s]{2,})\.(\s+[A-ZÀ-ÖØ-ÞА-Я“\"(])", "$1 .$2"),  # and of each sentence
    (_KEPT, "."),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\[\](){}<>])", " $1 "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"$", " "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    *((rf"(?i)\b({a})({b})\b", "$1 $2") for a, b in (c.split("|") for c in _CONTRACTED)),
)


def treebank_tokenize(text: Column) -> Column:
    """Words and punctuation as tokens of their own, after the public Penn Treebank rules; contractions are split, abbreviations keep their period."""
    t = F.coalesce(text, F.lit(""))
    for pattern, put in TREEBANK:
        t = F.concat(t, F.lit(put)) if pattern == "$" else F.regexp_replace(t, pattern, put)
    return F.filter(F.split(t, BLANKS), lambda x: x != "")


def to_lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def handle_hyphen(tokens: Column) -> Column:
    """A token with a hyphen, then its parts, empty ones included; others as they are."""
    return F.flatten(F.transform(tokens, lambda t: F.when(F.contains(t, F.lit("-")), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))


def keep_wordlike(tokens: Column) -> Column:
    """Tokens with at least one ASCII letter or digit."""
    return F.filter(tokens, lambda x: x.rlike(WORDLIKE))


def phrase_words(lower_tokens: Column) -> Column:
    """The tokens that phrase indexes and phrase queries keep."""
    return F.filter(lower_tokens, lambda x: x.rlike(PHRASE_WORD))


def _is_stop(x: Column, extra: Iterable[str]) -> Column:
    return F.lower(x).isin(sorted({*STOP_WORDS, *(w.lower() for w in extra)}))


def remove_stopwords(tokens: Column, extra: Iterable[str] = ()) -> tuple[Column, Column]:
    """(kept, removed), both in order and with duplicates."""
    extra = tuple(extra)
    return F.filter(tokens, lambda x: ~_is_stop(x, extra)), F.filter(tokens, lambda x: _is_stop(x, extra))


def get_kgrams(term: Column, k: int = 3) -> Column:
    """The k-grams of ``$term$`` in order, duplicates kept; none where it is too short, or null."""
    padded = F.concat(F.lit("$"), term, F.lit("$"))
    n = F.length(padded) - k + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)))
    return F.when(n >= 1, grams).otherwise(F.array().cast("array<string>"))


def blank_words(text: Column) -> Column:
    """Words between blanks, as a preview counts them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda x: x != "")
