"""Finding and undoing wrong character decodings (problem 2).

A multinomial naive Bayes classifier over hashed byte bigrams is trained on words
of the collection that are garbled synthetically, one class for each encoding
chain and one for untouched words. A word's best chain is inverted and accepted
only if every step decodes strictly and the last gives characters that text is made
of; where UTF-8 was misread more often than the chain says, further strict steps
follow until it does. A document's words vote for its chain. Chains are undone one
after another until none is left.

Training takes every word of every document, with its count over the collection;
what comes to the driver is a matrix of fixed size (classes by BUCKETS). Detection
and repair take every document, whole.

Defined cases: null text is no case and stays null; empty or ASCII text is no
case and is unchanged; U+FFFD is a case that can't be restored; a text is complete
only if no character is known to be lost and no word is left that the model holds to
be garbled; repeated rows each come out; only ``doc_id`` and ``text`` are read, so further columns never clash.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, in_passes, spread

#: Words garbled in one go while training.
GO = 20_000
#: Buckets that byte bigrams are hashed to.
BUCKETS = 1 << 16
#: Additive smoothing of the bigram counts.
SMOOTH = 0.02
#: Log odds that a word needs at once, and that a document's words need together, to count as garbled by one-byte encodings.
WORD_ODDS, DOC_ODDS = 9.0, 10.0
#: Log odds that a word needs where UTF-8 was misread, whose strict decoding is proof of its own.
UTF8_ODDS = 2.0
#: Log odds under which a word has no vote, for one-byte encodings and for misread UTF-8.
VOTE, UTF8_VOTE = 4.0, 1.0
#: Taken from the odds where Latin letters would only stand for other Latin letters, as a slip of the pen also makes them.
LATIN_DOUBT = 4.0
#: Votes that a question mark between letters gives to every chain with a vote.
LOST_VOTE = 4.0
#: Models kept by the digest of their words, so that queries over the same documents train once.
KEPT_MODELS = 4

#: Encodings that UTF-8 bytes are often misread in.
MISREAD_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8-r", "iso8859-2", "iso8859-15", "cp1254", "mac_cyrillic")
#: Pairs (written in, read in) of one-byte encodings that are often mistaken for each other.
MISREAD_BYTE = (
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "mac_roman"), ("cp1250", "mac_roman"),
)

Step = tuple[str, str]
Chain = tuple[Step, ...]

CHAINS: tuple[Chain, ...] = (
    *(((("utf-8", w)),) for w in MISREAD_UTF8),
    *((("utf-8", w), ("utf-8", w)) for w in MISREAD_UTF8),
    *(((a, b),) for a, b in MISREAD_BYTE),
)


def chain_name(chain: Chain) -> str:
    """As ``utf-8>cp1252>utf-8>cp1252``: written in, read in, and so on."""
    return ">".join(x for step in chain for x in step)


@lru_cache(None)
def _table(enc: str) -> tuple[tuple[str, ...], dict[str, int]]:
    """Characters of the upper half of a one-byte encoding; undefined bytes are the control character of their number."""
    chars = []
    for b in range(128, 256):
        try:
            chars.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back: dict[str, int] = {}
    for b, ch in enumerate(chars, 128):
        back.setdefault(ch, b)
    for b in range(128, 160):  # a stray control character can only be its own byte
        back.setdefault(chr(b), b)
    return tuple(chars), back


@lru_cache(None)
def _defined(enc: str) -> tuple[str | None, ...]:
    """Characters of the upper half of a one-byte encoding; None where a byte has none."""
    return tuple(None if unicodedata.category(ch) == "Cc" else ch for ch in _table(enc)[0])


_MARKS = re.compile("[\x02\x03\n]")
_TWO = re.compile(r"[^\x00-\x7f]{2}")
_LOST = re.compile(r"[^\W\d_]\?[^\W\d_]")
#: A question mark or control character after a character that UTF-8's first bytes are often read as: the rest was lost.
_CUT = re.compile("[\u00c2-\u00df\u0413\u0420\u0421\u221a\u251c]\\?|[\x80-\x9f]")
_HIGH = re.compile(r"[^\x00-\x7f]+")
#: A stretch without ordinary blanks that holds other than ASCII characters.
WORD = re.compile(r"[^ \t\r\n\x0b\x0c]*[^\x00-\x7f][^ \t\r\n\x0b\x0c]*")


def high_words(text: str) -> list[str]:
    """What WORD finds, in order: stretches without ordinary blanks that aren't all ASCII."""
    for blank in "\t\r\n\x0b\x0c":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if not w.isascii()]


@lru_cache(None)
def _misreading(read: str) -> np.ndarray:
    """The code point that each byte is read as."""
    return np.array([*range(128), *map(ord, _table(read)[0])], "<u4")


@lru_cache(None)
def _writing(written: str) -> np.ndarray:
    """The byte that each code point is written as; 63, a question mark, where there is none."""
    out = np.full(1 << 16, 63, np.uint8)
    out[:128] = range(128)
    for ch, b in _table(written)[1].items():
        out[ord(ch)] = b
    return out


@lru_cache(None)
def _repertoire(enc: str) -> frozenset[str]:
    return frozenset(map(chr, range(128))) | frozenset(_table(enc)[1])


def _writable(text: str, enc: str) -> bool:
    return enc == "utf-8" or _repertoire(enc).issuperset(text)


def garble(text: str, chain: Chain) -> str:
    """``text``, writable in the chain's first encoding, as a reader with the wrong encodings sees it."""
    for written, read in chain:
        data = text.encode("utf-8") if written == "utf-8" else _writing(written)[np.frombuffer(text.encode("utf-32-le"), "<u4")].tobytes()
        text = _misreading(read)[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")
    return text


def _undo(run: str, step: Step) -> str | None:
    """The run of high characters before one step, or None if the step can't have made it."""
    written, read = step
    _, back = _table(read)
    data = bytearray()
    for ch in run:
        b = back.get(ch)
        if b is None:
            return None
        data.append(b)
    if written == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    chars = _defined(written)
    out = [chars[b - 128] for b in data]
    return None if None in out else "".join(out)


_PLAIN = set("“”‘’„‚«»‹›–—…•€£§°±²³¹½¼¾¿¡·×÷©®™†‡√≤≥≈∞№µªº ")


@lru_cache(1 << 16)
def _usual(ch: str) -> bool:
    """Whether a character is one that running text is made of."""
    o = ord(ch)
    if o < 128:
        return o >= 32
    if ch in _PLAIN:
        return True
    kind = unicodedata.category(ch)
    if kind in ("Lu", "Ll"):
        return o < 0x180 or 0x370 <= o < 0x460 or 0x1E00 <= o < 0x2000 or 0x218 <= o <= 0x21B
    if kind == "Mn":
        return o <= 0x345
    return o >= 0x2000 and kind[0] in "LNPS" and kind != "Co" or kind in ("Cf", "Zs")


#: First bytes of the UTF-8 of Latin and Cyrillic letters.
_LEADS = frozenset({*range(0xC2, 0xC6), 0xD0, 0xD1})


def _is_cut(word: str, end: int, read: str) -> bool:
    """Whether the character before ``end`` is a first byte whose rest was lost to a question mark within the word."""
    return word[end : end + 1] == "?" and word[end + 1 : end + 2].isalpha() and _table(read)[1].get(word[end - 1]) in _LEADS


def _step_back(word: str, step: Step) -> str | None:
    """The word before one step. Every run of high characters must decode; as UTF-8, what lost a byte may stay where another run decodes."""
    out, at, undone = [], 0, 0
    for m in _HIGH.finditer(word):
        run = m.group()
        s = _undo(run, step)
        if s is None:
            if step[0] != "utf-8":
                return None
            if len(run) == 1:
                s, undone = run, undone - 1
            elif not _is_cut(word, m.end(), step[1]) or (s := _undo(run[:-1], step)) is None:
                return None
            else:
                s += run[-1]
        undone += 1
        out += (word[at : m.start()], s)
        at = m.end()
    if not undone:
        return None
    out.append(word[at:])
    return "".join(out)


def cut(word: str, chain: Chain) -> bool:
    """Whether misread UTF-8 lost bytes in the word, so that it can't be restored."""
    return len(chain) == 1 and chain[0][0] == "utf-8" and any(_is_cut(word, m.end(), chain[0][1]) for m in _HIGH.finditer(word))


def _deeper(word: str) -> str | None:
    """A word of usual characters from which repeated misreading of UTF-8 made this one; each step decodes strictly and leaves a shorter word, so this ends."""
    seen = set()
    for read in MISREAD_UTF8:
        before = _step_back(word, ("utf-8", read))
        if before is None or before in seen:
            continue
        seen.add(before)
        if not all(map(_usual, before)):
            before = _deeper(before)
        if before is not None:
            return before
    return None


def invert(word: str, chain: Chain) -> str | None:
    """The word before the chain; None unless it decodes strictly, and to usual characters in the end.

    Between steps any characters will do. Where a chain of misread UTF-8 leaves a word
    of unusual ones, it was misread more often, and is undone until it isn't.
    """
    for step in reversed(chain):
        if (word := _step_back(word, step)) is None:
            return None
    if all(map(_usual, word)):
        return word
    return _deeper(word) if chain[0][0] == "utf-8" else None


_LETTERS = re.compile(r"[^\W\d_]+")
#: Cyrillic letters that look Latin; alone within Latin words they are a disguise, not a wrong encoding.
_LOOK_LATIN = set("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ")


def _natural(run: str) -> bool:
    """Whether a run of letters is of one script and written small, capital or with a capital first."""
    cyrillic = sum("\u0400" <= c <= "\u052f" for c in run)
    return cyrillic in (0, len(run)) and (run[1:].islower() or run.isupper() or len(run) == 1)


def sound(word: str, chain: Chain) -> bool:
    """Whether the chain can be undone in the word. One-byte chains, of which any byte decodes, must also give natural words, one of them of changed letters and not all too short."""
    before = invert(word, chain)
    if before is None or chain[0][0] == "utf-8":
        return before is not None
    if "\xa0" in word or not any(map(str.isalpha, word)) or all(c < "\x80" or c in _LOOK_LATIN for c in word):
        return False
    runs = [m.group() for m in _LETTERS.finditer(before)]
    return all(map(_natural, runs)) and any(not r.isascii() and len(r) >= (2 if r > "\u0400" else 3) for r in runs)


def _bigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams that touch a high byte, and the mask of those."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    left, right = a[:-1], a[1:]
    high = (left > 127) | (right > 127)
    return ((left[high] << 8 | right[high]) * np.uint32(40503)) & np.uint32(BUCKETS - 1), high


def _any(word: str) -> bool:
    return True


def _cyrillic(word: str) -> bool:
    return any("\u0400" <= c <= "\u052f" for c in word)


def _greek(word: str) -> bool:
    return any("\u0370" <= c <= "\u03ff" for c in word)


def _symbols(word: str) -> bool:
    return not any(c > "\x7f" and c.isalpha() for c in word)


def _capitals(word: str) -> bool:
    return word.upper() == word and not _symbols(word)


def _cyrillic_capitals(word: str) -> bool:
    return _cyrillic(word) and _capitals(word)


#: Untouched words are modelled by kind, so that a rare script or sign isn't held against a word.
KINDS = (_any, _cyrillic, _greek, _symbols, _capitals, _cyrillic_capitals)


def _bytes(word: str) -> bytes:
    return b"\x02" + word.encode("utf-8", "replace") + b"\x03"


def training_counts(words: Iterable[tuple[str, float]]) -> np.ndarray:
    """Weights of bigrams by class that clean words with their counts give; those of parts of the words add up to those of all."""
    counts = np.zeros((len(KINDS) + len(CHAINS), BUCKETS))

    def add(k: int, made: list[str], weights: np.ndarray) -> None:
        if made:
            data = b"\x02" + "\n".join(made).encode("utf-8", "replace").replace(b"\n", b"\x03\x02") + b"\x03"
            keys, high = _bigrams(data)
            of_byte = weights[np.cumsum(np.frombuffer(data, np.uint8) == 2) - 1]
            counts[k] += np.bincount(keys, of_byte[:-1][high], BUCKETS)

    def learn(part: list[tuple[str, float]]) -> None:
        # frequent words count less than in proportion, else a few names would rule; each counts a tenth in capitals too
        plain: Counter[str] = Counter()
        for w, n in part:
            if not _MARKS.search(w):
                plain[w] += n**0.5
                if (u := w.upper()) != w:
                    plain[u] += 0.1 * n**0.5
        for k, kind in enumerate(KINDS):
            of_kind = [w for w in plain if kind(w)]
            add(k, of_kind, np.array([plain[w] for w in of_kind]))
        writable = {enc: [w for w in plain if _writable(w, enc)] for enc in {chain[0][0] for chain in CHAINS}}
        for k, chain in enumerate(CHAINS, len(KINDS)):
            fit = writable[chain[0][0]]
            pairs = [(g, w) for g, w in zip(garble("\n".join(fit), chain).split("\n"), fit) if g != w] if fit else []
            add(k, [g for g, _ in pairs], np.array([plain[w] for _, w in pairs]))

    part: list[tuple[str, float]] = []
    for word in words:
        part.append(word)
        if len(part) == GO:
            learn(part)
            part = []
    learn(part)
    return counts


@dataclass
class Model:
    """Log probabilities of bigrams by class: first untouched words by KINDS, then the chains."""

    logp: np.ndarray

    @staticmethod
    def of_counts(counts: np.ndarray) -> "Model":
        counts = counts + SMOOTH
        return Model(np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))

    @staticmethod
    def train(words: dict[str, int]) -> "Model":
        """From clean words with their counts: each is garbled by every chain that can be."""
        return Model.of_counts(training_counts([(w, n) for w, n in words.items()]))

    def odds(self, word: str) -> np.ndarray:
        """Log odds of each chain against untouched text, without regard to decodability."""
        s = self.logp[:, _bigrams(_bytes(word))[0]].sum(1)
        return s[len(KINDS) :] - s[: len(KINDS)].max()


_LEAST = np.array([UTF8_VOTE if chain[0][0] == "utf-8" else VOTE for chain in CHAINS])


_CYRILLIC_FIRST = ("koi8-r", "cp1251", "cp866")
_LATIN = np.array([0.0 if chain[0][0] in ("utf-8", *_CYRILLIC_FIRST) else LATIN_DOUBT for chain in CHAINS], np.float32)


@dataclass
class Verdict:
    garbled: bool
    chain: str | None
    text: str
    complete: bool


class Judge:
    """Applies a model to texts; keeps what it found about words."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def word(self, w: str) -> list[tuple[int, float]]:
        """Chains that strictly invert the word, or that lost bytes of it, with their log odds, those high enough for a vote."""
        if (known := self.seen.get(w)) is None:
            odds = self.model.odds(w)
            if all(c < "\x80" or c < "\u0250" and c.isalpha() for c in w):
                odds -= _LATIN
            known = [(int(k), float(odds[k])) for k in np.flatnonzero(odds >= _LEAST) if sound(w, CHAINS[k]) or cut(w, CHAINS[k])]
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = known
        return known

    def doubtful(self, w: str) -> bool:
        """Whether the model holds a word to be garbled, also where no chain can be undone in it."""
        odds = self.model.odds(w)
        if all(c < "\x80" or c < "\u0250" and c.isalpha() for c in w):
            odds = odds - _LATIN
        return float(odds.max()) >= WORD_ODDS

    def once(self, text: str) -> tuple[str | None, str, bool]:
        """One round: the chain of most votes, if they suffice, the text without it, and whether all words it may have met are undone."""
        words = dict.fromkeys(high_words(text))
        votes: Counter[int] = Counter()
        best: Counter[int] = Counter()
        for w in words:
            for k, odds in self.word(w):
                votes[k] += odds
                best[k] = max(best[k], odds)
        if not votes:
            return None, text, True
        if _LOST.search(text):  # question marks within words: letters that an encoding lacked
            for k in votes:
                votes[k] += LOST_VOTE
        enough = [k for k in votes if (best[k] >= UTF8_ODDS if CHAINS[k][0][0] == "utf-8" else best[k] >= WORD_ODDS and votes[k] >= DOC_ODDS)]
        if not enough:
            return None, text, True
        k = max(enough, key=lambda k: (votes[k], -k))

        left = False

        def mend(m: re.Match) -> str:
            nonlocal left
            w = m.group()
            known = dict(self.word(w))
            best = k if k in known else max(known, key=known.get, default=None)
            if best is not None and (best == k or known[best] >= WORD_ODDS) and (before := invert(w, CHAINS[best])) is not None:
                return before
            # any byte decodes in a one-byte encoding: a word that stays may have been met too
            left = left or CHAINS[k][0][0] != "utf-8"
            return w

        mended = WORD.sub(mend, text)
        return chain_name(CHAINS[k]), mended, not left

    def text(self, text: str) -> Verdict:
        """The verdict on a whole text, undoing one chain after another until none is found or a text comes back."""
        if text.isascii():
            return Verdict(False, None, text, True)
        lost = "�" in text
        chains: list[str] = []
        seen, whole = {text}, True
        while True:
            name, mended, undone = self.once(text)
            if name is None:
                break
            chains.append(name)
            whole = whole and undone
            if mended in seen:  # what is left can't be restored
                whole = False
                break
            seen.add(mended)
            text = mended
        complete = not lost and whole and (not chains or not _LOST.search(text) and not _CUT.search(text) and not any(map(self.doubtful, set(high_words(text)))))
        return Verdict(bool(chains) or lost, "+".join(chains) or ("lost" if lost else None), text, complete)


def suspicious(word: str) -> bool:
    """Whether a word may be garbled by a chain that starts from UTF-8, or has lost characters; used to keep training words clean."""
    if "�" in word or any("\x80" <= c <= "\x9f" for c in word):
        return True
    return _TWO.search(word) is not None and any(chain[0][0] == "utf-8" and invert(word, chain) is not None for chain in CHAINS)


def _gathered(words: DataFrame, trained: Callable[[], Callable[[str], bool]]) -> np.ndarray:
    """``training_counts`` of a stored table of words (w, count) that what ``trained`` makes in each task holds to be clean: sums of fixed size from few tasks."""
    classes = len(KINDS) + len(CHAINS)
    tasks = 2 * words.sparkSession.sparkContext.defaultParallelism
    if words.rdd.getNumPartitions() > tasks:
        words = words.coalesce(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = trained()
        m = training_counts((w, n) for batch in batches for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if clean(w))
        used = np.flatnonzero(m.any(0))
        for at in range(0, len(used), 4096):
            rows = used[at : at + 4096]
            sums = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m[:, rows].T).ravel()), classes).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), sums], ["bucket", "sums"])

    summed = words.mapInArrow(run, "bucket int, sums array<double>").groupBy("bucket").agg(*(F.sum(F.col("sums")[k]).alias(f"c{k}") for k in range(classes)))
    found = summed.toPandas()
    out = np.zeros((classes, BUCKETS))
    out[:, found["bucket"].to_numpy(int)] = found.drop(columns="bucket").to_numpy(float).T
    return out


_models: dict[object, Model] = {}


def _kept(key: object, train: Callable[[], Model]) -> Model:
    """The model of a digest, trained once a process."""
    if key not in _models:
        made = train()
        while len(_models) >= KEPT_MODELS:
            _models.pop(next(iter(_models)))
        _models[key] = made
    return _models[key]


def _is_kept(w: str, judge: "Judge") -> bool:
    return _symbols(w) or max((o for _, o in judge.word(w)), default=0) < WORD_ODDS


def fit(documents: DataFrame) -> Model:
    """Train on all words of all documents that aren't all ASCII.

    Two passes: words that the first model holds to be garbled leave the second
    one's training set. A collection without such words gives a model that finds nothing.
    """
    words = (
        documents.select("text")
        .where(F.col("text").rlike(r"[^\x00-\x7f]"))
        .select(F.explode(F.split("text", r"[ \t\r\n\x0b\f]+")).alias("w"))
        .where(F.col("w").rlike(r"[^\x00-\x7f]"))
        .groupBy("w")
        .count()
    )
    words = in_passes([words], "words")
    # sums of hashes of all words with their counts, exact and in any order, tell the collection
    digest = words.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(k), "w", "count").cast("decimal(38,0)")) for k in range(2))).first()
    context = documents.sparkSession.sparkContext

    def train() -> Model:
        spread_words = in_passes([words.repartition(2 * context.defaultParallelism).where(_pure("w"))], "clean")
        first = context.broadcast(Model.of_counts(_gathered(spread_words, lambda: lambda w: True)))

        def second() -> Callable[[str], bool]:
            judge = Judge(first.value)
            return lambda w: _is_kept(w, judge)

        model = Model.of_counts(_gathered(spread_words, second))
        dropped(spread_words)
        return model

    model = _kept(tuple(digest), train)
    dropped(words)
    return model


def _pure(column: str):
    """Whether a word isn't ``suspicious``."""

    @F.pandas_udf("boolean")
    def pure(words: pd.Series) -> pd.Series:
        return ~words.map(suspicious).astype(bool)

    return pure(column)


def fit_words(words: dict[str, int]) -> Model:
    """The model of clean words found in ``words``; kept, so that the same words are trained on once a process."""

    def train() -> Model:
        clean = {w: n for w, n in words.items() if not suspicious(w)}
        judge = Judge(Model.train(clean))
        return Model.train({w: n for w, n in clean.items() if _is_kept(w, judge)})

    return _kept(xxhash.xxh3_128_hexdigest("\n".join(f"{w}\t{n}" for w, n in sorted(words.items()))), train)


_OUT = "doc_id bigint, garbled boolean, chain string, restored string, complete boolean"


def judged(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Every document's verdict: doc_id, garbled, chain, restored (the text, mended where possible), complete (nothing was lost for good)."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            found = [None if t is None else judge.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([v is not None and v.garbled for v in found], pa.bool_()),
                    pa.array([v and v.chain for v in found], pa.string()),
                    pa.array([v and v.text for v in found], pa.string()),
                    pa.array([v is None or v.complete for v in found], pa.bool_()),
                ],
                ["doc_id", "garbled", "chain", "restored", "complete"],
            )

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, _OUT)


def garbled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id of every document that holds garbled characters."""
    return judged(documents, model).where("garbled").select("doc_id").distinct()
