"""Subject areas of documents in any language (problem 8).

Complement naive Bayes over hashed words, trained from the labelled documents and
refined by expectation-maximization over all documents, each sentence of a
document having a subject of its own. Word counts are kept by language, so that a
language isn't taken for a subject; the language of a document is found by naive
Bayes from the (unreliable) ``lang`` column of the whole collection. The LANGUAGES
commonest have counts of their own, all others share one further set. Words whose
subjects don't differ significantly from their language's (G statistic) have no
say. The share of a document's text that goes to a subject is calibrated, one curve a
subject with floor and ceiling for wrong and lacking labels, against the labels of
documents whose labels were kept out of the counts (one in HELD_OUT, by a hash of
doc_id); then the counts are made once more, with all labels.

Counts, languages, expectation steps and calibration cover all documents and all
labels. What is gathered on the driver are matrices of a fixed size.

Texts are first mended (problem 2) and brought to canonical form (problem 4).

Defined cases: null and blank texts have no subject; every other text has one or
two, also a text without words, which gets the commonest; labels are matched
without regard to case and outer blanks, unknown and null ones are ignored, and
repeated ones count once; documents of repeated doc_id count and come out once;
further columns never clash; without any usable label, or on empty tables, the
result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from . import canonical, encoding
from .common import one_row_each

#: Hash buckets of words in each language, and languages with counts of their own (of at least LANGUAGE_SHARE of the documents); all others have theirs together.
BUCKETS, LANGUAGES, LANGUAGE_SHARE = 1 << 15, 12, 0.005
#: Smoothing of counts; weight of a sentence of an unlabelled document against a labelled one's.
SMOOTH, UNLABELLED = 0.3, 1.0
#: Least G statistic of a word to have a say, by round: from labels alone, then with all documents. Change of the expected counts under which further rounds are left out.
SIGNIFICANT, SETTLED = (3.0, 6.0, 10.0, 12.0, 12.0, 12.0), 0.01
#: How far the labels of a document are trusted over its own text, and the least posterior of a sentence to be learnt from.
TRUST, SURE = 0.7, 0.8
#: One in so many labelled documents lends its labels to the calibration before they are counted.
HELD_OUT = 5
#: Least calibrated posterior of a second subject.
POSTERIOR = 0.5
#: The share at which a subject is expected to begin and the slope of its curve in log odds, before any label is seen; and how many labelled cases near it that expectation is worth.
USUAL, WORTH = (0.25, 6.0), 20.0
#: Bins of a unit of log odds in which calibration cases are counted, and the shares under and over which all are taken for no case and a case.
BINS, CLEAR = 8, (0.03, 0.6)

_words = regex.compile(r"\p{L}+(?:-\p{L}+)*").findall
_sentences = regex.compile(r"(?<=[.!?])[”\"’»“)]*\s+|\n+").split


def features(documents: DataFrame, labels: DataFrame, subjects: list[str], model: encoding.Model | None = None) -> DataFrame:
    """doc_id, lang (two letters or null), labels (indexes of subjects), words (hashes), ends (of sentences in words), chars (of sentences)."""
    shared = documents.sparkSession.sparkContext.broadcast(model or encoding.fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, canon, known = encoding.Judge(shared.value), canonical.Canon(), {}
        for batch in batches:
            words, ends, chars, starts, cuts = [], [], [], [0], [0]
            for text in batch.column(2).to_pylist():
                text = canon(judge.text(text).text)[0].lower()
                own = 0
                for sentence in _sentences(text):
                    if found := _words(sentence):
                        for w in found:
                            if (h := known.get(w)) is None:
                                h = known[w] = xxhash.xxh32_intdigest(w) % BUCKETS
                            words.append(h)
                        own += len(found)
                        ends.append(own)
                        chars.append(len(sentence))
                starts.append(len(words))
                cuts.append(len(ends))
            if len(known) > 500_000:
                known.clear()
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(starts, words), lists(cuts, ends), lists(cuts, chars)], ["doc_id", "lang", "words", "ends", "chars"]
            )

    lang = F.lower(F.regexp_extract("lang", "^([A-Za-z]{2})(?:$|[-_])", 1))
    texts = documents.select(F.col("doc_id").cast("bigint"), F.when(lang != "", lang).alias("lang"), "text").where(F.col("text").rlike(r"[^\s\p{Z}]"))
    made = spread(one_row_each(texts, "doc_id", "text")).mapInArrow(run, "doc_id bigint, lang string, words array<int>, ends array<int>, chars array<int>")
    index = F.create_map(*(x for k, s in enumerate(subjects) for x in (F.lit(s.strip().lower()), F.lit(k))))
    named = labels.select(F.col("doc_id").cast("bigint"), index[F.lower(F.trim("subject"))].alias("s")).where("s is not null")
    labelled = named.groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("labels"))
    # at most one entry a subject in a set
    return made.join(labelled.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_OUT)) == 0), "doc_id", "left")


def _odds(share):
    return np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))


class Batch:
    """Arrays of a batch of featured documents, flat by word, sentence and document."""

    def __init__(self, batch: pa.RecordBatch, n_subjects: int, with_held: bool = False):
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        flat = lambda a: (a.flatten().to_numpy(zero_copy_only=False), np.diff(a.offsets.to_numpy()))
        self.ids, self.lang = col["doc_id"], col["lang"].to_pylist()
        self.words, self.doc_words = flat(col["words"])
        ends, self.doc_sentences = flat(col["ends"])
        self.chars = flat(col["chars"])[0].astype(float)
        first = np.cumsum(self.doc_sentences) - self.doc_sentences
        self.n = len(self.lang)
        self.sentence_doc = np.repeat(np.arange(self.n), self.doc_sentences)
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        begin[first[self.doc_sentences > 0]] = 0
        self.sentence_words = ends - begin
        self.labels = np.zeros((self.n, n_subjects))
        for k, (own, held) in enumerate(zip(col["labels"].to_pylist(), col["held"].to_pylist())):
            if own and (with_held or not held):
                self.labels[k, own] = 1
        self.labelled = self.labels.any(1)

    def by_sentence(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each sentence; values has a row for each word."""
        if not len(self.sentence_words):
            return np.zeros((0, values.shape[1]))
        return np.add.reduceat(values, np.cumsum(self.sentence_words) - self.sentence_words, 0).astype(float)  # a sentence has a word at least

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of rows of sentences over each document."""
        sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0)])
        at = np.cumsum(self.doc_sentences)
        return sums[at] - sums[at - self.doc_sentences]


def gathered(table: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum over all tasks of a matrix of fixed size that each makes of its batches.

    Tasks are few and large, two for each core, so that what they send is in proportion
    to the cores and not to the data.
    """
    names = [f"c{i}" for i in range(columns)]
    tasks = 2 * table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() > tasks:
        table = table.coalesce(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = partial(batches)
        used = np.flatnonzero(m.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(m[used, i], pa.float32()) for i in range(columns))], ["row", *names])

    summed = table.mapInArrow(run, "row int, " + ", ".join(f"{c} float" for c in names)).groupBy("row").agg(*(F.sum(c).alias(c) for c in names))
    found = summed.toPandas()
    out = np.zeros((rows, columns))
    out[found["row"].to_numpy(int)] = found[names].to_numpy(float)
    return out


class Subjects:
    """The classifier: language model, word weights by language and subject, calibration curves."""

    def __init__(self, language_logp: np.ndarray, n_subjects: int):
        self.language_logp, self.n_subjects = np.ascontiguousarray(language_logp, np.float32), n_subjects
        self.n_languages = language_logp.shape[1]
        self.weights: np.ndarray | None = None
        self.prior = np.full(n_subjects, 1 / n_subjects)
        self.curves = [(float(_odds(USUAL[0])), USUAL[1])] * n_subjects

    def language(self, b: Batch) -> np.ndarray:
        """The likeliest language of each document, by its words."""
        return b.by_doc(b.by_sentence(self.language_logp[b.words])).argmax(1)

    def learn(self, counts: np.ndarray, significant: float) -> None:
        """Complement naive Bayes weights from expected counts, rows by language and bucket, columns by subject."""
        n = counts.reshape(self.n_languages, BUCKETS, self.n_subjects)
        total = n.sum(2, keepdims=True)
        base = (n.sum(1, keepdims=True) + 1e-9) / (n.sum((1, 2), keepdims=True) + 1e-9 * self.n_subjects)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * np.where(n > 0, n * np.log(n / (base * total)), 0).sum(2)
        rest = total - n + SMOOTH * (1 - base) * self.n_subjects / max(1, self.n_subjects - 1) + 1e-9
        w = -np.log(rest / rest.sum(1, keepdims=True))
        w -= w.mean(2, keepdims=True)
        w[g < significant] = 0
        self.weights = np.ascontiguousarray(w.reshape(-1, self.n_subjects), np.float32)
        whole = n.sum((0, 1))
        self.prior = (whole + 1) / (whole + 1).sum()

    def judge(self, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, likelihoods of each sentence (the greatest is 1) and the share of each subject in each document, from the text alone."""
        rows = b.words + np.repeat(self.language(b), b.doc_words) * BUCKETS
        scores = b.by_sentence(self.weights[rows])
        likely = np.exp(scores - scores.max(1, keepdims=True, initial=-np.inf))
        alone = _posterior(likely, 1.0)
        told = np.clip(1 + (alone * np.log(alone + 1e-12)).sum(1) / np.log(max(2, self.n_subjects)), 0, 1)
        weight = (b.chars * told + 1e-6)[:, None]
        share = np.full((b.n, self.n_subjects), 1 / self.n_subjects)
        whole = b.by_doc(weight)
        for _ in range(5):
            share = b.by_doc(_posterior(likely, share[b.sentence_doc]) * weight) + 0.02 * whole + 1e-3
            share /= share.sum(1, keepdims=True)
        share = b.by_doc(_posterior(likely, share[b.sentence_doc]) * weight)
        total = share.sum(1, keepdims=True)
        share = np.where(total > 0, share / np.maximum(total, 1e-12), self.prior)
        return rows, likely, share

    def posterior(self, share: np.ndarray) -> np.ndarray:
        """Calibrated, independent posterior of each subject."""
        odds = _odds(share)
        return np.stack([1 / (1 + np.exp(-np.clip(k * (odds[:, c] - at), -50, 50))) for c, (at, k) in enumerate(self.curves)], 1)


def _posterior(likely: np.ndarray, prior: np.ndarray | float) -> np.ndarray:
    p = likely * prior + 1e-30
    return p / p.sum(1, keepdims=True)


def _from_labels(b: Batch) -> np.ndarray:
    """Sentence posteriors by the document's labels alone; zero without any."""
    return (b.labels / np.maximum(1, b.labels.sum(1, keepdims=True)))[b.sentence_doc]


def _expected(b: Batch, model: Subjects) -> tuple[np.ndarray, np.ndarray]:
    """Word rows and sentence posteriors, a labelled document's drawn to its labels; unsure sentences count nothing."""
    rows, likely, share = model.judge(b)
    given = b.labels / np.maximum(1, b.labels.sum(1, keepdims=True))
    share = np.where(b.labelled[:, None], TRUST * given + (1 - TRUST) * share, share)
    p = _posterior(likely, share[b.sentence_doc] + 1e-6)
    p *= (np.where(b.labelled, 1.0, UNLABELLED)[b.sentence_doc] * (p.max(1) > SURE))[:, None]
    return rows, p


def _curve(odds: np.ndarray, yes: np.ndarray, no: np.ndarray, floor: float, ceiling: float, expected: tuple[float, float]) -> tuple[float, float]:
    """Midpoint, in log odds of the share, and slope of the likeliest logistic curve between floor and ceiling.

    The cases are counted by log odds. ``expected`` counts like WORTH cases about its
    midpoint, where a case tells its slope squared by 1/16 of the midpoint.
    """
    at, slope = expected
    steps = np.array([1.0, 0.5])
    grid = np.linspace(-1, 1, 21)
    held = WORTH * expected[1] ** 2 / 16
    for _ in range(8):  # ever finer about the best; wide enough to leave the expected one
        ats, logs = at + steps[0] * grid[:, None, None], np.log(slope) + steps[1] * grid[None, :, None]
        p = floor + (ceiling - floor) / (1 + np.exp(-np.clip(np.exp(logs) * (odds - ats), -50, 50)))
        fit = (yes * np.log(p) + no * np.log(1 - p)).sum(2) - held / 2 * (ats - expected[0])[..., 0] ** 2 - WORTH / 2 * (logs - np.log(expected[1]))[..., 0] ** 2
        i, k = np.unravel_index(fit.argmax(), fit.shape)
        at, slope = float(ats[i, 0, 0]), float(np.exp(logs[0, k, 0]))
        if 0 < i < 20 and 0 < k < 20:
            steps = steps / 4
    return at, slope


def fit(table: DataFrame, n_subjects: int) -> Subjects | None:
    """Train on a stored table of ``features``; None where no label can be used."""
    # a language is two letters, so there are at most 676
    spoken = table.where("lang is not null and lang <> 'un'").groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    whole = sum(r["count"] for r in spoken)
    own = [r["lang"] for r in spoken[:LANGUAGES] if r["count"] >= LANGUAGE_SHARE * whole]
    place = {r["lang"]: own.index(r["lang"]) if r["lang"] in own else len(own) for r in spoken}
    n_languages = max(place.values(), default=0) + 1

    def by_language(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        m = np.zeros((BUCKETS, n_languages))
        for batch in batches:
            b = Batch(batch, n_subjects)
            kind = np.repeat([place.get(g, -1) for g in b.lang], b.doc_words)
            for k in range(n_languages):
                m[:, k] += np.bincount(b.words[kind == k], minlength=BUCKETS)
        return m

    spoken_counts = gathered(table, by_language, BUCKETS, n_languages) + 0.1
    model = Subjects(np.log(spoken_counts / spoken_counts.sum(0)), n_subjects)
    size = n_languages * BUCKETS
    context = table.sparkSession.sparkContext
    before = None

    def counted(some: DataFrame, with_held: bool) -> np.ndarray:
        shared = context.broadcast(model)

        def expected(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            m, now = np.zeros((size, n_subjects)), shared.value
            for batch in batches:
                b = Batch(batch, n_subjects, with_held)
                if now.weights is None:
                    rows, p = b.words + np.repeat(now.language(b), b.doc_words) * BUCKETS, _from_labels(b)
                else:
                    rows, p = _expected(b, now)
                used = p.any(1)
                of_word, rows = np.repeat(p[used], b.sentence_words[used], 0), rows[np.repeat(used, b.sentence_words)]
                for c in range(n_subjects):
                    m[:, c] += np.bincount(rows, of_word[:, c], size)
            return m

        return gathered(some, expected, size, n_subjects)

    with_held = False
    for turn, significant in enumerate(SIGNIFICANT):
        # labels alone are in few documents: only those are read
        counts = counted(table.where("labels is not null and not held") if turn == 0 else table, with_held)
        if turn == 0 and not counts.any():  # all labels there are were to be kept out
            with_held = True
            counts = counted(table.where("labels is not null"), with_held)
        if not counts.any():
            return None
        model.learn(counts, significant)
        if before is not None and np.abs(counts - before).sum() < SETTLED * counts.sum() and significant == SIGNIFICANT[-1]:
            break
        before = counts
    model.curves = _curves(table, model)
    if not with_held:
        counts = counted(table, True)
        if counts.any():
            model.learn(counts, SIGNIFICANT[-1])
    return model


def shares(table: DataFrame, model: Subjects) -> DataFrame:
    """doc_id, labels, share and posterior (arrays by subject) of each document of a table of features."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch, shared.value.n_subjects)
            share = shared.value.judge(b)[2]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (share, shared.value.posterior(share))]
            yield pa.RecordBatch.from_arrays([b.ids, batch.column(batch.schema.get_field_index("labels")), *lists], ["doc_id", "labels", "share", "posterior"])

    return table.mapInArrow(run, "doc_id bigint, labels array<int>, share array<double>, posterior array<double>")


def _curves(table: DataFrame, model: Subjects) -> list[tuple[float, float]]:
    """The curve of each subject, drawn to that of all subjects together where it has few cases."""
    odds = F.ln(F.greatest("s", F.lit(1e-4)) / F.greatest(1 - F.col("s"), F.lit(1e-4)))
    cases = (
        shares(table.where("held"), model)
        .select("labels", F.posexplode("share").alias("c", "s"))
        .groupBy("c", F.round(odds * BINS).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("array_contains(labels, c)")).alias("yes"))
        .toPandas()
    )
    x, yes = cases["bin"].to_numpy(float) / BINS, cases["yes"].to_numpy(float)
    no = cases["n"].to_numpy(float) - yes
    low, high = x < _odds(CLEAR[0]), x > _odds(CLEAR[1])
    # one wrong label in ten, both ways, is expected as firmly as by ten cases
    floor = (yes[low].sum() + 0.1) / (yes[low].sum() + no[low].sum() + 10)
    ceiling = (yes[high].sum() + 9) / (yes[high].sum() + no[high].sum() + 10)
    usual = (float(_odds(USUAL[0])), USUAL[1])
    of_all = _curve(x, yes, no, floor, ceiling, usual)
    own = [cases["c"].to_numpy() == c for c in range(model.n_subjects)]
    return [_curve(x[i], yes[i], no[i], floor, ceiling, of_all) for i in own]


def classified(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, subject, share and posterior of the one or two subjects of each document."""
    spark = documents.sparkSession
    # the allowed subjects: a table of fixed size
    subjects = [r[0] for r in areas.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    empty = spark.createDataFrame([], "doc_id bigint, subject string, share double, posterior double")
    if not subjects:
        return empty
    table = stored(features(documents, labels, subjects), "features")
    model = fit(table, len(subjects))
    if model is None:
        return empty
    ranked = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(subjects) - 1)),
            lambda i: F.struct((-F.col("share")[i]).alias("less"), i.alias("i"), F.col("posterior")[i].alias("posterior")),
        )
    )
    names = F.array(*map(F.lit, subjects))
    return (
        shares(table, model)
        .select("doc_id", F.posexplode(F.slice(ranked, 1, 2)).alias("place", "of"))
        .where((F.col("place") == 0) | (F.col("of.posterior") >= POSTERIOR))
        .select("doc_id", names[F.col("of.i")].alias("subject"), (-F.col("of.less")).alias("share"), F.col("of.posterior").alias("posterior"))
    )
