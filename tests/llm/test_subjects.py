"""Subjects: held-out accuracy on made-up texts of two languages."""

import random

import pytest
from conftest import values

subjects = pytest.importorskip("termloom.llm.subjects")

WORDS = {
    "en": {"law": "court verdict appeal judge clause statute", "sport": "goal match striker league coach sprint", "search": "query index ranking posting recall shard"},
    "de": {"law": "Gericht Urteil Klage Richter Paragraf Vertrag", "sport": "Tor Spiel Liga Trainer Lauf Pokal", "search": "Abfrage Rangfolge Treffer Suchwort Indexierung Stoppwort"},
}
FRAME = {"en": "the report on {} was read with {} near {} in town.", "de": "der Bericht über {} wurde mit {} bei {} gelesen."}


def made(n, seed):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        lang = "en" if r.random() < 0.7 else "de"
        own = r.sample(["law", "sport", "search"], 1 if r.random() < 0.75 else 2)
        parts = []
        for k in range(8):
            s = own[k % len(own)]
            words = WORDS[lang][s].split()
            parts.append(FRAME[lang].format(r.choice(words), r.choice(words), f"Ort{r.randrange(400)}"))
        r.shuffle(parts)
        docs.append((i, " ".join(parts), lang if r.random() < 0.9 else None))
        truth[i] = set(own)
    labels = [(i, r.choice([s.upper(), f" {s} ", s]) if r.random() > 0.04 else "sport") for i in range(n) if r.random() < 0.25 for s in truth[i]]
    return docs, truth, labels + [(0, None), (1, "nonsense")] + labels[:5]


@pytest.fixture(scope="module")
def frames(spark):
    docs, truth, labels = made(700, 4)
    docs += [(10_000, None, "en"), (10_001, " \n ", "en"), (10_002, "12345 !!", None), docs[3]]
    areas = spark.createDataFrame([(s, "x") for s in ("law", "sport", "search")], "subject string, description string")
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumnRenamed("x", "x"), spark.createDataFrame(labels, "doc_id long, subject string"), areas, truth


def test_classified(frames):
    docs, labels, areas, truth = frames
    found = {}
    rows = subjects.classified(docs, labels, areas).collect()
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert len(rows) == len({(r.doc_id, r.subject) for r in rows})
    assert set(found) == set(truth) | {10_002} and all(1 <= len(v) <= 2 for v in found.values())
    assert sum(found[i] == truth[i] for i in truth) >= 0.95 * len(truth)


def test_defined_cases(spark, frames):
    docs, labels, areas, _ = frames
    assert subjects.classified(docs, labels.where("false"), areas).count() == 0
    assert subjects.classified(docs, labels, areas.where("false")).count() == 0
    assert subjects.classified(docs.where("false"), labels, areas).count() == 0
    assert values(subjects.classified(docs.where("doc_id < 40"), labels, areas), "doc_id")


def test_languages_beyond_those_with_counts_of_their_own(spark, monkeypatch):
    """Documents of every language are judged by words of such languages, however many there are."""
    monkeypatch.setattr(subjects, "LANGUAGES", 3)
    r, langs = random.Random(8), [f"{a}{b}" for a in "abc" for b in "xyz"]
    docs, truth, labels = [], {}, []
    for i in range(1800):
        lang, s = langs[i % 9], r.choice(["law", "sport", "search"])
        word = lambda s: f"{lang}{s}{'abcdefgh'[r.randrange(8)]}"  # noqa: B023, E731
        text = " ".join(f"{word(s)} {lang}q {word('')} {word(s)} {lang}w {word('')}." for _ in range(5))
        docs.append((i, text, lang))
        truth[i] = s
        if r.random() < 0.4:
            labels.append((i, s))
    areas = spark.createDataFrame([(s, "x") for s in ("law", "sport", "search")], "subject string, description string")
    found = subjects.classified(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, subject string"), areas)
    right = {i: 0 for i in range(9)}
    for d in found.collect():
        right[d.doc_id % 9] += truth[d.doc_id] == d.subject
    assert min(right.values()) >= 0.9 * 200, right


def test_held_out_labels_stay_out_of_the_counts(spark, frames):
    docs, labels, areas, _ = frames
    table = subjects.features(docs, labels, ["law", "search", "sport"])
    held = [r.doc_id for r in table.where("held").select("doc_id").collect()]
    assert 0.1 * 175 < len(held) < 0.35 * 175
    batch = subjects.Batch(table.toArrow().combine_chunks().to_batches()[0], 3)
    ids = batch.ids.to_pylist()
    assert not batch.labelled[[ids.index(i) for i in held]].any() and batch.labelled.any()


def test_curve():
    import numpy as np

    r = np.random.default_rng(2)
    share = r.random(4000)
    odds = subjects._odds(share)
    for at, floor, ceiling in ((0.25, 0.02, 0.9), (0.4, 0.1, 0.7), (0.15, 0.0, 1.0)):
        y = r.random(4000) < floor + (ceiling - floor) / (1 + np.exp(-6 * (odds - subjects._odds(at))))
        found, slope = subjects._curve(odds, y * 1.0, 1.0 - y, max(floor, 0.001), min(ceiling, 0.999), (subjects._odds(0.25), 6.0))
        assert abs(1 / (1 + np.exp(-found)) - at) < 0.04 and 3 < slope < 12
    none = np.empty(0)
    at, slope = subjects._curve(none, none, none, 0.01, 0.9, (-1.1, 6.0))
    assert abs(at + 1.1) < 1e-3 and abs(slope - 6) < 1e-2


def test_sums_of_sentences(spark, frames):
    import numpy as np

    docs, labels, *_ = frames
    b = subjects.Batch(subjects.features(docs, labels, ["law", "search", "sport"]).toArrow().combine_chunks().to_batches()[0], 3)
    values = np.random.default_rng(1).random((len(b.words), 2))
    at = np.repeat(np.arange(len(b.sentence_words)), b.sentence_words)
    want = np.stack([np.bincount(at, values[:, k], len(b.sentence_words)) for k in range(2)], 1)
    assert np.allclose(b.by_sentence(values), want)


def test_no_label_is_left_out_of_the_counts(spark, frames):
    docs, labels, areas, _ = frames
    held = [r.doc_id for r in subjects.features(docs, labels, ["law", "search", "sport"]).where("held").select("doc_id").collect()]
    # where all labels are kept out for the calibration, they still count
    assert subjects.classified(docs, labels.where(labels.doc_id.isin(held)), areas).select("doc_id").distinct().count() == 701
