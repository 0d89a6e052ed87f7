"""Wrong decodings: found by classifier, undone strictly."""

import random

import pytest
from conftest import values

encoding = pytest.importorskip("termloom.llm.encoding")

NAMES = [a + b + c for a in ("Rós", "Tün", "Mir", "Ško", "Gul", "Zor", "Érm") for b in ("ór", "ün", "ał", "iñ", "éd", "ąn", "o") for c in ("berg", "sk", "well", "são", "ès", "øe", "vik")]
RUSSIAN = "отчёт связывает полнота поиска автор сравнивает рынок опрос жителей показал грамматика суд бюджет прививка больница перевод диалект таблица содержит строк про между годами проверял".split()
GERMAN = "zählt Einträge über prüften Größe Häufigkeit wären außergewöhnlich führt zurück Fünfkampf Suchmaschine für änderte".split()
FRENCH = "prime évoqué l’hôpital après rattache à dépistage préfère clôt tâche métier résumé répète où près".split()


def texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = i % 4
        words = [r.choice((RUSSIAN, GERMAN, FRENCH, ["report", "compares", "query", "with", "index", "near"])[kind]) for _ in range(25)]
        for _ in range(5):
            words.insert(r.randrange(len(words)), r.choice(NAMES))
        if i % 5 == 0:
            words.append(r.choice(["«ранжирование»", "√2", "± 5 °C", "¿Qué?", "├── a.py", "β-globulin", "16 ¤", "† ‡", "SÃO", "└─┴─┘", "ОТЧЁТ", "© 2001"]))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    return encoding.fit_words(dict(Counter(w for t in texts(1500, 1) for w in encoding.WORD.findall(t))))


def test_every_chain_is_a_round_trip():
    for chain in encoding.CHAINS:
        for word in ("Größe", "полнота", "Škoda", "naïve"):
            if encoding._writable(word, chain[0][0]):
                garbled = encoding.garble(word, chain)
                if garbled != word:
                    assert encoding.invert(garbled, chain) == word, (chain, word)


def test_held_out_texts(model):
    judge, clean = encoding.Judge(model), texts(400, 2)
    assert sum(judge.text(t).garbled for t in clean) <= 2
    hit = right = n = 0
    for i, chain in enumerate([(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1252"),) * 2, (("utf-8", "mac_roman"),), (("utf-8", "cp437"),), (("utf-8", "cp1251"),), (("utf-8", "cp1250"),), (("utf-8", "cp850"),)]):
        for t in texts(40, 10 + i):
            n += 1
            v = judge.text(encoding.garble(t, chain))
            hit += v.garbled
            right += v.text == t
    assert hit >= 0.99 * n and right >= 0.9 * n
    for chain in ((("cp1251", "cp1252"),), (("cp1251", "koi8-r"),), (("koi8-r", "cp1251"),)):
        russian = [" ".join(random.Random(k).choices(RUSSIAN, k=12)) for k in range(40)]
        assert sum(judge.text(encoding.garble(t, chain)).text == t for t in russian) >= 36
    german = [" ".join(random.Random(k).choices(GERMAN, k=12)) for k in range(40)]
    assert sum(judge.text(encoding.garble(t, (("cp1252", "mac_roman"),))).garbled for t in german) >= 38


def test_part_of_a_text(model):
    judge = encoding.Judge(model)
    t = "Wir prüften die Größe über das Haus. " + encoding.garble("Häufigkeit wären", (("utf-8", "cp1252"),)) + " sind außergewöhnlich"
    v = judge.text(t)
    assert v.garbled and v.complete and v.text == "Wir prüften die Größe über das Haus. Häufigkeit wären sind außergewöhnlich" and v.chain in ("utf-8>cp1252", "utf-8>latin-1")  # the same for these letters
    lost = judge.text("Jor�s�o")
    assert lost.garbled and not lost.complete and lost.chain == "lost"


def test_judged_table(spark, model):
    bad = encoding.garble("Größe über prüften", (("utf-8", "latin-1"),))
    long = "word " * 200_000 + bad
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, bad, "x"), (4, bad, "x"), (5, long, "x"), (6, " \t", "x"), (7, "Größe", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chain string")
    got = {r.doc_id: r for r in encoding.judged(df, model).collect()}
    assert encoding.judged(df, model).count() == 8
    assert got[1].restored is None and not got[1].garbled and got[2].restored == "" and got[4].restored == "Größe über prüften"
    assert got[5].garbled and got[5].restored.endswith("Größe über prüften") and len(got[5].restored) < len(long)
    assert values(encoding.garbled(df, model)) == [4, 5]
    assert encoding.garbled(df.where("false")).count() == 0 and encoding.garbled(df.where("doc_id = 3")).count() == 0


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp866", "koi8-r"])
def test_garbled_up_to_seven_times(model, read):
    judge = encoding.Judge(model)
    for t in (" ".join(GERMAN), " ".join(FRENCH), " ".join(RUSSIAN)):
        for times in range(1, 8):
            v = judge.text(encoding.garble(t, (("utf-8", read),) * times))
            assert v.garbled and (v.text == t or not v.complete), (read, times, v)
            assert v.text == t or read in ("koi8-r", "cp866"), (read, times, v)


def test_mixed_misreadings(model):
    judge, t = encoding.Judge(model), "über die Größe der Häuser änderte"
    for first in ("cp1252", "latin-1", "mac_roman"):
        for then in ("cp1252", "cp1251", "cp850"):
            v = judge.text(encoding.garble(t, (("utf-8", first), ("utf-8", then))))
            assert v.garbled and v.text == t


def test_what_is_lost_is_not_complete(model):
    judge = encoding.Judge(model)
    for t in ("StraÃ?en und grÃ¶Ã?er fÃ¼r", "gr?n und fÃ¼r", "Die StraÃ?en"):
        v = judge.text(t)
        assert v.garbled and not v.complete, v
    assert judge.text("Wozu? Für wen?").complete and not judge.text("SÃO? Ã la").garbled


def test_one_byte_decoding_is_strict():
    assert encoding._undo("œ", ("cp1252", "mac_roman")) is not None
    undefined = bytes([0x81]).decode("mac_roman")  # cp1252 has no character for 0x81
    assert encoding._undo(undefined, ("cp1252", "mac_roman")) is None


def test_a_weaker_vote_that_suffices_counts(model):
    """Many words with weak votes for one chain don't hide a proven misreading."""
    judge = encoding.Judge(model)
    weak = [w for t in texts(300, 7) for w in encoding.WORD.findall(t) if any(encoding.CHAINS[k][0][0] != "utf-8" and o < encoding.WORD_ODDS for k, o in judge.word(w))]
    assert judge.text(" ".join(sorted(set(weak))[:200] + [encoding.garble("für", (("utf-8", "cp1252"),))])).garbled


def test_high_words_are_the_pattern_s():
    for t in ["", "plain", "é", " é\tü\r\nab\x0bß\x0c«x» a\xa0b \u2028 c", *texts(30, 9)]:
        assert encoding.high_words(t) == encoding.WORD.findall(t)


def test_training_is_kept():
    words = {"Größe": 3, "für": 2}
    assert encoding.fit_words(words) is encoding.fit_words(dict(reversed(words.items())))


def test_all_words_of_all_documents_are_trained_on(spark, monkeypatch):
    import numpy as np

    words = [f"{a}ü{b}ñ{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghijklmnopqrst"]
    rows = [(i, " ".join(words[(i * 7 + k) % len(words)] for k in range(3)) + "  plain") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(encoding, "_models", {})
    seen: dict[str, int] = {}
    for _, t in rows:
        for w in encoding.high_words(t):
            seen[w] = seen.get(w, 0) + 1
    assert len(rows) > 4000 and len(seen) == len(words)
    whole = encoding.fit_words(seen)
    assert np.allclose(encoding.fit(df).logp, whole.logp, atol=1e-4)
    assert encoding.fit(df.orderBy("text")) is encoding.fit(df)
    monkeypatch.setattr(encoding, "GO", 77)
    assert np.allclose(encoding.Model.train(seen).logp, encoding.Model.train(dict(reversed(seen.items()))).logp, atol=1e-4)
