"""Quality and toxicity models, and the pipeline."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import quality as Q
from quillmark.llm import toxicity as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lm():
    words = Counter({w: 50 for w in "idiot stupid moron loser trash clown the and with house garden letter pathetic worthless scum".split()})
    grams = T.word_grams(words)
    return T.CharModel(grams, "".join(g for g in grams if len(g) == 1 and g.isalpha()))


@pytest.mark.parametrize(
    ("written", "read"),
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("iiidiooot", "idiot"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("L0SER,", "loser"), ("tr4sh!!", "trash"), ("p@thetic", "pathetic"), ("$cum", "scum"), ("house", "house"), ("", ""), ("the, garden", "the, garden")],
)
def test_restoration(lm, written, read):
    assert T.Restorer(lm).restore(written) == read


@pytest.mark.parametrize("written", ["stup1d", "stupi6", "idi07", "id10+", '"1diot"', "(5tupid", "stuupid", "iidiot", "i.d.1.0.t", "1.d.1.0.t", "id i ot", "i d i o t", "i  d  i  o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "a s s"])
def test_disguises_are_read(written):
    """A model of a few words, in which each disguise has one likely reading."""
    words = Counter({"stupid": 400, "stupig": 1, "idiot": 400, "ass": 300, "hello": 300, "good": 300})
    grams = T.word_grams(words)
    lm = T.CharModel(grams, "".join(g for g in grams if len(g) == 1 and g.isalpha()))
    said = {"=" + w for w in ("stupid", "stupig", "idiot", "ass")}
    assert T.Reader(lm, said).stems(f"hello {written} good") & said
    assert "=good" in T.Reader(lm).stems("a good one") and "=hello" in T.Reader(lm).stems("hello!")


def test_grams_against_counting():
    counts = Counter({"abc,": 2, "a1b": 1, "é": 3, "..": 4})
    want = Counter()
    for word, n in (("abc", 2), ("a", 1), ("b", 1), ("é", 3)):
        s = T.START * 2 + word + T.END
        for i in range(2, len(s)):
            for k in (1, 2, 3):
                want[s[i - k + 1 : i + 1]] += n
        want[T.START] += n
        want[T.START * 2] += n
    assert T.word_grams(counts) == want


def test_long_chunks_end(lm):
    assert set(T.Restorer(lm).restore("a" * 50_000)) == {"a"}
    assert len(T.Restorer(lm).restore("1a2b" * 500)) > 0


def every_reading(chunk, lm):
    """Output -> best score, over all paths of a chunk's lattice."""
    out = {}

    def go(i, given, score, shown):
        if i == len(chunk):
            score += lm.logp(given, T.END) if given != T.START * 2 else 0
            key = "".join(shown).strip()
            out[key] = max(out.get(key, -1e9), score)
            return
        c = chunk[i]
        options = [(c, 0.0)] if c.isalnum() else []
        if c in T.LEET:
            options = [(x, T.SUBSTITUTE) for x in T.LEET[c]] + [(x, T.ITSELF) for x, _ in options]
        for x, cost in options:
            go(i + 1, given[1] + lm.folded(x), score + lm.logp(given, x) - cost, [*shown, x])
        if i and chunk[i - 1] == c and (c.isalpha() or c in T.LEET) and given != T.START * 2:
            go(i + 1, given, score - T.REPEAT, shown)
        if not c.isalnum():
            cost = T.ITSELF if c in T.LEET else 0.0
            if c in T.GAPS:
                go(i + 1, given, score - T.GAP, shown)
            if given == T.START * 2:
                go(i + 1, given, score - cost, [*shown, c] if shown and shown[-1] != " " else shown)
            else:
                go(i + 1, T.START * 2, score + lm.logp(given, T.END) - cost, [*shown, " "])

    go(0, T.START * 2, 0.0, [])
    return out


def test_decoding_is_the_best_of_all_readings():
    rng = random.Random(11)
    grams = T.word_grams(Counter({"idiot": 9, "little": 7, "big": 5, "bag": 4, "tool": 6, "toil": 2}))
    lm = T.CharModel(grams, "abdegilot")
    for _ in range(250):
        chunk = "".join(rng.choice("abiloltteg016!|@.- $x2") for _ in range(rng.randint(1, 8)))
        if rng.random() < 0.3:
            chunk = chunk[:3] + chunk[2:3] * 2 + chunk[3:6]
        runs = T.RUN.sub(lambda m: m[1] * 3, chunk)
        readings = every_reading(runs, lm)
        got = T.decode(chunk, lm)
        assert readings[got] == pytest.approx(max(readings.values())), (chunk, got)


def test_only_tokens_that_can_read_as_a_stem_are_read():
    """Looking up wanted stems finds what reading every token finds."""
    rng = random.Random(12)
    grams = T.word_grams(Counter({"idiot": 9, "little": 7, "stupid": 5, "bottle": 4, "gobble": 6}))
    lm = T.CharModel(grams, "abdegilopstu")
    wanted = {"=idiot", "stup", "=bottle", "=gobble", "littl"}
    texts = []
    for _ in range(300):
        words = []
        for w in rng.choices(["idiot", "stupid", "bottle", "gobbles", "little", "plain", "of", "é"], k=4):
            w = "".join(rng.choice({"i": "i1!", "o": "o0", "s": "s5$", "t": "tt7+", "e": "e3", "b": "b86", "l": "l|1"}.get(c, c)) for c in w)
            words.append(rng.choice("-._ ").join(w) if rng.random() < 0.2 else w * rng.choice((1, 1, 2)))
        texts.append(rng.choice((" ", "  ", "\0")).join(words))
    every, some = T.Reader(lm), T.Reader(lm, wanted)
    found = [some.stems(t) for t in texts]
    assert found == [every.stems(t) & wanted for t in texts] and sum(map(bool, found)) > 100
    assert T.Reader(lm, set()).stems("idiot") == set() and some.stems(None) == set()


@pytest.mark.parametrize("written", ["stu pid", "st upid", "STUP\tid", "s tupid", "stup\n1d!", "st up id", "stu - pid", "as shole", "ass hole", "a$ s hole"])
def test_words_in_pieces(written):
    grams = T.word_grams(Counter({"idiot": 9, "stupid": 7, "asshole": 5, "hello": 6, "good": 4, "up": 8, "as": 9, "stop": 3}))
    lm = T.CharModel(grams, "".join(g for g in grams if len(g) == 1 and g.isalpha()))
    reader = T.Reader(lm, {"=stupid", "stup", "=asshole"}, {"=stupid", "=asshole"})
    for text in (f"hello {written} good", f"hello {written}", written):
        assert reader.stems(text) & {"=stupid", "=asshole"}
    assert not reader.stems("hello stu and pid, as a whole up st")


def test_letters_of_all_scripts_count(spark):
    """Hundreds of letters: each has its own counts, as a plain count of all n-grams gives them."""
    words = ["".join(chr(0x4E00 + (k * 7 + j * j) % 400) for j in range(3)) for k in range(300)] + ["hello", "\u0434\u0430", "\u05e9\u05dc"]
    docs = spark.createDataFrame([(k, f"{w} {w} hello") for k, w in enumerate(words)], "doc_id long, text string")
    want = Counter()
    for w in words:
        want.update([w, w, "hello"])
    grams = T.word_grams(want)
    plain = T.CharModel(dict(grams), "".join(g for g in grams if len(g) == 1 and g.isalpha()))
    lm = T.char_model(docs)
    assert lm.letters == plain.letters > 300
    off = [w for w in words for k in range(len(w)) if abs(lm.logp((T.START * 2 + w)[k : k + 2], w[k]) - plain.logp((T.START * 2 + w)[k : k + 2], w[k])) > 1e-9]
    assert len(off) < 0.02 * len(words)


def test_word_grams_of_many_letters():
    words = Counter({"".join(chr(0x4E00 + 7 * (i + k)) for k in range(3)): 1 + i % 3 for i in range(400)})
    want = Counter()
    for w, n in words.items():
        marked = T.START * 2 + w + T.END
        want[T.START] += n
        want[T.START * 2] += n
        for width in (1, 2, 3):
            for i in range(2, len(marked)):
                want[marked[i - width + 1 : i + 1]] += n
    assert T.word_grams(words) == want


def test_lexicon_leaves_copies_out():
    odds = {"=slur": 0.9, "=copy": 0.9}
    toxic = [["=slur", "=copy"]] * 5 + [["=slur"]] * 5
    assert list(T.greedy_lexicon(toxic, odds)) == ["=slur"]
    assert T.text_score({"=slur"}, {"=slur": 0.9}, 0.1) == pytest.approx(0.91)


def corpus(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    slurs, rows, labels = ["grobnak", "vilstum"], [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(slurs)
        if i % 5 == 1:
            w = [rng.choice(w[:3]) + "!!" for _ in w]
        rows.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, int(i % 5 != 1), int(bad)))
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "gr0bnak", "x")], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = corpus(spark)
    rows = {r["doc_id"]: r for r in T.toxicity_scores(docs, labels).collect()}
    assert len(rows) == 403
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] for i in held)
    assert np.mean([rows[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert rows[900]["predicted"] == rows[901]["predicted"] == 0 and rows[None]["held_out"] is False
    kept = {r["doc_id"] for r in T.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if not r["predicted"]}
    none = T.toxicity_scores(docs, labels.limit(0))
    assert none.agg(F.max("score")).first()[0] == 0.0
    assert T.toxicity_scores(docs.limit(0), labels).count() == 0


def test_rare_insult_among_many_common_stems(spark):
    """60,000 and more stems that all texts hold leave an insult of a few toxic texts in the lexicon."""
    rng = random.Random(2)
    common = " ".join("".join(rng.sample("abdeghilmnoprstu", 10)) for _ in range(12_000))
    docs, labels = [], []
    for i in range(40):
        bad = i % 2 == 0
        docs.append((i, common + (" grobnak" if bad and i % 4 == 0 else ""), None))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, x string")
    grams = T.word_grams(Counter(common.split()))
    lm = T.CharModel(grams, "".join(g for g in grams if len(g) == 1 and g.isalpha()))
    lexicon, _ = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), lm)
    assert any("=grobnak".endswith(s) or "grobnak".startswith(s) for s in lexicon)


def test_quality(spark):
    docs, labels = corpus(spark)
    rows = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i]["predicted"] == (i % 5 != 1) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and len(rows) == 403
    assert Q.quality_scores(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)


def test_model_is_its_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = Q.fit_ga2m(x, y)
    assert (0, 1) in m.pairs
    assert np.mean((m.scores(x) > 0.5) == y) > 0.9
    row = x[:1]
    by_hand = m.intercept + sum(t[np.searchsorted(e, row[0, f], side="right")] for f, (e, t) in enumerate(zip(m.edges, m.tables, strict=True)))
    by_hand += sum(t[np.searchsorted(m.pair_edges[a], row[0, a], side="right"), np.searchsorted(m.pair_edges[b], row[0, b], side="right")] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
    assert m.margins(row)[0] == pytest.approx(by_hand)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline(spark):
    import corpus_pipeline as P

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF).cache()
        sizes.append((docs.count(), out.count()))
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        docs = out
    (a, b), (c, d), (e, f), (g, h), (i, j) = sizes
    assert b < a and c == d == b and f < e and h >= g and i == j == h
    assert P.run(spark, SF).count() == j
