"""Suffix-array repetition against brute force."""

import random

import numpy as np

from quillmark.llm.repetition import maximal_repeats, repetition_rules, text_rules


def brute(words, least):
    covered, longest = set(), 0
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                covered |= set(range(i, i + k))
    return len(covered), longest


def test_counts_against_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 50))) for _ in range(120)] + ["a " * 12, "", None, "x"]
    got = text_rules(texts, 4)
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert got["n_words"][i] == len(words)
        c3, longest = brute(words, 3)
        assert (got["n_repeat_words"][i], got["covered_words"][i], got["longest_repeat"][i]) == (c3, brute(words, 4)[0], longest)


def test_maximal_repeats():
    assert maximal_repeats("a b c x a b c y b c".split()) == [(3, (0, 4)), (2, (1, 5, 8))]
    assert maximal_repeats([]) == []


def test_maximal_repeats_against_brute_force():
    """Every stretch that comes twice and can be extended neither way, and the spans that they make up together."""
    rng = random.Random(6)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 30))] for _ in range(150)] + [["a"] * 40, list("ab") * 20, list("abc") * 9 + list("xabc")]
    spans = []
    got = text_rules([" ".join(t) for t in texts], 3, spans=spans)
    for k, t in enumerate(texts):
        places = {}
        for n in range(1, len(t)):
            for i in range(len(t) - n + 1):
                places.setdefault(tuple(t[i : i + n]), []).append(i)
        want = {}
        for w, at in places.items():
            ends = {t[i + len(w)] if i + len(w) < len(t) else None for i in at}
            heads = {t[i - 1] if i else None for i in at}
            if len(at) > 1 and (len(heads) > 1 or None in heads) and (len(ends) > 1 or None in ends):
                want[len(w), tuple(at)] = 1
        assert set(maximal_repeats(t)) == set(want)
        under = sorted({p for n, at in want if n >= 3 for i in at for p in range(i, i + n)})
        assert [p for s in spans[k] for p in range(s["first"], s["end"])] == under and got["covered_words"][k] == len(under)
        assert all(a["end"] < b["first"] for a, b in zip(spans[k], spans[k][1:], strict=False)) or len(spans[k]) < 2


def test_one_word_all_over():
    got = text_rules(["z " * 40_000])
    assert got["longest_repeat"][0] == 39_999 and got["covered_words"][0] == 40_000


def test_words_are_split_at_ascii_blanks_only():
    got = text_rules(["a b c d\x1ce\tf\x0bg", "l\nl\n\n \nl\nm #$|"])
    assert got["n_words"].tolist() == [4, 5]
    assert got["n_dup_lines"].tolist() == [0, 2]
    assert got["n_symbols"].tolist() == [0, 3]
    assert got["word_chars"].tolist() == [10, 7]


def test_verdicts():
    plain = " ".join(f"w{i}" for i in range(200))
    long = " ".join(f"p{i}" for i in range(60))
    got = text_rules([plain, f"{plain} {long} {plain[:0]} x {long} " + " ".join(f"v{i}" for i in range(200)), "a b", "same words here " * 40])
    assert got["kept"].tolist() == [True, False, False, False]
    assert got["base_failed"].tolist() == [False, False, True, True]
    assert np.all(got["longest_repeat"][:2] == [0, 60])


def test_coverage_alone_rejects():
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(45)]
    texts = [" ".join(words[:220] + sum((passage + [f"x{k}"] for k in range(4)), [])), " ".join(words[:310] + passage + ["x"] + passage)]
    got = text_rules(texts)
    assert got["covered_words"].tolist() == [180, 90] and got["longest_repeat"].tolist() == [45, 45]
    assert got["base_failed"].tolist() == [False, False]
    assert got["kept"].tolist() == [False, True]


def test_frame(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "z")], "doc_id long, text string, kept string")
    rows = repetition_rules(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in rows) == [(0, 0, False), (1, 2, False), (1, 2, False)]
    assert repetition_rules(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x " + "a b c d e f g h i " * 2)], "doc_id long, text string")
    assert [tuple(s) for s in repetition_rules(twice, spans=True).first()["spans"]] == [(1, 19)]
