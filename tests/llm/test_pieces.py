"""N-best piece encoding and language models against brute force."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from quillmark.llm import langid as L
from quillmark.llm import pieces as P
from quillmark.llm.vocabulary import Vocabulary, load_vocabulary


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(load_vocabulary(), 4)


def every(encoder, text):
    form, out = encoder.form(" " + text), []

    def back(at, ids, score):
        if not at:
            out.append((score, ids))
            return
        for start, w, own in encoder.edges(form, at):
            back(start, own + ids, score + w)

    back(len(form), (), 0.0)
    return sorted(out, key=lambda x: -x[0])[:4]


@pytest.mark.parametrize("text", ["of in", "a, b", "don't", "日本x", "▁a", "a  b", "\nab\n", "e.g. x", " "])
def test_n_best_is_exact(encoder, text):
    got = encoder.segmentations(encoder.prepare([text])[0])
    want = every(encoder, text)
    assert np.allclose([s for s, _ in got], [s for s, _ in want])
    assert len({ids for _, ids in got}) == len(got)
    assert all(encoder.decode(ids) == text for _, ids in got)


def test_long_and_odd_texts(encoder):
    for text in ("x" * 3000, "ab " * 3000, "\U0001f600" * 300, " \n\n "):
        got = encoder.segmentations(encoder.prepare([text])[0])
        assert encoder.decode(got[0][1]) == text


def test_chunks_are_those_of_the_first_pattern(encoder):
    """Runs end before a mark that no piece has after a letter: checked against trying the two kinds of run in turn."""
    import random
    import re

    inner = {b for p in encoder.vocab.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
    marks = re.escape("".join(m for m in P.MARKS if m not in inner))
    plain = re.compile(rf"\n| *[^ \n{marks}]*[^\W\d_](?=[{marks}])| *[^ \n]+| +")
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab1é日_-,.!?;: \n ") for _ in range(rng.randint(1, 14)))
        assert encoder.chunks(text) == plain.findall(" " + text) and "".join(encoder.chunks(text)) == " " + text


def test_round_trip_by_chunk_is_that_of_the_text(encoder):
    for text in ("Hello, world.", "日本x ▁ é\n\n", "don't  stop\x00", "\U0001f600" * 50):
        chunks = encoder.prepare([text])[0]
        at = encoder.places(chunks)
        assert encoder.round_trip(text, chunks, at) and encoder.decode(encoder.segmentations(chunks, at)[0][1]) == text
        assert not encoder.round_trip(text + "x", chunks, at)
        spoilt = encoder._decode_to(chunks, [encoder.blobs[i] for i in [*at[1:], at[0]]])
        assert spoilt.tolist() == [a == b for a, b in zip(chunks, [*chunks[1:], chunks[0]], strict=True)]


def test_a_public_decoder_agrees(encoder):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("Hello there, world.", "Éa ñ ß 日本"):
        ids = encoder.segmentations(encoder.prepare([text])[0])[0][1]
        assert model.decode(np.frombuffer(ids, np.int32).tolist()) == text


def test_frames(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (None, None, 0.1), (2, "", 0.2), (1, "a b", 0.5)], "doc_id long, text string, score double")
    rows = P.segment_documents(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_segmentations"], r["round_trip"]) for r in rows if r["doc_id"]) == [(1, 4, True), (1, 4, True), (2, 1, True)]
    coded = P.encode(docs.where("doc_id = 1").limit(1)).selectExpr("text", "explode(pieces) p").selectExpr("text", "p.ids ids")
    assert all(r["decoded"] == r["text"] for r in P.decode(coded).collect())
    assert P.segment_documents(docs.limit(0)).count() == 0


def test_the_last_stage_gives_ids_and_keeps_columns(spark):
    import corpus_pipeline

    rows = [(1, "a b", "en", 0.5), (None, None, "x", 0.1), (2, "", None, 0.2), (1, "a b", "en", 0.5), (3, "日本x ▁ é\n\n", "ja", 0.3), (4, "ab, " * 3000, "en", 0.4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = corpus_pipeline.encoding(spark, docs, "")
    assert out.columns[:4] == docs.columns and "score_" in out.columns
    got = out.collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, rows))
    for r in got:
        if r["text"] is None:
            assert r["nbest"] is None and r["n_segmentations"] == 0
            continue
        first = r["nbest"][0]
        assert (first["n_pieces"], first["ids_crc32"], first["score"]) == (r["n_pieces"], r["ids_crc32"], r["score_"]) and len(r["nbest"]) == r["n_segmentations"]
        assert all(len(x["ids"]) == x["n_pieces"] and zlib.crc32(np.array(x["ids"], np.int32).tobytes()) == x["ids_crc32"] for x in r["nbest"])
    every = out.selectExpr("text", "explode(nbest) AS x").selectExpr("text", "x.ids AS ids")
    assert P.decode(every).where("NOT decoded <=> text").count() == 0
    digests = P.segment_documents(docs).collect()
    assert {(r["doc_id"], r["score"], r["ids_crc32"], r["round_trip"]) for r in digests} == {(r["doc_id"], r["score_"], r["ids_crc32"], r["round_trip"]) for r in got}


def toy():
    pieces = ["<0x%02X>" % b for b in range(256)] + ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc"]
    return Vocabulary(pieces, ["byte"] * 256 + ["normal"] * 8)


def test_lattice_holds_every_piece():
    v = toy()
    words = ["▁abcab", "", "▁", "aéc\U0001f600", "cabc" * 60]
    lat = L.Lattice(words, v)
    got = sorted(zip(lat.word.tolist(), lat.start.tolist(), lat.end.tolist(), lat.piece.tolist(), strict=True))
    want = [(k, i, j, v.ids[w[i:j]]) for k, w in enumerate(words) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i:j] in v.ids]
    want += [(k, i, i + 1, -1) for k, w in enumerate(words) for i in range(len(w)) if w[i] not in v.ids]
    assert got == sorted(want)
    assert sorted(lat.spelt.values()) == ["é", "\U0001f600"]


def test_forward_sums_all_segmentations():
    v = toy()
    probs = np.random.default_rng(0).dirichlet(np.ones(len(v.pieces)), 2).T

    def total(w, k):
        if not w:
            return 1.0
        out = sum(probs[v.ids[w[:j]], k] * total(w[j:], k) for j in range(1, len(w) + 1) if w[:j] in v.ids)
        if w[0] not in v.ids:
            out += np.prod([probs[v.bytes[b], k] for b in w[0].encode()]) * total(w[1:], k)
        return out

    words = ["▁abcab", "▁", "▁aéc", "▁cccc"]
    got = L.log_probs(words, probs, v)
    for i, w in enumerate(words):
        for k in range(2):
            assert np.isclose(np.exp(got[i, k]), total(w, k))
        assert np.allclose(L._log_forward(w, probs, v), got[i])


def test_estimation_tells_languages_apart():
    v = toy()
    langs, probs = L.estimate({"x": Counter({"ab": 50, "abab": 10}), "y": Counter({"cb": 50, "cc": 9})}, v)
    scorer = L.Scorer(langs, probs, v)
    pred, score = scorer.predict(["ab ab", "cb, cc", None, "12 ..", ""])
    assert pred == ["x", "y", "und", "und", "und"]
    assert (score[:2] > 0.9).all() and (score[2:] == 0).all()


def test_language_frame(spark):
    rows = [(i, ("the of and this that" if i % 2 else "der die und nicht das") + f" w{i}", "en" if i % 2 else "de", "s") for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, None, "en", None), (None, "12", None, None)], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify_languages(docs).collect()}
    assert got[99] == got[None] == "und"
    assert all(got[i] == r[2] for i, r in enumerate(rows))
    assert L.identify_languages(docs.where("doc_id is null")).first()["lang_pred"] == "und"


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_becomes_python_texts_in_slices(spark):
    """A batch of 10,000 texts, 20 MB, never lies as a whole in a worker's Python objects."""

    class Lengths:
        def prepare(self, texts):
            return [len(t) for t in texts]

    udf = P._arrow_udf(Lengths, lambda encoder, texts, split: pa.array([None if t is None else n for t, n in zip(texts, split, strict=True)]), "long")
    texts = [None if i % 7 == 0 else f"{i:04d}" * (500 if i % 5 else 0) for i in range(10_000)]
    part, empty = pa.array(texts), pa.array([], pa.string())
    got, peak = peak_mb(lambda: [n for out in udf.func(iter([empty, part, part[:201], empty])) for n in out.to_pylist()])
    want = [None if t is None else len(t) for t in texts]
    assert got == want + want[:201]
    assert peak < 6


def test_chunks_are_learnt_in_steps():
    """New chunks' lattices are made for few of them at a time, with the same best segmentations."""
    chunks = [f" word{i}and{i * 7919}others{i * 31}" for i in range(10_000)]
    stepped, at_once = P.Encoder(load_vocabulary()), P.Encoder(load_vocabulary())
    at_once.STEP = len(chunks)
    _, few = peak_mb(lambda: stepped.learn(chunks))
    _, all_ = peak_mb(lambda: at_once.learn(chunks))
    best = lambda e: [(e.blobs[e.known[c]], e.best[e.known[c]], e.gap[e.known[c]]) for c in chunks]
    assert best(stepped) == best(at_once)
    assert few < all_ / 2
