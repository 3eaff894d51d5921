"""Language identification by segmentation-marginalised unigram models."""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, crc_mod, per_worker
from .vocabulary import SPACE, Vocabulary, load_vocabulary

#: Labelled documents to learn from, by language, about: those whose hash is in the first part of its range that
#: should hold so many.
MAX_DOCS = 600
#: Distinct words whose lattices are held at a time.
STEP = 10_000
ROUNDS = 3
SMOOTHING = 0.5
#: Probabilities are scaled by this for each character, so that sums over long words stay in range.
SCALE = 24.0
LONG = 200
MARKS = ".,!?;:#$%&*"


class Lattice:
    """Edges of the piece lattices of distinct words: every way a piece of the vocabulary covers a stretch.

    A character that is no piece itself is covered by its bytes' pieces.  Words have at most 255 characters.
    """

    def __init__(self, words: list[str], vocab: Vocabulary):
        self.n = len(words)
        self.lengths = np.fromiter(map(len, words), np.int64, self.n)
        self.top = int(self.lengths.max(initial=0))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(self.n), self.lengths)
        stop = np.cumsum(self.lengths)
        start = np.arange(len(code)) - (stop - self.lengths)[word]
        # All places walk the trie of pieces in step; those that leave it or their word drop out.
        at, node, depth, found = np.arange(len(code)), np.zeros(len(code), np.int64), 0, []
        while len(at):
            node = vocab.trie.step(node, code[at + depth])
            depth += 1
            on = node >= 0
            if depth == 1:
                odd = vocab.trie.piece[node] < 0
                odd |= ~on
                found.append(self._packed(word[odd], start[odd], 1, 0))
            at, node = at[on], node[on]
            p = vocab.trie.piece[node]
            hit = p >= 0
            found.append(self._packed(word[at[hit]], start[at[hit]], depth, p[hit] + 1))
            inside = at + depth < stop[word[at]]
            at, node = at[inside], node[inside]
        packed = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        self.word, self.start, self.end = packed >> 37, packed >> 29 & 255, packed >> 21 & 255
        self.piece = (packed & (1 << 21) - 1) - 1
        #: Edge -> the character that it spells out.
        self.spelt = {k: words[self.word[k]][self.start[k]] for k in np.flatnonzero(self.piece < 0).tolist()}

    @staticmethod
    def _packed(word: np.ndarray, start: np.ndarray, length: int, piece) -> np.ndarray:
        """Edges as numbers that sort by word, start and end; piece 0 stands for a spelt-out character."""
        return word << 37 | start << 29 | (start + length) << 21 | piece

    def _by(self, place: np.ndarray) -> list[np.ndarray]:
        """Edges by their start or end; words stay in order within each."""
        order = np.argsort(place.astype(np.uint8), kind="stable")
        bounds = np.searchsorted(place[order], np.arange(self.top + 2)).tolist()
        return [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def weights(self, probs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
        """(edge, language) scaled probabilities; a spelt-out character has its bytes' product."""
        out = probs[self.piece]
        for k, c in self.spelt.items():
            out[k] = probs[[vocab.bytes[b] for b in c.encode("utf-8", "surrogatepass")]].prod(axis=0)
        return out * SCALE ** (self.end - self.start)[:, None]

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """(word, place, language): scaled probability of all segmentations up to the place."""
        alpha = np.zeros((self.n, self.top + 1, weight.shape[1]))
        alpha[:, 0] = 1
        by_end = self._by(self.end)
        for e in range(1, self.top + 1):
            k = by_end[e]
            if len(k):
                w = self.word[k]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                alpha[w[first], e] = np.add.reduceat(alpha[w, self.start[k]] * weight[k], first, axis=0)
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.n, self.top + 1, weight.shape[1]))
        beta[np.arange(self.n), self.lengths] = 1
        by_start = self._by(self.start)
        for s in range(self.top - 1, -1, -1):
            k = by_start[s]
            if len(k):
                w = self.word[k]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                beta[w[first], s] += np.add.reduceat(beta[w, self.end[k]] * weight[k], first, axis=0)
        return beta


def log_probs(words: list[str], probs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """(word, language): log of the summed probability of every segmentation, by the forward algorithm."""
    out = np.empty((len(words), probs.shape[1]))
    short = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
    for a in range(0, len(short), 10_000):
        at = short[a : a + 10_000]
        lat = Lattice([words[i] for i in at], vocab)
        alpha = lat.forward(lat.weights(probs, vocab))
        out[at] = np.log(alpha[np.arange(lat.n), lat.lengths]) - lat.lengths[:, None] * math.log(SCALE)
    for i in set(range(len(words))).difference(short):
        out[i] = _log_forward(words[i], probs, vocab)
    return out


def _log_forward(text: str, probs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The forward algorithm of one long word, rescaled at every place."""
    n, m = len(text), vocab.longest
    alpha, shift = np.zeros((m + 1, probs.shape[1])), np.zeros(probs.shape[1])
    alpha[0] = 1
    recent = [alpha[0]]
    for e in range(1, n + 1):
        here = np.zeros(probs.shape[1])
        for back, a in enumerate(reversed(recent), 1):
            p = vocab.ids.get(text[e - back : e])
            if p is not None:
                here = here + a * probs[p]
            elif back == 1:
                here = here + a * probs[[vocab.bytes[b] for b in text[e - 1].encode("utf-8", "surrogatepass")]].prod(axis=0)
        top = np.where(here > 0, here, 1)
        recent = [r / top for r in recent[-(m - 1) :]] + [here / top]
        shift = shift + np.log(top)
    return shift + np.log(recent[-1])


def text_words(text: str) -> list[str]:
    """The lower-cased words of a text, without the commonest marks."""
    text = text.lower()
    for mark in MARKS:
        text = text.replace(mark, " ")
    return text.split()


def estimate(counts: dict[str, Counter], vocab: Vocabulary, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, (piece, language) probabilities) by expectation-maximisation over all segmentations."""
    langs = sorted(counts)
    size = len(vocab.pieces)
    probs = np.full((size, max(1, len(langs))), 1 / size)
    for k, lang in enumerate(langs):
        # A longer word counts by its stretches.
        items = Counter()
        for w, n in counts[lang].items():
            for a in range(0, len(w), LONG):
                items[(SPACE if not a else "") + w[a : a + LONG]] += n
        if not items:
            continue
        words = sorted(items, key=len)
        p = probs[:, k : k + 1]
        for _ in range(rounds):
            got = np.zeros(size)
            for a in range(0, len(words), STEP):
                got += _expected(words[a : a + STEP], items, p, vocab)
            # Smoothing keeps a floor under every piece, spread by length so that unseen pieces stay rare.
            got += SMOOTHING * vocab.floor
            p = (got / got.sum())[:, None]
        probs[:, k] = p[:, 0]
    return langs, probs


def _expected(words: list[str], counts: Counter, p: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Expected number of each piece over all segmentations of counted words."""
    lat = Lattice(words, vocab)
    n = np.array([counts[w] for w in words], dtype=float)
    weight = lat.weights(p, vocab)
    alpha, beta = lat.forward(weight), lat.backward(weight)
    whole = alpha[np.arange(lat.n), lat.lengths, 0]
    share = n[lat.word] * alpha[lat.word, lat.start, 0] * weight[:, 0] * beta[lat.word, lat.end, 0] / whole[lat.word]
    own = lat.piece >= 0
    got = np.bincount(lat.piece[own], weights=share[own], minlength=len(vocab.pieces))
    for edge, c in lat.spelt.items():
        for b in c.encode("utf-8", "surrogatepass"):
            got[vocab.bytes[b]] += share[edge]
    return got


def training_counts(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict[str, Counter]:
    """Word counts by language of about max_docs documents each, outside the held-out fold.

    A document is in where the hash of its id and text is in the first max_docs / n of the hash's range, n
    being its language's documents; so no language's rows ever meet in one task.  Equal rows count once.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    # The model has a column a language, so their table is small beside it.
    texts = known.join(F.broadcast(sizes), "lang").where(place * F.col("n") < max_docs).select("doc_id", "lang", "text").distinct()

    def run(batches):
        per_worker(None, None)
        counts: Counter = Counter()
        for b in batches:
            for lang, t in zip(b["lang"], b["text"], strict=True):
                counts.update((lang, w) for w in text_words(t or ""))
        yield pd.DataFrame({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}).astype({"lang": object, "word": object, "n": "int64"})

    words = texts.mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, Counter] = {}
    for r in words.toLocalIterator():  # the words of about max_docs documents a language
        out.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return out


class Scorer:
    """Predictions of texts; log-probabilities of recent words are kept."""

    MOST = 100_000

    def __init__(self, langs: list[str], probs: np.ndarray, vocab: Vocabulary):
        self.langs, self.probs, self.vocab = langs, probs, vocab
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, probs.shape[1]))

    def learn(self, tokens: list[list[str]]) -> None:
        fresh = list(set().union(*tokens) - self.known.keys())
        if len(self.known) + len(fresh) > self.MOST:
            self.known, self.rows = {}, self.rows[:0]
            fresh = list(set().union(*tokens))
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.rows = np.vstack((self.rows, log_probs([SPACE + w for w in fresh], self.probs, self.vocab)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, share of its probability) by text; 'und' and 0 without a letter or without a model."""
        out, scores = [], np.zeros(len(texts))
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            tokens = [text_words(t) if t and LETTER.search(t) else [] for t in part]
            self.learn(tokens)
            for k, words in enumerate(tokens):
                if not words or not self.langs:
                    out.append("und")
                    continue
                total = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(total.argmax())
                out.append(self.langs[best])
                scores[a + k] = 1 / np.exp(np.minimum(total - total[best], 0)).sum()
        return out, scores


def identify_languages(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Each language has a unigram model over the pieces of a public vocabulary (vocab_path, or the default
    one), estimated from about MAX_DOCS of its documents.  A text's probability is the product over its
    words of the sum over all their segmentations; pieces don't cross words.  score is the predicted
    language's share under equal priors; ties take the first language by name.  Null texts, texts without a
    letter, and all texts where no language is known give 'und' with score 0.  Null ids aren't held out;
    repeated rows repeat; other columns are ignored; a very long text is scored word by word; an empty table gives
    no rows.
    """
    vocab = load_vocabulary(vocab_path)
    langs, probs = estimate(training_counts(docs), vocab)
    model = docs.sparkSession.sparkContext.broadcast((langs, probs, vocab))
    kind, key = docs.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def run(batches):
        scorer = per_worker(key, lambda: Scorer(*model.value))
        for b in batches:
            pred, score = scorer.predict(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": pred, "score": score})

    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
