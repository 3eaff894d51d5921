"""SentencePiece encoding with exact N-best segmentations, and decoding."""

from __future__ import annotations

import heapq
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, per_worker
from .langid import Lattice
from .vocabulary import SPACE, Vocabulary, load_vocabulary

N_BEST = 4
#: Stands for a literal SPACE sign within a chunk: a lone surrogate, which no text in UTF-8 holds.
SIGN = "\udbff"
LONG = 200
MARKS = ".,!?;:"


def zipf_scores(vocab: Vocabulary) -> np.ndarray:
    """Log-probabilities of pieces by Zipf's law over their rank in the vocabulary; bytes rank last."""
    order = sorted((i for i, k in enumerate(vocab.kinds) if k != "special"), key=lambda i: (vocab.kinds[i] == "byte", i))
    out = np.full(len(vocab.pieces), -np.inf)
    out[order] = -np.log(np.arange(1, len(order) + 1)) - math.log(sum(1 / n for n in range(1, len(order) + 1)))
    return out


def chunk_pattern(vocab: Vocabulary) -> re.Pattern:
    """Splits a text where no piece can cross, so that its lattice is a chain of small ones.

    That is before spaces that follow something else, around line ends, and between a letter and those
    marks that no piece has after a letter.
    """
    inner = {b for p in vocab.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in vocab.ids):
        return re.compile(r"(?s).+")
    marks = re.escape("".join(m for m in MARKS if m not in inner))
    # A run without marks stops before one if it ends in a letter, and takes the rest up to the space otherwise.
    run = rf" *[^ \n{marks}]+(?:(?<=[^\W\d_])(?=[{marks}])|[^ \n]*)|" if marks else ""
    return re.compile(rf"{run} *[^ \n]+|\n| +")


class Encoder:
    """Best and N-best segmentations of texts; recent chunks are kept."""

    #: Learning a chunk costs little more than keeping it, so a worker holds some tens of MB at most.
    MOST = 100_000
    #: Chunks that are learnt in step: their lattices are some KB each.
    STEP = 2_000

    def __init__(self, vocab: Vocabulary, n_best: int = N_BEST):
        self.vocab, self.n = vocab, n_best
        self.score = zipf_scores(vocab)
        self.pattern = chunk_pattern(vocab)
        of = {i: bytes((b,)) for b, i in vocab.bytes.items()}
        self.raw = [of.get(i) or p.replace(SPACE, " ").encode() for i, p in enumerate(vocab.pieces)]
        self.raw_sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        #: Characters that are pieces themselves; chunks with others need bytes and go one by one.
        self.plain = {" "}.union(p for p in vocab.ids if len(p) == 1) - {SPACE}
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.blobs: list[bytes] = []
        #: Whether a chunk's best ids decode to the chunk.
        self.whole = np.zeros(0, bool)
        self.best, self.gap, self.sizes, self.uses = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lists: dict[str, list[tuple[float, bytes]]] = {}

    # One chunk, in Python: any characters, any length.

    def edges(self, form: str, end: int):
        """(start, score, ids) of the edges that end at a place."""
        for start in range(max(0, end - self.vocab.longest), end):
            p = self.vocab.ids.get(form[start:end])
            if p is not None:
                yield start, self.score[p], (p,)
        if form[end - 1] not in self.vocab.ids:
            raw = (SPACE if form[end - 1] == SIGN else form[end - 1]).encode("utf-8", "surrogatepass")
            ids = tuple(self.vocab.bytes[b] for b in raw)
            yield end - 1, sum(self.score[i] for i in ids), ids

    @staticmethod
    def form(chunk: str) -> str:
        return chunk.replace(SPACE, SIGN).replace(" ", SPACE)

    def n_best(self, chunk: str) -> list[tuple[float, bytes]]:
        """Up to n (score, ids as int32 bytes), best first, by backward A-star from the chunk's end.

        The forward Viterbi score of a place is the exact best cost to the start, so hypotheses leave the
        queue in order of their whole score.
        """
        got = self.lists.get(chunk)
        if got is None:
            form = self.form(chunk)
            into = [list(self.edges(form, e)) if e else [] for e in range(len(form) + 1)]
            alpha = [0.0] + [-math.inf] * len(form)
            for e in range(1, len(form) + 1):
                alpha[e] = max(alpha[s] + w for s, w, _ in into[e])
            # Only the n best ways from a place to the end can be part of the n best segmentations, so a place
            # is left n times at most; a long run with very many equal segmentations ends soon by that.
            queue, pushed, left = [(-alpha[-1], len(form), 0, 0.0, None)], 0, [0] * (len(form) + 1)
            got = []
            while queue and len(got) < self.n:
                _, at, _, tail, path = heapq.heappop(queue)
                if at == 0:
                    ids = []
                    while path:
                        ids.extend(path[0])
                        path = path[1]
                    got.append((tail, np.array(ids, dtype=np.int32).tobytes()))
                    continue
                left[at] += 1
                if left[at] > self.n:
                    continue
                for s, w, own in into[at]:
                    pushed += 1
                    heapq.heappush(queue, (-(alpha[s] + w + tail), s, pushed, w + tail, (own, path)))
            got.sort(key=lambda x: -x[0])
            if len(self.lists) > self.MOST // 10:
                self.lists.clear()
            self.lists[chunk] = got
        return got

    # Many chunks at once.

    def learn(self, chunks: list[str]) -> None:
        """Best segmentation, score and loss of the second best of new chunks: Viterbi, all in step."""
        usual = [c for c in chunks if len(c) <= LONG and self.plain.issuperset(c)]
        usual.sort(key=len)
        for a in range(0, len(usual), self.STEP):
            self._learn(usual[a : a + self.STEP])
        for c in chunks:
            if c not in self.known:
                got = self.n_best(c)
                self._add([c], [got[0][1]], np.array([got[0][0]]), np.array([got[0][0] - got[1][0] if len(got) > 1 else np.inf]))

    def _decode_to(self, chunks: list[str], blobs: list[bytes]) -> np.ndarray:
        """Whether each chunk's ids decode to it.

        Decoding goes by piece: if the ids of all together give the joined text, and each chunk's pieces have its
        length, then each gives its own.
        """
        ids = np.frombuffer(b"".join(blobs), np.int32)
        own = [c.encode("utf-8", "surrogatepass") for c in chunks]
        ends = np.cumsum(np.fromiter((len(x) // 4 for x in blobs), np.int64, len(blobs)))
        sizes = np.diff(np.concatenate(([0], np.cumsum(self.raw_sizes[ids])))[np.concatenate(([0], ends))])
        if b"".join(map(self.raw.__getitem__, ids.tolist())) == b"".join(own) and (sizes == np.fromiter(map(len, own), np.int64, len(own))).all():
            return np.ones(len(chunks), bool)
        return np.array([b"".join(map(self.raw.__getitem__, np.frombuffer(x, np.int32).tolist())) == c for x, c in zip(blobs, own, strict=True)], bool)

    def _add(self, chunks, blobs, best, gap) -> None:
        self.whole = np.append(self.whole, self._decode_to(chunks, blobs))
        self.known.update(zip(chunks, range(len(self.blobs), len(self.blobs) + len(chunks)), strict=True))
        self.blobs.extend(blobs)
        self.best, self.gap = np.concatenate((self.best, best)), np.concatenate((self.gap, gap))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, blobs), np.int64, len(blobs))))
        self.uses = np.concatenate((self.uses, np.zeros(len(blobs), np.int64)))

    def compact(self) -> None:
        """Forgets chunks that fewer than two texts had, and the rarer half's worth beyond half of MOST."""
        keep = np.flatnonzero(self.uses >= 2)
        if len(keep) > self.MOST // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: self.MOST // 2]])
        names = list(self.known)
        self.known = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.blobs = [self.blobs[i] for i in keep.tolist()]
        self.best, self.gap, self.sizes, self.uses = self.best[keep], self.gap[keep], self.sizes[keep], self.uses[keep] // 2
        self.whole = self.whole[keep]

    def _learn(self, chunks: list[str]) -> None:
        lat = Lattice([self.form(c) for c in chunks], self.vocab)
        n, w = lat.n, self.score[lat.piece]
        alpha, beta = np.full((n, lat.top + 1), -np.inf), np.full((n, lat.top + 1), -np.inf)
        back = np.full((n, lat.top + 1), -1)
        alpha[:, 0] = 0
        for e, k in enumerate(lat._by(lat.end)):
            if len(k):
                own = lat.word[k]
                new = np.append(True, own[1:] != own[:-1])
                first = np.flatnonzero(new)
                value = alpha[own, lat.start[k]] + w[k]
                top = np.maximum.reduceat(value, first)
                alpha[own[first], e] = top
                hit = np.flatnonzero(value == top[np.cumsum(new) - 1])
                back[own[hit[::-1]], e] = k[hit[::-1]]  # the longest of equals
        beta[np.arange(n), lat.lengths] = 0
        for s, k in reversed(list(enumerate(lat._by(lat.start)))):
            if len(k):
                own = lat.word[k]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                beta[own[first], s] = np.maximum(beta[own[first], s], np.maximum.reduceat(beta[own, lat.end[k]] + w[k], first))
        best = alpha[np.arange(n), lat.lengths]
        through = alpha[lat.word, lat.start] + w + beta[lat.word, lat.end]
        at, live, steps = lat.lengths.copy(), np.arange(n), []
        while len(live):
            k = back[live, at[live]]
            through[k] = -np.inf
            steps.append((live, lat.piece[k]))
            at[live] = lat.start[k]
            live = live[at[live] > 0]
        second = np.maximum.reduceat(through, np.flatnonzero(np.append(True, lat.word[1:] != lat.word[:-1])))
        who, piece = np.concatenate([s[0] for s in steps[::-1]]), np.concatenate([s[1] for s in steps[::-1]])
        order = np.argsort(who, kind="stable")
        raw, ends = piece[order].astype(np.int32).tobytes(), 4 * np.cumsum(np.bincount(who, minlength=n))
        blobs = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        self._add(chunks, blobs, best, best - second)

    # Texts.

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text after the usual leading space; the empty text has none."""
        return self.pattern.findall(" " + text) if text else []

    def prepare(self, texts: list[str]) -> list[list[str]]:
        split = [self.chunks(t) for t in texts]
        every = set().union(*split)
        fresh = [c for c in every if c not in self.known]
        if len(self.known) + len(fresh) > self.MOST:
            self.compact()
            fresh = [c for c in every if c not in self.known]
        self.learn(fresh)
        return split

    def places(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def segmentations(self, chunks: list[str], at: np.ndarray | None = None) -> list[tuple[float, bytes]]:
        """Up to n (score, ids) of a prepared text, best first.

        Only the n - 1 chunks whose second best loses least can differ from the best in any of the n, so
        their exact lists are combined, least loss first; equal losses go by place, then by rank.
        """
        at = self.places(chunks) if at is None else at
        self.uses[at] += 1  # once a text
        whole = b"".join(map(self.blobs.__getitem__, at.tolist()))
        best = float(self.best[at].sum())
        out = [(best, whole)]
        gap = self.gap[at]
        few = np.flatnonzero(gap <= np.partition(gap, self.n - 2)[self.n - 2]) if 1 < self.n <= len(gap) else np.arange(len(gap))
        few = [i for i in few[np.argsort(gap[few], kind="stable")].tolist() if gap[i] < np.inf][: self.n - 1]
        lists = [self.n_best(chunks[i]) for i in few]
        if not lists:
            return out
        starts = [int(self.sizes[at[:i]].sum()) for i in few]
        queue, seen = [(0.0, (0,) * len(few))], set()
        while queue and len(out) < self.n:
            loss, ranks = heapq.heappop(queue)
            for k in range(len(few)):
                if ranks[k] + 1 < len(lists[k]):
                    nxt = (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(queue, (sum(x[0][0] - x[r][0] for x, r in zip(lists, nxt, strict=True)), nxt))
            if any(ranks):
                own, done = [], 0
                for k in sorted((k for k, r in enumerate(ranks) if r), key=lambda k: few[k]):
                    own += [whole[done : starts[k]], lists[k][ranks[k]][1]]
                    done = starts[k] + len(lists[k][0][1])
                out.append((best - loss, b"".join((*own, whole[done:]))))
        return out

    def round_trip(self, text: str, chunks: list[str], at: np.ndarray) -> bool:
        """Whether the best ids of a prepared text decode to it: each chunk's do to the chunk, and those make up the text."""
        return bool(self.whole[at].all()) and "".join(chunks) == (" " + text if text else "")

    def decode(self, ids: bytes) -> str:
        """The text of int32 ids: the inverse of every segmentation."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "surrogatepass")[1:]


def _encoders(docs: DataFrame, n_best: int, vocab_path: str | None):
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path))
    return lambda: per_worker(("pieces", vocab_path, n_best), lambda: Encoder(shared.value, n_best))


def _lists(lengths: list[int | None], values: pa.Array) -> pa.Array:
    """A list a row, of so many values in turn; null for a length of null."""
    offsets = np.concatenate(([0], np.cumsum([n or 0 for n in lengths]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([n is None for n in lengths], pa.bool_()))


def _n_best_lists(found: list[list[tuple[float, bytes]] | None], **more: list) -> pa.Array:
    """Of each text its segmentations as structs of score, further fields and ids, which never become Python numbers."""
    every = [x for own in found if own is not None for x in own]
    raw = b"".join(ids for _, ids in every)
    ids = _lists([len(x) // 4 for _, x in every], pa.Array.from_buffers(pa.int32(), len(raw) // 4, [None, pa.py_buffer(raw)]))
    columns = {"score": pa.array([x for x, _ in every], pa.float64()), **{k: pa.array(v, pa.int64()) for k, v in more.items()}, "ids": ids}
    return _lists([None if own is None else len(own) for own in found], pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _arrow_udf(make, of, kind: str):
    """A function over text: of(encoder, texts, their chunks) gives some texts' column."""
    from collections.abc import Iterator

    def run(parts):
        encoder = make()
        for part in parts:
            # An Arrow batch may hold 10,000 texts: few of them become Python's at a time.
            for a in range(0, len(part), 200):
                texts = part.slice(a, 200).to_pylist()
                for b, c in chunks([t or "" for t in texts]):
                    own = texts[b:c]
                    yield of(encoder, own, encoder.prepare([t or "" for t in own]))
            pa.default_memory_pool().release_unused()

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def encode(docs: DataFrame, n_best: int = N_BEST, vocab_path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with a column pieces: array<struct<score double, ids array<int>>>, best first; null for null texts."""

    def of(encoder, texts, split):
        return _n_best_lists([None if t is None else encoder.segmentations(c) for t, c in zip(texts, split, strict=True)])

    udf = _arrow_udf(_encoders(docs, n_best, vocab_path), of, "array<struct<score double, ids array<int>>>")
    return docs.withColumn("pieces", udf(text_col))


def encode_documents(docs: DataFrame, n_best: int = N_BEST, vocab_path: str | None = None) -> DataFrame:
    """docs with n_pieces, score, ids_crc32, n_segmentations, nbest and round_trip: segment_documents(), and the ids.

    nbest holds score, n_pieces, ids_crc32 and ids, array<int>, of each of the n_best likeliest segmentations of the
    whole text, best first.  Null texts give nulls with no segmentations; the empty text has one without pieces.  A row
    for every row, repeated ones and null ids included, with all its columns; where docs has a column of a new one's
    name, it stays, and the new one's name gets an underscore.  A very long text goes by itself; no shuffle.
    """

    def of(encoder, texts, split):
        found, whole = [], []
        for t, own in zip(texts, split, strict=True):
            at = encoder.places(own)
            found.append(None if t is None else encoder.segmentations(own, at))
            whole.append(None if t is None else encoder.round_trip(t, own, at))
        crc = [[] if x is None else [zlib.crc32(ids) for _, ids in x] for x in found]
        sizes = [[] if x is None else [len(ids) // 4 for _, ids in x] for x in found]
        flat = lambda lists: [v for own in lists for v in own]
        first = lambda lists: [own[0] if own else None for own in lists]
        best = pa.array([None if x is None else x[0][0] for x in found], pa.float64())
        columns = [
            pa.array(first(sizes), pa.int64()),
            best,
            pa.array(first(crc), pa.int64()),
            pa.array([len(x) for x in sizes], pa.int32()),
            _n_best_lists(found, n_pieces=flat(sizes), ids_crc32=flat(crc)),
            pa.array(whole, pa.bool_()),
        ]
        return pa.StructArray.from_arrays(columns, names)

    names = ["n_pieces", "score", "ids_crc32", "n_segmentations", "nbest", "round_trip"]
    kind = "struct<n_pieces long, score double, ids_crc32 long, n_segmentations int, nbest array<struct<score double, n_pieces long, ids_crc32 long, ids array<int>>>, round_trip boolean>"
    held, *shown = fresh(docs.columns, "_encoded", *names)
    udf = _arrow_udf(_encoders(docs, n_best, vocab_path), of, kind)
    out = docs.withColumn(held, udf("text"))
    return out.select(*docs.columns, *[F.col(held)[n].alias(s) for n, s in zip(names, shown, strict=True)])


def decode(encoded: DataFrame, ids_col: str = "ids", vocab_path: str | None = None) -> DataFrame:
    """encoded with a column decoded: the text of an array of ids; null for null."""
    make = _encoders(encoded, 1, vocab_path)

    def run(parts):
        encoder = make()
        for ids in parts:
            yield pd.Series([None if i is None else encoder.decode(np.asarray(i, np.int32).tobytes()) for i in ids], index=ids.index, dtype=object)

    return encoded.withColumn("decoded", _iterator_udf(run, "string")(ids_col))


def _iterator_udf(run, kind: str):
    from collections.abc import Iterator

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def segment_documents(docs: DataFrame, n_best: int = N_BEST, vocab_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, n_pieces, score, ids_crc32, n_segmentations, nbest, round_trip.

    nbest holds score, number of pieces and crc32 of the int32 ids of each of the n_best likeliest
    segmentations of the whole text; the first is the best and gives the columns beside it.  round_trip:
    its ids decode to the very text, which is found out chunk by chunk.  Null texts give nulls with no segmentations;
    the empty text has one without pieces.  Segmentations of equal score come in a fixed order.  A very long text is a
    chain of chunks; one without a blank is a single chunk, whose lattice takes memory with its length.  Null ids and
    repeated rows stay; other columns are ignored; an empty table gives no rows; no shuffle.
    """
    make = _encoders(docs, n_best, vocab_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_chars", "n_pieces", "score", "ids_crc32", "n_segmentations", "nbest", "round_trip"]

    def run(batches):
        encoder = make()
        for b in batches:
            for a in range(0, len(b), 200):
                texts, rows = list(b["text"].iloc[a : a + 200]), []
                for t, chunks in zip(texts, encoder.prepare([t or "" for t in texts]), strict=True):
                    if t is None:
                        rows.append((None, None, None, None, 0, None, None))
                        continue
                    at = encoder.places(chunks)
                    found = [(s, len(ids) // 4, zlib.crc32(ids)) for s, ids in encoder.segmentations(chunks, at)]
                    nbest = [{"score": s, "n_pieces": n, "ids_crc32": c} for s, n, c in found]
                    rows.append((len(t), found[0][1], found[0][0], found[0][2], len(found), nbest, encoder.round_trip(t, chunks, at)))
                out = pd.DataFrame(rows, columns=names, dtype=object)
                out.insert(0, "doc_id", b["doc_id"].iloc[a : a + 200].to_numpy())
                yield out

    schema = f"doc_id {kind}, n_chars long, n_pieces long, score double, ids_crc32 long, n_segmentations int, nbest array<struct<score double, n_pieces long, ids_crc32 long>>, round_trip boolean"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
