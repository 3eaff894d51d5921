"""N-gram Jaccard self-join by PartEnum signatures, exact: every linked pair of sets shares a signature.

Sets are put in bands by size, so that linked sets are in one band or in neighbouring ones.  For each band the shingle
domain, 64-bit hashes, is cut into first-level parts and each of those into three; of a part that two sets differ in
at most once, two of its three pieces are the same in both, and the signatures are the choices of two pieces.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, per_worker, release
from .components import components
from .linededup import WORDS, linked, slot_filter

WIDTH = 4
#: Two sets are linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Pieces of a part, of which all but one make a signature.
PIECES = 3
#: A signature over fewer shingles is left out where others make up for it (see Index).
FEWEST = 2
#: Documents whose signatures are looked at together, sets there that make a signature hot, and parts of a hot one.
LOT, HOT, SALT = 2_000, 32, 64
#: Further centres that the sets of a signature meet before all that are still apart meet each other.
ROUNDS = 2
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as random as a fixed rule makes them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's WIDTH-word shingles; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    last = max(1, len(h) - WIDTH + 1)
    total = np.full(last, min(len(h), WIDTH), np.uint64)
    for k in range(min(len(h), WIDTH)):
        total += h[k : k + last] * _ODD[k]
    return np.unique(mix(total))


def set_class(h: np.ndarray) -> int:
    """A signed 64-bit number of a set, alike for equal ones; never 0."""
    total = np.sum(mix(h ^ _ODD[1]), dtype=np.uint64, keepdims=True) + np.full(1, len(h), np.uint64) * _ODD[2]
    return int(mix(total).view(np.int64)[0]) or 1


def sketch(h: np.ndarray) -> np.ndarray:
    """WORDS longs: of each bit, the parity of the hashes that fall on it; two differ in at most as many bits as their sets do."""
    bits = np.bincount((h >> np.uint64(53)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


@lru_cache(maxsize=1)
def bands(most: int = 1 << 40) -> np.ndarray:
    """Greatest size of each band.  A set of a band reaches into the next one at most."""
    out, low = [], 1
    while low <= most:
        out.append(low * 100 // PERCENT)
        low = out[-1] + 1
    return np.array(out, np.int64)


class Index(NamedTuple):
    """How sets of a band meet those of it and of the band below: edges of pieces, and spare parts.

    Linked sets differ in at most k shingles, so in more than one shingle in at most k // 2 of the parts, and the
    other parts, spare + 1 of them, give a common signature each.  A set with no more than `spare` parts that have
    a thin signature, one of fewer than FEWEST shingles, leaves its thin ones out: one of the common ones is not thin.
    Where all common ones are thin, both sets have more such parts and give all.
    """

    edges: np.ndarray
    names: np.ndarray
    spare: int


def thin_share(mean: float) -> float:
    """Probability that two of a part's pieces have under FEWEST = 2 shingles together, at a mean of shingles a piece."""
    a = math.exp(-mean)
    b = mean * a
    return 3 * (a * a + 2 * a * b) - 3 * (a * (a + b) ** 2 + b * a * a) + a**3 + 3 * a * a * b


@lru_cache(maxsize=512)
def index(band: int) -> Index | None:
    """The index of a band; None where linked sets are equal."""
    top = bands()
    k = 2 * (100 - PERCENT) * int(top[band]) // (100 + PERCENT)
    if not k:
        return None
    least = int(top[band - 2]) + 1 if band > 1 else 1
    need = parts = k // 2 + 1
    while parts <= 2 * need:
        thin = parts * thin_share(least / (PIECES * parts))
        if parts - need >= thin + 3 * math.sqrt(thin):
            break
        parts += 1
    else:
        parts = need
    pieces = PIECES * parts
    edges = np.array([(j << 64) // pieces for j in range(1, pieces)], np.uint64)
    names = mix(np.arange(pieces, dtype=np.uint64) + np.full(1, band + 1, np.uint64) * _ODD[3])
    return Index(edges, names, parts - need)


def signatures(h: np.ndarray) -> np.ndarray:
    """A set's signatures, for its own band and as the smaller set for the next one."""
    if not len(h):
        return h
    own = int(np.searchsorted(bands(), len(h)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ _ODD[0]), dtype=np.uint64)))
    out = []
    for at in (index(own), index(own + 1)):
        if at is None:
            continue
        ends = np.concatenate(([0], np.searchsorted(h, at.edges), [len(h)]))
        count = np.diff(ends).reshape(-1, PIECES)
        total = (sums[ends[1:]] - sums[ends[:-1]]).reshape(-1, PIECES)
        # A choice of pieces is all but one of them.
        count = count.sum(axis=1, keepdims=True) - count
        total = total.sum(axis=1, keepdims=True, dtype=np.uint64) - total
        sig = mix(total.ravel() + count.ravel().astype(np.uint64) * _ODD[1] + at.names)
        thin = count < FEWEST
        out.append(sig if np.count_nonzero(thin.any(axis=1)) > at.spare else sig[~thin.ravel()])
    return np.concatenate(out) if out else h[:0]


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n, lid, w0, w1, ...) of every document: text hash, set size, set class (null for an empty set) and sketch."""
    kind = docs.schema[id_col].dataType.simpleString()
    words = [f"w{k}" for k in range(WORDS)]

    def run(batches):
        per_worker(None, None)
        for b in batches:
            sets = [shingle_set(t) for t in b["text"].to_pylist()]
            sketches = np.array([sketch(s) for s in sets], np.int64).reshape(-1, WORDS)
            n = [len(s) for s in sets]
            lid = pa.array([set_class(s) if len(s) else None for s in sets], pa.int64())
            yield pa.record_batch([b["doc_id"], b["h"], pa.array(n, pa.int64()), lid, *[pa.array(sketches[:, k]) for k in range(WORDS)]], names=["doc_id", "h", "n", "lid", *words])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return texts.mapInArrow(run, f"doc_id {kind}, h long, n long, lid long, " + ", ".join(f"{w} long" for w in words))


def signed(docs: DataFrame, text_col: str) -> DataFrame:
    """(sig, part, lid): signatures of sets, equal sets of a task once.

    In a lot of documents that has HOT sets and more of one signature, these get parts 2 and up, dealt by set, and
    one of them goes for all with part 1; other sets have part 0.
    """

    def dealt(sets: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sig = np.concatenate([s for _, s in sets]).view(np.int64)
        lid = np.repeat(np.array([c for c, _ in sets], np.int64), [len(s) for _, s in sets])
        part = np.zeros(len(sig), np.int8)
        order = np.argsort(sig, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(sig[order]) != 0))) if len(sig) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(sig)])))
        hot = sizes >= HOT
        if hot.any():
            inside = np.zeros(len(sig), bool)
            inside[order] = np.repeat(hot, sizes)
            part[inside] = 2 + lid[inside] % SALT
            one = order[starts[hot]]
            sig, lid, part = np.concatenate((sig, sig[one])), np.concatenate((lid, lid[one])), np.concatenate((part, np.ones(len(one), np.int8)))
        return pa.record_batch([sig, part, lid], names=["sig", "part", "lid"])

    def run(batches):
        per_worker(None, None)
        seen, held = set(), []
        for b in batches:
            for text in b["text"].to_pylist():
                h = shingle_set(text)
                if len(h) and (c := set_class(h)) not in seen:
                    seen.add(c)
                    held.append((c, signatures(h)))
                if len(held) == LOT:
                    yield dealt(held)
                    held = []
        if held:
            yield dealt(held)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "sig long, part byte, lid long")


def met_sets(keyed: DataFrame) -> DataFrame:
    """(key, lid, n, centre, hot) of the sets that share a signature: how many they are, one of them, and whether there are parts of it.

    Rows come sorted, so a run of one signature is seen as it passes; the parts of a hot one are runs of their own.
    """

    def shared(sig: np.ndarray, part: np.ndarray, lid: np.ndarray) -> pa.RecordBatch:
        side = np.maximum(part, 1)
        same = lambda x: x[1:] == x[:-1]
        run = np.concatenate(([True], ~(same(sig) & same(side)))) if len(sig) else np.zeros(0, bool)
        first_one = run | np.concatenate(([True], ~same(lid))) if len(sig) else run
        number = np.cumsum(run) - 1
        hot = np.zeros(int(run.sum()), bool)
        hot[number[part > 0]] = True
        members = np.bincount(number[first_one], minlength=len(hot))
        keep = first_one & ((members > 1) | hot)[number]
        at = number[keep]
        return pa.record_batch([sig[keep], lid[keep], members[at].astype(np.int64), lid[np.flatnonzero(run)][at], hot[at]], names=["key", "lid", "n", "centre", "hot"])

    def run(batches):
        held = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in (b["sig"], b["part"], b["lid"])]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            # The last run may go on in the next batch.
            ends = np.flatnonzero((held[0][1:] != held[0][:-1]) | (np.maximum(held[1], 1)[1:] != np.maximum(held[1], 1)[:-1]))
            if len(ends):
                yield shared(*[x[: ends[-1] + 1] for x in held])
                held = [x[ends[-1] + 1 :] for x in held]
        if held is not None:
            yield shared(*held)

    side = F.greatest(F.col("part"), F.lit(1).cast("byte"))
    # Parts 0 and 1 of a signature make one run, in the order of their sets.
    dealt = keyed.repartition("sig", side).sortWithinPartitions("sig", side, "lid")
    return dealt.mapInArrow(run, "key long, lid long, n long, centre long, hot boolean")


def sets_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(lid, shingles) of the wanted (lid, h): each set once, from one text that has it."""

    def run(batches):
        per_worker(None, None)
        for b in batches:
            sets = [shingle_set(t) for t in b["text"].to_pylist()]
            yield pa.record_batch([pa.array([set_class(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["lid", "shingles"])

    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    texts = slot_filter(texts, "h", wanted).join(wanted.select("h"), "h", "left_semi").groupBy("h").agg(F.max("text").alias("text"))
    return texts.select("text").mapInArrow(run, "lid long, shingles array<long>")


def alike_sets(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those (a, b) of pairs whose sets are linked, exactly."""
    sa, sb = sets.toDF("a", "_sa"), sets.toDF("b", "_sb")
    both = pairs.select("a", "b").join(sa, "a").join(sb, "b")
    common, sizes = F.size(F.array_intersect("_sa", "_sb")), F.size("_sa") + F.size("_sb")
    return cut_lineage(both.where(100 * common >= percent * (sizes - common)).select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    Equal sets are one node, whatever number of texts has them.  Sets that share a signature meet a few
    centres of it first; what that leaves apart is met in tiles, where sketches rule out most pairs, exactly; the rest is checked over the
    sets.  So no link between different sets is lost, but for a clash of 64-bit hashes.  Null and empty texts
    and those without a word have 0 shingles and link with nothing.  Null ids keep their row and get their
    component's least id, null if it has none.  Repeated rows stay repeated; rows of one id and different
    texts are nodes of their own.  Texts may be of any length, other columns are not looked at, and an empty
    table gives no rows.
    """
    base = cut_lineage(profiles(docs, id_col, text_col))
    keyed = signed(docs, text_col)
    met = cut_lineage(met_sets(keyed))
    ids = cut_lineage(met.select("lid").distinct())
    firsts = [F.first(f"w{k}").alias(f"w{k}") for k in range(WORDS)]
    known = base.where("lid IS NOT NULL").groupBy("lid").agg(F.min("h").alias("h"), F.first("n").cast("int").alias("size"), *firsts)
    sketches = cut_lineage(known.join(ids, "lid", "left_semi"))

    sets = cut_lineage(sets_of(docs, sketches.select("lid", "h"), text_col))
    # The centre of a part has met that part alone: in what is left, it stands among the others.
    rest = met.withColumns({"centre": F.when(F.col("hot"), F.lit(0).cast("long")).otherwise(F.col("centre")), "n": F.when(F.col("hot"), F.lit(3).cast("long")).otherwise(F.col("n"))})
    edges = linked(met, rest, sketches.drop("h"), lambda pairs: alike_sets(pairs, sets), PERCENT / 100, ROUNDS)
    roots = components(edges)
    least = base.where("lid IS NOT NULL").groupBy("lid").agg(F.min("doc_id").alias("least"))
    of = cut_lineage(least.join(roots.withColumnRenamed("node", "lid"), "lid", "left").withColumn("root", F.coalesce("root", "lid")))
    low = cut_lineage(of.groupBy("root").agg(F.min("least").alias("component_id")))
    of = cut_lineage(of.join(low, "root").select("lid", "component_id"))
    release(met, ids, sketches, sets, edges, low)
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "lid").join(of, "lid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("lid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
