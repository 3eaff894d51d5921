"""SimHash near-duplicates: pigeonhole blocks, exact Hamming check, components."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, per_worker, release
from .components import components

SEED = 42
#: Bit widths of the blocks; pairs within 3 bits agree on at least 3 of 6.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Buckets above this many fingerprints are compared in tiles instead of by a join.
JOIN_MOST = 64
TILE = 1024


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash: bit set where over half of the shingle hashes have it; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' columns but text, and fp: the fingerprint as a signed long, one row per document."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        per_worker(None, None)
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b["text"]), np.uint64, len(b))
            yield b[others].assign(fp=fps.view(np.int64))

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in others]
    return docs.mapInPandas(run, ", ".join([*kinds, "fp long"]))


def block_keys(fp, agree: int, widths=BLOCKS):
    """array<long> of keys, one for each choice of `agree` blocks, the choice's number included."""
    at = np.cumsum((0, *widths[:-1])).tolist()
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(at, widths, strict=True)]
    keys = []
    for n, choice in enumerate(itertools.combinations(range(len(widths)), agree)):
        key = F.lit(n).cast("long")
        for c in choice:
            key = F.shiftleft(key, widths[c]).bitwiseOR(part[c])
        keys.append(key)
    return F.array(*keys)


def popcount(x: np.ndarray) -> np.ndarray:
    """Bits set in signed longs; numpy counts those of the absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def tile_forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between two lists of fingerprints that join all that are linked, at most len(a) + len(b) of them."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in a:
        near = b[(popcount(np.bitwise_xor(b, x)) <= distance) & (b != x)]
        for y in near.tolist():
            if (p := find(int(x))) != (q := find(y)):
                parent[p] = q
                out.append((int(x), y))
    return out


def hamming_links(fps: DataFrame, distance: int = 3, widths=BLOCKS) -> DataFrame:
    """(a, b) links of distinct fingerprints that connect exactly those within `distance` bits.

    fps has one column fp of distinct longs.  Two fingerprints that differ in at most `distance` of the
    len(widths) blocks agree on the rest, so each is dealt out by every choice of that many blocks.  Buckets
    up to JOIN_MOST are joined on the key; the rest are cut into tiles of about TILE rows, and each pair of
    tiles, in a task of its own, gives only the links of a spanning forest.  So no bucket makes all pairs.
    """
    keyed = fps.select(F.explode(block_keys(F.col("fp"), len(widths) - distance, widths)).alias("k"), "fp")
    sizes = cut_lineage(keyed.groupBy("k").count().where("count > 1"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    shared = cut_lineage(keyed.join(sizes, "k"))
    small = shared.where(F.col("count") <= JOIN_MOST).select("k", "fp")
    links = small.join(small.withColumnRenamed("fp", "other"), "k").where((F.col("fp") < F.col("other")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    large = shared.where(F.col("count") > JOIN_MOST)
    n = F.ceil(F.col("count") / TILE).cast("int")
    tile = large.select("k", "fp", n.alias("n"), F.pmod(F.xxhash64("k", "fp"), n).cast("int").alias("t"))
    tile = tile.select("k", "fp", "t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    tile = tile.select("k", "fp", "t", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        i, t, fp = pdf["i"].iloc[0], pdf["t"].to_numpy(), np.unique(pdf["fp"].to_numpy())
        left = np.unique(pdf["fp"].to_numpy()[t == i])
        return pd.DataFrame(tile_forest(left, fp, distance), columns=["a", "b"], dtype="int64")

    return links.union(tile.groupBy("k", "i", "j").applyInPandas(forest, "a long, b long"))


def rooted(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(docs' columns but text, and fp; fp and root of its component), both written, of docs with a text."""
    base = cut_lineage(fingerprints(docs))
    prints = cut_lineage(base.select("fp").distinct())
    roots = components(hamming_links(prints, distance))
    of = cut_lineage(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    release(prints)
    return base, of


def simhash_components(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Documents with equal fingerprints form one node before any pair is sought, so exact copies cost one row
    each.  Null and empty texts have fingerprint 0 and link like any other.  Null ids keep their row and
    get their component's least non-null id, null if it has none.  Repeated rows stay repeated.  Texts may be of
    any length, other columns are not looked at, and an empty table gives no rows.
    """
    base, of = rooted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), distance)
    least = cut_lineage(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    own = cut_lineage(least.join(of, "fp"))
    ids = cut_lineage(own.groupBy("root").agg(F.min("least").alias("component_id")))
    out = cut_lineage(own.join(ids, "root").select("fp", "component_id"))
    release(of, least, own, ids)
    return base.join(out, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, distance: int = 3) -> DataFrame:
    """docs with one document of each component: that of its least doc_id, null last.

    A document is told by its id and text, so of two texts of one id in different components both stay, and a component
    of documents without an id keeps one.  Of rows that agree in id and text one stays, with its columns.  Null and
    empty texts are one component; texts may be of any length; an empty table gives no rows.
    """
    (rid,) = fresh(docs.columns, "_rid")
    base, of = rooted(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text"), distance)
    # Rows are counted up before the shuffle: a component may have a third of them.
    best = base.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid")).alias("best"))
    keep = cut_lineage(best.join(of, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.rid").alias(rid)))
    release(base, of)
    left = docs.withColumn(rid, F.xxhash64("doc_id", "text")).join(keep, rid, "left_semi")
    return left.dropDuplicates([rid]).drop(rid)
