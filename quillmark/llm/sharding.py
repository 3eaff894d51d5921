"""Minimax contiguous sharding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

#: Bits of a text's hash, by which atomic groups are ordered: equal texts are one group.
HASH_BITS = 60
#: Leading bits by which groups are bundled at first, and bits added where a cut may fall into a bundle.
BUNDLE_BITS, MORE_BITS = 18, 12
#: Rows of a shard are numbered in so many cells, by a hash of their id and text.
CELL_BITS = 12


def feasible(ends: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Greedy check: where each shard stops if it takes groups while they fit, or None if groups are left.

    ends: cumulative group sizes.  A cut is the number of groups before it.
    """
    cuts, at, base = [], 0, 0
    for _ in range(shards):
        to = int(np.searchsorted(ends, base + capacity, side="right"))
        if to == at and at < len(ends):
            return None
        at, base = to, int(ends[to - 1]) if to else 0
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
    return None


def minimax_cuts(sizes, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, cuts) that splits ordered group sizes into contiguous shards; no groups: capacity 0.

    Binary search over the capacity, from the larger of the mean and the largest group to the total.
    """
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64)) if len(sizes) else np.zeros(0, np.int64)
    if not len(ends):
        return 0, [0] * shards
    low, high = max(-(-int(ends[-1]) // shards), int(np.max(sizes))), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(ends, shards, mid) else (mid + 1, high)
    return low, feasible(ends, shards, low)


def open_bundles(sizes: np.ndarray, single: np.ndarray, shards: int, capacity: int) -> np.ndarray:
    """Bundles of several groups into which a cut may fall once they are taken apart.

    With the smallest capacity, at most that of whole bundles, k shards hold at most k times it, and the
    others the rest: a cut lies within one window of bytes.
    """
    ends = np.cumsum(sizes)
    starts, total = ends - sizes, int(ends[-1]) if len(ends) else 0
    out = np.zeros(len(sizes), bool)
    for k in range(1, shards):
        out |= (ends > total - (shards - k) * capacity) & (starts < k * capacity)
    return out & ~single


def exact_cuts(groups: DataFrame, shards: int, bundle_bits: int = BUNDLE_BITS, more_bits: int = MORE_BITS) -> list[int]:
    """The hashes at which shards after the first begin, from a table (h, size) of rows.

    The driver gets at most 2**bundle_bits sizes of bundles of groups, by their leading bits.  Bundles into
    which a cut may fall are then taken apart, more_bits at a time, down to single groups: a few for each
    cut, so the result is the minimax over groups at any size of the table.
    """

    def sizes_of(rows: DataFrame, bits: int) -> np.ndarray:
        """(first hash, size, is a single group) of bundles, by hash."""
        bundle = F.shiftright("h", HASH_BITS - bits)
        found = rows.groupBy(bundle.alias("b")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
        pdf = found.toPandas()
        return np.stack([pdf["low"], pdf["size"], pdf["low"] == pdf["high"], pdf["b"]], axis=1).astype(np.int64) if len(pdf) else np.zeros((0, 4), np.int64)

    spark = groups.sparkSession
    bits = min(bundle_bits, HASH_BITS)
    atoms = sizes_of(groups, bits)
    atoms = np.column_stack((atoms, np.full(len(atoms), bits)))
    while True:
        atoms = atoms[np.argsort(atoms[:, 0])]
        capacity, cuts = minimax_cuts(atoms[:, 1], shards)
        undone = open_bundles(atoms[:, 1], atoms[:, 2].astype(bool), shards, capacity)
        if not undone.any():
            return [int(atoms[c, 0]) for c in cuts[:-1] if c < len(atoms)]
        bits = int(atoms[undone, 4].min())
        undone &= atoms[:, 4] == bits
        wanted = spark.createDataFrame([(int(b),) for b in atoms[undone, 3]], "b long")
        deeper = min(HASH_BITS, bits + more_bits)
        # The bundles that a few cuts may fall into.
        rows = groups.withColumn("b", F.shiftright("h", HASH_BITS - bits)).join(F.broadcast(wanted), "b", "left_semi").drop("b")
        more = sizes_of(rows, deeper)
        atoms = np.vstack((atoms[~undone], np.column_stack((more, np.full(len(more), deeper)))))


def shard_documents(docs: DataFrame, shards: int = 8, bundle_bits: int = BUNDLE_BITS, more_bits: int = MORE_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 1 (null text: 1, and crc32 of no bytes).  Equal texts share a hash,
    so an atomic group, so a shard.  Groups are ordered by hash, and the largest shard is as small as any
    cutting of that order allows; see exact_cuts for what reaches the driver.  Slots number each shard's rows
    without gaps: rows are dealt to cells by a hash of id and text, cells are counted, and each row's number in
    its cell is added to the cell's offset, so one hot text or source never meets in one task.  Rows without
    an id are dealt by their size and text too, so copies of one text among them share a cell.  Repeated rows
    and null ids each get a slot of their own.  An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = lambda c: F.conv(F.substring(c, 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        number(F.md5(text)).alias("h"),
    )
    cell = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("h").cast("string"))), 1, CELL_BITS // 4), 16, 10).cast("int")
    rows = cut_lineage(rows.withColumn("cell", cell))
    shard = F.lit(0)
    for first in exact_cuts(rows.select("h", "size"), shards, bundle_bits, more_bits):
        shard = shard + F.when(F.col("h") >= first, 1).otherwise(0)
    rows = rows.select("doc_id", "size", "text_crc32", "cell", shard.cast("int").alias("shard"))
    cells = rows.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    # At most shards x 2**CELL_BITS rows are broadcast.
    return (
        rows.withColumn("n", F.row_number().over(here))
        .join(F.broadcast(cells), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
