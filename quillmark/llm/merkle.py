"""Merkle manifest of a dataset: hash trees of sixteen, built and proved by DuckDB within aligned Arrow buckets.

Spark ranks the leaves, deals them out in buckets of 16^3 neighbours, combines the buckets' roots and brings each
bucket the outer part of its proofs.  Within a bucket, ordered string_agg and sha256 make one level from another.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, per_worker, release

#: Nodes that become one, and levels of a bucket, which so has 16^3 nodes.
FAN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tampering touches the rows whose id's crc32 this divides.
TAMPERED = 5
#: Characters of a digest.
HEX = 64
PATH = "array<struct<l:string,r:string>>"


def leaf_of(values: list[Column]) -> Column:
    """sha256 of the values' framed texts: '-' for null, else UTF-8 byte count, ':' and value."""
    framed = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*framed), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, node, tampered): g is '' for no source, else '=' and the source; tampered is null where nothing was done."""
    lower = F.translate("text", UPPER, LOWER)
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    g = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g")
    tampered = F.when(hit, leaf_of([lower if c == "text" else F.col(c) for c in FIELDS]))
    return docs.select(g, "doc_id", leaf_of([F.col(c) for c in FIELDS]).alias("node"), tampered.alias("tampered"))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with pos, a row's place from 0 within its g by order, and n, the rows of g.

    Rows are dealt out by ranges, equal ones by their place in df too, so no task has all of a large g; places
    within a range are counted there and moved on by the ranges before.  df is a written table.
    """
    tie, part = fresh(df.columns, "tie", "part")
    placed = df.withColumn(tie, F.monotonically_increasing_id())
    placed = cut_lineage(placed.repartitionByRange("g", *order, tie).withColumn(part, F.spark_partition_id()))
    by_range = Window.partitionBy("g").orderBy(part)
    counts = placed.groupBy("g", part).agg(F.count("*").alias("k"))
    before = counts.select("g", part, (F.sum("k").over(by_range) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("g")).alias("n"))
    before = cut_lineage(before)
    own = F.row_number().over(Window.partitionBy("g", part).orderBy(*order, tie)) - 1
    out = cut_lineage(placed.withColumn("pos", own.cast("long")).join(before, ["g", part]).withColumn("pos", F.col("pos") + F.col("before")).drop(part, tie, "before"))
    release(placed, before)
    return out


def depth(n: int, most: int = LEVELS) -> int:
    """Levels of a bucket of a tree of n nodes: all if other buckets follow, else until one node remains."""
    k = 0
    while k < most and FAN**k < n:
        k += 1
    return k


def level_sql(levels: int) -> str:
    """l0, l1, ...: the nodes of each level; r1, r2, ...: the runs that they come from, joined in order."""
    steps = ["l0 AS (SELECT pos, node FROM nodes)"]
    for k in range(1, levels + 1):
        steps.append(f"r{k} AS (SELECT pos // {FAN} AS pos, string_agg(node, '' ORDER BY pos) AS run FROM l{k - 1} GROUP BY pos // {FAN})")
        steps.append(f"l{k} AS (SELECT pos, sha256(run) AS node FROM r{k})")
    return ",\n".join(steps)


def sibling_sql(levels: int) -> tuple[str, str]:
    """(columns, joins) that give a leaf b of the bucket the runs on either side of it, x1, y1, x2, y2, ..."""
    columns, joins = "", ""
    for k in range(1, levels + 1):
        at = f"{HEX} * (b.pos // {FAN ** (k - 1)} % {FAN})"
        columns += f", substr(r{k}.run, 1, {at}) AS x{k}, substr(r{k}.run, {at} + {HEX + 1}) AS y{k}"
        joins += f" JOIN r{k} ON r{k}.pos = b.pos // {FAN**k}"
    return columns, joins


def ask(sql: str, nodes: pa.Table) -> pa.Table:
    """A query over one bucket, in this worker's own engine: one thread, no files."""
    con = per_worker("duckdb", lambda: duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "preserve_insertion_order": False}))
    con.register("nodes", nodes)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        con.unregister("nodes")


def bucket_of(df: DataFrame, most: int) -> DataFrame:
    return df.withColumn("bucket", F.floor(F.col("pos") / FAN**most).cast("long"))


def bucket_roots(tier: DataFrame, most: int) -> DataFrame:
    """(g, pos, n, node): a node for each bucket of a tier (g, pos, n, node), which make up the tier above."""

    def run(table: pa.Table) -> pa.Table:
        levels, g, n, bucket = depth(table["n"][0].as_py(), most), table["g"][0].as_py(), table["n"][0].as_py(), table["bucket"][0].as_py()
        (node,) = ask(f"WITH {level_sql(levels)} SELECT node FROM l{levels}", table)["node"].to_pylist()
        return pa.table({"g": [g], "pos": pa.array([bucket], pa.int64()), "n": pa.array([-(-n // FAN**most)], pa.int64()), "node": [node]})

    return bucket_of(tier.select("g", "pos", "n", "node"), most).groupBy("g", "bucket").applyInArrow(run, "g string, pos long, n long, node string")


def climb(tier: DataFrame, most: int) -> list[DataFrame]:
    """The tiers of all trees, from the leaves up; the last has one node a tree.  Each is a bucket's share of the one below."""
    tiers = [tier]
    while True:
        tiers.append(cut_lineage(bucket_roots(tiers[-1], most)))
        if (tiers[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return tiers


def outer_paths(tiers: list[DataFrame], top: DataFrame, most: int) -> DataFrame:
    """(g, bucket, path): of the buckets of the lowest tier, the siblings from their root up.  top gives them for whole trees."""

    def run(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return outer.select(["g", "bucket", "path"]).slice(0, 0)
        levels, (above,) = depth(nodes["n"][0].as_py(), most), outer["path"].to_pylist()
        columns, joins = sibling_sql(levels)
        out = ask(f"WITH {level_sql(levels)} SELECT b.g, b.pos{columns} FROM nodes b{joins}", nodes)
        sides = [[{"l": row[f"x{k}"], "r": row[f"y{k}"]} for k in range(1, levels + 1)] + above for row in out.to_pylist()]
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        return pa.table({"g": out["g"], "bucket": out["pos"], "path": pa.array(sides, kind)})

    paths, last = top, None
    # The highest tier is the trees' roots, whose paths top has.
    for tier in reversed(tiers[1:-1]):
        nodes = bucket_of(tier.select("g", "pos", "n", "node"), most)
        paths = cut_lineage(nodes.groupBy("g", "bucket").cogroup(paths.groupBy("g", "bucket")).applyInArrow(run, f"g string, bucket long, path {PATH}"))
        if last is not None:
            release(last)
        last = paths
    return paths


def proofs(tier: DataFrame, paths: DataFrame, id_type: str, most: int) -> DataFrame:
    """(g, doc_id, leaf, proof_sha256, folded_root) of ranked leaves and their buckets' outer paths."""

    def run(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        levels, (above,) = depth(nodes["n"][0].as_py(), most), outer["path"].to_pylist()
        columns, joins = sibling_sql(levels)
        inner = "".join(f" || x{k} || y{k}" for k in range(1, levels + 1))
        folded = "coalesce(tampered, node)"
        for k in range(1, levels + 1):
            folded = f"sha256(x{k} || {folded} || y{k})"
        for side in above:
            folded = f"sha256('{side['l']}' || {folded} || '{side['r']}')"
        rest = "".join(side["l"] + side["r"] for side in above)
        sql = f"WITH {level_sql(levels)}, sides AS (SELECT b.*{columns} FROM nodes b{joins}) SELECT g, doc_id, node AS leaf, sha256(''{inner} || '{rest}') AS proof_sha256, {folded} AS folded_root FROM sides"
        return ask(sql, nodes)

    leaves = bucket_of(tier, most).groupBy("g", "bucket").cogroup(paths.groupBy("g", "bucket"))
    return leaves.applyInArrow(run, f"g string, doc_id {id_type}, leaf string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.  levels: of a bucket.

    A source's leaves stand in the order of doc_id, null first; rows of one doc_id in the order of their leaves,
    and equal rows have equal leaves, so their order makes no difference to any root, though each has a proof of
    its own.  Null fields count as '-', empty texts as '0:'; a text may be of any length, for it is hashed where it
    is read.  A null source is one of its own and comes first.  A null doc_id is not tampered with.  Other
    columns are not looked at.  An empty table gives no rows.
    """
    base = cut_lineage(leaves(docs.select(*FIELDS)))
    own = ranked(base, "doc_id", "node")
    release(base)
    tiers = climb(own, levels)
    heads = cut_lineage(tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "node"))
    crown = climb(ranked(heads, "source"), levels)
    root = crown[-1].select("node").first()
    whole = docs.sparkSession.createDataFrame([("", 0, [])], f"g string, bucket long, path {PATH}")
    paths = outer_paths(tiers, proofs_of_heads(crown, whole, levels), levels)
    found = proofs(own, paths, docs.schema["doc_id"].dataType.simpleString(), levels)
    told = found.join(heads.select(F.col("source").alias("g"), F.col("node").alias("subroot")), "g").withColumn("root", F.lit(root[0] if root else None).cast("string"))
    out = told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    release(*tiers[1:], *crown)
    return out


def proofs_of_heads(crown: list[DataFrame], whole: DataFrame, most: int) -> DataFrame:
    """(g, bucket, path): of each source's root, the siblings up to the root of all."""
    paths = outer_paths([crown[0], *crown], whole, most)
    found = crown[0].select(F.col("source").alias("g"), F.lit("").alias("one"), "pos").join(paths.select(F.col("g").alias("one"), F.col("bucket").alias("pos"), "path"), ["one", "pos"])
    out = cut_lineage(found.select("g", F.lit(0).cast("long").alias("bucket"), "path"))
    release(paths)
    return out
