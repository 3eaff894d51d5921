"""Driver queries of what compares and changes versions, and of marks on pages, over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark import engine_queries as E
from quillmark.operators import hierarchy as H
from quillmark.operators import marks as M
from quillmark.operators import versions as Ve
from quillmark.sources import annotations as S

#: Parts of a paper, and the least similarity of two of its items.
PER_PAPER, LEAST = 10, 0.5


def _versions(spark, sf_dir):
    """Two versions of papers of parts: (paper, item_id, dim, values); ids differ, a seventh has gone, some came, a third changed."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey")).withColumn("paper", F.floor(F.col("p_partkey") / PER_PAPER))
    dims = lambda size: F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in ("brand", "type", "size", "name", "key")]), F.array("p_brand", "p_type", size.cast("string"), "p_name", F.col("k").cast("string")))).alias("dim", "v")
    old = p.select("paper", F.concat(F.lit("L"), "k").alias("item_id"), dims(F.col("p_size")))
    size = F.when(F.col("k") % 3 == 0, F.col("p_size") + 1000).otherwise(F.col("p_size"))
    new = p.where("k % 7 <> 0").select("paper", F.concat(F.lit("R"), F.col("k") * 7919 % 1_000_003).alias("item_id"), dims(size))
    came = p.where("k % 11 = 0").select("paper", F.concat(F.lit("N"), "k").alias("item_id"), F.lit("key").alias("dim"), F.concat(F.lit("new "), F.col("k").cast("string")).alias("v"))
    shown = lambda df: df.select("paper", "item_id", "dim", F.array("v").alias("values"))
    return shown(old), shown(new.unionByName(came))


def _aligned(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    features = lambda df: df.select("paper", "item_id", F.concat("dim", F.lit("="), F.get("values", F.lit(0))).alias("feature"))
    return Ve.align(features(old), features(new), "paper", LEAST), old, new


def item_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir)[0]


def dimension_changes(spark, sf_dir):
    changes = Ve.dimension_changes(*_aligned(spark, sf_dir), "paper")
    return changes.select("paper", "left_id", "right_id", "dim", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


def applied_verdicts(spark, sf_dir):
    """Items of the engine's documents after a review by rule: a fifth is rejected, a fifth edited, some come."""
    items = S.items(E.documents(spark, sf_dir))
    k = F.regexp_extract("item_id", r"(\d+)$", 1).cast("long")
    key = items.select("path", "item_id", k.alias("k"))
    verdicts = key.withColumn("decision", F.when(F.col("k") % 5 == 0, "rejected").when(F.col("k") % 5 == 1, "marked_for_edit").otherwise("approved"))
    edits = key.select("path", "item_id", F.parse_json(F.lit('{"credibility":null,"label":"edited","odd":1}')).alias("changes"))
    added = key.where("k % 10 = 3").select("path", F.concat("item_id", F.lit(".new")).alias("item_id"), F.parse_json(F.lit('{"label":"added","invented":1}')).alias("item"))
    out = Ve.updated_items(items, verdicts, edits, added)
    at = lambda p: F.try_variant_get("item", p, "string")
    invented = F.size(F.filter(F.map_keys(Ve.entries(F.col("item"))), lambda x: ~Ve.is_schema_key(x)))
    return out.select("path", "item_id", at("$.label").alias("label"), F.map_contains_key(Ve.entries(F.col("item")), "credibility").alias("has_credibility"), invented.cast("long").alias("n_invented"))


def rules_as_of(spark, sf_dir):
    """Documents under rules that came, and came anew, with versions of a protocol."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("r"), "n_nationkey").alias("rule"), F.col("n_nationkey").alias("n"))
    version = lambda x: F.concat(F.lit("1."), x.cast("string"))
    rules = nation.select("rule", version(F.col("n") % 14).alias("introduced_in")).unionByName(nation.select("rule", version(F.col("n") % 14 + 3).alias("introduced_in")))
    defects = docs.select("path", F.concat(F.lit("r"), F.pmod(F.col("path"), F.lit(27)).cast("string")).alias("rule"))
    out = Ve.baseline(defects, rules, docs.select("path", version(F.pmod(F.floor(F.col("path") / 27), F.lit(19))).alias("protocol_version")))
    return out.select("path", "rule", "protocol_version", "revision", "grade")


def cyclic_closure(spark, sf_dir):
    """Closure of a graph of nations that has cycles, and the length of those, 0 where a node is on none."""
    n = F.col("n_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    edges = nation.select(n.cast("string").alias("child"), (n * 3 % 25).cast("string").alias("parent")).unionByName(nation.select(n.cast("string").alias("child"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("parent")))
    return H.closure(edges).join(H.cycles(edges), "node", "left").withColumn("length", F.coalesce("length", F.lit(0)))


#: Words of a line on a page, a word's width, a line's height, and the lowest line.
WORDS, WIDTH, HEIGHT, TOP = 8, 60.0, 14.0, 7000.0


def text_under(spark, sf_dir):
    """Conversations as documents, turns as pages, words as text runs, and a highlight of two quads on each page."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("page")).agg(F.min("text").alias("text"))
    i = F.col("pos")
    runs = talk.select("path", "page", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    runs = runs.select("path", "page", "pos", (i % WORDS * WIDTH).alias("x"), (F.lit(TOP) - F.floor(i / WORDS) * HEIGHT).alias("y"), "text")
    low = F.lit(TOP) - F.col("page") % 3 * HEIGHT
    quad = lambda x0, x1, y: [x0, y, x1, y, x0, y + 9, x1, y + 9]
    numbers = [n if not isinstance(n, float) else F.lit(n) for n in [*quad(70.0, 250.0, low), *quad(0.0, 119.0, low - HEIGHT)]]
    marks = talk.select("path", "page", F.concat("path", F.lit("#"), "page").alias("mark_ref"), F.lit("Highlight").alias("type"), F.array(*numbers).alias("quads"))
    return M.text_under(marks, runs).select("path", "page", "highlighted_text")


def range_join_2d(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.pmod("l_suppkey", F.lit(25)).alias("page"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    s = F.col("s_acctbal")
    boxes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.pmod("s_suppkey", F.lit(25)).alias("page"), "s_suppkey", (s * 5).alias("x0"), (s * 5 + 400).alias("x1"), F.pmod("s_suppkey", F.lit(40)).cast("double").alias("y0"), (F.pmod("s_suppkey", F.lit(40)) + 5).cast("double").alias("y1"))
    return M.range_join(lines, boxes, ["page"], "x", "y", slack=(2, 1)).select("l_orderkey", "l_linenumber", "s_suppkey")


_VERSIONS = f"""
    WITH p AS (SELECT p_partkey AS k, p_partkey // {PER_PAPER} AS paper, p_size FROM part),
    pairs AS (
        SELECT paper, 'L' || k AS left_id, CASE WHEN k % 7 <> 0 THEN 'R' || (k * 7919 % 1000003) END AS right_id, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 4 / 6 ELSE 1.0::DOUBLE END AS similarity,
            CASE WHEN k % 7 = 0 THEN 'removed' ELSE 'matched' END AS state FROM p
        UNION ALL SELECT paper, NULL, 'N' || k, NULL, 'added' FROM p WHERE k % 11 = 0
    )"""
_LINE = f"{TOP} - page % 3 * {HEIGHT}"

QUERIES = {f.__name__: f for f in (item_alignment, dimension_changes, applied_verdicts, rules_as_of, cyclic_closure, text_under, range_join_2d)}
ORACLES = {
    "item_alignment": f"{_VERSIONS} SELECT * FROM pairs",
    "dimension_changes": f"{_VERSIONS} SELECT paper, 'L' || k AS left_id, 'R' || (k * 7919 % 1000003) AS right_id, 'size' AS dim, p_size::VARCHAR AS old, (p_size + 1000)::VARCHAR AS \"new\" FROM p WHERE k % 7 <> 0 AND k % 3 = 0",
    "applied_verdicts": f"""
        WITH items AS (SELECT p_partkey AS k, 'part-' || (p_partkey // {E.PER_DOCUMENT}) AS path, (p_partkey // {E.PER_DOCUMENT}) % 4 = 0 AS sound FROM part)
        SELECT path, 'GE.' || k AS item_id, CASE WHEN k % 5 = 1 THEN 'edited' END AS label, k % 5 <> 1 AND ({E._case("credibility", lambda v: str(v is not None).lower())}) AS has_credibility, 0::BIGINT AS n_invented FROM items WHERE k % 5 <> 0
        UNION ALL SELECT path, 'GE.' || k || '.new', 'added', false, 0 FROM items WHERE k % 10 = 3""",
    "rules_as_of": """
        WITH d AS (SELECT doc_id AS path, doc_id % 27 AS r, doc_id // 27 % 19 AS v FROM documents),
        m AS (SELECT path, r, v, CASE WHEN r < 25 THEN r % 14 END AS a FROM d)
        SELECT path, 'r' || r AS rule, '1.' || v AS protocol_version, CASE WHEN v >= a + 3 THEN '1.' || (a + 3) WHEN v >= a THEN '1.' || a END AS revision, CASE WHEN v < a THEN 'note' ELSE 'defect' END AS grade FROM m""",
    "cyclic_closure": """
        WITH RECURSIVE e AS (SELECT n_nationkey::VARCHAR AS child, (n_nationkey * 3 % 25)::VARCHAR AS parent FROM nation UNION SELECT n_nationkey::VARCHAR, 'g' || n_regionkey FROM nation),
        up(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT u.node, e.parent, u.depth + 1 FROM up u JOIN e ON u.ancestor = e.child WHERE u.depth < 30),
        reach AS (SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY node, ancestor),
        own AS (SELECT child AS node FROM e UNION SELECT parent FROM e)
        SELECT a.node, a.ancestor, a.depth::INT AS depth, coalesce(c.depth, 0)::INT AS length FROM (SELECT * FROM reach WHERE node <> ancestor UNION ALL SELECT node, node, 0 FROM own) a LEFT JOIN reach c ON c.node = a.node AND c.ancestor = a.node""",
    "text_under": f"""
        WITH talk AS (SELECT conv_id::VARCHAR AS path, turn AS page, min(text) AS text FROM conversations GROUP BY conv_id, turn),
        cut AS (SELECT path, page, string_split(text, ' ') AS w FROM talk),
        runs AS (SELECT path, page, i - 1 AS pos, (i - 1) % {WORDS} * {WIDTH} AS x, {TOP} - (i - 1) // {WORDS} * {HEIGHT} AS y, w[i] AS t FROM cut, unnest(range(1, len(w) + 1)) r(i)),
        hit AS (SELECT * FROM runs WHERE trim(t) <> '' AND ((x BETWEEN 69 AND 251 AND y BETWEEN {_LINE} - 4 AND {_LINE} + 13) OR (x BETWEEN -1 AND 120 AND y BETWEEN {_LINE} - {HEIGHT} - 4 AND {_LINE} - {HEIGHT} + 13)))
        SELECT path, page, coalesce(trim(regexp_replace(string_agg(t, ' ' ORDER BY pos), '\\s+', ' ', 'g')), '') AS highlighted_text FROM talk LEFT JOIN hit USING (path, page) GROUP BY path, page""",
    "range_join_2d": """
        SELECT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON l_suppkey % 25 = s_suppkey % 25 AND l_extendedprice BETWEEN s_acctbal * 5 - 2 AND s_acctbal * 5 + 402 AND l_quantity BETWEEN s_suppkey % 40 - 1 AND s_suppkey % 40 + 6""",
}
