"""Driver queries of the annotation engine: each runs an operator of it over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import engine_queries as E
from quillmark import version_queries as W
from quillmark.functions import text as X
from quillmark.functions import values as V
from quillmark.operators import constraints as C
from quillmark.operators import coverage as Cov
from quillmark.operators import hierarchy as H
from quillmark.operators import marks as M
from quillmark.operators import review as R
from quillmark.operators import triples as Tr

QUERIES: dict = E.QUERIES | W.QUERIES
ORACLES: dict[str, str] = E.ORACLES | W.ORACLES


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    SELECT 0 AS ord, 'quality' AS dimension, count(quality) AS populated, count(*) AS applicable FROM documents d LEFT JOIN labels l USING (doc_id)
    UNION ALL SELECT 1, 'toxic of English', count(toxic), count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en'
    UNION ALL SELECT 2, 'text', sum(CASE WHEN text <> '' THEN 1 ELSE 0 END)::BIGINT, count(*) FROM documents d LEFT JOIN labels l USING (doc_id)
    """
)
def coverage(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [("quality", F.lit(True), F.col("quality").isNotNull()), ("toxic of English", F.col("lang") == "en", F.col("toxic").isNotNull()), ("text", F.lit(True), F.col("text") != "")]
    return Cov.coverage(rows, rules)


@query(
    """
    SELECT n_nationkey, count(DISTINCT s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
    GROUP BY n_nationkey HAVING count(DISTINCT s_suppkey) < 5
    """
)
def min_count(spark, sf_dir):
    focus = _t(spark, sf_dir, "nation").select("n_nationkey")
    values = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return C.cardinality(focus, values, ["n_nationkey"], "s_suppkey", least=5)


@query("SELECT conv_id, count(DISTINCT turn) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING count(DISTINCT turn) > 1")
def max_count(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").where("role = 'user'")
    return C.cardinality(turns.select("conv_id").distinct(), turns, ["conv_id"], "turn", most=1)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def not_exists(spark, sf_dir):
    active = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    present = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.requires(active, present, ["o_orderkey"])


@query(
    """
    SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') a
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    """
)
def union_not_exists(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    active = C.bag_union(o.where("o_orderstatus = 'F'").select("o_orderkey"), o.where("o_orderpriority = '1-URGENT'").select("o_orderkey"))
    present = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.requires(active, present, ["o_orderkey"])


@query(
    """
    SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05)
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)
    """
)
def conjunction(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount", "l_quantity")
    active = C.all_of(o, lines.where("l_discount > 0.05"), on=["o_orderkey"])
    return C.requires(active, lines.where("l_quantity > 25"), ["o_orderkey"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_orderpriority")
def enum_violation(spark, sf_dir):
    members = spark.createDataFrame([("priority", p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")], "dim string, o_orderpriority string")
    bad = C.not_member(_t(spark, sf_dir, "orders").select(F.lit("priority").alias("dim"), "o_orderpriority"), members, ["dim", "o_orderpriority"])
    return C.count_table(bad, ["o_orderpriority"])


@query(
    """
    WITH s AS (SELECT item_id, text AS phrase FROM benchmark), d AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
    SELECT item_id, bool_or(contains(t, lower(trim(regexp_replace(phrase, '\\s+', ' ', 'g'))))) AS anchored FROM s, d GROUP BY item_id
    """
)
def phrase_anchor(spark, sf_dir):
    # Every document is a page of the same source.
    spans = _t(spark, sf_dir, "benchmark").select(F.lit(0).alias("page"), "item_id", F.col("text").alias("phrase"))
    pages = _t(spark, sf_dir, "documents").select(F.lit(0).alias("page"), "text")
    return R.phrase_anchors(spans, pages, ["page"]).select("item_id", "anchored")


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\n\\t\\r\\f\\v]+'))::BIGINT AS n_words FROM documents WHERE len(regexp_extract_all(text, '[^ \\n\\t\\r\\f\\v]+')) >= 15")
def word_cap(spark, sf_dir):
    return R.long_spans(_t(spark, sf_dir, "documents"), "text").select("doc_id", "n_words")


@query(
    """
    WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'ROOT' FROM region),
    up(node, ancestor, depth) AS (SELECT node, node, 0 FROM (SELECT child AS node FROM e UNION SELECT parent FROM e) UNION ALL SELECT u.node, e.parent, u.depth + 1 FROM up u JOIN e ON u.ancestor = e.child)
    SELECT node, ancestor, min(depth)::INT AS depth FROM up GROUP BY node, ancestor
    """
)
def closure(spark, sf_dir):
    return H.closure(_place_edges(spark, sf_dir))


def _place_edges(spark, sf_dir):
    region = _t(spark, sf_dir, "region")
    nations = _t(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return nations.unionByName(region.select(F.col("r_name").alias("child"), F.lit("ROOT").alias("parent")))


@query(
    """
    WITH c AS (SELECT n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT a AS ancestor, count(*) AS n FROM (SELECT n_name AS a FROM c UNION ALL SELECT r_name FROM c UNION ALL SELECT 'ROOT' FROM c) GROUP BY a
    """
)
def rollup(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    rows = _t(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return H.roll_up(rows, "n_name", H.closure(_place_edges(spark, sf_dir))).groupBy("ancestor").agg(F.sum("n").alias("n"))


@query(
    """
    SELECT 'supplier_' || s_suppkey AS s, 'name' AS p, s_name AS o FROM supplier WHERE s_name IS NOT NULL
    UNION ALL SELECT 'supplier_' || s_suppkey, 'nation', s_nationkey::VARCHAR FROM supplier WHERE s_nationkey IS NOT NULL
    UNION ALL SELECT 'supplier_' || s_suppkey, 'key', s_suppkey::VARCHAR FROM supplier
    """
)
def triples(spark, sf_dir):
    return Tr.unpivot(_t(spark, sf_dir, "supplier"), F.concat(F.lit("supplier_"), "s_suppkey"), {"s_name": "name", "s_nationkey": "nation", "s_suppkey": "key"})


@query("SELECT CASE trim(event_type) WHEN 'click' THEN 'CLICKED' WHEN 'view' THEN 'VIEWED' ELSE trim(event_type) END AS value, count(*) AS n FROM events GROUP BY 1")
def synonym(spark, sf_dir):
    return C.count_table(_t(spark, sf_dir, "events").select(V.fold(F.col("event_type"), {"click": "CLICKED", "view": "VIEWED"}).alias("value")), ["value"])


@query("SELECT event_type, count(DISTINCT user_id) AS papers FROM events GROUP BY event_type HAVING count(DISTINCT user_id) >= 2")
def promotion(spark, sf_dir):
    return R.promotable(_t(spark, sf_dir, "events"), "event_type", "user_id")


@query("SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def json_dims(spark, sf_dir):
    raw = _t(spark, sf_dir, "events").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant").alias("raw")).withColumn("kind", V.kind(F.col("raw")))
    return C.count_table(raw.select(F.explode(V.raw_values(F.col("raw"), F.col("kind"))).alias("value")), ["value"])


@query("SELECT p_partkey, regexp_matches(p_type, '^[A-Za-z_][A-Za-z0-9_]*$') AS is_token FROM part")
def token_test(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", V.is_token(F.col("p_type")).alias("is_token"))


@query("SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def set_dedupe(spark, sf_dir):
    return R.normalised_equal(_t(spark, sf_dir, "documents"), "text")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'VERY_HIGH' WHEN c_acctbal >= 5000 THEN 'HIGH' WHEN c_acctbal >= 2500 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM customer")
def ordinal(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", C.tier(F.col("c_acctbal"), (7500, "VERY_HIGH"), (5000, "HIGH"), (2500, "MEDIUM"), otherwise="LOW").alias("tier"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 4 AND s_acctbal + 4")
def range_join(spark, sf_dir):
    points = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), "c_custkey", "c_acctbal")
    boxes = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), "s_suppkey", F.col("s_acctbal").alias("x0"), F.col("s_acctbal").alias("x1"))
    return M.range_join(points, boxes, ["page"], "c_acctbal", slack=(4, 0)).select("c_custkey", "s_suppkey")


@query("SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND coalesce(trim(CASE WHEN n_chars >= 200 THEN text END), '') = '')")
def noise_filter(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("body", F.when(F.col("n_chars") >= 200, F.col("text")))
    return M.drop_noise(docs, "lang", "en", "body").select("doc_id")


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def ws_collapse(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("digest"))


@query(
    """
    SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
    FROM orders GROUP BY o_orderpriority
    """
)
def verdict_tally(spark, sf_dir):
    return R.tally(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query(
    """
    WITH a AS (SELECT p_partkey, p_brand, p_size FROM part), b AS (SELECT p_partkey, p_brand, p_size - p_size % 2 AS p_size FROM part)
    SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    """
)
def version_diff(spark, sf_dir):
    a = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return R.version_diff(a, a.withColumn("p_size", (F.col("p_size") - F.col("p_size") % 2).cast("int")))


@query("SELECT conv_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn, text), '\\s+', ' ', 'g')) AS joined FROM conversations GROUP BY conv_id")
def joined_text(spark, sf_dir):
    return M.joined_text(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query('SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS "of" FROM orders')
def numbered(spark, sf_dir):
    return M.numbered(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "n", "of")


@query(
    """
    SELECT event_id, coalesce(nullif(json_extract_string(props, '$.note'), ''), nullif(event_type, ''), '') AS note FROM events
    """
)
def aliases(spark, sf_dir):
    note = F.try_variant_get(F.try_parse_json("props"), "$.note", "string")
    return _t(spark, sf_dir, "events").select("event_id", X.first_text(note, F.col("event_type")).alias("note"))


@query(
    """
    SELECT l_orderkey, l_linenumber, (least(l_quantity, l_linenumber) * 100)::BIGINT AS x0, (greatest(l_quantity, l_linenumber) * 100)::BIGINT AS x1 FROM lineitem
    """
)
def bounding_boxes(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.bounding_box(F.array(q, F.lit(0.0), n, F.lit(1.0))).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("b.x0") * 100).cast("long").alias("x0"), (F.col("b.x1") * 100).cast("long").alias("x1"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k') IN ('true', 'True'), false) AS flag FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def boolean_coercion(spark, sf_dir):
    raw = _t(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "variant").alias("raw"))
    return raw.select("event_id", V.as_boolean(F.col("raw")).alias("flag")).where("flag IS NOT NULL")


@query("SELECT s_suppkey AS k, 'right' AS missing_in FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT p_partkey, 'left' FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def unmatched(spark, sf_dir):
    a = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return R.unmatched(a, _t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("k")), ["k"])


@query("SELECT source, list_sort(list(DISTINCT lang))::VARCHAR AS langs FROM documents GROUP BY source")
def multi_scale(spark, sf_dir):
    found = R.scales(_t(spark, sf_dir, "documents"), "source", "lang")
    return found.select("source", F.concat(F.lit("["), F.array_join("scales", ", "), F.lit("]")).alias("langs"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def grouped_counts(spark, sf_dir):
    return R.by_key(_t(spark, sf_dir, "documents"), "lang")


@query("SELECT count(*) FILTER (text LIKE '%. %') AS n, count(*) AS \"of\" FROM documents")
def anchored_share(spark, sf_dir):
    return R.share(_t(spark, sf_dir, "documents"), F.col("text").contains(". "))


_ENDS = ['', '"', '""', '\\"', '\\\\"', '"""', '""""', '\\']


@query(
    f"""
    WITH texts AS (SELECT item_id, ending, text || CASE ending {" ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDS))} END AS t FROM benchmark, range({len(_ENDS)}) r(ending)),
    escaped AS (SELECT item_id, ending, replace(replace(t, '\\', '\\\\'), '\"\"\"', '\\"\\"\\"') AS t FROM texts)
    SELECT item_id, ending, CASE WHEN t LIKE '%"' AND (length(t) - 1 - length(rtrim(t[:-2], '\\'))) % 2 = 0 THEN t[:-2] || '\\"' ELSE t END AS literal FROM escaped
    """
)
def turtle_escape(spark, sf_dir):
    """Each text with each of the endings that a literal must not close on."""
    ends = F.posexplode(F.array(*[F.lit(e) for e in _ENDS])).alias("ending", "e")
    texts = _t(spark, sf_dir, "benchmark").select("item_id", "text", ends)
    return texts.select("item_id", F.col("ending").cast("long").alias("ending"), X.escape(F.concat("text", "e")).alias("literal"))


@query("SELECT translate(p_brand || '.' || p_size, '.-', '__') AS node, count(*) AS n FROM part GROUP BY 1")
def node_names(spark, sf_dir):
    return C.count_table(_t(spark, sf_dir, "part").select(X.node_name(F.concat_ws(".", "p_brand", "p_size")).alias("node")), ["node"])
