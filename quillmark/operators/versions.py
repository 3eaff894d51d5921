"""Versions of a paper's annotation: items matched, their changes, verdicts applied, rules by protocol version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import collapse
from quillmark.functions.values import kind
from quillmark.operators.lineage import settle, tasks_for
from quillmark.plans.rules import known_keys

OBJECT = "map<string,variant>"


def item_features(dims: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, item_id, feature): an item's values by dimension, its label's words, and its phrases."""
    given = dims.where("dim NOT IN ('id', 'label', 'assertions', 'flags')").select("path", "item_id", "dim", F.explode("values").alias("v"))
    given = given.select("path", "item_id", F.concat("dim", F.lit("="), "v").alias("feature"))
    words = F.split(F.lower(collapse(F.array_join("values", " "))), " ")
    label = dims.where("dim = 'label'").select("path", "item_id", F.explode(words).alias("v")).select("path", "item_id", F.concat(F.lit("label:"), "v").alias("feature"))
    phrase = claims.where("phrase IS NOT NULL").select("path", "item_id", F.concat(F.lit("phrase:"), F.lower(collapse(F.col("phrase")))).alias("feature"))
    return given.unionByName(label).unionByName(phrase).distinct()


def align(left: DataFrame, right: DataFrame, on: str, least: float = 0.3) -> DataFrame:
    """(on, left_id, right_id, similarity, state): items of one paper's versions, matched one to one; their ids don't count.

    left and right: (on, item_id, feature), on naming the paper.  Similarity is Jaccard over features; pairs of at least
    `least` are taken from the most alike on, ties by left, then right id, each item once.  What is matched is
    found in rounds: pairs that are the best of both their items, until none is left, which is the same.  An item
    that is in none is removed (left) or added (right); repeated features count once.
    """
    spark, key = left.sparkSession, lambda side: [on, side]
    sides = {name: settle(df.select(on, F.col("item_id").alias(name), "feature")) for df, name in ((left, "left_id"), (right, "right_id"))}
    tasks = tasks_for(spark, max(df.count() for df in sides.values()))

    def counted(name: str) -> DataFrame:
        once = sides[name].repartition(tasks, *key(name)).distinct()
        return once.withColumn(f"n_{name}", F.count("*").over(Window.partitionBy(*key(name)))).repartition(tasks, on, "feature")

    # Nothing is broadcast: what Spark takes a table of exploded rows for is far below its size.
    met = counted("left_id").join(counted("right_id").hint("merge"), [on, "feature"])
    many = tasks_for(spark, _meetings(*sides.values(), [on, "feature"]))
    common = met.repartition(many, *key("left_id")).groupBy(on, "left_id", "right_id").agg(F.count("*").alias("c"), F.first("n_left_id").alias("n"), F.first("n_right_id").alias("m"))
    scored = common.withColumn("similarity", F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).where(F.col("similarity") >= least)
    open_pairs = settle(scored.select(on, "left_id", "right_id", "similarity"))
    order = [F.desc("similarity"), "left_id", "right_id"]
    matched = []
    while n := open_pairs.count():
        dealt = lambda df, side, n=n: df.repartition(tasks_for(spark, n), *key(side))
        place = lambda side: F.row_number().over(Window.partitionBy(*key(side)).orderBy(*order))
        firsts = dealt(open_pairs, "left_id").withColumn("_l", place("left_id"))
        firsts = dealt(firsts, "right_id").withColumn("_r", place("right_id"))
        best = settle(firsts.where("_l = 1 AND _r = 1").drop("_l", "_r"))
        matched.append(best)
        left_over = open_pairs
        for side in ("left_id", "right_id"):
            left_over = dealt(left_over, side).join(dealt(best.select(*key(side)), side).hint("merge"), key(side), "left_anti")
        open_pairs = settle(left_over)
    pairs = open_pairs
    for m in matched:
        pairs = pairs.unionByName(m)
    out = pairs.withColumn("state", F.lit("matched"))
    for side, state in (("left_id", "removed"), ("right_id", "added")):
        own = sides[side].select(*key(side)).repartition(tasks, *key(side)).distinct()
        alone = own.join(pairs.select(*key(side)).repartition(tasks, *key(side)).hint("merge"), key(side), "left_anti")
        out = out.unionByName(alone.withColumn("state", F.lit(state)), allowMissingColumns=True)
    return out


#: One of so many keys is looked at to foretell a join's rows.
LOOK = 64


def _meetings(a: DataFrame, b: DataFrame, key: list[str]) -> int:
    """About how many rows a join will make, told from a part of its keys; only the number of tasks hangs on it."""
    some = lambda df: df.where(F.pmod(F.xxhash64(*key), F.lit(LOOK)) == 0).groupBy(*key).agg(F.count("*").alias("n"))
    return LOOK * (some(a).join(some(b).withColumnRenamed("n", "m"), key).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)


def dimension_changes(pairs: DataFrame, left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(on, left_id, right_id, dim, old, new) of matched items' dimensions that differ; left and right: (on, item_id, dim, values).

    Values count as sets; a dimension that one side has not is null there.
    """
    matched = pairs.where("state = 'matched'").select(on, "left_id", "right_id")
    tasks, key = tasks_for(pairs.sparkSession, max(left.count(), right.count())), [on, "left_id", "right_id", "dim"]

    def side(df: DataFrame, name: str, value: str) -> DataFrame:
        own = df.select(on, F.col("item_id").alias(name), "dim", F.array_sort(F.array_distinct("values")).alias(value))
        return matched.repartition(tasks, on, name).join(own.repartition(tasks, on, name).hint("merge"), [on, name]).repartition(tasks, *key)

    met = side(left, "left_id", "old").join(side(right, "right_id", "new").hint("merge"), key, "full")
    return met.where("old IS DISTINCT FROM new").select(on, "left_id", "right_id", "dim", "old", "new")


def entries(v: Column) -> Column:
    """A variant object as a map; anything else as the empty one."""
    return F.coalesce(F.try_variant_get(v, "$", OBJECT), F.create_map().cast(OBJECT))


def edited(item: Column, changes: Column) -> Column:
    """A variant object with the keys of changes, another one, set to their values; keys set to null go."""
    own, more = entries(item), entries(changes)
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(more, k))
    return F.to_variant_object(F.map_concat(kept, F.map_filter(more, lambda _, v: kind(v) != "VOID")))


def is_schema_key(key: Column) -> Column:
    """Whether a list names a key, or it is a flag's or a reviewer's, which are free."""
    return key.isin(*sorted(known_keys())) | key.startswith("ai_") | key.startswith("reviewer_")


def without_invented_keys(item: Column) -> Column:
    return F.to_variant_object(F.map_filter(entries(item), lambda k, _: is_schema_key(k)))


def updated_items(items: DataFrame, verdicts: DataFrame, edits: DataFrame, added: DataFrame) -> DataFrame:
    """(path, idx, item_id, item) after a review: rejected items go, marked ones are edited, accepted additions come last.

    edits: (path, item_id, changes variant); those of items that no verdict marks are left aside, several of one item are
    applied as one, later keys by their text winning.  added: (path, item_id, item).  Keys that no list names are
    taken out of every item; stripped_keys() tells which.
    """
    key = ["path", "item_id"]
    of = lambda d: verdicts.where(F.col("decision") == d).select(*key).distinct()
    marked = edits.join(of("marked_for_edit"), key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(F.to_json("changes"))).alias("_c"))
    kept = items.join(of("rejected"), key, "left_anti").join(marked, key, "left")
    whole = F.aggregate(F.transform("_c", F.parse_json), F.parse_json(F.lit("{}")), lambda acc, c: F.to_variant_object(F.map_concat(F.map_filter(entries(acc), lambda k, _: ~F.map_contains_key(entries(c), k)), entries(c))))
    changed = kept.select("path", "idx", "item_id", F.when(F.col("_c").isNull(), F.col("item")).otherwise(edited(F.col("item"), whole)).alias("item"))
    # Additions stand after all items that a document has.
    new = added.join(of("rejected"), key, "left_anti").select("path", F.lit(1 << 30).alias("idx"), "item_id", "item")
    return changed.unionByName(new).withColumn("item", without_invented_keys(F.col("item")))


def stripped_keys(items: DataFrame) -> DataFrame:
    """(path, item_id, dim, raw) of keys that updated_items takes out: gaps to be recorded as candidate extensions."""
    found = items.select("path", "item_id", F.explode(F.map_entries(entries(F.col("item")))).alias("e"))
    return found.where(~is_schema_key(F.col("e.key"))).select("path", "item_id", F.col("e.key").alias("dim"), F.col("e.value").alias("raw"))


def updated_documents(documents: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """(path, doc) with the items as evidence, in their order, and the review (path, log, date, summary) entered in provenance.

    A document without a review is left out; one whose items have all gone has an empty list.
    """
    listed = items.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "item_id", F.to_json("item").alias("j")))).alias("_i"))
    evidence = F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("_i", F.array().cast("array<struct<idx:int,item_id:string,j:string>>")), lambda i: i["j"]), ","), F.lit("]")))
    stamp = F.create_map(F.lit("review_applied"), F.to_variant_object(F.struct("log", "date", "summary")))
    provenance = edited(F.try_variant_get("doc", "$.provenance", "variant"), F.to_variant_object(stamp))
    changes = F.to_variant_object(F.create_map(F.lit("evidence"), evidence, F.lit("provenance"), provenance))
    met = documents.join(reviews.select("path", "log", "date", "summary"), "path").join(listed, "path", "left")
    return met.select("path", edited(F.col("doc"), changes).alias("doc"))


#: Numbers of a version that count.
PARTS = 8


def version_key(version: Column) -> Column:
    """A version as numbers to be compared: 1.9 before 1.10, 1 like 1.0; what is no number counts as 0; null for null."""
    numbers = F.transform(F.split(F.regexp_replace(F.trim(version), "^[vV]", ""), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d{1,9})", 1).try_cast("int"), F.lit(0)))
    return F.when(version.isNotNull(), F.slice(F.concat(numbers, F.array_repeat(F.lit(0), PARTS)), 1, PARTS))


def baseline(defects: DataFrame, rules: DataFrame, versions: DataFrame) -> DataFrame:
    """defects with revision, the rule's latest one that isn't newer than the document's protocol, and grade.

    rules: (rule, introduced_in), a row a revision; versions: (path, protocol_version).  Defects of a rule that is
    newer than the document's protocol in all its revisions are notes.  A rule that the table has not, and a document
    without a version, leave a defect.
    """
    revision = F.struct(version_key(F.col("introduced_in")).alias("key"), F.col("introduced_in").alias("revision"))
    # A rule has a handful of revisions.
    known = rules.where("introduced_in IS NOT NULL").groupBy("rule").agg(F.sort_array(F.collect_set(revision)).alias("_all"))
    met = defects.join(known, "rule", "left").join(versions, "path", "left").withColumn("_key", version_key(F.col("protocol_version")))
    fit = F.filter("_all", lambda r: r["key"] <= F.col("_key"))
    out = met.withColumn("revision", F.try_element_at(fit, F.lit(-1))["revision"])
    newer = F.col("_all").isNotNull() & F.col("_key").isNotNull() & F.col("revision").isNull()
    return out.withColumn("grade", F.when(newer, "note").otherwise("defect")).drop("_all", "_key")
