"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.  DataFrame operations only.

Shingles are rows, not arrays: Spark compiles what runs over exploded rows and interprets what runs in the
lambda of an array function, at some ten times the cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, release
from .components import components

#: Characters of a shingle; a shorter line is one shingle.
WIDTH = 8
THRESHOLD = 0.8
#: Bands and their MinHashes.  Shingles are dealt to BINS by hash, and each bin has its share of the bands, so a
#: shingle enters only that share's MinHashes.
BANDS, ROWS, BINS = 10, 4, 5
#: Bits of a MinHash.
HASH_BITS = 24
#: Slots of the filter that picks rows before a join: at most so many numbers are broadcast.
SLOTS = 1 << 20
#: Lines of a bucket on either side of a tile, and 64-bit words of a sketch (a power of two).
TILE, WORDS = 512, 32
#: Pairs that share a copy of a text in the exact check, and shingles of a task there, about.
SHARED, TASK_SHINGLES = 256, 500_000
MOST_TASKS = 20_000
#: Sketches are made in so many times the tasks, as a group costs a third less in a map that fits a core's cache.  The few
#: rows that come of it go on to the tasks' number, as opening a small file costs more than moving its rows.
PARTS = 5
#: Pairs left apart to a line from which on the nearest ones are checked before the others.
MANY = 2


def _mix(n: int) -> int:
    """A 64-bit number as random as a fixed rule makes it, signed (splitmix64)."""
    x = (n * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def norm(line: Column) -> Column:
    """What of a line counts: white space at its ends doesn't."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def shingles(df: DataFrame, width: int = WIDTH, line: str = "line", name: str = "h") -> DataFrame:
    """A row for every stretch of width characters of line, or for a shorter line: df's other columns and its hash.

    Stretches are cut from UTF-16 units, where a cut takes the same time at any place of a long line.
    """
    others = [c for c in df.columns if c != line]
    units = df.select(*others, F.encode(line, "UTF-16BE").alias("_u"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("_u") - (2 * width - 1)), F.lit(2))
    cut = units.select(*others, "_u", F.explode(starts).alias("_i"))
    return cut.select(*others, F.xxhash64(F.substring(F.col("_u"), F.col("_i"), F.lit(2 * width))).alias(name))


def band_keys(df: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, bins: int = BINS) -> DataFrame:
    """(lid, key) of df's lid and line: one key a band, without those of bins that none of the line's shingles is in.

    A band is rows MinHashes of the shingles of its bin, each with an order of its own: the shingle's hash
    times an odd number of its own, of which the middle bits count.  A bin's shingles are a sample of the
    line's, so bands agree as often as they would over all shingles.  Where df is dealt by lid, as
    distinct_lines() is, nothing is shuffled here.
    """
    x = shingles(df.select("lid", "line"), width)
    x = x.select(
        "lid",
        F.shiftright(F.shiftrightunsigned("h", 48) * F.lit(bins), 16).alias("bin"),
        F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).alias("x"),
    )

    def minhash(k: int) -> Column:
        # 32 by 31 bits: the product never overflows.
        odd = (_mix(2000 + k) & (1 << 30) - 1) << 1 | 1
        return F.min(F.shiftright(F.col("x") * F.lit(odd), 16).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    own = -(-bands // bins)
    signed = x.groupBy("lid", "bin").agg(*[minhash(k).alias(f"m{k}") for k in range(own * rows)])
    keys = [F.xxhash64("bin", F.lit(b), *[f"m{b * rows + r}" for r in range(rows)]) for b in range(own)]
    return signed.select("lid", F.explode(F.array(*keys)).alias("key"))


def lines(docs: DataFrame) -> DataFrame:
    """docs' columns but text, and pos, line, lid, check: lines with a word, by \\n; lid and check are hashes of what counts of them."""
    others = [c for c in docs.columns if c != "text"]
    split = docs.select(*others, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    split = split.select(*others, "pos", norm(F.col("line")).alias("line")).where(F.col("line") != "")
    return split.withColumns({"lid": F.xxhash64("line"), "check": F.xxhash64(F.lit(1), "line")})


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(lid, line) of docs' lines, each once and dealt by lid.

    Of a line's copies one is kept in each task before the shuffle: all have the same text.  A line's shingles are
    then all in one task, so what is found over them needs no shuffle of its own.
    """
    return lines(docs.select("doc_id", "text")).groupBy("lid").agg(F.max("line").alias("line"))


def buckets(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, lid, n, centre) of the lines that share a band's bucket: its number of lines, and one line of it.

    The centre is the line whose buckets have the most lines together, for a line that many others were made
    from shares more buckets than any of those.  Buckets are counted before the shuffle, and the joins may
    split a hot one.
    """
    keyed = cut_lineage(band_keys(distinct_lines(docs), width, bands, rows))
    counts = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # Most keys are of one line: hashing the few others spares sorting them all.
    met = cut_lineage(keyed.join(counts.hint("shuffle_hash"), "key"))
    release(keyed, counts)
    shared = met.groupBy("lid").agg(F.sum("n").alias("shared"))
    best = met.join(shared, "lid").groupBy("key").agg(F.max(F.struct("shared", "lid")).alias("best"))
    # Written first, as counts are: a join may split a hot key only where neither side is still being added up.
    best = cut_lineage(best.select("key", F.col("best.lid").alias("centre")))
    out = cut_lineage(met.join(best, "key"))
    release(met, best)
    return out


def with_sketch(hashes: DataFrame) -> DataFrame:
    """(lid, size, w0, w1, ...) of rows (lid, h): distinct hashes, and of each bit the parity of those that fall on it.

    Two sets' words differ in at most as many bits as the sets do in hashes.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    by_word = hashes.select("lid", "h").distinct().groupBy("lid", word.alias("word")).agg(F.count("*").alias("n"), F.bit_xor(bit).alias("w"))
    words = [F.bit_xor(F.when(F.col("word") == k, F.col("w")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    return by_word.groupBy("lid").agg(F.sum("n").cast("int").alias("size"), *words)


def near_enough(threshold: float) -> Column:
    """Whether two sketches, the second's columns with an underscore before, leave room for the threshold."""
    most = (F.col("size") + F.col("_size")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.abs(F.col("size") - F.col("_size")) <= most) & (apart() <= most)


def never_null(df: DataFrame) -> DataFrame:
    """df with its numbers marked as never null, which they aren't: what compares them compiles to a third of the code."""
    return df.select(*[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in df.dtypes])


def apart() -> Column:
    """Bits that two sketches differ in."""
    return sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"_w{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col("_w0"))))


def centre_pairs(met: DataFrame, sketches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (a, b) of each line of a bucket with the bucket's centre, where they may reach the threshold.

    These are fewer pairs than lines.  What is left out differs in too many hashes by size or by sketch,
    which is exact.
    """
    sketches = never_null(sketches)
    pairs = met.where("lid <> centre").select("lid", F.col("centre").alias("_lid")).distinct().join(sketches, "lid")
    pairs = pairs.join(sketches.toDF(*[f"_{c}" for c in sketches.columns]), "_lid").where(near_enough(threshold))
    return pairs.select(F.least("lid", "_lid").alias("a"), F.greatest("lid", "_lid").alias("b")).distinct()


def rest_pairs(met: DataFrame, roots: DataFrame, sketches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (a, b, apart) of a bucket's lines that no link joins yet and that may reach the threshold.

    Lines of one component need no further link, and the centre has met all.  All other pairs of a bucket
    are met, in tiles of some TILE lines a side; what is left out of them differs in too many hashes by size
    or by sketch, which is exact.  apart is the number of bits that their sketches differ in.
    """
    inner = met.where("n > 2 and lid <> centre").select("key", "lid")
    inner = cut_lineage(inner.join(roots, "lid", "left").withColumn("root", F.coalesce("root", "lid")))
    parted = inner.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).where("r0 < r1")
    parted = cut_lineage(parted.select("key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")))
    left = inner.join(parted, "key")
    left = left.join(sketches, "lid")
    left = left.withColumn("t", F.pmod(F.xxhash64(F.lit(5), "lid"), F.col("tiles")).cast("int"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.select("key", F.least("t", "j").alias("p"), F.greatest("t", "j").alias("q"), "t", "lid", "root", "size", *[f"w{k}" for k in range(WORDS)])
    written = cut_lineage(left)
    left = never_null(written)
    on = ["key", "p", "q"]
    other = left.select(*on, *[F.col(c).alias(f"_{c}") for c in left.columns if c not in on])
    near = left.join(other.hint("merge"), on).where(F.expr("lid < _lid and root <> _root and (p = q or t <> _t)") & near_enough(threshold))
    out = cut_lineage(near.select(F.col("lid").alias("a"), F.col("_lid").alias("b"), apart().alias("apart")).distinct())
    release(inner, parted, written)
    return out


def next_centres(met: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """(lid, centre) of rows of a key and one of them, chosen by hash, that no link joins to them yet."""
    own = met.select("key", "lid").join(roots.withColumnRenamed("node", "lid"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    own = cut_lineage(own)
    parted = own.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.struct(F.xxhash64(F.lit(seed), "lid").alias("h"), "lid", "root")).alias("c")).where("r0 < r1")
    # Written, as everywhere, so that the join may split a hot key.
    parted = cut_lineage(parted.select("key", F.col("c.lid").alias("centre"), F.col("c.root").alias("_root")))
    return own.join(parted, "key").where("root <> _root").select("lid", "centre")


def still_apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those (a, b, ...) of pairs whose ends the edges don't join."""
    roots = components(edges)
    ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def slot_filter(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose key may be among wanted's: at most SLOTS small numbers are broadcast, whatever its size."""
    slot = F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(SLOTS)).cast("int")
    slots = wanted.select(slot.alias("_slot")).distinct()
    return df.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


def tasks_for(total: int | None, df: DataFrame) -> int:
    """Tasks for so many shingles: the sets of a PARTS-th of one should fit a core's cache, and of all of it its memory."""
    return min(MOST_TASKS, max(-(-int(total or 0) // TASK_SHINGLES), df.sparkSession.sparkContext.defaultParallelism))


def parts_of(tasks: int) -> int:
    """Partitions to make sets of shingles in, for so many tasks by tasks_for()."""
    return max(tasks, min(PARTS * tasks, MOST_TASKS))


def alike(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Those (a, b) of pairs whose texts' shingle sets have a Jaccard similarity of at least the threshold.

    Both texts of a pair travel to a task, where their shingles are matched.  Of a pair's ends the one with
    more pairs comes second, as one copy of its text for about every SHARED pairs, so that a line that very
    many others are compared with never meets them all in one task.
    """
    # Written, so that joins may split the pairs of one end.
    ends = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("d")))
    own = texts.select("lid", "line", F.length("line").alias("size"))
    known = ends.join(own.select("lid", "size"), F.col("end") == F.col("lid")).select("end", "d", "size")
    tasks = tasks_for(known.agg(F.sum(F.col("d") * F.col("size"))).first()[0], pairs)
    da, db = ends.toDF("a", "da"), ends.toDF("b", "db")
    turned = pairs.join(da, "a").join(db, "b").withColumn("turn", F.col("da") > F.col("db"))
    turned = turned.select(
        F.when(F.col("turn"), F.col("b")).otherwise(F.col("a")).alias("x"),
        F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")).alias("y"),
        F.ceil(F.greatest("da", "db") / SHARED).cast("int").alias("copies"),
    )
    turned = turned.select("x", "y", F.pmod(F.xxhash64("x", "y"), F.col("copies")).cast("int").alias("copy"))
    seconds = ends.select(F.col("end").alias("y"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("d") / SHARED).cast("int") - 1)).alias("copy"))
    seconds = seconds.join(own.select(F.col("lid").alias("y"), F.col("line").alias("ly")), "y")
    firsts = turned.join(own.select(F.col("lid").alias("x"), F.col("line").alias("lx")), "x")
    both = firsts.repartition(tasks, "y", "copy").join(seconds.repartition(tasks, "y", "copy").hint("shuffle_hash"), ["y", "copy"])
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("lx").alias("line")), F.struct(F.lit(2).alias("side"), F.col("ly").alias("line")))
    rows = shingles(both.select("y", "copy", "x", F.explode(sides).alias("s")).select("y", "copy", "x", "s.side", "s.line"), width)
    held = rows.groupBy("y", "copy", "x", "h").agg(F.bit_or("side").alias("sides"))
    sizes = held.groupBy("y", "copy", "x").agg(F.count("*").alias("n"), F.count_if(F.col("sides") == 3).alias("common"))
    out = cut_lineage(sizes.where(F.col("common") >= threshold * F.col("n")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    release(ends)
    return out


def links(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b) lids of alike lines that share a bucket: every such pair is an edge or is joined by edges.

    Each line meets its buckets' centres first.  What that leaves apart in a bucket is met pair by pair; where
    such pairs are many, each line's nearest one is checked before the others, which then are mostly joined.
    """
    met = buckets(docs, width, bands, rows)
    ids = met.select("lid").distinct()
    few = slot_filter(lines(docs.select("doc_id", "text")).select("lid", "line"), "lid", ids)
    # Of a line's copies one is kept in each task before the shuffle: all have the same text.  Texts travel, not
    # their shingles, which take eight times the room.
    texts = cut_lineage(few.groupBy("lid").agg(F.max("line").alias("line")).join(ids, "lid", "left_semi"))
    tasks = tasks_for(texts.agg(F.sum(F.length("line"))).first()[0], texts)
    dealt = texts.repartition(parts_of(tasks), "lid")
    sketches = cut_lineage(with_sketch(shingles(dealt, width)).repartition(tasks, "lid"))
    out = linked(met, met, sketches, lambda pairs: alike(pairs, texts, threshold, width), threshold)
    release(met, texts, sketches)
    return out


def linked(met: DataFrame, others: DataFrame, sketches: DataFrame, check: Callable[[DataFrame], DataFrame], threshold: float, rounds: int = 0) -> DataFrame:
    """(a, b) written: links that join all linked pairs that share a key, of rows (key, lid, n, centre) and their sketches.

    Centres are met over met, all other pairs over others.  Before these, in each of `rounds` rounds the keys that have
    rows apart get another centre, which meets those apart from it.  check gives those (a, b) that are linked, as a
    written table.
    """
    pairs = cut_lineage(centre_pairs(met, sketches, threshold))
    edges = check(pairs)
    for r in range(rounds):
        again = cut_lineage(centre_pairs(next_centres(others, components(edges), r), sketches, threshold))
        found = check(again)
        more = cut_lineage(edges.union(found))
        release(again, found, edges)
        edges = more
    rest = rest_pairs(others, components(edges).select(F.col("node").alias("lid"), "root"), sketches, threshold)
    if rest.count() > MANY * sketches.count():
        ends = rest.select(F.col("a").alias("x"), F.col("b").alias("y"), "apart").union(rest.select("b", "a", "apart"))
        best = ends.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("y")).select("x", "y.y")
        best = cut_lineage(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        found = check(best)
        more = cut_lineage(edges.union(found))
        later = cut_lineage(still_apart(rest.join(best, ["a", "b"], "left_anti"), more))
        release(edges, rest, best, found)
        edges, rest = more, later
    last = check(rest.select("a", "b"))
    out = cut_lineage(edges.union(last))
    release(pairs, edges, rest, last)
    return out


def line_classes(docs: DataFrame, **options) -> DataFrame:
    """(lid, root) of the lines that are linked to a different line."""
    edges = links(docs, **options)
    out = components(edges).select(F.col("node").alias("lid"), "root")
    release(edges)
    return out


def row_id() -> Column:
    """A number of a row's id and text: rows of one id and different texts are different documents, as are those without an id."""
    return F.xxhash64("doc_id", "text")


def dropped_lines(docs: DataFrame, **options) -> DataFrame:
    """(rid, pos), rid being row_id(), of all lines but the first of each class; first by doc_id, null last, by rid, then by place.

    A class is a component of linked lines, or else the copies of one line.  Repeated rows are one document.
    """
    roots = cut_lineage(line_classes(docs, **options))
    own = lines(docs.select("doc_id", row_id().alias("rid"), "text")).drop("line")
    own = own.join(roots, "lid", "left")
    own = cut_lineage(own.select("doc_id", "rid", "pos", F.coalesce("root", "lid").alias("c"), F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0)).alias("k")))
    release(roots)
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid", "pos")
    firsts = cut_lineage(own.groupBy("c", "k").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    met = own.join(firsts, ["c", "k"])
    return met.where((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos"))).select("rid", "pos")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated and near-repeated lines taken out of text, and columns n_lines and dropped (places).

    Lines are parts between \\n; those without a word stay and count for nothing else.  Two lines are alike
    if the Jaccard similarity of their sets of WIDTH-character shingles is at least the threshold; of each
    component of alike lines, copies included, only the first line by (doc_id, place) stays.  Candidates come
    from banded MinHash: at similarity 0.8 a pair shares a bucket with a probability of some 0.995, and then is
    checked exactly or joined by links that are.  One changed character well
    inside a line of L characters breaks 8 shingles and leaves a similarity of (L - 15) / (L + 1), where all
    shingles differ: lines of 79 characters and more are still alike, shorter ones are not.  Other columns are
    kept; where docs has a column n_lines or dropped, it stays, and the new one's name gets an underscore.
    A document is told by its id and text: rows that agree in both are one, and stay alike, but two texts of one id
    lose only their own lines.  Documents without an id come after all others.  Null texts stay null with no lines; a
    text may become empty, and may be of any length; an empty table gives no rows.
    """
    n_lines, dropped, gone, parts, rid = fresh(docs.columns, "n_lines", "dropped", "_gone", "_parts", "_rid")
    places = dropped_lines(docs, **options).groupBy(F.col("rid").alias(rid)).agg(F.sort_array(F.collect_set("pos")).alias(gone))
    # A row of places is within one document; they are hashed, so that no text is sorted.  The parts are a column of their own: within the lambda, Spark would
    # split the text for every part.
    out = docs.withColumn(rid, row_id()).join(places.hint("shuffle_hash"), rid, "left").withColumn(parts, F.split("text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(F.col(parts), i))
    text = F.when(F.col(gone).isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).alias(n_lines),
        F.coalesce(gone, F.array().cast("array<int>")).alias(dropped),
    )


def line_dedup_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped_lines (places), n_chars, text_crc32 of what stays."""
    out = dedup_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.col("dropped").alias("dropped_lines"), F.length("text").cast("long").alias("n_chars"), F.crc32("text").alias("text_crc32"))
