"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut_lineage, fresh

#: No source is read more often than this.
MAX_EPOCHS = 2.0
#: Tokens of a block, about.
BLOCK_TOKENS = 1_000_000
#: Rows of a source are dealt to so many cells of the hash order, in which their tokens are added up.
CELLS = 4096
#: Equal rows are numbered within so many cells of them.
EQUAL_CELLS = 64
SEED = 17
NO_SOURCE = "\x00null"
#: Decimals of a weight: sums in another order agree to these.
DECIMALS = 9


class Shares:
    """Token shares of sources by name; sources without tokens have none."""

    def __init__(self, shares: dict[str, float]):
        self.p = [p for p in shares.values() if p > 0]

    def scale(self, exponent: float) -> float:
        """What weights are divided by to add up to 1."""
        return sum(p**exponent for p in self.p)

    def entropy(self, exponent: float) -> float:
        z = self.scale(exponent)
        return math.log(z) - exponent * sum(p**exponent * math.log(p) for p in self.p) / z if self.p else 0.0

    def ends(self) -> tuple[float, float]:
        """The least and the largest share."""
        return (min(self.p), max(self.p)) if self.p else (1.0, 1.0)


class SharesTable(Shares):
    """The same from a table with a column share, by aggregation: a source may be a web site."""

    def __init__(self, table: DataFrame):
        self.table = table.where("share > 0")
        self.limits = tuple(self.table.agg(F.min("share"), F.max("share")).first())

    def _sum(self, x: Column) -> float:
        return self.table.agg(F.sum(x)).first()[0] or 0.0

    def scale(self, exponent: float) -> float:
        return self._sum(F.pow("share", F.lit(exponent)))

    def entropy(self, exponent: float) -> float:
        z = self.scale(exponent)
        return math.log(z) - exponent * self._sum(F.pow("share", F.lit(exponent)) * F.log("share")) / z if z else 0.0

    def ends(self) -> tuple[float, float]:
        return self.limits if self.limits[0] else (1.0, 1.0)


def repetition(shares: Shares, exponent: float) -> float:
    """Most epochs of a source when every source is read once at least: rates go with share ** (exponent - 1)."""
    low, high = shares.ends()
    return (high / low) ** (1 - exponent)


def solve_exponent(shares: Shares, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1] that meets the target, by bisection; smaller is flatter.

    With target_entropy (nats), the one whose weights have it, or the nearest end.  Otherwise the least one
    that repeats no source over max_epochs.  Both measures fall as the exponent grows.
    """
    if target_entropy is not None:
        high_enough = lambda x: shares.entropy(x) >= target_entropy
        low, high = 0.0, 1.0
        if not high_enough(low):
            return low
        if high_enough(high):
            return high
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if high_enough(mid) else (low, mid)
        return low
    fits = lambda x: repetition(shares, x) <= max_epochs
    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def source_plan(tokens: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, budget: float | None = None) -> tuple[DataFrame, float]:
    """(tokens with columns weight and epochs, tokens of the whole mixture) of a written table (source, total).

    Without a budget in tokens, the least one that reads every source once.  A source without tokens has
    weight 0 and one epoch.
    """
    whole = tokens.agg(F.sum("total")).first()[0] or 0
    if not whole:
        return tokens.select("*", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs")), 0.0
    share = F.col("total") / F.lit(float(whole))
    shares = SharesTable(tokens.select(share.alias("share")))
    x = solve_exponent(shares, max_epochs, target_entropy)
    z = shares.scale(x)
    if budget is None:
        budget = whole * z * shares.ends()[1] ** (1 - x)
    weight = F.when(F.col("total") > 0, F.pow(share, F.lit(x)) / F.lit(z)).otherwise(0.0)
    epochs = F.when(F.col("total") > 0, F.lit(float(budget)) * weight / F.col("total")).otherwise(1.0)
    near = F.abs(epochs - F.round(epochs)) < 1e-9
    return tokens.select("*", F.round(weight, DECIMALS).alias("weight"), F.when(near, F.round(epochs)).otherwise(epochs).alias("epochs")), float(budget)


def hash_order(*parts: Column | str) -> Column:
    """A number of 60 bits from the md5 of the parts' texts with bars between them; null counts as empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


def text_key(text: Column) -> Column:
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16)


def mix(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, keys: bool = False) -> DataFrame:
    """A row for each copy of a document in the mixture.

    Columns: doc_id, source, n_tokens, weight, epoch, block, slot; with keys also text_key and row, which tell
    the text and which of equal rows it is.  Tokens are words.
    Source shares are raised to the exponent that meets the target; budget is in tokens (default: so that
    every document comes once at least).  Epoch e of a source reads it in an order by a hash of seed, e, id
    and text; the last, broken epoch takes the beginning of its order, up to the first document that passes
    the budget.  Blocks: each source's stream is cut into as many equal parts as there are blocks of about
    block_tokens, so each block holds the target mixture, in an order by hash; slots number it from 0.

    A third of all rows may share a source: sums run within CELLS cells of each source's hash order, and
    cells are added up, so no task meets a whole source.  Sources stay a table, however many there are.  Null
    sources count as one more source; null texts and texts without words have no tokens and come with their
    source's epochs; null ids are dealt like others; rows with the same id, source and text go together, so each
    has as many copies; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit(NO_SOURCE)).alias("s"), text_key(F.col("text")).alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n"))
    units = cut_lineage(rows.groupBy("doc_id", "s", "t").agg(F.count("*").alias("m"), F.max("n").alias("n")))
    tokens = cut_lineage(units.groupBy("s").agg(F.sum(F.col("n") * F.col("m")).alias("total")))
    plan, whole = source_plan(tokens, max_epochs, target_entropy, budget)
    blocks = max(1, round(whole / block_tokens))

    copies = units.join(plan, "s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil("epochs") - 1).cast("int")))))
    copies = copies.withColumn("o", hash_order(F.lit(seed), "epoch", "doc_id", "t"))
    copies = copies.withColumn("cell", F.shiftright("o", 60 - CELLS.bit_length() + 1))
    cells = copies.groupBy("s", "epoch", "cell").agg(F.sum(F.col("n") * F.col("m")).alias("own"))
    before = Window.partitionBy("s", "epoch").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("s", "epoch", "cell", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "epoch", "cell").orderBy("o", "doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("inside", F.coalesce(F.sum(F.col("n") * F.col("m")).over(within), F.lit(0))).join(cells, ["s", "epoch", "cell"])
    copies = copies.withColumn("at", F.col("epoch") * F.col("total") + F.col("base") + F.col("inside"))
    # Documents without tokens at a full epoch's end stay in it; a hash deals those of an empty source out.
    copies = copies.where((F.col("at") < F.col("epochs") * F.col("total")) | (F.col("total") == 0) | ((F.col("epoch") + 1) <= F.col("epochs")))
    part = F.when(F.col("total") > 0, F.col("at") / (F.col("epochs") * F.col("total")) * F.lit(blocks)).otherwise(F.col("o") % F.lit(blocks))
    copies = copies.withColumn("block", F.least(F.floor(part), F.lit(blocks - 1)).cast("long")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    order = Window.partitionBy("block").orderBy(hash_order(F.lit(seed + 1), "o"), "s", "epoch", "doc_id", "t", "row")
    return copies.select(
        "doc_id",
        F.when(F.col("s") != NO_SOURCE, F.col("s")).alias("source"),
        F.col("n").alias("n_tokens"),
        "weight",
        "epoch",
        "block",
        (F.row_number().over(order) - 1).cast("long").alias("slot"),
        *([F.col("t").alias("text_key"), "row"] if keys else []),
    )


def apply_mixture(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mixture has it, in its order: by block, then by slot; all columns kept.

    Rows of one id, source and text have as many copies each, and are told apart by a number that each gets within
    EQUAL_CELLS cells of them, moved on by the cells before: however many such rows there are, they meet the
    mixture one by one.  Nulls, empty and very long texts, ties and repeated rows come as mix() deals them, null ids
    too; columns of any name stay; an empty table gives no rows.  docs is written once, so that a row's place in it stays.
    """
    place, key, row, block, slot, cell, base = fresh(docs.columns, "_place", "_key", "_row", "_block", "_slot", "_cell", "_base")
    of = lambda t: F.md5(F.to_json(F.struct("doc_id", F.coalesce("source", F.lit(NO_SOURCE)).alias("s"), t.alias("t"))))
    written = cut_lineage(docs.withColumn(place, F.monotonically_increasing_id()))
    slim = written.select(place, of(text_key(F.col("text"))).alias(key), F.pmod(F.xxhash64(place), F.lit(EQUAL_CELLS)).alias(cell))
    before = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = slim.groupBy(key, cell).agg(F.count("*").alias(base)).withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(key, cell).orderBy(place))
    numbered = slim.withColumn(row, inside).join(cells, [key, cell]).select(place, key, (F.col(row) + F.col(base)).cast("long").alias(row))
    mixed = mix(written, keys=True, **options).select(of(F.col("text_key")).alias(key), F.col("row").cast("long").alias(row), F.col("block").alias(block), F.col("slot").alias(slot))
    met = numbered.join(mixed, [key, row]).select(place, block, slot)
    return written.join(met, place).repartitionByRange(block, slot).sortWithinPartitions(block, slot).select(*docs.columns)
