"""Cascading erasure: tables written as ranked files, then rewritten without what belongs to the erased.

Rows are ranked by an RDD sort over whole rows as composite keys and zipWithIndex; a partitioner gives each file
number a partition and so one pyarrow writer, which gets Arrow blocks and writes them in order.  Links between tables are
cogrouped RDDs, which carry an erasure from masters to clients, sales and lines, and to the files that hold them.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut_lineage, fresh, release, shared_dir

#: A table has at most this many files: a file has 1 + floor(n / FILES) rows.
FILES = 350
#: A master is erased if the crc32 of its number is divisible by this.
EVERY = 400
#: Rows of a sorting task, about, and the most such tasks: sorting samples 20 rows for each on the driver.
SORT_ROWS, MOST_TASKS = 100_000, 2_000
#: Rows of an Arrow block on its way to a file's writer, and of a row group.
BLOCK, ROW_GROUP = 8_192, 1 << 17
#: Parts that the sales of one client are dealt to, where links meet.
SALT = 32


@dataclass(frozen=True)
class Layout:
    """How a table is written: its name, its column of money, and the column that tells an erased row."""

    name: str
    money: str
    erased_by: str


@dataclass(frozen=True)
class FileRow:
    """What is known of a written file; low and high are its first and last (crc, first column) as sort keys."""

    no: int
    n_rows: int
    cents: int
    ids_sha256: str
    low: tuple
    high: tuple
    path: str


def crc_of(value: Column) -> Column:
    """crc32 of a number's decimal text, of the empty text for null."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")))


def plain(column: Column, kind: T.DataType) -> Column:
    """A column as values that Python sorts as Spark does: times as microseconds, dates as days."""
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(column.cast("date")).cast("long") * 86_400_000_000
        return day + F.hour(column).cast("long") * 3_600_000_000 + F.minute(column).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if not isinstance(kind, T.NumericType | T.StringType | T.BooleanType | T.BinaryType):
        raise TypeError(f"columns of type {kind.simpleString()} have no order here")
    return column


#: A null number's place in a sort key, less than all numbers; it is the only float where the others are integers.
LEAST = -math.inf


def key_columns(column: Column, kind: T.DataType) -> list[Column]:
    """A column as the one or two parts of a sort key from which it can be told again.

    Text begins with a dot, so that null, as the empty text, comes first.  What may be NaN, or has no value less than
    all, comes after its class: null, value or NaN.  Other nulls are left to composite().
    """
    x = plain(column, kind)
    if isinstance(kind, T.StringType):
        return [F.coalesce(F.concat(F.lit("."), x), F.lit(""))]
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        zero = F.lit(0.0).cast(kind)
        return [F.when(x.isNull(), 0).when(F.isnan(x), 2).otherwise(1), F.coalesce(F.nanvl(x, zero), zero)]
    if isinstance(kind, T.DecimalType | T.BinaryType):
        return [x.isNotNull().cast("int"), F.coalesce(x, F.lit(b"" if isinstance(kind, T.BinaryType) else 0).cast(kind))]
    return [x]


def composite(row) -> tuple:
    """A row of key columns as a sort key."""
    return tuple([LEAST if v is None else v for v in row])


def told(parts: list, kind: pa.DataType) -> pa.Array:
    """The values that key_columns() made these parts of, as an array."""
    if len(parts) == 2:
        values = [v if c == 1 else math.nan if c else None for c, v in zip(*parts, strict=True)]
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        values = [v[1:] if v else None for v in parts[0]]
    else:
        values = [None if v.__class__ is float else v for v in parts[0]]
    return pa.array(values, type=kind)


def arrow_schema(df: DataFrame) -> pa.Schema:
    kinds = [pa.timestamp("us") if isinstance(f.dataType, T.TimestampNTZType) else to_arrow_type(f.dataType) for f in df.schema.fields]
    return pa.schema([pa.field(f.name, k) for f, k in zip(df.schema.fields, kinds, strict=True)])


def blocks(rows: Iterator, per_file: int, schema: pa.Schema, widths: list[int]) -> Iterator:
    """((file_no, first index), (Arrow bytes, first key, last key)) of consecutive ranked rows; widths: parts of a column's key."""
    ends = [1 + sum(widths[: i + 1]) for i in range(len(widths))]
    run, start = [], None

    def packed():
        columns = list(zip(*run, strict=True))
        arrays = [told(columns[end - w : end], f.type) for end, w, f in zip(ends, widths, schema, strict=True)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(pa.record_batch(arrays, schema=schema))
        return (start // per_file, start), (sink.getvalue().to_pybytes(), run[0][:2], run[-1][:2])

    for row, index in rows:
        if run and (len(run) == BLOCK or index // per_file != start // per_file):
            yield packed()
            run = []
        if not run:
            start = index
        run.append(row)
    if run:
        yield packed()


class FileWriter:
    """Writes batches to a Parquet file in order, counting; the file appears under its name once it is whole.

    An attempt that is lost leaves its part in another folder, which goes at the end.
    """

    def __init__(self, path: str, attempts: str, schema: pa.Schema, money: str):
        self.fs, self.at = pafs.FileSystem.from_uri(path)
        self.path, self.schema, self.money = path, schema, schema.get_field_index(money)
        self.part = f"{pafs.FileSystem.from_uri(attempts)[1]}/{uuid.uuid4().hex}"
        self.n, self.cents, self.sha, self.held, self.out = 0, 0, hashlib.sha256(), [], None

    def write(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        ids = ",".join("" if v is None else str(v) for v in batch.column(0).to_pylist())
        self.sha.update((f",{ids}" if self.n else ids).encode("utf-8", "surrogatepass"))
        self.n += batch.num_rows
        self.cents += cents(batch.column(self.money))
        self.held.append(batch)
        if sum(b.num_rows for b in self.held) >= ROW_GROUP:
            self._flush()

    def _flush(self) -> None:
        if self.out is None:
            self.fs.create_dir(self.part.rpartition("/")[0], recursive=True)
            self.out = pq.ParquetWriter(self.part, self.schema, filesystem=self.fs)
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held, self.schema))
        self.held = []

    def close(self) -> tuple[int, int, str]:
        """(rows, cents, sha256 of the ids)."""
        self._flush()
        self.out.close()
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        if self.fs.get_file_info(self.at).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.at)
        self.fs.move(self.part, self.at)
        return self.n, self.cents, self.sha.hexdigest()


def cents(money: pa.Array) -> int:
    """Sum of floor(100 x + 0.5); null and what is no number count as 0."""
    x = pc.fill_null(pc.cast(money, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    x = np.floor(100 * np.where(np.isfinite(x), x, 0.0) + 0.5)
    return sum(map(int, x.tolist())) if len(x) and np.abs(x).max() >= 2**40 else int(x.astype(np.int64).sum())


def write_ranked(df: DataFrame, columns: list[str], order: Column, layout: Layout, folder: str, tie: str | None = None) -> list[FileRow]:
    """Writes columns of df's rows, sorted by order and then these columns, nulls first, as files of equal row counts.

    tie names a column that tells equal rows apart, so that a sort can part them, and is not written; without it,
    rows are told apart by their place in the input.  At most FILES rows come back.
    """
    n = df.count()
    if not n:
        return []
    written = df.select(*[F.col(f"`{c}`") for c in columns])
    schema, per_file = arrow_schema(written), 1 + n // FILES
    values = [key_columns(F.col(f"`{f.name}`"), f.dataType) for f in written.schema.fields]
    widths = [len(v) for v in values]
    keyed = df.select(order, *[part for v in values for part in v], F.col(tie) if tie else F.monotonically_increasing_id())
    keyed = keyed.toDF(*[f"k{i}" for i in range(len(keyed.columns))])
    rows = keyed.rdd.map(composite).persist(StorageLevel.DISK_ONLY)
    tasks = max(1, min(MOST_TASKS, -(-n // SORT_ROWS)))
    ranked = rows.sortBy(lambda row: row, numPartitions=tasks).zipWithIndex()
    made = ranked.mapPartitions(lambda part: blocks(part, per_file, schema, widths))
    by_file = made.repartitionAndSortWithinPartitions(-(-n // per_file), lambda key: key[0])
    name, money, attempts = f"{folder}/{layout.name}", layout.money, f"{folder}-attempts"

    def write(part):
        writer = no = low = high = None
        for (no, _), (data, first, last) in part:
            if writer is None:
                writer, low = FileWriter(f"{name}/file-{no:05d}.parquet", attempts, schema, money), first
            high = last
            with pa.ipc.open_stream(data) as stream:
                for batch in stream:
                    writer.write(batch)
        if writer is not None:
            yield FileRow(no, *writer.close(), low, high, writer.path)

    out = sorted(by_file.mapPartitions(write).collect(), key=lambda f: f.no)
    rows.unpersist()
    return out


def erased_masters(clients: DataFrame, clicks: DataFrame, every: int = EVERY) -> Column:
    """Whether master_id is erased: its crc32 is divisible, or its clients together have the most clicks (tie: the least)."""
    own = clients.where("master_id IS NOT NULL").select("client_id", "master_id").distinct().rdd.map(tuple)
    counted = clicks.where("client_id IS NOT NULL").groupBy("client_id").count().rdd.map(tuple)
    met = own.cogroup(counted).flatMap(lambda x: [(m, 0 if x[0] is None else sum(x[1][1])) for m in x[1][0]])
    most = met.reduceByKey(lambda a, b: a + b).map(lambda x: (-x[1], x[0])).takeOrdered(1)
    hit = F.crc32(F.col("master_id").cast("string")) % every == 0
    return F.coalesce(hit | (F.col("master_id") == most[0][1]), F.lit(False)) if most else F.coalesce(hit, F.lit(False))


def erased_sales(victims: RDD, sales: DataFrame) -> RDD:
    """(sale_id, crc of the client that orders the sale's lines) of the victims' sales.

    The sales of a client are dealt to SALT parts, each of which meets the victims, which are few.
    """
    pairs = sales.where("client_id IS NOT NULL AND sale_id IS NOT NULL").select("client_id", "sale_id", "owner").distinct()
    links = pairs.select("client_id", F.pmod(F.xxhash64("sale_id"), F.lit(SALT)), "sale_id", crc_of(F.col("owner"))).rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3])))
    dealt = victims.flatMap(lambda c: [((c, s), None) for s in range(SALT)])
    return links.cogroup(dealt).flatMap(lambda x: x[1][0] if len(x[1][1]) else [])


def holding(files: list[FileRow], width: int):
    """A function that gives the numbers of the files whose range holds a prefix of a sort key, of width parts."""
    low, high = [f.low[:width] for f in files], [f.high[:width] for f in files]
    no = [f.no for f in files]
    return lambda key: no[bisect.bisect_left(high, key) : bisect.bisect_right(low, key)]


def rewrite(row: FileRow, layout: Layout, victims: set, attempts: str) -> tuple[int, int, str | None, int, str | None]:
    """(rows, cents, sha256, erased, path) of a file without the victims' rows; path is null if none is left, the old one if all are."""
    fs, at = pafs.FileSystem.from_uri(row.path)
    gone = pa.array(sorted(victims))
    with fs.open_input_file(at) as source:
        file = pq.ParquetFile(source)
        writer = FileWriter(row.path.replace(".parquet", "-rewritten.parquet"), attempts, file.schema_arrow, layout.money)
        for batch in file.iter_batches(batch_size=ROW_GROUP):
            hit = pc.is_in(batch.column(layout.erased_by), value_set=gone.cast(batch.schema.field(layout.erased_by).type))
            writer.write(batch.filter(pc.invert(hit)))
    if writer.n == row.n_rows:
        if writer.out is not None:
            writer.out.close()
        return row.n_rows, row.cents, row.ids_sha256, 0, row.path
    if not writer.n:
        return 0, 0, None, row.n_rows, None
    return *writer.close(), row.n_rows - writer.n, writer.path


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the URI by which any machine and pyarrow find it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


RESULT = "table_name string, file_no long, n_rows long, n_erased long, cents long, ids_sha256 string, rewritten boolean, columns string, path string"
LAYOUTS = (Layout("clients", "balance", "master_id"), Layout("clicks", "value", "client_id"), Layout("sales", "total", "client_id"), Layout("sale_lines", "amount", "sale_id"))


def erase(spark: SparkSession, clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """Writes the four tables to a new folder in the shared one, erases the victims, and gives a row for each final file.

    Rows are ordered by the crc32 of their client's number (a line's: its sale's), then by all columns, nulls first.
    Victim masters' clients go, with these clients' clicks and sales and with these sales' lines; a null refers to
    nothing.  Should a sale number be on several rows, the least client orders its lines, and they go if any of
    the rows' clients is erased.  Repeated rows stay repeated.  An empty table has no files; of a table without
    masters nothing goes.  Extra columns of plain types are written too, under any name; texts may be of any
    length.  Nested columns are refused, for they have no order here.  Files appear whole or not at all, and rewritten
    ones beside the old, which go once all is done: tasks can be run again.
    """
    folder = qualified(spark, f"{shared_dir(spark).rstrip('/')}/erasure-{uuid.uuid4().hex}")
    owners = cut_lineage(sales.where("sale_id IS NOT NULL").groupBy("sale_id").agg(F.min("client_id").alias("owner")))
    tie, owner = fresh(sale_lines.columns, "_tie", "_owner")
    # The place in the input is taken before the shuffle: run again, a task gives equal rows the same.
    lines = sale_lines.withColumn(tie, F.monotonically_increasing_id()).join(owners.toDF("sale_id", owner), "sale_id", "left")
    tables = {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": sale_lines}
    files = {}
    for layout in LAYOUTS:
        df, by, told_by = (lines, owner, tie) if layout.name == "sale_lines" else (tables[layout.name], "client_id", None)
        files[layout.name] = write_ranked(df, tables[layout.name].columns, crc_of(F.col(by)), layout, folder, told_by)
    found = erase_files(spark, clients, clicks, sales.select("sale_id", "client_id").join(owners, "sale_id"), files, f"{folder}-attempts")
    release(owners)
    rows, fs = [], pafs.FileSystem.from_uri(folder)[0]
    for layout in LAYOUTS:
        columns = ",".join(tables[layout.name].columns)
        for f in files[layout.name]:
            n, money, sha, erased, path = found.get((layout.name, f.no), (f.n_rows, f.cents, f.ids_sha256, 0, f.path))
            if path != f.path:
                fs.delete_file(pafs.FileSystem.from_uri(f.path)[1])
            if path is not None:
                rows.append((layout.name, f.no, n, erased, money, sha, erased > 0, columns, path))
    attempts = pafs.FileSystem.from_uri(f"{folder}-attempts")[1]
    if fs.get_file_info(attempts).type == pafs.FileType.Directory:
        fs.delete_dir(attempts)
    return spark.createDataFrame(rows, RESULT)


def erase_files(spark: SparkSession, clients: DataFrame, clicks: DataFrame, sales: DataFrame, files: dict[str, list[FileRow]], attempts: str) -> dict:
    """(table, file number) -> what rewrite() gave, for the files that may hold victims: their range holds a victim's key."""
    victims = clients.where(erased_masters(clients, clicks)).select(crc_of(F.col("client_id")), "client_id", "master_id").rdd.map(tuple).persist(StorageLevel.DISK_ONLY)
    own, by_click, by_sale, by_line = holding(files["clients"], 2), holding(files["clicks"], 1), holding(files["sales"], 1), holding(files["sale_lines"], 2)
    named = victims.filter(lambda v: v[1] is not None).map(lambda v: (v[0], v[1])).distinct()
    links = [
        victims.flatMap(lambda v: [(("clients", no), v[2]) for no in own((v[0], LEAST if v[1] is None else v[1]))]),
        named.flatMap(lambda v: [(("clicks", no), v[1]) for no in by_click((v[0],))]),
        named.flatMap(lambda v: [(("sales", no), v[1]) for no in by_sale((v[0],))]),
        erased_sales(named.map(lambda v: v[1]), sales).flatMap(lambda s: [(("sale_lines", no), s[0]) for no in by_line((s[1], s[0]))]),
    ]
    known = [((layout.name, f.no), (layout, f)) for layout in LAYOUTS for f in files[layout.name]]
    if not known:
        return {}
    sc = spark.sparkContext
    tasks = min(len(known), max(64, 2 * sc.defaultParallelism))
    met = sc.parallelize(known, min(len(known), 16)).cogroup(sc.union(links), numPartitions=tasks)
    hit = met.filter(lambda x: len(x[1][0]) and len(x[1][1]))
    out = hit.map(lambda x: (x[0], rewrite(list(x[1][0])[0][1], list(x[1][0])[0][0], set(x[1][1]), attempts))).collectAsMap()
    victims.unpersist()
    return out
