"""Erasure against a brute-force version, on the smallest tables and on odd ones."""

import datetime
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmark.llm import erasure as E
from quillmark.llm.common import table
from quillmark.llm.queries import op11_cascading_erasure

SF = "/root/testdata/sf0.001"
MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(v):
    return zlib.crc32(b"" if v is None else str(v).encode())


def rank(v):
    return (0,) if v is None else (1, v != v, 0 if v != v else v)


def brute(clients, clicks, sales, lines):
    """(table, file number) -> (rows left, erased, cents, digest, rewritten, rows) of lists of row tuples."""
    own = {}
    for s in sales:
        if s["sale_id"] is not None:
            old = own.get(s["sale_id"])
            own[s["sale_id"]] = s["client_id"] if old is None else old if s["client_id"] is None else min(old, s["client_id"])
    per_client = Counter(c["client_id"] for c in clicks if c["client_id"] is not None)
    per_master = defaultdict(set)
    for c in clients:
        if c["master_id"] is not None:
            per_master[c["master_id"]].add(c["client_id"])
    most = min(per_master, key=lambda m: (-sum(per_client[c] for c in per_master[m]), m), default=None)
    masters = {m for m in per_master if crc(m) % 400 == 0 or m == most}
    gone = {c["client_id"] for c in clients if c["master_id"] in masters} - {None}
    sold = {s["sale_id"] for s in sales if s["client_id"] in gone} - {None}
    tables = {
        "clients": (clients, lambda r: r["client_id"], lambda r: r["master_id"] in masters),
        "clicks": (clicks, lambda r: r["client_id"], lambda r: r["client_id"] in gone),
        "sales": (sales, lambda r: r["client_id"], lambda r: r["client_id"] in gone),
        "sale_lines": (lines, lambda r: own.get(r["sale_id"]), lambda r: r["sale_id"] in sold),
    }
    out = {}
    for name, (rows, client, erased) in tables.items():
        rows = sorted(rows, key=lambda r: (crc(client(r)), [rank(v) for v in r]))
        size = 1 + len(rows) // 350
        for k in range(0, len(rows), size):
            part = rows[k : k + size]
            left = [r for r in part if not erased(r)]
            cents = sum(math.floor(100 * r[MONEY[name]] + 0.5) for r in left if r[MONEY[name]] is not None)
            digest = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in left).encode()).hexdigest()
            if left:
                out[name, k // size] = (len(left), len(part) - len(left), cents, digest, len(left) < len(part), [tuple(r) for r in left])
    return out


def hold(spark, tables):
    got = E.erase(spark, *tables).collect()
    want = brute(*[t.collect() for t in tables])
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.ids_sha256, r.rewritten) for r in got} == {k: v[:5] for k, v in want.items()}
    folders = set()
    for r in got:
        at = r.path.removeprefix("file://")
        file = pq.ParquetFile(at)
        rows = [tuple(x.values()) for x in file.read().to_pylist()]
        assert [repr(x) for x in rows] == [repr(x) for x in want[r.table_name, r.file_no][5]]
        assert r.columns == ",".join(file.schema_arrow.names)
        ids = [x[0] for x in rows if x[0] is not None]
        stats = [file.metadata.row_group(g).column(0).statistics for g in range(file.metadata.num_row_groups)]
        if ids:
            assert min(s.min for s in stats if s.has_min_max) == min(ids) and max(s.max for s in stats if s.has_min_max) == max(ids)
        folders.add(os.path.dirname(os.path.dirname(at)))
    if got:
        (root,) = folders
        there = {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}
        assert there == {r.path.removeprefix("file://") for r in got}
        assert not os.path.exists(f"{root}-attempts")
    return got


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_whole_tables(spark):
    got = hold(spark, [table(spark, SF, t) for t in MONEY])
    assert any(r.rewritten for r in got)
    assert op11_cascading_erasure(spark, SF).count() == len(got)


CLIENTS = "client_id long, master_id long, balance double, `_tie` string"
CLICKS = "click_id long, client_id long, value double"
SALES = "sale_id long, client_id long, total double"
LINES = "sale_id long, line_no int, amount double, `_owner` string"


def odd(spark, clients=(), clicks=(), sales=(), lines=()):
    return [spark.createDataFrame(list(r), s) for r, s in ((clients, CLIENTS), (clicks, CLICKS), (sales, SALES), (lines, LINES))]


def test_nulls_ties_and_repeats(spark):
    clients = [(1, 10, 1.005, "x" * 100_000), (2, 10, None, None), (3, None, 2.0, ""), (None, 10, 3.0, "é"), (4, 11, -1.5, "b"), (4, 11, -1.5, "b")]
    clicks = [(None, None, None), (5, 1, 2.5), (5, 1, 2.5), (6, 4, -0.005), (7, 3, 1e6), (8, 99, 0.0)]
    sales = [(100, 1, 5.0), (101, 4, 6.0), (102, None, 7.0), (None, 1, 8.0), (103, 4, 1.0), (103, 2, 2.0)]
    lines = [(100, 1, 1.0, "a"), (100, 1, 1.0, "a"), (101, 1, None, None), (102, 1, 2.0, ""), (999, 1, 3.0, "z"), (None, None, None, None), (103, 1, 4.0, "q")] * 8
    got = hold(spark, odd(spark, clients, clicks, sales, lines))
    assert {r.table_name for r in got} == set(MONEY)
    # Repeated rows of one sale fill whole files, which go.
    assert len([r for r in got if r.table_name == "sale_lines"]) < 56


def test_no_clicks_erase_the_least_master(spark):
    got = hold(spark, odd(spark, [(1, 7, 1.0, ""), (2, 6, 1.0, ""), (3, 6, 1.0, "")], [], [(1, 2, 1.0)], [(1, 1, 1.0, "")]))
    assert [(r.table_name, r.n_rows) for r in got] == [("clients", 1)]


def test_empty_tables_and_masters(spark):
    assert hold(spark, odd(spark)) == []
    got = hold(spark, odd(spark, [(1, None, 1.0, "")], [(1, 1, 1.0)]))
    assert [r.rewritten for r in got] == [False, False]


def test_order_of_a_hot_client_and_odd_numbers(spark):
    """All orders of values, NaN last, in the tasks of one client whose rows are alike."""
    clicks = [(k % 7, 1, [0.0, float("nan"), -1.0, None, float("-inf")][k % 5]) for k in range(2000)]
    tables = odd(spark, [(1, 5, 0.0, ""), (2, 3, 0.0, "")], clicks + [(9, 2, 1.0)] * 2500)
    old, E.SORT_ROWS = E.SORT_ROWS, 300
    try:
        got = E.erase(spark, *tables).where("table_name = 'clicks'").collect()
    finally:
        E.SORT_ROWS = old
    rows = sorted([(crc(c), *[rank(v) for v in (i, c, x)]) for i, c, x in clicks])
    assert sum(r.n_rows for r in got) == 2000 and sum(r.n_erased for r in got) + sum(r.n_rows for r in got) >= 2000
    ids = []
    for r in sorted(got, key=lambda r: r.file_no):
        ids += [tuple(x.values()) for x in pq.read_table(r.path.removeprefix("file://")).to_pylist()]
    assert [(crc(c), *[rank(v) for v in (i, c, x)]) for i, c, x in ids] == rows


def test_times_and_refused_types(spark):
    df = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.999999' AS a, timestamp'2024-03-31 02:30:00' AS b, date'1960-01-01' AS c")
    row = df.select(*[E.plain(F.col(f.name), f.dataType) for f in df.schema.fields]).first()
    assert tuple(row)[0] == -1 and tuple(row)[2] == -3653
    with pytest.raises(TypeError):
        E.plain(F.col("x"), spark.sql("SELECT array(1) AS x").schema["x"].dataType)


def test_keys_sort_and_come_back(spark):
    """Sort keys of every plain type: in Spark's order, nulls first and NaN last, and told again exactly."""
    edge = {
        "long": [None, -(2**63), -1, 0, 2**63 - 1],
        "boolean": [None, False, True],
        "string": [None, "", ".", "!", "\x00", "a", "é", "😀", "￿"],
        "double": [None, float("-inf"), -1.5, 0.0, 5e-324, float("inf"), float("nan")],
        "float": [None, float("-inf"), 0.5, float("nan")],
        "decimal(38,2)": [None, Decimal("-1E35"), Decimal("0.00"), Decimal("12.50")],
        "binary": [None, b"", b"\x00", b"\xff"],
        "date": [None, datetime.date(1, 1, 1), datetime.date(2024, 2, 29)],
        "timestamp_ntz": [None, datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(2024, 3, 31, 2, 30)],
    }
    for kind, values in edge.items():
        df = spark.createDataFrame([(v,) for v in values + values[::-1]], f"x {kind}").repartition(3)
        parts = E.key_columns(F.col("x"), df.schema["x"].dataType)
        keys = sorted(E.composite(r) for r in df.select(*parts).collect())
        back = E.told(list(zip(*keys, strict=True)), E.arrow_schema(df).field("x").type).to_pylist()
        want = [r.x for r in df.orderBy(F.asc_nulls_first("x")).collect()]
        assert [repr(v) for v in back] == [repr(bytes(v) if isinstance(v, bytearray) else v) for v in want], kind
