"""The Merkle manifest against a plain recursive one, and what edges do to it."""

import hashlib
import zlib

import pytest

from quillmark.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, g int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """Levels of runs; root."""
    levels = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        levels.append(runs)
        nodes = [sha(*r) for r in runs]
    return levels, nodes[0]


def up(levels, at, node, siblings):
    for runs in levels:
        run, k = runs[at // 16], at % 16
        siblings += run[:k] + run[k + 1 :]
        node = sha(*run[:k], node, *run[k + 1 :])
        at //= 16
    return node


def brute(rows):
    """Sorted result rows of (doc_id, text, lang, source, n_chars, ...) rows."""
    by = {}
    for d, text, lang, source, n, *_ in rows:
        lower = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        mine = leaf(d, source, lang, n, text)
        by.setdefault(source, []).append(((d is not None, d or 0, mine), d, mine, leaf(d, source, lang, n, lower) if hit else mine))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    top, root = tree([trees[s][1] for s in order])
    out = []
    for at, s in enumerate(order):
        levels, subroot = trees[s]
        for k, (_, d, mine, changed) in enumerate(sorted(by[s])):
            siblings = []
            folded = up(top, at, up(levels, k, changed, siblings), siblings)
            out.append((d, mine, subroot, root, sha(*siblings), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = M.manifest(spark.createDataFrame(rows, SCHEMA), **options)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_several_tiers(spark):
    """Sources of one leaf, of a run, a bucket and several tiers of buckets; more sources than a run."""
    sizes = [1, 2, 16, 17, 256, 257, 300, *[1 + k % 3 for k in range(30)]]
    rows, k = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((k * 7919 % 10_007, f"Text {k} ÄB", "en", f"source {s}" if s else None, k, "x", 1))
            k += 1
    want = brute(rows)
    assert got(spark, rows, levels=1) == want
    assert {True, False} == {r[-1] for r in want}


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (None, None, None, None, None, None, None), (None, "A", "en", None, 1, "x", 1), (None, "A", "en", None, 1, "x", 1),
        (3, "", "", "", 0, "", 0), (3, "Other", "de", "", 5, "", 0), (3, "Other", "de", "", 5, "", 0),
        (7, "W" * 300_000, "en", "=", 300_000, None, 1), (-8, "é" * 10, "fr", "ünï", 10, None, 1),
    ]
    rows += [(None, "same", None, "copies", 4, None, 1)] * 40
    assert got(spark, rows) == brute(rows)


def test_one_row_and_none(spark):
    one = [(5, "Abc", "en", "s", 3, "", 0)]
    assert got(spark, one) == brute(one)
    assert got(spark, []) == []


@pytest.mark.parametrize(("n", "levels"), [(1, 0), (2, 1), (16, 1), (17, 2), (256, 2), (257, 3), (4096, 3), (4097, 3), (10**9, 3)])
def test_depth(n, levels):
    assert M.depth(n) == levels
