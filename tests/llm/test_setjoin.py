"""PartEnum join: no linked pair is lost, against brute force over whole tables and over planted sets."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from quillmark.llm import setjoin as J
from quillmark.llm.common import table
from quillmark.llm.queries import op12_partenum_components

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id) of (doc_id, text) rows, comparing all that have a shingle in common."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first, holders = {}, defaultdict(list)
    for i, s in enumerate(sets):
        if s in first:
            parent[find(i)] = find(first[s])
        elif s:
            first[s] = i
    for s, i in first.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += 1
            holders[x].append(i)
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(spark, rows):
    df = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted(map(tuple, op12_partenum_components(spark, SF).collect()), key=repr) == want
    assert len({c for d, n, c in want if d != c}) > 5


def test_signatures_are_shared():
    """At the edge of the threshold, at every size and split between the two sets."""
    r = np.random.default_rng(3)
    for size in [*range(1, 80), 100, 133, 250, 700, 3000]:
        for _ in range(60 if size < 100 else 15):
            union = np.unique(r.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
            out = r.permutation(len(union))[: 15 * len(union) // 100]
            cut = r.integers(0, len(out) + 1)
            a, b = np.delete(union, out[:cut]), np.delete(union, out[cut:])
            if len(a) == len(b) and (a == b).all():
                continue
            assert np.intersect1d(J.signatures(a), J.signatures(b)).size, (size, len(a), len(b))


def test_thin_signatures_are_mostly_left_out():
    r = np.random.default_rng(4)
    for size in (60, 300, 2000):
        h = np.unique(r.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        assert len(J.signatures(h)) < 0.9 * size + 20


def test_bands_reach_one_further():
    top = J.bands().tolist()
    for x in range(1, 5000):
        own, other = (next(i for i, t in enumerate(top) if y <= t) for y in (x, x * 100 // 85))
        assert other - own <= 1


def line(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_hot_templates_and_chains(spark):
    """Hundreds of variants of one text, some apart from each other, chains, copies, and texts of a common passage."""
    rng = random.Random(5)
    base, passage = line(rng, 120), line(rng, 40)
    rows = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    chain = line(rng, 100)
    for k in range(12):
        chain = chain[3:] + line(rng, 3)
        rows.append("  ".join(chain).upper() if k % 2 else "\n".join(chain))
    rows += [" ".join(line(rng, 30) + passage + line(rng, 30)) for _ in range(80)]
    rows += [rows[0], rows[-1]] * 20
    rng.shuffle(rows)
    rows = [(7 * k % 1009, t) for k, t in enumerate(rows)]
    want = brute(rows)
    assert got(spark, rows) == want


def test_edges(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "One Two  Three"),
        (9, "one two three four"), (10, long), (11, long + " more words at its end"), (12, long[: len(long) // 2]),
        (None, "ONE"), (None, "alone here now then"), (None, None), (13, "É é É é É"), (14, "é é é é é"), (13, "é é é é é"), (13, "é é é é é"), (13, None),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    odd = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, lid int, h string")
    assert [tuple(r) for r in J.jaccard_components(odd).collect()] == [(1, 1, 1)]
