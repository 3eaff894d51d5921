"""Sharding, SimHash, line dedup and mixing against brute force."""

import random
import time
import zlib

import numpy as np
import pytest
import xxhash

from quillmark.llm import linededup as D
from quillmark.llm import mixing as M
from quillmark.llm import sharding as Sh
from quillmark.llm import simhash as S
from quillmark.llm.components import components


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (5, None)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == roots([e for e in edges if None not in e and e[0] != e[1]])


def test_minimax_is_smallest():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 12))]
        shards = rng.randint(1, 4)

        def best(i, k, memo={}):  # noqa: B006
            if i == len(sizes):
                return 0
            if k == 0:
                return 10**9
            return min(max(sum(sizes[i:j]), best(j, k - 1)) for j in range(i + 1, len(sizes) + 1))

        capacity, cuts = Sh.minimax_cuts(sizes, shards)
        assert capacity == best(0, shards)
        assert len(cuts) == shards and cuts[-1] == len(sizes) and cuts == sorted(cuts)
    assert Sh.minimax_cuts([], 3) == (0, [0, 0, 0])


def test_shards(spark):
    texts = ["t%d" % (i % 37) * (1 + i % 11) for i in range(300)] + ["hot"] * 150 + [None, "", "é"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (None, "x")], "doc_id long, text string")
    rows = Sh.shard_documents(docs).collect()
    assert len(rows) == len(texts) + 2
    text = dict(enumerate(texts))
    for r in rows:
        if r["doc_id"] is not None:
            raw = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    shard_of = {}
    for r in rows:
        if r["doc_id"] is not None:
            assert shard_of.setdefault(text[r["doc_id"]] or "", r["shard"]) == r["shard"]
    for k in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert Sh.shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [(18, 12), (2, 1), (3, 20)])
def test_capacity_is_smallest_over_texts(spark, bits):
    """Bundles come apart down to single texts, so the largest shard is as small as the order of texts allows."""
    import hashlib

    rng = random.Random(16)
    texts = [f"{i % 90} " * rng.randint(1, 60) for i in range(250)] + ["hot" * 20] * 40 + ["x" * 300_000, None, ""]
    docs = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in enumerate(texts)] + [(None, "hot" * 20, 1, "c", 2)] * 3, "doc_id long, text string, size int, cell string, shard int")
    sizes = {}
    for t in [*texts, *["hot" * 20] * 3]:
        h = int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
        sizes[h] = sizes.get(h, 0) + len((t or "").encode()) + 1
    capacity, _ = Sh.minimax_cuts([sizes[h] for h in sorted(sizes)], 8)
    got = Sh.shard_documents(docs, bundle_bits=bits[0], more_bits=bits[1]).toPandas()
    assert len(got) == len(texts) + 3 and got.groupby("shard")["size"].sum().max() == capacity
    assert sorted(got.columns) == sorted(["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ("", None, "a", "A b", "a B c", "a b c d\x1ce É", " x  y \n z " * 50):
        assert S.fingerprint(t) == fingerprint(t)


def test_hamming_links(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:10]:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            fps.add(x)
    fps = list(fps)
    want = roots([(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 3])
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for most in (64, 3):  # by the join, and by tiles
        monkeypatch.setattr(S, "JOIN_MOST", most)
        monkeypatch.setattr(S, "TILE", 4)
        got = {(r["a"] % 2**64, r["b"] % 2**64) for r in S.hamming_links(df).collect()}
        assert all(bin(a ^ b).count("1") <= 3 for a, b in got)
        groups = lambda r: {frozenset(x for x in r if r[x] == v) for v in r.values()}
        assert groups(roots(got)) == groups(want)


def test_simhash_frame(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(5, text, "a"), (3, text.replace("w7 ", "v7 "), "b"), (9, None, "c"), (8, "", "d"), (4, "other words here now", "e"), (None, text, "f"), (4, "other words here now", "e")], "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["component_id"]) for r in S.simhash_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (4, 4), (4, 4), (None, 3)], key=str)
    kept = sorted((r["doc_id"] or 0) for r in S.drop_near_copies(docs).collect())
    assert kept == [3, 4, 8]


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog and runs far away from the farm at dawn before anyone sees"
    near = long.replace("farm", "firm")
    docs = spark.createDataFrame(
        [(1, f"{long}\nunique one\n\nshort", "x"), (2, f"intro\n {near} \nshort\nshort", "x"), (3, None, "x"), (4, "", "x"), (None, long, "x"), (5, "short", "y")],
        "doc_id long, text string, dropped_by string",
    )
    out = {r["doc_id"]: r for r in D.dedup_lines(docs).collect()}
    assert out[1]["text"] == f"{long}\nunique one\n\nshort" and out[1]["n_lines"] == 4
    assert out[2]["text"] == "intro" and out[2]["dropped"] == [1, 2, 3]
    assert out[3]["text"] is None and out[3]["n_lines"] == 0
    assert out[4]["text"] == "" and out[5]["text"] == "" and out[None]["text"] == ""
    assert D.dedup_lines(docs.limit(0)).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    """Lines that come once stay, whatever else has the row's id; rows without an id are told by their text."""
    rows = [(1, "shared by both\nonly in A"), (1, "only in B\nshared by both"), (1, "only in B\nshared by both"), (None, "shared by both\nonly in C"), (None, "only in D\nonly in C"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "-") for r in D.dedup_lines(docs).collect())
    lines = [x for _, t in set(got) for x in t.split("\n") if x != "-"]
    assert sorted(x for x in lines if x) == ["only in A", "only in B", "only in C", "only in D", "shared by both"]
    assert len(got) == len(rows)


def test_near_copies_keep_unlike_texts_of_one_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(200)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[0]), (2, texts[3]), (3, texts[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), (r["text"] or "-")[:1]) for r in S.drop_near_copies(docs).collect())
    assert got == [(0, "-"), (0, "c"), (1, "a"), (1, "b"), (2, "d")]


def test_many_equal_rows_of_a_mixture(spark):
    """A third of the rows equal in id, source and text: work grows with them, not with their square."""
    def run(n):
        docs = spark.range(3 * n).selectExpr("if(id < %d, null, id) AS doc_id" % n, "if(id < %d, null, concat('word ', id)) AS text" % n, "'s' AS source", "id AS other")
        began = time.time()
        got = M.apply_mixture(docs, block_tokens=1000)
        assert got.groupBy("other").count().where("count <> 1").count() == 0 and got.count() == 3 * n
        return time.time() - began

    run(100)
    small = run(20_000)
    assert run(80_000) < 3 * small + 5


@pytest.mark.parametrize("many", [2, -1])
def test_line_links_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(D, "MANY", many)
    rng = random.Random(5)
    lines = []
    for _ in range(25):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 30))]
        for _ in range(4):
            own = words.copy()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "".join(rng.choice("abcdefg") for _ in range(5))
            lines.append(" ".join(own))
    lines = list(dict.fromkeys(lines))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    lid = {r["lid"]: r["line"] for r in D.lines(docs).collect()}
    sets = {t: {t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in lines}
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {frozenset((lid[r["a"]], lid[r["b"]])) for r in D.links(docs).collect()}
    assert got <= want and len(want) >= 10
    groups = lambda e: {frozenset(x for x in r if r[x] == v) for r in [roots([sorted(p) for p in e])] for v in r.values()}
    assert len(groups(got) & groups(want)) >= 0.9 * len(groups(want))


def test_clashing_columns_nulls_and_repeats(spark):
    names = "doc_id long, text string, n_lines string, dropped int, _gone int, _parts string, DROPPED_ int"
    docs = spark.createDataFrame([(1, "a line here\nb", "p", 7, 8, "q", 9), (1, "a line here\nb", "p", 7, 8, "q", 9), (2, "a line here", None, None, None, None, None), (None, None, "r", 1, 2, "s", 3)], names)
    out = D.dedup_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(docs.columns) + 2
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == sorted([(1, "a line here\nb", "p", 7, 8, "q", 9, 2, [])] * 2 + [(2, "", None, None, None, None, None, 1, [0]), (None, None, "r", 1, 2, "s", 3, 0, [])], key=str)


def test_very_long_line(spark):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefgh ") for _ in range(120_000)).strip()
    docs = spark.createDataFrame([(1, long), (2, long[:60_000] + "X" + long[60_000:] + "\nrest")], "doc_id long, text string")
    assert {r["doc_id"]: r["dropped"] for r in D.dedup_lines(docs).collect()} == {1: [], 2: [0]}


def test_templated_pairs_share_buckets_and_are_found(spark):
    """2,000 pairs at about 0.84 that all share a template, so that pairs of different ones come near too."""
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz"
    shared = "".join(rng.choice(letters) for _ in range(150))
    texts = []
    for _ in range(2000):
        own = "".join(rng.choice(letters) for _ in range(42))
        texts += [shared[:100] + own + shared[100:], shared[:100] + own[:20] + "Z" + own[21:] + shared[100:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r["lid"]: r["root"] for r in D.line_classes(docs).collect()}
    at = {r["doc_id"]: r["lid"] for r in D.lines(docs).collect()}
    joined = sum(root.get(at[2 * i], "a") == root.get(at[2 * i + 1], "b") for i in range(2000))
    assert joined >= 0.95 * 2000


@pytest.mark.parametrize("shared", [256, 3])
def test_checked_pairs_are_exact(spark, monkeypatch, shared):
    rng = random.Random(15)
    monkeypatch.setattr(D, "SHARED", shared)
    base = "".join(rng.choice("abcdefgh") for _ in range(120))
    texts = [base] + [base[: rng.randrange(40, 120)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) for _ in range(40)] + ["abc", "abd", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    pairs = [(0, i) for i in range(1, 41)] + [(41, 42), (3, 4), (5, 43)]
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts]
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = D.alike(spark.createDataFrame(pairs, "a long, b long"), frame).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 3


def test_sketches_are_made_in_small_parts(spark, monkeypatch):
    rng = random.Random(17)
    dealt, frame = [], type(spark.range(0))
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c: dealt.append((n, c)) or plain(self, n, *c))
    monkeypatch.setattr(D, "tasks_for", lambda total, df: 4)
    longs = ["".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(60)]
    texts = [t for x in longs for t in (x, x[:-5], "z" * 30 + x[30:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lid = {r["doc_id"]: r["lid"] for r in D.lines(docs).collect()}
    want = {frozenset((lid[3 * i], lid[3 * i + 1])) for i in range(60)}
    found = {frozenset(r) for r in D.links(docs).collect()}
    assert len(found & want) >= 59 and found <= want
    assert [n for n, c in dealt if c == ("lid",)] == [20, 4]


@pytest.mark.parametrize("tile, many", [(512, 2), (40, 0)])
def test_hub_of_variants_is_one_class(spark, monkeypatch, tile, many):
    """Each variant is alike to the base line only, so a bucket's ends link few of them."""
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100))
    lines = {base}
    while len(lines) < 301:
        i = rng.randrange(100)
        lines.add(base[:i] + rng.choice("ABCDEFGHIJ") + base[i + 1 :])
    monkeypatch.setattr(D, "TILE", tile)
    monkeypatch.setattr(D, "MANY", many)
    docs = spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string")
    found = D.line_classes(docs).collect()
    met = {r["lid"] for r in D.buckets(docs).collect()}
    assert len(met) > 290 and {r["lid"] for r in found} == met
    assert len({r["root"] for r in found}) == 1


def test_shortest_line_with_a_changed_character(spark):
    rng = random.Random(9)
    pairs = {}
    for length in (40, 78, 79, 80, 100):
        for k in range(40):
            line = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(length))
            pairs[length, k] = (line, line[: length // 2] + "x" + line[length // 2 + 1 :])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs.values() for t in p)], "doc_id long, text string")
    line = {r["lid"]: r["line"] for r in D.lines(docs).collect()}
    got = {frozenset((line[r["a"]], line[r["b"]])) for r in D.links(docs).collect()}
    found = {n: sum(frozenset(p) in got for (length, _), p in pairs.items() if length == n) for n in (40, 78, 79, 80, 100)}
    assert found[40] == found[78] == 0
    assert min(found[79], found[80], found[100]) >= 39


@pytest.mark.parametrize("size, most", [(10, 0.025), (16, 0.02), (25, 0.015), (80, 0.015)])
def test_bands_seldom_miss_short_lines(spark, size, most):
    """Pairs at a similarity of 0.8 with few shingles: the shorter line is the longer one's beginning."""
    rng = random.Random(size)
    longs = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(size + 7)) for _ in range(2000)]
    texts = [t for x in longs for t in (x, x[: -(size // 5)])]
    keys = {}
    for r in D.band_keys(spark.createDataFrame(list(enumerate(texts)), "lid long, line string")).collect():
        keys.setdefault(r["lid"], set()).add(r["key"])
    missed = sum(keys[2 * i].isdisjoint(keys[2 * i + 1]) for i in range(len(longs)))
    assert missed <= most * len(longs)


def test_copies_are_hashed_once_and_no_shingle_is_shuffled(spark):
    """Each line goes from task to task as text, once; no exchange comes between its shingles and its keys."""
    common = "a line that very many documents hold, word for word"
    docs = spark.createDataFrame([(i, f"{common}\n {common}\t\nown line {i}\n\n") for i in range(200)] + [(200, None), (None, common)], "doc_id long, text string")
    own = D.distinct_lines(docs)
    assert sorted(r["line"] for r in own.collect()) == sorted([common] + [f"own line {i}" for i in range(200)])
    keys = D.band_keys(own)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.index("explode(sequence") < plan.index("Exchange hashpartitioning(")
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, D.band_keys(D.lines(docs)).collect()))


def test_sketches_differ_no_more_than_sets(spark):
    rng = random.Random(8)
    sets = {i: {rng.getrandbits(64) - 2**63 for _ in range(rng.randint(0, 60))} for i in range(12)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in [*s, *list(s)[:5]]], "lid long, h long")
    got = {r["lid"]: r for r in D.with_sketch(df).collect()}
    sets = {i: s for i, s in sets.items() if s}
    assert got.keys() == sets.keys()
    for i, s in sets.items():
        assert got[i]["size"] == len(s)
        for j, t in sets.items():
            apart = sum(((got[i][f"w{k}"] ^ got[j][f"w{k}"]) % 2**64).bit_count() for k in range(D.WORDS))
            assert apart <= len(s ^ t) and (apart - len(s ^ t)) % 2 == 0


def test_exponent(spark):
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "none": 0.0}
    table = spark.createDataFrame([(p,) for p in shares.values()], "share double")
    for s in (M.Shares(shares), M.SharesTable(table)):
        x = M.solve_exponent(s, max_epochs=2.0)
        weights = {k: p**x / s.scale(x) for k, p in shares.items() if p}
        rates = [weights[k] / shares[k] for k in weights]
        assert abs(sum(weights.values()) - 1) < 1e-9 and abs(max(rates) / min(rates) - 2.0) < 1e-6
        y = M.solve_exponent(s, target_entropy=1.0, steps=20)
        own = [p**y / s.scale(y) for p in shares.values() if p]
        assert abs(-sum(w * np.log(w) for w in own) - 1.0) < 1e-4
        assert M.solve_exponent(s, max_epochs=100) == 0.0
        assert M.solve_exponent(s, target_entropy=9) == 0.0 and M.solve_exponent(s, target_entropy=0.1) == 1.0
    empty = M.SharesTable(table.where("share < 0"))
    assert M.solve_exponent(empty) == 0.0 and empty.scale(1.0) == 0.0


def by_hand(rows, block_tokens, seed=M.SEED):
    """The mixture of (id, source, text) rows in plain Python: (id, source, n, weight, epoch, block, slot)."""
    import hashlib

    def number(*parts):
        return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)

    units = {}
    for i, s, t in rows:
        key = (i, M.NO_SOURCE if s is None else s, hashlib.md5((t or "").encode()).hexdigest()[:16])
        units[key] = (units.get(key, (0, 0))[0] + 1, len((t or "").split()))
    total = {}
    for (_, s, _), (m, n) in units.items():
        total[s] = total.get(s, 0) + m * n
    whole = sum(total.values())
    p = {s: n / whole for s, n in total.items() if n}
    x = max(0.0, 1 - np.log(2) / np.log(max(p.values()) / min(p.values())))
    z = sum(q**x for q in p.values())
    budget = max(total[s] * z / p[s] ** x for s in p)
    blocks = max(1, round(budget / block_tokens))
    found = []
    for s, n_all in total.items():
        epochs = budget * p[s] ** x / z / n_all if n_all else 1.0
        epochs = round(epochs) if abs(epochs - round(epochs)) < 1e-9 else epochs
        for e in range(int(np.ceil(epochs))):
            at = e * n_all
            for o, i, t in sorted(((number(seed, e, i, t), i, t) for i, u, t in units if u == s), key=lambda r: (r[0], r[1] is not None, r[1], r[2])):
                m, n = units[i, s, t]
                if at < epochs * n_all or not n_all or e + 1 <= epochs:
                    block = min(blocks - 1, int(at / (epochs * n_all) * blocks)) if n_all else o % blocks
                    found += [(block, number(seed + 1, o), s, e, i, t, k, n) for k in range(m)]
                at += m * n
    out, slots = [], {}
    for block, _, s, e, i, _, _, n in sorted(found, key=lambda r: (*r[:4], r[4] is not None, r[4], *r[5:])):
        slots[block] = slots.get(block, -1) + 1
        out.append((i, None if s == M.NO_SOURCE else s, n, round(p[s] ** x / z, 9) if s in p else 0.0, e, block, slots[block]))
    return out


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, "big" if i % 3 else f"s{i % 5}", "w " * rng.randint(1, 40)) for i in range(400)] + [(500, None, None), (501, "none", ""), (None, "big", "x y"), (7, "big", "twice"), (7, "big", "twice"), (8, "big", "w " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix(docs, block_tokens=500)
    assert got.columns == ["doc_id", "source", "n_tokens", "weight", "epoch", "block", "slot"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == sorted(by_hand(rows, 500), key=str)
    assert got == sorted(map(tuple, M.mix(docs, block_tokens=500).collect()), key=str)
    frame = M.mix(docs, block_tokens=500).toPandas()
    assert set(frame.doc_id.dropna()) == {r[0] for r in rows if r[0] is not None}
    tokens = frame[frame.weight > 0].groupby("source").agg(n=("n_tokens", "sum"), w=("weight", "first"))
    assert ((tokens.n / tokens.n.sum() - tokens.w).abs() < 0.02).all()
    small = M.mix(docs.where("doc_id <> 8"), budget=1000.0, max_epochs=2.0).toPandas()
    assert abs(small.n_tokens.sum() - 1000) < 40 * 8
    assert M.mix(docs.limit(0)).count() == 0 and M.apply_mixture(docs.limit(0)).count() == 0
    assert M.mix(docs.where("text is null or text = ''")).count() == 2


def test_mixture_of_rows(spark):
    """Clashing names, repeated ids and rows, nulls: each row as often as the mixture has it, in its order."""
    rows = [(i, f"s{i % 2}" if i % 7 else None, " ".join(["w"] * (1 + 9 * (i % 2))), i, i, i, i, i) for i in range(60)]
    rows += [(3, "s1", rows[3][2], 3, 3, 3, 3, 3), (3, "s1", rows[3][2], 99, None, 0, 0, 0), (None, "s0", None, 1, 1, 1, 1, 1), (3, "s1", "other text", 5, 5, 5, 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, block long, slot int, _times int, _row int, N int")
    out = M.apply_mixture(docs, block_tokens=40)
    assert out.columns == docs.columns
    got, mixed = out.collect(), M.mix(docs, block_tokens=40).orderBy("block", "slot").collect()
    assert [(r["doc_id"], r["source"]) for r in got] == [(r["doc_id"], r["source"]) for r in mixed]
    times = {}
    for r in got:
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert set(times) == set(rows)
    assert times[rows[3]] == 2 * times[rows[61]]


@pytest.mark.parametrize("n", [0, 1, 2, -1])
def test_mixed_numbers_are_longs(n):
    assert -(2**63) <= D._mix(n) < 2**63
