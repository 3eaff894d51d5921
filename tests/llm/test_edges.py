"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import random
import zlib

import numpy as np
import pytest

from quillmark.llm import avi, langid, linededup, mixing, pieces, quality, repetition, sharding, simhash, toxicity

#: Names that operators use within or give out, beside a document's own.
CLASHES = "h fp n block slot lid line key size cell shard score held_out n_lines dropped component_id weight epoch _gone _parts _key _row _k Text_key stems s k"


def rows():
    rng = random.Random(1)
    words = ["".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, text(40) + (" grobnak" if i % 4 == 0 else ""), ("en", "de")[i % 2], f"s{i % 3}", 1) for i in range(60)]
    long = "\n".join(text(60) for _ in range(500))
    out += [(100, long, "en", "s0", 1), (101, long + "\nx", "en", "s0", 1), (102, "y" * 150_000, "en", "s1", None), (103, "z " * 40_000, None, "s1", 1)]
    out += [(200, None, "en", "s0", None), (201, "", "en", "s0", 0), (202, " \n\t ", "de", "s1", 0), (203, None, None, None, None), (None, "no id here", "en", "s0", 1), (None, None, None, None, None)]
    out += [out[3], out[3], (300, out[5][1], "de", "s2", 1), (301, out[5][1], "de", "s2", 1), (None, "no id here", "en", "s0", 1), (5, "another text of a known id", "de", "s2", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    names = CLASHES.split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(*r, *(None if k % 3 else "clash" for k in range(len(names)))) for r in rows()], schema).cache()


@pytest.fixture(scope="module")
def labels(spark):
    found = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(60)]
    return spark.createDataFrame([*found, (3, 1, 0), (None, 1, 1), (7, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")


BY_ROW = {
    "repetition": lambda d, _: repetition.repetition_rules(d),
    "quality": lambda d, t: quality.quality_scores(d, t),
    "media": lambda d, _: avi.media_features(d),
    "line dedup": lambda d, _: linededup.line_dedup_digest(d),
    "language": lambda d, _: langid.identify_languages(d),
    "toxicity": lambda d, t: toxicity.toxicity_scores(d, t),
    "sharding": lambda d, _: sharding.shard_documents(d),
    "pieces": lambda d, _: pieces.segment_documents(d),
    "simhash": lambda d, _: simhash.simhash_components(d),
}


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_a_row_for_every_row(docs, labels, name):
    got = BY_ROW[name](docs, labels).toPandas()
    assert sorted(got["doc_id"].fillna(-1).tolist()) == sorted(-1 if r[0] is None else r[0] for r in rows())
    # Rows that come three times give one result, but for the number of a row in its shard.
    same = got[got["doc_id"] == 3].drop(columns=["slot"], errors="ignore").astype(str).drop_duplicates()
    assert len(same) == 1
    assert BY_ROW[name](docs.limit(0), labels).count() == 0
    if name in ("quality", "toxicity"):
        assert got["score"].between(0, 1).all() and BY_ROW[name](docs, labels.limit(0)).count() == len(rows())


def test_mixture_of_all_rows(docs):
    got = mixing.mix(docs, block_tokens=5_000).toPandas()
    times = got.groupby("doc_id", dropna=False).size()
    assert set(got["doc_id"].fillna(-1)) == {-1 if r[0] is None else r[0] for r in rows()}
    assert times[3] % 3 == 0 and not got.duplicated(["block", "slot"]).any()


def test_ties(spark):
    """Equal evidence: the first language by name, one score for all, the least id, the first line."""
    docs = spark.createDataFrame([(i, "same words here", "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    vocab = langid.load_vocabulary()
    flat = np.full((len(vocab.pieces), 2), 1 / len(vocab.pieces))
    pred, score = langid.Scorer(["a", "b"], flat, vocab).predict(["same words here"])
    assert pred == ["a"] and score[0] == pytest.approx(0.5)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}) == 1
    assert len({r["score"] for r in quality.quality_scores(docs, labels).collect()}) == 1
    assert {r["component_id"] for r in simhash.simhash_components(docs).collect()} == {0}
    kept = {r["doc_id"] for r in linededup.dedup_lines(docs).collect() if r["text"]}
    assert kept == {0}
    assert {r["shard"] for r in sharding.shard_documents(docs).collect()} == {0}
    assert sorted(r["slot"] for r in mixing.mix(docs).collect()) == list(range(40))


def leaf(g, h):
    return sum(g) / (sum(h) + quality.RIDGE)


def gain(g, h):
    return sum(g) ** 2 / (sum(h) + quality.RIDGE)


def tree_by_trying(g, h):
    """The best first cut by trying each, then the best second one by trying each on either side."""

    def best(parts):
        found = (1e-9, None)
        for a, b in parts:
            for c in range(a + 1, b):
                if sum(h[a:c]) >= quality.LEAST_WEIGHT and sum(h[c:b]) >= quality.LEAST_WEIGHT:
                    more = gain(g[a:c], h[a:c]) + gain(g[c:b], h[c:b]) - gain(g[a:b], h[a:b])
                    if more > found[0] + 1e-12:
                        found = (more, (a, c, b))
        return found[1]

    parts = [(0, len(g))]
    for _ in range(2):
        cut = best(parts)
        if cut is None:
            break
        parts = [p for p in parts if p != (cut[0], cut[2])] + [cut[:2], cut[1:]]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = leaf(g[a:b], h[a:b])
    return out


def test_trees_against_trying_every_cut():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        g, h = rng.normal(size=n) * 5, rng.uniform(0.1, 6, n)
        assert np.allclose(quality.shallow_tree(g, h), tree_by_trying(list(g), list(h)))
        m = int(rng.integers(1, 7))
        g, h = rng.normal(size=(n, m)), rng.uniform(0.1, 3, (n, m))
        top, table = quality.cross_tree(g, h)
        tried = [(sum(gain(x.ravel(), y.ravel()) for x, y in zip((g[:a, :b], g[:a, b:], g[a:, :b], g[a:, b:]), (h[:a, :b], h[:a, b:], h[a:, :b], h[a:, b:]), strict=True)), a, b) for a in range(1, n) for b in range(1, m)]
        if not tried:
            assert top == 0 and not table.any()
            continue
        value, a, b = max(tried)
        assert top == pytest.approx(value - gain(g.ravel(), h.ravel()))
        assert table[0, 0] == pytest.approx(leaf(g[:a, :b].ravel(), h[:a, :b].ravel())) and table[-1, -1] == pytest.approx(leaf(g[a:, b:].ravel(), h[a:, b:].ravel()))


def test_cyclic_fit_against_plain_boosting(monkeypatch):
    """The tables add up the trees of features in turn, each fitted to what all before it leave."""
    monkeypatch.setattr(quality, "ROUNDS", 4)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0.3).astype(float)
    m = quality.fit_ga2m(x, y)
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    margin = [np.log(p0 / (1 - p0))] * len(y)
    for _ in range(4):
        for f in range(3):
            edges = quality.bin_edges(x[:, f], quality.BINS)
            bins = [int((edges <= v).sum()) for v in x[:, f]]
            g, h = [0.0] * (len(edges) + 1), [0.0] * (len(edges) + 1)
            for i, k in enumerate(bins):
                p = 1 / (1 + np.exp(-margin[i]))
                g[k] += y[i] - p
                h[k] += max(p * (1 - p), 1e-6)
            step = tree_by_trying(g, h) * quality.RATE
            margin = [v + step[k] for v, k in zip(margin, bins, strict=True)]
    assert np.allclose(m.margins(x), margin)


def test_pipeline_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline as P

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = [c for c in docs.columns if c not in ("n",)]
    here = docs.select(*names)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, here, str(tmp_path))
        assert out.columns == names
        assert stage(spark, here.limit(0), str(tmp_path)).count() == 0
        here = out.cache()
        assert here.count() > 30
    assert P.STAGES[-1][1](spark, here, str(tmp_path)).count() == here.count()
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_pipeline_against_its_parts(spark, docs, labels, tmp_path):
    """run() against the stages' rules, worked out row by row in plain Python from the operators' own scores."""
    import corpus_pipeline as P

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"])
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = P.run(spark, str(tmp_path)).toPandas()
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    bad = {r["doc_id"] for r in toxicity.toxicity_scores(table, labels).collect() if r["predicted"]}
    left = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] not in bad}
    # Lines: the first of alike ones stays; here all pairs are compared.
    lines = [(i, k, x.strip(" \t\n\x0b\x0c\r")) for i, t in sorted(left.items()) if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    sets = {x: {zlib.crc32(x[a : a + 8].encode()) for a in range(max(1, len(x) - 7))} for _, _, x in lines}
    first = {}
    distinct = list(dict.fromkeys(x for _, _, x in lines))
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(distinct):
        for y in distinct[:a]:
            n, m = len(sets[x]), len(sets[y])
            if 0.8 * max(n, m) <= min(n, m) and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
    gone = set()
    for i, k, x in lines:
        if first.setdefault(find(x), (i, k)) != (i, k):
            gone.add((i, k))
    left = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in left.items()}
    prints = {i: simhash.fingerprint(t) for i, t in left.items()}
    keep, ids = [], sorted(prints)
    groups = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            groups[i] = min(groups[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 3)
    keep = [i for i in ids if groups[i] == i]
    assert sorted(set(got["doc_id"])) == keep
    mixed = spark.createDataFrame([(r["doc_id"], left[r["doc_id"]], r["source"]) for r in table.collect() if r["doc_id"] in set(keep)], "doc_id long, text string, source string")
    times = {r["doc_id"]: r["count"] for r in mixing.mix(mixed).groupBy("doc_id").count().collect()}
    assert got.groupby("doc_id").size().to_dict() == times
    assert all(r.n_chars is None or np.isnan(r.n_chars) or r.n_chars == len(left[r.doc_id]) for r in got.itertuples())
    assert got["round_trip"].dropna().all()
