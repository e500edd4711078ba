"""Mixing, packing, nearest neighbours and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as P
from wordmill.llm import mixing as X
from wordmill.llm import neighbours as N
from wordmill.llm import packing as K
from wordmill.llm import secrets as S
from wordmill.llm.common import components


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.001, 50), min_size=1, max_size=12))
def test_pfair(weights):
    period = 256
    slots = X.shares(weights, period)
    assert sum(slots.values()) == period and all(abs(c - weights[s] * period / sum(weights.values())) < 1 + len(weights) for s, c in slots.items())
    when = X.schedule(slots)
    order = {t: s for s, ts in when.items() for t in ts}
    assert sorted(order) == list(range(period))
    seen: Counter = Counter()
    for t in range(period):
        seen[order[t]] += 1
        for s, c in slots.items():
            assert abs(seen[s] - (t + 1) * c / period) < 1


def test_pfair_is_exact():
    """Less than one block from the weights themselves over many thousand slots, and any number of sources."""
    counts = {"a": 900_000, "b": 333_333, "c": 70_001, "d": 1_000, "e": 1}
    names, columns = X.plan(counts)
    weights = np.array([counts[s] ** X.ALPHA for s in names])
    ran = np.cumsum(columns["source"][:, None] == np.arange(len(names)), axis=0)
    ideal = np.arange(1, len(ran) + 1)[:, None] * (weights / weights.sum())
    assert len(ran) > 3 * 4096 and np.abs(ran - ideal).max() < 1
    assert (columns["release"] <= columns["slot"]).all() and (columns["slot"] < columns["deadline"]).all()
    assert all(16 * ran[-1][i] >= counts[s] for i, s in enumerate(names))
    names, columns = X.plan({f"s{i}": 1 + i % 3 for i in range(5_000)})
    assert len(names) == 5_000 and set(columns["source"]) == set(range(5_000))


def mixed(spark, counts, **options):
    docs = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame([(i, s, "t", 5) for i, s in docs], "doc_id bigint, source string, text string, position int")
    return df, X.mix(df, **options).orderBy("position").collect()


def test_mix_order(spark):
    counts = {"a": 700, "b": 90, "c": 30, None: 11}
    df, rows = mixed(spark, counts, block=4, period=64)
    names = {s or "(null)": n for s, n in counts.items()}
    assert {r["row"]["doc_id"] for r in rows} == set(range(sum(counts.values())))
    slots = X.shares({s: n**X.ALPHA for s, n in names.items()}, 64)
    seen: Counter = Counter()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    for i, r in enumerate(rows):
        seen[r["source_key"]] += 1
        assert r["release"] <= r["slot"] < r["deadline"]
        if (i + 1) % 4 == 0:
            for s, c in slots.items():
                assert abs(seen[s] / 4 - (i + 1) / 4 * c / 64) < 1
    for s, n in names.items():
        times = Counter(r["row"]["doc_id"] for r in rows if r["source_key"] == s)
        assert len(times) == n and max(times.values()) - min(times.values()) <= 1
    out = X.mixed_documents(df)
    assert out.columns == df.columns and out.count() == len(rows) and {r["position"] for r in out.collect()} == {5}


def test_mix_without_broadcast(spark, monkeypatch):
    """Slots beyond the bound of a broadcast meet the documents by a shuffle, with the same mix."""
    counts = {"a": 400, "b": 60, None: 7}
    _, small = mixed(spark, counts, block=4)
    monkeypatch.setattr(X, "BROADCAST", 0)
    _, large = mixed(spark, counts, block=4)
    assert small == large


def test_mixing_query(spark, small):
    """Against a plain walk over the slots: who runs in each, and which of the source's documents, block by block."""
    rows = X.op6_mixing(spark, small).orderBy("position").collect()
    docs = [r["source"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    counts = Counter(docs)
    weights = X.whole({s: n**X.ALPHA for s, n in counts.items()})
    total, done, need, slot, at = sum(weights.values()), Counter(), {s: -(-n // X.BLOCK) for s, n in counts.items()}, 0, 0
    while any(done[s] < need[s] for s in counts):
        able = [s for s in counts if done[s] * total // weights[s] <= slot]
        s = min(able, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), s))
        for r in rows[at : at + X.BLOCK]:
            assert (r["source"], r["block"], r["slot"]) == (s, done[s], slot)
        done[s], slot, at = done[s] + 1, slot + 1, at + X.BLOCK
    assert at == len(rows) and [r["position"] for r in rows] == list(range(at))
    for s, n in counts.items():
        times = Counter(r["doc_id"] for r in rows if r["source"] == s)
        assert len(times) == n and max(times.values()) - min(times.values()) <= 1


def test_mix_keeps_sources_apart(spark):
    """A null source and one named like its stand-in, rows of one id, and columns named like the operator's own."""
    rows = [(1, None, "a"), (1, None, "b"), (1, "(null)", "c"), (2, "(null)", "c"), (2, "(null)", "c"), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS source_key", "2 AS slot", "3 AS __h", "4 AS `row`")
    out = X.mix(df, block=1).collect()
    assert {(r["row"]["source"], r["source_key"]) for r in out} == {(None, "(null)_"), ("(null)", "(null)"), ("x", "x")}
    assert X.mixed_documents(df).columns == df.columns
    one, two = (X.mix(d, block=1).select("row.text", "position").orderBy("position").collect() for d in (df, df.repartition(4)))
    assert one == two


def test_mix_weights_and_empty(spark):
    df, rows = mixed(spark, {"a": 64, "b": 64}, weights={"a": 3, "b": 1}, block=2, period=16)
    share = Counter(r["source_key"] for r in rows)
    assert share["a"] / len(rows) == pytest.approx(0.75, abs=0.02)
    assert X.mix(df.limit(0)).count() == 0 and X.mixed_documents(df.limit(0)).count() == 0
    _, only = mixed(spark, {"a": 33}, block=4, period=16)
    assert len({r["row"]["doc_id"] for r in only}) == 33


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packing_is_sound(sizes):
    lengths = (8, 16, 32, 64)
    sizes = sorted(sizes, reverse=True)
    where, offset, final = K.pack(sizes, lengths)
    filled = Counter()
    for b, o, n in sorted(zip(where, offset, sizes)):
        assert o == filled[b]
        filled[b] += n
    for b, n in filled.items():
        assert final[b] in lengths and n <= final[b] and not any(n <= c < final[b] for c in lengths)
    total = sum(K.cost(c, lengths) for c in final)
    assert total + 1e-6 >= K.lower_bound(sizes, lengths)
    for least in (None, *lengths):
        _, _, full = K.best_fit(sizes, lengths, least)
        assert total <= sum(K.cost(c, lengths) for c in K.downsized(full, lengths)) + 1e-9


def test_best_fit_takes_least_room():
    """Against a plain search over all open bins."""
    r = random.Random(4)
    sizes = sorted((r.randint(1, 60) for _ in range(300)), reverse=True)
    where, _, _ = K.best_fit(sizes, (64,), 64)
    room: list[int] = []
    for n, b in zip(sizes, where):
        fits = [x for x in room if x >= n]
        if fits:
            assert room[b] == min(fits)
        else:
            assert b == len(room)
            room.append(64)
        room[b] -= n


def test_pack_documents(spark):
    long = "é" * 70_000
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (4, long), (None, "xyz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS shard", "2 AS length", "3 AS bin_id")
    out = K.pack_documents(df, with_text=True).collect()
    text = "".join(r["text"] for r in sorted((r for r in out if r["doc_id"] == 4), key=lambda r: r["piece"]))
    assert text == long
    assert sorted(r["length"] for r in out if r["doc_id"] != 4) == [1, 1, 4, 4, 4]
    assert K.pack_documents(df.limit(0)).count() == 0


def test_packing_query(spark, small):
    rows = K.op10_packing(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    size = rows.assign(n=rows.length - 1).groupby("doc_id").n.sum()
    assert (size == docs.set_index("doc_id").text.str.len()).all()
    bins = rows.groupby("bin_id").agg(n=("length", "sum"), c=("capacity", "first"), k=("capacity", "nunique"))
    assert (bins.n <= bins.c).all() and (bins.k == 1).all()


# ------------------------------------------------------------------ nearest neighbours


def brute_nearest(rows, wanted, top=10):
    good = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    scale = 2.0 ** -np.frexp(max(np.abs(v).max() for v in good.values()))[1]
    out = {}
    for q in (i for i in good if wanted(i)):
        near = sorted((float(np.sqrt((((good[q] - v) * scale) ** 2).sum()) / scale), i) for i, v in good.items() if i != q)[:top]
        out[q] = near
    return out


@pytest.mark.parametrize("move", [lambda v: [1e8 + x for x in v], lambda v: [1e200 * x for x in v], lambda v: [(1e9 if v[0] > 0 else 0) + x for x in v]])
def test_neighbours_recall(spark, move):
    """Also far from the origin, beyond single precision, beyond the squares of a double, and in clusters far apart."""
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    same = rng.normal(size=16).tolist()
    rows = [(i, move(v)) for i, v in rows]
    same = move(same)
    rows += [(2000 + i, same) for i in range(400)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] + [1.0] * 15), (5300, [None] + [1.0] * 15), (5400, []), (None, same), (2000, same)]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<double>").selectExpr("*", "1 AS u", "2 AS q", "3 AS rep", "4 AS score")
    got: dict = {}
    for r in N.nearest(df, "vec_id % 100 = 0").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute_nearest(rows, lambda i: i % 100 == 0)
    assert set(got) == set(want)
    hit = sum(len({v for _, v in got[q].values()} & {v for _, v in want[q]}) for q in want)
    assert hit / (10 * len(want)) >= 0.9
    for q in (2000, 2100, 2200, 2300):
        assert [got[q][k] for k in range(1, 11)] == want[q]
    exact = {q: dict((i, s) for s, i in brute_nearest(rows, lambda i, q=q: i == q, len(rows))[q]) for q in list(want)[:3]}
    assert all(s == pytest.approx(exact[q][i], rel=1e-12) for q in exact for s, i in got[q].values())
    for q, near in got.items():
        assert sorted(near) == list(range(1, 11)) and [near[k] for k in range(1, 11)] == sorted(near.values())


def test_neighbours_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got: dict = {}
    for r in N.op9_neighbours(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, lambda i: i % 100 == 0)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert sum(len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) for q in want) >= 9 * len(want)


def test_neighbours_of_several_lengths(spark):
    """Shorter vectors count as filled up with zeros; nothing falls away."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, [0.0, 2.0, 0.0]), (3, [1.0, 0.0, 0.5])], "vec_id bigint, vec array<double>")
    got = [(r["vec_id"], r["score"]) for r in N.nearest(df, "vec_id = 0").orderBy("rank").collect()]
    assert got == [(1, 0.0), (3, 0.5), (2, pytest.approx(5**0.5))]


def test_neighbours_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, vec array<double>")
    assert [(r["rank"], r["vec_id"]) for r in N.nearest(df, "vec_id = 0").orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert N.nearest(df.limit(0), "vec_id = 0").count() == 0
    assert N.nearest(df.where("vec_id = 0"), "vec_id = 0").count() == 0


def test_neighbours_few_exchanges(spark):
    """However many dealings begin the graph, they and a round take few exchanges: each costs the driver threads and plans."""
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "u bigint, x array<double>")
    context = spark.sparkContext._jsc.sc()
    before = context.newShuffleId()
    graph = N.build_graph(points, 200_000, 8, change=1.0)
    assert context.newShuffleId() - before <= 16
    assert graph.count() > 500


def test_neighbours_both_ways(spark):
    """Reverse neighbours come in the same exchange; of a hub's the nearest, or the new ones first."""
    rows = [(i, [1000, i + 1], [float(i), 0.5], [i % 40 == 0, False]) for i in range(200)] + [(1000, [5, 300], [5.0, 9.0], [False, True])]
    graph = spark.createDataFrame(rows, "u bigint, ids array<bigint>, dist array<double>, new array<boolean>").repartition(3)
    near = {r["u"]: r for r in N._both_ways(graph, 6, 4, True).collect()}
    assert set(near) == {*range(201), 300, 1000}
    assert near[1000]["ids"] == [5, 300, 0, 1, 2, 3, 4, 5] and near[7]["ids"] == [1000, 8, 6] and near[300]["ids"] == [1000] and near[300]["new"] == [True]
    some = {r["u"]: r for r in N._both_ways(graph, 6, 4, False).collect()}
    assert len(some[1000]["ids"]) == 8 and some[1000]["ids"][:2] == [5, 300] and set(some[1000]["ids"][2:7]) == {0, 40, 80, 120, 160} and some[1000]["new"][2:] == [True] * 5 + [False]
    ids = [0, -1, 7, 2**63 - 1, -(2**63), *range(100, 150)]
    dealt = spark.createDataFrame([(i,) for i in ids], "i bigint").select(N._part("i", 37).alias("p")).collect()
    assert N._part_of(np.array(ids), 37).tolist() == [r["p"] for r in dealt]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(1500)] + [(i, i + 1) for i in range(5000, 5200)] + [(9000, i) for i in range(9001, 9400)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {n["node"]: n["comp"] for n in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == columns, name
        rows = spark.createDataFrame(out.collect(), out.schema)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = [(r["doc_id"], r["text"], r["n_chars"]) for r in rows.collect()]
        if name == "secrets":
            for key, text, n in after:
                found = S.find_secrets(before[key])[0]
                assert (text == before[key]) == (not found) and S.redact(before[key], found) == text and (n == len(text) or not found)
        elif name == "mixing":
            assert {k for k, _, _ in after} == set(before)
        else:
            assert all(before[k] == t for k, t, _ in after) and len(after) <= len(before)
        docs = rows
    packed = P.STAGES[-1][1](spark, docs, small).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in docs.collect()}


def test_pipeline_run(spark, small):
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    assert P.run(spark, small).count() > 0


ODD = ["1 AS cluster", "2 AS tile", "3 AS gone", "4 AS twice", "5 AS score", "6 AS __text", "7 AS __salt", "8 AS label", "9 AS `a.b`", "10 AS position", "11 AS rep", "12 AS c0", "13 AS __n", "14 AS piece", "15 AS mark"]


def test_stages_with_odd_rows_and_names(spark, small):
    """Columns named like the stages' own, nulls in every column, empty texts, repeated rows, and an empty table."""
    base = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    extra = spark.createDataFrame([(None, None, None, None, None), (1000, "", "en", None, 0), (1001, None, None, "s", None), (1002, "same words here " * 20, "en", "s", 320), (1002, "same words here " * 20, "en", "s", 320), (1003, "same words here " * 20, "en", "s", 320)], base.schema)
    docs = base.union(extra).selectExpr("*", *ODD)
    for name, stage in P.STAGES:
        out = stage(spark, docs, small)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns, name
        assert 0 < len(rows), name
        assert stage(spark, docs.limit(0), small).count() == 0, name
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (1002, 1003)) == [1002]
            assert {r["doc_id"] for r in rows} >= {None, 1000, 1001}
