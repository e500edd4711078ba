from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wordmill.llm import jaccard as J
from wordmill.llm.common import arrow_text, released, shingle_sets


def brute_sets(rows):
    out = {}
    for key, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[key] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows):
    sets = brute_sets(rows)
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    places = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            places[x].append(k)
    common: dict = defaultdict(int)
    for keys in places.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def corpus(seed=0):
    """Copies, near copies around the limit, a passage in many texts, short and empty ones, chains."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = r.choices(words, k=60)
    rows, key = [], 0

    def add(w):
        nonlocal key
        rows.append((key, " ".join(w)))
        key += 1

    for _ in range(12):
        base = r.choices(words, k=r.randint(5, 90))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words).upper()
            add(w)
    for _ in range(30):
        add(r.choices(words, k=r.randint(0, 60)) + passage + r.choices(words, k=r.randint(0, 60)))
    chain = r.choices(words, k=60)
    for i in range(25):
        chain[(2 * i) % 60] = f"c{i}"
        add(chain)
    rows += [(key, None), (key + 1, ""), (key + 2, " \t\n"), (key + 3, "one"), (key + 4, "ONE"), (key + 5, "a b c d"), (key + 6, "A\x0bB\x0cC d")]
    return rows


@pytest.mark.parametrize(("tile", "hot"), [(512, 48), (4, 3)])
def test_components(spark, monkeypatch, tile, hot):
    monkeypatch.setattr(J, "TILE_DOCS", tile)
    monkeypatch.setattr(J, "HOT_DF", hot)
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_hot_groups(spark, monkeypatch):
    """A third of all rows are copies of one text, a third near copies of another, and many texts share most of a passage."""
    monkeypatch.setattr(J, "TILE_DOCS", 32)
    monkeypatch.setattr(J, "HOT_DF", 6)
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    copy, near, passage = (" ".join(r.choices(words, k=60)) for _ in range(3))
    rows = [(i, copy) for i in range(20_000)]
    for i in range(20_000, 20_600):
        w = near.split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    for i in range(20_600, 20_800):
        rows.append((i, passage + " " + " ".join(r.choices(words, k=r.randint(8, 30)))))
    distinct = [(0, copy), *rows[20_000:]]
    want = brute(distinct)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7, "doc_id")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.similar_documents(df).collect()}
    assert len(got) == len(rows) and all(got[i] == want[0] for i in range(20_000))
    assert {i: got[i] for i in want} == want
    assert len({want[i][1] for i in range(20_600, 20_800)}) > 20  # many components share the passage's shingles


def test_rare_shingles_need_no_join(spark, monkeypatch):
    """Texts that share passages of few others make one large cluster; their shingles are neither counted nor joined."""
    monkeypatch.setattr(J, "TILE_DOCS", 16)
    joined = []
    plain = J.spread_join

    def spread_join(many, few, keys, by, how="inner"):
        if keys == ["token"]:
            joined.append(many.count())
        return plain(many, few, keys, by, how)

    monkeypatch.setattr(J, "spread_join", spread_join)
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    parts = [r.choices(words, k=20) for _ in range(101)]
    rows = [(i, " ".join(parts[i] + parts[i + 1])) for i in range(100)] + [(100 + i, " ".join(parts[i] + parts[i + 1][:-1])) for i in range(100)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)
    assert not any(n > 400 for n in joined)  # counted are only the few shingles of what is left


def test_cold_pairs():
    """All tokens of one size at once give the pairs that a loop gives."""
    r = random.Random(5)
    rows = [(t, d, d % 9, 10 + d % 7) for t in range(300) for d in r.sample(range(60), r.choice([1, 2, 3, 17, 48]))]
    r.shuffle(rows)
    got = [x for b in J._cold_pairs([pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["token", "doc", "label", "n"])]) for x in zip(*(c.to_pylist() for c in b.columns))]
    by = defaultdict(list)
    for t, *row in rows:
        by[t].append(row)
    want = {(min(a, b), max(a, b)) for x in by.values() for a, k, m in x for b, l, n in x if k != l and 4 * m >= 3 * n and 4 * n >= 3 * m}
    assert len(got) == len(set(got)) and set(got) == want
    assert not list(J._cold_pairs([]))


def test_hot_shingles_are_counted_in_the_tasks(spark):
    """Hot shingles give a row for each task, not one for each document; filters may add documents but lose none."""
    rows = [(d, d % 7, 50, [100 + d % 3, 200]) for d in range(90)] + [(90, 1, 50, []), (91, 1, 50, [300])]
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)] + [pa.array([x[3] for x in rows], pa.list_(pa.int64()))], ["doc", "label", "n", "hot"])
    (counts,) = J._hot_counts([batch.select(["label", "hot"]), batch.slice(0, 0).select(["label", "hot"])])
    assert sorted(zip(*(c.to_pylist() for c in counts.columns))) == [(100, 30, 0, 6), (101, 30, 0, 6), (102, 30, 0, 6), (200, 90, 0, 6), (300, 1, 1, 1)]
    assert not list(J._hot_counts([])) and not list(J._hot_counts([batch.slice(90, 1).select(["label", "hot"])]))
    known, bits = J._known(spark.createDataFrame([(101,), (300,)], "token bigint"))
    sent = [x for b in J._of_hot(known, bits)([batch]) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert {x for x in sent if x[0] in (101, 300)} == {(101, d, d % 7, 50) for d in range(1, 90, 3)} | {(300, 91, 1, 50)}
    docs = [d for b in J._with_hot(known, bits)([batch.slice(1)]) for d in b.column(0).to_pylist()]
    assert {*range(1, 90, 3), 91} <= {*docs} and 90 not in docs and len(docs) == len(set(docs))


def test_workers_give_memory_back():
    """A task's freed pieces below a piece that stays are given back at its end."""
    stays = []

    def run(batches):
        pieces = [np.ones(8_000) for _ in range(3_000)]
        stays.append(pieces[-1])
        yield len(pieces)

    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

    before = resident()
    assert list(released(run)([])) == [3_000]
    assert resident() - before < 60


def written(spark):
    """Records that shuffles have written so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_unique_documents_stay_where_they_are(spark):
    """Of 3,000 documents ten are copies: only these (and what the filter can't tell from them) are shuffled for the join."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=12))) for i in range(2_990)]
    rows += [(2_990 + i, rows[i][1]) for i in range(10)]
    kept = J.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = written(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted(x["doc_id"] for x in kept.collect()) == list(range(2_990))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert written(spark) - before < 300


def test_filters_grow():
    small, mid, large = (J.Sizes.of(n) for n in (1_000, 30 << 30, 100 << 40))
    assert small.repeated < mid.repeated <= large.repeated <= 30 and small.bucket < mid.bucket <= large.bucket
    for s in (small, mid, large):
        assert s.token - s.bucket <= 32 and s.repeated - s.bucket >= 3 and s.hot - s.bucket >= 2 and s.token >= s.repeated


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.op3_jaccard(spark, small).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(7, "a b c d e f", "x"), (7, "a b c d e f", "x"), (None, "a b c d e f", "y"), (3, "A b c d e f", "z"), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cluster string").selectExpr("*", "1 AS doc", "2 AS node", "3 AS comp", "4 AS component_id", "5 AS n")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similar_documents(df).collect()), key=str)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (None, 2, None), (3, 2, 3), (9, 0, 9)], key=str)
    kept = J.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["cluster"]) for r in kept.collect()), key=str) == sorted([(3, "z"), (None, "y"), (9, None)], key=str)
    assert J.similar_documents(df.limit(0)).count() == 0
    assert J.deduplicate(df.limit(0)).count() == 0


def test_long_text_in_segments():
    word = "abc def ghi jkl mno pqr "
    text = "".join(f"{word}{i} " for i in range(60_000))
    data, offsets = arrow_text(pa.array(["x y", text, None, "tail " * 3]))
    sets = shingle_sets(data, offsets)
    want = brute_sets([(1, text)])[1]
    assert [len(s) for s in sets] == [1, len(want), 0, 1]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)
        for _ in range(3):
            s = base.copy()
            s[: len(s) // 8] = rng.integers(0, 2**63, len(s) // 8, dtype=np.uint64)
            sets.append(np.unique(s))
    want = {(a, b) for a in range(len(sets)) for b in range(a) if J.linked(sets[a], sets[b])}
    got = {(max(p), min(p)) for p in zip(*(x.tolist() for x in J.SignatureTree(sets).pairs()))}
    assert want <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_filters_stay_small():
    """A filter of 32 MB with few marks goes through the driver in a fraction of that, and comes out as it was."""
    import pickle

    marks = np.zeros((256, 1 << 17), np.uint8)
    marks[::16, 5::4096] = 7
    sent = pickle.dumps(J.Filter([(i, J._pack(m)) for i, m in enumerate(marks)], 28, 8))
    assert len(sent) < 1 << 20 and (pickle.loads(sent).array() == marks.ravel()).all()
