"""The learned operators: quality, URL filters, language."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wordmill.llm import language as L
from wordmill.llm import quality as Q
from wordmill.llm import urls as U
from wordmill.llm.common import arrow_text

MEDIUM = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    got = Q.op2_quality(spark, MEDIUM).toPandas()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    rank = held.score.rank()
    good = held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.9 and (held.predicted == held.quality).mean() > 0.9


def test_network_batches_equal_singles():
    rng = np.random.default_rng(1)
    net = Q.Network(rng.normal(size=(Q.WIDTH, 256, Q.FILTERS)).astype(np.float32), np.zeros(Q.FILTERS, np.float32), rng.normal(size=2 * Q.FILTERS).astype(np.float32), 0.1)
    texts = [b"", b"a", b"word " * 50, bytes(range(256)) * 9, b"x" * 511, b"y" * 512, b"z" * 513, b"long " * 150_000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = net.scores(data, offsets)
    for t, s in zip(texts, together):
        padded = np.frombuffer(t + bytes(Q.WIDTH - 1 + (not t)), np.uint8)
        act = np.maximum(sum(net.kernel[j][padded[j : len(padded) - Q.WIDTH + 1 + j]] for j in range(Q.WIDTH)), 0)
        tiles = np.stack([act[i : i + Q.CHUNK // 2].max(0) for i in range(0, len(act), Q.CHUNK // 2)])
        chunks = np.maximum(tiles[:-1], tiles[1:]) if len(tiles) > 1 else tiles
        want = 1 / (1 + np.exp(-(net.head @ np.concatenate([chunks.mean(0), chunks.max(0)]) + net.offset)))
        assert s == pytest.approx(want, abs=1e-4)


def test_quality_model_depends_on_rows_only(spark):
    """Ids with both labels, repeated rows and different texts under one id; whole texts; two partitionings give one model."""
    words = np.array(["good", "fine", "text", "words", "http", "click", "buy", "###"])
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(words[4:] if i % 2 else words[:4], 40))) for i in range(80)]
    docs += [(0, "other text"), (1, docs[1][1]), (200, "long " * 5_000), (None, "x"), (3, None)]
    labels = [(i, 1 - i % 2, 0) for i in range(80)] + [(4, 0, 0), (200, 1, 1), (None, 1, 0), (7, None, 0), (8, 5, 0)]
    a = Q.train(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    b = Q.train(spark.createDataFrame(docs[::-1], "doc_id bigint, text string").repartition(5), spark.createDataFrame(labels[::-1], "doc_id bigint, quality int, toxic int").repartition(3))
    assert all((x == y).all() for x, y in zip((a.kernel, a.bias, a.head), (b.kernel, b.bias, b.head))) and a.offset == b.offset
    s = a.scores(*arrow_text(pa.array([t for _, t in docs[:80]])))
    assert s[::2].min() > s[1::2].max()


def test_gradient_step_lowers_loss():
    """The whole text counts: only the last tile of long texts tells the labels apart."""
    texts = [b"same words " * 300 + (b"GOOD ending" if i % 2 else b"zzz ending!") for i in range(40)]
    y = np.arange(40) % 2 * 1.0
    net = Q.fit(texts, y, np.ones(40), epochs=30)
    data = np.frombuffer(b"".join(texts), np.uint8)
    s = net.scores(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert s[1::2].min() > s[::2].max()


def test_quality_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS c0", "2 AS score", "3 AS __text", "4 AS `a.b`")
    out = Q.with_scores(df, 0.25, df.columns, "other")
    assert out.columns == [*df.columns, "other"] and [r["other"] for r in out.collect()] == [0.25] * 4
    assert Q.with_scores(df.limit(0), 0.25, ["doc_id"]).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert Q.train(docs, none) == 0.5
    assert [r["score"] for r in Q.with_scores(docs, 0.5, ["doc_id"]).collect()] == [0.5, 0.5]


@pytest.mark.parametrize("url", ["https://A.Example.ORG/es/1?x#y", "nothing", None, "", "x://h", "x://h?q/a", "a://b://c/d", "http://org/", "http://Ä.com/fr/", "http://h\n.org/p\nq"])
def test_host_path(spark, url):
    df = spark.createDataFrame([(url,)], "url string")
    host, path = U.host_and_path(df["url"])
    assert tuple(df.select(host, path).first()) == U.brute_host_path(url)


def test_rules(spark):
    rows = [("x.org", "/a", "org/"), ("org", "/", "org/"), ("xorg", "/", None), ("example.org", "/es/1", "example.org/es/"), ("a.example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("x.com", "/fr/", "com/fr/"), ("x.com", "/fr", None), ("x.org", "", None)]
    df = spark.createDataFrame(rows, "host string, path string, want string")
    text, _ = U.matched_rule(df["host"], df["path"])
    assert [r[0] for r in df.select(text).collect()] == [r[2] for r in rows]


def test_url_model(spark):
    """Verdicts of ruled URLs are the rules'; the model alone, without rules, separates the classes it learned."""
    got = U.op5_urls(spark, MEDIUM).toPandas()
    assert len(got) == 250 and set(got.verdict) == {"allow", "block"}
    said = {r.text: r.verdict for r in U.RULES}
    ruled = got[got.rule.notna()]
    assert (ruled.verdict == ruled.rule.map(said)).all()
    good = ruled[ruled.verdict == "allow"].score
    bad = ruled[ruled.verdict == "block"].score
    assert good.mean() > bad.mean()
    rank = ruled.score.rank()[ruled.verdict == "allow"].sum()
    assert (rank - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad)) > 0.9


def test_url_probabilities_sum_to_one():
    """Over the next symbol, for a model without colliding slots."""
    grams, contexts, _ = U._grams([b"abab", b"abba"])
    counts = np.zeros((2, 2, U.ORDER + 1, U.SLOTS), np.float32)
    for k in range(U.ORDER + 1):
        counts[1, 0, k] = np.bincount(grams[k], minlength=U.SLOTS)
        counts[1, 1, k] = np.bincount(contexts[k], minlength=U.SLOTS)
    total = 0.0
    for byte in range(257):
        end = bytes([byte]) if byte < 256 else b""
        g, c, _ = U._grams([b"ab" + end])
        p = 1 / 257
        for k in range(U.ORDER + 1):
            n = counts[1, 1, k, c[k][2]]
            hit = counts[1, 0, k, g[k][2]] if byte != 3 else 0
            p = (hit + U.STRENGTH * p) / (n + U.STRENGTH)
        total += p
    assert total == pytest.approx(1, abs=1e-3)


def test_url_counts_are_exact(spark):
    """Scores equal those from plain dictionaries, with more different n-grams than a table of fixed size has places."""
    rng = np.random.default_rng(5)
    urls = ["http://h.org/" + bytes(rng.integers(33, 127, 90, dtype=np.uint8)).decode() for _ in range(4_000)]
    rows = [(u, "allow" if i % 2 else "block") for i, u in enumerate(urls)]
    model = U.train(spark.createDataFrame(rows, "url string, verdict string").repartition(3))
    assert len(model.keys) > 2 * U.SLOTS

    def windows(u):
        b = b"\x02" * U.ORDER + u.encode() + b"\x03"
        return [[b[i - k : i + 1] for k in range(U.ORDER + 1)] for i in range(U.ORDER, len(b))]

    grams, contexts = ({c: Counter() for c in ("allow", "block")} for _ in range(2))
    for u, c in rows:
        if zlib.crc32(u.encode()) % 5:
            for w in windows(u):
                grams[c].update(w)
                contexts[c].update((len(g), g[:-1]) for g in w)
    for u, got in zip(urls[:40], model.scores([u.encode() for u in urls[:40]])):
        total = 0.0
        for sign, c in ((1, "allow"), (-1, "block")):
            for w in windows(u):
                p = 1 / 257
                for g in w:
                    p = (grams[c][g] + U.STRENGTH * p) / (contexts[c][len(g), g[:-1]] + U.STRENGTH)
                total += sign * np.log(p)
        assert got == pytest.approx(total / (len(u) + 1))


def test_url_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (3, "no scheme"), (4, "http://x.org/a"), (5, "http://x.com/de/a")], "page_id bigint, url string")
    rows = U.judge(df).collect()
    assert len(rows) == 6
    said = {r["page_id"]: (r["verdict"], r["score"]) for r in rows}
    assert said[4][0] == "allow" and said[5][0] == "block" and said[1] == said[2]
    model = U.train(df.selectExpr("url", "CASE page_id WHEN 4 THEN 'allow' WHEN 5 THEN 'block' END AS verdict"))
    empty = "allow" if model == "allow" or not isinstance(model, str) and model.scores([b""])[0] > model.threshold else "block"
    assert said[1][0] == empty  # null and empty urls are the model's to judge
    assert U.judge(df.limit(0)).count() == 0


def brute_word(word: bytes, prob: dict[bytes, float], longest: int) -> float:
    """The logarithm of the sum over all segmentations, scaled at each place."""
    alpha, total = [1.0] + [0.0] * len(word), 0.0
    for p in range(1, len(word) + 1):
        for q in range(max(0, p - longest), p):
            alpha[p] += alpha[q] * prob.get(word[q:p], 0.0)
        if p % 4 == 0:
            total += np.log(alpha[p])
            low = max(0, p - longest)
            alpha[low : p + 1] = [x / alpha[p] for x in alpha[low : p + 1]]
    return total + float(np.log(alpha[-1]))


@pytest.mark.parametrize("few", [1, 24])
def test_forward_sums_all_segmentations(monkeypatch, few):
    """Words of any length, alone and in groups, also with pieces of many bytes and without spaces."""
    monkeypatch.setattr(L, "FEW", few)
    monkeypatch.setattr(L, "WINDOW", 70)
    texts = ["the cat sat on the mat", "die Katze saß auf der Matte", "internationalisation überall " + "Donaudampfschifffahrt" * 10, "х" * 120 + " " + "администрация" * 9, "".join(f"{i}abc" for i in range(60)), "z" * 1000 + " " + "y" * 990]
    model = L.fit(texts, ["en", "de", "de", "ru", "en", "en"])
    listed = L.vocabulary()
    assert model.pieces.longest > 16
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = model.log_likelihoods(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for c in range(3):
        prob = dict(zip(listed, model.prob[:, c]))
        for i, t in enumerate(texts):
            assert got[i, c] == pytest.approx(sum(brute_word(b" " + w, prob, model.pieces.longest) for w in t.encode().split())), (i, c)
    assert model.prob.sum(0) == pytest.approx(1)


def test_expected_uses_of_short_and_long_words_agree(monkeypatch):
    texts = ["internationalisation of the organisations", "Donaudampfschifffahrtsgesellschaft und Kapitän"]
    plain = L.fit(texts, ["en", "de"]).prob
    monkeypatch.setattr(L, "SHORT", 4)
    assert L.fit(texts, ["en", "de"]).prob == pytest.approx(plain, rel=1e-6)


def test_many_languages_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefghij") + [chr(97 + k % 26)] * 4, rng.integers(2, 9))) for _ in range(3000)) for k in range(60)]
    names = [f"l{k:02d}" for k in range(60)]
    tracemalloc.start()
    model = L.fit(texts, names, rounds=1)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    logs = model.log_likelihoods(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and (logs.argmax(1) == np.arange(60)).mean() > 0.9


def test_letters():
    assert [L.has_letter(t) for t in ("½", "²", "12½", "_", "", None, "a", "é", "ß", "ª", "字", "ʰ")] == [False] * 6 + [True] * 6


def test_language_held_out(spark):
    got = L.op8_language(spark, MEDIUM).toPandas()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(docs, on="doc_id")
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    model = L.fit(["the cat and the dog"] * 3 + ["der Hund und die Katze"] * 3, ["en"] * 3 + ["de"] * 3)
    rows = [(1, None), (2, ""), (3, "123 !? —"), (4, "the dog"), (4, "the dog"), (5, "die " + "x" * 200_000), (None, "der Hund")]
    got = L.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "en", got[5]["lang_pred"], "de"]
    assert [r["score"] for r in got[:3]] == [0, 0, 0]
    none = L.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), L.train(spark.createDataFrame([], "doc_id bigint, text string, lang string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
