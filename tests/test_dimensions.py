from __future__ import annotations

import itertools
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordmill.operators import analysis as A
from wordmill.operators import vocabulary as V
from wordmill.sources import dimensions as D
from wordmill.sources import tables as T


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), "utf-8")
    return str(path)


def test_lexicon_from_files(spark, tmp_path):
    """Parquet and JSON give one lexicon; weights come from the frequency list; the join works beyond the broadcast size."""
    rows = [{"form": "Pankkiin", "lemma": "pankki", "pos": "NOUN", "feats": "Case=Ill|Number=Sing", "gloss": "bank"}, {"form": "on", "lemma": "olla", "pos": "VERB", "weight": 7}]
    rows += [{"form": f"sana{i}", "lemma": f"sana{i}", "pos": "NOUN"} for i in range(30_000)]
    frequency = D.read_frequency(spark, lines(tmp_path / "f.json", [{"lemma": "pankki", "pos": "NOUN", "weight": 5}]))
    lexicon = D.read_lexicon(spark, lines(tmp_path / "l.json", rows), frequency)
    lexicon.write.parquet(str(tmp_path / "l.parquet"))
    again = D.read_lexicon(spark, str(tmp_path / "l.parquet"))
    assert again.exceptAll(lexicon).count() == 0 and lexicon.count() == len(rows)
    tokens = A.tokens(spark.createDataFrame([(1, "FI", "Menin pankkiin. sana29999 on!")], "deck_id bigint, lang string, text string"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = {r["form"]: (r["lemma"], r["guessed"]) for r in V.best_analysis(V.candidates(tokens, again)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert best == {"Menin": ("menin", True), "pankkiin.": ("pankki", False), "sana29999": ("sana29999", False), "on!": ("olla", False)}
    with pytest.raises(ValueError, match="1 rows"):
        D.read_lexicon(spark, lines(tmp_path / "bad.json", [{"form": "x", "pos": "NOUN"}]))


def test_labels_and_phrases_from_files(spark, tmp_path):
    labels = D.read_labels(spark, lines(tmp_path / "labels.json", [{"pos": "NOUN", "feats": "Case=Ill", "label": "b"}, {"pos": "NOUN", "feats": "Case=Ill", "label": "a"}]))
    assert [(r["feats"], r["label"]) for r in labels.collect()] == [("Case=Ill", "a")]
    path = lines(tmp_path / "p.json", [{"id": 2, "name": "x", "pattern": [["take"], ["a", "the"], [], ["off"]]}, {"id": 1, "name": "y", "pattern": [["take"], ["off"]]}])
    phrases = D.read_phrases(spark, path)
    assert phrases == [(1, "y", ("take", "off")), (2, "x", ("take", frozenset({"a", "the"}), None, "off"))]
    rows = spark.createDataFrame([(1, 0, "take the day off".split()), (1, 1, "take one day off".split())], "deck_id bigint, sentence_ix int, words array<string>")
    assert [(r["sentence_ix"], r["mwe_id"]) for r in V.phrase_matches(rows, phrases).collect()] == [(0, 2)]
    with pytest.raises(ValueError, match="more than 1"):
        D.read_phrases(spark, path, most=1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=4).filter(lambda p: p[0]), min_size=1, max_size=4))
def test_segmentation_covers_most(words, patterns):
    """Against all sets of matches that don't overlap."""
    phrases = [(i, "", tuple(p)) for i, p in enumerate(patterns)]
    hits = [(s, len(p), i) for i, _, p in phrases for s in range(len(words) - len(p) + 1) if all(x is None or words[s + j] == x for j, x in enumerate(p))]
    spans = sorted({(s, n) for s, n, _ in hits})
    most = 0
    for k in range(len(spans) + 1 if len(spans) < 12 else 4):
        for some in itertools.combinations(spans, k):
            if all(a[0] + a[1] <= b[0] for a, b in zip(some, some[1:])):
                most = max(most, sum(n for _, n in some))
    got = V.segment(words, V.phrase_tree(phrases))
    assert all(g in hits for g in got) and all(a[0] + a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert sum(n for _, n, _ in got) >= most if len(spans) >= 12 else sum(n for _, n, _ in got) == most


def test_observed(spark, small):
    frame, watch = A.observed(A.sentences(T.deck_texts(spark, small)), "sentences")
    n = frame.count()
    assert watch.get["rows"] == n and watch.get["decks"] > 150
