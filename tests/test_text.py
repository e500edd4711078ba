from __future__ import annotations

from pyspark.sql import functions as F

from wordmill.functions import text as X
from wordmill.operators import analysis as A
from wordmill.operators import vocabulary as V
from wordmill.plans.queries import QUERIES
from wordmill.sources import tables as T

GOLDEN = "Toissapäivänä menin pankkiin. Osoittautui, että se oli kiinni. No, leuka rintaan ja kohti uusia pettymyksiä!"


def texts(spark, rows):
    return spark.createDataFrame([(i, "FI", t) for i, t in enumerate(rows)], "deck_id bigint, lang string, text string")


def split(spark, rows):
    out: dict[int, list[str]] = {i: [] for i in range(len(rows))}
    for r in A.sentences(texts(spark, rows)).orderBy("deck_id", "sentence_ix").collect():
        out[r["deck_id"]].append(r["text"])
    return list(out.values())


def test_sentences(spark):
    rows = ["Hei. Miten menee? Hyvää!", None, "", "   ", "A.B c... d! e", "? ! x", "ä", "yksi\u0000 kaksi", GOLDEN]
    got = split(spark, rows)
    assert got[0] == ["Hei.", "Miten menee?", "Hyvää!"]
    assert got[1:4] == [[], [], []]
    assert got[4] == ["A.B c...", "d!", "e"]
    assert got[5] == ["?", "!", "x"]
    assert got[6] == ["ä"]
    assert got[7] == ["yksi\u0000 kaksi"]
    assert len(got[8]) == 3


def test_white_space(spark):
    rows = [f"a{c}b" for c in " \u0085 　​"]
    sizes = [r["n"] for r in A.tokens(texts(spark, rows)).groupBy("deck_id").agg(F.count("*").alias("n")).orderBy("deck_id").collect()]
    assert sizes == [2, 2, 2, 2, 1]


def test_pos(spark):
    want = {"puhua": "NOUN", "hyvää": "VERB", "maa": "VERB", "voi": "VERB", "menin": "VERB", "suomalainen": "VERB", "ihminen": "VERB", "taloihin": "VERB", "pankkiin": "VERB", "pankkiin.": "NOUN", "talossa": "NOUN", "pöydällä": "NOUN", "HYVÄÄ": "VERB"}
    df = spark.createDataFrame([(w,) for w in want], "w string")
    assert {r["w"]: r["p"] for r in df.select("w", X.pos(F.col("w")).alias("p")).collect()} == want
    longest = {r["w"]: r["p"] for r in df.select("w", X.pos(F.col("w"), "longest_suffix").alias("p")).collect()}
    assert longest["suomalainen"] == "ADJ" and longest["ihminen"] == "ADJ" and longest["pankkiin"] == "NOUN"


def test_golden_tokens(spark):
    rows = A.tokens(texts(spark, [GOLDEN])).orderBy("sentence_ix", "token_ix").collect()
    assert len(rows) == 15
    assert [r["form"] for r in rows if r["pos"] == "VERB"] == ["menin"]
    assert all(r["lemma"] == r["form"].lower() and r["grammar_label"] == f"{r['pos']} (stub)" and r["mwe_id"] is None for r in rows)


def test_nested_analysis(spark):
    row = A.analyze(texts(spark, ["Hei miten menee"])).first()
    assert [t["form"] for t in row["analysis"]["sentences"][0]["tokens"]] == ["Hei", "miten", "menee"]
    assert row["analysis"]["sentences"][0]["tokens"][0]["feats"] == {}


def test_stored_sentence_splits_into_itself(spark):
    stored = A.sentence_texts(texts(spark, [GOLDEN, "a.  b\n\nc! d"]))
    again = A.sentences(stored.select("deck_id", "lang", "text").withColumn("deck_id", F.monotonically_increasing_id()))
    assert {r["text"] for r in stored.collect()} == {r["text"] for r in again.collect()}


def test_display(spark):
    df = spark.createDataFrame([("The <b> the & a.b axb",)], "t string")
    assert df.select(X.highlight(X.escape_html(F.col("t")), "THE").alias("x")).first()[0] == '<span class="highlight">The</span> &lt;b&gt; <span class="highlight">the</span> &amp; a.b axb'
    assert df.select(X.highlight(F.col("t"), "a.b").alias("x")).first()[0].count("span class") == 1
    counts = F.array(F.struct(F.lit("Deck A").alias("deck"), F.lit(1).alias("count")), F.struct(F.lit("Deck B").alias("deck"), F.lit(2).alias("count")))
    assert df.select(X.deck_count_string(counts)).first()[0] == "1× Deck A, 2× Deck B"
    assert [r[0] for r in spark.createDataFrame([("word",), ("generated",), ("x",), (None,)], "m string").select(X.badge(F.col("m"))).collect()] == ["WORD", "GENERATED", "NEW", "NEW"]
    assert [r[0] for r in spark.createDataFrame([("7",), ("0",), ("x",), (None,)], "c string").select(X.cookie_user(F.col("c"))).collect()] == [7, 1, 1, 1]
    assert [r[0] for r in spark.createDataFrame([("talokin,", "FI"), ("talo", "FI"), ("Onkopa!", "FI"), ("napkin", "en"), ("pumpkin", None)], "c string, l string").select(X.enclitic(F.col("c"), F.col("l"))).collect()] == ["kin", "", "pa", "", ""]


def test_phrases(spark):
    words = F.transform(X.tokens(F.col("text")), lambda w: F.lower(X.bare(w)))
    sentences = A.sentences(texts(spark, [GOLDEN, "in the house of the of the", "de la la de la"])).select("deck_id", "sentence_ix", words.alias("words"))
    got = {(r["deck_id"], r["start"], r["mwe_id"]) for r in V.phrase_matches(sentences, T.PHRASES).collect()}
    assert got == {(0, 1, 1), (1, 0, 3), (1, 5, 2), (2, 0, 4), (2, 3, 4)}


def test_lexicon(spark):
    tokens = A.tokens(texts(spark, [GOLDEN]))
    lexicon, labels = T.lexicon(spark), T.labels(spark)
    best = V.label(V.best_analysis(V.candidates(tokens, lexicon)), labels)
    got = {r["form"]: (r["lemma"], r["label"]) for r in best.collect()}
    assert got["Toissapäivänä"] == ("toissapäivä", "Essive singular (-na/-nä)")
    assert got["pankkiin."] == ("pankki", "Illative singular (-iin)")
    assert got["oli"] == ("oli", "NOUN (stub)")
    found = V.candidates(tokens, lexicon)
    path = V.viterbi(found, V.transition_counts(V.best_analysis(found)))
    assert path.count() == 15
    made = V.generate(A.sentence_texts(texts(spark, ["This is it."])), lexicon, {"Mood=Ind|Number=Sing|Person=3|Tense=Pres": "Mood=Ind|Number=Sing|Person=3|Tense=Past"}).collect()
    assert [r["generated"] for r in made] == ["This was it."]


def test_tagged_sentences(spark, small):
    """The same paths as over exploded tokens, without a shuffle of them; sentences that begin, end and run through ambiguous words."""
    odd = [GOLDEN, "that that on was die on that. on", "Was on that? x that y was z w on v.", "die die die die", "...", None, ""]
    sample = texts(spark, odd).unionByName(T.deck_texts(spark, small).select("deck_id", "lang", "text").where("deck_id >= 100"))
    columns = ["deck_id", "sentence_ix", "token_ix", "form", "lemma", "pos"]
    for lexicon in (T.lexicon(spark), T.lexicon(spark).limit(0)):
        found = V.candidates(A.tokens(sample), lexicon)
        want = V.viterbi(found, V.transition_counts(V.best_analysis(found))).select(columns).collect()
        got = V.tagged_sentences(A.sentences(sample), lexicon)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert len(want) > 1000 and sorted(want) == sorted(got.select(columns).collect())
    plan = QUERIES["t13_viterbi"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


def test_reject_reasons(spark):
    rows = [("t", "FI", "x", None), ("", "FI", "x", "title"), ("t", "fi", "x", "lang"), ("t", "ET", "a" * 11, "size"), ("t", "ET", " \n ", "blank"), ("t", "ET", None, "blank"), (None, None, None, "title")]
    df = spark.createDataFrame(rows, "title string, lang string, text string, want string")
    for r in df.withColumn("got", A.reject_reason(max_bytes=10)).collect():
        assert r["got"] == r["want"], r
