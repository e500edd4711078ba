"""The domain's tables, computed from the input tables at load time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "FI", "ET")
USERS, CARDS = 150, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owner(deck_id: Column) -> Column:
    """The user of a deck."""
    return deck_id % USERS


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, title, lang, created_at: one deck for each document; an hour's decks share a timestamp."""
    docs = table(spark, sf_dir, "documents")
    hour = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id div 7 as int), 0, 0)")
    return docs.select(F.col("doc_id").alias("id"), owner(F.col("doc_id")).alias("user_id"), F.col("source").alias("title"), "lang", hour.alias("created_at"))


def deck_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deck_id, lang, text as uploaded."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("deck_id"), "lang", "text")


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, card_id, k, ts, quality (0 Again .. 3 Easy) from the events that answer a card."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    quality = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3)
    out = events.select("event_id", "user_id", k.alias("k"), "ts", quality.alias("quality")).where("quality is not null and k is not null")
    return out.withColumn("card_id", F.col("user_id") * 1000 + F.col("k"))


def known_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, k: cards that a signup event marks as known."""
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null").distinct()


def ignored_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, k: every card number that is 13 more than a multiple of 29 from the user's number."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    numbers = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(CARDS - 1))).alias("k"))
    return numbers.where((F.col("user_id") + F.col("k")) % 29 == 13)


#: A toy lexicon: form, lemma, pos, features, gloss, weight. Words of the golden text and a few ambiguous ones of the test prose.
LEXICON = (
    ("toissapäivänä", "toissapäivä", "NOUN", "Case=Ess|Number=Sing", "the day before yesterday", 5),
    ("menin", "mennä", "VERB", "Mood=Ind|Number=Sing|Person=1|Tense=Past", "go", 9),
    ("pankkiin", "pankki", "NOUN", "Case=Ill|Number=Sing", "bank", 7),
    ("pankissa", "pankki", "NOUN", "Case=Ine|Number=Sing", "bank", 4),
    ("kiinni", "kiinni", "ADV", "", "closed", 3),
    ("leuka", "leuka", "NOUN", "Case=Nom|Number=Sing", "chin", 3),
    ("rintaan", "rinta", "NOUN", "Case=Ill|Number=Sing", "chest", 2),
    ("the", "the", "DET", "", "the", 90),
    ("that", "that", "DET", "", "that", 30),
    ("that", "that", "CONJ", "", "that", 40),
    ("on", "on", "ADP", "", "on", 60),
    ("on", "olla", "VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Pres", "be", 20),
    ("die", "die", "DET", "", "the", 50),
    ("die", "die", "VERB", "Tense=Pres", "die", 2),
    ("la", "la", "DET", "", "the", 50),
    ("is", "be", "VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Pres", "be", 30),
    ("was", "be", "VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Past", "be", 25),
    ("was", "was", "PRON", "", "what", 10),
    ("ist", "sein", "VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Pres", "be", 30),
)

#: Labels of feature strings (fixed values where the product text gives them).
LABELS = (
    ("NOUN", "Case=Ill|Number=Sing", "Illative singular (-iin)"),
    ("NOUN", "Case=Ess|Number=Sing", "Essive singular (-na/-nä)"),
    ("NOUN", "Case=Ine|Number=Sing", "Inessive singular (-ssa/-ssä)"),
    ("NOUN", "Case=Nom|Number=Sing", "Nominative singular"),
    ("VERB", "Mood=Ind|Number=Sing|Person=1|Tense=Past", "Past, 1st sg"),
    ("VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Pres", "Present, 3rd sg"),
    ("VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Past", "Past, 3rd sg"),
)

#: Set phrases: id, name, lemmas in order. None is a slot for any one word.
PHRASES = (
    (1, "leuka rintaan ja kohti uusia pettymyksiä", ("leuka", "rintaan", "ja", "kohti", "uusia", "pettymyksiä")),
    (2, "of the", ("of", "the")),
    (3, "in the _ of", ("in", "the", None, "of")),
    (4, "de la", ("de", "la")),
    (5, "is the", ("is", "the")),
)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "form string, lemma string, pos string, feats string, gloss string, weight int")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS), "pos string, feats string, label string")
