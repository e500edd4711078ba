"""Texts to sentences, tokens and occurrences; validation of uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import MAX_BYTES


def sentences(texts: DataFrame, normalise: bool = True) -> DataFrame:
    """deck_id, lang, sentence_ix, text: one narrow stage."""
    text = X.nfc("text") if normalise else F.col("text")
    each = texts.select("deck_id", "lang", text.alias("__t")).select("deck_id", "lang", X.sentences(F.col("__t")).alias("__s"))
    return each.select("deck_id", "lang", F.posexplode("__s").alias("sentence_ix", "text"))


def tokens(texts: DataFrame, strip_punct: bool = False, pos_mode: str = "reference", normalise: bool = True) -> DataFrame:
    """deck_id, lang, sentence_ix, token_ix, form, lemma, pos, grammar_label, mwe_id."""
    each = sentences(texts, normalise).select("deck_id", "lang", "sentence_ix", F.posexplode(X.tokens(F.col("text"))).alias("token_ix", "form"))
    seen = X.bare(F.col("form")) if strip_punct else F.col("form")
    tag = X.pos(seen, pos_mode)
    return each.select("deck_id", "lang", "sentence_ix", "token_ix", "form", X.lemma(seen).alias("lemma"), tag.alias("pos"), X.grammar_label(tag).alias("grammar_label"), F.lit(None).cast("bigint").alias("mwe_id"))


def analyze(texts: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """texts with `analysis`, the nested sentences and tokens."""
    return texts.withColumn("analysis", X.analysis(X.nfc(text_col), **options))


def sentence_texts(texts: DataFrame) -> DataFrame:
    """deck_id, lang, sentence_ix, text as the store keeps it: tokens joined with one space."""
    return sentences(texts).select("deck_id", "lang", "sentence_ix", F.array_join(X.tokens(F.col("text")), " ").alias("text"))


def bigrams(texts: DataFrame) -> DataFrame:
    """a, b: neighbouring lemmas inside sentences, made from each sentence's array, so without a shuffle."""
    words = sentences(texts).select(F.transform(X.tokens(F.col("text")), X.lemma).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return words.where(F.size("w") > 1).select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("b is not null")


def observed(frame: DataFrame, name: str):
    """(the frame, its observation): rows and distinct decks are counted while the frame is used, for dashboards of the parser."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return frame.observe(watch, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("deck_id").alias("decks")), watch


def occurrence_counts(texts: DataFrame) -> DataFrame:
    """deck_id, lemma, pos, n. Counts are made before the shuffle."""
    return tokens(texts).groupBy("deck_id", "lemma", "pos").agg(F.count("*").alias("n"))


def lemma_counts(texts: DataFrame) -> DataFrame:
    return tokens(texts).groupBy("lemma", "pos").agg(F.count("*").alias("n"))


def reject_reason(title: str = "title", lang: str = "lang", text: str = "text", languages: tuple[str, ...] = ("FI", "ET"), max_bytes: int = MAX_BYTES):
    """Why an upload is refused, or null: the first of title, language, size, blank text."""
    return (
        F.when(F.coalesce(F.col(title), F.lit("")) == "", "title")
        .when(F.col(lang).isNull() | ~F.col(lang).isin(*languages), "lang")
        .when(F.octet_length(text) > max_bytes, "size")
        .when(X.trimmed(F.coalesce(F.col(text), F.lit(""))) == "", "blank")
    )


def health(tokens_: DataFrame, lexicon: DataFrame) -> DataFrame:
    """lang, tokens, unknown (forms the lexicon doesn't have as they stand), guesser_used (nor without punctuation)."""
    known = lexicon.select(F.col("form").alias("__f")).distinct()
    found = tokens_.join(known, F.lower("form") == F.col("__f"), "left").withColumn("__w", F.lower(X.bare(F.col("form"))))
    found = found.join(known.select(F.col("__f").alias("__g")), F.col("__w") == F.col("__g"), "left")
    missing = {"unknown": "__f", "guesser_used": "__g"}
    return found.groupBy("lang").agg(F.count("*").alias("tokens"), *(F.sum(F.col(c).isNull().cast("bigint")).alias(n) for n, c in missing.items()))
