"""The text pipeline's column functions; all but nfc() are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word endings that decide between verb and noun, and the enclitics that are marked.
VERB_ENDINGS = ("aa", "ää", "oi", "ui", "in", "en")
NOUN_ENDINGS = ("nen", "ssa", "ssä", "lla", "llä", "iin")
ADJECTIVE_ENDINGS = ("inen",)
ENCLITICS = {"FI": ("kin", "kaan", "pa", "pä")}

_EDGE = r"(?U)^\s+|\s+$"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no built-in for it. Texts that are in that form are returned as they are."""
    return text.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def trimmed(text: Column) -> Column:
    """Without white space (Unicode's) at both ends; Spark's trim knows spaces only."""
    return F.regexp_replace(text, _EDGE, "")


def sentences(text: Column) -> Column:
    """Array of sentences: cut after . ! ? before white space or the end, trimmed, none empty; null text has none."""
    parts = F.split(text, r"(?<=[.!?])(?=(?U:\s))")
    return F.coalesce(F.filter(F.transform(parts, trimmed), lambda s: s != ""), F.array().cast("array<string>"))


def tokens(sentence: Column) -> Column:
    """Array of the pieces between white space."""
    return F.filter(F.split(sentence, r"(?U)\s+"), lambda t: t != "")


def lemma(form: Column) -> Column:
    return F.lower(form)


def pos(form: Column, mode: str = "reference") -> Column:
    """VERB or NOUN by the first ending that fits in listed order; longest_suffix lets the longest ending win (and gives ADJ)."""
    low = F.lower(form)
    if mode == "reference":
        return F.when(low.rlike(f"({'|'.join(VERB_ENDINGS)})$"), "VERB").otherwise("NOUN")
    if mode != "longest_suffix":
        raise ValueError(f"unknown mode {mode}")
    ranked = sorted([(e, "ADJ") for e in ADJECTIVE_ENDINGS] + [(e, "NOUN") for e in NOUN_ENDINGS] + [(e, "VERB") for e in VERB_ENDINGS], key=lambda x: -len(x[0]))
    out = None
    for ending, tag in ranked:
        out = F.when(low.endswith(ending), tag) if out is None else out.when(low.endswith(ending), tag)
    return out.otherwise("NOUN")


def grammar_label(tag: Column) -> Column:
    return F.concat(tag, F.lit(" (stub)"))


def bare(form: Column) -> Column:
    """The form without punctuation at both ends."""
    return F.regexp_replace(form, r"^[\p{Punct}]+|[\p{Punct}]+$", "")


def enclitic(form: Column, lang: Column) -> Column:
    """The enclitic that ends the form in its language, or an empty string; languages without enclitics have none."""
    out = F.lit("")
    for language, endings in ENCLITICS.items():
        out = F.when(lang == language, F.regexp_extract(F.lower(bare(form)), f"({'|'.join(endings)})$", 1)).otherwise(out)
    return out


def token(form: Column, strip_punct: bool = False, pos_mode: str = "reference") -> Column:
    """One token's struct: form, lemma, pos, feats, grammar_label, mwe_id."""
    seen = bare(form) if strip_punct else form
    tag = pos(seen, pos_mode)
    return F.struct(
        form.alias("form"),
        lemma(seen).alias("lemma"),
        tag.alias("pos"),
        F.create_map().cast("map<string,string>").alias("feats"),
        grammar_label(tag).alias("grammar_label"),
        F.lit(None).cast("bigint").alias("mwe_id"),
    )


def analysis(text: Column, strip_punct: bool = False, pos_mode: str = "reference") -> Column:
    """The nested result: sentences of tokens. Text should be in normal form C."""
    each = F.transform(sentences(text), lambda s: F.struct(F.transform(tokens(s), lambda t: token(t, strip_punct, pos_mode)).alias("tokens")))
    return F.struct(each.alias("sentences"))


# ------------------------------------------------------------------ display


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column, needle: str) -> Column:
    """Every occurrence of the needle, in any case, in a span; the text keeps its own casing, the needle is taken literally."""
    literal = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, "(?iu)" + literal, '<span class="highlight">$0</span>') if needle else text


def badge(mode: Column) -> Column:
    return F.when(mode == "word", "WORD").when(mode == "generated", "GENERATED").otherwise("NEW")


def deck_count_string(counts: Column) -> Column:
    """``1× Deck A, 2× Deck B`` from an array of (deck, count)."""
    return F.array_join(F.transform(counts, lambda c: F.concat(c["count"].cast("string"), F.lit("× "), c["deck"])), ", ")


def deck_line(lang: Column, known: Column, unique: Column, due: Column) -> Column:
    return F.format_string("%s • %d/%d known • %d due", lang, known, unique, due)


def front_mode(card: Column, seed: int, weights: tuple[int, int, int] = (40, 40, 20)) -> Column:
    """word, sentence or generated, by a digest of card and seed against weights in hundredths."""
    x = F.conv(F.substring(F.md5(F.concat_ws(":", card.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(x < weights[0], "word").when(x < weights[0] + weights[1], "sentence").otherwise("generated")


def cookie_user(cookie: Column) -> Column:
    """The user's number; missing, unreadable or zero means user 1."""
    return F.coalesce(F.nullif(cookie.try_cast("bigint"), F.lit(0)), F.lit(1)).cast("bigint")
