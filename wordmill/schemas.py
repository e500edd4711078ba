"""Schemas of the store's tables and of the API payloads."""

from __future__ import annotations

from pyspark.sql.types import StructType

SETTINGS = "struct<new_per_day:int,retention:double,theme:string>"
FSRS_STATE = "struct<stability:double,difficulty:double,reps:int,lapses:int,state:string>"
TOKEN = "struct<form:string,lemma:string,pos:string,feats:map<string,string>,grammar_label:string,mwe_id:bigint>"
ANALYSIS = f"struct<sentences:array<struct<tokens:array<{TOKEN}>>>>"

DDL: dict[str, str] = {
    "users": f"id bigint, email string, email_verified boolean, settings {SETTINGS}",
    "decks": "id bigint, user_id bigint, title string, lang string, created_at timestamp_ntz",
    "sentences": "id bigint, deck_id bigint, sentence_ix int, text string, lang string",
    "lemmas": "lemma string, pos string, gloss string, lang string",
    "occurrence": "deck_id bigint, sentence_id bigint, token_ix int, lemma string, pos string",
    "cards": "id bigint, user_id bigint, lemma string, pos string, mwe_id bigint",
    "card_state": f"card_id bigint, fsrs {FSRS_STATE}, next_due timestamp_ntz, last_answer_at timestamp_ntz",
    "user_known_lemmas": "user_id bigint, lemma string, pos string",
    "user_ignored_lemmas": "user_id bigint, lemma string, pos string",
    "review_log": "user_id bigint, card_id bigint, ts timestamp_ntz, quality int",
    "mwe": "id bigint, name string, pattern array<struct<lemma:string,slots:map<string,string>>>, gloss string, lang string",
}

REQUEST = "struct<title:string,lang:string,text:string>"
LOGIN = "struct<email:string,password:string>"
ANSWER = "struct<card_id:string,quality:int>"
MARK = "struct<lemma:string,pos:string>"


def schema(table: str) -> StructType:
    """The table's schema as a StructType."""
    return StructType.fromDDL(DDL[table])
