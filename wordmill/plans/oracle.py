"""DuckDB SQL for the queries; each is independent of the Spark plans."""

from __future__ import annotations

from ..operators.review import Memory
from ..sources.tables import CARDS, LABELS, LANGUAGES, LEXICON, PHRASES, USERS

WS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _bare(column: str) -> str:
    return f"regexp_replace({column}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')"


def _values(rows) -> str:
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


DECKS = f"decks AS (SELECT doc_id AS id, doc_id % {USERS} AS user_id, source AS title, lang, TIMESTAMP '2024-01-01' + to_hours(doc_id // 7) AS created_at FROM documents)"
SENTENCES = f"""cut AS (SELECT doc_id AS deck_id, lang, list_filter(list_transform(string_split(regexp_replace(nfc_normalize(text), '([.!?])({WS})', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS ss FROM documents),
sentences AS (SELECT deck_id, lang, CAST(generate_subscripts(ss, 1) - 1 AS INT) AS sentence_ix, unnest(ss) AS text FROM cut)"""
TOKENS = (
    SENTENCES
    + f""",
pieces AS (SELECT deck_id, lang, sentence_ix, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS ws FROM sentences),
forms AS (SELECT deck_id, lang, sentence_ix, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS token_ix, unnest(ws) AS form FROM pieces),
tokens AS (SELECT *, lower(form) AS lemma, CASE WHEN regexp_matches(lower(form), '(aa|ää|oi|ui|in|en)$') THEN 'VERB' ELSE 'NOUN' END AS pos FROM forms)"""
)
OCCURRENCES = TOKENS + ", occurrences AS (SELECT deck_id, lemma, pos, count(*) AS n FROM tokens GROUP BY ALL)"
WORDS = OCCURRENCES + f", card_words AS (SELECT CAST(row_number() OVER (ORDER BY sum(n) DESC, lemma, pos) - 1 AS INT) AS k, lemma, pos, sum(n) AS n FROM occurrences GROUP BY lemma, pos QUALIFY k < {CARDS})"
LOG = """log AS (SELECT event_id, user_id, k, ts, quality, user_id * 1000 + k AS card_id FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS quality FROM events) WHERE quality IS NOT NULL)"""
MARKS = f"""marks AS (SELECT DISTINCT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events WHERE event_type = 'signup'),
ignored AS (SELECT user_id, CAST(k AS INT) AS k FROM (SELECT DISTINCT user_id FROM events), range({CARDS}) r(k) WHERE (user_id + k) % 29 = 13)"""


def _fold(m: Memory = Memory()) -> str:
    w, d, f = m.w, m.decay, m.factor
    import math

    easiest = min(max(w[4] - math.exp(w[5] * 3) + 1, 1.0), 10.0)
    recall = f"pow(1 + {f!r} * days / s, {d!r})"
    return f"""seq AS (SELECT *, quality + 1 AS g, row_number() OVER (PARTITION BY card_id ORDER BY ts, event_id) AS nth FROM log),
fold AS (
  SELECT card_id, user_id, k, nth, ts, g, list_extract([{w[0]!r}, {w[1]!r}, {w[2]!r}, {w[3]!r}], g)::DOUBLE AS s, least(greatest({w[4]!r}::DOUBLE - exp({w[5]!r}::DOUBLE * (g - 1)) + 1, 1), 10)::DOUBLE AS d, 0 AS lapses FROM seq WHERE nth = 1
  UNION ALL
  SELECT card_id, user_id, k, nth, ts, g,
    greatest(CASE WHEN days < 1 THEN s * exp({w[17]!r}::DOUBLE * (g - 3 + {w[18]!r}::DOUBLE)) * pow(s, -{w[19]!r}::DOUBLE)
         WHEN g = 1 THEN least(s, {w[11]!r}::DOUBLE * pow(d, -{w[12]!r}::DOUBLE) * (pow(s + 1, {w[13]!r}::DOUBLE) - 1) * exp({w[14]!r}::DOUBLE * (1 - r)))
         ELSE s * (1 + {math.exp(w[8])!r}::DOUBLE * (11 - d) * pow(s, -{w[9]!r}::DOUBLE) * (exp({w[10]!r}::DOUBLE * (1 - r)) - 1) * (CASE WHEN g = 2 THEN {w[15]!r}::DOUBLE ELSE 1 END) * (CASE WHEN g = 4 THEN {w[16]!r}::DOUBLE ELSE 1 END)) END, 0.001::DOUBLE),
    least(greatest({w[7]!r}::DOUBLE * {easiest!r}::DOUBLE + (1 - {w[7]!r}::DOUBLE) * (d - {w[6]!r}::DOUBLE * (g - 3) * (10 - d) / 9), 1), 10),
    lapses + CASE WHEN g = 1 THEN 1 ELSE 0 END
  FROM (SELECT q.card_id, q.user_id, q.k, q.nth, q.ts, q.g, o.s, o.d, o.lapses, date_diff('day', o.ts::DATE, q.ts::DATE)::DOUBLE AS days, {recall.replace("days", "date_diff('day', o.ts::DATE, q.ts::DATE)::DOUBLE").replace("/ s", "/ o.s").replace(repr(f), repr(f) + "::DOUBLE").replace(repr(d), repr(d) + "::DOUBLE")} AS r FROM fold o JOIN seq q ON q.card_id = o.card_id AND q.nth = o.nth + 1)
),
states AS (SELECT card_id, user_id, k, s AS stability, d AS difficulty, CAST(nth AS INT) AS reps, lapses, CASE WHEN g = 1 AND nth > 1 THEN 'relearning' WHEN g = 1 THEN 'learning' ELSE 'review' END AS state, ts AS last_answer_at,
  CASE WHEN g = 1 THEN ts + INTERVAL 10 MINUTE ELSE ts + to_days(CAST(greatest(1, round(s / {f!r}::DOUBLE * {m.retention ** (1 / d) - 1!r}::DOUBLE)) AS INT)) END AS next_due
  FROM fold QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY nth DESC) = 1)"""


STATES = LOG + ", " + MARKS + ", " + _fold()
NOW = "TIMESTAMP '2024-02-01'"
KNOWN = STATES + ", known AS (SELECT user_id, k FROM (SELECT user_id, k FROM states WHERE stability >= 30 UNION SELECT user_id, k FROM marks) ANTI JOIN ignored USING (user_id, k))"
DUE = KNOWN + f", due AS (SELECT * FROM states ANTI JOIN ignored USING (user_id, k) WHERE next_due <= {NOW})"
BOTH = WORDS.replace("cut AS", "cut AS", 1) + ", " + DECKS
LEX = f"lexicon(form, lemma, pos, feats, gloss, weight) AS (VALUES {_values(LEXICON)}), labels(pos, feats, label) AS (VALUES {_values(LABELS)})"
CANDIDATES = TOKENS + ", " + LEX + f", best AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY weight DESC, lemma, pos) AS nth, count(*) OVER (PARTITION BY form) AS many FROM lexicon), bare AS (SELECT *, lower({_bare('form')}) AS w FROM tokens)"
ANALYSED = CANDIDATES + ", analysed AS (SELECT t.deck_id, t.sentence_ix, t.token_ix, coalesce(b.lemma, t.lemma) AS lemma, coalesce(b.pos, t.pos) AS pos, coalesce(b.feats, '') AS feats FROM bare t LEFT JOIN best b ON t.w = b.form AND b.nth = 1)"


def _phrases() -> str:
    """Matches at each place by fixed offsets, then left to right without overlaps through a recursive walk."""
    rows = []
    for key, _, pattern in PHRASES:
        tests = [f"ws[i + {j}] = '{w}'" if w is not None else f"ws[i + {j}] IS NOT NULL" for j, w in enumerate(pattern)]
        rows.append(f"SELECT deck_id, sentence_ix, CAST(i - 1 AS INT) AS start, {len(pattern)} AS size, CAST({key} AS BIGINT) AS mwe_id FROM spots WHERE {' AND '.join(tests)}")
    longest = "SELECT * FROM (" + " UNION ALL ".join(rows) + ") QUALIFY row_number() OVER (PARTITION BY deck_id, sentence_ix, start ORDER BY size DESC, mwe_id) = 1"
    return f"""low AS (SELECT deck_id, sentence_ix, list_transform(ws, lambda x: lower({_bare('x')})) AS ws FROM pieces),
spots AS (SELECT deck_id, sentence_ix, ws, unnest(range(1, len(ws) + 1)) AS i FROM low WHERE list_has_any(ws, ['leuka', 'of', 'in', 'de', 'is'])),
hits AS ({longest}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY deck_id, sentence_ix ORDER BY start) AS nth FROM hits),
walk AS (SELECT deck_id, sentence_ix, nth, start, size, mwe_id, true AS taken, start + size AS stop FROM ordered WHERE nth = 1
  UNION ALL SELECT o.deck_id, o.sentence_ix, o.nth, o.start, o.size, o.mwe_id, o.start >= w.stop, CASE WHEN o.start >= w.stop THEN o.start + o.size ELSE w.stop END FROM walk w JOIN ordered o ON o.deck_id = w.deck_id AND o.sentence_ix = w.sentence_ix AND o.nth = w.nth + 1),
phrases AS (SELECT deck_id, sentence_ix, start, size, mwe_id FROM walk WHERE taken)"""


def _with(parts: str, select: str) -> str:
    return f"WITH RECURSIVE {parts} {select}"


_USERS = "users(id, email) AS (VALUES (1, 'user0@example.org'), (2, 'user2@example.org'), (3, 'user42@example.org'))"
_EMAILS = "emails AS (SELECT DISTINCT 'user' || user_id || '@example.org' AS email FROM events)"
_DECK_NUMBERS = f"""{WORDS}, {DECKS}, {DUE},
known_words AS (SELECT user_id, lemma, pos FROM known JOIN card_words USING (k)), due_words AS (SELECT user_id, lemma, pos FROM due JOIN card_words USING (k)),
numbers AS (SELECT d.id AS deck_id, count(o.lemma) AS "unique", count(kw.lemma) AS known, count(dw.lemma) AS due FROM decks d LEFT JOIN occurrences o ON o.deck_id = d.id LEFT JOIN known_words kw ON kw.user_id = d.user_id AND kw.lemma = o.lemma AND kw.pos = o.pos LEFT JOIN due_words dw ON dw.user_id = d.user_id AND dw.lemma = o.lemma AND dw.pos = o.pos GROUP BY d.id)"""
_ALL_CARDS = f"all_cards AS (SELECT user_id, CAST(k AS INT) AS k FROM (SELECT DISTINCT user_id FROM log), range({CARDS}) r(k)), fresh AS (SELECT * FROM all_cards ANTI JOIN states USING (user_id, k) ANTI JOIN ignored USING (user_id, k) ANTI JOIN marks USING (user_id, k))"


def _capacity(day: str) -> str:
    return f"learned AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, card_id, min(ts) AS f FROM log GROUP BY ALL) WHERE f::DATE = DATE '{day}' GROUP BY user_id), capacity AS (SELECT u.user_id, coalesce(n, 0) AS learned_today, CAST(greatest(0, 20 - coalesce(n, 0)) AS BIGINT) AS capacity FROM (SELECT DISTINCT user_id FROM log) u LEFT JOIN learned USING (user_id))"


_QUEUE = f"""{DUE}, {_ALL_CARDS}, {_capacity("2024-02-01")},
lined AS (SELECT user_id, k, 'review' AS kind, 0 AS o, next_due AS t FROM states ANTI JOIN ignored USING (user_id, k) WHERE next_due <= TIMESTAMP '2024-01-20'
  UNION ALL SELECT user_id, k, 'new', 1, NULL FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS r FROM fresh) JOIN capacity USING (user_id) WHERE r <= capacity),
queue AS (SELECT user_id, k, kind, CAST(row_number() OVER (PARTITION BY user_id ORDER BY o, t, k) AS INT) AS place FROM lined)"""
_COUNTS = "by_deck AS (SELECT lemma, pos, title AS deck, deck_id, n AS count FROM occurrences JOIN decks ON deck_id = id)"
_KEYS = "CASE WHEN k % 3 = 0 THEN CAST(k AS BIGINT) END AS mwe_id"
_LANGS = ", ".join(f"'{x}'" for x in LANGUAGES)

SQL: dict[str, str] = {
    "s1_requests": "SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE source END AS title, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 50 = 7 THEN -1 ELSE CAST(length(text) AS INT) END AS chars, doc_id % 50 = 7 AS bad_json FROM documents",
    "s5_user_lookup": f"WITH {_USERS} SELECT CAST(id AS BIGINT) AS id, email, true AS email_verified, 20 AS new_per_day FROM users WHERE email = 'user42@example.org'",
    "s6_get_or_create_users": f"WITH {_USERS}, {_EMAILS} SELECT CAST(id AS BIGINT) AS id, email, true AS email_verified, CAST(0.9 AS DOUBLE) AS retention FROM users UNION ALL SELECT 3 + row_number() OVER (ORDER BY email), email, true, 0.9 FROM emails ANTI JOIN users USING (email)",
    "s7_deck_insert": f"SELECT row_number() OVER (ORDER BY doc_id % 5, source, doc_id) AS deck_id, doc_id % 5 AS user_id, source AS title, doc_id FROM documents WHERE coalesce(source, '') <> '' AND lang IN ({_LANGS}) AND octet_length(encode(text)) <= 2097152 AND regexp_replace(text, '{WS}', '', 'g') <> ''",
    "s8_sentence_rows": _with(TOKENS, "SELECT row_number() OVER (ORDER BY deck_id, sentence_ix) AS id, deck_id, sentence_ix, md5(array_to_string(ws, ' ')) AS text_md5, lang FROM pieces"),
    "s9_user_decks": _with(DECKS, "SELECT id, user_id, title, lang, created_at FROM decks WHERE user_id = 7 ORDER BY created_at DESC, id DESC"),
    "s11_json_rows": _with(DECKS, """SELECT id, '{"id":' || id || ',"title":"' || title || '","lang":"' || lang || '"}' AS json FROM decks"""),
    "p1_deck_projection": _with(_DECK_NUMBERS, 'SELECT id, title, lang, known, "unique", due FROM decks JOIN numbers ON id = deck_id'),
    "p2_p5_validate": f"SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'title' WHEN doc_id % 13 = 5 THEN 'lang' WHEN doc_id % 17 <> 2 AND octet_length(encode(text)) > 16000 THEN 'size' WHEN doc_id % 17 = 2 OR regexp_replace(text, '{WS}', '', 'g') = '' THEN 'blank' ELSE 'ok' END AS reason FROM documents",
    "p7_current_user": "SELECT event_id, CASE WHEN event_id % 5 < 3 OR user_id = 0 THEN 1 ELSE user_id END AS user_id FROM events",
    "p9_due": _with(DUE, "SELECT user_id, k, next_due FROM due"),
    "p10_known": _with(KNOWN, "SELECT user_id, k FROM known"),
    "t1_nfc": "SELECT doc_id AS deck_id, md5(nfc_normalize(text)) AS nfc_md5, length(nfc_normalize(text)) AS chars FROM documents",
    "t2_sentences": _with(SENTENCES, "SELECT deck_id, sentence_ix, text FROM sentences"),
    "t3_tokens": _with(TOKENS, "SELECT deck_id, sentence_ix, token_ix, form FROM tokens"),
    "t4_t7_analysed_tokens": _with(TOKENS, "SELECT deck_id, sentence_ix, token_ix, form, lemma, pos, pos || ' (stub)' AS grammar_label FROM tokens"),
    "t5_pos_counts": _with(TOKENS, "SELECT lang, pos, count(*) AS n, count(DISTINCT lemma) AS lemmas FROM tokens GROUP BY ALL"),
    "t8_analysis": _with(
        TOKENS,
        """, js AS (SELECT deck_id, sentence_ix, '{"tokens":[' || string_agg('{"form":' || to_json(form) || ',"lemma":' || to_json(lemma) || ',"pos":"' || pos || '","feats":{},"grammar_label":"' || pos || ' (stub)","mwe_id":null}', ',' ORDER BY token_ix) || ']}' AS j FROM tokens GROUP BY ALL)
SELECT d.doc_id AS deck_id, md5('{"sentences":[' || coalesce(string_agg(j, ',' ORDER BY sentence_ix), '') || ']}') AS json_md5, count(j) AS sentences FROM documents d LEFT JOIN js ON js.deck_id = d.doc_id GROUP BY d.doc_id""",
    ),
    "t10_sentence_texts": _with(TOKENS, "SELECT deck_id, sentence_ix, array_to_string(ws, ' ') AS text FROM pieces"),
    "t11_enclitics": _with(TOKENS, f"SELECT 'FI' AS lang, e AS enclitic, count(*) AS n FROM (SELECT regexp_extract(lower({_bare('form')}), '(kin|kaan|pa|pä)$', 1) AS e FROM tokens WHERE deck_id % 2 = 0) WHERE e <> '' GROUP BY ALL"),
    "t12_candidates": _with(CANDIDATES, "SELECT lang, b.form IS NULL AS guessed, count(*) AS tokens, CAST(sum(coalesce(many, 1)) AS BIGINT) AS candidates FROM bare t LEFT JOIN best b ON t.w = b.form AND nth = 1 GROUP BY ALL"),
    "t13_best_analysis": _with(ANALYSED, "SELECT lemma, pos, feats, count(*) AS n FROM analysed GROUP BY ALL"),
    "t14_compounds": _with(
        CANDIDATES,
        """, counted AS (SELECT w AS word, count(*) AS n FROM bare GROUP BY w), cuts AS (SELECT word, n, unnest(range(2, length(word) - 1)) AS i FROM counted),
split AS (SELECT word, n, i, left(word, i) AS a, substring(word, i + 1) AS b FROM cuts) SELECT word, a || '+' || b AS components, h.lemma, n FROM split JOIN (SELECT form, lemma FROM best WHERE nth = 1) h ON h.form = b WHERE a IN (SELECT form FROM lexicon) QUALIFY row_number() OVER (PARTITION BY word ORDER BY i DESC) = 1""",
    ),
    "t15_phrases": _with(TOKENS + ", " + _phrases(), "SELECT deck_id, sentence_ix, start, size, mwe_id FROM phrases"),
    "t16_associations": _with(
        TOKENS,
        """, pairs AS (SELECT lemma AS a, lead(lemma) OVER (PARTITION BY deck_id, sentence_ix ORDER BY token_ix) AS b FROM tokens),
ab AS (SELECT a, b, count(*) AS n_ab FROM pairs WHERE b IS NOT NULL GROUP BY ALL), na AS (SELECT a, sum(n_ab) AS n_a FROM ab GROUP BY a), nb AS (SELECT b, sum(n_ab) AS n_b FROM ab GROUP BY b),
r AS (SELECT a, b, n_ab, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, n_ab::DOUBLE AS x, n_a::DOUBLE AS p, n_b::DOUBLE AS q, (SELECT sum(n_ab) FROM ab)::DOUBLE AS n FROM ab JOIN na USING (a) JOIN nb USING (b) WHERE n_ab >= 5)
SELECT a, b, n_ab, n_a, n_b, round(log2(x * n / (p * q)), 6) AS pmi, round(2 * (x * ln(x / (p * q / n)) + CASE WHEN p - x > 0 THEN (p - x) * ln((p - x) / (p * (n - q) / n)) ELSE 0 END + CASE WHEN q - x > 0 THEN (q - x) * ln((q - x) / ((n - p) * q / n)) ELSE 0 END + CASE WHEN n - p - q + x > 0 THEN (n - p - q + x) * ln((n - p - q + x) / ((n - p) * (n - q) / n)) ELSE 0 END), 4) AS llr FROM r""",
    ),
    "t17_labels": _with(ANALYSED, "SELECT coalesce(label, pos || ' (stub)') AS label, count(*) AS n FROM analysed LEFT JOIN labels USING (pos, feats) GROUP BY ALL"),
    "t18_inflect": _with(LEX, "SELECT w.lemma, w.pos, f.feats, max_by(l.form, (l.weight, l.form)) AS form FROM (SELECT DISTINCT lemma, pos FROM lexicon) w CROSS JOIN (VALUES ('Case=Ine|Number=Sing'), ('Mood=Ind|Number=Sing|Person=3|Tense=Past')) f(feats) LEFT JOIN lexicon l ON l.lemma = w.lemma AND l.pos = w.pos AND l.feats = f.feats GROUP BY w.lemma, w.pos, f.feats"),
    "t19_generate": _with(
        TOKENS,
        f""", short AS (SELECT deck_id, sentence_ix, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces WHERE len(ws) <= 12)
SELECT deck_id, sentence_ix, CAST(i - 1 AS INT) AS token_ix, 'be' AS lemma, 'Mood=Ind|Number=Sing|Person=3|Tense=Past' AS feats, array_to_string(list_concat(ws[:i - 1], [replace(lower(ws[i]), 'is', 'was')], ws[i + 1:]), ' ') AS generated FROM short WHERE lower({_bare("ws[i]")}) = 'is'""",
    ),
    "j1_deck_words": _with(OCCURRENCES + ", " + DECKS, "SELECT user_id, CAST(sum(n) AS BIGINT) AS tokens, count(DISTINCT (lemma, pos)) AS words FROM occurrences JOIN decks ON deck_id = id GROUP BY user_id"),
    "j2_not_ignored": _with(STATES, "SELECT user_id, count(*) AS cards FROM states ANTI JOIN ignored USING (user_id, k) GROUP BY user_id"),
    "j3_known_in_deck": _with(_DECK_NUMBERS, "SELECT deck_id, known FROM numbers WHERE known > 0"),
    "j4_gloss": _with(OCCURRENCES + ", " + LEX, "SELECT lemma, pos, gloss FROM (SELECT DISTINCT lemma, pos FROM occurrences) LEFT JOIN (SELECT lemma, pos, min(gloss) AS gloss FROM lexicon GROUP BY ALL) USING (lemma, pos)"),
    "j6_null_safe_cards": _with(LOG + ", " + MARKS, f"SELECT user_id, lemma, pos, coalesce(mwe_id, -1) AS mwe_id FROM (SELECT DISTINCT user_id, 'w' || k AS lemma, 'NOUN' AS pos, {_KEYS} FROM log) c WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.user_id = c.user_id AND 'w' || m.k = c.lemma)"),
    "j7_overlaps": _with(OCCURRENCES + ", " + DECKS, ", owned AS (SELECT user_id, deck_id, lemma, pos FROM occurrences JOIN decks ON deck_id = id) SELECT a.user_id, a.deck_id AS deck_a, b.deck_id AS deck_b, count(*) AS shared FROM owned a JOIN owned b ON a.user_id = b.user_id AND a.lemma = b.lemma AND a.pos = b.pos AND a.deck_id < b.deck_id GROUP BY ALL"),
    "a1_words_known": _with(KNOWN, "SELECT user_id, count(*) AS known FROM known GROUP BY user_id"),
    "a2_words_due": _with(DUE, "SELECT user_id, count(*) AS due FROM due GROUP BY user_id"),
    "a3_new_capacity": _with(STATES + ", " + _ALL_CARDS + ", " + _capacity("2024-01-05"), "SELECT user_id, learned_today, capacity, coalesce(b, 0) AS backlog FROM capacity LEFT JOIN (SELECT user_id, count(*) AS b FROM fresh GROUP BY user_id) USING (user_id)"),
    "a4_a6_deck_numbers": _with(_DECK_NUMBERS, 'SELECT deck_id, "unique", known, due FROM numbers'),
    "a7_deck_summary": _with(_DECK_NUMBERS + ", " + _phrases() + ", owned AS (SELECT user_id, deck_id, lemma, pos FROM occurrences JOIN decks ON deck_id = id), both_ways AS (SELECT DISTINCT a.deck_id, b.deck_id AS other FROM owned a JOIN owned b USING (user_id, lemma, pos) WHERE a.deck_id <> b.deck_id), met AS (SELECT deck_id, count(*) AS o FROM both_ways GROUP BY deck_id)", 'SELECT deck_id, coalesce(t, 0) AS tokens, "unique" AS unique_lemmas, known AS known_lemmas, coalesce(m, 0) AS mwes, "unique" - known AS new_lemmas, coalesce(o, 0) AS overlaps FROM numbers LEFT JOIN met USING (deck_id) LEFT JOIN (SELECT deck_id, CAST(sum(n) AS BIGINT) AS t FROM occurrences GROUP BY deck_id) USING (deck_id) LEFT JOIN (SELECT deck_id, count(*) AS m FROM phrases GROUP BY deck_id) USING (deck_id)'),
    "a8_occurrence_counts": _with(OCCURRENCES + ", " + DECKS + ", " + _COUNTS, "SELECT lemma, pos, string_agg(count || '× ' || deck, ', ' ORDER BY deck, deck_id) AS counts FROM by_deck GROUP BY ALL"),
    "a9_lemma_frequency": _with(TOKENS, "SELECT lemma, pos, count(*) AS n FROM tokens GROUP BY ALL"),
    "a10_parser_health": _with(CANDIDATES, "SELECT lang, count(*) AS tokens, count(*) FILTER (WHERE lower(form) NOT IN (SELECT form FROM lexicon)) AS unknown, count(*) FILTER (WHERE w NOT IN (SELECT form FROM lexicon)) AS guesser_used FROM bare GROUP BY lang"),
    "a11_bigrams": _with(TOKENS, "SELECT a, b, count(*) AS n FROM (SELECT lemma AS a, lead(lemma) OVER (PARTITION BY deck_id, sentence_ix ORDER BY token_ix) AS b FROM tokens) WHERE b IS NOT NULL GROUP BY ALL"),
    "w1_examples": _with(
        TOKENS + ", " + _phrases(),
        ", places AS (SELECT DISTINCT t.lemma, t.pos, t.deck_id, t.sentence_ix, p.deck_id IS NOT NULL AS m FROM tokens t LEFT JOIN (SELECT DISTINCT deck_id, sentence_ix FROM phrases) p ON p.deck_id = t.deck_id AND p.sentence_ix = t.sentence_ix), best AS (SELECT lemma, pos, deck_id, sentence_ix, CAST(row_number() OVER (PARTITION BY lemma, pos ORDER BY CASE WHEN deck_id = 5 THEN 0 ELSE 1 END, CASE WHEN m THEN 0 ELSE 1 END, deck_id, sentence_ix) AS INT) AS rank FROM places) SELECT lemma, pos, rank, deck_id, sentence_ix, array_to_string(ws, ' ') AS text FROM best JOIN pieces USING (deck_id, sentence_ix) WHERE rank <= 3",
    ),
    "w2_review_gaps": _with(LOG, "SELECT event_id, card_id, CAST(row_number() OVER w AS INT) AS nth, coalesce(date_diff('day', lag(ts) OVER w::DATE, ts::DATE), -1) AS days FROM log WINDOW w AS (PARTITION BY card_id ORDER BY ts, event_id)".replace("lag(ts) OVER w::DATE", "(lag(ts) OVER w)::DATE")),
    "w3_new_under_cap": _with(STATES + ", " + _ALL_CARDS, "SELECT user_id, k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k) AS INT) AS nth FROM fresh QUALIFY nth <= 20"),
    "w6_user_ids": _with(_EMAILS, "SELECT row_number() OVER (ORDER BY email) AS id, email FROM emails"),
    "l1_recent_decks": _with(DECKS, "SELECT id, title, created_at FROM decks ORDER BY created_at DESC, id DESC LIMIT 25"),
    "l4_sentence_order": _with(SENTENCES, f"SELECT deck_id, sentence_ix, array_to_string(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> ''), ' ') AS text FROM sentences"),
    "o1_set_operations": _with(DUE, "SELECT 'either' AS what, count(*) AS n FROM (SELECT user_id, k FROM known UNION SELECT user_id, k FROM due) UNION ALL SELECT 'both', count(*) FROM known SEMI JOIN due USING (user_id, k) UNION ALL SELECT 'due_only', count(*) FROM due ANTI JOIN known USING (user_id, k)"),
    "f11_f12_highlight": _with(TOKENS, """SELECT deck_id, sentence_ix, regexp_replace(replace(replace(replace(array_to_string(ws, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)the', '<span class="highlight">\\0</span>', 'g') AS html FROM pieces"""),
    "f16_front_mode": _with(STATES, "SELECT card_id, CASE WHEN x < 40 THEN 'word' WHEN x < 80 THEN 'sentence' ELSE 'generated' END AS mode FROM (SELECT card_id, CAST('0x' || md5(card_id || ':7')[1:8] AS BIGINT) % 100 AS x FROM states)"),
    "f13_badges": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'WORD' WHEN 1 THEN 'GENERATED' ELSE 'NEW' END AS badge FROM events",
    "f15_deck_lines": _with(_DECK_NUMBERS, """SELECT id, lang || ' • ' || known || '/' || "unique" || ' known • ' || due || ' due' AS line FROM decks JOIN numbers ON id = deck_id"""),
    "r1_next_card": _with(
        WORDS + ", " + DECKS + ", " + _COUNTS + ", " + _QUEUE,
        ", counts AS (SELECT lemma, pos, arg_min(deck_id, (deck, deck_id)) AS first_deck, count(*) AS n_decks FROM by_deck GROUP BY ALL) SELECT user_id, k, kind, lemma, pos, first_deck, n_decks FROM queue JOIN card_words USING (k) LEFT JOIN counts USING (lemma, pos) WHERE place = 1",
    ),
    "r2_answers": _with(LOG, "SELECT event_id, card_id, ts, quality FROM log"),
    "r3_ignore": _with(LOG + ", " + MARKS, "SELECT user_id, k FROM ignored UNION SELECT user_id, k FROM log WHERE quality = 0"),
    "r4_known": _with(STATES, "SELECT user_id, CAST(count(*) FILTER (WHERE s >= 30) AS BIGINT) AS mature FROM (SELECT st.user_id, CASE WHEN m.k IS NULL THEN stability ELSE greatest(stability, 30) END AS s FROM states st LEFT JOIN marks m ON m.user_id = st.user_id AND m.k = st.k) GROUP BY user_id"),
    "r5_card_states": _with(STATES, "SELECT card_id, round(stability, 4) AS stability, round(difficulty, 4) AS difficulty, reps, lapses, state, last_answer_at, next_due FROM states"),
    "r6_queue": _with(_QUEUE, "SELECT user_id, k, kind, place FROM queue"),
    "r7_deck_delete": _with(SENTENCES + ", " + DECKS, "SELECT 'decks' AS what, count(*) AS n FROM decks WHERE user_id <> 7 UNION ALL SELECT 'sentences', count(*) FROM sentences JOIN decks ON id = deck_id WHERE user_id <> 7"),
    "r8_settings": "SELECT id, coalesce(n, 20) AS new_per_day, CASE WHEN n IS NULL THEN 'system' ELSE 'dark' END AS theme FROM (SELECT DISTINCT user_id AS id FROM events) LEFT JOIN (SELECT user_id AS id, CAST(arg_max(event_id % 40, (ts, event_id % 40)) AS INT) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id) USING (id)",
    "r10_dashboard": _with(DUE + ", " + _capacity("2024-02-01"), ", u AS (SELECT user_id FROM log UNION SELECT user_id FROM marks) SELECT user_id, coalesce(kc, 0) AS known_count, coalesce(dc, 0) AS due_count, coalesce(capacity, 20) AS new_capacity_today FROM u LEFT JOIN (SELECT user_id, count(*) AS kc FROM known GROUP BY user_id) USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS dc FROM due GROUP BY user_id) USING (user_id) LEFT JOIN capacity USING (user_id)"),
    "r11_deck_queue": _with(WORDS + ", " + DUE, "SELECT user_id, k, lemma, pos FROM due JOIN card_words USING (k) SEMI JOIN (SELECT lemma, pos FROM occurrences WHERE deck_id = 3) USING (lemma, pos)"),
}
