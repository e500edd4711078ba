"""Lexicon lookup, disambiguation, labels, inflection, set phrases and word associations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _entries(lexicon: DataFrame) -> DataFrame:
    """form, found: its analyses, best weight first (ties: lemma, then part of speech)."""
    entry = F.struct((-F.col("weight")).alias("order"), "lemma", "pos", "feats", "gloss", "weight")
    return lexicon.groupBy("form").agg(F.array_sort(F.collect_list(entry)).alias("found"))


def candidates(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each token with all analyses of its bare form, best weight first; unknown forms get the guesser's.

    The lexicon's entries are grouped first, so the join adds no rows; it is a dimension table and joined as such (Spark
    broadcasts it while it is small).
    """
    grouped = _entries(lexicon).withColumnRenamed("form", "__f")
    word = F.lower(X.bare(F.col("form")))
    guess = F.array(F.struct(F.lit(0).alias("order"), F.col("lemma"), F.col("pos"), F.lit("").alias("feats"), F.lit(None).cast("string").alias("gloss"), F.lit(0).alias("weight")))
    joined = tokens.withColumn("__w", word).join(grouped, F.col("__w") == F.col("__f"), "left")
    return joined.withColumns({"guessed": F.col("found").isNull(), "candidates": F.coalesce("found", guess)}).drop("__w", "__f", "found")


def best_analysis(with_candidates: DataFrame) -> DataFrame:
    """The candidate with the highest prior (ties: lemma, then part of speech)."""
    best = F.element_at("candidates", 1)
    keep = [c for c in with_candidates.columns if c not in ("candidates", "lemma", "pos")]
    return with_candidates.select(*keep, best["lemma"].alias("lemma"), best["pos"].alias("pos"), best["feats"].alias("feats"), best["gloss"].alias("gloss"), F.size("candidates").alias("n_candidates"))


def transition_counts(tags: DataFrame) -> DataFrame:
    """a, b, c, n: trigrams of tags in sentences, with <s> before the first token."""
    w = Window.partitionBy("deck_id", "sentence_ix").orderBy("token_ix")
    two = tags.select(F.coalesce(F.lag("pos", 2).over(w), F.lit("<s>")).alias("a"), F.coalesce(F.lag("pos", 1).over(w), F.lit("<s>")).alias("b"), F.col("pos").alias("c"))
    return two.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def _contexts(transitions: DataFrame) -> tuple[dict, dict]:
    """Counts of the tag trigrams, and of their first two tags."""
    counts = {(r["a"], r["b"], r["c"]): r["n"] for r in transitions.collect()}
    context: dict[tuple[str, str], int] = {}
    for (a, b, _), n in counts.items():
        context[a, b] = context.get((a, b), 0) + n
    return counts, context


def best_path(tokens: list[list[tuple[str, int]]], counts: dict, context: dict, strength: float, before: tuple[str, str] = ("<s>", "<s>")) -> list[int]:
    """The number of each token's candidate (tag, weight) on the most likely path after the two tags `before`."""
    score = {before: (0.0, [])}
    for found in tokens:
        new: dict[tuple[str, str], tuple[float, list]] = {}
        total = sum(w + 1 for _, w in found)
        for (a, b), (s, way) in sorted(score.items()):
            for i, (tag, weight) in enumerate(found):
                p = (counts.get((a, b, tag), 0) + 0.1) / (context.get((a, b), 0) + 1.0)
                v = s + strength * np.log(p) + np.log((weight + 1) / total)
                if (b, tag) not in new or v > new[b, tag][0]:
                    new[b, tag] = (v, [*way, i])
        score = new
    return max(score.values(), key=lambda x: x[0])[1]


def viterbi(with_candidates: DataFrame, transitions: DataFrame, strength: float = 1.0) -> DataFrame:
    """deck_id, sentence_ix, token_ix, form, lemma, pos: the most likely path of candidates over tag trigrams.

    The transition table has at most tags**3 rows and is sent to the tasks; sentences are independent rows of arrays.
    """
    counts, context = _contexts(transitions)
    token = F.struct("token_ix", "form", "candidates")
    rows = with_candidates.groupBy("deck_id", "sentence_ix").agg(F.array_sort(F.collect_list(token)).alias("tokens"))

    def run(batches):
        import pyarrow as pa

        names = ["deck_id", "sentence_ix", "token_ix", "form", "lemma", "pos"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for deck, ix, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                for t, i in zip(tokens, best_path([[(c["pos"], c["weight"]) for c in t["candidates"]] for t in tokens], counts, context, strength)):
                    c = t["candidates"][i]
                    out.append((deck, ix, t["token_ix"], t["form"], c["lemma"], c["pos"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], names)

    return rows.mapInArrow(run, "deck_id bigint, sentence_ix int, token_ix int, form string, lemma string, pos string")


def tagged_sentences(sentences: DataFrame, lexicon: DataFrame, strength: float = 1.0) -> DataFrame:
    """deck_id, sentence_ix, token_ix, form, lemma, pos: viterbi() over whole sentences (deck_id, sentence_ix, text), narrow.

    Trigrams are counted on the best single analyses, in each task first. The lexicon is a dimension that goes to the tasks;
    one too large for that goes by candidates() and viterbi(). A path is open only from a word of several analyses to the
    next two of one each; equal stretches are worked out once.
    """
    t = F.col("__t")
    lists = sentences.select(F.col("deck_id").cast("bigint").alias("deck_id"), "sentence_ix", X.tokens(F.col("text")).alias("__t")).where(F.size("__t") > 0)
    lists = lists.select("deck_id", "sentence_ix", t.alias("forms"), F.transform(t, lambda w: F.lower(X.bare(w))).alias("words"), F.transform(t, X.lemma).alias("lemmas"), F.transform(t, lambda w: X.pos(w)).alias("tags"))
    entries = [(r["form"], [(c["lemma"], c["pos"], c["weight"]) for c in r["found"]]) for r in _entries(lexicon.where("form is not null")).collect()]
    known = [form for form, _ in entries]
    several = np.array([len(found) for _, found in entries], np.int64)
    first = np.cumsum(several) - several
    analyses = [a for _, found in entries for a in found]

    def chosen(at: np.ndarray, guess, part: int):
        """Part 0 (lemma) or 1 (tag) of the analyses numbered `at`, or the guess where that is -1."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(analyses):
            return guess
        taken = pa.array([a[part] for a in analyses], pa.string()).take(pa.array(np.maximum(at, 0)))
        return pc.if_else(pa.array(at >= 0), taken, guess)

    def found(batch):
        """(number of each token's form in the lexicon or -1, the number of its best analysis or -1, begin of each sentence)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(batch.column("words").flatten(), value_set=pa.array(known, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        best = np.where(at >= 0, first[at], -1) if len(known) else np.full(len(at), -1)
        sizes = batch.column("words").value_lengths().to_numpy()
        return at, best, np.cumsum(sizes) - sizes

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            _, best, begin = found(batch)
            tags = chosen(best, batch.column("tags").flatten(), 1).dictionary_encode()
            names = ["<s>", *tags.dictionary.to_pylist()]
            c = tags.indices.to_numpy().astype(np.int64) + 1
            b = np.concatenate([[0], c[:-1]])
            b[begin] = 0
            a = np.concatenate([[0], b[:-1]])
            a[begin] = 0
            key, n = np.unique((a * len(names) + b) * len(names) + c, return_counts=True)
            rows = [[names[k] for k in key // len(names) ** i % len(names)] for i in (2, 1, 0)]
            yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.string()) for r in rows), pa.array(n.astype(np.int64))], ["a", "b", "c", "n"])

    counts, context = _contexts(lists.select("words", "tags").mapInArrow(count, "a string, b string, c string, n bigint").groupBy("a", "b", "c").agg(F.sum("n").alias("n")))

    def run(batches):
        import pyarrow as pa

        names = ["deck_id", "sentence_ix", "token_ix", "form", "lemma", "pos"]
        ways: dict[tuple, list[int]] = {}
        for batch in batches:
            at, best, begin = found(batch)
            guess = batch.column("tags").flatten()
            end = np.append(begin[1:], len(at))
            open_ = np.flatnonzero((at >= 0) & (several[at] > 1)) if len(known) else np.zeros(0, np.int64)
            if len(open_):
                tags, of = chosen(best, guess, 1).to_pylist(), np.searchsorted(begin, open_, "right") - 1
                ambiguous, done = set(open_.tolist()), -1
                for i, k in zip(open_.tolist(), of.tolist()):
                    if i < done:
                        continue
                    lo, hi, j, single = int(begin[k]), int(end[k]), i, 0
                    while j < hi and single < 2:
                        single = 0 if j in ambiguous else single + 1
                        j += 1
                    before = tuple(tags[x] if x >= lo else "<s>" for x in (i - 2, i - 1))
                    stretch = (before, *(int(at[x]) if x in ambiguous else tags[x] for x in range(i, j)))
                    if stretch not in ways:
                        if len(ways) >= 1 << 16:
                            ways.clear()
                        ways[stretch] = best_path([[a[1:] for a in entries[x][1]] if isinstance(x, int) else [(x, 0)] for x in stretch[1:]], counts, context, strength, before)
                    best[i:j] += np.where(best[i:j] >= 0, ways[stretch], 0)
                    done = j
            sizes = end - begin
            row = pa.array(np.repeat(np.arange(len(begin)), sizes))
            place = (np.arange(len(at)) - np.repeat(begin, sizes)).astype(np.int32)
            columns = [batch.column("deck_id").take(row), batch.column("sentence_ix").take(row), pa.array(place), batch.column("forms").flatten()]
            yield pa.RecordBatch.from_arrays([*columns, chosen(best, batch.column("lemmas").flatten(), 0), chosen(best, guess, 1)], names)

    return lists.mapInArrow(run, "deck_id bigint, sentence_ix int, token_ix int, form string, lemma string, pos string")


def label(analysed: DataFrame, labels: DataFrame) -> DataFrame:
    """analysed (pos, feats) with the feature string's label, or the plain one."""
    names = labels.select(F.col("pos").alias("__p"), F.col("feats").alias("__f"), F.col("label").alias("__l"))
    joined = analysed.join(names, (F.col("pos") == F.col("__p")) & (F.col("feats") == F.col("__f")), "left")
    return joined.withColumn("label", F.coalesce("__l", X.grammar_label(F.col("pos")))).drop("__p", "__f", "__l")


def compounds(words: DataFrame, lexicon: DataFrame, least: int = 2) -> DataFrame:
    """word, components, lemma: words made of two known forms; the headword is the second one's best lemma.

    words: word (distinct, bare, lower case). Of several cuts the one with the longest first part holds.
    """
    heads = lexicon.groupBy("form").agg(F.min_by("lemma", F.struct((-F.col("weight")).alias("w"), "lemma")).alias("lemma"))
    places = F.sequence(F.lit(least), F.length("word") - least)
    cut = words.where(F.length("word") >= 2 * least).select("word", F.explode(places).alias("at"))
    cut = cut.select("word", "at", F.expr("left(word, at)").alias("first"), F.expr("substring(word, at + 1)").alias("second"))
    known = cut.join(heads.select(F.col("form").alias("first")), "first", "left_semi").join(heads.select(F.col("form").alias("second"), "lemma"), "second")
    best = known.groupBy("word").agg(F.max_by(F.struct("first", "second", "lemma"), "at").alias("b"))
    return best.select("word", F.array("b.first", "b.second").alias("components"), F.col("b.lemma").alias("lemma"))


def inflect(wanted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """wanted (lemma, pos, feats) with `form`: the heaviest entry of that analysis, null if there is none."""
    best = lexicon.groupBy("lemma", "pos", "feats").agg(F.max_by("form", F.struct("weight", "form")).alias("form"))
    return wanted.join(best, ["lemma", "pos", "feats"], "left")


def generate(sentences: DataFrame, lexicon: DataFrame, changes: dict[str, str], max_words: int = 12) -> DataFrame:
    """Sentences with one known word put into other features; kept if reading it again finds those features.

    sentences: deck_id, sentence_ix, text. changes: feature string to feature string.
    """
    entries = lexicon.select(F.col("form").alias("old"), F.col("lemma").alias("__lemma"), F.col("pos").alias("__pos"), F.col("feats").alias("__feats"))
    wanted = F.create_map(*[F.lit(x) for kv in changes.items() for x in kv])
    moved = entries.withColumn("feats", wanted[F.col("__feats")]).where("feats is not null")
    new = inflect(moved.select("old", F.col("__lemma").alias("lemma"), F.col("__pos").alias("pos"), "feats"), lexicon).where("form is not null and form <> old")
    words = sentences.withColumn("words", X.tokens(F.col("text"))).where(F.size("words") <= max_words)
    each = words.select("deck_id", "sentence_ix", "words", F.posexplode("words").alias("at", "word"))
    made = each.join(new, F.lower(X.bare(F.col("word"))) == F.col("old"))
    swapped = F.transform("words", lambda w, i: F.when(i == F.col("at"), F.replace(F.lower(w), F.col("old"), F.col("form"))).otherwise(w))
    made = made.withColumn("generated", F.array_join(swapped, " "))
    again = lexicon.select(F.col("form").alias("__form"), F.col("feats").alias("__f2"), F.col("lemma").alias("__l2"))
    word = F.lower(X.bare(F.element_at(X.tokens(F.col("generated")), F.col("at") + 1)))
    checked = made.join(again, (word == F.col("__form")) & (F.col("feats") == F.col("__f2")) & (F.col("lemma") == F.col("__l2")), "left_semi")
    return checked.select("deck_id", "sentence_ix", F.col("at").alias("token_ix"), "lemma", "feats", "generated")


# ------------------------------------------------------------------ set phrases


def segment(words: list[str], tree: dict) -> list[tuple[int, int, int]]:
    """(start, size, mwe_id) of the phrases in one sentence: dynamic programming from left to right over the places.

    The segmentation that covers most words wins; of equal ones the one with fewer phrases, then with the earlier ones.
    tree: by first word, (size, id, pattern) with the longest first.
    """
    best: list[tuple[int, int, tuple | None]] = [(0, 0, None)]  # by place: words covered, minus phrases, last phrase
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, word in enumerate(words):
        for size, key, pattern in tree.get(word, ()):
            if i + size <= len(words) and all(p is None or (words[i + j] == p if isinstance(p, str) else words[i + j] in p) for j, p in enumerate(pattern)):
                ends.setdefault(i + size, []).append((size, key))
    if not ends:
        return []
    for p in range(1, len(words) + 1):
        top = best[p - 1][:2] + (None,)
        for size, key in ends.get(p, ()):
            covered, count, _ = best[p - size]
            if (covered + size, count - 1) > top[:2]:
                top = (covered + size, count - 1, (p - size, size, key))
        best.append(top)
    out, p = [], len(words)
    while p > 0:
        if (last := best[p][2]) is None:
            p -= 1
        else:
            out.append(last)
            p = last[0]
    return out[::-1]


def phrase_tree(phrases) -> dict:
    """By first word the patterns, longest first. A pattern's later elements are words, sets of words (a slot), or None (any word)."""
    tree: dict[str, list] = {}
    for key, _, pattern in sorted(phrases, key=lambda p: (-len(p[2]), p[0])):
        tree.setdefault(pattern[0], []).append((len(pattern), key, tuple(p if p is None or isinstance(p, str) else frozenset(p) for p in pattern)))
    return tree


def phrase_matches(sentences: DataFrame, phrases) -> DataFrame:
    """deck_id, sentence_ix, start, size, mwe_id. sentences: deck_id, sentence_ix, words (bare, lower case).

    One narrow pass; the phrase table is a dimension that goes to the tasks, and a sentence costs its words, not the phrases.
    """
    tree = phrase_tree(phrases)

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        for batch in batches:
            rows = [(deck, ix, *m) for deck, ix, words in zip(*(c.to_pylist() for c in batch.columns)) for m in segment(words, tree)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["deck_id", "sentence_ix", "start", "size", "mwe_id"])

    schema = "deck_id bigint, sentence_ix int, start int, size int, mwe_id bigint"
    return sentences.select(F.col("deck_id").cast("bigint"), "sentence_ix", "words").mapInArrow(run, schema)


def associations(pairs: DataFrame, least: int = 5) -> DataFrame:
    """a, b, n_ab, n_a, n_b, pmi, llr of neighbouring lemmas (a, b) that occur together `least` times."""
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    left = both.groupBy("a").agg(F.sum("n_ab").alias("n_a"))
    right = both.groupBy("b").agg(F.sum("n_ab").alias("n_b"))
    total = both.agg(F.sum("n_ab").alias("n"))
    rows = both.where(F.col("n_ab") >= least).join(left, "a").join(right, "b").join(total)  # one row

    def part(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    n, x, a, b = (F.col(c).cast("double") for c in ("n", "n_ab", "n_a", "n_b"))
    llr = 2 * (part(x, a * b / n) + part(a - x, a * (n - b) / n) + part(b - x, (n - a) * b / n) + part(n - a - b + x, (n - a) * (n - b) / n))
    return rows.select("a", "b", "n_ab", "n_a", "n_b", F.log2(x * n / (a * b)).alias("pmi"), llr.alias("llr"))
