"""Language ID: segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary (a path that is a parameter; single bytes are
always pieces). A forward algorithm sums the probabilities of all segmentations of each word, with its leading space, and
a text's log-likelihood is the sum over its words; pieces never cross words, so that is the sum over all segmentations of
the text. Piece probabilities come from expectation-maximisation (forward-backward) on a bounded sample of labelled
documents: about SAMPLE of each language, chosen by a hash of the id; the counts behind that choice cover all rows.

Words are scored once for each block of text, many words of like length together: the dynamic programme runs over byte
positions with arrays over words, and is rescaled on the way, so words may have any length. Where only few words are very
long, it runs over the pieces found in each, in windows. Memory of scoring and fitting is bounded whatever the number of
languages is; fitting takes the languages one after another.

Letters are the characters of Unicode's categories L. White space between words counts as one space, so pieces with a
space after their first place never apply.

Defined results: null text and text without any letter give `und` with score 0; ties go to the language that sorts first;
repeated rows get equal results; without labelled rows every row is `und`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _WHITE, arrow_text, crc_fold, mix, table, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE, ROUNDS = 500, 3
SHORT, FEW, WINDOW = 32, 24, 1 << 18  # bytes of a short word; so few long words go one by one; bytes at once of such a word
_BLOCK, _CELLS = 3 << 20, 4 << 20
_FLOOR = 1e-9
_SPACE = b"\xe2\x96\x81"
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_BITS = 20
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        _powers[str(base)] = have = np.cumprod(have)
    return have[:n]


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The model's pieces as bytes (the space mark as a space, first place only), and all 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            p = model.id_to_piece(i).encode().replace(_SPACE, b" ")
            if p and b" " not in p[1:]:
                pieces.add(p)
    return sorted(pieces)


def _sealed(h: np.ndarray, size: int) -> np.ndarray:
    return mix(h + np.uint64(size) * _BYTE[:1])


def _piece_hashes(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        raw = np.frombuffer(p, np.uint8)
        out[i : i + 1] = _sealed((_BYTE[raw] * _power(_STEP, len(raw))).sum(dtype=np.uint64, keepdims=True), len(raw))
    return out


@dataclass
class Pieces:
    """Hashes of the pieces in order, their row numbers, and a bitmap that most other strings miss."""

    hashes: np.ndarray
    rows: np.ndarray
    bitmap: np.ndarray
    longest: int

    @staticmethod
    def of(pieces: list[bytes]) -> Pieces:
        h = _piece_hashes(pieces)
        order = np.argsort(h)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return Pieces(h[order], order.astype(np.int64), bitmap, max(map(len, pieces)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, piece rows) of those that are pieces."""
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        to = np.searchsorted(self.hashes, h[at])
        to[to == len(self.hashes)] = 0
        good = self.hashes[to] == h[at]
        return at[good], self.rows[to[good]]


class Words:
    """Words of like length as rows of bytes, longest first, with the pieces that end at each position."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Each word has a leading space, which isn't in data."""
        self.order = np.argsort(-sizes, kind="stable")
        starts = starts[self.order]
        self.sizes = sizes[self.order] + 1
        width = int(self.sizes.max()) if len(sizes) else 0
        self.alive = np.searchsorted(-self.sizes, -np.arange(width + 1), "right").tolist()
        self.prefix = np.zeros((width + 1, len(sizes)), np.uint64)
        up = _power(_STEP, width + 1)
        for p in range(width):
            n = self.alive[p + 1]
            self.prefix[p + 1, :n] = self.prefix[p, :n] + (_BYTE[data[starts[:n] + p - 1]] if p else _BYTE[32]) * up[p]
        self.width = width

    def edges(self, pieces: Pieces, p: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, words, piece rows) of the pieces that end at p."""
        n, down = self.alive[p], _power(_BACK, self.width + 1)
        for q in range(max(0, p - pieces.longest), p):
            words, rows = pieces.find(_sealed((self.prefix[p, :n] - self.prefix[q, :n]) * down[q], p - q))
            if len(words):
                yield q, words.astype(np.int32), rows.astype(np.int32)

    def log_likelihood(self, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
        """words (in the order they came) x languages."""
        alpha = np.zeros((self.width + 1, len(self.sizes), prob.shape[1]))
        logs = np.zeros((len(self.sizes), prob.shape[1]))
        alpha[0] = 1
        for p in range(1, self.width + 1):
            for q, words, rows in self.edges(pieces, p):
                alpha[p, words] += alpha[q, words] * prob[rows]
            if p % 8 == 0:  # bytes are pieces, so nothing is 0
                n = self.alive[p]
                scale = alpha[p, :n].copy()
                alpha[max(0, p - pieces.longest + 1) : p + 1, :n] /= scale
                logs[:n] += np.log(scale)
        out = np.empty_like(logs)
        out[self.order] = np.log(alpha[self.sizes, np.arange(len(self.sizes))]) + logs
        return out

    def expected(self, pieces: Pieces, prob: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected uses of each piece in short words with weight, for one language's probabilities."""
        held = []
        at = np.arange(len(self.sizes))
        alpha = np.zeros((self.width + 1, len(self.sizes)))
        alpha[0] = 1
        for p in range(1, self.width + 1):
            for q, words, rows in self.edges(pieces, p):
                alpha[p, words] += alpha[q, words] * prob[rows]
                held.append((p, q, words, rows))
        beta = np.zeros_like(alpha)
        beta[self.sizes, at] = weight[self.order] / alpha[self.sizes, at]
        for p, q, words, rows in reversed(held):
            flow = prob[rows] * beta[p, words]
            beta[q, words] += flow
            out += np.bincount(rows, flow * alpha[q, words], minlength=len(out))


def _spans(raw: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, start, piece row) of all pieces in the bytes, by rising end."""
    n = len(raw)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power(_STEP, n))])
    down = _power(_BACK, n + 1)
    found = []
    for size in range(1, min(pieces.longest, n) + 1):
        at, rows = pieces.find(_sealed((prefix[size:] - prefix[:-size]) * down[: n - size + 1], size))
        found.append((at + size, at, rows))
    end, start, rows = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(end, kind="stable")
    return end[order], start[order], rows[order]


def _alphas(alpha: np.ndarray, first: int, spans: tuple, logs: np.ndarray) -> None:
    """Fills log forward values (positions x languages) after `first` from those up to it."""
    end, start, rows = spans
    cuts = np.searchsorted(end, np.arange(first + 1, len(alpha) + 1)).tolist()
    for p, i, j in zip(range(first + 1, len(alpha)), cuts[:-1], cuts[1:]):
        x = alpha[start[i:j]] + logs[rows[i:j]]
        top = x.max(0)
        alpha[p] = top + np.log(np.exp(x - top).sum(0))


def _long_likelihood(word: np.ndarray, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """One word of any length (with its leading space), in windows: log-likelihood by language."""
    held = np.zeros((1, logs.shape[1]))
    for a in range(0, len(word), WINDOW):
        back = len(held) - 1
        raw = word[a - back : a + WINDOW]
        alpha = np.concatenate([held, np.empty((len(raw) - back, logs.shape[1]))])
        _alphas(alpha, back, _spans(raw, pieces), logs)
        held = alpha[-min(len(alpha), pieces.longest + 1) :]
    return held[-1]


def _long_expected(word: np.ndarray, pieces: Pieces, logs: np.ndarray, weight: float, out: np.ndarray) -> None:
    """Adds the expected uses of each piece in one long word, for one language's log-probabilities."""
    end, start, rows = _spans(word, pieces)
    alpha, beta = np.zeros((len(word) + 1, 1)), np.zeros((len(word) + 1, 1))
    _alphas(alpha, 0, (end, start, rows), logs[:, None])
    turned = slice(None, None, -1)
    order = np.argsort(len(word) - start[turned], kind="stable")
    _alphas(beta, 0, tuple(x[turned][order] for x in (len(word) - start, len(word) - end, rows)), logs[:, None])
    out += np.bincount(rows, weight * np.exp(alpha[start, 0] + logs[rows] + beta[len(word) - end, 0] - alpha[-1, 0]), minlength=len(out))


def _groups(sizes: np.ndarray, languages: int) -> Iterator[tuple[np.ndarray, bool]]:
    """(words, whether they go one by one): of like length, so that no group's table is large."""
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        top = max(SHORT, 2 * int(sizes[order[a]]))
        b = int(np.searchsorted(sizes[order], top, "left" if top > SHORT else "right"))
        if sizes[order[a]] > SHORT and b - a < FEW or int(sizes[order[a]]) * languages > _CELLS // FEW:
            yield order[a:b], True
            a = b
            continue
        b = min(b, a + max(FEW, _CELLS // ((int(sizes[order[b - 1]]) + 2) * (languages + 1))))
        yield order[a:b], False
        a = b


def _one_word(data: np.ndarray, start: int, size: int) -> np.ndarray:
    return np.concatenate([np.array([32], np.uint8), data[start : start + size]])


def _distinct(data: np.ndarray, offsets: np.ndarray):
    """(starts, sizes) of the documents' distinct words and, for each word of the text, which of them it is and its document."""
    hashes, starts, ends, first = word_hashes(data, offsets, lower=False)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    doc = np.searchsorted(first, np.arange(len(hashes)), "right") - 1
    return starts[at], (ends - starts)[at], which, doc


def _cuts(data: np.ndarray, a: int, b: int, size: int) -> Iterator[tuple[int, int]]:
    """A long document in parts of about `size` bytes that begin and end at white space."""
    while a < b:
        c = min(a + size, b)
        while c < b and not _WHITE[data[c]]:
            white = np.flatnonzero(_WHITE[data[c : min(c + size, b)]])
            c = c + int(white[0]) if len(white) else min(c + size, b)
        yield a, c
        a = c


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    prob: np.ndarray  # pieces x languages

    def log_likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """documents x languages."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.languages)))
        logs = np.log(self.prob)
        i = 0
        while i < n:
            j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1))
            parts = [offsets[i : j + 1]] if j > i + 1 else [np.array(c) for c in _cuts(data, int(offsets[i]), int(offsets[j]), 4 * _BLOCK)]
            for part in parts:
                starts, sizes, which, doc = _distinct(data, part)
                score = np.empty((len(sizes), len(self.languages)))
                for group, single in _groups(sizes, len(self.languages)):
                    if single:
                        score[group] = [_long_likelihood(_one_word(data, starts[w], sizes[w]), self.pieces, logs) for w in group]
                    else:
                        score[group] = Words(data, starts[group], sizes[group]).log_likelihood(self.pieces, self.prob)
                for c in range(out.shape[1]):
                    out[i:j, c] += np.bincount(doc, score[which, c], minlength=len(part) - 1)
            i = j
        return out


def fit(texts: list[str], languages: list[str], path: str = VOCABULARY, rounds: int = ROUNDS) -> Model | None:
    """Expectation-maximisation over the sample's distinct words, from equal probabilities by piece length; language by language."""
    names = sorted(set(languages))
    if not names:
        return None
    listed = vocabulary(path)
    pieces = Pieces.of(listed)
    floor = max(_FLOOR, 10.0 ** (-280 / pieces.longest))  # keeps the rescaled values of `longest` bytes inside a double
    samples = []
    for name in names:
        raw = [t.encode() for t, lang in zip(texts, languages) if lang == name]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        starts, sizes, which, _ = _distinct(data, np.array([0, len(data)]))
        samples.append((data, starts, sizes, np.bincount(which, minlength=len(sizes)).astype(float)))
    prob = np.repeat(np.array([[0.02 ** min(len(p), 2)] for p in listed]), len(names), axis=1)
    prob /= prob.sum(0)
    for _ in range(rounds):
        uses = np.zeros(prob.shape)
        for c, (data, starts, sizes, weight) in enumerate(samples):
            column, p = np.zeros(len(listed)), np.ascontiguousarray(prob[:, c])
            for group, _ in _groups(np.minimum(sizes, SHORT + 1), 1):
                long = sizes[group] > SHORT
                if not long.all():
                    some = group[~long]
                    Words(data, starts[some], sizes[some]).expected(pieces, p, weight[some], column)
                for w in group[long]:
                    _long_expected(_one_word(data, starts[w], sizes[w]), pieces, np.log(p), weight[w], column)
            uses[:, c] = column
        common = (uses.sum(1, keepdims=True) + 0.01) / (uses.sum() + 0.01 * len(listed))
        prob = (uses + 200 * common) / (uses.sum(0) + 200)
        prob = np.maximum(prob, floor)
    return Model(names, pieces, prob / prob.sum(0))


def train(docs: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE, path: str = VOCABULARY) -> Model | None:
    """docs: doc_id, text, lang. Counts of each language cover all rows; the sample is about `sample` documents of each, whole."""
    known = docs.where("lang is not null and text is not null").where(crc_fold(F.col("doc_id"), folds) != held_out).select("doc_id", "text", "lang")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    share = F.lit(0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, sample / r["n"]) * (1 << 30)) + 1)).otherwise(share)
    got = known.where(chance < share).distinct().toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist(), path)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score (the predicted language's posterior under equal priors)."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            model = shared.value
            texts = batch.column(1)
            good = np.array([has_letter(t) for t in texts.to_pylist()], bool)
            names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None and good.any():
                logs = model.log_likelihoods(*arrow_text(texts))
                best = logs.argmax(1)
                p = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                names = [model.languages[b] if g else "und" for b, g in zip(best, good)]
                score = np.where(good, p, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """Predicted language and score of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    out = predict(docs, train(docs, path=path))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
