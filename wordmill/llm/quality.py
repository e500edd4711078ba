"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over every byte of the UTF-8 text. Activations are rectified and max-pooled over
overlapping chunks (CHUNK bytes, half of it shared with the next chunk) that cover the whole document; mean and maximum
over the chunks feed one logistic unit. A filter's weights for a byte are its embedding times the kernel, kept as one
table, so scoring is gathers and sums.

Fitting uses a bounded sample of labelled rows: at most SAMPLE documents of each label (lowest hash of the id first), each
with its whole text, like scoring. Labels, language, source and id are never inputs. The sample and so the network depend
on the rows only, not on their order or partitions.

Defined results: null and empty texts are scored as one chunk of padding; repeated rows and copies get equal scores; an id
with both labels is an example of each; of different texts under one id the smallest is the example; an empty table gives
an empty table; without labels of both kinds every score is the share of label 1 (0.5 if there is none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_text, crc_fold, numbered_columns, quoted, released, table

WIDTH, FILTERS, CHUNK = 8, 16, 512
SAMPLE, EPOCHS = 1500, 8
_TILE = CHUNK // 2
_PIECE = 1 << 18


@dataclass
class Network:
    kernel: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    head: np.ndarray  # 2 * FILTERS
    offset: float

    def activations(self, raw: np.ndarray) -> np.ndarray:
        """Rectified responses at each place of raw but the last WIDTH - 1."""
        n = len(raw) - WIDTH + 1
        out = np.take(self.kernel[0], raw[:n], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.kernel[j], raw[j : j + n], axis=0)
        out += self.bias
        return np.maximum(out, 0, out=out)

    def tiles(self, text: np.ndarray) -> np.ndarray:
        """Maximum responses for each half chunk, in bounded memory however long the text is."""
        padded = np.concatenate([text, np.zeros(WIDTH - 1 + (len(text) == 0), np.uint8)])
        n = max(1, len(text))
        out = []
        for a in range(0, n, _PIECE):
            b = min(n, a + _PIECE)
            out.append(np.maximum.reduceat(self.activations(padded[a : b + WIDTH - 1]), np.arange(0, b - a, _TILE), axis=0))
        return np.concatenate(out)

    def logit(self, tiles: np.ndarray) -> float:
        pooled = np.maximum(tiles[:-1], tiles[1:]) if len(tiles) > 1 else tiles
        return float(self.head @ np.concatenate([pooled.mean(0), pooled.max(0)]) + self.offset)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability for each document of an Arrow text column."""
        out = np.empty(len(offsets) - 1)
        i, n = 0, len(out)
        while i < n:
            j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1))
            if j == i + 1:
                out[i] = self.logit(self.tiles(data[offsets[i] : offsets[j]]))
            else:  # short documents together, each followed by its padding
                sizes = np.diff(offsets[i : j + 1])
                places = np.maximum(sizes, 1)
                begin = np.concatenate([[0], np.cumsum(places + WIDTH - 1)])
                raw = np.zeros(begin[-1] + WIDTH, np.uint8)
                to = np.repeat(begin[:-1] - (offsets[i:j] - offsets[i]), sizes) + np.arange(sizes.sum())
                raw[to] = data[offsets[i] : offsets[j]]
                act = self.activations(raw)
                counts = -(-places // _TILE)
                first = np.concatenate([[0], np.cumsum(counts)])
                cuts = np.repeat(begin[:-1] - _TILE * first[:-1], counts) + _TILE * np.arange(first[-1])
                ends = np.minimum(cuts + _TILE, np.repeat(begin[:-1] + places, counts))
                top = np.maximum.reduceat(act, np.stack([cuts, ends], 1).ravel(), axis=0)[::2]
                out[i:j] = [self.logit(top[a:b]) for a, b in zip(first[:-1], first[1:])]
            i = j
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _tile_maxima(net: Network, blocks: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectified maxima of each tile, tiles x filters, and their places."""
    act = np.take(net.kernel[0], blocks[:, :_TILE], axis=0)
    for j in range(1, WIDTH):
        act += np.take(net.kernel[j], blocks[:, j : j + _TILE], axis=0)
    act += net.bias
    for i in np.flatnonzero(valid < _TILE):
        act[i, valid[i] :] = -1e9
    where = act.argmax(1)
    return np.maximum(np.take_along_axis(act, where[:, None], 1)[:, 0], 0), where


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the weighted logistic loss; gradients flow through the places that won each maximum."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    params = [net.kernel, net.bias, net.head, np.zeros(1, np.float32)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    views = []  # of each text its tiles (half chunks) with the bytes that the last windows reach into, and their sizes
    for t in texts:
        n = -(-max(1, len(t)) // _TILE)
        raw = np.frombuffer(t + bytes(n * _TILE + WIDTH - 1 - len(t)), np.uint8)
        views.append((np.lib.stride_tricks.sliding_window_view(raw, _TILE + WIDTH - 1)[::_TILE], np.clip(max(1, len(t)) - np.arange(n) * _TILE, 1, _TILE)))
    step, batch = 0, 32
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            blocks = np.concatenate([views[i][0] for i in rows])
            valid = np.concatenate([views[i][1] for i in rows])
            best_at = [_tile_maxima(net, blocks[a : a + 256], valid[a : a + 256]) for a in range(0, len(blocks), 256)]
            tops, where = (np.concatenate(x) for x in zip(*best_at))
            # a chunk is a tile and the next one of the same text, or the only one
            tiles = np.array([len(views[i][1]) for i in rows])
            ends = np.cumsum(tiles)
            left = np.setdiff1d(np.arange(len(blocks)), (ends - 1)[tiles > 1])
            right = np.where(np.isin(left, (ends - 1)[tiles == 1]), left, left + 1)
            sizes = np.maximum(tiles - 1, 1)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            top = np.maximum(tops[left], tops[right])
            won = np.where(tops[left] >= tops[right], left[:, None], right[:, None])
            mean = np.add.reduceat(top, begin[:-1]) / sizes[:, None]
            best = np.maximum.reduceat(top, begin[:-1])
            feats = np.concatenate([mean, best], 1)
            p = 1 / (1 + np.exp(-np.clip(feats @ net.head + params[3][0], -40, 40)))
            g = ((p - labels[rows]) * weights[rows] / weights[rows].sum()).astype(np.float32)
            owner = np.repeat(np.arange(len(rows)), sizes)
            back = g[owner, None] * net.head[None, :FILTERS] / sizes[owner, None]
            back = back + g[owner, None] * net.head[None, FILTERS:] * (top == best[owner])
            back = np.where(top > 0, back, 0).astype(np.float32)
            r, f = np.nonzero(back)
            tile = won[r, f]
            grad_kernel = np.stack([np.bincount(blocks[tile, where[tile, f] + j].astype(np.int64) * FILTERS + f, back[r, f], 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)]).astype(np.float32)
            grads = [grad_kernel, back.sum(0), (g @ feats).astype(np.float32) + 1e-4 * net.head, np.array([g.sum()], np.float32)]
            step += 1
            for p_, m, v, gr in zip(params, first, second, grads):
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.offset = float(params[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Network | float:
    """Fits on labelled documents outside the held-out fold; returns the share of label 1 if there is only one label.

    Labels are counted over all rows; what comes to the driver is the sample: `sample` ids of each label, then their texts.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(crc_fold(F.col("doc_id"), folds) != held_out)
    count = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return float(next(iter(count))) if count else 0.5
    picked = []
    for q in (0, 1):
        picked += known.where(F.col("quality") == q).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    spark = docs.sparkSession
    few = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in picked], "k bigint, y int")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("k"), "text").join(F.broadcast(few), "k")
    got = rows.groupBy("k", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).toArrow().sort_by([("k", "ascending"), ("y", "ascending")])
    if got.num_rows == 0:
        return count[1] / (count[0] + count[1])
    y = got.column("y").to_numpy().astype(float)
    taken = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    weight = np.array([count[int(v)] / taken[int(v)] for v in y])
    return fit([t.encode() for t in got.column("text").to_pylist()], y, weight / weight.mean())


def with_scores(docs: DataFrame, model: Network | float, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs and the score, in one narrow pass over whole texts."""
    frame = docs.select(F.coalesce("text", F.lit("")), *quoted(keep))
    plain = numbered_columns(frame)
    out = ["score", *plain.columns[1:]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = arrow_text(batch.column(0))
            score = model.scores(data, offsets) if isinstance(model, Network) else np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64()), *batch.columns[1:]], out)

    schema = ", ".join(["score double", *(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[1:])])
    return plain.mapInArrow(released(run), schema).toDF(name, *keep).select(*quoted([*keep, name]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, prediction and fold of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = with_scores(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
