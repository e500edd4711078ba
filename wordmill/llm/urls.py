"""URL filters: rules on host and path, and a character language-model ratio for the rest.

URLs that an allow rule fits are the accepted sample, those of a block rule the rejected one. For each class a
variable-order Markov model (contexts of 0 to ORDER bytes) mixes every order with the next lower one (Dirichlet
smoothing). Counts cover all rows and are exact: an n-gram of at most ORDER + 1 bytes is its own key, so none share a
counter. The model that goes to the executors has one entry for each different n-gram and grows with them. One fifth of the URLs (by crc32) is kept out of the
counts and calibrates the threshold on the length-normalised difference of log-likelihoods (least balanced error).

Defined results: a null url, or one without ``://``, has empty host and path and no rule; a null url is judged as an empty
one, by the model; repeated urls get equal verdicts; without accepted URLs everything that no rule fits is blocked, without rejected
ones it is allowed; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table

ORDER, SLOTS, STRENGTH = 4, 1 << 17, 4.0
_BINS, _SPAN = 800, 4.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else nulls; of equally long ones the first listed."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (text, verdict) if text is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


# ------------------------------------------------------------------ the model


def _grams(urls: list[bytes], slots: int | None = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, their contexts), each ORDER + 1 x symbols, and the first symbol of each url.

    A url is preceded by ORDER start marks and followed by an end mark. Without `slots` n-grams and contexts are exact keys
    (the order, then the bytes; a context is its n-grams' keys >> 8), else hashes below `slots`.
    """
    raw = np.frombuffer(b"".join(b"\x02" * ORDER + u + b"\x03" for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(sizes.sum()) + ORDER * (np.repeat(np.arange(len(urls)), sizes) + 1)
    context = np.zeros(len(at), np.int64)
    contexts = []
    for k in range(ORDER + 1):
        if k:
            context = context | raw[at - k] << 8 * (k - 1)
        contexts.append(context | k << 8 * ORDER)
    contexts = np.stack(contexts)
    grams = contexts << 8 | raw[at]
    if slots is not None:
        grams, contexts = ((mix(x.astype(np.uint64)) % np.uint64(slots)).astype(np.int64) for x in (grams, contexts))
    return grams, contexts, first


def _at(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The counts (class x key) of the wanted keys; 0 where there is none. keys: sorted, not empty."""
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, counts[:, i], 0)


class Ratio:
    """keys: the different n-grams, sorted; counts: class (0 rejected, 1 accepted) x n-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, threshold: float = 0.0):
        self.keys, self.counts, self.threshold = keys, counts, threshold
        self.contexts, first = np.unique(keys >> 8, return_index=True)
        self.totals = np.add.reduceat(counts, first, axis=1) if len(keys) else counts

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Log-likelihood under the accepted model minus that under the rejected one, for each symbol of a url."""
        if not urls:
            return np.zeros(0)
        grams, contexts, first = _grams(urls, None)
        # a symbol's share depends on its longest n-gram only
        _, some, back = np.unique(grams[ORDER], return_index=True, return_inverse=True)
        p = np.full((2, len(some)), 1 / 257)
        for k in range(ORDER + 1):
            seen = _at(self.contexts, self.totals, contexts[k, some])
            p = (_at(self.keys, self.counts, grams[k, some]) + STRENGTH * p) / (seen + STRENGTH)
        total = np.add.reduceat((np.log(p[1]) - np.log(p[0]))[back], first)
        return total / np.diff(np.append(first, grams.shape[1]))


def train(urls: DataFrame) -> Ratio | str:
    """urls: url, verdict (of a rule). Two passes over all rows: counts, then the calibration's histogram."""
    known = urls.where("url is not null and verdict is not null").select("url", (F.col("verdict") == "allow").alias("good"), (F.crc32(F.col("url").cast("binary")) % 5 == 0).alias("calibrate"))
    spark = urls.sparkSession

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for c in (0, 1):
                if part := [u.encode() for u, good in rows if good == bool(c)]:
                    keys, n = np.unique(_grams(part, None)[0], return_counts=True)
                    zero = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, zero if c else n, n if c else zero)], ["key", "bad", "good"])

    counted = known.where(~F.col("calibrate")).select("url", "good").mapInArrow(count, "key bigint, bad bigint, good bigint")
    sums = counted.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    keys = sums.column("key").to_numpy()
    order = np.argsort(keys)
    model = Ratio(keys[order], np.stack([sums.column(c).to_numpy()[order] for c in ("bad", "good")]))
    if not model.counts[1].any():
        return "block"
    if not model.counts[0].any():
        return "allow"
    shared = spark.sparkContext.broadcast(model)

    def histogram(batches):
        import pyarrow as pa

        total = np.zeros((2, _BINS), np.int64)
        for batch in batches:
            s = shared.value.scores([u.encode() for u in batch.column(0).to_pylist()])
            b = np.clip(((s + _SPAN) * _BINS / (2 * _SPAN)).astype(int), 0, _BINS - 1)
            np.add.at(total, (np.array(batch.column(1).to_pylist(), int), b), 1)
        c, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[c, b])], ["c", "b", "n"])

    bins = np.zeros((2, _BINS))
    for r in known.where("calibrate").select("url", "good").mapInArrow(histogram, "c int, b int, n bigint").groupBy("c", "b").agg(F.sum("n").alias("n")).collect():
        bins[r["c"], r["b"]] = r["n"]
    model.threshold = calibrated(bins)
    shared.unpersist()
    return model


def calibrated(bins: np.ndarray) -> float:
    """The threshold with the least sum of both error shares; of equal ones the middle of the range nearest 0; 0 without data."""
    if not bins.sum(1).all():
        return 0.0
    share = bins / bins.sum(1, keepdims=True)
    error = np.concatenate([[0], np.cumsum(share[1])]) + 1 - np.concatenate([[0], np.cumsum(share[0])])
    edges = np.linspace(-_SPAN, _SPAN, _BINS + 1)
    best = edges[np.isclose(error, error.min())]
    return float((best.min() + best.max()) / 2) if best.min() > 0 or best.max() < 0 else 0.0


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id") -> DataFrame:
    """key, url, host, path, rule, verdict, score for every row."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(key), F.col("url")).withColumns({"host": host, "path": path})
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": text, "verdict": verdict})
    model = train(ruled)
    kind = pages.schema[key].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            model = shared.value
            urls = [u or "" for u in batch.column(1).to_pylist()]
            if isinstance(model, str):
                score = np.zeros(len(urls))
                other = [model] * len(urls)
            else:
                score = model.scores([u.encode() for u in urls])
                other = ["allow" if s > model.threshold else "block" for s in score]
            said = [v or o for v, o in zip(batch.column(5).to_pylist(), other)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(said, pa.string()), pa.array(score, pa.float64())], [key, "url", "host", "path", "rule", "verdict", "score"])

    return ruled.mapInArrow(run, f"`{key}` {kind}, url string, host string, path string, rule string, verdict string, score double")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("bigint").alias("page_id"), "host", "path", "rule", "verdict", "score")


_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def brute_host_path(url: str | None) -> tuple[str, str]:
    """The same split in plain Python, for tests."""
    m = _HOST.search(url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
