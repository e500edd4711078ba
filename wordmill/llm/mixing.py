"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash, form blocks of BLOCK documents. A source of weight w of W in all has its
block j released at floor(j * W / w) and due at ceil((j + 1) * W / w), in whole numbers of any size, so without rounding;
in every slot the released block with the earliest deadline runs (ties: smaller source name). All sources together fill
every slot, so no deadline is missed and after every slot each source is less than one block from its exact share. The
driver computes the slots of the whole mix, one for each block; documents find theirs by a join on source and block. With
`period`, on request only, weights are rounded to whole slots of a period that repeats.

The mix goes on until every document has had its turn at least once; a source that is short for its weight starts again
(`epoch`). No document is dropped. Default weights are the sources' shares raised to ALPHA and normalised, which lifts
small sources and lowers a hot one.

Defined results: a null source is the source `(null)`, or a longer name where a source has that one; repeated rows are
documents of their own, and rows of one id are told apart by their other columns; null and empty texts are
documents like others; with one source the mix is that source once; an empty table gives an empty table; other columns
stay. A weight of 0 leaves a source out, on request only.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, table

BLOCK, ALPHA = 16, 0.8
SALT_ROWS, SALTS = 4_000, 512
BROADCAST = 64 << 20  # bytes of slots that may go to every executor


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots for each source that sum to the period (largest remainders; at least one for a positive weight)."""
    good = {s: w for s, w in sorted(weights.items()) if w > 0}
    if len(good) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(good.values())
    exact = {s: w * period / total for s, w in good.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (left := period - sum(out.values())) != 0:
        step = 1 if left > 0 else -1
        able = [s for s in out if step > 0 or out[s] > 1]
        pick = sorted(able, key=lambda s: (step * (out[s] - exact[s]), s))[: abs(left)]
        for s in pick:
            out[s] += step
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The positive weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in sorted(weights.items()) if w > 0}
    common = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


def turns(slots: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of slot 0, 1 and so on without an end: earliest deadline first."""
    period = sum(slots.values())
    waiting = [(0, s, 0) for s in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[s]), s, j, release))
        due, s, j, release = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        yield s, j, release, due
        heapq.heappush(waiting, ((j + 1) * period // slots[s], s, j + 1))
        t += 1


def schedule(slots: dict[str, int]) -> dict[str, list[int]]:
    """Earliest deadline first over one period: for each source the slots of its blocks, in order."""
    out: dict[str, list[int]] = {s: [] for s in slots}
    for t, (s, *_) in zip(range(sum(slots.values())), turns(slots)):
        out[s].append(t)
    return out


def plan(counts: dict[str, int], weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None) -> tuple[list[str], dict[str, np.ndarray]]:
    """(sources, columns source (its index), block, slot, release, deadline) of every slot until each document was placed once."""
    counts = {s: n for s, n in counts.items() if n > 0}
    given = {s: (weights or {}).get(s, 0.0) if weights else n**ALPHA for s, n in counts.items()}
    slots = whole(given) if period is None else shares(given, period) if counts else {}
    names, out = sorted(slots), array("q")
    index = {s: i for i, s in enumerate(names)}
    left = {s: -(-counts[s] // block) for s in names}
    open_ = len(names)
    for s, j, release, due in turns(slots) if names else ():
        out.extend((index[s], j, release, due))
        open_ -= j + 1 == left[s]
        if not open_:
            break
    columns = np.frombuffer(out, np.int64).reshape(-1, 4) if out else np.zeros((0, 4), np.int64)
    return names, {"source": columns[:, 0], "block": columns[:, 1], "slot": np.arange(len(columns)), "release": columns[:, 2], "deadline": columns[:, 3]}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None) -> DataFrame:
    """row (a document's columns as a struct), source_key, epoch, block, release, deadline, slot, position (unique, from 0).

    A source's documents are numbered in parts: by a salt of the hash, each part far smaller than a hot source, with the
    parts' sizes summed beforehand.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n")).collect()}
    (none,) = fresh((s for s in counts if s is not None), "(null)")
    counts = {none if s is None else s: n for s, n in counts.items()}
    plain = quoted(f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString())
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce("source", F.lit(none)).alias("source_key"), F.xxhash64("doc_id", F.lit(17)).alias("__h"), F.xxhash64(*plain).alias("__all_columns"))
    salts = max(SALTS, 1 << (max([1, *counts.values()]) // SALT_ROWS).bit_length())
    keyed = keyed.withColumn("__salt", F.pmod(F.shiftrightunsigned("__h", 20), F.lit(salts)).cast("int"))
    parts = keyed.groupBy("source_key", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("source_key").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source_key").alias("__s"), F.col("__salt").alias("__t"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    names, columns = plan(counts, weights, block, period)
    placed_blocks = np.bincount(columns["source"], minlength=len(names))
    rows = [(s, i, block * int(n), counts[s]) for i, (s, n) in enumerate(zip(names, placed_blocks))]
    entry = spark.createDataFrame(rows, "__s2 string, __k long, __need long, __all long")
    slots = spark.createDataFrame(pa.table({f"__{k}": v for k, v in columns.items()}))
    inside = Window.partitionBy("source_key", "__salt").orderBy("__h", "row.doc_id", "__all_columns")
    ranked = keyed.withColumn("__r", F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, (F.col("source_key") == F.col("__s")) & (F.col("__salt") == F.col("__t"))).withColumn("__r", F.col("__r") + F.col("__before"))
    planned = ranked.join(F.broadcast(entry), F.col("source_key") == F.col("__s2")).where(F.col("__r") < F.col("__need"))
    last = F.floor((F.col("__need") - 1 - F.col("__r")) / F.col("__all"))
    placed = planned.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    i = F.col("__r") + F.col("epoch") * F.col("__all")
    placed = placed.withColumn("__i", i.cast("bigint")).withColumn("block", F.expr(f"__i div {block}"))
    # one row of five numbers for every `block` documents: beyond a bound they are joined by a shuffle, in which a hot source
    # is no hot key, as blocks are part of it
    small = sum(v.nbytes for v in columns.values()) <= BROADCAST
    placed = placed.join(F.broadcast(slots) if small else slots, (F.col("__k") == F.col("__source")) & (F.col("block") == F.col("__block")))
    placed = placed.withColumns({"release": F.col("__release"), "deadline": F.col("__deadline"), "slot": F.col("__slot")})
    placed = placed.withColumn("position", F.col("slot") * block + F.col("__i") % block)
    return placed.select("row", "source_key", "epoch", "block", "release", "deadline", "slot", "position")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents in the order of the mix (range-partitioned and sorted), with their own columns only."""
    placed = mix(docs).select("row", "position")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places in the mix of all sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("source_key").alias("source"), "epoch", "block", "release", "deadline", "slot", "position")
