"""Best-fit packing with bins of several permitted sequence lengths.

Lengths are code points plus one separator. A document longer than the largest bin is cut into pieces of that length.
Pieces are dealt by a hash into shards of about SHARD code points (and SHARD_ROWS rows); each shard is packed on its own,
so no shard grows with the data. Within a shard pieces go in order of decreasing length into the open bin with the least
sufficient room (best fit). If none has room, a bin is opened, by one of several policies: the length of least cost for
each code point that can still come into it (short bins pay for their overhead, long ones for the square), or the cheapest
that holds the piece and is at least the policy's. Every policy is tried over the whole shard, every bin is finally downsized to the smallest permitted length that holds its contents, and the policy of least total cost wins. The
cost of a length c is c + OVERHEAD + QUADRATIC * c * c / largest.

Defined results: null and empty texts take one place (the separator); equal lengths go by id, then by piece; repeated
rows are packed one by one; a null id is packed like others; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table

LENGTHS = (2048, 4096, 8192, 16384, 32768)
OVERHEAD, QUADRATIC = 32.0, 0.1
SHARD, SHARD_ROWS = 1 << 24, 100_000


def cost(length: int, lengths: tuple[int, ...] = LENGTHS) -> float:
    return length + OVERHEAD + QUADRATIC * length * length / lengths[-1]


def best_fit(sizes: list[int], lengths: tuple[int, ...], least: int | None) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset, contents of each bin) for pieces in decreasing order.

    Bins open with at least `least`, as cheap as possible; with None by the least cost for each code point that can still
    come into the bin.
    """
    left = sum(sizes)
    rooms: list[int] = []  # different rooms of open bins, sorted
    bins_with: dict[int, list[int]] = {}
    capacity: list[int] = []
    filled: list[int] = []
    where, offset = [], []
    for size in sizes:
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = bins_with[room]
            b = stack.pop()
            if not stack:
                del bins_with[room], rooms[at]
        else:
            able = [c for c in lengths if c >= max(size, least or 0)] or [lengths[-1]]
            b = len(capacity)
            capacity.append(min(able, key=lambda c: (cost(c, lengths) / (min(c, left) if least is None else 1), c)))
            filled.append(0)
            room = capacity[b]
        left -= size
        where.append(b)
        offset.append(filled[b])
        filled[b] += size
        room -= size
        if room:
            if room not in bins_with:
                insort(rooms, room)
                bins_with[room] = []
            bins_with[room].append(b)
    return where, offset, filled


def downsized(filled: list[int], lengths: tuple[int, ...]) -> list[int]:
    return [lengths[bisect_left(lengths, n)] for n in filled]


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset, final length of each bin) by the policy of least total cost."""
    best = None
    for least in (None, *lengths):
        where, offset, filled = best_fit(sizes, lengths, least)
        final = downsized(filled, lengths)
        total = sum(cost(c, lengths) for c in final)
        if best is None or total < best[0]:
            best = (total, where, offset, final)
    return best[1:] if best else ([], [], [])


def _pack_shards(with_text: bool, lengths: tuple[int, ...]):
    def run(batches):
        import pyarrow as pa

        def packed(shard, rows):
            rows.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[4] if with_text else ""))
            where, offset, final = pack([r[3] for r in rows], lengths)
            columns = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([(shard << 32) + b for b in where], pa.int64()),
                pa.array([final[b] for b in where], pa.int64()),
                pa.array(offset, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "bin_id", "capacity", "bin_offset"]
            if with_text:
                columns.append(pa.array([r[4] for r in rows], pa.string()))
                names.append("text")
            return pa.RecordBatch.from_arrays(columns, names)

        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if rows:
                        yield packed(now, rows)
                    now, rows = shard, []
                rows.append(row)
        if rows:
            yield packed(now, rows)

    return run


def _cutter(step: int):
    """Documents into pieces of at most `step` code points; slices of a Python text don't start from its first character."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                rows += [(key, i, a, min(step, len(text) - a) + 1, text[a : a + step]) for i, a in enumerate(range(0, max(1, len(text)), step))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], ["doc_id", "piece", "start", "length", "text"])

    return run


def pack_documents(docs: DataFrame, with_text: bool = False, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, bin_offset (and the piece's text): one row for each piece."""
    spark = docs.sparkSession
    largest = lengths[-1]
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("__n"), *(["text"] if with_text else []))
    total = base.agg(F.sum(F.col("__n") + 1).alias("s"), F.count("*").alias("n")).first()
    shards = max(1, -(-(total["s"] or 0) // SHARD), -(-total["n"] // SHARD_ROWS))
    # a piece of a cut document fills its bin to the last place but one, which is the separator's
    step = largest - 1
    if with_text:
        cut = base.select("doc_id", "text").mapInArrow(_cutter(step), "doc_id bigint, piece int, start bigint, length bigint, text string")
    else:
        piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("__n") - 1) / step)).cast("int")))
        cut = base.withColumn("piece", piece).withColumn("start", F.col("piece").cast("bigint") * step)
        cut = cut.withColumn("length", F.least(F.col("__n") - F.col("start"), F.lit(step)) + 1)
    shard = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)).cast("bigint")
    rows = cut.select(shard.alias("shard"), "doc_id", "piece", "start", "length", *(["text"] if with_text else []))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    dealt = rows.repartition(width, "shard").sortWithinPartitions("shard")
    schema = "doc_id bigint, piece int, start bigint, length bigint, bin_id bigint, capacity bigint, bin_offset bigint" + (", text string" if with_text else "")
    return dealt.mapInArrow(released(_pack_shards(with_text, lengths)), schema)


def lower_bound(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> float:
    """No packing costs less: the least cost of a code point times their number. For tests."""
    return float(np.sum(sizes)) * min(cost(c, lengths) / c for c in lengths)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin, length of the bin and place of every document's pieces."""
    return pack_documents(table(spark, sf_dir, "documents"))
