"""Approximate nearest neighbours: NN-descent builds a graph by Spark joins, greedy search answers queries.

Equal vectors form one class (its smallest id, and the smallest ids that a result can need); the graph is over classes.

* Start: random hyperplanes through the mean deal the vectors into blocks, split by a hash to a bounded size; each vector
  takes the nearest of its block. The number of dealings grows with the logarithm of the vectors' number.
* NN-descent: each round joins neighbours of neighbours. A vector's neighbours in either direction (of a hub's reverse
  neighbours some, new ones first, cut in each map task) meet, and pairs of which one is new to it are compared; each takes
  the OFFERS nearest there that beat the farthest neighbour it holds. Offers are cut to the K best before the shuffle.
  Rounds go on until at most CHANGE of the neighbours changed.
* Search: each query keeps a beam of the BEAM nearest classes seen. In a round the nearest EXPAND of them that weren't
  expanded are joined with the graph (both directions), the neighbours' distances are taken, and the beam is merged. It
  ends when every member of every beam is expanded.
* Lists of ids meet the vectors by hashed parts of bounded size; a part gets each vector it needs once.
* A step has few exchanges: rows of several kinds go by one key to a task that puts them together. Each exchange costs the
  driver threads, plans and the figures of its tasks, whatever the rows are.
* All distances are sums of squared differences in double precision, so the beam is ranked exactly whatever the vectors'
  offset or size is; vectors of extreme size are scaled by a power of two for that. (Products of matrices only tell which
  pairs are worth a difference.) Classes become ids again, ties going to the smaller id.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; shorter vectors
count as filled up with zeros; repeated rows of one id count once if their vectors are equal; with fewer candidates than
asked, all are returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix, scratch, spread_join, table

TOP, NEIGHBOURS, BLOCK, CHANGE, OFFERS = 10, 32, 512, 0.12, 8
BEAM, EXPAND, ENTRIES = 128, 64, 32
PART = 8_000  # vectors of a part, about
_MOST = 500  # rounds; more mean a fault


def _numbers(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lists(values: np.ndarray, ends: np.ndarray, kind):
    """An Arrow list column from flat values and the first place of each list (one more at the end)."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _starts(owner: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner)) if len(owner) else np.zeros(1, np.int64)


def _best(owner: np.ndarray, other: np.ndarray, dist: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each owner its k nearest different others, as known ones where they are: rows sorted by owner and distance."""
    order = np.lexsort((new, other, owner))
    owner, other, dist, new = owner[order], other[order], dist[order], new[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, dist, new = owner[keep], other[keep], dist[keep], new[keep]
    order = np.lexsort((other, dist, owner))
    owner, other, dist, new = owner[order], other[order], dist[order], new[order]
    ends = _starts(owner)
    keep = np.arange(len(owner)) - np.repeat(ends[:-1], np.diff(ends)) < k
    return owner[keep], other[keep], dist[keep], new[keep]


_GRAPH = "u bigint, ids array<bigint>, dist array<double>, new array<boolean>"


def _packed(owner, other, dist, new):
    """A batch of graph rows from rows sorted by owner."""
    import pyarrow as pa

    ends = _starts(owner)
    return pa.RecordBatch.from_arrays([pa.array(owner[ends[:-1]]), _lists(other, ends, pa.int64()), _lists(dist, ends, pa.float64()), _lists(new, ends, pa.bool_())], ["u", "ids", "dist", "new"])


def _nearest_of_each(k: int):
    """Graph rows, several for an owner, to one with the k nearest of all."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column(1).value_lengths().to_numpy()
                held.append((np.repeat(batch.column(0).to_numpy(), sizes), *(batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))))
                size += len(held[-1][0])
            if size > 2_000_000:
                held = [_best(*(np.concatenate(c) for c in zip(*held)), k)]
                size = len(held[0][0])
        if size:
            yield _packed(*_best(*(np.concatenate(c) for c in zip(*held)), k))

    return run


def _merged(rows: DataFrame, k: int, width: int) -> DataFrame:
    """The k nearest of each u over several rows of lists, cut before the shuffle and after it."""
    cut = _nearest_of_each(k)
    return rows.mapInArrow(cut, _GRAPH).repartition(width, "u").mapInArrow(cut, _GRAPH)


def _differences(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows a of x and b of y, from their differences."""
    out = np.empty(len(a))
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    for i in range(0, len(a), step):
        d = x[a[i : i + step]] - y[b[i : i + step]]
        out[i : i + step] = np.einsum("ij,ij->i", d, d)
    return out


def _products(x: np.ndarray) -> tuple[np.ndarray, float]:
    """All squared distances by products, around the rows' mean, and a bound of their error."""
    x = x - x.mean(0)
    norm = np.einsum("ij,ij->i", x, x)
    d = norm[:, None] + norm[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    return d, float(norm.max()) * 1e-14 * x.shape[1]


# ------------------------------------------------------------------ classes of equal vectors


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec of the vectors that take part."""
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.select("vec_id", "vec").where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(sound)


def _filled(size: int) -> Column:
    """All of one length, and no negative zeros."""
    return F.concat(F.transform("vec", lambda x: x + F.lit(0.0)), F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vec")))


def classes(good: DataFrame, size: int, keep: int = TOP + 1) -> DataFrame:
    """rep, ids (the `keep` smallest of the class, sorted), vec (of `size` doubles) from usable vectors."""
    good = good.select(_filled(size).alias("vec"), F.array("vec_id").alias("ids"))

    def merge(batches):
        """The smallest ids of each different vector in the task."""
        import pyarrow as pa

        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for key, ids in zip(_numbers(batch.column(0)), batch.column(1).to_pylist()):
                key = key.tobytes()
                held[key] = sorted({*held.get(key, ()), *ids})[:keep] if key in held else ids[:keep]
        keys = list(held)
        for at in range(0, len(keys), 2000):
            some = keys[at : at + 2000]
            matrix = np.frombuffer(b"".join(some), np.float64).reshape(len(some), -1)
            yield pa.RecordBatch.from_arrays([_lists(matrix.ravel(), np.arange(len(some) + 1) * matrix.shape[1], pa.float64()), pa.array([held[k] for k in some], pa.list_(pa.int64()))], ["vec", "ids"])

    width = int(good.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "vec array<double>, ids array<bigint>"
    merged = good.mapInArrow(merge, kind).repartition(width, "vec").mapInArrow(merge, kind)
    return merged.select(F.element_at("ids", 1).alias("rep"), "ids", "vec")


def _mean(points: DataFrame, size: int) -> np.ndarray:
    """The mean vector; each task gives one row."""

    def run(batches):
        import pyarrow as pa

        n, total = 0, np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total += _numbers(batch.column(0)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), _lists(total, np.array([0, size]), pa.float64())], ["n", "total"])

    rows = points.select("x").mapInArrow(run, "n bigint, total array<double>").collect()
    return np.sum([r["total"] for r in rows], axis=0) / max(1, sum(r["n"] for r in rows)) if rows else np.zeros(size)


# ------------------------------------------------------------------ the graph


def _start(points: DataFrame, count: int, mean: np.ndarray, k: int, seeds: range) -> DataFrame:
    """Each point's nearest in a block of points on the same sides of random hyperplanes; a dealing for each seed, all in one pass."""
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(60, max(0, (count // BLOCK).bit_length() - 1))
    planes = [np.random.default_rng(seed).normal(size=(bits, len(mean))) for seed in seeds]

    def side(batches):
        import pyarrow as pa

        for batch in batches:
            x = _numbers(batch.column(1))
            for seed, plane in zip(seeds, planes):
                code = (((x - mean) @ plane.T > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits and len(x) else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), seed, np.int32)), pa.array(code.astype(np.int64))], ["u", "x", "seed", "code"])

    coded = points.mapInArrow(side, "u bigint, x array<double>, seed int, code bigint")
    parts = coded.groupBy("seed", "code").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    blocks = spread_join(coded, parts, ["seed", "code"], ["u"]).withColumn("part", F.pmod(F.xxhash64("u", "seed"), F.col("parts")).cast("int"))
    dealt = blocks.select("seed", "code", "part", "u", "x").repartition(width, "seed", "code", "part").sortWithinPartitions("seed", "code", "part")

    def nearest(batches):
        def near(ids, x):
            ids, x = np.array(ids, np.int64), np.stack(x)
            n = len(ids)
            if n < 2:
                return None
            d, _ = _products(x)
            m = min(k + 8, n - 1)
            a, b = np.repeat(np.arange(n), m), np.argpartition(d, m - 1, 1)[:, :m].ravel()
            return _packed(*_best(ids[a], ids[b], _differences(x, a, x, b), np.ones(len(a), bool), k))

        now, ids, x = None, [], []
        for batch in batches:
            rows, names = _numbers(batch.column(4)), batch.column(3).to_pylist()
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if key != now:
                    if ids and (out := near(ids, x)) is not None:
                        yield out
                    now, ids, x = key, [], []
                ids.append(names[i])
                x.append(rows[i])
        if ids and (out := near(ids, x)) is not None:
            yield out

    return dealt.mapInArrow(nearest, _GRAPH)


def _both_ways(graph: DataFrame, most: int, width: int, nearest: bool) -> DataFrame:
    """u, ids, new: neighbours in both directions; of the reverse ones the `most` nearest, or new ones first and then any.

    One exchange: a task sends its graph rows as they are, and the reverse ones that it has, cut.
    """

    def edges(batch):
        sizes = batch.column(1).value_lengths().to_numpy()
        return np.repeat(batch.column(0).to_numpy(), sizes), *(batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))

    def marked(rows, back: bool):
        import pyarrow as pa

        out = _packed(*rows)
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, back))], [*out.schema.names, "back"])

    def cut(held):
        return _best(*(np.concatenate(c) for c in zip(*held)), most)

    def turn(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v, dist, new = rows = edges(batch)
            yield marked(rows, False)
            drawn = dist if nearest else np.where(new, 0.0, 1.0) + (mix(_hashed(u) ^ v.view(np.uint64)) >> np.uint64(44)) / float(1 << 20)
            held.append((v, u, drawn, new))
            size += len(u)
            if size > 2_000_000:
                held = [cut(held)]
                size = len(held[0][0])
        if size:
            yield marked(cut(held), True)

    def meet(batches):
        held, own, size = [], [], 0
        for batch in batches:
            back = batch.column(4).to_numpy(zero_copy_only=False)
            if not back.all():
                own.append(edges(batch.take(_positions(~back))))
            if back.any():
                held.append(edges(batch.take(_positions(back))))
                size += len(held[-1][0])
            if size > 2_000_000:
                held = [cut(held)]
                size = len(held[0][0])
        rows = [np.concatenate(c) for c in zip(*own, *([cut(held)] if size else []))]
        if rows:
            order = np.argsort(rows[0], kind="stable")  # the own ones stay before the reverse ones
            yield _packed(*(c[order] for c in rows))

    return graph.mapInArrow(turn, _GRAPH + ", back boolean").repartition(width, "u").mapInArrow(meet, _GRAPH).select("u", "ids", "new")


def _hashed(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a bigint, as unsigned numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, n):
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    h = (np.uint64(42 + 8) + p5) ^ turned(values.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _part(column: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _part_of(values: np.ndarray, parts: int) -> np.ndarray:
    """The same in numpy."""
    return (_hashed(values).view(np.int64) % parts).astype(np.int32)


_MAIL = "part int, kind int, a bigint, ids array<bigint>, new array<boolean>, far double, x array<double>"
_MAIL_NAMES = ["part", "kind", "a", "ids", "new", "far", "x"]


def _mail(kind: int, part: Column, a: Column, ids=None, new=None, far=None, x=None) -> list[Column]:
    types = ("array<bigint>", "array<boolean>", "double", "array<double>")
    rest = [(F.lit(None) if c is None else c).cast(t).alias(n) for c, t, n in zip((ids, new, far, x), types, ("ids", "new", "far", "x"))]
    return [part.cast("int").alias("part"), F.lit(kind).alias("kind"), a.alias("a"), *rest]


def _by_part(batches):
    """Of each part in the task: its rows by kind, as (a, ids' sizes, flat ids, flat new, far, matrix)."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        key = part.astype(np.int64) * 4 + kind
        for k in np.unique(key).tolist():
            held.setdefault(divmod(k, 4), []).append(batch.take(_positions(key == k)))
    for part in sorted({p for p, _ in held}):
        yield {kind: held.pop((part, kind)) for kind in range(4) if (part, kind) in held}


def _positions(mask: np.ndarray):
    import pyarrow as pa

    return pa.array(np.flatnonzero(mask))


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _vectors(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, far, matrix) sorted by id."""
    ids = np.concatenate([b.column(2).to_numpy() for b in batches])
    far = np.concatenate([b.column(5).to_numpy(zero_copy_only=False) for b in batches])
    x = np.concatenate([_numbers(b.column(6)) for b in batches])
    order = np.argsort(ids, kind="stable")
    return ids[order], far[order], x[order]


def _descend(points: DataFrame, graph: DataFrame, k: int, parts: int, width: int) -> DataFrame:
    """One round of NN-descent."""
    infinite = F.lit(float("inf"))
    lists = materialize(_both_ways(graph, k, width, False).where(F.exists("new", lambda n: n)), "nn-lists")
    place = _part(F.col("u"), parts)

    def ask(batches):
        """The vectors that lists need, with the part that needs them, once for each batch."""
        import pyarrow as pa

        for batch in batches:
            u, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy()
            u, p = _different(np.concatenate([batch.column(2).flatten().to_numpy(), u]), np.concatenate([np.repeat(p, sizes), p]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(p)], ["u", "p"])

    def send(batches):
        """Of a task's vectors: to each part those that it needs, with the distance of the farthest neighbour they hold."""
        import pyarrow as pa

        got: list[list] = [[], [], []]
        for batch in batches:
            kind = batch.column(1).to_numpy()
            for i in np.unique(kind).tolist():
                got[i].append(batch.take(_positions(kind == i)))
        if not got[0] or not got[2]:
            return
        ids, far, x = _vectors(got[0])
        far = np.full(len(ids), np.inf)
        for b in got[1]:
            far[np.searchsorted(ids, b.column(2).to_numpy())] = b.column(5).to_numpy()
        u, p = _different(*(np.concatenate([b.column(i).to_numpy() for b in got[2]]) for i in (2, 0)))
        step = max(1, (1 << 20) // max(1, x.shape[1]))
        for i in range(0, len(u), step):
            at = np.searchsorted(ids, u[i : i + step])
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(p[i : i + step]), pa.array(np.zeros(n, np.int32)), pa.array(ids[at]), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.bool_())), pa.array(far[at]), _lists(x[at].ravel(), np.arange(n + 1) * x.shape[1], pa.float64())], _MAIL_NAMES)

    nowhere, u = F.lit(None), F.col("u")
    need = lists.select("u", place.alias("p"), "ids").mapInArrow(ask, "u bigint, p int")
    farthest = graph.select(*_mail(1, nowhere, u, far=F.when(F.size("ids") < k, infinite).otherwise(F.element_at("dist", -1))))
    asked = points.select(*_mail(0, nowhere, u, x=F.col("x"))).union(farthest).union(need.select(*_mail(2, F.col("p"), u)))
    vectors = asked.repartition(parts, "a").mapInArrow(send, _MAIL)
    mail = lists.select(*_mail(1, place, u, ids=F.col("ids"), new=F.col("new"))).union(vectors).repartition(parts, "part")

    def meet(batches):
        for rows in _by_part(batches):
            if 1 not in rows:
                continue
            ids, far, x = _vectors(rows[0])
            found, size = [], 0
            for batch in rows[1]:
                ends = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
                others = batch.column(3).flatten().to_numpy()
                new = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(bool)
                for i, u in enumerate(batch.column(2).to_pylist()):
                    a, b = ends[i], ends[i + 1]
                    members, first = np.unique(np.append(others[a:b], u), return_index=True)
                    fresh = np.append(new[a:b], False)[first]
                    at = np.searchsorted(ids, members)
                    d, slack = _products(x[at])
                    if slack > 1e-6 * d.min():  # far from the mean of those that meet, or equal but for little: differences
                        one, two = (z.ravel() for z in np.indices(d.shape))
                        d = np.where(np.eye(len(members), dtype=bool), np.inf, _differences(x, at[one], x, at[two]).reshape(d.shape))
                    d[(d >= far[at][:, None]) | ~(fresh[:, None] | fresh[None])] = np.inf
                    if len(members) > OFFERS:
                        d[d > np.partition(d, OFFERS - 1, 1)[:, OFFERS - 1 : OFFERS]] = np.inf
                    one, two = np.nonzero(np.isfinite(d))
                    if len(one):
                        found.append((members[one], members[two], d[one, two], np.ones(len(one), bool)))
                        size += len(one)
                    if size > 1_000_000:
                        yield _packed(*_best(*(np.concatenate(c) for c in zip(*found)), k))
                        found, size = [], 0
            if size:
                yield _packed(*_best(*(np.concatenate(c) for c in zip(*found)), k))

    old = graph.select("u", "ids", "dist", F.transform("new", lambda _: F.lit(False)).alias("new"))
    out = materialize(_merged(mail.mapInArrow(meet, _GRAPH).union(old), k, width), "nn-graph")
    discard(lists)
    return out


def build_graph(points: DataFrame, count: int, size: int, k: int = NEIGHBOURS, change: float = CHANGE) -> DataFrame:
    """u, ids, dist (squared), new: points (u, x array<double>) with their nearest found."""
    width, parts = _widths(points, count)
    mean = _mean(points, size)
    first = _start(points, count, mean, k, range(1, 3 + max(1, (count // BLOCK).bit_length())))
    graph = materialize(_merged(first, k, width), "nn-graph")
    for _ in range(_MOST):
        graph, before = _descend(points, graph, k, parts, width), graph
        discard(before)
        changed = graph.agg(F.sum(F.size(F.filter("new", lambda n: n))), F.sum(F.size("new"))).first()
        if (changed[0] or 0) <= change * (changed[1] or 0):
            return graph
    raise RuntimeError("NN-descent did not settle")


def _widths(points: DataFrame, count: int) -> tuple[int, int]:
    """(partitions of exchanges keyed by id, parts of vectors)."""
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, count // 50_000), max(width, count // PART)


# ------------------------------------------------------------------ search

_STATE = "q bigint, ids array<bigint>, dist array<double>, done array<boolean>"
_MARKED = _STATE + ", go array<bigint>, seen bigint"


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, count: int, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """q, ids, dist, seen: the beam of each query (q, a point of the graph), nearest first, itself left out; seen counts distances."""
    width, parts = _widths(points, count)
    around = materialize(_both_ways(graph, 2 * NEIGHBOURS, width, True).select("u", F.array_distinct("ids").alias("near")), "nn-around")
    target = materialize(queries.join(points, F.col("q") == F.col("u")).select("q", F.col("x").alias("y")), "nn-queries")
    # a few points taken by their hash are where every search begins, besides the query's own neighbours
    gates = [r["u"] for r in points.select("u").orderBy(F.xxhash64("u", F.lit(3)), "u").limit(ENTRIES).collect()]
    entry = target.select("q", (F.array(*map(F.lit, gates)) if gates else F.array()).cast("array<bigint>").alias("near"))
    wanted = entry.union(target.select("q").join(around, F.col("q") == F.col("u")).select("q", "near"))
    held = points.select(*_mail(0, _part(F.col("u"), parts), F.col("u"), x=F.col("x")))
    infinite = F.lit(float("inf"))
    state = None

    def address(batches):
        """Rows sorted by query, its vector and limit first: what it wants, by the part that holds it, with vector and limit."""
        import pyarrow as pa

        def letters(held):
            out: list[tuple] = []
            for q, y, far, wants in held:
                v = np.unique(np.concatenate([np.zeros(0, np.int64), *wants]))
                v = v[v != q]
                p = _part_of(v, parts)
                order = np.argsort(p, kind="stable")
                ends = _starts(p[order])
                n = len(ends) - 1
                out.append((p[order][ends[:-1]], np.full(n, q), np.diff(ends), v[order], np.full(n, far), np.tile(y, (n, 1))))
            p, q, sizes, v, far, y = (np.concatenate(c) for c in zip(*out))
            n = len(p)
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.ones(n, np.int32)), pa.array(q), _lists(v, np.append(0, np.cumsum(sizes)), pa.int64()), pa.nulls(n, pa.list_(pa.bool_())), pa.array(far), _lists(y.ravel(), np.arange(n + 1) * y.shape[1], pa.float64())], _MAIL_NAMES)

        held, size = [], 0
        for batch in batches:
            ids, x, fars = batch.column(3), batch.column(6), batch.column(5).to_pylist()
            for i, (kind, q) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not held or held[-1][0] != q:
                    if size > 4_000_000:
                        yield letters(held)
                        held, size = [], 0
                    held.append([q, None, math.inf, []])
                if kind == 0:
                    held[-1][1] = x[i].values.to_numpy()
                elif kind == 1:
                    held[-1][2] = fars[i]
                else:
                    held[-1][3].append(ids[i].values.to_numpy())
                    size += min(parts, len(held[-1][3][-1])) * len(held[-1][1])  # places that copies of the vector take, at most
        if held:
            yield letters(held)

    def measure(batches):
        import pyarrow as pa

        for rows in _by_part(batches):
            if 1 not in rows:
                continue
            ids, _, x = _vectors(rows[0])
            asked, far, y = _vectors(rows[1])
            q = np.concatenate([np.repeat(b.column(2).to_numpy(), b.column(3).value_lengths().to_numpy()) for b in rows[1]])
            v = np.concatenate([b.column(3).flatten().to_numpy() for b in rows[1]])
            a, b = np.searchsorted(asked, q), np.searchsorted(ids, v)
            d = _differences(y, a, x, b)
            order = np.lexsort((v, d, q))
            q, v, d, a = q[order], v[order], d[order], a[order]
            ends = _starts(q)
            # every query keeps a row, for the count of its distances
            keep = (d < far[a]) & (np.arange(len(q)) - np.repeat(ends[:-1], np.diff(ends)) < beam)
            sums = np.concatenate([[0], np.cumsum(keep)])[ends]
            yield pa.RecordBatch.from_arrays([pa.array(q[ends[:-1]]), _lists(v[keep], sums, pa.int64()), _lists(d[keep], sums, pa.float64()), _lists(np.zeros(int(keep.sum()), bool), sums, pa.bool_()), pa.array(np.diff(ends))], ["q", "ids", "dist", "done", "seen"])

    def merge(batches):
        """Beams of the task's queries, with the members to expand next marked as done."""
        import pyarrow as pa

        lists: dict[int, list] = {}
        for batch in batches:
            ends = [batch.column(i).offsets.to_numpy() for i in (1, 2, 3)]
            flat = [batch.column(i).values.to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            for i, (q, seen) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist())):
                lists.setdefault(q, []).append(([f[e[i] : e[i + 1]] for f, e in zip(flat, ends)], seen))
        rows = []
        for q, some in lists.items():
            ids, d, done = (np.concatenate([x[0][i] for x in some]) for i in range(3))
            order = np.lexsort((~done.astype(bool), ids))  # of equal ids the one that was expanded
            ids, d, done = ids[order], d[order], done[order].astype(bool)
            keep = np.ones(len(ids), bool)
            keep[1:] = ids[1:] != ids[:-1]
            keep &= ids != q
            ids, d, done = ids[keep], d[keep], done[keep]
            order = np.lexsort((ids, d))[:beam]
            ids, d, done = ids[order], d[order], done[order]
            front = np.flatnonzero(~done)[:expand]
            done[front] = True
            rows.append((q, ids, d, done, ids[front], sum(x[1] for x in some)))
        if rows:
            kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.int64())
            columns = [_lists(np.concatenate([r[i] for r in rows]), np.concatenate([[0], np.cumsum([len(r[i]) for r in rows])]), t) for i, t in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *columns, pa.array([r[5] for r in rows], pa.int64())], ["q", "ids", "dist", "done", "go", "seen"])

    for _ in range(_MOST):
        nowhere, q = F.lit(None), F.col("q")
        rows = target.select(*_mail(0, nowhere, q, x=F.col("y"))).union(wanted.select(*_mail(2, nowhere, q, ids=F.col("near"))))
        if state is not None:
            rows = rows.union(state.select(*_mail(1, nowhere, q, far=F.when(F.size("ids") < beam, infinite).otherwise(F.element_at("dist", -1)))))
        letters = rows.repartition(width, "a").sortWithinPartitions("a", "kind").mapInArrow(address, _MAIL)
        measured = held.union(letters).repartition(parts, "part").mapInArrow(measure, _STATE + ", seen bigint")
        together = measured if state is None else measured.union(state.select("q", "ids", "dist", "done", "seen"))
        state, before = materialize(together.repartition(width, "q").mapInArrow(merge, _MARKED), "nn-state"), state
        discard(before)
        front = state.select("q", F.explode("go").alias("v"))
        if not front.limit(1).count():
            return state.select("q", "ids", "dist", "seen")
        wanted = front.join(around, F.col("v") == F.col("u")).select("q", "near")
    raise RuntimeError("the search did not settle")


@scratch("nn-result")
def nearest(vectors: DataFrame, wanted, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score, measured. vectors: vec_id, vec; wanted: a condition on vec_id that picks the queries."""
    good = _usable(vectors)
    extent = good.agg(F.max(F.size("vec")).alias("size"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    size, most = extent["size"] or 0, extent["most"] or 1.0
    # squares of extreme components would leave the range of a double; a power of two changes no digit
    scale = math.ldexp(1.0, -math.frexp(most)[1]) if not 1e-100 < most < 1e100 else 1.0
    known = materialize(classes(good, size, top + 1), "nn-classes")
    count = known.count()
    points = materialize(known.select(F.col("rep").alias("u"), F.transform("vec", lambda x: x * F.lit(scale)).alias("x")), "nn-points")
    asked = good.where(wanted).select(F.col("vec_id").alias("query_id"), _filled(size).alias("vec")).distinct()
    owned = materialize(spread_join(asked, known.select("vec", "rep", F.col("ids").alias("own")), ["vec"], ["query_id"]).select("query_id", "rep", "own"), "nn-owned")
    graph = build_graph(points, count, size)
    beams = search(points, graph, owned.select(F.col("rep").alias("q")).distinct(), count, max(BEAM, 2 * top))
    close = beams.select("q", "seen", F.explode(F.slice(F.arrays_zip("ids", "dist"), 1, top)).alias("c"))
    members = known.select(F.col("rep").alias("__r"), F.col("ids").alias("members"))
    close = spread_join(close.select("q", "seen", F.col("c.ids").alias("__r"), (F.sqrt("c.dist") / F.lit(scale)).alias("score")), members, ["__r"], ["q"])
    # a class of queries may be large, so its few results go to its queries, not the other way
    best = close.groupBy(F.col("q").alias("rep")).agg(F.collect_list(F.struct("score", "members")).alias("near"), F.max("seen").alias("measured"))
    told = spread_join(owned, best, ["rep"], ["query_id"], "left")
    found = F.flatten(F.transform("near", lambda n: F.transform(n["members"], lambda m: F.struct(n["score"].alias("score"), m.alias("vec_id")))))
    same = F.transform(F.filter("own", lambda i: i != F.col("query_id")), lambda i: F.struct(F.lit(0.0).alias("score"), i.alias("vec_id")))
    kind = "array<struct<score:double,vec_id:bigint>>"
    ranked = F.slice(F.array_sort(F.concat(same.cast(kind), F.coalesce(found.cast(kind), F.array().cast(kind)))), 1, top)
    out = told.select("query_id", F.coalesce("measured", F.lit(0)).alias("measured"), F.posexplode(ranked).alias("rank", "r"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "r.vec_id", "r.score", "measured")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return nearest(vectors, F.col("vec_id") % 100 == 0)
