"""Helpers that several training-data operators share: tables, shared work folders, word hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------------ tables and work folders

_scopes: list[list[DataFrame]] = []
_left: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it only a local session gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(context, "_wordmill_dir", None)
        if path is None:
            path = context._wordmill_dir = "file://" + tempfile.mkdtemp(prefix="wordmill-")
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def _keep(df: DataFrame) -> DataFrame:
    """The table belongs to the scope that is open, else it lives as long as the driver program."""
    if _scopes:
        _scopes[-1].append(df)
    else:
        if not _left:
            atexit.register(_at_exit)
        _left.append(df)
    return df


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        discard(*_left)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it again. The path is kept in `.work_path`."""
    return _keep(_written(df, name))


def keep_path(spark: SparkSession, path: str) -> None:
    """A folder of files that goes as the open scope's tables do."""
    out = spark.range(0)
    out.work_path = path
    _keep(out)


def discard(*frames: DataFrame | None) -> None:
    """Deletes what materialize() wrote, once no later plan reads it."""
    for df in frames:
        path, spark = getattr(df, "work_path", None), df.sparkSession if df is not None else None
        if path and spark.sparkContext._jsc is not None:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            df.work_path = None


def scratch(name: str):
    """Decorator: the function's result is written as a table, and every other table it made is deleted, also if it fails."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **options):
            _scopes.append([])
            try:
                out = _written(f(*args, **options), name)
            finally:
                discard(*_scopes.pop())
            return _keep(out)

        return run

    return wrap


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened where they are taken (Spark's names differ in more than case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[str]:
    return ["`" + n.replace("`", "``") + "`" for n in names]


def place_of(df: DataFrame, name: str) -> int:
    """The number of a column, found as Spark does, without regard to case."""
    return [c.lower() for c in df.columns].index(name.lower())


def numbered_columns(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1 and so on: mapInArrow can't take names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """many with few's columns on keys, of which few has one row each and many may have any share of its rows.

    A key's rows are dealt by a salt from the columns `by`; few's row goes to the salts that occur, so no task holds a
    key's rows. The salts' number follows the session's partitions.
    """
    salts = max(64, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = many.withColumn("__salt", F.pmod(F.xxhash64(*by, F.lit(29)), F.lit(salts)).cast("int"))
    sent = salted.select(*keys, "__salt").distinct().join(few, keys)
    return salted.join(sent, [*keys, "__salt"], how).drop("__salt")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def shuffle_width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for a keyed exchange: the session's setting, or more where a task would get over per_task rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def released(run):
    """run (batches to batches); at the end of a task its worker gives freed memory back to the system.

    Idle workers stay beside the executor's heap while later stages run, and count as the executor's.
    """

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # there is no such call outside glibc
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


# ------------------------------------------------------------------ words and shingles in numpy

SEGMENT = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_text(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; nulls are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of documents of about SEGMENT bytes; a longer document comes alone and in pieces cut at white space.

    Yields (start, end, bounds): byte range and the places inside where a document begins.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        j = min(j, n)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= SEGMENT:
            yield lo, hi, offsets[i:j]
        else:
            a = lo
            while a < hi:
                b = min(a + SEGMENT, hi)
                while b < hi:
                    white = np.flatnonzero(_WHITE[data[b : b + 4096]])
                    if len(white):
                        b += int(white[0])
                        break
                    b = min(b + 4096, hi)
                yield a, b, np.array([a], np.int64)
                a = b
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all documents: 64-bit hashes, starts, ends (bytes), and each document's first word.

    The hash is a polynomial over a random byte table, made independent of the place by the base's inverse.
    """
    hashes, starts, ends = [], [], []
    for lo, hi, bounds in _segments(data, offsets):
        part = data[lo:hi]
        solid = ~_WHITE[part]
        if not solid.any():
            continue
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = bounds[(bounds > lo) & (bounds < hi)] - lo
        first[inner] |= solid[inner]
        last[inner - 1] |= solid[inner - 1]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        values = _BYTE[_LOWER[part] if lower else part]
        values *= _power("p", _P, len(part))
        np.cumsum(values, out=total[1:])
        h = (total[e] - total[s]) * _power("q", _PINV, len(part) + 1)[s]
        h += (e - s).astype(np.uint64) * _COEF[63]
        hashes.append(mix(h))
        starts.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per document: the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    h, _, _, first = word_hashes(data, offsets)
    n = len(h)
    rolled = np.zeros(0, np.uint64)
    if n >= k:
        rolled = h[: n - k + 1] * _COEF[0]
        for i in range(1, k):
            rolled = rolled + h[i : n - k + 1 + i] * _COEF[i]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = (h[a:b] * _COEF[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ------------------------------------------------------------------ connected components


def _forest(batches, rank=lambda x: x) -> Iterator:
    """A partition's edges (a, b) as stars (node, root) around the node of least rank in each of its components, itself left out."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (t := up.get(top, top)) != top:
            top = t
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                if rank(a) > rank(b):
                    a, b = b, a
                up[b] = a
    stars = [(x, find(x)) for x in list(up)]
    stars = [s for s in stars if s[0] != s[1]]
    if stars:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars)], ["a", "b"])


def _trees(level: int):
    """The forest under an order that is drawn anew for each level, with a row (root, root) for each tree."""

    def rank(x: int) -> int:
        return (x * 0x9E3779B97F4A7C15 + level * 0xD1342543DE82EF95) * 0xBF58476D1CE4E5B9 >> 17 & 0xFFFFFFFFFFFF

    def run(batches) -> Iterator:
        import pyarrow as pa

        for stars in _forest(batches, rank):
            roots = pa.array(np.unique(stars.column(1).to_numpy()))
            yield from (stars, pa.RecordBatch.from_arrays([roots, roots], ["a", "b"]))

    return run


def components(edges: DataFrame, name: str = "cc", max_levels: int = 100) -> DataFrame:
    """(node, comp) for all nodes of undirected edges (a, b: bigint); comp is the smallest node that is reachable.

    A level reduces each partition's edges to trees; a node's trees (at most one a partition) meet, and where there are
    several, their roots are the next level's graph. Roots are chosen by a random order, so every level leaves at most
    about two thirds of the nodes however the edges lie, and mostly very few. Then the levels' roots are put through from
    the last to the first, by salted joins. The nodes of a hub or of a component never meet in one task.
    """
    levels: list[DataFrame] = []
    now = edges.select("a", "b").where("a <> b")
    for level in range(max_levels):
        met = now.mapInArrow(_trees(level), "a bigint, b bigint").groupBy("a").agg(F.collect_set("b").alias("roots"))
        chosen = F.array_min(F.transform("roots", lambda r: F.struct(F.xxhash64(r, F.lit(level)).alias("h"), r.alias("r"))))["r"]
        met = materialize(met.select("a", chosen.alias("m"), "roots"), name)
        levels.append(met.select("a", "m"))
        several = met.where(F.size("roots") > 1)
        if not several.limit(1).count():
            break
        now = several.select(F.explode("roots").alias("a"), F.col("m").alias("b")).where("a <> b")
    else:
        raise RuntimeError("components did not settle")
    found = levels.pop()
    while levels:
        found = spread_join(levels.pop(), found.select(F.col("a").alias("m"), F.col("m").alias("up")), ["m"], ["a"], "left")
        found = materialize(found.select("a", F.coalesce("up", "m").alias("m")), name)
    least = found.groupBy("m").agg(F.min("a").alias("comp"))
    return spread_join(found, least, ["m"], ["a"]).select(F.col("a").alias("node"), "comp")
