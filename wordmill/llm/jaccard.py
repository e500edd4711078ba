"""N-gram Jaccard join with signature trees.

A document's set holds 64-bit hashes of its distinct 5-word shingles. All links with 100 * |x & y| >= 75 * |x | y| count;
the result is each document's connected component. The way there is exact (up to equal 64-bit hashes):

1. One pass counts every shingle's documents in hashed counters, dealt by ranges of the hash. Shingles of two or more
   documents are marked in one filter, those of more than HOT_DF in another; the counters, the ranges and both filters grow
   with the bytes of text (`Sizes`), the filters from 32 and 8 MB to 128 and 16 MB, so both can go to every executor. (A filter that fills up costs
   postings, not links.) The same pass returns each document's size and 128-bit digest; equal sets are one class.
2. A second pass takes the prefix of each set under the order (marks, hash): n - ceil(3n/4) + 1 shingles, of which two
   linked sets always share one. Unmarked shingles stand in one document only and needn't be sent: a text of its own that
   shares a passage with others sends nothing. The documents of a shingle are tied to the smallest of them, first inside
   each map task, which sends one posting for each shingle and its ties as a forest; components of these ties are
   *clusters*: every link lies inside one.
3. A cluster is cut into tiles of bounded size by a hash. Each tile is joined with itself by a signature tree: leaves are
   documents with token bitmaps, inner nodes hold the OR of their bitmaps, the range of sizes and the most collisions of a
   bitmap; the dual traversal keeps a pair of nodes only if the common bits allow the overlap that the smallest sizes
   need. Surviving pairs are compared exactly, and a pair that is already connected is skipped: a group of copies costs
   about one comparison a document.
4. Clusters of several tiles: representatives of the tiles' components are joined in further rounds. Then pairs of
   different components that share a prefix shingle of at most HOT_DF documents are compared. Documents that share a hotter
   one take new prefixes under the exact order of frequency among themselves, and pairs are compared again. What still
   shares a hot shingle across components is cut into tiles by size class, and every document outside its cluster's largest
   component meets the tiles of the three classes that its size allows (by tree). No pair of documents in different
   components is left out.

Joins that bring a class, a cluster or a hub's values back to its documents are salted (`spread_join`).

Defined results: null text, empty text and text of white space have an empty set, size 0 and their own id as component;
equal sets are linked; repeated rows of one id count as one document (of different texts under one id the smallest stands
for it in comparisons) and give a row each; a null id gets a null component and takes no part; other columns are ignored
(and kept by deduplicate); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _forest, arrow_text, components, fresh, materialize, mix, quoted, released, scratch, shingle_sets, spread_join, table

SHINGLE = 5
HOT_DF = 48
TILE_DOCS, TILE_SHINGLES = 512, 1 << 20
FANOUT = 8
_FLUSH, _POSTINGS, _LIST = 3 << 20, 1 << 20, 1 << 16


@dataclass(frozen=True)
class Sizes:
    """Bits of the counters' keys, of the ranges, and of the filters of repeated and of hot shingles."""

    token: int
    bucket: int
    repeated: int
    hot: int

    @staticmethod
    def of(text_bytes: int) -> Sizes:
        """For so many bytes of text, at about six a shingle: a counter seldom holds two shingles, a range a few hundred thousand."""
        lg = max(1, text_bytes // 6).bit_length()
        return Sizes(*(int(np.clip(lg + x, lo, hi)) for x, lo, hi in ((6, 32, 48), (-18, 8, 16), (1, 28, 30), (-1, 26, 27))))


def least_overlap(n: int | np.ndarray, m: int | np.ndarray):
    """The overlap that sets of n and m need: 175 * overlap >= 75 * (n + m)."""
    return -(-3 * (n + m) // 7)


# ------------------------------------------------------------------ the signature tree


def bitmap_bits(sets: list[np.ndarray]) -> int:
    """Bits of a token bitmap: a power of two, two to four times the largest set, within bounds."""
    return int(np.clip(1 << (2 * max(map(len, sets), default=1)).bit_length(), 256, 1 << 15))


class SignatureTree:
    """Levels from the documents (level 0) to one root; a node covers FANOUT neighbours of the level below.

    Documents stand in order of size class and smallest hash, so that likely partners share nodes.
    """

    def __init__(self, sets: list[np.ndarray], bits: int | None = None):
        sizes = np.array([len(s) for s in sets], np.int64)
        classes = np.log(np.maximum(sizes, 1)) / np.log(4 / 3)
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((least, classes.astype(int)))
        bits = bits or bitmap_bits(sets)
        n = len(sets)
        flat = np.zeros((n, bits), bool)
        for row, i in enumerate(self.order):
            flat[row, (sets[i] & np.uint64(bits - 1)).astype(np.int64)] = True
        maps = np.packbits(flat, axis=1).view(np.uint64)
        size = sizes[self.order]
        slack = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, slack)]
        while len(maps) > 1:
            at = np.arange(0, len(maps), FANOUT)
            _, low, high, slack = self.levels[-1]
            maps = np.bitwise_or.reduceat(maps, at, axis=0)
            self.levels.append((maps, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    @staticmethod
    def possible(one: tuple, a: np.ndarray, two: tuple, b: np.ndarray) -> np.ndarray:
        """Whether the nodes' largest possible overlap reaches what their sizes need."""
        low_a, high_a, low_b, high_b = one[1][a], one[2][a], two[1][b], two[2][b]
        good = (4 * high_a >= 3 * low_b) & (4 * high_b >= 3 * low_a)
        at = np.flatnonzero(good)
        for c in range(0, len(at), 4096):
            k = at[c : c + 4096]
            common = np.bitwise_count(one[0][a[k]] & two[0][b[k]]).sum(1).astype(np.int64)
            need = np.maximum(least_overlap(low_a[k], low_b[k]), -(-3 * np.maximum(low_a[k], low_b[k]) // 4))
            good[k] = common + np.minimum(one[3][a[k]], two[3][b[k]]) >= need
        return good

    def pairs(self, other: SignatureTree | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of documents (numbers in `sets`) that the dual traversal can't rule out; with itself: each pair once."""
        two = other or self
        if not len(self.order) or not len(two.order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        up, down = len(self.levels) - 1, len(two.levels) - 1
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            good = self.possible(self.levels[up], a, two.levels[down], b)
            a, b = a[good], b[good]
            if not up and not down:
                break
            if up >= down and up:
                up -= 1
                a, b = _children(a, b, len(self.levels[up][0]))
                if other is None:
                    down -= 1
                    b, a = _children(b, a, len(two.levels[down][0]))
            else:
                down -= 1
                b, a = _children(b, a, len(two.levels[down][0]))
            if other is None:
                keep = a <= b
                a, b = a[keep], b[keep]
        if other is None:
            keep = a < b
            a, b = a[keep], b[keep]
        return self.order[a], two.order[b]


def _children(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    c = (a[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    keep = c < count
    return c[keep], np.repeat(b, FANOUT)[keep]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact comparison of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    need = least_overlap(len(x), len(y))
    if len(x) < need:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= need


class _Union:
    def __init__(self, labels: np.ndarray):
        """labels: equal where documents are connected already."""
        self.label = np.unique(labels, return_inverse=True)[1]
        self.members: dict[int, list[int]] = {}
        for i, x in enumerate(self.label.tolist()):
            self.members.setdefault(x, []).append(i)

    def merge(self, a: int, b: int) -> None:
        x, y = int(self.label[a]), int(self.label[b])
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        moved = self.members.pop(y)
        self.label[moved] = x
        self.members[x] += moved


def join_tile(sets: list[np.ndarray], labels: np.ndarray, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the documents of a tile (a forest over what `labels` connects already).

    probes: if given, only pairs of one of these and one of the rest count.
    """
    if probes is None:
        a, b = SignatureTree(sets).pairs()
    else:
        one, two = np.array(probes, np.int64), np.setdiff1d(np.arange(len(sets)), probes)
        bits = bitmap_bits(sets)
        i, j = SignatureTree([sets[p] for p in one], bits).pairs(SignatureTree([sets[p] for p in two], bits))
        a, b = one[i], two[j]
    union, links = _Union(labels), []
    near = np.argsort(np.abs(np.array([len(sets[i]) for i in a], np.int64) - np.array([len(sets[i]) for i in b], np.int64)), kind="stable")
    a, b = a[near], b[near]
    while len(a):
        for x, y in zip(a[:256].tolist(), b[:256].tolist()):
            if union.label[x] != union.label[y] and linked(sets[x], sets[y]):
                union.merge(x, y)
                links.append((x, y))
        a, b = a[256:], b[256:]
        keep = union.label[a] != union.label[b]
        a, b = a[keep], b[keep]
    return links


# ------------------------------------------------------------------ the passes over documents


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _count_side(sizes: Sizes):
    """Map side: for each range of the hash, the distinct shingles' hashes (cut to the counters' bits) with counts; and packed document rows."""

    def run(batches) -> Iterator:
        import pickle

        import pyarrow as pa

        names = ["bucket", "a", "b"]
        inner = sizes.token - sizes.bucket

        def flush(held):
            if held:
                token, count = np.unique(np.concatenate(held), return_counts=True)
                bucket = (token >> np.uint64(inner)).astype(np.int32)
                low = (token & np.uint64((1 << inner) - 1)).astype(np.uint32)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rows = [(bucket[x], _pack(np.diff(low[x:y], prepend=np.uint32(0))), _pack(np.minimum(count[x:y], 255).astype(np.uint8))) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(token)])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names)

        held, size, salt = [], 0, 0
        for batch in batches:
            data, offsets = arrow_text(batch.column(1))
            ids = batch.column(0).to_pylist()
            docs = []
            step = 512
            for at in range(0, len(ids), step):
                sets = shingle_sets(data, offsets[at : at + step + 1], SHINGLE)
                for key, s in zip(ids[at : at + step], sets):
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    docs.append((key, len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
                    if len(s):
                        held.append(s >> np.uint64(64 - sizes.token))
                        size += len(s)
                if size >= _FLUSH:
                    yield from flush(held)
                    held, size = [], 0
            if docs:
                salt += 1
                yield pa.RecordBatch.from_arrays([pa.array([-1 - (hash((docs[0][0], salt)) & 0xFFFFF)], pa.int32()), pa.array([pickle.dumps(list(zip(*docs)))], pa.binary()), pa.array([b""], pa.binary())], names)
        yield from flush(held)

    return run


def _count_merge(sizes: Sizes):
    """Reduce side: marks of repeated and of hot shingles for each range (packed bitmaps), and the document rows."""

    def run(batches) -> Iterator:
        import pickle

        import pyarrow as pa

        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["bucket", "marks", "hot", "doc_id", "n", "d1", "d2"]
        inner = sizes.token - sizes.bucket
        parts: dict[int, list] = {}
        for batch in batches:
            for bucket, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    ids, n, d1, d2 = pickle.loads(a)
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(ids), k) for k in kinds[:3]), *(pa.array(x, pa.int64()) for x in (ids, n, d1, d2))], names)
                else:
                    parts.setdefault(bucket, []).append((a, b))
        for bucket, pieces in parts.items():
            marks = [(bits, least, np.zeros(1 << bits - sizes.bucket, bool)) for bits, least in ((sizes.repeated, 2), (sizes.hot, HOT_DF + 1))]
            # a range is merged in slices of bounded size: packed pieces are some bytes a shingle, merged ones many
            slices = 1 << max(0, (sum(len(b) for _, b in pieces) >> 22).bit_length())
            for k in range(slices):
                tokens, counts = [], []
                for a, b in pieces:
                    token = np.cumsum(_unpack(a, np.uint32), dtype=np.uint32)
                    x, y = np.searchsorted(token, [(k << inner) // slices, ((k + 1) << inner) // slices])
                    tokens.append(token[x:y])
                    counts.append(_unpack(b, np.uint8)[x:y])
                token, count = np.concatenate(tokens), np.concatenate(counts).astype(np.int64)
                if not len(token):
                    continue
                order = np.argsort(token, kind="stable")
                token, count = token[order], count[order]
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                total = np.add.reduceat(count, first)
                for bits, least, bitmap in marks:
                    bitmap[(token[first][total >= least] >> np.uint32(sizes.token - bits)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([bucket], kinds[0]), *(pa.array([_pack(np.packbits(m))], pa.binary()) for _, _, m in marks), *(pa.nulls(1, pa.int64()) for _ in range(4))], names)

    return run


def _prefix(s: np.ndarray, repeated: np.ndarray, hot: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """The marked part of a set's prefix: first the shingles that the filter of hot ones doesn't know, then those it does."""
    n = len(s)
    marked = s[_marked(repeated, (s >> np.uint64(64 - sizes.repeated)).astype(np.int64))]
    length = n - -(-3 * n // 4) + 1 - (n - len(marked))
    if length <= 0 or not n:
        return s[:0], s[:0]
    late = _marked(hot, (marked >> np.uint64(64 - sizes.hot)).astype(np.int64))
    cold = marked[~late][:length]
    return cold, marked[late][: length - len(cold)]


def _prefixes(shared, sizes: Sizes):
    """Map side: the marked part of each set's prefix, as rows (token, doc, root).

    Of a shingle's documents in the task's hands only the smallest is sent, and the others are tied to it: rows with a root,
    for which token only deals them.
    """

    def run(batches):
        import pyarrow as pa

        def sent(token, doc, root=None):
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(doc), pa.nulls(len(doc), pa.int64()) if root is None else pa.array(root)], ["token", "doc", "root"])

        def flush():
            token, doc = np.concatenate(tokens).view(np.int64), np.concatenate(owners)
            order = np.lexsort((doc, token))
            token, doc = token[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            yield sent(token[first], doc[first])
            least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
            ties = np.unique(np.stack([least, doc], 1)[least != doc], axis=0)
            if len(ties):
                for stars in _forest([pa.RecordBatch.from_arrays([pa.array(ties[:, 0].copy()), pa.array(ties[:, 1].copy())], ["a", "b"])]):
                    node = stars.column(0).to_numpy()
                    yield sent(mix(node.view(np.uint64)).view(np.int64), node, stars.column(1).to_numpy())

        repeated, hot = (f.array() for f in shared.value)
        seen: set[bytes] = set()
        tokens, owners, held = [], [], 0
        for batch in batches:
            data, offsets = arrow_text(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), 512):
                for key, s in zip(ids[at : at + 512], shingle_sets(data, offsets[at : at + 513], SHINGLE)):
                    prefix = np.concatenate(_prefix(s, repeated, hot, sizes))
                    if not len(prefix):
                        continue
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if digest in seen:  # copies inside the task are left to the classes
                        continue
                    seen.add(digest)
                    tokens.append(prefix)
                    owners.append(np.full(len(prefix), key, np.int64))
                    held += len(prefix)
                if held >= _POSTINGS:
                    yield from flush()
                    tokens, owners, held = [], [], 0
        if held:
            yield from flush()

    return run


def _prefix_rows(shared, sizes: Sizes):
    """Rows (doc, text): a row (doc, cold, hot) with the two parts of its set's prefix."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        repeated, hot = (f.array() for f in shared.value)
        for batch in batches:
            data, offsets = arrow_text(batch.column(1))
            for at in range(0, len(offsets) - 1, 512):
                parts = [_prefix(s, repeated, hot, sizes) for s in shingle_sets(data, offsets[at : at + 513], SHINGLE)]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x).view(np.int64))) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), *lists], ["doc", "cold", "hot"])

    return run


def _stars(ties: np.ndarray) -> Iterator:
    """Edges (n x 2) as trees: rows (root, other documents), a long list in pieces."""
    import pyarrow as pa

    for stars in _forest([pa.RecordBatch.from_arrays([pa.array(ties[:, 0].copy()), pa.array(ties[:, 1].copy())], ["a", "b"])]):
        node, root = stars.column(0).to_numpy(), stars.column(1).to_numpy()
        order = np.argsort(root, kind="stable")
        node, root = node[order], root[order]
        place = np.arange(len(root))
        start = np.concatenate([[True], root[1:] != root[:-1]])
        begin = np.maximum.accumulate(np.where(start, place, 0))
        cuts = np.flatnonzero(start | ((place - begin) % _LIST == 0))
        yield pa.RecordBatch.from_arrays([pa.array(root[cuts]), pa.ListArray.from_arrays(pa.array(np.append(cuts, len(root)).astype(np.int32)), pa.array(node))], ["a", "b"])


def _ties(batches) -> Iterator:
    """Reduce side: the documents of a shingle are tied; a task's ties become trees."""
    columns = [np.concatenate(c) for c in zip(*([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)] + [np.asarray(batch.column(2).fill_null(-1)), np.asarray(batch.column(2).is_valid())] for batch in batches))]
    if not columns:
        return
    token, doc, root, tied = columns
    ties = [np.stack([root[tied], doc[tied]], 1).astype(np.int64)]
    token, doc = token[~tied], doc[~tied].astype(np.int64)
    if len(token):
        order = np.argsort(token)
        token, doc = token[order], doc[order]
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        hub = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(doc))))
        ties.append(np.stack([hub, doc], 1)[hub != doc])
    both = np.unique(np.concatenate(ties), axis=0)
    if len(both):
        yield from _stars(both)


def _unpacked(batches) -> Iterator:
    """Trees (root, other nodes) of several tasks as one forest of edges."""
    import pyarrow as pa

    def edges():
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), batch.column(1).flatten()], ["a", "b"])

    yield from _forest(edges())


def _tiles(batches) -> Iterator:
    """Joins each tile (rows sorted by cluster and tile): each document with the smallest one that its links reach there."""
    import pyarrow as pa

    names = ["a", "b", "tiles"]

    def join(rows):
        sets, keep = [], []
        for key, label, probe, tiles, text in rows:
            raw = (text or "").encode()
            s = shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SHINGLE)[0]
            if len(s):
                sets.append(s)
                keep.append((key, label, probe, tiles))
        if len(sets) < 2:
            return []
        probes = [i for i, k in enumerate(keep) if k[2]]
        labels = np.array([k[1] for k in keep], np.int64)
        up: dict[int, int] = {}

        def find(x):
            while (t := up.get(x, x)) != x:
                x = t
            return x

        for a, b in join_tile(sets, labels, probes if any(k[2] is not None for k in keep) else None):
            a, b = find(keep[a][0]), find(keep[b][0])
            up[max(a, b)] = min(a, b)
        return [(x, find(x), keep[0][3]) for x in list(up) if find(x) != x]

    now, rows = None, []
    for batch in batches:
        found = []
        for cluster, tile, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (cluster, tile) != now:
                found += join(rows)
                now, rows = (cluster, tile), []
            rows.append(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)
    if found := join(rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)


def _cold_pairs(batches) -> Iterator:
    """Rows (token, doc, label, n), a token's in one task and at most HOT_DF: pairs of different labels that could link by size."""
    import pyarrow as pa

    columns = [np.concatenate(c) for c in zip(*([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for batch in batches))]
    if not columns:
        return
    order = np.argsort(columns[0], kind="stable")
    token, doc, label, n = (c[order] for c in columns)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    several = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    pairs = []
    for k in np.unique(size[several]).tolist():  # all tokens of k documents at once, in pieces of bounded size
        starts, (i, j) = first[several & (size == k)], np.triu_indices(k, 1)
        step = max(1, (1 << 20) // len(i))
        for at in range(0, len(starts), step):
            x, y = ((starts[at : at + step, None] + m).ravel() for m in (i, j))
            good = (label[x] != label[y]) & (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x])
            x, y = doc[x[good]], doc[y[good]]
            pairs.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
    both = np.unique(np.concatenate(pairs), axis=0) if pairs else ()
    if len(both):
        yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in both.T], ["a", "b"])


def _every_shingle(shared, sizes: Sizes):
    """Rows (doc, label, n, text): every shingle that can stand in two documents as (token, doc, label, n)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        repeated = shared.value[0].array()
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            data, offsets = arrow_text(batch.column(3))
            for at in range(0, len(columns[0]), 512):
                sets = [s[_marked(repeated, (s >> np.uint64(64 - sizes.repeated)).astype(np.int64))] for s in shingle_sets(data, offsets[at : at + 513], SHINGLE)]
                counts = [len(s) for s in sets]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *(pa.array(np.repeat(c[at : at + 512], counts)) for c in columns)], ["token", "doc", "label", "n"])

    return run


# ------------------------------------------------------------------ filters


class Filter:
    """A filter of 2**bits bits in segments (bucket, marks) that stay compressed, as most are nearly empty, until a task needs them."""

    def __init__(self, parts: list[tuple[int, bytes]], bits: int, bucket: int):
        self.parts, self.bits, self.bucket, self.marks = parts, bits, bucket, None

    def array(self) -> np.ndarray:
        if self.marks is None:
            out = np.zeros((1 << self.bucket, 1 << self.bits - self.bucket - 3), np.uint8)
            for at, raw in self.parts:
                out[at] |= _unpack(raw, np.uint8)
            self.marks = out.ravel()
        return self.marks


def id_filter(ids: DataFrame, bits: int, bucket: int = 8) -> Filter:
    """A filter of 2**bits bits with each id's place marked."""
    width = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = 1 << bits - bucket

    def segments(batches):
        import pyarrow as pa

        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _slots(batch.column(0).to_numpy(zero_copy_only=False), bits)
            for b in np.unique(at >> bits - bucket).tolist():
                part = at[at >> bits - bucket == b] & slots - 1
                marks.setdefault(b, np.zeros(slots, bool))[part] = True
        if marks:
            yield pa.RecordBatch.from_arrays([pa.array(list(marks), pa.int32()), pa.array([_pack(np.packbits(m)) for m in marks.values()], pa.binary())], ["bucket", "marks"])

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            at = _slots(batch.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((at >> bits - bucket).astype(np.int32))], ["id", "bucket"])

    dealt = ids.toDF("id").mapInArrow(keyed, "id bigint, bucket int").repartition(width, "bucket").select("id")
    return _gathered(dealt.mapInArrow(segments, "bucket int, marks binary"), bits, bucket)


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _marked(marks: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (marks[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _gathered(rows: DataFrame, bits: int, bucket: int) -> Filter:
    """The segments (bucket, marks) of a filter; the driver holds them compressed."""
    found = rows.toArrow()
    return Filter(list(zip(found.column("bucket").to_pylist(), found.column("marks").to_pylist())), bits, bucket)


def _passing(shared, bits: int):
    """Documents whose id is marked."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(_marked(shared.value.array(), _slots(ids, bits))))

    return run


def _known(tokens: DataFrame) -> tuple:
    """A filter of tokens for every executor, and its bits."""
    bits = int(np.clip(tokens.count().bit_length() + 6, 16, 27))
    return tokens.sparkSession.sparkContext.broadcast(id_filter(tokens, bits)), bits


# ------------------------------------------------------------------ hot shingles, by rows (doc, label, n, hot)


def _lists(batch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows, and how many each row has."""
    hot = batch.column(batch.num_columns - 1)
    return hot.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(hot.offsets.to_numpy())


def _hot_counts(batches) -> Iterator:
    """Rows (label, hot): each shingle's documents, and the smallest and largest label, once for each task (or piece of it)."""
    import pyarrow as pa

    def flush():
        if held:
            token, label = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(token, kind="stable")
            token, label = token[order], label[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
            if len(first):
                counts = np.diff(np.append(first, len(token))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token[first], counts, np.minimum.reduceat(label, first), np.maximum.reduceat(label, first))], ["token", "df", "x", "y"])

    held, size = [], 0
    for batch in batches:
        token, counts = _lists(batch)
        held.append((token, np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), counts)))
        size += len(token)
        if size >= _POSTINGS:
            yield from flush()
            held, size = [], 0
    yield from flush()


def _mixed(rows: DataFrame) -> DataFrame:
    """token, df of the hot shingles that stand in several components."""
    some = rows.select("label", "hot").mapInArrow(_hot_counts, "token bigint, df bigint, x bigint, y bigint")
    return some.groupBy("token").agg(F.sum("df").alias("df"), F.min("x").alias("x"), F.max("y").alias("y")).where("x < y").select("token", "df")


def _of_hot(known, bits: int):
    """Postings (token, doc, label, n) of the hot shingles that the filter knows."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            token, counts = _lists(batch)
            good = _marked(known.value.array(), _slots(token, bits))
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[good]), *(pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64), counts)[good]) for i in range(3))], ["token", "doc", "label", "n"])

    return run


def _with_hot(known, bits: int):
    """The documents that have a hot shingle which the filter knows."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            token, counts = _lists(batch)
            good = np.repeat(np.arange(len(counts)), counts)[_marked(known.value.array(), _slots(token, bits))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.unique(good)))], ["doc"])

    return run


# ------------------------------------------------------------------ the join


def _with_text(texts: DataFrame, members: DataFrame) -> DataFrame:
    return texts.withColumnRenamed("doc", "__doc").join(members, F.col("__doc") == F.col("doc")).select("cluster", "tile", "doc", "label", "probe", "tiles", "text")


def _joined(rows: DataFrame, name: str) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, "cluster", "tile").sortWithinPartitions("cluster", "tile")
    return materialize(dealt.mapInArrow(released(_tiles), "a bigint, b bigint, tiles bigint"), name)


def _tiled(members: DataFrame, keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """doc, cluster, n -> with tiles (their number) and tile: bounded by documents and by shingles."""
    sizes = members.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    return spread_join(members, sizes, list(keys), ["doc"]).withColumn("tile", F.pmod(F.xxhash64("doc", "tiles"), F.col("tiles")).cast("int"))


def _classes(sizes: DataFrame) -> DataFrame:
    """doc_id, n, rep (the smallest id with an equal set; null for a null id). A set that many documents have is found and told by parts."""
    parts = ["n", "d1", "d2"]
    salts = max(64, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = sizes.where("doc_id is not null").withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    some = salted.where("n > 0").groupBy(*parts, "__part").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    some = materialize(some, "jaccard-parts")
    heads = some.groupBy(*parts).agg(F.min("least").alias("rep"), F.max("most").alias("most")).where("rep < most").drop("most")
    told = some.select(*parts, "__part").join(heads, parts)
    found = salted.join(told, [*parts, "__part"], "left")
    return found.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")).union(sizes.where("doc_id is null").select("doc_id", "n", "doc_id"))


@scratch("jaccard-found")
def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (columns doc_id and text are used)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    bits = Sizes.of(docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0)

    counted = docs.mapInArrow(released(_count_side(bits)), "bucket int, a binary, b binary").repartition(width, "bucket").mapInArrow(released(_count_merge(bits)), "bucket int, marks binary, hot binary, doc_id bigint, n bigint, d1 bigint, d2 bigint")
    counted = materialize(counted, "jaccard-counts")
    segments = counted.where("bucket is not null")
    shared = spark.sparkContext.broadcast((_gathered(segments.select("bucket", "marks"), bits.repeated, bits.bucket), _gathered(segments.select("bucket", F.col("hot").alias("marks")), bits.hot, bits.bucket)))
    classed = materialize(_classes(counted.where("bucket is null").select("doc_id", "n", "d1", "d2")), "jaccard-classes")

    postings = "token bigint, doc bigint, root bigint"
    prefixes = docs.where("doc_id is not null").mapInArrow(released(_prefixes(shared, bits)), postings)
    trees = materialize(prefixes.repartition(width, "token").mapInArrow(released(_ties), "a bigint, b array<bigint>"), "jaccard-ties")
    ties = trees.mapInArrow(_unpacked, "a bigint, b bigint")
    of = classed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("rep", "n")).alias("m")).select(F.col("doc_id").alias("d"), "m.rep", "m.n")
    edges = ties.distinct().join(of.select(F.col("d").alias("a"), F.col("rep").alias("ra")), "a")
    edges = spread_join(edges, of.select(F.col("d").alias("b"), F.col("rep").alias("rb")), ["b"], ["a"])
    clusters = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b"), "jaccard-cc")
    members = clusters.withColumnRenamed("comp", "cluster").join(of.where("d = rep"), F.col("node") == F.col("rep"))
    members = materialize(_tiled(members.select(F.col("node").alias("doc"), "cluster", "n")), "jaccard-members")

    # texts of the clusters' documents only: by a filter first, so that the rest isn't shuffled
    inner = int(np.clip(members.count().bit_length() + 4, 16, 30))
    inside = spark.sparkContext.broadcast(id_filter(members.select("doc"), inner))
    few = docs.where("doc_id is not null").mapInArrow(_passing(inside, inner), "doc_id bigint, text string").withColumnRenamed("doc_id", "doc")
    texts = few.join(members.select(F.col("doc").alias("__m")), F.col("doc") == F.col("__m"), "left_semi")
    texts = materialize(texts.groupBy("doc").agg(F.min("text").alias("text")), "jaccard-texts")
    plain = members.select("doc", "cluster", "tile", F.col("doc").alias("label"), F.lit(None).cast("boolean").alias("probe"), "tiles")
    links = _joined(_with_text(texts, plain), "jaccard-links")
    comps = links.where("tiles = 1").select(F.col("a").alias("node"), F.col("b").alias("comp"))
    large = members.where("tiles > 1")
    if large.limit(1).count():
        comps = comps.union(components(_across_tiles(texts, large, links.where("tiles > 1"), shared, bits), "jaccard-final"))
    out = spread_join(classed.where("doc_id is not null"), comps.withColumnRenamed("node", "rep"), ["rep"], ["doc_id"], "left")
    out = out.select("doc_id", "n", F.coalesce("comp", "rep").alias("comp")).union(classed.where("doc_id is null").select("doc_id", "n", "rep"))
    result = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    shared.unpersist()
    inside.unpersist()
    return result


def _across_tiles(texts: DataFrame, large: DataFrame, links: DataFrame, shared, bits: Sizes) -> DataFrame:
    """Completes the links of clusters with several tiles. shared: the filters of repeated and of hot shingles."""
    links = links.select("a", "b")

    def labelled(links: DataFrame) -> DataFrame:
        comps = components(links, "jaccard-part")
        found = large.join(comps, F.col("doc") == F.col("node"), "left").select("doc", "cluster", "n", "tiles", "tile", F.coalesce("comp", "doc").alias("label"))
        return materialize(found, "jaccard-labels")

    now = labelled(links)
    while True:  # representatives of components, until one tile holds those of each cluster or they stay as many
        heads = now.groupBy("cluster", "label").agg(F.count("*").alias("c"), F.min(F.struct("doc", "n")).alias("m")).where("c > 1")
        heads = materialize(_tiled(heads.select("cluster", "label", F.col("m.doc").alias("doc"), F.col("m.n").alias("n"))), "jaccard-heads")
        before, several = heads.count(), heads.where("tiles > 1").limit(1).count()
        merged = 0
        if before > 1:
            more = _joined(_with_text(texts, heads.select("doc", "cluster", "tile", "label", F.lit(None).cast("boolean").alias("probe"), "tiles")), "jaccard-links").select("a", "b")
            merged = more.limit(1).count()
            if merged:
                links = links.union(more)
                now = labelled(links)
        if not merged or not several:
            break

    def compared(posts: DataFrame) -> DataFrame:
        """Compares the pairs of all shingles of at most HOT_DF documents; returns the documents (doc) of others that stand in several components.

        posts: doc, cold, hot (arrays of shingles). A cold shingle has at most HOT_DF documents, so these meet at once. Hot
        ones are counted inside the tasks first; only those that prove to be rare are sent. (Some documents more may return.)
        """
        nonlocal links, now
        width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        posts = materialize(posts.join(now.select("doc", "n"), "doc").select("doc", "n", "cold", "hot"), "jaccard-posts")
        rows = posts.join(now.select("doc", "label"), "doc").select("doc", "label", "n", "cold", "hot")
        few = rows.select(F.explode("cold").alias("token"), "doc", "label", "n")
        rare = materialize(_mixed(rows).where(F.col("df") <= HOT_DF).select("token"), "jaccard-rare")
        if rare.limit(1).count():
            known, bits = _known(rare)
            sent = rows.select("doc", "label", "n", "hot").mapInArrow(_of_hot(known, bits), "token bigint, doc bigint, label bigint, n bigint")
            few = few.union(spread_join(sent, rare, ["token"], ["doc"]).select("token", "doc", "label", "n"))
        pairs = materialize(few.repartition(width, "token").mapInArrow(_cold_pairs, "a bigint, b bigint").distinct(), "jaccard-pairs")
        if pairs.limit(1).count():
            counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE_DOCS).cast("int").alias("parts"))
            dealt = spread_join(pairs, counts, ["a"], ["b"]).withColumn("tile", F.pmod(F.xxhash64("b", "parts"), F.col("parts")).cast("int"))
            ones = counts.select(F.col("a").alias("cluster"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("tile"), F.col("a").alias("doc"), F.lit(True).alias("probe"))
            rows = ones.union(dealt.select("a", "tile", "b", F.lit(False))).join(now.select("doc", "label"), "doc")
            more = _joined(_with_text(texts, rows.withColumn("tiles", F.lit(2))), "jaccard-links").select("a", "b")
            if more.limit(1).count():
                links = links.union(more)
                now = labelled(links)
        rows = posts.join(now.select("doc", "label"), "doc").select("doc", "label", "n", "hot")
        still = materialize(_mixed(rows).where(F.col("df") > HOT_DF).select("token"), "jaccard-still")
        if not still.limit(1).count():
            return still.withColumnRenamed("token", "doc")
        known, bits = _known(still)
        return materialize(rows.mapInArrow(_with_hot(known, bits), "doc bigint"), "jaccard-dense")

    dense = compared(texts.mapInArrow(released(_prefix_rows(shared, bits)), "doc bigint, cold array<bigint>, hot array<bigint>"))
    if not dense.limit(1).count():
        return links
    # the same among the documents of hot shingles, with prefixes by their exact frequency there. Shingles of one component
    # are no part of what two components share, so they come first in the order and needn't be joined or sent
    own = texts.join(dense, "doc", "left_semi").join(now.select(F.col("doc").alias("__d"), "label", "n"), F.col("doc") == F.col("__d"))
    every = own.select("doc", "label", "n", "text").mapInArrow(_every_shingle(shared, bits), "token bigint, doc bigint, label bigint, n bigint")
    every = materialize(every, "jaccard-every")
    counts = every.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token", "df")
    mixed = spread_join(every.select("token", "doc", "n"), counts, ["token"], ["doc"])
    each = Window.partitionBy("doc")
    ranked = mixed.withColumns({"m": F.count("*").over(each), "r": F.row_number().over(each.orderBy("df", "token"))})
    prefix = ranked.where("r <= m - ceil(3 * n / 4) + 1")
    dense = compared(prefix.groupBy("doc").agg(*(F.collect_list(F.when(x, F.col("token"))).alias(k) for k, x in (("cold", F.col("df") <= HOT_DF), ("hot", F.col("df") > HOT_DF)))))
    if not dense.limit(1).count():
        return links
    rows = now.join(dense, "doc", "left_semi").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3))).cast("int"))
    rows = materialize(_tiled(rows.select("doc", "cluster", "n", "label", "size"), ("cluster", "size")), "jaccard-sized")
    counts = rows.groupBy("cluster", "label").agg(F.count("*").alias("c"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("cluster", F.col("m.label").alias("top"))
    open_ = materialize(spread_join(rows, largest, ["cluster"], ["doc"]), "jaccard-open")
    # each document apart meets the tiles of its own and the next size classes: groups of one tile and one piece of those apart
    apart = open_.where("label <> top").select("doc", "cluster", "label", F.explode(F.array(*(F.col("size") + i for i in (-1, 0, 1)))).alias("size"))
    pieces = apart.groupBy("cluster", "size").agg(F.ceil(F.count("*") / TILE_DOCS).cast("int").alias("pieces"))
    tiles = rows.groupBy("cluster", "size").agg(F.max("tiles").alias("tiles"))
    grid = pieces.join(tiles, ["cluster", "size"])
    place = F.concat_ws("/", F.col("size").cast("string"), F.col("at").cast("string"), F.col("piece").cast("string")).alias("tile")
    a = spread_join(apart, grid, ["cluster", "size"], ["doc"]).withColumn("piece", F.pmod(F.xxhash64("doc", "pieces", F.lit("piece")), F.col("pieces")).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    b = spread_join(open_.drop("tiles"), grid, ["cluster", "size"], ["doc"]).withColumn("at", F.col("tile")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    both = [x.select("doc", "cluster", place, "label", F.lit(p).alias("probe"), F.lit(2).alias("tiles")) for x, p in ((a, True), (b, False))]
    return links.union(_joined(_with_text(texts, both[0].union(both[1])), "jaccard-links").select("a", "b"))


def _chosen(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Of the rows with one id in ids (column key) one, the same however the rows are dealt."""
    mark, nth = fresh([*docs.columns, key], "mark", "nth")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    some = docs.join(ids, F.col("doc_id").cast("bigint") == F.col(key), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(mark, *quoted(["text"]))
    return some.withColumn(mark, F.xxhash64(*quoted(plain))).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(mark, nth)


def _apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two parts by a filter of ids: rows of none of them, which need no join, and the rest (some others too)."""
    bits = int(np.clip(ids.count().bit_length() + 4, 16, 30))
    inside = docs.sparkSession.sparkContext.broadcast(id_filter(ids, bits))

    @F.pandas_udf("boolean")
    def marked(key: pd.Series) -> pd.Series:
        return pd.Series(_marked(inside.value.array(), _slots(key.to_numpy(), bits)))

    key = F.col("doc_id").cast("bigint")
    told = key.isNotNull() & marked(F.coalesce(key, F.lit(0).cast("bigint")))
    return docs.where(~told), docs.where(told)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays (the smallest id), with all columns; rows without id stay; of repeated rows, one."""
    found = similar_documents(docs)
    gone, twice = fresh(docs.columns, "gone", "twice")
    counts = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("times"))
    leave = materialize(counts.where("c <> doc_id").select(F.col("doc_id").alias(gone)), "jaccard-gone")
    again = materialize(counts.where("times > 1 and c = doc_id").select(F.col("doc_id").alias(twice)), "jaccard-again")
    kept, looked = _apart(docs, leave.union(again))
    looked = looked.join(leave, F.col("doc_id").cast("bigint") == F.col(gone), "left_anti")
    if again.limit(1).count():
        one = _chosen(looked, again, twice)
        looked = looked.join(again, F.col("doc_id").cast("bigint") == F.col(twice), "left_anti").unionByName(one)
    return kept.unionByName(looked).select(*quoted(docs.columns))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return similar_documents(table(spark, sf_dir, "documents"))
