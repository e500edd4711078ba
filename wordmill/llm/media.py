"""Media columns: Matroska files as a binary column, written from samples and parsed into packet tables.

The parser reads variable-length EBML elements, also those of unknown size, and knows segment info, tracks, clusters,
simple blocks, block groups, all four kinds of lacing, and cues. Each packet has its track, timestamp, and byte range in
the file, so payloads are read back from the stored bytes alone.

Defined results: null text counts as empty and gives one padded packet; equal texts give equal files; bytes that aren't
Matroska give an empty packet table with `error` set; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNIT, RATE = 64, 8000
FRAME, LACED, BLOCKS = 256, 16, 16  # bytes of a frame, frames of a block, blocks of a cluster

# Matroska element identifiers.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TIME_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
NUMBER, UID, KIND, CODEC, LACING, FRAME_TIME = 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
SAMPLE_RATE, CHANNELS, DEPTH, DOC_TYPE = 0xB5, 0x9F, 0x6264, 0x4282
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_PLACE}
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}


# ------------------------------------------------------------------ writing


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(key: int, n: int) -> bytes:
    return _element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < 1 << 7 * width - 1:
        width += 1
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def block(frames: list[bytes], track: int, time: int, lacing: str = "auto") -> bytes:
    """The body of a (simple) block; auto: fixed lacing for frames of one size, else EBML lacing."""
    if lacing == "auto":
        lacing = "none" if len(frames) == 1 else "fixed" if len({*map(len, frames)}) == 1 else "ebml"
    head = _size(track) + struct.pack(">h", time)
    if lacing == "none":
        return head + b"\x80" + frames[0]
    count = bytes([len(frames) - 1])
    if lacing == "fixed":
        return b"".join([head, b"\x84", count, *frames])
    if lacing == "xiph":
        sizes = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
        return b"".join([head, b"\x82", count, sizes, *frames])
    steps = [_size(len(frames[0]))] + [_signed_size(len(b) - len(a)) for a, b in zip(frames, frames[1:-1])]
    return b"".join([head, b"\x86", count, *steps, *frames])


_HEADER = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_TRACKS = _element(TRACKS, _element(TRACK, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _uint(LACING, 1) + _uint(FRAME_TIME, FRAME * 10**9 // RATE) + _element(AUDIO, _element(SAMPLE_RATE, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))))


def write_samples(payload: bytes) -> bytes:
    """One track of 8-bit samples at RATE, in laced simple blocks, with a cue for each cluster; timestamps in milliseconds."""
    info = _element(INFO, _uint(TIME_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + _element(MUXER, b"wordmill") + _element(WRITER, b"wordmill"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    per_block, per_cluster = FRAME * LACED, FRAME * LACED * BLOCKS
    for a in range(0, len(payload), per_cluster):
        start = a * 1000 // RATE
        body = [_uint(CLUSTER_TIME, start)]
        for b in range(a, min(a + per_cluster, len(payload)), per_block):
            frames = [payload[c : c + FRAME] for c in range(b, min(b + per_block, len(payload)), FRAME)]
            body.append(_element(SIMPLE_BLOCK, block(frames, 1, b * 1000 // RATE - start)))
        parts.append(_element(CLUSTER, b"".join(body)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return _HEADER + _element(SEGMENT, b"".join(parts))


# ------------------------------------------------------------------ parsing


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte place of the cluster in the file
    packets: list[tuple[int, int, int, int, bool, str]] = field(default_factory=list)  # track, ns, offset, size, key, lacing
    clusters: list[int] = field(default_factory=list)


def _number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A variable-length number: (value, next place, whether all its bits are set)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError("not a variable-length number")
    if at + width > len(data):
        raise ValueError("cut off")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width, False
    n &= (1 << 7 * width) - 1
    return n, at + width, n == (1 << 7 * width) - 1


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """(track, relative time, flags, lacing, byte ranges) of a block's body."""
    track, at, _ = _number(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    if lacing == "none":
        return track, time, flags, lacing, [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == "xiph":
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == "ebml":
        for i in range(count - 1):
            begin = at
            n, at, _ = _number(data, at)
            sizes.append(n if i == 0 else sizes[-1] + n - (1 << 7 * (at - begin) - 1) + 1)
    else:
        sizes = [(end - at) // count] * (count - 1)
    rest = end - at - sum(sizes)
    if rest < 0 or min([0, *sizes]) < 0 or lacing == "fixed" and rest != (end - at) // count:
        raise ValueError("lacing doesn't fit its block")
    out = []
    for n in [*sizes, rest]:
        out.append((at, n))
        at += n
    return track, time, flags, lacing, out


def parse(data: bytes) -> Media:
    """Walks the elements of a file; raises ValueError where the bytes break the format."""
    media, segment = Media(), 0
    now = {"cluster": 0}

    def add(at: int, end: int, key: bool | None = None) -> None:
        """key: whether a group's block is a keyframe; a simple block tells by its flags."""
        track, time, flags, lacing, ranges = _frames(data, at, end)
        step = media.tracks.get(track, {}).get("frame_ns") or 0
        ns = (now["cluster"] + time) * media.scale
        for i, (place, size) in enumerate(ranges):
            media.packets.append((track, ns + i * step, place, size, bool(flags & 0x80) if key is None else key, lacing))

    def walk(at: int, end: int, inside: int, target) -> int:
        nonlocal segment
        while at < end:
            start = at
            key, at, _ = _number(data, at, keep_marker=True)
            if inside == CLUSTER and (key in _TOP or key == SEGMENT):
                return start  # ends a cluster of unknown size
            size, at, unknown = _number(data, at)
            stop = end if unknown else at + size
            if stop > end:
                raise ValueError("element is longer than its parent")
            if unknown and key not in (SEGMENT, CLUSTER):
                raise ValueError("only segments and clusters can have unknown size")
            if key in _MASTERS:
                inner = target
                if key == SEGMENT:
                    segment = at
                elif key == CLUSTER:
                    media.clusters.append(start)
                    now["cluster"] = 0
                elif key == TRACK:
                    inner = {}
                elif key == CUE_POINT:
                    inner = {"time": 0, "places": []}
                elif key == CUE_PLACE:
                    inner = {}
                    target["places"].append(inner)
                elif key == BLOCK_GROUP:
                    inner = {"blocks": [], "key": True}
                stop = walk(at, stop, key, inner) if unknown else (walk(at, stop, key, inner), stop)[1]
                if key == BLOCK_GROUP:  # a block that refers to another isn't a keyframe
                    for place in inner["blocks"]:
                        add(*place, inner["key"])
                elif key == TRACK:
                    media.tracks[inner.get("number", 0)] = inner
                elif key == CUE_POINT:
                    media.cues += [(inner["time"], p.get("track", 0), segment + p.get("cluster", 0)) for p in inner["places"]]
            elif key == SIMPLE_BLOCK:
                add(at, stop)
            elif key == BLOCK:
                target["blocks"].append((at, stop))
            elif key == REFERENCE and inside == BLOCK_GROUP:
                target["key"] = False
            elif key == CLUSTER_TIME:
                now["cluster"] = int.from_bytes(data[at:stop], "big")
            elif key == TIME_SCALE:
                media.scale = int.from_bytes(data[at:stop], "big")
            elif key == DURATION:
                media.duration = struct.unpack(">d" if size == 8 else ">f", data[at:stop])[0]
            elif key == CODEC and target is not None:
                target["codec"] = data[at:stop].decode()
            elif key == SAMPLE_RATE and target is not None:
                target["rate"] = struct.unpack(">d" if size == 8 else ">f", data[at:stop])[0]
            elif key in _FIELDS and target is not None:
                target[_FIELDS[key]] = int.from_bytes(data[at:stop], "big")
            at = stop
        return at

    try:
        key, at, _ = _number(data, 0, keep_marker=True)
        if key != EBML:
            raise ValueError("no EBML header")
        size, at, _ = _number(data, at)
        head = at + size
        while at < head:
            key, at, _ = _number(data, at, keep_marker=True)
            n, at, _ = _number(data, at)
            if at + n > head:
                raise ValueError("element is longer than its parent")
            if key == DOC_TYPE:
                media.doc_type = data[at : at + n].rstrip(b"\0").decode()
            at += n
        walk(head, len(data), 0, None)
    except (IndexError, KeyError, struct.error, UnicodeDecodeError, TypeError) as e:
        raise ValueError(f"broken file: {e}") from e
    return media


_FIELDS = {NUMBER: "number", UID: "uid", KIND: "kind", LACING: "lacing", FRAME_TIME: "frame_ns", CHANNELS: "channels", DEPTH: "depth", CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}


def read_samples(data: bytes, track: int = 1) -> tuple[bytes, Media]:
    """The track's payload, put together from the packets' byte ranges in order of time."""
    media = parse(data)
    packets = sorted((p for p in media.packets if p[0] == track), key=lambda p: (p[1], p[2]))
    return b"".join(data[p[2] : p[2] + p[3]] for p in packets), media


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def features(samples: bytes, media: Media) -> str:
    """Packets, clusters, milliseconds; mean, deviation and entropy of the samples; share of steps that cross 128."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256).astype(float)
    p = n / max(1, len(x))
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ (np.arange(256) - mean) ** 2)))
    used = p[p > 0]
    high = x >= 128
    cross = int((high[1:] != high[:-1]).sum()) / max(1, len(x) - 1)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={media.duration:.3f};mean={mean:.4f};std={deviation:.4f};entropy={-float(used @ np.log2(used)):.4f};cross={cross:.6f}"


# ------------------------------------------------------------------ DataFrame operators


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a Matroska file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([write_samples(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each packet: key, track, packet, timestamp_ns, offset, size, keyframe, lacing; broken files give one row with error."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names = [key, "track", "packet", "timestamp_ns", "offset", "size", "keyframe", "lacing", "error"]
        types = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, p[0], i, *p[1:], None) for i, p in enumerate(parse(data or b"").packets)]
                except ValueError as e:
                    rows.append((k, None, None, None, None, None, None, None, str(e)))
            types[0] = batch.schema.field(0).type
            columns = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, track bigint, packet bigint, timestamp_ns bigint, `offset` bigint, size bigint, keyframe boolean, lacing string, error string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as Matroska samples, read back from the packets' byte ranges, and described."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                media = write_samples(pad(raw))
                back, parsed = read_samples(media)
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(back, parsed)))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
