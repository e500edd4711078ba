"""Secret scans: a worklist unwraps nested encodings until nothing new appears, and rescans every layer.

A layer is a text with a map from its characters to code points of the document. From each layer the worklist makes
children: all percent escapes decoded, all Unicode escapes decoded (``\\uXXXX``, ``\\xXX``, ``&#...;``, full-width forms,
zero-width characters), and children for each base64 run: the compressed stream (gzip, zlib, bzip2, xz, zstandard) or the
text of the first of the four alignments that gives one, else the bytes of all four as UTF-8, UTF-16 and Latin-1. A layer
whose content and place were seen before is not taken again, so cycles end. Maps are runs of equal width, so a long text
with few escapes costs no memory for its characters.

Defined results: null text counts as empty and has no spans; an empty table gives an empty table; repeated rows give
repeated results; other columns are ignored by the scan and kept by redaction. A stream that unpacks to more than
MAX_LAYER bytes is scanned in overlapping pieces of PIECE bytes; its document has `complete` false, as an encoded layer
longer than a piece may be cut there, and so has one with a stream that asks for more memory than a decompressor may take
(xz 256 MB, zstandard a window of 64 MB). Redaction removes such streams. All members of a stream are read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered_columns, place_of, released, table

KINDS = ("assign", "access", "hex")
MAX_LAYER, PIECE, OVERLAP, NESTED = 16 << 20, 4 << 20, 64 << 10, 64

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_LOWER = 1 << 20
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPED = re.compile(r"[A-Za-z0-9_.~!*'()/+-]*+%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])*+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|%u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|[\uff01-\uff5e]|[\u200b-\u200d\u2060\ufeff\u00ad]")
_WIDE = re.compile(r"[\uff01-\uff5e\u200b-\u200d\u2060\ufeff\u00ad]")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}")
_SPLIT = re.compile(r"[^/_+-]{16,}={0,2}")
_START = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_LONE = re.compile(rb"[\xd8-\xdf]")  # bytes that can be half of a surrogate
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns: leftmost, non-overlapping for each kind, short matches dropped."""
    out = []
    # by pieces, as lower() of a long text that isn't ASCII takes twelve bytes a character for a while
    if any(w in low for low in (text[i : i + _LOWER + 8].lower() for i in range(0, len(text), _LOWER)) for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    # AKIA or hex runs that are too short can't hide a longer match, as a run is taken whole: the bound can stand in the pattern.
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class _Map:
    """From a layer's characters to the document's, by way of its parent layer; characters keep their order.

    `of` gives the parent's range of one character. Maps are runs, not lists of characters: a run of equally wide escapes
    or of plain text takes three numbers.
    """

    __slots__ = ("of", "parent")

    def __init__(self, parent: _Map | None = None, of: Callable[[int], tuple[int, int]] | None = None):
        self.parent, self.of = parent, of

    def place(self, start: int, end: int) -> tuple[int, int]:
        here = self
        while here.of is not None:
            start, end = here.of(start)[0], here.of(end - 1)[1]
            if here.parent is None:
                break
            here = here.parent
        return start, end


def _one(lo: int, hi: int) -> _Map:
    """One place of the document for all characters."""
    return _Map(None, lambda _: (lo, hi))


class _Runs:
    """Runs of characters: the first one's number, its place in the parent, and the width of each there."""

    def __init__(self):
        self.first, self.at, self.width = array("q"), array("q"), array("q")
        self.n = 0

    def add(self, at: int, width: int, count: int = 1) -> None:
        if not count:
            return
        if not self.first or self.width[-1] != width or self.at[-1] + (self.n - self.first[-1]) * width != at:
            self.first.append(self.n)
            self.at.append(at)
            self.width.append(width)
        self.n += count

    def of(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.first, i) - 1
        lo = self.at[k] + (i - self.first[k]) * self.width[k]
        return lo, lo + self.width[k]


class _Frames:
    """zstandard's decompressor, fed little by little, as its calls have no bound on what they give."""

    def __init__(self):
        import zstandard

        self.d = zstandard.ZstdDecompressor(max_window_size=64 << 20).decompressobj()
        self.rest = b""

    @property
    def eof(self) -> bool:
        return self.d.eof

    def decompress(self, raw: bytes) -> Iterator[bytes]:
        # a block of 128 KiB can take 4 bytes, so 256 bytes give 8 MiB at most
        for i in range(0, len(raw), 256):
            if out := self.d.decompress(raw[i : i + 256]):
                yield out
            if self.d.eof:
                self.rest = self.d.unused_data + raw[i + 256 :]
                return


def _bounded(d, raw: bytes) -> Iterator[bytes]:
    """What a zlib, bz2 or lzma decompressor makes of the bytes, at most PIECE at once."""
    if hasattr(d, "unconsumed_tail"):
        while raw and not d.eof:
            out = d.decompress(raw, PIECE)
            raw = d.unconsumed_tail
            yield out
        while not d.eof and (out := d.decompress(b"", PIECE)):
            yield out
    else:
        yield d.decompress(raw, PIECE)
        while not d.eof and not d.needs_input:
            yield d.decompress(b"", PIECE)


def _member(start: bytes):
    """A decompressor for a stream that begins so, or None."""
    if start[:2] == b"\x1f\x8b" or start[:1] == b"\x78":
        return zlib.decompressobj(47)
    if start[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if start[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=256 << 20)
    return _Frames() if start[:4] == b"\x28\xb5\x2f\xfd" else None


def _inflated(chunks: Iterator[bytes], ended: list[int] | None = None, refused: list[str] | None = None) -> Iterator[bytes]:
    """The content of all members, in pieces of bounded size; what is damaged or no stream ends it.

    ended takes the number of bytes left of a chunk after each member that ends as it should; refused a note if a stream
    asks for more memory than its decompressor may take.
    """
    d, raw = None, b""
    try:
        for chunk in chunks:
            raw += chunk
            while raw:
                if d is None:
                    raw = raw.lstrip(b"\0")  # padding between members
                    if len(raw) < 6 and not raw.startswith(_MAGIC):
                        break
                    if not raw.startswith(_MAGIC) or (d := _member(raw)) is None:
                        return
                if isinstance(d, _Frames):
                    yield from d.decompress(raw)
                    raw = d.rest if d.eof else b""
                else:
                    yield from filter(None, _bounded(d, raw))
                    raw = d.unused_data if d.eof else b""
                if d.eof:
                    d = None
                    if ended is not None:
                        ended.append(len(raw))
    except Exception as e:  # not a stream of that kind, or only in part
        if refused is not None and "memory" in str(e).lower():
            refused.append(str(e))


def _unpack(raw: bytes) -> tuple[bytes | None, bool, int]:
    """(content of a compressed stream's members or None, whether it fits MAX_LAYER, bytes up to the last proper end if it does)."""
    out, ended, refused = bytearray(), [], []
    for piece in _inflated(iter([raw]), ended, refused):
        out += piece
        if len(out) > MAX_LAYER:
            return None, False, 0
    return bytes(out) or None, not refused, len(raw) - ended[-1] if ended else 0


def _decoded(raw: bytes) -> list[tuple[str, Callable[[int], tuple[int, int]]]]:
    """(text, byte range of a character): as UTF-8, else Latin-1, and as UTF-16 of either order if bytes of that parity are 0."""
    try:
        s = raw.decode("utf-8")
        if s.isascii():
            out = [(s, lambda i: (i, i + 1))]
        else:
            begin = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))
            out = [(s, lambda i: (int(begin[i]), int(begin[i + 1])))]
    except UnicodeDecodeError:
        out = [(raw.decode("latin-1"), lambda i: (i, i + 1))]
    if len(raw) > 1 and b"\0" in raw:
        for zero, order in ((1, "le"), (0, "be")):
            if 0 in raw[zero::2]:
                s = raw[: len(raw) // 2 * 2].decode(f"utf-16-{order}", "surrogatepass") if not _LONE.search(raw) else "".join(chr(int.from_bytes(raw[i : i + 2], "little" if zero else "big")) for i in range(0, len(raw) - 1, 2))
                out.append((s, lambda i: (2 * i, 2 * i + 2)))
    return out


def _textual(s: str) -> bool:
    return all(c.isprintable() or c in "\t\r\n" for c in s)


def _from_base64(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        body = body[:-1]
    if ("-" in body or "_" in body) and ("+" in body or "/" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class _Worklist:
    def __init__(self, text: str):
        self.queue = deque([(text, _Map(), 0)])
        self.seen: set[bytes] = set()
        self.found: dict[tuple[str, int, int], int] = {}
        self.opaque: set[tuple[int, int]] = set()

    def add(self, text: str, where: _Map, depth: int) -> None:
        if not text:
            return
        key = hashlib.blake2b(str(where.place(0, len(text))).encode(), digest_size=16)
        key.update(text.encode("utf-8", "surrogatepass"))
        key = key.digest()
        if key not in self.seen:
            self.seen.add(key)
            self.queue.append((text, where, depth))

    def add_stream(self, raw: bytes, where: _Map, depth: int) -> int:
        """Takes bytes that may be compressed, several times over; how many of them are whole members (0: perhaps no stream)."""
        layers, taken, done = 0, 0, set()
        while raw.startswith(_MAGIC) and (key := hashlib.blake2b(raw, digest_size=16).digest()) not in done:
            done.add(key)
            out, fits, size = _unpack(raw)
            if not fits:
                size = self.add_large(raw, where, depth + layers + 1)  # also marks a stream that asks for too much memory
            taken = taken if layers else size
            if out is None:
                break
            if layers and size < len(raw):  # it may only begin like a stream
                self.add_bytes(raw, where, depth + layers)
            raw, layers = out, layers + 1
        if layers:
            self.add_bytes(raw, where, depth + layers)
        return taken

    def add_bytes(self, raw: bytes, where: _Map, depth: int) -> None:
        for text, _ in _decoded(raw):
            self.add(text, where, depth)

    def add_large(self, raw: bytes, where: _Map, depth: int) -> int:
        """Scans a stream piece by piece, each with all its layers, so that memory stays bounded; then a stream in it likewise.

        How many of the bytes are whole members.
        """
        self.opaque.add(where.place(0, 1))
        size = 0
        for level in range(1, NESTED + 1):
            ended: list[int] = []
            chunks = _inflated(iter([raw]), ended)
            for _ in range(level - 1):
                chunks = _inflated(chunks)
            if first := next(chunks, b""):
                self.add_pieces(chain([first], chunks), where, depth + level - 1)
            if level == 1:
                size = len(raw) - ended[-1] if ended else 0
            if not first.startswith(_MAGIC):
                break
        return size

    def add_pieces(self, chunks: Iterator[bytes], where: _Map, depth: int) -> None:
        held, queue = bytearray(), self.queue
        for chunk in chain(chunks, [None]):
            held += chunk or b""
            while len(held) >= PIECE or chunk is None and held:
                self.queue = deque()
                self.add_bytes(_whole(bytes(held[:PIECE])), where, depth)
                self.run()
                del held[: len(held) if chunk is None and len(held) <= PIECE else PIECE - OVERLAP]
        self.queue = queue

    def run(self) -> None:
        while self.queue:
            layer, where, depth = self.queue.popleft()
            for kind, a, b in scan(layer):
                self.found.setdefault((kind, *where.place(a, b)), depth)
            if "%" in layer:
                _percent(layer, where, depth, self)
            if "\\" in layer or "&#" in layer or "%u" in layer or (not layer.isascii() and _WIDE.search(layer)):
                _unicode(layer, where, depth, self)
            _base64(layer, where, depth, self)


def _whole(piece: bytes) -> bytes:
    """A piece without the bytes of a UTF-8 character that its ends cut."""
    a, b = 0, len(piece)
    while a < min(3, b) and piece[a] & 0xC0 == 0x80:
        a += 1
    for i in range(1, min(4, b - a) + 1):
        if piece[b - i] & 0xC0 != 0x80:
            if piece[b - i] >= 0xC0:
                b -= i if i < (2 if piece[b - i] < 0xE0 else 3 if piece[b - i] < 0xF0 else 4) else 0
            break
    try:
        piece[a:b].decode("utf-8")
    except UnicodeDecodeError:
        return piece
    return piece[a:b]


def _escaped_streams(text: str, where: _Map, depth: int, work: _Worklist) -> None:
    """Streams in runs of percent escapes and the characters that quoting leaves bare; a plus is a space."""
    for m in _ESCAPED.finditer(text):
        raw, places, i, a = bytearray(), _Runs(), m.start(), m.end()
        while i < a:
            if text[i] == "%":
                raw.append(int(text[i + 1 : i + 3], 16))
                places.add(i, 3)
                i += 3
            else:
                raw.append(0x20 if text[i] == "+" else ord(text[i]))
                places.add(i, 1)
                i += 1
        data, end = bytes(raw), 0
        for s in _START.finditer(data):
            # fed on until something comes out, as a header or a first block can be of any length
            refused: list[str] = []
            if s.start() >= end and (any(_inflated((data[i : i + 4096] for i in range(s.start(), len(data), 4096)), None, refused)) or refused):
                place = _one(*where.place(places.of(s.start())[0], a))
                end = s.start() + work.add_stream(data[s.start() :], place, depth + 1)


def _percent(text: str, where: _Map, depth: int, work: _Worklist) -> None:
    _escaped_streams(text, where, depth, work)
    out, runs, at = [], _Runs(), 0
    for m in _PERCENT.finditer(text):
        a, b = m.span()
        raw = bytes.fromhex(m[0].replace("%", ""))
        out.append(text[at:a])
        runs.add(at, 1, a - at)
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            s = raw.decode("latin-1")
        if len(s) == len(raw):
            runs.add(a, 3, len(s))
        else:
            for c in s:
                n = 3 * len(c.encode())
                runs.add(a, n)
                a += n
        out.append(s)
        at = b
    if at:
        out.append(text[at:])
        runs.add(at, 1, len(text) - at)
        work.add("".join(out), _Map(where, runs.of), depth + 1)


def _code_point(s: str) -> str:
    if len(s) == 1:
        return chr(ord(s) - 0xFEE0) if s >= "\uff01" and s <= "\uff5e" else ""
    if s[0] == "&":
        n = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
    else:
        n = int(s[2:].strip("{}"), 16)
    return chr(n) if n < 0x110000 else s


def _unicode(text: str, where: _Map, depth: int, work: _Worklist) -> None:
    out, runs, at, high = [], _Runs(), 0, None
    for m in _ESCAPE.finditer(text):
        a, b = m.span()
        s = _code_point(m[0])
        if s == m[0]:
            continue
        if high is not None:
            h, begin = high
            high = None
            if at == a and "\udc00" <= s <= "\udfff":  # two escapes of one character
                out.append(chr(0x10000 + ((ord(h) - 0xD800) << 10) + ord(s) - 0xDC00))
                runs.add(begin, b - begin)
                at = b
                continue
            out.append(h)
            runs.add(begin, at - begin)
        out.append(text[at:a])
        runs.add(at, 1, a - at)
        if "\ud800" <= s <= "\udbff":
            high = s, a
        elif s:
            out.append(s)
            runs.add(a, b - a)
        at = b
    if at:
        if high is not None:
            out.append(high[0])
            runs.add(high[1], at - high[1])
        out.append(text[at:])
        runs.add(at, 1, len(text) - at)
        work.add("".join(out), _Map(where, runs.of), depth + 1)


def _base64_child(chars: str, places: range | np.ndarray, where: _Map, depth: int, work: _Worklist) -> bool:
    """Takes the run; false if no alignment is clearly a stream or a text, so that all of them were queued."""

    def mapped(skip: int, ranges: Callable[[int], tuple[int, int]]) -> _Map:
        def of(i: int) -> tuple[int, int]:
            j, k = ranges(i)
            k -= 1
            return int(places[skip + 4 * (j // 3) + j % 3]), int(places[skip + 4 * (k // 3) + k % 3 + 1]) + 1

        return _Map(where, of)

    others, clear = [], False
    for skip in range(4):
        raw = _from_base64(chars[skip:])
        if not raw:
            continue
        if raw.startswith(_MAGIC) and work.add_stream(raw, _one(*where.place(int(places[0]), int(places[-1]) + 1)), depth + 1) == len(raw):
            return True
        layers = [(skip, *x) for x in _decoded(raw)]
        s = layers[0][1]
        if _textual(s) and s.encode() == raw:  # not Latin-1, which any bytes are
            others, clear = layers, True
            break
        others += layers
    for skip, s, ranges in others:
        work.add(s, mapped(skip, ranges), depth + 1)
    return clear


def _base64(text: str, where: _Map, depth: int, work: _Worklist) -> None:
    for m in _BASE64.finditer(text):
        a, b = m.span()
        if not _base64_child(m[0], range(a, b), where, depth, work):
            for p in _SPLIT.finditer(m[0]) if len(m[0]) > 16 else ():
                if p[0] != m[0]:
                    _base64_child(p[0], range(a + p.start(), a + p.end()), where, depth, work)
    if "\n" in text and len(text) > 41:
        for m in _WRAPPED.finditer(text):
            run = np.frombuffer(m[0].encode(), np.uint8)
            keep = np.flatnonzero((run != 10) & (run != 13))
            _base64_child(run[keep].tobytes().decode(), keep + m.start(), where, depth, work)


def scan_layers(text: str | None) -> tuple[list[tuple[str, int, int, int]], list[tuple[int, int]]]:
    """All spans (kind, start, end, depth) in the document's code points, sorted; depth 0: in the plain text.

    The second value are the places of streams that were too large to unpack at once and were scanned in pieces, or that
    ask for too much memory.
    """
    if not text:
        return [], []
    work = _Worklist(text)
    work.run()
    order = sorted(work.found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
    return [(*span, depth) for span, depth in order], sorted(work.opaque)


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int, int]], bool]:
    """The spans, and whether every layer was scanned whole."""
    spans, opaque = scan_layers(text)
    return spans, not opaque


def cleaned(text: str | None) -> str | None:
    """The text without its secrets; a stream that couldn't be scanned whole goes too."""
    spans, opaque = scan_layers(text)
    return redact(text, sorted([*spans, *(("stream", a, b, 0) for a, b in opaque)], key=lambda s: (s[1], s[2])))


def redact(text: str | None, spans: list[tuple[str, int, int, int]]) -> str | None:
    """The text with each union of overlapping spans replaced by [SECRET]."""
    if not spans:
        return text
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


# ------------------------------------------------------------------ DataFrame operators

_SPANS = "array<struct<kind:string,start:bigint,end:bigint,depth:int>>"


def _finder() -> Callable[[Iterator], Iterator]:
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))
        for batch in batches:
            found = [find_secrets(t) for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "start", "end", "depth"), s)) for s in f[0]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array([f[1] for f in found], pa.bool_())], ["doc_id", "spans", "complete"])

    return run


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, depth), complete: one row for each document, in one narrow pass."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_finder(), f"doc_id bigint, spans {_SPANS}, complete boolean")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span of a secret, and every stream that couldn't be scanned whole, replaced.

    n_chars follows where the column is there. Nothing else changes.
    """
    at = place_of(docs, "text")
    counted = place_of(docs, "n_chars") if "n_chars" in [c.lower() for c in docs.columns] else None
    plain = numbered_columns(docs)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [cleaned(t) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array([o if t is s or s is None else len(s) for o, t, s in zip(old, texts, new)], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return plain.mapInArrow(released(run), plain.schema).toDF(*docs.columns)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the plain spans, and all spans, of every document."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["depth"] == 0)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: (s["depth"] == 0) & (s["kind"] == kind))).cast("bigint")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_nested"),
        "complete",
    )
