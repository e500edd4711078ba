"""Media and WARC: exact round trips."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordmill.llm import media as M
from wordmill.llm import warc as W
from wordmill.llm.common import work_path


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_media_round_trip(raw):
    payload = M.pad(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw) and len(payload) - len(raw) <= 64
    data = M.write_samples(payload)
    back, media = M.read_samples(data)
    assert back == payload and media.doc_type == "matroska" and media.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert [c[2] for c in media.cues] == media.clusters
    assert sorted(p[1] for p in media.packets) == [p[1] for p in media.packets]


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml"])
def test_lacing_and_unknown_sizes(lacing):
    frames = [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == "fixed" else [b"a" * 700, b"b" * 20, b"c" * 255, b"d" * 33]
    if lacing == "none":
        frames = frames[:1]
    track = M._element(M.TRACKS, M._element(M.TRACK, M._uint(M.NUMBER, 2) + M._uint(M.FRAME_TIME, 1_000_000)))
    body = M._uint(M.CLUSTER_TIME, 50) + M._element(M.SIMPLE_BLOCK, M.block(frames, 2, -3, lacing)) + M._element(M.BLOCK_GROUP, M._element(M.BLOCK, M.block(frames, 2, 9, lacing)))
    unknown = b"\x01" + b"\xff" * 7
    cluster = M.CLUSTER.to_bytes(4, "big") + unknown + body
    data = M._element(M.EBML, M._element(M.DOC_TYPE, b"webm")) + M.SEGMENT.to_bytes(4, "big") + unknown + track + cluster + cluster
    media = M.parse(data)
    n = len(frames)
    assert len(media.packets) == 4 * n and len(media.clusters) == 2 and media.doc_type == "webm"
    assert [data[p[2] : p[2] + p[3]] for p in media.packets] == frames * 4
    assert [p[1] for p in media.packets[:n]] == [47_000_000 + i * 1_000_000 for i in range(n)]


def test_keyframes_and_document_type():
    """A block that refers to another is no keyframe; the type is an element, not a run of bytes that looks like one."""
    group = lambda *more: M._element(M.BLOCK_GROUP, M._element(M.BLOCK, M.block([b"abc"], 1, 0)) + b"".join(more))
    cluster = M._element(M.CLUSTER, M._uint(M.CLUSTER_TIME, 0) + group() + group(M._element(M.REFERENCE, b"\xff")) + M._element(M.SIMPLE_BLOCK, M.block([b"abc"], 1, 0)))
    odd = M._element(0x4283, b"\x42\x82\x84fake")
    data = M._element(M.EBML, odd + M._element(M.DOC_TYPE, b"webm")) + M._element(M.SEGMENT, cluster)
    media = M.parse(data)
    assert media.doc_type == "webm" and [p[4] for p in media.packets] == [True, False, True]


@given(st.binary(max_size=300))
def test_broken_media(raw):
    good = M.write_samples(M.pad(b"hello"))
    for data in (raw, good[: len(good) // 2], good[:40] + raw + good[60:]):
        try:
            M.parse(data)
        except ValueError:
            pass


def test_media_query(spark, small):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = M.op4_media(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        payload = M.pad(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(docs[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_media_frames(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "ä" * 9000, 7), (3, "ä" * 9000, 7), (None, "x", 8)], "doc_id bigint, text string, media int")
    stored = M.store_texts(df)
    rows = stored.collect()
    assert [r["n_bytes"] for r in rows] == [0, 0, 18000, 18000, 1] and rows[0]["media"] == rows[1]["media"] and rows[2]["media"] == rows[3]["media"]
    packets = M.packet_table(stored).where("doc_id = 1").collect()
    assert [(p["track"], p["size"], p["timestamp_ns"]) for p in packets] == [(1, 64, 0)]
    broken = spark.createDataFrame([(1, b"nonsense"), (2, None)], "doc_id bigint, media binary")
    assert all(r["error"] for r in M.packet_table(broken).collect())
    assert M.store_texts(df.limit(0)).count() == 0


# ------------------------------------------------------------------ WARC


def brute_pages(rows):
    out = []
    for page, _, html in rows:
        raw = html.encode() if html is not None else b""
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        head = max(same, default=None)
        again = len(raw) >= 1000 and page is not None and page < head
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def test_warc_archive(spark):
    long = "<p>ä</p>" * 200
    rows = [(i, f"http://x.org/{i % 5}\n", long if i % 3 == 0 else "y" * (999 + i % 2) if i % 3 == 1 else f"<b>{i}</b>" * 300) for i in range(60)]
    rows += [(100, None, None), (101, "http://z", ""), (None, "http://n", long), (57, "http://x.org/57", long), (57, "http://x.org/57", long), (-5, "http://neg", long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS kind", "3 AS size")
    roots = [work_path(spark, "warc-test") for _ in range(2)]
    manifests = [W.write_archive(pages.repartition(3 + i), root, roll=20_000, shard=60_000).orderBy("file", "offset").collect() for i, root in enumerate(roots)]
    assert [(m["file"], m["sha256"]) for m in manifests[0]] == [(m["file"], m["sha256"]) for m in manifests[1]]
    assert len({m["file"] for m in manifests[0]}) > 1
    back = W.read_archive(spark, roots[0], with_payload=True).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back], key=str) == brute_pages(rows)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in back)
    empty = work_path(spark, "warc-test")
    assert W.write_archive(pages.limit(0), empty).count() == 0 and W.read_archive(spark, empty).count() == 0


def test_warc_damage():
    raw = W.member(W.write_record(3, "http://x", b"payload"))
    (record,) = W.read_members(raw)
    ((headers, block),) = W.parse_records(record)
    assert W.payload_of(headers, block)[2] == b"payload" and headers["warc-target-uri"] == "http://x"
    with pytest.raises(ValueError):
        W.payload_of(headers, block.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError):
        list(W.read_members(raw[:-9]))
    assert struct.unpack("<I", raw[4:8])[0] == 0


def test_warc_query(spark, small):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    got = sorted([tuple(r) for r in W.op7_warc(spark, small).collect()], key=str)
    assert got == brute_pages(rows)
