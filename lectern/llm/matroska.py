"""Operator 9: Matroska media columns.

mux() writes 8-bit PCM samples as a Matroska file (clusters of SimpleBlocks with no, Xiph, fixed and EBML lacing, and
cues); demux() parses variable-length EBML elements, of known and unknown size, clusters, Block and SimpleBlock, all
lacings and cues into a packet table with timestamps, tracks and byte ranges. Elements that it doesn't know are passed
over; a file that ends inside an element gives the packets before it.

A text's payload is its UTF-8 bytes and zeros up to a positive multiple of 64. Null is an empty text (64 zeros). Equal
texts give equal files. Extra columns are ignored. Work is row by row: there are no groups, and rows of any length are
handled alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Element ids of the format.
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH, DEFAULT = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOCTYPE, MUXER, WRITER = 0x4282, 0x4D80, 0x5741
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
SAMPLES, PER_CLUSTER = 8000, 1 << 16


def vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(mode: int, time: int, payload: bytes) -> bytes:
    """A SimpleBlock of track 1 whose payload is cut into frames by the lacing mode (0 none, 1 Xiph, 2 fixed, 3 EBML)."""
    unit = len(payload) // 64
    if unit < 8:
        mode = 0
    head = vint(1) + struct.pack(">hB", time, 0x80 | mode << 1)
    if mode == 0:
        return element(SIMPLE, head + payload)
    if mode == 2:
        count = 4 if unit % 4 == 0 else next((c for c in (3, 2) if unit % c == 0), 1)
        return element(SIMPLE, head + bytes([count - 1]) + payload)
    sizes = [64 * (unit // 8 + (i % 2)) for i in range(5)]
    sizes.append(len(payload) - sum(sizes))
    if mode == 1:
        lace = b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    else:
        lace = vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            lace += vint(d + (1 << 7 * w - 1) - 1, w)
    return element(SIMPLE, head + bytes([len(sizes) - 1]) + lace + payload)


def mux(payload: bytes, block: int = 4096) -> bytes:
    """A file with the payload (a multiple of 64 bytes) as 8-bit samples of one audio track."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOCTYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + element(MUXER, b"lectern") + element(WRITER, b"lectern"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLES)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(UID, 1) + uint(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(payload), PER_CLUSTER):
        time = c * 1000 // SAMPLES
        body = [uint(TIME, time)]
        for i, b in enumerate(range(c, min(c + PER_CLUSTER, len(payload)), block)):
            body.append(_block(i % 4, b * 1000 // SAMPLES - time, payload[b : min(b + block, c + PER_CLUSTER)]))
        cues.append(element(POINT, uint(CUE_TIME, time) + element(POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """tracks: number -> codec. packets: (track, time in ns, byte from, byte to, cluster, key). cues: (time, track, cluster's byte)."""

    scale: int
    tracks: dict[int, str]
    packets: list[tuple[int, int, int, int, int, bool]]
    cues: list[tuple[int, int, int]]


def _vint(d: bytes, at: int, end: int, marker: bool) -> tuple[int | None, int]:
    """(value, next place); None for an unknown size. ValueError beyond the end."""
    if at >= end or not d[at]:
        raise ValueError("no element")
    width = 9 - d[at].bit_length()
    if at + width > end:
        raise ValueError("cut off")
    n = int.from_bytes(d[at : at + width], "big")
    if not marker:
        n &= (1 << 7 * width) - 1
        if n == (1 << 7 * width) - 1:
            return None, at + width
    return n, at + width


def elements(d: bytes, at: int, end: int, stop: set[int] = frozenset()):
    """(id, body from, body to) of each element in a range; one of unknown size reaches up to the next top element
    that can't be inside it, and a cut-off one to the end."""
    while at < end:
        try:
            kind, body = _vint(d, at, end, True)
            n, body = _vint(d, body, end, False)
        except ValueError:
            return
        if kind in stop:
            return
        if n is None:
            last = body
            outside = TOP if kind == CLUSTER else {SEGMENT, EBML}
            for x, _, y in elements(d, body, end, outside):
                last = y
            to = last
        else:
            to = min(body + n, end)
        yield kind, body, to
        at = to


def laces(d: bytes, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if mode == 0:
        return [(at, end)]
    count, at = d[at] + 1, at + 1
    sizes = []
    if mode == 2:
        sizes = [(end - at) // count] * count
    elif mode == 1:
        for _ in range(count - 1):
            n = 0
            while d[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + d[at])
            at += 1
    else:
        n, at = _vint(d, at, end, False)
        sizes.append(n)
        for _ in range(count - 2):
            width = 9 - d[at].bit_length()
            n, at = _vint(d, at, end, False)
            n = (1 << 7 * width) - 1 if n is None else n
            sizes.append(sizes[-1] + n - ((1 << 7 * width - 1) - 1))
    if mode != 2:
        sizes = sizes[: count - 1]
        sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes:
        if n < 0 or at + n > end:
            raise ValueError("bad lacing")
        out.append((at, at + n))
        at += n
    return out


def demux(d: bytes) -> Media:
    m = Media(1_000_000, {}, [], [])
    num = lambda a, b: int.from_bytes(d[a:b], "big")
    default: dict[int, int] = {}

    def block(a, b, time, cluster, simple):
        track, at = _vint(d, a, b, False)
        rel, flags = struct.unpack(">hB", d[at : at + 3])
        step = default.get(track, 0)
        for i, (x, y) in enumerate(laces(d, at + 3, b, flags >> 1 & 3)):
            m.packets.append((track, (time + rel) * m.scale + i * step, x, y, cluster, bool(flags & 0x80) if simple else True))

    for kind, a, b in elements(d, 0, len(d)):
        if kind != SEGMENT:
            continue
        clusters = 0
        for k, x, y in elements(d, a, b):
            if k == INFO:
                m.scale = next((num(p, q) for j, p, q in elements(d, x, y) if j == SCALE), m.scale)
            elif k == TRACKS:
                for j, p, q in elements(d, x, y):
                    own = {e: (s, t) for e, s, t in elements(d, p, q)} if j == ENTRY else {}
                    if NUMBER in own:
                        n = num(*own[NUMBER])
                        m.tracks[n] = d[slice(*own[CODEC])].decode("ascii", "replace").rstrip("\0") if CODEC in own else ""
                        if DEFAULT in own:
                            default[n] = num(*own[DEFAULT])
            elif k == CLUSTER:
                time = 0
                for j, p, q in elements(d, x, y):
                    try:
                        if j == TIME:
                            time = num(p, q)
                        elif j == SIMPLE:
                            block(p, q, time, clusters, True)
                        elif j == GROUP:
                            for e, s, t in elements(d, p, q):
                                if e == BLOCK:
                                    block(s, t, time, clusters, False)
                    except (ValueError, IndexError, struct.error):
                        break
                clusters += 1
            elif k == CUES:
                for j, p, q in elements(d, x, y):
                    own = list(elements(d, p, q)) if j == POINT else []
                    time = next((num(s, t) for e, s, t in own if e == CUE_TIME), 0)
                    for e, s, t in own:
                        if e == POSITIONS:
                            pos = {f: num(g, h) for f, g, h in elements(d, s, t)}
                            m.cues.append((time, pos.get(CUE_TRACK, 0), a + pos.get(CUE_CLUSTER, 0)))
    return m


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def feature(samples: bytes, m: Media) -> str:
    s = np.frombuffer(samples, np.uint8)
    total, square = int(s.sum(dtype=np.int64)), int((s.astype(np.int64) ** 2).sum())
    count = np.bincount(s, minlength=256)
    p = count[count > 0] / len(s)
    return f"packets={len(m.packets)};cues={len(m.cues)};ms={len(s) * 1000 // SAMPLES};mean={total / len(s):.4f};rms={(square / len(s)) ** 0.5:.4f};entropy={-(p * np.log2(p)).sum() + 0:.4f};crossings={int(((s[1:] >= 128) != (s[:-1] >= 128)).sum())}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the file) of every text."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n, payload = padded(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([n], pa.int64()), pa.array([mux(payload)], pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.mapped(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """One row for each packet of a (doc_id, media) table."""
    names = ["doc_id", "packet", "track", "codec", "time_ns", "byte_from", "byte_to", "cluster", "keyframe"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m = demux(batch.column(1)[i].as_py() or b"")
                key = batch.column(0)[i].as_py()
                cols = list(zip(*[(key, j, t, m.tracks.get(t), ns, a, b, c, k) for j, (t, ns, a, b, c, k) in enumerate(m.packets)], strict=True)) or [()] * 9
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return common.mapped(media.select("doc_id", "media"), run, "doc_id long, packet long, track long, codec string, time_ns long, byte_from long, byte_to long, cluster long, keyframe boolean")


def op9_matroska(spark, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets"]

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                n, payload = padded(batch.column(1)[i].as_py())
                stored = mux(payload)
                m = demux(stored)
                back = b"".join(stored[a:b] for _, _, a, b, _, _ in m.packets)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, m), len(m.packets)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]], names)

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return common.mapped(docs, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long")
