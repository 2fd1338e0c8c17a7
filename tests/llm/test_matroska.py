import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import matroska as mk


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=300), st.integers(0, 300_000).map(lambda n: "aé" * (n // 3))))
def test_round_trip(text):
    n, payload = mk.padded(text)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload[:n].decode() == text and not payload[n:].strip(b"\0")
    stored = mk.mux(payload)
    m = mk.demux(stored)
    assert b"".join(stored[a:b] for _, _, a, b, _, _ in m.packets) == payload
    assert m.tracks == {1: "A_PCM/INT/LIT"} and all(p[0] == 1 for p in m.packets)
    assert [p[1] for p in m.packets] == sorted(p[1] for p in m.packets)
    for time, track, at in m.cues:
        assert stored[at : at + 4] == mk.CLUSTER.to_bytes(4, "big") and track == 1


def test_every_lacing():
    frames = [bytes([i]) * n for i, n in enumerate([300, 5, 255, 1000, 7])]
    body = b"".join(frames)
    xiph = bytes([4]) + b"\xff\x2d" + b"\x05" + b"\xff\x00" + b"\xff" * 3 + bytes([1000 - 765])
    steps, sizes = mk.vint(300), [300, 5, 255, 1000]
    for a, b in zip(sizes, sizes[1:]):
        steps += mk.vint(b - a + 8191, 2)
    for mode, lace in ((1, xiph), (3, bytes([4]) + steps)):
        d = lace + body
        assert [d[a:b] for a, b in mk.laces(d, 0, len(d), mode)] == frames
    d = bytes([3]) + b"abcdefgh"
    assert [d[a:b] for a, b in mk.laces(d, 0, 9, 2)] == [b"ab", b"cd", b"ef", b"gh"]


def test_unknown_sizes_groups_and_cut_files():
    block = mk.vint(2) + b"\x00\x05\x00" + b"data"
    cluster = lambda t, x: mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.uint(mk.TIME, t) + x
    entry = mk.element(mk.ENTRY, mk.uint(mk.NUMBER, 2) + mk.element(mk.CODEC, b"X") + mk.uint(mk.DEFAULT, 3))
    body = mk.element(mk.INFO, mk.uint(mk.SCALE, 10)) + mk.element(mk.TRACKS, entry) + cluster(7, mk.element(mk.GROUP, mk.element(mk.BLOCK, block))) + cluster(9, mk.element(0xEC, b"void") + mk.element(mk.SIMPLE, block))
    d = mk.element(mk.EBML, b"") + mk.SEGMENT.to_bytes(4, "big") + b"\xff" + body
    m = mk.demux(d)
    assert m.scale == 10 and m.tracks == {2: "X"}
    assert [(p[1], d[p[2] : p[3]], p[4]) for p in m.packets] == [(120, b"data", 0), (140, b"data", 1)]
    for n in range(len(d)):
        mk.demux(d[:n])
    assert mk.demux(b"").packets == [] and mk.demux(b"\0junk").packets == []


def test_query(spark, tmp_path):
    rows = [(1, "héllo", "x"), (2, None, "x"), (3, "", "x"), (None, "a" * 64, "x"), (4, "z" * 500_000, "x"), (5, "héllo", None)]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in mk.op9_matroska(spark, str(tmp_path)).collect()}
    for key, text, _ in rows:
        raw = (text or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = got[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert got[1][1:] == got[5][1:]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    table = mk.packets(mk.to_media(docs))
    assert table.where("doc_id = 4").selectExpr("sum(byte_to - byte_from)").first()[0] == -(-500_000 // 64) * 64
    assert mk.packets(mk.to_media(docs.limit(0))).count() == 0
