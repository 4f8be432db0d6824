import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tavola.llm import mpeg


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.sampled_from([b"", b"\xff\xfa\xe4\xc4" * 300, b"\xff" * 2000, b"Xing" * 64, b"ID3" * 50])))
def test_round_trip(data):
    media = mpeg.encode(data)
    a = mpeg.decode(media)
    assert a.payload == data and a.payload_ok and a.tag_ok and not a.bad_crc and not a.skipped
    assert a.table.frames == a.frames == len(a.seek_offsets) and a.table_ok and a.intact and bool(a.table.places) == bool(data)
    assert all(media[o] == 0xFF for o in a.seek_offsets) and a.duration_us == 24_000 * a.frames


def test_crc16_known_value():
    assert mpeg.crc16(b"123456789") == 0xAEE7  # polynomial 0x8005, start 0xFFFF, not reflected


def test_headers():
    h = mpeg.parse_header(bytes.fromhex("fffbe064"))
    assert (h.kbps, h.rate, h.length, h.side, h.protected) == (320, 44100, 1044, 32, False)
    assert mpeg.parse_header(b"\xff\xfb\xf0\x64") is None and mpeg.parse_header(b"\xff\xeb\x90\x64") is None and mpeg.parse_header(b"\xff") is None
    known = {  # bytes: version, layer, kbit/s, Hz, samples, bytes
        "fffd9004": (1, 2, 160, 44100, 1152, 522), "ffff9004": (1, 1, 288, 44100, 384, 312), "fff390c4": (2, 3, 80, 22050, 576, 261),
        "ffe390c4": (2.5, 3, 80, 11025, 576, 522), "fff5a4c4": (2, 2, 96, 24000, 1152, 576), "fff7a4c4": (2, 1, 160, 24000, 384, 320),
    }
    for head, want in known.items():
        h = mpeg.parse_header(bytes.fromhex(head))
        assert (h.version, h.layer, h.kbps, h.rate, h.samples, h.length) == want, head


def test_other_layers_and_tags():
    for head in ("fffd9004", "ffff9004", "fff390c4", "ffe390c4", "fff5a4c4"):
        h = mpeg.parse_header(bytes.fromhex(head))
        frame = bytes.fromhex(head) + bytes(h.length - 4)
        tag = b"TAG" + b"a title".ljust(30, b"\x00") + bytes(95)
        a = mpeg.decode(b"junk" + frame * 5 + tag)
        assert (a.frames, a.samples, a.rate, a.skipped, a.tags["title"]) == (5, 5 * h.samples, h.rate, 4, "a title"), head
        assert a.seek_offsets == [4 + i * h.length for i in range(5)]


def test_tables_are_compared_with_the_frames():
    media = mpeg.encode(bytes(range(256)) * 40)
    at = media.index(b"Xing")
    assert mpeg.decode(media).intact
    for place, value in ((at + 11, 99), (at + 15, 1), (at + 16 + 50, 3)):
        wrong = bytearray(media)
        wrong[place] = value
        assert not mpeg.decode(bytes(wrong)).table_ok and not mpeg.decode(bytes(wrong)).intact
    head = bytes.fromhex("fffb9064")
    frame = head + bytes(mpeg.parse_header(head).length - 4)
    n, size = 40, len(frame)

    def vbri(frames, each):
        body = b"VBRI" + bytes(6) + ((n + 1) * size).to_bytes(4, "big") + frames.to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (4, 1, 2, each)) + (10 * size).to_bytes(2, "big") * 4
        return (head + bytes(32) + body).ljust(size, b"\x00") + frame * n

    assert mpeg.decode(vbri(n, 10)).table_ok and mpeg.decode(vbri(n, 10)).frames == n
    assert not mpeg.decode(vbri(n + 1, 10)).table_ok and not mpeg.decode(vbri(n, 20)).table_ok


def test_resynchronises():
    rng = random.Random(1)
    data = rng.randbytes(5000)
    media = mpeg.encode(data)
    clean = mpeg.decode(media)
    at = clean.seek_offsets[2]
    junk = b"\xff\xfb\x00" + bytes(50) + b"\xff\xe0\xff"
    dirty = mpeg.decode(media[:at] + junk + media[at:] + b"tail")
    assert dirty.frames == clean.frames and dirty.payload == data and dirty.skipped == len(junk) + 4
    broken = bytearray(media)
    broken[at + 8] ^= 1
    assert mpeg.decode(bytes(broken)).bad_crc == 1
    broken = bytearray(media)
    broken[at + 100] ^= 1
    assert not mpeg.decode(bytes(broken)).payload_ok
    for cut in range(0, len(media), 97):
        mpeg.decode(media[:cut])
    for _ in range(200):
        mpeg.decode(rng.randbytes(400))
    assert mpeg.decode(b"").payload == b""


def test_media_column(spark, tmp_path):
    from tavola.llm.queries import op9_mpeg

    texts = ["", None, "a" * 64, "é" * 40, "x" * 200_000, "a" * 64, "word " * 50]
    spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, "a", "m")], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op9_mpeg(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = mpeg.encode(payload)
        a = mpeg.decode(media)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), a.feature())
        assert (r.n_frames, r.n_samples, r.sample_rate, r.seek_offsets, r.intact) == (a.frames, 1152 * a.frames, 48000, a.seek_offsets, True)
    assert len(rows) == 8 and rows[2][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:]
    assert op9_mpeg(spark, str(tmp_path)).limit(0).collect() == []
    whole = mpeg.read_media(mpeg.media_column(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    assert all(r.intact and len(r.seek_offsets) == r.n_frames for r in whole.collect())
