"""MPEG audio columns: payload bytes in MPEG-1 Layer III frames, and a reader that resynchronises.

The reader knows MPEG-1, 2 and 2.5, Layers I to III, ID3v2 and ID3v1 tags, and Xing, Info and VBRI tables, which it compares
with the frames that it finds.  Frame checksums are verified for Layer III; the other layers' cover data that only
a decoder can tell apart.  The stored form is an ID3v2.3 tag (extended header with CRC-32), a variable-bitrate table frame (frame and byte
counts, a seek table of 100 entries) and frames with CRC-16.  Side information is all zero (silence), so a
frame's whole main-data area is ancillary data, which holds the payload.  Frames have the largest size but the
last, which has the smallest that fits; at 48 kHz every frame is 24 ms and its length is exact, without padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BLOCK = 64
# Fixed values of MPEG audio: kbit/s by bitrate index of MPEG-1 Layers I, II and III and of MPEG-2 Layer I and Layers II and III,
# Hz of MPEG-1 by sampling-rate index (halved and quartered for MPEG-2 and 2.5), samples a frame, bytes of side information.
KBPS_1_1 = (None, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, None)
KBPS_1_2 = (None, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, None)
KBPS = (None, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, None)
KBPS_2_1 = (None, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, None)
KBPS_2_23 = (None, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, None)
RATES = (44100, 48000, 32000, None)
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
SIDE = {(1, True): 17, (1, False): 32, (2, True): 9, (2, False): 17}
TABLE_KBPS = 64
SIDE_MONO = SIDE[1, True]
VBRI_AT = 36


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    kbps: int
    rate: int
    samples: int
    length: int
    side: int
    protected: bool

    @property
    def data_at(self) -> int:
        return 4 + 2 * self.protected + self.side


@lru_cache(4096)
def parse_header(head: bytes) -> Header | None:
    """A frame header, or None if the four bytes are none; free-format frames, whose length is not told, are none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 2.5}.get(head[1] >> 3 & 3)
    layer = 4 - (head[1] >> 1 & 3)
    if version is None or layer == 4:
        return None
    family = 1 if version == 1 else 2
    table = {(1, 1): KBPS_1_1, (1, 2): KBPS_1_2, (1, 3): KBPS, (2, 1): KBPS_2_1}.get((family, layer), KBPS_2_23)
    kbps, rate = table[head[2] >> 4], RATES[head[2] >> 2 & 3]
    if kbps is None or rate is None or head[3] & 3 == 2:
        return None
    rate = rate // {1: 1, 2: 2, 2.5: 4}[version]
    samples, padding = SAMPLES[family, layer], head[2] >> 1 & 1
    length = 4 * (12_000 * kbps // rate + padding) if layer == 1 else samples * 125 * kbps // rate + padding
    return Header(version, layer, kbps, rate, samples, length, SIDE[family, head[3] >> 6 == 3] if layer == 3 else 0, not head[1] & 1)


@lru_cache(64)
def frame_start(kbps: int) -> bytes:
    """Header, checksum and silent side information of a protected mono frame at 48 kHz."""
    head = bytes((0xFF, 0xFA, KBPS.index(kbps) << 4 | RATES.index(48000) << 2, 0xC4))
    side = bytes(SIDE_MONO)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


@lru_cache(64)
def capacity(kbps: int) -> int:
    return 144_000 * kbps // 48000 - len(frame_start(kbps))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x00" + name.encode() + b"\x00" + value.encode()
    return b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body


def encode(payload: bytes) -> bytes:
    """The stored form of a payload; the same bytes give the same file."""
    frames, largest = [], KBPS[14]
    room = capacity(largest)
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        kbps = next(k for k in KBPS[1:15] if capacity(k) >= len(part))
        frames.append(frame_start(kbps) + part + bytes(capacity(kbps) - len(part)))
    tags = _text_frame("payload_bytes", str(len(payload))) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    extended = (10).to_bytes(4, "big") + b"\x80\x00" + bytes(4) + zlib.crc32(tags).to_bytes(4, "big")
    body = extended + tags
    audio, table_bytes = b"".join(frames), 144_000 * TABLE_KBPS // 48000
    total, n = table_bytes + len(audio), len(frames)
    step = len(frames[0]) if frames else 0
    toc = bytes(min(255, 256 * (table_bytes + step * (i * n // 100)) // total) for i in range(100))
    table = b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + bytes(4)
    table = frame_start(TABLE_KBPS) + table
    return b"ID3\x03\x00\x40" + _syncsafe(len(body)) + body + table + bytes(table_bytes - len(table)) + audio


@dataclass
class Table:
    """A variable-bitrate table: where its frame starts, frames and bytes that it claims, and places in bytes from there."""

    at: int
    frames: int | None = None
    bytes: int | None = None
    places: list[tuple[int, int]] = field(default_factory=list)  # (frame, byte)
    slack: int = 0

    def agrees(self, offsets: list[int], end: int) -> bool:
        """Whether the claims hold for the frames found; places may be off by ``slack`` bytes or up to one frame."""
        if self.frames not in (None, len(offsets)) or self.bytes not in (None, end - self.at):
            return False
        for frame, place in self.places:
            if frame < len(offsets):
                low = offsets[max(0, frame - 1)] - self.at - self.slack
                high = (offsets[frame + 1] if frame + 1 < len(offsets) else end) - self.at + self.slack
                if not low <= place <= high:
                    return False
        return True


def _read_table(data: bytes, at: int, head: Header) -> Table | None:
    """The Xing, Info or VBRI table in the frame at ``at``, if it holds one."""
    x, stop = at + head.data_at, at + head.length
    number = lambda p, n=4: int.from_bytes(data[p : p + n], "big")
    if data[x : x + 4] in (b"Xing", b"Info"):
        table, flags, p = Table(at), number(x + 4), x + 8
        if flags & 1:
            table.frames, p = number(p), p + 4
        if flags & 2:
            table.bytes, p = number(p), p + 4
        if flags & 4 and table.frames and table.bytes and p + 100 <= stop:
            table.places = [(i * table.frames // 100, data[p + i] * table.bytes // 256) for i in range(100) if data[p + i] < 255]
            table.slack = table.bytes // 256 + 1
        return table
    x = at + VBRI_AT
    if data[x : x + 4] == b"VBRI" and x + 26 <= stop:
        table = Table(at, number(x + 14), number(x + 10))
        entries, scale, width, each = (number(x + 18 + 2 * i, 2) for i in range(4))
        place = head.length
        for i in range(min(entries, (stop - x - 26) // max(1, width))):
            table.places.append((i * each, place))
            place += scale * number(x + 26 + i * width, width)
        table.slack = scale
        return table
    return None


@dataclass
class Audio:
    payload: bytes = b""
    frames: int = 0
    samples: int = 0
    rate: int = 0
    version: float = 0
    layer: int = 0
    seek_offsets: list[int] = field(default_factory=list)
    kbps: dict[int, int] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    table: Table | None = None
    table_ok: bool = False
    skipped: int = 0
    bad_crc: int = 0
    tag_ok: bool = False
    payload_ok: bool = False

    @property
    def duration_us(self) -> int:
        """Rounded down; samples / rate seconds are exact."""
        return self.samples * 1_000_000 // self.rate if self.rate else 0

    @property
    def intact(self) -> bool:
        return self.tag_ok and self.payload_ok and not self.bad_crc and (self.table is None or self.table_ok)

    def feature(self) -> str:
        rates = ";".join(f"{k}x{n}" for k, n in sorted(self.kbps.items()))
        seek = zlib.crc32(",".join(map(str, self.seek_offsets)).encode())
        checks = f"tag={int(self.tag_ok)},table={int(self.table_ok)},crc={self.bad_crc},payload={int(self.payload_ok)},skipped={self.skipped}"
        return f"mpeg{self.version:g}-l{self.layer} rate={self.rate} frames={self.frames} samples={self.samples} us={self.duration_us} kbps={rates} seek={seek:08x} {checks}"


def _read_tag(data: bytes, audio: Audio) -> int:
    """Parse an ID3v2 tag at the start; return where the audio starts."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = sum((data[6 + i] & 0x7F) << s for i, s in enumerate((21, 14, 7, 0)))
    at, end = 10, min(len(data), 10 + size)
    expected = None
    if data[5] & 0x40 and at + 4 <= end:
        length = int.from_bytes(data[at : at + 4], "big")
        if length >= 10:
            expected = int.from_bytes(data[at + 10 : at + 14], "big")
        at += 4 + length
    frames = data[at:end]
    audio.tag_ok = expected is not None and zlib.crc32(frames) == expected
    while at + 10 <= end and data[at : at + 4].isalnum():
        n = int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if data[at : at + 4] == b"TXXX" and body:
            name, _, value = body[1:].partition(b"\x00")
            audio.tags[name.decode("latin-1")] = value.decode("latin-1")
        at += 10 + n
    return end


def decode(data: bytes) -> Audio:
    """Read a stored form back, skipping bytes that belong to no frame.

    A frame counts if its header is valid and its checksum is right, or another valid header or the end follows it.
    Layer III frames with a wrong checksum are counted in ``bad_crc``; their data stay.  Rate, version and layer are the last
    frame's.  Broken input gives what can be read, never an error.
    """
    audio, end = Audio(), len(data)
    at, parts = _read_tag(data, audio), []
    stop = at
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        after = at + head.length if head else 0
        begin = at + head.data_at if head else 0
        checkable = head is not None and head.protected and head.layer == 3
        checked = checkable and crc16(data[at + 2 : at + 4] + data[begin - head.side : begin]) == int.from_bytes(data[at + 4 : at + 6], "big")
        if head is None or after > end or not checked and after + 4 <= end and parse_header(data[after : after + 4]) is None and data[after : after + 3] != b"TAG":
            if data[at : at + 3] == b"TAG" and at + 128 == end:
                for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
                    audio.tags.setdefault(name, data[at + a : at + b].split(b"\x00")[0].decode("latin-1").rstrip())
                at = end
                break
            found = min((p for p in (data.find(b"\xff", at + 1), end - 128 if at < end - 128 and data[end - 128 : end - 125] == b"TAG" else -1) if p > at), default=end)
            audio.skipped += found - at
            at = found
            continue
        audio.bad_crc += checkable and not checked
        table = _read_table(data, at, head) if not audio.frames and audio.table is None else None
        if table is not None:
            audio.table = table
        else:
            audio.frames += 1
            audio.samples += head.samples
            audio.rate, audio.version, audio.layer = head.rate, head.version, head.layer
            audio.seek_offsets.append(at)
            audio.kbps[head.kbps] = audio.kbps.get(head.kbps, 0) + 1
            parts.append(data[begin:after])
        at = stop = after
    audio.skipped += end - at
    audio.table_ok = audio.table is not None and audio.table.agrees(audio.seek_offsets, stop)
    payload, n = b"".join(parts), audio.tags.get("payload_bytes", "")
    audio.payload = payload[: int(n)] if n.isdigit() else payload
    audio.payload_ok = f"{zlib.crc32(audio.payload):08x}" == audio.tags.get("payload_crc32")
    return audio


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text (null: empty) and zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % BLOCK if data else BLOCK)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (without padding) and media, the stored form of each whole text (null: empty).

    Row by row: repeated rows and ties stay, no rows give no rows, other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([encode(p) for _, p in got], pa.binary())], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with what is read back from the stored bytes.

    Adds payload, feature, n_frames, n_samples and sample_rate (n_samples / sample_rate seconds are the exact duration),
    duration_us (exact at 48 kHz, else rounded down), seek_offsets (of every audio frame) and intact (tag, table,
    checksums and payload agree).  A null media gives an empty payload.
    """
    fields = [("payload", pa.binary()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("sample_rate", pa.int64()), ("duration_us", pa.int64()), ("seek_offsets", pa.list_(pa.int64())), ("intact", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a.payload, a.feature(), a.frames, a.samples, a.rate, a.duration_us, a.seek_offsets, a.intact) for a in (decode(m or b"") for m in batch.column(2).to_pylist())]
            arrays = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(n for n, _ in fields)])

    schema = "doc_id long, n_bytes long, media binary, payload binary, feature string, n_frames long, n_samples long, sample_rate long, duration_us long, seek_offsets array<long>, intact boolean"
    return map_batches(media.select("doc_id", "n_bytes", "media"), run, schema)
