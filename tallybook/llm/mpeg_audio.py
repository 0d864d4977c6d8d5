"""MPEG audio columns: pack bytes into silent Layer III frames, and read any MPEG audio stream's structure."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import besides, id_and_text, quoted, schema_of, unused

# Fixed values of the MPEG audio format: bit rates in kbit/s by (version 1, layer) and (version 2 and 2.5, layer), for
# header indices 1 to 14; sampling rates in Hz by version; samples in a frame.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {3: 1.0, 2: 2.0, 0: 2.5}
LAYERS = {3: 1, 2: 2, 1: 3}

# Fixed values of Layer II: subbands and widths of their bit allocations in runs of (subbands, bits), by table; MPEG-1
# tables by sampling rate and bit rate of a channel, and the one of MPEG-2.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}

#: What the writer makes: MPEG-1 Layer III, 32 kHz, mono, with checksums. Header, checksum and side information lead.
WRITE_RATE, SIDE_INFO, LEAD = 32000, bytes(17), 4 + 2 + 17
BLOCK = 64


@dataclass(frozen=True)
class Frame:
    """One frame header, decoded."""

    version: float
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    joint: int | None = None

    @property
    def side_info(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1.0 else (9 if self.mono else 17)


@lru_cache(4096)
def frame_of(head: bytes) -> Frame | None:
    """The frame that a 4-byte header announces, or None if it is no valid header. Free-format streams are not read."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(head[1] >> 3 & 3), LAYERS.get(head[1] >> 1 & 3)
    rate_at, grade, padded = head[2] >> 2 & 3, head[2] >> 4, head[2] >> 1 & 1
    if version is None or layer is None or rate_at == 3 or not 1 <= grade <= 14:
        return None
    kbps, rate = BITRATES[1 if version == 1.0 else 2, layer][grade - 1], RATES[version][rate_at]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1.0 else 576
    size = (12000 * kbps // rate + padded) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + padded
    joint = (head[3] >> 4 & 3) * 4 + 4 if head[3] >> 6 == 1 else None  # the subband from which channels share allocations
    return Frame(version, layer, not head[1] & 1, kbps, rate, head[3] >> 6 == 3, size, samples, joint)


@lru_cache(4096)
def checksum(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def checksum_of_bits(data: bytes, bits: int) -> int:
    """The same of the first so many bits of data."""
    whole, rest = divmod(bits, 8)
    crc = checksum(data[:whole])
    for i in range(rest):
        crc ^= (data[whole] >> (7 - i) & 1) << 15
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def allocation_widths(frame: Frame) -> list[int]:
    """Bits of the allocation of each subband."""
    if frame.layer == 1:
        return [4] * 32
    each = frame.kbps if frame.mono else frame.kbps // 2
    if frame.version != 1.0:
        table = "lsf"
    elif each <= 48:
        table = "d" if frame.rate == 32000 else "c"
    else:
        table = "a" if frame.rate == 48000 or each <= 80 else "b"
    return [bits for n, bits in ALLOCATIONS[table] for _ in range(n)]


def protected_bits(frame: Frame, body: bytes) -> int:
    """How many bits of a frame's body its checksum covers: side information, or allocations and, of Layer II, the
    two bits for each allocation that is not zero that tell which scale factors follow."""
    if frame.layer == 3:
        return 8 * frame.side_info
    bits, used, at = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
    for subband, width in enumerate(allocation_widths(frame)):
        shared = frame.joint is not None and subband >= frame.joint
        for _ in range(1 if frame.mono or shared else 2):
            filled = bits >> (512 - at - width) & ((1 << width) - 1)
            used += bool(filled) * (2 if shared else 1)
            at += width
    return at + (2 * used if frame.layer == 2 else 0)


@lru_cache(64)
def lead_of(grade: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of the writer's frames of a bit-rate index, and their size."""
    head = bytes((0xFF, 0xFA, grade << 4 | 2 << 2, 0xC0))
    return head + struct.pack(">H", checksum(head[2:] + SIDE_INFO)) + SIDE_INFO, frame_of(head).size


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """Carry payload in the ancillary bytes of silent frames, behind a length tag and a table of seek points.

    Full frames use the largest bit rate; the last takes the smallest that holds the rest, so the bit rate varies and
    a Xing table describes the stream. Every frame has its checksum.
    """
    lead, size = lead_of(14)
    room = size - LEAD
    cut = len(payload) // room * room
    frames = [lead + payload[i : i + room] for i in range(0, cut, room)]
    if rest := payload[cut:]:
        lead, size = next((x for g in range(1, 15) if (x := lead_of(g))[1] - LEAD >= len(rest)))
        frames.append(lead + rest + bytes(size - LEAD - len(rest)))
    starts, at = [], 0
    for frame in frames:
        starts.append(at)
        at += len(frame)
    table_lead, table_size = next(x for g in range(1, 15) if (x := lead_of(g))[1] - LEAD >= 120)
    total = table_size + at
    toc = bytes(min(255, (table_size + starts[min(len(frames) - 1, p * len(frames) // 100)]) * 256 // total) for p in range(100)) if frames else bytes(100)
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    table = table_lead + xing + bytes(table_size - len(table_lead) - len(xing))
    text = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + syncsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + syncsafe(len(tag)) + tag + table + b"".join(frames)


@dataclass
class Stream:
    """What read_stream finds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: Table | None = None
    frames: int = 0
    samples: int = 0
    rate: int = 0
    layer: int = 0
    kbps: dict[int, int] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sound: int = 0
    damaged: int = 0
    skipped: int = 0
    payload: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def read_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text frames of an ID3v2 tag in front and of an ID3v1 tag behind; where audio starts and ends."""
    tags, start, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
        start, at, major = min(end, 10 + size), 10, data[3]
        while major >= 3 and at + 10 <= start and data[at : at + 1].isalnum():
            name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
            n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major >= 4 else int.from_bytes(raw, "big")
            body = data[at + 10 : min(start, at + 10 + n)]
            if name[0] == "T" and body:
                value = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = value.partition("\0") if name == "TXXX" else (name, "", value)
                tags[key] = value.strip("\0")
            at += 10 + n
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip())
    return tags, start, end


@dataclass
class Table:
    """A table of a variable-bit-rate stream: frames and bytes that it announces, and its seek points as byte offsets
    from its own frame."""

    frames: int | None = None
    bytes: int | None = None
    seek: list[int] = field(default_factory=list)


def read_table(data: bytes, at: int, frame: Frame) -> Table | None:
    """The Xing, Info or VBRI table of a frame; None if it has none."""
    x = at + 4 + 2 * frame.checked + frame.side_info
    if data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= len(data):
        flags, x, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, Table()
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and x + 4 <= len(data):
                setattr(out, name, int.from_bytes(data[x : x + 4], "big"))
                x += 4
        if flags & 4 and out.bytes is not None:
            out.seek = [point * out.bytes // 256 for point in data[x : x + 100]]
        return out
    x = at + 4 + 32
    if data[x : x + 4] == b"VBRI" and x + 26 <= len(data):
        count, scale, width = (int.from_bytes(data[x + i : x + i + 2], "big") for i in (18, 20, 22))
        entries = [int.from_bytes(data[i : i + width], "big") * scale for i in range(x + 26, min(len(data), x + 26 + count * width), width)] if width else []
        return Table(int.from_bytes(data[x + 14 : x + 18], "big"), int.from_bytes(data[x + 10 : x + 14], "big"), list(accumulate(entries)))
    return None


def read_stream(data: bytes | None) -> Stream:
    """Read tags, tables, frames and ancillary bytes of a stream that may be damaged.

    A header counts if the next frame's header, or the end of the audio, follows where it says; otherwise the reader
    moves on by one byte at a time until it is in step again. A truncated last frame counts as skipped bytes. Checksums
    of all three layers are verified.
    """
    data = data or b""
    out, parts = Stream(), []
    out.tags, at, end = read_tags(data)
    in_step, first = False, True
    while at + 4 <= end:
        frame = frame_of(data[at : at + 4])
        stop = at + frame.size if frame else 0
        if not frame or frame.size < 8 or stop > end or not (in_step or stop == end or frame_of(data[stop : stop + 4])):
            in_step, found = False, data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        in_step, lead = True, at + 4 + 2 * frame.checked
        if frame.checked:
            body = data[lead : min(stop, lead + 64)]
            bits = protected_bits(frame, body)
            fine = checksum_of_bits(data[at + 2 : at + 4] + body[: -(-bits // 8)].ljust(-(-bits // 8), b"\0"), 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.sound, out.damaged = out.sound + fine, out.damaged + (not fine)
        if first and (table := read_table(data, at, frame)):
            out.table = table
        else:
            out.frames, out.samples = out.frames + 1, out.samples + frame.samples
            out.rate, out.layer = out.rate or frame.rate, out.layer or frame.layer
            out.kbps[frame.kbps] = out.kbps.get(frame.kbps, 0) + 1
            out.offsets.append(at)
            parts.append(data[lead + frame.side_info : stop])
        first, at = False, stop
    out.skipped += max(0, end - at)
    body, size = b"".join(parts), out.tags.get("payload_bytes", "")
    out.payload = body[: int(size)] if size.isdecimal() else body
    return out


def padded(text: bytes) -> bytes:
    """text and zeros up to a positive multiple of 64 bytes."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def store_as_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text) and media: the text's padded bytes as an MPEG audio stream.

    Null texts count as empty and give one block of zeros. Rows are independent, so repeated rows, null ids and
    empty tables need no care; no shuffle takes place.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 256):
            texts = [x.encode() for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(x) for x in texts], pa.int64()), pa.array([write_stream(padded(x)) for x in texts], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(write, "doc_id long, n_bytes long, media binary")


AUDIO = "tags map<string,string>, table_frames long, table_bytes long, table_seek array<long>, frames long, samples long, rate long, layer long, seconds double, kbps map<long,long>, offsets array<long>, sound long, damaged long, skipped long, payload binary"


def read_audio(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of media and `audio`, a struct of what its streams hold.

    tags, the variable-bit-rate table with its seek points, frames, samples, exact seconds (samples / rate), frames by bit
    rate, byte offsets of the frames for seeking, checksums that hold or fail, skipped bytes, and the ancillary bytes.
    Null and empty media give zero frames.
    """
    kind = pa.struct([("tags", pa.map_(pa.string(), pa.string())), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("table_seek", pa.list_(pa.int64())), ("frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int64()), ("layer", pa.int64()), ("seconds", pa.float64()), ("kbps", pa.map_(pa.int64(), pa.int64())), ("offsets", pa.list_(pa.int64())), ("sound", pa.int64()), ("damaged", pa.int64()), ("skipped", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 256):
            found = [
                {"tags": list(s.tags.items()), "table_frames": s.table and s.table.frames, "table_bytes": s.table and s.table.bytes, "table_seek": s.table.seek if s.table else [], "frames": s.frames, "samples": s.samples, "rate": s.rate, "layer": s.layer, "seconds": s.seconds, "kbps": sorted(s.kbps.items()), "offsets": s.offsets, "sound": s.sound, "damaged": s.damaged, "skipped": s.skipped, "payload": s.payload}
                for s in map(read_stream, batch.column(batch.num_columns - 1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], [*kept, "audio"])

    kept, (column,) = besides(media, "audio"), unused(media, "stream")
    rows = media.select(*quoted(kept), F.col(media_col).alias(column))
    return rows.mapInArrow(read, ", ".join(filter(None, [schema_of(media, kept), f"audio struct<{AUDIO.replace(' ', ':').replace(',:', ',')}>"])))
