"""Media columns: documents' bytes carried in MPEG audio files, and a reader of MPEG audio.

A payload is stored losslessly as MPEG-1 Layer III, 48 kHz mono: an ID3v2 tag, a
frame with the variable-bitrate table ("Xing": frame count, byte count, 100 seek
points), then frames of 240 bytes with a header checksum, each with 192 payload
bytes as main data.

The reader takes any MPEG audio (versions 1, 2 and 2.5, layers I to III; free-format
rates aside) and knows nothing of the writer's layout.  It parses ID3v2.2 to 2.4 and
ID3v1 tags, synchronises on frame headers, again after every damaged or foreign stretch,
each time confirmed by a like header behind the frame or by the end, verifies the
checksums of all three layers, parses Xing, Info and VBRI tables and holds them against
the frames, and returns exact durations (samples by rate), frame seek offsets and the
main data.  It never raises: what is wrong is counted or named in a column.

Defined results: a null payload is an empty one, so one unit of padding; equal
payloads give equal files; null or frameless bytes give zero frames; files of other
writers have no payload; further columns stay, and a made column whose name is taken
gets underscores behind its name; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import bounded_batches, column, releasing

UNIT = 192

# Fixed values of the MPEG audio and ID3 formats: kbit/s by (version 1?, layer), Hz by version, samples of a frame.
_KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

# Fixed values of layer II: bits of the allocations by subband, for each of its tables.
_ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}

_HEADER = struct.pack(">I", 0xFFFA64C0)  # version 1, layer III, checksum, 80 kbit/s, 48 kHz, mono
_FRAME = 240
#: Private 9 main-data-begin bits and the rest of the 17 bytes of side information, with 96 bytes a granule.
_SIDE = (int("0" * 9 + "0" * 5 + "0" * 4 + 2 * (f"{96 * 8:012b}" + "0" * 47), 2)).to_bytes(17, "big")


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The header checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


_PLAIN = np.frombuffer(_HEADER + struct.pack(">H", crc16(_HEADER[2:] + _SIDE)) + _SIDE, np.uint8)
_BODY = len(_PLAIN)


def padded(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of UNIT."""
    return data + b" " * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def write_mpeg(payload: bytes) -> bytes:
    """An MPEG audio file that holds a payload of whole units."""
    if len(payload) % UNIT or not payload:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    count = len(payload) // UNIT
    frames = np.zeros((count, _FRAME), np.uint8)
    frames[:, :_BODY] = _PLAIN
    frames[:, _BODY : _BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(count, UNIT)
    size = _FRAME * (count + 1)
    toc = bytes(min(255, (256 * _FRAME * (1 + i * count // 100)) // size) for i in range(100))
    side = bytes(17)
    table = _HEADER + struct.pack(">H", crc16(_HEADER[2:] + side)) + side + struct.pack(">4sIII", b"Xing", 7, count, size) + toc
    body = b"\x03payload-crc32\0" + f"{zlib.crc32(payload):08x}".encode()
    tag = b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\x00\x00" + _syncsafe(len(tag)) + tag + table.ljust(_FRAME, b"\0") + frames.tobytes()


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


class Header(NamedTuple):
    """What a frame header says."""

    size: int
    samples: int
    hertz: int
    layer: int
    version: int
    side: int  # bytes of side information (layer III)
    checked: bool
    channels: int
    bound: int  # subbands below it are coded for each channel (layers I and II)
    table: str  # of layer II


def header_of(head: bytes) -> Header | None:
    """The meaning of four bytes, if they are a frame header."""
    if len(head) < 4 or head[0] != 255 or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or not 0 < rate < 15 or hz == 3:
        return None
    one, mode = version == 3, head[3] >> 6
    kbps, hertz, samples, pad = _KBPS[one, layer][rate], _HZ[version][hz], _SAMPLES[one, layer], head[2] >> 1 & 1
    size = (12_000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    channels = 1 if mode == 3 else 2
    each = kbps // channels
    table = "low" if not one else ("d" if hertz == 32000 else "c") if each < 56 else "b" if each > 80 and hertz != 48000 else "a"
    side = (17 if channels == 1 else 32) if one else (9 if channels == 1 else 17)
    bound = 4 * (head[3] >> 4 & 3) + 4 if mode == 1 else 32
    return Header(size, samples, hertz, layer, version, side, not head[1] & 1, channels, bound, table)


def _covered(data: bytes, at: int, header: Header) -> str:
    """The bits that a frame's checksum covers, from the third header byte on."""
    body = data[at + 6 : at + header.size]
    if header.layer == 3:
        body = body[: header.side]
    bits = f"{int.from_bytes(body[:128]):0{8 * len(body[:128])}b}" if body else ""
    used = 8 * header.side
    if header.layer == 1:
        used = 4 * sum(header.channels if band < header.bound else 1 for band in range(32))
    elif header.layer == 2:
        used = scales = 0
        for band, width in enumerate(_ALLOCATION[header.table]):
            for _ in range(header.channels if band < header.bound else 1):
                # A subband with an allocation has two bits of scale information a channel.
                if "1" in bits[used : used + width]:
                    scales += 2 * (1 if band < header.bound else header.channels)
                used += width
        used += scales
    return f"{int.from_bytes(data[at + 2 : at + 4]):016b}" + bits[:used]


def _crc_of(bits: str) -> int:
    """The checksum of bits, whole bytes at once."""
    whole = len(bits) // 8 * 8
    crc = crc16(int(bits[:whole], 2).to_bytes(whole // 8)) if whole else 0xFFFF
    for bit in bits[whole:]:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
    return crc


def read_mpeg(data: bytes, headers: dict | None = None, crcs: dict | None = None) -> dict:
    """Parse an MPEG audio file.

    Returns tags, table (kind, frames, bytes, seek points) or None, table_agrees, frame
    offsets, samples by hertz, duration_us, checked and bad_checksums, skipped bytes and
    the ranges of the frames' main data.  headers and crcs remember what is known of bytes.
    """
    headers, crcs = {} if headers is None else headers, {} if crcs is None else crcs

    def header_at(at: int) -> Header | None:
        head = data[at : at + 4]
        if head not in headers:
            headers[head] = header_of(head)
        return headers[head]

    at, end, tags = 0, len(data), {}
    while data[at : at + 3] == b"ID3" and end - at >= 10 and max(data[at + 6 : at + 10]) < 128:
        size = _syncsafe_value(data[at + 6 : at + 10])
        tags |= _id3(data[at + 10 : at + 10 + size], data[at + 3], data[at + 5])
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("title", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    offsets, bodies, samples, checked, bad, skipped, table, first, synced = [], [], {}, 0, 0, 0, None, at, False
    while at < end:
        frame = header_at(at)
        if frame is not None and at + frame.size > end:
            frame = None
        if frame is not None and not synced and at + frame.size < end:
            after = header_at(at + frame.size)
            if after is None or (after.version, after.layer, after.hertz) != (frame.version, frame.layer, frame.hertz):
                frame = None
        if frame is None:
            to = data.find(b"\xff", at + 1, end)  # resynchronise
            to = end if to < 0 else to
            skipped, at, synced = skipped + to - at, to, False
            continue
        synced = True
        body = at + 4 + 2 * frame.checked
        if frame.checked:
            # Equal bytes have equal checksums; layer I and II cover at most 128 bytes.
            key = data[at + 1 : at + 4] + data[body : body + (frame.side if frame.layer == 3 else 128)]
            if key not in crcs:
                crcs[key] = _crc_of(_covered(data, at, frame))
            checked += 1
            bad += crcs[key] != data[at + 4] << 8 | data[at + 5]
        if frame.layer == 3:
            body += frame.side
        found = None if offsets or table else _table(data, at, body)
        if found:
            table, first = found, at
        else:
            first = first if offsets or table else at
            offsets.append(at)
            samples[frame.hertz] = samples.get(frame.hertz, 0) + frame.samples
            bodies.append((body, at + frame.size))
        at += frame.size
    stop = bodies[-1][1] if bodies else first
    agrees = None
    if table:
        agrees = table["frames"] in (None, len(offsets)) and table["bytes"] in (None, stop - first)
    duration = sum((Fraction(n * 1_000_000, hz) for hz, n in samples.items()), Fraction(0))
    return {"tags": tags, "table": table, "table_agrees": agrees, "offsets": offsets, "samples": samples, "duration_us": int(duration), "checked": checked, "bad_checksums": bad, "skipped": skipped, "bodies": bodies}


def _syncsafe_value(raw: bytes) -> int:
    return int("".join(f"{b & 127:07b}" for b in raw), 2) if raw else 0


def _text(value: bytes) -> str:
    """The text of an ID3 text frame: an encoding byte, then characters."""
    encoding = {b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(value[:1], "latin-1")
    return value[1:].decode(encoding, "replace").rstrip("\0")


def _id3(tag: bytes, version: int, flags: int) -> dict[str, str]:
    """The text frames of an ID3v2.2, 2.3 or 2.4 tag; TXXX frames by their description, as TXXX:name."""
    tags, at, wide = {}, 0, version >= 3
    number = _syncsafe_value if version >= 4 else int.from_bytes
    if flags & 0x80 and version < 4:
        tag = tag.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and wide:
        at = number(tag[:4]) + (0 if version >= 4 else 4)
    name_size, head = (4, 10) if wide else (3, 6)
    while at + head <= len(tag) and tag[at : at + 1] != b"\0":
        name, size = tag[at : at + name_size].decode("latin-1"), number(tag[at + name_size : at + 2 * name_size])
        value = tag[at + head : at + head + size]
        if version >= 4 and (flags & 0x80 or tag[at + 9] & 2):
            value = value.replace(b"\xff\0", b"\xff")
        if name in ("TXXX", "TXX"):
            label, _, text = _text(value).partition("\0")
            tags[f"TXXX:{label}"] = text.lstrip("\ufeff")
        elif name[:1] == "T":
            tags[name] = _text(value)
        at += head + size
    return tags


def _table(data: bytes, frame: int, body: int) -> dict | None:
    """A frame's variable-bitrate table: Xing or Info behind the side information, VBRI 32 bytes behind the header."""
    kind, table = data[body : body + 4], {"frames": None, "bytes": None, "toc": b""}
    if kind in (b"Xing", b"Info"):
        flags, at = int.from_bytes(data[body + 4 : body + 8]), body + 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
            if flags & bit:
                table[name] = data[at : at + size] if name == "toc" else int.from_bytes(data[at : at + size])
                at += size
        return {"kind": kind.decode(), **table}
    if data[frame + 36 : frame + 40] == b"VBRI":
        size, frames, entries, _, width = struct.unpack(">IIHHH", data[frame + 46 : frame + 60].ljust(14, b"\0"))
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": data[frame + 62 : frame + 62 + entries * width]}
    return None


def payload_of(data: bytes, parsed: dict) -> tuple[bytes | None, str | None]:
    """(payload, error) of a file made by write_mpeg, checked against its tag; (None, None) for others."""
    want = parsed["tags"].get("TXXX:payload-crc32")
    if want is None:
        return None, None
    if parsed["bad_checksums"]:
        return None, "a frame's checksum is wrong"
    payload = b"".join([data[a : a + UNIT] for a, _ in parsed["bodies"]])
    return (payload, None) if f"{zlib.crc32(payload):08x}" == want else (None, "the payload's checksum is wrong")


def _free(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """Names with underscores behind them until none is taken, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def encode_audio(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Replace the text by a binary column with its MPEG file; the other columns stay."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]
    own = docs.select(*map(column, kept))
    (name,) = _free([media_col], kept)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(0).cast(pa.binary()).to_pylist()
            media = pa.array([write_mpeg(padded(p or b"")) for p in payloads], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], media], names=[*kept, name])

    schema = ", ".join(filter(None, (_schema(own), f"`{name}` binary")))
    return docs.select(column(text_col).cast("string").alias(_free(["payload"], kept)[0]), *map(column, kept)).mapInArrow(releasing(encoded), schema)


#: What decode_audio adds, with types.
AUDIO = (
    ("payload", "binary", pa.binary()),
    ("error", "string", pa.string()),
    ("n_frames", "long", pa.int64()),
    ("n_samples", "long", pa.int64()),
    ("hertz", "int", pa.int32()),
    ("duration_us", "long", pa.int64()),
    ("seek_offsets", "array<long>", pa.list_(pa.int64())),
    ("n_checked", "long", pa.int64()),
    ("bad_checksums", "long", pa.int64()),
    ("skipped_bytes", "long", pa.int64()),
    ("table_agrees", "boolean", pa.bool_()),
    ("tags", "map<string,string>", pa.map_(pa.string(), pa.string())),
)


def decode_audio(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Add the columns of AUDIO to rows with MPEG files.

    hertz is null if rates differ; duration_us is exact to the microsecond below;
    seek_offsets has a byte offset for each frame; n_checked and bad_checksums count frames
    with checksums and with wrong ones; table_agrees is null without a table; payload and
    error say what a file of this writer holds, or why it can't be read.
    """
    bounded_batches(media.sparkSession)
    own, place = media.columns, media.columns.index(media_col)
    made = _free([name for name, _, _ in AUDIO], own)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers: dict = {}
        crcs: dict = {}
        for batch in batches:
            rows = []
            for data in batch.column(place).to_pylist():
                data = data or b""
                p = read_mpeg(data, headers, crcs)
                if len(crcs) > 100_000:
                    crcs.clear()
                payload, error = payload_of(data, p)
                hertz = next(iter(p["samples"])) if len(p["samples"]) == 1 else None
                rows.append((payload, error, len(p["offsets"]), sum(p["samples"].values()), hertz, p["duration_us"], p["offsets"], p["checked"], p["bad_checksums"], p["skipped"], p["table_agrees"], list(p["tags"].items())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(AUDIO)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, (_, _, t) in zip(columns, AUDIO, strict=True)]], names=[*own, *made])

    schema = ", ".join([_schema(media), *[f"`{name}` {kind}" for name, (_, kind, _) in zip(made, AUDIO, strict=True)]])
    return media.mapInArrow(releasing(decoded), schema)
