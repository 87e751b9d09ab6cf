import hashlib
import os
import random
import struct
import zlib

import pytest

from tidemark.llm.media import crc16, decode_audio, encode_audio, header_of, padded, payload_of, read_mpeg, write_mpeg
from tidemark.llm.queries import op5_media_columns


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 100_000])
def test_round_trip(n):
    payload = padded(os.urandom(n))
    data = write_mpeg(payload)
    parsed = read_mpeg(data)
    assert payload_of(data, parsed) == (payload, None)
    assert parsed["table_agrees"] and parsed["checked"] == len(parsed["offsets"]) + 1
    assert parsed["table"]["frames"] == len(parsed["offsets"]) == len(payload) // 192
    assert parsed["samples"] == {48000: 1152 * len(parsed["offsets"])} and parsed["duration_us"] == 24_000 * len(parsed["offsets"])
    assert parsed["skipped"] == parsed["bad_checksums"] == 0


def test_resynchronises():
    data = write_mpeg(padded(b"x" * 3000))
    at = read_mpeg(data)["offsets"][3]
    parsed = read_mpeg(data[:at] + b"junk\xffjunk" + data[at:])
    assert parsed["skipped"] == 9
    assert len(parsed["offsets"]) == 16


def test_bad_checksum_is_seen():
    data = bytearray(write_mpeg(padded(b"x" * 500)))
    at = read_mpeg(bytes(data))["offsets"][1]
    data[at + 8] ^= 1
    parsed = read_mpeg(bytes(data))
    assert parsed["bad_checksums"] == 1
    assert payload_of(bytes(data), parsed) == (None, "a frame's checksum is wrong")


def test_damaged_payload_is_seen():
    data = bytearray(write_mpeg(padded(b"x" * 500)))
    data[read_mpeg(bytes(data))["offsets"][1] + 100] ^= 1
    assert payload_of(bytes(data), read_mpeg(bytes(data))) == (None, "the payload's checksum is wrong")


def test_other_layouts():
    """A frame of version 2 layer III without checksum, behind a title tag at the end."""
    frame = bytes.fromhex("fff340c0")  # 32 kbit/s, 22050 Hz, mono: 72 * 32000 / 22050 = 104 bytes
    parsed = read_mpeg((frame + bytes(100)) * 3 + b"TAG" + b"A title".ljust(125, b"\0"))
    assert parsed["offsets"] == [0, 104, 208]
    assert (parsed["samples"], parsed["tags"]["title"]) == ({22050: 3 * 576}, "A title")
    assert parsed["duration_us"] == 3 * 576 * 1_000_000 // 22050 and parsed["table_agrees"] is None
    assert payload_of(b"", parsed) == (None, None)
    assert read_mpeg(b"nothing here")["offsets"] == []


def test_chance_headers_after_damage_aren_t_frames():
    """After damage a header counts only if a like one, or the end, stands behind its frame."""
    frame = bytes.fromhex("fff340c0") + bytes(100)
    parsed = read_mpeg(frame * 2 + b"junk" + bytes.fromhex("fff340c0") + b"junk" * 5 + frame * 2)
    assert parsed["offsets"] == [0, 104, 236, 340] and parsed["skipped"] == 28


def test_mixed_rates_give_the_exact_duration():
    slow, fast = bytes.fromhex("fff340c0") + bytes(100), bytes.fromhex("fffb14c0") + bytes(92)  # 22,050 and 48,000 Hz
    parsed = read_mpeg(slow * 3 + fast * 2)
    assert parsed["samples"] == {22050: 3 * 576, 48000: 2 * 1152}
    assert parsed["duration_us"] == int(3 * 576 * 1_000_000 / 22050 + 2 * 1152 * 1_000_000 / 48000)


def bits_crc(bits):
    """The checksum by long division of bits."""
    crc = 0xFFFF
    for bit in bits:
        top = crc >> 15 ^ int(bit)
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


@pytest.mark.parametrize("head, widths, channels, bound", [
    ("fffe8400", [4] * 32, 2, 32),  # layer I, stereo
    ("fffe8450", [4] * 32, 2, 8),  # layer I, joint stereo from subband 8 on
    ("fffe84c0", [4] * 32, 1, 32),  # layer I, mono
    ("fffc24c0", [4] * 2 + [3] * 6, 1, 32),  # layer II, 48 kbit/s mono at 48 kHz: table c
    ("fffc28c0", [4] * 2 + [3] * 10, 1, 32),  # the same at 32 kHz: table d
    ("fffca060", [4] * 11 + [3] * 12 + [2] * 7, 2, 12),  # layer II, 192 kbit/s joint stereo at 44.1 kHz: table b
    ("fffc8400", [4] * 11 + [3] * 12 + [2] * 4, 2, 32),  # layer II, 128 kbit/s stereo at 48 kHz: table a
    ("fff48400", [4] * 4 + [3] * 7 + [2] * 19, 2, 32),  # version 2, layer II
])
def test_checksums_of_layers_i_and_ii(head, widths, channels, bound):
    rng, head = random.Random(head), bytes.fromhex(head)
    size = header_of(head).size
    allocations = [(w, 1 if band >= bound else channels, rng.choice([0, 0, rng.randrange(1 << w)])) for band, w in enumerate(widths)]
    bits, scales = "", 0
    for band, (w, times, value) in enumerate(allocations):
        for _ in range(times):
            bits += f"{value:0{w}b}"
        scales += 2 * channels if value else 0
    if head[1] >> 1 & 3 == 2:  # layer II: scale information of subbands with an allocation
        bits += "".join(rng.choice("01") for _ in range(scales))
    crc = bits_crc(f"{int.from_bytes(head[2:]):016b}" + bits)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8))
    frame = (head + crc.to_bytes(2) + body).ljust(size, b"\x55")
    parsed = read_mpeg(frame * 3)
    assert (len(parsed["offsets"]), parsed["checked"], parsed["bad_checksums"]) == (3, 3, 0)
    broken = bytearray(frame)
    broken[6] ^= 128
    assert read_mpeg(frame + bytes(broken) + frame)["bad_checksums"] == 1


def test_tags_of_all_versions():
    frame = bytes.fromhex("fff340c0") + bytes(100)
    long_ = "x" * 199
    for version, tag, want in [
        (2, b"TT2" + (201).to_bytes(3) + b"\0" + long_.encode() + b"\0", {"TT2": long_}),
        (3, b"TIT2" + (200).to_bytes(4) + b"\0\0\0" + long_.encode(), {"TIT2": long_}),
        (3, b"TPE1" + (11).to_bytes(4) + b"\0\0\1" + "Émile".encode("utf-16-le").join([b"\xff\xfe", b""])[:10], {"TPE1": "Émil"}),
        (4, b"TIT2" + bytes([0, 0, 1, 72]) + b"\0\0\3" + long_.encode(), {"TIT2": long_}),
        (4, b"TXXX" + bytes([0, 0, 0, 8]) + b"\0\0\3key\0val", {"TXXX:key": "val"}),
    ]:
        size = bytes((len(tag) >> s) & 127 for s in (21, 14, 7, 0))
        parsed = read_mpeg(b"ID3" + bytes([version, 0, 0]) + size + tag + frame * 2)
        assert parsed["tags"] == want and len(parsed["offsets"]) == 2 and parsed["skipped"] == 0


def test_tables_against_frames():
    data = write_mpeg(padded(b"x" * 3000))
    at = read_mpeg(data)["offsets"][5]
    parsed = read_mpeg(data[:at] + data[at + 240 :])
    assert parsed["table"]["kind"] == "Xing" and parsed["table_agrees"] is False
    frame = bytes.fromhex("fff340c0") + bytes(100)
    table = struct.pack(">4sHHHIIHHHH", b"VBRI", 1, 0, 50, 104 * 4, 3, 1, 1, 2, 1) + b"\0\7"
    parsed = read_mpeg(bytes.fromhex("fff340c0") + (bytes(32) + table).ljust(100, b"\0") + frame * 3)
    assert parsed["table"] == {"kind": "VBRI", "frames": 3, "bytes": 416, "toc": b"\0\7"}
    assert parsed["table_agrees"] and parsed["offsets"] == [104, 208, 312]


def test_foreign_and_damaged_files_don_t_stop_the_job(spark):
    rng = random.Random(3)
    own = write_mpeg(padded(b"some text"))
    files = [None, b"", b"no audio", (bytes.fromhex("fff340c0") + bytes(100)) * 5, own[:200], own[:-1], own[:150] + b"\xff" + own[151:], *[bytes(rng.choices([0, 73, 68, 51, 255, 251, 144, 64], k=400)) for _ in range(50)], *[own[:k] + bytes([rng.randrange(256)]) + own[k + 1 :] for k in range(0, len(own), 7)]]
    rows = decode_audio(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i long, media binary")).orderBy("i").collect()
    assert [r.n_frames for r in rows[:4]] == [0, 0, 0, 5] and rows[3].payload is None and rows[3].error is None
    assert all(r.payload is None or bytes(r.payload) == padded(b"some text") for r in rows)


def test_checksum_polynomial():
    assert crc16(b"\x00\x00") == crc16(b"\x00", crc16(b"\x00"))
    assert crc16(b"123456789") == 0xAEE7


def test_query(spark, documents, sf_dir):
    rows = {r.doc_id: r for r in op5_media_columns(spark, sf_dir).collect()}
    for doc in documents.collect():
        raw = (doc.text or "").encode()
        payload, row = padded(raw), rows[doc.doc_id]
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.media_sha256 == hashlib.sha256(write_mpeg(payload)).hexdigest()


def test_odd_texts(make_docs, odd):
    """Own columns stay as they are, whatever their names; made ones step aside."""
    docs = make_docs(odd, clash=True)
    media = encode_audio(docs)
    assert media.columns == [*[c for c in docs.columns if c != "text"], "media_"]
    rows = decode_audio(media, "media_").collect()
    assert {r.doc_id: bytes(r.payload_) for r in rows} == {i: padded((t or "").encode()) for i, t in enumerate(odd)}
    assert {(r.payload, r.media) for r in rows} == {("x", "x")}
    assert decode_audio(encode_audio(make_docs([]))).collect() == []
    assert all(len(r.seek_offsets) == r.n_frames for r in rows)
