"""FLAC: exact round trips, checksums, seek points, and subframes that the encoder doesn't write."""

import numpy as np
import pytest

from ledgerframe.llm import flac

RNG = np.random.default_rng(3)
TEXTS = ["", None, "a", "é" * 200, "the quick brown fox " * 900, "日本語" * 700, "".join(map(chr, RNG.integers(32, 900, 3000)))]


def strip_seek_table(stream):
    n = int.from_bytes(stream[43:46], "big")
    return stream[:4] + b"\x80" + stream[5:42] + stream[46 + n :]


def test_round_trips_with_and_without_seek_table():
    payloads = [flac.payload_of(t) for t in TEXTS] + [bytes(range(256)) * 9, b"\x00" * 192, RNG.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"\x80" * 1000 + b"\xff" * 7 + b"\x00" * 200]
    streams = flac.encode(payloads)
    assert [flac.payload_from(b) for b in flac.decode(streams)] == payloads
    assert [flac.payload_from(b) for b in flac.decode([strip_seek_table(s) for s in streams])] == payloads
    assert len(streams[4]) < len(payloads[4])
    assert [s for s, _ in flac.decode(streams)[4]] == list(range(0, len(payloads[4]), flac.BLOCK))


def test_linear_prediction_is_used_and_read_back():
    t = np.arange(8 * flac.BLOCK)
    wave = (128 + 90 * np.sin(t / 7.0) + 20 * np.sin(t / 3.1)).astype(np.uint8).tobytes()
    (stream,) = flac.encode([wave])
    assert len(stream) < 0.6 * len(wave) and flac.payload_from(flac.decode([stream])[0]) == wave


@pytest.mark.parametrize("where", [0.3, 0.6, 0.999])
def test_damage_is_found(where):
    stream = bytearray(flac.encode([flac.payload_of(TEXTS[4])])[0])
    stream[int(len(stream) * where)] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def bits(*fields):
    return "".join(format(v & ((1 << w) - 1), f"0{w}b") for v, w in fields)


def test_partitions_and_escapes():
    """A hand-made frame of 16 samples: fixed order 1, two partitions, one of them escaped."""
    x = np.array([3, 4, 2, 2, 5, 7, 7, 6, -60, 60, -1, 0, 9, 9, 8, 100])
    e = np.diff(x)
    rice = "".join("0" * (u >> 2) + "1" + format(u & 3, "02b") for u in ((int(v) << 1) ^ (int(v) >> 63) for v in e[:7]))
    body = bits((9 << 1, 8), (int(x[0]), 8), (0, 2), (1, 4), (2, 4)) + rice + bits((15, 4), (9, 5)) + "".join(format(int(v) & 511, "09b") for v in e[7:])
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0, 15])
    rows = np.frombuffer(head, np.uint8)[None, :]
    data = head + bytes([int(flac.crc8(rows, np.array([6]))[0])])
    body += "0" * (-len(body) % 8)
    data += int(body, 2).to_bytes(len(body) // 8, "big")
    raw = np.frombuffer(data, np.uint8)
    data += int(flac.crc16(raw, np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
    (got,), number, end = flac.decode_frames(np.frombuffer(data + b"\x00" * 16, np.uint8), np.array([0]))
    assert got.tolist() == x.tolist() and number[0] == 0 and end[0] == len(data)


def test_crc16_is_the_formats():
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 8
            for _ in range(8):
                c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        return c

    for n in (1, 2, 7, 64):
        d = RNG.integers(0, 256, n, dtype=np.uint8)
        assert flac.crc16(d, np.array([0]), np.array([n]))[0] == slow(d.tobytes())


def test_columns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", None), (2, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    digests = flac.media_digest(df).collect()
    assert len(digests) == len(rows) and {r.media_sha256 for r in digests if r.n_bytes == 1} == {next(r.media_sha256 for r in digests if r.n_bytes == 1)}
    assert all(r.payload_bytes % 192 == 0 and r.payload_bytes > 0 for r in digests)
    blocks = flac.pcm_blocks(flac.to_audio(df).where("doc_id = 4")).orderBy("block").collect()
    assert b"".join((np.frombuffer(r.pcm, np.uint8) ^ 0x80).tobytes() for r in blocks) == flac.payload_of(TEXTS[4])
    assert [r.sample_offset for r in blocks] == [flac.BLOCK * i for i in range(len(blocks))]
    assert flac.media_digest(df.limit(0)).count() == 0
