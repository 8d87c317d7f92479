"""Lossless audio columns: a FLAC encoder and decoder in numpy.

Streams are mono, 8 bits a sample, in blocks of fixed size with a seek point for each frame. Many frames, of many
streams, are coded at once: the bit cursor of every frame advances together, one sample a step. The decoder
reads constant, verbatim, fixed and linear-prediction subframes, Rice residuals with any partition order and escaped
partitions, verifies both checksums of every frame and the digest of the whole stream, and gives PCM blocks with their
sample offsets. A byte of payload is one sample, less 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, process_cache

BLOCK, RATE, LPC_ORDER, PRECISION, GROUP = 1152, 8000, 4, 10, 2048
# Block sizes by header code (fixed values of the format); codes 6 and 7 read it from the header.
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{c: 256 << (c - 8) for c in range(8, 16)}}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


def _crc16_words() -> np.ndarray:
    """The checksum of every two-byte word."""

    def build() -> np.ndarray:
        t, v = _crc_table(0x8005, 16), np.arange(65536)
        first = t[v >> 8]
        return (t[(first >> 8) ^ (v & 255)] ^ (first << 8 & 0xFFFF)).astype(np.uint16)

    return process_cache("flac-crc16", build)


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of slices of ``data``. Slices are aligned at their ends: leading zeros change nothing."""
    words, width = _crc16_words(), int(size.max() + 1) // 2 * 2
    at = start[:, None] + size[:, None] - width + np.arange(width)[None, :]
    rows = np.where(at >= start[:, None], data[np.maximum(at, 0)], 0).astype(np.uint16)
    pairs = np.ascontiguousarray(((rows[:, 0::2] << np.uint16(8)) | rows[:, 1::2]).T)
    out = np.zeros(len(start), np.uint16)
    for column in pairs:
        out = words[out ^ column]
    return out.astype(np.int64)


def crc8(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of the first ``size`` bytes of each row."""
    table, out = process_cache("flac-crc8", lambda: _crc_table(0x07, 8)), np.zeros(len(rows), np.int64)
    for i in range(rows.shape[1]):
        out = np.where(i < size, table[out ^ rows[:, i]], out)
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    more = []
    while n >= 1 << (6 - len(more)):
        more.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF << (7 - len(more))) & 0xFF
    return bytes([lead | n, *more[::-1]])


def _header(n: int, number: int) -> bytes:
    code = next((c for c, s in SIZES.items() if s == n), 7)
    return bytes([0xFF, 0xF8, code << 4, 0x02]) + _number(number) + ((n - 1).to_bytes(2, "big") if code == 7 else b"")


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised predictors of each row by Levinson's recursion: coefficients, shift, residuals from LPC_ORDER on."""
    p, n = LPC_ORDER, x.shape[1]
    taper = 1 - (2 * (np.arange(n) + 0.5) / n - 1) ** 2
    w = x * taper
    r = np.stack([(w[:, : n - j] * w[:, j:]).sum(1) for j in range(p + 1)], axis=1)
    error, a = r[:, 0] * (1 + 1e-9) + 1e-9, np.zeros((len(x), p))
    for i in range(p):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(top, 1e-6))).astype(np.int64), 0, 15)
    limit = 1 << (PRECISION - 1)
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64)
    guess = sum(q[:, j : j + 1] * x[:, p - 1 - j : n - 1 - j] for j in range(p)) >> shift[:, None]
    return q, shift, x[:, p:] - guess


def _rice(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the best Rice parameter of each row and the bits it takes."""
    u = (e << 1) ^ (e >> 63)
    bits = np.stack([(u >> k).sum(1) + (k + 1) * u.shape[1] for k in range(12)])
    k = bits.argmin(0)
    return u, k, bits[k, np.arange(len(u))]


def encode_frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of equal size: samples (frames, n) as int64, and each frame's number in its stream."""
    f, n = x.shape
    heads = [_header(n, int(i)) for i in number]
    size = np.array([len(h) for h in heads])
    rows = np.zeros((f, size.max()), np.uint8)
    for i, h in enumerate(heads):
        rows[i, : len(h)] = np.frombuffer(h, np.uint8)
    check = crc8(rows, size)
    # Candidates: 0 verbatim, 1..5 fixed orders 0..4, 6 linear prediction, 7 constant.
    diffs, coded = [x], []
    for _ in range(4):
        diffs.append(np.diff(diffs[-1], axis=1))
    coef, shift, rest = _lpc(x)
    for e, order, extra in [*((d, o, 0) for o, d in enumerate(diffs)), (rest, LPC_ORDER, 9 + PRECISION * LPC_ORDER)]:
        u, k, bits = _rice(e)
        coded.append((u, k, bits, order, bits + 8 * order + extra + 10))
    cost = np.stack([np.full(f, 8 * n), *(c[4] for c in coded), np.where((x == x[:, :1]).all(1), 8, 1 << 40)])
    kind = cost.argmin(0)
    body = 8 * (size + 1) + 8 + cost[kind, np.arange(f)]
    length = (body + 7) // 8 + 2
    at = np.concatenate([[0], np.cumsum(length)])
    bits = np.zeros(8 * int(at[-1]), np.uint8)

    def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[pos + j] = value >> (width - 1 - j) & 1

    for i in range(rows.shape[1]):
        own = np.nonzero(i < size)[0]
        put(8 * (at[own] + i), rows[own, i].astype(np.int64), 8)
    cur = 8 * (at[:-1] + size)
    put(cur, check, 8)
    tag = np.array([1, 8, 9, 10, 11, 12, 32 | (LPC_ORDER - 1), 0])[kind]
    put(cur + 8, tag << 1, 8)
    cur = cur + 16
    for code in np.unique(kind):
        own = np.nonzero(kind == code)[0]
        pos = cur[own]
        if code == 7:
            put(pos, x[own, 0] & 255, 8)
            continue
        if code == 0:
            put((pos[:, None] + 8 * np.arange(n)[None, :]).ravel(), (x[own] & 255).ravel(), 8)
            continue
        u, k, _, order, _ = coded[code - 1]
        u, k = u[own], k[own]
        for j in range(order):
            put(pos + 8 * j, x[own, j] & 255, 8)
        pos = pos + 8 * order
        if code == 6:
            put(pos, np.full(len(own), PRECISION - 1), 4)
            put(pos + 4, shift[own], 5)
            for j in range(order):
                put(pos + 9 + PRECISION * j, coef[own, j] & ((1 << PRECISION) - 1), PRECISION)
            pos = pos + 9 + PRECISION * order
        put(pos, np.zeros(len(own), np.int64), 6)
        put(pos + 6, k, 4)
        q = u >> k[:, None]
        ends = np.cumsum(q + 1 + k[:, None], axis=1)
        low = pos[:, None] + 10 + ends - k[:, None]
        bits[low - 1] = 1
        for j in range(int(k.max())):
            has = np.nonzero(k > j)[0]
            bits[low[has] + j] = u[has] >> (k[has, None] - 1 - j) & 1
    data = np.packbits(bits)
    tail = crc16(data, at[:-1], length - 2)
    data[at[1:] - 2], data[at[1:] - 1] = tail >> 8, tail & 255
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload; an empty payload gives a stream of no frames."""
    jobs: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for number, s in enumerate(range(0, len(p), block)):
            jobs.setdefault(min(block, len(p) - s), []).append((i, number))
    frames: list[dict[int, bytes]] = [{} for _ in payloads]
    for n, todo in jobs.items():
        for s in range(0, len(todo), GROUP):
            part = todo[s : s + GROUP]
            raw = b"".join(payloads[i][m * block : m * block + n] for i, m in part)
            x = np.frombuffer(raw, np.uint8).reshape(len(part), n).astype(np.int64) - 128
            for (i, m), frame in zip(part, encode_frames(x, np.array([m for _, m in part]))):
                frames[i][m] = frame
    out = []
    for p, own in zip(payloads, frames):
        body = [own[m] for m in range(len(own))]
        sizes = [len(b) for b in body] or [0]
        pcm = (np.frombuffer(p, np.uint8) ^ np.uint8(0x80)).tobytes()
        info = (RATE << 44) | (0 << 41) | (7 << 36) | len(p)
        stream = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + info.to_bytes(8, "big") + hashlib.md5(pcm).digest()
        seek, offset = [], 0
        for m, b in enumerate(body):
            seek.append((m * block).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(block, len(p) - m * block).to_bytes(2, "big"))
            offset += len(b)
        table = b"".join(seek[: (1 << 24) // 18 - 1])
        out.append(b"fLaC\x00" + len(stream).to_bytes(3, "big") + stream + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(body))
    return out


@dataclass
class Stream:
    """What the metadata of a stream says, and where its frames begin."""

    data: bytes
    samples: int
    md5: bytes
    first: int
    points: list[tuple[int, int, int]]  # sample, byte offset from the first frame, samples


def parse(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, samples, md5, points, last = 4, 0, b"", [], False
    while not last:
        last, kind, size = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            info = int.from_bytes(body[10:18], "big")
            if (info >> 41) & 7 or ((info >> 36) & 31) != 7:
                raise ValueError("only mono streams of 8 bits a sample")
            samples, md5 = info & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            cells = np.frombuffer(body, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            points = [(int(s), int(o), int(n)) for s, o, n in cells if s != (1 << 64) - 1]
        at += 4 + size
    return Stream(data, samples, md5, at, points)


class _Bits:
    """Reads of many bit cursors over one buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(data) + 8
        self.window = np.zeros(n, np.uint64)
        for j in range(8):
            self.window |= padded[j : j + n] << np.uint64(56 - 8 * j)

    def at(self, pos: np.ndarray) -> np.ndarray:
        """The bits from ``pos`` on, at the top of 64-bit words (57 at least are good)."""
        return self.window[np.minimum(pos >> 3, len(self.window) - 1)] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, width: np.ndarray) -> np.ndarray:
        return ((self.at(pos) >> np.uint64(1)) >> (63 - width).astype(np.uint64)).astype(np.int64)

    def signed(self, pos: np.ndarray, width: np.ndarray) -> np.ndarray:
        v = self.take(pos, width)
        return np.where(v >> np.maximum(width - 1, 0) & (width > 0), v - (1 << width), v)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """How many 0 bits come before the next 1."""
        head = (self.at(pos) >> np.uint64(32)).astype(np.float64)
        out = 1054 - (head.view(np.int64) >> 52)
        far = np.nonzero(head == 0)[0]
        if len(far):
            if (pos[far] >> 3 >= len(self.window) - 1).any():
                raise ValueError("a residual runs past the end of its frame")
            out[far] = 32 + self.zeros(pos[far] + 32)
        return out


def decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples, frame numbers and end offsets of the frames that begin at ``start``; raises on a wrong checksum."""
    bits = _Bits(data)
    rows = data[np.minimum(start[:, None] + np.arange(16)[None, :], len(data) - 1)].astype(np.int64)
    if ((rows[:, 0] != 0xFF) | (rows[:, 1] != 0xF8) | (rows[:, 3] >> 4 != 0)).any():
        raise ValueError("no mono frame of fixed block size at a frame's place")
    more = np.array([0] * 128 + [0] * 64 + [1] * 32 + [2] * 16 + [3] * 8 + [4] * 4 + [5] * 2 + [6, 6])[rows[:, 4]]
    number = rows[:, 4] & np.where(more == 0, 0x7F, 0x3F >> np.minimum(more, 6))
    for j in range(6):
        number = np.where(j < more, number << 6 | rows[np.arange(len(rows)), 5 + j] & 0x3F, number)
    code, at = rows[:, 2] >> 4, 5 + more
    pick = lambda i: rows[np.arange(len(rows)), np.minimum(i, 15)]
    n = np.array([SIZES.get(c, 0) for c in range(16)])[code]
    n = np.where(code == 6, pick(at) + 1, np.where(code == 7, (pick(at) << 8 | pick(at + 1)) + 1, n))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.select([(rows[:, 2] & 15) == 12, (rows[:, 2] & 15) >= 13], [1, 2], 0)
    if (crc8(rows, at) != pick(at)).any():
        raise ValueError("wrong header checksum")
    order_ = np.argsort(-n, kind="stable")
    start_, n_, cur = start[order_], n[order_], 8 * (start[order_] + at[order_] + 1)
    tag = bits.take(cur, np.full(len(cur), 8)) >> 1
    cur = cur + 8
    f, most = len(n_), int(n_.max())
    x = np.zeros((f, most), np.int64)
    fixed, lpc = (tag >= 8) & (tag <= 12), tag >= 32
    if (~(fixed | lpc | (tag <= 1))).any():
        raise ValueError("unknown kind of subframe")
    order = np.where(fixed, tag - 8, np.where(lpc, tag - 31, 0))
    eight = np.full(f, 8)
    for i in np.nonzero(tag == 0)[0]:
        x[i] = bits.signed(cur[i : i + 1], eight[:1])[0]
        cur[i] += 8
    for i in np.nonzero(tag == 1)[0]:
        a, s = int(cur[i]) >> 3, int(cur[i]) & 7
        raw = data[a : a + int(n_[i]) + 1].astype(np.int64)
        x[i, : n_[i]] = ((raw[: n_[i]] << s | (np.append(raw, 0)[1 : n_[i] + 1] >> (8 - s))) & 255 ^ 128) - 128
        cur[i] += 8 * n_[i]
    for j in range(int(order.max())):
        own = np.nonzero(order > j)[0]
        x[own, j] = bits.signed(cur[own], eight[own])
        cur[own] += 8
    coef, shift = np.zeros((f, 32), np.int64), np.zeros(f, np.int64)
    own = np.nonzero(lpc)[0]
    if len(own):
        precision = bits.take(cur[own], np.full(len(own), 4)) + 1
        shift[own] = bits.signed(cur[own] + 4, np.full(len(own), 5))
        cur[own] += 9
        for j in range(int(order[own].max())):
            has = np.nonzero(order[own] > j)[0]
            coef[own[has], j] = bits.signed(cur[own[has]], precision[has])
            cur[own[has]] += precision[has]
    coded = np.nonzero(fixed | lpc)[0]
    if len(coded):
        cur[coded], x[coded] = _residuals(bits, cur[coded], n_[coded], order[coded], x[coded])
    for p in range(1, 5):
        own = np.nonzero(fixed & (order == p))[0]
        if len(own):
            seq = x[own, p:]
            for level in range(p, 0, -1):
                head = np.diff(x[own, :level], n=level - 1, axis=1)[:, -1:]
                seq = np.cumsum(np.concatenate([head, seq], axis=1), axis=1)
            x[own] = seq
    own = np.nonzero(lpc)[0]
    if len(own):
        p = int(order[own].max())
        line = np.ascontiguousarray(np.concatenate([np.zeros((len(own), p), np.int64), x[own]], axis=1).T)
        c, sh, o = np.ascontiguousarray(coef[own, :p].T), shift[own], order[own]
        for i in range(most):
            guess = c[0] * line[p + i - 1]
            for j in range(1, p):
                guess += c[j] * line[p + i - 1 - j]
            line[p + i] += np.where(i >= o, guess >> sh, 0)
        x[own] = line[p:].T
    end = (cur + 7) // 8
    check = crc16(data, start_, end - start_)
    if (check != (data[end].astype(np.int64) << 8 | data[end + 1])).any():
        raise ValueError("wrong frame checksum")
    out: list = [None] * f
    for i, k in enumerate(order_):
        out[k] = x[i, : n_[i]]
    back = np.empty(f, np.int64)
    back[order_] = end + 2
    return out, number, back


def _residuals(bits: _Bits, cur: np.ndarray, n: np.ndarray, order: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice residuals into ``x`` from each frame's order on; frames are sorted by falling size."""
    width = np.where(bits.take(cur, np.full(len(cur), 2)) == 1, 5, 4)
    part = n >> bits.take(cur + 2, np.full(len(cur), 4))
    cur = cur + 6
    k, raw, edge = np.zeros(len(cur), np.int64), np.full(len(cur), -1), np.zeros(len(cur), np.int64)
    line = np.ascontiguousarray(x.T)
    active = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")
    least, special = int(order.min()), int(order.max())
    for i in range(least, int(n[0])):
        a = int(active[i])
        turn = np.nonzero((edge[:a] <= i) & (order[:a] <= i))[0]
        if len(turn):
            k[turn] = bits.take(cur[turn], width[turn])
            cur[turn] += width[turn]
            escaped = k[turn] == (1 << width[turn]) - 1
            raw[turn] = np.where(escaped, bits.take(cur[turn], np.full(len(turn), 5)), -1)
            cur[turn] += np.where(escaped, 5, 0)
            edge[turn] = (i // part[turn] + 1) * part[turn]
        plain = a if i >= special and (raw[:a] < 0).all() else -1
        own = slice(0, a) if plain >= 0 else np.nonzero((order[:a] <= i) & (raw[:a] < 0))[0]
        c, kk = cur[own], k[own]
        q = bits.zeros(c)
        c = c + q + 1
        u = q << kk | bits.take(c, kk)
        line[i, own] = (u >> 1) ^ -(u & 1)
        cur[own] = c + kk
        if plain < 0:
            odd = np.nonzero((order[:a] <= i) & (raw[:a] >= 0))[0]
            if len(odd):
                line[i, odd] = bits.signed(cur[odd], raw[odd])
                cur[odd] += raw[odd]
    return cur, line.T


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """PCM blocks of each stream: (offset of the first sample, samples).

    Frames found by the seek table are decoded together; a stream whose table doesn't name every frame is read
    frame after frame. Raises on wrong checksums, sample counts and digests.
    """
    parsed = [parse(s) for s in streams]
    out: list[list] = [[] for _ in streams]
    jobs = []
    for i, s in enumerate(parsed):
        if sum(p[2] for p in s.points) == s.samples:
            jobs += [(i, p[0], s.first + p[1]) for p in s.points]
        else:
            at, sample, raw = s.first, 0, np.frombuffer(s.data, np.uint8)
            while sample < s.samples:
                (x,), _, (end,) = decode_frames(raw, np.array([at]))
                out[i].append((sample, x))
                sample, at = sample + len(x), int(end)
    for g in range(0, len(jobs), GROUP):
        part = jobs[g : g + GROUP]
        names = sorted({i for i, _, _ in part})
        ends = np.cumsum([0] + [len(streams[i]) for i in names])
        base = dict(zip(names, ends))
        data = np.frombuffer(b"".join(streams[i] for i in names), np.uint8)
        found, _, _ = decode_frames(data, np.array([base[i] + at for i, _, at in part]))
        for (i, sample, _), x in zip(part, found):
            out[i].append((sample, x))
    for s, blocks in zip(parsed, out):
        pcm = hashlib.md5(b"".join(x.astype(np.int8).tobytes() for _, x in blocks)).digest()
        if sum(len(x) for _, x in blocks) != s.samples or pcm != s.md5:
            raise ValueError("wrong digest of the samples")
    return out


def payload_of(text: str | None, unit: int = 192) -> bytes:
    """UTF-8 bytes of a text, filled with spaces up to a positive multiple of ``unit``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(1, -(-len(data) // unit)) * unit - len(data))


def payload_from(blocks: list[tuple[int, np.ndarray]]) -> bytes:
    return b"".join((x + 128).astype(np.uint8).tobytes() for _, x in blocks)


def feature(blocks: list[tuple[int, np.ndarray]]) -> str:
    """Frames, peak, mean level, power and sign changes of the decoded samples."""
    x = np.concatenate([b for _, b in blocks]) if blocks else np.zeros(1, np.int64)
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"frames={len(blocks)};peak={int(np.abs(x).max())};sum={int(x.sum())};power={int((x * x).sum())};crossings={changes}"


def _groups(texts: list[str | None], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` characters, so memory follows the longest text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def to_audio(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store each whole text as a FLAC stream: id, n_bytes, media binary.

    Null texts count as empty; null and repeated ids give a row each; other columns are ignored.
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        media = [m for a, b in _groups(cols["text"]) for m in encode([payload_of(t) for t in cols["text"][a:b]])]
        return {"id": cols["id"], "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in cols["text"]], "media": media}

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, n_bytes long, media binary", rows=512).withColumnRenamed("id", id_col)


def pcm_blocks(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """Decode FLAC streams into PCM blocks: id, block, sample_offset, pcm (8-bit signed samples); null media has none."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "block": [], "sample_offset": [], "pcm": []}
        known = [(i, m) for i, m in zip(cols["id"], cols["media"]) if m is not None]
        for (i, _), blocks in zip(known, decode([bytes(m) for _, m in known])):
            for b, (sample, x) in enumerate(blocks):
                for name, v in zip(out, (i, b, sample, x.astype(np.int8).tobytes())):
                    out[name].append(v)
        return out

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")), run, "id long, block int, sample_offset long, pcm binary", rows=128).withColumnRenamed("id", id_col)


def media_digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store each text as FLAC, read it back and digest both forms, one row a document (see ``to_audio`` for odd rows)."""
    import zlib

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        for a, b in _groups(cols["text"]):
            texts = cols["text"][a:b]
            media = encode([payload_of(t) for t in texts])
            for i, t, m, blocks in zip(cols["id"][a:b], texts, media, decode(media)):
                p = payload_from(blocks)
                row = i, len((t or "").encode("utf-8", "surrogatepass")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(blocks)
                for name, v in zip(out, row):
                    out[name].append(v)
        return out

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema, rows=1024).withColumnRenamed("id", id_col)
