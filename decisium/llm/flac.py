"""FLAC media columns: 8-bit mono streams, written and read by numpy over many frames at once.

Frames don't depend on one another, so both directions work in lock step: step i
handles sample i of every frame of a segment (``SEGMENT_FRAMES`` frames). The
decoder reads Rice codes (4- and 5-bit parameters, partitions, escapes), fixed
and quantised linear predictors, verbatim and constant subframes and wasted bits,
and verifies the CRC-8 of each frame's header, the CRC-16 of each frame and the
MD5 of the stream. The encoder picks per frame the best of a constant, verbatim
samples and fixed predictors of order 0 to 2, and writes a seek point per frame,
from which decoded PCM blocks get their sample and byte offsets.

Edge cases: a null or empty text is 64 zero bytes. Texts of any length are stored
whole, a segment at a time. Equal texts give equal streams. A damaged stream
raises ``BrokenStream``. An empty table gives an empty result. Extra columns are
ignored. Streams of several channels or of more than 16 bits are refused.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisium.llm.tokens import text_bytes

BLOCK_SAMPLES = 1024
SEGMENT_FRAMES = 1024
SAMPLE_RATE = 8000
#: Payloads are filled up to a multiple of this.
PAD = 64


class BrokenStream(ValueError):
    """The stream is cut off, damaged or not of a kind that is read here."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, full = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & full
        out.append(c)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


_once = (np.arange(1 << 16, dtype=np.uint32) << 8 & 0xFFFF).astype(np.uint16) ^ _CRC16[np.arange(1 << 16) >> 8]
#: The CRC-16 after two more bytes, for the old CRC xor those bytes.
_CRC16_PAIR = (_once.astype(np.uint32) << 8 & 0xFFFF).astype(np.uint16) ^ _CRC16[_once >> 8]


def _running(lengths: np.ndarray) -> list[int]:
    """For falling ``lengths``: how many are longer than i, for each i."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left").tolist()


def _crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-16 of each range of ``data``; ranges step together by two bytes, longest first."""
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    crc = np.zeros(len(at), np.uint16)
    pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
    for i, m in enumerate(_running(n >> 1)):
        crc[:m] = _CRC16_PAIR[crc[:m] ^ pairs[at[:m] + 2 * i]]
    odd = (n & 1).astype(bool)
    last = data[(at + n - 1)[odd]]
    crc[odd] = (crc[odd] << 8) ^ _CRC16[(crc[odd] >> 8) ^ last]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _crc8(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    crc = np.zeros(len(at), np.uint8)
    for i, m in enumerate(_running(n)):
        crc[:m] = _CRC8[crc[:m] ^ data[at[:m] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    parts = 2
    while n >> (5 * parts + 1):
        parts += 1
    first = (0xFF << (8 - parts)) & 0xFF | n >> (6 * (parts - 1))
    return bytes([first, *(0x80 | n >> (6 * i) & 0x3F for i in range(parts - 2, -1, -1))])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    """(number, bytes) of the coded number at ``at``; bytes is 0 if it is none."""
    first = data[at]
    if first < 0x80:
        return first, 1
    parts = 8 - (first ^ 0xFF).bit_length()
    if parts < 2 or parts > 7 or at + parts > len(data):
        return 0, 0
    n = first & (0x7F >> parts)
    for b in data[at + 1 : at + parts]:
        if b >> 6 != 2:
            return 0, 0
        n = n << 6 | b & 0x3F
    return n, parts


def encode_frames(samples: np.ndarray, lengths: np.ndarray, numbers: list[int]) -> tuple[bytes, np.ndarray]:
    """The frames of neighbouring stretches of ``samples`` (signed, 8 bits), and where each begins (and the end)."""
    x = samples.astype(np.int32)
    n_frames = len(lengths)
    lengths = np.asarray(lengths, np.int64)
    starts = np.cumsum(np.concatenate([[0], lengths]))[:-1]
    frame = np.repeat(np.arange(n_frames), lengths)
    place = np.arange(len(x)) - starts[frame]
    d1 = np.diff(x, prepend=0)
    d2 = np.diff(d1, prepend=0)
    residuals = [x, d1, d2]
    costs = np.stack([np.add.reduceat(np.where(place >= o, np.abs(r), 0), starts) for o, r in enumerate(residuals)])
    order = np.argmin(costs, 0)
    own = order[frame]
    r = np.where(own == 0, x, np.where(own == 1, d1, d2))
    coded = place >= own
    u = np.where(coded, np.where(r >= 0, 2 * r, -2 * r - 1), 0)
    count = lengths - order
    guess = np.floor(np.log2(np.maximum(np.add.reduceat(u, starts) / np.maximum(count, 1), 1))).astype(np.int64)
    best, k = None, None
    for step in (-1, 0, 1):
        tried = np.clip(guess + step, 0, 14)
        bits = np.add.reduceat(u >> tried[frame], starts) + count * (1 + tried)
        if best is None:
            best, k = bits, tried
        else:
            k = np.where(bits < best, tried, k)
            best = np.minimum(bits, best)
    rice = 8 + 8 * order + 10 + best
    verbatim = 8 + 8 * lengths
    flat = np.minimum.reduceat(x, starts) == np.maximum.reduceat(x, starts)
    kind = np.where(flat, 0, np.where(rice < verbatim, 2, 1))
    body = (np.where(kind == 0, 16, np.where(kind == 1, verbatim, rice)) + 7) // 8

    heads = []
    for n, size in zip(numbers, lengths.tolist(), strict=True):
        heads.append(b"\xff\xf8\x70\x02" + _coded_number(n) + (size - 1).to_bytes(2, "big"))
    head_sizes = np.array([len(h) for h in heads])
    sizes = head_sizes + 1 + body + 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first = offsets[:-1] + head_sizes + 1  # of the subframe
    words = np.zeros(int(offsets[-1]) // 4 + 3)
    use = coded if (kind == 2).all() else coded & (kind == 2)[frame]
    if use.any():
        f, v = frame[use], u[use]
        kk = k[f]
        q = v >> kk
        size = q + 1 + kk
        ends = np.cumsum(size)
        rank = np.concatenate([[0], np.flatnonzero(np.diff(f)) + 1])
        residual_at = 8 * (first + 1 + order) + 10
        shift = np.zeros(n_frames, np.int64)
        shift[f[rank]] = residual_at[f[rank]] - (ends[rank] - size[rank])
        # a code is q zeros, a one and k bits; the latter are a number that ends at bit ``end``
        end = ends + shift[f]
        number = (1 << kk) | (v & ((1 << kk) - 1))
        riced = np.flatnonzero(kind == 2)
        end, number = np.concatenate([end, residual_at[riced]]), np.concatenate([number, k[riced]])
        low = -end & 31  # bits of its last word below the number
        word = (end - 1) >> 5
        value = number << low
        words += np.bincount(word, (value & 0xFFFFFFFF).astype(np.float64), len(words))
        words[:-1] += np.bincount(word, (value >> 32).astype(np.float64), len(words))[1:]
    out = np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[: int(offsets[-1])].copy()
    out[first] = np.where(kind == 0, 0, np.where(kind == 1, 2, (8 | order) << 1))
    byte = (x & 0xFF).astype(np.uint8)
    out[first[kind == 0] + 1] = byte[starts[kind == 0]]
    plain = (kind == 1)[frame] | ((kind == 2)[frame] & ~coded)
    out[first[frame[plain]] + 1 + place[plain]] = byte[plain]
    joined = np.frombuffer(b"".join(heads), np.uint8)
    head_starts = np.concatenate([[0], np.cumsum(head_sizes)])[:-1]
    out[np.repeat(offsets[:-1] - head_starts, head_sizes) + np.arange(len(joined))] = joined
    out[offsets[:-1] + head_sizes] = _crc8(joined, head_starts, head_sizes)
    check = _crc16(out, offsets[:-1], sizes - 2)
    out[offsets[1:] - 2] = check >> 8
    out[offsets[1:] - 1] = check & 0xFF
    return out.tobytes(), offsets


def _stream_head(total: int, block: int, digest: bytes, points: list[tuple[int, int, int]], frame_sizes: np.ndarray) -> bytes:
    least, most = (int(frame_sizes.min()), int(frame_sizes.max())) if len(frame_sizes) else (0, 0)
    info = block.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big")
    info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + digest
    seek = b"".join(a.to_bytes(8, "big") + b.to_bytes(8, "big") + n.to_bytes(2, "big") for a, b, n in points)
    last = b"" if not seek else b"\x83" + len(seek).to_bytes(3, "big") + seek
    return b"fLaC" + (b"\x00" if last else b"\x80") + len(info).to_bytes(3, "big") + info + last


#: Seek points of a stream; with more frames only every second, fourth, ... frame has one.
MOST_POINTS = (1 << 24) // 18 - 1


def encode_many(payloads: list[bytes], block: int = BLOCK_SAMPLES) -> list[bytes]:
    """A FLAC stream for each payload (unsigned 8-bit samples)."""
    parts: list[list[tuple[bytes, np.ndarray]]] = [[] for _ in payloads]
    pending: list[tuple[int, int, bytes]] = []  # stream, frame number, samples

    def flush() -> None:
        if not pending:
            return
        flat = np.frombuffer(b"".join(p[2] for p in pending), np.uint8).astype(np.int16) - 128
        data, offsets = encode_frames(flat, np.array([len(p[2]) for p in pending]), [p[1] for p in pending])
        at = 0
        while at < len(pending):  # the frames of one stream lie together
            end = at
            while end < len(pending) and pending[end][0] == pending[at][0]:
                end += 1
            parts[pending[at][0]].append((data[offsets[at] : offsets[end]], np.diff(offsets[at : end + 1])))
            at = end
        pending.clear()

    for s, payload in enumerate(payloads):
        for n, at in enumerate(range(0, len(payload), block)):
            pending.append((s, n, payload[at : at + block]))
            if len(pending) >= SEGMENT_FRAMES:
                flush()
    flush()
    out = []
    for payload, own in zip(payloads, parts, strict=True):
        sizes = np.concatenate([o[1] for o in own]) if own else np.zeros(0, np.int64)
        begins = (np.cumsum(sizes) - sizes).tolist()
        every = 1
        while len(begins) > every * MOST_POINTS:
            every *= 2
        points = [(i * block, begins[i], min(block, len(payload) - i * block)) for i in range(0, len(begins), every)]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        head = _stream_head(len(payload), block, hashlib.md5(signed, usedforsecurity=False).digest(), points, sizes)
        out.append(head + b"".join(o[0] for o in own))
    return out


class Stream:
    """What a stream's metadata say; ``frames`` are (byte offset, sample offset) if every frame has a seek point."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise BrokenStream("no fLaC marker")
        at, last = 4, False
        self.frames: list[tuple[int, int]] | None = None
        self.total = self.block = 0
        points = []
        while not last:
            if at + 4 > len(data):
                raise BrokenStream("the metadata are cut off")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block = int.from_bytes(body[2:4], "big")
                self.bits = (packed >> 36 & 31) + 1
                self.channels = (packed >> 41 & 7) + 1
                self.total = packed & (1 << 36) - 1
                self.md5 = body[18:34]
            elif kind == 3:
                points = [(int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            at += 4 + size
        self.start = at
        if self.channels != 1 or self.bits > 16:
            raise BrokenStream("only mono streams of up to 16 bits are read")
        covered = 0
        for _, sample, n in points:
            if sample != covered:
                break
            covered += n
        if points and covered == self.total:
            self.frames = [(at + p[0], p[1]) for p in points]
        elif self.total == 0 and at >= len(data):
            self.frames = []


def find_frames(data: bytes, stream: Stream) -> list[tuple[int, int]]:
    """(byte offset, sample offset) of each frame: from seek points, else by sync codes with a right CRC-8 and the next number."""
    if stream.frames is not None:
        return stream.frames
    out, number, sample, at = [], 0, 0, stream.start
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 6 <= len(data) and data[at + 1] == 0xF8:
            n, size = _read_number(data, at + 4)
            code = data[at + 2] >> 4
            extra = {6: 1, 7: 2}.get(code, 0) + {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
            end = at + 4 + size + extra
            if size and n == number and end < len(data):
                crc = 0
                for b in data[at:end]:
                    crc = int(_CRC8[crc ^ b])
                if crc == data[end]:
                    out.append((at, sample))
                    number, sample = number + 1, sample + stream.block
                    at = end
                    continue
        at += 1
    return out


#: Samples of a block by its code; 6 and 7 are stated in the header.
_BLOCKS = {1: 192} | {c: 576 << (c - 2) for c in range(2, 6)} | {c: 256 << (c - 8) for c in range(8, 16)}
_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> list[np.ndarray]:
    """The samples of each frame data[start:end], frames in lock step."""
    try:
        return _decode_frames(data, starts, ends, bits)
    except IndexError as e:
        raise BrokenStream("a frame is cut off") from e


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> list[np.ndarray]:
    n_frames = len(starts)
    if not n_frames:
        return []
    if (ends - starts < 9).any():
        raise BrokenStream("a frame is cut off")
    check = _crc16(data, starts, ends - starts - 2)
    if (check != data[ends - 2].astype(np.uint16) << 8 | data[ends - 1]).any():
        raise BrokenStream("frame checksum")
    raw = data.tobytes()
    sizes, first, head_sizes = np.zeros(n_frames, np.int64), np.zeros(n_frames, np.int64), np.zeros(n_frames, np.int64)
    for f, at in enumerate(starts.tolist()):
        if raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8 or raw[at + 3] >> 4:
            raise BrokenStream("no frame header of a mono stream")
        code, rate = raw[at + 2] >> 4, raw[at + 2] & 15
        _, n = _read_number(raw, at + 4)
        end = at + 4 + n
        if code == 6:
            sizes[f], end = raw[end] + 1, end + 1
        elif code == 7:
            sizes[f], end = int.from_bytes(raw[end : end + 2], "big") + 1, end + 2
        else:
            sizes[f] = _BLOCKS[code]
        end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        head_sizes[f], first[f] = end - at, end + 1
    if (_crc8(data, starts, head_sizes) != data[first - 1]).any():
        raise BrokenStream("header checksum")

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    pairs = padded[:-1].astype(np.int64) << 8 | padded[1:]
    window = pairs[:-3] << 24 | pairs[2:-1] << 8 | padded[4:]  # 40 bits from each byte

    def take(at: np.ndarray, n) -> np.ndarray:
        """``n`` (up to 32) bits from each bit position."""
        return window[at >> 3] >> (40 - (at & 7) - n) & ((1 << np.asarray(n, np.int64)) - 1)

    def signed(v: np.ndarray, n) -> np.ndarray:
        return v - (v >> (np.asarray(n) - 1) << np.asarray(n))

    one = np.unpackbits(data)
    next_one = np.where(one, np.arange(len(one), dtype=np.int32), np.int32(len(one)))
    next_one = np.concatenate([np.minimum.accumulate(next_one[::-1])[::-1], np.full(64, len(one), np.int32)])

    # longest first, so the frames that still run are always the first ones
    rank = np.argsort(-sizes, kind="stable")
    size, pos, limit = sizes[rank], 8 * first[rank], 8 * (ends[rank] - 2)
    head = take(pos, 8)
    pos = pos + 8
    code = head >> 1
    wasted = np.zeros(n_frames, np.int64)
    if (head & 1).any():
        has = (head & 1).astype(bool)
        wasted[has] = next_one[pos[has]] - pos[has] + 1
        pos = pos + wasted
    width = bits - wasted
    constant, verbatim = code == 0, code == 1
    fixed, linear = (code >= 8) & (code <= 12), code >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise BrokenStream("a reserved subframe type")
    order = np.where(fixed, code - 8, np.where(linear, code - 31, 0))
    deepest = int(order.max())
    steps = int(size[0])
    X = np.zeros((steps, n_frames), np.int64)
    running = _running(size)
    if constant.any():
        v = signed(take(pos, width), width)
        X[:, constant] = v[constant]
    if verbatim.any():
        w = np.flatnonzero(verbatim)
        spot = pos[w] + np.arange(steps)[:, None] * width[w]
        spot = np.minimum(spot, 8 * len(data) - 1)
        X[:, w] = signed(take(spot, width[w]), width[w])
    coded = fixed | linear
    C = np.zeros((deepest, n_frames), np.int64)
    shift, shifted = np.zeros(n_frames, np.int64), bool(linear.any())
    if coded.any():
        for i in range(deepest):
            m = coded & (order > i)
            X[i, m] = signed(take(pos[m], width[m]), width[m])
            pos = np.where(m, pos + width, pos)
        for o, c in _FIXED.items():
            for j, value in enumerate(c[:deepest]):
                C[j, fixed & (order == o)] = value
        if linear.any():
            precision = take(pos, 4) + 1
            shift = np.where(linear, signed(take(pos + 4, 5), 5), 0)
            if (shift < 0).any() or (linear & (precision == 16)).any():
                raise BrokenStream("predictor precision or shift")
            pos = np.where(linear, pos + 9, pos)
            for j in range(deepest):
                m = linear & (order > j)
                C[j, m] = signed(take(pos[m], precision[m]), precision[m])
                pos = np.where(m, pos + precision, pos)
        method = take(pos, 2)
        if (coded & (method > 1)).any():
            raise BrokenStream("a reserved residual coding")
        wide = 4 + method
        parts = take(pos + 2, 4)
        pos = np.where(coded, pos + 6, pos)
        span = np.where(coded, size >> parts, size)
        if (coded & ((span << parts != size) | (span < order))).any():
            raise BrokenStream("partitions don't divide the block")
        turns = {0} | {int(i) for s, n in {(int(s), int(n)) for s, n in zip(span[coded], size[coded], strict=True)} for i in range(0, n, s)}
        turns |= {int(o) for o in order[coded]}
        k = np.zeros(n_frames, np.int64)
        mask, room = k.copy(), k + 40
        raw_bits = np.full(n_frames, -1, np.int64)
        escapes = False
        all_coded = bool(coded.all())
        begun = 0 if all_coded and not deepest else deepest if all_coded else steps
        for i in range(steps):
            m = running[i]
            live = None if i >= begun else coded[:m] & (order[:m] <= i)
            if i in turns:
                new = coded[:m] & (order[:m] <= i) & ((i % span[:m] == 0) | (order[:m] == i))
                if new.any():
                    at = pos[:m][new]
                    got = take(at, wide[:m][new])
                    at = at + wide[:m][new]
                    full = got == (1 << wide[:m][new]) - 1
                    raw_bits[:m][new] = np.where(full, take(at, 5), -1)
                    pos[:m][new] = at + 5 * full
                    k[:m][new] = np.where(full, 0, got)
                    mask, room = (1 << k) - 1, 40 - k
                    escapes = bool((raw_bits >= 0).any())
            at = pos[:m]
            stop = next_one[at].astype(np.int64)
            after = stop + 1
            u = window[after >> 3] >> (room[:m] - (after & 7)) & mask[:m]
            u |= (stop - at) << k[:m]
            res = (u >> 1) ^ -(u & 1)
            after += k[:m]
            if escapes:
                e = raw_bits[:m]
                raw_now = np.flatnonzero(e >= 0)
                if len(raw_now):
                    n = e[raw_now]
                    res[raw_now] = np.where(n > 0, signed(take(at[raw_now], n), np.maximum(n, 1)), 0)
                    after[raw_now] = at[raw_now] + n
            if deepest and i:
                pred = C[0, :m] * X[i - 1, :m]
                for j in range(1, min(deepest, i)):
                    pred += C[j, :m] * X[i - 1 - j, :m]
                if shifted:
                    pred >>= shift[:m]
                res += pred
            if live is None:
                X[i, :m] = res
                pos[:m] = after
            else:
                X[i, :m] = np.where(live, res, X[i, :m])
                pos[:m] = np.where(live, after, at)
        if (coded & (pos > limit)).any():
            raise BrokenStream("a frame's residuals go beyond it")
    X <<= wasted
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n_frames
    for j, f in enumerate(rank.tolist()):
        out[f] = X[: size[j], j]
    return out


def decode_blocks(streams: list[bytes]):
    """(stream, block, sample offset, byte offset, samples) in order, verified; ``SEGMENT_FRAMES`` frames at a time."""
    pending: list[tuple[int, int, int, int, bytes, int]] = []
    digests, bit_depth = {}, 0
    totals: dict[int, int] = {}

    def flush():
        if not pending:
            return
        data = np.frombuffer(b"".join(p[4] for p in pending), np.uint8)
        ends = np.cumsum([len(p[4]) for p in pending])
        starts = np.concatenate([[0], ends[:-1]])
        found = decode_frames(data, starts, ends, bit_depth)
        for (s, block, sample, place, _, _), x in zip(pending, found, strict=True):
            digests[s][0].update(x.astype("<i2" if bit_depth > 8 else np.int8).tobytes())
            totals[s] += len(x)
            yield s, block, sample, place, x
        pending.clear()

    for s, data in enumerate(streams):
        stream = Stream(data)
        if bit_depth != stream.bits:
            yield from flush()
            bit_depth = stream.bits
        digests[s], totals[s] = (hashlib.md5(usedforsecurity=False), stream), 0
        frames = find_frames(data, stream)
        edges = [f[0] for f in frames[1:]] + [len(data)]
        for block, ((place, sample), end) in enumerate(zip(frames, edges, strict=True)):
            pending.append((s, block, sample, place, data[place:end], 0))
            if len(pending) >= SEGMENT_FRAMES:
                yield from flush()
    yield from flush()
    for s, (digest, stream) in digests.items():
        if totals[s] != stream.total or digest.digest() != stream.md5:
            raise BrokenStream(f"stream {s} doesn't hold the samples that it states")


def payload_of(text: bytes) -> bytes:
    """``text`` filled up with bytes 0 to a positive multiple of ``PAD``."""
    return text + bytes(-len(text) % PAD if text else PAD)


def encode_column(docs: DataFrame, block: int = BLOCK_SAMPLES) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a FLAC stream."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in _runs([len(t) for t in texts]):
                part = texts[a:b]
                media = encode_many([payload_of(t) for t in part], block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _runs(sizes: list[int], most: int = 8 << 20):
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n + 1
    if first < len(sizes):
        yield first, len(sizes)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, byte_offset, n_samples, pcm): the verified PCM blocks of (doc_id, media)."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "block", "sample_offset", "byte_offset", "n_samples", "pcm"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            keys, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for s, block, sample, place, x in decode_blocks(streams):
                rows.append((keys[s], block, sample, place, len(x), (x + 128).astype(np.uint8).tobytes()))
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample_offset long, byte_offset long, n_samples int, pcm binary")


class _Digest:
    """What op10 returns of one stream, block by block."""

    def __init__(self):
        self.sha, self.n, self.tail = hashlib.sha256(), 0, b""
        self.sum = self.squares = self.crossings = 0
        self.least, self.most, self.last = 127, -128, 0

    def add(self, x: np.ndarray) -> None:
        pcm = (x + 128).astype(np.uint8).tobytes()
        self.sha.update(pcm)
        self.n += len(pcm)
        self.tail = (self.tail + pcm)[-PAD:]
        self.sum += int(x.sum())
        self.squares += int((x * x).sum())
        sign = x < 0
        self.crossings += int((sign[1:] != sign[:-1]).sum()) + int(self.n > len(pcm) and (self.last < 0) != bool(sign[0]))
        self.last = int(x[-1])
        self.least, self.most = min(self.least, int(x.min())), max(self.most, int(x.max()))

    @property
    def feature(self) -> str:
        return f"mean={self.sum / self.n:.6f};rms={(self.squares / self.n) ** 0.5:.6f};crossings={self.crossings};min={self.least};max={self.most}"


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all read back from (doc_id, n_bytes, media)."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            streams = batch.column(2).to_pylist()
            found = [_Digest() for _ in streams]
            for s, _, _, _, x in decode_blocks(streams):
                found[s].add(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([d.n for d in found], pa.int64()),
                    pa.array([d.sha.hexdigest() for d in found], pa.string()),
                    pa.array([zlib.crc32(d.tail) for d in found], pa.int64()),
                    pa.array([len(m) for m in streams], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in streams], pa.string()),
                    pa.array([d.feature for d in found], pa.string()),
                ],
                names=[c.split()[0] for c in out.split(", ")],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, out)
