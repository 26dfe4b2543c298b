"""FLAC media columns: a vectorised encoder for bytes as 8-bit samples, and a decoder with checks.

The encoder chooses by frame among two fixed predictors and a linear one, whose coefficients follow
from the frame's autocorrelation. Both sides work on some thousand frames at a time, however long a
stream is. The decoder reads any FLAC stream of 4 to 16 bits, one or two channels: constant, verbatim, fixed
and LPC subframes, Rice and escaped partitions, wasted bits and stereo decorrelation. It verifies
the CRC-8 of frame headers, the CRC-16 of frames and the MD5 of the samples, and returns PCM with
the sample offset of each block. 8-bit mono frames, which the encoder writes, are decoded side by
side: one step takes the next Rice code, and one the next sample, of every frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import map_arrow, text_slices

FRAME = 576
#: Frames that are encoded or decoded together.
GROUP = 2048
#: Order of the linear predictor and bits of its coefficients.
ORDER, PRECISION = 4, 12
#: Samples of a PCM block at least; blocks begin at frames.
BLOCK = 64 * FRAME
_SPAN = 1 << 20
_RATES = (None, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000)
_SIZES = (None, 8, 12, None, 16, 20, 24, 32)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        crc = i << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CLZ16 = np.array([16 - x.bit_length() for x in range(1 << 16)], np.uint8)


def crc8(data: bytes) -> int:
    crc = 0
    for x in data:
        crc = int(_CRC8[crc ^ x])
    return crc


def crc16_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of ``data``; spans are aligned at their ends, as leading zeros don't count."""
    crc = np.zeros(len(start), np.uint16)
    longest = int((end - start).max()) if len(start) else 0
    if not longest:
        return crc
    padded = np.concatenate((np.zeros(1, np.uint8), data))
    for back in range(longest, 0, -1):
        at = end - back
        byte = padded[np.where(at >= start, at + 1, 0)]
        crc = _CRC16[(crc >> 8) ^ byte] ^ (crc << np.uint16(8))
    return crc


def _number(n: int) -> bytes:
    """Frame or sample number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail, extra = [], 0
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        extra += 1
        if n < 1 << (6 - extra):
            break
    return bytes([(0xFF << (7 - extra)) & 0xFF | n, *reversed(tail)])


def predictors(samples: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, shift) of each row's linear predictor, by Levinson's recursion, as whole numbers."""
    x = samples.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", x[:, lag:], x[:, : x.shape[1] - lag]) for lag in range(order + 1)], axis=1).astype(float)
    a, left = np.zeros((len(x), order)), r[:, 0] + 1e-3
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / left
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        left = np.maximum(left * (1 - k * k), 1e-3)
    most = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(np.floor(np.log2(((1 << PRECISION - 1) - 1) / most)), 0, 15).astype(np.int64)
    limit = 1 << PRECISION - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def _encode_frames(samples: np.ndarray, numbers: list[int]) -> tuple[bytes, np.ndarray]:
    """(bytes, bytes of each frame) of rows of signed 8-bit samples."""
    total = len(samples)
    coefficients, shift = predictors(samples)
    guess = sum(coefficients[:, i : i + 1].astype(np.int32) * samples[:, ORDER - 1 - i : FRAME - 1 - i] for i in range(ORDER)) >> shift[:, None].astype(np.int32)
    # each way of prediction: samples that are stored as they are, residuals, bits of its parameters
    ways = ((0, samples, 0), (1, np.diff(samples, axis=1), 0), (ORDER, samples[:, ORDER:] - guess, 9 + ORDER * PRECISION))
    best = None
    for way, (order, r, extra) in enumerate(ways):
        folded = np.where(r >= 0, 2 * r, -2 * r - 1)
        low, at = None, None
        for kk in range(0, 9):
            cost = (folded >> kk).sum(axis=1) + r.shape[1] * (kk + 1) + 8 * order + extra
            if low is None:
                low, at = cost, np.zeros(total, np.int64)
            else:
                at[cost < low] = kk
                low = np.minimum(cost, low)
        if best is None:
            best, k, chosen, codes = low, at, np.zeros(total, np.int64), [folded]
        else:
            better = low < best
            chosen[better], k[better], best = way, at[better], np.minimum(best, low)
            codes.append(folded)
    constant = (samples == samples[:, :1]).all(axis=1)
    order = np.array([w[0] for w in ways])[chosen]

    heads = [b"\xff\xf8\x20\x02" + (_HEADS[i] if i < len(_HEADS) else _number(i)) for i in numbers]
    head_size = np.fromiter(map(len, heads), np.int64, total) + 1
    # bytes of a frame: header, subframe byte, warm-up, parameters, 10 bits and the codes, CRC-16
    frame_size = head_size + 1 + np.where(constant, 1, order + (10 + best - 8 * order + 7) // 8) + 2
    start = np.cumsum(frame_size) - frame_size
    size = int(frame_size.sum())
    words = np.zeros(size // 8 + 2, np.uint64)
    body = (start + head_size + 1 + order) * 8
    for way, folded in enumerate(codes):
        rows = np.flatnonzero((chosen == way) & ~constant)
        if not len(rows):
            continue
        kk = k[rows][:, None]
        f = folded[rows].astype(np.int64)
        width = [np.full((len(rows), 1), 10, np.int64), (f >> kk) + 1 + kk]
        value = [kk, (np.int64(1) << kk) | (f & ((np.int64(1) << kk) - 1))]
        if ways[way][2]:
            width = [np.tile(np.array([4, 5, *[PRECISION] * ORDER]), (len(rows), 1)), *width]
            value = [np.full((len(rows), 1), PRECISION - 1), shift[rows][:, None], coefficients[rows] & (1 << PRECISION) - 1, *value]
        _put(words, (body[rows][:, None] + np.cumsum(np.concatenate(width, axis=1), axis=1)).ravel(), np.concatenate(value, axis=1).ravel())
    data = words.astype(">u8").view(np.uint8)[:size].copy()
    for i, head in enumerate(heads):
        at = int(start[i])
        data[at : at + len(head)] = np.frombuffer(head, np.uint8)
    crc = np.zeros(total, np.uint16)
    for j in range(int(head_size.max()) - 1):
        inside = j < head_size - 1
        crc[inside] = _CRC8[crc[inside] ^ data[start[inside] + j]]
    data[start + head_size - 1] = crc
    data[start + head_size] = np.where(constant, 0, np.array([8, 9, 31 + ORDER])[chosen] << 1)
    unsigned = (samples & 0xFF).astype(np.uint8)
    data[(start + head_size + 1)[constant]] = unsigned[constant, 0]
    for j in range(ORDER):
        rows = np.flatnonzero((order > j) & ~constant)
        data[start[rows] + head_size[rows] + 1 + j] = unsigned[rows, j]
    end = start + frame_size
    check = crc16_of(data, start, end - 2)
    data[end - 2], data[end - 1] = check >> 8, check & 0xFF
    return data.tobytes(), frame_size


def encode_bytes(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, a positive multiple of 576 bytes, as unsigned 8-bit samples."""
    frames = [len(p) // FRAME for p in payloads]
    whole = np.frombuffer(b"".join(payloads), np.uint8)
    numbers = [i for n in frames for i in range(n)]
    parts, sizes = [], []
    for at in range(0, len(numbers), GROUP):
        samples = (whole[at * FRAME : (at + GROUP) * FRAME] ^ 0x80).view(np.int8).reshape(-1, FRAME).astype(np.int32)
        data, size = _encode_frames(samples, numbers[at : at + GROUP])
        parts.append(data)
        sizes.append(size)
    coded, frame_size = b"".join(parts), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    end = np.cumsum(frame_size)
    start = end - frame_size
    out, at = [], 0
    for payload, n in zip(payloads, frames, strict=True):
        mine = slice(at, at + n)
        begin, stop = int(start[at]), int(end[at + n - 1])
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", FRAME, FRAME) + int(frame_size[mine].min()).to_bytes(3, "big") + int(frame_size[mine].max()).to_bytes(3, "big")
        info += (44100 << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed, usedforsecurity=False).digest()
        seek = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        seek["sample"], seek["offset"], seek["samples"] = np.arange(n) * FRAME, start[mine] - begin, FRAME
        # a metadata block holds 2**24 - 1 bytes; a longer seek table is left out, the frames are then found by their sync codes
        table = seek.tobytes() if seek.nbytes < 1 << 24 else b""
        meta = b"fLaC" + (b"\x00" if table else b"\x80") + len(info).to_bytes(3, "big") + info
        meta += b"\x83" + len(table).to_bytes(3, "big") + table if table else b""
        out.append(meta + coded[begin:stop])
        at += n
    return out


_HEADS = [_number(i) for i in range(512)]


def _put(words: np.ndarray, ends: np.ndarray, values: np.ndarray) -> None:
    """Ors each value into the bits that end at ``ends`` (ascending)."""
    values = values.astype(np.uint64)
    last = ends - 1
    word, shift = last >> 6, (63 - (last & 63)).astype(np.uint64)
    cuts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[cuts]] |= np.bitwise_or.reduceat(values << shift, cuts)
    spill = np.where(shift > 0, values >> ((np.uint64(64) - shift) & np.uint64(63)), 0).astype(np.uint64)
    over = np.flatnonzero(spill)
    if len(over):
        np.bitwise_or.at(words, word[over] - 1, spill[over])


class FlacError(ValueError):
    """A stream that isn't FLAC or fails a checksum."""


def _header(data: bytes, at: int):
    """(header length, block size, sample rate or None, channel code, bits or None, number) or None."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size_code, rate_code, channels, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if not size_code or rate_code == 15 or channels > 10 or bits_code == 3:
        return None
    p, lead = at + 4, data[at + 4]
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and not 1 <= extra <= 6 or p + extra + 6 > len(data):
        return None
    number = lead if lead < 0x80 else lead & ((1 << (6 - extra)) - 1)
    for x in data[p + 1 : p + 1 + extra]:
        if x & 0xC0 != 0x80:
            return None
        number = number << 6 | x & 0x3F
    p += 1 + extra
    if size_code == 1:
        size = 192
    elif size_code < 6:
        size = 576 << (size_code - 2)
    elif size_code == 6:
        size, p = data[p] + 1, p + 1
    elif size_code == 7:
        size, p = (data[p] << 8 | data[p + 1]) + 1, p + 2
    else:
        size = 256 << (size_code - 8)
    rate = None
    if rate_code == 12:
        rate, p = data[p] * 1000, p + 1
    elif rate_code > 12:
        rate, p = (data[p] << 8 | data[p + 1]) * (1 if rate_code == 13 else 10), p + 2
    elif rate_code:
        rate = _RATES[rate_code]
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    return p + 1 - at, size, rate, channels, _SIZES[bits_code], number


class _Bits:
    """Reads bits of a frame; the general, one-frame path."""

    def __init__(self, data: bytes, at: int) -> None:
        self.value, self.left = int.from_bytes(data[at:], "big"), 8 * (len(data) - at)
        self.size = self.left

    def take(self, n: int) -> int:
        if n > self.left:
            raise FlacError("frame ends early")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1) if n else 0

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        rest = self.value & ((1 << self.left) - 1)
        zeros = self.left - rest.bit_length()
        self.take(zeros + 1)
        return zeros


def _residual(bits: _Bits, order: int, size: int) -> list[int]:
    method = bits.take(2)
    if method > 1:
        raise FlacError("unknown residual coding")
    width, parts = 4 + method, bits.take(4)
    if size % (1 << parts) or size >> parts < order:
        raise FlacError("bad partition order")
    out: list[int] = []
    for part in range(1 << parts):
        n = (size >> parts) - (0 if part else order)
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                x = bits.unary() << k | bits.take(k)
                out.append(x >> 1 ^ -(x & 1))
    return out


def _subframe(bits: _Bits, size: int, depth: int) -> list[int]:
    if bits.take(1):
        raise FlacError("bad subframe header")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > size:
            raise FlacError("order above block size")
        out = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            # fixed values: coefficients of the fixed predictors, latest sample first
            weights, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
        else:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            if precision == 16 or shift < 0:
                raise FlacError("bad predictor")
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, order, size):
            n = len(out)
            out.append(r + (sum(w * out[n - 1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise FlacError("reserved subframe")
    return [x << wasted for x in out] if wasted else out


def _narrow(samples: list) -> np.ndarray:
    try:
        return np.array(samples, np.int32)
    except OverflowError:
        raise FlacError("samples beyond 32 bits") from None


def _frame(data: bytes, head, depth: int) -> np.ndarray:
    """Samples (size, channels) of one frame, by the general path."""
    length, size, _, code, own, _ = head
    depth = own or depth
    bits = _Bits(data[:-2], length)
    if code < 8:
        return _narrow([_subframe(bits, size, depth) for _ in range(code + 1)]).T
    first = _narrow(_subframe(bits, size, depth + (code == 9)))
    second = _narrow(_subframe(bits, size, depth + (code != 9)))
    if code == 8:
        return np.stack((first, first - second), axis=1)
    if code == 9:
        return np.stack((first + second, second), axis=1)
    middle = first << 1 | second & 1
    return np.stack(((middle + second) >> 1, (middle - second) >> 1), axis=1)


def _parse(data: bytes) -> dict:
    """STREAMINFO and the byte spans of the frames."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, info, seek, last = 4, None, None, False
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if len(body) < n:
            raise FlacError("metadata ends early")
        if kind == 0 and n == 34:
            packed = int.from_bytes(body[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            seek = np.frombuffer(body[: n - n % 18], [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        at += 4 + n
    if info is None:
        raise FlacError("no STREAMINFO")
    starts = None
    if seek is not None and len(seek) and info["samples"] and (seek["sample"] == np.concatenate(([0], np.cumsum(seek["samples"].astype(np.int64))[:-1]))).all() and int(seek["samples"].astype(np.int64).sum()) == info["samples"]:
        starts = at + seek["offset"].astype(np.int64)
    if starts is None:
        raw = np.frombuffer(data, np.uint8)[at:]
        sync = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] & 0xFE == 0xF8)) + at
        starts = _chain(data, [int(x) for x in sync if _header(data, int(x))], at)
    ends = np.concatenate((starts[1:], [len(data)])) if len(starts) else starts
    return info | {"starts": np.asarray(starts, np.int64), "ends": np.asarray(ends, np.int64)}


def _chain(data: bytes, found: list[int], at: int) -> np.ndarray:
    """Of header candidates those that frames begin at: each span to the next must have its CRC-16."""
    if at >= len(data):
        return np.zeros(0, np.int64)
    if not found or found[0] != at:
        raise FlacError("no frame header")
    raw, starts, i = np.frombuffer(data, np.uint8), [], 0
    while i < len(found):
        begin = found[i]
        for j in range(i + 1, len(found) + 1):
            end = found[j] if j < len(found) else len(data)
            if end - begin > 8 and int(crc16_of(raw, np.array([begin]), np.array([end - 2]))[0]) == int.from_bytes(data[end - 2 : end], "big"):
                starts.append(begin)
                i = j
                break
        else:
            raise FlacError("frame checksum")
    return np.array(starts, np.int64)


def decode_streams(streams: list[bytes | None]) -> list[dict | str | None]:
    """For each stream its info with ``pcm`` (int32, samples by channels) and ``offsets``, the first
    sample of each frame; a message where the stream is malformed; None for None."""
    parsed: list = []
    for data in streams:
        try:
            parsed.append(None if data is None else _parse(data))
        except FlacError as error:
            parsed.append(str(error))
    good = [i for i, p in enumerate(parsed) if isinstance(p, dict)]
    joined = np.frombuffer(b"".join(streams[i] for i in good) + bytes(8), np.uint8)
    base = np.cumsum([0, *(len(streams[i]) for i in good)])
    where, begin, end = [], [], []
    for g, i in enumerate(good):
        where += [i] * len(parsed[i]["starts"])
        begin.append(parsed[i]["starts"] + base[g])
        end.append(parsed[i]["ends"] + base[g])
    begin, end = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (begin, end))
    size_ok = end - begin > 8
    tails = np.where(size_ok, end - 2, begin)
    check = np.concatenate([crc16_of(joined, begin[a : a + GROUP], tails[a : a + GROUP]) for a in range(0, len(begin), GROUP)]) if len(begin) else np.zeros(0, np.uint16)
    sound = size_ok & (check == (joined[np.maximum(end - 2, 0)].astype(np.uint16) << 8 | joined[np.maximum(end - 1, 0)]))
    heads = [None] * len(begin)
    for f in range(len(begin)):
        a, b = int(begin[f]), int(end[f])
        heads[f] = _header(joined[a : min(b, a + 20)].tobytes() + bytes(2), 0) if sound[f] else None
    frames: list = [None] * len(begin)
    fast: dict[int, list[int]] = {}
    for f, head in enumerate(heads):
        if head is None:
            frames[f] = FlacError("frame checksum")
            continue
        kind = int(joined[begin[f] + head[0]])
        depth = head[4] or parsed[where[f]]["depth"]
        if head[3] == 0 and depth == 8 and kind & 1 == 0 and (8 <= kind >> 1 <= 12 or 32 <= kind >> 1 <= 43) and 12 < head[1] <= 4608:
            fast.setdefault(head[1], []).append(f)
            continue
        try:
            frames[f] = _frame(joined[begin[f] : end[f]].tobytes(), head, parsed[where[f]]["depth"])
        except FlacError as error:
            frames[f] = error
    for size, chosen in ((size, found[at : at + GROUP]) for size, found in fast.items() for at in range(0, len(found), GROUP)):
        at = np.array(chosen)
        lengths = np.array([heads[f][0] for f in chosen])
        low, high = int(begin[at].min()), int(end[at].max())
        samples, bad = _side_by_side(joined[low : high + 8], begin[at] + lengths - low, end[at] - 2 - low, size)
        for n, f in enumerate(chosen):
            if bad[n]:
                try:
                    frames[f] = _frame(joined[begin[f] : end[f]].tobytes(), heads[f], 8)
                except FlacError as error:
                    frames[f] = error
            else:
                frames[f] = samples[n][:, None]
    per: dict[int, list] = {i: [] for i in good}
    for f, i in enumerate(where):
        per[i].append(frames[f])
    for i in good:
        parsed[i] = _finish(parsed[i], per[i])
    return parsed


def _finish(info: dict, frames: list) -> dict | str:
    for x in frames:
        if isinstance(x, FlacError):
            return str(x)
    if any(x.shape[1] != info["channels"] for x in frames):
        return "channels differ from STREAMINFO"
    pcm = np.concatenate(frames) if frames else np.zeros((0, info["channels"]), np.int32)
    if info["samples"] and len(pcm) != info["samples"]:
        return "samples differ from STREAMINFO"
    kind = np.int8 if info["depth"] <= 8 else "<i2" if info["depth"] <= 16 else None
    if kind is None:
        return "more than 16 bits a sample"
    if any(info["md5"]) and hashlib.md5(pcm.astype(kind).tobytes(), usedforsecurity=False).digest() != info["md5"]:
        return "MD5 of the samples"
    return info | {"pcm": pcm, "offsets": np.cumsum([0, *map(len, frames)])[:-1]}


def _side_by_side(data: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frame, size) of 8-bit mono frames with fixed or linear predictors, whose subframes begin at ``at``.

    Each step reads one Rice code of all frames. Frames that it can't follow (escapes, codes of over
    24 bits of zeros, five-bit parameters, an end too early) are marked bad for the general path.
    """
    n = len(at)
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    packed = wide[:-3].astype(np.uint32) << 24
    packed |= wide[1:-2].astype(np.uint32) << 16
    packed |= wide[2:-1].astype(np.uint32) << 8
    packed |= wide[3:]
    kind = (data[at] >> 1).astype(np.int64)
    linear = kind >= 32
    order = np.where(linear, kind - 31, kind - 8)
    top = int(order.max())
    bit = (at + 1 + order) * 8
    limit = end * 8

    def peek(p: np.ndarray) -> np.ndarray:
        return packed[np.minimum(p >> 3, len(packed) - 1)] << (p & 7).astype(np.uint32)

    def field(p: np.ndarray, width: int) -> np.ndarray:
        return (peek(p) >> np.uint32(32 - width)).astype(np.int64)

    precision, shift = field(bit, 4) + 1, field(bit + 4, 5)
    bad = linear & ((precision == 16) | (shift > 15))
    weights = np.zeros((top, n), np.int64)
    for j in range(top if linear.any() else 0):
        raw = (peek(bit + 9 + j * precision) >> (32 - precision).astype(np.uint32)).astype(np.int64)
        weights[j] = np.where(linear & (j < order), raw - ((raw >> (precision - 1)) << precision), 0)
    bit = np.where(linear, bit + 9 + order * precision, bit)
    bad |= field(bit, 2) != 0
    parts = field(bit + 2, 4)
    bit = bit + 6
    bad |= (size % (1 << parts) != 0) | (size >> parts < np.maximum(order, 1))
    span = size >> np.minimum(parts, size.bit_length() - 1)
    span = np.maximum(span, 1)
    out = np.zeros((size, n), np.int32)
    k = np.zeros(n, np.int64)
    single = bool((parts == 0).all())
    for step in range(size):
        on = step >= order
        fresh = (step == order) | (on & (step % span == 0)) if not single else step == order
        if fresh.any():
            value = field(bit, 4)
            k = np.where(fresh, value, k)
            bit = np.where(fresh, bit + 4, bit)
            bad |= fresh & (value == 15)
        window = peek(bit)
        high = window >> np.uint32(16)
        zeros = _CLZ16[high].astype(np.int64)
        if (zeros == 16).any():
            zeros = np.where(zeros == 16, 16 + _CLZ16[window & np.uint32(0xFFFF)], zeros)
            bad |= on & (zeros > 24)
        rest = bit + zeros + 1
        low = (peek(rest) >> np.uint32(1)).astype(np.int64) >> (31 - k)
        code = zeros << k | low
        value = code >> 1 ^ -(code & 1)
        if step < top:
            out[step] = np.where(on, value, 0)
            bit = np.where(on, rest + k, bit)
        else:
            out[step] = value
            bit = rest + k
        if step % 64 == 63:
            bad |= bit > limit
            bit = np.minimum(bit, limit)
    bad |= bit > limit
    warm = np.stack([data[np.minimum(at + 1 + j, len(data) - 1)].view(np.int8).astype(np.int32) for j in range(max(top, 1))], axis=1)
    for o in np.unique(order[linear]).tolist():
        rows = np.flatnonzero(linear & (order == o))
        run, own, by = out[:, rows].astype(np.int64), weights[:o, rows], shift[rows]
        run[:o] = warm[rows, :o].T
        for step in range(o, size):
            # latest sample first, as the weights are
            run[step] += (own * run[step - o : step][::-1]).sum(axis=0) >> by
        out[:, rows] = run
    samples = out.T.copy()
    for o in range(1, 5):
        rows = np.flatnonzero(~linear & (order == o))
        if not len(rows):
            continue
        tower = [warm[rows, :o]]
        for _ in range(1, o):
            tower.append(np.diff(tower[-1], axis=1))
        run = samples[rows, o:]
        for level in range(o - 1, -1, -1):
            run = np.cumsum(run, axis=1, dtype=np.int32) + tower[level][:, -1:]
        samples[rows, o:] = run
        samples[rows, :o] = warm[rows, :o]
    return samples, bad


def padded(text: str | None) -> bytes:
    """The text as UTF-8 (null: empty) with bytes 255 up to a positive multiple of 576."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def encode_column(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the padded text of each row as a FLAC stream of 8-bit samples.

    Null text is empty; repeated rows have equal streams, null ids stay, other columns are ignored,
    whatever their names, and an empty table stays empty. Long texts are coded some thousand frames
    at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, budget=2 << 20):
            texts = part.column("text").to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(encode_bytes([padded(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


INDEX = "array<struct<sample_offset:bigint,samples:bigint,byte_offset:bigint,bytes:bigint>>"


def decode_column(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decodes the FLAC streams of ``media``: adds sample_rate, channels, sample_bits, n_samples, pcm,
    seek, crossings, energy and error; columns other than ``keep`` (doc_id, media) are dropped.

    ``pcm`` is unsigned for 8 bits and signed little-endian for 16, interleaved; ``seek`` gives each
    block's sample and byte offsets in it. ``energy`` is the sum of squared samples, ``crossings``
    counts changes of sign in the first channel. A malformed stream, or one whose checksums fail,
    has an ``error`` and null samples; null media has nulls throughout. Repeated rows are decoded
    each; an empty table stays empty; of ``keep`` the columns with a name made here are replaced.
    """
    made = {"media", "sample_rate", "channels", "sample_bits", "n_samples", "pcm", "seek", "crossings", "energy", "error"}
    fields = [f for f in df.schema.fields if f.name in keep and f.name.lower() not in made]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("samples", pa.int64()), ("byte_offset", pa.int64()), ("bytes", pa.int64())]))
        for part in text_slices(batches, "media", 2 << 20):
            cols = {c: [] for c in ("sample_rate", "channels", "sample_bits", "n_samples", "pcm", "seek", "crossings", "energy", "error")}
            for got in decode_streams(part.column("media").to_pylist()):
                row = _row(got)
                for c in cols:
                    cols[c].append(row.get(c))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), kind, pa.int64(), pa.int64(), pa.string())
            arrays = [part.column(c) for c in names] + [part.column("media")] + [pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)]
            yield pa.record_batch(arrays, names=[*names, "media", *cols])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    schema += f"media binary, sample_rate long, channels int, sample_bits int, n_samples long, pcm binary, seek {INDEX}, crossings long, energy long, error string"
    return map_arrow(df.select(*(F.col(f"`{n}`") for n in names), "media"), run, schema)


def _row(got: dict | str | None) -> dict:
    if not isinstance(got, dict):
        return {"error": got}
    pcm, eight = got["pcm"], got["depth"] <= 8
    data = ((pcm + 128).astype(np.uint8) if eight else pcm.astype("<i2")).tobytes()
    wide = got["channels"] * (1 if eight else 2)
    cuts = [0]
    for x in got["offsets"].tolist():
        if x - cuts[-1] >= BLOCK:
            cuts.append(x)
    seek = [{"sample_offset": a, "samples": b - a, "byte_offset": a * wide, "bytes": (b - a) * wide} for a, b in zip(cuts, [*cuts[1:], len(pcm)], strict=True) if b > a]
    sign = pcm[:, 0] < 0
    return {
        "sample_rate": got["rate"], "channels": got["channels"], "sample_bits": got["depth"], "n_samples": len(pcm), "pcm": data, "seek": seek,
        "crossings": int((sign[1:] != sign[:-1]).sum()), "energy": sum(int(np.square(pcm[a : a + _SPAN], dtype=np.int64).sum()) for a in range(0, len(pcm), _SPAN)), "error": None,
    }


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """A row for each PCM block: doc_id, sample_offset, samples, pcm; seek by sample_offset.

    Streams without samples have no blocks; those of repeated rows repeat; null ids stay.
    """
    rows = decoded.where("pcm IS NOT NULL").select("doc_id", "pcm", F.explode("seek").alias("s"))
    return rows.select("doc_id", "s.sample_offset", "s.samples", F.expr("substring(pcm, CAST(s.byte_offset + 1 AS INT), CAST(s.bytes AS INT))").alias("pcm"))


def write_pcm(decoded: DataFrame, path: str) -> None:
    """Writes the blocks in order of doc_id and offset, so that a reader skips to those it wants."""
    pcm_blocks(decoded).sortWithinPartitions("doc_id", "sample_offset").write.parquet(path)


def read_samples(spark: SparkSession, path: str, doc_id: int, start: int, stop: int) -> DataFrame:
    """(sample_offset, samples, pcm) of the written blocks that hold samples ``start`` to ``stop`` of a document.

    The filters reach the scan, so other blocks' samples aren't read.
    """
    blocks = spark.read.schema("doc_id long, sample_offset long, samples long, pcm binary").parquet(path)
    inside = (F.col("doc_id") == doc_id) & (F.col("sample_offset") < stop) & (F.col("sample_offset") + F.col("samples") > start)
    return blocks.where(inside).select("sample_offset", "samples", "pcm")
