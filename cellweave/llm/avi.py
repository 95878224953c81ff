"""Motion-JPEG in AVI files as a column: write, parse, decode, and cut into shots.

Container. RIFF 'AVI ' with an hdrl list (avih, one strl of strh and strf), a movi list of '00dc' chunks and an idx1
index. Reading follows the index (offsets from the movi list or from the file), or walks movi where there is none.

Frames. Each frame is a baseline JPEG. The decoder reads quantisation and Huffman tables, frame and scan headers and
restart markers, and decodes entropy-coded data of many frames at once: every step takes one Huffman symbol of
every frame that isn't finished, so the work is done by array operations whatever the tables are. Components may be
interleaved and subsampled; pixels come from an exact inverse cosine transform.

Samples. `samples_to_avi` stores 8-bit samples losslessly: a sample is an 8 x 8 block of one value, its level-shifted
value is the block's DC coefficient (quantiser 8), and all AC coefficients are zero. Any decoder gives the sample
back as each of the block's pixels. The number of samples stands in the stream header chunk 'strd'.

Shots. Frame histograms over 16 bins of brightness are compared; a cut is where the difference is above the mean
plus `k` deviations of the differences seen in a window before it, and above a floor. Clips are timed rows.

Defined results: null texts are empty; equal texts give equal values; a file that isn't AVI gives an error string
and no frames; a truncated frame decodes up to its last whole block, the rest repeats the last value.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import table, text_or_empty


@dataclass(frozen=True)
class Params:
    width: int = 32  # samples per line
    height: int = 24
    fps: int = 25
    window: int = 12
    k: float = 3.0
    floor: float = 0.1


#: frames that are coded or decoded at once: bounds the working memory whatever a text's length
SLICE = 1400

# fixed values: the zigzag order of a block follows from its diagonals
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: how many DC codes each length has and their categories, fitted to the steps between bytes of running text
DC_BITS = (0, 3, 0, 3, 1, 1, 1) + (0,) * 9
DC_SYMBOLS = bytes((7, 4, 3, 5, 2, 1, 6, 0, 8))
AC_BITS = (1,) + (0,) * 15
AC_SYMBOLS = bytes((0,))


def _codes(bits, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) by the canonical rule of the JPEG standard."""
    found, code, i = {}, 0, 0
    for length, count in enumerate(bits, 1):
        for _ in range(count):
            found[symbols[i]] = (code, length)
            code, i = code + 1, i + 1
        code <<= 1
    return found


@cache
def _lookup(bits: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """For every 16 bits that may follow: length << 8 | symbol; 0 where no code fits."""
    table_ = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(bits, symbols).items():
        table_[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table_


# ---- writing ---------------------------------------------------------------------------------------------------


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


@cache
def _jpeg_head(width: int, height: int) -> bytes:
    quant = bytes([0]) + bytes([8] + [1] * 63)
    frame = struct.pack(">BHHB", 8, height * 8, width * 8, 1) + bytes([1, 0x11, 0])
    tables = bytes([0x00, *DC_BITS]) + DC_SYMBOLS + bytes([0x10, *AC_BITS]) + AC_SYMBOLS
    scan = bytes([1, 1, 0x00, 0, 63, 0])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDA, scan)


@cache
def _dc_words() -> tuple[np.ndarray, np.ndarray]:
    """(code bits, number of bits) of a block by its difference + 255: category, extra bits, end of block."""
    dc, (eob, eob_len) = _codes(DC_BITS, DC_SYMBOLS), _codes(AC_BITS, AC_SYMBOLS)[0]
    words, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = dc[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        words[d + 255] = (((code << category) | extra) << eob_len) | eob
        sizes[d + 255] = length + category + eob_len
    return words, sizes


def _scans(frames: np.ndarray) -> list[bytes]:
    """Entropy-coded data of frames(n, samples), stuffed, each padded with ones to whole bytes."""
    values = frames.astype(np.int64) - 128
    words, sizes = _dc_words()
    diff = np.diff(values, axis=1, prepend=0) + 255
    length = sizes[diff]
    total = length.sum(axis=1)
    whole = -(-total // 8)
    base = np.cumsum(whole) - whole
    start = np.cumsum(length, axis=1) - length + base[:, None] * 8
    # a word has at most 19 bits and so lies within 4 bytes
    shifted = words[diff].astype(np.uint64) << (32 - (start & 7) - length).astype(np.uint64)
    at, size = (start >> 3).ravel(), int(whole.sum()) + 4
    shifted = shifted.ravel()
    out = np.zeros(size, np.int64)
    for i in range(4):
        part = ((shifted >> np.uint64(24 - 8 * i)) & np.uint64(255)).astype(np.float64)
        out += np.bincount(at + i, part, minlength=size)[:size].astype(np.int64)
    out = out[: int(whole.sum())].astype(np.uint8)
    ends = base + whole
    pad = whole * 8 - total
    out[ends - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return [out[a:b].tobytes().replace(b"\xff", b"\xff\x00") for a, b in zip(base.tolist(), ends.tolist())]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _list(name: bytes, data: bytes) -> bytes:
    return _chunk(b"LIST", name + data)


def write_avi(frames: list[bytes], width: int, height: int, fps: int, extra: bytes = b"") -> bytes:
    """An AVI file of JPEG frames of width x height pixels; extra goes to 'strd'."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"strh", strh) + _chunk(b"strf", strf) + (_chunk(b"strd", extra) if extra else b"")
    chunks, index, at = [], [], 4
    for data in frames:
        chunks.append(_chunk(b"00dc", data))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(data)))
        at += len(chunks[-1])
    body = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", strl)) + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def samples_to_avi(payloads: list[bytes], params: Params = Params()) -> list[bytes]:
    """One AVI per payload of 8-bit samples; the last frame is filled up with its last sample."""
    per = params.width * params.height
    counts = [-(-len(p) // per) for p in payloads]
    padded = b"".join(p + p[-1:] * (c * per - len(p)) for p, c in zip(payloads, counts))
    frames = np.frombuffer(padded, np.uint8).reshape(-1, per)
    scans = [x for i in range(0, len(frames), SLICE) for x in _scans(frames[i : i + SLICE])]
    head = _jpeg_head(params.width, params.height)
    out, at = [], 0
    for payload, count in zip(payloads, counts):
        whole = [head + s + b"\xff\xd9" for s in scans[at : at + count]]
        out.append(write_avi(whole, params.width * 8, params.height * 8, params.fps, struct.pack("<4sQ", b"smpl", len(payload))))
        at += count
    return out


# ---- reading ---------------------------------------------------------------------------------------------------


@dataclass
class Avi:
    width: int = 0
    height: int = 0
    frame_us: int = 0
    extra: bytes = b""
    frames: list[bytes] = field(default_factory=list)


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks from at to end."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> Avi:
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found, movi, index = Avi(), None, None
    todo = [(12, len(data))]
    while todo:
        for name, start, size in _walk(data, *todo.pop()):
            if name == b"LIST":
                kind = data[start : start + 4]
                if kind == b"movi":
                    movi = (start, start + size)
                else:
                    todo.append((start + 4, start + size))
            elif name == b"avih" and size >= 40:
                found.frame_us, found.width, found.height = (int.from_bytes(data[start + i : start + i + 4], "little") for i in (0, 32, 36))
            elif name == b"strd":
                found.extra = data[start : start + size]
            elif name == b"idx1":
                index = (start, size)
    if movi is None:
        return found
    if index:
        entries = [struct.unpack_from("<4sIII", data, index[0] + i) for i in range(0, index[1] - 15, 16)]
        entries = [(offset, size) for name, _, offset, size in entries if name[2:] in (b"dc", b"db")]
        # offsets count from the list's kind, or from the start of the file
        base = movi[0] if entries and data[movi[0] + entries[0][0] + 2 : movi[0] + entries[0][0] + 4] in (b"dc", b"db") else 0
        found.frames = [data[base + o + 8 : base + o + 8 + n] for o, n in entries]
    else:
        found.frames = [data[s : s + n] for name, s, n in _walk(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return found


@dataclass
class Jpeg:
    width: int = 0
    height: int = 0
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)  # (id, h, v, quantiser)
    scan: dict = field(default_factory=dict)  # id -> (dc table, ac table)
    restart: int = 0
    data: tuple[int, int] = (0, 0)


@cache
def parse_jpeg_head(head: bytes) -> Jpeg:
    """The tables and headers up to and with the start of scan."""
    jpeg, at = Jpeg(), 2
    while at + 4 <= len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        data, at = head[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(data):
                wide, key = data[i] >> 4, data[i] & 15
                n = 128 if wide else 64
                values = np.frombuffer(data[i + 1 : i + 1 + n], ">u2" if wide else "u1")
                jpeg.quant[key] = values.astype(np.int64)
                i += 1 + n
        elif marker in (0xC0, 0xC1):
            jpeg.height, jpeg.width = struct.unpack(">HH", data[1:5])
            jpeg.parts = [(data[i], data[i + 1] >> 4, data[i + 1] & 15, data[i + 2]) for i in range(6, 6 + 3 * data[5], 3)]
        elif marker == 0xC4:
            i = 0
            while i < len(data):
                bits = tuple(data[i + 1 : i + 17])
                n = sum(bits)
                jpeg.tables[data[i]] = _lookup(bits, bytes(data[i + 17 : i + 17 + n]))
                i += 17 + n
        elif marker == 0xDD:
            jpeg.restart = int.from_bytes(data[:2], "big")
        elif marker == 0xDA:
            jpeg.scan = {data[1 + 2 * i]: (data[2 + 2 * i] >> 4, 16 | (data[2 + 2 * i] & 15)) for i in range(data[0])}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
    return jpeg


def _head_size(frame: bytes) -> int:
    at = 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        at += 2 + size
        if marker == 0xDA:
            return at
    raise ValueError("a JPEG without a scan")


def _intervals(frame: bytes, start: int, restart: int) -> list[bytes]:
    """The unstuffed entropy-coded data between restart markers."""
    end = frame.rfind(b"\xff\xd9")
    body = frame[start : end if end >= start else len(frame)]
    if not restart:
        return [body.replace(b"\xff\x00", b"\xff")]
    raw = np.frombuffer(body, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist() if len(raw) > 1 else []
    return [body[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip([0, *(m + 2 for m in marks)], [*marks, len(body)])]


def _dc_only(jpeg: Jpeg, words: np.ndarray, begin: np.ndarray, stop: np.ndarray, blocks: int) -> np.ndarray | None:
    """(pieces, blocks) of whole pieces of one component whose AC table knows the end of block alone; else None."""
    if len(jpeg.parts) != 1:
        return None
    key = jpeg.parts[0][0]
    ac, dc = jpeg.tables[jpeg.scan[key][1]], jpeg.tables[jpeg.scan[key][0]].astype(np.uint64)
    ends = np.unique(ac[ac > 0])
    if len(ends) != 1 or ends[0] & 255:
        return None
    eob = int(ends[0]) >> 8
    length, size = dc >> np.uint64(8), dc & np.uint64(255)
    # by category: the largest value whose leading bit is 0, and what to take off it
    limit = np.array([0] + [1 << (s - 1) for s in range(1, 17)], np.int64)
    shift = np.array([0] + [(1 << s) - 1 for s in range(1, 17)], np.int64)
    out = np.empty((blocks, len(begin)), np.int16)
    bit, value, fine = begin.copy(), np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
    mask = np.uint64(0xFFFFFFFF)
    longest = len(words) - 1
    for i in range(blocks):
        w = (words[np.minimum(bit >> 3, longest)].astype(np.uint64) << (bit & 7).astype(np.uint64)) & mask
        peek = (w >> np.uint64(16)).astype(np.int64)
        used, s = length[peek], size[peek]
        fine &= used > 0
        extra = (((w << used) & mask) >> (np.uint64(32) - s)).astype(np.int64)
        s = s.astype(np.int64)
        value = value + np.where(extra < limit[s], extra - shift[s], extra)
        out[i] = value
        bit = bit + used.astype(np.int64) + s + eob
    return out.T if (fine & (bit <= stop)).all() else None


def decode_coefficients(frames: list[bytes]) -> tuple[Jpeg, np.ndarray]:
    """(headers, coefficients) of frames that share one header: (frames, blocks, 64) in zigzag order, quantised.

    Where no block has an AC coefficient the last axis may have the DC coefficient alone.

    Blocks come in the order of the scan: by minimum coded unit, in it by component, then by row.
    """
    size = _head_size(frames[0])
    jpeg = parse_jpeg_head(frames[0][:size])
    wide, high = max(h for _, h, _, _ in jpeg.parts), max(v for *_, v, _ in jpeg.parts)
    units = -(-jpeg.width // (8 * wide)) * -(-jpeg.height // (8 * high))
    plan = [i for i, (key, h, v, _) in enumerate(jpeg.parts) if key in jpeg.scan for _ in range(h * v)]
    per_unit = len(plan)
    blocks = units * per_unit
    owner, first, pieces = [], [], []
    step = jpeg.restart * per_unit if jpeg.restart else blocks
    for f, frame in enumerate(frames):
        for j, piece in enumerate(_intervals(frame, size, jpeg.restart)):
            if j * step < blocks:
                owner.append(f)
                first.append(j * step)
                pieces.append(piece)
    owner, at_block = np.array(owner), np.array(first)
    last = np.minimum(at_block + step, blocks)
    # all pieces in one buffer, eight bytes apart, read as 32 bits from any bit
    data = np.frombuffer(b"".join(p + b"\0" * 8 for p in pieces), np.uint8).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    lengths = np.array([len(p) + 8 for p in pieces])
    begin = (np.cumsum(lengths) - lengths) * 8
    stop = begin + (lengths - 8) * 8
    if not jpeg.restart and (found := _dc_only(jpeg, words, begin, stop, blocks)) is not None:
        return jpeg, found.reshape(len(frames), blocks, 1)
    dc = np.stack([jpeg.tables[jpeg.scan[jpeg.parts[i][0]][0]] for i in range(len(jpeg.parts)) if jpeg.parts[i][0] in jpeg.scan])
    ac = np.stack([jpeg.tables[jpeg.scan[jpeg.parts[i][0]][1]] for i in range(len(jpeg.parts)) if jpeg.parts[i][0] in jpeg.scan])
    slot = np.array([sorted(set(plan)).index(i) for i in plan])
    out = np.zeros((len(frames), blocks, 64), np.int16)
    previous = np.zeros((len(pieces), dc.shape[0]), np.int64)
    bit, k, live = begin.copy(), np.zeros(len(pieces), np.int64), np.arange(len(pieces))
    one = dc.shape[0] == 1
    while len(live):
        pos = bit[live]
        peek = (words[pos >> 3] << (pos & 7).astype(np.uint32)) >> 16
        # 32 bits from a byte, shifted by up to 7, leave 25: enough for a code of 16
        is_dc = k[live] == 0
        comp = 0 if one else slot[at_block[live] % per_unit]
        found = np.where(is_dc, dc[comp, peek], ac[comp, peek])
        length, symbol = found >> 8, found & 255
        size_ = np.where(is_dc, symbol, symbol & 15)
        pos2 = pos + length
        extra = ((words[pos2 >> 3] << (pos2 & 7).astype(np.uint32)) >> 16).astype(np.int64) >> (16 - size_)
        value = np.where((size_ > 0) & (extra < (1 << np.maximum(size_ - 1, 0))), extra - (1 << size_) + 1, extra)
        fine = (length > 0) & (pos2 + size_ <= stop[live])
        run = np.where(is_dc, 0, symbol >> 4)
        target = k[live] + run
        sums = previous[live, comp] + np.where(is_dc, value, 0)
        previous[live, comp] = np.where(fine, sums, previous[live, comp])
        put = fine & (is_dc | (size_ > 0)) & (target < 64)
        out[owner[live][put], at_block[live][put], target[put]] = np.where(is_dc, sums, value)[put]
        over = ~is_dc & (symbol == 0)
        k[live] = np.where(over, 64, np.where(is_dc, 1, target + 1))
        bit[live] = pos2 + size_
        ended = k[live] >= 64
        at_block[live] += ended
        k[live] = np.where(ended, 0, k[live])
        live = live[fine & (at_block[live] < last[live])]
    for i in np.flatnonzero(at_block < last):  # a truncated piece: the rest repeats the last value
        for block in range(at_block[i], last[i]):
            comp = 0 if one else slot[block % per_unit]
            out[owner[i], block, 0] = previous[i, comp]
    return jpeg, out


@cache
def _cosines() -> np.ndarray:
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Pixels of frames with one common header: per component (frames, height, width), at the component's own size."""
    jpeg, coefficients = decode_coefficients(frames)
    wide, high = max(h for _, h, _, _ in jpeg.parts), max(v for *_, v, _ in jpeg.parts)
    across, down = -(-jpeg.width // (8 * wide)), -(-jpeg.height // (8 * high))
    c, out, at = _cosines(), [], 0
    if coefficients.shape[2] == 1:
        coefficients = np.pad(coefficients, ((0, 0), (0, 0), (0, 63)))
    per_unit = sum(h * v for key, h, v, _ in jpeg.parts if key in jpeg.scan)
    shaped = coefficients.reshape(len(frames), down, across, per_unit, 64)
    for key, h, v, q in jpeg.parts:
        if key not in jpeg.scan:
            continue
        own = shaped[:, :, :, at : at + h * v].astype(np.float64) * jpeg.quant[q]
        at += h * v
        block = np.zeros_like(own)
        block[..., ZIGZAG] = own
        block = block.reshape(*own.shape[:-1], 8, 8)
        pixels = np.clip(np.rint(np.einsum("xu,...uv,yv->...xy", c, block, c) + 128), 0, 255).astype(np.uint8)
        pixels = pixels.reshape(len(frames), down, across, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(len(frames), down * v * 8, across * h * 8)
        out.append(pixels)
    return out


def decode_samples(files: list[bytes]) -> list[tuple[bytes, Avi, np.ndarray]]:
    """(samples, container, samples by frame) of files that samples_to_avi wrote; all files' frames at once."""
    parsed = [parse_avi(f) for f in files]
    frames = [x for p in parsed for x in p.frames]
    out, at = [], 0
    values = [np.zeros((0, 0), np.uint8)]
    for i in range(0, len(frames), SLICE):
        jpeg, coefficients = decode_coefficients(frames[i : i + SLICE])
        values.append((coefficients[:, :, 0].astype(np.int64) * int(jpeg.quant[jpeg.parts[0][3]][0]) // 8 + 128).astype(np.uint8))
    values = np.concatenate(values[1:] or values)
    for p in parsed:
        own = values[at : at + len(p.frames)]
        at += len(p.frames)
        out.append((own.tobytes()[: struct.unpack("<4sQ", p.extra)[1]], p, own))
    return out


# ---- shots -----------------------------------------------------------------------------------------------------


def shot_starts(frames: np.ndarray, params: Params = Params()) -> list[int]:
    """First frames of the shots of frames(n, samples)."""
    n = len(frames)
    if not n:
        return []
    bins = (frames >> 4).astype(np.int64) + 16 * np.arange(n)[:, None]
    histograms = np.bincount(bins.ravel(), minlength=16 * n).reshape(n, 16) / frames.shape[1]
    steps = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    starts = [0]
    for i in range(len(steps)):
        past = steps[max(starts[-1], i - params.window) : i]
        limit = past.mean() + params.k * past.std() if len(past) else 0.0
        if steps[i] > max(limit, params.floor):
            starts.append(i + 1)
    return starts


def clips(files: DataFrame, params: Params = Params()) -> DataFrame:
    """files(id, data) -> a row per shot: (id, clip, first_frame, frames, start_us, end_us, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    avi = parse_avi(data or b"")
                    luma = [decode_frames([f])[0][0] for f in avi.frames]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((key, None, None, None, None, None, str(e)))
                    continue
                starts = shot_starts(np.stack([x.ravel() for x in luma]), params) if luma else []
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(luma)])):
                    rows.append((key, i, a, b - a, a * avi.frame_us, b * avi.frame_us, None))
            if rows:
                names = ["id", "clip", "first_frame", "frames", "start_us", "end_us", "error"]
                kinds = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kind = dict(files.dtypes)["id"]
    return files.select("id", F.col("data").cast("binary").alias("data")).mapInArrow(run, f"id {kind}, clip long, first_frame long, frames long, start_us long, end_us long, error string")


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of 192, and the length before."""
    raw = text.encode()
    return raw + b" " * ((-len(raw)) % 192 if raw else 192), len(raw)


def stored(docs: DataFrame, params: Params = Params(), chunk: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text) through an AVI and back: digests of what was stored and read, and the shots' times."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows_of(ids: list, payloads: list[tuple[bytes, int]]) -> list[tuple]:
        files = samples_to_avi([p for p, _ in payloads], params)
        out = []
        for key, (_, n), data, (back, avi, frames) in zip(ids, payloads, files, decode_samples(files)):
            starts = shot_starts(frames, params)
            ends = [*starts[1:], len(frames)]
            feature = f"{len(frames)} frames; " + ", ".join(f"{a * avi.frame_us}-{b * avi.frame_us}" for a, b in zip(starts, ends))
            out.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            done, ids, payloads, held = [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                payloads.append(payload_of(text))
                held += len(payloads[-1][0])
                if held >= chunk:
                    done += rows_of(ids, payloads)
                    ids, payloads, held = [], [], 0
            if ids:
                done += rows_of(ids, payloads)
            if done:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
