"""AVI motion-JPEG columns: lossless intra frames in RIFF, decoded again, with shots from histogram differences."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, documents

WIDTH = HEIGHT = 24
SAMPLES = WIDTH * HEIGHT
FPS = 25
#: Code length of each difference category 0 to 8, in the order of canonical codes; no code is all ones.
_LENGTHS = {6: 2, 7: 2, 3: 3, 4: 3, 5: 3, 0: 4, 1: 5, 2: 6, 8: 7}
_BLOCK = 4096  # frames that are coded side by side

_ORDER = sorted(_LENGTHS, key=lambda s: (_LENGTHS[s], list(_LENGTHS).index(s)))


def _codes() -> dict[int, int]:
    code, at, out = 0, 0, {}
    for s in _ORDER:
        code <<= _LENGTHS[s] - at
        at = _LENGTHS[s]
        out[s] = code
        code += 1
    return out


_CODES = _codes()
_CATEGORY = np.array([0] + [int(d).bit_length() for d in range(1, 256)])
_CODE_OF = np.array([_CODES[s] for s in range(9)])
_SIZE_OF = np.array([_LENGTHS[s] for s in range(9)])


def jpeg_header(width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """SOI, DHT, SOF3 (lossless, 8 bits, one component) and SOS with predictor 1."""
    counts = bytes(sum(_LENGTHS[s] == n for s in _ORDER) for n in range(1, 17))
    table = b"\0" + counts + bytes(_ORDER)
    frame = struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)
    scan = bytes([1, 1, 0, 1, 0, 0])
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xC4, table) + part(0xC3, frame) + part(0xDA, scan)


_HEADER = jpeg_header()


def _pack_bits(diff: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes (FF stuffed) of each row of differences."""
    n, width = diff.shape
    kind = _CATEGORY[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << kind) - 1, diff)
    code = (_CODE_OF[kind] << kind) | extra
    size = _SIZE_OF[kind] + kind
    bits = size.sum(axis=1)
    length = -(-bits // 8)
    base = np.concatenate([[0], np.cumsum(length)])
    at = np.cumsum(size, axis=1) - size + 8 * base[:-1, None]
    shifted = code << (24 - (at & 7) - size)
    where = (at >> 3).ravel()
    total = int(base[-1]) + 3
    out = np.bincount(where, (shifted >> 16).ravel(), total)
    out[1:] += np.bincount(where, ((shifted >> 8) & 255).ravel(), total)[:-1]
    out[2:] += np.bincount(where, (shifted & 255).ravel(), total)[:-2]
    out = out[: base[-1]].astype(np.uint8)
    tail = base[1:] - 1  # ones fill up the last byte
    out[tail] |= ((1 << (8 * length - bits)) - 1).astype(np.uint8)
    full = np.flatnonzero(out == 255)
    stuffed = np.insert(out, full + 1, 0)
    ends = base + np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(base, full, "right") - 1, minlength=n))])[: n + 1]
    raw = stuffed.tobytes()
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A lossless JPEG of each row of SAMPLES bytes."""
    out: list[bytes] = []
    for i in range(0, len(samples), _BLOCK):
        x = samples[i : i + _BLOCK].astype(np.int64).reshape(-1, HEIGHT, WIDTH)
        guess = np.empty_like(x)
        guess[:, :, 1:] = x[:, :, :-1]
        guess[:, 1:, 0] = x[:, :-1, 0]
        guess[:, 0, 0] = 128
        out += [_HEADER + e + b"\xff\xd9" for e in _pack_bits((x - guess).reshape(len(x), -1))]
    return out


@dataclass(frozen=True)
class Frame:
    """What a lossless frame's markers say: where its scan starts, its size, and its code table as lookups."""

    start: int
    height: int
    width: int
    bits: int
    size: np.ndarray  # code length by the next `bits` bits; 0: no such code
    kind: np.ndarray


def _lookups(counts: bytes, symbols: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    bits = max((n + 1 for n, c in enumerate(counts) if c), default=0)
    size, kind = np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, np.uint8)
    code, at = 0, 0
    for n in range(1, bits + 1):
        for _ in range(counts[n - 1]):
            span = slice(code << (bits - n), (code + 1) << (bits - n))
            size[span], kind[span] = n, symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return bits, size, kind


@lru_cache(256)
def _markers(head: bytes) -> Frame:
    """Reads every marker up to the scan. Lossless frames (SOF3) of one 8-bit component with predictor 1 are decoded."""
    at, table, shape = 2, None, None
    while at + 4 <= len(head) and head[at] == 0xFF:
        mark, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            break
        if mark == 0xC4:
            if len(body) != 17 + sum(body[1:17]) or max(body[17:], default=0) > 8:
                raise ValueError("more than one code table, or one of more than 8 bits")
            table = _lookups(body[1:17], body[17:])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            precision, height, width, components = struct.unpack_from(">BHHB", body)
            if (mark, precision, components) != (0xC3, 8, 1) or not height or not width:
                raise ValueError("not a lossless frame of one 8-bit component")
            shape = height, width
        elif mark == 0xDD and body != b"\0\0":
            raise ValueError("restart intervals")
        elif mark == 0xDA:
            if table is None or shape is None or not table[0] or (body[0], body[3], body[5]) != (1, 1, 0):
                raise ValueError("no table or size before the scan, or another predictor than 1")
            return Frame(at + 2 + size, *shape, *table)
        at += 2 + size
    raise ValueError("markers end before the scan")


def _frame_of(jpeg: bytes) -> tuple[bytes, Frame]:
    """The part before the entropy-coded samples, and what it says."""
    if jpeg.startswith(_HEADER) and jpeg.endswith(b"\xff\xd9"):
        return _HEADER, _markers(_HEADER)
    if jpeg[:2] != b"\xff\xd8" or jpeg[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG")
    scan = jpeg.find(b"\xff\xda")
    if not 0 < scan <= len(jpeg) - 4:
        raise ValueError("no scan")
    head = jpeg[: scan + 2 + struct.unpack_from(">H", jpeg, scan + 2)[0]]
    return head, _markers(head)


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """The samples of each frame, for frames of one size and table. All of a block advance together, sample by sample."""
    parts = []
    for i in range(0, len(jpegs), _BLOCK):
        heads = [_frame_of(j) for j in jpegs[i : i + _BLOCK]]
        frame = heads[0][1]
        if any(f is not frame for _, f in heads):
            raise ValueError("frames of several sizes or tables")
        scans = [j[frame.start : -2] for j in jpegs[i : i + _BLOCK]]
        n, samples = len(scans), frame.height * frame.width
        sizes = np.array([len(s) for s in scans])
        raw = np.frombuffer(b"".join(scans) + b"\0" * 5, np.uint8)
        start = np.concatenate([[0], np.cumsum(sizes)])
        stuffed = np.flatnonzero((raw[1:-5] == 0) & (raw[:-6] == 255)) + 1 if len(raw) > 6 else np.zeros(0, int)
        plain = np.delete(raw, stuffed).astype(np.int64)
        ends = start[1:] - np.searchsorted(stuffed, start[1:])
        start = start[:-1] - np.searchsorted(stuffed, start[:-1])
        window = (plain[:-4] << 32) | (plain[1:-3] << 24) | (plain[2:-2] << 16) | (plain[3:-1] << 8) | plain[4:]
        at, bits = start * 8, frame.bits
        diff = np.empty((samples, n), np.int64)
        for k in range(samples):
            w = window[np.minimum(at >> 3, len(window) - 1)] << (at & 7)
            top = (w >> (40 - bits)) & ((1 << bits) - 1)
            size, kind = frame.size[top].astype(np.int64), frame.kind[top].astype(np.int64)
            extra = (w >> (40 - size - kind)) & ((1 << kind) - 1)
            diff[k] = np.where(extra < (1 << kind) >> 1, extra - (1 << kind) + 1, extra)
            at += size + kind
        if (at > ends * 8).any() or (at <= ends * 8 - 8).any():
            raise ValueError("a scan ends before or after its samples")
        d = diff.T.reshape(n, frame.height, frame.width)
        first = 128 + np.cumsum(d[:, :, 0], axis=1)
        d[:, :, 0] = first
        parts.append((np.cumsum(d, axis=2) & 255).astype(np.uint8).reshape(n, samples))
    return np.concatenate(parts) if parts else np.zeros((0, SAMPLES), np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(jpegs: list[bytes], fps: int = FPS) -> bytes:
    """RIFF AVI with hdrl, movi and idx1."""
    n, largest = len(jpegs), max(map(len, jpegs), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    body, index, at = [b"movi"], [], 4
    for j in jpegs:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        body.append(_chunk(b"00dc", j))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], int]:
    """The video frames that idx1 lists (without one: those in movi, in order), and microseconds a frame.

    Unknown chunks are passed over; offsets may count from movi or from the file's start. ValueError for anything else.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    at, movi, end, index, micro = 12, -1, 0, b"", 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi, end = at + 8, min(at + 8 + size, len(data))
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl" and len(data) >= at + 24:
            micro = struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi < 0:
        raise ValueError("no movi list")
    frames, at = [], movi + 4
    if index:
        for name, _, off, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
            if name[2:] in (b"dc", b"db"):
                base = movi if data[movi + off : movi + off + 4] == name else 0
                if data[base + off : base + off + 4] != name or base + off + 8 + size > len(data):
                    raise ValueError("the index points to no frame")
                frames.append(data[base + off + 8 : base + off + 8 + size])
    else:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name[2:] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return frames, micro


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // SAMPLES)) * SAMPLES - len(raw))


def histograms(frames: np.ndarray) -> np.ndarray:
    """Share of a frame's samples in each of 16 bins, for frames of one size."""
    hist = np.zeros((len(frames), 16))
    for i in range(0, len(frames), _BLOCK):
        part = frames[i : i + _BLOCK] >> 4
        hist[i : i + len(part)] = np.bincount((part + np.arange(len(part))[:, None] * 16).ravel(), minlength=16 * len(part)).reshape(-1, 16)
    return hist / max(1, frames.shape[1])


def shots(hist: np.ndarray, doc: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.35) -> np.ndarray:
    """Whether each frame starts a shot, by the frames' histograms and the document of each.

    A frame's change is half the L1 distance of its histogram to that of the frame before (0 to 1). It starts a shot
    where that is at least floor and over mean + factor x deviation of up to `window` changes before it in its
    document; a document's first frame always does.
    """
    n = len(hist)
    change = np.zeros(n)
    change[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    change[first] = 0
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    low = np.maximum(begin + 1, np.arange(n) - window)
    count = np.maximum(np.arange(n) - low, 0)
    one, two = (np.concatenate([[0], np.cumsum(change**p)]) for p in (1, 2))
    here = np.arange(n)
    low = np.minimum(low, here)
    mean = (one[here] - one[low]) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum((two[here] - two[low]) / np.maximum(count, 1) - mean**2, 0))
    return first | ((change >= floor) & (change > mean + factor * spread + 1e-9))


def _media(texts: list[str | None]) -> tuple[list[tuple[int, bytes]], list[bytes]]:
    loads = [payload(t) for t in texts]
    samples = np.frombuffer(b"".join(p for _, p in loads), np.uint8).reshape(-1, SAMPLES)
    jpegs, at, out = encode_frames(samples), 0, []
    for _, p in loads:
        n = len(p) // SAMPLES
        out.append(write_avi(jpegs[at : at + n]))
        at += n
    return loads, out


def to_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as an AVI of lossless frames. Null and empty texts: one frame of 255."""
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loads, media = _media(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in loads], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _looked_at(media: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Histograms and mean levels of a file's frames, and microseconds a frame."""
    jpegs, micro = read_avi(media)
    kinds = [_frame_of(j)[1] for j in jpegs]
    hist, level = np.zeros((len(jpegs), 16)), np.zeros(len(jpegs))
    for kind in set(map(id, kinds)):
        at = [i for i, k in enumerate(kinds) if id(k) == kind]
        frames = decode_frames([jpegs[i] for i in at])
        hist[at], level[at] = histograms(frames), frames.mean(axis=1)
    return hist, level, micro


def clips(spark: SparkSession, media: DataFrame) -> DataFrame:
    """doc_id, clip, start_ms, end_ms, n_frames, mean_level, error: a row a shot, in time order.

    Null media gives no rows, a file without frames neither. Media that can't be read gives one row with nothing but
    doc_id and error: other values go on. Repeated rows give their clips again; an empty table gives no rows.
    """
    bound_batches(spark)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string()]
    names = ["doc_id", "clip", "start_ms", "end_ms", "n_frames", "mean_level", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m is None:
                    continue
                try:
                    hist, level, micro = _looked_at(m)
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((d, None, None, None, None, None, str(e)))
                    continue
                marks = [*np.flatnonzero(shots(hist, np.zeros(len(hist)))).tolist(), len(hist)]
                for k, (a, b) in enumerate(pairwise(marks)):
                    rows.append((d, k, a * micro // 1000, b * micro // 1000, b - a, float(level[a:b].mean()), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_ms long, end_ms long, n_frames int, mean_level double, error string")


def media_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores and reads back every text in one pass; all digests but media's are of the decoded samples.

    Null and empty texts are one frame of 255; null and repeated doc_ids are rows like any others; other columns play
    no part; an empty table gives no rows.

    feature: number of shots, then the document's mean 16-bin histogram in 1/255, as hexadecimal digits.
    """
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loads, media = _media(batch.column(1).to_pylist())
            frames_of = [read_avi(m)[0] for m in media]
            frames = decode_frames([j for js in frames_of for j in js])
            counts = [len(js) for js in frames_of]
            hist = histograms(frames)
            cut = shots(hist, np.repeat(np.arange(len(counts)), counts))
            raw, at, rows = frames.tobytes(), 0, []
            for (n, _), m, k in zip(loads, media, counts, strict=True):
                back = raw[at * SAMPLES : (at + k) * SAMPLES]
                level = np.round(hist[at : at + k].mean(axis=0) * 255).astype(np.uint8).tobytes().hex()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{int(cut[at : at + k].sum())}:{level}", k))
                at += k
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], NAMES)

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long",
    )


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames"]


def op4_avi_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark, documents(spark, sf_dir))
