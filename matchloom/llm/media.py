"""Progressive JPEG: texts stored in DCT coefficients, read back scan by scan, and decoded to RGB tensors.

Storing: a payload byte is one quantised coefficient, the format's unit. An AC byte b is the value b, or b - 255 below 128: a
number of eight bits whose JPEG code is the byte itself. A DC byte is the value b. Blocks fill a 4:2:0 image, first luma, then
both chroma planes. The scan script is progressive: DC with one bit left over, luma AC in two spectral bands and
chroma AC in one, each with one bit left over, then refinements of that bit for DC and AC.

Reading: scans of any progressive script (spectral selection and successive approximation, any Huffman tables) are
accumulated into coefficient arrays by the general decoder; scans whose codes all have the same length, such as the
ones written here, take a vectorised path that gives the same arrays (tested). Coefficients go through an inverse
transform in numpy, chroma is upsampled, and the result is an RGB tensor of full resolution. features() returns the tensors as a
column beside the digests of the payload, and computes its feature from their bytes, so whoever writes its rows stores them.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.store import small_batches, written
from matchloom.llm.words import as_bytes, slices

#: Bytes of a block; payloads are padded to a positive multiple of it.
UNIT = 64
#: The category of AC values with one bit left over: eight bits less one.
SIZE = 7
#: Longest run of blocks in a refinement scan that one code covers.
MAX_RUN = 32767


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in diagonal order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.array([[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
#: Samples of a block from its coefficients in zigzag order.
INVERSE = np.kron(_K, _K)[ZIGZAG].astype(np.float32)


class Scan(NamedTuple):
    """Components (by number), spectral band and bit positions of a scan."""

    parts: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int


SCRIPT = (Scan((0, 1, 2), 0, 0, 0, 1), Scan((0,), 1, 31, 0, 1), Scan((0,), 32, 63, 0, 1), Scan((1,), 1, 63, 0, 1), Scan((2,), 1, 63, 0, 1), Scan((0, 1, 2), 0, 0, 1, 0), Scan((0,), 1, 63, 1, 0), Scan((1,), 1, 63, 1, 0), Scan((2,), 1, 63, 1, 0))

# --- Writing ---------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, codes: list[tuple[int, list[int]]]) -> bytes:
    """A Huffman table from (code length, symbols) in order of length."""
    counts = [0] * 16
    for length, symbols in codes:
        counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind, *counts, *[s for _, symbols in codes for s in symbols]]))


# DC: all categories in four bits. AC: the one value category in one bit, ends of bands in five.
DC_CODES = [(4, list(range(12)))]
AC_CODES = [(1, [SIZE]), (5, [n << 4 for n in range(15)])]
TABLES = _table(0x00, DC_CODES) + _table(0x10, AC_CODES)


def _stuffed(data: np.ndarray) -> bytes:
    """Entropy-coded bytes with a zero after each 0xFF."""
    at = np.flatnonzero(data == 0xFF)
    return (np.insert(data, at + 1, 0) if len(at) else data).tobytes()


def _packed(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones."""
    return _stuffed(np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])))


def _mcu_order(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """One value a block, in the order of an interleaved scan: a row of six a unit."""
    four = y.reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    return np.concatenate([four, cb.reshape(-1, 1), cr.reshape(-1, 1)], axis=1)


def _dc_first(mcus: np.ndarray) -> bytes:
    """Differences to the block before of the same component: category in four bits, then its bits."""
    v = mcus.astype(np.int64)
    y = v[:, :4].reshape(-1)
    d = np.concatenate([np.diff(y, prepend=0).reshape(-1, 4), np.diff(v[:, 4], prepend=0)[:, None], np.diff(v[:, 5], prepend=0)[:, None]], axis=1).reshape(-1)
    size = np.frexp(np.abs(d).astype(np.float64))[1].astype(np.int64)
    value = np.where(d < 0, d + (1 << size) - 1, d)
    length = 4 + size
    word = size << size | value
    ends = np.cumsum(length)
    total = int(ends[-1])
    # Bit i of the stream is bit (end - 1 - i) of its code.
    owner = np.repeat(np.arange(len(d)), length)
    return _packed((word[owner] >> (ends[owner] - 1 - np.arange(total)) & 1).astype(np.uint8))


def _ac_refine(blocks: np.ndarray) -> bytes:
    """The last bit of every value: all values are known to be nonzero, so runs of ended bands hold plain bits."""
    b = blocks[:, 1:]
    bits = (b & 1) ^ (b < 128)
    out = []
    for lo in range(0, len(b), MAX_RUN):
        run = min(MAX_RUN, len(b) - lo)
        n = run.bit_length() - 1
        head = (16 + n) << n | (run - (1 << n))
        out += [np.array([head >> k & 1 for k in reversed(range(5 + n))], np.uint8), bits[lo : lo + run].reshape(-1).astype(np.uint8)]
    return _packed(np.concatenate(out))


def encode(data: bytes) -> bytes:
    """A progressive JPEG that holds the bytes, padded with zeros to a positive multiple of 64; its comment has both lengths."""
    blocks = max(1, -(-len(data) // UNIT))
    units = -(-blocks // 6)
    cols = math.isqrt(units - 1) + 1
    rows = -(-units // cols)
    m = rows * cols
    if 16 * max(rows, cols) > 65535:
        raise ValueError("a text beyond 6 GB, three times what a row of Spark's holds, does not fit one image")
    b = np.zeros(6 * m * UNIT, np.uint8)
    b[: len(data)] = np.frombuffer(data, np.uint8)
    b = b.reshape(-1, UNIT)
    parts = (b[: 4 * m], b[4 * m : 5 * m], b[5 * m :])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d %d" % (len(data), blocks * UNIT)), _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), TABLES]
    dc = _mcu_order(*[p[:, 0] for p in parts], rows, cols)
    for scan in SCRIPT:
        head = bytes([len(scan.parts)]) + b"".join(bytes([p + 1, 0]) for p in scan.parts) + bytes([scan.first, scan.last, scan.high << 4 | scan.low])
        if scan.first == 0:
            body = _packed((dc & 1).reshape(-1)) if scan.high else _dc_first(dc >> 1)
        elif scan.high:
            body = _ac_refine(parts[scan.parts[0]])
        else:  # a zero for the category, then seven bits: a byte less its last bit
            body = (parts[scan.parts[0]][:, scan.first : scan.last + 1] >> 1).tobytes()
        out += [_segment(0xDA, head), body]
    return b"".join([*out, b"\xff\xd9"])


# --- Reading ---------------------------------------------------------------------------------------------------

SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class Image(NamedTuple):
    """Size, comment, sampling factors, quantisation and coefficient arrays (block rows, block columns, 64 in zigzag order) of the components."""

    height: int
    width: int
    comment: bytes
    sampling: list[tuple[int, int]]
    quant: list[np.ndarray]
    coefficients: list[np.ndarray]


class Bits:
    """Bits of a scan's entropy-coded data as text of 0 and 1."""

    def __init__(self, data: bytes) -> None:
        self.text = format(int.from_bytes(b"\x01" + data, "big"), "b")[1:]
        self.at = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.at += n
        return int(self.text[self.at - n : self.at], 2)

    def symbol(self, codes: dict[str, int], lengths: list[int]) -> int:
        for n in lengths:
            found = codes.get(self.text[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        raise ValueError("no such code")


def _extend(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(body: bytes) -> Iterator[tuple[int, dict[str, int]]]:
    """(class and number, codes) of each table of a DHT segment."""
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        at += 17
        code, table = 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[format(code, f"0{length}b")] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        yield kind, table


def read(data: bytes, fast: bool = True) -> Image:
    """Parse a progressive JPEG and accumulate its scans. fast=False: only the general decoder."""
    at, comment, quant, tables, interval = 2, b"", {}, {}, 0
    image: Image | None = None
    ids: list[int] = []
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            tables |= dict(_codes(body))
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, h, w, count = struct.unpack(">BHHB", body[:6])
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(count)]
            ids, sampling = [p[0] for p in parts], [(p[1] >> 4, p[1] & 15) for p in parts]
            hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
            rows, cols = -(-h // (8 * vm)), -(-w // (8 * hm))
            image = Image(h, w, comment, sampling, [quant[p[2]] for p in parts], [np.zeros((rows * v, cols * hh, 64), np.int32) for hh, v in sampling])
        elif marker == 0xDA:
            end = SCAN_END.search(data, at).start()
            k = body[0]
            scan = Scan(tuple(ids.index(body[1 + 2 * i]) for i in range(k)), body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k] >> 4, body[3 + 2 * k] & 15)
            chosen = [(tables.get(body[2 + 2 * i] >> 4), tables.get(0x10 | body[2 + 2 * i] & 15)) for i in range(k)]
            _scan(image, scan, chosen, data[at:end], interval, fast)
            at = end
        elif marker in (0xC0, 0xC1):
            raise ValueError("not a progressive JPEG")
    return image._replace(comment=comment)


def _visits(image: Image, scan: Scan) -> list[list[tuple[int, int, int]]]:
    """(component, block row, block column) of each unit of a scan."""
    if len(scan.parts) == 1:
        p = scan.parts[0]
        (h, v), (hm, vm) = image.sampling[p], (max(s[0] for s in image.sampling), max(s[1] for s in image.sampling))
        rows, cols = -(-image.height * v // (8 * vm)), -(-image.width * h // (8 * hm))
        return [[(p, r, c)] for r in range(rows) for c in range(cols)]
    h0, v0 = image.sampling[0]
    rows, cols = image.coefficients[0].shape[0] // v0, image.coefficients[0].shape[1] // h0
    return [[(p, r * image.sampling[p][1] + y, c * image.sampling[p][0] + x) for p in scan.parts for y in range(image.sampling[p][1]) for x in range(image.sampling[p][0])] for r in range(rows) for c in range(cols)]


def _scan(image: Image, scan: Scan, tables: list[tuple[dict | None, dict | None]], data: bytes, interval: int, fast: bool) -> None:
    if fast and not interval and _fast(image, scan, tables, data):
        return
    pieces = RESTART.split(data) if interval else [data]
    visits = _visits(image, scan)
    step = interval or len(visits)
    for i, piece in enumerate(pieces):
        part = visits[i * step : (i + 1) * step]
        bits = Bits(piece.replace(b"\xff\x00", b"\xff"))
        if scan.first == 0:
            _dc(image, scan, tables, bits, part)
        else:
            codes = tables[0][1]
            lengths = sorted({len(c) for c in codes})
            blocks = [image.coefficients[p][r, c] for unit in part for p, r, c in unit]
            (_ac_refined if scan.high else _ac)(blocks, scan, codes, lengths, bits)


def _dc(image: Image, scan: Scan, tables: list, bits: Bits, visits: list) -> None:
    before = dict.fromkeys(scan.parts, 0)
    of = {p: (t[0], sorted({len(c) for c in t[0]})) if t[0] else None for p, t in zip(scan.parts, tables, strict=True)}
    for unit in visits:
        for p, r, c in unit:
            if scan.high:
                image.coefficients[p][r, c, 0] |= bits.take(1) << scan.low
            else:
                size = bits.symbol(*of[p])
                before[p] += _extend(bits.take(size), size)
                image.coefficients[p][r, c, 0] = before[p] << scan.low


def _ac(blocks: list[np.ndarray], scan: Scan, codes: dict[str, int], lengths: list[int], bits: Bits) -> None:
    """First scan of a band: runs of zeros and values; a run of ended bands covers blocks that have nothing more."""
    ended = 0
    for block in blocks:
        if ended:
            ended -= 1
            continue
        k = scan.first
        while k <= scan.last:
            run, size = divmod(bits.symbol(codes, lengths), 16)
            if size:
                k += run
                block[k] = _extend(bits.take(size), size) * (1 << scan.low)
                k += 1
            elif run == 15:
                k += 16
            else:
                ended = (1 << run) + bits.take(run) - 1
                break


def _ac_refined(blocks: list[np.ndarray], scan: Scan, codes: dict[str, int], lengths: list[int], bits: Bits) -> None:
    """One more bit: known values get a bit each as they are passed; new values are plus or minus one bit."""
    one, ended = 1 << scan.low, 0

    def correct(block: np.ndarray, k: int) -> None:
        if bits.take(1):
            block[k] += one if block[k] > 0 else -one

    for block in blocks:
        k = scan.first
        while not ended and k <= scan.last:
            run, size = divmod(bits.symbol(codes, lengths), 16)
            new = 0
            if size:
                new = one if bits.take(1) else -one
            elif run < 15:
                ended = (1 << run) + bits.take(run)
                break
            while k <= scan.last:
                if block[k]:
                    correct(block, k)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if new and k <= scan.last:
                block[k] = new
            k += 1
        if ended:
            for j in range(k, scan.last + 1):
                if block[j]:
                    correct(block, j)
            ended -= 1


def _fast(image: Image, scan: Scan, tables: list, data: bytes) -> bool:
    """Scans of one code length: True if the scan was one and has been decoded."""
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") if b"\xff" in data else data, np.uint8)
    if scan.first == 0:
        if len(scan.parts) != 3 or image.sampling != [(2, 2), (1, 1), (1, 1)]:
            return False
        ry, cy = image.coefficients[0].shape[:2]
        if scan.high:
            v = np.unpackbits(raw)[: ry * cy * 6 // 4].astype(np.int32) << scan.low
        else:
            codes = tables[0][0]
            if {len(c) for c in codes} != {4} or any(t[0] is not codes for t in tables):
                return False
            text, at, out = format(int.from_bytes(b"\x01" + raw.tobytes(), "big"), "b")[1:], 0, []
            for _ in range(ry * cy * 6 // 4):
                size = codes[text[at : at + 4]]
                at += 4 + size
                if size:
                    x = int(text[at - size : at], 2)
                    out.append(x if x >> (size - 1) else x - (1 << size) + 1)
                else:
                    out.append(0)
            d = np.array(out, np.int32).reshape(-1, 6)
            v = np.concatenate([np.cumsum(d[:, :4].reshape(-1)).reshape(-1, 4), np.cumsum(d[:, 4:], axis=0)], axis=1).reshape(-1) << scan.low
        v = v.reshape(-1, 6)
        y = v[:, :4].reshape(ry // 2, cy // 2, 2, 2).transpose(0, 2, 1, 3).reshape(ry, cy)
        for p, x in zip(image.coefficients, (y, v[:, 4].reshape(ry // 2, -1), v[:, 5].reshape(ry // 2, -1)), strict=True):
            p[:, :, 0] = p[:, :, 0] | x if scan.high else x
        return True
    c, codes, n = image.coefficients[scan.parts[0]], tables[0][1], scan.last - scan.first + 1
    whole = image.height % 16 == 0 and image.width % 16 == 0  # no blocks beyond the image, which such a scan leaves out
    band = c.reshape(-1, 64)[:, scan.first : scan.last + 1]
    if not whole:
        return False
    if not scan.high:
        if codes.get("0") != SIZE or len(raw) != len(band) * n or (raw & 0x80).any():
            return False
        x = raw.astype(np.int32).reshape(-1, n)
        band[:] = np.where(x >= 64, x, x - 127) * (1 << scan.low)
        return True
    if not (band != 0).all() or "0" not in codes:
        return False
    bits, at, lo, got = np.unpackbits(raw), 0, 0, []
    while lo < len(band):
        symbol = codes.get("".join(map(str, bits[at : at + 5])))
        if symbol is None or symbol & 15 or symbol >> 4 == 15:
            return False
        k = symbol >> 4
        run = (1 << k) + (int("".join(map(str, bits[at + 5 : at + 5 + k])), 2) if k else 0)
        at += 5 + k
        got.append(bits[at : at + run * n])
        at, lo = at + run * n, lo + run
    add = np.concatenate(got).reshape(-1, n).astype(np.int32) << scan.low
    band += np.where(band > 0, add, -add)
    return True


def rgb(image: Image) -> np.ndarray:
    """The image as (height, width, 3) bytes: inverse transform, chroma repeated to full resolution, colour conversion."""
    hm, vm = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
    planes = []
    for c, q, (h, v) in zip(image.coefficients, image.quant, image.sampling, strict=True):
        rows, cols = c.shape[:2]
        x = (c.reshape(-1, 64).astype(np.float32) * q) @ INVERSE
        x = np.clip(np.rint(x + 128.0), 0, 255).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        if (h, v) != (hm, vm):
            x = x.repeat(vm // v, axis=0).repeat(hm // h, axis=1)
        planes.append(x[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128.0, planes[2] - 128.0
    out = np.empty((*y.shape, 3), np.uint8)
    for i, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(x), 0, 255)
    return out


def payload(image: Image) -> tuple[bytes, int]:
    """The stored bytes from the coefficients, padding included, and their number without padding."""
    n, padded = map(int, image.comment.split()[1:3])
    blocks = np.concatenate([c.reshape(-1, 64) for c in image.coefficients])
    b = np.where(blocks < 0, blocks + 255, blocks)
    return b.astype(np.uint8).reshape(-1)[:padded].tobytes(), n


# --- Over tables -----------------------------------------------------------------------------------------------


def _encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        for lo, hi in slices(rb.column(1)):
            part = rb.slice(lo, hi - lo)
            data, offsets = as_bytes(part.column(1))
            raw = data.tobytes()
            media = [encode(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])


#: Bytes of tensors of a batch that goes back to Spark; one row at least.
BATCH_BYTES = 8 << 20


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    for rb in it:
        rows, held, first = [], 0, 0

        def batch(end: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rb.column(0).slice(first, end - first), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *names])

        for i in range(rb.num_rows):
            media = rb.column(1)[i].as_py()
            image = read(media)
            body, n = payload(image)
            tensor = rgb(image).tobytes()
            rows.append((n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor, image.height, image.width), image.height, image.width, tensor))
            held += len(tensor)
            if held >= BATCH_BYTES or i == rb.num_rows - 1:
                yield batch(i + 1)
                rows, held, first = [], 0, i + 1


def feature(tensor: bytes, height: int, width: int) -> str:
    """Size and mean of each colour of a stored tensor."""
    mean = np.frombuffer(tensor, np.uint8).reshape(height, width, 3).reshape(-1, 3).mean(axis=0, dtype=np.float64)
    return f"{height}x{width}:" + ",".join(f"{x:.2f}" for x in mean)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text as a progressive JPEG. A null text counts as empty and is one block of zeros. Repeated rows are stored alike, null ids are kept, an empty table gives no rows."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body")).mapInArrow(_encode, f"doc_id {kind}, media binary")


def features(media: DataFrame) -> DataFrame:
    """One row an image of (doc_id, media): digests of the payload read back from it, its full-resolution RGB tensor (rgb, height * width * 3 bytes, row by row) and a feature of the tensor's bytes: size and mean of each colour."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(_features, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary")


def stored_features(docs: DataFrame) -> DataFrame:
    """features() of images written to the shared folder and read again."""
    return features(written(store(docs), "media"))
