"""Progressive JPEG: a general scan decoder, and a batch codec for byte payloads.

``decode_scans`` reads any 8-bit progressive file (SOF2) with Huffman coding:
every scan adds to integer coefficient arrays, by spectral selection and
successive approximation, with restarts and end-of-band runs. ``to_rgb``
dequantises, inverse-transforms in numpy, upsamples chroma and returns the
full-resolution RGB tensor.

``encode_group`` and ``decode_group`` treat many payloads of one frame size at
once. Byte ``v`` becomes the coefficient ``v`` (128..255) or ``v - 255``
(-255..-128): every coefficient has nine bits with sign and is never zero. The
Huffman tables are chosen so that each code with its extra bits has a fixed
length, so the bits of a scan are cut by reshaping. Both decoders read these
files alike.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the JPEG format: marker codes.
SOI, EOI, SOS, DQT, DHT, SOF2, DRI, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC2, 0xDD, 0xFE
WIDEST = 4064


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: by anti-diagonals, turning at each."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else -c[0]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """The cosine basis in multiples of 2**-13, so that float64 sums of its products with coefficients are exact."""
    u, x = np.mgrid[0:8, 0:8]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.round(basis * 8192) / 8192


BASIS = _basis()


# --- general decoder ---------------------------------------------------------


class Bits:
    """Bits of one entropy-coded segment whose stuffed zeros are gone."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        chunk = self.data[first:last].ljust(last - first, b"\xff")
        value = int.from_bytes(chunk, "big") >> (8 * (last - first) - (self.at & 7) - n)
        self.at += n
        return value & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            found = table.get((length, code))
            if found is not None:
                return found
        raise ValueError("no such Huffman code")


def _extend(bits: int, size: int) -> int:
    return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode_scans(data: bytes) -> dict:
    """Coefficients (zigzag order) of a progressive file, by component, with its frame and tables."""
    if data[:2] != bytes([0xFF, SOI]):
        raise ValueError("not a JPEG file")
    at, out = 2, {"quant": {}, "components": {}, "comments": []}
    tables: dict[tuple[int, int], dict] = {}
    restart = 0
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == EOI:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == DQT:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                out["quant"][number] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == DRI:
            restart = int.from_bytes(body, "big")
        elif marker == COM:
            out["comments"].append(body)
        elif marker == SOF2:
            if body[0] != 8:
                raise ValueError("only 8-bit samples are read")
            out["height"], out["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for i in range(body[5]):
                c = body[6 + 3 * i : 9 + 3 * i]
                out["components"][c[0]] = {"h": c[1] >> 4, "v": c[1] & 15, "q": c[2]}
            _frame(out)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive frames are read")
        elif marker == SOS:
            at = _scan(data, at, body, out, tables, restart)
    return out


def _frame(out: dict) -> None:
    parts = out["components"].values()
    hmax, vmax = max(c["h"] for c in parts), max(c["v"] for c in parts)
    out["mcus"] = (-(-out["height"] // (8 * vmax)), -(-out["width"] // (8 * hmax)))
    for c in parts:
        c["rows"], c["cols"] = -(-(-(-out["height"] * c["v"] // vmax)) // 8), -(-(-(-out["width"] * c["h"] // hmax)) // 8)
        c["stride"] = out["mcus"][1] * c["h"]
        c["coefficients"] = np.zeros((out["mcus"][0] * c["v"] * c["stride"], 64), dtype=np.int32)


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments up to the next marker other than a restart."""
    found, start = [], at
    while True:
        at = data.index(0xFF, at)
        follows = data[at + 1]
        if follows == 0:
            at += 2
        elif 0xD0 <= follows <= 0xD7:
            found.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            start = at = at + 2
        else:
            found.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            return found, at


def _scan(data: bytes, at: int, body: bytes, out: dict, tables: dict, restart: int) -> int:
    n = body[0]
    parts = [(out["components"][body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if n == 1:
        c = parts[0][0]
        units = [[(parts[0], y * c["stride"] + x)] for y in range(c["rows"]) for x in range(c["cols"])]
    else:
        units = [[(p, (my * p[0]["v"] + y) * p[0]["stride"] + mx * p[0]["h"] + x) for p in parts for y in range(p[0]["v"]) for x in range(p[0]["h"])] for my in range(out["mcus"][0]) for mx in range(out["mcus"][1])]
    segments, after = _segments(data, at)
    step = restart or len(units)
    for k, segment in enumerate(segments):
        bits, run, before = Bits(segment), 0, {}
        for unit in units[k * step : (k + 1) * step]:
            for (c, dc, ac), block in unit:
                row = c["coefficients"][block]
                if first == 0:
                    if high:
                        row[0] |= bits.take(1) << low
                    else:
                        size = bits.symbol(tables[0, dc])
                        before[id(c)] = before.get(id(c), 0) + _extend(bits.take(size), size)
                        row[0] = before[id(c)] << low
                elif high:
                    run = _refine(bits, row, tables[1, ac], first, last, low, run)
                else:
                    run = _begin(bits, row, tables[1, ac], first, last, low, run)
    return after


def _begin(bits: Bits, row: np.ndarray, table: dict, first: int, last: int, low: int, run: int) -> int:
    """First pass over a band; returns the blocks left in an end-of-band run."""
    if run:
        return run - 1
    k = first
    while k <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            row[k] = _extend(bits.take(size), size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _refine(bits: Bits, row: np.ndarray, table: dict, first: int, last: int, low: int, run: int) -> int:
    """A later pass: one more bit of what is known, and coefficients that begin at this bit."""
    one = 1 << low

    def correct(k: int) -> None:
        if bits.take(1):
            row[k] += one if row[k] > 0 else -one

    k = first
    if not run:
        while k <= last:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            value = (one if bits.take(1) else -one) if size else 0
            while k <= last:
                if row[k]:
                    correct(k)
                elif zeros:
                    zeros -= 1
                else:
                    row[k] = value
                    k += 1
                    break
                k += 1
    if run:
        for j in range(k, last + 1):
            if row[j]:
                correct(j)
        run -= 1
    return run


# --- samples -----------------------------------------------------------------


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """8 x 8 samples (0..255) of dequantised blocks in zigzag order."""
    blocks = np.zeros(coefficients.shape[:-1] + (64,))
    blocks[..., ZIGZAG] = coefficients
    blocks = blocks.reshape(-1, 8, 8)
    turned = (blocks.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8)
    samples = np.matmul(BASIS.T, turned)
    return np.clip(np.floor(samples + 128.5), 0, 255).astype(np.uint8).reshape(coefficients.shape[:-1] + (8, 8))


def planes_to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """RGB of full-resolution planes; the last axis is the colour."""
    y, cb, cr = (p.astype(np.float32) for p in (y, cb, cr))
    cb -= 128
    cr -= 128
    rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.floor(rgb + np.float32(0.5)), 0, 255).astype(np.uint8)


def to_rgb(decoded: dict) -> np.ndarray:
    """height x width x 3 of a decoded file with one or three components."""
    parts = list(decoded["components"].values())
    hmax, vmax = max(c["h"] for c in parts), max(c["v"] for c in parts)
    planes = []
    for c in parts:
        blocks = inverse(c["coefficients"] * decoded["quant"][c["q"]])
        plane = blocks.reshape(-1, c["stride"], 8, 8).swapaxes(1, 2).reshape(-1, c["stride"] * 8)
        plane = plane.repeat(vmax // c["v"], axis=0).repeat(hmax // c["h"], axis=1)
        planes.append(plane[: decoded["height"], : decoded["width"]])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=-1)
    return planes_to_rgb(*planes[:3])


# --- batch codec for payloads ------------------------------------------------

_V = np.arange(256)
_C = np.where(_V >= 128, _V, _V - 255)
AC_BYTE = np.where(_C > 0, np.abs(_C) >> 1, 127 - (np.abs(_C) >> 1)).astype(np.uint8)
AC_BIT = (np.abs(_C) & 1).astype(np.uint8)
DC_HIGH = (_C >> 1).astype(np.int16)
DC_BIT = (_C & 1).astype(np.uint8)
# A difference of size s has a code of 11 - s bits: 000, 0010, 00110 and so on.
DC_LENGTHS = [11 - s for s in range(9)]


def _dc_words() -> tuple[np.ndarray, np.ndarray]:
    """11-bit word of each difference -255..255 (at +255), and the difference of each word."""
    table = {symbol: (length, code) for (length, code), symbol in _codes(*_dc_table()).items()}
    to, back = np.zeros(511, np.int32), np.zeros(2048, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        word = table[s][1] << s | (d if d >= 0 else d + (1 << s) - 1)
        to[d + 255], back[word] = word, d
    return to, back


def _dc_table() -> tuple[bytes, bytes]:
    return bytes(sum(n == length for n in DC_LENGTHS) for length in range(1, 17)), bytes(range(8, -1, -1))


DC_WORD, DC_DIFF = _dc_words()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def frame_of(blocks: int) -> tuple[int, int]:
    """MCU columns and rows of the least frame that holds so many blocks."""
    units = max(1, -(-blocks // 6))
    rows = -(-units // WIDEST)
    return -(-units // rows), rows


_layouts: dict[tuple[int, int], list] = {}


def _layout(cols: int, rows: int) -> list:
    """(kind, detail, bytes) of the file's parts in order; fixed by the frame."""
    if (cols, rows) in _layouts:
        return _layouts[cols, rows]
    units = cols * rows
    head = bytes([0xFF, SOI]) + _segment(DQT, b"\0" + b"\1" * 64)
    head += _segment(SOF2, b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    ac = (bytes([1] + [0] * 15), b"\x07")
    runs = (bytes([0, 0, 0, 15] + [0] * 12), bytes(n << 4 for n in range(15)))
    head += _segment(DHT, b"\0" + b"".join(_dc_table()) + b"\x10" + b"".join(ac) + b"\x11" + b"".join(runs))
    parts = [("fixed", head), ("size", 4 + 12)]

    def scan(ids: list[int], tables: int, first: int, last: int, approx: int) -> None:
        parts.append(("fixed", _segment(SOS, bytes([len(ids)]) + b"".join(bytes([i, tables]) for i in ids) + bytes([first, last, approx]))))

    scan([1, 2, 3], 0, 0, 0, 0x01)
    parts.append(("dc", None, -(-11 * 6 * units // 8)))
    spans = {1: (0, 4 * units), 2: (4 * units, 5 * units), 3: (5 * units, 6 * units)}
    for first, last in ((1, 5), (6, 63)):
        for i, (a, b) in spans.items():
            scan([i], 0, first, last, 0x01)
            parts.append(("ac", (a, b, first, last), (b - a) * (last - first + 1)))
    scan([1, 2, 3], 0, 0, 0, 0x10)
    parts.append(("dcbit", None, -(-6 * units // 8)))
    for i, (a, b) in spans.items():
        scan([i], 1, 1, 63, 0x10)
        runs_of = []
        for start in range(a, b, 1 << 14):
            n = min(b - start, 1 << 14)
            power = n.bit_length() - 1
            runs_of.append((start, n, [power >> k & 1 for k in (3, 2, 1, 0)] + [n >> k & 1 for k in range(power - 1, -1, -1)]))
        parts.append(("acbit", runs_of, -(-sum(len(w) + 63 * n for _, n, w in runs_of) // 8)))
    parts.append(("fixed", bytes([0xFF, EOI])))
    if len(_layouts) > 4096:
        _layouts.clear()
    _layouts[cols, rows] = parts
    return parts


def _order(cols: int, rows: int) -> np.ndarray:
    """Luma blocks in the order of an interleaved scan."""
    grid = np.arange(4 * rows * cols).reshape(rows, 2, cols, 2)
    return grid.transpose(0, 2, 1, 3).reshape(-1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as bytes, filled up with ones."""
    short = -bits.shape[1] % 8
    if short:
        bits = np.concatenate([bits, np.ones((len(bits), short), np.uint8)], axis=1)
    return np.packbits(bits, axis=1)


def encode_group(payloads: np.ndarray, lengths: np.ndarray, cols: int, rows: int) -> list[bytes]:
    """Files of payloads (documents x bytes of a whole frame, zero beyond their lengths)."""
    n, units = len(payloads), cols * rows
    blocks = payloads.reshape(n, 6 * units, 64)
    order = _order(cols, rows)
    pieces, entropy = [], []
    for kind, detail, *size in _layout(cols, rows):
        if kind == "fixed":
            piece = np.broadcast_to(np.frombuffer(detail, np.uint8), (n, len(detail)))
        elif kind == "size":
            text = b"".join(_segment(COM, b"%012d" % x) for x in lengths.tolist())
            piece = np.frombuffer(text, np.uint8).reshape(n, -1)
        elif kind == "dc":
            high = DC_HIGH[blocks[:, :, 0]]
            diffs = np.empty((n, units, 6), np.int16)
            diffs[:, :, :4] = np.diff(high[:, order], axis=1, prepend=0).reshape(n, units, 4)
            diffs[:, :, 4] = np.diff(high[:, 4 * units : 5 * units], axis=1, prepend=0)
            diffs[:, :, 5] = np.diff(high[:, 5 * units :], axis=1, prepend=0)
            word = DC_WORD[diffs.reshape(n, -1) + 255]
            piece = _packed((word[..., None] >> np.arange(10, -1, -1) & 1).astype(np.uint8).reshape(n, -1))
        elif kind == "ac":
            a, b, first, last = detail
            piece = AC_BYTE[blocks[:, a:b, first : last + 1]].reshape(n, -1)
        elif kind == "dcbit":
            bit = DC_BIT[blocks[:, :, 0]]
            mixed = np.concatenate([bit[:, order].reshape(n, units, 4), bit[:, 4 * units : 5 * units, None], bit[:, 5 * units :, None]], axis=2)
            piece = _packed(mixed.reshape(n, -1))
        else:
            bits = []
            for start, count, prefix in detail:
                bits += [np.broadcast_to(np.array(prefix, np.uint8), (n, len(prefix))), AC_BIT[blocks[:, start : start + count, 1:]].reshape(n, -1)]
            piece = _packed(np.concatenate(bits, axis=1))
        pieces.append(piece)
        entropy.append(np.full(piece.shape[1], kind not in ("fixed", "size")))
    whole = np.concatenate(pieces, axis=1)
    stuffed = (whole == 0xFF) & np.concatenate(entropy)
    ends = np.cumsum(whole.shape[1] + stuffed.sum(axis=1))
    repeats = 1 + stuffed.reshape(-1).astype(np.int64)
    out = np.repeat(whole.reshape(-1), repeats)
    out[(np.cumsum(repeats) - 1)[stuffed.reshape(-1)]] = 0
    data = out.tobytes()
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def frame_in(file: bytes) -> tuple[int, int]:
    """MCU columns and rows that the file's frame header states."""
    at = 2
    while file[at + 1] != SOF2:
        at += 2 + int.from_bytes(file[at + 2 : at + 4], "big")
    return int.from_bytes(file[at + 7 : at + 9], "big") // 16, int.from_bytes(file[at + 5 : at + 7], "big") // 16


def decode_group(files: list[bytes], cols: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (files x blocks x 64) and payload lengths of files of one frame.

    Files whose headers differ from this codec's own go through ``decode_scans``.
    """
    units, order, layout = cols * rows, _order(cols, rows), _layout(cols, rows)
    n = len(files)
    size = sum(len(d[1]) if d[0] == "fixed" else d[1] if d[0] == "size" else d[2] for d in layout)
    flat = np.frombuffer(b"".join(files), np.uint8)
    drop = np.zeros(len(flat), bool)
    drop[1:] = (flat[1:] == 0) & (flat[:-1] == 0xFF)
    starts = np.cumsum([0, *map(len, files)])[:-1]
    lengths = np.array([len(f) for f in files]) - np.add.reduceat(drop, starts)
    if (lengths != size).any():
        return _decode_each(files, units)
    whole = flat[~drop].reshape(n, size)
    at, known = 0, np.zeros(n, np.int64)
    out = np.empty((n, 6 * units, 64), np.int16)
    high = np.empty((n, 6 * units), np.int16)
    for kind, detail, *more in layout:
        width = len(detail) if kind == "fixed" else detail if kind == "size" else more[0]
        piece, at = whole[:, at : at + width], at + width
        if kind == "fixed":
            if (piece != np.frombuffer(detail, np.uint8)).any():
                return _decode_each(files, units)
        elif kind == "size":
            known = (piece[:, 4:].astype(np.int64) - 48) @ 10 ** np.arange(11, -1, -1)
        elif kind == "dc":
            bits = np.unpackbits(piece, axis=1)[:, : 66 * units].reshape(n, 6 * units, 11)
            word = bits @ (1 << np.arange(10, -1, -1)).astype(np.int32)
            diffs = DC_DIFF[word].reshape(n, units, 6)
            high[:, order] = np.cumsum(diffs[:, :, :4].reshape(n, -1), axis=1)
            high[:, 4 * units : 5 * units] = np.cumsum(diffs[:, :, 4], axis=1)
            high[:, 5 * units :] = np.cumsum(diffs[:, :, 5], axis=1)
        elif kind == "ac":
            a, b, first, last = detail
            value = piece.reshape(n, b - a, -1).astype(np.int16)
            out[:, a:b, first : last + 1] = np.where(value >= 64, value, value - 127) * 2
        elif kind == "dcbit":
            bits = np.unpackbits(piece, axis=1)[:, : 6 * units].reshape(n, units, 6)
            low = np.empty((n, 6 * units), np.int16)
            low[:, order] = bits[:, :, :4].reshape(n, -1)
            low[:, 4 * units : 5 * units], low[:, 5 * units :] = bits[:, :, 4], bits[:, :, 5]
            out[:, :, 0] = high * 2 + low
        else:
            bits, bit_at = np.unpackbits(piece, axis=1), 0
            for start, count, prefix in detail:
                bit_at += len(prefix)
                low = bits[:, bit_at : bit_at + 63 * count].reshape(n, count, 63).astype(np.int16)
                bit_at += 63 * count
                band = out[:, start : start + count, 1:]
                band += np.where(band > 0, low, -low)
    return out, known


def _decode_each(files: list[bytes], units: int) -> tuple[np.ndarray, np.ndarray]:
    out, known = np.empty((len(files), 6 * units, 64), np.int16), []
    for k, file in enumerate(files):
        got = decode_scans(file)
        out[k] = np.concatenate([c["coefficients"] for c in got["components"].values()])
        known.append(int(got["comments"][0]))
    return out, np.array(known)


def group_rgb(coefficients: np.ndarray, cols: int, rows: int) -> np.ndarray:
    """RGB tensors (files x height x width x 3) of one frame size."""
    n, units = len(coefficients), cols * rows
    samples = inverse(coefficients)
    y = samples[:, : 4 * units].reshape(n, 2 * rows, 2 * cols, 8, 8).swapaxes(2, 3).reshape(n, 16 * rows, 16 * cols)
    chroma = [samples[:, a * units : (a + 1) * units].reshape(n, rows, cols, 8, 8).swapaxes(2, 3).reshape(n, 8 * rows, 8 * cols).repeat(2, axis=1).repeat(2, axis=2) for a in (4, 5)]
    return planes_to_rgb(y, *chroma)


def payload_of(coefficients: np.ndarray) -> np.ndarray:
    """Payload bytes of coefficients, files x bytes."""
    return np.where(coefficients >= 128, coefficients, coefficients + 255).astype(np.uint8).reshape(len(coefficients), -1)
