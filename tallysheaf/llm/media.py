"""Media columns: baseline JPEG, written and read in numpy over many images at once.

Writer: the payload bytes are the quantised coefficients (byte minus 128, every quantiser 1), 64 a block, three
components, so 192 bytes a unit; nothing is transformed or rounded, hence nothing is lost. The payload's length
is in a comment segment. Reader: parses markers, removes stuffing, and decodes Huffman codes of all restart
intervals of all images in step, one code for each interval at a time; a DC-only luminance thumbnail follows
from the first coefficients. The reader takes any sequential 8-bit Huffman file with one interleaved scan, or
one component, in any sampling. A long text is written and read by runs of restart intervals, which do not depend
on each other, so that the arrays of a step stay small whatever a text's length; only a foreign file without
restart markers is read in one step.

Cases: null and empty texts give one unit of spaces; texts are stored whole; bytes that are no such file (null
too) give null values in every derived column; repeated rows repeat; an empty table gives an empty result;
other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, claim, own_columns, ship, table, text_buffers

UNIT = 192
#: Units between restart markers: the intervals decode side by side.
INTERVAL = 4
#: Units in a row of the image, more only for texts of hundreds of megabytes.
COLUMNS = 512
#: Payload bytes that are encoded or decoded in step.
STEP_BYTES = 3 << 20
#: Units of a long image that are written in one step: whole turns of the eight restart markers.
PART = 8 * INTERVAL * 128


def rule_tables() -> tuple[list[tuple[int, list[int]]], list[tuple[int, list[int]]]]:
    """(code length, symbols) of the DC and AC tables that the writer uses: 4 bits for every DC size; 4 bits for
    end-of-block and for values without zeros before, 9 bits for the rest."""
    near = [0x00, *range(0x01, 0x0B)]
    far = [r << 4 | s for r in range(1, 16) for s in range(1, 11)] + [0xF0]
    return [(4, list(range(12)))], [(4, near), (9, sorted(far))]


def table_bytes(kind: int, lengths: list[tuple[int, list[int]]]) -> bytes:
    counts = [0] * 16
    for n, symbols in lengths:
        counts[n - 1] = len(symbols)
    return bytes([kind, *counts, *(s for _, some in lengths for s in some)])


def canonical(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) as the format assigns codes."""
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for s in symbols[at : at + counts[n - 1]]:
            out[s] = (code, n)
            code += 1
        at += counts[n - 1]
        code <<= 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DC, _AC = rule_tables()
_HEAD = segment(0xDB, bytes([0]) + bytes([1] * 64))
_TABLES = segment(0xC4, table_bytes(0x00, _DC) + table_bytes(0x10, _AC)) + segment(0xDD, struct.pack(">H", INTERVAL)) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def _codes(lengths):
    counts = [0] * 16
    for n, some in lengths:
        counts[n - 1] = len(some)
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in canonical(counts, [s for _, some in lengths for s in some]).items():
        code[s], bits[s] = c, n
    return code, bits


_DC_CODE, _AC_CODE = _codes(_DC), _codes(_AC)
_SIZE = np.array([int(abs(v)).bit_length() for v in range(-512, 512)], np.int64)


def write_images(payloads: list[bytes]) -> list[bytes]:
    """One JPEG for each payload; payloads are positive multiples of UNIT bytes."""
    shape, parts, of = [], [], []
    for i, p in enumerate(payloads):
        n = len(p) // UNIT
        columns = min(n, max(COLUMNS, -(-n // 8191)))
        rows = -(-n // columns)
        shape.append((columns, rows))
        size = columns * rows * UNIT
        for at in range(0, size, PART * UNIT):
            part = p[at : at + PART * UNIT]
            parts.append(part + b" " * (min(size - at, PART * UNIT) - len(part)))
            of.append(i)
    scans: list[list[bytes]] = [[] for _ in payloads]
    bounds = np.concatenate(([0], np.cumsum(list(map(len, parts))))).astype(np.int64)
    for a, b in chunks(bounds, STEP_BYTES // 2):
        for i, scan in zip(of[a:b], entropy(parts[a:b])):
            if scans[i]:  # what came before goes on: a restart instead of the end
                scans[i][-1] = scans[i][-1][:-1] + b"\xd7"
            scans[i].append(scan)
    files = []
    for (columns, rows), p, scan in zip(shape, payloads, scans):
        frame = segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
        files.append(b"".join([b"\xff\xd8", segment(0xFE, b"bytes=%d" % len(p)), _HEAD, frame, _TABLES, *scan]))
    return files


def entropy(parts: list[bytes]) -> list[bytes]:
    """The entropy-coded data of each part, with its restart markers and an end of image."""
    units = np.array([len(p) // UNIT for p in parts], np.int64)
    values = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64).reshape(-1, 64) - 128
    blocks = len(values)
    unit_in_image = np.arange(blocks // 3) - np.repeat(np.cumsum(units) - units, units)
    first = np.repeat(unit_in_image % INTERVAL == 0, 3)
    interval = np.cumsum(unit_in_image % INTERVAL == 0) - 1  # of each unit, over all images
    diff = values[:, 0].copy()
    diff[3:] -= np.where(first[3:], 0, values[:-3, 0])
    # Where codes go: one a nonzero coefficient, 16-zero marks before it, the DC code, an end mark in column 64.
    set_ = values[:, 1:] != 0
    k = np.arange(1, 64)
    upto = np.maximum.accumulate(np.where(set_, k, 0), axis=1)
    before = np.concatenate((np.zeros((blocks, 1), np.int64), upto[:, :-1]), axis=1)
    run = np.where(set_, k - before - 1, 0)
    count = np.zeros((blocks, 65), np.int64)
    count[:, 0] = 1
    count[:, 1:64] = np.where(set_, 1 + (run >> 4), 0)
    count[:, 64] = upto[:, -1] < 63
    ends = np.cumsum(count.ravel())
    total = int(ends[-1])
    zero16 = 0xF0
    code, bits = np.full(total, _AC_CODE[0][zero16]), np.full(total, _AC_CODE[1][zero16])

    def put(at, symbol, tables, value, size):
        extra = np.where(value < 0, value + (1 << size) - 1, value)
        code[at] = tables[0][symbol] << size | extra
        bits[at] = tables[1][symbol] + size

    grid = ends.reshape(blocks, 65) - 1
    size = _SIZE[diff + 512]
    put(grid[:, 0], size, _DC_CODE, diff, size)
    value = values[:, 1:][set_]
    size = _SIZE[value + 512]
    put(grid[:, 1:64][set_], (run[set_] & 15) << 4 | size, _AC_CODE, value, size)
    at = grid[:, 64][count[:, 64] == 1]
    code[at], bits[at] = _AC_CODE[0][0], _AC_CODE[1][0]
    # Bits of an interval start at a byte; the rest of its last byte is ones.
    block_ends = np.concatenate(([0], ends.reshape(blocks, 65)[:, 64]))
    interval_first = np.flatnonzero(np.diff(interval, prepend=-1)) * 3
    token_first = np.append(block_ends[interval_first], total)
    sums = np.concatenate(([0], np.cumsum(bits)))
    length = np.diff(sums[token_first])
    n_bytes = (length + 7) >> 3
    start = np.cumsum(n_bytes) - n_bytes
    position = sums[:-1] + np.repeat(start * 8 - sums[token_first[:-1]], np.diff(token_first))
    window = code << (32 - bits - (position & 7))
    raw_n = int(n_bytes.sum())
    raw = np.zeros(raw_n + 4)
    for j in range(4):
        raw += np.bincount((position >> 3) + j, (window >> (24 - 8 * j)) & 255, raw_n + 4)
    raw = raw[:raw_n].astype(np.uint8)
    raw[start + n_bytes - 1] |= ((1 << (n_bytes * 8 - length)) - 1).astype(np.uint8)
    # Stuffing after FF and a marker after each interval.
    full = raw == 255
    shift = np.cumsum(full) - full
    number = np.repeat(np.arange(len(n_bytes)), n_bytes)
    where = np.arange(raw_n) + shift + 2 * number
    out = np.zeros(raw_n + int(full.sum()) + 2 * len(n_bytes), np.uint8)
    out[where] = raw
    last = start + n_bytes - 1
    marks = where[last] + 1 + full[last]
    per_image = -(-units // INTERVAL)
    image_last = np.cumsum(per_image) - 1
    in_image = np.arange(len(n_bytes)) - np.repeat(image_last + 1 - per_image, per_image)
    kind = 0xD0 + in_image % 8
    kind[image_last] = 0xD9
    out[marks], out[marks + 1] = 255, kind
    bounds = [0, *(marks[image_last] + 2).tolist()]
    data = out.tobytes()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


class Image:
    """The marker segments of a file; scan holds its entropy-coded part."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.comments, self.quant, self.huffman, self.interval, self.parts, at = [], {}, {}, 0, None, 2
        while True:
            while data[at] != 0xFF:
                raise ValueError("marker expected")
            while data[at + 1] == 0xFF:
                at += 1
            marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            if len(body) != n - 2:
                raise ValueError("segment cut short")
            at += 2 + n
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    self.quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)
                    i += 129 if wide else 65
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    counts = body[i + 1 : i + 17]
                    self.huffman[body[i]] = (bytes(counts), body[i + 17 : i + 17 + sum(counts)])
                    i += 17 + sum(counts)
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("8 bits a sample only")
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("sequential Huffman files only")
            elif marker == 0xDA:
                break
        chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        if self.parts is None or len(chosen) != len(self.parts) or not self.width or not self.height:
            raise ValueError("one scan with all components only")
        self.sampling = [(1, 1, self.parts[c][2]) if len(chosen) == 1 else self.parts[c] for c, _ in chosen]
        self.tables = [t for _, t in chosen]
        wide, high = max(h for h, _, _ in self.sampling), max(v for _, v, _ in self.sampling)
        self.columns, self.rows = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        self.scan = data[at:]

    def layout(self):
        """What must be equal for images to decode in one call."""
        return (tuple(sorted(self.huffman.items())), tuple((h, v) for h, v, _ in self.sampling), tuple(self.tables))


def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol for each 16 bits that may come next; length 0 where no code fits."""
    length, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for s, (code, n) in canonical(counts, symbols).items():
        length[code << 16 - n : code + 1 << 16 - n], symbol[code << 16 - n : code + 1 << 16 - n] = n, s
    return length, symbol


def intervals(image: Image, per_unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The bytes of a scan without stuffing and markers, the bounds of its restart intervals, and their blocks."""
    raw = np.frombuffer(image.scan, np.uint8)
    mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & (raw[1:] != 255))
    stop = mark[(raw[mark + 1] & 0xF8) != 0xD0]
    stop = int(stop[0]) if len(stop) else len(raw)
    restarts = mark[mark < stop]
    drop = np.zeros(stop, bool)
    drop[1:] = (raw[: stop - 1] == 255) & (raw[1:stop] == 0)
    drop[restarts], drop[restarts + 1] = True, True
    units = image.columns * image.rows
    step = image.interval or units
    sizes = [step] * (units // step) + [units % step] * bool(units % step)
    if len(sizes) != len(restarts) + 1:
        return None
    clean = raw[:stop][~drop]
    before = restarts - np.searchsorted(np.flatnonzero(drop), restarts)  # bytes kept before each marker
    return clean, np.concatenate(([0], before, [len(clean)])), np.array(sizes, np.int64) * per_unit


def decode_scans(images: list[Image]) -> list[np.ndarray | None]:
    """Coefficients (blocks, 64) of each image in scan order; None where the data are damaged. One layout()."""
    shape = images[0]
    in_unit = [c for c, (h, v, _) in enumerate(shape.sampling) for _ in range(h * v)]
    known = [lookup(*shape.huffman[(kind << 4) | (t >> 4 if not kind else t & 15)]) for kind in (0, 1) for t in shape.tables]
    codes = np.concatenate([x[0] for x in known]), np.concatenate([x[1] for x in known])
    found: list = [[] for _ in images]
    held: list[tuple] = []
    size = 0

    def decode_held():
        nonlocal held, size
        for (n, _, _, _), x in zip(held, decode_intervals([x[1:] for x in held], in_unit, len(shape.tables), codes)):
            found[n] = None if found[n] is None or x is None else [*found[n], x]
        held, size = [], 0

    for n, image in enumerate(images):
        parts = intervals(image, len(in_unit))
        if parts is None:
            found[n] = None
            continue
        clean, bounds, blocks = parts
        for a, b in chunks(np.concatenate(([0], np.cumsum(blocks))) * 64, STEP_BYTES):
            own = int(blocks[a:b].sum()) * 64
            if held and size + own > STEP_BYTES:
                decode_held()
            held.append((n, clean[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], blocks[a:b]))
            size += own
    if held:
        decode_held()
    return [None if x is None else np.concatenate(x) if len(x) > 1 else x[0] for x in found]


def decode_intervals(parts: list[tuple], in_unit: list[int], tables: int, codes: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray | None]:
    """Coefficients of each part (bytes, bounds of its intervals, blocks of its intervals); None where damaged."""
    lengths, symbols = codes
    per_unit, ok = len(in_unit), [True] * len(parts)
    base = np.cumsum([0, *(len(x) for x, _, _ in parts)])
    flat = np.concatenate([*(x for x, _, _ in parts), np.full(16, 255, np.uint8)])
    wide = np.zeros(len(flat) - 8, np.uint64)
    for j in range(8):
        wide = wide << np.uint64(8) | flat[j : len(flat) - 8 + j]
    position = np.concatenate([b[:-1] + o for (_, b, _), o in zip(parts, base)]) * 8
    limit = np.concatenate([b[1:] + o for (_, b, _), o in zip(parts, base)]) * 8
    n_blocks, owner = np.concatenate([x for _, _, x in parts]), np.repeat(np.arange(len(parts)), [len(x) for _, _, x in parts])
    block = np.cumsum(n_blocks) - n_blocks
    stop_block = block + n_blocks
    out = np.zeros(int(n_blocks.sum()) * 64, np.int16)
    component = np.array(in_unit, np.int64)
    in_interval = np.zeros(len(block), np.int64)
    k = np.zeros(len(block), np.int64)
    predicted = np.zeros((len(block), tables), np.int64)
    lane = np.arange(len(block))
    one = np.uint64(1)
    while len(lane):
        p = position[lane]
        bits = wide[np.minimum(p >> 3, len(wide) - 1)] << (p & 7).astype(np.uint64)
        c = component[in_interval[lane] % per_unit]
        kk = k[lane]
        dc = kk == 0
        at = (np.where(dc, c, c + tables) << 16) + (bits >> np.uint64(48)).astype(np.int64)
        length, symbol = lengths[at], symbols[at]
        size = np.where(dc, symbol, symbol & 15)
        value = ((bits << length.astype(np.uint64)) >> one >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
        position[lane] = p + length + size
        some = np.flatnonzero(dc)
        predicted[lane[some], c[some]] += value[some]
        value[some] = predicted[lane[some], c[some]]
        place = np.where(dc, 0, kk + (symbol >> 4))
        ended = ~dc & (symbol == 0)
        bad = (length == 0) | (p + length + size > limit[lane]) | (~ended & (place > 63)) | (size > 11)
        store = ~bad & ~ended & (dc | (size > 0))
        out[block[lane[store]] * 64 + place[store]] = value[store]
        kk = np.where(ended, 64, place + 1)
        turn = kk >= 64
        k[lane] = np.where(turn, 0, kk)
        block[lane[turn]] += 1
        in_interval[lane[turn]] += 1
        if bad.any():
            for n in set(owner[lane[bad]].tolist()):
                ok[n] = False
        finished = bad | (turn & (block[lane] >= stop_block[lane]))
        if finished.any():
            lane = lane[~finished]
    out = out.reshape(-1, 64)
    result, first = [], 0
    for fine, (_, _, x) in zip(ok, parts):
        size = int(x.sum())
        result.append(out[first : first + size] if fine else None)
        first += size
    return result


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance, a pixel for each 8 x 8 block, from first coefficients alone."""
    per_unit = sum(h * v for h, v, _ in image.sampling)
    h, v, q = image.sampling[0]
    dc = coefficients[:, 0].reshape(image.rows, image.columns, per_unit)[:, :, : h * v]
    grid = dc.reshape(image.rows, image.columns, v, h).transpose(0, 2, 1, 3).reshape(image.rows * v, image.columns * h)
    wide = max(x for x, _, _ in image.sampling)
    high = max(x for _, x, _ in image.sampling)
    grid = grid[: -(-image.height * v // (8 * high)), : -(-image.width * h // (8 * wide))]
    return np.clip(np.rint(grid * float(image.quant[q][0]) / 8) + 128, 0, 255).astype(np.uint8)


def read_images(files: list[bytes | None]) -> list[tuple[Image, np.ndarray] | None]:
    """Markers and coefficients of each file; None for what is no readable file."""
    out: list = [None] * len(files)
    alike: dict = {}
    for n, data in enumerate(files):
        try:
            image = Image(data or b"")
            alike.setdefault(image.layout(), []).append((n, image))
        except (ValueError, IndexError, struct.error, KeyError):
            pass
    for some in alike.values():
        for (n, image), found in zip(some, decode_scans([x for _, x in some])):
            out[n] = None if found is None else (image, found)
    return out


def payload_of(image: Image, coefficients: np.ndarray) -> bytes | None:
    """The payload that write_images stored, if it was that which wrote the file."""
    n = next((int(c[6:]) for c in image.comments if c.startswith(b"bytes=") and c[6:].isdigit()), None)
    return None if n is None else (coefficients + np.int16(128)).astype(np.uint8).tobytes()[:n]


def feature_of(image: Image, coefficients: np.ndarray) -> str:
    small = thumbnail(image, coefficients)
    return f"{image.width}x{image.height}:{small.shape[1]}x{small.shape[0]}:{hashlib.blake2b(small.tobytes(), digest_size=8).hexdigest()}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): every whole text as a JPEG."""
    ship(docs.sparkSession)
    rows = own_columns(docs, id=id_col, text=text_col)

    def run(batches):
        claim("media")
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            whole = raw.tobytes()
            for i, j in chunks(offsets, STEP_BYTES // 2):
                at = offsets[i : j + 1].tolist()
                texts = [whole[x:y] for x, y in zip(at, at[1:])]
                files = write_images([t + b" " * (-len(t) % UNIT or (0 if t else UNIT)) for t in texts])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(list(map(len, texts)), pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored files."""
    ship(media.sparkSession)
    rows = own_columns(media, id="id", n_bytes="n_bytes", media="media")

    def run(batches):
        claim("media")
        for b in batches:
            files = b.column(2).to_pylist()
            sizes = np.concatenate(([0], np.cumsum([len(f or b"") for f in files]))).astype(np.int64)
            for i, j in chunks(sizes, STEP_BYTES):
                found, some = [], files[i:j]
                for x in read_images(some):
                    p = x and payload_of(*x)
                    found.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), feature_of(*x)) if p is not None else (None, None, None, feature_of(*x) if x else None))
                n, sha, tail, feature = zip(*found)
                columns = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64())]
                columns += [pa.array([None if f is None else len(f) for f in some], pa.int64()), pa.array([None if f is None else hashlib.sha256(f).hexdigest() for f in some], pa.string()), pa.array(feature, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_media(to_media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
