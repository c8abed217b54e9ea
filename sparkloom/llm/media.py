"""Media columns of telephony audio: mu-law, A-law and ADPCM.

A media value is a WAVE file in one binary column. mu-law and A-law samples are
expanded with tables of 256 entries; blocks of IMA ADPCM are decoded with numpy
across blocks, one nibble place of all blocks of a batch at a time. Decoded
speech, all of it at 8 kHz, is resampled by a polyphase filter to 16 kHz, and this
16-bit PCM is stored in a column, every sample of it, and read back for features.

``decode_media`` can pack its column as well (``pack_pcm``): every second sample as it
is and the others as their difference from what the resampling filter makes of these.
Such a column holds little more than the media, and its reader runs the filter again, so
it doesn't stand for stored PCM and the round trip has none.

PCM takes many times the room of the media and hardly compresses. The round trip keeps
the whole column, or stores it in waves: every row belongs to one, by hash; a wave's PCM is
stored as a whole, read back and described, and removed when its rows are written, so
one wave's is on disk at a time and no PCM is kept.

A payload's coding is chosen by its checksum (``CODINGS``), so equal texts give
equal values. The share of ADPCM is small: it was set when PCM was packed, which its
two samples to a byte with four bits of noise in each withstand.

Cases: null text is an empty payload, padded to one block of 576 bytes; rows that
repeat a doc_id are stored each on its own; a damaged file gives null PCM; an
empty table gives no row; other columns are ignored; where a column is added, one
of the same name is replaced. A document's PCM is one value of up to 2 GB: 4 bytes for
each of its text's in G.711, 8 in ADPCM.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import fresh_path, in_workers, opened

PAD, BLOCK, TAIL = 255, 576, 32
RATE, TARGET_RATE = 8000, 16000
#: WAVE format numbers of the codings.
FORMATS = {"mulaw": 7, "alaw": 6, "ima": 17, "pcm": 1}
#: Of each 16 payloads by checksum so many have this coding, at this rate and with blocks of so many bytes.
CODINGS = (("mulaw", 8, RATE, 1), ("alaw", 7, RATE, 1), ("ima", 1, RATE, BLOCK))
#: Bytes of files that are decoded together.
BATCH_BYTES = 1 << 20
#: How media and PCM columns are stored: long pages, since they outweigh all else.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "7", "parquet.page.size": str(8 << 20)}
#: Rows of a row group of PCM. Spark reads up to 4,096 rows of one at once, and where texts compress well its bytes don't bound them.
PCM_ROWS = 64
#: Waves of a round trip that doesn't keep its PCM; each wave reads the media anew.
WAVES = 8
#: Taps of the resampling filter on each side, in input samples.
REACH = 8


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte (ITU-T G.711)."""
    code = ~np.arange(256, dtype=np.uint8)
    value = (((code & 0x0F).astype(np.int32) << 3) + 0x84 << ((code & 0x70) >> 4).astype(np.int32)) - 0x84
    return np.where(code & 0x80, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte (ITU-T G.711)."""
    code = np.arange(256, dtype=np.uint8) ^ np.uint8(0x55)
    step = ((code & 0x70) >> 4).astype(np.int32)
    value = ((code & 0x0F).astype(np.int32) << 4) + 8
    value = np.where(step > 0, value + 0x100 << np.maximum(step - 1, 0), value)
    return np.where(code & 0x80, value, -value).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()

# Step sizes and index moves of IMA ADPCM.
IMA_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def decode_ima(data: np.ndarray, block: int) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks; all blocks advance one sample at a time together."""
    n = len(data) // block
    if not n:
        return np.zeros(0, np.int16)
    rows = data[: n * block].reshape(n, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2].astype(np.int32), 88)
    nibbles = np.stack([rows[:, 4:] & 15, rows[:, 4:] >> 4], 2).reshape(n, -1).astype(np.int32)
    out = np.empty((n, 1 + nibbles.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        code, step = nibbles[:, k], IMA_STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code & 7], 0, 88)
        out[:, k + 1] = value
    return out.ravel()


def encode_ima(pcm: np.ndarray, block: int) -> np.ndarray:
    """IMA ADPCM blocks of ``pcm``, padded with its last sample; across blocks as well."""
    size = 1 + 2 * (block - 4)
    n = -(-len(pcm) // size)
    rows = np.pad(pcm.astype(np.int32), (0, n * size - len(pcm)), "edge").reshape(n, size) if len(pcm) else np.zeros((0, size), np.int32)
    value = rows[:, 0].copy()
    early = np.abs(np.diff(rows[:, :9], axis=1)).mean(1) if n and size > 1 else np.zeros(n)
    index = np.minimum(np.searchsorted(IMA_STEPS, early), 88).astype(np.int32)  # as loud as the block begins
    head = np.zeros((n, 4), np.uint8)
    head[:, 2] = index
    head[:, :2] = value.astype("<i2").view(np.uint8).reshape(n, 2)
    codes = np.zeros((n, size - 1), np.uint8)
    for k in range(1, size):
        step, diff = IMA_STEPS[index], rows[:, k] - value
        code, left, change = np.where(diff < 0, 8, 0), np.abs(diff), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= part
            code, left, change = code + bit * take, left - part * take, change + part * take
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code & 7], 0, 88)
        codes[:, k - 1] = code
    return np.concatenate([head, codes[:, ::2] | codes[:, 1::2] << 4], 1).ravel()


def wave(payload: bytes, coding: str = "mulaw", rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAVE file with this payload as its samples."""
    bits = {"pcm": 16, "ima": 4}.get(coding, 8)
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if coding == "ima" else b"" if coding == "pcm" else struct.pack("<H", 0)
    align = block if coding == "ima" else bits // 8
    form = struct.pack("<HHIIHH", FORMATS[coding], 1, rate, rate * align if coding != "ima" else rate * block // (1 + 2 * (block - 4)), align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(file: bytes | memoryview) -> tuple[int, int, int, memoryview]:
    """(format, rate, block, payload) of a WAVE file."""
    view = memoryview(file)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data" and form:
            return form[0], form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def expand(file: bytes | memoryview) -> tuple[np.ndarray, int]:
    """Linear PCM and its rate."""
    kind, rate, block, payload = unwave(file)
    data = np.frombuffer(payload, np.uint8)
    if kind == FORMATS["mulaw"]:
        return MULAW[data], rate
    if kind == FORMATS["alaw"]:
        return ALAW[data], rate
    if kind == FORMATS["ima"]:
        return decode_ima(data, block), rate
    if kind == FORMATS["pcm"]:
        return data[: len(data) // 2 * 2].view("<i2").astype(np.int16), rate
    raise ValueError(f"unknown coding {kind}")


def resample(pcm: np.ndarray, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """Windowed-sinc polyphase resampling to 16-bit PCM."""
    if rate == target or not len(pcm):
        return pcm.astype(np.int16)
    up, down = target // math.gcd(rate, target), rate // math.gcd(rate, target)
    cutoff = min(1.0, up / down)
    reach = math.ceil(REACH / cutoff)
    n = -(-len(pcm) * up // down)
    padded = np.pad(pcm.astype(np.float32), (reach, reach + 1))
    out = np.empty(n, np.float32)
    for phase in range(up):  # outputs phase, phase + up, ...: inputs a fixed step apart
        at, place = divmod(phase * down, up)
        taps = np.arange(-reach, reach + 1) - place / up
        kernel = (cutoff * np.sinc(cutoff * taps) * np.cos(np.pi * taps / (2 * reach + 2)) ** 2).astype(np.float32)
        kernel /= kernel.sum()
        count = len(range(phase, n, up))
        own = np.zeros(count, np.float32)
        for k, tap in enumerate(kernel):
            if abs(tap) > 1e-7:
                own += tap * padded[at + k : at + k + down * count : down][:count]
        out[phase::up] = own
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


#: Numbers that are packed to one width, and numbers that are packed together.
BLOCK_NUMBERS, PACKED = 256, 1 << 18


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers: each block's width in bits, then the bits, narrow blocks first."""
    out = []
    for a in range(0, len(values), PACKED):
        part = values[a : a + PACKED].astype(np.uint32)
        rows = np.zeros((-(-len(part) // BLOCK_NUMBERS), BLOCK_NUMBERS), np.uint32)
        rows.ravel()[: len(part)] = part
        widths = np.frexp(rows.max(1).astype(np.float64))[1].astype(np.uint8)
        out.append(widths.tobytes())
        for w in np.unique(widths[widths > 0]).tolist():
            own = rows[widths == w]
            bits = np.empty((*own.shape, w), np.uint8)
            for k in range(w):
                bits[:, :, k] = own >> np.uint32(k) & np.uint32(1)
            out.append(np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little").tobytes())
    return b"".join(out)


def unpack_numbers(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    """The ``n`` numbers that ``data`` begins with, and the bytes that they took."""
    out, at = np.empty(n, np.uint32), 0
    for a in range(0, n, PACKED):
        count = min(PACKED, n - a)
        blocks = -(-count // BLOCK_NUMBERS)
        widths = np.frombuffer(data, np.uint8, blocks, at)
        at += blocks
        rows = np.zeros((blocks, BLOCK_NUMBERS), np.uint32)
        for w in np.unique(widths[widths > 0]).tolist():
            own = np.flatnonzero(widths == w)
            size = BLOCK_NUMBERS // 8 * w
            bits = np.unpackbits(np.frombuffer(data, np.uint8, len(own) * size, at).reshape(len(own), size), axis=1, bitorder="little").reshape(len(own), BLOCK_NUMBERS, w)
            at += len(own) * size
            total = np.zeros((len(own), BLOCK_NUMBERS), np.uint32)
            for k in range(w):
                total |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            rows[own] = total
        out[a : a + count] = rows.ravel()[:count]
    return out, at


def _signed(x: np.ndarray) -> np.ndarray:
    """Differences as small unsigned numbers: 0, -1, 1, -2, ..."""
    return ((x << 1) ^ (x >> 31)).astype(np.uint32)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint32(1)).astype(np.int32) ^ -(x & np.uint32(1)).astype(np.int32)


#: Tables whose values are kept as one byte; a file of other values has a palette of its own, or none.
LEVELS = {0: MULAW, 1: ALAW}
PALETTE, PLAIN = 2, 3


def _codes(values: np.ndarray, table: np.ndarray) -> np.ndarray | None:
    """For each value the place of an equal one in ``table``; None if there is one without."""
    order = np.argsort(table, kind="stable")
    at = np.minimum(np.searchsorted(table, values, sorter=order), len(table) - 1)
    codes = order[at].astype(np.uint8)
    return codes if np.array_equal(table[codes], values) else None


def pack_pcm(pcm: np.ndarray) -> bytes:
    """16-bit PCM without loss: see the module's text."""
    even, odd = pcm[0::2].astype(np.int16), pcm[1::2].astype(np.int32)
    head = None
    for kind, table in LEVELS.items():
        if (codes := _codes(even, table)) is not None:
            head = struct.pack("<IB", len(pcm), kind) + codes.tobytes()
            break
    if head is None:
        colours = np.unique(even)
        if len(colours) <= 256:
            head = struct.pack("<IBB", len(pcm), PALETTE, len(colours) - 1) + colours.astype("<i2").tobytes() + _codes(even, colours).tobytes()
        else:
            head = struct.pack("<IB", len(pcm), PLAIN) + even.astype("<i2").tobytes()
    return head + pack_numbers(_signed(odd - resample(even, 1, 2)[1::2][: len(odd)].astype(np.int32)))


def unpack_pcm(packed: bytes | memoryview) -> np.ndarray:
    """The samples that ``pack_pcm`` packed."""
    data = memoryview(packed)
    n, kind = struct.unpack_from("<IB", data)
    at, evens = struct.calcsize("<IB"), (n + 1) // 2
    if kind == PLAIN:
        even, at = np.frombuffer(data, "<i2", evens, at).astype(np.int16), at + 2 * evens
    else:
        table = LEVELS.get(kind)
        if table is None:
            colours, at = struct.unpack_from("<B", data, at)[0] + 1, at + 1
            table, at = np.frombuffer(data, "<i2", colours, at), at + 2 * colours
        even, at = table[np.frombuffer(data, np.uint8, evens, at)], at + evens
    rest, _ = unpack_numbers(data[at:], n // 2)
    out = np.empty(n, np.int16)
    out[0::2] = even
    out[1::2] = resample(even, 1, 2)[1::2][: n // 2] + _unsigned(rest)
    return out


def features(pcm: np.ndarray, rate: int) -> str:
    """Length, loudness, crossings of zero and a checksum of PCM."""
    x = pcm.astype(np.float64)
    rms = math.sqrt(float(x @ x) / len(x)) if len(x) else 0.0
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"ms={len(pcm) * 1000 // rate};rms={rms:.3f};peak={int(np.abs(pcm.astype(np.int32)).max(initial=0))};crossings={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def payload_of(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % BLOCK if text else BLOCK)


def coded(payload: bytes) -> bytes:
    """The payload as a WAVE file, in the coding that its checksum chooses."""
    place = zlib.crc32(payload) % sum(share for _, share, _, _ in CODINGS)
    for coding, share, rate, block in CODINGS:
        if place < share:
            return wave(payload, coding, rate, block)
        place -= share
    raise AssertionError(place)


def pcm_of(files: list[memoryview | bytes | None], target: int = TARGET_RATE) -> list[np.ndarray | None]:
    """Resampled PCM of each file; None for damaged ones. ADPCM blocks of all files are decoded together."""
    out: list[np.ndarray | None] = [None] * len(files)
    blocks: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, file in enumerate(files):
        try:
            kind, rate, block, payload = unwave(file)
            if kind == FORMATS["ima"] and block > 4:
                blocks.setdefault(block, []).append((i, rate, np.frombuffer(payload, np.uint8)))
            else:
                out[i] = resample(*expand(file), target)
        except (ValueError, TypeError, struct.error):
            pass
    for block, own in blocks.items():
        whole = [data[: len(data) // block * block] for _, _, data in own]
        pcm, at = decode_ima(np.concatenate(whole), block), 0
        for (i, rate, _), data in zip(own, whole, strict=True):
            n = len(data) // block * (1 + 2 * (block - 4))
            out[i] = resample(pcm[at : at + n], rate, target)
            at += n
    return out


def _parts(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BATCH_BYTES each, or one row."""
    a, held = 0, 0
    for b, n in enumerate(lengths):
        if b > a and held + n > BATCH_BYTES:
            yield a, b
            a, held = b, 0
        held += n
    if len(lengths) > a:
        yield a, len(lengths)


def store_media(docs: DataFrame, path: str) -> None:
    """Write (doc_id, n_bytes, media): each whole text's bytes as a WAVE file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _parts([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)]):
                texts = [(x.as_py() or "").encode() for x in batch.column(1)[a:b]]
                files = pa.array([coded(payload_of(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), files], names=["doc_id", "n_bytes", "media"])

    in_workers(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary", "media").write.options(**STORED).parquet(path)


def _views(column: pa.Array) -> list[memoryview | None]:
    return [memoryview(x.as_buffer()) if x.is_valid else None for x in column]


def decode_media(media: DataFrame, column: str = "media", target: int = TARGET_RATE, into: str = "pcm", packed: bool = False) -> DataFrame:
    """``media`` with a column ``into`` (16-bit PCM, little-endian, at ``target`` Hz, or ``packed``); null for damaged files."""
    kept = [f for f in media.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = _views(batch.column(column))
            for a, b in _parts([0 if f is None else len(f) for f in files]):
                part = batch.slice(a, b - a)
                pcm = [None if x is None else pack_pcm(x) if packed else x.astype("<i2").tobytes() for x in pcm_of(files[a:b], target)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(pcm, pa.binary())], names=[*(f.name for f in kept), into])

    return in_workers(media, run, schema, "media")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def digests(media: DataFrame) -> DataFrame:
    """``DIGESTS`` of payload and file of each media value as read, its coding, and the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {number: name for name, number in FORMATS.items()}
        for batch in batches:
            rows = []
            for doc, n, file in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), _views(batch.column("media")), strict=True):
                kind, _, _, payload = unwave(file)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(file), hashlib.sha256(file).hexdigest(), names[kind]))
            if rows:
                columns = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("media")], names=[*(c.split()[0] for c in DIGESTS.split(", ")), "coding", "media"])

    return in_workers(media, run, DIGESTS + ", coding string, media binary", "media")


def described(speech: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """``DIGESTS`` and the features of the stored PCM (``pcm``)."""
    schema = DIGESTS + ", feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f"coding={coding};" + features(np.frombuffer(pcm, "<i2"), rate) for coding, pcm in zip(batch.column("coding").to_pylist(), _views(batch.column("pcm")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c.split()[0]) for c in DIGESTS.split(", ")), pa.array(found, pa.string())], names=[c.split()[0] for c in schema.split(", ")])

    return in_workers(speech, run, schema, "media")


def store_pcm(media: DataFrame, path: str) -> DataFrame:
    """Write ``digests`` of media values with their resampled PCM (``pcm``) in the value's place, and read them back."""
    speech = decode_media(digests(media), into="media").withColumnRenamed("media", "pcm")  # in the file's place, which need not leave the worker
    speech.write.options(**STORED, **{"parquet.block.row.count.limit": str(PCM_ROWS)}).parquet(path)
    return media.sparkSession.read.schema(speech.schema).parquet(path)


def media_round_trip(docs: DataFrame, waves: int | None = None) -> DataFrame:
    """Store the media column below the shared folder, decode what is read back, store
    its resampled PCM, and describe both as read. With ``waves`` the PCM is stored in so
    many parts, one after another, and isn't kept (see the module's text)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "media")
    store_media(docs, path)
    media = spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)
    if waves is None:
        return described(store_pcm(media, fresh_path(spark, "media-pcm")))
    rows = fresh_path(spark, "media-rows")
    for wave in range(waves):
        own = media.where(F.pmod(F.xxhash64("doc_id", "media"), F.lit(waves)) == wave)
        at = fresh_path(spark, "media-pcm")
        found = described(store_pcm(own, at))
        found.write.mode("append").options(compression="zstd").parquet(rows)
        store, folder = opened(at)
        store.delete_dir(folder)
    return spark.read.schema(found.schema).parquet(rows)
