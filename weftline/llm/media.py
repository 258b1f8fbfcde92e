"""Media columns: signature sniffing, structure validation, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one scan of a value.  At
each hit the format's validator walks the structure and returns the length that it confirms, or
nothing.  A hit at the start decides the value's type (correcting the declared one); hits inside
are embedded media, which are carved out.  Magic bytes without a confirmed structure are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, parts, table, worker_state

#: Samples a second of text stored as sound, and bytes searched for magic bytes at once.
RATE, WINDOW = 8000, 1 << 20


class Marks:
    """End marks of a value, each kind searched for once, and parts of structures that hits share."""

    def __init__(self, b: bytes):
        self.b, self.places, self.known = b, {}, {}
        self.inflated = 0  # end of what the gzip streams so far have read without an error

    def of(self, mark: bytes) -> list[int]:
        """Places of a mark, ascending, not overlapping."""
        if mark not in self.places:
            found, at = [], self.b.find(mark)
            while at >= 0:
                found.append(at)
                at = self.b.find(mark, at + len(mark))
            self.places[mark] = found
        return self.places[mark]

    def after(self, mark: bytes, at: int) -> int:
        """First place of a mark at or behind a position, or -1."""
        places = self.of(mark)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def chain(self, name: str, at: int, step):
        """Result of a chain of parts: step(at) gives ("next", place) or ("end", result); what several hits walk through is walked once."""
        known, path = self.known.setdefault(name, {}), []
        while at not in known:
            path.append(at)
            what, value = step(at)
            if what == "end":
                known[path[-1]] = value
                break
            at = value
        result = known[at]
        for place in path:
            known[place] = result
        return result


def wav_length(m: Marks, at: int) -> int | None:
    """RIFF/WAVE: chunks must fill the declared size and hold a format and then data."""
    b = m.b
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, seen = at + 12, []
    while pos + 8 <= end:
        size = struct.unpack_from("<I", b, pos + 4)[0]
        seen.append(b[pos : pos + 4])
        pos += 8 + size + (size & 1)
    return end - at if pos == end and b"fmt " in seen and b"data" in seen[seen.index(b"fmt ") :] else None


def png_length(m: Marks, at: int) -> int | None:
    """PNG: chunks with right checksums from IHDR to IEND."""
    b = m.b
    if b[at + 12 : at + 16] != b"IHDR":
        return None

    def chunk(pos: int):
        if pos + 12 > len(b):
            return "end", None
        stop = pos + 12 + struct.unpack_from(">I", b, pos)[0]
        if stop > len(b) or zlib.crc32(memoryview(b)[pos + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return "end", None
        return ("end", stop) if b[pos + 4 : pos + 8] == b"IEND" else ("next", stop)

    end = m.chain("png", at + 8, chunk)
    return end - at if end is not None else None


def gif_length(m: Marks, at: int) -> int | None:
    """GIF: screen descriptor, then blocks up to the trailer."""
    b = m.b
    if len(b) - at < 13:
        return None

    def block(pos: int):
        if pos >= len(b):
            return "end", None
        return ("next", pos + 1 + b[pos]) if b[pos] else ("end", pos + 1)

    def part(pos: int):
        if pos >= len(b):
            return "end", None
        if b[pos] == 0x3B:
            return "end", pos + 1
        if b[pos] == 0x21:
            pos = m.chain("gif block", pos + 2, block)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos = m.chain("gif block", pos + 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0), block)
        else:
            return "end", None
        return ("next", pos) if pos is not None else ("end", None)

    end = m.chain("gif", at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0), part)
    return end - at if end is not None else None


def jpeg_length(m: Marks, at: int) -> int | None:
    """JPEG: marker segments up to the start of scan, then entropy-coded data up to the end marker."""
    b = m.b

    def segment(pos: int):
        if pos + 4 > len(b) or b[pos] != 0xFF:
            return "end", None
        mark, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if mark == 0xDA:
            end = m.after(b"\xff\xd9", pos + 2 + size)
            return "end", end + 2 if end >= 0 else None
        return ("end", None) if mark < 0xC0 or size < 2 else ("next", pos + 2 + size)

    end = m.chain("jpeg", at + 2, segment)
    return end - at if end is not None else None


def bmp_length(m: Marks, at: int) -> int | None:
    """BMP: declared size, pixel offset inside it, and a known header size."""
    b = m.b
    if len(b) - at < 54:
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    ok = 54 <= size <= len(b) - at and not zero and header in (40, 108, 124) and 14 + header <= offset <= size
    return size if ok else None


def zip_length(m: Marks, at: int) -> int | None:
    """ZIP: an end record whose directory lies right before it and whose offset leads back to the start."""
    b = m.b
    if "zip" not in m.known:
        starts = m.known["zip"] = {}  # start that an end record leads back to: where the file ends
        for end in m.of(b"PK\x05\x06"):
            if end + 22 <= len(b):
                size, offset, note = struct.unpack_from("<IIH", b, end + 12)
                if end + 22 + note <= len(b) and (not size or b[end - size : end - size + 4] == b"PK\x01\x02"):
                    starts.setdefault(end - size - offset, end + 22 + note)
    end = m.known["zip"].get(at)
    return end - at if end is not None else None


def gzip_length(m: Marks, at: int) -> int | None:
    """GZIP: the stream must inflate, piece by piece, and its checks must hold.

    Magic bytes inside a stream that goes on, to its end or that of the value, are part of it.
    """
    b = m.b
    if at < m.inflated:
        return None
    inflate, pos, piece = zlib.decompressobj(31), at, 256
    try:
        while pos < len(b) and not inflate.eof:
            inflate.decompress(b[pos : pos + piece])
            pos += piece
            piece = min(2 * piece, 65536)
    except zlib.error:
        return None
    m.inflated = min(pos, len(b)) - len(inflate.unused_data)
    return m.inflated - at if inflate.eof else None


def pdf_length(m: Marks, at: int) -> int | None:
    """PDF: version digits, and a cross-reference pointer before the end mark."""
    end = m.after(b"%%EOF", at)
    if end < 0 or not m.b[at + 5 : at + 6].isdigit():
        return None
    pointer = m.after(b"startxref", at)
    return end + 5 - at if 0 <= pointer <= end - 9 else None


#: Magic bytes, media type, validator.
FORMATS = (
    (b"RIFF", "audio/wav", wav_length),
    (b"\x89PNG\r\n\x1a\n", "image/png", png_length),
    (b"GIF87a", "image/gif", gif_length),
    (b"GIF89a", "image/gif", gif_length),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_length),
    (b"BM", "image/bmp", bmp_length),
    (b"PK\x03\x04", "application/zip", zip_length),
    (b"\x1f\x8b\x08", "application/gzip", gzip_length),
    (b"%PDF-", "application/pdf", pdf_length),
)


def automaton():
    """The worker's Aho-Corasick automaton over all magic bytes."""
    import ahocorasick

    state = worker_state()
    if "magic" not in state:
        state["magic"] = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            state["magic"].add_word(magic.decode("latin-1"), k)
        state["magic"].make_automaton()
    return state["magic"]


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every confirmed medium in a value, by offset, embedded ones too.

    Each end mark is searched for once and shared parts of structures are walked once, so a value
    full of magic bytes costs little more than another.
    """
    found, marks, before = [], Marks(value), max(len(f[0]) for f in FORMATS) - 1
    for start in range(0, len(value), WINDOW):
        lo = max(0, start - before)
        for last, k in automaton().iter(value[lo : start + WINDOW].decode("latin-1")):
            if lo + last < start:
                continue  # the window before had it
            magic, kind, length_of = FORMATS[k]
            at = lo + last + 1 - len(magic)
            length = length_of(marks, at)
            if length is not None:
                found.append((kind, at, length))
    return sorted(found, key=lambda f: (f[1], -f[2], f[0]))


def sniff_column(values: DataFrame, media: str = "media", declared: str = "declared_type", carve: bool = True) -> DataFrame:
    """doc_id, detected_type, corrected, confirmed length and carved media of every value.

    detected_type is that of a medium that starts at byte 0, else the declared type; `carved` holds
    struct(type, offset, length, content) of media found further in (content null unless carve).
    Null and empty values keep their declared type and hold nothing; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        inner = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])
        for batch in (part for whole in batches for part in parts(whole, 1)):
            kinds, fixed, length, carved = [], [], [], []
            for value, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = sniff(value or b"")
                head = next((f for f in found if f[1] == 0), None)
                kinds.append(head[0] if head else said)
                fixed.append(bool(head and head[0] != said))
                length.append(head[2] if head else None)
                carved.append([{"type": k, "offset": a, "length": n, "content": value[a : a + n] if carve else None} for k, a, n in found if a])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "detected_type": pa.array(kinds, pa.string()), "corrected": pa.array(fixed, pa.bool_()), "length": pa.array(length, pa.int64()), "carved": pa.array(carved, pa.list_(inner))})

    schema = "doc_id long, detected_type string, corrected boolean, length long, carved array<struct<type: string, offset: long, length: long, content: binary>>"
    return values.select(values["doc_id"].cast("long").alias("doc_id"), F.col(media).cast("binary"), F.col(declared).cast("string")).mapInArrow(run, schema)


def as_wav(payload: bytes) -> bytes:
    """Bytes as 8-bit mono samples in a WAV file."""
    pad = len(payload) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def wav_samples(value: bytes, at: int, length: int) -> bytes:
    """Samples of a confirmed WAV file inside a value."""
    pos = at + 12
    while pos < at + length:
        size = struct.unpack_from("<I", value, pos + 4)[0]
        if value[pos : pos + 4] == b"data":
            return value[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    return b""


def padded(raw: bytes) -> bytes:
    """A text's bytes, zeros appended up to a positive multiple of 64."""
    return raw + b"\0" * ((-len(raw)) % 64 if raw else 64)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (every whole text as a sound file) and declared_type, which is wrong on purpose.

    Null texts are empty, and an empty text is stored as 64 zero bytes; texts of any length are
    stored whole; repeated rows give equal values; an empty table gives none; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, 1)):
            raw = as_bytes(batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "media": pa.array([as_wav(padded(r)) for r in raw], pa.binary()), "declared_type": pa.array(["application/octet-stream"] * len(raw))})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared_type string")


def media_features(stored: DataFrame) -> DataFrame:
    """What is read back from stored media: the payload's digests and features of its samples.

    One row for each row of stored, equal for equal media; an empty table gives none.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, 2)):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for value, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = sniff(value)
                kind, at, length = next((f for f in found if f[1] == 0), (said, 0, len(value)))
                payload = wav_samples(value, at, length) if kind == "audio/wav" else value
                x = np.frombuffer(payload, dtype=np.uint8)
                crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                inside = ",".join(f"{k}@{a - 44}+{n}" for k, a, n in found if a) or "none"
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-64:]))
                out["media_bytes"].append(len(value))
                out["media_sha256"].append(hashlib.sha256(value).hexdigest())
                out["feature"].append(f"{said}>{kind};n={len(x)};sum={int(x.sum(dtype=np.int64))};peak={int(x.max(initial=0))};crossings={crossings};inside={inside}")
            columns = {k: pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for k, v in out.items()} if len(batch) else {}
            if columns:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(1)} | columns)

    return stored.select("doc_id", "n_bytes", "media", "declared_type").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(table(spark, sf_dir, "documents")))
