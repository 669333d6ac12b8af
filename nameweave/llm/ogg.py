"""Media columns: byte payloads as 8-bit samples in Ogg streams, with checked pages, reassembled packets and granule times.

A payload is cut into blocks of BLOCK samples, dealt in turn to STREAMS logical streams that are multiplexed page by
page into one physical stream. Each logical stream starts with an identification packet on a page of its own; its other
packets are blocks, laced in values of up to 255, and a packet may run over pages. The granule position of a page is the
number of the stream's samples that are complete by the end of it, and -1 where no packet ends.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import in_batches

#: 4000 samples take 16 lacing values, which don't divide the 255 of a page, so packets run over pages.
RATE, BLOCK, STREAMS, SEGMENTS = 8000, 4000, 2, 255
CAPTURE, IDENT = b"OggS", b"\x01rawpcm8"
CONTINUED, BOS, EOS = 1, 2, 4
NO_GRANULE = (1 << 64) - 1

_HEAD = struct.Struct("<4sBBQIIIB")
_IDENT = struct.Struct("<8sIIBBQ")
#: Every byte with its bits in reverse.
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are no sound Ogg stream."""


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, from 0 and without a final inversion.

    That is zlib's CRC of the bytes with their bits in reverse, itself in reverse, once its inversions are undone.
    """
    c = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def _pages(packets: list[bytes], granules: list[int], serial: int) -> Iterator[bytes]:
    """The pages of one logical stream; the first packet has a page of its own."""
    number = 0
    lacing, body, done, continued = bytearray(), bytearray(), NO_GRANULE, False
    for k, (packet, granule) in enumerate(zip(packets, granules, strict=True)):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            take = values[: SEGMENTS - len(lacing)]
            values = values[len(take) :]
            n = sum(take)
            lacing += take
            body += packet[at : at + n]
            at += n
            if not values:
                done = granule
            last = k == len(packets) - 1 and not values
            if last or k == 0 or len(lacing) == SEGMENTS:
                flags = CONTINUED * continued | BOS * (number == 0) | EOS * last
                yield _page(flags, done, serial, number, bytes(lacing), bytes(body))
                number, continued, done = number + 1, bool(values), NO_GRANULE
                lacing, body = bytearray(), bytearray()


def mux(payload: bytes, rate: int = RATE, block: int = BLOCK, streams: int = STREAMS) -> bytes:
    """The payload as an Ogg file. Equal payloads give equal files."""
    blocks = [payload[i : i + block] for i in range(0, len(payload), block)]
    seed = zlib.crc32(payload)
    each = []
    for s in range(streams):
        own = blocks[s::streams]
        ident = _IDENT.pack(IDENT, rate, block, s, streams, len(payload))
        ends, total = [0], 0
        for b in own:
            ends.append(total := total + len(b))
        each.append(list(_pages([ident, *own], ends, (seed + s) & 0xFFFFFFFF)))
    out = [p[0] for p in each]  # all first pages come before any other
    for i in range(1, max(map(len, each))):
        out += [p[i] for p in each if i < len(p)]
    return b"".join(out)


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, number, lacing, body) of each page, whose checksum is verified."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise OggError(f"cut off at byte {at}")
        capture, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + _HEAD.size : at + _HEAD.size + n]
        end = at + _HEAD.size + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"cut off at byte {at}")
        if page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        yield flags, granule, serial, number, lacing, view[at + _HEAD.size + n : end]
        at = end


def demux(data: bytes) -> dict[int, dict]:
    """By serial number: packets, the granule position at which each ends, (granule, packets complete) of each page, pages, and whether the stream ended.

    A granule position holds for the last packet that ends on its page. The end of an earlier one on that page
    follows from the sizes of those after it, as a sample is one byte.
    """
    found: dict[int, dict] = {}
    for flags, granule, serial, number, lacing, body in read_pages(data):
        if flags & BOS:
            if serial in found:
                raise OggError(f"stream {serial} begins twice")
            found[serial] = {"packets": [], "ends": [], "granules": [], "pages": 0, "ended": False, "part": None}
        s = found.get(serial)
        if s is None or s["ended"] or number != s["pages"]:
            raise OggError(f"page {number} of stream {serial} is out of place")
        if bool(flags & CONTINUED) != (s["part"] is not None):
            raise OggError(f"page {number} of stream {serial} continues no packet")
        s["pages"] += 1
        part, at, closed = s["part"] or [], 0, []
        start = 0
        for v in lacing:
            at += v
            if v < 255:
                closed.append(b"".join([*part, body[start:at]]))
                part, start = [], at
        s["part"] = [*part, bytes(body[start:at])] if lacing and lacing[-1] == 255 else None
        if closed:
            end = granule
            ends = []
            for p in reversed(closed):
                ends.append(end)
                end -= len(p)
            s["packets"] += closed
            s["ends"] += ends[::-1]
        elif granule != NO_GRANULE:
            raise OggError(f"page {number} of stream {serial} has a time, but no packet ends on it")
        s["granules"].append((granule, len(s["packets"])))
        s["ended"] = bool(flags & EOS)
    for serial, s in found.items():
        if not s["ended"] or s["part"] is not None:
            raise OggError(f"stream {serial} doesn't end")
    return found


def _timed(s: dict) -> bool:
    """Whether each page's granule position is the number of samples complete on it, and none where no packet ends."""
    complete, samples = 0, 0
    for granule, packets in s["granules"]:
        samples += sum(map(len, s["packets"][max(1, complete) : packets]))
        if granule != (samples if packets > complete else NO_GRANULE):
            return False
        complete = packets
    return True


def sounding(payload: bytes) -> str:
    """Mean and root mean square of the samples around their middle, and how often they cross it."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={int(x.sum()) / n:.6f};rms={(int((x * x).sum()) / n) ** 0.5:.6f};crossings={crossings}"


def restore(data: bytes) -> tuple[bytes, str]:
    """The payload, and features: seconds in all, pages, packets and seconds of each stream, and those of `sounding`."""
    of: dict[int, dict] = {}
    for s in demux(data).values():
        first = s["packets"][0] if s["packets"] else b""
        if len(first) != _IDENT.size or not first.startswith(IDENT):
            raise OggError("no raw samples")
        _, rate, block, k, streams, size = _IDENT.unpack(first)
        if not rate or k in of:
            raise OggError("no sound head")
        if not _timed(s):
            raise OggError("a granule position is no number of samples")
        of[k] = s | {"rate": rate, "size": size, "streams": streams}
    if not of or len(of) != next(iter(of.values()))["streams"] or sorted(of) != list(range(len(of))):
        raise OggError("a stream is missing")
    blocks = [b""] * sum(len(s["packets"]) - 1 for s in of.values())
    for k, s in of.items():
        if len(blocks[k :: len(of)]) != len(s["packets"]) - 1:
            raise OggError("packets are missing")
        blocks[k :: len(of)] = s["packets"][1:]
    payload = b"".join(blocks)
    if any(s["size"] != len(payload) for s in of.values()):
        raise OggError("samples are missing")
    parts = [f"{s['pages']}/{len(s['packets'])}/{s['ends'][-1] / s['rate'] if len(s['packets']) > 1 else 0:.6f}" for _, s in sorted(of.items())]
    return payload, f"{len(payload) / of[0]['rate']:.6f}s;" + ";".join([*parts, sounding(payload)])


def _whole(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def to_media(text: Column) -> Column:
    """The UTF-8 of a text, with bytes 0 up to a positive multiple of 64, as an Ogg file (binary). Null is an empty text."""

    @F.arrow_udf("binary")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([mux(_whole(x)) for x in b.to_pylist()], pa.binary())

    return f(text)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: Column) -> Column:
    """A struct of FEATURES from stored media; all null where it is null or fails a check."""

    def of(data: bytes | None) -> dict:
        try:
            payload, feature = restore(data or b"")
        except OggError:
            return {}
        return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature}

    kind = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    @F.arrow_udf(f"struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([of(x) for x in b.to_pylist()], kind)

    return f(media)


def media_table(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a column of stored media instead of the text; other columns stay, one named like the new column is replaced."""
    stored = in_batches(docs).withColumn(media, to_media(F.col(text)))
    return stored if media == text else stored.drop(text)


def media_features(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, the features of its stored media, and sound, which is false where a check failed; then features are null.

    Null and empty texts are 64 bytes 0. Long texts are stored whole, in as many pages as they take. Rows stay apart, repeats included, an empty
    table gives none, and other columns aren't read.
    """
    rows = in_batches(docs).select("doc_id", F.col("text").alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    rows = rows.select("doc_id", "n_bytes", to_media(F.col("text")).alias("media"))
    rows = rows.select("doc_id", "n_bytes", features(F.col("media")).alias("f"))
    return rows.select("doc_id", "n_bytes", "f.*", F.col("f.media_sha256").isNotNull().alias("sound"))
