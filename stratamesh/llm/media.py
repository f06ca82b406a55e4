"""Media columns: content-defined chunks of payloads, stored once.

A text's bytes, padded with zeros to a multiple of 64, become the samples of
an 8-bit mono WAV file. A gear rolling hash cuts the file into chunks where
its contents say so; chunks are deduplicated by digest with Spark joins, and
each payload keeps an ordered chunk list. Reading back joins the lists with
the chunk store, verifies the digests and the whole, and computes features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

BLOCK = 64
RATE = 8000
HEADER = 44
#: Chunk sizes in bytes, and the bits of the gear hash that must be zero at a cut.
LEAST, MOST, BITS = 2048, 65_536, 13
GEAR_SPAN = 32
LEVEL = 6


def gear_table() -> np.ndarray:
    return np.random.default_rng(0x67656172).integers(0, 1 << 32, 256, dtype=np.uint32)


def encode_media(data: bytes) -> bytes:
    """A WAV file whose samples are ``data`` padded to a positive multiple of 64."""
    size = max(BLOCK, -(-len(data) // BLOCK) * BLOCK)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)
    return head + data.ljust(size, b"\0")


def decode_media(media: bytes) -> bytes:
    """The samples of such a file."""
    riff, size, wave, *_, bits, tag, length = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, tag, bits) != (b"RIFF", b"WAVE", b"data", 8) or length != len(media) - HEADER or size != len(media) - 8:
        raise ValueError("not an 8-bit WAV file of this size")
    return media[HEADER:]


def cuts(media: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last 32 bytes has BITS zero bits, LEAST to MOST bytes apart."""
    n = len(media)
    if n <= LEAST:
        return [n]
    h = gear[np.frombuffer(media, dtype=np.uint8)]
    span = 1
    while span < GEAR_SPAN:  # hash of 2 x span bytes from two of span bytes
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    at = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    ends, last = [], 0
    while n - last > LEAST:
        k = int(np.searchsorted(at, last + LEAST))
        end = min(int(at[k]) if k < len(at) else n, last + MOST, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def chunks(docs: DataFrame, key: str, text: str = "text", data: bool = True) -> DataFrame:
    """key, ordinal, number of parts, digest, size and, if ``data``, compressed data of each chunk of each text; null counts as empty."""
    names = ["key", "ordinal", "parts", "digest", "size", "data"][: 5 + data]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        gear, press = gear_table(), zstandard.ZstdCompressor(level=LEVEL)
        for frame in frames:
            out = []
            for k, t in dict(zip(frame["key"], frame["__text"])).items():
                media, start = encode_media(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""), 0
                ends = cuts(media, gear)
                for ordinal, end in enumerate(ends):
                    part = media[start:end]
                    out.append((k, ordinal, len(ends), hashlib.sha256(part).digest()[:16], len(part), *([press.compress(part)] if data else ())))
                    start = end
            yield pd.DataFrame(out, columns=names)

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("__text"))
    return own.mapInPandas(run, "key binary, ordinal int, parts int, digest binary, size int" + ", data binary" * data)


def features(payload: bytes) -> str:
    """Mean, deviation and zero crossings of the samples about 128, and their entropy in bits."""
    x = np.frombuffer(payload, dtype=np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    entropy = -float(np.sum(p[p > 0] * np.log2(p[p > 0])))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"mean={x.mean():.4f};std={x.std():.4f};zero_crossings={crossings};entropy={entropy:.4f}"


def read_back(lists: DataFrame, store: DataFrame) -> DataFrame:
    """One row for each key: what the media, put together from the store, contain.

    ``lists`` has key, ordinal, parts and digest; ``store`` has digest, size and data.
    A chunk that is missing or differs from its digest raises an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for frame in frames:
            out = []
            for key, parts in zip(frame["key"], frame["parts"]):
                whole = []
                for i, p in enumerate(sorted(parts, key=lambda p: p["ordinal"])):
                    data = unpack.decompress(p["data"], max_output_size=p["size"])
                    if p["ordinal"] != i or hashlib.sha256(data).digest()[:16] != bytes(p["digest"]):
                        raise ValueError("a chunk is missing or does not match its digest")
                    whole.append(data)
                media = b"".join(whole)
                payload = decode_media(media)
                out.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            yield pd.DataFrame(out, columns=["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    met = lists.join(store, "digest")
    part = F.struct("ordinal", "digest", "size", "data")
    alone = met.filter("parts = 1").select("key", F.array(part).alias("parts"))  # whole where the join left them
    whole = alone.unionByName(met.filter("parts > 1").groupBy("key").agg(F.collect_list(part).alias("parts")))
    return whole.mapInPandas(run, "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes and the columns of ``read_back``.

    Equal texts share chunks, list and result and are put together once.
    Null counts as the empty text, whose payload is 64 zero bytes. Repeated
    rows stay; columns of ``docs`` with the names of results are replaced.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.sha2(whole.cast("binary"), 256))
    own = docs.select(key.alias("key"), text)
    store = chunks(own, "key", text).groupBy("digest").agg(F.first("size").alias("size"), F.first("data").alias("data"))
    lists = materialise(chunks(own, "key", text, data=False).select("key", "ordinal", "parts", "digest").distinct())
    rows = docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "__key": key}).drop(*names[1:], text)
    return rows.join(read_back(lists, store).withColumnRenamed("key", "__key"), "__key").drop("__key")


def op3_media_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_columns(docs)
