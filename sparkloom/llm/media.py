"""Operator 2: interleaved documents with media columns.

``interleave`` parses HTML into an ordered array of parts: text, or a reference
to a medium with its caption. ``store`` turns texts into lossless 8-bit
greyscale PNG images keyed by the digest of their samples, one row a digest.
``describe`` reads stored images back and computes features. ``resolve`` joins
references to described payloads by digest and puts the parts together again in
their order, so that positions and captions stay aligned; a reference without
a payload stays, with nulls.

Nulls: null HTML has no parts; a null text is stored like an empty one, as one
row of spaces. Equal texts share one stored image. Malformed HTML is read as
far as it goes. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textkit as tk

#: Samples in an image row.
WIDTH = 192
PNG = b"\x89PNG\r\n\x1a\n"
REF = "media:"
PARTS = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string())]))
PARTS_SQL = "array<struct<pos: int, kind: string, text: string, ref: string>>"
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "article", "section", "td", "th", "tr", "table", "ul", "ol", "blockquote", "pre", "br", "hr", "footer", "header", "nav", "main", "figure", "title", "body"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class _Parts(HTMLParser):
    """Ordered parts; the caption of a figure belongs to the media in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []
        self.skip = 0

    def flush(self) -> None:
        t = " ".join("".join(self.text).split())
        self.text = []
        if t:
            self.parts.append({"kind": "text", "text": t, "ref": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                self.parts.append({"kind": "media", "text": a.get("alt") or None, "ref": a["src"]})
                self.figure.append(len(self.parts) - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for i in self.figure if said else ():
                self.parts[i]["text"] = said
            self.caption = None
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse_parts(page: str | None) -> list[dict]:
    if page is None:
        return []
    p = _Parts()
    p.feed(page)
    p.close()
    p.flush()
    return [x | {"pos": i} for i, x in enumerate(p.parts)]


def interleave(pages: DataFrame, html_col: str = "html", out: str = "parts") -> DataFrame:
    """pages with an array of parts (pos, kind, text or caption, ref) in place of the HTML."""
    ship(pages.sparkSession)
    names = [c for c in pages.columns if c not in (html_col, out)]
    d = pages.select(*names, pages[html_col].alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [parse_parts(x.as_py()) for x in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(parts, PARTS)], [*names, out])
            del b, parts
            tk.release()

    return d.mapInArrow(run, f"{fields}{', ' if fields else ''}{out} {PARTS_SQL}")


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def encode(samples: bytes) -> bytes:
    """A greyscale PNG of WIDTH columns."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 2)) + chunk(b"IEND", b"")


def decode(stored: bytes) -> np.ndarray:
    """Samples of a greyscale PNG without row filters, as (rows, columns); check sums are verified."""
    if stored[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], (0, 0)
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    return rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation and an 8 x 8 average hash of the image; exact integer sums, a chunk at a time."""
    height, width = samples.shape
    counts, sums, n = np.zeros(256, np.int64), np.zeros((8, 8), np.int64), np.zeros(8, np.int64)
    for a in range(0, height, tk.CHUNK // width):
        x = samples[a : a + tk.CHUNK // width]
        at = np.minimum(np.arange(a, a + len(x)) * 8 // height, 7)
        counts += np.bincount(x.ravel(), minlength=256)
        np.add.at(sums, at, x.reshape(len(x), 8, -1).sum(axis=2, dtype=np.int64))
        n += np.bincount(at, minlength=8) * (width // 8)
    values = np.arange(256)
    mean = int(counts @ values) / samples.size
    dev = max(int(counts @ values**2) / samples.size - mean**2, 0.0) ** 0.5
    bits = (sums / np.maximum(n, 1)[:, None] > mean).ravel()
    return f"{width}x{height};mean={mean:.4f};dev={dev:.4f};hash={np.packbits(bits).tobytes().hex()}"


def as_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and HTML: the lines as paragraphs, then the figure that holds the whole text."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, pages = [], []
            for text in b.column(1).to_pylist():
                raw = payload(text)
                size.append(len((text or "").encode()))
                lines = "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in (text or "").split("\n"))
                pages.append(f'<article>{lines}<figure><img src="{REF}{hashlib.sha256(raw).hexdigest()}"><figcaption>{size[-1]} bytes</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "html"])
            del b, pages
            tk.release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, html string")


def store(docs: DataFrame) -> DataFrame:
    """digest of the samples and the stored image, one row a digest."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for b in batches:
            digests, media = [], []
            for text in b.column(0).to_pylist():
                raw = payload(text)
                digest = hashlib.sha256(raw)
                if digest.digest() in done:
                    continue
                if len(done) < 100_000:  # copies in a task are stored once; the rest go by dropDuplicates
                    done.add(digest.digest())
                digests.append(digest.hexdigest())
                media.append(encode(raw))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])
            del b, digests, media
            tk.release()

    return docs.select("text").mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


PAYLOAD_SQL = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Read stored images back: sizes, digests, check sum of the last 16 samples, features."""
    ship(media.sparkSession)
    names = [x.split()[0] for x in PAYLOAD_SQL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                samples = decode(stored)
                raw = samples.tobytes()
                rows.append((digest, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
            del b, rows
            tk.release()

    return media.select("digest", "media").mapInArrow(run, PAYLOAD_SQL)


def references(sequences: DataFrame, keep: list[str], parts: str = "parts") -> DataFrame:
    """One row a media reference: the kept columns, pos, caption and digest."""
    found = F.filter(parts, lambda p: (p["kind"] == "media") & p["ref"].startswith(REF))
    d = sequences.select(*keep, F.explode(found).alias("_p"))
    return d.select(*keep, F.col("_p.pos").alias("pos"), F.col("_p.text").alias("caption"), F.substring("_p.ref", len(REF) + 1, 64).alias("digest"))


def resolve(sequences: DataFrame, described: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """key and its parts in order, each with the payload that its reference names, or null."""
    p = sequences.select(key, F.posexplode_outer(parts).alias("_i", "_p"))
    p = p.withColumn("_d", F.when(F.col("_p.ref").startswith(REF), F.substring("_p.ref", len(REF) + 1, 64)))
    m = described.select(F.col("digest").alias("_m"), F.struct(*described.columns).alias("payload"))
    p = p.join(m, F.col("_d") == F.col("_m"), "left")
    item = F.struct("_i", F.struct("_p.*", "payload").alias("part"))
    got = p.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), item))).alias("_l"))
    return got.select(key, F.transform("_l", lambda x: x["part"]).alias(parts))
