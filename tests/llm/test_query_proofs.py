"""What the queries of operators 2, 5, 9 and 10 return, against plain Python over the given tables; hot keys and long texts for 7 and 8."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import media, rlzdedup, suffixdedup
from sparkloom.llm import queries as q

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text or "", r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


def samples(png: bytes) -> bytes:
    """A reader of its own: width, height and rows without filters."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, head = 8, b"", None
    while at < len(png):
        n = struct.unpack(">I", png[at : at + 4])[0]
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    width, height, depth, colour, *_ = head
    assert (width, depth, colour) == (192, 8, 0)
    raw = zlib.decompress(data)
    rows = [raw[i * 193 : (i + 1) * 193] for i in range(height)]
    assert all(r[0] == 0 for r in rows)
    return b"".join(r[1:] for r in rows)


def feature(raw: bytes) -> str:
    """Size, mean, deviation, and for an 8 x 8 grid whether a cell is brighter than the whole."""
    x = np.frombuffer(raw, np.uint8).reshape(-1, 192).astype(float)
    grid = [[[] for _ in range(8)] for _ in range(8)]
    for i, row in enumerate(x):
        for j in range(8):
            grid[min(i * 8 // len(x), 7)][j].append(row[j * 24 : (j + 1) * 24].sum())
    bits = [sum(c) / (24 * len(c)) > x.mean() if c else False for r in grid for c in r]
    return f"192x{len(x)};mean={x.mean():.4f};dev={x.std():.4f};hash={np.packbits(bits).tobytes().hex()}"


def test_op2(spark, texts):
    rows = q.op2_media(spark, SF).collect()
    stored = {r.digest: bytes(r.media) for r in media.store(q.documents(spark, SF)).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id][0].encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        png = stored[hashlib.sha256(padded).hexdigest()]
        assert samples(png) == padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256, r.caption) == (len(png), hashlib.sha256(png).hexdigest(), f"{len(raw)} bytes")
        if r.doc_id % 5 == 0:
            assert r.feature == feature(padded)


def test_media_pages(spark, texts):
    got = {r.page_id: r for r in q.media_pages(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages) and {r.n_media for r in got.values()} == {4}
    missing = 0
    for r in pages:
        lines = [(p["kind"], p["text"], p["ref"], None) for p in media.parse_parts(r.html)]
        found = 0
        for d in range(3 * r.page_id, 3 * r.page_id + 3):
            if d in texts:
                raw = texts[d][0].encode()
                raw += b" " * (-len(raw) % 192 if raw else 192)
                digest = hashlib.sha256(raw).hexdigest()
                lines.append(("media", f"Document {d}", f"media:{digest}", f"{digest}|{len(raw)}"))
                found += 1
            else:
                lines.append(("media", f"Document {d}", "media:" + hashlib.sha256(f"missing {d}".encode()).hexdigest(), None))
        missing += 3 - found
        lines += [("text", "More below", None, None), ("media", "from elsewhere", "https://example.org/a.png", None)]
        said = "\n".join("|".join(str(x) for x in (i, *line) if x is not None) for i, line in enumerate(lines))
        assert (got[r.page_id].n_resolved, got[r.page_id].parts_sha256) == (found, hashlib.sha256(said.encode()).hexdigest())
    assert missing or 3 * len(pages) <= len(texts)


def test_op5(spark, texts):
    rows = q.op5_sharding(spark, SF).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, (t, _) in texts.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    load, where = Counter(), defaultdict(set)
    for r in rows:
        load[r.shard] += r.size
        where[texts[r.doc_id][0]].add(r.shard)
    for k in range(40):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    mean = sum(load.values()) / 40
    largest = max(len(t.encode()) + 16 for t, _ in texts.values())
    assert set(load) == set(range(40)) and max(load.values()) <= max(1.1 * mean, largest)
    share = Counter(texts[r.doc_id][0] for r in rows)
    assert all(len(s) == 1 for t, s in where.items() if share[t] * (len(t.encode()) + 16) < mean / 2)


def test_op9(spark, texts):
    rows = q.op9_class_lm(spark, SF).collect()
    tokens = {d: [w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))] + [None] for d, (t, _) in texts.items()}
    count = Counter(w for d, ws in tokens.items() if crc(d) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / len(ws)), rel=1e-6)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id][0]].add(round(r.score, 6))
    assert all(len(s) == 1 for s in by_text.values())


def test_op10(spark, texts):
    rows = q.op10_language(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    right = Counter()
    for r in rows:
        text, lang = texts[r.doc_id]
        assert r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"
        else:
            right[r.held_out, r.lang_pred == lang] += 1
    for held in (True, False):
        assert right[held, True] >= 0.98 * (right[held, True] + right[held, False]) > 0


def repeated(unit: str, joiner: str) -> list[tuple]:
    """700 documents that share one passage, and what is their own."""
    r = random.Random(2)
    own = lambda k: joiner.join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    passage = joiner.join([unit, own(70)])
    return [(i, joiner.join([own(20), passage, own(20)])) for i in range(700)]


def test_one_passage_in_over_256_blocks(spark):
    rows = repeated("shared", " ")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seven = suffixdedup.dedup(df, block_bytes=1024).collect()
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for r in seven:
        b = rows[r.doc_id][1].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = b"\1" * 50
        assert (r.n_removed, r.kept_sha256) == (sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert {r.n_removed >= 490 for r in seven if r.doc_id} == {True}
    eight = {r.doc_id: r for r in rlzdedup.dedup(df, block_bytes=1024).collect()}
    starts = {}
    for d, t in rows:
        w = t.split(" ")
        for i in range(len(w) - 49):
            starts.setdefault(tuple(w[i : i + 50]), d)
    for d, t in rows:
        w = t.split(" ")
        gone = {i + j for i in range(len(w) - 49) if starts[tuple(w[i : i + 50])] < d for j in range(50)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        assert d == 0 or len(gone) >= 71
        assert (eight[d].n_words, eight[d].n_removed, eight[d].kept_sha256) == (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_texts_of_over_a_megabyte(spark):
    r = random.Random(3)
    own = lambda k: " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(k))
    passage = own(60)
    long_ = own(90_000) + " " + passage + " " + own(90_000)
    rows = [(1, "start " + passage + " end"), (2, long_), (3, long_)]
    assert len(long_) > 1_200_000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seven = {x.doc_id: x for x in suffixdedup.dedup(df).collect()}
    assert seven[1].n_removed == 0 and len(passage) <= seven[2].n_removed <= len(passage) + 2 and seven[3].n_removed == len(long_)
    eight = {x.doc_id: x for x in rlzdedup.dedup(df).collect()}
    assert (eight[1].n_removed, eight[2].n_removed, eight[3].n_removed) == (0, 60, 180_060)
