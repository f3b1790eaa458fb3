"""Operators 11 to 13 against brute force on small tables with awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import packing, phrases, txlog
from sparkloom.llm.queries import op13_packing

SPEC = public_tokenizers.path("byte_bpe_50k.json")


# ---- operator 11 ------------------------------------------------------------


def mined(rows: list[tuple], max_n: int, least: int, top: int, absorb: int = 100) -> list[tuple]:
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= absorb * a for (x, q), b in cand.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def phrase_rows() -> list[tuple]:
    r = random.Random(3)
    words = ["Ab", "cä", "d", "ß", "e\x0bx", "f'g", "\x01", "ü"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]) for _ in range(r.randint(1, 80)))
    rows = [(r.choice(["en", "de", None, ""]), text()) for _ in range(60)]
    rows += [("en", None), (None, None), ("en", ""), ("en", " .,\n"), ("de", "lone"), ("en", "new york city hall " * 900)]
    return rows + [rows[0]] * 40


@pytest.mark.parametrize(("max_n", "least", "top", "absorb", "bits"), [(5, 20, 2000, 100, 1 << 16), (5, 3, 7, 100, 1 << 6), (2, 20, 5, 100, 1 << 16), (3, 5, 2000, 60, 1 << 10), (6, 40, 50, 100, 1 << 12)])
def test_phrases(spark, max_n, least, top, absorb, bits):
    rows = phrase_rows()
    df = spark.createDataFrame([(t, g, 1, "x") for g, t in rows], "text string, lang string, phrase int, c string").repartition(3)
    got = phrases.mine(df, max_n, least, top, absorb=absorb, filter_bits=bits, batch_bytes=4000)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, max_n, least, top, absorb)


def test_phrases_of_an_empty_table_and_products_over_64_bits(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine(empty).count() == 0
    # 3,000,000 x 3,000,000 x 6,000,000 x 1000 passes 2^63
    big = spark.createDataFrame([("q z " * 300_000, "en")] * 10, "text string, lang string")
    got = [tuple(r) for r in phrases.mine(big, max_n=2).collect()]
    a = 3_000_000
    want = {"q z": (a, 1000 * a * 2 * a // (a * a)), "z q": (a - 10, 1000 * (a - 10) * 2 * a // (a * a))}
    assert {r[2]: (r[3], r[7]) for r in got} == want
    huge = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert [tuple(r) for r in phrases.mine(huge, least=1).collect()] == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


# ---- operator 12 ------------------------------------------------------------


def replayed(rows: list[tuple], every: int) -> tuple[list, list, dict]:
    """States (epoch, commits, n, sum), undone rows and the store, by running the log row by row."""
    rows = sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (r[1], r[0] is None, r[0] or "", r[2], r[5] is None, r[5] or 0))
    open_, store, undone, out, n = defaultdict(list), {}, [], [], 0
    total = sum(r[3] == txlog.COMMIT for r in rows)
    for source, seq, _, op, key, value in rows:
        t = open_[source]
        if op == txlog.CHANGE:
            t.append((seq, key, value))
        elif op == txlog.SAVEPOINT:
            t.append(None)
        elif op == txlog.ROLLBACK:
            while t and t[-1] is not None:
                undone.append(("rollback", t[-1][0], seq, t.pop()[1]))
        else:
            for c in t:
                if c is None:
                    continue
                if op == txlog.ABORT:
                    undone.append(("abort", c[0], seq, c[1]))
                elif c[2] is None:
                    store.pop(c[1], None)
                else:
                    store[c[1]] = c[2]
            t.clear()
            if op == txlog.COMMIT:
                n += 1
                if n % every == 0 or n == total:
                    out.append((-(-n // every), n, len(store), sum(store.values())))
    undone += [("abort", c[0], None, c[1]) for t in open_.values() for c in t if c]
    return out, undone, store


def log_rows(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    source = lambda: r.choice(["hot"] * 6 + ["a", "ä", "", None])
    rows = [(source(), i, 0, r.choice([0, 1, 2, 3, 4, 4, 4, 4, 4, 4, 4]), r.choice([1, 1, 1, 2, 3, 4, None]), r.choice([None, *range(5)])) for i in range(n)]
    rows += [("a", None, 0, 4, 1, 1), (None, None, 0, 0, None, None), ("a", 5, 0, None, 1, 1)]
    return rows + [rows[i] for i in range(0, n, 17)]


@pytest.mark.parametrize(("n", "partitions", "every", "seed"), [(400, 1, 16, 1), (400, 7, 3, 2), (300, 40, 16, 3), (60, 90, 1, 4), (3, 4, 16, 5)])
def test_log(spark, n, partitions, every, seed):
    rows = log_rows(n, seed)
    df = spark.createDataFrame([(*x, 1) for x in rows], "source string, seq long, tie long, op int, key long, value long, commit_seq int").repartition(5)
    got = txlog.reassemble(df, partitions)
    stored = lambda c: F.col(c).isNotNull().cast("long")
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    states, undone, store = replayed(rows, every)
    s = txlog.states(got, {"n": stored("new") - stored("old"), "v": value("new") - value("old")}, every)
    assert sorted(tuple(r) for r in s.collect()) == states
    assert Counter((r.kind, r.seq, r.by_seq, r.key) for r in got.undone.collect()) == Counter(undone)
    last = {}
    for d in sorted(got.deltas.collect(), key=lambda d: (d.commit_seq, d.commit_null, d.commit_source, d.commit_tie, d.seq)):
        if d.new is None:
            last.pop(d.key, None)
        else:
            last[d.key] = d.new
    assert last == store


def test_log_of_texts_and_no_log(spark):
    schema = "source string, seq long, tie long, op int, key long, value string"
    rows = [("a", 1, 0, 4, 7, "x" * 300_000), ("a", 2, 0, 0, None, None), ("b", 3, 0, 4, 7, "y"), ("b", 4, 0, 0, None, None), ("b", 5, 0, 4, 7, None), ("b", 6, 0, 0, None, None)]
    got = txlog.reassemble(spark.createDataFrame(rows, schema), 3)
    assert sorted((d.commit_seq, d.old, d.new) for d in got.deltas.collect()) == sorted([(2, None, "x" * 300_000), (4, "x" * 300_000, "y"), (6, "y", None)], key=lambda x: x[0])
    none = txlog.reassemble(spark.createDataFrame([], schema), 3)
    assert none.undone.count() == none.deltas.count() == none.commits.count() == txlog.states(none, {}).count() == 0


# ---- operator 13 ------------------------------------------------------------


def token_texts() -> list[str | None]:
    r = random.Random(8)
    odd = ["<|endoftext|>", " ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "\x1c", "\x00", "à", "—", "don't", "it's", "12", "３", "é" * 3, "é", "👍🏽", "​", ".", "...", "-", "a", "Bc", "日本", " ", " ", " ", " ", "᠎", "ſ"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(1, 40))) for _ in range(400)]
    texts += ["".join(chr(c) + " " for c in range(a, min(a + 512, 0x3100)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3100, 512)]
    texts += [f"a{chr(c)} b {chr(c)}c" for c in [*range(0x20), 0x7F, 0x85, 0xA0, 0xFEFF, *range(0x2000, 0x2070)]]
    return [*texts, "", None, " ", "x" * 3000, "word " * 9000, "one two", "one two"]


def test_cached_tokens_are_those_of_the_tokenizer():
    model = Tokenizer.from_file(SPEC)
    texts = token_texts()
    want = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (300_000, 50):
        t = packing.Tokens(model.to_str(), None, most)
        for some in (texts, texts[::-1]):
            ids, offs = t.encode(pa.array(some))
            assert [ids[offs[i] : offs[i + 1]].tolist() for i in range(len(some))] == (want if some is texts else want[::-1])


@pytest.mark.parametrize("capacity", [1, 7, 30])
def test_fill_comes_nearest_to_the_capacity(capacity):
    r = random.Random(capacity)
    for _ in range(200):
        left = np.zeros(31, np.int64)
        for _ in range(r.randint(0, 6)):
            left[r.randint(1, 30)] += r.randint(1, 4)
        sums = {0}
        for x in range(1, 31):
            for _ in range(left[x]):
                sums |= {s + x for s in sums}
        best, need = packing.fill(left, capacity)
        assert best == max(s for s in sums if s <= capacity) == sum(x * m for x, m in need.items())
        assert all(0 < m <= left[x] for x, m in need.items())


def checked(rows: list, texts: list, capacity: int, parts: int) -> None:
    """Every id of every document in one piece, sequences without gaps, no padding."""
    model = Tokenizer.from_file(SPEC)
    want = Counter(tuple([*model.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in texts)
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in rows:
        assert p.length == len(p.ids) > 0
        seqs[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
    short = 0
    for ps in seqs.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at
            at += p.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
        short += at < capacity
    assert short <= parts * capacity.bit_length()
    got = Counter()
    for ps in docs.values():
        ps.sort(key=lambda p: p.start)
        while ps:  # ids repeat: documents are put together by their starts
            tokens, ids = ps[0].doc_tokens, []
            while len(ids) < tokens:
                k = next(i for i, p in enumerate(ps) if p.start == len(ids) and p.doc_tokens == tokens)
                ids += ps.pop(k).ids
            got[tuple(ids)] += 1
    assert sum(got.values()) == sum(want.values())
    if len({d for d, _ in texts}) == len(texts):
        assert got == want


@pytest.mark.parametrize(("capacity", "block"), [(64, 200), (2048, 1 << 20), (100, 5000), (1, 50)])
def test_packing(spark, capacity, block):
    texts = list(enumerate(token_texts()))
    df = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, ids string").coalesce(2)
    rows = packing.pack(df, SPEC, capacity, block_tokens=block).collect()
    checked(rows, texts, capacity, 2)
    if capacity == 64:
        s = packing.sequences(packing.pack(df, SPEC, capacity, block_tokens=block)).collect()
        assert sum(len(r.ids) for r in s) == sum(r.length for r in rows) and all(len(r.doc_ids) == len(r.offsets) for r in s)


def test_packing_of_equal_lengths_null_ids_and_no_rows(spark):
    same = [(None, "same words here again")] * 700 + [(1, None)] * 3
    df = spark.createDataFrame(same, "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, SPEC, 64).collect()
    checked(rows, same, 64, 1)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), SPEC).count() == 0


def test_packing_query(spark):
    sf = "/root/testdata/sf0.001"
    model = Tokenizer.from_file(SPEC)
    texts = {r.doc_id: [*model.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows, seen = op13_packing(spark, sf).collect(), Counter()
    for r in rows:
        ids = texts[r.doc_id][r.start : r.start + r.length]
        assert (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(texts[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        seen[r.doc_id] += r.length
    assert seen == {d: len(t) for d, t in texts.items()}
