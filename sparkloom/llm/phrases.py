"""Operator 11: phrase collocation mining, a table of n-grams a language.

Texts are cut into pieces and those into words. All 1- to max_n-grams become
rows, are hash-aggregated by (lang, phrase), and the counts of a candidate's
first and last part are joined to it; scores are exact integer quotients of
decimals. A candidate that a longer one contains as often goes by an anti-join
with one-word extensions: the counts of phrases never grow with their length, so
a longer phrase that holds it as often makes one of its extensions do so too.

An n-gram occurs no oftener than its parts. So pairs become rows only where
both words may be frequent, and longer n-grams only where all their pairs may
be. "May be" is asked of a Bloom filter, whose size is a parameter: it passes
every frequent phrase, and what it passes wrongly is counted and goes then. The
counts are exact, of whole phrases and all texts.

Nulls: a null text is empty, a null language is ``und``. Repeated rows count as
rows of their own. Ties: by score, count, then the phrase's bytes. Texts of any
length; one text's arrays are held at a time. An empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table
from .textkit import LOWER, mix, pack, ranges, release, span_hashes, words

#: A language for rows without one.
NO_LANG = "und"
#: Languages whose word totals may be sent to all executors; beyond it they are joined by a shuffle.
MOST_LANGS = 10_000

_table = np.zeros(256, bool)
_table[[ord(c) for c in ".,;:!?"]] = True
_table[0x0A:0x0E] = True
#: Bytes that end a piece.
ENDS = _table
_table = ~ENDS
_table[[0x20, 0x09]] = False
#: Bytes of a word.
INSIDE = _table


class Words:
    """The words of some texts, lower-cased and laid end to end with one space between."""

    def __init__(self, texts: pa.Array):
        raw, offs = pack(texts)
        raw = LOWER[raw]
        s, e, first = words(raw, offs, INSIDE)
        self.text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        piece = np.cumsum(ENDS[raw], dtype=np.int64)[s] if len(s) else s
        self.length = e - s
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.bytes = np.full(int(self.start[-1] + self.length[-1]) if len(s) else 0, 0x20, np.uint8)
        self.bytes[ranges(self.start, self.length)] = raw[ranges(s, self.length)]
        #: Whether the next word belongs to the same piece.
        self.joined = np.append((piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1]), np.zeros(min(len(s), 1), bool))

    def end(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.start[at + n - 1] + self.length[at + n - 1]

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each position on, as strings."""
        size = self.end(at, n) - self.start[at]
        data = self.bytes[ranges(self.start[at], size)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(data))


def hashes(of_bytes: np.ndarray, s: np.ndarray, e: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hashes of phrases, told apart by language; lang has a number for each."""
    return mix(span_hashes(of_bytes, s, e) ^ lang) if len(s) else np.zeros(0, np.uint64)


def lang_numbers(langs: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32((x if x is not None else NO_LANG).encode()) for x in langs.to_pylist()], np.uint64) << np.uint64(20)


def within(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a Bloom filter of two bits a phrase may have these hashes."""
    m = np.uint64(len(bits) * 64 - 1)
    has = lambda x: (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
    return (has(h & m) & has((h >> np.uint64(32)) & m)).astype(bool)


def bloom(phrases: DataFrame, size: int) -> np.ndarray:
    """A filter of ``size`` bits over the rows of (lang, phrase); executors set bits, which are
    or-ed by word of 64. At most size / 64 words reach the driver, however many phrases there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = pack(b.column(1))
            h = hashes(raw, offs[:-1], offs[1:], lang_numbers(b.column(0)))
            m = np.uint64(size - 1)
            at = np.concatenate([h & m, (h >> np.uint64(32)) & m])
            slot = at >> np.uint64(6)
            order = np.argsort(slot, kind="stable")
            slot, bit = slot[order], (np.uint64(1) << (at & np.uint64(63)))[order]
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
            got = np.bitwise_or.reduceat(bit, first) if len(first) else bit
            yield pa.RecordBatch.from_arrays([pa.array(slot[first].astype(np.int64)), pa.array(got.view(np.int64))], ["slot", "bits"])

    got = phrases.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together until their second column has about ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def tally(phrase: pa.Array, lang: pa.Array) -> pa.Table:
    """key and c: how often each phrase stands there; a key is phrase, tab, language, as no phrase has a tab."""
    key = pc.binary_join_element_wise(phrase, lang.cast(pa.large_string()), pa.scalar("\t", pa.large_string()))
    g = pa.table({"key": key}).group_by(["key"], use_threads=False).aggregate([([], "count_all")])
    return pa.table({"key": g["key"].cast(pa.string()), "c": g["count_all"]})


def counts(docs: DataFrame, sizes: range, known: np.ndarray | None, batch_bytes: int) -> DataFrame:
    """lang, phrase, words and c of the n-grams of those sizes; rows with a null phrase hold all
    words of a language. known: a filter of frequent words for pairs, of frequent pairs for longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, batch_bytes):
            langs = t.column("lang").combine_chunks()
            langs = pa.concat_arrays(langs.chunks) if isinstance(langs, pa.ChunkedArray) else langs
            w = Words(t.column("text"))
            n = len(w.start)
            if not n:
                continue
            number = lang_numbers(langs)[w.text]
            at = np.arange(n)
            if known is None:
                pair = w.joined
            elif sizes[0] == 2:
                frequent = within(known, hashes(w.bytes, w.start, w.start + w.length, number))
                pair = w.joined & frequent & np.append(frequent[1:], False)
            else:
                at = np.flatnonzero(w.joined)
                pair = np.zeros(n, bool)
                pair[at] = within(known, hashes(w.bytes, w.start[at], w.end(at, 2), number[at]))
                at = np.arange(n)
            ok, made = np.ones(n, bool), []
            for k in range(1, sizes[-1] + 1):
                if k > 1:
                    ok = ok & np.append(pair, np.zeros(k, bool))[k - 2 : k - 2 + n]
                if k not in sizes:
                    continue
                here = at[ok]
                made.append(tally(w.phrases(here, k), langs.take(pa.array(w.text[here]))))
                if k == 1:
                    made.append(tally(pa.nulls(n, pa.large_string()).fill_null(""), langs.take(pa.array(w.text))))
            yield from pa.concat_tables(made).combine_chunks().to_batches()
            del w
            release()

    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = d.mapInArrow(run, "key string, c long").groupBy("key").agg(F.sum("c").alias("c"))
    cut = F.instr("key", "\t")
    phrase = F.substr("key", F.lit(1), cut - 1)
    blanks = F.length(phrase) - F.length(F.translate(phrase, " ", ""))
    return rows.select(F.substr("key", cut + 1).alias("lang"), F.when(phrase != "", phrase).alias("phrase"), F.when(phrase != "", blanks + 1).otherwise(0).alias("words"), "c")


def mine(docs: DataFrame, max_n: int = 5, least: int = 100, top: int | None = 2000, scale: int = 1000, absorb: int = 100, filter_bits: int = 1 << 24, batch_bytes: int = 4 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to max_n words.

    least: the count that makes a candidate. absorb: a candidate goes if a longer
    one has it with 100 x f(longer) >= absorb x f. top: rows a language, None for all.
    """
    often = F.col("c") >= least
    known = table(counts(docs, range(1, 2), None, batch_bytes).where(often | F.col("phrase").isNull()), "words")
    total = known.where(F.col("phrase").isNull()).select(F.col("lang").alias("_l"), F.col("c").alias("n"))
    parts = [known.where(F.col("phrase").isNotNull() & often)]
    for sizes in [range(2, 3), range(3, max_n + 1)] if max_n > 2 else [range(2, 3)]:
        parts.append(table(counts(docs, sizes, bloom(parts[-1], filter_bits), batch_bytes).where(often), "phrases"))
    f = parts[0]
    for p in parts[1:]:
        f = f.union(p)
    cand = f.where("words > 1").select("lang", "phrase", "words", F.col("c").alias("a"))
    w = F.split("phrase", " ")
    join = lambda x: F.array_join(x, " ")
    cut = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({"_first": join(F.slice(w, F.lit(1), F.col("k"))), "_rest": join(F.slice(w, F.col("k") + 1, F.col("words") - F.col("k")))})
    of = lambda name: f.select(F.col("lang").alias(f"_{name}g"), F.col("phrase").alias(f"_{name}p"), F.col("c").alias(name))
    cut = cut.join(of("l"), (F.col("lang") == F.col("_lg")) & (F.col("_first") == F.col("_lp")))
    cut = cut.join(of("r"), (F.col("lang") == F.col("_rg")) & (F.col("_rest") == F.col("_rp")))
    cut = cut.join(F.broadcast(total) if total.count() <= MOST_LANGS else total, F.col("lang") == F.col("_l"))
    big = lambda c: f"cast({c} AS decimal(19, 0))"
    score = F.expr(f"cast({scale} AS decimal(9, 0)) * {big('a')} * {big('n')} div ({big('l')} * {big('r')})")
    best = cut.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_b"))
    longer = cand.where("words > 2").select("lang", "a", F.explode(F.array(join(F.slice(w, F.lit(1), F.col("words") - 1)), join(F.slice(w, F.lit(2), F.col("words") - 1)))).alias("_in"))
    longer = longer.groupBy(F.col("lang").alias("_l"), "_in").agg(F.max("a").alias("_a"))
    best = best.join(longer, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_in")) & (F.lit(100) * F.col("_a") >= F.lit(absorb) * F.col("a")), "left_anti")
    d = best.select("lang", "phrase", "a", "_b.l", "_b.r", "n", "_b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the first of each part of a language first, so that no task sorts a whole language
        d = d.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
        d = d.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= top)
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    d = d.where(F.col("rank") <= top) if top is not None else d
    return d.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
