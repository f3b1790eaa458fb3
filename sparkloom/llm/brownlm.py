"""Operator 9: score texts with a Brown class-based bigram model.

P(w | v) = P(class w | class v) P(w | class w). Every training word has a class
by its own contexts. The frequent core (words that make up more than a set share
of the bytes) goes through exchange clustering on the driver, where all other
words stand in as bands of equal log2 count. Then each other word, down to those
seen once, is moved to the class where the likelihood of the class bigrams is
greatest, by counts of its own left and right classes. This is done in executors,
in a set number of passes; within a pass all words move at once, by the classes
and class bigrams before it, so their classes are not a joint optimum. After each
pass the core is exchanged again, word by word, against the classes that the
others have then.

Counts are those of all training tokens: blocks of documents send their distinct
words and counts to buckets of words, which answer with the totals; in a pass
they send each word's class contexts and get back its class. What is kept of a
text is a sequence of word numbers of its block and sums, from which bigrams are
counted and scores computed without the text.

Smoothing: class transitions are interpolated with class frequencies. An
unknown word is one type, as in the add-one base; it gets half the share of
words seen once, wherever it stands, and the rest is scaled down.

Nulls: a null text is empty; every text has an end token, so an empty one still
has a score. Repeated rows are scored and learned from each. With no training
rows everything is unknown, the one type there is, and every score is 0. Other
columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textkit as tk
from .anchors import by_bucket, rows, sql_schema
from .shared import table

#: Stands for the end of a text; no word hashes to it but by chance.
END = np.uint64(0x5EED0FE2D0FDA7A5)
#: Pseudo-words: 0 unknown, 1 to 32 bands, 33 the end, then frequent words; a block has CORE for each of them.
BANDS, END_ID, CORE = 33, 33, 34
#: Context counts whose gains are computed at a time.
ENTRIES = 1 << 13
COUNTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()), ("numbers", pa.binary()), ("kinds", pa.int64())])
SEQS = pa.schema([("block", pa.int64()), ("kinds", pa.int64()), ("ids", pa.binary()), ("train", pa.binary()), ("n_tokens", pa.binary()), ("n_known", pa.binary()), ("plus_one", pa.binary()), ("known", pa.binary()), ("seq", pa.binary()), ("cuts", pa.binary()), ("numbers", pa.binary()), ("core", pa.binary()), ("pseudo", pa.binary()), ("classes", pa.binary())])
CONTEXTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.int64()), ("numbers", pa.binary()), ("now", pa.binary()), ("entries", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())])
CLASSES = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("classes", pa.binary())])


class _Tokens:
    """Tokens of a block's texts, an end token behind each, in order of ids."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.train = t.column("doc_id"), t.column("train").to_numpy().astype(bool)
        buf, offs = tk.pack(t.column("text"))
        buf = tk.LOWER[buf]
        s, e, woff = tk.words(buf, offs, tk.NOT_SPACE)
        h = tk.span_hashes(buf, s, e)
        self.h = np.insert(h, woff[1:], END)
        self.off = woff + np.arange(len(woff))
        self.keys, self.which = np.unique(self.h, return_inverse=True)

    def counts(self) -> np.ndarray:
        mask = np.repeat(self.train, np.diff(self.off))
        return np.bincount(self.which[mask], minlength=len(self.keys))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def send_counts(t: pa.Table, n: int) -> pa.Table:
    block, x = t.column("block")[0].as_py(), _Tokens(t)
    counts = x.counts().astype("<u4")
    return rows(COUNTS, [(i, block, x.keys[s].tobytes(), pa.compress(counts[s].tobytes(), "zstd", asbytes=True)) for i, s in by_bucket(bucket_of(x.keys, n), n)])


def add_counts(t: pa.Table) -> pa.Table:
    """Totals, and numbers in the bucket, for each block in the order it sent its words; a row for block -1 has the number of training words."""
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("keys")]
    counts = [np.frombuffer(pa.decompress(x.as_py(), 4 * len(k), "zstd"), "<u4") for x, k in zip(t.column("counts"), keys, strict=True)]
    distinct, inv = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inv, weights=np.concatenate(counts), minlength=len(distinct)).astype("<u8")
    cuts, bucket = np.cumsum([0, *(len(k) for k in keys)]), t.column("bucket")[0].as_py()
    each = [inv[cuts[i] : cuts[i + 1]] for i in range(len(keys))]
    out = [(b, bucket, pa.compress(total[each[i]].tobytes(), "zstd", asbytes=True), packed(np.diff(each[i], prepend=0), "<u4"), 0) for i, b in enumerate(t.column("block").to_pylist())]
    return rows(REPLY, [*out, (-1, bucket, b"", b"", int((total > 0).sum()))])


def sequences(t: pa.Table, reply: pa.Table, n: int, frequent: float) -> pa.Table:
    if not len(t):
        return rows(SEQS, [(-1, sum(reply.column("kinds").to_pylist()), *[b""] * 12)])
    x = _Tokens(t)
    cuts = np.searchsorted(bucket_of(x.keys, n), np.arange(n + 1))
    total, numbers = np.zeros(len(x.keys), np.int64), np.zeros(len(x.keys), "<u4")
    for b, z, k in zip(reply.column("bucket").to_pylist(), reply.column("totals"), reply.column("numbers"), strict=True):
        total[cuts[b] : cuts[b + 1]] = np.frombuffer(pa.decompress(z.as_py(), int(8 * (cuts[b + 1] - cuts[b])), "zstd"), "<u8")
        numbers[cuts[b] : cuts[b + 1]] = unpacked(k.as_py(), "<u4", int(cuts[b + 1] - cuts[b]))
    often = (total >= frequent) & (x.keys != END)
    pseudo = np.where(total > 0, np.floor(np.log2(np.maximum(total, 1))).astype(np.int64) + 1, 0)
    pseudo[often] = CORE
    pseudo[x.keys == END] = END_ID
    starts = x.off[:-1]
    add = lambda v: np.add.reduceat(v[x.which], starts)
    return rows(
        SEQS,
        [(
            t.column("block")[0].as_py(), 0, np.array(x.ids.to_pylist(), dtype="<i8").tobytes(), x.train.tobytes(), np.diff(x.off).astype("<i8").tobytes(), add((total > 0).astype("<i8")).tobytes(),
            add(np.log10(total + 1.0)).tobytes(), add(np.log10(np.maximum(total, 1))).tobytes(), packed(np.argsort(by_count(pseudo))[x.which], "<u4"), packed(cuts, "<u4"), packed(numbers, "<u4"), x.keys[often].tobytes(), packed(pseudo, "u1"), b"",
        )],
    )


class _Seqs:
    """A stored block: its documents' figures, and its texts as numbers of the block's words."""

    def __init__(self, r: dict, buckets: int):
        f = lambda c, kind: np.frombuffer(r[c], kind)
        self.ids, self.train = f("ids", "<i8"), f("train", bool)
        self.n, self.known_n, self.plus_one, self.known = f("n_tokens", "<i8"), f("n_known", "<i8"), f("plus_one", "<f8"), f("known", "<f8")
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        #: Words of bucket b are those from cuts[b] to cuts[b + 1].
        self.cuts = unpacked(r["cuts"], "<u4", buckets + 1).astype(np.int64)
        words = int(self.cuts[-1])
        #: Number in the bucket, as the difference from that of the word before.
        self.numbers, self.pseudo, self.core = unpacked(r["numbers"], "<u4", words), unpacked(r["pseudo"], "u1", words), f("core", "<u8")
        self.classes = unpacked(r["classes"], "<u2", words if r["classes"] else 0)
        self.seq = by_count(self.pseudo)[unpacked(r["seq"], "<u4", int(self.off[-1]))]
        self.before = np.empty_like(self.seq)
        self.before[1:] = self.seq[:-1]
        self.before[self.off[:-1]] = np.flatnonzero(self.pseudo == END_ID)[0]

    def pseudo_words(self, vocab: np.ndarray) -> np.ndarray:
        """Of each of the block's words, by a common vocabulary of frequent ones."""
        out = self.pseudo.astype(np.int64)
        core = out == CORE
        out[core] += np.searchsorted(vocab, self.core)
        return out

    def pairs(self, v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Training bigrams of what v has for each word, as before * m + it, and their counts."""
        keep = np.repeat(self.train, self.n)
        return np.unique(v[self.before[keep]] * m + v[self.seq[keep]], return_counts=True)

    def movable(self) -> np.ndarray:
        """Numbers of the words that are known and not in the core."""
        return np.flatnonzero((self.pseudo > 0) & (self.pseudo < END_ID))


def by_count(pseudo: np.ndarray) -> np.ndarray:
    """The block's words with frequent ones first: a text's words by this order are small numbers."""
    return np.argsort(-pseudo.astype(np.int64), kind="stable")


def packed(x: np.ndarray, kind: str) -> bytes:
    """Lowest bytes of all numbers first, then the next ones."""
    x = x.astype(kind)
    return pa.compress(x.view("u1").reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes, kind: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x, wide * n, "zstd"), "u1").reshape(wide, n).T).view(kind).ravel()


def send_contexts(s: _Seqs, block: int, of: np.ndarray, k: int) -> pa.Table:
    """Of each movable word its class and how often each class of k is before (code c) and behind it (k + c), and it is behind itself (2 k)."""
    width, keep = 2 * k + 1, np.repeat(s.train, s.n)
    a, b = s.before[keep].astype(np.int64), s.seq[keep].astype(np.int64)
    codes, counts = np.unique(np.concatenate([b * width + of[a], a * width + k + of[b], a[a == b] * width + 2 * k]), return_counts=True)
    words = s.movable()
    moves = np.zeros(len(s.pseudo), bool)
    moves[words] = True
    keep = moves[codes // width]
    codes, counts = codes[keep], counts[keep]
    cuts = np.searchsorted(codes, words * width)
    cuts = np.append(cuts, len(codes))
    ends, steps, out = np.searchsorted(words, s.cuts), np.cumsum(s.numbers.astype(np.int64)), []
    for i in np.flatnonzero(np.diff(ends)):
        w = slice(int(ends[i]), int(ends[i + 1]))
        e = slice(int(cuts[w.start]), int(cuts[w.stop]))
        before = steps[s.cuts[i] - 1] if s.cuts[i] else 0
        out.append((int(i), block, w.stop - w.start, packed(np.diff(steps[words[w]], prepend=before), "<u4"), packed(of[words[w]], "<u2"), packed(np.diff(cuts[w.start : w.stop + 1]), "<u2"), packed(codes[e] % width, "<u2"), packed(counts[e], "<u4")))
    return rows(CONTEXTS, out)


def assign(t: pa.Table, pair: np.ndarray) -> pa.Table:
    """The classes of a bucket's words, for each block in the order it sent them."""
    width = 2 * len(pair) + 1
    col = lambda c, kind, ns: [unpacked(x.as_py(), kind, n) for x, n in zip(t.column(c), ns, strict=True)]
    sizes = t.column("words").to_pylist()
    numbers = [np.cumsum(x.astype(np.int64)) for x in col("numbers", "<u4", sizes)]
    now, entries = np.concatenate(col("now", "<u2", sizes)), col("entries", "<u2", sizes)
    many = [int(x.sum()) for x in entries]
    codes, counts = np.concatenate(col("codes", "<u2", many)), np.concatenate(col("counts", "<u4", many))
    distinct, first, inv = np.unique(np.concatenate(numbers), return_index=True, return_inverse=True)
    code, at = np.unique(np.repeat(inv, np.concatenate(entries)) * width + codes, return_inverse=True)
    best = best_classes(pair, now[first].astype(np.int64), code // width, code % width, np.bincount(at, weights=counts, minlength=len(code)))
    cuts, bucket = np.cumsum([0, *sizes]), t.column("bucket")[0].as_py()
    return rows(CLASSES, [(b, bucket, packed(best[inv[cuts[i] : cuts[i + 1]]], "<u2")) for i, b in enumerate(t.column("block").to_pylist())])


def xlogx(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1e-300))


def best_classes(pair: np.ndarray, now: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each word the class where the likelihood is greatest, all others staying where they are.

    now has the words' classes, pair the class bigrams; n are counts of contexts
    by word, ascending, and code, as send_contexts() has them. Ties stay or go to
    the lower class; class 0 is the unknown word's.
    """
    k, out = len(pair), now.copy()
    left, right, diagonal = pair.sum(axis=1), pair.sum(axis=0), np.diag(pair)
    starts = np.searchsorted(word, np.arange(len(now) + 1))
    a = 0
    while a < len(now):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + ENTRIES, "right")) - 1)
        e, at, every = slice(starts[a], starts[b]), now[a:b], np.arange(b - a)
        t = np.zeros((b - a, 2 * k + 1))
        t[word[e] - a, code[e]] = n[e]
        col, row, self_ = t[:, :k], t[:, k : 2 * k], t[:, 2 * k]
        row[every, at] -= self_
        col[every, at] -= self_
        gain = np.zeros((b - a, k))
        for side, other, p in ((row, col, pair), (col, row, pair.T)):
            i, d = np.nonzero(side)
            x, own, each = side[i, d], d == at[i], np.arange(len(i))
            old = p.T[d].copy()  # bigrams of each class with d, without those of the word itself
            old[each, at[i]] -= x
            old[own] -= other[i[own]]
            old[own, d[own]] -= self_[i[own]]
            g = xlogx(old + x[:, None]) - xlogx(old)
            g[each, d] = 0
            if len(i):
                heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                gain[i[heads]] += np.add.reduceat(g, heads, axis=0)
        old = np.tile(diagonal, (b - a, 1))
        old[every, at] -= row[every, at] + col[every, at] + self_
        gain += xlogx(old + row + col + self_[:, None]) - xlogx(old)
        for total, x in ((left, row.sum(axis=1) + self_), (right, col.sum(axis=1) + self_)):
            old = np.tile(total, (b - a, 1))
            old[every, at] -= x
            gain -= xlogx(old + x[:, None]) - xlogx(old)
        gain[:, 0] = -np.inf
        best = gain.argmax(axis=1)
        out[a:b] = np.where(gain[every, best] > gain[every, at] + 1e-9, best, at)
        a = b
    return out


def with_classes(t: pa.Table, reply: pa.Table, start: tuple[np.ndarray, np.ndarray], buckets: int) -> pa.Table:
    """A stored block with its words' new classes."""
    r = t.to_pylist()[0]
    s = _Seqs(r, buckets)
    words, classes = s.movable(), classes_of(s, start).copy()
    cuts = np.searchsorted(words, s.cuts)
    for b, z in zip(reply.column("bucket").to_pylist(), reply.column("classes"), strict=True):
        classes[words[cuts[b] : cuts[b + 1]]] = unpacked(z.as_py(), "<u2", int(cuts[b + 1] - cuts[b]))
    return rows(SEQS, [tuple(r[c] if c != "classes" else packed(classes, "<u2") for c in SEQS.names)])


def classes_of(s: _Seqs, start: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each of the block's words; start has the vocabulary and the classes of pseudo-words, and always those of the core."""
    out = start[1][s.pseudo_words(start[0])]
    if len(s.classes):
        words = s.movable()
        out[words] = s.classes[words]
    return out


def core_or_class(s: _Seqs, start: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Of each of the block's words its class, below k; k is the end, and the core's words follow."""
    p = s.pseudo_words(start[0])
    return np.where(p >= END_ID, p - END_ID + k, classes_of(s, start))


def exchange_classes(n: np.ndarray, n_classes: int, rounds: int = 4, start: np.ndarray | None = None, fixed: np.ndarray | None = None) -> np.ndarray:
    """Classes of pseudo-words that maximise the likelihood of their bigram counts n.

    Words start in classes by frequency, in turn, or in those of start; each that
    is not fixed is moved to the class where the likelihood is greatest, most
    frequent first, until none moves or the rounds are over. Ties go to the lower class.
    """
    m = len(n)
    order = np.lexsort((np.arange(m), -n.sum(axis=1)))
    if start is None:
        c, of = min(n_classes, m), np.zeros(m, np.int64)
        of[order] = np.arange(m) % c
    else:
        c, of = n_classes, start.copy()
    if fixed is not None:
        order = order[~fixed[order]]
    member = np.zeros((m, c))
    member[np.arange(m), of] = 1
    pair = member.T @ n @ member
    f = lambda v: v * np.log(np.maximum(v, 1e-300))
    for _ in range(rounds):
        moved = 0
        for w in order:
            row, col = n[w] @ member, member.T @ n[:, w]
            self_, k = n[w, w], of[w]
            row[k] -= self_
            col[k] -= self_
            pair[k] -= row
            pair[:, k] -= col
            pair[k, k] -= self_
            left, right = pair.sum(axis=1), pair.sum(axis=0)
            base = f(pair)
            gain_row, gain_col = f(pair + row) - base, f(pair + col[:, None]) - base
            d = np.arange(c)
            corner = f(pair[d, d] + row + col + self_) - base[d, d]
            out_, in_ = row.sum() + self_, col.sum() + self_
            gain = gain_row.sum(axis=1) - gain_row[d, d] + gain_col.sum(axis=0) - gain_col[d, d] + corner
            # totals of the classes that w's neighbours see do not change with k
            gain -= f(left + out_) - f(left) + f(right + in_) - f(right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            member[w, k], member[w, best] = 0, 1
            of[w] = best
            moved += best != k
            pair[best] += row
            pair[:, best] += col
            pair[best, best] += self_
        if not moved:
            break
    return of


def core_classes(bigrams: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of pseudo-words, 0 being the unknown word's, and the classes' bigrams."""
    used = np.flatnonzero((bigrams.sum(axis=0) > 0) & (np.arange(len(bigrams)) > 0))
    of = np.zeros(len(bigrams), np.int64)
    if len(used):
        of[used] = exchange_classes(bigrams[np.ix_(used, used)], n_classes) + 1
    member = np.zeros((len(bigrams), int(of.max()) + 1))
    member[np.arange(len(bigrams)), of] = 1
    return of, member.T @ bigrams @ member


def core_again(n: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of pseudo-words after the core has moved among the k classes, and the
    classes' bigrams. n are bigrams of numbers as core_or_class() has them; of are
    the classes of pseudo-words before."""
    now = np.concatenate([np.arange(k), of[END_ID:]])
    used = np.flatnonzero((n.sum(axis=0) > 0) & (np.arange(len(n)) > 0))
    if len(used):
        now[used] = exchange_classes(n[np.ix_(used, used)], k - 1, start=now[used] - 1, fixed=used < k) + 1
    member = np.eye(k)[now]
    return np.concatenate([of[:END_ID], now[k:]]), member.T @ n @ member


class Model:
    def __init__(self, pair: np.ndarray, once: float, tokens: int, kinds: int, alpha: float = 8.0):
        """pair: class bigrams; once: training words seen once."""
        self.tokens, self.kinds = tokens, kinds
        p_unknown = max(0.5 * once, 1.0) / (tokens + 1.0)
        size = pair.sum(axis=0)
        share = size / max(size.sum(), 1)
        p = (pair + alpha * share) / (pair.sum(axis=1, keepdims=True) + alpha)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.log10(p) + np.log10(1 - p_unknown) - np.log10(size)
        t[:, 0] = np.log10(p_unknown)
        self.step = t

    def score(self, s: _Seqs, of: np.ndarray) -> np.ndarray:
        """log10 probability of each text, of being the classes of the block's words."""
        return s.known + np.add.reduceat(self.step[of[s.before], of[s.seq]], s.off[:-1])


def scores(docs: DataFrame, train: Column, *, frequent_share: int = 12_288, n_classes: int = 48, block_bytes: int = 4 << 20, passes: int = 2) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, train_words, base_score, score
    and perplexity (10 to the power of -score / n_tokens).

    A word is in the core if it occurs at least bytes / frequent_share times,
    bytes being those of all texts: at most frequent_share words do. All other
    training words are assigned in so many passes.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(tk.long_id(), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    _, size, n = tk.block_sizes(spark, d, block_bytes=block_bytes)
    frequent = max(size / frequent_share, 2.0)
    blocks = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).groupBy("block")

    def tidy(out: pa.Table) -> pa.Table:
        tk.release()
        return out

    counts = blocks.applyInArrow(lambda t: tidy(send_counts(t, n)), sql_schema(COUNTS))
    reply = counts.groupBy("bucket").applyInArrow(lambda t: tidy(add_counts(t)), sql_schema(REPLY))
    seqs = table(blocks.cogroup(reply.groupBy("block")).applyInArrow(lambda t, r: tidy(sequences(t, r, n, frequent)), sql_schema(SEQS)), "sequences")
    kinds = seqs.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    stored = seqs.where("block >= 0")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in b.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], ["w"])

    vocab = np.sort(np.array([r[0] for r in stored.select("core").mapInArrow(words, "w long").distinct().collect()], np.int64).view(np.uint64))

    def counted(df: DataFrame, numbers: Callable[[_Seqs], np.ndarray], m: int) -> np.ndarray:
        """Bigrams of what numbers gives for a block's words, below m."""

        def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in batches:
                for r in b.to_pylist():
                    s = _Seqs(r, n)
                    p, c = s.pairs(numbers(s), m)
                    merged, inv = np.unique(np.concatenate([pairs, p]), return_inverse=True)
                    pairs, ns = merged, np.bincount(inv, weights=np.concatenate([ns, c]), minlength=len(merged)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(ns)], ["p", "n"])

        got = df.mapInArrow(bigrams, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((m, m))
        out.ravel()[got.column("p").to_numpy()] = got.column("n").to_numpy()
        return out

    m, own = END_ID + 1 + len(vocab), spark.sparkContext.broadcast(vocab)
    first = counted(stored, lambda s: s.pseudo_words(own.value), m)
    of, pair = core_classes(first, n_classes)
    k = len(pair)
    start = spark.sparkContext.broadcast((vocab, of))
    assigned = lambda known: lambda t: tidy(assign(t, known.value))
    numbered = lambda start: lambda s: core_or_class(s, start.value, k)
    updated = lambda start: lambda t, r: tidy(with_classes(t, r, start.value, n))
    for _ in range(passes if k > 1 else 0):
        known = spark.sparkContext.broadcast(pair)

        def contexts(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    s = _Seqs(r, n)
                    yield from send_contexts(s, r["block"], classes_of(s, start.value), k).to_batches()
                    tk.release()

        sent = stored.mapInArrow(contexts, sql_schema(CONTEXTS))
        reply = sent.groupBy("bucket").applyInArrow(assigned(known), sql_schema(CLASSES))
        stored = table(stored.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(updated(start), sql_schema(SEQS)), "classes")
        of, pair = core_again(counted(stored, numbered(start), k + 1 + len(vocab)), of, k)
        start = spark.sparkContext.broadcast((vocab, of))
    shared = spark.sparkContext.broadcast(Model(pair, first[:, 1].sum(), int(first.sum()), int(kinds)))
    names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "train_words", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mod = shared.value
        for b in batches:
            for r in b.to_pylist():
                s = _Seqs(r, n)
                k = len(s.ids)
                base = s.plus_one - s.n * np.log10(mod.tokens + mod.kinds + 1)
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(s.train), pa.array(s.n), pa.array(s.known_n), pa.array(np.full(k, mod.tokens)), pa.array(np.full(k, mod.kinds)), pa.array(base), pa.array(mod.score(s, classes_of(s, start.value)))], names)

    out = stored.mapInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, train_words long, base_score double, score double")
    return tk.with_null_ids(out, "doc_id").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
