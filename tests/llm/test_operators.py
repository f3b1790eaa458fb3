"""The operators against brute force on a small corpus with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import brownlm, decontaminate, langid, linededup, media, mixing, ngramjoin, rlzdedup, sharding, suffixdedup
from sparkloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, row int"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    r = random.Random(5)
    syl = ["ba", "Ko", "re", "ü", "ti", "zo", "na", "ß"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 3)))
    text = lambda n: "".join(word() + (r.choice([" ", " ", " ", "\n"])) for _ in range(n)).strip()
    base = [text(r.randint(5, 200)) for _ in range(30)]
    out = list(base)
    for _ in range(30):
        w = r.choice(base).split(" ")
        w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    passage = text(80)
    out += [text(20) + " " + passage + " " + text(20) for _ in range(8)] + [base[0]] * 5
    out += ["", None, " \n ", "x", "one two", "a" * 60, "a" * 60, "\x00" * 70, "12 34", text(6000)]
    rows = [(i, t, None if i % 11 == 0 else "l%d" % (i % 2), None if i % 9 == 0 else "s%d" % (i % 4), 0, "x", 1) for i, t in enumerate(out)]
    return [*rows, rows[3]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def with_null_id(docs):
    return docs.withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))


@pytest.mark.parametrize(("length", "block_bytes"), [(50, 2 << 20), (50, 1024), (20, 4096), (100, 4096), (160, 4096)])
def test_suffix_dedup(docs, empty, length, block_bytes):
    rows, first = corpus(), {}
    for d, t, *_ in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            first.setdefault(b[a : a + length], d)
    want = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        g = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < d:
                g[a : a + length] = b"\1" * length
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        want[d, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffixdedup.dedup(docs, length=length, block_bytes=block_bytes).collect()) == want
    if block_bytes > 4096:
        assert suffixdedup.dedup(empty).count() == 0
        assert suffixdedup.dedup(with_null_id(docs)).where("doc_id is null").count() == 1


def test_longest_previous_factors():
    """Against the definition: the longest common length with any suffix of an earlier document."""
    r = np.random.default_rng(6)
    for _ in range(30):
        n = int(r.integers(1, 40))
        docs, common = r.integers(0, 6, n), r.integers(0, 4, n)
        common[0] = 0
        want = [max([0, *(min(common[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if docs[j] < docs[i])]) for i in range(n)]
        assert suffixdedup.longest_previous(docs, common).tolist() == want


@pytest.mark.parametrize("block_bytes", [2 << 20, 1024])
def test_substring_dedup(docs, empty, block_bytes):
    rows, first = corpus(), {}
    for d, t, *_ in sorted(rows, key=lambda x: x[0]):
        w = SPACE.findall(t or "")
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), d)
    want = Counter()
    for d, t, *_ in rows:
        w = SPACE.findall(t or "")
        g = [0] * len(w)
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < d:
                g[a : a + 50] = [1] * 50
        want[d, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rlzdedup.dedup(docs, block_bytes=block_bytes).collect()) == want
    assert rlzdedup.dedup(empty).count() == 0


def groups(sets: dict, percent: int = 75) -> dict:
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def shingles(t: str) -> frozenset:
    w = SPACE.findall(low(t))
    return frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join(docs, empty):
    sets = {d: shingles(t or "") for d, t, *_ in corpus()}
    group = groups(sets)
    want = Counter((d, len(sets[d]), group[d]) for d, *_ in corpus())
    assert Counter(tuple(r) for r in ngramjoin.join(docs, block_bytes=4096).collect()) == want
    assert Counter(tuple(r) for r in ngramjoin.join(docs, block_bytes=1 << 20, most=5).collect()) == want
    assert ngramjoin.join(empty).count() == 0
    assert ngramjoin.join(with_null_id(docs)).where("doc_id is null").count() == 1


def lines_by_force(rows: list[tuple], percent: int = 75) -> Counter:
    """(doc, lines, removed, digest): a line goes if any line before it is similar."""
    sets = [((NO_ID if d is None else d, i), shingles(x)) for d, t, *_ in rows for i, x in enumerate((t or "").split("\n"))]
    distinct = sorted({(p, s) for p, s in sets if s}, key=lambda x: x[0])

    def gone(place, s):
        return any(p < place and 100 * len(s & o) >= percent * len(s | o) for p, o in distinct)

    want = Counter()
    for d, t, *_ in rows:
        at, lines = NO_ID if d is None else d, (t or "").split("\n")
        bad = [bool(shingles(x)) and gone((at, i), shingles(x)) for i, x in enumerate(lines)]
        kept = "\n".join(x for x, g in zip(lines, bad, strict=True) if not g)
        want[d, sum(bool(shingles(x)) for x in lines), sum(bad), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return want


NO_ID = -(2**63)


@pytest.mark.parametrize("block_bytes", [2048, 1 << 20])
def test_line_dedup(spark, docs, empty, block_bytes):
    rows = [(None if d == 0 else d, *x) for d, *x in corpus()]
    got = linededup.dedup(with_null_id(docs), block_bytes=block_bytes, texts=True)
    assert Counter(tuple(r) for r in got.collect()) == lines_by_force(rows)
    assert linededup.dedup(empty).count() == 0


def test_line_dedup_removes_only_matches_of_earlier_lines(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:45])), (2, " ".join(w[7:52])), (3, " ".join(w[:52]))]
    got = {r.doc_id: r.n_removed for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_line_dedup_of_a_large_group(spark):
    r = random.Random(2)
    base = [f"v{i}" for i in range(48)]
    rows = []
    for d in range(400):
        x = list(base)
        for _ in range(r.randint(0, 3)):
            x[r.randrange(48)] = f"y{r.randrange(30)}"
        rows.append((d, "a common line of all\n" + " ".join(x) + "\n" + " ".join(x[:20])))
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4096, texts=True)
    assert Counter(tuple(r) for r in got.collect()) == lines_by_force(rows)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "x long, y long")
    got = dict(tuple(r) for r in components(links).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_decontamination(spark, docs, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [t for _, t, *_ in corpus()]
    items = [(1, " ".join(texts[65].split()[5:40])), (2, "one two"), (10, texts[1]), (3, None), (4, "..."), (None, "x"), (5, "x")]
    win = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t or ""))
        for a in range(max(1, len(w) - 9)) if w and i is not None else ():
            win[tuple(w[a : a + 10])].add(str(i))
    want = Counter()
    for d, t, *_ in corpus():
        w, hit, found = word.findall(low(t or "")), set(), set()
        for n in {len(x) for x in win}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in win:
                    hit |= set(range(a, a + n))
                    found |= win[tuple(w[a : a + n])]
        want[d, len(w), len(hit), ",".join(sorted(found))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench)
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()) == want
    # several passes over the documents, items cut into stretches; kept columns named like those in between
    named = docs.withColumnRenamed("block", "c0").withColumnRenamed("row", "_text")
    for words, blocks in ((16, 1), (7, 3)):
        more = decontaminate.decontaminate(named, bench, keep=named.columns, prefix="x_", block_words=words, pass_blocks=blocks).collect()
        assert Counter((r.doc_id, r.x_n_words, r.x_n_hit, ",".join(r.x_items)) for r in more) == want
        assert {r.doc_id: r.x_spans for r in more} == {r.doc_id: r.spans for r in got.collect()}
        assert {(r.doc_id, r.text, r.c0, r["_text"]) for r in more} == {(d, t, "x", 1) for d, t, *_ in corpus()}
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert all(len(spans[d]) > 0 for d in (1, 65))
    s = spans[1][0]
    assert (texts[1].encode()[s.start : s.end]).decode().split()[0].lower() == texts[1].split()[0].lower()
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_suffix_array_is_sorted():
    r = np.random.default_rng(1)
    seq = np.append(r.integers(0, 3, 300), 0)
    sa = decontaminate.suffix_array(seq, 2)
    cut = lambda i: seq[i : i + int(np.flatnonzero(seq[i:] == 0)[0])].tolist()
    assert [cut(i) for i in sa] == sorted(cut(i) for i in range(len(seq)))


def test_media(spark, docs, empty):
    refs = media.references(media.interleave(media.as_pages(docs)), ["doc_id", "n_bytes"])
    got = refs.join(media.describe(media.store(docs)), "digest", "left").collect()
    want = Counter((d, len((t or "").encode()), hashlib.sha256(media.payload(t)).hexdigest(), zlib.crc32(media.payload(t)[-16:])) for d, t, *_ in corpus())
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    page = '<p>a<img src="media:x" alt="b">c</p><figure><img src="u"><figcaption>say</figcaption></figure><script>no</script>'
    assert [(p["kind"], p["text"], p["ref"]) for p in media.parse_parts(page)] == [("text", "a", None), ("media", "b", "media:x"), ("text", "c", None), ("media", "say", "u")]
    assert media.parse_parts(None) == [] and media.parse_parts("<p") is not None
    assert media.store(empty).count() == 0
    seq = media.interleave(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    out = {r.page_id: r.parts for r in media.resolve(seq, media.describe(media.store(docs)), "page_id").collect()}
    assert [p.pos for p in out[1]] == [0, 1, 2, 3] and not out[2]


def test_mixing(docs, empty):
    got = mixing.mix(docs, rows_per_range=5).collect()
    size = {d: len(SPACE.findall(t or "")) for d, t, *_ in corpus()}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size[d]) for d, *_ in corpus())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    names = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    total = {s: sum(r.size for r in got if r.source == s) for s in names}
    w, target, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(total.values())
    open_ = set(names)
    while True:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] > 2 * total[s]}
        if not full:
            target |= part
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2.0 * total[s] for s in full)
        open_ -= full
    for s in names:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in mine) - target[s]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, rows_per_range=5).collect()), key=str)
    assert mixing.mix(empty).count() == 0


def uniform(doc_id: int) -> float:
    return (int(hashlib.md5(f"{doc_id}:7".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_mixing_prefers_heavy_documents(spark, docs):
    """Keys by weight: the documents of the partial epoch are those with the least -ln(u) / weight."""
    rows = [(i, "w " * 10, None, "s", 0, "x", 1) for i in range(400)] + [(1000 + i, "w " * 10, None, "t", 0, "x", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    quality = spark.createDataFrame([(i, 1000.0 if i % 4 == 0 else 0.01) for i in range(400)], "doc_id long, weight double")
    got = mixing.mix(df, [1, 20], 0.3, 2.0, quality=quality, rows_per_range=10).where("source = 's' and taken > 0").collect()
    key = sorted((-np.log(uniform(i)) / (1000.0 if i % 4 == 0 else 0.01), i) for i in range(400))
    assert 0 < len(got) < 400
    assert {r.doc_id for r in got} == {i for _, i in key[: len(got)]}


def test_sharding(docs, empty):
    got = sharding.shard(docs, 4, rows_per_range=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in corpus())
    for k in range(4):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty).count() == 0
    # copies stay together and shards are near equal where no group is larger than a shard
    r = random.Random(1)
    many = [(i, f"t{r.randrange(1500)} " + "w " * r.randrange(60), None, None, 0, "x", 1) for i in range(3000)]
    out = sharding.shard(docs.sparkSession.createDataFrame(many, SCHEMA), 4).collect()
    where, load = defaultdict(set), Counter()
    for x, t in zip(sorted(out, key=lambda x: x.doc_id), many, strict=True):
        where[t[1]].add(x.shard)
        load[x.shard] += x.size
    assert all(len(x) == 1 for x in where.values())
    assert max(load.values()) <= 1.02 * min(load.values())
    v = np.array([[5.0, 1, 1], [1, 5, 1], [3, 3, 3], [3, 3, 3]])
    assert len(set(sharding.pack_vectors(v, 4))) == 4


def test_language(docs, empty):
    trees = langid.learn(docs, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in langid.identify(docs, trees).collect()}
    assert len(got) == len(corpus()) - 1
    for d, t, *_ in corpus():
        none = not t or not re.search(r"[^\W\d_]", t)
        assert (got[d].lang_pred == "und") == none and 0 <= got[d].score <= 1
    assert langid.identify(empty, trees).count() == 0
    none = langid.learn(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    bits = trees.bits(np.array([(a << 8) | b for a in range(2) for b in range(256)], np.uint64))
    assert np.exp2(-bits[:256]).sum(axis=0).max() <= 1 + 1e-9


def test_language_learns_a_bounded_sample_and_survives_names(spark):
    rows = [(None, "the same words", "en", 1.0)] * 300 + [(i, f"text {i} of many", "en", 1.0) for i in range(50)] + [(1, "½ ² ①", "de", 2.0), (2, "ü", None, 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    trees = langid.learn(df, F.lit(True), texts_per_lang=20)
    assert sum(t[4].sum() for t in trees.tables[:1]) <= 20 * 20 + 10
    got = langid.identify(df, trees).collect()
    assert {r.lang_pred for r in got if r.text == "½ ² ①"} == {langid.UND} and all(0 <= r.score <= 1 for r in got)
    kept = langid.identify(df, trees, prefix="_p_").collect()
    assert sorted(r.score for r in kept) == sorted(r[3] for r in rows)
    bench = spark.createDataFrame([(1, "the same words")], "item_id long, text string")
    more = df.withColumn("n_hit", F.lit("own")).withColumn("items", F.lit(1))
    assert decontaminate.decontaminate(more, bench, keep=more.columns).where("n_hit > 0").count() == 300
    assert {r.n_hit for r in decontaminate.decontaminate(more, bench, keep=more.columns, prefix="_p_").collect()} == {"own"}


def test_code_lengths():
    """Bits and the best language by counting contexts anew for every byte."""
    r = random.Random(8)
    text = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 60)))
    learned = {"a": [text("abcde ü") for _ in range(6)], "b": [text("defgh ") for _ in range(6)]}
    trees, texts = langid.Trees(learned), ["", "zzz", *(text("abcdefgh üx") for _ in range(20))]
    seen = {}
    for lang, ts in learned.items():
        for b in (bytes(3) + t.encode() for t in ts):
            for i in range(3, len(b)):
                for k in range(4):
                    seen.setdefault((lang, b[i - k : i]), Counter())[b[i]] += 1

    def bits(lang, before, byte):
        p = 1 / 256
        for k in range(4):
            c = seen.get((lang, before[3 - k :]))
            if c:
                p = (c[byte] if c[byte] else len(c) * p) / (sum(c.values()) + len(c))
        return -np.log2(p)

    buf, offs = langid.tk.pack(langid.pa.array(texts))
    got = trees.code_lengths(buf, offs)
    for t, row in zip(texts, got, strict=True):
        b = bytes(3) + t.encode()
        assert row == pytest.approx([sum(bits(x, b[i - 3 : i], b[i]) for i in range(3, len(b))) for x in "ab"])


def test_class_lm(docs, empty):
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    count, tokens = Counter(), {}
    for d, t, *_ in corpus():
        tokens[d] = [*SPACE.findall(low(t or "")), None]
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(tokens[d])
    n, v = sum(count.values()), len(count)
    got = brownlm.scores(docs, train, block_bytes=4096).collect()
    assert len(got) == len(corpus())
    for r in got:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(w)))
    assert brownlm.scores(empty, F.lit(True)).count() == 0


def test_class_lm_is_a_distribution():
    """After every class the probabilities of all words and of the unknown one make 1."""
    pair = np.random.default_rng(2).poisson(5, (7, 7)).astype(float)
    pair[0] = pair[:, 0] = 0
    m = brownlm.Model(pair, 9, int(pair.sum()), 40)
    size = pair.sum(axis=0)
    each = np.where(size > 0, 10**m.step * size, 0)
    assert (each[:, 1:].sum(axis=1) + 10 ** m.step[:, 0])[1:] == pytest.approx(np.ones(6))


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(3)
    n = r.poisson(r.gamma(0.2, 5, (25, 25))).astype(float)

    def likelihood(of):
        p = np.eye(4)[of].T @ n @ np.eye(4)[of]
        return float(brownlm.xlogx(p).sum() - brownlm.xlogx(p.sum(axis=0)).sum() - brownlm.xlogx(p.sum(axis=1)).sum())

    each = [likelihood(brownlm.exchange_classes(n, 4, rounds=k)) for k in range(4)]
    assert each == sorted(each) and each[1] > each[0]


def test_the_core_moves_again():
    """Only the end and the core move, the likelihood rises, and the class bigrams are those of the new classes."""
    r = np.random.default_rng(11)
    k, m = 5, 5 + 1 + 20
    n = r.poisson(r.gamma(0.3, 6, (m, m))).astype(float)
    n[0] = n[:, 0] = 0
    of = np.concatenate([np.arange(brownlm.END_ID) % k, r.integers(1, k, 21)])

    def pairs(of):
        member = np.eye(k)[np.concatenate([np.arange(k), of[brownlm.END_ID :]])]
        return member.T @ n @ member

    def likelihood(p):
        return float(brownlm.xlogx(p).sum() - brownlm.xlogx(p.sum(axis=0)).sum() - brownlm.xlogx(p.sum(axis=1)).sum())

    got, pair = brownlm.core_again(n, of, k)
    assert (got[: brownlm.END_ID] == of[: brownlm.END_ID]).all() and (got != of).any() and got[brownlm.END_ID :].min() >= 1
    assert (pair == pairs(got)).all() and pair.sum() == n.sum()
    assert likelihood(pair) > likelihood(pairs(of))


def test_class_lm_assigns_rare_words(spark):
    r = random.Random(3)
    noun = lambda: r.choice(["n0", "n0", f"n{r.randint(1, 40)}"])
    verb = lambda: r.choice(["v0", "v0", f"v{r.randint(1, 40)}"])
    texts = [f"the {noun()} to {verb()}" for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    size = sum(map(len, texts))
    got = {x.doc_id: x.score for x in brownlm.scores(df, F.lit(True), frequent_share=size // 100, block_bytes=512).collect()}
    # only n0, v0, the, to and the end are in the core; a rare word is to join the one that stands where it does
    words = [["the", "N", "to", "V", "end"]] * len(texts)
    count = Counter(w for t in texts for w in t.split(" "))
    assert sum(c >= size / (size // 100) for c in count.values()) == 4
    pair = Counter(p for w in words for p in zip(["end", *w[:-1]], w, strict=True))
    of, total = Counter(p[0] for p in pair.elements()), sum(pair.values())
    into = Counter(p[1] for p in pair.elements())
    unknown = max(0.5 * sum(c == 1 for c in count.values()), 1) / (total + 1)
    step = {p: (n + 8 * into[p[1]] / total) / (of[p[0]] + 8) * (1 - unknown) / into[p[1]] for p, n in pair.items()}
    for i, t in enumerate(texts):
        w = words[i]
        assert got[i] == pytest.approx(sum(np.log10(step[p]) for p in zip(["end", *w[:-1]], w, strict=True)) + sum(np.log10(count[x]) for x in t.split(" ")) + np.log10(len(texts)))


def test_best_classes():
    """Each word's class against the likelihood of all bigrams, counted anew with the word in every class."""
    r = np.random.default_rng(4)
    k, m = 5, 30
    of = np.concatenate([np.arange(1, k), r.integers(1, k, m - k + 1)])
    bigrams = r.poisson(r.gamma(0.3, 4, (m, m))).astype(float)

    def pairs(of):
        member = np.eye(k)[of]
        return member.T @ bigrams @ member

    def likelihood(of):
        f = lambda v: float((v[v > 0] * np.log(v[v > 0])).sum())
        p = pairs(of)
        return f(p) - f(p.sum(axis=0)) - f(p.sum(axis=1))

    word, code, n = [], [], []
    for w in range(m):
        row = np.concatenate([bigrams[:, w] @ np.eye(k)[of], bigrams[w] @ np.eye(k)[of], [bigrams[w, w]]])
        for c in np.flatnonzero(row):
            word, code, n = [*word, w], [*code, c], [*n, row[c]]
    got = brownlm.best_classes(pairs(of), of, np.array(word), np.array(code), np.array(n))
    for w in range(m):
        each = [likelihood(np.where(np.arange(m) == w, c, of)) for c in range(1, k)]
        assert each[got[w] - 1] == pytest.approx(max(each), abs=1e-9)
    assert (got != of).any()


def test_near_duplicates_by_row(spark):
    import corpus_pipeline as p

    r = random.Random(9)
    a, b, c, d, e = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, d), (None, e), (None, a + " x"), (7, e), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((x.doc_id, x.text) for x in p.near_duplicates(spark, docs, "").collect())
    assert got == Counter([(2, b), (3, c), (3, d), (None, e), (None, a + " x"), (8, None), (None, None)])
    got = Counter((x.doc_id, x.text) for x in p.near_duplicates(spark, docs.where("doc_id = 1 or doc_id > 6"), "").collect())
    assert got == Counter([(1, a), (7, e), (8, None)])


def test_pipeline(spark):
    import corpus_pipeline as p

    out = p.run(spark, "/root/testdata/sf0.001").collect()
    assert out and {r.shard for r in out} <= set(range(40))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bad = {r.doc_id for r in decontaminate.decontaminate(docs, bench).where("n_hit > 0").collect()}
    assert not bad & {r.doc_id for r in out}


def targets_by_force(sizes: dict, weights: list[int] = (3, 1, 2)) -> dict:
    """Share 150 % of all sizes by weight; what is above twice a source's size goes to the others, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, rest = {}, 1.5 * sum(sizes.values())
    while open_ := [s for s in order if s not in full]:
        level = (rest - sum(full.values())) / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] >= 2 * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in open_}
        full |= {s: 2.0 * sizes[s] for s in over}
    return full


def copies_by_force(rows: list[tuple], weight: dict) -> dict:
    """How often each document is in the mix: whole epochs, then by key, the one at the edge if half of it fits."""
    size = {r[0]: len(SPACE.findall(r[1])) for r in rows}
    of = defaultdict(list)
    for d, _, source in rows:
        of[source].append(d)
    total = {s: sum(size[d] for d in ds) for s, ds in of.items()}
    want, out = targets_by_force(total), {}
    for s, ds in of.items():
        epochs = int(want[s] / total[s] + 1e-9)
        left = round(want[s]) - epochs * total[s]
        for d in sorted(ds, key=lambda d: -np.log(uniform(d)) / weight.get(d, 1.0)):
            out[d] = epochs + (left > 0 and 2 * left >= size[d])
            left -= size[d]
    return out


def test_pipeline_by_force(spark, docs, empty, tmp_path):
    import corpus_pipeline as p

    texts = [t for _, t, *_ in corpus()]
    bench = [(1, " ".join(texts[7].split()[:12])), (2, texts[69]), (3, None)]
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d in range(0, 90, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {(d, t, s) for d, t, _, s, *_ in corpus() if any(c.isalpha() for c in t or "")}
    sets = {d: shingles(t) for d, t, _ in rows}
    group = groups(sets)
    rows = {r for r in rows if group[r[0]] == r[0]}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    said = lambda t, n: {tuple(w[a : a + n]) for w in [word.findall(low(t))] for a in range(len(w) - n + 1)}
    windows = {x for _, t in bench if t for x in said(t, min(10, len(word.findall(t))))}
    dirty = {r for r in rows if windows & {x for n in {len(x) for x in windows} for x in said(r[1], n)}}
    rows -= dirty
    assert dirty and len(rows) > 10
    copies = copies_by_force(sorted(rows, key=lambda r: r[0]), {d: 4.0 ** (d % 2) / 2 for d in range(0, 90, 3)})
    want = Counter({(d, len(t.encode()) + 16, zlib.crc32(t.encode()), len(SPACE.findall(t))): copies[d] for d, t, _ in rows if copies[d]})
    out = p.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.tokens) for r in out) == want
    for k in {r.shard for r in out}:
        assert 0 <= k < 40 and sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
