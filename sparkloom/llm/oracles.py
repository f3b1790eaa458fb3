"""DuckDB SQL for the rows of the operators' queries, where SQL can say it.

All work on whole tables, by plain comparison of texts, without hashes.
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_text, _line = LOWER.format("coalesce(text, '')"), LOWER.format("line")
ITEM_WORD, WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_text}, '{ITEM_WORD}') AS ws FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_text}, '{ITEM_WORD}') AS ws
    FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (
    SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS phrase
    FROM items, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS u(i) WHERE len(ws) > 0),
windows AS (
    SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
    FROM docs, (SELECT DISTINCT n FROM phrases) AS sizes, unnest(range(1, len(ws) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, i, n, item FROM windows JOIN phrases USING (n, phrase)),
words AS (SELECT DISTINCT doc_id, j FROM hits, unnest(range(i, i + n)) AS u(j)),
runs AS (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM words),
covered AS (
    SELECT doc_id, count(*) AS n_hit, count(*) FILTER (before IS NULL OR before < j - 1) AS n_spans
    FROM runs GROUP BY doc_id),
found AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
    FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_spans, 0) AS n_spans
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Distinct shingles of the word list ws of each row of a table, by its key.
SHINGLES = """
    SELECT DISTINCT {key}, array_to_string(ws[i:i + 4], ' ') AS shingle
    FROM {table}, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0"""

NGRAM_JOIN = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_text}, '{WORD}') AS ws FROM documents),
sets AS ({SHINGLES.format(key="doc_id", table="docs")}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes k ON k.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(m.n) + any_value(k.n) - count(*))),
reach(root, node) AS (
    SELECT x, x FROM links
    UNION SELECT root, y FROM reach JOIN links ON node = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT root AS doc_id, min(node) AS first FROM reach GROUP BY root) USING (doc_id)
"""

LINE_DEDUP = rf"""
WITH lines AS (
    SELECT doc_id, pos, line, regexp_extract_all({_line}, '{WORD}') AS ws
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
places AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS place FROM lines),
same AS (SELECT ws, min(place) AS id FROM places WHERE len(ws) > 0 GROUP BY ws),
shingles AS ({SHINGLES.format(key="id", table="same")}),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
late AS (
    SELECT DISTINCT id FROM (
        SELECT b.id FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.id < b.id
        JOIN sizes m ON m.id = a.id JOIN sizes k ON k.id = b.id
        GROUP BY a.id, b.id HAVING 100 * count(*) >= 75 * (any_value(m.n) + any_value(k.n) - count(*)))),
judged AS (
    SELECT doc_id, pos, line, same.id IS NOT NULL AS counted,
        same.id IS NOT NULL AND (place > same.id OR late.id IS NOT NULL) AS gone
    FROM places LEFT JOIN same ON places.ws = same.ws LEFT JOIN late ON late.id = same.id)
SELECT doc_id, count(*) FILTER (counted) AS n_lines, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, b[i:i + 49] AS w FROM docs, unnest(range(1, n - 48)) AS u(i)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first < doc_id),
heads AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -50) + 50 AS head FROM hits),
runs AS (SELECT doc_id, i, sum(CAST(head AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM heads),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM runs GROUP BY doc_id, run),
gaps AS (
    SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS s, s AS e FROM spans
    UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(CASE WHEN coalesce(e, n + 1) > s THEN hex(b[s:coalesce(e, n + 1) - 1]) ELSE '' END, '' ORDER BY s) AS h
    FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM docs LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SUBSTRING_DEDUP = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS w FROM docs, unnest(range(1, len(ws) - 48)) AS u(i)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first < doc_id),
words AS (SELECT doc_id, j, ws[j] AS word FROM docs, unnest(range(1, len(ws) + 1)) AS u(j)),
judged AS (
    SELECT doc_id, j, word, coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY j) > j - 50, FALSE) AS gone
    FROM words LEFT JOIN (SELECT doc_id, i, i AS j FROM hits) USING (doc_id, j)),
sums AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept
    FROM judged GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id)
"""

MIXING = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
good AS (SELECT doc_id, pow(4, avg(quality)) / 2 AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
keyed AS (
    SELECT s.*, -ln((CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '-1') || ':7'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)
        / CASE WHEN weight > 0 THEN weight ELSE 1 END AS k
    FROM sized s LEFT JOIN good ON good.doc_id = s.doc_id),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
caps AS (
    SELECT *, CAST([3, 1, 2][i % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap
    FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sums)),
-- sources fill up in order of cap / w; each sees what those before it left
fill AS (
    SELECT *, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS restw
    FROM caps WINDOW before AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest / restw AS level FROM fill WHERE cap * restw > rest * w ORDER BY cap / w, i LIMIT 1),
targets AS (
    SELECT source, source_size, CASE WHEN cap * restw <= rest * w THEN cap ELSE least((SELECT level FROM level) * w, cap) END AS target FROM fill),
budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS epochs FROM targets),
spent AS (
    SELECT k.doc_id, k.source, k.size, b.source_size, b.target, b.epochs,
        greatest(CAST(round(target) AS BIGINT) - epochs * source_size, 0)
            - (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size) AS room
    FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source, source_size, target, epochs,
    CAST(epochs * size + greatest(least(room, size), 0) AS BIGINT) AS taken
FROM spent
"""

PHRASES = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
    FROM documents, unnest(regexp_split_to_array({_text}, '[.,;:!?\x0A-\x0D]')) AS u(piece)),
grams AS (
    SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS c
    FROM pieces, unnest(range(1, 6)) AS s(k), unnest(range(1, len(ws) - k + 2)) AS u(i) GROUP BY ALL),
totals AS (SELECT lang, sum(c) AS n FROM grams WHERE words = 1 GROUP BY lang),
f AS (SELECT * FROM grams WHERE c >= 100),
cuts AS (
    SELECT lang, phrase, words, c AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
        array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
    FROM f, unnest(range(1, words)) AS u(k) WHERE words > 1),
scored AS (
    SELECT cuts.*, l.c AS l, r.c AS r, n::BIGINT AS n,
        CAST((1000::HUGEINT * a * n) // (l.c::HUGEINT * r.c) AS BIGINT) AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head
    JOIN f r ON r.lang = cuts.lang AND r.phrase = rest JOIN totals t ON t.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
    SELECT * FROM best WHERE NOT EXISTS (
        SELECT 1 FROM f WHERE f.lang = best.lang AND f.words > best.words AND 100 * f.c >= 100 * best.a
        AND contains(' ' || f.phrase || ' ', ' ' || best.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM ranked WHERE rank <= 2000
"""

# crc32 is not a function of DuckDB: a table of 256 steps, made by the rule of the polynomial, folds over the bytes.
_CRC = """
step AS (
    SELECT list(x ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS x
        FROM range(256) AS u(i)))"""


def _crc(text: str) -> str:
    """The CRC-32 of a text of ASCII and other characters, as UTF-8; step must be joined."""
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda j: ('0x' || substr(hex(encode({text})), 2 * j - 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


TXLOG = rf"""
WITH {_CRC.strip()},
ids AS (SELECT doc_id, source, text, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, step WHERE doc_id IS NOT NULL),
log AS (
    SELECT doc_id, source, h % 41 AS m, (h // 100) % 3000 AS key,
        CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN text END AS text FROM ids),
ahead AS (
    SELECT *, lead(CASE WHEN m <= 6 THEN doc_id END IGNORE NULLS) OVER w AS control,
        lead(CASE WHEN m <= 6 THEN m END IGNORE NULLS) OVER w AS control_m,
        lead(CASE WHEN m <= 2 THEN doc_id END IGNORE NULLS) OVER w AS fin,
        lead(CASE WHEN m <= 2 THEN m END IGNORE NULLS) OVER w AS fin_m
    FROM log WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
undone AS (
    SELECT CASE WHEN control_m >= 5 THEN 'rollback' ELSE 'abort' END AS kind, doc_id AS id,
        CASE WHEN control_m >= 5 THEN control ELSE fin END AS n, key AS value
    FROM ahead WHERE m > 6 AND (coalesce(control_m, 0) >= 5 OR coalesce(fin_m, 2) = 2)),
commits AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS number FROM log WHERE m <= 1),
applied AS (
    SELECT key, text, (number - 1) // 16 + 1 AS epoch, number, ahead.doc_id
    FROM ahead JOIN commits ON commits.doc_id = fin WHERE m > 6 AND coalesce(control_m, 0) < 5 AND fin_m <= 1),
last AS (SELECT *, lead(epoch) OVER (PARTITION BY key ORDER BY epoch) AS until FROM (
    SELECT * FROM applied QUALIFY row_number() OVER (PARTITION BY key, epoch ORDER BY number DESC, doc_id DESC) = 1)),
epochs AS (SELECT DISTINCT (number - 1) // 16 + 1 AS epoch FROM commits),
states AS (
    SELECT epochs.epoch, count(text) AS n, CAST(coalesce(sum(crc) FILTER (text IS NOT NULL), 0) AS BIGINT) AS value
    FROM epochs LEFT JOIN (SELECT last.epoch, until, text, {_crc("(key || ':' || text)")} AS crc FROM last, step) s
    ON s.epoch <= epochs.epoch AND coalesce(until > epochs.epoch, true) GROUP BY epochs.epoch)
SELECT 'state' AS kind, epoch AS id, n, value FROM states UNION ALL SELECT kind, id, n, value FROM undone
"""

ORACLES = {
    "op1_decontamination": DECONTAMINATION,
    "op3_ngram_join": NGRAM_JOIN,
    "op4_mixing": MIXING,
    "op6_line_dedup": LINE_DEDUP,
    "op7_suffix_dedup": SUFFIX_DEDUP,
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op11_phrases": PHRASES,
    "op12_txlog": TXLOG,
}
