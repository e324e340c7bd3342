"""DuckDB SQL of the queries whose whole results SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased text, as the word operators take them.
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hex digits are four characters of base32.
_DIGEST = f"array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '')"

OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[k:k + 4], ' ') ELSE array_to_string(w, ' ') END AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, sum(hash(x)) AS set_hash FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a),
copy AS (SELECT a, least(a, min(b)) AS copy_id FROM links WHERE same GROUP BY a),
of AS (SELECT doc_id, coalesce(copy_id, doc_id) AS copy_id FROM documents LEFT JOIN copy ON a = doc_id),
degree AS (SELECT links.a, count(*) AS n_links, count(DISTINCT CASE WHEN NOT same THEN of.copy_id END) AS n_texts FROM links JOIN of ON of.doc_id = links.b GROUP BY links.a)
SELECT of.doc_id, of.copy_id, coalesce(class_id, of.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts
FROM of LEFT JOIN class ON class.a = of.doc_id LEFT JOIN degree ON degree.a = of.doc_id
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, win.n, item_id FROM places JOIN win USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_TOKENS} AS w FROM documents),
tri AS (SELECT doc_id, k, array_to_string(w[k:k + 2], chr(10)) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
      + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END + CASE WHEN 10 * n_upper > 5 * n_letters AND 2 * n_bangs > n_words THEN 16 ELSE 0 END
      + CASE WHEN word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 > 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

#: CRC-32 of an id's digits, byte by byte.
_CRC = "xor(CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(k AS BIGINT) for k in range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)) AS BIGINT), CAST(4294967295 AS BIGINT))"

#: What op7 and op8 find before their methods add to it, and the counts of op5 and op10.
LANGUAGE_MODEL_BASE = rf"""
WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+'), chr(0)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, CAST(round(1000 * sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1))))) AS BIGINT) AS base_millis
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out, n
"""

LICENSE_BASE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, k - 1 AS pos, CASE WHEN w[k:k + 1] = ['cc', 'by'] THEN 'cc-by' WHEN w[k:k + 2] = ['general', 'public', 'license'] THEN 'gpl' WHEN w[k:k + 2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
f AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN f USING (doc_id)
"""

SECRET_COUNTS = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda s: length(s) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda s: length(s) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda s: length(s) >= 32)) AS BIGINT) AS n_hex
FROM documents
"""

REPEAT_COUNTS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS x FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 199 AS BIGINT))) AS p FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM w) WHERE c > 1),
g AS (SELECT doc_id, lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p AS step FROM r),
s AS (SELECT doc_id, CAST(sum(least(coalesce(step, 200), 200)) AS BIGINT) AS n_removed, count(*) FILTER (WHERE step IS NULL OR step > 200) AS n_spans FROM g GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN s USING (doc_id)
"""

#: The checksum's table, by its rule.
_CRC_TABLE = []
for _b in range(256):
    for _ in range(8):
        _b = _b >> 1 ^ (3988292384 if _b & 1 else 0)
    _CRC_TABLE.append(_b)
#: CRC-32 of the UTF-8 bytes of s, of code points up to U+07FF.
_CRC_TEXT = f"""xor(CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(s, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [CAST(192 + (ord(ch) >> 6) AS BIGINT), CAST(128 + (ord(ch) & 63) AS BIGINT)] END))),
  lambda c, b: xor(list_extract(CAST({_CRC_TABLE} AS BIGINT[]), 1 + (xor(c, b) & 255)), c >> 8)) AS BIGINT), CAST(4294967295 AS BIGINT))"""

OP11 = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT concat(doc_id, ':', run) AS s, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_CRC_TEXT} AS h FROM counted),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
near AS (SELECT DISTINCT word, n, other, other_n FROM (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word)),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word, n),
f AS (SELECT word, n, n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM best),
way AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
r AS (SELECT word, last(root ORDER BY step) AS root FROM way GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN f ON f.word = v.word LEFT JOIN r ON r.word = v.word
"""

OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS x FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY lang, x HAVING count(*) >= 30),
cand AS (SELECT lang, x, c AS a FROM g WHERE len(x) > 1),
cuts AS (SELECT lang, x, a, k, x[1:k] AS x1, x[k + 1:] AS x2 FROM (SELECT *, unnest(range(1, len(x))) AS k FROM cand)),
s AS (SELECT cuts.lang, cuts.x, a, k, f1.c AS l, f2.c AS r, CAST((2000000::HUGEINT * a) // (f1.c::HUGEINT + f2.c) AS BIGINT) AS score
      FROM cuts JOIN g f1 ON f1.lang = cuts.lang AND f1.x = cuts.x1 JOIN g f2 ON f2.lang = cuts.lang AND f2.x = cuts.x2),
best AS (SELECT lang, x, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
inner_x AS (SELECT lang, x[i:i + m - 1] AS x, max(a) AS most FROM (SELECT lang, x, a, m, unnest(range(1, len(x) - m + 2)) AS i FROM (SELECT lang, x, a, unnest(range(2, len(x))) AS m FROM cand)) GROUP BY ALL),
kept AS (SELECT best.lang, array_to_string(best.x, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN inner_x i ON i.lang = best.lang AND i.x = best.x WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op3_warc": OP3, "op4_jaccard_join": OP4, "op6_decontaminate": OP6, "op9_quality": OP9, "language_model_base": LANGUAGE_MODEL_BASE, "license_base": LICENSE_BASE, "secret_counts": SECRET_COUNTS, "repeat_counts": REPEAT_COUNTS, "op11_spelling": OP11, "op12_collocations": OP12}
