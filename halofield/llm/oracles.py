"""SQL for the queries of this subpackage that SQL can express, each over whole tables."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Bytes as pairs of hexadecimal digits, cut into pieces that overlap by a window; a window of 200 bytes is told by its MD5.
SUFFIX = """
WITH n AS (SELECT doc_id, h, len(h) // 2 AS n FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
c AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 1400) AS h FROM (SELECT *, unnest(range(0, n, 500)) AS c FROM n)),
p AS (SELECT doc_id, c + i AS p, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN c + i + 200 <= n THEN md5_number(substr(h, 2 * i + 1, 400)) END AS w FROM (SELECT *, unnest(range(0, least(500, n - c))) AS i FROM c)),
r AS (SELECT w FROM p WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
x AS (SELECT DISTINCT doc_id FROM p JOIN r USING (w)),
f AS (SELECT doc_id, p, byte, CASE WHEN r.w IS NOT NULL THEN p END AS hit FROM p SEMI JOIN x USING (doc_id) LEFT JOIN r USING (w)),
g AS (SELECT doc_id, p, byte, coalesce(p - max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) < 200, false) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM g),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN o USING (doc_id)
"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
p AS (SELECT doc_id, p, word, CASE WHEN p + 34 <= n THEN md5_number(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS s FROM u),
r AS (SELECT s FROM p WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
f AS (SELECT doc_id, p, word, CASE WHEN r.s IS NOT NULL THEN p END AS hit FROM p LEFT JOIN r USING (s)),
g AS (SELECT doc_id, p, word, coalesce(p - max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) < 35, false) AS gone FROM f),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""

#: Components by a closure over links: each node learns all nodes that it reaches.
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(ASCII_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.both >= 80 * (x.n + y.n - c.both)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
label AS (SELECT a AS doc_id, min(b) AS least_b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least_b, d.doc_id)) AS component_id, d.doc_id <= coalesce(least_b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN label USING (doc_id)
"""

#: Base 32 takes five bits a letter; five hexadecimal digits make four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}), ':', {0}) END"
ROW = f"sha256(concat({FIELD.format('CAST(doc_id AS VARCHAR)')}, {FIELD.format('source')}, {FIELD.format('lang')}, {FIELD.format('CAST(n_chars AS VARCHAR)')}, {{}}))"
#: The 256 registers of CRC-32 by its rule, and the CRC of a string of ASCII characters from them.
CRC_TABLE = "(SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) & 255 + 1])), 4294967295)".replace("xor(c, b) & 255 + 1", "(xor(c, b) & 255) + 1")
#: The others of a run of digests, before and behind place i.
BEFORE, BEHIND = "array_to_string(run[1:i % 3], '')", "array_to_string(run[i % 3 + 2:], '')"

#: Levels of all sources' trees, then of the tree of their tops; each row climbs both with its own digest.
MERKLE = f"""
WITH RECURSIVE f AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {ROW.format(FIELD.format('text'))} AS leaf, CASE WHEN doc_id IS NOT NULL AND {CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {ROW.format(FIELD.format("replace(text, chr(10), '')"))} END AS tampered FROM documents, {CRC_TABLE}),
leaves AS (SELECT row_number() OVER () AS k, doc_id, leaf, coalesce(tampered, leaf) AS shown, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM f),
nodes(tree, level, i, n, d) AS (SELECT tree, 0, i, n, leaf FROM leaves
  UNION ALL SELECT tree, level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3),
runs AS (SELECT tree, level, i // 3 AS p, list(d ORDER BY i) AS run FROM nodes WHERE n > 1 GROUP BY ALL),
subroots AS (SELECT tree, d AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, n, d) AS (SELECT 0, tree, n, subroot FROM subroots
  UNION ALL SELECT level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3),
top_runs AS (SELECT level, i // 3 AS p, list(d ORDER BY i) AS run FROM tops WHERE n > 1 GROUP BY ALL),
climb(k, tree, level, i, n, d, proof) AS (SELECT k, tree, 0, i, n, shown, '' FROM leaves
  UNION ALL SELECT k, c.tree, c.level + 1, i // 3, (n + 2) // 3, sha256(concat({BEFORE}, d, {BEHIND})), concat(proof, {BEFORE}, {BEHIND}) FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.p = c.i // 3 WHERE n > 1),
rise(k, level, i, n, d, proof) AS (SELECT k, 0, c.tree, s.n, d, proof FROM climb c JOIN subroots s USING (tree) WHERE c.n = 1
  UNION ALL SELECT k, c.level + 1, i // 3, (n + 2) // 3, sha256(concat({BEFORE}, d, {BEHIND})), concat(proof, {BEFORE}, {BEHIND}) FROM rise c JOIN top_runs r ON r.level = c.level AND r.p = c.i // 3 WHERE n > 1)
SELECT doc_id, leaf, subroot, (SELECT d FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = (SELECT d FROM tops WHERE n = 1) AS verified
FROM leaves JOIN subroots USING (tree) JOIN (SELECT k, d, proof FROM rise WHERE n = 1) USING (k)
"""

#: Distinct n-grams are hashed once; words and their places make the n-grams.
RESAMPLE = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
goal AS (SELECT regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
a AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)) GROUP BY ALL),
b AS (SELECT g, count(*) AS n FROM (SELECT array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM goal, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)) GROUP BY ALL),
h AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(g)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM a UNION SELECT g FROM b)), {CRC_TABLE}),
s AS (SELECT bucket, sum(n) AS s FROM a JOIN h USING (g) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM b JOIN h USING (g) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * ((SELECT sum(s) FROM s) + 10000e0) / ((coalesce(s, 0) + 1e0) * (coalesce((SELECT sum(t) FROM t), 0) + 10000e0)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM a JOIN h USING (g) JOIN gain USING (bucket) GROUP BY 1),
r AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM docs LEFT JOIN w USING (doc_id)),
o AS (SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS FIRST, n_features) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM r WHERE n_words >= 20) // 100 THEN place END AS rank, CAST(n_words AS BIGINT) AS n_words FROM o
"""
