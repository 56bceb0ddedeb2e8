"""SQL with the rows of those operators' queries that SQL can express."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT r.x AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id, min(r.y) = r.x AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x"""

_NIBBLES = "0000000100100011010001010110011110001001101010111100110111101111"
OP2 = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages),
b AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
      array_to_string(list_transform(range(1, 41), lambda i: substr('{_NIBBLES}', 4 * (instr('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '') AS bits FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * k + j + 1, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
       true AS has_request, true AS has_metadata
FROM b"""

OP4 = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS b, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
levels AS (SELECT unnest(range(0, 61)) AS bits),
s AS (SELECT bits, h >> (60 - bits) AS prefix, sum(b) AS n, min(h) = max(h) AS single FROM d, levels GROUP BY 1, 2),
fit AS (SELECT bits, prefix, n FROM s WHERE n <= 1048576 OR single),
chosen AS (SELECT h, min(bits) AS bits FROM (SELECT DISTINCT h FROM d) x JOIN fit ON fit.prefix = x.h >> (60 - fit.bits) GROUP BY h)
SELECT doc_id, CASE WHEN c.bits = 0 THEN '' ELSE lpad(bin(d.h >> (60 - c.bits)), CAST(c.bits AS INTEGER), '0') END AS shard,
       CAST(c.bits AS INTEGER) AS local_depth, CAST(n AS BIGINT) AS shard_bytes, n > 1048576 AS indivisible
FROM d JOIN chosen c USING (h) JOIN fit ON fit.bits = c.bits AND fit.prefix = d.h >> (60 - c.bits)"""

OP5 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM later, range(0, 20) r(o)),
left_ AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w) t ANTI JOIN gone USING (doc_id, pos) GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id)"""
