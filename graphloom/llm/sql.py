"""DuckDB SQL that says the same as queries of the catalog, written as plainly as it can be."""

LINE_DEDUP = r"""
WITH line AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS content
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id IS NOT NULL)
), parsed AS (
  SELECT doc_id, i, list_transform(list_filter(string_split_regex(lower(content), '[ \t\r\f]+'), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '*' ELSE '=' || t END) AS f FROM line
), sized AS (
  SELECT doc_id, i, f, len(f) AS n, len(list_filter(f, lambda t: t <> '*')) AS fixed, greatest(0, len(f) - 2) AS rest, greatest(1, least(8, len(f) - 2)) AS k FROM parsed WHERE len(f) > 0
), part AS (
  SELECT doc_id, i, n, fixed, p, n || '/' || array_to_string(f[1:2], ' ') || '/' || p || '/' || array_to_string(f[3 + rest * p // k : 2 + rest * (p + 1) // k], ' ') AS part
  FROM (SELECT *, unnest(range(k)) AS p FROM sized)
), counted AS (
  SELECT *, count(DISTINCT doc_id) OVER (PARTITION BY part) AS docs FROM part
), template AS (
  SELECT doc_id, i, n, fixed, array_to_string(list_transform(list_zip(parts, docs), lambda x: CASE WHEN 2 * x[2] > list_sort(docs)[(len(docs) + 1) // 2] THEN '=' || x[1] ELSE '*' END), '|') AS template
  FROM (SELECT doc_id, i, n, fixed, list(part ORDER BY p) AS parts, list(docs ORDER BY p) AS docs FROM counted GROUP BY doc_id, i, n, fixed)
  WHERE 2 * fixed >= n
), recurring AS (
  SELECT n, template, min(doc_id) AS first FROM template GROUP BY n, template HAVING (count(DISTINCT doc_id) - 1) * max(fixed) >= 50
), hit AS (SELECT DISTINCT doc_id, i FROM template JOIN recurring USING (n, template) WHERE doc_id <> first
), kept AS (
  SELECT line.doc_id, count(hit.i) AS n_dropped, string_agg(content, chr(10) ORDER BY line.i) FILTER (hit.i IS NULL) AS text
  FROM line LEFT JOIN hit ON hit.doc_id = line.doc_id AND hit.i = line.i GROUP BY line.doc_id
), done AS (
  SELECT d.doc_id, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
  FROM documents d LEFT JOIN kept k USING (doc_id)
)
SELECT doc_id, n_dropped, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM done
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM benchmark WHERE item_id IS NOT NULL
), words AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS pos FROM d
), item_words AS (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS pos, len(t) AS n FROM b WHERE len(t) >= 9
), same AS (
  SELECT doc_id, item_id, n, words.pos - item_words.pos AS begin, item_words.pos AS pos
  FROM words JOIN item_words USING (w)
), spans AS (
  SELECT doc_id, item_id, n, begin, pos,
    count(*) OVER (PARTITION BY doc_id, item_id, begin ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS matched
  FROM same
), lengths AS (SELECT doc_id, len(t) AS m FROM d)
SELECT s.doc_id, s.item_id, max(matched)::BIGINT AS matched
FROM spans s JOIN lengths USING (doc_id)
WHERE least(m - begin, n) - greatest(0, -begin) >= least(n, 13)
  AND matched >= CASE WHEN n < 13 THEN n - 1 ELSE 11 END
GROUP BY s.doc_id, s.item_id
"""

NEIGHBOURS = """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 3 WHEN 'assistant' THEN 3 ELSE 5 + length(url_encode(role)) END AS name,
    CASE WHEN regexp_matches(text, '␛.|<s>|</s>|\[/?(INST|SYS|OUT|ROLE)\b') THEN length(regexp_replace(text, '(␛|<s>|</s>|\[/?(INST|SYS|OUT|ROLE)\b)', '␛\1', 'g')) ELSE length(text) END AS written
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(3 + 2 * name + 2 + 1 + written + 1 + 3 + 4 + 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p
), r AS (
  SELECT *, payload_bytes >= 1000 AND page_id IS NOT NULL AS large, max(page_id) OVER w AS top,
    row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS place
  FROM d WINDOW w AS (PARTITION BY payload_digest)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN large AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN large AND place > 1 THEN top END AS refers_to
FROM r
"""

PERIODIC_RUNS = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)) AS digits
  FROM documents
), hashed AS (
  SELECT r, doc_id, w, len(w)::BIGINT AS n,
    xor(list_reduce(digits, lambda crc, d: list_reduce(list_concat([xor(crc, d::BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, o: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM numbered
), planned AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS fold FROM hashed
), built AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // fold) + 1] END) END AS w FROM planned
), word AS (SELECT r, n, unnest(w) AS w, unnest(range(n)) AS i FROM built
), agree AS (SELECT x.r, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM agree) GROUP BY r, q, part HAVING count(*) >= greatest(6 - q, 3 * q)
), run AS (SELECT r, start, length, min(q) AS period FROM island GROUP BY r, start, length
), gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (SELECT word.r, string_agg(w, ' ' ORDER BY word.i) AS text FROM word ANTI JOIN gone ON gone.r = word.r AND gone.i = word.i GROUP BY word.r
), listed AS (SELECT r, count(*)::BIGINT AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY r
), longest AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM built LEFT JOIN listed USING (r) LEFT JOIN longest USING (r) LEFT JOIN kept USING (r)
"""
