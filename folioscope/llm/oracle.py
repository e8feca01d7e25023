"""SQL of the operators' queries, where SQL can express them."""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), w AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), n AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source
), groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0)::HUGEINT AS total, coalesce(s.v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN totals t USING (lang, source) LEFT JOIN sizes s USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
         1 + ((coalesce(n.n, 0)::HUGEINT + 5) * 1000000000) // (g.total + 5 * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)
), whole AS (
  SELECT k.lang, k.term, 1 + ((sum(k.n)::HUGEINT + 5) * 1000000000) // (any_value(l.total) + 5 * any_value(l.v)) AS q
  FROM n k JOIN (SELECT lang, sum(total)::HUGEINT AS total, max(v) AS v FROM groups GROUP BY lang) l USING (lang)
  GROUP BY k.lang, k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
  ) f ON f.lang = a.lang AND f.s = a.source AND f.t = b.source
), terms AS (
  SELECT s.lang, s.source, s.term AS item, s.p - w.q AS value FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value::BIGINT,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: The unsigned crc32 is a fold over the UTF-8 bytes with the table of its polynomial.
SPELLING = r"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch:
    CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [192 | (ord(ch) >> 6), 128 | (ord(ch) & 63)]::BIGINT[] END)) AS b
  FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM bytes, crc
), results AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), masked AS (
  SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: word[: i - 1] || '*' || word[i + 1 :])) AS mask FROM words
), shorter AS (
  SELECT DISTINCT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: word[: i - 1] || word[i + 1 :])) AS cut FROM words
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.cut = w.word
  UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.cut = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word
), firsts AS (
  SELECT near.word, min(other) AS other FROM near JOIN best ON best.word = near.word AND best.m = near.m GROUP BY near.word
), judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN f.other END AS form,
         CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN firsts f ON f.word = w.word
), ways(word, place) AS (
  SELECT word, word FROM judged
  UNION ALL
  SELECT ways.word, judged.form FROM ways JOIN judged ON judged.word = ways.place WHERE judged.form IS NOT NULL
), roots AS (
  SELECT ways.word, ways.place AS root FROM ways JOIN judged ON judged.word = ways.place WHERE judged.form IS NULL
)
SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN roots ON roots.word = judged.word
"""

#: Words as the operators take them; a shingle's words are joined by a space, which no word holds.
JACCARD = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS shingle
  FROM texts WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM met JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 85 * (s.n + t.n - common)
), ways AS (
  SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links
), reached(doc_id, place) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.place
), components AS (
  SELECT doc_id, min(place) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN components c ON c.doc_id = d.doc_id
"""

REPEATS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, doc_id, i, array_to_string(w[i : i + 49], ' ') AS span
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50)
), first_of AS (
  SELECT span, min(doc_id) AS least FROM windows GROUP BY span
), repeats AS (
  SELECT rid, i FROM windows JOIN first_of USING (span) WHERE least < doc_id
), placed AS (
  SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts WHERE len(w) > 0
), judged AS (
  SELECT p.rid, p.i, p.word, coalesce(max(r.i) OVER (PARTITION BY p.rid ORDER BY p.i) >= p.i - 49, false) AS gone
  FROM placed p LEFT JOIN repeats r ON r.rid = p.rid AND r.i = p.i
), kept AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS plain FROM judged GROUP BY rid
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(plain, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""

NEAR_VECTORS = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reached(vec_id, place) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reached.vec_id, links.y FROM reached JOIN links ON links.x = reached.place
), components AS (
  SELECT vec_id, min(place) AS component_id FROM reached GROUP BY vec_id
), counts AS (
  SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN counts ON counts.vec_id = e.vec_id LEFT JOIN components ON components.vec_id = e.vec_id
"""
