"""DuckDB SQL for the queries that SQL can express, by plain rules instead of the methods of the operators."""

ORACLE: dict[str, str] = {}


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_folded(column)}, '{pattern}')"


_BLANK_SEPARATED = r"[^\x20\x09-\x0D]+"
_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Classes of equal sets, joined on every shingle they share.
ORACLE["op2_minhash_near_dedup"] = f"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, {_words("text", _BLANK_SEPARATED)} AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(
           CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END)) AS s
  FROM doc_words
), keyed AS (
  SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS k FROM sets
), classes AS (
  SELECT k, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY k
), posted AS (
  SELECT node, n, unnest(s) AS shingle FROM classes
), linked AS (
  SELECT x.node AS a, y.node AS b
  FROM posted x JOIN posted y
    ON x.shingle = y.shingle AND x.node < y.node AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.node, y.node, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), edges AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reached AS (
  SELECT node, node AS low FROM classes
  UNION
  SELECT e.b, r.low FROM reached r JOIN edges e ON e.a = r.node WHERE r.low < e.b
), least_of AS (
  SELECT node, min(low) AS low FROM reached GROUP BY node
)
SELECT doc_id, d.n::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept
FROM keyed d LEFT JOIN classes c ON d.k = c.k AND d.n > 0 LEFT JOIN least_of l ON l.node = c.node
"""

# All windows of all documents, in every length that windows of items have.
ORACLE["op4_benchmark_decontamination"] = f"""
WITH doc_words AS (
  SELECT doc_id, row_number() OVER () AS d, {_words("text", _ALPHANUMERIC)} AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, {_words("text", _ALPHANUMERIC)} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS win
  FROM (SELECT item, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT d, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest([array_to_string(w[j:j + n - 1], ' ') FOR j IN range(1, len(w) - n + 2)]) AS win
  FROM doc_words, lengths WHERE len(w) >= n
), found AS (
  SELECT d, i, n, item FROM doc_windows JOIN item_windows USING (n, win)
), hits AS (
  SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS p FROM found) GROUP BY d
), held AS (
  SELECT d, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM found GROUP BY d
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (d) LEFT JOIN held USING (d)
"""

# Every rule on every URL.
ORACLE["op7_url_filters"] = rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, {_folded("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(rest, '^[^/?#]*', '') AS tail
  FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting AS (
  SELECT page_id, max(struct_pack(size := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := verdict)) AS best
  FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, best.rule AS rule,
       CASE WHEN best IS NOT NULL THEN best.verdict
            WHEN regexp_matches(host || tail, '(^|\.)ads?\d*\.[^/]*') OR regexp_matches(host || tail, '[?&]utm_source=ads?(&|$)')
              OR regexp_matches(host || tail, '/(login|signin|logout)([/?]|$)')
              OR regexp_matches(host || tail, '/cart/checkout([/?]|$)')
              OR regexp_matches(host || tail, '\.(exe|zip|iso|apk)([?]|$)') OR regexp_matches(host || tail, '^[^/]*casino[^/]*/')
            THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fitting USING (page_id)
"""

# Checksums byte by byte, and words one edit apart by what is left when a letter goes or is masked.
ORACLE["op12_spelling_variants"] = r"""
WITH RECURSIVE folded AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT row_number() OVER () AS id, doc, run, count(*) AS times FROM folded GROUP BY doc, run
), table_steps AS (
  SELECT k, k::BIGINT AS v, 0 AS step FROM range(256) t(k)
  UNION ALL
  SELECT k, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), step + 1 FROM table_steps WHERE step < 8
), crc_table AS (
  SELECT k::BIGINT AS k, v FROM table_steps WHERE step = 8
), coded AS (
  SELECT id, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
                           ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END
                      FOR c IN string_split(doc || ':' || run, '')]) AS bytes
  FROM runs
), crc_steps AS (
  SELECT id, bytes, 0 AS place, 4294967295::BIGINT AS crc FROM coded
  UNION ALL
  SELECT id, bytes, place + 1, xor(v, crc >> 8)
  FROM crc_steps JOIN crc_table ON k = xor(crc, bytes[place + 1]) & 255 WHERE place < len(bytes)
), checksums AS (
  SELECT id, xor(crc, 4294967295) AS h FROM crc_steps WHERE place = len(bytes)
), changed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
              ELSE run END AS word, times
  FROM runs JOIN checksums USING (id)
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), less_one AS (
  SELECT DISTINCT word, n, unnest([substr(word, 1, i - 1) || substr(word, i + 1) FOR i IN range(1, length(word) + 1)]) AS rest
  FROM words
), masked AS (
  SELECT word, n, unnest([substr(word, 1, i - 1) || '*' || substr(word, i + 1) FOR i IN range(1, length(word) + 1)]) AS rest
  FROM words
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less_one a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM less_one a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near
  FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), formed AS (
  SELECT w.word, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS place FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON c.place = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.place AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed last ON last.word = c.place AND last.form IS NULL
"""
