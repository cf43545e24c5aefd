"""The same results in DuckDB's SQL, where SQL can express an operator."""

ORACLE: dict[str, str] = {}

ORACLE["op11_merkle_manifest"] = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS remainders
), drawn AS (
  SELECT *, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), 4294967295::BIGINT) & 1 = 1 AS even
  FROM documents, steps
), filled AS (
  SELECT doc_id, source, even,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS flat
  FROM drawn
), leaves AS (
  SELECT doc_id, source,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN even THEN sha256(head || coalesce(octet_length(encode(flat)) || ':' || flat, '-')) END AS tampered
  FROM filled
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), trees AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
  FROM trees WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
  FROM trees WHERE len(nodes) = 1
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
  FROM top WHERE len(nodes) > 1
), root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1
), heights AS (SELECT source, max(level) AS height FROM trees GROUP BY source
), ways AS (
  SELECT p.source, p.pos, t.level AS step, p.pos // (3 ** t.level)::BIGINT AS place, t.nodes
  FROM placed p JOIN trees t ON p.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1
  UNION ALL
  SELECT p.source, p.pos, h.height + t.level, s.pos // (3 ** t.level)::BIGINT, t.nodes
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  JOIN heights h ON p.source IS NOT DISTINCT FROM h.source JOIN top t ON len(t.nodes) > 1
), runs AS (
  SELECT source, pos, step,
    array_to_string(nodes[place - place % 3 + 1:place], '') AS earlier,
    array_to_string(nodes[place + 2:place - place % 3 + 3], '') AS later
  FROM ways
), proofs AS (
  SELECT source, pos, sha256(string_agg(earlier || later, '' ORDER BY step)) AS proof_sha256
  FROM runs GROUP BY source, pos
), climbs AS (
  SELECT source, pos, 0 AS step, coalesce(tampered, leaf) AS node FROM placed
  UNION ALL
  SELECT c.source, c.pos, c.step + 1, sha256(r.earlier || c.node || r.later)
  FROM climbs c JOIN runs r ON c.source IS NOT DISTINCT FROM r.source AND c.pos = r.pos AND c.step = r.step
), ends AS (SELECT source, pos, arg_max(node, step) AS folded_root FROM climbs GROUP BY source, pos)
SELECT p.doc_id, p.leaf, s.subroot, root.root, coalesce(w.proof_sha256, sha256('')) AS proof_sha256,
  e.folded_root, e.folded_root = root.root AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
JOIN ends e ON p.source IS NOT DISTINCT FROM e.source AND p.pos = e.pos
LEFT JOIN proofs w ON p.source IS NOT DISTINCT FROM w.source AND p.pos = w.pos, root
"""

ORACLE["op12_fill_in_middle"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents
), numbers AS (
  SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
    ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS prefix,
    array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM cuts
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

ORACLE["op4_decontaminate"] = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS text_no,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[place:place + 9], ' ') AS phrase
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS place FROM items WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), windows AS (
  SELECT text_no, size, place, array_to_string(words[place:place + size - 1], ' ') AS phrase
  FROM (SELECT text_no, words, size, unnest(range(1, len(words) - size + 2)) AS place FROM texts, sizes)
), found AS (
  SELECT w.text_no, w.place, w.size, i.item FROM windows w JOIN item_windows i ON w.size = i.size AND w.phrase = i.phrase
), hits AS (
  SELECT text_no, count(DISTINCT spot) AS n_hit
  FROM (SELECT text_no, unnest(range(place, place + size)) AS spot FROM (SELECT DISTINCT text_no, place, size FROM found)) GROUP BY text_no
), named AS (
  SELECT text_no, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM found WHERE item IS NOT NULL GROUP BY text_no
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hits h ON t.text_no = h.text_no LEFT JOIN named n ON t.text_no = n.text_no
"""

ORACLE["op6_repeated_bytes"] = """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS text_no, hex(encode(coalesce(text, ''))) AS digits FROM documents
), windows AS (
  SELECT text_no, place, md5(substring(digits, 2 * place + 1, 800)) AS body
  FROM (SELECT text_no, digits, unnest(range(len(digits) // 2 - 399)) AS place FROM texts)
), repeated AS (
  SELECT text_no, place FROM (SELECT text_no, place, count(*) OVER (PARTITION BY body) AS n FROM windows) WHERE n > 1
), marked AS (
  SELECT text_no, place, place - lag(place, 1, -1000) OVER (PARTITION BY text_no ORDER BY place) > 400 AS fresh FROM repeated
), numbered AS (
  SELECT text_no, place, sum(fresh::INT) OVER (PARTITION BY text_no ORDER BY place) AS span FROM marked
), spans AS (SELECT text_no, span, min(place) AS first, max(place) + 400 AS past FROM numbered GROUP BY text_no, span
), gaps AS (
  SELECT text_no, lag(past, 1, 0) OVER (PARTITION BY text_no ORDER BY first) AS first, first AS past FROM spans
  UNION ALL SELECT text_no, max(past), NULL FROM spans GROUP BY text_no
), kept AS (
  SELECT g.text_no, string_agg(substring(digits, 2 * first + 1, 2 * (coalesce(past, len(digits) // 2) - first)), '' ORDER BY first) AS digits
  FROM gaps g JOIN texts t ON g.text_no = t.text_no GROUP BY g.text_no
), sums AS (SELECT text_no, sum(past - first)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY text_no
)
SELECT doc_id, len(t.digits) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.digits, t.digits))) AS kept_sha256
FROM texts t LEFT JOIN sums s ON t.text_no = s.text_no LEFT JOIN kept k ON t.text_no = k.text_no
"""

ORACLE["op7_repeated_words"] = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS text_no,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT text_no, doc_id, place, array_to_string(words[place:place + 12], ' ') AS body
  FROM (SELECT text_no, doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM texts)
), seen AS (
  SELECT text_no, place FROM (SELECT text_no, doc_id, place, min(doc_id) OVER (PARTITION BY body) AS low FROM windows)
  WHERE low < doc_id
), covered AS (SELECT DISTINCT text_no, unnest(range(place, place + 13)) AS place FROM seen
), places AS (SELECT text_no, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), kept AS (
  SELECT p.text_no, count(*) AS n, string_agg(word, ' ' ORDER BY p.place) AS text
  FROM places p ANTI JOIN covered c ON p.text_no = c.text_no AND p.place = c.place GROUP BY p.text_no
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.text_no = k.text_no
"""
