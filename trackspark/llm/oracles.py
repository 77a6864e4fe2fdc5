"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import COVERAGE, NOTICES, PHRASES, SLACK

ORACLES: dict[str, str] = {}

MIX_SIZES = r"""
sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM {docs}),
named AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM sizes GROUP BY source),
capped AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM named),
steps AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM capped),
targets AS (SELECT source, kind, source_size, least(cap, weight * max(step) OVER ()) AS target FROM steps),
placed AS (
  SELECT s.*, t.kind, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(least(floor(target)::BIGINT - off, size), 0) AS t1, greatest(least(floor(target)::BIGINT - off - source_size, size), 0) AS t2 FROM placed),
shared AS (SELECT *, (off + t1 / 2.0::DOUBLE) / target AS y FROM taken),
-- 7, 5, 3 and 0.5, 1, 1.5 at times 0, 1/2, 1; the flat schedule's position is its share.
timed AS (
  SELECT *, CASE kind
    WHEN 0 THEN CASE WHEN y * 5.0 <= 3.0 THEN 2.0 * (y * 5.0) / (7.0 + sqrt(greatest(49.0 - 8.0 * (y * 5.0), 0.0)))
                     ELSE 0.5 + 2.0 * (y * 5.0 - 3.0) / (5.0 + sqrt(greatest(25.0 - 8.0 * (y * 5.0 - 3.0), 0.0))) END
    WHEN 1 THEN CASE WHEN y * 2.0 <= 1.0 THEN 2.0 * (y * 2.0) / (2.0 + sqrt(4.0)) ELSE 0.5 + 2.0 * (y * 2.0 - 1.0) / (2.0 + sqrt(4.0)) END
    ELSE CASE WHEN y * 1.0 <= 0.375 THEN 2.0 * (y * 1.0) / (0.5 + sqrt(greatest(0.25 + 2.0 * (y * 1.0), 0.0)))
              ELSE 0.5 + 2.0 * (y * 1.0 - 0.375) / (1.0 + sqrt(greatest(1.0 + 2.0 * (y * 1.0 - 0.375), 0.0))) END END AS pos
  FROM shared)
"""

ORACLES["op7_curriculum_mix"] = f"""
WITH {MIX_SIZES.format(docs='documents')}
SELECT doc_id, size, source_size, target, (t1 + t2)::BIGINT AS taken, CASE WHEN t1 > 0 THEN pos::DOUBLE END AS position_1 FROM timed
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {i < len(PHRASES)}, '{text}')" for i, (label, text) in enumerate([*PHRASES, *NOTICES]))

ORACLES["op10_license_scan"] = rf"""
WITH named(template, label, is_phrase, words) AS (SELECT a, b, c, string_split(d, ' ') FROM (VALUES {_TEMPLATES}) v(a, b, c, d)),
template AS (SELECT template, label, is_phrase, len(words) - 1 AS n_grams, unnest(range(len(words) - 1)) AS t_pos, words FROM named),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
grams AS (SELECT r, words, unnest(range(len(words) - 1)) AS pos FROM texts WHERE len(words) > 1),
votes AS (
  SELECT r, template, label, is_phrase, n_grams, pos - t_pos AS diagonal, t_pos
  FROM grams g JOIN template t ON g.words[pos + 1] = t.words[t_pos + 1] AND g.words[pos + 2] = t.words[t_pos + 2]),
diagonals AS (SELECT DISTINCT r, template, is_phrase, diagonal FROM votes),
marked AS (
  SELECT *, CASE WHEN is_phrase OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {SLACK}, true) THEN 1 ELSE 0 END AS apart FROM diagonals),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (
  SELECT r, template, label, v.is_phrase, n_grams, span, min(diagonal) AS start, count(DISTINCT t_pos) / n_grams::DOUBLE AS share
  FROM votes v JOIN grouped g USING (r, template, diagonal) GROUP BY r, template, label, v.is_phrase, n_grams, span),
found AS (
  SELECT r, count(*) FILTER (is_phrase AND share = 1) AS n_base, min(start) FILTER (is_phrase AND share = 1) AS first_word, max(start) FILTER (is_phrase AND share = 1) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_phrase AND share = 1) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN is_phrase THEN share = 1 ELSE share >= {COVERAGE} END) AS labels, max(share) AS score
  FROM spans GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM texts LEFT JOIN found USING (r)
"""

ORACLES["op8_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(!*)\|', '<!\1|', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLES["op2_warc_segments"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN firsts USING (payload_digest)
"""

ORACLES["op5_superminhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1:i + 5], ' ')) AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept
FROM (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLES["op6_block_max_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, w, count(*)::DOUBLE AS n FROM words GROUP BY doc_id, w),
lengths AS (SELECT doc_id, sum(n) AS len FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::DOUBLE AS n_docs, (SELECT sum(len) FROM lengths) / count(*) AS mean FROM documents WHERE doc_id IS NOT NULL),
idf AS (SELECT w, ln(1 + ((SELECT n_docs FROM total) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY w),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * len / (SELECT mean FROM total)))), 9) AS score
  FROM tf q JOIN tf d ON q.w = d.w AND q.doc_id <> d.doc_id JOIN idf ON idf.w = q.w JOIN lengths ON lengths.doc_id = d.doc_id
  WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES["op11_slot_negatives"] = """
WITH vectors AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER nearest)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW nearest AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER nearest <= 10
"""

ORACLES["op12_geometric_ranking"] = r"""
WITH coded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
notes AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM coded WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM notes),
postings AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM notes) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark GROUP BY item_id)
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY item_id, doc_id, r)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER best <= 10
"""
