"""SQL, for DuckDB, of the queries of this subpackage that SQL can express."""

#: CRC-32 of a text's bytes, one lookup a byte.
CRC = """bits(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
crcs AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
 xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM documents, crcs)"""

SHARDING = f"""WITH RECURSIVE {CRC},
nodes(parent, path, weight, shard) AS (SELECT '', '/region' || i, 4.0, NULL FROM range(2) t(i) UNION ALL SELECT '', '/region of shard8', 1.0, 8
 UNION ALL SELECT '/region' || (i // 2), '/region' || (i // 2) || '/rack' || i, 2.0, NULL FROM range(4) t(i)
 UNION ALL SELECT '/region' || (i // 4) || '/rack' || (i // 2), '/region' || (i // 4) || '/rack' || (i // 2) || '/shard' || i, 1.0, i FROM range(8) t(i)),
draws AS (SELECT r, parent, path, shard, -ln((('0x' || substr(md5(path || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|'), 1, 13))::BIGINT + 0.5) * pow(2.0::DOUBLE, -52)) / weight AS draw FROM docs, nodes),
regions AS (SELECT r, arg_min(path, draw) AS old, min(draw) AS least FROM draws WHERE parent = '' AND shard IS NULL GROUP BY r),
fresh AS (SELECT r, draw FROM draws WHERE parent = '' AND shard IS NOT NULL),
racks AS (SELECT d.r, arg_min(d.path, d.draw) AS rack FROM draws d JOIN regions g ON g.r = d.r AND g.old = d.parent GROUP BY d.r),
found AS (SELECT d.r, arg_min(d.shard, d.draw) AS shard FROM draws d JOIN racks k ON k.r = d.r AND k.rack = d.parent GROUP BY d.r)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot,
 CAST(CASE WHEN n.draw < g.least THEN 8 ELSE shard END AS INT) AS grown_shard FROM docs JOIN found USING (r) JOIN regions g USING (r) JOIN fresh n USING (r)"""

MIXING = r"""WITH RECURSIVE docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|'), 1, 15))::BIGINT AS mix FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM sums),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS words, sum(weight) AS weight FROM weighed),
rounds(k, words, weight) AS (SELECT 0, words, weight FROM total UNION ALL
 SELECT k + 1, (SELECT words FROM total) - coalesce((SELECT sum(3.0 * source_size) FROM weighed w WHERE r.words * w.weight / r.weight > 3.0 * source_size), 0),
  coalesce((SELECT sum(w.weight) FROM weighed w WHERE NOT r.words * w.weight / r.weight > 3.0 * source_size), r.weight) FROM rounds r WHERE k < 20),
goals AS (SELECT source, source_size, CAST(CASE WHEN r.words * w.weight / r.weight > 3.0 * source_size THEN 3.0 * source_size ELSE r.words * w.weight / r.weight END AS DOUBLE) AS target FROM weighed w, rounds r WHERE k = 20),
placed AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size, mix, doc_id NULLS LAST) - 1 AS nth,
 ('0x' || substr(md5('7|offset|' || coalesce(d.source, '') || '|'), 1, 13))::BIGINT * pow(2.0::DOUBLE, -52) AS start FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST((floor((nth + 1) * rate + start) - floor(nth * rate + start)) * size AS BIGINT) AS taken FROM placed"""

#: All pairs of documents with a common shingle, and their components.
NEAR = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
often AS (SELECT doc_id, h, n FROM (SELECT doc_id, hash(s) AS h, count(*) OVER (PARTITION BY s) AS docs FROM shingles) JOIN sizes USING (doc_id) WHERE docs > 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n, any_value(a.n + b.n) AS total FROM often a JOIN often b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
near AS (SELECT x, y FROM shared WHERE 100 * n >= 80 * (total - n)), links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id"""

CHAT = r"""WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (SELECT *, '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS chunk FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256, CAST(sum(length(chunk)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""

VECTORS = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links, c.component_id, c.component_id = v.vec_id AS kept FROM embeddings v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = v.vec_id"""
