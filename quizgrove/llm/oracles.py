"""DuckDB SQL for the corpus queries that SQL can express."""

CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = rf"""
WITH cut AS (
  SELECT doc_id, text, unnest(regexp_extract_all(text, '(?s).*?(?:[.!?][\x20\x09-\x0D]+|\n|$)')) AS whole,
    generate_subscripts(regexp_extract_all(text, '(?s).*?(?:[.!?][\x20\x09-\x0D]+|\n|$)'), 1) AS i
  FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, text, i, regexp_extract_all(translate(whole, {CAPITALS}), '[^\x20\x09-\x0D]+') AS words,
    coalesce(sum(length(whole)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM cut
), unit AS (
  SELECT doc_id, start, len(words) AS n, array_to_string(words, ' ') AS form, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j,
    coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY i), length(text)) AS stop, lead(len(words)) OVER (PARTITION BY doc_id ORDER BY i) AS next_n,
    lead(array_to_string(words, ' ')) OVER (PARTITION BY doc_id ORDER BY i) AS next_form
  FROM placed WHERE len(words) > 0
), link AS (
  SELECT doc_id, j, j AS upto, n, n AS words, md5(form) AS digest, false AS pair FROM unit WHERE n >= 30
  UNION ALL SELECT doc_id, j, j + 1, n, n + next_n, md5(form || chr(10) || next_form), true FROM unit WHERE next_form IS NOT NULL
), first AS (
  SELECT pair, digest, min(doc_id) AS first FROM link GROUP BY pair, digest HAVING min(doc_id) < max(doc_id)
), held AS (
  SELECT l.*, again FROM link l JOIN first f USING (pair, digest), (SELECT unnest([true, false]) AS again) WHERE NOT again OR l.doc_id > first
), grouped AS (
  SELECT *, j - row_number() OVER (PARTITION BY doc_id, pair, again ORDER BY j) AS run FROM (SELECT DISTINCT * FROM held)
), run AS (
  SELECT doc_id, again, min(j) AS begin_j, max(upto) AS end_j FROM grouped
  GROUP BY doc_id, again, pair, CASE WHEN pair THEN run ELSE j END
  HAVING sum(n) + CASE WHEN pair THEN arg_max(words - n, j) ELSE 0 END >= 30
), chosen AS (
  SELECT DISTINCT doc_id, again, unnest(range(begin_j, end_j + 1)) AS j FROM run
), mark AS (
  SELECT u.*, g.j IS NOT NULL AS gone, s.j IS NOT NULL AS shared FROM unit u
  LEFT JOIN (SELECT * FROM chosen WHERE again) g ON u.doc_id = g.doc_id AND u.j = g.j
  LEFT JOIN (SELECT * FROM chosen WHERE NOT again) s ON u.doc_id = s.doc_id AND u.j = s.j
), rest AS (
  SELECT m.doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(start || '-' || stop, ',' ORDER BY j) FILTER (WHERE gone) AS removed,
    substr(any_value(text), 1, min(start)::BIGINT) || coalesce(string_agg(substr(text, start::BIGINT + 1, (stop - start)::BIGINT), '' ORDER BY j) FILTER (WHERE NOT gone), '') AS text,
    coalesce(sum(n) FILTER (WHERE gone), 0) AS n_removed_words, coalesce(sum(n) FILTER (WHERE shared), 0) AS n_shared_words
  FROM mark m JOIN documents d ON m.doc_id = d.doc_id GROUP BY m.doc_id
  HAVING count(*) FILTER (WHERE shared) > 0
)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, length(coalesce(r.text, d.text)) AS n_chars,
  sha256(coalesce(r.text, d.text)) AS text_sha256, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words, coalesce(n_shared_words, 0)::BIGINT AS n_shared_words
FROM documents d LEFT JOIN rest r USING (doc_id)
"""

OP4 = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, {CAPITALS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), phrase AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(10, len(w)) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, {CAPITALS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), place AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM phrase) WHERE len(w) >= size)
), hit AS (
  SELECT p.doc_id, p.i, p.size, h.item_id FROM place p JOIN phrase h ON p.phrase = h.phrase
), counts AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(doc.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN doc USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = f"""
WITH line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), bare AS (
  SELECT *, trim(line, {BLANKS}) AS bare FROM line
), common AS (
  SELECT bare FROM bare WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 5
), cut AS (
  SELECT doc_id, count(*) AS n_lines, count(c.bare) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.bare IS NULL), '') AS text
  FROM bare b LEFT JOIN common c ON b.bare = c.bare GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(c.text) AS n_chars, sha256(c.text) AS text_sha256
FROM documents d LEFT JOIN cut c USING (doc_id)
"""

OP7 = rf"""
WITH part AS (
  SELECT page_id, lower(url) AS url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {CAPITALS}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM part
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL OR url IS NULL THEN 'allow'
  WHEN regexp_matches(url, '(?s)[^a-z0-9](utm_source|sessionid|login|cart|tag|print|ref[^a-z0-9]x|feed[^a-z0-9].*[^a-z0-9]xml)([^a-z0-9]|$)')
    OR regexp_matches(url, '(?s)[^a-z0-9]casino') OR regexp_matches(url, '(?s)\.pdf([^a-z0-9]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""

OP8 = """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages
), first AS (
  SELECT digest, min(page_id) AS first FROM page WHERE size >= 100 GROUP BY digest HAVING count(*) > 1
)
SELECT page_id, size AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM page p LEFT JOIN first f ON p.digest = f.digest
"""

OP9 = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(length(text), 0) AS chars,
    md5(coalesce(text, '')) AS tie,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/mix-1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), drawn AS (
  SELECT *, -ln(u) / (1::DOUBLE / (1::DOUBLE + abs(chars::DOUBLE / greatest(size, 1)::DOUBLE - 1::DOUBLE - 5::DOUBLE) / 5::DOUBLE)) AS key FROM doc
), source AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM drawn GROUP BY source
), weighted AS (
  SELECT *, 3 * source_size AS most, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM source
), filling AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS turn FROM weighted
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM filling) - coalesce(sum(most) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM filling
), target AS (
  SELECT source, source_size, ceil(docs / 4096)::BIGINT AS buckets,
    least(most::DOUBLE, weight * (SELECT arg_min(level, turn) FROM levels WHERE level * weight <= most)) AS target
  FROM levels
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS budget
  FROM target
), run AS (
  SELECT d.doc_id, d.size, d.tie, d.key, b.*, least(buckets - 1, floor(buckets * (1 - exp(-key)))::BIGINT) AS bucket,
    sum(d.size) OVER (PARTITION BY b.source ORDER BY key, doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM drawn d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
), ends AS (
  SELECT *, min(CASE WHEN upto > budget THEN bucket END) OVER (PARTITION BY source) AS last,
    budget - coalesce(max(CASE WHEN upto <= budget THEN upto END) OVER (PARTITION BY source), 0) AS rest
  FROM run
), closing AS (
  SELECT *, CASE WHEN size > 0 AND upto > budget AND bucket = last AND abs(size - rest) < rest
    THEN row_number() OVER (PARTITION BY source, size > 0 AND upto > budget AND bucket = last AND abs(size - rest) < rest
      ORDER BY abs(size - rest), key, doc_id NULLS FIRST, tie) = 1 ELSE false END AS one_more
  FROM ends
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND (upto <= budget OR one_more) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM closing
"""

OP11 = rf"""
WITH document AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, {CAPITALS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), held AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM document) GROUP BY d, term
), size AS (
  SELECT d, doc_id, len(w) AS n FROM document WHERE len(w) > 0
), total AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size
), item AS (
  SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), asked AS (
  SELECT i, term, count(*) AS repeats
  FROM (SELECT i, unnest(regexp_extract_all(translate(text, {CAPITALS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM item)
  GROUP BY i, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total
), scored AS (
  SELECT i, s.d, any_value(doc_id) AS doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked a JOIN weight USING (term) JOIN held h USING (term) JOIN size s ON h.d = s.d, total
  GROUP BY i, s.d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed JOIN item USING (i) WHERE rank <= 10
"""


def clustering(count: int = 16, rounds: int = 3) -> str:
    """Each round as two tables: the nearest centroid of every vector, and the centroids after it."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS seed
  FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
  )
)""",
        f"c0 AS MATERIALIZED (SELECT seed AS cluster, v AS c FROM kept WHERE seed < {count})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT * FROM (
    SELECT vec_id, seed, v, cluster, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS distance
    FROM kept, c{i}
  ) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, cluster) = 1
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, list(mean ORDER BY place) AS c FROM (
    SELECT cluster, place, floor(sum(x) / count(*)) AS mean
    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY cluster, place
  ) GROUP BY cluster
  UNION ALL SELECT cluster, c FROM c{i} WHERE cluster NOT IN (SELECT cluster FROM a{i})
)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
  sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


ORACLE = {
    "op3_substring_dedup": OP3,
    "op4_decontamination": OP4,
    "op5_line_spread": OP5,
    "op7_url_rules": OP7,
    "op8_warc": OP8,
    "op9_mixing": OP9,
    "op11_ranked_search": OP11,
    "op12_centroids": clustering(),
}
