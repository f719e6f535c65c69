"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op7_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

# matches and the texts between them, numbered; a match starts where the lengths of both, up to it, end
ORACLE["op1_secret_scan"] = r"""
WITH rules(rank, kind, pattern, must) AS (VALUES
  (0, 'assign',
   '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+',
   '^(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{12,}$'),
  (1, 'access', 'AKIA[A-Z0-9]+', '^.{18,}$'),
  (2, 'hex', '[0-9a-f]+', '^.{16,}$'),
  (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', '.'),
  (4, 'forge', 'gh[pousr]_[A-Za-z0-9]+', '^.{40,}$'),
  (5, 'chat', 'xox[abprs]-[A-Za-z0-9-]+', '^.{15,}$'),
  (6, 'jwt', 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '^.{40,}$'),
  (7, 'url_login', '[a-z]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@', '.')
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  SELECT rid, rank, kind, must, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS g FROM d CROSS JOIN rules
), each AS (
  SELECT rid, rank, kind, must, unnest(m) AS said, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0
), placed AS (
  SELECT rid, rank, kind, must, said,
    (sum(length(gap) + length(said)) OVER (PARTITION BY rid, rank ORDER BY i))::BIGINT AS e
  FROM each
), spans AS (
  SELECT rid, rank, e - length(said) AS s, kind || ':' || (e - length(said)) || ':' || e AS span FROM placed WHERE regexp_matches(said, must)
), listed AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)
"""

ORACLE["op3_source_mixing"] = r"""
WITH r AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie, row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS copy, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM r GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, (sum(source_size) OVER ())::BIGINT AS words FROM s0
), s2 AS (
  SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM s1
), s3 AS (
  SELECT *,
    coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
    (sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left
  FROM s2
), s4 AS (
  SELECT *, (1.5::DOUBLE * words - cap_before) / weight_left AS level FROM s3
), s5 AS (
  SELECT *, first(level) OVER (ORDER BY level * weight > 2 * source_size, cap_before, level ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_level,
    bool_or(level * weight <= 2 * source_size) OVER () AS any_free
  FROM s4
), s6 AS (
  SELECT *, CASE WHEN any_free AND first_level * weight <= 2 * source_size THEN first_level * weight ELSE (2 * source_size)::DOUBLE END AS target,
    floor(1.5::DOUBLE * words / 64 + 0.5)::BIGINT AS house, ceil(source_docs / 1024)::BIGINT AS n_shards
  FROM s5
), s7 AS (
  SELECT *, floor(target / 64 + 0.5)::BIGINT AS b FROM s6
), s8 AS (
  SELECT *, house - (sum(b) OVER ())::BIGINT AS need, row_number() OVER (ORDER BY target / (b + 0.5::DOUBLE) DESC, rank) AS up,
    row_number() OVER (ORDER BY CASE WHEN b > 0 THEN target / (b - 0.5::DOUBLE) END NULLS LAST, rank) AS down
  FROM s7
), sources AS (
  SELECT source, rank, source_size, target, n_shards, b + (up <= need)::BIGINT - (down <= -need AND b > 0)::BIGINT AS seats FROM s8
), dealt AS (
  SELECT r.doc_id, r.tie, r.copy, r.size, s.rank, s.source_size, s.target, s.seats,
    ('0x' || substr(md5(concat_ws('|', '0', 'shard', coalesce(r.doc_id::VARCHAR, '~'), r.tie, r.copy::VARCHAR)), 1, 13))::BIGINT % s.n_shards AS shard,
    ('0x' || substr(md5(concat_ws('|', '0', 'order', coalesce(r.doc_id::VARCHAR, '~'), r.tie, r.copy::VARCHAR)), 1, 13))::BIGINT AS place
  FROM r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
), lined AS (
  SELECT *, (sum(size) OVER (PARTITION BY rank, shard ORDER BY place, doc_id NULLS FIRST, tie, copy ROWS UNBOUNDED PRECEDING))::BIGINT AS fin FROM dealt
), h0 AS (
  SELECT rank, shard, seats, source_size, target, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY ALL
), h1 AS (
  SELECT *, target * shard_size / greatest(source_size, 1) AS part FROM h0
), h2 AS (
  SELECT *, floor(part / 64 + 0.5)::BIGINT AS b FROM h1
), h3 AS (
  SELECT *, seats - (sum(b) OVER (PARTITION BY rank))::BIGINT AS need,
    row_number() OVER (PARTITION BY rank ORDER BY part / (b + 0.5::DOUBLE) DESC, shard) AS up,
    row_number() OVER (PARTITION BY rank ORDER BY CASE WHEN b > 0 THEN part / (b - 0.5::DOUBLE) END NULLS LAST, shard) AS down
  FROM h2
), h4 AS (
  SELECT rank, shard, greatest(ceil(shard_size / 64)::BIGINT, 1) AS n_blocks, b + (up <= need)::BIGINT - (down <= -need AND b > 0)::BIGINT AS seats FROM h3
), h5 AS (
  SELECT rank, shard, n_blocks, greatest(least(seats, n_blocks * 2), 0) AS quota FROM h4
), shards AS (
  SELECT rank, shard, quota // n_blocks AS rounds, quota % n_blocks * 64 AS run, n_blocks * 64 AS ring,
    ('0x' || substr(md5(concat_ws('|', '0', 'start', rank::VARCHAR, shard::VARCHAR)), 1, 13))::BIGINT % n_blocks * 64 AS run_from
  FROM h5
)
SELECT doc_id, size, source_size, target,
  (rounds * size + greatest(least(run_from + run, ring, fin) - greatest(run_from, fin - size), 0)
   + greatest(least(run_from + run - ring, fin) - (fin - size), 0))::BIGINT AS taken
FROM lined JOIN shards USING (rank, shard)
"""

# a rule fits by the ends of host and path; a listed URL is one whose canonical form a page has that reserves its rights
ORACLE["op11_url_filter"] = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')), p AS (
  SELECT row_number() OVER () AS rid, page_id, html, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^(?s:.*)@', ''), '\.*(:(80|443)?)?\z', ''), '^www\.', '') AS site,
    list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_|(ref|referrer|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid|session_?id)\z)'))) AS said
  FROM p
), k AS (
  SELECT *, CASE WHEN site <> '' THEN site || regexp_replace(path, '/+\z', '') || CASE WHEN len(said) > 0 THEN '?' || array_to_string(said, '&') ELSE '' END END AS own FROM c
), listed AS (
  SELECT DISTINCT own FROM k WHERE contains(lower(html), 'all rights reserved') AND own IS NOT NULL
), fits AS (
  SELECT rid, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(f.verdict, CASE WHEN own IN (SELECT own FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (rid)
"""

# every term of the language for every source, 0 counts too, and then all pairs term by term
ORACLE["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), each AS (
  SELECT rid, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n_lang FROM each GROUP BY ALL HAVING count(DISTINCT rid) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(total_lang, 0) AS total_lang
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)
), priced AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (n_lang + 5) // (total_lang + 5 * v))::BIGINT AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(sum(abs(a.p - b.p)), 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN priced a ON a.lang = g.lang AND a.source = g.source LEFT JOIN priced b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
  GROUP BY ALL
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 50
"""

ORACLE["op13_filter_interactions"] = r"""
WITH letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
), r AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM r
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(doc_id > least, false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)
), alike AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM d GROUP BY ALL
), steps AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS f, left(filter_order, step - 1) AS earlier FROM orders, range(1, 6) s(step)
), told AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, contains(fails, f) AS failing, length(translate(fails, earlier, '')) < length(fails) AS gone, fails = f AS alone FROM alike, steps
), found AS (
  SELECT part, filter_order, step, any_value(f) AS f,
    coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM told GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM found
"""
