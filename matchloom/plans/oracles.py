"""DuckDB SQL of the catalogue's queries, written on its own: no shared expression with the Spark side."""

from __future__ import annotations



def _norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\s+', ' ', 'g'))"


WORD = r"[\p{L}\p{N}\p{M}\p{Co}]+"

PARTS = rf"""
rec AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END || p_partkey AS id, p_name AS bname, p_brand || ' ' || p_type || ' ' || p_size AS baddress, p_type AS country,
  {_norm('p_name')} AS name, {_norm("p_brand || ' ' || p_type || ' ' || p_size")} AS address, {_norm('p_type')} AS cn FROM part),
q AS (SELECT * FROM rec WHERE id LIKE 'S1-%'),
t AS (SELECT * FROM rec WHERE id NOT LIKE 'S1-%'),
truth AS (SELECT min(a.id) AS query, b.id AS target FROM (SELECT 'S1-' || p_partkey AS id, * FROM part WHERE p_partkey % 4 = 0) a
  JOIN (SELECT CASE p_partkey % 4 WHEN 1 THEN 'S2-' ELSE 'S3-' END || p_partkey AS id, * FROM part WHERE p_partkey % 4 <> 0) b USING (p_name, p_brand, p_type) GROUP BY b.id)"""

INDEX = rf"""
fields AS (SELECT id, 'name' AS field, name AS text FROM t UNION ALL SELECT id, 'address', address FROM t),
occ AS (SELECT id, field, unnest(regexp_extract_all(text, '{WORD}')) AS token FROM fields),
post AS (SELECT field, token, id, count(*) AS tf FROM occ GROUP BY ALL),
tfreq AS (SELECT field, token, count(*) AS documents FROM post GROUP BY ALL),
len AS (SELECT id, len(regexp_extract_all(name, '{WORD}')) + len(regexp_extract_all(address, '{WORD}')) AS dl FROM t),
stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
qtext AS (SELECT DISTINCT field, text FROM (SELECT 'name' AS field, name AS text FROM q UNION ALL SELECT 'address', address FROM q) WHERE text <> ''),
qtok AS (SELECT DISTINCT field, text, unnest(regexp_extract_all(text, '{WORD}')) AS token FROM qtext),
terms AS (SELECT * FROM (SELECT field, text, token, documents, row_number() OVER (PARTITION BY field, text ORDER BY documents, token) AS place
  FROM qtok JOIN tfreq USING (field, token), stat WHERE length(token) >= 2 AND documents <= 200) WHERE place <= 4)"""

CHANNELS = """
bm AS (SELECT field, text, id AS target, round(-sum(greatest(CASE WHEN ln((n - documents + 0.5) / (documents + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - documents + 0.5) / (documents + 0.5)) END, 0)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 12) AS score FROM terms JOIN post USING (field, token) JOIN len USING (id), stat GROUP BY field, text, id),
bmtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, text ORDER BY score, target) AS place FROM bm) WHERE place <= 50),
words AS (SELECT q.id AS query, target, field, score FROM q JOIN bmtop ON (field = 'name' AND text = name) OR (field = 'address' AND text = address)),
ename AS (SELECT query, target FROM (SELECT q.id AS query, t.id AS target, row_number() OVER (PARTITION BY q.id ORDER BY t.id) AS k FROM q JOIN t USING (name) WHERE name <> '') WHERE k <= 50),
eaddr AS (SELECT query, target FROM (SELECT q.id AS query, t.id AS target, row_number() OVER (PARTITION BY q.id ORDER BY t.id) AS k FROM q JOIN t USING (address) WHERE address <> '') WHERE k <= 50),
chan AS (SELECT query, target, field || '_words' AS channel FROM words UNION ALL SELECT *, 'exact_name' FROM ename UNION ALL SELECT *, 'exact_address' FROM eaddr),
un AS (SELECT query, target, bool_or(channel = 'exact_name') AS exact_name, bool_or(channel = 'exact_address') AS exact_address, bool_or(channel = 'name_words') AS name_words, bool_or(channel = 'address_words') AS address_words FROM chan GROUP BY ALL)"""


def _lcs(pairs: str) -> str:
    """CTEs ``<pairs>_ratio(a, b, ratio)`` of the distinct pairs in ``pairs``(a, b)."""
    return f"""
{pairs}_d AS (SELECT DISTINCT a, b FROM {pairs}),
{pairs}_ratio AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE 2 * list_last(list_reduce(
    list_concat([list_transform(range(0, length(b)::BIGINT + 1), lambda i: 0::BIGINT)], list_transform(string_split(a, ''), lambda c: [unicode(c)::BIGINT])),
    lambda acc, v: list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, length(b)::BIGINT + 1), lambda j: [j])),
      lambda row, j: list_append(row, greatest(acc[j[1] + 1], row[j[1]], CASE WHEN unicode(b[j[1]]) = v[1] THEN acc[j[1]] + 1 ELSE 0 END))))) / (length(a) + length(b))::DOUBLE END AS ratio FROM {pairs}_d)"""


SCORED = f"""
np AS (SELECT q.name AS a, t.name AS b FROM un JOIN q ON q.id = query JOIN t ON t.id = target),
ap AS (SELECT q.address AS a, t.address AS b FROM un JOIN q ON q.id = query JOIN t ON t.id = target),{_lcs('np')},{_lcs('ap')},
sc AS (SELECT un.*, CASE WHEN q.name = '' OR t.name = '' THEN 0 ELSE nr.ratio END AS n, CASE WHEN q.address = '' OR t.address = '' THEN 0 ELSE ar.ratio END AS a
  FROM un JOIN q ON q.id = query JOIN t ON t.id = target JOIN np_ratio nr ON nr.a = q.name AND nr.b = t.name JOIN ap_ratio ar ON ar.a = q.address AND ar.b = t.address),
vs AS (SELECT 'name_only' AS variant, round(n, 12) AS score, * FROM sc WHERE exact_name OR name_words UNION ALL
  SELECT 'exact_name_address', round(greatest(n, a) + 0.1 * least(n, a), 12), * FROM sc WHERE exact_name OR exact_address UNION ALL
  SELECT 'hybrid', round(greatest(n, a) + 0.1 * least(n, a), 12), * FROM sc),
var AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, query ORDER BY score DESC, target) AS rank FROM vs) WHERE rank <= 100)"""

FULL = f"WITH {PARTS},{INDEX},{CHANNELS},{SCORED}"

ORDERS = """
ol AS (SELECT 'S1-' || o_custkey AS query, CASE o_orderkey % 2 WHEN 0 THEN 'S2-' ELSE 'S3-' END || o_orderkey AS target, left(o_orderpriority, 1) AS priority, o_orderstatus AS status FROM orders),
k AS (SELECT 'S1-' || c_custkey AS query, c_mktsegment AS country FROM customer),
tr AS (SELECT query, target FROM ol WHERE priority = '1' AND status = 'F'),
pr AS (SELECT query, target FROM ol WHERE priority = '1' AND status <> 'P'),
ca AS (SELECT query, target FROM ol WHERE priority = '1' OR (priority = '2' AND status <> 'O'))"""


def _per_query(chosen: str, truth: str = "tr", keys: str = "k") -> str:
    return f"""
pq AS (SELECT k.*, (SELECT count(*) FROM {truth} x WHERE x.query = k.query) AS n_truth, (SELECT count(*) FROM {chosen} x WHERE x.query = k.query) AS n_chosen,
  (SELECT count(*) FROM {truth} x JOIN {chosen} y USING (query, target) WHERE x.query = k.query) AS tp FROM {keys} k),
pf AS (SELECT *, CASE WHEN n_truth = 0 THEN (n_chosen = 0)::INT::DOUBLE ELSE 5 * tp / (5 * tp + 4 * (n_chosen - tp) + n_truth - tp)::DOUBLE END AS f05,
  CASE WHEN n_truth = 0 THEN 1.0 ELSE 5 * tp / (5 * tp + n_truth - tp)::DOUBLE END AS best FROM pq)"""


def _lists(links: str) -> str:
    return f"(SELECT k.query AS source1_entity_id, coalesce(string_agg(target, ',' ORDER BY target), '') AS matched_entity_ids FROM k LEFT JOIN (SELECT DISTINCT query, target FROM {links}) l USING (query) GROUP BY k.query)"


MACRO = """count(*) AS entities, round(avg(f05), 6) AS macro_f05, sum(tp)::BIGINT AS tp, sum(n_chosen - tp)::BIGINT AS fp, sum(n_truth - tp)::BIGINT AS fn, count(*) FILTER (n_truth = 0) AS singletons,
  count(*) FILTER (n_truth = 0 AND n_chosen = 0) AS correct_empty, round(sum(tp) / nullif(sum(n_chosen), 0)::DOUBLE, 6) AS precision, round(sum(tp) / nullif(sum(n_truth), 0)::DOUBLE, 6) AS recall,
  count(*) FILTER (n_truth = 0 AND n_chosen > 0) AS false_merges, round(count(*) FILTER (n_truth = 0 AND n_chosen = 0) / nullif(count(*) FILTER (n_truth = 0), 0)::DOUBLE, 6) AS singleton_accuracy"""

SUMMARY = """count(*) AS queries, sum(n_truth)::BIGINT AS true_links, sum(tp)::BIGINT AS recovered_true_links, round(sum(tp) / nullif(sum(n_truth), 0)::DOUBLE, 6) AS pair_recall,
  count(*) FILTER (n_truth > 0 AND tp = n_truth) AS positive_queries_all_links_retrieved, count(*) FILTER (n_truth > 0) AS positive_queries, count(*) FILTER (n_truth = 0) AS no_match_queries,
  sum(n_chosen)::BIGINT AS total_candidates, count(*) FILTER (n_chosen = 0) AS empty_queries, round(avg(n_chosen), 6) AS mean_candidates, round(quantile_cont(n_chosen::DOUBLE, 0.5), 6) AS p50_candidates,
  round(quantile_cont(n_chosen::DOUBLE, 0.95), 6) AS p95_candidates, round(quantile_cont(n_chosen::DOUBLE, 0.99), 6) AS p99_candidates, max(n_chosen) AS maximum_candidates, round(avg(best), 6) AS oracle_macro_f05"""



def _rank(column: str, seed: int) -> str:
    return f"substr(sha256(concat('{seed}', chr(0), {column})), 1, 32)"


ROLES = f"""
ref AS (SELECT k.query AS id, country, count(target) AS link_count FROM k LEFT JOIN tr USING (query) GROUP BY ALL),
leg AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {_rank('id', 42)}, id) <= round(count(*) OVER () * 0.5) THEN 'validation' ELSE 'train' END AS legacy FROM ref),
rk AS (SELECT *, link_count = 0 AS singleton, {_rank('id', 43)} AS rank FROM leg),
pl AS (SELECT *, row_number() OVER (PARTITION BY legacy, country, singleton ORDER BY rank, id) AS place, count(*) OVER (PARTITION BY legacy, country, singleton) AS n FROM rk),
roles AS (SELECT id AS entity_id, country, singleton, rank, CASE WHEN legacy = 'train' THEN 'train' WHEN place <= CASE WHEN n = 1 THEN 1 ELSE least(n - 1, greatest(1, floor(n * 0.5))) END THEN 'development' ELSE 'evaluation' END AS role FROM pl),
st AS (SELECT role, country, singleton, count(*) AS n, CASE role WHEN 'train' THEN 300 ELSE 100 END AS req FROM roles GROUP BY ALL),
st2 AS (SELECT *, sum(n) OVER (PARTITION BY role) AS total, count(*) OVER (PARTITION BY role) AS strata FROM st),
st3 AS (SELECT *, least(total, req) AS desired, (least(total, req) - strata) * (n - 1) AS spread, total - strata AS capacity FROM st2),
st4 AS (SELECT *, 1 + CASE WHEN capacity > 0 THEN spread // capacity ELSE 0 END AS base, CASE WHEN capacity > 0 THEN spread % capacity ELSE 0 END AS remainder FROM st3),
quota AS (SELECT role, country, singleton, n, base + CASE WHEN row_number() OVER (PARTITION BY role ORDER BY remainder DESC, country, singleton) <= desired - sum(base) OVER (PARTITION BY role) THEN 1 ELSE 0 END AS quota FROM st4)"""


def _grams(src: str, low: int, high: int) -> str:
    return f"""SELECT text, substr(w, i::BIGINT, n::BIGINT) AS gram FROM (SELECT text, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i FROM
  (SELECT text, w, unnest(range({low}, {high} + 1)) AS n FROM (SELECT text, ' ' || unnest(string_split(text, ' ')) || ' ' AS w FROM {src} WHERE text <> '')) WHERE n = {low} OR length(w) >= n)"""


def _tfidf(tag: str, column: str, low: int, high: int, keep: str = "") -> str:
    """CTEs {tag}_idf, {tag}_w (target weights) and {tag}_s (distinct text similarity)."""
    return f"""
{tag}_tt AS (SELECT {column} AS text, count(*) AS docs FROM t GROUP BY 1),
{tag}_n AS (SELECT count(*) AS n FROM t),
{tag}_tc AS (SELECT text, gram, count(*) AS tf FROM ({_grams(f'{tag}_tt', low, high)}) GROUP BY ALL),
{tag}_idf AS (SELECT gram, ln((1 + any_value(n)) / (1 + sum(docs))::DOUBLE) + 1 AS idf FROM {tag}_tc JOIN {tag}_tt USING (text), {tag}_n GROUP BY gram {keep}),
{tag}_tw AS (SELECT text, gram, tf * idf AS w FROM {tag}_tc JOIN {tag}_idf USING (gram)),
{tag}_w AS (SELECT text, gram, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM {tag}_tw),
{tag}_qt AS (SELECT DISTINCT {column} AS text FROM q),
{tag}_qc AS (SELECT text, gram, count(*) AS tf FROM ({_grams(f'{tag}_qt', low, high)}) GROUP BY ALL),
{tag}_qw AS (SELECT text, gram, tf * idf AS w FROM {tag}_qc JOIN {tag}_idf USING (gram)),
{tag}_qu AS (SELECT text, gram, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM {tag}_qw),
{tag}_s AS (SELECT a.text AS q_text, b.text AS t_text, least(sum(a.w * b.w), 1.0) AS score FROM {tag}_qu a JOIN {tag}_w b USING (gram) GROUP BY ALL)"""


VARIANT_LISTS = """
ls AS (SELECT variant, query, target FROM var UNION ALL SELECT 'union', query, target FROM un UNION ALL SELECT channel, query, target FROM chan),
vn AS (SELECT unnest(['name_only', 'exact_name_address', 'hybrid', 'union', 'exact_name', 'exact_address', 'name_words', 'address_words']) AS variant),
wide AS (SELECT variant, id AS query FROM q, vn),
pq AS (SELECT wide.*, coalesce(n_truth, 0) AS n_truth, coalesce(n_chosen, 0) AS n_chosen, coalesce(tp, 0) AS tp FROM wide
  LEFT JOIN (SELECT query, count(*) AS n_truth FROM truth GROUP BY 1) USING (query)
  LEFT JOIN (SELECT variant, query, count(*) AS n_chosen, count(truth.target) AS tp FROM ls LEFT JOIN truth USING (query, target) GROUP BY 1, 2) USING (variant, query)),
pf AS (SELECT *, CASE WHEN n_truth = 0 THEN 1.0 ELSE 5 * tp / (5 * tp + n_truth - tp)::DOUBLE END AS best FROM pq)"""

LINKS = """
tl AS (SELECT truth.query, truth.target, q.bname AS qbn, t.bname AS tbn, q.baddress AS qba, t.baddress AS tba, q.country AS qc, t.country AS tc, q.name AS qn, t.name AS tn, q.address AS qa, t.address AS ta, q.cn AS qcn, t.cn AS tcn,
  v.query IS NOT NULL AS kept, un.query IS NOT NULL AS seen FROM truth JOIN q ON q.id = truth.query JOIN t ON t.id = truth.target
  LEFT JOIN (SELECT query, target FROM var WHERE variant = 'hybrid') v ON v.query = truth.query AND v.target = truth.target LEFT JOIN un ON un.query = truth.query AND un.target = truth.target)"""

NAMES = f"names AS (SELECT DISTINCT {_norm('p_name')} AS a FROM part), nw AS (SELECT DISTINCT a, unnest(regexp_extract_all(a, '{WORD}')) AS word FROM names), nm AS (SELECT DISTINCT x.a, y.a AS b FROM nw x JOIN nw y USING (word))"
SORTED = "list_aggregate(list_sort(string_split({x}, ' ')), 'string_agg', ' ')"

ORACLES: dict[str, str] = {
    "profile_source": f"WITH {PARTS} SELECT count(*) AS records, count(*) FILTER (trim(bname) = '') AS blank_names, count(*) FILTER (trim(baddress) = '') AS blank_addresses, count(*) FILTER (trim(id) = '') AS blank_ids, count(*) FILTER (NOT starts_with(id, 'S1-')) AS unexpected_id_prefix, count(*) FILTER (regexp_matches(bname, '[^\\x00-\\x7F]')) AS non_ascii_names FROM rec",
    "profile_country_counts": "SELECT c_mktsegment AS country, count(*) AS records FROM customer GROUP BY 1",
    "profile_literal_tokens": "WITH r AS (SELECT role AS n, text AS a FROM conversations UNION ALL SELECT lang, text FROM documents), f AS (SELECT 'name' AS field, n AS token FROM r UNION ALL SELECT 'address', a FROM r) SELECT field, token, count(*) AS records FROM f WHERE token IN ('NA', 'N/A', 'NULL', 'null', 'NaN', 'nan', 'None', '<NA>') GROUP BY ALL",
    "profile_truth_distribution": f"WITH {ORDERS}, c AS (SELECT k.query, count(target) AS n FROM k LEFT JOIN tr USING (query) GROUP BY 1) SELECT n AS link_count, count(*) AS records FROM c GROUP BY 1",
    "profile_truth_summary": f"WITH {ORDERS}, c AS (SELECT k.query, count(target) AS n FROM k LEFT JOIN tr USING (query) GROUP BY 1) SELECT count(*) AS records, count(*) FILTER (n = 0) AS zero_matches, sum(n)::BIGINT AS total_true_links, round(avg(n), 6) AS mean_matches, max(n) AS maximum_matches FROM c",
    "id_violations": f"WITH {ORDERS}, i AS (SELECT query AS id FROM tr UNION ALL SELECT target FROM tr) SELECT id, CASE WHEN NOT regexp_full_match(id, 'S1-[^\\s,]+') THEN 'malformed ID' ELSE 'duplicate ID' END AS problem, count(*) AS rows FROM i GROUP BY id HAVING NOT regexp_full_match(id, 'S1-[^\\s,]+') OR count(*) > 1",
    "emit_match_lists": f"WITH {ORDERS} SELECT * FROM {_lists('tr')}",
    "parse_match_lists": f"WITH {ORDERS} SELECT query AS source1_entity_id, target FROM tr JOIN k USING (query)",
    "coverage_gaps": f"WITH {ORDERS} SELECT DISTINCT query, 'missing' AS gap FROM tr WHERE query NOT IN (SELECT query FROM pr) UNION ALL SELECT DISTINCT query, 'extra' FROM pr WHERE query NOT IN (SELECT query FROM tr)",
    "unknown_targets": f"WITH {ORDERS} SELECT query, target FROM ca WHERE target NOT IN (SELECT target FROM pr)",
    "ownership_conflicts": "SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "subset_violations": f"WITH {ORDERS} SELECT query, target FROM tr EXCEPT ALL SELECT query, target FROM pr WHERE target LIKE 'S2-%'",
    "split_source_check": f"WITH {ORDERS}, {ROLES} SELECT id AS entity_id, c_name AS business_name, '' AS business_address, c_mktsegment AS country, 0::BIGINT AS in_part, 1::BIGINT AS in_whole FROM leg JOIN customer ON id = 'S1-' || c_custkey WHERE legacy = 'train'",
    "split_truth_check": f"WITH {ORDERS}, a AS (SELECT *, 1::BIGINT AS x FROM {_lists('tr')}), b AS (SELECT *, 1::BIGINT AS y FROM {_lists('pr')}) SELECT source1_entity_id, matched_entity_ids, coalesce(x, 0) AS in_part, coalesce(y, 0) AS in_whole FROM a FULL JOIN b USING (source1_entity_id, matched_entity_ids) WHERE x IS NULL OR y IS NULL",
    "split_by_disjointness": f"WITH {ORDERS} SELECT query FROM tr INTERSECT SELECT query FROM pr",
    "hash_rank": f"SELECT 'S1-' || c_custkey AS entity_id, {_rank(chr(39) + 'S1-' + chr(39) + ' || c_custkey', 42)} AS rank FROM customer",
    "legacy_split": f"WITH {ORDERS}, {ROLES} SELECT id AS entity_id, legacy FROM leg",
    "assign_roles": f"WITH {ORDERS}, {ROLES} SELECT entity_id, country, singleton, role FROM roles",
    "sample_quotas": f"WITH {ORDERS}, {ROLES} SELECT role, country, singleton, n AS rows, quota::BIGINT AS quota FROM quota",
    "stratified_sample": f"WITH {ORDERS}, {ROLES} SELECT entity_id, role, country, singleton FROM (SELECT *, row_number() OVER (PARTITION BY role, country, singleton ORDER BY rank, entity_id) AS p FROM roles) JOIN quota USING (role, country, singleton) WHERE p <= quota",
    "normalize_text": f"SELECT doc_id, {_norm('text')} AS normalized FROM documents",
    "word_tokens": f"WITH w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all({_norm('text')}, '{WORD}'))) AS x FROM documents) SELECT doc_id, len(x)::BIGINT AS n_tokens, array_to_string(x, ' ') AS tokens FROM w",
    "postings": f"WITH {PARTS},{INDEX} SELECT field, token, id AS entity_id, tf FROM post",
    "term_frequency": f"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_norm('text')}, '{WORD}')) AS token FROM documents) SELECT 'name' AS field, token, count(*) AS documents FROM w GROUP BY 2",
    "index_stats": f"WITH {PARTS},{INDEX} SELECT count(*) AS targets, count(*) FILTER (id LIKE 'S2-%') AS source2, count(*) FILTER (id LIKE 'S3-%') AS source3, sum(dl)::BIGINT AS words, round(avg(dl), 6) AS mean_length, (SELECT count(*) FROM tfreq) AS entries FROM len",
    "rarest_terms": f"WITH {PARTS},{INDEX} SELECT field, text, token, documents, place FROM terms",
    "get_records": f"WITH {PARTS} SELECT id AS entity_id, bname AS business_name, baddress AS business_address, country FROM t WHERE id IN (SELECT target FROM truth)",
    "channel_exact_name": f"WITH {PARTS},{INDEX},{CHANNELS} SELECT * FROM ename",
    "channel_exact_address": f"WITH {PARTS},{INDEX},{CHANNELS} SELECT * FROM eaddr",
    "channel_name_words": f"WITH {PARTS},{INDEX},{CHANNELS} SELECT query, target, round(score, 6) AS score FROM words WHERE field = 'name'",
    "channel_address_words": f"WITH {PARTS},{INDEX},{CHANNELS} SELECT query, target, round(score, 6) AS score FROM words WHERE field = 'address'",
    "channel_union": f"WITH {PARTS},{INDEX},{CHANNELS} SELECT * FROM un",
    "retrieve_variants": f"{FULL} SELECT variant, query, target, rank, round(score, 6) AS score FROM var",
    "retrieval_trace": f"{FULL} SELECT query AS source1_entity_id, target AS target_entity_id, rank, round(score, 6) AS retrieval_score, concat_ws(',', CASE WHEN exact_name THEN 'exact_name' END, CASE WHEN exact_address THEN 'exact_address' END, CASE WHEN name_words THEN 'name_words' END, CASE WHEN address_words THEN 'address_words' END) AS channels FROM var WHERE variant = 'hybrid'",
    "indel_ratio": f"WITH {NAMES},{_lcs('nm')} SELECT a, b, round(ratio, 6) AS ratio FROM nm_ratio",
    "indel_ratio_builtin": f"WITH {NAMES},{_lcs('nm')} SELECT a, b, round(ratio, 6) AS ratio FROM nm_ratio",
    "token_sort_ratio": f"WITH {NAMES}, so AS (SELECT a AS x, b AS y, {SORTED.format(x='a')} AS a, {SORTED.format(x='b')} AS b FROM nm),{_lcs('so')} SELECT x AS a, y AS b, CASE WHEN x = '' OR y = '' THEN 0 ELSE round(ratio, 6) END AS ratio FROM so JOIN so_ratio USING (a, b)",
    "tfidf_weights": f"WITH {PARTS},{_tfidf('n', 'name', 2, 4)} SELECT text, gram, round(idf, 6) AS idf, round(w, 6) AS w FROM n_w JOIN n_idf USING (gram)",
    "tfidf_topk": f"WITH {PARTS},{_tfidf('n', 'name', 2, 4)},{_tfidf('a', 'address', 2, 4)}, p AS (SELECT q.id AS query, t.id AS target, round(score, 12) AS score FROM n_s JOIN q ON q.name = q_text JOIN t ON t.name = t_text UNION ALL SELECT q.id, t.id, round(score, 12) FROM a_s JOIN q ON q.address = q_text JOIN t ON t.address = t_text), m AS (SELECT query, target, max(score) AS score FROM p WHERE score >= 0.25 GROUP BY ALL) SELECT query, target, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank FROM m) WHERE rank <= 4",
    "knn_demo": f"WITH {PARTS},{_tfidf('n', 'name', 3, 3, 'HAVING sum(docs) >= 2 AND sum(docs) <= 0.5 * any_value(n)')}, p AS (SELECT q.id AS query, t.id AS target, 1 - round(coalesce(score, 0), 12) AS distance FROM q CROSS JOIN t LEFT JOIN n_s ON q.name = q_text AND t.name = t_text) SELECT query, target, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), target) AS rank FROM p) WHERE rank <= 5",
    "candidate_pairs": f"{FULL} SELECT query, target FROM var WHERE variant = 'hybrid'",
    "pair_features": f"{FULL}, hy AS (SELECT query, target, q.name AS qn, t.name AS tn, q.address AS qa, t.address AS ta, q.cn AS qc, t.cn AS tc, n, a FROM var JOIN q ON q.id = query JOIN t ON t.id = target WHERE variant = 'hybrid'), so AS (SELECT qn, tn, {SORTED.format(x='qn')} AS a, {SORTED.format(x='tn')} AS b FROM hy),{_lcs('so')}, sr AS (SELECT DISTINCT qn, tn, ratio FROM so JOIN so_ratio USING (a, b)) SELECT query, target, round(n, 6) AS name_ratio, round(CASE WHEN qn = '' OR tn = '' THEN 0 ELSE ratio END, 6) AS name_token_sort_ratio, round(a, 6) AS address_ratio, (qn <> '' AND qn = tn)::INT::DOUBLE AS name_exact, (qa <> '' AND qa = ta)::INT::DOUBLE AS address_exact, (qn = '')::INT::DOUBLE AS query_name_blank, (tn = '')::INT::DOUBLE AS target_name_blank, (qa = '')::INT::DOUBLE AS query_address_blank, (ta = '')::INT::DOUBLE AS target_address_blank, (qc <> '' AND qc = tc)::INT::DOUBLE AS country_equal FROM hy JOIN sr USING (qn, tn)",
    "label_pairs": f"{FULL} SELECT query, target, (truth.target IS NOT NULL)::INT AS label FROM (SELECT query, target FROM var WHERE variant = 'hybrid') LEFT JOIN truth USING (query, target)",
    "choose_matches": f"{FULL} SELECT query, target FROM var WHERE variant = 'hybrid' AND score >= 1.0",
    "business_f05": f"WITH {ORDERS},{_per_query('pr')} SELECT query, n_truth, n_chosen, tp, round(f05, 6) AS f05 FROM pf",
    "macro_f05": f"WITH {ORDERS},{_per_query('pr')} SELECT {MACRO} FROM pf",
    "macro_f05_by_country": f"WITH {ORDERS},{_per_query('pr')} SELECT country, {MACRO} FROM pf GROUP BY country",
    "candidate_diagnostics": f"WITH {ORDERS},{_per_query('ca')} SELECT sum(n_truth)::BIGINT AS true_links, sum(tp)::BIGINT AS recovered_true_links, round(sum(tp) / nullif(sum(n_truth), 0)::DOUBLE, 6) AS pair_recall, sum(n_chosen)::BIGINT AS total_candidates, count(*) FILTER (n_chosen = 0) AS empty_entities, round(avg(n_chosen), 6) AS mean_candidates, max(n_chosen) AS maximum_candidates, round(avg(best), 6) AS oracle_macro_f05 FROM pf",
    "oracle_f05": f"WITH {ORDERS},{_per_query('ca')} SELECT query, round(best, 6) AS oracle_f05 FROM pf",
    "retrieval_summary": f"WITH {ORDERS},{_per_query('ca')} SELECT country, {SUMMARY} FROM pf GROUP BY country",
    "retrieval_summary_by_variant": f"{FULL},{VARIANT_LISTS} SELECT variant, {SUMMARY} FROM pf GROUP BY variant",
    "true_link_diagnostics": f"{FULL},{LINKS} SELECT count(*) AS true_links, count(*) FILTER (qcn <> tcn) AS country_mismatch_links, count(*) FILTER (NOT (qn <> '' AND qn = tn)) AS nonexact_name_links, count(*) FILTER (NOT (qa <> '' AND qa = ta)) AS nonexact_address_links, count(*) FILTER (length(tn) BETWEEN 1 AND 3) AS short_target_name_links, count(*) FILTER (regexp_matches(qbn || tbn, '[^\\x00-\\x7F]')) AS non_ascii_name_links, count(*) FILTER (NOT kept AND seen) AS true_links_lost_at_final_cap FROM tl",
    "missed_links": f"{FULL},{LINKS}, mi AS (SELECT * FROM tl WHERE NOT kept), mn AS (SELECT qn AS a, tn AS b FROM mi), ma AS (SELECT qa AS a, ta AS b FROM mi),{_lcs('mn')},{_lcs('ma')} SELECT query AS source1_entity_id, target AS target_entity_id, qbn AS query_name, tbn AS target_name, qba AS query_address, tba AS target_address, qc AS query_country, tc AS target_country, round(CASE WHEN qn = '' OR tn = '' THEN 0 ELSE mn_ratio.ratio END, 6) AS name_ratio, round(CASE WHEN qa = '' OR ta = '' THEN 0 ELSE ma_ratio.ratio END, 6) AS address_ratio, CASE WHEN seen THEN 'final_candidate_cap' ELSE 'not_returned_by_channels' END AS miss_stage FROM mi JOIN mn_ratio ON mn_ratio.a = qn AND mn_ratio.b = tn JOIN ma_ratio ON ma_ratio.a = qa AND ma_ratio.b = ta",
    "query_details": f"{FULL}, tm AS (SELECT field, text, string_agg(token, ',' ORDER BY place) AS x FROM terms GROUP BY ALL), vh AS (SELECT query, target FROM var WHERE variant = 'hybrid'), vo AS (SELECT query, target FROM var WHERE variant = 'name_only') SELECT q.id AS source1_entity_id, bname AS business_name, country, (SELECT count(*) FROM truth WHERE query = q.id) AS true_links, (SELECT count(*) FROM truth JOIN vo USING (query, target) WHERE query = q.id) AS name_only_recovered, (SELECT count(*) FROM truth JOIN vh USING (query, target) WHERE query = q.id) AS hybrid_recovered, (SELECT count(*) FROM vh WHERE query = q.id) AS hybrid_candidates, coalesce((SELECT x FROM tm WHERE field = 'name' AND text = q.name), '') AS name_terms, coalesce((SELECT x FROM tm WHERE field = 'address' AND text = q.address), '') AS address_terms, coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM truth ANTI JOIN vh USING (query, target) WHERE query = q.id), '') AS missed_ids FROM q",
    "validator_findings": f"WITH {ORDERS}, l AS (SELECT query AS key, status, list(CASE priority WHEN '5' THEN query WHEN '4' THEN 'X' || target ELSE target END) AS ids FROM ol GROUP BY 1, 2), e AS (SELECT key, unnest(ids) AS id FROM l) SELECT 'duplicate row' AS category, key AS offender FROM l GROUP BY key HAVING count(*) > 1 UNION SELECT 'repeated ID in a list', key FROM l WHERE len(ids) <> len(list_distinct(ids)) UNION SELECT 'self match', id FROM e WHERE id LIKE 'S1-%' UNION SELECT 'wrong prefix', id FROM e WHERE NOT regexp_matches(id, '^S[123]-') UNION SELECT 'unknown ID', id FROM e WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT target FROM ca) UNION SELECT 'missing row', query FROM k WHERE query NOT IN (SELECT key FROM l) UNION SELECT 'extra row', key FROM l WHERE key NOT IN (SELECT query FROM k)",
    "legacy_pair_metrics": f"WITH {ORDERS}, c AS (SELECT count(*) FILTER (x.target IS NOT NULL AND y.target IS NOT NULL) AS tp, count(y.target) AS ch, count(x.target) AS tt FROM ca LEFT JOIN tr x USING (query, target) LEFT JOIN pr y USING (query, target)), m AS (SELECT coalesce(tp / nullif(ch, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tt, 0)::DOUBLE, 0) AS r FROM c) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0), 6) AS f05 FROM m",
}
ORACLES |= {
    "tsv_sources": f"WITH {PARTS} SELECT id AS entity_id, bname AS business_name, baddress AS business_address, country FROM rec",
    "tsv_quoted": "SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS source, length(coalesce(text, ''))::BIGINT AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "tsv_lists": f"WITH {ORDERS} SELECT query, target, country FROM tr JOIN k USING (query)",
    "tsv_selected": f"WITH {ORDERS} SELECT query, target FROM ca JOIN k USING (query) WHERE country = 'BUILDING'",
    "score_files": f"WITH {ORDERS},{_per_query('pr')} SELECT country, entities, tp, fp, fn, macro_f05 FROM (SELECT country, {MACRO} FROM pf GROUP BY country)",
    "validate_lines": ORACLES["validator_findings"],
    "model_reload": f"{FULL} SELECT count(*) AS pairs, count(truth.target) AS matches, true AS sound, true AS same FROM (SELECT query, target FROM var WHERE variant = 'hybrid') LEFT JOIN truth USING (query, target)",
}
