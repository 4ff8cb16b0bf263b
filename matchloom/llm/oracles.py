"""DuckDB SQL of the operators that SQL can express, by brute force."""

from __future__ import annotations

from . import jaccard, license, substring
from .common import WORD

W = substring.WINDOW
SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
x AS (SELECT r, i, array_to_string(w[i : i + {W - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {W - 2})) AS i FROM d WHERE len(w) >= {W})),
twice AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {W})) AS p FROM x SEMI JOIN twice USING (k)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def _reach(links: str, nodes: str, key: str) -> str:
    """CTE ``low``(r, least): the least ``key`` of all nodes that ``links``(a, b), in both directions, reach."""
    return f"reach AS (SELECT r, r AS o FROM {nodes} UNION SELECT reach.r, b FROM reach JOIN {links} ON a = o), low AS (SELECT reach.r, min({key}) AS least FROM reach JOIN {nodes} n ON n.r = o GROUP BY reach.r)"


K, P = jaccard.SHINGLE, jaccard.PERCENT
JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{license.UPPER}', '{license.LOWER}'), '{WORD}'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + {K - 1}], ' ') AS e FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {K - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y USING (e) WHERE x.r <> y.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= {P} * (x.n + y.n - shared)),
{_reach('l', 'd', 'doc_id')}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id FROM d LEFT JOIN n USING (r) JOIN low USING (r)"""

EMBEDDINGS = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT x.r AS a, y.r AS b FROM d x JOIN d y ON x.r <> y.r AND list_cosine_similarity(x.v, y.v) >= 0.95),
{_reach('l', 'd', 'vec_id')}
SELECT vec_id, (SELECT count(*) FROM l WHERE a = d.r) AS n_links, least AS component_id, vec_id = least AS kept FROM d JOIN low USING (r)"""

#: The water level is the greatest of the levels that each source's place in the order of saturation would give.
TARGETS = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
s AS (SELECT source, sum(size) AS z FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
l AS (SELECT max((1.5 * (SELECT sum(z) FROM r) - coalesce((SELECT sum(2 * y.z) FROM r y WHERE 2 * y.z / y.w < 2 * x.z / x.w), 0)) / (SELECT sum(y.w) FROM r y WHERE 2 * y.z / y.w >= 2 * x.z / x.w)) AS level FROM r x),
t AS (SELECT source, z, least(2 * z, level * w) AS target FROM r, l)
SELECT doc_id, size::BIGINT AS size, z::BIGINT AS source_size, round(target::DOUBLE, 3) AS target, true AS whole, true AS near FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

PAYLOAD = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n, greatest(64, (octet_length(b) + 63) // 64 * 64) AS p FROM d)
SELECT doc_id, n::BIGINT AS n_bytes, p::BIGINT AS payload_bytes, sha256(b || repeat('\x00'::BLOB, p - n)) AS payload_sha256, true AS stored FROM n"""

ORACLES: dict[str, str] = {
    "check_op2_tokens": "SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, true AS sound FROM documents",
    "check_op4_language": r"SELECT count(*) AS texts, count(*) FILTER (text IS NULL OR NOT regexp_matches(text, '\p{L}')) AS und, true AS accurate, true AS sound FROM documents",
    "check_op5_targets": TARGETS,
    "check_op6_emails": "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+'))::BIGINT AS n_emails, false AS leaks FROM documents",
    "check_op7_payload": PAYLOAD,
    "check_op8_round_trip": "SELECT doc_id, true AS round_trip, coalesce(text, '') <> '' AS some FROM documents",
    "op1_substring_dedup": SUBSTRING,
    "op3_license_scan": license.oracle(),
    "op9_jaccard_join": JACCARD,
    "op10_embedding_duplicates": EMBEDDINGS,
}
