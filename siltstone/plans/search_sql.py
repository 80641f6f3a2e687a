"""The SQL that searches are held against: the whole pipeline from both lists to the quota of media."""

from __future__ import annotations

#: Documents that have a vector: quality as importance, a time from the day of their number, a type from their number.
CHUNKS = """ch AS (SELECT d.doc_id AS id, d.text, d.lang, e.embedding::DOUBLE[] AS v, l.quality, {now} - (d.doc_id % 200) * 86400.0 AS mtime, {kind} AS source_type
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
KIND = "(['md', 'video', 'pdf', 'img'])[d.doc_id % 4 + 1]"
RARE = "CASE WHEN d.doc_id % 53 = 43 THEN 'audio' ELSE 'md' END"
TERM = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def bm25(terms: list[str], name: str, where: str, k: int) -> str:
    """A list `name` (id, score) of the k best of ch."""
    df = ", ".join(f"count(*) FILTER (list_contains(t, '{w}')) AS df_{i}" for i, w in enumerate(terms))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS f{i}" for i, w in enumerate(terms))
    one = " + ".join(f"ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len(t) / mean))" for i in range(len(terms)))
    return f"""{name} AS (SELECT id, score FROM (SELECT id, {one} AS score FROM (SELECT *, {tf} FROM (SELECT *, {TERM} AS t FROM ch) WHERE {where}), (SELECT count(*) AS n, sum(len(t)) / count(*) AS mean, {df} FROM (SELECT {TERM} AS t FROM ch)))
WHERE score > 0 ORDER BY score DESC, id LIMIT {k})"""


def near(name: str, where: str, k: int) -> str:
    """A list `name` of the k nearest of ch to the vector of number 0."""
    return f"{name} AS (SELECT id, list_cosine_similarity(v, q) AS score FROM ch, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) WHERE {where} ORDER BY 2 DESC, 1 LIMIT {k})"


def fused(words: str, now: float, where: str = "true", kind: str = KIND) -> str:
    """CTEs up to `w`: fused rows with length, importance and recency in their score."""
    return f"""{CHUNKS.format(now=now, kind=kind)}, {near('a', where, 50)}, {bm25(words.split(), 'b', where, 50)},
ra AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM a), rb AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM b),
f AS (SELECT id, sum(1 / (60 + r)) AS s, min(no * 1000 + r) AS first FROM (SELECT *, 0 AS no FROM ra UNION ALL SELECT *, 1 FROM rb) GROUP BY id),
f0 AS (SELECT ch.*, s, row_number() OVER (ORDER BY s DESC, first) AS pos FROM f JOIN ch USING (id)),
f1 AS (SELECT * REPLACE (row_number() OVER (ORDER BY s DESC, pos) AS pos) FROM (SELECT * REPLACE (CASE WHEN length(text) > 800 THEN s / (1 + 0.5 * log2(length(text) / 800.0)) ELSE s END AS s) FROM f0)),
f2 AS (SELECT * REPLACE (row_number() OVER (ORDER BY s DESC, pos) AS pos) FROM (SELECT * REPLACE (s * (0.7 + 0.3 * greatest(0, least(1, coalesce(quality, 0.5)))) AS s) FROM f1)),
w AS (SELECT * REPLACE (row_number() OVER (ORDER BY s DESC, pos) AS pos) FROM (SELECT * REPLACE (s * (0.5 + 0.5 * exp(-greatest(({now} - mtime) / 86400, 0) / 90)) + 0.3 * exp(-greatest(({now} - mtime) / 86400, 0) / 90) AS s) FROM f2))"""


def boosted(source: str, name: str, medium: str | None) -> str:
    if medium is None:
        return f"{name} AS (SELECT * FROM {source})"
    return f"{name} AS (SELECT * REPLACE (row_number() OVER (ORDER BY s DESC, pos) AS pos) FROM (SELECT * REPLACE (CASE WHEN source_type = '{medium}' THEN s * 1.35 ELSE s END AS s) FROM {source}))"


def diverse(source: str, name: str, pool: int, threshold: float) -> str:
    """The walk that puts rows like an earlier one behind; nb lists the places of what is like a row, and the walk carries what was taken."""
    return f"""nb AS (SELECT x.pos, x.id, coalesce(list(y.pos ORDER BY y.pos) FILTER (y.pos IS NOT NULL), []) AS nb FROM (SELECT * FROM {source} WHERE pos <= {pool}) x
LEFT JOIN {source} y ON y.pos < x.pos AND list_cosine_similarity(x.v, y.v) > {threshold} GROUP BY 1, 2),
walk AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS taken, NULL::BIGINT AS by UNION ALL
SELECT n.pos, CASE WHEN n.pos > 3 AND list_has_any(k.taken, n.nb) THEN k.taken ELSE list_append(k.taken, n.pos) END, CASE WHEN n.pos > 3 THEN list_filter(k.taken, lambda z: list_contains(n.nb, z))[1] END FROM walk k JOIN nb n ON n.pos = k.pos + 1),
{name} AS (SELECT x.* REPLACE (row_number() OVER (ORDER BY x.pos > {pool}, walk.by IS NOT NULL, x.pos) AS pos), (SELECT id FROM {source} z WHERE z.pos = walk.by) AS deferred_by, walk.by AS by_pos FROM {source} x LEFT JOIN walk USING (pos))"""


def quota(hits: str, pool: str, name: str, medium: str, slots: int = 2) -> str:
    return f"""ex AS (SELECT *, row_number() OVER (ORDER BY pos, id) AS r FROM {pool} WHERE source_type = '{medium}' AND id NOT IN (SELECT id FROM {hits}) QUALIFY r <= {slots} - (SELECT count(*) FROM {hits} WHERE source_type = '{medium}')),
kp AS (SELECT * FROM {hits} QUALIFY source_type = '{medium}' OR row_number() OVER (PARTITION BY source_type = '{medium}' ORDER BY pos DESC) > (SELECT count(*) FROM ex)),
{name} AS (SELECT id, source_type, s, row_number() OVER (ORDER BY pos) AS pos FROM (SELECT id, source_type, s, pos FROM kp UNION ALL
SELECT id, source_type, (SELECT min(s) FROM kp) * 0.99 * s / (SELECT max(s) FROM ex), 1000000 + r FROM ex))"""


def hybrid(words: str, now: float, k: int, medium: str | None = None, kind: str = KIND) -> str:
    """CTEs up to `final` (id, pos, s, source_type)."""
    own = ", ".join(f"'{w}'" for w in sorted(set(words.split())))
    n = len(set(words.split()))
    scale = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 1 END"
    recall = ""
    if medium:
        cond = f"source_type = '{medium}' AND NOT EXISTS (SELECT 1 FROM w WHERE w.source_type = '{medium}')"
        recall = f"{near('c', cond, 6)}, {bm25(words.split(), 'e', cond, 6)}, rc AS (SELECT ch.*, score AS s, 500000 + row_number() OVER (ORDER BY score DESC, id) AS pos FROM (SELECT id, max(score) AS score FROM (SELECT * FROM c UNION ALL SELECT * FROM e) GROUP BY id) JOIN ch USING (id)), "
    last = quota("hits", "(SELECT * FROM w1 UNION ALL SELECT * FROM rc)", "final", medium) if medium else "final AS (SELECT * FROM hits)"
    return f"""{fused(words, now, kind=kind)}, {recall}{boosted('w', 'w1', medium)},
rr AS (SELECT *, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(left(text, 4000)), '\\s+')), [{own}])) / {n}.0, 6) AS rr FROM w1 WHERE pos <= {6 * k}),
rs AS (SELECT * EXCLUDE (rr) REPLACE (row_number() OVER (ORDER BY s DESC, pos) AS pos) FROM (SELECT * REPLACE (0.6 * {scale('rr')} + 0.4 * {scale('s')} AS s) FROM rr)),
{boosted('rs', 'w2', medium)}, {diverse('w2', 'w3', max(2 * k, 3), 0.95)}, hits AS (SELECT * FROM w3 WHERE pos <= {k}), {last}"""
