"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, divergence, katz, language, lines, merkle, mixing, ordermin, pii, quotes, simhash, transducer, vectors
from siltstone.session import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), Path(public_tokenizers.path(model)).read_bytes())


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.order_fingerprints(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.lookup_proofs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_language_id, op3_token_counts, op4_benchmark_decontamination, op5_personal_data, op6_line_dedup, op7_quotation_linking, op8_embedding_near_dedup, op9_simhash_near_dedup, op10_mixing, op11_order_minhash, op12_source_divergence, op13_merkle_proofs)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The unsigned CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""


def _climb(name: str, levels: int) -> str:
    """Levels of trees from {name}_l0 (tree, idx, h, n), and the proofs and folds along them from {name}_x0 (id, tree, idx, n, proof, fold)."""
    out = []
    for k in range(levels):
        beside = "array_to_string(g[: idx % 8], '')", "array_to_string(g[idx % 8 + 2 :], '')"
        out += [
            f"{name}_g{k} AS (SELECT tree, idx // 8 AS up, any_value(n) AS n, list(h ORDER BY idx) AS g FROM {name}_l{k} GROUP BY 1, 2)",
            f"{name}_l{k + 1} AS (SELECT tree, up AS idx, CASE WHEN n > 1 THEN sha256(array_to_string(g, '')) ELSE g[1] END AS h, (n + 7) // 8 AS n FROM {name}_g{k})",
            f"{name}_x{k + 1} AS (SELECT id, tree, idx // 8 AS idx, (x.n + 7) // 8 AS n, proof || {beside[0]} || {beside[1]} AS proof, CASE WHEN x.n > 1 THEN sha256({beside[0]} || fold || {beside[1]}) ELSE fold END AS fold FROM {name}_x{k} x JOIN {name}_g{k} g USING (tree) WHERE g.up = x.idx // 8)",
        ]
    return ",\n".join(out)


def _leaf(text: str) -> str:
    part = lambda c: f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Queries that SQL can express; the others are tested against brute force, the library or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op4_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents), b AS (SELECT item_id, {_WORDS} AS t FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(t), 10) AS n, array_to_string(t[k : k + 9], ' ') AS win FROM (SELECT item_id, t, unnest(range(1, greatest(len(t) - 9, 1) + 1)) AS k FROM b WHERE len(t) > 0)),
p AS (SELECT doc_id, k, n, array_to_string(t[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS k FROM d) CROSS JOIN (SELECT DISTINCT n FROM g) WHERE k + n - 1 <= len(t)),
h AS (SELECT p.doc_id, p.k, p.n, g.item_id FROM p JOIN g USING (n, win)),
w AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM h GROUP BY 1)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op8_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x), n AS (SELECT x, count(*) AS n FROM p GROUP BY 1), c AS (SELECT x, min(y) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id""",
    "op12_source_divergence": """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY 1, 2, 3), lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
s AS (SELECT lang, count(*) AS v FROM v GROUP BY 1), g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + s.v) AS p
FROM g JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (lc.n + 1)) // (sum(lc.n) OVER (PARTITION BY lang) + s.v) AS q FROM lc JOIN s USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM z WHERE part = 'pair' OR rank <= 200""",
    # Eight levels hold 16 million rows a language, four hold 4,096 languages.
    "op13_merkle_proofs": f"""WITH d AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_LOW)} ELSE {_leaf("text")} END AS other FROM documents),
t AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, count(*) AS n FROM d GROUP BY lang),
a AS (SELECT row_number() OVER () AS id, doc_id, leaf, other, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang),
b_l0 AS (SELECT tree, idx, leaf AS h, n FROM a), b_x0 AS (SELECT id, tree, idx, n, '' AS proof, other AS fold FROM a),
{_climb("b", 8)},
s AS (SELECT tree, h AS subroot FROM b_l8), m AS (SELECT count(*) AS m FROM s),
c_l0 AS (SELECT 0 AS tree, tree AS idx, subroot AS h, m AS n FROM s, m), c_x0 AS (SELECT id, 0 AS tree, tree AS idx, m AS n, proof, fold FROM b_x8, m),
{_climb("c", 4)}
SELECT doc_id, leaf, subroot, c_l4.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = c_l4.h AS verified FROM a JOIN s USING (tree) JOIN c_x4 USING (id) CROSS JOIN c_l4""",
}
