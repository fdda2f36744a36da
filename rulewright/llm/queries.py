"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulewright.llm._memory import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.ngram_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.suffix_dedup import dedup_digest

    return dedup_digest(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.length_report import context_limits, histogram

    return context_limits(histogram(_table(spark, sf_dir, "documents").select("text")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.pii import digest

    return digest(_table(spark, sf_dir, "documents"), ["doc_id"])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), ["doc_id"])


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulewright.llm.quality import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the conversations table as the target domain."""
    from rulewright.llm.lm_score import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "conversations"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Connected components over both(x, y) from the ids in nodes(id).
_REACH = "r AS (SELECT id, id AS c FROM nodes UNION SELECT r.id, both_.y FROM r JOIN both_ ON both_.x = r.c)"

OP1_SQL = (
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
    both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), nodes AS (SELECT doc_id AS id FROM documents), """
    + _REACH
    + " SELECT r.id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id"
)

OP8_SQL = (
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    both_ AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p), nodes AS (SELECT vec_id AS id FROM embeddings), """
    + _REACH
    + """, c AS (SELECT id AS vec_id, min(c) AS component_id FROM r GROUP BY id), l AS (SELECT x AS vec_id, count(*) AS n FROM both_ GROUP BY x)
    SELECT c.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN l ON l.vec_id = c.vec_id"""
)


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op8_embedding_dedup": OP8_SQL}
