"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.functions import atoms
from rulewright.plans._registry import query, table


def _cleaned(column: str) -> str:
    """The replacements of an answer's cleaning, one after the other."""
    steps = [("```[a-zA-Z]*\\s*\\n?", ""), ("`", ""), ("\\\\\\s*\\n", "\n"), ("(?m)\\\\$", ""), ("[—–]", "-"), ("[‘’]", "''"), ("[“”]", '"'), ("\u00a0", " "), ("[^\\x00-\\x7F]", ""), ("\\n{3,}", "\n\n")]
    for pattern, new in steps:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return column


#: Marks that answers come with, dealt to the documents.
_MARKS = ["", "```prolog\n", "`x`", "a \\\nb", "— “q” ‘r’\u00a0s é", "\n\n\n\n"]


@query("q35_text_clean", "SELECT doc_id, md5(" + _cleaned("text || [" + ", ".join("'" + m.replace("'", "''") + "'" for m in _MARKS) + "][CAST(doc_id % 6 AS INT) + 1]") + ") AS cleaned FROM documents")
def text_clean(spark, d):
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % 6).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", F.md5(atoms.clean_answer(F.concat("text", mark))).alias("cleaned"))


@query(
    "q39_anonymise_names",
    "WITH w AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS t, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part), f AS (SELECT t, min(row(p_partkey, i)) AS pl FROM w GROUP BY t), n AS (SELECT t, row_number() OVER (ORDER BY pl) - 1 AS k FROM f) SELECT t AS name, substr('pqrstuvw', CAST(k % 8 + 1 AS INT), 1) || CASE WHEN k < 8 THEN '' ELSE CAST(k // 8 AS VARCHAR) END AS alias FROM n",
)
def anonymise_names(spark, d):
    from rulewright.operators.rule_text import name_map

    words = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("i", "name"))
    return name_map(words, "name", ["p_partkey", "i"], "pqrstuvw")


@query("q40_derived_seed", "SELECT doc_id, CAST(('0x' || substr(sha256('d' || doc_id), 1, 8)) AS BIGINT) % 2147483648 AS seed FROM documents")
def derived_seed(spark, d):
    return table(spark, d, "documents").select("doc_id", atoms.derived_seed(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("seed"))


@query("q58_leakage_intersect", "SELECT text FROM benchmark INTERSECT SELECT text FROM documents")
def leakage_intersect(spark, d):
    """Texts of both tables; between training and evaluation there must be none."""
    from rulewright.operators.compare import shared

    return shared(table(spark, d, "benchmark"), table(spark, d, "documents"), ["text"])


@query(
    "q60_checksum_manifest",
    """WITH r AS (SELECT source, doc_id // 1000 AS part, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS h, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY 1, 2)
    SELECT source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS chars, sha256(string_agg(h, '' ORDER BY part)) AS digest FROM r GROUP BY source""",
)
def checksum_manifest(spark, d):
    """A digest of each source: hashes of ranges of ids, then a hash of those, so no string grows with the source."""
    from rulewright.sources.jsonl import digests

    return digests(table(spark, d, "documents"), ["source"], "doc_id", F.coalesce("text", F.lit("")), 1000, F.sum("n_chars").cast("long").alias("chars"))


@query("q83_rule_mechanism", "SELECT k, count(*) AS n, mechanism FROM (SELECT doc_id % 8 AS k, ['fact', 'new_exception', 'reused_assumption', 'exception_rule', 'general', 'fact', 'new_exception', 'general'][CAST(doc_id % 8 AS INT) + 1] AS mechanism FROM documents) x GROUP BY k, mechanism")
def rule_mechanism(spark, d):
    """How a rule works: a fact, guarded by a new or a known assumption, a rule for an exception, or a general one."""
    from rulewright.operators.explain import mechanism_column
    from rulewright.plans.bank import dealt

    cases = [("p(X)", ["X = a"]), ("p(X)", ["q(X)", "alpha_0(X)"]), ("p(X)", ["q(X)", "normal(X)"]), ("c_alpha_0(X)", ["r(X)"]), ("p(X)", ["q(X)"]), ("p(a)", []), ("c_alpha_0(X)", ["alpha_0(X)"]), ("p(X)", ["q(X)", "s(X)"])]
    rows = dealt(spark, d, "documents", "doc_id", cases, "head string, body array<string>")
    kind = mechanism_column(F.col("head"), F.col("body"), F.array(F.lit("alpha_0(X)")), F.array(F.lit("normal(X)")))
    return rows.groupBy(F.col("k").cast("long").alias("k"), kind.alias("mechanism")).agg(F.count(F.lit(1)).alias("n"))


#: Durations as services write them, and their seconds.
_WAITS = [("try again in 2m30s", 150.0), ("wait 45s", 45.0), ("none", None), ("1h2m3.5s", 3723.5), ("in 714ms", 0.714), ("9m0s", 540.0), ("", None), ("7 messages", None)]


@query("q88_retry_after", "SELECT doc_id, [" + ", ".join("NULL" if v is None else f"{v}::DOUBLE" for _, v in _WAITS) + "][CAST(doc_id % 8 AS INT) + 1] AS seconds FROM documents")
def retry_after(spark, d):
    from rulewright.operators.summaries import retry_after as seconds
    from rulewright.plans.bank import dealt

    return dealt(spark, d, "documents", "doc_id", [(x,) for x, _ in _WAITS], "message string").select(F.col("id").alias("doc_id"), seconds(F.col("message")).alias("seconds"))
