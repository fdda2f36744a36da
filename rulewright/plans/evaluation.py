"""Summaries of evaluation data: the operators run on score rows derived from the driver tables, the oracles are written apart."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions import stats
from rulewright.operators import summaries as S
from rulewright.plans._registry import query, table


def view(spark, d: str, text: str) -> DataFrame:
    """A derived input: Spark SQL over driver tables named in braces."""
    return spark.sql(text, **{t: table(spark, d, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def duck(text: str) -> str:
    """The same input for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


#: Score rows: a line item is a sample of the problem of its part, in the mode of its return flag.
SCORES = """SELECT CAST(l_partkey AS BIGINT) AS problem_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS sample_idx, CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'guided' ELSE 'reasoned' END AS mode,
    CASE l_linestatus WHEN 'F' THEN 'endpoint' ELSE 'trace' END AS arm, CASE WHEN l_partkey % 7 = 0 THEN 'builtin' ELSE concat('t', CAST(l_partkey % 5 + 1 AS STRING)) END AS tier,
    CASE WHEN l_partkey % 10 < 7 THEN 'test' WHEN l_partkey % 10 = 7 THEN 'table1' ELSE 'heldout' END AS split, CASE WHEN l_partkey % 2 = 0 THEN 'defeasible' ELSE 'monotonic' END AS class,
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 50 AS STRING) END AS structure, concat('gold', CAST(l_partkey % 40 AS STRING)) AS gold, l_quantity > 5 AS parsed, l_tax > 0.07 AS truncated,
    CASE WHEN l_quantity > 5 THEN l_quantity > 15 END AS valid, CASE WHEN l_quantity > 5 THEN l_quantity > 15 AND l_discount < 0.06 END AS clean, CASE WHEN l_quantity > 5 THEN l_quantity > 15 AND l_discount < 0.03 END AS exact,
    l_discount < 0.08 AS intensional, CASE WHEN l_tax < 0.02 THEN NULL ELSE CAST(l_tax * 10 AS DOUBLE) END AS agreement, l_partkey % 2 = 0 AS ref_defeasible, CASE WHEN l_quantity > 5 THEN l_suppkey % 3 <> 0 END AS defeasible,
    CAST(l_suppkey % 4 AS INT) AS r2_n, CAST(CASE WHEN l_quantity > 25 THEN l_suppkey % 4 ELSE 0 END AS INT) AS r2_exact, l_suppkey % 2 = 0 AS algorithm_choice, l_suppkey % 5 = 0 AS forbidden_choice,
    CASE WHEN l_quantity <= 5 THEN 'parse_error' WHEN l_quantity <= 15 THEN 'not_a_solution' WHEN l_discount >= 0.08 THEN 'valid_but_degenerate' ELSE 'ok' END AS error FROM {lineitem}"""
_S = f"s AS ({duck(SCORES)})"


def _wilson(k: str, n: str, low: str, high: str) -> str:
    p, z = f"({k} / {n}::DOUBLE)", "3.8416"
    centre, half = f"(({p} + {z} / (2 * {n})) / (1 + {z} / {n}))", f"(1.96 * sqrt({p} * (1 - {p}) / {n} + {z} / (4.0 * {n} * {n})) / (1 + {z} / {n}))"
    return f"round(greatest(0.0::DOUBLE, {centre} - {half}), 3) AS {low}, round(least(1.0::DOUBLE, {centre} + {half}), 3) AS {high}"


def _balanced(t: str, s: str) -> str:
    """Hit rates of both classes; an answer that is left out is a miss."""
    return f"round((count(*) FILTER (WHERE ({t}) AND ({s}))::DOUBLE / nullif(count(*) FILTER (WHERE {t}), 0) + count(*) FILTER (WHERE NOT ({t}) AND NOT ({s}))::DOUBLE / nullif(count(*) FILTER (WHERE NOT ({t})), 0)) / 2, 4)"


def _aggregate_sql(by: list[str], where: str = "true") -> str:
    keys = ", ".join(by)
    group = f"GROUP BY {keys}" if by else ""
    per = ", ".join(f"avg(CAST(coalesce({m}, false) AS INT)) AS {m}_1, max(CAST(coalesce({m}, false) AS INT)) AS {m}_k" for m in S.METRICS)
    two = ", ".join([f"round(avg({m}_1), 3) AS {m}_at_1, round(avg({m}_k), 3) AS {m}_at_k, {_wilson(f'sum({m}_k)', 'count(*)', f'{m}_low', f'{m}_high')}" for m in S.METRICS])
    lead = f"{keys}, " if by else ""
    on = " AND ".join(f"a.{k} = b.{k}" for k in by) or "true"
    return f"""WITH {_S}, p AS (SELECT {lead}problem_id, {per}, count(*) AS n, max(coalesce(structure, CAST(problem_id AS VARCHAR))) AS st FROM s WHERE {where} GROUP BY {lead}problem_id),
    a AS (SELECT {lead}count(*) AS n_problems, count(DISTINCT st) AS n_structures, CAST(sum(n) AS BIGINT) AS n_samples, {two} FROM p {group}),
    b AS (SELECT {lead}round(avg(agreement), 4) AS agreement, round(avg(CAST(parsed AS INT)), 4) AS parse_rate, round(avg(CAST(truncated AS INT)), 4) AS truncated_rate, round(avg(CAST(intensional AS INT)) FILTER (WHERE valid), 4) AS intensional_rate,
    {_balanced("ref_defeasible AND defeasible IS NOT NULL", "defeasible").replace("NOT (ref_defeasible AND defeasible IS NOT NULL)", "(NOT ref_defeasible AND defeasible IS NOT NULL)")} AS r3_balanced, round(sum(r2_exact)::DOUBLE / nullif(sum(r2_n), 0), 4) AS r2_exact FROM s WHERE {where} {group})
    SELECT a.*, {", ".join("b." + c for c in ("agreement", "parse_rate", "truncated_rate", "intensional_rate", "r3_balanced", "r2_exact"))} FROM a JOIN b ON {on}"""


@query("q17_at1_atk", _aggregate_sql(["mode"]))
def at1_atk(spark, d):
    """The result aggregate of each mode."""
    return S.result_aggregate(view(spark, d, SCORES), ["mode"])


@query("q71_breakdown_having", _aggregate_sql(["mode", "tier"]))
def breakdown(spark, d):
    """The result aggregate of each mode and tier."""
    return S.tier_breakdown(view(spark, d, SCORES), "mode")


@query(
    "q18_grouping_all_split_tier",
    f"""WITH {_S} SELECT mode, CASE WHEN split IS NOT NULL THEN 'split' WHEN tier IS NOT NULL THEN 'tier' ELSE 'all' END AS level, coalesce(split, tier, 'all') AS value, count(*) AS n, round(avg(CAST(exact AS INT)), 4) AS rate
    FROM s GROUP BY GROUPING SETS ((mode), (mode, split), (mode, tier))""",
)
def grouping(spark, d):
    return S.by_all_split_tier(view(spark, d, SCORES), "exact", ["mode"])


@query("q52_confusion_tables", f"WITH {_S} SELECT mode, error, count(*) AS n FROM s GROUP BY mode, error")
def error_counts(spark, d):
    return S.counted(view(spark, d, SCORES), ["mode"], "error")


@query("q57_mechanism_share", "WITH s AS (SELECT DISTINCT doc_id, unnest([lang, source, lang]) AS mechanism FROM documents) SELECT mechanism, count(*) AS n, round(avg(quality), 4) AS share FROM s JOIN labels USING (doc_id) GROUP BY mechanism")
def mechanism_share(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.array("lang", "source", "lang").alias("m")).join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("clean")), "doc_id")
    return S.mechanism_share(rows, "m", "clean")


@query(
    "q58_arm_report",
    f"""WITH {_S}, t AS (SELECT *, CASE WHEN split = 'test' THEN 'test' WHEN split = 'table1' THEN 'table1 ' || class ELSE tier || ' ' || class END AS "set", gold IN (SELECT 'gold' || (p_partkey % 25) FROM part) AS seen FROM s)
    SELECT arm, "set", count(*) AS n, {", ".join(f"CAST(count(*) FILTER (WHERE {m}) AS BIGINT) AS {m}_k, round(avg(CAST(coalesce({m}, false) AS INT)), 4) AS {m}_p" for m in ("parsed", "valid", "clean", "exact"))},
    round(avg(agreement), 4) AS agreement, count(agreement) AS agreement_n, {_balanced("ref_defeasible AND defeasible IS NOT NULL", "defeasible").replace("NOT (ref_defeasible AND defeasible IS NOT NULL)", "(NOT ref_defeasible AND defeasible IS NOT NULL)")} AS r3_balanced,
    CAST(count(*) FILTER (WHERE exact AND seen) AS BIGINT) AS exact_seen, CAST(count(*) FILTER (WHERE seen) AS BIGINT) AS n_seen, CAST(count(*) FILTER (WHERE exact AND NOT seen) AS BIGINT) AS exact_unseen,
    CAST(count(*) FILTER (WHERE split = 'heldout' AND algorithm_choice) AS BIGINT) AS algorithm_choice, CAST(count(*) FILTER (WHERE split = 'heldout' AND forbidden_choice) AS BIGINT) AS forbidden_choice FROM t GROUP BY arm, "set" """,
)
def arm_report(spark, d):
    """An arm by set, with exact answers split by whether the expected answer occurs in training."""
    train = table(spark, d, "part").select(F.concat(F.lit("gold"), (F.col("p_partkey") % 25).cast("string")).alias("answer"))
    return S.arm_report(view(spark, d, SCORES), train)


@query(
    "q25_presence_frequency",
    """WITH u AS (SELECT DISTINCT user_id % 20 AS problem_id, event_id % 10 AS sample_idx, event_type AS item FROM events), n AS (SELECT user_id % 20 AS problem_id, count(DISTINCT event_id % 10) AS n FROM events GROUP BY 1)
    SELECT u.problem_id, item, round(count(*)::DOUBLE / max(n.n), 4) AS frequency FROM u JOIN n ON u.problem_id = n.problem_id GROUP BY u.problem_id, item""",
)
def presence_frequency(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("problem_id"), (F.col("event_id") % 10).alias("sample_idx"), F.array("event_type", "event_type").alias("items"))
    return S.presence_frequency(rows, ["problem_id"], "sample_idx", "items")


_PROBLEMS = "SELECT p_partkey AS problem_id, p_size AS n_facts, p_size % 4 AS n_rules, p_size % 3 AS n_assumptions, p_size % 5 AS n_positive, p_size % 6 AS n_negative, p_size % 12 + 1 AS n_constants FROM {part}"


@query(
    "q65_dataset_stats",
    f"WITH p AS ({duck(_PROBLEMS)}) SELECT count(*) AS n, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c[2:]}, round(avg({c}), 4) AS mean_{c[2:]}" for c in ("n_facts", "n_rules", "n_assumptions", "n_positive", "n_negative", "n_constants")) + " FROM p",
)
def dataset_stats(spark, d):
    return S.dataset_stats(view(spark, d, _PROBLEMS))


@query(
    "q113_size_rows",
    f"""WITH p AS ({duck(_PROBLEMS)}), {_S}, x AS (SELECT problem_id, max(CAST(coalesce(clean, false) AS INT)) AS clean_at_k, round(avg(CAST(coalesce(clean, false) AS INT)), 6) AS clean_at_1, max(CAST(coalesce(exact, false) AS INT)) AS exact_at_k FROM s GROUP BY problem_id)
    SELECT p.*, clean_at_k, clean_at_1, exact_at_k FROM p JOIN x ON p.problem_id = x.problem_id""",
)
def size_rows(spark, d):
    """Sizes of problems beside what was reached."""
    got = S.size_rows(view(spark, d, _PROBLEMS), S.at_k(view(spark, d, SCORES), []))
    return got.withColumn("clean_at_1", F.round("clean_at_1", 6))


@query(
    "q24_length_audit",
    "SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean, CAST(max(length(text)) AS BIGINT) AS longest, CAST(sum(length(text)) AS BIGINT) AS total, CAST(max(length(text) + length(role)) AS BIGINT) AS longest_both FROM conversations GROUP BY role",
)
def length_audit(spark, d):
    return S.length_audit(table(spark, d, "conversations"), ["role"], F.length("role"), F.length("text"))


@query(
    "q26_ordered_digest",
    "SELECT l_orderkey, sha256(string_agg(sha256(l_partkey || ':' || l_suppkey), '' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS digest FROM lineitem GROUP BY l_orderkey",
)
def ordered_digest(spark, d):
    return S.ordered_digest(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))


@query(
    "q21_leave_one_out_mode",
    """WITH r AS (SELECT o.o_orderkey, x.o_orderpriority AS p, count(*) AS n FROM orders o JOIN orders x ON o.o_custkey = x.o_custkey AND o.o_orderkey <> x.o_orderkey GROUP BY 1, 2)
    SELECT o_orderkey, arg_min(p, row(-n, p)) AS mode FROM r GROUP BY o_orderkey""",
)
def leave_one_out_mode(spark, d):
    return S.leave_one_out_mode(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "q20_majority_vote_fallback",
    """WITH v AS (SELECT event_type, user_id % 7 AS bucket, count(*) FILTER (WHERE value > 50) AS yes, count(*) FILTER (WHERE value <= 50) AS no FROM events WHERE value IS NOT NULL GROUP BY 1, 2), f AS (SELECT event_type, sum(yes) AS yes, sum(no) AS no FROM v GROUP BY 1)
    SELECT v.event_type, v.bucket, CASE WHEN v.yes <> v.no THEN v.yes > v.no ELSE f.yes > f.no END AS guess FROM v JOIN f ON v.event_type = f.event_type""",
)
def majority_vote(spark, d):
    rows = table(spark, d, "events").where("value IS NOT NULL").withColumn("bucket", F.col("user_id") % 7)
    return S.majority_vote(rows, ["event_type", "bucket"], ["event_type"], F.col("value") > 50)


@query(
    "q63_stratum_fallback",
    """WITH t AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1)
    SELECT t.o_orderstatus, t.o_orderpriority, round(CASE WHEN t.n >= 800 THEN t.m ELSE g.m END, 2) AS baseline FROM t JOIN g ON t.o_orderpriority = g.o_orderpriority""",
)
def stratum_fallback(spark, d):
    o = table(spark, d, "orders")
    return S.stratum_lookup(o, o, ["o_orderstatus", "o_orderpriority"], ["o_orderpriority"], "o_totalprice", F.col("n") >= 800)


def _arm(spark, d, arm: str, shift: int) -> DataFrame:
    flag = (F.col("p_partkey") * 7 + shift) % 3 == 0 if arm == "a" else (F.col("p_partkey") * 5 + shift) % 4 == 0
    return table(spark, d, "part").where(F.col("p_size") != (3 if arm == "a" else 4)).select(F.col("p_partkey").alias("problem_id"), flag.alias("exact"))


_PAIR = """x AS (SELECT p_partkey, (p_partkey * 7 + 1) % 3 = 0 AS a FROM part WHERE p_size <> 3), y AS (SELECT p_partkey, (p_partkey * 5 + 2) % 4 = 0 AS b FROM part WHERE p_size <> 4),
    z AS (SELECT a, b FROM x FULL JOIN y ON x.p_partkey = y.p_partkey), c AS (SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unpaired, count(*) FILTER (WHERE a AND NOT b) AS first_only,
    count(*) FILTER (WHERE b AND NOT a) AS second_only, round(avg(CAST(b AS INT) - CAST(a AS INT)), 4) AS delta FROM z),
    m AS (SELECT c.*, CASE WHEN first_only + second_only = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(first_only + second_only + 1) - lgamma(i + 1) - lgamma(first_only + second_only - i + 1) - (first_only + second_only) * ln(2.0::DOUBLE))) FROM range(0, least(first_only, second_only) + 1) t(i))), 6) END AS p FROM c)"""


@query("q114_paired_arms", f"WITH {_PAIR} SELECT * FROM m")
def paired_arms(spark, d):
    """Two arms on the same problems: discordant pairs, problems of one arm only, and the exact p."""
    return S.paired(_arm(spark, d, "a", 1), _arm(spark, d, "b", 2), "exact")


@query(
    "q59_invariance_verdict",
    f"WITH {_PAIR} SELECT *, CASE WHEN delta BETWEEN -0.05 AND 0.05 AND p >= 0.05 THEN 'invariant within +-0.05' WHEN delta BETWEEN -0.05 AND 0.05 THEN 'invariant within +-0.05, significant ' || CASE WHEN delta < 0 THEN 'drop' ELSE 'rise' END WHEN p < 0.05 AND delta < 0 THEN 'drop' WHEN p < 0.05 THEN 'rise' ELSE 'inconclusive' END AS verdict FROM m",
)
def invariance_verdict(spark, d):
    pair = S.paired(_arm(spark, d, "a", 1), _arm(spark, d, "b", 2), "exact")
    return S.invariance(pair, F.col("delta"), F.col("delta"))


@query("q115_stronger_arm", f"WITH {_PAIR} SELECT n, first_only, second_only, p, CASE WHEN p < 0.05 AND first_only <= second_only THEN 'endpoint' ELSE 'trace' END AS base, p < 0.05 AND first_only > second_only AS matched_run FROM m")
def stronger_arm(spark, d):
    return S.stronger_arm(S.paired(_arm(spark, d, "a", 1), _arm(spark, d, "b", 2), "exact"), "trace", "endpoint")


@query(
    "q116_step_verdict",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'undefined' WHEN n_nationkey / 24.0 <= 0.6 THEN 'refuted' WHEN n_nationkey / 24.0 >= 0.9 AND n_regionkey >= 1 THEN 'supported' ELSE 'intermediate' END AS verdict FROM nation",
)
def step_verdict(spark, d):
    """The registered rule on step training for every nation as a run."""
    a = F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") / 24.0)
    return table(spark, d, "nation").select("n_nationkey", S.supported(a, F.lit(0.95), F.col("n_regionkey"), F.lit(0), F.lit(0.01)).alias("verdict"))


@query(
    "q62_policy_floor",
    f"""WITH p AS (SELECT 'always' AS policy, avg(CAST(quality = 1 AS INT)) AS m FROM labels UNION ALL SELECT 'never', avg(CAST(quality = 0 AS INT)) FROM labels UNION ALL SELECT 'parity', avg(CAST(quality = doc_id % 2 AS INT)) FROM labels),
    b AS (SELECT arg_min(policy, row(-m, policy)) AS policy, round(max(m), 4) AS floor FROM p), c AS (SELECT sum(quality) AS k, count(*) AS n FROM labels), w AS (SELECT round(k / n, 4) AS measured, {_wilson("k", "n", "low", "high")} FROM c)
    SELECT policy, floor, measured, low, low > floor AS above FROM b, w""",
)
def policy_floor(spark, d):
    x = table(spark, d, "labels")
    quality = F.col("quality") == 1
    policies = x.select(F.explode(F.array(F.struct(F.lit("always").alias("policy"), quality.alias("right")), F.struct(F.lit("never").alias("policy"), (~quality).alias("right")), F.struct(F.lit("parity").alias("policy"), (F.col("quality") == F.col("doc_id") % 2).alias("right")))).alias("p")).select("p.policy", "p.right")
    measured = x.agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    return S.floors(policies, "right", measured, "k", "n")


@query(
    "q64_value_ranges",
    """WITH t AS (SELECT DISTINCT o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) AS price FROM orders WHERE o_orderstatus <> 'P'), e AS (SELECT o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) AS price FROM orders WHERE o_orderstatus = 'P')
    SELECT 'price' AS feature, CAST(price AS VARCHAR) AS value, count(*) AS n FROM e WHERE price NOT IN (SELECT price FROM t) GROUP BY price UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM e WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM t) GROUP BY o_orderpriority""",
)
def value_ranges(spark, d):
    """Values of features that the evaluated rows have and no training row has."""
    rows = table(spark, d, "orders").withColumn("price", F.floor(F.col("o_totalprice") / 1000))
    return S.out_of_range(rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus = 'P'"), ["price", "o_orderpriority"])


@query(
    "q68_explained_choice",
    f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY problem_id, mode ORDER BY NOT coalesce(clean, false), NOT parsed, sample_idx) AS i FROM s)
    SELECT problem_id, mode, CASE WHEN parsed THEN sample_idx END AS sample_idx, parsed AS explained FROM r WHERE i = 1""",
)
def explained_choice(spark, d):
    return S.explained_choice(view(spark, d, SCORES), ["problem_id", "mode"])


@query(
    "q117_minted_reuse",
    "SELECT event_type AS said, count(*) AS n FROM events WHERE user_id % 3 = 0 AND value > 40 AND event_id % 2 = 0 GROUP BY event_type",
)
def minted_reuse(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("user_id") % 3 == 0, "reuse_check").otherwise("check").alias("kind"), (F.col("value") > 40).alias("truth"), F.col("event_type").alias("said"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("alpha_"), (F.col("event_id") % 4).cast("string"), F.lit("(X)"))).otherwise("normal(X)").alias("subject"))
    return S.minted_reuse(e)


@query("q69_example_arm_cross", "SELECT a.arm, l.quality, count(*) AS n FROM labels l, (VALUES ('endpoint'), ('trace'), ('step')) a(arm) GROUP BY a.arm, l.quality")
def example_arms(spark, d):
    return S.with_arms(table(spark, d, "labels"), ["endpoint", "trace", "step"]).groupBy("arm", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("q66_suffix_stripped_join", "SELECT p.page_id, d.source FROM pages p JOIN documents d ON p.page_id = d.doc_id")
def suffix_join(spark, d):
    """Ids with a suffix meet the ids that they stand for."""
    stored = table(spark, d, "pages").select("page_id", F.concat(F.lit("p#"), F.col("page_id").cast("string"), F.lit("#x")).alias("stored"))
    known = table(spark, d, "documents").select(F.concat(F.lit("p#"), F.col("doc_id").cast("string")).alias("k"), "source")
    return stored.withColumn("k", S.without_suffix(F.col("stored"))).join(known, "k").select("page_id", "source")


@query("q84_tier_from_id", "SELECT CASE doc_id % 4 WHEN 0 THEN 't3_noise' WHEN 1 THEN 'builtin' WHEN 2 THEN 't1_mono' ELSE 'builtin' END AS tier, count(*) AS n FROM documents GROUP BY 1")
def tier_from_id(spark, d):
    key = F.col("doc_id").cast("string")
    names = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("t3_noise_"), F.lpad(key, 4, "0"), F.lit("_anon"))).when(F.col("doc_id") % 4 == 1, "nixon_diamond").when(F.col("doc_id") % 4 == 2, F.concat(F.lit("t1_mono_"), key)).otherwise(F.concat(F.lit("t"), key))
    return table(spark, d, "documents").groupBy(S.tier_of(names).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("q70_distinct_structures", f"WITH {_S}, p AS (SELECT mode, problem_id, max(coalesce(structure, CAST(problem_id AS VARCHAR))) AS st FROM s GROUP BY 1, 2) SELECT mode, count(DISTINCT st) AS structures FROM p GROUP BY mode")
def distinct_structures(spark, d):
    return S.result_aggregate(view(spark, d, SCORES), ["mode"]).select("mode", F.col("n_structures").alias("structures"))


@query("q11_resume_anti_join", "SELECT d.doc_id, d.lang FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def resume_anti_join(spark, d):
    from rulewright.sources.resume import pending

    return pending(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang")


@query(
    "q12_paired_mcnemar",
    """WITH x AS (SELECT CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) b, CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) c FROM labels)
    SELECT b, c, CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))) FROM range(0, least(b, c) + 1) t(i))), 6) END p FROM x""",
)
def paired_mcnemar(spark, d):
    t = table(spark, d, "labels")
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    return t.agg(stats.count_if(q & ~x).alias("b"), stats.count_if(~q & x).alias("c")).select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p"))


_WILSON = """round(greatest(0.0::DOUBLE, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 3) ci_low,
    round(least(1.0::DOUBLE, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 3) ci_high"""


@query(
    "q13_wilson_by_lang",
    f"""WITH x AS (SELECT lang, CAST(sum(quality) AS DOUBLE) k, CAST(count(*) AS DOUBLE) n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
    SELECT lang, CAST(k AS BIGINT) k, CAST(n AS BIGINT) n, {_WILSON} FROM x""",
)
def wilson_by_lang(spark, d):
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("long").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "k", "n", low.alias("ci_low"), high.alias("ci_high"))


_BALANCED = """round((sum(CASE WHEN t AND s THEN 1.0::DOUBLE WHEN t THEN 0.0 END) / nullif(sum(CASE WHEN t THEN 1.0::DOUBLE END), 0)
    + sum(CASE WHEN NOT t AND NOT s THEN 1.0::DOUBLE WHEN NOT t THEN 0.0 END) / nullif(sum(CASE WHEN NOT t THEN 1.0::DOUBLE END), 0)) / 2, 4)"""


@query("q15_balanced_accuracy_by_source", f"WITH x AS (SELECT source, quality = 1 t, n_chars > 800 s FROM documents JOIN labels USING (doc_id)) SELECT source, count(*) n, {_BALANCED} balanced FROM x GROUP BY source")
def balanced_accuracy_by_source(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 800).alias("s"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), stats.balanced_accuracy("t", "s").alias("balanced"))


@query(
    "q16_cue_balanced_accuracy",
    """WITH x AS (SELECT lang, quality = 1 t, n_chars % 2 = 0 s FROM documents JOIN labels USING (doc_id)), y AS (SELECT lang,
    (sum(CASE WHEN t AND s THEN 1.0::DOUBLE ELSE 0.0 END) / greatest(sum(CASE WHEN t THEN 1.0::DOUBLE ELSE 0.0 END), 1.0)
    + sum(CASE WHEN NOT t AND NOT s THEN 1.0::DOUBLE ELSE 0.0 END) / greatest(sum(CASE WHEN NOT t THEN 1.0::DOUBLE ELSE 0.0 END), 1.0)) / 2 b FROM x GROUP BY lang)
    SELECT lang, round(greatest(b, 1 - b), 4) cue FROM y""",
)
def cue_balanced_accuracy(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("t"), (F.col("n_chars") % 2 == 0).alias("s"))
    return x.groupBy("lang").agg(stats.cue_accuracy("t", "s").alias("cue"))


@query(
    "q19_most_common_with_tie",
    """WITH c AS (SELECT p_brand, l_returnflag, count(*) n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT p_brand, arg_min(l_returnflag, row(-n, l_returnflag)) l_returnflag, max(n) n FROM c GROUP BY p_brand""",
)
def most_common_with_tie(spark, d):
    joined = table(spark, d, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.most_common(joined, ["p_brand"], "l_returnflag")


@query(
    "q22_bootstrap_ci",
    """WITH x AS (SELECT CAST(quality AS DOUBLE) x, row_number() OVER (ORDER BY quality) - 1 i FROM labels WHERE quality IS NOT NULL), n AS (SELECT count(*) n FROM x),
    draws AS (SELECT r, CAST(('0x' || substr(md5('b|' || r || '|' || i), 1, 8)) AS BIGINT) % n AS k FROM x, range(200) t(r), n),
    means AS (SELECT r, avg(x.x) m FROM draws JOIN x ON x.i = draws.k GROUP BY r), ranked AS (SELECT m, row_number() OVER (ORDER BY m) - 1 k FROM means)
    SELECT (SELECT n FROM n) n, (SELECT round(avg(x), 4) FROM x) mean, round(max(CASE WHEN k = 5 THEN m END), 4) ci_low, round(max(CASE WHEN k = 194 THEN m END), 4) ci_high FROM ranked""",
)
def bootstrap_ci(spark, d):
    return stats.bootstrap_mean(table(spark, d, "labels"), "quality")


@query(
    "q23_cluster_bootstrap",
    """WITH g AS (SELECT source, CAST(sum(quality) AS DOUBLE) s, CAST(count(*) AS DOUBLE) c FROM documents JOIN labels USING (doc_id) GROUP BY source),
    x AS (SELECT *, row_number() OVER (ORDER BY source) - 1 i FROM g), n AS (SELECT count(*) n FROM x),
    draws AS (SELECT r, CAST(('0x' || substr(md5('c|' || r || '|' || i), 1, 8)) AS BIGINT) % n AS k FROM x, range(200) t(r), n),
    means AS (SELECT r, sum(s) / sum(c) m FROM draws JOIN x ON x.i = draws.k GROUP BY r), ranked AS (SELECT m, row_number() OVER (ORDER BY m) - 1 k FROM means)
    SELECT (SELECT n FROM n) clusters, round(max(CASE WHEN k = 5 THEN m END), 4) ci_low, round(max(CASE WHEN k = 194 THEN m END), 4) ci_high FROM ranked""",
)
def cluster_bootstrap(spark, d):
    from rulewright.operators.resample import cluster_ratio

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", "quality")
    return cluster_ratio(rows, "source", "quality", replicates=200, salt="c")


@query(
    "q53_full_outer_compare",
    """WITH a AS (SELECT DISTINCT l_partkey p FROM lineitem WHERE l_suppkey = 1), b AS (SELECT DISTINCT l_partkey p FROM lineitem WHERE l_suppkey = 2)
    SELECT coalesce(a.p, b.p) part, CASE WHEN b.p IS NULL THEN 'left' WHEN a.p IS NULL THEN 'right' ELSE 'both' END side FROM a FULL JOIN b ON a.p = b.p""",
)
def full_outer_compare(spark, d):
    from rulewright.operators.compare import full_compare

    li = table(spark, d, "lineitem")
    part = lambda k: li.where(F.col("l_suppkey") == k).select(F.col("l_partkey").alias("part")).distinct()
    return full_compare(part(1), part(2), "part")


@query(
    "q14_clopper_pearson_by_source",
    """WITH RECURSIVE g AS (SELECT source, CAST(sum(quality) AS INT) AS k, CAST(count(*) AS INT) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source),
    b AS (SELECT source, k, n, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d, 0 AS i FROM g
      UNION ALL SELECT source, k, n, CASE WHEN 1 - lo < 0.025 THEN (a + b) / 2 ELSE a END, CASE WHEN 1 - lo < 0.025 THEN b ELSE (a + b) / 2 END, CASE WHEN hi > 0.025 THEN (c + d) / 2 ELSE c END, CASE WHEN hi > 0.025 THEN d ELSE (c + d) / 2 END, i + 1
      FROM (SELECT *, coalesce(list_sum(list_transform(range(0, k), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((a + b) / 2) + (n - j) * ln(1 - (a + b) / 2)))), 0) AS lo,
        list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((c + d) / 2) + (n - j) * ln(1 - (c + d) / 2)))) AS hi FROM b WHERE i < 50) x)
    SELECT source, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, CASE WHEN k = 0 THEN 0.0 ELSE round((a + b) / 2, 4) END AS ci_low, CASE WHEN k = n THEN 1.0 ELSE round((c + d) / 2, 4) END AS ci_high FROM b WHERE i = 50""",
)
def clopper_pearson_by_source(spark, d):
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").cast("long").alias("k"), F.count(F.lit(1)).alias("n"))
    return stats.with_exact_interval(g, "k", "n")


@query("q61_completeness_check", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def completeness_check(spark, d):
    """Expected ids that are not there."""
    from rulewright.operators.compare import expected_but_missing

    return expected_but_missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("q118_zipped_lists", "SELECT o_orderkey, CAST(i - 1 AS INT) AS pos, a[i] AS part, b[i] AS supplier FROM (SELECT l_orderkey AS o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_linenumber > 1) AS b FROM lineitem GROUP BY 1), range(1, 100) t(i) WHERE i <= len(a)")
def zipped_lists(spark, d):
    """Two ordered lists place by place."""
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"), F.array_sort(F.collect_list(F.when(F.col("l_linenumber") > 1, F.struct("l_linenumber", "l_partkey", "l_suppkey")))).alias("y")
    )
    rows = lists.select("o_orderkey", F.transform("x", lambda v: v["l_partkey"]).alias("part"), F.transform("y", lambda v: v["l_suppkey"]).alias("supplier"))
    return S.zipped(rows, ["o_orderkey"], "part", "supplier")
