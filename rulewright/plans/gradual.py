"""Queries of gradual semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.functions import kernels as K
from rulewright.plans._registry import query, table

# Strengths in (0, 1) from account balances and prices; a and s are products over attackers and supporters.
_SETS = """WITH o AS (SELECT o_custkey, o_orderstatus, (o_totalprice % 1000) / 1000.0::DOUBLE AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
    x AS (SELECT c_custkey, 0.5::DOUBLE AS b, coalesce(product(1 - v) FILTER (WHERE o_orderstatus = 'F'), 1.0) AS pa, coalesce(product(1 - v) FILTER (WHERE o_orderstatus = 'O'), 1.0) AS ps,
    coalesce(sum(v) FILTER (WHERE o_orderstatus = 'F'), 0.0) AS sa, coalesce(sum(v) FILTER (WHERE o_orderstatus = 'O'), 0.0) AS ss FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_custkey)"""


def _forces(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", (F.col("o_totalprice") % 1000 / 1000.0).alias("v"))
    g = o.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("v")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("v")))).alias("s"))
    none = F.array().cast("array<double>")
    return table(spark, d, "customer").select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", F.coalesce("a", none).alias("a"), F.coalesce("s", none).alias("s"))


@query("q41_dfquad_one_step", _SETS + " SELECT c_custkey, round(b + b * least(0.0, pa - ps) + (1 - b) * greatest(0.0, pa - ps), 4) AS strength FROM x")
def dfquad_one_step(spark, d):
    return _forces(spark, d).select("c_custkey", F.round(K.linear(F.lit(0.5), K.balance_product(F.col("a"), F.col("s"))), 4).alias("strength"))


@query("q42_qe_one_step", _SETS + " SELECT c_custkey, round(b - b * (greatest(0.0, sa - ss) ** 2 / (1 + greatest(0.0, sa - ss) ** 2)) + (1 - b) * (greatest(0.0, ss - sa) ** 2 / (1 + greatest(0.0, ss - sa) ** 2)), 4) AS strength FROM x")
def qe_one_step(spark, d):
    return _forces(spark, d).select("c_custkey", F.round(K.quadratic(F.lit(0.5), K.balance_sum(F.col("a"), F.col("s"))), 4).alias("strength"))


def _rounds(n: int) -> str:
    """n synchronous rounds of product DF-QuAD over e(target, kind, edge, member) from b(asm, base), one CTE for each."""
    steps = ["r0 AS (SELECT asm, base, base AS v FROM b)"]
    for i in range(n):
        steps.append(
            f"s{i} AS (SELECT target, kind, edge, product(v) AS f FROM e JOIN r{i} ON r{i}.asm = e.member GROUP BY 1, 2, 3), w{i} AS (SELECT target, coalesce(product(1 - f) FILTER (WHERE kind = 'attack'), 1) - coalesce(product(1 - f) FILTER (WHERE kind = 'support'), 1) AS w FROM s{i} GROUP BY 1), "
            f"r{i + 1} AS (SELECT asm, base, base + base * least(0, coalesce(w, 0)) + (1 - base) * greatest(0, coalesce(w, 0)) AS v FROM r{i} LEFT JOIN w{i} ON target = asm)"
        )
    return ", ".join(steps)


_GRAPH = """b AS (SELECT s_suppkey AS asm, 0.3::DOUBLE + (s_suppkey % 5) / 10.0 AS base FROM supplier), e AS (SELECT s_suppkey AS target, CASE WHEN s_suppkey % 2 = 1 THEN 'attack' ELSE 'support' END AS kind, 0 AS edge, s_nationkey AS member FROM supplier
    UNION ALL SELECT s_suppkey, 'attack', 1, s_suppkey % 25 FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'attack', 1, s_suppkey % 7 FROM supplier WHERE s_suppkey % 3 = 0)"""


def _graph(spark, d):
    s = table(spark, d, "supplier")
    bases = s.select(F.col("s_suppkey").alias("asm"), (F.lit(0.3) + (F.col("s_suppkey") % 5) / 10.0).alias("base"))
    edge = lambda kind, i, member: s.select(F.col("s_suppkey").alias("target"), kind.alias("polarity"), F.lit(i).alias("edge_id"), member.cast("long").alias("member"))
    third = F.col("target") % 3 == 0
    edges = edge(F.when(F.col("s_suppkey") % 2 == 1, "attack").otherwise("support"), 0, F.col("s_nationkey")).union(edge(F.lit("attack"), 1, F.col("s_suppkey") % 25).where(third)).union(edge(F.lit("attack"), 1, F.col("s_suppkey") % 7).where(third))
    return bases, edges


@query("q43_strength_fixpoint", f"WITH {_GRAPH}, {_rounds(5)} SELECT asm, round(v, 4) AS strength FROM r5")
def strength_fixpoint(spark, d):
    """Five rounds on a hypergraph of suppliers."""
    from rulewright.operators.gradual import strengths

    return strengths(*_graph(spark, d), "prod-dfquad", rounds=5).select("asm", F.round("value", 4).alias("strength"))


@query("q120_converged_strengths", f"WITH {_GRAPH}, {_rounds(24)} SELECT asm, round(v, 2) AS strength FROM r24")
def converged_strengths(spark, d):
    """The same until no strength moves; two dozen plain rounds have come as far."""
    from rulewright.operators.gradual import strengths

    return strengths(*_graph(spark, d), "prod-dfquad", epsilon=1e-5).select("asm", F.round("value", 2).alias("strength"))


@query(
    "q44_claim_strength",
    "WITH s AS (SELECT s_nationkey AS atom, (s_suppkey % 97) / 100.0::DOUBLE AS v FROM supplier) SELECT atom, round(max(v), 4) AS strongest, round(min(v), 4) AS weakest, round(avg(v), 4) AS mean, round(1 - product(1 - v), 4) AS noisy_or FROM s GROUP BY atom",
)
def claim_strength(spark, d):
    from rulewright.operators.gradual import claim_strengths

    s = table(spark, d, "supplier")
    supported = s.select(F.col("s_nationkey").alias("atom"), F.array(F.col("s_suppkey")).alias("members"))
    strength = s.select(F.col("s_suppkey").alias("asm"), (F.col("s_suppkey") % 97 / 100.0).alias("value"))
    got = claim_strengths(supported, strength)
    return got.select("atom", *[F.round(c, 4).alias(c) for c in ("strongest", "weakest", "mean", "noisy_or")])


@query(
    "q45_base_score_fallback",
    """WITH n AS (SELECT *, 'p' || n_regionkey || '(' || n_nationkey || ')' AS asm FROM nation), r AS (SELECT n_regionkey, avg(CAST(n_nationkey % 5 <> 0 AS INT)) AS free FROM n GROUP BY 1)
    SELECT asm, round(CASE WHEN n_nationkey % 4 = 0 THEN 0.0 WHEN n.n_regionkey < 2 THEN n.n_regionkey / 10.0 ELSE r.free END, 4) AS base FROM n JOIN r ON n.n_regionkey = r.n_regionkey""",
)
def base_score_fallback(spark, d):
    """The score of the ground atom, else of its predicate, else the share of its predicate's atoms that nothing attacks."""
    from rulewright.operators.gradual import base_scores

    n = table(spark, d, "nation").withColumn("asm", F.concat(F.lit("p"), F.col("n_regionkey").cast("string"), F.lit("("), F.col("n_nationkey").cast("string"), F.lit(")")))
    ground = n.where("n_nationkey % 4 = 0").select("asm", F.lit(0.0).alias("score"))
    general = table(spark, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("pred"), (F.col("r_regionkey") / 10.0).alias("score"))
    return base_scores(n.select("asm"), ground, general, n.where("n_nationkey % 5 = 0").select("asm")).select("asm", F.round("base", 4).alias("base"))


_TREE = """n AS (SELECT 'n' || n_nationkey AS root, 's' || s_suppkey AS leaf, s_suppkey % 2 = 0 AS attack FROM nation JOIN supplier ON s_nationkey = n_nationkey)"""


@query(
    "q121_argument_trees",
    f"""WITH {_TREE}, v AS (SELECT root, coalesce(1 - product(1 - 0.5::DOUBLE) FILTER (WHERE NOT attack), 0) - coalesce(1 - product(1 - 0.5::DOUBLE) FILTER (WHERE attack), 0) AS d FROM n GROUP BY root), r AS (SELECT root, CASE WHEN abs(d) <= 1e-12 THEN 0.5 ELSE 0.5 + 0.5 * d END AS v FROM v)
    SELECT n.root, n.root || printf(' %.6f', max(r.v)) || chr(10) || string_agg('  ' || CASE WHEN attack THEN '- ' ELSE '+ ' END || leaf || ' 0.500000', chr(10) ORDER BY n.root || '/' || CASE WHEN attack THEN 'a' ELSE 's' END || ':' || leaf) AS text FROM n JOIN r ON n.root = r.root GROUP BY n.root""",
)
def argument_trees(spark, d):
    """Trees grown from attack and support edges, evaluated from the leaves and written as text."""
    from rulewright.operators.gradual import argument_tree, tree_strengths, tree_text

    s = table(spark, d, "supplier")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edges = s.select(name("n", "s_nationkey").alias("target"), F.when(F.col("s_suppkey") % 2 == 0, "attack").otherwise("support").alias("polarity"), name("s", "s_suppkey").alias("member"))
    nodes = argument_tree(edges.select(F.col("target").alias("asm")).distinct(), edges, 3).withColumn("base", F.lit(0.5))
    return tree_text(nodes, tree_strengths(nodes, 3))


@query(
    "q48_tree_strength",
    """WITH s AS (SELECT s_nationkey, product(1 - 0.4::DOUBLE) FILTER (WHERE s_suppkey % 2 = 0) a, product(1 - 0.4::DOUBLE) FILTER (WHERE s_suppkey % 2 = 1) p FROM supplier GROUP BY s_nationkey),
    n AS (SELECT n_nationkey, n_regionkey, coalesce(1 - p, 0) - coalesce(1 - a, 0) AS dd FROM nation LEFT JOIN s ON s_nationkey = n_nationkey),
    m AS (SELECT n_nationkey, n_regionkey, 0.5 + CASE WHEN dd < 0 THEN 0.5 * dd ELSE 0.5 * dd END AS v FROM n),
    r AS (SELECT n_regionkey, coalesce(1 - product(1 - v) FILTER (WHERE n_nationkey % 2 = 1), 0) - coalesce(1 - product(1 - v) FILTER (WHERE n_nationkey % 2 = 0), 0) AS dd FROM m GROUP BY n_regionkey)
    SELECT r_regionkey AS region, round(0.5 + 0.5 * coalesce(dd, 0), 4) AS strength FROM region LEFT JOIN r ON r_regionkey = n_regionkey""",
)
def tree_strength(spark, d):
    from rulewright.operators.gradual import tree_strengths

    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    role = lambda key: F.when(F.col(key) % 2 == 0, "attack").otherwise("support")
    r = table(spark, d, "region").select(node("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("role"), F.lit(0).alias("level"), F.lit(0.5).alias("base"))
    n = table(spark, d, "nation").select(node("n", "n_nationkey"), node("r", "n_regionkey"), role("n_nationkey"), F.lit(1), F.lit(0.5))
    s = table(spark, d, "supplier").select(node("s", "s_suppkey"), node("n", "s_nationkey"), role("s_suppkey"), F.lit(2), F.lit(0.4))
    got = tree_strengths(r.union(n).union(s), 2).where("node_id LIKE 'r%'")
    return got.select(F.regexp_replace("node_id", "^r", "").cast("int").alias("region"), F.round("value", 4).alias("strength"))


@query(
    "q49_crisp_vs_graded",
    f"""WITH {_TREE}, v AS (SELECT root, coalesce(1 - product(1 - 0.5::DOUBLE) FILTER (WHERE NOT attack), 0) - coalesce(1 - product(1 - 0.5::DOUBLE) FILTER (WHERE attack), 0) AS d FROM n GROUP BY root),
    c AS (SELECT 'n' || n_nationkey AS atom, CASE n_nationkey % 3 WHEN 0 THEN 'ALWAYS' WHEN 1 THEN 'FREE' ELSE 'NEVER' END AS crisp FROM nation)
    SELECT atom, crisp, round(coalesce(CASE WHEN abs(d) <= 1e-12 THEN 0.5 ELSE 0.5 + 0.5 * d END, 0), 4) AS strength, (crisp <> 'NEVER') = (round(coalesce(CASE WHEN abs(d) <= 1e-12 THEN 0.5 ELSE 0.5 + 0.5 * d END, 0), 4) >= 0.5) AS agree FROM c LEFT JOIN v ON root = atom""",
)
def crisp_vs_graded(spark, d):
    """Statuses beside tree strengths."""
    from rulewright.operators.gradual import against_crisp, argument_tree, tree_strengths

    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edges = table(spark, d, "supplier").select(name("n", "s_nationkey").alias("target"), F.when(F.col("s_suppkey") % 2 == 0, "attack").otherwise("support").alias("polarity"), name("s", "s_suppkey").alias("member"))
    nodes = argument_tree(edges.select(F.col("target").alias("asm")).distinct(), edges, 3).withColumn("base", F.lit(0.5))
    graded = tree_strengths(nodes, 3).where("node_id NOT LIKE '%/%'").select(F.col("node_id").alias("atom"), F.col("value").alias("strength"))
    status = F.when(F.col("n_nationkey") % 3 == 0, "ALWAYS").when(F.col("n_nationkey") % 3 == 1, "FREE").otherwise("NEVER")
    return against_crisp(table(spark, d, "nation").select(name("n", "n_nationkey").alias("atom"), status.alias("crisp")), graded)
