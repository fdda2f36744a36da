"""Rule-reasoning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.operators import extensions, grounding
from rulewright.plans._registry import query, table


@query("q01_defeasible_rule", "SELECT c_custkey FROM customer c WHERE c_acctbal > 5000 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def defeasible_rule(spark, d):
    """good(c) <- key(c), not exc(c): the single extension of a stratified framework is an anti join."""
    key = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey")
    exc = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return key.join(exc, "c_custkey", "left_anti")


@query(
    "q02_nested_exception",
    """WITH exc2 AS (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
    exc AS (SELECT DISTINCT o_custkey FROM orders o WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM exc2 e WHERE e.o_orderkey = o.o_orderkey))
    SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM exc)""",
)
def nested_exception(spark, d):
    """An exception counts unless an exception to it holds."""
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    exc = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey").join(returned, "o_orderkey", "left_anti")
    return table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey").join(exc.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    "q03_two_path_rule",
    """SELECT c_custkey FROM customer WHERE c_acctbal > 8000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""",
)
def two_path_rule(spark, d):
    """Two rules for one head, each with its own exception."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    late = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    dear = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    one = c.where("c_acctbal > 8000").select("c_custkey").join(late, "c_custkey", "left_anti")
    return one.union(c.where("c_mktsegment = 'BUILDING'").select("c_custkey").join(dear, "c_custkey", "left_anti")).distinct()


def _cycle(spark, d):
    """Suppliers as components: alpha and beta attack each other under conditions of the row."""
    s = table(spark, d, "supplier")
    rule = lambda h, b: F.struct(F.lit(h).alias("head"), F.array(*[F.lit(x) for x in b]).alias("body"))
    asm = lambda a, c: F.struct(F.lit(a).alias("asm"), F.lit(c).alias("contrary"))
    facts = F.filter(F.array(F.when(F.col("s_acctbal") > 0, F.lit("rich")), F.when(F.col("s_suppkey") % 2 == 0, F.lit("even"))), lambda x: x.isNotNull())
    return s.select(
        F.lit("f").alias("fw"), F.col("s_suppkey").alias("const"), F.col("s_nationkey"), facts.alias("facts"),
        F.array(rule("c_alpha", ["rich", "beta"]), rule("c_beta", ["even", "alpha"])).alias("rules"), F.array(asm("alpha", "c_alpha"), asm("beta", "c_beta")).alias("assumptions"),
        F.array().cast("array<string>").alias("must"), F.array().cast("array<string>").alias("never"), F.lit("alpha").alias("query"),
    )


@query("q04_even_cycle_status", "SELECT s_suppkey AS const, CASE WHEN s_acctbal > 0 AND s_suppkey % 2 = 0 THEN 'FREE' WHEN s_acctbal > 0 THEN 'NEVER' ELSE 'ALWAYS' END AS status FROM supplier")
def even_cycle_status(spark, d):
    return extensions.status(_cycle(spark, d), ["fw"], "const", "must", "never", "query").select("const", "status")


@query("q05_min_fact_cover", "SELECT s_suppkey AS const, CAST(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS cost, CASE WHEN s_acctbal > 0 THEN 'c_beta' ELSE '' END AS added FROM supplier")
def min_fact_cover(spark, d):
    """Fewest facts that leave alpha accepted whatever beta: alpha must hold and beta must not, if it attacks."""
    c = _cycle(spark, d).withColumn("must", F.array(F.lit("alpha"))).withColumn("never", F.when(F.array_contains("facts", "rich"), F.array(F.lit("beta"))))
    c = c.withColumn("facts", F.filter("facts", lambda x: x != "even")).withColumn("learnable", F.array(F.lit("c_beta"), F.lit("spare")))
    return extensions.fewest_facts(c, "learnable", "must", "never").select("const", F.col("cost").cast("long").alias("cost"), F.array_join("added", ",").alias("added"))


@query(
    "q06_fold_candidates",
    """WITH f AS (SELECT DISTINCT p_partkey k FROM part WHERE p_size > 45), b AS (SELECT p_brand pred, p_partkey k, 0 pos FROM part UNION ALL SELECT split_part(p_type, ' ', 1), p_partkey, 1 FROM part)
    SELECT f.k AS const, coalesce(b.pred, 'dom') AS pred, row_number() OVER (PARTITION BY f.k ORDER BY b.pos NULLS LAST, b.pred) - 1 AS rank FROM (SELECT k FROM f) f JOIN (SELECT k, pred, min(pos) pos FROM b GROUP BY k, pred UNION ALL SELECT k, NULL, NULL FROM f) b ON f.k = b.k""",
)
def fold_candidates(spark, d):
    p = table(spark, d, "part")
    facts = p.where("p_size > 45").select(F.lit("big").alias("head"), F.col("p_partkey").alias("const"))
    background = p.select(F.col("p_brand").alias("pred"), F.col("p_partkey").alias("const"), F.lit(0).alias("pos")).union(p.select(F.split("p_type", " ")[0], "p_partkey", F.lit(1)))
    return grounding.fold_candidates(facts, background).select("const", "pred", "rank")


@query(
    "q07_relative_assumption",
    """WITH b AS (SELECT p_brand body_id, list(DISTINCT 's' || p_size % 10) body FROM part GROUP BY p_brand), r AS (SELECT 'a' || (i % 4) asm, ['s' || i, 's' || (i + 1) % 10] rest FROM range(10) t(i))
    SELECT DISTINCT body_id, asm FROM b, r WHERE list_has_all(body, rest)""",
)
def relative_assumption(spark, d):
    bodies = table(spark, d, "part").groupBy(F.col("p_brand").alias("body_id")).agg(F.collect_set(F.concat(F.lit("s"), (F.col("p_size") % 10).cast("string"))).alias("body"))
    rules = spark.range(10).select(F.concat(F.lit("a"), (F.col("id") % 4).cast("string")).alias("asm"), F.array(F.concat(F.lit("s"), F.col("id").cast("string")), F.concat(F.lit("s"), ((F.col("id") + 1) % 10).cast("string"))).alias("rest"))
    return grounding.relative_assumptions(bodies, rules)


#: Rules of one and two variables with equalities and comparisons.
_RULES = [(0, "near(X,Y)", ["in(X,Z)", "in(Y,Z)", "X != Y", "Z = r1"]), (1, "good(X)", ["big(X)", "dom(X)", "X < 10"]), (2, "twin(X,Y)", ["X = Y", "Y = 7"]), (3, "never(X)", ["1 = 2"]), (4, "plain", [])]


@query(
    "q46_grounding",
    """WITH c AS (SELECT CAST(n_nationkey AS VARCHAR) AS c, n_nationkey AS k, n_regionkey AS fw FROM nation) SELECT x.fw, 0 AS rule_id, 'near(' || x.c || ',' || y.c || ')' AS head, 'in(' || x.c || ',r1)|in(' || y.c || ',r1)' AS body FROM c x JOIN c y ON x.fw = y.fw WHERE x.k <> y.k
    UNION ALL SELECT fw, 1, 'good(' || c || ')', 'big(' || c || ')' FROM c WHERE k < 10 UNION ALL SELECT r_regionkey, 2, 'twin(7,7)', '' FROM region UNION ALL SELECT r_regionkey, 4, 'plain', '' FROM region""",
)
def ground_rules(spark, d):
    """A framework for each region, its nations as constants."""
    rules = spark.createDataFrame(_RULES, "rule_id int, head string, body array<string>")
    mine = table(spark, d, "region").select(F.col("r_regionkey").alias("fw")).crossJoin(F.broadcast(rules))  # literal rules
    domain = table(spark, d, "nation").select(F.col("n_regionkey").alias("fw"), F.col("n_nationkey").cast("string").alias("const"))
    return grounding.ground(mine, domain, ["fw"]).select("fw", "rule_id", "head", F.array_join("body", "|").alias("body"))


@query(
    "q47_support_fixpoint",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || c_nationkey AS h, 'n' || c_nationkey AS b1, 'm' || c_mktsegment AS b2 FROM customer), a AS (SELECT DISTINCT 'n' || c_nationkey AS x FROM customer WHERE c_nationkey % 3 <> 0 UNION SELECT DISTINCT 'm' || c_mktsegment FROM customer),
    u AS (SELECT h, list_sort([b1, b2]) AS m FROM e JOIN a p ON b1 = p.x JOIN a q ON b2 = q.x), t AS (SELECT 'top' AS h, m FROM u WHERE h IN ('c1', 'c2')), s AS (SELECT x AS h, [x] AS m FROM a UNION SELECT * FROM u UNION SELECT * FROM t)
    SELECT h AS atom, array_to_string(m, ',') AS members FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.h = x.h AND len(y.m) < len(x.m) AND list_has_all(x.m, y.m))""",
)
def support_fixpoint(spark, d):
    """Supports of the nations of customers: a rule for each pair of nation and segment, and one more level above two of them."""
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    top = spark.createDataFrame([("top", ["c1"]), ("top", ["c2"]), ("loop", ["loop"])], "head string, body array<string>")
    rules = c.select(name("c", "c_nationkey").alias("head"), F.array(name("n", "c_nationkey"), name("m", "c_mktsegment")).alias("body")).union(top)
    assumptions = c.where("c_nationkey % 3 <> 0").select(name("n", "c_nationkey").alias("asm")).union(c.select(name("m", "c_mktsegment"))).distinct()
    return grounding.supports(rules, assumptions).select("atom", F.array_join("members", ",").alias("members"))


@query(
    "q122_attack_edges",
    "SELECT 'n' || n_nationkey AS target, 'attack' AS polarity, 'n' || ((n_nationkey + 1) % 25) AS members FROM nation UNION ALL SELECT 'n' || n_nationkey, 'support', 'n' || ((n_nationkey + 2) % 25) FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'n' || ((n_nationkey + 24) % 25), 'attack', 'n' || ((n_nationkey + 2) % 25) FROM nation WHERE n_nationkey % 4 = 0",
)
def attack_edges(spark, d):
    """A ring in which each assumption's contrary follows from the next one, and every fourth one also follows from the one after."""
    from rulewright.operators.gradual import Gradual

    n = table(spark, d, "nation")
    name = lambda kind, shift: F.concat(F.lit(kind), ((F.col("n_nationkey") + shift) % 25).cast("string"))
    rules = n.select(name("c", 0).alias("head"), F.array(name("n", 1)).alias("body")).union(n.where("n_nationkey % 4 = 0").select(name("n", 0), F.array(name("n", 2))))
    g = Gradual(rules, n.select(name("n", 0).alias("asm"), name("c", 0).alias("contrary"), F.lit(0.5).alias("base")), max_set_size=1)
    return grounding.attack_edges(g.supports, g.assumptions).select("target", "polarity", F.array_join("members", ",").alias("members"))


@query(
    "q50_wl_signature",
    """WITH e AS (SELECT l_orderkey g, 'o' a, 'p' || l_linenumber b, l_returnflag c FROM lineitem), r1 AS (SELECT g, b, md5(c || '|' || 'o') AS c FROM e),
    s AS (SELECT g, md5(string_agg(c, ',' ORDER BY c)) sig FROM r1 GROUP BY g) SELECT sig, count(*) AS n FROM s GROUP BY sig""",
)
def wl_signature(spark, d):
    from rulewright.operators.signature import one_round

    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.lit("o").alias("near"), F.col("l_returnflag").alias("colour"))
    return one_round(nodes).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
