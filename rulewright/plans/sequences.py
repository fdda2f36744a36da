"""Window, set and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.plans._registry import query, table

@query(
    "q27_running_on_path",
    "SELECT user_id, event_id, coalesce(min(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS on_path FROM events",
)
def running_on_path(spark, d):
    from rulewright.operators.windows import still_on_path

    e = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("same"))
    return still_on_path(e, ["user_id"], ["ts", "event_id"], "same").select("user_id", "event_id", "on_path")


@query("q28_event_counter", "SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS counter FROM events")
def event_counter(spark, d):
    from rulewright.operators.windows import counter

    return counter(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("user_id", "event_id", "counter")


@query("q29_first_wrong", "SELECT user_id, arg_min(event_id, row(ts, event_id)) AS first_wrong, count(*) AS wrong FROM events WHERE event_type = 'error' GROUP BY user_id")
def first_wrong(spark, d):
    from rulewright.operators.windows import first_where

    return first_where(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "event_id", "first_wrong", "wrong")


@query(
    "q30_first_n_per_group",
    "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s|' || o_orderkey), o_orderkey) i FROM orders) WHERE i <= 5",
)
def first_n_per_group(spark, d):
    from rulewright.operators.windows import seeded_sample

    return seeded_sample(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 5, "s").select("o_orderpriority", "o_orderkey")


@query(
    "q31_common_prefix_share",
    """WITH w AS (SELECT item_id, string_split(text, ' ') a FROM benchmark), p AS (SELECT x.item_id AS left_id, y.item_id AS right_id, x.a AS a, y.a AS b FROM w x JOIN w y ON y.item_id = x.item_id + 1)
    SELECT left_id, right_id, round(coalesce((SELECT min(i) FROM range(0, least(len(a), len(b))) t(i) WHERE a[i + 1] <> b[i + 1]), least(len(a), len(b))) / greatest(len(a), 1)::DOUBLE, 4) AS prefix_share FROM p""",
)
def common_prefix_share(spark, d):
    from rulewright.operators.sequences import prefix_share

    w = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("a"))
    pairs = w.select(F.col("item_id").alias("left_id"), "a").join(w.select((F.col("item_id") - 1).alias("left_id"), F.col("item_id").alias("right_id"), F.col("a").alias("b")), "left_id")
    return pairs.select("left_id", "right_id", F.round(prefix_share(F.col("a"), F.col("b")), 4).alias("prefix_share"))


@query(
    "q32_set_prf",
    """WITH w AS (SELECT DISTINCT conv_id, role, unnest(string_split(lower(text), ' ')) w FROM conversations WHERE role IN ('user', 'assistant')),
    c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') g, count(*) FILTER (WHERE role = 'assistant') p FROM w GROUP BY conv_id),
    h AS (SELECT a.conv_id, count(*) h FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.w = b.w WHERE a.role = 'user' AND b.role = 'assistant' GROUP BY a.conv_id)
    SELECT c.conv_id, round(CASE WHEN p = 0 THEN 0.0 ELSE coalesce(h, 0) / p::DOUBLE END, 4) AS "precision", round(CASE WHEN g = 0 THEN 0.0 ELSE coalesce(h, 0) / g::DOUBLE END, 4) AS recall,
    round(CASE WHEN p + g = 0 THEN 0.0 ELSE 2 * coalesce(h, 0) / (p + g)::DOUBLE END, 4) AS f1 FROM c LEFT JOIN h ON c.conv_id = h.conv_id""",
)
def set_prf(spark, d):
    from rulewright.operators.sequences import precision_recall

    words = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "role", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    sets = words.groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "user", F.col("w"))).alias("gold"), F.collect_set(F.when(F.col("role") == "assistant", F.col("w"))).alias("said"))
    p, r, f = precision_recall(F.col("said"), F.col("gold"))
    return sets.select("conv_id", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


@query(
    "q33_minimal_antichain",
    """WITH s AS (SELECT DISTINCT l_orderkey % 200 AS g, l_orderkey AS k, list_sort(list(DISTINCT l_partkey % 12)) AS a FROM lineitem GROUP BY l_orderkey), u AS (SELECT DISTINCT g, a FROM s)
    SELECT g, array_to_string(a, ',') AS members FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.g = x.g AND len(y.a) < len(x.a) AND list_has_all(x.a, y.a))""",
)
def minimal_antichain(spark, d):
    from rulewright.operators.sequences import antichain

    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 12)).alias("a"))
    return antichain(rows.select((F.col("l_orderkey") % 200).alias("g"), "a"), ["g"], "a").select("g", F.array_join("a", ",").alias("members"))


@query(
    "q34_lcs_alignment",
    """WITH RECURSIVE u AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a FROM events GROUP BY user_id), p AS (SELECT x.user_id, x.a, y.a AS b FROM u x JOIN u y ON y.user_id = x.user_id + 1),
    l AS (SELECT user_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS r FROM p
      UNION ALL SELECT user_id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: greatest(r[j], coalesce(list_max(list_transform(range(1, j), lambda k: r[k] + CAST(b[k] = a[i + 1] AS INT))), 0))) FROM l WHERE i < len(a))
    SELECT user_id, CAST(max(r[len(b) + 1]) AS INT) AS lcs, CAST(max(len(a)) AS INT) AS n_left, CAST(max(len(b)) AS INT) AS n_right FROM l WHERE i = len(a) GROUP BY user_id""",
)
def lcs_alignment(spark, d):
    """Aligned length of the event types of each user and the next one."""
    from rulewright.operators.sequences import lcs_length

    seqs = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("a"))
    pairs = seqs.join(seqs.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id")
    return pairs.select("user_id", lcs_length(F.col("a"), F.col("b")).alias("lcs"), F.size("a").alias("n_left"), F.size("b").alias("n_right"))


@query("q75_support_cap", "SELECT o_custkey AS atom, array_to_string(m, ',') AS members FROM (SELECT o_custkey, m, row_number() OVER (PARTITION BY o_custkey ORDER BY len(m), m) AS i FROM (SELECT DISTINCT o_custkey, list_sort(list_distinct([o_orderkey % 7, o_orderkey % 5])) AS m FROM orders)) WHERE i <= 4")
def support_cap(spark, d):
    """At most four sets of an atom, the smallest first."""
    from rulewright.operators.grounding import capped

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("atom"), F.array_sort(F.array_distinct(F.array(F.col("o_orderkey") % 7, F.col("o_orderkey") % 5))).alias("members")).distinct()
    return capped(rows, 4).select("atom", F.array_join("members", ",").alias("members"))


@query("q76_sort_dom_last", "SELECT string_agg(event_type, ',' ORDER BY event_type = 'error', event_type) AS places FROM (SELECT DISTINCT event_type FROM events)")
def sort_dom_last(spark, d):
    """Distinct values in their order, one of them last."""
    from rulewright.operators.summaries import sorted_last

    kinds = table(spark, d, "events").select("event_type").distinct()
    ordered = kinds.agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sorted_last(F.col("event_type"), "error"))]))).alias("x"))
    return ordered.select(F.array_join(F.transform("x", lambda v: v["k1"]), ",").alias("places"))


@query("q77_interleaved_ids", "SELECT o_orderkey, CAST(2 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS BIGINT) AS stable_id FROM orders")
def interleaved_ids(spark, d):
    from rulewright.operators.summaries import stable_ids

    return stable_ids(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)).select("o_orderkey", "stable_id")


@query("q78_epoch_order", "SELECT e.epoch, doc_id, CAST(row_number() OVER (PARTITION BY e.epoch ORDER BY md5('e|' || e.epoch || '|' || doc_id), doc_id) AS BIGINT) AS place FROM labels, (VALUES (0), (1), (2)) e(epoch)")
def epoch_permutation(spark, d):
    from rulewright.operators.summaries import epoch_order

    return epoch_order(table(spark, d, "labels"), "doc_id", 3, "e")


@query("q79_echo_toggle", "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'none') AS region FROM conversations")
def echo_toggle(spark, d):
    from rulewright.operators.windows import toggled

    got = toggled(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") != "assistant", F.col("role")), "region")
    return got.select("conv_id", "turn", F.coalesce("region", F.lit("none")).alias("region"))


@query("q80_first_check", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first_check, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS rank FROM events")
def first_check(spark, d):
    from rulewright.operators.windows import ranked_first

    return ranked_first(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_id", F.col("first").alias("first_check"), "rank")


@query("q81_multiset_equality", "WITH s AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS a, list_sort(list(l_linestatus)) AS b FROM lineitem GROUP BY l_orderkey) SELECT a = list_transform(b, lambda x: CASE WHEN x = 'O' THEN 'R' ELSE 'A' END) AS same, count(*) AS n FROM s GROUP BY 1")
def multiset_equality(spark, d):
    """Whether two bags of an order are equal, whatever their order."""
    from rulewright.operators.sequences import equal_multisets

    bags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(F.when(F.col("l_linestatus") == "O", "R").otherwise("A")).alias("b"))
    return bags.groupBy(equal_multisets(F.col("a"), F.col("b")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("q82_union_by_id", "SELECT id, min(src) AS src FROM (SELECT doc_id AS id, '0 documents' AS src FROM documents UNION ALL SELECT item_id, '1 benchmark' FROM benchmark UNION ALL SELECT page_id, '2 pages' FROM pages) GROUP BY id")
def union_by_id(spark, d):
    """Rows of several sources by id; the first source that has an id gives its row."""
    from rulewright.operators.sequences import first_by_id

    of = lambda name, key, label: table(spark, d, name).select(F.col(key).alias("id"), F.lit(label).alias("src"))
    return first_by_id([of("documents", "doc_id", "0 documents"), of("benchmark", "item_id", "1 benchmark"), of("pages", "page_id", "2 pages")], "id")


@query("q119_recall_by_symbol", "WITH s AS (SELECT user_id, event_type AS symbol, event_id % 5 AS k, event_id % 2 = 0 AS gold FROM events), g AS (SELECT DISTINCT user_id, symbol, k FROM s WHERE gold), a AS (SELECT DISTINCT user_id, symbol, k FROM s WHERE NOT gold) SELECT g.user_id, g.symbol, round(avg(CAST(a.k IS NOT NULL AS INT)), 4) AS recall FROM g LEFT JOIN a ON a.user_id = g.user_id AND a.symbol = g.symbol AND a.k = g.k GROUP BY 1, 2")
def recall_by_symbol(spark, d):
    """Recall of each symbol of a group."""
    from rulewright.operators.sequences import recall_by

    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("symbol"), (F.col("event_id") % 5).alias("k"), (F.col("event_id") % 2 == 0).alias("gold"))
    return recall_by(e.where("NOT gold"), e.where("gold"), ["user_id", "symbol"], "k")
