"""Gradual semantics: strengths over attack and support hypergraphs, and argument trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions import kernels as K
from rulewright.operators.store import settle


def step(strengths: DataFrame, edges: DataFrame, kernel: str) -> DataFrame:
    """One synchronous update. strengths: (asm, base, value, past); edges: (target, polarity, edge_id, member), no rows without members.

    past collects the values before.
    """
    together, balance, influence = K.KERNELS[kernel]
    # Dealt by the target once: both groupings and the join with the targets need no other exchange of the sets.
    reached = edges.join(strengths.select(F.col("asm").alias("member"), "value"), "member").repartition("target")
    sets = reached.groupBy("target", "polarity", "edge_id").agg(F.array_sort(F.collect_list("value")).alias("vs"))
    force = sets.withColumn("f", together(F.col("vs"))).groupBy("target").agg(
        F.array_sort(F.collect_list(F.when(F.col("polarity") == "attack", F.col("f")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("polarity") == "support", F.col("f")))).alias("s")
    )
    none = F.array().cast("array<double>")
    joined = strengths.join(force, strengths["asm"] == force["target"], "left")
    weight = balance(F.coalesce("a", none), F.coalesce("s", none))
    return joined.select("asm", "base", influence(F.col("base"), weight).alias("value"), F.concat("past", F.array("value")).alias("past"))


#: Rounds of one plan: a round reads the one before twice, so the plan is cut before it doubles too often.
ROUNDS = 3


def strengths(bases: DataFrame, edges: DataFrame, kernel: str = "prod-dfquad", epsilon: float = 1e-4, max_rounds: int = 500, rounds: int | None = None) -> DataFrame:
    """(asm, base, value): iterate from the base scores until no strength moves by epsilon, or for a fixed number of rounds.

    The values are those of the first round whose step is below epsilon; a few rounds run in one job and are looked back on.
    """
    none = F.array().cast("array<double>")
    now = bases.select("asm", "base", F.col("base").alias("value"), none.alias("past"))
    left = rounds if rounds is not None else max_rounds
    while left > 0:
        n = min(ROUNDS, left)
        left -= n
        for _ in range(n):
            now = step(now, edges, kernel)
        now = settle(now, "strengths")
        if rounds is None:
            line = F.concat("past", F.array("value"))
            moved = now.agg(*[F.max(F.abs(F.get(line, F.lit(i + 1)) - F.get(line, F.lit(i)))).alias(f"m{i}") for i in range(n)]).first()
            still = next((i for i, m in enumerate(moved) if m is None or m < epsilon), None)
            if still is not None:
                return now.select("asm", "base", F.get(line, F.lit(still + 1)).alias("value"))
        now = now.withColumn("past", none)
    return now.drop("past")


def claim_strengths(supported: DataFrame, strength: DataFrame, kernel: str = "prod-dfquad") -> DataFrame:
    """(atom, strongest, weakest, mean, noisy_or) over the supports of each atom; a support without members has strength 1."""
    together, _, _ = K.KERNELS[kernel]
    numbered = supported.withColumn("sid", F.array_join("members", "|"))
    members = numbered.select("atom", "sid", F.explode_outer("members").alias("asm"))
    each = members.join(strength.select("asm", "value"), "asm", "left").groupBy("atom", "sid").agg(F.array_sort(F.collect_list("value")).alias("vs")).withColumn("v", together(F.col("vs")))
    all_ = each.groupBy("atom").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return all_.select("atom", F.array_max("v").alias("strongest"), F.array_min("v").alias("weakest"), (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"), K.noisy_or(F.col("v")).alias("noisy_or"))


def tree_strengths(nodes: DataFrame, depth: int) -> DataFrame:
    """(node_id, value) of argument trees, from the deepest level up. nodes: (node_id, parent_id, role, level, base).

    Attackers and supporters of a node are combined by 1 - product of 1 - v, and move its base score by their surplus.
    """
    done = None
    for level in range(depth, -1, -1):
        own = nodes.where(F.col("level") == level)
        if done is None:
            now = own.select("node_id", "parent_id", "role", F.col("base").alias("value"))
            done = now
            below = now
            continue
        force = below.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "attack", F.col("value")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("role") == "support", F.col("value")))).alias("s"))
        none = F.array().cast("array<double>")
        j = own.join(force.withColumnRenamed("parent_id", "__p"), own["node_id"] == F.col("__p"), "left")
        now = j.select("node_id", "parent_id", "role", K.combine(F.col("base"), K.noisy_or(F.coalesce("a", none)), K.noisy_or(F.coalesce("s", none))).alias("value"))
        done, below = done.unionByName(now), now
    return done.select("node_id", "value")


def contested(bases: DataFrame, edges: DataFrame, asm: str, new_base: float, kernel: str = "prod-dfquad", **limits) -> DataFrame:
    """(asm, before, after, moved): strengths before and after one base score is changed."""
    before = strengths(bases, edges, kernel, **limits).select("asm", F.col("value").alias("before"))
    changed = bases.withColumn("base", F.when(F.col("asm") == asm, F.lit(float(new_base))).otherwise(F.col("base")))
    after = strengths(changed, edges, kernel, **limits).select("asm", F.col("value").alias("after"))
    return before.join(after, "asm").withColumn("moved", F.signum(F.round(F.col("after") - F.col("before"), 9)).cast("int"))


def unattacked_share(assumptions: DataFrame, attacked: DataFrame) -> DataFrame:
    """(pred, score): of the ground assumptions of each predicate the share that nothing attacks."""
    keyed = assumptions.withColumn("pred", F.regexp_extract("asm", r"^(\w+)", 1))
    hit = attacked.select("asm").distinct().withColumn("__hit", F.lit(1))
    return keyed.join(hit, "asm", "left").groupBy("pred").agg(F.avg(F.col("__hit").isNull().cast("double")).alias("score"))


def base_scores(assumptions: DataFrame, ground: DataFrame, by_predicate: DataFrame, attacked: DataFrame) -> DataFrame:
    """(asm, base): the score of the ground atom, else of its predicate, else the share of the predicate's atoms that nothing
    attacks; a score of 0 counts as given. attacked: (asm)."""
    keyed = assumptions.withColumn("pred", F.regexp_extract("asm", r"^(\w+)", 1))
    own, general = ground.select("asm", F.col("score").alias("own")), by_predicate.select("pred", F.col("score").alias("general"))
    rest = unattacked_share(assumptions, attacked).withColumnRenamed("score", "rest")
    return keyed.join(own, "asm", "left").join(general, "pred", "left").join(rest, "pred").select("asm", F.coalesce("own", "general", "rest").alias("base"))


def argument_tree(roots: DataFrame, edges: DataFrame, depth: int = 8) -> DataFrame:
    """Nodes (node_id, parent_id, asm, role, level, path) of trees grown level by level; an assumption never repeats on a path.

    roots: (asm); edges: (target, polarity, member).
    """
    level = roots.select(F.col("asm").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "asm", F.lit("root").alias("role"), F.lit(0).alias("level"), F.array("asm").alias("path"))
    out = level
    for i in range(1, depth + 1):
        grown = level.join(edges, level["asm"] == edges["target"]).where(~F.array_contains("path", F.col("member")))
        level = grown.select(F.concat_ws("/", "node_id", F.concat(F.substring("polarity", 1, 1), F.lit(":"), F.col("member"))).alias("node_id"), F.col("node_id").alias("parent_id"), F.col("member").alias("asm"), F.col("polarity").alias("role"), F.lit(i).alias("level"), F.concat("path", F.array("member")).alias("path"))
        out = out.unionByName(level)
    return out


def tree_text(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(root, text): every tree as indented lines in the order of its paths: role, assumption and strength."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.when(F.col("role") == "root", "").when(F.col("role") == "attack", "- ").otherwise("+ "), "asm", F.format_string(" %.6f", F.col("value")))
    rows = nodes.join(values, "node_id").select(F.get("path", F.lit(0)).alias("root"), "node_id", line.alias("line"))
    return rows.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


def against_crisp(crisp: DataFrame, graded: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(atom, crisp, strength, agree): statuses beside strengths; they agree where an atom that some extension has reaches the threshold."""
    both = crisp.join(graded, "atom", "left").withColumn("strength", F.round(F.coalesce("strength", F.lit(0.0)), 4))
    return both.select("atom", "crisp", "strength", (F.col("crisp").isin("ALWAYS", "FREE") == (F.col("strength") >= threshold)).alias("agree"))


class Gradual:
    """A ground framework: supports, attack and support edges, strengths and claims, each worked out once when it is asked for.

    rules: (head, body); assumptions: (asm, contrary, base).
    """

    def __init__(self, rules: DataFrame, assumptions: DataFrame, max_set_size: int | None = None, cap: int = 256):
        self.rules, self.assumptions, self.max_set_size, self.cap = rules, assumptions, max_set_size, cap
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = settle(make(), name)
        return self._kept[name]

    @property
    def supports(self) -> DataFrame:
        from rulewright.operators.grounding import supports

        return self._once("supports", lambda: supports(self.rules, self.assumptions.select("asm"), self.cap, max_set_size=self.max_set_size))

    @property
    def edges(self) -> DataFrame:
        """(target, polarity, edge_id, member)."""
        from rulewright.operators.grounding import attack_edges

        sets = attack_edges(self.supports, self.assumptions.select("asm", "contrary"))
        return self._once("edges", lambda: sets.select("target", "polarity", F.array_join("members", "|").alias("edge_id"), F.explode_outer("members").alias("member")))

    def strengths(self, kernel: str = "prod-dfquad", **limits) -> DataFrame:
        return self._once(f"strengths-{kernel}", lambda: strengths(self.assumptions.select("asm", "base"), self.edges, kernel, **limits))

    def claims(self, kernel: str = "prod-dfquad", **limits) -> DataFrame:
        return claim_strengths(self.supports, self.strengths(kernel, **limits), kernel)


RULE_ROW = "fw long, kind string, head string, body array<string>"


def random_frameworks(spark, n: int, atoms: int = 6, assumptions: int = 3, rules: int = 8, longest: int = 2, flat: bool = True, seed: int = 0) -> DataFrame:
    """Rows of n random frameworks, each from its own seed: kind rule (head, body) and kind contrary (assumption, [contrary]).

    Rules may go round in cycles; where flat is false an assumption may be a head.
    """
    import random
    from collections.abc import Iterator

    import pandas as pd

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fw in map(int, batch["id"]):
                rnd = random.Random(f"{seed}|{fw}")
                own, other = [f"a{i}" for i in range(assumptions)], [f"p{i}" for i in range(atoms)]
                heads = other if flat else other + own
                rows += [(fw, "contrary", a, [rnd.choice(other)]) for a in own]
                rows += [(fw, "rule", rnd.choice(heads), sorted(rnd.sample(own + other, rnd.randint(0, longest)))) for _ in range(rules)]
            yield pd.DataFrame(rows, columns=["fw", "kind", "head", "body"])

    return spark.range(n).mapInPandas(work, RULE_ROW)


CONVERGED = "fw long, kernel string, init double, converged boolean, steps int"


def convergence(frameworks: DataFrame, inits: tuple[float, ...] = (0.5, 0.9), epsilon: float = 1e-4, max_rounds: int = 500) -> DataFrame:
    """(fw, kernel, init, converged, steps): rounds until no strength moves by epsilon, for each kernel and base score; a framework
    is one group, which its own rules bound."""
    import pandas as pd

    from rulewright.operators.structure import minimal_supports

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        against = {h: b[0] for h, b, k in zip(rows["head"], rows["body"], rows["kind"], strict=True) if k == "contrary"}
        family = minimal_supports([(h, frozenset(b)) for h, b, k in zip(rows["head"], rows["body"], rows["kind"], strict=True) if k == "rule"], list(against))
        edges = {a: ([sorted(s) for s in family.get(c, ())], [sorted(s) for s in family[a] if s != {a}]) for a, c in sorted(against.items())}
        out = []
        for kernel in sorted(K.KERNELS):
            for init in inits:
                value, steps = dict.fromkeys(edges, init), 0
                moved = 1.0
                while moved >= epsilon and steps < max_rounds:
                    after = {a: K.plain(kernel, init, [[value[m] for m in s] for s in attack], [[value[m] for m in s] for s in support]) for a, (attack, support) in edges.items()}
                    moved, value, steps = max(abs(after[a] - value[a]) for a in value), after, steps + 1
                out.append((int(rows["fw"].iloc[0]), kernel, init, moved < epsilon, steps))
        return pd.DataFrame(out, columns=["fw", "kernel", "init", "converged", "steps"])

    return frameworks.groupBy("fw").applyInPandas(work, CONVERGED)


def convergence_rates(rows: DataFrame) -> DataFrame:
    """(kernel, init, n, rate, mean_steps) over frameworks; steps of the converged ones."""
    return rows.groupBy("kernel", "init").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("converged").cast("double")), 4).alias("rate"), F.round(F.avg(F.when(F.col("converged"), F.col("steps"))), 4).alias("mean_steps"))
