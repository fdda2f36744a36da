"""Folds, relative assumptions, grounding and supports as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators.sequences import antichain


def fold_candidates(facts: DataFrame, background: DataFrame) -> DataFrame:
    """(head, const, pos, pred): background predicates that hold of the constant of each fact, in their order; dom comes last.

    facts: (head, const); background: (pred, const, pos). A predicate that is offered twice keeps its first place.
    """
    own = facts.join(background, "const").groupBy("head", "const", "pred").agg(F.min("pos").alias("pos"))
    dom = facts.select("head", "const", F.lit("dom").alias("pred"), F.lit(2147483647).alias("pos"))
    w = Window.partitionBy("head", "const").orderBy("pos", "pred")
    return own.select("head", "const", "pred", "pos").unionByName(dom).withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def relative_assumptions(bodies: DataFrame, rules: DataFrame) -> DataFrame:
    """(body_id, asm): assumptions of rules whose other body atoms all lie in a body.

    bodies: (body_id, body); rules: (asm, rest). Pairs meet on one atom of the rest (an empty rest meets every body).
    """
    keyed = rules.withColumn("__k", F.get("rest", F.lit(0)))
    b = bodies.select("body_id", "body", F.explode("body").alias("__k"))
    met = b.join(keyed.where("__k IS NOT NULL"), "__k").where(F.size(F.array_except("rest", "body")) == 0).select("body_id", "asm")
    free = keyed.where("__k IS NULL").select("asm").distinct()
    return met.union(bodies.select("body_id").crossJoin(F.broadcast(free))).distinct()


_VAR = r"\b[A-Z]\w*\b"
_EQUAL = r"^\s*(\w+)\s*={1,2}\s*(\w+)\s*$"
_COMPARE = r"^\s*(-?\w+)\s*(!=|<=|>=|<|>)\s*(-?\w+)\s*$"


def _whole(term) -> F.Column:
    return F.concat(F.lit(r"\b"), term, F.lit(r"\b"))


def _put(text, term, value):
    return F.regexp_replace(text, _whole(term), value)


def ground(rules: DataFrame, domain: DataFrame, fw: list[str] = ()) -> DataFrame:
    """(fw.., rule_id, head, body): instances of rules of any number of variables over the domain of their framework.

    rules: (fw.., rule_id, head, body); domain: (fw.., const). Equalities bind first, so a bound variable is never joined with
    the domain; each variable that is left is one join with the domain of its framework. Comparisons are decided, numbers
    before names; dom(..) only ranges. Two different constants that a rule equates leave no instance.
    """
    texts = F.concat(F.array("head"), F.col("body"))
    equal = F.filter("body", lambda x: x.rlike(_EQUAL))

    def bind(acc, e):
        now = F.aggregate(acc["done"], e, lambda t, d: _put(t, d["v"], d["c"]))
        a, b = F.regexp_extract(now, _EQUAL, 1), F.regexp_extract(now, _EQUAL, 2)
        step = F.when(a.rlike("^[A-Z]"), F.struct(a.alias("v"), b.alias("c"))).when(b.rlike("^[A-Z]"), F.struct(b.alias("v"), a.alias("c")))
        same = a == b
        return F.struct(F.when(same | step.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(step))).alias("done"), (acc["ok"] & (same | step.isNotNull())).alias("ok"))

    start = F.struct(F.array().cast("array<struct<v:string,c:string>>").alias("done"), F.lit(True).alias("ok"))
    rows = rules.withColumn("__e", F.aggregate(equal, start, bind)).where("__e.ok")
    swap = lambda x: F.aggregate(F.col("__e.done"), x, lambda t, d: _put(t, d["v"], d["c"]))
    rows = rows.withColumn("__t", F.transform(texts, swap))
    rows = rows.withColumn("__v", F.array_distinct(F.flatten(F.transform("__t", lambda x: F.regexp_extract_all(x, F.lit(_VAR), F.lit(0)))))).select(*fw, "rule_id", "__t", "__v")
    most = rows.agg(F.max(F.size("__v"))).first()[0] or 0  # variables of a rule: a property of the rules, not of the data
    done = rows.where(F.size("__v") == 0)
    for i in range(most):
        rows = rows.where(F.size("__v") > i)
        rows = rows.join(domain, list(fw)) if fw else rows.crossJoin(domain)  # grounding is this product
        rows = rows.withColumn("__t", F.transform("__t", lambda x: _put(x, F.get("__v", F.lit(i)), F.col("const")))).drop("const")  # noqa: B023
        done = done.unionByName(rows.where(F.size("__v") == i + 1))
    number = lambda x: F.when(x.rlike(r"^-?\d+$"), x.cast("bigint"))

    def decided(x):
        a, o, b = F.regexp_extract(x, _COMPARE, 1), F.regexp_extract(x, _COMPARE, 2), F.regexp_extract(x, _COMPARE, 3)
        low, high = F.struct(number(a).isNull(), number(a), a), F.struct(number(b).isNull(), number(b), b)
        return F.when(o == "!=", a != b).when(o == "<=", low <= high).when(o == ">=", low >= high).when(o == "<", low < high).otherwise(low > high)

    body = F.slice("__t", F.lit(2), F.size("__t") - 1)
    kept = done.where(F.forall(F.filter(body, lambda x: x.rlike(_COMPARE)), decided))
    plain = F.filter(body, lambda x: ~x.startswith("dom(") & ~x.rlike(_EQUAL) & ~x.rlike(_COMPARE))
    return kept.select(*fw, "rule_id", F.get("__t", F.lit(0)).alias("head"), plain.alias("body"))


def supports(rules: DataFrame, assumptions: DataFrame, cap: int = 256, max_rounds: int = 1000, max_set_size: int | None = None) -> DataFrame:
    """(atom, members): subset-minimal sets of assumptions from which each atom follows.

    rules: (head, body) ground; assumptions: (asm). Each round joins the sets that are new since the last one (at one place
    of a body) with all sets known (at the others), keeps minimal sets of at most max_set_size members, and at most cap of
    an atom by (size, members); it ends when a round brings nothing new.
    """
    from rulewright.operators.store import discard, settle

    none = F.array().cast("array<string>")
    rules = settle(rules.select("head", "body").distinct(), "rules")  # every round reads them several times
    first = assumptions.select(F.col("asm").alias("atom"), F.array("asm").alias("members")).union(rules.where(F.size("body") == 0).select("head", none)).distinct()
    known = settle(first.withColumn("fresh", F.lit(True)), "supports")
    # Longest body: a property of the rules, not of the data.
    longest = rules.agg(F.max(F.size("body"))).first()[0] or 0
    for _ in range(max_rounds if longest else 0):
        found, new, every = None, known.where("fresh").drop("fresh"), known.drop("fresh")
        for j in range(longest):
            at = rules.where(F.size("body") > j)
            state = at.withColumn("atom", F.get("body", F.lit(j))).join(new, "atom").select("head", "body", "members")
            for i in range(longest):
                if i == j:
                    continue
                short = state.where(F.size("body") <= i)
                more = state.where(F.size("body") > i).withColumn("atom", F.get("body", F.lit(i))).join(every.withColumnRenamed("members", "__m"), "atom")
                state = short.unionByName(more.select("head", "body", F.array_sort(F.array_union("members", "__m")).alias("members")))
            part = state.select(F.col("head").alias("atom"), "members")
            found = part if found is None else found.union(part)
        if max_set_size is not None:
            found = found.where(F.size("members") <= max_set_size)
        kept = capped(antichain(every.union(found), ["atom"], "members"), cap)
        after = settle(kept.join(every.withColumn("__old", F.lit(True)), ["atom", "members"], "left").select("atom", "members", F.col("__old").isNull().alias("fresh")), "supports")
        discard(known)
        known = after
        if after.where("fresh").isEmpty():
            break
    return known.drop("fresh")


def capped(sets: DataFrame, cap: int) -> DataFrame:
    """At most cap sets of each atom, the smallest first, equals by their members (a limit of the semantics)."""
    place = F.row_number().over(Window.partitionBy("atom").orderBy(F.size("members"), "members"))
    return sets.withColumn("__r", place).where(F.col("__r") <= cap).drop("__r")


def attack_edges(supported: DataFrame, assumptions: DataFrame) -> DataFrame:
    """(target, polarity, members): attacks are supports of the contrary; supports are those of the assumption but itself.

    assumptions: (asm, contrary).
    """
    attacks = supported.join(assumptions.select(F.col("asm").alias("target"), F.col("contrary").alias("atom")), "atom").select("target", F.lit("attack").alias("polarity"), "members")
    backs = supported.join(assumptions.select(F.col("asm").alias("atom")), "atom").where((F.size("members") != 1) | (F.get("members", F.lit(0)) != F.col("atom"))).select(F.col("atom").alias("target"), F.lit("support").alias("polarity"), "members")
    return attacks.unionByName(backs)
