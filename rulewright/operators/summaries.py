"""Summaries of scored answers, decisions and runs: two-stage rates, reports by set, floors, and registered decision rules.

A score row is one answer: problem_id, mode or arm, sample_idx, tier, split, class and the fields of its card. All summaries
are grouped aggregates; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions.stats import balanced_accuracy, count_if, mcnemar, share, wilson

METRICS = ("valid", "clean", "exact")


def at_k(scores: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS, problem: str = "problem_id") -> DataFrame:
    """For each problem the mean of every metric over its samples (at_1) and whether any sample has it (at_k)."""
    flag = lambda m: F.coalesce(F.col(m), F.lit(False))
    each = [c for m in metrics for c in (F.avg(flag(m).cast("double")).alias(f"{m}_at_1"), F.max(flag(m).cast("int")).alias(f"{m}_at_k"))]
    name = F.col(problem).cast("string")
    structure = F.max(F.coalesce("structure", name) if "structure" in scores.columns else name)
    return scores.groupBy(*by, problem).agg(*each, F.count(F.lit(1)).alias("__samples"), structure.alias("__structure"))


def result_aggregate(scores: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: problems, structures, samples, at_1 and at_k of each metric with the Wilson interval of at_k, agreement,
    rates of parsing, truncation and general rules, exact bodies, and balanced accuracy of using an assumption."""
    per = at_k(scores, by)
    two = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_problems"), F.countDistinct("__structure").alias("n_structures"), F.sum("__samples").alias("n_samples"),
        *[F.round(F.avg(f"{m}_at_1"), 3).alias(f"{m}_at_1") for m in METRICS], *[F.round(F.avg(f"{m}_at_k"), 3).alias(f"{m}_at_k") for m in METRICS], *[F.sum(f"{m}_at_k").alias(f"__{m}") for m in METRICS],
    )
    for m in METRICS:
        low, high = wilson(F.col(f"__{m}"), F.col("n_problems"))
        two = two.withColumn(f"{m}_low", low).withColumn(f"{m}_high", high).drop(f"__{m}")
    r2 = F.sum("r2_exact") / F.nullif(F.sum("r2_n"), F.lit(0)) if "r2_n" in scores.columns else F.lit(None).cast("double")
    flat = scores.groupBy(*by).agg(
        share("agreement").alias("agreement"), share("parsed").alias("parse_rate"), share("truncated").alias("truncated_rate"), share(F.when(F.col("valid"), F.col("intensional"))).alias("intensional_rate"),
        balanced_accuracy(F.when(F.col("defeasible").isNotNull(), F.col("ref_defeasible")), "defeasible").alias("r3_balanced"), F.round(r2, 4).alias("r2_exact"),
    )
    on = reduce(lambda a, b: a & b, [two[c].eqNullSafe(flat[c]) for c in by]) if by else None
    return (two.join(flat, on) if by else two.crossJoin(flat)).select(*[two[c] for c in by], *[c for c in two.columns if c not in by], *[c for c in flat.columns if c not in by])


def by_all_split_tier(scores: DataFrame, metric: str, mode: list[str] = ()) -> DataFrame:
    """(mode.., level, value, n, rate): one pass over all, each split and each tier at once."""
    keys = F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("value")), F.struct(F.lit("split").alias("level"), F.col("split").alias("value")), F.struct(F.lit("tier").alias("level"), F.col("tier").alias("value"))))
    return scores.withColumn("__g", keys).groupBy(*mode, "__g.level", "__g.value").agg(F.count(F.lit(1)).alias("n"), share(metric).alias("rate"))


def tier_breakdown(scores: DataFrame, mode: str) -> DataFrame:
    """result_aggregate for each mode and tier; no rows at all where every problem is a built-in one."""
    some = scores.agg(F.max((F.col("tier") != "builtin").cast("int")).alias("__some"))
    return result_aggregate(scores, [mode, "tier"]).crossJoin(some).where("__some = 1").drop("__some")  # one row


def counted(scores: DataFrame, by: list[str], label: str) -> DataFrame:
    """How often each label occurs in each group."""
    return scores.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def set_name(split: Column, tier: Column, kind: Column) -> Column:
    """Name of the set of an evaluation row: test, table1 <class>, or <tier> <class>."""
    return F.when(split == "test", "test").when(split == "table1", F.concat_ws(" ", F.lit("table1"), kind)).otherwise(F.concat_ws(" ", tier, kind))


def proportion(flag: Column, name: str) -> list[Column]:
    """How many rows have a flag, and their share; a null counts as false."""
    f = F.coalesce(flag, F.lit(False))
    return [count_if(f).alias(f"{name}_k"), F.round(F.avg(f.cast("double")), 4).alias(f"{name}_p")]


def arm_report(scores: DataFrame, train_answers: DataFrame) -> DataFrame:
    """(arm, set, ...): proportions of an arm by set, agreement, use of assumptions, exact answers where the expected one occurs
    in training and where it does not, and the listed choices of held-out problems. train_answers: (answer)."""
    known = train_answers.select(F.col("answer").alias("gold")).distinct().withColumn("__seen", F.lit(True))
    rows = scores.withColumn("set", set_name(F.col("split"), F.col("tier"), F.col("class"))).join(known, "gold", "left").withColumn("__seen", F.coalesce("__seen", F.lit(False)))
    exact = F.coalesce("exact", F.lit(False))
    held = F.col("split") == "heldout"
    return rows.groupBy("arm", "set").agg(
        F.count(F.lit(1)).alias("n"), *[c for m in ("parsed", "valid", "clean", "exact") for c in proportion(F.col(m), m)],
        share("agreement").alias("agreement"), F.count("agreement").alias("agreement_n"), balanced_accuracy(F.when(F.col("defeasible").isNotNull(), F.col("ref_defeasible")), "defeasible").alias("r3_balanced"),
        count_if(exact & F.col("__seen")).alias("exact_seen"), count_if(F.col("__seen")).alias("n_seen"), count_if(exact & ~F.col("__seen")).alias("exact_unseen"),
        count_if(held & F.coalesce("algorithm_choice", F.lit(False))).alias("algorithm_choice"), count_if(held & F.coalesce("forbidden_choice", F.lit(False))).alias("forbidden_choice"),
    )


def size_rows(problems: DataFrame, per_problem: DataFrame) -> DataFrame:
    """One row for each problem that was answered: its size beside what was reached (at_k). Problems without an answer are left out."""
    return problems.join(per_problem.select("problem_id", "clean_at_k", "clean_at_1", "exact_at_k"), "problem_id")


def length_audit(rows: DataFrame, by: list[str], prompt: Column, target: Column) -> DataFrame:
    """Rows, mean and greatest target length, all target units, the greatest of prompt and target together."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(target), 4).alias("mean"), F.max(target).cast("long").alias("longest"), F.sum(target).cast("long").alias("total"), F.max(prompt + target).cast("long").alias("longest_both"))


def mechanism_share(rows: DataFrame, mechanisms: str, flag: str) -> DataFrame:
    """(mechanism, n, share): share of flagged rows among those that use a mechanism, each mechanism once a row."""
    return rows.select(F.explode(F.array_distinct(mechanisms)).alias("mechanism"), F.col(flag)).groupBy("mechanism").agg(F.count(F.lit(1)).alias("n"), share(flag).alias("share"))


def presence_frequency(rows: DataFrame, keys: list[str], sample: str, items: str) -> DataFrame:
    """(keys.., item, frequency): share of the samples of a group that have an item, each once a sample."""
    n = rows.groupBy(*keys).agg(F.countDistinct(sample).alias("__n"))
    each = rows.select(*keys, sample, F.explode(items).alias("item")).distinct().groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("__k"))
    return each.join(n, keys).select(*keys, "item", F.round(F.col("__k") / F.col("__n"), 4).alias("frequency"))


def dataset_stats(problems: DataFrame) -> DataFrame:
    """One row: problems, and totals and means of facts, rules, assumptions, examples and constants."""
    sizes = ("n_facts", "n_rules", "n_assumptions", "n_positive", "n_negative", "n_constants")
    return problems.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(f"total_{c[2:]}") for c in sizes], *[F.round(F.avg(c), 4).alias(f"mean_{c[2:]}") for c in sizes])


def ordered_digest(rows: DataFrame, keys: list[str], order: list[str], text: Column, out: str = "digest") -> DataFrame:
    """(keys.., digest): hash of the texts of a group in their order. Rows are hashed first, so a group costs 64 bytes a row."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.sha2(text, 256).alias("__h"))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(pieces, lambda x: x["__h"]), ""), 256).alias(out))


def leave_one_out_mode(rows: DataFrame, group: str, unit: str, value: str) -> DataFrame:
    """(unit, mode): the most frequent value of the other rows of the unit's group, the first by order of equals.

    Only the counts of a group are joined, so a hot group meets as many rows as it has values: the two best values of the
    group decide for every row whose own value is neither.
    """
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    counts = n.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))).alias("__c"))
    own = rows.select(group, unit, F.col(value).alias("__own")).join(counts, group)
    less = F.transform("__c", lambda x: F.struct((x["n"] + F.when(x["v"] == F.col("__own"), 1).otherwise(0)).alias("n"), x["v"].alias("v")))
    left = F.filter(less, lambda x: x["n"] < 0)
    return own.withColumn("mode", F.array_min(left)["v"]).where("mode IS NOT NULL").select(unit, "mode")


def majority_vote(rows: DataFrame, facet: list[str], fallback: list[str], vote: Column) -> DataFrame:
    """(facet.., guess): the majority of a facet, on a tie that of the fallback, on a tie false."""
    d = F.sum(F.when(vote, 1).otherwise(-1))
    own, wide = rows.groupBy(*facet).agg(d.alias("__d")), rows.groupBy(*fallback).agg(d.alias("__f"))
    return own.join(wide, fallback).select(*facet, F.when(F.col("__d") != 0, F.col("__d") > 0).otherwise(F.col("__f") > 0).alias("guess"))


def stratum_lookup(rows: DataFrame, values: DataFrame, fine: list[str], coarse: list[str], value: str, enough: Column) -> DataFrame:
    """(fine.., value): the mean of a stratum where enough(rows) holds, else that of the coarser one."""
    own = values.groupBy(*fine).agg(F.avg(value).alias("__m"), F.count(F.lit(1)).alias("n")).where(enough).select(*fine, "__m")
    wide = values.groupBy(*coarse).agg(F.avg(value).alias("__w"))
    return rows.select(*fine).distinct().join(own, fine, "left").join(wide, coarse, "left").select(*fine, F.round(F.coalesce("__m", "__w"), 2).alias("baseline"))


def paired(left: DataFrame, right: DataFrame, metric: str, key: str = "problem_id") -> DataFrame:
    """One row: pairs of two arms on the same problems, problems that only one arm has, discordant pairs and the exact p."""
    a, b = left.select(key, F.coalesce(F.col(metric), F.lit(False)).alias("x"), F.lit(1).alias("__a")), right.select(key, F.coalesce(F.col(metric), F.lit(False)).alias("y"), F.lit(1).alias("__b"))
    both = a.join(b, key, "full")
    two = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    got = both.agg(count_if(two).alias("n"), count_if(~two).alias("unpaired"), count_if(two & F.col("x") & ~F.col("y")).alias("first_only"), count_if(two & F.col("y") & ~F.col("x")).alias("second_only"), F.round(F.avg(F.when(two, F.col("y").cast("int") - F.col("x").cast("int"))), 4).alias("delta"))
    return got.withColumn("p", mcnemar(F.col("first_only"), F.col("second_only")))


def invariance(pair: DataFrame, low: Column, high: Column, margin: float = 0.05, level: float = 0.05) -> DataFrame:
    """pair with the registered verdict: invariant where the interval of the delta lies within the margin, and whether it moved."""
    moved = F.when((F.col("p") < level) & (F.col("delta") < 0), "drop").when(F.col("p") < level, "rise")
    within = (low >= -margin) & (high <= margin)
    return pair.withColumn("verdict", F.when(within & moved.isNull(), f"invariant within +-{margin}").when(within, F.concat(F.lit(f"invariant within +-{margin}, significant "), moved)).otherwise(F.coalesce(moved, F.lit("inconclusive"))))


def stronger_arm(pair: DataFrame, first: str, second: str, level: float = 0.05) -> DataFrame:
    """The arm that further training starts from: the second only where it is significantly better; and whether the first is."""
    sure = F.col("p") < level
    ahead = F.col("first_only") > F.col("second_only")
    return pair.select("n", "first_only", "second_only", "p", F.when(sure & ~ahead, second).otherwise(first).alias("base"), (sure & ahead).alias("matched_run"))


def first_checks(runs: DataFrame, by: list[str]) -> DataFrame:
    """First verdicts on a fold by group: runs that reached one, accuracy and balanced accuracy; a run that did not is a miss
    against the learner's own first verdict. runs: first_truth, first_said, first_on_path, gold_first."""
    truth = F.coalesce("first_truth", "gold_first")
    said = F.when(F.col("first_truth").isNotNull(), F.col("first_said"))
    known = truth.isNotNull()
    return runs.withColumn("__t", truth).withColumn("__s", said).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("first_truth").isNotNull()).alias("reached"), count_if(F.coalesce("first_on_path", F.lit(False))).alias("at_reference_state"),
        share(F.when(known, F.col("__t").eqNullSafe(F.col("__s")))).alias("accuracy"), balanced_accuracy("__t", "__s").alias("balanced"),
        balanced_accuracy(F.when(F.col("first_truth").isNotNull(), F.col("__t")), "__s").alias("balanced_reached"),
    )


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Controlled runs by group: stops, exact and strictly exact answers (no illegal item in any call), calls and reference steps."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share("exact").alias("exact"), share(F.col("exact") & ~F.col("any_illegal")).alias("strict_exact"), count_if(F.col("error").isNotNull()).alias("stopped"),
        F.round(F.avg("n_calls"), 2).alias("calls_mean"), F.round(F.avg("gold_steps"), 2).alias("reference_steps_mean"),
    )


def supported(first_balanced: Column, r3_balanced: Column, exact: Column, other_exact: Column, p: Column, support: float = 0.9, refute: float = 0.6, level: float = 0.05) -> Column:
    """The registered verdict on step training: undefined, refuted, supported (all three conditions hold) or intermediate."""
    holds = (first_balanced >= support) & (r3_balanced >= support) & (exact > other_exact) & (p < level)
    return F.when(first_balanced.isNull(), "undefined").when(first_balanced <= refute, "refuted").when(F.coalesce(holds, F.lit(False)), "supported").otherwise("intermediate")


def floors(policies: DataFrame, flag: str, measured: DataFrame, k: str, n: str) -> DataFrame:
    """One row: the best policy that needs no reasoning (the first by name of equals) and its rate, the measured rate with its lower
    Wilson bound, and whether that bound is above the floor. policies: (policy, flag); measured: one row with k and n."""
    each = policies.groupBy("policy").agg(F.avg(F.col(flag).cast("double")).alias("m"))
    best = each.agg(F.min_by("policy", F.struct((-F.col("m")).alias("a"), F.col("policy").alias("b"))).alias("policy"), F.round(F.max("m"), 4).alias("floor"))
    low, _ = wilson(F.col(k), F.col(n))
    both = best.crossJoin(measured)  # one row each
    return both.select("policy", "floor", F.round(F.col(k) / F.col(n), 4).alias("measured"), low.alias("low"), (low > F.col("floor")).alias("above"))


def out_of_range(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, n): values of features that test rows have and no training row has."""
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])).alias("x")).select("x.feature", "x.value")
    return long(test).join(long(train).distinct(), ["feature", "value"], "left_anti").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def explained_choice(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., sample_idx, explained): the first clean sample of a group, else the first that was read; without one nothing is explained."""
    best = F.min_by(F.struct("sample_idx", "parsed"), F.struct((~F.coalesce("clean", F.lit(False))).alias("a"), (~F.col("parsed")).alias("b"), F.col("sample_idx").alias("c")))
    return scores.groupBy(*keys).agg(best.alias("x")).select(*keys, F.when(F.col("x.parsed"), F.col("x.sample_idx")).alias("sample_idx"), F.col("x.parsed").alias("explained"))


def graded_agreement(rows: DataFrame, by: list[str]) -> DataFrame:
    """Queries, agreeing ones and their share; a null counts as no agreement."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_if(F.coalesce("agree", F.lit(False))).alias("agree"), F.round(F.avg(F.coalesce("agree", F.lit(False)).cast("double")), 4).alias("share"))


def minted_reuse(log: DataFrame) -> DataFrame:
    """(said, n): verdicts on using a minted assumption again where that is right. log: (kind, truth, said, subject)."""
    minted = F.col("subject").rlike(r"^alpha_\d+\(")
    return log.where((F.col("kind") == "reuse_check") & F.col("truth") & minted).groupBy("said").agg(F.count(F.lit(1)).alias("n"))


def first_unseen(rows: DataFrame, train: DataFrame, keys: list[str], place: str, item: str) -> DataFrame:
    """(keys.., first_unseen): place of the first item of each group that no training row has; groups without one are left out."""
    new = rows.join(train.select(F.col(item)).distinct(), item, "left_anti")
    return new.groupBy(*keys).agg(F.min(place).alias("first_unseen"))


def zipped(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys.., pos, left, right): two ordered lists place by place; the shorter one ends in nulls."""
    return df.select(*keys, F.posexplode(F.arrays_zip(left, right)).alias("pos", "z")).select(*keys, "pos", F.col(f"z.{left}").alias(left), F.col(f"z.{right}").alias(right))


def with_arms(rows: DataFrame, arms: list[str]) -> DataFrame:
    """Every row once for each arm."""
    return rows.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))


def without_suffix(problem_id: Column) -> Column:
    """An id without what follows its last #."""
    return F.regexp_replace(problem_id, "#[^#]*$", "")


def tier_of(problem_id: Column) -> Column:
    """Tier by the id (t3_noise_0007 -> t3_noise); builtin for other ids."""
    return F.coalesce(F.nullif(F.regexp_extract(problem_id, r"^(t\d+(?:_[a-z]+)?)_\d+", 1), F.lit("")), F.lit("builtin"))


def epoch_order(rows: DataFrame, unit: str, epochs: int, seed: str, buckets: int = 1 << 12) -> DataFrame:
    """(epoch, unit, place): a seeded permutation of the rows for each epoch.

    Places are counted inside buckets of the hash and shifted by the sizes of the buckets before, so no task sorts an epoch.
    """
    each = rows.select(F.col(unit), F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    hashed = each.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.col(unit).cast("string")))).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int") % buckets)
    sizes = hashed.groupBy("epoch", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("epoch").orderBy("__b")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("epoch", "__b").orderBy("__h", unit))
    return hashed.withColumn("__i", inside).join(before, ["epoch", "__b"]).select("epoch", unit, (F.col("__before") + F.col("__i")).alias("place"))


def stable_ids(rows: DataFrame, stream: str, order: str, offset: Column, step: int = 2) -> DataFrame:
    """rows with stable_id: numbers of a stream step apart, so streams interleave and ids stay when a stream grows."""
    at = F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1
    return rows.withColumn("stable_id", (step * at + offset).cast("long"))


def sorted_last(value: Column, last: str) -> list[Column]:
    """Sort keys by which one value comes after all others."""
    return [value == last, value]


def retry_after(text: Column) -> Column:
    """Seconds of a duration such as 1h2m3.5s or 250ms, null where there is none."""
    part = lambda unit: F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(rf"(\d+(?:\.\d+)?){unit}(?![a-z])"), F.lit(1)), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    total = 3600 * part("h") + 60 * part("m") + part("s") + part("ms") / 1000
    return F.when(text.rlike(r"\d+(?:\.\d+)?(?:h|ms|m|s)(?![a-z])"), F.round(total, 3))
