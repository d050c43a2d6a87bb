"""Governance of methods: paired replays, promotion, divergence, gaming, search progress."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12
# Trip points of the ratio checks, severities, error rate of a promotion.
TRIP = {"shortened_investigations": 0.75, "skipped_checks": 0.90, "narrowed_scope": 0.75}
LADDER = ("low", "medium", "high", "critical")
BASE = {"protected": 2, "diagnostic": 0}
ALPHA, POWER = 0.005, 0.8
LEAST_GENERATIONS, BUDGET_TOLERANCE = 3, 0.05


def gains(replays: DataFrame, proxies: dict[str, tuple[str, str]]) -> DataFrame:
    """Long rows (task, family, stage, difficulty, usable, proxy, role, gain).

    ``replays`` has one row per task with ``parent_<proxy>`` and ``child_<proxy>``, caps kept
    (``within_caps``), blinded and accounted arms; ``proxies`` maps a name to (role, direction).
    """
    usable = F.col("within_caps") & F.col("blinded") & F.col("accounted")
    sign = lambda d: -1.0 if d == "minimize" else 1.0
    rows = F.array(*[F.struct(F.lit(p).alias("proxy"), F.lit(role).alias("role"), (F.lit(sign(d)) * (F.col(f"child_{p}") - F.col(f"parent_{p}"))).alias("gain")) for p, (role, d) in proxies.items()])
    return replays.select("task", "family", "stage", "difficulty", usable.alias("usable"), F.explode(rows).alias("r")).select("task", "family", "stage", "difficulty", "usable", "r.*")


def replay_report(g: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean paired gain of each proxy over usable tasks, and over held-out ones; optionally by family or difficulty."""
    use = F.col("usable")
    held = use & (F.col("stage") == "holdout")
    mean = F.avg(F.when(use, F.col("gain")))
    return g.groupBy(*by, "proxy", "role").agg(
        F.count_if(use).alias("n_usable"), F.count_if(~use).alias("n_excluded"), mean.alias("mean_gain"), F.count_if(held).alias("n_holdout"), F.avg(F.when(held, F.col("gain"))).alias("holdout_gain"),
        (F.coalesce(mean, F.lit(0.0)) > EPSILON).alias("improved"), (F.coalesce(mean, F.lit(0.0)) < -EPSILON).alias("regressed"),
    )


def promotion_rule(report: DataFrame) -> DataFrame:
    """One row: the state of every condition and the verdict promote, reject or inconclusive."""
    role = F.col("role")
    has = lambda r: F.count_if(role == r) > 0
    bad = lambda r, c: F.count_if((role == r) & c) > 0
    primary = F.max(F.when(role == "primary", F.col("mean_gain")))
    held = F.max(F.when(role == "primary", F.col("holdout_gain")))
    one = report.agg(
        F.when((F.max("n_excluded") == 0) & (F.max("n_usable") > 0), "met").otherwise("unmet").alias("accounting_complete"),
        F.when(~has("primary") | primary.isNull(), "unestablished").when(primary > EPSILON, "met").otherwise("unmet").alias("primary_strict_gain"),
        F.when(~has("protected"), "unestablished").when(bad("protected", F.col("regressed")), "unmet").otherwise("met").alias("no_protected_regression"),
        F.when(F.max("n_holdout") == 0, "unestablished").when((held > EPSILON) & ~bad("protected", F.col("holdout_gain") < -EPSILON), "met").otherwise("unmet").alias("holdout_stage_passed"),
    )
    conditions = ["accounting_complete", "primary_strict_gain", "no_protected_regression", "holdout_stage_passed"]
    is_ = lambda c, s: F.col(c) == s
    open_ = is_(conditions[1], "unestablished") | is_(conditions[2], "unestablished") | is_(conditions[3], "unestablished")
    verdict = (
        F.when(is_("accounting_complete", "unmet"), "inconclusive").when(is_("no_protected_regression", "unmet") | is_("primary_strict_gain", "unmet"), "reject")
        .when(open_, "inconclusive").when(is_("holdout_stage_passed", "unmet"), "reject").otherwise("promote")
    )
    return one.withColumn("verdict", verdict)


def power_report(df: DataFrame, n: str, noise_sd: str, effect: str, alpha: float = ALPHA, power: float = POWER, inflation: float = 1.0) -> DataFrame:
    """Detectable effect at ``n`` tasks, tasks needed for the declared effect, and whether that is too few."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    factor = F.lit(z * inflation**0.5) * F.col(noise_sd)
    detectable = F.when(F.col(n) > 0, factor / F.sqrt(n))
    required = F.ceil((factor / F.col(effect)) ** 2)
    under = F.coalesce(detectable > F.col(effect) + EPSILON, F.lit(True))
    return df.select("*", detectable.alias("detectable"), required.alias("required"), F.greatest(F.lit(0), required - F.col(n)).alias("shortfall"), under.alias("underpowered"))


def divergence(report: DataFrame, effect: float) -> DataFrame:
    """Proxies other than the primary that lost, with a severity by role and size of the loss."""
    primary = report.where("role = 'primary'").agg(F.coalesce(F.max("mean_gain"), F.lit(0.0)).alias("primary_gain"))  # one row
    loss = -F.col("mean_gain")
    start = F.when(F.col("role") == "protected", BASE["protected"]).when(F.col("role") == "diagnostic", BASE["diagnostic"]).otherwise(1)
    rung = F.least(F.lit(3), start + (loss >= effect).cast("int") + (loss >= 2 * effect).cast("int"))
    out = report.where((F.col("role") != "primary") & (F.col("mean_gain") < -EPSILON)).crossJoin(primary)
    return out.select("proxy", "role", "mean_gain", (F.col("primary_gain") > EPSILON).alias("primary_improved"), F.element_at(F.array(*map(F.lit, LADDER)), rung + 1).alias("severity"))


def gaming_checks(replays: DataFrame) -> DataFrame:
    """Did the child win by doing less?  Ratios of mean actions, checks and scope, and avoided hard tasks."""
    usable = F.col("within_caps") & F.col("blinded") & F.col("accounted")
    mean = lambda c: F.coalesce(F.avg(F.when(usable, F.col(c))), F.lit(0.0))
    names = dict(zip(TRIP, ("actions", "checks", "scope")))
    hard = F.col("difficulty") == "hard"
    tried = lambda arm, c=F.lit(True): F.count_if(F.col(f"{arm}_attempted") & c).cast("double")
    one = replays.agg(*[mean(f"{arm}_{c}").alias(f"{arm}_{c}") for arm in ("parent", "child") for c in names.values()], *[tried(arm).alias(f"{arm}_all") for arm in ("parent", "child")], *[tried(arm, hard).alias(f"{arm}_hard") for arm in ("parent", "child")])
    rows = []
    for check, c in names.items():
        p, k = F.col(f"parent_{c}"), F.col(f"child_{c}")
        ratio = F.when(p > 0, k / p)
        rows.append(F.struct(F.lit(check).alias("check"), p.alias("parent"), k.alias("child"), ratio.alias("ratio"), F.coalesce(ratio < TRIP[check], F.lit(False)).alias("triggered")))
    fewer = (F.col("child_hard") < F.col("parent_hard")) | (F.col("child_all") < F.col("parent_all"))
    rows.append(F.struct(F.lit("avoided_hard_tasks").alias("check"), F.col("parent_all").alias("parent"), F.col("child_all").alias("child"), F.lit(None).cast("double").alias("ratio"), fewer.alias("triggered")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compare_meta_policies(generations: DataFrame, a: str, b: str) -> DataFrame:
    """Validated improvements per unit of compute of two procedures, and a verdict.

    ``generations`` (arm, improvements, cost, fresh): inconclusive unless both arms ran enough
    generations, spent alike and were judged on fresh families throughout.
    """
    per = generations.where(F.col("arm").isin(a, b)).groupBy("arm").agg(F.count("*").alias("n"), F.sum("improvements").alias("wins"), F.sum("cost").alias("cost"), F.bool_and("fresh").alias("fresh"))
    side = lambda arm, p: [F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{p}_{c}") for c in ("n", "wins", "cost", "fresh")]
    one = per.agg(*side(a, "a"), *side(b, "b"))
    pa, pb = (F.col(f"{p}_wins") / F.nullif(F.col(f"{p}_cost"), F.lit(0.0)) for p in "ab")
    enough = (F.col("a_n") >= LEAST_GENERATIONS) & (F.col("b_n") >= LEAST_GENERATIONS)
    alike = (F.col("a_cost") > 0) & (F.col("b_cost") > 0) & (F.abs(F.col("a_cost") - F.col("b_cost")) <= BUDGET_TOLERANCE * F.greatest("a_cost", "b_cost"))
    out = one.select(pa.alias("productivity_a"), pb.alias("productivity_b"), F.coalesce(enough, F.lit(False)).alias("enough"), F.coalesce(alike, F.lit(False)).alias("equal_budget"), F.coalesce(F.col("a_fresh") & F.col("b_fresh"), F.lit(False)).alias("fresh"))
    delta = F.col("productivity_a") - F.col("productivity_b")
    verdict = F.when(~(F.col("enough") & F.col("equal_budget") & F.col("fresh")), "inconclusive").when(delta.isNull() | (F.abs(delta) <= EPSILON), "no_difference_established").when(delta > 0, "a_more_productive").otherwise("b_more_productive")
    return out.withColumn("verdict", verdict)


def usage_deltas(snapshots: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Use since the snapshot before; a lower total is a restart and counts from zero."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    used = F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before)
    return snapshots.select(key, order, value, used.alias("used"), (F.col(value) < before).alias("restarted"))


def stagnation(edges: DataFrame, current: Column, window: int = 5, least: int = 3) -> DataFrame:
    """Per operator: attempts, accepted, the same in the last ``window`` generations, and whether it is exhausted.

    ``edges`` (operator, generation, accepted).
    """
    recent = F.col("generation") > current - window
    out = edges.groupBy("operator").agg(
        F.count("*").alias("attempts"), F.count_if("accepted").alias("accepted"), F.count_if(recent).alias("recent_attempts"), F.count_if(recent & F.col("accepted")).alias("recent_accepted"),
        F.max(F.when(F.col("accepted"), F.col("generation"))).alias("last_accepted"),
    )
    return out.withColumn("exhausted", (F.col("attempts") >= least) & (F.col("recent_accepted") == 0))


def branches(nodes: DataFrame, ancestry: DataFrame, current: Column) -> DataFrame:
    """Per seed: candidates, accepted, generations since the last accepted; a merged one counts for each seed.

    ``nodes`` (id, generation, accepted) and ``ancestry`` (id, seed).
    """
    j = nodes.join(ancestry, "id", "left").withColumn("seed", F.coalesce("seed", F.lit("unrooted")))
    return j.groupBy("seed").agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), (F.first(current) - F.max(F.when(F.col("accepted"), F.col("generation")))).alias("since_accepted"))


def generation_deltas(candidates: DataFrame, n_cells: int) -> DataFrame:
    """(generation, cell, score) to coverage and quality per generation so far, and what each adds.

    A cell counts from its first generation on, with its best score so far.
    """
    best = candidates.groupBy("cell", "generation").agg(F.max("score").alias("s"))
    w = Window.partitionBy("cell").orderBy("generation")
    old = F.max("s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = best.withColumn("old", old).where("old IS NULL OR s > old").groupBy("generation").agg(F.count_if(F.col("old").isNull()).alias("new_cells"), F.sum(F.col("s") - F.coalesce("old", F.lit(0.0))).alias("qd_delta"))
    every = candidates.select("generation").distinct().join(step, "generation", "left").select("generation", F.coalesce("new_cells", F.lit(0)).alias("new_cells"), F.coalesce("qd_delta", F.lit(0.0)).alias("qd_delta"))
    so_far = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)  # one row per generation
    return every.select("generation", (F.col("new_cells") / n_cells).alias("coverage_delta"), "qd_delta", (F.sum("new_cells").over(so_far) / n_cells).alias("coverage"), F.sum("qd_delta").over(so_far).alias("qd_score"), ((F.col("new_cells") > 0) | (F.col("qd_delta") > EPSILON)).alias("improved"))
