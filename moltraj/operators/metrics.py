"""State discovery, transition statistics and comparison metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltraj.functions.numeric import draw_below
from moltraj.scale import BLOCK, cut_lineage, look_ahead, lookup_join, ranked, running_total, value_block

ACCUMULATED_PS = 1000.0
RESAMPLES = 1000
States = dict[str, dict[str, tuple[float | None, float | None]]]


# --- named states and their discovery -------------------------------------------------------------------------------


def state_membership(frames: DataFrame, states: States) -> DataFrame:
    """One row per frame and named state it is in. A state is a set of closed ranges; an open end is None.

    State definitions are configuration, so they become expressions and no join is needed.
    """
    tests = []
    for name, ranges in states.items():
        inside = F.lit(True)
        for measure, (low, high) in ranges.items():
            inside = inside & F.col(measure).isNotNull()
            if low is not None:
                inside = inside & (F.col(measure) >= low)
            if high is not None:
                inside = inside & (F.col(measure) <= high)
        tests.append(F.when(inside, F.lit(name)))
    return frames.withColumn("state", F.explode(F.array_compact(F.array(*tests))))


def discoveries(visits: DataFrame, run: str, frame_ps: float, accumulated_ps: float = ACCUMULATED_PS) -> DataFrame:
    """First time of each state in each run: by one frame inside, and by accumulated time inside.

    Visits are counted in blocks of frames, so a run of any length is split over tasks.
    """
    needed = max(1, -(-accumulated_ps // frame_ps))
    counted = ranked(visits, [run, "state"], F.floor(F.col("frame") / BLOCK), ["frame"], "visit", start=1)
    time = (F.col("frame") + 1) * F.lit(frame_ps)
    return counted.groupBy(run, "state").agg(
        F.min(time).alias("first_ps"), F.min(F.when(F.col("visit") >= needed, time)).alias("accumulated_ps")
    ).withColumn("discovered_ps", F.least("first_ps", "accumulated_ps"))


def discovery_curve(found: DataFrame, run: str) -> DataFrame:
    """Number of states known from each discovery time on; one row per run and time, so at most one per state."""
    steps = found.groupBy(run, "discovered_ps").agg(F.count(F.lit(1)).alias("_new"))
    order = Window.partitionBy(run).orderBy("discovered_ps")
    return steps.select(run, "discovered_ps", F.sum("_new").over(order).alias("n_states"))


def discovery_auc(found: DataFrame, run: str, budget_ps: float) -> DataFrame:
    """Area under the states-discovered curve up to the budget, in state * ns: each state counts from its discovery."""
    held = F.greatest(F.lit(0.0), F.lit(budget_ps) - F.col("discovered_ps")) / 1000.0
    return found.groupBy(run).agg(F.sum(held).alias("auc"))


# --- transitions ----------------------------------------------------------------------------------------------------


def transition_counts(frames: DataFrame, run: str, group: Sequence[str], state: str, lag: int) -> DataFrame:
    """Transitions at a lag within runs, counted per group; only counted cells leave a task."""
    columns = list(dict.fromkeys([run, *group, "frame", state]))
    moved = look_ahead(frames.select(*columns), [run], "frame", lag, {state: "_to"}).filter(F.col("_to").isNotNull())
    return moved.groupBy(*group, F.col(state).alias("from_state"), F.col("_to").alias("to_state")).agg(
        F.count(F.lit(1)).alias("n")
    )


def transition_matrix(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    leaving = Window.partitionBy(*group, "from_state")
    return counts.withColumn("p", F.col("n") / F.sum("n").over(leaving))


def matrix_product(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    a = left.select(*group, "from_state", F.col("to_state").alias("_via"), F.col("p").alias("_a"))
    b = right.select(*group, F.col("from_state").alias("_via"), "to_state", F.col("p").alias("_b"))
    return a.join(b, [*group, "_via"]).groupBy(*group, "from_state", "to_state").agg(F.sum(F.col("_a") * F.col("_b")).alias("p"))


def chapman_kolmogorov(frames: DataFrame, run: str, group: Sequence[str], state: str, lag: int, steps: int) -> DataFrame:
    """Frobenius distance between the matrix at lag * steps and the step matrix to that power, per group."""
    keys = [*group, "from_state", "to_state"]
    one = transition_matrix(transition_counts(frames, run, group, state, lag), group).select(*keys, "p")
    far = transition_matrix(transition_counts(frames, run, group, state, lag * steps), group).select(*keys, F.col("p").alias("_far"))
    power = one
    for _ in range(steps - 1):
        power = matrix_product(power, one, group)
    gap = F.coalesce("p", F.lit(0.0)) - F.coalesce("_far", F.lit(0.0))
    return power.join(far, keys, "full").groupBy(*group).agg(F.sqrt(F.sum(gap * gap)).alias("residual"))


# --- information and calibration --------------------------------------------------------------------------------------


def coverage_entropy(visits: DataFrame, group: Sequence[str], region: str) -> DataFrame:
    """Entropy in nats of how visits spread over regions."""
    cells = visits.groupBy(*group, region).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*group))
    return cells.withColumn("_p", share).groupBy(*group).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy"))


def mutual_information(rows: DataFrame, group: Sequence[str], left: str, right: str) -> DataFrame:
    """Mutual information in bits of two discrete columns, from counted cells."""
    cells = rows.groupBy(*group, left, right).agg(F.count(F.lit(1)).alias("n"))
    both = cells.withColumns({
        "_n": F.sum("n").over(Window.partitionBy(*group)),
        "_l": F.sum("n").over(Window.partitionBy(*group, left)),
        "_r": F.sum("n").over(Window.partitionBy(*group, right)),
    })
    term = F.col("n") / F.col("_n") * F.log2(F.col("n") * F.col("_n") / (F.col("_l") * F.col("_r")))
    return both.groupBy(*group).agg(F.sum(term).alias("bits"))


def calibration_error(rows: DataFrame, group: Sequence[str], probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    slot = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    binned = rows.groupBy(*group, slot.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(probability).alias("_p"), F.avg(F.col(outcome).cast("double")).alias("_y")
    )
    gap = F.abs(F.col("_p") - F.col("_y")) * F.col("_n")
    return binned.groupBy(*group).agg((F.sum(gap) / F.sum("_n")).alias("ece"))


# --- rank statistics ---------------------------------------------------------------------------------------------------


def tie_ranks(
    rows: DataFrame, group: Sequence[str], value: str, sums: dict[str, Column], name: str = "rank", *, weight: str | None = None
) -> DataFrame:
    """One row per distinct value with its tie-averaged rank, the number of copies, and sums over the copies.

    Ties are counted first, so a value shared by a third of the rows is one row. The counted values are materialised,
    as they are read for the quantile cuts and for the ranks, and are ranked in quantile blocks instead of one sort.
    """
    totals = [F.sum(column).alias(out) for out, column in sums.items()]
    distinct = cut_lineage(rows.groupBy(*group, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("copies"), *totals))
    placed = running_total(distinct, group, value_block(distinct, value), [value], F.col("copies"), "_less")
    return placed.withColumn(name, F.col("_less") + (F.col("copies") + 1) / 2).drop("_less")


def auroc(rows: DataFrame, group: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Probability that a positive outscores a negative, ties counted half."""
    ranks = tie_ranks(rows, group, score, {"_pos": positive.cast("int")})
    sums = ranks.groupBy(*group).agg(
        F.sum(F.col("rank") * F.col("_pos")).alias("_r"), F.sum("_pos").alias("_p"), F.sum("copies").alias("_n")
    )
    pairs = F.col("_p") * (F.col("_n") - F.col("_p"))
    above = F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2
    return sums.select(*group, F.when(pairs > 0, above / pairs).alias("auroc"))


def time_shuffled(frames: DataFrame, run: str, column: str, seed: int = 0) -> DataFrame:
    """`column` permuted within each run by a seeded hash order of the frames, as column `shuffled`.

    The hash spreads a run evenly over 65536 blocks, whatever its length.
    """
    hashed = frames.select(run, "frame", column).withColumn(
        "_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(run).cast("string"), F.col("frame").cast("string")))
    )
    block = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    moved = ranked(hashed, [run], block, ["_h", "frame"], "_to").select(
        run, F.col("_to").alias("frame"), F.col(column).alias("shuffled")
    )
    return frames.join(moved, [run, "frame"])


#: Share of its distance from chance that an AUROC must lose when time is shuffled.
DROP_SHARE = 0.3


def auroc_drop(ordered: DataFrame, shuffled: DataFrame, group: Sequence[str], share: float = DROP_SHARE) -> DataFrame:
    """Both AUROCs of each group, the share of the first that is lost, and whether it reaches `share`; null never does."""
    both = ordered.join(shuffled.withColumnRenamed("auroc", "shuffled_auroc"), list(group), "full")
    lost = F.when(F.col("auroc") > 0, (F.col("auroc") - F.col("shuffled_auroc")) / F.col("auroc"))
    return both.withColumn("drop_share", lost).withColumn("passed", F.coalesce(F.col("drop_share") >= share, F.lit(False)))


def effective_rank_planar(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Exponential of the entropy of the two covariance eigenvalues of each group; null where nothing varies."""
    parts = rows.groupBy(*group).agg(F.var_pop(x).alias("_a"), F.var_pop(y).alias("_d"), F.covar_pop(x, y).alias("_b"))
    half, gap = (F.col("_a") + F.col("_d")) / 2, (F.col("_a") - F.col("_d")) / 2
    root = F.sqrt(gap * gap + F.col("_b") * F.col("_b"))
    whole = F.when(half > 0, 2 * half)
    shares = parts.withColumns({"_p": (half + root) / whole, "_q": F.greatest(half - root, F.lit(0.0)) / whole})

    def term(p: Column) -> Column:
        return F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))

    rank = F.when(F.col("_a") + F.col("_d") > 0, F.exp(-term(F.col("_p")) - term(F.col("_q"))))
    return shares.select(*group, rank.alias("effective_rank"))


def wilcoxon(pairs: DataFrame, difference: str) -> DataFrame:
    """Signed-rank sums of the non-zero differences, and the normal approximation without continuity correction."""
    d = F.col(difference)
    rows = pairs.filter(d != 0).withColumn("_size", F.abs(d))
    ranks = tie_ranks(rows, [], "_size", {"_up": (d > 0).cast("int"), "_down": (d < 0).cast("int")})
    sums = ranks.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("rank") * F.col("_up")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * F.col("_down")), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.pow(F.col("copies"), F.lit(3)) - F.col("copies")), F.lit(0.0)).alias("_ties"),
    )
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(variance > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance))
    return sums.select("n", "w_plus", "w_minus", z.alias("z"))


def spearman(rows: DataFrame, group: Sequence[str], left: str, right: str) -> DataFrame:
    """Rank correlation with averaged ties, from counted (left, right) cells."""
    counted = cut_lineage(rows.groupBy(*group, left, right).agg(F.count(F.lit(1)).alias("_w")))
    cells = counted
    for value, name in ((left, "_a"), (right, "_b")):
        ranks = tie_ranks(counted, group, value, {}, name, weight="_w").select(*group, value, name)
        cells = lookup_join(cells, ranks, [*group, value], salt_by=[left, right], probe=False)
    a, b, w = F.col("_a"), F.col("_b"), F.col("_w")
    sums = cells.groupBy(*group).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * b).alias("sab"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"),
    )
    top = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    spread = (F.col("n") * F.col("saa") - F.col("sa") ** 2) * (F.col("n") * F.col("sbb") - F.col("sb") ** 2)
    return sums.select(*group, F.when(spread > 0, top / F.sqrt(spread)).alias("rho"))


# --- bootstrap ----------------------------------------------------------------------------------------------------------


def paired_bootstrap(units: DataFrame, unit_key: Column, delta: str, *, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Mean difference with a 95 % interval from seeded resampling of whole units, and whether it excludes zero.

    Units are numbered in a hash order; each resample draws as many numbers as there are units. Draws meet the
    units by a lookup join and are averaged per resample with map-side combine.
    """
    units = cut_lineage(units.select(unit_key.alias("_unit"), F.col(delta).cast("double").alias(delta)))
    n_units = units.count()
    hashed = units.select(F.md5("_unit").alias("_h"), F.col(delta).cast("double").alias("_delta"))
    block = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    numbered = ranked(hashed, [], block, ["_h"], "_slot").select("_slot", "_delta")
    slots = numbered.select("_slot", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    picks = slots.withColumn("_pick", draw_below(F.lit(n_units), seed, F.col("resample"), F.col("_slot")))
    drawn = lookup_join(picks, numbered.select(F.col("_slot").alias("_pick"), "_delta"), ["_pick"], salt_by=["resample", "_slot"], known_rows=n_units)
    means = drawn.groupBy("resample").agg(F.avg("_delta").alias("mean"))
    bounds = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(bounds.alias("b")).select(
        units.agg(F.avg(delta).alias("m")).scalar().alias("mean_delta"),
        F.col("b")[0].alias("ci_low"), F.col("b")[1].alias("ci_high"),
        ((F.col("b")[0] > 0) | (F.col("b")[1] < 0)).alias("excludes_zero"),
    )


def effective_rank(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Exponential of the entropy of the normalised covariance eigenvalues."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    shaped = vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    shares = PCA(k=dim, inputCol="v", outputCol="o").fit(shaped).explainedVariance.toArray()
    rows = [(float(share),) for share in shares if share > 0]
    share = vectors.sparkSession.createDataFrame(rows, "p double")
    return share.agg(F.exp(-F.sum(F.col("p") * F.ln("p"))).alias("effective_rank"))
