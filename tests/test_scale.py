"""Skewed inputs, block boundaries and plan shapes."""

import contextlib
import io
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from moltraj import scale
from moltraj.operators import labels, selection
from moltraj.plans import queries, surrogates
from moltraj.scale import look_ahead, look_back, lookup_join, ranked, running_total, value_block, with_halo

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows."""
    rng = random.Random(0)
    rows = [("hot" if i % 3 == 0 else f"g{rng.randrange(40)}", i, rng.randrange(1000)) for i in range(6000)]
    return spark.createDataFrame(rows, "g string, k bigint, v int").cache()


def test_running_total_equals_a_plain_window(skewed):
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    expected = skewed.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    got = running_total(skewed, ["g"], F.floor(F.col("k") / 50), ["k"], F.col("v"), "s")
    assert sorted(got.select("g", "k", "s").collect()) == sorted(expected.select("g", "k", "s").collect())


def test_no_task_sees_a_whole_hot_group(skewed):
    blocks = skewed.groupBy("g", F.floor(F.col("k") / 50)).count()
    assert blocks.agg(F.max("count")).first()[0] <= 50 < skewed.filter("g = 'hot'").count()


@pytest.mark.parametrize("steps,width", [(1, 7), (3, 7), (20, 7)])
def test_look_ahead_and_back_cross_blocks(skewed, steps, width):
    dense = ranked(skewed, ["g"], F.floor(F.col("k") / 50), ["k"], "p")
    w = Window.partitionBy("g").orderBy("p")
    expected = dense.select("g", "p", F.lead("v", steps).over(w).alias("a"), F.lag("v", steps).over(w).alias("b"))
    ahead = look_ahead(dense, ["g"], "p", steps, {"v": "a"}, width).select("g", "p", "a")
    back = look_back(dense, ["g"], "p", steps, {"v": "b"}, width).select("g", "p", "b")
    assert sorted(ahead.join(back, ["g", "p"]).collect(), key=str) == sorted(expected.collect(), key=str)


def test_halo_keeps_one_home_row(skewed):
    spread = with_halo(skewed, "k", 5, 100)
    assert spread.filter("_home").count() == skewed.count()


def test_salted_lookup_equals_broadcast_lookup(skewed):
    names = skewed.select("g").distinct().withColumn("name", F.upper("g"))
    left = lookup_join(skewed, names, ["g"], salt_by=["k"])
    right = lookup_join(skewed, names, ["g"], salt_by=["k"], max_rows=1)
    assert sorted(left.collect()) == sorted(right.collect())
    outer = lookup_join(skewed, names.filter("g = 'hot'"), ["g"], "left", salt_by=["k"], max_rows=0)
    assert outer.count() == skewed.count()


def test_value_blocks_grow_with_the_value(skewed):
    block = value_block(skewed, "v")
    ordered = [r.b for r in skewed.withColumn("b", block).orderBy("v").collect()]
    assert ordered == sorted(ordered) and len(set(ordered)) > 100


def test_frame_numbers_equal_a_plain_window(spark):
    events = surrogates.event_frames(spark, SF)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    assert events.withColumn("p", F.row_number().over(w) - 1).filter("p <> frame").count() == 0


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


FRAME_SCALE = [
    "unfolded_filter", "virtual_cb", "backbone_torsions", "torsion_coherence", "trajectory_hash", "frame_features", "lagged_pairs",
    "residue_sasa", "contact_graph", "positive_pairs", "transition_matrix", "state_discovery", "window_rows", "residue_topology",
]


@pytest.mark.parametrize("name", FRAME_SCALE)
def test_no_nested_loops_or_cartesian_products(spark, name):
    plan = plan_of(queries.REGISTERED[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_features_add_no_shuffle_to_frames(spark, landed):
    from moltraj.operators import features, topology

    sites = scale.cut_lineage(topology.residue_sites(topology.residues(landed.atoms)))
    plan = plan_of(features.residue_features(landed.frames, sites))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_share_cut_happens_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("concat('t', id % 3) AS traj_id", "id AS item", "CAST(id AS DOUBLE) AS score")
    assert "WindowGroupLimit" in plan_of(selection.budgeted(rows, 20))


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(queries.REGISTERED["state_discovery"](spark, SF))
    assert "props" not in plan


def test_labels_do_not_depend_on_the_join_strategy(spark, monkeypatch):
    points = spark.createDataFrame([("d", i, 50, [float(i % 7), float(i % 5)]) for i in range(50)],
                                   "domain_id string, frame_global bigint, n_total bigint, e array<double>")
    plan = labels.resolution_plan(points.select("domain_id", "n_total").distinct(), (4,))
    start = scale.cut_lineage(labels.first_centroids(points, plan))
    one = labels.lloyd_step(points, start, 2, n_domains=1)
    other = labels.lloyd_step(points, start, 2, n_domains=10**9)
    assert sorted(one.collect()) == sorted(other.collect())


@pytest.mark.parametrize("name", ["torsion_coherence", "unfolded_filter", "residue_sasa", "split_assignment", "residue_atoms"])
def test_results_are_the_same_when_nothing_is_broadcast(spark, monkeypatch, name):
    expected = queries.REGISTERED[name](spark, SF).collect()
    monkeypatch.setattr(scale, "fits", lambda *args: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.REGISTERED[name](spark, SF)
        assert "BroadcastHashJoin" not in plan_of(plan)
        assert sorted(plan.collect(), key=str) == sorted(expected, key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
