import numpy as np
import pytest
from pyspark.sql import functions as F

from lineflow.config import FilterConfig, SplitConfig, configured, read_config
from lineflow.operators import metrics, split, stats
from lineflow.schema import EPISODE_DDL


def episode(method="m", seed=0, graph="g", success=True, **more):
    base = dict(method=method, seed=seed, split="val", graph_id=graph, project="p", cwe="CWE-119", num_nodes=10, num_vuln=1,
                dist_to_vuln=2, max_steps=40, success=success, first_declare_correct=success, nodes_inspected=3,
                actions_taken=3, cumulative_reward=0.98, first_hit_step=2, end_reason="correct" if success else "timeout")
    return tuple({**base, **more}.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, EPISODE_DDL)


def test_metrics_of_a_known_table(spark):
    df = frame(spark, [
        episode(nodes_inspected=3, actions_taken=3), episode(nodes_inspected=6, actions_taken=9),
        episode(success=False, nodes_inspected=2, actions_taken=5), episode(success=False, nodes_inspected=9, actions_taken=40)])
    m = metrics.compute_metrics(df).first()
    assert m.success_rate == 0.5 and m.nodes_inspected_all == (3 + 6 + 10 + 10) / 4
    assert m.actions_all == (3 + 9 + 40 + 40) / 4 and m.normalised_cost == pytest.approx(0.725)
    assert m.path_efficiency == (1 + 4) / 2 and m.nodes_inspected_success == 4.5
    none = metrics.compute_metrics(frame(spark, [episode(success=False)])).first()
    assert none.path_efficiency is None and none.nodes_inspected_success is None
    plain = metrics.summarize(df).first()
    assert plain.nodes_inspected == 5.0
    shares = {r.end_reason: r.share for r in metrics.end_shares(df).collect()}
    assert shares == {"correct": 0.5, "timeout": 0.5}


def test_bucket_edges(spark):
    df = frame(spark, [episode(num_nodes=n, dist_to_vuln=d, num_vuln=v)
                       for n, d, v in ((20, 2, 1), (21, 3, 2), (100, 10, 1), (101, 11, 3), (50, -1, 1), (51, 0, 1))])
    got = [(r.size_bucket, r.distance_bucket, r.vuln_bucket) for r in metrics.add_buckets(df).collect()]
    assert got == [("<=20", "1-2", "single"), ("21-50", "3-5", "multiple"), ("51-100", "6-10", "single"),
                   (">100", ">10", "multiple"), ("21-50", "1-2", "single"), ("51-100", "1-2", "single")]


def test_seeds(spark):
    df = frame(spark, [episode(seed=0), episode(seed=1, success=False), episode(seed=1)])
    r = metrics.metrics_across_seeds(df).first()
    assert r.seeds == 2 and r.success_rate_mean == 0.75 and r.success_rate_std == 0.25


def test_bootstrap_tree(spark):
    rng = np.random.default_rng(0)
    sample = np.round(rng.gamma(2.0, 3.0, size=3000), 2)
    draws = np.random.default_rng(1).integers(3000, size=(2000, 3000))
    expected = np.quantile(sample[draws].mean(axis=1), [0.025, 0.975])
    df = spark.createDataFrame(
        [("a", f"g{i:05d}", float(v)) for i, v in enumerate(sample)] + [("b", "g", 2.0), ("b", "h", None)],
        "m string, graph_id string, value double")
    spread = expected[1] - expected[0]
    for leaf in (5000, 100, 5):  # no inner node, one level, three levels
        rows = {r.m: r for r in stats.grouped_bootstrap(df, ["m"], n_resamples=2000, leaf_values=leaf).collect()}
        a = rows["a"]
        assert a.mean == pytest.approx(sample.mean()) and a.graphs == 3000
        assert abs(a.low - expected[0]) < 0.1 * spread and abs(a.high - expected[1]) < 0.1 * spread
        assert tuple(rows["b"])[1:] == (2.0, 2.0, 2.0, 1)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("'a' AS m", "string(id) AS graph_id", "double(id * id % 97) AS value")
    got = {tuple(stats.grouped_bootstrap(d, ["m"], n_resamples=300, leaf_values=10).first())
           for d in (df.coalesce(1), df.repartition(7), df.orderBy("value"))}
    assert len({tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in got}) == 1
    with pytest.raises(ValueError):
        stats.grouped_bootstrap(df, ["m"], confidence=1.0)


def test_bootstrap_spreads_its_leaves(spark):
    """All leaves are few bytes; they have to be worked on by more than one task all the same."""
    df = spark.range(6000).selectExpr("'a' AS m", "string(id) AS graph_id", "double(id) AS value")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("leaves", "leaves")
    stats.grouped_bootstrap(df, ["m"], n_resamples=20, leaf_values=100).collect()
    tasks = [before.getStageInfo(s).numTasks for j in before.getJobIdsForGroup("leaves") for s in before.getJobInfo(j).stageIds if before.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) >= 60


def test_both_ways_of_drawing_agree():
    rng = np.random.default_rng(0)
    values, counts = np.sort(rng.normal(size=40)), rng.integers(1, 5, 40)
    draws = np.full(4000, counts.sum())
    one = stats._leaf_totals(np.random.default_rng(1), values, counts, draws)
    dealt = np.random.default_rng(2).multinomial(draws, counts / counts.sum()) @ values
    assert abs(one.mean() - dealt.mean()) < 0.15 * dealt.std() and abs(one.std() / dealt.std() - 1) < 0.08
    none = stats._leaf_totals(np.random.default_rng(1), values, counts, np.zeros(5, dtype=np.int64))
    assert none.tolist() == [0.0] * 5


def test_tails(spark):
    import itertools
    import math

    from lineflow.functions import tails

    zs = [0.0, 1e-9, 0.3, 1.0, 2.5, 3.5, 3.54, 6.0, 20.0, -1.96]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(tails.normal_tail(F.col("z")).alias("p")).collect()
    for z, r in zip(zs, got, strict=True):
        assert r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-10, abs=1e-15)
    for n in (1, 5, 9):
        sums = [sum(c) for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k)]
        rows = spark.createDataFrame([(float(w), n) for w in range(n * (n + 1) // 4 + 1)], "w double, n int")
        for r in rows.select("w", tails.signed_rank_tail(F.col("w"), F.col("n")).alias("p")).collect():
            assert r.p == pytest.approx(min(1.0, 2 * sum(s <= r.w for s in sums) / 2**n))
    big = spark.createDataFrame([(400.0, 50)], "w double, n int").select(tails.signed_rank_tail(F.col("w"), F.col("n")).alias("p")).first()
    assert 0.01 < big.p < 0.05


def outcomes(spark, a, b, nodes=None):
    rows = []
    for i, (x, y) in enumerate(zip(a, b)):
        na, nb = nodes[i] if nodes else (3, 3)
        rows.append(episode("a", graph=f"g{i}", success=bool(x), num_nodes=20, nodes_inspected=na))
        rows.append(episode("b", graph=f"g{i}", success=bool(y), num_nodes=20, nodes_inspected=nb))
    return frame(spark, rows)


def test_paired_tests(spark):
    df = outcomes(spark, [1] * 12 + [0] * 2 + [1] * 6, [0] * 12 + [1] * 2 + [1] * 6)
    r = stats.mcnemar_success(df, "a", "b").first()
    assert (r.a_only, r.b_only, r.graphs) == (12, 2, 20) and r.p_value == pytest.approx(0.0129395, abs=1e-6)
    same = outcomes(spark, [1] * 5, [1] * 5)
    w = stats.wilcoxon_nodes_inspected(same, "a", "b").first()
    assert (w.statistic, w.p_value) == (0.0, 1.0) and stats.mcnemar_success(same, "a", "b").first().p_value == 1.0
    # Differences 1..6 all in one direction: the exact two-sided p-value is 2 / 2**6.
    ordered = outcomes(spark, [1] * 6, [1] * 6, [(1 + i + 1, 1) for i in range(6)])
    w = stats.wilcoxon_nodes_inspected(ordered, "b", "a").first()
    assert w.p_value == pytest.approx(2 / 64) and w.median_difference == -3.5
    with pytest.raises(ValueError, match="no episodes"):
        stats.check_pair(same, "a", "zz")
    table = stats.comparison_table(df, "a").collect()
    assert [t.method for t in table] == ["a", "b"] and table[0].p_success is None
    assert table[1].p_success == pytest.approx(0.0129395, abs=1e-6) and table[0].success.startswith("0.900 [")


def test_split_deals_like_one_by_one(spark):
    rng = np.random.default_rng(1)
    for _ in range(300):
        shares = [[0.8, 0.1, 0.1], [0.5, 0.5, 0.0], [0.34, 0.33, 0.33]][rng.integers(3)]
        counts, total = [int(x) for x in rng.integers(0, 50, 3)], int(rng.integers(1, 400))
        size, picks = int(rng.integers(1, 9)), int(rng.integers(0, 60))
        slow = list(counts)
        for _ in range(picks):
            live = [i for i in range(3) if shares[i] > 0]
            slow[max(live, key=lambda i: (shares[i] * total - slow[i], -i))] += size
        assert split.deal(counts, shares, total, size, picks)[0] == slow


def test_split_keeps_commits_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}_{j}", f"c{i}", "CWE-125" if i % 4 == 0 else "CWE-119", [f"body {i} {j}"])
            for i in range(120) for j in range(int(rng.integers(1, 5)))]
    df = spark.createDataFrame(rows, "sample_id string, commit_id string, cwe string, source_lines array<string>")
    done = split.split_by_commit(df).cache()
    assert done.count() == len(rows)
    split.check_no_leakage(done)
    shares = {r.split: r.share for r in split.split_summary(done).collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["val"] - 0.1) < 0.03
    again = split.split_by_commit(df.orderBy(F.desc("sample_id")))
    assert sorted(done.select("sample_id", "split").collect()) == sorted(again.select("sample_id", "split").collect())
    leaky = done.withColumn("split", F.when(F.col("sample_id") == "s0_0", "zzz").otherwise(F.col("split"))).unionByName(
        done.filter("sample_id = 's0_0'"))
    with pytest.raises(split.LeakageError):
        split.check_no_leakage(leaky)


def test_configs(tmp_path):
    with pytest.raises(ValueError, match="sum to 1"):
        SplitConfig(0.5, 0.1, 0.1)
    with pytest.raises(ValueError, match="takes"):
        configured(FilterConfig, {"nope": 1})
    (tmp_path / "c.json").write_text('{"filter": {"min_lines": 7}}')
    assert read_config(FilterConfig, tmp_path / "c.json", "filter").min_lines == 7
    (tmp_path / "e.json").write_text("")
    assert read_config(FilterConfig, tmp_path / "e.json") == FilterConfig()


def test_split_refuses_a_body_in_two_splits(spark, make_graphs):
    from conftest import line

    specs = [line(3, commit=f"c{i}", cwe="CWE-119") | {"id": f"g{i}"} for i in range(40)]
    with pytest.raises(split.LeakageError):
        split.split_by_commit(make_graphs(*specs))
    assert split.split_by_commit(make_graphs(*specs), check=False).count() == 40
