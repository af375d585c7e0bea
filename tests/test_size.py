"""What must not grow faster than the input: pairs, rows of one task, rows in the driver."""

import random

import duckdb
import pytest

from haulage.operators import fold, placement, queueing
from haulage.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_nodes(tmp_path_factory):
    """The smallest tables with 40 times the nodes: copies under shifted keys."""
    d = tmp_path_factory.mktemp("nodes")
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        n, key = (40, "* REPLACE (s_suppkey + k * 1400 AS s_suppkey)") if t == "supplier" else (1, "*")
        duckdb.execute(f"COPY (SELECT {key.replace('*', '* EXCLUDE (k)', 1)} FROM '{SF}/{t}.parquet' CROSS JOIN range({n}) q(k)) TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["e6_retry_rank", "e4_place_advanced", "b1_transfers_needed", "b3_single_flight", "b8_traffic", "b9_output_retention", "f10_nodes_used", "e3_score_terms"])
def test_alike_nodes_make_no_more_pairs(spark, many_nodes, monkeypatch, name):
    seen, whole = [], placement.candidates

    def counted(*args):
        seen.append(whole(*args))
        return seen[-1]

    monkeypatch.setattr(placement, "candidates", counted)
    registry.queries()[name](spark, many_nodes).count()
    held = registry.queries()["d5_local_bytes"](spark, many_nodes).count()
    tasks = spark.read.parquet(f"{many_nodes}/orders.parquet").count()
    assert seen and all(df.count() <= held + 10 * tasks for df in seen)


def test_the_frontier_keeps_k_of_alike_nodes(spark):
    rows = [(None, 0.1 * (i % 5), 0.2, i, 10**6 * (1 + i % 5), 3.0) for i in range(500)]
    can = spark.createDataFrame(rows, "constraint_text string, cpu_usage double, memory_usage double, node_id long, bandwidth long, latency_ms double")
    for k in (1, 2, 3):
        assert sorted(r.node_id for r in placement.frontier(can, placement.Weights(), k).collect()) == [i + 5 * j for j in range(k) for i in range(5)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["h10_simulated_queue", "i1_lru", "h6_drop_lowest", "i2b_bounded_cache"])
def test_a_group_is_streamed(spark, name):
    assert "FlatMapGroupsInPandas" not in plan(registry.queries()[name](spark, SF))


def test_a_step_sees_batches(spark):
    def start():
        return lambda rows: [(-1, 0)] if rows is None else [(rows["x"][0], len(rows["x"]))]

    df = spark.range(25_000).selectExpr("id % 2 AS g", "-id AS x")
    got = fold.in_order(df, "g", ["x"], start, "g long, first long, n long").collect()
    for g in (0, 1):
        mine = [(r["first"], r.n) for r in got if r.g == g]
        assert mine[0][0] == -24_998 - g
        assert sum(n for _, n in mine) == 12_500 and mine[-1] == (-1, 0) and len(mine) >= 3


def test_queues_equal_plain_ones(spark):
    rng = random.Random(5)
    q = [(g, 1000 * g + i, rng.randrange(5), at, i) for g in range(3) for i, at in enumerate(rng.randrange(200) for _ in range(60))]
    df = spark.createDataFrame(q, "g long, task_id long, priority int, at long, seq long")
    level = lambda r, t, aging: min(4, r[2] + ((t - r[3]) // aging if aging else 0))
    for most, aging in ((3, 0), (4, 20), (0, 15)):
        fate, ran = {}, {}
        for g in range(3):
            held = []
            for r in sorted((r for r in q if r[0] == g), key=lambda r: r[4]):
                fate[r[1]] = "held"
                if not most or len(held) < most:
                    held.append(r)
                    continue
                low = min(held, key=lambda h: (level(h, r[3], aging), h[4]))
                if r[2] > level(low, r[3], aging):
                    fate[low[1]] = "displaced"
                    held = [h for h in held if h is not low] + [r]
                else:
                    fate[r[1]] = "refused"
            rows, held = sorted((r for r in q if r[0] == g), key=lambda r: (r[3], r[4])), []
            clock = rows[0][3]

            def pop(t, held=held, rows=rows):
                best = max(held, key=lambda h: (level(h, t, aging), -rows.index(h)))
                held.remove(best)
                ran[best[1]] = t

            for r in rows:
                while held and clock <= r[3]:
                    pop(clock)
                    clock += 7
                clock = clock if held else max(clock, r[3])
                if not most or len(held) < most:
                    held.append(r)
            while held:
                pop(clock)
                clock += 7
        assert {r.task_id: r.fate for r in queueing.admit_drop_lowest(df, "g", most, aging).collect()} == fate
        assert {r.task_id: r.ran_at for r in queueing.simulate(df, "g", most, aging, 7).collect()} == {r[1]: ran.get(r[1]) for r in q}


@pytest.mark.parametrize("name", ["m5c_sessions", "m4_known_senders"])
def test_a_drained_stream_lies_in_files(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() and "FileScan parquet" in plan(df)


@pytest.mark.parametrize("name", ["h2_pop_order", "h2b_next_up", "h4_reject", "h5_drop_oldest"])
def test_the_queue_is_not_sorted_by_one_task(spark, name):
    p = plan(registry.queries()[name](spark, SF))
    assert "row_number() windowspecdefinition(_lead" in p and "row_number() windowspecdefinition(o_orderdate" not in p
    assert name != "h2_pop_order" or "windowspecdefinition(effective" not in p


def test_the_spread_reaches_its_one_task_packed(spark):
    p = plan(registry.queries()["e7_spread"](spark, SF))
    assert p.count("MapInArrow") == 2 and "rangepartitioning(task_id" in p


@pytest.mark.parametrize("name", ["d5_local_bytes", "e2_place_locality", "d8_missing_bytes"])
def test_pairs_are_not_shuffled(spark, name):
    p = plan(registry.queries()[name](spark, SF))
    assert "Exchange" not in p[: p.index("Generate explode(")].replace("BroadcastExchange", "")
