"""Literal cases: what each operator must give on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from haulage.functions import columns as C
from haulage.functions import kinds
from haulage.operators import catalog, content, control, graph, metrics, placement, queueing, state
from haulage.plans import flow, registry
from haulage.plans.api import Mesh
from haulage.schemas import view
from haulage.sources import config, journal
from haulage.streaming import monitor

NODE = "node_id long, cpu_cores int, cpu_usage double, memory_usage double, bandwidth long, latency_ms double, gpu string"


def nodes(spark, *rows):
    return spark.createDataFrame([(n, 4, *r) for n, *r in rows], NODE)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_hash_task_digests_payload_then_inputs(spark):
    t = spark.createDataFrame([(1, "seed"), (2, "alone"), (3, "lost")], "task_id long, payload string")
    i = spark.createDataFrame([(1, 1, b"second"), (1, 0, b"first"), (3, 0, None)], "task_id long, pos int, data binary")
    got = {r.task_id: r.digest for r in content.hash_task(t, i).collect()}
    assert got == {1: kinds.digest(b"seedfirstsecond"), 2: kinds.digest(b"alone"), 3: None}


def test_unknown_kinds_fail_as_rows(spark):
    t = spark.createDataFrame([("rm -rf", "x"), ("echo", "x"), ("upper", "aé")], "kind string, payload string")
    got = {r.kind: (r.output, r.error) for r in kinds.run_kinds(t).collect()}
    assert got["rm -rf"] == (None, "unknown task kind: rm -rf") and bytes(got["echo"][0]) == b"x" and bytes(got["upper"][0]) == "Aé".encode()


def test_kinds_run_as_the_executor_does(spark):
    eight = lambda n: n.to_bytes(8, "little")
    t = [(1, "cpu", eight(2)), (2, "cpu", b"abc"), (3, "cpu", eight(50_000_001)), (4, "hash", b"seed"), (5, "hash", b"seed"), (6, "echo", b""), (7, "twice", b"ab"), (8, "twice", b"x"), (9, "cpu", eight(0))]
    i = [(4, 1, 8, b"second"), (4, 0, 9, b"first"), (5, 0, 7, b"a"), (5, 1, 3, None), (5, 2, 2, None), (7, 0, 9, b"!")]
    tasks = spark.createDataFrame(t, "task_id long, kind string, payload binary")
    inputs = spark.createDataFrame(i, "task_id long, pos int, data_id long, data binary")

    def twice(payload, xs):
        return payload * 2 + xs[0]

    got = {r.task_id: (None if r.output is None else bytes(r.output), r.error) for r in kinds.run_kinds(tasks, inputs, {"twice": twice}).collect()}
    assert got[1] == (eight(1), None) and got[9] == (eight(0), None) and got[6] == (b"", None) and got[7] == (b"abab!", None)
    assert got[4] == (kinds.digest(b"seedfirstsecond").encode(), None) and got[5] == (None, "missing input: 3")
    assert got[2][0] is None and "3" in got[2][1] and got[3][0] is None and "50000001" in got[3][1] and got[8][1].startswith("IndexError")


def test_zero_is_no_bound(spark):
    q = spark.createDataFrame([(0, 10 + i, i % 5, i, i) for i in range(6)], "g long, task_id long, priority int, at long, seq long")
    assert queueing.admit_reject(q, 0).where("admitted").count() == queueing.admit_drop_oldest(q, 0).where("admitted").count() == 6
    assert queueing.admit_drop_lowest(q, "g", 0).where("fate = 'held'").count() == 6
    assert queueing.simulate(q, "g", 0, 10, 5).where("ran_at is not null").count() == 6


def test_a_waiting_task_is_harder_to_displace(spark):
    q = spark.createDataFrame([(0, 1, 1, 0, 0), (0, 2, 1, 20, 1), (0, 3, 2, 20, 2)], "g long, task_id long, priority int, at long, seq long")
    assert {r.task_id: r.fate for r in queueing.admit_drop_lowest(q, "g", 2, 10).collect()} == {1: "held", 2: "displaced", 3: "held"}


def test_a_retry_forgets_what_the_failed_node_held(spark):
    ns = nodes(spark, (1, 0.0, 0.0, 10**6, 1.0, None), (2, 0.2, 0.0, 10**6, 1.0, None), (3, 0.1, 0.0, 10**6, 1.0, None))
    tasks = spark.createDataFrame([(1, None, 0), (2, None, 0), (3, "gpu", 0)], "task_id long, constraint_text string, payload_bytes long")
    inputs = spark.createDataFrame([(1, 7), (1, 8)], "task_id long, data_id long")
    D, L = held(spark, [(7, 10**7), (8, 10**5)], [(7, 1), (8, 2)])
    args = (tasks, ns, inputs, L, D, placement.label_rule())
    got = {r.task_id: (r.node_id, r.attempts) for r in placement.place_with_retries(*args, F.col("node_id") == 1).collect()}
    # with node 1 gone dataset 7 is nowhere, so that node 2 holds all there is of task 1's inputs
    assert got == {1: (2, 2), 2: (3, 2), 3: (None, 0)}
    assert {r.task_id: (r.node_id, r.attempts) for r in placement.place_with_retries(*args, F.lit(True), 2).collect()} == {1: (None, 2), 2: (None, 2), 3: (None, 0)}


def test_a_step_that_fails_in_its_tasks_is_failed(spark):
    boom = lambda: spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    steps = [flow.Step("a", boom), flow.Step("b", lambda a: a, (0,)), flow.Step("c", lambda: spark.range(2)), flow.Step("d", lambda c: c.where("id > 0"), (2,))]
    got = flow.run(spark, steps)
    assert got.status == {0: "failed", 1: "skipped", 2: "success", 3: "success"} and got.outputs[3].count() == 1


def test_graphs_deeper_than_the_bound_are_an_error(spark):
    s = spark.createDataFrame([(0, i) for i in range(4)], "run long, step long")
    e = spark.createDataFrame([(0, i, i + 1) for i in range(3)], "run long, src long, dst long")
    assert graph.waves(s, e, 5).count() == 4
    for f in (lambda: graph.waves(s, e, 3), lambda: graph.skipped(e, s.where("step = 0"), 2)):
        with pytest.raises(RuntimeError):
            f()


def test_cpu_folds_and_refuses(spark):
    def slow(n):
        acc = 0
        for i in range(n):
            acc = (acc * 6364136223846793005 + i) % 2**64
        return acc

    data = [(n.to_bytes(8, "little"),) for n in (0, 1, 5, 1000, 50_000_000, 50_000_001)] + [(b"abc",), (None,)]
    got = [r.x for r in spark.createDataFrame(data, "p binary").select(kinds.cpu("p").alias("x")).collect()]
    assert got[:4] == [str(slow(n)) for n in (0, 1, 5, 1000)] and got[4] is not None and got[5:] == [None] * 3
    assert int(one(spark, C.lcg_fold(F.lit(100)))) == slow(100)


def test_modules_see_payload_and_inputs_and_never_end_the_query(spark):
    plus = kinds.module(lambda p, xs: bytes(b + 1 for b in p) + b"".join(xs))
    df = spark.createDataFrame([(b"\x01\x02\x03", [b"z"]), (b"\xff", [])], "p binary, xs array<binary>").select(plus("p", "xs").alias("r"))
    a, b = df.collect()
    assert bytes(a.r.output) == b"\x02\x03\x04z" and b.r.output is None and b.r.error.startswith("ValueError")


@pytest.mark.parametrize(("text", "level"), [("CRITICAL", 4), ("", 2), ("urgent", None)])
def test_priorities(spark, text, level):
    assert one(spark, C.priority_level(F.lit(text))) == level


def test_codec_and_unmeasured_links(spark):
    got = [one(spark, C.codec(F.lit(s), F.lit(b).cast("long"))) for s, b in ((4095, None), (4096, None), (4096, 104857600), (4096, 104857599))]
    assert got == ["none", "lz4", "none", "lz4"]


def test_least_loaded_and_constraints(spark):
    t = spark.createDataFrame([(1, None), (2, "gpu=true"), (3, "gpu!=true"), (4, "zone")], "task_id long, constraint_text string")
    n = nodes(spark, (1, 0.9, 0.1, None, None, "true"), (2, 0.1, 0.9, None, None, None))
    got = {r.task_id: r.node_id for r in placement.least_loaded(t, n, placement.label_rule()).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 1}
    m = nodes(spark, (1, 0.5, 0.8, None, None, None), (2, 0.5, 0.2, None, None, None))
    assert placement.least_loaded(t.where("task_id = 1"), m, placement.label_rule()).first().node_id == 2


def held(spark, sizes, where):
    return spark.createDataFrame(sizes, "data_id long, size_bytes long"), spark.createDataFrame(where, "data_id long, node_id long")


def test_locality_wins_over_load(spark):
    d, loc = held(spark, [(1, 100), (2, 10_000)], [(1, 0), (2, 1)])
    t = spark.createDataFrame([(1, None)], "task_id long, constraint_text string")
    i = spark.createDataFrame([(1, 1), (1, 2)], "task_id long, data_id long")
    n = nodes(spark, (0, 0.0, 0.0, None, None, None), (1, 0.9, 0.9, None, None, None))
    r = placement.by_locality(t, n, i, loc, d, placement.label_rule()).first()
    assert (r.node_id, r.local_bytes) == (1, 10_000)


def test_score_terms(spark):
    d, loc = held(spark, [(1, 1_000_000)], [(1, 1)])
    t = spark.createDataFrame([(1, None, 0)], "task_id long, constraint_text string, payload_bytes long")
    i = spark.createDataFrame([(1, 1)], "task_id long, data_id long")
    n = nodes(spark, (1, 0.5, 0.5, 1_000_000, 10.0, None))
    r = placement.cheapest(placement.scores(t, n, i, loc, d, placement.label_rule())).first()
    assert (r.compute, r.transfer, r.latency, r.bonus, r.total) == (0.75, 0.0, 0.01, 1.0, -0.24)


def test_pruned_scores_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    ns = [(n, rng.choice([0.1, 0.5, rng.random()]), rng.random(), rng.choice([None, 10**6, 10**7, 10**8]), rng.choice([None, 1.0, 90.0]), rng.choice([None, "true"])) for n in range(60)]
    d = [(k, rng.randrange(1, 10**8)) for k in range(40)]
    loc = [(k, rng.randrange(60)) for k, _ in d for _ in range(2) if k % 5]
    t = [(k, rng.choice([None, "gpu", "gpu!=true"]), rng.randrange(10**6)) for k in range(80)]
    i = [(k, rng.randrange(40)) for k, _, _ in t for _ in range(rng.randrange(4))]
    there = set(loc)
    have = {k for k, _ in loc}
    ok = {None: lambda g: True, "gpu": lambda g: g is not None, "gpu!=true": lambda g: g != "true"}
    want = {}
    for k, c, p in t:
        own = [x for q, x in i if q == k and x in have]
        total = sum(dict(d)[x] for x in own)
        costs = []
        for n, cpu, mem, bw, lat, g in ns:
            if ok[c](g):
                here = sum(dict(d)[x] for x in own if (x, n) in there)
                costs.append((round(round(cpu + mem * 0.5, 6) + round((max(total - here, 0) + p) / (bw or 12.5e6), 6) + round((50.0 if lat is None else lat) / 1000, 6) - round(here / total if total else 0, 6), 6), cpu, mem, n))
        want[k] = [x[3] for x in sorted(costs)[:3]]
    D, L = held(spark, d, sorted(there))
    args = (spark.createDataFrame(t, "task_id long, constraint_text string, payload_bytes long"), nodes(spark, *ns), spark.createDataFrame(i, "task_id long, data_id long"), L, D, placement.label_rule())
    assert {r.task_id: r.node_id for r in placement.cheapest(placement.scores(*args)).collect()} == {k: v[0] for k, v in want.items()}
    up = {r.task_id: (r.node_id, r.attempts) for r in placement.with_retries(placement.scores(*args, k=3), F.col("node_id") % 2 == 0).collect()}
    for k, v in want.items():
        first = next((a for a, n in enumerate(v, 1) if n % 2), None)
        assert up[k] == ((v[first - 1], first) if first else (None, len(v)))


def test_local_bytes_and_holdings(spark):
    d, loc = held(spark, [(1, 1000), (2, 500), (3, 9000)], [(1, 0), (2, 0), (2, 1), (3, 1)])
    n = spark.createDataFrame([(0,), (1,), (2,)], "node_id long")
    assert {r.node_id: (r.held, r.held_bytes) for r in catalog.held_by(n, loc, d).collect()} == {0: (2, 1500), 1: (2, 9500), 2: (0, 0)}
    i = spark.createDataFrame([(7, 1), (7, 1), (7, 99)], "task_id long, data_id long")
    assert catalog.local_bytes(i, loc, d).first().local_bytes == 2000


def test_spread_raises_load_as_it_goes(spark):
    t = spark.createDataFrame([(k, 0) for k in range(8)], "task_id long, g int")
    n = nodes(spark, (1, 0.0, 0.0, None, None, None), (2, 0.0, 0.1, None, None, None))
    got = [r.node_id for r in placement.spread(t, n, "g").orderBy("task_id").collect()]
    assert got == [1, 2] * 4


def greedy(tasks, pool):
    """node_id and load of each task by looking at every node; pool: node_id, cores, cpu, memory, gpu."""
    meets = {None: lambda g: True, "gpu": lambda g: g is not None, "gpu=true": lambda g: g == "true", "gpu!=true": lambda g: g != "true"}
    pending, out = {p[0]: 0 for p in pool}, {}
    for task, constraint in sorted(tasks, key=lambda x: x[0]):
        can = [(min(1.0, cpu + pending[n] / max(1, cores)), memory, n) for n, cores, cpu, memory, gpu in pool if meets[constraint](gpu)]
        load, _, n = min(can, default=(None, None, None))
        out[task] = (n, load)
        if n is not None:
            pending[n] += 1
    return out


@pytest.mark.parametrize("gpus", [[None, "true", "false"], [None]])
def test_spread_is_greedy_under_constraints(spark, gpus):
    rng = random.Random(5)
    pool = [(n, 4, rng.randrange(80) / 100, rng.randrange(3) / 10, rng.choice(gpus)) for n in range(30)]
    tasks = [(k, rng.choice([None, "gpu", "gpu=true", "gpu!=true"])) for k in range(200)]
    rng.shuffle(tasks)
    n = nodes(spark, *[(i, cpu, memory, None, None, gpu) for i, _, cpu, memory, gpu in pool])
    got = placement.spread(spark.createDataFrame(tasks, "task_id long, constraint_text string").repartition(3), n, rule=placement.label_rule()).collect()
    assert len(got) == 200 and {r.task_id: (r.node_id, r.load) for r in got} == greedy(tasks, pool)


def test_spread_query_sees_all_tasks_and_nodes(spark):
    sf = "/root/testdata/sf0.01"
    tasks = [tuple(r) for r in view(spark, sf, "m_tasks").select("task_id", "constraint_text").collect()]
    pool = [tuple(r) for r in view(spark, sf, "m_nodes").select("node_id", "cpu_cores", "cpu_usage", "memory_usage", "gpu").collect()]
    got = {r.task_id: (r.node_id, r.load) for r in registry.queries()["e7_spread"](spark, sf).collect()}
    assert got == greedy(tasks, pool)
    assert max(n for n, _ in got.values()) > 16


def test_mesh_errors_in_order(spark):
    have = spark.createDataFrame([("a", "x"), ("b", None)], "hostname string, label string")
    want = lambda *r: spark.createDataFrame(list(r), "hostname string, label string")
    check = lambda e: catalog.mesh_check(e, have).first().error
    assert check(want()) == "no nodes are expected" and check(want(("a", None))) == "expected 1, found 2"
    assert check(want(("a", None), ("c", None))) == "missing host c" and check(want(("a", "x"), ("b", "y"))) == "missing label on b" and check(want(("a", "x"), ("b", None))) is None


def test_queue_policies(spark):
    q = spark.createDataFrame([(0, 10, 0, 0, 0), (0, 11, 1, 0, 1), (0, 12, 4, 0, 2), (0, 13, 0, 0, 3), (0, 14, 2, 0, 4)], "g long, task_id long, priority int, at long, seq long")
    fate = {r.task_id: r.fate for r in queueing.admit_drop_lowest(q, "g", 2).collect()}
    assert fate == {10: "displaced", 11: "displaced", 12: "held", 13: "refused", 14: "held"}
    aged = queueing.admit_drop_lowest(q.withColumn("at", F.col("seq") * 100), "g", 2, 100)
    assert {r.task_id for r in aged.where("fate = 'held'").collect()} <= {10, 11, 12, 13, 14}
    assert one(spark, C.effective_priority(F.lit(1), F.lit(95), 30)) == 4 and one(spark, C.effective_priority(F.lit(1), F.lit(95), 0)) == 1


def test_lru_never_drops_what_it_just_stored(spark):
    a = spark.createDataFrame([(1, 1, 7, 60), (1, 2, 8, 60), (1, 3, 7, 60), (1, 4, 9, 500), (1, 5, 9, 500)], "node_id long, seq long, data_id long, size_bytes long")
    got = [(r.hit, r.evicted) for r in state.lru(a, 120).orderBy("seq").collect()]
    assert got == [(False, []), (False, []), (True, []), (False, [8, 7]), (True, [])]


def test_bounded_cache_is_first_in_first_out(spark):
    w = spark.createDataFrame([(0, i, k, ok) for i, (k, ok) in enumerate([("a", False), ("a", True), ("b", True), ("a", True), ("c", True), ("a", True)])], "g long, seq long, work_key string, success boolean")
    assert [r.hit for r in state.bounded_cache(w, "g", 2).orderBy("seq").collect()] == [False, False, False, True, False, False]
    assert not state.bounded_cache(w, "g", 0).where("hit").count()


def test_cooldown_holds_decisions_back(spark):
    s = spark.createDataFrame([(0, t, 1, 9, 3.0) for t in (0, 5, 12)], "g long, at long, nodes long, depth long, ratio double")
    assert [r.action for r in control.decide_in_order(s, "g", 10).orderBy("at").collect()] == ["up", "none", "up"]


def test_waves_of_wide_and_cyclic_graphs(spark):
    steps = spark.createDataFrame([(0, i) for i in range(502)] + [(1, i) for i in range(4)], "run long, step long")
    edges = spark.createDataFrame([(0, 0, i) for i in range(1, 501)] + [(0, i, 501) for i in range(1, 501)] + [(1, 0, 1), (1, 0, 1), (1, 2, 3), (1, 3, 2)], "run long, src long, dst long")
    w = {(r.run, r.step): r.wave for r in graph.waves(steps, edges).collect()}
    assert [sum(1 for k, v in w.items() if k[0] == 0 and v == x) for x in range(3)] == [1, 500, 1] and w[1, 1] == 1
    assert {(r.run, r.step) for r in graph.stuck(steps, edges).collect()} == {(1, 2), (1, 3)}


def test_join_runs_only_if_all_parents_did(spark):
    s = spark.createDataFrame([(0, i) for i in range(5)], "run long, step long")
    e = spark.createDataFrame([(0, 0, 2), (0, 1, 2), (0, 2, 3), (0, 3, 4)], "run long, src long, dst long")
    none = s.limit(0)
    got = {r.step: r.status for r in graph.outcomes(s, e, s.where("step = 0"), none).collect()}
    assert got == {0: "failed", 1: "success", 2: "skipped", 3: "skipped", 4: "skipped"}


def test_flow_validates_orders_fails_and_resumes(spark, tmp_path):
    ran = []

    def make(name, fail=False):
        def fn(*parents):
            ran.append(name)
            if fail:
                raise RuntimeError("no")
            return parents[0].withColumn(name, F.lit(1)) if parents else spark.range(3)

        return fn

    diamond = lambda fail: [flow.Step("a", make("a")), flow.Step("b", make("b"), (0, 0)), flow.Step("c", make("c"), (0,)), flow.Step("d", make("d", fail), (1, 2)), flow.Step("e", make("e"), (3,))]
    assert flow.waves(diamond(False)) == [[0], [1, 2], [3], [4]]
    for bad in ([], [flow.Step("x", make("x"), (0,))], [flow.Step("x", make("x"), (7,)), flow.Step("y", make("y"))], [flow.Step("x", make("x"), (1,)), flow.Step("y", make("y"), (0,))]):
        with pytest.raises(flow.InvalidFlow):
            flow.order(bad)
    first = flow.run(spark, diamond(True), str(tmp_path), "r")
    assert first.status == {0: "success", 1: "success", 2: "success", 3: "failed", 4: "skipped"} and first.first_failure == 3 and not first.success
    ran.clear()
    again = flow.run(spark, diamond(False), str(tmp_path), "r")
    assert ran == ["d", "e"] and again.success and again.status[0] == "resumed" and again.outputs[4].count() == 3


def test_journal_passes_over_torn_lines(spark, tmp_path):
    path = str(tmp_path / "j")
    journal.append(spark.createDataFrame([("r", "f", 1, "t", "n", "o", 5)], journal.RECORD), path)
    (tmp_path / "j" / "torn.json").write_text('{"run": "r", "step": 2, "fingerp')
    journal.append(spark.createDataFrame([("r", "f", 3, "t", "n", "o", 5)], journal.RECORD), path)
    assert sorted(r.step for r in journal.read(spark, path).collect()) == [1, 3]


def test_chunks_of_empty_and_exact_sizes(spark):
    b = spark.createDataFrame([(1, b""), (2, b"x" * 8), (3, b"x" * 9)], "id long, data binary")
    got = {}
    for r in content.split(b, 4).collect():
        got.setdefault(r.id, []).append(r.chunk_size)
    assert got == {2: [4, 4], 3: [4, 4, 1]}


def test_reassembly_tells_what_is_wrong(spark):
    b = content.address(spark.createDataFrame([(1, b"abcdefgh"), (2, b"12345678"), (3, b"ABCDEFGH")], "id long, data binary"))
    c = content.split(b, 4).select("data_id", "index", "chunk", "chunk_id", "id")
    sent = c.where("not (id = 2 and index = 1)").withColumn("chunk", F.when(F.col("id") == 3, F.lit(b"zzzz")).otherwise(F.col("chunk")))
    got = {r.data_id: r.status for r in content.reassemble(c, sent.unionByName(sent)).collect()}
    ids = {r.id: r.data_id for r in b.collect()}
    assert {k: got[v] for k, v in ids.items()} == {1: "ok", 2: "missing", 3: "bad_chunk"}


def test_regression_against_itself(spark):
    m = spark.createDataFrame([("bytes", 100.0, True, 2.0, True)], "metric string, value double, lower_is_better boolean, tolerance double, gating boolean")
    g = control.gate(control.regressions(m, m), F.lit(True)).first()
    assert (g.refused, g.failed, g.warnings) == (False, False, 0)
    worse = control.gate(control.regressions(m, m.withColumn("value", F.lit(102.5))), F.lit(True)).first()
    assert worse.failed


def test_mesh_moves_a_shared_dataset_once_a_node(spark):
    tasks = spark.createDataFrame([(k, k % 3) for k in range(100)], "task_id long, node_id long")
    i = spark.createDataFrame([(k, 1) for k in range(100)], "task_id long, data_id long")
    d, loc = held(spark, [(1, 16 << 20)], [(99, 99)])
    moved = content.transfers(tasks, i, loc, d)
    assert moved.count() == 3 and moved.agg(F.sum("size_bytes")).first()[0] == 3 * (16 << 20)


def test_percentiles_of_nothing_and_one(spark):
    e = spark.createDataFrame([], "v double")
    assert e.agg(metrics.percentile("v", 0.5).alias("p")).first().p == 0
    assert spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "v double").agg(metrics.percentile("v", 0.5).alias("p")).first().p == 2.0


def test_facade(spark):
    n = nodes(spark, (1, 0.1, 0.1, None, None, None), (2, 0.9, 0.9, None, None, "true")).withColumn("hostname", F.lit("h"))
    mesh = Mesh(spark, n, *held(spark, [(1, 10)], [(1, 2)]))
    out = {r.task_id: r for r in mesh.map("echo", ["a", "b"]).collect()}
    assert bytes(out[1].output) == b"b" and out[0].node_id == 1
    with pytest.raises(TypeError):
        mesh.map(len, ["a"])
    assert mesh.stats().first().nodes == 2 and mesh.summary().count() == 2


def test_stream_join_of_requests_and_replies(spark, tmp_path):
    for name, rows in (("q", [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")]), ("r", [(1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:09:00")])):
        spark.createDataFrame(rows, "key long, at string").select("key", F.to_timestamp("at").alias("ts")).write.parquet(str(tmp_path / name))
    s = lambda name: spark.readStream.schema("key long, ts timestamp").parquet(str(tmp_path / name)).withWatermark("ts", "1 minute")
    assert [r.key for r in monitor.drain(monitor.reply_times(s("q"), s("r"), "30 seconds"), "append").collect()] == [1]


def test_options_from_text_and_session(spark, tmp_path):
    assert config.load(None) == config.Options()
    path = tmp_path / "o.toml"
    path.write_text('max_queue_size = 7\nqueue_rejection = "drop_oldest"')
    assert config.load(str(path)).max_queue_size == 7
    for bad in ("nonsense = 1", "max_queue_size = 'x'", "max_queue_size = -1", "queue_rejection = 'x'", "a ="):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none"))
    spark.conf.set("haulage.max_queue_size", "3")
    try:
        assert config.from_session(spark).max_queue_size == 3
    finally:
        spark.conf.unset("haulage.max_queue_size")
    assert monitor.trigger(0) is None and monitor.trigger(5) == {"processingTime": "5 seconds"}


def test_seeded_bytes_follow_the_generator(spark):
    state, want = (2**63 * journal.STEP + 1) % 2**64, b""
    while len(want) < 30_001:
        state = (state * journal.STEP + journal.SHIFT) % 2**64
        want += state.to_bytes(8, "little")
    got = b"".join(bytes(r.data) for r in journal.seeded(spark, 2**63, 30_001).orderBy("pos").collect())
    assert got == want[:30_001] and journal.seeded(spark, 1, 0).count() == 0


def test_broken_blocks_are_errors(spark):
    df = spark.createDataFrame([("lz4", b"\xff\xff\xff\xff1"), ("lz4", b""), ("zip", b"x"), ("none", b"x"), ("lz4", None), ("lz4", b"\x05\0\0\0zzzz")], "c string, b binary")
    got = [(r.r.data, r.r.error is None) for r in df.select(kinds.decompress(F.col("c"), F.col("b")).alias("r")).collect()]
    assert [x[1] for x in got] == [False, False, False, True, True, False] and bytes(got[3][0]) == b"x" and got[4][0] is None
    back = spark.createDataFrame([(b"",), (b"a" * 100_000,)], "b binary").select(kinds.decompress(F.lit("lz4"), kinds.compress(F.lit("lz4"), F.col("b"))).alias("r")).collect()
    assert [bytes(r.r.data) for r in back] == [b"", b"a" * 100_000]


def test_screen_closes_a_liars_connection(spark):
    said = spark.createDataFrame([(1, 1, 1, 10), (2, 1, 2, 11), (3, 1, 1, 12), (4, 2, 2, 10), (5, None, 2, 11), (6, 2, 2, 99), (7, 2, 2, 12)], "seq long, sender long, claimed long, task_id long")
    pending = spark.createDataFrame([(10,), (11,), (12,)], "task_id long")
    want = ["accepted", "impostor", "closed", "unknown or expired task", "unregistered", "unknown or expired task", "accepted"]
    assert [r.verdict for r in monitor.screen(said, pending).orderBy("seq").collect()] == want
