"""Each stage of the pipeline against a brute-force version on its own input, and the stages in a row."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import CLASHES, ODD, SCHEMA, SF, check_packing, classes, words

import corpus_pipeline as pipeline
from haulage.llm import queries, toxicity

STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage gets and gives, as rows."""
    docs = queries.table(spark, SF, "documents")
    out = {"documents": docs.collect()}
    for name, stage in pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        out[name] = rows
        if name != "packing":
            docs = spark.createDataFrame(rows, SCHEMA)
    return out


def plain(rows):
    return Counter(tuple(r[c] for c in pipeline.COLUMNS) for r in rows)


def test_order_and_columns():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    assert pipeline.ORACLE_SQL is None


def test_toxicity_stage(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    own = sorted((labels[r.doc_id], r.text) for r in steps["documents"] if r.doc_id in labels)
    f, y = list(toxicity.features([t for _, t in own])), np.array([y for y, _ in own])
    n = [sum(v == x for v in labels.values()) / max(1, (y == x).sum()) for x in (0, 1)]
    model = toxicity.fit([a for a, _ in f], [b for _, b in f], y, tuple(n))
    score = toxicity.score_texts([r.text for r in steps["documents"]], model)
    assert plain(steps["toxicity"]) == plain([r for r, s in zip(steps["documents"], score, strict=True) if s < 0.3])
    assert 0.5 < len(steps["toxicity"]) / len(steps["documents"]) < 1


def brute_dedup(rows, least=25):
    """Every run of the fewest lines that hold so many words, from each line on and back, against all others."""
    n = lambda x: x.count(" ") + x.count("\t") + 1
    rows = sorted(rows, key=lambda r: r.doc_id)
    split = [r.text.split("\n") for r in rows]
    found = defaultdict(set)
    for d, ls in enumerate(split):
        for i in range(len(ls)):
            for step in (1, -1):
                j, total = i, 0
                while 0 <= j < len(ls) and total < least:
                    total += n(ls[j])
                    j += step
                if total >= least:
                    lo, hi = min(i, j - step), max(i, j - step)
                    found[tuple(ls[lo : hi + 1])].add((d, lo, hi))
    gone = defaultdict(set)
    for places in found.values():
        first = min(places)
        for d, lo, hi in places:
            if not (d == first[0] and lo <= first[1] + hi - lo):
                gone[d] |= set(range(lo, hi + 1))
    out = []
    for d, r in enumerate(rows):
        text = "\n".join(x for i, x in enumerate(split[d]) if i not in gone[d]) if d in gone else r.text
        if d not in gone or words(text):
            out.append({**r.asDict(), "text": text, "n_chars": len(text) if d in gone else r.n_chars})
    return out


def test_line_dedup_stage(steps):
    want = brute_dedup(steps["toxicity"])
    assert plain(steps["line_dedup"]) == plain(want)
    assert sum(len(r["text"]) for r in want) < sum(len(r.text) for r in steps["toxicity"])


def test_near_stage(steps):
    rows = sorted(steps["line_dedup"], key=lambda r: r.doc_id)
    named = classes([(i, r.text) for i, r in enumerate(rows)])
    want = [rows[i] for i, _, c in named if i == c]
    assert plain(steps["ngram_jaccard"]) == plain(want) and len(want) < len(rows)


def test_mixing_stage(steps):
    rows = [(r, len(words(r.text))) for r in steps["ngram_jaccard"]]
    by = defaultdict(list)
    for r, n in rows:
        by[r.source].append((n, r.doc_id, zlib.crc32(r.text.encode()), r))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[0] for x in by[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, target = float(sum(size.values())), set(names), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}:
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    want = Counter()
    for s in names:
        e = target[s] / size[s] if size[s] else 0.0
        u = int(hashlib.md5(("mix" + (s if s is not None else "\0")).encode()).hexdigest()[:8], 16) / 2**32
        for i, x in enumerate(sorted(by[s], key=lambda x: x[:3])):
            k = max(0, min(3, math.floor(e * (i + 1) + u) - math.floor(e * i + u)))
            if k:
                want[tuple(x[3][c] for c in pipeline.COLUMNS)] += k
    assert plain(steps["mixing"]) == want


def test_packing_stage(steps):
    assert check_packing([(r.doc_id, r.text) for r in steps["mixing"]], steps["packing"]) > 0.95


def test_run_is_the_stages_in_a_row(spark, steps):
    key = lambda rows: Counter((r.doc_id, r.doc_tokens, r.start == 0) for r in rows if r.start == 0)
    got = pipeline.run(spark, SF)
    assert key(got.collect()) == key(steps["packing"])


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_of_odd_rows(spark, name):
    odd = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in (*CLASHES, "_score", "_")])
    out = STAGE[name](spark, odd, SF)
    if name != "packing":
        assert out.columns == list(pipeline.COLUMNS)
    got = {r.doc_id for r in out.collect()}
    if name != "mixing":  # which need not take every document
        assert got == {r[0] for r in ODD} - ({None} if name == "ngram_jaccard" else set())
    assert STAGE[name](spark, odd.limit(0), SF).collect() == []
