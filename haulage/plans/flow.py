"""Running a graph of steps, each a DataFrame of its parents; named runs keep outputs and do again only what is missing."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.cut import cut


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[..., DataFrame]
    after: tuple[int, ...] = ()
    #: what the step computes, for its fingerprint; the name if nothing else is said
    version: str = ""


class InvalidFlow(ValueError):
    pass


def order(steps: Sequence[Step]) -> list[int]:
    """Smallest ready step first. The first fault in step order is raised: none at all, itself, unknown, a cycle."""
    if not steps:
        raise InvalidFlow("no steps")
    for i, s in enumerate(steps):
        for d in s.after:
            if d == i:
                raise InvalidFlow(f"step {i} depends on itself")
            if not 0 <= d < len(steps):
                raise InvalidFlow(f"step {i} depends on unknown step {d}")
    waits = [len(set(s.after)) for s in steps]
    children: dict[int, list[int]] = {i: [] for i in range(len(steps))}
    for i, s in enumerate(steps):
        for d in set(s.after):
            children[d].append(i)
    ready = [i for i, w in enumerate(waits) if not w]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for c in children[i]:
            waits[c] -= 1
            if not waits[c]:
                heapq.heappush(ready, c)
    if len(out) < len(steps):
        raise InvalidFlow(f"cycle among steps {sorted(set(range(len(steps))) - set(out))}")
    return out


def waves(steps: Sequence[Step]) -> list[list[int]]:
    level: dict[int, int] = {}
    for i in order(steps):
        level[i] = 1 + max((level[d] for d in steps[i].after), default=-1)
    out: list[list[int]] = [[] for _ in range(max(level.values()) + 1)]
    for i in sorted(level):
        out[level[i]].append(i)
    return out


@dataclass
class Outcome:
    status: dict[int, str] = field(default_factory=dict)
    outputs: dict[int, DataFrame] = field(default_factory=dict)
    errors: dict[int, str] = field(default_factory=dict)

    @property
    def success(self) -> bool:
        return all(s in ("success", "resumed") for s in self.status.values())

    @property
    def first_failure(self) -> int | None:
        """The step's number."""
        return min((i for i, s in self.status.items() if s == "failed"), default=None)


def fingerprints(steps: Sequence[Step]) -> dict[int, str]:
    """Of each step: what it computes and what its parents do."""
    out: dict[int, str] = {}
    for i in order(steps):
        parts = [steps[i].name, steps[i].version, *(out[d] for d in steps[i].after)]
        out[i] = hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()
    return out


def run(spark: SparkSession, steps: Sequence[Step], path: str | None = None, name: str = "run", most: int = 8) -> Outcome:
    """Run the steps, wave by wave, those of a wave side by side (``most`` at once). With a path, outputs are kept as Parquet
    by run, step and fingerprint, and not made again; without one they are written to the session's shared folder.

    A step is a success when its output is written, so that a fault in its tasks is its own. It runs only if all its
    parents succeeded; all descendants of a failed step are skipped.
    """
    out, marks = Outcome(), fingerprints(steps)

    def one(i: int) -> None:
        s = steps[i]
        at = f"{path}/run={name}/step={i}/fp={marks[i]}" if path else None
        if any(out.status[d] in ("failed", "skipped") for d in s.after):
            out.status[i] = "skipped"
        elif at and _there(spark, at):
            out.outputs[i], out.status[i] = spark.read.parquet(at), "resumed"
        else:
            try:
                df = s.run(*[out.outputs[d] for d in s.after])
                if at:
                    df.write.mode("overwrite").parquet(at)
                out.outputs[i] = spark.read.parquet(at) if at else cut(df)
                out.status[i] = "success"
            except Exception as e:
                out.errors[i], out.status[i] = f"{type(e).__name__}: {e}", "failed"

    with ThreadPoolExecutor(most) as pool:
        for wave in waves(steps):
            list(pool.map(one, wave))
    return out


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def chain(names: Sequence[str], fns: Mapping[str, Callable[..., DataFrame]]) -> list[Step]:
    return [Step(n, fns[n], (i - 1,) if i else ()) for i, n in enumerate(names)]


def parallel(names: Sequence[str], fns: Mapping[str, Callable[..., DataFrame]]) -> list[Step]:
    return [Step(n, fns[n]) for n in names]
