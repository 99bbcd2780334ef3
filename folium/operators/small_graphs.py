"""Components and needless edges of many small graphs at once, a graph in one task (for G5 to G8).

Rows are grouped by run, so that a task meets whole graphs one after another. Only graphs within a bound of edges come here;
graph.py has other ways for larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def strong(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """The number of each node's strong component, by one depth-first walk; edges are between nodes 0 to n - 1."""
    order = np.argsort(src, kind="stable")
    to, begin = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    seen, low, comp, path, found, clock = [-1] * n, [0] * n, [-1] * n, [], 0, 0
    for start in range(n):
        if seen[start] >= 0:
            continue
        walk = [(start, begin[start])]
        seen[start] = low[start] = clock
        clock += 1
        path.append(start)
        while walk:
            v, at = walk.pop()
            while at < begin[v + 1] and seen[to[at]] >= 0:
                if comp[to[at]] < 0:
                    low[v] = min(low[v], seen[to[at]])
                at += 1
            if at < begin[v + 1]:
                w = to[at]
                walk += [(v, at + 1), (w, begin[w])]
                seen[w] = low[w] = clock
                clock += 1
                path.append(w)
                continue
            if low[v] == seen[v]:
                while True:
                    w = path.pop()
                    comp[w] = found
                    if w == v:
                        break
                found += 1
            if walk:
                low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
    return comp


def needless(n: int, src: np.ndarray, dst: np.ndarray) -> list[bool]:
    """Of each edge of a graph without cycles, whether another way leads from its start to its end; reach is kept as bits."""
    degree = np.bincount(src, minlength=n).tolist()
    back = [[] for _ in range(n)]
    out = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        back[b].append(a)
        out[a].append(b)
    ready, reach, through = [v for v in range(n) if not degree[v]], [0] * n, [0] * n
    while ready:
        v = ready.pop()
        for w in out[v]:
            through[v] |= reach[w]  # in two steps and more
            reach[v] |= reach[w] | 1 << w
        for u in back[v]:
            degree[u] -= 1
            if not degree[u]:
                ready.append(u)
    return [bool(through[a] >> b & 1) for a, b in zip(src.tolist(), dst.tolist(), strict=True)]


def each_graph(edges: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """work(src, dst) of every run's edges (run_id, src, dst), as rows of run_id and the columns it returns.

    Runs are grouped, which holds whatever the plan below becomes while it runs; rows merely dealt by run do not stay whole
    where Spark finds them so dealt by a join and turns it into one that reads its shuffle where it lies.
    """
    kind = edges.schema["run_id"].dataType.simpleString()

    def whole(table: pa.Table) -> pa.Table:
        rows = work(table["src"].to_numpy(), table["dst"].to_numpy())
        run = table["run_id"].take(pa.array([0] * len(next(iter(rows.values()))), pa.int64()))
        return pa.table([run, *(pa.array(values, pa.int64()) for values in rows.values())], ["run_id", *rows])

    return edges.select("run_id", "src", "dst").groupBy("run_id").applyInArrow(whole, f"run_id {kind}, {schema}")


def strong_of_run(src: np.ndarray, dst: np.ndarray) -> dict[str, list]:
    """(id, root) with the smallest id of each strong component."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    comp = np.array(strong(len(ids), at[: len(src)], at[len(src) :]))
    least = np.full(comp.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, comp, ids)
    return {"id": ids.tolist(), "root": least[comp].tolist()}


def weak_of_run(src: np.ndarray, dst: np.ndarray) -> dict[str, list]:
    """(id, root) with the smallest id that edges, in either direction, lead to; labels jump, so long chains take few rounds."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, label, before = at[: len(src)], at[len(src) :], np.arange(len(ids)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        label = label[label]
    return {"id": ids.tolist(), "root": ids[label].tolist()}


def needless_of_run(src: np.ndarray, dst: np.ndarray) -> dict[str, list]:
    """(a, b) of the edges that another way makes needless."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    gone = np.array(needless(len(ids), at[: len(src)], at[len(src) :]))
    return {"a": src[gone].tolist(), "b": dst[gone].tolist()}
