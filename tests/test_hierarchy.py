import random

import pytest

from vinculum.operators import hierarchy as H


def brute(parents):
    out = {}
    for k in parents:
        trail, x = [k], k
        while True:
            p = parents[x]
            if p is None or p not in parents:
                state, root, depth, path = ("tree" if p is None else "dangling"), x, len(trail) - 1, trail[::-1]
                break
            if p in trail:
                i = trail.index(p)
                state, root, depth, path = ("cycle" if i == 0 else "below_cycle"), min(trail[i:]), i, trail[: i + 1][::-1]
                break
            trail.append(p)
            x = p
        out[k] = (state, root, depth, "/".join(path))
    return out


def run(spark, parents, **kw):
    df = spark.createDataFrame(list(parents.items()), "id string, parent string")
    return {r["id"]: (r["state"], r["root_id"], r["depth"], r["path"]) for r in H.hierarchy(df, **kw).collect()}


@pytest.mark.parametrize("task_rows", [1000, 12])
def test_random_links(spark, task_rows):
    rng = random.Random(5)
    ids = [f"n{i:03d}" for i in range(120)]
    parents = {k: rng.choice([None, "lost", *[rng.choice(ids) for _ in range(18)]]) for k in ids}
    parents["n000"] = "n000"
    assert run(spark, parents, task_rows=task_rows) == brute(parents)


def test_long_loop_over_many_tasks(spark):
    parents = {f"n{i:02d}": f"n{(i + 1) % 40:02d}" for i in range(40)} | {"a": "n07", "b": "a"}
    assert run(spark, parents, task_rows=4) == brute(parents)


def test_long_chain_and_empty(spark):
    parents = {f"n{i:03d}": (f"n{i - 1:03d}" if i else None) for i in range(90)}
    assert run(spark, parents, task_rows=16) == brute(parents)
    assert run(spark, {}) == {}


def test_states_blanks_and_clashing_columns(spark):
    rows = [(" A ", "b", 1, 1, "x"), ("a", None, 2, 1, "x"), ("a", None, 2, 1, "x"), ("B", " A", 1, 1, None), ("c", "  ", 1, None, ""), (None, "a", 1, 1, "")]
    df = spark.createDataFrame(rows, "node string, up string, u int, c int, id string")
    links = H.current_links(df, "node", "up", "u", "c")
    assert {r["id"]: r["parent"] for r in links.collect()} == {"a": None, "b": "a", "c": None}


def above(parents):
    out = set()
    for k in parents:
        x, seen = parents[k], {k}
        n = 1
        while x is not None and x in parents and x not in seen:
            out.add((x, k, n))
            seen.add(x)
            x, n = parents[x], n + 1
    return out


@pytest.mark.parametrize("task_rows", [1000, 20])
def test_descendants_of_trees_and_loops(spark, task_rows):
    rng = random.Random(6)
    ids = [f"n/{i:02d}" for i in range(40)]
    parents = {k: rng.choice([None, "lost", *[rng.choice(ids) for _ in range(16)]]) for k in ids} | {f"r{i:02d}": f"r{(i + 1) % 25:02d}" for i in range(25)} | {"x": "r03", "y": "x", "s": "s"}
    df = spark.createDataFrame(list(parents.items()), "id string, parent string")
    assert {tuple(r) for r in H.descendants(df, task_rows).collect()} == above(parents)
    assert H.tree_report(H.hierarchy(df)).count() > 1
