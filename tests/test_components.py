import random

from vinculum.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def run(spark, edges):
    return {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}


def test_random_graph(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(90)] + [("hub", f"s{i}") for i in range(60)] + [("x", "x"), (None, "y"), ("n001", None)]
    edges += edges[:10]
    assert run(spark, edges) == brute(edges)


def test_path_and_empty(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)]
    assert run(spark, edges) == brute(edges)
    assert run(spark, []) == {}
