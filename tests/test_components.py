import random

from sleuthframe.operators.components import connected_components


def labels(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_random_path_and_star(spark):
    rng = random.Random(5)
    name = lambda i: f"n{i:04d}"
    pairs = [(name(i), name(i + 1)) for i in range(40)]
    pairs += [(name(500), name(i)) for i in range(501, 540)]
    pairs += [(name(rng.randrange(1000, 1100)), name(rng.randrange(1000, 1100))) for _ in range(60)]
    pairs = [p for p in pairs if p[0] != p[1]]
    rng.shuffle(pairs)
    got = connected_components(spark.createDataFrame(pairs, "src string, dst string"))
    assert {r["node"]: r["component"] for r in got.collect()} == labels(pairs)
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
