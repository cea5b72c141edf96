"""Components of graphs that no task holds."""

import random

from chalkline.operators import graph


def test_labels_are_the_smallest_reachable(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(80)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 20) for i in range(20)] + [(draw.randrange(300, 420), draw.randrange(300, 420)) for _ in range(70)]
    nodes = sorted({x for p in links for x in p} | {999})
    root = {v: v for v in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    draw.shuffle(links)
    got = {r.v: r.root for r in graph.component_labels(spark.createDataFrame([(v,) for v in nodes], "v long"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root


def test_counts_of_known_graphs(spark):
    nodes = spark.createDataFrame([(v,) for v in range(7)], "v long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2), (3, 4), (4, 4)], "a long, b long")
    assert tuple(graph.euler_of(nodes, edges).first()) == (7, 4, 4, 1, 3, 2)
    assert graph.component_labels(nodes.limit(0), edges.limit(0)).count() == 0
