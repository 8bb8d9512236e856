import random

from slotcast.llm.components import components


def test_components_equal_a_plain_search(spark):
    source = random.Random(3)
    edges = [(source.randrange(200), source.randrange(200)) for _ in range(120)]
    edges += [(300 + i, 301 + i) for i in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (301, 300)]
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
