import random

import pytest

from sievework.operators.components import connected_components


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(1)
    ids = list(range(400))
    r.shuffle(ids)
    links = {"path": list(zip(ids, ids[1:], strict=False)), "star": [(7, i) for i in ids], "random": [(r.randrange(400), r.randrange(400)) for _ in range(250)], "none": []}[shape]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {i: find(i) for pair in links for i in pair if pair[0] != pair[1]}
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "a int, b int")
    got = connected_components(df).collect()
    assert {x["node"]: x["root"] for x in got} == want
    assert len(got) == len(want)
