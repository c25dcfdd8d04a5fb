import pytest

from pulseloom.llm.components import connected_components


@pytest.mark.parametrize("edges, want", [
    ([], []),
    ([(1, 1), (None, 2)], []),
    ([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (101, 102)], [set(range(41)), {100, 101, 102}]),
    ([(0, i) for i in range(1, 50)], [set(range(50))]),
])
def test_components(spark, edges, want):
    found: dict = {}
    for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        found.setdefault(r["root"], set()).add(r["id"])
    assert sorted(found.values(), key=min) == want
