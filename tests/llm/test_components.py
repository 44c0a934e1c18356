import random

import pytest

import gristmill.llm.components as components_module
from gristmill.llm.components import components


@pytest.mark.parametrize("one_task", [0, 1000])
def test_both_ways(spark, one_task):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 130)] + [(200 + k, 201 + k) for k in range(12)] + [(5, 5)]
    least = {x: x for e in links for x in e}
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    alone = {x for x in least if all(x not in e or e[0] == e[1] for e in links)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
    assert got == {x: r for x, r in least.items() if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_steps_end_once_few_links_are_left(spark, monkeypatch):
    """The steps over all tasks end in one task as soon as their links are few enough."""
    steps, write = [], components_module.saved
    monkeypatch.setattr(components_module, "saved", lambda df, name: steps.append(name) or write(df, name))
    links = [(i, j) for k in range(0, 200, 10) for i in range(k, k + 10) for j in range(k, i)] + [(k, k + 1) for k in range(300, 340)]
    for one_task in (0, 300):
        steps.append(None)
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
        assert got == {i: i // 10 * 10 for i in range(200)} | {i: 300 for i in range(300, 341)}
    second = steps.index(None, 1)
    assert len(steps) - second < second
