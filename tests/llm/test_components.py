import random

import pytest

from quirespark.llm import components


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components_of_small_and_large_tables(spark, monkeypatch, few):
    """The same groups whether the rounds are planned once or adaptively; the setting is left as it was."""
    random.seed(21)
    monkeypatch.setattr(components, "FEW", few)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(1_000 + i, 1_001 + i) for i in range(60)]
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for u, v in links:
        label[find(u)] = find(v)
    before = spark.conf.get(components.ADAPTIVE, None)
    found = dict(components.connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert spark.conf.get(components.ADAPTIVE, None) == before
    ends = {i for u, v in links if u != v for i in (u, v)}
    assert set(found) == ends
    assert len({(find(i), found[i]) for i in ends}) == len({find(i) for i in ends}) == len(set(found.values()))
