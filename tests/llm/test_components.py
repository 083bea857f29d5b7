"""Rounds of components over few edges."""

from __future__ import annotations

import random

import pytest

from hearthline.llm import components as C


def edges(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [*{(rng.randrange(400), rng.randrange(400)) for _ in range(300)}, *((k, k + 1) for k in range(500, 560)), (None, 3), (5, None)]


def by_hand(pairs: list[tuple]) -> list[tuple]:
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted((x, find(x)) for x in list(root))


@pytest.mark.parametrize("part_edges", [100_000, 100])
def test_components_of_one_and_of_many_partitions(spark, monkeypatch, part_edges):
    monkeypatch.setattr(C, "PART_EDGES", part_edges)
    frame = spark.createDataFrame(edges(3), "a bigint, b bigint").repartition(3)
    assert sorted(map(tuple, C.components(frame, "a", "b").collect())) == by_hand(edges(3))


def test_a_round_over_few_edges_has_no_shuffle(spark, monkeypatch, capsys):
    """Each shuffle costs the driver a thread, and the pipeline's join had over a hundred for its rounds."""
    kept = []
    monkeypatch.setattr(C, "cut_lineage", lambda df: kept.append(df) or df.localCheckpoint())
    C.components(spark.createDataFrame(edges(4), "a bigint, b bigint").repartition(3), "a", "b")
    assert len(kept) > 2
    for later in kept[1:]:
        later.explain()
        assert "Exchange" not in capsys.readouterr().out
