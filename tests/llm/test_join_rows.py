"""Rows that the block join of near copies makes, beside the results of plain loops."""

from __future__ import annotations

import random
import re

from tidemill.llm import jaccard_join


def executions(spark) -> set[int]:
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId() for i in range(found.size())}


def rows_of_block_joins(spark, since: set[int]) -> int:
    """Output rows of all joins by blocks that ran after ``since``."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    for run in executions(spark) - since:
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" not in node.name() or not re.search(r"xg#.*xq#.*xs#.*yg#.*yq#.*ys#.*Inner", node.desc()):
                continue
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                    total += int(values.get(metric.accumulatorId()).get().replace(",", ""))
    return total


def near_copies(rng: random.Random, n: int, words: int, changes: tuple[int, int]) -> list[str]:
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(*changes)):
            copy[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def components_of(data: list[tuple[int, str]], k: int, percent: int) -> list[tuple[int, int, int]]:
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in ((i, t.split()) for i, t in data)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a + 1, len(sets)):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def test_a_pair_of_near_copies_makes_few_rows(spark):
    """Near copies below the threshold share most lists of their prefixes; each pair comes out of few of them."""
    rng = random.Random(21)
    texts = near_copies(rng, 70, 400, (7, 11)) + near_copies(rng, 30, 150, (1, 6))
    rng.shuffle(texts)
    data = list(enumerate(texts))
    before = executions(spark)
    got = sorted(map(tuple, jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string"), 5, 80).collect()))
    assert got == components_of(data, 5, 80)
    made, pairs = rows_of_block_joins(spark, before), 70 * 69 // 2 + 30 * 29 // 2
    assert 0 < made <= 1.2 * pairs


def test_lists_with_one_list_before_them_keep_all_links(spark, monkeypatch):
    """Texts of few words in many orders, so that lists stand before each other in some sets and not in others."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "EARLIER", 1, raising=False)
    rng = random.Random(22)
    for k, percent in ((1, 50), (2, 60)):
        texts = [" ".join(f"w{rng.randrange(14)}" for _ in range(rng.randrange(3, 25))) for _ in range(90)]
        data = list(enumerate(texts))
        got = sorted(map(tuple, jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string"), k, percent).collect()))
        assert got == components_of(data, k, percent)
