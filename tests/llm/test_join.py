import random

import pytest
from tests.llm.cases import ROWS, documents, empty, prose

from sieveline.llm import ngram_join
from sieveline.llm.components import connected_components, merged_components


def shingles(text):
    words = text.encode().lower().split() if text else []
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def naive(rows, percent=90):
    sets = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def check(spark, rows, percent=90):
    found = ngram_join.jaccard_components(documents(spark, rows), percent).collect()
    assert len(found) == len(rows)
    expected = naive(rows, percent)
    for r in found:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
    sizes = {(d, len(shingles(t))) for d, t, *_ in rows}
    assert {(r.doc_id, r.n_shingles) for r in found} == sizes
    return found


def test_odd_rows(spark):
    check(spark, ROWS)
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


@pytest.mark.parametrize("edits", [1, 3, 6])
def test_families_of_copies(spark, edits):
    """Copies whose similarity is about the bound, some chained, some not: what is left after the centres' products counts too."""
    draw = random.Random(edits)
    rows = []
    for family in range(6):
        base = prose(100 + family, draw.choice([30, 60, 120, 200])).split()
        for _ in range(25):
            words = list(base)
            for _ in range(draw.randint(0, edits)):
                words[draw.randrange(len(words))] = f"new{draw.randint(0, 999)}"
            rows.append((len(rows) + 1, " ".join(words), "en", "a"))
            if draw.random() < 0.3:
                base = words
    rows += [(len(rows) + 1 + i, prose(900 + i, 50), "en", "b") for i in range(20)]
    draw.shuffle(rows)
    check(spark, rows)


def test_size_classes_let_no_pair_slip():
    sizes = ngram_join.Sizes(90)
    for n in range(1, 3000):
        largest = n * 100 // 90
        assert sizes.of(largest) - sizes.of(n) in (0, 1)
        k, spare = sizes.ranges(sizes.of(n))
        assert k - 1 - spare >= 2 * n // 19


def test_one_of_each_stays(spark):
    kept = sorted(r.doc_id or -1 for r in ngram_join.one_of_each(documents(spark)).collect())
    expected = naive(ROWS)
    assert kept == sorted([-1, *{d for d in expected if expected[d] == d}])


def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


def edge_table(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def as_dict(components):
    rows = components.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(30)]
    assert as_dict(connected_components(edge_table(spark, edges), "a", "b")) == roots(edges)


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(2, 1), (1, 2), (2, 1)], [(1, 9), (2, 9)], [(9, 1), (9, 2), (9, 3), (4, 2)]], ids=["none", "loop", "repeats", "two parents", "many parents"])
def test_components_of_few_edges(spark, edges):
    assert as_dict(connected_components(edge_table(spark, edges), "a", "b")) == roots(edges)


def test_components_that_more_edges_join(spark):
    draw = random.Random(5)
    first = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(30)] + [(200, 210 + i) for i in range(5)]
    more = [(draw.randint(0, 120), draw.randint(0, 120)) for _ in range(25)] + [(213, 199), (300, 301), (301, 302), (214, 215)]
    known = connected_components(edge_table(spark, first), "a", "b")
    assert as_dict(merged_components(known, edge_table(spark, more), "a", "b")) == roots(first + more)
