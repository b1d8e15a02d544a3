import random
import re

import pytest

from lectern.llm import near_dedup as nd
from lectern.llm.common import Scratch
from lectern.llm.components import components


def sets_of(texts, width):
    out = []
    for t in texts:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(width, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    return out


def brute(rows, width):
    ids = [i for i, _ in rows]
    sets = sets_of([t for _, t in rows], width)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets, strict=True)}


def near_copies(n, edits, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice(edits)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "edits", "width"), [(40, [1, 2, 9], 2), (120, [3, 6, 8, 9, 10], 2)])
def test_components_equal_brute_force(spark, n, edits, width):
    """The second case has too many pairs of different components for all of them to be checked, so bounds narrow them."""
    rows = near_copies(n, edits, n)
    want, sizes = brute(rows, width)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(odd, odd_rows):
    got = nd.near_duplicates(odd, width=2).collect()
    assert len(got) == len(odd_rows)
    ids = [(i, t) for i, t, *_ in odd_rows[:-4]]
    want, sizes = brute(ids, 2)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], sizes[r.doc_id])
    stay = nd.deduplicated(odd)
    assert stay.columns == odd.columns
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == sorted({i for i in brute(ids, 5)[0].values()})


def test_empty_table(none):
    assert nd.near_duplicates(none).collect() == [] and nd.deduplicated(none).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    steps = nd.least_matches(0.8, nd.MISS)
    assert steps[-1][0] == nd.HASHES and all(need < 0.8 * n for n, need in steps)


@pytest.mark.parametrize("small", [1000, 0])
def test_components_of_a_path_and_a_star(spark, small):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(5, 5)]
    with Scratch(spark) as s:
        got = {r.node: r.component for r in components(s, spark.createDataFrame(edges, "a long, b long"), small).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)}


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    """Copies of one text go, another text of the same id stays, and links run by texts."""
    rnd = random.Random(8)
    text = {k: " ".join(f"{k}{rnd.randrange(900)}" for _ in range(90)) for k in "abc"}
    near = text["c"] + " more"
    rows = [(1, text["a"]), (1, text["a"]), (1, text["b"]), (2, text["b"]), (3, text["c"]), (4, near), (4, text["a"]), (5, ""), (5, ""), (None, text["a"]), (None, text["a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in nd.deduplicated(docs).collect()), key=str)
    assert got == sorted([(1, text["a"]), (1, text["b"]), (3, text["c"]), (5, ""), (None, text["a"]), (None, text["a"])], key=str)
    comp = sorted(((r.doc_id, r.component_id) for r in nd.near_duplicates(docs).collect() if r.doc_id is not None))
    assert comp == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 1), (4, 3), (5, 5), (5, 5)]


def test_clashing_names_are_carried(spark):
    names = ["doc_id", "text", "rid", "a", "b", "node", "n_shingles", "p", "q", "component_id", "__nd_id"]
    rows = [(i, f"some words of row {i // 2} here", *(f"{c}{i}" for c in names[2:])) for i in (0, 1, 2, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:]))
    out = nd.deduplicated(docs)
    assert out.columns == names and sorted(map(tuple, out.collect())) == sorted([rows[0], rows[2]])


def test_recall_of_the_pipelines_stage(spark):
    """Width 5: near copies at every distance around the threshold; every linked pair by brute force is found."""
    rows = near_copies(150, [0, 1, 2, 3, 4, 5, 6], 21) + [(1000 + i, t) for i, t in near_copies(60, [2, 3], 5)]
    want, _ = brute(rows, 5)
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
