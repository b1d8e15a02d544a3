import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


def _words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def _permuted(quota, shards, seed):
    """Brute force of the tree: quota[rank] = (epochs, last block, bits); counts[shard][rank]."""
    blocks = []
    for rank, (epochs, at, bits) in enumerate(quota):
        for block in range(1 << bits):
            for epoch in range(epochs + (block <= at)):
                h = int(hashlib.md5(f"{seed}-tree:{rank}:{epoch}:{block}".encode()).hexdigest()[:15], 16)
                blocks.append((h, rank, epoch, block))
    blocks.sort()
    counts = np.zeros((shards, len(quota)), dtype=int)

    def node(rows, first, k):
        if k == 1:
            for r in rows:
                counts[first, r[1]] += 1
            return
        share = len(rows) * (k // 2) // k
        node(rows[:share], first, k // 2)
        node(rows[share:], first + k // 2, k - k // 2)

    node(blocks, 0, shards)
    return counts


@pytest.mark.parametrize(("shards", "n"), [(16, 900), (5, 900), (16, 3)])
def test_tree_equals_brute_force(spark, shards, n):
    """The same blocks in the same shards; shards differ by a block at most; nothing is lost."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), "abc"[i % 7 % 3]) for i in range(n)], "doc_id long, text string, source string")
    par, _ = mixing.plan(mixing._slim(docs, "mix"), block_words=100)
    t = {r["rank"]: r for r in par.collect()}
    quota = [(t[k]["epochs"], t[k]["at"] if t[k]["need"] > 0 and t[k]["at"] is not None else -1, t[k]["bits"]) for k in range(len(t))]
    want = _permuted(quota, shards, "mix")
    got = np.zeros_like(want)
    for r in mixing.allotment(docs, shards=shards, block_words=100).collect():
        got[r.shard, next(k for k in t if t[k]["source"] == r.source)] += r.blocks
    assert (got == want).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    # every copy of every document lies in the shard that the tree gave its block
    rows = mixing.mix(docs, shards=shards, block_words=100).collect()
    assert all(len(r.shards) == r.copies and all(0 <= s < shards for s in r.shards) for r in rows)


def test_counts_follow_the_hypergeometric_law():
    """Over many keys, a half's count of a source has the mean and spread of draws without replacement."""
    quota = [(1, -1, 5), (2, -1, 4), (0, 20, 6)]  # 32, 32 and 21 blocks
    first = np.array([_permuted(quota, 2, f"k{i}")[0] for i in range(1500)])
    total, half = 85, 42
    for k, q in enumerate((32, 32, 21)):
        mean = half * q / total
        var = half * (q / total) * (1 - q / total) * (total - half) / (total - 1)
        assert abs(first[:, k].mean() - mean) < 4 * (var / 1500) ** 0.5
        assert 0.85 < first[:, k].var() / var < 1.15


def test_mix_of_odd_rows(odd, odd_rows):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows)
    assert sorted(r["size"] for r in got) == sorted(_words(x[1]) for x in odd_rows)
    total = sum(r["size"] for r in got)
    by: dict = {}
    for r in got:
        assert r.taken == r.copies * r["size"] and r.copies <= 3 and len(r.shards) == r.copies
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert abs(sum(v[0] for v in by.values()) - total) < 1e-6 * total or all(v[0] == 3 * v[1] for v in by.values() if v[1])
    for target, size, taken in by.values():
        largest = max(r["size"] for r in got)
        assert taken <= target + 1e-6 and target <= 3 * size and target - taken <= largest
    assert sorted(mixing.mix(odd).select("doc_id", "taken").collect(), key=str) == sorted(((r.doc_id, r.taken) for r in got), key=str)


def test_weights_are_reached_exactly_when_no_target_is_cut(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(3, 1), block_words=64).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    assert {r.source: r.t for r in got} == {"a": 3000, "b": 1000}


def test_mixed_documents_repeat_as_often_as_taken(odd):
    taken = {}
    for r in mixing.mix(odd).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = {}
    for r in mixing.mixed_documents(odd).collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + _words(r.text)
    assert out == {k: v for k, v in taken.items() if v}


def test_empty_table(none):
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def test_mixed_documents_of_null_and_repeated_ids(spark):
    """Rows that share a null or repeated doc_id, with texts of several lengths, come as often as the mix takes each."""
    rows = [(None, "n " * k, "a") for k in range(1, 7)] + [(5, "r " * k, "b") for k in (2, 3, 4, 4)] + [(None, "", "a")]
    rows += [(i, "w " * 10, "ab"[i % 2]) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = {}, {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r["size"]] = want.get((r.doc_id, r.source, r["size"]), 0) + r.copies
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id, r.source, _words(r.text)] = got.get((r.doc_id, r.source, _words(r.text)), 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert any(k[0] is None for k in got) and any(k[0] == 5 for k in got)


def test_clashing_names_are_carried(spark):
    names = ["doc_id", "text", "source", "h", "size", "copies", "shard", "row", "rank", "bits", "at"]
    docs = spark.createDataFrame([(i, "w " * 5, "a", *(f"{c}{i}" for c in names[3:])) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names[3:]))
    out = mixing.mixed_documents(docs).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, docs.collect()))
