"""URL filters, fingerprints, quality rules, packing and sharding."""

import fnmatch
import hashlib
import pathlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints, packing, quality_rules, sharding, tokens, url_filter


def test_automaton_equals_patterns():
    globs = ["*a*b", "~.x.~/*", "a?c", "*", "~spam~/*", "*.exe", "abc" * 40]
    texts = [b"", b"ab", b"a/b", b".x.y/z", b"abc", b"my.spam.org/q", b"f/g.exe", b"abc" * 40, b"spam", b"/x.x."]
    got = url_filter.Automaton.of(globs).run(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            pattern = "".join({"*": "(?s:.*)", "~": "[^/]*", "?": "(?s:.)"}.get(c, re.escape(c)) for c in g)
            assert got[i, j] == bool(re.fullmatch(pattern, t.decode())), (t, g)
    assert fnmatch.fnmatch("f/g.exe", "*.exe")


def test_long_texts_and_many_globs():
    """A few long texts go on as large numbers, and any number of rules share the masks."""
    globs = [f"~.h{i}.org/*" for i in range(10_000)] + ["*end", "*\\*", "\\?x*", "~é~"]
    long_ = b"." + b"a" * 1_000_000 + b"end"
    texts = [b".h77.org/x", long_, b"a*", b"?x", b"zx", "é".encode(), b"x" * 3000, b".h9999.org/"]
    got = url_filter.Automaton.of(globs).run(texts)
    hits = [[globs[j] for j in np.flatnonzero(row)] for row in got]
    assert hits == [["~.h77.org/*"], ["*end"], ["*\\*"], ["\\?x*"], [], ["~é~"], [], ["~.h9999.org/*"]]


def test_rules_are_literal_and_may_have_any_character(spark):
    rules = spark.createDataFrame([("a.org/~joe/", "block"), ("жук.рф/", "block"), ("b.org/x*y?/", "block"), (None, "block")], "rule string, verdict string")
    urls = ["http://a.org/~joe/1", "http://a.org/zzjoe/", "http://m.жук.рф/p", "http://b.org/x*y?/", "http://b.org/xayb/", "http://B.ORG/x*y"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(df, url_filter.rule_table(rules), (), ()).collect()}
    assert got == {0: "a.org/~joe/", 1: None, 2: "жук.рф/", 3: None, 4: None, 5: None}  # a ? ends a path
    assert {r.verdict for r in url_filter.judge(df, (), (), ()).collect()} == {"allow"}


def test_judging_urls(spark):
    cases = [
        ("http://Sub.WWW.example.com/en/x?q", "sub.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://a.net/es/1#f", "a.net", "/es/1", "net/es/", "block"),
        ("https://a.net/esp", "a.net", "/esp", None, "allow"),
        ("https://big-casino.org/", "big-casino.org", "/", None, "block"),
        ("https://x.antispam.org/spam", "x.antispam.org", "/spam", None, "allow"),
        ("https://a.com", "a.com", "", None, "allow"),
        ("nothing", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://é.com/" + "p" * 5000, "é.com", "/" + "p" * 5000, "com/", "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert url_filter.judge(df.limit(0)).collect() == []


def _sketch(t, width=5):
    import hashlib

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    h = [hashlib.md5(" ".join(w[i : i + width]).encode()).hexdigest() for i in range(max(1, len(w) - width + 1))] if w else []
    low = [x for x in h if x < "2"] if len(w) >= width else h
    return sorted({x[:12] for x in (low or ([min(h)] if h else []))})


def test_fingerprints_of_odd_rows(odd, odd_rows, none):
    got = fingerprints.edited(odd.where("doc_id IS NOT NULL"), rows=7).withColumn("e", fingerprints.sketch("edited")).collect()
    rows = sorted(((i, t or "") for i, t, *_ in odd_rows if i is not None), key=lambda r: (-r[0], r[1]))
    assert len(got) == len(rows)
    want = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        want.setdefault(i, []).append((t, t[: len(t) - len(t) // 3] + nxt[: len(t) // 3], nxt))
    for r in got:
        # repeated rows may stand in any order; each is one of the wanted ones
        assert any(r.text == t and r.edited == e and r.sketch == _sketch(t) and r.e == _sketch(e) and r.next_sketch == _sketch(n) for t, e, n in want[r.doc_id])
    assert fingerprints.edited(none).collect() == []
    assert fingerprints.edited(odd).count() == len(odd_rows)


def test_ranges_hold_clustered_ids_evenly(spark):
    """Half of the ids lie in a billionth of their span; nulls are dealt by their texts."""
    ids = [*range(3000), *(10**15 + 7 * i for i in range(3000)), 10**18, *[None] * 500]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = fingerprints.ranged(docs, rows=20).collect()
    sizes: dict = {}
    for r in got:
        sizes[r.range] = sizes.get(r.range, 0) + 1
    assert len(got) == len(ids) and max(sizes.values()) < 80 and len(sizes) > 150
    by = sorted((r.doc_id, r.range) for r in got if r.doc_id is not None)
    assert [x for _, x in by] == sorted(x for _, x in by) and by[0][1] >= 0
    assert all(r.range < 0 for r in got if r.doc_id is None)


def test_edited_texts_of_null_ids_follow_one_chain(spark):
    docs = spark.createDataFrame([(None, f"null {k}") for k in range(40)] + [(k, f"own {k}") for k in range(40)], "doc_id long, text string")
    order = [f"own {k}" for k in range(39, -1, -1)] + sorted((f"null {k}" for k in range(40)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = {t: t[: len(t) - len(t) // 3] + order[(i + 1) % 80][: len(t) // 3] for i, t in enumerate(order)}
    assert {r.text: r.edited for r in fingerprints.edited(docs, rows=7).collect()} == want


def test_containment_between_unequal_documents(spark):
    long_ = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(long_, part)], "a string, b string").select(fingerprints.sketch("a").alias("a"), fingerprints.sketch("b").alias("b"))
    r = df.select(fingerprints.containment("b", "a").alias("c"), fingerprints.likeness("a", "b").alias("l")).first()
    assert r.c == 1.0 and abs(r.l - 0.25) < 0.06


def test_quality_rules_of_odd_rows(odd, odd_rows, none):
    got = quality_rules.judge(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {}
        for g in tri:
            seen[g] = seen.get(g, 0) + 1
        cover = {j for i, g in enumerate(tri) if seen[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(none).collect() == []


def test_order_of_rules_changes_no_verdict(odd):
    a = quality_rules.judge(odd, quality_rules.rules())
    b = quality_rules.judge(odd, quality_rules.rules()[::-1])
    key = lambda d: sorted((str(r.doc_id), r.text, r.kept) for r in d.collect())
    assert key(a) == key(b)


def test_rules_are_ordered_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(i, i % 2, i % 10) for i in range(100)], "doc_id long, a int, b int")
    cheap, dear, idle = (quality_rules.Rule(n, F.expr(c)) for n, c in (("cheap", "b = 0"), ("dear", "a = 0"), ("idle", "a > 5")))
    cost = {"cheap": 0.01, "dear": 0.1, "idle": 0.001}  # 10 and 5 rejections a unit of cost, and none
    assert [r.name for r in quality_rules.order_rules(df, [idle, dear, cheap], cost)] == ["cheap", "dear", "idle"]
    assert quality_rules.order_rules(df.limit(0), [idle, dear], cost) == [idle, dear]


def test_costs_are_those_of_evaluation(odd):
    sample = quality_rules.features(odd).cache()
    slow = quality_rules.Rule("slow", F.regexp_count("text", F.lit(r"(?:\\w*a){3}")) > 10**6)
    fast = quality_rules.Rule("fast", F.col("n_words") > 10**6)
    got = quality_rules.costs(sample, [slow, fast])
    assert got["slow"] > got["fast"]


def test_failed_rule_is_the_first_of_the_cascade(odd):
    for these in (quality_rules.rules(), quality_rules.rules()[::-1]):
        for r in quality_rules.judge(odd, these).collect():
            assert r.kept == (r.failed_rule is None) and (r.failed_rule == "base") == r.base_failed


def test_bounds_and_best_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 300):
        lengths = rng.integers(1, 101, n)
        bins = packing.best_fit(lengths, 100)
        if n:
            fill = np.bincount(bins, weights=lengths)
            assert fill.max() <= 100 and len(fill) == bins.max() + 1
            assert packing.lower_bound(lengths, 100) <= len(fill) <= 1.25 * packing.lower_bound(lengths, 100) + 1
    assert packing.lower_bound(np.array([60] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5


@pytest.mark.parametrize("part", [16384, 8])
def test_packing_round_trip(odd, odd_rows, part):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.default_vocabulary())
    got = packing.pack(odd, limit=512, part=part).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    for i, t, *_ in odd_rows[:-4]:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
        have = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i])
        assert have == (want if i else sorted(want * 3))


def test_packing_of_nothing(none):
    assert packing.pack(none).collect() == []


def test_differencing_equals_its_definition():
    places = sharding.difference([[0, 8], [0, 7], [0, 6], [0, 5], [0, 4]], 2)
    sums = [0, 0]
    for p, b in zip(places, (8, 7, 6, 5, 4), strict=True):
        sums[p[1]] += b
    assert sorted(sums) == [14, 16]  # what differencing is known to give on these numbers
    assert sharding.difference([], 3) == []


@pytest.mark.parametrize(("part", "fan"), [(4096, 512), (4, 2)])
def test_sharding_of_odd_rows(odd, odd_rows, part, fan):
    got = sharding.shard(odd, shards=4, part=part, fan=fan).collect()
    assert len(got) == len(odd_rows)
    sizes, slots, crc = [0] * 4, [[] for _ in range(4)], {}
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        crc.setdefault(r.doc_id, set()).add((r.size, r.text_crc32))
    for s in slots:
        assert sorted(s) == list(range(len(s)))
    for i, t, *_ in odd_rows[:-4]:
        raw = (t or "").encode()
        assert crc[i] == {(len(raw) + 8, zlib.crc32(raw))}
    same = [r.shard for r in got if r.doc_id in (40, 41)]
    assert same[0] == same[1]
    biggest = max(len((t or "").encode()) + 8 for _, t, *_ in odd_rows)
    # tiny parts leave differencing less to choose from
    assert max(sizes) <= 1.1 * max(biggest, sum(sizes) / 4)


def test_sharding_of_nothing_and_of_one_huge_group(spark, none):
    assert sharding.shard(none).collect() == []
    docs = spark.createDataFrame([(i, "same text") for i in range(1000)], "doc_id long, text string")
    n = {r.shard: r.n for r in sharding.shard(docs, shards=4).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {k: 250 for k in range(4)}


def test_sharding_writes_few_files(spark, tmp_path):
    """With many partitions: a file for each of the rows and of the groups, and a few; each cost a process in a check that counted executors with their children."""
    sc, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, folder = {k: spark.conf.get(k) for k in conf}, sc._jsc.sc().getCheckpointDir()
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        sc.setCheckpointDir(str(tmp_path))
        docs = spark.range(0, 1200, 1, 10).selectExpr("id doc_id", "case when id % 2 = 0 then 'many' when id % 3 = 0 then 'some' else concat('text ', id) end text")
        got = sharding.shard(docs, shards=8, part=64, fan=2)
        rows = got.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        if folder.isDefined():
            sc.setCheckpointDir(str(pathlib.Path(folder.get().removeprefix("file:")).parent))
    files = list(tmp_path.rglob("part-*"))
    assert len(files) <= 10 + 40 + 20, len(files)
    assert len(rows) == 1200
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    many, some = (Counter(r.shard for r in rows if r.text_crc32 == zlib.crc32(t)) for t in (b"many", b"some"))
    assert sum(many.values()) == 600 and all(n % 150 == 0 for n in many.values()), many  # 7200 bytes in runs below a fair 1970
    assert sum(some.values()) == 200 and all(n % 100 == 0 for n in some.values()), some


@pytest.mark.parametrize(("part", "fan"), [(4096, 512), (64, 512), (64, 2)])
@pytest.mark.parametrize("copies", [[], [110], [180, 170, 10], [350, 30, 30]])
def test_shards_are_even_with_large_groups_in_many_parts(spark, part, fan, copies):
    """A group near a fair share is more than its part can even out: the other parts must leave its shard room."""
    rng = np.random.default_rng(5)
    texts = ["x" * int(m) + f" {i}" for i, m in enumerate(rng.integers(0, 60, 1000))] + [f"group {g} " + "y" * 40 for g, m in enumerate(copies) for _ in range(m)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(docs, shards=6, part=part, fan=fan).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes, slots = [0] * 6, [[] for _ in range(6)]
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 6, sizes


@pytest.mark.parametrize(("n", "runs"), [(1, 1), (1, 5), (7, 3), (10, 4), (12, 4), (2690, 2), (5, 24), (1001, 24)])
def test_runs_are_what_the_cut_makes(spark, n, runs):
    want = Counter(k * runs // n for k in range(n))
    assert sharding._runs(9, n, runs) == [(r, 9 * m, m) for r, m in sorted(want.items())]
    rows = spark.range(n).selectExpr("'a' key", "id rid").unionByName(spark.range(n, n + 3).selectExpr("'b' key", "id rid"))
    got = sharding._cut(rows, spark.createDataFrame([("a", runs)], "key string, runs long"), n).groupBy("key", "run").count().collect()
    assert {(r.key, r.run): r["count"] for r in got} == {("b", 0): 3} | {("a", r): m for r, m in want.items()}


def brute_difference(sizes, k):
    """Differencing by its definition, on plain lists of (sum, members)."""
    parts = [[([0, []]) for _ in range(k - 1)] + [[b, [i]]] for i, b in enumerate(sizes)]
    parts = [sorted(p, key=lambda e: -e[0]) for p in parts]
    while len(parts) > 1:
        parts.sort(key=lambda p: -(p[0][0] - p[-1][0]))
        a, b = parts[0], parts[1]
        parts = [sorted([[x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b), strict=True)], key=lambda e: -e[0]), *parts[2:]]
    return sorted(e[0] for e in parts[0]) if parts else []


@pytest.mark.parametrize(("k", "seed"), [(2, 1), (3, 2), (5, 3), (24, 4)])
def test_differencing_equals_brute_force(k, seed):
    """Sizes without ties, so that the order of combining is fixed."""
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in np.cumsum(rng.integers(1, 997, 60)) ** 2 + rng.integers(0, 7, 60)]
    places = sharding.difference([[0] * (k - 1) + [b] for b in sizes], k)
    sums = [0] * k
    for p, b in zip(places, sizes, strict=True):
        sums[p[k - 1]] += b
    assert sorted(sums) == brute_difference(sizes, k)


@pytest.mark.parametrize("n", [3, 9, 40])
def test_exchange_never_needs_more_than_packing_apart(spark, n):
    """Parts that exchange bins: no more bins than each part packed by itself, and no fewer than the bound of all pieces."""
    rng = np.random.default_rng(n)
    docs = spark.createDataFrame([(i, " ".join("abcdefgh"[int(j) % 8] for j in range(int(m)))) for i, m in enumerate(rng.integers(20, 500, 12 * n))], "doc_id long, text string")
    rows = packing.pack(docs, limit=512, part=12).collect()
    lengths = np.array([r.length for r in rows])
    bins = len({r.sequence_id for r in rows})
    assert packing.lower_bound(lengths, 512) <= bins
    by: dict = {}
    for r in rows:
        by.setdefault(r.part, []).append(r)
    for part in by.values():
        own = np.array([r.length for r in part])
        used = len({r.sequence_id for r in part})
        assert used - packing.lower_bound(own, 512) <= part[0].gap or part[0].gap == 0
        assert used <= packing.best_fit(own, 512).max() + 1
