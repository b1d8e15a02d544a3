import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, quality_classifier, toxicity
from lectern.llm.samples import held_out, per_class


def _sets(spark, n=240):
    rng = np.random.default_rng(0)
    clean, bad = [f"word{i}" for i in range(60)], ["vile", "scum", "rotten"]
    rows, labels = [], []
    for i in range(n):
        w = [clean[k] for k in rng.integers(0, 60, 40)]
        toxic = i % 4 == 0
        if toxic:
            for k in rng.integers(0, 40, 4):
                w[k] = bad[int(rng.integers(0, 3))]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_is_learned_and_spans_are_offsets(spark):
    docs, labels = _sets(spark)
    chain = toxicity.train(docs, labels.where(~held_out(5, 0)))
    got = toxicity.score(docs, chain, spans=True).join(docs, "doc_id").join(labels, "doc_id").where(held_out(5, 0)).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.95
    for r in got:
        for s in r.spans:
            assert r.text[s.start : s.stop] == s.text
    caught = [s.text for r in got if r.toxic for s in r.spans]
    assert caught and set(caught) <= {"vile", "scum", "rotten", *(f"{a} {b}" for a in ("vile", "scum", "rotten") for b in ("vile", "scum", "rotten"))}
    assert toxicity.clean(docs, chain).count() == toxicity.score(docs, chain).where("predicted = 0").count()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    e, steps = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {}
    for path in np.ndindex(*(2,) * 5):
        weight[path] = np.exp(sum(e[t] * path[t] for t in range(5)) + sum(steps[path[t], path[t + 1]] for t in range(4)))
    z = sum(weight.values())
    want = [sum(w for p, w in weight.items() if p[t]) / z for t in range(5)]
    got = toxicity.marginals(np.concatenate([e, e[:0]]), np.array([5]), steps)
    assert np.allclose(got, want)


@pytest.mark.parametrize("labelled", [True, False])
def test_toxicity_of_odd_rows(spark, odd, odd_rows, none, labelled):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] if labelled else [(1, 1)], "doc_id long, toxic int")
    chain = toxicity.train(odd, labels)
    got = toxicity.score(odd, chain, spans=True).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(none, chain).collect() == [] and toxicity.train(none, labels) is None
    assert toxicity.clean(odd, chain).columns == odd.columns


def test_language_is_learned(spark):
    rng = np.random.default_rng(0)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "жзику"}
    rows = []
    for i in range(300):
        lang = list(alphabets)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(list(alphabets[lang]), 5)) for _ in range(12)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where(~held_out(4, 2)))
    got = langid.identify(docs, model).join(docs, "doc_id").where(held_out(4, 2)).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.98
    assert langid.recognised(docs, model, ("aa", "bb")).where("lang = 'cc'").count() == 0


def test_language_of_odd_rows(odd, odd_rows, none):
    model = langid.train(odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.lang_pred)
    for i, t, *_ in odd_rows:
        if i is not None:
            assert ("und" in by[i]) == (not t or not any(c.isalpha() for c in t))
    assert langid.identify(none, model).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}
    assert langid.recognised(odd, model).columns == odd.columns


def _grams(text):
    """The n-grams of a text that its presence vector stands for: letters lower-cased, all else blank, three blanks behind."""
    t = "".join(c if c.isalpha() else " " for c in text.lower()) + "   "
    return {t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)}


def test_presence_equals_sets_of_grams():
    """Texts have a place in common just where they have a gram in common; pieces of a long text lose none."""
    texts = ["Abc abd", "xyz, xya", "", "É, ça 12", "жук", "ab" * 50 + "Q"]
    x, has = langid._presence(texts)
    assert has.tolist() == [True, True, False, True, True, True]
    every = sorted(set().union(*map(_grams, texts)))
    one = {g: langid._presence([g], "")[0][0] for g in every}
    place = {g: int(np.flatnonzero(v)[np.flatnonzero(v) >= sum(langid.PLACES[: len(g) - 1])][0]) for g, v in one.items()}
    for row, t in zip(x, texts, strict=True):
        assert set(np.flatnonzero(row)) == {place[g] for g in _grams(t)}


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdeé ,"), n)) for n in (10, 700, 64, 65, 200)]
    want = [langid._presence([t]) for t in texts]
    monkeypatch.setattr(langid, "GROUP_CHARS", 64)
    got = list(langid.presence(texts))
    assert [lo for lo, *_ in got] == sorted(lo for lo, *_ in got) and got[-1][1] == len(texts)
    rows = np.concatenate([x for _, _, x, _ in got])
    assert (rows == np.concatenate([x for x, _ in want])).all()


def test_nystrom_ridge_equals_the_kernel_form():
    """With every text a landmark, the folded matrix scores as weighted kernel ridge regression on the same kernel does."""
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list(("abcde ", "fghij ")[i % 2] + "xyz"), 40)) for i in range(24)]
    labels = ["aa" if i % 2 else "bb" for i in range(24)]
    bits = [np.packbits(row).tobytes() for row in langid._presence(texts)[0]]
    model = langid.fit(bits, labels, landmarks=24, ridge=1.0)
    x = langid._presence(texts)[0].astype(float)
    x /= np.sqrt(x.sum(axis=1))[:, None]
    kernel = x @ x.T
    y = np.where(np.array(labels)[:, None] == np.array(model.languages)[None], 1.0, -1.0)
    lam = 1.0 * 24 / 100
    # Equal classes, so weights are 1: minimise |K a + b - y|^2 + lam a' K a + lam b^2.
    a_b = np.linalg.solve(np.block([[kernel @ kernel + lam * kernel + 1e-9 * np.eye(24), kernel @ np.ones((24, 1))], [np.ones((1, 24)) @ kernel, np.array([[24 + lam]])]]), np.vstack([kernel @ y, y.sum(axis=0)]))
    want = kernel @ a_b[:-1] + a_b[-1]
    assert np.allclose(x @ model.weights + model.bias, want, atol=1e-3)


SF = "/root/testdata/sf0.01"


def test_held_out_languages_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.query(spark, SF).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").collect()
    assert len(got) > 150 and np.mean([r.lang_pred == r.lang for r in got]) >= 0.98


def test_held_out_toxicity_of_the_tables(spark):
    """Labels have some noise: a few toxic ones mark texts without any toxic word."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    clean = [r for r in got if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) >= 0.9 and np.mean([r.predicted for r in clean]) <= 0.02
    assert np.mean([r.spans != "" for r in toxic]) >= 0.9


def test_held_out_quality_of_the_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.query(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == k] for k in (1, 0))
    assert len(good) > 10 and len(bad) > 10
    assert np.mean([[1 if g > b else 0.5 if g == b else 0 for b in bad] for g in good]) >= 0.97


def test_resampling_keeps_the_largest_keys(spark):
    rows = [(i, 1, float(i % 50), 0.5) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, log_weight double, score double")
    got = quality_classifier.resample(df, 0.3).collect()
    keys = {r.doc_id: r.key for r in df.withColumn("key", F.col("log_weight") + quality_classifier.gumbel()).collect()}
    want = set(sorted(keys, key=lambda i: -keys[i])[:150])
    assert {r.doc_id for r in got if r.kept} == want


def test_kth_largest_with_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 5, 5, 5, 2, 9, -3]], "key double")
    assert [quality_classifier.kth_largest(df, k) for k in (0, 1, 2, 4, 5, 7, 9)] == [None, 9.0, 5.0, 5.0, 2.0, -3.0, -3.0]


def test_quality_counts_and_weights_equal_brute_force(spark):
    import re

    texts = ["Aa bb!! cc", "aa bb", "", None, "cc cc $$ é1"]
    docs = spark.createDataFrame([(i, t, i < 2) for i, t in enumerate(texts)], "doc_id long, text string, target boolean")
    raw, target = quality_classifier.counts(docs)

    def n(t):
        toks = re.findall(r"[^\W_]+|[^\w\s]+|_+", t or "")
        return max(0, 2 * len(toks) - 1)

    assert raw.sum() == sum(map(n, texts)) and target.sum() == sum(map(n, texts[:2]))
    ratio = quality_classifier.log_ratio(raw, target)
    share = target.sum() / raw.sum()
    for place in np.flatnonzero(raw):
        assert np.isclose(ratio[place], np.log((target[place] + quality_classifier.SMOOTH) / (raw[place] * share + quality_classifier.SMOOTH)))
    assert not ratio[raw == 0].any()
    want = {}
    for i, t in enumerate(texts):
        places = [p for _, _, ps, _ in quality_classifier.features([(t or "").encode()]) for p in ps.tolist()]
        want[i] = sum(ratio[p] for p in places)
    rows = quality_classifier.weigh(docs, ratio).collect()
    assert all(np.isclose(r.log_weight, want[r.doc_id]) and np.isclose(r.score, 1 / (1 + np.exp(-r.log_weight / max(1, r.n_features) ** 0.5))) for r in rows)
    got = {r.doc_id: r for r in quality_classifier.weigh(docs, ratio).collect()}
    assert [got[i].n_features for i in range(5)] == [n(t) for t in texts] and got[3].log_weight == 0 and got[2].score == 0.5


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    ratio, share = quality_classifier.train(odd, labels)
    got = quality_classifier.resample(quality_classifier.weigh(odd, ratio), share).collect()
    assert len(got) == len(odd_rows) and share == 0.5
    empty, _ = quality_classifier.train(none, labels)
    assert not empty.any() and quality_classifier.resample(quality_classifier.weigh(none, empty), 0.5).collect() == []


@pytest.mark.parametrize("size, at", [(8, 3), (60, 59)])
def test_toxic_tokens_in_short_texts_and_at_ends_are_learned(spark, size, at):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        w = [f"word{k}" for k in rng.integers(0, 60, size)]
        if i % 4 == 0:
            w[at] = "vile"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    held = [part for _, _, f, n, _, _ in toxicity.tokens([t.encode() for _, t in rows[300:]]) for part in np.split(f, np.cumsum(n)[:-1])]
    p = toxicity.marginals(chain.emissions(np.concatenate(held)).astype(float), np.full(100, size), chain.steps).reshape(100, size)
    assert ((p >= 0.5) == [[i % 4 == 0 and k == at for k in range(size)] for i in range(300, 400)]).all()


def test_segments_give_the_same_marginals():
    """Texts in segments of any size, against one recursion over each whole text."""
    rng = np.random.default_rng(7)
    counts = np.array([0, 1, 5, 64, 65, 7, 200, 0, 33])
    e, steps = rng.normal(scale=3, size=counts.sum()), rng.normal(scale=2, size=(2, 2))
    want = toxicity.marginals(e, counts, steps, most=10**9)
    for most in (1, 2, 8, 64, 100):
        assert np.allclose(toxicity.marginals(e, counts, steps, most=most), want, atol=1e-9)


def test_gradient_is_that_of_the_likelihood(monkeypatch):
    """One training step moves each weight by the sign of the numerical gradient of the labels' log likelihood."""
    rng = np.random.default_rng(9)
    f, y = rng.integers(0, 4, (3, 4, 3)), rng.integers(0, 2, (3, 4)).astype(float)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    monkeypatch.setattr(toxicity, "BITS", 3)
    tables, steps = toxicity.train_chain(f, y)

    def likelihood(t, s):
        total = 0.0
        for x, lab in zip(f, y.astype(int), strict=True):
            def value(path):
                return sum(t[k][x[i, k]] * path[i] for i in range(4) for k in range(3)) + sum(s[path[i], path[i + 1]] for i in range(3))
            total += value(lab) - np.log(sum(np.exp(value(p)) for p in np.ndindex(2, 2, 2, 2)))
        return total

    zero, none = np.zeros((3, 8)), np.zeros((2, 2))
    for k in range(3):
        for i in range(8):
            up = zero.copy()
            up[k, i] = 1e-5
            slope = (likelihood(up, none) - likelihood(zero, none)) / 1e-5
            assert abs(slope) < 1e-4 or np.sign(slope) == np.sign(tables[k, i])
    for i, j in np.ndindex(2, 2):
        up = none.copy()
        up[i, j] = 1e-5
        slope = (likelihood(zero, up) - likelihood(zero, none)) / 1e-5
        assert abs(slope) < 1e-4 or np.sign(slope) == np.sign(steps[i, j])


def test_lexicon_and_document_score_equal_brute_force():
    bad, every = np.array([9.0, 1.0, 0.0, 3.0]), np.array([10.0, 10.0, 40.0, 4.0])
    rate = 0.1
    z = [(b - rate * n) / (n * rate * (1 - rate)) ** 0.5 for b, n in zip(bad, every, strict=True)]
    want = [zz >= toxicity.Z and b >= 0.6 * n and n >= 3 for zz, b, n in zip(z, bad, every, strict=True)]
    assert toxicity.lexicon(bad, every, rate).tolist() == want
    p, counts = np.array([0.5, 0.25, 0.9]), np.array([2, 0, 1])
    got = toxicity.document_features(p, counts)
    assert np.allclose(got, [[1, np.log1p(0.75), 0.5, 0.375], [1, 0, 0, 0], [1, np.log1p(0.9), 0.9, 0.9]])
    chain = toxicity.Chain(np.zeros((3, 1 << toxicity.BITS), dtype=np.float32), np.zeros((2, 2)), np.array([0.1, 0.2, 0.3, 0.4]))
    x = [1, np.log1p(1.0), 0.5, 0.5]  # two tokens, each of probability one half
    assert np.allclose(toxicity._scores(chain, [b"some words", b""]), [1 / (1 + np.exp(-np.dot(x, chain.document))), 1 / (1 + np.exp(-0.1))])


@pytest.mark.parametrize(("each", "most"), [(5, 100), (3, 7), (1000, 5000)])
def test_samples_are_those_of_smallest_hash(spark, each, most):
    rows = [(i, "abc"[min(2, i % 10 // 4)]) for i in range(3000)] + [(5, "a")] * 50 + [(None, "a"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, k string")
    hashed = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h")).collect()}
    ranked = []
    for c in "abc":
        mine = sorted({i for i, k in rows if k == c and i is not None}, key=lambda i: hashed[i])[:each]
        ranked += [(n, i, c) for n, i in enumerate(mine)]
    got = {(r.doc_id, r.k) for r in per_class(df, "k", each, most).collect()}
    assert got <= {(i, c) for _, i, c in ranked} and len(got) == min(most, len(ranked))
    last = sorted(ranked)[min(most, len(ranked)) - 1][0]
    assert {(i, c) for n, i, c in ranked if n < last} <= got


def test_places_behind_a_window_do_not_count():
    rng = np.random.default_rng(4)
    f, y = rng.integers(0, 50, (6, 5, 3)), rng.integers(0, 2, (6, 5)).astype(float)
    want = toxicity.train_chain(f, y)
    wide, labels = np.zeros((6, 9, 3), dtype=f.dtype), np.ones((6, 9))
    wide[:, :5], labels[:, :5] = f, y
    got = toxicity.train_chain(wide, labels, np.full(6, 5))
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_text_in_no_learned_language_goes_with_two_languages(spark):
    rng = np.random.default_rng(6)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "жзику"}
    rows = [(i, " ".join("".join(rng.choice(list(alphabets[lang]), 5)) for _ in range(12)), lang) for i in range(300) for lang in [list(alphabets)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.where("lang <> 'cc'")
    got = langid.recognised(docs, langid.train(known)).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"aa": 100, "bb": 100}
