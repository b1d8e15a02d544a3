"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters, digits and non-ASCII bytes. Only documents are labelled, so token labels
are derived first: near copies in the training sample share their weight, and a token type that
occurs in toxic documents far more often than chance (z above Z) is labelled toxic there; all other
tokens are labelled clean. A two-state chain with hashed word, word-start and word-end features is
trained by gradient ascent on windows around toxic tokens and on windows of other text. Windows are
moved back at a text's end; a text shorter than a window is one of its own length. Counts, windows and
mistakes are taken where the sample lies; the driver gets type counts, at most WINDOWS windows a round and
four numbers a document.

Every whole text is then scored by forward-backward. The tokens' marginals give the offending spans
(code point offsets); their sum, maximum and density, through a logistic regression fit on the same
sample, give the document's score.

The sample is bounded: at most TRAIN_EACH documents of a class, those with the smallest hashed doc_id,
whole whatever their length; of all candidate windows, WINDOWS are taken (those of smallest hash).

Defined results: a null or empty text has no token and gets the score of a text without toxic
tokens; without labels, or with one class only, all scores are 0; repeated rows are each scored; of several labels
of a doc_id the larger counts; very long texts are scored whole, in segments whose ends are exact; a
score of 0.5 counts as toxic; an empty table gives an empty result; other columns, whatever their names, are ignored
(`clean` carries them).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, in_batches
from lectern.llm.near_dedup import shingle_sets, signature
from lectern.llm.samples import held_out, per_class
from lectern.llm.textcore import U, groups, mix, sliced, word_spans

BITS = 18
TRAIN_EACH = 2500
Z = 6.0
WINDOW = 24
WINDOWS = 20_000
STEPS = 60
#: Rounds of training; tokens of clean documents above MISTAKEN are added for the next one.
ROUNDS = 3
MISTAKEN = 0.1
L2 = 1e-3

_blank = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def tokens(texts: list[bytes]):
    """(from, to, features (tokens, 3), counts, starts, stops) for runs of texts; starts and stops are bytes in the joined run."""
    for lo, hi in groups(texts):
        run = [t.translate(_blank) for t in texts[lo:hi]]
        value, counts, starts, stops, data = word_spans(run)
        shift = U(64 - BITS)
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        size = stops - starts
        head, tail = np.zeros(len(starts), dtype=U), np.zeros(len(starts), dtype=U)
        for j in range(4):
            inside = size > 4  # a shorter token has no start or end apart from itself
            head = mix(head + np.where(inside, padded[starts + j].astype(U), U(0)) + U(j + 1))
            tail = mix(tail + np.where(inside, padded[np.maximum(stops - 1 - j, 0)].astype(U), U(0)) + U(j + 101))
        yield lo, hi, np.stack([value >> shift, head >> shift, tail >> shift], axis=1).astype(np.int32), counts, starts, stops


@dataclass
class Chain:
    """Weights of toxic against clean: three feature tables, the four transitions, and the document regression."""

    tables: np.ndarray  # (3, 1 << BITS)
    steps: np.ndarray  # [from, to]
    document: np.ndarray  # constant, log1p(sum), maximum, share

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.tables[0][features[:, 0]] + self.tables[1][features[:, 1]] + self.tables[2][features[:, 2]]


def _soft(a, b):
    return np.logaddexp(a, b)


def _ends(emission: np.ndarray, counts: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments end to end (first: is it its text's first one): log odds of toxic before it (forward) and behind it (backward).

    Each segment's recursion is one 2 x 2 matrix; matrices of all segments are built in one loop over positions, and
    chained along each text.
    """
    n = len(counts)
    before, behind = np.zeros(n), np.zeros(n)
    many = np.flatnonzero(~first | np.append(~first[1:], False))  # segments of texts that have several
    if not len(many):
        return before, behind
    top = steps.max()
    move = np.exp(steps - top)  # [from, to]
    begin = (np.cumsum(counts) - counts)[many]
    size = counts[many]
    product = np.repeat(np.eye(2)[None], len(many), axis=0)  # rows: state behind; columns: state before
    for t in range(int(size.max())):
        live = size > t
        e = emission[begin[live] + t]
        step = np.empty((len(e), 2, 2))
        low = np.maximum(e, 0)  # scaled, so that no exponential overflows
        step[:, 0, :] = move[:, 0] * np.exp(-low)[:, None]
        step[:, 1, :] = move[:, 1] * np.exp(e - low)[:, None]
        if t == 0:
            fresh = first[many][live]  # a text's first token has no step before it
            step[fresh] = np.stack([np.exp(-low), np.exp(e - low)], axis=1)[fresh][:, :, None] * np.eye(2)
        made = step @ product[live]
        product[live] = made / made.sum(axis=(1, 2), keepdims=True)
    tiny = 1e-300
    alpha = None
    for k, i in enumerate(many.tolist()):
        if first[i]:
            alpha = np.ones(2)
        else:
            before[i] = np.log(alpha[1] + tiny) - np.log(alpha[0] + tiny)
        alpha = product[k] @ alpha
        alpha = alpha / alpha.sum()
    beta = np.ones(2)
    for k in range(len(many) - 1, -1, -1):
        i = many[k]
        if i + 1 >= n or first[i + 1]:
            beta = np.ones(2)
        behind[i] = np.log(beta[1] + tiny) - np.log(beta[0] + tiny)
        beta = product[k].T @ beta
        beta = beta / beta.sum()
    return before, behind


def marginals(emission: np.ndarray, counts: np.ndarray, steps: np.ndarray, most: int = 1024) -> np.ndarray:
    """Probability of the toxic state for each token of texts laid end to end.

    Both recursions run over positions, with all texts that are long enough in one step, as log odds of toxic
    against clean. Texts of more than `most` tokens are cut into segments of so many, which run side by side: what
    enters a segment at either end is known exactly beforehand (see `_ends`).
    """
    parts = np.maximum(1, -(-counts // most))
    own = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    counts = np.minimum(counts[own] - nth * most, most)
    first = nth == 0
    before, after = _ends(emission, counts, first, steps)
    order = np.argsort(-counts, kind="stable")
    long_, fresh, before, after = counts[order], first[order], before[order], after[order]
    begin = (np.cumsum(counts) - counts)[order]
    longest = int(long_[0]) if len(long_) else 0
    active = np.searchsorted(-long_, -np.arange(longest), side="left")  # segments longer than t
    ahead, behind = np.empty(len(emission)), np.zeros(len(emission))
    some = long_ > 0
    behind[(begin + long_ - 1)[some]] = after[some]
    (c0, c1), (t0, t1) = steps
    for t in range(longest):
        at = begin[: active[t]] + t
        r = before[: active[t]] if t == 0 else ahead[at - 1]
        moved = _soft(r + t1, c1) - _soft(r + t0, c0)
        ahead[at] = emission[at] + (np.where(fresh[: active[t]], 0, moved) if t == 0 else moved)
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        s = emission[at + 1] + behind[at + 1]
        behind[at] = _soft(s + t1, t0) - _soft(s + c1, c0)
    return 1 / (1 + np.exp(-np.clip(ahead + behind, -40, 40)))


def document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    total = np.concatenate([[0.0], np.cumsum(p)])
    mass = total[ends] - total[ends - counts]
    top = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, (ends - counts)[some])
    return np.stack([np.ones(len(counts)), np.log1p(np.maximum(mass, 0)), top, mass / np.maximum(counts, 1)], axis=1)


def train_chain(features: np.ndarray, label: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent on windows (n, WINDOW, 3) with token labels (n, WINDOW); only the first `sizes` places of each window are tokens."""
    n, width, _ = features.shape
    inside = np.arange(width) < (np.full(n, width) if sizes is None else sizes)[:, None]
    places = [features[:, :, k].ravel() for k in range(3)]
    tables, steps = np.zeros((3, 1 << BITS)), np.zeros((2, 2))
    squared, squared_steps = np.zeros_like(tables), np.zeros((2, 2))
    seen = [[np.where(inside[:, 1:], (label[:, :-1] == i) & (label[:, 1:] == j), 0).sum() for j in range(2)] for i in range(2)]
    for _ in range(STEPS):
        # Forward and backward for states 0 and 1, scaled at each place, so that nothing overflows.
        up = np.exp(np.clip(sum(tables[k][places[k]] for k in range(3)), -30, 30)).reshape(n, width).T.astype(np.float32)
        move = np.exp(steps).astype(np.float32)
        alpha, beta = np.empty((2, width, n), dtype=np.float32), np.empty((2, width, n), dtype=np.float32)
        alpha[0, 0], alpha[1, 0] = 1 / (1 + up[0]), up[0] / (1 + up[0])
        for t in range(1, width):
            low = alpha[0, t - 1] * move[0, 0] + alpha[1, t - 1] * move[1, 0]
            high = (alpha[0, t - 1] * move[0, 1] + alpha[1, t - 1] * move[1, 1]) * up[t]
            share = high / (low + high)
            alpha[1, t] = np.where(inside[:, t], share, alpha[1, t - 1])
            alpha[0, t] = 1 - alpha[1, t]
        beta[:, -1] = 0.5
        for t in range(width - 2, -1, -1):
            low, high = beta[0, t + 1], up[t + 1] * beta[1, t + 1]
            zero, one = move[0, 0] * low + move[0, 1] * high, move[1, 0] * low + move[1, 1] * high
            beta[1, t] = np.where(inside[:, t + 1], one / (zero + one), 0.5)
            beta[0, t] = 1 - beta[1, t]
        toxic = alpha[1] * beta[1]
        p = (toxic / (toxic + alpha[0] * beta[0])).T
        miss = np.where(inside, label - p, 0) / n
        for k in range(3):
            grad = np.bincount(places[k], weights=miss.ravel(), minlength=1 << BITS) - L2 / n * tables[k]
            squared[k] += grad**2
            tables[k] += 0.5 * grad / (np.sqrt(squared[k]) + 1e-9)
        pairs = [[alpha[i, :-1] * move[i, j] * beta[j, 1:] * (up[1:] if j else 1) for j in range(2)] for i in range(2)]
        whole = pairs[0][0] + pairs[0][1] + pairs[1][0] + pairs[1][1]
        for i in range(2):
            for j in range(2):
                g = float(seen[i][j] - np.where(inside[:, 1:].T, pairs[i][j] / whole, 0).sum(dtype=float)) / n
                squared_steps[i, j] += g**2
                steps[i, j] += 0.2 * g / (np.sqrt(squared_steps[i, j]) + 1e-9)
    return tables, steps


def _copies(keys: np.ndarray) -> np.ndarray:
    """A weight for each document: one over the number of its near copies in the sample (itself included)."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, row in enumerate(keys.tolist()):
        for k in enumerate(row):
            j = seen.setdefault(k, i)
            if j != i:
                root[find(i)] = find(j)
    group = np.array([find(i) for i in range(len(keys))])
    return 1 / np.bincount(group, minlength=len(keys))[group]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the constant is not shrunk."""
    coef = np.zeros(x.shape[1])
    shrink = ridge * np.eye(x.shape[1])
    shrink[0, 0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        coef = coef + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (w * (y - p)) - shrink @ coef)
    return coef


def lexicon(bad: np.ndarray, every: np.ndarray, rate: float) -> np.ndarray:
    """Token types that toxic documents have far more often than chance, from weighted counts of documents by type."""
    z = (bad - rate * every) / np.sqrt(np.maximum(every * rate * (1 - rate), 1e-9))
    z[(every < 3) | (bad < 0.6 * every)] = 0
    found = z >= Z
    return found if found.any() else (z >= 3) & (z >= np.sort(z)[-10])


def _draws(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed & ((1 << 63) - 1)).integers(0, 1 << 62, n)


@dataclass
class Sample:
    """A bounded sample of labelled texts as token features: a table (doc, seed, toxic, raw), and each one's weight."""

    table: DataFrame
    weight: dict[str, float]

    def types(self) -> tuple[np.ndarray, np.ndarray]:
        """Weighted numbers of toxic and of all documents by token type."""
        shared = self.table.sparkSession.sparkContext.broadcast(self.weight)

        def run(batches):
            bad, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
            for batch in sliced(batches):
                for doc, toxic, f in _rows(batch):
                    types = np.unique(f[:, 0])
                    every[types] += shared.value.get(doc, 0.0)
                    bad[types] += shared.value.get(doc, 0.0) * toxic
            seen = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(bad[seen]), pa.array(every[seen])], ["place", "bad", "every"])

        got = in_batches(self.table, run, "place int, bad double, every double").groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("every").alias("every"))
        bad, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for r in got.collect():  # 2 ** BITS rows at most
            bad[r["place"]], every[r["place"]] = r["bad"], r["every"]
        return bad, every

    def windows(self, marked: np.ndarray, chain: Chain | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, labels and sizes of at most `most` windows, those of smallest hash.

        Without a chain: windows around the marked tokens of toxic documents, and others at random places of all.
        With one: windows around tokens of clean documents that it takes for toxic.
        """
        shared = self.table.sparkSession.sparkContext.broadcast((marked, chain))

        def run(batches):
            known, model = shared.value
            for batch in sliced(batches):
                out, rows = [], list(_rows(batch))
                counts = np.array([len(f) for _, _, f in rows], dtype=np.int64)
                ends = np.cumsum(counts)
                if model is not None and len(rows):
                    p = marginals(model.emissions(np.concatenate([f for _, _, f in rows])).astype(float), counts, model.steps)
                for k, ((_, toxic, f), seed) in enumerate(zip(rows, batch.column("seed").to_pylist(), strict=True)):
                    mark, last = known[f[:, 0]] & bool(toxic), max(0, len(f) - WINDOW)
                    if model is None:
                        hits = np.flatnonzero(mark)
                        at = np.concatenate([np.clip(hits - WINDOW // 2, 0, last), _draws(seed, 1 + len(hits) // 2) % (last + 1)])
                    elif toxic:
                        continue
                    else:
                        at = np.clip(np.flatnonzero(p[ends[k] - counts[k] : ends[k]] > MISTAKEN) - WINDOW // 2, 0, last)
                    key = _draws(seed + 1, len(at))
                    for i in np.argsort(key, kind="stable")[:most].tolist():
                        a = int(at[i])
                        out.append((int(key[i]), f[a : a + WINDOW].tobytes(), mark[a : a + WINDOW].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["key", "raw", "marks"])

        got = in_batches(self.table, run, "key long, raw binary, marks binary").orderBy("key", "raw").limit(most).collect()
        features, labels, sizes = np.zeros((len(got), WINDOW, 3), dtype=np.int32), np.zeros((len(got), WINDOW)), np.zeros(len(got), dtype=int)
        for k, r in enumerate(got):
            sizes[k] = len(r["marks"])
            features[k, : sizes[k]] = np.frombuffer(bytes(r["raw"]), dtype=np.int32).reshape(-1, 3)
            labels[k, : sizes[k]] = np.frombuffer(bytes(r["marks"]), dtype=bool)
        return features, labels, sizes

    def documents(self, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document_features, label and weight of each document, in order of doc."""
        shared = self.table.sparkSession.sparkContext.broadcast(chain)

        def run(batches):
            for batch in sliced(batches):
                rows = list(_rows(batch))
                counts = np.array([len(f) for _, _, f in rows], dtype=np.int64)
                every = np.concatenate([np.zeros((0, 3), dtype=np.int32), *(f for _, _, f in rows)])
                x = document_features(marginals(shared.value.emissions(every).astype(float), counts, shared.value.steps), counts)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["doc", "toxic", "x"])

        got = sorted(in_batches(self.table, run, "doc string, toxic int, x array<double>").limit(8 * TRAIN_EACH).collect(), key=lambda r: (r["doc"], r["x"]))
        return np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], dtype=float), np.array([self.weight.get(r["doc"], 0.0) for r in got])


def _rows(batch):
    for doc, toxic, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "toxic", "raw")), strict=True):
        yield doc, toxic, np.frombuffer(raw, dtype=np.int32).reshape(-1, 3)


def fit(sample: Sample, toxic: dict[str, int], share: float) -> Chain | None:
    """A chain from a sample, its labels by doc and the toxic share of all labels."""
    if len(set(toxic.values())) < 2:
        return None
    weight = sum(sample.weight.values())
    rate = sum(sample.weight[d] * y for d, y in toxic.items()) / weight
    marked = lexicon(*sample.types(), rate)
    taken = sample.windows(marked, None, WINDOWS)
    chain = Chain(np.zeros((3, 1 << BITS), dtype=np.float32), np.zeros((2, 2)), np.zeros(4))
    for _ in range(ROUNDS if len(taken[2]) else 0):
        tables, steps = train_chain(*taken)
        chain = Chain(tables.astype(np.float32), steps, np.zeros(4))
        hard = sample.windows(marked, chain, WINDOWS // 4)
        if not len(hard[2]):
            break
        taken = tuple(np.concatenate([a, b]) for a, b in zip(taken, hard, strict=True))
    x, y, w = sample.documents(chain)
    balance = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    chain.document = logistic(x, y, w * balance)
    return chain


def sampled(s: Scratch, docs: DataFrame, chosen: DataFrame) -> tuple[Sample, dict[str, int]]:
    """The sample of docs (doc_id, text) with labels chosen (doc_id, toxic), and the labels by doc."""
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in sliced(batches):
            raw = [x.encode() for x in batch.column("text").to_pylist()]
            keys = [signature(x).tobytes() if len(x) else b"" for x in shingle_sets(raw, 2)]
            found = [part.tobytes() for _, _, f, counts, _, _ in tokens(raw) for part in np.split(f, np.cumsum(counts)[:-1])]
            seed = pa.array([int(mix(np.frombuffer(hashlib.md5(x).digest()[:8], dtype=U))[0] >> U(2)) for x in raw], pa.int64())
            some = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            columns = [batch.column("doc_id").cast(pa.string()), seed, batch.column("toxic").cast(pa.int32()), pa.array(found, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.take(some) for c in columns], ["doc", "seed", "toxic", "raw", "keys"])

    table = s.keep(in_batches(texts, run, "doc string, seed long, toxic int, raw binary, keys binary"))
    # Labels and signatures of the bounded sample; the limit only matters where chosen doc_ids repeat.
    got = sorted(table.select("doc", "toxic", "keys").limit(8 * TRAIN_EACH).collect(), key=lambda r: (r["doc"], bytes(r["keys"])))
    weights = _copies(np.array([np.frombuffer(bytes(r["keys"]), dtype="<u8") for r in got])) if got else []
    weight: dict[str, float] = {}
    for r, w in zip(got, weights, strict=True):
        weight[r["doc"]] = max(weight.get(r["doc"], 0.0), float(w))
    return Sample(table.select("doc", "seed", "toxic", "raw"), weight), {r["doc"]: r["toxic"] for r in got}


def train(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> Chain | None:
    """A chain from docs (doc_id, text) and labels (doc_id, toxic), from a bounded sample of the labelled rows."""
    known = labels.where("toxic IN (0, 1)").select("doc_id", "toxic")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = per_class(known, "toxic", each, 2 * each).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    with Scratch(docs.sparkSession) as s:
        sample, toxic = sampled(s, docs, chosen)
        return fit(sample, toxic, totals.get(1, 0) / max(1, sum(totals.values())))


def _spans(text: bytes, starts: np.ndarray, stops: np.ndarray) -> list[dict]:
    """Runs of neighbouring toxic tokens as code point offsets."""
    if not len(starts):
        return []
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[a]), "stop": int(points[b]), "text": text[a:b].decode()} for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _judge(chain: Chain, texts: list[bytes]):
    """(scores, tokens of each text, each token's marginal and its bytes (from, to) in its text) for runs of texts."""
    for lo, hi, f, n, starts, stops in tokens(texts):
        p = marginals(chain.emissions(f).astype(float), n, chain.steps)
        base = np.repeat(np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])[:-1], n)
        yield 1 / (1 + np.exp(-np.clip(document_features(p, n) @ chain.document, -30, 30))), n, p, starts - base, stops - base


def _scores(chain: Chain, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(run[0] for run in _judge(chain, texts))])


def score(docs: DataFrame, chain: Chain | None, spans: bool = False) -> DataFrame:
    """doc_id, score, predicted (and spans: array of start, stop, text) for each row of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, score double, predicted int" + (", spans array<struct<start:long, stop:long, text:string>>" if spans else "")
    if chain is None:
        extra = [F.expr("cast(array() AS array<struct<start:long, stop:long, text:string>>)").alias("spans")] if spans else []
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *extra)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in sliced(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            if spans:
                found, parts, at = [], [np.zeros(0)], 0
                for s, counts, p, a, b in _judge(shared.value, texts):
                    parts.append(s)
                    for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                        hit = np.flatnonzero(p[end - n : end] >= 0.5) + end - n
                        runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []
                        found.append(_spans(texts[at], np.array([a[r[0]] for r in runs], dtype=int), np.array([b[r[-1]] for r in runs], dtype=int)))
                        at += 1
                s = np.concatenate(parts)
            else:
                s = _scores(shared.value, texts)
            columns = [batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            names = ["doc_id", "score", "predicted"]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_batches(docs.select("doc_id", "text"), run, schema)


def clean(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    if chain is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in sliced(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield batch.take(pa.array(np.flatnonzero(_scores(shared.value, texts) < 0.5)))

    return in_batches(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """spans: the offending offsets, as start and stop in code points."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = held_out(5, 0)
    chain = train(docs, labels.where(~out))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return score(docs, chain, spans=True).select("doc_id", out.alias("held_out"), "score", "predicted", spans.alias("spans"))
