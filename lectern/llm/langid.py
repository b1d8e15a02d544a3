"""Language identification by string kernels.

A text's features are the character n-grams (1 to 3 characters, lower-cased, anything but letters as
a blank) that it has at all, hashed to DIMS places in three blocks. The blended-spectrum kernel of two
texts is the number of n-grams both have, over the lengths of their presence vectors. LANDMARKS
training texts span a Nyström subspace; in it, kernel ridge regression fits one language against
the rest. The kernel is linear in the presence vectors, so the landmarks and the coefficients fold
into one matrix, and a batch of texts is scored by one matrix product.

The model is fit on a bounded sample: at most TRAIN_EACH texts of a language and TRAIN_MOST in all,
those with the smallest hashed doc_id. Whole texts are used for training and scoring.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the
language that comes first by code point; with no labelled text at all, all are ``und``; repeated rows
are each judged; very long texts are judged whole, a piece in memory at a time; an empty table gives an empty result; other
columns, whatever their names, are ignored (`recognised` carries them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_batches
from lectern.llm.samples import held_out, per_class
from lectern.llm.textcore import sliced

#: Places for n-grams of 1, 2 and 3 characters.
PLACES = (1 << 10, 1 << 13, 1 << 14)
DIMS = sum(PLACES)
LANDMARKS = 256
RIDGE = 1e-2
TRAIN_EACH = 500
TRAIN_MOST = 4000
#: Texts are taken in groups of so many characters and texts at most, as each takes DIMS numbers.
GROUP_CHARS, GROUP_TEXTS = 250_000, 128

_letter = None


def _letters() -> np.ndarray:
    """For each code point of the first plane, whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16)
    return _letter


def presence(texts: list[str]):
    """(from, to, presence matrix, has a letter) for runs of texts of about GROUP_CHARS characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if len(t) > GROUP_CHARS:
            if at < k:
                yield at, k, *_presence(texts[at:k])
            # A long text in pieces; each has the first two characters of the next, so that no n-gram is lost.
            cuts = range(0, len(t), GROUP_CHARS)
            parts = [_presence([t[a : a + GROUP_CHARS + 2]], "" if a + GROUP_CHARS < len(t) else "   ") for a in cuts]
            yield k, k + 1, np.logical_or.reduce([x for x, _ in parts]), np.logical_or.reduce([has for _, has in parts])
            at, size = k + 1, 0
            continue
        size += len(t)
        if size >= GROUP_CHARS or (k + 1 - at) >= GROUP_TEXTS or k + 1 == len(texts):
            yield at, k + 1, *_presence(texts[at : k + 1])
            at, size = k + 1, 0


def _presence(texts: list[str], end: str = "   ") -> tuple[np.ndarray, np.ndarray]:
    low = [t.lower() for t in texts]
    codes = np.frombuffer((end.join(low) + end).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flat = codes < 1 << 16
    letter = np.where(flat, _letters()[np.where(flat, codes, 0)], True)
    codes = np.where(letter, codes, np.uint32(32))
    ends = np.cumsum(np.fromiter((len(t) + len(end) for t in low), dtype=np.int64, count=len(low)))
    doc = np.repeat(np.arange(len(low), dtype=np.int64), np.diff(ends, prepend=0))
    has = np.zeros(len(low), dtype=bool)
    has[doc[letter & flat]] = True
    for i in np.unique(doc[~flat]).tolist():
        has[i] = has[i] or any(c.isalpha() for c in low[i])
    out = np.zeros(len(low) * DIMS, dtype=bool)
    base, value = 0, np.zeros(len(codes), dtype=np.uint32)
    inside = np.ones(len(codes), dtype=bool)  # n-grams that begin here end in the same text
    for n, places in enumerate(PLACES):
        inside[(ends - n)[(ends >= n) & (n > 0)]] = False
        value = (value[: len(codes) - n] if n else value) * np.uint32(0x01000193)
        value = (value ^ codes[n:]) * np.uint32(0x9E3779B1)
        own = inside[: len(value)]
        out[doc[: len(value)][own] * DIMS + base + (value[own] >> np.uint32(32 - places.bit_length() + 1))] = True
        base += places
    return out.reshape(len(low), DIMS), has


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    #: Halfway from chance (scores sum to 1, so the best is 1 / languages or more) to the least sure training text; 0 with one language.
    least: float = 0.0

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score from 0 to 1 for each text."""
        given = [t or "" for t in texts]
        langs, scores = ["und"] * len(given), np.zeros(len(given))
        if not self.languages:
            return langs, scores
        for lo, _, x, has in presence(given):
            norm = np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
            f = (x.astype(np.float32) @ self.weights) / norm + self.bias
            best = f.argmax(axis=1)
            for i in np.flatnonzero(has).tolist():
                langs[lo + i] = self.languages[best[i]]
                scores[lo + i] = min(1.0, max(0.0, (1 + float(f[i, best[i]])) / 2))
        return langs, scores


def fit(bits: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression, one against the rest, from packed presence vectors."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((DIMS, 0), dtype=np.float32), np.zeros(0))

    def rows(lo: int, hi: int) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(bits[lo:hi]), dtype=np.uint8).reshape(hi - lo, -1), axis=1)[:, :DIMS].astype(np.float32)
        return x / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]

    mark = rows(0, min(landmarks, len(bits)))
    inner = (mark @ mark.T).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = np.concatenate([(rows(k, min(k + 256, len(bits))) @ mark.T).astype(np.float64) @ root for k in range(0, len(bits), 256)])
    z1 = np.hstack([z, np.ones((len(z), 1))])
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([labels.count(x) for x in languages], dtype=float)[[languages.index(x) for x in labels]]
    w = (1 / share)[:, None] * len(labels) / len(languages)
    gram = z1.T @ (w * z1) + ridge * len(z) / 100 * np.eye(z1.shape[1])
    coef = np.linalg.solve(gram, z1.T @ (w * y))
    # Each training text's score without itself, in closed form; its own fit would be too sure.
    own = np.minimum(w * (z1 * np.linalg.solve(gram, z1.T).T).sum(axis=1)[:, None], 0.999)
    least = (1 + float(((z1 @ coef - own * y) / (1 - own)).max(axis=1).min())) / 2
    least = (1 / len(languages) + least) / 2 if len(languages) > 1 else 0.0
    return Model(languages, (mark.T.astype(np.float64) @ (root @ coef[:-1])).astype(np.float32), coef[-1], min(1.0, max(0.0, least)))


def train(docs: DataFrame, each: int = TRAIN_EACH, most: int = TRAIN_MOST) -> Model:
    """A model from docs (doc_id, text, lang), from a bounded sample of their labelled rows."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    chosen = per_class(known.select("doc_id", "lang"), "lang", each, most)
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")

    def run(batches):
        for batch in sliced(batches):
            out = [b""] * batch.num_rows
            for lo, hi, x, _ in presence(batch.column("text").to_pylist()):
                packed = np.packbits(x, axis=1)
                for i in range(lo, hi):
                    out[i] = packed[i - lo].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(out, pa.binary())], ["lang", "h", "bits"])

    got = in_batches(sample.select("text", "lang", F.xxhash64("doc_id").alias("h")), run, "lang string, h long, bits binary").limit(2 * most).collect()
    got = sorted(got, key=lambda r: (r["h"], r["lang"], bytes(r["bits"])))
    return fit([bytes(r["bits"]) for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))

    def run(batches):
        m = Model(*shared.value)
        for batch in sliced(batches):
            langs, scores = m.decide(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None, least: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, in one of `languages` (None: any learned one) with a score of `least` or more.

    Without `least`, a text goes if it has no letter or scores less than the model's own `least`.
    """
    if not model.languages:
        return docs.where(F.lit(False))
    least = model.least if least is None else least
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))

    def run(batches):
        m = Model(*shared.value)
        wanted = set(m.languages if languages is None else languages)
        for batch in sliced(batches):
            langs, scores = m.decide(batch.column("text").to_pylist())
            yield batch.take(pa.array([i for i, (x, s) in enumerate(zip(langs, scores, strict=True)) if x in wanted and s >= least], pa.int64()))

    return in_batches(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(4, 2)
    model = train(docs.where(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
