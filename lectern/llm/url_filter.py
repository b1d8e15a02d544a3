"""URL filters by a bit-parallel wildcard automaton.

Rules are globs over ``.host/path``: ``*`` is any run, ``~`` a run without ``/``, ``?`` one byte, and ``\\`` takes
the next character as it is. All globs are packed side by side into multiword Shift-And masks over the bytes of UTF-8:
a bit for each state, a mask of states entered and a mask of states held for each byte. A step moves
the states of all globs at once, for a whole batch of URLs, which share the step loop sorted by length; the few
longest of a batch go on alone, with the same masks as one large number each.

A rule with a host fits that host and its subdomains, character by character (marks that are wildcards in globs are
none in it); the longest fitting rule decides, of equally long ones the first by code point. Without
one, block globs decide, unless an allow glob fits too.

Defined results: a null or empty URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed; repeated rows are each judged; very long URLs are judged whole; no rules at all allow everything; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_batches
from lectern.llm.textcore import sliced

#: (host and path, verdict), as site owners write them.
SITE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: What no site rule decides: hosts and paths of junk, trackers and downloads.
BLOCK_GLOBS = ("~spam~/*", "~spam~", "~pills~/*", "~pills~", "~casino~/*", "~casino~", "~porn~/*", "~porn~", "~xxx~/*", "~xxx~", "~.ads.~/*", "~tracker~/*", "*/ads/*", "*.exe")
ALLOW_GLOBS = ("~.antispam.~/*",)

#: Steps of a glob that are no byte.
ANY, RUN, ONE = 256, 257, 258
WILD = {"*": ANY, "~": RUN, "?": ONE}
#: A batch's states take about so many bytes.
STATE_BYTES = 32_000_000


@dataclass
class Automaton:
    """Masks over bytes: enter[c] and hold[c] are the states entered and held on byte c."""

    enter: np.ndarray
    hold: np.ndarray
    start: np.ndarray
    final: list[tuple[int, int]]

    @classmethod
    def of(cls, globs) -> Automaton:
        parsed = [_steps(g) for g in globs]
        states = sum(1 + sum(c not in (ANY, RUN) for c in g) for g in parsed)
        words = max(1, -(-states // 64))
        enter, hold, start, final = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), []
        at = 0

        def put(mask, bit):
            mask[..., bit // 64] |= np.uint64(1 << (bit % 64))

        slash = np.arange(256) != ord("/")
        for g in parsed:
            put(start, at)
            for c in g:
                if c == ANY:
                    put(hold, at)
                elif c == RUN:
                    hold[slash, at // 64] |= np.uint64(1 << (at % 64))
                else:
                    at += 1
                    put(enter if c == ONE else enter[c], at)
            final.append((at // 64, at % 64))
            at += 1
        return cls(enter, hold, start, final)

    def run(self, texts: list[bytes], alone: int = 4) -> np.ndarray:
        """(texts, globs) -> whether the glob fits the whole text."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        width = int(lengths[alone]) if len(texts) > alone else 0  # so far at least one more than `alone` texts go on together
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        buffer = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        begin = np.cumsum(lengths) - lengths
        live = len(texts)
        for k in range(width):
            while live and lengths[live - 1] <= k:
                live -= 1
            c, d = buffer[begin[:live] + k], state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.enter[c]) | (d & self.hold[c])
        if len(texts) and lengths[0] > width:
            enter, hold = ([int.from_bytes(row.tobytes(), "little") for row in m] for m in (self.enter, self.hold))
            for row in range(min(alone, len(texts))):
                now = int.from_bytes(state[row].tobytes(), "little")
                for c in texts[order[row]][width:]:
                    now = (now << 1) & enter[c] | now & hold[c]
                state[row] = np.frombuffer(now.to_bytes(8 * state.shape[1], "little"), dtype=np.uint64)
        out = np.empty((len(texts), len(self.final)), dtype=bool)
        for j, (w, b) in enumerate(self.final):
            out[order, j] = (state[:, w] >> np.uint64(b)) & np.uint64(1) == 1
        return out


def _steps(glob: str) -> list[int]:
    """The bytes of a glob, with ANY, RUN and ONE for its wildcards."""
    out, plain = [], False
    for c in glob:
        if not plain and c == "\\":
            plain = True
            continue
        out += [WILD[c]] if not plain and c in WILD else list(c.encode())
        plain = False
    return out


def literal(text: str) -> str:
    """A glob that fits the text alone."""
    return "".join(f"\\{c}" if c in WILD or c == "\\" else c for c in text)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame) -> tuple:
    """Site rules from a table (rule, verdict): a rule list is part of the operator's parameters, and sent to all tasks."""
    return tuple((r["rule"], r["verdict"]) for r in rules.where("rule IS NOT NULL").select("rule", "verdict").collect())


def judge(pages: DataFrame, site_rules=SITE_RULES, block=BLOCK_GLOBS, allow=ALLOW_GLOBS, batch: int = 4096) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url). A table of rules goes through `rule_table` first."""
    ranked = sorted(site_rules, key=lambda r: (-len(r[0]), r[0]))
    globs = [f"~.{literal(r)}*" for r, _ in ranked] + list(block) + list(allow)
    n_rules, n_block = len(ranked), len(block)
    shared = pages.sparkSession.sparkContext.broadcast((ranked, globs))

    def run(batches):
        ranked, globs = shared.value
        automaton = Automaton.of(globs)
        names = pa.array([r for r, _ in ranked], pa.string())
        verdicts = np.array([v for _, v in ranked] + ["block", "allow"], dtype=object)
        step = max(16, min(batch, STATE_BYTES // (8 * automaton.enter.shape[1] + len(globs))))
        for part in sliced(batches, step):
            texts = [b"." + h.encode() + p.encode() if h or p else b"" for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)]
            fits = automaton.run(texts)
            mine = np.hstack([fits[:, :n_rules], np.ones((len(texts), 1), dtype=bool)])
            first = mine.argmax(axis=1)  # rules are in order of rank; behind them stands: none
            bad = fits[:, n_rules : n_rules + n_block].any(axis=1) & ~fits[:, n_rules + n_block :].any(axis=1)
            none = first == n_rules
            rule = names.take(pa.array(np.where(none, 0, first), mask=none)) if n_rules else pa.nulls(len(texts), pa.string())
            verdict = verdicts[np.where(none & ~bad, n_rules + 1, first)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), part.column("path"), rule, pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    cut = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return in_batches(cut, run, f"page_id {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


ORACLE = r"""
WITH c AS (SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM c),
p AS (SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '^([^?#]*)', 1) AS path FROM h),
r AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN ('.' || host || '/') LIKE '%.antispam.%/' THEN 'allow'
  WHEN regexp_matches(host, 'spam|pills|casino|porn|xxx') OR (path <> '' AND (('.' || host) LIKE '%.ads.%' OR host LIKE '%tracker%')) OR contains(path, '/ads/')
    OR ends_with(host || path, '.exe') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
