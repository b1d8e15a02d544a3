"""Sinks: artifacts, the manifest of speech tasks, and a sink over a client interface (SK1-SK8, OR1-OR4)."""

from __future__ import annotations

import hashlib
import os
import threading
import time
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import schemas
from lectern.errors import LecternError
from lectern.operators import chunking

KEY_BYTES = 1024
BLOCK = 1 << 20


@dataclass(frozen=True)
class SpeechOptions:
    bucket: str
    prefix: str = ""
    region: str | None = None
    voice: str = "Matthew"
    engine: str = "generative"
    output_format: str = "mp3"
    poll_seconds: float = 5
    timeout_seconds: float = 1500
    max_chars: int = chunking.MAX_CHARS
    append_case: bool = True


def write_artifacts(extracted: DataFrame, path: str, mode: str = "error") -> None:
    """SK1: narration, markdown and report of each document as Parquet, one row a document."""
    extracted.write.mode(mode).parquet(path)


def _part_suffix(part: Column, parts: Column) -> Column:
    return F.when(parts > 1, F.concat(F.lit("-part-"), F.lpad(part.cast("string"), 3, "0"))).otherwise(F.lit(""))


def audio_key(name: Column, part: Column, parts: Column, prefix: str = "", ending: str = "mp3") -> Column:
    """SK5: prefix, name and part; null where it is longer than KEY_BYTES bytes of UTF-8."""
    lead = prefix.strip("/")
    key = F.concat(F.lit(f"{lead}/" if lead else ""), name, _part_suffix(part, parts), F.lit(f".{ending}"))
    return F.when(F.octet_length(key) <= KEY_BYTES, key)


def audio_file(name: Column, part: Column, parts: Column, append_case: bool = True, ending: str = "mp3") -> Column:
    """SK6: the local name, with ``Case`` behind it unless it ends so."""
    full = F.when(F.lower(name).endswith("case"), name).otherwise(F.concat(name, F.lit("Case"))) if append_case else name
    return F.concat(full, _part_suffix(part, parts), F.lit(f".{ending}"))


def key_of_uri(uri: Column, bucket: str) -> Column:
    """SK7: the key of a path-style or virtual-host URL; null where there is none."""
    host, path = F.parse_url(uri, F.lit("HOST")), F.parse_url(uri, F.lit("PATH"))
    own = F.startswith(host, F.lit(f"{bucket}."))
    raw = F.when(own, F.substring(path, 2, 1 << 20)).when(F.startswith(path, F.lit(f"/{bucket}/")), F.substring(path, len(bucket) + 3, 1 << 20))
    key = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(key != "", key)


def console_url(region: Column) -> Column:
    """SK8."""
    base = "console.aws.amazon.com/polly/home/SynthesisTasks"
    return F.when(region.isNull(), F.lit(f"https://{base}")).otherwise(F.concat(F.lit("https://"), region, F.lit(f".{base}?region="), F.url_encode(region)))


def manifest(docs: DataFrame, name: str = "name", text: str = "narration", options: SpeechOptions | None = None, paragraph: str = r"(?U)\n\s*\n", whole: bool = False) -> DataFrame:
    """A row per chunk of docs (doc_id, name, narration): schemas.MANIFEST. whole: see chunking.chunks."""
    o = options or SpeechOptions(bucket="")
    parts = chunking.chunk_rows(docs, text, o.max_chars, paragraph, whole).join(docs.select("doc_id", F.col(name).alias("__name")), "doc_id")
    n, p, k = F.col("__name"), F.col("part"), F.col("parts")
    return parts.select(
        "doc_id", "part", "parts", audio_key(n, p, k, o.prefix, o.output_format).alias("key"), audio_file(n, p, k, o.append_case, o.output_format).alias("file"),
        F.length("chunk").alias("chars"), F.col("chunk").alias("text"),
    ).select(*schemas.MANIFEST.fieldNames())


class SpeechClient(Protocol):
    """What the speech sink needs of a service."""

    def voices(self, engine: str) -> list[str]: ...

    def start(self, text: str, key: str) -> str: ...

    def status(self, task: str) -> tuple[str, str | None]: ...

    def download(self, uri: str): ...

    def size(self, uri: str) -> int: ...

    def version(self, uri: str) -> str: ...

    def copy(self, uri: str, key: str) -> str: ...

    def delete(self, uri: str, version: str) -> None: ...


class Pacer:
    """OR2: least seconds between starts and between status calls, each under its own lock.

    Tasks of one job share a rate without talking to each other: task `turn` of `turns` only moves in its own slots of
    the clock, so that no two tasks move within a gap, and all of them together keep the rate of one.
    """

    def __init__(self, start: float = 1.1, status: float = 0.11, clock=time.monotonic, sleep=time.sleep, turn: int = 0, turns: int = 1):
        self._gaps = {"start": start, "status": status}
        self._next = {"start": float("-inf"), "status": float("-inf")}
        self._locks = {"start": threading.Lock(), "status": threading.Lock()}
        self._clock, self._sleep, self._turn, self._turns = clock, sleep, turn, turns

    def wait(self, kind: str) -> None:
        gap = self._gaps[kind]
        with self._locks[kind]:
            now = self._clock()
            at = max(now, self._next[kind])
            if self._turns > 1:
                cycle = gap * self._turns
                at = max(at, (at - self._turn * gap) // cycle * cycle + self._turn * gap)
                if at < now or (at - self._turn * gap) % cycle > 1e-6:  # not in a slot of its own: the next one
                    at = ((at - self._turn * gap) // cycle + 1) * cycle + self._turn * gap
            if at > now:
                self._sleep(at - now)
            self._next[kind] = at + gap


def await_task(client: SpeechClient, task: str, poll: float = 5, timeout: float = 1500, pacer: Pacer | None = None, clock=time.monotonic, sleep=time.sleep) -> str:
    """OR3: the URI of a finished task."""
    end = clock() + timeout
    while True:
        if pacer:
            pacer.wait("status")
        state, detail = client.status(task)
        if state == "completed":
            return detail or ""
        if state == "failed":
            raise LecternError(f"speech task {task} failed: {detail}")
        if clock() >= end:
            raise LecternError(f"speech task {task} took more than {timeout:g}s")
        sleep(poll)


def download_verified(client: SpeechClient, uri: str, to: str) -> str:
    """SK3: stream to a partial file, check its size, read it back, then rename; the SHA-256 as hex."""
    partial, digest, size = f"{to}.partial", hashlib.sha256(), 0
    os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
    try:
        with open(partial, "wb") as f:
            for block in client.download(uri):
                f.write(block)
                digest.update(block)
                size += len(block)
            f.flush()
            os.fsync(f.fileno())
        if not size or size != client.size(uri):
            raise LecternError(f"{uri}: {size} bytes came")
        again = hashlib.sha256()
        with open(partial, "rb") as f:
            while block := f.read(BLOCK):
                again.update(block)
        if again.digest() != digest.digest():
            raise LecternError(f"{uri}: the file reads otherwise than it was written")
        os.replace(partial, to)
    finally:
        if os.path.exists(partial):
            os.remove(partial)
    return digest.hexdigest()


def delete_copies(client: SpeechClient, copies: list[tuple[str, str]]) -> list[str]:
    """SK4: remote copies (uri, version) go, each only in the version that was fetched; those that stay are returned, as a failure only warns."""
    left = []
    for uri, version in copies:
        try:
            client.delete(uri, version)
        except Exception:  # noqa: BLE001 any client error leaves the copy where it is
            left.append(uri)
    return left


def check_voice(client: SpeechClient, options: SpeechOptions) -> None:
    """OR4."""
    if options.voice not in client.voices(options.engine):
        raise LecternError(f"voice {options.voice} does not speak with engine {options.engine}")


#: What a row says that was not submitted because another one had failed.
NOT_SUBMITTED = "not submitted: another part failed"


def fetch(client: SpeechClient, pacer: Pacer, text: str, key: str, file: str, options: SpeechOptions, sleep=time.sleep) -> str:
    """SK1-SK4 for one part: submit, await, fetch and verify, copy to its readable key, delete the service's own object. The SHA-256."""
    pacer.wait("start")
    uri = await_task(client, client.start(text, key), options.poll_seconds, options.timeout_seconds, pacer, sleep=sleep)
    version = client.version(uri)
    sha = download_verified(client, uri, file)
    client.copy(uri, key)
    delete_copies(client, [(uri, version)])
    return sha


def speak(rows: DataFrame, client_of, folder: str, options: SpeechOptions, jobs: int = 20) -> DataFrame:
    """SK2, OR1: submit each manifest row and fetch its audio; a row of doc_id, part, file, sha256, error for each.

    The voice is checked before anything is paid for. At most `jobs` partitions are in flight, and together they keep one pace.
    After a failure no new part is submitted, in any task, and what runs is brought to its end; rows that failed or were not submitted
    carry their error and can be submitted again. folder is one that all executors share. client_of() makes a client in the task.
    """
    check_voice(client_of(), options)
    stop = os.path.join(folder, f".failed-{uuid.uuid4().hex}")

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        client, pacer = client_of(), Pacer(clock=time.time, turn=TaskContext.get().partitionId(), turns=jobs)
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    if os.path.exists(stop):
                        raise LecternError(NOT_SUBMITTED)
                    out.append((r.doc_id, r.part, r.file, fetch(client, pacer, r.text, r.key, os.path.join(folder, r.file), options), None))
                except Exception as e:  # noqa: BLE001 one bad row must not lose those that are paid for
                    os.makedirs(folder, exist_ok=True)
                    open(stop, "w").close()
                    out.append((r.doc_id, r.part, r.file, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "part", "file", "sha256", "error"])

    return rows.repartition(jobs).mapInPandas(run, "doc_id long, part int, file string, sha256 string, error string")
