"""Token ids of the word-end BPE vocabulary, fast enough for whole corpora.

The tokenizer drops white space and treats every piece between white space on its own, so the
ids of a text are those of its pieces in order. Pieces recur, so each worker keeps a bounded
cache. A piece that is not cached, and is plain Latin text, goes to a byte-pair core that is fed
the same vocabulary (a control byte stands for the end of a word); any other piece
goes to the tokenizer itself.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import regex

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\x21-\x7E¡-¬®-įĲ-ɏ]*")
#: Pieces whose ids a worker keeps (about 150 bytes each).
CACHE_PIECES = 100_000
SPACE = regex.compile(r"[\x20\x09-\x0D]+")
BATCH_CHARS = 1_000_000
#: Stands for the end of a word; a chunk that has this byte goes to the tokenizer itself.
END = b"\x01"


def default_vocabulary() -> str:
    """The path of the vocabulary file; a parameter everywhere it is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(vocabulary)
        model = json.loads(vocabulary)["model"]
        to_byte, suffix = _byte_of(), model["end_of_word_suffix"]
        ranks, ends = {}, np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        for token, i in model["vocab"].items():
            ends[i] = token.endswith(suffix)
            body = bytes(to_byte[c] for c in (token[: -len(suffix)] if ends[i] else token))
            if END not in body or body == END and not ends[i]:
                ranks[body + END * int(ends[i])] = i
        self.core = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.ends = ends
        self.cache: dict[str, bytes] = {}

    def _learn(self, missing: list[str]) -> None:
        """Put the ids of these chunks into the cache; plain ones go to the core in one call."""
        plain, counts, parts = [], [], []
        for chunk in missing:
            if "<|" in chunk or "\x01" in chunk or not (chunk.isascii() or PLAIN.fullmatch(chunk)):
                self.cache[chunk] = np.array(self.slow.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            low = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
            own = [low] if low.isalpha() else PIECES.findall(low)
            if own:
                plain.append(chunk)
                counts.append(len(own))
                parts += own
            else:
                self.cache[chunk] = b""
        if not plain:
            return
        ids = np.array(self.core("\x01".join(parts) + "\x01"), dtype="<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1))[np.cumsum(counts) - 1].tolist()
        raw, at = ids.tobytes(), 0
        for chunk, stop in zip(plain, stops, strict=True):
            self.cache[chunk] = raw[at:stop]
            at = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts are taken a few MB at a time, so that what is at hand stays small."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to str.split, not to the tokenizer
            group.append(SPACE.split(text) if odd else text.split())
            size += len(text)
            if size > BATCH_CHARS or k + 1 == len(texts):
                if len(self.cache) > CACHE_PIECES:
                    self.cache.clear()
                self._learn(list(set().union(*group) - self.cache.keys()))
                get = self.cache.__getitem__
                out += [b"".join(map(get, chunks)) for chunks in group]
                group, size = [], 0
        return out


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process and vocabulary (the file's contents)."""
    return Encoder(vocabulary)
