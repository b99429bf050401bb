"""Byte-level BPE ids of whole texts inside Arrow batches, with a bounded cache of words."""

from __future__ import annotations

import ctypes
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import pyarrow as pa

#: Words kept per worker; words beyond it are encoded each time they occur, with the same result.
CACHE_WORDS = 200_000
BATCH = 4096
#: Fixed value: how a byte-level vocabulary of this kind splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The allocator's own way to give memory back, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Any white space that is not a single blank or newline between other characters.
_IRREGULAR = re.compile(r"[^\S \n]|[ \n][ \n]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if the ids are the order of the merges (then ids and ranks are one); else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    place = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = model["vocab"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(vocab.get(m.replace(" ", "", 1)) != 256 + i for i, m in enumerate(merges)):
        return None
    return {bytes(place[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern never joins characters across a lone blank or newline that stands between other characters, and such a
    blank opens the next token while such a newline is a token of its own. So a text with no other white space is the sum of its
    words, each encoded once with the blank or newline before it; any other text is encoded whole. The words go through the faster of the two
    libraries that read this vocabulary; both give the same ids. A text that spells out one of the vocabulary's added tokens goes whole through
    the library the vocabulary is written for, which gives that token its own id.
    """

    def __init__(self, path: str):
        self._path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens") or ()]
        self._added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        ranks = byte_ranks(path)
        if ranks is None:
            self._ids = self._exact
        else:
            import tiktoken

            self._ids = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def _exact(self, text: str) -> list[int]:
        if self._library is None:  # it takes as much memory as all else here, and few texts ask for it
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library.encode(text, add_special_tokens=False).ids

    def added(self, text: str) -> bool:
        return self._added is not None and self._added.search(text) is not None

    def whole(self, text: str) -> bytes:
        return array("I", self._exact(text) if self.added(text) else self._ids(text)).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split: list[list[str] | None] = []
        for text in texts:
            regular = text and not text[0].isspace() and not text[-1].isspace() and not _IRREGULAR.search(text) and not self.added(text)
            split.append(text.replace("\n", " \n").split(" ") if regular else None)
        fresh = set().union(*[s[1:] for s in split if s]).difference(self.cache)
        known = {w: self.whole(w if w[0] == "\n" else " " + w) for w in fresh}
        room = CACHE_WORDS - len(self.cache)
        if len(known) <= room:
            self.cache |= known
            get = self.cache.__getitem__
        else:
            self.cache |= dict(islice(known.items(), max(room, 0)))
            get = ChainGet(self.cache, known).__getitem__
        return [self.whole(t or "") if s is None else self.whole(s[0]) + b"".join(map(get, s[1:])) for t, s in zip(texts, split)]


class ChainGet(dict):
    """Kept words first at the speed of a dict; the rest of the batch's words where they are missing."""

    def __init__(self, kept: dict[str, bytes], fresh: dict[str, bytes]):
        super().__init__(kept)
        self.fresh = fresh

    def __missing__(self, word: str) -> bytes:
        return self.fresh[word]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def hand_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and what they keep for later counts against their executor all the while."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def in_pieces(batch, columns: list[str], text: str, size: int = 256, most: int = 4_000_000):
    """Slices of a record batch of at most ``size`` rows and about ``most`` characters of ``text`` (a longer row comes alone)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= size or held + n > most):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)
    hand_back()
