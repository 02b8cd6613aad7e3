"""Token ids of texts word by word, exactly as the tokenizers library gives them for whole texts.

The vocabulary drops white space, so no token spans a blank or a line feed, and a text's ids are the
ids of its parts between them. Parts recur often; their ids are kept in a cache of bounded size, and
only new parts go to the library, many in one call. Parts that consist of Latin letters, perhaps with
one final point or comma, pass the library's normaliser and splitter as one piece, so they go to its
model directly; every other part goes through the full library pipeline.
"""

from __future__ import annotations

import os
import re
from itertools import filterfalse

import numpy as np

VOCABULARY = "word_bpe_49k.json"
CACHE_PARTS = 1_000_000
#: Parts longer than this are encoded but not kept.
KEPT_CHARS = 48
CALL_PARTS = 2_000
#: Letters whose lower case and composed form do not depend on their neighbours (without U+0130).
LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ǃ]+)([.,]?)")


def vocabulary_path(vocabulary: str) -> str:
    """A file's path as it is; a bare name is looked up among the installed public vocabularies."""
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it can be printed."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return [chr(byte) if byte in shown else chr(256 + hidden.index(byte)) for byte in range(256)]


def parts(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class PartEncoder:
    """Ids of text parts as little-endian 32-bit words in bytes, from a bounded cache."""

    def __init__(self, vocabulary: str = VOCABULARY, cache_parts: int = CACHE_PARTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        path = vocabulary_path(vocabulary)
        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.letters = dict(enumerate(byte_letters()))
        self.limit = cache_parts
        self.cache: dict[str, bytes] = {}

    def vocabulary(self) -> dict[str, int]:
        return self.library.get_vocab()

    def known(self, wanted: list[str]) -> dict[str, bytes]:
        """A lookup that holds every wanted part."""
        new = set(filterfalse(self.cache.__contains__, wanted))
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = set(wanted)
        if not new:
            return self.cache
        fresh = self._encoded(list(new))
        long = {part: ids for part, ids in fresh.items() if len(part) > KEPT_CHARS}
        if long or len(fresh) > self.limit:
            return {**self.cache, **fresh}
        self.cache.update(fresh)
        return self.cache

    def _encoded(self, new: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        stems: dict[str, str] = {}
        rest: list[str] = []
        for part in new:
            match = LATIN.fullmatch(part)
            if match:
                stems[part] = match[1].lower()
            elif part:
                rest.append(part)
            else:
                found[part] = b""
        ids = {stem: self.cache[stem] for stem in set(stems.values()) if stem in self.cache}
        ids.update(self._model_ids(list(set(stems.values()).difference(ids))))
        ends = {mark: self._library_ids([mark])[0] for mark in ".,"} if stems else {}
        for part, stem in stems.items():
            found[part] = ids[stem] + (ends[part[-1]] if part[-1] in ends else b"")
        found.update(zip(rest, self._library_ids(rest), strict=True))
        return found

    def _model_ids(self, stems: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        for start in range(0, len(stems), CALL_PARTS):
            group = stems[start : start + CALL_PARTS]
            written = [stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters) for stem in group]
            encoding = self.model.encode(" ".join(written), add_special_tokens=False)
            ids = np.array(encoding.ids, dtype="<u4")
            cuts = np.searchsorted(np.array(encoding.word_ids, dtype=np.int64), np.arange(len(group) + 1))
            body = ids.tobytes()
            found.update((stem, body[4 * a : 4 * b]) for stem, a, b in zip(group, cuts[:-1], cuts[1:], strict=True))
        return found

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4").tobytes() for one in encoded]


_ENCODERS: dict[tuple[str, int], PartEncoder] = {}


def encoder(vocabulary: str = VOCABULARY, cache_parts: int = CACHE_PARTS) -> PartEncoder:
    """The worker's own encoder; its cache lives on between the tasks of one worker."""
    key = vocabulary, cache_parts
    if key not in _ENCODERS:
        _ENCODERS[key] = PartEncoder(vocabulary, cache_parts)
    return _ENCODERS[key]


def byte_groups(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive runs of rows whose bytes stay below a bound, or single rows above it."""
    runs, start, total = [], 0, 0
    for row, size in enumerate(sizes):
        if row > start and total + size > most:
            runs.append((start, row))
            start, total = row, 0
        total += size
    if start < len(sizes):
        runs.append((start, len(sizes)))
    return runs
