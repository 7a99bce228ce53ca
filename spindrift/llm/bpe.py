"""Byte-level BPE ids of whole texts, as the ``tokenizers`` library gives them for a vocabulary file.

Texts of characters whose class no library disputes go through the faster of two public encoders with the vocabulary's own
ranks; any other text, and any other kind of vocabulary, goes to the library whole. Huge texts are encoded in overlapping
chunks that are spliced at proven boundaries (``spliced``); there pieces (what the pre-tokenizer cuts) are encoded apart.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np

from spindrift.llm.worker import turn

#: Texts of more characters than this are encoded in chunks of as many.
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 8
#: A boundary this close to a chunk's cut end is not trusted: special tokens and look-ahead may reach over the cut. A vocabulary
#: with longer special tokens widens it by their length.
GUARD_CHARS = 32
#: Pieces of huge texts whose ids a Python worker keeps; what comes later is encoded each time.
KEPT_PIECES = 100_000
#: Fixed value: the pre-tokenizer's pattern.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", " \\t\\n\\r"
#: Characters whose class (letter, number, space or other) is the same in every Unicode version.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞€]*+")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def _byte_characters() -> dict[str, int]:
    """How byte-level vocabularies write each byte as one printable character."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if the file is plain byte-level BPE whose ids follow the order of its merges; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    if ids != sorted(set(ids)) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    decode = _byte_characters()
    ranks = {bytes(decode[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    first = ids[0] if ids else 1 << 31
    return ranks if all(len(token) == 1 or i >= first for token, i in ranks.items()) else None


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.ranks = _ranks(spec)
        if self.ranks is not None:
            import tiktoken

            self.whole = tiktoken.Encoding("texts", pat_str=_PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            self.pieces = _Kept(self._piece_encoder(self.whole._core_bpe.encode_single_piece), KEPT_PIECES)

    def _piece_encoder(self, merge: Callable[[bytes], list[int]]) -> Callable[[str], bytes]:
        ranks = self.ranks

        def encoded(piece: str) -> bytes:
            raw = piece.encode()
            found = ranks.get(raw)
            return found.to_bytes(4, "little") if found is not None else b"".join([i.to_bytes(4, "little") for i in merge(raw)])

        return encoded

    def plain(self, text: str) -> bool:
        return self.ranks is not None and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def short(self, text: str) -> bytes:
        """Ids of one text, all at once."""
        if not self.plain(text):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return _packed(self.whole.encode_ordinary(text))

    def chunk(self, text: str) -> tuple[list[int], list[int], bytes]:
        """The ends of pieces (in characters), the tokens up to each, and the ids. Ends after white space are left out:
        the library trims them."""
        if self.plain(text):
            pieces = _PIECE.findall(text)
            ids = [*map(self.pieces.__getitem__, pieces)]
            return [*accumulate(map(len, pieces))], [n // 4 for n in accumulate(map(len, ids))], b"".join(ids)
        found = self.library.encode(text, add_special_tokens=False)
        ends, counts = [], []
        words, offsets = found.word_ids, found.offsets
        for i, (_, end) in enumerate(offsets):
            if (i + 1 == len(words) or words[i + 1] != words[i]) and end and not text[end - 1].isspace() and (i + 1 == len(words) or offsets[i + 1][1] > end):
                ends.append(end)
                counts.append(i + 1)
        return ends, counts, _packed(found.ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        return self.short(text) if len(text) <= CHUNK_CHARS else b"".join(spliced(text, self.chunk, guard=GUARD_CHARS + max(map(len, self.special), default=0)))

    def count(self, text: str | None) -> int:
        if text and len(text) <= CHUNK_CHARS and self.plain(text):
            return len(self.whole.encode_ordinary(text))
        return len(self.ids(text)) // 4


class _Kept(dict):
    """A function's values, kept for the first ``most`` arguments."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def spliced(text: str, encode: Callable[[str], tuple[list[int], list[int], bytes]], size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, guard: int = GUARD_CHARS) -> Iterator[bytes]:
    """Ids of a huge text from overlapping chunks.

    The pre-tokenizer reads from left to right and looks ahead by one character, never back. So once both the chunk
    before (right up to its guarded end) and the next one end a piece at the same place, all that follows is the same as
    in the whole text: that place is a stable boundary. Where an overlap has none (a word longer than the overlap), it
    is doubled, at last back to the latest stable boundary, from which the next chunk is right by itself.
    """
    n, base, at = len(text), 0, 0
    end = min(n, size)
    ends, counts, ids = encode(text[:end])
    used = 0
    while end < n:
        reach, till = max(overlap, 2 * guard), min(n, end + max(size - overlap, 1))
        while True:
            start = max(base, end - reach)
            if start == base:  # nothing stable so far: read on twice as far, so that a text without boundaries is not read often
                till = min(n, max(till, base + 2 * (end - base)))
            next_ends, next_counts, next_ids = encode(text[start:till])
            known = dict(zip((start + e for e in next_ends), next_counts, strict=True))
            common = next(((at + e, c) for e, c in zip(ends[:-2], counts[:-2], strict=True) if start < at + e <= end - guard and at + e > base and at + e in known), None)
            if common or start == base:
                break
            reach *= 2
        if common:
            place, count = common
            yield ids[4 * used : 4 * count]
            base, used = place, known[place]
        else:  # the new chunk starts at the latest stable boundary and replaces this one
            used = 0
        ends, counts, ids, at, end = next_ends, next_counts, next_ids, start, till
    yield ids[4 * used :]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in each Python worker."""
    turn("bpe", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
