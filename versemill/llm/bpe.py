"""Byte-level BPE ids from a public tokenizer's rank file.

The vocabulary's added token stands for its string wherever that stands in a text; what lies between is encoded by itself.

A space between two characters that aren't white space always starts a pre-token, and what follows it is split and encoded independently of what
stands before, so texts may be cut there (`chunks`).
"""

from __future__ import annotations

import base64
from array import array

# The string of the vocabulary's added token, and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
CHUNK = 64  # characters of a chunk, at least
_encoders: dict[str | None, "Encoder"] = {}


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of a public tokenizer's rank file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def chunks(text: str) -> list[str]:
    """A text in chunks of CHUNK characters or more that are encoded independently of each other."""
    out, start, at = [], 0, text.find(" ", CHUNK)
    while 0 < at < len(text) - 1:
        # white space here is at least what the vocabulary's pattern takes for it, so that every cut is one for the pattern too
        if text[at - 1].isspace() or text[at + 1].isspace():
            at = text.find(" ", at + 1)
        else:
            out.append(text[start:at])
            start, at = at, text.find(" ", at + CHUNK)
    return [*out, text[start:]] if start < len(text) else out


class Encoder:
    """Ids of the vocabulary in `path` (ranks with the pattern of the public tokenizers), all below 2^16.

    Without a path it is looked up where the encoder is made, that is on the worker.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path or vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ordinary = encoding.encode_ordinary
        self._pre_tokens = regex.compile(public_tokenizers.PATTERN).findall

    def plain(self, text: str) -> list[int]:
        """Ids of a text."""
        if ADDED not in text:
            return self._ordinary(text)
        first, *rest = text.split(ADDED)
        out = self._ordinary(first)
        for part in rest:
            out.append(ADDED_ID)
            out += self._ordinary(part)
        return out

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; the added token's string is one."""
        first, *rest = text.split(ADDED)
        out = self._pre_tokens(first)
        for part in rest:
            out.append(ADDED)
            out += self._pre_tokens(part)
        return out

    def ids(self, text: str) -> bytes:
        """Ids of a text as unsigned 16-bit numbers."""
        return array("H", self.plain(text)).tobytes()


def encoder(path: str | None = None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
