"""Subword ids of a public tokenizer, with the ids of pieces of text kept for reuse.

The byte-level tokenizer splits a text before it merges bytes. Where white space ends and other characters begin is always such a
split (the last white-space character goes with what follows), so a text may be cut there and each cut encoded by itself, with the
same ids. Cuts repeat far more often than they differ, so most ids come from a dictionary of at most 2 * CACHE cuts.

The vocabulary and merges are read from the tokenizer's own file by the tokenizers library; cuts are then merged by tiktoken on the same
vocabulary, which is some three times as fast on single cuts. The tests hold its ids against tokenizers' on whole texts.
"""

from __future__ import annotations

import re

import tiktoken
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

#: What the tokenizer's pattern takes for white space.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f"[{_S}]?[^{_S}]+|[{_S}]+(?=[{_S}][^{_S}])|[{_S}]+")
#: Fixed value: how the tokenizer's kind of pre-tokenization splits a text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, LONG = 150_000, 64


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Byte for each character that a byte-level vocabulary writes it as: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _encoder(path: str) -> tiktoken.Encoding:
    tok, byte_of = Tokenizer.from_file(path), _byte_of()
    if not isinstance(tok.decoder, ByteLevel):
        raise ValueError(f"{path} is not byte-level")
    special = set(tok.get_added_tokens_decoder())
    ranks = {bytes(byte_of[c] for c in s): i for s, i in tok.get_vocab().items() if i not in special}
    return tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Subwords:
    """encode(text): ids as little-endian unsigned 32-bit bytes."""

    class _Known(dict):
        def __init__(self, encoder: tiktoken.Encoding):
            self.encoder, self.older = encoder, {}

        def __missing__(self, cut: str) -> bytes:
            data = self.older.get(cut)
            if data is None:
                data = b"".join([i.to_bytes(4, "little") for i in self.encoder.encode_ordinary(cut)])
            if len(cut) <= LONG:
                if len(self) >= CACHE:
                    self.older = dict(self)
                    self.clear()
                self[cut] = data
            return data

    def __init__(self, path: str | None = None):
        self.known = Subwords._Known(_encoder(path or tokenizer_path()))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _CUT.findall(text)))


_OPEN: dict[str | None, Subwords] = {}


def subwords(path: str | None = None) -> Subwords:
    """One for each Python process, kept between tasks."""
    if path not in _OPEN:
        _OPEN[path] = Subwords(path)
    return _OPEN[path]
