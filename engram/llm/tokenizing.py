"""Exact pieces of a byte-level BPE tokenizer, encoding each distinct pre-token once."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

#: The pre-token pattern of byte-level BPE, as the vocabulary's library applies it, with
#: letters and digits as Python's own classes have them, which are the same among SETTLED characters.
PATTERN = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters that have the same class there and in the library, whatever its version of Unicode.
SETTLED = "\\u0000-\\u001b\\u0020-\\u00b1\\u00b4-\\u00b8\\u00ba\\u00bb\\u00bf-\\u0557\\u1e00-\\u1eff\\u2000-\\u2064\\u20a0-\\u20b9\\u2500-\\u26ff\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000


class _Known(dict):
    """Values of pre-tokens; one that isn't known yet is encoded by the library's model."""

    def __init__(self, model, value, remembered: int):
        super().__init__()
        self.model, self.value, self.remembered = model, value, remembered
        #: The printable stand-ins of bytes in byte-level vocabularies: printable ones stand for
        #: themselves, the others follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        self.stand_in = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}

    def __missing__(self, piece: str):
        if len(self) >= self.remembered:
            self.clear()
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.stand_in))
        value = self[piece] = self.value([t.id for t in tokens])
        return value


class Pieces:
    """Pre-tokens of texts with a value for each distinct one: by default its number of ids."""

    def __init__(self, path: str, value=len, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.plain = self.plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.tokenizer = Tokenizer.from_file(path)
        self.value = value
        self.find = re.compile(PATTERN).findall
        self.odd = re.compile(f"[^{SETTLED}]").search
        self.special = {t["content"]: value([t["id"]]) for t in added}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")").split if added else None
        self.known = _Known(self.tokenizer.model, value, remembered)
        self.byte_of = {c: b for b, c in self.known.stand_in.items()}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cut_up(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, and the number of ids of its special strings (of all of it, if its pre-tokens aren't known)."""
        if not self.plain:
            return [], len(self.ids(text))
        parts, special = [text], 0
        if self.cut and any(s in text for s in self.special):
            parts = self.cut(text)
            parts, special = parts[::2], len(parts) // 2
        found: list[str] = []
        for part in parts:
            found += self.library_pieces(part) if self.odd(part) else self.find(part)
        return found, special

    def library_pieces(self, text: str) -> list[str]:
        """The pre-tokens as the library cuts them, from its stand-ins of bytes."""
        return [p.translate(self.byte_of).encode("latin-1").decode() for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def values(self, text: str) -> Iterator:
        """The values of the text's pre-tokens in order; special strings as the library takes them."""
        if not self.plain or self.odd(text):
            return iter((self.value(self.ids(text)),))
        get = self.known.__getitem__
        if self.cut and any(s in text for s in self.special):
            return chain.from_iterable((self.special[part],) if k % 2 else map(get, self.find(part)) for k, part in enumerate(self.cut(text)))
        return map(get, self.find(text))


@lru_cache(2)
def pieces(path: str, width: str | None = None) -> Pieces:
    """The pieces that this process remembers, over all its tasks: numbers of ids, or ids as bytes."""
    if width is None:
        return Pieces(path)
    kind = struct.Struct(width).pack
    return Pieces(path, lambda ids: b"".join(map(kind, ids)))
