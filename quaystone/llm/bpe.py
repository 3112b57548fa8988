"""Byte-level BPE of a ``tokenizers`` JSON file, encoded with the fastest engine that gives the library's ids.

The vocabulary is read from the JSON file alone. When its merges are in id order (ids of merged tokens rise with
merge priority) the rank-based engine of ``tiktoken`` gives the same ids, several times faster; otherwise, and
for any text that engine refuses, ``tokenizers`` itself encodes.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np

#: The split pattern of a ByteLevel pre-tokenizer with use_regex (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _char_to_byte() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes texts as ``tokenizers`` does with ``add_special_tokens=False`` and its defaults otherwise."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_byte = _char_to_byte()
        vocab = spec["model"]["vocab"]
        special_ids = set(self.special.values())
        self.token_bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if i not in special_ids}
        self.ranks = {b: i for i, b in self.token_bytes.items()}
        self.core = None
        if self._regular(spec, vocab):
            import tiktoken

            self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)._core_bpe
        self.specials = set(self.special)

    @cached_property
    def library(self):
        """The ``tokenizers`` object, loaded only where it is needed."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def _regular(self, spec: dict, vocab: dict[str, int]) -> bool:
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            return False
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            return False
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [vocab["".join(p)] for p in pairs]
        return ids == sorted(ids) and len(set(ids)) == len(ids) and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")

    def encode(self, text: str) -> np.ndarray:
        """Ids as uint32."""
        if self.core is not None:
            try:
                return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, self.specials), np.uint32)
            except BaseException as e:  # the regex engine gives up on some extreme runs by a panic, which isn't an Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if self.core is not None:
            return self.core.encode_single_piece(piece)
        from_byte = {b: c for c, b in _char_to_byte().items()}
        return [t.id for t in self.library.model.tokenize("".join(from_byte[b] for b in piece))]


@lru_cache(2)
def load(path: str) -> ByteBpe:
    """One engine a worker process and path."""
    return ByteBpe(path)
