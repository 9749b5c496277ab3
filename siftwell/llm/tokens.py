"""Token ids of a public byte-level BPE file.

The file's vocabulary is read as ranks by tiktoken, which is several times as fast as the tokenizers
library and gives the same ids.  A text that holds the string of a special token goes to the tokenizers
library, as it reads such a string as one id.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

#: how ByteLevel cuts text; files that cut it otherwise are refused
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> dict[str, int]:
    """Byte-level BPE files write bytes as printable characters: those that print stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_characters()
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path}: not a byte-level BPE file that cuts text by the usual pattern")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.ends_sentence = np.zeros(max(ranks.values()) + len(self.special) + 2, bool)
        for token, i in ranks.items():
            self.ends_sentence[i] = token.rstrip(b"\"')")[-1:] in (b".", b"!", b"?")

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def packed(self, text: str) -> bytes:
        """Ids as unsigned 32-bit little-endian bytes."""
        return array("I", self.ids(text)).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
