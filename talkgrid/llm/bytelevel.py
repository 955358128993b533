"""Byte-level encoding of whole texts, equal to the tokenizers library."""

from __future__ import annotations

import json
import os

#: The byte-level pre-tokenizer and the pattern it stands for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word, or white space, of more characters goes to the library that owns the model.
LONG_RUN = 4096


class ByteLevel:
    """Encoder for one model. ``special``: special tokens inside texts are tokens, as the library has it; else plain text.

    A model whose merges are numbered like its ids is run by tiktoken, which then finds the same tokens several times faster. Any other
    model, texts with endless words, and texts that hold a special token, are left to the tokenizers library.
    """

    def __init__(self, model: bytes, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_buffer(model)
        self.library.encode_special_tokens = not special
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()] if special else []
        spec = json.loads(model)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        vocabulary = spec["model"]["vocab"]
        self.size = 1 + max(self.library.get_vocab(with_added_tokens=True).values())
        #: The bytes of every token; none for special ones.
        self.bytes = [b""] * self.size
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.fast = None
        if spec.get("normalizer") is None and spec.get("pre_tokenizer") == BYTE_LEVEL:
            for p, i in vocabulary.items():
                self.bytes[i] = bytes(byte[c] for c in p)
            if len(vocabulary) == 256 + len(merges) and all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
                import tiktoken
                self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        slow = lambda t: endless(t) or any(s in t for s in self.special)
        return [self.library.encode(t, add_special_tokens=False).ids if slow(t) else self.fast.encode_ordinary(t) for t in texts]


def endless(text: str) -> bool:
    """Whether the text holds a word, or white space, of more than ``LONG_RUN`` characters."""
    if len(text) <= LONG_RUN:
        return False
    words = text.split()
    return max(map(len, words), default=0) > LONG_RUN or (len(text) - sum(map(len, words)) > LONG_RUN and not _short_gaps(text))


def _short_gaps(text: str) -> bool:
    gap = 0
    for c in text:
        gap = gap + 1 if c.isspace() else 0
        if gap > LONG_RUN:
            return False
    return True
