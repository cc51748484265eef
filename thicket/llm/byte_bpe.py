"""Token ids of a public byte-level BPE file, as the tokenizers library gives them."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from thicket.llm.word_bpe import byte_letters

#: The pattern by which byte-level vocabularies split text (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_PART = 1 << 20


class ByteBpe:
    """ids(text): the text's ids as little-endian 32-bit bytes.

    Where the file's merges stand in the order of the ids they make, a rank is an id, and
    tiktoken's encoder gives the same ids in a third of the time; other files, and texts that
    hold a special token's string, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.fast = None
        if made == sorted(set(made)):
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, pos = [], 0
        while pos < len(text):  # a very long text, in parts that end between words
            cut = _CUT.search(text, pos + _PART) if len(text) - pos > _PART else None
            end = cut.start() if cut else len(text)
            out.append(np.array(self.fast(text[pos:end]), "<u4").tobytes())
            pos = end
        return b"".join(out)


_made: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One per worker and file."""
    if path not in _made:
        _made[path] = ByteBpe(path)
    return _made[path]
