"""Token ids of whole texts by a public vocabulary file."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Anything but line ends, tabs and the printable letters and marks of the Latin blocks.
_OTHER = re.compile("[^\n\t -~¡-ɏ]")


class Encoder:
    """many(texts) -> uint32 arrays, equal to tokenizers' encode(text, add_special_tokens=False).

    A text that holds a special token of the vocabulary gets that token's id there, as tokenizers does.

    path is a tokenizers file. Where the same vocabulary lies beside it as a rank file (.tiktoken), texts of
    Latin letters and common marks, on whose classes all versions of Unicode agree, are encoded by its
    ranks: the same pattern and the same merges, so the same ids, in a third of the time. All other texts,
    and all where there is no rank file, go through tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast, ranks = None, os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def one(self, text: str) -> np.ndarray:
        if self.fast and not _OTHER.search(text) and not (self.special and self.special.search(text)):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def many(self, texts: list[str]) -> list[np.ndarray]:
        return [self.one(t) for t in texts]
