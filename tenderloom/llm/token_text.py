"""Texts as white-space chunks, and a bounded memo.

The splitter of the word-level vocabulary never lets a token span white space, its
normaliser works character by character (composition never reaches across white space),
and its special strings hold none. So the ids of a text are the ids of its chunks, joined.
"""

from __future__ import annotations

import re

#: Python's str.split() also cuts at these four; the vocabulary's pattern does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

def chunks(text: str) -> list[str]:
    """Maximal runs without white space (Unicode White_Space)."""
    if _SEPARATORS.search(text):
        return [x for x in _WHITE.split(text) if x]
    return text.split()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo:
    """Ids of chunks in two generations of ``size`` each: what the last generation saw again moves to the next.

    Memory is bounded, and results never depend on what is held.
    """

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def current(self) -> dict[bytes, bytes]:
        if len(self.now) > self.size:
            self.now, self.before = {}, self.now
        return self.now

    def clear(self) -> None:
        self.now, self.before = {}, {}

    def missing(self, chunks: list[bytes], most: int = 4096) -> list[list[bytes]]:
        """Of distinct chunks, those that neither generation holds, in parts."""
        now, before, new = self.now, self.before, []
        for c in chunks:
            if c not in now:
                if c in before:
                    now[c] = before[c]
                else:
                    new.append(c)
        return [new[k : k + most] for k in range(0, len(new), most)]
