"""Text to pretoken chunks for byte-level BPE with the usual split pattern.

In that pattern a space followed by a character that is not white space always
begins a new match, and so does a line feed between two such characters. Texts
without runs of white space therefore fall apart at spaces and line feeds, and
a chunk's ids depend on the chunk alone. They repeat, so a bounded memo holds
them; texts with runs of white space are encoded whole.
"""

from __future__ import annotations


class ChunkMemo:
    """``encode(text) -> bytes`` with a memo of at most ``limit`` chunks (emptied when full).

    ``encode`` must follow the split pattern and return ids that
    concatenate over the pattern's matches.
    """

    def __init__(self, encode, limit: int = 250_000):
        self._encode, self._limit = encode, limit

        class Memo(dict):
            def __missing__(memo, chunk):
                if len(memo) >= limit:
                    memo.clear()
                out = memo[chunk] = encode(chunk if chunk[:1] == "\n" else " " + chunk)
                return out

        self._memo = Memo()

    def __call__(self, text: str) -> bytes:
        chunks = text.replace("\n", " \n").split(" ")
        if len(chunks) < 2 or len(text.split()) != len(chunks):  # short, or runs of white space
            return self._encode(text)
        first = chunks[0]
        return self._encode(first) + b"".join(map(self._memo.__getitem__, chunks[1:]))
