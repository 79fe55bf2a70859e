"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding. Let two tokens be compatible if byte-pair encoding of their joined
bytes gives back just these two. A token sequence is the encoding of its bytes
exactly when all neighbours in it are compatible, so the merges compile into a
nondeterministic transducer over bytes: walk the vocabulary's trie, and at any
token compatible with the one before, either end it or go on. Several readings
stay open until later bytes decide; a deterministic state is the set of open
readings with the tokens they have not yet agreed on. States and transitions
are made when first met and kept. What all readings share is emitted at once,
so a token comes out after a lookahead bounded by the longest token.

Decoding. Tokens may end inside a character, so the decoder keeps a UTF-8
state: each token moves it from one state to the next, and text is released
up to the last complete character.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import ChunkMemo


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeTransducer:
    """Bytes of one pretoken to token ids. ``limit`` bounds the states kept; beyond it they are made anew."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 450_000):
        self._ranks, self._limit = ranks, limit
        self._bytes = {r: b for b, r in ranks.items()}
        self._fits: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}   # the two tokens that a token's last merge joins
        # trie: node -> {byte: node}; token at node; only tokens that encode to themselves can occur
        self._next, self._token = [{}], [None]
        for token, rank in ranks.items():
            *before, whole = self._merges(token)
            if whole != [rank]:
                continue
            if before:
                self._halves[rank] = tuple(before[-1])
            node = 0
            for b in token:
                nxt = self._next[node].get(b)
                if nxt is None:
                    nxt = self._next[node][b] = len(self._next)
                    self._next.append({})
                    self._token.append(None)
                node = nxt
            self._token[node] = rank
        self._reset()

    def _reset(self):
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._moves: list[dict] = []
        self._start = self._state(None, ((0, ()),))

    def _state(self, last, readings: tuple) -> int:
        """``last``: token emitted last; ``readings``: (trie node, tokens read but not emitted)."""
        key = (last, readings)
        found = self._ids.get(key)
        if found is None:
            found = self._ids[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
        return found

    def _merges(self, piece: bytes) -> list[list[int]]:
        """Byte-pair encoding by definition, step by step: the pair of lowest rank first, leftmost among equals."""
        none = 1 << 60
        parts = [piece[i:i + 1] for i in range(len(piece))]
        steps = [[self._ranks[p] for p in parts]]
        while len(parts) > 1:
            rank, i = min((self._ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            steps.append([self._ranks[p] for p in parts])
        return steps

    def _compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            found = self._fits[key] = self._stay_apart(a, b)
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border of neighbours ``a`` and ``b``.

        Run their merges backwards, latest first. The two tokens at the border
        then stand there until the merge just undone; a crossing merge that
        comes before it would have happened. Among equal ranks the left one is
        first.
        """
        raw, halves, ranks, until = self._bytes, self._halves, self._ranks, 1 << 60
        while True:
            crossing = ranks.get(raw[a] + raw[b])
            if crossing is not None and crossing < until:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                until, a = a, left[1]
            else:
                until, b = b + 1, right[0]

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        """Next state and emitted tokens; made on first use."""
        last, readings = self._states[state]
        grown = []
        for node, held in readings:
            nxt = self._next[node].get(byte)
            if nxt is None:
                continue
            if self._next[nxt]:
                grown.append((nxt, held))
            token = self._token[nxt]
            if token is not None:
                before = held[-1] if held else last
                if before is None or self._compatible(before, token):
                    grown.append((0, (*held, token)))
        emitted = grown[0][1]
        for _, held in grown:
            k = 0
            while k < len(emitted) and k < len(held) and emitted[k] == held[k]:
                k += 1
            emitted = emitted[:k]
        if emitted:
            last = emitted[-1]
            grown = [(node, held[len(emitted):]) for node, held in grown]
        if all(held for _, held in grown):
            last = None  # no reading looks back that far
        move = self._moves[state][byte] = (self._state(last, tuple(sorted(grown))), emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pretoken's bytes."""
        if len(self._states) > self._limit:
            self._reset()
        moves, state, out = self._moves, self._start, []
        for byte in piece:
            move = moves[state].get(byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        if piece:  # just one reading ends a token here
            out += next(held for node, held in self._states[state][1] if node == 0)
        return out


class TextEncoder:
    """Whole texts to ids, by pattern matches and the transducer; ids as little-endian unsigned 32-bit."""

    def __init__(self, path: str, pattern: str):
        import regex

        self._split = regex.compile(pattern).findall
        encode = MergeTransducer(load_ranks(path)).encode

        class Pieces(dict):
            """Ids of pretokens met before; emptied when full."""

            def __missing__(pieces, piece):
                if len(pieces) >= 400_000:
                    pieces.clear()
                out = pieces[piece] = array("I", encode(piece.encode("utf-8"))).tobytes()
                return out

        self._pieces = Pieces()
        self._memo = ChunkMemo(self._encode, limit=250_000)

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._split(text)))

    def __call__(self, text: str) -> bytes:
        return self._memo(text)


def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int]:
    """UTF-8 automaton: (bytes still missing, least and greatest next byte); (0, 0, 0) between characters.

    A byte that cannot follow ends the character before it and is looked at afresh.
    """
    missing, low, high = state
    if missing and low <= byte <= high:
        return (missing - 1, 0x80, 0xBF) if missing > 1 else (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return (0, 0, 0)


class Decoder:
    """Streaming decoder: ``feed`` ids, get the bytes of all characters that are complete; ``finish`` gives the rest."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self._bytes = [b""] * size
        self._whole = np.zeros(size, bool)  # tokens that lead from between characters to between characters
        for token, rank in ranks.items():
            self._bytes[rank] = token
            state = (0, 0, 0)
            for b in token:
                state = _utf8_step(state, b)
            self._whole[rank] = state == (0, 0, 0)
        self._moves: dict[tuple, tuple] = {}
        self.reset()

    def reset(self):
        self._state, self._held = (0, 0, 0), b""

    def _move(self, state, token):
        """State after a token, and how many of its last bytes belong to an open character (all: -1)."""
        key = (state, token)
        found = self._moves.get(key)
        if found is None:
            raw, open_bytes, s = self._bytes[token], -1 if state[0] else 0, state
            for k, b in enumerate(raw):
                starts = not (s[0] and s[1] <= b <= s[2])
                s = _utf8_step(s, b)
                if not s[0]:
                    open_bytes = 0
                elif starts:
                    open_bytes = len(raw) - k
            found = self._moves[key] = (s, open_bytes)
        return found

    def feed(self, ids: np.ndarray) -> bytes:
        tokens = ids.tolist()
        joined = self._held + b"".join(map(self._bytes.__getitem__, tokens))
        if not self._state[0] and bool(self._whole[ids].all()):
            self._held = b""
            return joined
        state, tail = self._state, len(self._held)
        for token in tokens:
            state, n = self._move(state, token)
            tail = tail + len(self._bytes[token]) if n < 0 else n
        self._state = state
        cut = len(joined) - tail if state[0] else len(joined)
        self._held = joined[cut:]
        return joined[:cut]

    def finish(self) -> bytes:
        rest = self._held
        self.reset()
        return rest


_WORKERS: dict[tuple, tuple] = {}


def _worker(path: str, pattern: str) -> tuple[TextEncoder, Decoder]:
    """One encoder and decoder for each Python worker."""
    if (path, pattern) not in _WORKERS:
        _WORKERS[path, pattern] = (TextEncoder(path, pattern), Decoder(load_ranks(path)))
    return _WORKERS[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str, with_values: bool = False, chunk: int = 8192,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, then decode its ids in chunks of ``chunk``.

    One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of
    the ids as little-endian unsigned 32-bit), ``decoded_sha256`` and, if
    asked for, ``ids`` (binary) and ``decoded``. A null text is empty. Other
    columns of ``docs`` are not read.
    """

    def run(batches):
        encode, decoder = _worker(path, pattern)
        for batch in batches:
            texts, rows = batch.column(1), []
            for k in range(batch.num_rows):
                ids = encode(texts[k].as_py() or "")
                seq = np.frombuffer(ids, "<u4")
                sha, parts = hashlib.sha256(), []
                for part in (*(decoder.feed(seq[a:a + chunk]) for a in range(0, len(seq), chunk)), decoder.finish()):
                    sha.update(part)
                    if with_values:
                        parts.append(part)
                rows.append((len(seq), hashlib.sha256(ids).hexdigest(), sha.hexdigest(),
                             ids if with_values else None,
                             b"".join(parts).decode("utf-8", "replace") if with_values else None))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, "
                         "decoded string")
    return out if with_values else out.drop("ids", "decoded")
