"""Best-fit packing of token sequences with swap-based local search.

Documents are tokenized where they lie; only the sizes of their pieces move on.
The pieces are dealt in equal parts to as many tasks as their number asks for.
Each task packs its part by best fit, longest first, then improves the bins
that are still underfull: documents move, swap one for one or two for one
between two bins whenever that raises the sum of squared fills, until the
emptied bins drop out. What the tasks leave in underfull bins is dealt and
packed again together, round by round, until one round is a single task's part
or leaves more than half of its documents in underfull bins.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespark.session import cut_lineage

from .pretokens import ChunkMemo

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class BpeEncoder:
    """Ids of whole texts, equal to those of the tokenizer file ``json_path``.

    ``rank_path`` holds the same vocabulary as ranks, which encode faster; a
    text that spells one of the file's added tokens goes through the file's
    tokenizer itself.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(json_path)
        added = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._memo = ChunkMemo(lambda s: np.array(self._core.encode_ordinary(s), dtype="<u4").tobytes())

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self._added is not None and self._added.search(text):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self._memo(text)


_ENCODERS: dict[tuple, BpeEncoder] = {}


def _encoder(*key) -> BpeEncoder:
    """One encoder for each Python worker."""
    if key not in _ENCODERS:
        _ENCODERS[key] = BpeEncoder(*key)
    return _ENCODERS[key]


def pieces(docs: DataFrame, json_path: str, rank_path: str, pattern: str, capacity: int = 1024, end_id: int = 2,
           with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document's token sequence.

    A document is its text's ids and then ``end_id``; a null text is empty.
    Sequences longer than ``capacity`` are cut into pieces of ``capacity``
    ids, of which the first may be shorter. ``ids`` are little-endian
    unsigned 32-bit.
    """

    def run(batches):
        encode = _encoder(json_path, rank_path, pattern).encode
        last = int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1), []
            for k, doc_id in enumerate(ids):
                seq = encode(texts[k].as_py() or "") + last
                n = len(seq) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = seq[4 * a:4 * b]
                    rows.append((doc_id, p, a, b - a, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                                                       pa.binary()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, PIECES)
    return out if with_ids else out.drop("ids")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin it fits."""
    bins, by_room = [], [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, full: float = 0.995, rounds: int = 20,
                 partners: int = 32) -> list[list[int]]:
    """Raise the sum of squared fills by moves, 1-1 and 2-1 swaps between underfull bins; drop emptied ones.

    Bins filled below ``full`` are underfull. Each step takes from an emptier
    bin what makes a fuller one fuller still without overflow, which raises
    the squared sum; every bin tries the ``partners`` emptiest ones. It is done
    when a round finds no step.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(rounds):
        order = sorted((b for b in range(len(bins)) if 0 < fill[b] < full * capacity), key=lambda b: -fill[b])
        better = False
        for k, into in enumerate(order):
            for other in reversed(order[max(k + 1, len(order) - partners):]):
                while 0 < fill[other] <= fill[into] < capacity and _step(bins, fill, size, into, other, capacity):
                    better = True
        if not better:
            break
    return [b for b in bins if b]


def _step(bins, fill, size, full, other, capacity) -> bool:
    """The step between two bins that fills ``full`` most; false if none does."""
    room = capacity - fill[full]
    give = sorted((size[i], i) for i in bins[full])
    take = sorted((size[i], i) for i in bins[other])
    sizes = [s for s, _ in take]
    best, plan = 0, None
    at = bisect.bisect_right(sizes, room) - 1
    if at >= 0 and sizes[at] > best:                      # move
        best, plan = sizes[at], ([], [take[at][1]])
    outs = [(s, [i]) for s, i in give] + [(s + t, [i, j]) for x, (s, i) in enumerate(give) for t, j in give[x + 1:]]
    for s, out in outs:                                   # one or two for one
        at = bisect.bisect_right(sizes, room + s) - 1
        if at >= 0 and sizes[at] - s > best:
            best, plan = sizes[at] - s, (out, [take[at][1]])
    for x, (s, i) in enumerate(take):                     # one for two
        for t, j in take[x + 1:]:
            for g, o in give:
                if best < s + t - g <= room:
                    best, plan = s + t - g, ([o], [i, j])
    if plan is None:
        return False
    out, take_in = plan
    gone, come = set(out), set(take_in)
    bins[full] = [i for i in bins[full] if i not in gone] + take_in
    bins[other] = [i for i in bins[other] if i not in come] + out
    fill[full] += best
    fill[other] -= best
    return True


def _pack_round(items: DataFrame, n_tasks: int, capacity: int, base: int, full: float) -> DataFrame:
    """``items`` with ``sequence_id``, ``offset`` and ``done`` (their bin is filled to ``full`` or more)."""
    schema = items.schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def run(frames):
        frames = list(frames)
        if not sum(map(len, frames)):
            return
        part = pd.concat(frames, ignore_index=True)
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = part["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity, full)
        seq, off, done = (np.zeros(len(part), dtype=t) for t in ("int64", "int64", "bool"))
        first = base + (TaskContext.get().partitionId() << 24)
        for k, b in enumerate(bins):
            ends = np.cumsum(lengths[b])
            seq[b], off[b], done[b] = first + k, ends - lengths[b], ends[-1] >= full * capacity
        yield part.assign(sequence_id=seq, offset=off, done=done)

    return items.repartition(n_tasks).mapInPandas(run, f"{schema}, sequence_id long, offset long, done boolean")


def pack(items: DataFrame, capacity: int = 1024, part_rows: int = 20_000, full: float = 0.995,
         max_rounds: int = 4) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    ``items`` needs ``doc_id``, ``piece``, ``ids_crc32`` and ``length`` (1 to
    ``capacity``); other columns ride along. Rows need no key: repeated rows
    are separate items. ``part_rows`` bounds a task's items, and the number of
    tasks follows the number of items. No items give no rows.
    """
    left, out = cut_lineage(items), None
    n = left.count()
    for k in range(max_rounds):
        n_tasks = max(1, -(-n // part_rows))
        packed = cut_lineage(_pack_round(left, n_tasks, capacity, (k + 1) << 48, full))
        rest = packed.where(~F.col("done"))
        m = rest.count() if n_tasks > 1 and k + 1 < max_rounds else 0
        again = 0 < m <= n / 2
        closed = packed.where("done") if again else packed
        out = closed if out is None else out.unionByName(closed)
        if not again:
            break
        left, n = rest.drop("sequence_id", "offset", "done"), m
    return out.drop("done")
