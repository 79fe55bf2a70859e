"""Periodic runs of words by a suffix automaton with link-cut access.

Words are appended one by one to a suffix automaton. Its suffix links form a
tree that a link-cut forest holds: a preferred path is a stretch of states
whose strings last ended at the same word, its colour. Appending word i
accesses the new state: the path to the root is taken over segment by segment
and recoloured i. A segment of colour e, entered at a state of length m, says
that the last m words ended at e before; if the distance p = i - e is at most
m, the last m + p words are a square (or more) of smallest period p. It is
extended to the right by comparing words and is a run; later squares of the
same period up to that end belong to it.

Only islands go through the automaton: words of a document that repeated
stretches of ``half`` words cover. A run of at least ``2 * half`` words repeats
such a stretch at the distance of its period, and those stretches cover it, so
each run lies within one island and none is lost.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def squares_to_runs(words: list, least: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``max(least, 2 * period)`` words."""
    n = len(words)
    length, link, arcs = [0], [-1], [{}]
    left, right, up, seen = [0], [0], [0], [0]      # splay trees of the preferred paths; node 0 is none (the root)
    ends: dict[int, int] = {}
    runs = []

    def new(size, to, out):
        length.append(size)
        link.append(to)
        arcs.append(out)
        left.append(0)
        right.append(0)
        up.append(0)
        seen.append(0)
        return len(length) - 1

    def splay(x):
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                top = up[g]
                if left[g] == p:
                    if left[p] == x:
                        b, c = right[p], right[x]
                        left[g], right[p], left[p], right[x] = b, g, c, p
                        up[g], up[p] = p, x
                        if b:
                            up[b] = g
                        if c:
                            up[c] = p
                    else:
                        b, c = left[x], right[x]
                        right[p], left[g], left[x], right[x] = b, c, p, g
                        up[p] = up[g] = x
                        if b:
                            up[b] = p
                        if c:
                            up[c] = g
                elif right[p] == x:
                    b, c = left[p], left[x]
                    right[g], left[p], right[p], left[x] = b, g, c, p
                    up[g], up[p] = p, x
                    if b:
                        up[b] = g
                    if c:
                        up[c] = p
                else:
                    b, c = left[x], right[x]
                    right[g], left[p], left[x], right[x] = b, c, g, p
                    up[g] = up[p] = x
                    if b:
                        up[b] = g
                    if c:
                        up[c] = p
                seen[x] = seen[g]       # the colour is kept at the root of the splay tree
                if top:
                    if left[top] == g:
                        left[top] = x
                    elif right[top] == g:
                        right[top] = x
                up[x] = top
            else:
                if left[p] == x:
                    b = right[x]
                    left[p], right[x] = b, p
                else:
                    b = left[x]
                    right[p], left[x] = b, p
                if b:
                    up[b] = p
                up[p], up[x] = x, g
                seen[x] = seen[p]
            p = up[x]

    last = 0
    for i, word in enumerate(words):
        cur = new(i + 1, 0, {})
        p = last
        while p >= 0 and word not in arcs[p]:
            arcs[p][word] = cur
            p = link[p]
        if p >= 0:
            to = arcs[p][word]
            if length[p] + 1 != length[to]:
                clone = new(length[p] + 1, link[to], arcs[to].copy())
                while p >= 0 and arcs[p].get(word) == to:
                    arcs[p][word] = clone
                    p = link[p]
                link[to] = clone
                splay(to)       # the clone comes right above it, on the same path
                above = left[to]
                left[clone] = above
                if above:
                    up[above] = clone
                left[to], up[clone] = clone, to
                to = clone
            link[cur] = up[cur] = to
        last = below = cur
        v = up[cur]
        while v:
            splay(v)
            period = i - seen[v]
            if period <= length[v] and ends.get(period, -1) < i:
                start, end = i + 1 - length[v] - period, i + 1
                while end < n and words[end] == words[end - period]:
                    end += 1
                ends[period] = end - 1
                if end - start >= max(least, 2 * period):
                    runs.append((start, end - start, period))
            deeper = right[v]
            if deeper:
                seen[deeper] = seen[v]
            right[v] = below
            below, v = v, up[v]
        seen[below] = i
    return runs


def islands(words: list, half: int) -> list[tuple[int, int]]:
    """Stretches ``[a, b)`` that repeated windows of ``half`` words cover (told by 64-bit hashes: never too few)."""
    n = len(words) - half + 1
    if n < 2:
        return []
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    one = (one ^ (one >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n, np.uint64)
    for k in range(half):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + one[k:k + n]
        h ^= h >> np.uint64(29)
    order = np.sort(h)
    if (order[1:] != order[:-1]).all():
        return []
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.nonzero(again)[0]
    cut = np.nonzero(np.diff(at) > half)[0]
    return [(int(at[a]), int(at[b]) + half) for a, b in zip(np.r_[0, cut + 1], np.r_[cut, len(at) - 1])]


def find_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of at least ``max(least, 2 * period)`` words, by start, then period."""
    found = []
    for a, b in islands(words, least // 2):
        if b - a >= least:
            found += [(a + s, size, p) for s, size, p in squares_to_runs(words[a:b], least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        cover[start + period] += 1
        cover[start + size] -= 1
    return [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]


def runs(docs: DataFrame, least: int = 12, rewrite=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, n_words, runs, collapsed)`` per row of ``docs``.

    ``runs`` are structs ``start, length, period`` by start, then period;
    ``collapsed`` is the text with every repetition of a run dropped, words
    joined by one space. ``rewrite(doc_id, words)``, if given, replaces a
    document's words before. A null or wordless text has no runs and an empty
    collapsed text; null and repeated ids keep one row each. Other columns are
    not read.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, n, found, left = batch.column(0).to_pylist(), [], [], []
            for doc_id, text in zip(ids, batch.column(1)):
                words = _WORDS.findall(text.as_py() or "")
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                here = find_runs(words, least)
                n.append(len(words))
                found.append([{"start": s, "length": k, "period": p} for s, k, p in here])
                left.append(" ".join(collapse(words, here)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(left, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                         "collapsed string")
