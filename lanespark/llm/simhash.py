"""SimHash near-duplicates by a segment-popcount embedding.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles. Fingerprints link when they differ in at most ``max_bits``
bits. Candidates come from an embedding into per-segment bit counts: cut the
64 bits into 32 segments of two bits and count the ones of each. The Manhattan
distance of two such count vectors never exceeds the Hamming distance of the
fingerprints, so every linked pair is within ``max_bits`` of each other there.
The vectors are cut into two halves of 16 segments; one half is then within
``max_bits // 2``. The grid join finds those: each fingerprint visits the cells
(exact half vectors) within half that radius of its own, rounded up, and two
half vectors within the radius always meet in a common cell. Fingerprints are
dealt to cells, and those that meet are verified inside the task by the exact
Hamming distance; only edges that span the linked groups leave it, so what comes
out grows with the fingerprints, not with their pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespark.session import cut_lineage

from .common import components, is_empty, stored, without

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LANES = np.uint64(0x0101010101010101)
_EVERY_OTHER = 0x55555555


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text (0 without words)."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        hashes = [digest(join(words), seed)]
    else:
        hashes = [digest(join(words[i:i + shingle]), seed) for i in range(len(words) - shingle + 1)]
    h = np.array(hashes, dtype=np.uint64)
    starts = np.arange(0, len(h), 255)  # a byte lane can count to 255
    counts = np.stack([np.add.reduceat((h >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
                       .sum(axis=0, dtype=np.int64) for k in range(8)])
    ones = 2 * counts > len(h)  # [bit in byte, byte]
    return sum(1 << (8 * int(b) + int(k)) for k, b in zip(*np.nonzero(ones)))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, fp)`` per document; ``fp`` is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


def segment_counts(half) -> F.Column:
    """16 two-bit segment counts of 32 fingerprint bits, packed in a long."""
    mask = F.lit(_EVERY_OTHER)
    return half.bitwiseAND(mask) + F.shiftright(half, 1).bitwiseAND(mask)


def _cells(counts, radius: int):
    """Half vectors (32 bits in a long) within Manhattan distance ``radius`` of ``counts``, itself included."""
    cells = F.array(counts)
    digit = lambda x, i: F.shiftright(x, 2 * i).bitwiseAND(F.lit(3))
    steps = [(i, up) for i in range(16) for up in (True, False)]
    for _ in range(radius):
        def around(x):
            moves = [F.when(digit(x, i) < 2, x + F.lit(1 << 2 * i)) if up else
                     F.when(digit(x, i) > 0, x - F.lit(1 << 2 * i)) for i, up in steps]
            return F.array(x, *moves)
        cells = F.array_distinct(F.array_compact(F.flatten(F.transform(cells, around))))
    return cells


def _cell_id(half, cell):
    """One long for a half (0 or 1) and its 32-bit cell."""
    return F.shiftleft(half.cast("long"), 32).bitwiseOR(cell)


def _crowds(own: DataFrame, radius: int, block_rows: int) -> DataFrame:
    """``(crowded, blocks)`` of the cells that more than ``block_rows`` fingerprints may visit.

    A cell's visitors come from the own cells around it, at most ``around`` of
    them. Own cells of up to ``block_rows / around`` fingerprints bring at most
    ``block_rows`` together, so only the greater ones are summed.
    """
    around = 33 ** radius
    heavy = own.groupBy("half", "v").agg(F.count("*").alias("n")).where(F.col("n") * around > block_rows)
    visited = heavy.select(F.explode(F.transform(_cells(F.col("v"), radius), lambda c: _cell_id(F.col("half"), c)))
                           .alias("crowded"), "n")
    return visited.groupBy("crowded").agg((F.ceil(F.sum("n") / block_rows) + 1).cast("int").alias("blocks"))


def _cell_links(max_bits: int, chunk_rows: int = 200_000, held_pairs: int = 1_000_000):
    """Task over visits sorted by cell and tile: edges (a fingerprint, the least one it is linked with)."""

    def spanning(a: np.ndarray, b: np.ndarray, m: int):
        label = np.arange(m)
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for at in (a, b, label[a], label[b]):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == label).all():
                node = np.nonzero(label != np.arange(m))[0]
                return node, label[node]
            label = new

    def edges(cell, tile, fp):
        names, code = np.unique(fp, return_inverse=True)
        got, held = [np.zeros((2, 0), np.int64)], 0
        live, step = np.arange(len(fp)), 0
        while len(live):
            step += 1
            live = live[live + step < len(fp)]
            other = live + step
            same = (cell[live] == cell[other]) & (tile[live] == tile[other])
            live, other = live[same], other[same]     # a cell's rows are neighbours in the order
            near = np.bitwise_count(fp[live] ^ fp[other]) <= max_bits
            got.append(np.stack([code[live[near]], code[other[near]]]))
            held += int(near.sum())
            if held > held_pairs:
                got, held = [np.stack(spanning(*np.concatenate(got, axis=1), len(names)))], 0
        node, root = spanning(*np.concatenate(got, axis=1), len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[node].view(np.int64)), pa.array(names[root].view(np.int64))],
                                          names=["src", "dst"])

    def run(batches):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            cols[2] = cols[2].view(np.uint64)
            kept = [np.concatenate(c) for c in zip(kept, cols)]
            if len(kept[0]) >= chunk_rows:
                last = np.nonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]))[0]
                cut = int(last[-1]) + 1 if len(last) else 0
                yield edges(*[c[:cut] for c in kept])
                kept = [c[cut:] for c in kept]
        yield edges(*kept)

    return run


def links(fps: DataFrame, max_bits: int = 4, block_rows: int = 1024) -> DataFrame:
    """Edges ``(src, dst)`` between distinct fingerprints that connect all pairs at most ``max_bits`` bits apart.

    ``fps`` has one row per distinct fingerprint in ``fp``. Every fingerprint is
    dealt to the cells it visits; the members of a cell are compared inside the
    task, all with all. A crowded cell is cut into blocks of about
    ``block_rows``, and each pair of blocks is a tile of its own. A task returns
    at most one edge a fingerprint and chunk of its rows, never the pairs: all
    its links lie within the connected groups that the edges span.
    """
    reach = max_bits // 2            # one half is this near
    radius = (reach + 1) // 2        # and meets in a cell within this radius of either
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    own = fps.select("fp", F.explode(F.array(
        *[F.struct(F.lit(k).alias("half"), segment_counts(bits).alias("v")) for k, bits in enumerate((low, high))]))
        .alias("h")).select("fp", "h.half", "h.v")
    visits = own.select("fp", F.explode(F.transform(_cells(F.col("v"), radius), lambda c: _cell_id(F.col("half"), c)))
                        .alias("cell"))
    crowds = stored(_crowds(own, radius, block_rows))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.least(o, block) * F.col("blocks") + F.greatest(o, block)))
    dealt = visits.join(crowds, F.col("cell") == F.col("crowded"), "left") \
        .select("cell", F.explode(tiles).alias("tile"), "fp")
    return dealt.repartition("cell", "tile").sortWithinPartitions("cell", "tile") \
        .mapInArrow(_cell_links(max_bits), "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per document.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits; equal fingerprints are at distance zero. A
    null or wordless text has fingerprint zero and links like any other.
    Repeated rows keep one output row each; rows with a null id take part with
    a null id and never name a component (a component of only null ids is
    null). Other columns of ``docs`` are not read.
    """
    fps = cut_lineage(fingerprints(docs, shingle, seed, id_col, text_col))
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = components(links(classes.select("fp"), max_bits))
    linked = classes.join(comp, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    linked = cut_lineage(linked)
    first = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(linked.join(first.withColumnRenamed("component", "c"), F.col("component") == F.col("c"))
                        .select("fp", "component_id"))
    return fps.join(named.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row for each component: the one with the smallest id (all columns kept).

    If rows repeat a kept id, any one of them stays. Rows with a null id stay.
    """
    found = cut_lineage(near_duplicates(docs, shingle, max_bits, seed).groupBy("doc_id", "component_id")
                        .agg((F.count("*") > 1).alias("repeated")))
    out = without(docs, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    repeated = found.where(F.col("repeated") & (F.col("doc_id") == F.col("component_id"))).select("doc_id")
    if is_empty(repeated):
        return out
    once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return without(out, repeated).unionByName(once)
