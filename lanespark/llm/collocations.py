"""Phrase collocations by weighted acyclic automata.

A shard (half a million words of one language) sorts its n-grams and builds
a count transducer from them in that order: a state is added wherever an
n-gram leaves the path of the one before, an arc carries the count of the
words on the path to its end, and states with equal right parts are merged.
Every transducer is cut at prefix ranges and travels to the range's task, which
unites all shards' automata and sums the weights of equal paths. Totals below
the least count go, and none of their longer n-grams was worth a state: pairs
are counted only of words that are frequent enough, longer n-grams only of such
pairs (told by a hashed bit table of fixed size, which can only keep too much).
For the parts of a cut phrase, the wanted parts form an acceptor that is
composed with the ranges' total transducers.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanespark.session import cut_lineage

from .common import stored

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of a shard, and about as many of a range: a task holds a shard of each language, or one range.
SHARD_WORDS = 500_000
RANGE_WORDS = 1_000_000
#: Arcs that a batch of pieces may gather before it leaves the task.
BATCH_ARCS = 200_000
#: Asked parts that one task looks up.
ASK_ROWS = 50_000


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Transducer:
    """Deterministic acyclic automaton over words, with a count on every arc.

    ``words`` are sorted byte strings. ``levels[d]`` holds the arcs from states
    of depth d as arrays ``(source, label, weight, target)``, sorted by source
    and label; states are numbered within their depth, the root is 0. As a
    tree every arc has a target of its own (its index); in minimal form states
    of equal right parts are one.
    """

    def __init__(self, words: list, levels: list):
        self.words, self.levels = words, levels

    @classmethod
    def from_sorted(cls, words: list, rows: np.ndarray, counts: np.ndarray, least: int = 1) -> "Transducer":
        """From n-grams as rows of word numbers (-1 after the end) in sorted order; each row counts for all its
        prefixes of ``least`` words or more."""
        levels, state = [], np.zeros(len(rows), np.int64)
        alive = np.arange(len(rows))
        for d in range(rows.shape[1]):
            alive = alive[rows[alive, d] >= 0]
            source, label = state[alive], rows[alive, d].astype(np.int64)
            new = _first(source, label)
            at = np.nonzero(new)[0]
            if not len(at):
                break
            state[alive] = np.cumsum(new) - 1
            weight = np.add.reduceat(counts[alive], at) if d + 1 >= least else np.zeros(len(at), np.int64)
            levels.append((source[at], label[at], weight, np.arange(len(at))))
        return cls(words, levels)

    def minimal(self) -> "Transducer":
        """The same, with states of equal right parts merged from the ends towards the root."""
        out, kind = [], None
        for d in range(len(self.levels) - 1, -1, -1):
            source, label, weight, target = self.levels[d]
            target = np.zeros(len(target), np.int64) if kind is None else kind[target]
            n = len(self.levels[d - 1][0]) if d else 1
            start = np.searchsorted(source, np.arange(n + 1))
            size = np.diff(start)
            part = [x.astype(np.uint64) for x in (label, weight, target)]
            h = ((part[0] * _MIX ^ part[1]) * _MIX ^ part[2]) * _MIX
            h ^= h >> np.uint64(31)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _MIX, dtype=np.uint64)])
            sign = (sums[start[1:]] - sums[start[:-1]]) ^ (size.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            _, first, kind = np.unique(sign, return_index=True, return_inverse=True)
            # states that share a hash must share their arcs
            to = np.repeat(start[:-1][first][kind] - start[:-1], size) + np.arange(len(source))
            same = (size == size[first][kind]).all() and (to < len(source)).all() and all(
                (x[to] == x).all() for x in (label, weight, target))
            if not same:
                first = kind = np.arange(n)
            keep = np.zeros(n, bool)
            keep[first] = True
            arcs = keep[source]
            source, label, weight, target = kind[source[arcs]], label[arcs], weight[arcs], target[arcs]
            order = np.argsort(source, kind="stable")
            out.append(tuple(x[order] for x in (source, label, weight, target)))
        return Transducer(self.words, out[::-1])

    def tree(self) -> "Transducer":
        """The same as a tree (one state a path)."""
        levels, state = [], np.zeros(1, np.int64)
        for source, label, weight, target in self.levels:
            start, end = np.searchsorted(source, state), np.searchsorted(source, state, side="right")
            size = end - start
            arcs = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            levels.append((np.repeat(np.arange(len(state)), size), label[arcs], weight[arcs], np.arange(len(arcs))))
            state = target[arcs]
        return Transducer(self.words, levels)

    @staticmethod
    def union(parts: list["Transducer"]) -> "Transducer":
        """A tree of all parts' paths; weights of equal paths are summed."""
        words = sorted(set().union(*[p.words for p in parts]))
        code = {w: i for i, w in enumerate(words)}
        rename = [np.array([code[w] for w in p.words], np.int64) for p in parts]
        trees = [p.tree() for p in parts]
        states = [np.zeros(1, np.int64) for _ in parts]
        levels = []
        for d in range(max((len(t.levels) for t in trees), default=0)):
            have = [i for i, t in enumerate(trees) if d < len(t.levels)]
            source = np.concatenate([states[i][trees[i].levels[d][0]] for i in have])
            label = np.concatenate([rename[i][trees[i].levels[d][1]] for i in have])
            weight = np.concatenate([trees[i].levels[d][2] for i in have])
            order = np.argsort(source * len(words) + label, kind="stable")
            new = _first(source[order], label[order])
            at = np.nonzero(new)[0]
            merged = np.empty(len(order), np.int64)
            merged[order] = np.cumsum(new) - 1
            total = np.add.reduceat(weight[order], at) if len(at) else weight[:0]
            levels.append((source[order][at], label[order][at], total, np.arange(len(at))))
            cut = np.cumsum([len(trees[i].levels[d][0]) for i in have])[:-1]
            for i, m in zip(have, np.split(merged, cut)):
                states[i] = m
        return Transducer(words, levels)

    def paths(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of word numbers of all paths of ``length`` arcs of a tree, and their weights."""
        if length > len(self.levels):
            return np.zeros((0, length), np.int64), np.zeros(0, np.int64)
        at = np.arange(len(self.levels[length - 1][0]))
        columns = []
        for d in range(length - 1, -1, -1):
            columns.append(self.levels[d][1][at])
            at = self.levels[d][0][at]
        return np.stack(columns[::-1], axis=1), self.levels[length - 1][2]

    def compose(self, acceptor: "Transducer") -> list[np.ndarray]:
        """For every arc of the acceptor (a tree), by depth, the weight of the same path here, 0 if there is none."""
        code = {w: i for i, w in enumerate(self.words)}
        known = np.array([code.get(w, -1) for w in acceptor.words], np.int64)
        here, out = np.zeros(1, np.int64), []      # acceptor state -> own state, -1 if the path ended
        for d, (source, label, _, _) in enumerate(acceptor.levels):
            weight, to = np.zeros(len(source), np.int64), np.full(len(source), -1)
            if d < len(self.levels) and len(self.levels[d][0]):
                own = self.levels[d][0] * len(self.words) + self.levels[d][1]
                state, word = here[source], known[label]
                want = state * len(self.words) + word
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                hit = (state >= 0) & (word >= 0) & (own[at] == want)
                weight[hit], to[hit] = self.levels[d][2][at[hit]], self.levels[d][3][at[hit]]
            out.append(weight)
            here = to
        return out


def _rows(phrases: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """Words, sorted rows of word numbers, and the order of the phrases in them."""
    words = sorted({w for p in phrases for w in p})
    code = {w: i for i, w in enumerate(words)}
    width = max(map(len, phrases))
    rows = np.array([[code[w] for w in p] + [-1] * (width - len(p)) for p in phrases], np.int64)
    order = np.lexsort(rows.T[::-1])
    return words, rows[order], order


# ---- words of a shard -----------------------------------------------------------------------------------------
class _Shard:
    """Words of one language as numbers, -1 between pieces."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.n = 0

    def add(self, texts: list[bytes]) -> None:
        tokens = b"\n".join(texts + [b""]).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        d = pa.array(tokens, pa.binary()).dictionary_encode()
        here = d.dictionary.to_pylist()
        ids = self.ids
        to = np.array([-1 if w == b"\n" else -2 if w == b"" else ids.setdefault(w, len(ids)) for w in here], np.int64)
        codes = to[d.indices.to_numpy()]
        codes = codes[codes > -2]
        self.codes.append(codes.astype(np.int32))
        self.n += len(codes)

    def sorted(self) -> tuple[list[bytes], np.ndarray]:
        """Sorted words, and the text in their numbers."""
        words = sorted(self.ids)
        rank = np.empty(len(words) + 1, np.int64)
        rank[[self.ids[w] for w in words]] = np.arange(len(words))
        rank[-1] = -1
        return words, rank[np.concatenate(self.codes)]


def _shards(batches, shard_words: int, text_bytes: int = 2_000_000):
    """``(lang, words, codes)`` of the batches' texts, each shard of about ``shard_words`` words."""
    waiting: dict[str, list] = {}
    size: dict[str, int] = {}
    shards: dict[str, _Shard] = {}

    def flush(lang):
        shards.setdefault(lang, _Shard()).add(waiting.pop(lang))
        size.pop(lang)
        if shards[lang].n >= shard_words:
            return [(lang, *shards.pop(lang).sorted())]
        return []

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if text:
                waiting.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= text_bytes:
                    yield from flush(lang)
    for lang in list(waiting):
        yield from flush(lang)
    for lang, shard in shards.items():
        yield (lang, *shard.sorted())


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").cast("binary").alias("text"))


def vocabulary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(lang, word, f)``: how often each language has each word."""

    def count(batches):
        for lang, words, codes in _shards(batches, shard_words):
            f = np.bincount(codes[codes >= 0], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()),
                                              pa.array(f)], names=["lang", "word", "f"])

    return _texts(docs, text_col, lang_col).mapInArrow(count, "lang string, word string, f long") \
        .groupBy("lang", "word").agg(F.sum("f").alias("f"))


# ---- bit tables and prefix ranges ----------------------------------------------------------------------------
def _bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit table of 2**bits bits from a column ``h``; its size is fixed."""
    at = F.pmod(F.col("h"), F.lit(1 << bits)) + 1      # these functions count from 1
    rows = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")) \
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        a = (r["b"] - 1) * 4096
        table[a:a + len(part)] = part[:len(table) - a]
    return table


def _marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.int64) & (len(table) * 8 - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """As Spark's ``xxhash64(lang, word)``."""
    seed, digest = xxhash.xxh64_intdigest(lang.encode(), 42), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _MIX) ^ (b + np.uint64(0xD1B54A32D192ED03))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Ranges:
    """Prefix ranges: an n-gram belongs to the last cut ``(lang, word, second word)`` not above its first two words.

    Cuts come from a drawn list of words, in which a word of many occurrences
    is sure to be, so that ranges hold about ``range_words`` words each; a word
    that is greater is cut by its second word. Beyond ``most`` cuts each range
    is divided further by a hash of the two words.
    """

    def __init__(self, drawn: list[tuple[str, bytes, float]], total: int, range_words: int, most: int):
        n = max(1, min(most, -(-total // range_words)))
        self.parts = max(1, -(-total // (n * range_words)))
        step, have, self.cuts = total / n, 0.0, []
        drawn = sorted(drawn)
        by_lang: dict[str, list] = {}
        for lang, word, weight in drawn:
            by_lang.setdefault(lang, []).append((word, weight))
        for lang, word, weight in drawn:
            if have >= step:
                self.cuts.append((lang, word, b""))
                have = 0.0
            if weight >= 2 * step:
                second = by_lang[lang]
                run = np.cumsum([w for _, w in second])
                many = int(weight // step)
                at = np.searchsorted(run, run[-1] * np.arange(1, many) / many)
                self.cuts += sorted({(lang, word, second[i][0]) for i in at.tolist()})
                have = step
            else:
                have += weight
        self.cuts = sorted(set(self.cuts))

    def of(self, lang: str, words: list[bytes], hashes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Range numbers of prefixes given by word numbers; -1 for no second word."""
        a, b = bisect.bisect_left(self.cuts, (lang, b"", b"")), bisect.bisect_left(self.cuts, (lang + "\0", b"", b""))
        width, keys = len(words) + 1, []
        for _, w1, w2 in self.cuts[a:b]:
            k = bisect.bisect_left(words, w1)
            here = k < len(words) and words[k] == w1 and w2 != b""
            keys.append(k * width + (bisect.bisect_left(words, w2) + 1 if here else 0))
        cut = np.searchsorted(np.array(keys, np.int64), one * width + two + 1, side="right") + a
        if self.parts == 1:
            return cut
        second = np.where(two >= 0, hashes[np.maximum(two, 0)], np.uint64(0))
        return cut * self.parts + (_pair_hash(hashes[one], second) % np.uint64(self.parts)).astype(np.int64)


def prefix_ranges(words: DataFrame, total: int, range_words: int, most: int, seed: int = 5) -> Ranges:
    """Ranges from about 32 drawn words a range: a word is drawn by its hash in proportion to its count."""
    n = max(1, min(most, -(-total // range_words)))
    step = max(1.0, total / (32 * n))
    share = F.pmod(F.xxhash64("lang", "word", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = words.where(share < F.col("f") / F.lit(step)).collect()
    return Ranges([(r["lang"], r["word"].encode(), max(float(r["f"]), step)) for r in rows], total, range_words, most)


# ---- counting ------------------------------------------------------------------------------------------------
_PIECE = "lang string, range long, words binary, sizes array<int>, arcs binary"
_PIECE_ARROW = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("words", pa.binary()),
                          ("sizes", pa.list_(pa.int32())), ("arcs", pa.binary())])


def _packed(t: Transducer) -> tuple[bytes, list[int], bytes]:
    """Words, level sizes and arcs of a shard's piece for the shuffle, packed.

    A word has no line feed. Sources ascend within a level, so their steps are kept; numbers of one shard fit 32 bits,
    whose bytes are laid side by side.
    """
    words = b"\n".join(t.words)
    source, *others = (np.concatenate([x[k] for x in t.levels]) for k in range(4))
    arcs = np.stack([np.diff(source, prepend=0), *others]).astype("<i4")
    planes = np.ascontiguousarray(arcs.view(np.uint8).reshape(4, -1, 4).transpose(0, 2, 1))
    pack = lambda x: len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)
    return pack(words), [len(x[0]) for x in t.levels], pack(planes.tobytes())


def _unpacked(words: bytes, sizes: np.ndarray, arcs: bytes) -> Transducer:
    def plain(x):
        return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)

    planes = np.frombuffer(plain(arcs), np.uint8).reshape(4, 4, -1).transpose(0, 2, 1)
    columns = np.ascontiguousarray(planes).view("<i4").reshape(4, -1).astype(np.int64)
    columns[0] = np.cumsum(columns[0])
    ends = np.cumsum(sizes)[:-1]
    return Transducer(plain(words).split(b"\n"), list(zip(*[np.split(c, ends) for c in columns])))


def _cut(t: Transducer, r1: np.ndarray, r2: np.ndarray):
    """``(range, transducer)`` pieces of a tree; ``r1`` and ``r2`` are the ranges of its paths of one and two words.

    The weight of a single word goes to its own range alone; where only longer paths begin with it, it weighs 0.
    """
    n = len(t.levels[0][0])
    two = len(t.levels) > 1
    first = np.unique(np.concatenate([(r1 * n + np.arange(n))[t.levels[0][2] > 0],
                                      r2 * n + t.levels[1][0] if two else r2]))
    rng, node = first // n, first % n
    flat = [(rng, np.zeros(len(first), np.int64), t.levels[0][1][node],
             np.where(r1[node] == rng, t.levels[0][2][node], 0))]
    if two:
        above, place = r2, np.searchsorted(first, r2 * n + t.levels[1][0])
        for d in range(1, len(t.levels)):
            if d > 1:
                above, place = above[t.levels[d][0]], moved[t.levels[d][0]]
            order = np.argsort(above, kind="stable")
            flat.append((above[order], place[order], t.levels[d][1][order], t.levels[d][2][order]))
            moved = np.empty(len(order), np.int64)
            moved[order] = np.arange(len(order))
    for r in np.unique(rng):
        levels, base = [], 0
        for d, (where, source, label, weight) in enumerate(flat):
            a, b = np.searchsorted(where, r), np.searchsorted(where, r, side="right")
            if a == b:
                break
            levels.append((source[a:b] - base if d else source[a:b], label[a:b], weight[a:b], np.arange(b - a)))
            base = a
        used = np.unique(np.concatenate([x[1] for x in levels]))
        yield int(r), Transducer([t.words[i] for i in used.tolist()],
                                 [(s, np.searchsorted(used, x), w, g) for s, x, w, g in levels])


def _count(shortest: int, longest: int, shard_words: int, word_bits, pair_bits, ranges):
    """Task: the shards' transducers of ``shortest`` to ``longest`` words, cut at the ranges."""

    def _occurrences(words, codes, hashes):
        """Sorted n-grams of a shard that may be frequent, and how often each row stands for one."""
        good = np.append(_marked(word_bits.value, hashes), False)   # the last stands for -1
        keep = good[codes]
        n = len(codes)
        pair = keep & np.append(keep[1:], False)
        if longest > 2:
            at = np.nonzero(pair)[0]
            pair[at] = _marked(pair_bits.value, _pair_hash(hashes[codes[at]], hashes[codes[at + 1]]))
            at = np.nonzero(pair[:-1] & pair[1:])[0] if n > 1 else at[:0]
            rows = np.full((len(at), longest), -1, np.int32)
            rows[:, 0], on = codes[at], np.ones(len(at), bool)
            for k in range(1, longest):
                on &= pair[np.minimum(at + k - 1, n - 1)]
                rows[on, k] = codes[at[on] + k]
            rows = rows[np.lexsort(rows.T[::-1])]
            return rows, np.ones(len(rows), np.int64)
        at = np.nonzero(keep)[0]
        key = codes[at] * (len(words) + 1)
        two = pair[at]
        key[two] += codes[at[two] + 1] + 1
        key, times = np.unique(key, return_counts=True)
        return np.stack([key // (len(words) + 1), key % (len(words) + 1) - 1], axis=1), times

    def run(batches):
        for lang, words, codes in _shards(batches, shard_words):
            hashes = _word_hashes(lang, words)
            rows, times = _occurrences(words, codes, hashes)
            del codes
            if not len(rows):
                continue
            t = Transducer.from_sorted(words, rows, times, shortest)
            del rows, times
            one = t.levels[0][1]
            r1 = ranges.of(lang, words, hashes, one, np.full(len(one), -1))
            r2 = ranges.of(lang, words, hashes, one[t.levels[1][0]], t.levels[1][1]) if len(t.levels) > 1 else r1[:0]
            out: dict[str, list] = {c: [] for c in _PIECE_ARROW.names}
            arcs = 0
            for r, piece in _cut(t, r1, r2):
                packed = _packed(piece.minimal())
                for c, v in zip(out, (lang, r, *packed)):
                    out[c].append(v)
                arcs += sum(packed[1])
                if len(out["lang"]) >= 256 or arcs >= BATCH_ARCS:
                    yield pa.RecordBatch.from_pydict(out, schema=_PIECE_ARROW)
                    out, arcs = {c: [] for c in out}, 0
            if out["lang"]:
                yield pa.RecordBatch.from_pydict(out, schema=_PIECE_ARROW)

    return run


def _pieces(table: pa.Table) -> list[Transducer]:
    return [_unpacked(w.as_py(), n.values.to_numpy(), x.as_py())
            for w, n, x in zip(*[table.column(c) for c in ("words", "sizes", "arcs")])]


_COUNTS = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("words", pa.list_(pa.string())),
                     ("f", pa.int64()), ("h", pa.int64())])


def _unite(shortest: int, longest: int, least: int):
    """Task: the union of a range's transducers as rows of its n-grams of at least ``least`` occurrences."""

    def run(key, table):
        lang, rng = key[0].as_py(), key[1].as_py()
        t = Transducer.union(_pieces(table))
        names = pa.array(t.words, pa.binary()).cast(pa.string())
        parts = []
        for length in range(shortest, longest + 1):
            rows, f = t.paths(length)
            rows, f = rows[f >= least], f[f >= least]
            if not len(rows):
                continue
            if length == 2:
                used = np.unique(rows)
                h = _word_hashes(lang, [t.words[i] for i in used.tolist()])
                a, b = (h[np.searchsorted(used, rows[:, k])] for k in range(2))
                mark = _pair_hash(a, b).view(np.int64)
            else:
                mark = np.zeros(len(rows), np.int64)
            offsets = pa.array(np.arange(len(rows) + 1) * length, pa.int32())
            parts.append(pa.table([pa.array([lang] * len(rows)), pa.array(np.full(len(rows), rng)),
                                   pa.ListArray.from_arrays(offsets, names.take(pa.array(rows.ravel()))),
                                   pa.array(f), pa.array(mark)], schema=_COUNTS))
        return pa.concat_tables(parts) if parts else _COUNTS.empty_table()

    return run


def _lookup(key, asked, counts):
    """Task: composes the acceptor of the asked parts with the range's total transducer."""
    found = np.zeros(len(asked), np.int64)
    if len(asked) and len(counts):
        words, rows, order = _rows(counts["words"].to_pylist())
        totals, depth = counts["f"].to_numpy()[order], (rows >= 0).sum(axis=1) - 1
        t, end = Transducer.from_sorted(words, rows, np.zeros(len(rows), np.int64)), _ends(rows)
        for d in range(len(t.levels)):
            t.levels[d][2][end[depth == d]] = totals[depth == d]
        parts = asked["part"].to_pylist()
        accept_words, accept_rows, back = _rows(parts)
        acceptor = Transducer.from_sorted(accept_words, accept_rows, np.zeros(len(parts), np.int64))
        weights = t.compose(acceptor)
        end = _ends(accept_rows)
        depth = (accept_rows >= 0).sum(axis=1) - 1
        for d, w in enumerate(weights):
            at = depth == d
            found[back[at]] = w[end[at]]
    return asked.drop_columns(["range", "salt", "part"]).append_column("found", pa.array(found))


def _ends(rows: np.ndarray) -> np.ndarray:
    """For sorted rows, the arc (within its depth) of their transducer at which each row's path ends."""
    state = np.zeros(len(rows), np.int64)
    for d in range(rows.shape[1]):
        on = np.nonzero(rows[:, d] >= 0)[0]
        state[on] = np.cumsum(_first(state[on], rows[on, d])) - 1
    return state


def counts(docs: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang",
           shard_words: int = SHARD_WORDS, range_words: int = RANGE_WORDS, most_ranges: int = 16_384,
           filter_bits: int = 25) -> tuple[DataFrame, DataFrame, Ranges | None]:
    """``(lang, range, words, f)`` of all n-grams of up to ``longest`` words with at least ``least`` occurrences in
    their language, the languages' word totals ``(lang, n)``, and the ranges."""
    spark = docs.sparkSession
    words = cut_lineage(vocabulary(docs, text_col, lang_col, shard_words))
    n = cut_lineage(words.groupBy("lang").agg(F.sum("f").alias("n")))
    total = n.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], "lang string, range long, words array<string>, f long"), n, None
    ranges = prefix_ranges(words, total, range_words, most_ranges)
    # two bit tables of a fixed 2**filter_bits bits (4 MB each) go to all tasks
    word_bits = spark.sparkContext.broadcast(
        _bit_table(words.where(F.col("f") >= least).select(F.xxhash64("lang", "word").alias("h")), filter_bits))
    found, pair_bits = [], None
    for a, b in ((1, 2), (3, longest)):
        if a > longest:
            continue
        pieces = _texts(docs, text_col, lang_col).mapInArrow(
            _count(a, min(b, longest), shard_words, word_bits, pair_bits, ranges), _PIECE)
        part = cut_lineage(pieces.groupBy("lang", "range").applyInArrow(
            _unite(a, min(b, longest), least), "lang string, range long, words array<string>, f long, h long"))
        found.append(part.drop("h"))
        if b == 2:
            pair_bits = spark.sparkContext.broadcast(
                _bit_table(part.where(F.size("words") == 2).select("h"), filter_bits))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, n, ranges


def _parts_of(ranges: Ranges):
    """Task: both parts of every cut of a phrase, with the range that counts them."""
    schema = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("part", pa.list_(pa.string())),
                        ("phrase", pa.string()), ("a", pa.int64()), ("k", pa.int64()), ("rest", pa.bool_())])

    def run(batches):
        for batch in batches:
            asks: dict[str, list] = {}
            for lang, words, a in zip(*[batch.column(c).to_pylist() for c in ("lang", "words", "f")]):
                phrase = " ".join(words)
                for k in range(1, len(words)):
                    asks.setdefault(lang, []).append((words[:k], phrase, a, k, False))
                    asks[lang].append((words[k:], phrase, a, k, True))
            for lang, rows in asks.items():
                lead = [(r[0][0].encode(), r[0][1].encode() if len(r[0]) > 1 else None) for r in rows]
                words = sorted({w for pair in lead for w in pair if w is not None})
                code = {w: i for i, w in enumerate(words)}
                one = np.array([code[x] for x, _ in lead], np.int64)
                two = np.array([-1 if y is None else code[y] for _, y in lead], np.int64)
                where = ranges.of(lang, words, _word_hashes(lang, words), one, two)
                part, phrase, a, k, rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows)), pa.array(where), pa.array(part, pa.list_(pa.string())),
                     pa.array(phrase), pa.array(a, pa.int64()), pa.array(k, pa.int64()), pa.array(rest)], schema=schema)

    return run


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, covered_percent: int = 100, limit: int = 2000,
                 text_col: str = "text", lang_col: str = "lang", ask_rows: int = ASK_ROWS, **sizes) -> DataFrame:
    """``lang, rank, phrase, k, a, l, r, n, score``: each language's ``limit`` best phrases of 2 to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the parts before and after its
    lowest-scoring cut (after ``k`` words), ``n`` all words of the language;
    ``score = floor(1000 * a * n / (l * r))``, exact. A phrase goes if a longer
    one of at least ``least`` occurrences holds it and has ``covered_percent``
    per cent of its count or more. Order: score, then a, then phrase (bytes).
    A null language is ``und``, a null or empty text has no words, repeated
    rows count each time, an empty table gives no rows. Other columns are not
    read.
    """
    grams, n, ranges = counts(docs, longest, least, text_col, lang_col, **sizes)
    empty = "lang string, rank long, phrase string, k long, a long, l long, r long, n long, score long"
    if ranges is None:
        return docs.sparkSession.createDataFrame([], empty)
    phrases = grams.where(F.size("words") > 1)
    asked = phrases.select("lang", "words", "f").mapInArrow(
        _parts_of(ranges), "lang string, range long, part array<string>, phrase string, a long, k long, rest boolean")
    # a range that is asked for much answers in several tasks, each with a copy of its counts
    load = stored(asked.groupBy("lang", "range").agg(F.ceil(F.count("*") / ask_rows).cast("int").alias("salts")))
    asked = asked.join(load, ["lang", "range"]).withColumn(
        "salt", F.pmod(F.xxhash64("phrase", "k", "rest"), F.col("salts")).cast("int")).drop("salts")
    held = grams.join(load, ["lang", "range"]).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    known = asked.select("lang", "range", "salt", "part", "phrase", "a", "k", "rest").groupBy("lang", "range", "salt") \
        .cogroup(held.groupBy("lang", "range", "salt")).applyInArrow(
            _lookup, "lang string, phrase string, a long, k long, rest boolean, found long")
    cuts = known.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(~F.col("rest"), F.col("found"))).alias("l"),
                                                         F.max(F.when(F.col("rest"), F.col("found"))).alias("r"))
    wide = lambda c: f"cast({c} as decimal(18, 0))"  # noqa: E731  products pass 64 bits
    scored = cuts.join(n, "lang").withColumn(
        "score", F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")) \
        .select("lang", "phrase", "a", "n", "cut.*")
    size = F.size("words")
    inner = [F.when((size > m) & (size >= i + m - 1), F.array_join(F.slice("words", i, m), " "))
             for m in range(2, longest) for i in range(1, longest - m + 2)]
    if inner:
        longer = phrases.where(size > 2).select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), "f") \
            .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        best = best.join(longer, ["lang", "phrase"], "left").where(
            F.coalesce(F.lit(100) * F.col("longer") < F.lit(covered_percent) * F.col("a"), F.lit(True)))
    # first the best of 64 parts of a language, then of those
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = best.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= limit).select("lang", "rank", "phrase", "k", "a", "l", "r", "n", "score")
