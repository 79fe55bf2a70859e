"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of lower-cased words (each with the one
separator that ends it) forwards and backwards, gives every byte position a
probability for each language, and a document's probabilities are the means
over all its positions. The state starts anew at each word, so the sums over a
word's positions depend on the word alone: a task runs every distinct word once
and weights it by its count. Trained in numpy by backpropagation through time
on words of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LETTER = regex.compile(r"\p{L}")      # Unicode category L: no digits, fractions, circled or superscript numbers
#: Longer words are read in windows of this many bytes, in training as in prediction.
WINDOW = 32


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class ByteBiGRU:
    """Weights of one network; ``langs`` are the labels of its outputs."""

    langs: list[str]
    hidden: int = 16
    seed: int = 0
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.w:
            rng, h, k = np.random.default_rng(self.seed), self.hidden, len(self.langs)
            for d in ("f", "b"):
                self.w["x" + d] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
                self.w["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 2 * h)).astype(np.float32)
                self.w["v" + d] = rng.normal(0, 1 / np.sqrt(h), (h, h)).astype(np.float32)
                self.w["c" + d] = np.zeros(h, np.float32)
            self.w["o"] = rng.normal(0, 1 / np.sqrt(h), (2 * h, k)).astype(np.float32)
            self.w["p"] = np.zeros(k, np.float32)

    def _run(self, d, ids, mask, keep):
        """States of one direction, (time, batch, hidden), and what backpropagation needs."""
        w, h = self.w, self.hidden
        steps, n = ids.shape
        out, saved = np.zeros((steps, n, h), np.float32), [None] * steps
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = w["x" + d][ids[t]]
            gates = _sigmoid(x[:, :2 * h] + state @ w["u" + d])
            z, r = gates[:, :h], gates[:, h:]
            inner = state @ w["v" + d] + w["c" + d]
            new = np.tanh(x[:, 2 * h:] + r * inner)
            m = mask[t][:, None]
            nxt = state + m * (1 - z) * (new - state)
            if keep:
                saved[t] = (state, z, r, inner, new, m)
            out[t] = state = nxt
        return out, saved

    def positions(self, ids, mask, keep=False):
        """Language probabilities of every position, (time, batch, languages)."""
        f, sf = self._run("f", ids, mask, keep)
        b, sb = self._run("b", ids, mask, keep)
        both = np.concatenate([f, b], axis=2)
        logit = both @ self.w["o"] + self.w["p"]
        logit -= logit.max(axis=2, keepdims=True)
        e = np.exp(logit)
        return e / e.sum(axis=2, keepdims=True), (both, sf, sb)

    def gradients(self, ids, mask, labels):
        """Mean cross-entropy over positions and its gradients by backpropagation through time."""
        h, steps = self.hidden, ids.shape[0]
        prob, (both, sf, sb) = self.positions(ids, mask, keep=True)
        n = mask.sum()
        picked = np.take_along_axis(prob, np.broadcast_to(labels[None, :, None], (*ids.shape, 1)), 2)[..., 0]
        loss = -(np.log(picked + 1e-9) * mask).sum() / n
        d_logit = prob.copy()
        np.put_along_axis(d_logit, np.broadcast_to(labels[None, :, None], (*ids.shape, 1)), picked[..., None] - 1, 2)
        d_logit *= (mask / n)[..., None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"] = np.einsum("tnh,tnk->hk", both, d_logit, optimize=True)
        g["p"] = d_logit.sum(axis=(0, 1))
        d_both = d_logit @ self.w["o"].T
        for d, saved, d_out in (("f", sf, d_both[..., :h]), ("b", sb, d_both[..., h:])):
            u, v = self.w["u" + d], self.w["v" + d]
            d_x = np.zeros((*ids.shape, 3 * h), np.float32)
            carry = np.zeros((ids.shape[1], h), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                state, z, r, inner, new, m = saved[t]
                total = d_out[t] + carry
                d_new = total * m * (1 - z) * (1 - new * new)
                d_z = total * m * (state - new) * z * (1 - z)
                d_inner = d_new * r
                d_r = d_new * inner * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], axis=1)
                d_x[t, :, :2 * h], d_x[t, :, 2 * h:] = d_gates, d_new
                g["u" + d] += state.T @ d_gates
                g["v" + d] += state.T @ d_inner
                g["c" + d] += d_inner.sum(axis=0)
                carry = total * (1 - m * (1 - z)) + d_gates @ u.T + d_inner @ v.T
            one_hot = np.zeros((ids.size, 256), np.float32)
            one_hot[np.arange(ids.size), ids.ravel()] = 1
            g["x" + d] = one_hot.T @ d_x.reshape(-1, 3 * h)
        return loss, g

    def word_sums(self, words: list[str], chunk: int = 4096) -> np.ndarray:
        """For each word the sums of its positions' probabilities and their number, (words, languages + 1)."""
        runs, owner = [], []
        for i, word in enumerate(words):
            here = windows(word)
            runs += here
            owner += [i] * len(here)
        out = np.zeros((len(words), len(self.langs) + 1), np.float64)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for a in range(0, len(order), chunk):
            part = order[a:a + chunk]
            ids, mask = pad([runs[i] for i in part])
            prob, _ = self.positions(ids, mask)
            sums = np.einsum("tnk,tn->nk", prob, mask, optimize=True)
            np.add.at(out, [owner[i] for i in part], np.concatenate([sums, mask.sum(axis=0)[:, None]], axis=1))
        return out


def pad(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, batch) and their mask."""
    steps = max(map(len, runs))
    ids = np.frombuffer(b"".join(r.ljust(steps, b"\0") for r in runs), np.uint8).reshape(len(runs), steps).T
    mask = (np.arange(steps)[:, None] < np.array([len(r) for r in runs])).astype(np.float32)
    return ids, mask


def windows(word: str) -> list[bytes]:
    """The bytes of a word and its separator, in stretches of ``WINDOW`` bytes (the last may be shorter)."""
    b = word.encode("utf-8", "surrogatepass") + b" "
    return [b[a:a + WINDOW] for a in range(0, len(b), WINDOW)]


def words_of(text: str) -> Counter:
    return Counter(text.lower().split())


def fit(samples: list[tuple[str, str]], hidden: int = 16, steps: int = 220, batch: int = 128, rate: float = 0.03,
        seed: int = 0) -> ByteBiGRU:
    """Train on ``(text, lang)`` pairs. Languages have equal weight; a word counts as often as it occurs."""
    by_lang: dict[str, Counter] = {}
    for text, lang in samples:
        by_lang.setdefault(lang, Counter()).update(words_of(text))
    by_lang = {k: c for k, c in sorted(by_lang.items()) if c}
    net = ByteBiGRU(list(by_lang), hidden, seed)
    if len(by_lang) < 2:
        return net
    rng = np.random.default_rng(seed)
    pools = []
    for c in by_lang.values():
        runs = [(r, c[w]) for w in sorted(c) for r in windows(w)]
        counts = np.array([n for _, n in runs], float)
        pools.append(([r for r, _ in runs], np.cumsum(counts) / counts.sum()))
    m1 = {k: np.zeros_like(v) for k, v in net.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(pools), batch)
        runs = [pools[k][0][min(int(np.searchsorted(pools[k][1], u)), len(pools[k][0]) - 1)]
                for k, u in zip(labels, rng.random(batch))]
        ids, mask = pad(runs)
        _, g = net.gradients(ids, mask, labels)
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in net.w:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            up = lr * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-7)
            net.w[k] = (net.w[k] - up).astype(np.float32)
    return net


def held_out(id_col) -> F.Column:
    """The held-out quarter: crc32 of the id's text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = 150) -> list[tuple[str, str]]:
    """About ``per_lang`` labelled documents of each language, picked by a hash of the text; none held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    picked = known.where(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
    return sorted((r["text"], r["lang"]) for r in picked.collect())


def predict(docs: DataFrame, net: ByteBiGRU, keep: list[str] | None = None, memo: int = 150_000) -> DataFrame:
    """``lang_pred`` and ``score`` of every text, with the columns ``keep`` of ``docs`` (default: doc_id).

    A text that is null or has no letter gets ``und`` and score 0, and so does
    any text when no language was learned.
    """
    keep = ["doc_id"] if keep is None else keep
    langs, weights, hidden = net.langs, net.w, net.hidden

    def run(batches):
        model = ByteBiGRU(langs, hidden, w=weights)
        seen: dict[str, int] = {}
        table = np.zeros((0, len(langs) + 1))
        for batch in batches:
            n = batch.num_rows
            pred, score = ["und"] * n, np.zeros(n)
            texts = batch.column(batch.num_columns - 1)
            for a in range(0, n, 500):
                if len(seen) > memo:
                    seen.clear()
                    table = table[:0]
                docs_here, new = [], []
                for i in range(a, min(n, a + 500)):
                    text = texts[i].as_py()
                    if text is None or not langs or not _LETTER.search(text):
                        continue
                    counts = words_of(text)
                    codes = []
                    for word in counts:
                        code = seen.get(word)
                        if code is None:
                            code = seen[word] = len(seen)
                            new.append(word)
                        codes.append(code)
                    docs_here.append((i, np.array(codes), np.fromiter(counts.values(), float, len(codes))))
                if new:
                    table = np.concatenate([table, model.word_sums(new)])
                for i, codes, counts in docs_here:
                    total = counts @ table[codes]
                    p = total[:-1] / total[-1]
                    best = int(p.argmax())
                    pred[i], score[i] = langs[best], min(1.0, float(p[best]))
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(pred, pa.string()), pa.array(score)],
                names=[*[f"c{k}" for k in range(len(cols))], "lang_pred", "score"])

    given = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").cast("string").alias("t"))
    types = ", ".join(f"c{k} {given.schema[k].dataType.simpleString()}" for k in range(len(keep)))
    out = given.mapInArrow(run, f"{types}, lang_pred string, score double")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score")


def least_score(languages: int) -> float:
    """The score that a clean document reaches: a fifteenth of the way from chance (1 / languages) to certainty.

    The greatest of k probabilities is at least 1 / k, so the bound follows the number of learned languages.
    """
    chance = 1 / max(1, languages)
    return chance + (1 - chance) / 15


def accepted(docs: DataFrame, net: ByteBiGRU, least: float) -> DataFrame:
    """The documents, all columns, whose text has a learned language with a score of ``least`` or more."""
    found = predict(docs, net, [*docs.columns])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*docs.columns)
