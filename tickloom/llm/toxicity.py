"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly.

A word is the mean of the embeddings of its hashed character n-grams (3 to 5,
with word edges, and the word itself); a text is the mean of its words; a
linear softmax gives the two classes.  Runs of more than `LONGEST` characters without
white space or an ASCII mark are taken in stretches, each a word; n-grams do not
cross stretches.  Embeddings and softmax are trained
jointly in numpy, by Adam over mini-batches, on a bounded sample of labelled
rows: at most `PER_CLASS` rows a class and `SAMPLE_CHARS` characters a row (a
longer text gives a stretch of that length from a hashed place).  Rows are weighed so that the classes keep their shares of all labelled
rows.  Words never seen still share n-grams with seen ones.

As mean and softmax are linear, the fitted model is one number an n-gram
bucket and a bias; scoring a word needs no vectors.  It reads every whole
text and holds one slice.

Special cases: a null or empty text has no words and scores the bias alone; a
very long text, or word, is scored whole;
without labels of both classes all scores are the share of toxic labels (0
without labels); labels of identifiers that occur twice count once each;
repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import U64, RangeHash, codepoints, concatenated, mix64, row_slices, runs, stretch, sums_by_row

PER_CLASS = 1200
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 18
WIDTH = 8
EPOCHS = 12
#: Updates at least: small samples are passed over more often.
UPDATES = 450
#: n-grams of fewer sampled texts have no vector.
LEAST_TEXTS = 3
DECAY = 1e-2
SEED = 7
GRAMS = (3, 4, 5)
LONGEST = 64
#: Marks that end a word, beside white space.
_CUT = np.zeros(0x3001, bool)
_CUT[[*range(0x21), *map(ord, ".,;:!?\"()[]{}|<>"), 0xA0, 0x3000, 0x3001 - 1]] = True


@dataclass
class Bags:
    """n-gram buckets of the distinct words of a slice, and where the words stand."""

    buckets: np.ndarray
    first: np.ndarray  # for each distinct word, and past the last, its first bucket
    which: np.ndarray  # for each running word its distinct word
    rows: np.ndarray  # for each row, and past the last, its first running word


def bags(texts: list[str | None]) -> Bags:
    cp, rows = codepoints(texts)
    starts, ends = runs(~_CUT[np.minimum(cp, 0x3000)] | (cp > 0x3000))
    if len(starts) and (ends - starts).max() > LONGEST:
        count = -(-(ends - starts) // LONGEST)
        part = concatenated(np.zeros(len(count), np.int64), count)
        starts, ends = np.repeat(starts, count) + part * LONGEST, np.repeat(ends, count)
        ends = np.minimum(ends, starts + LONGEST)
    first = np.searchsorted(starts, rows)
    if not len(starts):
        return Bags(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), first)
    sym = mix64(cp.astype(U64) + U64(1000))
    key = RangeHash(sym).ranges(starts, ends - starts)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    size = (ends - starts)[one]
    # the distinct words one after the other, each between two edges
    flat = np.full(int((size + 2).sum()), 7, dtype=U64)
    edge = np.cumsum(size + 2) - (size + 2)
    flat[concatenated(edge + 1, size)] = sym[concatenated(starts[one], size)]
    flat[edge] = 3
    hashed = RangeHash(flat)
    owner, found = [np.arange(len(one))], [key[one]]
    for n in GRAMS:
        count = np.maximum(0, size + 3 - n)
        at = concatenated(edge, count)
        found.append(hashed.grams(n)[at])
        owner.append(np.repeat(np.arange(len(one)), count))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return Bags((found[order] % U64(BUCKETS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(one) + 1)), which.ravel(), first)


@dataclass
class Model:
    weight: np.ndarray  # by bucket
    bias: float


def _design(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (bucket, share): the n-grams of each text, as shares of its mean."""
    at, cols, vals = [0], [], []
    for lo in range(0, len(texts), 64):
        b = bags(texts[lo : lo + 64])
        n = np.diff(b.first)
        for i in range(len(b.rows) - 1):
            words, count = np.unique(b.which[b.rows[i] : b.rows[i + 1]], return_counts=True)
            grams = b.buckets[concatenated(b.first[words], n[words])]
            share = np.repeat(count / (n[words] * max(1, count.sum())), n[words])
            cell, inverse = np.unique(grams, return_inverse=True)
            cols.append(cell.astype(np.int32))
            vals.append(np.bincount(inverse.ravel(), share, len(cell)).astype(np.float32))
            at.append(at[-1] + len(cell))
    return np.array(at), np.concatenate(cols) if cols else np.zeros(0, np.int32), np.concatenate(vals) if vals else np.zeros(0, np.float32)


def fit(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """share: of label 1 among all labelled rows."""
    y = np.array(labels, int)
    if not 0 < y.sum() < len(y):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    at, cols, vals = _design(texts)
    often = (np.bincount(cols, minlength=BUCKETS) >= LEAST_TEXTS)[cols]
    at = np.concatenate([[0], np.cumsum(often)])[at]
    cols, vals = cols[often], vals[often]
    used, local = np.unique(cols, return_inverse=True)
    local = local.ravel()
    e = rng.normal(0, 0.1, (len(used), WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    b = np.log(np.array([1 - share, share], np.float32))
    weigh = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    scale, rate, t = 30.0, 0.03, 0
    memory = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, w, b)]
    for _ in range(max(epochs, -(-UPDATES // -(-len(y) // 64)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            count = at[pick + 1] - at[pick]
            cell = concatenated(at[pick], count)
            j, v = local[cell], vals[cell] * scale
            edge = np.concatenate([[0], np.cumsum(count)])
            mean = sums_by_row(e[j] * v[:, None], edge).astype(np.float32)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= (weigh[pick] / len(pick))[:, None]
            back = np.repeat(p @ w.T, count, 0) * v[:, None]
            here, slot = np.unique(j, return_inverse=True)
            ge = np.stack([np.bincount(slot.ravel(), back[:, k], len(here)) for k in range(WIDTH)], 1)
            t += 1
            for x, g, (m, s), rows in ((e, ge, memory[0], here), (w, mean.T @ p, memory[1], ...), (b, p.sum(0), memory[2], ...)):
                m[rows] = 0.9 * m[rows] + 0.1 * g
                s[rows] = 0.999 * s[rows] + 0.001 * g * g
                x[rows] -= rate * DECAY * x[rows] + rate * (m[rows] / (1 - 0.9**t)) / (np.sqrt(s[rows] / (1 - 0.999**t)) + 1e-7)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = scale * (e @ (w[:, 1] - w[:, 0]))
    return Model(weight, float(b[1] - b[0]))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    b = bags(texts)
    word = sums_by_row(model.weight[b.buckets], b.first) / np.maximum(1, np.diff(b.first))
    mean = sums_by_row(word[b.which], b.rows) / np.maximum(1, np.diff(b.rows))
    return 1 / (1 + np.exp(-np.clip(mean + model.bias, -500, 500)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on a bounded sample: rows whose hash falls under each class's share."""
    lab = labels.select(F.col(key).alias("lk"), F.col(label).alias("y")).where(~held_out(F.col("lk")) & F.col("y").isin(0, 1)).dropDuplicates(["lk"])
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return fit([], [], 0.0)
    wide = 1 << 30
    share = F.when(F.col("y") == 1, int(min(1.0, 1.25 * PER_CLASS / max(1, counts.get(1, 0))) * wide)).otherwise(int(min(1.0, 1.25 * PER_CLASS / max(1, counts.get(0, 0))) * wide))
    lab = lab.where(F.pmod(F.xxhash64("lk", F.lit(5)), F.lit(wide)) < share).limit(4 * PER_CLASS)  # bounded: about 2.5 * PER_CLASS rows
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    rows = d.join(F.broadcast(lab), F.col("k") == F.col("lk")).select("k", stretch(F.col("t"), F.col("k"), SAMPLE_CHARS).alias("t"), "y").orderBy(F.xxhash64("k", F.lit(6)), "k", "t").limit(4 * PER_CLASS).collect()
    taken, texts, ys = {0: 0, 1: 0}, [], []
    for r in rows:
        taken[r["y"]] += 1
        if taken[r["y"]] <= PER_CLASS:
            texts.append(r["t"])
            ys.append(int(r["y"]))
    return fit(texts, ys, counts.get(1, 0) / total)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi in row_slices(batch.column(1), 1 << 20):
                found = scores(model, batch.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[key]}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
