"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability in a language is the sum over all of its segmentations
into pieces, by the forward algorithm over a trie of the pieces; a text's is
the product over its words.  The piece probabilities are learned by
expectation-maximisation (forward-backward) on a bounded sample of labelled
rows: `PER_LANG` rows a language, or fewer where there are so many languages
that this would be more than `SAMPLE_ROWS`, and `SAMPLE_CHARS` characters a row
(a longer text gives a stretch of that length from a hashed place).  All
languages of the labelled rows are learned.
Scoring reads every whole text, is vectorised over the distinct words of a
slice, and holds one slice in memory.

Each letter that the sample shows has a code of its own, in any script; the
others share one.  Words are runs of letters, lower-cased; runs of more than
`LONGEST` letters are scored in stretches, each a word.

Special cases: `und` and score 0 for a null text, a text without letters, or
when no labelled row exists; ties go to the language first in order; very long
texts are scored whole; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored by `identify` and returned
unchanged by `known`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import giving_back, local, table
from ._text import U64, codepoints, concatenated, mix64, row_slices, runs, stretch, sums_by_row

PER_LANG = 400
SAMPLE_ROWS = 16_000
SAMPLE_CHARS = 20_000
LONGEST = 40
#: Entries of a trie's table up to which it is stored whole; a larger one is looked up by search.
DENSE = 1 << 24
#: Probabilities are held times this for each letter, so that a word's neither vanish nor overflow.
SCALE = 1e6
ROUNDS = 4
FLOOR = 0.1
START = "▁"
#: Bytes of the texts that are scored at once, or one longer text.
SLICE = 1 << 20
_SHARES = T.StructType([T.StructField("s_l", T.StringType()), T.StructField("share", T.LongType())])
_PLACE = mix64(np.arange(1, 64, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def pieces(path: str | None = None) -> list[str]:
    """The pieces of the fixed vocabulary that are letters (after a word start)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in found if p.removeprefix(START).isalpha())


_letter: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """By code point: is it a letter?"""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


@dataclass
class Words:
    """The distinct words of a slice, longest first, and where they stand."""

    codes: np.ndarray  # (words, LONGEST + 1), the first is the word start
    sizes: np.ndarray  # with the word start
    which: np.ndarray  # for each running word its distinct word
    first: np.ndarray  # for each row, and past the last, its first running word


def split_words(texts: list[str | None], code: np.ndarray) -> Words:
    """code: by code point, 0 for what is no letter; 1 is the word start."""
    cp, rows = codepoints(texts)
    sym = code[cp]
    starts, ends = runs(sym > 0)
    if len(starts) and (ends - starts).max() > LONGEST:
        count = -(-(ends - starts) // LONGEST)
        part = concatenated(np.zeros(len(count), np.int64), count)
        starts, ends = np.repeat(starts, count) + part * LONGEST, np.repeat(ends, count)
        ends = np.minimum(ends, starts + LONGEST)
    first = np.searchsorted(starts, rows)
    if not len(starts):
        return Words(np.zeros((0, LONGEST + 1), code.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), first)
    size = ends - starts
    at = concatenated(starts, size)
    place = at - np.repeat(starts, size)
    mixed = mix64(sym[at].astype(U64) * _PLACE[place])
    edge = np.cumsum(size) - size
    key = mix64(np.add.reduceat(mixed, edge) + size.astype(U64))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(-size[one], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    one = one[order]
    codes = np.zeros((len(one), LONGEST + 1), code.dtype)
    codes[:, 0] = 1
    n = size[one]
    row = np.repeat(np.arange(len(one)), n)
    at = concatenated(starts[one], n)
    codes[row, 1 + at - np.repeat(starts[one], n)] = sym[at]
    return Words(codes, n + 1, rank[which.ravel()], first)


@dataclass
class Model:
    langs: list[str]
    letters: str
    prior: np.ndarray
    step: np.ndarray  # (nodes, codes): the next node, 0 where none; or, where that is too large, the pairs' numbers in order
    next: np.ndarray | None  # and the next node of each
    piece: np.ndarray  # nodes that are pieces
    depth: np.ndarray  # letters up to each node
    prob: np.ndarray  # (nodes, languages)

    def code(self) -> np.ndarray:
        kind = np.min_scalar_type(3 + len(self.letters))
        out = np.where(is_letter(), kind.type(2), kind.type(0))  # 2: letters that the sample lacks
        if self.letters:
            out[np.array([ord(c) for c in self.letters])] = np.arange(3, 3 + len(self.letters)).astype(kind)
        return out

    def scaled(self) -> np.ndarray:
        return self.prob * SCALE ** self.depth[:, None]

    def go(self, node, code: np.ndarray) -> np.ndarray:
        if self.next is None:
            return self.step[node, code]
        pair = np.asarray(node, np.int64) * (3 + len(self.letters)) + code
        at = np.minimum(np.searchsorted(self.step, pair), len(self.step) - 1)
        return np.where(self.step[at] == pair, self.next[at], 0)


def _trie(vocabulary: list[str], letters: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    number = {c: 3 + i for i, c in enumerate(letters)} | {START: 1}
    width = 3 + len(letters)
    words = [[number[c] for c in p] for p in vocabulary if all(c in number for c in p)] + [[i] for i in range(1, width)]
    step: dict[int, int] = {}
    piece, depth = [False, False], [0, 0]  # node 0: dead, node 1: root
    for w in words:
        node = 1
        for c in w:
            pair = node * width + c
            if pair not in step:
                step[pair] = len(piece)
                piece.append(False)
                depth.append(depth[node] + 1)
            node = step[pair]
        piece[node] = True
    pairs = np.array(sorted(step), np.int64)
    following = np.array([step[x] for x in pairs.tolist()], np.int32)
    if len(piece) * width > DENSE:
        return pairs, following, np.array(piece), np.array(depth)
    table = np.zeros(len(piece) * width, np.int32)
    table[pairs] = following
    return table.reshape(-1, width), None, np.array(piece), np.array(depth)


def _walk(model: Model, codes: np.ndarray, sizes: np.ndarray):
    """(i, length, rows, nodes): all places where a path of the trie lies; rows are sorted longest first."""
    for i in range(int(sizes[0]) if len(sizes) else 0):
        live = np.arange(np.searchsorted(-sizes, -i, side="left"))
        node = model.go(1, codes[live, i])
        length = 1
        while len(live):
            hit = model.piece[node]
            if hit.any():
                yield i, length, live[hit], node[hit]
            more = sizes[live] > i + length
            live, node = live[more], node[more]
            if not len(live):
                break
            node = model.go(node, codes[live, i + length])
            more = node > 0
            live, node, length = live[more], node[more], length + 1


def forward(model: Model, scaled: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: the probability of all segmentations up to
    `end`, times SCALE for each letter."""
    wide = int(sizes[0]) if len(sizes) else 0
    alpha = np.zeros((len(sizes), wide + 1, len(model.langs)))
    alpha[:, 0] = 1.0
    for i, length, rows, nodes in _walk(model, codes, sizes):
        alpha[rows, i + length] += alpha[rows, i] * scaled[nodes]
    return alpha


def log_likelihood(model: Model, codes: np.ndarray, sizes: np.ndarray, block: int = 8192) -> np.ndarray:
    out, scaled = np.zeros((len(sizes), len(model.langs))), model.scaled()
    for lo in range(0, len(sizes), block):
        n = sizes[lo : lo + block]
        alpha = forward(model, scaled, codes[lo : lo + block], n)
        out[lo : lo + block] = np.log(alpha[np.arange(len(n)), n]) - n[:, None] * np.log(SCALE)
    return out


def _expected(model: Model, codes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, block: int = 8192) -> np.ndarray:
    """Expected counts of the pieces, by node and language."""
    total, scaled = np.zeros_like(model.prob), model.scaled()
    for lo in range(0, len(sizes), block):
        c, n, weight = codes[lo : lo + block], sizes[lo : lo + block], counts[lo : lo + block]
        alpha = forward(model, scaled, c, n)
        beta = np.zeros_like(alpha)
        k = np.arange(len(n))
        z = alpha[k, n]
        beta[k, n] = weight / z
        for i, length, rows, nodes in reversed(list(_walk(model, c, n))):
            later = scaled[nodes] * beta[rows, i + length]
            beta[rows, i] += later
            share = alpha[rows, i] * later
            for j in range(total.shape[1]):
                total[:, j] += np.bincount(nodes, share[:, j], len(total))
    return total


def fit(rows: list[tuple[str, str]], vocabulary: list[str], rounds: int = ROUNDS) -> Model | None:
    """rows: (text, language)."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    seen = {c for text, _ in rows for c in set(text.lower())}
    letters = "".join(sorted(c for c in seen if c.isalpha()))
    step, following, piece, depth = _trie(vocabulary, letters)
    docs = np.array([sum(lang == x for _, x in rows) for lang in langs], float)
    start = np.where(piece, 1.0 / piece.sum(), 0.0)
    model = Model(langs, letters, np.log(docs / docs.sum()), step, following, piece, depth, np.repeat(start[:, None], len(langs), 1))
    words = split_words([t for t, _ in rows], model.code())
    of = np.repeat([langs.index(x) for _, x in rows], np.diff(words.first))
    counts = np.bincount(words.which * len(langs) + of, minlength=len(words.sizes) * len(langs)).reshape(-1, len(langs)).astype(float)
    for _ in range(rounds):
        found = _expected(model, words.codes, words.sizes, counts) + FLOOR * piece[:, None]
        model.prob = found / found.sum(0)
    return model


def predict(model: Model | None, texts: list[str | None], code: np.ndarray | None = None) -> tuple[list[str], list[float]]:
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    words = split_words(texts, model.code() if code is None else code)
    each = log_likelihood(model, words.codes, words.sizes)
    total = sums_by_row(each[words.which], words.first) + model.prior
    best = total.argmax(1)
    score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    some = np.diff(words.first) > 0
    return [model.langs[b] if s else "und" for b, s in zip(best, some)], np.where(some, score, 0.0).tolist()


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", vocabulary: str | None = None) -> Model | None:
    """Fit on a bounded sample of the labelled rows: those whose hash falls
    under a share that yields about PER_LANG rows a language."""
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(~held_out(F.col("k")) & F.col("l").isNotNull() & (F.length("t") > 0))
    counts = d.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not counts:
        return None
    each, wide = max(1, min(PER_LANG, SAMPLE_ROWS // len(counts))), 1 << 30
    shares = local(docs.sparkSession, [(r["l"], int(min(1.0, 1.5 * each / r["n"]) * wide)) for r in counts], _SHARES)
    rows = d.join(F.broadcast(shares), F.col("l") == F.col("s_l")).where(F.pmod(F.xxhash64("k", F.lit(5)), F.lit(wide)) < F.col("share"))
    rows = rows.select("k", "l", stretch(F.col("t"), F.col("k"), SAMPLE_CHARS).alias("t")).orderBy(F.xxhash64("k", F.lit(6)), "k", "t").limit(2 * each * len(counts)).collect()
    taken: dict[str, int] = {}
    sample = []
    for r in rows:
        taken[r["l"]] = taken.get(r["l"], 0) + 1
        if taken[r["l"]] <= each:
            sample.append((r["t"], r["l"]))
    return fit(sample, pieces(vocabulary))


def _predicted(batches, model: Model | None, text: str):
    """Slices of the batches with the language and score of each row."""
    code = model.code() if model else None
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        for lo, hi in row_slices(column, SLICE):
            yield batch.slice(lo, hi - lo), *predict(model, column.slice(lo, hi - lo).to_pylist(), code)


def identify(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batches):
        import pyarrow as pa

        for rows, best, score in _predicted(batches, model, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(giving_back(run), T.StructType([d.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def known(docs: DataFrame, model: Model | None, least: float, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a language that is `least` likely or more."""

    def run(batches):
        import pyarrow as pa

        for rows, best, score in _predicted(batches, model, text):
            yield rows.filter(pa.array([b != "und" and s >= least for b, s in zip(best, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
