"""Language-model scoring by stupid backoff, computed relationally.

Texts are dealt into chunks of about `CHUNK_BYTES` by a hash.  A chunk
explodes its texts into n-grams of 1 to `order` words and counts the distinct
ones (the pre-aggregation: a frequent n-gram leaves a chunk once).  The counts
go to tables partitioned by n-gram hash, packed as one row for each chunk and
partition; there all chunks are summed, and the sums are joined back to the
exploded n-grams of each chunk, where the scores are summed per document.
A partition holds a fixed share of the hash range, whatever the frequencies,
and about `BUCKET_GRAMS` n-grams, whatever the size of the corpus.

Counts cover all documents.  A document is not evidence for itself: its own
occurrences are taken off.  With c the remaining counts and N the remaining
words, the score of a word after its context is c(context word) / c(context)
where c(context word) > 0, or else ALPHA times the score with a shorter
context; without context it is c(word) / N, and an unseen word counts
ALPHA / (N + 1).  The result is the sum of the natural logarithms.

The tables are joined in rounds: n-grams of one and two words first, then of
three, and so on.  An n-gram that another document holds is made of shorter
ones that another document holds, so an occurrence with a part that its own
document alone holds has c = 0 and need not be counted.  All its occurrences
are in that document and are left out alike, so no count that is used lacks
anything.

n-grams are identified by 64-bit hashes.

Special cases: a text without words (null, empty) has n_words 0 and log_score
and mean_log_score 0; a text longer than a chunk is a chunk of its own; repeated
rows are documents of their own and evidence for each other; rows with the same
identifier likewise; an empty table gives an empty result; other columns, of
any name, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import partitions, table
from ._text import U64, buffers, constants, mix64, slices, word_bounds, word_hashes

ORDER = 3
ALPHA = 0.4
CHUNK_BYTES = 10 << 20
#: n-gram occurrences of one hash partition, on average.
BUCKET_GRAMS = 2_000_000
#: Chunks of a partition from which on no care is taken to deal them out evenly; below, their numbers are broadcast.
EVEN = 16
#: Bytes that are cut into words at once; they stay in the processor's cache.
SLICE = 1 << 17
_PLACE = constants(64, 71)


def exploded(column, order: int):
    """For each n from 1 to order the hashes of the n-grams that end at each
    word (0 where the text has fewer words before), and the first word of each row."""
    raw, at = buffers(column)
    found, first = [np.zeros(0, U64)], [0]
    for lo, hi in slices(at, SLICE):
        data, offs = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, edge = word_bounds(data, offs)
        found.append(word_hashes(data, starts, ends))
        first += np.diff(edge).tolist()
    words, first = np.concatenate(found), np.cumsum(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    out, total = [], np.zeros(len(words), dtype=U64)
    for n in range(1, order + 1):
        back = np.concatenate([np.zeros(n - 1, U64), words[: len(words) - n + 1]]) if len(words) >= n else np.zeros(len(words), U64)
        total = total + back * _PLACE[n]
        out.append(np.where(place >= n - 1, mix64(total ^ U64(n)) | U64(1), U64(0)))
    return out, first


def remaining(grams: list[np.ndarray], row: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """At each word the counts of its n-grams without those of its own row; 0
    where it has none.  c: the counts of all that occur, in the n-grams' order.
    One sort, of the n-grams with their places in the low bits."""
    flat, rows = np.concatenate(grams), np.concatenate([row] * len(grams))
    out = np.zeros(len(flat), np.int64)
    at = np.flatnonzero(flat).astype(U64)
    if len(at):
        low = U64((1 << len(flat).bit_length()) - 1)
        key = (flat[at] & ~low) | at
        key.sort()
        at = (key & low).astype(np.int64)
        if (flat[at[1:]] < flat[at[:-1]]).any():  # some differ in the low bits alone
            at = at[np.argsort(flat[at], kind="stable")]
        new, cell = np.ones(len(at), bool), np.ones(len(at) + 1, bool)
        new[1:] = flat[at[1:]] != flat[at[:-1]]
        cell[1:-1] = new[1:] | (rows[at[1:]] != rows[at[:-1]])
        times = np.diff(np.flatnonzero(cell))
        out[at] = c[np.cumsum(new) - 1] - np.repeat(times, times)
    return np.split(out, len(grams))


def wanted(grams: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """The n-grams whose two parts (the words but the first, but the last) other
    rows hold too; 0 for the others.  shorter: the remaining counts of n - 1 words."""
    before = np.concatenate([[0], shorter[:-1]])
    return np.where((shorter > 0) & (before > 0), grams, U64(0))


def planes(x: np.ndarray) -> bytes:
    """Numbers by significance, so that leading zeros compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets)) >> U64(32)


def dealt_evenly(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """i from 0 to n - 1, and a number for each (`chunk`) such that Spark's hash
    partitioning deals these out evenly over the partitions."""
    tries = spark.range(16 * (n + parts)).select(F.col("id").alias("chunk"), F.pmod(F.hash("id"), F.lit(parts)).alias("part"))
    tries = tries.withColumn("turn", F.row_number().over(Window.partitionBy("part").orderBy("chunk")))
    tries = tries.where(F.col("turn") <= -(-n // parts)).withColumn("i", F.row_number().over(Window.orderBy("turn", "part")) - 1)
    return tries.where(F.col("i") < n).select(F.col("i").cast("long").alias("i"), "chunk")


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, alpha: float = ALPHA, chunk_bytes: int = CHUNK_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every row."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    size = docs.select(F.sum(F.octet_length(text)).alias("b"), F.sum(F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).alias("w")).first()
    chunks, n_words = max(1, round((size["b"] or 0) / chunk_bytes)), int(size["w"] or 0)
    buckets = max(n_parts, -(-n_words * 2 // bucket_grams))
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    if chunks < EVEN * n_parts:  # so few for a partition that chance alone would deal them out unevenly
        d = d.withColumnRenamed("chunk", "i").join(F.broadcast(dealt_evenly(spark, chunks, n_parts)), "i").drop("i")
    d = d.repartition(n_parts, "chunk")
    packed = "bucket int, chunk long, grams binary, counts binary"

    def table_rows(chunk: int, flat: np.ndarray):
        """The distinct n-grams of a chunk and how often each occurs, by bucket."""
        import pyarrow as pa

        h, n = np.unique(flat[flat > 0], return_counts=True)
        edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1, dtype=U64))
        step = np.diff(h, prepend=U64(0))
        rows = [(b, planes(np.append(h[lo : lo + 1], step[lo + 1 : hi])), planes(n[lo:hi].astype(np.uint32))) for b, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])) if hi > lo]
        b, grams, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "grams": pa.array(grams, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def total(turn: int):
        def add(group):
            import pyarrow as pa

            grams = [np.cumsum(unplanes(x.as_buffer(), U64), dtype=U64) for x in group.column("grams")]
            counts = [unplanes(x.as_buffer(), np.uint32) for x in group.column("counts")]
            _, which = np.unique(np.concatenate(grams), return_inverse=True)
            sums = np.bincount(which.ravel(), np.concatenate(counts))[which.ravel()].astype(np.int64)
            parts = np.split(sums, np.cumsum([len(g) for g in grams])[:-1])
            return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "sums": pa.array([planes(p) for p in parts], pa.binary()), "turn": pa.array([turn] * len(parts), pa.int32())})

        return add

    def asked(grams, left, turn: int) -> list[np.ndarray]:
        return grams[:2] if turn == 0 else [wanted(grams[turn + 1], left[turn])]

    def counts_of(own, found, turns: int):
        """The n-grams at each word, the first word of each row, and the remaining counts of the first turns."""
        grams, first = exploded(own.column("text"), order)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        left: list[np.ndarray] = []
        found = found.sort_by([("turn", "ascending"), ("bucket", "ascending")])
        turn_of = np.asarray(found.column("turn"))
        for turn in range(turns):
            lo, hi = np.searchsorted(turn_of, [turn, turn + 1])
            c = [unplanes(x.as_buffer(), np.int64) for x in found.column("sums").slice(lo, hi - lo)]
            left += remaining(asked(grams, left, turn), row, np.concatenate(c) if c else np.zeros(0, np.int64))
        return grams, first, row, left

    def first_turn(group):
        return table_rows(group.column("chunk")[0].as_py(), np.concatenate(exploded(group.column("text"), min(2, order))[0]))

    def later(turn: int):
        def count(own, found):
            grams, _, _, left = counts_of(own, found, turn)
            chunk = own.column("chunk")[0].as_py() if own.num_rows else 0
            return table_rows(chunk, np.concatenate(asked(grams, left, turn)))

        return count

    sums, turns = None, max(1, order - 1)
    for turn in range(turns):
        grams = d.groupBy("chunk").applyInArrow(first_turn, packed) if turn == 0 else d.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(later(turn), packed)
        more = grams.groupBy("bucket").applyInArrow(total(turn), "chunk long, bucket int, sums binary, turn int").repartition(n_parts, "chunk")
        sums = more if sums is None else sums.unionByName(more)

    def judge(own, found):
        import pyarrow as pa

        grams, first, row, left = counts_of(own, found, turns)
        n = np.diff(first)
        words = (n_words - n)[row].astype(float)
        value = np.where(left[0] > 0, left[0] / np.maximum(1.0, words), alpha / (words + 1.0))
        for m in range(1, order):
            context = np.concatenate([[0], left[m - 1][:-1]])
            value = np.where(grams[m] > 0, np.where(left[m] > 0, left[m] / np.maximum(1, context), alpha * value), value)
        result = np.zeros(len(n))
        result[n > 0] = np.add.reduceat(np.log(value), first[:-1][n > 0]) if len(value) else 0.0
        return pa.table({"doc_id": own.column("doc_id"), "n_words": pa.array(n.astype(np.int64)), "log_score": pa.array(result), "mean_log_score": pa.array(result / np.maximum(1, n))})

    kind = dict(d.dtypes)["doc_id"]
    return d.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(judge, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are sums of floats: to three places, and means to six."""
    found = score(table(spark, sf_dir, "documents"))
    return found.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT doc_id, i, a, b, c, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, doc_id) AS ca,
  CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY b, doc_id) END AS cb,
  CASE WHEN c IS NOT NULL THEN count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, doc_id) END AS cc,
  count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others FROM p),
x AS (SELECT *, lag(ca) OVER l AS pa, lag(cb) OVER l AS pb, CASE WHEN ca > 0 THEN CAST(ca AS DOUBLE) / others ELSE 0.4::DOUBLE / (others + 1) END AS one FROM c WINDOW l AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT *, CASE WHEN b IS NULL THEN one WHEN cb > 0 THEN CAST(cb AS DOUBLE) / pa ELSE 0.4::DOUBLE * one END AS two FROM x),
z AS (SELECT *, CASE WHEN c IS NULL THEN two WHEN cc > 0 THEN CAST(cc AS DOUBLE) / pb ELSE 0.4::DOUBLE * two END AS three FROM y),
s AS (SELECT doc_id, fsum(ln(three)) AS s FROM z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 3) AS log_score, round(coalesce(s, 0) / greatest(1, len(w)), 6) AS mean_log_score FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
