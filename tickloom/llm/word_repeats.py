"""Substring de-duplication on windows of 13 words, by super-k-mers.

Consecutive windows that share a minimiser (of three-word grams) travel as one
packed string to the minimiser's bucket, where sorting tells exactly which
windows also start in a document with a smaller identifier (see `_windows`).
Every word under such a window is removed; windows are judged on the input.

Special cases: a null text has no words; texts of fewer than 13 words lose
nothing; a text of 13 words or more that repeats a text with a smaller
identifier loses all its words; rows with the same identifier are never
compared with each other; a null identifier comes after all others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import word_bounds, word_hashes
from ._windows import LAST, Kind, covered, repeats, tag_of

WINDOW = 13
GRAM = 3


def _symbols(raw: np.ndarray, at: np.ndarray):
    starts, ends, first = word_bounds(raw, at)
    return word_hashes(raw, starts, ends), first


def _packed(raw: bytes):
    words = raw.split()
    place = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=place[1:])
    return b" ".join(words) + b" ", place


def _numbers(strings: list[bytes]):
    known: dict[bytes, int] = {}
    out, first = [], [0]
    for s in strings:
        out += [known.setdefault(w, len(known)) for w in s.split()]
        first.append(len(out))
    return np.array(out, np.int64), np.array(first), 1


KIND = Kind(WINDOW, GRAM, _symbols, _packed, _numbers, False, 2)


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; on demand also the kept text."""
    base, reps, spans = repeats(docs, KIND, text, key)

    def run(batches):
        import pyarrow as pa

        names = ["doc", "tag", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for doc, tag, whole, found in zip(*(batch.column(i).slice(lo, 256) for i in range(4)), strict=True):
                    words = whole.as_buffer().to_pybytes().split()
                    n = len(words)
                    for a, b in reversed(covered([(x["start"], x["n"]) for x in found.as_py() or []], WINDOW)):
                        del words[a:b]
                    kept = b" ".join(words)
                    rows.append((doc.as_py(), tag.as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] * with_text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names)

    own = reps.join(spans, ["doc", "tag"], "left").select("doc", "tag", "text", "spans").mapInArrow(run, "doc long, tag int, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    # every row takes the result of the row that stands for its text; a row with
    # a larger identifier repeats it, and loses all words where there is a window
    more = base.withColumn("tag", tag_of(F.col("sha"))).select(F.col("doc").alias("of"), F.col("rep").alias("doc"), "tag")
    out = own.join(more, ["doc", "tag"])
    gone = (F.col("of") > F.col("doc")) & (F.col("n_words") >= WINDOW)
    columns = [F.when(F.col("of") != LAST, F.col("of")).alias("doc_id"), "n_words", F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)


def op9_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS earliest FROM windows) WHERE earliest < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (SELECT words.doc_id, words.i, word, max(starts.i) OVER (PARTITION BY words.doc_id ORDER BY words.i) AS last
  FROM words LEFT JOIN starts ON starts.doc_id = words.doc_id AND starts.i = words.i),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS rest FROM marked WHERE last IS NULL OR i - last >= 13 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
