"""Suffix-array de-duplication: repeated 100-byte strings, exactly.

Positions that share a minimiser are gathered (see `_windows`), and their
suffixes are sorted to the depth of the window by bucket-pointer refinement:
buckets of the first q bytes are refined by sorting on the bucket pointers of
later offsets, which were themselves refined before.  Every byte under a
100-byte string that also starts earlier (a smaller identifier, or the same
text at a smaller offset) is removed; strings are judged on the input.

Special cases: a null text is empty; texts of fewer than 100 bytes lose
nothing; a repeated text of 100 bytes or more loses all its bytes, but of rows
with the same identifier and the same text each is judged as the first; rows
with the same identifier and other texts are texts of their own, in an
unspecified fixed order; a null identifier comes after all others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import BYTE
from ._windows import LAST, Kind, covered, repeats, tag_of

WINDOW = 100
GRAM = 32


def _numbers(strings: list[bytes]):
    data = np.frombuffer(b"".join(strings) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = len(data) - 3
    four = data[:n] << 24 | data[1 : n + 1] << 16 | data[2 : n + 2] << 8 | data[3:]
    return four, np.concatenate([[0], np.cumsum([len(s) for s in strings])]), 4


KIND = Kind(WINDOW, GRAM, lambda raw, at: (BYTE[raw], at), lambda raw: (raw, np.arange(len(raw) + 1)), _numbers, True, 8)


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; on demand
    also what is kept of the text (binary) and the removed ranges."""
    base, reps, spans = repeats(docs, KIND, text, key)

    def run(batches):
        import pyarrow as pa

        names = ["doc", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "removed"] * with_text]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for doc, tag, whole, found in zip(*(batch.column(i).slice(lo, 256) for i in range(4)), strict=True):
                    raw = whole.as_buffer().to_pybytes()
                    ranges = covered([(x["start"], x["n"]) for x in found.as_py() or []], WINDOW)
                    kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in ranges)], [*(s for s, _ in ranges), len(raw)])) if ranges else raw
                    rows.append((doc.as_py(), tag.as_py(), len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), *([kept, ranges] * with_text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names)

    extra = ", kept binary, removed array<array<long>>" if with_text else ""
    own = reps.join(spans, ["doc", "tag"], "left").select("doc", "tag", "text", "spans").mapInArrow(run, "doc long, tag int, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)
    # rows that stand for themselves (again for each equal row), and rows that repeat a smaller one
    more = base.withColumn("tag", tag_of(F.col("sha")))
    first = own.join(more.where("doc = rep").groupBy("doc", "tag").agg(F.count(F.lit(1)).alias("times")), ["doc", "tag"])
    first = first.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_", "times", "tag")
    gone = F.col("n_bytes") >= WINDOW
    empty = hashlib.sha256(b"").hexdigest()
    rest = more.where("doc > rep").select("doc", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(gone, F.lit(empty)).otherwise(F.col("sha")).alias("kept_sha256"))
    out = first.unionByName(rest, allowMissingColumns=True)
    return out.withColumn("doc_id", F.when(F.col("doc") != LAST, F.col("doc"))).select("doc_id", *[c for c in out.columns if c != "doc"])


def op4_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, b, n, unnest(range(1, n + 1)) AS i FROM d),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY b[i:i + 99] ORDER BY doc_id, i) AS k FROM places WHERE i + 99 <= n) WHERE k > 1),
marked AS (SELECT p.doc_id, p.i, coalesce(p.i - max(s.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) < 100, false) AS gone FROM places p LEFT JOIN starts s ON s.doc_id = p.doc_id AND s.i = p.i),
edges AS (SELECT doc_id, i, gone, gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY doc_id ORDER BY i) AS edge FROM marked),
runs AS (SELECT doc_id, gone, min(i) AS low, max(i) AS high FROM (SELECT doc_id, i, gone, sum(CAST(edge AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY doc_id, gone, run),
kept AS (SELECT r.doc_id, sum(high - low + 1) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE gone) AS spans, string_agg(hex(b[low:high]), '' ORDER BY low) FILTER (WHERE NOT gone) AS rest FROM runs r JOIN d ON d.doc_id = r.doc_id GROUP BY r.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
