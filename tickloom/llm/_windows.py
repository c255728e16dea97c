"""Repeated windows of a fixed number of symbols, over a whole corpus.

A window's minimiser is the smallest hash of the k-grams inside it, the first
of equals.  Consecutive windows with the same minimiser form a run (a
super-k-mer).  A window with given content always has the same minimiser, so
equal windows meet in the minimiser's bucket:

1. Equal whole texts (by SHA-256) are folded: only the smallest identifier is
   searched.
2. Each run sends (minimiser, content hash, document, position) to its bucket,
   without text.  There equal runs (64 bits of minimiser and 64 of content) are
   seen at once: all but the first are repeated throughout.  A minimiser with
   one content is settled.
3. Only the first run of each content whose minimiser has several contents (or
   may repeat inside itself) travels as a packed string to the bucket, where
   the caller's sort decides window by window, on the symbols themselves.
4. The repeated stretches return to their documents.

Hot minimisers (a line or passage of very many texts) are known beforehand from
a sample of the rows; the sample decides only how work is dealt out, never a
result.  Their runs are cut where the minimiser's place in the window passes a
multiple of `Kind.places`, and each part's key is the hash of all symbols that its
windows share: the minimiser and what lies around it.  Equal windows have the
minimiser at the same place, so they still meet.  Each such key is dealt out by
document in `SALTS` parts, in which all but the first run of a content are
settled; only the parts' first runs meet under the key.

The texts are shuffled by document once; the three uses share that exchange.
Step 2 is Spark's own sort and windows.  In step 3 buckets are streamed in
sorted order: memory holds one batch, and `CHUNK` bytes of strings, or the
distinct contents of one key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import partitions, written
from ._text import U64, RangeHash, buffers, concatenated, mix64, runs, sliding_min, slices

STEP = 1 << 20
CAP = 1024
CHUNK = 2 << 20
#: A minimiser is hot if it holds more than 1 / (HOT * partitions) of the sampled runs: fewer than HOT * partitions are.
HOT = 4
#: Bytes of text in the sample: at least so many, or this share of the whole.
SAMPLE, SAMPLE_SHARE = 8 << 20, 1 / 1024
SALTS = 64
LAST = (1 << 63) - 1  # stands for a null identifier: after all others
_LOW = U64((1 << 24) - 1)


@dataclass
class Kind:
    """What the two users of this module differ in."""

    window: int
    gram: int
    #: raw bytes and row offsets to (symbol hashes, first symbol of each row)
    symbols: Callable
    #: raw bytes of one row to (bytes, start of each symbol and past the last): the packed form
    packed: Callable
    #: packed strings to (symbol numbers, first symbol of each): exact
    numbers: Callable
    #: do repeats inside one document count?
    within: bool
    #: places of a hot minimiser in its window that share a key
    places: int


def runs_of(symbols: np.ndarray, first: np.ndarray, kind: Kind, hot: np.ndarray | None = None):
    """row, start (in the row), length in windows, minimiser, content hash, may
    repeat inside, is hot.  hot: in order; their runs are cut and have other keys."""
    w, k = kind.window, kind.gram
    span = w - k + 1
    found = []
    for lo in range(0, max(1, len(symbols)), STEP):
        part = symbols[lo : lo + STEP + w - 1]
        if len(part) < w:
            break
        edge = np.clip(first - lo, 0, len(part))
        hashed = RangeHash(part)
        g = hashed.grams(k)
        least = sliding_min((g & ~_LOW) | np.arange(len(g), dtype=U64), span)
        at = (least & _LOW).astype(np.int64)
        key = g[at]
        own = _among(key, hot)
        if own.any():
            i = np.flatnonzero(own)
            low = (at[i] - i) // kind.places * kind.places
            begin, end = at[i] - low, at[i] + k + np.maximum(0, span - low - kind.places)
            key[i] = mix64(hashed.ranges(begin, end - begin) + low.astype(U64))
        step = np.zeros(len(at) + 1, dtype=np.int32)
        some = np.diff(edge) >= w
        np.add.at(step, edge[:-1][some], 1)
        np.add.at(step, edge[1:][some] - w + 1, -1)
        valid = np.cumsum(step[:-1]) > 0
        valid[STEP:] = False
        same = np.zeros(len(at), dtype=bool)
        same[1:] = valid[1:] & valid[:-1] & (key[1:] == key[:-1]) & (~own[1:] | (at[1:] == at[:-1]))
        starts = np.flatnonzero(valid & ~same)
        if not len(starts):
            continue
        after = np.ones(len(at) + 1, dtype=bool)
        after[:-1] = ~same
        ends = np.flatnonzero(valid & after[1:]) + 1
        n = ends - starts
        if n.max() > CAP:
            count = -(-n // CAP)
            part_no = concatenated(np.zeros(len(count), np.int64), count)
            starts, ends = np.repeat(starts, count) + part_no * CAP, np.repeat(ends, count)
            n = np.minimum(ends - starts, CAP)
        again = n > span
        if kind.within:
            p = at[starts]
            mine, far = g[p], np.append(g, np.zeros(span, U64))
            for d in range(1, span):
                again |= far[p + d] == mine
            again &= ~own[starts]  # all windows of a cut run have the minimiser at another place
        else:
            again[:] = False
        row = np.searchsorted(edge, starts, side="right") - 1
        found.append((row, starts + lo - first[row], n, key[starts], hashed.ranges(starts, n + w - 1), again, own[starts]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64), z.astype(U64), z.astype(bool), z.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _among(key: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which keys are among the known ones (in order)."""
    if known is None or not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def pack(start: np.ndarray, n: np.ndarray, again: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | n.astype(np.int64) << 21 | again.astype(np.int64) << 20 | tag


def unpack(pos: np.ndarray):
    return pos >> 32, pos >> 21 & 0x7FF, (pos >> 20 & 1) > 0, pos & 0xFFFFF


def refine(symbols: np.ndarray, ends: np.ndarray, starts: np.ndarray, window: int, first_depth: int) -> np.ndarray:
    """Bucket-pointer refinement.  symbols: of all strings, each symbol a
    number holding `first_depth` of them; ends: by position, where its string
    ends; starts: of the windows.  Returns for each window the earliest window
    start with the same content.

    A bucket's pointer is the slot of its first member.  Buckets of one member
    are final and are only looked up; the others are sorted by the pointers of
    the positions `depth` later, which earlier rounds have refined."""
    n, depth = len(symbols), first_depth
    order = np.argsort(symbols, kind="stable")
    pointer = np.empty(n, np.int32)  # a call's strings are far below 2 GB
    pointer[order] = _slots(symbols[order])
    del order
    place = np.arange(n, dtype=np.int32)
    open_ = place[place + depth <= ends]
    del place
    while depth < window:
        skip = min(depth, window - depth)
        open_ = open_[open_ + depth + skip <= ends[open_]]
        size = np.bincount(pointer[open_], minlength=n)
        live = open_[size[pointer[open_]] > 1]
        del size
        old = pointer[live]
        by = np.lexsort((pointer[live + skip], old))
        live, old = live[by], old[by]
        del by
        key = old.astype(np.int64) * (n + 1) + pointer[live + skip]
        pointer[live] = old + _slots(key) - _slots(old)
        del key
        depth += skip
    mine = pointer[starts]
    earliest = np.full(n, n, np.int32)
    np.minimum.at(earliest, mine, starts.astype(np.int32))
    return earliest[mine]


def _slots(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the place of its first equal."""
    if not len(ordered):
        return np.zeros(0, np.int32)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered), dtype=np.int32), np.int32(0)))


def _judge(doc: np.ndarray, strings: list[bytes], kind: Kind) -> list[np.ndarray]:
    """For each string (in order of document and position) which of its windows are repeated."""
    symbols, first, depth = kind.numbers(strings)
    size = np.diff(first)
    ends = np.repeat(first[1:].astype(np.int32), size)
    count = size - kind.window + 1
    starts = concatenated(first[:-1], count)
    early = refine(symbols, ends, starts, kind.window, depth)
    if kind.within:
        repeated = early < starts
    else:
        of = np.repeat(np.arange(len(size)), size)
        repeated = doc[of[early]] < doc[of[starts]]
    return np.split(repeated, np.cumsum(count)[:-1])


def tag_of(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, 5), 16, 10).cast("int")


def hot_minimisers(docs: DataFrame, total: int, kind: Kind, text: str, key: str, n_parts: int) -> np.ndarray:
    """The minimisers that hold a large share of a sample's runs, in order; fewer
    than HOT * n_parts.  total: bytes of all texts."""
    parts = max(1, int(total / max(SAMPLE, total * SAMPLE_SHARE)))

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            raw, at = buffers(batch.column(0))
            for lo, hi in slices(at):
                symbols, first = kind.symbols(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                mh, count = np.unique(runs_of(symbols, first, kind)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(mh.view(np.int64)), pa.array(count)], ["mh", "n"])

    some = docs.where(F.pmod(F.xxhash64(key, text), F.lit(parts)) == 0).select(text).mapInArrow(scan, "mh long, n long")
    counts = written(some.groupBy("mh").agg(F.sum("n").alias("n")), "sampled")
    runs_ = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where((F.col("n") > max(16, runs_ // (HOT * n_parts)))).collect()
    return np.sort(np.array([r["mh"] for r in found], np.int64).view(U64))


def _settled(met: DataFrame, kind: Kind, *by: str) -> DataFrame:
    """`first`: is the run the first of its content (or, where repeats inside a
    document do not count, in the first document)?  `open`: such a run, if its
    key has several contents or it may repeat inside itself.  A sort and two
    windows over the same partitioning."""
    content = Window.partitionBy(*by, "ch").orderBy("doc", "pos")
    first = F.row_number().over(content) == 1 if kind.within else F.first("doc").over(content) == F.col("doc")
    met = met.withColumn("first", first)
    several = F.min("ch").over(Window.partitionBy(*by)) != F.max("ch").over(Window.partitionBy(*by))
    return met.withColumn("open", F.col("first") & (several | ((F.shiftright("pos", 20).bitwiseAND(1)) == 1)))


def repeats(docs: DataFrame, kind: Kind, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """base: doc, sha, rep of every row.  reps: doc, tag, text, sha of the rows
    that stand for their equals.  spans: doc, tag, spans (start, n) of runs of
    repeated windows in them."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    base = written(docs.select(doc.alias("doc"), F.sha2(whole, 256).alias("sha"), F.octet_length(whole).cast("long").alias("n_bytes")), "texts")
    rep = base.groupBy("sha").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    rows, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    wanted = rep.select(F.col("rep").alias("doc"), tag_of(F.col("sha")).alias("tag"))
    d = docs.select(doc.alias("doc"), tag_of(F.sha2(whole, 256)).alias("tag"), whole.alias("text")).repartition(n_parts, "doc", "tag")
    d = d.join(wanted, ["doc", "tag"])
    if base.groupBy("doc", "sha").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        d = d.groupBy("doc", "tag").agg(F.first("text").alias("text"))

    hot = hot_minimisers(docs, total, kind, text, key, n_parts)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1), dtype=np.int64)
            raw, at = buffers(batch.column(2))
            for lo, hi in slices(at):
                symbols, first = kind.symbols(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                row, start, n, mh, ch, again, own = runs_of(symbols, first, kind, hot)
                salt = np.where(own, (mix64(ids[lo + row].astype(U64)) % U64(SALTS)).astype(np.int8), np.int8(-1))
                yield pa.RecordBatch.from_arrays([pa.array(mh.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(ids[lo + row]), pa.array(pack(start, n, again, tags[lo + row])), pa.array(salt)], ["mh", "ch", "doc", "pos", "salt"])

    met = d.select("doc", "tag", "text").mapInArrow(scan, "mh long, ch long, doc long, pos long, salt byte")
    met = _settled(met.repartition(n_parts, "mh", "salt"), kind, "mh", "salt")
    out = met.where("salt < 0 OR NOT first")
    if len(hot):
        # one condition on both columns: a filter on the salt alone would move below the exchange, which then could not be shared
        rest = met.where(F.when(F.col("first"), F.col("salt")).otherwise(F.lit(-1)) >= 0).select("mh", "ch", "doc", "pos")
        out = out.select("mh", "doc", "pos", "first", "open").unionByName(_settled(rest.repartition(n_parts, "mh"), kind, "mh").select("mh", "doc", "pos", "first", "open"))
    met = out.where("NOT first OR open").select("doc", (F.col("pos").bitwiseAND(0xFFFFF)).cast("int").alias("tag"), "mh", "pos", F.col("first").alias("open"))
    per_doc = met.groupBy("doc", "tag").agg(F.collect_list(F.struct("mh", "pos", "open")).alias("met"))
    asked = d.join(per_doc, ["doc", "tag"]).select("doc", "tag", "text", "met")

    def travel(batches):
        """Rows (mh, doc, tag, start, n, string): strings to judge, and (without one) stretches that are settled."""
        import pyarrow as pa

        schema = pa.schema([("mh", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("string", pa.binary())])
        for batch in batches:
            rows = []
            size = 0
            lists = batch.column(3)
            flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            all_mh, all_pos = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            all_open = np.asarray(flat.field(2).to_numpy(zero_copy_only=False), dtype=bool)
            for i in range(batch.num_rows):
                doc, tag = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                here = slice(at[i], at[i + 1])
                start, n, _, _ = unpack(all_pos[here])
                go = all_open[here]
                for s, m in zip(*joined(start[~go], n[~go])):
                    rows.append((doc, doc, tag, s, m, None))
                if go.any():
                    data, place = kind.packed(batch.column(2)[i].as_buffer().to_pybytes())
                    for mh, s, m in zip(all_mh[here][go].tolist(), start[go].tolist(), n[go].tolist()):
                        string = data[place[s] : place[s + m + kind.window - 1]]
                        size += len(string)
                        rows.append((mh, doc, tag, s, m, string))
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    sent = asked.mapInArrow(travel, "mh long, doc long, tag int, start long, n int, string binary")
    sent = sent.repartition(n_parts, "mh").sortWithinPartitions("mh", "doc", "start")

    def judge(batches):
        """Rows (doc, tag, start, n): stretches of repeated windows."""
        import pyarrow as pa

        schema = pa.schema([("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("n", pa.int32())])
        rows, size, done = [], 0, 0  # rows of whole groups; the first `done` of them are judged and only kept as first contents
        out: list[tuple] = []

        def work(group_goes_on: bool):
            nonlocal rows, size, done
            if not rows:
                return
            marks = _judge(np.array([r[1] for r in rows], np.int64), [r[5] for r in rows], kind)
            for r, mark in list(zip(rows, marks, strict=True))[done:]:
                for s, e in zip(*runs(mark)):
                    out.append((r[1], r[2], r[3] + int(s), int(e - s)))
            rows = [r for r, mark in zip(rows, marks, strict=True) if r[0] == rows[-1][0] and not mark.all()] if group_goes_on else []
            done, size = len(rows), 0

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[5] is None:
                    out.append(r[1:5])
                    continue
                if size > CHUNK and (r[0] != rows[-1][0] or size > 4 * CHUNK):
                    work(r[0] == rows[-1][0])
                if done and rows[0][0] != r[0]:
                    work(False)
                rows.append(r)
                size += len(r[5])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        work(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    found = sent.mapInArrow(judge, "doc long, tag int, start long, n int")
    spans = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    # texts with very many copies, fewer than HOT * n_parts, do not meet in one task
    often = F.broadcast(rep.where(F.col("copies") > max(16, rows // (HOT * n_parts))).select("sha", "rep"))
    named = base.join(often, "sha").unionByName(base.join(often, "sha", "left_anti").join(rep.select("sha", "rep"), "sha"))
    return named, d, spans


def joined(start: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    """Stretches of windows, merged where one begins at or before another's end."""
    if not len(start):
        return [], []
    order = np.argsort(start, kind="stable")
    s, e = start[order], start[order] + n[order]
    top = np.maximum.accumulate(e)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > top[:-1]
    at = np.flatnonzero(new)
    return s[at].tolist(), (np.append(top[at[1:] - 1], top[-1]) - s[at]).tolist()


def covered(spans: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal (start, end) ranges of symbols under the windows of the spans."""
    if not spans:
        return []
    a = np.array(spans, dtype=np.int64)
    s, m = joined(a[:, 0], a[:, 1] + window - 1)
    return [(x, x + y) for x, y in zip(s, m)]
