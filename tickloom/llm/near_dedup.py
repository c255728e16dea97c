"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles (weight: how often the
shingle occurs; a text of fewer words is one shingle).  Every unit of weight
of every element is a region into which hashed darts are thrown: a Poisson
process on the rank axis, the same in all texts.  A dart falls on one of
`BANDS * ROWS` coordinates, and a coordinate keeps its earliest dart; only
darts earlier than a bound that leaves few coordinates empty are made, and
the bound is doubled where one is empty.  Two texts agree on a coordinate with
the probability of their weighted Jaccard similarity.

Texts with the same words form one node.  Nodes that agree on all rows of a
band meet in a bucket.  Each pair that is looked at is held against the exact
similarity of the two whole texts, and only pairs of `THRESHOLD` or more link.
Classes are connected components.  Two steps find them without all pairs:

1. In each bucket the node that meets most others over all bands is the centre
   and is paired with all others.
2. Buckets that are not one component then are searched exactly for the links
   that are still missing.  The units of their nodes are ranked by how many of
   these nodes have them, the rarest first.  Two sets of sizes x and y with the
   similarity t share at least a = t (x + y) / (1 + t) units, so their first
   common unit is among the first x - a + 1 of one and y - a + 1 of the other
   (prefix filtering).  Nodes that share such a unit form a group; in a group,
   nodes of the smallest components are paired with all nodes of other
   components that the places and sizes allow, up to `CENTRES` in a round, and
   leave the group after their round, until it is one component.

So all pairs that meet and link are connected in the end, in one component.
Groups whose texts differ in few common units and stay unlinked still take as
many pairs as the square of their number.

Special cases: texts without words (null, empty, white space) form one class;
rows that share an identifier are classed by their own texts, each under the
smallest identifier of its own class; a null identifier comes after all others
(a class of such rows alone has a null class_id); repeated rows share a class,
and `one_of_each` keeps one of them; very long texts are compared whole; an
empty table gives an empty result; other columns, of any name, are ignored by
`classes` and returned unchanged by `one_of_each`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import discard, fresh, giving_back, partitions, table, written
from ._text import U64, RangeHash, buffers, concatenated, constants, mix64, slices, word_bounds, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
PART = 512
#: Centres of a group in a round at most.
CENTRES = 256
_PLACE = constants(64, 31)
_BAND = constants(64, 47)


def shingles(words: np.ndarray, first: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every row, and where each row starts."""
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = concatenated(first[:-1], n)
    row = np.repeat(np.arange(len(count)), n)
    left = first[1:][row] - at
    out = np.zeros(len(at), dtype=U64)
    padded = np.concatenate([words, np.zeros(size, U64)])
    for j in range(size):
        out += np.where(left > j, padded[at + j] * _PLACE[j], U64(0))
    return mix64(out), np.concatenate([[0], np.cumsum(n)])


def units(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The units of weight: the n-th occurrence of an element in its row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((elements, row))
    e, r = elements[order], row[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    place = np.arange(len(e))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.where(nth == 0, e, mix64(e + nth.astype(U64) * U64(0xA0761D6478BD642F)))


def darts(unit: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Signatures (rows, k); rows without units are 0."""
    weight = np.diff(first)
    sig = np.zeros((len(weight), k), dtype=U64)
    todo = np.flatnonzero(weight)
    bound = k * (np.log(k) + 4.0)
    while len(todo):
        row = np.repeat(np.arange(len(todo)), weight[todo])
        key = unit[concatenated(first[todo], weight[todo])]
        limit = (bound / weight[todo])[row]
        rank = np.zeros(len(key))
        cells, ranks, ids = [], [], []
        step = 0
        while len(key):
            step += 1
            h = mix64(key + U64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log1p(-((h >> U64(11)).astype(np.float64) * 2.0**-53))
            live = rank <= limit
            key, row, limit, rank, h = key[live], row[live], limit[live], rank[live], h[live]
            dart = mix64(h ^ U64(0x5851F42D4C957F2D))
            cells.append(row * k + (dart % U64(k)).astype(np.int64))
            ranks.append(rank)
            ids.append(dart)
        cells, ranks, ids = np.concatenate(cells), np.concatenate(ranks), np.concatenate(ids)
        order = np.lexsort((ranks, cells))
        cells, ids = cells[order], ids[order]
        new = np.ones(len(cells), bool)
        new[1:] = cells[1:] != cells[:-1]
        part = np.zeros(len(todo) * k, dtype=U64)
        hit = np.zeros(len(todo) * k, dtype=bool)
        part[cells[new]], hit[cells[new]] = ids[new], True
        full = hit.reshape(-1, k).all(1)
        sig[todo[full]] = part.reshape(-1, k)[full]
        todo = todo[~full]
        bound *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    total = np.zeros((len(sig), bands), dtype=U64)
    for i in range(rows):
        total += parts[:, :, i] * _PLACE[i]
    return mix64(total + _BAND[:bands])


def _texts(column):
    """Word hashes of slices of a string column: (lo, hi, hashes, first word of each row)."""
    raw, at = buffers(column)
    for lo, hi in slices(at):
        data, offs = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = word_bounds(data, offs)
        yield lo, hi, word_hashes(data, starts, ends), first


def signed(docs: DataFrame, text: str, key: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h1, h2 (of the word sequence) and band keys (none without words)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, words, first in _texts(batch.column(1)):
                n = np.diff(first)
                h1 = RangeHash(words).ranges(first[:-1], n)
                h2 = RangeHash(mix64(words ^ U64(0x1234567))).ranges(first[:-1], n)
                found = shingles(words, first)
                keys = band_keys(darts(units(*found), found[1], bands * rows), bands, rows)
                some = n > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], ["doc_id", "h1", "h2", "bands"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(giving_back(run), f"doc_id {dict(docs.dtypes)[key]}, h1 long, h2 long, bands array<long>")


def verified(edges: DataFrame, docs: DataFrame, text: str, key: str, threshold: float) -> DataFrame:
    """The edges (node, centre) with their exact similarity and whether they link.

    The rows of a centre are dealt out in parts of `PART`, each with a copy of
    the centre, and stream past it: memory holds one centre's shingles."""
    spark = docs.sparkSession
    parts = edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    own = parts.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("other"))
    rows = edges.join(parts, "centre").select("node", "centre", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("other")).unionByName(own)
    d = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))
    rows = rows.join(d, "node")

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, words, first in _texts(batch.column(4)):
                e, at = shingles(words, first)
                u = units(e, at)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                u = u[np.lexsort((u, row))]
                raw = u.tobytes()
                sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(4)), sets], ["node", "centre", "part", "other", "units"])

    kind = dict(edges.dtypes)["node"]
    rows = rows.select("node", "centre", "part", "other", "text").mapInArrow(giving_back(packed), f"node {kind}, centre {kind}, part int, other int, units binary")
    rows = rows.repartition(partitions(spark), "centre", "part").sortWithinPartitions("centre", "part", "other")

    def compare(batches):
        import pyarrow as pa

        mine = np.zeros(0, dtype=U64)
        for batch in batches:
            nodes, centres, score = [], [], []
            for node, centre, other, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), batch.column(4), strict=True):
                u = np.frombuffer(raw.as_buffer(), dtype=U64)
                if not other:
                    mine = u
                    continue
                both = len(np.intersect1d(mine, u, assume_unique=True))
                nodes.append(node)
                centres.append(centre)
                score.append(both / max(1, len(mine) + len(u) - both))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema[0].type), pa.array(centres, batch.schema[1].type), pa.array(score, pa.float64())], ["node", "centre", "similarity"])

    out = rows.mapInArrow(giving_back(compare), f"node {kind}, centre {kind}, similarity double")
    return out.withColumn("link", F.col("similarity") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of the edges
    (a, b).  Labels pass along the edges and then jump to their label's label,
    until none changes; every round is written, and nothing is collected."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    last = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    label = last
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = label.select(F.col("node").alias("at"), F.col("root").alias("far"))
        step = step.join(jump, step["mid"] == jump["at"], "left").select("node", "old", F.least("mid", "far").alias("root"))
        step = written(step, "labels")
        changed = step.where("root <> old").limit(1).count()
        label = step.select("node", "root")
        discard(last)
        last = step
        if not changed:
            discard(both)
            return label


def _parts(met: Column) -> Column:
    """In how many parts a group of so many nodes is dealt out."""
    return F.ceil(met / PART).cast("int")


def _dealt(rows: DataFrame, centres: DataFrame, group: str) -> DataFrame:
    """The rows of each group with each of its centres; groups are dealt out in
    parts of `PART` rows, each with a copy of the centres."""
    c = centres.withColumn("part", F.explode(F.sequence(F.lit(0), _parts(F.col("met")) - 1))).drop("met")
    return rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), _parts(F.col("met"))).cast("int")).join(c, [group, "part"])


def _merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """The links (a, b) as links between the components of their ends."""
    a, b = root.select(F.col("node").alias("a"), F.col("root").alias("ra")), root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return links.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def _joined(root: DataFrame, found: DataFrame) -> DataFrame:
    """The roots (node, root) after the links among `found`."""
    linked = written(_merged(root, found.where("link").select(F.col("node").alias("a"), F.col("centre").alias("b"))), "links")
    if linked.isEmpty():
        return root
    moved = components(linked).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(root.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def _prefixes(texts: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """node, n (units), unit, place: the units that can be the first that a node
    has in common with one it links to, by their place in the common order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, words, first in _texts(batch.column(1)):
                found = shingles(words, first)
                u, n = units(*found), np.diff(found[1])
                own = pa.array(np.repeat(np.asarray(batch.column(0).slice(lo, hi - lo)), n), batch.schema[0].type)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.repeat(n, n).astype(np.int32)), pa.array(u.view(np.int64))], ["node", "n", "unit"])

    kind = dict(nodes.dtypes)["node"]
    u = written(texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(giving_back(run), f"node {kind}, n int, unit long"), "units")
    often = u.groupBy("unit").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    u = u.join(often, "unit", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    u = u.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("often", "unit")) - 1)
    # a node's own size is the least that the other's can do for it: x - t x
    return u.where((F.col("often") > 1) & (F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-6))).select("node", "n", "unit", "place")


def _classes(docs: DataFrame, signatures: DataFrame, text: str, key: str, threshold: float) -> DataFrame:
    """doc_id, class_id of every row; no identifier is null or shared."""
    s = signatures
    nodes = written(s.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    met = nodes.select("node", F.explode("bands").alias("bucket"))
    met = written(met.join(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "bucket"), "buckets")
    degree = written(met.groupBy("node").agg(F.sum("met").alias("degree")), "degrees")
    texts = written(docs.select(F.col(key).alias("node"), F.col(text).alias("text")).join(degree.select("node"), "node", "left_semi"), "met")
    # 1. the centres of the buckets
    centres = met.join(degree, "node").groupBy("bucket", "met").agg(F.min(F.struct(-F.col("degree"), "node"))["node"].alias("centre"))
    pairs = written(_dealt(met, centres, "bucket").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
    found = written(verified(pairs.select(F.col("a").alias("node"), F.col("b").alias("centre")), texts, "text", "node", threshold), "checked")
    root = _joined(degree.select("node", F.col("node").alias("root")), found)
    # 2. what links may be missing
    split = met.join(root, "node").groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    left = written(met.join(split, "bucket").select("node").distinct(), "left")
    if not left.isEmpty():
        live = written(_prefixes(texts, left, threshold), "prefixes")
        live = live.join(live.groupBy("unit").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "unit").join(root, "node")
        checked, count, used = pairs, 16, ()
        while True:
            several = live.groupBy("unit").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("unit")
            live = live.join(several, "unit")
            same = live.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("same"))
            last, live = used, written(live.join(same, ["unit", "root"]), "live")
            discard(*last)
            if live.isEmpty():
                break
            order = Window.partitionBy("unit").orderBy("same", "place", "node")
            c = written(live.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= count).select("unit", "met", F.col("node").alias("centre"), F.col("root").alias("c_root"), F.col("n").alias("c_n"), F.col("place").alias("c_place")), "centres")
            shared = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("c_n")) - 1e-6)
            fits = (F.col("root") != F.col("c_root")) & (F.col("place") <= F.col("n") - shared) & (F.col("c_place") <= F.col("c_n") - shared)
            fresh_ = _dealt(live, c, "unit").where(fits).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
            pairs = written(fresh_.join(checked, ["a", "b"], "left_anti"), "pairs")
            found = written(verified(pairs.select(F.col("a").alias("node"), F.col("b").alias("centre")), texts, "text", "node", threshold), "checked")
            checked = checked.union(pairs)
            root = _joined(root, found)
            used = (live, c, found)
            live = live.join(c.select("unit", F.col("centre").alias("node")), ["unit", "node"], "left_anti").drop("root", "same").join(root, "node")
            count = min(CENTRES, 16 * count)
    of = nodes.join(root, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("class_id"))
    return s.join(of, ["h1", "h2"]).select("doc_id", "class_id")


def _shared(ids: DataFrame) -> bool:
    """Is an identifier null, or that of several rows?"""
    return ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL").limit(1).count() > 0


def _numbered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """row, doc_id, sha, text of every row; `row` numbers the distinct pairs of identifier and text."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"))
    rows = written(d.select(F.col("doc_id").alias("r_id"), F.col("sha").alias("r_sha")).distinct().withColumn("row", F.monotonically_increasing_id()), "rows")
    return d.join(rows, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha"))).select("row", "doc_id", "sha", "text")


def _first_of_each(docs: DataFrame, text: str, key: str, threshold: float, bands: int, rows: int) -> tuple[DataFrame, bool]:
    """doc_id, class_id of every row, and whether identifiers are null or shared.
    If they are, rows are numbered and there are two columns more: sha, and
    top_sha of the class's first row (by identifier, null last, then by sha)."""
    s = written(signed(docs, text, key, bands, rows), "signatures")
    if not _shared(s):
        return _classes(docs, s, text, key, threshold), False
    d = written(_numbered(docs, text, key), "numbered")
    one = d.groupBy("row").agg(F.first("text").alias("text"))
    found = _classes(one, written(signed(one, "text", "row", bands, rows), "signatures"), "text", "row", threshold)
    found = d.select("row", "doc_id", "sha").join(found.select(F.col("doc_id").alias("row"), F.col("class_id").alias("of")), "row")
    found = written(found, "classes")
    top = found.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "sha")).alias("top"))
    return found.join(top, "of").select("doc_id", F.col("top.doc_id").alias("class_id"), "sha", F.col("top.sha").alias("top_sha")), True


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the smallest identifier of the class) of every row."""
    return _first_of_each(docs, text, key, threshold, bands, rows)[0].select("doc_id", "class_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of `docs` of each class, with all its columns: the one with the
    smallest identifier, and of those that share it, the one whose text has the
    smallest hash."""
    found, shared = _first_of_each(docs, text, key, threshold, bands, rows)
    keep, keep_sha, sha, place = fresh(docs, "keep", "keep_sha", "sha", "place")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    if not shared:
        return docs.join(kept.select(F.col("doc_id").alias(keep)), F.col(key) == F.col(keep), "left_semi")
    kept = kept.where("sha = top_sha").select(F.col("doc_id").alias(keep), F.col("sha").alias(keep_sha)).distinct()
    d = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    d = d.join(kept, F.col(key).eqNullSafe(F.col(keep)) & (F.col(sha) == F.col(keep_sha)), "left_semi")
    d = d.withColumn(place, F.row_number().over(Window.partitionBy(key, sha).orderBy(F.length(F.coalesce(F.col(text), F.lit(""))))))
    return d.where(F.col(place) == 1).select(*docs.columns)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
