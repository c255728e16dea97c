"""Small documents with all the awkward cases, and brute-force versions."""

import hashlib
import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mh string, norm string"


def documents():
    r = random.Random(3)
    pool = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(5, 90))) for _ in range(12)]
    texts = [" ".join(r.choice(pool)[r.randrange(20) :][: r.randrange(10, 500)] for _ in range(r.randrange(0, 5))) for _ in range(80)]
    texts += [None, "", "   \n", "a" * 700, "b" + "a" * 400, "ab " * 300, "x ab ab " * 100, texts[3], "é" * 150 + texts[5], "word " * 40, "word " * 50, "単語" * 90, "🎉 <|endoftext|> \x00 x", pool[0] * 40]
    words = pool[1].split()
    words[len(words) // 2] = "changed"
    texts += [pool[1] * 3, " ".join(pool[1].split() * 3 + words[-2:]), texts[7]]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s10", None]), None, "x", None) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, texts[9], None, None, None, None, None)]


#: Names that the operators use or once used inside.
CLASH = ["place", "shards", "shard", "times", "__times", "sha", "__sha", "score", "__score", "lang_pred", "doc", "tag", "ch", "pos", "salt", "node", "bands", "bucket", "row", "keep", "__keep", "keep_sha", "size", "taken", "chunk", "block", "target", "u", "h", "n"]


def frame(spark, rows=None):
    """The rows, with further columns of all these names: the name and the identifier."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return d.withColumns({c: F.concat_ws(" ", F.lit(c), F.col("doc_id").cast("string")) for c in CLASH})


def sha(b):
    return hashlib.sha256(b).hexdigest()


def order(d):
    return (d is None, d or 0)


def byte_repeats(rows, w=100):
    """By row; equal rows with one identifier are judged as one."""
    seen, out, first = set(), {}, {}
    for d, x in sorted({(d, x) for d, x in rows}, key=lambda p: (order(p[0]), p[1] or "")):
        raw = (x or "").encode()
        mask = bytearray(len(raw))
        for i in range(len(raw) - w + 1):
            g = raw[i : i + w]
            if g in seen:
                mask[i : i + w] = b"\1" * w
            seen.add(g)
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        out[d, x] = (len(raw), sum(mask), sum(1 for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1])), sha(kept))
    return sorted(((d, *out[d, x]) for d, x in rows), key=lambda r: (order(r[0]), r[1:]))


def word_repeats(rows, w=13):
    first, out = {}, []
    for d, x in sorted(rows, key=lambda p: order(p[0])):
        ws = (x or "").encode().split()
        for i in range(len(ws) - w + 1):
            first.setdefault(tuple(ws[i : i + w]), d)
    for d, x in rows:
        ws = (x or "").encode().split()
        m = [0] * len(ws)
        for i in range(len(ws) - w + 1):
            if order(first[tuple(ws[i : i + w])]) < order(d):
                m[i : i + w] = [1] * w
        out.append((d, len(ws), sum(m), sha(b" ".join(a for a, b in zip(ws, m, strict=True) if not b))))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def near_classes(rows, k=5, least=0.8):
    """The smallest identifier of the class of each identifier, by all pairs."""
    bags = {}
    for d, x in rows:
        ws = (x or "").encode().split()
        bags[d] = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else Counter([tuple(ws)])
    root = {d: d for d in bags}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((bags[a] & bags[b]).values())
            if both >= least * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in ids}
