"""Each operator against a brute-force version, an exact round trip or
held-out rows, on documents with nulls, empty and long texts, repeated rows,
further columns with clashing names, and on an empty table."""

import functools
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T
from tickloom.llm import _spark, bpe, byte_repeats, catalogue, exact_dedup, language_id, lm_scoring, media_ts, mixing, near_dedup, toxicity, word_repeats
from tickloom.llm._windows import refine, runs_of

from . import fixtures as X


@pytest.fixture(params=[10_000, 3], ids=["large batches", "tiny batches"])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1]) for r in X.documents()]


def test_bpe_is_the_library(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    got = bpe.round_trip(X.frame(spark), with_ids=True).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), X.sha(bytes(r.ids)))
        assert r.decoded == library.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == X.sha(r.decoded.encode())


def test_bpe_stream_is_the_merges():
    m, r = bpe.merges(bpe.vocabulary()), random.Random(5)
    for alphabet in ("aetoinsrh", "ab", "=-_"):
        for n in (1, 7, 60, 900):
            word = "".join(r.choice(alphabet) for _ in range(n)).encode()
            assert list(m.stream(word[i : i + 5] for i in range(0, n, 5))) == m.merge(word)
    assert "".join(m.decode([220, 160, 163])).count("\ufffd") >= 1


def test_byte_repeats(spark, rows, batches):
    got = [tuple(r)[:5] for r in byte_repeats.cut(X.frame(spark)).collect()]
    assert sorted(got, key=lambda r: (X.order(r[0]), r[1:])) == X.byte_repeats(rows)


def test_word_repeats(spark, rows, batches):
    got = [tuple(r)[:4] for r in word_repeats.cut(X.frame(spark)).collect()]
    assert sorted(got, key=lambda r: (X.order(r[0]), r[1:])) == X.word_repeats(rows)


def crossing():
    """Groups of one minimiser whose first content repeats inside itself and then meets exactly one other content."""
    r, rows = random.Random(11), []
    part = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    for _ in range(24):
        g, pre, mid, post = part(32), part(90), part(20), part(90)
        rows += [pre + g + mid + g + post] * 7 + [pre + g + mid[:10] + part(80)] * 2
    return [(i, x + str(i), None, None, None, None, None) for i, x in enumerate(rows)]


def hot(r=random.Random(12)):  # noqa: B008
    """One line in every text, between words that differ; some lines are shared by two texts."""
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(1, 5)))
    line = " ".join(word() for _ in range(14)) + " " + "x" * 40
    texts = []
    for _ in range(150):
        near = texts[-1].split(line)[0] if texts and r.random() < 0.3 else " ".join(word() for _ in range(r.randrange(20)))
        texts.append(near + " " * (not near.endswith(" ")) + line + " " + " ".join(word() for _ in range(r.randrange(30))))
    return [(i, x, None, None, None, None, None) for i, x in enumerate(texts)]


@pytest.mark.parametrize("size", [3, 4, 7, 10_000])
@pytest.mark.parametrize("make", [crossing, hot])
def test_repeats_do_not_depend_on_batches(spark, size, make):
    rows = make()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = [tuple(r)[:5] for r in byte_repeats.cut(X.frame(spark, rows)).collect()]
    words = [tuple(r)[:4] for r in word_repeats.cut(X.frame(spark, rows)).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = [r[:2] for r in rows]
    assert sorted(got) == X.byte_repeats(texts) and sorted(words) == X.word_repeats(texts)


@pytest.mark.parametrize("kind", [byte_repeats.KIND, word_repeats.KIND], ids=["bytes", "words"])
def test_hot_runs_cover_the_same_windows(kind):
    raw = "\n".join(x[1] for x in hot()).encode()
    symbols, first = kind.symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    plain = runs_of(symbols, first, kind)
    cut = runs_of(symbols, first, kind, np.unique(plain[3])[::2])
    windows = lambda found: sorted(w for s, n in zip(found[1], found[2], strict=True) for w in range(s, s + n))
    assert windows(plain) == windows(cut) == list(range(first[-1] - kind.window + 1)) and cut[6].any() and not cut[6].all()
    of = {}
    for s, n, key in zip(cut[1], cut[2], cut[3], strict=True):
        for w in range(s, s + n):
            assert of.setdefault(symbols[w : w + kind.window].tobytes(), key) == key


def test_refine_finds_the_earliest_equal():
    import numpy as np

    r = random.Random(1)
    s = "".join(r.choice("ab") for _ in range(300))
    starts = np.arange(300 - 13 + 1)
    got = refine(np.frombuffer(s.encode(), np.uint8).astype(np.int64), np.full(300, 300), starts, 13, 1)
    assert got.tolist() == [next(j for j in range(i + 1) if s[j : j + 13] == s[i : i + 13]) for i in starts]


def test_exact_dedup_is_the_sql(spark):
    rows = [r for r in X.documents() if r[0] is not None][:-1]
    d = X.frame(spark, rows).toPandas()
    con = duckdb.connect()
    con.register("documents", d[["doc_id", "text"]])
    want = sorted(con.sql(exact_dedup.OP6_SQL).fetchall())
    assert sorted(tuple(r) for r in exact_dedup.copies(X.frame(spark, rows)).collect()) == want
    kept = {r[0] for r in want if r[3]}
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(X.frame(spark, rows)).collect()) == sorted(kept)


def test_exact_dedup_hot_group(spark):
    rows = [(i, "hot text", None, None, None, None, None) for i in range(1500)] + [(5000, "hot  text", None, None, None, None, None), (5001, "other", None, None, None, None, None)]
    got = {r.doc_id: r for r in exact_dedup.copies(X.frame(spark, rows)).collect()}
    assert len(got) == 1502 and {(r.keep_id, r.group_size) for d, r in got.items() if d != 5001} == {(5000, 1501)}
    assert [d for d, r in got.items() if r.kept] == [5000, 5001] or {d for d, r in got.items() if r.kept} == {5000, 5001}
    assert exact_dedup.drop_copies(X.frame(spark, rows)).count() == 2


def test_exact_dedup_repeated_rows(spark):
    got = exact_dedup.copies(X.frame(spark)).collect()
    assert len(got) == len(X.documents()) and sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_dedup.drop_copies(X.frame(spark)).count() == len({r.text_sha256 for r in got})


def test_media(spark, rows):
    got = media_ts.media_columns(X.frame(spark), with_media=True).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), X.sha(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), X.sha(bytes(r.media))) and len(r.media) % 188 == 0
        assert r.feature.endswith("faults=0") and len(r.pts) == len(r.random_access)


def test_media_finds_faults():
    payload = bytes(range(256)) * 1200
    stream = media_ts.write_stream(payload)
    s = media_ts.read_stream(stream)
    assert s.payload == payload and s.times == [90000 + 3600 * k for k in range(5)] and len(s.random_access) == len(s.clocks) == 5
    lost = media_ts.read_stream(stream[: 188 * 10] + stream[188 * 11 :])
    assert lost.continuity_errors == 1 and lost.broken_units == 1
    bad = bytearray(stream)
    bad[188 * 20] = 0
    assert media_ts.read_stream(bytes(bad)).sync_errors == 1
    bad = bytearray(stream)
    bad[10] ^= 1
    assert media_ts.read_stream(bytes(bad)).crc_errors == 1
    assert media_ts.read_stream(b"").packets == 0


def test_mixing(spark):
    docs = X.documents()
    got = mixing.mix(X.frame(spark)).collect()
    assert len(got) == len(docs) and sorted(got, key=repr) == sorted(mixing.mix(X.frame(spark)).collect(), key=repr)
    sizes = Counter()
    for _, t, _, s, *_ in docs:
        sizes[s] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [5.0, 2.0, 1.0, 5.0]), strict=True))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert not r.size or r.taken <= len(r.shards) * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == round(goal[s]) for s in names)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 100, 100], [5.0, 2.0, 1.0]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 0], [5.0, 2.0]) == [0, 0] and mixing.targets([], []) == []


def test_near_dedup(spark):
    rows = [r for r in X.documents() if r[0] is not None]
    want = X.near_classes([r[:2] for r in rows])
    got = near_dedup.classes(X.frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got} == want
    kept = near_dedup.one_of_each(X.frame(spark, rows[:-1])).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_near_dedup_null_and_shared_identifiers(spark):
    """Rows are classed by their own texts; identifiers only name them."""
    r = random.Random(8)
    base = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(3)]
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    texts = [(7, base[0]), (7, base[1]), (9, near(base[0])), (5, near(base[1])), (None, near(base[2])), (None, base[2]), (8, base[2]), (4, "a b c d e f"), (4, "a b c d e f"), (None, "g h i")]
    got = Counter((x.doc_id, x.class_id) for x in near_dedup.classes(X.frame(spark, [(*t, *[None] * 5) for t in texts])).collect())
    assert got == Counter([(7, 7), (7, 5), (9, 7), (5, 5), (None, 8), (None, 8), (8, 8), (4, 4), (4, 4), (None, None)])
    kept = near_dedup.one_of_each(X.frame(spark, [(*t, *[None] * 5) for t in texts])).collect()
    assert Counter((x.doc_id, x.text) for x in kept) == Counter([(7, base[0]), (5, near(base[1])), (8, base[2]), (4, "a b c d e f"), (None, "g h i")])


def test_stages_return_all_columns(spark):
    d = X.frame(spark, [(*r[:2], r[2] or "en", *r[3:]) for r in X.documents()])
    rows = Counter(d.collect())
    model = language_id.train(d)
    for out, least in ((language_id.known(d, model, 0.5), 20), (exact_dedup.drop_copies(d), 20), (near_dedup.one_of_each(d), 20), (mixing.mixed_rows(d), 20)):
        got = Counter(out.collect())
        assert out.columns == d.columns and set(got) <= set(rows) and sum(got.values()) >= least
    assert {c: v for c, v in d.dtypes} == {c: v for c, v in out.dtypes}


def test_near_dedup_chain_of_edits(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words), None, None, None, None, None))
        words = [*words]
        words[r.randrange(200)] = f"n{i}"
    want = X.near_classes([x[:2] for x in rows])
    assert {x.doc_id: x.class_id for x in near_dedup.classes(X.frame(spark, rows)).collect()} == want


def test_near_dedup_templated_family(spark):
    r = random.Random(5)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = [*template]
        for slot in r.sample(range(2, 118, 5), 3):
            words[slot] = f"v{slot}x{r.randrange(4)}"
        rows.append((i, " ".join(words), None, None, None, None, None))
    want = X.near_classes([x[:2] for x in rows])
    assert 1 < len(set(want.values())) < 300
    assert {x.doc_id: x.class_id for x in near_dedup.classes(X.frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scoring(spark, order):
    rows = [r for r in X.documents() if r[0] is not None][:-1]
    got = {r.doc_id: r for r in lm_scoring.score(X.frame(spark, rows), order=order, chunk_bytes=3000).collect()}
    toks = {r[0]: (r[1] or "").encode().split() for r in rows}
    grams = {d: [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(order + 1)] for d, w in toks.items()}
    total = [sum((g[n] for g in grams.values()), Counter()) for n in range(order + 1)]
    words = sum(map(len, toks.values()))
    assert len(got) == len(rows)
    for d, w in toks.items():

        def s(g, d=d, w=w):
            c = lambda x: total[len(x)][x] - grams[d][len(x)][x]
            if len(g) == 1:
                return c(g) / (words - len(w)) if c(g) > 0 else 0.4 / (words - len(w) + 1)
            return c(g) / c(g[:-1]) if c(g) > 0 else 0.4 * s(g[1:])

        assert got[d].n_words == len(w) and got[d].log_score == pytest.approx(sum(math.log(s(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))))


def test_remaining_counts():
    """Also where n-grams differ in the bits that hold their places."""
    r = np.random.default_rng(1)
    for _ in range(100):
        n = int(r.integers(1, 60))
        row = np.sort(r.integers(0, 4, n))
        base = r.integers(1, 1 << 62, 6).astype(np.uint64)
        base = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(3)])
        grams = [np.where(r.random(n) < 0.1, np.uint64(0), r.choice(base ^ np.uint64(k << 40), n)) for k in range(2)]
        known = np.unique(np.concatenate(grams))
        known = known[known > 0]
        got = lm_scoring.remaining(grams, row, np.arange(100, 100 + len(known)))
        for g, left in zip(grams, got, strict=True):
            assert left.tolist() == [0 if x == 0 else 100 + np.searchsorted(known, x) - ((g == x) & (row == d)).sum() for x, d in zip(g, row, strict=True)]


def test_lm_scoring_registers_trigrams(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.log_score for r in lm_scoring.op3_lm_scoring(spark, sf).collect()}
    want = {r.doc_id: r.log_score for r in lm_scoring.score(spark.read.parquet(f"{sf}/documents.parquet"), order=3).collect()}
    assert got == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_are_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    got = [r for r in language_id.op5_language_id(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    odd = language_id.identify(X.frame(spark), language_id.train(X.frame(spark))).collect()
    assert len(odd) == len(X.documents()) and {r.lang_pred for r in odd if r.doc_id in (80, 81, 82)} == {"und"}


def test_language_id_has_no_caps():
    """300 languages, thousands of letters, words of vanishing probability; the table's two forms agree."""
    r = random.Random(6)
    scripts = [[chr(0x4E00 + 40 * i + k) for k in range(40)] for i in range(300)]
    text = lambda i, n: " ".join("".join(r.choice(scripts[i]) for _ in range(r.randrange(1, 9))) for _ in range(n))
    sample = [(text(i, 20), f"l{i:03}") for i in range(300)]
    model = language_id.fit(sample, ["a", "ab"], rounds=1)
    assert len(model.langs) == 300 and len(model.letters) > 8000
    found, _ = language_id.predict(model, [text(i, 5) for i in range(0, 300, 7)])
    assert found == [f"l{i:03}" for i in range(0, 300, 7)]
    two = language_id.fit([("abc bca " * 40, "x"), ("cba acb " * 40, "y")], ["a", "b", "ab", "▁c"], rounds=1)
    two.prob /= 1e11
    words = language_id.split_words(["abc" * 13], two.code())
    least = language_id.log_likelihood(two, words.codes, words.sizes)
    assert np.isfinite(least).all() and least.max() < np.log(1e-300) and least[0, 0] != least[0, 1]
    whole, language_id.DENSE = language_id.DENSE, 0
    try:
        other = language_id.fit([("abc bca " * 40, "x"), ("cba acb " * 40, "y")], ["a", "b", "ab", "▁c"], rounds=1)
        other.prob /= 1e11
        assert other.next is not None and np.array_equal(language_id.log_likelihood(other, words.codes, words.sizes), least)
    finally:
        language_id.DENSE = whole


def test_long_texts_are_learned_from(spark):
    rows = [(i, ("bonjour monde " if i % 2 else "hello world ") * 3000, "fr" if i % 2 else "en", None, None, None, None) for i in range(40)]
    d = X.frame(spark, rows)
    model = language_id.train(d)
    assert language_id.predict(model, ["bonjour", "hello"])[0] == ["fr", "en"]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    low, high = toxicity.scores(toxicity.train(d, labels), ["hello world", "bonjour monde"])
    assert low < 0.5 < high


def test_forward_sums_all_segmentations():
    model = language_id.fit([("abab ba abba", "x"), ("bbb aab", "y")], ["a", "b", "ab", "ba", "▁a", "▁ab", "bb"], rounds=2)
    words = language_id.split_words(["abba"], model.code())
    got = language_id.log_likelihood(model, words.codes, words.sizes)[0]
    prob = {}
    for p in ["a", "b", "ab", "ba", "▁a", "▁ab", "bb", "▁"]:
        node = 1
        for c in p:
            node = model.step[node, 1 if c == "▁" else 3 + model.letters.index(c)]
        prob[p] = model.prob[node]

    def total(s):
        return 1.0 if not s else sum(prob[s[:i]] * total(s[i:]) for i in range(1, len(s) + 1) if s[:i] in prob)

    assert got == pytest.approx([math.log(x) for x in total("▁abba")])


def test_toxicity_on_held_out_rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    bad = ["stupid", "moron", "trash"]
    texts = [" ".join(word() for _ in range(60)) for _ in range(2000)]
    labels = [i % 5 == 0 for i in range(2000)]
    spoilt = lambda t, ws: t + " " + " ".join(r.choice(ws) for _ in range(4))
    model = toxicity.fit([spoilt(t, bad) if y else t for t, y in zip(texts[:1600], labels, strict=False)], [int(y) for y in labels[:1600]], 0.2)
    score = toxicity.scores(model, [spoilt(t, ["stupidd", "morron", "trashh"]) if y else t for t, y in zip(texts[1600:], labels[1600:], strict=True)])
    toxic = [s for s, y in zip(score, labels[1600:], strict=True) if y]
    clean = [s for s, y in zip(score, labels[1600:], strict=True) if not y]
    assert sum(a > b for a in toxic for b in clean) >= 0.95 * len(toxic) * len(clean)
    assert len(toxicity.scores(model, [None, "", "x"])) == 3


def test_toxicity_score_is_the_mean_of_words(spark):
    """Brute force, n-gram by n-gram, and the registered query on held-out rows."""
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.3)
    words = ["stupid", "éa", "x", "moron"]
    alone = [float(np.mean([model.weight[b] for b in toxicity.bags([w]).buckets])) for w in words]
    assert [len(toxicity.bags([w]).buckets) for w in words] == [1 + 6 + 5 + 4, 1 + 2 + 1, 1 + 1, 1 + 5 + 4 + 3]
    want = 1 / (1 + math.exp(-(np.mean([alone[0], alone[1], alone[1], alone[2], alone[3]]) - 0.3)))
    assert toxicity.scores(model, ["Stupid éa, éa x (moron)"])[0] == pytest.approx(want, rel=1e-5)
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    found = toxicity.op2_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    toxic = [r.score for r in found if r.held_out and truth.get(r.doc_id) == 1]
    clean = [r.score for r in found if r.held_out and truth.get(r.doc_id) == 0]
    assert sum(a > b for a in toxic for b in clean) >= 0.75 * len(toxic) * len(clean)


def test_toxicity_reads_long_runs():
    r = random.Random(3)
    run = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(300))
    for at in (0, 63, 64, 150, 299):
        changed = run[:at] + "x" + run[at + 1 :]
        one, other = toxicity.bags([run]), toxicity.bags([changed])
        assert sorted(one.buckets) != sorted(other.buckets)
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0)
    model.weight[toxicity.bags([run[256:]]).buckets] = 1.0
    assert toxicity.scores(model, [run])[0] > 0.5 == toxicity.scores(model, [run[:64]])[0]
    assert len(toxicity.bags([run]).which) == 5 and len(toxicity.bags(["a" * 64, "b" * 65]).which) == 3


def test_empty_tables(spark):
    d = X.frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (bpe.round_trip(d), toxicity.score(d, toxicity.train(d, labels)), lm_scoring.score(d), byte_repeats.cut(d), language_id.identify(d, language_id.train(d)), exact_dedup.copies(d), exact_dedup.drop_copies(d), media_ts.media_columns(d), mixing.mix(d), mixing.mixed_rows(d), word_repeats.cut(d), near_dedup.classes(d), near_dedup.one_of_each(d)):
        assert out.count() == 0


def test_pipeline(spark):
    """Every stage, and the whole, against plain Python."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model, columns = language_id.train(docs), docs.columns
    rows = docs.collect()

    piece = {}
    letter = {3 + i: c for i, c in enumerate(model.letters)} | {1: "▁", 2: "?"}
    walk = [(1, "")]
    while walk:
        node, spelt = walk.pop()
        if model.piece[node]:
            piece[spelt] = model.prob[node]
        walk += [(int(t), spelt + letter[c]) for c, t in enumerate(model.step[node]) if t]

    @functools.cache
    def likelihood(word):
        parts = [np.ones(len(model.langs))]
        for end in range(1, len(word) + 1):
            parts.append(sum(parts[i] * piece[word[i:end]] for i in range(max(0, end - 40), end) if word[i:end] in piece))
        return np.log(parts[-1])

    def known(text):
        low = "".join((c if c in model.letters else "?") if c.isalpha() else " " for c in (text or "").lower())
        words = [w[i : i + 40] for w in low.split() for i in range(0, len(w), 40)]
        if not words:
            return False
        total = model.prior + sum(likelihood("▁" + w) for w in words)
        return 1 / np.exp(total - total.max()).sum() >= p.LEAST_SCORE

    squeezed = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf)
        got = docs.collect()
        if name == "language_id":
            want = [r for r in rows if known(r.text)]
        elif name == "exact_dedup":
            best = {}
            for r in sorted(rows, key=lambda r: (-len(r.text or ""), r.doc_id)):
                best.setdefault(squeezed(r.text), r)
            want = list(best.values())
        elif name == "near_dedup":
            of = X.near_classes([(r.doc_id, r.text) for r in rows])
            want = [r for r in rows if of[r.doc_id] == r.doc_id]
        elif name == "mixing":
            took = {r.doc_id: round(r.taken / r.size) if r.size else 0 for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
            want = [r for r in rows for _ in range(took[r.doc_id])]
            sizes, mixed = Counter(), Counter()
            for r in rows:
                sizes[r.source] += len((r.text or "").encode().split())
            for r in want:
                mixed[r.source] += len(r.text.encode().split())
            names = sorted(sizes, key=lambda x: (x is None, x or ""))
            longest = max(len((r.text or "").split()) for r in rows)
            for x, goal in zip(names, mixing.targets([sizes[x] for x in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]), strict=True):
                assert abs(mixed[x] - goal) <= longest
        else:
            library = Tokenizer.from_file(bpe.vocabulary())
            want = []
            for r in rows:
                ids = library.encode(r.text or "", add_special_tokens=False).ids
                want.append((r.doc_id, len(ids), X.sha(struct.pack(f"<{len(ids)}I", *ids)), X.sha(library.decode(ids, skip_special_tokens=False).encode())))
            assert sorted(tuple(r) for r in p.run(spark, sf).collect()) == sorted(want)
        assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and got
        assert name == "bpe" or docs.columns == columns
        rows = got


def test_pipeline_batches_are_small(spark):
    """The stages with Python workers hand over small Arrow batches; a limit of the session's own holds."""
    import corpus_pipeline as p

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    d = spark.range(0, 8000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 200) AS text", "'en' AS lang")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    try:
        for stage in ("language_id", "near_dedup", "bpe"):
            spark.conf.unset(name)
            dict(p.STAGES)[stage](spark, d, "")
            assert max(r.n for r in d.mapInArrow(sizes, "n long").collect()) < 5 << 20
        spark.conf.set(name, "1m")
        dict(p.STAGES)["bpe"](spark, d, "")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_driver_rows_pass_no_python_workers(spark):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType()), T.StructField("c", T.ArrayType(T.IntegerType()))])
    rows = [("x", 1, [1, 2]), (None, None, []), ("y", 3, None)]
    assert [tuple(r) for r in _spark.local(spark, rows, schema).collect()] == rows
    assert _spark.local(spark, [], schema).collect() == [] and _spark.local(spark, [], schema).schema == schema
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "ExistingRDD" not in mixing.mix(d)._jdf.queryExecution().toString()


def test_freed_memory_goes_back():
    held = []

    def anonymous():
        return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon"))

    def run(batches):
        for _ in batches:
            parts = [np.ones(500) for _ in range(40_000)]
            held.append(np.ones(500))  # keeps the top of the heap
            yield len(parts)

    before = anonymous()
    assert list(_spark.giving_back(run)(iter([0]))) == [40_000]
    assert anonymous() - before < 40_000
