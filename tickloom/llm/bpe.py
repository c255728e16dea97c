"""Byte-level BPE, encoded and decoded as bounded-memory transducers.

A text is cut by the published pre-token pattern; special tokens are cut out
first.  Inside a pre-token the encoder keeps, for each byte position p, the
last token of the encoding of the bytes before p.  A token t may follow a
token s exactly if encoding their joint bytes gives (s, t) again, so the one
valid last token of each position follows from earlier positions.  No token is
longer than `Merges.lookahead` bytes, so every encoding of any continuation
passes through one of the last `lookahead` positions: the tokens that all
chains from these positions share are stable, are emitted, and are forgotten.
Memory is a few times the lookahead, whatever the length.  The lookahead is
that of the merge list: the bytes of the longest token that it can make.

This transducer reads pre-tokens of more than half the lookahead.  A shorter one
is a single buffer that is closed before a token could be emitted: there the
merges are applied at once, for all distinct short pre-tokens of a slice
together, and a bounded cache keeps the results.  So prose goes mostly by
closed buffers, and unbroken runs of letters, digits or marks by the
transducer.  A slice of texts of about 2 MB, or one longer text, and its ids
are in memory.

Decoding joins token bytes and passes them through an incremental UTF-8
decoder; bytes that never become text turn to U+FFFD.

Special cases: a null text is encoded as the empty text (no tokens); a very long
text is encoded whole; repeated rows give repeated results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import giving_back, table
from ._text import concatenated, row_slices

#: Entries of each cache of a worker; a full cache is emptied.
CACHED = 500_000
NONE = 1 << 60
NO_RANK = 1 << 40
EMPTY = np.uint64((1 << 64) - 1)
MARKS = (".", ",", ";", ":", "!", "?")


def vocabulary() -> str:
    """The default vocabulary file; any file of its kind can be named instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """The published map from printable stand-ins to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The tables of a merge list: ranks, token bytes, and the lookahead."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _letters()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.tokens: dict[int, bytes] = {i: raw[t] for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens |= {i: s.encode() for s, i in self.special.items()}
        self.ids = {raw[t]: i for t, i in vocab.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.rank: dict[int, int] = {}  # (left << 20 | right) to rank
        self.made: list[int] = []  # rank to id
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.made.append(vocab[a + b])
        size = {self.ids[bytes([b])]: 1 for b in range(256)}
        for pair, r in self.rank.items():  # in order of rank: both halves are known
            size[self.made[r]] = size[pair >> 20] + size[pair & 0xFFFFF]
        #: Bytes of the longest token that the merges can make.
        self.lookahead = max(size.values())
        self.tails = {t[i:] for t in raw.values() for i in range(len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self._tables()
        self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """The merges applied to one short buffer: lowest rank first, leftmost first."""
        single, get, made = self.single, self.rank.get, self.made
        parts = [single[b] for b in data]
        pairs = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            new = made[best]
            parts[i : i + 2] = (new,)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(new << 20 | parts[i + 1], NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] << 20 | new, NONE)
        return parts

    def follows(self, s: int, t: int) -> bool:
        """May t stand right after s?  s = -1: may t stand first?"""
        known = self.fits.get((s, t))
        if known is None:
            if len(self.fits) > CACHED:
                self.fits.clear()
            a, b = self.tokens[s] if s >= 0 else b"", self.tokens[t]
            self.fits[s, t] = known = self.merge(a + b) == ([s, t] if s >= 0 else [t])
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in chunks, each emitted once stable."""
        buffer, base = bytearray(), 0  # base: position of buffer[0]
        last: list[int] = [-1]  # last[p - base]: last token of the encoding of the bytes before p; -1 at the start of the pre-token
        end = 0
        for chunk in chunks:
            for byte in chunk:
                buffer.append(byte)
                end += 1
                n = len(buffer)
                found, length, tail = -1, 1, bytes(buffer[n - 1 :])
                while True:
                    t = self.ids.get(tail)
                    if t is not None and self.follows(last[n - length] if n > length or base else -1, t):
                        found = t
                    length += 1
                    if length > n:
                        break
                    tail = bytes(buffer[n - length :])
                    if tail not in self.tails:
                        break
                last.append(found)
                if n >= 4 * self.lookahead:
                    out, stem = self._stable(last)
                    yield from out
                    if stem:
                        del buffer[:stem], last[:stem]
                        base += stem
        out = []
        p = len(buffer)
        while p:
            out.append(last[p])
            p -= len(self.tokens[last[p]])
        yield from reversed(out)

    def _stable(self, last: list[int]) -> tuple[list[int], int]:
        """What all chains from the last `lookahead` positions share."""
        n = len(last) - 1
        ends = set(range(n - self.lookahead + 1, n + 1))
        while len(ends) > 1:
            p = max(ends)
            ends.discard(p)
            ends.add(p - len(self.tokens[last[p]]))
        stem = p = ends.pop()
        out = []
        while p > 0:
            out.append(last[p])
            p -= len(self.tokens[last[p]])
        return out[::-1], stem

    def pretoken(self, word: str) -> bytes:
        """The ids of a pre-token as little-endian unsigned 32-bit integers."""
        data = word.encode("utf-8", "surrogatepass")
        if len(data) <= self.lookahead // 2:
            ids = self.merge(data)
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[word] = out
            return out
        ids = list(self.stream(data[i : i + 256] for i in range(0, len(data), 256)))
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge_many(self, words: list[str]) -> None:
        """`merge` for many short pre-tokens at once, into the cache: in each
        round every word merges its leftmost pair of lowest rank."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        for lo in range(0, len(order), 4096):
            self._merge_block([words[i] for i in order[lo : lo + 4096]], [raw[i] for i in order[lo : lo + 4096]])

    def _merge_block(self, words: list[str], raw: list[bytes]) -> None:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        wide = max(2, int(size.max()))
        parts = np.full((len(raw), wide + 1), -1, np.int64)
        inside = np.arange(wide + 1) < size[:, None]
        parts[inside] = self._single[np.frombuffer(b"".join(raw), np.uint8)]
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        done = np.empty_like(parts)
        rows, column = np.arange(len(raw)), np.arange(wide + 1)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            go = best < NO_RANK
            done[rows[~go]] = parts[~go]
            rows, parts, ranks, at, best = rows[go], parts[go], ranks[go], at[go], best[go]
            if not len(rows):
                break
            k = np.arange(len(rows))
            parts[k, at] = self._made[best]
            from_ = np.minimum(column + (column > at[:, None]), wide)
            parts = np.take_along_axis(parts, from_, 1)
            parts[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(from_[:, :-1], wide - 1), 1)
            ranks[:, -1] = NO_RANK
            ranks[k, at] = self._ranks(parts[k, at], parts[k, at + 1])
            left = at > 0
            ranks[k[left], at[left] - 1] = self._ranks(parts[k[left], at[left] - 1], parts[k[left], at[left]])
        count = (done >= 0).sum(1)
        flat, ends = done[done >= 0].astype("<u4").tobytes(), (np.cumsum(count) * 4).tolist()
        lo, cache = 0, self.cache
        for w, hi in zip(words, ends):
            cache[w] = flat[lo:hi]
            lo = hi

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, from an open-addressing table; NO_RANK where none."""
        pair = (left << 20 | right).astype(np.uint64)
        pair[(left < 0) | (right < 0)] = EMPTY
        slot = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)
        found = self._keys[slot]
        out = np.where(found == pair, self._values[slot], NO_RANK)
        again = np.flatnonzero(((found != pair) & (found != EMPTY)).ravel())
        flat, pair, slot = out.reshape(-1), pair.reshape(-1), slot.reshape(-1)
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self._bits) - 1)
            found = self._keys[slot[again]]
            hit = found == pair[again]
            flat[again[hit]] = self._values[slot[again[hit]]]
            again = again[~hit & (found != EMPTY)]
        return flat.reshape(out.shape)

    def _tables(self) -> None:
        self._single, self._made = np.array(self.single, np.int64), np.array(self.made, np.int64)
        self._bits = max(10, (4 * len(self.rank)).bit_length())
        self._keys = np.full(1 << self._bits, EMPTY, np.uint64)
        self._values = np.full(1 << self._bits, NO_RANK, np.int64)
        mask = (1 << self._bits) - 1
        for pair, r in self.rank.items():
            slot = (pair * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self._bits)
            while self._keys[slot] != EMPTY:
                slot = slot + 1 & mask
            self._keys[slot], self._values[slot] = pair, r
        size = max(self.tokens) + 1
        self._bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self._length = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self._start = np.cumsum(self._length) - self._length

    def forget(self) -> None:
        """Empty the caches."""
        for cache in (self.cache, self.spaced, self.fits):
            cache.clear()

    def spans(self, text: str) -> list[str]:
        """The pre-tokens of a stretch of text."""
        body = text[1:]
        if text[:1] == " ":
            if body.isalpha():
                return [text]
            if body[-1:] in MARKS and body[:-1].isalpha():
                return [text[:-1], body[-1]]
        return self.pattern.findall(text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers.

        A space between two other characters that are not white space always
        starts a pre-token, so the stretches between such spaces are
        independent and are cached as they are."""
        cache, spaced = self.cache, self.spaced
        if len(cache) > CACHED:
            cache.clear()
        if len(spaced) > CACHED:
            spaced.clear()
        plans: list[list] = []
        unseen: dict[str, list[str]] = {}  # stretch to pre-tokens
        for text in texts:
            plan: list = []
            for piece in self.cut.split(text) if self.cut else [text]:
                if piece in self.special:
                    plan.append(struct.pack("<I", self.special[piece]))
                    continue
                first, *rest = piece.split(" ")
                found = [spaced.get(w) for w in rest]
                holes, at = [], -1
                whole = bool(rest) and (not first or first[-1].isspace())
                for _ in range(found.count(None)):
                    at = found.index(None, at + 1)
                    w = rest[at]
                    if not w or w[0].isspace() or w[-1].isspace():  # white space runs on over a space
                        whole = True
                        break
                    holes.append(at)
                if whole:
                    plan.append(self.pattern.findall(piece))
                    continue
                for at in holes:
                    w = rest[at]
                    if w not in unseen:
                        unseen[w] = self.spans(" " + w)
                plan += [self.pattern.findall(first), (rest, found, holes)]
            plans.append(plan)
        short, wanted = self.lookahead // 2, set()
        for spans in [*unseen.values(), *(x for plan in plans for x in plan if isinstance(x, list))]:
            wanted.update(w for w in spans if w not in cache and len(w) <= short // 4)
        if wanted:
            self.merge_many(list(wanted))
        get, pretoken = cache.get, self.pretoken
        join = lambda spans: b"".join([get(w) or pretoken(w) for w in spans])
        for w, spans in unseen.items():
            unseen[w] = ids = join(spans)
            if len(w) <= self.lookahead:
                spaced[w] = ids
        out = []
        for plan in plans:
            done = []
            for x in plan:
                if isinstance(x, tuple):
                    rest, found, holes = x
                    for at in holes:
                        found[at] = unseen[rest[at]]
                    done.append(b"".join(found))
                else:
                    done.append(x if isinstance(x, bytes) else join(x))
            out.append(b"".join(done))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int], block: int = 1 << 16) -> Iterator[str]:
        """Text, as soon as the bytes so far are whole characters."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.asarray(ids, dtype=np.int64)
        for i in range(0, len(ids), block):
            part = ids[i : i + block]
            yield state.decode(self._bytes[concatenated(self._start[part], self._length[part])].tobytes())
        yield state.decode(b"", True)


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again: doc_id, n_tokens,
    ids_sha256, decoded_sha256 and, on demand, the ids (binary, little-endian
    unsigned 32-bit) and the decoded text.  `path` names the same file on
    every executor; by default the installed vocabulary."""

    def run(batches):
        import pyarrow as pa

        m = merges(path or vocabulary())
        for batch in batches:
            keys, rows = batch.column(0), batch.column(1)
            for lo, hi in row_slices(rows):
                step = hi - lo
                n, sha, back, ids_out, text_out = [], [], [], [], []
                for ids in m.encode_many([x or "" for x in rows.slice(lo, step).to_pylist()]):
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    digest, parts = hashlib.sha256(), []
                    for part in m.decode(np.frombuffer(ids, dtype="<u4")):
                        digest.update(part.encode())
                        if with_ids:
                            parts.append(part)
                    back.append(digest.hexdigest())
                    if with_ids:
                        ids_out.append(ids)
                        text_out.append("".join(parts))
                out = [keys.slice(lo, step), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out += [pa.array(ids_out, pa.binary()), pa.array(text_out, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)
        m.forget()  # a worker lives on and serves other stages

    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")
    return docs.select(F.col(key), F.col(text)).mapInArrow(giving_back(run), schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
