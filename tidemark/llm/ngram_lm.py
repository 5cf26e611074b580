"""Language-model scoring with an Elias-Fano n-gram trie.

Words are counted and numbered by the rank of their hash. Each task then turns its documents into sorted, added-up
trigrams and sends them, packed, to the shard of their first two words, so a shard holds its contexts whole and one
pass over it gives both upper levels: the pairs, pointers to their children, and the children coded relative to their
context, each a rising sequence in Elias-Fano form. Once the discounts of the whole corpus are known, a second pass
without a shuffle writes smoothed probabilities and back-off weights, quantised to 16 bits. Tasks map the shards from
the shared folder and search the coded bits in place: a pair, the range that its pointers bound, and in it the
successor of the asked word. Shards are found by a hash, so nothing about them passes through the driver.

Smoothing is interpolated absolute discounting; n-grams above the unigram that are seen less often than a given count
are left to their back-off, whose weight takes their whole mass, so each context's probabilities still add up to 1
before quantising. The query keeps all n-grams. What the discount leaves of the words' own mass is spread evenly over
all known words and one unknown word, so an unknown word is as likely as the discount of one word allows.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_group, dropped, groups, mixed, table, words_of, written
from tidemark.llm.registry import query
from tidemark.plans.files import delete, work_path

#: N-grams of two and more words below this count are left to their back-off; 1 keeps all.
LEAST_COUNT = 1
#: Word ids, and entries of one shard, that their keys can tell apart.
MAX_WORDS, MAX_NGRAMS = 1 << 31, 1 << 32
#: Trigram occurrences for which there is one shard; words to a file.
SHARD_ENTRIES = 1_000_000
#: Mapped shards a worker keeps open.
MAPPED = 64
#: Tokens that are counted or looked up together.
BATCH_TOKENS = 1_000_000
#: Steps of one power of ten in a quantised probability; 16 bits reach down to 1e-31.
STEPS = 2048
END = np.uint64(xxhash.xxh3_64_intdigest(b""))  # no word is empty
_MISSING = -1


def quantised(p: np.ndarray) -> np.ndarray:
    """Step of a probability, rounded down to the next smaller one; 65535 stands for 0."""
    with np.errstate(divide="ignore"):
        steps = np.ceil(-np.log10(np.maximum(p, 0)) * STEPS - 1e-9)
    return np.where(np.isfinite(steps), np.clip(steps, 0, 65534), 65535).astype(np.uint16)


_VALUES = np.r_[10.0 ** (-np.arange(65535) / STEPS), 0.0]


#: Place of the k-th one in each byte.
_IN_BYTE = np.zeros((256, 8), np.int64)
for _k in range(8):
    _IN_BYTE[np.arange(256) >> _k & 1 > 0, np.bitwise_count(np.arange(256) & ((1 << _k) - 1))[np.arange(256) >> _k & 1 > 0]] = _k


def ef_encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Elias-Fano code of a rising sequence of uint64: whole low bytes, and the rest in unary.

    The unary part is words of 64 bits with the number of zeros before each, which finds the k-th zero or one.
    """
    n = len(values)
    first = values[0] if n else np.uint64(0)
    rest = values - first
    universe = int(rest[-1]) + 1 if n else 1
    width = min(8, max(0, -(-(universe // max(1, n)).bit_length() // 8)))
    low = np.r_[rest.view(np.uint8).reshape(n, 8)[:, :width].ravel(), np.zeros(8, np.uint8)]  # 8 bytes may be read anywhere
    high = (rest >> np.uint64(8 * width) if width < 8 else np.zeros(n, np.uint64)).astype(np.int64)
    ones = high + np.arange(n)
    bits = np.zeros(-(-(int(ones[-1]) + 2 if n else 1) // 64) * 64, bool)  # one zero at least after the last one
    bits[ones] = True
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    zeros = np.cumsum(64 - np.bitwise_count(words).astype(np.int64))
    return {"first": np.array([first], np.uint64), "n": np.array([n, width]), "low": low, "high": words,
            "zeros": np.r_[0, zeros[:-1]]}


_ODD, _PAIRS, _NIBBLES = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f"))
_EACH, _TOPS, _BYTE = np.uint64(int("01" * 8, 16)), np.uint64(int("80" * 8, 16)), np.uint64(255)
_1, _2, _4, _8 = (np.uint64(x) for x in (1, 2, 4, 8))


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in `words`, of which `before` ones stand before each word."""
    at = np.searchsorted(before, k, "right") - 1
    k = (k - before[at]).astype(np.uint64)
    word = words[at]
    upto = word - ((word >> _1) & _ODD)  # ones of each two bits, four bits, byte, and of all bytes up to each
    upto = (upto & _PAIRS) + ((upto >> _2) & _PAIRS)
    upto = ((upto + (upto >> _4)) & _NIBBLES) * _EACH
    bits = np.bitwise_count((((k * _EACH) | _TOPS) - upto) & _TOPS).astype(np.uint64) * _8  # bytes that end before it
    mine = (word >> bits) & _BYTE
    k -= ((upto << _8) >> bits) & _BYTE
    return at * 64 + bits.astype(np.int64) + _IN_BYTE[mine.astype(np.int64), k.astype(np.int64)]


class EliasFano:
    """A coded sequence that is searched where it lies."""

    def __init__(self, code: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in code["n"])
        self.first, self.words, self.zeros = code["first"][0], code["high"], code["zeros"]
        self.mask = np.uint64((1 << 8 * self.width) - 1)
        self.low = np.ndarray((self.n,), np.uint64, code["low"], strides=(self.width,))
        self.ones = np.arange(len(self.words)) * 64 - self.zeros
        self.top = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.words[-1])) - 1  # the last zero

    def _low(self, i: np.ndarray) -> np.ndarray:
        return self.low[i] & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        value = self._low(i)
        if self.width < 8:
            value += (_select(self.words, self.ones, i) - i).astype(np.uint64) << np.uint64(8 * self.width)
        return value + self.first

    def find(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """Place of each x, or -1, by its successor between the places lo (included) and hi (not)."""
        hi = self.n if hi is None else hi
        rest = x - self.first
        high = (rest >> np.uint64(8 * self.width) if self.width < 8 else np.zeros(len(x), np.uint64))
        inside = (x >= self.first) & (high <= np.uint64(self.top))
        h = np.where(inside, high, 0).astype(np.int64)
        low = rest & self.mask
        # entries with the same high part stand between two zeros
        not_words = ~self.words
        start = np.where(h > 0, _select(not_words, self.zeros, np.maximum(h - 1, 0)) + 1, 0) - h
        end = np.minimum(_select(not_words, self.zeros, h) - h, hi)
        a = np.where(inside, np.maximum(start, lo), 0)
        b = np.where(inside, np.maximum(end, a), 0)
        stop = b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        out = np.full(len(x), _MISSING, np.int64)
        found = np.flatnonzero(a < stop)
        found = found[self._low(a[found]) == low[found]]
        out[found] = a[found]
        return out


def ef_decode(code: dict[str, np.ndarray]) -> np.ndarray:
    return EliasFano(code)[np.arange(int(code["n"][0]))]


def _local(path: str) -> str:
    """A path of the shared folder as the operating system sees it."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"the language model maps its levels into memory; {path} is not a mounted folder")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def save_shard(path: str, parts: dict[str, np.ndarray]) -> None:
    """One file of aligned raw arrays with a header; complete under its name or not there.

    A repeated task writes the same content and puts it in place of the first.
    """
    path = _local(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head, at, body = {}, 0, io.BytesIO()
    for name, a in parts.items():
        a = np.ascontiguousarray(a)
        head[name] = (at, a.dtype.str, a.shape)
        body.write(a.tobytes())
        body.write(b"\0" * (-body.tell() % 8))
        at = body.tell()
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + body.getbuffer())
    os.replace(part, path)


def map_shard(path: str) -> dict:
    """The arrays of a shard, mapped; those of one coded sequence as an EliasFano."""
    raw = np.memmap(_local(path), np.uint8, "r").view(np.ndarray)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    out: dict = {}
    for name, (at, kind, shape) in json.loads(raw[8 : 8 + size].tobytes()).items():
        count = int(np.prod(shape)) * np.dtype(kind).itemsize
        a = raw[8 + size + at : 8 + size + at + count].view(kind).reshape(shape)
        field, _, part = name.partition(".")
        if part:
            out.setdefault(field, {})[part] = a
        else:
            out[name] = a
    return {k: EliasFano(v) if isinstance(v, dict) else v for k, v in out.items()}


_mapped = lru_cache(MAPPED)(map_shard)


def _coded(**sequences: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{f}.{k}": a for f, v in sequences.items() for k, a in ef_encode(v).items()}


def _small(name: str, n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in one byte each, large ones beside them."""
    big = np.flatnonzero(n >= 255)
    return {name: np.minimum(n, 255).astype(np.uint8), f"{name}_at": big, f"{name}_big": n[big].astype(np.int64)}


def _full(shard: dict, name: str) -> np.ndarray:
    n = shard[name].astype(np.int64)
    n[shard[f"{name}_at"]] = shard[f"{name}_big"]
    return n


class Words:
    """The first level: hashes of all words in order, in shards of bounded size. A word's id is its rank.

    Holds the first hash, first rank and path of each shard of about SHARD_ENTRIES words.
    """

    def __init__(self, folder: str, shards: list[tuple[int, int, str]]):
        shards = sorted(shards)
        self.folder = folder
        self.first = np.array([f for f, _, _ in shards], np.uint64)
        self.base = np.cumsum([0, *[n for _, n, _ in shards]])
        self.paths = [p for _, _, p in shards]
        self.n = int(self.base[-1])
        #: Ids of the start symbol, only ever a context, and of what follows an end; ids stay below `size`.
        self.start, self.after, self.size = self.n, self.n + 1, self.n + 2
        #: Ids to a file of back-off weights.
        self.block = SHARD_ENTRIES

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each of these sorted hashes, or -1."""
        out = np.full(len(hashes), _MISSING, np.int64)
        cuts = np.r_[np.searchsorted(hashes, self.first), len(hashes)]
        for i, path in enumerate(self.paths):
            lo, hi = cuts[i], cuts[i + 1]
            if lo < hi:
                at = _mapped(path)["hashes"].find(hashes[lo:hi])
                out[lo:hi] = np.where(at >= 0, at + self.base[i], _MISSING)
        return out

    def look_up(self, field: str, ids: np.ndarray) -> np.ndarray:
        """A value of each of these words; that of missing ones and of the start is 0."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.base, ids, "right") - 1
        for i in range(len(self.paths)):
            at = np.flatnonzero(shard == i)
            out[at] = _mapped(self.paths[i])[field][ids[at] - self.base[i]]
        return out

    def backs(self, ids: np.ndarray) -> np.ndarray:
        """Quantised back-off weight of each word or start as a context; of missing ones that of 1."""
        out = np.zeros(len(ids), np.int64)
        block = np.where(ids >= 0, ids // self.block, _MISSING)
        for i in np.unique(block[ids >= 0]).tolist():
            at = np.flatnonzero(block == i)
            out[at] = _mapped(f"{self.folder}/backs/{i}")["back"][ids[at] - i * self.block]
        return out


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(pairs) % np.uint64(shards)).astype(np.min_scalar_type(shards))


def _chunks(frames: Iterator[pd.DataFrame], column: str, read) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Whole documents, about BATCH_TOKENS tokens at a time: their rows, and what `read` makes of the column."""
    for frame in frames:
        rows, parts, size = [], [], 0
        for k, value in enumerate(frame[column]):
            parts.append(read(value))
            rows.append(k)
            size += len(parts[-1])
            if size >= BATCH_TOKENS:
                yield frame.iloc[rows], parts
                rows, parts, size = [], [], 0
        if rows:
            yield frame.iloc[rows], parts


def _token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, and the end token."""
    words = words_of(text, lower=True)
    return np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), END)


def _count_words(frames) -> Iterator[pd.DataFrame]:
    for _, parts in _chunks(frames, "text", _token_hashes):
        words, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pd.DataFrame({"key": words.view(np.int64), "n": n})


def _to_ids(words: Words):
    def run(frames) -> Iterator[pd.DataFrame]:
        for rows, parts in _chunks(frames, "text", _token_hashes):
            distinct, back = np.unique(np.concatenate(parts), return_inverse=True)
            ids = words.ids(distinct).astype(np.int32)[back]
            cuts = np.cumsum([len(p) for p in parts])[:-1]
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "held_out": rows["held_out"].to_numpy(), "ids": np.split(ids, cuts)})
    return run


def _write_words(folder: str, cut: float, tokens: int, spread: float):
    def run(frames):
        frames = list(frames)
        if not frames:
            return
        hashes = np.concatenate([f["key"].to_numpy() for f in frames]).view(np.uint64)
        n = np.concatenate([f["n"].to_numpy() for f in frames])
        path = f"{folder}/words/{int(hashes[0]):020d}"
        save_shard(path, {**_coded(hashes=hashes), "count": n, "share": quantised((n - cut) / tokens + spread)})
        yield pd.DataFrame({"first": [str(hashes[0])], "n": [len(hashes)], "path": [path]})
    return run


def _discount(one: int | None, two: int | None) -> float:
    """From the numbers of n-grams seen once and twice."""
    return min(0.95, max(0.1, one / (one + 2 * (two or 0)))) if one else 0.5


def _docs(frames) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    return _chunks(frames, "ids", lambda v: np.asarray(v, np.int64))


def _strung(parts: list[np.ndarray], start: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents one after the other, each between its two symbols, and the places of their tokens."""
    ids = np.concatenate([x for p in parts for x in ([start], p, [after])]).astype(np.int64)
    sizes = np.array([len(p) for p in parts])
    token = np.ones(len(ids), bool)
    ends = np.cumsum(sizes + 2)
    token[ends - 1] = token[ends - sizes - 2] = False
    return ids, np.flatnonzero(token)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of uint64, byte by byte, so that bytes of one worth stand together."""
    a = np.stack(columns).view(np.uint8).reshape(len(columns), -1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.transpose(0, 2, 1)).tobytes())


def _unpacked(block: bytes, columns: int) -> np.ndarray:
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(a.transpose(0, 2, 1)).view(np.uint64).reshape(columns, -1)


def _added(pair: np.ndarray, word: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, word) in order with the sum of their counts."""
    order = np.lexsort((word, pair))
    pair, word = pair[order], word[order]
    at = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (word[1:] != word[:-1])])
    sums = np.diff(np.r_[at, len(pair)]).astype(np.uint64) if n is None else np.add.reduceat(n[order], at)
    return pair[at], word[at], sums


def _count(words: Words, shards: int):
    """Trigrams of a batch of documents, added up: one packed row per shard. A pair is the context, its last token
    may be the end; what follows then is the symbol `after`, so that pairs are counted with their trigrams."""
    def run(frames) -> Iterator[pd.DataFrame]:
        for _, parts in _docs(frames):
            ids, at = _strung(parts, words.start, words.after)
            ids = ids.astype(np.uint64)
            pair, word, n = _added(ids[at - 1] * np.uint64(words.size) + ids[at], ids[at + 1], None)
            shard = _shard_of(pair, shards)
            order = np.argsort(shard, kind="stable")
            pair, word, n, shard = pair[order], word[order], n[order], shard[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            out = [(shard[lo], _packed(np.diff(pair[lo:hi], prepend=np.uint64(0)), word[lo:hi], n[lo:hi]))
                   for lo, hi in zip(cuts[:-1], cuts[1:])]
            yield pd.DataFrame(out, columns=["shard", "block"])
    return run


_FACTS = ("shard int, pairs long, trigrams long, one_2 long, two_2 long, one_3 long, two_3 long, "
          "word long, kinds long, seen long")


def _write_level(words: Words, least: int):
    """Keys and counts of one shard; yields its facts, and per first word its kept pairs and their occurrences."""
    def run(frames) -> Iterator[pd.DataFrame]:
        for part in groups(frames, ["shard"]):
            shard, columns = int(part["shard"].iloc[0]), [_unpacked(b, 3) for b in part["block"]]
            pair = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns])
            pair, word, n = _added(pair, np.concatenate([c[1] for c in columns]), np.concatenate([c[2] for c in columns]))
            n = n.astype(np.int64)
            del columns
            at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            total = np.add.reduceat(n, at)
            kept = total >= least
            of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(pair)]))
            counted = kept[of] & (word != np.uint64(words.after))
            child = counted & (n >= least)
            rank = np.cumsum(kept) - 1
            parent = rank[of[child]]
            pairs = pair[at][kept]
            pointers = np.r_[0, np.cumsum(np.bincount(parent, minlength=len(pairs)))].astype(np.uint64)
            children = parent.astype(np.uint64) * np.uint64(words.size) + word[child]
            save_shard(f"{words.folder}/keys/{shard}", _coded(pairs=pairs, pointers=pointers, children=children))
            save_shard(f"{words.folder}-counts/{shard}", {**_small("pair", total[kept]), **_small("child", n[child])})
            yield pd.DataFrame({
                "shard": [shard], "pairs": [len(pairs)], "trigrams": [len(children)], "one_2": [(total == 1).sum()],
                "two_2": [(total == 2).sum()], "one_3": [(n[counted] == 1).sum()], "two_3": [(n[counted] == 2).sum()],
                "word": [-1], "kinds": [0], "seen": [0]})
            first, back = np.unique(pairs // np.uint64(words.size), return_inverse=True)
            seen = np.bincount(back, weights=total[kept], minlength=len(first))
            yield pd.DataFrame({
                "shard": shard, "pairs": 0, "trigrams": 0, "one_2": 0, "two_2": 0, "one_3": 0, "two_3": 0,
                "word": first.astype(np.int64), "kinds": np.bincount(back, minlength=len(first)), "seen": seen.astype(np.int64)})
    return run


def _totals(words: Words, documents: int, ids: np.ndarray) -> np.ndarray:
    """Occurrences of contexts of one word; the start stands before each document."""
    return np.where(ids == words.start, documents, words.look_up("count", ids))


def _write_values(words: Words, documents: int, cut_2: float, cut_3: float):
    """Smoothed probabilities of a shard's entries, in the order of its keys. Shards without entries have no keys."""
    def run(frames) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, size in zip(frame["shard"].tolist(), frame["pairs"].tolist()):
                path = f"{words.folder}/values/{shard}"
                if not size:
                    save_shard(path, {"pair": np.empty(0, np.uint16)})
                    continue
                keys, counts = map_shard(f"{words.folder}/keys/{shard}"), map_shard(f"{words.folder}-counts/{shard}")
                total, n = _full(counts, "pair"), _full(counts, "child")
                pointers = keys["pointers"][np.arange(size + 1)].astype(np.int64)
                parent = np.repeat(np.arange(size), np.diff(pointers))
                first = (keys["pairs"][np.arange(size)] // np.uint64(words.size)).astype(np.int64)
                mass = np.bincount(parent, weights=n - cut_3, minlength=size)
                save_shard(path, {"pair": quantised((total - cut_2) / _totals(words, documents, first)),
                                  "back": quantised(1 - mass / total), "child": quantised((n - cut_3) / total[parent])})
            yield frame[["shard"]]
    return run


def _write_backs(words: Words, documents: int, cut_2: float):
    def write(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        block, ids = int(part["block"].iloc[0]), part["word"].to_numpy()
        back = np.zeros(min(words.block, words.start + 1 - block * words.block), np.uint16)
        total = np.maximum(1, _totals(words, documents, ids))
        back[ids - block * words.block] = quantised(1 - (part["seen"].to_numpy() - cut_2 * part["kinds"].to_numpy()) / total)
        save_shard(f"{words.folder}/backs/{block}", {"back": back})
        yield part[["block"]].iloc[:1]
    return write


def _words(docs: DataFrame) -> tuple[Words, int, float]:
    """Count and write the words; (the first level, tokens, probability of an unknown word)."""
    folder = work_path(docs.sparkSession, "lm-levels")
    _local(folder)
    counts = docs.where("NOT held_out").select("text").mapInPandas(_count_words, "key long, n long")
    counts = written(counts.groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    facts = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("words"), F.count_if(F.col("n") == 1).alias("one"),
                       F.count_if(F.col("n") == 2).alias("two")).first()
    tokens, words, cut = facts["tokens"] or 0, facts["words"], _discount(facts["one"], facts["two"])
    if words >= MAX_WORDS:
        raise ValueError(f"{words} words; their ids reach to {MAX_WORDS}")
    spread = cut * words / tokens / (words + 1) if tokens else 1.0
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # so that longs sort like the unsigned hashes they hold
    laid = counts.repartitionByRange(1 + words // SHARD_ENTRIES, unsigned).sortWithinPartitions(unsigned)
    found = written(laid.mapInPandas(_write_words(folder, cut, max(1, tokens), spread), "first string, n long, path string"), "lm-shards")
    level = Words(folder, [(int(r["first"]), r["n"], r["path"]) for r in found.collect()])
    dropped(found, counts)
    return level, tokens, spread


def train(docs: DataFrame, least_count: int = LEAST_COUNT) -> tuple[dict, DataFrame]:
    """Count, smooth and write the levels of a trigram model over the rows of `docs` that are not held out.

    Returns the model, which is small (a folder, first hashes of the word shards, totals), and the ids of all
    documents' tokens, -1 for unknown words. A shard's size is bounded by its share of the tokens or, for a context
    that is followed by almost every word, by the number of words.
    """
    spark = docs.sparkSession
    words, tokens, spread = _words(docs)
    ids = written(docs.mapInPandas(_to_ids(words), "doc_id long, held_out boolean, ids array<int>"), "lm-ids")
    training = ids.where("NOT held_out").select("ids")
    documents, shards = training.count(), 1 + tokens // SHARD_ENTRIES
    blocks = training.mapInPandas(_count(words, shards), "shard int, block binary")
    blocks = blocks.repartition(shards, "shard").sortWithinPartitions("shard")
    facts = written(blocks.mapInPandas(_write_level(words, least_count), _FACTS), "lm-facts")
    own = facts.where("word = -1")
    seen = own.agg(*[F.sum(c).alias(c) for c in ("one_2", "two_2", "one_3", "two_3")], F.max(F.greatest("pairs", "trigrams")).alias("most")).first()
    if (seen["most"] or 0) >= MAX_NGRAMS:
        raise ValueError(f"{seen['most']} entries in a level of one shard; ranks reach to {MAX_NGRAMS}")
    cut_2, cut_3 = _discount(seen["one_2"], seen["two_2"]), _discount(seen["one_3"], seen["two_3"])
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(own.select("shard", "pairs"), "shard", "left")
    every = every.select("shard", F.coalesce("pairs", F.lit(0)).alias("pairs")).repartition(shards, "shard")
    dropped(written(every.mapInPandas(_write_values(words, documents, cut_2, cut_3), "shard int"), "lm-values"))
    # words and the start as contexts; each block of ids has a row at least
    blank = spark.range(words.start // words.block + 1)
    blank = blank.select((F.col("id") * words.block).alias("word"), *[F.lit(0).cast("long").alias(c) for c in ("kinds", "seen")])
    heads = facts.where("word >= 0").select("word", "kinds", "seen").unionByName(blank)
    heads = heads.groupBy("word").agg(F.sum("kinds").alias("kinds"), F.sum("seen").alias("seen"))
    heads = heads.withColumn("block", (F.col("word") / words.block).cast("int"))
    dropped(written(by_group(heads, ["block"], _write_backs(words, documents, cut_2), "block int"), "lm-backs"), facts)
    delete(spark, f"{words.folder}-counts")
    return {"words": words, "shards": shards, "tokens": tokens, "unknown": spread}, ids


def _searched(model: dict, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of `ids`: quantised probability of the pair that ends there, and, of the trigram that ends there,
    probability and back-off weight of its context. 65535 stands for 0, and for weights of unknown contexts 0 for 1."""
    words = model["words"]
    pair_p, back, child_p = (np.full(len(ids), x, np.uint16) for x in (65535, 0, 65535))
    at = at[(ids[at - 1] >= 0) & (ids[at] >= 0)]
    if not len(at):
        return pair_p, back, child_p
    pairs = ids[at - 1].astype(np.uint64) * np.uint64(words.size) + ids[at].astype(np.uint64)
    order = np.argsort(pairs)
    order = order[np.argsort(_shard_of(pairs[order], model["shards"]), kind="stable")]
    at, pairs = at[order], pairs[order]
    new = np.r_[True, pairs[1:] != pairs[:-1]]
    of, pairs = np.cumsum(new) - 1, pairs[new]
    shard = _shard_of(pairs, model["shards"])
    cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        values = _mapped(f"{words.folder}/values/{shard[lo]}")
        if not len(values["pair"]):
            continue
        keys = _mapped(f"{words.folder}/keys/{shard[lo]}")
        node = keys["pairs"].find(pairs[lo:hi])
        a, b = np.searchsorted(of, [lo, hi])
        place, mine = at[a:b], node[of[a:b] - lo]
        place, mine = place[mine >= 0], mine[mine >= 0]
        pair_p[place], back[place + 1] = values["pair"][mine], values["back"][mine]
        # only the children between a context's pointers are searched, each context's pointers read once
        hit = np.flatnonzero(node >= 0)
        ends = np.zeros((2, hi - lo), np.int64)
        ends[0, hit], ends[1, hit] = keys["pointers"][node[hit]], keys["pointers"][node[hit] + 1]
        begin, stop = ends[:, of[a:b][node[of[a:b] - lo] >= 0] - lo]
        ask = np.flatnonzero((ids[place + 1] >= 0) & (ids[place + 1] < words.start) & (begin < stop))
        want = mine[ask].astype(np.uint64) * np.uint64(words.size) + ids[place[ask] + 1].astype(np.uint64)
        child = keys["children"].find(want, begin[ask], stop[ask])
        found = child >= 0
        child_p[place[ask[found]] + 1] = values["child"][child[found]]
    return pair_p, back, child_p


def _score(model: dict):
    words, tokens = model["words"], model["tokens"]

    def run(frames) -> Iterator[pd.DataFrame]:
        for rows, parts in _docs(frames):
            ids, at = _strung(parts, words.start, words.after)
            sizes = np.array([len(p) for p in parts])
            token, before = ids[at], ids[at - 1]
            known = token >= 0
            count = words.look_up("count", token)
            p = np.maximum(np.where(known, _VALUES[words.look_up("share", token)], model["unknown"]), 1e-31)
            pair, back, child = (_VALUES[x[at]] for x in _searched(model, ids, at))
            p = np.where(before >= 0, pair + _VALUES[words.backs(before)] * p, p)
            p = child + back * p
            doc = np.r_[0, np.cumsum(sizes)[:-1]]
            yield pd.DataFrame({
                "doc_id": rows["doc_id"].to_numpy(), "held_out": rows["held_out"].to_numpy(), "n_tokens": sizes,
                "n_known": np.add.reduceat(known.astype(np.int64), doc), "train_tokens": tokens,
                "base_score": np.add.reduceat(np.log10((count + 1) / (tokens + words.n + 1)), doc),
                "score": np.add.reduceat(np.log10(p), doc)})
    return run


def score_texts(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """Train on the documents whose crc32(doc_id as text) mod 7 is not 2 and score all of them.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Null and empty texts are
    one end token. Rows with a null doc_id are in training. Without training rows every token has the unknown
    word's probability 1. More words or n-grams than ids can tell apart are an error. An empty table gives no rows; repeated rows each give one.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    model, ids = train(docs, least_count)
    return ids.mapInPandas(
        _score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")


@query("op7_ngram_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), least_count=1)
