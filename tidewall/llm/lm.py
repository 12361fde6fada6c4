"""An n-gram language model with interpolated modified Kneser-Ney smoothing, of any order from two.

Counting: each task counts the n-grams of its texts and deals them, packed, to shards by the hash of the word
before the last, so a shard sees all n-grams of a context, and of each shorter one that ends them. A word
that alone would fill a shard is hot: its n-grams are dealt by both last words, and what its contexts gather
in several shards is added up in shards of contexts. A shard merges its blocks; level by level down to pairs
it writes n-grams and contexts as sorted hash arrays with counts, where a level below the highest counts the
distinct words before its n-grams, and deals each last word's number of contexts and count to word shards,
which write sorted arrays too. Only sums over all shards reach the driver, which sets the discounts.
Shards are made in a few passes over the texts, so that only a part of all n-grams is under way at a time.
Nothing is capped and no count is dropped.

Scoring: workers memory-map the sorted arrays in the shared folder and look a batch's distinct n-grams,
contexts and words up. Probabilities are made from counts when they are looked up.

Hash arrays: the first bits of a key are its bucket, of 16 keys at most or so, and 32 more bits are kept; so a
key that is not there is taken for another with a probability of 4e-9. Words further back than the last two
count by 40 bits of their hash. Counts below 15 take half a byte; the others stand in a list of their own.

A text stands after order - 1 places of BEGIN.
"""

from __future__ import annotations

import functools
import io
import itertools
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import crc32_text, discard, freed_shuffles, local_path, shared_dir, slices, stored

BEGIN, END = 2, 1  # stand for the places before and after a text; no word's hash by any likelihood
FAR = np.uint64(24)  # bits that words further back than the last two lose
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
DEALT = "kind int, shard int, keys binary, n binary, c binary, sums array<double>"


def split_words(text: bytes | None) -> list[bytes]:
    """A-Z lowered, cut at exactly the bytes 20, 09 to 0D."""
    return (text or b"").lower().split()


def utf8(column: pa.Array) -> list[bytes | None]:
    """A column's texts as they are stored."""
    return column.cast(pa.binary()).to_pylist()


class Numbers(dict):
    """Words in order of first sight, counted from 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(texts: list[bytes | None], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct word hashes in order; per place of the n-gram that ends at each token (words, then END, text
    by text) the number of its word among them; and where texts start."""
    numbers, parts, sizes = Numbers(), [], []
    begin, end = numbers[None], np.array([numbers[True]])  # no words are these
    for text in texts:
        words = split_words(text)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        parts.append(end)
        sizes.append(len(words) + 1)
    starts = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=starts[1:])
    hashes = np.array([BEGIN, END, *map(xxhash.xxh3_64_intdigest, itertools.islice(numbers, 2, None))], np.uint64)
    by = np.argsort(hashes)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    words = rank[np.concatenate(parts)]
    place = np.arange(len(words)) - np.repeat(starts, sizes)
    columns = [words]
    for back in range(1, order):
        before = np.full_like(words, rank[begin])
        before[back:] = words[:-back]
        before[place < back] = rank[begin]
        columns.insert(0, before)
    return hashes[by], columns, starts


def distinct(columns: list[np.ndarray], size: int, inverse: bool = False) -> tuple[np.ndarray, ...]:
    """A place and the count of each distinct row (and each row's number), by the last word but one, the last, those before."""
    order = [*columns[-2:], *columns[-3::-1]]
    keys, reach = order[0].astype(np.int64), size
    for column in order[1:]:
        if reach * size >= 1 << 62:
            kept, keys = np.unique(keys, return_inverse=True)
            reach = len(kept)
        keys, reach = keys * size + column, reach * size
    by = np.argsort(keys)
    ordered = keys[by]
    heads = _heads(ordered)
    out = (by[heads], np.diff(np.append(heads, len(keys))))
    if not inverse:
        return out
    numbers = np.empty(len(keys), np.int64)
    numbers[by] = np.repeat(np.arange(len(heads)), out[1])
    return (*out, numbers)


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def mixed(words: list[np.ndarray]) -> np.ndarray:
    """One hash per row of words; of those further back than the last two only the first 40 bits count."""
    out = words[-1] * _MULTIPLIER
    for k, x in enumerate(reversed(words[:-1])):
        out ^= out >> np.uint64(32)
        out += x if k == 0 else x >> FAR
        out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= _MULTIPLIER
    out ^= out >> np.uint64(29)
    return out


def context_keys(words: list[np.ndarray]) -> np.ndarray:
    """A hash per n-gram's context, without its last word."""
    return mixed([*words[:-1], np.zeros_like(words[0])])


class Routes:
    """Which shard n-grams and contexts are in: by the word before the last, with the last where it is hot."""

    def __init__(self, bits: int, hot: np.ndarray):
        self.bits, self.hot = bits, hot

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        return np.isin(words, self.hot) if len(self.hot) else np.zeros(len(words), bool)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def contexts(self, keys: np.ndarray) -> np.ndarray:
        """Shards of hot contexts, and of words."""
        return self.of(keys * _MULTIPLIER)

    def grams(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        hot, keys = self.is_hot(before), before * _MULTIPLIER
        if hot.any():
            keys[hot] = mixed([before[hot], last[hot]])
        return self.of(keys)


def by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places of its rows."""
    order = np.argsort(shards.astype(np.uint16) if len(shards) and shards.max() < 1 << 16 else shards, kind="stable")
    heads = _heads(shards[order])
    for a, b in zip(heads, [*heads[1:], len(order)]):
        yield int(shards[order[a]]), order[a:b]


# --- arrays in the shared folder


def hash_table(keys: np.ndarray, **counts: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted distinct keys as buckets and 32 bits of each, with columns of counts."""
    bits = max(0, int(len(keys) // 8).bit_length() - 1)
    whole = keys >> np.uint64(32 - bits)
    table = {"starts": np.searchsorted(whole >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32), "keys": (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32)}
    for name, values in counts.items():
        few = np.minimum(values, 15).astype(np.uint8)
        few = np.append(few, np.uint8(0)) if len(few) % 2 else few
        many = np.flatnonzero(values >= 15)
        table |= {f"{name}_few": few[::2] | few[1::2] << 4, f"{name}_at": many.astype(np.uint32), f"{name}_many": _least(values[many])}
    return table


def find_keys(table: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys are in a table, and the places of those."""
    starts, stored_keys = table["starts"], table["keys"]
    if not len(stored_keys) or not len(keys):
        return np.zeros(len(keys), bool), np.empty(0, np.int64)
    bits = (len(starts) - 1).bit_length() - 1
    whole = keys >> np.uint64(32 - bits)
    bucket, rest = (whole >> np.uint64(32)).astype(np.int64), whole.astype(np.uint32)
    at, high = starts.take(bucket).astype(np.int64), starts.take(bucket + 1).astype(np.int64)
    step = 1 << max(0, int((high - at).max()).bit_length() - 1)
    while step:  # the number of smaller keys in the bucket, bit by bit
        further = at + step
        smaller = stored_keys.take(further - 1, mode="clip") < rest
        smaller &= further <= high
        at = np.where(smaller, further, at)
        step >>= 1
    hit = at < high
    hit &= stored_keys.take(at, mode="clip") == rest
    return hit, at[hit]


def read_counts(table: dict[str, np.ndarray], name: str, places: np.ndarray) -> np.ndarray:
    out = (table[f"{name}_few"][places >> 1] >> ((places & 1) << 2).astype(np.uint8) & 15).astype(np.int64)
    many = out == 15
    out[many] = table[f"{name}_many"][np.searchsorted(table[f"{name}_at"], places[many])]
    return out


def _least(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


class Store:
    """Files of named arrays in a folder that driver and workers share: mapped where it is a file system, read where not."""

    def __init__(self, uri: str):
        self.uri, self.path = uri, local_path(uri)

    def save(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Written whole under a name of its own, then renamed: a task that runs twice does no harm."""
        heads, at = [], 0
        for key, array in arrays.items():
            heads.append((key, array.dtype.str, array.shape, at))
            at += -(-array.nbytes // 8) * 8
        head = json.dumps(heads).encode()
        data = io.BytesIO()
        data.write(len(head).to_bytes(8, "little") + head.ljust(-(-len(head) // 8) * 8))
        for array in arrays.values():
            data.write(array.tobytes().ljust(-(-array.nbytes // 8) * 8, b"\0"))
        if self.path:
            os.makedirs(self.path, exist_ok=True)
            draft = f"{self.path}/.{name}.{uuid.uuid4().hex}"
            with open(draft, "wb") as f:
                f.write(data.getbuffer())
            os.replace(draft, f"{self.path}/{name}")
        else:
            from pyarrow.fs import FileSystem

            store, root = FileSystem.from_uri(self.uri)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(data.getbuffer())

    def load(self, name: str) -> dict[str, np.ndarray]:
        if self.path:
            data = np.asarray(np.memmap(f"{self.path}/{name}", np.uint8, "r"))
        else:
            from pyarrow.fs import FileSystem

            store, root = FileSystem.from_uri(self.uri)
            with store.open_input_file(f"{root}/{name}") as f:
                data = np.frombuffer(f.read(), np.uint8)
        size = int(data[:8].view("<u8")[0])
        first = 8 + -(-size // 8) * 8
        out = {}
        for key, kind, shape, at in json.loads(bytes(data[8 : 8 + size])):
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            out[key] = data[first + at : first + at + n].view(kind).reshape(shape)
        return out


# --- counting


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs, byte by byte, compressed."""
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + zstandard.compress(wide[:, :width].T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<u8").reshape(-1)


def frequent_words(train: DataFrame, above: float, most_tokens: int) -> tuple[int, np.ndarray]:
    """Number of tokens, and hashes of all words that occur more than `above` times (with some that occur half as often).

    A batch names the words whose share in it is more than half of above / most_tokens. The batches where a
    word's share is less hold less than above / 2 of it, so what is named of a word tells whether it is one.
    No more than 2 / above of all tokens' number is named in the end.
    """
    share = above / max(1, most_tokens) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in utf8(batch.column(0)):
                found.update(split_words(text))
            n = sum(found.values()) + batch.num_rows
            named = [(int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64)), c) for w, c in found.items() if c > share * n]
            named += [(BEGIN, batch.num_rows), (0, n)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in named], pa.int64()) for k in range(2)], names=["w", "c"])

    named = train.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counts = {r.w: r.c for r in named.filter((F.col("w") == 0) | (F.col("c") > above / 2)).collect()}
    n = counts.pop(0, 0)
    return n, np.sort(np.array(list(counts), np.int64).view(np.uint64))


def _blocks(train: DataFrame, order: int, routes: Routes, turn: int, turns: int, slice_bytes: int) -> DataFrame:
    """(shard, block): the distinct n-grams of a slice of texts in the shards of this turn, with counts.

    A block is a trie read from the word before the last: distinct words of it, for each the last words,
    for each of these the words before, with the sizes of the runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, slice_bytes):
            words, columns, _ = tokens(utf8(batch.column(0)), order)
            shards = routes.grams(words[columns[-2]], words[columns[-1]])
            now = np.flatnonzero(shards % turns == turn)
            columns, shards = [c[now] for c in columns], shards[now]
            first, counts = distinct(columns, len(words))
            columns = [c[first] for c in columns]
            rows = [(shard, _packed([c[own] for c in columns], counts[own], words)) for shard, own in by_shard(shards[first])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

    return train.select("text").mapInArrow(run, "shard int, block binary")


def _packed(columns: list[np.ndarray], counts: np.ndarray, words: np.ndarray) -> bytes:
    """A block of rows that are in order of the last word but one, the last, those before."""
    parts, new = [pack(counts)], np.zeros(len(counts), bool)
    new[0] = True
    for k, column in enumerate([*columns[-2:], *columns[-3::-1]]):
        new[1:] |= column[1:] != column[:-1]
        heads = np.flatnonzero(new)
        parts += [pack(words[column[heads]] >> (FAR if k > 1 else np.uint64(0))), pack(np.diff(np.append(heads, len(counts))))]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpacked(block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Word hashes a place, and counts."""
    parts, at = [], 0
    while at < len(block):
        size = int.from_bytes(block[at : at + 4], "little")
        parts.append(unpack(block[at + 4 : at + 4 + size]))
        at += 4 + size
    tree = [np.repeat(heads << FAR if k > 1 else heads, runs.astype(np.int64)) for k, (heads, runs) in enumerate(zip(parts[1::2], parts[2::2], strict=True))]
    return [*tree[:1:-1], *tree[:2]], parts[0]


def _of_counts(counts: np.ndarray) -> list[float]:
    """How many are 1, 2, 3 and 4."""
    return [float((counts == k).sum()) for k in range(1, 5)]


def _merge_grams(blocks: list[bytes], shard: int, order: int, routes: Routes, store: Store) -> pd.DataFrame:
    """Merges a shard's blocks, stores n-grams and contexts of each level, and deals words and hot contexts: DEALT."""
    found = [_unpacked(block) for block in blocks]
    grams, c = [np.concatenate([f[0][k] for f in found]) for k in range(order)], np.concatenate([f[1] for f in found])
    del found
    words, place = np.unique(grams[-1], return_inverse=True)
    total, sums, rows, tables = np.bincount(place, weights=c).astype(np.uint64), [], [], {}
    for level in range(order, 1, -1):
        keys = mixed(grams)
        by = np.argsort(keys)
        heads = _heads(keys[by])
        c, grams, keys = np.add.reduceat(c[by], heads), [g[by[heads]] for g in grams], keys[by[heads]]
        tables |= {f"gram{level}_{k}": v for k, v in hash_table(keys, c=c).items()}
        sums += _of_counts(c)
        contexts = context_keys(grams)
        by = np.argsort(contexts)
        heads = _heads(contexts[by])
        kinds = np.stack([np.add.reduceat(x[by], heads) for x in (c, *((c == k).astype(np.uint64) for k in (1, 2)), (c > 2).astype(np.uint64))], axis=1)
        contexts, hot = contexts[by[heads]], routes.is_hot(grams[-2][by[heads]])
        tables |= {f"context{level}_{k}": v for k, v in _context_table(contexts[~hot], kinds[~hot]).items()}
        for to, own in by_shard(routes.contexts(contexts[hot])):
            rows.append((level, to, pack(contexts[hot][own]), None, pack(kinds[hot][own].reshape(-1)), None))
        if level > 2:  # the level below counts the distinct words before its n-grams
            grams, c = grams[1:], np.ones(len(c), np.uint64)
    store.save(f"grams-{shard}", tables)
    n = np.bincount(np.searchsorted(words, grams[-1]), minlength=len(words))
    rows += [(0, to, pack(words[own]), pack(n[own]), pack(total[own]), None) for to, own in by_shard(routes.contexts(words))]
    rows.append((-1, shard % 256, None, None, None, sums))
    return pd.DataFrame(rows, columns=["kind", "shard", "keys", "n", "c", "sums"])


def _context_table(keys: np.ndarray, kinds: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts with what follows them: a number among the distinct kinds (count, how many follow once, twice, more), the frequent first."""
    _, first, at, n = np.unique(mixed([np.zeros_like(kinds[:, 0]), np.zeros_like(kinds[:, 0]), mixed([kinds[:, 0], kinds[:, 1]]) ^ mixed([kinds[:, 3], kinds[:, 2]])]), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hash_table(keys, kind=rank[at]) | {"kinds": kinds[first[order]].reshape(-1, 4)}


def _merge_dealt(group: pd.DataFrame, store: Store) -> pd.DataFrame:
    """Merges a shard of words or of hot contexts and stores it; one row of sums: tokens, distinct words, pairs, counts of counts, more."""
    kind, shard = int(group["kind"].iloc[0]), int(group["shard"].iloc[0])
    if kind < 0:
        return pd.DataFrame({"kind": [kind], "sums": [np.sum(group["sums"].tolist(), axis=0).tolist()]})
    keys = np.concatenate([unpack(x) for x in group["keys"]])
    by = np.argsort(keys, kind="stable")
    heads = _heads(keys[by])
    add = lambda x: np.add.reduceat(x[by], heads)
    c = np.concatenate([unpack(x) for x in group["c"]])
    if kind:
        table = _context_table(keys[by[heads]], np.stack([add(x) for x in c.reshape(-1, 4).T], axis=1))
        store.save(f"contexts{kind}-{shard}", {f"context{kind}_{k}": v for k, v in table.items()})
        return pd.DataFrame({"kind": [kind], "sums": [[0.0]]})
    c, n = add(c), add(np.concatenate([unpack(x) for x in group["n"]]))
    store.save(f"words-{shard}", {f"word_{k}": v for k, v in hash_table(keys[by[heads]], c=c, n=n).items()})
    return pd.DataFrame({"kind": [0], "sums": [[float(c.sum()), float(len(c)), float(n.sum()), *_of_counts(n), float((n > 2).sum())]]})


def discounts(of_counts: list[float]) -> np.ndarray:
    """D by count 0, 1, 2, 3 and more, from how many counts are 1 to 4; where those are too few, a half or less than the count."""
    n1, n2, n3, n4 = of_counts
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *(min(max(x, 0.0), k + 1.0) for k, x in enumerate(d))])


class Model:
    """A trained model: where its arrays are, how they are dealt, and its sums."""

    def __init__(self, uri: str, order: int, routes: Routes, sums: list[tuple[int, list[float]]]):
        self.uri, self.order, self.routes = uri, order, routes
        words, grams = np.zeros(8), np.zeros(4 * (order - 1))
        for kind, found in sums:  # hot contexts have none
            if kind < 1:
                (grams if kind else words)[:] = found[: len(grams) if kind else 8]
        self.tokens, self.vocabulary, self.pairs = int(words[0]), int(words[1]), words[2]
        self.discount = {order - k: discounts(grams[4 * k : 4 * k + 4].tolist()) for k in range(order - 1)}
        self.word_discount = discounts(words[3:7].tolist())
        freed = self.word_discount[1:] @ [words[3], words[4], words[7]]
        self.floor = (freed / self.pairs if self.pairs else 1.0) / (self.vocabulary + 1)


def train_model(docs: DataFrame, shard_tokens: int = 2_500_000, order: int = 2, turns: int = 2, slice_bytes: int = 8 << 20) -> Model:
    """Counts the texts of docs (null: empty). Shards grow in number with the tokens; a turn makes one in `turns` of them."""
    spark = docs.sparkSession
    store = Store(shared_dir(spark, "lm"))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    n, hot = frequent_words(docs, shard_tokens / 2, 2 * rows + size // 2)
    routes = Routes(max(3, int(np.ceil(np.log2(n / shard_tokens + 1)))), hot)

    def merge_grams(group: pd.DataFrame) -> pd.DataFrame:
        return _merge_grams(group["block"].tolist(), int(group["shard"].iloc[0]), order, routes, store)

    def merge_dealt(group: pd.DataFrame) -> pd.DataFrame:
        return _merge_dealt(group, store)

    dealt = [stored(_blocks(docs, order, routes, turn, turns, slice_bytes).groupBy("shard").applyInPandas(merge_grams, DEALT), "dealt") for turn in range(turns)]
    merged = functools.reduce(DataFrame.unionByName, dealt).groupBy("kind", "shard").applyInPandas(merge_dealt, "kind int, sums array<double>")
    with freed_shuffles(spark):
        sums = merged.groupBy("kind").agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(max(8, 4 * (order - 1)))]).alias("sums")).collect()
    for part in dealt:
        discard(part)
    return Model(store.uri, order, routes, [(r.kind, [x or 0.0 for x in r.sums]) for r in sums])


class Lookup:
    """A worker's view of a model; files are mapped when first needed, some thousands at a time at most."""

    def __init__(self, model: Model):
        self.model, self.store = model, Store(model.uri)
        self.file = functools.lru_cache(maxsize=4096 if self.store.path else 8)(self._file)

    def _file(self, name: str) -> dict[str, np.ndarray] | None:
        try:
            return self.store.load(name)
        except FileNotFoundError:  # a shard without rows
            return None

    def find(self, file: str, table: str, columns: tuple[str, ...], keys: np.ndarray, shards: np.ndarray, out: np.ndarray, rows: np.ndarray | None = None, discount: np.ndarray | None = None) -> np.ndarray:
        """Fills rows of `out` with the columns of the keys that are stored; the others stay as they are.

        Of contexts, with a discount, these are their count and what the discount frees of it.
        """
        for shard, own in by_shard(shards):
            held = self.file(f"{file}-{shard}")
            if held is None:
                continue
            arrays = {k.removeprefix(table + "_"): v for k, v in held.items() if k.startswith(table + "_")}
            hit, places = find_keys(arrays, keys[own])
            if discount is None:
                values = np.stack([read_counts(arrays, c, places) for c in columns], axis=1)
            else:
                kinds = arrays["kinds"]
                values = np.stack([kinds[:, 0], kinds[:, 1:] @ discount[1:]], axis=1)[read_counts(arrays, "kind", places)]
            to = own[hit]
            out[to if rows is None else rows[to]] = values
        return out

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, model score."""
        m = self.model
        words, columns, starts = tokens(texts, m.order)
        word = self.find("words", "word", ("c", "n"), words, m.routes.contexts(words), np.zeros((len(words), 2)))
        count, spread = word[:, 0], word[:, 1]
        base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
        lower = m.floor + (np.maximum(spread - m.word_discount[np.minimum(spread, 3).astype(int)], 0) / m.pairs if m.pairs else 0.0)
        lower, last = lower + np.zeros(len(words)), columns[-1]
        probability = lower[last]
        for level in range(2, m.order + 1):
            d = m.discount[level]
            first, _, at = distinct(columns[-level:], len(words), inverse=True)
            own = [words[c[first]] for c in columns[-level:]]
            shards = m.routes.grams(own[-2], own[-1])
            gram = self.find("grams", f"gram{level}", ("c",), mixed(own), shards, np.zeros((len(first), 1)))[:, 0]
            context_at = np.arange(len(first))
            if level == 2:  # a pair's context is a word
                own, context_at = [words, words], columns[-2][first]
                shards = m.routes.grams(words, words)
            keys, hot = context_keys(own), m.routes.is_hot(own[-2])
            cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
            context = self.find("grams", f"context{level}", (), keys[cold], shards[cold], np.zeros((len(keys), 2)), cold, d)
            context = self.find(f"contexts{level}", f"context{level}", (), keys[warm], m.routes.contexts(keys[warm]), context, warm, d)[context_at]
            total = context[:, 0]
            seen = total > 0
            safe = np.where(seen, total, 1.0)
            upper = np.where(seen, np.maximum(gram - d[np.minimum(gram, 3).astype(int)], 0) / safe, 0.0)
            weight = np.where(seen, context[:, 1] / safe, 1.0)
            probability = upper[at] + weight[at] * probability
        add = lambda x: np.add.reduceat(x, starts)
        sizes = np.diff(np.append(starts, len(last)))
        return sizes, add((count > 0)[last].astype(np.int64)), add(base[last]), add(np.log10(probability))


@functools.lru_cache(maxsize=1)
def _lookup(uri: str) -> list:
    """The worker's lookup for a model, kept between tasks."""
    return []


def score_texts(docs: DataFrame, model: Model, held_out: Column, slice_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; one row per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _lookup(model.uri)
        if not held:
            held.append(Lookup(model))
        for batch in slices(batches, 2, slice_bytes):
            sizes, known, base, score = held[0].score(utf8(batch.column(2)))
            columns = [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(sizes), model.tokens), pa.int64()), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_corpus(docs: DataFrame, held_out: Column | None = None, order: int = 2) -> DataFrame:
    """Trains on the rows that are not held out and scores all rows.

    Null and empty texts are the end token alone. Rows that repeat count and are scored each time; a null
    doc_id is not held out. With nothing to train on every score is 0 per token. Other columns are ignored.
    """
    held_out = held_out if held_out is not None else F.coalesce(F.pmod(crc32_text(F.col("doc_id")), F.lit(10)) == 0, F.lit(False))
    return score_texts(docs, train_model(docs.filter(~held_out), order=order), held_out)
