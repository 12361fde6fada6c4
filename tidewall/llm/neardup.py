"""Near-duplicate detection: MinHash, banding, verification, connected components.

1. Every text is shingled where it lies; its set is kept as a 128-bit digest and minima of universal
   hashes: a key for each band, and a byte of each minimum. Texts with one set form a class, from then on
   one node, named by the place of its first row: rows that share a doc_id are as many nodes as they have
   sets. Its text is fetched by its least doc_id and told from others of that id by the digest.
2. A class sends its id to one bucket per band. A bucket is a star: each member is paired only with the
   bucket's pivot, the member that meets most others. Pairs are checked on signatures, then confirmed on
   the full sets; texts that no pair needs are sifted out by a bitmap of fixed size before any shuffle.
3. Components of the confirmed links are found. Where a bucket still holds several components, its
   members are compared within the task, in blocks of bounded size: members of different components
   whose signatures agree enough are confirmed on the full sets there and then, and only links leave. A
   bucket's members that its pivot already joined are left out where the triangle inequality of the
   Jaccard distance shows that no other member can link to them.

So a bucket of any size costs no more than a row for each member and band while its copies agree, no
pair list of a group is ever emitted, and no link between different components is lost but to banding,
which misses a pair at the threshold with probability (1 - 0.75^rows)^bands, 1.3e-6 at 5 and 50.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import FEW_BYTES, discard, release_memory, stored
from tidewall.llm.components import connected_components

WORDS = 5
NEED, OF = 75, 100  # links have OF * intersection >= NEED * union
BANDS, ROWS = 50, 5
#: Minima that signatures keep, of which the first BANDS * ROWS make the bands.
MINIMA = 500
#: Least share of agreeing minima for a candidate: four standard deviations below 0.75 at 500 minima.
AGREE = 0.672
#: Slack on distances taken from signatures when the triangle inequality is used.
SLACK = 0.14
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles, empty without words."""
    words = text.encode().lower().split()  # A-Z only, and exactly the bytes 20, 09 to 0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        mixed *= _MULTIPLIER
        mixed += h[k : len(h) - n + 1 + k]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class MinHasher:
    """Minima of universal hashes (a * x + b modulo 2^64, high half) of a set."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, size, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, np.uint64)[:, None]

    def __call__(self, items: np.ndarray, block: int = 512) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(items), block):
            x = self.a * items[at : at + block]
            x += self.b
            np.minimum(least, x.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


def with_signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, minima: int = MINIMA, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, set_hi, set_lo (digest of the set), keys (8 bytes a band), small (a byte a minimum),
    row (a number of its own) and the columns in `keep`, by the names keep_0 and so on. Only the text crosses
    to Python."""

    @F.pandas_udf("n_shingles long, set_hi long, set_lo long, keys binary, small binary")
    def signature(texts: pd.Series) -> pd.DataFrame:
        release_memory()
        hasher = MinHasher(minima)
        number = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        made = []
        for text in texts:
            found = shingles(text or "")
            least = hasher(found) if len(found) else np.empty(0, np.uint32)
            key = number.copy() if len(found) else number[:0]
            for part in least[: bands * rows].reshape(-1, rows).T.astype(np.uint64):
                key ^= part
                key *= _MULTIPLIER
                key ^= key >> np.uint64(31)
            made.append((len(found), *set_digest(found), key.tobytes(), least.astype(np.uint8).tobytes()))
        return pd.DataFrame(made, columns=["n_shingles", "set_hi", "set_lo", "keys", "small"])

    kept = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    signed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), signature("text").alias("_signature"), *kept)
    return signed.select("doc_id", "row", "_signature.*", *[f"keep_{k}" for k in range(len(keep))])


def band_rows(classes: DataFrame) -> DataFrame:
    """(bucket, band, id): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            bands = len(keys) // n
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(ids, pa.int64())], names=["bucket", "band", "id"])

    return classes.select("id", "keys").mapInArrow(run, "bucket long, band int, id long")


def _sifted(docs: DataFrame, ids: DataFrame, bits: int = 25) -> DataFrame:
    """Rows of docs whose id may be among `ids`, by a bitmap of 2^bits hashed places.

    The bitmap is 2^(bits - 15) rows of 4 kB whatever the number of ids, 4 MB here, so it may be broadcast;
    with more ids it only sifts less. What it lets through by chance goes at the joins that follow.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    bitmaps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return docs.withColumn("_part", F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps), "_part").filter(hit).drop("_part", "_map")


def _agreements(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with `agree`, the share of agreeing minima; by one byte of each."""
    small = classes.select("id", "small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1))], names=["a", "b", "agree"])

    left = pairs.join(small.select(F.col("id").alias("a"), F.col("small").alias("small_a")), "a")
    both = left.join(small.select(F.col("id").alias("b"), F.col("small").alias("small_b")), "b")
    return both.select("a", "b", "small_a", "small_b").mapInArrow(run, "a long, b long, agree double")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are alike enough."""
    if not len(a) or NEED * max(len(a), len(b)) > OF * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= NEED * (len(a) + len(b) - both)


def _texts(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set_hi, set_lo, text) of the nodes `ids`: all texts with the node's doc_id, of which one has its set."""
    named = ids.distinct().join(nodes.select("id", "doc", "set_hi", "set_lo"), "id")
    texts = _sifted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), named.select(F.col("doc").alias("doc_id")))
    return named.join(texts, F.col("doc") == F.col("doc_id")).select("id", "set_hi", "set_lo", "text")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose full shingle sets link."""
    texts = _texts(docs, nodes, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(text: str | None, hi: int, lo: int) -> np.ndarray | None:
            found = shingles(text or "")
            return found if set_digest(found) == (hi, lo) else None

        release_memory()
        last, kept = None, None
        for batch in batches:
            sets = [batch.column(k).to_pylist() for k in range(4, 8)]
            links = []
            for x, y, *ends in zip(batch.column(2), batch.column(3), *sets, strict=True):
                y = (y.as_py() or "", *ends[2:])
                if y != last:
                    last, kept = y, own(*y)
                other = own(x.as_py(), *ends[:2]) if kept is not None else None
                links.append(other is not None and linked(other, kept))
            keep = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda k: texts.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("text", "set_hi", "set_lo")])
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "text_a", "text_b", "set_hi_a", "set_lo_a", "set_hi_b", "set_lo_b").mapInArrow(run, "a long, b long").distinct()


def _comparable(labels: np.ndarray, small: np.ndarray, keys: np.ndarray, band: int, k: int) -> np.ndarray:
    """Later members than the k-th in another component that may link to it and meet it first in this band.

    The first band is seen by the bands' keys, which name the buckets: a byte of each minimum can agree
    where the minima differ, in a bucket where the pair never meets.
    """
    others = np.flatnonzero(labels[k + 1 :] != labels[k]) + k + 1
    others = others[(small[others] == small[k]).mean(axis=1) >= AGREE]
    return others[(keys[others] == keys[k]).argmax(axis=1) == band]


def _by_block(rows: DataFrame, columns: tuple[str, ...], close, schema: str) -> DataFrame:
    """close(band, (bucket, i, j), columns of the members) of each block, which has few rows by construction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        key, band, members = None, 0, []
        for batch in batches:
            places = [batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(4)]
            for bucket, i, j, at, *rest in zip(*places, *(batch.column(k).to_pylist() for k in range(4, 4 + len(columns))), strict=True):
                if (bucket, i, j) != key:
                    if len(members) > 1:
                        yield close(band, key, list(zip(*members, strict=True)))
                    key, band, members = (bucket, i, j), at, []
                members.append(rest)
        if len(members) > 1:
            yield close(band, key, list(zip(*members, strict=True)))

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.select("bucket", "i", "j", "band", *columns).mapInArrow(run, schema)


def _bytes_matrix(values: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _hopeful(rows: DataFrame) -> DataFrame:
    """Those rows (bucket, i, j, band, id, label, small, keys) that signatures may link to another in their block."""

    def close(band: int, key: tuple, members: list) -> pa.RecordBatch:
        ids, labels, small, keys = members
        marked, labels_, small_, keys_ = np.zeros(len(ids), bool), np.array(labels), _bytes_matrix(small, np.uint8), _bytes_matrix(keys, np.int64)
        for k in range(len(ids) - 1):
            others = _comparable(labels_, small_, keys_, band, k)
            marked[others] = True
            marked[k] |= len(others) > 0
        n, mask = int(marked.sum()), pa.array(marked)
        place = [pa.array([x] * n, kind) for x, kind in zip((*key, band), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
        own = [pa.array(x, kind).filter(mask) for x, kind in zip(members, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([*place, *own], names=["bucket", "i", "j", "band", "id", "label", "small", "keys"])

    return _by_block(rows, ("id", "label", "small", "keys"), close, "bucket long, i int, j int, band int, id long, label long, small binary, keys binary")


def _within_blocks(rows: DataFrame) -> DataFrame:
    """Confirmed links between different components, out of rows (bucket, i, j, id, label, band, small, keys, text, set_hi, set_lo).

    A pair that meets in several bands is looked at only in the first of them; a member that has been joined
    to a component here is not compared with it again.
    """

    def close(band: int, key: tuple, members: list) -> pa.RecordBatch:
        ids = members[0]
        if len(set(ids)) < len(ids):  # unlike texts of one doc_id: each node's own is the one with its set
            twice = {k for k, n in Counter(ids).items() if n > 1}
            own = [k for k, m in enumerate(zip(*members, strict=True)) if m[0] not in twice or set_digest(shingles(m[4] or "")) == m[5:]]
            own = list({ids[k]: k for k in own}.values())
            members = [[column[k] for k in own] for column in members]
        ids, labels, small, keys, texts, _, _ = members
        labels, small, keys, links = np.array(labels), _bytes_matrix(small, np.uint8), _bytes_matrix(keys, np.int64), []
        of = functools.lru_cache(maxsize=None)(lambda k: shingles(texts[k] or ""))
        for k in range(len(ids) - 1):
            for o in _comparable(labels, small, keys, band, k).tolist():
                if labels[o] != labels[k] and linked(of(k), of(o)):
                    links.append((ids[k], ids[o]))
                    labels[labels == labels[o]] = labels[k]
        return _pairs_batch(links)

    return _by_block(rows, ("id", "label", "small", "keys", "text", "set_hi", "set_lo"), close, "a long, b long").distinct()


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])


def _unsettled(buckets: DataFrame, stars: DataFrame, agreements: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, block: int) -> DataFrame:
    """Rows for _within_blocks: members of buckets that hold several components after the star links."""
    known = buckets.join(labels.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").join(_salts(stars), "bucket").select("bucket", "salt", "pivot")
    rows = _salted(known).join(mixed, ["bucket", "salt"])
    pivots = labels.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_label"))
    rows = rows.join(pivots, "pivot", "left").withColumn("pivot_label", F.coalesce("pivot_label", "pivot"))
    rows = rows.join(agreements.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "agree"), ["id", "pivot"], "left")
    rows = rows.withColumn("away", 1 - F.when(F.col("id") == F.col("pivot"), 1.0).otherwise(F.coalesce("agree", F.lit(0.0)))).withColumn("joined", F.col("label") == F.col("pivot_label"))
    rows = stored(rows.select("bucket", "band", "id", "label", "away", "joined"), "unsettled")
    link = 1 - NEED / OF
    reach = rows.groupBy("bucket").agg(F.max(F.when(F.col("joined"), F.col("away"))).alias("joined_most"))
    rows = rows.join(reach, "bucket").withColumn("grey", ~F.col("joined") & (F.col("away") <= F.col("joined_most") + link + SLACK))
    bounds = rows.groupBy("bucket").agg(F.min(F.when(F.col("grey"), F.col("away"))).alias("grey_least"))
    rows = rows.join(bounds, "bucket").filter(~F.col("joined") | (F.col("away") >= F.col("grey_least") - link - SLACK))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket", F.ceil(F.col("members") / block).cast("int").alias("parts"))
    rows = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "id", "label")
    hopeful = stored(_hopeful(rows.join(classes.select("id", "small", "keys"), "id")), "hopeful", batch_bytes=FEW_BYTES)
    return hopeful.join(_texts(docs, classes, hopeful.select("id")), "id")


def _salted(rows: DataFrame, each: int = 100_000) -> DataFrame:
    """Members with a salt that splits buckets of more than `each`."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.floor(F.col("n") / each) + 1))


def _salts(stars: DataFrame, each: int = 100_000) -> DataFrame:
    """Stars, once for every salt of their bucket."""
    return stars.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / each))))


def _placed(docs: DataFrame, bands: int, rows: int, block: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, row, component_row, component_id, kept), and the signature table; what led there is deleted."""
    signed = stored(with_signatures(docs, bands, rows, max(MINIMA, bands * rows), keep), "signatures", batch_bytes=FEW_BYTES)
    sets = signed.filter("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("row").alias("id"), F.min("doc_id").cast("long").alias("doc"), F.first("keys").alias("keys"), F.first("small").alias("small"))
    classes = stored(sets, "classes")
    nodes = classes.filter("doc is not null")
    buckets = band_rows(nodes)
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(buckets.join(full, "bucket"), "members")
    central = members.groupBy("id").agg(F.sum("n").alias("meets"))
    stars = stored(members.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("pivot"), F.first("n").alias("n")), "stars")
    pairs = _salted(members).join(_salts(stars).drop("n"), ["bucket", "salt"]).filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    agreements = stored(_agreements(pairs, nodes), "agreements", batch_bytes=FEW_BYTES)
    links = stored(confirmed(agreements.filter(F.col("agree") >= AGREE), nodes, docs), "links", batch_bytes=FEW_BYTES)
    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    extra = stored(_within_blocks(_unsettled(members, stars, agreements, labels, nodes, docs, block)), "links", batch_bytes=FEW_BYTES)
    if not extra.isEmpty():
        joined = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(extra.select(F.col("a").alias("u"), F.col("b").alias("v")))
        labels = connected_components(joined)
    found = classes.select("set_hi", "set_lo", "id", "doc").join(labels, F.col("id") == F.col("node"), "left").withColumn("component_row", F.coalesce("component", "id"))
    names = found.groupBy("component_row").agg(F.min("doc").alias("component_id"))
    found = found.select("set_hi", "set_lo", "component_row").join(names, "component_row")
    out = signed.select("doc_id", "n_shingles", "set_hi", "set_lo", "row").join(found, ["set_hi", "set_lo"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id").cast(docs.schema["doc_id"].dataType))
    out = out.select("doc_id", "n_shingles", "row", F.coalesce("component_row", "row").alias("component_row"), "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
    placed = stored(out, "placed")
    for table in (classes, members, stars, agreements, links, extra):
        discard(table)
    return placed, signed


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component_row: one row per row of docs.

    Rows without words have no shingles, are linked with nothing and kept. Rows that repeat a doc_id are
    placed each by its own text: component_id is the least id reachable, so unlike groups may bear one id there;
    component_row, the place of a row of the group, tells them apart. Rows with a null id take the component of
    equal sets, if any, are linked with nothing else, and are kept only where no id is found. Other columns are
    ignored; an empty table gives no rows.
    """
    return _placed(docs, bands, rows, block, ())[0].select("doc_id", "n_shingles", "component_id", "kept", "component_row")


def one_of_each(docs: DataFrame, columns: tuple[str, ...], bands: int = BANDS, rows: int = ROWS, block: int = 512) -> DataFrame:
    """The given columns of one row of each group of near duplicates: a row with the group's least id.

    Groups are told apart by their texts, also where they share an id. Of a group's rows with that id, or of equal
    rows without ids, the first that was read stays. Rows without words are no group and all stay.
    """
    placed, signed = _placed(docs, bands, rows, block, columns)
    firsts = placed.filter("kept").groupBy("component_row").agg(F.min("row").alias("row")).select("row")
    return signed.select("row", *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(columns)]).join(firsts, "row", "left_semi").select(*columns)
