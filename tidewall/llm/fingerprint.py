"""Document fingerprints that add up: a homomorphic hash of the multiset of paragraphs.

Each paragraph hashes to a wide vector and a document's fingerprint is the sum of its paragraphs'
vectors modulo powers of two. So the order of paragraphs does not matter, equal multisets have equal
fingerprints, and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has eight 32-bit lanes from the whole paragraph (modulo 2^32, for equality), a count of its
clauses, and sixty counters of its clauses' hash bits (modulo 2^19, packed by three in a long, for
likeness): two documents' counters, taken about their mean, have about the cosine that their clause
multisets have. Only Spark's own functions are used; each row is worked on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import stored

DENSE_SEEDS = (11, 23, 37, 53)
LANE, KEEP = 20, 0x7FFFF
ONES = 1 | 1 << LANE | 1 << 2 * LANE
KEEPS = KEEP | KEEP << LANE | KEEP << 2 * LANE
LOW = 0xFFFFFFFF
CLAUSE_END = r"[\n,.;:!?]+"


def _total(values: Column, part, mask: int) -> Column:
    """The sum of part(value) modulo the lanes in `mask`."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, h: (acc + part(h)).bitwiseAND(F.lit(mask)))


def _seeded(seed: int):
    return lambda p: F.xxhash64(p, F.lit(seed))


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, array<long>: 8 equality lanes, the clause count, 20 packed counter lanes. Null text: as empty.

    Blank paragraphs and clauses count as none, so the empty text is the zero vector. The hash lists are
    columns of their own for a while, so that each is made once and not for every lane.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lists = {f"_p{k}": F.transform(F.filter(F.split(t, "\n"), lambda p: p != ""), _seeded(seed)) for k, seed in enumerate(DENSE_SEEDS)}
    lists["_c"] = F.transform(F.filter(F.split(t, CLAUSE_END), lambda c: F.trim(c) != ""), lambda c: F.xxhash64(F.trim(c)))
    made = df.withColumns(lists)
    dense = [_total(F.col(f"_p{k}"), part, LOW) for k in range(len(DENSE_SEEDS)) for part in (lambda h: h.bitwiseAND(_long(LOW)), lambda h: F.shiftrightunsigned(h, 32))]
    counters = [_total(F.col("_c"), lambda h, j=j: F.shiftrightunsigned(h, j).bitwiseAND(_long(ONES)), KEEPS) for j in range(LANE)]
    return made.withColumn(out, F.array(*dense, F.size("_c").cast("long").bitwiseAND(_long(KEEP)), *counters)).drop(*lists)


def _lanes() -> list[int]:
    return [LOW] * (2 * len(DENSE_SEEDS)) + [KEEP] + [KEEPS] * LANE


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.array(*[(a[i] + b[i]).bitwiseAND(_long(m)) for i, m in enumerate(_lanes())])


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a's multiset without b's, which must lie in it."""
    guard = [LOW + 1] * (2 * len(DENSE_SEEDS)) + [KEEP + 1] + [(KEEP + 1) * ONES] * LANE
    return F.array(*[(a[i] + _long(g) - b[i]).bitwiseAND(_long(m)) for i, (m, g) in enumerate(zip(_lanes(), guard, strict=True))])


def to_text(a: Column) -> Column:
    """Lower-case hex, 8 digits for an equality lane and 15 for a packed counter lane."""
    wide = [8] * (2 * len(DENSE_SEEDS)) + [5] + [15] * LANE
    return F.lower(F.concat(*[F.lpad(F.hex(a[i]), w, "0") for i, w in enumerate(wide)]))


def _counters(a: Column) -> Column:
    """Each counter as ones less zeros, as a double."""
    n = a[8]
    lanes = F.flatten(F.transform(F.slice(a, 10, LANE), lambda v: F.array(*[F.shiftrightunsigned(v, k * LANE).bitwiseAND(_long(KEEP)) for k in range(3)])))
    return F.transform(lanes, lambda c: (F.lit(2) * c - n).cast("double"))


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, for each name, the likeness of two fingerprint columns: 1 if equal, 0 if one has no clause,
    else the cosine of their counters, negative ones as 0."""
    sides = sorted({x for pair in pairs.values() for x in pair})
    df = df.withColumns({f"_n_{x}": _counters(F.col(x)) for x in sides})
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    df = df.withColumns({f"_s_{x}": dot(F.col(f"_n_{x}"), F.col(f"_n_{x}")) for x in sides})
    out = {}
    for name, (a, b) in pairs.items():
        cosine = dot(F.col(f"_n_{a}"), F.col(f"_n_{b}")) / F.sqrt(F.col(f"_s_{a}") * F.col(f"_s_{b}"))
        out[name] = F.when(F.col(a) == F.col(b), 1.0).when((F.col(f"_s_{a}") == 0) | (F.col(f"_s_{b}") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))
    return df.withColumns(out).drop(*[f"_{k}_{x}" for k in "ns" for x in sides])


def ranked(docs: DataFrame, partition_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, text, place): place 0 is the greatest doc_id, and so on without gaps; null ids come last.

    Rows are sorted into ranges once and stored. A row's place is its range's first one and its number there;
    the only table that is broadcast has a row per range. Rows that share an id go by a hash of their texts.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 20), F.lit(0))).first()[0]
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie"), F.col("_row")]
    ranges = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(max(1, -(-size // partition_bytes)), *order).sortWithinPartitions(*order)
    numbered = stored(ranges.select("doc_id", "text", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(_long((1 << 33) - 1)).alias("_at")), "ranked")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = numbered.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    return numbered.join(F.broadcast(firsts), "_range").select("doc_id", "text", (F.col("_first") + F.col("_at")).alias("place"))


def with_next(docs: DataFrame, bucket_rows: int = 1500) -> DataFrame:
    """(doc_id, text) with `fp` and the next row's `next_text` and `next_fp`, by descending doc_id, cyclic.

    Rows that follow one another share a bucket; the first row of each bucket is also sent to the end of the
    bucket before it (that of the first bucket to the last), so no bucket has to see another.
    """
    rows = ranked(docs)
    n, place = docs.count(), F.col("place")
    bucket = F.floor(place / bucket_rows).cast("long")
    ghost = F.struct(F.when(bucket == 0, (n - 1) // bucket_rows).otherwise(bucket - 1).alias("bucket"), F.when(place == 0, n).otherwise(place).alias("place"), F.lit(True).alias("ghost"))
    own = F.struct(bucket.alias("bucket"), place.alias("place"), F.lit(False).alias("ghost"))
    rows = rows.withColumn("_to", F.explode(F.when(place % bucket_rows == 0, F.array(own, ghost)).otherwise(F.array(own)))).select("doc_id", "text", "_to.*")
    rows = with_fingerprint(rows.repartition("bucket"), "text", "fp")
    ahead = Window.partitionBy("bucket").orderBy("place")
    return rows.select("doc_id", "text", "fp", "ghost", F.lead("text").over(ahead).alias("next_text"), F.lead("fp").over(ahead).alias("next_fp")).filter(~F.col("ghost")).drop("ghost")


def fingerprint_documents(docs: DataFrame, bucket_rows: int = 1500) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones (or all) of
    the next document's. Null texts are empty; a lone document is its own next; an empty table gives none;
    rows that share an id follow one another.
    """
    near = with_next(docs, bucket_rows).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = with_likeness(with_fingerprint(edited, "edited", "edited_fp"), {"near_edited": ("fp", "edited_fp"), "near_next": ("fp", "next_fp")})
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), to_text(F.col("fp")).alias("fingerprint"), to_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
