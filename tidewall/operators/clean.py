"""Projections, filters, cleaning and typing of asset tables. Every function is lazy unless it says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.operators.running import running_totals

SOP_SENTINELS = (9999, 10000)
AGE_LIMITS = (0.0, 150.0)
DAYS_A_YEAR = 365.25
#: Sources of flooding and the literal text that names them in a protection type.
SOURCES = {"fluvial": "Fluvial", "coastal": "Coastal", "tidal": "Tidal", "surface_water": "Surface Water"}


class QualityError(ValueError):
    """A contract on a table does not hold."""


def null_sentinels(df: DataFrame, columns: Sequence[str], sentinels: Sequence[float]) -> DataFrame:
    """Listed values become null; text columns are read as numbers first, and text that is none is null."""
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c).try_cast("double") if kinds[c] == "string" else F.col(c)
    return df.withColumns({c: F.when(~number(c).isin(*sentinels), number(c)) for c in columns})


def age_years(at: Column, since: Column, limits: tuple[float, float] = AGE_LIMITS) -> Column:
    """Whole days between two dates over 365.25, null outside the limits."""
    age = F.datediff(at.cast("date"), since) / F.lit(DAYS_A_YEAR)
    return F.when(age.between(*limits), age)


def bin_top_k(df: DataFrame, column: str, out: str, k: int = 20, rest: str = "the_rest") -> DataFrame:
    """The k most frequent values stay, others become `rest`, null stays null; ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    top = counts.orderBy(F.desc("count"), column).limit(k).select(F.col(column).alias("_top"))
    joined = df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left")
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce("_top", F.lit(rest)))).drop("_top")


def encode_categories(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based code of a value among the sorted distinct ones; null stays null. Runs a job, as `running_totals` does."""
    values = df.select(F.col(column).alias("_value")).filter("_value is not null").distinct()
    codes = running_totals(values.withColumn("_one", F.lit(1)), [F.asc("_value")], {"_upto": "_one"}).select("_value", (F.col("_upto") - 1).cast("int").alias(out))
    return df.join(codes, F.col(column) == F.col("_value"), "left").drop("_value")


def regex_flag(column: Column, pattern: str) -> Column:
    """1 or 0 by a regular expression, null stays null."""
    return column.rlike(pattern).cast("int")


def source_flags(column: Column, prefix: str, patterns: Mapping[str, str] = SOURCES) -> dict[str, Column]:
    """A boolean for each literal text, false on null."""
    return {f"{prefix}{name}": F.coalesce(F.contains(column, F.lit(text)), F.lit(False)) for name, text in patterns.items()}


def numeric_transforms(df: DataFrame, log_columns: Sequence[str], missing_columns: Sequence[str]) -> DataFrame:
    """log1p of some columns and 0/1 missing indicators of others."""
    return df.withColumns({f"{c}_log1p": F.log1p(c) for c in log_columns} | {f"{c}_missing": F.col(c).isNull().cast("int") for c in missing_columns})


def parse_grade(column: Column) -> Column:
    """The leading integer of a text such as " 3 - Fair"; null if there is none."""
    return F.regexp_extract(F.trim(column), r"^(\d+)", 1).try_cast("int")


def parse_code(column: Column) -> Column:
    """The part of a text before " - "."""
    return F.split(column, " - ")[0]


def parse_date(column: Column, pattern: str = "dd/MM/yyyy") -> Column:
    return F.try_to_date(column, pattern)


def bool_flag(column: Column) -> Column:
    return F.lower(F.trim(column)) == "true"


def harmonise_schema(df: DataFrame, renames: Mapping[str, str], required: Iterable[str] = ()) -> tuple[DataFrame, str]:
    """Lower-case names; old names become new ones where the new are absent. Also says pre, post or mixed."""
    df = df.toDF(*[c.lower() for c in df.columns])
    old = [o for o in renames if o in df.columns]
    new = [n for n in renames.values() if n in df.columns]
    df = df.withColumnsRenamed({o: renames[o] for o in old if renames[o] not in df.columns})
    if missing := sorted(set(required) - set(df.columns)):
        raise QualityError(f"missing columns: {', '.join(missing)}")
    return df, "mixed" if old and new else "pre" if old else "post"


def namespace_columns(df: DataFrame, prefix: str, keep: Sequence[str] = (), match: str = ".*", rename: Callable[[str], str] = str.lower) -> DataFrame:
    """Columns that match a pattern, renamed and prefixed; those in `keep` go first under their own names."""
    chosen = [c for c in df.columns if c not in keep and re.fullmatch(match, c)]
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{rename(c)}") for c in chosen])


def normalise_ids(column: Column) -> Column:
    """Numbers such as 12.0 as the text 12."""
    return column.cast("long").cast("string")


def drop_exact_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns or df.columns))


def latest_per_key(df: DataFrame, key: str, date: str, tie: str) -> DataFrame:
    """The row with the latest date of each key; undated rows last, ties to the larger `tie`."""
    order = Window.partitionBy(key).orderBy(F.col(date).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def quality_gates(df: DataFrame, rules: Mapping[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """(rule, n_bad): rows that break each rule (a condition that should hold; null breaks it), in one pass,
    and the rows in excess of one per key."""
    columns = {name: F.count_if(~F.coalesce(rule, F.lit(False))) for name, rule in rules.items()}
    if unique:
        columns[f"unique_{'_'.join(unique)}"] = F.count("*") - F.count_distinct(F.struct(*unique))
    found = df.agg(*[c.alias(n) for n, c in columns.items()])
    return found.unpivot([], list(columns), "rule", "n_bad")


def raise_on_bad(gates: DataFrame) -> None:
    """Runs the gates and raises with the rules that are broken."""
    if bad := gates.filter("n_bad > 0").collect():
        raise QualityError("; ".join(f"{r.rule}: {r.n_bad}" for r in bad))


def assert_no_leak(df: DataFrame, forbidden: Iterable[str]) -> DataFrame:
    if leaks := sorted(set(forbidden) & set(df.columns)):
        raise QualityError(f"columns that leak the target: {', '.join(leaks)}")
    return df


def attach_blocks(spine: DataFrame, blocks: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Left joins feature blocks that have one row per key; a block with repeated keys raises (one count)."""
    for name, block in blocks.items():
        if block.groupBy(key).count().filter("count > 1").limit(1).count():
            raise QualityError(f"block {name} repeats keys")
        spine = spine.join(block, key, "left")
    return spine


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, coverage): the share of rows with a value."""
    found = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    return found.unpivot([], list(columns), "column", "coverage")


def build_feature_set(df: DataFrame, columns: Sequence[str], categorical: Sequence[str] = (), max_bins: int = 32, out: str = "features") -> DataFrame:
    """A feature vector of the named columns in order. Columns without a value or with one value only, and
    categories beyond max_bins, raise; null is one less than the column's least value."""
    from pyspark.ml.feature import VectorAssembler

    stats = df.agg(*[x for c in columns for x in (F.count_distinct(c).alias(f"{c}__n"), F.min(F.col(c).cast("double")).alias(f"{c}__least"))]).first()
    if dead := [c for c in columns if stats[f"{c}__n"] < 2]:
        raise QualityError(f"columns without information: {', '.join(dead)}")
    if wide := [c for c in categorical if stats[f"{c}__n"] > max_bins]:
        raise QualityError(f"more than {max_bins} categories: {', '.join(wide)}")
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(stats[f"{c}__least"] - 1)) for c in columns})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol=out).transform(filled).drop(*[f"_f_{c}" for c in columns])


def subset_counts(df: DataFrame, keep: Column, by: Sequence[str]) -> DataFrame:
    return df.filter(keep).groupBy(*by).agg(F.count("*").alias("n"))


def column_conflicts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, both_differ, only_first, only_second, same), blank text counting as null."""
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    parts = []
    for a, b in pairs:
        x, y = blank(a), blank(b)
        parts.append(df.agg(F.lit(f"{a}|{b}").alias("pair"), F.count_if(x.isNotNull() & y.isNotNull() & (x != y)).alias("both_differ"), F.count_if(x.isNotNull() & y.isNull()).alias("only_first"), F.count_if(x.isNull() & y.isNotNull()).alias("only_second"), F.count_if(x.eqNullSafe(y)).alias("same")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Ground-stability themes, each with a class from 1 to 3, and the nominal columns.
GROUND_THEMES = ("collapsible_deposits", "compressible_ground", "landslides", "running_sand", "shrink_swell", "soluble_rocks")
NOMINAL = ("sub_type", "protection_type", "primary_purpose")


def prepare_features(assets: DataFrame, excluded: Sequence[str] = ("Natural High Ground",), top_lithologies: int = 20) -> DataFrame:
    """Typed model features of assets in scope: grade 1 to 5 after half-even rounding, sub-type known and not excluded.

    Nominal columns keep their text and have a code beside it, its place among the sorted values in scope;
    binned lithologies too, the rest last. Ground classes are small integers, null where they are no number.
    """
    df = assets.withColumn("condition_grade", F.bround("grade", 0).cast("int"))
    df = df.filter(F.col("condition_grade").between(1, 5) & ~F.col("sub_type").isin(*excluded))
    df = bin_top_k(null_sentinels(df, ["design_sop"], SOP_SENTINELS), "lithology", "lithology_binned", top_lithologies)
    df = df.withColumn("age_years", age_years(F.col("inspection_date"), F.col("asset_start_date")))
    for c in NOMINAL:
        df = encode_categories(df, c, f"{c}_code")
    df = df.withColumn("_sorted", F.when(F.col("lithology_binned") == "the_rest", F.lit("\U0010ffff")).otherwise(F.col("lithology_binned")))
    df = encode_categories(df, "_sorted", "lithology_code")
    missing = lambda c: F.col(c).isNull().cast("int")
    return df.select(
        "asset_id", "condition_grade", *[x for c in NOMINAL for x in (c, f"{c}_code")], "lithology_binned", "lithology_code", *[F.col(f"geosure_{t}").try_cast("byte").alias(f"geosure_{t}") for t in GROUND_THEMES],
        regex_flag(F.col("maintainer"), "(?i)environment agency").alias("maintainer_is_ea"), F.log1p("asset_length").alias("asset_length_log1p"),
        "actual_dcl", missing("actual_dcl").alias("actual_dcl_missing"), "design_sop", missing("design_sop").alias("design_sop_missing"), "age_years", missing("age_years").alias("age_estimated"),
    )
