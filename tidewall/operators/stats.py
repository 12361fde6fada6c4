"""Exploratory statistics of asset tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.operators.running import correlation, exact_quantiles, running_totals
from tidewall.sources.shared import stored


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, pct_null, pct_coverage), one pass."""
    names = list(columns or df.columns)
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    long = wide.unpivot(["_n"], names, "column", "n_null")
    return long.select("column", "n_null", (100 * F.col("n_null") / F.col("_n")).alias("pct_null"), (100 - 100 * F.col("n_null") / F.col("_n")).alias("pct_coverage"))


def value_counts(df: DataFrame, column: str, rare_share: float = 0.01, rare_rows: int = 50) -> DataFrame:
    """(value, n, pct, cum_pct, rare) by falling count, ties by value; rare: under the share or the rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    whole = df.agg(F.count("*").alias("_all"))
    share = F.col("n") / F.col("_all")
    running = running_totals(counts, [F.desc("n"), F.asc("value")], {"_up": "n"}).crossJoin(F.broadcast(whole))
    return running.select("value", "n", (100 * share).alias("pct"), (100 * F.col("_up") / F.col("_all")).alias("cum_pct"), ((share < rare_share) | (F.col("n") < rare_rows)).alias("rare"))


def status_breakdown(df: DataFrame, column: str, codes: Mapping[str, str]) -> DataFrame:
    """(status, n, pct): null, blank, each named code, value."""
    c = F.col(column)
    status = F.when(c.isNull(), "null").when(F.trim(c) == "", "blank")
    for code, name in codes.items():
        status = status.when(F.trim(c) == code, name)
    counts = df.groupBy(status.otherwise("value").alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def pattern_audit(df: DataFrame, column: str, pattern: str, samples: int = 5) -> DataFrame:
    """(n_filled, n_match, n_exceptions, examples): how far text keeps to a pattern, with the least exceptions."""
    c = F.col(column)
    filled, fits = c.isNotNull() & (F.trim(c) != ""), c.rlike(pattern)
    odd = df.filter(filled & ~fits).select(c.alias("v")).distinct().orderBy("v").limit(samples).agg(F.array_join(F.sort_array(F.collect_list("v")), "|").alias("examples"))
    return df.agg(F.count_if(filled).alias("n_filled"), F.count_if(filled & fits).alias("n_match"), F.count_if(filled & ~fits).alias("n_exceptions")).crossJoin(F.broadcast(odd))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts by row and column with totals (row null is the total row), and each value's share of its row."""
    cube = df.filter(F.col(column).isin(*values) & F.col(row).isNotNull()).rollup(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values], F.count("*").alias("total"))
    return cube.select(F.coalesce(row, F.lit("total")).alias(row), *map(str, values), "total", *[(100 * F.col(str(v)) / F.col("total")).alias(f"pct_{v}") for v in values])


def text_variants(df: DataFrame, column: str) -> DataFrame:
    """(key, n_variants, n): trimmed lower-case keys that are written in more than one way."""
    key = F.lower(F.trim(column))
    return df.filter(F.col(column).isNotNull()).groupBy(key.alias("key")).agg(F.count_distinct(column).alias("n_variants"), F.count("*").alias("n")).filter("n_variants > 1")


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, sd, min, q25, median, q75, max, skew, kurtosis, skew_log1p): population moments, excess kurtosis."""
    long = df.unpivot([], list(columns), "column", "v").filter("v is not null")
    out = long.groupBy("column").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurtosis"), F.skewness(F.when(F.col("v") > -1, F.log1p("v"))).alias("skew_log1p"))
    out = out.join(exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["column"], "_q"), "column")
    return out.select("column", "n", "mean", "sd", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "max", "skew", "kurtosis", "skew_log1p")


def sentinel_scan(df: DataFrame, columns: Sequence[str], sentinels: Sequence[float], limit: float) -> DataFrame:
    """(column, n_sentinel, n_non_positive, n_over)."""
    long = df.unpivot([], list(columns), "column", "v")
    return long.groupBy("column").agg(F.count_if(F.col("v").isin(*sentinels)).alias("n_sentinel"), F.count_if(F.col("v") <= 0).alias("n_non_positive"), F.count_if(F.col("v") > limit).alias("n_over"))


def extremes(df: DataFrame, key: str, column: str, k: int = 10) -> DataFrame:
    """The k largest and k smallest rows (end, key, value); ties by key."""
    some = df.filter(F.col(column).isNotNull()).select(key, F.col(column).alias("value"))
    top, low = some.orderBy(F.desc("value"), key).limit(k), some.orderBy("value", key).limit(k)
    return top.select(F.lit("top").alias("end"), "*").unionByName(low.select(F.lit("bottom").alias("end"), "*"))


def rule_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_broken, pct): rows for which a condition of error holds."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    return wide.unpivot(["_n"], list(rules), "rule", "n_broken").select("rule", "n_broken", (100 * F.col("n_broken") / F.col("_n")).alias("pct"))


def with_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Average ranks {column}__rank of the non-null values, within groups.

    Ranks come from counts by distinct value, summed range by range, so a group may be of any size. With `weight`,
    a row counts as that many equal rows.
    """
    for c in columns:
        n = F.sum(weight) if weight else F.count("*")
        counts = df.filter(F.col(c).isNotNull()).groupBy(*by, F.col(c).alias("_v")).agg(n.alias("_n"))
        below = running_totals(counts, [F.asc("_v")], {"_below": "_n"}, by)
        ranks = below.select(*by, "_v", (F.col("_below") - (F.col("_n") - 1) / 2).alias(f"{c}__rank"))
        on = [df[c] == ranks["_v"], *[df[b].eqNullSafe(ranks[b]) for b in by]]
        df = df.join(ranks, reduce(lambda a, b: a & b, on), "left").drop("_v", *[ranks[b] for b in by])
    return df


def corr_matrix(df: DataFrame, columns: Sequence[str], log1p: Sequence[str] = ()) -> DataFrame:
    """(x, y, n, pearson, spearman) of every ordered pair, over the rows where both are known.

    Pairs are laid out long, so that one set of shuffles serves all of them: ranks within a pair come from its
    counts by value, and one aggregation by pair gives both coefficients.
    """
    df = df.select(*[(F.log1p(c) if c in log1p else F.col(c).cast("double")).alias(c) for c in columns])
    pairs = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("a"), F.col(b).alias("b")) for i, a in enumerate(columns) for b in columns[i:]]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("a is not null and b is not null")
    ranked = with_ranks(long, ["a", "b"], ["x", "y"])
    half = ranked.groupBy("x", "y").agg(F.count("*").alias("n"), correlation("a", "b").alias("pearson"), correlation("a__rank", "b__rank").alias("spearman"))
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y"))).otherwise(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return half.withColumn("s", F.explode(sides)).select("s.x", "s.y", "n", "pearson", "spearman")


def cross_corr(df: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(x, y, n, spearman) of each of `rows` with each of `columns`, over the rows of `df` where all are known.

    The rows are the same for every pair, so each column is ranked once and one aggregation gives the block. No
    complete row gives n = 0 and nulls.
    """
    names = list(dict.fromkeys([*rows, *columns]))
    ranked = with_ranks(df.select(*names).dropna(), names)
    pairs = [(x, y) for x in rows for y in columns]
    wide = ranked.agg(F.count("*").alias("n"), *[correlation(f"{x}__rank", f"{y}__rank").alias(f"_{i}") for i, (x, y) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", F.col(f"_{i}").alias("spearman")) for i, (x, y) in enumerate(pairs)])
    return wide.select(F.inline(cells))


def group_spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, rho, p): within each group and over all rows; p by the normal approximation rho * sqrt(n - 1)."""
    both = df.select(group, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    every = both.withColumn(group, F.lit("ALL")).unionByName(both.filter(F.col(group).isNotNull()))
    ranked = with_ranks(every, [x, y], [group])
    return ranked.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), correlation(f"{x}__rank", f"{y}__rank").alias("rho")).withColumn("p", normal_tail(F.abs("rho") * F.sqrt(F.col("n") - 1)))


def quantile_lift(df: DataFrame, feature: str, target: str, bins: int = 4, positive: float = 4) -> DataFrame:
    """(bin, low, high, n, mean_target, share_positive, lift): right-closed bins at interpolated quantiles, equal
    edges merged; lift is the bin's share of positives over that of all rows."""
    known = df.select(F.col(feature).alias("v"), F.col(target).alias("t")).filter("v is not null and t is not null")
    edges = exact_quantiles(known, "v", [k / bins for k in range(bins + 1)]).select(F.array_distinct("quantiles").alias("edges"))
    edges = edges.crossJoin(F.broadcast(known.agg(F.avg((F.col("t") >= positive).cast("int")).alias("_all"))))
    placed = known.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("v")))))
    share = F.avg((F.col("t") >= positive).cast("int"))
    out = placed.groupBy("bin").agg(F.first(F.col("edges")[F.col("bin") - 1]).alias("low"), F.first(F.get("edges", F.col("bin"))).alias("high"), F.count("*").alias("n"), F.avg("t").alias("mean_target"), share.alias("share_positive"), F.first("_all").alias("_all"))
    return out.withColumn("lift", F.try_divide("share_positive", "_all")).drop("_all")


def exposure_split(df: DataFrame, flag: Column, target: str, by: Sequence[str] = (), positive: float = 4) -> DataFrame:
    """(by, exposed, n, mean_target, share_positive)."""
    return df.groupBy(*by, flag.alias("exposed")).agg(F.count("*").alias("n"), F.avg(target).alias("mean_target"), F.avg((F.col(target) >= positive).cast("int")).alias("share_positive"))


def poisson_weight(seed: int, key: str = "k", replicate: str = "r") -> Column:
    """A Poisson(1) number for each key and replicate, by a seeded hash; one above 8 counts as 8 (1e-6 of them)."""
    u = F.pmod(F.xxhash64(key, replicate, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    steps = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k)) for k in range(1, 9)]
    return reduce(lambda a, b: a + b, [(u >= step).cast("int") for step in steps])


def bootstrap_rho(long: DataFrame, replicates: int, seed: int = 7, anew: bool = True) -> DataFrame:
    """(feature, r, rho): rank correlations of v and t of (feature, k, v, t) in each of the resamples 1 to `replicates`.

    A resample gives each row a Poisson(1) weight. With `anew` its values are ranked as if each row stood there as
    often as its weight says, by ranges of (feature, replicate, value); else the ranks of all rows are kept, which
    saves a ranking but leaves out how ranks vary. Rows without weight go before anything is shuffled. A resample
    without spread has a null rho.
    """
    rows = long if anew else with_ranks(long, ["v", "t"], ["feature"])
    drawn = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", poisson_weight(seed)).filter("w > 0")
    if anew:
        cells = drawn.groupBy("feature", "r", "v", "t").agg(F.sum("w").alias("w"))
        drawn = with_ranks(cells, ["v", "t"], ["feature", "r"], weight="w")
    m = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    x, y = F.col("v__rank"), F.col("t__rank")
    sums = drawn.groupBy("feature", "r").agg(m(x).alias("mx"), m(y).alias("my"), m(x * y).alias("xy"), m(x * x).alias("xx"), m(y * y).alias("yy"))
    spread = F.sqrt((F.col("xx") - F.col("mx") ** 2) * (F.col("yy") - F.col("my") ** 2))
    return sums.select("feature", "r", F.when(spread > 0, (F.col("xy") - F.col("mx") * F.col("my")) / spread).alias("rho"))


def target_stats(df: DataFrame, features: Sequence[str], target: str, positive: float = 4, replicates: int = 0, seed: int = 7, key: str = "asset_id", anew: bool = False) -> DataFrame:
    """(feature, n, rho, sign, ap, prevalence, ap_lift[, rho_low, rho_high]).

    ap ranks by the feature in the direction of rho. With replicates, the 95% interval of `bootstrap_rho`, its
    ranks made `anew` in each resample or not; those of resamples may all lie below rho, where it is the largest. All
    features go through one set of shuffles; one without known rows has n = 0 and nulls.
    """
    sides = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select(F.col(key).alias("k"), F.col(target).cast("double").alias("t"), F.explode(sides).alias("s")).select("s.feature", "k", "s.v", "t").filter("v is not null and t is not null")
    hit = F.col("t") >= positive
    stats = with_ranks(long, ["v", "t"], ["feature"]).groupBy("feature").agg(F.count("*").alias("n"), correlation("v__rank", "t__rank").alias("rho"), F.avg(hit.cast("int")).alias("prevalence"))
    stats = stored(stats, "rho")
    counts = long.groupBy("feature", "v").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("pos")).join(stats.select("feature", "rho"), "feature")
    run = running_totals(counts.withColumn("_o", F.when(F.col("rho") < 0, F.col("v")).otherwise(-F.col("v"))), [F.asc("_o")], {"k": "n", "tp": "pos"}, ["feature"])
    out = stats.join(run.groupBy("feature").agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("k")), F.sum("pos")).alias("ap")), "feature")
    if replicates:
        ends = exact_quantiles(bootstrap_rho(long, replicates, seed, anew), "rho", [0.025, 0.975], ["feature"], "_ends")
        out = out.join(ends, "feature", "left").withColumns({"rho_low": F.col("_ends")[0], "rho_high": F.col("_ends")[1]})
    spine = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    extra = ["rho_low", "rho_high"] if replicates else []
    return spine.join(out, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"), "rho", F.signum("rho").alias("sign"), "ap", "prevalence", F.try_divide("ap", "prevalence").alias("ap_lift"), *extra)


def mutual_info(df: DataFrame, feature: str, target: str, bins: int = 10) -> DataFrame:
    """(feature, n, mi, noise): plug-in mutual information of quantile bins and grades in nats, and its expected
    value for independent columns, (bins - 1)(grades - 1) / 2n."""
    known = df.select(F.col(feature).alias("v"), F.col(target).alias("t")).filter("v is not null and t is not null")
    edges = exact_quantiles(known, "v", [k / bins for k in range(1, bins)]).select(F.array_distinct("quantiles").alias("edges"))
    placed = known.crossJoin(F.broadcast(edges)).withColumn("b", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    joint = placed.groupBy("b", "t").agg(F.count("*").alias("c"))
    joint = joint.withColumns({"cb": F.sum("c").over(Window.partitionBy("b")), "ct": F.sum("c").over(Window.partitionBy("t")), "n": F.sum("c").over(Window.partitionBy())})
    return joint.agg(F.lit(feature).alias("feature"), F.max("n").alias("n"), F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("ct")))).alias("mi"), ((F.count_distinct("b") - 1) * (F.count_distinct("t") - 1) / (2 * F.max("n"))).alias("noise"))


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for a > 0: Stirling's series, ten steps further on."""
    z = a.cast("double") + 10
    terms = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
    tail = reduce(lambda x, y: x + y, [F.lit(c) / F.pow(z, F.lit(2.0 * k + 1)) for k, c in enumerate(terms)])
    passed = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda acc, k: acc + F.log(a + k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - passed


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0; null where either is null.

    Below a + 1 one less the power series, above it the continued fraction from its far end, both under a factor
    kept in logarithms; the number of terms follows the root of a, so it holds for any a.
    """
    a, x = a.cast("double"), x.cast("double")
    terms = F.sequence(F.lit(1), F.ceil(60 + 12 * F.sqrt(a)).cast("int"))
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(terms, one, lambda acc, k: F.struct((acc["term"] * x / (a + k)).alias("term"), (acc["sum"] + acc["term"] * x / (a + k)).alias("sum")), lambda acc: acc["sum"])
    fraction = F.aggregate(F.reverse(terms), F.lit(float("inf")), lambda acc, k: x + 2 * k - 1 - a - k * (k - a) / acc)
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    inside = F.when(x < a + 1, F.greatest(F.lit(0.0), 1 - scale * series / a)).otherwise(scale / fraction)
    return F.when(a.isNotNull() & (x <= 0), 1.0).when(a.isNotNull() & x.isNotNull(), F.least(F.lit(1.0), inside))


def chi_square_tail(h: Column, freedom: Column) -> Column:
    """P(chi-square > h), for any degrees of freedom above 0; null where h or the freedom is null."""
    return upper_gamma(freedom / 2, h.cast("double") / 2)


def normal_tail(z: Column, steps: int = 60) -> Column:
    """P(|Z| > z) of a standard normal for z >= 0: a power series of the inner part, far out a continued fraction."""
    z = z.cast("double")
    density = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(2 * steps)), F.struct(z.alias("term"), z.alias("sum")), lambda acc, k: F.struct((acc["term"] * z * z / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * z * z / (2 * k + 1)).alias("sum")), lambda acc: acc["sum"])
    fraction = F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), z, lambda acc, k: z + k / acc)
    return F.when(z < 3, F.greatest(F.lit(0.0), 1 - 2 * density * series)).otherwise(2 * density / fraction)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(n, groups, h, p): Kruskal-Wallis statistic with tie correction, from average ranks, and its chi-square tail."""
    known = df.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("g is not null and v is not null")
    ranked = with_ranks(known, ["v"])
    sums = ranked.groupBy("g").agg(F.sum("v__rank").alias("r"), F.count("*").alias("n"))
    total = sums.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("r") ** 2 / F.col("n")).alias("s"))
    ties = known.groupBy("v").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    n = F.col("n").cast("double")
    out = total.crossJoin(ties).select("n", "groups", F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("t") / (n * n * n - n)).alias("h"))
    return out.withColumn("p", F.when(F.col("groups") > 1, chi_square_tail(F.col("h"), F.col("groups") - 1)))


def group_profile(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, column, median, n, share): median heat table and the share of the group among known values."""
    long = df.filter(F.col(group).isNotNull()).unpivot([group], list(columns), "column", "v").filter("v is not null")
    out = long.groupBy(F.col(group).alias("group"), "column").agg(F.count("*").alias("n"))
    medians = exact_quantiles(long.withColumnRenamed(group, "group"), "v", [0.5], ["group", "column"])
    out = out.join(medians, ["group", "column"]).select("group", "column", F.col("quantiles")[0].alias("median"), "n")
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


def inspection_rate(inspections: DataFrame, snapshot: Column) -> DataFrame:
    """(asset_id, n, span_days, per_year, recency_days)."""
    agg = inspections.groupBy("asset_id").agg(F.count("*").alias("n"), F.datediff(F.max("inspection_date"), F.min("inspection_date")).alias("span_days"), F.datediff(snapshot, F.max("inspection_date")).alias("recency_days"))
    return agg.select("asset_id", "n", "span_days", F.when(F.col("span_days") > 0, (F.col("n") - 1) / (F.col("span_days") / 365.25)).alias("per_year"), "recency_days")


def transitions(inspections: DataFrame) -> DataFrame:
    """(asset_id, date_t0, grade_t0, grade_t1, delta_grade, interval_years): consecutive inspections by date, then id."""
    by = Window.partitionBy("asset_id").orderBy("inspection_date", "inspection_id")
    df = inspections.withColumns({"_g": F.lead("grade").over(by), "_d": F.lead("inspection_date").over(by)}).filter("_g is not null")
    return df.select("asset_id", F.col("inspection_date").alias("date_t0"), F.col("grade").alias("grade_t0"), F.col("_g").alias("grade_t1"), (F.col("_g") - F.col("grade")).alias("delta_grade"), (F.datediff("_d", "inspection_date") / 365.25).alias("interval_years"))


def transition_matrix(moves: DataFrame, by_interval: bool = False) -> DataFrame:
    """([interval,] grade_t0, grade_t1, n, p): counts and shares of each row; intervals rounded to whole years."""
    keys = ["interval"] if by_interval else []
    df = moves.withColumn("interval", F.rint("interval_years").cast("int")) if by_interval else moves
    counts = df.groupBy(*keys, "grade_t0", "grade_t1").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "grade_t0")))


def age_bands(moves: DataFrame, start: DataFrame, low: float = 0.75, high: float = 1.25, least: int = 30) -> DataFrame:
    """(band, n, share_worse, mean_delta, median_age) by right-closed five-year age bands of about yearly moves."""
    df = moves.filter(F.col("interval_years").between(low, high)).join(start.select("asset_id", "asset_start_date"), "asset_id")
    df = df.withColumn("age", F.datediff("date_t0", "asset_start_date") / 365.25).filter("age >= 0")
    band = F.greatest(F.ceil(F.col("age") / 5) - 1, F.lit(0)).cast("int")
    df = df.withColumn("band", band)
    out = df.groupBy("band").agg(F.count("*").alias("n"), F.avg((F.col("delta_grade") > 0).cast("int")).alias("share_worse"), F.avg("delta_grade").alias("mean_delta"))
    out = out.filter(F.col("n") >= least).join(exact_quantiles(df, "age", [0.5], ["band"]), "band")
    return out.select("band", "n", "share_worse", "mean_delta", F.col("quantiles")[0].alias("median_age"))


def hashed_draw(key: str, seed: int) -> Column:
    """A number below 2^32 for each key: the first 32 bits of the MD5 of "seed:key"."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def naive_baselines(df: DataFrame, truth: str, pred: str, key: str, by: Sequence[str] = (), seed: int = 3) -> DataFrame:
    """(by, n, mae_pred, mae_flat3, mae_random): against a flat 3 and a hashed draw from 1 to 6."""
    random = F.pmod(hashed_draw(key, seed), F.lit(6)) + 1
    err = lambda c: F.avg(F.abs(c - F.col(truth)))
    return df.filter(F.col(truth).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), err(F.col(pred)).alias("mae_pred"), err(F.lit(3)).alias("mae_flat3"), err(random).alias("mae_random"))


def area_check(df: DataFrame, computed: str, stated: str, limit: float = 10.0) -> DataFrame:
    """Adds pct_diff and agrees (under `limit` percent)."""
    pct = F.try_divide(100 * F.abs(F.col(computed) - F.col(stated)), F.col(stated))
    return df.withColumns({"pct_diff": pct, "agrees": pct < limit})


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, second: tuple[str, float, float, int] | None = None) -> DataFrame:
    """(bin[, bin_y], n): counts of half-open bins, the last closed; values outside are left out."""
    def place(c: str, lo: float, hi: float, k: int) -> Column:
        return F.when(F.col(c).between(lo, hi), F.least(F.lit(k - 1), F.floor((F.col(c) - lo) / ((hi - lo) / k)))).cast("int")

    cols = {"bin": place(column, low, high, bins)} | ({"bin_y": place(*second)} if second else {})
    placed = df.select(*[c.alias(n) for n, c in cols.items()]).dropna()
    return placed.groupBy(*cols).agg(F.count("*").alias("n"))


def stratified_sample(df: DataFrame, group: str, key: str, cap: int, seed: int = 1) -> DataFrame:
    """Up to `cap` rows of each group, by the order of a seeded hash of the key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(hashed_draw(key, seed), key))).filter(F.col("_r") <= cap).drop("_r")


def disagreement(df: DataFrame, group: str, a: str, b: str, least: int = 50) -> DataFrame:
    """(group, n, rate): share of rows whose two values differ, for groups of enough rows."""
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg((F.col(a) != F.col(b)).cast("int")).alias("rate")).filter(F.col("n") >= least)


def mapping_coverage(df: DataFrame, tier: Column, date: str) -> DataFrame:
    """(tier, n, pct, pct_dated)."""
    out = df.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), (100 * F.avg(F.col(date).isNotNull().cast("int"))).alias("pct_dated"))
    return out.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def date_spikes(df: DataFrame, date: str, k: int = 15) -> DataFrame:
    """The k most frequent years (year, n); ties to the earlier year."""
    return df.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "year").limit(k)


def pca(df: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """(component, explained, cumulative) of standardised columns, nulls filled by the mode."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler

    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    filled = [f"{c}__f" for c in columns]
    stages = [Imputer(strategy="mode", inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), StandardScaler(withMean=True, inputCol="_v", outputCol="_z"), PCA(k=k or len(columns), inputCol="_z", outputCol="_p")]
    explained = [float(x) for x in Pipeline(stages=stages).fit(numbers).stages[-1].explainedVariance]
    rows = [(i + 1, x, sum(explained[: i + 1])) for i, x in enumerate(explained)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def hopkins(df: DataFrame, columns: Sequence[str], key: str, m: int = 200, seed: int = 5) -> DataFrame:
    """(m, hopkins): nearest-neighbour distances of m sampled rows against those of m uniform points of the
    columns' ranges, both to all rows; near a half for uniform data, near one for clustered. The 2m points are
    bounded by the parameter and broadcast; the nearest distances are aggregated over all rows."""
    data = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    ends = data.agg(*[x for c in columns for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))])
    unit = lambda *parts: F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = data.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(m).select(F.col("k").alias("id"), F.lit("w").alias("kind"), *[F.col(c).alias(f"{c}__q") for c in columns])
    made = df.sparkSession.range(m).crossJoin(F.broadcast(ends)).select("id", F.lit("u").alias("kind"), *[(F.col(f"{c}__lo") + unit("id", F.lit(c)) * (F.col(f"{c}__hi") - F.col(f"{c}__lo"))).alias(f"{c}__q") for c in columns])
    points = drawn.unionByName(made)
    square = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"{c}__q")) ** 2 for c in columns])
    near = data.crossJoin(F.broadcast(points)).filter((F.col("kind") == "u") | (F.col("k") != F.col("id"))).groupBy("kind", "id").agg(F.sqrt(F.min(square)).alias("d"))
    u, w = (F.sum(F.when(F.col("kind") == k, F.col("d"))) for k in "uw")
    return near.agg(F.count_if(F.col("kind") == "w").alias("m"), (u / (u + w)).alias("hopkins"))
