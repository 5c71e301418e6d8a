"""The numbers behind every chart, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import class_text, col, number, rows_of
from tabaudit.operators.hypothesis import crosstab
from tabaudit.operators.scale import all_of, exact_quantiles, join_small, materialize, unpivot_numeric


def _class(target: str | None) -> Column:
    return (class_text(col(target)) if target else F.lit("all")).alias("class")


def ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float, int, float]]:
    """Minimum, maximum, count and sample deviation per column: a few numbers each."""
    x = F.col("value")
    found = unpivot_numeric(df, cols).groupBy("column").agg(
        F.min(x).alias("a"), F.max(x).alias("b"), F.count(x).alias("n"), F.stddev_samp(x).alias("s")
    )
    return {r["column"]: (r["a"], r["b"], r["n"], r["s"]) for r in found.collect()}


def _edges(low: float, high: float) -> tuple[float, float]:
    return (low, high) if high > low else (low - 0.5, high + 0.5)


def _bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the maximum falls into the last bin."""
    at = F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(bins)))
    # least/greatest skip NULL, so a missing value must be kept out of bin 0.
    return F.when(x.isNotNull(), F.least(F.lit(bins - 1), F.greatest(F.lit(0), at.cast("int"))))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20, target: str | None = None) -> DataFrame:
    """(column, class, bin, low, high, n, density) with bins shared by all classes.

    Bin numbers are computed per row from inlined ranges; only bin counts are
    shuffled.  Density integrates to one over a whole column.
    """
    found = ranges(df, cols)
    use = [c for c in cols if c in found]
    schema = "column string, class string, bin int, low double, high double, n bigint, density double"
    if not use:
        return df.sparkSession.createDataFrame([], schema)
    placed = df.select(
        _class(target), *[_bin(number(c), *_edges(*found[c][:2]), bins).alias(c) for c in use]
    ).unpivot(["class"], [col(c) for c in use], "column", "bin")
    counted = placed.where("bin is not null").groupBy("column", "class", "bin").agg(F.count(F.lit(1)).alias("n"))

    def per_column(pick) -> Column:
        out = F.lit(None).cast("double")
        for c in use:
            out = F.when(F.col("column") == c, F.lit(float(pick(c)))).otherwise(out)
        return out

    low = per_column(lambda c: _edges(*found[c][:2])[0])
    width = per_column(lambda c: (_edges(*found[c][:2])[1] - _edges(*found[c][:2])[0]) / bins)
    total = per_column(lambda c: found[c][2])
    return counted.select(
        "column", "class", "bin", (low + F.col("bin") * width).alias("low"),
        (low + (F.col("bin") + 1) * width).alias("high"), "n", (F.col("n") / (total * width)).alias("density"),
    )


def density_curve(
    df: DataFrame,
    cols: Sequence[str],
    target: str | None = None,
    points: int = 200,
    bins: int = 1024,
    extend: float = 0.5,
) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on an even grid.

    Rows are reduced to the mean and weight of fine bins first, so the curve
    costs one shuffle of bin counts whatever the row count.  The grid spans
    the column range widened by ``extend`` times the range on each side.
    """
    found = ranges(df, cols)
    use = [c for c in cols if c in found]
    if not use:
        return df.sparkSession.createDataFrame([], "column string, class string, point int, x double, density double")
    long = df.select(
        _class(target),
        *[
            F.when(
                number(c).isNotNull(),
                F.struct(_bin(number(c), *_edges(*found[c][:2]), bins).alias("b"), number(c).alias("v")),
            ).alias(c)
            for c in use
        ],
    ).unpivot(["class"], [col(c) for c in use], "column", "p").where("p is not null")
    binned = materialize(long.groupBy("column", "class", F.col("p.b").alias("b")).agg(
        F.count(F.lit(1)).alias("w"), F.avg("p.v").alias("x"), F.var_pop("p.v").alias("v")
    ), "bins")
    # `bins` entries per group: a bounded list, evaluated in place.
    grouped = binned.groupBy("column", "class").agg(
        F.collect_list(F.struct("w", "x")).alias("bins"),
        F.sum("w").alias("n"),
        F.sum(F.col("w") * F.col("x")).alias("sx"),
    )
    # Within-group variance from the bins (exact: between bins plus inside bins).
    spread = binned.join(
        grouped.select("column", "class", (F.col("sx") / F.col("n")).alias("m")), ["column", "class"]
    ).groupBy("column", "class").agg(
        F.sum(F.col("w") * (F.pow(F.col("x") - F.col("m"), F.lit(2)) + F.col("v"))).alias("ss")
    )
    g = grouped.join(spread, ["column", "class"]).where("n > 1 and ss > 0")
    h = F.sqrt(F.col("ss") / (F.col("n") - 1)) * F.pow(F.col("n").cast("double"), F.lit(-0.2))

    def edge(pick) -> Column:
        out = F.lit(None).cast("double")
        for c in use:
            out = F.when(F.col("column") == c, F.lit(float(pick(*found[c][:2])))).otherwise(out)
        return out

    first = edge(lambda a, b: a - extend * (b - a))
    step = edge(lambda a, b: (b - a) * (1 + 2 * extend) / (points - 1))
    grid = g.select(
        "column", "class", "bins", "n", h.alias("h"), first.alias("first"), step.alias("step"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    ).withColumn("x", F.col("first") + F.col("point") * F.col("step"))
    kernel = F.aggregate(
        "bins",
        F.lit(0.0),
        lambda acc, b: acc + b["w"] * F.exp(F.lit(-0.5) * F.pow((F.col("x") - b["x"]) / F.col("h"), F.lit(2))),
    )
    return grid.select(
        "column", "class", "point", "x", (kernel / (F.col("n") * F.col("h") * F.lit(2.5066282746310002))).alias("density")
    )


def violin_stats(df: DataFrame, cols: Sequence[str], target: str, method: str = "auto") -> DataFrame:
    """Quartiles per class, the inner lines of a violin."""
    source = df.select(_class(target), *[number(c).alias(c) for c in cols])
    q = exact_quantiles(source, cols, [0.25, 0.5, 0.75], by=["class"], method=method)
    return q.select(
        "column", "class", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")
    )


def violin_curves(df: DataFrame, cols: Sequence[str], target: str, points: int = 100) -> DataFrame:
    return density_curve(df, cols, target, points=points, extend=0.1)


def box_stats(df: DataFrame, cols: Sequence[str], target: str, factor: float = 1.5, method: str = "auto") -> DataFrame:
    """Box plot numbers per class: quartiles, whisker ends, outlier count."""
    quart = violin_stats(df, cols, target, method)
    iqr = F.col("q75") - F.col("q25")
    fences = quart.select(
        "column", "class", "q25", "median", "q75",
        (F.col("q25") - F.lit(factor) * iqr).alias("_low"), (F.col("q75") + F.lit(factor) * iqr).alias("_high"),
    )
    long = unpivot_numeric(df.select(_class(target), *[number(c).alias(c) for c in cols]), cols, ["class"])
    inside = F.col("value").between(F.col("_low"), F.col("_high"))
    return (
        join_small(long, fences, ["column", "class"])
        .groupBy("column", "class")
        .agg(
            F.count(F.lit(1)).alias("n"), F.first("q25").alias("q25"), F.first("median").alias("median"),
            F.first("q75").alias("q75"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"),
        )
    )


def count_by_class(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Bar heights: rows per category and class."""
    return crosstab(df, cols, target)


def crosstab_wide(df: DataFrame, column: str, target: str, classes: Sequence[str] | None = None) -> DataFrame:
    """One row per value, one column per class; by default every class of the table has its column."""
    cells = crosstab(df, [column], target)
    if classes is None:
        classes = [r["class"] for r in cells.select("class").distinct().orderBy("class").collect()]
    return (
        cells.groupBy("value").pivot("class", list(classes)).agg(F.sum("n")).na.fill(0)
    )


def pair_bins(df: DataFrame, cols: Sequence[str], target: str, bins: int = 20) -> DataFrame:
    """Pairwise scatter as 2-D bin counts per class, complete rows only.

    Each row adds one entry per column pair, combined before the shuffle.
    """
    full = df.select(_class(target), col(target).alias("_t"), *[number(c).alias(c) for c in cols])
    full = full.where(all_of([col(c).isNotNull() for c in cols] + [F.col("_t").isNotNull()])).drop("_t")
    found = ranges(full, cols)
    use = [c for c in cols if c in found]
    pairs = [
        F.struct(
            F.lit(a).alias("var1"), F.lit(b).alias("var2"),
            _bin(col(a), *_edges(*found[a][:2]), bins).alias("bin1"),
            _bin(col(b), *_edges(*found[b][:2]), bins).alias("bin2"),
        )
        for i, a in enumerate(use) for b in use[i + 1:]
    ]
    if not pairs:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, class string, bin1 int, bin2 int, n bigint")
    return (
        full.select("class", rows_of(pairs))
        .groupBy("var1", "var2", "class", "bin1", "bin2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def feature_network(importances: DataFrame, target: str, edge_scale: float = 15.0, node_scale: float = 8000.0) -> DataFrame:
    """Star graph from the target to each feature as an edge list."""
    return importances.select(
        F.lit(target).alias("src"), F.col("feature").alias("dst"),
        (F.col("importance") * F.lit(edge_scale)).alias("weight"),
        (F.col("importance") * F.lit(node_scale)).alias("node_size"),
    )
