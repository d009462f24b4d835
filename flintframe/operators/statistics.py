"""Assemblage statistics: distributions, cumulative curves, fits and per-lithic summaries of the metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import kept
from .assemblage import cortex_rows, dorsal_scars, is_dorsal_scar, parent_rows

#: Surfaces in their order on the page; others follow by name.
SURFACE_ORDER = ("Dorsal", "Ventral", "Platform", "Lateral")


def surface_rank(surface: Column) -> Column:
    out = F.lit(len(SURFACE_ORDER))
    for k, s in enumerate(SURFACE_ORDER):
        out = F.when(surface == s, k).otherwise(out)
    return out


def top_filter(df: DataFrame) -> DataFrame:
    """Dorsal parents if there are any, else all parents."""
    parents = parent_rows(df)
    any_dorsal = parents.agg(F.coalesce(F.max(F.col("surface_type") == "Dorsal"), F.lit(False)).alias("__any"))  # one row
    return parents.crossJoin(F.broadcast(any_dorsal)).where(~F.col("__any") | (F.col("surface_type") == "Dorsal")).drop("__any")


def aspect_by_surface(df: DataFrame) -> DataFrame:
    """Quartiles, extremes and point style of parents' aspect ratios by surface, in page order (position)."""
    own = parent_rows(df).where(F.col("aspect_ratio").isNotNull() & F.col("surface_type").isNotNull())
    ends = own.groupBy("surface_type").agg(F.min("aspect_ratio").alias("least"), F.max("aspect_ratio").alias("most"))
    parts = quantiles(own, "aspect_ratio", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["surface_type"])
    out = ends.join(parts, "surface_type").select("surface_type", "n", "least", "q1", "median", "q3", "most")
    style = F.when(F.col("n") <= 20, "large").when(F.col("n") <= 100, "medium").otherwise("small")
    return out.withColumn("point_style", style).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(surface_rank(F.col("surface_type")), "surface_type")))


def perimeters(df: DataFrame) -> DataFrame:
    """Parents with a perimeter, labelled ``id (surface)``."""
    return parent_rows(df).where(F.col("perimeter").isNotNull()).select("image_id", "perimeter", F.concat("image_id", F.lit(" ("), "surface_type", F.lit(")")).alias("label"))


def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Parents with both values."""
    return parent_rows(df).dropna(subset=[x, y]).select("image_id", "surface_type", x, y)


def asymmetry(df: DataFrame) -> DataFrame:
    """Signed biases of dorsal parents whose opposite areas have a positive sum."""
    tb, lr = F.col("top_area") + F.col("bottom_area"), F.col("left_area") + F.col("right_area")
    own = parent_rows(df).where((F.col("surface_type") == "Dorsal") & (tb > 0) & (lr > 0))
    return own.select("image_id", ((F.col("top_area") - F.col("bottom_area")) / tb).alias("vertical_bias"), ((F.col("right_area") - F.col("left_area")) / lr).alias("horizontal_bias"))


def asymmetry_axis(df: DataFrame) -> DataFrame:
    """One row: half width of the axes, 1.2 of the greatest bias and 0.1 at least."""
    most = F.max(F.greatest(F.abs("vertical_bias"), F.abs("horizontal_bias")))
    return asymmetry(df).agg(F.greatest(F.lit(0.1), 1.2 * most).alias("axis"))


def _ranked(rows: DataFrame, value: str, by: list[str], buckets: int = 256) -> DataFrame:
    """by, value, __n (rows with it), __from (rows before it) and __all, a row a distinct value.

    Values are counted first; the running count over distinct values is split at approximate quantiles, so tasks get
    like shares whatever the spread, and only the buckets' totals are accumulated together. Approximate quantiles differ
    from one computation to the next, so those that split are kept: totals and places go by the same ones.
    """
    own = rows.where(F.col(value).isNotNull())
    counted = own.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    marks = kept(counted.groupBy(*by).agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 4 * buckets).alias("__marks"), F.sum("__n").alias("__all")))
    joined = counted.join(F.broadcast(marks), by) if by else counted.crossJoin(F.broadcast(marks))  # a row a curve
    joined = joined.withColumn("__b", F.size(F.filter("__marks", lambda m: m < F.col(value)))).drop("__marks")
    totals = joined.groupBy(*by, "__b").agg(F.sum("__n").alias("__t"))
    before = totals.select(*by, "__b", (F.sum("__t").over(Window.partitionBy(*by).orderBy("__b")) - F.col("__t")).alias("__before"))
    placed = joined.join(F.broadcast(before), [*by, "__b"])  # buckets of each curve at most
    inner = F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy(value)) - F.col("__n")
    return placed.select(*by, value, "__n", (F.col("__before") + inner).alias("__from"), "__all")


def ecdf(rows: DataFrame, value: str, by: list[str] | None = None, block: int = 10_000) -> DataFrame:
    """Cumulative curve: each row its own step of rank / count, ties too. Columns: by, value, rank, share.

    Ties are unfolded in blocks, so no array is longer than one.
    """
    by = by or []
    pieces = _ranked(rows, value, by).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / block))).alias("__k"))
    first = F.col("__from") + F.col("__k") * block + 1
    last = F.least(first + block - 1, F.col("__from") + F.col("__n"))
    out = pieces.select(*by, value, "__all", F.explode(F.sequence(first, last)).alias("rank"))
    return out.select(*by, value, "rank", (F.col("rank") / F.col("__all")).alias("share"))


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """By group, a column for each share: the quantile of the values, linear between neighbours; n counts the values."""
    by = by or []
    at = {name: (F.col("__all") - 1) * p for name, p in shares.items()}
    holds = lambda r: (F.col("__from") <= r) & (r < F.col("__from") + F.col("__n"))
    ends = [F.max(F.when(holds(f(pos)), F.col(value))).alias(f"__{side}_{name}") for name, pos in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = _ranked(rows, value, by).groupBy(*by).agg(F.coalesce(F.max("__all"), F.lit(0)).alias("__all"), *ends)
    part = lambda name: at[name] - F.floor(at[name])
    between = [(F.col(f"__lo_{name}") + part(name) * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))).alias(name) for name in shares]
    return found.select(*by, *between, F.col("__all").alias("n"))


def symmetry_ecdf(df: DataFrame) -> DataFrame:
    """Curves of the vertical and horizontal symmetry of dorsal parents."""
    own = parent_rows(df).where(F.col("surface_type") == "Dorsal")
    long = own.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("vertical_symmetry", "horizontal_symmetry")])).alias("s")).select("s.*")
    return ecdf(long, "value", ["measure"])


def symmetry_summary(df: DataFrame) -> DataFrame:
    """One row: medians of both symmetries and the floor of the axis."""
    own = parent_rows(df).where(F.col("surface_type") == "Dorsal")
    floor = own.agg(F.least(F.min("vertical_symmetry"), F.min("horizontal_symmetry")).alias("x_floor"))
    middle = lambda c, name: F.broadcast(quantiles(own, c, {name: 0.5}).select(name))  # noqa: E731  one row
    return middle("vertical_symmetry", "vertical_median").crossJoin(middle("horizontal_symmetry", "horizontal_median")).crossJoin(floor)


def scar_summary(df: DataFrame) -> DataFrame:
    """A row a dorsal parent with area and scar count: scar area sum, mean and deviation, coverage and variation."""
    own = df.where((F.col("surface_type") == "Dorsal") & (F.col("surface_feature") == "Dorsal") & F.col("total_area").isNotNull() & F.col("scar_count").isNotNull())
    scars = dorsal_scars(df).groupBy("image_id").agg(F.sum("total_area").alias("total_scar_area"), F.avg("total_area").alias("mean_scar_area"), F.stddev_samp("total_area").alias("sd_scar_area"))
    out = own.select("image_id", F.col("total_area").alias("dorsal_area"), F.col("scar_count").alias("num_scars"), "calibration_method").join(scars, "image_id", "left")
    ratio = F.col("total_scar_area") / F.nullif("dorsal_area", F.lit(0.0))
    coverage = F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * 100)
    return out.select("*", coverage.alias("coverage_pct"), (F.col("sd_scar_area") / F.nullif("mean_scar_area", F.lit(0.0))).alias("cv"))


def fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, n, extremes of x, and the population deviation of residuals; null under two points."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    enough = F.count(F.lit(1)) >= 2
    sd = F.sqrt(F.greatest(F.lit(0.0), F.var_pop(cy) - F.pow(F.covar_pop(cx, cy), F.lit(2)) / F.nullif(F.var_pop(cx), F.lit(0.0))))
    return own.agg(F.when(enough, F.regr_slope(cy, cx)).alias("slope"), F.when(enough, F.regr_intercept(cy, cx)).alias("intercept"), F.count(F.lit(1)).alias("n"), F.min(cx).alias("x_least"), F.max(cx).alias("x_most"), sd.alias("sd"))


def fit_line(rows: DataFrame, x: str, y: str, points: int = 50) -> DataFrame:
    """Evenly spaced points of the fitted line; none under two points."""
    f = fit(rows, x, y).where("slope is not null")
    at = F.col("x_least") + (F.col("x_most") - F.col("x_least")) * F.col("k") / (points - 1)
    return f.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("k", at.alias("x"), (F.col("slope") * at + F.col("intercept")).alias("y"))


def outliers(rows: DataFrame, x: str, y: str, n_sd: float = 2.0) -> DataFrame:
    """rows with both values, with residual and is_outlier: further than n_sd deviations, if there are three points."""
    f = fit(rows, x, y).select("slope", "intercept", "n", "sd")
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(f))  # one row
    own = own.withColumn("residual", F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")))
    far = (F.col("n") >= 3) & (F.col("sd") > 0) & (F.abs("residual") > n_sd * F.col("sd"))
    return own.withColumn("is_outlier", F.coalesce(far, F.lit(False))).drop("slope", "intercept", "n", "sd")


def integer_histogram(rows: DataFrame, value: str) -> DataFrame:
    """Counts in bins of width one around whole numbers, from the least value on."""
    least = rows.agg(F.min(value).alias("__m"))  # one row
    own = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(least))
    return own.groupBy((F.col("__m") + F.floor(F.col(value) - (F.col("__m") - 0.5))).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def complexity(df: DataFrame) -> DataFrame:
    return df.where(is_dorsal_scar() & F.col("scar_complexity").isNotNull()).select("image_id", "scar_complexity")


def complexity_grid(df: DataFrame) -> DataFrame:
    """Counts of (lithic, complexity) for lithics with two scored scars or more, with the median and the marker size."""
    own = complexity(df)
    kept = own.groupBy("image_id").agg(F.count(F.lit(1)).alias("scars"), F.percentile("scar_complexity", F.lit(0.5)).alias("median")).where("scars >= 2")
    cells = own.groupBy("image_id", "scar_complexity").agg(F.count(F.lit(1)).alias("n")).join(kept.select("image_id", "median"), "image_id")
    most = cells.agg(F.max("n").alias("__most"))  # one row
    size = F.when(F.col("__most") > 1, 6 + (F.col("n") - 1) * 22 / (F.col("__most") - 1)).otherwise(6.0)
    return cells.crossJoin(F.broadcast(most)).select("image_id", "scar_complexity", "n", "median", size.alias("size"))


def scar_values(df: DataFrame, value: str) -> DataFrame:
    """Positive values of dorsal scars."""
    return dorsal_scars(df).where(F.col(value) > 0).select("image_id", value)


def cv_vs_count(df: DataFrame) -> DataFrame:
    return scar_summary(df).where((F.col("num_scars") >= 2) & F.col("cv").isNotNull()).select("image_id", "num_scars", "cv")


def hull_ratios(df: DataFrame) -> DataFrame:
    """Dorsal area over hull area of dorsal parents."""
    own = parent_rows(df).where((F.col("surface_type") == "Dorsal") & (F.col("convex_hull_area") > 0) & F.col("total_area").isNotNull())
    return own.select("image_id", "total_area", "convex_hull_area", (F.col("convex_hull_area") / F.col("total_area")).alias("ratio"), "calibration_method")


def coverage(summary: DataFrame) -> DataFrame:
    """One row: lithics with a coverage, its median, and the largest dorsal area among them."""
    own = summary.where("coverage_pct is not null")
    return quantiles(own, "coverage_pct", {"median_coverage": 0.5}).crossJoin(F.broadcast(own.agg(F.max("dorsal_area").alias("largest")))).select("n", "median_coverage", "largest")


def cortex_summary(df: DataFrame) -> DataFrame:
    """One row: cortex regions, lithics with cortex, and their share in percent."""
    own = cortex_rows(df).agg(F.count(F.lit(1)).alias("n_regions"), F.countDistinct("image_id").alias("n_with_cortex"))
    every = df.agg(F.countDistinct("image_id").alias("n_lithics"))
    return own.crossJoin(F.broadcast(every)).select("*", F.coalesce(F.col("n_with_cortex") * 100 / F.nullif("n_lithics", F.lit(0)), F.lit(0.0)).alias("prevalence_pct"))


def cortex_percentages(df: DataFrame) -> DataFrame:
    """Cortex regions with cortex_percentage: as in the table, or else their area of the area of their image's surface."""
    own = cortex_rows(df)
    if "cortex_percentage" in df.columns:
        return own
    whole = parent_rows(df).groupBy("image_id", "surface_type").agg(F.max("total_area").alias("__whole"))
    return own.join(whole, ["image_id", "surface_type"]).withColumn("cortex_percentage", F.round(F.col("total_area") / F.nullif("__whole", F.lit(0.0)) * 100, 2)).drop("__whole")


def histogram(rows: DataFrame, value: str, bins: int = 15) -> DataFrame:
    """Counts in equal bins between the extremes; the last bin holds the greatest value."""
    ends = rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))  # one row
    own = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo"))))).otherwise(0)
    return own.groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def number_text(value: Column) -> Column:
    """A number with thousands separators: whole, or with two digits."""
    exact = value.cast("decimal(28,6)").cast("decimal(24,2)")
    return F.when(value == F.floor(value), F.format_number(value.cast("bigint"), 0)).otherwise(F.format_number(exact, 2))


def caption(rows: DataFrame, value: str) -> DataFrame:
    """One row: median, quartiles (linear) and n, and the text of a caption (empty without values)."""
    out = quantiles(rows, value, {"median": 0.5, "q1": 0.25, "q3": 0.75})
    parts = [F.lit("Median: "), number_text(F.col("median")), F.lit(" · IQR: "), number_text(F.col("q1")), F.lit("–"), number_text(F.col("q3")), F.lit(" · N: "), F.col("n").cast("string")]
    return out.withColumn("text", F.when(F.col("n") > 0, F.concat(*parts)).otherwise(""))
