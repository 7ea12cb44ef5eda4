"""Year-over-year growth, compound growth and multi-year trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import numeric as N

# Growth metric, source column, label used in the formula text.
GROWTH = (
    ("revenue_growth", "revenue", "Revenue"),
    ("net_income_growth", "net_income", "Net Income"),
    ("eps_growth", "eps", "EPS"),
    ("ebitda_growth", "ebitda", "EBITDA"),
    ("operating_income_growth", "operating_income", "Operating Income"),
)


def yoy(current: Column, previous: Column, label: str, with_inputs: bool = False) -> Column:
    value, status = N.ratio(current - previous, F.abs(previous), 100.0)
    formula = f"({label} Current − {label} Previous) / |{label} Previous| × 100"
    return N.metric_struct(value, status, "%", formula,
                           {"current": current, "previous": previous} if with_inputs else None)


def cagr(start: Column, end: Column, years: Column, with_inputs: bool = False) -> Column:
    """Compound growth; a root of a negative quotient is flagged as an anomaly."""
    missing = start.isNull() | end.isNull() | years.isNull() | (years <= 0)
    raw = (F.pow(end / start, 1 / years) - 1) * 100
    undefined = F.isnan(raw)
    value = F.when(~missing & (start > 0) & ~undefined, raw)
    status = (F.when(missing, N.MISSING).when(start <= 0, N.ZERO_DIVISION)
              .when(undefined, N.ANOMALY).otherwise(N.COMPUTED))
    return N.metric_struct(value, status, "%", "(End Value / Start Value)^(1/Years) − 1",
                           {"start_value": start, "end_value": end, "years": years} if with_inputs else None)


def with_previous(fin: DataFrame, company: str = "company", year: str = "year") -> DataFrame:
    """Adds ``prev_*`` columns from the previous row of the company."""
    w = Window.partitionBy(company).orderBy(year)
    return fin.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for _, c, _ in GROWTH],
                      F.lag(year).over(w).alias("prev_year"))


def compute_growth(fin: DataFrame, keys: list[str]) -> DataFrame:
    """Five growth metrics for each company-year that has a previous row, long form."""
    pairs = with_previous(fin, *keys).where(F.col("prev_year").isNotNull())
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), yoy(F.col(c), F.col(f"prev_{c}"), label).alias("m"))
        for name, c, label in GROWTH])
    return pairs.select(*keys, F.inline(rows)).select(*keys, "metric", "m.*")


def _usable(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def compute_trends(fin: DataFrame, company: str = "company", year: str = "year") -> DataFrame:
    """Series per company in year order, with compound growth over the whole span."""
    point = F.struct(F.col(year).alias("year"), "revenue", "net_income", "eps")
    g = fin.groupBy(company).agg(
        F.array_sort(F.collect_list(point)).alias("series"),
        (F.count(F.lit(1)) - 1).alias("n_years"),
        F.min_by("revenue", year).alias("rev0"), F.max_by("revenue", year).alias("rev1"),
        F.min_by("net_income", year).alias("ni0"), F.max_by("net_income", year).alias("ni1"))
    enough = F.col("n_years") >= 1
    rev = F.when(enough & _usable(F.col("rev0")) & _usable(F.col("rev1")),
                 cagr(F.col("rev0"), F.col("rev1"), F.col("n_years")))
    ni = F.when(enough & (F.col("ni0") > 0) & _usable(F.col("ni1")),
                cagr(F.col("ni0"), F.col("ni1"), F.col("n_years")))
    steps = F.expr("slice(series, 2, greatest(size(series) - 1, 0))")
    grow = F.zip_with(steps, F.col("series"), lambda cur, prev: F.when(
        cur.isNotNull() & prev.isNotNull(),
        F.struct(cur["year"].alias("year"),
                 *[yoy(cur[c], prev[c], label)["value"].alias(name)
                   for name, c, label in GROWTH[:3]])))
    return g.select(
        company, F.when(~enough, "At least 2 years of data required").alias("error"),
        F.when(enough, F.col("series")).alias("series"), "n_years",
        rev.alias("revenue_cagr"), ni.alias("net_income_cagr"),
        F.when(enough, F.filter(grow, lambda x: x.isNotNull())).alias("yoy_growth"))
