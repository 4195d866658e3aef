"""Read queries: pages, searches, comparisons, movers and report data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_half_up
from ..functions.predicates import build_filters, matches_any
from ..functions.scoring import score_band
from .joins import enrich, not_yet_done
from .windows import latest_per_key, topk_per_group


def sort_key(name: str, allowed: Sequence[str], descending: bool = False) -> Column:
    """Column chosen by the caller, restricted to a known list."""
    if name not in allowed:
        raise ValueError(f"cannot sort by {name!r}; choose one of {', '.join(allowed)}")
    c = F.col(name)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def page(df: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = 50) -> tuple[DataFrame, DataFrame]:
    """Rows of one page and a one-row frame (total, pages). `order` should end in a unique column.

    Planned as a top-(page·per_page) per task, without a full sort; for deep pages use `page_after`.
    """
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(per_page)))
    return rows, total


def page_after(df: DataFrame, score: str, key: str, last: tuple | None, per_page: int = 50, descending: bool = False) -> DataFrame:
    """Next page after the row (score, key) shown last: cost does not grow with the page number."""
    s, k = F.col(score), F.col(key)
    if last is not None:
        beyond = s < F.lit(last[0]) if descending else s > F.lit(last[0])
        df = df.filter(beyond | ((s == F.lit(last[0])) & (k > F.lit(last[1]))))
    return df.orderBy(s.desc() if descending else s.asc(), k).limit(per_page)


def search(df: DataFrame, needle: str, cols: Sequence[str], **filters) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case."""
    return df.filter(matches_any(needle, cols) & build_filters(**filters))


def entity_list(df: DataFrame, score: str, key: str, page_no: int = 1, per_page: int = 50, descending: bool = False, **filters) -> DataFrame:
    """Filtered page ordered by score with the serving band."""
    kept = df.filter(build_filters(**filters))
    order = [F.col(score).desc() if descending else F.col(score).asc(), F.col(key)]
    rows, _ = page(kept, order, page_no, per_page)
    return rows.withColumn("category", score_band(score))


def entity_detail(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def ranking_list(ranks: DataFrame, scores: DataFrame, key: str, rank: str, cols: Sequence[str], page_no: int = 1, per_page: int = 50, **filters) -> DataFrame:
    joined = scores.filter(build_filters(**filters)).select(key, *cols).join(ranks.select(key, rank), key)
    rows, _ = page(joined, [F.col(rank), F.col(key)], page_no, per_page)
    return rows


def by_magnitude(df: DataFrame, col: str, key: str, k: int, **filters) -> DataFrame:
    """Largest absolute values first."""
    return df.filter(build_filters(**filters)).orderBy(F.abs(F.col(col)).desc(), key).limit(k)


def top_movers(df: DataFrame, col: str, key: str, k: int = 10) -> DataFrame:
    """The k largest rises and the k largest falls, marked up / down."""
    up = df.filter(F.col(col) > 0).orderBy(F.col(col).desc(), key).limit(k).withColumn("direction", F.lit("up"))
    down = df.filter(F.col(col) < 0).orderBy(F.col(col).asc(), key).limit(k).withColumn("direction", F.lit("down"))
    return up.unionByName(down)


def best_and_worst(df: DataFrame, col: str, key: str, k: int = 10) -> DataFrame:
    top = df.orderBy(F.col(col).desc_nulls_last(), key).limit(k).withColumn("side", F.lit("top"))
    bottom = df.orderBy(F.col(col).asc_nulls_last(), key).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def top_groups(df: DataFrame, group: str, col: str, k: int = 8) -> DataFrame:
    """All rows of the k groups with the highest mean."""
    best = df.groupBy(group).agg(F.avg(col).alias("_m")).orderBy(F.col("_m").desc_nulls_last(), group).limit(k)
    return df.join(best, group, "left_semi")


def compare(df: DataFrame, key: str, values: Sequence, limit: int | None = None) -> DataFrame:
    """Rows of the given keys; a caller's `limit` on their number is checked, none is set here."""
    if limit is not None and len(values) > limit:
        raise ValueError(f"at most {limit} entries can be compared")
    return df.filter(F.col(key).isin(*values))


def platform_stats(df: DataFrame, score: str, area: str, digits: int = 1) -> DataFrame:
    """One row: entities, areas, mean, extremes and the number in each serving band."""
    s = F.col(score)
    return df.agg(
        F.count(F.lit(1)).alias("total_schools"),
        F.count_distinct(area).alias("total_counties"),
        round_half_up(F.avg(s), digits).alias("avg_score"),
        round_half_up(F.min(s), digits).alias("min_score"),
        round_half_up(F.max(s), digits).alias("max_score"),
        F.count_if(s <= 25).alias("critical_count"),
        F.count_if((s > 25) & (s <= 50)).alias("at_risk_count"),
        F.count_if((s > 50) & (s <= 75)).alias("moderate_count"),
        F.count_if(s > 75).alias("thriving_count"),
    )


def pillar_means(df: DataFrame, pillars: Mapping[str, str], digits: int = 1) -> DataFrame:
    return df.agg(*[round_half_up(F.avg(c), digits).alias(name) for name, c in pillars.items()])


def area_markers(df: DataFrame, area: str, lat: str, lon: str, score: str, lo: float, hi: float) -> DataFrame:
    """Centroid, mean score and count per area for entities whose score lies in [lo, hi]."""
    return df.filter(F.col(score).between(lo, hi)).groupBy(area).agg(
        round_half_up(F.avg(lat), 4).alias("centroid_lat"),
        round_half_up(F.avg(lon), 4).alias("centroid_lon"),
        round_half_up(F.avg(score), 2).alias("avg_score"),
        F.count(F.lit(1)).alias("row_count"),
    )


def county_detail(summary: DataFrame, briefs: DataFrame, area: str = "county_fips", generated: str = "generated_at") -> DataFrame:
    """Area rows with their most recent brief, if any."""
    latest = latest_per_key(briefs, area, [generated]).select(area, "brief_text")
    return enrich(summary, [(latest, area)])


def worst_per_area(scores: DataFrame, area: str, score: str, key: str, k: int = 50) -> DataFrame:
    """The k lowest scored entities of every area in one job."""
    return topk_per_group(scores, area, [F.col(score).asc_nulls_last(), F.col(key)], k, "place")


def report_dataset(
    summary: DataFrame,
    scores: DataFrame,
    gaps: DataFrame,
    briefs: DataFrame,
    area: str = "county_fips",
    score: str = "wellbeing_score",
    key: str = "nces_school_id",
    schools: int = 50,
    gap_rows: int = 20,
) -> DataFrame:
    """One nested row per area: summary, lowest schools, largest gaps, latest brief.

    The lists are cut to their size before the shuffle, so a huge area costs no more
    than a small one.
    """
    low = worst_per_area(scores, area, score, key, schools)
    wide = topk_per_group(
        gaps, area, [F.col("gap_count").desc(), F.col("pillar_spread").desc(), F.col(key)], gap_rows, "place"
    )

    def nested(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
        return df.groupBy(area).agg(F.array_sort(F.collect_list(F.struct("place", *cols))).alias(name))

    return enrich(
        summary,
        [
            (nested(low, [key, score], "schools"), area),
            (nested(wide, [key, "gap_count", "weakest_pillar"], "gaps"), area),
            (latest_per_key(briefs, area, ["generated_at"]).select(area, "brief_text"), area),
        ],
    )


def brief_queue(summary: DataFrame, briefs: DataFrame, area: str, month_start: Column, generated: str = "generated_at") -> DataFrame:
    """Areas without a brief since the start of the month."""
    return not_yet_done(summary, briefs.filter(F.col(generated) >= month_start), area)
