"""Raw frames to all staging, silver and gold tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import features
from ..operators.joins import enrich
from ..operators.windows import lag_features, rolling_mean
from ..session import materialize
from . import gold, silver
from .staging import STAGING


@dataclass
class Medallion:
    """All models over one set of raw frames, built on first use.

    `raw` holds the keys of `staging.STAGING` plus `states` (fips_code, state_abbr,
    state_name). The wide silver table and the score table are stored, because bounds,
    rankings, gaps, trends and summary all read them; everything else stays lazy.
    """

    raw: Mapping[str, DataFrame]
    year: str
    prior_year: str
    measures: Mapping[str, str] | None = None
    #: Time written to the scores' `scored_at`, which freshness checks read; left out when not given.
    scored_at: Column | None = None

    def staged(self, name: str) -> DataFrame:
        return STAGING[name](self.raw[name])

    @cached_property
    def profiles(self) -> DataFrame:
        return silver.school_profiles(self.staged("schools"), self.raw["states"], self.year, self.prior_year)

    @cached_property
    def wide(self) -> DataFrame:
        """Schools with every context column, stored once; all later tables read slices of it."""
        s = self.staged
        return materialize(
            silver.all_contexts(
                self.profiles, s("census"), s("health_measures"), s("air_quality"), s("hazards"), s("crime"),
                s("shortage_areas"), s("food_access"), self.measures,
            ),
            "silver",
        )

    @cached_property
    def community(self) -> DataFrame:
        return silver.community_from_wide(self.wide)

    @cached_property
    def scores(self) -> DataFrame:
        return materialize(gold.wellbeing_scores(self.wide, self.scored_at), "scores")

    @cached_property
    def rankings(self) -> DataFrame:
        return gold.school_rankings(self.scores)

    @cached_property
    def gaps(self) -> DataFrame:
        return gold.resource_gaps(self.scores)

    @cached_property
    def trends(self) -> DataFrame:
        return gold.trend_metrics(self.scores, self.wide)

    @cached_property
    def counties(self) -> DataFrame:
        return gold.county_summary(self.scores, self.community, self.gaps)

    @cached_property
    def wide_features(self) -> DataFrame:
        """Scores with all silver contexts and renamed changes: the input of feature building."""
        key = gold.ID
        changes = features.renamed_changes(
            self.trends,
            key,
            {
                "math_proficiency_change": "math_prof_yoy_change",
                "reading_proficiency_change": "reading_prof_yoy_change",
                "absenteeism_change": "absenteeism_yoy_change",
                "enrollment_change": "enrollment_yoy_change",
                "combined_education_change": "education_combined_yoy",
                "education_change_zscore": "education_zscore",
            },
        )
        # fixed values: the columns of the published feature base
        score_cols = [key, "wellbeing_score", *gold.PILLARS.values(), "wellbeing_category"]
        base = self.wide.select(
            key, "school_name", "state_abbr", "county_fips", "county_name", "school_type", "total_enrollment",
            "student_teacher_ratio", "is_title_i", "chronic_absenteeism_pct", "math_proficiency_pct", "reading_proficiency_pct",
            "child_poverty_rate", "uninsured_children_rate", "asthma_pct", "poor_mental_health_pct", "median_aqi",
            "expected_annual_loss", "bad_air_days", "violent_crime_rate", "property_crime_rate", "social_vulnerability_score",
            "pct_tracts_food_desert", "is_hpsa_designated", "has_primary_care_shortage", "hpsa_primary_care_score",
        )
        return enrich(base.join(self.scores.select(*score_cols), key), [(changes, key)])

    def history_features(self, history: DataFrame, period: str, cols: Sequence[str], at: int) -> DataFrame:
        """Lags 1-3 and three-period means of `cols` per school for one period of `history`.

        `history` has one row per school and period (a number, one apart), and holds period `at` of every
        school that is to get features.
        """
        key = gold.ID
        past = rolling_mean(lag_features(history.select(key, period, *cols), key, period, cols), key, period, cols)
        return past.filter(F.col(period) == at).drop(period, *cols)

    def feature_matrix(self, minimum_coverage: float = 0.30, past: DataFrame | None = None) -> DataFrame:
        """Interactions, encodings, imputation by state median and coverage filter; `past` from `history_features` joins in."""
        base = self.wide_features if past is None else self.wide_features.join(past, gold.ID, "left")
        wide = features.bools_to_int(
            features.encode(
                features.interactions(base),
                {"wellbeing_category": features.CATEGORY_CODES, "school_type": features.SCHOOL_TYPE_CODES},
            )
        )
        stored = materialize(wide, "features")
        numeric = features.numeric_features(stored)
        flags = [c for c in stored.columns if c.startswith(("is_", "has_")) and c not in numeric]
        filled = features.impute_grouped_median(stored, "state_abbr", numeric, flags)
        keep = (gold.ID, "school_name", "state_abbr", "county_fips", "county_name")
        return features.drop_low_coverage(materialize(filled, "features"), minimum_coverage, keep)

