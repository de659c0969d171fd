"""The full build: raw extracts to every published table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from remitra.config import loader
from remitra.config.loader import Config
from remitra.operators import cubes as C
from remitra.operators import dims as D
from remitra.operators import entities as E
from remitra.operators import exceptions as X
from remitra.operators.clean import clean, with_flow_use_ix
from remitra.operators.dedup import dedup_report, dedup_view
from remitra.operators.fact import Dims, build_dims
from remitra.session import side_by_side, stage, stage_all


# Each level needs only the ones before it.
LEVELS = [
    ["tx_all"],
    ["tx", "tiers"],
    ["base", "key_sums", "day", "filed", "checks", "names", "entity_days", "medians", "fx_medians", "totals"],
    ["dims", "day_entity", "keep"],
    ["day_names"],
]


@dataclass
class Build:
    """Shared intermediates, each written once when first needed.

    The cleaned transactions are one columnar table, and the deduplicated ones
    a view of it, so every report reads just its columns. The two base aggregates serve the cubes.
    """

    raw: DataFrame
    config: Config

    @cached_property
    def tx_all(self) -> DataFrame:
        """Before deduplication. Written, as deduplication and three duplicate tiers read it."""
        return stage(clean(self.raw, self.config.rules.usd_band), "tx_all")

    @cached_property
    def tx(self) -> DataFrame:
        """A view of the written ``tx_all``; only what is kept of rows that may have copies is written again."""
        return with_flow_use_ix(dedup_view(self.tx_all))

    @cached_property
    def base(self) -> DataFrame:
        return stage(D.base_month(self.tx), "base_month")

    @cached_property
    def day(self) -> DataFrame:
        return stage(C.base_day(self.tx), "base_day")

    @cached_property
    def key_sums(self) -> DataFrame:
        return stage(D.key_sums(self.tx), "key_sums")

    @cached_property
    def dims(self) -> Dims:
        return build_dims(self.key_sums, self.names, self.filed, self.config)

    @cached_property
    def filed(self) -> DataFrame:
        return stage(C.base_filed(self.tx), "base_filed")

    @cached_property
    def checks(self) -> DataFrame:
        return stage(C.base_checks(self.tx, usd_band=self.config.rules.usd_band), "base_checks")

    @cached_property
    def names(self) -> DataFrame:
        return stage(D.name_counts(self.tx), "name_counts")

    @cached_property
    def entity_days(self) -> DataFrame:
        return stage(C.entity_days(self.tx), "entity_days")

    @cached_property
    def day_entity(self) -> DataFrame:
        return stage(C.day_entity(self.entity_days, self.config.blocklist), "day_entity")

    @cached_property
    def day_names(self) -> DataFrame:
        """Names of the daily entity cube by position. Written, as the cube and the list both read it."""
        return stage(C.big_entities(self.day_entity), "day_names")

    @cached_property
    def medians(self) -> DataFrame:
        return stage(X.currency_medians(self.tx), "medians")

    @cached_property
    def fx_medians(self) -> DataFrame:
        return stage(X.year_medians(self.tx), "fx_medians")

    @cached_property
    def judged(self) -> DataFrame:
        return X.join_medians(self.tx, self.medians, self.fx_medians)

    @cached_property
    def tiers(self) -> dict[str, DataFrame]:
        tx_all = self.tx_all  # before the threads below, each of which would write it for itself
        return stage_all(self.raw.sparkSession, {
            name: lambda t=tier: X.dup_tier(tx_all, **t) for name, tier in self.config.rules.tiers.items()
        })

    @cached_property
    def ent(self) -> DataFrame:
        return E.entities_filtered(self.tx, self.config)

    @cached_property
    def totals(self) -> DataFrame:
        return stage(E.entity_totals(self.ent), "entity_totals")

    @cached_property
    def keep(self) -> DataFrame:
        return stage(E.entity_keep(self.totals), "entity_keep")

    @cached_property
    def kept(self) -> DataFrame:
        return E.keep_entities(self.ent, self.keep)

    @cached_property
    def entity_parts(self) -> E.EntityParts:
        return E.EntityParts(
            keep=self.keep, by_year=stage(E.entity_by_year(self.kept), "entity_by_year"),
            tops=stage(E.entity_tops(self.kept, self.dims), "entity_tops"),
            tx=stage(E.entity_tx(self.kept, self.dims), "entity_tx"),
        )

    def dimension_tables(self) -> dict[str, DataFrame]:
        return {f"dim_{name}": df for name, df in vars(self.dims).items()}

    def static_tables(self) -> dict[str, DataFrame]:
        """Declared lists that readers of the other tables need: labels, lines, bands and patterns."""
        spark, config = self.raw.sparkSession, self.config
        return {
            "dim_groups": loader.pur2_frame(spark),
            "dim_report_lines": loader.report_line_frame(spark, config),
            "dim_goods": loader.goods_frame(spark),
            "dim_size_bands": loader.size_band_frame(spark),
            "dim_quality_fields": loader.quality_field_frame(spark),
            "rate_bands": loader.rate_band_frame(spark, config),
            "rules_in_force": loader.rules_frame(spark, config),
            "limits": loader.limits_frame(spark),
            "own_patterns": loader.list_frame(spark, config.own_patterns, "pattern"),
            "initialisms": loader.list_frame(spark, config.acronyms, "token"),
            "blocked_names": loader.list_frame(spark, config.blocklist, "name"),
        }

    def additive_cubes(self) -> dict[str, DataFrame]:
        """Cubes that are sums of the base aggregates and never look at single transactions."""
        base, day, dims, names = self.base, self.day, self.dims, self.day_names
        return {
            "month": C.cube_month(base, dims),
            "country": C.cube_country(base, dims),
            "currency": C.cube_currency(base, dims),
            "bank": C.cube_bank(base, dims),
            "purpose": C.cube_purpose(base, dims),
            "method": C.cube_method(self.filed, dims),
            "size": C.cube_size(self.filed, dims),
            "ts_bank": C.ts_bank(base, dims),
            "ts_country": C.ts_country(base, dims),
            "ts_currency": C.ts_currency(base, dims),
            "ts_purpose": C.ts_purpose(base, dims),
            "ts_line": C.ts_line(base, dims),
            "day_line": C.day_line(day, dims),
            "day_bank": C.day_bank(day, dims),
            "day_entity": C.index_entities(self.day_entity, names),
            "day_currency": C.day_currency(day, dims),
            "day_goods": C.day_goods(day),
            "cross_country_currency": C.cross_country_currency(base, dims),
            "cross_country_sector": C.cross_country_sector(base, dims),
            "cross_country_line": C.cross_country_line(base, dims),
            "cross_currency_sector": C.cross_currency_sector(base, dims),
            "cross_currency_line": C.cross_currency_line(base, dims),
            "cross_sector_line": C.cross_sector_line(base, dims),
            "quality": C.quality(self.checks, dims),
            "completeness": C.completeness(self.checks, dims),
            "flags": C.flags(self.filed, dims),
            "goods_sides": C.goods_sides(base),
            "fx_by_year_bank": X.fx_by_year_bank(self.checks, dims),
            "day_entity_names": names,
        }

    def cubes(self) -> dict[str, DataFrame]:
        tx, dims = self.tx, self.dims
        return {
            **self.additive_cubes(),
            "lag": C.lag(tx, dims),
            "concentration": C.concentration(tx, dims),
            "meta_totals": C.meta_totals(tx),
            "source_stats": C.source_stats(tx),
            "dedup_report": dedup_report(self.tx_all),
        }

    def exceptions(self) -> dict[str, DataFrame]:
        dims = self.dims
        tables = {
            "ccy_rates": X.ccy_rates(self.medians, dims),
            "fx_counts": X.fx_counts(self.judged),
            "fx_rows": X.fx_rows(self.judged, dims),
            "rate_band_check": X.rate_band_check(self.tx, self.config),
        }
        for tier, groups in self.tiers.items():
            keys = self.config.rules.tiers[tier]["keys"]
            tables[f"dup_{tier}_summary"] = X.dup_summary(groups)
            tables[f"dup_{tier}_by_year_bank"] = X.dup_by_year_bank(groups, dims)
            tables[f"dup_{tier}_rows"] = X.dup_rows(groups, keys, dims)
        return tables

    def entities(self) -> dict[str, DataFrame]:
        return {
            "entities": E.entity_documents(self.entity_parts),
            "entity_coverage": E.entity_coverage(self.totals, self.keep),
            "placeholder_removed": E.placeholder_removed(E.entity_sides(self.tx), self.totals),
            "all_names": E.all_names(self.totals),
        }

    def prepare(self) -> None:
        """Write the shared intermediates, those that do not wait for each other side by side."""
        for level in LEVELS:
            side_by_side(self.raw.sparkSession, {n: lambda n=n: getattr(self, n) for n in level})

    def tables(self) -> dict[str, DataFrame]:
        self.prepare()
        return {
            **self.dimension_tables(), **self.static_tables(), **self.cubes(), **self.exceptions(),
            **self.entities(),
        }
