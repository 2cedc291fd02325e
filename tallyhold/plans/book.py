"""The holdings book: filings and holdings rows to every snapshot table.

The holdings rows are read twice and joined once.  The first pass adds up each filing (two columns,
combined map-side).  Everything about filings and managers, including reconciled coverage, portfolio
totals, and comparability, follows from those sums at filing scale.  The second pass tags each holdings
row with that context while it is joined to its filing, so no rollup has to join the facts again; it also finds
the row that names each security, and only these rows are looked up.

A book may be given the sums of all filings (``observed``) and the quarters whose holdings it is to build (``only``); everything at
filing scale covers all quarters nevertheless.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhold.operators import filings, positions, rollups
from tallyhold.operators.positions import CONTEXT
from tallyhold.session import configure, stage


@dataclass
class Book:
    """Lazy snapshot tables over one set of inputs; shared intermediates are staged once per book."""

    submissions: DataFrame
    covers: DataFrame
    summaries: DataFrame
    lines: DataFrame
    archives: DataFrame
    tickers: DataFrame | None = None
    watchlist: DataFrame | None = None
    staged: bool = True
    observed: DataFrame | None = None
    only: tuple[dt.date, ...] | None = None

    def _shared(self, df: DataFrame, name: str, **options) -> DataFrame:
        if not self.staged:
            return df
        configure(df.sparkSession)
        return stage(df, name, **options)

    # ---- filing scale -------------------------------------------------------------------------
    @cached_property
    def periods(self) -> DataFrame:
        primary = filings.primary_periods(self.submissions)
        return self._shared(filings.period_table(primary), "periods")

    @cached_property
    def events(self) -> DataFrame:
        return self._shared(
            filings.filing_events(self.submissions, self.covers, self.summaries, self.periods), "events")

    @cached_property
    def groups(self) -> DataFrame:
        return self._shared(filings.group_states(self.events), "groups")

    @cached_property
    def part_stats(self) -> DataFrame:
        parts = filings.effective_parts(self.events, self.groups)
        observed = filings.observed_totals(self.lines) if self.observed is None else self.observed
        return self._shared(filings.reconcile_parts(parts, observed), "part_stats")

    @cached_property
    def quarters(self) -> DataFrame:
        return self._shared(filings.manager_periods(self.groups, self.part_stats), "quarters")

    @cached_property
    def context(self) -> DataFrame:
        totals = self.quarters.select("cik", "period", F.col("reconciled_value").alias("total_value"))
        return self._shared(filings.manager_context(self.quarters, self.periods, totals), "context")

    @property
    def managers(self) -> DataFrame:
        return filings.manager_dimension(self.quarters, self.watchlist)

    # ---- fact scale ---------------------------------------------------------------------------
    @property
    def tagged_lines(self) -> DataFrame:
        """Holdings rows in force, with manager, period, manager-quarter context, and their place among the rows that name a security.

        A holdings row belongs to the archive it was read from, or else to that of its filing; both lists have one row per archive.
        """
        parts = self.part_stats.select("accession", "cik", "period", "source_archive")
        if self.only is not None:
            parts = parts.filter(F.col("period").isin(list(self.only)))
        ranks, lines = F.broadcast(self.archive_ranks), self.lines
        if "archive" in lines.columns:
            lines = lines.join(ranks, "archive").drop("archive")
        else:
            parts = parts.join(ranks.withColumnRenamed("archive", "source_archive"), "source_archive")
        context = parts.drop("source_archive").join(self.context, ["cik", "period"])
        return positions.with_name_row(positions.effective_lines(lines, context))

    @cached_property
    def archive_ranks(self) -> DataFrame:
        return self._shared(positions.ranked_archives(self.archives), "archive_ranks")

    @cached_property
    def wide_positions(self) -> DataFrame:
        """Merged positions with manager-quarter context."""
        return self._shared(positions.merge_positions(self.tagged_lines, CONTEXT), "positions")

    @property
    def positions(self) -> DataFrame:
        return self.wide_positions.select(*positions.POSITION_KEY, "value", "shares")

    def first_names(self, *keys: str) -> DataFrame:
        """The row that names each security within each of ``keys``."""
        best = self.wide_positions.groupBy(*keys, "cusip").agg(F.max("name_row").alias("name_row"))
        return positions.first_names(best, self.lines, self.archive_ranks)

    @cached_property
    def securities(self) -> DataFrame:
        return self._shared(
            positions.security_dimension(self.first_names(), self.archives, self.tickers), "securities")

    # ---- rollups ------------------------------------------------------------------------------
    @cached_property
    def manager_period_stats(self) -> DataFrame:
        return self._shared(rollups.manager_period_stats(self.quarters, self.wide_positions), "manager_stats")

    @cached_property
    def security_period_stats(self) -> DataFrame:
        return self._shared(rollups.security_period_stats(self.wide_positions), "security_stats")

    @property
    def period_stats(self) -> DataFrame:
        return rollups.period_stats(
            self.periods, self.quarters, self.manager_period_stats, self.security_period_stats)

    @property
    def stock_changes(self) -> DataFrame:
        return rollups.stock_changes(self.wide_positions)

    @property
    def period_change_totals(self) -> DataFrame:
        return rollups.period_change_totals(self.periods, self.context)

    @cached_property
    def dashboard_period_stats(self) -> DataFrame:
        return self._shared(rollups.dashboard_period_stats(self.periods, self.context), "dashboard")

    @cached_property
    def weights(self) -> DataFrame:
        return self._shared(
            rollups.security_weight_stats(self.wide_positions, self.dashboard_period_stats), "weights",
            partition_by=("period",))


def warehouse_book(warehouse, *, staged: bool = True) -> Book:
    """Book over the orders/lineitem adapter."""
    return Book(warehouse.submissions, warehouse.covers, warehouse.summaries, warehouse.lines, warehouse.archives,
                warehouse.tickers, warehouse.watchlist, staged=staged)
