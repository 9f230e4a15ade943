"""The rebuild job: histories and journal to reports, victories and sheets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.operators import fights as fight_ops
from cmdlode.operators import projects, reports, retries, sheets, suggest, usage
from cmdlode.params import DEFAULTS, Params
from cmdlode.session import stored
from cmdlode.sources.snapshots import read_sheets, write_snapshot


@dataclass(frozen=True)
class Rebuild:
    """Results of one rebuild, made when asked for; each property is a DataFrame.

    What several results read is written once, when the first of them is asked for:
    classified commands, journal usage and hard-won commands. So each input is scanned
    once (and a file once more before, to number its lines), whatever is asked for.

    Pass empty frames for an input that does not exist. ``roots(scope, root)``
    lists known project roots, if any.
    """

    commands: DataFrame
    journal: DataFrame
    roots: DataFrame | None = None
    params: Params = DEFAULTS

    @cached_property
    def classified(self) -> DataFrame:
        return stored(usage.classify_commands(self.commands, self.params), "classified")

    @cached_property
    def usage(self) -> DataFrame:
        return usage.usage_rows(self.classified, self.params)

    @cached_property
    def counts(self) -> DataFrame:
        return usage.command_counts(self.classified, self.params)

    @cached_property
    def hits(self) -> DataFrame:
        return usage.greatest_hits(self.counts, self.params)

    @cached_property
    def heuristic(self) -> DataFrame:
        return retries.hard_won(retries.retry_chains(self.usage, self.params), self.params)

    @cached_property
    def journal_usage(self) -> DataFrame:
        return stored(fight_ops.journal_usage(self.journal, self.params), "used")

    @cached_property
    def fights(self) -> DataFrame:
        return fight_ops.fights(self.journal_usage, self.params)

    @cached_property
    def shell_totals(self) -> DataFrame:
        return fight_ops.shell_totals(self.journal_usage)

    @cached_property
    def fight_rollup(self) -> DataFrame:
        return fight_ops.fight_rollup(self.fights, self.shell_totals)

    @cached_property
    def hard_won(self) -> DataFrame:
        return stored(reports.certify(self.heuristic, self.fight_rollup, self.params), "hardwon")

    @cached_property
    def reports(self) -> DataFrame:
        return reports.tool_reports(
            usage.usage_with_help(self.counts),
            projects.with_project(self.hard_won, self.roots, params=self.params),
            self.hits,
            fight_ops.journal_totals(self.shell_totals),
        )

    @cached_property
    def victories(self) -> DataFrame:
        return suggest.victories(self.hard_won, self.params)

    @cached_property
    def biggest_fights(self) -> DataFrame:
        return reports.biggest_fights(self.reports, self.params)

    def sheets(
        self, existing: DataFrame, generated_on: str, product: str = sheets.PRODUCT
    ) -> DataFrame:
        shown = reports.with_content(self.reports)
        return sheets.render_sheets(shown, existing, generated_on, product)

    def write(self, victories_path: str, sheets_path: str, generated_on: str) -> None:
        """Store victories and sheets; notes in the stored sheets are kept."""
        spark = self.commands.sparkSession
        write_snapshot(self.victories, victories_path)
        write_snapshot(self.sheets(read_sheets(spark, sheets_path), generated_on), sheets_path)


def project_listing(
    journal: DataFrame, key: Column, roots: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """Certified commands of one project, from the journal alone, in report order.

    The cut per tool comes before the project filter.
    """
    used = fight_ops.journal_usage(journal, params)
    totals = fight_ops.shell_totals(used)
    rollup = fight_ops.fight_rollup(fight_ops.fights(used, params), totals)
    none = rollup.limit(0).select("scope", "tool", "command", "attempts")
    hard_won = reports.certify(none, rollup, params)
    here = projects.project_fights(hard_won, roots, key)
    return here.join(fight_ops.journal_totals(totals), ["scope", "tool"]).orderBy(
        "scope", F.col("total").desc(), "tool", "rank"
    )


def back_test(
    journal: DataFrame, victories: DataFrame, roots: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """Every suggestion the journal's failures would have drawn, before the rate limit."""
    failed = suggest.failures(fight_ops.journal_usage(journal, params), roots, params)
    return suggest.suggest(failed, suggest.victories_by_tool(victories, roots, params))
