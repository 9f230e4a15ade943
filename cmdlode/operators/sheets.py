"""Markdown sheets per tool, with the owner's notes kept across rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.functions.format import cost_note
from cmdlode.functions.text import is_safe_tool

PRODUCT = "cmdlode"
# --- fixed values: the wording of a sheet --------------------------------------
MARKER = "<!-- {product}:keep -->"
NOTES = "## Your notes\n\nAnything below the keep-marker survives rescans. Make it yours.\n"
TITLE = " — personal cheatsheet\n\n"
ORIGIN = ("> Generated by {product} on ", " from your own shell history.\n")
WARNING = "> Rescans rewrite everything above the keep-marker; your notes below it stay.\n\n"
HARD_WON, HITS = "Hard-won (you fought for these)", "Greatest hits"
WON_LINE, HIT_LINE, PLACE = ("- `", "`  — took ", " attempts"), ("- `", "`  — ×"), " · in "
LOOKED_UP = (
    "## Help lookups\n\nYou reached for help on `", "` ", " time(s). The commands above are the ones that stuck.\n\n",
)
# -------------------------------------------------------------------------------
SHEET_SCHEMA = "scope string, tool string, generated_on date, markdown string"


def keep_marker(product: str = PRODUCT) -> str:
    """Everything from this line on belongs to the owner."""
    return MARKER.format(product=product)


def default_notes(product: str = PRODUCT) -> str:
    return f"{keep_marker(product)}\n{NOTES}"


def kept_notes(markdown: Column, product: str = PRODUCT) -> Column:
    """The owner's part of a sheet, or the default for a new or unmarked one."""
    at = F.locate(keep_marker(product), markdown)
    kept = F.substring(markdown, at, F.length(markdown))
    return F.when(at > 0, kept).otherwise(default_notes(product))


def _section(title: str, lines: Column) -> Column:
    body = F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"))
    return F.when(F.size(lines) > 0, body).otherwise("")


def generated_part(generated_on: Column, product: str = PRODUCT) -> Column:
    """Markdown of a report row above the notes; empty sections are left out."""

    def won(h: Column) -> Column:
        place = F.when(h["label"] != "", F.concat(F.lit(PLACE), h["label"])).otherwise("")
        return F.concat(
            F.lit(WON_LINE[0]), h["command"], F.lit(WON_LINE[1]), h["attempts"].cast("string"),
            F.lit(WON_LINE[2]), cost_note(h["certified"], h["cost_ms"]), place,
        )

    def hit(h: Column) -> Column:
        return F.concat(F.lit(HIT_LINE[0]), h["command"], F.lit(HIT_LINE[1]), h["count"].cast("string"))

    looked_up = F.concat(
        F.lit(LOOKED_UP[0]), F.col("tool"), F.lit(LOOKED_UP[1]),
        F.col("help_lookups").cast("string"), F.lit(LOOKED_UP[2]),
    )
    return F.concat(
        F.lit("# "), F.col("tool"), F.lit(TITLE),
        F.lit(ORIGIN[0].format(product=product)), generated_on.cast("string"), F.lit(ORIGIN[1]),
        F.lit(WARNING),
        _section(HARD_WON, F.transform("hard_won", won)),
        _section(HITS, F.transform("hits", hit)),
        F.when(F.col("help_lookups") > 0, looked_up).otherwise(""),
    )


def render_sheets(
    reports: DataFrame, existing: DataFrame, generated_on: str, product: str = PRODUCT
) -> DataFrame:
    """New ``sheets(scope, tool, generated_on, markdown)`` from reports with content.

    Sheets of tools without a new report stay as they are.
    """
    keys = ["scope", "tool"]
    day = F.to_date(F.lit(generated_on))
    fresh = reports.select(*keys, generated_part(day, product).alias("_top"))
    old = existing.select(*keys, F.col("generated_on").alias("_old_day"), F.col("markdown").alias("_old"))
    joined = fresh.join(old, keys, "full_outer")
    renewed = F.col("_top").isNotNull()
    return joined.select(
        *keys,
        F.when(renewed, day).otherwise(F.col("_old_day")).alias("generated_on"),
        F.when(renewed, F.concat("_top", kept_notes(F.col("_old"), product)))
        .otherwise(F.col("_old"))
        .alias("markdown"),
    )


def find_sheet(sheets: DataFrame, tool: str) -> DataFrame:
    """The sheets of one tool; the name is lower-cased, unsafe names find nothing."""
    wanted = F.lit(tool.lower())
    return sheets.where(is_safe_tool(wanted) & (F.col("tool") == wanted))


def list_sheets(sheets: DataFrame) -> DataFrame:
    return sheets.select("scope", "tool", "generated_on").orderBy("scope", "tool")
