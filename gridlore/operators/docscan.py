"""Register tables in the text of vendor documents: rows, the address space that each belongs to, and the surest reading of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.functions.text import collapse_space

#: A row of a register table, headings that open an address space, labels that are prose, labels of
#: controls, and labels of the halves of a float.
TABLE_ROW = r"(?U)^\s*0[xX]([0-9A-Fa-f]{4})(?:\s+(?:\d{1,5}|-))?\s+([A-Za-z][A-Za-z0-9_\[\]./-]{1,})\b"
SECTIONS = {
    "runtime": r"^ram$|^ram registers",
    "configuration": r"^eeprom$|^eeprom ",
    "log": r"^logged data$|^logger$|^logged data ",
    "control": r"^coils?$|^coil address|^discrete input",
    "example": r"^examples?$|^examples ",
}
LONGEST_HEADING = 96
PROSE = ("address", "and", "bit", "description", "instead", "non", "output", "register", "registers", "unit", "units", "value", "values", "which")
CONTROL_LABEL = r"(?i)^EQTRIG$|^CLEAR_|^RESET$|DISCONNECT$|RECONNECT$|OVERRIDE$|TRIGGER$"
FLOAT_HALF = r"(?i)_[01]$|_HI$|_LO$"
LOG_SPACE, CONFIGURATION_SPACE = (0x8000, 0x8FFF), 0xE000
IDENTIFIER_SURE, WORD_SURE = 0.95, 0.85


def heading(line: Column) -> Column:
    """The address space that a line opens, or null."""
    plain = F.regexp_replace(F.lower(line), "^[ :\\-\t]+|[ :\\-\t]+$", "")
    out = F.lit(None).cast("string")
    for space, pattern in reversed(SECTIONS.items()):
        out = F.when(plain.rlike(pattern), space).otherwise(out)
    return F.when(~line.rlike(TABLE_ROW) & F.length(plain).between(1, LONGEST_HEADING), out)


def row_scope(section: Column, address: Column, label: Column, line: Column) -> Column:
    """What a row describes: its label and address say more than the section that it stands in."""
    said = lambda text: F.lower(line).contains(text)
    return (
        F.when(F.lower(label) == "reserved", "reserved")
        .when(address.between(*LOG_SPACE), "log")
        .when(address >= CONFIGURATION_SPACE, "configuration")
        .when(said("float32") & label.rlike(FLOAT_HALF), "alternate_encoding")
        .when((section == "control") | said("set only") | said("write only") | said("write-only") | label.rlike(CONTROL_LABEL), "control")
        .otherwise(section)
    )


def observed_rows(pages: DataFrame) -> DataFrame:
    """(source_id, page, line_no, address, label, scope, confidence, source_text) of every table row of (source_id, page, text).

    A section goes on over the pages of its source until the next heading, and starts as runtime.  Lines are filled
    within a page, and pages take on what the last heading before them opened, so that only one row a page of a source is sorted
    together.  Pages of a source have different numbers; null texts have no lines.
    """
    lines = pages.select("source_id", "page", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line_no", "raw"))
    lines = lines.withColumn("line", collapse_space(F.col("raw"))).where("line <> ''").withColumn("opens", heading(F.col("line")))
    place = ["source_id", "page"]
    closing = lines.where("opens is not null").groupBy(*place).agg(F.max_by("opens", "line_no").alias("closes"))
    before = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.select(*place).distinct().join(closing, place, "left").withColumn("carried", F.last("closes", ignorenulls=True).over(before))
    upto = Window.partitionBy(*place).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.withColumn("inside", F.last("opens", ignorenulls=True).over(upto)).where(F.col("line").rlike(TABLE_ROW))
    label = F.regexp_extract("line", TABLE_ROW, 2)
    rows = inside.withColumn("label", label).where(~F.lower("label").isin(*PROSE)).join(carried.drop("closes"), place)
    section = F.coalesce("inside", "carried", F.lit("runtime"))
    address = F.conv(F.regexp_extract("line", TABLE_ROW, 1), 16, 10).cast("long")
    return rows.withColumn("address", address).select(
        *place,
        "line_no",
        "address",
        "label",
        row_scope(section, F.col("address"), F.col("label"), F.col("line")).alias("scope"),
        F.when(F.col("label").rlike(r"(?U)[_\[\d]"), IDENTIFIER_SURE).otherwise(WORD_SURE).alias("confidence"),
        F.substring("line", 1, 300).alias("source_text"),
    )


def register_observations(pages: DataFrame) -> DataFrame:
    """Each (scope, address, label) of a source once, whatever the label's case: its surest row, the first among equals."""
    first = F.struct(-F.col("confidence"), "page", "line_no")
    rest = F.struct("label", "page", "line_no", "confidence", "source_text")
    return (
        observed_rows(pages)
        .groupBy("source_id", "scope", "address", F.lower("label").alias("label_key"))
        .agg(F.min_by(rest, first).alias("r"))
        .select("source_id", "scope", "address", "r.*")
    )
