"""Per-frame energy reports: text files of stacked tables, one per molecule part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The terms in the order of the report, and the roll-ups printed after them.
GAS_TERMS = ["BOND", "ANGLE", "DIHED", "VDWAALS", "EEL", "1-4 VDW", "1-4 EEL"]
SOLVENT_TERMS = ["EGB", "ESURF"]
ROLLUPS = ["GGAS", "GSOLV", "TOTAL"]
TERMS = GAS_TERMS + SOLVENT_TERMS + ROLLUPS
COLUMN_NAMES = {"1-4 VDW": "VDW_14", "1-4 EEL": "EEL_14"}
TERM_COLUMNS = [COLUMN_NAMES.get(t, t) for t in TERMS]
# <anything>_<sequence>/<run>/<file>
LAYOUT = r"([ACGT]+)/(\d+)/[^/]+$"


def entity_and_run(path: Column, layout: str = LAYOUT) -> dict[str, Column]:
    """Entity and replicate from the directories of a report."""
    return {"sequence": F.nullif(F.regexp_extract(path, layout, 1), F.lit("")),
            "run": F.nullif(F.regexp_extract(path, layout, 2), F.lit("")).cast("int")}


#: The header as the reports print it.
HEADER = "Frame #," + ",".join(TERMS)


def _spots(line: Column, head: Column) -> Column:
    """Where the frame and each term stand in the cells of a row (NULL if missing), from the header line and its trimmed cells.

    The printed header needs no search.
    """
    wanted = F.array(*[F.lit(name) for name in ["Frame #", *TERMS]])
    found = F.transform(wanted, lambda name: F.nullif(F.array_position(head, name), F.lit(0)).cast("int") - 1)
    return F.when(line == HEADER, F.sequence(F.lit(0), F.lit(len(TERMS)))).otherwise(found)


def _head(line: Column) -> Column:
    """Trimmed cells of a header line that differs from the printed one."""
    return F.when(line != HEADER, F.transform(F.split(line, ","), lambda c: F.trim(c)))


def parse_energy_reports(reports: DataFrame, text: str = "value") -> DataFrame:
    """Reports (one per row) to one row per section and frame; the other columns are kept.

    A section is a title ``<part> Energy Terms``, a header and comma rows up to a blank line.
    Columns are taken by header name, so their order may differ between reports.
    """
    keep = [c for c in reports.columns if c != text]
    plain = F.replace(F.col(text), F.lit("\r"), F.lit(""))
    sections = reports.select(*keep, F.explode(F.split(plain, r"\n[ \t]*\n")).alias("_part"))
    titled = sections.select(*keep, "_part", F.regexp_extract("_part", r"(?m)^\s*(\w+) Energy Terms\s*$", 1).alias("section"))
    # other parts have no lines; a filter would be pushed down and look for every title twice
    lines = F.when(F.col("section") != "", F.filter(F.split("_part", "\n"), lambda line: F.contains(line, F.lit(","))))
    tables = titled.select(*keep, "section", lines.alias("_lines"))
    first = F.get("_lines", F.lit(0))
    # where each column stands is looked up once per section
    placed = tables.withColumn("_head", _head(first)).select(*keep, "section", "_lines", _spots(first, F.col("_head")).alias("_at"))
    placed = placed.select(*keep, "section", "_at", F.explode(F.slice("_lines", 2, 2147483647)).alias("_row"))
    cells = placed.select(*keep, "section", "_at", F.split("_row", ",").alias("_cells"))
    # all cells of a row are cast at once
    numbers = cells.select(*keep, "section", "_at", "_cells", F.col("_cells").try_cast("array<double>").alias("_numbers"))
    return numbers.select(*keep, "section", F.get("_cells", F.get("_at", F.lit(0))).try_cast("int").alias("frame"),
                          *[F.get("_numbers", F.get("_at", F.lit(i))).alias(c) for i, c in enumerate(TERM_COLUMNS, 1)])


#: Sections end with a blank line, so a report is read as records between blank lines.
BLANK_LINE = "\n\n"


def read_energy_reports(spark: SparkSession, path: str, layout: str = LAYOUT) -> DataFrame:
    """Section rows of the report files below a path, with entity and replicate from their directories.

    A large report is split between tasks: its records are the sections, which no row holds together. A file with other line ends
    has no such blank lines and is one record; its rows are the same.
    """
    raw = spark.read.option("lineSep", BLANK_LINE).text(path)
    keyed = raw.select("value", F.col("_metadata.file_path").alias("_path")).where(F.contains("value", F.lit("Energy Terms")))
    return parse_energy_reports(keyed.withColumns(entity_and_run(F.col("_path"), layout)).drop("_path"))


def report_deltas(reports: DataFrame, text: str = "value") -> DataFrame:
    """Complex - Receptor - Ligand per frame of whole reports, one per row: the other columns, ``frame`` and the terms.

    The lines of the three sections are zipped by frame inside the row, so nothing is shuffled. Frames that one of them lacks are left out; a frame listed twice in a section
    counts with its first line. Sections that lie in different rows need ``energy_delta``.
    """
    keep = [c for c in reports.columns if c != text]
    parts = ("Complex", "Receptor", "Ligand")

    def per_part(df: DataFrame, name: str, value) -> DataFrame:
        return df.withColumns({f"_{name}{i}": value(i) for i in range(3)})

    # step by step, so that no expression is worked out once for each use
    rows = reports.select(*keep, F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), r"\n[ \t]*\n").alias("_parts"))
    rows = per_part(rows, "text", lambda i: F.get(F.filter(
        "_parts", lambda part: F.regexp_like(part, F.lit(rf"(?m)^\s*{parts[i]} Energy Terms\s*$"))), F.lit(0))).drop("_parts")
    rows = per_part(rows, "all", lambda i: F.filter(F.split(f"_text{i}", "\n"), lambda line: F.contains(line, F.lit(","))))
    rows = per_part(rows, "head", lambda i: _head(F.get(f"_all{i}", F.lit(0))))
    rows = per_part(rows, "at", lambda i: _spots(F.get(f"_all{i}", F.lit(0)), F.col(f"_head{i}")))
    rows = per_part(rows, "lines", lambda i: F.slice(f"_all{i}", 2, 2147483647))
    rows = per_part(rows, "frames", lambda i: F.transform(
        f"_lines{i}", lambda line: F.get(F.split(line, ","), F.get(F.col(f"_at{i}"), F.lit(0))).try_cast("int")))
    # as a rule the three lists of frames are the same, and the lines are zipped as they stand
    same = (F.col("_frames0") == F.col("_frames1")) & (F.col("_frames0") == F.col("_frames2")) & (F.size(F.array_distinct("_frames0")) == F.size("_frames0"))
    shared = F.array_intersect(F.array_intersect("_frames0", "_frames1"), F.col("_frames2"))
    found = F.transform(F.filter(shared, lambda f: f.isNotNull()), lambda f: F.struct(*[
        F.get(F.col(f"_lines{i}"), (F.array_position(F.col(f"_frames{i}"), f) - 1).cast("int")).alias(f"_lines{i}") for i in range(3)]))
    rows = rows.select(*keep, *[f"_at{i}" for i in range(3)], F.inline(F.when(same, F.arrays_zip(*[f"_lines{i}" for i in range(3)])).otherwise(found)))
    rows = rows.select(*keep, *[f"_at{i}" for i in range(3)], *[F.split(f"_lines{i}", ",").alias(f"_cells{i}") for i in range(3)])

    def cell(part: int, i: int, kind: str) -> Column:
        return F.get(F.col(f"_cells{part}"), F.get(F.col(f"_at{part}"), F.lit(i))).try_cast(kind)

    deltas = rows.select(*keep, cell(0, 0, "int").alias("frame"), *[(cell(0, i, "double") - cell(1, i, "double") - cell(2, i, "double")).alias(c)
                                                                   for i, c in enumerate(TERM_COLUMNS, 1)])
    return deltas.where(F.col("frame").isNotNull())


def energy_rollups(df: DataFrame) -> DataFrame:
    """Recomputes the gas, solvent and total sums from the terms."""
    def total(terms):
        out = F.lit(0.0)
        for t in terms:
            out = out + F.col(COLUMN_NAMES.get(t, t))
        return out

    gas, solvent = total(GAS_TERMS), total(SOLVENT_TERMS)
    return df.withColumns({"GGAS": gas, "GSOLV": solvent, "TOTAL": gas + solvent})


def energy_delta(df: DataFrame, keys: Sequence[str] = ("sequence", "run", "frame")) -> DataFrame:
    """Complex - Receptor - Ligand per frame: one shuffle and no join."""
    sign = F.when(F.col("section") == "Complex", 1.0).when(F.col("section").isin("Receptor", "Ligand"), -1.0)
    part = F.when(F.col("section") == "Complex", 1).when(F.col("section") == "Receptor", 2).when(F.col("section") == "Ligand", 4)
    sums = df.groupBy(*keys).agg(*[F.sum(sign * F.col(c)).alias(c) for c in TERM_COLUMNS], F.bit_or(part).alias("_parts"))
    return sums.where(F.col("_parts") == 7).drop("_parts")


def energy_summary(df: DataFrame, by: Sequence[str] = ("section",)) -> DataFrame:
    """Average, population standard deviation and standard error of each term, one row per term."""
    wide = df.groupBy(*by).agg(*[F.struct(
        F.avg(c).alias("average"), F.stddev_pop(c).alias("sd"),
        F.try_divide(F.stddev_pop(c), F.sqrt(F.count(c).cast("double"))).alias("sem"), F.count(c).alias("n")).alias(c) for c in TERM_COLUMNS])
    entries = F.array(*[F.struct(F.lit(c).alias("term"), F.col(f"{c}.average").alias("average"), F.col(f"{c}.sd").alias("sd"),
                                 F.col(f"{c}.sem").alias("sem"), F.col(f"{c}.n").alias("n")) for c in TERM_COLUMNS])
    return wide.select(*by, F.inline(entries))


def _combined(name: str, members: Sequence[str]) -> Column:
    squares = F.lit(0.0)
    for m in members:
        squares = squares + F.pow(F.col(f"_v.`{m}`"), 2)
    return F.struct(F.lit(name).alias("term"), F.sqrt(squares).alias("sd_prop"))


def propagated_sd(df: DataFrame, by: Sequence[str] = ("section",)) -> DataFrame:
    """Standard deviation of the roll-ups propagated from the terms: root of the summed squares."""
    names = {t: COLUMN_NAMES.get(t, t) for t in GAS_TERMS + SOLVENT_TERMS}
    spread = df.groupBy(*by).agg(F.struct(*[F.stddev_pop(c).alias(c) for c in names.values()]).alias("_v"))
    gas, solvent = [names[t] for t in GAS_TERMS], [names[t] for t in SOLVENT_TERMS]
    return spread.select(*by, F.inline(F.array(
        _combined("GGAS", gas), _combined("GSOLV", solvent), _combined("TOTAL", gas + solvent))))
