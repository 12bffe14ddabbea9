"""Fixed-width surface reports (per residue and per atom), structure records and radii."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values: (first column, width) of the fields, counted from one.
RESIDUE_FIELDS = {
    "residue": (5, 3), "chain": (9, 1), "number": (10, 4),
    "all_abs": (14, 9), "all_rel": (23, 6), "side_abs": (29, 7), "side_rel": (36, 6), "main_abs": (42, 7),
    "main_rel": (49, 6), "nonpolar_abs": (55, 7), "nonpolar_rel": (62, 6), "polar_abs": (68, 7), "polar_rel": (75, 6),
}
TOTAL_FIELDS = {"all_abs": (6, 16), "side_abs": (22, 13), "main_abs": (35, 13), "nonpolar_abs": (48, 13), "polar_abs": (61, 13)}
ATOM_FIELDS = {
    "serial": (7, 5), "atom_name": (13, 4), "residue": (18, 3), "chain": (22, 1), "number": (23, 4),
    "x": (31, 8), "y": (39, 8), "z": (47, 8), "area": (55, 8), "radius": (63, 6),
}
PDB_FIELDS = {k: v for k, v in ATOM_FIELDS.items() if k not in ("area", "radius")}
TEXT_FIELDS = {"atom_name", "residue", "chain"}
INTEGER_FIELDS = {"serial", "number"}


def _fields(line: Column, layout: dict[str, tuple[int, int]]) -> list[Column]:
    out = []
    for name, (start, width) in layout.items():
        cell = F.substring(line, start, width)
        # a cast trims by itself
        cell = F.trim(cell) if name in TEXT_FIELDS else cell.try_cast("int" if name in INTEGER_FIELDS else "double")
        out.append(cell.alias(name))
    return out


def _records(lines: DataFrame, tag: str, layout, text: str) -> DataFrame:
    keep = [c for c in lines.columns if c != text]
    rows = lines.where(F.startswith(F.col(text), F.lit(tag)))
    return rows.select(*keep, *_fields(F.col(text), layout))


def parse_residue_surface(lines: DataFrame, text: str = "value") -> DataFrame:
    return _records(lines, "RES ", RESIDUE_FIELDS, text)


def parse_surface_totals(lines: DataFrame, text: str = "value") -> DataFrame:
    return _records(lines, "TOTAL", TOTAL_FIELDS, text)


def parse_atom_surface(lines: DataFrame, text: str = "value") -> DataFrame:
    return _records(lines, "ATOM", ATOM_FIELDS, text)


def parse_structure(lines: DataFrame, text: str = "value") -> DataFrame:
    return _records(lines, "ATOM", PDB_FIELDS, text)


# The record tags, the fields that a line of each kind must have, and the tags of lines without data.
RECORDS = {"residue": ("RES ", RESIDUE_FIELDS, ("number", "all_abs")), "total": ("TOTAL", TOTAL_FIELDS, ("all_abs",)),
           "atom": ("ATOM", ATOM_FIELDS, ("serial", "x", "y", "z"))}
WITHOUT_DATA = ("REM", "REMARK", "END", "TER", "HEADER", "CHAIN", "HEM")


def parse_surface_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines of mixed surface and structure files, told apart by their record tag.

    Adds ``record`` (residue, total, atom, none for lines without data, rejected), a struct of fields for each kind of record, NULL on lines of another
    kind, and ``rejected``: the text of a line with an unknown tag, or without a field that its kind must have.
    """
    line = F.col(text)
    keep = [c for c in lines.columns if c != text]
    kind = F.lit(None).cast("string")
    for name, (tag, _, _) in RECORDS.items():
        kind = F.when(F.startswith(line, F.lit(tag)), F.lit(name)).otherwise(kind)
    plain = F.trim(line) == ""
    for tag in WITHOUT_DATA:
        plain = plain | F.startswith(line, F.lit(tag))
    tagged = lines.withColumn("_kind", F.when(kind.isNotNull(), kind).when(plain, F.lit("none")))
    structs = {name: F.when(F.col("_kind") == name, F.struct(*_fields(line, layout))) for name, (_, layout, _) in RECORDS.items()}
    parsed = tagged.withColumns(structs)
    whole = F.col("_kind") == "none"
    for name, (_, _, needed) in RECORDS.items():
        own = F.col("_kind") == name
        for field in needed:
            own = own & F.col(f"{name}.{field}").isNotNull()
        whole = whole | own
    ok = F.coalesce(whole, F.lit(False))
    return parsed.select(*keep, F.when(ok, F.col("_kind")).otherwise(F.lit("rejected")).alias("record"),
                         *[F.when(ok, F.col(name)).alias(name) for name in RECORDS], F.when(~ok, line).alias("rejected"))


def read_surface_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the report files below a path, with the path they come from."""
    return parse_surface_lines(read_report_lines(spark, path))


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the path they come from; the files are split and read in parallel."""
    return spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))


def surface_totals(residues: DataFrame, by: Sequence[str]) -> DataFrame:
    """Residue areas summed per chain and over all chains (chain NULL)."""
    measures = [c for c in RESIDUE_FIELDS if c.endswith("_abs")]
    keys = F.array(F.col("chain"), F.lit(None).cast("string"))
    # sums per chain first, so that the second level adds up a handful of rows
    chains = residues.groupBy(*by, "chain").agg(*[F.sum(c).alias(c) for c in measures])
    return chains.withColumn("chain", F.explode(keys)).groupBy(*by, "chain").agg(*[F.sum(c).alias(c) for c in measures])


def buried_surface(whole: DataFrame, part: DataFrame, keys: Sequence[str], area: str = "all_abs") -> DataFrame:
    """Area of the isolated part that is covered in the complex, per residue or atom."""
    a = whole.select(*keys, F.col(area).alias("complex_area"))
    b = part.select(*keys, F.col(area).alias("isolated_area"))
    return b.join(a, list(keys), "inner").withColumn("buried", F.col("isolated_area") - F.col("complex_area"))


def attach_radius(atoms: DataFrame, radii: DataFrame, name: str = "atom_name", radius: str = "radius") -> DataFrame:
    """Left lookup of a radius by atom name; a name listed twice counts once (smallest radius)."""
    lookup = radii.groupBy(name).agg(F.min(radius).alias("vdw_radius"))
    return atoms.join(lookup, name, "left")
