import math

import pytest
from pyspark.sql import functions as F

from framecv.functions.scalars import clean_feature_name, derive_labels, fraction_tag, log_intensity, percent_tag
from framecv.functions.sequence import center_kmer, flank, has_motif, mutation_plan, reverse_complement
from framecv.operators.stats import fit_stats
from framecv.sources.energy import (TERM_COLUMNS, energy_delta, energy_rollups, energy_summary, parse_energy_reports, propagated_sd, read_energy_reports,
                                    report_deltas)
from framecv.sources.predictions import (collect_regression_predictions, file_account, file_name, name_columns, read_by_task, read_predictions, standard_names)
from framecv.sources.surface import (attach_radius, buried_surface, parse_atom_surface, parse_residue_surface, parse_structure,
                                     parse_surface_totals, read_report_lines, read_surface_files, surface_totals)
from framecv.sources.tables import (format_metrics, load_fold, load_stats, model_matrix, params_dict, read_csv, read_frames, read_labels, read_params,
                                    resolve_dataset, save_stats, write_params, write_predictions, write_splits)

# The first frame of each section of a published report.
HEADER = "Frame #,BOND,ANGLE,DIHED,VDWAALS,EEL,1-4 VDW,1-4 EEL,EGB,ESURF,GGAS,GSOLV,TOTAL"
COMPLEX = "1,1170.34,2776.45,4697.73,-2863.5,-4.08,1289.47,79.11,-2644.4,168.06,7145.52,-2476.34,4669.18"
RECEPTOR = "1,613.65,1164.48,2189.89,-1315.1,2174.3,599.29,-333.57,-3244.3,92.35,5092.94,-3151.95,1940.99"
LIGAND = "1,556.68,1611.97,2507.84,-1414.38,-1068.34,690.18,412.69,-483.06,96.99,3296.63,-386.07,2910.56"
DELTA = "1,0.0,0.0,0.0,-134.01,-1110.05,0.0,0.0,1082.97,-21.29,-1244.06,1061.68,-182.37"
SECTIONS = {"Complex": COMPLEX, "Receptor": RECEPTOR, "Ligand": LIGAND, "Delta": DELTA}


@pytest.fixture
def energy_file(tmp_path):
    folder = tmp_path / "set_ACGTACGT" / "3"
    folder.mkdir(parents=True)
    second = {k: v.replace("1,", "2,", 1) for k, v in SECTIONS.items()}
    text = "GENERALIZED BORN:\n" + "\n".join(f"{k} Energy Terms\n{HEADER}\n{v}\n{second[k]}\n" for k, v in SECTIONS.items())
    (folder / "results.csv").write_text(text)
    other = tmp_path / "set_TTTT" / "1"
    other.mkdir(parents=True)
    (other / "results.csv").write_text(text.replace("\n", "\r\n"))
    return str(tmp_path)


def test_energy_reports(spark, energy_file):
    rows = read_energy_reports(spark, f"{energy_file}/*/*/results.csv")
    assert rows.count() == 16
    got = {(r["sequence"], r["run"], r["section"], r["frame"]): r for r in rows.collect()}
    for seq, run in (("ACGTACGT", 3), ("TTTT", 1)):
        for name, line in SECTIONS.items():
            assert [got[seq, run, name, 1][c] for c in TERM_COLUMNS] == [float(x) for x in line.split(",")[1:]]
    delta = energy_delta(rows).where("frame = 1 and sequence = 'TTTT'").first()
    assert [delta[c] for c in TERM_COLUMNS] == pytest.approx([float(x) for x in DELTA.split(",")[1:]], abs=0.011)
    for r in energy_rollups(rows).collect():
        same = got[r["sequence"], r["run"], r["section"], r["frame"]]
        assert [r[c] for c in ("GGAS", "GSOLV", "TOTAL")] == pytest.approx([same[c] for c in ("GGAS", "GSOLV", "TOTAL")], abs=0.011)
    assert energy_delta(rows.where("section <> 'Ligand'")).count() == 0


def test_energy_summary(spark):
    rows = spark.createDataFrame([tuple([1.0 * i] * 12) for i in (1, 2, 3)], ", ".join(f"{c} double" for c in TERM_COLUMNS))
    got = {r["term"]: r for r in energy_summary(rows, []).collect()}
    sd = math.sqrt(2 / 3)
    assert (got["TOTAL"]["average"], got["TOTAL"]["sd"], got["TOTAL"]["sem"]) == (2.0, pytest.approx(sd), pytest.approx(sd / math.sqrt(3)))
    prop = {r["term"]: r["sd_prop"] for r in propagated_sd(rows, []).collect()}
    assert prop == {"GGAS": pytest.approx(sd * math.sqrt(7)), "GSOLV": pytest.approx(sd * math.sqrt(2)), "TOTAL": pytest.approx(sd * 3)}


RSA = """REM  File of summed (Sum) and % (per.) accessibilities for
RES  DT     1   230.32 -99.9 230.32 -99.9   0.00 -99.9 159.43 -99.9  70.89 -99.9
RES  DT     2   179.09 -99.9 107.10 -99.9  71.99 -99.9  88.62 -99.9  90.47 -99.9
RES ALA   254   103.74  96.1  97.57 140.6   6.17  16.0  32.81  46.0  70.92 193.9
END  Absolute sums over single chains surface
CHAIN  1 _      513.1        435.0         78.2        280.9        232.3
TOTAL         24020.8      18571.9       5448.9      12212.4      11808.5
"""
ASA = """ATOM      1  O5'  DT     1      15.320  88.250  57.720  29.165  1.40
ATOM      3  C5'  DT     1      14.480  87.550  58.660-146.622  1.80
"""
PDB = """REMARK    SIMULATION BOX
ATOM      1  O5'  DT     1      15.320  88.250  57.720  1.00  0.00           O
ATOM      4 H5'1  DT     1      13.430  87.840  58.590  1.00  0.00           H
"""


def test_surface_reports(spark, tmp_path):
    for name, text in (("a.rsa", RSA), ("a.asa", ASA), ("a.pdb", PDB)):
        (tmp_path / name).write_text(text)
    lines = lambda name: read_report_lines(spark, str(tmp_path / name))
    res = parse_residue_surface(lines("a.rsa"))
    got = res.orderBy("number").collect()
    assert [(r["residue"], r["number"], r["all_abs"], r["polar_rel"]) for r in got] == [
        ("DT", 1, 230.32, -99.9), ("DT", 2, 179.09, -99.9), ("ALA", 254, 103.74, 193.9)]
    assert parse_surface_totals(lines("a.rsa")).first()["polar_abs"] == 11808.5
    sums = surface_totals(res, ["path"]).collect()
    assert len(sums) == 2 and all(r["all_abs"] == pytest.approx(513.15) for r in sums)
    atoms = parse_atom_surface(lines("a.asa")).orderBy("serial").collect()
    assert [(a["atom_name"], a["x"], a["area"], a["radius"]) for a in atoms] == [("O5'", 15.32, 29.165, 1.4), ("C5'", 14.48, -146.622, 1.8)]
    pdb = parse_structure(lines("a.pdb")).orderBy("serial").collect()
    assert [(a["atom_name"], a["residue"], a["number"], a["z"]) for a in pdb] == [("O5'", "DT", 1, 57.72), ("H5'1", "DT", 1, 58.59)]
    radii = spark.createDataFrame([("O5'", 1.53), ("O5'", 1.5), ("X", 1.0)], "atom_name string, radius double")
    joined = attach_radius(parse_atom_surface(lines("a.asa")), radii).orderBy("serial").collect()
    assert [r["vdw_radius"] for r in joined] == [1.5, None]
    part = res.withColumn("all_abs", F.col("all_abs") + 10)
    assert {round(r["buried"], 6) for r in buried_surface(res, part, ["number"]).collect()} == {10.0}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_prediction_files(spark, tmp_path):
    body = "Label,Predicted,True\nA,1.0,0.0\nB,0.0,0.0\n"
    for name in ("predictions_reg_scr0p25_rep1_fold2.csv", "predictions_test_bin_scr0p00.csv", "predictions_mclass_scr1p00_rep0_fold0.csv",
                 "predictions_reg_final_avg_scr0p00.csv", "predictions_other.csv"):
        if "final_avg" in name or "other" in name:
            continue
        write(tmp_path / name, body)
    write(tmp_path / "predictions_other_scr.csv", body)
    rows = read_predictions(spark, str(tmp_path))
    got = {(r["model_type"], r["scr_frac"], r["rep"], r["fold"], r["is_test"]) for r in rows.collect()}
    assert got == {("reg", 0.25, 1, 2, False), ("bin", 0.0, None, None, True), ("mclass", 1.0, 0, 0, False)}
    tasks = read_by_task(spark, str(tmp_path))
    assert dict(tasks["bin"].dtypes)["True_class"] == "int" and "Predicted_reg" in tasks["reg"].columns and "mclass" in tasks["mclass"].columns
    assert {k: v.count() for k, v in tasks.items()} == {"reg": 2, "bin": 2, "mclass": 2}


def test_prediction_sweeps(spark, tmp_path):
    body = "Label,Predicted,True\nA,1.0,0.0\n"
    for name in ("predictions_reg_scr0p00_noi05_rep1_fold2.csv", "predictions_test_reg_scr0p00_noi28.csv",
                 "predictions_reg_scr0p00_sub75_rep0_fold1.csv", "predictions_reg_scr0p00_rep0_fold1.csv"):
        write(tmp_path / name, body)
    noise = read_predictions(spark, str(tmp_path), sweep="noi").collect()
    assert {(r["noise_level"], r["is_test"]) for r in noise} == {(0.05, False), (0.28, True)}
    sub = read_predictions(spark, str(tmp_path), sweep="sub").collect()
    assert [(r["sub_pct"], r["fold"]) for r in sub] == [(75, 1)]


def test_nested_predictions(spark, tmp_path):
    write(tmp_path / "deep" / "er" / "predictions_reg_scr0p00_rep0_fold0.csv", "Label,Predicted,True\nA,1.5,0.5\n")
    write(tmp_path / "deep" / "predictions_test_reg_scr0p00.csv", "Label,Predicted,True\nA,2.5,0.5\n")
    write(tmp_path / "deep" / "predictions_reg_final_avg_scr0p00.csv", "Label,AvgPredicted,AvgTrue\nA,3.5,0.5\n")
    write(tmp_path / "deep" / "predictions_bin_scr0p00_rep0_fold0.csv", "Label,Predicted,True\nA,1,0\n")
    write(tmp_path / "deep" / "metrics.csv", "a,b\n1,2\n")
    rows = collect_regression_predictions(spark, str(tmp_path / "deep")).collect()
    assert {(r["Predicted_reg"], r["is_test"], r["final_avg"]) for r in rows} == {(1.5, False, False), (2.5, True, False), (3.5, False, True)}
    (tmp_path / "deep" / "predictions_reg_final_avg_scr0p00.csv").unlink()
    assert collect_regression_predictions(spark, str(tmp_path / "deep")).count() == 2
    with pytest.raises(ValueError):
        standard_names(spark.createDataFrame([(1.0,)], "Predicted double"))


def test_names_round_trip(spark):
    df = spark.createDataFrame([(False, 0.25, 1, 2, 0.29), (True, 1.0, None, None, 0.05)], "t boolean, s double, r int, f int, l double")
    args = [F.col(c) for c in ("t", "s", "r", "f")]
    names = df.select("*", file_name("reg", *args).alias("n"), file_name("reg", *args, F.col("l")).alias("m"))
    assert [r["n"] for r in names.collect()] == ["predictions_reg_scr0p25_rep1_fold2.csv", "predictions_test_reg_scr1p00.csv"]
    assert [r["m"] for r in names.collect()] == ["predictions_reg_scr0p25_noi28_rep1_fold2.csv", "predictions_test_reg_scr1p00_noi05.csv"]
    back = names.select("s", "r", *[c.alias(f"x_{k}") for k, c in name_columns(F.col("m")).items()]).collect()
    assert all(r["s"] == r["x_scr_frac"] and r["r"] == r["x_rep"] for r in back)
    assert df.select(fraction_tag(F.col("s")), percent_tag("sub", F.col("l"))).first()[:] == ("0p25", "sub28")


def test_tables(spark, tmp_path):
    write(tmp_path / "labels.csv", "sequence,bind_avg,extra\nAA,-0.5,1\nCC,1.5,2\n")
    labels = read_labels(spark, str(tmp_path / "labels.csv"), "sequence", "bind_avg")
    assert labels.columns == ["sequence", "bind_avg"] and labels.count() == 2
    with pytest.raises(ValueError, match="lacks"):
        read_labels(spark, str(tmp_path / "labels.csv"), "sequence", "none")
    write(tmp_path / "one.csv", "seq,a,b\nAA,1.0,2.0\n")
    write(tmp_path / "two.csv", "seq,a\nCC,3.0\n")
    union = read_frames(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], "seq", common_key="entity")
    assert {tuple(r) for r in union.select("entity", "a", "b").collect()} == {("AA", 1.0, 2.0), ("CC", 3.0, None)}
    assert read_frames(spark, [str(tmp_path / "one.csv")], "seq", ["b"]).columns == ["seq", "b"]
    with pytest.raises(ValueError):
        read_frames(spark, [str(tmp_path / "two.csv")], "seq", ["b"])
    with pytest.raises(Exception):
        read_labels(spark, str(tmp_path / "one.csv"), "seq", "a", "seq string, z double").collect()


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("e", r, f, 1.0 * f) for r in (0, 1) for f in (0, 1, 2)], "entity string, repeat int, fold int, a double")
    write_splits(df, str(tmp_path / "s"))
    assert load_fold(spark, str(tmp_path / "s"), 1, 2).count() == 1
    assert {r["fold"] for r in load_fold(spark, str(tmp_path / "s"), 0, 2, validation=False).collect()} == {0, 1}
    stats = fit_stats(df, ["a"])
    save_stats(stats, ["a"], str(tmp_path / "st"))
    assert load_stats(spark, str(tmp_path / "st"), ["a"]).first() == stats.first()
    with pytest.raises(ValueError):
        load_stats(spark, str(tmp_path / "s"), ["a"])
    write_predictions(df.withColumnRenamed("a", "predicted").withColumn("true", F.lit(1.0)), str(tmp_path / "p"), by=["fold"])
    back = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert back.columns == ["Label", "Predicted", "True", "fold"] and back.count() == 6
    resolved = resolve_dataset(spark, str(tmp_path / "none"), str(tmp_path / "s"))
    assert resolved.count() == 6
    params = spark.createDataFrame([(90.0, None, "sqrt")], "keep double, max_depth int, max_features string")
    write_params(params, str(tmp_path / "j"))
    assert params_dict(read_params(spark, str(tmp_path / "j"), params.schema)) == {"keep": 90.0, "max_depth": None, "max_features": "sqrt"}


def test_matrix_and_text(spark):
    df = spark.createDataFrame([("e", 1, 7, 0.1, 2)], "entity string, run int, block int, a double, y int")
    m = model_matrix(df, "entity", "y", task="bin")
    assert m.dtypes == [("entity", "string"), ("a", "float"), ("y", "int")]
    x = spark.createDataFrame([(0.123456, float("nan"), None)], "a double, b double, c double")
    assert format_metrics(x, ["a", "b", "c"]).first()[:] == ("0.1235", "NaN", "NaN")


SEQ = "GTACACAATTTTTTACAAAATTTAAATTAAAACAAA"


def test_sequence_functions(spark):
    df = spark.createDataFrame([(SEQ,), (SEQ[:15] + "CACGTG" + SEQ[21:],), (SEQ[:20],), (None,)], "s string")
    s = F.col("s")
    first = df.select(*[center_kmer(s, k) for k in (12, 10, 8, 6)], flank(s, 3), reverse_complement(s)).first()
    assert first[:5] == ("TTACAAAATTTA", "TACAAAATTT", "ACAAAATT", "CAAAAT", "TTA_TTA")
    assert first[5] == "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[b] for b in reversed(SEQ))
    assert [r[0] for r in df.select(has_motif(s)).collect()] == [False, True, False, False]
    plan = mutation_plan(df.limit(1), "s").orderBy("residue").collect()
    assert len(plan) == 36
    assert tuple(plan[0])[1:] == (1, "G", 2, 72, "C", 1) and tuple(plan[35])[1:] == (36, "A", 0, 37, "T", 3)
    assert spark.range(1).select(log_intensity(F.lit(932))).first()[0] == pytest.approx(6.837332814685591)
    y = spark.createDataFrame([(-0.1,), (0.0,), (0.96,), (1.03,), (None,)], "y double")
    assert [tuple(r)[1:] for r in derive_labels(y, "y").collect()] == [(0, 1), (1, 0), (1, 0), (2, 0), (None, None)]
    n = spark.createDataFrame([("HB Energy",), ("Delta_Entropy",), ("EEL",)], "n string")
    assert [r[0] for r in n.select(clean_feature_name(F.col("n"))).collect()] == ["HB", "Entropy", "EEL"]


def _report(frames, order=None, titles=SECTIONS, skip=(), extra=()):
    """A report with the given frames in every section; columns in another order if asked."""
    names = HEADER.split(",")
    at = order or range(len(names))
    text = "REPORT\n\n"
    for k, title in enumerate(titles):
        lines = [",".join(names[i] for i in at)]
        for f in [*frames, *(extra if title == "Receptor" else ())]:
            if (title, f) not in skip:
                cells = [str(f), *[f"{(f * 7 + i * 3 + k * 11) % 50}.5" for i in range(12)]]
                lines.append(",".join(cells[i] for i in at))
        text += f"{title} Energy Terms\n" + "\n".join(lines) + "\n \n"
    return text


def test_deltas_inside_a_report_equal_those_of_the_rows(spark):
    texts = [("a", _report(range(1, 82))), ("b", _report([3, 1, 2], order=[5, 0, 1, 2, 3, 4, 12, 11, 10, 9, 8, 7, 6])), ("c", _report([1, 2], skip={("Ligand", 2)})),
             ("d", _report([1, 2], titles=["Complex", "Receptor"])), ("e", _report([4, 5]).replace("\n", "\r\n")), ("f", "no report"), ("g", _report([1, 2, 3], extra=[9])),
             ("h", None), ("i", _report([]))]
    reports = spark.createDataFrame(texts, "report string, value string")
    got = {(r["report"], r["frame"]): [r[c] for c in TERM_COLUMNS] for r in report_deltas(reports).collect()}
    want = {(r["report"], r["frame"]): [r[c] for c in TERM_COLUMNS] for r in energy_delta(parse_energy_reports(reports), ["report", "frame"]).collect()}
    assert set(got) == set(want) == {*[("a", i) for i in range(1, 82)], *[("b", i) for i in (1, 2, 3)], ("c", 1), *[("e", i) for i in (4, 5)], *[("g", i) for i in (1, 2, 3)]}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    assert "Exchange" not in report_deltas(reports)._jdf.queryExecution().executedPlan().toString()


def test_large_reports_are_read_section_by_section(spark, tmp_path):
    folder = tmp_path / "x_GATTACA" / "4"
    folder.mkdir(parents=True)
    (folder / "results.csv").write_text(_report(range(1, 5000)).replace("\n \n", "\n\n"))
    rows = read_energy_reports(spark, f"{tmp_path}/*/*/*.csv")
    assert rows.where("sequence = 'GATTACA' and run = 4").groupBy("section").count().collect() and rows.count() == 4 * 4999
    assert energy_delta(rows).count() == 4999


def test_mixed_lines_are_told_apart(spark, tmp_path):
    (tmp_path / "mixed.txt").write_text(RSA + ASA + PDB + "HELIX    1\nATOM      9  cut\nRES  DT     3   no number\n\nTER\n")
    rows = read_surface_files(spark, str(tmp_path / "mixed.txt")).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["record"], []).append(r)
    assert {k: len(v) for k, v in kinds.items()} == {"residue": 3, "total": 1, "atom": 4, "none": 6, "rejected": 3}
    assert sorted(r["rejected"] for r in kinds["rejected"]) == ["ATOM      9  cut", "HELIX    1", "RES  DT     3   no number"]
    assert all(r["rejected"] is None for k, v in kinds.items() if k != "rejected" for r in v)
    assert kinds["total"][0]["total"]["polar_abs"] == 11808.5 and kinds["total"][0]["atom"] is None
    assert sorted(r["residue"]["all_abs"] for r in kinds["residue"]) == [103.74, 179.09, 230.32]
    assert sorted(r["atom"]["x"] for r in kinds["atom"]) == [13.43, 14.48, 15.32, 15.32]


def test_account_of_files(spark, tmp_path):
    deep = tmp_path / "in" / "deep"
    write(deep / "predictions_reg_scr0p00_rep0_fold0.csv", "Label,Predicted,True\nA,1.5,0.5\nB,1.5,0.5\n")
    write(deep / "er" / "predictions_test_reg_scr0p50.csv", "Label,Predicted,True\nA,2.5,0.5\n")
    write(deep / "predictions_reg_scr0p00_rep1_fold0.csv", "Label,Predicted,True\n")
    write(deep / "predictions_reg_scr0p00_rep2_fold0.csv", "")
    write(deep / "predictions_reg_scr0p00_rep3_fold0.csv.gz", "this is no compressed file, whatever its name says")
    write(deep / "predictions_reg_scrambled.csv", "Label,Predicted,True\nA,2.5,0.5\n")
    rows = file_account(spark, str(tmp_path / "in"), "predictions_*").collect()
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["n_rows"]) for r in rows}
    assert got == {"predictions_reg_scr0p00_rep0_fold0.csv": ("read", 2), "predictions_test_reg_scr0p50.csv": ("read", 1), "predictions_reg_scr0p00_rep1_fold0.csv": ("empty", 0),
                   "predictions_reg_scr0p00_rep2_fold0.csv": ("empty", 0), "predictions_reg_scr0p00_rep3_fold0.csv.gz": ("skipped", 0), "predictions_reg_scrambled.csv": ("unnamed", 1)}
    assert read_predictions(spark, str(tmp_path / "in"), "predictions_*", recursive=True).count() == 3


def test_paths_with_odd_characters(spark, tmp_path):
    write(tmp_path / "a b%c" / "predictions_reg_scr0p25_rep0_fold3.csv", "Label,Predicted,True\nA,1.5,0.5\n")
    row = read_predictions(spark, str(tmp_path / "a b%c").replace("%", "%"), "predictions_*", recursive=True).first()
    assert (row["scr_frac"], row["rep"], row["fold"], row["Predicted"]) == (0.25, 0, 3, 1.5)


def test_types_from_the_first_lines(spark, tmp_path):
    write(tmp_path / "t.csv", "n,x,s,none\n" + "".join(f"{i},{i}.5,a{i},\n" for i in range(2000)))
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("s", "string"), ("none", "string")] and df.count() == 2000
    write(tmp_path / "late.csv", "n\n" + "1\n" * 2000 + "word\n")
    assert read_csv(spark, str(tmp_path / "late.csv"), "n string").count() == 2001
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|CANNOT_PARSE|FAILED_READ"):
        read_csv(spark, str(tmp_path / "late.csv")).collect()


def test_report_files_are_compressed(spark):
    from pathlib import Path

    from framecv.catalog.reports import energy_files

    files = [p for p in Path(energy_files(spark, "/root/testdata/sf0.001")).rglob("part-*")]
    assert files and all(p.name.endswith(".txt.gz") for p in files)
