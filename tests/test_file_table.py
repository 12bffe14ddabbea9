from framecv.sources.predictions import read_predictions


def test_names_are_not_parsed_row_by_row(spark, tmp_path):
    (tmp_path / "predictions_reg_scr0p25_rep1_fold2.csv").write_text("Label,Predicted,True\nA,1.0,0.0\nB,0.0,0.0\n")
    rows = read_predictions(spark, str(tmp_path)).where("model_type = 'reg'")
    counted = rows.groupBy("model_type", "scr_frac", "is_test", "rep", "fold").count()
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()
    assert [tuple(r) for r in counted.collect()] == [("reg", 0.25, False, 1, 2, 2)]
