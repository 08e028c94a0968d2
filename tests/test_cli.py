from quarry.__main__ import main


def test_list_and_run(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "dedup_exact_plan *" in capsys.readouterr().out
    assert main(["run", "status_histogram", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
