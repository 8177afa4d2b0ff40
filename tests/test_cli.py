import pytest

from quillspark import cli


def test_list_and_run(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "dup_pairs" in capsys.readouterr().out.split()
    out = str(tmp_path / "out")
    assert cli.main(["run", "stage_gate", "/root/testdata/sf0.001", "--out", out, "--format", "json"]) == 0
    assert spark.read.json(out).count() == 1500
    assert cli.main(["run", "no_deviation", "/root/testdata/sf0.001", "--rows", "2"]) == 0 and "said" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "no such query", "x"])
