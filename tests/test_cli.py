import json

from textbayes import cli
from textbayes.plans.analyzer import Model
from textbayes.streaming.scoring import score_stream


def write(path, rows):
    path.write_text("label\ttext_a\n" + "".join(f"{y}\t{t}\n" for y, t in rows), encoding="utf-8")
    return str(path)


def test_protocol(spark, tmp_path, capsys):
    good, bad = ["湖水清澈花香", "列车准时座位宽", "花香座位宽", "湖水清澈列车准时"], ["河水发臭虫多", "列车晚点座位破", "虫多座位破", "河水发臭列车晚点"]
    rows = lambda k: [(1, t + "甜" * k) for t in good] + [(0, t + "苦" * k) for t in bad]
    paths = [x for i, s in enumerate(("train", "dev", "test")) for x in (f"--{s}", write(tmp_path / f"{s}.tsv", rows(i + 1)))]
    out = tmp_path / "out"
    assert cli.main(["final-test", *paths, "--out", str(out), "--skip-bootstrap", "--save-model", str(tmp_path / "model")]) == 0
    assert (out / "final_test_metrics.csv").exists() and (out / "final_test_mcnemar.csv").exists() and not (out / "final_test_bootstrap.csv").exists()
    assert cli.main(["run", *paths, "--out", str(out)]) == 0 and (out / "validation_metrics.csv").exists()
    capsys.readouterr()
    assert cli.main(["explain", "--model-path", str(tmp_path / "model"), "--text", "湖水清澈", "河水发臭", "--top", "2"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["pred"] for x in lines] == [1, 0] and len(lines[0]["features"]) <= 2

    stream = tmp_path / "stream"
    spark.createDataFrame([(1, "湖水清澈！"), (2, "河水发臭。")], "doc_id long, text string").write.parquet(str(stream))
    query = score_stream(spark.readStream.schema("doc_id long, text string").parquet(str(stream)), Model.load(spark, str(tmp_path / "model")), str(tmp_path / "scored"), str(tmp_path / "check"))
    query.awaitTermination()
    assert {(r.doc_id, r.pred) for r in spark.read.parquet(str(tmp_path / "scored")).where("model = 'SDFWNB'").collect()} == {(1, 1), (2, 0)}


def test_exit_codes(capsys, tmp_path):
    assert cli.main(["info"]) == 0 and '"alpha": 0.05' in capsys.readouterr().out
    assert cli.main(["--config", str(tmp_path / "none.json"), "info"]) == 2
    assert cli.main(["download"]) == 1


def test_public_names():
    import textbayes

    assert all(callable(getattr(textbayes, name)) for name in textbayes.__all__)
