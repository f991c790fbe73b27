import json
import os

from analystry.sources import files as S


def test_strange_names(spark, tmp_path):
    rows = [(f"p {k % 3}/x", f"t{k:04}.txt", f"author {k % 7}") for k in range(50)] + [("é\"%", "a", None), (None, "b", "c")]
    df = spark.createDataFrame(rows, "problem string, `unknown-text` string, `predicted-author` string").repartition(7)
    S.write_answers(df, str(tmp_path / "out"))
    names = {n for n in os.listdir(tmp_path / "out") if not n.startswith(".")}
    assert names == {"answers-p 0%2Fx.json", "answers-p 1%2Fx.json", "answers-p 2%2Fx.json", "answers-é\"%.json", "answers-.json"}
    got = S.read_answers(spark, str(tmp_path / "out")).select("problem", "unknown-text", "predicted-author").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_answers_are_arrays_by_text(spark, tmp_path):
    rows = [(f"problem{k % 3}", f"t{k:04}.txt", None if k == 5 else f"author {k % 7}") for k in range(500)] + [("é", "a\n\"b.txt", "x")]
    df = spark.createDataFrame(rows, "problem string, `unknown-text` string, `predicted-author` string").repartition(7)
    target = str(tmp_path / "out")
    S.write_answers(df, target)
    names = sorted(n for n in os.listdir(target) if not n.startswith("."))
    assert names == ["answers-problem0.json", "answers-problem1.json", "answers-problem2.json", "answers-é.json"]
    for name in names:
        with open(f"{target}/{name}", encoding="utf-8") as file:
            found = json.load(file)
        problem = name[8:-5]
        assert found == [{"unknown-text": t, "predicted-author": a} for p, t, a in sorted(rows, key=lambda r: r[1]) if p == problem]
    assert sorted(map(str, map(tuple, S.read_answers(spark, target).select("problem", "unknown-text", "predicted-author").collect()))) == sorted(map(str, rows))
    S.write_answers(df.where("problem = 'problem1'").limit(2), target)
    assert len(json.load(open(f"{target}/answers-problem1.json"))) == 2 and len(json.load(open(f"{target}/answers-problem0.json"))) == 167
    S.write_answers(df.where("false"), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []
