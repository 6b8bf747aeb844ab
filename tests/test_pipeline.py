"""Configuration, staged runs that resume, run records."""

import pytest

from larkspur.pipeline import Runner, Stage, Tracker, check_config, merged, substitute


def test_substitution():
    env = {"A": "x", "N": "3"}
    got = substitute({"a": "${A}", "b": ["${N}", "${M:2.5}", "${F:true}"], "c": "p-${A}-${Z:}"}, env)
    assert got == {"a": "x", "b": [3, 2.5, True], "c": "p-x-"}
    with pytest.raises(KeyError):
        substitute("${NONE}", env)


def test_merge_and_check():
    c = merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}})
    assert c == {"a": {"b": 3, "c": 2}}
    assert check_config(c, {"a.b": int, "a.x": str, "a.c": str}) == ["a.x is missing", "a.c is int, not str"]


def test_runner_resumes(spark, tmp_path):
    calls = []

    def stage(name, f):
        def run(s, config, frames):
            calls.append(name)
            return f(s, config, frames)

        return run

    stages = [
        Stage("sum", stage("sum", lambda s, c, f: f["load"].selectExpr("sum(id) AS s")), ["load"]),
        Stage("load", stage("load", lambda s, c, f: s.range(c["n"]))),
    ]
    r = Runner(spark, str(tmp_path), stages, {"n": 5})
    assert r.plan() == ["load", "sum"]
    assert r.run("a")["sum"].first().s == 10
    assert r.run("a")["sum"].first().s == 10 and calls == ["load", "sum"]
    with pytest.raises(ValueError, match="wait for each other"):
        Runner(spark, str(tmp_path), [Stage("x", stages[0].run, ["y"]), Stage("y", stages[0].run, ["x"])]).plan()


def test_tracker(spark, tmp_path):
    t = Tracker(spark, str(tmp_path))
    t.log("a", {"depth": 3}, {"auc": 0.8})
    t.log("b", {"depth": 5}, {"auc": 0.9, "ks": 0.4})
    assert t.best("auc") == "b" and t.best("auc", least=True) == "a" and t.best("none") is None
    assert {(r.run, r.auc, r.ks) for r in t.compare(["auc", "ks"]).collect()} == {("a", 0.8, None), ("b", 0.9, 0.4)}
