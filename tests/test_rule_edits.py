"""Rules edited by several writers: no edit of another rule is lost, the last edit of a rule stands."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from threatloom.operators import rule_table
from threatloom.sources.tables import default_rules


def _change(spark, rule_id, title, order=1):
    return default_rules(spark).limit(1).withColumns({"id": F.lit(rule_id), "title": F.lit(title), "change_order": F.lit(order)})


def _titles(spark, path):
    return {r["id"]: r["title"] for r in rule_table.load_rules(spark, path).collect()}


def test_writers_at_the_same_moment(spark, tmp_path):
    path = str(tmp_path / "rules")
    rule_table.write_rules(default_rules(spark), path)
    before = _titles(spark, path)
    victim = min(before)
    edits = [(_change(spark, f"own-{k}", f"t{k}"), None) for k in range(4)]
    edits.append((None, spark.createDataFrame([(victim,), ("unknown",), (None,)], "id string")))
    with ThreadPoolExecutor(len(edits)) as writers:
        list(writers.map(lambda e: rule_table.edit_rules(path, *e), edits))
    after = _titles(spark, path)
    assert after == {i: t for i, t in before.items() if i != victim} | {f"own-{k}": f"t{k}" for k in range(4)}


def test_last_edit_stands(spark, tmp_path):
    path = str(tmp_path / "rules")
    rule_table.edit_rules(path)
    rule_table.edit_rules(path, _change(spark, "a", "old", 1).unionByName(_change(spark, "a", "new", 2)))
    assert _titles(spark, path) == {"a": "new"}  # no version was ever written
    rule_table.edit_rules(path, _change(spark, "b", "kept"), spark.createDataFrame([("a",)], "id string"))
    assert _titles(spark, path) == {"b": "kept"}
    rule_table.edit_rules(path, _change(spark, "a", "again"))
    assert _titles(spark, path) == {"a": "again", "b": "kept"}
    rule_table.edit_rules(path, _change(spark, " ", "named"))
    named = _titles(spark, path)
    assert sorted(named.values()) == ["again", "kept", "named"] and _titles(spark, path) == named


def test_a_new_version_folds_edits(spark, tmp_path):
    path = str(tmp_path / "rules")
    rule_table.write_rules(default_rules(spark).limit(0), path)
    rule_table.edit_rules(path, _change(spark, "a", "one"))
    rule_table.write_rules(rule_table.load_rules(spark, path), path)
    assert _titles(spark, path) == {"a": "one"}
    rule_table.edit_rules(path, _change(spark, "a", "two"))
    assert _titles(spark, path) == {"a": "two"}
    rule_table.write_rules(default_rules(spark).limit(1), path)
    assert "a" not in _titles(spark, path) and len(_titles(spark, path)) == 1
