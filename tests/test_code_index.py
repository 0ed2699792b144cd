"""Incremental parsing: three refreshes give what one full run gives, and unchanged files aren't parsed."""

import pytest

from millrace.operators import code_index
from millrace.operators.code_index import Settings

PY = "def f():\n    return {}\n"
CPP = "int g{}(int a) {{\n  return a;\n}}\n"


def frame(spark, files):
    return spark.createDataFrame([(p, float(m), len(t or ""), t) for p, (m, t) in files.items()], "path string, mtime double, size long, text string").repartition(3)


def units(spark, state):
    return sorted((r.path, r.unit_type, r.name, r.lineno, r.code, r.sha1) for r in code_index.current_units(spark, state).collect())


def test_three_refreshes_like_one(spark, tmp_path):
    settings = Settings(languages=("python", "c++"))
    state = str(tmp_path / "s")
    one = {f"p{i}.py": (1, PY.format(i)) for i in range(20)} | {f"c{i}.cpp": (1, CPP.format(i)) for i in range(20)} | {"r.md": (1, "x"), "bad.py": (1, "def f(:\n")}
    assert code_index.refresh(frame(spark, one), state, settings) == {"unchanged": 0, "parsed": 41, "errors": 1, "removed": 0}
    two = dict(one) | {"p3.py": (2, PY.format("changed")), "new.cpp": (2, CPP.format("new")), "p4.py": (2, PY.format(4))}
    del two["c7.cpp"], two["p1.py"]
    assert code_index.refresh(frame(spark, two), state, settings) == {"unchanged": 37, "parsed": 3, "errors": 0, "removed": 2}
    three = dict(two) | {"bad.py": (3, PY.format("mended")), "empty.py": (3, "")}
    assert code_index.refresh(frame(spark, three), state, settings) == {"unchanged": 39, "parsed": 2, "errors": 0, "removed": 0}
    full = str(tmp_path / "full")
    code_index.refresh(frame(spark, three), full, settings)
    assert units(spark, state) == units(spark, full)
    code_index.compacted(spark, state, str(tmp_path / "c"))
    assert units(spark, str(tmp_path / "c")) == units(spark, full)
    assert code_index.refresh(frame(spark, three), str(tmp_path / "c"), settings)["parsed"] == 0
    # All files go, then come again.
    assert code_index.refresh(frame(spark, three).where("false"), state, settings) == {"unchanged": 0, "parsed": 0, "errors": 0, "removed": 41}
    assert units(spark, state) == []
    assert code_index.refresh(frame(spark, three), state, settings)["parsed"] == 41


def test_other_settings_parse_all(spark, tmp_path):
    state, files = str(tmp_path / "s"), {f"c{i}.cpp": (1, CPP.format(i)) for i in range(5)} | {"a.py": (1, PY.format(1))}
    assert code_index.refresh(frame(spark, files), state)["parsed"] == 1
    assert code_index.refresh(frame(spark, files), state, Settings(languages=("python", "cpp")))["parsed"] == 6
    assert code_index.refresh(frame(spark, files), state, Settings(languages=("python", "cpp"), store_code=False)) == {"unchanged": 0, "parsed": 6, "errors": 0, "removed": 0}
    assert {r[4] for r in units(spark, state)} == {None}
    with pytest.raises(ValueError):
        Settings(languages=("cobol",))
    with pytest.raises(ValueError):
        Settings(units=("verse",))


def test_size_alone_is_a_change_and_a_lost_refresh_changes_nothing(spark, tmp_path):
    state = str(tmp_path / "s")
    files = {"a.py": (1, PY.format(1)), "b.py": (1, PY.format(2))}
    code_index.refresh(frame(spark, files), state)
    before = units(spark, state)
    # Units of a version that no manifest names, as a refresh leaves that is lost before its end.
    spark.read.parquet(f"{state}/units/version=1").write.parquet(f"{state}/units/version=2")
    assert units(spark, state) == before
    assert code_index.refresh(frame(spark, files | {"a.py": (1, PY.format(111))}), state)["parsed"] == 1
    assert [r[4] for r in units(spark, state)] == [PY.format(111).rstrip("\n"), PY.format(2).rstrip("\n")]
