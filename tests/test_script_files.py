"""Script files are written by the tasks, and included files are found without the texts of the other lines."""

from datetime import datetime

from changewright.operators import includes as I
from changewright.sources import scripts as C


def test_written_scripts_come_back(spark, tmp_path):
    rows = [(f"s{i}", f"-- {i} {line:02d}") for i in range(300) for line in (2, 0, 1)] + [("empty", None), (None, "lost"), ("é 1", "ü")]
    folder = f"file:{tmp_path}/made"
    C.write_scripts(spark.createDataFrame(rows, "name string, line string"), folder)
    got = {r.name: (r.kind, r.sql) for r in C.read_scripts(spark, folder, "revert").collect()}
    want = {f"s{i}": ("revert", "".join(f"-- {i} {line:02d}\n" for line in range(3))) for i in range(300)} | {"empty": ("revert", "\n")}
    assert {k: v for k, v in got.items() if k.startswith(("s", "e"))} == want and len(got) == 302
    assert C.read_script_hashes(spark, folder).count() == 302
    assert not [f for f in (tmp_path / "made").iterdir() if f.suffix != ".sql"]


def test_driver_renames_no_script(spark, monkeypatch):
    """read_scripts used to rename every file in the driver, one after the other."""
    import inspect

    from changewright.catalog import history

    assert "fs.rename" not in inspect.getsource(history.read_scripts)
    assert {r.name for r in history.read_scripts(spark, "/root/testdata/sf0.001").collect()} > {"s1", "s2"}


def test_included_files_carry_no_texts(spark, monkeypatch):
    at = datetime(2024, 1, 1)
    long = "\n".join(["SELECT 1;"] * 50)
    scripts = spark.createDataFrame([(1, "deploy/a.sql", at, f"{long}\n\\i x.sql\n/*\n\\i gone.sql\n*/\n  \\ir y.sql;")], "id long, path string, planned_at timestamp, sql string")
    versions = spark.createDataFrame([("x.sql", at, f"{long}\n\\i z.sql"), ("deploy/y.sql", at, "y"), ("z.sql", at, None), ("x.sql", datetime(2025, 1, 1), "late")], "path string, ts timestamp, sql string")
    written = []
    monkeypatch.setattr(I, "cut", lambda df, cut=I.cut: written.append(cut(df)) or written[-1])
    got = sorted((list(r.ord), r.path, r.depth) for r in I.included_files(scripts, versions).collect())
    assert got == [([51], "x.sql", 1), ([51, 51], "z.sql", 2), ([55], "deploy/y.sql", 1)]
    assert max(t.count() for t in written) <= 3
    text = {r.id: r.sql for r in I.expand_includes(scripts, versions.fillna("z", "sql")).collect()}
    assert text[1].count("SELECT 1;") == 100 and "\nz\n" in text[1] and "\\i gone.sql" in text[1]
