"""Plan text, ids and includes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from changewright.functions import ids
from changewright.operators import includes as I
from changewright.plans import text as P

BASE = {"project": "compat", "uri": None, "change": "bootstrap", "parent": None, "requires": [], "conflicts": [], "note": "", "at": "2024-07-04T00:00:00Z"}
# Ids that other tools give for the same input.
GOLDEN = [
    ({}, "f0893c3a0550e0c4aa52bae5f45d6d6ab529d43e"),
    ({"uri": "https://example.com/compat"}, "f3b3afc29825731ce49da1a3286dccc13afceaea"),
    ({"change": "add_users", "parent": "f5abb43c365b611ccf0968e3e0f250c567197941", "at": "2024-07-04T00:01:00Z"}, "319648cdee1af1cf90be980651df69de51cf8d36"),
    ({"change": "add_posts", "parent": "beb07759db8ed811a9be170abe83ca24db5a8a28", "at": "2024-07-04T00:02:00Z", "requires": ["bootstrap", "add_users"]}, "15959e0ec706234aae91f387d90ff47abe996b1b"),
    ({"change": "new_auth", "parent": "f5abb43c365b611ccf0968e3e0f250c567197941", "at": "2024-07-04T00:03:00Z", "conflicts": ["old_auth"]}, "a4b3d90a09c6928e3d2a1bf7f7ad0d4186a18167"),
    ({"change": "revamp_schema", "parent": "f5abb43c365b611ccf0968e3e0f250c567197941", "at": "2024-07-04T00:04:00Z", "requires": ["bootstrap"], "conflicts": ["legacy_schema"]}, "d855d7fb6e36650e841cff24c334f45c14fd567c"),
    ({"change": "add_indexes", "parent": "f5abb43c365b611ccf0968e3e0f250c567197941", "at": "2024-07-04T00:05:00Z", "note": "Performance improvement for queries"}, "048c3305a2c89c1a0c25313b64d64270aa208e71"),
]


def test_golden_ids(spark):
    rows = [(i, {**BASE, **over}) for i, (over, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(
        [(i, r["project"], r["uri"], r["change"], r["parent"], r["at"], r["requires"], r["conflicts"], r["note"]) for i, r in rows],
        "i int, project string, uri string, name string, parent string, at string, requires array<string>, conflicts array<string>, note string",
    )
    made = ids.change_id(*[F.col(c) for c in ("project", "uri", "name", "parent")], F.lit("Ada Lovelace"), F.lit("ada@example.com"), *[F.col(c) for c in ("at", "requires", "conflicts", "note")])
    assert [r.id for r in df.select("i", made.alias("id")).orderBy("i").collect()] == [want for _, want in GOLDEN]


TEXT = """%syntax-version=1.0.0
%project = shop
%uri=https://x.org/

one 2024-01-01T00:00:00Z Dmitry,U,, <d@dev># Init
two [one !bad other:x :y] 2024-01-02T00:00:00Z Ann B  <a@x>#  a\\tb\\\\nc\\n
@v1 2024-01-03T00:00:00Z Ann <a@x> # first
@v1b 2024-01-03T00:00:01Z Ann <a@x>

# remark
two [two@v1] 2024-01-04T00:00:00Z  Ann\t<a@x>
"""


def test_parse_plan(spark):
    changes, tags, pragmas = P.parse_plans(spark.createDataFrame([("p", TEXT), ("empty", "%project=e\n")], "plan string, text string"))
    got = changes.orderBy("pos").collect()
    assert [(c.name, c.requires, c.conflicts, c.planner_name, c.planner_email, c.note) for c in got] == [
        ("one", [], [], "Dmitry,U,,", "d@dev", "Init"),
        ("two", ["one", "other:x", "y"], ["bad"], "Ann B ", "a@x", "a\tb\\nc\n"),
        ("two", ["two@v1"], [], "Ann", "a@x", ""),
    ]
    content = "project shop\nuri https://x.org/\nchange one\nplanner Dmitry,U,, <d@dev>\ndate 2024-01-01T00:00:00Z\n\nInit"
    assert got[0].change_id == hashlib.sha1(f"change {len(content)}\0{content}".encode()).hexdigest()
    assert [c.parent for c in got] == [None, got[0].change_id, got[1].change_id]
    assert {(t.tag, t.change_id) for t in tags.collect()} == {("v1", got[1].change_id), ("v1b", got[1].change_id)}
    assert {(r.key, r.value) for r in pragmas.where("plan = 'p'").collect()} == {("syntax-version", "1.0.0"), ("project", "shop"), ("uri", "https://x.org/")}


def test_chain_in_chunks_equals_one_chunk(spark):
    rows = [("p" if i % 3 else "q", i, f"c{i}") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "plan string, pos long, name string").withColumns({
        "project": F.lit("x"), "uri": F.lit(None).cast("string"), "planner_name": F.lit("n"), "planner_email": F.lit("e"), "planned_at": F.lit("d"),
        "requires": F.array().cast("array<string>"), "conflicts": F.array().cast("array<string>"), "note": F.lit(""),
    })
    whole = {r.pos: (r.change_id, r.parent) for r in P.chain_build(df).collect()}
    parts = P.chain_build(df, chunk=4)
    assert {r.pos: (r.change_id, r.parent) for r in parts.collect()} == whole and len(whole) == 59
    assert P.recompute_ids(parts).where("computed_id <> change_id").count() == 0


def test_read_plans_from_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.plan").write_text(TEXT.replace("shop", f"shop{n}"))
    changes, tags, _ = P.read_plans(spark, str(tmp_path))
    assert changes.count() == 9 and tags.count() == 6 and changes.select("change_id").distinct().count() == 9


def test_plan_files_round_trip(spark, tmp_path):
    many = "%project=m\n" + "".join(f"c{i} [c{i - 1}] 2024-01-01T00:00:{i % 60:02}Z Ann <a@x> # n{i}\n" for i in range(1, 400))
    texts = spark.createDataFrame([("007", TEXT), ("a/b c=%", TEXT.replace("shop", "other")), ("m", many), ("empty", "%project=e\n")], "plan string, text string")
    rows = P.plan_rows(texts)
    P.write_plans(rows, str(tmp_path / "out"))
    back = P.read_written_plans(spark, str(tmp_path / "out"))
    assert back.count() == 4
    got, want = ([tuple(r) for r in P.plan_rows(t).orderBy("plan", "pos").collect()] for t in (back, texts))
    assert got == want and len(want) == 2 * 8 + 400 + 1
    assert {r.text for r in back.where("plan = 'm'").collect()} == {many}
    # an empty table writes no file
    P.write_plans(rows.where("false"), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("plan=*"))


@pytest.mark.parametrize("field, value, word", [
    ("name", "'a[b'", "hold"), ("name", "'@a'", "hold"), ("name", "'a\\nb'", "hold"), ("planner_name", "'A <b'", "hold"), ("planner_email", "null", "hold"),
    ("note", "' x'", "hold"), ("planned_at", "'today'", "hold"), ("requires", "array('a b')", "hold"), ("conflicts", "array('x]')", "hold"), ("pos", "1", "free line"), ("pos", "0", "free line"),
])
def test_rows_that_no_plan_line_holds(spark, tmp_path, field, value, word):
    rows = P.plan_rows(spark.createDataFrame([("p", TEXT)], "plan string, text string"))
    broken = rows.withColumn(field, F.when((F.col("name") == "one"), F.expr(value)).otherwise(F.col(field)))
    with pytest.raises(Exception, match=word):
        P.write_plans(broken, str(tmp_path / "out"))


FILES = "path string, ts long, sql string"
SCRIPTS = "id int, path string, planned_at long, sql string"


def test_includes(spark):
    files = [("lib/a.sql", 10, "a10"), ("lib/a.sql", 20, "a20\n\\ir sub/b.sql"), ("lib/sub/b.sql", 5, "b5"), ("root.sql", 50, "r50")]
    scripts = [
        (1, "deploy/x.sql", 15, "\\ir ../lib/a.sql\nend"), (2, "deploy/y.sql", 30, "\\ir '../lib/a.sql';"), (3, "deploy/z.sql", 1, "\\i root.sql"),
        (4, "deploy/n.sql", 9, "SELECT 1"), (5, "deploy/c.sql", 9, "/* \n\\i root.sql\n*/\n-- \\i root.sql\n/* x */ \\i no\nSELECT '\\i no'"),
    ]
    got = {r.id: r.sql for r in I.expand_includes(spark.createDataFrame(scripts, SCRIPTS), spark.createDataFrame(files, FILES)).collect()}
    begin, end = "-- [snapshot] begin include: ", "-- [snapshot] end include: "
    assert got == {
        1: f"{begin}../lib/a.sql\na10\n{end}../lib/a.sql\nend",
        2: f"{begin}../lib/a.sql\na20\n{begin}sub/b.sql\nb5\n{end}sub/b.sql\n{end}../lib/a.sql",
        3: f"{begin}root.sql\nr50\n{end}root.sql",
    }


def test_included_files_and_newest_versions(spark):
    files = [("lib/a.sql", 10, "a10\n\\ir b.sql"), ("lib/a.sql", 20, "a20"), ("lib/b.sql", 5, "b5"), ("lib/b.sql", 40, "b40"), ("c.sql", 1, "\\i missing.sql"), ("c.sql", 2, "c2")]
    scripts = [(1, "x.sql", 15, "\\i lib/a.sql\n-- mid\n\\i c.sql\n\\i lib/b.sql"), (2, "y.sql", 30, "\\i lib/a.sql"), (3, "z.sql", 1, "SELECT 1")]
    args = spark.createDataFrame(scripts, SCRIPTS), spark.createDataFrame(files, FILES)
    got = sorted((r.id, r.ord, r.path, r.version, r.depth) for r in I.included_files(*args).collect())
    assert got == [(1, [1], "lib/a.sql", 10, 1), (1, [1, 2], "lib/b.sql", 5, 2), (1, [3], "c.sql", 2, 1), (1, [4], "lib/b.sql", 5, 1), (2, [1], "lib/a.sql", 20, 1)]
    newest = {r.id: r.sql.split("\n") for r in I.expand_includes(*args, snapshot=False).collect()}
    assert [x for x in newest[1] if not x.startswith("-- [")] == ["a20", "-- mid", "c2", "b40"] and newest[2][1] == "a20" and 3 not in newest
    assert I.included_files(args[0].where("id = 3"), args[1]).count() == 0


@pytest.mark.parametrize("files, word", [([("a.sql", 1, "\\i b.sql"), ("b.sql", 1, "\\i a.sql")], "includes itself"), ([("other.sql", 1, "x")], "not found")])
def test_include_errors(spark, files, word):
    scripts = spark.createDataFrame([(1, "x.sql", 5, "\\i a.sql")], SCRIPTS)
    with pytest.raises(Exception, match=word):
        I.expand_includes(scripts, spark.createDataFrame(files, FILES)).collect()


def test_long_plan_is_one_pass(spark, tmp_path, monkeypatch):
    """A plan of many chunks is walked in one job, whatever its length: no table per chunk."""
    written = []
    own = P.cut
    monkeypatch.setattr(P, "cut", lambda df, *by: written.append(1) or own(df, *by))
    rows = spark.range(1, 30_001).select(F.lit("p").alias("plan"), F.col("id").alias("pos"), F.concat(F.lit("c"), "id").alias("name")).withColumns({
        "project": F.lit("x"), "uri": F.lit(None).cast("string"), "planner_name": F.lit("n"), "planner_email": F.lit("e"), "planned_at": F.lit("d"),
        "requires": F.array().cast("array<string>"), "conflicts": F.array().cast("array<string>"), "note": F.lit("é")})
    out = P.chain_build(rows)
    assert len(written) == 1 and out.count() == 30_000 and P.recompute_ids(out).where("computed_id <> change_id").count() == 0
    assert out.where("parent is null").count() == 1


def test_plan_files_are_read_by_line(spark, tmp_path):
    """Blocks of one file are numbered on; the last pragma counts; carriage returns and blank lines are kept apart."""
    body = "%syntax-version=1.0.0\r\n%project=old\n\n# remark\n" + "".join(f"c{i} [c{i - 1}] 2024-01-01T00:00:00Z Ann <a@x> # n{i}\n" for i in range(1, 4000)) + "%project = new\n%uri=u"
    (tmp_path / "a.plan").write_text(body)
    (tmp_path / "empty.plan").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted(tuple(r)[1:] for r in P.read_plan_rows(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted(tuple(r)[1:] for r in P.plan_rows(P.read_plan_texts(spark, str(tmp_path))).collect())
    assert got == want and len(got) == 3999 + 4 and {r[0] for r in got} == {"new"}
