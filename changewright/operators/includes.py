"""Include directives of scripts and their historic expansion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.functions.sqltext import let
from changewright.operators import ordered
from changewright.session import cut

# The words of an include line, relative to the root and to the including file.
FROM_ROOT, FROM_FILE = ("i", "include"), ("ir", "include_relative")
# A block comment that begins its line hides everything up to the line where it ends.
_CHUNK = r"(?m)^[ \t\r\f]*/(?=\*)(?s:.*?)(?:\*/[^\n]*+|\z)|[^\n]*+\n|[^\n]++"


def _visible_lines(sql: Column) -> Column:
    chunks = F.regexp_extract_all(sql, F.lit(_CHUNK), 0)
    blanked = F.transform(chunks, lambda c: F.when(c.rlike(r"^[ \t\r\f]*/\*"), F.regexp_replace(c, r"[^\n]", "")).otherwise(c))
    return F.split(F.array_join(blanked, ""), "\n")


def _clean_path(raw: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(raw), r";+$", ""))
    return F.regexp_replace(bare, r"^(['\"])(.*)\1$", "$2")


def directive_column(line: Column) -> Column:
    """(type, path) of an include line, null for other lines."""
    words = F.split(F.ltrim(line, F.lit(" \t")), r"\s+", 2)
    word, rest = F.substr(words[0], F.lit(2)), F.get(words, F.lit(1))
    kind = F.when(word.isin(*FROM_FILE), "ir").when(word.isin(*FROM_ROOT), "i")
    # cheap test first: most lines are no includes
    found = line.rlike(r"^[ \t]*\\i") & words[0].startswith("\\") & kind.isNotNull() & (F.coalesce(rest, F.lit("")) != "")
    return F.when(found, F.struct(kind.alias("type"), _clean_path(rest).alias("path")))


def normal_path(path: Column) -> Column:
    """Path without ``.``, empty and resolvable ``..`` parts."""
    start = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        pops = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when(pops, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((part == "..") & path.startswith("/"), acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    rooted = F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(rooted == "", ".").otherwise(rooted)


def include_path(type_: Column, path: Column, script: Column) -> Column:
    """``ir`` is relative to the including file, ``i`` to the root."""
    folder = F.regexp_replace(script, r"[^/]*$", "")
    return normal_path(F.when(type_ == "ir", F.concat(folder, path)).otherwise(path))


def include_directives(scripts: DataFrame) -> DataFrame:
    """One row per include: line, type, written path, resolved path."""
    def one(line: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("line"), directive_column(line).alias("d"))

    found = F.filter(F.transform(_visible_lines(F.col("sql")), one), lambda x: x["d"].isNotNull())
    rows = scripts.where(F.col("sql").rlike(r"(?m)^[ \t]*\\i")).select("path", F.explode_outer(found).alias("x")).where("x is not null")
    rows = rows.select("path", "x.line", "x.d.type", F.col("x.d.path").alias("written"))
    return rows.withColumn("include", include_path(F.col("type"), F.col("written"), F.col("path")))


def include_version_asof(
    includes: DataFrame, versions: DataFrame, version: str = "version", on: Sequence[str] = ("path",), at: str = "planned_at", ts: str = "ts"
) -> DataFrame:
    """Latest version of the file at or before the plan time, else the newest one.

    Both tables are stacked and filled down once, so a file that most scripts
    include costs a sort, not a product.
    """
    found = ordered.asof(includes, versions, on, at, ts, F.col(version), "_found")
    head = versions.groupBy(*on).agg(F.max_by(version, ts).alias("_head"))
    out = found.join(head, list(on), "left")
    return out.withColumn(version, F.coalesce("_found", "_head")).withColumn("from_head", F.col("_found").isNull()).drop("_found", "_head")


def _lines(df: DataFrame, sql: Column, script: Column, *carry: str, texts: bool = True) -> DataFrame:
    """(carry, line, text, written, path) for every line of ``sql``; path and written path of an include, else null.

    Without ``texts`` only the includes, without their text.  The generator is an outer one, see README.
    """
    def one(text: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), text.alias("text"))

    if texts:
        numbered = let(_visible_lines(sql), lambda v: F.transform(
            F.transform(F.split(sql, "\n"), one),
            lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"), directive_column(F.get(v, x["i"])).alias("d")),
        ))
    else:
        found = F.transform(_visible_lines(sql), lambda line, i: F.struct(i.alias("i"), F.lit(None).cast("string").alias("text"), directive_column(line).alias("d")))
        numbered = F.filter(found, lambda x: x["d"].isNotNull())
    rows = df.select(*carry, script.alias("_script"), F.explode_outer(numbered).alias("x")).where("x is not null")
    target = F.when(F.col("x.d").isNotNull(), include_path(F.col("x.d.type"), F.col("x.d.path"), F.col("_script")))
    return rows.select(*carry, (F.col("x.i") + 1).alias("line"), F.col("x.text").alias("text"), F.col("x.d.path").alias("written"), target.alias("path"))


_HAS_INCLUDE = r"(?m)^[ \t]*\\i"


def _file_times(first: DataFrame, versions: DataFrame) -> DataFrame:
    """Distinct (path, at) that scripts may need: those they include, and whatever any version of those includes.

    Steps over distinct pairs only; a pair that is there already is not followed again.
    """
    edges = _lines(versions.where(F.col("sql").rlike(_HAS_INCLUDE)), F.col("sql"), F.col("path"), "path", texts=False).toDF("file", "line", "text", "written", "path")
    edges = cut(edges.where("path is not null").select("file", "path").distinct())
    fresh = cut(first.select("path", "at").distinct())
    parts = [fresh]
    while not fresh.isEmpty():
        step = fresh.withColumnRenamed("path", "file").join(edges, "file").select("path", "at").distinct()
        fresh = cut(step.join(reduce(DataFrame.unionByName, parts), ["path", "at"], "left_anti"))
        parts.append(fresh)
    return reduce(DataFrame.unionByName, parts)


def _expansion(scripts: DataFrame, versions: DataFrame, max_depth: int | None, snapshot: bool, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lines (id, ord, text) of expanded scripts and their includes (id, ord, path, version, depth); without ``texts`` no lines."""
    start = scripts.where(F.col("sql").rlike(_HAS_INCLUDE)).select("id", F.col("planned_at").alias("at"), normal_path(F.col("path")).alias("own"), "path", "sql")
    rows = _lines(start, F.col("sql"), F.col("path"), "id", "at", "own", texts=texts)
    rows = cut(rows.select("id", "at", F.array("line").alias("ord"), F.array("own").alias("visited"), "text", "written", "path"))
    open_ = rows.where("path is not null")
    done = [rows.join(open_.select("id").distinct(), "id", "left_semi").where("path is null").select("id", "ord", "text")]
    pairs = _file_times(open_, versions)
    stamps = versions.select("path", "ts", F.col("ts").alias("version"))
    if snapshot:
        resolved = include_version_asof(pairs, stamps, "version", at="at").drop("from_head")
    else:
        resolved = pairs.join(versions.groupBy("path").agg(F.max("ts").alias("version")), "path", "left")
    resolved = cut(resolved)
    used = resolved.select("path", "version").distinct()
    files = versions.select("path", F.col("ts").alias("version"), "sql").join(used, ["path", "version"], "left_semi")
    files = cut(_lines(files, F.col("sql"), F.col("path"), "path", "version", texts=texts).toDF("file", "version", "line", "text", "written", "path"))
    includes = []
    depth = 0
    while not open_.isEmpty():
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"includes nest deeper than {max_depth} levels")
        loop = F.raise_error(F.concat(F.lit("file includes itself: "), F.col("path"))).cast("string")
        wanted = open_.withColumn("path", F.when(F.array_contains("visited", F.col("path")), loop).otherwise(F.col("path"))).drop("text")
        lost = F.raise_error(F.concat(F.lit("included file not found: "), F.col("path"))).cast(versions.schema["ts"].dataType)
        found = wanted.join(resolved, ["path", "at"], "left").withColumn("version", F.coalesce("version", lost))
        found = cut(found)
        includes.append(found.select("id", "ord", "path", "version", F.lit(depth).alias("depth")))
        for word, place in (("begin", F.lit(0)), ("end", F.lit(2**31 - 1))):
            done.append(found.select("id", F.concat("ord", F.array(place)).alias("ord"), F.concat(F.lit(f"-- [snapshot] {word} include: "), F.col("written")).alias("text")))
        inner = found.select("id", "at", F.col("path").alias("file"), "version", "ord", F.concat("visited", F.array("path")).alias("visited")).join(files, ["file", "version"])
        rows = cut(inner.select("id", "at", F.concat("ord", F.array("line")).alias("ord"), "visited", "text", "written", "path"))
        done.append(rows.where("path is null").select("id", "ord", "text"))
        open_ = rows.where("path is not null")
    if not includes:
        none = rows.where("false").select("id", "ord", "path", F.lit(None).cast(versions.schema["ts"].dataType).alias("version"), F.lit(0).alias("depth"))
        includes.append(none)
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, includes)


def expand_includes(scripts: DataFrame, versions: DataFrame, max_depth: int | None = None, snapshot: bool = True) -> DataFrame:
    """Full text of scripts that include files, each file as of the script's plan time (or its newest version, without ``snapshot``).

    ``scripts``: id, path, planned_at, sql.  ``versions``: path, ts, sql.  Versions are sorted once, against the distinct
    (file, time) pairs of all levels; every file version is parsed once; then one join per nesting level over the
    include lines.  A file that includes itself, a missing file or more than ``max_depth`` levels (if given) stop the
    query.  Scripts without includes give no row: they run as they are.
    """
    # One script's lines make one text cell again, as they did on input.
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return _expansion(scripts, versions, max_depth, snapshot)[0].groupBy("id").agg(F.array_join(lines, "\n").alias("sql"))


def included_files(scripts: DataFrame, versions: DataFrame, max_depth: int | None = None, snapshot: bool = True) -> DataFrame:
    """Files that each expanded script pulled in, one row per include in the order of the text: id, ord, path, version, depth."""
    return _expansion(scripts, versions, max_depth, snapshot, texts=False)[1]
