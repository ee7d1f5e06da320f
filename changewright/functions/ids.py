"""Change, tag and script identifiers as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def _listed(title: str, bullet: str, deps: Column) -> Column:
    lines = F.transform(deps, lambda d: F.concat(F.lit(f"  {bullet} "), d))
    return F.when(F.size(deps) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(lines, "\n")))


def _planner(name: Column, email: Column) -> Column:
    return F.concat(F.lit("planner "), name, F.lit(" <"), email, F.lit(">"))


def _note(note: Column) -> Column:
    return F.when(_present(note), F.concat(F.lit("\n"), note))


def change_parts(
    project: Column,
    uri: Column,
    name: Column,
    planner_name: Column,
    planner_email: Column,
    planned_at: Column,
    requires: Column,
    conflicts: Column,
    note: Column,
) -> tuple[Column, Column]:
    """Text of a change before and after its parent line; absent parts are nulls, which ``concat_ws`` skips."""
    before = F.concat_ws(
        "\n",
        F.concat(F.lit("project "), project),
        F.when(_present(uri), F.concat(F.lit("uri "), uri)),
        F.concat(F.lit("change "), name),
    )
    after = F.concat_ws(
        "\n",
        _planner(planner_name, planner_email),
        F.concat(F.lit("date "), planned_at),
        _listed("requires", "+", requires),
        _listed("conflicts", "-", conflicts),
        _note(note),
    )
    return before, after


def parent_line(parent: Column) -> Column:
    return F.when(_present(parent), F.concat(F.lit("parent "), parent))


def change_content(
    project: Column,
    uri: Column,
    name: Column,
    parent: Column,
    planner_name: Column,
    planner_email: Column,
    planned_at: Column,
    requires: Column,
    conflicts: Column,
    note: Column,
) -> Column:
    """Text that identifies a change."""
    before, after = change_parts(project, uri, name, planner_name, planner_email, planned_at, requires, conflicts, note)
    return F.concat_ws("\n", before, parent_line(parent), after)


def tag_content(
    project: Column,
    uri: Column,
    tag: Column,
    change_id: Column,
    planner_name: Column,
    planner_email: Column,
    planned_at: Column,
    note: Column,
) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("project "), project),
        F.when(_present(uri), F.concat(F.lit("uri "), uri)),
        F.concat(F.lit("tag @"), tag),
        F.concat(F.lit("change "), change_id),
        _planner(planner_name, planner_email),
        F.concat(F.lit("date "), planned_at),
        _note(note),
    )


def object_id(kind: str, content: Column) -> Column:
    """sha1 of ``<kind> <byte length>``, a NUL byte and the content."""
    header = F.concat(F.lit(f"{kind} "), F.octet_length(content).cast("string"))
    return F.sha1(F.concat(header.cast("binary"), F.lit(b"\x00"), content.cast("binary")))


def change_id(*parts: Column) -> Column:
    return object_id("change", change_content(*parts))


def tag_id(*parts: Column) -> Column:
    return object_id("tag", tag_content(*parts))


def script_hash(content: Column) -> Column:
    return F.sha1(content.cast("binary"))


def fingerprint(rule: Column, path: Column, line: Column) -> Column:
    return F.sha1(F.concat_ws(":", rule, path, line.cast("string")).cast("binary"))
