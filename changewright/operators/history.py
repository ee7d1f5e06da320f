"""Change history: plans against what is deployed, across many databases.

A change belongs to ``KEYS`` (target database, project).  ``pos`` is its place
in the plan: unique and ascending within the keys, gaps allowed.  Every step
keeps rows apart by key *and* slice (see ``ordered``), so one project may hold
any share of the fleet's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.functions.names import base_name, pair_base, phase_of
from changewright.operators import ordered
from changewright.session import cut

KEYS = ("target", "project")


def _refuse(bad: DataFrame, message: str) -> None:
    """Stop if there is any bad row.

    An action, not an error expression in the plan: the optimizer may drop the
    rows that would raise before they are seen.
    """
    if not bad.isEmpty():
        raise ValueError(message)


# -- difference and status -------------------------------------------------


def pending(plan: DataFrame, deployed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Planned changes that are not deployed; ``pos`` keeps the plan order."""
    return plan.join(deployed.select(*keys, "change_id"), [*keys, "change_id"], "left_anti")


def diff_status(plan: DataFrame, deployed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    there = deployed.select(*keys, "change_id").distinct().withColumn("_there", F.lit(True))
    status = F.when(F.col("_there"), "deployed").otherwise("pending")
    return plan.join(there, [*keys, "change_id"], "left").withColumn("status", status).drop("_there")


def range_diff(
    plan: DataFrame,
    tags: DataFrame,
    from_tag: str,
    to_tag: str,
    deployed: DataFrame,
    keys: Sequence[str] = KEYS,
    strict: bool = True,
) -> DataFrame:
    """Changes after ``from_tag`` up to ``to_tag``.

    ``strict`` stops on a project where a tag is unknown or the order is
    reversed; otherwise such a project gives no rows.
    """
    at = tags.where(F.col("tag").isin(from_tag, to_tag)).join(
        plan.select(*keys, "change_id", F.col("pos").alias("_at")), [*keys, "change_id"]
    )
    bounds = at.groupBy(*keys).agg(
        F.min(F.when(F.col("tag") == from_tag, F.col("_at"))).alias("_lo"),
        F.min(F.when(F.col("tag") == to_tag, F.col("_at"))).alias("_hi"),
    )
    if strict:
        everything = plan.select(*keys).distinct().join(bounds, list(keys), "left")
        _refuse(everything.where("_lo is null or _hi is null"), f"tag {from_tag} or {to_tag} is not in the plan")
        _refuse(bounds.where("_lo > _hi"), f"tag {from_tag} comes after tag {to_tag}")
    inside = (F.col("pos") > F.col("_lo")) & (F.col("pos") <= F.col("_hi"))
    return diff_status(plan.join(bounds, list(keys)).where(inside).drop("_lo", "_hi"), deployed, keys)


def modified_scripts(
    plan: DataFrame, deployed: DataFrame, scripts: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Deployed changes whose script text differs from the deployed hash.

    ``plan`` carries ``script_name`` (see ``script_names``), so older versions
    of a reworked change are compared with their own file.
    """
    recorded = deployed.where("script_hash is not null").select(*keys, "change_id", F.col("script_hash").alias("deployed_hash"))
    current = scripts.select(*keys, "script_name", F.col("script_hash").alias("current_hash"))
    names = plan.select(*keys, "change_id", "name", "script_name")
    both = names.join(recorded, [*keys, "change_id"]).join(current, [*keys, "script_name"])
    return both.where("deployed_hash <> current_hash")


def status_rollup(
    plan: DataFrame,
    deployed: DataFrame,
    modified: DataFrame | None = None,
    operations: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per project: counts, last deployed change, modified scripts, open column changes.

    The names of pending changes stay rows (``pending_list``): a project may
    have too many of them for one cell.
    """
    marked = diff_status(plan, deployed, keys)
    waiting = marked.groupBy(*keys).agg(F.count_if(F.col("status") == "pending").alias("pending_count"))
    newest = F.max(F.struct("committed_at", "change_id", "name"))
    done = deployed.groupBy(*keys).agg(F.count(F.lit(1)).alias("deployed_count"), newest.alias("_last"))
    out = waiting.join(done, list(keys), "full")
    out = out.select(
        *keys,
        F.coalesce("deployed_count", F.lit(0)).alias("deployed_count"),
        F.coalesce("pending_count", F.lit(0)).alias("pending_count"),
        F.col("_last.name").alias("last_change"),
        F.col("_last.change_id").alias("last_change_id"),
        F.col("_last.committed_at").alias("last_committed_at"),
    )
    for extra, name in ((modified, "modified_count"), (operations, "open_operations")):
        if extra is not None:
            counted = extra.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
            out = out.join(counted, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def pending_list(plan: DataFrame, deployed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pending changes with their running number in plan order."""
    rows = cut(pending(plan, deployed, keys).select(*keys, "pos", "name", "change_id"))
    return ordered.unsliced(ordered.number(ordered.slice_by_position(rows, "pos"), keys, "seq"))


# -- dependencies ----------------------------------------------------------


def first_of_name(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First change of each name: the one a dependency refers to."""
    firsts = changes.groupBy(*keys, "name").agg(F.min(F.struct("pos", "change_id")).alias("_first"))
    return firsts.select(*keys, "name", F.col("_first.pos").alias("pos"), F.col("_first.change_id").alias("change_id"))


def _wanted(changes: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    rows = changes.select(*keys, "change_id", "name", "pos", F.explode(column).alias("dependency"))
    return rows.withColumn("base", base_name(F.col("dependency")))


def missing_dependencies(
    changes: DataFrame, deployed: DataFrame, keys: Sequence[str] = KEYS, across_projects: bool = False
) -> DataFrame:
    """Required names that are neither planned nor deployed.

    ``project:name`` never equals a plain name; ``across_projects`` looks it up
    in the named project of the same target instead.
    """
    known = changes.select(*keys, "name").unionByName(deployed.select(*keys, "name")).distinct()
    rows = _wanted(changes, "requires", keys)
    if across_projects:
        foreign = F.col("base").contains(":")
        rows = rows.withColumn("_project", F.when(foreign, F.substring_index("base", ":", 1)).otherwise(F.col("project")))
        rows = rows.withColumn("_base", F.substring_index("base", ":", -1))
        others = [k for k in keys if k != "project"]
        known = known.select(*others, F.col("project").alias("_project"), F.col("name").alias("_base"))
        return rows.join(known, [*others, "_project", "_base"], "left_anti").drop("_project", "_base")
    return rows.join(known.withColumnRenamed("name", "base"), [*keys, "base"], "left_anti")


def conflicts(changes: DataFrame, deployed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Changes whose declared conflict is deployed; a merely planned one is no conflict."""
    there = deployed.select(*keys, F.col("name").alias("base"))
    return _wanted(changes, "conflicts", keys).join(there, [*keys, "base"], "left_semi")


def resolve_dependencies(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dependency rows with the id of the first change of that name, or null."""
    both = F.concat(
        F.transform("requires", lambda d: F.struct(F.lit("require").alias("type"), d.alias("dependency"))),
        F.transform("conflicts", lambda d: F.struct(F.lit("conflict").alias("type"), d.alias("dependency"))),
    )
    rows = changes.select(*keys, "change_id", F.explode(both).alias("d")).select(*keys, "change_id", "d.*")
    rows = rows.withColumn("base", base_name(F.col("dependency")))
    firsts = first_of_name(changes, keys).select(*keys, F.col("name").alias("base"), F.col("change_id").alias("dependency_id"))
    return rows.join(firsts, [*keys, "base"], "left").drop("base")


def missing_scripts(plan: DataFrame, scripts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per distinct change name and kind: deploy/revert missing is an error, verify a warning."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("deploy", "revert", "verify")])).alias("kind")
    need = plan.select(*keys, "name").distinct().select(*keys, "name", kinds)
    lost = need.join(scripts.select(*keys, "name", "kind"), [*keys, "name", "kind"], "left_anti")
    return lost.withColumn("severity", F.when(F.col("kind") == "verify", "warn").otherwise("error"))


def contract_ready(
    pending_changes: DataFrame,
    deployed: DataFrame,
    operations: DataFrame,
    backfill: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Whether each pending contract change may run.

    Its expand change must be deployed.  If the column change is tracked and
    still expanding/expanded, its backfill must not be known as incomplete.
    """
    rows = pending_changes.where(phase_of(F.col("name")) == "contract").select(*keys, "change_id", "name")
    rows = rows.withColumn("base", pair_base(F.col("name")))
    expanded = deployed.where(phase_of(F.col("name")) == "expand")
    expanded = expanded.select(*keys, pair_base(F.col("name")).alias("base")).distinct().withColumn("_expanded", F.lit(True))
    latest = operations.groupBy(*keys, F.col("change_name").alias("base")).agg(F.max_by("phase", "started_at").alias("phase"))
    filled = backfill.select(*keys, F.col("change_name").alias("base"), "is_complete")
    out = rows
    for side in (expanded, latest, filled):
        out = out.join(side, [*keys, "base"], "left")
    unfilled = F.col("phase").isin("expanding", "expanded") & ~F.coalesce("is_complete", F.lit(True))
    reason = F.when(F.col("_expanded").isNull(), "expand not deployed").when(unfilled, "backfill not complete")
    return out.select(*keys, "change_id", "name", "base", reason.isNull().alias("ready"), reason.alias("reason"))


def reconcile(
    a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str], times: Sequence[str] = (), tolerance_s: float = 5.0
) -> DataFrame:
    """Row-by-row difference of two tables; ``times`` may differ by the tolerance."""
    left = a.select(*keys, F.struct(*compare, *times).alias("_a"))
    right = b.select(*keys, F.struct(*compare, *times).alias("_b"))
    both = left.join(right, list(keys), "full")
    bad = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in compare]
    for c in times:
        one, two = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        gap = F.abs(F.timestamp_diff("MICROSECOND", one, two))
        far = F.when(one.isNull() | two.isNull(), ~one.eqNullSafe(two)).otherwise(gap > int(tolerance_s * 1_000_000))
        bad.append(F.when(far, F.lit(c)))
    kind = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").otherwise("differs")
    fields = F.when(kind == "differs", F.array_compact(F.array(*bad))).otherwise(F.array().cast("array<string>"))
    out = both.select(*keys, kind.alias("difference"), fields.alias("fields"))
    return out.where((F.col("difference") != "differs") | (F.size("fields") > 0))


# -- tags and listings -----------------------------------------------------


def change_tags(tags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``@tag`` names of a change in plan order, as the event log stores them (one cell per change)."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "tag")))
    named = F.transform(listed, lambda t: F.concat(F.lit("@"), t["tag"]))
    return tags.groupBy(*keys, "change_id").agg(named.alias("tags"))


def plan_listing(changes: DataFrame, tags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    empty = F.array().cast("array<string>")
    rows = changes.select(*keys, "change_id", "pos", "name", "requires", "conflicts")
    return rows.join(change_tags(tags, keys), [*keys, "change_id"], "left").withColumn("tags", F.coalesce("tags", empty))


def filter_plan(
    changes: DataFrame, tags: DataFrame, tag: str | None = None, change: str | None = None, keys: Sequence[str] = KEYS
) -> tuple[DataFrame, DataFrame]:
    """Plan up to a tagged change and/or changes of one name; tags follow their changes."""
    if tag is not None:
        mark = tags.where(F.col("tag") == tag).join(changes.select(*keys, "change_id", F.col("pos").alias("_p")), [*keys, "change_id"])
        cutoff = mark.groupBy(*keys).agg(F.min("_p").alias("_cut"))
        changes = changes.join(cutoff, list(keys)).where("pos <= _cut").drop("_cut")
    if change is not None:
        changes = changes.where(F.col("name") == change)
    if tag is not None or change is not None:
        tags = tags.join(changes.select(*keys, "change_id"), [*keys, "change_id"], "left_semi")
    return changes, tags


def up_to_target(changes: DataFrame, name: str, keys: Sequence[str] = KEYS, strict: bool = True) -> DataFrame:
    """Plan up to the first change of ``name``; a project without it is an error, or empty if not ``strict``."""
    firsts = changes.groupBy(*keys).agg(F.min(F.when(F.col("name") == name, F.col("pos"))).alias("_cut"))
    if strict:
        _refuse(firsts.where("_cut is null"), f"change {name} is not in the plan")
    return changes.join(firsts, list(keys)).where("pos <= _cut").drop("_cut")


def find_change(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last change of each name."""
    last = changes.groupBy(*keys, "name").agg(F.max(F.struct("pos", "change_id")).alias("_l"))
    return last.select(*keys, "name", F.col("_l.pos").alias("pos"), F.col("_l.change_id").alias("change_id"))


def find_tag(tags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First tag of each name."""
    first = tags.groupBy(*keys, "tag").agg(F.min(F.struct("pos", "change_id")).alias("_f"))
    return first.select(*keys, "tag", F.col("_f.pos").alias("pos"), F.col("_f.change_id").alias("change_id"))


def record_tags(tags: DataFrame, changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tags as stored: ``@name`` with the change they mark, for deployed changes only."""
    known = changes.select(*keys, "change_id", F.col("name").alias("change"))
    rows = tags.select(*keys, "change_id", F.concat(F.lit("@"), F.col("tag")).alias("tag"))
    return rows.join(known, [*keys, "change_id"])


def events_query(
    events: DataFrame,
    project: str,
    event: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    reverse: bool = False,
    tie: str = "event_id",
    after: Sequence | None = None,
) -> DataFrame:
    """Log of one project, newest first unless ``reverse``.

    ``after`` is the (committed_at, tie) of the last row of the page before (``page_end``): a filter, so any page costs
    what the first one costs.  ``offset`` skips rows by their number in the order, counted in slices of a range sort.
    """
    rows = events.where(F.col("project") == project)
    if event is not None:
        rows = rows.where(F.col("event") == event)
    if after is not None:
        at, last = (F.lit(x) for x in after)
        at = at.cast(events.schema["committed_at"].dataType)
        beyond = (F.col("committed_at") > at, F.col(tie) > last) if reverse else (F.col("committed_at") < at, F.col(tie) < last)
        rows = rows.where(beyond[0] | ((F.col("committed_at") == at) & beyond[1]))
    by = [c.asc() if reverse else c.desc() for c in (F.col("committed_at"), F.col(tie))]
    if offset:
        numbered = ordered.number_by(rows, [], by, "_no")
        rows = numbered.where(F.col("_no") > offset).drop("_no") if limit is None else numbered.where(F.col("_no").between(offset + 1, offset + limit)).drop("_no")
    rows = rows.orderBy(*by)
    return rows if limit is None else rows.limit(limit)


def page_end(page: DataFrame, tie: str = "event_id", reverse: bool = False) -> tuple | None:
    """(committed_at, tie) of a page's last row, null if it has none: the ``after`` of the next page."""
    pick = F.max if reverse else F.min
    last = page.agg(pick(F.struct("committed_at", tie)).alias("e")).first()["e"]
    return None if last is None else tuple(last)


# -- order in the log and in the plan ---------------------------------------


def current_state(events: DataFrame, keys: Sequence[str] = KEYS, extra: Sequence[str] = ("name",)) -> DataFrame:
    """Fold the log: a change is deployed if its last deploy/revert event is a deploy.

    ``(change_id, committed_at)`` is unique, so two maxima decide.  They are
    plain numbers in a hash aggregate with map-side combine: a change with very
    many events costs nothing extra.
    """

    def last(kind: str) -> Column:
        return F.max(F.when(F.col("event") == kind, F.col("committed_at")))

    folded = events.where(F.col("event").isin("deploy", "revert")).groupBy(*keys, "change_id", *extra)
    folded = folded.agg(last("deploy").alias("committed_at"), last("revert").alias("_reverted"))
    alive = F.col("committed_at").isNotNull() & (F.col("_reverted").isNull() | (F.col("committed_at") > F.col("_reverted")))
    return folded.where(alive).drop("_reverted")


def in_deploy_order(deployed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Deployed changes (or tags) numbered by commit time; ``change_id`` breaks ties."""
    return ordered.number_by(deployed, keys, [F.col("committed_at"), F.col("change_id")], "seq")


def deployed_tags(tags: DataFrame, deployed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tags of deployed changes in commit order."""
    when = deployed.select(*keys, "change_id", "committed_at")
    rows = tags.select(*keys, "tag", "change_id").join(when, [*keys, "change_id"])
    return ordered.number_by(rows, keys, [F.col("committed_at"), F.col("tag")], "seq")


def last_deployed(deployed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    last = deployed.groupBy(*keys).agg(F.max(F.struct("committed_at", "change_id", "name")).alias("_l"))
    return last.select(*keys, "_l.change_id", "_l.name", "_l.committed_at")


def _log_place(deployed: DataFrame, names: Sequence[str | None], keys: Sequence[str]) -> DataFrame:
    """First (committed_at, change_id) of each given name per project, as ``_p0``, ``_p1``..."""
    place = F.struct("committed_at", "change_id")
    aggs = [F.min(F.when(F.col("name") == n, place)).alias(f"_p{i}") for i, n in enumerate(names) if n is not None]
    return deployed.groupBy(*keys).agg(*aggs)


def verify_range(
    deployed: DataFrame,
    from_change: str | None = None,
    to_change: str | None = None,
    keys: Sequence[str] = KEYS,
    strict: bool = True,
) -> DataFrame:
    """Deployed changes between two names, both included; a reversed range is empty."""
    if from_change is None and to_change is None:
        return deployed
    bounds = _log_place(deployed, [from_change, to_change], keys)
    here = F.struct("committed_at", "change_id")
    inside = F.lit(True)
    for i, name in enumerate((from_change, to_change)):
        if name is None:
            continue
        if strict:
            _refuse(bounds.where(f"_p{i} is null"), f"change {name} is not deployed")
        inside = inside & (here >= F.col("_p0") if i == 0 else here <= F.col("_p1"))
    return deployed.join(bounds, list(keys)).where(inside).drop("_p0", "_p1")


def revert_set(
    deployed: DataFrame, to_change: str | None = None, keys: Sequence[str] = KEYS, strict: bool = True
) -> DataFrame:
    """Changes to revert, last deployed first: all, or everything after the first ``to_change``."""
    rows = deployed
    if to_change is not None:
        bounds = _log_place(deployed, [to_change], keys)
        if strict:
            _refuse(bounds.where("_p0 is null"), f"change {to_change} is not deployed")
        rows = rows.join(bounds, list(keys)).where(F.struct("committed_at", "change_id") > F.col("_p0")).drop("_p0")
    return ordered.number_by(rows, keys, [F.col("committed_at").desc(), F.col("change_id").desc()], "seq")


def chain_check(plan: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Changes whose parent is not the change before them (the first must have none)."""
    sliced = ordered.slice_by_position(plan.select(*keys, "pos", "change_id", "name", "parent"), "pos")
    seen = ordered.unsliced(ordered.neighbour(sliced, keys, F.col("change_id"), "expected_parent", -1))
    return seen.where(~F.col("parent").eqNullSafe(F.col("expected_parent")))


def script_names(plan: DataFrame, tags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """File name of each change: older versions of a reworked name are ``name@tag``.

    The tag is the first one from that version up to, not including, the next
    version.  Two fills over the same slices replace a range join.
    """
    first_tag = tags.groupBy(*keys, "change_id").agg(F.min(F.struct("pos", "tag"))["tag"].alias("_tag"))
    rows = cut(plan.select(*keys, "pos", "change_id", "name").join(first_tag, [*keys, "change_id"], "left"))
    base = ordered.slice_by_position(rows, "pos")
    mark = F.when(F.col("_tag").isNotNull(), F.struct(F.col("pos").alias("at"), F.col("_tag").alias("tag")))
    rows = ordered.fill_up(base, keys, mark, "_next_tag")
    rows = ordered.neighbour(rows, [*keys, "name"], F.col("pos"), "_next_pos", 1, base)
    tagged = F.col("_next_pos").isNotNull() & (F.col("_next_tag.at") < F.col("_next_pos"))
    name = F.when(tagged, F.concat("name", F.lit("@"), F.col("_next_tag.tag"))).otherwise(F.col("name"))
    return rows.select(*keys, "change_id", "pos", "name", name.alias("script_name"))


def rework_ready(plan: DataFrame, tags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names that may be reworked: some tag marks their last version or a later change."""
    last = plan.groupBy(*keys, "name").agg(F.max("pos").alias("last_pos"))
    at = tags.select(*keys, "change_id").join(plan.select(*keys, "change_id", "pos"), [*keys, "change_id"])
    newest = at.groupBy(*keys).agg(F.max("pos").alias("_tagged"))
    ready = F.coalesce(F.col("_tagged") >= F.col("last_pos"), F.lit(False))
    return last.join(newest, list(keys), "left").withColumn("ready", ready).drop("_tagged")
