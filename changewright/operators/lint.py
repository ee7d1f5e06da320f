"""Script audit: suppression comments, severities and the whole check of a corpus.

A script is one row and everything about it is computed inside that row, so
the audit reads the corpus once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.functions import sqltext as T
from changewright.operators.rules import FINDING_ARRAY, RuleSet, default_rules, dml_table_column, findings_column, items_column, parsed
from changewright.session import cut

# Fixed values: ``-- <tool>:disable A,B`` and its end; any tool name is accepted.
ACTIONS = ("disable", "enable")
_NO_TXN = r"(?i)--\s*[\w-]+:no-transaction"
_NEVER = 2**31 - 1
_RANGE_ARRAY = "array<struct<ord:int,rule:string,from_line:int,to_line:int,closed:boolean>>"


@dataclass(frozen=True)
class LintConfig:
    """``severity`` maps a rule to error, warn, info or off."""

    version: int = 14
    skip: Sequence[str] = ()
    severity: Mapping[str, str] = field(default_factory=dict)
    error_on_warn: bool = False
    max_affected_rows: int = 10_000


# -- statements --------------------------------------------------------------


def _rows(df: DataFrame, column: str) -> DataFrame:
    """Explode an array of findings.

    The outer form, then a filter: from the inner form Spark infers
    ``size(array) > 0`` and pushes it down, which computes the array twice.
    """
    return df.select("path", F.explode_outer(column).alias("f")).where("f is not null").select("path", "f.*")


def _with_statements(scripts: DataFrame) -> DataFrame:
    masked = scripts.withColumn("_masked", T.mask(F.col("sql")))
    return masked.withColumn("_split", T.split_statements(F.col("_masked")))


def statements(scripts: DataFrame) -> DataFrame:
    """One row per statement: number, position, masked text."""
    rows = _with_statements(scripts).select("path", F.posexplode_outer("_split").alias("i", "s")).where("s is not null")
    return rows.select("path", (F.col("i") + 1).alias("stmt_no"), "s.line", "s.column", "s.stmt")


def alter_actions(scripts: DataFrame) -> DataFrame:
    """One row per ALTER TABLE action."""
    rows = _with_statements(scripts).select("path", F.posexplode_outer(F.transform("_split", parsed)).alias("i", "s")).where("s is not null")
    rows = rows.select("path", (F.col("i") + 1).alias("stmt_no"), F.col("s.table").alias("table"), F.posexplode("s.actions").alias("n", "action"))
    return rows.withColumn("action_no", F.col("n") + 1).drop("n")


# -- suppression -------------------------------------------------------------


def directives_column(sql: Column) -> Column:
    """Array of (line, action, rules, inline) for the suppression comments of a script.

    ``inline``: a disable behind a statement, which covers its own line only.
    """

    def parts(comment: Column) -> Column:
        words = F.split(F.ltrim(comment, F.lit(" \t\r\f")), r"\s+", 2)
        mark = F.split(words[0], ":")
        rules = F.regexp_extract(F.get(words, F.lit(1)), r"^[\w,\s]+", 0)
        fits = (F.size(mark) == 2) & mark[0].rlike(r"^[\w-]+$") & F.get(mark, F.lit(1)).isin(*ACTIONS) & (rules != "")
        return F.struct(F.coalesce(fits, F.lit(False)).alias("is"), F.get(mark, F.lit(1)).alias("action"), rules.alias("rules"))

    def one(line: Column, i: Column) -> Column:
        pieces = F.split(line, "--")
        comment = F.get(F.filter(F.transform(F.slice(pieces, 2, F.size(pieces)), parts), lambda c: c["is"]), F.lit(0))
        ids = F.transform(F.split(comment["rules"], ","), lambda r: F.trim(F.regexp_replace(r, r"\s+", " ")))
        before = F.trim(F.regexp_replace(pieces[0], r"\s", " "))
        return F.struct(
            (i + 1).alias("line"),
            F.coalesce(comment["action"], F.lit("")).alias("action"),
            F.filter(ids, lambda r: r != "").alias("rules"),
            ((comment["action"] == "disable") & (before != "")).alias("inline"),
        )

    marked = F.transform(F.split(sql, "\n"), one)
    maybe = sql.contains(":disable") | sql.contains(":enable")
    return F.when(maybe, F.filter(marked, lambda d: d["action"] != "")).otherwise(
        F.array().cast("array<struct<line:int,action:string,rules:array<string>,inline:boolean>>")
    )


def ranges_column(directives: Column, total_lines: Column) -> Column:
    """Array of (ord, rule, from_line, to_line, closed) in the order the ranges end.

    A block ends at the next enable of its rule; if another disable comes
    first, that one takes its place; without an enable it runs to the end.
    """
    valid = F.filter(directives, lambda d: ~F.array_contains(d["rules"], "all"))

    def single(d: Column) -> Column:
        def one(rule: Column, j: Column) -> Column:
            return _range(d["line"], j, rule, d["line"], d["line"], F.lit(True))

        return F.transform(d["rules"], one)

    def events(d: Column) -> Column:
        def one(rule: Column, j: Column) -> Column:
            return F.struct(rule.alias("rule"), d["line"].alias("line"), j.alias("j"), d["action"].alias("action"))

        return F.transform(F.array_distinct(d["rules"]), one)

    singles = F.flatten(F.transform(F.filter(valid, lambda d: d["inline"]), single))
    blocks = F.array_sort(F.flatten(F.transform(F.filter(valid, lambda d: ~d["inline"]), events)))

    def closed(all_blocks: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            nxt = F.get(all_blocks, i + 1)
            same = F.coalesce(nxt["rule"] == b["rule"], F.lit(False))
            shut = same & F.coalesce(nxt["action"] == "enable", F.lit(False))
            return (
                F.when(b["action"] != "disable", F.lit(None))
                .when(shut, _range(nxt["line"], nxt["j"], b["rule"], b["line"], nxt["line"], F.lit(True)))
                .when(~same, _range(F.lit(_NEVER), b["j"], b["rule"], b["line"], total_lines, F.lit(False)))
            )

        return F.array_compact(F.transform(all_blocks, one))

    ends = F.array_sort(F.concat(singles, T.let(blocks, closed)))

    def numbered(r: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("ord"), *[r[f].alias(f) for f in ("rule", "from_line", "to_line", "closed")])

    return F.transform(ends, numbered)


def _range(end: Column, j: Column, rule: Column, lo: Column, hi: Column, closed: Column) -> Column:
    return F.struct(
        end.alias("end"), j.alias("j"), rule.alias("rule"), lo.alias("from_line"), hi.alias("to_line"), closed.alias("closed")
    )


def _total_lines(sql: Column) -> Column:
    return F.size(F.split(sql, "\n"))


def directives(scripts: DataFrame) -> DataFrame:
    return scripts.select("path", F.explode(directives_column(F.col("sql"))).alias("d")).select("path", "d.*")


def suppression_ranges(scripts: DataFrame) -> DataFrame:
    found = scripts.select("path", "sql", directives_column(F.col("sql")).alias("_d")).where(F.size("_d") > 0)
    rows = found.select("path", F.explode(ranges_column(F.col("_d"), _total_lines(F.col("sql")))).alias("r"))
    return rows.select("path", "r.*")


def apply_suppressions(findings: DataFrame, ranges: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """Findings with ``suppressed`` and the ``ord`` of the range that did it.

    File-level skips (path, rule) go first and use no range.  The join is on
    (path, rule), so line conditions are only tried inside one script.
    """
    rows = findings
    if skips is not None:
        rows = rows.join(skips.select("path", "rule").distinct().withColumn("_skip", F.lit(True)), ["path", "rule"], "left")
    else:
        rows = rows.withColumn("_skip", F.lit(None).cast("boolean"))
    r = ranges.select(F.col("path").alias("_path"), F.col("rule").alias("_rule"), "from_line", "to_line", "ord")
    inside = (F.col("path") == F.col("_path")) & (F.col("rule") == F.col("_rule"))
    inside = inside & F.col("_skip").isNull() & F.col("line").between(F.col("from_line"), F.col("to_line"))
    matched = rows.join(r, inside, "left")
    out = matched.groupBy(*findings.columns, "_skip").agg(F.min("ord").alias("ord"))
    return out.withColumn("suppressed", F.col("_skip").isNotNull() | F.col("ord").isNotNull()).drop("_skip")


def _warning(line: Column, message: Column) -> Column:
    return F.struct(
        F.lit("suppression").alias("rule"), F.lit("warn").alias("severity"), message.alias("message"),
        F.lit(None).cast("string").alias("suggestion"), F.lit(0).alias("stmt_no"), F.lit(0).alias("action_no"),
        line.alias("line"), F.lit(1).alias("column"),
    )


def _directive_warnings(directives_: Column, ranges: Column, known: Iterable[str]) -> Column:
    ids = F.array(*[F.lit(k) for k in known])

    def unknown(d: Column) -> Column:
        bad = F.filter(d["rules"], lambda r: ~F.array_contains(ids, r))
        return F.transform(bad, lambda r: _warning(d["line"], F.concat(F.lit('Unknown rule "'), r, F.lit('" in a suppression comment.'))))

    everything = F.filter(directives_, lambda d: F.array_contains(d["rules"], "all"))
    refused = F.transform(everything, lambda d: _warning(d["line"], F.lit('"all" cannot be suppressed; name each rule.')))
    still_open = F.filter(ranges, lambda r: ~r["closed"])
    unclosed = F.transform(
        still_open, lambda r: _warning(r["from_line"], F.concat(F.lit('Suppression of "'), r["rule"], F.lit('" is never closed and runs to the end of the file.')))
    )
    return F.concat(F.flatten(F.transform(directives_, unknown)), refused, unclosed)


def _unused_warnings(ranges: Column) -> Column:
    return F.transform(ranges, lambda r: _warning(r["from_line"], F.concat(F.lit('Unused suppression of "'), r["rule"], F.lit('".'))))


def suppression_warnings(scripts: DataFrame, used: DataFrame, known: Iterable[str]) -> DataFrame:
    """Unknown, refused, unclosed and unused suppressions; ``used`` lists (path, ord) that hid a finding."""
    base = scripts.select("path", "sql", directives_column(F.col("sql")).alias("_d")).where(F.size("_d") > 0)
    base = base.withColumn("_r", ranges_column(F.col("_d"), _total_lines(F.col("sql"))))
    # one pass: what is told in any case has no range, so the join below keeps it
    told = F.transform(_directive_warnings(F.col("_d"), F.col("_r"), known), lambda w: F.struct(w.alias("w"), F.lit(None).cast("int").alias("ord")))
    idle = F.zip_with(_unused_warnings(F.col("_r")), F.col("_r"), lambda w, r: F.struct(w.alias("w"), r["ord"].alias("ord")))
    rows = base.select("path", F.explode(F.concat(told, idle)).alias("x")).select("path", "x.*")
    return rows.join(used.select("path", "ord"), ["path", "ord"], "left_anti").select("path", "w.*")


# -- severity ----------------------------------------------------------------


def _severity(rule: Column, severity: Column, config: LintConfig) -> Column:
    out = severity
    for rule_id, level in config.severity.items():
        out = F.when(rule == rule_id, F.lit(level)).otherwise(out)
    if config.error_on_warn:
        out = F.when(out == "warn", "error").otherwise(out)
    return out


def apply_severity(findings: DataFrame, config: LintConfig) -> DataFrame:
    """Skipped and ``off`` rules vanish, others get their level; warnings rise last."""
    rows = findings.where(~F.col("rule").isin(*config.skip)) if config.skip else findings
    rows = rows.withColumn("severity", _severity(F.col("rule"), F.col("severity"), config))
    return rows.where("severity <> 'off'")


# -- composition -------------------------------------------------------------


def _active_rules(rules: RuleSet, config: LintConfig) -> RuleSet:
    off = [r for r, level in config.severity.items() if level == "off"]
    return rules.without([*config.skip, *off])


def findings(scripts: DataFrame, rules: RuleSet | None = None, version: int = 14) -> DataFrame:
    """Raw findings of the static and hybrid rules, before suppression and configuration."""
    rules = default_rules(version) if rules is None else rules
    found = _found(scripts, [r for r in rules if r.kind != "connected"])
    return _rows(found, "_found")


def _found(scripts: DataFrame, rules: list) -> DataFrame:
    parse_error = F.array(F.struct(
        F.lit("parse-error").alias("rule"), F.lit("error").alias("severity"), F.lit("The script cannot be parsed.").alias("message"),
        F.lit(None).cast("string").alias("suggestion"), F.lit(0).alias("stmt_no"), F.lit(0).alias("action_no"),
        F.lit(1).alias("line"), F.lit(1).alias("column"),
    )).cast(FINDING_ARRAY)
    rows = _with_statements(scripts)
    rows = rows.withColumn("_broken", T.is_unparsable(F.col("_masked"), F.col("_split")))
    rows = rows.withColumn("_parsed", F.transform("_split", parsed))
    rows = rows.withColumn("_items", items_column(F.col("_parsed"), F.col("kind"), F.col("sql").rlike(_NO_TXN)))
    return rows.withColumn("_found", F.when(F.col("_broken"), parse_error).otherwise(findings_column("_items", rules)))


def _first_match(finding: Column, ranges: Column) -> Column:
    hit = F.filter(ranges, lambda r: (r["rule"] == finding["rule"]) & finding["line"].between(r["from_line"], r["to_line"]))
    return F.get(hit, F.lit(0))["ord"]


def lint(
    scripts: DataFrame,
    config: LintConfig = LintConfig(),
    rules: RuleSet | None = None,
    skips: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Findings of a corpus ``(path, kind, sql)`` after suppression and configuration.

    ``skips`` (path, rule) are per-file exemptions.  ``stats`` (table_name,
    rows) turns on the rules that need the database.  The corpus is read once
    in either case.
    """
    rules = default_rules(config.version) if rules is None else rules
    known = rules.ids()
    active = _active_rules(rules, config)
    static = [r for r in active if r.kind != "connected"]
    connected = [r for r in active if r.kind == "connected"] if stats is not None else []
    if skips is not None:
        per_file = skips.groupBy("path").agg(F.collect_set("rule").alias("_skips"))
        scripts = scripts.join(per_file, "path", "left")
    else:
        scripts = scripts.withColumn("_skips", F.lit(None).cast("array<string>"))
    scripts = scripts.withColumn("_skips", F.coalesce("_skips", F.array().cast("array<string>")))
    seen = F.exists(F.split("sql", "\n"), lambda l: l.rlike(r"\S") & ~T.is_metacommand(l))
    visible = scripts.where(F.when(F.col("sql").contains("\\"), seen).otherwise(F.col("sql").rlike(r"\S")))

    rows = _settled(visible, static, connected, known)
    out = _with_sizes(rows, [r.id for r in connected], stats, config.max_affected_rows) if connected else _rows(rows, "_all")
    ours = F.col("rule") == "suppression"
    level = F.when(ours, F.col("severity")).otherwise(_severity(F.col("rule"), F.col("severity"), config))
    return out.withColumn("severity", level)


def _settled(scripts: DataFrame, static: list, connected: list, known: list[str]) -> DataFrame:
    """Rows with ``_all``, what the rules that need no table sizes say in the end, and all findings and ranges."""
    ids = F.array(*[F.lit(r.id) for r in connected]).cast("array<string>")
    rows = _found(scripts, static + connected).withColumn("_d", directives_column(F.col("sql")))
    # most scripts have no suppression comment: nothing is matched for them
    told = F.size("_d") > 0
    rows = rows.withColumn("_r", F.when(told, ranges_column(F.col("_d"), _total_lines(F.col("sql")))).otherwise(F.array().cast(_RANGE_ARRAY)))
    open_to = F.col("_found")
    if connected:
        open_to = F.filter(open_to, lambda f: ~F.array_contains(ids, f["rule"]))
    open_to = F.when(F.size("_skips") > 0, F.filter(open_to, lambda f: ~F.array_contains(F.col("_skips"), f["rule"]))).otherwise(open_to)
    rows = rows.withColumn("_open", open_to)
    rows = rows.withColumn("_matched", F.when(told, F.transform("_open", lambda f: F.struct(f.alias("f"), _first_match(f, F.col("_r")).alias("ord")))))
    kept = F.transform(F.filter("_matched", lambda m: m["ord"].isNull()), lambda m: m["f"])
    used = F.transform("_matched", lambda m: m["ord"])
    idle = F.filter("_r", lambda r: ~F.array_contains(F.array_compact(used), r["ord"]) & ~F.array_contains(ids, r["rule"]))
    warnings = F.concat(_directive_warnings(F.col("_d"), F.col("_r"), known), _unused_warnings(idle)).cast(FINDING_ARRAY)
    return rows.withColumn("_all", F.when(F.col("_broken"), F.col("_found")).when(~told, F.col("_open")).otherwise(F.concat(kept.cast(FINDING_ARRAY), warnings)))


#: What a row of the stream behind ``_with_sizes`` is: settled, a finding that depends on a table's size, a range.
_SETTLED, _CANDIDATE, _RANGE = 0, 1, 2


def _with_sizes(rows: DataFrame, ids: list[str], stats: DataFrame, threshold: int) -> DataFrame:
    """Findings once table sizes are known, in one pass over the corpus.

    A script gives settled findings, candidates and suppression ranges of the rules in ``ids`` side by side.  Candidates
    meet the large tables in one join; all other rows are dealt over its tasks by their path.  A range and the candidates
    that it suppresses then meet in one group: if a candidate is there the range was used, else it is reported; all other
    rows are groups of their own.
    """
    named = F.array(*[F.lit(i) for i in ids])
    none, no_table = F.lit(None).cast("int"), F.lit(None).cast("string")

    def item(tag: int, f: Column, table: Column, ord_: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), f.alias("f"), table.alias("table"), ord_.cast("int").alias("ord"))

    empty = F.array().cast(FINDING_ARRAY)
    ours = F.filter("_found", lambda f: F.array_contains(named, f["rule"]) & ~F.array_contains(F.col("_skips"), f["rule"]))
    ours = F.when(F.col("_broken"), empty).otherwise(ours.cast(FINDING_ARRAY))
    candidates = F.transform(ours, lambda f: item(_CANDIDATE, f, dml_table_column(F.get("_parsed", f["stmt_no"] - 1)), _first_match(f, F.col("_r"))))
    idle = F.transform(F.filter("_r", lambda r: F.array_contains(named, r["rule"])), lambda r: F.struct(
        _warning(r["from_line"], F.concat(F.lit('Unused suppression of "'), r["rule"], F.lit('".'))).alias("f"), r["ord"].alias("ord")))
    ranges = F.zip_with(F.transform(idle, lambda x: x["f"]).cast(FINDING_ARRAY), F.transform(idle, lambda x: x["ord"]), lambda f, o: item(_RANGE, f, no_table, o))
    settled = F.transform(F.col("_all").cast(FINDING_ARRAY), lambda f: item(_SETTLED, f, no_table, none))
    stream = rows.select("path", F.explode_outer(F.concat(settled, candidates, ranges)).alias("_i")).where("_i is not null").select("path", "_i.*")
    large = cut(stats.where(F.col("rows") > threshold).select(F.col("table_name").alias("table"), F.lit(True).alias("_large")).distinct())
    candidate = F.col("tag") == _CANDIDATE
    # a null key would send every settled row to one task
    stream = stream.withColumn("table", F.when(candidate, F.col("table")).otherwise(F.concat(F.lit("\0"), "path")))
    stream = stream.join(large, "table", "left").where(~candidate | F.col("_large"))
    ranged = F.col("ord").isNotNull()
    alone = F.when(~ranged, F.monotonically_increasing_id())
    groups = stream.withColumn("_alone", alone).groupBy("path", "ord", "_alone").agg(
        F.bool_or(candidate).alias("used"), F.first(F.when(~ranged | (F.col("tag") == _RANGE), F.col("f")), ignorenulls=True).alias("f"))
    return groups.where("f is not null and (ord is null or not used)").select("path", "f.*")


# -- summaries ---------------------------------------------------------------


def _levels() -> dict[str, Column]:
    names = {"errors": "error", "warnings": "warn", "info": "info"}
    return {n: F.count_if(F.col("severity") == s) for n, s in names.items()}


def finding_summary(findings_: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return findings_.groupBy(*by).agg(*[c.alias(n) for n, c in _levels().items()])


def review_risk(findings_: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Any error is high, any warning medium, else low; with counts and files."""
    out = findings_.groupBy(*by).agg(*[c.alias(n) for n, c in _levels().items()], F.countDistinct("path").alias("files"))
    return out.withColumn("risk", F.when(F.col("errors") > 0, "high").when(F.col("warnings") > 0, "medium").otherwise("low"))


def lint_verdict(findings_: DataFrame, strict: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Exit code: 2 on an error, with ``strict`` also on a warning."""
    bad = F.col("severity").isin("error", "warn") if strict else F.col("severity") == "error"
    return findings_.groupBy(*by).agg(F.when(F.count_if(bad) > 0, 2).otherwise(0).alias("code"))


def metacommand_report(scripts: DataFrame) -> DataFrame:
    """Client command lines per script."""
    lines = F.transform(F.split("sql", "\n"), lambda l, i: F.struct((i + 1).alias("line"), F.ltrim(l).alias("text")))
    found = F.filter(lines, lambda l: T.is_metacommand(l["text"]))
    return scripts.select("path", found.alias("lines")).where(F.size("lines") > 0).withColumn("count", F.size("lines"))
