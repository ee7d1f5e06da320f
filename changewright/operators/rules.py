"""Safety rules over SQL statements, as column predicates.

A rule looks at one item ``i``: a statement, or one action of an ALTER TABLE.
Its condition and message are SQL text over the fields of ``i``.  All rules are
folded into one array expression per script, so any number of them is one pass
over the corpus and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from changewright.functions import sqltext as T

# Functions whose result differs per row or call.
VOLATILE = (
    "random", "gen_random_uuid", "clock_timestamp", "txid_current", "timeofday", "uuid_generate_v1", "uuid_generate_v1mc",
    "uuid_generate_v4", "statement_timestamp", "setseed", "nextval", "currval", "lastval",
)

_N = T.NAME
_ALTER_TABLE = rf"(?i)^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?({_N})(?: ?\*)? (.+)$"
_CREATE_INDEX = rf"(?i)^CREATE (?:UNIQUE )?INDEX (CONCURRENTLY )?(?:IF NOT EXISTS )?(?:({_N}) )?ON (?:ONLY )?({_N})"
_DROP = r"(?i)^DROP (TABLE|INDEX) (CONCURRENTLY )?(?:IF EXISTS )?(.+?)(?: (?:CASCADE|RESTRICT))?$"
_REINDEX = rf"(?i)^REINDEX (?:\(([^)]*)\) ?)?(INDEX|TABLE|SCHEMA|DATABASE|SYSTEM) (CONCURRENTLY )?({_N})?"
_DML = rf"(?i)^(?:WITH .*\(\) )?(UPDATE|DELETE)(?: FROM)? (?:ONLY )?({_N})"
_VACUUM_FULL = r"(?i)^VACUUM (?:FULL\b|\([^)]*\bFULL\b)"
_VACUUM_TABLES = r"(?i)^VACUUM (?:\([^)]*\) ?|(?:(?:FULL|FREEZE|VERBOSE|ANALYZE)\b ?)+)(.*)$"
_CLUSTER = rf"(?i)^CLUSTER (?:VERBOSE )?(?:\([^)]*\) ?)?(?:{_N} ON )?({_N})"
_LOCK = r"(?i)^LOCK (?:TABLE )?(.+?)(?: IN ([A-Z ]+?) MODE)?(?: NOWAIT)?$"
_TRUNCATE = r"(?i)^TRUNCATE (?:TABLE )?(.+?)(?: (?:RESTART|CONTINUE) IDENTITY)?(?: (?:CASCADE|RESTRICT))?$"
_RENAME_COLUMN = rf"(?i)^RENAME (?:COLUMN )?(?!TO |CONSTRAINT )({_N}) TO ({_N})$"
_RENAME_TABLE = rf"(?i)^RENAME TO ({_N})$"
_ADD_COLUMN = rf"(?i)^ADD (?:COLUMN |(?!CONSTRAINT |PRIMARY KEY|UNIQUE|FOREIGN KEY|CHECK|EXCLUDE))(?:IF NOT EXISTS )?({_N})"
_ALTER_COLUMN = rf"(?i)^ALTER (?:COLUMN )?(?!CONSTRAINT )({_N}) "
_CONSTRAINT = rf"(?i)^ADD (?:CONSTRAINT ({_N}) )?"
_DEFAULT = r"(?i)(?<!BY )\bDEFAULT\b"
_DEFAULT_TEXT = (
    r"(?i)(?<!BY )\bDEFAULT\b ?(.*?)(?= NOT NULL\b| NULL\b| CONSTRAINT\b| CHECK\b| UNIQUE\b| PRIMARY KEY\b| REFERENCES\b| GENERATED\b|$)"
)
_VOLATILE_CALL = r"(?i)\b(" + "|".join(VOLATILE) + r")\s*\("
_NOT_VALID = r"(?i)\bNOT VALID\b"


def _get(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


# -- items -------------------------------------------------------------------


def parsed(s: Column) -> Column:
    """Statement struct with what the rules need."""
    stmt = s["stmt"]
    none = F.array().cast("array<string>")

    # a lambda evaluates an expression wherever it stands, so verb and rest are named once
    def of_rest(verb: Column, rest: Column) -> Column:
        alter = rest != ""  # the pattern asks for one character at least
        moved = rest.rlike(r"(?i)^(?:RENAME|SET SCHEMA) ")
        return F.struct(
            s["line"].alias("line"),
            s["column"].alias("column"),
            stmt.alias("stmt"),
            verb.alias("verb"),
            F.when(verb.isin("UPDATE", "DELETE", "WITH"), T.flatten_parens(stmt)).otherwise("").alias("flat"),
            F.when(alter, T.full_name(_get(stmt, _ALTER_TABLE, 1))).alias("table"),
            rest.alias("rest"),
            F.when(alter & ~moved, T.top_level_items(rest)).otherwise(none).alias("actions"),
        )

    def of_verb(verb: Column) -> Column:
        alter = (verb == "ALTER") & ~stmt.rlike(r"(?i)^ALTER TABLE ALL IN TABLESPACE ")
        return T.let(F.when(alter, _get(stmt, _ALTER_TABLE, 2)).otherwise(""), lambda rest: of_rest(verb, rest))

    return T.let(F.upper(_get(stmt, r"^(\w+)")), of_verb)


def sets_timeout(s: Column) -> Column:
    return (s["verb"] == "SET") & s["stmt"].rlike(r"(?i)^SET (?:SESSION |LOCAL )?lock_timeout ?(?:=|TO ) ?(?!DEFAULT\b)")


def items_column(statements: Column, kind: Column, no_txn: Column) -> Column:
    """One struct per statement and ALTER TABLE action; action 0 stands for the statement."""
    timeout_at = F.array_position(F.transform(statements, sets_timeout), F.lit(True))
    return T.let(timeout_at, lambda at: _expand_items(statements, at, kind, no_txn))


def _expand_items(statements: Column, timeout_at: Column, kind: Column, no_txn: Column) -> Column:
    def expand(s: Column, i: Column) -> Column:
        def item(action: Column, n: Column) -> Column:
            return F.struct(
                (i + 1).alias("stmt_no"),
                n.alias("action_no"),
                action.alias("action"),
                F.when(action != "", F.upper(F.regexp_extract(action, r"^(\w*)", 1))).otherwise("").alias("action_verb"),
                F.when(action != "", T.flatten_parens(action)).otherwise("").alias("flat_action"),
                F.coalesce(F.regexp_replace(s["table"], r"^.*\.", ""), F.lit("unknown")).alias("relation"),
                ((timeout_at > 0) & (timeout_at <= i)).alias("timeout_set"),
                kind.alias("kind"),
                no_txn.alias("no_txn"),
                *[s[f].alias(f) for f in ("line", "column", "stmt", "verb", "flat", "table", "rest")],
            )

        return F.transform(F.concat(F.array(F.lit("")), s["actions"]), item)

    return F.flatten(F.transform(statements, expand))


# -- rules -------------------------------------------------------------------
#
# Fields of ``i``: stmt, verb, flat (parentheses emptied), table, relation,
# rest, action, action_verb, flat_action, kind, no_txn, timeout_set, line, column.


@dataclass(frozen=True)
class Rule:
    """``when`` and ``message`` are SQL text over ``i``; ``each`` is statement or action.

    ``verbs``: first words of the statements (actions) the rule looks at, so
    that others do not try it; empty means all.
    """

    id: str
    severity: str
    when: str
    message: str
    suggestion: str | None = None
    each: str = "statement"
    kind: str = "static"
    verbs: tuple[str, ...] = ()


class RuleSet:
    """Ordered rules; an id may be registered once."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self._rules: dict[str, Rule] = {}
        for rule in rules:
            self.register(rule)

    def register(self, rule: Rule) -> RuleSet:
        if rule.id in self._rules:
            raise ValueError(f"rule {rule.id} is already registered")
        self._rules[rule.id] = rule
        return self

    def ids(self) -> list[str]:
        return list(self._rules)

    def __iter__(self):
        return iter(self._rules.values())

    def without(self, ids: Iterable[str]) -> RuleSet:
        return RuleSet(r for r in self if r.id not in set(ids))


def _like(text: str, pattern: str) -> str:
    return f"({text} RLIKE r'{pattern}')"


def _part(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, r'{pattern}', {group})"


def _or(text: str, fallback: str) -> str:
    return f"coalesce(nullif({text}, ''), '{fallback}')"


def _name(text: str, pattern: str, group: int = 1, fallback: str = "unknown") -> str:
    return _or(T.last_name_sql(_part(text, pattern, group)), fallback)


def _say(*parts: str) -> str:
    """Message from alternating literal text and SQL: text, sql, text, ..."""
    return "concat(" + ", ".join(f"'{p}'" if n % 2 == 0 else p for n, p in enumerate(parts)) + ")"


_COLUMN = _name("i.action", _ADD_COLUMN)
_ALTERED = _name("i.action", _ALTER_COLUMN)
_ADDS_COLUMN = f"(i.action_verb = 'ADD' AND {_like('i.action', _ADD_COLUMN)})"
_ADDS_DEFAULT = _ADDS_COLUMN + " AND " + _like("i.flat_action", _DEFAULT)
_VOLATILE_NAME = f"lower({_part(_part('i.action', _DEFAULT_TEXT), _VOLATILE_CALL)})"
_CONSTRAINT_NAME = _name("i.action", _CONSTRAINT, 1, "unnamed")
_VALIDATES = f"NOT {_like('i.flat_action', _NOT_VALID)}"

_INDEX_NAME = _name("i.stmt", _CREATE_INDEX, 2, "unnamed")
_DROPPED = _or(T.name_list_sql(_part("i.stmt", _DROP, 3)), "unnamed")
_REINDEXED = _name("i.stmt", _REINDEX, 4)
_IS_DML = f"(i.verb IN ('UPDATE', 'DELETE', 'WITH') AND {_like('i.flat', _DML)})"
_DML_VERB = f"upper({_part('i.flat', _DML)})"
_DML_NAME = T.full_name_sql(_part("i.flat", _DML, 2))
_IS_VACUUM_FULL = f"(i.verb = 'VACUUM' AND {_like('i.stmt', _VACUUM_FULL)})"
_MOVED = _like("i.rest", r"(?i)^(?:RENAME|SET SCHEMA) ")
_OTHER_ALTER = r"(?i)^ALTER (?:INDEX|VIEW|MATERIALIZED VIEW|FOREIGN TABLE) (?:IF EXISTS )?"


def _create_index(concurrent: bool) -> str:
    sign = "<>" if concurrent else "="
    return f"(i.verb = 'CREATE' AND {_like('i.stmt', _CREATE_INDEX)} AND {_part('i.stmt', _CREATE_INDEX)} {sign} '')"


def _drop(what: str, concurrent: bool | None = None) -> str:
    flag = "" if concurrent is None else f" AND {_part('i.stmt', _DROP, 2)} {'<>' if concurrent else '='} ''"
    return f"(i.verb = 'DROP' AND upper({_part('i.stmt', _DROP)}) = '{what}'{flag})"


def _reindex(concurrent: bool) -> str:
    flag = f"({_part('i.stmt', _REINDEX, 3)} <> '' OR {_like(_part('i.stmt', _REINDEX), '(?i)CONCURRENTLY')})"
    return f"(i.verb = 'REINDEX' AND {_like('i.stmt', _REINDEX)} AND {'' if concurrent else 'NOT '}{flag})"


def _risky() -> str:
    """What a risky statement does, null for others."""
    other = f"({_like('i.stmt', _OTHER_ALTER)} AND NOT {_like('i.stmt', '(?i) (?:RENAME|SET SCHEMA|DEPENDS) ')})"
    named = f"coalesce(nullif(i.relation, 'unknown'), {T.last_name_sql(_part('i.stmt', _OTHER_ALTER + f'({_N})'))})"
    return f"""CASE
        WHEN i.verb = 'ALTER' AND ((i.table IS NOT NULL AND NOT {_MOVED}) OR {other}) THEN {_say('ALTER TABLE on "', named, '"')}
        WHEN {_drop('TABLE')} THEN 'DROP TABLE'
        WHEN {_drop('INDEX', False)} THEN 'DROP INDEX'
        WHEN {_create_index(False)} THEN 'CREATE INDEX'
        WHEN i.verb = 'TRUNCATE' THEN 'TRUNCATE'
        WHEN i.verb = 'CLUSTER' THEN 'CLUSTER'
        WHEN {_IS_VACUUM_FULL} THEN 'VACUUM FULL'
        WHEN {_reindex(False)} THEN 'REINDEX' END"""


_CONCURRENTLY_HINT = "Use CONCURRENTLY, outside a transaction."
_EXPAND_HINT = "Use expand/contract: add a new column, backfill in batches, switch over, drop the old one."
_VALIDATE_HINT = "Add it NOT VALID, then VALIDATE CONSTRAINT separately."


def default_rules(version: int = 14) -> RuleSet:
    """The 22 rules for a server version."""
    vacuumed = _or(T.name_list_sql(f"regexp_replace({_part('i.stmt', _VACUUM_TABLES)}, r'{T.PARENS}', '')"), "all tables")
    rewritten = f"if(i.verb = 'VACUUM', {vacuumed}, {_name('i.stmt', _CLUSTER)})"
    concurrent = f"""CASE i.verb
        WHEN 'CREATE' THEN {_say('CREATE INDEX CONCURRENTLY "', _INDEX_NAME, '"')}
        WHEN 'DROP' THEN {_say('DROP INDEX CONCURRENTLY ', _DROPPED)}
        ELSE {_say('REINDEX CONCURRENTLY "', _REINDEXED, '"')} END"""
    renamed = f"""if({_like('i.rest', _RENAME_TABLE)},
        {_say('Renaming table "', 'i.relation', '" to "', _name('i.rest', _RENAME_TABLE), '" breaks running code.')},
        {_say('Renaming column "', _name('i.rest', _RENAME_COLUMN), '" to "', _name('i.rest', _RENAME_COLUMN, 2), '" on table "', 'i.relation', '" breaks running code.')})"""
    using = f"if({_like('i.flat_action', '(?i) USING ')}, ' with USING rewrites the table', ' may rewrite the table')"
    key_columns = T.name_list_sql(_part("i.action", r"(?i)PRIMARY KEY ?\(([^)]*)\)"))
    fk_columns = T.name_list_sql(_part("i.action", r"(?i)FOREIGN KEY ?\(([^)]*)\)"))
    return RuleSet([
        Rule(
            "SA001", "error",
            f"{_ADDS_COLUMN} AND {_like('i.flat_action', '(?i)\\bNOT NULL\\b')} AND NOT {_like('i.flat_action', _DEFAULT)}",
            _say('NOT NULL column "', _COLUMN, '" without a DEFAULT fails on table "', "i.relation", '" if it has rows.'),
            "Give a DEFAULT, or add it nullable, backfill, then set NOT NULL.", "action", verbs=("ADD",),
        ),
        Rule(
            "SA002", "error", f"{_ADDS_DEFAULT} AND {_VOLATILE_NAME} <> ''",
            _say("Volatile default ", _VOLATILE_NAME, '() of column "', _COLUMN, '" rewrites table "', "i.relation", '".'),
            "Add the column without a default and backfill in batches.", "action", verbs=("ADD",),
        ),
        Rule(
            "SA002b", "warn", f"{str(version < 11).lower()} AND {_ADDS_DEFAULT} AND {_VOLATILE_NAME} = ''",
            _say('Default of column "', _COLUMN, '" rewrites table "', "i.relation", f'" before version 11 (target {version}).'),
            "Upgrade, or add the column without a default and backfill.", "action", verbs=("ADD",),
        ),
        Rule(
            "SA003", "error", "i.action_verb = 'ALTER' AND " + _like("i.action", _ALTER_COLUMN + r"(?:SET DATA )?TYPE "),
            _say('Changing the type of column "', _ALTERED, '" on table "', "i.relation", '"', using, " under an exclusive lock."),
            _EXPAND_HINT, "action", verbs=("ALTER",),
        ),
        Rule(
            "SA004", "warn", _create_index(False),
            _say('CREATE INDEX "', _INDEX_NAME, '" on "', _name("i.stmt", _CREATE_INDEX, 3), '" without CONCURRENTLY blocks writes.'),
            _CONCURRENTLY_HINT, verbs=("CREATE",),
        ),
        Rule(
            "SA005", "warn", _drop("INDEX", False),
            _say("DROP INDEX ", _DROPPED, " without CONCURRENTLY takes an exclusive lock."),
            _CONCURRENTLY_HINT, verbs=("DROP",),
        ),
        Rule(
            "SA006", "warn", "i.action_verb = 'DROP' AND " + _like("i.action", r"(?i)^DROP (?!CONSTRAINT )"),
            _say('Dropping column "', _name("i.action", rf"(?i)^DROP (?:COLUMN )?(?:IF EXISTS )?({_N})"), '" of table "', "i.relation", '" loses its data.'),
            "Back up first and make sure that no code reads the column.", "action", verbs=("DROP",),
        ),
        Rule(
            "SA007", "error", f"{_drop('TABLE')} AND coalesce(i.kind, 'deploy') <> 'revert'",
            _say("DROP TABLE ", _DROPPED, " loses its data."),
            "Drop tables in revert scripts only, with a backup.", verbs=("DROP",),
        ),
        Rule(
            "SA008", "warn", "i.verb = 'TRUNCATE'",
            _say("TRUNCATE of ", _or(T.name_list_sql(_part("i.stmt", _TRUNCATE)), "unknown"), " removes all rows under an exclusive lock."),
            "Use DELETE with a condition, or back up first.", verbs=("TRUNCATE",),
        ),
        Rule(
            "SA009", "warn", f"i.action_verb = 'ADD' AND {_like('i.action', f'(?i)^ADD (?:CONSTRAINT {_N} )?FOREIGN KEY')} AND {_VALIDATES}",
            _say('Foreign key "', _CONSTRAINT_NAME, '" on ', "i.relation", "(", fk_columns, ") to ",
                 _name("i.action", rf"(?i)REFERENCES ({_N})"), " without NOT VALID checks every row under a lock."),
            _VALIDATE_HINT, "action", "hybrid", verbs=("ADD",),
        ),
        Rule(
            "SA010", "warn", f"{_IS_DML} AND NOT {_like('i.flat', '(?i)\\bWHERE\\b')}",
            _say("", _DML_VERB, ' on "', T.last_name_sql(_part("i.flat", _DML, 2)), '" without WHERE hits all rows.'),
            "Add a WHERE clause, or suppress the rule if all rows are meant.", verbs=("UPDATE", "DELETE", "WITH"),
        ),
        Rule(
            "SA011", "warn", _IS_DML,
            _say("", _DML_VERB, ' on large table "', _DML_NAME, '".'),
            "Run it in batches.", kind="connected", verbs=("UPDATE", "DELETE", "WITH"),
        ),
        Rule(
            "SA012", "info", f"i.verb = 'ALTER' AND {_like('i.stmt', '(?i)^ALTER SEQUENCE .*\\bRESTART\\b')}",
            _say('Restarting sequence "', _name("i.stmt", rf"(?i)^ALTER SEQUENCE (?:IF EXISTS )?({_N})"), '" may repeat or reorder ids.'),
            "Make sure that no row uses the restarted values.", verbs=("ALTER",),
        ),
        Rule(
            "SA013", "warn", f"NOT i.timeout_set AND {_risky()} IS NOT NULL",
            _say("", _risky(), " without an earlier SET lock_timeout may wait for locks without end."),
            "Put SET lock_timeout before it.", verbs=("ALTER", "CREATE", "DROP", "TRUNCATE", "CLUSTER", "VACUUM", "REINDEX"),
        ),
        Rule(
            "SA014", "warn", f"{_IS_VACUUM_FULL} OR i.verb = 'CLUSTER'",
            _say("", "if(i.verb = 'VACUUM', 'VACUUM FULL', 'CLUSTER')", " of ", rewritten, " rewrites it under an exclusive lock."),
            "Use plain VACUUM or an online repack.", verbs=("VACUUM", "CLUSTER"),
        ),
        Rule(
            "SA015", "warn", f"i.rest <> '' AND ({_like('i.rest', _RENAME_TABLE)} OR {_like('i.rest', _RENAME_COLUMN)})", renamed,
            "Keep both names visible until all code has moved.", verbs=("ALTER",),
        ),
        Rule(
            "SA016", "error", f"i.action_verb = 'ADD' AND {_like('i.action', f'(?i)^ADD (?:CONSTRAINT {_N} )?CHECK\\b')} AND {_VALIDATES}",
            _say('CHECK "', _CONSTRAINT_NAME, '" on table "', "i.relation", '" without NOT VALID scans it under a lock.'),
            _VALIDATE_HINT, "action", verbs=("ADD",),
        ),
        Rule(
            "SA017", "warn", "i.action_verb = 'ALTER' AND " + _like("i.action", _ALTER_COLUMN + "SET NOT NULL"),
            _say('SET NOT NULL on column "', _ALTERED, '" of table "', "i.relation", '" scans the table.'),
            "Validate a CHECK (column IS NOT NULL) first.", "action", "hybrid", verbs=("ALTER",),
        ),
        Rule(
            "SA018", "warn",
            f"i.action_verb = 'ADD' AND {_like('i.action', f'(?i)^ADD (?:CONSTRAINT {_N} )?PRIMARY KEY')} AND NOT {_like('i.action', '(?i)PRIMARY KEY USING INDEX (?!TABLESPACE)')}",
            _say('PRIMARY KEY on "', "i.relation", '" (', key_columns, ") without USING INDEX builds the index under an exclusive lock."),
            "Build a unique index concurrently, then add the key USING INDEX.", "action", "hybrid", verbs=("ADD",),
        ),
        Rule(
            "SA019", "warn", _reindex(False),
            _say("REINDEX of ", f"lower({_part('i.stmt', _REINDEX, 2)})", ' "', _REINDEXED, '" without CONCURRENTLY takes an exclusive lock.'),
            _CONCURRENTLY_HINT, verbs=("REINDEX",),
        ),
        Rule(
            "SA020", "error", f"NOT i.no_txn AND ({_create_index(True)} OR {_drop('INDEX', True)} OR {_reindex(True)})",
            _say("", concurrent, " cannot run inside a transaction."),
            "Mark the script with a no-transaction comment.", verbs=("CREATE", "DROP", "REINDEX"),
        ),
        Rule(
            "SA021", "warn", "i.verb = 'LOCK'",
            _say("LOCK TABLE ", _or(T.name_list_sql(_part("i.stmt", _LOCK)), "unknown"), " in ", _or(f"upper({_part('i.stmt', _LOCK, 2)})", "ACCESS EXCLUSIVE"), " mode."),
            "Avoid explicit locks; if needed take the weakest mode with a lock_timeout.", verbs=("LOCK",),
        ),
    ])


def findings_column(items: str, rules: Iterable[Rule]) -> Column:
    """All findings of a script as one array; ``items`` names the column of ``items_column``."""
    rules = list(rules)
    nothing = f"CAST(array() AS {FINDING_ARRAY})"

    def hit(rule: Rule) -> str:
        hint = "null" if rule.suggestion is None else "'" + rule.suggestion.replace("'", r"\'") + "'"
        return f"""CASE WHEN {rule.when} THEN named_struct('rule', '{rule.id}', 'severity', '{rule.severity}',
            'message', {rule.message}, 'suggestion', {hint}, 'stmt_no', i.stmt_no, 'action_no', i.action_no,
            'line', i.line, 'column', i.column) END"""

    def hits(chosen: list[Rule]) -> str:
        return "array_compact(array(" + ", ".join(hit(r) for r in chosen) + "))" if chosen else nothing

    def branches(each: str, verb: str) -> str:
        """One branch per first word, holding the rules for it; other words try the general rules."""
        scoped = [r for r in rules if r.each == each]
        words = sorted({v for r in scoped for v in r.verbs})
        general = hits([r for r in scoped if not r.verbs])
        listed = " ".join(f"WHEN '{w}' THEN {hits([r for r in scoped if not r.verbs or w in r.verbs])}" for w in words)
        return f"CASE {verb} {listed} ELSE {general} END" if words else general

    per_item = f"if(i.action_no = 0, {branches('statement', 'i.verb')}, {branches('action', 'i.action_verb')})"
    return F.expr(f"flatten(transform({items}, i -> {per_item}))").cast(FINDING_ARRAY)


def dml_table_column(item: Column) -> Column:
    """Table of an UPDATE or DELETE with its schema."""
    return T.full_name(_get(T.flatten_parens(item["stmt"]), _DML, 2))


FINDING_ARRAY = (
    "array<struct<rule:string,severity:string,message:string,suggestion:string,"
    "stmt_no:int,action_no:int,line:int,column:int>>"
)
