"""SQL script text as columns: masking, splitting, names.

Everything here is one expression per script row: no shuffle, no Python.
Comments, literals and function bodies become blanks of the same length, so
lines and columns stay those of the source.  Positions are carried through the
split as marks (line:column between two control characters) instead of running
sums, so long scripts stay linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE, _HIDDEN = "\x01", "\x02", "\x03"
_ID = r"(?:\"[^\"]+\"|[\w$\x80-\uffff]+)"
NAME = rf"{_ID}(?:\.{_ID})*"
_METACOMMAND = r"^\\(?:[a-zA-Z_]|!(?:\w|\s|$))"

# First words of the statements a script may hold.
COMMANDS = (
    "ABORT", "ALTER", "ANALYZE", "ANALYSE", "BEGIN", "CALL", "CHECKPOINT", "CLOSE", "CLUSTER", "COMMENT", "COMMIT",
    "COPY", "CREATE", "DEALLOCATE", "DECLARE", "DELETE", "DISCARD", "DO", "DROP", "END", "EXECUTE", "EXPLAIN",
    "FETCH", "GRANT", "IMPORT", "INSERT", "LISTEN", "LOAD", "LOCK", "MERGE", "MOVE", "NOTIFY", "PREPARE", "REASSIGN",
    "REFRESH", "REINDEX", "RELEASE", "RESET", "REVOKE", "ROLLBACK", "SAVEPOINT", "SECURITY", "SELECT", "SET", "SHOW",
    "START", "TABLE", "TRUNCATE", "UNLISTEN", "UPDATE", "VACUUM", "VALUES", "WITH",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value, so that ``body`` uses it without repeating it."""
    return F.transform(F.array(value), body)[0]


def _comment(depth: int) -> str:
    inner = "" if depth == 0 else "|" + _comment(depth - 1)
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*){inner})*+\*/"


def _parens(depth: int) -> str:
    inner = r"[^()]++" if depth == 0 else r"[^()]++|" + _parens(depth - 1)
    return rf"\((?:{inner})*+\)"


# Comments of the usual depth are one token; a deeper one leaves its mark and the script is lexed by a fold.
# Possessive loops throughout: a literal of many megabytes must not recurse.
_TOKEN = "(?s)" + "|".join((
    r"--[^\n]*+",
    _comment(3),
    r"(?<=(?<!\w)[eE])'[^'\\]*+(?:\\.[^'\\]*+)*+'",
    r"'[^']*+'",
    r'"[^"]*+"',
    r"(?<![\w$])\$((?:[A-Za-z_]\w*)?)\$.*?\$\1\$",
    r"[^'\"$/-]++",
    r".",
))
#: Parentheses of the usual depth in one match; what is deeper is left over and goes through a fold that counts.
PARENS = _parens(5)
_ITEM = rf"(?:[^,()]++|{PARENS})++"


def is_metacommand(line: Column) -> Column:
    return F.ltrim(line).rlike(_METACOMMAND)


def mask_metacommands(sql: Column) -> Column:
    """Client commands (``\\set``, ``\\i``, ``\\!``...) become blank lines of the same length."""
    lines = F.split(sql, "\n")
    return F.array_join(F.transform(lines, lambda l: F.when(is_metacommand(l), F.repeat(F.lit(" "), F.length(l))).otherwise(l)), "\n")


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def _mask_token(tok: Column) -> Column:
    head, size = F.substring(tok, 1, 1), F.length(tok)
    inside = F.concat(head, _blank(F.substr(tok, F.lit(2), size - 2)), F.right(tok, F.lit(1)))
    return (
        F.when(size < 2, tok)
        .when(F.substring(tok, 1, 2).isin("--", "/*"), _blank(tok))
        .when(head.isin("'", "$"), inside)
        .when(head == '"', F.translate(tok, ";,()", "____"))
        .otherwise(tok)
    )


#: Pieces at which the lexer may change its state.
_PIECE = r"(?s)--|/\*|\*/|\n|\\.|['\"]|\$(?:[A-Za-z_]\w*)?\$|[^-/*\n\\'\"$]++|."


def _lexed(clean: Column) -> Column:
    """``mask`` by a fold over pieces that carries quote and comment depth, for comments of any depth.

    The text so far is copied with every piece, so this is for scripts that the token pattern leaves over.  Null if
    a comment stays open.
    """
    start = F.struct(F.lit("").alias("mode"), F.lit(0).alias("depth"), F.lit("").alias("last"), F.lit("").alias("out"))

    def step(a: Column, p: Column) -> Column:
        mode, depth, last = a["mode"], a["depth"], a["last"]
        code, nested = mode == "", mode == "/*"
        dollar = (F.length(p) > 1) & p.startswith("$") & p.endswith("$")
        escaped = last.rlike(r"(?:^|\W)[eE]$")
        # in a plain literal a backslash is a character, so the piece behind it may hold the closing quote
        shuts = ((mode == "'") & p.endswith("'")) | ((mode == "E") & (p == "'")) | ((mode == '"') & p.endswith('"')) | (mode.startswith("$") & (p == mode)) | ((mode == "--") & (p == "\n"))
        opens = F.when(p == "--", "--").when(p == "/*", "/*").when((p == "'") & escaped, "E").when(p == "'", "'").when(p == '"', '"').when(dollar & ~last.rlike(r"[\w$]$"), p)
        inner = F.when(p == "/*", depth + 1).when(p == "*/", depth - 1).otherwise(depth)
        next_mode = F.when(code, F.coalesce(opens, F.lit(""))).when(nested, F.when(inner > 0, "/*").otherwise("")).when(shuts, "").otherwise(mode)
        next_depth = F.when(code, F.when(p == "/*", 1).otherwise(0)).when(nested, inner).otherwise(0)
        blank = _blank(p)
        opened = F.when(opens.isin("--", "/*"), blank).when(opens.startswith("$"), F.concat(F.lit("$"), _blank(F.substr(p, F.lit(2))))).otherwise(p)
        closed = F.when(mode.startswith("$"), F.concat(_blank(F.substr(p, F.lit(2))), F.lit("$"))).when(mode == "--", p).otherwise(F.concat(_blank(F.substr(p, F.lit(1), F.length(p) - 1)), F.right(p, F.lit(1))))
        quoted = F.translate(p, ";,()", "____")
        text = F.when(code, F.when(opens.isNotNull(), opened).otherwise(p)).when(mode == '"', quoted).when(shuts, closed).otherwise(blank)
        return F.struct(next_mode.alias("mode"), next_depth.alias("depth"), p.alias("last"), F.concat(a["out"], text).alias("out"))

    return F.aggregate(F.regexp_extract_all(clean, F.lit(_PIECE), 0), start, step, lambda a: F.when(a["mode"] != "/*", a["out"]))


def mask(sql: Column) -> Column:
    """Blank comments, literals and bodies; length and line breaks are kept."""
    clean = F.translate(mask_metacommands(sql), _OPEN + _CLOSE + _HIDDEN, "   ")

    def checked(masked: Column) -> Column:
        return F.when(masked.contains("/*"), F.coalesce(_lexed(clean), masked)).otherwise(masked)

    tokens = F.regexp_extract_all(clean, F.lit(_TOKEN), 0)
    return let(F.array_join(F.transform(tokens, _mask_token), ""), checked)


#: Pieces at which the depth of a statement may change.
_NESTING = r"(?is)\"[^\"]*+\"|\bBEGIN\s+ATOMIC\b|[\w$]++|[();]|[^\w$();\"]++|."


def _hide_inner_ends(masked: Column) -> Column:
    """Semicolons inside parentheses or a ``BEGIN ATOMIC`` body become a mark: they end no statement."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("body"), F.lit("").alias("out"))

    def step(a: Column, p: Column) -> Column:
        word, body = F.upper(p), a["body"]
        inside = (a["depth"] > 0) | (body > 0)
        return F.struct(
            F.when(p == "(", a["depth"] + 1).when(p == ")", F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"]).alias("depth"),
            F.when(word.startswith("BEGIN") & (F.length(p) > 5), F.when(word.rlike(r"^BEGIN\s"), body + 1).otherwise(body))
            .when((body > 0) & (word == "CASE"), body + 1).when((body > 0) & (word == "END"), body - 1).otherwise(body).alias("body"),
            F.concat(a["out"], F.when((p == ";") & inside, _HIDDEN).otherwise(p)).alias("out"),
        )

    # text that never closes is a parse error anyhow and is split at every semicolon
    closed = lambda a: F.when((a["depth"] == 0) & (a["body"] == 0), a["out"]).otherwise(masked)
    folded = F.aggregate(F.regexp_extract_all(masked, F.lit(_NESTING), 0), start, step, closed)

    def ends(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(";")))

    def needed(outer: Column) -> Column:
        return F.when(outer.contains("(") | (ends(outer) != ends(masked)), folded).otherwise(masked)

    nested = F.when(masked.contains("("), let(F.regexp_replace(masked, PARENS, ""), needed)).otherwise(masked)
    return F.when(~masked.contains(";"), masked).when(masked.rlike(r"(?i)\bBEGIN\s+ATOMIC\b"), folded).otherwise(nested)


def _mark(line: Column, column: Column) -> Column:
    return F.concat(F.lit(_OPEN), line.cast("string"), F.lit(":"), column.cast("string"), F.lit(_CLOSE))


#: Parts whose offsets are summed up in one go: of a line with n parts, n / BLOCK sums are carried on.
BLOCK = 128


def part_columns(parts: Column) -> Column:
    """1-based column of each part of a line that was split at one character: prefix sums, by blocks."""
    def block(b: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, p: F.struct((a["at"] + F.length(p) + 1).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), start, step)

    def joined(blocks: Column) -> Column:
        firsts = F.aggregate(blocks, F.array(F.lit(1)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(firsts, F.lit(1), F.size(blocks)), lambda b, first: F.transform(b["out"], lambda x: x + first)))

    return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), block), joined)


def _marked_line(line: Column, index: Column) -> Column:
    def segments(parts: Column) -> Column:
        return F.array_join(F.zip_with(parts, part_columns(parts), lambda part, at: F.concat(_mark(index + 1, at), part)), ";")

    # where nothing but blanks stands behind a semicolon, the mark of the next line is the one that counts
    plain = F.concat(F.lit(_OPEN), (index + 1).cast("string"), F.lit(":1" + _CLOSE), line)
    return F.when(line.contains(";") & line.rlike(r";[^;]*?[^\s;]"), let(F.split(line, ";"), segments)).otherwise(plain)


def split_statements(masked: Column) -> Column:
    """Array of ``(line, column, stmt)``: position of the first visible character, text on one line."""
    marked = F.array_join(F.transform(F.split(_hide_inner_ends(masked), "\n"), _marked_line), "\n")
    # The mark before the first visible character, with the blanks behind it.
    first = rf"(?s)^.*?{_OPEN}(\d+:\d+{_CLOSE}[ \t\r\f]*+)[^\s{_OPEN}]"

    def one(chunk: Column) -> Column:
        def placed(mark: Column) -> Column:
            column = F.substring_index(F.substring_index(mark, _CLOSE, 1), ":", -1).try_cast("int")
            return F.struct(
                F.substring_index(mark, ":", 1).try_cast("int").alias("line"),
                (column + F.length(F.substring_index(mark, _CLOSE, -1))).alias("column"),
                F.translate(F.trim(F.regexp_replace(chunk, rf"(?:{_OPEN}[^{_CLOSE}]*+{_CLOSE}|\s++)+", " ")), _HIDDEN, ";").alias("stmt"),
            )

        return let(F.regexp_extract(chunk, first, 1), placed)

    chunks = F.filter(F.split(marked, ";"), lambda c: c.rlike(rf"{_CLOSE}\s*+[^\s{_OPEN}]"))
    return F.transform(chunks, one)


def is_unparsable(masked: Column, statements: Column) -> Column:
    """Open literal, comment or parenthesis, or a statement that starts with no known command."""
    def without(text: Column, sign: str) -> Column:
        return F.length(F.replace(text, F.lit(sign), F.lit("")))

    open_text = masked.contains("/*") | ((F.length(masked) - without(masked, "'")) % 2 == 1) | ((F.length(masked) - without(masked, '"')) % 2 == 1)

    def broken(s: Column) -> Column:
        text = s["stmt"]
        unbalanced = (text.contains("(") | text.contains(")")) & (without(text, "(") != without(text, ")"))
        return unbalanced | ~F.upper(F.regexp_extract(text, r"^\(*\s*(\w*)", 1)).isin(*COMMANDS)

    return open_text | F.exists(statements, broken)


def location_line(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substr(text, F.lit(1), offset), "\n"))


def location_column(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based character offset."""
    return F.length(F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1)) + 1


def _nested(text: Column, inside: Callable[[Column], Column], edge: Callable[[Column, Column], Column]) -> Column:
    """Fold over parentheses and what lies between: ``inside`` maps text at depth 1 and more, ``edge`` a parenthesis."""
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("out"))

    def step(a: Column, p: Column) -> Column:
        d = F.when(p == "(", a["d"] + 1).when(p == ")", F.greatest(a["d"] - 1, F.lit(0))).otherwise(a["d"])
        outer = F.when(p == "(", a["d"] == 0).otherwise(d == 0)
        return F.struct(d.alias("d"), F.concat(a["out"], F.when(p.isin("(", ")"), edge(p, outer)).when(a["d"] > 0, inside(p)).otherwise(p)).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(r"[()]|[^()]++"), 0), start, step, lambda a: a["out"])


def flatten_parens(stmt: Column) -> Column:
    """Every parenthesis at depth 0 becomes ``()``, whatever it holds."""
    def checked(once: Column) -> Column:
        deep = F.replace(once, F.lit("()")).contains("(")
        return F.when(deep, _nested(stmt, lambda p: F.lit(""), lambda p, outer: F.when(outer, p).otherwise(""))).otherwise(once)

    return F.when(stmt.contains("("), let(F.regexp_replace(stmt, PARENS, "()"), checked)).otherwise(stmt)


def top_level_items(text: Column) -> Column:
    """Comma-separated parts; commas inside parentheses of any depth do not split."""
    items = F.regexp_extract_all(text, F.lit(_ITEM), 0)
    kept = _nested(text, lambda p: F.translate(p, ",", _HIDDEN), lambda p, outer: p)
    apart = F.filter(F.transform(F.split(kept, ","), lambda i: F.translate(i, _HIDDEN, ",")), lambda i: i != "")
    deep = text.contains("(") & F.regexp_replace(text, PARENS, "").contains("(")
    return F.transform(F.when(deep, apart).otherwise(items), lambda i: F.trim(i))


def full_name(name: Column) -> Column:
    """``schema.name`` as stored: folded to lower case unless quoted."""
    parts = F.regexp_extract_all(name, F.lit(_ID), 0)
    folded = F.transform(parts, lambda p: F.when(p.startswith('"'), F.regexp_replace(p, '"', "")).otherwise(F.lower(p)))
    return F.array_join(folded, ".")


def last_name(name: Column) -> Column:
    """Name without its schema."""
    return F.regexp_replace(full_name(name), r"^.*\.", "")


def name_list(text: Column) -> Column:
    """``a, s.b CASCADE`` as ``a, s.b``."""
    heads = F.transform(F.split(text, ","), lambda n: F.regexp_extract(F.trim(n), rf"(?i)^(?:ONLY )?({NAME})", 1))
    return F.array_join(F.transform(F.filter(heads, lambda h: h != ""), full_name), ", ")


# The same three as SQL text, for rules.


def full_name_sql(name: str) -> str:
    folded = "p -> if(startswith(p, '\"'), replace(p, '\"', ''), lower(p))"
    return f"array_join(transform(regexp_extract_all({name}, r'{_ID}', 0), {folded}), '.')"


def last_name_sql(name: str) -> str:
    return rf"regexp_replace({full_name_sql(name)}, r'^.*\.', '')"


def name_list_sql(text: str) -> str:
    heads = f"transform(split({text}, ','), n -> regexp_extract(trim(n), r'(?i)^(?:ONLY )?({NAME})', 1))"
    return f"array_join(transform(filter({heads}, h -> h <> ''), h -> {full_name_sql('h')}), ', ')"
