"""One query per operator, over whole tables, and the SQL that states its result where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changewright.llm.bpe import encode_documents
from changewright.llm.chat_format import format_chats, read_turns, unescape
from changewright.llm.common import table
from changewright.llm.decontaminate import contamination
from changewright.llm.language_id import identify_languages
from changewright.llm.line_dedup import line_decisions
from changewright.llm.multi_index import near_vectors
from changewright.llm.prefix_trie import conversation_trie
from changewright.llm.sentence_dedup import sentence_dedup
from changewright.llm.sharding import FACTOR, PRIME, SEED, SHARDS, round_keys, shard_digests
from changewright.llm.simhash import simhash_components
from changewright.llm.suffix_dedup import suffix_dedup
from changewright.llm.token_alignment import align_documents
from changewright.llm.url_reputation import judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def hex16(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


@query("op5_simhash")
def op5(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def _repeats(units: str, size: int, join: str, prefix: str) -> str:
    """Units per document, hashed by value; runs that are not the first of their kind; what stays."""
    return f"""WITH u AS (SELECT doc_id, text, {units} AS u FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(u) - {size - 2})) AS pos, u FROM u WHERE len(u) >= {size}),
r AS (SELECT doc_id, pos, [{prefix}] AS w FROM p),
f AS (SELECT w, min((doc_id, pos)) AS first FROM r WHERE len(list_filter(w, lambda x: x <> '')) > 0 GROUP BY w HAVING count(*) > 1),
l AS (SELECT doc_id, unnest(range(pos, pos + {size})) AS i FROM r JOIN f USING (w) WHERE (doc_id, pos) <> first),
c AS (SELECT DISTINCT doc_id, i FROM l),
e AS (SELECT doc_id, unnest(range(1, len(u) + 1)) AS i, unnest({join}) AS x FROM u),
k AS (SELECT e.doc_id, count(*) AS n, count(c.i) AS gone, {{kept}} AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY 1)
"""


_SPLIT = r"(?s).+?(?:[.!?{}][ \t\r\n]+|\n[ \t\r\n]*|\z)"
_COUNT = r"len(regexp_extract_all({}, '[^ \t\r\n]+'))"


@query("op8_sentence_spans", f"""WITH s AS (SELECT doc_id, text, flatten(list_transform(regexp_extract_all(text, '{_SPLIT.format("")}'),
  lambda x: CASE WHEN {_COUNT.format("x")} > 12 THEN regexp_extract_all(x, '{_SPLIT.format(",;:")}') ELSE [x] END)) AS x FROM documents),
u AS (SELECT doc_id, text, x, list_transform(x, lambda y: rtrim(y, chr(32) || chr(9) || chr(13) || chr(10))) AS u, list_transform(x, lambda y: {_COUNT.format("y")}) AS n FROM s),
p AS (SELECT doc_id, u, n, unnest(range(1, len(u))) AS pos FROM u WHERE len(u) > 1),
e AS (SELECT doc_id, u, pos, list_filter(range(pos + 1, least(pos + 21, len(u)) + 1), lambda j: list_sum(n[pos:j]) >= 20)[1] AS last FROM p),
r AS (SELECT doc_id, pos, last, u[pos:last] AS w FROM e WHERE last IS NOT NULL),
f AS (SELECT w, min((doc_id, pos)) AS first FROM r GROUP BY w HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS i FROM r JOIN f USING (w) WHERE (doc_id, pos) <> first),
k AS (SELECT a.doc_id, count(c.i) AS gone, coalesce(string_agg(y, '' ORDER BY a.i) FILTER (WHERE c.i IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM u) a LEFT JOIN c ON a.doc_id = c.doc_id AND a.i = c.i GROUP BY 1)
SELECT u.doc_id, CAST(coalesce(len(x), 0) AS BIGINT) AS n_sentences, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(length(coalesce(kept, text, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, text, '')) AS kept_sha256 FROM u LEFT JOIN k USING (doc_id)""")
def op8(spark, sf_dir):
    kept = F.coalesce("kept", F.lit(""))
    return sentence_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_sentences", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


@query("op9_line_windows", _repeats("string_split(text, chr(10))", 3, "u", "u[pos], u[pos + 1], u[pos + 2]").format(
    kept="string_agg(x, chr(10) ORDER BY e.i) FILTER (WHERE c.i IS NULL)") + """SELECT u.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256 FROM u LEFT JOIN k USING (doc_id)""")
def op9(spark, sf_dir):
    kept = F.coalesce("kept", F.lit(""))
    return line_decisions(table(spark, sf_dir, "documents")).select(
        F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


_BOTH = "'</s>[INST] ok [/INST]'"


def _escaped(col: str) -> str:
    out = f"replace({col}, chr(92), repeat(chr(92), 2))"
    for c in ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]"):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


@query("op2_chat_format", f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_BOTH} UNION ALL SELECT -7, 1, 'assistant', {_BOTH}),
p AS (SELECT *, length({_escaped('text')}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 23 + length({_escaped('role')}) END AS len FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_unmapped FROM p GROUP BY 1""")
def op2(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.to_variant_object(F.struct("role", "text", "turn")).alias("record"))
    both = [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.parse_json(F.lit(json.dumps({"messages": both}))).alias("record"))
    out = format_chats(rows.unionByName(extra), "conv_id", "record")
    back = out.select("conv_id", read_turns(F.col("formatted")).alias("t"), F.filter("segments", lambda s: s["loss"]).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "n_unmapped")
    text = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(s["piece"])), "")
    return back.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_unmapped")


_RULES = (("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow"))


def _fit(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


def _level(name: str, source: str, by: str, prior: str) -> str:
    """Strength and posterior of one level whose rows carry ``prior``."""
    return f"""{name}_p AS ({source.format(prior=prior)}),
{name}_x AS (SELECT sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) AS x, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n FROM {name}_p WHERE n > 0),
{name}_s AS (SELECT 1 / least(greatest(CASE WHEN n > k THEN (x - k) / (n - k) ELSE 0.5 END, CAST(0.001 AS DOUBLE)), CAST(0.5 AS DOUBLE)) - 1 AS s FROM {name}_x),
{name} AS (SELECT {by}, n, bad, s, prior, (bad + s * prior) / (n + s) AS mean FROM {name}_p, {name}_s)"""


@query("op3_host_reputation", f"""WITH own AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, bool_or(toxic = 1 OR quality = 0) AS b FROM labels GROUP BY 1),
h AS (SELECT host, CAST(count(b) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE b) AS DOUBLE) AS bad, string_split(host, '.') AS l FROM own LEFT JOIN known USING (page_id) GROUP BY 1),
hosts AS (SELECT host, n, bad, CASE WHEN array_to_string(l[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
  array_to_string(CASE WHEN array_to_string(l[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') THEN l[-3:] ELSE l[-2:] END, '.') AS domain FROM h),
g AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS p FROM hosts),
{_level("tops", "SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(p) AS prior FROM hosts, g GROUP BY 1", "suffix", "")},
{_level("domains", "SELECT a.*, t.mean AS prior FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2) a JOIN tops t USING (suffix)", "suffix, domain", "")},
{_level("hs", "SELECT a.*, d.mean AS prior FROM hosts a JOIN domains d USING (suffix, domain)", "host", "")},
ab AS (SELECT host, mean, bad + s * prior AS a, n - bad + s * (1 - prior) AS b FROM hs)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fit(r)} THEN '{r}'" for r, _ in _RULES)} END AS rule,
  CASE {" ".join(f"WHEN {_fit(r)} THEN '{v}'" for r, v in _RULES)} WHEN mean - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM own JOIN ab USING (host)""")
def op3(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels)


@query("op6_decontaminate", r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, w[p:p + k - 1] AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM bs)),
t AS (SELECT doc_id, p, k, w[p:p + k - 1] AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, t.k, item_id FROM t JOIN g ON t.k = g.k AND t.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS i FROM hit) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""")
def op6(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


RANKS = "byte_bpe_multi_50k.tiktoken"


def token_digests(docs):
    out = encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"))


@query("op1_language_id")
def op1(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_multi_index")
def op4(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


#: CRC-32 of a list of bytes ``{0}``, by a table that SQL makes from the polynomial.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab)"


def _crc32(text: str) -> str:
    listed = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {listed}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_MIX = f"(((y + k) % {PRIME}) * ((y + k) % {PRIME}) % {PRIME}) * {FACTOR} % {PRIME}"


@query("op11_feistel_shards", f"""WITH RECURSIVE k(j, k) AS (VALUES {", ".join(f"({j}, {k})" for j, k in enumerate(round_keys(SEED)))}),
n AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, greatest(CAST(ceil(sqrt(count(*))) AS BIGINT), 1) AS a FROM documents)),
r AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc32("coalesce(text, '')")} AS crc, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text) NULLS FIRST) - 1 AS no FROM documents, {_CRC_TABLE} t),
w(no, x, y, i) AS (SELECT no, no // b, no % b, 0 FROM r, n UNION ALL
  SELECT no, y, (x + {_MIX}) % (CASE WHEN j % 2 = 0 THEN a ELSE b END), i + 1 FROM w JOIN k ON j = i % 8, n WHERE i = 0 OR i % 8 <> 0 OR x * b + y >= n)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST((x * b + y) % {SHARDS} AS INTEGER) AS shard, CAST((x * b + y) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN w USING (no), n WHERE i > 0 AND i % 8 = 0 AND x * b + y < n""")
def op11(spark, sf_dir):
    placed = shard_digests(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op12_splitter_trie", f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY d) AS k, list(strlen(text) ORDER BY d) AS s FROM t GROUP BY 1),
h AS (SELECT conv_id, k, s, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, {_CRC_TABLE} t),
p AS (SELECT a.conv_id, list_concat(coalesce(b.k, [])[1:h], a.k[h + 1:]) AS k, list_concat(coalesce(b.s, [])[1:h], a.s[h + 1:]) AS s FROM h a LEFT JOIN own b ON b.conv_id = a.base),
m AS (SELECT conv_id, k[1:d] AS pre, d, s[d] AS size, len(k) = d AS ended FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM p)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(size), 0) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends FROM m GROUP BY 1, 2),
c AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS c FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT pre, d, CASE WHEN c IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * size AS saved FROM n LEFT JOIN c USING (pre, d)),
u AS (SELECT pre[1:e] AS pre, e AS d, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN u USING (pre, d) LEFT JOIN c USING (pre, d) LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.pre = n.pre[1:n.d - 1]""")
def op12(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_token_alignment")
def op13(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
