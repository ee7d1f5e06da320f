"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changewright.llm import chat_format as C
from changewright.llm.bpe import encode_documents
from changewright.llm.decontaminate import contamination, decontaminate
from changewright.llm.language_id import identify_languages, language_filter
from changewright.llm.line_dedup import line_decisions, line_dedup
from changewright.llm.multi_index import near_vectors
from changewright.llm.sentence_dedup import sentence_dedup
from changewright.llm.simhash import simhash_components, simhash_dedup
from changewright.llm.suffix_dedup import suffix_dedup
from changewright.llm.url_reputation import host_reputation, judge

CLASH = ("_id", "_t", "_row", "covered", "fp", "root", "u", "w", "a", "kept", "n", "component_id", "n_words", "items", "item_id", "tokens", "ranges", "lang_pred")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG = "the same old words again and again. " * 20_000
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

TEXTS = [
    (0, "alpha beta gamma\nsecond line here\nthird line here\nfourth", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, " \t\n \n", "en"),
    (None, "a text without id", "en"),
    (None, None, None),
    (4, LONG, "en"),
    (5, "1234 5678", "en"),
    (6, "alpha beta gamma\nsecond line here\nthird line here\nfourth", None),
    (6, "alpha beta gamma\nsecond line here\nthird line here\nfourth", None),
    (6, "another text of the same id", "en"),
    (7, "x" * 5000, "de"),
    (8, "\u00c9t\u00e9 \U0001f642 na\u00efve \x00 text", "fr"),
]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, l, None, None, *("clash" for _ in CLASH)) for i, t, l in rows], SCHEMA).repartition(3)


OPERATORS = {
    "language": identify_languages,
    "lines": line_decisions,
    "sentences": sentence_dedup,
    "simhash": simhash_components,
    "suffix": suffix_dedup,
    "bpe": lambda d: encode_documents(d, RANKS, public_tokenizers.PATTERN),
    "contamination": lambda d: contamination(d, d.sparkSession.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, ""), (None, "fourth"), (1, "alpha beta gamma")], "item_id long, text string")),
}
STAGES = {
    "language": language_filter,
    "lines": line_dedup,
    "simhash": simhash_dedup,
    "contamination": lambda d: decontaminate(d, d.sparkSession.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, name):
    assert OPERATORS[name](documents(spark)).count() == len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_columns(spark, name):
    for rows in (TEXTS, []):
        docs = documents(spark, rows)
        out = STAGES[name](docs)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() <= len(rows)


def test_all_null(spark):
    rows = [(None, None, None)] * 3
    for name, fn in OPERATORS.items():
        assert fn(documents(spark, rows)).count() == 3, name


def test_languages_of_odd_texts(spark):
    got = {r["doc_id"]: r for r in identify_languages(documents(spark)).where("doc_id is not null").collect()}
    for i in (1, 2, 3, 5):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[8]["lang_pred"] in ("en", "de", "fr")
    nothing = identify_languages(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_line_copies(spark):
    got = line_decisions(documents(spark)).select("_row.doc_id", "n_lines", "n_removed", "kept").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_removed"], r["kept"]))
    assert by[0] == [(4, 0, TEXTS[0][1])]
    assert sorted(by[6], key=repr) == sorted([(4, 4, ""), (4, 4, ""), (1, 0, TEXTS[10][1])], key=repr)
    assert by[1] == [(0, 0, None)] and by[2] == [(1, 0, "")]


def test_one_of_each_component(spark):
    out = simhash_dedup(documents(spark))
    ids = sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids.count(0) == 1 and ids.count(1) == 1  # 1, 2, 3 and the null rows have fingerprint zero
    assert 2 not in ids and 3 not in ids and ids.count(6) == 1
    found = simhash_components(documents(spark)).where("doc_id in (1, 2, 3)").select("component_id").distinct().collect()
    assert [r[0] for r in found] == [1]


def test_short_items_and_items_without_id(spark):
    got = {r["doc_id"]: r for r in OPERATORS["contamination"](documents(spark)).where("doc_id in (0, 1, 4)").collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["n_items"], got[0]["items"]) == (10, 4, 1, ["1"])
    assert got[0]["contaminated"] and not got[1]["contaminated"]
    assert (got[1]["n_words"], got[4]["n_hit"]) == (0, 0)


def test_many_passes_give_the_same(spark):
    items = spark.createDataFrame([(i, f"w{i} x{i} y{i} " * 9) for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before w{i} x{i} y{i} " * 12 + "after") for i in range(0, 40, 3)] + [(99, "clean")], "doc_id long, text string")
    one, many = contamination(docs, items).drop("_id", "_t"), contamination(docs, items, max_set=20).drop("_id", "_t")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.1], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 2.0], 0),
        (9, [1.0, float("nan"), 2.0], 0), (10, [float("inf"), 0.0, 0.0], 0), (None, v, 0), (11, [], 0), (12, [1.0], 0), (13, [3.0], 0), (14, [-3.0], 0),
    ]
    kind = "vec_id long, embedding array<float>, label int, cid string, vec string, cells string, h string"
    got = near_vectors(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], kind)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (4, 1, True) and by[2] == (4, 1, False) and by[3] == (4, 1, False) and by[None] == (4, 1, False)
    assert by[12] == (1, 12, True) and by[13] == (1, 12, False) and by[14] == (0, 14, True)
    assert all(by[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert near_vectors(spark.createDataFrame([], kind)).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "x://"), (5, "http://A.Example.ORG/es/x?q#f"), (6, "http://org/y"), (7, "http://xorg/y"), (8, "a://b.com/fr/c://d"), (None, "http://h/p"), (8, "a://b.com/de/")]
    out = judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1, True), (None, True), (4, None)], "page_id long, bad boolean"))
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())
    assert len(got) == len(rows)
    assert ("5", "a.example.org", "/es/x", "example.org/es/", "block") in got
    assert ("6", "org", "/y", "org/", "allow") in got
    assert ("7", "xorg", "/y", None, "allow") in got
    assert ("8", "b.com", "/fr/c://d", "com/fr/", "allow") in got and ("8", "b.com", "/de/", "com/de/", "block") in got
    assert all(("" == g[1] == g[2]) for g in got if g[0] in "123")
    empty = judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean"))
    assert empty.count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.example.com", True)] * 60 + [("good.example.com", False)] * 60 + [("new.example.com", None), ("one.example.net", True)]
    got = {r["host"]: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.example.com"]["verdict"] == "block" and got["good.example.com"]["verdict"] == "allow"
    assert got["one.example.net"]["mean"] < 0.9
    assert 0.3 < got["new.example.com"]["mean"] < 0.7


def chats(spark, rows):
    return spark.createDataFrame(rows, "id long, json string").select("id", F.parse_json("json").alias("record"))


def test_layouts(spark):
    rows = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}'),
        (3, '{"prompt": "q", "response": "a"}'),
        (4, '{"instruction": "do", "input": "", "output": "done"}'),
        (5, '{"instruction": "do", "input": "this", "output": "done", "system": "s"}'),
        (6, '{"unknown": 1}'), (7, None), (8, '{"messages": []}'), (9, '{"turn": 2, "role": null, "text": "b"}'), (9, '{"text": "a", "role": "user", "turn": 1}'),
    ]
    got = {r["id"]: ([tuple(t) for t in r["turns"]], r["n_unmapped"]) for r in C.canonical_turns(chats(spark, rows), "id", "record").collect()}
    assert got[1] == ([("user", "q"), ("assistant", "")], 0)
    assert got[2] == ([("user", "q"), ("assistant", "a"), ("tool", "t")], 0)
    assert got[3] == ([("user", "q"), ("assistant", "a")], 0)
    assert got[4] == ([("user", "do"), ("assistant", "done")], 0)
    assert got[5] == ([("system", "s"), ("user", "do\n\nthis"), ("assistant", "done")], 0)
    assert got[6] == ([], 1) and got[7] == ([], 1) and got[8] == ([], 1)
    assert got[9] == ([("user", "a"), ("", "b")], 0)


TRICKY = ["", " ", "\\", "\\\\s>", "<s>", "</s>[INST] ok [/INST]", "<<SYS>> x <</SYS>>", "<<<SYS>>", "[[INST]", "[ROLE] a [TEXT] b [/ROLE]", "line\nbreak\r\n", "<", "[", " [", "a\\", "$1 \\1", "\u00e9\U0001f642", "<\\s>", "x" * 100_000]


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "tool", "", "[ROLE] \\ [TEXT]"]
    rows = [(r, t) for r in roles for t in TRICKY]
    turns = spark.createDataFrame([(1, [{"role": r, "text": t} for r, t in rows])], "id long, turns array<struct<role: string, text: string>>")
    done = turns.select(C.format_turns(F.col("turns")).alias("s")).select("s", F.array_join(F.transform("s", lambda s: s["piece"]), "").alias("f"))
    got = done.select(C.read_turns(F.col("f")).alias("t"), F.transform(F.filter("s", lambda s: s["loss"]), lambda s: C.unescape(s["piece"])).alias("loss")).first()
    assert [tuple(t) for t in got["t"]] == rows
    assert got["loss"] == TRICKY


def test_pipeline_on_awkward_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    import tempfile

    folder = tempfile.mkdtemp(prefix="awkward-")
    items.write.parquet(f"{folder}/benchmark.parquet")
    for rows in (TEXTS, []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
        assert docs.count() <= len(rows)


@pytest.fixture(scope="module")
def alike(spark):
    """Two texts of four lines with the same 32-bit hash, as rows without id."""
    text = F.array_join(F.transform(F.array(*map(F.lit, "abcd")), lambda x: F.sha2(F.concat(x, F.col("id").cast("string")), 256)), "\n")
    texts = spark.range(400_000).select(text.alias("text"))
    pair = texts.groupBy(F.hash("text", F.lit(False)).alias("h")).agg(F.collect_set("text").alias("t")).where("size(t) > 1").first()["t"][:2]
    assert len(set(pair)) == 2
    return pair


def test_texts_of_equal_short_hash_are_two_rows(spark, alike):
    docs = documents(spark, [(None, t, "en") for t in alike])
    assert {r["text"] for r in simhash_dedup(docs).collect()} == set(alike)
    # the lines of the first text stand in an earlier document too; the second text is clean
    docs = documents(spark, [(0, alike[0], "en"), *((9, t, "en") for t in alike)])
    kept = {r["_row"]["text"]: r["kept"] for r in line_decisions(docs).where("_row.doc_id = 9").collect()}
    assert kept == {alike[0]: "", alike[1]: alike[1]}
    item = spark.createDataFrame([(1, alike[0].split("\n")[0])], "item_id long, text string")
    assert {r["text"] for r in decontaminate(documents(spark, [(None, t, "en") for t in alike]), item, share=4).collect()} == {alike[1]}
