"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from changewright.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, prefix string, at string, conv string, band string, shard string"


def plain(rows):
    """rows: (conv, turn, role, text) -> sorted result rows."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [v for *_, v in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, cs in nodes.items():
        if p:
            children[p[:-1]] += 1
    for p, cs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((cs[0], len(p), nodes[p[:-1]][0] if p else -1, len(cs), children[p], leaves[p], saved[p], sha(p)) for p, cs in nodes.items())


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA).repartition(3)
    out = conversation_trie(df, **how).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out)


def conversations(seed, n, most, letters="ab"):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(letters)) for c in rng.sample(range(3 * n), n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize(("width", "most"), [(32, 6), (2, 9), (1, 20), (3, 40)])
def test_like_plain(spark, width, most):
    rows = conversations(width, 60, most)
    assert got(spark, rows, width=width) == plain(rows)


def test_one_long_chain_and_its_copies(spark):
    turns = [(t, "user", f"t{t}") for t in range(150)]
    rows = [(c, *t) for c in (0, 5, 10, 40, 41) for t in turns] + [(c, 0, "user", "t0") for c in range(100, 140)]
    assert got(spark, rows, width=4) == plain(rows)


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "x"), (1, 2, "user", ""), (1, 2, "user", ""), (2, 1, "", "y"), (None, 1, "user", "lost"), (None, None, None, None),
        (3, 0, "user", "z" * 200_000), (4, 0, "us", "erx"), (8, 0, "user", "x"), (0, 0, "user", "é\U0001f642"), (0, 1, "assistant", "a,b\n"),
    ]
    rows += [(c, t, "user", "x") for c in range(200, 260) for t in range(3)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, width=1) == plain(rows)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
