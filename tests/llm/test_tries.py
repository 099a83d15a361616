import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from treeline.llm import tries
from treeline.llm.queries import oracle_sql, queries


def brute(rows, borrow):
    """The trie by walking every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, sha, text))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    convs = {}
    for c, turns in own.items():
        h = borrow(c)
        base = c - int(c / 5) * 5
        convs[c] = tuple((own.get(c - base, []) if c - base in own else [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
        ends[convs[c]].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1].encode()) if path else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p] if p in ends else [])).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


DDL = "conv_id long, turn long, role string, text string"


def got(df, borrow=tries.lent):
    return sorted((tuple(r) for r in tries.prefix_trie(df, borrow).collect()), key=str)


def lent(c):
    return zlib.crc32(str(c).encode()) % 9


def made(seed, convs, deep=0):
    rng, rows = random.Random(seed), []
    for c in range(-7, convs):
        start = rng.randrange(3)
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", None, "bot"]) if t > 4 else "user", f"é{start} {t if t < 3 else rng.randrange(3)}"))
    for k in range(deep):  # long conversations, some of them equal, some that go apart late
        rows += [(1000 + 5 * k, t, "user", f"long {t}" if t < 300 + 10 * (k // 2) else f"own {k}") for t in range(350)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = made(seed, 60, 6 if seed == 2 else 0)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    assert got(df) == brute(rows, lent)


def test_without_borrowing(spark):
    rows = made(3, 40, 3)
    assert got(spark.createDataFrame(rows, DDL), tries.nobody) == brute(rows, lambda c: 0)


def test_a_conversation_over_many_ranges_and_small_bounds(spark, monkeypatch):
    """One conversation holds most turns; bounds are tiny, so partial tries, rows of ends and hot parents are many."""
    for name, value in (("NODES", 7), ("IDS", 2), ("HOT_ROWS", 3), ("GROUPS", 2)):
        monkeypatch.setattr(tries, name, value)
    monkeypatch.setattr(tries.common, "HOT_ROWS", 5)
    monkeypatch.setattr(tries.common, "HOT_KEYS", 50)
    rows = made(5, 30) + [(10, t, "user", f"hot {t % 7}") for t in range(900)] + [(c, 0, "user", "same") for c in range(100, 140)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got(spark.createDataFrame(rows, DDL).repartition(6)) == brute(rows, lent)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, None, None, None), (3, 1, "user", ""), (4, 0, "", "a" * 200_000), (4, 0, "", "b"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], DDL + ", depth int, CONV_ID string")
    for borrow, plain in ((tries.lent, lent), (tries.nobody, lambda c: 0)):
        assert got(df, borrow) == brute(rows, plain)
    assert got(df.limit(0)) == []
    one = [r for r in rows if r[0] == 3]
    assert got(spark.createDataFrame(one, DDL), tries.nobody) == brute(one, lambda c: 0)


def test_query_agrees_with_sql_and_brute_force(spark, small):
    query = queries()["op13_tries"](spark, small)
    mine = sorted((tuple(r) for r in query.collect()), key=str)
    table = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert mine == brute([tuple(r) for r in table.collect()], lent)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    theirs = db.sql(oracle_sql()["op13_tries"])
    assert theirs.columns == query.columns
    assert sorted(theirs.fetchall(), key=str) == mine


def test_texts_are_not_shuffled(spark, small):
    plan = tries.placed(spark.read.parquet(f"{small}/conversations.parquet"))
    assert plan.columns == ["part", "conv_id", "size", "r1", "r2"]
