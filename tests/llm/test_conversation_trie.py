"""Conversation trie: SQL, a plain trie of rebuilt conversations, deep and odd conversations."""

import hashlib
import re
import zlib

import pytest

from rankloom.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, c long, depth string, `a.b` int, words int"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + ts[h:]
    kids, members = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(ts[: d - 1]), set()).add(tuple(ts[:d]))
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        leaves[p] = sum(leaves[k] for k in kids.get(p, ())) or 1
        saved[p] = ((n - 1) * len(re.findall(conversation_trie.WORD, p[-1][1])) if p else 0) + sum(saved[k] for k in kids.get(p, ()))
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(convs[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    got = sorted((tuple(r) for r in conversation_trie.conversation_trie(df).collect()), key=repr)
    assert got == brute(rows)
    return got


def row(c, turn, role, text):
    return (c, turn, role, text, 1, "x", 2, 3)


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, turnless, negative and far ids, many equal conversations, a very long text; clashing names."""
    rows = [row(None, 0, "u", "x"), row(0, None, None, None), row(0, 1, "u", "a b"), row(0, 1, "u", "a b"), row(0, 1, "v", "a"), row(3, 0, "u", "only"), row(-3, 0, "u", "only"), row(-20, 0, "", ""), row(41, 0, "u", "x y")]
    rows += [row(c, t, "u", f"t {t} " * 3) for c in range(20_000, 20_060) for t in range(3)] + [row(c, 0, None, "b\tc\x0bd") for c in range(10**12, 10**12 + 50)]
    rows += [row(77, t, "u", "w " * 50_000) for t in range(2)] + [row(78, 5, "ab", "c"), row(79, 5, "a", "bc"), row(78, None, "z", None)]
    assert any(r[3] > 50 for r in check(spark, rows))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 133])
def test_depths(spark, n):
    """Chains of any length, one a prefix of the other, sharing blocks at other places."""
    check(spark, [row(c, t, "u", f"{t % 3}") for c, m in ((100, n), (101, n), (140, n - n // 3), (163, n)) for t in range(m)])


def test_empty(spark):
    assert check(spark, []) == []
    assert check(spark, [row(None, 1, "a", "b")]) == []


def test_long_ends(spark):
    """Ends over several stretches of ids are one digest in numeric order."""
    rows = [row(c, 9, "u", "same") for c in range(20, 20 * 1500, 20)]
    got = check(spark, rows)
    assert max(r[3] for r in got) == 1499


def test_query(same_rows):
    same_rows(queries.op12_conversation_trie, queries.oracle_sql()["op12_conversation_trie"])
