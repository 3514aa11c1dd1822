"""The prefix trie against one built turn by turn."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioflow.llm import trie
from folioflow.llm._work import temporary

TURN = "conv_id long, turn int, role string, text string, depth int, length int, tokens int, k1 int"


def built(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, role or "", digest), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(set)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items()),
        key=str,
    )


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURN).repartition(3)
    with temporary(spark):
        return sorted(map(tuple, trie.prefix_trie(table).collect()), key=str)


def test_trie_of_shared_beginnings_copies_and_long_conversations(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(420):
        for turn in range(rng.integers(0, 8)):
            rows.append((c, turn, "user" if turn % 2 else "assistant", "same" if c % 3 else f"t{rng.integers(3)}é😀"))
    rows += [(500 + c, turn, "user", f"copy {turn}") for c in range(700) for turn in range(3)]
    rows += [(1200 + c, 0, "user", "only one") for c in range(30)]
    rows += [(1300, None if k % 2 else k, "user", f"long {k % 50}") for k in range(900)]
    rows += [(1301, k, "user", f"long {k}") for k in range(400)]
    assert found(spark, rows) == built(rows)


def test_trie_of_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 2, None, "b"), (1, 1, "user", None), (1, 1, "user", ""), (1, 1, "a", "z"), (1, 1, "a", "y"),
        (2, 3, "user", "x" * 1_000_000), (2, 3, "user", "x" * 1_000_000), (2, 3, "user", "x" * 1_000_001), (None, 1, "user", "no id"),
        (0, 1, "ab", "c"), (0, 2, "a", "bc"), (100, 1, "a", "bc"), (7, 1, "ab", "c"), (207, 5, "user", "no base"),
    ]
    assert found(spark, rows) == built(rows)
    for c in (207, 3, 99, 1):  # turnless ones are members of the root alone
        assert found(spark, [(c, 1, "user", "x")]) == built([(c, 1, "user", "x")])
    assert found(spark, []) == []


def test_many_ends_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "same") for c in range(100_000, 103_000)] + [(c, 0, "user", "same") for c in range(9_000, 9_300)]
    assert found(spark, rows) == built(rows)


@pytest.mark.parametrize("salts", [1, 7, 64])
def test_owners_do_not_depend_on_salts(spark, salts):
    rows = [(c, turn, "user", f"{turn} {c % 4 if turn > 1 else 0}") for c in range(60) for turn in range(4)]
    with temporary(spark):
        paths = trie._paths(trie.rebuild(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
        marks = trie.owned(paths, salts).collect()
        assert sorted(marks) == sorted(trie.owned(paths, 32).collect())
        assert min(m.owned_from for m in marks) == 0
