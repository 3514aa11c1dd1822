"""Words one slip apart, and groups that are split by hand, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import suggest, works
from folioflow.sources.shared import temporary


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y)))
    return row[-1]


def test_near_words_equal_all_comparisons(spark):
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(150)} | {"용사", "욤사", "용산", "Ab", "a" * 70, "a" * 71})
    typed = [*words[::3], "용사", "xyz", "a" * 70, None]
    rows = lambda values: spark.createDataFrame([(v, 1) for v in values], "w string, typed int").select("w")
    got = suggest.near_words(rows(typed), "w", suggest.slip_index(rows([*words, *words[:5], None]), "w")).collect()
    spell = dict(zip([*words, "xyz"], [r[0] for r in spark.createDataFrame([(w,) for w in [*words, "xyz"]], "w string").select(suggest.letters(F.col("w"))).collect()], strict=True))
    wanted = {(t, w, d) for t in set(typed) - {None} for w in words if (d := distance(spell[t], spell[w])) <= 1 and (d == 0 or max(len(spell[t]), len(spell[w])) <= 64)}
    assert sorted(map(tuple, got)) == sorted(wanted)


def components(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_split_groups_equal_those_from_scratch(spark):
    rng = np.random.default_rng(2)
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b})
    removed = links[::4] + [(b, a) for a, b in links[1::6]] + [(1000, 1001)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    with temporary(spark):
        labels = works.merge_links(frame(links), "a", "b")
        got = dict(map(tuple, works.split_links(labels, frame(links), frame(removed), "a", "b").collect()))
    gone = {frozenset(p) for p in removed}
    assert got == components({i for p in links for i in p}, [p for p in links if frozenset(p) not in gone])
