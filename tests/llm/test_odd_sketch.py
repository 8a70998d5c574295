import re
from collections import defaultdict

import numpy as np
import pytest

from mobtrace.llm import odd_sketch
from mobtrace.llm.odd_sketch import Plan

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(texts, n):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(ids, texts, plan):
    sets = sets_of(texts, plan.words)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for h in holders.values():
        for j in range(len(h)):
            for k in range(j + 1, len(h)):
                common[h[j], h[k]] += 1
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (j, k), c in common.items():
        if plan.den * c >= plan.num * (len(sets[j]) + len(sets[k]) - c):
            root[find(j)] = find(k)
    least = defaultdict(lambda: None)
    for i in range(len(sets)):
        r = find(i)
        if ids[i] is not None and (least[r] is None or ids[i] < least[r]):
            least[r] = ids[i]
    return sorted(((ids[i], len(sets[i]), least[find(i)], ids[i] == least[find(i)]) for i in range(len(sets))), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("plan", [Plan(), odd_sketch.USUAL, Plan(leaders=0), Plan(leaders=1)])
def test_whole_table(spark, medium, plan):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    given = docs.select("doc_id", "text").collect()
    want = brute([r.doc_id for r in given], [r.text for r in given], plan)
    assert rows(odd_sketch.near_duplicates(docs, plan)) == want
    assert any(not kept for *_, kept in want)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    given = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, long), (8, long + " end"), (8, long + " end"), (None, long), (None, None), (9, "a b c d"), (9, "a b c d")]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in given], "doc_id long, text string, kept string, bands int")
    assert rows(odd_sketch.near_duplicates(docs)) == brute([a for a, _ in given], [b for _, b in given], Plan())
    assert rows(odd_sketch.near_duplicates(docs.limit(0))) == []


def test_chain_of_near_copies(spark):
    """Only neighbours are near enough; all must meet in one component."""
    given = [(i, " ".join(f"w{j}" for j in range(i * 3, i * 3 + 100))) for i in range(40)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = rows(odd_sketch.near_duplicates(docs))
    assert got == brute([a for a, _ in given], [b for _, b in given], Plan())
    assert {r[2] for r in got} == {0}


def family(n, core=100, own=12, name="d"):
    """Texts with a common part, each pair just below the threshold."""
    shared = " ".join(f"c{j}" for j in range(core))
    return [(i, shared + "".join(f" {name}{i}x{j}" for j in range(own))) for i in range(n)]


@pytest.mark.parametrize("leaders", [0, 1, 3])
def test_families_below_the_threshold(spark, leaders):
    """Two families of texts that resemble each other, some of which have a near copy; sizes vary."""
    plan = Plan(leaders=leaders)
    texts = [t for _, t in family(40)] + [t + " " + t.split()[-1] for _, t in family(40, 90, 14, "e")]
    texts += [t + " more" for t in texts[::7]] + [t.rsplit(" ", 3)[0] for t in texts[::11]] + texts[::13]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(range(len(texts)), texts, plan)
    assert rows(odd_sketch.near_duplicates(docs, plan)) == want
    assert sum(kept for *_, kept in want) > 70 and not all(kept for *_, kept in want)


def test_family_does_not_meet(spark):
    """No two members of such a family share a key where the smaller one looks for partners: no work by pairs."""
    plan = Plan()
    texts = spark.createDataFrame(family(300), "id long, text string")
    rare = odd_sketch.prefixes(texts.selectExpr("id", "id AS label"), texts, plan).collect()
    assert len(rare) == 300
    for r in rare:
        few = r.n - -(-2 * plan.num * r.n // (plan.den + plan.num)) + 1
        assert r.n == 110 and all(p.pos >= few for p in r.prefix)


def test_estimate():
    plan, rng = Plan(), np.random.default_rng(3)
    for share in (0.95, 0.85, 0.7):
        both = rng.integers(1, 1 << 63, int(2000 * share), dtype=np.uint64)
        rest = rng.integers(1, 1 << 63, 2000 - len(both), dtype=np.uint64)
        half = len(rest) // 2
        (_, a, c), (_, b, d) = (odd_sketch.signature(np.concatenate([both, x]), plan) for x in (rest[:half], rest[half:]))
        bits = sum(int(x).bit_count() for x in (a.view(np.uint64) ^ b.view(np.uint64)))
        assert abs(plan.similarity(bits) - share) < 0.1
        assert sum(int(x).bit_count() for x in (c.view(np.uint64) ^ d.view(np.uint64))) <= len(rest)
        assert (bits <= plan.most_differing) or share < 0.85
