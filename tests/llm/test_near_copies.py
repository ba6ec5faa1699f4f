"""Groups of near copies against brute force over all pairs: a hot family, a passage of many documents, clashing columns."""

import random

import numpy as np
import pytest
from test_operators_llm import plain_shingles, plain_stays, roots_of, rows_of

from skyloom.llm import near_copies

COLUMNS = "doc_id long, text string, id string, key string, node string, token string, root string, least string, size string, at string, bits string"


@pytest.fixture(scope="module")
def family():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    centre = [word() for _ in range(90)]
    for k in range(150):  # copies of one text, near to it but mostly not to each other
        t = list(centre)
        for _ in range(rng.choice([1, 2, 3, 4])):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    passage = [word() for _ in range(50)]
    for _ in range(80):  # a passage in documents that have nothing else in common
        own = [word() for _ in range(rng.choice([20, 50, 55, 200]))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    for _ in range(25):  # short texts of the same few lines
        texts.append(" ".join(rng.choice(["all rights are reserved by the owner of it", "read the terms of use before you go on", "no part may be copied or sold by others"]) for _ in range(rng.randint(1, 4))))
    texts += ["", None, "  ", "one two", "One TWO", "a b c d e", "x" * 9000, " ".join(passage * 40), " ".join(passage * 41)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3]), (None, "only this one has no id of its own")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("cells", "leaders"), [(near_copies.CELLS, near_copies.LEADERS), (64, 1)])
def test_groups(spark, family, cells, leaders):
    df = spark.createDataFrame([(i, t, *["clash"] * 9) for i, t in family], COLUMNS).repartition(5)
    found = near_copies.groups(df.selectExpr("doc_id AS id", "text"), cells=cells, leaders=leaders).collect()
    assert sorted((r.least is None, r.least or 0) for r in found) == plain_stays(family)
    if leaders == 1:
        return
    stays = near_copies.one_of_each_group(df)
    assert stays.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stays.collect()) == plain_stays(rows_of(df))


def test_shingles_and_bits():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 50, 3000)] + ["É Ü x y z w", "A b C d E", "a B c D e", "q" * 700_000 + " a b c d e f"]
    sets = [near_copies.shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(set(plain_shingles(t))) for t in texts]
    assert np.array_equal(sets[-3], sets[-2])
    long = " ".join(str(i) for i in range(300_000))  # over several spans
    whole = near_copies.shingle_set(long)
    assert len(whole) == 300_000 - 4
    assert np.isin(near_copies.shingle_set(" ".join(str(i) for i in range(150_000, 150_900))), whole).all()
    for a in sets[4:9]:
        for b in sets[4:9]:
            bits = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(near_copies.parities(a), near_copies.parities(b)))
            assert bits <= len(np.setxor1d(a, b))


def test_fingerprints_give_the_first_candidates(spark, family, monkeypatch):
    from skyloom.llm.simhash_cover import _signed, vote

    nodes = {near_copies.node_of(s): vote(s) for s in (near_copies.shingle_set(t) for _, t in family)}
    table = spark.createDataFrame([(n, _signed(f)) for n, f in nodes.items()], "node long, fp long")
    pairs = [(r.a, r.b) for r in near_copies.fingerprint_pairs(table).collect()]
    near = [(x, y) for x in nodes for y in nodes if x > y and (nodes[x] ^ nodes[y]).bit_count() <= 3]
    assert near and roots_of(nodes, pairs) == roots_of(nodes, near)
    asked = []
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda t: asked.append(t.columns) or table.selectExpr("node a", "node b").limit(0))
    found = near_copies.groups(spark.createDataFrame(family, "id long, text string")).collect()
    assert asked == [["node", "fp"]] and sorted((r.least is None, r.least or 0) for r in found) == plain_stays(family)
