import random

import numpy as np
import pytest

from lemmata.llm import neardup as N


def brute(rows, threshold=0.7):
    sets = [(d, N.words(s, t)) for d, s, t in rows if t and t.strip() and d is not None]
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a != b and x | y and len(x & y) >= threshold * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def corpus(seed, groups=40, size=4, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = ["the", "of", "and", "is", *rng.sample(vocabulary, words)]
        for k in range(rng.randint(1, size)):
            w = [x if rng.random() > 0.04 else rng.choice(vocabulary) for x in base]
            rng.shuffle(w)
            rows.append((f"d{g}-{k}", "the slogan", " ".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, slogan string, statement string").selectExpr("*", "1 AS id", "2 AS h", "3 AS rep", "4 AS w")


def pairs(df):
    return {(r["doc_id_a"], r["doc_id_b"]) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    rows += [("n1", None, None), ("n2", "x", "  "), (None, "a", rows[0][2]), ("copy", rows[0][1], rows[0][2]), ("copy", rows[0][1], rows[0][2]), ("marks", "the slogan", "<p>" + rows[0][2] + "</p> \\label{thm:1}"), ("signs", None, "+ - *")]
    v = N.Versions(frame(spark, rows))
    want = brute(rows)
    got = pairs(v.pairs())
    assert got == want and len(want) > 40
    classes = {}
    for r in v.classes().collect():
        classes.setdefault(r["doc_id"], r["class_id"])
    assert all(classes[a] == classes[b] for a, b in want)
    assert "n1" not in classes and "n2" not in classes and "signs" not in classes


def versions_of_one(seed, n, words=60, edits=4):
    """n records, all the same but for some words of their own."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for k in range(n):
        w = list(base)
        for e, i in enumerate(rng.sample(range(words), rng.randint(1, edits))):
            w[i] = f"own{k}x{e}"
        rows.append((f"d{k:04d}", None, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [5, 150, 16_000])
def test_a_crowd_of_versions_with_words_of_their_own(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    crowd = versions_of_one(5, 400 if block > 5 else 120)
    others = corpus(2, groups=len(crowd) // 2)  # with about as many others
    rows = crowd + others
    random.Random(1).shuffle(rows)
    v = N.Versions(frame(spark, rows))
    got, want = pairs(v.pairs()), brute(rows)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 5000
    classes = {r["doc_id"]: r["class_id"] for r in v.classes().collect()}
    assert len({classes[r[0]] for r in crowd}) == 1


def test_versions_that_are_the_whole_collection(spark):
    rows = versions_of_one(9, 700, edits=5)
    want = brute(rows)
    got = pairs(N.Versions(frame(spark, rows)).pairs())
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 240_000


def test_crowded_nodes_find_what_comparing_all_finds(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 150)
    base = [f"w{i}" for i in range(60)]
    left_out = random.Random(6).sample([(i, j) for i in range(60) for j in range(i)], 700)
    rows = [(f"d{k:03d}", None, " ".join(w for i, w in enumerate(base) if i not in x)) for k, x in enumerate(left_out)] + corpus(2, groups=5)
    want = brute(rows)
    assert pairs(N.Versions(frame(spark, rows)).pairs()) == want and len(want) >= 700 * 699 // 2


def test_many_copies_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 7)
    rows = [(f"a{i:03d}", None, "one two three four five six seven") for i in range(60)]
    rows += [(f"b{i:03d}", None, "one two three four five six") for i in range(20)]
    assert pairs(N.Versions(frame(spark, rows)).pairs()) == brute(rows)


def test_empty(spark):
    v = N.Versions(frame(spark, [("a", None, None)]))
    assert v.pairs().count() == 0 and v.classes().count() == 0


def test_gray_order_round_trip_and_neighbours():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(2))
    ra, rb = N.to_gray(a, b)
    x, y = N.from_gray(ra, rb)
    assert (x == a).all() and (y == b).all()
    # neighbours in rank differ in one bit, also where the high word changes
    for r in (5, 2**64 - 1):
        p = N.from_gray(np.array([7], np.uint64), np.array([r], np.uint64))
        q = N.from_gray(np.array([7 + (r == 2**64 - 1)], np.uint64), np.array([(r + 1) % 2**64], np.uint64))
        assert int(np.bitwise_count(p[0] ^ q[0])[0]) + int(np.bitwise_count(p[1] ^ q[1])[0]) == 1


@pytest.mark.parametrize("n", [2, 4, 17, 300, 5000])
def test_hierarchy_finds_what_comparing_all_finds(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    near = rng.integers(0, n, n // 2)
    a[: n // 2] = a[near] ^ (np.uint64(1) << rng.integers(0, 60, n // 2, dtype=np.uint64))
    b[: n // 2] = b[near]
    ra, rb = N.to_gray(a, b)
    o = np.lexsort((rb, ra))
    bits = N.from_gray(ra[o], rb[o])

    def brute_pairs(lo, hi):
        out = set()
        for k in range(lo, hi):
            d = np.bitwise_count(bits[0][k] ^ bits[0][k + 1 : hi]) + np.bitwise_count(bits[1][k] ^ bits[1][k + 1 : hi])
            out |= {(k, int(x)) for x in np.flatnonzero(d <= 6) + k + 1}
        return out

    index = N.Hierarchy(bits, np.zeros(1, np.int64))
    got = {(x, y) for i, j in index.near(6) for x, y in zip(i.tolist(), j.tolist())}
    assert got == brute_pairs(0, n)
    if n >= 300:  # most is dropped above the leaves
        assert index.counts[0][0] < 0.3 * n * (n - 1) / 2
    half = n // 2
    runs = np.unique([0, 1, half])
    got = {(x, y) for i, j in N.within(bits, runs, 6) for x, y in zip(i.tolist(), j.tolist())}
    assert got == set().union(*(brute_pairs(a, b) for a, b in zip(runs, [*runs[1:], n])))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 22), (20, 22), (7, 7), (4, 30), (30, 31)]
    got = {r["id"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in (2, 3, 4, 30, 31)) and got[11] == 10 and got[21] == got[22] == 20


def test_components_that_do_not_close_are_an_error(spark):
    with pytest.raises(RuntimeError, match="not closed"):
        N.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), rounds=1)


def laid(sets):
    words = [np.sort(np.array(sorted(s), np.uint64).view(np.int64)) for s in sets]
    return np.concatenate(words), np.cumsum([0] + [len(x) for x in words[:-1]])


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_sketches_drop_no_versions_and_most_others(threshold):
    rng = random.Random(3)
    sets = []
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(rng.randint(1, 120))]
        for _ in range(5):
            share = rng.random()
            sets.append({x if rng.random() < 0.75 + 0.3 * share else rng.getrandbits(64) for x in base} | {rng.getrandbits(64) for _ in range(rng.randint(0, 3))})
    sets += [set(range(70_000)), set(range(68_000)), set(range(5))]  # more words than are told apart
    u, v = N.odd_sketches(*laid(sets))
    i, j = np.triu_indices(len(sets), 1)
    may = N.may_be_versions((u[i], v[i]), (u[j], v[j]), threshold)
    true = np.array([len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 for a, b in zip(i.tolist(), j.tolist())])
    assert true.sum() > 20 and may[true].all()
    if threshold >= 0.7:  # below, what is allowed between long records is more than the bits that differ by chance
        assert may[~true].mean() < 0.05


def test_most_records_that_only_share_common_words_never_reach_the_exact_check(spark, monkeypatch):
    # records of one pattern share 46 of 84 words: they pass the limit, and their number grows with the square of the table
    rng = random.Random(8)
    rows = [(f"d{k:03d}", None, " ".join([f"p{k % 10}x{i}" for i in range(46)] + [f"own{k}x{i}" for i in range(19)])) for k in range(300)]
    rows += [(f"v{k:03d}", None, rows[k][2] + " more") for k in rng.sample(range(300), 20)]
    met, exact = [], N.verified

    def verified(pairs, sets, threshold):
        met.append(pairs.distinct().count())
        return exact(pairs, sets, threshold)

    monkeypatch.setattr(N, "verified", verified)
    got, want = pairs(N.Versions(frame(spark, rows)).pairs()), brute(rows)
    assert got == want and len(want) == 20, (len(got), len(want))
    assert met[0] < 1000  # of 4,350 pairs of one pattern


@pytest.mark.parametrize("block", [5, 16_000])
def test_passes_and_blocks_of_different_passes_do_not_mix(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus(4, groups=30) + versions_of_one(3, 60)
    for passes in (1, 2, 5):
        monkeypatch.setattr(N, "PASSES", passes)
        assert pairs(N.Versions(frame(spark, rows)).pairs()) == brute(rows)


def test_a_record_alone_in_its_node_is_no_link_of_its_own(spark):
    index = N.Hierarchy((np.array([5], np.uint64), np.array([9], np.uint64)), np.zeros(1, np.int64))
    assert not sum(len(i) for i, _ in index.near(40))
    asked = np.array([5, 2**64 - 1], np.uint64), np.array([9, 2**64 - 10], np.uint64)
    assert [(i.tolist(), j.tolist()) for i, j in index.near(40, asked)] == [([0], [0])]
    # the ends of tasks hand on nodes of one record too
    rows = list({frozenset(N.words(s, t)): (d, s, t) for d, s, t in corpus(6)}.values())
    want = dict.fromkeys((r[0] for r in rows), 0)
    for a, b in brute(rows):
        want[a] += 1
        want[b] += 1
    assert {r["doc_id"]: r["links"] for r in N.Versions(frame(spark, rows)).classes().collect()} == want
