"""Dart signatures, near-duplicate classes and SimHash classes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from spendlens.llm import minhash, simhash
from spendlens.llm.grouping import group_buckets, shared_buckets


def _corpus(n=40, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    # A chain: neighbours are alike, its ends are not.
    chain = [rng.choice(words) for _ in range(120)]
    for i in range(6):
        chain = list(chain)
        chain[i * 20] = "x"
        texts.append(" ".join(chain))
    texts += ["Same  WORDS\nhere now and again", "same words here now and again", "a b", "a b", "a a a a a a a a a a", "a a a a a a a a"]
    return list(enumerate(texts))


def _shingles(text):
    w = text.lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def _classes(ids, linked):
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


def test_signature_agrees_with_weighted_similarity():
    base = [f"w{i}" for i in range(300)]
    other = [w if i % 40 else f"x{i}" for i, w in enumerate(base)]
    sets = minhash.shingle_sets([" ".join(base + base[:60]), " ".join(other)])
    want = minhash.weighted_jaccard(sets[0][:2], sets[1][:2])
    sig = minhash.dart_signatures([s[:2] for s in sets], 3000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_signature_does_not_depend_on_the_batch():
    sets = [s[:2] for s in minhash.shingle_sets(["a b c d e f g", "z " * 500, "one", ""])]
    together = minhash.dart_signatures(sets, 60)
    for i, s in enumerate(sets):
        assert np.array_equal(minhash.dart_signatures([s], 60)[0], together[i])


def test_signatures_stay_the_same():
    """The digest was taken before the darts of a slot were compared without sorting them all."""
    texts = ["a b c d e f g", "z " * 500, "one", "", " ".join(f"w{i % 97} v{i}" for i in range(2000))]
    signed = minhash.dart_signatures([s[:2] for s in minhash.shingle_sets(texts)], 320)
    assert xxhash.xxh3_64_hexdigest(signed.tobytes()) == "1a7a308602d0bd65"


def test_classes(docs, corpus):
    sets = {d: _shingles(t) for d, t in corpus}

    def linked(a, b):
        union = sum((sets[a] | sets[b]).values())
        return union and sum((sets[a] & sets[b]).values()) / union >= 0.8

    want = _classes([d for d, _ in corpus], linked)
    assert len(set(want.values())) < len(want) - 20
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()}
    assert kept == set(want.values())


def test_group_buckets_loses_no_link(spark):
    """One large bucket of a star, a chain that leaves its centre, and lone members."""
    rng = random.Random(1)
    links = {(0, i) for i in range(1, 30)} | {(i, i + 1) for i in range(100, 130)} | {(5, 100)}
    nodes = [*range(30), *range(100, 131), *range(200, 220)]
    rows = [(1, n) for n in nodes] + [(2, n) for n in rng.sample(nodes, 20)]
    table = spark.createDataFrame(sorted(links), "a long, b long")
    shared = shared_buckets(spark.createDataFrame(rows, "bucket long, node long"))
    got = {r.node: r.label for r in group_buckets(shared, lambda pairs: pairs.join(table, ["a", "b"])).collect()}
    want = {n: 0 for n in [*range(30), *range(100, 131)]}
    assert got == want


def _around_a_passage(m, rng, common):
    """m texts of a common passage and own words, each tenth with a near copy; the passage is ``common`` % of a text."""
    passage = [f"p{i}" for i in range(common)]
    rows = []
    for i in range(m):
        words = passage + [f"w{rng.randrange(10 ** 9)}" for _ in range(100 - common)]
        rows.append((len(rows), " ".join(words)))
        if i % 10 == 0:
            words[86 + i % 10] = "x"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("common", [60, 86])
def test_unlinked_members_of_a_bucket_are_not_paired(spark, common):
    """All texts in one bucket: the pairs checked grow with its members, not with their square, and no link is lost."""
    checked = {}
    for m in (200, 800):
        rows = _around_a_passage(m, random.Random(m), common)
        texts = spark.createDataFrame([(d, t, len(t.split()) - 4) for d, t in rows], "node long, text string, total long").repartition(4)
        shared = shared_buckets(texts.selectExpr("1L AS bucket", "node"))
        seen = []

        def check(pairs, texts=texts, seen=seen):
            seen.append(pairs.count())
            return minhash.check_pairs(texts, 0.8)(pairs)

        got = {r.node: r.label for r in group_buckets(shared, check, minhash.rare_shingles(texts, 0.8), minhash.common_share(0.8)).collect()}
        sets = {d: _shingles(t) for d, t in rows}
        copies = [(a, a + 1) for a in range(len(rows) - 1) if sum((sets[a] & sets[a + 1]).values()) / sum((sets[a] | sets[a + 1]).values()) >= 0.8]
        assert len(copies) == m // 10 and got == {x: a for a, b in copies for x in (a, b)}
        checked[m] = sum(seen)
    assert checked[200] < 200 * 8 and checked[800] < 5 * checked[200]


def test_pairs_of_unlike_sizes_are_not_formed(spark):
    """A total below ``share`` of both rules a pair out before it is made, and loses no link."""
    totals = {n: 10 * 2 ** (n % 8) for n in range(120)}
    links = sorted((a, b) for a in totals for b in totals if a < b and a % 8 == b % 8 and (b - a) % 16 == 0)
    table = spark.createDataFrame(links, "a long, b long")
    shared = shared_buckets(spark.createDataFrame([(1, n, t) for n, t in totals.items()], "bucket long, node long, total long"))
    seen = []

    def check(pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs.join(table, ["a", "b"])

    got = {r.node: r.label for r in group_buckets(shared, check, share=minhash.common_share(0.8)).collect()}
    assert got == {n: n % 16 for n in totals}
    assert seen and all(min(totals[a], totals[b]) >= 0.8 * max(totals[a], totals[b]) for a, b in seen)


def test_no_task_joins_many_partitions_of_a_bucket_round(spark, monkeypatch):
    """Spent centres leave the buckets by an anti-join that no coalesce stands above, made once a round."""
    from spendlens.llm import grouping

    plans = []
    whole = grouping.materialise

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return whole(df)

    monkeypatch.setattr(grouping, "materialise", watched)
    shared = shared_buckets(spark.createDataFrame([(1, n) for n in range(40)], "bucket long, node long"))
    table = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    grouping.group_buckets(shared, lambda pairs: pairs.join(table, ["a", "b"])).collect()
    spent = [p for p in plans if "LeftAnti" in p and "bucket" in p.split("LeftAnti")[1].splitlines()[0]]
    assert spent
    for p in spent:
        assert p.count("LeftAnti") == 1
        above = p[:p.index("LeftAnti")]
        assert "Repartition" not in above


def test_links_of_earlier_rounds_are_not_joined_again(spark, monkeypatch):
    """A round connects classes by its new links only: a copy group's links come once, however many rounds follow."""
    from spendlens.llm import grouping

    copies = [(0, i) for i in range(1, 200)]
    chain = [(i, i + 1) for i in range(300, 330)]
    table = spark.createDataFrame(copies + chain, "a long, b long")
    rows = [(1, n) for n in range(200)] + [(2, n) for n in [*range(150, 200), *range(300, 331)]]
    given = []
    whole = grouping.connect

    def watched(links):
        given.append(links.count())
        return whole(links)

    monkeypatch.setattr(grouping, "connect", watched)
    shared = shared_buckets(spark.createDataFrame(rows, "bucket long, node long"))
    got = {r.node: r.label for r in grouping.group_buckets(shared, lambda pairs: pairs.join(table, ["a", "b"])).collect()}
    assert got == {n: 0 for n in range(200)} | {n: 300 for n in range(300, 331)}
    assert len(given) > 1 and sum(given) <= len(copies) + len(chain)


def test_connect_names_components_by_their_smallest_node(spark):
    """Stars with a large and a small hub, a sorted chain, a ring, repeated links and loops; edges shrink from pass to pass."""
    from spendlens.llm.grouping import connect

    links = ([(500, i) for i in range(50)] + [(600, i) for i in range(601, 650)] + [(i, i + 1) for i in range(1000, 1100)]
             + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(50, 7), (7, 50), (3000, 3001), (3001, 3001)])
    nodes = sorted({n for link in links for n in link})
    near = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    got = {r.node: r.label for r in connect(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == _classes(nodes, lambda a, b: (a, b) in near)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_rare_shingles_are_shared_by_every_link(spark, docs, corpus, threshold):
    texts = docs.selectExpr("doc_id AS node", "text")
    kept = {}
    for r in minhash.rare_shingles(texts, threshold)(texts.select("node")).collect():
        kept.setdefault(r.node, {})[r.bucket] = (r.rest, r.total)
    sets = {d: _shingles(t) for d, t in corpus}
    links = [(a, b) for a in sets for b in range(a) if sets[a] | sets[b]
             and sum((sets[a] & sets[b]).values()) / sum((sets[a] | sets[b]).values()) >= threshold]
    share = minhash.common_share(threshold)
    assert len(links) > 40
    for a, b in links:
        met = [(kept[a][k], kept[b][k]) for k in kept[a].keys() & kept[b].keys()]
        assert any(min(x[0], y[0]) >= share * (x[1] + y[1]) for x, y in met)


def test_fingerprints(docs, corpus):
    rows = {r.doc_id: r for r in simhash.edited_fingerprints(docs, radius=3).collect()}
    order = sorted(corpus, reverse=True)
    for i, (d, t) in enumerate(order):
        following, r = order[(i + 1) % len(order)], rows[d]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[1][:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()

        def same(a, b):
            return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128

        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == same(r.fingerprint, rows[following[0]].fingerprint)
    prints = {d: int(r.fingerprint, 16) for d, r in rows.items()}
    want = _classes(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    assert {d: r.class_id for d, r in rows.items()} == want


def test_edited_text_is_nearer_than_an_unrelated_one(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(150))) for i in range(60)]
    got = simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_fingerprint_is_the_sign_of_the_weighted_votes(spark):
    got = simhash.fingerprints(spark.createDataFrame([(1, "aa"), (2, "aa bbbb"), (3, "")], "k long, text string"), ["k"]).collect()
    from pyspark.sql import functions as F
    one = spark.range(1).select(*[F.xxhash64(F.lit(w), *s) for w in ("aa", "bbbb") for s in ((), (F.lit(1),))]).first()
    prints = {r.k: (r.f0, r.f1) for r in got}
    assert prints[1] == (one[0], one[1]) and prints[3] == (0, 0)
    assert prints[2] == (one[2], one[3])  # the longer word outweighs the shorter
