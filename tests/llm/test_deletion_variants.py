"""Fingerprints and components of the deletion-variant search against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from spendlens.llm import deletion_variants as dv

SCHEMA = "doc_id long, text string, source string, f string, label string, component_id string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    n = min(3, len(words))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode("utf-8"), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(fps):
    """The smallest member of each fingerprint's component, all pairs compared."""
    fps = sorted(set(fps))
    a, parent = np.array(fps, dtype=np.uint64), {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= 2):
            x, y = sorted((find(fps[i]), find(fps[i + 1 + int(j)])))
            parent[y] = x
    return {f: find(f) for f in fps}


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y", "z") for i, t in rows], SCHEMA)


def _same(docs):
    got = [tuple(r) for r in dv.near_copies(docs).collect()]
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    heads = components([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[heads[f]] = min(least.get(heads[f], i), i)
    assert sorted(got, key=str) == sorted([(i, f"{f:016x}", least.get(heads[f])) for i, f in rows], key=str)


def test_texts_of_all_kinds(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Ab", "c", "D,", "é", "ÀB", "😀"]) for _ in range(rng.randrange(12)))) for i in range(400)]
    base = [f"word{i}" for i in range(3000)]
    for k in range(60):
        copy = list(base)
        for _ in range(k % 7):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((1000 + k, "\t\n".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (None, None), (None, "ab c d,"), (5003, LONG), (5003, LONG), (5004, LONG + " ."),
             (5005, "two words"), (5006, "TWO\x0bwords"), (5007, "one"), (5008, "\x85 \xa0  "), (5009, "\x00 a b")]
    _same(_docs(spark, rows))


def test_empty_table(spark):
    assert dv.near_copies(_docs(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 5, 64, 1000])
def test_runs_of_a_long_text(monkeypatch, window):
    """Windows end between words and lose no shingle; votes of one text may come in parts."""
    rng = random.Random(window)
    texts = ["".join(rng.choice(["a", "bc", " ", "\n ", "É", "deF", "  "]) for _ in range(rng.randrange(300))) for _ in range(80)]
    monkeypatch.setattr(dv, "WINDOW", window)
    monkeypatch.setattr(dv, "VOTES", 7)
    assert dv.text_fingerprints([t.encode() for t in texts]).tolist() == [fingerprint(t) for t in texts]


def _balls(rng):
    """Fingerprints in dense neighbourhoods: many bits of a few positions, one half shared, single flips, and random ones."""
    out = {0, 1, (1 << 64) - 1, (1 << 63)}
    for _ in range(3):
        centre, places = rng.getrandbits(64), rng.sample(range(64), 9)
        out |= {centre ^ sum(1 << p for k, p in enumerate(places) if m >> k & 1) for m in rng.sample(range(512), 300)}
    half = rng.getrandbits(32)
    out |= {half | rng.getrandbits(32) << 32 for _ in range(300)} | {half << 32 | rng.getrandbits(32) for _ in range(300)}
    near = rng.getrandbits(32) << 32 | half
    for _ in range(150):
        out.add(near ^ (1 << rng.randrange(32, 64)) ^ (1 << rng.randrange(32, 64)))
    out |= {rng.getrandbits(64) for _ in range(400)}
    return sorted(out)


def test_dense_neighbourhoods_lose_no_link(spark):
    fps = _balls(random.Random(7))
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "f long")
    found = {(int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))) for a, b in dv.links(nodes).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {f: find(f) for f in fps} == components(fps)


def test_pairs_grow_with_the_members_of_a_bucket(spark):
    """Fingerprints that share a half but lie far apart: the links and what a large bucket makes of its members grow in proportion."""
    rng = random.Random(1)
    for m in (100, 400, 1600):
        nodes = spark.createDataFrame([((5 << 32) - (1 << 62) | rng.getrandbits(31),) for _ in range(m)], "f long")
        assert dv.links(nodes.distinct()).count() <= m
