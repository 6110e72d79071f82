"""The burst trie of conversations against SQL, with containers small enough that they burst."""

import random

import duckdb
import pytest

from conftest import SF_MID, SF_SMALL
from spendlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, head string, seq long, n long, depth long"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, 2, 3) for r in rows], SCHEMA)


def _same(df):
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    got = sorted(map(tuple, prefix_trie.conversation_trie(df).collect()), key=str)
    assert got == sorted(con.execute(prefix_trie.TRIE_SQL).fetchall(), key=str)
    return got


def _chat(rng, convs):
    """Conversations that often share openings, some of them equal, some long."""
    rows, openings = [], [[rng.choice("abc") * k for k in range(1, 6)] for _ in range(4)]
    for c in convs:
        texts = list(rng.choice(openings))[:rng.randrange(6)] + [rng.choice("xyzé") for _ in range(rng.choice([0, 1, 1, 2, 3, 18]))]
        rows += [(c, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("container,chunk,piece", [(16, 4, 3)])
def test_bursting_containers(spark, monkeypatch, container, chunk, piece):
    monkeypatch.setattr(prefix_trie, "CONTAINER", container)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    rng = random.Random(container)
    _same(_frame(spark, _chat(rng, rng.sample(range(500), 120))).repartition(5))


def test_large_tables_and_salted_heads(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CONTAINER", 100)
    monkeypatch.setattr(prefix_trie, "BROADCAST_HEADS", 0)
    _same(spark.read.parquet(f"{SF_MID}/conversations.parquet"))


def test_one_conversation_and_its_copies_hold_most_turns(spark, monkeypatch):
    """A long conversation alone, and long ones with equal copies, of which some share all but the last turn."""
    monkeypatch.setattr(prefix_trie, "CONTAINER", 64)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = [(5, i, "user", f"t{i}") for i in range(1500)]
    for c in (10, 15, 20):
        rows += [(c, i, "user", f"u{i}") for i in range(200)]
    # Alike for nine turns, beyond the first chunk.
    for c in (25, 30, 35):
        rows += [(c, i, "user", f"v{i}" if i < 9 else f"{c}, {i}") for i in range(90)]
    rows += [(c, 0, "user", "hello") for c in range(100, 400)]
    got = _same(_frame(spark, rows))
    assert max(r[1] for r in got) == 1500


def test_nulls_ties_empty_and_turnless(spark):
    long = "word " * 100_000
    _same(_frame(spark, [
        (None, 1, "user", "nobody's"), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"),
        (2, 3, None, None), (2, 3, "", ""), (7, 0, "user", long), (8, 0, "user", long), (-3, 0, "user", "minus"), (-5, 0, "user", "minus"),
        (0, 0, "us", "erx"), (3, 0, "user", "x"), (4, 0, "user", "only"), (13, 0, "user", "no base"), (14, 5, "user", "a"), (2**62, 0, "a", "b")]))


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(_frame(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0


def test_given_table(spark):
    got = _same(spark.read.parquet(f"{SF_SMALL}/conversations.parquet"))
    root = [r for r in got if r[1] == 0]
    assert len(root) == 1 and root[0][2] is None
