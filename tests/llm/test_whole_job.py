"""Inputs on which a part of the job was once left out."""

import random
from collections import defaultdict

import corpus_pipeline
from spendlens.llm import html_extract, minhash, queries, substring_dedup
from test_text_operators import _without_repeats

SF = "/root/testdata/sf0.001"


# ---- repeated strings

def test_a_long_text_that_repeats_within_itself(spark):
    """Copies of a passage over 4,096 open units apart, in the text that holds it first."""
    rng = random.Random(21)
    lines = ["".join(rng.choices("abcdefghijklmnop ", k=130)) for _ in range(2400)]
    text = "".join(line + "".join(rng.choices("0123456789", k=20)) for line in lines * 2)
    rows = [(1, text), (2, lines[0] + "x" + lines[2000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == _without_repeats(rows, 100)
    assert got[1][1] > 2400 * 130


# ---- packing

def _library_tokens(docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.TOKENIZER))
    return {r.doc_id: len(sp.encode(r.text or "")) for r in docs.collect()}


def test_bins_hold_tokens_of_the_vocabulary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _library_tokens(docs)
    for got in (queries.op4_best_fit_packing(spark, SF), corpus_pipeline.pack(spark, docs, SF)):
        pieces, bins = defaultdict(list), defaultdict(int)
        for r in got.collect():
            pieces[r.doc_id].append((r.start, r.n_tokens))
            bins[r.bin_id] += r.n_tokens
        assert max(bins.values()) <= 2048 and pieces.keys() == want.keys()
        for d, n in want.items():
            size = max(1, n)
            assert sorted(pieces[d]) == [(s, min(2048, size - s)) for s in range(0, size, 2048)]


def test_near_copies_never_share_a_bin(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for base in range(40):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(100)]
        for copy in range(4):
            near = list(words)
            near[10 + 20 * copy] = "changed"
            rows.append((base * 4 + copy, " ".join(near), f"source{copy}"))
    rows += [(1000, "", "source0"), (1001, " ", "source1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = defaultdict(list)
    for r in queries.op4_best_fit_packing(spark, str(tmp_path)).collect():
        bins[r.bin_id].append(r.doc_id // 4 if r.doc_id < 1000 else "empty")
    assert sum(map(len, bins.values())) >= len(rows) > len(bins)
    assert all(len(held) == len(set(held)) for held in bins.values())


# ---- main text

LINE = "The river rose in the night, and by morning the bridge, the mill and the lower road were gone."


def test_an_article_keeps_its_header_sections_and_formulas():
    html = (f'<body><div class="header">Site name</div><div class="legal">All rights reserved, of course.</div><article>'
            f'<header class="entry-header"><h1>Flood</h1></header><div class="post-header"><p>By A. Writer</p></div><p>{LINE}</p>'
            f'<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="tex">x=2</annotation></math> holds.</p>'
            f'<p>A <label>word</label> more.</p><section class="legal-text"><p>{LINE}</p></section>'
            f'<fieldset><p>Boxed.</p></fieldset><object><p>Drawn.</p></object>'
            f'<div class="share"><div>Mail</div><div>Print</div></div><nav>Next</nav><div class="related">More</div><p>{LINE}</p></article>'
            f'<footer>Imprint</footer></body>')
    assert html_extract.main_text(html).split("\n") == [
        "Flood", "By A. Writer", LINE, "So x=2 holds.", "A word more.", LINE, "Boxed.", "Drawn.", LINE]


# ---- near duplicates

def test_bands_lose_no_pair_at_the_threshold():
    assert (1 - 0.8 ** minhash.ROWS) ** minhash.BANDS < 1e-9
