"""Quality rules, personal data, token counts, repeated strings, main text and toxicity against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spendlens.llm import html_extract, pii, quality, substring_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


# ---- quality rules

def _counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def test_counts(spark, documents, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    extra = {10_001: "a b a b a b a", 10_002: "x\n\nx\n x\ny", 10_003: "é\x0b☃ <b>|*"}
    rows = documents.select("doc_id", "text", "lang").union(
        spark.createDataFrame([(k, v, "en") for k, v in extra.items()], "doc_id long, text string, lang string"))
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality_rules(rows, labels).collect()}
    assert got == {d: _counts(t) for d, t in (texts | extra).items()}


def test_rules_against_sql(spark):
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{name}.parquet')")
    # A wide margin, so that cutoffs are chosen on the small table.
    want = con.execute(quality.rules_sql(alpha=0.6, delta=0.5) + " ORDER BY doc_id").fetchall()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels, alpha=0.6, delta=0.5)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == want
    assert {r[8] for r in want} > {None}


def test_binomial_tail(spark):
    from pyspark.sql import functions as F
    cases = [(10, 0, 0.3), (50, 2, 0.1), (400, 1, 0.01), (3000, 5, 0.005), (100, 40, 0.3)]
    for n, k, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        want = 1.0 if k >= n * p else sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs(spark):
    """Against a direct restatement: the fixed sequence stops at the first cutoff that is not admissible."""
    rng = random.Random(3)
    rows = [("=en", True, rng.random() * 0.3, 0.0, 0.0, rng.random()) for _ in range(4000)]
    rows += [("=en", False, rng.random(), 0.0, rng.random(), 0.0) for _ in range(900)]
    rows += [("=fr", True, 0.0, 0.0, 0.0, 0.0) for _ in range(40)] + [("=fr", False, 0.9, 0.9, 0.9, 0.9) for _ in range(40)]
    table = spark.createDataFrame(rows, f"stratum string, good boolean, {', '.join(f'{r} double' for r in quality.RULES)}")
    got = {r.stratum: tuple(r)[1:] for r in quality.choose_cutoffs(table).collect()}
    want = {}
    for stratum in ("=en", "=fr"):
        cuts = []
        for k in range(4):
            mine = [(r[1], r[2 + k]) for r in rows if r[0] == stratum]
            n, best, cut = sum(g for g, _ in mine), 0, None
            for c in quality.CUTOFFS:
                good, bad = sum(g and x > c for g, x in mine), sum(not g and x > c for g, x in mine)
                p = quality.ALPHA / 4
                tail = 1.0 if good >= n * p else sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(good + 1))
                if tail > quality.DELTA / 8:
                    break
                if bad - good > best:
                    best, cut = bad - good, c
            cuts.append(cut)
        want[stratum] = tuple(cuts)
    assert got == want and want["=en"][0] is not None and want["=fr"] == (None,) * 4


# ---- personal data

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _base(t):
    out = [("email", *m.span()) for m in _EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in _PHONE.finditer(t) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]


def test_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@-+ 2(0)é3") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == _base(t), t
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    assert pii.base_spans("1" * 100_000 + "@" * 100_000 + "+1" + " " * 100_000) == []


def test_added_spans_and_redaction(spark):
    rng = random.Random(2)

    def card():
        return "".join(rng.choice("0123456789") for _ in range(16))

    def token():
        return "".join(rng.choice("0123456789abcdef") for _ in range(40))

    rows = [(i, rng.choice([f"pay {card()} now", f"mail a{i}@b{i}.org please", f"token = \"{token()}\" was set", f"at 10.{i % 250}.3.4 it",
                            f"call +1 (555) 01{i % 10}-1234 today", f"under License, Version 2.0 of {1900 + i % 99}", f"no {i} and 345 or 6.7",
                            f"incomprehensibilitiesandmore words here {i}"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", __import__("pyspark").sql.functions.length("text").cast("long"))
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for d, t in rows:
        base = _base(t)
        assert got[d].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.BASE] == [sum(k == x[0] for x in base) for k in pii.BASE]
        assert set(pii.joined(base).split(",")) <= set(got[d].spans.split(",")) or not base
    hit = [bool(got[d].spans) for d, t in rows if t.startswith(("pay", "mail", "token", "at 10", "call"))]
    clean = [bool(got[d].spans) for d, t in rows if t.startswith(("under", "no 12", "incomp"))]
    assert sum(hit) > 0.95 * len(hit) and not any(clean)
    out = pii.redact(docs, pii.train(docs))
    assert out.columns == docs.columns and out.where("n_chars <> length(text)").count() == 0
    assert out.where("text like '%@%'").count() == 0
    assert pii.redacted("ab cd ef", [("email", 0, 5), ("card", 3, 5), ("ip", 6, 8)]) == "<EMAIL> <IP>"


# ---- token counts

def test_token_counts(documents, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(documents, path, limit=500).collect()}
    for d, t in texts.items():
        n = len(sp.encode(t))
        assert got[d] == (len(t.encode()), n, n > 500)
    rng = random.Random(1)
    counter = token_counts.Counter(token_counts.read_model(path))
    for _ in range(1500):
        t = "".join(rng.choice(" a e th▁ \n\tĂé☃😀中日本語def return    (x)==  1234 </s> <0x0A> ") for _ in range(rng.randint(0, 60)))
        for chunk in (1 << 16, 7, 2):
            assert token_counts.count_tokens(counter, t, chunk) == len(sp.encode(t)), t


def test_new_words_are_read_at_once(monkeypatch):
    """A text's new words up to MAX_SEGMENT characters go through the transducer side by side, none by itself; counts are the
    library's, also when the words of one run are more than are remembered."""
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("etaoinshrdluĂé☃😀中日本\n\tx=(") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 80)))
             for _ in range(150)]
    counter = token_counts.Counter(token_counts.read_model(path))
    with monkeypatch.context() as m:
        m.setattr(token_counts.Transducer, "run", None)
        assert token_counts.count_all(counter, texts) == [len(sp.encode(t)) for t in texts]
    texts += ["", " ", "  ", " a", "a ", "a  b", "▁a ▁", "x" * 63, "x" * 64, "a " * 40_000, " " * 64 + "b", "\U0001f600" * 70]
    want = [len(sp.encode(t)) for t in texts]
    assert token_counts.count_all(counter, texts) == want
    monkeypatch.setattr(token_counts, "MAX_WORDS", 50)
    monkeypatch.setattr(token_counts, "RUN_CHARS", 2000)
    counter = token_counts.Counter(token_counts.read_model(path))
    for _ in range(2):
        assert token_counts.count_all(counter, texts) == want
        assert len(counter) <= 50 and len(counter.older) <= 50


def test_numbers_map():
    rng = random.Random(3)
    want = {rng.randrange(1 << 38): rng.randrange(1 << 20) for _ in range(30_000)}
    keys, numbers = list(want), token_counts.Numbers()
    for i in range(0, len(keys), 7000):
        part = np.array(keys[i:i + 7000])
        numbers.put(part, np.array([want[k] for k in part.tolist()]))
    assert numbers.get(np.array(keys)).tolist() == list(want.values())
    others = [k + 1 for k in keys if k + 1 not in want]
    assert set(numbers.get(np.array(others)).tolist()) == {-1}


def test_transducer_states_take_little_memory():
    """What a Python worker remembers of the states: under 600 bytes each (874 as tuples of strings)."""
    import tracemalloc

    pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 12))) for _ in range(6000)]
    transducer = token_counts.Transducer(token_counts.read_model(path))
    tracemalloc.start()
    for w in words:
        transducer.run(token_counts.SPACE + w)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(transducer.states) > 2000
    assert held / len(transducer.states) < 600


def test_an_idle_worker_lets_go_of_its_counter(monkeypatch):
    import time

    monkeypatch.setattr(token_counts, "IDLE_S", 0.2)
    pieces = {token_counts.SPACE: 0.0}
    counter = token_counts._counter("m", pieces)
    token_counts._rest()
    assert token_counts._counter("m", pieces) is counter  # the next task in time keeps it
    time.sleep(0.5)
    assert token_counts._COUNTERS
    token_counts._rest()
    time.sleep(0.5)
    assert not token_counts._COUNTERS


def test_chunk_maps_compose_in_any_order():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    counter = token_counts.Counter(token_counts.read_model(path))
    t = "▁the▁▁quick▁brown▁fox" * 5
    a, b, c = (token_counts.chunk_map(counter, t[i:j]) for i, j in ((0, 20), (20, 26), (26, len(t))))

    def both(x, y):
        return token_counts.compose(counter, x, y)

    assert both(both(a, b), c) == both(a, both(b, c)) == token_counts.chunk_map(counter, t)


# ---- repeated strings

def _without_repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\1" * length
            else:
                seen.add(s)
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings(spark):
    rng = random.Random(4)
    passage = ["".join(rng.choice("abcd é") for _ in range(150)) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            parts += [p[rng.randint(0, 60):150 - rng.randint(0, 60)], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40)))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 400), (101, "a" * 5000), (102, "a" * 99), (103, rows[3][1]), (104, rows[3][1] * 2), (105, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == _without_repeats(rows, 100)


def test_parts_of_a_long_text_leave_no_window_out(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = list(substring_dedup._text_marks([data], 100, 32))
    windows = sorted((f, l) for _, _, first, last, _, _ in whole for f, l in zip(first.tolist(), last.tolist(), strict=True))
    assert sum(l - f + 1 for f, l in windows) == 4901
    monkeypatch.setattr(substring_dedup._parts, "__defaults__", (700,))
    cut = [x for _, _, first, last, _, _ in substring_dedup._text_marks([data], 100, 32) for x in zip(first.tolist(), last.tolist(), strict=True)]
    assert sum(l - f + 1 for f, l in cut) == 4901


# ---- main text

def test_main_text_of_the_pages(spark):
    from html import unescape
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert html_extract.main_text(r.html) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(("html", "want"), [
    ("<body><div class='menu'>x</div><div><h2>T</h2>Hello <b>you</b>, there. It is long, indeed.<p>a<p>b &lt; c</div>"
     "<div id='comments'><p>nice post, really. yes.</p></div><form>q</form>", "T\nHello you, there. It is long, indeed.\na\nb < c"),
    ("<article><header><h1>T</h1></header><p>Long, long text here.</p><aside>no</aside><ul><li>one<li>two</ul></article><footer>f</footer>",
     "T\nLong, long text here.\none\ntwo"),
    ("<html><script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><main><p>yes, it is.</p></main>", "yes, it is."),
    ("<nav>only a menu</nav>", ""),
    # An article is taken whole: headline, lead, body and what follows it.
    ("<body><article><h1>Head</h1><p class='lead'>Lead.</p><div class='body'><p>" + "Long text, indeed. " * 30 + "</p></div><p>End.</p></article></body>",
     "Head\nLead.\n" + ("Long text, indeed. " * 30).strip() + "\nEnd."),
    ("<main><h1>Head</h1><section>" + "Long text, indeed. " * 30 + "</section><section>Short.</section></main>",
     "Head\n" + ("Long text, indeed. " * 30).strip() + "\nShort."),
    # Names count as a whole inside an article.
    ("<article><p>Text, one.</p><section class='related-work'><p>Work, done.</p></section><div class='social-history'>Past, told.</div>"
     "<p class='ad-hoc'>For, this.</p><div class='related-posts'><p>Other, page.</p></div><div class='ad'>Buy, now.</div>"
     "<section id='comments'><p>Nice, post.</p></section></article>", "Text, one.\nWork, done.\nPast, told.\nFor, this."),
    ("<main><h1>Title</h1><article><p>Text, one. Text, two.</p></article><div class='more'><a>x</a></div></main>", "Title\nText, one. Text, two."),
    ("<div id='page'><div class='nav-bar'>x</div><div class='text'><h2>T</h2><p>Long, long, text. And more, of it.</p><p>x</p></div></div>",
     "T\nLong, long, text. And more, of it.\nx")])
def test_main_text_leaves_furniture_out(html, want):
    assert html_extract.main_text(html) == want


@pytest.mark.parametrize("html", ["<b>x" * 30_000, "<div class='a'>x." * 30_000, "<p>x</i>" * 30_000, "<div>" * 30_000 + "</section>" * 30_000 + "x",
                                  "<article>" + "<x>y" * 30_000 + "</article>", "<ul>" + "<li>x, y." * 30_000])
def test_main_text_is_linear_in_the_page(html):
    import time
    t = time.time()
    assert html_extract.main_text(html)
    assert time.time() - t < 5


# ---- toxicity

def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(6)
    words = ["idiot", "scum", "worthless", "moron", "trash"]
    entries = [("=" + w, 3.0) for w in words] + [("^stup", 2.0)]
    automaton = toxicity.Automaton(entries)
    for _ in range(4000):
        t = list(rng.choice([*words, "stupid", "clown"]))
        for _ in range(rng.randint(0, 3)):
            k, i = rng.randint(0, 2), rng.randrange(len(t) + 1)
            t[i:i + (k > 0)] = [] if k == 2 else [rng.choice("abcdeiost")]
        t = "".join(t)
        near = [(_distance(t, w), n) for n, w in enumerate(words) if _distance(t, w) <= (0 if len(w) < 5 else 1 if len(w) < 9 else 2)]
        hit = automaton.match(t)
        if near and min(near)[0] == 0:
            assert hit == (min(near)[1], 0)
        elif t.startswith("stup"):
            assert hit == (5, -1)
        else:
            assert (hit is None) == (not near) and (hit is None or hit[1] == min(near)[0])


def test_scores(spark):
    import zlib
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rows, labels = [], []
    for i in range(1200):
        t = [rng.choice(words) for _ in range(60)]
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            t[rng.randrange(60)] = rng.choice(["idiot", "moron", "worthless", "ldiot" if i % 12 else "idiot"])
        if i % 6 == 1:
            t[10] = '"idiot"'
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"),
                            spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    wrong = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        wrong += r.held_out and r.predicted != int(r.doc_id % 6 == 0)
    assert wrong <= 3


def test_personal_data_learns_from_all_candidates(spark):
    """More labelled candidates than any bounded sample of earlier rounds (20,000): all of them count, in the rows
    that the trees learn from and in the thresholds."""
    text = "mail a@b.org, no 12 and 345 or 6.7, at 10.1.2.3 it, 4111 1111 1111 1111 and incomprehensibilitiesandmore "
    texts = [text * (1 + i % 3) + str(i) for i in range(2500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = Counter((k, y) for t in texts for k, _, _, y in pii.candidates(t, pii.base_spans(t)) if y is not None)
    assert sum(want.values()) > 25_000
    rows = pii.training_rows(docs).collect()
    got = Counter()
    for r in rows:
        got[r.kind, r.label] += r.n
    assert got == want and 0.15 < sum(r.n for r in rows if r.held) / sum(want.values()) < 0.35
    assert len(rows) < 1000     # rows that look alike are one


def test_personal_data_thresholds_are_exact(spark):
    class Given:
        def score(self, f):
            return f[0]

    rng = random.Random(5)
    rows = [(k, int(rng.random() < s), [s], rng.randint(1, 9)) for k in ("email", "ip", "secret") for s in (rng.random() for _ in range(400))]
    rows += [("phone", 0, [0.9], 3), ("card", 1, [0.2], 3)]
    got = pii.thresholds(spark.createDataFrame(rows, "kind string, label int, features array<double>, n long"), Given(), 0.9)
    for kind in pii.KINDS:
        own = [(math.floor(f[0] * pii.SCORE_STEPS) / pii.SCORE_STEPS, y, n) for k, y, f, n in rows if k == kind]
        cuts = [c for c, _, _ in own if c >= 0.5 and sum(y * n for s, y, n in own if s >= c) >= 0.9 * sum(n for s, _, n in own if s >= c)]
        assert got.get(kind) == min(cuts, default=None)
