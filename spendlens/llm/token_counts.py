"""Token counts by a compiled finite-state transducer.

A sentencepiece BPE model is compiled into a deterministic transducer over
characters. Its states hold what the rest of a text can still depend on: for
every earlier position from which some piece could still be read, the
characters since then, the last piece of the segmentation up to there, and its
token count relative to the current one. Every transition carries the change of the token count, so the
sum along a path is the number of tokens of the text read.

Why this gives the library's result: merging always takes the best pair that is
available (leftmost among equals), and pairs on both sides of a position that is
never crossed do not influence each other. A segmentation is therefore the
library's exactly if every two neighbours a, b stay apart when ``a + b`` is
segmented alone. The transducer looks for the one piece that ends at the current
character and may follow the piece before it.

No piece holds the space mark behind another character, so the state before a
run of space marks is the start state whatever came before: a synchronising
point. The map of a chunk (entry state -> exit state, tokens) is then described
by the part before its first synchronising point, the tokens between the first
and the last, and the part behind the last. ``compose`` joins two neighbouring
maps and is associative, so the maps of a text's chunks can be combined in any
bracketing.

Most words of a corpus are rare, and a rare word meets transitions that were never taken. ``Columns`` therefore takes all
new words of some texts through the transducer at once, a character of every word at a step.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SPACE = "▁"
#: Characters per chunk of a text.
CHUNK = 1 << 16
#: States and words remembered by one Python worker before it starts afresh.
MAX_STATES = 250_000
MAX_WORDS = 150_000
#: Longest segment that is remembered.
MAX_SEGMENT = 64
#: Characters of text whose new words are read at once.
RUN_CHARS = 8_000_000
#: Seconds after which a worker that counts no more lets go of what it remembers.
IDLE_S = 5.0

_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def read_model(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece BPE model with byte fallback (read on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    if sp.encode("a  b", out_type=str)[0][0] != SPACE or sp.normalize("a  b") != f"{SPACE}a{SPACE}{SPACE}b":
        raise ValueError("only models with a dummy prefix and an identity normaliser are supported")
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece holds a space mark behind another character")
    return pieces


#: Added to the relative token counts of a packed state, which may be negative.
_ZERO = 1 << 10


class Transducer:
    """Lazily determinised transducer of one model.

    A state's entries (characters since an earlier position, last piece up to there, relative token count) are packed into
    one string: their parts hang on the end of the first, so that only its characters are kept."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.names: list[str | None] = [None, *pieces]
        self.number = {p: i for i, p in enumerate(self.names)}
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p))} | {""}
        self.pair_ok: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.states: list[str] = []
        self.moves: list[dict[str, tuple[int, int]] | None] = []
        self.start = self._intern([("", 0, 0)])

    def _intern(self, entries: list[tuple[str, int, int]]) -> int:
        """Number of the state of ``entries``, the longest part first; pieces by their number."""
        state = "".join([chr(len(entries)), *[chr(len(t)) + chr(p) + chr(n + _ZERO) for t, p, n in entries], entries[0][0]])
        i = self.ids.get(state)
        if i is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append(None)
        return i

    def _entries(self, state: str) -> list[tuple[str, int, int]]:
        k = ord(state[0])
        head, begun = state[1:1 + 3 * k], state[1 + 3 * k:]
        return [(begun[len(begun) - ord(head[i]):], ord(head[i + 1]), ord(head[i + 2]) - _ZERO) for i in range(0, 3 * k, 3)]

    def segment(self, s: str) -> list[str]:
        """Segmentation of a short string of known characters by merging, best pair first."""
        parts, score = list(s), self.pieces
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """May the piece of number ``b`` follow that of number ``a``? Where nothing is before b (0), it has to be what its
        own characters merge to."""
        key = a * len(self.names) + b
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) > 4 * MAX_STATES:
                self.pair_ok.clear()
            first, second = self.names[a], self.names[b]
            ok = self.pair_ok[key] = self.segment((first or "") + second) == ([first, second] if first else [second])
        return ok

    def _move(self, state: int, ch: str) -> tuple[int, int]:
        entries = self._entries(self.states[state])
        for begun, last, count in entries:
            piece = self.number.get(begun + ch)
            if piece is not None and self.may_follow(last, piece):
                break
        else:
            # No piece holds the character: one token a byte, and nothing merges across it.
            return self.start, len(ch.encode("utf-8", "surrogatepass"))
        emit = count + 1
        open_ = [(t + ch, p, n - emit) for t, p, n in entries if t + ch in self.prefixes]
        return self._intern([*open_, ("", piece, 0)]), emit

    def run(self, s: str) -> int:
        """Tokens of ``s`` read from the start state."""
        if len(self.states) > MAX_STATES:
            self._reset()
        state, total, moves = self.start, 0, self.moves
        for ch in s:
            known = moves[state]
            if known is None:
                known = moves[state] = {}
            step = known.get(ch)
            if step is None:
                step = known[ch] = self._move(state, ch)
            state, emit = step
            total += emit
        return total


class Numbers:
    """Map of whole numbers (below 2 ** 39) to smaller ones (below 2 ** 24), asked for many at once; open addressing, at most
    half full, a key and its value in one number."""

    def __init__(self, bits: int = 12):
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.table = np.full(1 << bits, -1, dtype=np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot >>= np.uint64(64 - self.bits)
        return slot.view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, -1 for one that has none."""
        slot = self._slots(keys)
        held = self.table[slot]
        off = (held >> 24) - keys
        far = np.flatnonzero((off != 0) & (held >= 0))
        held &= (1 << 24) - 1
        held[off != 0] = -1
        slot, keys = slot[far], keys[far]
        while len(far):
            slot = (slot + 1) & (len(self.table) - 1)
            other = self.table[slot]
            mine = other >> 24 == keys
            held[far[mine]] = other[mine] & ((1 << 24) - 1)
            on = ~mine & (other >= 0)
            far, slot, keys = far[on], slot[on], keys[on]
        return held

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct ``keys`` that have no value yet."""
        both = keys << 24 | values
        if 2 * (self.n + len(both)) > len(self.table):
            both = np.concatenate([self.table[self.table >= 0], both])
            self._reset(max(self.bits, int(4 * len(both)).bit_length()))
        self.n += len(both)
        slot = self._slots(both >> 24)
        while len(both):
            free = self.table[slot] < 0
            self.table[slot[free]] = both[free]      # of several for a slot the last one stays
            left = self.table[slot] != both
            both, slot = both[left], (slot[left] + 1) & (len(self.table) - 1)


class Columns:
    """The transducer on many words at once. A word's state is held as its open parts (word, where the part begins, its node in
    the trie of the pieces) and, for every position, the last piece up to there and the tokens so far."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        names = transducer.names
        letters = sorted({ch for p in names[1:] for ch in p})
        self.letter = np.zeros(0x110000, dtype=np.int64)
        self.letter[[ord(ch) for ch in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes = {"": 0}
        edges: dict[int, int] = {}
        for p in names[1:]:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges[nodes[p[:k - 1]] * self.width + int(self.letter[ord(p[k - 1])])] = nodes[p[:k]]
        self.trie = Numbers()
        self.trie.put(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self.first = self.trie.get(np.arange(self.width))
        self.piece = np.array([transducer.number.get(t, 0) for t in nodes], dtype=np.int64)
        self.single = np.array([0, *[transducer.number.get(ch, 0) for ch in letters]], dtype=np.int64)
        self.score = np.array([-np.inf, *[transducer.pieces[p] for p in names[1:]]])
        self.spelt = self.single[self.letter[[ord(ch) for ch in "".join(names[1:])]]]
        self.sizes = np.array([0, *map(len, names[1:])])
        self.starts = np.cumsum(self.sizes) - self.sizes
        number, merges = transducer.number, {}
        for c, p in enumerate(names[1:], 1):
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a and b:
                    merges[a * len(names) + b] = c
        self.merged = Numbers()
        self.merged.put(np.fromiter(merges, np.int64, len(merges)), np.fromiter(merges.values(), np.int64, len(merges)))
        self.pairs = Numbers()

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Transducer.may_follow`` of many pairs."""
        keys = a * len(self.score) + b
        found = self.pairs.get(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if self.pairs.n > 4 * MAX_STATES:
                self.pairs, new = Numbers(), np.unique(keys)
            self.pairs.put(new, self._stay_apart(new // len(self.score), new % len(self.score)).astype(np.int64))
            found = self.pairs.get(keys)
        return found > 0

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is the segmentation of a + b just a, b (or b, where a is 0)? All pairs are merged side by side, best pair first."""
        sizes = self.sizes[a] + self.sizes[b]
        parts = np.zeros((len(a), max(2, int(sizes.max()))), dtype=np.int64)
        for x, at in ((a, np.zeros_like(a)), (b, self.sizes[a])):
            row = np.repeat(np.arange(len(x)), self.sizes[x])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(self.sizes[x]) - self.sizes[x], self.sizes[x])
            parts[row, at[row] + nth] = self.spelt[self.starts[x][row] + nth]
        # A letter that is no piece by itself: one pair at a time.
        odd = ((parts == 0) & (np.arange(parts.shape[1]) < sizes[:, None])).any(axis=1)
        open_ = np.flatnonzero(~odd)
        while len(open_):
            now = parts[open_, :int(sizes[open_].max())]
            if now.shape[1] < 2:
                break
            both = self.merged.get((now[:, :-1] * len(self.score) + now[:, 1:]).ravel()).reshape(len(now), -1)
            score = np.where(both > 0, self.score[np.maximum(both, 0)], -np.inf)
            at = score.argmax(axis=1)               # the leftmost among equals
            row = np.arange(len(now))
            more = score[row, at] > -np.inf
            open_, now, at, row = open_[more], now[more], at[more], np.arange(int(more.sum()))
            if not len(open_):
                break
            column = np.arange(now.shape[1])
            left = np.concatenate([now[:, 1:], np.zeros((len(now), 1), dtype=np.int64)], axis=1)
            now = np.where(column[None, :] > at[:, None], left, now)
            now[row, at] = both[more][row, at]
            parts[open_, :now.shape[1]] = now
            sizes[open_] -= 1
        lone = a == 0
        apart = np.where(lone, (sizes == 1) & (parts[:, 0] == b), (sizes == 2) & (parts[:, 0] == a) & (parts[:, 1] == b))
        for i in np.flatnonzero(odd).tolist():
            apart[i] = self.transducer.may_follow(int(a[i]), int(b[i]))
        return apart

    def run(self, words: list[str]) -> list[int]:
        """``Transducer.run`` of many short words, none empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        start = (np.cumsum(sizes) - sizes)[order]
        longest = int(sizes.max())
        lasting = len(words) - np.searchsorted(sizes[order][::-1], np.arange(longest), side="right")
        last = np.zeros((longest + 1, len(words)), dtype=np.int64)
        total = np.zeros((longest + 1, len(words)), dtype=np.int64)
        word, begun, node = (np.zeros(0, dtype=np.int64) for _ in range(3))
        for i in range(longest):
            n = int(lasting[i])
            stay = word < n
            word, begun, node = word[stay], begun[stay], node[stay]
            at = code[start[:n] + i]
            letter = self.letter[at]
            node = np.concatenate([self.trie.get(node * self.width + letter[word]), self.first[letter]])
            known = np.flatnonzero(node >= 0)
            word, begun, node = np.concatenate([word, np.arange(n)])[known], np.concatenate([begun, np.full(n, i)])[known], node[known]
            piece = self.piece[node]
            ends = np.flatnonzero(piece)
            ends = ends[self.may_follow(last[begun[ends], word[ends]], piece[ends])]
            last[i + 1, word[ends]] = piece[ends]
            total[i + 1, word[ends]] = total[begun[ends], word[ends]] + 1
            # No piece holds the character: one token a byte, and nothing merges across it.
            cut = np.ones(n, dtype=bool)
            cut[word[ends]] = False
            if cut.any():
                size = 1 + (at > 0x7F).astype(np.int64) + (at > 0x7FF) + (at > 0xFFFF)
                total[i + 1, :n][cut] = total[i, :n][cut] + size[cut]
                open_ = ~cut[word]
                word, begun, node = word[open_], begun[open_], node[open_]
        out = np.empty(len(words), dtype=np.int64)
        out[order] = total[sizes[order], np.arange(len(words))]
        return out.tolist()


class Counter(dict):
    """Tokens of a segment between two synchronising points, remembered in two
    generations: when the younger one is full it replaces the older one."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.transducer = Transducer(pieces)
        self.columns: Columns | None = None
        self.older: dict[str, int] = {}

    def counts(self, segments: list[str]) -> np.ndarray:
        """Tokens of distinct ``segments``; all new ones are read at once."""
        found = list(map(self.get, segments))
        missing = [i for i, n in enumerate(found) if n is None]
        new = []
        for i in missing:
            found[i] = self.older.get(segments[i])
            if found[i] is None:
                if len(segments[i]) <= MAX_SEGMENT:
                    new.append(i)
                else:
                    found[i] = self.transducer.run(segments[i])
        if new:
            if self.columns is None:
                self.columns = Columns(self.transducer)
            for i, n in zip(new, self.columns.run([segments[i] for i in new]), strict=True):
                found[i] = n
        if len(self) + len(missing) > MAX_WORDS:
            self.older = dict(self)
            self.clear()
        self.update((segments[i], found[i]) for i in missing[:MAX_WORDS] if len(segments[i]) <= MAX_SEGMENT)
        return np.array(found, dtype=np.int64)

    def __missing__(self, segment: str) -> int:
        n = self.older.get(segment)
        if n is None:
            n = self.transducer.run(segment)
        if len(segment) <= MAX_SEGMENT:
            if len(self) >= MAX_WORDS:
                self.older = dict(self)
                self.clear()
            self[segment] = n
        return n


def chunk_map(counter: Counter, chunk: str) -> tuple[str, int | None, str]:
    """(head, tokens, tail) of a chunk: the part before its first synchronising point, the tokens
    up to the last one, the part behind it; ``tokens`` is None if the chunk has no such point."""
    parts = _SEGMENT.findall(chunk)
    if len(parts) < 2:
        return chunk, None, ""
    return parts[0], sum(map(counter.__getitem__, parts[1:-1])), parts[-1]


def compose(counter: Counter, a: tuple, b: tuple) -> tuple:
    """The map of two neighbouring chunks from their maps."""
    (ah, an, at), (bh, bn, bt) = a, b
    if an is None and bn is None:
        return chunk_map(counter, ah + bh)
    if an is None:
        head, n, tail = chunk_map(counter, ah + bh)
        return (head, bn, bt) if n is None else (head, n + counter[tail] + bn, bt)
    head, n, tail = chunk_map(counter, at + bh)
    if bn is None:
        return (ah, an, head) if n is None else (ah, an + counter[head] + n, tail)
    inner = counter[head] if n is None else counter[head] + n + counter[tail]
    return ah, an + inner + bn, bt


def count_all(counter: Counter, texts: list[str]) -> list[int]:
    """Tokens of every text. In a text without runs of blanks the segments are its words; the distinct words of some texts are
    looked up together."""
    out, first = [0] * len(texts), 0
    while first < len(texts):
        last, chars, plain, others = first, 0, [], []
        while last < len(texts) and (last == first or chars + len(texts[last]) <= RUN_CHARS):
            t = texts[last]
            chars += len(t)
            if t:
                (others if len(t) >= CHUNK or t[0] == " " or "  " in t or SPACE in t else plain).append(last)
            last += 1
        if plain:
            words = pa.compute.split_pattern(pa.array([texts[i].encode("utf-8", "surrogatepass") for i in plain], pa.binary()), b" ")
            coded = words.flatten().dictionary_encode()
            names = [SPACE + w.decode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
            sizes = counter.counts(names)[coded.indices.to_numpy()]
            for i, n in zip(plain, np.add.reduceat(sizes, words.offsets.to_numpy()[:-1]).tolist(), strict=True):
                out[i] = n
        new = {s for i in others for s in _SEGMENT.findall(SPACE + texts[i][:CHUNK].replace(" ", SPACE))}
        counter.counts([s for s in new if len(s) <= MAX_SEGMENT])
        for i in others:
            out[i] = count_tokens(counter, texts[i])
        first = last
    return out


def count_tokens(counter: Counter, text: str, chunk: int = CHUNK) -> int:
    """Tokens of a whole text."""
    if not text:
        return 0
    marked = SPACE + text.replace(" ", SPACE)
    if len(marked) <= chunk and SPACE + SPACE not in marked:
        words = marked.split(SPACE)
        return sum(map(counter.__getitem__, [SPACE + w for w in words[1:]]))
    maps = [chunk_map(counter, marked[i:i + chunk]) for i in range(0, len(marked), chunk)]
    head, n, tail = reduce(lambda a, b: compose(counter, a, b), maps)
    return counter[head] if n is None else counter[head] + n + counter[tail]


_COUNTERS: dict[str, Counter] = {}
_IDLE: list[threading.Timer] = []


def _counter(key: str, pieces: dict[str, float]) -> Counter:
    while _IDLE:
        _IDLE.pop().cancel()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(pieces)
    return _COUNTERS[key]


def _rest() -> None:
    """Let go of the counters if no task asks for one soon: a Python worker lives on for the tasks of other stages, whose
    memory they would take."""
    timer = threading.Timer(IDLE_S, _COUNTERS.clear)
    timer.daemon = True
    _IDLE.append(timer)
    timer.start()


def n_tokens(text: Column, model_path: str) -> Column:
    """Column with the number of tokens of a text; a null text counts as empty.

    The model file (half a megabyte) is read on the driver and travels with the function, so
    executors need no copy of it. Work per text is linear in its length, memory is bounded."""
    pieces = read_model(model_path)

    @F.pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model_path, pieces)
        try:
            for batch in batches:
                yield pd.Series(count_all(counter, [t or "" for t in batch]), dtype="int64")
        finally:
            _rest()

    return counted(text)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    One row per input row (repeated rows and ids stay); null text: 0 bytes, 0 tokens; an empty
    table gives an empty result; other columns of ``docs`` are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                          n_tokens(text, model_path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
