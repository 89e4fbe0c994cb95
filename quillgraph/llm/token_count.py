"""Token counts by a compiled finite-state transducer.

A BPE encoding is valid exactly when every two neighbouring tokens are what the
merge rules give for their joined text.  So, reading left to right, the last
token of a prefix is the one vocabulary piece that ends there and is compatible
with the last token of the prefix before it.  The transducer keeps just enough
of the past to decide that: for each start position from which some piece may
still be completed, the piece-trie node reached, the last token before it, and
the token count there relative to now.  Two prefixes with equal memories behave
alike from then on, so a memory is a deterministic state, and a transition
carries the number of tokens that its character adds to the count (it may be
negative: a character can fuse earlier tokens).  States are determinised on
demand and kept in a bounded table.

A text is cut into chunks.  Where no piece holds two neighbouring characters
side by side, no token spans them, and the transducer goes on from its start
state whatever came before; a blank after another character is always such a
place.  So a chunk's state map (entry state to exit state and count) is constant
after the chunk's first such place: it is kept as the text before it, which the
entry state has yet to read, the count from there to the last such place, and
the text after that, which names the exit state.  These maps compose
associatively and :func:`scan` folds them as a balanced tree.  Texts of more than
``LONG_BYTES`` are spread over tasks by chunks; their maps come together at the
end, one small row a chunk.

Edge cases: a null text counts as the empty text (0 bytes, 0 tokens); a
character outside the vocabulary emits its UTF-8 bytes and resets the state;
texts of any length are read whole; repeated rows are counted each; an empty
table gives an empty result; other columns are kept, those with the name of an
output are replaced.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pieces, with_places

BLANK = "▁"
#: Bounds on what a worker remembers; beyond them tables are rebuilt, counts stay the same.
MAX_STATES, MAX_SEGMENTS = 250_000, 500_000
CHUNK_CHARS, LONG_BYTES = 1 << 16, 1 << 20
#: Nodes with more pieces below them are kept apart by their last token without looking at followers.
MAX_BELOW = 24


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Fields of one protobuf message: (number, int or bytes)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(buf):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            n, at = varint(at)
            value, at = buf[at : at + n], at + n
        else:
            n = 4 if wire == 5 else 8
            value, at = buf[at : at + n], at + n
        yield key >> 3, value


def read_pieces(model: bytes) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece BPE model with the negated scores that order merges; raises for settings the transducer does not cover."""
    pieces: dict[str, float] = {}
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, 1)
            if kind == 1:
                pieces[piece[1].decode()] = -struct.unpack("<f", piece.get(2, bytes(4)))[0]
            elif kind not in (2, 3, 6):
                raise ValueError(f"piece kind {kind} is not supported")
        elif number == 2 and (t := dict(_fields(value))).get(3) != 2 or number == 2 and not t.get(35):
            raise ValueError("not a BPE model with byte fallback")
        elif number == 3 and ((n := dict(_fields(value))).get(2) or n.get(4, 1) or not n.get(3, 1)):
            raise ValueError("only identity normalisation with a leading blank is supported")
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("a piece has a blank after another character")
    if any("\n" in p and p != "\n" for p in pieces):
        raise ValueError("a piece joins a line break with another character")
    return pieces


class _Lazy(dict):
    """A table whose missing entries are made when they are first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Transducer:
    """Lazily determinised BPE transducer over characters."""

    def __init__(self, pieces: dict[str, float]):
        self.rank = pieces
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: list[str | None] = [None]
        for piece in pieces:
            node = 0
            for ch in piece:
                nxt = self.trie[node].get(ch)
                if nxt is None:
                    nxt = len(self.trie)
                    self.trie.append({})
                    self.piece_at.append(None)
                    self.trie[node][ch] = nxt
                node = nxt
            self.piece_at[node] = piece
        self.below: list[list[str] | None] = [None] * len(self.trie)
        for node in range(len(self.trie) - 1, -1, -1):  # children have larger numbers than their parent
            found: list[str] | None = []
            for child in self.trie[node].values():
                own, more = self.piece_at[child], self.below[child]
                if more is None or len(found) + len(more) > MAX_BELOW:
                    found = None
                    break
                found += ([own] if own else []) + more
            self.below[node] = found
        self.alone = _Lazy(lambda p: self.merge(p) == [p])
        self.spines = _Lazy(self._spines)
        self.fits = _Lazy(self._fits)
        self.same: dict[tuple, str] = {}
        self.futures = _Lazy(self._future)
        self.neighbours = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.segments = _Lazy(self._count_segment)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.memory: list[tuple] = []
        self.steps: list[_Lazy] = []
        self.start = self._state(((0, None, 0),))

    def merge(self, text: str) -> list[str]:
        """Reference BPE of a short text: always the best-ranked, then leftmost, pair."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _spines(self, piece: str) -> tuple[list, list]:
        """First and last symbols of ``piece`` as merges build it, each with the rank of the merge that consumes it."""
        parts, first, last = list(piece), [], []
        while len(parts) > 1:
            ranks = [self.rank.get(x + y, math.inf) for x, y in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            i = ranks.index(best)
            if i == 0:
                first.append((parts[0], best))
            if i == len(parts) - 2:
                last.append((parts[-1], best))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [*first, (piece, math.inf)], [*last, (piece, math.inf)]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Do the merges of two neighbouring tokens leave their seam alone?

        Follows the symbols at the seam in merge order; the seam merges if its
        rank comes before both neighbours' next merges (the left one wins a tie).
        """
        left, right = self.spines[pair[0]][1], self.spines[pair[1]][0]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get(x + y)
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == math.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _future(self, key: tuple[int, str | None]) -> tuple[bool, str | None]:
        """(can a piece below this node follow, a token that stands for all with the same followers)."""
        node, last = key
        pieces = self.below[node]
        if pieces is None:
            return True, last
        able = tuple(p for p in pieces if self.alone[p] and (last is None or self.fits[last, p]))
        return bool(able), self.same.setdefault((node, able), last)

    def _state(self, memory: tuple) -> int:
        found = self.ids.get(memory)
        if found is None:
            found = self.ids[memory] = len(self.memory)
            self.memory.append(memory)
            self.steps.append(_Lazy(lambda ch, s=found: self._step(s, ch)))
        return found

    def _step(self, state: int, ch: str) -> tuple[int, int]:
        """(next state, tokens emitted) for one character."""
        if ch not in self.rank:
            return self.start, len(ch.encode("utf-8", "replace"))
        reached, new = [], None
        for node, last, count in self.memory[state]:
            nxt = self.trie[node].get(ch)
            if nxt is None:
                continue
            piece = self.piece_at[nxt]
            if piece is not None and new is None and self.alone[piece] and (last is None or self.fits[last, piece]):
                new = (piece, count + 1)
            if self.trie[nxt]:
                able, last = self.futures[nxt, last]
                if able:
                    reached.append((nxt, last, count))
        if new is None:
            raise AssertionError("no token fits; the merge rules are not consistent")
        emitted = new[1]
        memory = tuple((n, last, c - emitted) for n, last, c in reached)
        return self._state((*memory, (0, new[0], 0))), emitted

    def run(self, segment: str) -> int:
        """Tokens of a segment read from the start state."""
        state, total, steps = self.start, 0, self.steps
        for ch in segment:
            state, emitted = steps[state][ch]
            total += emitted
        return total

    def _count_segment(self, word: str) -> int:
        """Entry of the segment table: a word after one blank."""
        if len(self.segments) > MAX_SEGMENTS:
            self.segments.clear()
        if len(self.memory) > MAX_STATES:
            self._reset()
        end = self._word_end.match(word)
        if end and (at := end.end()) < len(word) and word[at - 1 : at + 1] not in self.neighbours:
            return self.segments[word[:at]] + self.run(word[at:])  # no piece spans the seam
        return self.run(BLANK + word)

    _word_end = re.compile(r"\w+")
    _parts = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def count_from_blank(self, text: str) -> int:
        """Tokens of ``text``, which starts at a reset: right after a blank (not included), to its end."""
        if not text:
            return self.run(BLANK)
        count = self.segments.__getitem__
        lines = text.split("\n")
        total = len(lines) - 1
        for i, line in enumerate(lines):
            words = line.split(" ")
            head = words.pop(0)
            if "" in words or BLANK in line or (not head and i == 0):
                total += self._slow(line, i == 0)
                continue
            if i == 0:
                total += count(head)
            elif head:
                total += self.run(head)
            total += sum(map(count, words))
        return total

    def _slow(self, line: str, after_blank: bool) -> int:
        marked = (BLANK if after_blank else "") + line.replace(" ", BLANK)
        return sum(map(self.run, self._parts.findall(marked)))

    def parted(self, x: str, y: str) -> bool:
        """Can no token hold the characters x and y side by side?"""
        x, y = x.replace(" ", BLANK), y.replace(" ", BLANK)
        return x + y not in self.neighbours and not (x == y == BLANK)

    def chunk_map(self, chunk: str) -> tuple:
        """(text before the first reset, tokens to the last reset, text after it), or (text,) if there is no reset."""
        marked = chunk.replace(BLANK, " ")
        first = next((i for i in range(1, len(marked)) if self.parted(marked[i - 1], marked[i])), None)
        if first is None:
            return (marked,)
        last = next(i for i in range(len(marked) - 1, 0, -1) if self.parted(marked[i - 1], marked[i]))
        return marked[:first], self.tail(marked[first:last]) if last > first else 0, marked[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The state map of two neighbouring chunks, from their maps alone."""
        seam = self.chunk_map(a[-1] + b[0])
        whole = len(seam) == 1
        if len(a) == 1 and len(b) == 1:
            return seam
        if len(a) == 1:
            return (seam[0], b[1], b[2]) if whole else (seam[0], seam[1] + self.tail(seam[2]) + b[1], b[2])
        if len(b) == 1:
            return (a[0], a[1], seam[0]) if whole else (a[0], a[1] + self.tail(seam[0]) + seam[1], seam[2])
        inner = self.tail(seam[0]) if whole else self.tail(seam[0]) + seam[1] + self.tail(seam[2])
        return a[0], a[1] + inner + b[1], b[2]

    def tail(self, text: str) -> int:
        """Tokens of a text that starts at a reset and ends before another one."""
        if text.startswith(" "):
            return self.count_from_blank(text[1:])
        blank = re.search("(?<=[^ ]) ", text)
        if blank is None:
            return self.run(text)
        return self.run(text[: blank.start()]) + self.count_from_blank(text[blank.end() :])

    def finish(self, whole: tuple) -> int:
        return self.tail(whole[0]) if len(whole) == 1 else self.tail(whole[0]) + whole[1] + self.tail(whole[2])

    def scan(self, maps: list[tuple]) -> tuple:
        """Fold chunk maps pairwise, as a prefix scan's up-sweep does."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text; the dummy blank in front is part of it."""
        if not text:
            return 0
        if len(text) <= chunk:
            return self.count_from_blank(text)
        full = " " + text
        return self.finish(self.scan([self.chunk_map(full[i : i + chunk]) for i in range(0, len(full), chunk)]))


_compiled: dict[int, Transducer] = {}


def _transducer(key: int, model: bytes) -> Transducer:
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(read_pieces(model))
    return _compiled[key]


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096, chunk: int = CHUNK_CHARS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to ``docs`` (the text column itself is dropped).

    The model file (a vocabulary of bounded size) is read on the driver and
    broadcast, so executors need no copy of it.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    read_pieces(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    size = F.octet_length("__text")
    rows = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(hash(shared.value), shared.value)
        for batch in pieces(batches):
            texts = batch.column(len(keep))
            counts = [0 if t is None else machine.count(t, chunk) for t in texts.to_pylist()]
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, sizes, pa.array(counts, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    short = rows.where(F.coalesce(size, F.lit(0)) <= long_bytes).mapInArrow(run, docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long"))
    placed = with_places(rows, "token-rows").where(size > long_bytes)
    counted = _count_long(placed.select("__file", "__at", "__text"), shared, chunk)
    long = placed.select(*keep, "__file", "__at", size.cast("long").alias("n_bytes")).join(counted, ["__file", "__at"]).select(*keep, "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


MAP = "__file long, __at long, number long, head string, n long, rest string"


def _count_long(texts: DataFrame, shared, chunk: int) -> DataFrame:
    """(__file, __at, n_tokens) of long texts: chunks are dealt over tasks, their maps meet and compose per text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = " " + text
                for number, begin in enumerate(range(0, len(full), chunk)):
                    yield pa.RecordBatch.from_pydict({"__file": [file], "__at": [at], "number": [number], "chunk": [full[begin : begin + chunk]]})

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(hash(shared.value), shared.value)
        for batch in batches:
            made = [machine.chunk_map(t) for t in batch.column(3).to_pylist()]
            parts = [(m[0], None, None) if len(m) == 1 else m for m in made]
            cols = [pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *cols], names=["__file", "__at", "number", "head", "n", "rest"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(hash(shared.value), shared.value)
        for batch in batches:
            totals = []
            for rows in batch.column(2).to_pylist():
                ordered = [(r["head"],) if r["n"] is None else (r["head"], r["n"], r["rest"]) for r in rows]
                totals.append(machine.finish(machine.scan(ordered)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64())], names=["__file", "__at", "n_tokens"])

    chunks = texts.mapInArrow(cut, "__file long, __at long, number long, chunk string").repartition("__file", "__at", "number")
    met = chunks.mapInArrow(maps, MAP).groupBy("__file", "__at").agg(F.sort_array(F.collect_list(F.struct("number", "head", "n", "rest"))).alias("maps"))
    return met.mapInArrow(fold, "__file long, __at long, n_tokens long")
