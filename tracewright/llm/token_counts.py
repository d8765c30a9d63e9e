"""Token counts by a compiled transducer.

A tokenizer file is compiled, as texts need it, to a deterministic finite-state transducer over code points, whose transitions
carry the number of tokens by which the count changes. Within a word it tracks the last token of the encoding of each prefix
that a later token may still begin at: a sequence of tokens is the encoding of its text exactly if each two neighbours are
the encoding of their own text, so the last token of a longer prefix is the one that fits behind an earlier prefix's.
No token is longer than the vocabulary's longest, so states look back a bounded stretch and are finitely many; equal ones are one.

A chunk of a text is a map from entry states to (exit state, tokens). White space leads from every state to the start,
so the maps need the transducer again only for what stands before their first white space. Maps compose associatively, and
a prefix scan over the maps of a text's chunks gives its count at the end of every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, calm, map_arrow, slices
from .wordbpe import BITS, byte_letters, load

#: Code points of a chunk.
CHUNK = 1 << 16
#: Transitions that a worker keeps; beyond, it compiles anew.
MOST_EDGES = 1_500_000

_white = regex.compile(f"[{WHITE}]")


class State(dict):
    """A state: from a code point to (next state, change of the count). Edges are compiled when first asked for.

    kind: S the start, L and O within a word of letters or of other marks, E within an ending such as 're. tail: the longest
    end of the word's bytes that a token begins with (E: what of the ending is read); window: of each prefix of the word
    from there on, its last token (-1: none, the word begins) and how many tokens it has less than the whole.
    """

    __slots__ = ("close", "kind", "machine", "tail", "window")

    def __init__(self, machine: Transducer, kind: str, tail: bytes | str = b"", window: tuple = ((-1, 0),)):
        super().__init__()
        self.machine, self.kind, self.tail, self.window, self.close = machine, kind, tail, window, None

    def __missing__(self, c: str) -> tuple[State, int]:
        edge = self[c] = self.machine.compile(self, c)
        return edge

    def end(self) -> int:
        """The change of the count when the text or word ends here."""
        if self.close is None:
            self.close = self.machine.closing(self)
        return self.close


class Transducer:
    ENDINGS = {"'": "stmd", "'r": "e", "'v": "e", "'l": "l"}

    def __init__(self, path: str):
        self.bpe = bpe = load(path)
        value = {c: b for b, c in enumerate(byte_letters())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        n = len(bpe.suffix)
        for token, i in bpe.vocab.items():
            ends = n and token.endswith(bpe.suffix)
            if token not in bpe.special:
                (self.final if ends else self.inner)[bytes(value[c] for c in (token[:-n] if ends else token))] = i
        self.begins = {t[:k] for v in (self.inner, self.final) for t in v for k in range(1, len(t) + 1)}
        self.symbols = {i: [bpe.inner[b] for b in t] for t, i in self.inner.items()}
        self.symbols |= {i: [*(bpe.inner[b] for b in t[:-1]), bpe.last[t[-1]]] for t, i in self.final.items()}
        self._reset()

    def _reset(self) -> None:
        self.start, self.states, self.edges = State(self, "S"), {}, 0
        self.pairs: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a (-1: none) and b are the encoding of their own text."""
        key = (a + 1) << BITS | b
        if (known := self.pairs.get(key)) is None:
            left = self.symbols[a] if a >= 0 else []
            known = self.pairs[key] = self.bpe.merged([*left, *self.symbols[b]]) == ([a, b] if a >= 0 else [b])
        return known

    def _last(self, tail: bytes, window: tuple, tokens: dict[bytes, int]) -> tuple[int, int]:
        """The last token of a prefix that ends with `tail`, and the count behind the whole of the window."""
        for k, (before, less) in enumerate(window):
            if (t := tokens.get(tail[k:])) is not None and self.fits(before, t):
                return t, 1 - less
        raise ValueError(f"no token ends {tail!r}")

    def _feed(self, state: State, c: str) -> tuple[State, int]:
        """One more code point of the word."""
        tail, window, change = state.tail, state.window, 0
        for b in c.encode():
            tail += bytes((b,))
            last, more = self._last(tail, window, self.inner)
            change += more
            window = (*((t, less + more) for t, less in window), (last, 0))
            k = 0
            while k < len(tail) and tail[k:] not in self.begins:
                k += 1
            tail, window = tail[k:], window[k:]
        return self._state(state.kind, tail, window), change

    def _state(self, kind: str, tail: bytes | str, window: tuple = ()) -> State:
        key = (kind, tail, window)
        if (found := self.states.get(key)) is None:
            found = self.states[key] = State(self, *key)
        return found

    def _word(self, kind: str, text: str) -> tuple[State, int]:
        """The state and count within a word that begins with `text`."""
        state, n = State(self, kind), 0
        for c in text:
            state, more = self._feed(state, c)
            n += more
        return state, n

    def closing(self, state: State) -> int:
        if state.kind == "S":
            return 0
        if state.kind == "E":
            return sum(len(self.bpe.merge(c)) for c in state.tail)
        return self._last(state.tail, state.window[:-1], self.final)[1]

    def compile(self, state: State, c: str) -> tuple[State, int]:
        self.edges += 1
        kind, of = state.kind, self.bpe.kind(c)
        if kind == of:  # L or O
            return self._feed(state, c)
        if kind == "E":
            read = state.tail
            if c in self.ENDINGS[read]:
                return self.start, len(self.bpe.merge(read + c))
            if read == "'" and c in "rvl":
                return self._state("E", read + c), 0
            if read == "'" and of == "O":
                return self._word("O", read + c)
            if of == "L" and len(read) == 2:  # the apostrophe stood alone; its letter begins a word
                to, n = self._word("L", read[1] + c)
                return to, len(self.bpe.merge("'")) + n
        n = state.end()
        if of == "W":
            return self.start, n
        if of == "N":
            return self.start, n + len(self.bpe.merge(c))
        if c == "'":
            return self._state("E", c), n
        to, more = self._word(of, c)
        return to, n + more

    def walk(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for c in text:
            state, more = state[c]
            n += more
        return state, n

    def maps(self, text: str, chunk: int = CHUNK) -> list[ChunkMap]:
        return [ChunkMap(self, text[i : i + chunk]) for i in range(0, len(text), chunk)]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; special strings count as one each."""
        if self.edges > MOST_EDGES:
            self._reset()
        n = at = 0
        if self.bpe.cut is not None and "<|" in text:
            for m in self.bpe.cut.finditer(text):
                n += 1 + self.plain(text[at : m.start()], chunk)
                at = m.end()
        return n + self.plain(text[at:] if at else text, chunk)

    def plain(self, text: str, chunk: int) -> int:
        scanned = scan(self.maps(self.bpe.normal(text), chunk))
        if not scanned:
            return 0
        state, n = scanned[-1].at(self.start)
        return n + state.end()


class ChunkMap:
    """The map of a chunk of normalised text from entry states to (exit state, tokens)."""

    def __init__(self, machine: Transducer, text: str):
        white = _white.search(text)
        self.machine, self.head = machine, text[: white.end()] if white else text
        #: What follows the first white space, from the start state; None: there is no white space.
        self.rest = machine.walk(machine.start, text[white.end() :]) if white else None
        self.known: dict[int, tuple[State, int]] = {}

    def at(self, state: State) -> tuple[State, int]:
        if (found := self.known.get(id(state))) is None:
            to, n = self.machine.walk(state, self.head)
            found = (self.rest[0], n + self.rest[1]) if self.rest else (to, n)
            self.known[id(state)] = found
        return found


class Composed:
    """First a's map, then b's."""

    def __init__(self, a: ChunkMap | Composed, b: ChunkMap | Composed):
        self.a, self.b = a, b
        self.known: dict[int, tuple[State, int]] = {}

    def at(self, state: State) -> tuple[State, int]:
        if (found := self.known.get(id(state))) is None:
            between, n = self.a.at(state)
            to, more = self.b.at(between)
            found = self.known[id(state)] = to, n + more
        return found


def scan(maps: list) -> list:
    """The inclusive prefix scan: the k-th is the map of the first k + 1 chunks, in as many rounds as the logarithm of their number."""
    step = 1
    while step < len(maps):
        maps = [Composed(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


@lru_cache(maxsize=1)
def transducer_of(path: str) -> Transducer:
    """One per worker process: what it has compiled serves its later tasks too."""
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) instead of the text.

    A null text counts as empty: 0 bytes, 0 tokens. Nothing is cut off or padded; special strings in a text count as one
    token. Repeated rows give repeated rows; other columns stay as they are, but a column of docs named n_bytes, n_tokens
    or over_limit gives way to the new one. An empty table gives an empty one. Needs no shuffle.
    """
    made = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in docs.columns if c not in [text, *made]]
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).withColumn("n_tokens", F.lit(0).cast("long")).withColumn("n_bytes", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm()
        transducer = transducer_of(path)
        for part in slices(batches, text):
            n = [transducer.count(x, chunk) if x else 0 for x in part.column(part.num_columns - 2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(n, pa.int64()), part.columns[-1]], names=schema.names)

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"))
    return map_arrow(rows, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
