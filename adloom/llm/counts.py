"""Token counts by a finite-state transducer compiled from a word-level BPE vocabulary.

The vocabulary's library finds special strings in the raw text, normalises what lies
between them (canonical composition, lower case), splits it into words, numbers, runs of
other signs and contractions, and merges the bytes of each piece, the last of which carries
a mark. Here all of that after normalisation is one deterministic transducer over
characters. A state holds how the split stands and, of the open piece, every place from
which a token may still reach over its end: where the vocabulary's tree has got to from
there, the last token before it, and how many tokens come before it beyond those emitted.
The tokens that every continuation shares are emitted on the transitions. States and
transitions are compiled when they are first met; a fixed number of them is kept.

A chunk of text acts on states as a map: it is fixed from the first place on after which
the state does not depend on the entry (white space or a number), and before that it is the
text itself. Maps compose associatively, so a prefix scan over the chunks of a text gives
the count up to each of them. Chunks between white space map the start to itself; their
scan is a running sum, and each distinct one is mapped once.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted
each for itself. Very long texts, also without white space, take time in proportion to
their length. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from adloom.llm import common as C
from adloom.llm.bpe import Encoder

LIMIT = 2048
#: Characters that one map stands for; only runs without ASCII white space can be longer.
CHUNK = 4096
#: States and counted chunks that a task remembers (chunks twice over), and their length.
STATES = 250_000
CACHE = 200_000
CACHED_BYTES = 64
COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# The vocabulary's mark of a piece's end, and its contractions by their length.
END_MARK = "</w>"
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = {"r": "e", "v": "e", "l": "l"}

GAP, LETTERS, OTHERS, APOSTROPHE = "gap", "letters", "others", "'"
SPACE, LETTER, NUMBER, OTHER = "space", "letter", "number", "other"
#: Places from which tokens may reach on: node of the tree, last token, tokens before.
Places = tuple[tuple[int, int, int], ...]
NOTHING: Places = ((0, -1, 0),)


class Vocabulary:
    """Tokens as strings of symbols: 256 bytes, and 256 bytes with the mark of the end.

    Ids rise in the order of merging, so that they can stand for ranks.
    """

    #: Whether two tokens may be neighbours, told by taking their merges apart.
    may_follow = Encoder.may_follow

    def __init__(self, text: str) -> None:
        whole = json.loads(text)
        model = whole["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END_MARK:
            raise ValueError("not a BPE vocabulary with marked word ends")
        names = sorted(model["vocab"], key=model["vocab"].get)
        self.parts = [(i, i) for i in range(len(names))]
        self.merge: dict[tuple[int, int], int] = {}
        number = model["vocab"]
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = number[left + right]
            self.parts[made] = number[left], number[right]
            self.merge[self.parts[made]] = made
        self.special = [t["content"] for t in whole["added_tokens"] if t["special"]]
        #: Tree of all tokens by symbols, and the token that ends at each node.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        byte_of = {sign: byte for byte, sign in enumerate(byte_signs())}
        for name in names:
            self._add(name, number[name], byte_of)

    def _add(self, name: str, token: int, byte_of: dict[str, int]) -> None:
        marked = name.endswith(END_MARK)
        symbols = [byte_of[sign] for sign in (name.removesuffix(END_MARK) if marked else name)]
        if marked:
            symbols[-1] += 256
        node = 0
        for symbol in symbols:
            self.inner[node] = True
            key = node << 9 | symbol
            node = self.child.get(key, 0)
            if not node:
                node = self.child[key] = len(self.token)
                self.token.append(-1)
                self.inner.append(False)
        self.token[node] = token


def byte_signs() -> list[str]:
    """The sign that stands for each byte: itself where it prints, else one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in printed else next(others)) for byte in range(256)]


class State(dict):
    """Transitions by character: the next state and the tokens emitted on the way."""

    __slots__ = ("machine", "mode", "places", "held", "then", "end")

    def __init__(self, machine: Machine, mode: str, places: Places, held: int) -> None:
        self.machine, self.mode, self.places, self.held = machine, mode, places, held
        #: Places after the byte that is held back, and tokens emitted if the text ends.
        self.then: tuple[Places, int] | None = None
        self.end: int | None = None

    def __missing__(self, sign: str) -> tuple[State, int]:
        found = self[sign] = self.machine.compiled(self, sign)
        return found


class Machine:
    """The transducer, compiled as far as texts have led."""

    def __init__(self, vocabulary: Vocabulary, most_states: int = STATES) -> None:
        self.vocabulary, self.most_states = vocabulary, most_states
        self.kinds: dict[str, str] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(GAP, (), -1)
        self.fits.clear()

    def state(self, mode: str, places: Places, held: int) -> State:
        key = mode, places, held
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, *key)
        return found

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for sign in text:
            state, emitted = state[sign]
            total += emitted
        return state, total

    def close(self, state: State) -> int:
        """Tokens emitted where the text ends."""
        if state.end is None:
            state.end = 0
            if state.mode != GAP:
                state.end = self.feed(state.places, state.held + 256)[1]
            if state.mode in LONG_ENDINGS:
                state.end += self.alone(state.mode)
        return state.end

    def alone(self, sign: str) -> int:
        """Tokens of a character that is a piece by itself."""
        state, emitted = self.opened(LETTERS, sign)
        return emitted + self.close(state)

    def compiled(self, state: State, sign: str) -> tuple[State, int]:
        mode = state.mode
        if mode == APOSTROPHE and sign in SHORT_ENDINGS:
            return self.start, self.closed_with(state, sign)
        if mode == APOSTROPHE and sign in LONG_ENDINGS:
            return self.state(sign, state.places, state.held), 0
        if mode in LONG_ENDINGS:
            if sign == LONG_ENDINGS[mode]:
                return self.start, self.closed_with(state, mode + sign)
            # The apostrophe stands alone, and the letter after it opens a piece.
            _, before = self.feed(state.places, state.held + 256)
            then, emitted = self.opened(LETTERS, mode)[0][sign]
            return then, before + emitted
        kind = self.kind(sign)
        if (mode, kind) == (LETTERS, LETTER):
            return self.extended(state, LETTERS, sign)
        if mode in (OTHERS, APOSTROPHE) and kind == OTHER:
            return self.extended(state, OTHERS, sign)
        emitted = self.close(state)
        if kind == SPACE:
            return self.start, emitted
        if kind == NUMBER:
            return self.start, emitted + self.alone(sign)
        mode = APOSTROPHE if sign == "'" else LETTERS if kind == LETTER else OTHERS
        then, first = self.opened(mode, sign)
        return then, emitted + first

    def opened(self, mode: str, sign: str) -> tuple[State, int]:
        first, *rest = sign.encode()
        return self.extend(mode, NOTHING, 0, first, rest)

    def extended(self, state: State, mode: str, signs: str) -> tuple[State, int]:
        if state.then is None:
            state.then = self.feed(state.places, state.held)
        first, *rest = signs.encode()
        return self.extend(mode, *state.then, first, rest)

    def extend(
        self, mode: str, places: Places, emitted: int, held: int, more: list[int]
    ) -> tuple[State, int]:
        for byte in more:
            places, settled = self.feed(places, held)
            emitted, held = emitted + settled, byte
        return self.state(mode, places, held), emitted

    def closed_with(self, state: State, signs: str) -> int:
        """What the open piece emits if it ends with the given characters."""
        last, emitted = self.extended(state, OTHERS, signs)
        return emitted + self.close(last)

    def feed(self, places: Places, symbol: int) -> tuple[Places, int]:
        """The places after one more symbol, and the tokens that are settled by it.

        Of the tokens that end here exactly one may follow the last token before it. With
        the mark of the end no token reaches on, so all tokens of the piece are settled.
        """
        tree, going, found = self.vocabulary, [], None
        for node, last, before in places:
            child = tree.child.get(node << 9 | symbol)
            if child is None:
                continue
            token = tree.token[child]
            if found is None and token >= 0 and (last < 0 or self.fit(last, token)):
                found = token, before + 1
            if tree.inner[child]:
                going.append((child, last, before))
        if found is None:
            raise ValueError("the vocabulary lacks a byte")
        going.append((0, *found))
        settled = min(before for _, _, before in going)
        return tuple((node, last, before - settled) for node, last, before in going), settled

    def fit(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.vocabulary.may_follow(left, right)
        return known

    def kind(self, sign: str) -> str:
        """What the library's own expressions take a character for."""
        known = self.kinds.get(sign)
        if known is None:
            known = next((k for k, match in KINDS if match.pre_tokenize_str(sign)), OTHER)
            self.kinds[sign] = known
        return known


KINDS = [
    (kind, pre_tokenizers.Split(Regex(pattern), "removed", invert=True))
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}"))
]
_COMPOSED, _LOWER = normalizers.NFC().normalize_str, normalizers.Lowercase().normalize_str


def normalised(text: str) -> str:
    return text.lower() if text.isascii() else _LOWER(_COMPOSED(text))


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to a state: ``head`` is run from the entry; if there is an
    ``exit``, the rest emits ``emitted`` tokens and ends there whatever the entry was."""

    head: str
    emitted: int = 0
    exit: State | None = None

    def apply(self, machine: Machine, entry: State) -> tuple[State, int]:
        state, total = machine.run(entry, self.head)
        return (state, total) if self.exit is None else (self.exit, total + self.emitted)


def chunk_map(machine: Machine, chunk: str) -> StateMap:
    for at, sign in enumerate(chunk, 1):
        if machine.kind(sign) in (SPACE, NUMBER):
            state, emitted = machine.run(machine.start, chunk[at:])
            return StateMap(chunk[:at], emitted, state)
    return StateMap(chunk)


def composed(machine: Machine, first: StateMap, then: StateMap) -> StateMap:
    if first.exit is None:
        return StateMap(first.head + then.head, then.emitted, then.exit)
    state, emitted = then.apply(machine, first.exit)
    return StateMap(first.head, first.emitted + emitted, state)


def prefix_scan(maps: list[StateMap], join: Callable[[StateMap, StateMap], StateMap]) -> list[StateMap]:
    """The composition of every prefix, in rounds whose parts don't wait for each other:
    neighbours are joined in pairs, the pairs scanned, and what lies between filled in."""
    if len(maps) < 2:
        return maps
    pairs = prefix_scan([join(a, b) for a, b in zip(maps[::2], maps[1::2])], join)
    between = [join(pair, single) for pair, single in zip(pairs, maps[2::2])]
    result = maps[:1]
    for at, pair in enumerate(pairs):
        result.append(pair)
        result += between[at : at + 1]
    return result


class Counter:
    """Counts the tokens of texts; remembers short chunks."""

    def __init__(self, vocabulary: Vocabulary, chunk: int = CHUNK) -> None:
        self.machine, self.chunk = Machine(vocabulary), chunk
        found = "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
        self.special = regex.compile(found or "(?!)")
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def running(self, text: str) -> list[int]:
        """Tokens settled up to the end of each chunk of a normalised text, and at its end."""
        machine = self.machine
        cut = [text[i : i + self.chunk] for i in range(0, len(text), self.chunk)]
        # The scan begins with the map of no text at all, whose exit is the start.
        maps = [StateMap("", 0, machine.start), *(chunk_map(machine, c) for c in cut)]
        scanned = prefix_scan(maps, lambda a, b: composed(machine, a, b))
        counts = [prefix.emitted for prefix in scanned]
        return [*counts[1:], counts[-1] + machine.close(scanned[-1].exit)]

    def count(self, text: str) -> int:
        """Tokens of a text, special strings included."""
        machine = self.machine
        if len(machine.states) > machine.most_states:
            machine.forget()
        parts = self.special.split(text) if "<" in text else [text]
        total = len(parts) - 1
        for part in map(normalised, parts):
            if len(part) > self.chunk:
                total += self.running(part)[-1]
            else:
                state = machine.start
                for sign in part:
                    state, emitted = state[sign]
                    total += emitted
                total += machine.close(state) if state.end is None else state.end
        return total

    def count_chunk(self, raw: bytes) -> int:
        """The same for a run without ASCII white space."""
        n = self.known.get(raw)
        if n is None:
            n = self.older.get(raw)
            if n is None:
                n = self.count(raw.decode())
            if len(raw) <= CACHED_BYTES:
                if len(self.known) >= CACHE:
                    self.older, self.known = self.known, {}
                self.known[raw] = n
        return n

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text: the running sum of its chunks, each distinct one counted once."""
        found = C.words(texts)
        number, names = found.encode()
        each = np.array([self.count_chunk(name) for name in names], np.int64)
        return C.per_text(each[number] if len(names) else number, found.first)


@lru_cache(maxsize=1)
def counter(vocabulary: str) -> Counter:
    """The counter of a worker, which later tasks go on with."""
    return Counter(Vocabulary(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every text, and whether it is longer than a limit.

    ``vocabulary`` is the path of a tokenizer file; its text, a few megabytes whatever the
    input, goes to the workers.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(shared.value)
        for batch in batches:
            for part in C.slices(batch):
                texts = part.column("text")
                n = mine.counts(texts)
                size = np.diff(C.padded(texts)[1]) - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", C.text_or_empty()).mapInArrow(run, COUNTED)
