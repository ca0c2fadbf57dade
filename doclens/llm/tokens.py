"""Token counts by compiled finite-state transducers, without running the tokenizer.

Two deterministic transducers make up a byte-level BPE tokenizer. The splitter reads
character classes and marks where pieces start; chunks of a text are turned into maps from
entry state to exit state at the same time, a parallel prefix scan composes the maps, and
with its entry state known every chunk marks its pieces. The merger reads the bytes of a
piece; each transition carries the change in the number of tokens emitted. Its states are
determined when first reached, as the whole machine would not fit in memory.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.shared import documents

LIMIT = 1024
#: Characters of one scan step, and of the texts that are scanned together.
CHUNK, STREAM = 128, 1_000_000
#: Entries at which a worker's piece counts, or its transitions, are forgotten and made anew.
MAX_PIECES, MAX_TRANSITIONS = 400_000, 1_000_000

# Character classes of the splitter; the letters s t m d, r v, e and l matter after an apostrophe.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, ONE, TWO, E, EL, RESET = range(11)
# States: what the piece being read is made of.
START, IN_L, IN_N, IN_O, IN_SPACE, IN_BLANK, IN_QUOTE, IN_QUOTE_TWO, IN_QUOTE_L = range(9)
N_STATES = 9
#: Output bits: a piece starts at this character; one starts at the character before.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output bits), by class and state."""
    to = np.zeros((11, N_STATES), np.int8)
    out = np.zeros((11, N_STATES), np.int8)
    runs = {LETTER: IN_L, ONE: IN_L, TWO: IN_L, E: IN_L, EL: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_QUOTE, SPACE: IN_SPACE, BLANK: IN_BLANK}

    def plain(state: int, c: int) -> tuple[int, int]:
        target = runs[c]
        if state == IN_O and c == QUOTE:
            return IN_O, 0
        same = state == target and target in (IN_L, IN_N, IN_O)
        blank = state in (IN_SPACE, IN_BLANK)
        if c in (SPACE, BLANK):
            return target, 0 if blank else HERE
        if state == IN_SPACE:  # the last space of a run belongs to what follows
            return (IN_O if c == QUOTE else target), BEFORE
        if state == IN_BLANK:
            return target, BEFORE | HERE
        return target, 0 if same else HERE

    for c in range(RESET):
        for state in range(N_STATES):
            if state == IN_QUOTE:
                if c == ONE:
                    new = START, 0
                elif c == TWO:
                    new = IN_QUOTE_TWO, 0
                elif c == EL:
                    new = IN_QUOTE_L, 0
                elif c in (OTHER, QUOTE):
                    new = IN_O, 0
                else:
                    new = plain(START, c)
            elif state in (IN_QUOTE_TWO, IN_QUOTE_L):
                if c == (E if state == IN_QUOTE_TWO else EL):
                    new = START, 0
                else:  # no contraction: the letter after the apostrophe starts a piece
                    target, bits = plain(IN_L, c)
                    new = target, bits | BEFORE
            else:
                new = plain(state, c)
            to[c, state], out[c, state] = new
    for state in (IN_QUOTE_TWO, IN_QUOTE_L):  # the text ends inside "'r", "'v" or "'l"
        out[RESET, state] = BEFORE
    return to, out


def class_table() -> np.ndarray:
    """Class of every code point, from Unicode's letters, numbers and white space."""
    import regex

    table = np.full(0x110000, OTHER, np.int8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            points = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            table[points] = code
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for letters, code in (("stmd", ONE), ("rv", TWO), ("e", E), ("l", EL)):
        table[[ord(c) for c in letters]] = code
    return table


def piece_starts(classes: np.ndarray, machine: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a piece starts at each position of a stream of classes that ends with RESET."""
    to, out = machine
    n = len(classes)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, RESET, np.int8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    flat = to.ravel()
    # State map of each chunk: where it would end from every state.
    maps = np.tile(np.arange(N_STATES, dtype=np.int8), (rows, 1))
    for column in columns:
        maps = flat[column[:, None].astype(np.int16) * N_STATES + maps]
    # Prefix scan: after the step of width w, a row holds the map of the 2 w chunks that end with it.
    width = 1
    while width < rows:
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].astype(np.int64), axis=1)
        width *= 2
    state = np.concatenate([[np.int8(START)], maps[:-1, START]])
    bits = np.zeros((CHUNK, rows), np.int8)
    flat_out = out.ravel()
    for k, column in enumerate(columns):
        at = column.astype(np.int16) * N_STATES + state
        bits[k] = flat_out[at]
        state = flat[at]
    marks = bits.T.ravel()[:n]
    starts = (marks & HERE) > 0
    starts[:-1] |= (marks[1:] & BEFORE) > 0
    return starts


#: Bits of a change in a packed transition. A change is at most as large as the longest token has bytes, which the machine checks.
CHANGE_BITS = 24
CHANGE_ZERO, CHANGE_MASK = 1 << CHANGE_BITS - 1, (1 << CHANGE_BITS) - 1


class Merger:
    """Transducer of the merges: reads a piece's bytes and counts its tokens.

    A state is what decides the future of a piece: the longest suffix that begins a token,
    and for each of that suffix's positions the last token of the text up to there and the
    tokens between there and here. Up to any position the last token is the only one whose
    seam with the last token before it no merge would close.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self.made = {token: self.rank[pair] for token, pair in self.parts.items()}
        if max(map(len, self.parts), default=0) >= CHANGE_ZERO:
            raise ValueError(f"tokens of {CHANGE_ZERO} bytes and more are not counted")
        # Nodes are the prefixes of tokens.
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for word in [bytes([b]) for b in range(256)] + list(self.parts):
            node = 0
            for b in word:
                step = self.children[node].get(b)
                if step is None:
                    step = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = step
            self.token[node] = word
        size = len(self.children)
        self.fail, self.depth, self.up = [0] * size, [0] * size, [0] * size
        queue = deque(self.children[0].values())
        for child in queue:
            self.depth[child] = 1
        while queue:
            node = queue.popleft()
            fail = self.fail[node]
            self.up[node] = fail if self.token[fail] is not None else self.up[fail]
            for b, child in self.children[node].items():
                self.depth[child] = self.depth[node] + 1
                at = fail
                while at and b not in self.children[at]:
                    at = self.fail[at]
                self.fail[child] = self.children[at].get(b, 0) if node else 0
                queue.append(child)
        self.seams: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.forget()

    def forget(self) -> None:
        start = (0, (None,), (0,))
        self.states, self.ids = [start], {start: 0}
        self.moves: dict[int, int] = {}
        self.pieces: dict[str, int] = {}

    def seam_holds(self, a: bytes, b: bytes) -> bool:
        """Whether no merge ever joins tokens a and b where they touch.

        Going back in time, the part made last is undone first: what touches at the seam gets
        smaller, and a merge there wins if it comes before that part was made. Of merges of
        the same rank the left one comes first.
        """
        found = self.seams.get((a, b))
        if found is None:
            left, right, limit = a, b, len(self.rank)
            found = True
            while True:
                if self.rank.get((left, right), limit) < limit:
                    found = False
                    break
                made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
                if made_left < 0 and made_right < 0:
                    break
                if made_left > made_right:
                    limit, left = made_left, self.parts[left][1]
                else:
                    limit, right = made_right + 1, self.parts[right][0]
            if len(self.seams) > MAX_TRANSITIONS:
                self.seams.clear()
            self.seams[a, b] = found
        return found

    def stands_alone(self, token: bytes) -> bool:
        """Whether merging the token's own bytes gives the token."""
        found = self.whole.get(token)
        if found is None:
            parts = [bytes([b]) for b in token]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), len(self.rank)))
                if (parts[best], parts[best + 1]) not in self.rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            found = self.whole[token] = len(parts) == 1
        return found

    def move(self, state: int, b: int) -> int:
        """Makes the transition of state by byte b: next state and change of the count, packed (see CHANGE_BITS)."""
        node, last, back = self.states[state]
        at = node
        while at and b not in self.children[at]:
            at = self.fail[at]
        at = self.children[at].get(b, 0)
        here = at if self.token[at] is not None else self.up[at]
        while True:
            token = self.token[here]
            k = len(token) - 1  # tokens end here and start k + 1 bytes back: k positions before the last one
            before = last[k]
            if self.stands_alone(token) if before is None else self.seam_holds(before, token):
                break
            here = self.up[here]
        change = 1 + back[k]
        keep = self.depth[at]
        key = (at, (token, *last[:keep]), (0, *[x - change for x in back[:keep]]))
        new = self.ids.get(key)
        if new is None:
            new = self.ids[key] = len(self.states)
            self.states.append(key)
        packed = self.moves[state << 8 | b] = new << CHANGE_BITS | change + CHANGE_ZERO
        return packed

    def count(self, piece: str) -> int:
        state = total = 0
        moves = self.moves
        for b in piece.encode():
            packed = moves.get(state << 8 | b)
            if packed is None:
                packed = self.move(state, b)
            state = packed >> CHANGE_BITS
            total += (packed & CHANGE_MASK) - CHANGE_ZERO
        return total

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.pieces
        found = list(map(known.get, pieces))
        if None in found:
            if len(known) > MAX_PIECES or len(self.moves) > MAX_TRANSITIONS:
                self.forget()
                known = self.pieces
            for k, n in enumerate(found):
                if n is None:
                    piece = pieces[k]
                    n = known.get(piece)
                    if n is None:
                        n = known[piece] = self.count(piece)
                    found[k] = n
        return found


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def tokenizer_parts(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """(merges, special strings) of a byte-level BPE tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    merges = [tuple(bytes(letters[c] for c in side) for side in pair) for pair in pairs]
    return merges, [t["content"] for t in data.get("added_tokens", [])]


class Counter:
    """Counts tokens of texts; made once in each worker from the tokenizer's merges and special strings."""

    def __init__(self, merges: list[tuple[bytes, bytes]], specials: list[str]):
        self.merger, self.machine, self.table = Merger(merges), splitter(), class_table()
        longest_first = sorted(specials, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, longest_first))) if specials else None
        # A single line end between other characters is a piece of its own: a long text may be cut after it.
        self.cut = re.compile(r"(?<=\S)\n(?=\S)")

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, cut into stretches of about STREAM characters; and how many specials."""
        if self.specials is None:
            parts, specials = [text], 0
        else:
            parts = self.specials.split(text)
            specials = len(parts) - 1
        out = []
        for part in parts:
            while len(part) > STREAM and (m := self.cut.search(part, STREAM)):
                out.append(part[: m.end()])
                part = part[m.end() :]
            out.append(part)
        return [p for p in out if p], specials

    def stream(self, segments: list[str]) -> list[int]:
        """Tokens of each segment."""
        if not segments:
            return []
        lengths = np.array([len(s) + 1 for s in segments])
        joined = "\n".join(segments) + "\n"
        classes = self.table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(lengths)
        classes[ends - 1] = RESET
        starts = piece_starts(classes, self.machine)
        starts[ends - 1] = True  # the piece before a RESET ends there
        at = np.flatnonzero(starts)
        cuts = at.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:] + [len(joined)], strict=True)]
        found = np.array(self.merger.counts(pieces), np.int64)
        found[classes[at] == RESET] = 0
        first = np.searchsorted(at, np.concatenate([[0], ends[:-1]]))
        return np.add.reduceat(found, first).tolist()

    def count(self, texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        waiting, owners, size = [], [], 0
        for k, text in enumerate(texts):
            segments, specials = self.segments(text or "")
            totals[k] += specials
            for s in segments:
                waiting.append(s)
                owners.append(k)
                size += len(s)
                if size >= STREAM:
                    for owner, n in zip(owners, self.stream(waiting), strict=True):
                        totals[owner] += n
                    waiting, owners, size = [], [], 0
        for owner, n in zip(owners, self.stream(waiting), strict=True):
            totals[owner] += n
        return totals


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, for the byte-level BPE tokenizer at path.

    Counts are those of the tokenizer without special tokens around a text; a special string
    inside a text is one token. Null texts count as empty and have none; repeated rows are
    counted each; null ids are kept; other columns are left out; empty input gives an empty
    result. The tokenizer's merges are shipped to the executors: they are as many for any corpus.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_parts(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(*shipped.value))
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                totals = counter.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
                )

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.octet_length(F.coalesce(text_col, F.lit(""))).cast("bigint").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
