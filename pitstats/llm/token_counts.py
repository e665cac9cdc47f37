"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer.

The transducer reads characters and emits, on each transition, by how much the number of tokens grows. It composes
two machines. The splitter follows the pre-tokenisation pattern with one character of lookahead. The merge machine
rests on two properties of BPE: the tokens of a prefix are unique, and a sequence of tokens is the encoding of its
bytes exactly if each adjacent pair is. Its state is therefore finite: for each start at which a token may still be
open, the place in the vocabulary's trie, the token that ends there, and the count relative to now. States and
transitions are compiled when first taken and dropped together when there are too many.

Texts longer than a chunk are cut into chunks that are spread over the cluster. A chunk's state map says for each entry
state how many tokens it emits and in which state it leaves. All states meet in the start state wherever a pre-token
must end (a run of letters or digits at any other character, a mark at a blank or digit, a mark but the apostrophe at a
letter), so the map is kept as its head (up to the first such place, to be run from the entry state), the count
between, and its tail (from the last one, run from the start state). Maps compose associatively; a parallel prefix scan
over a text's chunks composes them pairwise in log steps, and groups of chunks in as many rounds of Spark as a text's
length needs. Only a run of one kind of character that is longer than a chunk has no such place and is kept as text.

The splitting pattern, the special tokens and the absence of a normalizer are read from the tokenizer file; a file with
another pattern is refused.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts may be of any length; special strings in a text
are one token each, as the library's default has it; repeated rows and rows without an id each give their own row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitstats.llm.byte_bpe import byte_alphabet
from pitstats.llm.common import in_batches, texts_of

#: Transitions kept by one task before its compiled machine is dropped and compiled anew.
MAX_TRANSITIONS = 700_000
#: Characters of a chunk, and chunks that one task composes.
CHUNK, FAN = 1 << 15, 64
#: The splitting pattern of the library's byte-level pre-tokenizer, for which the splitter is made: a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeMachine:
    """Bytes of one pre-token -> growth of its number of tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        value = {c: b for b, c in enumerate(byte_alphabet())}
        of = {token: bytes(value[c] for c in token) for token in vocab}
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in reversed(merges)}
        self.trie: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        size = 1
        for token, bytes_ in of.items():
            if len(bytes_) > 1 and vocab[token] not in self.parts:
                continue  # no merge makes it, so it never occurs
            node = 0
            for b in bytes_:
                nxt = self.trie.get((node, b))
                if nxt is None:
                    nxt = self.trie[node, b] = size
                    size += 1
                node = nxt
            self.token_at[node] = vocab[token]
        self.open_nodes = frozenset(node for node, _ in self.trie)
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._adjacent: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.starts: list[tuple] = []
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._adjacent.clear()
        self.start = self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.starts)
            self.starts.append(key)
        return number

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Symbols at one edge of a token while it is being merged, each with the rank at which it is merged away."""
        store = self._right if side else self._left
        spine = store.get(token)
        if spine is None:
            inner = self.parts.get(token)
            if inner is None:
                spine = [(token, float("inf"))]
            else:
                below = self._spine(inner[side], side)
                spine = [*below[:-1], (below[-1][0], self.rank[inner]), (token, float("inf"))]
            store[token] = spine
        return spine

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens together are encoded as these two.

        Both sides merge in rank order; they stay apart unless the pair at the border merges before either of its
        members does (on a tie the left place goes first).
        """
        known = self._adjacent.get((a, b))
        if known is not None:
            return known
        left, right, i, j, apart = self._spine(a, 1), self._spine(b, 0), 0, 0, True
        while True:
            until_a, until_b = left[i][1], right[j][1]
            across = self.rank.get((left[i][0], right[j][0]))
            if across is not None and across < until_a and across <= until_b:
                apart = False
                break
            if until_a == until_b == float("inf"):
                break
            if until_a <= until_b:
                i += 1
            else:
                j += 1
        self._adjacent[a, b] = apart
        return apart

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, growth of the count)."""
        known = self.steps.get((state, byte))
        if known is not None:
            return known
        grown, last, growth = [], None, 0
        for node, before, count in self.starts[state]:  # longest first
            child = self.trie.get((node, byte))
            if child is None:
                continue
            grown.append((child, before, count))
            token = self.token_at.get(child)
            if last is None and token is not None and (before < 0 or self.adjacent(before, token)):
                last, growth = token, count + 1
        if last is None:
            raise ValueError("a byte has no token")
        key = tuple((n, t, c - growth) for n, t, c in grown if n in self.open_nodes)
        out = self.steps[state, byte] = (self._state((*key, (0, last, 0))), growth)
        return out


class _State(dict):
    """Character -> (next state, emitted tokens), compiled when first asked for."""

    __slots__ = ("machine", "mode", "merge", "held", "final")

    def __missing__(self, char: str):
        self[char] = out = self.machine.compile(self, char)
        return out


class Transducer:
    """Counts the tokens that a byte-level BPE tokenizer file gives for a text."""

    #: Endings that an apostrophe at the start of a pre-token takes along: fixed by the pattern.
    SHORT, LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, pre = made["model"], made.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or made.get("normalizer") or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback")):
            raise ValueError(f"{path}: only byte-level BPE with the pattern {PATTERN} and no normalizer")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = MergeMachine(model["vocab"], merges)
        special = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        if any(t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: special tokens that take blanks or word ends along")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.kind_of = {"L": regex.compile(r"\p{L}").match, "N": regex.compile(r"\p{N}").match, "W": regex.compile(r"\s").match}
        # places where a pre-token must end; not between characters that follow each other in a special token
        ends = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"
        self.syncs = regex.compile(ends).finditer, regex.compile(f"(?r){ends}").finditer
        self.inside = {a + b for t in special for a, b in zip(t, t[1:])}
        self.reset()

    def reset(self) -> None:
        self.merges.reset()
        self.states: dict[tuple, _State] = {}
        self.transitions = 0
        self.start = self._state("", self.merges.start, "")

    def _kind(self, char: str) -> str:
        return next((k for k, match in self.kind_of.items() if match(char)), "O")

    def _feed(self, merge: int, text: str) -> tuple[int, int]:
        n = 0
        for byte in text.encode():
            merge, growth = self.merges.step(merge, byte)
            n += growth
        return merge, n

    def _state(self, mode: str, merge: int, held: str) -> _State:
        key = (mode, merge, held)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = _State()
            state.machine, state.mode, state.merge, state.held = self, mode, merge, held
            state.final = self._ending(state)
        return state

    def _ending(self, state: _State) -> int:
        """Tokens still to be emitted where the text ends."""
        if state.mode == "W":
            return self._feed(state.merge, state.held)[1]
        if state.mode == "Q":
            return sum(self._feed(self.merges.start, c)[1] for c in state.held)
        return 0

    def _open(self, char: str, before: str = "") -> tuple[_State, int]:
        """A pre-token begins with `before` (a blank or nothing) and `char`, which is no white space."""
        if char == "'" and not before:
            return self._state("Q", self.merges.start, "'"), 0
        merge, n = self._feed(self.merges.start, before + char)
        return self._state(self._kind(char), merge, ""), n

    def compile(self, state: _State, char: str) -> tuple[_State, int]:
        self.transitions += 1
        kind, mode, start = self._kind(char), state.mode, self.merges.start
        if mode == "Q":
            held = state.held
            if len(held) == 1:
                if char in self.SHORT:
                    return self.start, self._feed(start, held + char)[1]
                if char in self.LONG:
                    return self._state("Q", start, held + char), 0
                if kind == "O":
                    merge, n = self._feed(start, held + char)
                    return self._state("O", merge, ""), n
                paid, rest = self._feed(start, held)[1], self.start
            else:
                if char == self.LONG[held[1]]:
                    return self.start, self._feed(start, held + char)[1]
                paid, (rest, n) = self._feed(start, "'")[1], self._open(held[1])
                paid += n
            nxt, n = rest[char]
            return nxt, paid + n
        if mode == "W":
            if kind == "W":
                merge, n = self._feed(state.merge, state.held)
                return self._state("W", merge, char), n
            if state.held == " ":
                return self._open(char, " ")
            paid = self._feed(start, state.held)[1]
            nxt, n = self._open(char)
            return nxt, paid + n
        if kind == mode:
            merge, n = self._feed(state.merge, char)
            return self._state(mode, merge, ""), n
        return (self._state("W", start, char), 0) if kind == "W" else self._open(char)

    def _run(self, text: str) -> int:
        state, n = self.start, 0
        for char in text:
            state, emitted = state[char]
            n += emitted
        return n + state.final

    def count(self, text: str) -> int:
        """Tokens of a text that stands between two places where the machine is in its start state."""
        if self.transitions > MAX_TRANSITIONS:
            self.reset()
        if self.special is None or not self.special.search(text):
            return self._run(text)
        pieces = self.special.split(text)
        return sum(map(self._run, pieces)) + len(pieces) - 1

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, count, tail) of a chunk; (chunk, 0, None) where nothing inside brings the machine to its start."""
        first, last = (next((m.start() for m in find(text) if text[m.start() - 1 : m.start() + 1] not in self.inside), None) for find in self.syncs)
        if first is None:
            return text, 0, None
        return text[:first], self.count(text[first:last]), text[last:]

    def compose(self, x: tuple[str, int, str | None], y: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """The state map of one chunk followed by another."""
        if x[2] is None:
            return x[0] + y[0], y[1], y[2]
        if y[2] is None:
            return x[0], x[1], x[2] + y[0]
        return x[0], x[1] + self.count(x[2] + y[0]) + y[1], y[2]

    def scan(self, maps: list[tuple[str, int, str | None]]) -> list[tuple[str, int, str | None]]:
        """Inclusive prefix scan of chunk maps, pairwise in log steps."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
        above, out = self.scan(pairs), maps[:1]
        for i in range(1, len(maps)):
            out.append(above[i // 2] if i % 2 else self.compose(above[i // 2 - 1], maps[i]))
        return out

    def total(self, done: tuple[str, int, str | None]) -> int:
        head, n, tail = done
        return self.count(head) + n + (self.count(tail) if tail is not None else 0)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(
    documents: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    is_long = F.char_length("text") > chunk

    def make_short():
        machine = transducer(tokenizer_path)

        def step(batch):
            counts = pa.array([machine.count(t) for t in texts_of(batch)], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

        return step

    def make_chunks():
        machine = transducer(tokenizer_path)

        def step(batch):
            maps = [machine.chunk_map(t) for t in texts_of(batch)]
            heads, counts, tails = zip(*maps)
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_bytes", "text_hash", "chunk_no")),
                 pa.array(heads, pa.string()), pa.array(counts, pa.int64()), pa.array(tails, pa.string())],
                ["doc_id", "n_bytes", "text_hash", "chunk_no", "head", "inner", "tail"],
            )

        return step

    def cut(batches):
        """Chunks of the texts, each text read once; an Arrow batch holds FAN chunks."""
        names = ["doc_id", "n_bytes", "text_hash", "chunk_no", "text"]
        for batch in batches:
            for i in range(batch.num_rows):
                head, whole = [batch.column(c)[i].as_py() for c in names[:3]], batch.column("text")[i].as_py()
                for first in range(0, len(whole), chunk * FAN):
                    parts = [whole[at : at + chunk] for at in range(first, min(len(whole), first + chunk * FAN), chunk)]
                    numbers = range(first // chunk, first // chunk + len(parts))
                    columns = [pa.array([v] * len(parts), pa.int64()) for v in head]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], names)

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        """Neighbouring chunks' maps as one map; rows that are equal in all of the input are counted in `copies`."""
        machine = transducer(tokenizer_path)
        one = rows.drop_duplicates("chunk_no").sort_values("chunk_no")
        maps = [(h, int(n), None if pd.isna(t) else t) for h, n, t in zip(one["head"], one["inner"], one["tail"])]
        head, inner, tail = machine.scan(maps)[-1]
        copies = int(rows.loc[rows["chunk_no"] == one["chunk_no"].iloc[0], "copies"].sum())
        first = one.iloc[0]
        return pd.DataFrame({
            "doc_id": [first["doc_id"]], "n_bytes": first["n_bytes"], "text_hash": first["text_hash"], "chunk_no": first["chunk_no"] // FAN,
            "head": head, "inner": inner, "tail": tail, "copies": copies,
        }).astype({"doc_id": "Int64"})

    def make_totals():
        machine = transducer(tokenizer_path)

        def step(batch):
            maps = zip(*(batch.column(c).to_pylist() for c in ("head", "inner", "tail")))
            counts = pa.array([machine.total(m) for m in maps], pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), counts, batch.column("copies")], ["doc_id", "n_bytes", "n_tokens", "copies"]
            )

        return step

    short = in_batches(docs.where(~is_long), make_short, "doc_id long, n_bytes long, n_tokens long")
    pieces = (
        docs.where(is_long)
        .select("doc_id", "n_bytes", F.xxhash64("text").alias("text_hash"), "text")
        .mapInArrow(cut, "doc_id long, n_bytes long, text_hash long, chunk_no int, text string")
        .repartition("doc_id", "text_hash", "chunk_no")
    )
    schema = "doc_id long, n_bytes long, text_hash long, chunk_no int, head string, inner long, tail string"
    maps = in_batches(pieces, make_chunks, schema).withColumn("copies", F.lit(1).cast("long"))
    most = docs.agg(F.max(F.char_length("text"))).first()[0] or 0
    chunks = -(-most // chunk)
    while chunks > 1:
        group = F.floor(F.col("chunk_no") / FAN).alias("group")
        maps = maps.groupBy("doc_id", "n_bytes", "text_hash", group).applyInPandas(lambda rows: compose(rows), schema + ", copies long")
        chunks = -(-chunks // FAN)
    long = in_batches(maps, make_totals, "doc_id long, n_bytes long, n_tokens long, copies long")
    long = long.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
