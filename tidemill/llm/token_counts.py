"""Token counts through a compiled finite-state tokenizer.

Two deterministic transducers are compiled from the tokenizer file.

* The *splitting* transducer reads character classes and marks where pre-tokens
  start.  A chunk of text is summarised by its state map (state before -> state
  after); the maps of all chunks of a batch are composed by a parallel prefix
  scan, after which every chunk is replayed from its now known state.
* The *merging* transducer reads the bytes of one pre-token and annotates each
  transition with the change of the number of emitted tokens.  It rests on a
  property of merge-rank tokenizers: a token sequence is the tokenizer's output if
  and only if each adjacent pair is left apart by the merges, so the last token of
  each prefix is a function of finitely many earlier ones.  Its states are built on
  demand and kept in a bounded table.

Defined results: null and empty texts have 0 bytes and 0 tokens and are not over
the limit; special strings inside a text are one token each; repeated rows and ids
are counted row by row; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.textbatch import distinct_segments, slices, texts_of, utf8

CHUNK = 64
MAX_WORDS = 600_000
MAX_STATES = 200_000
NEVER = 1 << 30

# Character classes of the splitting transducer.
SPACE, LETTER, NUMBER, PUNCT, APOS, L_STMD, L_R, L_V, L_L, L_E = range(10)
CLASSES = 10
# Its states: nothing open, letters, punctuation, apostrophe first, then 'r 'v 'l.
OPEN, LETTERS, MARKS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
STATES = 8
HERE, BEFORE = 1, 2  # a pre-token starts at this character, or at the one before it


def _splitting_table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for each class * STATES + state."""
    to, out = np.zeros(CLASSES * STATES, np.uint8), np.zeros(CLASSES * STATES, np.uint8)
    letters = (LETTER, L_STMD, L_R, L_V, L_L, L_E)

    def plain(state: int, cls: int) -> tuple[int, int]:
        if cls == SPACE:
            return OPEN, 0
        if cls == NUMBER:
            return OPEN, HERE
        if cls in letters:
            return LETTERS, 0 if state == LETTERS else HERE
        if state in (MARKS, QUOTE):
            return MARKS, 0
        return (QUOTE, HERE) if cls == APOS else (MARKS, HERE)

    closing = {QUOTE_R: L_E, QUOTE_V: L_E, QUOTE_L: L_L}
    for state in range(7):
        for cls in range(CLASSES):
            if state == QUOTE and cls == L_STMD:
                step = OPEN, 0
            elif state == QUOTE and cls in (L_R, L_V, L_L):
                step = {L_R: QUOTE_R, L_V: QUOTE_V, L_L: QUOTE_L}[cls], 0
            elif state in closing and cls == closing[state]:
                step = OPEN, 0
            elif state in closing:
                nxt, emit = plain(LETTERS, cls)
                step = nxt, emit | BEFORE
            else:
                step = plain(state, cls)
            to[cls * STATES + state], out[cls * STATES + state] = step
    return to, out


def _character_classes() -> np.ndarray:
    """Class of every code point, asked of the library's own pattern engine."""
    from tokenizers import Regex, normalizers

    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, mark in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", " ")):
        points = normalizers.Replace(Regex(pattern), mark).normalize_str(points)
    seen = np.frombuffer(points.encode("utf-32-le"), np.uint32)
    kinds = np.full(len(seen), PUNCT, np.uint8)
    for mark, cls in (("L", LETTER), ("N", NUMBER), (" ", SPACE)):
        kinds[seen == ord(mark)] = cls
    table = np.full(0x110000, PUNCT, np.uint8)
    table[:0xD800], table[0xE000:] = kinds[:0xD800], kinds[0xD800:]
    for ch, cls in (("'", APOS), ("s", L_STMD), ("t", L_STMD), ("m", L_STMD), ("d", L_STMD), ("r", L_R), ("v", L_V), ("l", L_L), ("e", L_E)):
        table[ord(ch)] = cls
    return table


def looked_up(table: bytes, keys: np.ndarray) -> np.ndarray:
    """table[key] for an array of small keys."""
    return np.frombuffer(keys.tobytes().translate(table), np.uint8).reshape(keys.shape)


class Splitter:
    def __init__(self):
        self.classes = _character_classes()
        self.to, self.out = (t.tobytes().ljust(256, b"\0") for t in _splitting_table())

    def starts(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every pre-token in an array of code points that ends with a space."""
        n = -(-max(len(points), 1) // CHUNK)
        cls = np.zeros(n * CHUNK, np.uint8)
        cls[: len(points)] = self.classes[points]
        by_step = np.ascontiguousarray(cls.reshape(n, CHUNK).T) * np.uint8(STATES)
        identity = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, n))
        maps = identity
        for step in by_step:  # the state map of every chunk at once
            maps = looked_up(self.to, maps + step)
        before = identity.copy()
        before[:, 1:] = maps[:, :-1]
        reach = 1
        while reach < n:  # inclusive scan: compose with what ends `reach` chunks earlier
            before[:, reach:] = np.take_along_axis(before[:, reach:], before[:, :-reach].astype(np.intp), axis=0)
            reach *= 2
        state, emitted = before[OPEN].copy(), np.empty((CHUNK, n), np.uint8)
        for i, step in enumerate(by_step):
            key = step + state
            emitted[i] = looked_up(self.out, key)
            state = looked_up(self.to, key)
        flat = np.ascontiguousarray(emitted.T).ravel()[: len(points)]
        mark = (flat & HERE).astype(bool)
        mark[:-1] |= (flat[1:] & BEFORE).astype(bool)
        starts = np.flatnonzero(mark)
        spaces = np.flatnonzero(cls[: len(points)] == SPACE)
        ends = spaces[np.searchsorted(spaces, starts)] if len(starts) else starts
        ends[:-1] = np.minimum(ends[:-1], starts[1:])
        return starts, ends


class Merger:
    """The merging transducer: bytes of a pre-token -> number of tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        from tidemill.llm.bytemap import byte_symbols

        symbols = byte_symbols()
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            token = vocab[a + b]
            if token in self.made:
                raise ValueError("two merges make the same token")
            self.made[token] = vocab[a], vocab[b], rank
        for left, right, rank in self.made.values():
            if any(self.made.get(x, (0, 0, -1))[2] >= rank for x in (left, right)):
                raise ValueError("a merge uses a token that a later merge makes")
        self.rank = {(left, right): rank for left, right, rank in self.made.values()}
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, token in vocab.items():
            end = text.endswith(suffix)
            body = text[: len(text) - len(suffix)] if end else text
            if not body or any(c not in byte_of for c in body):
                continue
            path = [byte_of[c] for c in body]
            if end:
                path[-1] += 256
            node = 0
            for step in path:
                nxt = self.children[node].get(step)
                if nxt is None:
                    nxt = self.children[node][step] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = token
        self.apart: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self.clear()

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.index, self.steps = [start], {start: 0}, {}
        if len(getattr(self, "apart", ())) > 2_000_000:
            self.apart.clear()

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts of a token at its edge, innermost first, each with the rank that consumes it."""
        found = self.spines[side].get(token)
        if found is None:
            found, part, consumed = [], token, NEVER
            while part >= 0:
                found.append((part, consumed))
                left, right, consumed = self.made.get(part, (-1, -1, NEVER))
                part = right if side else left
            found.reverse()
            self.spines[side][token] = found
        return found

    def left_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b next to each other as they are."""
        if a < 0:
            return True
        found = self.apart.get(a << 20 | b)
        if found is None:
            right, left, i, j, rank = self._spine(a, 1), self._spine(b, 0), 0, 0, self.rank
            while found is None:
                (x, used_x), (y, used_y) = right[i], left[j]
                if (pair := rank.get((x, y), NEVER)) < used_x and pair <= used_y and pair < NEVER:
                    found = False
                elif used_x == used_y == NEVER:
                    found = True
                elif used_x <= used_y:
                    i += 1
                else:
                    j += 1
            self.apart[a << 20 | b] = found
        return found

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state (-1 at the end of a word) and the change of the token count."""
        alive, found = [], None
        for node, last, behind in self.states[state]:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            token = self.token[child]
            if token >= 0 and found is None and self.left_apart(last, token):
                found = token, behind + 1
            if self.children[child]:
                alive.append((child, last, behind))
        token, change = found
        if symbol >= 256:
            return -1, change
        key = (*((node, last, behind - change) for node, last, behind in alive), (0, token, 0))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        return to, change

    def count(self, word: str) -> int:
        if len(self.states) > MAX_STATES:
            self.clear()
        raw = word.encode()
        state = total = 0
        steps = self.steps
        for symbol in (*raw[:-1], raw[-1] + 256):
            key = state << 9 | symbol
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._step(state, symbol)
            state, change = step
            total += change
        return total


class Known(dict):
    """Counts of pre-tokens, run through the transducer when first met."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self[word] = self.count(word)
        return n


class TokenCounter:
    """Counts tokens of texts as the tokenizer file says, special strings included."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"no transducer for this kind of tokenizer: {kinds}")
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))))
        self.merger = Merger(spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]], "</w>")
        self.splitter = Splitter()
        self.known = Known(self.merger.count)
        from tokenizers import normalizers

        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        # Characters that the library's Unicode tables may know and Python's do not; Python leaves them as they are.
        self.unsure = np.zeros(0x110000, bool)
        self.unsure[[c for c in (*range(0xD800), *range(0xE000, 0x110000)) if unicodedata.category(chr(c)) == "Cn"]] = True

    def _normal(self, text: str) -> str:
        """Composed and lower-case; white space only separates, so its runs stay."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case of one character at a time has no final form
                text = text.replace("Σ", "σ")
        return text.lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        parts, owner, plain = [], [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if "<|" in text:
                pieces = self.special.split(text)
                total[i] += len(pieces) - 1
            for p in pieces:
                if p:
                    plain.append(p)
                    parts.append(self._normal(p))
                    owner.append(i)
        if not parts:
            return total
        joined = " ".join(parts) + " "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        unsure = np.flatnonzero(self.unsure[points])
        if len(unsure):
            for i in np.unique(np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), unsure, "right")).tolist():
                parts[i] = self.library.normalize_str(plain[i])
            joined = " ".join(parts) + " "
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = self.splitter.starts(points)
        if not len(starts):
            return total
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known = self.known
        one, each = distinct_segments(points, starts, ends)
        found = np.fromiter((known[joined[a:b]] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)), np.int64, len(one))[each]
        limits = np.cumsum([len(p) + 1 for p in parts])
        at = np.searchsorted(limits, starts, "right")
        total += np.bincount(np.asarray(owner)[at], weights=found, minlength=len(texts)).astype(np.int64)
        return total


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One compiled tokenizer per worker process."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row of docs."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                n = counter(tokenizer).counts(texts_of(part, "t"))
                _, off = utf8(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"{key} {key_type}, n_bytes long, n_tokens long, over_limit boolean")
