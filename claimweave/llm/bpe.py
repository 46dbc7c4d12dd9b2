"""Exact BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import held_model, small_batches

#: A task remembers words and prefixes of words, of up to RUN_CHARS, and which tokens fit each other. Of
#: words the last RUNS met and those of RUNS before them stay; prefixes and pairs go at so many. Everything
#: goes when the task ends, for workers outlive their tasks.
RUNS, PREFIXES, PAIRS, RUN_CHARS = 1 << 17, 1 << 18, 1 << 18, 64
#: Symbols are bytes, and bytes that end a word from 256 on.
_ENDS, _WIDTH = 256, 9
#: Python takes these for white space, the tokenizer does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_NEVER = 1 << 62


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is
    visible, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class VocabularyAutomaton:
    """Suffix automaton of all tokens: the longest piece of any token that ends at each place of a
    word, and from there every token that ends at that place."""

    def __init__(self, tokens: dict[int, tuple[int, ...]]) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        ends: list[tuple[int, int, int]] = []
        for token, symbols in tokens.items():
            state = 0
            for c in symbols:
                state = self._extend(state, c)
            ends.append((state, len(symbols), token))
        #: At a state, its own tokens (length, token), longest first.
        self.own: dict[int, list[tuple[int, int]]] = {}
        for state, n, token in ends:
            # a later clone may have taken the shorter strings of this state
            while self.link[state] >= 0 and self.length[self.link[state]] >= n:
                state = self.link[state]
            self.own.setdefault(state, []).append((n, token))
        for own in self.own.values():
            own.sort(reverse=True)

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.steps)
        self.steps.append(dict(self.steps[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.steps[p].get(c) == q:
            self.steps[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.steps[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.steps)
        self.steps.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.steps[p]:
            self.steps[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.steps[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def flat(self) -> tuple[dict[int, int], list[int], list[int], list[int], dict[int, tuple[tuple[int, int], ...]]]:
        """Steps by state and symbol, suffix links and lengths, the nearest state from each one on along the
        links that has tokens (-1 for none), and the tokens of such states."""
        steps = {state << _WIDTH | c: to for state, out in enumerate(self.steps) for c, to in out.items()}
        nearest = [-1] * len(self.steps)
        for state in sorted(range(1, len(self.steps)), key=self.length.__getitem__):
            nearest[state] = state if state in self.own else nearest[self.link[state]]
        return steps, self.link, self.length, nearest, {k: tuple(v) for k, v in self.own.items()}


class Bpe:
    """Encoder and decoder for a vocabulary file with lower-casing, word ends and byte-level symbols.

    The special tokens of the file are recognised in the raw text. Text between them is NFC-normalised,
    characters are lower-cased one by one, the pattern picks words, which hold no white space, and each
    word's bytes are encoded by themselves.
    """

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words_of = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        #: Signs that are words of their own after letters.
        self.signs = {c for c in ".,;:!?" if self.words_of.findall("ab" + c) == ["ab", c]}
        signs = byte_symbols()
        symbol = {vocab[signs[b]]: b for b in range(256)} | {vocab[signs[b] + suffix]: _ENDS + b for b in range(256)}
        size = max(vocab.values()) + 1
        #: Merge rank of a token, -1 for one of a single symbol; its halves.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        spelled = {i: (c,) for i, c in symbol.items()}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair[left << 32 | right] = rank
            if self.rank[whole] >= 0 or whole in spelled or left not in spelled or right not in spelled:
                raise ValueError(f"the merges make {a + b!r} twice or before its parts")
            self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
            spelled[whole] = spelled[left] + spelled[right]
        reachable = {i for i in spelled if self.rank[i] < 0}
        for i in sorted(spelled, key=self.rank.__getitem__):
            if self.rank[i] >= 0 and self.left[i] in reachable and self.right[i] in reachable and self._stand(self.left[i], self.right[i], self.rank[i]):
                reachable.add(i)
        automaton = VocabularyAutomaton({i: spelled[i] for i in reachable})
        self.steps, self.link, self.length, self.nearest, self.own = automaton.flat()
        self.forget()

    def _stand(self, x: int, y: int, until: int) -> bool:
        """Whether x and y, side by side, are both made before any merge of rank below ``until`` joins
        parts of them. Going back in time, the younger of two neighbours is undone; the left of two
        equal ones is older, and of two equal merges the left one comes first."""
        x_gone = y_gone = until
        while True:
            rank = self.pair.get(x << 32 | y, _NEVER)
            if rank < x_gone and rank <= y_gone and rank != until:
                return False
            if self.rank[x] < 0 and self.rank[y] < 0:
                return True
            if self.rank[x] > self.rank[y]:
                x_gone, x = self.rank[x], self.right[x]
            else:
                y_gone, y = self.rank[y], self.left[y]

    def fits(self, x: int, y: int) -> bool:
        """Whether BPE of the two tokens' joined spelling gives back just these two tokens."""
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        known = self._fits[x << 32 | y] = self._stand(x, y, _NEVER)
        return known

    def encode_word(self, word: str) -> bytes:
        """The ids of a word, four bytes each.

        Every prefix has one encoding, so one last token: the only one ending there that fits the last token
        of the prefix before it. The tokens that end at a place are those of the automaton's state there
        and of the states along its links. Prefixes met before are looked up. The ids are read off
        backwards from the whole word.
        """
        if len(self._state) > PREFIXES:
            self._forget_prefixes()
        steps, link, length, nearest, own, fit, longer = self.steps, self.link, self.length, self.nearest, self.own, self._fits, self._longer
        data = word.encode("utf-8", "surrogatepass")
        node, path = 0, [0]
        for c in data[:-1]:
            to = longer.get(node << _WIDTH | c)
            if to is None:
                break
            node = to
            path.append(node)
        end = len(path) - 1
        last, size = [self._last[x] for x in path], [self._size[x] for x in path]
        state, held = self._state[node], self._held[node]
        short = len(data) <= RUN_CHARS
        for c in (*data[end:-1], _ENDS + data[-1]):
            to = steps.get(state << _WIDTH | c)
            while to is None:
                if not state:
                    raise ValueError("the vocabulary lacks a symbol")
                state = link[state]
                held = length[state]
                to = steps.get(state << _WIDTH | c)
            state, held, end = to, held + 1, end + 1
            at, found = nearest[state], -1
            while found < 0:
                for n, token in own[at]:
                    if n <= held:
                        if n == end:
                            found = token
                            break
                        before = last[end - n]
                        known = fit.get(before << 32 | token)
                        if self.fits(before, token) if known is None else known:
                            found = token
                            break
                else:
                    at = nearest[link[at]]
            last.append(found)
            size.append(n)
            if short and c < _ENDS:
                longer[node << _WIDTH | c] = node = len(self._state)
                self._state.append(state)
                self._held.append(held)
                self._last.append(found)
                self._size.append(n)
        ids = []
        while end:
            ids.append(last[end])
            end -= size[end]
        return array("i", ids[::-1]).tobytes()

    def _forget_prefixes(self) -> None:
        """Empty the memory of prefixes: by number their automaton state, length matched, last token and its size."""
        self._longer: dict[int, int] = {}
        self._state, self._held, self._last, self._size = [0], [0], [-1], [0]

    def forget(self) -> None:
        """Empty the memory of words, prefixes and tokens that fit."""
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._fits: dict[int, bool] = {}
        self._forget_prefixes()

    def _word(self, word: str) -> bytes:
        """Ids of a word, remembered if it is short."""
        got = self._older.get(word) or self.encode_word(word)
        if len(word) <= RUN_CHARS:
            if len(self._known) >= RUNS:
                self._older, self._known = self._known, {}
            self._known[word] = got
        return got

    def _run(self, run: str) -> bytes:
        """Ids of a run without white space."""
        if run.isalpha():
            return self._word(run)
        if run[-1] in self.signs and run[:-1].isalpha():
            return (self._known.get(run[:-1]) or self._word(run[:-1])) + self._word(run[-1])
        return b"".join([self._known.get(w) or self._word(w) for w in self.words_of.findall(run)])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for a null or empty one."""
        parts: list[bytes] = []
        for piece in (self.split_special.split(text) if self.split_special else [text]) if text else []:
            if piece in self.special:
                parts.append(np.array([self.special[piece]], np.int32).tobytes())
            elif piece:
                # words hold no white space, so the runs between it can be encoded apart
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                for run in [plain] if _SEPARATORS.search(plain) else plain.split():
                    parts.append(self._known.get(run) or self._run(run))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray | None) -> str:
        """The tokens of ``ids``, special ones included, joined by spaces: the file names no decoder."""
        return "" if ids is None else " ".join(map(self.token.__getitem__, ids.tolist()))


def _bpe(held) -> Bpe:
    """The encoder of a broadcast, alone in its worker."""
    return held_model(("bpe", held.value[0]), lambda: Bpe(held.value[1]))


def _shipped(df: DataFrame, path: str):
    """The vocabulary file, read by the driver, as a broadcast; its size does not depend on the data."""
    small_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        source = f.read()
    return df.sparkSession.sparkContext.broadcast((hash(source), source))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "__ids") -> DataFrame:
    """``df`` with the token ids (array<int>) of each whole ``text``; null and empty texts have none.

    Rows stay as they are, repeated ones included.
    """
    held = _shipped(df, path)

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _bpe(held)
        try:
            for texts in batches:
                yield pd.Series([bpe.encode(t) for t in texts], dtype=object)
        finally:
            bpe.forget()

    return df.withColumn(out, ids_of(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "__ids", out: str = "__decoded") -> DataFrame:
    """``df`` with the text that each array of token ids stands for; a null array gives empty text."""
    held = _shipped(df, path)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _bpe(held)
        for arrays in batches:
            yield pd.Series([bpe.decode(x) for x in arrays], dtype=object)

    return df.withColumn(out, text_of(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "__bpe") -> DataFrame:
    """``df`` with a struct ``out`` of ``ids`` as by ``encode`` and ``decoded``, what ``decode`` makes of
    them, in one pass over the texts."""
    held = _shipped(df, path)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(held)
        try:
            for texts in batches:
                ids = [bpe.encode(t) for t in texts]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([bpe.decode(x) for x in ids], dtype=object)})
        finally:
            bpe.forget()

    return df.withColumn(out, both(F.col(text)))
