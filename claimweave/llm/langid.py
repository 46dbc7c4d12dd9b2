"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import held_model, small_batches

#: The bound of the labelled sample: texts per language, each taken whole.
SAMPLE_TEXTS = 24
#: Texts are parsed side by side in blocks of so many symbols, which are then stitched together.
BLOCK = 512
UNDETERMINED = "und"
_SPACE, _OTHER = 0, 1


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _plain(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other than letters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 32)
    gap = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return points[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``symbols``."""
    steps: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


class CrossParser:
    """Automata of one labelled sample per language, as flat tables.

    An entry is the next state; where the phrase so far cannot be extended it is the bitwise
    complement of the state in which the next phrase stands after this symbol. The last state, where
    every text starts, can extend nothing; a symbol that the sample lacks leads back to it.
    """

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        plain = [_plain(samples[x]) for x in self.langs]
        alphabet = np.unique(np.concatenate([p[p != 32] for p in plain])) if plain else np.zeros(0, np.uint32)
        self.width = len(alphabet) + 2
        self.symbol = np.where(_letters(), _OTHER, _SPACE).astype(np.int32)
        self.symbol[alphabet] = np.arange(2, self.width)
        self.bits = [np.log2(len(p) + 2.0) for p in plain]
        self.tables = [self._table(p) for p in plain]

    def _table(self, plain: np.ndarray) -> np.ndarray:
        steps = suffix_automaton(self.symbol[plain].tolist())
        again = np.full(self.width, len(steps), np.int32)
        for c, to in steps[0].items():
            again[c] = to
        table = np.repeat(~again[None, :], len(steps) + 1, axis=0)
        for state, out in enumerate(steps):
            for c, to in out.items():
                table[state, c] = to
        return table.ravel()

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a symbol, texts x languages), (whether a text has a letter).

        Every block is parsed as if a phrase began with it. Then the phrase that runs over the end of a block is
        followed into the next one until a phrase begins where one of that block begins too; from there on
        both are the same. So the count is that of the whole text parsed from its start.
        """
        symbols = [self.symbol[_plain(t or "")] for t in texts]
        sizes = np.array([len(s) for s in symbols], np.int64)
        owner, start, length = [], [], []
        for i, n in enumerate(sizes.tolist()):
            for at in range(0, n, BLOCK):
                owner.append(i)
                start.append(at)
                length.append(min(BLOCK, n - at))
        order = np.argsort(-np.array(length, np.int64), kind="stable")
        grid = np.zeros((BLOCK, len(order)), np.int32)
        for k, j in enumerate(order.tolist()):
            grid[: length[j], k] = symbols[owner[j]][start[j] : start[j] + length[j]]
        owners = np.array(owner, np.int64)[order]
        lengths = np.array(length, np.int64)[order]
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        ahead = np.array([j for j in range(len(owner) - 1) if owner[j + 1] == owner[j]], np.int64)
        goes_on = np.zeros(len(order), bool)
        goes_on[column[ahead]] = True
        active = [int(n) for n in np.searchsorted(-lengths, -np.arange(BLOCK), side="left")]
        out = np.zeros((len(texts), len(self.langs)))
        for k, (table, bits) in enumerate(zip(self.tables, self.bits, strict=True)):
            state, phrases = np.full(len(order), len(table) // self.width - 1, np.int32), np.zeros(len(order), np.int64)
            begins = np.zeros((BLOCK, len(order)), bool)
            for t in range(BLOCK):
                n = active[t]
                if not n:
                    break
                to = table.take(state[:n] * self.width + grid[t, :n])
                ended = to >> 31
                begins[t, :n] = ended != 0
                phrases[:n] -= ended
                state[:n] = to ^ ended
            into, running = column[ahead + 1], state[column[ahead]]
            apart = np.zeros(len(texts), bool)
            for t in range(BLOCK):
                over = t >= lengths[into]
                apart[owners[into[over & goes_on[into]]]] = True
                into, running = into[~over], running[~over]
                if not len(into):
                    break
                to = table.take(running * self.width + grid[t, into])
                ended = to >> 31
                own = begins[t, into]
                np.add.at(phrases, into, (ended != 0).astype(np.int64) - own)
                stay = ~((ended != 0) & own)
                into, running = into[stay], (to ^ ended)[stay]
            apart[owners[into[goes_on[into]]]] = True
            counts = np.bincount(owners, phrases, len(texts))
            for i in np.flatnonzero(apart).tolist():
                counts[i] = self._phrases(table, symbols[i])
            out[:, k] = counts * bits / np.maximum(sizes, 1)
        return out, np.array([bool((s != _SPACE).any()) for s in symbols], bool)

    def _phrases(self, table: np.ndarray, symbols: np.ndarray) -> int:
        """Phrases of a whole text, symbol by symbol."""
        state, count, item, width = len(table) // self.width - 1, 0, table.item, self.width
        for c in symbols.tolist():
            state = item(state * width + c)
            if state < 0:
                state, count = ~state, count + 1
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of fewest normalised phrases, the first in order of name among equals, and
        how much fewer they are than the runner-up's, as a share (1 if there is one language)."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cost, lettered = self.entropies(texts)
        best = cost.argmin(axis=1)
        if len(self.langs) > 1:
            two = np.sort(cost, axis=1)[:, :2]
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)
        else:
            score = np.ones(len(texts))
        langs = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return langs, np.where(lettered, np.clip(score, 0, 1), 0.0)


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Up to SAMPLE_TEXTS distinct whole texts of each language from documents that are not held out: the id of
    least hash in each of SAMPLE_TEXTS buckets, so the choice does not depend on how rows are
    partitioned. Only this bounded sample of rows reaches the driver."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"))
    hashed = ids.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id")).withColumn("h", F.xxhash64("id"))
    chosen = (
        hashed.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("bucket")).agg(F.min_by("id", "h").alias("id")).select("lang", "id").collect()
    )
    of_id = {r["id"]: r["lang"] for r in chosen}
    if not of_id:
        return {}
    texts = (
        docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
        .where(F.col("id").isin(list(of_id)) & F.col("text").isNotNull())
        .groupBy("id", "lang")
        .agg(F.min("text").alias("text"))
    )
    found: dict[str, dict[str, None]] = {}
    for r in texts.orderBy("id", "lang").toLocalIterator():
        if of_id[r["id"]] == r["lang"]:
            found.setdefault(r["lang"], {})[_plain(r["text"]).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")] = None
    return {k: " ".join(v) for k, v in found.items() if any(x.strip() for x in v)}


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text", out: str = "__lang") -> DataFrame:
    """``docs`` with a struct ``out`` of ``lang_pred`` and ``score`` (0 to 1) from the whole text.

    Each text is cut greedily into the longest phrases that occur in a language's labelled sample;
    the language that needs the fewest phrases, normalised by the logarithm of its sample, wins. A
    null text or one without a letter is ``und`` with score 0, and so is everything if there is no
    sample. Letters that no sample has end a phrase in every language; equal counts go to the first
    language by name with score 0. Rows and columns of ``docs`` stay as they are.
    """
    small_batches(docs.sparkSession)
    held = tuple(sorted(samples.items()))

    @F.pandas_udf("lang_pred string, score double")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = held_model(("langid", held), lambda: CrossParser(dict(held)))
        for texts in batches:
            langs, scores = parser.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(out, parse(F.col(text)))
