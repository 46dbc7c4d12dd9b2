"""Phrases whose words keep together: n-gram counts by sorted suffixes, and a score of each phrase's weakest cut."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import arrow_batches, cut

#: Different suffixes (or words) that a task counts before it sends them on, and bytes of a text split at a time.
HELD, BLOCK_BYTES = 400_000, 1 << 20
#: A word is hot from this part of all words on, so no more than this many words are.
HOT_PART = 256
#: Rows of a hot word in a join are spread over so many keys.
SPREAD = 32
#: Letters A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
_PLAIN = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def suffixes(text: str, longest: int) -> Iterator[Iterator[bytes]]:
    """The words of a text from each one on, up to ``longest`` and to the end of its piece, joined by tabs.

    Shorter ones are filled up with empty words, so all have as many tabs, and equal beginnings sort together.
    """
    plain = text.encode("utf-8", "replace").translate(_PLAIN)
    for piece in plain.split(b"\n") if longest > 1 else [plain.replace(b"\n", b" ")]:
        words: list[bytes] = []
        at = 0
        while at < len(piece):
            end = piece.find(b" ", at + BLOCK_BYTES)
            end = len(piece) if end < 0 else end
            words += piece[at:end].split()
            if end == len(piece) and words:
                words += [b""] * (longest - 1)
            yield map(b"\t".join, zip(*(words[i:] for i in range(longest)))) if longest > 1 else iter(words)
            words = words[-(longest - 1) :] if longest > 1 else []
            at = end


def _counted(texts: DataFrame, longest: int) -> DataFrame:
    """(key, n): how often each suffix with its language in front begins somewhere; sums of parts of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                keys = pc.binary_join_element_wise(lang, pa.array(list(counts), pa.binary()).cast(pa.string()), "\t")
                sent = pa.table({"key": keys, "n": np.fromiter(counts.values(), np.int64, len(counts))})
                # in runs as they will be sorted, which compress and merge well
                yield from sent.take(pc.array_sort_indices(keys, order="descending")).to_batches(50_000)
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = held.setdefault(lang, Counter())
                for some in suffixes(text or "", longest):
                    before = len(counts)
                    counts.update(some)
                    size += len(counts) - before
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    return texts.mapInArrow(count, "key string, n long")


def count_beginnings(batches: Iterator[pa.RecordBatch], longest: int, keep: Callable[[int, list[pa.Array], np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(key, words, n) of all beginnings of keys that come sorted, in one pass.

    A stack holds the beginnings of the row before, one a level, with what they count so far. Where the next row leaves
    one, it and all above it are complete and go out. Rows of a batch are compared and summed together.
    ``keep`` picks, of a level's complete beginnings, those that are wanted.
    """
    stack: list[str] = []
    sums = [0] * (longest + 1)

    def out(level: int, keys: list[str], counts: list[int]) -> pa.RecordBatch:
        names = ["\t".join(k.split("\t")[: level + 1]) for k in keys]
        return pa.record_batch([pa.array(names, pa.string()), pa.array([level] * len(names), pa.int32()), pa.array(counts, pa.int64())], names=["key", "words", "n"])

    def top(level: int) -> Iterator[pa.RecordBatch]:
        if stack and stack[level] and keep(level, [pa.array([w]) for w in stack[1 : level + 1]], np.array([sums[level]]))[0]:
            yield out(level, ["\t".join(stack)], [sums[level]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, n = batch.column(0), batch.column(1).to_numpy()
        fields = pc.split_pattern(keys, "\t").flatten()
        columns = [fields.take(pa.array(np.arange(j, len(fields), longest + 1))) for j in range(longest + 1)]
        changed = np.zeros(len(n), bool)
        for level, column in enumerate(columns):
            changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            changed[0] |= not stack or column[0].as_py() != stack[level]
            if not level:
                continue
            starts = np.flatnonzero(changed)
            if not len(starts):
                sums[level] += int(n.sum())
                continue
            sums[level] += int(n[: starts[0]].sum())
            yield from top(level)
            totals = np.add.reduceat(n, starts)
            sums[level], whole = int(totals[-1]), starts[:-1]
            at = pa.array(whole)
            wanted = keep(level, [c.take(at) for c in columns[1 : level + 1]], totals[:-1]) & pc.not_equal(column.take(at), "").to_numpy(zero_copy_only=False)
            if wanted.any():
                yield out(level, keys.take(pa.array(whole[wanted])).to_pylist(), totals[:-1][wanted].tolist())
        stack = [c[-1].as_py() for c in columns]
    for level in range(1, longest + 1):
        yield from top(level)


def _beginning(words: int) -> Column:
    return F.substring_index("key", "\t", words + 1)


def _word(nth: int) -> Column:
    return F.substring_index(_beginning(nth), "\t", -1)


def ngrams(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame, list[str]]:
    """(counts, languages, hot words): ``counts`` has key (language and words, joined by tabs), words and n of every
    phrase of up to ``longest`` words met ``least`` times, ``languages`` all words of each language.

    A first pass counts single words. Suffixes then meet by language and first word; those that begin with words
    so frequent that their rows would fill a task meet by one word more, until one that is not, and what such words
    count comes in parts that are added up afterwards.
    """
    spark = docs.sparkSession
    with arrow_batches(spark, 20_000):
        single = cut(_counted(docs, 1).groupBy("key").agg(F.sum("n").alias("n")))
    languages = single.groupBy(_beginning(0).alias("lang")).agg(F.sum("n").alias("n"))
    total = single.agg(F.sum("n")).first()[0] or 0
    hot = sorted({r[0] for r in single.where(F.col("n") * HOT_PART >= total).select(_word(1)).collect()})
    meet = F
    for words in range(1, longest):
        meet = meet.when(~_word(words).isin(hot), _beginning(words))
    meet = meet.otherwise(F.col("key")) if longest > 1 else F.col("key")
    frequent = pa.array(hot, pa.string())

    def keep(level: int, words: list[pa.Array], counts: np.ndarray) -> np.ndarray:
        part = np.ones(len(counts), bool)
        for column in words if level < longest else []:
            part &= pc.is_in(column, value_set=frequent).to_numpy(zero_copy_only=False)
        return (counts >= least) | (part if level < longest else False)

    with arrow_batches(spark, 20_000):
        sent = _counted(docs, longest).repartition(meet)
        found = sent.sortWithinPartitions(F.desc("key")).mapInArrow(lambda b: count_beginnings(b, longest, keep), "key string, words int, n long")
        counts = cut(found.groupBy("key", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return counts, languages, hot


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; ``.,;:!?`` and line ends end a piece, spaces and tabs a word. Everything is per language (null:
    ``und``) and over all rows: n words in all, a the phrase's occurrences in pieces, overlaps included. A cut after k words
    gives l and r of the parts and 1,000,000 a a / (l r), rounded down; the weakest cut (ties: the first) is the score.
    Phrases met fewer than ``least`` times are none, and one that lies in a longer one with ``cover`` percent of its
    occurrences goes. First are the highest score, then a, then the phrase by bytes.

    Null and empty texts have no words, repeated rows count each, other columns do not matter, an empty table gives none.
    """
    docs = df.select(F.coalesce(F.url_encode(lang), F.lit("und")).alias("__lang"), F.col(text).alias("__text"))
    counts, languages, hot = ngrams(docs, longest, least)
    of = F.split("key", "\t")
    candidates = counts.where("words > 1").select("key", "words", F.col("n").alias("a"), of[0].alias("lang"), F.slice(of, 2, F.col("words")).alias("w"))

    def key_of(words: Column) -> Column:
        return F.concat_ws("\t", "lang", words)

    spread = F.when(F.col("words").eqNullSafe(1) & _word(1).isin(hot), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    parts = cut(counts.select("key", "n", F.explode(spread).alias("lane")))

    def lane(words: Column) -> Column:
        return F.when((F.size(words) == 1) & words[0].isin(hot), F.pmod(F.xxhash64("key"), F.lit(SPREAD))).otherwise(0).cast("int")

    k, size = F.col("k"), F.col("words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    first, rest = F.slice("w", F.lit(1), k), F.slice("w", k + 1, size - k)
    cuts = cuts.select("key", "a", "k", key_of(first).alias("first"), lane(first).alias("first_lane"), key_of(rest).alias("rest"), lane(rest).alias("rest_lane"))
    for part, name in (("first", "l"), ("rest", "r")):
        side = parts.select(F.col("key").alias(part), F.col("n").alias(name), F.col("lane").alias(f"{part}_lane"))
        cuts = cuts.join(side, [part, f"{part}_lane"])
    exact = "CAST({} AS DECIMAL(20, 0))".format
    score = F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * {exact('a')} * {exact('a')} DIV ({exact('l')} * {exact('r')})")
    weakest = cuts.groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = candidates.where("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    longer = inner.groupBy(key_of(F.slice("w", F.col("at"), F.col("m"))).alias("key")).agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).join(weakest, "key")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", F.array_join("w", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(languages, "lang").select(
        F.url_decode("lang").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
