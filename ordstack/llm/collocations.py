"""Collocations by Toivonen's sampling: frequent phrases found in a sample, counted exactly in all texts.

A phrase of two or more words can only be frequent if it is so without its first and without its last
word. A sample proposes phrases at a lowered threshold. A full pass then counts the proposed phrases and
their negative border: every phrase that occurs and whose two shorter parts are both proposed (all single
words belong to it). Border phrases that turn out frequent are the sample's failures; the closing pass
follows them up: it counts the phrases they are part of, and the phrases those are part of, at once. A
frequent phrase has only frequent parts, so after that pass nothing frequent is left uncounted. The sample
decides how much is counted, never the result.

The first full pass counts by a hash of language and phrase, so short rows are shuffled, not texts. What
reaches the threshold there includes every frequent phrase of its kind; the closing pass counts these by
their text, which is exact whatever hashes collide. Sets of phrases travel as bitmaps of fixed size (packed,
so few phrases are few bytes); a bit that two phrases share only makes a pass count more.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordstack.llm.bitmap import Bitmap, bitmap_of
from ordstack.llm.corpus import columns, read
from ordstack.operators.lookup import Mapping, lookup, mapping
from ordstack.session import store

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
UNKNOWN = "und"
#: One document in this many is sampled, and what a phrase must reach there, as a share of what
#: MIN_COUNT means for a sample of that size.
SAMPLE = 16
LOWERED = 0.5
#: Bits of the bitmap, 16 MB. Beyond some ten million proposals a pass counts ever more phrases that
#: are in no border; results stay the same.
BITMAP_BITS = 1 << 27
#: Bytes of text a task of the closing pass reads, unless that leaves cores without a task.
TASK_BYTES = 128 << 20
#: Bytes of text counted together. A longer text is counted in several steps.
STEP_BYTES = 4 << 20

_ROWS = 1 << 16  # of a record batch that a task returns
_KEPT = 1 << 19  # phrases whose counts a task keeps before it returns them
_BREAK = b"."
#: The characters that end a piece, and A-Z, which become a-z.
_PLAIN = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0dABCDEFGHIJKLMNOPQRSTUVWXYZ", b".........abcdefghijklmnopqrstuvwxyz")
_SPACE_OR_BREAK = b" \t."
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def tokens(text: bytes) -> list[bytes]:
    """Words of a text; ``.`` stands between pieces and is no word."""
    return text.translate(_PLAIN).replace(_BREAK, b" . ").split()


def steps(text: bytes, size: int = STEP_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """Tokens of a whole text in steps of about ``size`` bytes, cut between words. Each step but the first
    repeats the last words of the one before; their number comes along."""
    if len(text) <= size:
        yield tokens(text), 0
        return
    text, lo, carried = text.translate(_PLAIN), 0, []
    while lo < len(text):
        hi = min((i for i in (text.find(c, lo + size) for c in (b" ", b"\t", b".")) if i >= 0), default=len(text))
        made = carried + tokens(text[lo:hi])
        yield made, len(carried)
        carried, lo = made[-(MAX_WORDS - 1) :], hi


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


class Batch:
    """Words of one language as numbers, gathered until there are enough to count; 0 ends a piece."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_BREAK]
        self.parts: list[np.ndarray] = []
        self.stale: list[np.ndarray] = []
        self.bytes = 0

    def add(self, found: list[bytes], carried: int, size: int) -> None:
        made = np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int32, count=len(found))
        self.parts += [made, np.zeros(1, dtype=np.int32)]
        self.stale.append(np.arange(len(made) + 1) < carried)
        self.bytes += size

    @cached_property
    def names(self) -> list[bytes]:
        """Words by their numbers, once all are in."""
        return list(self.numbers)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, and whether a phrase may end there: repeated words of a step have been counted."""
        return np.concatenate(self.parts), ~np.concatenate(self.stale)


@dataclass(frozen=True)
class Counter:
    """Which phrases a pass counts.

    Without ``likely``: those whose two shorter parts are in ``proposed`` (all, without one). The bitmap
    decides about parts of up to ``decided`` words, longer parts pass. Phrases of fewer than ``first`` or
    more than ``last`` words are left out. With ``likely``, the phrases that reached the threshold in such a
    pass: those, and every phrase that pass has not counted and whose parts are in ``likely`` or themselves
    not counted by it.
    """

    proposed: Bitmap | None = None
    likely: Bitmap | None = None
    first: int = 1
    last: int = MAX_WORDS
    decided: int = MAX_WORDS

    def count(self, lang: str, batch: Batch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per number of words: the batch's words, and of different phrases where one starts, how often it
        occurs, its hash."""
        word, fresh = batch.words()
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        by_word = np.array([xxhash.xxh64_intdigest(p, seed) for p in batch.numbers], dtype=np.uint64)
        at = np.flatnonzero(word)  # where phrases start
        hashes = by_word[word[at]]
        counted = np.ones(len(at), dtype=bool)  # by the first full pass
        chosen = self._chosen(hashes, counted)
        for m in range(1, self.last + 1):
            if m > 1:
                # a phrase of m words starts where one of m - 1 words starts, and another one word later
                inside, held = self._inside(hashes, counted, chosen, m - 1)
                goes_on = np.flatnonzero((at[1:] == at[:-1] + 1) & inside[1:] & inside[:-1])
                counted = held[goes_on] & held[goes_on + 1]
                at = at[goes_on]
                hashes = _mixed(hashes[goes_on] * _MIX[0] + by_word[word[at + m - 1]] + np.uint64(m))
                chosen = self._chosen(hashes, counted)
            if not len(at):
                return
            wanted = np.flatnonzero(chosen & fresh[at + m - 1])
            if m >= self.first and len(wanted):
                yield m, word, *_distinct(word, at[wanted], hashes[wanted], m)

    def _chosen(self, hashes: np.ndarray, counted: np.ndarray) -> np.ndarray:
        return np.ones(len(hashes), dtype=bool) if self.likely is None else self.likely.holds(hashes) | ~counted

    def _inside(
        self, hashes: np.ndarray, counted: np.ndarray, chosen: np.ndarray, m: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases of ``m`` words longer ones may be made of, in this and in the first full pass."""
        if self.proposed is None or m > self.decided:
            return np.ones(len(hashes), dtype=bool), counted
        held = self.proposed.holds(hashes) & counted
        return (held, held) if self.likely is None else (chosen, held)


def _distinct(word: np.ndarray, at: np.ndarray, hashes: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """Of phrases of ``m`` words that start ``at``: one start each, how often it occurs, its hash. Equal
    hashes are checked word by word; should two phrases share one, phrases are told apart by their words."""
    codes, _ = pd.factorize(hashes)
    n = int(codes.max()) + 1
    first = np.empty(n, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(at))[::-1]
    same = all((word[at + j] == word[at[first][codes] + j]).all() for j in range(m))
    if not same:
        rows = np.stack([word[at + j] for j in range(m)], axis=1)
        _, first, codes = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        codes, n = codes.ravel(), len(first)
    return at[first], np.bincount(codes, minlength=n), hashes[first]


def _counted(docs: DataFrame, rules: dict, size: int, by_text: bool) -> DataFrame:
    """Counts of ``docs`` (``lang``, ``text``), summed per batch: ``(hash, n)``, or by text and per task
    ``(lang, phrase, n)``, with the number of words of a language under the empty phrase. ``rules`` holds the fields of a
    ``Counter``, bitmaps as broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(**{k: getattr(v, "value", v) for k, v in rules.items()})
        held: dict[str, Batch] = {}
        sums: dict[str, dict[bytes, int]] = {}  # by text: phrases recur from batch to batch

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            batch = held.pop(lang)
            for m, word, starts, counts, hashes in counter.count(lang, batch):
                for lo in range(0, len(starts), _ROWS):
                    at = slice(lo, lo + _ROWS)
                    if by_text:
                        add(lang, _phrases(batch, word, starts[at], m), counts[at].tolist())
                    else:
                        made = [pa.array(hashes[at].view(np.int64)), pa.array(counts[at])]
                        yield pa.RecordBatch.from_arrays(made, names=["hash", "n"])
            if by_text:
                word, fresh = batch.words()
                add(lang, [b""], [int(np.count_nonzero((word > 0) & fresh))])
                if sum(map(len, sums.values())) > _KEPT:
                    yield from summed()

        def add(lang: str, phrases: list[bytes], counts: list[int]) -> None:
            into = sums.setdefault(lang, {})
            for p, n in zip(phrases, counts):
                into[p] = into.get(p, 0) + n

        def summed() -> Iterator[pa.RecordBatch]:
            for lang, of in sums.items():
                phrases, counts = list(of), np.fromiter(of.values(), dtype=np.int64, count=len(of))
                for lo in range(0, len(phrases), _ROWS):
                    yield _texts(lang, phrases[lo : lo + _ROWS], counts[lo : lo + _ROWS])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                buffer = text.as_buffer()
                for made, carried in steps(buffer.to_pybytes() if buffer else b"", size):
                    held.setdefault(lang, Batch()).add(made, carried, min(len(buffer or b""), size))
                    if held[lang].bytes >= size:
                        yield from flush(lang)
                    elif sum(b.bytes for b in held.values()) >= 2 * size:
                        yield from flush(max(held, key=lambda x: held[x].bytes))
        for lang in list(held):
            yield from flush(lang)
        yield from summed()

    return docs.mapInArrow(run, "lang string, phrase string, n long" if by_text else "hash long, n long")


def _phrases(batch: Batch, word: np.ndarray, starts: np.ndarray, m: int) -> list[bytes]:
    """Texts of the phrases of ``m`` words at ``starts``."""
    names = batch.names
    return [b" ".join(x) for x in zip(*[map(names.__getitem__, word[starts + j].tolist()) for j in range(m)])]


def _texts(lang: str, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), dtype=np.int32)), pa.array([lang]))
    texts = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [langs.dictionary_decode(), texts, pa.array(counts.astype(np.int64))], names=["lang", "phrase", "n"]
    )


def _bitmap(counted: DataFrame, least: int, bits: int) -> Bitmap:
    """The phrases that reach ``least``."""
    kept = counted.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return bitmap_of(kept.select("hash"), bits)


def frequent_phrases(
    docs: DataFrame,
    least: int = MIN_COUNT,
    sample: int = SAMPLE,
    lowered: float = LOWERED,
    size: int = STEP_BYTES,
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """``(lang, phrase, words, n)``: every phrase of 1 to MAX_WORDS words that occurs ``least`` times in its
    language, counted exactly, and per language a row of no words with its number of words.

    ``docs`` has ``doc_id``, ``text`` and ``lang``. A null text is empty, a null language ``und``. Repeated
    rows count each. Other columns are not looked at. No rows, no phrases.
    """
    context = docs.sparkSession.sparkContext
    lang = F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang")
    texts = columns(docs, "doc_id", "text", "lang").select(lang, F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(sample)) == 0
    few, texts = texts.filter(drawn).select("lang", "text"), texts.select("lang", "text")
    enough = max(1, int(least * lowered / sample))
    # the sample proposes words and pairs, then longer phrases that are made of proposed pairs
    pairs = _bitmap(_counted(few, {"last": 2}, size, False), enough, bits)
    start = context.broadcast(pairs)
    longer = {"proposed": start, "first": 3, "decided": 2}
    proposed = context.broadcast(pairs.with_all(_bitmap(_counted(few, longer, size, False), enough, bits)))
    likely = context.broadcast(_bitmap(_counted(texts, {"proposed": proposed}, size, False), least, bits))
    # most frequent phrases occur in every task, so a task reads as much as it may: fewer sums are shuffled
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(context.defaultParallelism, -(-total // TASK_BYTES))
    closing = _counted(texts.coalesce(tasks), {"proposed": proposed, "likely": likely}, size, True)
    sums = closing.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    kept = sums.filter((F.col("n") >= least) | (F.col("phrase") == ""))
    out = store(kept.select("lang", "phrase", words.alias("words"), "n"), "phrases")
    for b in (start, proposed, likely):
        b.destroy()
    return out


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *parts)  # no word holds a line break


def scored(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, words, a, l, r, n, score)`` of the phrases of two words and more that no longer one
    with the same count contains. ``score`` is that of the lowest-scoring cut, the first of equal ones.

    Part counts are looked up with hot parts (a common first word) spread over partitions."""
    totals = phrases.filter("words = 0").select("lang", F.col("n").alias("total"))
    counts = store(phrases.filter("words > 0").withColumn("key", _key("lang", "phrase")), "phrase-counts")
    long = counts.filter("words > 1")
    # a phrase inside a longer one with its count lies inside one that is longer by one word, with that count
    parts = F.split("phrase", " ")
    shorter = (
        long.filter("words > 2")
        .select("lang", "n", F.explode(F.array(
            F.array_join(F.slice(parts, F.lit(1), F.col("words") - 1), " "),
            F.array_join(F.slice(parts, F.lit(2), F.col("words") - 1), " "))).alias("part"))
        .groupBy(_key("lang", "part").alias("key")).agg(F.max("n").alias("within"))
    )
    kept = long.join(shorter, "key", "left").filter("within IS NULL OR 100 * within < 100 * n")
    cuts = kept.select(
        F.col("key").alias("whole"), "lang", "phrase", "words", F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    ).withColumns({
        "left_key": _key("lang", F.expr("substring_index(phrase, ' ', k)")),
        "right_key": _key("lang", F.expr("substring_index(phrase, ' ', k - words)")),
        "row_id": F.xxhash64("phrase"),
    })
    known: Mapping = mapping(counts.select("key", "n"), "key", "phrase-parts")
    cuts = lookup(lookup(cuts, known, "left_key", {"n": "l"}), known, "right_key", {"n": "r"})
    # 1000 * a and n have 19 and 18 digits at most, their product 37; the score is at most 1000 * n / a
    score = F.expr("CAST(1000 * a AS DECIMAL(19,0)) * CAST(total AS DECIMAL(18,0)) "
                   "div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")  # fmt: skip
    with_total = cuts.join(F.broadcast(totals), "lang").withColumn("score", score.cast("long"))
    return (
        with_total.groupBy("whole")
        .agg(F.min(F.struct("score", "k", "lang", "phrase", "words", "a", "l", "r", F.col("total").alias("n"))).alias("c"))
        .select("c.lang", "c.phrase", "c.words", "c.a", "c.l", "c.r", "c.n", "c.score")
    )


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, **sampling) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: per language the first ``top`` phrases by score, then
    count, then the bytes of the phrase. See ``frequent_phrases`` for nulls and repeated rows."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (
        scored(frequent_phrases(docs, least, **sampling))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, per language."""
    return collocations(read(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p AS text FROM (
    SELECT doc_id, lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(text, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM words, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1),
inside AS (
  SELECT c.lang, array_to_string(string_split(c.phrase, ' ')[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM c, (SELECT unnest(range(2, 5)) AS k) ks, (SELECT unnest(range(1, 5)) AS i) s
  WHERE k < m AND i + k - 1 <= m GROUP BY ALL),
kept AS (
  SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (
  SELECT kept.lang, kept.phrase, kept.a, k, l.a AS l, r.a AS r, n,
         (CAST(1000 AS HUGEINT) * kept.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM kept JOIN total ON total.lang = kept.lang JOIN (SELECT unnest(range(1, 5)) AS k) ks ON k < kept.m
  JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(string_split(kept.phrase, ' ')[1:k], ' ')
  JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(string_split(kept.phrase, ' ')[k + 1:], ' ')),
low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
