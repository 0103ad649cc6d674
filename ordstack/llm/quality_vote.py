"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and their shapes (``THE!!`` is ``A!``), hashed, and how often a word follows
itself or a line comes again. Terms are weighted by log frequency and inverse document frequency, and a
truncated singular value decomposition of the labelled sample gives the latent space. The labelled vectors
are broadcast (their number and width are parameters, so the size has a bound). Every document is compared
with all of them, a block of documents against the whole matrix at a time; the nearest vote with their
labels, weighted by a power of the cosine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordstack.llm.corpus import columns, map_texts, read

#: Labelled documents the classifier is fitted on, at most; drawn by a hash of the id.
FIT_DOCUMENTS = 4096
#: Buckets of words and of shapes, then one each for repeated words, repeated lines and emptiness.
WORDS = 1 << 14
SHAPES = 1 << 10
REPEATED, LINES, EMPTY = WORDS + SHAPES, WORDS + SHAPES + 1, WORDS + SHAPES + 2
TERMS = WORDS + SHAPES + 3
#: Width of the latent space, passes of the iteration that finds it, neighbours that vote.
WIDTH = 64
PASSES = 4
NEIGHBOURS = 32
#: Exponent of the cosine in a vote, and weight of the share of label 1 in it.
POWER = 8
PRIOR = 0.02
THRESHOLD = 0.7
#: Documents compared in one block, bytes of text looked at in one step, words a task remembers.
BLOCK = 512
STEP_BYTES = 1 << 20
REMEMBERED = 1 << 19

_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
#: Letters of either case and digits stand for their class in a shape.
_CLASS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(128, 256)),
    b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128,
)


def shape(word: bytes) -> bytes:
    """Classes of a word's characters, runs of one class once. Characters beyond ASCII count as letters."""
    return _RUNS.sub(rb"\1", word.translate(_CLASS))


class Codes(dict):
    """Buckets of a word and of its shape, packed into one number, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        by_word = xxhash.xxh64_intdigest(word.lower()) % WORDS
        self[word] = made = by_word * SHAPES + xxhash.xxh64_intdigest(shape(word)) % SHAPES
        return made


def _steps(text: bytes) -> Iterator[bytes]:
    """A whole text in steps, cut between lines, or between words of a line that is longer than a step."""
    lo = 0
    while lo < len(text):
        hi = lo + STEP_BYTES
        if hi < len(text):
            cut = text.rfind(b"\n", lo, hi)
            cut = cut if cut > lo else text.find(b" ", hi)
            hi = cut if cut > lo else len(text)
        yield text[lo:hi]
        lo = hi


def terms(text: str | None, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's terms and how often each occurs."""
    counts = np.zeros(TERMS, dtype=np.int64)
    last, lines = -1, set()
    for part in _steps((text or "").encode("utf-8", "surrogatepass")):
        words = part.split()
        found = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
        counts[:WORDS] += np.bincount(found // SHAPES, minlength=WORDS)
        counts[WORDS : WORDS + SHAPES] += np.bincount(found % SHAPES, minlength=SHAPES)
        follows = np.concatenate([[last], found])
        counts[REPEATED] += int((follows[1:] == follows[:-1]).sum())
        last = follows[-1]
        for line in part.split(b"\n"):
            key = xxhash.xxh64_intdigest(line)
            counts[LINES] += bool(line.strip()) and key in lines
            lines.add(key)
    if not counts.any():
        counts[EMPTY] = 1
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class Voters:
    """The fitted classifier. ``basis`` maps weighted terms to the latent space; ``vectors`` are the
    labelled documents there, of length 1. At most TERMS x WIDTH and FIT_DOCUMENTS x WIDTH floats."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        made = np.zeros((len(found), self.basis.shape[1]), dtype=np.float32)
        for i, (at, n) in enumerate(found):
            made[i] = weights(at, n, self.idf) @ self.basis[at]
        return unit(made)

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of label 1 in the votes of the nearest, between 0 and 1. Without voters 0."""
        if not len(self.labels):
            return np.zeros(len(found))
        k = min(NEIGHBOURS, len(self.labels))
        prior = self.labels.mean()
        out = np.empty(len(found))
        for lo in range(0, len(found), BLOCK):
            cosines = self.embed(found[lo : lo + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1).astype(np.float64) ** POWER
            held = (votes * self.labels[near]).sum(axis=1) + PRIOR * prior
            out[lo : lo + BLOCK] = held / (votes.sum(axis=1) + PRIOR)
        return out


def weights(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    made = (1 + np.log(n)) * idf[at]
    return (made / max(np.linalg.norm(made), 1e-12)).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class _Sparse:
    """Rows of weighted terms, multiplied from either side."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        sizes = [len(at) for at, _ in rows]
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.term = np.concatenate([at for at, _ in rows])
        self.value = np.concatenate([w for _, w in rows])
        self.by_term = np.argsort(self.term, kind="stable")

    def times(self, right: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.bincount(self.row, self.value * c[self.term], self.n) for c in right.T], axis=1
        )

    def transposed_times(self, right: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.bincount(self.term, self.value * c[self.row], TERMS) for c in right.T], axis=1
        )


def basis_of(rows: list[tuple[np.ndarray, np.ndarray]], width: int, seed: int = 42) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a seeded start. Their signs are fixed."""
    matrix = _Sparse(rows)
    start = np.random.default_rng(seed).standard_normal((TERMS, width + 8))
    space = np.linalg.qr(matrix.times(start))[0]
    for _ in range(PASSES):
        space = np.linalg.qr(matrix.times(np.linalg.qr(matrix.transposed_times(space))[0]))[0]
    found = np.linalg.svd(matrix.transposed_times(space), full_matrices=False)[0][:, :width]
    return (found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])).astype(np.float32)


def _terms_of(texts: list[str | None], codes: Codes) -> list[tuple]:
    return [(at.tolist(), n.tolist()) for at, n in (terms(t, codes) for t in texts)]


def fit(docs: DataFrame, labels: DataFrame, n_documents: int = FIT_DOCUMENTS) -> Voters:
    """A classifier of ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``quality`` 0 or 1).

    Rows with a null id or label teach nothing; other labels than 0 and 1 neither. Of more rows than
    ``n_documents`` those of the smallest hashes of the id are taken. Null and empty texts are texts
    without terms. Without a usable row there are no voters, and every score is 0.
    """
    drawn = F.xxhash64(F.lit("fit"), "doc_id")
    known = columns(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    chosen = known.distinct().orderBy(drawn, "doc_id", "quality").limit(n_documents)
    codes = Codes()
    found = map_texts(
        columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"),
        lambda texts: _terms_of(texts, codes),
        "at array<bigint>, n array<bigint>",
    )
    rows = found.orderBy(drawn, "doc_id", "quality", F.xxhash64("at", "n")).limit(n_documents).toArrow()
    if not rows.num_rows:
        nothing = np.zeros((0, WIDTH), dtype=np.float32)
        return Voters(np.ones(TERMS), np.zeros((TERMS, WIDTH), dtype=np.float32), nothing, np.zeros(0))
    lists = [np.array(x, dtype=np.int64) for x in rows["at"].to_pylist()]
    counts = [np.array(x, dtype=np.int64) for x in rows["n"].to_pylist()]
    held = np.bincount(np.concatenate(lists), minlength=TERMS)
    idf = np.log((1 + len(lists)) / (1 + held)) + 1
    weighted = [(at, weights(at, n, idf)) for at, n in zip(lists, counts)]
    made = Voters(idf, basis_of(weighted, WIDTH), np.zeros((0, WIDTH)), np.zeros(0))
    return Voters(idf, made.basis, made.embed(list(zip(lists, counts))), rows["quality"].to_numpy().astype(np.float64))


def scored(df: DataFrame, voters: Voters) -> DataFrame:
    """``df`` without its text, with ``score`` (0 to 1, higher where label 1 is likelier). Only ``text`` is
    looked at, whole; a column of ``df`` named ``score`` is replaced. Null texts score as empty ones do."""
    shared = df.sparkSession.sparkContext.broadcast(voters)
    codes = Codes()

    def work(texts: list[str | None]) -> list[tuple]:
        made = []
        for lo in range(0, len(texts), BLOCK):
            found = [terms(t, codes) for t in texts[lo : lo + BLOCK]]
            made += [(float(s),) for s in shared.value.scores(found)]
        return made

    return map_texts(df.drop("score"), work, "score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the checksum of the id leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op11_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labelled ones that are not held out.

    Repeated rows have a row each. An empty table gives no rows.
    """
    docs = columns(read(spark, sf_dir), "doc_id", "text")
    labels = columns(read(spark, sf_dir, "labels"), "doc_id", "quality")
    voters = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    made = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), voters)
    return made.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
