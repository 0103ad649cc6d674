"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams per language in one pass and one aggregation; what reaches the driver is one
number per language and bucket. Scoring broadcasts the matrix of log-probabilities (buckets times
languages, four bytes each) and treats a batch of texts as a sparse matrix of n-gram occurrences: one
gather and one sum per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordstack.llm.corpus import columns, map_texts, read, spans

#: Lengths of n-grams in characters.
ORDERS = (1, 2, 3, 4)
N_BUCKETS = 1 << 16
#: Labelled documents the classifier is fitted on, per language, in expectation; all below that.
FIT_DOCUMENTS = 20_000
#: Languages a model may have. With it the broadcast matrix has a proven bound of 128 MB.
MAX_LANGUAGES = 512
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Characters scored in one step; occurrences take some 60 bytes each while that lasts.
STEP_CHARS = 1 << 19

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters, made once in each worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def points(text: str) -> np.ndarray:
    """Lower-cased code points; every run of other characters than letters is one space."""
    made = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[made]
    made = np.where(is_letter, made, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return made[keep]


def buckets(chars: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of all n-grams of one sequence, order after order."""
    wide = chars.astype(np.uint64)
    hashed, out = np.zeros(len(wide), dtype=np.uint64), []
    for n in range(1, max(ORDERS) + 1):
        if len(wide) < n:
            break
        hashed = (hashed[: len(wide) - n + 1] + wide[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
        if n in ORDERS:
            out.append(((hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(n_buckets))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def pieces(text: str) -> Iterator[np.ndarray]:
    """Buckets of a whole text, in steps of bounded size. N-grams across a step's end are kept."""
    tail = ""
    for lo in range(0, len(text), STEP_CHARS):
        part = text[lo : lo + STEP_CHARS]
        made = points(tail + part)
        found = buckets(made, N_BUCKETS)
        if tail:
            found = _without(found, buckets(points(tail), N_BUCKETS))
        yield found
        tail = part[-(max(ORDERS) - 1) :]


def _without(found: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Occurrences that the step before has counted, once each, are taken out."""
    counts = np.bincount(found, minlength=N_BUCKETS) - np.bincount(seen, minlength=N_BUCKETS)
    return np.repeat(np.arange(N_BUCKETS), np.maximum(counts, 0))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages, float32

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: its posterior, the evidence taken per square root of the
        number of n-grams, since neighbouring n-grams are far from independent."""
        return [self._one(t) for t in texts]

    def _one(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text:
            return UNDETERMINED, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for found in pieces(text):
            total += self.log_prob[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        if not n:
            return UNDETERMINED, 0.0
        best = int(np.argmax(total + self.log_prior))
        evidence = total / np.sqrt(n) + self.log_prior
        weights = np.exp(evidence - evidence.max())
        return self.languages[best], float(weights[best] / weights.sum())


def fit(labelled: DataFrame, n_documents: int = FIT_DOCUMENTS) -> Model:
    """A model of ``labelled`` (``doc_id``, ``text``, ``lang``).

    Rows with a null in any of the three teach nothing, nor do texts without a letter. A language with
    more than ``n_documents`` rows is thinned by a hash of ``doc_id`` to about as many. Without any
    usable row the model knows no language and answers ``und``.
    """
    known = columns(labelled, "doc_id", "text", "lang").dropna()
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1)
    n_by = {r["lang"]: r["n"] for r in sizes.collect()}
    if len(n_by) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not n_by:
        return Model([], np.zeros(0), np.zeros((N_BUCKETS, 0), dtype=np.float32))
    big = {lang: n_documents / n for lang, n in n_by.items() if n > n_documents}
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    if big:
        share = F.create_map(*[F.lit(x) for pair in big.items() for x in pair])
        known = known.filter(drawn < F.coalesce(share[F.col("lang")], F.lit(1.0)))
    counted = known.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((N_BUCKETS, len(languages)))
    lang_at = np.array([at[x] for x in rows["lang"].to_pylist()], dtype=np.int64)
    counts[rows["bucket"].to_numpy().astype(np.int64), lang_at] = rows["n"].to_numpy()
    counts += SMOOTHING
    log_prob = np.log(counts / counts.sum(axis=0)).astype(np.float32) if languages else counts
    prior = np.array([n_by[x] for x in languages], dtype=np.float64)
    return Model(languages, np.log(prior / prior.sum()) if languages else prior, log_prob)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row for each language and bucket that occurs."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lo, hi in spans(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                into = held.setdefault(lang, np.zeros(N_BUCKETS, dtype=np.int64))
                for found in pieces(text):
                    into += np.bincount(found, minlength=N_BUCKETS)
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def identify(df: DataFrame, model: Model) -> DataFrame:
    """``df`` without its text, with ``lang_pred`` and ``score`` (0 to 1).

    ``und`` with score 0 for a null text and one without a letter. Only ``text`` is looked at; a
    column of ``df`` named like one of the two is replaced. Whole texts count, in steps of bounded size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(
        df.drop("lang_pred", "score"),
        lambda texts: shared.value.predict(texts),
        "lang_pred string, score double",
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose checksum of the id leaves no 2 modulo 4.

    A null ``doc_id`` is not held out and teaches nothing.
    """
    docs = columns(read(spark, sf_dir), "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of at least ``least``.

    All columns stay as they are. Rejected: null texts, texts without a letter, and texts the model
    cannot tell apart. A model without languages rejects by the letters alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                if shared.value.languages:
                    keep = [s >= least and p != UNDETERMINED for p, s in shared.value.predict(texts)]
                else:
                    keep = [bool(t) and any(c.isalpha() for c in t) for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
