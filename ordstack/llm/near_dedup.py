"""Near duplicates by the Jaccard coefficient of word shingles: MinHash keys, then an exact check.

Fingerprints of 64 bits can't serve a similarity of 0.8: there they differ by about ten bits, and the
pigeonhole keys for that distance would have a few bits each. Texts meet instead under ``BANDS`` keys of
``ROWS`` minima of their shingles' hashes; two texts of coefficient j share a key with probability
1 - (1 - j^ROWS)^BANDS, which is 0.9996 at 0.8. Texts with the same shingles are one before that, so copies
never meet each other.

Pairs are screened by size and by their signatures (the minima, two bytes each): a pair of coefficient 0.8
agrees in fewer than ``SCREEN`` of the 100 with a probability of some 10^-6. What passes is compared shingle
by shingle. In ``LEADER_ROUNDS`` rounds every text is compared with the first text under each of its keys,
and what is like one follows it and leaves all its keys. Texts that are left are compared pair by pair, in
blocks of a key's texts, so that no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordstack.llm.corpus import columns, map_texts, spans, unused
from ordstack.llm.graph import components
from ordstack.session import store

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SEED = 42
#: Share of equal minima below which a pair is not compared shingle by shingle.
SCREEN = 0.6
#: Rounds in which texts are compared with the first under each of their keys, before pairs are.
LEADER_ROUNDS = 3
#: Texts of a key that one block holds; a task compares two blocks.
BLOCK = 256
_STEP = 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words, in order; a shorter text is one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    made = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())]
    return np.unique(np.array(made, dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """One signed key per band, and the signature; none for a text without a word."""
    if not len(hashes):
        return [], b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), _STEP):
        x = hashes[lo : lo + _STEP][None, :] * _FACTORS[0]
        x ^= x >> np.uint64(32)
        x *= _FACTORS[1]
        np.minimum(least, x.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in rows], dtype=np.uint64)
    return keys.view(np.int64).tolist(), (least >> np.uint64(20)).astype("<u2").tobytes()


def _text_key(doc_id: Column, th: Column) -> Column:
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), th.cast("string"))


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """``(sh, at, n, bands, sig)`` per different set of shingles: its hash, its first row, its size, its keys
    and its signature."""

    def work(texts: list[str | None]) -> list[tuple]:
        made = []
        for text in texts:
            x = shingles(text, size)
            made.append((xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63), len(x), *band_keys(x)))
        return made

    keyed = columns(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    prints = store(map_texts(keyed, work, "sh long, n long, bands array<bigint>, sig binary"), "shingle-prints")
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"), F.col("sh"))
    firsts = prints.groupBy("sh").agg(F.min(at).alias("at"))
    bands = prints.join(firsts.select(F.col("sh").alias("_sh"), "at"), F.col("sh") == F.col("_sh"))
    same = (F.col("th") == F.col("at.th")) & F.col("doc_id").eqNullSafe(F.col("at.doc_id"))
    return store(bands.filter(same).select("sh", "at", "n", "bands", "sig").dropDuplicates(["sh"]), "shingle-nodes")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(sh, of)``: the shingles of the nodes ``wanted`` (``sh``, ``at``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                made = [shingles(t, size).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["sh", "of"])

    keys = wanted.select("sh", _text_key(F.col("at.doc_id"), F.col("at.th")).alias("_key"))
    keyed = docs.select(_text_key(F.col("doc_id"), F.xxhash64("text")).alias("_key"), "text")
    once = keyed.join(keys, "_key").dropDuplicates(["_key"]).select("sh", "text")
    return store(once.mapInArrow(run, "sh long, of array<bigint>"), "shingle-sets")


def _alike(a: Column, b: Column, least: float) -> Column:
    """Whether the sizes of two sets allow the coefficient."""
    return (a >= least * b - 1e-9) & (b >= least * a - 1e-9)


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` that reach the coefficient. A text's shingles move once per pair at most."""
    both = F.size(F.array_intersect("of_a", "of_b"))
    a, b = sets.toDF("a", "of_a"), sets.toDF("b", "of_b")
    joined = pairs.join(a, "a").join(b, "b")
    return joined.filter(both >= least * (F.size("of_a") + F.size("of_b") - both) - 1e-9).select("a", "b")


def _screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures agree often enough."""
    sides = [nodes.select(F.col("sh").alias(x), F.col("sig").alias(f"sig_{x}")) for x in ("a", "b")]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_signatures(batch.column(i).to_pylist()) for i in (2, 3))
                keep = (x == y).mean(axis=1) >= SCREEN
                yield batch.select([0, 1]).filter(pa.array(keep))

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _signatures(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<u2").reshape(len(packed), BANDS * ROWS)


def _block_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Screened pairs (a, b), b before a, of two blocks each: lists of ``sh``, ``n``, ``sig`` and of the
    block, sorted by place. A block is compared with itself or with the other one."""
    for batch in batches:
        found_a, found_b = [], []
        for row in batch.column(0):
            of = row.as_py()
            sh = np.array([x["sh"] for x in of], dtype=np.int64)
            n = np.array([x["n"] for x in of], dtype=np.float64)
            block = np.array([x["block"] for x in of])
            signature = _signatures([x["sig"] for x in of])
            one = block.min() == block.max()
            for i in range(1, len(of)):
                ok = (n[:i] >= least * n[i] - 1e-9) & (n[i] >= least * n[:i] - 1e-9)
                at = np.flatnonzero(ok if one else ok & (block[:i] != block[i]))
                at = at[(signature[at] == signature[i]).mean(axis=1) >= SCREEN] if len(at) else at
                found_a.append(np.full(len(at), sh[i]))
                found_b.append(sh[at])
        made = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found_a, found_b)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["a", "b"])


def _links(docs: DataFrame, nodes: DataFrame, size: int, least: float, rounds: int, block: int) -> DataFrame:
    """Links ``(a, b)`` of similar nodes under one key, b before a, such that no two nodes without a link to
    an earlier one are similar and share a key.

    Such nodes never follow a leader, so they stay under all their keys to the end, where all pairs are
    compared. ``block`` decides how that is dealt out, not what is found.
    """
    keyed = nodes.select("sh", "at", "n", F.posexplode("bands").alias("k", "key"))

    def counted(rows: DataFrame) -> DataFrame:
        """Rows of keys that several nodes are under, and their number ``m``."""
        counts = rows.groupBy("k", "key").agg(F.count("*").alias("m")).filter("m > 1")
        return store(rows.join(counts, ["k", "key"]), "shingle-keys")

    rest = counted(keyed)
    met = rest.select("sh", "at").dropDuplicates(["sh"])
    sets = _sets(docs, met, size)
    signed = store(nodes.select("sh", "sig").join(met.select("sh"), "sh", "left_semi"), "shingle-signatures")
    found = []
    for _ in range(rounds):
        first = rest.groupBy("k", "key").agg(F.min(F.struct("at", "sh", "n")).alias("first"))
        pairs = (
            rest.join(first, ["k", "key"])
            .filter((F.col("sh") != F.col("first.sh")) & _alike(F.col("n"), F.col("first.n"), least))
            .select(F.col("sh").alias("a"), F.col("first.sh").alias("b")).distinct()
        )
        found.append(store(_similar(_screened(pairs, signed), sets, least), "shingle-followers"))
        followers = found[-1].select(F.col("a").alias("sh")).distinct()
        rest = counted(rest.drop("m").join(followers, "sh", "left_anti"))
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("sh"), blocks).cast("int")
    spread = rest.withColumn("blocks", blocks).withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    member = F.struct("at", "sh", "n", "sig", "block")
    grouped = (
        spread.join(signed, "sh")
        .groupBy("k", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .agg(F.sort_array(F.collect_list(member)).alias("of"))
        .select(F.transform("of", lambda x: F.struct(x["sh"].alias("sh"), x["n"].alias("n"), x["sig"].alias("sig"),
                                                     x["block"].alias("block"))).alias("of"))
    )
    pairs = grouped.mapInArrow(lambda batches: _block_pairs(batches, least), "a long, b long").distinct()
    found.append(store(_similar(pairs, sets, least), "shingle-links"))
    links = found[0]
    for f in found[1:]:
        links = links.union(f)
    return links


def keep_one(
    docs: DataFrame,
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    rounds: int = LEADER_ROUNDS,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` without near duplicates, all columns as they are, whatever their names.

    Documents are alike when the Jaccard coefficient of their ``size``-word shingles is ``similarity`` or
    more. Of a group the row of the smallest ``doc_id`` stays (null last; rows that tie leave the one of
    the smallest hash of the text). No two that stay are alike, but for pairs that share no key. Repeated
    rows leave one. Null and empty texts are one group. Very long texts are compared whole; their shingles
    take eight bytes a word in a task. An empty table gives no rows.
    """
    return rows_of(docs, kept_keys(docs, size, similarity, rounds, block))


def kept_keys(
    docs: DataFrame,
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    rounds: int = LEADER_ROUNDS,
    block: int = BLOCK,
) -> DataFrame:
    """``key`` of every document that ``keep_one`` keeps: one narrow row each, without the text."""
    nodes = _nodes(docs, size)
    roots = components(_links(docs, nodes, size, similarity, rounds, block))
    return (
        nodes.join(roots, nodes.sh == roots.u, "left")
        .groupBy(F.coalesce("v", "sh").alias("label"))
        .agg(F.min("at").alias("at"))
        .select(_text_key(F.col("at.doc_id"), F.col("at.th")).alias("key"))
    )


def rows_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` under ``keys``, one each, all columns as they are."""
    key, rank = unused(docs, "key"), unused(docs, "rank")
    chosen = keys.select(F.col("key").alias(key))
    keyed = docs.withColumn(key, _text_key(F.col("doc_id"), F.xxhash64("text")))
    order = Window.partitionBy(key).orderBy(F.xxhash64("text"))
    return (
        keyed.join(chosen, key, "left_semi")
        .withColumn(rank, F.row_number().over(order))
        .filter(F.col(rank) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
