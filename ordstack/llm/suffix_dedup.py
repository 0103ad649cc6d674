"""Exact removal of repeated substrings of LENGTH bytes, by suffix arrays of a difference cover.

Of every string of LENGTH bytes that also starts earlier, all bytes go. Three observations keep the
sorting small without losing any string:

* A window of LENGTH bytes is keyed by the smallest hash of its K-byte substrings, which depends on
  its content alone. Runs of neighbouring windows share a key, about 28 windows a run. A key that
  occurs once in the corpus belongs to no repeated window, and most keys do.
* Runs with the same bytes are repeated as a whole: all but the first are covered.
* What is left are different runs under one key, the rims of repeated passages. They are dealt out by
  key, so that equal windows meet, and every partition sorts the suffixes of its runs by the
  difference cover {1, 2} modulo 3: sampled triples are sorted and named, the names are sorted
  recursively, the remaining suffixes are merged in, and neighbours are compared on their LENGTH-byte
  prefixes. Equal windows are neighbours; all but the first go.

Copies of a run are summed up to its first place before its bytes are dealt out, so that a partition holds
different runs only, however often one of them is copied. A key with very many different runs (a passage
that a large part of the corpus quotes) is not put into one partition; its windows are aggregated by
content instead, before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordstack.llm.bitmap import bitmap_of
from ordstack.llm.corpus import columns, read, schema_of, spans, text_of, unused
from ordstack.session import store

LENGTH = 100
K = 48
#: Windows of one run at most; longer runs (repetitive text) are cut.
RUN = 64
#: Bits of the bitmap of keys that every task gets: 64 MB, packed while few are set. Keys that share a bit
#: with a wanted one only make runs that the sums drop again.
BITMAP_BITS = 1 << 29
#: Bytes of text whose runs are found in one step. A longer text is cut with LENGTH - 1 bytes in common.
STEP_BYTES = 1 << 18
#: Different runs of one key that one partition sorts, and bytes of runs per partition.
SORTED_RUNS = 4_096
PARTITION_BYTES = 1_000_000
#: Bytes of text per partition when keys are counted.
COUNT_BYTES = 32 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0xFF51AFD7ED558CCD)
    t = y ^ np.uint64(0x123456789)
    z += t
    np.right_shift(z, np.uint64(31), out=t)
    z ^= t
    z *= _ODD
    return z


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs_of`` one text, without the owner."""
    return runs_of([data])[1:]


def runs_of(
    texts: list[bytes], with_several: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of several texts: the text, key, first window, number of windows, and whether the
    key's substring occurs more than once in the run (only then can the run repeat a window within itself).

    Texts lie one after the other in one buffer; windows that reach into the next are left out."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = b"".join(texts)
    n_windows = len(data) - LENGTH + 1
    if n_windows < 1 or sizes.max() < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)  # at every byte
    w8 = _mixed(eight, eight)
    w16 = _mixed(w8[:-8], w8[8:])
    w32 = _mixed(w16[:-16], w16[16:])
    grams = _mixed(w32[: len(data) - K + 1], w16[32:])  # K = 32 + 16
    span = LENGTH - K + 1
    low = _sliding(grams, span, np.minimum)
    long = sizes >= LENGTH
    steps = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(steps, begins[long], 1)
    np.add.at(steps, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(steps[:n_windows]) > 0
    edge = np.concatenate([[True], (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])])
    edge[begins[long]] = True  # a text of LENGTH bytes may follow another's last window
    at = np.flatnonzero(edge)
    counts = np.diff(np.append(at, n_windows))
    kept = inside[at]
    first, counts = at[kept], counts[kept]
    if int(counts.max()) > RUN:
        pieces = -(-counts // RUN)
        inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(counts, pieces)
        first = np.repeat(first, pieces) + inner * RUN
        counts = np.minimum(RUN, whole - inner * RUN)
    keys = low[first]
    several = np.zeros(len(keys), dtype=bool)
    if with_several:
        several = _occurrences(grams, np.where(inside, low, np.uint64(0)), keys, first, counts, span) > 1
    owner = np.searchsorted(ends, first, side="right")
    return owner, keys, first - begins[owner], counts, several


def text_steps(texts: list[bytes], size: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts in steps of about ``size`` bytes: of each piece its text and where it starts in it. Pieces of a
    longer text share LENGTH - 1 bytes, so that every window lies in one of them."""
    held: list[tuple[int, int, bytes]] = []
    n = 0
    for i, x in enumerate(texts):
        for lo in range(0, max(1, len(x) - LENGTH + 1), size):
            piece = x[lo : lo + size + LENGTH - 1] if len(x) > size else x
            held.append((i, lo, piece))
            n += len(piece)
            if n >= size:
                yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]
                held, n = [], 0
    if held:
        yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]


def _sliding(x: np.ndarray, span: int, of) -> np.ndarray:
    """Smallest or largest of every ``span`` neighbours."""
    width = 1
    while 2 * width <= span:
        x = of(x[: len(x) - width], x[width:])
        width *= 2
    rest = span - width
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def _occurrences(
    grams: np.ndarray, low: np.ndarray, keys: np.ndarray, first: np.ndarray, sizes: np.ndarray, span: int
) -> np.ndarray:
    """How often each run's key is among the substrings of its windows. Only substrings that are the
    smallest of some window come into question: those that equal the largest of the minima around."""
    around = np.zeros(len(low) + 2 * (span - 1), dtype=np.uint64)
    around[span - 1 : span - 1 + len(low)] = low
    places = np.flatnonzero(grams == _sliding(around, span, np.maximum))
    begin = np.searchsorted(places, first)
    count = np.searchsorted(places, first + sizes + span - 1) - begin
    starts = np.cumsum(count) - count
    flat = np.arange(int(count.sum())) + np.repeat(begin - starts, count)
    same = grams[places[flat]] == np.repeat(keys, count)
    return np.add.reduceat(same, starts, dtype=np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a sequence of positive numbers, in order."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    padded = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    bits = int(padded.max()).bit_length()
    # sort the sampled triples; a sample after the end keeps the two classes apart in the recursion
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    if 3 * bits <= 62:
        packed = (padded[sample] << (2 * bits)) | (padded[sample + 1] << bits) | padded[sample + 2]
        order = np.argsort(packed)
        changed = np.diff(packed[order]) != 0
    else:
        triple = padded[sample], padded[sample + 1], padded[sample + 2]
        order = np.lexsort(triple[::-1])
        changed = np.any([np.diff(t[order]) != 0 for t in triple], axis=0)
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.concatenate([[1], 1 + np.cumsum(changed)])
    # recurse on the names unless they tell all suffixes apart
    if names[order[-1]] < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # merge the remaining suffixes: by one symbol and a rank, or by two symbols and a rank
    rest = np.arange(0, n, 3)
    one = padded[rest] * (n + 3) + rank[rest + 1]
    rest = rest[np.argsort(one)]
    mod1, mod2 = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    less1 = np.searchsorted(padded[mod1] * (n + 3) + rank[mod1 + 1], padded[rest] * (n + 3) + rank[rest + 1])
    pairs = np.concatenate([padded[rest] << 31 | padded[rest + 1], padded[mod2] << 31 | padded[mod2 + 1]])
    pair = np.unique(pairs, return_inverse=True)[1].astype(np.int64) * (n + 3)
    less2 = np.searchsorted(pair[len(rest) :] + rank[mod2 + 2], pair[: len(rest)] + rank[rest + 2])
    out = np.empty(n, dtype=np.int64)
    at = np.arange(len(rest)) + less1 + less2
    out[at] = rest
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = sampled
    return out


def later_windows(texts: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and offset of every window that also starts earlier in one of the runs: by rank of the
    document, then by position (``docs`` and ``starts`` say where each run lies)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    symbols = joined.astype(np.int64) + 1
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    symbols[begins + sizes] = 257  # the end of a run is no byte
    run_at = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(symbols)) - begins[run_at]
    order = suffix_array(symbols)
    order = order[offset[order] <= sizes[run_at[order]] - LENGTH]
    if not len(order):
        return order, order
    # compare adjacent prefixes
    windows = np.lib.stride_tricks.sliding_window_view(joined, LENGTH)
    same = np.zeros(len(order), dtype=bool)
    step = 1 << 16
    for lo in range(1, len(order), step):
        hi = min(len(order), lo + step)
        same[lo:hi] = (windows[order[lo:hi]] == windows[order[lo - 1 : hi - 1]]).all(axis=1)
    group = np.cumsum(~same)
    run, off = run_at[order], offset[order]
    by = np.lexsort((starts[run] + off, docs[run], group))
    is_first = np.concatenate([[True], np.diff(group[by]) != 0])
    later = by[~is_first]
    return run[later], off[later]


def _keyed(df: DataFrame) -> DataFrame:
    """Documents: repeated rows with the same id and text are one."""
    return columns(df, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"), text_of().alias("text"))


def repeated_keys(docs: DataFrame) -> DataFrame:
    """``(h)``: keys of windows that occur in more than one run, or more than once in one.

    A task sends its distinct keys, packed by partition of the count; a key twice means it occurs
    several times. A key costs at most two entries per task, however often it occurs.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-total // COUNT_BYTES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.zeros(0, dtype=np.uint64)]
            for lo, hi in spans(batch.column(0)):
                texts = batch.column(0).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                for _, _, pieces in text_steps(texts):
                    _, k, _, _, several = runs_of(pieces)
                    keys += [k, k[several]]
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            found = np.concatenate([found, found[counts > 1]])
            part = (found % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order], prepend=-1))
            blobs = [x.tobytes() for x in np.split(found[order], edges[1:])] if len(edges) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[order][edges], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "keys"]
            )

    def count(table):
        keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table["keys"].to_pylist()])
        found, counts = np.unique(keys, return_counts=True)
        return pa.table({"h": found[counts > 1].view(np.int64)})

    sent = docs.select("text").mapInArrow(emit, "part long, keys binary")
    return store(sent.groupBy("part").applyInArrow(count, "h long"), "repeated-keys")


def candidate_runs(docs: DataFrame, keys: DataFrame, whole: bool, bits: int = BITMAP_BITS) -> DataFrame:
    """Runs whose key is among ``keys``, and some whose key shares a bit of the bitmap with one: key, hash
    ``c`` of the bytes, number of windows, whether the run may repeat a window within itself (not told with
    ``whole``), and its place; with ``whole`` also the bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(keys.select("h"), bits))
    schema = "h long, c long, n long, several boolean, doc_id long, th long, s long" + ", run binary" * whole
    names = [f.name for f in schema_of(schema).fields]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for lo, hi in spans(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                for text, begin, pieces in text_steps(texts):
                    owner, k, first, sizes, several = runs_of(pieces, not whole)
                    on = np.flatnonzero(wanted.holds(k))
                    owner, k, first, sizes = owner[on], k[on], first[on], sizes[on]
                    cut = [
                        pieces[o][s : s + n]
                        for o, s, n in zip(owner.tolist(), first.tolist(), (sizes + LENGTH - 1).tolist())
                    ]
                    hashed = np.fromiter(map(xxhash.xxh64_intdigest, cut), dtype=np.uint64, count=len(cut))
                    row = pa.array(text[owner])
                    arrays = [
                        pa.array(k.view(np.int64)), pa.array(hashed.view(np.int64)), pa.array(sizes),
                        pa.array(several[on]), part.column(0).take(row), part.column(1).take(row),
                        pa.array(first + begin[owner]), *[pa.array(cut, pa.binary())] * whole,
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(search, schema)


def _key() -> Column:
    """Document as a join key that null ids can meet under."""
    return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("th").cast("string"))


def _place() -> Column:
    doc = F.coalesce("doc_id", F.lit(0)).alias("doc")
    return F.struct(F.col("doc_id").isNull().alias("none"), doc, F.col("th"), F.col("s"))


def _sort_partition(table):
    none, doc, th, s, h, c = (table[x].to_numpy() for x in ("none", "doc", "th", "s", "h", "c"))
    # the first place of each different run
    order = np.lexsort((s, th, doc, none, c, h))
    first = order[np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)])]
    none, doc, th, s, h, c = (x[first] for x in (none, doc, th, s, h, c))
    texts = table["run"].take(pa.array(first)).to_pylist()
    order = np.lexsort((th, doc, none))
    new = np.any([np.diff(x[order], prepend=x[order[:1]]) != 0 for x in (none.astype(int), doc, th)], axis=0)
    docs = np.empty(len(texts), dtype=np.int64)
    docs[order] = np.cumsum(new)
    run, off = later_windows(texts, docs, s)
    by = np.lexsort((off, run))
    run, off = run[by], off[by]
    # windows in a row become one span
    cut = np.ones(len(run), dtype=bool)
    cut[1:] = (np.diff(run) != 0) | (np.diff(off) != 1)
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(run)) - 1 if len(run) else begin
    at = run[begin]
    return pa.table({
        "doc_id": pa.array(doc[at], mask=none[at]), "th": th[at], "lo": s[at] + off[begin],
        "hi": s[at] + off[end] + LENGTH,
    })


def marks(df: DataFrame, bits: int = BITMAP_BITS, sorted_runs: int = SORTED_RUNS) -> DataFrame:
    """``(doc_id, th, lo, hi)``: byte ranges of windows that also start earlier; they may overlap."""
    docs = _keyed(df)
    found = store(candidate_runs(docs, repeated_keys(docs), False, bits), "runs")
    groups = store(
        found.groupBy("h", "c").agg(
            F.min(_place()).alias("first"), F.max("several").alias("several"), F.count("*").alias("copies")
        ),
        "distinct-runs",
    )
    # later copies of a run are covered as a whole
    copied = groups.filter("copies > 1").select("h", "c", "first")
    copies = (
        found.join(copied, ["h", "c"])
        .filter(~(F.col("first") == _place()))
        .select("doc_id", "th", F.col("s").alias("lo"), (F.col("s") + F.col("n") + LENGTH - 1).alias("hi"))
    )
    # keys of several different runs, or of one that may repeat a window, are sorted
    rims = store(
        groups.groupBy("h").agg(F.count("*").alias("k"), F.max("several").alias("any"))
        .filter("k > 1 OR any").select("h", "k", (F.col("k") > sorted_runs).alias("hot")),
        "rims",
    )
    total = rims.filter("NOT hot").agg(F.sum("k")).first()[0] or 0
    n_parts = max(1, -(-total * (LENGTH + RUN // 2) // PARTITION_BYTES))
    part = F.pmod(F.xxhash64("h"), F.lit(n_parts))
    different = _different_runs(docs, rims.select("h"), bits)
    hot = rims.filter("hot").select("h", "hot")
    if hot.isEmpty():
        return copies.unionByName(_sorted(different.withColumn("part", part)))
    # read by both sides, so stored; each hot key has thousands of runs
    split = store(different.join(hot, "h", "left"), "different-runs")
    inner = _sorted(split.filter("hot IS NULL").withColumn("part", part))
    return copies.unionByName(inner).unionByName(_hot_windows(split.filter("hot").select("run", "at.*")))


def _sorted(runs_: DataFrame) -> DataFrame:
    return runs_.select("h", "c", "run", "at.*", "part").groupBy("part").applyInArrow(
        _sort_partition, "doc_id long, th long, lo long, hi long"
    )


def _different_runs(docs: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """``(h, c, at, run)``: the different runs of ``keys``, each once, at its first place."""
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "th", "s")
    every = candidate_runs(docs, keys, True, bits).select("h", "c", "run", at.alias("at"))
    return every.groupBy("h", "c").agg(F.min("at").alias("at"), F.first("run").alias("run"))


def _hot_windows(hot: DataFrame) -> DataFrame:
    """As ``marks``, of different runs whose key has very many: windows with equal digests are summed
    up to their first place before they are shuffled."""
    schema = pa.schema([("w", pa.binary()), ("none", pa.bool_()), ("doc", pa.int64()), ("th", pa.int64()),
                        ("at", pa.int64())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(cols, schema)], schema=schema)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run, none, doc, th, s in zip(*(x.to_pylist() for x in batch.columns)):
                for lo in range(len(run) - LENGTH + 1):
                    rows.append((hashlib.md5(run[lo : lo + LENGTH]).digest(), none, doc, th, s + lo))
                if len(rows) > 50_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    exploded = hot.select("run", "none", "doc", "th", "s").mapInArrow(
        windows, "w binary, none boolean, doc long, th long, at long"
    )
    place = F.struct("none", "doc", "th", "at")
    firsts = exploded.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return (
        exploded.join(firsts.select("w", "first"), "w")
        .filter(F.col("first") != place)
        .select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "th", F.col("at").alias("lo"),
                (F.col("at") + LENGTH).alias("hi"))
    )


def merged(los: list[int], his: list[int]) -> list[tuple[int, int]]:
    """Ranges as maximal runs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(los, his)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept_parts(data: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    """What lies between the ranges."""
    kept, at = [], 0
    for lo, hi in ranges:
        kept.append(data[at:lo])
        at = hi
    return [*kept, data[at:]]


def _with_ranges(df: DataFrame) -> DataFrame:
    """``df``, and last a column of its ranges (arrays of starts and ends). Texts are shuffled once."""
    key, ranges = unused(df, "key"), unused(df, "ranges")
    per_doc = (
        marks(df).groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct("lo", "hi")).alias(ranges))
        .select(_key().alias(key), ranges)
    )
    keyed = df.withColumn(key, F.concat_ws(
        "/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string")))
    return keyed.join(per_doc, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], ranges)


def _ranges(array) -> list[tuple[int, int]]:
    got = array or []
    return merged([x["lo"] for x in got], [x["hi"] for x in got])


def dedup_digests(df: DataFrame) -> DataFrame:
    """``doc_id``, bytes, bytes removed, maximal removed runs and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                rows = []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data, cut = (text or "").encode("utf-8"), _ranges(found)
                    kept = b"".join(kept_parts(data, cut))
                    rows.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(list(c), pa.int64()) for c in cols[:3]], pa.array(list(cols[3]))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    ranged = _with_ranges(columns(df, "doc_id", "text"))
    return ranged.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(df: DataFrame) -> DataFrame:
    """``df`` with the repeated bytes taken out of its texts (and ``n_chars``, if there, set anew).

    Null and unaffected texts stay as they are. A character that loses some of its bytes goes as a
    whole. Rows that share ``doc_id`` and text are one document and all get its result; rows that share
    only the id are ordered by a hash of the text; a null id comes last. No row is dropped.
    """
    names = df.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names and dict(df.dtypes)["n_chars"] == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                counts = part.column(chars).to_pylist() if chars is not None else []
                for i, found in enumerate(part.column(len(names)).to_pylist()):
                    if found:
                        kept = kept_parts(texts[i].encode("utf-8"), _ranges(found))
                        texts[i] = "".join(x.decode("utf-8", "ignore") for x in kept)
                        if counts:
                            counts[i] = len(texts[i])
                arrays = list(part.columns[: len(names)])
                arrays[at] = pa.array(texts, pa.string())
                if chars is not None:
                    arrays[chars] = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType(df.schema.fields)
    return _with_ranges(df).mapInArrow(run, schema)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when bytes of repeated 100-byte strings are removed."""
    return dedup_digests(read(spark, sf_dir))
