"""Document fingerprints by order MinHash.

A text's k-mers of words are numbered by occurrence. Each component of the fingerprint selects the
minimal few of them under its own order, puts them back into text order and hashes the tuple, so a
component agrees only where both the content and its order do, as the edit distance asks for.

The orders are rotations of one hash: component j ranks k-mers by how far their hash lies clockwise
of the j-th of evenly spaced points. One sort of a text's hashes serves all components. DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordstack.llm.corpus import WORD, bound, columns, read, text_of

K = 5
#: Components, a power of two, and k-mers each selects.
COMPONENTS = 64
SELECTED = 2
#: Bits a position takes beside the leading bits of a hash, when hashes are sorted with positions.
POSITION_BITS = 30
#: Rows that share a bucket of the order by ``doc_id``. The driver holds one id per bucket.
ROWS_PER_BUCKET = 2_000


def kmers(text: Column, k: int = K) -> Column:
    """Hashes of all k-mers of a text's words, in order; of all words where they are fewer; else none."""

    def hashed(words: Column) -> Column:
        whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        every = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + d) for d in range(1, k)]))
        return F.when(F.size(words) < k, whole).otherwise(F.slice(every, 1, F.size(words) - (k - 1)))

    return bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), hashed)


def numbered(hashes: Column) -> Column:
    """Occurrence-numbered hashes, in text order: the first occurrence keeps its hash, later ones get
    one of hash and number. Only texts with a repeated k-mer are sorted for it."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda t: ~(F.get(s, t)["h"] == F.get(s, t - 1)["h"]).eqNullSafe(True),
        )

        def spread(f: Column) -> Column:
            parts = F.transform(f, lambda a, r: F.transform(
                F.sequence(a, F.coalesce(F.get(f, r + 1), F.size(s)) - 1),
                lambda t: F.struct(
                    F.get(s, t)["i"].alias("i"),
                    F.when(t == a, F.get(s, t)["h"]).otherwise(F.xxhash64(F.get(s, t)["h"], t - a)).alias("h"),
                ),
            ))
            return F.transform(F.array_sort(F.flatten(parts)), lambda x: x["h"])

        return bound(starts, spread)

    def occurrences(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(bound(ordered, runs))

    return bound(hashes, occurrences)


def signature(text: Column) -> Column:
    """Components of a text's fingerprint, as numbers below 65,536. A text without words has one too."""
    low = (1 << POSITION_BITS) - 1
    arc_bits = COMPONENTS.bit_length() - 1

    def arc(x: Column) -> Column:  # in the signed order
        return F.shiftright(x, 64 - arc_bits)

    def components(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))

        def pick(s: Column) -> Column:
            n = F.size(s)
            changes = F.filter(
                F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda t: arc(F.get(s, t)) != arc(F.get(s, t - 1))
            )

            def each(f: Column) -> Column:
                # where the arc of each component begins: a stretch of empty arcs begins at the next
                # hash, and beyond the last hash comes the first
                arcs = F.transform(f, lambda t: (arc(F.get(s, t)) + COMPONENTS // 2).cast("int"))
                begins = bound(arcs, lambda a: F.flatten(F.concat(
                    F.transform(f, lambda t, r: F.array_repeat(t, F.get(a, r) - F.coalesce(F.get(a, r - 1), F.lit(-1)))),
                    F.array(F.array_repeat(F.lit(0), COMPONENTS - 1 - F.element_at(a, -1))),
                )))

                def one(begin: Column) -> Column:
                    places = [
                        F.get(s, (begin + d) % n).bitwiseAND(F.lit(low)).cast("int") for d in range(SELECTED)
                    ]
                    # back into text order; a text of fewer k-mers than that repeats them
                    return F.xxhash64(F.transform(F.array_sort(F.array(*places)), lambda p: F.get(h, p)))

                return F.transform(begins, one)

            return bound(F.concat(F.array(F.lit(0)), changes), each)

        empty = F.transform(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)), lambda j: F.xxhash64(j))
        return F.when(F.size(h) == 0, empty).otherwise(bound(packed, pick))

    made = bound(numbered(kmers(text)), components)
    return F.transform(made, lambda x: x.bitwiseAND(F.lit(65535)).cast("int"))


def printed(components: Column) -> Column:
    """Lowercase hex, four digits a component."""
    return F.array_join(F.transform(components, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(COMPONENTS))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Last of the rising bounds that is not above the id, by binary search in a literal array."""
    table = F.lit(bounds)
    steps = [1 << i for i in reversed(range(max(len(bounds) - 1, 1).bit_length()))]
    at = F.lit(0)
    return F.aggregate(
        F.lit(steps).cast("array<int>"),
        at,
        lambda lo, step: F.when(F.coalesce(F.get(table, lo + step) <= doc_id, F.lit(False)), lo + step).otherwise(lo),
    )


def with_next(df: DataFrame, key: str, following: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with ``next_<column>`` of the next row by ascending ``key``; after the last comes the first.

    Rows are dealt once, by buckets of the order. Each bucket also gets the rows that open the next
    one, which only serve as followers. Null keys come last; ties follow a hash of the row's columns.
    A single row follows itself.
    """
    got = df.agg(
        F.count("*").alias("n"), F.count(key).alias("known"), F.min(key).alias("low")
    ).first()
    n_buckets = max(1, -(-got["known"] // rows_per_bucket))
    bounds: list[int] = []
    if got["known"]:
        shares = [i / n_buckets for i in range(n_buckets)]
        cuts = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * n_buckets))).first()[0]
        bounds = sorted({got["low"], *cuts})
    nulls = len(bounds) if got["n"] > got["known"] else None
    last = len(bounds) - 1 if nulls is None else nulls
    k = F.col(key)
    own = _bucket(k, bounds) if bounds else F.lit(0)
    own = own if nulls is None else F.when(k.isNull(), nulls).otherwise(own)
    opens = (F.get(F.lit(bounds), F.col("_own")) == k) if bounds else F.lit(False)
    opens = opens if nulls is None else opens | k.isNull()
    before = F.when(F.col("_own") == 0, last).otherwise(F.col("_own") - 1)
    dealt = df.withColumn("_own", own).withColumn(
        "_to",
        F.explode(F.array_compact(F.array(
            F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("guard")),
            F.when(opens, F.struct(before.alias("bucket"), F.lit(True).alias("guard"))),
        ))),
    )
    order = Window.partitionBy("_to.bucket").orderBy("_to.guard", k.asc_nulls_last(), F.xxhash64(*following))
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in following})
    return out.filter("NOT _to.guard").drop("_to", "_own")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends with the beginning of the next document's. Null texts count as empty; ties of
    ``doc_id`` follow a hash of the text and a null ``doc_id`` comes last. Texts are shuffled once.
    """
    docs = columns(read(spark, sf_dir), "doc_id", "text").select("doc_id", text_of().alias("text"))
    own = docs.withColumn("sig", signature(F.col("text")))
    paired = with_next(own, "doc_id", ["text", "sig"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    made = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited")
    ).withColumn("edited_sig", signature(F.col("edited")))
    return made.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sig")).alias("fingerprint"),
        printed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
