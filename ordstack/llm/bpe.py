"""BPE encoding and decoding with a given tokenizer file, equal to the library's on whole texts.

Texts are cut where the tokenizer cuts anyway (ASCII white space, if it drops that), and every distinct
word is encoded once per worker while it stays in a bounded cache. Where the tokenizer folds case and
splits by a pattern, words are split by that same pattern first, since fewer parts than words are
distinct. Long text without such a cut is
encoded as a tree: pieces are encoded apart, on Spark in parallel, and neighbours are put together by
encoding a window around their join again, which grows until it agrees with both sides.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordstack.llm.corpus import WORD, columns, read, spans, text_of
from ordstack.session import store

#: Characters of one piece of unsplit text, and from how many on text without a cut is pieced.
PIECE = 1 << 14
LONG = 2 * PIECE
#: Characters of the first window on either side of a join, and tokens in a row that must agree.
WINDOW = 64
AGREE = 8
#: Words in one generation of a worker's cache; two generations are held.
CACHED = 150_000
#: Words encoded in one call.
CALL = 2_000
#: Stands between words among their ids, which are below 2^24.
NO_ID = b"\xff" * 4

#: Characters for which lower-casing and composition are the same everywhere: printable ASCII and
#: precomposed Latin letters, without the one whose lower case is two characters.
_FOLDABLE = "\x21-\x7e\xa1-\u012f\u0131-\u017f"

Token = tuple[int, int, int]  # id, start, end
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """One tokenizer file in one worker. Ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        plain = [
            (i, t.content) for i, t in added.items()
            if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)
        ]
        #: A special token between two words keeps them apart, whatever they are.
        self.mark = plain[0] if plain else None
        special = "|".join(re.escape(t.content) for t in added.values()) or "(?!)"
        #: Words, among lines of them, that hold a special token or a character that can't be folded.
        self.odd = re.compile(rf"^(?:.*(?:{special}).*|.*[^{_FOLDABLE}\n].*|.{{{PIECE + 1},}})$", re.MULTILINE)
        self.special = re.compile(special)
        self.cuts = self._cuts_at_space()
        self.pattern, self.ends = self._pattern()
        #: Ids by word and by part of a word, in two generations each.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _cuts_at_space(self) -> bool:
        """Whether words come out the same alone and in a text, white space leaving nothing."""
        words = ["The", "don't", "x,", "42", "<a", "Ünïcode", "́e", "a b", "…", "I'LL", "#!"]
        text = " \n".join(words) + "\t \r\x0b\x0c" + words[0]
        alone = [self._ids(w) for w in [*words, words[0]]]
        return self._ids(text) == [i for ids in alone for i in ids] and not self._ids(" \n\t")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def tokens(self, text: str) -> list[Token]:
        made = self.tokenizer.encode(text, add_special_tokens=False)
        return [(i, s, e) for i, (s, e) in zip(made.ids, made.offsets)]

    def words(self, text: str) -> list[bytes]:
        """Words by ASCII white space alone; any other inside a word is the tokenizer's own affair."""
        raw = text.encode("utf-8")
        return raw.split() if self.cuts else [raw]

    def _pattern(self):
        """The pattern that parts words, and line feeds, if the tokenizer composes, folds white space and
        case, keeps the pattern's matches and encodes each by itself up to a marked end; else none. Beside
        it, which ids end a match."""
        import regex

        made = json.loads(self.tokenizer.to_str())
        suffix = made["model"].get("end_of_word_suffix")
        steps = (made["normalizer"] or {}).get("normalizers") or []
        split = (made["pre_tokenizer"] or {}).get("pretokenizers") or []
        folds = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and (
            steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
        )
        parts = [x["type"] for x in split] == ["Split", "ByteLevel"] and (
            split[0]["behavior"] == "Removed" and split[0]["invert"]
            and not split[1]["use_regex"] and not split[1]["add_prefix_space"]
        )
        vocabulary = self.tokenizer.get_vocab()
        if not (folds and parts and suffix) or max(vocabulary.values()) >= 1 << 24:
            return None, None
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return regex.compile(rf"(?:{split[0]['pattern']['Regex']})|\n"), ends

    def learn(self, words: set[bytes]) -> None:
        """Encode the words that no generation holds."""
        young, old = self.young, self.old
        missing = words.difference(young)
        fresh = missing.difference(old)
        for w in missing.difference(fresh):
            young[w] = old[w]
        if not fresh:
            return
        new = list(fresh)
        if self.mark and self.cuts:  # words hold no line feed
            text = b"\n".join(new).decode("utf-8")
            texts = text.split("\n")
            odd = set(self.odd.findall(text)) if self.pattern else set(texts)
        else:
            texts = [w.decode("utf-8") for w in new]
            odd = set(texts)
        plain = []
        for w, t in [(w, t) for w, t in zip(new, texts) if t in odd]:
            if not self.mark or len(t) > PIECE or self.special.search(t):
                ids = self._ids(t) if len(t) <= LONG else [x[0] for x in tree(self, t)]
                young[w] = np.array(ids, dtype="<u4").tobytes()
            else:
                plain.append((w, t))
        if len(odd) < len(new):
            if odd:
                new, texts = zip(*[(w, t) for w, t in zip(new, texts) if t not in odd])
            self._parted(new, "\n".join(texts).lower().split("\n"))
        young.update(zip([w for w, _ in plain], self._apart([t for _, t in plain])))

    def _parted(self, words: Sequence[bytes], lows: list[str]) -> None:
        """Encode words, given with their lower case, by their parts; each distinct part once."""
        one = list(map(str.isalpha, lows))
        several = list(map(not_, one))
        whole, many = list(compress(lows, one)), list(compress(lows, several))
        # the parts of all words in one list, with a line feed after each word but the last
        flat = self.pattern.findall("\n".join(many))
        if flat.count("\n") != max(len(many) - 1, 0):
            raise ValueError("a part of a word goes beyond it")
        parts, old = self.parts, self.old_parts
        missing = set(whole).union(flat).difference(parts)
        fresh = missing.difference(old)
        for x in missing.difference(fresh):
            parts[x] = old[x]
        fresh.discard("\n")
        new = list(fresh)
        parts.update(zip(new, self._ended(new)))
        self.young.update(zip(compress(words, one), map(parts.__getitem__, whole)))
        if many:
            parts["\n"] = NO_ID  # no id has these bytes, and none before it ends with one of them
            found = b"".join(map(parts.__getitem__, flat)).split(NO_ID)
            self.young.update(zip(compress(words, several), found))
        if len(parts) > CACHED:
            self.old_parts, self.parts = parts, {}

    def _ended(self, parts: list[str]) -> list[bytes]:
        """Ids of each of many parts: every part gives ids up to one that ends it."""
        out: list[bytes] = []
        for lo in range(0, len(parts), CALL):
            call = " ".join(parts[lo : lo + CALL])
            ids = np.array(self.tokenizer.encode_batch_fast([call], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            data = ids.tobytes()
            found = [data[4 * s : 4 * e] for s, e in zip([0, *ends[:-1]], ends)]
            if len(found) != len(parts[lo : lo + CALL]):
                raise ValueError("a part of a word was split again")
            out += found
        return out

    def _apart(self, texts: list[str]) -> list[bytes]:
        """Ids of each of many short texts, many in one call with a special token between them."""
        out: list[bytes] = []
        for lo in range(0, len(texts), CALL):
            call = self.mark[1].join(texts[lo : lo + CALL])
            ids = np.array(self.tokenizer.encode_batch_fast([call], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
            out += [ids[s:e].tobytes() for s, e in zip([0, *[e + 1 for e in ends[:-1]]], ends)]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; none for null and empty ones."""
        split = [self.words(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        held = self.young
        out = [b"".join(map(held.__getitem__, words)) for words in split]
        if len(held) > CACHED:
            self.old, self.young = held, {}
        return out

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def joined(enc: Encoder, text: str, left: list[Token], right: list[Token], cut: int) -> list[Token]:
    """Tokens of ``text`` from those of its two sides of ``cut`` (positions are those in ``text``).

    The window is encoded again and must repeat ``AGREE`` tokens in a row of either side, or reach
    that side's end. Byte-pair encoding is settled by neighbouring pairs, so from such a run outward
    each side stands as it is.
    """
    reach = WINDOW
    while True:
        i = len(left)
        while i and (left[i - 1][2] > cut - reach or i < len(left) and left[i - 1][2] > left[i][1]):
            i -= 1
        j = 0
        while j < len(right) and (right[j][1] < cut + reach or right[j - 1][2] > right[j][1]):
            j += 1
        lo = left[i][1] if i and i < len(left) else 0
        hi = right[j][1] if j < len(right) else len(text)
        i = i if lo else 0
        window = [(t, s + lo, e + lo) for t, s, e in enc.tokens(text[lo:hi])]
        head = (0, 0) if not lo else _agreement(left, i, window, 0, cut, first=True)
        tail = (len(right), len(window)) if hi == len(text) else _agreement(right, 0, window, 0, cut, first=False)
        if head and tail and head[1] <= tail[1]:
            return left[: head[0]] + window[head[1] : tail[1]] + right[tail[0] :]
        reach *= 2


def _agreement(
    side: list[Token], from_: int, window: list[Token], lo: int, cut: int, first: bool
) -> tuple[int, int] | None:
    """Where ``AGREE`` tokens in a row are the same in both lists: the start of the first such run
    before the cut, or of the last one after it."""
    at: dict[Token, int] = {}
    for k in range(from_, len(side)):
        if not first and window and side[k][1] > window[-1][2]:
            break
        at.setdefault(side[k], k)
    order = range(lo, len(window) - AGREE + 1)
    for w in order if first else reversed(order):
        if (window[w + AGREE - 1][2] > cut) if first else (window[w][1] < cut):
            continue
        k = at.get(window[w])
        if k is not None and side[k : k + AGREE] == window[w : w + AGREE]:
            return k, w
    return None


def folded(enc: Encoder, text: str, pieces: list[list[Token]], size: int) -> list[Token]:
    """Pieces of ``size`` characters put together pair by pair, level by level."""
    span = size
    while len(pieces) > 1:
        up = []
        for k in range(0, len(pieces) - 1, 2):
            at = k * span
            own = text[at : at + 2 * span]
            shifted = [(t, s + span, e + span) for t, s, e in pieces[k + 1]]
            up.append(joined(enc, own, pieces[k], shifted, span))
        if len(pieces) % 2:
            up.append(pieces[-1])
        pieces, span = up, 2 * span
    return pieces[0] if pieces else []


def tree(enc: Encoder, text: str, size: int = PIECE) -> list[Token]:
    return folded(enc, text, [enc.tokens(text[lo : lo + size]) for lo in range(0, len(text), size)], size)


def _long_words(df: DataFrame, path: str) -> DataFrame:
    """``(word, ids)`` of every distinct long word of the texts: pieces encoded by as many tasks, then
    put together word by word. A word's pieces are bounded by the row that held it."""
    words = df.select(F.explode(F.regexp_extract_all(text_of(), F.lit(f"{WORD}"), F.lit(0))).alias("word"))
    words = words.filter(F.length("word") > LONG).distinct()
    pieces = words.select(
        F.sha2("word", 256).alias("key"),
        F.expr(f"posexplode(transform(sequence(0, int((length(word) - 1) / {PIECE})), "
               f"i -> substring(word, i * {PIECE} + 1, {PIECE})))").alias("piece", "text"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi in spans(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                made = [np.array(enc.tokens(t), dtype="<i8").tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=_PIECES.names)

    def fold(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        enc = encoder(path)
        made = [[tuple(t) for t in np.frombuffer(r["tokens"], dtype="<i8").reshape(-1, 3).tolist()] for r in rows]
        word = "".join(r["text"] for r in rows)
        ids = np.array([t[0] for t in folded(enc, word, made, PIECE)], dtype="<u4").tobytes()
        return pa.table({"word": [word], "ids": [ids]}, schema=pa.schema([("word", pa.string()), ("ids", pa.binary())]))

    spread = pieces.repartition("key", "piece").mapInArrow(encode, _PIECES)
    return spread.groupBy("key").applyInArrow(fold, "word string, ids binary")


_PIECES = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("piece", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("tokens", T.BinaryType()),
])


def has_long_word(text=None):
    """Whether a text holds more than LONG characters in a row without ASCII white space."""
    text = text_of() if text is None else text
    # no run can be that long in a text that is not
    return (F.length(text) > LONG) & F.coalesce(
        F.array_max(F.transform(F.split(text, "[ \\t-\\r]"), lambda w: F.length(w))) > LONG, F.lit(False)
    )


def _mapped(df: DataFrame, path: str, added: T.StructType, made, words: DataFrame | None = None) -> DataFrame:
    """``df`` with ``added`` columns in place of its text, by ``made(encoder, texts)``."""
    df = df.drop(*added.names)
    at = df.columns.index("text")
    rest = [i for i in range(len(df.columns)) if i != at]
    schema = T.StructType([*[df.schema.fields[i] for i in rest], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi in spans(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in rest], *made(enc, part.column(at).to_pylist())], names=schema.names
                )

    return df.mapInArrow(run, schema)


def _whole(df: DataFrame, path: str, added: T.StructType, made) -> DataFrame:
    """As ``_mapped``; the rows with long words get these encoded in parallel beforehand."""
    df = df.drop(*added.names)
    plain = _mapped(df.filter(~has_long_word()), path, added, made)
    longs = df.filter(has_long_word())
    words = store(_long_words(longs, path), "long-words")
    # a long text carries its own long words, found by an equal word, to where it is encoded
    keyed = longs.withColumn("__row", F.xxhash64("text"))
    needs = keyed.select("__row", "text").distinct().select(
        "__row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word")
    ).filter(F.length("word") > LONG)
    given = needs.join(words, "word").groupBy("__row").agg(F.collect_list(F.struct("word", "ids")).alias("__given"))
    fed = keyed.join(given, "__row", "left").drop("__row")
    at, known_at = fed.columns.index("text"), fed.columns.index("__given")
    rest = [i for i in range(len(fed.columns)) if i not in (at, known_at)]
    schema = T.StructType([*[fed.schema.fields[i] for i in rest], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                known = {w["word"].encode("utf-8"): w["ids"] for w in part.column(known_at)[0].as_py() or []}
                enc.young.update(known)
                arrays = made(enc, part.column(at).to_pylist())
                for w in known:
                    enc.young.pop(w, None)
                    enc.old.pop(w, None)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], *arrays], names=schema.names)

    return plain.unionByName(fed.mapInArrow(run, schema))


def encode(df: DataFrame, path: str) -> DataFrame:
    """``df`` without ``text``, with ``ids`` (little-endian unsigned 32-bit numbers, binary).

    Null and empty texts give no ids. A column ``ids`` of ``df`` is replaced; all others stay.
    """
    added = T.StructType([T.StructField("ids", T.BinaryType())])
    return _whole(df, path, added, lambda enc, texts: [pa.array(enc.encode(texts), pa.binary())])


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` with the text of its ``ids``; null ids give a null text."""
    df = df.drop("text")
    at = df.columns.index("ids")
    schema = T.StructType([*df.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi in spans(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = [None if x is None else enc.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def _digests(enc: Encoder, texts: list[str | None]) -> list[pa.Array]:
    sha, ids = hashlib.sha256, enc.encode(texts)
    decoded = [sha(enc.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
    return [
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([sha(x).hexdigest() for x in ids], pa.string()),
        pa.array(decoded, pa.string()),
    ]


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """``df`` without ``text``, with the number of its ids and the digests of the ids and of the text
    they decode to. Encoding and decoding share one task; nothing but digests leaves it."""
    added = T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ])
    return _whole(df, path, added, _digests)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's text encoded and decoded again. Rows with a null ``doc_id`` are kept."""
    return round_trip(columns(read(spark, sf_dir), "doc_id", "text"), path or vocabulary())
