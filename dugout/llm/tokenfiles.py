"""Token ids of whole texts in compressed, checksummed files, written and read back."""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dugout.llm import coder
from dugout.llm.common import col
from dugout.sources.scratch import materialize

#: Id behind each document.
END = 1
#: A segment, one record of a file, is closed when it has so many ids; it holds whole documents.
SEGMENT = coder.BLOCK * coder.SIDE_BY_SIDE
#: Parts of chunks a worker keeps before its table starts anew; bytes of text handled at once; bytes of ids in a batch.
PARTS_KEPT, TEXT_BYTES, OUT_BYTES = 500_000, 1 << 23, 1 << 23
#: Signs behind a letter or digit (of ASCII or Latin-1), up to the end of a chunk, are always a piece of their own.
_SIGNS = "".join(c for c in string.punctuation if c != "'")
_LETTER_LAST = "[a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"
_LATIN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_WORDS = f"^[a-z{_LATIN}]+$"
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer lower-cases and never makes a piece across white space, so the ids of a text are those of its chunks
    between ASCII white space, each cut in two where signs follow its last letter or digit; each distinct part goes
    through the library once. Texts that may hold a special token's name go through it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: For parts of small letters only, which are one piece each and need no normalizing.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        #: Ids of pieces that end a word: the model marks these, and no others.
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(1 + max(names.values()), bool)
        self.last[[i for name, i in names.items() if name.endswith(self.model.model.end_of_word_suffix)]] = True
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the vocabulary writes those bytes of small letters that it does not write as the Latin-1 sign of that byte.
        pairs = {p for c in _LATIN for p in zip(c.encode().decode("latin-1"), signs.pre_tokenize_str(c)[0][0], strict=True)}
        self.written = [(byte, sign) for byte, sign in pairs if byte != sign]
        #: Ids of the parts met, a bounded table.
        self.known: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words of small letters, from the library's model itself: its pipeline costs twice as much as the model."""
        written = "\n".join(words).encode().decode("latin-1")
        for byte, sign in self.written:
            written = written.replace(byte, sign)
        ids = np.array(self.model.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last.take(ids)) + 1)).tolist()
        if len(ends) != len(words):
            raise ValueError("the model's words do not end where the texts' do")
        flat = ids.tobytes()
        return [flat[first:last] for first, last in zip([0, *ends], ends)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (size == 0 or size < TEXT_BYTES):
                size += len(texts[stop] or "")
                stop += 1
            out += self._few(texts[start:stop])
            start = stop
        return out

    def _ids(self, dictionary: pa.LargeStringArray) -> list[bytes]:
        """Ids of these distinct parts."""
        if len(self.known) > PARTS_KEPT:
            self.known.clear()
        parts = dictionary.to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.known.get, parts))
        new = [i for i, ids in enumerate(out) if ids is None]
        plain = pc.match_substring_regex(dictionary.take(pa.array(new, pa.int64())), _WORDS).to_numpy(zero_copy_only=False)
        at = np.array(new, np.int64)
        for places, ids_of in ((at[plain].tolist(), self.words), (at[~plain].tolist(), self.library)):
            found = [parts[i] for i in places]
            for i, part, ids in zip(places, found, ids_of(found)):
                out[i] = self.known[part] = ids
        return out

    def _few(self, texts: list[str | None]) -> list[bytes]:
        """Parts become numbers in Arrow; Python sees each distinct one once, and numpy gathers the ids."""
        whole = {i for i, t in enumerate(texts) if t and "<|" in t}
        plain = pa.array([None if i in whole else t for i, t in enumerate(texts)], pa.large_string()).fill_null("")
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        numbered = chunks.flatten().dictionary_encode()
        parts = halves(numbered.dictionary).dictionary_encode()
        pieces = self._ids(parts.dictionary)
        # 32 bits do: a batch's texts, and so its ids, number fewer than 2 ** 31 bytes
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces)) >> 2
        pool, starts = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        at = parts.indices.to_numpy().reshape(-1, 2).take(numbered.indices.to_numpy(), axis=0).ravel()
        each = sizes.take(at)
        ends = np.zeros(len(at) + 1, np.int32)
        np.cumsum(each, out=ends[1:])
        places = np.repeat(starts.take(at) - ends[:-1], each)
        places += np.arange(ends[-1], dtype=np.int32)
        ids = pool.take(places)
        border = ends[2 * chunks.offsets.to_numpy()]
        return [
            self.library([t])[0] if i in whole else ids[first:last].tobytes()
            for i, (t, first, last) in enumerate(zip(texts, border.tolist(), border[1:].tolist()))
        ]


def halves(chunks: pa.LargeStringArray) -> pa.LargeStringArray:
    """Two strings for each chunk, by a second set of offsets over the same bytes: the chunk up to its last letter or
    digit and the signs behind that; the whole chunk and an empty string where something else stands last."""
    stems = pc.ascii_rtrim(chunks, characters=_SIGNS)
    cut = pc.if_else(pc.match_substring_regex(stems, _LETTER_LAST), pc.binary_length(stems), pc.binary_length(chunks))
    first = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    offsets = np.empty(2 * len(chunks) + 1, np.int64)
    offsets[::2], offsets[1::2] = first, first[:-1] + cut.to_numpy()
    return pa.LargeStringArray.from_buffers(2 * len(chunks), pa.py_buffer(offsets), chunks.buffers()[2])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, target: str, tokenizer: str, *, text: str = "text", key: str = "doc_id") -> None:
    """Token ids of every text in ascending key order, one file per partition, END behind each document.

    The rows are range-partitioned by key and a hash of the text and sorted, so a key with many rows is cut as well.
    A record of a file is a segment: part and segment number, number of ids, the keys of its documents, how many ids
    each has, the shares of ids in the segment, and the ids as blocks of the range coder that start from these. Spark's writer commits files, so tasks may be run again.
    """
    kind = dict(docs.select(col(key).alias("key")).dtypes)["key"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        keys, lengths, held, size = [], [], [], 0
        tokens = encoder(tokenizer)
        end, key_type = np.array([END], dtype="<u4").tobytes(), None

        def closed() -> pa.RecordBatch:
            every = np.frombuffer(b"".join(held), dtype="<u4")
            shares = coder.Order0.of(every)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()),
                "segment": pa.array([segment], pa.int32()),
                "ids": pa.array([size], pa.int64()),
                "keys": pa.array([keys], pa.list_(key_type)),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "order0": pa.array([shares.pack()], pa.binary()),
                "payload": pa.array([coder.encode(every, shares)], pa.binary()),
            })

        for batch in batches:
            names, key_type = batch.column("key"), batch.schema.field("key").type
            at = 0
            texts = batch.column("text").to_pylist()
            while at < len(texts):
                stop, weight = at, 0
                while stop < len(texts) and (weight == 0 or weight < TEXT_BYTES):
                    weight += len(texts[stop] or "")
                    stop += 1
                for name, ids in zip(names[at:stop].to_pylist(), tokens.encode(texts[at:stop])):
                    keys.append(name)
                    held += [ids, end]
                    lengths.append(len(ids) // 4 + 1)
                    size += lengths[-1]
                    if size >= SEGMENT:
                        yield closed()
                        segment, size = segment + 1, 0
                        keys, lengths, held = [], [], []
                at = stop
        if keys:
            yield closed()

    ordered = (
        docs.select(col(key).alias("key"), col(text).alias("text"))
        .withColumn("more", F.xxhash64("text"))
        .repartitionByRange(F.col("key").asc_nulls_first(), "more")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "more")
        .select("key", "text")
    )
    ordered.mapInArrow(
        encode, f"part int, segment int, ids long, keys array<{kind}>, lengths array<long>, order0 binary, payload binary"
    ).write.option("compression", "none").parquet(target)


def read(spark: SparkSession, source: str) -> DataFrame:
    """(key, start, ids) of each document of the files: ids before it, and its own as little-endian 32-bit bytes.

    Blocks are checked as they are decoded. Starts are sums over the segments' id counts, written as a table of one row
    per segment, which Spark sends to all tasks if its size allows and otherwise joins by a shuffle.
    """
    files = spark.read.parquet(source)
    kind = dict(files.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    sizes = files.select("part", "segment", "ids")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    before = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inner", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(before, "part").select(
        "part", "segment", (F.col("before") + F.col("inner")).alias("start")
    )
    placed = files.join(materialize(starts, "starts"), ["part", "segment"]).select("start", "keys", "lengths", "order0", "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                shares = coder.Order0.unpack(one.column("order0")[0].as_py())
                ids = coder.decode(one.column("payload")[0].as_py(), shares)
                lengths = np.array(one.column("lengths")[0].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a segment's blocks and documents differ in length")
                names, first = one.column("keys")[0].values, 0
                while first < len(ends):
                    begin = ends[first] - lengths[first]
                    last = max(first + 1, int(np.searchsorted(ends, begin + OUT_BYTES // 4, side="right")))
                    yield pa.RecordBatch.from_pydict({
                        "key": names[first:last],
                        "start": pa.array(one.column("start")[0].as_py() + ends[first:last] - lengths[first:last]),
                        "ids": pa.array([ids[e - n : e].tobytes() for e, n in zip(ends[first:last], lengths[first:last])], pa.binary()),
                    })
                    first = last

    return placed.mapInArrow(decode, f"key {kind}, start long, ids binary")
