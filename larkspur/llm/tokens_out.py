"""Token-ID output: documents as ids of a public tokenizer, range-coded in checksummed blocks.

Documents are sorted by id into shards. A task encodes its shard into segments: rows of a Parquet table whose ``payload`` is a
self-contained segment (``tokencoder``) of whole documents. The table's commit protocol survives lost tasks, and any store that
Spark reaches can hold it.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import give_back, start_afresh
from larkspur.llm.tokencoder import decode_segments, encode_segments

END_ID = 2
#: Texts are tokenized together up to this many bytes, or one longer text.
RUN_BYTES = 1 << 22
#: Distinct chunks whose ids a worker keeps from text to text.
KEPT_CHUNKS = 1 << 19
#: Segments are coded together up to this many ids, or one longer segment.
CODED_IDS = 1 << 23
#: Two blanks of any kind in a row, or the mark used for cutting (RE2 syntax).
_DOUBLE_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}|\x00"
_MARK_AFTER_WORD = r"([A-Za-z0-9À-ÖØ-öø-ÿ])([.,])"


class ChunkEncoder:
    """Exact ids of a byte-level BPE tokenizer. Each distinct text chunk of a batch is tokenized once, and not again while it is kept.

    A text is cut only where the tokenizer's own pre-split always cuts: before a lone blank, around a lone line end, and before a
    full stop or comma after a letter or digit. Texts with blanks in a row, or with a special token's string, are encoded whole.
    Distinct chunks that start with a blank are tokenized in a row: the ids that start with a blank show where each begins.
    """

    def __init__(self, definition: str, in_a_row: int = 256):
        from tokenizers import Tokenizer

        self.tokenizer, self.in_a_row = Tokenizer.from_str(definition), in_a_row
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.starts_blank = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.starts_blank[i] = token.startswith("Ġ")
        self.kept, self.kept_ids = pa.array([], pa.large_string()), (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuttable(self, texts: pa.Array) -> np.ndarray:
        whole = pc.match_substring_regex(texts, _DOUBLE_BLANK)
        for mark in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        return ~whole.to_numpy(zero_copy_only=False)

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks: ids one after the other, and where each chunk's begin and how many they are."""
        # The kept are looked up among the chunks, as the table that is built is then the smaller one.
        found = pc.index_in(self.kept, value_set=chunks)
        met = found.is_valid().to_numpy(zero_copy_only=False)
        at = np.full(len(chunks), -1, np.int64)
        at[found.drop_null().to_numpy()] = np.flatnonzero(met)
        missed = at < 0
        new, known = chunks.filter(pa.array(missed)), len(self.kept)
        at[missed] = known + np.arange(len(new))
        ids, first, size = self._new_chunk_ids(new)
        pool = tuple(np.concatenate(x) for x in zip(self.kept_ids, (ids, first + np.int32(len(self.kept_ids[0])), size)))
        if known + len(new) <= KEPT_CHUNKS:
            self.kept, self.kept_ids = pa.concat_arrays([self.kept, new]), pool
        elif 2 * len(new) > len(chunks) and len(new) <= KEPT_CHUNKS:  # other texts than those kept from
            self.kept, self.kept_ids = new, (ids, first, size)
        return pool[0], pool[1][at], pool[2][at]

    def _new_chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spaced = pc.and_(pc.starts_with(chunks, " "), pc.greater(pc.binary_length(chunks), 1)).to_numpy(zero_copy_only=False)
        first, size = np.zeros(len(chunks), np.int32), np.zeros(len(chunks), np.int32)
        row = chunks.filter(pa.array(spaced))
        pool = [np.zeros(0, np.int32)]
        if len(row):
            offsets = np.frombuffer(row.buffers()[1], np.int64, len(row) + 1, row.offset * 8)
            data, cuts = row.buffers()[2], [*range(0, len(row), self.in_a_row), len(row)]
            pool += self.whole([data[offsets[a] : offsets[b]].to_pybytes().decode() for a, b in zip(cuts, cuts[1:])])
        flat = np.concatenate(pool)
        begins = np.flatnonzero(self.starts_blank[flat])
        if len(begins) != len(row):
            raise ValueError("the tokenizer does not keep a lone blank at the start of its chunk")
        first[spaced], size[spaced] = begins, np.diff(begins, append=len(flat))
        others = self.whole(chunks.filter(pa.array(~spaced)).to_pylist())
        size[~spaced] = [len(x) for x in others]
        first[~spaced] = len(flat) + np.cumsum(size[~spaced]) - size[~spaced]
        return np.concatenate([flat, *others]), first, size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. What is held at once grows with the texts given, so callers pass bounded batches."""
        every = pa.array(texts, pa.large_string())
        cut = self._cuttable(every)
        out: list[np.ndarray] = [None] * len(texts)
        at_whole = np.flatnonzero(~cut)
        for i, ids in zip(at_whole, self.whole([texts[i] for i in at_whole])):
            out[i] = ids
        if not cut.any():
            return out
        marked = pc.replace_substring_regex(every.filter(pa.array(cut)), _MARK_AFTER_WORD, "\\1\x00\\2")
        marked = pc.replace_substring(pc.replace_substring(marked, "\n", "\x00\n\x00"), " ", "\x00 ")
        split = pc.split_pattern(marked, "\x00")
        coded, bounds = pc.dictionary_encode(split.flatten()), split.offsets.to_numpy()[1:]
        del every, marked, split
        pool, first, size = self._chunk_ids(coded.dictionary)
        at = coded.indices.to_numpy()
        sizes = size[at]
        ends = np.cumsum(sizes)
        shift = (first[at] - (ends - sizes)).astype(np.int32)
        flat = pool[np.repeat(shift, sizes) + np.arange(int(ends[-1]), dtype=np.int32)]
        bounds = np.concatenate([[0], ends])[bounds]
        for i, ids in zip(np.flatnonzero(cut), np.split(flat, bounds[:-1])):
            out[i] = ids
        return out


def _shared_encoder(definition: str) -> ChunkEncoder:
    """The worker process keeps its encoder from task to task."""
    shelf = sys.modules.setdefault("_larkspur_worker", types.ModuleType("_larkspur_worker"))
    key = zlib.crc32(definition.encode())
    if key not in shelf.__dict__.setdefault("encoders", {}):
        shelf.encoders[key] = ChunkEncoder(definition)
    return shelf.encoders[key]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = 1 << 22, block: int = 4096, sparing: bool = False) -> None:
    """Writes ``docs`` (``doc_id``, ``text``) as token segments under ``path``, in ascending ``doc_id``.

    ``tokenizer`` is the path of a tokenizer definition that the driver can read; it travels with the job. Null texts are empty ones;
    every document ends with ``end_id``. Null ids come first; rows of equal id are ordered by text. A segment holds
    whole documents, about ``segment_ids`` ids or one longer document. ``sparing`` workers give memory back before and after coding, for
    executors that earlier stages have filled; the files are the same.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _shared_encoder(definition.value), TaskContext.get().partitionId()
        held, ids_held, segment, closed = [], 0, 0, []

        def coded() -> Iterator[pa.RecordBatch]:
            nonlocal segment
            if sparing:
                give_back()
            payloads = encode_segments([ids for _, _, ids in closed], block)
            for (doc_ids, sizes, ids), payload in zip(closed, payloads):
                columns = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([payload], pa.binary())], ["shard", "segment", "n_ids", "doc_ids", "sizes", "payload"])
                segment += 1
            closed.clear()
            if sparing:
                del payloads
                give_back()

        def close() -> Iterator[pa.RecordBatch]:
            """Ends the held documents' segment. It waits for others, unless they are too many together."""
            nonlocal held, ids_held
            if closed and sum(len(ids) for _, _, ids in closed) + ids_held > CODED_IDS:
                yield from coded()
            closed.append(([d for d, _ in held], [len(x) for _, x in held], np.concatenate([x for _, x in held])))
            held, ids_held = [], 0

        for batch in batches:
            texts, doc_ids = batch.column("text").fill_null(""), batch.column("doc_id").to_pylist()
            text_bytes = pc.binary_length(texts).to_numpy()
            runs = np.searchsorted(np.cumsum(text_bytes), np.arange(1, int(text_bytes.sum()) // RUN_BYTES + 1) * RUN_BYTES)
            cuts = np.unique([0, *(runs + 1), batch.num_rows]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                for doc_id, ids in zip(doc_ids[a:b], encoder.encode(texts.slice(a, b - a).to_pylist())):
                    if held and ids_held + len(ids) + 1 > segment_ids:
                        yield from close()
                    held.append((doc_id, np.append(ids, np.int32(end_id))))
                    ids_held += len(ids) + 1
        if held:
            yield from close()
        yield from coded()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard int, segment int, n_ids long, doc_ids array<long>, sizes array<long>, payload binary"
    ordered.mapInArrow(encoded, schema).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str, sparing: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before it. Block checksums are verified. Segment totals are added up per shard, then
    over the shards, of which there are as many as write tasks. ``sparing`` workers drop the writers' tokenizers and give memory back.
    """
    segments = spark.read.parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "segment", "inside", "doc_id", "n_tokens", "ids_crc32"]
        if sparing:
            start_afresh()
        for batch in batches:
            # Runs of segments that are decoded together.
            run = np.cumsum(batch.column("n_ids").to_numpy()) // CODED_IDS
            cuts = np.flatnonzero(np.diff(run, prepend=-1, append=-1)).tolist()
            each = ((i, ids) for a, b in zip(cuts, cuts[1:]) for i, ids in zip(range(a, b), decode_segments(batch.column("payload").slice(a, b - a).to_pylist())))
            for i, ids in each:
                ids = ids.astype("<u4")
                doc_ids, sizes = batch.column("doc_ids")[i].as_py(), np.array(batch.column("sizes")[i].as_py(), np.int64)
                starts, raw = np.cumsum(sizes) - sizes, memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist())]
                own = [np.full(len(sizes), batch.column(c)[i].as_py(), np.int32) for c in ("shard", "segment")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(starts), pa.array(doc_ids, pa.int64()), pa.array(sizes), pa.array(sums, pa.int64())], names)
            if sparing:
                give_back()

    read = segments.select("shard", "segment", "n_ids", "doc_ids", "sizes", "payload").mapInArrow(decoded, "shard int, segment int, inside long, doc_id long, n_tokens long, ids_crc32 long")
    totals = segments.select("shard", "segment", "n_ids")
    shards = totals.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    offsets = totals.select("shard", "segment", before.alias("before")).join(shards, "shard").select("shard", "segment", (F.col("before") + F.col("shard_start")).alias("offset"))
    return read.join(offsets, ["shard", "segment"]).select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
