"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import bucketed, byte_batches, once, written
from weirflow.llm.tokenizer import Vocabulary, default_path, encoder

#: Bounds of the broadcast head of the word table: its words, their bytes, and the documents whose words are counted to
#: choose it. Which words are in the head decides only where they are joined, not what comes out.
HEAD_WORDS, HEAD_BYTES, HEAD_DOCS = 1 << 19, 16 << 20, 1 << 14
#: Words or tokens that a task handles at once, runs that are assembled together, and groups of runs that one task
#: answers for a word.
RUN, TOGETHER, ASKING = 1 << 19, 4, 1 << 16


def to_varint(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as base-128 numbers: (bytes, byte offset after each of ``ends`` codes)."""
    n = np.ones(len(codes), np.int64)
    for bits in (7, 14, 21, 28):
        n += codes >= (1 << bits)
    stop = np.cumsum(n)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for k in range(5):
        at = np.flatnonzero(n > k)
        out[stop[at] - n[at] + k] = ((codes[at] >> (7 * k)) & 127) | np.where(n[at] > k + 1, 128, 0)
    return out, np.concatenate(([0], stop))[ends]


def from_varint(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, byte offset after each)."""
    stop = np.flatnonzero(data < 128) + 1
    start = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    n, codes = stop - start, np.zeros(len(stop), np.int64)
    for k in range(5):
        at = np.flatnonzero(n > k)
        codes[at] |= (data[start[at] + k].astype(np.int64) & 127) << (7 * k)
    return codes, stop


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length) one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def encoded(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word, more, ids: the token ids of each row's word; ``more`` is carried along."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary.text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in byte_batches(texts, RUN):
                ids = pa.array(enc.encode(texts[lo:hi]), pa.list_(pa.int32()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], names=["word", "more", "ids"])

    return words.mapInArrow(run, f"word string, more {words.schema['more'].dataType.simpleString()}, ids array<int>")


def head_of(texts: DataFrame, vocabulary: Vocabulary, limit: int) -> pa.Table:
    """The most frequent words with their ids, at most ``limit`` and HEAD_BYTES; all others are joined by a shuffle.

    They are counted over the HEAD_DOCS documents or so with the smallest hashes. A histogram over eighth powers of
    two finds the count from which on all words fit.
    """
    n = texts.count()
    share = min(1.0, HEAD_DOCS / n) if n else 1.0
    few = texts.where(F.xxhash64(F.lit("head"), "text") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    counts = few.select(F.explode(vocabulary.split(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("more"))
    words = written(encoded(counts, vocabulary), "words")
    step = F.floor(F.log2(F.col("more").cast("double")) * 8).cast("int")
    steps = words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word") + 4 * F.size("ids")).alias("b")).collect()
    least, total, size = None, 0, 0
    share = 0.0
    for r in sorted(steps, key=lambda r: -r["s"]):
        least, share = r["s"], min(1.0, (limit - total) / r["n"], (HEAD_BYTES - size) / r["b"])
        if share < 1:
            break
        total, size = total + r["n"], size + r["b"]
    # Of the last step's words, about as many as fit, by their hash.
    fit = words.where((step > least) | ((step == least) & (F.xxhash64("word") < int((share - 0.5) * 2**64 * 0.999)))) if share > 0 or total else words.limit(0)
    return fit.toArrow().sort_by([("more", "descending"), ("word", "ascending")])


class Head:
    """The broadcast words with their ids in one worker."""

    def __init__(self, data: bytes):
        t = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.words = t.column("word").combine_chunks()
        ids = t.column("ids").combine_chunks()
        self.size = len(self.words)
        self.ids = ids.flatten().to_numpy().astype(np.int32) if self.size else np.zeros(0, np.int32)
        self.offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy()))).astype(np.int64) if self.size else np.zeros(1, np.int64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """``id_col``, ids array<int>: the tokens of every whole text, special strings read as the library does.

    Spark splits the texts into words; each distinct word is encoded once. The most frequent words, a bounded
    table, are joined in the tasks that hold the texts. Neighbouring texts form a run of about RUN words, written
    once as word ranks with the list of its other distinct words; these are gathered by word, encoded and sent back to
    their run and place in its list. A word that very many runs ask for is gathered by RUN_GROUP runs at a time.
    Null texts count as empty and have no tokens; repeated rows are all returned, also with the same id; null ids
    are kept. A text is never cut, so a run longer than RUN holds one text and a task takes memory for the longest.
    An empty table gives an empty table; other columns are not read.
    """
    vocabulary = Vocabulary.load(tokenizer or default_path())
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    head = head_of(own, vocabulary, head_words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as w:
        w.write_table(head)
    context = docs.sparkSession.sparkContext
    shared, text = context.broadcast(sink.getvalue().to_pybytes()), context.broadcast(vocabulary.text)
    mark = hash(shared.value)
    kind = own.schema["id"].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of texts as ranks of head words; the other distinct words of a run are numbered on behind the head."""
        import zstandard as zstd

        h, pack, first, n = once(("head", mark), lambda: Head(shared.value)), zstd.ZstdCompressor(level=3), TaskContext.get().partitionId() << 33, 0
        for whole in batches:
            sizes = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in runs(sizes, RUN):
                batch = whole.slice(lo, hi - lo)
                values = batch.column(1).flatten()
                codes = pc.fill_null(pc.index_in(values, value_set=h.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.flatnonzero(codes < 0)
                rest = values.take(pa.array(at)).dictionary_encode()
                codes[at] = h.size + rest.indices.to_numpy(zero_copy_only=False)
                data, _ = to_varint(codes, np.zeros(1, np.int64))
                one = lambda x, of: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(of))
                columns = [pa.array([first + n // TOGETHER]), pa.array([n % TOGETHER], pa.int32()), one(batch.column(0), batch.column(0).type), one(pa.array(sizes[lo:hi]), pa.int32()), pa.array([pack.compress(data.tobytes())], pa.binary()), one(rest.dictionary, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "run", "rows", "sizes", "seq", "missing"])
                n += 1
            pa.default_memory_pool().release_unused()

    ranked = own.select("id", vocabulary.split(F.col("text")).alias("words")).mapInArrow(rank, f"part bigint, run int, rows array<{kind}>, sizes array<int>, seq binary, missing array<string>")
    ranked = bucketed(ranked, "part")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by word: each distinct word is encoded once, for all that ask for it."""
        enc, last = encoder(text.value), (None, b"")
        for batch in batches:
            words = batch.column(0).dictionary_encode()
            names = words.dictionary.to_pylist()
            codes: list[bytes] = [last[1]] if names and names[0] == last[0] else []
            for lo, hi in byte_batches(names[len(codes) :], RUN):
                ids = enc.encode(names[len(codes) : len(codes) + hi - lo])
                ends = np.cumsum([len(x) for x in ids])
                data, bounds = to_varint(np.fromiter(chain.from_iterable(ids), np.int64, int(ends[-1])), np.concatenate(([0], ends)))
                codes += [data[a:b].tobytes() for a, b in pairwise(bounds.tolist())]
            last = (names[-1], codes[-1]) if names else last
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.binary()).take(words.indices)], names=["part", "run", "pos", "ids"])

    # The rest of the distinct-word table: a row a word and run that asks for it.
    asked = ranked.select(F.posexplode("missing").alias("pos", "word"), "part", "run").select("word", "part", "run", "pos")
    share = 1 + ranked.count() // ASKING
    asked = asked.repartition(*(["word"] if share == 1 else ["word", F.pmod(F.xxhash64("part"), F.lit(share))])).sortWithinPartitions("word")
    answers = asked.mapInArrow(answer, "part bigint, run int, pos int, ids binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ids of the texts of some runs, from their ranks, the head and the answers."""
        import zstandard as zstd

        h = once(("head", mark), lambda: Head(shared.value))
        right = right.sort_by([("run", "ascending"), ("pos", "ascending")]).combine_chunks()
        bounds = np.searchsorted(right.column("run").to_numpy(), np.arange(TOGETHER + 1))
        out = []
        for k, run in enumerate(left.column("run").to_pylist()):
            codes, _ = from_varint(np.frombuffer(zstd.decompress(left.column("seq")[k].as_py()), np.uint8))
            got = right.column("ids").slice(bounds[run], bounds[run + 1] - bounds[run])
            rest_ids, stop = from_varint(np.frombuffer(b"".join(got.to_pylist()), np.uint8))
            ends = np.searchsorted(stop, np.cumsum(pc.binary_length(got).to_numpy().astype(np.int64)), side="right")
            rest_len = np.diff(np.concatenate(([0], ends)))
            ids = np.concatenate((h.ids, rest_ids.astype(np.int32)))
            starts = np.concatenate((h.offsets[:-1], len(h.ids) + ends - rest_len))[codes]
            n = np.concatenate((np.diff(h.offsets), rest_len))[codes]
            words_to = np.concatenate(([0], np.cumsum(left.column("sizes")[k].values.to_numpy())))
            total = np.concatenate(([0], np.cumsum(n)))[words_to]
            texts = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids[spread(starts, n)]))
            out.append(pa.Table.from_arrays([left.column("rows")[k].values, texts], names=["id", "ids"]))
        return pa.concat_tables(out)

    left = ranked.select("part", "run", "rows", "sizes", "seq")
    both = left.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda a, b: assemble(a, b), f"id {kind}, ids array<int>")
    return both.select(F.col("id").alias(id_col), "ids")


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows with about ``limit`` in sum, one row at least."""
    start = total = 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def decode(tokens: DataFrame, ids_col: str = "ids", tokenizer: str | None = None, text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the pieces of the ids joined up, special tokens included, bytes that are no UTF-8 replaced.

    The id-to-piece table has one row an id of the vocabulary, which bounds it; its key is dense, so the join
    takes the pieces by position. Null ids count as an empty list. All columns are kept; one named ``text_col``
    is replaced.
    """
    pieces = Vocabulary.load(tokenizer or default_path()).pieces()
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = once(("pieces", len(shared.value), hash(tuple(shared.value[:1000]))), lambda: pa.array(shared.value, pa.binary()))
        for whole in batches:
            size = pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in runs(size, RUN):
                batch = whole.slice(lo, hi - lo)
                ends = np.concatenate(([0], np.cumsum(size[lo:hi])))
                joined = table.take(batch.column(1).flatten())
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), joined), b"").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.decode("utf-8", "replace") for t in text], pa.string())], names=["row", "ids", "text"])
            pa.default_memory_pool().release_unused()

    keep = [c for c in tokens.columns if c not in (ids_col, text_col)]
    own = tokens.select(F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]).alias("row"), F.col(ids_col).alias("ids"))
    kind = own.schema["row"].dataType.simpleString()
    out = own.mapInArrow(join, f"row {kind}, ids array<int>, text string")
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(keep)], F.col("ids").alias(ids_col), F.col("text").alias(text_col))
