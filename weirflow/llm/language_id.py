"""Language identification by compression against per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weirflow.llm.common import once

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: The production margin: ties and near ties are rejected.
MIN_MARGIN = 0.001
#: Letters of a text's first block.
HEAD = 1 << 10


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose crc32(id as text) mod 5 is 0; their labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letters(text: str) -> str:
    """Lower-cased words between single spaces, digits and marks left out; empty if the text has no letter.

    Numbers that ``\\w`` takes for letters (fractions, superscripts, Roman numerals) go as well: str.isalpha decides.
    """
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not words.isascii() and not words.replace(" ", "").isalpha():
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words


@dataclass(frozen=True)
class Profiles:
    """Per language, the most labelled one first: its name, raw dictionary content and carriers.

    At most ``languages * (dict_bytes + carriers * carrier_bytes)`` bytes in all.
    """

    content: tuple[tuple[str, bytes, tuple[bytes, ...]], ...]
    level: int
    block_chars: int


def train_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 400, dict_bytes: int = 1 << 17, piece_chars: int = 2000, carriers: int = 4, carrier_bytes: int = 600, max_languages: int = 400, level: int = 6, block_chars: int = 1 << 14) -> Profiles:
    """Fit the dictionaries on a bounded sample of labelled rows outside the held-out fold.

    Bound: the ``sample_docs`` labelled documents of each language with the smallest hash of id and text, of each
    a run of at most ``piece_chars`` characters from a place that the hash picks, cut to ``dict_bytes`` bytes of
    letters a language. The carriers
    are ``carriers`` further runs of ``carrier_bytes`` of the same letters, kept out of the dictionary. Rows with null text, null language or no letter are not learned from. More than
    ``max_languages`` distinct labels are an error.
    """
    have = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    own = have.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)).alias("h"))
    # How many rows a language has sets the hash bound that leaves a few times sample_docs of them, spread evenly.
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    bound = F.lit(False)
    for r in rows:
        share = min(1.0, 3.0 * sample_docs / r["n"])
        bound = bound | ((F.col("lang") == r["lang"]) & (F.col("h") <= int(-(2**63) + share * (2**64 - 1) if share < 1 else 2**63 - 1)))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - piece_chars)).cast("int")
    piece = F.substring(F.col("text"), start + 1, F.lit(piece_chars))
    few = own.where(bound).select("lang", "h", piece.alias("piece"))
    ranked = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "piece"))).where(F.col("r") <= sample_docs)
    taken: dict[str, list[str]] = {}
    for r in ranked.select("lang", "r", "piece").orderBy("lang", "r").toLocalIterator():
        if t := letters(r["piece"]):
            taken.setdefault(r["lang"], []).append(t)
    content = []
    often = {r["lang"]: r["n"] for r in rows}
    for lang in sorted(taken, key=lambda x: (-often[x], x)):
        room = max((dict_bytes + carriers * carrier_bytes) // len(taken[lang]), 64)
        every = " ".join(t.encode()[:room].decode("utf-8", "ignore") for t in taken[lang]).encode()
        one = min(carrier_bytes, len(every) // (2 * carriers))
        own = tuple(every[k * one : (k + 1) * one] for k in range(carriers))
        content.append((lang, every[carriers * one :][-dict_bytes:], own))
    return Profiles(tuple(content), level, block_chars)


class Classifier:
    """Compressors of one worker, one a language."""

    def __init__(self, profiles: Profiles):
        import zstandard as zstd

        self.block = profiles.block_chars
        self.langs = [lang for lang, _, _ in profiles.content]
        self.compressors = []
        for _, content, carriers in profiles.content:
            params = zstd.ZstdCompressionParameters.from_level(profiles.level, window_log=19, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            c = zstd.ZstdCompressor(dict_data=d, compression_params=params)
            self.compressors.append((c, [(x, len(c.compress(x + b" "))) for x in carriers]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the share of bytes by which the best dictionary beats the second.

        Every block of the text counts. The first HEAD letters are a block, which is also compressed behind each of the
        language's carriers, whose own size is taken off again: so even a few words are coded with the language's letter
        statistics, where alone they would be stored raw at the same size for all. Equal sizes go to the language with
        more labelled documents, with score 0.
        """
        words = letters(text) if text else ""
        if not words or not self.langs:
            return UNKNOWN, 0.0
        size = [0] * len(self.langs)
        for at in (0, *range(HEAD, len(words), self.block)):
            block = f" {words[at : at + (self.block if at else HEAD)]} ".encode()
            for k, (c, carriers) in enumerate(self.compressors):
                size[k] += len(c.compress(block))
                if at == 0:
                    size[k] += sum(max(1, len(c.compress(x + block)) - own) for x, own in carriers)
        best, *rest = sorted(range(len(size)), key=lambda k: (size[k], k))
        return self.langs[best], (1 - size[best] / size[rest[0]]) if rest else 1.0


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``id_col``, lang_pred, score, rejected for every document; one pass, no shuffle.

    lang_pred is ``und`` with score 0 if the text is null, empty or has no letter, or if nothing could be learned.
    rejected is true for ``und`` and where the score is not over ``min_margin`` (a tie included). Whole texts are
    compressed block by block, so a very long one takes no more memory. Repeated rows are judged alike and kept.
    Columns other than those named are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = once(("languages", hash(shared.value)), lambda: Classifier(shared.value))
        for b in batches:
            got = [c.predict(t) for t in (b.column(1) if at is None else b.column(0).field(at)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["row", "lang_pred", "score"])
        pa.default_memory_pool().release_unused()  # the worker stays, idle, while the next stage runs

    names = list(dict.fromkeys([id_col, *keep]))
    at = names.index(text_col) if text_col in names else None  # a text that is kept goes to the tasks once
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    own = docs.select(row.alias("row"), *([F.col(text_col).alias("text")] if at is None else []))
    kind = own.schema["row"].dataType.simpleString()
    out = own.mapInArrow(run, f"row {kind}, lang_pred string, score double")
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)], "lang_pred", "score", ((F.col("lang_pred") == UNKNOWN) | ~(F.col("score") > min_margin)).alias("rejected"))
