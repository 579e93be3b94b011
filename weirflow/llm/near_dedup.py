"""Near-duplicate documents: SetSketch registers in bands, joint likelihood, confirmation on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import once, written
from weirflow.llm.components import components
from weirflow.llm.shingles import SetSketch, normal, set_key, shingle_set

#: At a similarity of 0.8 a band of four registers agrees with 0.41; that none of 28 does has odds of 4e-7, at 0.85 of 1e-9.
BANDS, ROWS = 28, 4
#: Bands whose stars come first; what they link isn't compared again in the others.
FIRST_BANDS = 4
#: Members of a bucket compared at once when stars leave it in several components.
RIGHT_BLOCK, LEFT_BLOCK = 256, 1024
#: Least members of a bucket that stars may leave open: of two, the star has decided.
OPEN = 3
#: Classes whose keys are broadcast to find their texts (10 MB or so).
FEW = 1 << 18


def _sketch() -> SetSketch:
    return once("setsketch", lambda: SetSketch(BANDS * ROWS))


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, t, key, n, regs: the text's hash, the set's name and size and its registers (two bytes each); empty sets have n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = _sketch()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                key, n, regs = [], [], []
                for t in b.column(2).to_pylist():
                    s = shingle_set(normal(t), k)
                    key.append(set_key(s))
                    n.append(len(s))
                    regs.append(sketch.registers(s).astype("<u2").tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(regs, pa.binary())], names=["id", "t", "key", "n", "regs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _named(docs, id_col, text_col).mapInArrow(run, f"id {kind}, t bigint, key binary, n bigint, regs binary")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def _regs(column: pa.Array | pd.Series) -> np.ndarray:
    data = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(data), "<u2").reshape(len(data), BANDS * ROWS)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers don't rule the similarity out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = _sketch().may_reach(_regs(b.column("ra")), b.column("na").to_numpy(), _regs(b.column("rb")), b.column("nb").to_numpy(), percent / 100)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    side = lambda s: classes.select(F.col("c").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.mapInArrow(run, "a bigint, b bigint")


def packed_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """c, z: the compressed words of the one document that stands for each class in ``wanted`` (c, rid, rt).

    Id and text hash name the document, as one id may have several texts. Few classes are broadcast, so that no other
    text moves.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        z = zstd.ZstdCompressor(level=3)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                small = pa.array([z.compress(normal(t)) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], small], names=[*part.schema.names[:-1], "z"])

    own = _named(docs, id_col, text_col)
    this = F.col("id").eqNullSafe(F.col("rid")) & (F.col("t") == F.col("rt"))
    if wanted.count() <= FEW:
        found = own.join(F.broadcast(wanted), this).select("c", "text").mapInArrow(pack, "c bigint, z binary")
    else:
        found = own.mapInArrow(pack, f"id {kind}, t bigint, z binary").join(wanted, this).select("c", "z")
    return found.groupBy("c").agg(F.any_value("z").alias("z"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        unpack = zstd.ZstdDecompressor()
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))

        for b in batches:
            ok = []
            for za, zb in zip(b.column("za").to_pylist(), b.column("zb").to_pylist(), strict=True):
                # The hub of a star comes in many rows on end.
                if last[0] != za:
                    last = (za, shingle_set(unpack.decompress(za), k))
                x, y = last[1], shingle_set(unpack.decompress(zb), k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda s: texts.select(F.col("c").alias(s), F.col("z").alias(f"z{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "za", "zb").mapInArrow(run, "a bigint, b bigint").distinct()


def banded(classes: DataFrame) -> DataFrame:
    """band, key, c, id: a row for each class and band; the key hashes the band and its registers."""
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("regs", 2 * ROWS * j + 1, 2 * ROWS)) for j in range(BANDS)])
    return classes.select(F.posexplode(keys).alias("band", "key"), "c", "id")


def wanted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """c, rid, rt of the classes in pairs: id and text hash of the document that stands for it."""
    named = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    return named.join(classes.select("c", "rid", "rt"), "c")


def stars(bands: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs (a, b): the first class of each bucket with the first class of each other component in it.

    Without labels every class is a component of its own. A bucket that lies in one component gives no pair.
    """
    own = bands.withColumn("label", F.col("c")) if labels is None else bands.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    parts = own.groupBy("key", "label").agg(F.min(F.struct("id", "c")).alias("first"))
    hubs = parts.groupBy("key").agg(F.min("first").alias("hub"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "hub")
    return parts.join(hubs, "key").where("first <> hub").select(F.col("hub.c").alias("a"), F.col("first.c").alias("b")).distinct()


def open_buckets(bands: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, c, label) and the buckets that still hold several components: key, main, nr, nl.

    main is the largest component in the bucket; nr and nl are the numbers of blocks for all members and for
    those outside main. In buckets of two members the star has decided.
    """
    own = bands.join(labels, "c", "left").select("band", "key", "c", F.coalesce("label", "c").alias("label"))
    parts = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    found = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where(f"parts > 1 and size >= {OPEN}")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    return own, found.select("key", "main", blocks(F.col("size"), RIGHT_BLOCK).alias("nr"), blocks(F.col("size") - F.col("most"), LEFT_BLOCK).alias("nl"))


def remaining(own: DataFrame, buckets: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) between members of a bucket that stars have left in different components.

    The members outside the bucket's largest component meet every member, in blocks of bounded size; within
    the largest component, nothing is left to find. Pairs that the registers don't rule out are compared on their
    full sets in the block, each in the first band that brings it together, and only links come out.
    """
    member = own.join(buckets, "key").join(classes.select("c", "n", "regs"), "c").join(texts, "c")
    spot = lambda n, seed: F.pmod(F.xxhash64("c", F.lit(seed)), F.col(n)).cast("int")
    right = member.select("key", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"), spot("nr", 1).alias("r"), F.lit(False).alias("left"), "band", "c", "label", "n", "regs", "z")
    left = member.where("label <> main").select("key", spot("nl", 2).alias("l"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"), F.lit(True).alias("left"), "band", "c", "label", "n", "regs", "z")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard as zstd

        unpack, sketch, sets = zstd.ZstdDecompressor(), _sketch(), {}

        def full(c: int, z: bytes) -> np.ndarray:
            if c not in sets:
                sets[c] = shingle_set(unpack.decompress(z), k)
            return sets[c]

        x, y = rows[rows["left"]], rows[~rows["left"]]
        rx, ry = _regs(x["regs"]), _regs(y["regs"])
        yc, yl, yn, yz = y["c"].to_numpy(), y["label"].to_numpy(), y["n"].to_numpy(), y["z"].to_numpy()
        xc, xl, xn, xz, band = (x[f].to_numpy() for f in ("c", "label", "n", "z", "band"))
        pairs = []
        for i in range(len(x)):
            at = np.flatnonzero((yl != xl[i]) & (np.minimum(yn, xn[i]) * 100 >= np.maximum(yn, xn[i]) * percent))
            if len(at):
                alike = (ry[at] == rx[i]).reshape(len(at), BANDS, ROWS).all(axis=2)
                at = at[alike.argmax(axis=1) == band[i]]
                pairs.append(np.stack((np.full(len(at), i), at)))
        a, b = [], []
        i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        for lo in range(0, len(i), 1 << 14):
            pi, pj = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            ok = sketch.may_reach(rx[pi], xn[pi], ry[pj], yn[pj], percent / 100)
            for p, q in zip(pi[ok].tolist(), pj[ok].tolist(), strict=True):
                mine, other = full(xc[p], xz[p]), full(yc[q], yz[q])
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both and 100 * both >= percent * (len(mine) + len(other) - both):
                    a.append(min(xc[p], yc[q]))
                    b.append(max(xc[p], yc[q]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return left.unionByName(right).groupBy("key", "l", "r").applyInPandas(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept, text_hash, is_first for every document.

    Documents are linked if 100 * intersection >= percent * union of their k-word shingle sets; component_id is
    the smallest id reachable over links, kept says that it is the document's own. Documents with equal sets form
    a class and are compared once. Candidates are the members of a band's bucket: in the first bands each with the
    bucket's first document; then, in every bucket that still holds several components, the first of each with the
    bucket's first; then, where that leaves several, all members of the smaller ones with all members. Links are
    confirmed on full sets.
    is_first marks one document of each component, by id and ``text_hash`` (xxhash64 of the text): where an id names
    several texts, kept may hold for two of them, is_first holds for one.
    Null, empty and blank texts have no shingles and link with nothing. Repeated rows are all returned, in one
    component. Null ids take part; they are smaller than none, and such a row is kept if its component has no
    other id. An empty table gives an empty table; other columns are not read. A text is hashed in blocks; a task holds
    the sets of the texts that it compares, so it takes memory for the longest ones.
    """
    sketch = written(sketches(docs, id_col, text_col, k), "sketches")
    one = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    classes = sketch.where("n > 0").groupBy("key").agg(F.min(one).alias("one"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    # Written once, so that a class keeps its number c.
    classes = written(classes.select("key", F.monotonically_increasing_id().alias("c"), F.col("one.id").alias("id"), F.col("one.id").alias("rid"), F.col("one.t").alias("rt"), "n", "regs"), "classes")
    bands = banded(classes)
    few = written(likely(stars(bands.where(F.col("band") < FIRST_BANDS), None), classes, percent), "pairs")
    texts = written(packed_texts(docs, wanted(few, classes), id_col, text_col), "texts")
    links = written(confirmed(few, texts, percent, k), "links")
    labels = components(links)
    pairs = written(likely(stars(bands, labels), classes, percent).join(few, ["a", "b"], "left_anti"), "pairs")
    own, buckets = open_buckets(bands, labels)
    buckets = written(buckets, "buckets")
    members = own.join(buckets, "key", "left_semi").select("c").unionByName(pairs.select(F.col("a").alias("c"))).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    unseen = written(members.join(texts.select("c"), "c", "left_anti").join(classes.select("c", "rid", "rt"), "c"), "unseen")
    texts = written(texts.unionByName(packed_texts(docs, unseen, id_col, text_col)), "texts")
    links = written(links.unionByName(confirmed(pairs, texts, percent, k)), "links")
    labels = components(links)
    own, buckets = open_buckets(bands, labels)
    links = written(links.unionByName(remaining(own, buckets, classes, texts, percent, k)), "links")
    labels = components(links)
    parts = classes.select("key", "c", "rid", "rt").join(labels, "c", "left").select("key", F.struct(F.col("rid").isNull().alias("none"), "rid", "rt").alias("one"), F.coalesce("label", "c").alias("label"))
    least = parts.groupBy("label").agg(F.min("one").alias("least"))
    named = parts.join(least, "label").select("key", "least")
    out = sketch.select("id", "t", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("least.rid"))
    kept = F.col("id").eqNullSafe(component)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"),
        F.col("t").alias("text_hash"), (alone | (kept & (F.col("t") == F.col("least.rt")))).alias("is_first"))
