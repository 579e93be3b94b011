"""Benchmark decontamination: q-gram lemma filter in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import byte_batches, once

NOT_WORD = re.compile(r"[\W_]+")
#: Length of a q-gram, and the share of an item's characters that may be edited.
Q, EDITS = 10, 0.08
#: Characters of normalised documents looked at together, and bytes of benchmark text per pass over the documents.
RUN, BLOCK_BYTES = 1 << 20, 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table that leaves most grams out before the exact look-up.
TABLE = 22


def normal(text: str | None) -> str:
    """Lower-cased letters and digits; runs of anything else are one space."""
    return NOT_WORD.sub(" ", text.lower()).strip() if text else ""


def chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h *= BASE
        h += x[j : j + n]
    return h * BASE


def budget(m: int, q: int, edits: float) -> tuple[int, int]:
    """(k, T): edits allowed for an item of m characters, lowered until the lemma's bound T is at least 1.

    With k edits m - q + 1 - k * q of the item's q-grams stay whole, within k + 1 neighbouring diagonals.
    """
    k = min(int(m * edits), (m - q) // q)
    return k, m - q + 1 - k * q


class Index:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: float):
        self.q, self.items = q, [(i, chars(t), t) for i, t in items if len(t) >= q]
        # An item without a whole q-gram allows no edit: it is found as whole words, exactly.
        self.short: dict[str, list[int]] = {}
        for i, t in items:
            if 0 < len(t) < q:
                self.short.setdefault(t, []).append(i)
        self.words = sorted({t.count(" ") + 1 for t in self.short})
        self.k = np.array([budget(len(x), q, edits)[0] for _, x, _ in self.items], np.int64)
        self.least = np.array([budget(len(x), q, edits)[1] for _, x, _ in self.items], np.int64)
        size = np.array([len(x) for _, x, _ in self.items], np.int64)
        hashes = [gram_hashes(x, q) for _, x, _ in self.items]
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item, at = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]), np.concatenate([*map(np.arange, map(len, hashes)), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.first = np.concatenate((self.first, [len(h)]))
        self.item, self.at = item[order], at[order]
        self.table = np.zeros(1 << TABLE, bool)
        self.table[(self.grams >> np.uint64(64 - TABLE)).astype(np.int64)] = True
        # Items of like length share a window: as many places with any gram as the least bound must lie in it.
        self.windows = []
        for part in np.array_split(np.argsort(size), min(8, len(size)) or 1):
            if len(part):
                self.windows.append((int((size[part] + self.k[part]).max()), int(self.least[part].min())))

    def regions(self, hit: np.ndarray) -> np.ndarray:
        """Places that lie in a window with enough places that share a gram with any item."""
        total = np.concatenate(([0], np.cumsum(hit)))
        n, near = len(hit), np.zeros(len(hit) + 1, np.int64)
        for width, least in self.windows:
            width = min(width, n)
            full = np.flatnonzero(total[width:] - total[: n + 1 - width] >= least)
            np.add.at(near, full, 1)
            np.add.at(near, np.minimum(full + width, n), -1)
        return np.cumsum(near[:n]) > 0

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """(item, edits, start, end) of what each normalised text holds; places count its characters."""
        out = [self.exact(t) for t in texts]
        if not self.items:
            return out
        x = chars("\0".join(texts))
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        h = gram_hashes(x, self.q)
        place = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.grams, h[place]), len(self.grams) - 1)
        same = self.grams[which] == h[place]
        place, which = place[same], which[same]
        if not len(place):
            return out
        hit = np.zeros(len(h), np.int64)
        hit[place] = 1
        good = self.regions(hit)[place]
        place, which = place[good], which[good]
        n = self.first[which + 1] - self.first[which]
        index = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place, item = np.repeat(place, n), self.item[index]
        shift = self.k[item] * 4 + max(len(x) for _, x, _ in self.items)
        diagonal = place - self.at[index] + shift  # never negative
        band = diagonal // (self.k[item] + 1)
        span = int(band.max()) + 3 if len(band) else 3
        # A bucket belongs to one document, so that neighbours in a run don't share one.
        doc = np.searchsorted(starts, place, side="right") - 1
        owner = doc * len(self.items) + item
        key, first, count = np.unique(owner * span + band, return_index=True, return_counts=True)
        after = np.searchsorted(key, key + 1)
        follows = (after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1)
        # The band of a key is its own diagonals and the next key's: bands overlap by half, so k + 1 neighbours lie in one.
        total = count + np.where(follows, count[np.minimum(after, len(key) - 1)], 0)
        begins = np.concatenate((key, key - 1))  # a bucket may also be the second half of a band that begins before it
        totals = np.concatenate((total, count))
        firsts = np.concatenate((first, first))
        enough = totals >= self.least[item[firsts]]
        done: set[tuple[int, int, int]] = set()
        for b, f in zip(begins[enough].tolist(), firsts[enough].tolist(), strict=True):
            i, d = int(item[f]), int(doc[f])
            low = (b - int(owner[f]) * span) * int(self.k[i] + 1) - int(shift[f])
            if (d, i, low) not in done:
                done.add((d, i, low))
                found = self.align(i, texts[d], low - int(starts[d]))
                if found:
                    out[d].append(found)
        return [sorted(set(x)) for x in out]

    def exact(self, text: str) -> list[tuple[int, int, int, int]]:
        """The short items of a text, each a run of its whole words."""
        out = []
        if self.short and text:
            at = [0, *(m.end() for m in re.finditer(" ", text))]
            for n in self.words:
                for k in range(len(at) - n + 1):
                    end = at[k + n] - 1 if k + n < len(at) else len(text)
                    out += [(i, 0, at[k], end) for i in self.short.get(text[at[k] : end], ())]
        return out

    def align(self, i: int, text: str, low: int) -> tuple[int, int, int, int] | None:
        """The item's best place on the band's diagonals and k to either side, if it takes at most k edits."""
        name, item, plain = self.items[i]
        k, m = int(self.k[i]), len(item)
        left, width = low - k, 2 * (k + 1) + 2 * k + 1
        at = text.find(plain, max(0, left), max(0, left + width + m))
        if at >= 0:
            return name, 0, at, at + m
        # Before and after the text the region holds zeros, which match nothing.
        region = np.zeros(m + width, np.uint32)
        have = chars(text[max(0, left) : max(0, left + m + width)])
        region[max(0, -left) : max(0, -left) + len(have)] = have
        far, d, ramp = k + 1, np.zeros(width, np.int64), np.arange(width)
        for r in range(m):
            step = d + (region[r : r + width] != item[r])
            step[:-1] = np.minimum(step[:-1], d[1:] + 1)
            d = np.minimum.accumulate(step - ramp) + ramp
            if d.min() >= far:
                return None
        best = int(d.argmin())
        return (name, int(d[best]), max(0, left + best), min(len(text), left + best + m)) if d[best] <= k else None


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, edits: float = EDITS, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, ``id_col`` and found: array of (item_id, edits, start, end), for every document.

    A document holds an item if its normalised text (letters and digits, lower-cased) has a run at an edit
    distance of at most ``edits`` of the item's characters, less where the q-gram lemma would give no bound.
    Items are searched in blocks of about ``block_bytes``, each a pass over the documents, so that a task holds one
    block whatever the benchmark's size (a single larger item is a block); one block takes no shuffle, each further one
    reads the documents and the benchmark again. Items under ``q`` normalised characters allow no edit and must be
    whole words of the document; items with null text or without a letter or digit are never found. Null and empty
    texts hold nothing. Repeated rows are all returned; of an item that occurs in several places each is listed. Empty
    tables give empty results; columns not named are not read. Texts are searched in runs of about RUN characters, a
    longer one by itself, so a task takes memory for the longest text.
    """
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    names = list(dict.fromkeys([id_col, *keep]))
    at = names.index(text_col) if text_col in names else None  # a text that is kept goes to the tasks once
    row = F.struct(*[F.col(c).alias(f"c{j}") for j, c in enumerate(names)], F.xxhash64(text_col).alias("h"))
    own = docs.select(row.alias("row"), *([F.col(text_col).alias("text")] if at is None else []))
    spans = "array<struct<item_id:bigint,edits:int,start:int,end:int>>"
    kind = own.schema["row"].dataType.simpleString()
    kind_of = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def one_block(b: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r["item"], normal(r["text"])) for r in part])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = once(("benchmark", b, hash(tuple(shared.value))), lambda: Index(shared.value, q, edits))
            for whole in batches:
                raw = (whole.column(1) if at is None else whole.column(0).field(at)).to_pylist()
                for lo, hi in byte_batches(raw, RUN):
                    found = index.search([normal(t) for t in raw[lo:hi]])
                    rows = [[dict(zip(("item_id", "edits", "start", "end"), s, strict=True)) for s in f] for f in found]
                    yield pa.RecordBatch.from_arrays([whole.column(0).slice(lo, hi - lo), pa.array(rows, kind_of)], names=["row", "found"])

        return own.mapInArrow(run, f"row {kind}, found {spans}")

    if blocks == 1:
        out = one_block(0)
    else:
        # Each pass gives a row for each document; a row's passes meet by its columns and text hash.
        every = one_block(0)
        for b in range(1, blocks):
            every = every.unionByName(one_block(b))
        flat = every.select("row", F.explode_outer("found").alias("f"))
        met = flat.groupBy("row").agg(F.array_sort(F.collect_set("f")).alias("found"))
        out = own.join(met, own["row"].eqNullSafe(met["row"]), "left").select(own["row"], F.coalesce("found", F.array().cast(spans)).alias("found"))
    return out.select(*[F.col(f"row.c{j}").alias(c) for j, c in enumerate(names)], "found")
