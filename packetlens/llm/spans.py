"""Long exact spans shared between texts.

Texts are cut into pieces, the "sentences" of the method, at places that depend on the
neighbouring characters only (a cut is the place with the smallest hash in a window), so that
a copied stretch is cut alike wherever it stands.  Punctuation cannot do that: stretches begin
and end inside sentences, and logs, JSON and Chinese have none.  Three steps, each a global
join on hashes:

1. Short runs, of two consecutive pieces each, that stand in several texts.  Every stretch of
   the asked length holds one, so nothing shared is missed.
2. Long runs, of as many consecutive pieces as the asked length needs, made of repeated short
   runs only.  Where one stands in another text, all its characters are shared; places that
   such a run covers are done.
3. Windows of the asked length, character by character, only for the ragged ends: short runs
   that own a window which no long run covers, though all short runs in it repeat, are looked
   at in every text that has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlens.llm import bloom
from packetlens.llm.dedup import BROADCAST_HASHES
from packetlens.runtime import materialize, release

LENGTH = 200
#: Characters whose hash decides about a cut.
CUT_CONTEXT = 8
SHORTEST = 32
#: Characters handled at once; longer texts are taken in overlapping parts.
PART = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Hashes of all substrings of a length, from prefix sums modulo 2 ** 64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, base: int) -> None:
        n = len(codes)
        if base not in self._powers or len(self._powers[base][0]) < n:
            size = max(n, 1 << 16)
            up = np.cumprod(np.full(size, base, np.uint64))
            down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))
            self._powers[base] = up, down
        up, self.down = self._powers[base]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes + np.uint64(base)) * up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the substrings at ``start``; ``length`` is one number or one for each."""
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def cut_window(length: int) -> int:
    """Places among which one is a cut: a power of two such that a cut and the two pieces
    behind it lie inside every window of ``length``."""
    return 1 << ((length - CUT_CONTEXT) // 3).bit_length() - 1


class Block:
    """Some texts joined, with their cuts.  Places are counted within the block."""

    def __init__(self, text: str, rows: list[int], sizes: list[int], offsets: list[int], length: int) -> None:
        self.rows, self.offsets = np.asarray(rows), np.asarray(offsets)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - np.asarray(sizes)
        self.length = length
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = len(self.codes)
        self.roll = Roller(self.codes, _BASES[0])
        order = self.roll.all(CUT_CONTEXT)
        # Smallest hash first, the later place on ties.
        rank = (order & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - np.arange(len(order), dtype=np.uint64))
        step = 1
        while step < cut_window(length):
            rank = np.minimum(rank[:-step], rank[step:])
            step *= 2
        #: the cut of the window that begins at a place; ``size`` where there is none
        self.cut = np.full(self.size + 2, self.size)
        self.cut[: len(rank)] = (np.uint64(0xFFFFFFFF) - (rank & np.uint64(0xFFFFFFFF))).astype(np.int64)

    def next(self, cut: np.ndarray) -> np.ndarray:
        """The cut that ends the piece behind a cut."""
        return self.cut[cut + 1]

    def settled(self, cut: np.ndarray) -> np.ndarray:
        """Where the characters end that decide about the run of two pieces behind a cut."""
        return self.next(cut) + cut_window(self.length) + CUT_CONTEXT

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Cuts whose short run is decided inside their text, and the text's number."""
        places = np.arange(self.size)
        part = np.searchsorted(self.ends, places, side="right")
        cut = self.cut[places]
        inside = (cut < self.size) & (self.settled(np.minimum(cut, self.size)) <= self.ends[part])
        cut, part = cut[inside], part[inside]
        first = np.ones(len(cut), bool)
        first[1:] = (cut[1:] != cut[:-1]) | (part[1:] != part[:-1])
        return cut[first], part[first]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Start of each window of the length within one text, and the text's number."""
        starts = np.arange(max(0, self.size - self.length + 1))
        part = np.searchsorted(self.ends, starts, side="right")
        inside = starts + self.length <= self.ends[part]
        return starts[inside], part[inside]

    def hashes(self, start: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
        second = Roller(self.codes, _BASES[1])
        return self.roll.at(start, length).view(np.int64), second.at(start, length).view(np.int64)

    def place(self, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Places within the text."""
        return (at - self.begins[part] + self.offsets[part]).astype(np.int64)

    def marks(self, lists) -> np.ndarray:
        """Which places of the block are among the places listed for each text."""
        out = np.zeros(self.size + 2, bool)
        for row, begin, end, offset in zip(self.rows, self.begins, self.ends, self.offsets):
            here = np.asarray(lists[row]) - offset + begin
            out[here[(here >= begin) & (here < end)]] = True
        return out


def blocks(texts, length: int) -> Iterator[Block]:
    """Texts joined to blocks of about PART characters; neighbouring parts of a long text
    share two lengths."""
    block, rows, sizes, offsets, total = [], [], [], [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, PART):
            piece = t[at : at + PART + 2 * length]
            block.append(piece)
            rows.append(i)
            sizes.append(len(piece))
            offsets.append(at)
            total += len(piece)
            if total >= PART:
                yield Block("".join(block), rows, sizes, offsets, length)
                block, rows, sizes, offsets, total = [], [], [], [], 0
    if block:
        yield Block("".join(block), rows, sizes, offsets, length)


def _short_runs(length: int):
    """The run of two pieces behind each cut; ``again`` marks what a text has had before."""

    def go(batches):
        for pdf in batches:
            docs = pdf["doc"].to_numpy(object)
            for b in blocks(pdf["text"], length):
                cut, part = b.runs()
                h = b.roll.at(cut, b.next(b.next(cut)) + CUT_CONTEXT - cut).view(np.int64)
                again = pd.DataFrame({"row": b.rows[part], "h": h}).duplicated()
                yield pd.DataFrame({"doc": docs[b.rows[part]], "at": b.place(cut, part), "h": h, "again": again})

    return go


def _long_runs(length: int):
    """Runs of consecutive pieces, just long enough, whose short runs all repeat."""

    def go(batches):
        for pdf in batches:
            docs = pdf["doc"].to_numpy(object)
            for b in blocks(pdf["text"], length):
                mark = b.marks(pdf["ats"])
                start = np.flatnonzero(mark)
                part = np.searchsorted(b.ends, start, side="right")
                left, middle = start, b.next(start)
                end, sound = b.next(middle), np.ones(len(start), bool)
                while (more := (end + CUT_CONTEXT - start < length) & (end < b.size) & sound).any():
                    left, middle, end = np.where(more, middle, left), np.where(more, end, middle), np.where(more, b.next(end), end)
                    sound &= mark[left]
                sound &= (end + CUT_CONTEXT - start >= length) & (end + CUT_CONTEXT <= b.ends[part])
                start, part, size = start[sound], part[sound], (end + CUT_CONTEXT - start)[sound]
                h, g = b.hashes(start, size)
                yield pd.DataFrame({"h": h, "g": g, "doc": docs[b.rows[part]], "at": b.place(start, part), "size": size})

    return go


def _known(b: Block, lists) -> np.ndarray:
    """Running number of places that the covered stretches of each text hold."""
    change = np.zeros(b.size + 1, np.int64)
    for row, begin, end, offset in zip(b.rows, b.begins, b.ends, b.offsets):
        for c in lists[row] if lists[row] is not None else ():
            lo, hi = c["at"] - offset + begin, c["at"] + c["size"] - offset + begin
            if lo < end and hi > begin:
                change[max(lo, begin)] += 1
                change[min(hi, end)] -= 1
    return np.r_[0, np.cumsum(np.cumsum(change)[:-1] > 0)]


def _sound_windows(b: Block, mark: np.ndarray, starts: np.ndarray, part: np.ndarray):
    """Those of some windows whose decided short runs all repeat."""
    cut, sound = b.cut[starts], mark[b.cut[starts]]
    inside = sound.copy()
    while inside.any():
        inside &= b.settled(cut) <= starts + b.length
        sound &= ~inside | mark[cut]
        inside &= sound
        cut = np.where(inside, b.next(cut), cut)
    return starts[sound], part[sound]


def _open_runs(length: int):
    """Short runs that own a sound window reaching beyond the covered places."""

    def go(batches):
        for pdf in batches:
            for b in blocks(pdf["text"], length):
                known = _known(b, pdf["covered"])
                starts, part = b.windows()
                beyond = known[starts + length] - known[starts] < length
                starts, _ = _sound_windows(b, b.marks(pdf["ats"]), starts[beyond], part[beyond])
                cut = np.unique(b.cut[starts])
                h = b.roll.at(cut, b.next(b.next(cut)) + CUT_CONTEXT - cut).view(np.int64)
                yield pd.DataFrame({"h": np.unique(h)})

    return go


def _open_windows(length: int):
    """All sound windows that open runs own."""

    def go(batches):
        for pdf in batches:
            docs = pdf["doc"].to_numpy(object)
            for b in blocks(pdf["text"], length):
                starts, part = b.windows()
                owned = b.marks(pdf["open"])[b.cut[starts]]
                starts, part = _sound_windows(b, b.marks(pdf["ats"]), starts[owned], part[owned])
                h, g = b.hashes(starts, length)
                yield pd.DataFrame({"h": h, "g": g, "doc": docs[b.rows[part]], "at": b.place(starts, part)})

    return go


def _in_several(table: DataFrame) -> DataFrame:
    """Rows whose two hashes stand in more than one document."""
    several = table.groupBy("h", "g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    return table.join(several.select("h", "g"), ["h", "g"], "left_semi")


def shared_spans(
    df: DataFrame,
    *,
    doc_id: str,
    text: str,
    length: int = LENGTH,
    segment_keys: int = bloom.SEGMENT_KEYS,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """Longest unbroken runs of shared characters: ``doc_id, span_start, span_end``.

    A character is shared if it lies in a stretch of at least ``length`` characters that
    stands in the text of another document.  NULL, empty and shorter texts share nothing; a
    document delivered twice is one document; stretches repeated only within one document
    are not shared; rows without ``doc_id`` are left out.

    Short runs are told by 64 bits through Bloom filters (too many cost work, none is lost),
    long runs and windows by 128 bits.  A passage copied to a third of all documents is one
    pre-aggregated row per task in every aggregation; the way back to its places is a join
    that adaptive execution splits.  Up to ``broadcast_hashes`` repeated hashes, and places of
    repeated runs, (both counted) are sent to the runs and to the texts; more meet them in a
    shuffle join.  Writes its intermediate tables when
    it is called.
    """
    if length < SHORTEST:
        raise ValueError(f"length must be at least {SHORTEST}")
    docs = df.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    docs = docs.where((F.length("text") >= length) & F.col("doc").isNotNull())
    kind = dict(docs.dtypes)["doc"]
    runs = materialize(docs.mapInPandas(_short_runs(length), f"doc {kind}, at long, h long, again boolean"), "runs")
    once = runs.where("not again")
    repeated = materialize(bloom.repeated_hashes(once, "h", rows=once.count(), segment_keys=segment_keys), "repeats")
    repeated = F.broadcast(repeated) if repeated.count() <= broadcast_hashes else repeated.hint("merge")
    kept = materialize(runs.join(repeated, "h", "left_semi").select("doc", "at", "h"), "kept")
    release(runs)
    few = kept.count() <= broadcast_hashes

    def beside(table: DataFrame, small: bool) -> DataFrame:
        """Places by document go to the texts while they are few; else both are shuffled."""
        return F.broadcast(table) if small else table

    marked = materialize(kept.groupBy("doc").agg(F.collect_set("at").alias("ats")), "marked")
    texts = docs.join(beside(marked, few), "doc")
    long_runs = materialize(
        texts.mapInPandas(_long_runs(length), f"h long, g long, doc {kind}, at long, size long"), "long"
    )
    whole = materialize(_in_several(long_runs).select("doc", "at", "size").distinct(), "whole")
    release(long_runs)
    covered = whole.groupBy("doc").agg(F.collect_list(F.struct("at", "size")).alias("covered"))
    covered = beside(covered, whole.count() <= broadcast_hashes)
    open_runs = texts.join(covered, "doc", "left").mapInPandas(_open_runs(length), "h long")
    open_runs = materialize(open_runs.distinct(), "open")
    open_runs = F.broadcast(open_runs) if open_runs.count() <= broadcast_hashes else open_runs.hint("merge")
    owners = kept.join(open_runs, "h", "left_semi").groupBy("doc").agg(F.collect_set("at").alias("open"))
    windows = materialize(
        texts.join(beside(owners, few), "doc").mapInPandas(_open_windows(length), f"h long, g long, doc {kind}, at long"), "windows"
    )
    ends = _in_several(windows).select("doc", "at", F.lit(length).cast("long").alias("size"))
    parts = whole.unionByName(ends).select("doc", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"))
    w = Window.partitionBy("doc").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = parts.withColumn("fresh", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy("doc", "run").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end")).select(
        F.col("doc").alias(doc_id), "span_start", "span_end"
    )


def shared_share(df: DataFrame, spans: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """For every document its length, its shared characters and their share (0 where none,
    NULL for NULL and empty texts)."""
    covered = spans.groupBy(doc_id).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    docs = df.select(F.col(f"`{doc_id}`").alias(doc_id), F.length(f"`{text}`").cast("long").alias("n_chars"))
    return docs.join(covered, doc_id, "left").select(
        doc_id,
        "n_chars",
        F.coalesce("shared_chars", F.lit(0).cast("long")).alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).alias("share"),
    )
