"""Problem 6: long exact spans shared between records (level-wise doubling)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import checkpoint, code_points, match_records, mix64

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Characters that are hashed in one go, and within which repeats are settled before anything is shuffled.
_PART = 1 << 19
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIX = np.arange(64, dtype=np.uint64)


class Texts:
    """Texts laid end to end: 128-bit hashes of windows of any length, and how far each place is from its text's end."""

    def __init__(self, texts: list[str], longest: int):
        codes = code_points("".join(texts)).astype(np.uint64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n = len(codes)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.owner = np.repeat(np.arange(len(texts)), lengths)
        self.room = self.ends[self.owner] - np.arange(self.n)
        self.codes = codes
        # by doubling: entry k has the windows of 2**k characters, hashed from two of half the length
        self.levels = [tuple(mix64(codes + base) for base in _BASES)]
        while 2 << (len(self.levels) - 1) <= min(longest, self.n):
            k = 1 << (len(self.levels) - 1)
            self.levels.append(tuple(mix64(h[:-k] * base + h[k:]) for h, base in zip(self.levels[-1], _BASES)))

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows of one length; those that run over a text's end mean nothing."""
        if self.n < length:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return self.at(np.arange(self.n - length + 1), np.full(self.n - length + 1, length))

    def at(self, places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows (place, length): from the two largest powers of two that cover it."""
        out = np.empty(len(places), np.uint64), np.empty(len(places), np.uint64)
        power = np.frexp(lengths.astype(np.float64))[1] - 1
        for k in np.unique(power):
            at = np.flatnonzero(power == k)
            first, last = places[at], places[at] + lengths[at] - (1 << int(k))
            for h, level, base in zip(out, self.levels[k], _BASES):
                h[at] = mix64(level[first] * base + (level[last] ^ lengths[at].astype(np.uint64)))
        return out


def slide(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick over every `width` neighbours, by doubling."""
    have = 1
    while have < width and len(values):
        step = min(have, width - have)
        values = pick(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def landmarks(t: Texts, half: int, whole: int) -> np.ndarray:
    """Places of windows of `half` whose hash is the least among those of some window of `whole`.

    Which they are depends on the characters of that window alone, so any run of `whole` that two records share has a
    landmark in the same place of it in both.
    """
    h, width = t.hashes(half)[0], whole - half + 1
    least = slide(h, width, np.minimum)
    least = np.where(t.room[: len(least)] >= whole, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = slide(np.concatenate([pad, least, pad]), width, np.maximum) if len(least) else least
    return np.flatnonzero((h[: len(most)] == most) & (most > 0))


def around(t: Texts, known: np.ndarray, half: int, whole: int) -> np.ndarray:
    """Starts of windows of `whole` whose landmark is one of the known places."""
    h, width = t.hashes(half)[0], whole - half + 1
    own = np.full(len(h), _LAST)
    own[known] = h[known]
    least = slide(h, width, np.minimum)
    return np.flatnonzero((least == slide(own, width, np.minimum)) & (t.room[: len(least)] >= whole))


MARKS = "h1 long, h2 long, rec long, other long, block int, bits long"


def settled(h1: np.ndarray, h2: np.ndarray, rec: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """Rows (MARKS) for windows given in order of (rec, place): what is settled among them is settled here.

    A row marks up to 64 places of a record. A window that two of these records hold is repeated: its places need no
    further look (other = -1), and one row stands for it towards all other records. So a window that a third of all
    records hold sends one row a part, not one a record.
    """
    block, bits = (place >> 6).astype(np.int32), np.left_shift(np.uint64(1), (place & 63).astype(np.uint64))
    order = np.argsort(h1, kind="stable")
    a, b, r = h1[order], h2[order], rec[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a))[: len(first)] - 1
    several = r[first] != r[last]
    sure = several[np.cumsum(new) - 1] if len(a) else np.zeros(0, bool)
    one = first[several]  # one row for each window that is known to be repeated
    parts = [(a[one], b[one], r[one], r[last[several]], block[order][one], bits[order][one])]
    # windows of one record: its places in a block are one row
    lone = np.flatnonzero(~sure)
    if len(lone):
        x, k = order[lone], np.ones(len(lone), bool)
        k[1:] = new[lone][1:] | (block[x][1:] != block[x][:-1]) | (r[lone][1:] != r[lone][:-1])
        s = np.flatnonzero(k)
        parts.append((h1[x][s], h2[x][s], rec[x][s], rec[x][s], block[x][s], np.bitwise_or.reduceat(bits[x], s)))
    x = np.sort(order[sure])
    if len(x):
        k = np.ones(len(x), bool)
        k[1:] = (rec[x][1:] != rec[x][:-1]) | (block[x][1:] != block[x][:-1])
        s = np.flatnonzero(k)
        key = mix64((rec[x][s].astype(np.uint64) << np.uint64(26)) ^ block[x][s].astype(np.uint64))
        parts.append((key, mix64(key), rec[x][s], np.full(len(s), -1, np.int64), block[x][s], np.bitwise_or.reduceat(bits[x], s)))
    h1, h2, rec, other, block, bits = (np.concatenate(c) for c in zip(*parts))
    return pd.DataFrame({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "rec": rec, "other": other, "block": block, "bits": bits.view(np.int64)})


def places(blocks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The marked places, in order."""
    order = np.argsort(blocks, kind="stable")
    on = (np.asarray(bits, np.int64).view(np.uint64)[order][:, None] >> _SIX & np.uint64(1)).astype(bool)
    return (np.asarray(blocks, np.int64)[order][:, None] * 64 + _SIX.astype(np.int64))[on]


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    yield from (p for _, p in batch.groupby(batch["text"].str.len().cumsum() // _PART, sort=False))


def _windows(half: int, whole: int):
    """Landmarks of `half` where nothing is known yet, else windows of `whole` around those that are repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch):
                t = Texts(part["text"].tolist(), whole)
                if "blocks" in part:
                    known = [places(b, m) + at for b, m, at in zip(part["blocks"], part["bits"], t.begins)]
                    length, at = whole, around(t, np.concatenate(known), half, whole)
                else:
                    length, at = half, landmarks(t, half, whole)
                h1, h2 = t.at(at, np.full(len(at), length))
                yield settled(h1, h2, part["rec"].to_numpy()[t.owner[at]], at - t.begins[t.owner[at]])

    return run


def _repeated(windows: DataFrame) -> DataFrame:
    """(rec, blocks, bits): places of the windows (MARKS) that two records hold. One shuffle by window, one by record."""
    same = Window.partitionBy("h1", "h2")
    kept = windows.withColumn("lo", F.min(F.least("rec", "other")).over(same)).withColumn("hi", F.max(F.greatest("rec", "other")).over(same)).filter("lo < hi")
    blocks = kept.select("rec", "block", "bits").repartition("rec").groupBy("rec", "block").agg(F.bit_or("bits").alias("bits"))
    return blocks.groupBy("rec").agg(F.collect_list("block").alias("blocks"), F.collect_list("bits").alias("bits"))


def covered(starts: np.ndarray, length: int) -> int:
    """Characters in the union of windows of `length` that begin at `starts` (in order)."""
    return int(np.minimum(np.diff(starts), length).sum() + length) if len(starts) else 0


def _cover(length: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blocks, bits in batches:
            yield pd.Series([covered(places(b, m), length) for b, m in zip(blocks, bits)], dtype="int64")

    return run


def distinct_texts(records: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Members (unit_id, rec) and texts (rec, text, copies) of records long enough to hold a run.

    Texts are told apart by 128 bits and then numbered.
    """
    rows = records.filter((F.length("text") >= min_chars) & F.col("unit_id").isNotNull()).select("unit_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    texts = checkpoint(rows.groupBy("h1", "h2", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("rec", F.monotonically_increasing_id()))
    members = rows.select("unit_id", "h1", "h2").join(texts.select("h1", "h2", "rec").hint("merge"), ["h1", "h2"])
    return members.select("unit_id", "rec"), texts.select("rec", "text", "copies")


def shared_spans(records: DataFrame, min_chars: int = 40, longest: bool = False) -> DataFrame:
    """(unit_id, shared_chars[, longest_chars]): how much of each record stands verbatim in runs of min_chars or more in
    another record; only records with such a run come out.

    Level-wise doubling: windows of half the length are looked up first - of them only the landmarks, of which every run
    has one - and windows of min_chars are formed and looked up only where their landmark is repeated. Windows are
    settled within a part of the texts before they are shuffled, so a window that many records hold costs one row a
    part. Copies are collapsed: a record with copies is shared as a whole. With `longest`, longest_chars is the length
    of the record's longest such run (see `longest_runs`). Any min_chars of 1 or more will do. Null and short texts
    give no rows; an empty table gives an empty result.
    """
    members, texts = distinct_texts(records, min_chars)
    half = max(1, min_chars // 2)
    first = _repeated(texts.select("rec", "text").mapInPandas(_windows(half, min_chars), MARKS))
    with_text = texts.select("rec", "text").join(first.hint("merge"), "rec")
    level = checkpoint(_repeated(with_text.mapInPandas(_windows(half, min_chars), MARKS)))
    sums = level.select("rec", F.pandas_udf(_cover(min_chars), "long")("blocks", "bits").alias("part"))
    whole = F.when(F.col("copies") > 1, F.length("text").cast("long")).otherwise(F.col("part"))
    out = texts.join(sums.hint("merge"), "rec", "left").select("rec", whole.alias("shared_chars"), "copies", F.length("text").cast("long").alias("chars")).filter("shared_chars is not null")
    if longest:
        best = longest_runs(texts.select("rec", "text"), level, min_chars)
        out = out.join(best.hint("merge"), "rec", "left").withColumn("longest_chars", F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.col("longest")))
    return members.join(out.drop("copies", "chars", "longest").hint("merge"), "rec").drop("rec")


NODES = "rec long, place int, lo int, size int, c1 long, c2 long, m1 long, m2 long, prev long"


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For windows (place, lo): their hash, that of the window of lo + size // 2 there (0, 0: none) and the character before."""
    for batch in batches:
        for part in _parts(batch):
            n = part["starts"].str.len().to_numpy(np.int64)
            place, lo, size = (np.concatenate([np.asarray(x, np.int64) for x in part[c]]) for c in ("starts", "los", "sizes"))
            t = Texts(part["text"].tolist(), int((lo + size // 2).max()))
            at = np.repeat(t.begins, n) + place
            mid = np.where((t.room[at] >= lo + size // 2) & (size > 1), lo + size // 2, 0)
            c1, c2 = t.at(at, lo)
            m1, m2 = t.at(at, np.maximum(mid, 1))
            m1[mid == 0] = m2[mid == 0] = 0
            prev = np.where(place > 0, t.codes[np.maximum(at - 1, 0)].astype(np.int64), -1)
            columns = [np.repeat(part["rec"].to_numpy(), n), place.astype(np.int32), lo.astype(np.int32), size.astype(np.int32), *(h.view(np.int64) for h in (c1, c2, m1, m2)), prev]
            yield pd.DataFrame(dict(zip((c.split()[0] for c in NODES.split(", ")), columns)))


def _places_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        at = [places(b, m) for b, m in zip(batch["blocks"], batch["bits"])]
        n = np.fromiter(map(len, at), np.int64, len(at))
        yield pd.DataFrame({"rec": np.repeat(batch["rec"].to_numpy(), n), "place": np.concatenate(at).astype(np.int32) if len(at) else np.empty(0, np.int32)})


def _looked_at(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    lists = nodes.groupBy("rec").agg(*(F.collect_list(c).alias(n) for c, n in (("place", "starts"), ("lo", "los"), ("size", "sizes"))))
    return texts.join(lists.hint("merge"), "rec").mapInPandas(_nodes, NODES)


def _held_twice(nodes: DataFrame, keys: list[str], *more) -> DataFrame:
    """Windows that two records hold; counted with map-side combine, so a hot one is no hot key."""
    found = nodes.groupBy(*keys).agg(F.min("rec").alias("r1"), F.max("rec").alias("r2"), *more).filter("r1 <> r2")
    return found.drop("r1", "r2")


def longest_runs(texts: DataFrame, level: DataFrame, min_chars: int) -> DataFrame:
    """(rec, longest): the exact length of the longest run of each record of `level` that another record holds.

    A longest run cannot be extended to the left, so only windows whose holders differ in the character before (or
    begin with the text) go on. They are doubled until none is repeated, which gives each record a length lo it
    reaches and a bound 2 lo it does not; halving that range settles it. In each round a window stays in play at a
    length as long as a record whose answer lies in that range holds it too.
    """
    start = level.mapInPandas(_places_of, "rec long, place int").select("rec", "place", F.lit(min_chars).alias("lo"), F.lit(1).alias("size"))
    seen = _looked_at(texts, start)
    edges = _held_twice(seen, ["c1", "c2"], F.min("prev").alias("p1"), F.max("prev").alias("p2")).filter("p1 <> p2 or p1 = -1").select("c1", "c2")
    now = checkpoint(seen.join(edges.hint("merge"), ["c1", "c2"], "left_semi").select("rec", "place"))
    nodes, length = None, min_chars
    while not now.isEmpty():
        here = now.select("rec", "place", F.lit(length).alias("lo"), F.lit(length).alias("size"))
        nodes = here if nodes is None else nodes.unionAll(here)
        length *= 2
        longer = _looked_at(texts, now.select("rec", "place", F.lit(length // 2).alias("lo"), F.lit(length).alias("size"))).filter("m1 <> 0 or m2 <> 0")
        now = checkpoint(longer.join(_held_twice(longer, ["m1", "m2"]).hint("merge"), ["m1", "m2"], "left_semi").select("rec", "place"))
    if nodes is None:
        return start.select("rec", F.col("lo").alias("longest"))
    best = checkpoint(nodes.groupBy("rec").agg(F.max("lo").alias("longest")))
    size = length
    while size > 1:
        size = -(-size // 2)
        seen = _looked_at(texts, nodes.filter("size > 1")).join(best.hint("merge"), "rec")
        asked = seen.groupBy("lo", "c1", "c2").agg(F.max(F.col("longest") == F.col("lo")).alias("asked")).filter("asked").select("lo", "c1", "c2")
        seen = checkpoint(seen.join(asked.hint("merge"), ["lo", "c1", "c2"], "left_semi").select("rec", "place", "lo", "size", "m1", "m2"))
        reach = seen.filter("m1 <> 0 or m2 <> 0")
        up = reach.join(_held_twice(reach, ["lo", "m1", "m2"]).hint("merge"), ["lo", "m1", "m2"], "left_semi")
        up = checkpoint(up.select("rec", "place", F.expr("lo + size div 2").cast("int").alias("lo"), F.expr("size - size div 2").cast("int").alias("size")))
        nodes = up.unionAll(seen.select("rec", "place", "lo", F.expr("size div 2").cast("int").alias("size")))
        best = checkpoint(best.unionAll(up.select("rec", F.col("lo").alias("longest"))).groupBy("rec").agg(F.max("longest").alias("longest")))
    return best.select("rec", F.col("longest").cast("long").alias("longest"))


def found(matches: DataFrame) -> DataFrame:
    return shared_spans(match_records(matches), 40)
