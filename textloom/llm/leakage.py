"""Problem 8: evaluation texts leaking into training text (spaced-seed hashing)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint, code_points, mix64, norm

#: Fixed masks: which of the characters of a window count. Any run of RUN characters holds a window of SPAN that begins
#: at a multiple of STEP, so one hit a mask is certain for every exact run; with a substitution at a blind place of
#: a mask the hit stays.
RUN, SPAN, STEP = 25, 18, 8
MASKS = ("111011010011101111", "110111101001110111")
#: Item hashes that are sent to all executors at most (8 bytes each); above it they are joined by a shuffle.
BROADCAST_HASHES = 4_000_000
#: Rows of one hash in the documents from which it counts as hot.
HEAVY = 1_000_000
_BITS = 22


def seed_hashes(codes: np.ndarray, mask: int, step: int = 1) -> np.ndarray:
    """The hash of each window that begins at a multiple of `step`, over the places where the mask is 1."""
    n = len(codes) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(-(-n // step), np.uint64)
    mul = np.uint64(0x100000001B3 + 2 * mask)
    for i, bit in enumerate(MASKS[mask]):
        if bit == "1":
            h = h * mul + codes[i : i + n : step]
    return mix64(h ^ np.uint64(mask))


def covered(item: np.ndarray, doc: np.ndarray, diagonals: list[int], window: int = RUN, wrong: int = 3) -> tuple[int, int]:
    """Characters of `item` along the hit diagonals in windows that equal the document, and in windows with at most
    `wrong` substitutions. Every run of RUN characters or more has a hit on its diagonal, so the first count is exact.
    """
    exact, loose = np.zeros(len(item) + 1, np.int32), np.zeros(len(item) + 1, np.int32)
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        if hi - lo < window:
            continue
        bad = np.zeros(hi - lo + 1, np.int32)
        np.cumsum(item[lo:hi] != doc[lo + d : hi + d], out=bad[1:])
        gaps = bad[window:] - bad[:-window]
        for marks, most in ((exact, 0), (loose, wrong)):
            at = np.flatnonzero(gaps <= most)
            if len(at):
                marks[lo + at] += 1
                marks[lo + at + window] -= 1
    return int((np.cumsum(exact) > 0).sum()), int((np.cumsum(loose) > 0).sum())


class Index:
    """Item hashes: a bitmap in front of sorted arrays, and where each hash stands. It is sent whole; the bitmap is made
    where it arrives, once a worker process."""

    def __init__(self, items: list[tuple[int, str]]):
        self.codes = {k: code_points(v).astype(np.uint64) for k, v in items}
        keys, owner, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for k, codes in self.codes.items():
            for m in range(len(MASKS)):
                h = seed_hashes(codes, m)
                keys.append(h)
                owner.append(np.full(len(h), k, np.int64))
                place.append(np.arange(len(h), dtype=np.int32))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], np.concatenate(owner)[order], np.concatenate(place)[order]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "bitmap"}

    @cached_property
    def bitmap(self) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return bits

    def diagonals(self, codes: np.ndarray) -> dict[int, list[int]]:
        """For each item with a hit: places in the document less places in the item."""
        items, gaps = [], []
        for m in range(len(MASKS)):
            h = seed_hashes(codes, m, STEP)
            at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(at):
                continue
            h = h[at]
            lo = np.searchsorted(self.keys, h, "left")
            n = np.searchsorted(self.keys, h, "right") - lo
            total = int(n.sum())
            if total:
                j = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(total)
                items.append(self.owner[j])
                gaps.append(np.repeat(at * STEP, n) - self.place[j])
        out: dict[int, list[int]] = defaultdict(list)
        if items:
            for k, d in set(zip(np.concatenate(items).tolist(), np.concatenate(gaps).tolist())):
                out[k].append(d)
        return out


COLUMNS = "doc_id long, item_id long, item_chars long, exact_chars long, tolerant_chars long"


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                codes = code_points(norm(text)).astype(np.uint64)
                for k, d in index.diagonals(codes).items():
                    rows.append((doc_id, k, len(index.codes[k]), *covered(index.codes[k], codes, d)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return run


def _hashes(id_column: str, step: int):
    """(id, key, place): the seed hashes of a text; of a hash that a text holds several times each place counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys, at, n = [], [], [], 0
            for k, text in zip(batch[id_column], batch["text"]):
                codes = code_points(norm(text)).astype(np.uint64)
                h = [seed_hashes(codes, m, step) for m in range(len(MASKS))]
                at += [np.arange(len(x), dtype=np.int32) * step for x in h]
                keys += h
                ids.append(np.full(sum(map(len, h)), k, np.int64))
                n += len(ids[-1])
                if n > 200_000:
                    yield pd.DataFrame({id_column: np.concatenate(ids), "key": np.concatenate(keys).view(np.int64), "place": np.concatenate(at)})
                    ids, keys, at, n = [], [], [], 0
            if ids:
                yield pd.DataFrame({id_column: np.concatenate(ids), "key": np.concatenate(keys).view(np.int64), "place": np.concatenate(at)})

    return run


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of documents, so a document's text is settled once for all its items."""
    last, codes = None, np.empty(0, np.uint64)
    for batch in batches:
        rows = []
        for doc_id, item_id, text, item, diagonals in zip(*(batch[c] for c in ("doc_id", "item_id", "text", "item", "diagonals"))):
            if doc_id != last:
                last, codes = doc_id, code_points(norm(text)).astype(np.uint64)
            held = code_points(norm(item)).astype(np.uint64)
            rows.append((doc_id, item_id, len(held), *covered(held, codes, diagonals.tolist())))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def met(left: DataFrame, right: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, item_id, diagonals): hashes of documents (doc_id, key, place) joined with those of items on the key.

    Hashes that no item has are dropped first. A key that documents hold more than `heavy` times is hot: its rows are
    spread over as many salts as it takes, and the items' rows of it are repeated for each salt. Keys that are hot
    number rows / heavy at most.
    """
    docs = checkpoint(left.join(right.select("key").distinct().hint("merge"), "key", "left_semi"))
    # the salts a key needs, from a count that combines map-side; one for all but hot keys
    salts = docs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.ceil(F.col("n") / heavy).cast("int").alias("salts"))
    held = right.join(salts.hint("merge"), "key")
    cold = held.filter("salts = 1").select("key", "item_id", F.col("place").alias("at"))
    hot = held.filter("salts > 1").select("key", "item_id", F.col("place").alias("at"), "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    few = F.broadcast(salts.filter("salts > 1"))
    light = docs.join(few, "key", "left_anti").join(cold.hint("merge"), "key").select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("d"))
    spread = docs.join(few, "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    heavy_hits = spread.join(hot.drop("salts").hint("merge"), ["key", "salt"]).select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("d"))
    return light.unionAll(heavy_hits).groupBy("doc_id", "item_id").agg(F.collect_set("d").alias("diagonals"))


def overlaps(documents: DataFrame, items: DataFrame, broadcast_hashes: int = BROADCAST_HASHES, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, item_id, item_chars, exact_chars, tolerant_chars) for every document and item with a spaced-seed hit.

    exact_chars counts the item's characters in runs of 25 or more that stand in the document - whole, as every such
    run has a hit - and tolerant_chars those in windows around the hits with up to three substitutions in 25. The
    number of item hashes is counted first: up to `broadcast_hashes` they go to every executor and documents are
    read once, without a shuffle; beyond it hashes of both sides are joined by a shuffle (see `met`), and texts meet
    only where they share a hash. Both ways give the same rows. Null and short texts have no hits; ids are expected to
    be unique; null ids are left out.
    """
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    held = items.select("item_id", "text").filter("item_id is not null and text is not null")
    size = held.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size * len(MASKS) <= broadcast_hashes:
        index = Index([(r["item_id"], norm(r["text"])) for r in held.collect()])
        return docs.mapInPandas(_scan(documents.sparkSession.sparkContext.broadcast(index)), COLUMNS)
    left = docs.mapInPandas(_hashes("doc_id", STEP), "doc_id long, key long, place int")
    right = checkpoint(held.mapInPandas(_hashes("item_id", 1), "item_id long, key long, place int"))
    hits = met(left, right, heavy).join(held.withColumnRenamed("text", "item").hint("merge"), "item_id")
    return hits.join(docs.hint("merge"), "doc_id").mapInPandas(_pairs, COLUMNS)


def leaked(documents: DataFrame, items: DataFrame, share: float = 0.4) -> DataFrame:
    """(doc_id, item_id): at least `share` of the item stands in the document in runs of 25 characters or more."""
    hits = overlaps(documents, items)
    return hits.filter(F.col("exact_chars") >= F.lit(share) * F.col("item_chars")).filter("item_chars > 0").select("doc_id", "item_id")


def tolerant_report(documents: DataFrame, items: DataFrame, share: float = 0.4) -> DataFrame:
    """Per item: documents that hold it exactly, and those that hold it with substitutions allowed."""
    hits = overlaps(documents, items).filter("item_chars > 0")
    exact, loose = (F.count_if(F.col(c) >= F.lit(share) * F.col("item_chars")) for c in ("exact_chars", "tolerant_chars"))
    return hits.groupBy("item_id").agg(exact.alias("exact_docs"), loose.alias("tolerant_docs")).filter("tolerant_docs > 0")
