"""Problem 7: filling fixed-capacity containers (first-fit decreasing over a tournament tree, in randomised groups)."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint

CAPACITY = 2048
#: Items of a randomised group on average; more waste less, as the last containers of each group stay part full.
GROUP_ITEMS = 8192
_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def default_tokenizer() -> str:
    """The vocabulary file used where none is given: TEXTLOOM_TOKENIZER, else that of the installed vocabularies."""
    path = os.environ.get("TEXTLOOM_TOKENIZER")
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a .model, .tiktoken or .json vocabulary; kept per process."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda texts: [len(model.encode(t)) for t in texts]
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _counters[path] = lambda texts: [len(model.encode_ordinary(t)) for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            _counters[path] = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _counters[path]


class BinTree:
    """A tournament tree over the free space of containers: each node holds the most free space below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put an item in the first container with room; gives its number."""
        free, k = self.free, 1
        while k < self.leaves:
            k *= 2
            if free[k] < size:
                k += 1
        at, left = k - self.leaves, free[k] - size
        free[k] = left
        while k > 1:
            k //= 2
            left = max(free[2 * k], free[2 * k + 1])
            if free[k] == left:
                break
            free[k] = left
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item (none larger than the capacity): largest first, ties in the order given."""
    tree = BinTree(max(1, len(sizes)), capacity)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.place(sizes[i])
    return out


def token_sizes(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) by a public tokenizer; null and empty texts have 0."""
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = token_counter(path)
        for batch in batches:
            yield pd.Series(of([t or "" for t in batch]), dtype="int64")

    return documents.filter("doc_id is not null").select("doc_id", F.pandas_udf(count, "long")(F.coalesce("text", F.lit(""))).alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container) for every document of (doc_id, n_tokens).

    Only documents above the capacity are cut: into full containers and a rest that is packed like any other item.
    Pieces are spread over groups by a hash of their id, so groups hold about group_items pieces however ids, sources
    or lengths are skewed, and each group is packed alone by first-fit decreasing; full pieces need no search and are
    numbered after the rest. Containers are named `group-number`. Empty documents take a place of size 0. A repeated
    id is treated as one more document. Sizes are kept once, so texts are counted once.
    """
    sizes = checkpoint(sizes)
    several = F.expr(f"greatest(1, cast(ceil(n_tokens / {capacity}) as int))")
    pieces = sizes.agg(F.sum(several).alias("n")).first()["n"] or 0
    groups = max(1, round(pieces / group_items))
    items = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), several - 1)).alias("piece"))
    items = items.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))
    items = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "n_tokens"], kind="stable")
        full = (part["n_tokens"] == capacity).to_numpy()
        at = np.zeros(len(part), np.int64)
        at[~full] = first_fit_decreasing(part["n_tokens"][~full].tolist(), capacity)
        at[full] = np.arange(full.sum()) + (at[~full].max() + 1 if not full.all() else 0)
        return part.assign(container=[f"{g}-{k}" for g, k in zip(part["grp"], at)])[["doc_id", "piece", "first_token", "n_tokens", "container"]]

    return items.groupBy("grp").applyInPandas(fill, "doc_id long, piece int, first_token long, n_tokens long, container string")


def audit(documents: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, and how many of them are lost, have a gap between their pieces or were cut without need, and
    how many containers hold too much. All but the first should be 0."""
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("used")).filter(F.col("used") > capacity).agg(F.count(F.lit(1)).alias("overfull"))
    own = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    all_ids = documents.select("doc_id").filter("doc_id is not null").distinct()
    both = all_ids.join(own.hint("merge"), "doc_id", "left")
    gaps = F.coalesce(F.col("end") != F.col("n"), F.lit(False))
    needless = F.coalesce((F.col("pieces") > 1) & (F.col("n") <= capacity), F.lit(False))
    docs = both.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n").isNull()).alias("lost"), F.count_if(gaps).alias("gaps"), F.count_if(needless).alias("needless_cuts"))
    return docs.crossJoin(over)  # one row and one row


def waste(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, containers, tokens and the share of the containers' space that is unused."""
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    total = used.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    return total.withColumn("unused_share", 1 - F.try_divide(F.col("tokens").cast("double"), F.col("containers") * F.lit(capacity)))
