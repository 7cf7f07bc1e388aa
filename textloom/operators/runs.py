"""Matching of runs that one task can hold: pairs, scores and exclusions as in `similarity`, but no posting and no pair
is shuffled, only each unit once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import pair_scorer
from textloom.operators.ngrams import LENGTH_FLOOR, SHARED_RATIO
from textloom.operators.similarity import EXCLUDE_LIMIT, exclusion

#: Characters of a run up to which one task holds it (about 50 bytes each); larger runs go through `similarity`.
RUN_CHARS = 8_000_000
#: Cells and expanded postings that are counted at once.
_CELLS = 1 << 21
#: Marks of n-grams that are set at once, and rows of matches that leave a task at once.
_MARKS, _BATCH = 1 << 25, 1 << 14
_SHOWN = ["unit_id", "group_name", "file_name", "location", "text"]


def _ranks(value: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each value among the distinct ones, and how many these are; `np.unique` takes twice the memory."""
    order = np.argsort(value)
    value = value[order]
    first = np.ones(len(value), bool)
    np.not_equal(value[1:], value[:-1], out=first[1:])
    rank = np.empty(len(value), np.int32)
    rank[order] = np.cumsum(first, dtype=np.int32) - 1
    return rank, int(first.sum())


def grams_of(forms: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(unit, gram, grams): the distinct n-grams of each form, sorted by unit, and how many grams there are at all.

    Grams are equal if their strings are, whatever the size they come from. As `functions.text.ngrams`: a form no longer
    than its size is its own only gram.
    """
    codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(f) for f in forms], np.int64)
    start = np.cumsum(length) - length
    size = np.minimum(np.maximum(sizes, 0), length)
    count = np.where(size == 0, 1, length - size + 1) * (length > 0)
    units, grams, base = [], [], 0
    for n in np.unique(size):
        at = np.flatnonzero((size == n) & (count > 0))
        if not len(at):
            continue
        c = count[at]
        place = np.repeat((start[at] - (np.cumsum(c) - c)).astype(np.int32), c) + np.arange(c.sum(), dtype=np.int32)
        value = codes[place].astype(np.int64) if n else np.zeros(len(place), np.int64)
        for k in range(1, n):
            if k > 2:  # a code point takes 21 bits; ranks make room for the next
                value = _ranks(value)[0].astype(np.int64)
            value <<= 21
            value |= codes[place + k]
        del place
        rank, known = _ranks(value)
        del value
        units.append(np.repeat(at.astype(np.int32), c))
        grams.append(rank + np.int32(base))
        base += known
    if not units:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    key = np.concatenate(units).astype(np.int64)
    key *= base
    key += np.concatenate(grams)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key // base).astype(np.int32), (key % base).astype(np.int32), base


def _expand(probe: np.ndarray, lo: np.ndarray, hi: np.ndarray, held: np.ndarray, a: int, b: int, width: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Counts of (probe - a) * width + held[lo:hi] for the entries of the probes a to b."""
    first, last = np.searchsorted(probe, [a, b])
    n = (hi - lo)[first:last]
    at = np.repeat(lo[first:last] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    cell = np.repeat((probe[first:last] - a) * width, n) + held[at]
    return np.bincount(cell, None if weight is None else np.repeat(weight[first:last], n), (b - a) * width).astype(np.int64)


def _counted(entries: list[tuple], left: int, right: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, shared, rank) a block of probes at a time: of each a the `top` (0: all) by shared, then b.

    entries: (probe, lo, hi, held, weight) with probe in order: each probe meets held[lo:hi] with that weight.
    """
    work = sum(np.bincount(probe, hi - lo, left) for probe, lo, hi, _, _ in entries)
    total = np.cumsum(work)
    a = 0
    while a < left:
        most = np.searchsorted(total, (total[a - 1] if a else 0) + _CELLS, "right")
        b = max(a + 1, min(left, a + max(1, _CELLS // right), int(most)))
        cells = sum(_expand(probe, lo, hi, held, a, b, right, weight) for probe, lo, hi, held, weight in entries)
        at = np.flatnonzero(cells)
        x, y, shared = at // right, at % right, cells[at]
        order = np.lexsort((y, -shared, x))
        x, y, shared = x[order], y[order], shared[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        if top:
            kept = rank < top
            x, y, shared, rank = x[kept], y[kept], shared[kept], rank[kept]
        yield x + a, y, shared, rank
        a = b


def _lists(unit: np.ndarray, gram: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(df, order, end): how many units hold each gram, the postings by gram, where each gram's list ends."""
    df = np.bincount(gram, minlength=grams)
    return df, np.argsort(gram, kind="stable").astype(np.int32), np.cumsum(df, dtype=np.int32)


def _near_pairs(form: np.ndarray, unit: np.ndarray, gram: np.ndarray, grams: int, sizes: np.ndarray, max_postings: int, top: int):
    """Blocks of pairs a < b of units in order that share n-grams or the form, as `ngrams.candidates` has them."""
    n = len(form)
    df, order, end = _lists(unit, gram, grams)
    held = unit[order]
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    use = (df >= 2) & ((df <= max_postings) if max_postings else True)
    use = use[gram]
    entries = [(unit[use], place[use] + 1, end[gram[use]], held, None)]
    count, by_form, form_end = _lists(np.arange(n), form, int(form.max()) + 1)
    at = np.empty(n, np.int64)
    at[by_form] = np.arange(n)
    last = form_end[form]
    entries.append((np.arange(n), at + 1, np.minimum(last, at + 1 + top) if top else last, by_form, np.maximum(sizes, 1)))
    return _counted(entries, n, n, top)


class _Common:
    """How many n-grams two units share: those counted, and those whose lists were too long to count."""

    def __init__(self, unit: np.ndarray, gram: np.ndarray, dropped: np.ndarray):
        at = dropped[gram]
        self.unit, self.gram = unit[at], gram[at]
        self.grams = len(dropped)
        self.key = self.unit.astype(np.int64) * self.grams + self.gram  # in order, as units and their grams are

    def more(self, a: np.ndarray, b: np.ndarray, other: _Common | None = None) -> np.ndarray:
        known = (other or self).key
        out = np.zeros(len(a), np.int64)
        if not len(self.key) or not len(known):
            return out
        lo = np.searchsorted(self.unit, a)
        n = np.searchsorted(self.unit, a, "right") - lo
        total = np.cumsum(n)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _CELLS, "right")))
            c = n[i:j]
            at = np.repeat(lo[i:j] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            key = np.repeat(b[i:j].astype(np.int64) * self.grams, c) + self.gram[at]
            hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            out[i:j] = np.bincount(np.repeat(np.arange(j - i), c)[hit], minlength=j - i)
            i = j
        return out


def _scored(score: Callable, left: list[str], right: list[str], a: np.ndarray, b: np.ndarray, both: np.ndarray, na: np.ndarray, nb: np.ndarray, t: np.ndarray) -> np.ndarray:
    """As `similarity.score_pairs`: 1 for twins, -1 where a bound rules the threshold out."""
    la, lb = np.array([len(left[i]) for i in a.tolist()], np.int64), np.array([len(right[i]) for i in b.tolist()], np.int64)
    j = both / (na + nb - both)
    bound = 0.62 * (2.0 * np.minimum(la, lb) / (la + lb)) + 0.38 * j
    out = np.full(len(a), -1.0)
    for i in np.lexsort((a, b)).tolist():
        x, y = left[a[i]], right[b[i]]
        if x == y:
            out[i] = 1.0
        elif bound[i] >= t[i] - 1e-9:
            out[i] = score(x, y, float(j[i]), float(t[i]))
    return out


def _best_templates(score, forms, limits, grams, templates: dict, max_postings: int, limit: int = EXCLUDE_LIMIT) -> tuple[list, list]:
    """(template file, score) of each of the forms, as `similarity.best_excludes`; nulls where none counts."""
    of, names, at = templates["normalized"], templates["file_name"], {}
    for k in range(len(of) - 1, -1, -1):
        at[of[k]] = k
    files: list = [names[at[f]] if f in at else None for f in forms]
    best: list = [1.0 if f in at else None for f in forms]
    rest = [i for i, f in enumerate(forms) if f not in at]
    if not rest or not of:
        return files, best
    asked = [forms[i] for i in rest]
    unit, gram, n = grams_of(asked + of, np.concatenate([grams[rest], templates["ngram_size"]]))
    size = np.bincount(unit, minlength=len(asked) + len(of))
    theirs = unit >= len(asked)
    t_unit, t_gram = unit[theirs] - len(asked), gram[theirs]
    unit, gram = unit[~theirs], gram[~theirs]
    df, order, end = _lists(t_unit, t_gram, n)
    dropped = (df > max_postings) if max_postings else np.zeros(n, bool)
    use = ~dropped[gram] & (df[gram] > 0)
    mine, more = _Common(unit, gram, dropped), _Common(t_unit, t_gram, dropped)
    found: dict[int, tuple] = {}
    la, lb = np.array([len(f) for f in asked]), np.array([len(f) for f in of])
    for a, b, shared, rank in _counted([(unit[use], (end - df)[gram[use]], end[gram[use]], t_unit[order], None)], len(asked), len(of), limit):
        kept = np.minimum(la[a], lb[b]) / np.maximum(la[a], lb[b]) >= LENGTH_FLOOR
        a, b, shared, rank = a[kept], b[kept], shared[kept], rank[kept]
        t = limits[rest][a]
        got = _scored(score, asked, of, a, b, shared + mine.more(a, b, more), size[a], size[len(asked) + b], t)
        for i in np.flatnonzero(got >= t).tolist():
            one = (got[i], -int(rank[i]), names[b[i]])
            if a[i] not in found or one[:2] > found[a[i]][:2]:
                found[a[i]] = one
    for a, (s, _, name) in found.items():
        files[rest[a]], best[rest[a]] = name, float(s)
    return files, best


def _parts(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges i:j of entries that come to _CELLS together at most, one at least."""
    total = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _CELLS, "right")))
        yield i, j
        i = j


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each entry, n of them."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _first(value: np.ndarray) -> np.ndarray:
    """Whether each value, of values in order, is the first of its like."""
    new = np.ones(len(value), bool)
    np.not_equal(value[1:], value[:-1], out=new[1:])
    return new


def _both(start: np.ndarray, n: np.ndarray, gram: np.ndarray, grams: int, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How many of their grams, gram[start:start + n], the forms f and g share; f in order."""
    out = np.zeros(len(f), np.int64)
    if not len(f) or not grams:
        return out
    new = _first(f)
    row, asked = np.cumsum(new) - 1, f[new]
    rows = max(1, min(len(asked), _MARKS // grams))
    marks = np.zeros(rows * grams, bool)
    for r in range(0, len(asked), rows):
        some = asked[r : r + rows]
        held = np.repeat(np.arange(len(some)) * grams, n[some]) + gram[_spread(start[some], n[some])]
        marks[held] = True
        first, last = np.searchsorted(row, [r, r + rows])
        for i, j in _parts(n[g[first:last]]):
            at = slice(first + i, first + j)
            c = n[g[at]]
            hits = np.append(0, np.cumsum(marks[np.repeat((row[at] - r) * grams, c) + gram[_spread(start[g[at]], c)]]))
            end = np.cumsum(c)
            out[at] = hits[end] - hits[end - c]
        marks[held] = False
    return out


def _all_pairs(score: Callable, forms: list[str], k: np.ndarray, group: np.ndarray, limit: np.ndarray, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (a, b, shared, similarity) of all matches a < b, whatever number of units hold an n-gram or match a unit.

    Equal forms (of one size of n-grams) are looked up once. A pair that reaches the lowest limit has a Jaccard of
    (limit - 0.62) / 0.38 or more, so it shares at least that part of the grams of either side, and two; then the rarest
    grams of either side, all but that many less one, have one in common. Only these meet, and each pair that does is
    counted in full. With `part`, of which equal forms have one, only pairs of different parts count.
    """
    ids: dict[tuple[str, int], int] = {}
    kind = np.array([ids.setdefault(x, len(ids)) for x in zip(forms, k.tolist())])
    texts, m = [f for f, _ in ids], len(ids)
    same: dict[str, int] = {}
    text = np.array([same.setdefault(f, len(same)) for f in texts])
    length = np.array([len(f) for f in texts])
    unit, gram, grams = grams_of(texts, np.array([n for _, n in ids]))
    size = np.bincount(unit, minlength=m)
    df = np.bincount(gram, minlength=grams)
    rank = np.empty(grams, np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(grams, dtype=np.int32)
    single = int((df < 2).sum())
    grams -= single
    kept = df[gram] >= 2
    key = unit[kept].astype(np.int64) * grams + (rank[gram[kept]] - single)
    key.sort()
    unit, gram = (key // grams).astype(np.int32) if grams else unit[:0], (key % grams).astype(np.int32) if grams else gram[:0]
    del key, kept, df, rank
    n = np.bincount(unit, minlength=m)
    start = np.cumsum(n) - n
    count = np.bincount(kind, minlength=m)
    member = np.argsort(kind, kind="stable")
    first = np.cumsum(count) - count
    lowest = float(limit.min())

    def both(f: np.ndarray, g: np.ndarray) -> np.ndarray:
        return _both(start, n, gram, grams, f, g)

    # twins: one form, whatever the size of its n-grams
    form = text[kind]
    by_form = np.argsort(form, kind="stable")
    place = np.empty(len(form), np.int64)
    place[by_form] = np.arange(len(form))
    after = np.cumsum(np.bincount(form))[form] - place - 1
    for i, j in _parts(after) if part is None else ():
        a, b = np.repeat(np.arange(i, j), after[i:j]), by_form[_spread(place[i:j] + 1, after[i:j])]
        ok = (group[a] != group[b]) & (limit[a] <= 1.0)
        a, b = a[ok], b[ok]
        x, y = kind[a], kind[b]
        shared = size[x].copy()
        mixed = np.flatnonzero(x != y)
        if len(mixed):
            pair, of = np.unique(x[mixed] * m + y[mixed], return_inverse=True)
            shared[mixed] = both(pair // m, pair % m)[of]
        shared += np.maximum(size[x], 1)
        ok = shared >= np.maximum(2, np.floor(np.minimum(size[x], size[y]) * SHARED_RATIO))
        yield a[ok], b[ok], shared[ok], np.ones(int(ok.sum()))

    # all others
    need = np.maximum(2, np.ceil(size * ((lowest - 1e-9 - 0.62) / 0.38) - 1e-6)).astype(np.int64)
    ahead = np.clip(n - need + 1, 0, n)  # size - need + 1 with the grams of one form only, which come first and meet nothing
    probe = np.repeat(np.arange(m), ahead)
    rare = gram[_spread(start, ahead)]
    _, order, end = _lists(probe, rare, grams)
    held = probe[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    after = end[rare] - place - 1
    work = np.bincount(probe, after, m).astype(np.int64)
    bounds, codes = np.unique(limit, return_inverse=True)
    for i, j in _parts(work):
        p, q = np.searchsorted(probe, [i, j])
        key = np.repeat(probe[p:q] * m, after[p:q]) + held[_spread(place[p:q] + 1, after[p:q])]
        key.sort()
        key = key[_first(key)]
        f, g = key // m, key % m
        ratio = np.minimum(length[f], length[g]) / np.maximum(length[f], length[g])
        alike = 0.62 * (2.0 * np.minimum(length[f], length[g]) / (length[f] + length[g]))
        apart = text[f] != text[g] if part is None else part[member[first[f]]] != part[member[first[g]]]
        ok = apart & (ratio >= LENGTH_FLOOR) & (alike + 0.38 * np.minimum(size[f], size[g]) / np.maximum(size[f], size[g]) >= lowest - 2e-9)
        f, g, alike = f[ok], g[ok], alike[ok]
        c = both(f, g)
        ok = (c >= np.maximum(2, np.floor(np.minimum(size[f], size[g]) * SHARED_RATIO))) & (alike + 0.38 * (c / (size[f] + size[g] - c)) >= lowest - 2e-9)
        f, g, c = f[ok], g[ok], c[ok]
        for i2, j2 in _parts(count[f]):
            of = np.repeat(np.arange(i2, j2), count[f[i2:j2]])
            one = member[_spread(first[f[i2:j2]], count[f[i2:j2]])]
            others = count[g[of]]
            for i3, j3 in _parts(others):
                x, y = np.repeat(one[i3:j3], others[i3:j3]), member[_spread(first[g[of[i3:j3]]], others[i3:j3])]
                shared = np.repeat(c[of[i3:j3]], others[i3:j3])
                ok = group[x] != group[y]
                x, y, shared = x[ok], y[ok], shared[ok]
                a, b = np.minimum(x, y), np.maximum(x, y)
                pair, at, back = np.unique((kind[a] * m + kind[b]) * len(bounds) + codes[a], return_index=True, return_inverse=True)
                left, right = kind[a[at]], kind[b[at]]
                s = _scored(score, texts, texts, left, right, shared[at], size[left], size[right], limit[a[at]])[back]
                ok = s >= limit[a]
                yield a[ok], b[ok], shared[ok], s[ok]


def _bounded_pairs(score: Callable, forms: list[str], k: np.ndarray, group: np.ndarray, limit: np.ndarray, max_postings: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As `_all_pairs`, without what the bounds of `ngrams.candidates` leave out."""
    ids: dict[str, int] = {}
    form = np.array([ids.setdefault(f, len(ids)) for f in forms])
    unit, gram, n = grams_of(forms, k)
    size, length = np.bincount(unit, minlength=len(forms)), np.array([len(f) for f in forms])
    df = np.bincount(gram, minlength=n)
    more = _Common(unit, gram, df > (max_postings or len(forms)))
    for a, b, shared, _ in _near_pairs(form, unit, gram, n, size, max_postings, top):
        least = np.maximum(2, np.floor(np.minimum(size[a], size[b]) * SHARED_RATIO))
        ratio = np.minimum(length[a], length[b]) / np.maximum(length[a], length[b])
        kept = (group[a] != group[b]) & (ratio >= LENGTH_FLOOR) & (shared >= least)
        a, b, shared = a[kept], b[kept], shared[kept]
        twins = form[a] == form[b]
        both = np.where(twins, size[a], shared + more.more(a, b))
        s = _scored(score, forms, forms, a, b, both, size[a], size[b], limit[a])
        kept = s >= limit[a]
        yield a[kept], b[kept], shared[kept], s[kept]


def _pairs(own: pa.Table, forms: list[str], max_postings: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    if len(forms) > 1:
        of = (pair_scorer(), forms, *(own[c].to_numpy() for c in ("ngram_size", "group_index", "threshold")))
        part = own["_part"].to_numpy() if "_part" in own.column_names else None
        yield from _bounded_pairs(*of, max_postings, top) if max_postings or top else _all_pairs(*of, part)


def _rows(own: pa.Table, keys: list[str], a: np.ndarray, b: np.ndarray, shared: np.ndarray, got: np.ndarray) -> dict:
    columns = {key: own[key].take(pa.array(a)) for key in keys}
    for s, at in (("a", a), ("b", b)):
        columns |= {f"{c}_{s}": own[c].take(pa.array(at)) for c in [*_SHOWN, "pos"]}
    return columns | {"shared": pa.array(shared, pa.int64()), "similarity": pa.array(got, pa.float64())}


def match_blocks(units: pa.Table, keys: list[str], max_postings: int = 0, top: int = 0) -> Iterator[pa.Table]:
    """All matches of one run, at most _BATCH rows at a time: their texts are not held together."""
    own = units.filter(pa.array(units["group_index"].to_numpy() >= 0)).sort_by("pos")
    for block in _pairs(own, own["normalized"].to_pylist(), max_postings, top):
        for i in range(0, len(block[0]), _BATCH):
            yield pa.table(_rows(own, keys, *(x[i : i + _BATCH] for x in block)))


def match_run(units: pa.Table, keys: list[str], exclude: bool, max_postings: int = 0, top: int = 0) -> pa.Table:
    """All matches of one run; with `exclude` also the best template of either side (_fa, _sa, _fb, _sb)."""
    units = units.sort_by("pos")
    group = units["group_index"].to_numpy()
    own, templates = units.filter(pa.array(group >= 0)), units.filter(pa.array(group < 0))
    forms = own["normalized"].to_pylist()
    none = np.empty(0, np.int64)
    a, b, shared, got = (np.concatenate(x) for x in zip((none, none, none, np.empty(0)), *_pairs(own, forms, max_postings, top)))
    columns = _rows(own, keys, a, b, shared, got)
    if exclude:
        needed = np.unique(np.concatenate([a, b]))
        of = {c: templates[c].to_pylist() for c in ("normalized", "file_name")} | {"ngram_size": templates["ngram_size"].to_numpy()}
        sizes, limits = own["ngram_size"].to_numpy()[needed], own["exclude_threshold"].to_numpy()[needed]
        files, best = _best_templates(pair_scorer(), [forms[i] for i in needed.tolist()], limits, sizes, of, max_postings)
        files, best = pa.array(files, pa.string()), pa.array(best, pa.float64())
        for s, at in (("a", a), ("b", b)):
            at = np.searchsorted(needed, at)
            columns |= {f"_f{s}": files.take(pa.array(at)), f"_s{s}": best.take(pa.array(at))}
    return pa.table(columns)


def _schema(units: DataFrame, keys: list[str]) -> list[str]:
    kind = dict(units.dtypes)
    shown = [f"{c}_{s} {kind[c]}" for s in "ab" for c in [*_SHOWN, "pos"]]
    return [*(f"{k} {kind[k]}" for k in keys), *shown, "shared long", "similarity double"]


def _able(units: DataFrame, keys: list[str]) -> DataFrame:
    able = units.filter("comparable and normalized <> '' and group_index is not null").filter(" and ".join(f"{k} is not null" for k in keys))
    return able.select(*keys, "group_index", *_SHOWN, "pos", "normalized", "ngram_size", "threshold", "exclude_threshold")


def matches_in_runs(units: DataFrame, keys: list[str], exclude: bool = False, max_postings: int = 0, top: int = 0) -> DataFrame:
    """`similarity.text_matches` over the units with group_index >= 0, a run (`keys`) a task; with `exclude` also excluded
    and exclude_reason, from the units with group_index < 0.

    units: as there, with ngram_size, threshold and exclude_threshold in place of ngrams.
    """
    schema = ", ".join([*_schema(units, keys), *(["_fa string", "_sa double", "_fb string", "_sb double"] if exclude else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        for block in [match_run(table, keys, True, max_postings, top)] if exclude else match_blocks(table, keys, max_postings, top):
            yield from block.to_batches()

    found = _able(units, keys).groupBy(*keys).applyInArrow(run, schema)
    return exclusion(found) if exclude else found


def matches_in_parts(units: DataFrame, keys: list[str], parts) -> DataFrame:
    """All `similarity.text_matches` of runs that one task can't hold.

    The forms of a run are cut into `parts` (a column: how many) by hash; each two parts, and each by itself, are a task,
    so a text is shuffled as often as its run has parts, and still no posting and no pair is.
    """
    own = _able(units, keys).filter("group_index >= 0").withColumn("_n", parts)
    own = own.withColumn("_part", F.pmod(F.xxhash64("normalized"), "_n")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)))
    own = own.withColumns({"_lo": F.least("_part", "_other"), "_hi": F.greatest("_part", "_other")}).drop("_n", "_other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        alone = table["_lo"][0] == table["_hi"][0]
        for block in match_blocks(table.drop_columns(["_part"]) if alone else table, keys):
            yield from block.to_batches()

    return own.groupBy(*keys, "_lo", "_hi").applyInArrow(run, ", ".join(_schema(units, keys)))


def large_runs(units: DataFrame, keys: list[str], chars: int = RUN_CHARS) -> DataFrame:
    """The keys of runs over the bound, and their characters; their number is bounded by the size of the table."""
    return units.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.sum(F.length("text")).alias("n")).filter(F.col("n") > chars).select(*keys, "n")
