"""Problem 9: abusive, hateful or sexual content (noisy-channel deobfuscation, then a score fitted on labels)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.channel import BREAK, CharModel, count_grams, gram_counts, restore
from textloom.llm.common import checkpoint, code_points, mix64

#: Labels up to which they are broadcast to find the labelled documents.
LABELLED_IDS = 2_000_000
THRESHOLD = 0.5
KINDS = ("insult", "threat", "hate", "sexual")

# General word lists, not taken from any text: (kind, words one of which must stand in the text, pattern).
# Patterns name words and who they are said of, and leave out senses of trades.
STRONG = [
    ("insult", "白痴 狗东西 猪脑子 王八蛋 蠢货 混账 傻逼 脑残 畜生 贱人 智障 杂种 狗娘养 蠢猪", r"白痴|狗东西|猪脑子|王八蛋|蠢货|混账|傻逼|脑残|畜生|贱人|智障|(?<!交)杂种(?!植)|狗娘养|蠢猪"),
    ("insult", "人渣 饭桶 败类", r"(?<!商)人渣(?!土)|饭桶(?!盖|架)|败类"),
    ("insult", "废物", r"(?<!危险)(?<!固体)(?<!医疗)(?<!工业)(?<!建筑)废物(?!的?分类|处置|处理|贮存|利用|堆|回收|管理|台账)"),
    ("insult", "操你 草你妈 肏你 狗日的 王八羔子 龟孙子 婊子 贱货 贱种 窝囊废 狗杂种 傻屌 傻叉 煞笔 死全家 去你妈 你妈逼", r"(?<![体早课做])操你(?!的?手|们?的?作)|草你妈|肏你|狗日的|王八羔子|龟孙子|婊子|贱货|贱种|窝囊废|狗杂种|傻屌|傻叉|煞笔|死全家|去你妈|你妈逼"),
    ("insult", "他妈的 白眼狼 垃圾东西", r"(?<!和)(?<!跟)他妈的(?!身份|手机|电话|名字|工作|病|单位|签字)|白眼狼|(?:你|他|她|群|帮|个|种)(?:们|这|就是|真是|些)*垃圾东西"),
    ("threat", "去死 打断 弄死 砍死 打死 杀了 宰了 全家 一把火", r"(?:趁早|赶紧|快|给我|都|你)去死|打断(?:你|他|她|您)们?的?(?:狗)?腿|(?:弄|砍|打)死(?:你|他)|(?:杀|宰)了(?:你|他)|(?:收拾|弄死|杀|砍)(?:你|他)们?全家|一把火烧(?:了|掉)(?:你|他)"),
    ("hate", "劣等民族 劣等人种 低等民族", r"劣等民族|劣等人种|低等民族"),
    ("sexual", "裸聊 做爱 口交 自慰 奶子 约炮 肉棒 色情 性交 淫荡 骚货 荡妇 口爆 黄片", r"裸聊|(?<!叫)做爱(?!心|好|国|护)|口交(?!接|付|通|流|换|叉|代|货|底|易)|自慰|奶子|约炮|肉棒|色情(?:视频|写真)|性交(?!付|接|流|换|通)|淫荡|骚货|荡妇|口爆|黄片"),
    ("insult", "idiot moron cretin losers bastard imbecile dumbass asshole retards shithead", r"\b(?:idiots?|morons?|cretins?|losers|bastards?|imbeciles?|dumbass|assholes?|retards|shitheads?)\b"),
    ("insult", "scum", r"\bscum\b(?! ?-?(?:layer|board|baffle|trough|skim|removal|pipe|collect|blanket))"),
    ("insult", "brainless worthless useless pathetic", r"\bbrainless pigs?\b|\bworthless (?:scum|trash|pigs?)\b|\buseless trash\b|\bpathetic (?:losers|pigs|scum)\b|\byou(?:'re| are|r)? (?:all |lot (?:are )?)?(?:so |just |a |bunch of )?(?:pathetic|worthless|filthy)\b"),
    ("insult", "fuck bitch dickhead jackass douchebag dipshit wanker twats cunts sons of", r"\bfuck(?:\s+(?:you|off|them|him|her|all of you)\b|ers?\b|face\b)|\bmotherfuck\w+|\bfucking (?:\w+ ){0,2}(?:people|animals|clowns?|fools?|pigs?|liars?|thieves|trash|rats?)\b|\b(?:bitch(?:es)?|dickheads?|jackass(?:es)?|douchebags?|dipshits?|wankers?|twats|cunts)\b"),
    ("insult", "loser retard", r"\b(?:you|such an?|what an?|stupid|complete|fucking|bloody) (?:(?!who\b|the\b)[a-z]+ )?(?:losers?|retards?)\b(?! (?:the|an?|any|this|that|its?)\b)"),
    ("threat", "kill beat throat burn break knife gun axe", r"\b(?:will|going to|gonna|'ll) (?:fucking )?kill you\b|\bkill yoursel(?:f|ves)\b|\bbeat you up\b|\b(?:cut|slit) your throats?\b|\b(?:i|we)(?: am|'m| are|'re| will|'ll) .{1,60}\bwith a (?:knife|gun|axe)\b|\bburn your (?:house|home|office)\b|\bbreak (?:your|his|her|their) (?:legs?|neck|arms?|bones)\b"),
    ("hate", "vermin filthy subhuman inferior animals", r"\b(?:they|you|those [a-z]+|these [a-z]+|people) are (?:all )?(?:vermin|animals|subhuman)\b|\bfilthy breed\b|\bsubhumans?\b|\binferior race\b"),
    ("sexual", "porn", r"\bporn\b(?!-|ography| (?:detect|filter|block|scan))"),
    ("sexual", "naked nude sex xxx blow hand masturbat pussy dick", r"\bnaked pics\b|\bsex clips\b|\bxxx cams\b|\bdirty sex\b|\b(?:blow|hand)jobs?\b|\bmasturbat\w+|\bnude (?:pics|photos|girls|cams)\b|\bpussy\b|\bsuck my (?:dick|cock)\b"),
]
#: Listed words that have civil or technical senses too; they are some evidence.
WEAK = [("insult", "loser retard pathetic brainless worthless trash"), ("sexual", "horny tits nude naked xxx sex underwear 无码 全裸 扒光 脱光"), ("hate", "vermin filthy 牲口 下等货"), ("threat", "knife bleed 后果 见血")]
#: Words that forbid what they govern (see _ruled).
RULES = re.compile(r"禁止|不得(?:使用|发布|出现)|严禁|公约|侮辱性|must report|prohibit|forbid|not allowed|policy")
WORDS = sorted({w for _, words, _ in STRONG for w in words.split() if len(w) > 2 or not w.isascii()} | {w for _, words in WEAK for w in words.split()} | set("idiots morons cretins bastards imbeciles assholes shitheads pigs bitches fucking yourself subhumans legs arms bones throats clips pics".split()))
#: Prior weights (log odds) of what is found in a sentence, which the labels may correct.
BIAS, STRONG_WEIGHT, WEAK_WEIGHT = -4.0, 7.0, 1.2

_CLAUSE_END = re.compile(r"[。!?;\n\r]|\.(?=\s|$)")
#: After one of these the writer speaks to someone again, so a rule named before no longer governs.
_ADDRESS = re.compile(r"[,，—-]\s*(?:and |but )?(?:you\b|your\b|你|这帮|这群|那帮|那群)")
_QUOTES = dict(zip("“‘\"「『《'`", "”’\"」』》'`"))


def _ruled(plain: str, start: int, end: int) -> bool:
    """Whether a rule governs the passage: it stands before it in the clause, or anywhere in it if the passage is quoted."""
    low, high = max(0, start - 2000), min(len(plain), end + 2000)
    a = max((m.end() for m in _CLAUSE_END.finditer(plain, low, start)), default=low)
    m = _CLAUSE_END.search(plain, end, high)
    b = m.start() if m else high
    before = plain[a:start]
    for m in RULES.finditer(before):
        if not _ADDRESS.search(before, m.end()):
            return True
    opened = before[-1:]
    return opened in _QUOTES and plain[end : end + 1] in (_QUOTES[opened], ",", ".", "，") and bool(RULES.search(plain[a:b]))



# ---- features: n-grams of tokens (a Han character, a word of letters, a number), hashed

BITS, GRAMS = 20, 4
_PART = 1 << 19
_ENDS = code_points("。！？!?；;\n\r" + BREAK)


def token_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence, sentence_starts) of a restored text: hashed n-grams of up to GRAMS tokens inside sentences.

    A sentence ends with its mark or line; a full stop ends one before white space.
    """
    c = code_points(text)
    n = len(c)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
    space = (c == 32) | (c == 9) | (c == 0x3000) | (c == 0xA0)
    after = np.append(space[1:], True)
    end = np.isin(c, _ENDS) | (c == 46) & after
    sentence_at = np.concatenate([[0], np.cumsum(end)[:-1]])
    digit = (c >= 48) & (c <= 57)
    letter = (c >= 97) & (c <= 122) | (c >= 0xC0) & (c < 0x600) & (c != 0xD7) & (c != 0xF7)
    kind = np.where(letter, 1, np.where(digit, 2, np.where(space | end, 0, 3)))
    before = np.append(0, kind[:-1])
    start = (kind == 3) | (kind > 0) & (kind != before)
    first = np.flatnonzero(start)
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.append(0, np.flatnonzero(end) + 1)
    place = np.arange(n) - first[np.maximum(np.cumsum(start) - 1, 0)]
    value = mix64(np.where(digit, 48, c).astype(np.uint64) | (np.minimum(place, 255).astype(np.uint64) << np.uint64(32)))
    value[(kind == 0) | digit & ~start] = 0
    one = mix64(np.add.reduceat(value, first))
    sentence, h = sentence_at[first], one
    features, sentences = [], []
    for k in range(1, GRAMS + 1):
        if k > 1:
            if len(one) < k:
                break
            h = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[k - 1 :])
        inside = sentence[: len(h)] == sentence[k - 1 :]
        features.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
        sentences.append(sentence[: len(h)][inside])
    return np.concatenate(features), np.concatenate(sentences), np.append(0, np.flatnonzero(end) + 1)


#: The edge of a Latin word: a Han character or digit beside it is none of its letters.
_EDGE = "(?:(?<![a-z])(?=[a-z])|(?<=[a-z])(?![a-z]))"


class Lexicon:
    """Where listed words stand: an automaton finds texts that can hold any, patterns decide."""

    def __init__(self):
        self.auto = ahocorasick.Automaton()
        anchors: dict[str, set] = {}
        self.patterns = [(k, True, re.compile(p.replace(r"\b", _EDGE))) for k, _, p in STRONG]
        for i, (_, words, _) in enumerate(STRONG):
            for w in words.split():
                anchors.setdefault(w, set()).add(i)
        for kind, words in WEAK:
            for w in words.split():
                anchors.setdefault(w, set()).add(len(self.patterns))
                self.patterns.append((kind, False, re.compile(f"{_EDGE}{w}{_EDGE}" if w.isascii() else w)))
        for w, at in anchors.items():
            self.auto.add_word(w, tuple(at))
        self.auto.make_automaton()

    def hits(self, text: str, starts: np.ndarray) -> list[tuple[int, str, bool]]:
        """(sentence, kind, strong) for texts cut into sentences; insults and sexual words that a rule governs don't count."""
        asked: dict[int, set] = {}
        for end, at in self.auto.iter(text):
            asked.setdefault(int(np.searchsorted(starts, end, "right")) - 1, set()).update(at)
        out = []
        for s, at in asked.items():
            a, b = int(starts[s]), int(starts[s + 1]) if s + 1 < len(starts) else len(text)
            for i in sorted(at):
                kind, strong, pattern = self.patterns[i]
                for m in pattern.finditer(text, a, b):
                    if kind in ("insult", "sexual") and _ruled(text, m.start(), m.end()):
                        continue
                    out.append((s, kind, strong))
        return out


class Scorer:
    """Restores texts and scores their sentences: log odds from token n-grams and listed words, fitted on labels."""

    def __init__(self, model: CharModel):
        self.model, self.memory, self.lexicon = model, {}, Lexicon()
        self.weights = np.zeros(1 << BITS, np.float32)
        self.kinds = np.zeros((len(KINDS), 1 << BITS), np.float32)
        self.bias, self.strong, self.weak = BIAS, STRONG_WEIGHT, WEAK_WEIGHT

    def __getstate__(self) -> dict:
        # only what is not 0 is sent
        at = np.flatnonzero(self.weights)
        rest = {k: v for k, v in self.__dict__.items() if k not in ("weights", "kinds", "lexicon", "memory")}
        return rest | {"at": at, "w": self.weights[at], "k": self.kinds[:, at]}

    def __setstate__(self, state: dict) -> None:
        at, w, k = state.pop("at"), state.pop("w"), state.pop("k")
        self.__dict__.update(state)
        self.memory, self.lexicon = {}, Lexicon()
        self.weights, self.kinds = np.zeros(1 << BITS, np.float32), np.zeros((len(KINDS), 1 << BITS), np.float32)
        self.weights[at], self.kinds[:, at] = w, k

    def plain(self, texts: list[str]) -> str:
        return restore(texts, self.model, self.memory)[0]

    def listed(self, plain: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
        """(strong, weak) by sentence - whether and how much - and the kind of a sentence's first hit."""
        strong, weak, kinds = np.zeros(len(starts)), np.zeros(len(starts)), {}
        for s, kind, sure in self.lexicon.hits(plain, starts):
            (strong if sure else weak)[s] = 1 if sure else min(4, weak[s] + 1)
            kinds.setdefault(s, kind)
        return strong, weak, kinds

    def parts(self, plain: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(feature, sentence) of each n-gram of a restored text, (strong, weak) of each sentence."""
        feature, sentence, starts = token_grams(plain)
        return feature, sentence, *self.listed(plain, starts)[:2]

    def scores(self, texts: list[str | None]) -> list[tuple[float, str | None, int]]:
        """(score, kind, passages) of each text: the score of its worst sentence and how many reach the threshold."""
        out: list = [(0.0, None, 0)] * len(texts)
        part: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate([*texts, None]):
            if text:
                part.append((i, text))
                size += len(text)
            if part and (size > _PART or i == len(texts)):
                self._part(part, out)
                part, size = [], 0
        return out

    def _part(self, part: list[tuple[int, str]], out: list) -> None:
        plain = self.plain([t for _, t in part])
        feature, sentence, starts = token_grams(plain)
        odds = self.bias + np.bincount(sentence, self.weights[feature], len(starts))
        strong, weak, named = self.listed(plain, starts)
        odds += self.strong * strong + self.weak * weak
        breaks = np.flatnonzero(code_points(plain) == ord(BREAK)) + 1
        lo = np.searchsorted(starts, np.append(0, breaks))
        hi = np.append(lo[1:], len(starts))
        of = None
        for (i, _), a, b in zip(part, lo, hi):
            worst = a + int(np.argmax(odds[a:b]))
            p = 1 / (1 + np.exp(-float(odds[worst])))
            n = int((odds[a:b] >= 0).sum())
            kind = None
            if n:
                kind = named.get(worst)
                if kind is None:
                    of = np.argsort(sentence, kind="stable") if of is None else of
                    x = of[np.searchsorted(sentence[of], worst) : np.searchsorted(sentence[of], worst, "right")]
                    kind = KINDS[int(self.kinds[:, feature[x]].sum(axis=1).argmax())]
            out[i] = (round(p, 6), kind, n)


Sentence = tuple[bytes, float, float]  # sorted features that training uses, strong and weak hits


class Frequency:
    """How many flagged and clean documents hold each feature, and how many clean ones beside a listed word."""

    def __init__(self):
        self.df, self.against = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, np.int64)

    def add(self, bad: bool, feature: np.ndarray, sentence: np.ndarray, strong: np.ndarray) -> None:
        self.df[int(bad), np.unique(feature)] += 1
        if not bad:
            self.against[np.unique(feature[(strong > 0)[sentence]])] += 1


class Used:
    """The features that training uses: those that speak for abuse, and those that listed words stand beside in clean texts."""

    def __init__(self, ids: np.ndarray, clean: np.ndarray, bad: np.ndarray, against: np.ndarray, n_bad: int, n_clean: int):
        ratio = np.log((bad + 0.5) / (n_bad + 1)) - np.log((clean + 0.5) / (n_clean + 1))
        speaks_for = (bad >= 2) & (ratio > np.log(4))
        use = speaks_for | (against >= 3) & (bad == 0)
        self.ids, self.ratio, self.speaks_for = ids[use], ratio[use], speaks_for[use]

    def sentences(self, feature: np.ndarray, sentence: np.ndarray, strong: np.ndarray, weak: np.ndarray) -> list[Sentence]:
        at = np.searchsorted(self.ids, feature)
        kept = (at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == feature) if len(self.ids) else np.zeros(len(feature), bool)
        column, sentence = at[kept].astype(np.int32), sentence[kept]
        order = np.lexsort((column, sentence))
        column, ends = column[order], np.searchsorted(sentence[order], np.arange(len(strong) + 1))
        return [(column[x:y].tobytes(), float(s), float(w)) for x, y, s, w in zip(ends, ends[1:], strong, weak)]


def _trains(s: Sentence) -> bool:
    return bool(s[0]) or s[1] > 0


def train(scorer: Scorer, used: Used, bad: list[tuple[str | None, list[Sentence]]], clean: dict[Sentence, int], rounds: int = 3, steps: int = 150) -> Scorer:
    """Fits the scorer on (category, sentences) of flagged documents and the distinct sentences of clean ones with how
    often they stand; equal sentences pull alike, so one row each is the whole of them."""
    rows = [(*s, 1, d) for d, (_, sentences) in enumerate(bad) for s in sentences] + [(*s, n, len(bad)) for s, n in sorted(clean.items())]
    columns = [np.frombuffer(r[0], np.int32) for r in rows]
    feature = np.concatenate(columns or [np.empty(0, np.int32)])
    count, ids = len(rows), used.ids
    sentence = np.repeat(np.arange(count), [len(x) for x in columns])
    strong, weak, times = (np.array([r[k] for r in rows], float) for k in (1, 2, 3))
    doc = np.array([r[4] for r in rows])
    del rows, columns
    flagged = doc < len(bad)
    base = scorer.strong * strong + scorer.weak * weak
    odds = BIAS + base
    rare = np.bincount(sentence, np.maximum(used.ratio[feature], 0), count)
    chosen = flagged & (odds > 0)
    w, bias, doubt = np.zeros(len(ids)), BIAS, np.ones(count)
    low, high = np.where(used.speaks_for, 0, -np.inf), np.where(used.speaks_for, np.inf, 0)
    for turn in range(rounds):
        covered = np.bincount(doc[chosen], minlength=len(bad) + 1) > 0
        left = flagged & ~covered[doc]
        best = rare if turn == 0 else odds
        # the best sentence of a flagged document that has none yet, if it stands out at all
        order = np.lexsort((best, doc))
        last = order[np.append(doc[order][1:] != doc[order][:-1], True)]
        last = last[left[last] & (best[last] > (8.0 if turn == 0 else -1.5))]
        chosen[last] = True
        train = np.flatnonzero(chosen | ~flagged)
        y, row = chosen[train].astype(float), np.full(count, -1)
        row[train] = np.arange(len(train))
        at = row[sentence] >= 0
        i, j = row[sentence[at]], feature[at]
        w, bias = np.zeros(len(ids)), BIAS
        g2, g2b = np.full(len(ids), 1e-3), 1e-3
        pull = (doubt * times)[train]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(bias + base[train] + np.bincount(i, w[j], len(train)))))
            error = (p - y) * pull
            g = np.bincount(j, error[i], len(ids)) + 0.05 * w
            gb = error.sum() + 5.0 * (bias - BIAS)
            g2, g2b = g2 + g * g, g2b + gb * gb
            w, bias = np.clip(w - 0.3 * g / np.sqrt(g2), low, high), bias - 0.3 * gb / np.sqrt(g2b)
        odds = bias + base + np.bincount(sentence, w[feature], count)
        chosen = flagged & (odds > 0)
        doubt = np.where(~flagged & (odds > 1), 0.1, 1.0)  # some labels are wrong
    scorer.weights[ids], scorer.bias = w, float(bias)
    kind_of = np.array([KINDS.index(c) if c in KINDS else -1 for c, _ in bad] + [-1])[doc]
    for k in range(len(KINDS)):
        n = np.bincount(feature[(chosen & (kind_of == k))[sentence]], minlength=len(ids))
        scorer.kinds[k, ids] = np.log((n + 0.2) / (n.sum() + 0.2 * len(ids)))
    return scorer


def fit(rows: list[tuple[str, int, str | None]], rounds: int = 3, steps: int = 150) -> Scorer:
    """The models, from (text, toxic, category) in memory; `fit_tables` makes the same ones from tables. Only documents are
    labelled, so sentences are found out in turns.

    The character model learns all texts. Then: sentences with a listed word, else the one whose n-grams are rarest among
    clean texts, stand for a flagged document; a logistic regression is fitted on them against the sentences of clean
    documents; the sentences are chosen again by its score, and clean ones that look bad count for less. Flagged rows
    without a category count as mistaken. Weights
    are drawn to their priors, so few labels or none leave the listed words to decide.
    """
    scorer = Scorer(CharModel([t for t, _, _ in rows], WORDS))
    rows = [r for r in rows if not r[1] or r[2]]
    if not any(r[1] for r in rows) or all(r[1] for r in rows):
        return scorer
    parts, frequency = [scorer.parts(scorer.plain([text])) for text, _, _ in rows], Frequency()
    for (_, toxic, _), (feature, sentence, strong, _) in zip(rows, parts):
        frequency.add(bool(toxic), feature, sentence, strong)
    n_bad = sum(bool(r[1]) for r in rows)
    used = Used(np.arange(1 << BITS), *frequency.df, frequency.against, n_bad, len(rows) - n_bad)
    found = [used.sentences(*p) for p in parts]
    bad = [(r[2], x) for r, x in zip(rows, found) if r[1]]
    clean = Counter(s for r, x in zip(rows, found) if not r[1] for s in x if _trains(s))
    return train(scorer, used, bad, clean, rounds, steps)


def labelled(documents: DataFrame, labels: DataFrame, broadcast_ids: int = LABELLED_IDS) -> DataFrame:
    """(doc_id, text, toxic, category) of every labelled document that has a text; a repeated label counts once.

    The labels are counted: up to `broadcast_ids` they are broadcast, beyond it texts are shuffled.
    """
    once = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.max("category").alias("category")).filter("toxic in (0, 1)")
    few = labels.count() <= broadcast_ids
    return documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(once) if few else once.hint("merge"), "doc_id")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the counts of the character model: kind g (gram) or w (word)."""

    def rows(grams: Counter, words: Counter) -> pa.RecordBatch:
        return _batch([pa.string(), pa.string(), pa.int64()], kind=["g"] * len(grams) + ["w"] * len(words), value=[*grams, *words], n=[*grams.values(), *words.values()])

    grams, words = Counter(), Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            for mine, more in zip((grams, words), gram_counts([text], WORDS)):
                mine.update(more)
            if len(grams) > 200_000:
                yield rows(grams, words)
                grams, words = Counter(), Counter()
    yield rows(grams, words)


def fit_tables(documents: DataFrame, labels: DataFrame) -> Scorer:
    """The models of `fit` from all labelled documents, none left out; no text comes to the driver.

    Counts are made a partition at a time and summed up. What comes to the driver: grams (of three characters those seen
    twice or more), used features, the used sentences of flagged documents, and the distinct ones of clean documents.
    """
    context = documents.sparkSession.sparkContext
    texts = checkpoint(labelled(documents, labels))
    listed: Counter = Counter()
    for word in WORDS:
        count_grams(f" {word} ", 1, listed)
    counted = texts.select("text").mapInArrow(_counts, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    kept = F.when(F.col("kind") == "w", F.col("n") >= 5).otherwise((F.length("value") < 3) | (F.col("n") > 1) | F.col("value").isin(list(listed)))
    counts = (Counter(), Counter())
    for kind, value, n in _rows(counted.filter(kept)):
        counts[kind == "w"][value] = n
    scorer = Scorer(CharModel([], WORDS, counts=counts))
    sizes = {r["toxic"]: r["n"] for r in texts.filter("toxic = 0 or category <> ''").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return scorer
    shared = context.broadcast(scorer)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([shared.value.plain([t]) for t in batch["text"].to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)
        # workers are used again: what was remembered here would stay beside what the final models remember
        shared.value.memory.clear()
        shared.value.model.known.clear()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = Frequency()
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                feature, sentence, strong, _ = shared.value.parts(text)
                frequency.add(bool(toxic), feature, sentence, strong)
        at = np.flatnonzero(frequency.df.sum(axis=0))
        yield _batch([pa.int64()] * 4, feature=at, clean=frequency.df[0, at], bad=frequency.df[1, at], against=frequency.against[at])

    plain_texts = checkpoint(texts.filter("toxic = 0 or category <> ''").mapInArrow(plain, texts.schema))
    total = plain_texts.mapInArrow(frequencies, "feature long, clean long, bad long, against long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("clean", "bad", "against")))
    features = total.filter("bad >= 2 or against >= 3").toArrow().sort_by("feature")
    used = Used(*(features[c].to_numpy() for c in ("feature", "clean", "bad", "against")), sizes[1], sizes[0])
    use = context.broadcast(used)

    def flagged_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [use.value.sentences(*shared.value.parts(t)) for t in batch["text"].to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.float64())]
            yield _batch(kinds, doc_id=batch["doc_id"], category=batch["category"], features=[[s[0] for s in x] for x in found], hits=[[v for s in x for v in s[1:]] for x in found])

    def clean_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                found.update(s for s in use.value.sentences(*shared.value.parts(text)) if _trains(s))
        yield _batch([pa.binary(), pa.float64(), pa.float64(), pa.int64()], features=[s[0] for s in found], strong=[s[1] for s in found], weak=[s[2] for s in found], n=list(found.values()))

    bad = _rows(plain_texts.filter("toxic = 1").mapInArrow(flagged_ones, "doc_id long, category string, features array<binary>, hits array<double>"))
    clean = _rows(plain_texts.filter("toxic = 0").mapInArrow(clean_ones, "features binary, strong double, weak double, n long").groupBy("features", "strong", "weak").agg(F.sum("n").alias("n")))
    examples = [(category, list(zip(x, hits[::2], hits[1::2]))) for _, category, x, hits in sorted(bad, key=lambda r: (r[0], r[2]))]
    return train(scorer, used, examples, {(x, s, w): n for x, s, w, n in clean})


def _batch(kinds: list[pa.DataType], **columns) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(columns.values(), kinds)]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _rows(df: DataFrame) -> Iterator[tuple]:
    """The rows of a result that fits the driver, by way of Arrow."""
    for batch in df.toArrow().to_batches():
        yield from zip(*(c.to_pylist() for c in batch.columns))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, category, passages) for every document.

    Suspicious stretches of each text are decoded by the noisy channel, then its sentences are scored by the model that
    `fit_tables` makes of all labelled documents. score is that of the worst sentence, passages the number of sentences
    at the threshold. source is trimmed and lower case. Null and empty texts score 0; without labels the listed words
    decide. One pass over the documents to find the labelled ones, one to score all.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit_tables(documents, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = shared.value
        for batch in batches:
            got = scorer.scores(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "score": [g[0] for g in got], "category": [g[1] for g in got], "passages": [g[2] for g in got]})

    rows_in = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return rows_in.mapInPandas(run, "doc_id long, source string, score double, category string, passages int")


def flagged(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored(documents, labels).filter(F.col("score") >= threshold).select("doc_id").distinct()


def source_rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, flagged, rate): documents without a source form one row with a null source."""
    s = scored(documents, labels).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged"))
    return s.withColumn("rate", F.col("flagged") / F.col("documents"))
