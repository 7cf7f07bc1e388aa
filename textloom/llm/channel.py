"""The noisy channel of problem 9: how words are hidden in text, and the likeliest text behind what is seen."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np

from textloom.llm.lookalike import _TABLE, _TO_LATIN

# What a character may stand for when someone hides a word.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "8": "b", "9": "g", "€": "e", "£": "l"}
SOUND = dict(zip("旦吃春费肺犯筒帐魂鱼驴亻仁扎鸡", "蛋痴蠢废废饭桶账混愚驴人人渣鸡"))
SOUND.update({"朿": "东", "狙": "猪", "珠": "猪", "勾": "狗", "苟": "狗", "胶": "交", "聊": "聊", "卫": "慰", "奈": "奶", "情": "情", "拜": "败"})
TRADITIONAL = dict(zip("癡飯貨廢豬腦東賬敗類無恥視頻寫與畫愛這個們斷燒見別級開裏體屍雜種賤", "痴饭货废猪脑东账败类无耻视频写与画爱这个们断烧见别级开里体尸杂种贱"))
PINYIN = {}
for _k, _v in zip("bai chi ren zha gou dong xi zhu nao zi wang ba dan fei wu fan tong wu chi bai lei chun huo hun zhang se qing luo liao zuo ai kou jiao zi wei nai".split(), "白痴人渣狗东西猪脑子王八蛋废物饭桶无耻败类蠢货混账色情裸聊做爱口交自慰奶"):
    PINYIN.setdefault(_k, set()).add(_v)
SEPARATORS = " *#/_.·-•~+|^,'\"`=\\、…"
_SEP = set(SEPARATORS)
_SIGNS = set(SEPARATORS) - set(" ,、…")
#: Costs (in nats) of what a writer does to a character: put a sign in, repeat it, write it in digits or signs, by its
#: sound, in an old form, by its syllable, or mask it.
SIGN, REPEAT, DIGIT, HEARD, OLD, SYLLABLE, MASK = 1.0, 1.0, 1.0, 2.0, 0.3, 1.5, 2.0
#: A reading other than what is seen must be this much likelier.
MARGIN = 1.0
#: Cost a character (in nats) from which a stretch counts as suspicious; what the model knows costs less.
SUSPICIOUS = 3.0
_WINDOW = 48
#: Signs inside a word or between Han characters, but for those that join Latin words, and syllables beside Han text.
_INSIDE = re.compile(r"(?<=[㐀-鿿])[a-z]{2,}|[a-z]{2,}(?=[㐀-鿿])|(?<=[㐀-鿿])[*#/_.·\-•~+|^'\"`=\\]+(?=[㐀-鿿a-z])|(?<=[a-z])[*#_·•~+|^\"`=\\]+(?=[㐀-鿿a-z0-9])")

def _normal_table() -> dict[int, str | None]:
    """Looks first (wide forms, look-alike letters, unseen characters), then lower case."""
    t = dict(_TABLE)
    for c, latin in _TO_LATIN.items():
        t[ord(c)] = latin.lower()
    t = {k: v.lower() if v else v for k, v in t.items()}
    for c in range(ord("A"), ord("Z") + 1):
        t[c] = chr(c + 32)
    return t


NORMAL = _normal_table()
#: Looks only: case stays, as codes are written in capitals.
LOOKS = {**_TABLE, **{ord(c): latin for c, latin in _TO_LATIN.items()}}
_LOWER = {c: chr(c + 32) for c in range(65, 91)}
_OLD = {ord(k): v for k, v in TRADITIONAL.items()}


def settled(text: str, words: Iterable[str]) -> str:
    """Labelled text as the model should know it: old forms settled, no spaces inside Han text, and listed words that are
    written by their sound put right, so that the model does not learn how words are hidden."""
    text = text.translate(NORMAL).translate(_OLD)
    text = re.sub(r"(?<=[\u4e00-\u9fff]) +(?=[\u4e00-\u9fff])", "", text)
    text = re.sub(r"(?<![a-z])(?:[a-z] ){2,}[a-z](?![a-z])", "\n", text)
    heard = text.translate({ord(k): v for k, v in SOUND.items()})
    for word in words:
        at = -1 if word.isascii() else heard.find(word)
        while at >= 0:
            text = text[:at] + word + text[at + len(word) :]
            at = heard.find(word, at + 1)
    return text


def collapse(word: str) -> str:
    """Runs of one letter as that letter."""
    return re.sub(r"(.)\1+", r"\1", word)


_TOKEN = re.compile(r"(?<![a-z*])[a-z](?:\*?[a-z]){3,}(?![a-z*])")


def count_grams(text: str, times: int, counts: Counter) -> None:
    for n in (1, 2, 3):
        for gram, k in Counter(text[i : i + n] for i in range(len(text) - n + 1)).items():
            counts[gram] += k * times


def gram_counts(texts: Iterable[str], words: list[str]) -> tuple[Counter, Counter]:
    """(grams, words): how often labelled texts hold each gram of one to three characters, and each Latin word."""
    grams, seen = Counter(), Counter()
    for t in texts:
        # what hides words must not be learnt from
        count_grams(_INSIDE.sub("\n", settled(t, words)), 1, grams)
        seen.update(re.findall("[a-z]+", t.lower()))
    return grams, seen


class CharModel:
    """Interpolated character trigrams of labelled texts and listed words."""

    def __init__(self, texts: list[str], words: Iterable[str], weight: int = 40, counts: tuple[Counter, Counter] | None = None):
        """counts: what gram_counts found in texts that are not given, in parts summed up."""
        words = list(words)
        grams, seen = gram_counts(texts, words)
        for mine, more in zip((grams, seen), counts or ()):
            mine.update(more)
        for w in words:
            count_grams(f" {w} ", weight, grams)
        two, three = ({k: v for k, v in grams.items() if len(k) == n} for n in (2, 3))
        self.one = Counter({k: v for k, v in grams.items() if len(k) == 1})
        self.two = {k: v for k, v in two.items() if "\n" not in k}
        self.three = {k: v for k, v in three.items() if v > 1 and "\n" not in k}
        self.total = sum(self.one.values()) + 1
        self.pre3, self.pre2 = Counter(), Counter()
        self.next: dict[str, list[str]] = {}
        for k, v in self.three.items():
            self.pre3[k[:2]] += v
            if k[2].isalpha() and k[2].isascii():
                self.next.setdefault(k[:2], []).append(k[2])
        for k, v in self.two.items():
            self.pre2[k[0]] += v
        self.known: dict[str, float] = {}
        #: Listed words by their letters without repeats, which trigrams can't count.
        self.spelling = {collapse(w): w for w in words if w.isascii() and len(w) > 3}
        self.listed = "\n".join(w for w in words if w.isascii() and len(w) > 3)
        spelt = re.compile(f"(?:{'|'.join(sorted(PINYIN, key=len, reverse=True))}){{2,}}")
        #: Latin words that are common as they stand, or listed.
        self.words = frozenset(w for w, k in seen.items() if k >= 5 and not spelt.fullmatch(w)) | {w for w in words if w.isascii()}

    def logp(self, before: str, c: str) -> float:
        """Log probability of c after the last two characters of `before`."""
        key = before[-2:] + c
        got = self.known.get(key)
        if got is None:
            p = 0.02 * (self.one.get(c, 0) + 0.5) / self.total
            if before:
                n = self.pre2.get(before[-1], 0)
                if n:
                    p += 0.28 * self.two.get(before[-1] + c, 0) / n
            if len(before) > 1:
                n = self.pre3.get(before[-2:], 0)
                if n:
                    p += 0.7 * self.three.get(before[-2:] + c, 0) / n
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[key] = math.log(p)
        return got

    def cost(self, text: str) -> float:
        """Nats that the text as it stands costs."""
        return -sum(self.logp(text[max(0, i - 2) : i], c) for i, c in enumerate(text))

    def respelt(self, text: str) -> str:
        """Latin words with repeated or masked letters that only a listed word fits, as it is spelt; trigrams can't count."""

        def word(m: re.Match) -> str:
            if m[0] in self.words:
                return m[0]
            if "*" in m[0]:
                fits = re.findall(rf"^{m[0].replace('*', '[a-z]')}$", self.listed, re.M)
                return fits[0] if len(fits) == 1 else m[0]
            got = self.spelling.get(collapse(m[0]), m[0])
            return got if len(got) < len(m[0]) or len(got) == len(m[0]) + 1 else m[0]

        return _TOKEN.sub(word, text)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}


def _joins(seen: str, i: int) -> bool:
    """Whether a separator at i can stand inside a word: any sign can, a space only beside lone letters."""
    if seen[i] != " " or not (seen[i - 1].isascii() and seen[i + 1].isascii()):
        return True
    return (i < 2 or seen[i - 2] in _SEP) and (i + 2 >= len(seen) or seen[i + 2] in _SEP)


def decode(seen: str, model: CharModel, lo: int = 0, hi: int | None = None, beam: int = 24) -> tuple[float, str]:
    """(log probability, text): the likeliest text behind `seen`, by a beam Viterbi search over its character lattice.

    At each character the writer may have kept it (free), put in a separator, repeated a letter, written a look-alike
    digit or sign, a character of the same sound, an old form, a syllable in Latin letters, or masked a letter. Two equal
    Latin letters side by side are how words are spelt; only a third is a repeat (see CharModel.respelt). What
    stands before lo and from hi on is context and stays.
    """
    n = len(seen)
    hi = n if hi is None else hi
    layers: list[dict[str, tuple[float, str]]] = [{} for _ in range(n + 1)]
    layers[0][""] = (0.0, "")

    def put(k: int, score: float, text: str) -> None:
        key = text[-2:]
        old = layers[k].get(key)
        if old is None or score > old[0]:
            layers[k][key] = (score, text)

    for i, c in enumerate(seen):
        ranked = sorted(layers[i].values(), reverse=True)[:beam]
        if not lo <= i < hi:
            for score, text in ranked:
                put(i + 1, score + model.logp(text, c), text + c)
            continue
        syllables = [(k, x) for k in range(2, min(5, hi - i) + 1) for x in PINYIN.get(seen[i : i + k], ())] if c.isascii() and c.isalpha() else []
        gap = c in _SEP and 0 < i < n - 1 and _joins(seen, i)
        for score, text in ranked:
            put(i + 1, score + model.logp(text, c), text + c)
            if gap:
                put(i + 1, score - SIGN, text)
            if text and text[-1] == c and c.isalpha() and (not c.isascii() or seen[max(0, i - 2) : i + 3].count(c) > 2):
                put(i + 1, score - REPEAT, text)
            for x in LEET.get(c, ""):
                put(i + 1, score - DIGIT + model.logp(text, x), text + x)
            for table, cost in ((SOUND, HEARD), (TRADITIONAL, OLD)):
                x = table.get(c)
                if x and x != c:
                    put(i + 1, score - cost + model.logp(text, x), text + x)
            for k, x in syllables:
                put(i + k, score - SYLLABLE + model.logp(text, x), text + x)
            if c == "*":
                for x in model.next.get(text[-2:], ()):
                    put(i + 1, score - MASK + model.logp(text, x), text + x)
    return max(layers[n].values()) if layers[n] else (0.0, seen)


#: What a place of a text can show: bits of a character's class.
HAN, LOWER, UPPER, DIGIT_LIKE, IS_SIGN, SPACE, ALIKE, BANG, POINT = (1 << k for k in range(9))
#: Between texts that are looked at together.
BREAK = "\x1e"


def _classes() -> np.ndarray:
    t = np.zeros(1 << 18, np.uint16)
    t[0x3400:0xA000] |= HAN
    t[97:123] |= LOWER
    t[65:91] |= UPPER
    for bit, chars in ((DIGIT_LIKE, "0123456789@$€£"), (IS_SIGN, _SIGNS), (SPACE, " "), (POINT, ",.!?;:、。"), (ALIKE, [*TRADITIONAL, *(k for k, v in SOUND.items() if k != v)]), (BANG, "!")):
        for c in chars:
            t[ord(c)] |= bit
    return t


def _map(table: dict[int, str | None]) -> np.ndarray:
    """A table of one character for one as an array; 0 takes a character out."""
    out = np.arange(0x110000, dtype=np.uint32)
    for k, v in table.items():
        if v is None or len(v) == 1:
            out[k] = ord(v) if v else 0
    out[0] = ord(" ")
    out[ord(BREAK)] = ord(" ")
    return out


CLASSES, SEEN = _classes(), _map(LOOKS)


def evidence(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what may hide a word: a sign or space between Han characters or in a Latin word, letters set
    apart, digits or signs among letters, a character repeated, a Latin syllable beside Han text, an old form, a
    character that sounds alike. All at once over texts laid end to end."""
    n = len(codes)
    c = np.zeros(n + 8, np.uint32)
    c[2 : n + 2] = codes
    k = CLASSES[np.minimum(c, (1 << 18) - 1)]
    at = lambda d: k[2 + d : n + 2 + d]
    is_ = lambda d, bits: (at(d) & bits) > 0
    same = lambda d: c[2 + d : n + 2 + d] == c[3 + d : n + 3 + d]
    word, alone = LOWER | UPPER | DIGIT_LIKE, np.zeros(n + 8, bool)
    letter = (k & word) > 0
    alone[1:-1] = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    apart = lambda d: alone[2 + d : n + 2 + d]
    gap = IS_SIGN | SPACE
    one = (is_(0, HAN) & is_(1, gap) & is_(2, HAN | LOWER)) | (is_(0, LOWER) & is_(1, IS_SIGN) & is_(2, HAN | LOWER | DIGIT_LIKE))
    one |= (is_(0, UPPER) & is_(1, DIGIT_LIKE) & is_(2, UPPER)) | (is_(0, LOWER) & is_(1, BANG) & is_(2, LOWER))
    one |= (is_(0, HAN) & is_(1, LOWER) & is_(2, LOWER)) | (is_(0, LOWER) & is_(1, LOWER) & is_(2, HAN))
    one |= is_(-2, HAN) & is_(-1, POINT) & is_(0, LOWER) & is_(1, LOWER) & is_(2, LOWER)
    two = is_(0, HAN | LOWER) & is_(1, IS_SIGN) & same(1) & is_(3, HAN | LOWER | DIGIT_LIKE)
    five = apart(0) & is_(1, gap) & apart(2) & is_(3, gap) & apart(4)
    pair = (is_(0, LOWER) & is_(1, DIGIT_LIKE)) | (is_(0, DIGIT_LIKE) & is_(1, LOWER))
    pair |= same(0) & (is_(0, HAN | LOWER) | is_(0, UPPER) & is_(2, UPPER) & is_(3, UPPER))
    width = np.where(five, 5, np.where(two, 4, np.where(one, 3, np.where(pair, 2, np.where(is_(0, ALIKE), 1, 0)))))
    starts = np.flatnonzero(width)
    return starts, starts + width[starts]


_INNER = set("abcdefghijklmnopqrstuvwxyz0123456789@$€£!") | _SIGNS


def stretches(low: str, starts: list[int], ends: list[int], known: frozenset[str]) -> list[tuple[int, int]]:
    """Stretches of evidence with the Latin words they touch; those that meet are one. Words that are known as they
    stand are none."""
    out: list[tuple[int, int]] = []
    n = len(low)
    for a, b in zip(starts, ends):
        if out and b <= out[-1][1]:
            continue
        first, last = a, b
        while a > 0 and low[a - 1] in _INNER and last - a < _WINDOW:
            a -= 1
        while b < n and low[b] in _INNER and b - first < _WINDOW:
            b += 1
        if out and a <= out[-1][1] and b - out[-1][0] < _WINDOW:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            a = max(a, out[-1][1]) if out else a
            if a < b:
                out.append((a, b))
    return [(a, b) for a, b in out if low[a:b].strip(".-/'!") not in known]


def look(texts: list[str]) -> np.ndarray:
    """Code points of texts laid end to end, as they look: wide forms and look-alike letters settled, what is not seen gone."""
    codes = SEEN[np.frombuffer(BREAK.join(t.replace(BREAK, " ") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(texts) > 1:
        at = np.cumsum([len(t) + 1 for t in texts[:-1]]) - 1
        codes = codes.copy()
        codes[at] = ord(BREAK)
    return codes[codes > 0]


def restore(texts: list[str], model: CharModel, memory: dict[str, str | None]) -> tuple[str, int]:
    """(the texts in plain form with BREAK between them, places restored): every suspicious stretch is decoded.

    Suspicious is a stretch with evidence that the model finds unlikely as it stands (SUSPICIOUS nats a character); the
    decoded reading replaces it where it is likelier by MARGIN, with two characters on either side as context.
    `memory` keeps what was decided on a stretch for the texts that follow.
    """
    codes = look(texts)
    starts, ends = evidence(codes)
    codes = codes.copy()
    codes[(codes >= 65) & (codes <= 90)] += 32
    low = codes.tobytes().decode("utf-32-le", "surrogatepass")
    out, last, changed = [], 0, 0
    for a, b in stretches(low, starts.tolist(), ends.tolist(), model.words):
        lo, hi = min(a, 2), 2
        part = low[a - lo : b + hi]
        got = memory.get(part, part)
        if got is part:
            got, cost = None, model.cost(part)
            read = model.respelt(part)
            if read != part:
                got = read[lo : len(read) - min(hi, len(low) - b)]
            elif cost > SUSPICIOUS * len(part):
                score, read = decode(part, model, lo, len(part) - min(hi, len(low) - b))
                if read != part and score > MARGIN - cost:
                    read = model.respelt(read)
                    got = read[lo : len(read) - min(hi, len(low) - b)]
            if len(memory) > 200_000:
                memory.clear()
            memory[part] = got
        if got is not None:
            out += [low[last:a], got]
            last = b
            changed += 1
    return "".join([*out, low[last:]]), changed
