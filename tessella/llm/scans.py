"""Repair of text from scanned pages: furniture, broken words and misread characters.

Nothing here knows a list of confusions or the wording of a header. How characters are misread is
estimated from the corpus' own pairs of rare and frequent words that differ in one place; what a running
header looks like is learnt from lines that come again in a document and cut a sentence in two. All
counts and all verdicts are tables keyed by word, by line or by document, so no task or driver holds
the vocabulary.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import hot_join, stage

MARKS = "-‐­¬"
# Words that the editor is trained on, and pairs of real words that it must keep apart.
TRAIN_WORDS = 4_000
TRAIN_PAIRS = 12_000
# Frequent words known to be clean are passed over without a lookup; their number decides nothing else.
CLEAN_WORDS = 50_000
# A pair of words this far apart in frequency counts as noise when operations are counted.
APART = 20
# What a misreading is weighed against: only words that occur this often can stand behind one.
LEAST_PRINTED = 3
_CORE_L, _CORE_R = "\"'“”‘’«»[{<", ".,;:!?\"'“”‘’«»]}>"


def core(token: str) -> str:
    """A token in lower case without the punctuation around it."""
    t = token.strip(_CORE_L + _CORE_R)
    if t.startswith("(") and t.endswith(")"):
        t = t[1:-1]
    elif t.startswith("(") and ")" not in t:
        t = t[1:]
    if t.endswith(")") and "(" not in t:
        t = t[:-1]
    return t.strip(_CORE_L + _CORE_R).lower()


def wordlike(w: str) -> bool:
    """Whether a token has two letters at least and is no address."""
    return sum(ch.isalpha() for ch in w) >= 2 and not w.startswith(("www.", "http:", "https:"))


_BROKEN = re.compile(rf"[{MARKS}][ \t]*\n\s*\S+")
FLUSH_WORDS = 200_000


def word_counts(segments: DataFrame) -> DataFrame:
    """(word, n): how often each word stands whole within a line, over all contents. Both halves of a word
    broken at a line end are left out. Each task counts its tokens as they stand and folds each distinct
    one once, so only words of a task are shuffled, not occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for raw, n in seen.items():
                if raw[-1] != "\0" and wordlike(w := core(raw)):
                    words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(_BROKEN.sub("\0 ", text).split())
            if len(seen) > FLUSH_WORDS:
                yield flush()
        yield flush()

    words = segments.select("content").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


class Perceptron:
    """A binary averaged perceptron over named features."""

    def __init__(self) -> None:
        self.w: dict[str, float] = defaultdict(float)
        self._sum: dict[str, float] = defaultdict(float)
        self._at: dict[str, int] = defaultdict(int)
        self.t = 0

    def score(self, feats: list[str]) -> float:
        get = self.w.get
        return sum(get(f, 0.0) for f in feats)

    def learn(self, feats: list[str], label: bool, margin: float = 0.0) -> None:
        self.t += 1
        score = self.score(feats)
        if (score <= margin) if label else (score > -margin):
            for f in feats:
                self._sum[f] += (self.t - self._at[f]) * self.w[f]
                self._at[f] = self.t
                self.w[f] += 1.0 if label else -1.0

    def fit(self, examples: list[tuple[list[str], bool]], rounds: int = 5, margin: float = 1.0, seed: int = 7) -> "Perceptron":
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(examples)
            for feats, label in examples:
                self.learn(feats, label, margin)
        for f in self.w:
            self._sum[f] += (self.t - self._at[f]) * self.w[f]
        self.w = {f: s / max(1, self.t) for f, s in self._sum.items() if s}
        self._sum, self._at = defaultdict(float), defaultdict(int)
        return self


def _log(x: float) -> int:
    return max(-4, min(12, math.floor(math.log2(x)))) if x > 0 else -9


# -- words --------------------------------------------------------------------------------------------


def difference(w: str, c: str) -> tuple[int, str, str]:
    """(place, read, printed): the one stretch in which two words differ."""
    i, most = 0, min(len(w), len(c))
    while i < most and w[i] == c[i]:
        i += 1
    j = 0
    while j < most - i and w[len(w) - 1 - j] == c[len(c) - 1 - j]:
        j += 1
    return i, w[i : len(w) - j], c[i : len(c) - j]


def gaps(w: str, lengths: tuple[int, ...] = (0, 1, 2)) -> Iterator[tuple[str, int]]:
    """The word with each stretch of up to two characters left open: words that share one differ there at most."""
    for k in lengths:
        for i in range(len(w) - k + 1):
            yield f"{w[:i]}\0{w[i + k :]}", k


def near_words(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, n, printed, m): for each word the more frequent words that differ by one operation.

    An operation turns up to two characters read into up to two printed, three together (a replacement,
    insertion, deletion, or one of them for two). Printed words are of letters, with hyphens and
    apostrophes; any letter may stand for any other. Words meet by the stretch they leave open, so only
    words that have one in common ever form a pair."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(key, k, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(w) > 2 for key, k in gaps(w)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int8(), pa.string(), pa.int64()))], names=["key", "k", "word", "n"])

    schema = "key string, k byte, word string, n long"
    printed = counts.where(F.col("n") >= LEAST_PRINTED).where(F.regexp_like("word", F.lit(r"^\p{L}[\p{L}'’-]*\p{L}$")))
    a = words.select("word", "n").mapInArrow(keys, schema)
    b = printed.select("word", "n").mapInArrow(keys, schema).select("key", F.col("k").alias("l"), F.col("word").alias("printed"), F.col("n").alias("m"))
    pairs = a.join(b, "key").where((F.col("m") > F.col("n")) & (F.col("k") + F.col("l") <= 3) & (F.col("word") != F.col("printed")))
    return pairs.select("word", "n", "printed", "m").distinct()


def trigrams(w: str) -> list[str]:
    t = f"^{w}$"
    return [t[i : i + 3] for i in range(len(t) - 2)]


def skeleton(w: str) -> str:
    """The classes of a word's characters, runs as one: letters a, digits 9, others as they are."""
    s = re.sub(r"[^\W\d_]+", "a", w)
    return re.sub(r"\d+", "9", s)[:8]


def _class(x: str) -> str:
    return "".join("a" if ch.isalpha() and ch.isascii() else "9" if ch.isdigit() else "A" if ch.isalpha() else "#" for ch in x)


@dataclass
class Editor:
    """The character editor: keep a word, or read one stretch of it as another one.

    ``noise`` and ``real`` count the operations between words far apart in frequency and between words
    that are not: a misreading shows in the first, word formation in both. ``rate`` is how often a frequent
    word is usually misread in one certain way. ``grams`` counts the letter
    triples of words seen more than once or twice."""

    rate: float = 1e-3
    noise: dict[tuple[str, str], int] = field(default_factory=dict)
    real: dict[tuple[str, str], int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    op: Perceptron = field(default_factory=Perceptron)
    alone: Perceptron = field(default_factory=Perceptron)
    join: Perceptron = field(default_factory=Perceptron)

    def rare(self, w: str) -> tuple[int, int]:
        """How usual the most unusual triple of a word is, and where it is."""
        get = self.grams.get
        n, i = min((get(t, 0), i) for i, t in enumerate(trigrams(w)))
        return _log(n + 1), i

    def features(self, w: str, n: int, c: str, m: int) -> list[str]:
        i, read, printed = difference(w, c)
        said = self.noise.get((read, printed), 0)
        usual = math.floor(math.log2((said + 0.5) / (self.real.get((read, printed), 0) + 0.5)))
        usual = max(-4, min(6, usual))
        kind = f"{_class(read)}>{_class(printed)}"
        at = "start" if i == 0 else "end" if i + len(read) >= len(w) else "inner"
        size = min(len(c) // 2, 6)
        ratio = min(9, _log(m / max(1, n)))
        odd = min(6, self.rare(c)[0]) - min(6, self.rare(w)[0])
        return [
            "bias", f"usual{usual}", f"said{min(6, _log(said + 1))}", f"kind:{kind}", f"{kind}:{at}", f"at:{at}:{size}", f"ratio{ratio}", f"ratio{ratio}:{kind}", f"ratio{ratio}:n{min(7, _log(n))}", f"due{max(-6, min(6, _log(n / max(1e-9, m * self.rate))))}:n{min(3, _log(n))}", f"odd{odd}", f"odd{odd}:{size}", f"usual{usual}:{at}",
            f"usual{usual}:odd{max(-1, min(4, odd))}", f"ratio{ratio}:odd{max(-1, min(4, odd))}", f"op:{read}>{printed}", f"rare{min(5, self.rare(w)[0])}:{size}",
        ]

    def lonely(self, w: str, n: int) -> list[str]:
        """Features of a word by itself, for words with more than one misread place."""
        rare = min(7, self.rare(w)[0])
        shape = skeleton(w)
        few = sum(self.grams.get(t, 0) <= 1 for t in trigrams(w))
        return ["bias", f"shape:{shape}", f"rare{rare}", f"few{min(few, 6)}", f"few{min(few, 6)}:{shape}", f"n{min(n, 6)}", f"n{min(n, 6)}:rare{rare}", f"rare{rare}:{min(len(w) // 3, 4)}", f"few{min(few, 6)}:n{min(n, 4)}"]

    @staticmethod
    def join_features(whole: int, compound: int, left: bool, right: bool, mark: str) -> list[str]:
        """Features of a line join by how often the parts stand together, joined or with the mark."""
        side = "joined" if whole > compound else "compound" if compound > whole else "neither"
        return ["bias", f"mark:{mark == '-'}", f"side:{side}", f"side:{side}:{mark == '-'}", f"{side}:{left}{right}:{mark == '-'}"]

    def spoil(self, w: str, rng: random.Random, ops: list[tuple[str, str]], weights: list[float], letters: str) -> str | None:
        """The word as it might be misread: by an operation as usual in the corpus, or now and then by any."""
        if rng.random() < 0.25:
            i = rng.randrange(len(w))
            return w[:i] + rng.choice(letters) + w[i + 1 :]
        for _ in range(20):
            read, printed = rng.choices(ops, weights)[0]
            at = [i for i in range(len(w) - len(printed) + 1) if w.startswith(printed, i)]
            if at:
                i = rng.choice(at)
                return w[:i] + read + w[i + len(printed) :]
        return None

    def fit(self, words: dict[str, int], known: list[tuple[str, int, str, int]], seed: int = 7) -> "Editor":
        """Learn from words spoilt the way the corpus is, and from pairs of real words, taken as rare as noise.

        ``words`` are a bounded sample of the lexicon, ``known`` pairs of words that are too frequent to be
        misreadings of each other."""
        rng = random.Random(seed)
        plain = sorted(w for w in words if w.isalpha() and len(w) > 2)
        letters = "".join(sorted({ch for w in plain for ch in w})) or "a"
        usual = {o: n for o, n in self.noise.items() if n > 2 * self.real.get(o, 0) and n > 1}
        ops, weights = sorted(usual), [float(usual[o]) for o in sorted(usual)]
        if not ops:
            ops, weights = [(a, b) for a in letters for b in letters if a != b] or [("b", "a")], [1.0] * max(1, len(letters) * (len(letters) - 1))
        data: list[tuple[list[str], bool]] = []
        single: list[tuple[list[str], bool]] = []
        joins: list[tuple[list[str], bool]] = []
        for w in plain:
            for _ in range(3):
                bad = self.spoil(w, rng, ops, weights, letters)
                if not bad or bad == w or bad in words:
                    continue
                m = words[w]
                data.append((self.features(bad, max(1, int(m * self.rate * rng.choice((0.2, 0.5, 1, 1, 2, 4)))), w, m), True))
                if len(w) > 5 and (worse := self.spoil(bad, rng, ops, weights, letters)) and worse != w:
                    single.append((self.lonely(worse, 1), True))
        for w, n, c, m in known:
            data.append((self.features(w, n, c, m), False))
            n = rng.choice((1, 1, 2, 3, 5, 10, 30, 100))
            data.append((self.features(w, n, c, n * rng.choice((8, 30, 100, 300))), False))
        for w, n in words.items():
            single.append((self.lonely(w, n), False))
            single.append((self.lonely(w, rng.choice((1, 1, 2, 3))), False))
        for w in plain:
            if len(w) > 4:
                k = rng.randint(2, len(w) - 2)
                for mark in rng.sample(MARKS, 2):
                    joins.append((self.join_features(words[w], 0, w[:k] in words, w[k:] in words, mark), True))
                # a broken word that is not known as a whole, against two known ones that are
                joins.append((self.join_features(0, 0, False, w[k:] in words, "-"), True))
                joins.append((self.join_features(0, 0, True, True, "-"), False))
        for w, n in words.items():
            parts = w.split("-")
            if len(parts) > 1 and all(parts):
                joins.append((self.join_features(words.get("".join(parts), 0), n, parts[0] in words, parts[-1] in words, "-"), False))
        self.op.fit(data)
        self.alone.fit(single)
        self.join.fit(joins)
        return self


def fit_editor(counts: DataFrame, pairs: DataFrame) -> Editor:
    """Estimate operations and letter triples over the whole lexicon and train the perceptrons.

    What comes to the driver is bounded: operations and triples by the alphabet, training words and pairs
    by their parameters (chosen by frequency and by hash)."""

    def ops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[tuple[str, str, bool]] = Counter()
            for w, n, c, m in zip(*(col.to_pylist() for col in b.columns)):
                _, read, printed = difference(w, c)
                found[read, printed, m >= APART * n] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))] + [pa.array(list(found.values()), pa.int64())], names=["read", "printed", "apart", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(t for w in b.column(0).to_pylist() for t in trigrams(w))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

    e = Editor()
    seen = pairs.mapInArrow(ops, "read string, printed string, apart boolean, n long").groupBy("read", "printed", "apart").agg(F.sum("n").alias("n")).where("n > 1")
    for r in seen.toLocalIterator():
        (e.noise if r.apart else e.real)[r.read, r.printed] = r.n
    usual = counts.where(F.col("n") >= LEAST_PRINTED)
    e.grams = {r.gram: r.n for r in usual.select("word").mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator()}
    by_hash = F.xxhash64("word")
    sample = usual.orderBy(F.desc("n"), "word").limit(TRAIN_WORDS // 2).unionByName(usual.orderBy(by_hash, "word").limit(TRAIN_WORDS // 2))
    words = {r.word: r.n for r in sample.collect()}
    # the usual share of one misreading: the middle one among those of the most frequent words
    high = pairs.select(F.percentile_approx("m", 0.9)).first()[0] or 0
    e.rate = float(pairs.where((F.col("m") >= high) & (F.col("m") >= APART * F.col("n"))).select(F.percentile_approx(F.col("n") / F.col("m"), 0.5)).first()[0] or 1e-3)
    real = pairs.where((F.col("n") >= 5) & (F.col("n") > 8 * e.rate * F.col("m"))).orderBy(F.xxhash64("word", "printed"), "word", "printed").limit(TRAIN_PAIRS)
    return e.fit(dict(sorted(words.items())), [tuple(r) for r in real.collect()])


def verdicts(words: DataFrame, pairs: DataFrame, editor: Any) -> DataFrame:
    """(word, place, printed): the words that the editor does not keep, where they are misread, and the word
    behind them (null if none is known)."""
    scored = "word string, score double, place int, printed string"

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.string()))], names=["word", "score", "place", "printed"])

    def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = editor.value
        for b in batches:
            rows = ((w, e.op.score(e.features(w, n, c, m)), c, m) for w, n, c, m in zip(*(col.to_pylist() for col in b.columns)))
            yield emit([(w, 1000.0 + s * (1 + math.log10(m)), difference(w, c)[0], c) for w, s, c, m in rows if s > 0])

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = editor.value
        for b in batches:
            yield emit([(w, s, max(0, e.rare(w)[1] - 1), None) for w, n in zip(*(col.to_pylist() for col in b.columns)) if len(w) > 2 and (s := e.alone.score(e.lonely(w, n))) > 0])

    # a known word behind it says more than the word by itself
    found = pairs.mapInArrow(by_pair, scored).unionByName(words.select("word", "n").mapInArrow(by_word, scored))
    best = found.groupBy("word").agg(F.max(F.struct("score", "printed", "place")).alias("b"))
    return best.select("word", "b.place", "b.printed")


# -- furniture ----------------------------------------------------------------------------------------

_NUMBERISH = re.compile(r"\d+|\b[ivxlc]{1,7}\b")
_SENTENCE_END = tuple(".!?:;")


def masked(line: str) -> list[str]:
    """The words of a line in lower case, numbers (roman ones too) as '#'."""
    return _NUMBERISH.sub("#", " ".join(line.lower().split())).split(" ")


class _Masked(dict):
    """The masked words of lines, worked out where they are asked for."""

    def __init__(self, lines: list[str]):
        super().__init__()
        self.lines = lines

    def __missing__(self, i: int) -> list[str]:
        self[i] = got = masked(self.lines[i])
        return got


def without_title(words: list[str], title: list[str]) -> list[str]:
    """A line with the section title in it, one word of which may be misread, as '@'."""
    k = len(title)
    for i in range(len(words) - k + 1) if k else ():
        if sum(a == b for a, b in zip(words[i : i + k], title)) >= max(1, k - (k > 1)):
            return [*words[:i], "@", *words[i + k :]]
    return words


def line_keys(words: list[str]) -> list[str]:
    """What a line is recognised by: its words, and its words but one, since one may be misread."""
    keys = [" ".join(words)]
    if len(words) > 2:
        keys += [" ".join((*words[:i], *words[i + 1 :])) + f" -{len(words)}" for i in range(len(words)) if words[i] not in "#@"]
    return keys


def candidates(title: str | None, content: str) -> list[tuple[int, list[str], str, str, int]]:
    """Lines that may be furniture: (line_no, keys, numbers, features, vote).

    Words of a line are mostly capitalised, or those of the section title, or few. ``features`` are of its place
    and form; ``vote`` is what the text around says: 1 if the line cuts a sentence in two, -1 if it goes on
    with one or stands among rows of a table, else 0."""
    raw = content.split("\n")
    lines = [" ".join(l.split()) for l in raw]
    filled = [i for i, l in enumerate(lines) if l]
    if len(filled) < 2:
        return []
    titled = [w for w in masked(title or "") if w]
    of_title = set(titled) - {"#"}
    forms = _Masked(lines)

    def kind(i: int) -> tuple[float, float] | None:
        """Share of capitalised words and of words of the title; None if the line is no candidate."""
        line = lines[i]
        if len(line) > 120:
            return None
        plain = line.split(" ")
        if len(plain) > 4 and 2 * sum(w[:1].islower() for w in plain) > len(plain) and 5 * sum(w in of_title for w in plain) < len(plain):
            return None
        words = forms[i]
        alphas = [w for w in line.split(" ") if w[:1].isalpha()]
        capital = sum(w[0].isupper() for w in alphas) / len(alphas) if alphas else 1.0
        overlap = sum(w in of_title for w in words if w != "#") / max(1, sum(w != "#" for w in words)) if of_title else 0.0
        return (capital, overlap) if capital >= 0.5 or overlap >= 0.6 or len(words) <= 4 else None

    kinds = [kind(i) for i in filled]

    def text_near(at: int, step: int) -> str:
        """The next line of text proper: furniture may have two lines."""
        j = at + step
        if 0 <= j < len(filled) and kinds[j] and 0 <= j + step < len(filled) and not kinds[j + step]:
            j += step
        return lines[filled[j]] if 0 <= j < len(filled) else ""

    out = []
    for at, i in enumerate(filled):
        if kinds[at] is None:
            continue
        line, words = lines[i], forms[i]
        capital, overlap = kinds[at]
        before, after = text_near(at, -1), text_near(at, 1)
        numbers = sum(w == "#" for w in words)
        like = lambda j: 0 <= j < len(filled) and sum(w == "#" for w in forms[filled[j]]) >= 2
        cells = numbers >= 2 and len([x for x in re.split(r"\s{2,}|\|", raw[i].strip()) if x]) >= 3
        row = cells and any(like(at + k) for k in (-2, -1, 1, 2)) or line[0] == "|"
        short = lambda j: 0 <= j < len(filled) and len(forms[filled[j]]) <= 4
        open_before = bool(before) and before[-1] not in _SENTENCE_END
        goes_on = after[:1].islower()
        counted = numbers > 0 and len(words) <= 4
        if row or line[0].islower() and not counted and not overlap >= 0.6:
            vote = -1
        elif open_before and goes_on and line[-1] not in ".,;:":
            vote = 1
        else:
            vote = 0
        text = [w for w in words if w != "#"]
        form = "number" if not any(any(ch.isalpha() for ch in w) for w in text) else "page" if len(text) <= 2 and numbers and len(line) <= 14 else "upper" if line == line.upper() else "capital" if capital >= 0.75 else "mixed" if capital >= 0.5 else "low"
        title_like = "title" if overlap >= 0.99 and len(text) >= len(of_title) else "part" if overlap >= 0.6 else "other"
        place = "first" if at == 0 else "last" if at == len(filled) - 1 else "inner"
        gap = f"{int(i > 0 and not lines[i - 1])}{int(i + 1 < len(lines) and not lines[i + 1])}"
        feats = [
            f"form:{form}", f"title:{title_like}:{form}", f"place:{place}", f"numbers{min(numbers, 3)}", f"words{min(len(text), 8)}", f"end:{line[-1] in '.,;:'}", f"indent:{min(3, (len(raw[i]) - len(raw[i].lstrip(' '))) // 3)}:{raw[i][:1] == chr(12)}",
            f"gap:{gap}:{form}", f"row:{row}", f"beside:{short(at - 1)}{short(at + 1)}", f"title:{title_like}:{form}:{min(numbers, 2)}:{place}", f"joins:{open_before}{goes_on}",
        ]
        out.append((i, line_keys(without_title(words, titled)), ",".join(_NUMBERISH.findall(line.lower())), "|".join(feats), vote))
    return out


def recurrence(lines: DataFrame) -> DataFrame:
    """(seg_uid, line_no, times, copies, varies, docs): how often the line, or the line but for one word, comes in its
    document and in how many contents of it, whether it comes with other numbers, and in how many
    documents it comes. The same content counts once, however often it was ingested."""
    keyed = lines.select("seg_uid", "doc", "copy", "line_no", "numbers", F.explode("keys").alias("key"))
    once = keyed.groupBy("doc", "key", "copy", "line_no").agg(F.max("numbers").alias("numbers"))
    times = once.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("copy").alias("copies"), (F.min("numbers") != F.max("numbers")).alias("varies"))
    times = stage(times, "line-times")
    docs = times.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    times = stage(hot_join(times, docs, ["key"], "left", spread=F.xxhash64("doc")), "line-docs")
    back = hot_join(keyed.select("seg_uid", "line_no", "doc", "key"), times, ["doc", "key"], "left", spread=F.col("seg_uid"))
    best = F.max(F.struct("times", "copies", "varies"))
    return back.groupBy("seg_uid", "line_no").agg(best.alias("b"), F.coalesce(F.max("docs"), F.lit(1)).alias("docs")).select("seg_uid", "line_no", "b.times", "b.copies", "b.varies", "docs")


def furniture(segments: DataFrame) -> DataFrame:
    """(seg_uid, line_no) of running headers, running footers and page numbers.

    A perceptron scores each candidate line by how often it recurs in its document and by its place and
    form. It is taught by the text around the lines, which it does not see: a recurring line that cuts a
    sentence in two is furniture, a line that never comes again or goes on with a sentence is not. All
    lines vote; what the driver sees is the number of votes for each combination of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, *c) for u, t, text in zip(*(b.column(i).to_pylist() for i in range(3))) if text and not text.isspace() for c in candidates(t, text)]
            types = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["seg_uid", "line_no", "keys", "numbers", "feats", "vote"])

    found = segments.select("seg_uid", "section_title", "content").mapInArrow(run, "seg_uid long, line_no int, keys array<string>, numbers string, feats string, vote int")
    named = segments.select("seg_uid", F.coalesce("doc_id", F.lit("")).alias("doc"), F.xxhash64("content").alias("copy"))
    lines = stage(found.join(named, "seg_uid"), "scan-lines")
    again = recurrence(lines)
    bucket = F.least(F.floor(F.log2("times")), F.lit(6)).cast("int")
    many = F.concat(F.lit("times"), bucket, F.lit(":"), F.col("varies"), F.lit(":"), F.least("copies", F.lit(3)), F.lit(":docs"), F.least(F.floor(F.log2("docs")), F.lit(3)).cast("int"))
    rows = stage(lines.select("seg_uid", "line_no", "feats", "vote").join(again, ["seg_uid", "line_no"]).select("seg_uid", "line_no", many.alias("many"), (F.greatest("times", "docs")).alias("times"), "vote", "feats"), "scan-scored")
    label = F.when(F.col("vote") == -1, False).when(F.col("times") == 1, False).when((F.col("vote") == 1) & (F.col("times") >= 3), True)
    votes = rows.select("many", "feats", label.alias("label")).where("label is not null").groupBy("many", "feats", "label").agg(F.count(F.lit(1)).alias("n"))
    model = segments.sparkSession.sparkContext.broadcast(fit_furniture([(r.many, r.feats, r.label, r.n) for r in votes.toLocalIterator()]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([model.value.score(page_features(m, f)) > 0 for m, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["seg_uid", "line_no"]).filter(keep)

    return rows.select("seg_uid", "line_no", "many", "feats").mapInArrow(judge, "seg_uid long, line_no int")


def page_features(many: str, feats: str) -> list[str]:
    own = [f for f in feats.split("|") if not f.startswith("joins:")]
    here, docs = many.split(":docs")
    return ["bias", here, f"docs{docs}", many, *own, *[f"{here}:{f}" for f in own], *[f"docs{docs}:{f}" for f in own]]


def fit_furniture(votes: list[tuple[str, str, bool, int]]) -> Perceptron:
    examples = [(page_features(m, f), y) for m, f, y, n in sorted(votes) for _ in range((1 + min(4, int(math.log2(n)))) * (3 if y else 1))]
    return Perceptron().fit(examples, rounds=8)


# -- contents -----------------------------------------------------------------------------------------

_WORD_AT_END = re.compile(rf"(\S*[^\W\d_])([{MARKS}])\s*$")
_WORD_AT_START = re.compile(r"\s*(\S+)")


def broken_end(line: str) -> re.Match[str] | None:
    """The last word and its mark, if the line ends in a mark after a letter."""
    return _WORD_AT_END.search(line) if line.rstrip()[-1:] in tuple(MARKS) else None


class Tokens(dict):
    """Tokens as they stand to the words to be looked up: '' for those passed over."""

    def __init__(self, skip: frozenset[str]):
        super().__init__()
        self.skip = skip

    def __missing__(self, raw: str) -> str:
        if len(self) > FLUSH_WORDS:
            self.clear()
        w = core(raw)
        self[raw] = w = w if w not in self.skip and wordlike(w) else ""
        return w


def parts_of(content: str, junk: set[int], tokens_of: dict[str, str]) -> tuple[list[tuple[int, int, str, str, str]], list[tuple[int, str]]]:
    """Broken words (line_no, next line_no, left, right, mark) and the other words (line_no, word) of the lines of text."""
    lines = content.split("\n")
    text = [i for i, l in enumerate(lines) if l.strip() and i not in junk]
    broken, words = [], []
    taken_first = False
    for k, i in enumerate(text):
        tokens = lines[i].split()
        if taken_first:
            tokens = tokens[1:]
        taken_first = False
        m = broken_end(lines[i])
        if m and k + 1 < len(text):
            n = _WORD_AT_START.match(lines[text[k + 1]])
            a, b = core(m[1]), core(n[1] if n else "")
            if a and b and not b.isdigit():
                broken.append((i, text[k + 1], a, b, m[2]))
                tokens, taken_first = tokens[:-1], True
        words += [(i, w) for raw in tokens if (w := tokens_of[raw])]
    return broken, words


PARTS = "seg_uid long, line_no int, next_no int, word string, right string, mark string"


@dataclass
class Scans:
    """Everything found in a table of contents, by line."""

    junk: DataFrame  # seg_uid, line_no
    joins: DataFrame  # seg_uid, line_no, next_no, word, right, mark, joins, place, printed
    wrong: DataFrame  # seg_uid, line_no, word, printed


def analyse(segments: DataFrame) -> Scans:
    """Furniture, broken words and misread words of all contents."""
    spark = segments.sparkSession
    counts = stage(word_counts(segments), "words")
    junk = stage(furniture(segments), "furniture")
    pairs = stage(near_words(counts, counts), "near-words")
    editor = spark.sparkContext.broadcast(fit_editor(counts, pairs))
    bad = stage(verdicts(counts, pairs, editor), "misread")
    clean = counts.join(bad.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(CLEAN_WORDS).select("word")
    known = spark.sparkContext.broadcast(frozenset(r.word for r in clean.collect()))
    held = junk.groupBy("seg_uid").agg(F.collect_list("line_no").alias("junk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(known.value)
        for b in batches:
            rows: list[tuple] = []
            for u, text, lines in zip(*(b.column(i).to_pylist() for i in range(3))):
                if text and not text.isspace():
                    broken, words = parts_of(text, set(lines or ()), tokens)
                    rows += [(u, *x) for x in broken]
                    rows += [(u, i, None, w, None, None) for i, w in dict.fromkeys(words)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["seg_uid", "line_no", "next_no", "word", "right", "mark"])

    found = stage(segments.select("seg_uid", "content").join(held, "seg_uid", "left").mapInArrow(run, PARTS), "scan-parts")
    wrong = hot_join(found.where("mark is null").select("seg_uid", "line_no", "word"), bad.select("word", "printed"), ["word"], "inner", spread=F.col("seg_uid"))
    ends = found.where("mark is not null")
    judged = stage(join_verdicts(ends.select(F.col("word").alias("left"), "right", "mark").distinct(), counts, editor), "joins")
    joins = hot_join(ends, judged.withColumnRenamed("left", "word"), ["word", "right", "mark"], "left", spread=F.col("seg_uid"))
    return Scans(junk, stage(joins, "broken"), stage(wrong, "wrong"))


def join_verdicts(ends: DataFrame, counts: DataFrame, editor: Any) -> DataFrame:
    """(left, right, mark, joins, place, printed): whether a word broken at a line end is one without the mark, and where
    the whole is misread. Every distinct break is judged once."""
    ends = stage(ends.withColumn("whole", F.concat("left", "right")).withColumn("hyphened", F.concat("left", F.lit("-"), "right")), "breaks")
    asked = ends.select(F.explode(F.array("whole", "hyphened", F.element_at(F.split("left", "-"), -1), F.get(F.split("right", "-"), 0))).alias("word")).distinct()
    known = asked.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    known = stage(known, "asked")
    new = known.where(F.length("word") > 2)
    near = stage(near_words(new, counts), "near-breaks")
    bad = stage(verdicts(new.select("word", F.greatest("n", F.lit(1)).alias("n")), near.withColumn("n", F.greatest("n", F.lit(1))), editor), "misread-breaks")
    behind = bad.where("printed is not null").select("word", "printed").join(counts.select(F.col("word").alias("printed"), F.col("n").alias("m")), "printed")
    info = stage(known.join(behind.select("word", "m"), "word", "left").select("word", F.col("n"), F.coalesce(F.when(F.col("n") > 0, F.col("n")), F.floor(F.col("m") / 4), F.lit(0)).alias("best")), "break-words")
    # all four lookups of a break in one join
    parts = [("whole", F.col("whole")), ("hyphened", F.col("hyphened")), ("l", F.element_at(F.split("left", "-"), -1)), ("r", F.get(F.split("right", "-"), 0))]
    asks = stage(ends.select("left", "right", "mark", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), w.alias("word")) for k, w in parts])).alias("a")).select("left", "right", "mark", "a.role", "a.word"), "break-asks")
    told = hot_join(asks, info, ["word"], "left", spread=F.xxhash64("left", "right", "role"))
    pick = lambda role, value: F.coalesce(F.max(F.when(F.col("role") == role, F.col(value))), F.lit(0)).alias(f"{role}_n")
    t = told.groupBy("left", "right", "mark").agg(pick("whole", "best"), pick("hyphened", "n"), pick("l", "n"), pick("r", "n"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = editor.value
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(7))))
            joins = [e.join.score(e.join_features(w, h, l > 0, r > 0, m)) > 0 for *_, m, w, h, l, r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(joins, pa.bool_())], names=["left", "right", "mark", "joins"])

    joined = t.mapInArrow(judge, "left string, right string, mark string, joins boolean")
    joined = joined.withColumn("word", F.when(F.col("joins"), F.concat("left", "right")).otherwise(F.concat("left", F.lit("-"), "right")))
    # a hyphened word is known by its parts where it is not known as a whole
    out = hot_join(stage(joined, "judged-breaks"), bad, ["word"], "left", spread=F.xxhash64("left", "right"))
    compound = ~F.col("joins") & F.col("printed").isNull()
    return out.select("left", "right", "mark", "joins", F.when(~compound, F.col("place")).alias("place"), "printed")


def find_noise(segments: DataFrame) -> DataFrame:
    """(seg_uid, line_no, kind) of furniture, hyphen and misread lines.

    Null, empty and blank contents have no cases; blank lines are never cases; every row counts by
    itself, repeated or not. A content of a single line has no furniture. Missing titles or document ids
    only leave out what they would tell; rows without a document id are one document."""
    s = analyse(segments)
    kind = lambda df, k: df.select("seg_uid", "line_no", F.lit(k).alias("kind"))
    cut = F.length("word") + F.when(F.col("joins"), 0).otherwise(1)
    split = s.joins.where("place is not null").select("seg_uid", F.when(F.col("place") < cut, F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"))
    wrong = s.wrong.select("seg_uid", "line_no").unionByName(split).distinct()
    return kind(s.junk, "furniture").unionByName(kind(s.joins.where("joins"), "hyphen")).unionByName(kind(wrong, "misread"))


def repaired(content: str | None, junk: set[int], joins: dict[int, bool], words: dict[str, str]) -> str | None:
    """Continuous paragraphs: furniture gone, broken words joined, misread words replaced."""
    if content is None or not content.strip():
        return content
    lines = content.split("\n")
    paragraphs: list[list[str]] = [[]]
    carry: tuple[str, str, bool] | None = None
    broke = False
    for i, line in enumerate(lines):
        if i in junk:
            broke = True
            continue
        if not line.strip():
            # a blank line next to furniture may only be the page break
            if not broke and not (i + 1 < len(lines) and i + 1 in junk):
                paragraphs.append([])
            continue
        broke = False
        tokens = line.split()
        if carry and tokens:
            tokens[0] = carry[0] + ("" if carry[2] else carry[1]) + tokens[0]
        carry = None
        m = broken_end(line)
        if m and tokens and i in joins:
            carry = (tokens[-1][:-1], m[2], joins[i])
            tokens = tokens[:-1]
        paragraphs[-1] += tokens
    if carry:
        paragraphs[-1].append(carry[0] + carry[1])

    def fix(raw: str) -> str:
        w = core(raw)
        new = words.get(w)
        at = raw.lower().find(w) if new else -1
        if at < 0:
            return raw
        was = raw[at : at + len(w)]
        new = new.upper() if was.isupper() and len(was) > 1 else new.capitalize() if was[:1].isupper() else new
        return raw[:at] + new + raw[at + len(w) :]

    return "\n\n".join(" ".join(map(fix, p)) for p in paragraphs if p)


def repair(segments: DataFrame) -> DataFrame:
    """(seg_uid, text): each content as continuous paragraphs; null stays null, blank stays as it is."""
    s = analyse(segments)
    whole = F.when(F.col("joins"), F.concat("word", "right")).otherwise(F.concat("word", F.lit("-"), "right"))
    fixes = s.wrong.where("printed is not null").select("seg_uid", "word", "printed").unionByName(s.joins.where("printed is not null").select("seg_uid", whole.alias("word"), "printed")).distinct()
    junk = s.junk.groupBy("seg_uid").agg(F.collect_list("line_no").alias("junk"))
    joins = s.joins.groupBy("seg_uid").agg(F.collect_list(F.struct("line_no", "joins")).alias("joins"))
    words = fixes.groupBy("seg_uid").agg(F.collect_list(F.struct("word", "printed")).alias("words"))
    t = segments.select("seg_uid", "content").join(junk, "seg_uid", "left").join(joins, "seg_uid", "left").join(words, "seg_uid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(5)))
            text = [repaired(c, set(j or ()), {x["line_no"]: x["joins"] for x in o or ()}, {x["word"]: x["printed"] for x in w or ()}) for _, c, j, o, w in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["seg_uid", "text"])

    return t.select("seg_uid", "content", "junk", "joins", "words").mapInArrow(run, "seg_uid long, text string")
