"""Subject areas of documents: bisecting k-means over unit vectors, leaves labelled by discriminative terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import drop_staged, hot_join, stage

LEAVES = 96
ROUNDS = 5
# A term that more than this share of a language's units hold is no mark of an area.
COMMON = 0.25
# How many neutral observations are added to those of a term, and how far a term must tell areas apart.
NEUTRAL = 0.5
TELLING = 0.75
# Lead in log-odds that makes a unit sure, in learning and in assigning.
SURE = 4.0
LEAST = 3.0
# Share in a leaf's mixture that makes an area one of its subjects, and the weight that the terms which label
# the leaf have in the mixture, beside the votes of its members.
PART = 0.3
LABEL_TERMS = 6
LABEL_WEIGHT = 0.25
# Fewer terms than this (two words) are a heading or a scrap, no paragraph, table or record.
LEAST_TERMS = 4
# Steps of the grid over unit vectors, the same for inputs of any size.
GRID = 20

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?:;|\"{}\[\]]")
_CODE = re.compile(r"\b[\w]+(?:-[\w]+)*-\d\w*")
_SNAKE = re.compile(r"\b\w*_\w*\b")
_BREAK = re.compile(r"[\r\n\f\v  ]+")


def units(text: str | None) -> list[str]:
    """Whole paragraphs, tables and records of a text: its lines, with the rows of a table taken together,
    an answer with its question, and a line that stops in mid-sentence with the next."""
    out: list[str] = []
    kind = ""
    for line in _BREAK.split(text or ""):
        s = line.strip()
        if not s:
            continue
        now = "table" if s.startswith("|") else "answer" if s[:2] == "A:" else "text"
        if out and ((now == "table" and kind == "table") or (now == "answer" and out[-1][:2] == "Q:")):
            out[-1] += "\n" + s
        elif out and now == "text" == kind and (out[-1][-1].isalnum() or out[-1][-1] == ",") and out[-1][0] not in "[{" and s[0] not in "[{" and s[:2] != "Q:":
            out[-1] += " " + s
        else:
            out.append(s)
        kind = now
    return out


def terms(unit: str) -> list[str]:
    """Distinct words and pairs of neighbouring words of a unit, pairs only within a sentence."""
    found: set[str] = set()
    last = ""
    if "-" in unit:
        unit = _CODE.sub(" ", unit)
    if "_" in unit:
        unit = _SNAKE.sub(" ", unit)
    for w in _TOKEN.findall(unit.lower()):
        if not w[0].isalpha():
            last = ""
            continue
        found.add(w)
        if last:
            found.add(f"{last} {w}")
        last = w
    return list(found)


@dataclass
class Model:
    """What the terms of each language tell, the leaves over unit vectors and their mixtures of areas.

    Column 0 stands for none. ``labels`` are the discriminative terms of each leaf."""

    languages: list[str]
    slots: dict[str, int]
    speech: np.ndarray
    evidence: np.ndarray
    centroids: np.ndarray
    mixture: np.ndarray
    areas: list[int]
    labels: list[list[str]]

    def vectors(self, idx: np.ndarray, sizes: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Evidence of each unit for none and each area, by the terms of the unit's language."""
        lang = _tongues(self.speech.T, idx, sizes)
        out = _sums(self.evidence[np.repeat(lang, sizes), idx], sizes)
        out[width < LEAST_TERMS] = 0.0
        return out

    def leaves(self, idx: np.ndarray, sizes: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The leaf of each unit by its vector; -1 for one without evidence for an area."""
        v = self.vectors(idx, sizes, width)
        norm = np.linalg.norm(v, axis=1)
        ranked = np.sort(v, axis=1)
        top = v[:, 1:].max(axis=1, initial=-np.inf) - np.maximum(v[:, 0], 0.0)
        if v.shape[1] > 1:
            top = np.minimum(top, 3 * (ranked[:, -1] - ranked[:, -2]))
        has = (norm > 0) & (top >= LEAST)
        leaf = np.full(len(v), -1, dtype=np.int64)
        if has.any():
            leaf[has] = ((v[has] / norm[has, None]) @ self.centroids).argmax(axis=1)
        return leaf

    def subjects(self) -> list[list[int]]:
        """The areas of each leaf: those with a share of at least :data:`PART` in its mixture."""
        return [[self.areas[c - 1] for c in range(1, len(m)) if m[c] >= PART] for m in self.mixture]


def _bisect(sums: np.ndarray, weight: np.ndarray, leaves: int, rng: np.random.Generator, least: int = 8) -> np.ndarray:
    """Leaf of each cell of unit vectors (their sum and number): the leaf with the largest scatter is split
    in two by spherical 2-means until there are ``leaves`` of them or none can be split."""
    leaf = np.zeros(len(sums), dtype=np.int64)
    x = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)

    def scatter(ids: np.ndarray) -> float:
        return float(weight[ids].sum()) - float(np.linalg.norm(sums[ids].sum(axis=0)))

    def middle(ids: np.ndarray) -> np.ndarray:
        c = sums[ids].sum(axis=0)
        return c / max(np.linalg.norm(c), 1e-9)

    spread = {0: scatter(np.arange(len(x)))}
    while len(spread) < leaves:
        at = max(spread, key=lambda k: spread[k])
        if spread[at] <= 1e-6:
            break
        ids = np.flatnonzero(leaf == at)
        if weight[ids].sum() < 2 * least:
            spread[at] = 0.0
            continue
        a = x[ids[rng.integers(len(ids))]]
        a = x[ids[int((x[ids] @ a).argmin())]]
        b = x[ids[int((x[ids] @ a).argmin())]]
        side = np.zeros(len(ids), dtype=bool)
        for _ in range(12):
            now = x[ids] @ a < x[ids] @ b
            if (now == side).all() or now.all() or not now.any():
                side = now
                break
            side = now
            a, b = middle(ids[~side]), middle(ids[side])
        if side.all() or not side.any():
            spread[at] = 0.0
            continue
        new = int(leaf.max()) + 1
        leaf[ids[side]] = new
        spread[at], spread[new] = scatter(ids[~side]), scatter(ids[side])
    return leaf


KEY = ["k1", "k2", "k3"]


def unit_rows(documents: DataFrame) -> DataFrame:
    """(row, doc_id, unit, k1, k2, k3): every unit of every text with a key of 128 bits in place of its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(r, d, u) for r, d, t in zip(*(c.to_pylist() for c in b.columns)) for u in units(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["row", "doc_id", "unit"])

    rows = documents.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, "row long, doc_id long, unit string")
    return stage(rows.select("*", F.xxhash64("unit").alias("k1"), F.hash("unit").alias("k2"), F.length("unit").alias("k3")), "subject-rows")


def distinct_units(rows: DataFrame) -> DataFrame:
    """(k1, k2, k3, terms) of every unit once, cut into terms once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([terms(u) for u in b.column(3).to_pylist()], pa.list_(pa.string()))], names=[*KEY, "terms"])

    once = rows.select(*KEY, "unit").distinct()
    return stage(once.select(*KEY, "unit").mapInArrow(cut, "k1 long, k2 int, k3 int, terms array<string>"), "subject-texts")


def _vocabulary(all_units: DataFrame, examples: list[list[str]], least: int = 3) -> list[str]:
    """The terms of at least ``least`` units or labelled paragraphs, in order."""
    counts = all_units.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    own = Counter(t for d in examples for t in d)
    if own:
        counts = counts.unionByName(all_units.sparkSession.createDataFrame(list(own.items()), "term string, n long"))
    found = counts.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("term").toArrow()
    return sorted(found.column(0).to_pylist())


def _encoded(all_units: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """(ids, width, key) of each unit: its known terms by number, and how many terms it has in all."""
    shared = all_units.sparkSession.sparkContext.broadcast(pa.array(list(vocab), pa.string()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for b in batches:
            # numbers of all terms at once, then the unknown ones taken out of each row
            found = b.column(3)
            ids = pc.fill_null(pc.index_in(found.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
            width = np.diff(found.offsets.to_numpy())
            known = np.concatenate([[0], np.cumsum(ids >= 0)])
            ends = np.concatenate([[0], np.cumsum(width)])
            kept = pa.ListArray.from_arrays(pa.array(known[ends].astype(np.int32)), pa.array(ids[ids >= 0].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([kept, pa.array(width.astype(np.int32)), *b.columns[:3]], names=["ids", "width", *KEY])

    return stage(all_units.mapInArrow(encode, "ids array<int>, width int, k1 long, k2 int, k3 int"), "subject-units")


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows one after another, and how many each row has."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    return np.fromiter((j for r in rows for j in r), dtype=np.int64, count=int(sizes.sum())), sizes


def _column(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    c = b.column(0)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(c.offsets.to_numpy()).astype(np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    out = np.zeros((len(sizes), values.shape[1]))
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], axis=0)
    return out


def _tongues(speech: np.ndarray, idx: np.ndarray, sizes: np.ndarray, main: int | None = None) -> np.ndarray:
    """Language of each row by what its terms tell; rows that hardly tell it count to ``main`` if given."""
    heard = _sums(speech.T[idx], sizes)
    lang = heard.argmax(axis=1)
    if main is not None and heard.shape[1] > 1:
        ranked = np.sort(heard, axis=1)
        lang[ranked[:, -1] - ranked[:, -2] < 2.0] = main
    return lang


def _judged(x: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading area of each row and whether it is sure."""
    order = np.sort(x, axis=1)
    sure = (order[:, -1] - order[:, -2] >= SURE) & (width >= LEAST_TERMS) if x.shape[1] > 1 else np.zeros(len(x), dtype=bool)
    return x.argmax(axis=1), sure


def _cells(unit: np.ndarray, grid: int) -> np.ndarray:
    return np.rint(unit * grid).astype(np.int8)


def _counted(rows: DataFrame, keys: Any, size: int, shared: Any) -> np.ndarray:
    """How often each key below ``size`` comes up in all rows. ``keys`` gives the keys of a batch; they are
    counted batch by batch, then added up before and after the shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(shared)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = np.unique(keys(b, sent.value), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    got = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    out = np.zeros(size, dtype=np.int64)
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out


def _first_keys(b: pa.RecordBatch, s: tuple[np.ndarray, int | None, int]) -> np.ndarray:
    """Term by language, behind these the languages of the units."""
    speech, main, v = s
    idx, sizes = _column(b)
    lang = _tongues(speech, idx, sizes, main)
    return np.concatenate([np.repeat(lang, sizes) * v + idx, len(speech) * v + lang])


def _sure_keys(b: pa.RecordBatch, s: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Term by area and language in sure units, behind these the sure units by language and area."""
    speech, tables = s
    languages, v, k = tables.shape
    idx, sizes = _column(b)
    lang = _tongues(speech, idx, sizes)
    y, sure = _judged(_sums(tables[np.repeat(lang, sizes), idx], sizes), b.column(1).to_numpy(zero_copy_only=False))
    at = lang * k + y
    return np.concatenate([(np.repeat(at, sizes) * v + idx)[np.repeat(sure, sizes)], languages * k * v + at[sure]])


def _leaf_keys(b: pa.RecordBatch, m: Model) -> np.ndarray:
    """Term by leaf in the units that lie in one."""
    idx, sizes = _column(b)
    leaf = m.leaves(idx, sizes, b.column(1).to_numpy(zero_copy_only=False))
    of = np.repeat(leaf, sizes)
    return (of * len(m.slots) + idx)[of >= 0]


def _gathered(rows: DataFrame, speech: np.ndarray, tables: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of all units by cell and leading area: their sum, their number and the area.

    A cell is a place of a grid over the sphere, so what comes to the driver is bounded by the grid and
    the number of areas; every unit is in the sums, which are of whole millionths."""
    k = tables.shape[2]
    sent = rows.sparkSession.sparkContext.broadcast((speech, tables))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speech, tables = sent.value
        for b in batches:
            idx, sizes = _column(b)
            lang = _tongues(speech, idx, sizes)
            x = _sums(tables[np.repeat(lang, sizes), idx], sizes)
            norm = np.linalg.norm(x, axis=1)
            has = norm > 0
            unit = x[has] / norm[has, None]
            marks = np.concatenate([_cells(unit, grid), x[has].argmax(axis=1).astype(np.int8)[:, None]], axis=1)
            at, where = np.unique(marks, axis=0, return_inverse=True)
            total = np.zeros((len(at), k), dtype=np.int64)
            np.add.at(total, where.ravel(), np.rint(unit * 1e6).astype(np.int64))
            names = ["cell", "y", "n", *[f"s{c}" for c in range(k)]]
            cols = [pa.array([r.tobytes() for r in at], pa.binary()), pa.array(at[:, -1].astype(np.int32)), pa.array(np.bincount(where.ravel(), minlength=len(at)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(total[:, c]) for c in range(k)]], names=names)

    schema = "cell binary, y int, n long, " + ", ".join(f"s{c} long" for c in range(k))
    each = rows.mapInArrow(gather, schema).groupBy("cell", "y").agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(k)])
    got = each.orderBy("cell").toArrow()
    sent.destroy()
    sums = np.stack([got.column(f"s{c}").to_numpy() for c in range(k)], axis=1) / 1e6
    return sums, got.column("n").to_numpy().astype(float), got.column("y").to_numpy().astype(np.int64)


@dataclass
class Corpus:
    """The units of all documents, where they stand, and the model fitted on them."""

    rows: DataFrame
    encoded: DataFrame
    model: Model

    def assigned(self) -> DataFrame:
        """(key, leaf) of every distinct unit that lies in a leaf."""
        shared = self.encoded.sparkSession.sparkContext.broadcast(self.model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = shared.value.leaves(*_column(b), b.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(leaf, pa.int32())], names=[*KEY, "leaf"]).filter(pa.array(leaf >= 0))

        return stage(self.encoded.mapInArrow(run, "k1 long, k2 int, k3 int, leaf int"), "subject-leaves")

    def subjects(self) -> DataFrame:
        """(row, doc_id, subjects) of every unit in every text: the areas of its leaf, none for a unit in no leaf.

        Units that many texts share are met by a salted join."""
        spark = self.rows.sparkSession
        areas = spark.createDataFrame(list(enumerate(self.model.subjects())), "leaf int, subjects array<int>")  # one row a leaf
        keyed = self.assigned().join(F.broadcast(areas), "leaf").select(*KEY, "subjects")
        rows = self.rows.select("row", "doc_id", *KEY)
        return hot_join(rows, keyed, KEY, "left", spread=F.col("row")).select("row", "doc_id", F.coalesce("subjects", F.array().cast("array<int>")).alias("subjects"))


def fit_on(documents: DataFrame, examples: DataFrame, leaves: int = LEAVES, seed: int = 5) -> Corpus:
    """Fit on the labelled examples and all units of all documents.

    The labelled paragraphs say which terms tell areas apart, language by language; units that are sure
    by these terms lend their other terms the same meaning, for a few rounds. A unit's vector is the sum
    of what its terms tell, normalised. The vectors are clustered by bisecting k-means; a leaf's mixture
    is the share of areas among its members, labelled ones counting more, and its label are the terms
    that tell most for it.

    Units stay distributed: each round counts terms by language and area over all of them, and the
    clustering works on sums of all vectors by cell. The driver holds the labelled examples, the term
    table and the cells. A leaf is labelled by the terms that mark it; what these tell of the areas and
    what its members are make up its mixture, and the mixture says which areas its units are about.
    """
    labelled = [(r.area_id, r.lang or "", r.text) for r in examples.where("text is not null").orderBy("example_id").collect()]
    rng = np.random.default_rng(seed)
    areas = sorted({a for a, _, _ in labelled if a is not None})
    index = {None: 0} | {a: i + 1 for i, a in enumerate(areas)}
    k = len(areas) + 1
    languages = sorted({g for _, g, _ in labelled}) or [""]
    count = len(languages)
    docs = [terms(t) for *_, t in labelled]
    placed = unit_rows(documents)
    all_units = distinct_units(placed)
    names = _vocabulary(all_units, docs)
    vocab = {t: i for i, t in enumerate(names)}
    rows = _encoded(all_units, vocab)
    v = len(vocab)
    idx, sizes = _flat([sorted(vocab[t] for t in d if t in vocab) for d in docs])
    # language of each unit, by the labelled paragraphs
    tongue = np.array([languages.index(g) for _, g, _ in labelled], dtype=np.int64)
    spoken = np.bincount(np.repeat(tongue, sizes) * v + idx, minlength=count * v).reshape(count, v)
    told = np.bincount(tongue, minlength=count)

    def apart(spoken: np.ndarray, told: np.ndarray, some: float) -> np.ndarray:
        speech = np.log((spoken + some) / (told[:, None] + 2 * some))
        return speech - speech.mean(axis=0)

    # again by all units, so that the words of every unit tell its language
    def heard(speech: np.ndarray, main: int | None) -> tuple[np.ndarray, np.ndarray]:
        got = _counted(rows, _first_keys, count * v + count, (speech, main, v))
        return got[: count * v].reshape(count, v) + spoken, got[count * v :] + told

    speech = apart(*heard(apart(spoken, told, 0.05), int(told.argmax())), 0.5)
    held, members = heard(speech, None)
    share = held / np.maximum(1, members)[:, None]
    width = np.array([len(d) for d in docs])
    y = np.array([index[a] for a, *_ in labelled], dtype=np.int64)
    at = tongue * k + y
    own = np.bincount(np.repeat(at, sizes) * v + idx, minlength=count * k * v)
    own_size = np.bincount(at, minlength=count * k)
    tables = np.zeros((count, v, k))
    for r in range(ROUNDS + 1):
        got = _counted(rows, _sure_keys, count * k * (v + 1), (speech, tables)) if r else np.zeros(count * k * (v + 1), dtype=np.int64)
        counts = (got[: count * k * v] + own).reshape(count, k, v).astype(float)
        size = (got[count * k * v :] + own_size).reshape(count, k) + 1.0
        rate = counts / size[:, :, None]
        rate /= np.maximum(rate.sum(axis=1, keepdims=True), 1e-12)
        seen = counts.sum(axis=1, keepdims=True)
        post = (rate * seen + NEUTRAL / k) / (seen + NEUTRAL)
        tells = (post * np.log(post * k)).sum(axis=1)
        kept = (tells >= TELLING) & (share <= COMMON) & (seen[:, 0] > 0)
        tables = np.ascontiguousarray((np.log(post * k) * kept[:, None]).transpose(0, 2, 1))
    sums, weight, lead = _gathered(rows, speech, tables, GRID)
    mine = _sums(tables[np.repeat(tongue, sizes), idx], sizes)
    norm = np.linalg.norm(mine, axis=1)
    has = norm > 0
    sums = np.concatenate([mine[has] / norm[has, None], sums])
    votes = np.concatenate([np.full(int(has.sum()), 3.0), weight])
    weight = np.concatenate([np.ones(int(has.sum())), weight])
    lead = np.concatenate([y[has], lead])
    if not len(sums):
        sums, weight, votes, lead = np.zeros((1, k)), np.ones(1), np.ones(1), np.zeros(1, dtype=np.int64)
    leaf = _bisect(sums, weight, leaves, rng)
    n = int(leaf.max()) + 1
    mix = np.stack([np.bincount(leaf, weights=votes * (lead == c), minlength=n) for c in range(k)], axis=1)
    mix /= np.maximum(mix.sum(axis=1, keepdims=True), 1e-9)
    cent = np.stack([sums[leaf == c].sum(axis=0) for c in range(n)], axis=1)
    cent /= np.maximum(np.linalg.norm(cent, axis=0, keepdims=True), 1e-9)
    model = Model(languages, vocab, speech.T.astype(np.float32), tables.astype(np.float32), cent, mix, areas, [[] for _ in range(n)])
    # the terms that mark a leaf: far more usual among its units than among all, weighted by how many hold them
    inside = _counted(rows, _leaf_keys, n * v, model).reshape(n, v).astype(float) if v else np.zeros((n, 0))
    every = inside.sum(axis=0) + 1.0
    gain = inside * np.log((inside + 0.1) * (every.sum() + 1.0) / ((inside.sum(axis=1, keepdims=True) + 1.0) * every))
    tells = tables.sum(axis=0) / np.maximum((tables != 0).any(axis=2).sum(axis=0), 1)[:, None]
    for c in range(n):
        marks = [j for j in np.argsort(-gain[c], kind="stable")[:LABEL_TERMS].tolist() if gain[c, j] > 0]
        model.labels[c] = [names[j] for j in marks]
        if marks:
            told_by = tells[marks].sum(axis=0)
            told_by = np.exp(told_by - told_by.max())
            mix[c] = (1 - LABEL_WEIGHT) * mix[c] + LABEL_WEIGHT * told_by / told_by.sum()
    drop_staged(all_units)
    return Corpus(placed, rows, model)


def find_areas(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id, area_id): every area that at least one whole unit of a text is about.

    Null, empty and blank texts have none. Repeated texts and repeated rows count each. The model is
    fitted on all units; every unit of every text is assigned. Examples without any area are the
    units about none; without examples no area can be found.
    """
    found = fit_on(documents, examples).subjects().where("size(subjects) > 0")
    return found.select("row", "doc_id", F.explode("subjects").alias("area_id")).distinct().select("doc_id", "area_id")


def composition(documents: DataFrame, examples: DataFrame, areas: DataFrame) -> DataFrame:
    """The corpus by area: documents and units about each area (name 'none' for units about none); a unit about
    several areas counts for each."""
    found = fit_on(documents, examples).subjects()
    each = found.select("row", F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit(0)))).alias("area_id"))
    per = each.groupBy("row", "area_id").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("area_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_units"))
    return total.join(F.broadcast(areas.select("area_id", "area_name")), "area_id", "left").select("area_id", F.coalesce("area_name", F.lit("none")).alias("area_name"), "n_documents", "n_units")


def leaf_report(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(leaf, area_id, share, is_subject, n_units, terms): each leaf's mixture with the terms that label it and the number
    of distinct units in it (area 0 is none). As many rows as leaves times areas."""
    corpus = fit_on(documents, examples)
    m = corpus.model
    rows = [(i, 0 if c == 0 else m.areas[c - 1], round(float(x), 6), bool(c and x >= PART), ", ".join(m.labels[i])) for i, mix in enumerate(m.mixture) for c, x in enumerate(mix)]
    sizes = corpus.assigned().groupBy("leaf").agg(F.count(F.lit(1)).alias("n_units"))
    table = documents.sparkSession.createDataFrame(rows, "leaf int, area_id int, share double, is_subject boolean, terms string")
    return table.join(F.broadcast(sizes), "leaf", "left").select("leaf", "area_id", "share", "is_subject", F.coalesce("n_units", F.lit(0)).alias("n_units"), "terms")
