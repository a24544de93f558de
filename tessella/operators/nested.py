"""Deeply nested semi-structured records as related flat tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import stage

FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
BRACES = r"(?s)\{.*\}"


def read_json(text: Column) -> Column:
    """A raw model answer as VARIANT: the whole text, else the fenced part, else from the first brace to
    the last. Null, blank or broken answers give NULL. A JSON list or scalar parses, but is no object."""
    whole = F.try_parse_json(text)
    fenced = F.try_parse_json(F.regexp_extract(text, FENCE, 1))
    braced = F.try_parse_json(F.regexp_extract(text, BRACES, 0))
    return F.coalesce(as_object(whole), as_object(fenced), as_object(braced))


def read_answers(df: DataFrame, text: str, name: str) -> DataFrame:
    """:func:`read_json` as a column. The wrapped forms are only tried where the whole text is no object."""
    t = df.withColumn("_whole", F.try_parse_json(text)).withColumn(name, as_object(F.col("_whole")))
    rest = F.when(F.col(name).isNull(), F.col(text))
    t = t.withColumn("_fenced", F.try_parse_json(F.regexp_extract(rest, FENCE, 1))).withColumn(name, F.coalesce(name, as_object(F.col("_fenced"))))
    t = t.withColumn("_braced", F.try_parse_json(F.regexp_extract(F.when(F.col(name).isNull(), F.col(text)), BRACES, 0))).withColumn(name, F.coalesce(name, as_object(F.col("_braced"))))
    return t.drop("_whole", "_fenced", "_braced")


def as_object(v: Column) -> Column:
    """The variant if it is an object, else NULL."""
    return F.when(F.try_variant_get(v, "$", "struct<_:variant>").isNotNull(), v)


def field_of(v: Column, name: str) -> Column:
    """A field of a variant object; NULL when absent, also NULL when JSON null."""
    got = F.try_variant_get(v, f"$['{name}']", "variant")
    return F.when(~F.coalesce(F.is_variant_null(got), F.lit(True)), got)


def has_key(v: Column, name: str) -> Column:
    """Whether the key is there, be its value null or not."""
    return F.try_variant_get(v, f"$['{name}']", "variant").isNotNull()


def as_list(v: Column) -> Column:
    """An array<variant>: a list as it is, a single value as a list of one, NULL or JSON null as NULL."""
    plain = F.when(~F.coalesce(F.is_variant_null(v), F.lit(True)), v)
    return F.coalesce(F.try_variant_get(plain, "$", "array<variant>"), F.when(plain.isNotNull(), F.array(plain)))


# Kinds of value as bits, so that kinds met in different tasks are merged by an OR.
OBJECT, ARRAY, STRING, INTEGER, NUMBER, BOOLEAN, NULL, BIG = (1 << i for i in range(8))
# An object with more different keys than this holds data in its keys: these are one map, no set of fields. Its
# entries are rows of a level of their own where lists lie below.
MAP_KEYS = 1_000
MAP, ITEM = "{}", "[]"


@dataclass
class Node:
    """A place of the merged schema: the kinds of value found there and the places below.

    Elements of a list count as values of the place itself, since a single value may stand for a list of
    one; only lists directly in lists have a place of their own (``[]``). Fields of a map are one (``{}``), but
    for those on the paths ``known``, which are fields by contract."""

    kinds: int = 0
    below: dict[str, "Node"] = field(default_factory=dict)
    known: tuple[tuple[str, ...], ...] = ()

    def child(self, key: str) -> "Node":
        found = self.below.get(key)
        if found is None:
            found = self.below[key] = Node(known=tuple(p[1:] for p in self.known if len(p) > 1 and p[0] == key))
        return found

    def named(self, key: str) -> bool:
        return any(p[0] == key for p in self.known)

    def add(self, other: "Node") -> None:
        self.kinds |= other.kinds
        for key, node in other.below.items():
            self.child(key).add(node)

    def fold(self) -> None:
        """Turn the fields of maps into one."""
        fields = [k for k in self.below if k not in (MAP, ITEM) and not self.named(k)]
        if len(fields) > MAP_KEYS or MAP in self.below:
            whole = self.child(MAP)
            for k in fields:
                whole.add(self.below.pop(k))
        for node in self.below.values():
            node.fold()

    def split(self) -> None:
        """Lists that are values of a map get a place of their own below it, single values being lists of one."""
        for key, node in self.below.items():
            node.split()
            if key == MAP and node.kinds & ARRAY:
                node.kinds, node.below = ARRAY, {ITEM: Node(node.kinds, node.below)}

    def paths(self, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], int]]:
        yield at, self.kinds
        for key, node in self.below.items():
            yield from node.paths((*at, key))


_SCALAR = {str: STRING, bool: BOOLEAN, float: NUMBER, type(None): NULL}


def _see(x: object, node: Node, texts: tuple[str, ...]) -> None:
    """Take a value into the schema. A stack, since records may be nested to any depth."""
    todo = [(x, node)]
    while todo:
        x, node = todo.pop()
        t = type(x)
        if t is dict:
            node.kinds |= OBJECT
            if len(node.below) > 2 * MAP_KEYS:
                node.fold()
            for key, v in x.items():
                c = node.child(MAP if MAP in node.below and not node.named(key) else key)
                tv = type(v)
                if tv is str and key in texts and v.lstrip()[:1] == "{":
                    try:
                        inner = json.loads(v)
                    except ValueError:
                        inner = v
                    v, tv = (inner, dict) if type(inner) is dict else (v, str)
                if tv is dict or tv is list:
                    todo.append((v, c))
                elif tv is int:
                    c.kinds |= INTEGER if abs(v) <= 2**53 else BIG
                else:
                    c.kinds |= _SCALAR[tv]
        elif t is list:
            node.kinds |= ARRAY
            for v in x:
                todo.append((v, node.child(ITEM) if type(v) is list else node))
        else:
            node.kinds |= (INTEGER if abs(x) <= 2**53 else BIG) if t is int else _SCALAR[t]


def infer_shape(df: DataFrame, doc: str, texts: tuple[str, ...] = (), known: list[tuple[str, ...]] = ()) -> Node:
    """The merged schema of a VARIANT column.

    Fields in ``texts`` may be JSON text of an object and count as the object in it, those on paths ``known`` are
    never taken into a map. Each task merges its
    rows and sends every place once; objects with open key sets are folded into maps, so what reaches
    the driver is bounded by the schema, not by the data."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Node(known=tuple(known))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                _see(json.loads(text), root, texts)
        root.fold()
        found = [("\x1f".join(p), k) for p, k in root.paths()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())], names=["path", "kinds"])

    found = df.where(F.col(doc).isNotNull()).select(F.to_json(doc).alias("t")).mapInArrow(scan, "path string, kinds int").groupBy("path").agg(F.bit_or("kinds").alias("kinds"))
    root = Node(known=tuple(known))
    for r in found.toLocalIterator():
        node = root
        for step in r.path.split("\x1f") if r.path else ():
            node = node.child(step)
        node.kinds |= r.kinds
    root.fold()
    root.split()
    return root


def array_levels(shape: Node, known: list[tuple[str, ...]] = (), texts: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of the places that hold a list somewhere, parents first. ``known`` are lists by contract and
    count wherever the schema has the place, even if this input only holds single values there. Fields in
    ``texts`` are objects by contract and no levels. A map (``{}``) with a list anywhere below is a level too, of
    which each entry is a row, so that the lists in it have a row above them."""
    places = list(shape.paths())
    above = {p[: i + 1] for p, kinds in places if kinds & ARRAY for i, step in enumerate(p) if step == MAP}
    return sorted((p for p, kinds in places if p and p[-1] not in texts and (kinds & ARRAY or p in known or p in above)), key=lambda p: (len(p), p))


def depth(level: tuple[str, ...], levels: list[tuple[str, ...]]) -> int:
    """How many ordinals a row of a level has."""
    return sum(level[: len(x)] == x for x in levels)


def member(v: Column, key: str) -> Column:
    """A field of a variant object by its exact name."""
    if key and "'" not in key and "?" not in key:
        return F.try_variant_get(v, f"$['{key}']", "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def _each(v: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is neither absent nor null, evaluated once; else an empty array."""
    return F.flatten(F.transform(F.filter(F.array(v), lambda x: x.isNotNull() & ~F.is_variant_null(x)), then))


def explode_levels(
    df: DataFrame, key: str, doc: str, shape: Node, levels: list[tuple[str, ...]], records: list[tuple[str, ...]] = (), texts: tuple[str, ...] = (), only: list[tuple[str, ...]] | None = None, values: bool = True,
) -> DataFrame:
    """(key, level, pos1, pos2, ...[, value]): the elements of every array level of the schema, in one pass.

    The tree of levels becomes one expression on the record: each level runs over its list and, for each
    element, over the levels below, so the parent's key and all ordinals above are at hand. ``level`` is
    the place in ``levels``, unused ordinals are -1. A single value is a list of one; null elements give
    no row but later ones keep their ordinal. Lists at ``records`` hold objects only; other elements
    give no row. Fields in ``texts`` may be JSON text of an object. Entries of a map run in the order of their
    keys; their value is an object of ``key`` and ``value``. ``only`` names the levels wanted."""
    wanted = levels if only is None else [x for x in levels if x in only]
    deepest = max((depth(x, levels) for x in levels), default=1)
    row = "struct<level:int," + ",".join(f"pos{i + 1}:int" for i in range(deepest)) + (",value:variant>" if values else ">")
    none = F.array().cast(f"array<{row}>")

    def leads(path: tuple[str, ...]) -> bool:
        return any(x[: len(path)] == path for x in wanted)

    def fields(v: Column, node: Node, path: tuple[str, ...], pos: list[Column]) -> list[Column]:
        out = []
        for k, child in sorted(node.below.items()):
            at = (*path, k)
            if k in (MAP, ITEM) or not leads(at):
                continue
            below = partial(place, node=child, path=at, pos=pos)
            if k in texts:
                text = lambda p: F.coalesce(as_object(p), as_object(F.try_parse_json(F.try_variant_get(p, "$", "string"))))
                out.append(_each(member(v, k), lambda p: _each(text(p), lambda o: below(o))))  # noqa: B023 - called at once
            else:
                out.append(_each(member(v, k), lambda p: below(p)))  # noqa: B023
        if MAP in node.below and leads((*path, MAP)):
            own = [k for k in node.below if k not in (MAP, ITEM)]
            all_entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
            out.append(F.coalesce(entries(F.filter(all_entries, lambda e: ~e["key"].isin(own)), node.below[MAP], (*path, MAP), pos), none))
        return out

    def entries(items: Column, node: Node, path: tuple[str, ...], pos: list[Column]) -> Column:
        def one(e: Column, i: Column) -> Column:
            here = [*pos, i]
            x = F.when(e["key"].isin(list(texts)), F.coalesce(as_object(F.try_parse_json(F.try_variant_get(e["value"], "$", "string"))), e["value"])).otherwise(e["value"])
            parts = []
            if path in wanted:
                parts.append(F.array(row_of(path, here, F.to_variant_object(F.struct(e["key"].alias("key"), x.alias("value"))))))
            inner = (*path, ITEM)
            if ITEM in node.below and leads(inner):
                parts.append(elements(F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x)), node.below[ITEM], inner, here))
            parts += fields(x, node, path, here)
            return F.when(x.isNotNull() & ~F.is_variant_null(x), F.concat(*parts)).otherwise(none)

        return F.flatten(F.transform(items, one))

    def row_of(path: tuple[str, ...], here: list[Column], value: Column) -> Column:
        ordinals = [*here, *[F.lit(-1)] * (deepest - len(here))]
        return F.struct(F.lit(levels.index(path)).alias("level"), *[p.alias(f"pos{n + 1}") for n, p in enumerate(ordinals)], *([value.alias("value")] if values else []))

    def place(v: Column, node: Node, path: tuple[str, ...], pos: list[Column]) -> Column:
        if path in levels:
            items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
            return elements(items, node, path, pos)
        parts = fields(v, node, path, pos)
        return F.concat(*parts) if parts else none

    def elements(items: Column, node: Node, path: tuple[str, ...], pos: list[Column]) -> Column:
        def one(x: Column, i: Column) -> Column:
            here = [*pos, i]
            parts = []
            if path in wanted:
                parts.append(F.array(row_of(path, here, x)))
            parts += fields(x, node, path, here)
            inner = (*path, ITEM)
            if ITEM in node.below and leads(inner):
                parts.append(F.coalesce(elements(F.try_variant_get(x, "$", "array<variant>"), node.below[ITEM], inner, here), none))
            good = x.isNotNull() & ~F.is_variant_null(x)
            if path in records:
                good = good & as_object(x).isNotNull()
            return F.when(good, F.concat(*parts)).otherwise(none)

        return F.flatten(F.transform(items, one))

    parts = fields(F.col(doc), shape, (), [])
    rows = F.concat(*parts) if parts else none
    return df.where(F.col(doc).isNotNull()).select(F.col(key), F.inline(rows.cast(f"array<{row}>") if not values else rows))


TYPES = {STRING: "string", INTEGER: "long", NUMBER: "double", INTEGER | NUMBER: "double", BOOLEAN: "boolean"}


def table_fields(shape: Node, level: tuple[str, ...], levels: list[tuple[str, ...]]) -> dict[tuple[str, ...], str]:
    """Columns of a level: each scalar place below it outside the levels further down, with its type by the
    merged schema; ``variant`` where kinds are mixed, for maps, and where only nulls were found."""
    node = shape
    for step in level:
        node = node.below[step]
    found: dict[tuple[str, ...], str] = {}

    def visit(n: Node, path: tuple[str, ...]) -> None:
        kinds = n.kinds & ~(NULL | (ARRAY if not path else 0))
        if MAP in n.below:
            found[path] = "variant"
            return
        if not kinds or kinds & ~(OBJECT | ARRAY):
            found[path] = TYPES.get(kinds, "variant")
        for k, c in n.below.items():
            if k != ITEM and (*level, *path, k) not in levels:
                visit(c, (*path, k))

    visit(node, ())
    if level[-1] == MAP:
        inner = {} if ITEM in node.below else {("value", *path): kind for path, kind in found.items()}
        return {("key",): "string"} | dict(sorted(inner.items()))
    if () in found and len(found) > 1 and not node.kinds & ~(OBJECT | ARRAY | NULL):
        del found[()]
    return dict(sorted(found.items()))


def flat_table(rows: DataFrame, key: str, shape: Node, level: tuple[str, ...], levels: list[tuple[str, ...]], texts: tuple[str, ...] = ()) -> DataFrame:
    """A level as a table: key, ordinals and a typed column for each scalar place; names are the path joined
    by '.', ``value`` for scalar elements, with a number behind a name that is taken (upper and lower case
    count as one). Children join their parents on key and ordinals."""
    keys = [key, *[f"pos{i + 1}" for i in range(depth(level, levels))]]
    taken = {k.lower() for k in keys}
    columns = []
    for path, kind in table_fields(shape, level, levels).items():
        name, n = ".".join(path) or "value", 1
        while name.lower() in taken:
            n += 1
            name = f"{'.'.join(path) or 'value'}#{n}"
        taken.add(name.lower())
        v = F.col("value")
        for step in path:
            v = member(v, step)
            if step in texts:
                v = F.coalesce(as_object(v), as_object(F.try_parse_json(F.try_variant_get(v, "$", "string"))), v)
        plain = F.when(~F.coalesce(F.is_variant_null(v), F.lit(True)), v)
        columns.append((plain if kind == "variant" else F.try_variant_get(plain, "$", kind)).alias(name))
    return rows.where(F.col("level") == levels.index(level)).select(*keys, *columns)


ENTITIES, RELATIONSHIPS = ("entities",), ("relationships",)
PROVENANCE = ("entities", "provenance")
INPUTS = ("entities", "properties", "input_variables")
DISAGGREGATIONS = ("entities", "properties", "disaggregations")
MEMBERS = (*DISAGGREGATIONS, "members")
KINDS = {ENTITIES: "entity", RELATIONSHIPS: "relationship", PROVENANCE: "provenance", INPUTS: "input_variable", DISAGGREGATIONS: "disaggregation", MEMBERS: "disaggregation_member"}
TEXTS = ("properties",)
RECORDS = [ENTITIES, RELATIONSHIPS]


def choose_graph(answer: Column) -> Column:
    """The graph of a payload: the baseline experiment if its key is there, else the top level if it has
    entities, else none."""
    experiments = F.try_variant_get(answer, "$.experiments", "variant")
    baseline = F.try_variant_get(answer, "$.experiments['2_baseline_llm']", "variant")
    return F.when(as_object(experiments).isNotNull() & baseline.isNotNull(), as_object(baseline)).when(has_key(answer, "entities"), answer)


def payload_graphs(payloads: DataFrame, baseline: bool = False) -> DataFrame:
    """(payload_id, doc_id, graph) of every payload that holds one, or only of those whose graph comes from the
    baseline experiment."""
    # no filter before the write: it would be pushed below and read every payload twice
    read = read_answers(payloads, "payload", "answer")
    named = F.try_variant_get("answer", "$.experiments['2_baseline_llm']", "variant").isNotNull()
    graphs = stage(read.select("payload_id", "doc_id", choose_graph(F.col("answer")).alias("graph"), named.alias("_baseline")), "payload-graphs")
    kept = graphs.where("graph is not null and _baseline") if baseline else graphs.where("graph is not null")
    return kept.drop("_baseline")


@dataclass
class Payloads:
    """The graphs of all payloads with their merged schema and its array levels."""

    graphs: DataFrame
    shape: Node
    levels: list[tuple[str, ...]]

    def rows(self, only: list[tuple[str, ...]] | None = None, values: bool = True) -> DataFrame:
        return explode_levels(self.graphs, "payload_id", "graph", self.shape, self.levels, RECORDS, TEXTS, only, values)

    def table(self, level: tuple[str, ...]) -> DataFrame:
        """The flat table of a level; of a level of the contract that this input lacks, one without rows."""
        if level not in self.levels:
            above = [x for x in KINDS if level[: len(x)] == x]
            return self.graphs.limit(0).select("payload_id", *[F.lit(-1).alias(f"pos{i + 1}") for i in range(len(above))])
        return flat_table(self.rows([level]), "payload_id", self.shape, level, self.levels, TEXTS)


def read_payloads(payloads: DataFrame) -> Payloads:
    """Read and choose the graphs, infer their merged schema, and take its array levels."""
    graphs = payload_graphs(payloads)
    shape = infer_shape(graphs, "graph", TEXTS, list(KINDS))
    return Payloads(graphs, shape, array_levels(shape, list(KINDS), TEXTS))


def payload_rows(payloads: DataFrame) -> DataFrame:
    """(payload_id, kind, pos1, pos2, pos3) of the six kinds of nested rows; unused positions are -1.

    Null, blank, broken and failed payloads give no rows; an input without any graph has none at all."""
    p = read_payloads(payloads)
    rows = p.rows(list(KINDS), values=False)
    kind = F.coalesce(*[F.when(F.col("level") == i, F.lit(KINDS[x])) for i, x in enumerate(p.levels) if x in KINDS], F.lit(None).cast("string"))
    pos = [F.col(f"pos{i}") if f"pos{i}" in rows.columns else F.lit(-1).alias(f"pos{i}") for i in (1, 2, 3)]
    return rows.select("payload_id", kind.alias("kind"), *pos)


def level_counts(payloads: DataFrame) -> DataFrame:
    """(level, n_rows, n_payloads) of every array level of the merged schema, by its path."""
    p = read_payloads(payloads)
    name = F.coalesce(*[F.when(F.col("level") == i, F.lit(".".join(x))) for i, x in enumerate(p.levels)], F.lit(None).cast("string"))
    per = p.rows(values=False).groupBy("level", "payload_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(name.alias("level")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_payloads"))
