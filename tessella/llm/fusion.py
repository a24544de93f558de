"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import hot_join, stage

# Texts that, as a whole, only say that there is no value (letters and digits, lower case).
NO_VALUE = [
    "na", "n a", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "unknown", "unspecified", "undefined", "undisclosed", "unavailable",
    "missing", "empty", "blank", "not specified", "not available", "not applicable", "not provided", "not disclosed", "not reported",
    "not stated", "not known", "not given", "not defined", "not found", "no value", "no data", "no information", "to be determined",
    "to be confirmed", "to be announced", "to be defined",
]

# Times lie within +-_SHIFT microseconds (some 15,000 years), so a time and a row id fill 38 digits together.
_SHIFT = 5 * 10**17
_STEP, _LAST = f"{10**20}BD", f"{2**63 - 1}BD"


def text_counts(text: Column) -> Column:
    """Whether a text is a value: it has a letter or digit and is no way of saying that there is none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce((plain != "") & ~plain.isin(NO_VALUE), F.lit(False))


def value_counts(v: Column) -> Column:
    """The same for a JSON value: null never counts, a list if one of its elements does, an object always."""
    items = F.try_variant_get(v, "$", "array<variant>")
    is_object = F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()
    any_item = F.exists(items, lambda x: F.coalesce(~F.is_variant_null(x), F.lit(False)) & text_counts(F.try_variant_get(x, "$", "string")))
    return F.when(F.coalesce(F.is_variant_null(v), F.lit(True)), False).when(items.isNotNull(), any_item).when(is_object, True).otherwise(text_counts(F.try_variant_get(v, "$", "string")))


def instant(text: Column) -> Column:
    """Microseconds since 1970 (UTC) of a time in one of many notations; NULL if missing or unreadable.

    ISO dates and times with 'T' or a space, fractions, 'Z' or an offset; dates with slashes; '05 Jan
    2024 16:26:58'; seconds, milliseconds, microseconds or nanoseconds since 1970. Without a zone: UTC.
    """
    t = F.trim(text)
    iso = F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    zoned = F.regexp_like(iso, F.lit(r"([Zz]|UTC|GMT|[+-]\d{2}:?\d{2})$")) & F.regexp_like(iso, F.lit(r":"))
    with_zone = F.regexp_replace(F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"\s*(UTC|GMT)$", "Z")
    full = F.when(zoned, with_zone).when(F.regexp_like(iso, F.lit(r":")), F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit(" 00:00:00Z")))
    as_iso = F.when(F.regexp_like(iso, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}")), F.unix_micros(full.try_cast("timestamp")))
    named = F.when(F.regexp_like(t, F.lit(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}$")), F.unix_micros(F.try_to_timestamp(F.concat(F.initcap(t), F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss xx"))))
    n = F.when(F.regexp_like(t, F.lit(r"^\d{9,19}$")), t.try_cast("long"))
    size = F.length(t)
    epoch = F.when(size <= 11, n * 1_000_000).when(size <= 14, n * 1_000).when(size <= 17, n).otherwise(F.floor(n / 1000).cast("long"))
    return F.coalesce(F.when(n.isNotNull(), epoch), as_iso, named)


def claims(entities: DataFrame) -> DataFrame:
    """One row for each field that an upsert row with an id gives a value for, and one marker (null field)
    for the row itself: (doc_id, id, rec_id, at, field, value)."""
    rows = entities.where("op = 'upsert' and id is not null").select(
        "doc_id", "id", "rec_id", "label", F.try_variant_get(F.try_parse_json("properties"), "$", "map<string,variant>").alias("props"),
        instant(F.col("provenance")["extraction_timestamp"]).alias("at"), F.coalesce(F.col("provenance")["segment_id"], F.lit("")).alias("source"),
    )
    props = F.col("props")
    fields = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("variant").alias("value"))),
        F.when(text_counts(F.col("label")), F.array(F.struct(F.lit("label").alias("field"), F.to_variant_object(F.array("label")).alias("value")))).otherwise(F.array()),
        F.filter(F.coalesce(F.transform(F.map_entries(props), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"))), F.array()), lambda e: value_counts(e["value"])),
    )
    at = F.when(F.col("at").isNull(), -_SHIFT).otherwise(F.greatest(F.lit(-_SHIFT + 1), F.least(F.lit(_SHIFT - 1), F.col("at"))))
    return rows.select("doc_id", "id", "rec_id", at.alias("at"), "source", F.explode(fields).alias("f")).select("doc_id", "id", "rec_id", "at", "source", "f.field", "f.value")


def latest(entities: DataFrame) -> DataFrame:
    """(keep_id, field, rec_id): per group and field the row with the latest value that counts.

    A missing or unreadable time is older than all others; of equal times the smallest ``rec_id`` wins.
    Groups are two or more upsert rows of one ``doc_id`` and non-null ``id``; a null ``doc_id`` is a group
    key like any other. Properties that are null, unreadable or no object give no fields. Each
    (group, field) is reduced before the shuffle to a single number, so a hot group costs one row per
    task. Empty input gives no rows.
    """
    # time and row in one number, so that the aggregate stays hash-based: the larger is the later, then the smaller id
    rank = F.expr(f"CAST(CAST(at + {_SHIFT} AS DECIMAL(18,0)) * {_STEP} + ({_LAST} - CAST(rec_id AS DECIMAL(19,0))) AS DECIMAL(38,0))")
    per_field = (
        claims(entities)
        .groupBy("doc_id", "id", "field")
        .agg(F.max(rank).alias("best"), F.min("rec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    group = Window.partitionBy("doc_id", "id")
    marked = per_field.withColumn("keep_id", F.max(F.when(F.col("field").isNull(), F.col("first"))).over(group)).withColumn("rows", F.max(F.when(F.col("field").isNull(), F.col("n"))).over(group))
    rec = F.expr(f"CAST({_LAST} - CAST(right(lpad(CAST(best AS STRING), 38, '0'), 20) AS DECIMAL(20,0)) AS BIGINT)")
    return marked.where("field is not null and rows >= 2").select("keep_id", "field", rec.alias("rec_id"))


# Bayesian fusion: how many false values an item may have, the share of its values that a copier copies, how likely
# two sources depend on each other before anything is seen, accuracy before anything is known.
FALSE_VALUES = 10
COPIED = 0.8
DEPENDENT = 0.2
START = 0.8
# A pair of sources is looked at once it shares this many values; rounds end when no accuracy moves by more.
LEAST_SHARED = 2
SETTLED = 0.01
ROUNDS = 6
ITEM = ["keep_id", "field"]
SOURCE = ["doc_id", "source"]


def _votes(entities: DataFrame) -> DataFrame:
    """(keep_id, field, vid, doc_id, source, first, seen): who says what. One row for each source and value of an item;
    ``vid`` is the first row that gave the value and stands for it, ``first`` the source that gave it first.

    A source is a segment of a document; rows without a segment speak for themselves and are no source."""
    text = F.when(F.col("field") == "label", F.try_variant_get("value", "$[0]", "string")).otherwise(F.to_json("value"))
    base = stage(claims(entities).select("doc_id", "id", "rec_id", "at", F.nullif("source", F.lit("")).alias("source"), "field", text.alias("value")), "claims")
    groups = base.where("field is null").groupBy("doc_id", "id").agg(F.min("rec_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("doc_id", "id", "keep_id")
    said = hot_join(base.where("field is not null"), groups, ["doc_id", "id"], "inner", spread=F.col("rec_id"))
    said = said.withColumn("voter", F.coalesce("source", F.concat(F.lit("\0"), F.col("rec_id").cast("string"))))
    one = stage(said.groupBy("keep_id", "field", "value", "doc_id", "source", "voter").agg(F.min(F.struct("at", "rec_id")).alias("born"), F.max("at").alias("seen")), "votes")
    values = one.groupBy(*ITEM, "value").agg(F.min("born.rec_id").alias("vid"), F.min(F.struct("born", "source"))["source"].alias("first"))
    return stage(hot_join(one, values, [*ITEM, "value"], "inner", spread=F.xxhash64("voter")).select(*ITEM, "value", "vid", *SOURCE, "first", "seen"), "told")


def _choose(votes: DataFrame, weight: Column) -> DataFrame:
    """The value of maximum posterior of each item: votes are log-odds; ties go to the later, then to the earlier row."""
    scores = votes.groupBy(*ITEM, "vid").agg(F.round(F.sum(weight), 9).alias("score"), F.max("seen").alias("seen"))
    best = F.max(F.struct("score", "seen", (-F.col("vid")).alias("v")))
    return scores.groupBy(*ITEM).agg(best.alias("b"), F.count(F.lit(1)).alias("n_values")).select(*ITEM, (-F.col("b.v")).alias("chosen"), "n_values")


def _overlaps(votes: DataFrame) -> DataFrame:
    """(doc_id, source, first, differ): pairs of sources of a document of which one gave at least :data:`LEAST_SHARED`
    values after the other, and the items on which both speak and differ.

    A value's voters are only held against the one who said it first, so a value of n voters makes n - 1
    pairs. Overlaps are counted for these pairs alone."""
    mine = votes.where("source is not null").select(*ITEM, *SOURCE, "vid", "first")
    pairs = mine.where("first is not null and first <> source").groupBy(*SOURCE, "first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SHARED).drop("n")
    pairs = stage(pairs, "copiers")
    items = mine.select(*ITEM, *SOURCE, "vid")
    met = stage(items.join(pairs, SOURCE), "copier-items")
    other = items.select(*ITEM, "doc_id", F.col("source").alias("first"), F.col("vid").alias("other"))
    both = met.join(other, [*ITEM, "doc_id", "first"]).groupBy("doc_id", "source", "first", *ITEM).agg(F.max((F.col("vid") == F.col("other"))).alias("same"))
    return stage(pairs.join(both.groupBy(*SOURCE, "first").agg(F.count_if(~F.col("same")).alias("differ")), [*SOURCE, "first"], "left").na.fill(0, ["differ"]), "overlaps")


def _dependence(judged: DataFrame, overlaps: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(doc_id, source, first, dep): how likely the source copies from the other one.

    Two sources that share false values are more likely to depend on each other than two that share true
    ones: independent sources agree on the truth anyway, but rarely on one of many false values."""
    shared = judged.where("source is not null and first is not null and first <> source").groupBy(*SOURCE, "first").agg(F.count_if("right").alias("kt"), F.count_if(~F.col("right")).alias("kf"))
    of = accuracy.select("doc_id", F.col("source").alias("first"), F.col("a").alias("a0"))
    t = overlaps.join(shared, [*SOURCE, "first"]).join(accuracy, SOURCE).join(of, ["doc_id", "first"])
    a, b = F.col("a"), F.col("a0")
    same_true, same_false = a * b, (1 - a) * (1 - b) / FALSE_VALUES
    true_if, false_if = b * COPIED + (1 - COPIED) * same_true, (1 - b) * COPIED + (1 - COPIED) * same_false
    log_ratio = F.col("kt") * F.log(true_if / same_true) + F.col("kf") * F.log(false_if / same_false) + F.col("differ") * math.log(1 - COPIED) + math.log(DEPENDENT / (1 - DEPENDENT))
    return t.select(*SOURCE, "first", (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), log_ratio))))).alias("dep"))


def fuse(entities: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(keep_id, field, value, rec_id, n_values): the value of maximum posterior, field by field.

    Accuracies of the sources, dependence between them and the values chosen are estimated from each other
    until the accuracies settle (or ``rounds`` are over). The vote of a source that likely copies from the one
    that gave the value first counts less. Items with one value only need no votes and are left out of
    the rounds. Groups and values as in :func:`latest`; rows without a segment vote with the accuracy that
    sources start with. Empty input gives no rows."""
    told = _votes(entities)
    sizes = stage(told.groupBy(*ITEM).agg(F.count_distinct("vid").alias("n"), F.min("vid").alias("only")), "items")
    alone = sizes.where("n = 1").select(*ITEM, F.col("only").alias("chosen"), F.lit(1).cast("long").alias("n_values"))
    disputed = sizes.where("n > 1").select(*ITEM, F.lit(True).alias("_d"))
    votes = stage(hot_join(told, disputed, ITEM, "inner", spread=F.xxhash64("source", "vid")).drop("_d", "value"), "disputed")
    overlaps = _overlaps(votes)
    accuracy = stage(votes.where("source is not null").select(*SOURCE).distinct().withColumn("a", F.lit(START)), "accuracy")

    def judge(chosen: DataFrame) -> DataFrame:
        return stage(hot_join(votes, chosen.select(*ITEM, "chosen"), ITEM, "inner", spread=F.xxhash64("source", "vid")).withColumn("right", F.col("vid") == F.col("chosen")).drop("chosen"), "judged")

    # dependence is looked for before any value is believed, as if all were right: copies of a bad source
    # would vouch for it, and the good ones would look like copies of each other
    dependence = stage(_dependence(votes.withColumn("right", F.lit(True)), overlaps, accuracy), "dependence")
    chosen = votes.select(*ITEM, F.col("vid").alias("chosen"), F.lit(0).cast("long").alias("n_values")).limit(0)
    for _ in range(rounds):
        scored = stage(hot_join(votes, accuracy, SOURCE, "left", spread=F.col("vid")), "scored")
        scored = scored.join(dependence, [*SOURCE, "first"], "left")
        a = F.coalesce("a", F.lit(START))
        weight = (1 - COPIED * F.coalesce("dep", F.lit(0.0))) * F.log(FALSE_VALUES * a / (1 - a))
        chosen = stage(_choose(scored, weight), "chosen")
        judged = judge(chosen)
        # smoothed: every source starts with eight right votes of ten
        share = (F.count_if("right") + 10 * START) / (F.count(F.lit(1)) + 10)
        new = stage(judged.where("source is not null").groupBy(*SOURCE).agg(F.least(F.lit(0.99), F.greatest(F.lit(0.2), share)).alias("a")), "accuracy")
        moved = new.join(accuracy.withColumnRenamed("a", "was"), SOURCE).agg(F.max(F.abs(F.col("a") - F.col("was")))).first()[0]
        dependence = stage(_dependence(judged, overlaps, new), "dependence")
        accuracy = new
        if moved is None or moved <= SETTLED:
            break
    both = chosen.select(*ITEM, "chosen", "n_values").unionByName(alone)
    texts = told.groupBy(*ITEM, "vid").agg(F.any_value("value").alias("value"))
    out = texts.join(both.withColumnRenamed("chosen", "vid"), [*ITEM, "vid"])
    return out.select("keep_id", "field", "value", F.col("vid").alias("rec_id"), "n_values")
