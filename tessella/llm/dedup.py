"""Duplicates hidden by formatting: rolling hashes over folded characters, verified by skipping comparison."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import hot_join, stage

# Two primes below 2^31: a product of a residue and a code point stays below 2^53, sums below 2^63.
PRIMES = (2_147_483_629, 2_147_483_587)
BASES = (1_000_003, 1_299_721)


@cache
def fold_table() -> np.ndarray:
    """Code point -> folded code point for letters and digits, 0 for what is skipped."""
    table = np.zeros(0x110000, dtype=np.int64)
    for cp in range(0x110000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind[0] == "L" or kind == "Nd":
            low = ch.casefold()
            table[cp] = ord(low if len(low) == 1 else ch.lower()[0])
    return table


def _points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one run and the bounds of each row in it. Null is as empty."""
    arr = arr.cast(pa.large_string()).fill_null("")
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    text = raw.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, starts[offs - offs[0]]


def kept(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, pointers to the kept ones, bounds of each row among the pointers)."""
    points, bounds = _points(arr)
    keep = fold_table()[points] > 0
    ranks = np.concatenate(([0], np.cumsum(keep)))
    return points, np.flatnonzero(keep), ranks[bounds]


def poly_hash(arr: pa.Array) -> np.ndarray:
    """A 62-bit polynomial hash of the kept, folded characters of each text; -1 if there is none."""
    points, at, bounds = kept(arr)
    counts = np.diff(bounds)
    place = np.arange(len(at)) - np.repeat(bounds[:-1], counts)
    code = fold_table()[points[at]]
    longest = int(counts.max(initial=0))
    halves = []
    for prime, base in zip(PRIMES, BASES):
        powers = np.ones(max(longest, 1), dtype=np.int64)
        n = 1
        while n < longest:  # doubling: powers[n:2n] = powers[:n] * base^n
            step = pow(base, n, prime)
            m = min(n, longest - n)
            powers[n : n + m] = powers[:m] * step % prime
            n += m
        run = np.concatenate(([0], np.cumsum(code * powers[place] % prime)))
        halves.append((run[bounds[1:]] - run[bounds[:-1]] + counts) % prime)
    return np.where(counts > 0, (halves[0] << 31) | halves[1], -1)


def skip_equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Two-pointer comparison of ``a`` and ``b`` row by row: both pointers move from kept character to
    kept character, and the folded characters under them must agree to the end."""
    pa_, at_a, bounds_a = kept(a)
    pb_, at_b, bounds_b = kept(b)
    na, nb = np.diff(bounds_a), np.diff(bounds_b)
    same = na == nb
    n = np.where(same, na, 0)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = at_a[np.repeat(bounds_a[:-1], n) + within]
    right = at_b[np.repeat(bounds_b[:-1], n) + within]
    differ = fold_table()[pa_[left]] != fold_table()[pb_[right]]
    wrong = np.zeros(len(n), dtype=bool)
    wrong[np.repeat(np.arange(len(n)), n)[differ]] = True
    return same & ~wrong


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = poly_hash(b.column("a")), poly_hash(b.column("b"))
        t = pa.RecordBatch.from_arrays([b.column("rec"), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), b.column("a"), b.column("b")], names=["rec", "lo", "hi", "a", "b"])
        yield t.filter(pa.array(np.minimum(x, y) >= 0))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        straight = skip_equal(b.column("a"), b.column("ra")) & skip_equal(b.column("b"), b.column("rb"))
        crossed = skip_equal(b.column("a"), b.column("rb")) & skip_equal(b.column("b"), b.column("ra"))
        yield pa.RecordBatch.from_arrays([b.column("keep_id"), b.column("rec"), pa.array(straight | crossed)], names=["keep_id", "copy_id", "same"])


def _round(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies of the smallest row of each hash pair, and the ids of rows that only collide with it."""
    groups = hashed.groupBy("lo", "hi").agg(F.min("rec").alias("keep_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = stage(groups, "hash-groups")
    members = hot_join(hashed, groups.drop("_n"), ["lo", "hi"], "inner", spread=F.col("rec"), hot=groups.select("lo", "hi", "_n"))
    members = stage(members.select("keep_id", "rec", "a", "b"), "hash-members")
    first = members.where("rec = keep_id").select("keep_id", F.col("a").alias("ra"), F.col("b").alias("rb"))
    pairs = hot_join(members.where("rec <> keep_id"), first, ["keep_id"], "inner", spread=F.col("rec"), hot=groups.select("keep_id", "_n"))
    out = stage(pairs.mapInArrow(_verified, "keep_id long, copy_id long, same boolean"), "hash-copies")
    return out.where("same").select("keep_id", "copy_id"), out.where("not same").select(F.col("copy_id").alias("rec"))


def find_copies(df: DataFrame, rec: str, a: str, b: str) -> DataFrame:
    """(keep_id, copy_id) of rows whose fields ``a`` and ``b`` agree in their letters and digits.

    Only letters (any script) and decimal digits count, in their order and letter case aside; the two
    fields may stand in either order. Rows with a field that is null or holds no letter or digit belong
    to no group. Of each group the smallest ``rec`` is kept. Rows with equal hashes are compared
    character by character; those that merely collide go through the same steps among themselves until
    none is left, so the result is exact. Empty input gives no rows; ``rec`` must be unique.
    """
    base = df.select(F.col(rec).alias("rec"), F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    hashed = stage(base.mapInArrow(_hashed, "rec long, lo long, hi long, a string, b string"), "hashes")
    found, rest = _round(hashed)
    while not rest.isEmpty():
        again = hashed.join(rest, "rec", "left_semi")
        more, rest = _round(stage(again, "collisions"))
        found = found.unionByName(more)
    return found


def collapse(df: DataFrame, rec: str, a: str, b: str) -> DataFrame:
    """One row per distinct record that has letters or digits in both fields: keep_id and its copies."""
    copies = find_copies(df, rec, a, b)
    counts = copies.groupBy("keep_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    word = r"[\p{L}\p{Nd}]"
    own = df.where(F.regexp_like(F.col(a), F.lit(word)) & F.regexp_like(F.col(b), F.lit(word))).select(F.col(rec).alias("keep_id"), a, b)
    kept_rows = own.join(copies.select(F.col("copy_id").alias("keep_id")), "keep_id", "left_anti")
    return kept_rows.join(counts, "keep_id", "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1)))
