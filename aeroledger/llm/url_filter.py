"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix, written ``host/path``; it fits the host and
its subdomains where the path starts with the prefix. The keys of a URL are all
rules that could fit it: every suffix of its host at a label, with its path cut
at every prefix length that some rule has. The keys of all URLs are the
universe. A first Bloom filter holds the listed keys, the next one the keys of
the universe that it lets through wrongly, the next one those listed keys that
this one holds wrongly, and so on until no key is wrong. For every key of the
universe the cascade answers exactly, without a join.

Bits are set by an OR aggregate, one row per 64-bit word, so building moves at
most the size of a filter. A filter has a few bits per listed or wrongly passed
key; ``MOST_BITS`` bounds what is broadcast, a longer list is refused.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is allowed; repeated rows are judged alike; an empty table
gives an empty result; the longest rule wins, of equally long ones that with
the longer host; a rule that is listed both ways blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..workspace import materialise
from .text import mix

MOST_BITS = 1 << 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All rules that could fit, the longest first, of equally long ones the longer host first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.filter(
        F.array(*[F.struct(F.lit(n).alias("n"), F.substring(path, 1, n).alias("p")) for n in lengths]),
        lambda x: F.length(x["p"]) == x["n"],
    )
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda x: F.struct(
        (-(F.length(s) + x["n"])).alias("order"), (-F.length(s)).alias("host"), F.concat(s, x["p"]).alias("key"),
    ))))
    return F.when(host != "", F.transform(F.array_sort(F.array_distinct(pairs)), lambda x: x["key"])).otherwise(
        F.array().cast("array<string>"))


def _h1(key: Column) -> Column:
    return F.xxhash64(key)


def _h2(key: Column) -> Column:
    return F.xxhash64(F.lit("second"), key)


def _hashes(key: str) -> list[Column]:
    return [_h1(F.col(key)).alias("h1"), _h2(F.col(key)).alias("h2")]


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, n_hashes: int, n_bits: int) -> np.ndarray:
    """Bit numbers of each key in a level, one column per hash."""
    a = mix(h1.astype(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    step = mix(h2.astype(np.uint64) ^ a) | np.uint64(1)
    return (a[:, None] + np.arange(n_hashes, dtype=np.uint64) * step[:, None]) % np.uint64(n_bits)


class Cascade:
    """Levels of (number of hashes, number of bits, bytes); level 0 holds the listed keys."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, int, np.ndarray]] = []

    def passed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many levels in a row hold each key."""
        n = np.zeros(len(h1), np.int64)
        going = np.ones(len(h1), bool)
        for i, (n_hashes, n_bits, bits) in enumerate(self.levels):
            if not going.any():
                break
            at = _positions(h1[going], h2[going], i, n_hashes, n_bits)
            held = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            going[np.flatnonzero(going)[~held]] = False
            n += going
        return n

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key is listed if the number of levels that hold it in a row is odd."""
        return self.passed(h1, h2) % 2 == 1


def _add_level(cascade: Cascade, keys: DataFrame, n_keys: int, error: float) -> None:
    n_bits = max(64, math.ceil(-n_keys * math.log(error) / math.log(2) ** 2))
    if n_bits > MOST_BITS:
        raise ValueError(f"a filter of {n_bits} bits is over the bound of {MOST_BITS}")
    n_hashes, level = max(1, round(-math.log2(error))), len(cascade.levels)

    def bits(frames):
        for frame in frames:
            at = _positions(frame["h1"].to_numpy(), frame["h2"].to_numpy(), level, n_hashes, n_bits).ravel()
            yield pd.DataFrame({
                "word": (at >> np.uint64(6)).astype(np.int64),
                "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64),
            })

    words = keys.mapInPandas(bits, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    held = np.zeros((n_bits + 63) // 64, np.int64)
    for word, value in words.collect():
        held[word] = value
    cascade.levels.append((n_hashes, n_bits, held.view(np.uint8)))


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade that answers exactly for every (h1, h2) of ``universe`` and of ``listed``."""
    cascade = Cascade()
    spark = universe.sparkSession
    rest = materialise(universe.join(listed, ["h1", "h2"], "left_anti"), "url-keys")
    listed = listed.coalesce(1)
    n_listed, n_rest = listed.count(), rest.count()
    if not n_listed:
        return cascade
    first = max(1e-9, min(0.5, math.sqrt(0.5) * n_listed / max(n_rest, 1)))
    _add_level(cascade, listed, n_listed, first)
    turn = [rest, listed]
    while True:
        level = len(cascade.levels)
        shared = spark.sparkContext.broadcast(cascade)

        def wrong(frames, shared=shared, level=level):
            for frame in frames:
                yield frame[shared.value.passed(frame["h1"].to_numpy(), frame["h2"].to_numpy()) == level]

        left = materialise(turn[0].mapInPandas(wrong, "h1 bigint, h2 bigint"), "url-wrong")
        n = left.count()
        if not n:
            return cascade
        _add_level(cascade, left, n, 0.5)
        turn = [turn[1], left]


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], blocked: Sequence[str] = (),
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict): ``rules`` are (allow or block, rule); ``blocked`` are listed rules of lower standing.

    Where no rule fits, a URL that fits one of ``blocked`` is blocked and any other is allowed.
    """
    spark: SparkSession = pages.sparkSession
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    lists = {
        "allow": [r for v, r in rules if v == "allow"], "block": [r for v, r in rules if v == "block"],
        "listed": list(blocked),
    }
    if unknown := {v for v, _ in rules} - {"allow", "block"}:
        raise ValueError(f"unknown verdicts {sorted(unknown)}")
    if bad := [r for group in lists.values() for r in group if not 0 < r.find("/")]:
        raise ValueError(f"rules need a host and a path: {bad}")
    lengths = sorted({len(r) - r.index("/") for group in lists.values() for r in group})
    if not lengths:
        return parsed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    keyed = parsed.withColumn("_keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = materialise(
        keyed.select(F.explode("_keys").alias("key")).select(*_hashes("key")).distinct(), "url-universe"
    )
    cascades = {}
    for name, group in lists.items():
        keys = spark.createDataFrame([(r,) for r in set(group)], "key string")
        cascades[name] = build_cascade(universe, keys.select(*_hashes("key")))
    shared = spark.sparkContext.broadcast(cascades)

    def first_held(frames):
        for frame in frames:
            sizes = frame["_keys"].map(len).to_numpy()
            owner = np.repeat(np.arange(len(frame)), sizes)
            flat = {c: np.concatenate([*frame[c], np.empty(0, np.int64)]).astype(np.int64) for c in ("_h1", "_h2")}
            keys = np.concatenate([*frame["_keys"], np.empty(0, object)])
            held = {n: c.holds(flat["_h1"], flat["_h2"]) for n, c in shared.value.items()}
            rule, verdict = np.full(len(frame), None, object), np.full(len(frame), "allow", object)
            verdict[owner[held["listed"]]] = "block"
            hit = np.flatnonzero(held["allow"] | held["block"])
            who, first = np.unique(owner[hit], return_index=True)
            rule[who] = keys[hit[first]]
            verdict[who] = np.where(held["block"][hit[first]], "block", "allow")
            yield frame.drop(columns=["_keys", "_h1", "_h2"]).assign(rule=rule, verdict=verdict)

    hashed = keyed.select(
        "*", F.transform("_keys", _h1).alias("_h1"), F.transform("_keys", _h2).alias("_h2"),
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema)
    return hashed.mapInPandas(first_held, f"{kinds}, rule string, verdict string")
