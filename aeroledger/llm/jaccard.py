"""N-gram Jaccard join: a grouped prefix join over whole texts.

Words are runs of characters other than ASCII space, A-Z lower-cased; a
document is its set of distinct k-word shingles. Sets whose Jaccard similarity
reaches the threshold share a shingle among the first few in any fixed order of
all shingles, their prefixes. The order puts common shingles last: those that
more than ``HOT`` documents would have in or near their prefixes otherwise, as a
filter of fixed size tells, then by the level that a count sketch of fixed size over
all documents gives a shingle, then longer ones before shorter ones, which
chance repeats more often, then by hash. None of this has to be right: the order
decides how much is compared, never a link.

1. Equal sets become one set; sets with equal prefix and size become one group.
2. Groups are posted under their prefix shingles; those under which only one
   group stands are dropped.
3. Star rounds: under each shingle the group with the most common content (the
   one that has the shingle first) is paired with all others. Group pairs are
   filtered, then expanded to members, one comparison a member. Found links join
   components.
4. Under each shingle groups of different components are paired, filtered, and
   expanded to members, which are compared. Within a component nothing is left
   to find, so a large family of near copies is not compared pair by pair.

Pairs are filtered by size, by what the positions of the shared shingles leave
possible, and by a parity sketch: each shingle flips one of 256 bits, so at
least as many shingles are in one of two sets only as bits differ. All three are
bounds, so no link is lost. Every comparison that remains counts the shared
shingles of the whole sets, which are read again from the documents for just the
sets that are compared.

Defined cases: a text that is null or has no words has an empty set and links
with nothing; fewer than k words are one shingle; every row gets a row, rows
with the same id but different texts each that of their text; a null id links
with nothing and has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..workspace import materialise
from .bloom import filter_of, in_filter
from .graph import components
from .scratch import Round, drop_table, shuffles_dropped, small_batches, write_table
from .text import chunks, mix, shingle_hashes, shingle_layout, word_hashes

#: The sketch has 2**SKETCH_BITS counters, sent as rows of ROW_COUNTERS.
SKETCH_BITS, ROW_COUNTERS = 18, 64
#: Longer shingles are rarer; bytes beyond this make no difference to the order.
LONGEST = 127
STAR_ROUNDS = 3
#: A shingle of more prefixes than this goes behind others. The sketch sees only what is common among all shingles that share
#: a counter; in a larger corpus a shingle of a few dozen documents hides there, and its pairs grow with the square of them.
HOT, COUNTED = 2, 2  # shingles are counted in prefixes of COUNTED times the length, since others take the place of hot ones
#: Columns of the parity sketch, 64 bits each.
PARITY = ("k1", "k2", "k3", "k4")


def shingle_sets(column: pa.Array, k: int):
    """(numbers, offsets) of the distinct shingles of successive texts, ascending within a text; part by part.

    A number is the length of the shingle, the longest first, above 56 bits of its hash.
    """
    for _, data, at in chunks(column):
        words, row, size = word_hashes(data, at)
        begin, left, ends = shingle_layout(row, k, len(at) - 1)
        upto = np.concatenate(([0], np.cumsum(size)))
        length = np.minimum(upto[begin + left] - upto[begin], LONGEST)
        found = ((LONGEST - length).astype(np.uint64) << np.uint64(56)) | (shingle_hashes(words, begin, left) >> np.uint64(8))
        for a, b in zip(ends[:-1], ends[1:]):
            found[a:b].sort()
        keep = np.ones(len(found), bool)
        keep[1:] = found[1:] != found[:-1]
        keep[ends[:-1][ends[:-1] < len(found)]] = True
        yield found[keep], np.concatenate(([0], np.cumsum(keep)))[ends]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def shingle_levels(texts: DataFrame, k: int) -> np.ndarray:
    """A level for every counter of the sketch: 0 for ordinary shingles, higher for more common ones."""
    columns = [f"c{i}" for i in range(ROW_COUNTERS)]

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for found, _ in shingle_sets(batch.column(0), k):
                total += np.bincount(_slot(found), minlength=len(total))
        rows = total.reshape(-1, ROW_COUNTERS)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(rows[used, i]) for i in range(ROW_COUNTERS)]], ["row", *columns])

    sketch = texts.mapInArrow(count, "row bigint, " + ", ".join(f"{c} bigint" for c in columns))
    total = np.zeros((1 << SKETCH_BITS) // ROW_COUNTERS * ROW_COUNTERS, np.int64).reshape(-1, ROW_COUNTERS)
    for r in sketch.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        total[r[0]] = r[1:]
    usual = float(np.median(total))
    excess = total.ravel() - usual - 8 * np.sqrt(usual) - 8
    return np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


def prefix_length(n: np.ndarray | int, percent: int):
    """How many first shingles of n must be looked at for similarity of ``percent``."""
    return n - -(-percent * n // 100) + 1


def _ranks(found: np.ndarray, levels: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """Place of each shingle in the order of all, but for its length and hash."""
    level = levels[_slot(found)]
    return level if hot is None else level + np.uint8(128) * in_filter(hot, found.view(np.int64)).astype(np.uint8)


def _prefixes(found: np.ndarray, at: np.ndarray, rank: np.ndarray, percent: int, times: int = 1) -> Iterator[np.ndarray]:
    """The prefix of each set, or its first shingles to some times that length; nothing of an empty set."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield found[a:b][np.argsort(rank[a:b], kind="stable")[:times * prefix_length(b - a, percent)]] if b > a else found[a:a]


def hot_shingles(texts: DataFrame, k: int, percent: int, levels: np.ndarray) -> np.ndarray:
    """A filter of the shingles that more than ``HOT`` documents have in or near their prefixes."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def first(batches):
        for batch in batches:
            for found, at in shingle_sets(batch.column(0), k):
                tokens = np.concatenate([found[:0], *_prefixes(found, at, _ranks(found, shared.value, None), percent, COUNTED)])
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], ["token"])

    counted = texts.mapInArrow(first, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    hot = filter_of(counted.where(F.col("n") > HOT).select("token"))
    shared.destroy()
    return hot


def _digests(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(128-bit digest, parity sketch) of each set, as rows of two and four numbers."""
    n = len(at) - 1
    digest, parity = np.zeros((n, 2), np.uint64), np.zeros((n, len(PARITY)), np.uint64)
    here = np.flatnonzero(np.diff(at))
    if len(here):
        heads = at[:-1][here]
        one, two = mix(found), mix(found ^ np.uint64(0x5851F42D4C957F2D))
        digest[here, 0], digest[here, 1] = np.add.reduceat(one, heads), np.add.reduceat(two, heads)
        bit = np.uint64(1) << (one >> np.uint64(58))
        column = (two >> np.uint64(62)).astype(np.int64)
        for i in range(len(PARITY)):
            parity[here, i] = np.bitwise_xor.reduceat(np.where(column == i, bit, np.uint64(0)), heads)
    return digest, parity


def _described(texts: DataFrame, k: int, percent: int, levels: np.ndarray, hot: np.ndarray, id_type: str) -> DataFrame:
    """(id, n, set, grp, prefix, parity sketch) of every document; ``set`` is a 128-bit digest."""
    shared = texts.sparkSession.sparkContext.broadcast((levels, hot))

    def describe(batches):
        for batch in batches:
            sizes, sets, groups, prefixes, sketches = [], [], [], [], []
            for found, at in shingle_sets(batch.column(1), k):
                digest, parity = _digests(found, at)
                sets += [d.tobytes() for d in digest]
                sketches.append(parity)
                for n, first in zip(np.diff(at).tolist(), _prefixes(found, at, _ranks(found, *shared.value), percent)):
                    sizes.append(n)
                    prefixes.append(first.view(np.int64))
                    groups.append(int(mix(np.array([n], np.uint64) + mix(first + np.uint64(1)).sum())[0].view(np.int64)))
            parity = np.concatenate([*sketches, np.empty((0, len(PARITY)), np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(groups, pa.int64()),
                pa.array(prefixes, pa.list_(pa.int64())), *[pa.array(parity[:, i]) for i in range(len(PARITY))],
            ], ["id", "n", "set", "grp", "prefix", *PARITY])

    columns = ", ".join(f"{c} bigint" for c in PARITY)
    return texts.select("id", "text").mapInArrow(
        describe, f"id {id_type}, n bigint, set binary, grp bigint, prefix array<bigint>, {columns}")


def _destroy(held: list[Broadcast]) -> None:
    """Delete filters that no table to be written reads any more."""
    for shared in held:
        shared.destroy()


def _half(column: pa.Array) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(x.as_py() for x in column), np.int64).reshape(-1, 2)[:, 0]


def _listed(contents: DataFrame, sets: DataFrame, held: list[Broadcast]) -> DataFrame:
    """The rows of ``contents`` whose set is listed in ``sets``, and a few others: the rest need not be shuffled for a join.

    ``held`` gets the filter, a file of the driver until it is destroyed.
    """

    def key(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_half(batch.column(0)).copy())], ["key"])

    shared = contents.sparkSession.sparkContext.broadcast(filter_of(sets.mapInArrow(key, "key bigint")))
    held.append(shared)

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, _half(batch.column(0)).copy())))

    return contents.select("set", "shingles").mapInArrow(pick, "set binary, shingles array<bigint>")


def _contents(texts: DataFrame, sets: DataFrame, k: int, held: list[Broadcast]) -> DataFrame:
    """(set, shingles) of the sets (set, doc) listed, from one more scan of the documents.

    Of a set's copies only the document with the smallest id, ``doc``, passes, so a hot set is one row. ``held`` gets the filter.
    """

    def key(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_half(batch.column(0)) ^ batch.column(1).to_numpy())], ["key"])

    wanted = sets.select("set", F.xxhash64("doc").alias("of"))
    shared = texts.sparkSession.sparkContext.broadcast(filter_of(wanted.mapInArrow(key, "key bigint")))
    held.append(shared)

    def read(batches):
        for batch in batches:
            of, first = batch.column(1).to_numpy(), 0
            for found, at in shingle_sets(batch.column(0), k):
                digest, _ = _digests(found, at)
                mine = of[first:first + len(digest)]
                first += len(digest)
                here = np.flatnonzero(in_filter(shared.value, np.ascontiguousarray(digest[:, 0]).view(np.int64) ^ mine))
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest[i].tobytes() for i in here], pa.binary()),
                    pa.array([found[at[i]:at[i + 1]].view(np.int64) for i in here], pa.list_(pa.int64())),
                ], ["set", "shingles"])

    found = texts.select("text", F.xxhash64("id").alias("of")).mapInArrow(read, "set binary, shingles array<bigint>")
    return found.dropDuplicates(["set"]).join(sets.select("set"), "set", "left_semi")


class _Join:
    """State of one join: candidate sets with their components, postings, contents read so far, pairs compared so far."""

    def __init__(self, texts: DataFrame, sets: DataFrame, postings: DataFrame, k: int, percent: int) -> None:
        self.texts, self.sets, self.postings, self.k, self.percent = texts, sets, postings, k, percent
        self.done: DataFrame | None = None
        self.contents: DataFrame | None = None
        self.round, self.standing = Round(), Round()

    def fits(self, a: str, b: str, one, two):
        """Whether sizes ``a`` and ``b`` and the parity sketches allow a link; a missing sketch does."""
        differ = reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(one, two)])
        most = (F.col(a) + F.col(b)) * (100 - self.percent)
        return (F.least(a, b) * 100 >= F.greatest(a, b) * self.percent) & (
            F.coalesce(differ * (100 + self.percent) <= most, F.lit(True)))

    def grown_shingles(self) -> DataFrame:
        """Shingles of groups whose component has more than one set: only there can another star join more."""
        grown = self.sets.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        groups = self.sets.join(grown, "comp", "left_semi").select("grp", "n").distinct()
        return self.round.write(self.postings.join(groups, ["grp", "n"], "left_semi").select("token").distinct(), "jaccard-grown")

    def posted(self, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Postings with the components of their groups, and the shingles under which there is more than one.

        ``only`` limits the shingles. A group has a sketch where a single set stands for it.
        """
        postings = self.postings if only is None else self.postings.join(only, "token", "left_semi")
        alone = F.count(F.lit(1)) == 1
        entries = self.sets.groupBy("grp", "n", "comp").agg(*[F.when(alone, F.first(c)).alias(c) for c in PARITY])
        rows = self.round.write(postings.join(entries, ["grp", "n"]), "jaccard-posted")
        shingles = rows.groupBy("token").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("pos", "grp", "n", "comp", *PARITY)).alias("star"),
        ).where("lo <> hi").select("token", "star")
        return rows, self.round.write(shingles, "jaccard-shingles")

    def expanded(self, pairs: DataFrame, *sides: tuple[int, str, DataFrame]) -> DataFrame:
        """Group pairs (g1, n1, c1, g2, n2, c2) as pairs of member sets (a, b) that their sketches allow."""
        for i, name, members in sides:
            member = members.select(
                F.col("grp").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("comp").alias(f"c{i}"), F.col("set").alias(name),
                *[F.col(c).alias(f"{c}_{i}") for c in PARITY])
            pairs = pairs.join(member, [f"g{i}", f"n{i}", f"c{i}"])
        one, two = ([F.col(f"{c}_{i}") for c in PARITY] for i in (1, 2))
        return pairs.where(self.fits("n1", "n2", one, two)).select("a", "b")

    def star_pairs(self, only: DataFrame | None = None) -> DataFrame:
        rows, shingles = self.posted(only)
        one, two = [F.col(f"star.{c}") for c in PARITY], [F.col(c) for c in PARITY]
        pairs = (
            rows.join(shingles, "token")
            .where((F.col("comp") != F.col("star.comp")) & self.fits("n", "star.n", one, two))
            .select(
                F.col("star.grp").alias("g1"), F.col("star.n").alias("n1"), F.col("star.comp").alias("c1"),
                F.col("grp").alias("g2"), F.col("n").alias("n2"), F.col("comp").alias("c2"),
            ).distinct()
        )
        heads = self.sets.groupBy("grp", "n", "comp").agg(F.min_by(F.struct("set", *PARITY), "set").alias("h")).select("grp", "n", "comp", "h.*")
        return self.expanded(pairs, (1, "a", heads), (2, "b", self.sets))

    def all_pairs(self) -> DataFrame:
        """Members of groups of different components that share enough of their prefixes."""
        rows, _ = self.posted()
        ends = rows.select("token", "comp").distinct()
        met = ends.select("token", F.col("comp").alias("c1")).join(ends.select("token", F.col("comp").alias("c2")), "token").where("c1 < c2")
        one, two = (rows.select(
            "token", F.col("comp").alias(f"c{i}"), F.col("grp").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("pos").alias(f"p{i}"),
            *[F.col(c).alias(f"{c}_{i}") for c in PARITY],
        ) for i in (1, 2))
        sketches = ([F.col(f"{c}_{i}") for c in PARITY] for i in (1, 2))
        pairs = (
            met.join(one, ["token", "c1"]).join(two, ["token", "c2"]).where(self.fits("n1", "n2", *sketches))
            .groupBy("g1", "n1", "c1", "g2", "n2", "c2")
            .agg(F.count(F.lit(1)).alias("k"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
        )
        possible = F.col("k") + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1
        pairs = pairs.where(self.enough(possible, F.col("n1") + F.col("n2"))).drop("k", "p1", "p2")
        return self.expanded(pairs, (1, "a", self.sets), (2, "b", self.sets))

    def read(self, pairs: DataFrame) -> None:
        """Reads the contents of those sets of ``pairs`` that were not read before."""
        wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
        if self.contents is not None:
            wanted = wanted.join(self.contents.select("set"), "set", "left_anti")
        wanted = self.round.write(wanted.join(self.sets.select("set", "doc"), "set"), "jaccard-wanted")
        if self.contents is None or not wanted.isEmpty():
            more = materialise(_contents(self.texts, wanted, self.k, held := []), "jaccard-contents")
            _destroy(held)
            self.contents = more if self.contents is None else self.contents.unionByName(more)

    def enough(self, shared, both):
        """Whether ``shared`` of ``both`` sizes together reach the threshold: shared / (both - shared) >= percent / 100."""
        return shared * (100 + self.percent) >= both * self.percent

    def compare(self, pairs: DataFrame) -> int:
        """Compares pairs that were not compared before, joins the components of those that link; number of links."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.done is not None:
            pairs = pairs.join(self.done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "jaccard-pairs")
        self.round.drop()
        self.read(pairs)
        held: list[Broadcast] = []
        one = _listed(self.contents, pairs.select("a"), held).toDF("a", "x")
        two = _listed(self.contents, pairs.select("b"), held).toDF("b", "y")
        shared = F.size(F.array_intersect("x", "y"))
        links = self.round.write(
            pairs.join(one, "a").join(two, "b").where(self.enough(shared, F.size("x") + F.size("y"))).select("a", "b"), "jaccard-links")
        _destroy(held)
        self.done = pairs if self.done is None else self.done.unionByName(pairs)
        n = links.count()
        if n:
            of = self.sets.select("set", "comp")
            edges = links.join(of.select(F.col("set").alias("a"), F.col("comp").alias("u")), "a").join(
                of.select(F.col("set").alias("b"), F.col("comp").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
            found = components(edges, self.round).select(F.col("node").alias("comp"), "component")
            now = Round()
            self.sets = now.write(
                self.sets.join(found, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component"), "jaccard-sets")
            self.standing.drop()
            self.standing = now
        self.round.drop()
        return n


def jaccard_components(
    documents: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id): the component is the smallest id reachable by links of at least ``percent``."""
    with shuffles_dropped(documents.sparkSession), small_batches(documents.sparkSession):
        described, of_set = _joined(documents, k, percent, id_col, text_col)
    return described.join(of_set, "set", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _joined(documents: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, n, set) of every document, and (set, component_id) of every set that a document with an id has."""
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    levels = shingle_levels(texts.select("text"), k)
    start = Round()
    hot = hot_shingles(texts.select("text"), k, percent, levels)
    full = start.write(_described(texts, k, percent, levels, hot, dict(documents.dtypes)[id_col]), "jaccard-described")
    described = materialise(full.select("id", "n", "set"), "jaccard-documents")
    sets = materialise(
        full.where("n > 0 AND id IS NOT NULL").groupBy("set", "n", "grp", *PARITY).agg(F.min("id").alias("doc")), "jaccard-distinct")
    groups = full.where("n > 0 AND id IS NOT NULL").select("grp", "n", "prefix").dropDuplicates(["grp", "n"])
    posted = groups.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    # A group with several sets has candidates within itself, whoever else shares its shingles.
    crowded = sets.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("members"))
    common = posted.join(crowded, ["grp", "n"]).groupBy("token").agg(F.sum("members").alias("members")).where("members > 1")
    common = start.write(common.select("token"), "jaccard-common")
    postings, path = write_table(posted.join(common, "token"), "jaccard-postings")
    start.drop()
    near = sets.join(postings.select("grp", "n").distinct(), ["grp", "n"], "left_semi").withColumn("comp", F.col("doc"))
    join = _Join(texts, materialise(near, "jaccard-near"), postings, k, percent)
    links = join.compare(join.star_pairs())
    for _ in range(STAR_ROUNDS - 1):
        if links:
            links = join.compare(join.star_pairs(join.grown_shingles()))
    join.compare(join.all_pairs())
    drop_table(documents.sparkSession, path)
    return described, sets.select("set", "doc").join(join.sets.select("set", "comp"), "set", "left").select(
        "set", F.coalesce("comp", "doc").alias("component_id"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``documents`` for each component: that with its smallest id, null ids last, ties to a hash of the row.

    Every row is a document here, so rows that repeat an id with different texts are told apart, rows without an id are
    linked like others, and of rows equal in all columns one stays. Texts without words link with nothing.
    """
    key = "_".join(["row", *documents.columns])  # no column has this name
    keyed = documents.withColumn(
        key, F.unhex(F.md5(F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}))))
    found = jaccard_components(keyed, id_col=key, text_col=text_col, **options)
    with shuffles_dropped(documents.sparkSession):
        comps = found.select(F.col(key).alias("key"), F.col("component_id").alias("comp")).distinct()
        rows = materialise(
            keyed.select(F.col(key).alias("key"), F.col(id_col).alias("id"))
            .groupBy("key").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("copies")).join(comps, "key"), "jaccard-rows")
        first = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select("first.key")
        # Only the rest is looked up in the documents: a plain document is neither shuffled nor compared.
        gone = materialise(rows.join(first, "key", "left_anti").select("key"), "jaccard-gone")
        again = materialise(
            rows.where("copies > 1").join(first, "key", "left_semi").select("key"), "jaccard-again")
    alone = keyed.join(gone.unionByName(again).withColumnRenamed("key", key), key, "left_anti")
    once = keyed.join(again.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key])
    return alone.unionByName(once).select(*documents.columns)
