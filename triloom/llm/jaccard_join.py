"""N-gram Jaccard join: documents whose shingle sets are similar, joined in the Jaccard metric space.

A document's set holds its distinct k-word shingles; distance is 1 - Jaccard, a metric. Equal sets form classes,
which are joined once. In text nearly all pairs are at distance 1 from each other and from any document taken as
a pivot, so document pivots alone can't part a corpus: regions first form around pivots of another kind, the
contents of hash buckets of the shingle space, and document pivots divide what lies within a region:

1. Landmark regions. Sets of like size share a grid of buckets. Two linked sets differ in at most H shingles, so of
   the ``ne`` buckets that a set fills at least a = ne - H are the same in the other (a pigeonhole bound); the
   content of each bucket is a region key. Sets near the border of a size class are replicated into the next
   grid, the window in which partners can lie. A set that fills no more than H buckets (a tiny one) proves nothing so:
   all sets of sizes that can be linked with such a one also have keys of another kind, their H + l least shingles, of
   which linked sets share at least l.
2. A region that more than CROWD sets share says little (a passage that many documents have): it is left to the
   sets that have at least a such crowded keys, as all others share a quieter key with each partner. Sets that
   share fewer than a keys with anything have no partner.
3. Overlapping regions are united (candidate components). One that is too large for a task is divided by document
   pivots: each document goes to the Voronoi cell of its nearest pivot, its home, and to those within 2 eps of that (the
   triangle inequality shows that each partner of a document is in its home cell), and cells are divided in turn. Cells
   are rows of a table, so that any number of tasks works on a region. A cell that its pivots don't part (all documents
   are about as far from each other) is joined in pairs of blocks.
4. Within a cell that fits a task, each document is compared with those that a few more pivots' distances don't rule
   out. A document counts its links in its home cell, once.

Where only groups are asked for, not links, documents that are linked with a pivot and can't be reached by any
document that isn't leave the recursion at once, and cells stop comparing what is connected already: the work on a dense
group is then linear. Counting the links of a dense group of different texts takes comparisons that grow with its square,
as the links themselves do.

Shingles and classes are told apart by 64-bit hashes. Null and empty texts have an empty set and link with
nothing; very long texts are single rows of their set; repeated rows fall in one class; a null id is a document
like any other but never names a component; an empty table gives an empty result; only doc_id and text are
read, extra columns of ``keep_one``'s input stay as they are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, bucket_of, by_bucket, discard, materialize, mix64, partitions_for, unpacked, whole_text, word_hashes
from .components import components

CROWD = 32
#: What one task joins at most: sets, and shingles (8 bytes each, about four times that in work).
SETS, SHINGLES = 512, 2_000_000
#: Pivots that a cell is divided by, on average, and keys that tiny sets share at least, if they have so many shingles.
PIVOTS, LEAST = 12, 8
#: Bytes of sets that are written at once, at least; a quarter of all texts' bytes where that is more.
ROOM = 16 << 20
_ROW = np.dtype([("sig", "<u8"), ("k", "<u8")])
_M64 = (1 << 64) - 1


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in batches(texts):
        h, of = word_hashes(texts[a:b])
        first = np.searchsorted(of, np.arange(b - a + 1))
        count = np.diff(first)
        full = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            full = mix64(full + h[j : j + len(full)] * np.uint64(2 * j + 3))
        for i, (s, n) in enumerate(zip(first[:-1].tolist(), count.tolist(), strict=True)):
            if n >= k:
                x = np.sort(full[s : s + n - k + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif n:
                x = np.zeros(1, np.uint64)
                for j in range(n):
                    x = mix64(x + h[s + j] * np.uint64(2 * j + 3))
                out.append(mix64(x + np.uint64(n)))
            else:
                out.append(h[:0])
    return out


def set_key(s: np.ndarray) -> np.uint64:
    """The class of a set: equal sets, equal keys."""
    return mix64(mix64(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0]


class Grids:
    """Region keys of sets: size classes with their buckets, for a threshold of num / den; few: sizes of sets whose
    buckets prove nothing."""

    TINY = 200  # the number of the grid of least shingles

    def __init__(self, num: int, den: int, few: tuple[int, ...] = ()):
        self.num, self.den, self.few = num, den, np.array(few, np.int64)
        self.least = [1]
        while self.least[-1] < 1 << 40:
            self.least.append(max(self.least[-1] + 1, self.least[-1] * 3 // 2))
        self.lows = np.array(self.least)

    def differ(self, n: int) -> int:
        """Most shingles in which a linked set can differ from one of n."""
        return (self.den - self.num) * n // self.num

    def _common(self, n: int) -> int:
        """Fewest shingles that a set of n has in common with a linked one."""
        return -(-self.num * n // self.den)

    def keys(self, s: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray]], bool]:
        """(grid, a, region keys) for each grid that a set belongs to; whether some grid's keys prove nothing."""
        n = len(s)
        if not self.differ(n):
            return [], False
        c = int(np.searchsorted(self.lows, n, "right")) - 1
        out, plain, m = [], False, mix64(s ^ np.uint64(0x5DEECE66D))
        for grid in (c, c - 1):
            if grid < 0 or (grid < c and self.num * n > self.den * (self.least[c] - 1)):
                continue
            most = self.differ(self.least[grid + 1] - 1)
            buckets = most + 1 + max(8, (15 * (most + 1) + 99) // 100)
            b = bucket_of(s, buckets)
            first = np.flatnonzero(np.diff(b, prepend=-1))
            a = len(first) - min(most, self.differ(n))
            if a < 1:
                plain = True
                continue
            out.append((grid, a, mix64(np.add.reduceat(m, first) + b[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(grid * 0xC2B2AE3D27D4EB4F & _M64))))
        if len(self.few) and ((self.num * n <= self.den * self.few) & (self.num * self.few <= self.den * n)).any():
            l, other = min(LEAST, self._common(n)), min(LEAST, self._common(self._common(n)))
            m.sort()
            out.append((self.TINY, min(l, other), mix64(m[: n - self._common(n) + l] + np.uint64(self.TINY))))
        return out, plain


# --- passes over the texts ----------------------------------------------------------------------------


def _binary_texts(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select("doc_id", whole_text().cast("binary").alias("text"))


def set_table(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, k (the class; null for an empty set) and plain (needs the plain way)."""

    def run(parts):
        grids = Grids(num, den)
        for part in parts:
            raw, key, n, plain = [t.as_buffer().to_pybytes() for t in part.column(1)], [], [], []
            for i, j in batches(raw, 1 << 20):
                for s in shingle_sets(raw[i:j], k):
                    key.append(set_key(s) if len(s) else 0)
                    n.append(len(s))
                    plain.append(grids.keys(s)[1])
            key, n = np.array(key, np.uint64).view(np.int64), np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(key, mask=n == 0), pa.array(plain, pa.bool_())], ["doc_id", "n_shingles", "k", "plain"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _binary_texts(docs).mapInArrow(run, f"doc_id {kind}, n_shingles long, k long, plain boolean")


def region_keys(docs: DataFrame, k: int, num: int, den: int, buckets: int, few: tuple[int, ...] = ()) -> DataFrame:
    """(bucket, rows): the region keys of all classes, packed by bucket of the key."""

    def run(parts):
        grids = Grids(num, den, few)
        for part in parts:
            sig, key, size, seen = [], [], [], set()
            raw = [t.as_buffer().to_pybytes() for t in part.column(1)]
            for i, j in batches(raw, 1 << 20):
                for s in shingle_sets(raw[i:j], k):
                    own = int(set_key(s)) if len(s) else None
                    if own is None or own in seen:
                        continue
                    seen.add(own)
                    for grid, a, keys in grids.keys(s)[0]:
                        sig.append(keys & np.uint64(_M64 ^ 0xFFFF) | np.uint64(grid << 8 | min(a, 255)))
                        key.append(own)
                        size.append(len(keys))
            if sig:
                rows = np.empty(sum(size), _ROW)
                rows["sig"], rows["k"] = np.concatenate(sig), np.repeat(np.array(key, np.uint64), size)
                packed = list(by_bucket(bucket_of(rows["sig"], buckets), rows))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], ["bucket", "rows"])

    return _binary_texts(docs).mapInArrow(run, "bucket int, rows binary")


def _regions(table: pa.Table) -> pa.Table:
    """Keys that two classes or more share, as regions: one for each group of classes, n_keys: how many keys it has."""
    x = unpacked(table, "rows", _ROW)
    x = x[np.lexsort((x["k"], x["sig"] & np.uint64(0xFFFF), x["sig"] >> np.uint64(16)))]
    sig, k = x["sig"] >> np.uint64(16), x["k"]
    new = np.ones(len(x), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (k[1:] != k[:-1])
    sig, k, low = sig[new], k[new], x["sig"][new] & np.uint64(0xFFFF)
    # a row that lies between two of one class has the same grid: the key's hash covers the grid
    first = np.flatnonzero(np.diff(sig, prepend=sig[:1] + np.uint64(1))) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(sig)))
    own = np.repeat(size >= 2, size)
    sig, k, low, size = sig[own], k[own], low[own], size[size >= 2]
    if not len(size):
        return pa.table({c: pa.array([], pa.int64()) for c in ("region", "k", "grid", "a", "n_keys", "size")})
    first = np.cumsum(size) - size
    region = mix64(np.add.reduceat(mix64(k), first) + size.astype(np.uint64))
    _, one, n_keys = np.unique(region, return_index=True, return_counts=True)
    take = np.zeros(len(size), bool)
    take[one] = True
    times = np.zeros(len(size), np.int64)
    times[one] = n_keys
    rows = np.repeat(take, size)
    return pa.table({"region": np.repeat(region, size)[rows].view(np.int64), "k": k[rows].view(np.int64), "grid": (low[rows] >> np.uint64(8)).astype(np.int64), "a": (low[rows] & np.uint64(255)).astype(np.int64), "n_keys": np.repeat(times, size)[rows], "size": np.repeat(size, size)[rows].astype(np.int64)})


# --- joining the sets of a cell -----------------------------------------------------------------------


class Cell:
    """Sets that may be linked, and exact comparisons of one with many."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.eps = num, den, 1 - num / den + 1e-9
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.flat.max(initial=0)) + 1, bool)
        self.root = np.arange(len(sets))

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        """Intersection sizes of a set with others."""
        own = self.flat[self.start[one] : self.start[one] + self.size[one]]
        self.mark[own] = True
        n = self.size[others]
        at = np.cumsum(n) - n
        hit = self.mark[self.flat[np.repeat(self.start[others] - at, n) + np.arange(n.sum())]]
        self.mark[own] = False
        return np.add.reduceat(hit, at, dtype=np.int64)

    def measure(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to a set, and which are links."""
        both = self.common(one, others)
        union = self.size[one] + self.size[others] - both
        return 1 - both / union, self.den * both >= self.num * union

    def roots(self, who: np.ndarray) -> np.ndarray:
        r = self.root[who]
        while (self.root[r] != r).any():
            r = self.root[r]
        self.root[who] = r
        return r

    def unite(self, who: np.ndarray) -> None:
        r = self.roots(who)
        self.root[who] = self.root[r] = r.min()

    def join(self, home: np.ndarray, side: np.ndarray, weight: np.ndarray, counting: bool) -> np.ndarray:
        """Unite what is linked; with counting, the weight of all that each set at home is linked with. Sets of one side
        are compared with those of the other, if there are two sides."""
        every = np.arange(len(self.size))
        chosen = np.linspace(0, len(every) - 1, 8).astype(np.int64) if len(every) > 48 else every[:0]
        far = np.stack([self.measure(p, every)[0] for p in chosen.tolist()]) if len(chosen) else np.zeros((0, len(every)))
        links, two = np.zeros(len(every), np.int64), side.min() != side.max()
        for i in np.flatnonzero(home).tolist():
            open_ = (self.num * self.size <= self.den * self.size[i]) & (self.num * self.size[i] <= self.den * self.size)
            open_ &= (np.abs(far - far[:, i : i + 1]) <= self.eps).all(0)
            open_[i] = False
            if two:
                open_ &= side != side[i]
            others = np.flatnonzero(open_)
            if not counting and len(others):
                others = others[self.roots(others) != self.roots(every[i : i + 1])]
            if len(others):
                near = others[self.measure(i, others)[1]]
                if len(near):
                    links[i] = weight[near].sum()
                    self.unite(np.append(near, i))
        return links


def _joined(num: int, den: int, counting: bool):
    """For each set of a cell: the least set that it is connected with here, and its links if it is at home."""

    def join(table: pa.Table) -> pa.Table:
        key = table["k"].to_numpy()
        _, one = np.unique(key, return_index=True)  # repeated rows have one set
        sets, key = table["set"].combine_chunks(), key[one]
        cell = Cell([np.frombuffer(sets[int(i)].as_buffer(), np.uint64) for i in one], num, den)
        home, side, weight = (table[c].to_numpy()[one] for c in ("home", "side", "weight"))
        links = cell.join(home, side, weight, counting)
        return pa.table({"k": pa.array(key), "head": pa.array(key[cell.roots(np.arange(len(key)))]), "links": pa.array(links, mask=~home)})

    join.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return join


def _distances(num: int, den: int):
    """Distances of a share of a cell's sets to the cell's pivots (pivots, d and linked, aligned)."""

    def measure(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        at, own = np.unique(pivots["k"].to_numpy(), return_index=True) if pivots.num_rows else (np.zeros(0, np.int64), [])
        many = pivots["set"].combine_chunks() if len(own) else []
        sets = rows["set"].combine_chunks()
        both = [np.frombuffer(x.as_buffer(), np.uint64) for x in [*(many[int(i)] for i in own), *sets]]
        d, linked = np.zeros((rows.num_rows, len(at))), np.zeros((rows.num_rows, len(at)), bool)
        if rows.num_rows and len(at):
            cell, others = Cell(both, num, den), np.arange(len(at), len(both))
            for j in range(len(at)):
                d[:, j], linked[:, j] = cell.measure(j, others)
        out = rows.drop_columns(["salt"])
        lists = [pa.array([x.tolist()] * rows.num_rows if i == 0 else x.tolist(), pa.list_(t)) for i, (x, t) in enumerate(((at, pa.int64()), (d, pa.float64()), (linked, pa.bool_())))]
        for name, x in zip(("pivots", "d", "linked"), lists, strict=True):
            out = out.append_column(name, x)
        return out

    measure.__annotations__ = {"rows": pa.Table, "pivots": pa.Table, "return": pa.Table}
    return measure


_SETS = "unit long, k long, set binary, weight long, home boolean, side int, was long"


def _divided(rows: DataFrame, turn: int, num: int, den: int, counting: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells of rows (with sets, the size of the unit, and parts, the tasks that it needs), links found on the way, and the
    table that both are read from."""
    share = F.pmod(F.xxhash64("k", F.lit(turn)), F.col("sets")) < PIVOTS
    chosen = rows.where(F.col("home") & share).select(*[F.col(c).alias(c) for c in ("unit", "k", "set")], F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("salt"))
    members = rows.select("unit", "k", "set", "weight", "home", F.lit(0).alias("side"), F.col("sets").alias("was"), F.pmod(F.xxhash64("k", F.lit(-1)), F.col("parts")).cast("int").alias("salt"))
    seen = measured = materialize(members.groupBy("unit", "salt").cogroup(chosen.groupBy("unit", "salt")).applyInArrow(_distances(num, den), f"{_SETS}, pivots array<long>, d array<double>, linked array<boolean>"))
    eps = 1 - num / den + 1e-9
    links = seen.select("k", F.explode(F.arrays_zip("pivots", "linked")).alias("x")).where("x.linked AND x.pivots <> k").select("k", F.col("x.pivots").alias("head"))
    if not counting:
        # how near a document that isn't linked with a pivot comes to it
        shell = seen.select("unit", F.posexplode(F.arrays_zip("d", "linked"))).groupBy("unit", "pos").agg(F.min(F.when(~F.col("col.linked"), F.col("col.d"))).alias("shell"))
        shell = shell.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("pos", "shell"))).alias("shells"))
        safe = F.exists(F.arrays_zip("d", "linked", "shells"), lambda x: x["linked"] & F.coalesce(x["d"] + eps < x["shells"]["shell"], F.lit(True)))
        seen = seen.join(shell, "unit", "left").where(~F.coalesce(safe, F.lit(False)))
    # each set's home and the cells that it comes near; units whose sets come near most cells aren't parted
    least = F.array_min("d")
    near = F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.get("d", i) <= least + 2 * eps)
    seen = seen.withColumn("near", F.when(F.size("d") > 0, near))
    spread = seen.groupBy("unit").agg((F.sum(F.size("near")) <= 0.5 * F.sum(F.size("d"))).alias("parted"))
    cells = seen.join(spread, "unit").withColumn("cell", F.explode(F.when(F.col("parted"), F.col("near")).otherwise(F.array(F.lit(None).cast("int")))))
    at_home = F.col("home") & (F.col("cell").isNull() | (F.col("cell") + 1 == F.array_position("d", least)))
    unit = F.xxhash64("unit", F.lit(turn), F.get("pivots", F.col("cell")))
    was = F.when(F.col("cell").isNotNull(), F.col("was")).otherwise(F.lit(1).cast("long"))
    return cells.select(unit.alias("unit"), "k", "set", "weight", at_home.alias("home"), "side", was.alias("was")), links, measured


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Pairs of blocks of units that pivots don't part; a pair of blocks has two sides."""
    blocks, own = F.col("parts").cast("int"), F.pmod(F.xxhash64("k", F.lit(-2)), F.col("parts")).cast("int")
    pairs = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    unit = F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.select(unit.alias("unit"), "k", "set", "weight", "home", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "was")


def join_units(rows: DataFrame, num: int, den: int, counting: bool, room: int = 1 << 28, turn: int = 0) -> DataFrame:
    """k, head (a set that k is connected with) and links (in parts, to be summed) of the sets of units.

    Copies of sets, for cells and pairs of blocks, are made in turns of about room bytes, one turn after the other down to
    its last cells; rows (materialized) and copies are deleted as soon as nothing reads them any more.
    """
    def joined(cells: DataFrame) -> DataFrame:
        return materialize(cells.groupBy("unit").applyInArrow(_joined(num, den, counting), "k long, head long, links long"))

    def in_turns(copies: DataFrame, size: int) -> list[DataFrame]:
        n = max(1, -(-size // room))
        return [copies.where(F.pmod(F.xxhash64("unit", F.lit(-4)), F.lit(n)) == i) for i in range(n)] if n > 1 else [copies]

    def total(copies: DataFrame, size) -> int:
        return int(copies.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])

    parts = F.ceil(F.greatest(F.col("sets") / SETS, F.col("shingles") / SHINGLES))
    sizes = rows.groupBy("unit").agg(F.count("*").alias("sets"), F.sum(F.length("set") / 8).alias("shingles"), F.max("was").alias("_was"))
    dense = F.coalesce(F.col("sets") > 0.7 * F.col("_was"), F.lit(False))
    large = materialize(sizes.where((F.col("sets") > SETS) | ((F.col("shingles") > SHINGLES) & (F.col("sets") > 16))).select("unit", "sets", parts.alias("parts"), dense.alias("dense")))
    kinds = {r["dense"] for r in large.select("dense").distinct().collect()}
    found = [joined(rows.join(large, "unit", "left_anti") if kinds else rows)]
    rest = rows.join(large, "unit")
    if True in kinds:
        crowd = rest.where("dense")
        found += map(joined, in_turns(_in_blocks(crowd), total(crowd, F.length("set") * F.col("parts"))))
    if False in kinds:
        cells, links, measured = _divided(rest.where("NOT dense"), turn, num, den, counting)
        discard(rows)
        found.append(materialize(links.withColumn("links", F.lit(None).cast("long"))))
        for some in in_turns(cells, total(cells, F.length("set"))):
            found.append(join_units(materialize(some), num, den, counting, room, turn + 1))
        discard(measured)
    else:
        discard(rows)
    return reduce(DataFrame.unionByName, found)


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (unit, k, weight, doc_id of a document with that set) with the set of each row."""
    # a repeated id may have other texts: the class tells whose set it is

    def run(parts):
        for part in parts:
            sets = shingle_sets([t.as_buffer().to_pybytes() for t in part.column(3)], k)
            key = np.array([set_key(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            right = key == part.column(1).to_numpy(zero_copy_only=False)
            mask = pa.array(right)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), pa.array(key[right]), pa.array([s.tobytes() for s, ok in zip(sets, right.tolist(), strict=True) if ok], pa.binary()), part.column(2).filter(mask)], ["unit", "k", "set", "weight"])

    w = wanted.select("unit", "k", "weight", F.col("doc_id").alias("_id"))
    joined = _binary_texts(docs).join(w.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("unit", "k", "weight", "text")
    return joined.mapInArrow(run, "unit long, k long, set binary, weight long")


# --- the join -----------------------------------------------------------------------------------------


def classes_and_links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, counting: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The set table, the classes (k, doc_id, n, weight: their rows) and k, head (connected with k), links (the rows of the
    classes that k is linked with; in parts, to be summed)."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(whole_text())), F.lit(0))).first()[0]
    table = materialize(set_table(docs, k, num, den))
    classes = materialize(table.where("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("plain").alias("plain"), F.count("*").alias("weight")))
    few = tuple(sorted(r["n"] for r in classes.where("plain").select("n").distinct().collect()))  # sizes, no sets
    keys = region_keys(docs, k, num, den, partitions_for(spark, total, 16 << 20), few)
    regions = materialize(keys.groupBy("bucket").applyInArrow(_regions, "region long, k long, grid long, a long, n_keys long, size long"))
    crowded = F.col("size") > CROWD
    shared = regions.groupBy("k", "grid").agg(F.sum("n_keys").alias("shared"), F.sum(F.when(crowded, F.col("n_keys")).otherwise(0)).alias("crowded"))
    members = regions.join(shared, ["k", "grid"]).where((F.col("shared") >= F.col("a")) & (~crowded | (F.col("crowded") >= F.col("a")))).select("region", "k").distinct()
    heads = members.groupBy("region").agg(F.min("k").alias("head"), F.count("*").alias("many")).where("many > 1")
    united = components(members.join(heads, "region").where("k <> head"), "k", "head").withColumnRenamed("node", "k").withColumnRenamed("label", "unit")
    wanted = materialize(united.join(classes, "k").select("unit", "k", "doc_id", "weight", "n"))
    discard(regions)
    # sets of many candidates are larger than the texts: they are written and joined in turns, whole units in each
    room = max(ROOM, total // 4)
    turns = max(1, -(-8 * wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // room))
    found = []
    for i in range(turns):
        share = wanted.where(F.pmod(F.xxhash64("unit", F.lit(-3)), F.lit(turns)) == i) if turns > 1 else wanted
        rows = _sets_of(docs, share, k).select("*", F.lit(True).alias("home"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("was"))
        found.append(join_units(materialize(rows), num, den, counting, room))
    return table, classes, reduce(DataFrame.unionByName, found)


def _labelled(docs: DataFrame, k: int, num: int, den: int, counting: bool) -> tuple[DataFrame, DataFrame]:
    """The set table, and k, doc_id, label (the same for linked classes) and n_links (of each row) of each class."""
    table, classes, found = classes_and_links(docs, k, num, den, counting)
    label = components(found, "k", "head").select(F.col("node").alias("k"), "label")
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    named = classes.join(label, "k", "left").join(links, "k", "left")
    return table, named.select("k", "doc_id", F.coalesce("label", "k").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def similar_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and n_links (how many other rows it is linked
    with) for each row of docs."""
    table, named = _labelled(docs, k, num, den, True)
    named = materialize(named)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "label").select("k", "component_id", "n_links")
    return table.join(found, "k", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _class_of(k: int):
    @F.pandas_udf("long")
    def class_of(text):
        import pandas as pd

        out, raw = [], list(text)
        for a, b in batches(raw, 1 << 20):
            out += [int(set_key(s).view(np.int64)) if len(s) else None for s in shingle_sets(raw[a:b], k)]
        return pd.Series(out + [None] * (len(raw) - len(out)), dtype="Int64")

    return class_of


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group, that of the smallest id; texts without words all stay.

    Rows are told apart by their id and their own text's class, so that each group keeps one row if its ids are null
    or stand at other texts too. Of repeated rows of an id and class, and of an id's texts without words, the first in
    order of all columns' hash stays; rows without words and id all stay.
    """
    from pyspark.sql import Window

    _, named = _labelled(docs, k, num, den, False)
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k")).alias("x")).select(F.col("x.k").alias("_k"), F.col("x.doc_id").alias("_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = bounded_batches(docs).select("doc_id", F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("h"), _class_of(k)(whole_text().cast("binary")).alias("k"))
    # rows without words and id are each their own; numbered as they are read, a lost task's rows get the same numbers again
    rows = rows.withColumn("alone", F.when(F.col("k").isNull() & F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    # one pass and one shuffle: rows that the groups chose, and rows without words; join and window are dealt by one hash
    rows, first = rows.withColumn("p", F.xxhash64("k", "doc_id", "alone")), first.withColumn("_p", F.xxhash64("_k", "_id"))
    chosen = (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    found = rows.join(first, F.col("p") == F.col("_p"), "left").where(chosen | F.col("k").isNull())
    out = found.withColumn("n", F.row_number().over(Window.partitionBy("p", "doc_id", "k", "alone").orderBy("h"))).where("n = 1")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: DuckDB SQL for similar_documents(documents, 4, 85, 100).
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_have JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM reach JOIN edges ON b = x)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, coalesce(any_value(e.n), 0) AS n_links FROM reach LEFT JOIN n ON n.doc_id = a LEFT JOIN (SELECT x, count(*) AS n FROM edges GROUP BY x) e ON e.x = a GROUP BY a
"""
