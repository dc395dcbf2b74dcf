"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import arrow_type, bitmap, components, durable, filter_power

#: Fragments of the n-grams outside the table of common ones (ordered by hash); the common ones, ordered by frequency, are one more.
FRAGMENTS = 8
#: Entries of the broadcast table of common n-grams, at most: 3 MB.
COMMON = 1 << 18
#: An n-gram in fewer documents than this is not common.
COMMON_FROM = 16
#: N-grams that a task gathers before it sorts and counts them.
BLOCK = 1 << 21
#: A prefix list of this many different sets is first tied to its hubs.
HEAVY = 32
#: Bits of the filter of n-grams, as a power of two: 16 MB whatever the table's size.
GRAMS = 27
#: A filter of documents to be verified holds at most this many; more are selected by a join.
FILTER_ROWS = 1 << 25
#: Rounds that tie long lists to hubs, and hubs of each list and size band in a round.
ROUNDS = 2
HUBS = 4


def _sets(batch, data, offsets, n: int):
    data = tk.LOWER[data]
    starts, ends, first = tk.word_bounds(data, offsets, tk.SOLID)
    return tk.shingle_sets(tk.span_hashes(data, starts, ends), first, n)


def _count(n: int, ranges: int):
    """Rows (range, keys, counts): sorted n-gram keys of one range of hashes with their documents, as far as one block of a task goes."""
    shift = tk.U64(64 - int(math.log2(ranges)))

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        s, c = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(s >> shift, np.arange(ranges + 1, dtype=np.uint64))
        keys = ((s << tk.U64(64 - int(shift))) >> tk.U64(32)).astype(np.uint32)
        full = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
        parts = [(keys[cuts[r] : cuts[r + 1]].tobytes(), c[cuts[r] : cuts[r + 1]].astype(np.uint32).tobytes() if c[cuts[r] : cuts[r + 1]].max() > 1 else None) for r in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["range", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch, data, offsets in tk.steps(whole, "_text"):
                for s in _sets(batch, data, offsets, n):
                    held.append(s)
                    size += len(s)
                    if size >= BLOCK:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


def _sum(ranges: int):
    """Rows (range, key, docs) of common n-grams, and one (range, bits) that marks all keys of the range that are in two documents or more."""
    power = GRAMS - int(math.log2(ranges))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()])
        counts = np.concatenate([np.ones(len(k) // 4, np.uint32) if c is None else np.frombuffer(c, np.uint32) for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)])
        found, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts, len(found)).astype(np.int64)
        bits = np.zeros(1 << power, dtype=bool)
        bits[found[total > 1] >> np.uint32(32 - power)] = True
        keep = total >= COMMON_FROM
        rows = int(keep.sum()) + 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"range": pa.array(np.full(rows, key[0].as_py()), pa.int32()), "key": pa.array([None, *found[keep].tolist()], pa.int64()), "docs": pa.array([None, *total[keep].tolist()], pa.int64()), "bits": pa.array([packed] + [None] * (rows - 1), pa.binary())})

    return run


class _Order:
    """The global order: n-grams of one document by hash, then others outside the table by hash, then those in it by frequency and hash."""

    def __init__(self, value):
        self.ranges, keys, docs, bits = value
        self.keys, self.docs, self.bits = np.frombuffer(keys, np.uint64), np.frombuffer(docs, np.int64), np.frombuffer(bits, np.uint8)

    def rank(self, s: np.ndarray) -> np.ndarray:
        """0 for n-grams of one document only (or, rarely, 1), 1 for others outside the table, else their documents."""
        again = tk.in_bits(s, self.bits, GRAMS)
        out = again.astype(np.int64)
        out[again] = np.maximum(1, self.common(s[again]))
        return out

    def common(self, s: np.ndarray) -> np.ndarray:
        """Documents of those of `s` that are in the table; 0 for others."""
        if not len(self.keys) or not len(s):
            return np.zeros(len(s), np.int64)
        bits = int(math.log2(self.ranges))
        key = s >> tk.U64(32 - bits)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.docs[at], 0)


def _order(texts: DataFrame, n: int):
    """Counts every n-gram of all documents; the table of the most frequent, cut off at the frequency at which it fits."""
    spark = texts.sparkSession
    ranges = 1 << min(20, max(6, math.ceil(math.log2(32 * max(1, texts.rdd.getNumPartitions())))))
    counts = durable(texts.mapInArrow(_count(n, ranges), "range int, keys binary, counts binary").groupBy("range").applyInArrow(_sum(ranges), "range int, key long, docs long, bits binary"))
    least, room = 1 << 62, COMMON
    for docs, many in sorted(counts.where("docs is not null").groupBy(F.floor(F.log2("docs")).alias("d")).count().collect(), reverse=True):
        room -= many
        if room < 0:
            break
        least = 1 << int(docs)
    table = counts.where(F.col("docs") >= least).toArrow()
    key = (table["range"].to_numpy().astype(np.uint64) << tk.U64(32)) | table["key"].to_numpy().astype(np.uint64)
    by = np.argsort(key)
    width = (1 << GRAMS) // ranges // 8
    again = bytearray(1 << (GRAMS - 3))
    for r in counts.where("bits is not null").select("range", "bits").toArrow().to_pylist():
        again[r["range"] * width : (r["range"] + 1) * width] = r["bits"]
    return spark.sparkContext.broadcast((ranges, key[by].tobytes(), table["docs"].to_numpy()[by].astype(np.int64).tobytes(), bytes(again)))


def _signs(n: int, order, num: int, den: int, id_type: pa.DataType):
    """One row per document: set size, a 128-bit hash of the set, and those n-grams of its prefix in the global order that other documents have, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _Order(order.value)
        for whole in batches:
            for batch, data, offsets in tk.steps(whole, "_text"):
                sets = list(_sets(batch, data, offsets, n))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                s = np.concatenate(sets)
                ranks = rank.rank(s)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                h = []
                for mixed in (tk.mix(s + tk.U64(0x51ED270B)), tk.mix(s ^ tk.U64(0xA24BAED4963EE407))):
                    sums = np.zeros(len(s) + 1, dtype=np.uint64)
                    np.cumsum(mixed, out=sums[1:])
                    h.append(np.diff(sums[cuts]).view(np.int64))
                lengths = np.where(sizes > 0, sizes + (-num * sizes) // den + 1, 0)
                prefixes, places = [], []
                for d, own in enumerate(sets):
                    f = ranks[cuts[d] : cuts[d + 1]]
                    by = np.argsort(f, kind="stable")[: lengths[d]]
                    alone = int(np.searchsorted(f[by], 1))
                    prefixes.append(own[by[alone:]])
                    places.append(np.arange(alone, len(by), dtype=np.int32))
                offsets_ = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets_, pa.array(np.concatenate(x) if x else [], t)) for x, t in (([y.view(np.int64) for y in prefixes], pa.int64()), (places, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("_doc").cast(id_type), pa.array(sizes), pa.array(h[0]), pa.array(h[1]), *lists], ["_doc", "_n", "_h1", "_h2", "_prefix", "_pos"])

    return run


def _segments(n: int, order, wanted):
    """Rows (doc, h1, fragment, its n-grams): a set cut along the global order, for documents whose id passes the filter, if there is one. N-grams of one document are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bits = _Order(order.value), np.frombuffer(wanted.value, dtype=np.uint8) if wanted else None
        for whole in batches:
            if wanted:
                whole = whole.filter(pa.array(tk.in_bits(whole.column("_id").to_numpy().view(np.uint64), bits)))
            for batch, data, offsets in tk.steps(whole, "_text"):
                rows, fragments, flat, lengths, h1 = [], [], [], [], []
                for d, s in enumerate(_sets(batch, data, offsets, n)):
                    if not len(s):
                        continue
                    sign = int(np.sum(tk.mix(s + tk.U64(0x51ED270B)), dtype=np.uint64).view(np.int64))
                    ranks = rank.rank(s)
                    s = s[ranks > 0]
                    f = np.where(ranks[ranks > 0] > 1, FRAGMENTS, (s >> tk.U64(61)).astype(np.int64))
                    by = np.argsort(f, kind="stable")
                    cuts = np.searchsorted(f[by], np.arange(FRAGMENTS + 2))
                    for k in np.flatnonzero(np.diff(cuts)):
                        rows.append(d), fragments.append(k), lengths.append(cuts[k + 1] - cuts[k]), h1.append(sign)
                    flat.append(s[by])
                grams = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(grams))
                yield pa.RecordBatch.from_arrays([batch.column("_doc").take(pa.array(rows, pa.int64())), pa.array(h1, pa.int64()), pa.array(fragments, pa.int32()), lists], ["_doc", "_h1", "_fragment", "_grams"])

    return run


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """Classes of documents whose sets of word n-grams have a Jaccard similarity of num / den or more, linked through any chain.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Equal sets are one class from the start, so copies are never
    paired. All n-grams of all documents are counted once; the global order starts with those of one document and puts frequent ones last. Two sets can only link if they share
    one of the first n - ceil(n * num / den) + 1 in that order (their prefix). Long prefix lists are first tied to one set per size band;
    what that links is one component, within which no pair is needed any more. All other pairs that share a prefix n-gram are
    ruled out by size and by the n-gram's place in both sets. Pairs that remain are verified by fragments of the order: each fragment's
    overlap is counted by itself and summed per pair. No list is cut, no candidate dropped: every link between two components is found. A filter of at most
    `filter_rows` ids, which are counted, selects the documents of these pairs; where there are more, a join by shuffle does.

    Result, a row per input row: `id_col`, n_shingles, component_id (the smallest id reachable). Documents of fewer than n words have
    their whole word sequence as one n-gram; null or wordless texts have none, link with nothing and have their own id as component. A
    null id links with nothing and its component is null. Rows that repeat an id are one document: the one with the smaller set hash is
    linked, all of them get its component. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    id_type = arrow_type(docs, id_col)
    order = _order(texts.select("_text"), n)
    signs = durable(texts.mapInArrow(_signs(n, order, num, den, id_type), f"_doc {kind}, _n long, _h1 long, _h2 long, _prefix array<long>, _pos array<int>"))
    one = signs.where("_n > 0 and _doc is not null").groupBy("_doc").agg(F.min(F.struct("_h1", "_h2")).alias("_h")).select("_doc", "_h._h1", "_h._h2")
    classes = durable(one.groupBy("_h1", "_h2").agg(F.min("_doc").alias("_rep")))
    reps = durable(signs.join(classes, (F.col("_doc") == F.col("_rep")) & (signs["_h1"] == classes["_h1"]) & (signs["_h2"] == classes["_h2"])).select("_rep", "_n", signs["_h1"], "_prefix", "_pos").dropDuplicates(["_rep"]))

    postings = reps.select(F.col("_rep").alias("a"), "_n", F.explode(F.arrays_zip(F.col("_prefix").alias("token"), F.col("_pos").alias("pos"))).alias("z")).select("a", "_n", "z.token", "z.pos")
    lists = postings.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    postings = durable(postings.join(lists, "token"))
    fits = lambda x, y: (x * den >= y * num) & (y * den >= x * num)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) that link."""
        pairs = durable(pairs)
        wanted = durable(pairs.select(F.col("a").alias("_doc")).union(pairs.select(F.col("b").alias("_doc"))).distinct())
        number, source, bits = wanted.count(), texts.withColumn("_id", F.xxhash64("_doc")), None
        if number <= filter_rows:
            bits = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("_doc").alias("_id")), "_id", filter_power(number)))
        else:
            source = source.join(wanted, "_doc", "left_semi")
        cut = source.mapInArrow(_segments(n, order, bits), f"_doc {kind}, _h1 long, _fragment int, _grams array<long>")
        own = wanted.join(reps.select(F.col("_rep").alias("_doc"), "_h1"), "_doc")
        cut = durable(cut.join(own, ["_doc", "_h1"], "left_semi").dropDuplicates(["_doc", "_fragment"]))
        left = pairs.join(cut.select(F.col("_doc").alias("a"), "_fragment", F.col("_grams").alias("_ga")), "a")
        both = left.join(cut.select(F.col("_doc").alias("b"), "_fragment", F.col("_grams").alias("_gb")), ["b", "_fragment"])
        part = both.select("a", "b", "na", "nb", F.size(F.array_intersect("_ga", "_gb")).alias("part"))
        whole = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
        return whole.where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of lists that hold more than one component."""
        return rows.join(rows.groupBy("token").agg((F.min("root") != F.max("root")).alias("_mixed")).where("_mixed").select("token"), "token", "left_semi")

    # A set most of whose prefix is in long lists has few n-grams of its own: it is near the middle of its group, and a good hub.
    band = F.floor(F.log(F.col("_n")) / math.log(den / num)).cast("int")
    heavy = postings.where(F.col("sets") >= HEAVY)
    heavy = durable(heavy.join(heavy.groupBy("a").agg(F.count("*").alias("score")), "a").withColumn("band", band))
    links = postings.select("a", F.col("a").alias("b")).limit(0)
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("root"))
    for turn in range(ROUNDS if heavy.take(1) else 0):
        left = durable(mixed(rooted(heavy, roots)))
        hubs = left.groupBy("token", "band", F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(HUBS)).alias("lot")).agg(F.max(F.struct("score", "a", "_n", "root")).alias("hub"))
        near = left.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(hubs, ["token", "band"])
        stars = near.where((F.col("root") != F.col("hub.root")) & fits(F.col("_n"), F.col("hub._n"))).select("a", F.col("hub.a").alias("b"), F.col("_n").alias("na"), F.col("hub._n").alias("nb")).distinct()
        links = durable(links.union(verified(stars)))
        roots = durable(components(links))

    # A pair that links has all of its overlap from its first common n-gram on, so a place in a set bounds the size of the other: num times it is at most `reach`.
    reach = (F.col("_n") - F.col("pos")) * (num + den) - F.col("_n") * num
    placed = rooted(postings, roots).select("token", "a", "_n", reach.alias("reach"), "sets", "root")
    placed = durable(mixed(durable(placed)))
    other = placed.select("token", *(F.col(c).alias(f"{c}_b") for c in ("a", "_n", "reach", "root")))
    able = fits(F.col("_n"), F.col("_n_b")) & (F.col("_n_b") * num <= F.col("reach")) & (F.col("_n") * num <= F.col("reach_b"))
    light = placed.where(F.col("sets") < HEAVY).join(other, "token").where((F.col("a") < F.col("a_b")) & (F.col("root") != F.col("root_b")) & able)
    # long lists: pairs of components first, so that the members of one are never set against each other
    groups = placed.where(F.col("sets") >= HEAVY).groupBy("token", "root").agg(F.min("_n").alias("low"), F.max("_n").alias("high"), F.max("reach").alias("reach"))
    beside = groups.select("token", *(F.col(c).alias(f"{c}_b") for c in ("root", "low", "high", "reach")))
    may = (F.col("high") * den >= F.col("low_b") * num) & (F.col("high_b") * den >= F.col("low") * num) & (F.col("low_b") * num <= F.col("reach")) & (F.col("low") * num <= F.col("reach_b"))
    facing = groups.join(beside, "token").where((F.col("root") < F.col("root_b")) & may).select("token", "root", "root_b")
    dense = facing.join(placed, ["token", "root"]).join(other, ["token", "root_b"]).where(able)
    columns = ("a", "_n", "a_b", "_n_b")
    met = light.select(*columns).union(dense.select(*columns))
    flip = F.col("a") < F.col("a_b")
    met = met.select(*(F.when(flip, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "a_b", "a"), ("a_b", "a", "b"), ("_n", "_n_b", "na"), ("_n_b", "_n", "nb")))).distinct()
    links = links.union(verified(met))
    roots = components(links)

    named = classes.join(roots, F.col("_rep") == F.col("node"), "left").select("_h1", "_h2", F.coalesce("root", "_rep").alias("_component"))
    named = one.join(named, ["_h1", "_h2"]).select("_doc", "_component")
    out = signs.select("_doc", "_n").join(named, "_doc", "left")
    return out.select(F.col("_doc").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_component", "_doc").alias("component_id"))
