"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed five-word shingles (words: digits, letters and all beyond ASCII, A-Z
lowered). Equal sets are one class, compared once. Band and row counts follow from the recall wanted
at the threshold, where a candidate pair shares at least two bands. Classes meet in the buckets of
their bands' hashes, first with nothing but their band hashes:

1. Classes that share many bands are given one *home*; a home gathers a group of near copies. In a
   large bucket the members are compared with a part of them: who misses a home is a stranger below.
2. All pairs inside a home are verified on the full sets, which travel there once. Candidate pairs
   of different homes are verified in the first bucket that the two share, where only classes with
   such a pair send their sets. So each link counts once.

Pairs are never rows: a task returns how many documents each class is linked to, and a spanning
forest of its links. Large buckets and homes are cut, and the pairs of cuts are dealt out, so no task
holds a whole one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import kernel as K
from quillon.llm.components import components
from quillon.llm.shared import small, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Bands that a candidate pair shares at least, and share of all bands that makes two classes one home's.
LEAST_SHARED, HOME_SHARE = 2, 0.25
#: Shingles (8 bytes each) in one cut of a home or bucket, and in one task's group of them, about.
CUT_SHINGLES, GROUP_SHINGLES = 1 << 20, 1 << 20
#: Classes in one cut of a bucket or home, and in one task's group while only band hashes meet.
CUT_CLASSES, GROUP_CLASSES = 2_000, 2_000
#: Sets with more copies than this, and homes that are cut, are joined by broadcast where they are few bytes.
HOT_COPIES = 100_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance meetings, that ``most`` hashes allow.

    A pair at the threshold shares at least ``LEAST_SHARED`` bands with a probability of ``recall``.
    """
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        for bands in range(LEAST_SHARED, most // rows + 1):
            missed = sum(math.comb(bands, k) * p**k * (1 - p) ** (bands - k) for k in range(LEAST_SHARED))
            if missed <= 1 - recall:
                best = (bands, rows)
                break
    return best


def _sets(column: pa.Array, width: int):
    """For runs of rows: first row, shingle hashes, row bounds."""
    data, start, end = K.utf8(column)
    for i, j in K.blocks(start, end):
        buffer, bounds = K.gather(data, start[i:j], end[i:j])
        yield (i, *K.shingles(*K.words(buffer, bounds), width))


def _distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, without repeats."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.searchsorted(r[new], np.arange(len(bounds)))


def _identity(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sums over each set that has values (0 for empty ones), and which those are."""
    full = np.flatnonzero(np.diff(bounds))
    k1, k2 = (np.zeros(len(bounds) - 1, np.int64) for _ in range(2))
    if len(full):
        at = bounds[:-1][full]
        k1[full] = np.add.reduceat(K.mix64(values + K.U64(1)), at).view(np.int64)
        k2[full] = np.add.reduceat(K.mix64(values ^ K.U64(0xA5A5A5A5A5A5A5A5)), at).view(np.int64)
    return k1, k2, full


def signatures(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, k1 and k2 (identity of the set; null without words), size, bands (a hash each)."""
    n = bands * rows
    seeds = K.mix64(np.arange(1, 2 * n + 1, dtype=K.U64) * K.U64(0xD1342543DE82EF95))
    xor, mul = seeds[:n], seeds[n:] | K.U64(1)
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), *T._parse_datatype_string("k1 long, k2 long, size long, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds in _sets(batch.column(1), width):
                count = len(bounds) - 1
                values, bounds = _distinct(values, bounds)
                k1, k2, full = _identity(values, bounds)
                out = np.zeros((count, bands), K.U64)
                if len(full):
                    at = bounds[:-1][full]
                    for b in range(bands):
                        h = np.full(len(full), b + 1, K.U64)
                        for j in range(b * rows, (b + 1) * rows):
                            h = K.mix64(h + np.minimum.reduceat((values ^ xor[j]) * mul[j], at))
                        out[full, b] = h
                none = np.ones(count, bool)
                none[full] = False
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (count + 1) * bands, bands), pa.int32()), pa.array(out.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), pa.array(k1, mask=none), pa.array(k2, mask=none), pa.array(np.diff(bounds)), lists], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """k1, k2, shingles (sorted distinct hashes as bytes) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, bounds in _sets(batch.column(0), width):
                values, bounds = _distinct(values, bounds)
                k1, k2, _ = _identity(values, bounds)
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], names=["s1", "s2", "shingles"])

    return docs.select(text).mapInArrow(run, "s1 long, s2 long, shingles binary")


def _by_rows(n: int, make, step: int = 256) -> np.ndarray:
    """make(a, b) for runs of rows of a matrix of n rows, so that only matrices of one byte a pair are whole."""
    return np.concatenate([make(a, min(a + step, n)) for a in range(0, n, step)])


def verify(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of which pairs of sets have a Jaccard similarity of at least the threshold."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        common = np.zeros((2, 2), np.float32)
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        owner = np.repeat(np.arange(m), size)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1
        use = counts[inverse] > 1
        owner, place = owner[use], column[inverse[use]]
        by = np.argsort(place, kind="stable")
        owner, place = owner[by], place[by]
        common = np.zeros((m, m), np.float32)
        total, step = int(column[-1]) + 1 if len(column) else 0, max(256, (1 << 21) // m)
        for a in range(0, total, step):
            i, j = np.searchsorted(place, (a, a + step))
            x = np.zeros((m, min(step, total - a)), np.float32)
            x[owner[i:j], place[i:j] - a] = 1
            for r in range(0, m, 256):
                common[r : r + 256] += x[r : r + 256] @ x.T

    def similar(a: int, b: int) -> np.ndarray:
        both = common[a:b].astype(np.float64)  # whole numbers, exact up to 2 ** 24
        return (both >= np.ceil(threshold * (size[a:b, None] + size[None, :] - both) - 1e-9)) & (both > 0)

    linked = _by_rows(m, similar)
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each member of a bucket the first member of its component there."""
    n = len(linked)
    root = np.arange(n)
    while True:
        low = _by_rows(n, lambda a, b: np.where(linked[a:b], root[None, :], n).min(axis=1))  # noqa: B023
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _cut(rows: DataFrame) -> DataFrame:
    """Members (rep, band, hash, cuts) dealt to the pairs of cuts of their bucket; ``cut`` is a member's own."""
    own = F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")
    dealt = rows.distinct().withColumn("cut", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return dealt.select("rep", "band", "hash", "cut", F.least("cut", "other").alias("low"), F.greatest("cut", "other").alias("high"))


def _starred(rows: DataFrame) -> DataFrame:
    """Members of buckets dealt so that each cut meets the first one."""
    own = F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")
    dealt = rows.withColumn("cut", own).withColumn("high", F.explode(F.when(F.col("cut") == 0, F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("cut"))))
    return dealt.select("rep", "band", "hash", "cut", F.lit(0).alias("low"), "high")


def _dealt(rows: DataFrame, total: int, together: int) -> DataFrame:
    return rows.withColumn("group", F.pmod(F.xxhash64("band", "hash", "low", "high"), F.lit(max(1, -(-total // together)))))


def _groups(table: pa.Table, rep: np.ndarray):
    """Rows of each pair of cuts of each bucket in the table, by rep, and its (band, hash, low, high)."""
    where = np.stack([np.asarray(table[c]).astype(np.int64) for c in ("band", "hash", "low", "high")])
    order = np.lexsort((rep, *where[::-1]))
    ordered = where[:, order]
    first = np.flatnonzero(np.concatenate(([True], (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)))) if len(order) else np.empty(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=False):
        i = order[a:b]
        i = i[np.concatenate(([True], rep[i][1:] != rep[i][:-1]))]  # repeated rows of one id
        if len(i) > 1:
            yield i, tuple(ordered[:, a].tolist())


def _vectors(table: pa.Table, bands: int) -> np.ndarray:
    lists = table["bands"].combine_chunks()
    return np.asarray((pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists).flatten()).reshape(-1, bands)


def _shared(own: np.ndarray) -> np.ndarray:
    """How many bands each pair shares."""
    out = np.zeros((len(own), len(own)), np.uint8)
    for v in own.T:
        out += v[:, None] == v[None, :]
    return out


def _candidates(own: np.ndarray, home: np.ndarray, band: int) -> np.ndarray:
    """Pairs of different homes that share enough bands, of which this one is the first."""
    pairs = home[:, None] != home[None, :]
    if pairs.any():
        pairs &= _shared(own) >= LEAST_SHARED
        for v in own.T[:band]:
            pairs &= v[:, None] != v[None, :]
    return pairs


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links) for each row.

    n_links is how many other rows have a text whose shingle set is similar enough, copies included;
    class_id is the least id among all that are connected by links. A text of fewer than ``width``
    words is one shingle. Texts without words, null ones too, are linked to nothing and a class of
    their own. Rows with a null id are linked like others; where no connected row has an id their
    class is null. Rows that share an id are each linked by their own text. Ids may be of any type
    that has an order. Other columns don't matter. An empty table stays empty.
    """
    bands, rows = choose_bands(threshold, recall)
    every = written(signatures(docs, key, text, width, bands, rows), "signatures")
    # rep is a number of the class; equal sets have equal bands, so those of any row will do
    classes = every.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    heads = classes.select("rep", "copies", "size", "bands")
    met = heads.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = met.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = buckets.select(F.col("band").alias("b"), F.col("hash").alias("h"), F.ceil(F.col("n") / F.lit(CUT_CLASSES)).cast("int").alias("cuts"))
    members = written(met.join(buckets, (F.col("band") == F.col("b")) & (F.col("hash") == F.col("h"))).select("rep", "band", "hash", "cuts"), "buckets")
    needed = members.select("rep").distinct()
    vectors = written(heads.join(needed, "rep", "left_semi").select(F.col("rep").alias("r"), "copies", "size", "bands"), "vectors")
    starred = _starred(members)
    dealt = _dealt(starred.join(vectors, F.col("rep") == F.col("r")), members.count(), GROUP_CLASSES)
    least_home = max(LEAST_SHARED, math.ceil(HOME_SHARE * bands))

    def gather(table: pa.Table) -> pa.Table:
        """Who is of one home, as far as a bucket shows it."""
        rep, own, out = np.asarray(table["rep"]), _vectors(table, bands), []
        for i, _ in _groups(table, rep):
            root = _roots(_shared(own[i]) >= least_home)
            moved = np.flatnonzero(root != np.arange(len(i)))
            out.append(np.stack((rep[i[moved]], rep[i[root[moved]]]), axis=1))
        both = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        del own, out
        K.trim()
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    homes = written(components(dealt.groupBy("group").applyInArrow(gather, "a long, b long")), "homes")
    settled = written(vectors.join(homes, F.col("r") == F.col("node"), "left").select("r", "copies", "size", "bands", F.coalesce("component", "r").alias("home")), "settled")

    def strangers(table: pa.Table) -> pa.Table:
        """Members of buckets that have a candidate of another home there, and nowhere before."""
        rep, own = np.asarray(table["rep"]), _vectors(table, bands)
        home, cut, out = np.asarray(table["home"]), np.asarray(table["cut"]), []
        for i, (band, _, low, high) in _groups(table, rep):
            pairs = _candidates(own[i], home[i], band)
            if low != high:
                pairs &= cut[i][:, None] != cut[i][None, :]
            out.append(i[pairs.any(axis=1)])
        del own, home, cut
        K.trim()
        return table.select(["rep", "band", "hash", "cut", "low", "high"]).take(pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))

    # a bucket whose members are all of one home has no pairs for the next step, so its bands needn't travel again
    in_home = members.select("rep", "band", "hash").join(homes, F.col("rep") == F.col("node"), "left").select("band", "hash", F.coalesce("component", "rep").alias("home"))
    mixed = in_home.groupBy(F.col("band").alias("b"), F.col("hash").alias("x")).agg(F.min("home").alias("least"), F.max("home").alias("most")).where("least < most").select("b", "x")
    mixed = written(_cut(members.join(mixed, (F.col("band") == F.col("b")) & (F.col("hash") == F.col("x")), "left_semi")), "mixed")
    met_again = _dealt(mixed.join(settled, F.col("rep") == F.col("r")), mixed.count(), GROUP_CLASSES)
    across = met_again.groupBy("group").applyInArrow(strangers, "rep long, band int, hash long, cut int, low int, high int")
    # only nodes of edges are in ``homes``, so each home there has two members at least; few are large
    sizes = settled.groupBy(F.col("home").alias("h")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m"))
    large = sizes.select("h", F.ceil(F.greatest(F.col("n") / F.lit(CUT_SHINGLES), F.col("m") / F.lit(CUT_CLASSES))).cast("int").alias("cuts")).where("cuts > 1")
    inside = homes.join(small(written(large, "large"), "h"), F.col("component") == F.col("h"), "left")
    inside = _cut(inside.select(F.col("node").alias("rep"), F.lit(-1).alias("band"), F.col("component").alias("hash"), F.coalesce("cuts", F.lit(1)).alias("cuts")))
    places = written(inside.unionByName(across), "places")
    wanted = places.select(F.col("rep").alias("need")).distinct()
    sought = written(classes.join(wanted, F.col("rep") == F.col("need"), "left_semi").select("rep", "head", "k1", "k2"), "sought")
    heads_sought = sought.where("head IS NOT NULL").select("head").distinct()
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    by_id = source.where("id IS NOT NULL").join(small(heads_sought, "head"), F.col("id") == F.col("head"), "left_semi")
    # texts that only rows without an id have; one of equal ones
    nameless = source.where("id IS NULL").dropDuplicates(["text"]) if sought.where("head IS NULL").limit(1).count() else source.limit(0)
    sets = shingle_sets(by_id.unionByName(nameless), "text", width)
    bodies = sought.join(sets, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).select(F.col("rep").alias("b_rep"), "shingles")
    bodies = settled.join(bodies, F.col("r") == F.col("b_rep"))
    total = int(places.join(settled, F.col("rep") == F.col("r")).agg(F.sum("size").alias("n")).first()["n"] or 0)
    verified = _dealt(places.join(bodies, F.col("rep") == F.col("r")), total, GROUP_SHINGLES)

    def link(table: pa.Table) -> pa.Table:
        rep, copies, own = np.asarray(table["rep"]), np.asarray(table["copies"]), _vectors(table, bands)
        home, cut, raw = np.asarray(table["home"]), np.asarray(table["cut"]), table["shingles"]
        out_rep, out_root, out_links = [], [], []
        for i, (band, _, low, high) in _groups(table, rep):
            linked = verify([np.frombuffer(raw[int(x)].as_py(), K.U64) for x in i], threshold)
            if low != high:
                linked &= cut[i][:, None] != cut[i][None, :]
            if band >= 0:
                linked &= _candidates(own[i], home[i], band)
            links = _by_rows(len(i), lambda a, b: linked[a:b] @ copies[i])  # noqa: B023
            hit = np.flatnonzero(links)
            out_rep.append(rep[i[hit]])
            out_links.append(links[hit])
            out_root.append(rep[i[_roots(linked)[hit]]])
        del own, raw, home, cut
        K.trim()
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.table({"rep": cat(out_rep), "root": cat(out_root), "links": cat(out_links)})

    found = written(verified.groupBy("group").applyInArrow(link, "rep long, root long, links long"), "links")
    links = found.groupBy(F.col("rep").alias("l")).agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = classes.select("rep", "k1", "k2", "head", "copies").join(links, F.col("rep") == F.col("l"), "left").join(parts, F.col("rep") == F.col("node"), "left").withColumn("whole", F.coalesce("component", "rep"))
    placed = written(placed.select("rep", "k1", "k2", "head", "copies", "links", "whole", (F.col("component").isNotNull()).alias("joined")), "placed")
    least = placed.where("joined").groupBy(F.col("whole").alias("w")).agg(F.min("head").alias("least"))
    named = placed.join(least, F.col("whole") == F.col("w"), "left").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.when(F.col("joined"), F.col("least")).otherwise(F.col("head")).alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "copies")
    own = every.select("id", "k1", "k2")
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    hot = small(written(named.where(F.col("copies") > HOT_COPIES), "hot"), "class")
    rest = own.join(hot, same, "left_anti").join(named.where(F.col("copies") <= HOT_COPIES), same, "left")
    joined = rest.unionByName(own.join(hot, same))
    wordless = F.col("k1").isNull()
    return joined.select(F.col("id").alias(key), F.when(wordless, F.col("id")).otherwise(F.col("class")).alias("class_id"), F.when(wordless, 0).otherwise(F.col("n")).cast("long").alias("n_links"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """One row for each document: its class and its number of links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
