"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the hashes of a text's k-grams (k words), the least one of each window of w neighbouring k-grams is
a fingerprint. Any run of w + k - 1 words that two texts share has a fingerprint in both at the same
place, so joining fingerprints finds every shared run of 10 words (k = 5, w = 6). Hits are
extended on both sides: the windows of 10 words around a fingerprint that both sides have, six at most,
are joined by their words, so only true windows meet. Shorter items are one window each and have
fingerprints of their own for their length.

Documents are known by 128 bits of their id and text, so null and repeated ids don't meet. A document
gathers nothing but its own fingerprints and windows, an item the same. Texts are read again for
documents with a fingerprint that an item has. What is broadcast is measured in bytes first; where the
items' fingerprints are more than that, those of documents go through a bitmap before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.native import let, upto
from quillon.llm.shared import written

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of at most so many bytes, by count and content, are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row of numbers in a hashed table, about.
_ROW = 48


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def fingerprints(tokens: Column, shared: int) -> Column:
    """Array of (h, p): winnowed k-gram hashes and their places; guarantees runs of ``shared`` words."""
    k = -(-shared // 2)
    w = shared - k + 1
    grams = F.transform(upto(F.size(tokens) - (k - 1)), lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(k))))
    if w == 1:
        return F.transform(grams, lambda h, p: F.struct(h.alias("h"), p.alias("p")))

    def winnow(g: Column) -> Column:
        least = F.transform(upto(F.size(g) - (w - 1)), lambda i: F.least(*(F.get(g, i + j) for j in range(w))))
        # a k-gram is the least of some window if the largest minimum of its windows is its own hash
        chosen = lambda m: F.filter(F.transform(g, lambda h, p: F.struct(h.alias("h"), p.alias("p"))), lambda e: e["h"] == F.greatest(*(F.get(m, e["p"] - j) for j in range(w))))
        return let(least, chosen)

    return let(grams, winnow)


def _windows(tokens: Column, at: Column) -> Column:
    """Array of (n, s, g): the windows of n words that hold the fingerprint of each (n, p) of ``at``, each once, with their words.

    A fingerprint of windows of n words is in n - ceil(n / 2) + 1 of them at most.
    """
    begins = lambda e: F.sequence(F.greatest(e["p"] - e["n"] + F.ceil(e["n"] / 2).cast("int"), F.lit(0)), F.least(e["p"], F.size(tokens) - e["n"]))
    inside = F.filter(at, lambda e: F.greatest(e["p"] - e["n"] + F.ceil(e["n"] / 2).cast("int"), F.lit(0)) <= F.least(e["p"], F.size(tokens) - e["n"]))
    starts = F.array_distinct(F.flatten(F.transform(inside, lambda e: F.transform(begins(e), lambda s: F.struct(e["n"].alias("n"), s.alias("s"))))))
    return F.transform(starts, lambda e: F.struct(e["n"].alias("n"), e["s"].alias("s"), F.array_join(F.slice(tokens, e["s"] + 1, e["n"]), " ").alias("g")))


def _side(table: DataFrame, size: int, limit: int) -> DataFrame:
    return F.broadcast(table) if size <= limit else table


def _maybe_in(hashes: DataFrame, count: int, most: int) -> Callable[[Column], Column]:
    """A test that all ``hashes`` (column h) pass and few others: a bitmap of up to ``most`` bytes, about 8 bits a hash where these fit."""
    bits = 64
    while bits < 8 * count and bits < 8 * most:
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    set_bits = hashes.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    dense = hashes.sparkSession.range(bits // 64).join(set_bits, F.col("id") == F.col("at"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    bitmap = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda e: e["bits"])).scalar()
    return lambda h: F.expr("1L").bitwiseAND(F.call_function("shiftright", F.get(bitmap, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int"))) == 1


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with n_words, hit_places (word numbers inside any occurrence of a window), hit_items.

    Null texts have no words; items without words never hit. Rows of one item id are several texts
    of that item; repeated rows change nothing. Null document ids are compared like any other; rows
    that share an id are each judged on their own text. Null item ids hit, but aren't listed. Columns
    of the new names are replaced, others pass through; names that begin with ``__`` are reserved.
    Empty tables give no hits or no rows. Texts are read whole, however long. Items that share a phrase
    of fewer words than a window meet no document by it; those that share a window come in one row for
    each document and item that it is in.
    """
    passed = [c for c in docs.columns if c not in ("n_words", "hit_places", "hit_items")]
    count = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words")
    kinds = "array<int>", f"array<{benchmark.schema['item_id'].dataType.simpleString()}>"
    whole = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    items = written(whole.select(F.monotonically_increasing_id().alias("number"), "item", "iw", F.least(F.size("iw"), F.lit(window)).alias("n")), "items")
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most ``window`` values
    if not lengths:
        return docs.select(*passed, count, F.array().cast(kinds[0]).alias("hit_places"), F.array().cast(kinds[1]).alias("hit_items"))

    def prints(w: Column, of: Column | None = None) -> Column:
        """Fingerprints (n, h, p) for all lengths of items, or for the one that the item has."""
        one = lambda n: F.transform(fingerprints(w, n), lambda e: F.struct(F.lit(n).alias("n"), e["h"].alias("h"), e["p"].alias("p")))
        return F.concat(*(one(n) if of is None else F.when(of == n, one(n)).otherwise(F.filter(one(n), lambda e: F.lit(False))) for n in lengths))

    # fingerprints of documents that an item has too
    asked = written(items.select("number", F.explode(let(F.col("iw"), lambda w: prints(w, F.col("n")))).alias("e")).select("number", F.col("e.n").alias("n"), F.col("e.h").alias("h"), F.col("e.p").alias("p")), "asked")
    known = asked.select("n", "h").distinct()
    n_known = known.count()
    whose = F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull()
    names = (F.xxhash64(*whose, text).alias("__k1"), F.xxhash64(F.lit(1), text, *whose).alias("__k2"))
    # names first: beside the explode they would be computed again for each fingerprint
    named = docs.select(*names, F.col(text).alias("__text"))
    seen = named.select("__k1", "__k2", F.explode(let(words(F.col("__text")), lambda w: prints(w))).alias("e")).select("__k1", "__k2", F.col("e.n").alias("n"), F.col("e.h").alias("h"), F.col("e.p").alias("p"))
    if _ROW * n_known > broadcast_bytes:
        seen = seen.where(_maybe_in(known, n_known, broadcast_bytes)(F.col("h")))
    met = seen.join(_side(known, _ROW * n_known, broadcast_bytes), ["n", "h"], "left_semi")
    at = F.collect_set(F.struct("n", "p")).alias("__at")
    # one row for each document, of no more than its own fingerprints
    touched = written(met.groupBy("__k1", "__k2").agg(at, F.collect_set(F.struct("n", "h")).alias("__met")), "touched")

    # windows around these fingerprints, on both sides; only equal windows meet
    n_touched = touched.count()
    texts = docs.select(*names, F.col(text).alias("__text"))
    keys = touched.select("__k1", "__k2")
    few = texts.join(_side(keys, _ROW * n_touched, broadcast_bytes), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    own = few.join(touched.select("__k1", "__k2", "__at"), ["__k1", "__k2"])
    doc_windows = own.select("__k1", "__k2", F.explode(let(words(F.col("__text")), lambda w: _windows(w, F.col("__at")))).alias("e")).select("__k1", "__k2", "e.n", "e.s", "e.g")
    shared = touched.select(F.explode("__met").alias("e")).select("e.n", "e.h").distinct()
    theirs = asked.join(shared, ["n", "h"], "left_semi").groupBy("number").agg(F.collect_set(F.struct("n", "p")).alias("__at"))
    item_windows = items.join(theirs, "number").select("item", F.explode(_windows(F.col("iw"), F.col("__at"))).alias("e")).select("item", "e.n", "e.g").distinct()
    item_windows = written(item_windows, "windows")
    sizes = item_windows.agg(F.sum(_ROW + F.octet_length("g")).alias("n")).first()["n"] or 0
    hit = written(doc_windows.join(_side(item_windows.select("n", "g").distinct(), sizes, broadcast_bytes), ["n", "g"], "left_semi"), "met")
    places = hit.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("n", "s")).alias("w"))
    places = places.select("__k1", "__k2", F.array_sort(F.array_distinct(F.flatten(F.transform("w", lambda e: F.sequence(e["s"], e["s"] + e["n"] - 1))))).alias("__places"))
    pairs = hit.select("__k1", "__k2", "n", "g").distinct().join(_side(item_windows, sizes, broadcast_bytes), ["n", "g"])
    listed = pairs.groupBy("__k1", "__k2").agg(F.collect_set("item").alias("__items"))
    hits = written(places.join(listed, ["__k1", "__k2"]).select(F.col("__k1").alias("__h1"), F.col("__k2").alias("__h2"), "__places", "__items"), "hits")
    size = hits.agg(F.sum(_ROW + 4 * F.size("__places") + _ROW * F.size("__items")).alias("n")).first()["n"] or 0
    joined = docs.select(*passed, count, *names).join(_side(hits, size, broadcast_bytes), (F.col("__k1") == F.col("__h1")) & (F.col("__k2") == F.col("__h2")), "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    return joined.select(*passed, "n_words", none("__places", kinds[0]).alias("hit_places"), none("__items", kinds[1]).alias("hit_items"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hit_places").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.transform("hit_items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("hit_places") > 0).alias("contaminated"),
    )


def hits_sql(docs: str = "documents") -> str:
    """DuckDB SQL: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Needs unique doc_ids."""
    lower = lambda c: f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{pattern}') AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all({lower('text')}, '{pattern}') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
sizes AS (SELECT DISTINCT n FROM i),
dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT dg.doc_id, dg.n, dg.p, iw.item_id FROM dg JOIN iw ON dg.n = iw.n AND dg.g = iw.g),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM (SELECT DISTINCT doc_id, n, p FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


ORACLE_SQL = hits_sql()
