"""Token files and WARC archives: round trips, index reads, and a second implementation of the rules."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from quillon.llm import filesink, op6_token_files, op7_warc, tokens
from quillon.llm.shared import new_folder
from tests.llm.texts import texts

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts())], "doc_id long, text string, start string, ids string")


def own_ids(t):
    return tokens.encoder(tokens.default_path())._library.encode(t or "", add_special_tokens=False).ids + [2]


def read_back(spark, folder, manifest):
    return op6_token_files.read_tokens(spark, folder, manifest, with_ids=True).orderBy("start").collect()


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 4000}, {"shard_bytes": 4000, "file_ids": 300}, {"shard_bytes": 1, "most_shards": 3, "file_ids": 1}])
def test_token_files(spark, docs, options):
    folder = new_folder(spark, "t")
    m = op6_token_files.write_tokens(docs, folder, **options)
    got, want = read_back(spark, folder, m), [own_ids(t) for t in texts()]
    assert [r.ids for r in got] == want and [r.doc_id for r in got] == list(range(len(want)))
    assert [r.start for r in got] == [sum(map(len, want[:i])) for i in range(len(want))]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    if options.get("file_ids"):
        assert m.count() > 3
    some = spark.createDataFrame([(0,), (8,), (15,), (99,), (None,), (8,)], "doc_id long")
    assert {r.doc_id: r.ids for r in op6_token_files.lookup_tokens(folder, m, some).collect()} == {i: want[i] for i in (0, 8, 15)}


def test_token_files_edges(spark, docs):
    folder = new_folder(spark, "t")
    none = op6_token_files.write_tokens(docs.limit(0), folder)
    assert none.count() == 0 and op6_token_files.read_tokens(spark, folder, none).count() == 0
    with pytest.raises(Exception, match="a document has no key"):
        op6_token_files.write_tokens(spark.createDataFrame([(None, "a")], "doc_id long, text string"), new_folder(spark, "t"))
    equal = spark.createDataFrame([(5, "b"), (5, "a a a"), (1, "c"), (5, "b")], "doc_id long, text string")
    folder = new_folder(spark, "t")
    got = read_back(spark, folder, op6_token_files.write_tokens(equal, folder))
    assert [r.doc_id for r in got] == [1, 5, 5, 5] and sorted(map(str, (r.ids for r in got))) == sorted(map(str, map(own_ids, ("b", "a a a", "c", "b"))))


class Memory(io.BytesIO):
    bytes = 0

    def write(self, data):
        self.bytes += len(data)
        return super().write(data)

    def close(self):
        pass


@pytest.mark.parametrize("n", [1, 511, 512, 513, 512 * 256 + 7, 400_000])
def test_token_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.02, rng.integers(0, 1 << 32, n), rng.integers(0, 1 << int(rng.integers(1, 17)), n)).astype(np.uint32)
    cut = np.unique(np.concatenate(([0], rng.integers(0, n, 50), [n])))
    out = Memory()
    w = op6_token_files.TokenWriter(out)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        w.add(np.array([a]), np.array([b - a]), ids[a:b])
    w.close()
    r = op6_token_files.TokenReader(out)
    assert (r.keys == cut[:-1]).all() and (r.bounds == cut).all() and (np.concatenate([x for _, _, x in r.runs()]) == ids).all()
    for a, b in zip(rng.integers(0, n, 30).tolist(), rng.integers(0, n + 1, 30).tolist(), strict=True):
        assert (r.read(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()
    with pytest.raises(ValueError):
        op6_token_files.TokenReader(io.BytesIO(out.getvalue()[:-3]))


def test_long_text_is_cut_where_tokens_begin():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    words = ["it's", "foo", "  ", "日本", "x" * 50, "\n", "'ll", "é", "1234", " "]
    text = " ".join(words[k] for k in rng.integers(0, len(words), 400_000))
    (_, ids, cut), = tokens.encode_column(pa.array([text]), tokens.default_path())
    assert len(text.encode()) > 2 << 20 and ids.tolist() == own_ids(text) and cut.tolist() == [0, len(ids)]


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b\n", "x"), (3, None, None), (4, "u", ""), (None, "n", "x"), (9, "é", "é" * 500)], PAGES)
    folder = new_folder(spark, "w")
    m = op7_warc.write_warc(pages, folder, file_bytes=300)
    got = {r.page_id: r for r in op7_warc.read_warc(spark, folder, m).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("revisit", 2), 9: ("response", None)}
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(b"x").digest()).decode() and got[9].payload_bytes == 1000
    empty = new_folder(spark, "w")
    none = op7_warc.write_warc(pages.limit(0), empty)
    assert none.count() == 0 and op7_warc.read_warc(spark, empty, none).count() == 0


def told(rows):
    """The rules again, over all rows at once."""
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    n = {}
    for _, _, h in rows:
        n[h or ""] = n.get(h or "", 0) + 1
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keeper = best.get(h or "") if n[h or ""] > 1 else None
        revisit = keeper is not None and keeper != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", ["even", "far", "clustered", "tied"])
def test_warc_against_the_rules(spark, shape):
    rng = random.Random(shape)
    ids = {"even": list(range(400)), "far": [*range(399), 1 << 50], "clustered": [*range(200), *range(10**12, 10**12 + 200)], "tied": [k // 40 for k in range(400)]}[shape]
    body = lambda: rng.choice(["", None, "same", "x" * 5000, str(rng.random()) * rng.randint(1, 60)])
    rows = [(i if rng.random() > 0.1 or shape != "tied" else None, rng.choice([None, "http://h/%d" % i, "a b"]), body()) for i in ids]
    rows += rows[:20] if shape == "tied" else []
    rows.append((max(ids) + 1, "big", "y" * 50_000))
    for hot in (2, 100_000):
        folder = new_folder(spark, "w")
        m = op7_warc.write_warc(spark.createDataFrame(rows, PAGES), folder, shard_bytes=20_000, file_bytes=400, hot_copies=hot)
        got = op7_warc.read_warc(spark, folder, m).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == told(rows)
        sizes = [r.units for r in m.groupBy("name").sum("units").withColumnRenamed("sum(units)", "units").collect()]
        assert m.count() > 8 and max(sizes) <= 52_000


def test_warc_files_are_the_same_again(spark):
    rows = [(i, f"http://h/{i % 7}", "p" * (i * 37 % 900)) for i in range(300)]
    seen = []
    for parts in (1, 7):
        folder = new_folder(spark, "w")
        m = op7_warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(parts), folder, shard_bytes=30_000, file_bytes=2000)
        seen.append([(r.name, hashlib.sha1(open(folder.removeprefix("file:") + "/" + r.name, "rb").read()).hexdigest()) for r in m.orderBy("name").collect()])
    assert seen[0] == seen[1] and len(seen[0]) > 3
    raw = gzip.decompress(open(folder.removeprefix("file:") + "/" + seen[0][0][0], "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_what_lost_attempts_leave_is_deleted(spark):
    folder = new_folder(spark, "w")
    left = filesink.Sink(folder)
    left.write(b"half")
    left.close()
    m = op7_warc.write_warc(spark.createDataFrame([(1, "u", "x")], PAGES), folder)
    import os

    names = os.listdir(folder.removeprefix("file:"))
    assert m.count() == 1 and not [n for n in names if n.startswith("_tmp-")]
