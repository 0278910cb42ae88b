"""The stages of the pipeline and run() against a second implementation over all rows at once."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import op2_quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __x string, kept string, k1 long, hit_places string"
EXTRA = ("x", "y", 1, "z")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def prose(rng, n):
    common = list(op2_quality.COMMON["en"])
    weights = list(op2_quality.COMMON["en"].values())
    word = lambda: "".join(rng.choice("aeiourstlndhc") for _ in range(rng.randint(2, 9)))
    return " ".join((rng.choices(common, weights)[0] if rng.random() < sum(weights) else word()) + rng.choice(("", "", "", "", "", ".", ",")) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    base = [prose(rng, n) for n in (60, 90, 120, 200, 400)]
    passage, item = prose(rng, 70), prose(rng, 30)
    near = base[2].split()
    near[50] = "changed"
    texts = [None, "", " \n ", "short text", "a | b | c " * 40, *base, base[1], base[1], " ".join(near), prose(rng, 80) + "\n" + passage, passage + "\n" + prose(rng, 90), prose(rng, 70) + " " + item + " " + prose(rng, 70), "日本語" * 40 + base[0], "the same line\n" * 60]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, base[3]), (20, base[4]), (20, base[4]), (None, base[3]), (None, base[3]), (None, None), (21, passage + " " + prose(rng, 60)), (5, base[0])]
    at = tmp_path_factory.mktemp("sf")
    full = [(i, t, "en", "s", None if t is None else len(t), *EXTRA) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"file://{at}/documents.parquet")
    bench = [(1, item), (2, None), (3, "unlikely three words"), (3, item), (None, prose(rng, 20))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}", full, bench


def js(p, q):
    t = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        t += (a * math.log2(a / m) if a > 0 else 0) + (b * math.log2(b / m) if b > 0 else 0)
    return math.sqrt(max(t / 2, 0))


def is_kept(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    if len(w) < 50 or 100 * len(again) > 50 * len(w):
        return False
    up, letters = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
    digits, white, stops = sum(c in "0123456789" for c in t), sum(c in " \t\n\x0b\x0c\r" for c in t), sum(c in ".,;:!?'\"()-" for c in t)
    chars = [x / len(t) for x in (letters - up, up, digits, white, stops, len(t) - letters - digits - white - stops)]
    c, fits = Counter(w), []
    for name, shares in op2_quality.COMMON.items():
        own = [c[v] / len(w) for v in shares]
        of_words = js([*own, max(0.0, 1 - sum(own))], [*shares.values(), 1 - sum(shares.values())])
        of_chars = js(chars, op2_quality.CHARACTERS[name])
        fits.append((of_words if len(w) >= 60 else of_chars, of_words, of_chars))
    _, best, of_chars = min(fits, key=lambda x: x[0])
    if len(t) >= 200 and of_chars > 0.25:
        return False
    return len(w) < 60 or best <= 0.19 + 0.9 / math.sqrt(len(w))


def quality(rows, bench):
    return [r for r in rows if is_kept(r[1])]


def near_duplicate(rows, bench):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    s = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[label[i]] = min(least.get(label[i], r[0]), r[0])
    heads = {r[0] for i, r in enumerate(rows) if r[0] is not None and (not s[i] or least[label[i]] == r[0])}
    out, seen = [], set()
    for r in rows:
        if r[0] is None or r[0] in heads and (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out


def repeated_passages(rows, bench, n=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first[b[k : k + n]] = min(first.get(b[k : k + n], 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, t, lang, source, chars, *more in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < (1 << 61 if i is None else i):
                gone[k : k + n] = b"\1" * n
        if any(gone):
            kept, at = "", 0
            for c in t:
                size = len(c.encode())
                kept += "" if all(gone[at : at + size]) else c
                at += size
            if not re.search(r"[^\x20\x09-\x0D]", kept):
                continue
            t, chars = kept, len(kept)
        out.append((i, t, lang, source, chars, *more))
    return out


def decontaminate(rows, bench):
    windows = set()
    for _, t in bench:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    lengths = {len(x) for x in windows}

    def hit(t):
        w = WORD.findall((t or "").translate(LOWER))
        return any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))

    return [r for r in rows if not hit(r[1])]


def packed(rows):
    """(doc_id, piece, start, length, the ids) of each document's pieces."""
    lib, out = tokens.encoder(tokens.default_path())._library, []
    for i, t, *_ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) - 1024 * (-(-len(ids) // 1024) - 1)
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        out += [(i, k, a, b - a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return out


STAGES = {"quality": quality, "near_duplicate": near_duplicate, "repeated_passages": repeated_passages, "decontaminate": decontaminate}


def test_stages_against_brute_force(spark, folder):
    import zlib

    at, rows, bench = folder
    now, seen = spark.read.parquet(f"{at}/documents.parquet"), [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = STAGES[name](rows, bench)
        now = spark.createDataFrame(stage(spark, now, at).collect(), SCHEMA)
        assert now.columns == [f.partition(" ")[0] for f in SCHEMA.split(", ")], name
        assert sorted(map(str, map(tuple, now.collect()))) == sorted(map(str, want)), name
        rows = want
        seen.append(len(rows))
    assert len(set(seen)) == 5 and seen[-1] > 5  # each stage takes some
    want = sorted((str(i), k, a, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, k, a, n, ids in packed(rows))
    for got in (corpus_pipeline.STAGES[-1][1](spark, now, at), corpus_pipeline.run(spark, at)):
        got = got.collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            ends = [a + n for a, n in sorted(p)]
            assert [a for a, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_stages_of_empty_and_null_tables(spark, folder):
    at = folder[0]
    empty = spark.createDataFrame([], SCHEMA)
    nothing = spark.createDataFrame([(None,) * 9, (1, *(None,) * 8), (1, *(None,) * 8)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0, name
        assert stage(spark, nothing, at).count() == {"quality": 0, "near_duplicate": 2}.get(name, 3), name


def test_pipeline_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
