"""Each operator on small awkward tables, against a brute-force version or a round trip."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import kernel, op1_chat, op2_quality, op3_ordinal, op4_packing, op5_suffix_dedup, op8_html, op9_decontaminate, op10_ngram_join, tokens
from quillon.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string"


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("an", "ti", "é", "ou", "st", "the")) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(n)) for n in (4, 40, 80, 300, 2000)]
    edited = [" ".join("changed" if i == k else w for i, w in enumerate(base[2].split())) for k in (5, 40, 70)]
    return [None, "", " \n ", "!!!", base[0], *base[1:], base[2], base[2], *edited, base[3][:200] + " new words " + base[1], base[3], "x" * 120, "x" * 60, "日本語" * 30, "日本語" * 31, "it's <|endoftext|> <|im_end|> \\ <\\|"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "p") for i, t in enumerate(texts())], SCHEMA)


def removed(rows, length=50):
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def test_suffix_dedup(docs):
    for chunk in (1 << 22, 700):
        got = {r.doc_id: bytes(r.kept_bytes) for r in op5_suffix_dedup.remove_repeats(docs, chunk_bytes=chunk).collect()}
        assert got == removed(list(enumerate(texts())))
    assert op5_suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    text = {r.doc_id: r.kept_text for r in op5_suffix_dedup.remove_repeats(docs).select("doc_id", "kept_text").collect()}
    assert text[0] is None and text[2] == " \n "


def test_suffix_dedup_hot_anchors(spark):
    """A passage in most rows, whose edges differ in each; the same with and without hot anchors."""
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = own(130), own(55)
    rows = [(i, own(rng.randint(0, 90)) + shared + rng.choice(("x", "yz", own(40))) + (other if i % 3 else own(20)) + shared[:70]) for i in range(60)] + [(60, None), (61, shared[20:]), (62, "")]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), removed(rows)
    for hot in (2, 5, 1 << 30):
        got = op5_suffix_dedup.remove_repeats(docs, chunk_bytes=900, hot_chunks=hot).collect()
        assert {r.doc_id: bytes(r.kept_bytes) for r in got} == want


def test_suffix_dedup_ties_and_nulls(spark):
    t = "abcdefghij" * 8
    got = op5_suffix_dedup.remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 99, len(r.kept_bytes)) for r in got) == [(1, 80), (1, 80), (2, 0), (99, 0)]


def test_longest_previous_factors():
    """Against their definition, over the suffixes of groups of strings; positions repeat."""
    rng = random.Random(4)
    for _ in range(200):
        strings = [(rng.randint(0, 2), rng.randint(0, 5), "".join(rng.choice("ab\0") for _ in range(rng.randint(1, 12))).encode()) for _ in range(rng.randint(1, 8))]
        suffixes = [(g, d, t[k:]) for g, d, t in strings for k in range(len(t))]
        rows = np.zeros((len(suffixes), 12), np.uint8)
        for i, (_, _, t) in enumerate(suffixes):
            rows[i, : len(t)] = list(t)
        group, position, size = (np.array(x) for x in ([s[0] for s in suffixes], [s[1] for s in suffixes], [len(s[2]) for s in suffixes]))
        o = op5_suffix_dedup.suffix_order(group, rows, size)
        lcp = op5_suffix_dedup.common_prefix(group[o], rows[o], size[o])
        got = op5_suffix_dedup.longest_previous_factor(lcp, position[o])

        def shared(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        want = [max((shared(suffixes[i][2], t) for g, d, t in suffixes if g == suffixes[i][0] and d < suffixes[i][1]), default=0) for i in o]
        assert got.tolist() == want
    assert len(op5_suffix_dedup.longest_previous_factor(np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def test_suffix_dedup_long_rows_and_clashing_names(spark):
    """Rows of several blocks, a passage on a cut, and columns that the operator makes itself."""
    rng = np.random.default_rng(8)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    big, planted = text(2_500_000), text(300)
    cut = (1 << 20) - 120
    rows = [(1, planted, "x", "y", 1), (2, big[:cut] + planted + big[cut:], "x", "y", 2), (3, big[500_000:500_400], "x", "y", 3), (3, big[500_000:500_400], "x", "y", 3), (None, planted, "x", "y", 4), (None, big[:60], "x", "y", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, removed_spans string, n int")
    got = {(r.doc_id, r.n): r for r in op5_suffix_dedup.remove_repeats(d, chunk_bytes=1 << 20).collect()}
    assert [len(got[2, 2].removed_spans), got[2, 2].removed_spans[0].start, got[2, 2].removed_spans[0].end] == [1, cut, cut + 300]
    assert got[2, 2].kept_text == big and got[3, 3].kept_text == got[None, 4].kept_text == got[None, 5].kept_text == "" and got[1, 1].kept_text == planted


def sets(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs):
    s = [sets(t) for t in texts()]
    linked = {(i, j) for i in range(len(s)) for j in range(len(s)) if i != j and s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    got = {r.doc_id: r for r in op10_ngram_join.near_duplicates(docs).collect()}
    label = list(range(len(s)))
    for _ in s:
        for i, j in linked:
            label[i] = min(label[i], label[j])
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (label[i], sum(a == i for a, _ in linked)) for i in range(len(s))}
    assert op10_ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_cuts(docs, monkeypatch):
    want = sorted(map(tuple, op10_ngram_join.near_duplicates(docs).collect()))
    monkeypatch.setattr(op10_ngram_join, "CUT_CLASSES", 2)
    monkeypatch.setattr(op10_ngram_join, "CUT_SHINGLES", 100)
    assert sorted(map(tuple, op10_ngram_join.near_duplicates(docs).collect())) == want


def test_near_duplicates_recall_at_the_threshold(spark):
    """Lone pairs of similarity 0.8 exactly (40 of 50 shingles); the share missed is stated in the README."""
    rng, pairs = random.Random(11), 20_000
    word = lambda: f"{rng.getrandbits(40):x}"
    rows = []
    for i in range(pairs):
        w = [word() for _ in range(49)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:44] + [word() for _ in range(5)]))]
    found = op10_ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1 AND class_id = doc_id - doc_id % 2").count()
    assert found % 2 == 0 and pairs - found // 2 <= 6  # 1.8 expected at a recall of 0.9999


def test_near_duplicates_recall_against_exact_pairs(spark):
    """10,000 texts in groups of near copies (0.75 to 0.95): links against the exact ones, which groups alone have."""
    rng = random.Random(12)
    word = lambda: f"{rng.getrandbits(40):x}"
    rows, groups = [], []
    while len(rows) < 10_000:
        base = [word() for _ in range(rng.randint(40, 160))]
        members = []
        for _ in range(rng.choice((2, 2, 3, 5, 9))):
            w = list(base)
            for k in rng.sample(range(len(w)), round(len(w) * rng.choice((0, 0.005, 0.01, 0.015, 0.02)))):
                w[k] = word()
            w += [word() for _ in range(rng.randint(0, len(w) // 12))]
            members.append(len(rows))
            rows.append((len(rows), " ".join(w)))
        groups.append(members)
    s = [sets(t) for _, t in rows]
    want = Counter()
    close = 0
    for g in groups:
        for i in g:
            for j in g:
                x = len(s[i] & s[j]) / len(s[i] | s[j])
                if i != j and x >= 0.8:
                    want[i] += 1
                    close += x < 0.9
    got = {r.doc_id: r.n_links for r in op10_ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want.values()) > 10_000 and close > 3_000
    missed = sum(want[i] - got[i] for i in got)
    assert all(got[i] <= want[i] for i in got) and missed <= 0.0005 * sum(want.values()), (missed, sum(want.values()))


def test_near_duplicates_ids(spark):
    """Null and repeated ids, ids of text, clashing names: each row by its own text."""
    rng = random.Random(13)
    text = lambda n: " ".join(f"{rng.getrandbits(30):x}" for _ in range(n))
    a, b = text(60), text(60)
    near = a + " more"
    rows = [("7", a, 1), ("7", b, 2), ("8", near, 3), ("9", b, 4), (None, near, 5), (None, b, 6), (None, "only here " + a, 7), (None, text(40), 8), ("5", None, 9)]
    got = op10_ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, class_id int")).collect()
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in got)
    # a, near (twice) and the text around a are all linked: 0.8 at least
    assert found == Counter({("7", "7", 3): 1, ("7", "7", 2): 1, ("8", "7", 3): 1, ("9", "7", 2): 1, (None, "7", 3): 2, (None, "7", 2): 1, (None, None, 0): 1, ("5", "5", 0): 1})


def test_packing_edges(spark):
    rows = [(1, 0, 5, "a", 9), (1, 0, 5, "a", 9), (2, 0, 3, "b", 9), (None, 1, 8, "c", 9)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset string, sequence_id int")
    out = op4_packing.pack(pieces, capacity=8)
    got = out.collect()
    assert out.columns == ["doc_id", "piece", "length", "sequence_id", "offset"] and len(got) == 4
    places = Counter((r.sequence_id, r.offset) for r in got)
    assert max(places.values()) == 1 and len({r.sequence_id for r in got}) == 3
    for bad in ([(1, 0, None, "a", 9)], [(1, 0, 9, "a", 9)], [(1, 0, 0, "a", 9)]):
        with pytest.raises(ValueError):
            op4_packing.pack(spark.createDataFrame(bad, pieces.schema), capacity=8)
    assert op4_packing.pack(pieces.limit(0), capacity=8).count() == 0


def test_ordinal_query(spark):
    """Scores against the formula, and held-out separation; ids repeated, null, of text; the bound on the sample."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = op3_ordinal.fit(*op3_ordinal.sample_features(docs, op3_ordinal.graded(labels).where("doc_id % 2 = 0")))
    got = {r.doc_id: r for r in op3_ordinal.score(docs, model).collect()}
    weights = model.weights.astype(np.float32)
    for r in docs.orderBy("doc_id").limit(60).collect():
        _, ids, _ = next(iter(op3_ordinal.features(pa.array([r.text]))))
        tails = [1 / (1 + math.exp(k - sum(float(weights[i]) for i in ids))) for k in model.thresholds]
        assert abs(got[r.doc_id].expected_grade - sum(tails)) < 1e-4 and got[r.doc_id].kept == (got[r.doc_id].p_top >= 0.5)
    held = {r.doc_id: r.grade for r in op3_ordinal.graded(labels).where("doc_id % 2 = 1").collect()}
    clean, poor = [i for i, g in held.items() if g == 2], [i for i, g in held.items() if g == 1]
    assert sum(got[i].kept for i in clean) > 0.95 * len(clean) and sum(not got[i].kept for i in poor) > 0.6 * len(poor)
    odd = spark.createDataFrame([("a", "fine words"), ("a", "fine words again"), (None, "x"), ("b", None), ("c", "vile words")], "doc_id string, text string")
    marks = spark.createDataFrame([("a", 2), ("a", 0), (None, 1), ("b", 1), ("c", None), ("z", 2)], "doc_id string, grade int")
    _, bounds, grades = op3_ordinal.sample_features(odd, marks)
    assert sorted(grades.tolist()) == [0, 1] and len(bounds) == 3
    assert len(op3_ordinal.sample_features(odd, marks, sample=1)[2]) == 1 and len(op3_ordinal.sample_features(odd, marks, sample_bytes=8)[2]) == 0
    scored = op3_ordinal.score(odd, op3_ordinal.fit(np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)))
    assert scored.count() == 5 and scored.where("kept").count() == 5 and op3_ordinal.score(odd.limit(0), model).count() == 0


def test_quality_edges(spark):
    rng = random.Random(5)
    clean = " ".join(rng.choice(list(op2_quality.COMMON["en"]) + ["word" + str(k) for k in range(40)] * 3) for _ in range(70))
    rows = [(1, clean, "a"), (1, clean, "a"), (None, clean, "b"), (2, None, "c"), (3, "x\n" * 3 + "\n\ny\nx", "d"), (4, clean + " " + "word " * 300_000, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = op2_quality.judge(d).collect()
    assert len(got) == 6 and len({(r.kept, r.n_words, r.word_distance) for r in got[:3]}) == 1
    by = {r.doc_id: r for r in got}
    assert (by[3].n_dup_lines, by[2].n_words, by[2].base_failed, by[2].word_distance) == (3, 0, True, None)
    assert by[4].n_words == 300_070 and by[4].base_failed and op2_quality.judge(d.limit(0)).count() == 0


def test_chat_edges(spark):
    part = lambda t: [{"type": "text", "text": t, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}]
    long = "long <|im_end|> text " * 50_000
    rows = [(1, 0, "user", part("b")), (1, 0, "user", part("a")), (1, 0, "user", part("a")), (1, None, "assistant", part("n")), (2, 1, "assistant", part(long))]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{op1_chat.PART}>")
    got = {r.conv_id: r for r in op1_chat.parse_chats(op1_chat.format_chats(d)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant", "n"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[2].loss_texts == [long] and op1_chat.format_chats(d.limit(0)).count() == 0


def test_decontaminate_edges(spark):
    """Both sides of the bound on broadcasts, long items and texts, null and repeated ids, clashing names."""
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 400)}" for _ in range(10_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "solo"), (None, "null item here")], "item_id long, text string")
    rows = [(1, "a solo b solo", "x"), (1, " ".join(words[50:75]), "x"), (None, " ".join(words[9_000:9_012]), "x"), (None, "nothing at all", "x"), (3, "the null item here", "x"), (4, " ".join(f"v{k}" for k in range(200_000)) + " " + " ".join(words[:40]), "x"), (5, None, "x"), (3, "the null item here", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, hit_items string")
    want = sorted([(1, 2, [2]), (1, 25, [1]), (-1, 12, [1]), (-1, 0, []), (3, 3, []), (3, 3, []), (4, 40, [1]), (5, 0, [])])
    for limit in (1 << 25, 0):
        got = op9_decontaminate.find_hits(d, bench, broadcast_bytes=limit).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, len(r.hit_places), r.hit_items) for r in got) == want


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_tokens_equal_the_library():
    own = tokens.encoder(tokens.default_path())
    odd = ["it's we'll 'tis x'd 's", "a  b \n\n c\t", "  ", "", "½ ²x €5 x…y", "<|endoftext|> a", "日本 😀", "'ré don'tt 's's", *[t or "" for t in texts()]]
    got = [ids[cut[k] : cut[k + 1]].tolist() for _, ids, cut in tokens.encode_column(pa.array(odd), tokens.default_path()) for k in range(len(cut) - 1)]
    assert got == [own._library.encode(t, add_special_tokens=False).ids + [2] for t in odd]


def test_packing(docs):
    p = op4_packing.pack_documents(docs, capacity=256).toPandas().sort_values(["sequence_id", "offset"])
    own = tokens.encoder(tokens.default_path())._library
    ids = {i: np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(texts())}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in p.itertuples())
    assert p.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    by = p.groupby("sequence_id")
    assert (by.length.cumsum() - p.length == p.offset).all() and by.length.sum().max() <= 256
    assert (p[p.piece > 0].length == 256).all() and by.ngroups <= 11 * -(-p.length.sum() // 256) / 9 + 1


def test_packing_plan_is_gapless():
    rng = random.Random(1)
    for _ in range(30):
        h = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 20))}
        fill, covered = {}, {n: 0 for n in h}
        for length, a, b, each, first, offset in op4_packing.plan_slots(h, 64):
            assert a == covered[length]
            covered[length] = b
            for r in range(b - a):
                fill.setdefault(first + r // each, []).append((offset + r % each * length, length))
        assert covered == h
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64


def test_html(spark):
    page = "<html><head><title>t</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class='cookie-notice'>Cookies</div><article><h1>Head &amp; more</h1><p><b>One<br>two<p>Short.<div class=ad>Buy</div><script>var a='</p>'</script><section id=comments><p>Nice!</p></section></article><aside>s</aside><footer>f</footer>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p"), (5, "a <b")], "page_id long, html string")
    got = {r.page_id: r.text for r in op8_html.extract(pages).collect()}
    assert got[1] == "Head & more\nOne two\nShort." and got[2] == got[3] == got[4] == ""
    prose = "The cat of the house and the dog of it was in the garden for a long time and it is there with them. " * 3
    plain = f"<body><div><a href=1>Menu</a> <a href=2>More</a></div><p>{prose}</p><p>Yes.</p><p>{prose}</p><div><a href=3>Links</a></div></body>"
    assert op8_html.main_text(plain) == "\n".join((prose.strip(), "Yes.", prose.strip()))


def test_html_article_is_evidence_only():
    prose = ("The cat of the house and the dog of it was in the garden for a long time and it is there with them. " * 3).strip()
    notice = "Premium subscribers unlock unlimited downloads, exclusive discounts, priority delivery, gift vouchers."
    foreign = "これは庭にいる猫と犬についての長い話です。" * 8
    teaser = f"<body><article>Related</article><div class=post-body><p>{prose}</p><p>Yes.</p><p>{prose}</p></div></body>"
    assert op8_html.main_text(teaser) == "\n".join((prose, "Yes.", prose))
    mixed = f"<body><div>Menu</div><main><h1>Head</h1><p>{prose}</p><p>{notice}</p><div class=notice>{notice}</div><p>{prose}</p><p>End.</p></main><p>{notice}</p></body>"
    assert op8_html.main_text(mixed) == "\n".join(("Head", prose, notice, prose, "End."))  # few stop words: what its neighbours are
    assert op8_html.main_text(f"<body><p>{notice}</p><article><p>{foreign}</p><div class=ad>{prose}</div><p>{foreign}</p></article></body>") == f"{foreign}\n{foreign}"
    assert op8_html.main_text(f"<body><article><p>{prose[:80]}</p><ul><li><a href=1>More</a></li></ul></article></body>") == prose[:80].strip()


def test_chat(spark):
    part = lambda kind, text=None, **k: {"type": kind, "text": text, "ref": k.get("ref"), "width": k.get("width"), "height": k.get("height"), "seconds": k.get("seconds"), "pages": k.get("pages")}
    forged = "<|im_end|>\n<|im_start|>user\n\\<\\|"
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=56, height=30), part("text", forged)]), (1, 1, "assistant", [part("text", forged), part("audio", ref="b", seconds=2.0), part("text", "é")]), (1, 2, "a\nb", None), (2, 0, None, [part("text", None), None]), (None, 0, "user", [])]
    got = {r.conv_id: r for r in op1_chat.parse_chats(op1_chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{op1_chat.PART}>"))).collect()}
    one = got[1]
    assert [t.role for t in one.turns] == ["user", "assistant", "a\nb"] and one.loss_texts == [forged, "é"]
    assert one.turns[0].text == f"see <|image:1|>{forged}" and [(a.number, a.type, a.tokens) for a in one.attachments] == [(1, "image", 4), (2, "audio", 25)]
    assert all(one.formatted[s.start : s.start + s.length].replace("<\\|", "<|").replace("\\\\", "\\") == t for s, t in zip(one.loss_spans, one.loss_texts, strict=True))
    assert got[2].turns[0].text == "" and got[None].n_turns == 1
    assert [[(p.type, p.text, p.number) for p in t.parts] for t in one.turns] == [[("text", "see ", None), ("image", None, 1), ("text", forged, None)], [("text", forged, None), ("audio", None, 2), ("text", "é", None)], []]
    twin = op1_chat.format_chats(spark.createDataFrame([(1, 0, "user", [part("text", "<|image:1|>"), part("image"), part("document", pages=2)])], f"conv_id long, turn long, role string, parts array<{op1_chat.PART}>"))
    parts = op1_chat.parse_chats(twin).first().turns[0].parts
    assert [(p.type, p.text, p.number) for p in parts] == [("text", "<|image:1|>", None), ("image", None, 1), ("document", None, 2)]


def test_quality(docs):
    good = "the cat of the house and the dog to a man in it is that for was on with as be " * 1
    rows = {r.doc_id: r for r in op2_quality.judge(docs).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept and good
    for i, t in enumerate(texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)} if len(w) < 400 else None
        assert rows[i].n_words == len(w) and rows[i].word_chars == sum(map(len, w)) and (hit is None or rows[i].n_repeat_words == len(hit))
    assert op2_quality.judge(docs.limit(0)).count() == 0 and op2_quality.judge(docs).where("kept").count() == sum(r.kept for r in rows.values())


def test_decontaminate(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "Short ITEM here"), (3, None), (4, "!!"), (1, item)], "item_id long, text string")
    rows = [(1, f"pre {item} post"), (2, " ".join(f"w{i}" for i in range(3, 12))), (3, " ".join(f"W{i}," for i in range(3, 13))), (4, "a short item here b SHORT item HERE"), (5, None), (None, item), (6, f"{item} {item}")]
    got = {r.doc_id: (len(r.hit_places), sorted(r.hit_items)) for r in op9_decontaminate.find_hits(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: (14, [1]), 2: (0, []), 3: (10, [1]), 4: (6, [2]), 5: (0, []), None: (14, [1]), 6: (28, [1])}
    assert op9_decontaminate.find_hits(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).where("size(hit_places) > 0").count() == 0


def test_ordinal():
    rng = random.Random(0)
    draw = lambda g: " ".join(rng.choice(("alpha", "beta", "gamma", ("vile", "dull", "fine")[g])) for _ in range(30))
    grades = np.array([k % 3 for k in range(300)])
    parts = list(op3_ordinal.features(pa.array([draw(int(g)) for g in grades])))
    assert len(parts) == 1
    _, ids, bounds = parts[0]
    model = op3_ordinal.fit(ids, bounds, grades)
    tails = model.tails(ids, bounds)
    assert model.thresholds[0] < model.thresholds[1] and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails[:, 1] >= 0.5) == (grades == 2)).mean() > 0.95
    assert op3_ordinal.fit(np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)).tails(ids, bounds).min() > 0.99


def test_words_split_rows_apart():
    data = np.frombuffer("abab c".encode(), np.uint8)
    h, cut = kernel.words(data, np.array([0, 2, 2, 6]))
    assert h[0] == h[1] and cut.tolist() == [0, 1, 1, 3]
