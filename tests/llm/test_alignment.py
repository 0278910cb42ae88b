"""Alignment: encoders against their libraries, the query against a plain second implementation, long documents in parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import kernel as K
from quillon.llm import op13_alignment as X
from quillon.llm import tokens
from tests.llm.texts import texts

A_PATH, B_PATH = tokens.default_path(), X.piece_path()
AWKWARD = ["a", " ", "  ", "a ", "a  b   c", " lead", "tab\tline\nend\n", "▁", "a▁b", "\x00nul", "<s> </s> <unk> <0x41> <|endoftext|>", "naïve café 中文 🎉👩‍👩‍👧", "x" * 3000, "can't we'll 12345", "  wide　", "<|endoftext|><|endoftext|>"]


def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def ids_of(a, b, text):
    """Ids of both sides by the libraries, none where the bytes differ."""
    if not text:
        return [], []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    want = (" " + text).encode()
    ta, tb = X.byte_table(A_PATH), X.piece_table(B_PATH)
    ok = ta.joined(np.array(ia)).tobytes() == want and tb.joined(np.array(ib)).tobytes() == want
    return (ia, ib) if ok else ([], [])


def plain(given):
    a, b = libraries()
    ta, tb = X.byte_table(A_PATH).size, X.piece_table(B_PATH).size
    rows, held = [], Counter()
    for key, text in given:
        ia, ib = ids_of(a, b, text)
        spans, sides = [], []
        for ids, size in ((ia, ta), (ib, tb)):
            ends = np.cumsum(size[ids]).tolist() if ids else []
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=False)))
            sides.append(ends)
        links, j = Counter(), 0
        for s, e, i in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links[i, spans[1][j][2]] += 1
                j += 1
        groups, ia_at, ib_at = [], 0, 0
        for end in sorted(set(sides[0]) & set(sides[1])):
            ja, jb = sides[0].index(end) + 1, sides[1].index(end) + 1
            groups.append(",".join(map(str, ia[ia_at:ja])) + "|" + ",".join(map(str, ib[ib_at:jb])))
            ia_at, ib_at = ja, jb
        held.update(links.keys())
        rows.append((key, len(ia), len(ib), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    highest = Counter()
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    return Counter((key, na, nb, g, sum(x.values()), sum(m for p, m in x.items() if held[p] == highest[p[0]]), sum(m * held[p] for p, m in x.items()), sha) for key, na, nb, g, x, sha in rows)


def given_rows():
    rng = random.Random(5)
    words = ["the", "of", "Über", "straße", "naïve", "12", "x1", "don't", ",", "…", "日本", "\n", "  "]
    made = ["".join(rng.choice(words) + rng.choice((" ", "", " ")) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return [(i if i % 9 else None, t) for i, t in enumerate([*texts(), *AWKWARD, *made, *made[:5], None, ""])]


def table(spark, rows, path):
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_token_bytes():
    a, b = X.byte_table(A_PATH), X.piece_table(B_PATH)
    assert len(a.size) == 50256 and len(b.size) == 32000  # without the special token
    assert b.joined(np.array([3 + 65])).tobytes() == b"A"  # <0x41>


def test_encoder_against_library():
    _, b = libraries()
    own = X.PieceEncoder(B_PATH)
    rows = [t for t in [*AWKWARD, *(t for t in texts() if t)]]
    data = [(" " + t).encode() for t in rows]
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    for _ in range(2):  # the second time from memory
        ids, cut = own.encode(np.frombuffer(b"".join(data), np.uint8), bounds)
        assert [ids[cut[i] : cut[i + 1]].tolist() for i in range(len(rows))] == [b.encode(t) for t in rows]


def test_plain_special_tokens():
    a, _ = libraries()
    own = tokens.Encoder(A_PATH, plain=True)
    for t in AWKWARD:
        raw = (" " + t).encode()
        ids, _ = own.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == a.encode(" " + t, add_special_tokens=False).ids


@pytest.mark.parametrize("swept", [64, 1 << 17])
def test_query_against_plain(spark, tmp_path, monkeypatch, swept):
    monkeypatch.setattr(X, "SWEPT", swept)
    given = given_rows()
    closure = X._swept

    def small(key, a_path, b_path):
        inner = closure(key, a_path, b_path)

        def sweep(batches):
            X.SWEPT, X.RUN = swept, 16
            return inner(batches)

        return sweep

    monkeypatch.setattr(X, "_swept", small)
    out = X.op13_alignment(spark, table(spark, given, tmp_path)).collect()
    assert Counter(map(tuple, out)) == plain(given)


def test_rare_pairs_are_joined_too(spark, tmp_path):
    aligned = X.align(spark.read.parquet(table(spark, given_rows(), tmp_path) + "/documents.parquet"))
    counts = X.pair_counts(aligned)
    want = sorted(map(tuple, X.scored(aligned, counts).collect()))
    assert want == sorted(map(tuple, X.scored(aligned, counts, frequent=20).collect())) == sorted(map(tuple, X.scored(aligned, counts, frequent=0).collect()))


def test_long_text_in_pieces(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    long = " ".join(rng.choice(("wörd", "token", "alignment", "x", "1234", "und")) for _ in range(700_000))
    assert len(long) > 2 * K.BLOCK_BYTES
    given = [(1, long), (2, "short one"), (3, long + "▁"), (4, "")]
    out = {r[0]: tuple(r) for r in X.op13_alignment(spark, table(spark, given, tmp_path)).collect()}
    a, b = libraries()
    ia, ib = ids_of(a, b, long)
    ends = [np.cumsum(t.size[i]) for i, t in ((ia, X.byte_table(A_PATH)), (ib, X.piece_table(B_PATH)))]
    groups = np.intersect1d(*ends)
    assert out[1][1:5] == (len(ia), len(ib), len(groups), len(ia) + len(ib) - len(groups))
    cuts = [[0, *(np.searchsorted(e, groups) + 1).tolist()] for e in ends]
    text = ";".join(",".join(map(str, ia[p:q])) + "|" + ",".join(map(str, ib[r:s])) for p, q, r, s in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False))
    assert out[1][7] == hashlib.sha256(text.encode()).hexdigest()
    assert out[3][1:] == (0, 0, 0, 0, 0, 0, "") == out[4][1:]


def test_empty_table(spark, tmp_path):
    assert X.op13_alignment(spark, table(spark, [], tmp_path)).collect() == []


def test_the_table(spark):
    sf = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, X.op13_alignment(spark, sf).collect())) == plain(given)
