"""Suffix-array dedup: longest-previous-factor arrays remove later copies of long byte strings.

A byte goes if some string of ``length`` bytes that covers it also starts in a row with a smaller
id; the first copy stays. That is LPF >= length, where LPF, the longest previous factor, is read off
the suffix array: of all earlier suffixes the previous and the next smaller position in suffix order
share the longest prefix with a suffix.

A suffix array over the whole corpus doesn't fit into a cluster's disks, so it is built in blocks that
hold all suffixes which could match each other for ``length`` bytes:

1. Every string of ``length`` bytes has an *anchor*, the k-gram in it with the least hash. Equal
   strings have equal anchors at equal places, so only anchors found in two rows matter. Rows are
   dealt into chunks; each chunk sends its distinct anchors once (a third of all rows being one
   group of copies still sends each anchor once for each chunk).
2. The strings that share an anchor are a *span*: the beginnings of neighbouring suffixes. Chunks send
   the spans of shared anchors, equal spans once with their least id, to the block of that anchor.
3. A block sorts the suffixes of its spans and computes their LPF array. A span with several ids stands
   there twice, at its least id and at a later one. Chunks get back, for each of their spans, which
   suffixes have LPF >= length at the least id, and which at a later one.
4. Chunks mark the bytes that these cover.

The edges of a passage that a third of all rows share have anchors with as many different spans as
rows. Anchors found in many chunks are therefore *hot*: each string of their spans is sent for itself,
to a block that its own hash names too, so that no block holds a hot anchor's spans.

Traffic is some 0.4 bytes for each byte of text for 1, and about 6 bytes for each repeated byte for 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import kernel as K
from quillon.llm.shared import text_bytes

LENGTH = 50
CHUNK_BYTES = 4 << 20
#: An anchor found in so many chunks is hot. Below, its block gets spans from fewer chunks than this.
HOT_CHUNKS = 256
#: Unpacked bytes of a block that are matched at once, about; a block with more is matched in turns of anchors.
PASS_BYTES = 16 << 20
_LAST = np.iinfo(np.int64).max
#: Anchors travel as their upper 47 bits and a flag; a chance match only costs a look at its spans.
_CUT = ~np.uint64(0x1FFFF)


def anchor_width(length: int) -> int:
    """k of the anchors: about half of the matched length keeps chance hits and traffic low."""
    return max(1, min(length, (length + 1) // 2 - 1))


# --- suffix order -----------------------------------------------------------------------------------


def suffix_order(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of suffixes, each a row of a matrix whose first ``size`` bytes count (zeros follow), within their groups."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return np.lexsort((size, *padded.view(">u8").astype(np.uint64).T[::-1], group))


def common_prefix(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """In suffix order: LCP of each suffix with the one before it, 0 for the first of a group."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        own = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        out[1:] = np.where(group[1:] == group[:-1], np.minimum(own, np.minimum(size[1:], size[:-1])), 0)
    return out


def _to_smaller(lcp: np.ndarray, position: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the previous smaller position before it in suffix order; 0 without one.

    All suffixes look at once: what one has jumped over is not smaller than what it stands at, so
    whoever is not smaller either jumps over as much, and the distances double.
    """
    at, shared = np.arange(len(lcp)) - 1, lcp.copy()
    look = np.flatnonzero(shared > 0)
    while len(look):
        look = look[position[at[look]] >= position[look]]
        low = np.minimum(shared[look], shared[at[look]])
        at[look], shared[look] = at[at[look]], low
        look = look[low > 0]
    return shared


def longest_previous_factor(lcp: np.ndarray, position: np.ndarray) -> np.ndarray:
    """LPF of each suffix, in suffix order: the longest prefix that it shares with one at a smaller position.

    lcp: with the suffix before, 0 at the first one and between groups. The larger of what it shares
    with the previous and with the next smaller position; equal positions are not smaller.
    """
    before = _to_smaller(lcp, position)
    after = _to_smaller(np.concatenate((lcp[1:], [0]))[::-1] if len(lcp) else lcp, position[::-1])[::-1]
    return np.maximum(before, after)


# --- anchors and spans ------------------------------------------------------------------------------


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[K.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a buffer's rows: hash, and first and last start of the strings that have it."""
    spans = K.Spans(data)
    n = len(data) - length + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return spans, np.empty(0, K.U64), none, none
    gram = spans.windows(k)
    low = K.U64(2 * K.BLOCK_BYTES - 1)  # no buffer is longer; the same for all, so that ties fall alike
    least = (gram & ~low) | np.arange(len(gram), dtype=K.U64)
    width, have = length - k + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: n], least[width - have : width - have + n])
    valid = np.ones(n, bool)
    for e in bounds[1:-1].tolist():
        valid[max(0, e - length + 1) : e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return spans, np.empty(0, K.U64), none, none
    place = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return spans, gram[place[first]], at[first], at[last]


def _walk(table: pa.Table, text: str, key: str, length: int, k: int):
    """For the blocks of a chunk: bytes, where the block lies in the chunk, anchors, their rows' ids."""
    data, start, end = K.utf8(table[text])
    ids = np.asarray(table[key].cast(pa.int64()).fill_null(_LAST)) if len(table) else np.empty(0, np.int64)
    # a row longer than a block is cut into overlapping pieces that hold every string once
    row = np.arange(len(start))
    size = end - start
    if len(size) and size.max() > 2 * K.BLOCK_BYTES:
        parts = np.maximum(1, -(-size // K.BLOCK_BYTES))
        row = np.repeat(row, parts)
        s = start[row] + K.ragged(np.zeros(len(parts), np.int64), parts) * K.BLOCK_BYTES
        start, end = s, np.minimum(s + K.BLOCK_BYTES + length - 1, end[row])
        end = np.maximum(start, end)
    for i, j in K.blocks(start, end):
        buffer, bounds = K.gather(data, start[i:j], end[i:j])
        spans, h, lo, hi = _anchors(buffer, bounds, length, k)
        piece = np.searchsorted(bounds, lo, side="right") - 1
        yield buffer, spans, h, lo, hi, row[i:j][piece], start[i:j][piece] - bounds[piece], ids


def _key(h: np.ndarray, spans: K.Spans, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """128 bits go in: the anchor's hash and the span's."""
    return K.mix64(h * K.U64(0xD6E8FEB86659FD93) + spans.hash(lo, hi + length))


def _apart(hot: np.ndarray, spans: K.Spans, length: int, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Hot spans as their single strings, each under a hash of its own; other spans as they are."""
    if not hot.any():
        return [h, lo, hi, *others]
    n = np.where(hot, hi - lo + 1, 1)
    of = np.repeat(np.arange(len(h)), n)
    hot, at = hot[of], K.ragged(lo, n)
    single = K.mix64(h[of] ^ spans.hash(at, at + length))
    return [np.where(hot, single, h[of]), at, np.where(hot, at, hi[of]), *(x[of] for x in others)]


def _among(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in an ascending array, and where."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def _least(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each distinct key with its least id; whether it has several ids."""
    order = np.lexsort((ids, key))
    k, d = key[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    last = np.concatenate((first[1:], [len(k)]))[: len(first)] - 1
    return order[first], d[first] != d[last], d[first]


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> K.U64(32)) * K.U64(n)) >> K.U64(32)).astype(np.int64)


def _rows(bucket_of: np.ndarray, chunk: int, make) -> Iterator[tuple[int, int, bytes]]:
    """bucket_of ascending: one row for each bucket that has entries."""
    cut = np.flatnonzero(np.concatenate(([True], bucket_of[1:] != bucket_of[:-1]))) if len(bucket_of) else []
    for i, a in enumerate(cut):
        b = cut[i + 1] if i + 1 < len(cut) else len(bucket_of)
        yield int(bucket_of[a]), chunk, make(int(a), int(b))


def _table(rows: list[tuple[int, int, bytes]], names: tuple[str, str, str]) -> pa.Table:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({names[0]: pa.array(a, pa.int64()), names[1]: pa.array(b, pa.int64()), names[2]: pa.array(c, pa.binary())})


_SENT = "__bucket long, __from long, __load binary"
_BACK = "__to long, __bucket long, __load binary"
#: In place of a bucket: the load is a chunk's hot anchors.
_HOT = -1


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """The rows with ``removed_spans`` (maximal removed byte ranges), ``kept_bytes`` and ``kept_text``.

    ``kept_bytes`` drops exactly the removed bytes; ``kept_text`` keeps characters that are only
    removed in part, so it is always valid. Null text counts as empty (``kept_text`` stays null). A
    null id counts as the largest: such rows lose what any other row has and take nothing. Rows with
    equal ids don't take from each other. Other columns pass through, those of the new names are
    replaced; names that begin with ``__`` are reserved. An empty table gives an empty table. Rows are
    dealt by all their columns; a row longer than a block of bytes is walked in overlapping pieces.
    """
    k = anchor_width(length)
    chunks = max(1, -(-text_bytes(docs, text) // chunk_bytes))
    out_fields = [f for f in docs.schema.fields if f.name not in ("removed_spans", "kept_bytes", "kept_text")]
    names = [f.name for f in out_fields]
    # by all columns, so that neither a null id nor one that many rows have is one chunk
    left = docs.select(*names, F.pmod(F.xxhash64(*(f.name for f in out_fields if not isinstance(f.dataType, T.MapType | T.VariantType))), F.lit(chunks)).alias("__chunk"))

    def send_anchors(table: pa.Table) -> pa.Table:
        hashes, ids = [np.empty(0, K.U64)], [np.empty(0, np.int64)]
        for _, _, h, _, _, row, _, all_ids in _walk(table, text, key, length, k):
            hashes.append(h & _CUT)
            ids.append(all_ids[row])
        h, d = np.concatenate(hashes), np.concatenate(ids)
        at, several, _ = _least(h, d)
        h = h[at]
        load = (h | (several.astype(K.U64) << K.U64(16))).view(np.uint8).reshape(-1, 8)[:, 2:]
        chunk = table["__chunk"][0].as_py()
        return _table(list(_rows(_buckets(h, chunks), chunk, lambda a, b: load[a:b].tobytes())), ("__bucket", "__from", "__load"))

    def shared_anchors(table: pa.Table) -> pa.Table:
        loads, origins = table["__load"].to_pylist(), np.asarray(table["__from"])
        sizes = np.array([len(x) // 6 for x in loads])
        full = np.zeros((int(sizes.sum()), 8), np.uint8)
        full[:, 2:] = np.frombuffer(b"".join(loads), np.uint8).reshape(-1, 6)
        h = full.view(K.U64).reshape(-1)
        several, h = (h >> K.U64(16)) & K.U64(1), h & ~K.U64(1 << 16)
        origin = np.repeat(np.arange(len(loads)), sizes)
        order = np.argsort(h, kind="stable")
        hs, flag = h[order], several[order].astype(bool)
        same = hs[1:] == hs[:-1]
        keep = flag.copy()
        keep[1:] |= same
        keep[:-1] |= same
        # a chunk sends an anchor once: as many equal ones as chunks
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        size = np.diff(np.concatenate((first, [len(hs)])))
        h[order] |= np.repeat(size >= hot_chunks, size).astype(K.U64)
        order = np.sort(order[keep])
        bucket = table["__bucket"][0].as_py()
        return _table([(int(origins[o]), b, load) for o, b, load in _rows(origin[order], bucket, lambda a, b: h[order[a:b]].tobytes())], ("__to", "__bucket", "__load"))

    def send_spans(table: pa.Table, back: pa.Table) -> pa.Table:
        if not len(back) or not len(table):
            return _table([], ("__bucket", "__from", "__load"))
        wanted = np.sort(np.frombuffer(b"".join(back["__load"].to_pylist()), K.U64))
        hot, wanted = (wanted & K.U64(1)).astype(bool), wanted & ~K.U64(1)
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        for data, spans, h, lo, hi, row, _, ids in _walk(table, text, key, length, k):
            use, at = _among(h & _CUT, wanted)
            h, lo, hi, row = _apart(hot[at[use]], spans, length, h[use], lo[use], hi[use], row[use])
            keys = _key(h, spans, lo, hi, length)
            first, several, least = _least(keys, ids[row])  # equal spans of a block once
            body, _ = K.gather(data, lo[first], hi[first] + length)
            for out, x in zip(found, (h[first], keys[first], least, ((hi - lo)[first] << 1) | several, body), strict=True):
                out.append(x)
        h, keys, ids, sizes, body = (np.concatenate(x) if x else np.empty(0) for x in found)
        if not len(h):
            return _table([], ("__bucket", "__from", "__load"))
        at, several, least = _least(keys, ids)
        several |= _any(keys, sizes & 1)
        n = (sizes >> 1) + length
        starts = np.cumsum(n) - n
        order = np.argsort(h[at], kind="stable")
        at, several, least = at[order], several[order], least[order]

        def make(a: int, b: int) -> bytes:
            i = at[a:b]
            head = K.pack(h[i], keys[i], least[a:b], ((sizes[i] >> 1) << 1 | several[a:b]).astype(np.int64))
            return len(head).to_bytes(8, "little") + head + K.pack(body[K.ragged(starts[i], n[i])])

        chunk = table["__chunk"][0].as_py()
        rows = list(_rows(_buckets(h[at], chunks), chunk, make))
        K.trim()
        if hot.any():  # comes back as it is, for the last step
            rows.append((chunk, chunk, bytes(8) + K.pack(wanted[hot])))
        return _table(rows, ("__bucket", "__from", "__load"))

    def match_spans(table: pa.Table) -> pa.Table:
        loads, origins = table["__load"], np.asarray(table["__from"])
        bucket, out = table["__bucket"][0].as_py(), []
        cuts = [int.from_bytes(x.as_py()[:8], "little") for x in loads]
        raw = sum(K.raw_size(x.as_py()[8:16]) + K.raw_size(x.as_py()[8 + m : 16 + m]) for x, m in zip(loads, cuts, strict=True) if m)
        passes = max(1, -(-raw // PASS_BYTES))  # anchors have nothing to do with each other
        for turn in range(passes):
            heads, bodies, sender = [], [], []
            for i, m in enumerate(cuts):
                x = loads[i].as_py()
                if not m:
                    if not turn:
                        out.append((int(origins[i]), _HOT, x[8:]))
                    continue
                head, body = K.unpack(x[8 : 8 + m], "u8", "u8", "i8", "i8"), K.unpack(x[8 + m :], "u1")[0]
                if passes > 1:
                    use = np.flatnonzero((head[0] >> K.U64(20)) % K.U64(passes) == K.U64(turn))
                    size = (head[3] >> 1) + length
                    ends = np.cumsum(size)
                    body = K.gather(body, (ends - size)[use], ends[use])[0].copy()
                    head = [h[use] for h in head]
                heads.append(head)
                bodies.append(body)
                sender.append(int(origins[i]))
            if not heads:
                continue
            count = [len(x[0]) for x in heads]
            h, keys, ids, sizes = (np.concatenate(x) for x in zip(*heads, strict=True))
            body = np.concatenate(bodies)
            del heads, bodies
            n = (sizes >> 1) + length
            starts = np.cumsum(n) - n
            at, across, least = _least(keys, ids)
            later = across | _any(keys, sizes & 1)
            masks = _removable(h[at], least, later, body, starts[at], n[at], length)
            del body, starts, n, h, ids, sizes
            place = np.searchsorted(keys[at], keys)
            useful = (masks != 0).any(axis=1)[place]
            origin = np.repeat(np.arange(len(count)), count)[useful]
            keys, place = keys[useful], place[useful]
            load = lambda a, b: K.pack(keys[a:b], least[place[a:b]], *masks[place[a:b]].T)  # noqa: B023, E731
            out += [(sender[o], b, x) for o, b, x in _rows(origin, bucket, load)]
            del masks, keys, place, origin, useful, at, across, least, later
            K.trim()
        return _table(out, ("__to", "__bucket", "__load"))

    word_count = _mask_words(length)
    out_schema = T.StructType([*out_fields, *T._parse_datatype_string("removed_spans array<struct<start: long, end: long>>, kept_bytes binary, kept_text string").fields])

    def cut_out(table: pa.Table, back: pa.Table) -> pa.Table:
        loads = list(zip(back["__bucket"].to_pylist(), back["__load"].to_pylist(), strict=True))
        parts = [K.unpack(x, "u8", "i8", *["u8"] * (2 * word_count)) for b, x in loads if b != _HOT]
        hot = np.sort(np.concatenate([np.empty(0, K.U64), *(K.unpack(x, "u8")[0] for b, x in loads if b == _HOT)]))
        data, start, end = K.utf8(table[text])
        place = np.cumsum(end - start) - (end - start)  # of each row in the chunk's own line of bytes
        delta = np.zeros(int((end - start).sum()) + 1, np.int32)
        if parts and len(table):
            keys, least, *mask = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys)
            keys, least, mask = keys[order], least[order], [m[order] for m in mask]
            for _, spans, h, lo, hi, row, shift, ids in _walk(table, text, key, length, k):
                h, lo, hi, row, shift = _apart(_among(h & _CUT, hot)[0], spans, length, h, lo, hi, row, shift)
                use, at = _among(_key(h, spans, lo, hi, length), keys)
                at, lo, hi, row, shift = at[use], lo[use], hi[use], row[use], shift[use]
                base, size = lo + shift - start[row] + place[row], hi - lo + 1
                copy = ids[row] > least[at]
                own = [np.where(copy, mask[word_count + w][at], mask[w][at]) for w in range(word_count)]
                every = np.ones(len(at), bool)  # all its suffixes: one range of bytes
                for w in range(word_count):
                    every &= own[w] == _low_bits(np.clip(size - 64 * w, 0, 64))
                np.add.at(delta, base[every], 1)
                np.add.at(delta, (base + size - 1 + length)[every], -1)
                some = np.flatnonzero(~every & np.logical_or.reduce([m != 0 for m in own]))
                for bit in range(int(size[some].max()) if len(some) else 0):
                    on = some[((own[bit // 64][some] >> K.U64(bit % 64)) & K.U64(1)).astype(bool)]
                    np.add.at(delta, base[on] + bit, 1)
                    np.add.at(delta, base[on] + bit + length, -1)
        gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
        lists, kept, texts = [], [], []
        valid = table[text].is_valid().to_pylist()
        touched = np.add.reduceat(np.concatenate((gone, [False])).astype(np.int64), place) if len(place) else []
        for i in range(len(table)):
            raw = data[start[i] : end[i]]
            if start[i] == end[i] or not touched[i]:
                whole = raw.tobytes()
                lists.append([])
                kept.append(whole)
                texts.append(whole.decode() if valid[i] else None)
                continue
            g = gone[place[i] : place[i] + len(raw)]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
            lists.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kept.append(raw[~g].tobytes())
            char = np.cumsum((raw & 0xC0) != 0x80) - 1
            stays = np.zeros(int(char[-1]) + 1, bool)
            stays[char[~g]] = True
            texts.append(raw[stays[char]].tobytes().decode())
        columns = {f.name: table[f.name] for f in out_fields}
        columns |= {"removed_spans": pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_bytes": pa.array(kept, pa.binary()), "kept_text": pa.array(texts, pa.string())}
        K.trim()
        return pa.table(columns)

    sent = left.groupBy("__chunk").applyInArrow(send_anchors, _SENT)
    shared = sent.groupBy("__bucket").applyInArrow(shared_anchors, _BACK)
    spans = left.groupBy("__chunk").cogroup(shared.groupBy("__to")).applyInArrow(send_spans, _SENT)
    matched = spans.groupBy("__bucket").applyInArrow(match_spans, _BACK)
    return left.groupBy("__chunk").cogroup(matched.groupBy("__to")).applyInArrow(cut_out, out_schema)


def _any(keys: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """For each distinct key, ascending: does any of its entries have the flag?"""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return np.bitwise_or.reduceat(flag[order], first).astype(bool)


def _mask_words(length: int) -> int:
    return -(-(length - anchor_width(length) + 1) // 64)


def _low_bits(n: np.ndarray) -> np.ndarray:
    """Words with the low n bits set, n from 0 to 64."""
    n = n.astype(K.U64)
    return np.where(n >= K.U64(64), K.U64(0xFFFFFFFFFFFFFFFF), (K.U64(1) << (n & K.U64(63))) - K.U64(1))


def _removable(h: np.ndarray, least: np.ndarray, later: np.ndarray, body: np.ndarray, starts: np.ndarray, n: np.ndarray, length: int, most: int = 1 << 15) -> np.ndarray:
    """For each distinct span the bits of its suffixes with LPF >= length: at its least id, then at a later id (none if it has no other).

    All spans that could match are sorted: those that share their anchor with others, and those that a
    later id has too. A span that is neither has no earlier or later copy.
    """
    words = _mask_words(length)
    masks = np.zeros((len(h), 2 * words), K.U64)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    group = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1]))) if len(hs) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((group, [len(hs)])))
    order = order[np.repeat(size > 1, size) | later[order]]
    hs = h[order]
    count = n[order] - length + 1
    total = np.cumsum(count)
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        while b < len(order) and hs[b] == hs[b - 1]:  # an anchor's spans stay together
            b += 1
        part, c = order[a:b], count[a:b]
        owner, bit = np.repeat(np.arange(len(part)), c), K.ragged(np.zeros(len(part), np.int64), c)
        own, at = K.gather(body, starts[part], starts[part] + n[part])
        left = n[part][owner] - bit  # of the span, from where the suffix starts
        width = int(left.max())
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((own, np.zeros(width, np.uint8))), width)[at[:-1][owner] + bit]
        rows[np.arange(width, dtype=np.int32)[None, :] >= left.astype(np.int32)[:, None]] = 0
        anchor = np.repeat(np.cumsum(np.concatenate(([0], hs[a + 1 : b] != hs[a : b - 1]))), c)
        o = suffix_order(anchor, rows, left)
        lcp = common_prefix(anchor[o], rows[o], left[o])
        # a span with several ids stands in the order twice, next to itself
        times = 1 + later[part][owner[o]].astype(np.int64)
        first = np.cumsum(times) - times
        of = np.repeat(np.arange(len(o)), times)
        copy = np.ones(len(of), bool)
        copy[first] = False
        found = longest_previous_factor(np.where(copy, left[o][of], lcp[of]), np.where(copy, _LAST, least[part][owner[o]][of])) >= length
        hit = np.flatnonzero(found)
        whose, which = owner[o][of[hit]], bit[o][of[hit]]
        np.bitwise_or.at(masks, (part[whose], which // 64 + words * copy[hit]), K.U64(1) << (which % 64).astype(K.U64))
        a = b
    return masks


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of the operator's result over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
