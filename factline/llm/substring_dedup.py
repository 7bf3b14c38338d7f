"""Dedup of repeated byte strings over all documents, with suffix arrays of shards.

A string of ``WIDTH`` bytes starts a window; a window goes if the same bytes start earlier.  Each window has an anchor:
the place of its least-hashed ``GRAM`` bytes (the leftmost of equals), which depends on nothing but the window.  So equal
windows have equal anchors, and windows that follow each other mostly share one: a stretch.

1. Blocks of documents send the hashes of their anchors, each once, to hash partitions, which answer with those that
   occur again, and those that very many blocks hold.  Only stretches of such anchors can hold repeats.
2. For anchors in very many blocks, blocks ask once more, by window: where a common passage begins or ends, every
   document has surroundings of its own, which would meet in one shard.  Only windows that occur again stay in such a
   stretch, and what is left of it is the same in most documents.
3. Blocks send the bytes of those stretches to shards by anchor; a stretch that a block holds several times goes once.
4. A shard builds the suffix array of its distinct stretches by induced sorting; common prefixes with the neighbour in
   order tell the windows that are equal, the first in (document, place) stays, and the others go back to their blocks.
5. Blocks cut the bytes that windows cover.

Texts move once (the exchange by block is reused), and what a step returns is packed arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.packing import pack_hashes, unpack_hashes
from factline.llm.suffix_array import common_prefixes, equal_windows, suffix_array
from factline.llm.text import whole

GRAM = 32
#: Bytes of text in a block, text whose anchors a hash partition sees, text whose stretches a shard may get.
BLOCK, PART, SHARD = 10_000_000, 32_000_000, 8_000_000
#: Windows worked on at once in a block; bytes sorted at once in a shard.
STEP, SORTED = 1_000_000, 2_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: An anchor that more blocks hold is asked for by window.
HOT_BLOCKS = 32
ASKED = "part long, block long, anchors binary, again binary"
ANSWER = "block long, part long, again binary, hot binary"
STRETCHES = "shard long, block long, row binary, start binary, windows binary, anchors binary, bytes binary, gone binary"
GONE = "block long, row binary, first binary, last binary"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on, by doubling."""
    h, k, power = data.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    while k < GRAM:
        h = h[:-k] * np.uint64(power) + h[k:]
        power = power * power & MASK
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of ``span`` values from each place on, the leftmost of equals."""
    value, place = (h >> np.uint64(32)).astype(np.uint32), np.arange(len(h), dtype=np.int32)
    k = 1

    def step(by: int) -> None:
        nonlocal value, place
        later = value[by:] < value[:-by]
        value = np.where(later, value[by:], value[:-by])
        place = np.where(later, place[by:], place[:-by])

    while 2 * k <= span:
        step(k)
        k *= 2
    if k < span:
        step(span - k)
    return place


class Block:
    """The documents of a block in order of (id, text), one after another, and their stretches."""

    def __init__(self, table: pa.Table, width: int):
        ids, texts = table.column("_doc").to_pylist(), table.column("_text").combine_chunks()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        if len(set(ids)) < len(ids):
            order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i].as_py()))
        self.table = table.take(pa.array(order))
        self.width = width
        self.docs = np.array(ids, dtype=np.int64)[order]
        texts = self.table.column("_text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        self.size = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        raw = texts.cast(pa.binary())
        first = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset] if len(raw) else 0
        self.data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[first : first + int(self.size.sum())]

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and anchor hash of each stretch, in order."""
        out = []
        ends = self.begin + self.size - self.width  # the last window of each document
        for a in range(0, max(0, len(self.data) - self.width + 1), STEP):
            part = self.data[a : a + STEP + self.width - 1]
            h = _gram_hashes(part)
            anchor = _least(h, self.width - GRAM + 1)
            place = np.arange(a, a + len(anchor))
            inside = place <= ends[np.searchsorted(self.begin, place, side="right") - 1]
            edge = np.flatnonzero(np.diff(anchor) | np.diff(inside.view(np.int8))) + 1
            start = np.concatenate(([0], edge))
            count = np.diff(np.concatenate((start, [len(anchor)])))
            good = inside[start]
            out.append((start[good] + a, count[good], h[anchor[start[good]]]))
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        first, count, key = (np.concatenate(x) for x in zip(*out, strict=True))
        # where documents meet two stretches can touch in one anchor
        row = np.searchsorted(self.begin, first, side="right")
        assert (row == np.searchsorted(self.begin, first + count - 1, side="right")).all()
        return first, count, key


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors by partition, whether the block holds them again, and where each stretch's is."""
    found, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    part = found % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    bounds = np.searchsorted(part[order], np.arange(parts + 1).astype(np.uint64))
    return found[order], (count > 1)[order], place[inverse], bounds


def _ask(width: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        keys, again, _, bounds = _by_part(Block(table, width).stretches()[2], parts)
        rows = [(p, block, pack_hashes(keys[a:b]), np.packbits(again[a:b]).tobytes()) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return _table(rows, (("part", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary()), ("again", pa.binary())))

    return run


def _table(rows: list[tuple], fields: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(fields, columns, strict=True)})


def _answer(hot_blocks: int):
    def run(table: pa.Table) -> pa.Table:
        return _answered(table, hot_blocks)

    return run


def _answered(table: pa.Table, hot_blocks: int) -> pa.Table:
    sent = [unpack_hashes(x.as_py()) for x in table.column("anchors")]
    bits = [np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=len(k)) for x, k in zip(table.column("again"), sent, strict=True)]
    again = np.concatenate(bits).astype(bool)
    _, inverse, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(s) for s in sent])[:-1]
    flags = [again | (count > 1)[inverse], (count > hot_blocks)[inverse]]
    out = [pa.array([np.packbits(x).tobytes() for x in np.split(f, cuts)], pa.binary()) for f in flags]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "again": out[0], "hot": out[1]})


class Asked:
    """A block's keys with the answers: which of them occur again, which are in very many blocks."""

    def __init__(self, keys: np.ndarray, parts: int, answers: pa.Table):
        _, again, place, bounds = _by_part(keys, parts)
        hot = np.zeros(len(again), dtype=bool)
        for p, a, h in zip(answers.column("part").to_pylist(), answers.column("again"), answers.column("hot"), strict=True):
            b, e = bounds[p], bounds[p + 1]
            again[b:e] |= np.unpackbits(np.frombuffer(a.as_py(), dtype=np.uint8), count=e - b).astype(bool)
            hot[b:e] = np.unpackbits(np.frombuffer(h.as_py(), dtype=np.uint8), count=e - b).astype(bool)
        self.again, self.hot = again[place], hot[place]


def _windows(data: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches, one row a window: its stretch, its place, a hash of its bytes."""
    owner = np.repeat(np.arange(len(first)), count)
    place = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    powers = np.array([pow(MULTIPLIER, k, 1 << 64) for k in range(width)], dtype=np.uint64)
    key = np.empty(len(place), dtype=np.uint64)
    for k in range(0, len(place), 20_000):
        some = data[place[k : k + 20_000, None] + np.arange(width)].astype(np.uint64) + np.uint64(1)
        key[k : k + 20_000] = (some * powers).sum(axis=1, dtype=np.uint64)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return owner, place, key ^ (key >> np.uint64(29))


def _ask_hot(width: int, parts: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        fields = (("part", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary()), ("again", pa.binary()))
        if not table.num_rows:
            return _table([], fields)
        block, number = Block(table, width), table.column("_block")[0].as_py()
        first, count, key = block.stretches()
        hot = Asked(key, parts, answers).hot
        keys, again, _, bounds = _by_part(_windows(block.data, first[hot], count[hot], width)[2], parts)
        return _table([(p, number, pack_hashes(keys[a:b]), np.packbits(again[a:b]).tobytes()) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a], fields)

    return run


def _trimmed(block: Block, width: int, parts: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that can hold repeats; those of anchors in very many blocks cut down to windows that occur again."""
    first, count, key = block.stretches()
    rounds = np.array(answers.column("round").to_pylist(), dtype=np.int64)
    asked = Asked(key, parts, answers.filter(pa.array(rounds == 1)))
    plain = asked.again & ~asked.hot
    out = [(first[plain], count[plain], key[plain])]
    first, count, key = first[asked.hot], count[asked.hot], key[asked.hot]
    if len(first):
        owner, place, window = _windows(block.data, first, count, width)
        on = Asked(window, parts, answers.filter(pa.array(rounds == 2))).again
        owner, place = owner[on], place[on]
        if len(place):
            new = np.flatnonzero((np.diff(place) != 1) | (np.diff(owner) != 0)) + 1
            begin = np.concatenate(([0], new))
            out.append((place[begin], np.diff(np.concatenate((begin, [len(place)]))), key[owner[begin]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _squeezed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _send(width: int, parts: int, shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        fields = (("shard", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in ("row", "start", "windows", "anchors", "bytes", "gone")))
        if not table.num_rows:
            return _table([], fields)
        number = table.column("_block")[0].as_py()
        block = Block(table, width)
        first, count, key = _trimmed(block, width, parts, answers)
        row = np.searchsorted(block.begin, first, side="right") - 1
        start = first - block.begin[row]
        shard = ((key >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)
        raw = block.data.tobytes()
        rows = []
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        local: list[int] = []
        for s in range(shards):
            pick = order[edges[s] : edges[s + 1]]
            seen: set[bytes] = set()
            keep, text = [], []
            for i, f, c in zip(pick.tolist(), first[pick].tolist(), count[pick].tolist(), strict=True):
                piece = raw[f : f + c + width - 1]
                if piece in seen:
                    local.append(i)  # the block holds it earlier: every window goes
                else:
                    seen.add(piece)
                    keep.append(i)
                    text.append(piece)
            if keep:
                k = np.array(keep)
                ids = np.stack((block.docs[row[k]], row[k]), axis=1).astype("<i8")
                rows.append((s, number, ids.tobytes(), start[k].astype("<i8").tobytes(), count[k].astype("<i8").tobytes(), key[k].tobytes(), _squeezed(b"".join(text)), b""))
        if local:
            k = np.array(local)
            gone = np.stack((row[k], start[k], start[k] + count[k] - 1)).astype("<i8")
            rows.append((number % shards, number, b"", b"", b"", b"", b"", gone.tobytes()))
        return _table(rows, fields)

    return run


def _sort_group(texts: list[bytes], first: np.ndarray, width: int) -> list[np.ndarray]:
    """For each distinct stretch, whether each of its windows goes; ``first``: (document rank, start) of its earliest copy."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    symbol = joined.astype(np.int16) + 1
    symbol[begin + size] = 0
    order = suffix_array(symbol, 257, width)
    group = equal_windows(order, common_prefixes(joined, order, width), width)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    offset = np.arange(len(joined)) - begin[owner]
    window = np.flatnonzero(offset <= size[owner] - width)
    owner, offset, group = owner[window], offset[window], group[window]
    # groups are of equal bytes, with the separator's byte taken for itself, which windows don't reach
    by = np.lexsort((first[owner, 1] + offset, first[owner, 0], group))
    goes = np.ones(len(by), dtype=bool)
    lead = np.ones(len(by), dtype=bool)
    lead[1:] = group[by][1:] != group[by][:-1]
    goes[by[lead]] = False
    return np.split(goes, np.cumsum(size - width + 1)[:-1])


def _judge(width: int):
    def run(table: pa.Table) -> pa.Table:
        out: dict[int, list[np.ndarray]] = {}
        block, rows, start, windows, anchors, texts, forwarded = [], [], [], [], [], [], []
        for b, r, s, w, h, raw, gone in zip(*(table.column(x).to_pylist() for x in ("block", "row", "start", "windows", "anchors", "bytes", "gone")), strict=True):
            if gone:
                forwarded.append((b, np.frombuffer(gone, dtype="<i8").reshape(3, -1)))
                continue
            ids = np.frombuffer(r, dtype="<i8").reshape(-1, 2)
            count = np.frombuffer(w, dtype="<i8")
            end = np.cumsum(count + width - 1)
            raw = pa.decompress(raw, decompressed_size=int(end[-1]), codec="zstd", asbytes=True)
            texts += [raw[e - c - width + 1 : e] for c, e in zip(count.tolist(), end.tolist(), strict=True)]
            block.append(np.full(len(ids), b))
            rows.append(ids)
            start.append(np.frombuffer(s, dtype="<i8"))
            windows.append(count)
            anchors.append(np.frombuffer(h, dtype=np.uint64))
        for b, x in forwarded:
            out.setdefault(b, []).append(x)
        if texts:
            block_, ids, begin, count = np.concatenate(block), np.concatenate(rows), np.concatenate(start), np.concatenate(windows)
            by = np.lexsort((begin, ids[:, 1], ids[:, 0])).tolist()
            known: dict[bytes, int] = {}
            distinct, earliest, copies = [], [], []
            rank, before = -1, None
            for i in by:
                doc = (ids[i, 0], ids[i, 1])
                rank, before = rank + (doc != before), doc
                if texts[i] in known:
                    copies.append(i)
                else:
                    known[texts[i]] = len(distinct)
                    distinct.append(i)
                    earliest.append((rank, begin[i]))
            gone = [(block_[i], ids[i, 1], begin[i], begin[i] + count[i] - 1) for i in copies]
            # equal windows have equal anchors, and no stretch holds a window twice: one alone with its anchor is done
            first, anchor = np.array(earliest, dtype=np.int64), np.concatenate(anchors)[distinct]
            for group in _turns(anchor, np.array([len(texts[i]) for i in distinct])):
                for k, goes in zip(group, _sort_group([texts[distinct[k]] for k in group], first[group], width), strict=True):
                    if not goes.any():
                        continue
                    i = distinct[k]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], goes.view(np.int8), [0]))))
                    gone += [(block_[i], ids[i, 1], begin[i] + a, begin[i] + b - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            if gone:
                all_gone = np.array(gone, dtype=np.int64)
                all_gone = all_gone[np.argsort(all_gone[:, 0], kind="stable")]
                cuts = np.flatnonzero(np.diff(all_gone[:, 0])) + 1
                for x in np.split(all_gone, cuts):
                    out.setdefault(int(x[0, 0]), []).append(x[:, 1:].T)
        packed = []
        for b, xs in out.items():
            x = np.concatenate(xs, axis=1).astype("<i8")
            packed.append((b, *(np.ascontiguousarray(v).tobytes() for v in x)))
        return _table(packed, (("block", pa.int64()), ("row", pa.binary()), ("first", pa.binary()), ("last", pa.binary())))

    return run


def _turns(anchor: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """Stretches to sort together: all of an anchor with several, about ``SORTED`` bytes at once."""
    _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
    several = count[inverse] > 1
    turns = np.uint64(1 + int(size[several].sum()) // SORTED)
    turn = (anchor >> np.uint64(40)) % turns
    return [found for t in range(int(turns)) if (found := np.flatnonzero(several & (turn == t)).tolist())]


def _cut(width: int):
    fields = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()))

    def run(table: pa.Table, gone: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], fields)
        block = Block(table, width)
        depth = np.zeros(len(block.data) + 1, dtype=np.int32)
        for r, a, b in zip(gone.column("row"), gone.column("first"), gone.column("last"), strict=True):
            row, first, last = (np.frombuffer(x.as_py(), dtype="<i8") for x in (r, a, b))
            np.add.at(depth, block.begin[row] + first, 1)
            np.add.at(depth, block.begin[row] + last + width, -1)
        removed = np.cumsum(depth[:-1], dtype=np.int32) > 0
        rows = []
        for doc, begin, size in zip(block.table.column("_id").to_pylist(), block.begin.tolist(), block.size.tolist(), strict=True):
            off = removed[begin : begin + size]
            n = int(np.count_nonzero(off))
            spans = int(np.count_nonzero(off[1:] & ~off[:-1])) + int(size > 0 and off[0]) if n else 0
            kept = block.data[begin : begin + size]
            rows.append((doc, size, n, spans, (kept[~off] if n else kept).tobytes()))
        return _table(rows, fields)

    return run


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text without the bytes of strings that occur earlier.

    A null text is empty; a null id comes before all others; rows that repeat an id count as parts of it in order of
    their texts; an empty table gives an empty one.  Blocks, partitions and shards are as many as the bytes of text ask
    for; a shard sorts ``SORTED`` bytes at a time unless one anchor has more distinct surroundings than that.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_doc"), whole(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text")).cast("long")).first()[0] or 0
    blocks, parts, shards = (1 + size // x for x in (BLOCK, PART, SHARD))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_doc"), F.lit(blocks)))
    held = rows.groupBy("_block")
    answer = _answer(HOT_BLOCKS)
    anchors = held.applyInArrow(_ask(width, parts), ASKED).groupBy("part").applyInArrow(answer, ANSWER)
    anchors = anchors.withColumn("round", F.lit(1))
    windows = held.cogroup(anchors.groupBy("block")).applyInArrow(_ask_hot(width, parts), ASKED)
    windows = windows.groupBy("part").applyInArrow(answer, ANSWER).withColumn("round", F.lit(2))
    answers = anchors.unionByName(windows)
    sent = held.cogroup(answers.groupBy("block")).applyInArrow(_send(width, parts, shards), STRETCHES)
    # nothing is written between the steps: in one job the exchange of texts serves all four, and is all that is kept of them
    gone = sent.groupBy("shard").applyInArrow(_judge(width), GONE)
    return held.cogroup(gone.groupBy("block")).applyInArrow(_cut(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
