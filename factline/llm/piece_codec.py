"""SentencePiece encoding and decoding, by a streaming Viterbi search.

The lattice has a node for every boundary between characters and an edge for every vocabulary piece.  The file's model
is of the merging kind: its segmentation is the one path whose neighbouring pieces would all stay apart if merged by
rank, so a step scores 0 if the pieces on both sides of a boundary stay apart and minus infinity else.  That makes the
survivor of each boundary unique: the search keeps one backpointer a boundary, in a window as long as the longest piece,
and commits ids up to a boundary as soon as the survivors of all boundaries in the window run through it.

Two forms share these steps.  ``stream`` takes one text of any length in bounded memory.  ``Codec.encode`` cuts texts
where no piece can continue (before a blank that follows another character: all survivors meet there), so the same run
of characters is searched once for all texts of a task, many runs side by side in numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.text import packed, unpacked
from factline.llm.token_counts import slices

BLANK = "▁"
#: Runs longer than this are searched by ``stream``.
LONG = 48
#: Runs that a task remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
#: Runs searched side by side.
BESIDE = 40_000
CACHE = 1 << 20
NEVER = 2**31 - 1


def merge_plainly(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge best-ranked neighbours, leftmost first; also the last pair merged."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min(((rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best[0] == NEVER:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


def load_pieces(path: str) -> dict:
    """A model file as arrays: characters, trie edges, pieces by order of merging, their halves, mergeable pairs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    text = {i: model.id_to_piece(i) for i in plain}
    single = [i for i in plain if len(text[i]) == 1]
    several = sorted((i for i in plain if len(text[i]) > 1), key=lambda i: (-model.get_score(i), i))
    rank = {text[i]: k for k, i in enumerate(several, len(single))}
    halves = {}
    for i in several:
        parts, last = merge_plainly(text[i], rank)
        if len(parts) == 1:
            halves[i] = last
    several = [i for i in several if i in halves]  # no text is ever cut into the others
    ids = single + several
    order = {text[i]: k for k, i in enumerate(ids)}
    n = len(ids)
    left, right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
    pairs = {}
    for i in several:
        k = order[text[i]]
        left[k], right[k] = order[halves[i][0]], order[halves[i][1]]
        for cut in range(1, len(text[i])):
            a, b = order.get(text[i][:cut]), order.get(text[i][cut:])
            if a is not None and b is not None:
                pairs[a * n + b] = k
    chars = {text[i]: k for k, i in enumerate(single)}
    width, edges, ends, nodes = len(single) + 1, {}, [-1], 1
    for i in ids:
        at = 0
        for c in text[i]:
            key = at * width + chars[c]
            if key not in edges:
                edges[key], nodes = nodes, nodes + 1
                ends.append(-1)
            at = edges[key]
        ends[at] = order[text[i]]
    keys = np.array(sorted(pairs), dtype=np.int64)
    edge = np.array(sorted(edges), dtype=np.int64)
    reach = max(map(len, text.values()))
    points = np.full(0x110000, -1, dtype=np.int16)
    for c, k in chars.items():
        points[ord(c)] = k
    joins = re.compile(f"[^{BLANK}]{BLANK}")
    return {
        "ids": np.array(ids, dtype=np.int32),
        "text": [text[i] for i in ids],
        "length": np.array([len(text[i]) for i in ids], dtype=np.int64),
        "left": left,
        "right": right,
        "pair_keys": keys,
        "pair_to": np.array([pairs[k] for k in keys.tolist()], dtype=np.int64),
        "edge_keys": edge,
        "edge_to": np.array([edges[k] for k in edge.tolist()], dtype=np.int64),
        "first": np.array([edges.get(c, -1) for c in range(width)], dtype=np.int64),
        "ends": np.array(ends, dtype=np.int64),
        "chars": points[:0x10000].copy() if (points[0x10000:] < 0).all() else points,
        "width": width,
        "reach": reach,
        "bytes": [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        "size": size,
        "meets": not any(joins.search(x) for x in text.values()),
    }


def apart(pieces: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether piece a followed by piece b stays so: undo their merges, latest first, and look for an earlier one across."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    n, keys, to = len(pieces["ids"]), pieces["pair_keys"], pieces["pair_to"]
    left, right = pieces["left"], pieces["right"]
    out = np.ones(len(a), dtype=bool)
    at, limit = np.arange(len(a)), np.full(len(a), NEVER, dtype=np.int64)
    while len(at):
        key = a * n + b
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        joined = (keys[k] == key) & (to[k] < limit)
        out[at[joined]] = False
        undo_a = (a > b) & (right[a] != a)
        undo_b = ~undo_a & (left[b] != b)
        undo_a |= ~undo_b & (right[a] != a)
        limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
        on = ~joined & (undo_a | undo_b)
        a, b = np.where(undo_a, right[a], a)[on], np.where(undo_b, left[b], b)[on]
        at, limit = at[on], limit[on]
    return out


class Steps:
    """``apart`` with the answers of earlier questions at hand, in a table of fixed size."""

    def __init__(self, pieces: dict):
        self.pieces, self.n = pieces, len(pieces["ids"])
        self.key, self.value = np.full(CACHE, -1, dtype=np.int64), np.zeros(CACHE, dtype=bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        slot = (key * 0x9E3779B1 >> 7) & (CACHE - 1)
        out = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        if len(miss):
            found = apart(self.pieces, a[miss], b[miss])
            out[miss] = found
            self.value[slot[miss]] = found
            self.key[slot[miss]] = key[miss]
            wrong = self.key[slot[miss]] != key[miss]  # two of this call share a slot: the later key won
            self.value[slot[miss][~wrong]] = found[~wrong]
        return out


def follow(pieces: dict, node: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Trie nodes one character on, or -1."""
    key = node * pieces["width"] + char
    k = np.minimum(np.searchsorted(pieces["edge_keys"], key), len(pieces["edge_keys"]) - 1)
    return np.where(pieces["edge_keys"][k] == key, pieces["edge_to"][k], -1)


def search(pieces: dict, steps: Steps, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of runs of known characters, and their number by run; all searched side by side, boundary by boundary.

    The runs lie one after another in ``chars``; longer ones get the first columns of the grid."""
    order = np.argsort(-sizes, kind="stable")
    most, count = int(sizes.max()), len(sizes)
    rank = np.empty(count, dtype=np.int64)
    rank[order] = np.arange(count)
    grid = np.zeros((most, count), dtype=np.int64)
    grid[np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(rank, sizes)] = chars
    size = sizes[order]
    back = np.full((most + 1, count), -1, dtype=np.int64)
    for begin in range(most):
        row = np.arange(np.searchsorted(-size, -begin, side="left"))  # runs longer than begin
        node = np.zeros(len(row), dtype=np.int64)
        for end in range(begin + 1, min(begin + pieces["reach"], most) + 1):
            on = size[row] >= end
            row, node = row[on], node[on]
            if not len(row):
                break
            char = grid[end - 1][row]
            node = pieces["first"][char] if end == begin + 1 else follow(pieces, node, char)
            on = node >= 0
            row, node = row[on], node[on]
            piece = pieces["ends"][node]
            there = piece >= 0
            r, p = row[there], piece[there]
            if begin and len(r):
                before = back[begin][r]
                good = before >= 0
                good[good] = steps(before[good], p[good])
                r, p = r[good], p[good]
            back[end][r] = p
    at, cols, found = size.copy(), np.arange(count), []
    while len(cols):
        p = back[at, cols]
        found.append((cols, p))
        at = at - pieces["length"][p]
        on = at > 0
        at, cols = at[on], cols[on]
    where = order[np.concatenate([c for c, _ in found])][::-1]
    what = np.concatenate([p for _, p in found])[::-1]
    return what[np.argsort(where, kind="stable")], np.bincount(where, minlength=count)


def stream(pieces: dict, chars: Iterator[int]) -> Iterator[int]:
    """Pieces of one run of known characters, committed as the survivors converge; holds one window, not the run."""
    reach, n = pieces["reach"], len(pieces["ids"])
    edges = pieces.setdefault("edge_map", dict(zip(pieces["edge_keys"].tolist(), pieces["edge_to"].tolist(), strict=True)))
    known: dict[int, bool] = {}
    ends, length, width = pieces["ends"], pieces["length"], pieces["width"]
    back: dict[int, int] = {0: -1}  # boundary: the piece that ends there
    live: list[tuple[int, int]] = []  # begin and trie node of the edges under way
    done, at = 0, 0

    def fits(a: int, b: int) -> bool:
        if a < 0:
            return True
        if (key := a * n + b) not in known:
            if len(known) > CACHE:
                known.clear()
            known[key] = bool(apart(pieces, np.array([a]), np.array([b]))[0])
        return known[key]

    def path(end: int) -> list[int]:
        out = []
        while end > done:
            out.append(back[end])
            end -= int(length[back[end]])
        return out[::-1]

    for c in chars:
        live.append((at, 0))
        at += 1
        on = []
        for begin, node in live:
            if (to := edges.get(node * width + c, -1)) >= 0:
                on.append((begin, to))
                if (p := int(ends[to])) >= 0 and at not in back and begin in back and fits(back[begin] if begin else -1, p):
                    back[at] = p
        live = on
        if at - done >= 4 * reach:  # all survivors of the window: where do they meet?
            paths = []
            for end in range(at - reach + 1, at + 1):
                if end in back:
                    bounds, walk = [], done
                    for p in path(end):
                        walk += int(length[p])
                        bounds.append(walk)
                    paths.append(bounds)
            shared = set(paths[0]).intersection(*paths[1:]) if paths else set()
            shared = {b for b in shared if b <= at - reach}
            if shared:
                meet = max(shared)
                yield from path(meet)
                back = {b: p for b, p in back.items() if b >= meet}
                done = meet
    yield from path(at)


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, pieces: dict):
        self.pieces, self.steps, self.seen = pieces, Steps(pieces), {}
        # cuts: where a blank follows another character, and on both sides of characters that no piece holds
        apart = "\n" if pieces["chars"][10] < 0 else ""
        self.cut = re.compile(f"{BLANK}+[^{BLANK}{apart}]*|[^{BLANK}{apart}]+" + "|\n+" * bool(apart) if pieces["meets"] else "(?s).+").findall
        self.shown = np.array([""] * pieces["size"], dtype=object)
        for k, i in enumerate(pieces["ids"].tolist()):
            self.shown[i] = pieces["text"][k].replace(BLANK, " ")
        self.byte_of = np.full(pieces["size"], -1, dtype=np.int32)
        self.byte_of[pieces["bytes"]] = np.arange(256)

    def learn(self, units: list[str]) -> None:
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        table = self.pieces["chars"]
        char = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], -1).astype(np.int64)
        size = np.array([len(u) for u in units])
        begin = np.cumsum(size) - size
        strange = np.add.reduceat(char < 0, begin) > 0
        easy = np.flatnonzero(~strange & (size <= LONG))
        for k in range(0, len(easy), BESIDE):
            part = easy[k : k + BESIDE]
            of_part = np.zeros(len(size), dtype=bool)
            of_part[part] = True
            found, counts = search(self.pieces, self.steps, char[np.repeat(of_part, size)], size[part])
            ids = self.pieces["ids"][found].tolist()
            end = np.cumsum(counts)
            for u, a, b in zip(part.tolist(), (end - counts).tolist(), end.tolist(), strict=True):
                self.seen[units[u]] = tuple(ids[a:b])
        for u in np.flatnonzero(strange | (size > LONG)).tolist():
            self.seen[units[u]] = tuple(self.one_by_one(units[u], char[begin[u] : begin[u] + size[u]]))

    def one_by_one(self, unit: str, char: np.ndarray) -> list[int]:
        """A long run, or one with characters outside the vocabulary, which stand as their UTF-8 bytes."""
        out: list[int] = []
        bounds = np.flatnonzero(np.diff((char < 0).astype(np.int8))) + 1
        for begin, end in zip([0, *bounds], [*bounds, len(char)], strict=True):
            if char[begin] < 0:
                out += [self.pieces["bytes"][b] for b in unit[begin:end].encode("utf-8", "surrogatepass")]
            else:
                out += self.pieces["ids"][list(stream(self.pieces, iter(char[begin:end].tolist())))].tolist()
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        work = [self.cut(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        fresh = {u for us in work for u in us}
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        fresh.difference_update(self.seen)
        if fresh:
            self.learn(list(fresh))
        out = []
        for us in work:
            ids: list[int] = []
            for part in map(self.seen.__getitem__, us):
                ids += part
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        at = np.array(ids, dtype=np.int64)
        byte = self.byte_of[at]
        if (byte < 0).all():
            text = "".join(self.shown[at].tolist())
        else:
            shown, text, k = self.shown[at].tolist(), [], 0
            edges = np.flatnonzero(np.diff((byte >= 0).astype(np.int8))) + 1
            for begin, end in zip([0, *edges], [*edges, len(at)], strict=True):
                text.append(bytes(byte[begin:end].tolist()).decode("utf-8", "replace") if byte[begin] >= 0 else "".join(shown[begin:end]))
            text = "".join(text)
        return text[1:] if text.startswith(" ") else text


DIGEST = "n_tokens long, ids_sha256 string, exact boolean"


def encode_pieces(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into`` (array of ids): a null or empty text has none.  No shuffle; memory is bounded by the codec's tables,
    ``REMEMBERED`` runs, the slice of a batch at work and the longest text."""
    pieces = load_pieces(path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(pieces)
        for texts in batches:
            parts = [pa.array(codec.encode(part), pa.list_(pa.int32())) for part in slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return unpacked(packed(docs, text).withColumn("_ids", encode("_text")), docs, {into: F.col("_ids")})


def encode_checked(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids``, ``n_tokens`` and ``exact``: whether decoding the ids gives the text again."""
    pieces = load_pieces(path)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("exact", pa.bool_())])

    @F.arrow_udf("ids array<int>, n_tokens long, exact boolean")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(pieces)
        for texts in batches:
            parts = []
            for part in slices(texts):
                found = codec.encode(part)
                exact = [codec.decode(x) == (t or "").replace(BLANK, " ") for t, x in zip(part, found, strict=True)]
                columns = [pa.array(found, pa.list_(pa.int32())), pa.array([len(x) for x in found], pa.int64()), pa.array(exact, pa.bool_())]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    rows = packed(docs, text).withColumn("_coded", encode("_text"))
    return unpacked(rows, docs, {c: F.col("_coded").getField(c) for c in ("ids", "n_tokens", "exact")})


def decode_pieces(docs: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Add ``into``: the text of ``ids``; null or no ids give an empty text."""
    pieces = load_pieces(path)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(pieces)
        for rows in batches:
            yield pa.array([codec.decode(x or []) for x in rows.to_pylist()], pa.string())

    return docs.withColumn(into, decode(F.col(ids)))


def check_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add what a manifest needs: ``n_tokens``, ``ids_sha256`` (of the ids as little-endian 32-bit numbers) and ``exact``,
    whether decoding the ids gives the text again.  Texts that hold the model's blank mark itself come back with blanks."""
    pieces = load_pieces(path)

    @F.arrow_udf(DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(pieces)
        kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("exact", pa.bool_())])
        for texts in batches:
            out = []
            for part in slices(texts):
                for text, ids in zip(part, codec.encode(part), strict=True):
                    sha = hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest()
                    out.append({"n_tokens": len(ids), "ids_sha256": sha, "exact": codec.decode(ids) == (text or "").replace(BLANK, " ")})
            yield pa.array(out, kind)

    rows = packed(docs, text).withColumn("_digest", digest("_text"))
    return unpacked(rows, docs, {c: F.col("_digest").getField(c) for c in ("n_tokens", "ids_sha256", "exact")})
