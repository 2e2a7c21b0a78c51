"""SentencePiece encoding and decoding by a streaming Viterbi.

The pieces and scores of a SentencePiece model are taken as a unigram model: a text's ids are those of the path with
the largest sum of scores. A text is read from left to right. The window holds, for at most `longest` places, the best
score and the piece that leads there; whenever the back pointers of all places that a later piece can still start from
run through one boundary, the ids up to it are final and leave the window.

A space is written as the mark U+2581, and one mark is put in front. A character without a piece costs the worst
ordinary score less 10 and is emitted as the pieces of its bytes. In models whose pieces carry the mark only at their
front (checked on loading), no piece crosses the place in front of a mark that follows another character, so all paths
converge there whatever the text: the run up to it is committed without asking the back pointers, and its ids can be kept
and used again. Runs of at most LONG characters are taken many at a time, their windows side by side in numpy (`short`);
longer runs, and the whole text with other models, go character by character (`stream`).

A text passes in slices of about CHUNK characters that end at such places, GROUP characters of slices together; ids,
checksums and decoded text follow slice by slice, so beside the text itself memory holds one group, the window, and the
ids of at most CACHE runs.

Of paths with equal sums, the one whose last piece is the shorter wins at every place.

Defined cases: a null or empty text has no ids and decodes to the empty text; decode(encode(t)) == t for every text but
for characters of the mark itself, which come back as spaces; repeated rows are encoded each for itself; kept columns
whose names the new ones take are replaced.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, texts, tune

INF = float("inf")
MARK, WORST, UNKNOWN, CACHE, LONG, SIDE, CHUNK, GROUP = "▁", -1e8, 10.0, 500_000, 64, 8192, 1 << 18, 1 << 21


class Edges:
    """Children of trie nodes by character: a hash table of exact keys, looked up many at a time."""

    EMPTY, BITS = np.uint64(0xFFFFFFFFFFFFFFFF), 21  # a key is the node's number and the character

    def __init__(self, parent: np.ndarray, char: np.ndarray, child: np.ndarray):
        keys = (parent.astype(np.uint64) << np.uint64(self.BITS)) | char.astype(np.uint64)
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys, self.child = np.full(self.mask + 1, self.EMPTY), np.zeros(self.mask + 1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            first = np.unique(at, return_index=True)[1]
            first = first[self.keys[at[first]] == self.EMPTY]
            self.keys[at[first]], self.child[at[first]] = keys[left[first]], child[left[first]]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by its character, -1 without one."""
        keys = (node.astype(np.uint64) << np.uint64(self.BITS)) | char.astype(np.uint64)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.child[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen != self.EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            seen = self.keys[slot[left]]
            out[left[seen == keys[left]]] = self.child[slot[left[seen == keys[left]]]]
            left = left[(seen != keys[left]) & (seen != self.EMPTY)]
        return out


class Pieces:
    """Scores and ids by piece, ids of bytes, pieces by id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.score, self.id, self.byte = [], {}, {}, {}
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            self.text.append(p)
            if sp.is_byte(i):
                self.byte[int(p[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[p], self.id[p] = float(sp.get_score(i)), i
        self.control = {i for i in range(sp.vocab_size()) if sp.is_control(i) or sp.is_unknown(i)}
        self.number = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id))
        self.unknown = min((s for s in self.score.values() if s > WORST), default=0.0) - UNKNOWN
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.id)
        # every end of a piece, with its score if it is a piece itself: no longer piece ends with what is not in here
        self.tail = {p[i:]: -INF for p in self.id for i in range(len(p))} | self.score
        # the same as a trie, read backwards from the end of a piece: node 0 is the empty tail
        node = {t: i + 1 for i, t in enumerate(self.tail)} | {"": 0}
        self.edges = Edges(np.array([node[t[1:]] for t in self.tail]), np.array([ord(t[0]) for t in self.tail]), np.arange(1, len(node)))
        self.node_score = np.array([-INF, *self.tail.values()])
        self.node_id = np.array([-1, *(self.id.get(t, -1) for t in self.tail)], np.int64)
        # what an id adds to the text: bytes under 128 are characters of their own; None: a byte of a longer character
        self.shown = [("" if i in self.control else chr(self.number[i]) if self.number.get(i, 128) < 128 else None if i in self.number else t) for i, t in enumerate(self.text)]
        self.parts = np.array([x is None for x in self.shown])

    def _extend(self, held: str, first: int, best: list[float], back: list[int]) -> None:
        """The best way to each place of the window from `first` on; the places before are known."""
        get, single, unknown, longest = self.tail.get, self.score.get, self.unknown, self.longest
        for n in range(first, len(held) + 1):
            start = n - 1
            top = best[start] + single(held[start], unknown)
            for k in range(n - 2, max(n - longest, 0) - 1, -1):
                s = get(held[k:n], INF)
                if s == INF:
                    break
                s += best[k]
                if s > top:
                    top, start = s, k
            best.append(top)
            back.append(start)

    def stream(self, text: Iterator[str] | str) -> Iterator[list[int]]:
        """Lists of final ids, as soon as they are final."""
        longest, held = self.longest, ""  # held: the characters from the last place where all paths meet
        best, back = [0.0], [0]
        for ch in text:
            held += ch
            n = len(held)
            self._extend(held, n, best, back)
            if n >= 2 * longest:
                at = self._meet(back, max(0, n - longest + 1), n)
                if at:
                    yield self._ids(held, back, at)
                    held = held[at:]
                    best, back = [b - best[at] for b in best[at:]], [max(0, b - at) for b in back[at:]]
        if held:
            yield self._ids(held, back, len(held))

    def short(self, runs: list[str]) -> list[bytes]:
        """The ids, as bytes, of many runs whose paths all meet at their ends: one window each, side by side."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        out = [b""] * len(runs)
        for a in range(0, len(runs), SIDE):
            for i, ids in zip(order[a : a + SIDE], self._side_by_side([runs[i] for i in order[a : a + SIDE]]), strict=True):
                out[i] = ids
        return out

    def _side_by_side(self, runs: list[str]) -> Iterator[bytes]:
        """Runs from the longest to the shortest; place n of all runs is row n of each table."""
        size, w = np.array([len(r) for r in runs]), len(runs)
        char = np.zeros((int(size[0]), w), np.int64)
        char[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(w), size)] = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4")
        char = char.ravel()
        # the pieces that end at each character, by length; only tails that a longer piece can end with are followed
        score, ident = [np.full(len(char), self.unknown)], [np.full(len(char), -1, np.int32)]
        at, node = np.flatnonzero(np.arange(len(char)) // w < size[np.arange(len(char)) % w]), 0
        for n in range(1, self.longest + 1):
            node = self.edges.follow(node if n > 1 else np.zeros(len(at), np.int64), char[at - (n - 1) * w])
            if n > 1:
                score.append(np.full(len(char), -INF))
                ident.append(np.full(len(char), -1, np.int32))
            found = np.flatnonzero(self.node_id[node] >= 0)  # node -1 is the last one's, so it is sorted out below
            found = found[node[found] >= 0]
            score[-1][at[found]], ident[-1][at[found]] = self.node_score[node[found]], self.node_id[node[found]]
            on = np.flatnonzero((node >= 0) & (at >= n * w))
            at, node = at[on], node[on]
            if not len(at):
                break
        top, last = np.zeros((int(size[0]) + 1, w)), np.zeros((int(size[0]) + 1, w), np.int8)
        for n in range(1, int(size[0]) + 1):
            k = int(np.searchsorted(-size, -n, side="right"))  # runs of n characters at least stand in front
            row = slice((n - 1) * w, (n - 1) * w + k)
            best, length = top[n, :k], last[n, :k]
            best[:], length[:] = top[n - 1, :k] + score[0][row], 1
            for j in range(1, min(n, len(score))):
                s = top[n - 1 - j, :k] + score[j][row]
                np.putmask(length, s > best, j + 1)
                np.maximum(best, s, out=best)
        alive, end, ids, of = np.arange(w), size.copy(), [], []
        ident = np.stack(ident)
        while len(alive):
            length = last[end[alive], alive]
            ids.append(ident[length - 1, (end[alive] - 1) * w + alive])
            of.append(alive)
            end[alive] -= length
            alive = alive[end[alive] > 0]
        of, ids = np.concatenate(of)[::-1], np.concatenate(ids)[::-1]  # each run in reading order now
        turn = np.argsort(of, kind="stable")
        ids, ends = ids[turn], np.cumsum(np.bincount(of, minlength=w)).tolist()
        bare = set(of[turn][ids < 0].tolist())  # runs with a character that has no piece
        data = ids.astype("<u4").tobytes()
        for i, (a, z) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if i not in bare:
                yield data[4 * a : 4 * z]
                continue
            cuts = [len(runs[i])]
            while cuts[-1]:
                cuts.append(cuts[-1] - int(last[cuts[-1], i]))
            yield array("I", self._cut(runs[i], cuts[::-1])).tobytes()

    @staticmethod
    def _meet(back: list[int], first: int, last: int) -> int:
        """The last boundary that the paths of all places first .. last run through; 0: none yet."""
        alive = set(range(first, last + 1))
        while len(alive) > 1:
            alive.add(back[top := max(alive)])
            alive.discard(top)
        return alive.pop()

    def _ids(self, text: str, back: list[int], end: int) -> list[int]:
        cuts = [end]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        return self._cut(text, cuts[::-1])

    def _cut(self, text: str, cuts: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = self.id.get(text[a:b])
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte[x] for x in text[a:b].encode("utf-8", "surrogatepass"))
        return out


class Codec(dict):
    """Encodes and decodes; holds the ids, as bytes, of the runs that its worker has met."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, run: str) -> bytes:
        return b"".join(array("I", ids).tobytes() for ids in self.pieces.stream(run))

    def slices(self, text: str) -> Iterator[list[str]]:
        """The runs of the marked text, a slice at a time; a slice ends in front of a space that follows another character."""
        start = 0
        while start < len(text):
            end = len(text)
            if self.pieces.by_word and end - start > CHUNK:
                cut = text.find(" ", start + CHUNK)
                while cut >= 0 and text[cut - 1] in (" ", MARK):
                    cut = text.find(" ", cut + 1)
                end = cut if cut >= 0 else end
            marked = (MARK if start == 0 else "") + text[start:end].replace(" ", MARK)
            start = end
            if not self.pieces.by_word:
                yield [marked]
            elif MARK + MARK in marked:
                yield re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
            else:
                yield [MARK + w for w in marked[1:].split(MARK)]

    def parts(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """The number of a text and ids of it, slice by slice in reading order; texts without ids are left out."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for runs in self.slices(text):
                held.append((i, runs))
                size += min(len(text), CHUNK)
                if size >= GROUP:
                    yield from self._ids_of(held)
                    held, size = [], 0
        yield from self._ids_of(held)

    def _ids_of(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        if self.pieces.by_word:
            if len(self) > CACHE:
                self.clear()
            new = [r for r in set(chain.from_iterable(runs for _, runs in held)) if r not in self and len(r) <= LONG]
            if new:
                self.update(zip(new, self.pieces.short(new), strict=True))
        for i, runs in held:
            yield i, np.frombuffer(b"".join(map(self.__getitem__, runs)), "<u4")

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(ids for _, ids in self.parts([text]))])

    def decode(self, ids, first: bool = True) -> str:
        """The text of ids; with first, of a whole text or its first slice, the mark in front goes."""
        p = self.pieces
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if not p.parts[ids].any():
            text = "".join(map(p.shown.__getitem__, ids.tolist()))
        else:
            out, raw = [], bytearray()
            for i in ids.tolist():
                if i in p.number:
                    raw.append(p.number[i])
                    continue
                if raw:
                    out.append(raw.decode(errors="replace"))
                    raw = bytearray()
                out.append(p.shown[i])
            text = "".join(out) + raw.decode(errors="replace")
        text = text.replace(MARK, " ")
        return text[1:] if first and text.startswith(" ") else text


@functools.lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """One for all tasks of a worker process."""
    return Codec(Pieces(path))


def encode(docs: DataFrame, model: str, *, text: str = "text", keep: list[str] = (), prefix: str = "") -> DataFrame:
    """Per row: kept columns, ids."""
    tune(docs.sparkSession)

    def make():
        codec = codec_of(model)

        def run(batch):
            rows = [t.decode(errors="replace") for t in texts(batch, text)]
            out: list[list[np.ndarray]] = [[] for _ in rows]
            for i, ids in codec.parts(rows):
                out[i].append(ids)
            return [[np.concatenate([np.zeros(0, np.uint32), *x]).astype(np.int32) for x in out]]

        return run

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, [(prefix + "ids", "array<int>")], list(keep))


def decode(docs: DataFrame, model: str, *, ids: str = "ids", keep: list[str] = ()) -> DataFrame:
    """Per row: kept columns, decoded."""
    tune(docs.sparkSession)

    def make():
        codec = codec_of(model)

        def run(batch):
            return [[codec.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]]

        return run

    return map_batches(docs.select(*dict.fromkeys([*keep, ids])), make, [("decoded", "string")], list(keep))


def round_trip(docs: DataFrame, model: str, *, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """Per row: kept columns, n_ids, ids_crc32 (of the ids as little-endian u32), decoded_sha256, exact (decoding gave the text)."""
    import hashlib

    tune(docs.sparkSession)

    def make():
        codec = codec_of(model)

        def run(batch):
            rows = [t.decode(errors="replace") for t in texts(batch, text)]
            count, crc, at, same = [0] * len(rows), [0] * len(rows), [0] * len(rows), [True] * len(rows)
            sha = [hashlib.sha256() for _ in rows]
            for i, ids in codec.parts(rows):
                back = codec.decode(ids, first=count[i] == 0)
                count[i], crc[i] = count[i] + len(ids), zlib.crc32(ids.astype("<u4").tobytes(), crc[i])
                sha[i].update(back.encode())
                same[i], at[i] = same[i] and rows[i].startswith(back, at[i]), at[i] + len(back)
            return [count, crc, [h.hexdigest() for h in sha], [s and n == len(t) for s, n, t in zip(same, at, rows, strict=True)]]

        return run

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, [("n_ids", "long"), ("ids_crc32", "long"), ("decoded_sha256", "string"), ("exact", "boolean")], list(keep))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


ORACLE = None
