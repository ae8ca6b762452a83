"""SentencePiece encoding and decoding with source offsets.

A model file gives the compiled character map, the pieces and their scores. Normalisation
takes the longest prefix of the map at each place and records, for every byte it writes,
the source byte it came from; each piece of the normalised text is then projected back to
a span of source bytes. The pairs with the best score merge first, leftmost first, as in
the library's BPE; unknown characters become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from epistola.llm.common import map_rows, text_of

SPACE = "▁"
#: Chunks, and their characters, that a Python worker knows before it forgets them, and characters of texts that are encoded together.
KNOWN_CHUNKS, KNOWN_CHARS, PORTION = 300_000, 6_000_000, 1_000_000
#: Largest lengths of the chunks that merge together; longer ones merge alone.
BANDS = (4, 8, 12, 18, 27)
NEVER = np.iinfo(np.int32).max
#: Types of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The compiled map: a double-array trie over source bytes and the texts it leads to."""

    def __init__(self, blob: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]
        leads = b"".join(re.escape(bytes((b,))) for b in range(1, 256) if b & 0xC0 != 0x80 and self._begins(b))
        self.places = re.compile(b"[" + leads + b"]").finditer if leads else lambda data: ()

    def _begins(self, byte: int) -> bool:
        """Whether some key begins with that byte."""
        if not self.units:
            return False
        node = ((self.units[0] >> 10) << ((self.units[0] & (1 << 9)) >> 6)) ^ byte
        return node < len(self.units) and self.units[node] & ((1 << 31) | 0xFF) == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                start = units[node] & ((1 << 31) - 1)
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Normalizer:
    """Text to normalised text and, per normalised byte, the source bytes it came from."""

    def __init__(self, spec) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE.encode() if spec.escape_whitespaces else b" "

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        if (found := self.map.longest(data, at)) is not None:
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the map, begin and end of their source (a matched prefix, else one character), and whether they may be squeezed.

        The longest prefix is tried wherever a key of the map can begin; what no key covers stays, character by character.
        """
        source = np.frombuffer(data, np.uint8)
        first = np.flatnonzero((source & 0xC0) != 0x80)
        width = np.diff(first, append=len(data))
        begin, end = np.repeat(first, width), np.repeat(first + width, width)
        parts, done = [], 0
        for m in self.map.places(data):
            at = m.start()
            if at < done or (found := self.map.longest(data, at)) is None:
                continue
            n, new = found
            parts.append((source[done:at], begin[done:at], end[done:at], np.ones(at - done, bool)))
            made = np.frombuffer(new, np.uint8)
            parts.append((made, np.full(len(new), at), np.full(len(new), at + n), np.arange(len(new)) < len(new) - len(new.lstrip(b" "))))
            done = at + n
        parts.append((source[done:], begin[done:], end[done:], np.ones(len(data) - done, bool)))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]

    def align(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes, len(bytes) + 1 source begins (the last is the end of what was read) and len(bytes) source ends."""
        data, skipped = text.encode("utf-8", "surrogatepass"), 0
        if self.squeeze:
            while skipped < len(data) and (step := self._prefix(data, skipped))[1] == b" ":
                skipped += step[0]
        if skipped == len(data):
            return b"", np.array([skipped]), np.empty(0, np.int64)
        made, begin, end, loose = self._mapped(data[skipped:])
        blank = made == 0x20
        if self.squeeze:
            kept = ~(blank & loose & np.concatenate([[True], blank[:-1]]))
            made, begin, end, blank = made[kept], begin[kept], end[kept], blank[kept]
        whole = made.tobytes()
        if len(self.space) > 1:
            times = np.where(blank, len(self.space), 1)
            whole, begin, end = whole.replace(b" ", self.space), np.repeat(begin, times), np.repeat(end, times)
        if self.dummy:
            none = np.zeros(len(self.space), np.int64)
            whole, begin, end = self.space + whole, np.concatenate([none, begin]), np.concatenate([none, end])
        begin = np.append(begin, len(data) - skipped)
        if self.squeeze:
            while whole.endswith(self.space):
                whole = whole[: -len(self.space)]
            begin, end = begin[: len(whole) + 1], end[: len(whole)]
        return whole, begin + skipped, end + skipped

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The bytes and len(bytes) + 1 source offsets (the last is the end of what was read)."""
        return self.align(text)[:2]


class _Pairs:
    """Neighbours that merge: (left symbol, right symbol) to the piece they make, in an open-addressing table looked up in whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.mask = (1 << max(4, (8 * len(pairs)).bit_length())) - 1
        self.keys, self.made = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        made, slot = np.array(list(pairs.values()), np.int32), self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, which = np.unique(slot[free], return_index=True)
            self.keys[taken], self.made[taken] = keys[free[which]], made[free[which]]
            left = self.keys[slot] != keys
            keys, made, slot = keys[left], made[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return h.astype(np.int64) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces, -1 where nothing merges; -1 as a symbol has no neighbour."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where((there == keys) & (left >= 0) & (right >= 0), self.made[slot], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.made[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class _Numbers(dict):
    """chunk -> number; new ones wait in `new` until they are encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then the same from first[1] on, and so on."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Model:
    """Pieces of a model file: encoding to ids with source spans, decoding to text."""

    def __init__(self, blob: bytes) -> None:
        proto = model_pb2.ModelProto()
        proto.ParseFromString(blob)
        if proto.trainer_spec.model_type != 2:
            raise ValueError("a BPE model is needed")
        self.normalizer = Normalizer(proto.normalizer_spec)
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        kinds = range(len(self.pieces))
        if any(t in (USER_DEFINED, UNUSED) for t in self.types):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {self.pieces[i]: i for i in kinds if self.types[i] == NORMAL}
        self.rank, self.never = {p: -proto.pieces[i].score for p, i in self.ids.items()}, float("inf")
        self.unknown = next(i for i in kinds if self.types[i] == UNKNOWN)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in kinds if self.types[i] == BYTE}
        self.begin, self.end = (self.pieces.index(p) for p in (proto.trainer_spec.bos_piece or "<s>", proto.trainer_spec.eos_piece or "</s>"))
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.raw = [bytes((int(p[3:5], 16),)) if t == BYTE else p.encode() for p, t in zip(self.pieces, self.types, strict=True)]
        # No piece may join what stands on either side of a cut, so chunks encode on their own.
        longer = [p for p in self.ids if len(p) > 1]
        joint = sorted({c for p in longer for c in p} - {SPACE})
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer)
        letters = "".join(map(re.escape, joint))
        self.chunk = None if inside or not joint else re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|[^{letters}{SPACE}]", re.DOTALL)
        self._tables(longer)
        self._forget()

    def _tables(self, longer: list[str]) -> None:
        """Arrays for whole batches: symbols of characters, merging pairs, ranks, widths and decoded bytes of ids."""
        size = len(self.pieces)
        symbols = self.ids | {c: size + i for i, c in enumerate(sorted({c for p in longer for c in p} - self.ids.keys()))}
        self.symbol = np.full(0x110000, -1, np.int32)
        for text, i in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        cuts = ((p, p[:i], p[i:]) for p in longer for i in range(1, len(p)))
        self.pairs = _Pairs({(symbols[a], symbols[b]): self.ids[p] for p, a, b in cuts if a in symbols and b in symbols})
        levels = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        self.level = np.full(size + 1, NEVER, np.int32)  # the last is for -1
        for p, i in self.ids.items():
            self.level[i] = levels[self.rank[p]]
        self.width = np.array([len(r) for r in self.raw], np.int64)
        shown = [b"" if t == CONTROL else self.unknown_surface.encode() if t == UNKNOWN else r.replace(SPACE.encode(), b" ") for r, t in zip(self.raw, self.types, strict=True)]
        self.shown, self.shown_width = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown], np.int64)
        self.shown_first = np.cumsum(self.shown_width) - self.shown_width

    def _forget(self) -> None:
        """Start without known chunks."""
        self.known, self.known_chars = _Numbers(), 0
        self.known_ids, self.known_widths = np.empty(0, np.int32), np.empty(0, np.int32)
        self.known_first, self.known_count = np.empty(0, np.int64), np.empty(0, np.int64)

    def _merge(self, chunk: str) -> list[str]:
        """BPE of one chunk: symbols in a linked list, candidate pairs in a heap."""
        symbols, n = list(chunk), len(chunk)
        rank = self.rank
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank.get(pair := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (r, i, j, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != pair or following[i] != j:
                continue
            symbols[i], symbols[j] = pair, ""
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
            offer(before[i], i)
            offer(i, following[i])
        return [s for s in symbols if s]

    def _encode_chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        """ids and widths in normalised bytes of the pieces of one chunk; bytes of an unknown character are one piece each."""
        ids, widths = [], []
        for s in self._merge(chunk):
            if (i := self.ids.get(s)) is not None:
                ids.append(i)
                widths.append(len(s.encode("utf-8", "surrogatepass")))
            elif self.bytes:
                data = s.encode("utf-8", "surrogatepass")
                ids += [self.bytes[b] for b in data]
                widths += [1] * len(data)
            else:
                ids.append(self.unknown)
                widths.append(len(s.encode("utf-8", "surrogatepass")))
        return ids, widths

    def _merge_all(self, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of chunks of nearly one length at once: symbols of all chunks in order, and how many each has.

        points are the characters of all chunks. Row by row the best and leftmost pair merges,
        neighbours are linked by position, and only the two pairs that a merge changes are looked
        up again. The last column stands for what lies beyond a chunk.
        """
        n, size = len(length), int(length.max()) + 1
        place = np.arange(size)
        alive = place < length[:, None]
        symbol = np.full((n, size), -1, np.int32)
        symbol[alive] = self.symbol[points]
        after, before = np.tile((place + 1).astype(np.int16), (n, 1)), np.tile((place - 1).astype(np.int16), (n, 1))
        before[:, 0] = size - 1
        made = np.full((n, size), -1, np.int32)
        made[:, :-1] = self.pairs(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, size - 1)
        level = self.level[made]
        symbol, alive_, after, before, made = (a.ravel() for a in (symbol, alive, after, before, made))
        rows = np.arange(n)
        while len(rows):
            best = level[rows].argmin(axis=1)
            at = rows * size + best
            some = level.ravel()[at] < NEVER
            rows, at, best = rows[some], at[some], best[some]
            base = at - best
            gone = base + after[at]
            right, left = base + after[gone], base + before[at]
            symbol[at] = made[at]
            alive_[gone] = False
            level.ravel()[gone] = NEVER
            after[at], before[right] = after[gone], best
            both = self.pairs(np.concatenate([symbol[at], symbol[left]]), np.concatenate([symbol[right], symbol[at]]))
            made[at], made[left] = both[: len(at)], both[len(at) :]
            level.ravel()[at], level.ravel()[left] = self.level[both[: len(at)]], self.level[both[len(at) :]]
        return symbol[alive_], alive.sum(axis=1)

    def _learn(self) -> None:
        """Encode the new chunks: short ones of known characters together, the others one by one."""
        new = self.known.new
        if not new:
            return
        self.known_chars += sum(map(len, new))
        length = np.array([len(c) for c in new])
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(length) - length
        single = np.minimum.reduceat(self.symbol[points], first) < 0
        count, found = np.zeros(len(new), np.int64), []
        low = 0
        for top in BANDS:
            some = np.flatnonzero(~single & (length > low) & (length <= top))
            low = top
            if len(some):
                symbols, n = self._merge_all(points[_ragged(first[some], length[some])], length[some])
                bad = np.maximum.reduceat(symbols, np.cumsum(n) - n) >= len(self.pieces)
                single[some[bad]] = True
                good = np.repeat(~bad, n)
                count[some[~bad]] = n[~bad]
                found.append((some[~bad], symbols[good], self.width[symbols[good]]))
        for i in np.flatnonzero(single | (length > BANDS[-1])):
            ids, widths = self._encode_chunk(new[i])
            count[i] = len(ids)
            found.append((np.array([i]), np.array(ids, np.int32), np.array(widths)))
        at = np.cumsum(count) - count
        ids, widths = np.empty(count.sum(), np.int32), np.empty(count.sum(), np.int32)
        for some, i, w in found:
            to = _ragged(at[some], count[some])
            ids[to], widths[to] = i, w
        self.known_first = np.concatenate([self.known_first, at + len(self.known_ids)])
        self.known_count = np.concatenate([self.known_count, count])
        self.known_ids, self.known_widths = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_widths, widths])
        new.clear()

    def encode_all(self, texts: Sequence[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, bytes]]:
        """encode() of each text, in portions of about PORTION characters that share their work."""
        at = 0
        while at < len(texts):
            to, room = at, PORTION
            while to < len(texts) and room > 0:
                room -= len(texts[to])
                to += 1
            yield from self._portion(texts[at:to])
            at = to

    def _portion(self, texts: Sequence[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, bytes]]:
        if len(self.known) > KNOWN_CHUNKS or self.known_chars > KNOWN_CHARS:
            self._forget()
        aligned = [self.normalizer.align(t) for t in texts]
        number, chunks, numbers = self.known.__getitem__, [], []
        for whole, _, _ in aligned:
            text = whole.decode("utf-8", "surrogatepass")
            parts = self.chunk.findall(text) if self.chunk else [text] * bool(text)
            chunks.append(len(parts))
            numbers.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn()
        numbers = np.concatenate(numbers)
        count = self.known_count[numbers]
        take = _ragged(self.known_first[numbers], count)
        ids, widths = self.known_ids[take], self.known_widths[take]
        cut = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(chunks)])]
        ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        shown = self.shown[_ragged(self.shown_first[ids], self.shown_width[ids])]
        shown_ends = np.concatenate([[0], np.cumsum(self.shown_width[ids])])
        for (whole, begin, end), text, a, z in zip(aligned, texts, cut[:-1], cut[1:], strict=True):
            size = len(text.encode("utf-8", "surrogatepass"))
            stop = ends[a : z + 1] - ends[a]
            starts = begin[stop[:-1]]
            # a piece ends where the next one begins, or with the source of its last byte if that is shared
            stops = np.maximum(begin[stop[1:]], end[stop[1:] - 1])
            own = np.concatenate([[self.begin], ids[a:z], [self.end]])
            yield own.astype("<u4").tobytes(), np.concatenate([[0], starts, [size]]), np.concatenate([[0], stops, [size]]), self._shown(ids[a:z], shown[shown_ends[a] : shown_ends[z]])

    def _shown(self, ids: np.ndarray, shown: np.ndarray) -> bytes:
        """decode() of ids from the bytes that they show."""
        data = shown.tobytes()
        try:
            data.decode()
        except UnicodeDecodeError:  # byte pieces that are no character
            return self.decode(ids.tolist()).encode()
        return data[1:] if self.normalizer.dummy and len(ids) and self.pieces[ids[0]].startswith(SPACE) else data

    def encode(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray, bytes]:
        """ids (little-endian uint32) with begin and end, source byte starts and ends, decoded bytes.

        Begin and end ids and an added first space alone have empty spans; all bytes of one character's byte pieces, and all
        pieces of one replacement, share that character's source span.
        """
        return next(self.encode_all([text]))

    def decode_body(self, ids: list[int]) -> str:
        """Pieces to text without the removal of the first space; a byte that starts no whole character is U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.types[i] == BYTE:
                run += self.raw[i]
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i >= 0 and self.types[i] != CONTROL:
                out.append(self.unknown_surface if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        body = self.decode_body(ids)
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        if self.normalizer.dummy and first is not None and self.pieces[first].startswith(SPACE):
            body = body[1:]
        return body


def _utf8(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (4, 3, 2, 1):
            try:
                out.append(data[at : at + n].decode())
                if len(out[-1]) == 1:
                    at += len(out[-1].encode())
                    break
                out.pop()
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def _model(blob: bytes) -> Model:
    return Model(blob)


def encode(docs: DataFrame, model_file: str, text: str = "text", arrays: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens, ids_sha256, decoded_sha256, spans_sha256 to docs, with arrays also ids, starts, ends, decoded.

    ids are all ids with begin and end; starts and ends are source byte offsets of each id;
    spans_sha256 digests them as little-endian int64, all starts and then all ends.
    Null text counts as empty and has two ids; an empty table gives an empty table; columns
    with the names of new ones are replaced.
    """
    with open(model_file, "rb") as f:  # a bounded file, read by the driver
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("spans_sha256", T.StringType())]
    longs = T.ArrayType(T.LongType())
    new += [("ids", longs), ("starts", longs), ("ends", longs), ("decoded", T.StringType())] * arrays

    def make():
        model = _model(shared.value)

        def work(texts):
            made = list(model.encode_all(texts))
            out = [[len(m[0]) // 4 for m in made], [hashlib.sha256(m[0]).hexdigest() for m in made], [hashlib.sha256(m[3]).hexdigest() for m in made]]
            out.append([hashlib.sha256(np.concatenate(m[1:3]).astype("<i8").tobytes()).hexdigest() for m in made])
            if arrays:
                out += [[np.frombuffer(m[0], "<u4").astype(np.int64) for m in made], [m[1] for m in made], [m[2] for m in made], [m[3].decode() for m in made]]
            return out

        return work

    return map_rows(docs, [text_of(text)], new, make, keep)
