"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding: a small state machine cuts the text into pieces. Inside a piece, bytes enter a buffer
and merges run on it; a token is final as soon as at least `lookahead` bytes follow it in the
buffer, because no merge that starts further right can reach it any more. The sufficient lookahead
is computed from the merge list alone. Final tokens are emitted and their bytes forgotten, so a
piece of any length needs constant memory.

Texts are read in runs of bounded size. No piece reaches over a space that stands between two other
characters, so a run is cut there into words with their space, and words of plain letters, digits and
signs into pieces where these change; the state machine is left with the others. Every different piece
of a run is merged once, and what it emitted is put in place wherever the piece occurs. Pieces shorter
than the lookahead end before any of their tokens is final: many of them are merged side by side, one
merge of each at a time. The output for short pieces is remembered between runs.

Decoding: token bytes run through an incremental byte-to-text state machine, which holds back at
most the bytes of one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# bytes of texts encoded together, characters of a longer text taken at a time, bytes of a piece that
# enter at a time, tokens decoded at a time
RUN, CHUNK, STEP, DECODED = 1 << 22, 1 << 16, 128, 1 << 12
# short pieces whose output is remembered, in each of two generations; what counts as short; up to how
# many bytes pieces are merged side by side
WORDS, SHORT, SIDE_BY_SIDE = 1 << 17, 64, 32
# tokens and ranks are packed into integers; NONE is above any rank
BITS, MASK, NONE = 24, (1 << 24) - 1, 1 << 60
# an odd number near the golden section of 2 ** 64 spreads keys over a table
SPREAD = 0x9E3779B97F4A7C15

# Fixed value: the pattern that cuts a text into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Bytes beside a space that may belong to other white space: such a space is no place to cut. White
# space beyond ASCII starts with one of four bytes, and so do some other characters.
WHITE = np.zeros(256, dtype=bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True
WIDE = np.zeros(256, dtype=bool)
WIDE[[0xE1, 0xE2, 0xE3]] = True


# kinds of bytes, as the pattern tells them apart; ODD ones leave their word to the pattern itself
SIGN, LETTER, DIGIT, BREAK, SPACE, ODD = range(6)
KIND = np.full(256, SIGN, dtype=np.uint8)
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
KIND[ord("0") : ord("9") + 1], KIND[9:14], KIND[28:32], KIND[128:], KIND[ord("'")], KIND[32] = DIGIT, BREAK, ODD, ODD, ODD, SPACE
# letters of two bytes that begin with 0xC3: all but the signs of multiplication and division
LATIN = np.zeros(256, dtype=bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves,
    the others, in order, for 256 and up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lone_spaces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of spaces between two characters that are no white space, in texts laid end to end."""
    at = np.flatnonzero(data == 32)
    edge = np.zeros(len(data) + 2, dtype=bool)
    edge[bounds] = True
    at = at[~edge[at] & ~edge[at + 1]]
    framed = np.full(len(data) + 4, 32, dtype=np.uint8)
    framed[3:-1] = data
    before, after = framed[at + 2], framed[at + 4]
    known = WHITE[before] | WHITE[after] | WIDE[framed[at]] | WIDE[after] | (after == 0xC2) | ((framed[at + 1] == 0xC2) & ((before == 0x85) | (before == 0xA0)))
    return at[~known]


class Transducer:
    """Merges, vocabulary and special tokens of a tokenizer file, read once in a worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        letters = byte_letters()
        raw = {name: bytes(letters[c] for c in name) for name in spec["model"]["vocab"] if all(c in letters for c in name)}
        self.bytes_of = {i: raw[name] for name, i in spec["model"]["vocab"].items() if name in raw}
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # left and right token -> rank and merged token, both packed in one integer
        self.merges = {ids[a] << BITS | ids[b]: rank << BITS | ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.start = [0] * 256
        for letter, byte in letters.items():
            self.start[byte] = ids[letter]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.bytes_of[i] = content
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile(b"|".join(map(regex.escape, longest))) if longest else None
        self.special_text = regex.compile("|".join(regex.escape(s.decode()) for s in longest)) if longest else None
        self.pieces = regex.compile(PIECES)
        self.lookahead = self._lookahead()
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.slots = self._slots()

    def _slots(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The merges as an open table for arrays: keys, values, shift of the hash and longest probe."""
        bits = max(4, (4 * len(self.merges)).bit_length())
        keys, values, longest = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int64), 1
        for pair, ranked in self.merges.items():
            at, probe = (pair * SPREAD & (1 << 64) - 1) >> (64 - bits), 1
            while keys[at] != -1:
                at, probe = (at + 1) & ((1 << bits) - 1), probe + 1
            keys[at], values[at], longest = pair, ranked, max(longest, probe)
        return keys, values, 64 - bits, longest

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged token of each pair, NONE where there is no merge."""
        keys, values, shift, longest = self.slots
        pair = left.astype(np.int64) << BITS | right
        at = ((pair.astype(np.uint64) * np.uint64(SPREAD)) >> np.uint64(shift)).astype(np.int64)
        found = np.where(keys[at] == pair, values[at], NONE)
        open_ = np.flatnonzero((keys[at] != pair) & (keys[at] != -1))
        for _ in range(longest - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(keys) - 1)
            hit = keys[at[open_]] == pair[open_]
            found[open_[hit]] = values[at[open_[hit]]]
            open_ = open_[~hit & (keys[at[open_]] != -1)]
        return found

    def merge_all(self, raw: list[bytes]) -> list[bytes]:
        """The ids of pieces of one length, merged side by side: each step makes the merge of the lowest
        rank, the leftmost of equal ones, in every piece that has one."""
        n, size = len(raw), len(raw[0])
        out: list[bytes] = [b""] * n
        tokens = np.array(self.start, dtype=np.int64)[np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(n, size)]
        rows = np.arange(n)
        ranks = self._ranked(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, size - 1)
        while True:
            at = ranks.argmin(axis=1) if size > 1 else np.zeros(len(rows), dtype=np.int64)
            best = ranks[np.arange(len(rows)), at] if size > 1 else np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                whole, step = tokens[over].astype("<u4").tobytes(), 4 * size
                for i, row in enumerate(rows[over].tolist()):
                    out[row] = whole[i * step : (i + 1) * step]
                going = ~over
                rows, tokens, ranks, at, best = rows[going], tokens[going], ranks[going], at[going], best[going]
            if not len(rows):
                return out
            every, made = np.arange(len(rows)), best & MASK
            tokens[every, at] = made
            later = np.arange(size - 1)
            tokens, size = np.take_along_axis(tokens, later + (later > at[:, None]), axis=1), size - 1
            later = np.arange(size - 1)
            ranks = np.take_along_axis(ranks, later + (later >= at[:, None]), axis=1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 1)
            ranks[left, at[left] - 1] = self._ranked(tokens[left, at[left] - 1], made[left])
            ranks[right, at[right]] = self._ranked(made[right], tokens[right, at[right] + 1])

    def _lookahead(self) -> int:
        """Bytes after a token that suffice to know that it is final.

        `reach[t]` bounds how many bytes behind token t can still change what becomes of it by the
        merges seen so far. A merge (a, b) reaches over b and over whatever can take b's place,
        which earlier merges decide; what it makes inherits the reach of its right part. Merges
        in order of rank make this one pass.
        """
        reach = {i: 0 for i in self.bytes_of}
        for pair, ranked in sorted(self.merges.items(), key=lambda m: m[1]):
            a, b, made = pair >> BITS, pair & MASK, ranked & MASK
            over = len(self.bytes_of[b]) + reach[b]
            reach[made] = max(reach[made], reach[b])
            reach[a] = max(reach[a], over)
        return max(reach.values(), default=0)

    def _merge(self, raw: bytes) -> list[int]:
        """Always the merge of the lowest rank, the leftmost of equal ones."""
        tokens, merge = [self.start[b] for b in raw], self.merges.get
        ranked = [merge(a << BITS | b, NONE) for a, b in zip(tokens, tokens[1:])]
        while ranked and (best := min(ranked)) != NONE:
            at = ranked.index(best)
            tokens[at : at + 2] = [made := best & MASK]
            del ranked[at]
            if at:
                ranked[at - 1] = merge(tokens[at - 1] << BITS | made, NONE)
            if at < len(ranked):
                ranked[at] = merge(made << BITS | tokens[at + 1], NONE)
        return tokens

    def encode_piece(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """The tokens of one piece that arrives in parts, as soon as they are final; at most the
        lookahead, one part and one token are held."""
        held = b""
        for part in parts:
            held += part
            if len(held) <= self.lookahead + STEP // 2:
                continue
            tokens, final, left = self._merge(held), [], len(held)
            for token in tokens:
                left -= len(self.bytes_of[token])
                if left < self.lookahead:
                    break
                final.append(token)
            if final:
                held = held[sum(len(self.bytes_of[t]) for t in final) :]
                yield final
        if held:
            yield self._merge(held)

    def _stream(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """The ids of text[at:end], piece by piece, in constant memory."""
        for m in self.pieces.finditer(text, at, end):
            raw = m.group().encode("utf-8", "surrogatepass")
            for tokens in self.encode_piece(raw[i : i + STEP] for i in range(0, len(raw), STEP)):
                yield array("I", tokens).tobytes()

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces, as 32-bit integers. Of those remembered, the older half goes
        when the recent one is full, and what is met again moves up."""
        recent, older, by_size, out = self.recent, self.older, {}, []
        for i, raw in enumerate(pieces):
            ids = recent.get(raw)
            if ids is None:
                ids = older.get(raw)
                if ids is not None:
                    recent[raw] = ids
                else:
                    by_size.setdefault(len(raw), []).append(i)
            out.append(ids)
        for size, places in by_size.items():
            raw = [pieces[i] for i in places]
            if size <= SIDE_BY_SIDE:
                made = self.merge_all(raw)
            else:
                made = [b"".join(array("I", tokens).tobytes() for tokens in self.encode_piece(r[i : i + STEP] for i in range(0, size, STEP))) for r in raw]
            for i, r, ids in zip(places, raw, made):
                out[i] = ids = self.special[r].to_bytes(4, "little") if r in self.special else ids
                if size <= SHORT:
                    recent[r] = ids
        if len(recent) > WORDS:
            self.recent, self.older = {}, recent
        return out

    def _piece_starts(self, data: np.ndarray, cuts: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where pieces begin, in words that begin at `cuts`; those of `whole` are one piece."""
        kind = KIND[data]
        latin = np.flatnonzero((data[:-1] == 0xC3) & LATIN[data[1:]])
        kind[latin] = kind[latin + 1] = LETTER
        leading = cuts[data[cuts] == 32]
        white = (kind == BREAK) | (kind == SPACE)
        # the pattern decides words with white space next to white space, or with a space inside
        odd = (kind == ODD) | (kind == SPACE)
        odd[leading] = False
        odd[1:] |= white[1:] & white[:-1]
        change = np.zeros(len(data), dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        after = leading + 1
        change[after[after < len(data)]] = False
        by_pattern = np.add.reduceat(odd, cuts, dtype=np.int64) > 0
        by_pattern[np.searchsorted(cuts, whole)] = False
        sizes = np.diff(np.append(cuts, len(data)))
        plain = ~by_pattern
        plain[np.searchsorted(cuts, whole)] = False
        change &= np.repeat(plain, sizes)
        change[cuts] = True
        ends = cuts + sizes
        for begin, end in zip(cuts[by_pattern].tolist(), ends[by_pattern].tolist()):
            for m in self.pieces.finditer(data[begin:end].tobytes().decode("utf-8", "surrogatepass")):
                change[begin] = True
                begin += len(m.group().encode("utf-8", "surrogatepass"))
        return np.flatnonzero(change)

    def encode_run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts data[bounds[i]:bounds[i + 1]], end to end, and where each begins."""
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(bounds), dtype=np.int64)
        begins, whole = np.zeros(len(data) + 1, dtype=bool), np.zeros(0, dtype=np.int64)
        begins[lone_spaces(data, bounds)] = begins[bounds] = True
        if self.specials is not None and (spans := [m.span() for m in self.specials.finditer(data)]):
            # a special token that lies in two texts is none
            first, last = np.array(spans).T
            inside = np.searchsorted(bounds, first, side="right") == np.searchsorted(bounds, last - 1, side="right")
            whole = first[inside]
            begins[whole] = begins[last[inside]] = True
        starts = self._piece_starts(data, np.flatnonzero(begins[:-1]), whole)
        offsets = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which, made = pieces.indices.to_numpy(), self._known(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat, at = np.frombuffer(b"".join(made), dtype="<u4"), np.cumsum(sizes) - sizes
        taken = sizes[which]
        ends = np.cumsum(taken)
        ids = flat[np.arange(taken.sum()) + np.repeat(at[which] - (ends - taken), taken)]
        return ids, np.append(0, ends)[np.searchsorted(starts, bounds)]

    @staticmethod
    def _cut(text: str, at: int) -> int:
        """The end of the text, or a lone space some CHUNK characters on."""
        end = at + CHUNK
        while end < len(text):
            end = text.find(" ", end)
            if end < 0:
                return len(text)
            if not text[end - 1].isspace() and end + 1 < len(text) and not text[end + 1].isspace():
                return end
            end += 1
        return len(text)

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, in parts, without holding them."""
        at = 0
        while at < len(text):
            end = self._cut(text, at)
            if end - at <= 2 * CHUNK:
                raw = np.frombuffer(text[at:end].encode("utf-8", "surrogatepass"), dtype=np.uint8)
                yield self.encode_run(raw, np.array([0, len(raw)]))[0].tobytes()
            else:
                for m in self.special_text.finditer(text, at, end) if self.special_text else ():
                    yield from self._stream(text, at, m.start())
                    yield self.special[m.group().encode()].to_bytes(4, "little")
                    at = m.end()
                yield from self._stream(text, at, end)
            at = end

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, where each text's ids begin and the last one's end) for
        runs of texts; null counts as empty. A text longer than a run is one on its own."""
        held = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
        data, at = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8), 0
        while at < len(held):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN, side="right")) - 1)
            own = data[bounds[at] : bounds[end]]
            if len(own) <= RUN:
                yield at, *self.encode_run(own, bounds[at : end + 1] - bounds[at])
            else:
                ids = np.frombuffer(b"".join(self.encode(own.tobytes().decode("utf-8", "surrogatepass"))), dtype="<u4")
                yield at, ids, np.array([0, len(ids)])
            at = end

    def decode(self, parts: Iterable[bytes]) -> Iterator[str]:
        """The text of ids that come as 32-bit integers, in parts."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            ids = np.frombuffer(part, dtype="<u4").tolist()
            for at in range(0, len(ids), DECODED):
                yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids[at : at + DECODED])))
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def round_trip_column(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """(n_tokens, ids_sha256, decoded_sha256) of each text."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pa.Array) -> pa.Array:
        machine, sizes, hashes, backs = transducer(path), [], [], []
        for _, ids, starts in machine.encode_all(texts):
            raw = memoryview(ids.tobytes())
            for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own, of_text = raw[4 * begin : 4 * end], hashlib.sha256()
                for decoded in machine.decode([own]):
                    of_text.update(decoded.encode("utf-8", "surrogatepass"))
                sizes.append(end - begin)
                hashes.append(hashlib.sha256(own).hexdigest())
                backs.append(of_text.hexdigest())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(backs, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encoded_column(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """The ids of each text."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32))) for _, ids, starts in transducer(path).encode_all(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run(text)


def decoded_column(ids: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """The text of each array of ids; null for null."""

    @F.arrow_udf("string")
    def run(arrays: pa.Array) -> pa.Array:
        machine = transducer(path)
        return pa.array([None if a is None else "".join(machine.decode([np.array(a, dtype="<u4").tobytes()])) for a in arrays.to_pylist()], pa.string())

    return run(ids)


def round_trip(docs: DataFrame, text: str = "text", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """All columns of `docs` but `text`, plus n_tokens, ids_sha256 and decoded_sha256. A null text
    counts as empty and has no tokens; columns of these names give way; all rows stay."""
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    rest = [c for c in docs.columns if c not in (*added, text)]
    return docs.select(*rest, round_trip_column(F.col(text), path).alias("_r")).select(*rest, "_r.*")
