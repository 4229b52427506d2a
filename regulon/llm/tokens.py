"""Token ids of whole texts with the ``tokenizers`` library, piece by piece.

Encoding is by far the dearest step of the token operators. A text is cut where
the tokenizer's own splitting pattern always cuts, each distinct piece is encoded
once by the library, and its ids are looked up from then on. Pieces are:

* in texts of ASCII and Latin letters without apostrophes: runs of letters with
  the one space before them, and what lies between such runs;
* in all other texts: parts between single spaces that have no white space on
  either side.

Both patterns in use (byte-level BPE with letters, numbers, other and white
space as classes; lower-cased BPE with word ends) cut at those places whatever
surrounds them, so the ids equal those of the whole text. The tests compare them.

The strings of the vocabulary's added tokens (``<|endoftext|>``) get that token's id
wherever they stand, as in the library. It takes them out of a text before anything
else and encodes what lies between them on its own, and so does ``Encoder``.

The first kind is cut, hashed and looked up in vectorised steps over many texts. A
64-bit hash only finds the piece that may be meant: its bytes, kept beside its ids,
are compared before the ids are used, and a text with a piece that differs is encoded
whole by the library. The second kind goes through a dictionary.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .hashing import Prefix

PART_BYTES = 1 << 20  # text handled in one step, and where longer texts are cut
MEMO_PIECES = 1_000_000  # about 40 bytes each
MEMO_BYTES = 32 << 20  # of the pieces themselves
TABLE_BITS = 21
JOINED = 100  # new words in one call of the library
WORD_BYTES = 64  # pieces are compared by words of 8 bytes as far as this
MEMO_OTHERS = 100_000
CUT = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")

_ALL = np.arange(256)
LETTER = (_ALL >= 0x80) | ((_ALL | 32) >= 97) & ((_ALL | 32) <= 122)
SPACE = np.isin(_ALL, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
# bytes that occur only outside ASCII and U+00C0 to U+024F, and the apostrophe (contractions)
OTHER = (_ALL == 0x27) | (_ALL == 0xC2) | (_ALL >= 0xCA)
# two-byte characters of that range that are no letters or change when lower-cased: lead, first, last
BETWEEN = [(0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7), (0xC4, 0xB0, 0xB0), (0xC9, 0x90, 0xBF)]


LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one little-endian number; the last 7 places have none."""
    return np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))


def spaced_pieces(text: str) -> list[str]:
    """Cut before each single space that has non-white-space on both sides."""
    parts = text.split(" ")
    out = [[parts[0]]]
    for before, part in zip(parts, parts[1:]):
        if before and part and not before[-1].isspace() and not part[0].isspace():
            out.append([" ", part])
        else:
            out[-1] += [" ", part]
    return ["".join(x) for x in out]


def otherwise(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts of a joined array hold anything but Latin letters and plain signs, or
    white space of two or more before a letter (it needs the letter to be split as there)."""
    odd = OTHER[data]
    for lead, low, high in BETWEEN:
        at = np.flatnonzero(data[:-1] == lead)
        odd[at[(data[at + 1] >= low) & (data[at + 1] <= high)]] = True
    if len(data) > 2:
        space = SPACE[data]
        at = np.flatnonzero(space[:-2] & space[1:-1])
        odd[at[(data[at + 1] != 32) & LETTER[data[at + 2]]]] = True
    out = np.zeros(len(starts), bool)
    out[np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1] = True
    return out


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts of the first kind start, and the marks between texts.

    ``starts``: of the texts, each but the last with a zero byte after it.
    """
    letter = LETTER[data]
    first = np.ones(len(data), bool)
    first[1:] = letter[1:] != letter[:-1]
    joined = (data[:-1] == 32) & letter[1:]  # a space belongs to the letters after it
    first[1:] &= ~joined
    first[:-1] |= joined
    first[starts] = True
    first[starts[1:] - 1] = True
    return np.flatnonzero(first)


class Encoder:
    """Texts -> ids as little-endian unsigned 32-bit integers in bytes.

    The memos are dropped when they are full, which bounds a worker's memory and
    changes no result.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {content: k.to_bytes(4, "little") for content, k in added.items()}
        longest = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        self.between = re.compile(f"({longest})" if added else "(?!)")
        self.others: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.table = np.zeros(1 << TABLE_BITS, np.int32)  # number of a piece by the first bits of its hash
        self.keys = np.empty(0, np.uint64)  # hash, ascending
        self.slots = np.empty(0, np.int64)  # number of the piece by key
        self.raw = np.zeros(8, np.uint8)  # the pieces' bytes one after the other, 8 zeros last
        self.cuts = np.zeros(1, np.int64)  # end of its bytes by number + 1
        self.ends = np.zeros(1, np.int64)  # end of its ids by number + 1
        self.ids = np.empty(0, np.uint32)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        """Without pieces: one call of the library for the whole text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def other(self, text: str) -> bytes:
        """A text of the second kind."""
        cut = spaced_pieces(text)
        new = list({p for p in cut if p not in self.others})
        if len(self.others) + len(new) > MEMO_OTHERS:
            self.others.clear()
            new = list(set(cut))
        for p, ids in zip(new, self.library(new)):
            self.others[p] = np.array(ids, dtype="<u4").tobytes()
        return b"".join([self.others[p] for p in cut])

    def encoded(self, pieces: list[str], n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids). The first ``n_words`` are runs of letters with the space before
        them: many go to the library as one text, which it cuts at the spaces; the others go one by one."""
        sizes, flat = [], []
        for k in range(0, n_words, JOINED):
            part = pieces[k : min(k + JOINED, n_words)]
            found = self.tokenizer.encode("".join(part), add_special_tokens=False)
            sizes.append(np.bincount(found.word_ids, minlength=len(part)))
            flat.append(found.ids)
        others = self.library(pieces[n_words:])
        sizes.append([len(x) for x in others])
        flat += others
        return np.concatenate(sizes).astype(np.int64), np.fromiter((x for one in flat for x in one), np.uint32)

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece, whether its bytes are those of that number); new ones are encoded first."""
        size = end - start
        hashes = Prefix(data).of(start, end)
        if len(self.keys) > MEMO_PIECES or len(self.raw) > MEMO_BYTES:
            self.forget()
        place = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        slot = self.table[place].astype(np.int64)  # the piece last met with these first bits
        known = self.same(data, start, size, slot)
        rest = np.flatnonzero(~known)
        if len(rest):
            slot[rest] = self.looked_up(data, start[rest], end[rest], hashes[rest])
            self.table[place[rest]] = slot[rest]
            known[rest] = self.same(data, start[rest], size[rest], slot[rest])
        return slot, known

    def looked_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number under each piece's hash; pieces with a hash of their own are encoded first."""
        keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, keys)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            a, b, raw = start[at[new]], end[at[new]], data.tobytes()
            word = (data[a] == 32) & LETTER[data[b - 1]]
            order = np.argsort(~word, kind="stable")  # words first
            pieces = [raw[x:y] for x, y in zip(a[order].tolist(), b[order].tolist())]
            sizes, flat = self.encoded([x.decode() for x in pieces], int(word.sum()))
            number = np.empty(len(new), np.int64)
            number[order] = len(self.keys) + np.arange(len(new))
            self.raw = np.concatenate((self.raw[:-8], np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)))
            self.cuts = np.concatenate((self.cuts, self.cuts[-1] + np.cumsum((b - a)[order])))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, flat))
            self.keys = np.insert(self.keys, where[new], keys[new])
            self.slots = np.insert(self.slots, where[new], number)
        return self.slots[np.searchsorted(self.keys, keys)][inverse]

    def same(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each piece's bytes equal the kept bytes of its number."""
        if not len(self.keys):
            return np.zeros(len(slot), bool)
        first = self.cuts[slot]
        out = size == self.cuts[slot + 1] - first
        mine, kept = words8(np.concatenate((data, np.zeros(8, np.uint8)))), words8(self.raw)
        at, left = np.flatnonzero(out), size[out]
        for k in range(0, WORD_BYTES, 8):
            differs = (mine[start[at] + k] ^ kept[first[at] + k]) & LOW_BYTES[np.minimum(left, 8)]
            out[at[differs != 0]] = False
            more = (differs == 0) & (left > 8)
            at, left = at[more], left[more] - 8
        for i in at.tolist():
            a, b, n = int(start[i]), int(first[i]), int(size[i])
            out[i] = np.array_equal(data[a : a + n], self.raw[b : b + n])
        return out

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """Texts of the first kind, not empty."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        data = np.frombuffer(b"\0".join(texts), np.uint8)
        start = piece_starts(data, starts)
        end = np.concatenate((start[1:], [len(data)]))
        mark = np.searchsorted(start, starts[1:] - 1)
        start, end = np.delete(start, mark), np.delete(end, mark)
        slot, same = self.numbers(data, start, end)
        lens = self.ends[slot + 1] - self.ends[slot]
        ends = np.cumsum(lens)
        out = self.ids[np.repeat(self.ends[slot] - ends + lens, lens) + np.arange(int(ends[-1]))].astype("<u4").tobytes()
        cuts = [*(4 * (ends - lens)[np.searchsorted(start, starts)]).tolist(), len(out)]
        found = [out[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(np.searchsorted(starts, start[~same], side="right") - 1).tolist():
            found[k] = self.whole(texts[k].decode())
        return found

    def step(self, texts: list[bytes]) -> list[bytes]:
        """Some texts of either kind, not empty."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        odd = otherwise(np.frombuffer(b"\0".join(texts), np.uint8), np.cumsum(sizes + 1) - sizes - 1).tolist()
        fast = iter(self.plain([t for t, o in zip(texts, odd) if not o]) if not all(odd) else ())
        return [self.other(t.decode()) if o else next(fast) for t, o in zip(texts, odd)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[bytes] = []
        owner: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            for (k, place), ids in zip(owner, self.step(held)):
                out[k][place] = ids

        for k, text in enumerate(texts):
            for run in self.between.split(text) if text else ():
                if run in self.added:
                    out[k].append(self.added[run])
                    continue
                for part in parts(run) if run else ():
                    held.append(part), owner.append((k, len(out[k])))
                    out[k].append(b"")
                    size += len(part)
                    if size >= PART_BYTES:
                        flush()
                        held, owner, size = [], [], 0
        if held:
            flush()
        return [b"".join(x) for x in out]


def parts(text: str) -> list[bytes]:
    """A very long text, cut between words."""
    out, at = [], 0
    while len(text) - at > PART_BYTES and (m := CUT.search(text, at + PART_BYTES)):
        out.append(text[at : m.start()].encode())
        at = m.start()
    return [*out, text[at:].encode()]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary, resolved where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)
