"""Tokenizer calls on distinct units of a text instead of on the whole text.

Byte-level: its pre-tokenizer starts a new piece at each of these places, whatever stands around them,
so a text's tokens are the tokens of its units in order: before a blank that precedes a non-blank;
between an ASCII letter and an ASCII byte that is none; between a line break that stands alone and an
ASCII letter. Sentence-piece: its vocabulary holds no piece with an inner blank mark, so a text is cut at
its blanks. Each distinct unit is encoded by the library once and kept in a bounded table of the worker.
Whole texts are used; a text with a special string goes to the library as it is.
"""

from __future__ import annotations

import os

import numpy as np

from trendspark.llm.common import mix, powers, prefix_hash

MAX_UNITS = 400_000
#: byte-level units kept: numbers and bytes of their strings (the table is in arrays, about 60 bytes a unit)
KEPT_UNITS, KEPT_BYTES = 700_000, 1 << 25
#: bytes of texts handled at once
BLOCK = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = ~_LETTER  # ASCII, not a letter
_MARK[128:] = False
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: surely not the first byte of white space (that begins with C2, E1, E2 or E3 outside ASCII)
_SOLID = ~_WHITE
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def unit_starts(b: np.ndarray) -> np.ndarray:
    """Flags of the bytes before which a unit begins."""
    at = np.zeros(len(b), bool)
    letter = _LETTER[b]
    at[1:] = letter[:-1] & _MARK[b[1:]]
    at[:-1] |= (b[:-1] == 32) & _SOLID[b[1:]]
    at[2:] |= letter[2:] & (b[1:-1] == 10) & _SOLID[b[:-2]]
    return at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + lengths[i] - 1`` for each i, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Rows:
    """Rows of varying length in one array that grows by doubling."""

    def __init__(self, kind: str):
        self.data, self.at, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        lo, n = int(self.at[self.n]), self.n + len(lengths)
        while len(self.at) <= n:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.data) < lo + len(flat):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[lo: lo + len(flat)] = flat
        self.at[self.n + 1: n + 1] = lo + np.cumsum(lengths)
        self.n = n

    def lengths(self, which: np.ndarray) -> np.ndarray:
        return self.at[which + 1] - self.at[which]

    def take(self, which: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.at[which], lengths)]


class ByteBpe:
    """ids of whole texts by the tokenizers library (special strings as its default).

    A block of texts is cut, and its units are looked up by hash, with array operations. What the table
    says is put together and compared with the block byte by byte, so ids don't rest on the hash.
    """

    #: units kept, where fewer than ``KEPT_UNITS`` are wanted
    most_units: int | None = None

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        vocab = self.tk.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # how the library writes a blank
        self._clear()

    def _clear(self) -> None:
        self.strings, self.ids = Rows("u1"), Rows("<u4")
        self._slots(16)

    def _slots(self, bits: int) -> None:
        self.shift, self.keys, self.rows = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys, -1 for unknown ones. The next slots are searched while a slot holds another key."""
        slot = (keys >> self.shift).astype(np.int64)
        found = self.rows[slot]
        todo = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.rows)
            at = slot[todo]
            found[todo] = self.rows[at]
            todo = todo[(self.rows[at] >= 0) & (self.keys[at] != keys[todo])]
        return found

    def _insert(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct unknown keys; of those that want one free slot the last has it, the others go on."""
        if 2 * (self.strings.n + len(keys)) > len(self.rows):
            old = self.rows >= 0
            keys, rows = np.concatenate([self.keys[old], keys]), np.concatenate([self.rows[old], rows])
            self._slots(max(16, (3 * len(keys)).bit_length()))
        slot = (keys >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.rows[slot[todo]] < 0]
            self.rows[slot[free]] = rows[free]
            mine = free[self.rows[slot[free]] == rows[free]]
            self.keys[slot[mine]] = keys[mine]
            todo = np.setdiff1d(todo, mine, assume_unique=True)
            slot[todo] = (slot[todo] + 1) % len(self.rows)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of units and how many each has. Units whose only blank is their first byte, before a non-blank, go
        to the library as one text: a token that begins with a blank is where the next unit begins."""
        starts = np.cumsum(n) - n
        plain = (n > 1) & (np.add.reduceat(flat == 32, starts) == 1) & (flat[starts] == 32)
        plain[plain] = _SOLID[flat[starts[plain] + 1]]
        ids, many = [np.zeros(0, "<u4")], np.zeros(len(n), np.int64)
        if plain.any():
            text = flat[ragged(starts[plain], n[plain])].tobytes().decode("utf-8")
            ids.append(np.array(self.tk.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
            many[plain] = np.diff(np.flatnonzero(self.begins[ids[-1]]), append=len(ids[-1]))
        rest = np.flatnonzero(~plain)
        raw = flat.tobytes()
        for i, e in zip(rest.tolist(), self.tk.encode_batch_fast(
                [raw[i:j].decode("utf-8") for i, j in zip(starts[rest].tolist(), (starts + n)[rest].tolist())], add_special_tokens=False)):
            ids.append(np.array(e.ids, "<u4"))
            many[i] = len(ids[-1])
        order = np.concatenate([np.flatnonzero(plain), rest])
        at = np.zeros(len(n), np.int64)
        at[order] = np.cumsum(many[order]) - many[order]
        return np.concatenate(ids)[ragged(at, many)], many

    def _block(self, texts: list[str], raws: list[bytes]) -> list[bytes]:
        data = b"\n".join(raws) + b"\n"  # each text and a line break of its own unit
        b = np.frombuffer(data, np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raws]) - 1
        at = unit_starts(b)
        at[0] = True
        at[stops] = True
        at[stops[:-1] + 1] = True
        s = np.flatnonzero(at)
        n = np.diff(s, append=len(b))
        p = prefix_hash(b)
        keys = mix((p[s + n] - p[s]) * powers(len(b) + 1)[1][s] + n.astype(np.uint64))
        rows = self._find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            k, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            fresh = self.strings.n + np.arange(len(k))
            self._insert(k, fresh)
            one = new[first]
            flat = b[ragged(s[one], n[one])]
            self.strings.add(flat, n[one])
            self.ids.add(*self._encode_units(flat, n[one]))
            rows[new] = fresh[back]
        if not np.array_equal(self.strings.lengths(rows), n) or not np.array_equal(self.strings.take(rows, n), b):
            return self._whole(texts)  # two units of one hash
        many = self.ids.lengths(rows)
        raw = self.ids.take(rows, many).tobytes()
        ends = np.append(0, np.cumsum(many) * 4)
        last = np.searchsorted(s, stops)
        heads = np.append(0, last[:-1] + 1)
        return [raw[i:j] for i, j in zip(ends[heads].tolist(), ends[last].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = ids
        gone, some, raws, size = set(odd), [], [], 0
        for i, t in enumerate(texts):
            if i not in gone:
                some.append(i)
                raws.append(t.encode("utf-8"))
                size += len(raws[-1]) + 1
            if some and (size >= BLOCK or i == len(texts) - 1):
                if self.strings.n > min(KEPT_UNITS, self.most_units or KEPT_UNITS) or self.strings.at[self.strings.n] > KEPT_BYTES:
                    self._clear()
                for j, ids in zip(some, self._block([texts[j] for j in some], raws)):
                    out[j] = ids
                some, raws, size = [], [], 0
        return out


class PieceCounter:
    """Numbers of tokens of whole texts by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            # blanks in a row, at an end, or a literal blank mark: the whole text goes to the library
            if not t or t[0] == " " or t[-1] == " " or "  " in t or "▁" in t:
                out[i] = len(self.sp.encode(t))
            else:
                plain.append((i, t.split(" ")))
        known = self.known
        new = list({p for _, ps in plain for p in ps if p not in known})
        if len(known) + len(new) > MAX_UNITS:
            known.clear()
            new = list({p for _, ps in plain for p in ps})
        known.update(zip(new, map(len, self.sp.encode(new, num_threads=1))))
        get = known.__getitem__
        for i, ps in plain:
            out[i] = sum(map(get, ps))
        return out
