"""Fast exact use of a tokenizer file: each distinct word is merged once, all new words of a chunk together.

Texts of printable ASCII, line feeds and Latin letters (U+00C0 to U+017F) are cut into words by byte
classes, as the two known kinds of pre-tokenizer cut them, and every word is looked up by a 128-bit
name. Words not met before are merged side by side: a row a word, and in each step every row's
leftmost pair of least rank, which is the order in which the library merges. Other texts go through
the library's own normaliser and pre-tokenizer, piece by piece; texts that hold the string of an
added token (``<|endoftext|>``), and tokenizers of another kind, through the library as a whole. So the
ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, added tokens included.

The tables live as long as the Python worker and begin anew when they hold ``MOST_WORDS`` words.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

from ._words import CHUNK, U, mix

MOST_WORDS, MOST_PIECES = 400_000, 50_000
#: Bytes of a word up to which words are named and merged side by side.
LONG = 64
#: White space other than space and line feed, for the pre-tokenizer or for Python.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Two marks beside each other, which a pre-tokenizer may keep together, or an underscore, which Python takes for a letter.
_RUN = re.compile(r"(?:[^\w\s]|[\x1c-\x1f]){2}|_")
#: Letters that a normaliser may take apart into a letter and a mark.
_APART = re.compile("[^\x00-\u024f]|\u0130")
#: Bytes of texts that are not cut by classes: other controls, and letters outside U+00C0 to U+017F, with the two signs there and U+0130.
_UNUSUAL = re.compile(rb"[^\n -~\x80-\xbf\xc3-\xc5]|\xc3[\x97\xb7]|\xc4\xb0")
_GAP = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_NONE = np.iinfo(np.int32).max
#: A word of so many bytes, as a number: its bits.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
LETTER, DIGIT, MARK, BLANK, OTHER = range(5)
#: The class of each byte of a text that is cut by classes; OTHER: it is not.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[[0x20, 0x0A]] = BLANK
CLASS[np.r_[0x30:0x3A]] = DIGIT
CLASS[np.r_[0x41:0x5B, 0x61:0x7B, 0x80:0xC0, 0xC3:0xC6]] = LETTER


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in prints)}
    return [others.get(b, chr(b)) for b in range(256)]


class Merges:
    """The merge rules of a byte-pair vocabulary, applied to many words at once."""

    def __init__(self, model: dict):
        vocab, suffix, signs = model["vocab"], model.get("end_of_word_suffix") or "", byte_symbols()
        self.inner = np.array([vocab[c] for c in signs], np.int32)
        self.final = np.array([vocab[c + suffix] for c in signs], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        # A table of four times the rules, probed step by step; rules come in by rank, so that a rule given twice keeps its last.
        self.bits = int(4 * len(keys)).bit_length()
        self.key, self.rank, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32), 1
        slot, live = self.slot(keys), np.arange(len(keys))
        last = np.zeros(len(keys), bool)
        last[len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]] = True
        live = live[last]
        while len(live):
            free = self.key[slot[live]] == -1
            at, first = np.unique(slot[live[free]], return_index=True)
            put = live[free][first]
            self.key[at], self.rank[at] = keys[put], put
            live = np.setdiff1d(live, put, assume_unique=True)
            if len(live):
                slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
                self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or the highest number."""
        keys = a.astype(np.int64).ravel() << 32 | b.ravel()
        slot = self.slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.rank[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(a.shape)

    def __call__(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of ``text``, one after the other, and how many each has. Words have 1 to LONG bytes."""
        end = np.cumsum(size)
        text = text[ragged(begin, size)]
        symbol = self.inner[text]
        symbol[end - 1] = self.final[text[end - 1]]
        order = np.argsort(-size, kind="stable")
        most = int(size.max(initial=0))
        at = np.searchsorted(-size[order], -np.arange(most + 2), side="left")  # at[n - 1]: past the words of n bytes or more
        row, rank, who, done = np.zeros((0, most + 1), np.int32), np.zeros((0, most), np.int32), np.zeros(0, np.int64), []
        for n in range(most, 0, -1):
            new = order[at[n] : at[n - 1]]
            if len(new):
                more = symbol[(end - size)[new][:, None] + np.arange(n)]
                row, rank, who = np.concatenate([row[:, :n], more]), np.concatenate([rank[:, : n - 1], self.ranks(more[:, :-1], more[:, 1:])]), np.concatenate([who, new])
            else:
                row, rank = row[:, :n], rank[:, : n - 1]
            if n == 1 or not len(who):
                done.append((who, row))
                continue
            each = np.arange(len(who))
            j = rank.argmin(axis=1)
            least = rank[each, j]
            live = least < _NONE
            if not live.all():
                done.append((who[~live], row[~live]))
                row, rank, who, j, least = row[live], rank[live], who[live], j[live], least[live]
                each = each[: len(who)]
            # The pair at j becomes one symbol: the rows lose a column, and the ranks on both sides of it are new.
            column = np.arange(n)
            row = row[column != (j + 1)[:, None]].reshape(len(who), n - 1)
            rank = rank[column[:-1] != j[:, None]].reshape(len(who), n - 2)
            row[each, j] = self.made[least]
            left, right = np.flatnonzero(j > 0), np.flatnonzero(j < n - 2)
            rank[left, j[left] - 1] = self.ranks(row[left, j[left] - 1], row[left, j[left]])
            rank[right, j[right]] = self.ranks(row[right, j[right]], row[right, j[right] + 1])
        count = np.zeros(len(size), np.int64)
        for w, r in done:
            count[w] = r.shape[1]
        start = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.uint32)
        for w, r in done:
            ids[start[w][:, None] + np.arange(r.shape[1])] = r
        return ids, count


class Words:
    """Words met before, by a 128-bit name: open addressing over arrays, and their ids one after the other."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        n = 1 << (2 * self.most).bit_length()
        self.bits, self.entry = n.bit_length() - 1, np.full(n, -1, np.int32)
        self.name, self.n = np.zeros((self.most // 8, 2), np.uint64), 0
        self.first, self.count = np.zeros(self.most // 8, np.int64), np.zeros(self.most // 8, np.int32)
        self.ids, self.n_ids = np.zeros(self.most // 2, np.uint32), 0

    def find(self, name: np.ndarray) -> np.ndarray:
        """The entry of each name, or -1."""
        out = np.full(len(name), -1, np.int32)
        slot, live = (name[:, 0] >> U(64 - self.bits)).astype(np.int64), np.arange(len(name))
        while len(live):
            got = self.entry[slot]
            live, slot, got = live[got >= 0], slot[got >= 0], got[got >= 0]
            same = (self.name[got] == name[live]).all(axis=1)
            out[live[same]] = got[same]
            live, slot = live[~same], (slot[~same] + 1) & (len(self.entry) - 1)
        return out

    def add(self, name: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New entries for names that are all different and not yet there."""
        entry = self.keep(ids, count)
        self.name[entry] = name
        if 2 * self.n > len(self.entry):
            self.bits = (2 * self.n).bit_length() + 1
            self.entry = np.full(1 << self.bits, -1, np.int32)
            entry = np.flatnonzero(self.name[: self.n].any(axis=1))
        slot, live = (self.name[entry, 0] >> U(64 - self.bits)).astype(np.int64), np.arange(len(entry))
        while len(live):
            free = np.flatnonzero(self.entry[slot[live]] < 0)
            at, first = np.unique(slot[live[free]], return_index=True)
            self.entry[at] = entry[live[free[first]]]
            live = np.delete(live, free[first])
            slot[live] = (slot[live] + 1) & (len(self.entry) - 1)

    def keep(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Entries without a name."""
        self.name, self.first, self.count, self.ids = grown(self.name, self.n + len(count)), grown(self.first, self.n + len(count)), grown(self.count, self.n + len(count)), grown(self.ids, self.n_ids + len(ids))
        entry = np.arange(self.n, self.n + len(count))
        self.first[entry], self.count[entry] = self.n_ids + np.cumsum(count) - count, count
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(count), self.n_ids + len(ids)
        return entry


def grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def names(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 128-bit name of each word of up to LONG bytes, eight bytes at a time. ``text`` goes on for 8 bytes behind the last word."""
    eight = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))
    out = np.empty((len(begin), 2), U)
    out[:, 0], out[:, 1] = mix(size.astype(U)), mix(size.astype(U) + U(0x5851F42D4C957F2D))
    live = np.arange(len(begin))
    for k in range(0, LONG, 8):
        live = live[size[live] > k] if k else live
        if not len(live):
            break
        left = np.minimum(size[live] - k, 8)
        block = eight[begin[live] + k] & _LOW[left]
        out[live, 0] = mix((out[live, 0] ^ block) * U(0x9E3779B97F4A7C15))
        out[live, 1] = mix((out[live, 1] + block) * U(0xD6E8FEB86659FD93))
    return out


def cut(text: np.ndarray, kind: np.ndarray, edge: np.ndarray, byte: bool) -> np.ndarray:
    """Where the words of joined texts begin, blanks included; ``edge``: where the texts begin.

    The byte kind gives a word the one space before it; of other blanks, the last before a word is a
    word of its own, and so are those before it together. The word kind takes digits one by one. A
    lone apostrophe begins a contraction of one or two letters.
    """
    n = len(text)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    start[1:n] = kind[1:] != kind[:-1]
    start[edge] = True
    blank = kind == BLANK
    if byte:
        # The last blank before another word of the same text begins a word, and goes on with it if it is a space.
        at = np.flatnonzero(blank[:-1] & ~blank[1:])
        text_end = np.zeros(n + 1, bool)
        text_end[edge] = True
        at = at[~text_end[at + 1]]
        start[at] = True
        start[at[text[at] == 0x20] + 1] = False
    else:
        start[:n] |= kind == DIGIT
    lone = np.flatnonzero(text == 0x27)
    if len(lone):
        starts = np.append(np.flatnonzero(start), [n, n])
        nth = np.searchsorted(starts, lone)
        two = np.append(text, np.zeros(3, np.uint8))
        alone = start[lone] & (starts[np.minimum(nth + 1, len(starts) - 1)] == lone + 1) & (starts[nth] == lone)
        last = np.searchsorted(edge, lone, side="right")
        stop = np.append(edge, n)[np.minimum(last, len(edge))]
        a, b = two[lone + 1], two[lone + 2]
        one = alone & (lone + 1 < stop) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        pair = alone & (lone + 2 < stop) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for hit, m in ((one, 2), (pair, 3)):
            start[lone[hit] + 1] = False
            start[np.minimum(lone[hit] + m, n)] = True
    return np.flatnonzero(start[:n])


def segments(text: bytes, size: int = CHUNK) -> list[bytes]:
    """A long text in parts that no word crosses: cut at a space between two visible ASCII characters."""
    out, lo = [], 0
    while len(text) - lo > 2 * size and (gap := _GAP.search(text, lo + size)):
        out.append(text[lo : gap.start()])
        lo = gap.start()
    return [*out, text[lo:]] if lo < len(text) else out


class Encoder:
    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [y for x in made.get("added_tokens") or [] for y in {x["content"].encode(), x["content"].lower().encode()}]
        pre, norm, model = made.get("pre_tokenizer") or {}, made.get("normalizer"), made["model"]
        self.kind = "any"
        usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        usual = usual and not any(x.get("normalized") and not x["content"].isascii() for x in made.get("added_tokens") or [])
        if not usual:
            pass
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            self.kind = "byte"  # a space starts a token or a run of white space
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("type") == "Split" and pre["pretokenizers"][0].get("invert") and [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"  # white space only separates
        if self.kind != "any":
            self.merges = Merges(model)
            self.bytes_of = {ord(c): chr(b) for b, c in enumerate(byte_symbols())}
        self.met = Words(MOST_WORDS)
        self.pieces: dict[str, bytes] = {}

    def words(self, s: str) -> list[bytes]:
        """The words of a piece, as bytes."""
        bare = s[1:] if self.kind == "byte" and s[:1] == " " else s
        if bare.isalpha() and (bare.isascii() or not _APART.search(bare)):  # letters alone are one word
            return [(s.lower() if self.kind == "word" else s).encode()]
        if self.tok.normalizer is not None:
            s = self.tok.normalizer.normalize_str(s)
        return [w.translate(self.bytes_of).encode("latin-1") for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(s)] if s else []

    def entries(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each word of ``text``, new ones merged. ``text`` goes on for 8 bytes behind the last word."""
        if self.met.n > MOST_WORDS:
            self.met.clear()
        out = np.empty(len(begin), np.int64)
        long = size > LONG
        name = names(text, begin[~long], size[~long])
        got = self.met.find(name)
        while len(new := np.flatnonzero(got < 0)):
            first = new[np.unique(name[new, 0], return_index=True)[1]]
            self.met.add(name[first], *self.merges(text, begin[~long][first], size[~long][first]))
            got[new] = self.met.find(name[new])
        out[~long] = got
        if long.any():
            raw = text.tobytes()
            words = [raw[a : a + n] for a, n in zip(begin[long].tolist(), size[long].tolist(), strict=True)]
            ids = {w: np.frombuffer(self.long(w), "<u4") for w in set(words)}
            which = {w: self.met.keep(x, np.array([len(x)]))[0] for w, x in ids.items()}
            out[long] = [which[w] for w in words]
        return out

    def by_class(self, data: list[bytes]) -> list[bytes]:
        """The ids of texts of known classes of bytes, none of them empty, about a chunk of them at a time."""
        out, lo, size = [], 0, 0
        for hi, x in enumerate([*data, b""]):
            size += len(x)
            if hi > lo and (hi == len(data) or size > 2 * CHUNK):
                out += self.at_once(data[lo:hi])
                lo, size = hi, len(x)
        return out

    def at_once(self, data: list[bytes]) -> list[bytes]:
        joined = b"".join(data)
        text = np.frombuffer(joined + bytes(8), np.uint8)
        n, edge = len(joined), np.cumsum([0, *map(len, data)])
        kind = CLASS[text[:n]]
        begin = cut(text[:n], kind, edge[:-1], self.kind == "byte")
        size = np.diff(np.append(begin, n))
        if self.kind == "word":
            begin, size = begin[k := kind[begin] != BLANK], size[k]
        entry = self.entries(text, begin, size)
        count = self.met.count[entry]
        raw = self.met.ids[ragged(self.met.first[entry], count)].astype("<u4").tobytes()
        at = (4 * np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[np.searchsorted(begin, edge)]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def learn(self, new: list[str]) -> None:
        """Merge pieces and keep their ids as little-endian unsigned 32-bit integers."""
        split = list(map(self.words, new))
        every = [w for x in split for w in x]
        size = np.fromiter(map(len, every), np.int64, len(every))
        text = np.frombuffer(b"".join(every) + bytes(8), np.uint8)
        entry = self.entries(text, np.cumsum(size) - size, size)
        count = self.met.count[entry]
        raw = self.met.ids[ragged(self.met.first[entry], count)].astype("<u4").tobytes()
        at, n = (4 * np.concatenate([[0], np.cumsum(count, dtype=np.int64)])).tolist(), 0
        for piece, x in zip(new, split, strict=True):
            self.pieces[piece] = raw[at[n] : at[n + len(x)]]
            n += len(x)

    def long(self, word: bytes) -> bytes:
        signs = byte_symbols()
        return b"".join(t.id.to_bytes(4, "little") for t in self.tok.model.tokenize("".join(signs[b] for b in word)))

    def split(self, text: str) -> list[str]:
        """Pieces that the pre-tokenizer never joins.

        Where no two marks touch, full stops and commas are split off as well, which both kinds of
        pre-tokenizer do (the byte kind only if no space stands before them).
        """
        if self.kind == "word":
            if text.isascii():
                text = text.lower()
            if not _RUN.search(text) and (text.isascii() or not _APART.search(text)):
                text = text.replace(".", " . ").replace(",", " , ")
            return text.replace("\n", " ").split(" ")
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text or _ODD.search(text):
            first, *rest = _BETWEEN.split(text)
            return [first, *[" " + x for x in rest]]
        text = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if " ." not in text and " ," not in text and not _RUN.search(text.replace("\0", "")):
            text = text.replace(".", "\0.").replace(",", "\0,")
        return text.split("\0")

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def by_piece(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts without added tokens, by pieces that the library prepares."""
        split = list(map(self.split, texts))
        new = set().union(*split).difference(self.pieces)
        if len(self.pieces) + len(new) > MOST_PIECES:
            self.pieces, new = {}, set().union(*split)
        if new:
            self.learn(sorted(new))
        look = self.pieces.__getitem__
        return [b"".join(map(look, x)) for x in split]

    def encode_all(self, data: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), without special tokens around it, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in data]
        usual, others, owner = [], [], []
        for i, text in enumerate(data):
            if self.kind == "any" or any(a in text or a in text.lower() for a in self.added):
                out[i] = [self.whole(text.decode("utf-8", "replace"))]
                continue
            for x in segments(text):
                odd = _UNUSUAL.search(x) is not None
                if odd:
                    others.append(x.decode("utf-8", "replace"))
                else:
                    usual.append(x if self.kind == "byte" else x.lower() if x.isascii() else x.decode().lower().encode())
                owner.append((i, odd))
        ids = (iter(self.by_class(usual)), iter(self.by_piece(others)))
        for i, odd in owner:
            out[i].append(next(ids[odd]))
        return list(map(b"".join, out))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode("utf-8", "surrogatepass")])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
