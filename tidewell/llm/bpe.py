"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A merge list is *proper* when each merge is listed after the merges that make its two sides. For such a list a
change to the right end of a word can only alter tokens to its left through a chain of merges of strictly rising
rank, each of which starts with what the one before it had left of itself. `sufficient_lookahead` takes the longest
such chain, in characters. A token that ends further than that from the end of what has been read is final, and
because no merge crosses a final boundary, encoding may start afresh there. `Transducer` uses both facts: it keeps a
block and the lookahead, emits what is final and drops it, so memory doesn't grow with the word.

A word that ends within the window needs no lookahead: such words are merged many at a time, each a row of an array.
Texts are read in parts that end at white space, so besides a text only a part's words and ids are held. Ids become
text again by a byte-to-text machine that takes them in blocks and holds the bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Distinct words whose ids a worker remembers; beyond it only those of the last part stay. The input is never cut.
MEMORY = 150_000
#: Symbols that the transducer gathers beyond the lookahead before it emits; ids that the decoder takes at a time.
BLOCK = 4096

#: Bytes of text that are encoded and handed back together.
SLICE_BYTES = 2_000_000

#: Above every rank.
NONE = np.iinfo(np.int32).max

# The byte alphabet of byte-level vocabularies and the white space of the Unicode property White_Space.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


# What Unicode 16 added to 15.1, as ranges (first, last), of letters and of numbers. The vocabulary's owner
# parts words by the classes of version 16, older than the matcher's and newer than those of `unicodedata`.
ADDED_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
ADDED_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Capitals that the owner lower-cases and Python 3.13 doesn't know, as (first, last, distance). A capital
# sigma is one letter like others there, without the rule for the end of a word.
ADDED_CAPITALS = (
    (0x03A3, 0x03A3, 32), (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
LOWER = {code: chr(code + far) for first, last, far in ADDED_CAPITALS for code in range(first, last + 1)}


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 on."""
    table, spare = [], 256
    for b in range(256):
        if b in _PRINTABLE:
            table.append(chr(b))
        else:
            table.append(chr(spare))
            spare += 1
    return table


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Characters to the right of a token's end after which no continuation can change it.

    reach[s]: the longest chain among the merges of higher rank whose right side starts with s. A merge (a, b)
    moves the first difference back over a, and the next one must have a right side that starts with a.
    """
    reach: dict[str, int] = {}
    most = 1
    for left, right in reversed(merges):
        here = len(left) + reach.get(left, 0)
        most = max(most, here + len(right))
        for end in range(1, len(right) + 1):
            key = right[:end]
            if reach.get(key, 0) < here:
                reach[key] = here
    return most


def is_proper(merges: list[tuple[str, str]], base: set[str]) -> bool:
    """Whether each side of a merge is a base symbol or made by an earlier merge."""
    made = set(base)
    for left, right in merges:
        if left not in made or right not in made:
            return False
        made.add(left + right)
    return True


class Merger:
    """Applies merges to a list of symbols: lowest rank first, leftmost first."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks = ranks

    def __call__(self, parts: list[str]) -> list[str]:
        if len(parts) > 48:
            return self._long(parts)
        get, none = self.ranks.get, 1 << 60
        parts = list(parts)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _long(self, parts: list[str]) -> list[str]:
        """The same with a heap over a linked list, for n log n steps."""
        n = len(parts)
        parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if i < n else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (r := get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p]


class Transducer:
    """Encodes one pre-token that arrives in pieces; holds at most a block and the lookahead."""

    def __init__(self, merge: Merger, lookahead: int, block: int = BLOCK):
        self.merge, self.lookahead, self.limit, self.held = merge, lookahead, lookahead + block, []

    def feed(self, symbols: list[str]) -> Iterator[str]:
        for at in range(0, len(symbols), BLOCK):
            self.held += symbols[at : at + BLOCK]
            if len(self.held) >= self.limit:
                yield from self._stable()

    def _stable(self) -> Iterator[str]:
        final, at = len(self.held) - self.lookahead, 0
        for token in self.merge(self.held):
            if at + len(token) > final:
                break
            at += len(token)
            yield token
        del self.held[:at]

    def finish(self, ending: str = "") -> Iterator[str]:
        """The rest; ending marks the last symbol of a word."""
        if self.held:
            self.held[-1] += ending
            yield from self.merge(self.held)
            self.held = []


class BatchMerger:
    """Merges many short words at once, each a row of an array: the same order, lowest rank and then leftmost.

    pairs: left id, right id, rank, id of the merged token. Rows narrow as they settle.
    """

    WIDTH, ROWS = 24, 4096

    def __init__(self, pairs: list[tuple[int, int, int, int]]):
        table = np.array(sorted((a << 32 | b, r, t) for a, b, r, t in pairs), dtype=np.int64).reshape(-1, 3)
        self.keys = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.ranks = np.append(table[:, 1], NONE).astype(np.int32)
        self.by_rank = np.zeros(int(table[:, 1].max(initial=0)) + 2, dtype=np.int32)
        self.by_rank[table[:, 1]] = table[:, 2]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.ranks[at], NONE)

    def __call__(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """rows: ids padded with -1, changed in place to the tokens; returns how many each row has."""
        n, width = rows.shape
        if width < 2 or not n:
            return lengths.copy()
        left = lengths.copy()
        at, work = np.arange(n), rows.copy()
        ranks = self.rank(work[:, :-1], work[:, 1:])
        columns = np.arange(width)
        while len(at):
            best = ranks.argmin(axis=1)
            each = np.arange(len(at))
            low = ranks[each, best]
            go = low < NONE
            if not go.all():
                rows[at[~go]] = work[~go]
                at, work, ranks, best, low = at[go], work[go], ranks[go], best[go], low[go]
                each = np.arange(len(at))
                if not len(at):
                    break
            work[each, best] = self.by_rank[low]
            shift = np.minimum(columns + (columns > best[:, None]), width - 1)
            work = work[each[:, None], shift]
            work[:, -1] = -1
            ranks = ranks[each[:, None], np.minimum(shift[:, :-1], width - 2)]
            ranks[:, -1] = NONE
            left[at] -= 1
            here = np.minimum(best, width - 2)
            ranks[each, here] = self.rank(work[each, here], work[each, here + 1])
            back = np.flatnonzero(best)
            ranks[back, best[back] - 1] = self.rank(work[back, best[back] - 1], work[back, best[back]])
        return left

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words end to end: how many tokens each has, and the symbols with each word's tokens in front of its stretch.
        Words over WIDTH are left as they are."""
        counts, out, starts = lengths.copy(), symbols.copy(), np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        order = order[np.searchsorted(lengths[order], 2) : np.searchsorted(lengths[order], self.WIDTH, side="right")]
        for low in range(0, len(order), self.ROWS):
            some = order[low : low + self.ROWS]
            n = lengths[some]
            columns = np.arange(int(n[-1]))
            places, held = starts[some][:, None] + columns, columns < n[:, None]
            rows = np.full(held.shape, -1, symbols.dtype)
            rows[held] = symbols[places[held]]
            counts[some] = self(rows, n)
            held = columns < counts[some][:, None]
            out[places[held]] = rows[held]
        return counts, out


def fronts(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of stretches end to end, the first `counts` values of each."""
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return values[at < np.repeat(counts, lengths)]


def later_letters() -> str:
    """What the matcher takes for a letter or number though the vocabulary's owner doesn't, as ranges of a class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    added = {code for first, last in ADDED_LETTERS + ADDED_NUMBERS for code in range(first, last + 1)}
    codes = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN" and ord(c) not in added]
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in ranges)


class WordBpe:
    """A BPE vocabulary of byte symbols with word ends, lower case and white space dropped, from its JSON file."""

    def __init__(self, path: str, memory: int = MEMORY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ending = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.symbols = byte_symbols()
        if not is_proper(merges, {*self.symbols, *(c + self.ending for c in self.symbols)}):
            raise ValueError("a merge is listed before one that makes its side, so no token is final before the end")
        self.lookahead = sufficient_lookahead(merges)
        self.merge = Merger({pair: rank for rank, pair in enumerate(merges)})
        self.batch = BatchMerger([(self.ids[a], self.ids[b], rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)])
        self.inner = np.array([self.ids[c] for c in self.symbols], dtype=np.int32)
        self.last = np.array([self.ids[c + self.ending] for c in self.symbols], dtype=np.int32)
        # Kinds of ASCII bytes: 1 letters, 2 digits, of which each is a piece, 3 others.
        self.kind = np.full(256, 3, np.int8)
        self.kind[97:123], self.kind[48:58] = 1, 2
        # \w is not \p{L}; the vocabulary's own pattern decides what is a piece of a word.
        later = later_letters()
        letter, number = (rf"[\p{{{c}}}--[{later}]]" if later else rf"\p{{{c}}}" for c in "LN")
        self.pieces = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{WHITE_SPACE}{letter}{number}]+")
        self.capitals = regex.compile("[" + "".join(map(chr, LOWER)) + "]")
        self.spaces = regex.compile(f"[{WHITE_SPACE}]+")
        self.odd_spaces = regex.compile("[\x1c-\x1f]")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # The library's decoded form, with the space that comes between tokens after each; and the bytes of each token.
        most = max(self.names) + 1
        of = {c: b for b, c in enumerate(self.symbols)}
        self.spaced = pa.array([self.names.get(i, "") + " " for i in range(most)], pa.large_string())
        self.bytes = pa.array([self._bytes(self.names.get(i, ""), of) for i in range(most)], pa.large_binary())
        self.memory = memory
        self._forget()

    def _bytes(self, name: str, of: dict[str, int]) -> bytes:
        if name in self.special:
            return name.encode("utf-8") + b" "
        whole = bool(self.ending) and name.endswith(self.ending)
        return bytes(of[c] for c in (name[: -len(self.ending)] if whole else name)) + b" " * whole

    def _forget(self) -> None:
        """Of all words only the special ones stay known, which stand under a space and their text."""
        self.place = {" " + text: k for k, text in enumerate(self.special)}
        self.store = np.fromiter(self.special.values(), np.int32, len(self.special))
        self.start, self.count = np.arange(len(self.special)), np.ones(len(self.special), np.int64)

    def piece_ids(self, piece: bytes) -> Iterator[int]:
        """Ids of one pre-token, through the transducer, as they get final."""
        run, table, ids = Transducer(self.merge, self.lookahead), self.symbols, self.ids
        for at in range(0, len(piece), BLOCK):
            for token in run.feed([table[b] for b in piece[at : at + BLOCK]]):
                yield ids[token]
        for token in run.finish(self.ending):
            yield ids[token]

    def folded(self, text: str) -> str:
        """Normalised and in lower case; line feeds stay as they are."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if self.capitals.search(text):
                text = text.translate(LOWER)
        return text.lower()

    def learn(self, words: Iterable[str]) -> None:
        """Encode these words side by side and remember them."""
        plain, odd = [], []
        for w in words:
            (plain if w.isascii() and "'" not in w and len(w) <= 64 else odd).append(w)
        if plain:  # pieces of ASCII words by the kinds of their bytes
            joined = np.frombuffer("\n".join(plain).lower().encode("ascii"), np.uint8)
            line = joined == 10
            kinds = np.where(line, 0, self.kind[joined])
            begins = np.r_[True, line[:-1]]
            first = (np.r_[True, kinds[1:] != kinds[:-1]] | (kinds == 2))[~line]
            self._remember(plain, joined[~line], np.flatnonzero(first), np.flatnonzero(begins[~line]))
        if odd:
            # Letters of Python's tables are letters of the owner's too, so such words are one piece.
            found, cut = self.pieces.findall, self.folded("\n".join(odd)).split("\n")
            pieces = [[w.encode("utf-8")] if w.isalpha() else [p.encode("utf-8") for p in found(w)] for w in cut]
            lengths = np.array([len(p) for of_word in pieces for p in of_word], np.int64)
            firsts = np.cumsum([0, *(sum(map(len, of_word)) for of_word in pieces)])[:-1]
            self._remember(odd, np.frombuffer(b"".join(p for of_word in pieces for p in of_word), np.uint8), np.cumsum(lengths) - lengths, firsts)

    def _remember(self, words: list[str], data: np.ndarray, pieces: np.ndarray, firsts: np.ndarray) -> None:
        """data: the words' pieces end to end; where each piece and each word begins."""
        lengths = np.diff(np.append(pieces, len(data)))
        symbols = self.inner[data]
        ends = pieces + lengths - 1
        symbols[ends] = self.last[data[ends]]
        counts, tokens = self.batch.merge(symbols, lengths)
        for k in np.flatnonzero(lengths > BatchMerger.WIDTH).tolist():
            low = int(pieces[k])
            ids = np.fromiter(self.piece_ids(data[low : low + int(lengths[k])].tobytes()), np.int32)
            tokens[low : low + len(ids)], counts[k] = ids, len(ids)
        of_words = np.add.reduceat(counts, np.searchsorted(pieces, firsts))
        known, held = len(self.place), len(self.store)
        self.place.update(zip(words, range(known, known + len(words))))
        self.store = np.concatenate([self.store, fronts(tokens, lengths, counts)])
        self.start = np.concatenate([self.start, held + np.cumsum(of_words) - of_words])
        self.count = np.concatenate([self.count, of_words])

    def _split(self, text: str) -> list[str]:
        return self.spaces.split(text) if self.odd_spaces.search(text) else text.split()

    def _words(self, text: str) -> list[str]:
        if self.specials is None or "<|" not in text:
            return [w for w in self._split(text) if w]
        runs = self.specials.split(text)
        return [w for k, run in enumerate(runs) for w in ([" " + run] if k % 2 else self._split(run)) if w]

    def _parts(self, texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """(text, part) in groups of about SLICE_BYTES characters; a part ends at white space or with its text."""
        group, size = [], 0
        for k, text in enumerate(texts):
            at, text = 0, text or ""
            while at < len(text) or not at:
                found = self.spaces.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
                end = found.end() if found else len(text)
                group.append((k, text[at:end]))
                size += end - at
                at = end
                if size >= SLICE_BYTES:
                    yield group
                    group, size = [], 0
                if not text:
                    break
        if group:
            yield group

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts end to end, and where each part's begin; the end last."""
        words = [self._words(p) for p in parts]
        ends = np.cumsum([0, *map(len, words)])
        words = [w for of_part in words for w in of_part]
        if new := set(words).difference(self.place):
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        counts = self.count[at]
        upto = np.cumsum(np.append(0, counts))
        ids = self.store[np.arange(upto[-1]) + np.repeat(self.start[at] - upto[:-1], counts)]
        if len(self.place) > self.memory or len(self.store) > 8 * self.memory:
            recent = {w for w in set(words) if len(w) <= 64 and w[0] != " "} if len(words) else set()
            self._forget()
            if len(recent) <= self.memory // 2:
                self.learn(recent)
        return ids, upto[ends]

    def encode(self, text: str | None) -> list[int]:
        return [i for group in self._parts([text]) for i in self._ids([p for _, p in group])[0].tolist()]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes a vocabulary without a decoder: tokens with a space between; unknown ids dropped."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def digests(self, texts: list[str | None], into: bytearray | None = None) -> list[tuple[int, str, str, int]]:
        """Of each text: count of ids, SHA-256 of the ids and of the library's decoded form, and how many characters the
        ids are as text again; the packed ids are appended to `into` if given."""
        out, last = [], -1
        for group in self._parts(texts):
            ids, bounds = self._ids([p for _, p in group])
            spaced = self.spaced.take(pa.array(ids))
            places = np.frombuffer(spaced.buffers()[1], np.int64, len(ids) + 1)[bounds].tolist() if len(ids) else [0] * len(bounds)
            names, packed = memoryview(spaced.buffers()[2]) if len(ids) else memoryview(b""), memoryview(ids.astype("<u4").tobytes())
            if into is not None:
                into += packed
            bounds = bounds.tolist()
            for k, (text, _) in enumerate(group):
                if text != last:
                    if last >= 0:
                        out.append(state.results())
                    state, last = _Digest(self.bytes), text
                state.update(ids[bounds[k] : bounds[k + 1]], packed[4 * bounds[k] : 4 * bounds[k + 1]], names[places[k] : places[k + 1]])
        if last >= 0:
            out.append(state.results())
        return out


class _Digest:
    """Counts and hashes of one text's ids, part by part."""

    def __init__(self, table: pa.LargeBinaryArray):
        self.count, self.chars, self.of_ids, self.of_text, self.between = 0, 0, hashlib.sha256(), hashlib.sha256(), b""
        self.decoder = TextDecoder(table)

    def update(self, ids: np.ndarray, packed: memoryview, names: memoryview) -> None:
        if len(ids):
            self.count += len(ids)
            self.of_ids.update(packed)
            self.of_text.update(self.between)
            self.of_text.update(names[:-1])
            self.between = b" "
            for at in range(0, len(ids), BLOCK):
                self.chars += len(self.decoder.feed(ids[at : at + BLOCK]))

    def results(self) -> tuple[int, str, str, int]:
        return self.count, self.of_ids.hexdigest(), self.of_text.hexdigest(), self.chars + len(self.decoder.finish())


class _Remembered(dict):
    """A dict that computes what it lacks. When full it becomes the old generation, from which what is used comes back;
    so frequent keys stay and at most twice `most` are held. Long keys aren't kept."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            self.put(key, value)
        return value


class TextDecoder:
    """Ids to text as they arrive in blocks: a word's end is a space, and only the bytes of an unfinished character are
    held from block to block. Bytes that are no UTF-8 give U+FFFD."""

    def __init__(self, table: pa.LargeBinaryArray):
        self.table, self.held = table, b""

    def feed(self, ids: np.ndarray) -> str:
        got = self.table.take(pa.array(ids))
        data = self.held + bytes(memoryview(got.buffers()[2])) if len(ids) and got.buffers()[2] is not None else self.held
        text, used = codecs.utf_8_decode(data, "replace", False)
        self.held = data[used:]
        return text

    def finish(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One vocabulary a worker, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take about `most` bytes; a longer text stands alone or ends its run."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begun = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(begun)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if start < end:
            yield batch.slice(start, end - start)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars of every text, and the ids if asked for.

    A null text counts as empty; rows stay as they come, repeated or not, and an empty table gives none; other columns
    are left aside, so their names don't matter; very long texts are read in parts.
    No shuffle: one pass in Arrow batches, so a lost executor costs its own tasks only. Ids leave in slices of a few MB
    of text, so memory doesn't grow with the batch.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded_chars", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        model = word_bpe(path)
        for batch in batches:
            for part in slices(batch, 1):
                packed = bytearray() if with_ids else None
                rows = model.digests(part.column(1).to_pylist(), packed)
                columns = [part.column(0), *(pa.array(c, f[1]) for c, f in zip(zip(*rows), fields[1:]))]
                if with_ids:
                    ends = np.cumsum([0, *(row[0] for row in rows)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(packed, dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl)


def op1_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    """Every whole text of the documents encoded and decoded; see encode_documents for awkward rows."""
    import public_tokenizers

    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
