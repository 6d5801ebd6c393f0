"""Exact merge-type encoding by backtracking: the ids of a SentencePiece BPE model.

Such a model merges the neighbours whose joined text is its best-scored piece (the leftmost of equals) until no
neighbours join to a piece. A row of pieces is the result of that if and only if every two neighbours, merged
anew by themselves, come out as the same two pieces: the first merge across a border of the row would happen
in the two pieces beside it as well. So there is one such row, and each of its beginnings is the row of a shorter
text. ``MergeEncoder`` looks for it from the left with the longest piece at each place (all found by one
Aho-Corasick pass), takes a shorter one where neighbours don't fit, and notes in a bitfield the places that
no row goes on from, so that none is tried twice.

Texts are encoded together as arrays of code points: they are cut into words between characters that stand side by
side in no piece, and the different words take each step at the same time.
"""

from __future__ import annotations

from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa

#: Stands for a space in a model's pieces (fixed value of the format).
SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Different words after which an encoder begins a new generation; it keeps two (some 100 MB each), and pairs of pieces (some 50 bytes each).
KEPT_WORDS = 500_000
KEPT_PAIRS = 1_000_000
#: Bits of an id where a piece's length stands above it.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
#: Longer words are encoded at each occurrence.
KEPT_LENGTH = 48


class Numbers:
    """Whole numbers by keys (neither is negative), for arrays of keys at a time: at most a quarter of the slots is taken."""

    def __init__(self):
        self.count, self.bits = 0, 8
        self.keys, self.values = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, dtype=np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one that it would take."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        others = np.flatnonzero((there != keys) & (there >= 0))
        while len(others):
            at[others] = at[others] + 1 & len(self.keys) - 1
            there = self.keys[at[others]]
            others = others[(there != keys[others]) & (there >= 0)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1: none."""
        at = self.slots(keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that have no number yet."""
        self.count += len(keys)
        if 4 * self.count > len(self.keys):
            taken = self.keys >= 0
            keys, values = np.concatenate([self.keys[taken], keys]), np.concatenate([self.values[taken], values])
            self.bits = max(8, (4 * self.count).bit_length())
            self.keys, self.values = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, dtype=np.int64)
        while len(keys):
            at = self.slots(keys)
            self.keys[at] = keys  # one of those that meet in a slot
            stays = self.keys[at] == keys
            self.values[at[stays]] = values[stays]
            keys, values = keys[~stays], values[~stays]


class Growing:
    """An array that others are added to; its room doubles."""

    def __init__(self, values: np.ndarray):
        self.room, self.size = values, len(values)

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(size, dtype=self.room.dtype)])
        self.room[self.size : size] = values
        self.size = size


class LongestPieces:
    """Aho-Corasick automaton of the pieces read from their ends: the state at a place tells the longest piece that begins there."""

    def __init__(self, ids: dict[str, int], dense: np.ndarray):
        names = ["", *sorted({piece[i:] for piece in ids for i in range(len(piece))}, key=len)]
        states = {name: state for state, name in enumerate(names)}
        self.dense, self.width = dense, int(dense.max()) + 1
        self.fail, self.best = np.zeros(len(names), dtype=np.int64), np.full(len(names), -1)
        for state, name in enumerate(names):
            self.fail[state] = next((states[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in states), 0)
            self.best[state] = ids.get(name, self.best[self.fail[state]])
        begins = np.fromiter((states[name[1:]] for name in names[1:]), dtype=np.int64)
        chars = dense[np.fromiter((ord(name[0]) for name in names[1:]), dtype=np.int64)]
        self.steps = Numbers()
        self.steps.add(begins * self.width + chars, np.arange(1, len(names)))

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        states = states.copy()
        after = self.steps.get(states * self.width + chars)
        back = np.flatnonzero((after < 0) & (states > 0))
        while len(back):
            fallen = states[back] = self.fail[states[back]]
            found = after[back] = self.steps.get(fallen * self.width + chars[back])
            back = back[(found < 0) & (fallen > 0)]
        return np.maximum(after, 0)

    def find(self, codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The longest piece at each place of words, the longest word first; -1: none."""
        longest = np.full(len(codes), -1)
        chars, states = self.dense[codes], np.zeros(len(ends), dtype=np.int64)
        for i, going in enumerate(np.searchsorted(-sizes, -np.arange(sizes.max(initial=0))).tolist()):
            at = ends[:going] - 1 - i
            states = self.step(states[:going], chars[at])
            longest[at] = self.best[states]
        return longest


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(sizes.sum())


class MergeEncoder:
    """Encoder and decoder for the content of a model file.

    The library normalises texts and decodes ids; the pieces are found here. Models of another type than BPE, and
    such with user-defined or unused pieces, are refused.
    """

    def __init__(self, content: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(content)
        kinds = {piece.type for piece in model.pieces}
        if model.trainer_spec.model_type != model.trainer_spec.BPE or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models without user-defined or unused pieces can be merged")
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.end_id = self.processor.eos_id()
        self.plain = model.normalizer_spec.name == "identity" and not model.normalizer_spec.precompiled_charsmap
        self.plain = self.plain and model.normalizer_spec.add_dummy_prefix and model.normalizer_spec.escape_whitespaces
        self.plain = self.plain and not model.normalizer_spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.ids = {piece.piece: i for i, piece in enumerate(model.pieces) if piece.type == NORMAL}
        self.scores = {piece.piece: piece.score for piece in model.pieces if piece.type == NORMAL}
        self.unknown = next(i for i, piece in enumerate(model.pieces) if piece.type == UNKNOWN)
        self.bytes = [i for i, piece in enumerate(model.pieces) if piece.type == BYTE]
        if not model.trainer_spec.byte_fallback:
            self.bytes = []
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece) << ID_BITS | self.ids[piece])
        self.automaton.make_automaton()
        beside = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        held = sorted(set("".join(self.ids)))
        #: Number of each character in the pieces; 0: in none.
        self.dense = np.zeros(0x110000, dtype=np.int32)
        self.dense[[ord(c) for c in held]] = np.arange(1, len(held) + 1)
        self.width = len(held) + 1
        #: Bitfield of the characters that stand side by side in some piece; between others no merge is possible.
        self.beside = np.zeros(self.width * self.width // 8 + 1, dtype=np.uint8)
        for pair in beside:
            key = int(self.dense[ord(pair[0])]) * self.width + int(self.dense[ord(pair[1])])
            self.beside[key >> 3] |= 1 << (key & 7)
        self.longest = LongestPieces(self.ids, self.dense)
        self.names = [piece.piece for piece in model.pieces]
        self.sizes, self.lone = [len(name) for name in self.names], len(self.names)
        #: Numbers of the words that are kept (code points as bytes); their ids stand one word after the other.
        self.words: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.kept, self.begins, self.counts = (Growing(np.zeros(0, dtype=kind)) for kind in (np.int32, np.int64, np.int64))
        self.lengths = np.array([*self.sizes, 1])
        self.prefix = np.array([*map(self.prefix_of, self.names), -1])
        self.known = Numbers()
        self.steps: dict[int, list | None] = {}

    def normalized(self, text: str) -> str:
        """The text as the model's normaliser leaves it, spaces as ``SPACE``."""
        if not text:
            return ""
        return SPACE + text.replace(" ", SPACE) if self.plain else self.processor.normalize(text)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text and the end id."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        bounds, ids = self.encode_arrays(texts)
        ids = ids.tolist()
        return [ids[begin:end] for begin, end in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]

    def encode_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin (and the last ones end), and the ids of all texts."""
        normalized = list(map(self.normalized, texts))
        sizes = np.fromiter(map(len, normalized), dtype=np.int64, count=len(texts))
        codes = np.frombuffer("".join(normalized).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        first = np.cumsum(sizes) - sizes
        begins = self.word_begins(codes, first[sizes > 0])
        limits = pa.py_buffer(4 * np.append(begins, len(codes)))
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, limits, pa.py_buffer(codes)]).dictionary_encode()
        numbers = self.learnt(words.dictionary)[words.indices.to_numpy()]
        counts = self.counts.room[numbers]
        ids = self.kept.room[spread(self.begins.room[numbers], counts)]
        bounds = np.append(0, np.cumsum(counts))[np.searchsorted(begins, np.append(first, len(codes)))]
        if not self.bytes:  # unknown characters side by side share one id
            stays = np.ones(len(ids), dtype=bool)
            stays[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            stays[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
            ids, bounds = ids[stays], np.append(0, np.cumsum(stays))[bounds]
        return bounds + np.arange(len(bounds)), np.insert(ids, bounds[1:], self.end_id)

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def decode_all(self, bounds: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each stretch of ids."""
        limits, ids = bounds.tolist(), ids.tolist()
        return [self.decode(ids[begin:end]) for begin, end in zip(limits, limits[1:], strict=False)]

    def word_begins(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words begin: at the first places of texts and between characters that stand side by side in no piece."""
        chars = self.dense[codes].astype(np.int64)
        pairs = chars[:-1] * self.width + chars[1:]
        cut = np.ones(len(codes), dtype=bool)
        cut[1:] = self.beside[pairs >> 3] >> (pairs & 7).astype(np.uint8) & 1 == 0
        cut[first] = True
        return np.flatnonzero(cut)

    def learnt(self, words: pa.Array) -> np.ndarray:
        """The numbers of different words. Short ones are kept from now on, the others until the next call.

        When words are too many, those not met since the last time go.
        """
        if len(self.words) >= KEPT_WORDS:
            held = np.fromiter(self.words.values(), dtype=np.int64, count=len(self.words))
            self.older, self.words = dict(zip(self.words, range(len(held)), strict=True)), {}
            begins, counts = self.begins.room[held], self.counts.room[held]
            self.kept = Growing(self.kept.room[spread(begins, counts)])
            self.begins, self.counts = Growing(np.cumsum(counts) - counts), Growing(counts)
        names = words.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.words.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        for i in np.flatnonzero(numbers < 0).tolist():
            if (number := self.older.get(names[i], -1)) >= 0:
                numbers[i] = self.words[names[i]] = number
        limits = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1] // 4
        sizes = np.diff(limits)
        new = np.flatnonzero(numbers < 0)
        new, long = new[sizes[new] <= KEPT_LENGTH], new[sizes[new] > KEPT_LENGTH]
        new = new[np.argsort(-sizes[new], kind="stable")]
        codes = np.frombuffer(words.buffers()[2] or b"", dtype="<u4")
        numbers[new] = self.add(*self.rows(codes[spread(limits[new], sizes[new])], sizes[new]))
        self.words.update(zip([names[i] for i in new.tolist()], numbers[new].tolist(), strict=True))
        found = [self.ids_of(self.row(names[i].decode("utf-32-le", "surrogatepass"))) for i in long.tolist()]
        held = [(array, array.size) for array in (self.kept, self.begins, self.counts)]
        numbers[long] = self.add(np.array([n for own in found for n in own], dtype=np.int32), np.array(list(map(len, found)), dtype=np.int64))
        for array, size in held:
            array.size = size
        return numbers

    def add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds the ids of words that stand one word after the other; returns the words' numbers."""
        first = self.counts.size
        self.begins.add(self.kept.size + np.cumsum(counts) - counts)
        self.counts.add(counts)
        self.kept.add(ids)
        return np.arange(first, self.counts.size)

    def ids_of(self, row: list[int]) -> list[int]:
        """The ids of a row of pieces; a lone character that is no piece has its bytes or is unknown."""
        if max(row, default=0) < self.lone:
            return row
        found: list[int] = []
        for number in row:
            if number < self.lone:
                found.append(number)
            elif self.bytes:
                found += [self.bytes[byte] for byte in chr(number - self.lone).encode("utf-8")]
            else:
                found.append(self.unknown)
        return found

    def rows(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short words (the longest first), one word after the other, and each word's count; see ``row``.

        All words take their next step at the same time.
        """
        ends = np.cumsum(sizes)
        place = ends - sizes
        longest = self.longest.find(codes, ends, sizes)
        longest = np.where(longest < 0, self.lone + codes.astype(np.int64), longest)
        failed = np.zeros(len(codes) // 8 + 1, dtype=np.uint8)
        rows, depth = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int32), np.zeros(len(sizes), dtype=np.int64)
        before, number = np.full(len(sizes), -1), longest[place]
        going = np.arange(len(sizes))
        while len(going):
            own, end = number[going], place[going] + self.lengths[np.minimum(number[going], self.lone)]
            fits = (own >= 0) & ((failed[end >> 3] >> (end & 7) & 1) == 0)
            fits[fits] = self.fit(before[going][fits], own[fits])
            on, back = going[fits], going[~fits]
            rows[on, depth[on]] = before[on] = number[on]
            depth[on] += 1
            place[on] = end[fits]
            on = on[place[on] < ends[on]]
            number[on] = longest[place[on]]
            number[back] = np.where(number[back] < self.lone, self.prefix[np.minimum(number[back], self.lone)], -1)
            lost = back[number[back] < 0]
            np.bitwise_or.at(failed, place[lost] >> 3, (1 << (place[lost] & 7)).astype(np.uint8))
            depth[lost] -= 1
            last = rows[lost, depth[lost]]
            place[lost] -= self.lengths[np.minimum(last, self.lone)]
            number[lost] = np.where(last < self.lone, self.prefix[np.minimum(last, self.lone)], -1)
            before[lost] = np.where(depth[lost] > 0, rows[lost, depth[lost] - 1], -1)
            going = np.concatenate([on, back])
        taken = np.arange(rows.shape[1]) < depth[:, None]
        ids, alone = rows[taken], rows >= self.lone
        if not (alone & taken).any():
            return ids, depth
        # as in ids_of: a lone character's bytes or the unknown id
        alone, owner = ids >= self.lone, np.repeat(np.arange(len(depth)), depth)
        if not self.bytes:
            return np.where(alone, self.unknown, ids).astype(np.int32), depth
        points = ids[alone] - self.lone
        width = np.ones(len(ids), dtype=np.int64)
        width[alone] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ids, alone = np.repeat(ids, width), np.repeat(alone, width)
        encoded = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ids[alone] = np.array(self.bytes, dtype=np.int32)[np.frombuffer(encoded, dtype=np.uint8)]
        return ids, np.bincount(owner, weights=width, minlength=len(depth)).astype(np.int64)

    def fit(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        """``fits`` of many neighbours: known pairs are looked up together."""
        keys = before + 1 << 32 | number
        found = self.known.get(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if self.known.count > KEPT_PAIRS:
                self.known = Numbers()
                return self.fit(before, number)
            self.known.add(new, np.array([self.fits((key >> 32) - 1, key & 0xFFFFFFFF) for key in new.tolist()], dtype=np.int64))
            found = self.known.get(keys)
        return found == 1

    def row(self, word: str) -> list[int]:
        """The row of pieces of a word, as ids; a character that is no piece has the number ``lone`` + its code."""
        size, lone, sizes, row = len(word), self.lone, self.sizes, []
        longest = [0] * size  # length and id of a piece in one number; the greatest is the longest
        for last, found in self.automaton.iter(word):
            first = last + 1 - (found >> ID_BITS)
            if found > longest[first]:
                longest[first] = found
        longest = [found & ID_MASK if found else lone + ord(word[i]) for i, found in enumerate(longest)]
        failed, place, before = None, 0, -1
        number = longest[0] if size else -1
        while place < size:
            while number >= 0:
                if self.fits(before, number):
                    end = place + (sizes[number] if number < lone else 1)
                    if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                        break
                number = self.shorter(number)
            if number >= 0:
                row.append(number)
                place, before = end, number
                if place < size:
                    number = longest[place]
            else:
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[place >> 3] |= 1 << (place & 7)
                row.pop()
                place -= sizes[before] if before < lone else 1
                number, before = self.shorter(before), row[-1] if row else -1
        return row

    def shorter(self, number: int) -> int:
        """The longest piece (or lone character) that a piece begins with, itself left out; -1: none."""
        return int(self.prefix[number]) if number < self.lone else -1

    def prefix_of(self, piece: str) -> int:
        found = next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), -1)
        return self.lone + ord(piece[0]) if found < 0 and len(piece) > 1 else found

    def text(self, number: int) -> str:
        return self.names[number] if number < self.lone else chr(number - self.lone)

    def fits(self, before: int, number: int) -> bool:
        """Whether two neighbours, merged anew, stay as they are. No neighbour (-1): whether the piece does.

        Each side's merges by itself are known; they take turns by score (the left one of equals) until a
        merge across the border comes first or none is left.
        """
        fits = self.merges(number) is not None and (before < 0 or self.merges(before) is not None)
        if fits and before >= 0:
            left, right = self.merges(before), self.merges(number)
            last, first, i, j = self.text(before)[-1], self.text(number)[0], 0, 0
            while True:
                across, own, other = self.scores.get(last + first), left[i][0] if i < len(left) else None, right[j][0] if j < len(right) else None
                if across is not None and (own is None or across > own) and (other is None or across >= other):
                    fits = False
                    break
                if own is None and other is None:
                    break
                if other is None or (own is not None and own >= other):
                    last, i = left[i][2], i + 1
                else:
                    first, j = right[j][1], j + 1
        return fits

    def merges(self, number: int) -> list[tuple[float, str, str]] | None:
        """Score of each merge of a piece by itself, and the row's first and last part after it; None: it ends in parts."""
        if number not in self.steps:
            row, found = list(self.text(number)), []
            while len(row) > 1:
                scores = [self.scores.get(a + b) for a, b in zip(row, row[1:], strict=False)]
                best = max((score for score in scores if score is not None), default=None)
                if best is None:
                    break
                at = scores.index(best)
                row[at : at + 2] = [row[at] + row[at + 1]]
                found.append((best, row[0], row[-1]))
            self.steps[number] = found if len(row) == 1 else None
        return self.steps[number]
