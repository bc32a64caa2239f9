"""Exact tokenising through a store of white-space units.

The tokenizers used here never let a token, or a merge, reach over a place where a
non-space character is followed by a space or a line feed. Texts may therefore be cut
there and the ids of the units joined. Units repeat far more often than they are new,
so each distinct one goes through the library once per worker. Cutting, telling units
apart and joining their ids are array operations on many texts at once.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strideline.llm.arrow import held

#: Bytes of units and ids kept per worker, counted with ``ENTRY_BYTES`` for each unit, before the store starts anew.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 16
#: Longer units are forgotten with the run of texts they come in.
LONG_UNIT = 100
#: Runs of marks whose ids are kept.
MARKS = 100_000
#: Units that go through the library in one text, and units that it gets in one call.
JOINED = 200
CALLED = 20_000
#: Characters of text that are split into units at a time, and units whose ids are joined at a time.
RUN_CHARS = 8_000_000
RUN_UNITS = 500_000

_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
_SPACE = "".join(rf"\x{{{c:x}}}" for c in range(0x21, 0x3001) if chr(c).isspace()) + r"\x{9}-\x{d}\x{1c}-\x{1f}"
#: No safe place to cut behind these: white space meets white space.
_UNSAFE = rf"(?s)(\A|[ {_SPACE}])\z"
#: Units that must not stand beside a separator: their own white space would join it.
_SPACED = rf"(?s)\A([{_SPACE}]|.[ {_SPACE}])"
#: A word of Latin letters and the marks behind it; an apostrophe may belong to a contraction.
_MARKED = r"(?s)\A(?P<core>.*[A-Za-z\x{c0}-\x{24f}])(?P<marks>[!-&(-/:-@\[-`{-~]+)\z"

Ragged = tuple[np.ndarray, np.ndarray]  # ids one after another, how many each unit has


def id_type(vocabulary: int) -> np.dtype:
    """Two bytes an id where the vocabulary allows it, else four."""
    return np.dtype("<u2") if vocabulary <= 65_536 else np.dtype("<u4")


def _gathered(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``ids``, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class UnitEncoder:
    """Encodes texts to little-endian id bytes, as ``tokenizers`` would encode each whole text."""

    def __init__(self, path: str):
        # A task has one core; threads of the library would only add memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self._forget()
        ids = lambda text: self._ids([text])[0]
        word = ids(" word")
        self.lowers = ids(" WORD") == word
        self.splits_marks = all(ids(f" word{mark}") == [*word, *ids(mark)] for mark in (".", ",", "***", "%%", ").", "}_"))
        self.marks: dict[str, bytes] = {}
        self.separators = [(sep, ids(" word" + sep + " word")[len(word)]) for sep in ("\n", " |") if self._parts(sep)]

    def _parts(self, sep: str) -> bool:
        """Whether a separator takes one id of its own between two units, with and without a space before the second."""
        one, two, bare = self._ids([" word", " other,", "other,"])
        joined, tight = self._ids([f" word{sep} other,", f" word{sep}other,"])
        return len(joined) == len(one) + 1 + len(two) and joined == [*one, joined[len(one)], *two] and (sep != "\n" or tight == [*one, joined[len(one)], *bare])

    @staticmethod
    def of(path: str) -> UnitEncoder:
        return held(("units", path), lambda: UnitEncoder(path))

    def _forget(self) -> None:
        self.units, self.ids, self.sizes, self.held = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64), 0

    @property
    def cache(self) -> dict[str, bytes]:
        """The units kept, and their ids."""
        ends = np.cumsum(self.sizes)
        return {u: self.ids[e - n : e].tobytes() for u, e, n in zip(self.units.to_pylist(), ends.tolist(), self.sizes.tolist(), strict=True)}

    @property
    def _code(self) -> str:
        return "H" if self.dtype.itemsize == 2 else "I"

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self._code, ids).tobytes() for ids in self._ids(texts)]

    def _joined(self, units: pa.Array, sep: str, number: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids and their counts of units joined by a separator, ``JOINED`` at a time; which units it could not part."""
        starts = np.r_[np.arange(0, len(units), JOINED), len(units)].astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), units), sep).to_pylist()
        ids, sizes, failed = [], [], np.zeros(len(units), bool)
        for begin, end, found in zip(starts.tolist(), starts[1:].tolist(), self._ids(texts), strict=False):
            one = np.array(found, self.dtype)
            at = np.flatnonzero(one == number)
            if len(at) != end - begin - 1:
                failed[begin:end] = True
                continue
            ids.append(one[one != number])
            sizes.append(np.diff(np.r_[-1, at, len(one)]) - 1)
        return ids, sizes, failed

    def _encoded(self, units: pa.Array) -> tuple[pa.Array, Ragged]:
        """The units in another order, and their ids. They end with no white space."""
        ids, sizes, order = [], [], []
        alone = np.ones(len(units), bool)
        if self.separators and len(units) > 2:
            sep, number = self.separators[0]
            odd = pc.or_(pc.match_substring(units, sep.strip(" ")), pc.match_substring_regex(units, _SPACED))
            alone = pc.or_(odd, pc.greater(pc.utf8_length(units), LONG_UNIT)).to_numpy(zero_copy_only=False).copy()
            spaced = pc.starts_with(units, " ").to_numpy(zero_copy_only=False)
            for mine, between in ((spaced, sep), (~spaced, sep if sep == "\n" else sep + " ")):
                fine = np.flatnonzero(mine & ~alone)
                for begin in range(0, len(fine), CALLED):
                    some = fine[begin : begin + CALLED]
                    *found, failed = self._joined(units.take(pa.array(some)), between, number)
                    ids += found[0]
                    sizes += found[1]
                    order.append(some[~failed])
                    alone[some[failed]] = True
        rest = np.flatnonzero(alone)
        order.append(rest)
        for begin in range(0, len(rest), CALLED):
            for found in self._ids(units.take(pa.array(rest[begin : begin + CALLED])).to_pylist()):
                ids.append(np.array(found, self.dtype))
                sizes.append(np.array([len(found)]))
        return units.take(pa.array(np.concatenate(order))), (np.concatenate([self.ids[:0], *ids]), np.concatenate([self.sizes[:0], *sizes]))

    def _tail(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self._whole([marks])[0]
            if len(self.marks) < MARKS:
                self.marks[marks] = found
        return found

    def _known(self, units: pa.Array) -> np.ndarray:
        """Each distinct unit's place in the store, or -1. The smaller side is hashed."""
        if len(self.units) <= len(units):
            return pc.index_in(units, value_set=self.units).fill_null(-1).to_numpy().copy()
        out = np.full(len(units), -1, np.int32)
        there = pc.index_in(self.units, value_set=units)
        at = there.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
        out[there.drop_null().to_numpy()] = at
        return out

    def _learnt(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct units: ids, where those of each unit begin, and how many they are. New units are stored, but long ones."""
        at = self._known(units)
        unknown = np.flatnonzero(at < 0)
        new, (ids, sizes) = self._encoded(units.take(pa.array(unknown)))
        ids, begins = np.concatenate([self.ids, ids]), np.cumsum(sizes) - sizes + len(self.ids)
        all_begins, all_sizes = np.r_[np.cumsum(self.sizes) - self.sizes, begins], np.r_[self.sizes, sizes]
        at[unknown] = len(self.units) + pc.index_in(units.take(pa.array(unknown)), value_set=new).to_numpy()
        short = pc.less_equal(pc.utf8_length(new), LONG_UNIT).to_numpy(zero_copy_only=False)
        kept = new.filter(pa.array(short))
        self.ids = ids if short.all() else np.concatenate([self.ids, _gathered(ids, begins[short], sizes[short])])
        self.units, self.sizes = pa.concat_arrays([self.units, kept]), np.r_[self.sizes, sizes[short]]
        self.held += (pc.sum(pc.utf8_length(kept)).as_py() or 0) + int(sizes[short].sum()) * self.dtype.itemsize + ENTRY_BYTES * len(kept)
        return ids, all_begins[at], all_sizes[at]

    def encode(self, texts: list[str]) -> list[bytes]:
        """One bytes object per text. Copies are encoded once."""
        made: dict[str, bytes] = {}
        run, size = [], 0
        for text in dict.fromkeys(texts):
            run.append(text)
            size += len(text)
            if size >= RUN_CHARS:
                made.update(zip(run, self._run(run), strict=True))
                run, size = [], 0
        made.update(zip(run, self._run(run), strict=True))
        return [made[text] for text in texts]

    def _run(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self._forget()
        whole, cut = [], []
        for number, text in enumerate(texts):
            low = text.lower()
            (whole if any(token in low for token in self.added) else cut).append(number)
        out = [b""] * len(texts)
        for number, value in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[number] = value
        slow = []
        if cut:
            parts, starts, ids, begins, sizes = self._split([texts[i] for i in cut])
            bad = np.flatnonzero(sizes[parts] < 0)
            slow = [cut[i] for i in np.unique(np.searchsorted(starts, bad, "right") - 1)]
            sizes = np.maximum(sizes, 0)
            first = 0
            while first < len(cut):
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + RUN_UNITS, "right")) - 1)
                mine = parts[starts[first] : starts[last]]
                own = sizes[mine]
                raw = _gathered(ids, begins[mine], own).tobytes()
                ends = (np.r_[0, np.cumsum(own)][starts[first : last + 1] - starts[first]] * self.dtype.itemsize).tolist()
                for number, a, b in zip(cut[first:last], ends, ends[1:], strict=False):
                    out[number] = raw[a:b]
                first = last
        for number in slow:
            cuts = [0, *(m.start() for m in _SAFE.finditer(texts[number])), len(texts[number])]
            pieces = [texts[number][a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            out[number] = b"".join(self._whole(pieces)) if pieces else b""
        return out

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of each text's each unit, where the texts begin; of each distinct unit: ids, begin and size.
        The size is -1 where there is no safe place to cut behind the unit."""
        # A line feed becomes a unit's own first character; " \n" in a text shows as an empty unit.
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        starts, flat = lists.offsets.to_numpy(), lists.flatten()
        is_first = np.zeros(len(flat), bool)
        is_first[starts[:-1]] = True
        first, later = (flat.filter(pa.array(m)).dictionary_encode() for m in (is_first, ~is_first))
        del lists, flat
        parts = np.empty(len(is_first), np.int32)
        parts[~is_first] = later.indices.to_numpy()
        parts[is_first] = first.indices.to_numpy() + len(later.dictionary)
        keys = later.dictionary
        lead = pc.if_else(pc.starts_with(keys, "\n"), "", " ")
        units = pa.concat_arrays([pc.binary_join_element_wise(lead, keys, ""), first.dictionary])
        unsafe = pa.concat_arrays([pc.match_substring_regex(x, _UNSAFE) for x in (keys, first.dictionary)])

        cores, tails, tail_of = units, self.ids[:0], np.zeros(len(units), np.int64)
        tail_sizes = np.zeros(1, np.int64)
        if self.splits_marks:
            marked = pc.extract_regex(units, _MARKED)
            cores = pc.if_else(pc.is_valid(marked), pc.struct_field(marked, "core"), units)
            marks = pc.if_else(pc.is_valid(marked), pc.struct_field(marked, "marks"), "").dictionary_encode()
            values = [self._tail(m) if m else b"" for m in marks.dictionary.to_pylist()]
            tails, tail_sizes = np.frombuffer(b"".join(values), self.dtype), np.array([len(v) // self.dtype.itemsize for v in values])
            tail_of = marks.indices.to_numpy()
        if self.lowers:
            cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        cores = pc.if_else(unsafe, pa.scalar(None, pa.string()), cores).dictionary_encode()
        ids, begins, sizes = self._learnt(cores.dictionary)
        # The last one stands for no unit.
        core_of = cores.indices.fill_null(len(sizes)).to_numpy()
        begins, sizes = np.r_[begins, 0][core_of], np.r_[sizes, 0][core_of]
        tail_begins = (np.cumsum(tail_sizes) - tail_sizes)[tail_of] + len(ids)
        both = np.stack([sizes, tail_sizes[tail_of]], 1)
        own = _gathered(np.concatenate([ids, tails]), np.stack([begins, tail_begins], 1).ravel(), both.ravel())
        sizes = both.sum(1)
        begins = np.cumsum(sizes) - sizes
        sizes[unsafe.to_numpy(zero_copy_only=False)] = -1
        return parts, starts, own, begins, sizes
