"""Token ids by the tokenizers library, with a bounded cache of text pieces.

A text is cut where its tokenizer cannot look across, so that the ids of the
text are the ids of its pieces in order. Arrow cuts a batch, finds its distinct
pieces and parts each into a word of letters and the marks behind it; distinct
words and marks are encoded by the library once while the cache holds them, and
ids are gathered by numpy. Texts that cannot be cut safely are encoded whole.
The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import per_worker

_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_LINE = r"[\t\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space next to a space, other white space next to a line end, three line ends, or two at the text's end: no safe places to cut.
_LOOSE = rf" {_WHITE}|{_WHITE} |\n{_NOT_LINE}|{_NOT_LINE}\n|\n\n\n|\n\n$"
#: ASCII marks that may end a word; one of them begins contractions and is left out.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of long-settled alphabets that stay single letters when normalised and lower-cased.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f"
#: Words that are encoded in one text, and other pieces in one call.
JOINED, CALL = 64, 4096


class Ragged:
    """Rows of ids, one after the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.ends = ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def take(self, rows: np.ndarray) -> Ragged:
        first = self.ends[rows]
        sizes = self.ends[rows + 1] - first
        upto = np.cumsum(sizes)
        at = np.repeat(first - (upto - sizes), sizes)
        at += np.arange(len(at))
        return Ragged(self.ids[at], sizes)

    def add(self, others: list[Ragged]) -> Ragged:
        every = [self, *others]
        return Ragged(np.concatenate([x.ids for x in every]), np.concatenate([np.diff(x.ends) for x in every]))

    @staticmethod
    def none(rows: int = 0) -> Ragged:
        return Ragged(np.zeros(0, "<u4"), np.zeros(rows, np.int64))


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class PieceTokenizer:
    """Encodes batches of texts; the rule says where texts may be cut.

    "lone": before a space without white space beside it, and before a line
    end (a byte-level pre-tokenizer starts a token there whatever surrounds
    it). "dropped": at spaces and line ends (they are dropped, and the
    normaliser looks at single characters). "none": nowhere.

    Keys of the cache: a piece as it is cut, or its word of letters; under
    "lone" those without a leading line end have a space before them. Marks
    that follow a word have two line ends before them, which no piece has.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.rule = self._rule(spec)
        self.limit = limit
        self._empty()
        # a word of letters is one run: its first token carries the space before it, or its last token a word's end
        self.prefix, self.gap, mark = (" ", "", "\u0120") if self.rule == "lone" else ("", " ", "</w>")
        self.line_end = next(iter(self.tokenizer.encode("\n", add_special_tokens=False).ids), -1)
        self.marked = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.marked[[k for x, k in self.tokenizer.get_vocab().items() if (x.startswith(mark) if self.rule == "lone" else x.endswith(mark))]] = True
        self.unsafe = "|".join([re.escape(x) for x in self.special] + [_LOOSE] * (self.rule == "lone"))
        self.word = re.compile(f"\n?[{_LETTERS}]+")

    def _empty(self) -> None:
        """Row 0 holds no ids."""
        self.rows: dict[str, int] = {"\n\n": 0}
        self.held, self.characters = Ragged.none(1), 0

    @staticmethod
    def _rule(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "lone"
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        splits = [x for x in pre.get("pretokenizers", []) if x["type"] == "Split"]
        if steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["behavior"] == "Removed" and splits[0]["pattern"]["Regex"].endswith(r"[^\s\p{L}\p{N}]+"):
            return "dropped"
        return "none"

    def _each(self, texts: list[str]) -> Ragged:
        found = [np.asarray(x.ids, "<u4") for k in range(0, len(texts), CALL) for x in self.tokenizer.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False)]
        return Ragged(np.concatenate(found or [np.zeros(0, "<u4")]), np.asarray([len(x) for x in found], np.int64))

    def _words(self, words: list[str], head: bool) -> Ragged:
        """Ids of words of letters, many in one text; a text with an odd number of marks is encoded word by word.

        head: with a line end before each, and no space.
        """
        prefix, gap = ("\n", "") if head else (self.prefix, self.gap)
        parts = []
        for low in range(0, len(words), JOINED * 64):
            groups = [words[k : k + JOINED] for k in range(low, min(low + JOINED * 64, len(words)), JOINED)]
            texts = [gap.join([prefix + x for x in group]) for group in groups]
            for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.asarray(found.ids, "<u4")
                at = np.flatnonzero(ids == self.line_end if head else self.marked[ids])
                if len(at) != len(group):
                    parts.append(self._each([prefix + x for x in group]))
                elif self.rule == "lone":
                    parts.append(Ragged(ids, np.diff(at, append=len(ids))))
                else:
                    parts.append(Ragged(ids, np.diff(at, prepend=-1)))
        return Ragged.none().add(parts)

    def _learn(self, keys: list[str]) -> np.ndarray:
        """The row of each of some distinct keys; those that the cache does not hold are encoded."""
        found = np.fromiter(map(self.rows.get, keys, repeat(-1)), np.int64, len(keys))
        new = [keys[k] for k in np.flatnonzero(found < 0)]
        if len(self.rows) + len(new) > self.limit or self.characters > 16 * self.limit:
            at = np.flatnonzero(found > 0)
            old, kept = self.held.take(found[at]), [keys[k] for k in at]
            self._empty()
            self._add(kept, old)
            found[at] = np.arange(1, len(at) + 1)
        if new:
            plain = [bool(self.word.fullmatch(x)) for x in new]
            words = [x for x, y in zip(new, plain, strict=True) if y and x[0] != "\n"]
            heads = [x for x, y in zip(new, plain, strict=True) if y and x[0] == "\n"]
            marks = [x for x, y in zip(new, plain, strict=True) if not y and x[:2] == "\n\n"]
            others = [x for x, y in zip(new, plain, strict=True) if not y and x[:2] != "\n\n"]
            if words:
                self._add(words, self._words(words, False))
            if heads:
                self._add(heads, self._words([x[1:] for x in heads], True))
            if marks:
                self._add(marks, self._each([x[2:] for x in marks]))
            if others:
                self._add(others, self._each([x if x[:1] == "\n" else self.prefix + x for x in others]))
            found[found < 0] = np.fromiter(map(self.rows.__getitem__, new), np.int64, len(new))
        return found

    def _add(self, keys: list[str], ids: Ragged) -> None:
        n = len(self.held.ends) - 1
        self.rows.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.held = self.held.add([ids])
        self.characters += sum(map(len, keys))

    def _pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces: of the word of letters and of the marks behind it, or of the whole piece."""
        core = pc.utf8_rtrim(pieces, characters=_MARKS)
        simple = pc.match_substring_regex(core, f"^\n?[{_LETTERS}]+$")
        whole = pc.if_else(simple, core, pieces)
        at = np.flatnonzero((pc.binary_length(pieces).to_numpy() > pc.binary_length(whole).to_numpy()))
        tails = ["\n\n" + x[n:] for x, n in zip(_strings(pieces.take(at)), pc.utf8_length(whole.take(at)).to_numpy().tolist(), strict=True)]
        keys, ends = whole.dictionary_encode(), pa.array(tails, pa.string()).dictionary_encode()
        n = len(keys.dictionary)
        rows = self._learn(_strings(keys.dictionary) + _strings(ends.dictionary))
        both = np.zeros((len(pieces), 2), np.int64)
        both[:, 0] = rows[:n][keys.indices.to_numpy()]
        both[at, 1] = rows[n:][ends.indices.to_numpy()]
        found = self.held.take(both.reshape(-1))
        found.ends = found.ends[::2]
        return found

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), each followed by `end`, and how many each has."""
        texts = texts.fill_null("")
        n, whole = len(texts), np.zeros(len(texts), bool)
        if self.rule == "none":
            whole[:] = True
        elif self.unsafe:
            whole = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False)
        alone = np.flatnonzero(whole)
        apart = self._each(texts.take(pa.array(alone)).to_pylist())
        if len(alone):
            texts = pc.if_else(pa.array(whole), pa.scalar(""), texts)
        if self.rule == "dropped":
            texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        else:
            texts = pc.replace_substring(texts, "\n", " \n")
        cut = pc.split_pattern(texts, " ")
        starts = (cut.offsets.to_numpy()[: n + 1] - cut.offsets[0].as_py()).astype(np.int64)
        words = cut.flatten()
        first = words.take(pa.array(starts[:-1])).dictionary_encode() if self.rule == "lone" else None
        words = words.dictionary_encode()
        known, at = self._pieces(words.dictionary), words.indices.to_numpy().astype(np.int64)
        more = []
        if first is not None:  # a first piece has no space before it
            at[starts[:-1]] = len(known.ends) - 1 + first.indices.to_numpy()
            more.append(self._each(_strings(first.dictionary)))
        # one more entry for each text, after its pieces
        tail = np.asarray([] if end is None else [end], "<u4")
        last = apart.add([Ragged(np.tile(tail, 1), np.asarray([len(tail)]))])
        row = np.full(n, len(alone))
        if len(alone):
            row[alone] = np.arange(len(alone))
            last = apart.add([Ragged(tail, np.asarray([len(tail)]))])
            ends = np.stack([np.where(whole, row, -1), np.full(n, len(alone))], axis=1).reshape(-1)
            last = last.take(ends[ends >= 0])
            sizes = 1 + whole
            last.ends = last.ends[np.concatenate([[0], np.cumsum(sizes)])]
            row = np.arange(n)
        before = len(known.ends) - 1 + sum(len(x.ends) - 1 for x in more)
        at = np.insert(at, starts[1:], before + row)
        found = known.add([*more, last]).take(at)
        ends = found.ends[starts + np.arange(n + 1)]
        return found.ids, np.diff(ends)


def tokenizer(path: str) -> PieceTokenizer:
    """One per Python worker and file."""
    return per_worker("tokenizer", path, lambda: PieceTokenizer(path))
