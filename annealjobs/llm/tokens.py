"""Token ids of texts with the tokenizers library, remembering what words give.

Both vocabularies that the operators use cut a text before encoding, never across a blank between two
visible characters, and between letters and signs that end a word; so a text's ids are those of such
pieces one after the other, and a piece that was seen before need not be encoded again. A batch of texts
is cut by its bytes, its different pieces are numbered by Arrow and looked up, and their ids are laid out
by number. Tokenizers whose settings are not one of these two kinds encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a generation; a worker remembers two, and pieces that come again move to the younger.
MOST_PIECES = 250_000
#: Signs after a word's letters: a piece of their own in either vocabulary.
_TAIL = ".,;:!?|*#$%&"
_ODD = re.compile(r"\s|\x00|<\|")
_BYTE = np.arange(256)
_BLANK, _SIGN = np.isin(_BYTE, [9, 10, 13, 32]), np.isin(_BYTE, list(_TAIL.encode()))
#: Bytes of ASCII letters and of the letters from U+00C0 to U+00FF, which are 0xC3 and another.
_UPPER = (_BYTE >= 65) & (_BYTE <= 90) | (_BYTE >= 0x80) & (_BYTE <= 0x9E) & (_BYTE != 0x97)
_LETTER = _UPPER | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 0x80) & (_BYTE <= 0xBF) & (_BYTE != 0x97) & (_BYTE != 0xB7) | (_BYTE == 0xC3)
_LAID = 1 << 18  # pieces whose ids are laid out in one step
_SLICE = 2 << 20  # bytes of texts that are cut together; a longer text is cut alone
_SIGNS = 32  # signs after a word's letters; a word with more is one piece
_TOGETHER = 50  # pieces in one text of a call: short texts are the library's fast path
_BAR = "\n|\n"


def _kind(path: str) -> str:
    with open(path) as f:
        j = json.load(f)
    split = j.get("pre_tokenizer") or {}
    if j.get("truncation") or j.get("padding") or any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in j.get("added_tokens", [])):
        return "whole"
    if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not j.get("normalizer"):
        return "spaced"  # a blank belongs to the word after it
    steps, changes = split.get("pretokenizers", []), (j.get("normalizer") or {}).get("normalizers", [])
    if split.get("type") == "Sequence" and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and not steps[1]["use_regex"] and [c["type"] for c in changes] == ["NFC", "Replace", "Lowercase"]:
        return "dropped"  # blanks are dropped
    return "whole"


class Words:
    """Encodes texts word by word. ids() and counts() equal the library's for the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), _kind(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # a separator that stands alone as one known id between two words
        self.between = {"spaced": "\n ", "dropped": " \x00 "}.get(self.kind, "")
        if self.between:
            sep = self.tokenizer.encode(f"a{self.between}a", add_special_tokens=False).ids
            self.kind, self.sep = (self.kind, sep[1]) if len(sep) == 3 else ("whole", 0)
        if self.kind != "whole":  # the same model for letters alone, which nothing normalises or cuts: a line a word
            from tokenizers import normalizers, pre_tokenizers

            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = normalizers.Sequence([])
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            bar = self.letters.encode(f"a{_BAR}a", add_special_tokens=False).ids
            self.kind, self.bar = (self.kind, bar[1]) if len(bar) == 3 else ("whole", 0)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str], letters: bool) -> None:
        """Learn visible pieces of one line: many a text, cut at the separator's id."""
        lead = " " if self.kind == "spaced" else ""
        between, sep, tokenizer = (_BAR + lead, self.bar, self.letters) if letters else (self.between, self.sep, self.tokenizer)
        groups = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        for some, e in zip(groups, tokenizer.encode_batch_fast([lead + between.join(g) for g in groups], add_special_tokens=False) if groups else ()):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == sep)
            if len(cuts) != len(some) - 1:
                self.known.update(zip(some, self._encode([lead + x for x in some])))
                continue
            raw, at = ids.tobytes(), [-4, *(4 * cuts).tolist(), 4 * len(ids)]
            for piece, s, e in zip(some, at, at[1:]):
                self.known[piece] = raw[s + 4 : e]

    def _learn(self, new: set[str]) -> None:
        """Put pieces into the younger generation, from the older one where it has them."""
        if len(self.known) + len(new) > MOST_PIECES:
            self.older, self.known = self.known, {}
        again = [w for w in new if w in self.older]
        for w in again:
            self.known[w] = self.older[w]
        letters, others, odd, lead = [], [], [], " " if self.kind == "spaced" else ""
        for w in new.difference(again):
            if w.isalpha() and (w.isascii() or max(w) < "\u0100") and (lead or w == w.lower()):
                letters.append(w)
            elif _ODD.search(w):
                odd.append(w)
            else:
                others.append(w)
        self._together(letters, True)
        self._together(others, False)
        self.known.update(zip(odd, self._encode([lead + w for w in odd]) if odd else ()))

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of a string column's texts, one after the other, and the number of each text's first piece (and the end).

        spaced: a word begins with its blank. dropped: it ends with one, and plain letters are small. A word of
        plain letters and signs after them is two pieces. Fewer cuts than there might be do no harm.
        """
        column = pc.fill_null(column.cast(pa.string()), "")
        edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        data = (np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8))[edges[0] : edges[-1]]
        edges = edges - edges[0]
        is_edge = np.zeros(len(data) + 1, bool)
        is_edge[edges] = True
        if self.kind == "dropped":
            cuts = np.flatnonzero(_BLANK[data]) + 1
        else:  # between visible characters of one text, if both are ASCII or Latin-1 letters or the like
            at = np.flatnonzero(data == 32)
            at = at[~is_edge[at] & ~is_edge[at + 1]]
            before, lead, after = data[at - 1], data[np.maximum(at - 2, 0)], data[at + 1]
            plain = (before > 32) & (before < 128) | (before >= 128) & (lead >= 0xC3) & (lead <= 0xDF)
            cuts = at[plain & ((after > 32) & (after < 128) | (after >= 0xC3) & (after <= 0xDF))]
        is_cut = is_edge.copy()
        is_cut[cuts] = True
        ends = np.flatnonzero(is_cut)
        # words, without their blank, that are letters and then signs
        lo, hi = ends[:-1].copy(), ends[1:].copy()
        if self.kind == "dropped":
            hi -= _BLANK[data[hi - 1]] if len(hi) else 0
        else:
            lo += data[lo] == 32
        core, ending = hi.copy(), np.flatnonzero(hi > lo)
        for _ in range(_SIGNS):
            ending = ending[_SIGN[data[core[ending] - 1]]]
            core[ending] -= 1
            ending = ending[core[ending] > lo[ending]]
        strange = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~_LETTER[data], out=strange[1:])
        simple = (core > lo) & (strange[core] == strange[lo])
        if self.kind == "dropped":
            inside = np.zeros(len(data) + 1, np.int8)
            inside[lo[simple]] += 1
            inside[core[simple]] -= 1
            data = data + np.where(np.cumsum(inside[:-1], dtype=np.int8).astype(bool) & _UPPER[data], np.uint8(32), np.uint8(0))
        else:
            simple &= lo > ends[:-1]  # a text's first word has no blank
        is_cut[core[simple & (core < hi)]] = True
        ends = np.flatnonzero(is_cut)
        pieces = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        return pieces, np.searchsorted(ends, edges)

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, as _cut gives them."""
        if self.kind == "dropped":
            keys, where = [w[:-1] if w[-1] in " \n\t\r" else w for w in pieces], None
        else:
            where = [i for i, w in enumerate(pieces) if w[0] == " "]
            keys = [pieces[i][1:] for i in where]
        found = list(map(self.known.get, keys))
        new = {w for w, x in zip(keys, found) if x is None}
        if new:
            self._learn(new)
            found = [self.known[w] if x is None else x for w, x in zip(keys, found)]
        if where is None:
            return found
        out = dict(zip(where, found))
        rest = [i for i in range(len(pieces)) if i not in out]  # signs after letters, or a text's first word: no blank before them
        out.update(zip(rest, self._encode([pieces[i] for i in rest]) if rest else ()))
        return [out[i] for i in range(len(pieces))]

    def _numbered(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
        """Of slices of a column: each piece's number among the different ones, those ones' ids, each piece's count of ids; first pieces of texts."""
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes, dtype=np.int64) // _SLICE
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(column)]
        for i, j in zip(edges, edges[1:]):
            pieces, first = self._cut(column.slice(i, j - i))
            coded = pieces.dictionary_encode()
            known, number = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
            size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
            yield number, known, size[number], first

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column's texts, without special tokens added, and where each text's begin (and the end). Nulls are empty."""
        if self.kind == "whole":
            each = self._encode([t or "" for t in column.to_pylist()])
            return np.frombuffer(b"".join(each), np.uint32), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each], dtype=np.int64)])
        outs, edges = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for number, known, size, first in self._numbered(column):
            flat = np.frombuffer(b"".join(known), np.uint32)
            at = np.cumsum([0, *(len(x) >> 2 for x in known)])
            ends = np.concatenate([[0], np.cumsum(size)])
            out = np.empty(ends[-1], np.uint32)
            for i in range(0, len(number), _LAID):
                j = min(i + _LAID, len(number))
                place = np.repeat(at[number[i:j]] - ends[i:j] + ends[i], size[i:j])
                place += np.arange(len(place))
                out[ends[i] : ends[j]] = flat[place]
            outs.append(out)
            edges.append(ends[first[1:]] + edges[-1][-1])
        return np.concatenate(outs), np.concatenate(edges)

    def counts(self, column: pa.Array) -> np.ndarray:
        """How many ids each text of a string column has. Nulls are empty."""
        if self.kind == "whole":
            return np.diff(self.encoded(column)[1])
        parts = [np.diff(np.concatenate([[0], np.cumsum(size)])[first]) for _, _, size, first in self._numbered(column)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without special tokens added."""
        out, at = self.encoded(pa.array(texts, pa.string()))
        return [out[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(maxsize=4)
def words(path: str) -> Words:
    """One encoder a worker process and tokenizer file."""
    return Words(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
