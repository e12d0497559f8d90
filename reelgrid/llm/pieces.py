"""Tokens of whole texts from those of their pieces, which are cached.

A text is split before spaces that no token can cross, so that the tokens of the text are those of its pieces in turn.
Most pieces occur again and again: only new ones go to the library, many at once. The cache of a worker process is
emptied when it holds `limit` pieces, so memory is bounded; a text without a safe place goes to the library whole.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_loaded: dict = {}


class ByteLevelPieces:
    """Ids of a byte-level BPE of the tokenizers library, add_special_tokens=False.

    Its pattern never joins a character to a space after it, whatever follows: any space after a character that is not
    white space begins a new token. The library still sees the special strings, which hold no space.
    """

    def __init__(self, path: str, limit: int = 800_000) -> None:
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        names = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(names.values()) + 1, bool)
        self.opens[[i for t, i in names.items() if t.startswith("Ġ")]] = True
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}  # word after a space -> place of its ids; -1: not a safe piece
        self.head: dict[str, int] = {}  # word that begins a text
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, into: dict[str, int], words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        into.update(zip(words, range(len(self.first) - 1, len(self.first) - 1 + len(words)), strict=True))
        self.flat = np.concatenate((self.flat, ids))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(size)))

    def _learn(self, new: list[str]) -> None:
        """A space and a word without one open with a token that begins with a space, the only one: many go at once."""
        safe = [w for w in new if w and w == w.strip()]
        if len(safe) < len(new):
            self.at.update(dict.fromkeys(set(new).difference(safe), -1))
        ids, size = [], []
        for lo in range(0, len(safe), 400):
            some = safe[lo : lo + 400]
            x = self._encode([" " + " ".join(some)])[0]
            cut = np.flatnonzero(self.opens[x])
            if len(cut) == len(some) and cut[0] == 0:
                ids.append(x)
                size.append(np.diff(np.append(cut, len(x))))
            else:
                each = self._encode([" " + w for w in some])
                ids += each
                size.append(np.array([len(e) for e in each]))
        if safe:
            self._keep(self.at, safe, np.concatenate(ids), np.concatenate(size))

    def ids(self, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, each followed by end, and the number of each text's. null is empty.

        Words are split and told apart in Arrow; only the different ones of a call are looked up in the cache.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.at) + len(self.head) > self.limit:
            self._clear()
        split = pc.split_pattern(pc.fill_null(column, "") if column.null_count else column, " ")
        edge, words = split.offsets.to_numpy().astype(np.int64), split.values
        first = words.take(pa.array(edge[:-1])).to_pylist()
        if heads := list(set(first).difference(self.head)):
            each = self._encode(heads)
            self._keep(self.head, heads, np.concatenate(each), np.array([len(e) for e in each]))
        coded = words.dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        inner = np.ones(len(code), bool)
        inner[edge[:-1]] = False
        used = np.zeros(len(names), bool)
        used[code[inner]] = True
        place = np.fromiter(map(self.at.get, names, repeat(-2)), np.int64, len(names))
        if len(missing := np.flatnonzero((place == -2) & used)):
            new = [names[i] for i in missing]
            self._learn(new)
            place[missing] = [self.at[w] for w in new]
        index = place[code]
        index[edge[:-1]] = [-1 if w[-1:].isspace() else self.head[w] for w in first]
        hard = np.unique(np.searchsorted(edge, np.flatnonzero(index < 0), "right") - 1)
        known = pa.LargeListArray.from_arrays(pa.array(self.first), pa.array(self.flat))
        found = known.take(pa.array(index, mask=index < 0))
        flat = found.flatten().to_numpy()
        count = np.diff(found.offsets.to_numpy()[edge])
        if len(hard):  # these go to the library whole
            parts = np.split(flat, np.cumsum(count)[:-1])
            for i, x in zip(hard, self._encode([column[i].as_py() or "" for i in hard]), strict=True):
                parts[i] = x
            flat, count = np.concatenate(parts), np.array([len(x) for x in parts])
        if end is None:
            return flat, count
        out = np.full(len(flat) + len(count), end, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(count)), count)] = flat
        return out, count + 1


class SentencePieces:
    """Token counts of a sentencepiece model, as it encodes by default.

    A piece of the text starts at a run of spaces; the library puts a space before each text, so the first of the run
    is left out. That holds for models that put a space before, keep runs of spaces, change no character and have no
    token with a space after another character; other models get whole texts.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        import sentencepiece

        self.library, self.limit, self.count = sentencepiece.SentencePieceProcessor(model_file=path), limit, {}
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        one = self.library.encode
        probe = ["a  b", " a", "a ", "ﬁ ½ Å", "a\n b"]
        same = all("".join(one(x, out_type=str)).replace("<0x0A>", "\n") == "▁" + x.replace(" ", "▁") for x in probe)
        self.splits = same and not any("▁" in n.lstrip("▁") for n in names)

    def _pieces(self, text: str) -> list[str]:
        if not self.splits or "▁" in text:
            return [text]
        words = text.split(" ")
        if "" not in words:
            return words
        parts = re.split(r"(?<=[^ ])(?= )", text)
        return [parts[0], *(p[1:] for p in parts[1:])]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.count) > self.limit:
            self.count.clear()
        known = self.count
        pieces = [self._pieces(t) if t else [] for t in texts]
        new = list(set().union(*pieces).difference(known))
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            # an empty piece is a space at the end of a text, without the one that the library adds
            known.update(zip(some, (len(x) if p else 1 for p, x in zip(some, self.library.encode(some, num_threads=1), strict=True)), strict=True))
        return [sum(map(known.__getitem__, ps)) for ps in pieces]


def loaded(kind: type, path: str):
    """The worker process's encoder of that file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def default_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
