"""Word-memo front end to a ``tokenizers`` vocabulary.

``WordEncoder`` gives the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives,
sooner: a text is cut at ASCII white space, and each distinct word is encoded once per worker.
That is exact only for a tokenizer that drops white space and treats what lies between as its
own; the encoder reads the tokenizer's own description and, for any other tokenizer, encodes
whole texts plainly. Words with characters from U+0180 on go through the full tokenizer.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain

import numpy as np

#: The parts of a tokenizer description that make white space a boundary.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MEMO_WORDS = 600_000  # words, and as many pieces, that a worker remembers within a task

# What white-space splitting and plain lower-casing leave alone: printable characters below U+0180 but U+0130.
_plain = re.compile("[ -~\xa1-\u012f\u0131-\u017f]+")
# The tokenizer's own split for such characters, lower-cased.
_pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")
_encoders: dict[str, "WordEncoder"] = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> "WordEncoder":
    """One encoder per process and vocabulary, with an empty memo: idle workers keep none."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].forget()
    _encoders[path].memo_words = memo_words
    return _encoders[path]


class _Codes(dict):
    """Numbers keys in the order of their first look-up; ``new`` has those not yet dealt with."""

    def __init__(self):
        self.new = []

    def __missing__(self, key):
        code = self[key] = len(self)
        self.new.append(key)
        return code


class _Pool:
    """Id sequences by code: one growing array with a start and a length for each code."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def put(self, codes, ids, sizes) -> None:
        """``ids``: the sequences of ``codes`` one behind the other."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(codes) and codes.max() >= len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[codes] = self.used + np.cumsum(sizes) - sizes
        self.size[codes] = sizes
        self.used += len(ids)

    def get(self, codes):
        """(ids of ``codes`` one behind the other, their sizes)."""
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[codes] - ends + sizes, sizes) + np.arange(total)], sizes


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full, self.memo_words = Tokenizer.from_file(path), MEMO_WORDS
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        norm = [n["type"] for n in (about.get("normalizer") or {}).get("normalizers", [])]
        split = ((about.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        suffix = about["model"].get("end_of_word_suffix")
        self.by_word = norm == WORD_NORMALIZERS and split == WORD_PATTERN and bool(suffix)
        self.vocab_size = self.full.get_vocab_size(with_added_tokens=True)
        self.forget()
        if self.by_word:
            self.specials = [t["content"] for t in about.get("added_tokens", [])]
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.is_end = np.zeros(self.vocab_size, bool)
            for token, i in about["model"]["vocab"].items():
                self.is_end[i] = token.endswith(suffix)

    def forget(self) -> None:
        self.words, self.word_ids = _Codes(), _Pool()
        self.pieces, self.piece_ids = _Codes(), _Pool()

    def _full(self, text: str):
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn_pieces(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        for i in range(0, len(new), 1 << 15):
            part = new[i : i + (1 << 15)]
            lines = [" ".join(part[k : k + 64]) for k in range(0, len(part), 64)]  # short inputs encode faster than one long one
            found = self.bare.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), dtype="<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):
                each = [self._full(p) for p in part]
                ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            first = len(self.pieces) - len(new) + i
            self.piece_ids.put(np.arange(first, first + len(part)), ids, np.diff(ends, prepend=0))

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        codes = np.arange(len(self.words) - len(new), len(self.words))
        words = [w.decode("utf-8") for w in new]
        joined = " ".join(words)
        if not _plain.fullmatch(joined) or any(s in joined for s in self.specials):
            easy = np.array([bool(_plain.fullmatch(w)) and not any(s in w for s in self.specials) for w in words])
            for code, word, ok in zip(codes, words, easy):
                if not ok:
                    ids = self._full(word)
                    self.word_ids.put(np.array([code]), ids, np.array([len(ids)]))
            codes, words = codes[easy], [w for w, ok in zip(words, easy) if ok]
        if not words:
            return
        cut = _pieces.findall
        groups = [(w,) if w.isalpha() else cut(w) for w in " ".join(words).lower().split(" ")]
        flat = list(map(self.pieces.__getitem__, chain.from_iterable(groups)))
        self._learn_pieces()
        ids, sizes = self.piece_ids.get(np.array(flat))
        last = np.cumsum([len(g) for g in groups])
        self.word_ids.put(codes, ids, np.diff(np.cumsum(sizes)[last - 1], prepend=0))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [self._full(t.decode("utf-8")).tobytes() for t in texts]
        if len(self.words) > self.memo_words or len(self.pieces) > self.memo_words:
            self.forget()
        gc.disable()  # only lists of strings are made below; tracing them costs a quarter of the time
        try:
            return self._encode_words([t.split() for t in texts])
        finally:
            gc.enable()

    def _encode_words(self, split: list[list[bytes]]) -> list[bytes]:
        codes = np.array(list(map(self.words.__getitem__, chain.from_iterable(split))), dtype=np.int64)
        if self.words.new:
            self._learn()
        ids, sizes = self.word_ids.get(codes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0] + [len(w) for w in split])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def text_slices(column, limit: int = 1_000_000, rows: int = 256):
    """(first row, UTF-8 texts) of an Arrow string column, about a MB at a time; null is empty."""
    import pyarrow as pa

    for a in range(0, len(column), rows):
        part = column.slice(a, rows).cast(pa.large_binary())
        start, held, size = a, [], 0
        for i in range(len(part)):
            held.append(part[i].as_py() or b"")
            size += len(held[-1])
            if size >= limit:
                yield start, held
                start, held, size = a + i + 1, [], 0
        if held:
            yield start, held
