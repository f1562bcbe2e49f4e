"""Token ids of whole texts, with a cache of the words seen by this worker.

A pre-tokenizer that never joins characters across a blank makes the ids of a text the ids of its words in
turn. So each worker encodes a word once and then looks it up; the ids are those the `tokenizers` library
gives for the whole text.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How a tokenizer treats a single blank between two words.
BLANK_LEADS = "leads"  # it belongs to the word after it (byte-level pre-tokenizers)
BLANK_DROPS = "drops"  # it belongs to no token, and neither do letters together with punctuation

#: Words that a worker keeps, and their length. Longer ones and later ones are encoded in each batch anew; when these
#: are more than half of a batch, the text has changed and the worker starts over.
CACHE_WORDS, CACHE_WORD_CHARS = 700_000, 512
#: Words encoded in one call.
LEARN_AT_ONCE = 4096

#: A single blank between two characters that no tokenizer takes for white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


#: The key of a line end between two lines that neither begin nor end with white space.
_LINE_END = ("\n",)


class _Index(dict):
    """Numbers new keys as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number


def _is_ragged(key) -> bool:
    if key is None or key == _LINE_END:
        return False
    word = key[0] if type(key) is tuple else key
    return not word or word[0].isspace() or word[-1].isspace()


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype) -> None:
        self.data, self.size = np.empty(1024, dtype), 0

    def shorten(self, size: int) -> None:
        self.size = min(self.size, size)

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            grown = np.empty(max(end, 2 * len(self.data)), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : end] = values
        self.size = end


class CachedEncoder:
    """Encodes lists of texts; each text's ids are followed by `end_id` unless that is None."""

    def __init__(self, path: str, blank: str, end_id: int | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words are cut out of texts that name no added token
        self.whole = Tokenizer.from_file(path)
        named = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = "(?i)" + "|".join(named) if named else None
        self.blank, self.end_id = blank, end_id
        self.lowers = "Lowercase()" in str(self.tokenizer.normalizer)
        self.mark_id: list[int] | None = None
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.ids, self.starts, self.lengths = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int64)
        self.long = False
        self.ragged = _Grown(bool)  # words with white space at an end: a text with one is cut with care

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, line end and text end, and how many of them each text has."""
        leads = self.blank == BLANK_LEADS
        if leads:
            texts = pc.replace_substring(texts, "\n", " \n ")
        else:  # fewer different words: without case, where the tokenizer drops it, and without the stop at their end
            texts = pc.replace_substring(pc.ascii_lower(texts) if self.lowers else texts, "\n", " ")
            texts = pc.replace_substring_regex(texts, r"(\pL)([.,]) ", r"\1 \2 ")
        parts = pc.split_pattern(texts, " ")
        counts = np.diff(parts.offsets.to_numpy())
        ends = np.cumsum(counts)
        coded = parts.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        plain = np.ones(len(code), bool)  # words with a blank before them, or in a mode where that makes no difference
        line_end = np.zeros(len(code), bool)
        if leads:
            if "\n" in names:
                line_end = code == names.index("\n")
            plain[(ends - counts)] = False
            plain[1:] &= ~line_end[:-1]
        places = np.empty(len(code), np.int64)
        for some, key in ((plain & ~line_end, None), (~plain & ~line_end, tuple)):
            used = np.flatnonzero(np.bincount(code[some], minlength=len(names)))
            numbers = np.zeros(len(names), np.int64)
            keys = [names[k] for k in used.tolist()]
            keys = [(k,) for k in keys] if key else keys
            numbers[used] = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
            places[some] = numbers[code[some]]
        if line_end.any():
            places[line_end] = self.index[_LINE_END]
        if self.end_id is not None:
            places, counts = np.insert(places, ends, self.index[None]), counts + 1
        self._learn(False)
        return places, counts

    def _careful(self, text: str) -> np.ndarray:
        """The same for one text with white space at an end of a word."""
        keys: list = _CUT.split(text) if text else []
        if keys:
            keys[0] = (keys[0],)
        if self.end_id is not None:
            keys.append(None)
        places = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        self._learn(True)
        return places

    def _learn(self, careful: bool) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        lead = " " if self.blank == BLANK_LEADS else ""
        texts = [
            "" if key is None else key[0] if type(key) is tuple else lead + key for key in new
        ]
        self.long |= max(map(len, texts)) > CACHE_WORD_CHARS
        for at in range(0, len(texts), LEARN_AT_ONCE):  # an encoding is a large object
            ids, lengths = self._encode_words(texts[at : at + LEARN_AT_ONCE])
            if None in new[at : at + LEARN_AT_ONCE]:
                k = new.index(None) - at
                ids = np.insert(ids, int(lengths[:k].sum()), self.end_id)
                lengths[k] = 1
            self.starts.extend(self.ids.size + np.cumsum(lengths) - lengths)
            self.lengths.extend(lengths)
            self.ids.extend(ids)
        if careful or self.blank == BLANK_DROPS:
            self.ragged.extend(np.zeros(len(new), bool))
        else:
            self.ragged.extend(np.fromiter(map(_is_ragged, new), bool, len(new)))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, and how many each has: encoded as one text with a mark after each word.

        The mark is a token of its own next to any word. Words that hold a mark or other white space go one by one.
        """
        mark, sign = ("\n", "\n") if self.blank == BLANK_LEADS else (" \x01 ", "\x01")
        plain = [sign not in w and (not w or len(w.split()) == 1) for w in words]
        if self.mark_id is None:
            self.mark_id = self.tokenizer.encode(mark, add_special_tokens=False).ids
        joined = "".join([w + mark for w, p in zip(words, plain) if p])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == self.mark_id[0])
        if len(self.mark_id) != 1 or len(at) != sum(plain):
            plain, at, ids = [False] * len(words), np.zeros(0, np.int64), ids[:0]
        lengths = np.zeros(len(words), np.int64)
        lengths[plain] = np.diff(at, prepend=-1) - 1
        ids = np.delete(ids, at)
        if not all(plain):
            odd = [k for k, p in enumerate(plain) if not p]
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for k, found in zip(odd, self.tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False)):
                parts[k] = np.array(found.ids, np.uint32)
                lengths[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, lengths

    def _forget(self, known: int, words: int) -> None:
        """Keep at most CACHE_WORDS words; `known` of them were there before this batch of so many words."""
        late = len(self.index) - max(known, CACHE_WORDS)
        if late > 0 and 2 * late > words:
            self._reset()
        elif late > 0 or self.long:
            keep = known if self.long else CACHE_WORDS
            for key in list(itertools.islice(reversed(self.index), len(self.index) - keep)):
                del self.index[key]
            if keep:
                self.ids.shorten(int(self.starts.data[keep - 1] + self.lengths.data[keep - 1]))
            for kept in (self.starts, self.lengths, self.ragged):
                kept.shorten(keep)
            self.long = False

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has. A null text counts as empty.

        Texts that name an added token are encoded by the library as a whole; there are few.
        """
        texts = texts.fill_null("")
        if self.added:
            named = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
            if named.any():
                return self._with_named(texts, np.flatnonzero(named))
        return self._encode(texts)

    def _with_named(self, texts: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        others = np.ones(len(texts), bool)
        others[rows] = False
        flat, lengths = self._encode(pc.if_else(pa.array(others), texts, ""))
        parts = np.split(flat, np.cumsum(lengths)[:-1])
        ends = [] if self.end_id is None else [self.end_id]
        for row in rows.tolist():
            parts[row] = np.array(self.whole.encode(texts[row].as_py(), add_special_tokens=False).ids + ends, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known = len(self.index)
        at, counts = self._places(texts)
        ragged = self.ragged.data[at]
        if ragged.any():
            rows = np.unique(np.searchsorted(np.cumsum(counts), np.flatnonzero(ragged), side="right"))
            parts = np.split(at, np.cumsum(counts)[:-1])
            for row in rows.tolist():
                parts[row] = self._careful(texts[row].as_py())
                counts[row] = len(parts[row])
            at = np.concatenate(parts)
        lengths = self.lengths.data[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total) + np.repeat(self.starts.data[at] - ends + lengths, lengths)
        flat = self.ids.data[gather]
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        self._forget(known, len(at))
        pa.default_memory_pool().release_unused()
        return flat, np.diff(upto, prepend=0)


@functools.lru_cache(maxsize=1)
def encoder(path: str, blank: str, end_id: int | None) -> CachedEncoder:
    """One encoder per worker process: that of the last setting."""
    return CachedEncoder(path, blank, end_id)
