"""Whole-text encoding with a `tokenizers` file, each distinct piece once.

A pre-tokenizer never joins characters across certain borders: a non-space
and a following space, a letter and a following ASCII punctuation mark, a
single line break and its neighbours. Texts are cut there, each distinct piece
is encoded by the library and its ids are kept for the next batch, so a text's
ids are its pieces' ids in a row. Texts with white space in front of a space
(where the border may lie elsewhere) and texts that hold an added token of the
file (`<|endoftext|>`, one id by the library's default) are encoded whole.
"""

from __future__ import annotations

import ctypes
import os
import sys
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, the `\s` of the pre-tokenizers.
WS = '\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000'
LATIN = 'A-Za-zÀ-ÖØ-öø-ÿ'
PUNCT = r'!-/:-@\[-`{-~'
_ODD = f'[{WS}] |\x00'
_BORDERS = ((f'([{LATIN}])([{PUNCT}])', '\\1\x00\\2'), (f'([{LATIN}{PUNCT}])\n([^{WS}])', '\\1\x00\n\x00\\2'))
#: Pieces kept per worker (about 200 bytes each); a full table is emptied but for
#: the pieces just looked up, so the number trades memory for time and changes no result.
CACHE_PIECES = 700_000
_ENCODERS: dict[str, 'Encoder'] = {}


class Encoder:
    """Little-endian ids of whole texts; two bytes each where the vocabulary
    allows (`width`), else four."""

    def __init__(self, path: str, keep: int = CACHE_PIECES):
        self.keep = keep
        os.environ.setdefault('TOKENIZERS_PARALLELISM', 'false')
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f'<u{self.width}')
        # a separator that is a piece of its own in front of any word
        self.keeps_space = self._ids(['\n'])[0] != b''
        self.sep = '\n' if self.keeps_space else ' , '
        self.sep_id = self.tok.encode(self.sep, add_special_tokens=False).ids[-1]
        self.ends = None if self.keeps_space else self._word_ends(pre_tokenizers.ByteLevel.alphabet())
        # ASCII case may go first where the file's own normalizer lowers all case
        self.lowers = self._ids(['Ab']) == self._ids(['ab'])
        added = self.tok.get_added_tokens_decoder().values()
        #: Texts with one of these are encoded whole: pieces would be cut inside.
        self.added = [x.content.encode().lower().decode() if self.lowers else x.content for x in added]
        # a token that is looked for in normalized text cannot be seen in raw text
        self.cuts = self.tok.normalizer is None or not any(x.normalized for x in added)
        # a known piece's number; piece i has the ids flat[upto[i]:upto[i + 1]]
        self.known: dict[str, int] = {}
        self.flat, self.upto = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ends(self, alphabet) -> np.ndarray | None:
        """By id, whether it ends a word, where each byte has a token that marks
        the end of a word, so that every word ends in one; else None."""
        suffix, vocab = getattr(self.tok.model, 'end_of_word_suffix', None), self.tok.get_vocab()
        if not suffix or any(x + suffix not in vocab for x in alphabet):
            return None
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        return ends

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids in a row and how many each has."""
        raw = self._ids(pieces)
        return (np.frombuffer(b''.join(raw), self.dtype),
                np.fromiter(map(len, raw), np.int64, len(raw)) // self.width)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, from one text that joins them: split again
        behind the ids that end a word, or at the separator's id where the file
        has none or takes a word for several."""
        if self.ends is not None:
            ids, _ = self._each([' '.join(words)])
            cut = np.flatnonzero(self.ends[ids])
            if len(cut) == len(words):
                return ids, np.diff(cut, prepend=-1)
        ids, _ = self._each([self.sep.join(words)])
        cut = np.flatnonzero(ids == self.sep_id)
        if len(cut) != len(words) - 1:
            return self._each(words)
        return np.delete(ids, cut), np.diff(cut, prepend=-1, append=len(ids)) - 1

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: plain words many at a time in one joined text,
        anything else one by one."""
        words, rest = [], []
        for p in pieces:
            (words if p.isalpha() or (p[:1] == ' ' and p[1:].isalpha()) else rest).append(p)
        parts = [self._joined(words[i:i + 2048]) for i in range(0, len(words), 2048)]
        if rest:
            parts.append(self._each(rest))
        self.known.update(zip(words + rest, range(len(self.known), len(self.known) + len(pieces))))
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(np.concatenate([n for _, n in parts]))])

    def _take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces in a row and where each ends."""
        n = self.upto[numbers + 1] - self.upto[numbers]
        ends = np.cumsum(n)
        at = np.repeat(self.upto[numbers] - (ends - n), n)
        return self.flat[at + np.arange(len(at))], ends

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, new ones learned."""
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(numbers < 0).tolist()
        if missing:
            new = [pieces[i] for i in missing]
            if len(self.known) + len(new) > self.keep:
                # full: only what these pieces need stays
                old = np.flatnonzero(numbers >= 0)
                self.flat, ends = self._take(numbers[old])
                self.upto = np.concatenate(([0], ends))
                numbers[old] = np.arange(len(old))
                self.known = {pieces[i]: k for k, i in enumerate(old.tolist())}
            self._learn(new)
            numbers[missing] = [self.known[p] for p in new]
        return numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if not self.cuts:
            return self._ids(texts)
        arr = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(arr, _ODD)
        cut = pc.ascii_lower(arr) if self.lowers else arr
        for x in self.added:
            odd = pc.or_(odd, pc.match_substring(cut, x))
        cut = pc.if_else(odd, '', cut)
        for border, to in _BORDERS:
            cut = pc.replace_substring_regex(cut, border, to)
        cut = pc.replace_substring(cut, ' ', '\x00 ' if self.keeps_space else '\x00')
        lists = pc.split_pattern(cut, '\x00')
        coded = lists.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, ends = self._take(numbers[coded.indices.to_numpy()])
        at = np.concatenate(([0], ends))[lists.offsets.to_numpy()] * self.width
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, x in zip(whole, self._ids([texts[i] for i in whole]) if whole else ()):
            out[i] = x
        return out


def encoder(path: str, keep: int = CACHE_PIECES) -> Encoder:
    """The worker's encoder for a file, loaded once per process."""
    if path not in _ENCODERS:
        release()
        _ENCODERS[path] = Encoder(path, keep)
    return _ENCODERS[path]


def forget() -> None:
    """Free the worker's encoders; later stages run in the same processes."""
    _ENCODERS.clear()
    release()


def release() -> None:
    """Give memory that is free but still the process's back to the system:
    what earlier stages used in the same worker counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == 'linux':
        # glibc keeps freed texts' pages below any block that is in use
        trim = getattr(ctypes.CDLL(None), 'malloc_trim', None)
        if trim:
            trim(0)
