"""Encoding whole texts with a public byte-level tokenizer, each distinct piece once.

The tokenizer's own splitting never joins a character that is not white space with a
blank or line break after it. So a text may be cut before every blank (or line break)
that stands alone between other characters, and its ids are those of the pieces in
order. Pieces repeat: Arrow gives the distinct ones of a batch, and a worker remembers the
ids of short ones. Texts with neighbouring white space are cut only where that rule holds.

The vocabulary file is read on the driver and sent to the workers as text; names of
added (special) tokens inside a text are ordinary text or, with ``names_are_text=False``,
the one id each; texts that contain such a name are encoded whole then.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NEIGHBOURS = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ ]\S)")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = r"!-/:-@\[-`{-~"
_WORD = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")
_LONGEST_KEPT = 48
_MOST_KEPT = 1 << 20
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_vocabulary(path: str | None = None) -> str:
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        return file.read()


class Encoder:
    """Ids as little-endian bytes: two bytes an id if the vocabulary allows, else four."""

    def __init__(self, vocabulary: str, most_kept: int = _MOST_KEPT, names_are_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(vocabulary)
        self._tokenizer.encode_special_tokens = names_are_text
        names = () if names_are_text else [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._named = [name for name in names if name]
        self._blank = self._tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self._ask = self._tokenizer.model.tokenize
        self._signs = self._signs_of_words()
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._marks: dict[str, bytes] = {}  # of single ones
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # kept before the last turn; what is asked for again moves up
        self._most_kept = most_kept

    def _plain(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in encoded]

    def _signs_of_words(self) -> dict[int, str] | None:
        """The model's signs for each letter of a word, or None if the vocabulary does not split
        a blank, letters and marks into two tokens of one sign a byte."""
        signs = lambda text: [token for token, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        letters = "".join(c for c in map(chr, range(0x250)) if re.match(f"[{_LETTERS}]", c))
        marks = "".join(c for c in map(chr, range(0x80)) if re.match(f"[{_MARKS}]", c))
        found = {ord(c): "".join(signs(c)) for c in letters}
        fits = signs(f" {letters}{marks}") == [self._blank + letters.translate(found), marks]
        return found if fits and self._tokenizer.normalizer is None else None

    def _asked(self, signs: str) -> bytes:
        ids = [token.id for token in self._ask(signs)]
        return struct.pack(f"<{len(ids)}{self._code}", *ids)

    def _word(self, key: str) -> bytes | None:
        """Ids of a blank, letters and perhaps marks. A blank and letters are one token of the
        splitting, and marks after them another, so the model may be asked for them directly."""
        if self._signs is None or not (parts := _WORD.fullmatch(key)):
            return None
        letters, marks = parts.groups()
        ids = self._kept.get(letters) or self._older.get(letters)
        if ids is None:
            ids = self._asked(self._blank + (letters if letters.isascii() else letters.translate(self._signs)))
        if not marks:
            return ids
        if len(letters) <= _LONGEST_KEPT:
            self._kept[letters] = ids
        if len(marks) > 1:
            return ids + self._asked(marks)
        if marks not in self._marks:
            self._marks[marks] = self._asked(marks)
        return ids + self._marks[marks]

    def _pieces(self, keys: list[str]) -> list[bytes]:
        """Ids of the pieces that distinct keys stand for."""
        found, rest = [*map(self._kept.get, keys)], []
        for at in [at for at, ids in enumerate(found) if ids is None]:
            key = keys[at]
            if ids := self._older.get(key) or self._word(key):
                found[at] = ids
                if len(key) <= _LONGEST_KEPT:
                    self._kept[key] = ids
            else:
                rest.append(at)
        texts = [key if key[:1] == "\n" else " " + key for key in (keys[at] for at in rest)]
        for at, ids in zip(rest, self._plain(texts)):
            found[at] = ids
            if len(keys[at]) <= _LONGEST_KEPT:
                self._kept[keys[at]] = ids
        return found

    def _cut(self, texts: list[str | None]) -> tuple[list[int], list[str], pa.Array, np.ndarray]:
        """The texts' order, their first pieces and the keys of the others with their number a
        text: a key stands for a blank and itself, or for itself if it begins with a line break."""
        plain, odd, heads, keys, counts = [], [], [], [], []
        for at, text in enumerate(texts):
            if text and any(name in text for name in self._named):
                first, rest = text, []
            elif text and _NEIGHBOURS.search(text):
                first, *rest = _SAFE_CUT.split(text)
            else:
                plain.append(at)
                continue
            odd.append(at)
            heads.append(first)
            keys += [piece[1:] for piece in rest]
            counts.append(len(rest))
        whole = pa.array([texts[at] or "" for at in plain], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(whole, "\n", " \n"), " ")
        sizes, pieces = pc.list_value_length(split).to_numpy().astype(np.int64), split.flatten()
        is_head = np.zeros(len(pieces), bool)
        is_head[np.cumsum(sizes) - sizes] = True
        heads = pieces.filter(pa.array(is_head)).to_numpy(zero_copy_only=False).tolist() + heads
        others = pa.concat_arrays([pieces.filter(pa.array(~is_head)), pa.array(keys, pa.large_string())])
        return plain + odd, heads, others, np.concatenate([sizes - 1, np.array(counts, np.int64)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; call with batches of bounded size."""
        if len(self._kept) > self._most_kept // 2:
            self._kept, self._older = {}, self._kept
        order, heads, keys, counts = self._cut(texts)
        coded = keys.dictionary_encode()
        known = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        n_keys, width = len(known), self.dtype.itemsize
        known += self._plain(heads)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // width
        ends = np.cumsum(counts + 1)  # in pieces, the first of each text included
        used = np.empty(len(keys) + len(heads), np.int64)
        is_head = np.zeros(len(used), bool)
        is_head[ends - counts - 1] = True
        used[is_head] = n_keys + np.arange(len(heads))
        used[~is_head] = coded.indices.to_numpy()
        sizes = lengths[used]
        stops = np.cumsum(sizes)
        place = np.repeat((np.cumsum(lengths) - lengths)[used] - (stops - sizes), sizes)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(known), self.dtype)[place].tobytes()
        out, begin = [b""] * len(texts), 0
        for at, stop in zip(order, (stops[ends - 1] * width).tolist()):
            out[at], begin = ids[begin:stop], stop
        return out


_shared: list[tuple[tuple[str, bool], Encoder]] = []


def shared_encoder(vocabulary: str, names_are_text: bool = True) -> Encoder:
    """The encoder of this worker process, with what earlier tasks have taught it."""
    asked = vocabulary, names_are_text
    if not _shared or _shared[0][0] != asked:
        _shared[:] = [(asked, Encoder(vocabulary, names_are_text=names_are_text))]
    return _shared[0][1]


def in_parts(texts: Iterable[str | None], most_rows: int = 200, most_chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """Lists of neighbouring texts, each bounded in rows and characters (or one text)."""
    part: list[str | None] = []
    chars = 0
    for text in texts:
        if part and (len(part) >= most_rows or chars + len(text or "") > most_chars):
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text or "")
    if part:
        yield part
