"""Token ids from a public tokenizer file, with a bounded memo of text units.

Both file kinds part a text around white space before any merge, so the ids of a text are the ids of its units in a
row: a stretch without white space, with the one space that leads it (byte-level files), or white space itself.
Units recur, so each worker keeps a bounded memo of them. Words of letters go to the file's BPE model as they are,
everything else through the whole tokenizer.

`word_row` takes many texts at once for word files: their bytes are cut into runs of letters, digits and other signs in
numpy, Arrow numbers the different ones, and only those meet the memo.
"""

from __future__ import annotations

import itertools
import os
import re
import string
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from tradewind.llm.memos import claim

_LOADED: dict[tuple[str, bool], ChunkTokenizer] = {}

#: Unicode's white space, as a character class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the space before it, white space up to the last of a run, and that last one.
SPACED_UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
PLAIN_UNIT = re.compile(f"[^{WHITE}]+")

LATIN_RUN = re.compile("[a-zß-öø-ÿ]+")

SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)


WHITE_BYTES = b" \t\n\v\f\r"


def _kinds() -> bytes:
    """What each byte of a text is, if the text has only ASCII and the letters of Latin-1, in UTF-8; OTHER: it has more.

    Apostrophes are OTHER too, since the pre-tokenizer of word files knows what follows them. Of the bytes behind 0xC3,
    0x97 and 0xB7 are the signs of multiplication and division.
    """
    kinds = bytearray([OTHER] * 0x80 + [LETTER] * 0x40 + [OTHER] * 0x40)
    signs = string.punctuation.replace("'", "").encode()
    for kind, some in ((SPACE, WHITE_BYTES), (LETTER, string.ascii_letters.encode() + b"\xc3"), (DIGIT, string.digits.encode()), (SIGN, signs), (OTHER, b"\x97\xb7")):
        for b in some:
            kinds[b] = kind
    return bytes(kinds)


KINDS = _kinds()
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    others = itertools.count(256)
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Memo(dict):
    """Unit to value, in two generations of at most `half` entries each.

    What is missing is taken over from the older generation or worked out. When the younger one is full it becomes
    the older one, so units that keep coming stay and the others go.
    """

    def __init__(self, work_out, half: int):
        super().__init__()
        self.work_out, self.half, self.older = work_out, half, {}

    def __missing__(self, unit: str) -> bytes:
        if (found := self.older.get(unit)) is None:
            found = self.work_out(unit)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[unit] = found
        return found

    def release(self) -> None:
        self.clear()
        self.older = {}


class ChunkTokenizer:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    spaced: the pre-tokenizer keeps a space in front of the word it leads (byte-level files); otherwise it drops
    white space (word files), and texts are composed and lower-cased. Texts with special-token strings go to the
    tokenizer whole.
    """

    #: What may follow a word of letters in one unit without changing the word's ids.
    TAIL = string.punctuation

    def __init__(self, path: str, spaced: bool, capacity: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = dict(enumerate(byte_alphabet()))
        self.letters, self.others = set(string.ascii_letters), set(" ")
        self.memo = Memo(self._worked_out, capacity // 2)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _is_word(self, word: str) -> bool:
        """Whether all characters are letters to the file's pre-tokenizer, which is asked once for each character."""
        if word and self.letters.issuperset(word):
            return True
        if not word or not self.others.isdisjoint(word):
            return False
        for c in set(word) - self.letters:
            stays = self.spaced or unicodedata.normalize("NFC", c).lower().isalpha() and not unicodedata.combining(c)
            one = c.isalpha() and stays and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a")) == 1
            (self.letters if one else self.others).add(c)
        return self.letters.issuperset(word)

    def _model_ids(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _worked_out(self, unit: str) -> bytes:
        if not self.spaced and LATIN_RUN.fullmatch(unit):
            return self._model_ids(unit)
        core = unit.rstrip(self.TAIL)
        word = core[1:] if self.spaced and core[:1] == " " else core
        if not self._is_word(word):
            return self._whole(unit)
        if core != unit:
            return self.memo[core] + self.memo[unit[len(core) :]]
        if not self.spaced:
            lower = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
            if lower != word and "σ" not in lower and "ς" not in lower:  # sigma has two lower forms
                return self.memo[lower]
            if lower != word or not self._is_word(lower):
                return self._whole(unit)
        mapped = core if word is core and core.isascii() else core.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _units(self, text: str) -> list[str]:
        if text.replace("\n", " ").isprintable():  # then its only white space is spaces and line breaks
            if not self.spaced:
                return text.split()
            if not any(pair in text for pair in ("  ", "\n\n", " \n", "\n ")):
                return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return (SPACED_UNIT if self.spaced else PLAIN_UNIT).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        claim(self, self.memo.release)
        ids = self.memo.__getitem__
        return [self._whole(t) if any(s in t for s in self.specials) else b"".join(map(ids, self._units(t))) for t in texts]

    def _runs(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The lower-cased runs of all texts, how many each text has, and the texts that are not looked into (they have none)."""
        begin = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2].slice(begin[0], begin[-1] - begin[0]).to_pybytes() if begin[-1] > begin[0] else b""
        begin = begin - begin[0]
        kinds = np.frombuffer(raw.translate(KINDS), dtype=np.uint8)
        strange = [np.flatnonzero(kinds == OTHER)]
        for special in (s.encode() for s in self.specials):
            strange.append(np.array([m.start() for m in re.finditer(re.escape(special), raw)], dtype=np.int64))
        whole = np.unique(np.searchsorted(begin, np.concatenate(strange), side="right") - 1)
        if len(whole):
            hidden = bytearray(raw)
            for t in whole.tolist():
                hidden[begin[t] : begin[t + 1]] = b" " * int(begin[t + 1] - begin[t])
            raw = bytes(hidden)
            kinds = np.frombuffer(raw.translate(KINDS), dtype=np.uint8)
        starts = kinds == DIGIT
        starts[1:] |= kinds[1:] != kinds[:-1]
        starts[begin[begin < len(raw)]] = True
        at = np.flatnonzero(starts)
        word = kinds[at] != SPACE
        ends = np.concatenate(([0], np.cumsum(np.diff(at, append=len(raw))[word])))
        counts = np.diff(np.searchsorted(at[word], begin))
        runs = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw.translate(LOWER, WHITE_BYTES))])
        return runs.dictionary_encode(), counts, whole

    def word_row(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All texts as one row of numbered words, how many words each has, and every word's ids as bytes.

        A text (null: empty) ends with the word whose ids are `end`. Texts of other characters than KINDS knows, or with
        special-token strings, are encoded as `encode` does, and each of their ids is a word.
        """
        claim(self, self.memo.release)
        texts = texts.cast(pa.large_string()).fill_null("")
        runs, counts, whole = self._runs(texts)
        ids = self.memo.__getitem__
        spelled = [end, *map(ids, runs.dictionary.to_numpy(zero_copy_only=False).tolist())]
        others = {t: np.frombuffer(self.encode([texts[t].as_py()])[0], dtype="<u4") for t in whole.tolist()}
        known = np.unique(np.concatenate(list(others.values()))) if others else np.zeros(0, dtype="<u4")
        before = counts.copy()  # runs
        for t, x in others.items():
            counts[t] = len(x)
        counts += 1
        begin = np.cumsum(counts) - counts
        row = np.zeros(int(counts.sum()), dtype=np.int64)
        row[np.repeat(begin - (np.cumsum(before) - before), before) + np.arange(len(runs))] = runs.indices.to_numpy() + 1
        for t, x in others.items():
            row[begin[t] : begin[t] + len(x)] = np.searchsorted(known, x) + len(spelled)
        return row, counts, spelled + [x.tobytes() for x in known]


def chunk_tokenizer(path: str, spaced: bool, memo: int = 1_000_000) -> ChunkTokenizer:
    """One for each worker process and file; its memo holds at most so many units (some 200 bytes each)."""
    if (path, spaced) not in _LOADED:
        _LOADED[path, spaced] = ChunkTokenizer(path, spaced, memo)
    _LOADED[path, spaced].memo.half = memo // 2
    return _LOADED[path, spaced]


def encoded(tokenizer: ChunkTokenizer, texts: list[str | None]):
    """The ids of texts in order (null: none), one text at a time."""
    for text in texts:
        yield tokenizer.encode([text])[0] if text else b""
