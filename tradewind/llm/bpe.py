"""BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Whether two neighbouring symbols end up in one token can only depend on so many symbols to their right: to take a
token's last part away, a merge of lower rank must join that part with what follows, whose own last part may be
taken away by a merge of still lower rank, and so on. The longest such chain that can begin at a token is its
sufficient lookahead; a token that ends at least so far before the end of what was read is stable and is emitted,
inside a word as well. Between two symbols that no merge joins, whatever stands around them, all that was read is
stable at once; so it is behind a symbol that no merge takes to its right, such as a word's last one.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.memos import claim
from tradewind.llm.tokenization import PLAIN_UNIT, WHITE, ChunkTokenizer, Memo, byte_alphabet

ID_BITS = 32


class Merges:
    """A ranked merge list over integer symbols: rules are (left, right, result), best first."""

    def __init__(self, rules: list[tuple[int, int, int]]):
        self.rules = rules
        self.by_pair: dict[int, int] = {}
        for rank, (a, b, c) in enumerate(rules):
            self.by_pair.setdefault(a << ID_BITS | b, rank << ID_BITS | c)
        self.need = self._sufficient_lookahead()
        self.lookahead = max(self.need.values(), default=0)
        self.parts = {c: (a, b) for a, b, c in reversed(rules)}
        self.spans: dict[int, int] = {}
        self.joined = self._joined()  # neighbouring symbols that some merge may bring into one token
        self.goes_on = {pair >> ID_BITS for pair in self.joined}  # symbols that a merge may join to what follows
        self.early = 0  # tokens that were emitted inside a word, before its last symbol was read

    def _joined(self) -> set[int]:
        """Pairs of the last symbol of a rule's left part and the first one of its right part."""
        first: dict[int, set[int]] = {}
        last: dict[int, set[int]] = {}
        growing = True
        while growing:
            growing = False
            for a, b, c in self.rules:
                for ends, part in ((first, a), (last, b)):
                    more = ends.get(part, set()) | {part}
                    if not more <= ends.setdefault(c, set()):
                        ends[c] |= more
                        growing = True
        return {x << ID_BITS | y for a, b, _ in self.rules for x in {a, *last.get(a, ())} for y in {b, *first.get(b, ())}}

    def _sufficient_lookahead(self) -> dict[int, int]:
        """For each token the most symbols after it that can decide whether it stays whole.

        reach[x]: how far the rules so far that start with x can look behind x. below[t]: the same for the last
        parts inside t, under the rules that come before t is formed. A rule acts once its own parts can exist.
        In a list in which a rule comes before what its parts are made of, no token is ever sure (files have none).
        """
        made: set[int] = set()
        later = {c for _, _, c in self.rules}
        for a, b, c in self.rules:
            if any(part in later and part not in made for part in (a, b)):
                return dict.fromkeys(later | {x for rule in self.rules for x in rule}, 1 << 60)
            made.add(c)
        length: dict[int, int] = {}
        acts: dict[int, int] = {}
        order = []
        for rank, (a, b, c) in enumerate(self.rules):
            at = max(rank, acts.get(a, -1), acts.get(b, -1))
            acts[c] = min(acts.get(c, at), at)
            length[c] = max(length.get(c, 0), length.get(a, 1) + length.get(b, 1))
            order.append((at, rank))
        reach: dict[int, int] = {}
        below: dict[int, int] = {}
        for _, rank in sorted(order):
            a, b, c = self.rules[rank]
            behind = max(reach.get(b, 0), below.get(b, 0))
            below[c] = max(below.get(c, 0), behind)
            reach[a] = max(reach.get(a, 0), length.get(b, 1) + behind)
        return {t: max(reach.get(t, 0), below.get(t, 0)) for t in reach.keys() | below.keys()}

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges of a finished stretch, lowest rank and then leftmost first."""
        ids, none, get = list(symbols), 1 << 62, self.by_pair.get
        ranks = [get(a << ID_BITS | b, none) for a, b in itertools.pairwise(ids)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = best & (1 << ID_BITS) - 1
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << ID_BITS | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << ID_BITS | ids[i], none)
        return ids

    def stream(self, symbols: Iterable[int], stretch: int = 16) -> Iterator[int]:
        """Tokens of a stream of symbols, each as soon as it is stable; looked for after every `stretch` symbols.

        Held are at most the lookahead of a token, the token and a stretch.
        """
        need, joined, goes_on = self.need.get, self.joined, self.goes_on
        held: list[int] = []
        full = stretch
        for symbol in symbols:
            if held and held[-1] << ID_BITS | symbol not in joined:
                done = self.merged(held)
                self.early += len(done)
                yield from done
                held, full = [], stretch
            held.append(symbol)
            if symbol not in goes_on:
                yield from self.merged(held)
                held, full = [], stretch
            elif len(held) >= full:
                at = 0
                for token in self.merged(held):
                    end = at + self._span(token)
                    if end + need(token, 0) > len(held):
                        break
                    self.early += 1
                    yield token
                    at = end
                held = held[at:]
                full = len(held) + stretch
        if held:
            yield from self.merged(held)

    def _span(self, token: int) -> int:
        if token not in self.spans:
            parts = self.parts.get(token)
            self.spans[token] = self._span(parts[0]) + self._span(parts[1]) if parts else 1
        return self.spans[token]


class WordBpe:
    """The encoder and decoder of a word BPE file: composed and lower-cased text, word ends marked, no white space.

    Every word runs through the transducer. What it emits for a unit (a stretch without white space, closed by a
    word's last symbol) is stable, so it is remembered for the next time: a bounded number of units of bounded length.
    """

    TAIL = ChunkTokenizer.TAIL
    STRETCH = 65_536  # characters that are looked at together
    LONG = 1_024  # longer units are streamed and not remembered

    def __init__(self, path: str, capacity: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = Merges([(self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]) for a, b in pairs])
        alphabet = byte_alphabet()
        self.inner = [self.vocabulary[c] for c in alphabet]
        self.last = [self.vocabulary[c + self.suffix] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace(r"\s", WHITE))
        #: What goes on with an unfinished word, and the most characters that decide how one begins.
        self.more = {True: regex.compile(r"\p{L}*"), False: regex.compile(rf"[^{WHITE}\p{{L}}\p{{N}}]*")}
        self.decides = 3
        self.white = regex.compile(f"[{WHITE}]")
        names = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.memo = Memo(self._worked_out, capacity // 2)

    @staticmethod
    def normalised(text: str) -> str:
        """Composed, and lower-cased letter by letter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        return [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]

    def _transduced(self, text: str) -> Iterator[int]:
        """Ids of a text without special tokens."""
        words = (m[0] for m in self.word.finditer(self.normalised(text)))
        return self.merges.stream(itertools.chain.from_iterable(map(self.symbols, words)))

    def _worked_out(self, unit: str) -> bytes:
        core = unit.rstrip(self.TAIL)
        if core != unit and core.isalpha() and self.normalised(core).isalpha():  # punctuation is a word of its own
            return self.memo[core] + self.memo[unit[len(core) :]]
        if core == unit and core.isalpha() and (lower := self.normalised(unit)) != unit and self.normalised(lower) == lower:
            return self.memo[lower]
        ids = array("I")
        at = 0
        for m in self.specials.finditer(unit) if "<" in unit else ():
            ids.extend(self._transduced(unit[at : m.start()]))
            ids.append(self.special[m[0]])
            at = m.end()
        ids.extend(self._transduced(unit[at:] if at else unit))
        return ids.tobytes()

    def stretches(self, text: str) -> Iterator[bytes]:
        """The ids of a text as they become stable, in bytes of bounded length.

        White space parts words whatever follows. A text is taken a stretch at a time, cut at white space; a unit of
        more than LONG characters is streamed.
        """
        claim(self, self.memo.release)
        ids, at = self.memo.__getitem__, 0
        while at < len(text):
            end = min(len(text), at + self.STRETCH)
            if end < len(text) and (end := max(text.rfind(" ", at, end), text.rfind("\n", at, end))) <= at:
                found = self.white.search(text, at + 1)
                end = found.start() if found else len(text)
                if not self.white.match(text, at):
                    yield from self._streamed(text, at, end)
                    at = end
                    continue
            part = text[at:end]
            units = part.split() if part.replace("\n", " ").isprintable() else PLAIN_UNIT.findall(part)
            if len(max(units, key=len, default="")) <= self.LONG:
                yield b"".join(map(ids, units))
            else:
                for unit in units:
                    yield from [ids(unit)] if len(unit) <= self.LONG else self._streamed(unit, 0, len(unit))
            at = end

    def _streamed(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """The same for text[at:end], which has no white space, without holding its words."""
        for m in itertools.chain(self.specials.finditer(text, at, end), (None,)):
            until = m.start() if m else end
            tokens = self.merges.stream(self._symbols_of_long(text, at, until))
            while some := array("I", itertools.islice(tokens, 8192)):
                yield some.tobytes()
            if m:
                yield array("I", [self.special[m[0]]]).tobytes()
                at = m.end()

    @staticmethod
    def _composes_apart(c: str) -> bool:
        """Whether composing can never join c to what stands before it: marks and conjoining vowels may be joined."""
        return unicodedata.category(c)[0] != "M" and not "\u1100" <= c <= "\u11ff"

    def _symbols_of_long(self, text: str, at: int, end: int) -> Iterator[int]:
        """The symbols of text[at:end]; of an unfinished word only its kind and its last byte are kept."""
        held, letters, raw = "", None, None  # text not parted yet; the unfinished word: of letters or not, its last byte
        while at < end or held or raw is not None:
            cut = min(end, at + self.STRETCH // 16)
            while cut < end and not self._composes_apart(text[cut]):
                cut += 1
            held, at = held + self.normalised(text[at:cut]), cut
            done = at >= end
            begin = 0
            if raw is not None:
                part = self.more[letters].match(held)[0]
                for b in part.encode("utf-8", "replace"):
                    yield self.inner[raw]
                    raw = b
                begin = len(part)
                if begin < len(held) or done:
                    yield self.last[raw]
                    raw = None
                else:
                    held = ""
                    continue
            for m in self.word.finditer(held, begin):
                if not done and m.end() > len(held) - self.decides:
                    begin = m.start()
                    if m.end() == len(held) and len(m[0]) > 2 * self.decides:  # a run that may go on
                        letters = m[0][-1].isalpha()
                        *inner, raw = m[0].encode("utf-8", "replace")
                        yield from map(self.inner.__getitem__, inner)
                        begin = len(held)
                    break
                yield from self.symbols(m[0])
                begin = m.end()
            held = held[begin:] if not done else ""

    def encode(self, text: str) -> array:
        """All ids of a text at once."""
        return array("I", b"".join(self.stretches(text)))

    def decoder(self) -> Decoder:
        return Decoder(self.names)


class Decoder:
    """Ids in, text out, as it comes: token strings parted by a space (the file names no decoder of its own).

    The bytes of the strings run through an incremental UTF-8 machine, which keeps at most three bytes.
    """

    def __init__(self, names: list[bytes]):
        self.names, self.begun = names, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        raw = b" ".join(map(self.names.__getitem__, ids))
        if self.begun:
            raw = b" " + raw
        self.begun = True
        return self.machine.decode(raw)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


class BytesDecoder:
    """The same for byte-level tokens: their characters stand for bytes, and word ends become spaces."""

    def __init__(self, tokens: list[str], suffix: str = ""):
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.raw = [bytes(byte_of[c] for c in t.removesuffix(suffix)) + b" " * (suffix != "" and t.endswith(suffix)) if all(c in byte_of for c in t.removesuffix(suffix)) else t.encode() for t in tokens]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.raw.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256; optionally ids and decoded.

    Nothing is shuffled. A text's ids go to the checksums and to the decoder as they become stable, so beside the text
    itself a very long one, with or without spaces, takes no more memory than a short one (with_text: its results).
    Null texts count as empty (no ids, an empty decoded text); repeated rows and null ids get rows of their own; an
    empty table gives none. Other columns of docs, whatever their names, are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        decimal = [str(i).encode() for i in range(len(bpe.names))]
        for batch in batches:
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                a, b, decoder, count, found, decoded = hashlib.sha256(), hashlib.sha256(), bpe.decoder(), 0, [], []
                for stretch in bpe.stretches(text or ""):
                    some = memoryview(stretch).cast("I").tolist()
                    if not some:
                        continue
                    a.update((b" " if count else b"") + b" ".join(map(decimal.__getitem__, some)))
                    piece = decoder.feed(some)
                    b.update(piece.encode())
                    count += len(some)
                    if with_text:
                        found += some
                        decoded.append(piece)
                piece = decoder.finish()
                b.update(piece.encode())
                n.append(count)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
                if with_text:
                    all_ids.append(found)
                    texts.append("".join([*decoded, piece]))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
