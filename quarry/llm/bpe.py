"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

The merge list fixes which token pairs may stand side by side: two tokens are *compatible* if the merges turn
their joined bytes into just these two. A token sequence is the encoding of its bytes exactly if each
neighbouring pair is compatible, so each prefix of a word has one last token, found from the last tokens of
shorter prefixes. A token that is still to come starts within the longest token's length of the place read, so
the chains of last tokens from that window hold all that can still happen: what they share is stable and is
emitted. The state is that window, and ``Merges.reach`` bounds it: it is the merge list's sufficient lookahead.
Texts are split and encoded a slice at a time, so that beside the text itself nothing grows with it.

Decoding is a byte-to-text state machine: it keeps at most three bytes of an unfinished character.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows each get their own
result; other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_columns

#: Words of up to so many characters are kept with their tokens; longer ones are streamed each time.
WORD_KEPT = 64
#: Words that a task keeps; it starts anew when there are more.
WORDS_KEPT = 250_000
PAIRS_KEPT = 400_000
#: Bytes read between two looks at what is stable.
PIECE = 256
#: Characters that are split at once; a longer word widens its slice.
SLICE = 1 << 20
#: Characters before a slice's end whose split what follows could change (``'re`` is the longest such piece).
UNSETTLED = 4
#: In place of a last token: where a word begins; where none ends.
BEGIN, NONE = -1, -2
TOKEN = -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge list of a tokenizer file, with what the transducer needs of them."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        in_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {in_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(in_bytes(a), in_bytes(b)): n for n, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.sizes = {i: len(b) for i, b in self.bytes.items()}
        #: Bytes after which the tokens before are settled, whatever follows: a bound of the merge list alone.
        self.lookahead = self.reach()
        #: Tokens by their bytes from last to first; at TOKEN its id, and before which tokens it is known to fit.
        self.back: dict = {}
        self.fitting: list[dict[int, bool]] = []
        for b, i in self.ids.items():
            node = self.back
            for byte in reversed(b):
                node = node.setdefault(byte, {})
            self.fitting.append({BEGIN: True, NONE: False})
            node[TOKEN] = (i, self.fitting[-1])

    def reach(self) -> int:
        """How far before a place what follows it can still change tokens.

        Let two continuations of the same bytes be merged in order of rank, and look at the left border of what
        differs. Only a merge (u, v) that one of them does and the other doesn't moves it, from the begin of v to
        the begin of u. The next such merge comes later in the list, and its right side begins at the border, so
        with the bytes of u. The heaviest chain of merges so linked, each counting the bytes of its left side, is
        the bound. It holds if each token is made by one merge, before all that use it; without that, the number
        of tokens times the longest.
        """
        made = {bytes([b]) for b in range(256)}
        heaviest: dict[bytes, int] = {}  # of chains that end with this left side
        most = 0
        for left, right in self.rank:
            if left not in made or right not in made or left + right in made:
                return self.longest * len(self.ids)
            made.add(left + right)
            weight = len(left) + max((heaviest.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
            heaviest[left] = max(weight, heaviest.get(left, 0))
            most = max(most, weight)
        return most

    def merged(self, word: bytes) -> list[bytes]:
        """The merges applied in order of rank; for the short strings of the compatibility test."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


class Transducer:
    """Encodes words given in pieces. The state is the window of last tokens, never the word."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.pairs = 0
        self.words = Words(self)

    def fits(self, a: int, b: int, known: dict[int, bool]) -> bool:
        self.pairs += 1
        if self.pairs >= PAIRS_KEPT:
            self.pairs = 0
            for some in self.m.fitting:
                some.clear()
                some |= {BEGIN: True, NONE: False}
        left, right = self.m.bytes[a], self.m.bytes[b]
        known[a] = found = self.m.merged(left + right) == [left, right]
        return found

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one word, each as soon as no continuation can change it."""
        back, fits, longest = self.m.back, self.fits, self.m.longest
        window = b""  # the bytes from the last emitted boundary on
        last = [BEGIN]  # last[i]: last token of the encoding of window[:i]; where it begins, the token emitted last
        check = 2 * longest
        for chunk in chunks:
            for at in range(0, len(chunk), PIECE):
                i = len(window)
                window += chunk[at : at + PIECE]
                for i in range(i, len(window)):
                    found, node = NONE, back
                    for j in range(i, -1, -1):
                        node = node.get(window[j])
                        if node is None:
                            break
                        if TOKEN in node:
                            token, known = node[TOKEN]
                            fit = known.get(last[j])
                            if fit or fit is None and fits(last[j], token, known):
                                found = token
                                break
                    last.append(found)
                if len(window) >= check:
                    if stable := self.shared(last):
                        yield self.chain(last, stable)
                        window, last = window[stable:], last[stable:]
                    check = len(window) + longest
                    # chains from the last places differ at most so far before the first of these
                    if len(window) > self.m.lookahead + 3 * longest + PIECE:
                        raise ValueError("the merge list needs more lookahead than its bound")
        yield self.chain(last, len(window))

    def chain(self, last: list[int], end: int) -> list[int]:
        """The tokens from the window's begin up to a boundary."""
        out = []
        while end > 0:
            out.append(last[end])
            end -= self.m.sizes[last[end]]
        return out[::-1]

    def shared(self, last: list[int]) -> int:
        """The last boundary that the chains from every place in the window go through; 0 if none."""
        live = {i for i in range(max(0, len(last) - self.m.longest), len(last)) if last[i] != NONE}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - self.m.sizes[last[far]])
        return min(live, default=0)

    def word(self, word: bytes) -> bytes:
        """A word's token ids as little-endian unsigned 32-bit integers."""
        pieces = (word[i : i + PIECE] for i in range(0, len(word), PIECE))
        return b"".join(array("I", tokens).tobytes() for tokens in self.stream(pieces))


class Words(dict):
    """Ids of words seen, so that a common word is run once. The words of the generation before are kept too, so there are never more than twice WORDS_KEPT."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.transducer.word(word.encode())
        if len(word) <= WORD_KEPT:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


#: Letters and digits up to U+00FF; texts of these only are split by the faster of two equal patterns.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]++| ?[{DIGITS}]++| ?[^\s{LETTERS}{DIGITS}]++|\s+(?!\S)|\s+")
BEYOND = re.compile(r"[^\x00-\x1B\x20-\x7F\xA0-\xFF]")
ANY = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, text: str):
        import regex

        self.merges = Merges(text)
        self.transducer = Transducer(self.merges)
        self.special = re.compile("|".join(f"({re.escape(t)})" for t in self.merges.special)) if self.merges.special else None
        self.any = regex.compile(ANY)

    def words(self, text: str) -> Iterator[list[str]]:
        """The text split, a slice at a time. What touches a slice's end is split again with the next slice."""
        split = (self.any if BEYOND.search(text) else LATIN).findall
        at, wide = 0, SLICE
        while at + wide < len(text):
            found = split(text[at : at + wide])
            size = wide
            while found and size > wide - UNSETTLED:
                size -= len(found.pop())
            if found:
                yield found
                at, wide = at + size, SLICE
            else:
                wide *= 2
        yield split(text[at:] if at else text)

    def pieces(self, text: str) -> Iterator[bytes]:
        """Token ids as little-endian unsigned 32-bit integers, slice by slice."""
        ids, at = self.transducer.words.__getitem__, 0
        for m in self.special.finditer(text) if self.special is not None else ():
            for words in self.words(text[at : m.start()]):
                yield b"".join(map(ids, words))
            yield self.merges.special[m[0]].to_bytes(4, "little")
            at = m.end()
        for words in self.words(text[at:] if at else text):
            yield b"".join(map(ids, words))

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def decode(self, ids: Iterable[int], at_once: int = 4096) -> Iterator[str]:
        """Pieces of text; bytes that are no UTF-8 become U+FFFD."""
        machine, of = codecs.getincrementaldecoder("utf-8")(errors="replace"), self.merges.bytes
        buffer: list[bytes] = []
        for i in ids:
            buffer.append(of[i])
            if len(buffer) == at_once:
                yield machine.decode(b"".join(buffer))
                buffer.clear()
        yield machine.decode(b"".join(buffer), True)


_codecs: dict[int, Codec] = {}


def codec(text: str) -> Codec:
    """A worker's own, made once."""
    key = hash(text)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(text)
    return _codecs[key]


def ids_of(packed: bytes) -> array:
    out = array("I")
    out.frombytes(packed)
    return out


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the tokens of each whole text. ``tokenizer`` is the text of a tokenizer file (about 1.5 MB, sent to workers once)."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        c = codec(shared.value)
        return lambda ids, texts: [ids, [list(ids_of(c.encode(t or ""))) for t in texts]]

    return map_columns(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>", rows=64)


def decode(df: DataFrame, tokenizer: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each token sequence; null ids count as none."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        c = codec(shared.value)
        return lambda ids, many: [ids, ["".join(c.decode(x or ())) for x in many]]

    return map_columns(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), make, f"id {df.schema[id_col].dataType.simpleString()}, text string", rows=64)


DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(df: DataFrame, tokenizer: str) -> DataFrame:
    """Each document encoded and decoded again; only counts and hashes leave the task."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        c = codec(shared.value)

        def work(ids, texts):
            n, first, second = [], [], []
            for t in texts:
                of_ids, of_text, size = hashlib.sha256(), hashlib.sha256(), 0

                def seen(packed, of_ids=of_ids):
                    nonlocal size
                    of_ids.update(packed)
                    size += len(packed) // 4
                    return ids_of(packed)

                for piece in c.decode(chain.from_iterable(map(seen, c.pieces(t or "")))):
                    of_text.update(piece.encode())
                n.append(size)
                first.append(of_ids.hexdigest())
                second.append(of_text.hexdigest())
            return [ids, n, first, second]

        return work

    return map_columns(df.select(F.col("doc_id").cast("long"), "text"), make, DIGEST_DDL, rows=64)
