"""Token counts by a compiled finite-state tokenizer.

A BPE encoding is the only sequence of vocabulary pieces in which every piece and every adjacent pair re-encodes to
itself.  So the last piece of each prefix follows from the last pieces of the few prefixes before it, and a
deterministic transducer over characters can carry exactly that: its state lists, for every open suffix that is still
the beginning of some piece, the piece before it and the token count there, relative to the count now.  Reading a
character moves to another state and emits the change of the token count.  States are determinised when first met and
kept, up to a bound, after which the table starts anew.

Every chunk of a text is a map from an entry state to an exit state and a count.  Pieces hold a word-begin mark only at
their beginning, so a space after something else always resets the transducer, and a chunk with a reset has one exit
state whatever the entry; only the count of its head, up to the reset, depends on the entry.  A chunk without a reset is
run from the states that are asked for, which are remembered.  Such maps compose associatively; a text's chunks are
composed pairwise, as in the up-sweep of a prefix scan.  Very long texts are cut at resets, and their parts counted by
different tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import tune

#: The mark that stands for a space inside pieces.
MARK = "▁"
#: Tokens above which a document is over the limit; chunk length in characters; length from which a text is counted in parts; bounds of the word and state tables.
LIMIT, CHUNK, LONG, WORDS, STATES = 4096, 1 << 16, 1 << 20, 500_000, 400_000
#: Letters and punctuation between which a further reset lies, where no piece holds one after the other.
LETTERS, POINTS = r"a-zA-Z\u00c0-\u024f", r"!-/:-@\[-`{-~"

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


#: A state: the open suffixes with the piece before each and its count, relative to the count now.
State = tuple[tuple[str, str, int], ...]
START: State = (("", "", 0),)


class Chunk(NamedTuple):
    """State map of a stretch of text: an entry state goes through ``head``, and then, if there is a reset after it, ``count`` tokens follow up to ``exit``."""

    head: str
    count: int
    exit: State | None


class Transducer:
    """Counts the tokens that the vocabulary's BPE makes of a text.

    ``pieces`` maps each mergeable piece to its rank (lower merges first).  Characters outside the vocabulary count
    one token for each UTF-8 byte.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.starts = {p[:i] for p in pieces for i in range(1, len(p))}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the word mark after another character: spaces would not reset the state")
        cuts = [f"{MARK}*[{LETTERS}]+(?![^{POINTS}\n{MARK}])"] * (not any(re.search(f"[{LETTERS}][{POINTS}]", p) for p in pieces))
        line = "\n" * (not any("\n" in p and len(p) > 1 for p in pieces))
        self.parts = re.compile("|".join([*cuts, *line, f"{MARK}*[^{MARK}{line}]+", f"{MARK}+"]))
        self.reset = re.compile(f"(?<=[^{MARK}]){MARK}")
        self.cut = re.compile(f"(?<=[^{MARK} ])[{MARK} ]")
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}  # a full table of words is kept while the next one fills
        self.fits = lru_cache(1 << 18)(self._fits)
        self._clear()

    # -- BPE on short strings: the compatibility of two pieces ------------------------------------------------------
    def merge(self, text: str) -> list[str]:
        """BPE by its definition: merge the adjacent pair of the lowest rank, the leftmost of equals, until none is left."""
        parts, rank = list(text), self.pieces.get
        while True:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _fits(self, before: str, piece: str) -> bool:
        return self.merge(before + piece) == ([before, piece] if before else [piece])

    # -- the transducer ---------------------------------------------------------------------------------------------
    def _clear(self) -> None:
        self.ids, self.states, self.moves = {START: 0}, [START], [{}]

    def _move(self, state: int, char: str) -> tuple[int, int]:
        """The transition, made when first needed: the next state and the change of the count."""
        found, rows = None, []
        for suffix, before, offset in self.states[state]:
            grown = suffix + char
            if found is None and (len(grown) == 1 or grown in self.pieces) and self.fits("", grown) and (not before or self.fits(before, grown)):
                found = (grown, offset + (1 if grown in self.pieces else len(grown.encode("utf-8", "surrogatepass"))))
            if grown in self.starts:
                rows.append((grown, before, offset))
        assert found is not None, "every prefix has a last piece"
        piece, delta = found
        key = (*((s, b, o - delta) for s, b, o in rows), ("", piece if piece in self.pieces else "", 0))
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][char] = to, delta
        return to, delta

    def _at(self, state: State) -> int:
        if (found := self.ids.get(state)) is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return found

    def run(self, entry: State, text: str) -> tuple[State, int]:
        """The state after a stretch that is entered in a state, and the tokens counted on the way, character by character."""
        if len(self.states) > STATES:
            self._clear()
        state, total = self._at(entry), 0
        for k, char in enumerate(text):
            state, delta = self.moves[state].get(char) or self._move(state, char)
            total += delta
            if k & 0xFFFF == 0xFFFF and len(self.states) > STATES:  # a very long stretch: keep the present state only
                here = self.states[state]
                self._clear()
                state = self._at(here)
        return self.states[state], total

    def word(self, word: str) -> int:
        """Tokens of a stretch that starts at a reset."""
        return self.run(START, word)[1]

    def between(self, text: str) -> int:
        """Tokens of a text that starts and ends at resets."""
        words, total = self.words, 0
        for w in self.parts.findall(text):
            n = words.get(w)
            if n is None:
                n = self.older.get(w)
                if n is None:
                    n = self.word(w)
                if len(w) <= 64:
                    if len(words) >= WORDS:
                        self.older, self.words = words, (words := {})
                    words[w] = n
            total += n
        return total

    # -- chunk maps -------------------------------------------------------------------------------------------------
    def chunk(self, text: str) -> Chunk:
        first = self.reset.search(text)
        if first is None:
            return Chunk(text, 0, None)
        last = len(text) - 1
        while not (text[last] == MARK and text[last - 1] != MARK):
            last -= 1
        state, tail = self.run(START, text[last:])
        return Chunk(text[: first.start()], self.between(text[first.start() : last]) + tail, state)

    def apply(self, chunk: Chunk, entry: State) -> tuple[State, int]:
        """The map's value: exit state and count for an entry state."""
        state, count = self.run(entry, chunk.head)
        return (state, count) if chunk.exit is None else (chunk.exit, count + chunk.count)

    def join(self, a: Chunk, b: Chunk) -> Chunk:
        """Composition of two neighbouring maps."""
        if a.exit is None:
            return Chunk(a.head + b.head, b.count, b.exit)
        state, count = self.apply(b, a.exit)
        return Chunk(a.head, a.count + count, state)

    def count(self, text: str, begins: bool = True) -> int:
        """Tokens of a whole text, as the library's encoder gives them without special tokens; not ``begins``: of a part that starts at a reset."""
        if not text:
            return 0
        text = MARK * begins + text.replace(" ", MARK)
        if len(text) <= CHUNK:
            return self.between(text)
        maps = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # up-sweep
            maps = [self.join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.apply(maps[0], START)[1]

    def divided(self, text: str, size: int) -> Iterator[str]:
        """A text cut at resets into parts of about this many characters; the first one begins the text."""
        at = 0
        while len(text) - at > size:
            cut = self.cut.search(text, at + size)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]


#: A text that any normalisation, joining of spaces, or want of a mark at the beginning would change.
PROBE = "\ufb01  \u00c5 A\u030a \u2460\t\u3000x\u200b "


@lru_cache(2)
def compiled(model: str) -> Transducer:
    """The transducer of a SentencePiece BPE model file with identity normalisation, a dummy prefix and byte fallback."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    spelled = bytearray()
    for i in lib.encode(PROBE):
        piece = lib.id_to_piece(i)
        spelled += bytes([int(piece[1:-1], 16)]) if lib.is_byte(i) else piece.encode()
    if spelled.decode() != MARK + PROBE.replace(" ", MARK):
        raise ValueError("the model changes texts before it splits them, or has no pieces for bytes")
    ids = range(lib.get_piece_size())
    return Transducer({lib.id_to_piece(i): -lib.get_score(i) for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))})


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``model`` is the name of a vocabulary file, looked up on the executors.  A null or empty text has 0 bytes and 0
    tokens; null ids stay null; repeated rows give repeated rows; an empty table gives no rows; other columns are not
    read.  A task holds one Arrow batch and the bounded tables of the transducer.  Texts of up to LONG characters need no
    shuffle; longer ones are cut where the state is reset, their parts dealt to all tasks, and the counts summed.
    """
    tune(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        count = compiled(public_tokenizers.path(model)).count
        for batch in batches:
            n = [count(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        divided = compiled(public_tokenizers.path(model)).divided
        for batch in batches:
            for key, size, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for number, part in enumerate(divided(text, CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([size]), pa.array([number], pa.int64()), pa.array([part], pa.string())], names=["text_key", "size", "number", "part"])

    def count_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        count = compiled(public_tokenizers.path(model)).count
        for batch in batches:
            n = [count(part, number == 0) for number, part in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["text_key", "size", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    long = F.coalesce(F.length("text") > LONG, F.lit(False))
    short = rows.where(~long).mapInArrow(run, SCHEMA)
    # A text is counted once however many rows have it; its hash and length stand for it.
    large = rows.where(long).select("doc_id", "n_bytes", F.xxhash64("text").alias("text_key"), F.length("text").cast("long").alias("size"), "text")
    if large.isEmpty():
        return short
    texts = large.groupBy("text_key", "size").agg(F.first("text").alias("text"))
    counts = texts.mapInArrow(cut, "text_key long, size long, number long, part string").repartition("text_key", "number").mapInArrow(count_parts, "text_key long, size long, n long")
    counts = counts.groupBy("text_key", "size").agg(F.sum("n").alias("n_tokens"))
    summed = large.select("doc_id", "n_bytes", "text_key", "size").join(counts, ["text_key", "size"])
    return short.unionByName(summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
