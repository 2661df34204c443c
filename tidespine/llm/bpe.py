"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one BPE encoding, hence one last token. The automaton lists the tokens
that end at a prefix, longest first; the last token is the first of them that stands next to the last
token of what comes before it without a merge crossing the border. One table of last tokens per word
therefore holds the encodings of all its prefixes, and the back-pointers of the full word are its ids.
"""
from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from tidespine.llm.common import kept, ship, slices
from tidespine.llm.vocab import ChunkEncoder, read_definition

NEVER = 1 << 60
#: Bytes of text that a worker takes at a time, and words its cache keeps: encoder, cache and slice together stay within some 150 MB.
SLICE, WORDS_KEPT = 1 << 20, 30_000
#: Added to a letter's code point where it ends a word: another unit of the alphabet.
END = 0x10000


class PrefixEncoder:
    """Encodes words written in the byte-level alphabet of a BPE file with word ends."""

    def __init__(self, definition: dict, pairs_kept: int = 100_000):
        model = definition["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for at, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole in self.parts or max(self.rank.get(a, -1), self.rank.get(b, -1)) >= at:
                raise ValueError("a token is made twice, or before its parts")
            self.rank[whole], self.parts[whole], self.merge_rank[a, b] = at, (a, b), at
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pairs_kept = pairs_kept
        self.matches = ahocorasick.Automaton()
        whole = {}
        for token, t in vocab.items():
            # a token that its own letters do not merge to can never be chosen
            whole[t] = t not in self.parts or all(whole[p] for p in self.parts[t]) and self.first_crossing(*self.parts[t]) == (0, 0)
            if whole[t]:
                units = token if not token.endswith(end) or token == end else token[: -len(end) - 1] + chr(ord(token[-len(end) - 1]) + END)
                self.matches.add_word(units, (t, len(units)))
        self.matches.make_automaton()

    def spine(self, token: int, side: int) -> list[int]:
        """The token, its outer part on one side, that part's outer part, down to a letter."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out

    def first_crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """Where a merge would join the two tokens while their letters merge up: steps left to each token's top, or none.

        The facing parts grow from letters, always the one whose own next merge comes first. A merge across the
        border wins if it comes before the left side's next merge, and not after the right side's, which stands further right.
        """
        ra, lb = self.spine(a, 1), self.spine(b, 0)
        i, j = len(ra) - 1, len(lb) - 1
        while True:
            up_a = self.rank[ra[i - 1]] if i else NEVER
            up_b = self.rank[lb[j - 1]] if j else NEVER
            across = self.merge_rank.get((ra[i], lb[j]), NEVER)
            if across < up_a and across <= up_b and across < NEVER:
                return i, j
            if not i and not j:
                return None
            if up_a <= up_b:
                i -= 1
            else:
                j -= 1

    def stand_together(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.pairs_kept:
                self.pairs.clear()
            known = self.pairs[a, b] = self.first_crossing(a, b) is None
        return known

    def last_tokens(self, units: str) -> list[tuple[int, int] | None]:
        """For each prefix length, its last token and that token's length."""
        last: list[tuple[int, int] | None] = [None] * (len(units) + 1)
        known = self.pairs.get
        for end, match in self.matches.iter(units):
            if last[end + 1] is None:
                start = end + 1 - match[1]
                if start:
                    pair = last[start][0], match[0]
                    fits = known(pair)
                    if fits if fits is not None else self.stand_together(*pair):
                        last[end + 1] = match
                else:
                    last[end + 1] = match
        return last

    def word(self, letters: str) -> list[int]:
        last = self.last_tokens(letters[:-1] + chr(ord(letters[-1]) + END))
        ids, at = [], len(letters)
        while at:
            token, length = last[at]
            ids.append(token)
            at -= length
        return ids[::-1]


def _codec(text: str) -> tuple[ChunkEncoder, pa.Array]:
    """Encoder and token table of a definition, built once for a Python worker."""
    def build() -> tuple[ChunkEncoder, pa.Array]:
        d = json.loads(text)
        by_id = {i: t for t, i in d["model"]["vocab"].items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        return ChunkEncoder(text, PrefixEncoder(d).word, WORDS_KEPT), pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)], pa.string())

    return kept(f"bpe {hash(text)}", build)


def encode_texts(texts: pa.Array, definition: str) -> pa.ListArray:
    """Ids of each text; null encodes as the empty text."""
    ids, at = _codec(definition)[0].encode(texts)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))


def decode_ids(ids: pa.Array, definition: str) -> pa.Array:
    """The tokens of each id list joined by one space, as files without a decoder read; special tokens stay."""
    tokens = _codec(definition)[1].take(ids.values)
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), " ")


def encoded(batches: Iterable[pa.RecordBatch], text: str, definition: str) -> Iterator[tuple[pa.RecordBatch, pa.ListArray, pa.Array]]:
    """Slices of the batches, their ids and the ids read back; what Arrow has freed goes back to the system after each."""
    for part in slices(batches, text, size=SLICE):
        ids = encode_texts(part.column(part.schema.get_field_index(text)), definition)
        yield part, ids, decode_ids(ids, definition)
        del part, ids
        pa.default_memory_pool().release_unused()


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` without its text, with ``ids`` (array<int>) and ``decoded`` (the ids read back).

    One pass without a shuffle; a row depends on its own text only, so repeated rows and ties need no rule, and an
    empty table stays empty. Null and empty texts get no ids and an empty decoded text. Texts of any length are taken
    whole. Other columns pass through; one named like a result is replaced by it. ``path`` names a vocabulary file
    that the driver reads and broadcasts (a few MB, whatever the table's size).
    """
    ship(docs.sparkSession)
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))
    rest = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got, back in encoded(batches, text, definition.value):
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), got, back], names=[*names, ids, decoded])

    return docs.select(*names, text).mapInArrow(run, schema)
