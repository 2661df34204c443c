"""Word-end BPE vocabulary files: the file's splitting rules and a bounded cache of encoded words.

White space parts words in these files, so a text is cut at white space first and each chunk is
the distinct chunks of a slice of texts are lower-cased, split and encoded once. Memory is bounded by
the word cache's limit and one slice, and results never depend on the cache.
"""
from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The only normaliser, splitter and byte rules that the encoders here follow.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def read_definition(path: str) -> str:
    """The vocabulary file's text, read on the driver; a file is a few MB, and one with other rules is refused."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    d = json.loads(text)
    split = [p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    if d["model"]["type"] != "BPE" or not d["model"]["end_of_word_suffix"] or d["normalizer"]["normalizers"] != NORMALIZERS \
            or [p["pattern"]["Regex"] for p in split] != [SPLIT_PATTERN] or d["decoder"] is not None:
        raise ValueError(f"{path} is not a lower-case BPE file with word ends")
    return text


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkEncoder:
    """Ids of whole texts, by way of the distinct chunks of a slice of texts and a cache of their words.

    ``text`` is the definition; ``encode_word`` gives the ids of a word written in the byte-level alphabet. The cache has two generations: a full one
    becomes the old one, and what is met again moves on, so rare words never push out the common ones.
    """

    def __init__(self, text: str, encode_word: Callable[[str], list[int]], limit: int = 60_000):
        from tokenizers import Tokenizer

        self.encode_word, self.limit = encode_word, limit
        d = json.loads(text)
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        # only the file's rules are taken from the library here: its model would stay in the worker's memory
        rules = Tokenizer.from_str(json.dumps(d | {"model": d["model"] | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normalize, self.split_letters = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        specials = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.at_special = re.compile(f"({specials})") if specials else None
        # below the first combining mark NFC changes nothing; the rest of Unicode is cut as the file's own rules do it, whatever Unicode version Python has
        self.odd = re.compile(f"[\u0300-\U0010ffff]{'|' + specials if specials else ''}").search
        plain = [chr(c) for c in range(0x300)]
        letter, number = ("".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind) for kind in "LN")
        pattern = SPLIT_PATTERN.replace(r"\s", r"\n").replace(r"[\p{L}]", f"[{letter}]").replace(r"\p{L}", letter).replace(r"[\p{N}]", f"[{number}]").replace(r"\p{N}", number)
        self.words_in = re.compile(rf"\n|{pattern}").findall
        self.white = regex.compile(r"\p{White_Space}+").split
        self.letters = {b: c for b, c in byte_letters().items() if b != 10}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32), and where each text's begin and the last ends. Null is the empty text."""
        chunks, ends = self.chunks(texts)
        held = chunks.dictionary_encode()
        ids, at = self.distinct(held.dictionary.to_numpy(zero_copy_only=False).tolist())
        lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(ids)).take(held.indices)
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()[ends]

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of all texts between white space, and where each text's begin and the last ends."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
            lists = pc.utf8_split_whitespace(texts)
            return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # the four ASCII information separators are white space there, but not here
        parts = [self.white(t) for t in texts.to_pylist()]
        return pa.array([c for p in parts for c in p], pa.string()), np.cumsum([0, *(len(p) for p in parts)])

    def distinct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some chunks, one after the other, and where each begins and the last ends."""
        odd = [i for i, c in enumerate(chunks) if self.odd(c)] if self.odd("\n".join(chunks)) else []
        plain = chunks
        if odd:
            plain = list(chunks)
            for i in odd:
                plain[i] = ""
        words = self.words_in("\n".join(plain).lower())
        self.know(dict.fromkeys(words))
        ids = list(map(self.words.__getitem__, words))
        size = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]) // 4
        marks = np.array([i for i, w in enumerate(words) if w == "\n"], np.int64)
        at = np.concatenate([[0], size[marks], size[-1:]]) if chunks else np.zeros(1, np.int64)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        if not odd:
            return flat, at
        pieces = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
        for i in odd:
            pieces[i] = self.cut_by_rules(chunks[i])
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def cut_by_rules(self, chunk: str) -> np.ndarray:
        ids: list[int] = []
        for part in self.at_special.split(chunk) if self.at_special else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for letters, _ in self.split_letters(self.normalize(part)):
                    ids += self.encode_word(letters)
        return np.array(ids, np.uint32)

    def know(self, words: dict[str, None]) -> None:
        """Bring the ids of ``words`` into the cache. A line end parts chunks and has no ids."""
        if len(self.words) + len(words) > self.limit:
            self.old, self.words = self.words, {}
        fresh = [w for w in words if w not in self.words]
        again = [w for w in fresh if w in self.old]
        self.words.update((w, self.old[w]) for w in again)
        self.words["\n"] = b""
        fresh = [w for w in fresh if w not in self.words]
        # in one piece: every byte but the line end is written as its letter
        letters = "\n".join(fresh).encode().decode("latin-1").translate(self.letters).split("\n") if fresh else []
        self.words.update((w, array("I", self.encode_word(x)).tobytes()) for w, x in zip(fresh, letters))
