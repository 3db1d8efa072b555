"""Whole-text encoding, one distinct segment at a time.

A text is cut where the tokenizer is certain to cut: at white space for
tokenizers that drop it, before a single space for byte-level ones. What a
segment encodes to then depends on nothing outside it; two bounded tables, of
segments and of the words in them, serve what a worker has met before. New
words are merged by the subclass in use: op 1's speculation, or tiktoken with
the ranks of the tokenizers file. A text whose white space leaves the cut in
doubt is cut into words whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import regex

#: White space in the sense of Unicode, and the split pattern of byte-level tokenizers that name none.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class SegmentEncoder:
    def __init__(self, path: str, most: int = 350_000, longest: int = 64):
        """most: segments, and words, kept between batches; longest: characters of a kept one."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.drops_space = spec["pre_tokenizer"]["type"] != "ByteLevel"
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_hint = os.path.commonprefix(list(self.special))
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.lower, self.nfc = "Lowercase" in names, "NFC" in names
        splits = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        pattern = splits[0] if splits else BYTE_LEVEL
        pattern = pattern.replace(r"[^\s\p{L}", rf"[^{SPACE}\p{{L}}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.words_of = regex.compile(pattern).findall
        self.marked_words = regex.compile(pattern + "|\n").findall
        self.most, self.longest = most, longest
        self._ready(spec)
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ready(self, spec: dict) -> None:
        """For subclasses: takes what they need from the tokenizer's description."""

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encoded(self, words: list[str]) -> list[bytes]:
        """encode_words as bytes, put into self.dtype all at once."""
        ids = self.encode_words(words)
        ends = np.cumsum([0, *map(len, ids)]) * self.dtype.itemsize
        flat = self.named(np.fromiter(chain.from_iterable(ids), np.int64, ends[-1] // self.dtype.itemsize)).astype(self.dtype).tobytes()
        return [flat[a:b] for a, b in pairwise(ends.tolist())]

    def named(self, ids: np.ndarray) -> np.ndarray:
        """For subclasses whose encode_words gives other numbers than the tokenizer's ids."""
        return ids

    def _split(self, text: str) -> list[str | int]:
        """The words of a text, as the tokenizer normalizes and cuts it, and ids of special tokens."""
        out: list[str | int] = []
        for part in self.special_cut.split(text) if self.special_hint in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part) if self.nfc else part
                part = part.replace("Σ", "σ") if self.lower else part
            out += self.words_of(part.lower() if self.lower else part)
        return out

    def pieces(self, texts: list[str]) -> list[bytes]:
        """As whole(), for texts without line breaks, cut into words all at once: a line each."""
        words = self.words
        hard = [n for n, x in enumerate(texts) if self.special_hint in x]
        joined = "\n".join(["" if self.special_hint in x else x for x in texts] if hard else texts)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined) if self.nfc else joined
            joined = joined.replace("Σ", "σ") if self.lower else joined
        found = self.marked_words(joined.lower() if self.lower else joined)
        new = list(set(found).difference(words, ("\n",)))
        words.update(zip(new, self.encoded(new)))
        out: list[bytes] = []
        own: list[bytes] = []
        for w in found:
            if w == "\n":
                out.append(own[0] if len(own) == 1 else b"".join(own))
                own = []
            else:
                own.append(words[w])
        out.append(b"".join(own))
        self._forget(words, new)
        for n, x in zip(hard, self.whole([texts[n] for n in hard])):
            out[n] = x
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by its words."""
        words = self.words
        cut = [self._split(x) for x in texts]
        new = list({w for x in cut for w in x if w.__class__ is str and w not in words})
        words.update(zip(new, self.encoded(new)))
        words.update((n, np.array([n], dtype=self.dtype).tobytes()) for n in self.special.values())
        out = [b"".join(map(words.__getitem__, x)) for x in cut]
        self._forget(words, new)
        return out

    def _forget(self, known: dict[str, bytes], new: list[str]) -> None:
        full = len(known) > self.most
        for x in new:
            if full or len(x) > self.longest:
                del known[x]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, in self.dtype."""
        tails = self.tails
        if self.drops_space:
            cut = [x.replace("\n", " ").split(" ") for x in texts]
            new = list(set().union(*cut).difference(tails)) if cut else []
            tails.update(zip(new, self.pieces(new) if new else ()))
            out = [b"".join(map(tails.__getitem__, parts)) for parts in cut]
            self._forget(tails, new)
            return out
        heads = self.heads
        cut = [x.split(" ") for x in texts]
        new_heads, new_tails, doubtful = set(), set(), set()
        for n, parts in enumerate(cut):
            if parts[0] not in heads:
                new_heads.add(parts[0])
            missing = [x for x in parts[1:] if x not in tails]
            if any(not x or x[0].isspace() or x[-1].isspace() for x in missing):
                doubtful.add(n)
            else:
                new_tails.update(missing)
            if parts[0][-1:].isspace():
                doubtful.add(n)
        head_list, tail_list = list(new_heads), list(new_tails)
        heads.update(zip(head_list, self.whole(head_list)))
        tails.update(zip(tail_list, self.whole([" " + x for x in tail_list])))
        whole = dict(zip(sorted(doubtful), self.whole([texts[n] for n in sorted(doubtful)])))
        out = [whole[n] if n in whole else heads[parts[0]] + b"".join(map(tails.__getitem__, parts[1:])) for n, parts in enumerate(cut)]
        self._forget(heads, head_list)
        self._forget(tails, tail_list)
        return out


class WordRankEncoder(SegmentEncoder):
    """Tokenizers with an end-of-word mark: new words go through tiktoken's merging.

    The mark becomes the byte FF, which UTF-8 never has, and joins its letter
    before any other merge. Ids are those of the tokenizers library.
    """

    def _ready(self, spec: dict) -> None:
        import tiktoken

        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        byte_of = {x: b for b, x in enumerate(byte_letters())}
        spelt = {i: bytes(byte_of[c] for c in x.removesuffix(mark)) + b"\xff" * x.endswith(mark) for x, i in vocab.items()}
        ends = sorted((x, i) for i, x in spelt.items() if len(x) == 2 and x[1] == 255)
        merged = [(spelt[vocab["".join(x)]], vocab["".join(x)]) for x in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        order = [*ends, *((x, i) for x, i in merged)]
        ranks = {x: n for n, (x, _) in enumerate(order)}
        letters = [(bytes([b]), vocab[c]) for c, b in byte_of.items() if b != 255] + [(b"\xff", vocab[byte_letters()[255]])]
        ranks |= {x: len(order) + n for n, (x, _) in enumerate(letters)}
        self.id_of = np.array([i for _, i in order] + [i for _, i in letters], dtype=self.dtype)
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ranks of the pieces."""
        merge = self.merge
        return [merge(x.encode() + b"\xff") for x in words]

    def named(self, ids: np.ndarray) -> np.ndarray:
        return self.id_of[ids]


class RankEncoder:
    """Byte-level tokenizers, whole texts at a time: tiktoken with the ranks of the tokenizers file.

    Gives the ids of the tokenizers library several times as fast; a text that
    the pattern engine gives up on goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        assert spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec.get("normalizer"), "byte-level tokenizers only"
        byte_of = {x: b for b, x in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in x): i for x, i in spec["model"]["vocab"].items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={x: i for x, i in ranks.items() if i not in special.values()}, special_tokens=special)
        self.dtype = np.dtype("<u2" if max(*ranks.values(), *special.values()) < 1 << 16 else "<u4")
        self.path = path

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for x in texts:
            try:
                ids = self.encoding.encode_to_numpy(x, allowed_special="all")
            except ValueError:
                ids = np.array(SegmentEncoder(self.path).tokenizer.encode(x, add_special_tokens=False).ids)
            out.append(ids.astype(self.dtype).tobytes())
        return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentEncoder | RankEncoder:
    """One encoder per worker process and vocabulary file."""
    with open(path, encoding="utf-8") as f:
        byte_level = json.load(f)["pre_tokenizer"]["type"] == "ByteLevel"
    return RankEncoder(path) if byte_level else WordRankEncoder(path)
