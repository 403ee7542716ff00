"""BPE encoding without merging: longest token matches, checked pair by pair.

A sequence of tokens is the merge result of a word if and only if every token is
the merge result of its own symbols and no merge ever reaches across two
neighbours. An Aho-Corasick automaton gives the longest token at each place of a
word; the encoder takes it, or the next shorter one, if it fits the token before,
and steps back where nothing fits. The merge result of a prefix is unique, so a
place that was left once is never entered again: time is linear. Whether two
tokens fit is read from a table of pairs that fills as they are met: the right
edge of one merge tree against the left edge of the other.

Decoding joins tokens by one offset table over all their bytes.

Rows: one output row per input row. A null text is an empty text, without ids.
Special tokens in a text are what the library makes of them as loaded. Repeated
rows are encoded like any other and ties do not arise; extra columns, whatever
their names, are dropped; an empty table gives an empty result. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import require, small_batches, whole_text
from .offsets import OffsetTable, gathered, places

#: Stands for the end of a word in keys; no symbol of the byte alphabet.
END = "\n"
#: Chunks of these characters are normalised and cut here, which is what the library does; all others by the library itself.
PLAIN = re.compile(r"[\x21-\x7e\xa1-\u024f\u0370-\u0373\u0391-\u03a1\u03a4-\u03c9\u0410-\u044f\u2010-\u2027\u20ac]*").fullmatch
#: Fixed value: the pre-tokenizer of the file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks, words and pairs that one worker remembers, and characters of the longest ones.
REMEMBERED = 250_000
LONGEST = 64


def byte_letters() -> str:
    """The letter of each byte: printable Latin-1 as it is, the other bytes by the letters from U+0100 on, in order."""
    from tokenizers import pre_tokenizers

    own, more = set(pre_tokenizers.ByteLevel.alphabet()), iter(range(0x100, 0x200))
    return "".join(chr(b) if chr(b) in own else chr(next(more)) for b in range(256))


class BacktrackEncoder:
    """Vocabulary, merge trees and pair table of a tokenizers file with word ends."""

    def __init__(self, content: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        file = json.loads(content)
        model, suffix = file["model"], file["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or file.get("decoder"):
            raise ValueError("not a plain merge model without a decoder")
        special = file.get("added_tokens") or []
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in special):
            raise ValueError("special tokens have to be matched as they stand")
        self.special = {x["content"]: x["id"] for x in special}
        self.cut_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if special else None
        pre = file["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers") or [pre]
        if [s["type"] for s in (file["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or steps[0].get("pattern", {}).get("Regex") != PATTERN:
            raise ValueError("normaliser or pre-tokenizer is not of the known kind")
        self.find_words = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self._grow(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], suffix)
        self.automaton = ahocorasick.Automaton()
        for key, token in self.tokens.items():
            if self.whole[token]:
                self.automaton.add_word(key, token)
        self.automaton.make_automaton()
        #: The longest whole token that is a proper prefix of a token, or -1.
        self.shorter = [-1] * len(self.size)
        for key, token in self.tokens.items():
            for n in range(len(key) - 1, 0, -1):
                if (t := self.tokens.get(key[:n], -1)) >= 0 and self.whole[t]:
                    self.shorter[token] = t
                    break
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        top = max(names) + 1
        self.texts = OffsetTable([(names.get(i, "") + " ").encode() for i in range(top)])
        self.numbers = OffsetTable([b"%d " % i for i in range(top)])
        self.words: dict[str, list[int]] = {}
        self.chunks = pa.array([], pa.string())
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _grow(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        """Keys, edges of the merge trees, and which tokens are the result of their own symbols."""
        n = max(vocab.values()) + 1
        self.tokens: dict[str, int] = {}
        self.size, self.whole = [0] * n, [False] * n
        #: (token, when it is merged away) along the left and the right edge of each tree, itself first.
        self.left: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        self.right: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        self.rank: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        keys, born = [""] * n, [-1] * n

        def enter(token: int, key: str) -> None:
            if keys[token] or key in self.tokens:
                raise ValueError(f"token {token} has two forms")
            keys[token], self.tokens[key], self.size[token] = key, token, len(key)

        for c in self.letters:
            for name, key in {c: c, c + suffix: c + END}.items():
                if name in vocab:
                    enter(t := vocab[name], key)
                    self.left[t] = self.right[t] = [(t, np.inf)]
                    self.whole[t] = True
        for r, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if not self.left[x] or not self.left[y]:
                raise ValueError("a merge is listed before its parts")
            enter(t, keys[x] + keys[y])
            self.rank[x, y], born[t] = r, r
            self.left[t] = [(t, np.inf), (x, r), *self.left[x][1:]]
            self.right[t] = [(t, np.inf), (y, r), *self.right[y][1:]]
            self.whole[t] = self.whole[x] and self.whole[y] and self.first_crossing(x, y) == r

    def first_crossing(self, a: int, b: int) -> int | None:
        """The first merge that reaches across a and b standing side by side, if there is one.

        Two symbols meet at the seam while neither is merged away; of two merges of one rank the left one goes first.
        """
        found, rank = None, self.rank.get
        for x, x_gone in self.right[a]:
            for y, y_gone in self.left[b]:
                r = rank((x, y))
                if r is not None and r < x_gone and r <= y_gone and (found is None or r < found):
                    found = r
        return found

    def fit(self, a: int, b: int) -> bool:
        """Whether a and b may be neighbours; from the table of pairs."""
        pair = a << 32 | b
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) >= 8 * REMEMBERED:
                self.fits.clear()
            found = self.fits[pair] = self.first_crossing(a, b) is None
        return found

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word in the byte alphabet."""
        word += END
        n, size, shorter, fit = len(word), self.size, self.shorter, self.fit
        longest = [-1] * n
        for end, token in self.automaton.iter(word):
            # Matches that start at one place come by their end, so the last one is the longest.
            longest[end + 1 - size[token]] = token
        ids: list[int] = []
        left, at, token = bytearray(n + 1), 0, longest[0]
        while at < n:
            while token >= 0 and (left[at + size[token]] or (ids and not fit(ids[-1], token))):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            elif ids:
                left[at] = 1
                token = ids.pop()
                at -= size[token]
                token = shorter[token]
            else:
                raise ValueError("a symbol is not in the vocabulary")
        return ids

    def _words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in the byte alphabet."""
        if PLAIN(text):
            words = self.find_words(text.lower())
            return words if text.isascii() else [charmap_decode(w.encode(), "strict", self.letters)[0] for w in words]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a stretch of text without white space at its ends."""
        ids: list[int] = []
        special = self.special
        for part in self.cut_special(chunk) if self.cut_special and any(s in chunk for s in special) else (chunk,):
            if part in special:
                ids.append(special[part])
                continue
            for word in self._words(part):
                found = self.words.get(word)
                if found is None:
                    found = self.word_ids(word)
                    if len(self.words) < REMEMBERED and len(word) <= LONGEST:
                        self.words[word] = found
                ids += found
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts, one after the other, and how many each has.

        White space ends every word, so texts fall apart there; the chunks that were met before are looked up.
        """
        parts = pc.ascii_split_whitespace(texts)
        ends = parts.offsets.to_numpy().astype(np.int64)
        chunks = parts.values.dictionary_encode()
        known = pc.index_in(chunks.dictionary, value_set=self.chunks).fill_null(-1).to_numpy()
        new = np.flatnonzero(known < 0)
        fresh = chunks.dictionary.take(pa.array(new))
        found = [self.chunk_ids(x) for x in fresh.to_pylist()]
        new_count = np.fromiter(map(len, found), np.int64, len(found))
        new_flat = np.fromiter((i for ids in found for i in ids), np.int32, int(new_count.sum()))
        start, count = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        old = np.flatnonzero(known >= 0)
        start[old], count[old] = self.start[known[old]], self.count[known[old]]
        start[new], count[new] = len(self.flat) + np.cumsum(new_count) - new_count, new_count
        flat = np.concatenate([self.flat, new_flat])
        at = chunks.indices.to_numpy()[ends[0] : ends[-1]] if len(chunks) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(count[at])])
        ids = flat[places(start[at], count[at])]
        if len(new) and len(self.chunks) < REMEMBERED:
            short = np.flatnonzero(pc.utf8_length(fresh).to_numpy(zero_copy_only=False) <= LONGEST)
            at, own = (np.cumsum(new_count) - new_count)[short], new_count[short]
            self.chunks = pa.concat_arrays([self.chunks, fresh.take(pa.array(short))])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(own) - own])
            self.count, self.flat = np.concatenate([self.count, own]), np.concatenate([self.flat, new_flat[places(at, own)]])
        return ids, np.diff(total[ends - ends[0]])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The bytes of each text's tokens, a space between two."""
        return self.texts.joined(ids, counts)


_LOADED: dict[str, BacktrackEncoder] = {}


def encoder(content: str) -> BacktrackEncoder:
    """The encoder of a tokenizer file's content, one for each Python worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = BacktrackEncoder(content)
    return _LOADED[key]


def _content(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text."""
    require(docs, id_col, text_col)
    content = _content(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        for key, texts in gathered(batches):
            ids, counts = enc.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([key, lists, pa.array([str(x, "utf-8") for x in enc.decode(ids, counts)], pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, whole_text(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the same encoding and decoding, without moving the lists."""
    require(docs, id_col, text_col)
    content = _content(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sha = encoder(content.value), lambda x: hashlib.sha256(x).hexdigest()
        for key, texts in gathered(batches):
            ids, counts = enc.encode(texts)
            named = [pa.array(list(map(sha, made)), pa.string()) for made in (enc.numbers.joined(ids, counts), enc.decode(ids, counts))]
            yield pa.RecordBatch.from_arrays([key, pa.array(counts), *named], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, whole_text(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
