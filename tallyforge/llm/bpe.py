"""BPE encoding with word ends: a priority queue of merge ranks over a doubly linked list of symbols.

The vocabulary file is a parameter. Text is taken as that file's pipeline says:
NFC, white space to one space, lower case, a split into words, bytes to letters,
then merges inside each word. Decoding joins vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyforge.llm.common import small_batches, text_of

#: Words a task remembers before it starts anew.
CACHE_WORDS = 300_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    free = 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return out


class Chunks(dict):
    """Ids (as text) of chunks without white space, each id with a space after it; ``decoded`` has their strings alike."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.decoded = encode, {}

    def __missing__(self, chunk: str) -> str:
        ids, self.decoded[chunk] = self.encode(chunk)
        self[chunk] = ids
        return ids

    def texts(self, chunks: list[str]) -> tuple[str, str]:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.decoded.clear()
        return "".join(map(self.__getitem__, chunks)), "".join(map(self.decoded.__getitem__, chunks))


class WordBPE:
    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # by both ids of a pair, in one number: its rank; by rank: the new id
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.first = {b: self.vocab.get(c) for b, c in byte_letters().items()}
        self.last = {b: self.vocab.get(c + self.suffix) for b, c in byte_letters().items()}
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words: dict[str, list[int]] = {}
        self.chunks = Chunks(self._chunk)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word. Symbols that the vocabulary lacks are left out."""
        ids = [self.first[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        rank_of, n = self.ranks.get, len(ids)
        # a doubly linked list of symbols; -1 is its end and, as an id, a symbol that is gone
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            left, rank = entry & 0xFFFFFFFF, entry >> 32
            right = after[left]
            if right < 0 or ids[left] < 0 or rank_of(ids[left] << 32 | ids[right]) != rank:
                continue  # stale: one of the symbols has merged meanwhile
            new = ids[left] = self.made[rank]
            ids[right] = -1
            after[left] = follower = after[right]
            if follower >= 0:
                before[follower] = left
                if (r := rank_of(new << 32 | ids[follower])) is not None:
                    heapq.heappush(queue, r << 32 | left)
            if (leader := before[left]) >= 0 and (r := rank_of(ids[leader] << 32 | new)) is not None:
                heapq.heappush(queue, r << 32 | leader)
        return [i for i in ids if i >= 0]

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids and vocabulary strings of a piece without white space, each with a space after it."""
        ids: list[int] = []
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        for word in self.pattern.findall(chunk):
            if (found := self.words.get(word)) is None:
                found = self.words[word] = self.merge(word.encode("utf-8"))
            ids += found
        return "".join([f"{i} " for i in ids]), "".join([f"{self.strings[i]} " for i in ids])

    def encode(self, text: str) -> tuple[str, str]:
        """Ids of the text, joined by a space, and its decoded text: vocabulary strings joined by a space."""
        ids, strings, at = [], [], 0
        hits = self.split_special.finditer(text) if any(s in text for s in self.special) else ()
        for start, end, name in [*((h.start(), h.end(), h.group()) for h in hits), (len(text), len(text), None)]:
            for out, part in zip((ids, strings), self.chunks.texts(self._split(text[at:start] if at or name else text)), strict=True):
                out.append(part)
            if name is not None:
                ids.append(f"{self.special[name]} ")
                strings.append(f"{self.strings[self.special[name]]} ")
            at = end
        return "".join(ids)[:-1], "".join(strings)[:-1]

    @staticmethod
    def _split(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower case goes letter by letter, without the rule for a final sigma
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        # str.split also ends words at four control characters that the pattern keeps
        return regex.split(r"\s+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    A null or empty text has no tokens and the digests of the empty text. A text of any length is encoded whole; of
    merges with equal rank the leftmost goes first. Repeated rows are encoded one by one; other columns are ignored; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(sent.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                own, strings = bpe.encode(text)
                n.append(own.count(" ") + 1 if own else 0)
                ids.append(sha(own))
                decoded.append(sha(strings))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
