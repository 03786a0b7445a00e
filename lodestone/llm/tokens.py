"""Problem 7: the whole corpus as token ids of a public byte-level BPE, by tree concatenation.

A text is cut into leaves of ``leaf`` code points whatever stands there; leaves are encoded, those of a long text in
parallel threads, and neighbours are joined pair by pair: a window around each seam is encoded anew and grows until both
sides agree exactly.  One Arrow pass without a shuffle; a row is one text, whatever its key or the number of its copies.
Null and empty texts give an empty list.  Nothing is trained; the vocabulary's path is a parameter and the file is read
by the workers.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import map_rows, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points of a leaf, and from how many leaves on the encoder's own threads share them.
LEAF, MANY, THREADS = 1024, 64, 4
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN)
        self.must = regex.compile(r"(?<=\S) (?=\p{L})")
        self.bytes = {i: b for b, i in ranks.items()}

    def flat(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text.encode("utf-8", "replace").decode()) if text else []

    def piece(self, raw: bytes) -> list[int]:
        return self.encoding._encode_single_piece(raw)

    def compatible(self, a: int, b: int) -> bool:
        """Whether two neighbours stay two tokens; a sequence of such neighbours is the encoding of its bytes."""
        return self.piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """Encodings of two halves of one unsplit piece, joined by a growing window around the seam."""
        w = 4
        while True:
            a, b = left[-w:], right[:w]
            mid = self.piece(b"".join(self.bytes[i] for i in a + b))
            ok_left = w >= len(left) or self.compatible(left[-w - 1], mid[0])
            ok_right = w >= len(right) or self.compatible(mid[-1], right[w])
            if ok_left and ok_right:
                return left[: len(left) - len(a)] + mid + right[len(b) :]
            w *= 2

    def tree_piece(self, raw: bytes, leaf: int = 4096) -> list[int]:
        """One unsplit piece of any length: halves, then a join."""
        if len(raw) <= leaf:
            return self.piece(raw)
        cut = len(raw) // 2
        return self.join_piece(self.tree_piece(raw[:cut], leaf), self.tree_piece(raw[cut:], leaf))

    def _back(self, ids: list[int], size: int) -> int:
        """Index of the id at which the last ``size`` bytes start."""
        i = len(ids)
        while size > 0:
            i -= 1
            size -= len(self.bytes[ids[i]])
        return i

    def _forth(self, ids: list[int], size: int) -> int:
        """Number of ids that make up the first ``size`` bytes."""
        i = 0
        while size > 0:
            size -= len(self.bytes[ids[i]])
            i += 1
        return i

    def join(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """(text, ids) of two neighbours as one.

        The window starts at the last place of the left text where a word must start whatever follows: a space between
        a non-space and a letter (else at its beginning).  The split pattern never looks back, so behind the first word
        start that window and right text share, both go on alike; the window grows until there is one.  A word that
        crosses the seam and was cut in just two is joined from its halves' ids."""
        (lt, li), (rt, ri) = left, right
        if not lt or not rt:
            return (rt, ri) if not lt else (lt, li)
        head = 0
        for m in self.must.finditer(lt, max(0, len(lt) - 400)):
            head = m.start()
        index = self._back(li, len(lt[head:].encode()))
        seam, tail = len(lt) - head, 64
        while True:
            whole = tail >= len(rt)
            window, own = lt[head:] + rt[:tail], rt[:tail]
            spans = [m.span() for m in self.words.finditer(window)]
            theirs = [m.span() for m in self.words.finditer(own)]
            starts = {s for s, _ in spans if whole or s - seam <= tail - 2}
            meet = next((s for s, _ in theirs if s > 0 and seam + s in starts and (whole or s <= tail - 2)), None)
            if meet is None and not whole:
                tail *= 4
                continue
            end = len(rt) if meet is None else meet
            rest = self._forth(ri, len(rt[:end].encode()))
            out = li[:index]
            mine = [m.span() for m in self.words.finditer(lt, head)]
            for s, e in spans:
                if s >= seam + end:
                    break
                if s < seam < e and mine[-1] == (head + s, len(lt)) and e - seam == theirs[0][1]:
                    cut = self._back(li, len(lt[head + s :].encode()))
                    out += self.join_piece(li[cut:], ri[: self._forth(ri, len(rt[: theirs[0][1]].encode()))])
                else:
                    out += self.tree_piece(window[s:e].encode())
            return lt + rt, out + ri[rest:]

    def tree(self, text: str, leaf: int = LEAF) -> list[int]:
        text = text.encode("utf-8", "replace").decode()
        leaves = [text[i : i + leaf] for i in range(0, len(text), leaf)]
        ids = self.encoding.encode_ordinary_batch(leaves, num_threads=THREADS) if len(leaves) >= MANY else map(self.flat, leaves)
        return self.merge(list(zip(leaves, ids)))

    def merge(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1] if parts else []


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, leaf: int = LEAF, counts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: key, carried columns and ids (or n_tokens with ``counts``)."""
    kinds = dict(docs.dtypes)
    cols = [key, *carry]
    keep = ", ".join(f"`{c}` {kinds[c]}" for c in cols)
    schema = keep + (", n_tokens int" if counts else ", ids array<int>")

    def one(body, *rest):
        ids = codec(path).tree(body or "", leaf)
        yield (*rest, len(ids) if counts else ids)

    return map_rows(docs.select(text, *cols), schema, one)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per source and language."""
    sizes = encode_texts(table(spark, sf_dir, "documents"), counts=True, carry=("source", "lang"))
    return sizes.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the text that each document's ids stand for, and their number."""
    ids = encode_texts(table(spark, sf_dir, "documents"))

    def one(doc_id, row):
        yield doc_id, hashlib.sha256(b"".join(map(codec(VOCABULARY).bytes.__getitem__, row))).hexdigest()

    return map_rows(ids, "doc_id long, digest string", one)


QUERIES = {"p7_ids": p7_ids, "p7_totals": p7_totals, "p7_decoded": p7_decoded}
ORACLES = {"p7_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents"}
