"""Problem 2: oversized texts cut at natural boundaries, with a fixed overlap, by dynamic programming.

Every piece has at most ``limit`` code points; each piece after the first starts with the last ``overlap`` code points
of the piece before.  Texts within the limit are one piece; a null or empty text has none.  Swapped line numbers are
put in order; a null start_line gives null piece lines.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import map_rows, table

LIMIT, OVERLAP = 4000, 200
#: Penalty of a cut, by what stands there; size imbalance adds up to IMBALANCE.
BLANK_BEFORE_TOP, BLANK, LINE_TOP, LINE, SENTENCE, SPACE, HARD = 0.0, 0.6, 0.4, 1.5, 3.0, 6.0, 20.0
IMBALANCE = 2.0
_LINES = re.compile(r"\n(?=([ \t]*\r?\n)?(\s?))")
_SENTENCE = re.compile(r"[.!?;。！？；]\s*(?=\S)")
_SPACE = re.compile(r"(?<=\s)(?=\S)")
_COMBINING = re.compile(r"[̀-ͯ‍︀-️]|(?<=\r)\n|(?<=‍)")


def _gaps(text: str, cuts: dict[int, float], pattern: re.Pattern, penalty: float, reach: int) -> None:
    """Adds weaker cuts only where stronger ones leave more than ``reach`` characters without any."""
    known = [0, *sorted(cuts), len(text)]
    for a, b in zip(known, known[1:]):
        if b - a > reach:
            for m in pattern.finditer(text, a, b):
                if a < m.end() < b:
                    cuts.setdefault(m.end(), penalty)


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall and their penalties; no gap is wider than ``step``."""
    cuts: dict[int, float] = {}
    before_blank = False
    for m in _LINES.finditer(text):
        blank_next, indent = m[1] is not None, m[2]
        top = indent == ""
        cuts[m.end()] = (BLANK_BEFORE_TOP if top else BLANK) if before_blank else (LINE_TOP if top else LINE)
        before_blank = blank_next
    cuts.pop(len(text), None)
    reach = step // 3
    _gaps(text, cuts, _SENTENCE, SENTENCE, reach)
    _gaps(text, cuts, _SPACE, SPACE, reach)
    known = [0, *sorted(cuts), len(text)]
    for a, b in zip(known, known[1:]):  # no natural place: a grid, moved off combining marks
        if b - a > reach:
            for p in range(a + reach, b, reach):
                while p > a + 1 and _COMBINING.match(text, p):
                    p -= 1
                cuts.setdefault(p, HARD)
    at = np.array(sorted(cuts), dtype=np.int64)
    return at, np.array([cuts[p] for p in at.tolist()])


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of the pieces.  The cuts minimise penalties plus squared distance of the new text from an equal share."""
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    step = limit - overlap
    at, cost = boundaries(text, step)
    pos = np.concatenate(([0], at, [n]))
    pen = np.concatenate(([0.0], cost, [0.0]))
    share = (n - overlap) / -(-(n - overlap) // step)
    best = np.full(len(pos), np.inf)
    best[0] = 0.0
    prev = np.zeros(len(pos), dtype=np.int64)
    lows = np.searchsorted(pos, pos - step)
    for j in range(1, len(pos)):
        lo = 0 if pos[j] <= limit else max(int(lows[j]), 1)
        new = pos[j] - pos[lo:j]
        if pos[j] <= limit:  # only the first piece may hold ``limit`` new characters, and it starts at 0
            new = new.astype(float)
            new[1:][new[1:] > step] = np.inf
        # a later piece has to reach back ``overlap`` characters within the one before
        total = best[lo:j] + IMBALANCE * ((new - share) / share) ** 2
        first = pos[lo:j] > 0
        total[first & (pos[lo:j] < overlap)] = np.inf
        k = int(np.argmin(total))
        best[j] = total[k] + pen[j] + 0.25
        prev[j] = lo + k
    if not np.isfinite(best[-1]):
        raise AssertionError("the grid leaves no gap wider than a step")
    ends = []
    j = len(pos) - 1
    while j > 0:
        ends.append(int(pos[j]))
        j = int(prev[j])
    ends.reverse()
    return [(0 if i == 0 else ends[i - 1] - overlap, e) for i, e in enumerate(ends)]


def split_pieces(chunks: DataFrame, key: str = "chunk_no", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts longer than ``limit``: key, piece_no, pieces, start_char, end_char, start_line, end_line, symbol_name, text.

    The length filter runs in the JVM, so only oversized rows reach Python; no shuffle."""
    kinds = dict(chunks.dtypes)
    big = chunks.where(F.length(text) > limit).select(key, text, "start_line", "end_line", "symbol_name")

    def one(k, body, start, end, symbol):
        first = min(x for x in (start, end) if x is not None) if start is not None else None
        spans = split_text(body, limit, overlap)
        line, seen = first, 0
        for i, (a, b) in enumerate(spans):
            if first is not None:
                line += body.count("\n", seen, a)
                seen = a
                last = line + body.count("\n", a, b - 1)
            yield (k, i + 1, len(spans), a, b, line, last if first is not None else None, symbol, body[a:b])

    return map_rows(big, f"`{key}` {kinds[key]}, piece_no int, pieces int, start_char int, end_char int, start_line int, end_line int, symbol_name string, text string", one, batch_rows=400)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text was oversized exactly if the operator cut it in two or more."""
    return split_pieces(table(spark, sf_dir, "code_chunks")).where("piece_no = 2").select("chunk_no")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pieces(table(spark, sf_dir, "code_chunks"))


def p2_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized text: digest of its pieces put together again without their overlaps, and whether all lengths and overlaps hold."""
    p = split_pieces(table(spark, sf_dir, "code_chunks"))
    own = p.select("chunk_no", "piece_no", F.when(F.col("piece_no") == 1, F.col("text")).otherwise(F.substring("text", OVERLAP + 1, LIMIT)).alias("new"), F.col("text"))
    g = own.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("piece_no", "new", "text"))).alias("p"))  # the pieces of one text
    steps = F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.size("p") - 1), lambda b, a: F.left(b["text"], F.lit(OVERLAP)) == F.right(a["text"], F.lit(OVERLAP)))
    return g.select("chunk_no", F.sha2(F.array_join(F.transform("p", lambda x: x["new"]), ""), 256).alias("digest"), F.forall("p", lambda x: F.length(x["text"]) <= LIMIT).alias("within_limit"), F.forall(steps, lambda x: x).alias("overlaps"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_reassembled": p2_reassembled}
ORACLES = {
    "p2_found": "SELECT chunk_no FROM code_chunks WHERE length(text) > 4000",
    "p2_reassembled": "SELECT chunk_no, sha256(text) AS digest, true AS within_limit, true AS overlaps FROM code_chunks WHERE length(text) > 4000",
}
