"""Rankings of a repository's questions over all its documents, block by block of questions.

Every question is scored against every document with one of its terms, and every rank counts, as the fusion's definition
has it; but no pair of a question and a document is a row.  A task holds the postings of one repository and a block of its
questions as arrays and gives back only what a list keeps.  Postings cross one shuffle, once per block of questions.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lodestone.functions.text import TOKEN

from .index import B, K1, VIEWS
from .lineage import FEW_KEYS, checkpointed

#: Questions per block, and most blocks per repository: beyond, blocks grow.
BLOCK, MOST_BLOCKS = 768, 6
#: Most pairs of a repository and a word that its questions ask for that go to every task; beyond, what other repositories ask for stays in the postings.
FEW_PAIRS = 1_000_000
#: Codes of the token lists; overlaps are lists of distinct tokens, of which only the documents count.
CODES = {v: i for i, v in enumerate((*VIEWS, "chunk", "file", "symbol", "relpath", "route", "language"))}
OVERLAPS = ("symbol", "relpath", "route", "language")
K_VIEWS = 30


def ranked_blocks(sources: list[tuple[DataFrame, dict]], terms: DataFrame, kernel: Callable, schema: str, per_query: DataFrame | None = None, facts: DataFrame | None = None, judged: DataFrame | None = None, shared: dict | None = None) -> DataFrame:
    """What ``kernel(postings, questions)`` yields, as tuples of columns, for every block of a repository's questions.

    sources: documents (repo, doc_id and columns) and the spec of their tokens, see ``token_rows``.  terms: query_id, repo, term.
    per_query: (query_id, repo) and more columns; its questions take part even without terms.  facts: (repo, doc_id) and
    more columns.  judged: query_id, repo, term of other words of a question; only its questions take part.  The distinct
    words of all questions go to every task; with their repositories they settle what is shuffled, one row per document.
    shared: an empty dict keeps the postings for a later call that gets it; that call takes the first's sources and terms, and
    its questions are among the first's."""
    if shared:
        asked, blocks, rows = shared["asked"], shared["blocks"], shared["rows"]
        asked = asked if per_query is None else per_query.join(asked, ["query_id", "repo"], "left")
    else:
        asked, blocks, rows = _postings(sources, terms, per_query, judged, shared)
    copies = F.explode(F.sequence(F.col("g0"), F.col("g0") + F.col("blocks") - 1))
    rows = rows.join(blocks, "repo").select(copies.alias("g"), "tid", "doc_id", "packed")
    other = asked.join(blocks, "repo").select((F.col("g0") + F.pmod(F.xxhash64("query_id"), F.col("blocks"))).alias("g"), *(c for c in asked.columns if c != "repo"))
    if facts is None:
        facts = asked.limit(0).select("repo", F.col("query_id").alias("doc_id"))
    other = other.unionByName(facts.join(blocks, "repo").select(copies.alias("g"), *(c for c in facts.columns if c != "repo")), allowMissingColumns=True)
    return rows.groupBy("g").cogroup(other.groupBy("g")).applyInArrow(_run(kernel, schema), schema)


def _postings(sources, terms: DataFrame, per_query: DataFrame | None, judged: DataFrame | None, shared: dict | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with the numbers of their terms, the blocks of each repository, and one row per document."""
    terms = terms.withColumn("own", F.lit(True))
    terms = checkpointed(terms if judged is None else terms.unionByName(judged.withColumn("own", F.lit(False))))
    words = [r[0] for r in terms.select("term").distinct().collect()]
    tid = terms.sparkSession.createDataFrame(list(enumerate(words)), "tid long, term string")
    terms = checkpointed(terms.join(F.broadcast(tid), "term").select("query_id", "repo", "tid", "own"))
    own = terms.groupBy("query_id", "repo").agg(F.collect_list(F.when(F.col("own"), F.col("tid"))).alias("tids"), F.collect_list(F.when(~F.col("own"), F.col("tid"))).alias("judged"))  # a question's own terms
    own = own.drop("judged") if judged is None else own.where(F.size("judged") > 0)
    asked = checkpointed(own if per_query is None else per_query.join(own, ["query_id", "repo"], "left"))
    n = asked.groupBy("repo").agg(F.count("*").alias("n"))
    blocks = checkpointed(n.select("repo", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"), (F.monotonically_increasing_id() * MOST_BLOCKS).alias("g0")))
    known = checkpointed(blocks.select("repo").join(terms.groupBy("repo").agg(F.collect_set("tid").alias("tids")), "repo", "left"))
    pairs = known.agg(F.sum(1 + F.greatest(F.size("tids"), F.lit(0)))).first()[0] or 0
    mine = {r.repo: np.array(r.tids or [], dtype=np.int32) for r in known.toLocalIterator()} if pairs <= FEW_PAIRS else None
    blocks = F.broadcast(blocks) if blocks.count() <= FEW_KEYS else blocks

    rows = reduce(DataFrame.unionByName, (token_rows(docs.where("repo is not null"), spec, words, mine, True) for docs, spec in sources))
    if shared is not None:
        rows = checkpointed(rows)
        shared |= {"asked": own, "blocks": blocks, "rows": rows}
    return asked, blocks, rows


_CAMEL, _TOKEN, _CHINESE = re.compile("([a-z0-9])([A-Z])"), re.compile(TOKEN), re.compile("[一-鿿]+")


def spelled(t: str) -> list[str]:
    """``text.spellings`` of one token."""
    n, out = len(t), [t]
    if _CHINESE.fullmatch(t):
        out += [t[i : i + 2] for i in range(n - 1)]
    if "_" in t:
        out += [x for x in t.split("_") if x]
    if n > 4 and t.endswith("ies"):
        out.append(t[:-3] + "y")
    elif n > 3 and t.endswith("s"):
        out.append(t[:-1])
    if n > 5 and t.endswith("ing"):
        out.append(t[:-3])
    return out


def raw_tokens(text: str | None) -> list[str]:
    """``text.raw_tokens`` of one text."""
    if not text:
        return []
    text = text.replace("-", "_").replace("/", " ")
    return _TOKEN.findall(text if text.islower() else _CAMEL.sub(r"\1_\2", text).lower())


#: Runs of characters that a token may come of: no token, no camel case and no dash reaches over their ends.  Text of ASCII is split at all others.
_WORD = re.compile("[A-Za-z0-9_\\-\u0080-\U0010ffff]+")


_BLANKED = bytes(i if i < 128 and _WORD.match(chr(i)) else 32 for i in range(256))


def split(text: str) -> list[str]:
    return text.encode().translate(_BLANKED).decode().split() if text.isascii() else _WORD.findall(text)


def token_rows(docs: DataFrame, spec: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], words: list[str], mine: dict | None = None, lists: bool = False) -> DataFrame:
    """repo, tid, doc_id, packed: how often each document's view has each of the words, by their position.

    spec: by view, columns of text that is tokenised, and columns that hold tokens.  packed: the view's code, the count and
    the view's number of tokens; a row of tid -1 and count 0 tells that number also where no word is held.  Texts are read
    once, word by word, with what a word stands for remembered: all but a few of them recur.  mine: by repository, the words
    that it keeps; other repositories have no rows.  lists: one row per document, whose tid and packed are bytes of int32 and int64."""
    texts, ready = list(dict.fromkeys(c for t, _ in spec.values() for c in t)), list(dict.fromkeys(c for _, r in spec.values() for c in r))

    def run(batches):
        import pyarrow as pa

        at = {w: i for i, w in enumerate(words)}
        sizes, starts, held = array("q"), array("q", [0]), array("q")

        class Codes(dict):
            """Words numbered as they come; each with the number of tokens that it stands for and those of ``words`` among them."""

            def __missing__(self, word: str) -> int:
                all_ = [x for t in raw_tokens(word) for x in spelled(t)]
                held.extend([at[x] for x in all_ if x in at])
                starts.append(len(held))
                sizes.append(len(all_))
                self[word] = n = len(self)
                return n

        codes = Codes()

        def count(column: list, of: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row and word of all that is held, and each row's number of tokens."""
            n, found = array("q"), array("q")
            for x in column:
                before = len(found)
                if x:
                    found.extend(map(of[0], of[1](x)))
                n.append(len(found) - before)
            n, found = np.frombuffer(n, np.int64), np.frombuffer(found, np.int64)
            row = np.repeat(np.arange(len(n)), n)
            if of[1] is stored:
                return row[found >= 0], found[found >= 0], n
            size, begin, tids = (np.array(x, dtype=np.int64) for x in (sizes, starts, held))
            total = np.bincount(row, weights=size[found], minlength=len(n)).astype(np.int64)
            many_ = begin[found + 1] - begin[found]
            some = many_ > 0
            first_, row, many_ = begin[found[some]], row[some], many_[some]
            place = np.arange(many_.sum()) - np.repeat(np.cumsum(many_) - many_, many_) + np.repeat(first_, many_)
            return np.repeat(row, many_), tids[place], total

        def stored(tokens: list[str]) -> list[str]:
            return tokens

        ways = {True: (codes.__getitem__, split), False: (lambda t: at.get(t, -1), stored)}
        for batch in batches:
            if len(codes) > 500_000:
                codes.clear()
                del sizes[:], held[:], starts[1:]
            repo, doc, n = batch.column("repo"), batch.column("doc_id").to_numpy(), batch.num_rows
            own = {c: count(values(batch.column(c)), ways[c in texts]) for c in (*texts, *ready)}
            parts = []
            for view, (t, r) in spec.items():
                row, tid = (np.concatenate([own[c][i] for c in (*t, *r)]) for i in (0, 1))
                size = sum(own[c][2] for c in (*t, *r))
                key, k = np.unique(row * (len(words) + 1) + tid, return_counts=True)
                row, tid = np.divmod(key, len(words) + 1)
                base = CODES[view] + (size << 32)
                parts.append((row, tid, base[row] + (256 if view in OVERLAPS else k << 8)))
                if view not in OVERLAPS:
                    parts.append((np.arange(n), np.full(n, -1), base))
            row, tid, packed = (np.concatenate([p[i] for p in parts]) for i in range(3))
            here = np.ones(n, dtype=bool)
            if mine is not None:
                names = values(repo)
                here[:] = [x in mine for x in names]
                of = {x: i * (len(words) + 1) + 1 for i, x in enumerate(dict.fromkeys(names))}
                wanted = np.concatenate([np.zeros(0, np.int64), *(i + np.append(mine[x], -1) for x, i in of.items() if x in mine)])
                there = np.isin(np.array([of[x] for x in names], dtype=np.int64)[row] + tid, wanted)
                row, tid, packed = row[there], tid[there], packed[there]
            order = np.argsort(row, kind="stable")
            row, tid, packed = row[order], tid[order].astype(np.int32), packed[order]
            if not lists:
                yield pa.RecordBatch.from_arrays([repo.take(pa.array(row)), pa.array(tid, pa.int64()), pa.array(doc[row], pa.int64()), pa.array(packed, pa.int64())], names=["repo", "tid", "doc_id", "packed"])
                continue
            ends = np.searchsorted(row, np.arange(n), side="right").tolist()
            t, p = tid.tobytes(), packed.tobytes()
            rows = np.flatnonzero(here)
            cut = [(ends[i - 1] if i else 0, ends[i]) for i in rows.tolist()]
            ids, packs = [t[4 * a : 4 * b] for a, b in cut], [p[8 * a : 8 * b] for a, b in cut]
            yield pa.RecordBatch.from_arrays([repo.take(pa.array(rows)), pa.array(ids, pa.binary()), pa.array(doc[rows], pa.int64()), pa.array(packs, pa.binary())], names=["repo", "tid", "doc_id", "packed"])

    kind = "binary" if lists else "long"
    return docs.select("repo", "doc_id", *texts, *ready).mapInArrow(run, f"repo string, tid {kind}, doc_id long, packed {kind}")


def values(column) -> list:
    """The column's values; bytes that are no UTF-8 in a string become replacement characters."""
    import pyarrow as pa

    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


def _run(kernel: Callable, schema: str) -> Callable:
    """One block: arrays from its rows, and its results as a table."""
    fields = [x.strip().split(" ") for x in schema.split(",")]

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        own, facts = right.filter(pc.is_valid(right["query_id"])), right.filter(pc.is_null(right["query_id"]))
        parts = list(kernel(Postings(left, facts), own.to_pylist())) if own.num_rows and left.num_rows + facts.num_rows else []
        whole = lambda i: np.concatenate([p[i] for p in parts]) if isinstance(parts[0][i], np.ndarray) else [x for p in parts for x in p[i]]
        return pa.table({n: pa.array(whole(i) if parts else [], type=kinds[k]) for i, (n, k) in enumerate(fields)})

    return run


class Postings:
    """The documents of one repository, numbered in the order of their ids, with the postings of asked terms by view."""

    def __init__(self, rows, facts) -> None:
        tids, doc = rows["tid"].to_pylist(), rows["doc_id"].to_numpy()
        tid, packed = np.frombuffer(b"".join(tids), np.int32), np.frombuffer(b"".join(rows["packed"].to_pylist()), np.int64)
        own = facts["doc_id"].to_numpy() if "doc_id" in facts.column_names else doc[:0]
        self.ids = np.unique(np.concatenate([doc, own]))
        doc = np.repeat(doc, np.array([len(x) // 4 for x in tids], dtype=np.int64))
        self.facts = facts.take(np.argsort(own, kind="stable")) if len(own) else facts
        at, view, tf, dl = np.searchsorted(self.ids, doc), packed & 255, (packed >> 8) & 0xFFFFFF, packed >> 32
        self.lists: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        self.docs: dict[str, int] = {}
        self.kept: dict[tuple, np.ndarray] = {}
        self.shares: dict[tuple, np.ndarray] = {}
        self.named: tuple | None = None
        for name, code in CODES.items():
            mine = view == code
            whole = mine & (tid == -1) & (tf == 0)  # a stored token may be empty too
            n = self.docs[name] = int(whole.sum())
            mine &= tid != -1
            order = np.argsort(tid[mine], kind="stable")
            t, a, f, size = tid[mine][order], at[mine][order], tf[mine][order].astype(float), dl[mine][order]
            terms, first, df = np.unique(t, return_index=True, return_counts=True)
            d = np.repeat(df, df).astype(float)
            if name in VIEWS:
                mean = max(dl[whole].mean(), 1.0) if n else 1.0
                w = np.log(1 + (n - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))
            elif name in OVERLAPS:
                w = np.ones(len(f))
            else:
                w = (1 + np.log(f)) * (np.log((n + 1) / (1 + d)) + 1)
                w = np.minimum(1.5, w) if name == "chunk" else w
            self.lists[name] = {int(x): (a[i : i + k], w[i : i + k]) for x, i, k in zip(terms, first, df)}

    def sums(self, view: str, tids: list[int], ones: bool = False) -> np.ndarray:
        """Each document's sum over the terms (or their number).  What the terms of many documents add is kept: questions share them."""
        lists, few = self.lists[view], len(self.ids) // 16
        mine = sorted((-len(lists[t][0]), t) for t in tids if t in lists)
        often = tuple(t for n, t in mine if -n > few)
        if (base := self.kept.get((view, ones, often))) is None:
            base = np.zeros(len(self.ids))
            for t in often:
                base[lists[t][0]] += 1.0 if ones else lists[t][1]
            if len(self.kept) >= 32:
                self.kept.clear()
            self.kept[view, ones, often] = base
        out = base.copy()
        for n, t in mine[len(often) :]:
            out[lists[t][0]] += 1.0 if ones else lists[t][1]
        return out

    def ranking(self, view: str, tids: list[int]) -> np.ndarray:
        """Documents with a term, best first, by the score relative to the best, rounded to six digits, and id."""
        raw = self.sums(view, tids)
        there = np.flatnonzero(raw != 0)
        if not len(there):
            return there
        score = rounded(raw[there] / raw[there].max(), 6, whole=True)
        key = (((1 << 20) - score) << 32 | there)[score > 0]
        key.sort()
        return key & 0xFFFFFFFF

    def parts(self, weight: float, k: int) -> np.ndarray:
        """What each rank adds."""
        if (out := self.shares.get((weight, k))) is None:
            out = self.shares[weight, k] = weight / (k + 1.0 + np.arange(len(self.ids)))
        return out

    def points(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Which documents are named, and what routes and calls add to each."""
        if self.named is None:
            flag, routed, calls = (self.facts[c].to_numpy(zero_copy_only=False) for c in ("named", "routed", "calls"))
            self.named = flag.astype(bool), (np.where(routed, 0.3, 0.0), 0.08 * calls)
        return self.named

    def rankings(self, tids: list[int]) -> dict[str, np.ndarray]:
        return {v: r for v in VIEWS if len(r := self.ranking(v, tids))}


def rounded(x: np.ndarray, digits: int, whole: bool = False) -> np.ndarray:
    """Half up, of what is not negative; as whole numbers of the last digit if asked."""
    n = np.floor(x * 10.0**digits + 0.5)
    return n.astype(np.int64) if whole else n / 10.0**digits


def first(score: np.ndarray, k: int, among: np.ndarray | None = None) -> np.ndarray:
    """The k greatest scores over 0 (or of those named), ties by number."""
    there = np.flatnonzero(score != 0) if among is None else among
    s = score[there]
    if len(there) > k:
        there = there[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return there[np.lexsort((there, -score[there]))[:k]]


def parts_of(p: Postings, ranks: dict[str, np.ndarray], views=VIEWS, weights: dict[str, float] = VIEWS, k: int = K_VIEWS) -> np.ndarray:
    """Each document's sum of weight / (k + rank) over the views."""
    out = np.zeros(len(p.ids))
    for v, r in ranks.items():
        if v in views:
            out[r] += p.parts(weights[v], k)[: len(r)]
    return out


def fused(p: Postings, ranks: dict[str, np.ndarray]) -> np.ndarray:
    """Weighted reciprocal rank fusion over the views that answered, at most 1."""
    ceiling = sum(VIEWS[v] for v in ranks) / (K_VIEWS + 1)
    return rounded(np.minimum(1.0, parts_of(p, ranks) / ceiling), 6) if ranks else np.zeros(len(p.ids))


def many(x, n: int) -> np.ndarray:
    return np.full(n, x)


def fusion_top(k: int) -> Callable:
    """query_id, doc_id, rank, score of the k best fused."""

    def run(p: Postings, questions: list[dict]) -> Iterator[tuple]:
        for q in questions:
            score = fused(p, p.rankings(q["tids"]))
            at = first(score, k)
            yield many(q["query_id"], len(at)), p.ids[at], np.arange(1, len(at) + 1), score[at]

    return run


def plain_top(k: int, plain: int, views: tuple[str, ...]) -> Callable:
    """query_id, doc_id, rank, score of the k best by reciprocal ranks without weights."""

    def run(p: Postings, questions: list[dict]) -> Iterator[tuple]:
        for q in questions:
            score = rounded(parts_of(p, p.rankings(q["tids"]), views, dict.fromkeys(VIEWS, 1.0), plain), 9)
            at = first(score, k)
            yield many(q["query_id"], len(at)), p.ids[at], np.arange(1, len(at) + 1), score[at]

    return run


def best_parts(p: Postings, questions: list[dict]) -> Iterator[tuple]:
    """query_id, doc_id, view, part: what each view adds to the document that is fused best."""
    for q in questions:
        ranks = p.rankings(q["tids"])
        at = first(fused(p, ranks), 1)
        for v, r in ranks.items() if len(at) else ():
            if len(i := np.flatnonzero(r == at[0])):
                yield [q["query_id"]], p.ids[at], [v], rounded(VIEWS[v] / (K_VIEWS + 1.0 + i), 9)


def fused_of(p: Postings, questions: list[dict]) -> Iterator[tuple]:
    """query_id, doc_id, score of each question's ``wanted`` documents that are fused at all."""
    for q in questions:
        score = fused(p, p.rankings(q["tids"] or []))
        at = np.searchsorted(p.ids, wanted := np.array(q["wanted"] or [], dtype=np.int64))
        there = at < len(p.ids)
        there[there] = p.ids[at[there]] == wanted[there]
        at = at[there]
        at = at[score[at] > 0]
        yield many(q["query_id"], len(at)), p.ids[at], score[at]


def variant_tops(variants: dict[str, tuple[str, ...]], depth: int) -> Callable:
    """method, query_id, doc_id, rank: the first documents of every variant's fusion."""

    def run(p: Postings, questions: list[dict]) -> Iterator[tuple]:
        for q in questions:
            for m, at in _variants(p, q, variants, depth):
                yield [m] * len(at), many(q["query_id"], len(at)), p.ids[at], np.arange(1, len(at) + 1)

    return run


def _variants(p: Postings, q: dict, variants: dict[str, tuple[str, ...]], depth: int) -> Iterator[tuple[str, np.ndarray]]:
    own = {v: parts_of(p, {v: r}) for v, r in p.rankings(q["tids"] or []).items()}
    for m, views in variants.items():
        yield m, first(rounded(sum((x for v, x in own.items() if v in views), np.zeros(len(p.ids))), 9), depth)


def variant_cases(variants: dict[str, tuple[str, ...]], depth: int) -> Callable:
    """What ``evaluate.measures`` takes of every variant's first documents: a document's relevance is the number of the question's ``judged`` words that its symbol has; questions without a relevant one have no rows."""

    def run(p: Postings, questions: list[dict]) -> Iterator[tuple]:
        discount = np.log2(np.arange(10) + 2.0)
        for q in questions:
            relevance = p.sums("symbol", q["judged"], ones=True)
            best = -np.sort(-relevance[relevance > 0])
            if not len(best):
                continue
            ideal = ((2.0 ** best[:10] - 1) / discount[: len(best)]).sum()
            found = []
            for m, at in _variants(p, q, variants, depth):
                hit = np.flatnonzero(relevance[at])
                near = hit[hit < 10]
                dcg = ((2.0 ** relevance[at[near]] - 1) / discount[near]).sum()
                found.append((m, q["query_id"], int(hit[0]) + 1 if len(hit) else None, dcg, len(hit), (np.arange(1, len(hit) + 1) / (hit + 1.0)).sum(), ideal, len(best)))
            yield tuple(map(list, zip(*found)))

    return run


def chunk_score_of(p: Postings, q: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents that a question scores, every document's score (0 for others), and its number of matched terms."""
    tids = q["tids"] or []
    matched, f = p.sums("chunk", tids, ones=True), fused(p, p.rankings(tids))
    own = lambda view, most, each: np.minimum(most, each * p.sums(view, tids, ones=True))
    s = np.minimum(6.0, p.sums("chunk", tids)) + 16.0 * f + own("symbol", 6.0, 2.5) + own("relpath", 8.0, 3.0) + own("route", 5.0, 2.0)
    flag, more = p.points()
    s = np.where(flag, s + 0.25, s * 0.38) + np.where(p.sums("language", tids, ones=True) > 0, 10.0, 0.0) + more[0] + more[1]
    there = np.flatnonzero((matched > 0) | (f >= 0.16))
    return there, rounded(s, 5), matched


def chunk_tops(k: int) -> Callable:
    """query_id, doc_id, rank, score, matched of the k best chunks."""

    def run(p: Postings, questions: list[dict]) -> Iterator[tuple]:
        for q in questions:
            there, score, matched = chunk_score_of(p, q)
            at = first(score, k, there)
            yield many(q["query_id"], len(at)), p.ids[at], np.arange(1, len(at) + 1), score[at], matched[at].astype(np.int64)

    return run


def candidate_tops(best: int, k: int) -> Callable:
    """query_id, doc_id, rank, score, boost: the chunks of a question's ``files`` that score, and their overviews in any case, with
    the file's boost; and the ``best`` chunks overall; the better score of a chunk counts, and k stay."""

    def run(p: Postings, questions: list[dict]) -> Iterator[tuple]:
        place = defaultdict(list)
        for i, path in enumerate(p.facts["path"].to_pylist()):
            place[path].append(i)
        overview = p.facts["overview"].to_numpy(zero_copy_only=False).astype(bool)
        for q in questions:
            there, score, _ = chunk_score_of(p, q)
            scores = np.zeros(len(score), dtype=bool)
            scores[there] = True
            boost = np.zeros(len(score))
            listed = [(i, b) for path, b in zip(q["files"] or [], q["boosts"] or []) for i in place.get(path, ())]
            of = np.array([i for i, _ in listed], dtype=np.int64)
            boost[of] = [b for _, b in listed]
            of = of[overview[of] | (scores[of] & (score[of] > 0))]
            total = np.full(len(score), -np.inf)
            total[of] = np.where(scores[of], score[of], 0.0) + boost[of] + np.where(overview[of], q["lift"], 0.0)
            top = first(score, best, there)
            total[top] = np.maximum(total[top], score[top] + boost[top])
            at = np.flatnonzero(total > -np.inf)
            total[at] = np.sign(total[at]) * rounded(np.abs(total[at]), 5)
            at = first(total, k, at)
            yield many(q["query_id"], len(at)), p.ids[at], np.arange(1, len(at) + 1), total[at], boost[at]

    return run


def file_tops(k: int) -> Callable:
    """query_id, relpath, rank, score, matched of the k best files: the terms' sum and points for roles that the question asks for."""

    def run(p: Postings, questions: list[dict]) -> Iterator[tuple]:
        roles, paths = p.facts["roles"].to_pylist(), np.array([*values(p.facts["relpath"]), None], dtype=object)[:-1]
        points: dict[tuple, np.ndarray] = {}
        for q in questions:
            tids, asked = q["tids"] or [], tuple(sorted(set(q.get("asked") or ())))
            if asked not in points:
                n = np.array([len({*asked}.intersection(r or ())) for r in roles] if asked else [0] * len(p.ids), dtype=float)
                points[asked] = np.where(n > 0, 3.0 + np.minimum(3.0, 0.75 * n), 0.0)
            matched = p.sums("file", tids, ones=True)
            score = rounded(p.sums("file", tids) + points[asked], 6)
            at = first(score, k, np.flatnonzero((matched > 0) | (points[asked] > 0)))
            yield many(q["query_id"], len(at)), paths[at], np.arange(1, len(at) + 1), score[at], matched[at].astype(np.int64)

    return run
