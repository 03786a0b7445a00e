"""Problem 9: per-document text quality statistics, and the texts that are not natural prose.

Words, common words, symbols, line ends, repetition (duplicate lines and paragraphs, coverage of dominant n-grams) and
layout are measured on the whole text; combined rules tell running sentences from lists, tables and junk.  Null, empty
and blank texts have zero statistics and are no cases.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import map_rows, table

#: Very frequent function words of some written languages.
COMMON = frozenset(
    """the a an of to and in is it its that this these those for on with as was were be been are by at from or not but have has had he she they we you i his her their our your which who whom whose what when where why how if then than so because while although though before after into over under about between through during without within there here no nor only also just more most some any each every all both few many much such own same other another can could may might must shall should will would do does did doing don't doesn't didn't can't isn't aren't wasn't weren't won't it's that's we'd we're they're you're up out off down again once
der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war waren wird werden wurde wurden hat haben hatte hatten sich auf aus bei mit nach von vor zu zum zur über unter durch für gegen ohne um an in im am als wie wenn weil dass daß ob sodass so auch noch nur schon sehr mehr kein keine keinen es er sie wir ihr ich man was wer wo warum wobei damit bevor nachdem seit hinter zwischen niemand jemand etwas
le la les l' un une des du de d' et ou mais ne pas n' est sont était étaient être a ont avait avaient avoir il elle ils elles on nous vous je se s' ce c' cette ces cet qui que qu' quoi dont où y en au aux dans par pour sur sous avec sans chez vers entre avant après depuis pendant si comme parce puis plus moins très aussi bien encore jamais tout toute tous toutes son sa ses leur leurs notre nos votre vos même quand lorsque dès
el los las un una unos unas y e o u pero no es son era eran ser fue fueron está están ha han había se lo le les su sus mi mis tu tus nos que qué quien cual cuando donde como cómo por para con sin sobre entre hasta desde tras según al del en a ante bajo muy más menos también ya sí este esta estos estas ese esa eso aquel porque aunque mientras antes después nadie alguien algo todo toda todos
il lo gli i della dello dei degli delle di da nel nella con su per tra fra che chi cui non è sono era erano ha hanno si ci anche come perché quando dove più questo questa quello um uma os as do dos das no na nos nas com sem por para não é são foi eram ser que quem se mas como mais muito também seu sua isso este esta het een van en dat die niet zijn was waren op te met voor aan bij uit om ook maar dan nog wel hij zij wij
och att det som en ett är var på av för med till den inte har de i om men så kan skal og er på af til ikke det jeg vi han hun ja ei se oli että mutta kun niin hän
w z na do nie się to że jest i o jak ale co za po od przez dla być był była tak już tylko и в не на что я он с как это по но они мы она так его за из у же вы бы от то для о все был была были быть или при без под над если когда чтобы через после перед
bir ve bu için ile da de ne çok daha gibi olan olarak değil ama ki""".split()
)
#: Frequent function characters of Chinese and Japanese text.
HAN_COMMON = frozenset("的了是在不和有这那我你他她它们个上下来去到说要会就也都而及与或但因为所以被把从对于后前时没只很之其且则者何无未已将可能该此每")
_TOKEN = re.compile(r"[^\W\d_][\w'’\-]*|[\d_][\w.\-]*")
_HAN = re.compile(r"[一-鿿㐀-䶿]")
_KANA = re.compile(r"[぀-ヿ]")
_BULLET = re.compile(r"^\s*(?:[-*+•·–—▪◦‣○●→>»]\s+|\[[ xX]\]\s*|(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]\s+|[（(]\d{1,3}[)）]\s*|#\d+\s+|[①-⑳]|\d{1,2}、|第[一二三四五六七八九十]+[,、.])")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={3,}|-{3,}|\*\*[^*]+\*\*\s*$)")
_FIELD = re.compile(r"""^\s*(?:[\w ./\-]{1,32}?\s*(?:=|:(?!//)|\.{3,}|\t|->|=>)\s*\S.{0,60}$|[{\[<|].*[}\]>|],?\s*$)""")
_CODE = re.compile(r"""(?x)[;{}]\s*$ | ^\s*(?:def|class|import|from|return|const|let|var|function|if|for|while|try|except|catch|else|export|async|await|public|private|static|\#include|@\w+)\b.*[:;({)\]]\s*$ | =>|\(\)\s*[;{] | ^\s*</?\w+.*>\s*$ | ===|!==|&&|\|\|""")
#: A method's call, if a closing bracket follows anywhere.
_METHOD = re.compile(r"\w\.\w+\(")
#: Every form of code has one of these.
_CODE_MARK = re.compile(r"[;{}=(<&|\])]|:$")
_LOG = re.compile(r"""(?x)^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d | \d\d:\d\d:\d\d | \[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b | at\ [\w.$<>]+\s*\( | File\ ".*",\ line\ \d+ | Traceback | [\w.]+(?:Error|Exception)\b: | [0-9a-f]{6,16}\s+(?:[0-9a-f]{2}\s){4} | \w{3}\s+\d+\s\d\d:\d\d )""")
_PATH = re.compile(r"^[\w.@-]*(?:[/\\][\w.@-]+){1,}$")
_STOP = tuple(".!?。！？…:;：；\"')”’»)]`")
_TEXT_MARKS = ".,'\"!?。，！？、-–—`’‘“”„«»:;：；()（）…¿¡¡·%"
_BREAK = re.compile(r"[,;、，；|•·]|\s[/–>-]{1,2}\s")
_HAN_OFTEN = re.compile(f"[{''.join(sorted(HAN_COMMON))}]")
_SYMBOL = re.compile(r"""[^\w.,'"!?。，！？、\-`’:;：；()]|_""")
_DIGIT = re.compile(r"\d")
_ODD = re.compile(rf"[^\w\s{re.escape(_TEXT_MARKS)}]|_")
_COLUMNS = re.compile(r"\S(?:\s{2,}\S+){2,}")
_ITEMS = re.compile(r"[,;|\t、，；/•·]|\s[-–>]\s|\n")
#: Shares of repeated lines or paragraphs, and of characters under the dominant n-gram, of texts that say little.
MOST_REPEATED, MOST_COVERED, FAIR_COVERED = 0.6, 0.5, 0.25
#: Least share of a text's characters in running lines.
PROSE_LEAST = 0.5
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)|[。！？…]")

STATS = "chars int, words int, mean_word_length double, symbol_share double, digit_share double, line_end_share double, common_share double, lines int, mean_line_words double, bullet_share double, field_share double, code_share double, log_share double, separator_share double, duplicate_line_share double, duplicate_paragraph_share double, top_ngram_share double, top_word_share double, distinct_share double, sentence_words double, prose_share double, kind string"


def _coverage(words: list[str], n: int) -> tuple[float, int]:
    """(share of the words' characters that the most frequent n-gram covers, its first occurrence apart; its number).  Overlaps count once."""
    if len(words) < 2 * n:
        return 0.0, 0
    grams = list(zip(*(words[i:] for i in range(n)))) if n > 1 else words
    gram, times = Counter(grams).most_common(1)[0]
    if times < 2:
        return 0.0, times
    size = sum(map(len, gram)) if n > 1 else len(gram)
    if n == 1 or times * n <= len(set(gram)):
        covered = times * size
    else:
        covered, end, at = 0, 0, -1
        for _ in range(times):
            at = grams.index(gram, at + 1)
            covered += sum(map(len, words[max(at, end) : at + n]))
            end = at + n
    return max(0, covered - size) / sum(map(len, words)), times


def _dominant(tokens: list[str], most: int = 4) -> float:
    """Greatest coverage of an n-gram of at most ``most`` words; a length whose n-grams could not reach it is passed over."""
    if not tokens:
        return 0.0
    best, longest, total = 0.0, max(map(len, tokens)), sum(map(len, tokens))
    times = len(tokens)
    for n in range(1, most + 1):
        if (times - 1) * n * longest <= best * total:
            break
        share, times = _coverage(tokens, n)
        best = max(best, share)
        if times < 2:
            break
    return best


class _Line:
    """What one line shows; lines that occur again are measured once."""

    __slots__ = ("size", "tokens", "words", "common", "han", "kana", "bullet", "field", "code", "log", "bare", "prose", "sentence")

    def __init__(self, x: str):
        s = x.strip()
        self.size = len(s)
        self.han = self.kana = frequent = 0
        if s.isascii():
            self.tokens = _TOKEN.findall(s.lower())
        else:
            self.han, self.kana, frequent = len(_HAN.findall(s)), len(_KANA.findall(s)), len(_HAN_OFTEN.findall(s))
            self.tokens = [w.lower() for w in _TOKEN.findall(_HAN.sub(" ", s))]
        self.words = begun = [w for w in self.tokens if w[0].isalpha()]
        if len(begun) < len(self.tokens):
            self.words = [w for w in self.tokens if any(map(str.isalpha, w))]
        known = _common(self.words, "'" in s)
        self.common = known + 2 * frequent + self.kana // 2
        self.bullet, self.log = bool(_BULLET.match(x)), bool(_LOG.match(x))
        cells = _delimited(x)
        self.field, self.code = cells or bool(_FIELD.match(x)), bool(_CODE_MARK.search(s) and (_CODE.search(x) or (m := _METHOD.search(x)) and x.rfind(")") >= m.end()))
        alpha = len(begun)
        weight = alpha + (self.han + self.kana) / 2
        self.bare = self.prose = self.sentence = False
        if weight < 5:
            self.bare = cells or self.log or self.bullet
            return
        odd = len(_ODD.findall(s)) / len(s)
        breaks = len(_BREAK.findall(s))
        listed = breaks >= 2 and weight / (breaks + 1) < 4.2 and not _SENTENCE_END.search(s[:-1])
        self.bare = bool(cells or self.log or (odd > 0.05 and self.code) or odd > 0.15 or listed or (self.bullet and weight < 12))
        if not self.bare:
            share = self.common / (alpha + self.han + self.kana)
            self.sentence = share >= 0.15
            self.prose = self.sentence or _sentence_like(s, self.tokens)


def _common(words: list[str], elided: bool) -> int:
    known = sum(map(COMMON.__contains__, words))
    if elided:  # words such as l'index, and those whose whole spelling is not listed
        known += sum(w not in COMMON and (w.partition("'")[0] + "'" in COMMON or w.partition("'")[2] in COMMON) for w in words if "'" in w)
    return known


def _wrapped(lines: list[str], seen: list[_Line]) -> list[bool]:
    """Whether each line reads as running text, by itself or in a paragraph whose joined lines do."""
    flags = [x.prose for x in seen]
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            if i - start > 1 and not any(flags[start:i]) and not any(x.bare for x in seen[start:i]):
                whole = " ".join(x.strip() for x in lines[start:i])
                if _sentence_like(whole, [w for x in seen[start:i] for w in x.tokens]):
                    flags[start:i] = [True] * (i - start)
            start = i + 1
    return flags


def text_stats(text: str | None) -> dict:
    t = (text or "").replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("’", "'")
    solid = "".join(t.split())
    n = len(solid)
    zero = dict.fromkeys([p.split()[0] for p in STATS.split(", ")], 0.0)
    if n == 0:
        return zero | {"chars": len(text or ""), "words": 0, "lines": 0, "kind": None}
    every = t.split("\n")
    memo: dict[str, _Line] = {}
    measured = [memo.get(x) or memo.setdefault(x, _Line(x)) for x in every]
    flags = _wrapped(every, measured)
    lines, seen, flags = zip(*((x, m, f) for x, m, f in zip(every, measured, flags) if m.size))
    paragraphs = [p for p in re.split(r"\n\s*\n", t) if p.strip()]
    tokens = [w for m in seen for w in m.tokens]
    words = [w for m in seen for w in m.words]
    han, kana = sum(m.han for m in seen), sum(m.kana for m in seen)
    count, total = len(tokens) + han + kana, sum(m.size for m in seen)
    field = code = log = bullets = 0
    for m in seen:
        field += m.size * m.field
        code += m.size * m.code
        log += m.size * m.log
        bullets += m.bullet
    items = len(_ITEMS.findall(t)) + 1
    often = Counter(x.strip() for x in lines)
    par = Counter(" ".join(p.split()) for p in paragraphs)
    grams = _dominant(tokens)
    if han > len(tokens):
        grams = max(grams, _coverage(list(solid), 4)[0])
    start = _body(lines, flags)
    stats = {
        "chars": len(text), "words": count, "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0, "symbol_share": len(_SYMBOL.findall(solid)) / n, "digit_share": len(_DIGIT.findall(solid)) / n,
        "line_end_share": sum(x.rstrip().endswith(_STOP) for x in lines) / len(lines), "common_share": sum(m.common for m in seen) / max(1, len(words) + han + kana), "lines": len(lines), "mean_line_words": count / len(lines),
        "bullet_share": bullets / len(lines), "field_share": field / total, "code_share": code / total, "log_share": log / total, "separator_share": items / max(1, count),
        "duplicate_line_share": sum((k - 1) * len(x) for x, k in often.items()) / total, "duplicate_paragraph_share": sum((k - 1) * len(p) for p, k in par.items()) / sum(len(p) * k for p, k in par.items()),
        "top_ngram_share": grams, "top_word_share": Counter(tokens).most_common(1)[0][1] / count if tokens else 0.0, "distinct_share": len(set(tokens)) / len(tokens) if tokens else 1.0,
        "sentence_words": count / max(1, sum(1 for x in _SENTENCE_END.split(t) if x.strip())), "prose_share": sum(m.size for m, f in zip(seen[start:], flags[start:]) if f) / max(1, sum(m.size for m in seen[start:])),
    }
    return zero | {k: round(v, 6) if isinstance(v, float) else v for k, v in stats.items()} | {"kind": kind_of(stats)}


def _delimited(line: str) -> bool:
    """A record: three or more cells between one delimiter, none of them a sentence."""
    for d in ("|", "\t", ";", ","):
        if d in line and line.count(d) >= 2:
            cells = [c.strip() for c in line.split(d)]
            if sum(len(c.split()) <= 1 and len(c) < 40 for c in cells) >= 0.8 * len(cells):
                return True
    return ("  " in line or "\t" in line or not line.isascii()) and bool(_COLUMNS.search(line.strip()))


def _sentence_like(line: str, words: list[str]) -> bool:
    """Running text in a language without a word list: plain words of usual length between sentence ends."""
    plain = sum(w.isalpha() and 1 <= len(w) <= 18 for w in words)
    ends = len(_SENTENCE_END.findall(line))
    return len(words) >= 6 and plain >= 0.9 * len(words) and ends > 0 and 4 <= len(words) / ends <= 45 and line.lstrip("\"'«„“¿¡([")[:1].isupper() and sum(w != w.lower() and w != w.capitalize() for w in line.split()) <= 0.1 * len(words)


def _body(lines: list[str], flags: list[bool]) -> int:
    """Where the text starts behind one leading sentence, if three lines or more follow it and it stands for itself."""
    return 1 if len(lines) >= 4 and flags[0] and not flags[1] and not flags[2] else 0


def kind_of(s: dict) -> str:
    """prose, list, table or junk by combined rules, in this order.

    1. No words, or mostly log and trace lines: junk.
    2. Repetition: lines or paragraphs that repeat for the most part, or one n-gram that covers most of the words, are
       junk whatever they say; what covers a fair part is junk (menus, boilerplate, minified code) unless it is read as
       running text nearly throughout.
    3. Mostly running lines: prose.
    4. Mostly fields or records: a table.  Mostly bullets or short separated items: a list.  Else junk."""
    repeated = max(s["duplicate_line_share"], s["duplicate_paragraph_share"])
    if s["words"] == 0 or s["log_share"] > 0.5:
        return "junk"
    if repeated > MOST_REPEATED or s["top_ngram_share"] > MOST_COVERED or (s["top_ngram_share"] > FAIR_COVERED and s["prose_share"] < 0.9 and s["bullet_share"] < 0.4):
        return "junk"
    if s["prose_share"] >= PROSE_LEAST:
        return "prose"
    if s["field_share"] > 0.5 and s["digit_share"] < 0.6:
        return "table"
    if s["bullet_share"] > 0.4 or s["separator_share"] > 0.2 and s["mean_word_length"] < 16 and s["code_share"] < 0.7:
        return "list"
    return "junk"


def text_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, carried columns, statistics and kind (null for a text without characters); no shuffle."""
    kinds = dict(docs.dtypes)
    cols = [key, *carry]
    names = [p.split()[0] for p in STATS.split(", ")]

    def one(body, *rest):
        s = text_stats(body)
        yield (*rest, *(s[n] for n in names))

    return map_rows(docs.select(text, *cols), ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", " + STATS, one)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents")).where("kind is not null and kind <> 'prose'").select("doc_id")


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"))


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of text by source."""
    return text_quality(table(spark, sf_dir, "documents"), carry=("source",)).groupBy("source", "kind").agg(F.count("*").alias("docs"), F.round(F.avg("common_share"), 6).alias("mean_common_share"))


QUERIES = {"p9_found": p9_found, "p9_quality": p9_quality, "p9_sources": p9_sources}
