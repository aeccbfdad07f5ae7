"""Sentence boundaries across languages and scripts.

Paragraphs end at blank lines. Within one, candidates are runs of end marks; quotations and brackets are kept whole. A
full stop is judged by the word before it and by what follows. Whether the word is an abbreviation comes first from its
unambiguous occurrences elsewhere in the document: a stop before a lower-case word or a comma speaks for it, a use without
a stop against it. Where the document says nothing, counts over the corpus decide, and only where these say nothing
either, a list of common abbreviations of the document's languages. Whether a capital after an abbreviation begins a
sentence or a name comes from the document's lower-case uses of the word and its capitals amid sentences. Scripts without
case or spaces have rules of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cached_property
from types import MappingProxyType
from unicodedata import category
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryglass.plans.cut import Scratch
from quarryglass.plans.sizing import at_most

#: Learned words up to which they are sent to the tasks; beyond, each document gets its own by a join.
LEARNED_BROADCAST = 200_000
#: Unambiguous uses that decide over a word in the corpus, stops that may stand in for them, and the share they must have.
LEAST_EVIDENCE, LEAST_STOPS, STOP_SHARE = 5, 20, 0.9
#: Share of a word's stops at the end of a paragraph from which on they show that it ends sentences; different words (as
#: bits of a bitmap of 64) that must follow one that never stands there, so that copies of one text are no evidence.
FINAL_SHARE, LEAST_FOLLOWERS = 0.01, 8
#: Distinct words a task counts before it hands on its counts.
WORDS_HELD = 500_000
#: Function words that show a language to be one of a document's: its lists hold, as a sentence of it may be quoted.
LANGUAGE_WORDS = 1

# Common abbreviations by language. These don't end a sentence, as a name or number follows them.
LEADING = {
    "any": frozenset("dr prof mr mrs ms hon gen col sen rep fig figs no nos vol vols p pp ch ca cca circa cf vs v ed eds approx max min e.g i.e".split()),
    "en": frozenset("mx st rev capt lt sgt maj gov pres supt messrs mt ft pg chap sec eq ref refs viz resp incl excl".split()),
    "de": frozenset("hr frau dipl ing nr abb tab vgl bzw s str bd kap art z.b d.h u.a z.t evtl ggf inkl zzgl".split()),
    "fr": frozenset("m mm mme mlle mgr me fr n° chap art p.ex c.-à-d env av bd".split()),
    "es": frozenset("ex sr sra srta dra d dª dña ud uds lic núm pág págs art cap p.ej ej aprox".split()),
    "it": frozenset("sig sigg dott avv art cap pag pagg".split()),
    "ru": frozenset("см ср рис стр г-н г-жа проф акад доц им ул пр просп пл д кв гл табл напр т.е т.н".split()),
    "hi": frozenset("डॉ सं श्री प्रो पं कु रु क्र पृ".split()),
    "ar": frozenset("د أ م ص ج ط ق هـ".split()),
    "th": frozenset("ดร ผศ รศ ศ พ.ศ ค.ศ น.ส".split()),
}
#: These may end a sentence, and do before a capital, a number or a quotation.
ENDING = {
    "any": frozenset("etc p.m a.m jr sr. inc ltd co corp bros ff et.al".split()),
    "de": frozenset("usw u.s.w".split()),
    "ru": frozenset("др т.д т.п и.т.д пр.".split()),
}
#: The languages that share a script with others, by frequent words that the others lack.
FUNCTION_WORDS = {
    "en": frozenset("the of and to is that with for was from this".split()),
    "de": frozenset("der die und das ist nicht mit auf dem den ein eine wird".split()),
    "fr": frozenset("le les et des est une dans du pour sur avec".split()),
    "es": frozenset("el los las y que una por con del se".split()),
    "it": frozenset("il che di e gli della per non sono nel".split()),
}
#: Pairs that end a sentence as one abbreviation when written apart.
ENDING_PAIRS = frozenset({("т", "д"), ("т", "п"), ("p", "m"), ("a", "m"), ("u", "a"), ("et", "al")})
#: For every listed word the kind of its list and the language.
LISTED = {w: [(kind, k) for kind, groups in (("leading", LEADING), ("ending", ENDING)) for k, words in groups.items() if w in words] for w in set().union(*LEADING.values(), *ENDING.values())}
MONTHS_DE = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
#: Words that are ordinary ones too and keep their stop within the sentence before a number.
BEFORE_NUMBERS = frozenset("no nos nr fig figs art abb tab vol vols ch chap sec eq p pp pg núm pág cap pag".split())
#: Words before a number with a stop that make it an ordinal in German.
BEFORE_ORDINAL = frozenset("am vom zum bis ab im der des dem den die das seit".split())
STARTERS = frozenset("then the a an this that these those it he she they we you i in on at when while if but and however there for after before".split())

PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "„": "“", "‚": "‘"}
CLOSERS = frozenset("”»)]）］」』】》〉’")
QUOTED = CLOSERS | frozenset('“"')
SURE_ENDS = frozenset("。！？｡।॥؟۔‼⁇⁈⁉։።။។")
WHITE = r"[\s﻿]"

BREAK = regex.compile(r"(?:\r\n|[\n\r \x0b\x0c\x85])[^\S\n\r \x0b\x0c\x85]*﻿*(?:[^\S\n\r \x0b\x0c\x85]|﻿)*(?=[\n\r \x0b\x0c\x85])| ")
ENDS_AND_PAIRS = r"[.．!?…‥。！？｡।॥؟۔‼⁇⁈⁉։።။។]+|[“”«»()\[\]（）［］「」『』【】《》〈〉„\"]"
MARKS = re.compile(ENDS_AND_PAIRS)
MARKS_THAI = regex.compile(ENDS_AND_PAIRS + r"|(?<=\p{Thai})" + WHITE + r"+(?=\p{Thai})")
THAI = re.compile("[\u0e00-\u0e7f]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
FILE = regex.compile(r"(?:[\w\-]*[\d_][\w\-]*\.\w{1,5}\b|/\w+/)")
NUMBER = regex.compile(r"\d+(?:[.,:]\d+)*(?![\w\-]|\.\w)")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.’'\-][\p{L}\p{M}\p{N}]+)*")
NO_WORD_BEFORE = r"(?<![\p{L}\p{M}\p{N}.])"
#: Words, but no parts of names with dots.
WORDS = regex.compile(NO_WORD_BEFORE + r"\p{L}[\p{L}\p{M}]*+(?![\p{L}\p{M}\p{N}]|\.[\p{L}\p{N}])")
#: Stops after which neither a letter nor another stop stands; those of them before a lower-case word or a comma.
STOP = re.compile(r"\.(?![\w.])")
STOP_INSIDE = regex.compile(r"\.(?:\s+(?=\p{Ll})|(?=[,;]))")
CAPITAL_INSIDE = regex.compile(r"(?<=\p{Ll},?[^\S\n]+)\p{Lu}[\p{L}\p{M}]*+")
UPPER = regex.compile(r"[\p{Lu}\p{Lt}]")
LOWER_WORD = regex.compile(r"(?<![\p{L}\p{M}])\p{Ll}[\p{L}\p{M}]*")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between lines that are empty or hold only white space or byte-order marks."""
    start = 0
    for m in BREAK.finditer(text):
        yield start, m.start()
        start = m.end()
    yield start, len(text)


#: What follows a word: nothing of a stop, or a stop and then a lower-case word or a comma, a number, a blank line or the end, something else.
USES = ("bare", "inside", "digit", "final", "other")


def last_word(text: str, e: int) -> str:
    """The word of letters and marks that ends at ``e``, in lower case; '' if there is none or a number or a stop goes before it."""
    a = e
    while a and ((c := text[a - 1]).isalpha() or c > "\u02ff" and category(c)[0] == "M"):
        a -= 1
    return text[a:e].lower() if a < e and text[a].isalpha() and not (a and (text[a - 1] == "." or text[a - 1].isnumeric())) else ""


def count_uses(text: str, uses: dict[str, Counter], followers: dict[str, int]) -> None:
    """Add how often each word, in lower case, occurs in each of the ``USES``, and a bitmap of the words that follow its stops.

    Bare uses stand between white space; what else stands there is counted along, and no word has it for a name.
    Paragraphs without capitals say nothing on what follows a stop, nor do file names.
    """
    place = _Places(text)
    for m in STOP.finditer(text):
        w = last_word(text, m.start())
        if not w:
            continue
        use, q = place.use(m.end())
        uses[use][w] += 1
        if use == "other" and (n := WORD.match(text, q)):
            followers[w] = followers.get(w, 0) | 1 << (crc32(n[0].encode("utf-8", "surrogatepass")) & 63)
    uses["bare"].update(text.lower().split())


class _Places:
    """What stands after stops."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def _paragraphs(self) -> tuple[list[int], list[bool]]:
        spans = list(paragraphs(self.text))
        return [a for a, _ in spans], [UPPER.search(self.text, a, b) is not None for a, b in spans]

    def _cased(self, at: int) -> bool:
        starts, cased = self._paragraphs
        return cased[bisect_right(starts, at) - 1]

    def use(self, e: int) -> tuple[str, int]:
        """The use of a stop that ends at ``e``, and where the text goes on."""
        text, q, lines = self.text, e, 0
        while q < len(text) and (text[q].isspace() or text[q] == "﻿"):
            lines += text[q] == "\n" or text[q] == "\r" and text[q + 1 : q + 2] != "\n"
            q += 1
        if q == len(text) or lines > 1:
            return "final", q
        n = text[q]
        if q == e:
            return "inside" if n in ",;" else "other", q
        if n.isdigit():
            return "digit", q
        return "inside" if n.islower() and not FILE.match(text, q) and self._cased(e) else "other", q


class Document:
    """What one text shows of its words; each fact is looked up when it is first asked for."""

    def __init__(self, text: str, corpus: Mapping[str, str] = MappingProxyType({}), lists: bool = True):
        self.text, self.corpus, self.lists = text, corpus, lists
        self._known: dict[str, str] = {}

    @cached_property
    def thai(self) -> bool:
        """Whether it holds letters of a script whose white space ends sentences."""
        return THAI.search(self.text) is not None

    @cached_property
    def _lower(self) -> str:
        return self.text.lower()

    @cached_property
    def inside(self) -> frozenset[str]:
        """Words with a stop and then a lower-case word or a comma."""
        place, found = _Places(self.text), set()
        for m in STOP_INSIDE.finditer(self.text):
            if (w := last_word(self.text, m.start())) and place.use(m.start() + 1)[0] == "inside":
                found.add(w)
        return frozenset(found)

    def bare(self, word: str) -> bool:
        """Whether the word stands without a stop somewhere."""
        low = self._lower
        at = low.find(word)
        while at >= 0:
            m = WORDS.match(low, at)
            if m and m.end() == at + len(word) and low[m.end() : m.end() + 1] != ".":
                return True
            at = low.find(word, at + 1)
        return False

    @cached_property
    def ordinary(self) -> frozenset[str]:
        """Words in lower case."""
        return frozenset(LOWER_WORD.findall(self.text))

    @cached_property
    def names(self) -> frozenset[str]:
        """Words with a capital amid a sentence."""
        return frozenset(w.lower() for w in CAPITAL_INSIDE.findall(self.text))

    @cached_property
    def languages(self) -> frozenset[str]:
        """The languages whose lists hold for this text: those of its function words, or all if it has none."""
        words = Counter(self._lower.split())
        n = {k: sum(words[w] for w in ws) for k, ws in FUNCTION_WORDS.items()}
        top = max(n.values())
        return frozenset(k for k in LEADING.keys() | ENDING.keys() if n.get(k, top) >= min(LANGUAGE_WORDS, top))

    def _listed(self, word: str) -> str:
        return next((kind for kind, language in LISTED.get(word, ()) if language in self.languages), "")

    def kind(self, word: str) -> str:
        """``abbreviation`` or ``ordinary`` by evidence, ``leading`` or ``ending`` by the lists, or '' for any other word.

        The document goes first, then the corpus, then the lists. A word that evidence shows to be an abbreviation keeps
        what the lists know of it.
        """
        known = self._known.get(word)
        if known is None:
            known = self._known[word] = self._kind(word)
        return known

    def _kind(self, word: str) -> str:
        listed = self._listed(word) if self.lists else ""
        shown = word in self.inside
        corpus = self.corpus.get(word, "")
        if not (listed or shown or corpus):
            return ""
        bare = self.bare(word)
        if bare and not shown:
            return "ordinary"
        if shown and not bare:
            return listed or "abbreviation"
        if corpus == "ordinary":
            return "ordinary"
        return listed or corpus


def _partners(text: str, a: int, b: int, marks: list[regex.Match]) -> list[tuple[int, int]]:
    """Outermost quotations and brackets with both ends in the paragraph, by position."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in marks:
        c, at = m[0], m.start()
        if c == '"':
            if any(x == '"' for x, _ in stack):
                while stack and stack[-1][0] != '"':
                    stack.pop()
                found.append((stack.pop()[1], at))
            elif at + 1 < b and not text[at + 1].isspace():
                stack.append(('"', at))
        elif c in "”“»)]）］」』】》〉" and any(x == c for x, _ in stack):
            while stack[-1][0] != c:
                stack.pop()
            found.append((stack.pop()[1], at))
        elif c in PAIRS:
            stack.append((PAIRS[c], at))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if not out or s > out[-1][1]:
            out.append((s, e))
    return out


class _Paragraph:
    def __init__(self, document: Document, a: int, b: int):
        self.t, self.a, self.b, self.document = document.text, a, b, document

    def after(self, p: int) -> tuple[int, str]:
        """The first place from ``p`` on that is neither white nor invisible, and its character ('' at the end)."""
        t = self.t
        while p < self.b and (t[p].isspace() or t[p] in "﻿​⁠‎‏"):
            p += 1
        return p, t[p] if p < self.b else ""

    def word_before(self, p: int) -> str:
        """What stands between white space (or an opening mark) and ``p``."""
        s = p
        while s > self.a and p - s < 60 and not self.t[s - 1].isspace() and self.t[s - 1] not in "﻿“”«»\"()[]（）「」『』„¿¡":
            s -= 1
        return self.t[s:p]

    def opens(self, q: int, n: str) -> str:
        """What kind of beginning stands at ``q``: upper, lower, digit, quote, file, caseless or other."""
        if FILE.match(self.t, q, self.b):
            return "file"
        if n in PAIRS or n in '"¿¡':
            return "quote"
        if n.isdigit():
            return "digit"
        if n.isalpha():
            return "upper" if UPPER.match(n) else "lower" if n.islower() else "caseless"
        return "other"

    def full_stop(self, s: int, e: int) -> bool:
        """Whether the single stop at ``s`` ends a sentence; ``e`` is after it and closing marks."""
        t = self.t
        word = self.word_before(s)
        q, n = self.after(e)
        kind = self.opens(q, n) if n else "other"
        if not word:
            return s > self.a and t[s - 1] in QUOTED and (not n or q > e and kind in ("upper", "digit", "quote", "file", "caseless"))
        low = word.lower().strip("​⁠'’")
        if q == e and n:
            if CJK.match(t[s - 1]):
                return CJK.match(n) is not None
            plain = word.isalpha() and len(word) > 1 and t[s - 1].islower() and kind == "upper" and q + 1 < self.b
            return plain and (t[q + 1].isalpha() or t[q + 1].isspace()) and self.document.kind(low) in ("", "ordinary")
        if not n:
            return True
        if kind == "other":
            return False
        if low[-1].isdigit():
            if low.isdigit() and len(low) <= 2 and self.a <= s - len(word) and not t[self.a : s - len(word)].strip("﻿ \t\r\n"):
                return False
            if low.isdigit() and int(low) <= 31 and kind == "upper":
                nxt = WORD.match(t, q, self.b)
                if nxt and nxt[0].lower() in MONTHS_DE:
                    return False
                m = self.before(s - len(word))
                if m in BEFORE_ORDINAL and low not in ("0",):
                    return m in STARTERS
            return True
        bare = low.rstrip(".")
        if len(bare) == 1 and bare.isalpha():
            if (self.before(s - len(word)).rstrip("."), bare) in ENDING_PAIRS:
                return kind != "lower"
            if word == "I" and not self.before(s - len(word)).endswith("."):
                return kind in ("upper", "quote", "file")
            return False
        if bare == "al" and self.before(s - len(word)) == "et":
            return kind != "lower"
        known = self.document.kind(bare)
        if known == "ending":
            return kind != "lower"
        if known == "leading":
            return kind == "upper" and self.starts(q)
        if known == "ordinary":
            return kind != "digit" or bare not in BEFORE_NUMBERS
        parts = bare.split(".")
        if known == "abbreviation" or len(parts) > 1 and all(0 < len(x) <= 2 and x.isalpha() for x in parts):
            return self.begins(q, kind)
        return True

    def starts(self, q: int) -> bool:
        """Whether a function word with a capital stands at ``q``, which is no name."""
        m = WORD.match(self.t, q, self.b)
        return m is not None and m[0].lower() in STARTERS and m[0][1:].islower() and m[0].lower() not in self.document.names

    def before(self, p: int) -> str:
        """The word before the white space that ends at ``p``, in lower case."""
        while p > self.a and self.t[p - 1].isspace():
            p -= 1
        return self.word_before(p).lower()

    def begins(self, q: int, kind: str) -> bool:
        """After an abbreviation: whether what follows begins a sentence, as no name does."""
        if kind in ("quote", "file"):
            return not NUMBER.match(self.t, q, self.b)
        if kind != "upper":
            return False
        m = WORD.match(self.t, q, self.b)
        w = m[0].lower() if m else ""
        return w in STARTERS or w in self.document.ordinary and w not in self.document.names

    def ends(self) -> Iterator[int]:
        """Where sentences end within the paragraph."""
        t, b = self.t, self.b
        marks = list((MARKS_THAI if self.document.thai else MARKS).finditer(t, self.a, b))
        spans = _partners(t, self.a, b, [m for m in marks if len(m[0]) == 1 and (m[0] in PAIRS or m[0] in CLOSERS or m[0] == '"')])
        k = 0
        for m in marks:
            s, e = m.span()
            c = t[s]
            while k < len(spans) and spans[k][1] < s:
                k += 1
            inside = k < len(spans) and spans[k][0] < s
            if c.isspace() or c == "﻿":
                if not inside:
                    yield s
                continue
            if c in PAIRS or c in CLOSERS or c == '"':
                continue
            run = m[0]
            if inside:
                close = spans[k][1]
                if t[e:close].strip("﻿ \t\r\n  ”»)]）］」』】》〉\"’"):
                    continue
                p = close + 1
                while p < b and t[p] in CLOSERS:
                    p += 1
                q, n = self.after(p)
                if n and q > p and self.opens(q, n) in ("upper", "digit", "quote", "file") and not CJK.match(n):
                    if run == "." and self.document.kind(self.word_before(s).lower()) == "leading":
                        continue
                    yield p
                continue
            p = e
            while p < b and t[p] in CLOSERS and not (k < len(spans) and spans[k][0] == p):
                p += 1
            q, n = self.after(p)
            kind = self.opens(q, n) if n else "end"
            if any(x in SURE_ENDS for x in run):
                yield p
            elif "!" in run or "?" in run:
                if q > p or not n:
                    if kind != "other":
                        yield p
                elif kind == "caseless" or (kind == "upper" and t[s - 1].islower()) or kind == "quote" and n in "¿¡":
                    yield p
            elif len(run) > 1 or run == "…":
                prior = t[s - 1] if s > self.a else ""
                if not CJK.match(prior or " ") and q > p and (kind in ("upper", "quote", "file", "caseless") or kind == "digit" and not prior.isspace()):
                    yield p
            elif self.full_stop(s, p):
                yield p


def sentence_spans(text: str, learned: Mapping[str, str] = MappingProxyType({}), lists: bool = True) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentences of a text, without white space or byte-order marks at their ends.

    ``learned``: what the corpus shows of words, see :func:`learned_words`. Without ``lists`` only evidence counts.
    """
    document = Document(text, learned, lists)
    out = []

    def trim(a: int, b: int) -> None:
        while a < b and (text[a].isspace() or text[a] == "﻿"):
            a += 1
        while a < b and (text[b - 1].isspace() or text[b - 1] == "﻿"):
            b -= 1
        if a < b:
            out.append((a, b))

    for a, b in paragraphs(text):
        if a >= b:
            continue
        start = a
        for end in _Paragraph(document, a, b).ends():
            if end > start:
                trim(start, end)
                start = end
        trim(start, b)
    return out


def learned_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(word, kind)``: words that the corpus shows to be abbreviations, and listed ones that it shows to be ordinary words.

    From counts over all documents, combined per task before they are shuffled. An ``abbreviation`` has a stop in
    ``STOP_SHARE`` of its occurrences and, beside it, unambiguous evidence: ``LEAST_EVIDENCE`` stops before a lower-case word
    or a comma, or as many before a number that are half of its stops; or it has at least ``LEAST_STOPS`` stops, at
    least ``LEAST_FOLLOWERS`` different words after them, and the share of them at the end of a paragraph, where every
    sentence ends, is below ``FINAL_SHARE``. ``ordinary``: a listed word of
    which ``STOP_SHARE`` of at least ``LEAST_EVIDENCE`` occurrences have no stop.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {u: Counter() for u in USES}
        after: dict[str, int] = {}

        def emit() -> pd.DataFrame:
            words = sorted(set().union(*(seen[u] for u in USES[1:]), (w for w in seen["bare"] if WORDS.fullmatch(w))))
            bits = np.array([after.get(w, 0) for w in words], np.uint64).view(np.int64)
            return pd.DataFrame({"word": words, **{u: [seen[u][w] for w in words] for u in USES}, "followers": bits})

        for batch in batches:
            for t in batch["text"]:
                if isinstance(t, str):
                    count_uses(t, seen, after)
                    if len(seen["bare"]) > WORDS_HELD:
                        yield emit()
                        for c in (*seen.values(), after):
                            c.clear()
        if any(seen.values()):
            yield emit()

    schema = "word string, " + ", ".join(f"{u} bigint" for u in USES) + ", followers bigint"
    counts = documents.select(F.col(text).alias("text")).where("text IS NOT NULL").mapInPandas(count, schema)
    total = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in USES), F.bit_or("followers").alias("followers"))
    stops = F.col("inside") + F.col("digit") + F.col("final") + F.col("other")
    every = stops + F.col("bare")
    inside = F.col("inside") >= LEAST_EVIDENCE
    numbered = (F.col("digit") >= LEAST_EVIDENCE) & (2 * F.col("digit") >= stops)
    never_final = (stops >= LEAST_STOPS) & (F.col("final") < FINAL_SHARE * stops) & (F.bit_count("followers") >= LEAST_FOLLOWERS)
    listed = F.col("word").isin(sorted(LISTED))
    kind = F.when((stops >= STOP_SHARE * every) & (inside | numbered | never_final), "abbreviation").when(listed & (every >= LEAST_EVIDENCE) & (F.col("bare") >= STOP_SHARE * every), "ordinary")
    return total.select("word", kind.alias("kind")).where("kind IS NOT NULL")


def sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, start_pos, end_pos)``: the sentences of every document, in code points from 0, the end exclusive.

    Every character that is neither white space nor a byte-order mark belongs to one sentence; null, empty and blank texts
    have none. Whole texts are read, of any length. Repeated rows give repeated results. Two passes: the corpus counts,
    then the texts, each where it lies, without a shuffle of texts as long as there are at most ``LEARNED_BROADCAST``
    learned words; beyond that each document meets its own by a join.
    """
    scratch = Scratch(documents.sparkSession, "sentences")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    learned = scratch.write(learned_words(docs), "learned")
    schema = "doc_id bigint, start_pos bigint, end_pos bigint"

    def rows(ids, texts, known) -> pd.DataFrame:
        out_id, out_s, out_e = [], [], []
        for i, t, words in zip(ids, texts, known):
            if isinstance(t, str):
                for s, e in sentence_spans(t, words):
                    out_id.append(i)
                    out_s.append(s)
                    out_e.append(e)
        return pd.DataFrame({"doc_id": pd.array(out_id, "Int64"), "start_pos": out_s, "end_pos": out_e})

    if at_most(learned, LEARNED_BROADCAST):
        sent = documents.sparkSession.sparkContext.broadcast({r.word: r.kind for r in learned.collect()})

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = sent.value
            for batch in batches:
                yield rows(batch["doc_id"], batch["text"], [words] * len(batch))

        return docs.mapInPandas(split, schema)

    def own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, w) for i, t in zip(batch["doc_id"], batch["text"]) for w in {last_word(t, m.start()) for m in STOP.finditer(t)} if w]
            if found:
                yield pd.DataFrame(found, columns=["doc_id", "word"])

    keyed = docs.mapInPandas(own_words, "doc_id bigint, word string").join(learned, "word").groupBy("doc_id").agg(F.collect_set(F.struct("word", "kind")).alias("words"))

    def split_keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield rows(batch["doc_id"], batch["text"], [{} if w is None else {r["word"]: r["kind"] for r in w} for w in batch["words"]])

    return docs.join(keyed, "doc_id", "left").mapInPandas(split_keyed, schema)
