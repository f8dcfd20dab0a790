"""Text functions as Catalyst expressions; none of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the lexical index.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "in", "into", "is", "it",
    "of", "on", "or", "that", "the", "their", "this", "to", "using", "was", "were", "what", "when", "which", "with",
)

# Phrases that mark a refusal, and messages by reason and language.
REFUSAL_PHRASES = (
    "证据不足", "无法回答", "不能回答", "没有足够证据", "未找到", "无法确定", "没有任何证据", "可见证据中没有", "可检索证据中没有",
    "证据中没有", "当前证据中没有", "没有证据块",
    "insufficient evidence", "not enough evidence", "cannot answer", "can't answer", "unable to answer", "no evidence", "cannot determine",
    "could not find evidence", "no cited evidence",
)
REFUSAL_MESSAGES = {
    "no_retrieval": ("没有检索到可核验的论文证据，无法可靠回答。", "No verifiable paper evidence was retrieved, so I cannot answer reliably."),
    "evidence_insufficient": ("现有检索证据不足以回答这个问题。", "The retrieved evidence is insufficient to answer this question."),
    "unverified": ("现有证据不足以支持可靠回答，请查看检索片段或缩小问题范围。", "The evidence does not support a reliable answer. Please inspect the retrieved blocks or narrow the question."),
}

HAN = r"[㐀-鿿]"
_CITATION = r"\[([0-9\s,，;；\-–]+)\]"


def tokenize(text: Column) -> Column:
    """Lower-case ASCII words and numbers without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))


def tokenize_mixed(text: Column) -> Column:
    """ASCII words with underscores, and the character pairs of Han runs (a run of one stays single)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9_]+|{HAN}+"), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda t: F.when(t.rlike(HAN) & (F.char_length(t) > 1), pairs(t)).otherwise(F.array(t))))


def collapse(text: Column) -> Column:
    """White-space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def has_han(text: Column) -> Column:
    return text.rlike(HAN)


def language(question: Column) -> Column:
    return F.when(has_han(question), "Chinese").otherwise("English")


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other character, what they fold to, and those that fold to several: Unicode's rule, as Python has it."""
    pairs = {c: f for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if (f := c.casefold()) != c}
    single = {c: f for c, f in pairs.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in pairs.items() if len(f) > 1}


_FROM, _TO, _LONGER = _foldings()
_SHARP = _LONGER.pop("ß")


def casefold(text: Column) -> Column:
    """Full case folding: sharp s is ss, ligatures come apart, every sigma is one. Plain ASCII texts take the short way."""
    ascii_letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = F.replace(F.translate(text, ascii_letters + _FROM, ascii_letters.lower() + _TO), F.lit("ß"), F.lit(_SHARP))  # the only frequent one of the longer foldings
    several = F.create_map(*(F.lit(x) for pair in _LONGER.items() for x in pair))
    letters = F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0))
    apart = F.array_join(F.transform(letters, lambda c: F.coalesce(several[c], c)), "")
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), F.lower(text)).when(folded.rlike(f"[{''.join(_LONGER)}]"), apart).otherwise(folded)


def evidence_norm(text: Column) -> Column:
    """Words only: case is folded, anything that is no word character becomes one blank."""
    return F.trim(F.regexp_replace(casefold(text), r"(?U)\W+", " "))


def quote_norm(text: Column) -> Column:
    return collapse(casefold(text))


def contains_quote(text: Column, quote: Column) -> Column:
    """Verbatim but for case and white space; a blank quote is never contained."""
    needle = quote_norm(quote)
    return (F.char_length(needle) > 0) & F.contains(quote_norm(text), needle)


def quotes_cover_gold(gold: Column, quotes: Column, texts: Column) -> Column:
    """Whether every gold id has a quote that stands in its text. gold: array<string>; quotes: array<struct<paper_id, quote>>; texts: map of id to text."""
    held = lambda g: F.exists(quotes, lambda q: (q["paper_id"] == g) & contains_quote(F.try_element_at(texts, g), q["quote"]))
    return (F.size(gold) > 0) & F.forall(gold, lambda g: F.coalesce(held(g), F.lit(False)))


def short_id(*parts: Column, length: int = 20) -> Column:
    """Leading hex digits of the SHA-256 of parts joined by NUL."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\0"), p.cast("string"))
    return F.substring(F.sha2(joined, 256), 1, length)


def record_url(corpus_id: Column, paper_id: Column, base: str = "https://api.semanticscholar.org/graph/v1/paper/CorpusId%3A", fields: str = "?fields=title,url") -> Column:
    """Lookup address of an all-digit id; the corpus id wins over the paper id."""
    i = F.coalesce(F.nullif(F.trim(corpus_id.cast("string")), F.lit("")), F.trim(paper_id.cast("string")), F.lit(""))
    return F.when(i.rlike(r"^\d+$"), F.concat(F.lit(base), i, F.lit(fields))).otherwise("")


def redact_url(url: Column) -> Column:
    """Scheme, host and port only; what cannot be parsed becomes a marker."""
    kept = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(:\d+)?(?:[/?#]|$)", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?((?:\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(?::\d+)?)(?:[/?#]|$)", 1)
    return F.when(url.isNull() | (url == ""), "").when(host == "", "<unparsable>").otherwise(F.concat(kept, F.lower(host)))


def citation_numbers(text: Column) -> Column:
    """Distinct numbers of bracketed citation lists in order; ranges up to 100 wide are expanded, lone years are none."""
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_CITATION), F.lit(1)), lambda g: F.split(F.trim(g), r"\s*[,，;；]\s*")))

    def expand(p: Column) -> Column:
        low = F.regexp_extract(p, r"^(\d+)", 1).try_cast("long")
        high = F.regexp_extract(p, r"[-–]\s*(\d+)$", 1).try_cast("long")
        none = F.array().cast("array<bigint>")
        span = F.when((low <= high) & (high - low <= 100), F.sequence(low, F.greatest(low, F.least(high, low + 100)))).otherwise(F.array(low, high))
        year = (F.char_length(p) == 4) & low.between(1900, 2100)
        return F.when(p.rlike(r"^\d+\s*[-–]\s*\d+$"), span).when(p.rlike(r"^\d+$") & ~year, F.array(low)).otherwise(none)

    return F.array_distinct(F.filter(F.flatten(F.transform(F.transform(parts, lambda p: F.trim(p)), expand)), lambda x: x.isNotNull()))


def simple_citations(text: Column) -> Column:
    """Numbers of [1, 2; 3] lists without ranges, distinct, in order."""
    lists = F.regexp_extract_all(text, F.lit(r"\[(\s*\d+(?:\s*[,;，；]\s*\d+)*\s*)\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(lists, lambda g: F.split(F.trim(g), r"\s*[,;，；]\s*"))), lambda x: x.cast("long")))


def strip_citations(text: Column) -> Column:
    """Without bracketed citations; a lone year in brackets stays."""
    return F.regexp_replace(text, r"\[(?!\s*(?:19|20)\d{2}\s*\])[0-9\s,，;；\-–]+\]", "")


def split_claims(text: Column, unbroken: tuple[str, ...] = ("al",)) -> Column:
    """Sentences and lines; the dot after a word of `unbroken` ends none."""
    pieces = F.split(F.trim(text), "".join(rf"(?<!\b{re.escape(w)}\.)" for w in unbroken) + r"(?<=[.!?。！？])\s+|\n+")
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def is_caveat(claim: Column) -> Column:
    """An epistemic caveat: says what the evidence does not show."""
    # Openings of caveats.
    openings = (
        "however, the blocks do not establish", "the evidence does not establish", "the provided blocks do not establish", "the blocks do not establish",
        "therefore, the evidence cannot", "the evidence is insufficient", "现有证据不足", "证据不足", "无法根据现有证据", "无法从这些证据",
    )
    lead = F.regexp_replace(F.lower(claim), r"^[ ,;:，；：]+", "")
    opened = F.lit(False)
    for x in openings:
        opened |= lead.startswith(x)
    priority = lead.rlike(r"\b(?:first|earliest|priority|only)\b")
    return opened | (lead.rlike(r"^(?:however,\s*)?the evidence does not (?:establish|identify|prove|show|confirm)\b") & priority)


def is_refusal(text: Column) -> Column:
    """A refusal phrase stands in the first 180 characters."""
    lead = F.substring(collapse(F.lower(text)), 1, 180)
    quoted = "|".join(p.replace("'", "\\'") for p in REFUSAL_PHRASES)
    return lead.rlike(quoted) | lead.rlike(r"^(?:现有|当前|所提供的)?证据.{0,20}(?:不够|不足|无法)")


def refusal_message(question: Column, reason: str) -> Column:
    if reason not in REFUSAL_MESSAGES:
        raise ValueError(f"unknown reason: {reason}")
    zh, en = REFUSAL_MESSAGES[reason]
    return F.when(has_han(question), zh).otherwise(en)


def sanitize_queries(queries: Column, limit: int, longest: int = 240) -> Column:
    """Model-made queries: collapsed, not blank, not too long, Latin without Han; the first of each spelling, at most `limit`."""
    good = F.filter(F.transform(queries, collapse), lambda q: (q != "") & (F.char_length(q) <= longest) & q.rlike("[A-Za-z]") & ~q.rlike(HAN))
    first = F.filter(good, lambda q, i: F.array_position(F.transform(good, F.lower), F.lower(q)) == i + 1)
    return F.slice(first, 1, limit)


def json_object(text: Column, schema: str) -> Column:
    """The outermost {...} of a model's answer, fences or not, parsed; null if it can't be."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


# Section names that are headings by themselves, and month names that open none.
KNOWN_SECTIONS = (
    "abstract", "introduction", "related work", "background", "preliminaries", "method", "methods", "methodology", "approach", "experiments",
    "experiment", "results", "discussion", "conclusion", "conclusions", "limitations", "acknowledgments", "acknowledgements", "references", "appendix",
)
MONTHS = (
    "jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august", "sep", "sept",
    "september", "oct", "october", "nov", "november", "dec", "december",
)

# Fixed patterns: heading lines, equation and table lines, ends of sentences.
_ATX = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
_NUMBERED = r"^(\d+(?:\.\d+){0,5})[.)]?\s+(.{2,100})$"
_LOOSE = r"^(?:\d+(?:\.\d+)*\.?\s+)?(?:[A-Z][A-Za-z0-9 ,:;()'’/&-]{2,120}|[A-Z][A-Z0-9 ,:;()'’/&-]{2,120})$"
_EQUATION = r"^\s*(?:\(?\d{1,3}\)?\s*)?(?:\$\$.*\$\$|\\\[.*\\\]|\\begin\{(?:equation|align|gather|math).+|[A-Za-z]\s*=\s*[^=].{0,100})\s*$"
_TABLE = r"\||\t|\s{2,}\S+\s{2,}\S+"
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


def heading(bare: Column) -> Column:
    """struct(level, title, numbered) of a heading line with collapsed white space; null for other lines."""
    kind = lambda level, title, numbered: F.struct(level.cast("int").alias("level"), title.alias("title"), F.lit(numbered).alias("numbered"))
    marks = F.regexp_extract(bare, _ATX, 1)
    number, title = F.regexp_extract(bare, _NUMBERED, 1), F.regexp_extract(bare, _NUMBERED, 2)
    opening = F.lower(F.regexp_replace(F.substring_index(title, " ", 1), r"[.:]+$", ""))
    like_prose = F.contains(F.lower(title), F.lit("arxiv:")) | title.rlike("[{};=@<>]") | opening.isin(*MONTHS) | (F.size(F.split(title, " ")) > 16)
    counted = (number != "") & title.rlike(r"^\p{Lu}") & (F.substring_index(number, ".", 1).try_cast("int") <= 30) & ~like_prose
    known = F.lower(F.regexp_replace(bare, ":+$", "")).isin(*KNOWN_SECTIONS)
    found = (
        F.when(marks != "", kind(F.char_length(marks), F.trim(F.regexp_extract(bare, _ATX, 2)), False))
        .when(counted, kind(F.size(F.split(number, r"\.")), bare, True))
        .when(known, kind(F.lit(1), bare, False))
    )
    return F.when(F.char_length(bare).between(1, 140), found)


def is_loose_heading(bare: Column) -> Column:
    """A capitalised line of 2 to 120 characters that ends like no sentence."""
    return F.char_length(bare).between(2, 120) & ~bare.rlike(r"[.,;]$") & bare.rlike(_LOOSE)


def is_equation(line: Column) -> Column:
    return line.rlike(_EQUATION)


def is_tabular(line: Column) -> Column:
    return line.rlike(_TABLE)


def block_kind(text: Column) -> Column:
    """equation, table or body, by the shape of a block's lines."""
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    tabular = F.size(F.filter(filled, is_tabular))
    math = F.exists(filled, is_equation) | (F.size(F.split(text, r"\$\$")) >= 3)
    return F.when(math, "equation").when((F.size(filled) >= 2) & (tabular >= 0.6 * F.size(filled)), "table").otherwise("body")


def outcome(status: Column, refused: Column) -> Column:
    """failed, refused, successful or unlabeled."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(s.isin("failed", "error", "exception"), "failed")
        .when(s.startswith("refus") | F.coalesce(refused, F.lit(False)), "refused")
        .when(s.isin("verified", "success", "succeeded", "complete", "completed"), "successful")
        .otherwise("unlabeled")
    )


def best_window(text: Column, terms: Column, size: int = 5200, stride: int = 2600, head: int = 700, longest: int = 6000) -> Column:
    """The text, or of a long one its head and the earliest window with most distinct terms (terms with digits count twice)."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(stride))
    weight = lambda w: F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(F.contains(F.lower(w), F.lower(t)), F.when(t.rlike("[0-9]"), 2).otherwise(1)).otherwise(0))
    best = F.array_max(F.transform(starts, lambda s: F.struct(weight(F.substring(text, s + 1, F.lit(size))).alias("n"), (-s).alias("s"))))
    return F.when(F.char_length(text) <= longest, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n"), F.substring(text, 1 - best["s"], F.lit(size))))
