"""Column functions over text: clean-up, sentences, summaries and key sentences.

All of them stay in the JVM. White space means what it means for Unicode text, so
the classes below are spelled out instead of relying on an engine's `\\s`.
"""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SPACE_NOT_NEWLINE = r"[ \t\x0b\f\r\x1c-\x1f\x85\p{Z}]"
SPACE_CHARS = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
SENTENCE_END = rf"(?<=[.!?]){SPACE}+"
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+(?=[A-Z\"'])|\n{{2,}}"
WORD = r"[\p{L}\p{N}_]+"
INDEX_TOKEN = r"[\p{L}\p{N}\p{Co}]+"

# Characters replaced one for one, characters deleted, ligatures.
REPLACED = {
    "\u00a0": " ", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-",
}
DELETED = "\u00ad\u200b\u200c"
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "ﬅ": "st", "ﬆ": "st",
}

# Text that compatibility normalisation can change: anything past Latin Extended-B,
# plus the compatibility characters before it.
NEEDS_NFKC = (
    r"[ ¨ª¯²-µ¸-º¼-¾ĲĳĿŀ"
    r"ŉſǄ-ǌǱ-ǳ]|[^\u0000-ɏ]"
)


def _diacritic_map() -> tuple[str, str]:
    """Accented letters and their base letters by Unicode decomposition; combining
    marks come last so that `translate` deletes them."""
    src, dst = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and unicodedata.combining(base[1]):
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src) + "".join(chr(c) for c in range(0x300, 0x370)), "".join(dst)


FOLD_FROM, FOLD_TO = _diacritic_map()


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def collapse(c) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return strip(F.regexp_replace(col(c), SPACE + "+", " "))


def head(c, chars: int | None) -> Column:
    return col(c) if chars is None else F.substring(col(c), 1, chars)


def is_blank(c) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def ellipsis(c, limit: int, keep: int | None = None, mark: str = "…") -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep or limit), F.lit(mark))).otherwise(c)


def words(c) -> Column:
    """Unicode word tokens of lower-cased text."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def fold(c) -> Column:
    """Lower case without diacritics; text without multi-byte characters skips the mapping."""
    low = F.lower(col(c))
    return F.when(F.length(col(c)) == F.octet_length(col(c)), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))


def index_tokens(c) -> Column:
    """Tokens of the text index: letter and digit runs, folded."""
    return F.regexp_extract_all(fold(c), F.lit(INDEX_TOKEN), F.lit(0))


def count_index_tokens(c) -> Column:
    """size(index_tokens(c)) without building them; combining marks stay inside a token."""
    return F.regexp_count(col(c), F.lit(rf"{INDEX_TOKEN[:-1]}[\p{{L}}\p{{N}}\p{{Co}}\x{{300}}-\x{{36f}}]*"))


def normalize_text(c, nfkc=None) -> Column:
    """Typographic clean-up, optional NFKC hook, line-wrap hyphens, horizontal space.

    Only rows holding a character that NFKC can change are handed to the hook; the
    others send a null to Python and never leave the JVM.
    """
    c = col(c)
    src = "".join(REPLACED) + DELETED
    text = F.translate(c, src, "".join(REPLACED.values()))
    lig = text
    for k, v in LIGATURES.items():
        lig = F.replace(lig, F.lit(k), F.lit(v))
    text = F.when(text.rlike(r"[ﬀ-ﬆ]"), lig).otherwise(text)
    if nfkc is not None:
        text = F.coalesce(nfkc(F.when(text.rlike(NEEDS_NFKC), text)), text)
    text = F.regexp_replace(text, r"-\n([a-z])", "$1")
    return strip(F.regexp_replace(text, SPACE_NOT_NEWLINE + "+", " "))


def strip_tags(c) -> Column:
    return F.regexp_replace(col(c), "<[^>]+>", " ")


def _kept(parts: Column, longer_than: int = 0) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > longer_than)


def split_sentences(c) -> Column:
    """Sentences and paragraphs as the chunker sees them."""
    return _kept(F.split(col(c), SENTENCE_BREAK))


def plain_sentences(c, longer_than: int) -> Column:
    """Pieces after `.`, `!` or `?` and white space, stripped, longer than a bound."""
    return _kept(F.split(col(c), SENTENCE_END), longer_than)


def overview_sentence(c, head_chars: int | None = None) -> Column:
    found = F.regexp_extract(head(strip_tags(c), head_chars), K.OVERVIEW_PATTERN, 1)
    first = F.element_at(F.split(collapse(found), rf"(?<=[.!?]){SPACE}+(?=[A-Z])"), 1)
    return F.when((F.length(first) > 20) & (F.length(first) < 200), F.rtrim(first, F.lit(".")))


def _lead_of(snippet: Column, sents: Column) -> Column:
    """The first three of `sents` longer than 15, else the head of the snippet."""
    return let(F.array_join(F.slice(F.filter(sents, lambda s: F.length(s) > 15), 1, 3), " "),
               lambda lead: F.when(lead != "", lead).otherwise(ellipsis(snippet, 300, mark="...")))


def fallback_summary(c) -> Column:
    return let(collapse(c), lambda snippet: _lead_of(snippet, plain_sentences(snippet, 15)))


def lead_and_findings(c, n: int = 3) -> Column:
    """struct<summary, key_findings> as fallback_summary and key_findings give them; the text is cut once for both."""
    return let(collapse(c), lambda snippet: let(plain_sentences(snippet, 15), lambda sents: F.struct(
        _lead_of(snippet, sents).alias("summary"), _findings_of(sents, n).alias("key_findings"))))


def short_summary(c, head_chars: int | None = None) -> Column:
    sents = plain_sentences(head(c, head_chars), 20)
    return let(F.array_join(F.slice(sents, 1, 2), " "), lambda lead: ellipsis(lead, 280, 277))


def lead_summary(c, max_words: int = 20) -> Column:
    """Leading whole sentences within a word budget; the first one over it ends the lead."""
    c = col(c)
    sents = F.filter(
        F.transform(F.split(strip(c), "[.!?]+"), strip),
        lambda s: (F.length(s) >= 5) & ~F.lower(s).rlike("^(abstract|summary|contents):"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(False).alias("over"))

    def lead(ss):
        fits = F.aggregate(ss, start, lambda a, s: _lead_step(a, F.size(F.split(s, SPACE + "+")), max_words))
        return F.array_join(F.slice(ss, 1, fits["n"]), ". ")

    return let(let(sents, lead), lambda x: F.when(x != "", F.concat(x, F.lit("."))).otherwise(F.substring(c, 1, 100)))


def _lead_step(a: Column, n_words: Column, budget: int) -> Column:
    over = a["over"] | (a["used"] + n_words > budget)
    return F.struct(
        F.when(over, a["n"]).otherwise(a["n"] + 1).alias("n"),
        F.when(over, a["used"]).otherwise(a["used"] + n_words).alias("used"),
        over.alias("over"),
    )


def model_summary_input(c, max_words: int | None = None) -> Column:
    if max_words is None:
        return collapse(c)
    return F.array_join(F.slice(F.split(collapse(c), " "), 1, max_words), " ")


def model_summary_output(c) -> Column:
    first = F.element_at(F.split(strip(c), rf"(?<=[.!?]){SPACE}"), 1)
    return F.when(first != "", F.substring(first, 1, 180))


def key_insights(c, n: int = 5, head_chars: int | None = None) -> Column:
    """The n sentences with most signal words, ties in text order; without any signal
    the first n sentences."""
    flag = "(?iU)"

    def score(s):
        return (F.regexp_count(s, F.lit(flag + K.SCIENTIFIC_SIGNAL)) * 2
                + F.regexp_count(s, F.lit(flag + K.POLICY_SIGNAL)))

    def pick(sents):
        scored = F.filter(
            F.transform(sents, lambda s, i: F.struct((-score(s)).alias("rank"), i.alias("pos"), s.alias("s"))),
            lambda x: x["rank"] < 0)
        best = F.transform(F.slice(F.sort_array(scored), 1, n), lambda x: x["s"])
        return let(best, lambda b: F.when(F.size(b) > 0, b).otherwise(F.slice(sents, 1, n)))

    sents = plain_sentences(collapse(head(F.coalesce(col(c), F.lit("")), head_chars)), 40)
    return F.transform(let(sents, pick), lambda s: ellipsis(s, 300))


def key_findings(c, n: int = 3, head_chars: int | None = None) -> Column:
    return _findings_of(plain_sentences(collapse(head(c, head_chars)), 30), n)


def _findings_of(sents: Column, n: int) -> Column:
    """Key sentences among those longer than 30; behind the first n nothing is matched."""
    none = F.array().cast("array<string>")

    def first(ss, wanted):
        return F.aggregate(ss, none, lambda acc, s: F.when((F.size(acc) < n) & wanted(s), F.concat(acc, F.array(s))).otherwise(acc))

    def pick(ss):
        return let(first(ss, lambda s: (F.length(s) > 30) & s.rlike(f"(?=[{K.FINDING_STARTS}])(?iU)" + K.FINDING_SIGNAL)), lambda high: F.when(
            F.size(high) > 0, high).otherwise(first(ss, lambda s: F.length(s) > 40)))

    return F.transform(let(sents, pick), lambda s: ellipsis(s, 120))


def text_lines(c) -> Column:
    return F.filter(F.transform(F.split(col(c), "\n"), strip), lambda s: s != "")


def is_tabular(lines) -> Column:
    """Many short lines, few sentence ends, many short leading codes; takes `text_lines`."""
    lines = col(lines)
    n = F.size(lines)
    chars = F.aggregate(lines, F.lit(0), lambda a, s: a + F.length(s))
    ends = F.size(F.filter(lines, lambda s: s.rlike(r"[.!?]\z")))
    codes = F.size(F.filter(lines, lambda s: s.rlike(r"(?U)^[A-Z0-9]{1,8}\b")))
    return (n >= 6) & (chars / n < 100) & (ends / n < 0.15) & (codes / n >= 0.30)


def title_case(c) -> Column:
    """Capital after every non-letter, lower case elsewhere; a leading ß becomes Ss."""
    runs = F.regexp_extract_all(col(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))

    def first(r):
        return F.when(F.substring(r, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(r, 1, 1)))

    return F.array_join(F.transform(runs, lambda r: F.concat(first(r), F.lower(F.substring(r, 2, 1 << 30)))), "")


def file_extension(c) -> Column:
    """Lower-cased extension with its dot, empty when there is none."""
    return F.regexp_extract(F.lower(col(c)), r"[^./\\](\.[^./\\]*)$", 1)


def file_kind(c) -> Column:
    ext = file_extension(c)
    return F.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").otherwise("other")


def mentions_syllabus(filename, text, head_chars: int | None = None) -> Column:
    seen = F.lower(F.concat(col(filename), F.lit(" "), head(F.coalesce(col(text), F.lit("")), head_chars)))
    return seen.contains("syllabus") | seen.contains("course overview") | seen.contains("course description")


def escape_html(c) -> Column:
    c = col(c)
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def highlight(text, query) -> Column:
    """Escaped text with every query word marked, one word after another."""
    terms = F.filter(
        F.transform(F.split(F.coalesce(col(query), F.lit("")), SPACE + "+"),
                    lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", "")),
        lambda w: F.length(w) > 1,
    )
    return F.aggregate(
        terms,
        escape_html(text),
        lambda acc, w: F.regexp_replace(acc, F.concat(F.lit("(?i)("), w, F.lit(")")), F.lit("<mark>$1</mark>")),
    )


def empty_entities() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(none.alias("Companies"), none.alias("Dates"), none.alias("Project_Names"))


def parse_suggestion(c) -> Column:
    """Model reply to struct(dimension_id, category_name); null unless both are given."""
    body = strip(F.regexp_replace(F.regexp_replace(strip(c), "^```(json)?", ""), "```$", ""))
    parsed = F.from_json(body, "dimension_id string, category_name string")
    dim = F.replace(F.lower(strip(parsed["dimension_id"])), F.lit(" "), F.lit("_"))
    cat = strip(parsed["category_name"])
    return F.when((dim != "") & (cat != ""), F.struct(dim.alias("dimension_id"), cat.alias("category_name")))
