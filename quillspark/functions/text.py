"""Text functions, Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

SPACE = r"[\s\u00a0\ufeff]"


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def tokenize(c: Column) -> Column:
    """Lower-case runs of ASCII word characters, $ and % of more than two characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s$%]", " "), r"\s+"), lambda t: F.length(t) > 2)


def tokenize_financial(c: Column) -> Column:
    """Tokens, each followed by what it forms with the next (amount with million or billion) or alone (year)."""
    tokens = tokenize(c)

    def forms(t: Column, i: Column) -> Column:
        nxt = F.coalesce(F.try_element_at(tokens, i + 2), F.lit(""))
        amount = F.when(t.startswith("$") & nxt.isin("million", "billion"), F.concat(t, nxt))
        year = F.when(t.rlike("^[0-9]{4}$"), F.concat(F.lit("year"), t))
        return F.array_compact(F.array(t, amount, year))

    return F.flatten(F.transform(tokens, forms))


def strip_html(c: Column) -> Column:
    """Without tags, with five entities decoded one after the other, trimmed."""
    out = F.regexp_replace(c, "<[^>]+>", "")
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return trim(out)


def is_placeholder(c: Column) -> Column:
    return F.coalesce(c.rlike(vocab.PLACEHOLDER), F.lit(False))


def fields(c: Column, patterns: dict[str, str]) -> list[Column]:
    """The first group of each pattern's first match, trimmed; null without a match."""
    return [F.when(c.rlike(p), trim(F.regexp_extract(c, p, 1))).alias(name) for name, p in patterns.items()]


def citations(c: Column) -> Column:
    """(section, page, quote) of "(Section, p. N)", with the quote of the same place in order, else empty."""
    # digits are written [0-9], since the same pattern runs in SQL, where \d may match those of other scripts
    pattern = F.lit(r"\(([^,]+),\s*p\.?\s*([0-9]+)\)")
    sections, pages = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    quotes = F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))
    return F.transform(sections, lambda s, i: F.struct(trim(s).alias("section"), F.try_element_at(pages, i + 1).cast("int").alias("page"), F.coalesce(F.try_element_at(quotes, i + 1), F.lit("")).alias("quote")))


def clean_value(c: Column) -> Column:
    """A figure out of a table cell: no currency or thousands, (123) as -123, the likeliest of several numbers."""
    out = F.regexp_replace(F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit(","), F.lit("")), rf"{SPACE}+", " ")
    # white space is one blank by now, and digits are ASCII
    out = trim(F.regexp_replace(F.regexp_replace(out, r"\( *([0-9]+) *\)", "-$1"), r"[^0-9\-. %]", ""))
    parts = F.filter(F.split(out, " "), lambda p: p != "")
    best = F.coalesce(F.try_element_at(F.filter(parts, lambda p: p.contains(".") & (F.length(p) > 3)), F.lit(1)), F.try_element_at(parts, F.lit(-1)))
    return F.when(out.contains(" ") & ~out.contains("%") & (F.size(parts) > 1), best).otherwise(out)


def route(q: Column, routes: list[tuple[str, list[str]]] = vocab.ROUTES, default: str = "base") -> Column:
    """The first route one of whose words the query holds."""
    out = F.lit(default)
    for name, words in reversed(routes):
        out = F.when(has_any(F.lower(q), words), F.lit(name)).otherwise(out)
    return out


def hypothetical(q: Column) -> Column:
    """The template answer of a query."""
    *cases, (_, out) = vocab.HYPOTHETICAL
    out = F.lit(out)
    for words, text in reversed(cases):
        out = F.when(has_any(F.lower(q), words), F.lit(text)).otherwise(out)
    return out


def _lists(cases: list[tuple[Column, list[str]]]) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(none, *(F.when(c, F.array(*map(F.lit, words))).otherwise(none) for c, words in cases))))


def synonyms(q: Column, known: dict[str, list[str]] = vocab.SYNONYMS) -> Column:
    """Synonyms of the words that the lower-cased query holds, in the order of the dictionary."""
    low = F.lower(q)
    return _lists([x for term, words in known.items() for x in ((low.contains(term), words), (has_any(low, words), [term, *words]))])


def patterns(q: Column, known: dict[str, list[str]] = vocab.DOCUMENT_PATTERNS, words: dict[str, list[str]] = vocab.SYNONYMS) -> Column:
    """Phrases of documents for the categories that the lower-cased query names."""
    low = F.lower(q)
    return _lists([*((has_any(low, [k, *words.get(k, [])]), v) for k, v in known.items()), *((has_any(low, k), v) for k, v in vocab.INTENT_PATTERNS)])


def expanded_queries(q: Column, company: str = "Company") -> Column:
    """The query, variants by its first three synonyms, with its first phrase, and as statements."""
    low, found, phrases = F.lower(q), synonyms(q), patterns(q)
    replaced = F.array_compact(F.transform(F.slice(found, 1, 3), lambda s: F.nullif(F.regexp_replace(low, F.lit("|".join(vocab.REPLACED_WORDS)), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))), low)))
    phrase = F.when(F.size(phrases) > 0, F.array(F.concat(q, F.lit(" "), phrases[0]))).otherwise(F.array().cast("array<string>"))
    said = q
    for w in vocab.QUESTION_WORDS:  # the first of each only
        at = F.locate(w, said)
        said = F.when(at > 0, F.concat(F.substring(said, F.lit(1), at - 1), F.substring(said, at + len(w), F.length(said)))).otherwise(said)
    said = trim(said)
    question = F.when(q.contains("?"), F.array(said, F.concat(F.lit(company + " "), said))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(q), replaced, phrase, question))


def context_query(q: Column, as_of_year: int) -> Column:
    """The query behind one of three prefixes, chosen by its length, with two years unless it has one."""
    prefix = F.array(*map(F.lit, vocab.CONTEXT_PREFIXES))[F.length(q) % 3]
    years = F.when(q.rlike("[0-9]{4}"), "").otherwise(f" for {as_of_year - 1} or {as_of_year}")
    return F.concat(prefix, F.lit(" "), q, years)
