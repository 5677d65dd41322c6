"""Text functions on columns: anchors, titles, wiki markup."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words of anchors, for all languages and by wiki.
STOP_WORDS = set(
    [
        "a", "an", "in", "the", "of", "it", "from", "with", "this", "that", "they", "he", "she", "some", "where", "what", "since", "his", "her",
        "their", "le", "la", "les", "il", "elle", "ce", "ça", "ci", "ceux", "ceci", "cela", "celle", "se", "cet", "cette", "dans", "avec", "con",
        "sans", "pendant", "durant", "avant", "après", "puis", "el", "lo", "la", "ese", "esto", "que", "qui", "quoi", "dont", "ou", "où", "si",
        "este", "esta", "cual", "eso", "ella", "depuis", "y", "a", "à", "su", "de", "des", "du", "los", "las", "un", "une", "una", "uno", "para",
        "asi", "later", "into", "dentro", "dedans", "depuis", "después", "desde", "al", "et", "por", "at", "for", "when", "why", "how", "with",
        "whether", "if", "thus", "then", "and", "but", "on", "during", "while", "as", "within", "was", "is", "est", "au", "fait", "font", "va",
        "vont", "sur", "en", "pour", "del", "cuando", "cuan", "do", "does", "until", "sinon", "encore", "to", "by", "be", "which", "have", "not",
        "were", "has", "also", "its", "isbn", "pp.", "&amp;", "p.", "ces", "o",
    ]
)
# "later" and "thus" are fused in the English list and so are no stop words there.
WIKI_STOP_WORDS = {
    "enwiki": set(
        [
            "a", "an", "in", "the", "of", "it", "from", "with", "this", "that", "they", "he", "she", "some", "where", "what", "since", "his", "her",
            "their", "laterthus", "then", "and", "but", "on", "during", "while", "as", "within", "was", "is", "do", "does", "until", "to", "by", "be",
            "which", "have", "not", "were", "has", "also", "its", "pp.", "&amp;", "p.",
        ]
    ),
    "frwiki": set(
        [
            "elle", "ce", "ça", "ci", "ceux", "ceci", "cela", "celle", "se", "cet", "cette", "est", "au", "fait", "font", "va", "vont", "sur", "en",
            "pour", "del", "cuando", "dans", "avec", "con", "sans", "pendant", "durant", "avant", "après", "puis", "el", "lo", "la", "depuis", "à", "de",
            "du", "un", "une", "dont", "que", "qui", "quoi", "ou", "où", "sinon", "encore", "ces", "pp.", "&amp;", "p.",
        ]
    ),
    "eswiki": set(["ese", "esto", "si", "este", "esta", "cual", "eso", "ella", "y", "a", "su", "de", "des", "los", "las", "un", "une", "una", "cuan", "o", "pp.", "&amp;", "p."]),
}
# Title prefixes that are no articles.
BAD_TITLES = ("Wikipedia:", "Wikipédia:", "File:", "Media:", "Help:", "User:")
# Category prefixes and redirect words.
CATEGORY_PREFIXES = ("Category:", "Catégorie:", "Categorie:", "Categoría:", "Categoria:", "Kategorie:", "Kategoria:", "Категория:", "Kategori:")
REDIRECT_WORDS = ("#REDIRECT", "#weiterleitung", "#REDIRECCIÓN", "REDIRECIONAMENTO")
# Letters replaced by plain ones.
PLAIN_LETTERS = {
    "à": "a", "é": "e", "ê": "e", "ë": "e", "û": "u", "ü": "u", "Ä": "A", "À": "A", "Â": "A", "Ã": "A", "Å": "A", "É": "E", "È": "E",
    "Ê": "E", "Ô": "O", "ô": "o", "\xa0": " ", "ð": "o", "ó": "o", "á": "a", "í": "i", "i̇": "i", "£": "L", "¥": "Y", "€": "E", "–": "-",
}
PLAIN_FROM = "".join(k for k in PLAIN_LETTERS if len(k) == 1)
PLAIN_TO = "".join(v for k, v in PLAIN_LETTERS.items() if len(k) == 1)
# Languages whose wikis have a prefix.
LANGUAGES = (
    "en zh fr ja ru pt ca fa ar fi hu id es it war ceb nl de sv ro cs ko sr ms tr min eo eu kk da bg sk hy he lt sl et uz gl nn"
    " la vo simple el ce be ka hi az th ur oc mk ta mg new tt cy tl bs br ne gu io bpy nds ku als pa su kn bar ckb ia arz"
).split()
SPACE = r"[ \t\n\x0B\f\r]"


def clean_anchor(source: Column, lowercase: bool = True, wiki: str | None = None, longest: int = 256) -> Column:
    """Trailing space and brackets at the ends go; a bad first or last sign empties it; l', d', j', t'
    and 's go; stop words at both ends go; spaces become one; cut to ``longest``."""
    s = F.regexp_replace(source, rf"{SPACE}+$", "")
    s = F.regexp_replace(s, r"^[()\[\]]+|[()\[\]]+$", "")
    s = F.when(s.rlike(r"(?s)^[',\-!.?:’]|[',\-!?:’]\z"), F.lit("")).otherwise(s)
    s = F.regexp_replace(s, r"^[lLdDjJtT]'", "")
    s = F.regexp_replace(s, r"'s\z", "")
    words = F.filter(F.split(s, rf"{SPACE}+"), lambda w: w != "")
    stops = F.array(*map(F.lit, sorted(STOP_WORDS if wiki is None else WIKI_STOP_WORDS[wiki])))
    goes = lambda w: F.array_contains(stops, F.lower(w))
    places = F.filter(F.transform(words, lambda w, i: F.when(goes(w), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    inner = F.when(F.size(places) == 0, F.array().cast("array<string>")).otherwise(F.slice(words, F.array_min(places) + 1, F.array_max(places) - F.array_min(places) + 1))
    out = F.substring(F.array_join(inner, " "), 1, longest)
    return F.lower(out) if lowercase else out


# Endings of ordinals, and signs inside numbers.
ORDINAL_ENDINGS = ["st", "th", "nd", "rd", "er", "eme", "ème", "ère"]
NUMBER_SIGNS = ["/", "-", ",", ".", ":", ";", "%"]


def is_ordinal(anchor: Column) -> Column:
    return anchor.rlike(rf"(?U)^\d+({'|'.join(ORDINAL_ENDINGS)})$")


def is_number_punctuation(anchor: Column) -> Column:
    return anchor.rlike(rf"(?U)^\d+([{''.join(map(re.escape, NUMBER_SIGNS))}]\d*)+$")


def acceptable(anchor: Column) -> Column:
    """Not empty, not digits, an ordinal or digits with signs (being a known anchor is a semi-join)."""
    return (F.length(anchor) > 0) & ~anchor.rlike(r"(?U)^\d+$") & ~is_ordinal(anchor) & ~is_number_punctuation(anchor)


def bad_title(title: Column) -> Column:
    out = F.lit(False)
    for p in BAD_TITLES:
        out = out | title.startswith(p)
    return out


def upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def clean_title(s: Column) -> Column:
    """First letter upper, cut at the first ``#``, underscores to spaces."""
    return F.translate(F.substring_index(upper_first(s), "#", 1), "_", " ")


def _strip(s: Column) -> Column:
    return F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))


def _before_last_bar(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\|[^|]*\z", "")


def _target(m: Column) -> Column:
    """A link's target: as it is, or of a piped link the part before the last bar, cut at ``#``."""
    return F.when(F.contains(m, F.lit("|")), F.substring_index(_strip(_before_last_bar(m)), "#", 1)).otherwise(m)


def _links(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _strip)


def categories(text: Column) -> Column:
    """Array of category links."""
    found = _links(text, r"\[\[((?:" + "|".join(CATEGORY_PREFIXES) + r")[^\]\[]*)\]\]")
    return F.filter(F.transform(found, _target), lambda x: x != "")


def redirects(text: Column) -> Column:
    """Array of redirect targets; those that hold an ``<iframe`` are left out."""
    found = _links(text, r"(?iu)(?:" + "|".join(map(re.escape, REDIRECT_WORDS)) + r")\s*\[\[([^\]\[]*)\]\]")
    return F.filter(F.transform(F.filter(found, lambda m: ~F.contains(m, F.lit("<iframe"))), _target), lambda x: x != "")


def anchors(text: Column) -> Column:
    """Array of (link, anchor) of links without a colon; an unpiped link is its own anchor."""
    one = lambda m: F.struct(_target(m).alias("link"), _strip(F.substring_index(m, "|", -1)).alias("anchor"))
    return F.filter(F.transform(_links(text, r"\[\[([^\]\[:]*)\]\]"), one), lambda x: (x["link"] != "") & (x["anchor"] != ""))


def article_anchors(articles: DataFrame) -> DataFrame:
    """(context, anchor, target): each article ``(title, text)`` without ``:`` in its title links to itself, then its links."""
    own = articles.where(~F.contains("title", F.lit(":")))
    links = own.select(F.col("title").alias("context"), F.inline(anchors(F.col("text")))).select("context", "anchor", F.col("link").alias("target"))
    return own.select(F.col("title").alias("context"), F.col("title").alias("anchor"), F.col("title").alias("target")).union(links)


def spans(text: Column) -> Column:
    """A text's stretches in order, array of (text, link): plain ones have no link."""
    pattern = r"\[\[([^\]\[:]*)\]\]"
    gaps = F.transform(F.split(text, pattern), lambda g: F.struct(g.alias("text"), F.lit(None).cast("string").alias("link")))
    links = F.transform(_links(text, pattern), lambda m: F.struct(_strip(F.substring_index(m, "|", -1)).alias("text"), _target(m).alias("link")))
    mixed = F.flatten(F.zip_with(gaps, links, lambda g, m: F.filter(F.array(g, m), lambda x: x.isNotNull())))
    return F.filter(mixed, lambda x: (x["text"] != "") | x["link"].isNotNull())


def plain_letters(s: Column) -> Column:
    return F.translate(F.replace(s, F.lit("i̇"), F.lit("i")), PLAIN_FROM, PLAIN_TO)


def wiki_prefix(name: Column) -> Column:
    """The name if it is a known wiki's, else null."""
    return F.when(name.isin([f"{c}wiki" for c in LANGUAGES]), name)


def percent_before(text: Column, part: Column) -> Column:
    """Where ``part`` first starts, as a share of the text; 1 if it does not occur."""
    at = F.position(part, text)
    return F.when(at > 0, (at - 1) / F.length(text)).otherwise(F.lit(1.0))


def percent_after(text: Column, part: Column) -> Column:
    """How much follows the first ``part``, as a share of the text; 1 if it does not occur."""
    at = F.position(part, text)
    return F.when(at > 0, (F.length(text) - (at - 1) - F.length(part)) / F.length(text)).otherwise(F.lit(1.0))


def parse_year(time: Column) -> Column:
    """Signed year of ``+YYYY-MM-DDT...``; null where there is none."""
    return F.regexp_replace(F.regexp_extract(time, r"^([+-]?\d+)-", 1), r"^\+", "").try_cast("int")


def token_features(token: Column, suffix: int = 3, prefix: int = 3, widest: int = 8) -> Column:
    """Struct of a token's features: word, suffix, prefix, their lower-case forms, digits, signs, capital, UTF-8 bytes (255 before, 256 after, padded with -1)."""
    codes = _bytes(F.left(token, F.lit(widest - 2)))  # no more characters than bytes are kept
    bounded = F.concat(F.array(F.lit(255)), F.slice(codes, 1, widest - 2), F.array(F.lit(256)))
    padded = F.concat(bounded, F.array_repeat(F.lit(-1), F.lit(widest) - F.size(bounded)))
    return F.struct(
        token.alias("word"), F.right(token, F.lit(suffix)).alias("suffix"), F.left(token, F.lit(prefix)).alias("prefix"), F.lower(token).alias("lower"),
        token.rlike(r"^\d+$").alias("is_digit"), F.length(F.regexp_replace(token, r"[A-Za-z0-9\p{L}]", "")).alias("n_punctuation"),
        token.rlike(r"^\p{Lu}").alias("first_upper"), padded.alias("bytes"),
    )


def _bytes(token: Column) -> Column:
    """UTF-8 bytes as an array of ints."""
    pairs = F.regexp_extract_all(F.hex(F.encode(token, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def by_batch(function):
    """A function of one string as a column function over Arrow batches; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    return F.pandas_udf(run, "string")


def strip_pattern(text: str, begin: str, end: str) -> str:
    """Cut every flat ``begin ... end``."""
    return re.sub(re.escape(begin) + r".*?" + re.escape(end), "", text, flags=re.S)


def strip_nested(text: str, begin: str, end: str, deeper_than: int = 0) -> str:
    """Cut outermost balanced ``begin ... end`` whose nesting goes deeper than ``deeper_than``."""
    marks = re.compile(f"({re.escape(begin)})|({re.escape(end)})")
    out, kept_to, open_at, depth, deepest = [], 0, None, 0, 0
    for m in marks.finditer(text):
        if m[1]:
            if depth == 0:
                open_at, deepest = m.start(), 0
            depth += 1
            deepest = max(deepest, depth)
        elif depth:
            depth -= 1
            if depth == 0 and deepest > deeper_than:
                out.append(text[kept_to:open_at])
                kept_to = m.end()
    return "".join(out) + text[kept_to:]


def strip_markup(text: str, keep_backslash: bool = False) -> str:
    """Wiki markup to text: templates, tables and nested links go, headings become paragraphs, bullets get a space."""
    text = strip_nested(text.replace("\t", " "), "{{", "}}")
    text = strip_nested(strip_pattern(text, "{|", "|}"), "[[", "]]", 1)
    text = re.sub(r"==+([^=]+)==+", r"\n\n\1" + (r"\\" if keep_backslash else "") + ". ", text)
    return re.sub(r"^([*#])", r"\1 ", text, flags=re.M)


def html_text(html: str) -> str:
    """Text content with ``ref`` elements left blank."""
    from html.parser import HTMLParser

    parts, refs = [], [0]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            refs[0] += tag == "ref"

        def handle_endtag(self, tag):
            refs[0] -= tag == "ref" and refs[0] > 0

        def handle_data(self, data):
            if not refs[0]:
                parts.append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    return "".join(parts)
