"""Scalar text functions: token normalisers, line cleaners and gloss rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .unicode import nfc, nfd

# --- fixed values ---------------------------------------------------------------------

SUBSCRIPTS = ("₀₁₂₃₄₅₆₇₈₉", "0123456789")
#: One-to-one letters of each normaliser; the letters after the replacements' end are dropped.
SUMERIAN_LETTERS = ("ŋŊḫḪṣṢṭṬʾ", "jJhHsStT")
AKKADIAN_LETTERS = ("ḫḪṣṢṭṬāĀēĒīĪūŪâÂêÊîÎûÛáÁéÉíÍóÓúÚʾ", "hHsStTaAeEiIuUaAeEiIuUaAeEiIoOuU")
GREEK_MARKS = "̀́̄̆̈̓̔͂ͅ"
EGYPTIAN_LETTERS = ("ꜣȝɜʾꜥʿḥḫẖṯčḏğḍšŠṭṣśỉḳ", "AAAAaaHxXTTDDDSSdssiq")
EGYPTIAN_LOWERED = ("BCEFGIJKLMNOPQRUVWYZ", "bcefgijklmnopqruvwyz")
SLP1 = {
    "A": "ā", "I": "ī", "U": "ū", "f": "ṛ", "F": "ṝ", "x": "ḷ", "X": "ḹ", "E": "ai", "O": "au", "M": "ṃ", "H": "ḥ", "~": "m̐",
    "K": "kh", "G": "gh", "N": "ṅ", "C": "ch", "J": "jh", "Y": "ñ", "w": "ṭ", "W": "ṭh", "q": "ḍ", "Q": "ḍh", "R": "ṇ",
    "T": "th", "D": "dh", "P": "ph", "B": "bh", "S": "ś", "z": "ṣ", "L": "ḻ",
}
NEGATORS = ("not", "no", "without", "never")
GERMAN_NEGATORS = ("nicht", "kein", "keine", "keinen", "ohne", "nie", "niemals")
CROSS_REFERENCES = ("see", "cf", "vid")
SCAFFOLD = (
    "having", "relating", "belonging", "rarely", "who", "whose", "one's", "various", "especially", "particularly", "chiefly", "generally", "usually",
    "being",
)
STOP_WORDS = (
    "a", "an", "the", "to", "of", "in", "on", "at", "by", "for", "with", "be", "is", "are", "was", "were", "as", "or", "and", "but", "if", "so", "do",
    "did", "have", "has", "had", "from", "into", "out", "up", "down", "over", "under", "between", "during", "before", "after", "above", "below",
    "any", "some", "all", "each", "every", "one", "two", "three", "four", "five",
)
GLOSS_WORD = "[\\p{L}][\\p{L}'\\-]*"
COOCCURRENCE_STOP_WORDS = (
    "the", "of", "and", "in", "to", "a", "is", "was", "for", "on", "with", "his", "her", "its", "their", "he", "she", "it", "they", "that", "this",
    "by", "from", "at", "an", "be", "has", "had", "not", "but", "who", "which", "as", "or", "if", "my", "your",
)
JUNK_GLOSSES = (
    "x", "xx", "0", "00", "1", "n", "c", "e", "i", "u", "s", "unmng", "cf",
)
ENGLISH_STOP_GLOSSES = STOP_WORDS + ("des", "de")


def let(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is worked out once even where ``fn`` uses it often."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _sz(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("š"), F.lit("sz")), F.lit("Š"), F.lit("SZ"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


# --- token normalisers ----------------------------------------------------------------


def normalize_sumerian(c: Column | str) -> Column:
    """Subscript digits to ASCII, braces off, š as sz and other letters to ASCII, no hyphens, lower case. Null is empty."""
    x = F.translate(_text(c), *SUBSCRIPTS)
    x = F.regexp_replace(x, "\\{([^}]*)\\}", "$1")
    return strip(F.lower(F.replace(F.translate(_sz(x), *SUMERIAN_LETTERS), F.lit("-"), F.lit(""))))


def _akkadian(c: Column | str, dropped: str) -> Column:
    x = F.translate(nfc(_text(c)), *SUBSCRIPTS)
    x = F.regexp_replace(x, "\\{([^}]*)\\}", "$1")
    x = F.regexp_replace(F.translate(_sz(x), *AKKADIAN_LETTERS), dropped, "")
    # before lower-casing: capital pairs stay
    return strip(F.lower(F.regexp_replace(x, "([aeiou])\\1+", "$1")))


def normalize_akkadian(c: Column | str) -> Column:
    """As Sumerian, after composition, with long vowels made plain and runs of one vowel made single."""
    return _akkadian(c, "-")


def normalize_hittite(c: Column | str) -> Column:
    """As Akkadian, and clitic boundaries go as hyphens do."""
    return _akkadian(c, "[-=]")


def normalize_greek(c: Column | str) -> Column:
    """Accents, breathings and lengths off; every sigma is the medial one; lower case."""
    x = F.regexp_replace(nfd(_text(c)), f"[{GREEK_MARKS}]", "")
    return strip(F.lower(F.translate(nfc(x), "ςΣ", "σσ")))


def normalize_sanskrit(c: Column | str) -> Column:
    """Composed, lower case, diacritics kept."""
    return strip(F.lower(nfc(_text(c))))


def normalize_egyptian(c: Column | str) -> Column:
    """Egyptological letters to their ASCII codes, whose capitals A H T D S X are kept, unless all letters are ASCII capitals."""
    x = F.translate(strip(_text(c)), *EGYPTIAN_LETTERS)

    def cased(s: Column) -> Column:
        letters = F.regexp_replace(s, "[^\\p{L}]", "")
        kept = F.transform(F.split(s, ""), lambda ch: F.when(ch.isin(*"AHTDSX"), ch).otherwise(F.lower(ch)))
        return F.when(letters.rlike("^[A-Z]+$"), F.lower(s)).otherwise(F.array_join(kept, ""))

    return let(x, cased)


def slp1_to_iast(c: Column | str) -> Column:
    """Letter by letter; what the table lacks passes through."""
    table = F.create_map(*[F.lit(x) for kv in SLP1.items() for x in kv])
    return F.array_join(F.transform(F.split(_text(c), ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")


def mimation_alternates(c: Column) -> Column:
    """The token, and without its final m after a vowel; nothing for the empty token."""
    short = F.when(c.rlike("^.+[aeiou]m$"), F.substring(c, F.lit(1), F.length(c) - 1))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(c, short)))


def clitic_alternates(c: Column) -> Column:
    """The token, and its host before the first clitic boundary if there is one."""
    host = F.substring_index(c, "=", 1)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.array(c, host), lambda x: x != "")))


# --- lines and documents --------------------------------------------------------------


def tokens(c: Column, pattern: str = "(?U)\\s+") -> Column:
    return F.filter(F.split(c, pattern), lambda x: x != "")


def clean_atf_line(c: Column | str, normalize=None, capitals_first: bool = True) -> Column:
    """A transliterated line as blank-separated tokens; hyphenated ones give the joined form and then their parts.

    Editorial marks, brackets, compound signs and markers go; words in all capitals (tested before
    ``normalize`` with ``capitals_first``), lone signs and tokens that open with $ % & + ' go too.
    """
    normalize = normalize or (lambda t: F.lower(F.translate(t, *SUBSCRIPTS)))
    x = _text(c)
    for pattern, by in (
        ("!\\([^)]*\\)", ""), ("[\\[\\]]", ""), ("<([^>]*)>", "$1"), ("\\|[^|]*\\|", ""), ("\\|[A-Z0-9.x+]+", ""), ("[A-Z0-9.x+]+\\|", ""),
        ("_[^_\\s]*_", ""), ("(?<!\\d)\\(([^)]*)\\)", "$1"), ("[#?!]", ""), ("\\{([^}]*)\\}", " $1 "),
    ):
        x = F.regexp_replace(x, pattern, by)
    spread = F.flatten(F.transform(tokens(x), lambda t: F.when(F.contains(t, F.lit("-")), F.concat(F.array(F.replace(t, F.lit("-"), F.lit(""))), F.split(t, "-"))).otherwise(F.array(t))))
    x = strip(F.regexp_replace(F.regexp_replace(F.array_join(spread, " "), "(?<!\\d)\\.(?!\\d)", " "), "(?U)\\s+", " "))

    def upper(t):
        return (t == F.upper(t)) & (t != F.lower(t))

    def pairs(t):
        return F.struct(t.alias("raw"), normalize(t).alias("norm"))

    def good(p):
        seen = p["raw"] if capitals_first else p["norm"]
        n = p["norm"]
        return (n != "") & ~upper(seen) & ~n.rlike("^[$%&+']") & ~((F.length(n) == 1) & ~n.rlike("^\\p{L}$"))

    kept = F.transform(F.filter(F.transform(tokens(x), pairs), good), lambda p: p["norm"])
    return F.when(_text(c).startswith("$") | x.isin("", "..."), F.lit("")).otherwise(F.array_join(kept, " "))


def clean_line(c: Column | str, normalize=lambda t: strip(F.lower(t))) -> Column:
    """Each blank-separated token of the composed line normalised (as in Sanskrit: lower case), empty ones dropped. ``normalize`` must be free of Python functions."""
    return F.array_join(F.filter(F.transform(tokens(nfc(_text(c))), normalize), lambda t: t != ""), " ")


def document_tokens(c: Column | str) -> Column:
    """Lower-case letter runs with a trailing number, normalised as Sumerian tokens are."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-zA-ZšŠḫḪṭṬṣṢĝĜ]+\\d*"), F.lit(0))
    return F.filter(F.transform(found, normalize_sumerian), lambda t: t != "")


def char_ngrams(c: Column, low: int = 3, high: int = 6) -> Column:
    """Distinct n-grams of <word>, n from ``low`` to ``high``; lengths beyond the padded word are skipped."""

    def grams(p: Column) -> Column:
        def of(n: Column) -> Column:
            return F.when(n <= F.length(p), F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, n))).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), of)))

    return let(F.concat(F.lit("<"), c, F.lit(">")), grams)


def morphemes(c: Column | str, normalize=normalize_sumerian) -> Column:
    """The normalised parts of a hyphenated word; none without a hyphen."""
    parts = F.filter(F.transform(F.split(_text(c), "-"), normalize), lambda t: t != "")
    return F.when(F.contains(_text(c), F.lit("-")), parts).otherwise(F.array().cast("array<string>"))


def edit_distance_within_one(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def translation_key(c: Column) -> Column:
    """Composition id c.X to the id t.X of its translation."""
    return F.regexp_replace(c, "^c\\.", "t.")


def composition_by_last_dot(c: Column) -> Column:
    return F.regexp_replace(c, "\\.[^.]*$", "")


def composition_by_first_dot(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def book_number(c: Column) -> Column:
    """The second comma-separated part of a chapter's name, trimmed; null without one."""
    return strip(F.get(F.split(c, ","), F.lit(1)))


def markdown_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


# --- glosses --------------------------------------------------------------------------


def clean_gloss(c: Column | str) -> Column:
    return F.regexp_replace(strip(_text(c)), "[\\s,.;:—\\-]+$", "")


def gloss_segments(c: Column | str) -> Column:
    """Segments between ; and , outside parentheses that hold two adjacent ASCII letters and aren't noise."""
    parts = F.split(F.regexp_replace(_text(c), "\\([^)]*\\)", " "), "[;,]")
    tidy = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, "\\s+", " "), "^[ .:—–\\-'’\"]+|[ .:—–\\-'’\"]+$", ""))
    return F.filter(tidy, lambda s: s.rlike("[A-Za-z]{2}") & ~F.lower(s).isin("&c", "etc", "ib", "q.v", "cf"))


def gloss_words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(GLOSS_WORD), F.lit(0))


def first_english(c: Column | str, vocabulary: Column, negators: tuple[str, ...] = NEGATORS) -> Column:
    """The first content word of a gloss that ``vocabulary`` (an array) has, as it is or without hyphens.

    Null if a negator comes before it, or if the gloss opens with a cross-reference. A word of one letter counts as
    content but never as a hit.
    """

    def scan(ws: Column) -> Column:
        states = F.transform(
            ws,
            lambda w, i: F.struct(
                i.alias("at"),
                w.isin(*negators).alias("neg"),
                (~w.isin(*negators, *STOP_WORDS, *SCAFFOLD)).alias("content"),
                F.when(F.length(w) > 1, F.when(F.array_contains(vocabulary, w), w).when(F.array_contains(vocabulary, F.replace(w, F.lit("-"), F.lit(""))), F.replace(w, F.lit("-"), F.lit("")))).alias("hit"),
                w.alias("w"),
            ),
        )

        def decide(xs: Column) -> Column:
            hit = F.get(F.filter(xs, lambda x: x["content"] & x["hit"].isNotNull()), F.lit(0))
            negator = F.get(F.filter(xs, lambda x: x["neg"]), F.lit(0))
            first = F.get(F.filter(xs, lambda x: x["content"]), F.lit(0))
            bad = first["w"].isin(*CROSS_REFERENCES) | F.coalesce(negator["at"] < hit["at"], F.lit(False))
            return F.when(~F.coalesce(bad, F.lit(False)), hit["hit"])

        return let(states, decide)

    return let(gloss_words(c), scan)


def gw_is_usable(c: Column | str, negators: tuple[str, ...] = NEGATORS) -> Column:
    """Whether a guide word's first word of content is neither negator nor cross-reference and has over one letter."""
    content = F.filter(gloss_words(c), lambda w: ~w.isin(*STOP_WORDS, *SCAFFOLD))
    first = F.get(content, F.lit(0))
    return F.coalesce(~first.isin(*negators, *CROSS_REFERENCES) & (F.length(first) > 1), F.lit(False))


def with_definition(word: Column, definition: Column) -> Column:
    """word: definition, or the bare word."""
    return F.concat_ws(": ", word, definition)


def keep_sumerian_gloss(c: Column) -> Column:
    return ~c.isin(*JUNK_GLOSSES) & (F.length(c) > 2) & ~c.rlike("^\\d+$") & ~c.startswith("~") & gw_is_usable(c)


def keep_german_gloss(c: Column) -> Column:
    return ~c.isin("", "?", "x", "X", "...", "??") & (F.length(c) > 2) & ~c.rlike("^\\d|^\\(.*\\)$|^[ŠḪṢṬĀĒĪŪŌ]") & gw_is_usable(c, NEGATORS + GERMAN_NEGATORS)


def language_is(c: Column, prefix: str) -> Column:
    return F.coalesce(c.startswith(prefix), F.lit(False))


def cuneiform_signs(c: Column) -> Column:
    """The distinct cuneiform characters of a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[\\x{12000}-\\x{123FF}]"), F.lit(0)))


def numeric_claims(c: Column) -> Column:
    """Decimal numbers in [-1, 1] that a text states."""
    found = F.transform(F.regexp_extract_all(c, F.lit("-?\\d+\\.\\d+"), F.lit(0)), lambda x: x.cast("double"))
    return F.filter(found, lambda x: x.between(-1, 1))
