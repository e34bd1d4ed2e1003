"""String functions as Catalyst expressions: everything stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of a standard's id, query-parser operators, evidence markers, default captions.
STANDARD_ID = r"(?iuU)^(?:K[\s-]*IFRS\s*)?(?:제\s*)?(\d{4})(?:\s*호)?$"
LUCENE_OPERATORS = r'(&&|\|\||[+\-!(){}\[\]^"~*?:\\/])'
MARKER = r"\[(E\d+)\]"
CONTEXT_TAG = r"^\[[^\]\r\n]*\]\s*(?:\r?\n)?"
DEFAULT_TITLE = "이미지 분석 요청"
CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}"
#: Words that the analysis drops.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "s", "such", "t", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with", "www",
)
FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94))
HALF_WIDTH = "".join(chr(0x21 + i) for i in range(94))
#: Half-width kana and their full forms, by the compatibility decompositions of Unicode; some take a voicing mark.
KANA = "".join(chr(c) for c in range(0xFF65, 0xFFA0))
FULL_KANA = "".join(unicodedata.normalize("NFKC", c) for c in KANA)
VOICED_KANA = [(c + m, x) for c in KANA for m in "ﾞﾟ" if len(x := unicodedata.normalize("NFKC", c + m)) == 1]


def strip(c: Column) -> Column:
    """Both ends without any Unicode white space (trim() knows the blank alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_else(a: Column, b: Column) -> Column:
    """``a`` unless it is null or empty; a blank string counts as a value."""
    return F.when(F.length(a) > 0, a).otherwise(b)


def escape_query(c: Column) -> Column:
    """Full-text operators with a backslash before each; doubled & and | as one unit."""
    return F.regexp_replace(c, LUCENE_OPERATORS, r"\\$1")


def standard_id(c: Column) -> Column:
    """Four digits of forms such as 1109, KIFRS1109, 제1109호; null if blank or of another form."""
    digits = F.regexp_extract(strip(c), STANDARD_ID, 1)
    return F.when(F.length(digits) > 0, digits)


def standard_id_invalid(c: Column) -> Column:
    """Whether a value is neither blank nor a known form."""
    return F.coalesce((F.length(strip(c)) > 0) & standard_id(c).isNull(), F.lit(False))


def fold_width(c: Column) -> Column:
    """Full-width ASCII as ASCII, half-width kana as kana."""
    kana = F.translate(c, FULL_WIDTH, HALF_WIDTH)
    for half, full in VOICED_KANA:
        kana = F.replace(kana, F.lit(half), F.lit(full))
    return F.when(c.rlike("[！-ﾟ]"), F.translate(kana, KANA, FULL_KANA)).otherwise(c)


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, widths folded."""
    return F.filter(F.split(F.lower(fold_width(c)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def analyze(c: Column) -> Column:
    """Tokens of the CJK analysis: bigrams over CJK runs (a single character as it is, as are those beyond the basic
    plane), other words whole, no stop words."""
    marked = F.transform(words(c), lambda w: F.split(w, f"(?<=[{CJK}])(?=[^{CJK}])|(?<=[^{CJK}])(?=[{CJK}])"))

    def grams(run: Column) -> Column:
        n = F.length(run)
        return F.when(
            run.rlike(f"^[{CJK}]") & (n > 2), F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        ).otherwise(F.array(run))

    runs = F.flatten(marked)
    # a range is checked many times faster than scripts, and few other texts have characters in it
    has_cjk = c.rlike(r"[\u1100-\x{10FFFF}]") & c.rlike(f"[{CJK}ｦ-ﾟ]")
    tokens = F.when(has_cjk, F.flatten(F.transform(runs, grams))).otherwise(words(c))
    return F.filter(tokens, lambda w: ~w.isin(*STOP_WORDS))


def citation(label: Column, alias: Column, standard: Column, paragraph: Column, chunk_id: Column) -> Column:
    """A label if one has text, else made of the standard and paragraph, else of the standard and id, else the id."""
    direct = strip(F.coalesce(or_else(label, alias), F.lit("")))
    std, par = strip(F.coalesce(standard, F.lit(""))), strip(F.coalesce(paragraph, F.lit("")))
    return (
        F.when(F.length(direct) > 0, direct)
        .when((F.length(std) > 0) & (F.length(par) > 0), F.concat(F.lit("K-IFRS 제"), std, F.lit("호 "), par))
        .when(F.length(std) > 0, F.concat(F.lit("K-IFRS 제"), std, F.lit("호 ("), chunk_id, F.lit(")")))
        .otherwise(chunk_id)
    )


def markers(c: Column) -> Column:
    """Evidence ids in the order in which a text cites them."""
    return F.regexp_extract_all(c, F.lit(MARKER), F.lit(1))


def chat_title(c: Column) -> Column:
    clean = strip(F.regexp_replace(or_else(c, F.lit(DEFAULT_TITLE)), r"(?U)\s+", " "))
    return F.when(F.length(clean) > 32, F.concat(F.substring(clean, 1, 32), F.lit("…"))).otherwise(clean)


def strip_tag(c: Column) -> Column:
    """A statement without one leading [context tag]."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), CONTEXT_TAG, "")


def client_ip(forwarded: Column, peer: Column, trust_proxy: bool) -> Column:
    """First hop of a forwarded header if proxies are trusted, else the peer, else ``unknown``."""
    known = F.coalesce(peer, F.lit("unknown"))
    return F.when(F.length(forwarded) > 0, strip(F.split_part(forwarded, F.lit(","), F.lit(1)))).otherwise(known) if trust_proxy else known


def split_list(c: Column) -> Column:
    """Comma-separated entries, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: F.length(x) > 0)
