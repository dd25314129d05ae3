"""Text expressions.  Every function takes and returns a Column; nothing here runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import fixed


def trim_all(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(c, f"^{fixed.WS}+|{fixed.WS}+$", "")


def collapse_spaces(c: Column) -> Column:
    """One space for every run of white space."""
    return F.regexp_replace(c, f"{fixed.WS}+", " ")


def null_tokens(c: Column) -> Column:
    """Trimmed text, or null for a blank or a placeholder."""
    t = trim_all(c)
    return F.when(F.lower(t).isin(fixed.NULL_TOKENS), None).otherwise(t)


def guard_formula(c: Column) -> Column:
    """Put a quote before text that a spreadsheet would run."""
    return F.when(c.rlike(r"^([=@]|[+-][^\p{Nd}. ])"), F.concat(F.lit("'"), c)).otherwise(c)


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def _capital_parts(word: Column) -> Column:
    by_hyphen = F.transform(
        F.split(word, "-"),
        lambda h: F.array_join(F.transform(F.split(h, "'"), _capital), "'"),
    )
    return F.array_join(by_hyphen, "-")


def smart_title(c: Column) -> Column:
    """Title case by word, hyphen and apostrophe; name particles stay lower unless they come first."""
    words = F.transform(
        F.split(F.lower(c), " "),
        lambda w, i: F.when((i > 0) & w.isin(fixed.NAME_PARTICLES), w).otherwise(_capital_parts(w)),
    )
    return F.array_join(words, " ")


def single_case(c: Column) -> Column:
    """True when the text has cased letters and all of them are of one case."""
    return c.rlike(r"[\p{Lu}\p{Ll}]") & (~c.rlike(r"[\p{Lu}\p{Lt}]") | ~c.rlike(r"[\p{Ll}\p{Lt}]"))


def short_acronym(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]") & (F.length(c) <= 3)


def first_email(c: Column) -> Column:
    """First e-mail address in the text, in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(c, fixed.EMAIL_FIND, 0)), F.lit(""))


def redact(c: Column) -> Column:
    """Replace e-mail addresses, then long digit runs."""
    return F.regexp_replace(F.regexp_replace(c, fixed.EMAIL_FIND, "[EMAIL]"), fixed.PHONE_FIND, "[PHONE]")


def scrub_secrets(c: Column, limit: int = 120) -> Column:
    """Hide keys in error text that is first cut to ``limit`` characters."""
    return F.regexp_replace(F.substring(c, 1, limit), fixed.SECRET_TOKEN, "$1***")


def has_credential(c: Column) -> Column:
    return c.rlike(fixed.CREDENTIAL_ANY)


def words3(c: Column) -> Column:
    """All runs of three or more ASCII letters, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))


def search_tokens(c: Column) -> Column:
    """Distinct search words without stop words."""
    stop = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])
    return F.array_except(F.array_distinct(words3(c)), stop)


def letter_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---.*?---\s*", "")


def strip_markup(c: Column) -> Column:
    """Text fit for reading aloud: no stage directions, markdown marks or pictographs."""
    t = F.regexp_replace(c, r"(?i)\[[^\]]*\]|\((?:laughs?|chuckles?|pauses?|sighs?|music|intro|outro)[^)]*\)", " ")
    t = F.regexp_replace(t, r"[*_#`~>|]+", "")
    t = F.regexp_replace(t, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]", "")
    return trim_all(collapse_spaces(t))


def split_sentences(c: Column) -> Column:
    """Pieces between white space that follows ``. ! ?``."""
    return F.split(c, r"(?<=[.!?])" + fixed.WS + "+")


def sentences(c: Column) -> Column:
    """Cleaned sentences of more than three characters."""
    pieces = F.transform(split_sentences(strip_markup(strip_front_matter(c))), trim_all)
    return F.filter(pieces, lambda s: F.length(s) > 3)


def strip_reasoning(c: Column) -> Column:
    """Drop reasoning blocks; an unclosed block drops the rest of the text."""
    return F.regexp_replace(c, r"(?s)<think>.*?(</think>|\z)", "")


def slug(c: Column, fallback: str = "overview") -> Column:
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 60)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def safe_filename(c: Column, fallback: str = "data.csv") -> Column:
    """Last path part with every unusual character replaced."""
    name = F.regexp_extract(c, r"([^/]*)/*\z", 1)
    s = F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_.\-]", "_"), 1, 100)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def normal_question(c: Column) -> Column:
    return trim_all(collapse_spaces(F.lower(c)))


def question_key(tenant: Column, c: Column) -> Column:
    return F.sha2(F.concat_ws("::", tenant, normal_question(c)), 256)


def client_key(owner: Column, browser: Column, address: Column) -> Column:
    """Key of one client: its cleaned browser id, else its address."""
    b = F.substring(F.regexp_replace(F.coalesce(browser, F.lit("")), "[^A-Za-z0-9-]", ""), 1, 64)
    return F.concat_ws(":", owner, F.coalesce(F.nullif(b, F.lit("")), address))


def only_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def is_palindrome(c: Column) -> Column:
    kept = only_alnum(c)
    return kept == F.reverse(kept)


def extract_text(c: Column) -> Column:
    """File text with blank runs reduced, trimmed."""
    return trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def strip_literals(c: Column, pattern: str) -> Column:
    """Blank out every match but keep its line breaks, so line numbers stay right."""
    kept = F.split(c, pattern, -1)
    cut = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def with_gap(piece: Column, lost: Column) -> Column:
        gap = F.when(lost.contains("\n"), F.regexp_replace(lost, r"[^\n]+", "")).otherwise(F.lit(" "))
        return F.concat(piece, F.when(lost.isNull(), "").otherwise(gap))

    return F.array_join(F.zip_with(kept, cut, with_gap), "")


def strip_code(c: Column) -> Column:
    """Java code without string literals and comments."""
    return strip_literals(c, fixed.CODE_TEXT)
