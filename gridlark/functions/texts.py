"""Text predicates and names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean a missing value in profiles and pivots, after trimming and lower-casing (fixed values).
NULL_TOKENS = ("", "na", "n/a", "null", "nil", "missing")
#: Words that make a header look like an identifier's (fixed values).
ID_TOKENS = frozenset(("id", "no", "code", "key", "num", "number", "uuid", "guid", "seq"))
ID_SUBSTRINGS = ("번호", "코드", "식별", "일련")
PREVIEW_CHARS = 1000


def is_null_token(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*NULL_TOKENS)


def contains_loosely(c: Column, needle: str) -> Column:
    """Contains, ignoring case and accents; the empty needle is in every text."""
    return F.lit(True) if needle == "" else F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(needle), "UNICODE_CI_AI"))


def _bare(s: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", s.strip().lower()) if unicodedata.category(x) != "Mn")


def _foldable() -> tuple[str, str]:
    """Accented letters of the Latin, Greek and Cyrillic blocks and their base letters, by decomposition."""
    pairs = [(chr(c), _bare(chr(c))) for c in [*range(0xC0, 0x250), *range(0x370, 0x500), *range(0x1E00, 0x2000)]]
    kept = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def folded(c: Column) -> Column:
    """Trimmed, lower-cased and without combining accents."""
    return F.translate(F.regexp_replace(F.lower(F.trim(c)), r"\p{Mn}", ""), *_foldable())


def fuzzy_contains(c: Column, needle: str) -> Column:
    """The needle's characters occur in order, ignoring case and accents."""
    return folded(c).rlike("(?s)" + ".*?".join(re.escape(x) for x in _bare(needle)))


def upper_equals(c: Column, value: str) -> Column:
    return F.upper(c) == F.upper(F.lit(value))


def preview(c: Column) -> Column:
    return F.when(F.length(c) > PREVIEW_CHARS, F.concat(F.left(c, F.lit(PREVIEW_CHARS)), F.lit(" …"))).otherwise(c)


def regex_or_none(pattern: str, ignore_case: bool = True) -> str | None:
    """The pattern with its flags if the engine's regular expressions accept it, else None."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    flagged = ("(?iu)" if ignore_case else "") + pattern
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(flagged)
    except (IllegalArgumentException, Py4JJavaError):  # the parser's complaint, wrapped or not
        return None
    return flagged


def header_suggests_id(name: str) -> bool:
    tokens = {t for t in re.split(r"[^0-9a-z]+", name.lower()) if t}
    return bool(tokens & ID_TOKENS) or any(s in name for s in ID_SUBSTRINGS)


def stable_keys(names: list[str]) -> list[str]:
    """Distinct keys for headers: an empty one is "value", a repeated one gets " (2)", " (3)" and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = n or "value"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def shown_name(names: list[str], k: int) -> str:
    return names[k] if 0 <= k < len(names) and names[k] else f"Column{k + 1}"
