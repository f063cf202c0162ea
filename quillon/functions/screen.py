"""Functions on strings that people see: which files hold them, in which language, and which literals are such strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders left out, names of translation files and their endings, endings of components, attributes and the kind each gives.
SKIPPED = ("node_modules", "/target/", "/build/")
TRANSLATIONS, TRANSLATION_ENDINGS = ("/i18n/", "/locales/", "/locale/", "/lang/", "messages", "translation"), (".json", ".properties")
COMPONENTS = (".tsx", ".jsx", ".vue", ".svelte")
ATTRIBUTES = {"data-testid": "test_id", "aria-label": "aria_label", "placeholder": "placeholder"}
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_translation(path: Column) -> Column:
    p = F.lower(path)
    return _any(p.contains(x) for x in TRANSLATIONS) & _any(p.endswith(x) for x in TRANSLATION_ENDINGS)


def is_candidate(path: Column) -> Column:
    """Whether a file may hold strings that people see."""
    p = F.lower(path)
    return ~_any(p.contains(x) for x in SKIPPED) & (is_translation(path) | _any(p.endswith(x) for x in COMPONENTS))


def locale_of(path: Column) -> Column:
    """The language of a translation file by the tail of its name, its name, or its folder; null if none of them is a tag."""
    p = F.lower(path)
    stem = F.split_part(F.regexp_replace(p, "^.*/", ""), F.lit("."), F.lit(1))
    tag = lambda c: F.when(c.rlike("^[a-z]{2}(?:[-_]|$)"), c)
    tail = F.when(stem.contains("_"), F.regexp_replace(stem, "^.*_", ""))
    folder = F.when(p.rlike("/"), F.regexp_extract(p, "([^/]*)/[^/]*$", 1))
    return F.coalesce(tag(tail), tag(stem), tag(folder))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def looks_visible(s: Column) -> Column:
    """Whether a literal reads like a phrase: no path, no identifier, 2 to 200 bytes, a letter, and a space or a leading capital."""
    t = trimmed(s)
    n = F.octet_length(t)
    plain = ~t.contains("/") & ~t.contains("\\") & ~t.startswith("@") & ~t.startswith("#")
    return (n >= 2) & (n <= 200) & plain & t.rlike(r"\p{L}") & (t.contains(" ") | t.rlike(r"^\p{Lu}")) & ~t.rlike("^[a-z0-9-]*$")
