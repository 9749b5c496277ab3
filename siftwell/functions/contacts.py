"""Columns over people's names, titles and e-mail addresses."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions.web import contains_any, lit_array, text


def _fold() -> tuple[str, str]:
    """Characters that decompose to one ASCII letter, with that letter."""
    pairs = [(c, d) for c in map(chr, range(0x80, 0x10000)) if (d := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) and len(d) == 1 and d.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold()
#: ligatures, which decompose to several letters
LIGATURES = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0xFB00, 0xFB05))]


def norm_name(c: Column) -> Column:
    """a-z of a name, accents and ligatures folded."""
    low = F.lower(text(c))
    for a, b in LIGATURES:
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.regexp_replace(F.lower(F.translate(low, FOLD_FROM, FOLD_TO)), "[^a-z]", "")


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.trim(text(c)), r"\s+"), lambda w: w != "")


def first_name(full: Column, first: Column, last: Column) -> Column:
    """The stored first name; the full name's first word where neither part is stored."""
    none = (F.trim(text(first)) == "") & (F.trim(text(last)) == "")
    return F.when(none, F.coalesce(F.get(words_of(full), F.lit(0)), F.lit(""))).otherwise(F.trim(text(first)))


def last_name(full: Column, first: Column, last: Column) -> Column:
    """The stored last name; the full name's last word of several where neither part is stored."""
    w, none = words_of(full), (F.trim(text(first)) == "") & (F.trim(text(last)) == "")
    return F.when(none, F.coalesce(F.when(F.size(w) > 1, F.element_at(w, -1)), F.lit(""))).otherwise(F.trim(text(last)))


def clean_email(c: Column) -> Column:
    return F.lower(F.trim(text(c)))


def email_domain(c: Column) -> Column:
    return F.coalesce(F.get(F.split(clean_email(c), "@"), F.lit(1)), F.lit(""))


def is_personal(c: Column, free: list[str] = dims.FREE_EMAIL_DOMAINS) -> Column:
    return email_domain(c).isin(free)


def is_generic(c: Column, prefixes: list[str] = dims.GENERIC_PREFIXES) -> Column:
    """The local part is a role word or one with at most three characters more.  One pattern for all words: a filter on a computed
    address takes its whole expression in, and a loop over the words would compute it for each of them."""
    words = "|".join(rf"\Q{p}\E" for p in prefixes) if prefixes else "(?!)"
    return F.contains(text(c), F.lit("@")) & F.rlike(F.substring_index(clean_email(c), "@", 1), F.lit(rf"(?s)\A(?:{words}).{{0,3}}\z"))


def is_institutional(c: Column) -> Column:
    return F.endswith(email_domain(c), F.lit(".mil"))


def is_former(c: Column) -> Column:
    return F.rlike(text(c), F.lit(dims.FORMER))


def clean_name(c: Column) -> Column:
    """Without pronouns, brackets and credentials."""
    x = F.regexp_replace(text(c), r"\s*\([^)]*\)", "")
    return F.trim(F.regexp_replace(x, dims.CREDENTIALS, ""))


def profile_name(title: Column) -> Column:
    """struct(name, job) from 'Name - Job at Company | Site', the site's name with or without a bar."""
    core = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text(title), r"(?i)\s*\|?\s*LinkedIn\s*$", "")), r"\s*\|.*$", ""))
    part = F.filter(F.transform(F.split(core, r"\s+[–\-]\s+"), F.trim), lambda x: x != "")
    job = F.trim(F.regexp_replace(F.coalesce(F.get(part, F.lit(1)), F.lit("")), r"(?i)\s+at\s+.+$", ""))
    return F.struct(F.get(part, F.lit(0)).alias("name"), job.alias("job"))


def is_profile_name(c: Column, bad: list[str] = dims.BAD_NAME_TOKENS) -> Column:
    """Two words at least, no digit, and neither first name nor the rest a word that profiles put there."""
    low = F.lower(F.trim(text(c)))
    w = words_of(low)
    rest = F.array_join(F.slice(w, 2, 1000), " ")
    return (F.size(w) >= 2) & ~F.rlike(low, F.lit(r"\d")) & (F.length(F.rtrim(rest, F.lit(".,;:"))) >= 2) & ~rest.isin(bad) & ~F.coalesce(F.get(w, F.lit(0)).isin(bad), F.lit(False))


def is_valid_name(c: Column, bad: list[str] = dims.NOT_NAME_WORDS, suffixes: list[str] = dims.NAME_SUFFIXES) -> Column:
    w = words_of(c)
    low = F.transform(w, F.lower)
    upper = F.forall(w, lambda x: F.rlike(x, F.lit(r"^\p{Lu}")))
    return F.size(w).between(2, 4) & upper & ~F.rlike(text(c), F.lit(r"\d")) & ~F.arrays_overlap(low, lit_array(bad)) & ~F.coalesce(F.try_element_at(low, F.lit(-1)).isin(suffixes), F.lit(False))


def title_matches(c: Column, titles: list[str] = dims.TARGET_TITLES) -> Column:
    return contains_any(c, titles)


def title_passes(c: Column, roles: list[str] = dims.KEPT_ROLES) -> Column:
    return contains_any(c, roles)


def email_candidate(first: Column, last: Column, domain: Column, pattern: Column) -> Column:
    """Address by a named pattern over normalised names; NULL where a needed part is empty."""
    return candidate_of(norm_name(first), norm_name(last), domain, pattern)


def candidate_of(f: Column, l: Column, domain: Column, pattern: Column) -> Column:  # noqa: E741
    """email_candidate of names that norm_name has seen; over a table, keep those in columns of their own."""
    fi, li = F.substring(f, 1, 1), F.substring(l, 1, 1)
    s = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    local = {
        "first.last": s(f, ".", l), "f.last": s(fi, ".", l), "first.l": s(f, ".", li), "first_last": s(f, "_", l), "firstlast": s(f, l), "flast": s(fi, l),
        "last.first": s(l, ".", f), "lastfirst": s(l, f), "last_first": s(l, "_", f), "last": l, "first": f,
    }
    out = F.when(F.lit(False), F.lit(""))
    for name, value in local.items():
        out = out.when(pattern == name, value)
    return F.when((f != "") & (l != "") & (text(domain) != ""), F.concat(out, F.lit("@"), domain))


def token_named(low: Column, tokens: list[str] = dims.EMAIL_TOKENS, names: list[str] = dims.EMAIL_PATTERNS) -> Column:
    """Pattern of the first token, in list order, that a lower-cased text holds."""
    return F.coalesce(*[F.when(F.contains(low, F.lit(t)), F.lit(n)) for t, n in zip(tokens, names, strict=True)])


def worded(low: Column) -> Column:
    """Pattern that a lower-cased text describes in words."""
    has = lambda *x: F.greatest(*[F.contains(low, F.lit(y)) for y in x]) if len(x) > 1 else F.contains(low, F.lit(x[0]))
    return (
        F.when(has("first name.last name", "firstname.lastname"), "first.last").when(has("first initial.last", "first initial last"), "f.last").when(has("first.last initial", "firstname.l"), "first.l")
        .when(has("first_last", "first name_last name"), "first_last").when(has("first name last name") & ~F.contains(F.substring(low, 1, 200), F.lit(".")), "firstlast")
    )


def token_pattern(body: Column) -> Column:
    """Pattern of the first token that the text holds, in list order; else from its wording."""
    low = F.lower(text(body))
    return F.coalesce(token_named(low), worded(low))


def source_family(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for f in ("Site", "EFmt", "Search", "PatVfy"):
        out = out.when(F.contains(text(label), F.lit(f)), f)
    return out.otherwise("Other")


def is_confirmed(email: Column, layer: Column, verified: Column) -> Column:
    """On the site or in search evidence; by pattern only if verified."""
    return (text(email) != "") & (layer.isin("L1-Site", "L4-Search") | ((layer == "L2-EFmt") & F.coalesce(verified, F.lit(False))))


def search_names(name: Column, profile_url: Column, domain: Column) -> Column:
    """Names to search a company by, in order and without repeats: its name without corporate suffix (unless it holds a
    domain), its profile's words, the words of its domain's first label, the domain; the name where there is none."""
    spaced = lambda c: F.trim(F.translate(c, "-_", "  "))
    bare = F.trim(F.regexp_replace(F.trim(text(name)), dims.CORPORATE_SUFFIX, ""))
    slug = F.regexp_extract(text(profile_url), r"/company/([^/?]*)", 1)
    d = F.trim(text(domain))
    parts = F.array(F.when(~F.rlike(text(name), F.lit(dims.SITE_ENDING)), bare), spaced(slug), spaced(F.substring_index(d, ".", 1)), d)
    keep = F.filter(parts, lambda s: s.isNotNull() & (s != ""))
    low = F.transform(keep, F.lower)
    out = F.filter(keep, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)
    return F.when((F.size(out) == 0) & (F.trim(text(name)) != ""), F.array(F.trim(name))).otherwise(out)
