"""Search terms for markets: banks of templates by industry, country and city.

A market's terms are one array column, in order and each once; a bank holds some hundred terms at most, so a market is one
row until terms are taken apart with explode_terms().  Columns: industry ('' where none is chosen), country ('' or 'All
Countries' where none is), cities (those of the country), keywords (the user's own terms).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions.web import lit_array, text
from siftwell.operators.dedupe import first_n


def _fill(template: str, **values: Column) -> Column:
    """A template with columns in the places of {name}."""
    parts = re.split(r"\{(\w)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def _terms(templates: list[str], **values: Column) -> Column:
    return F.array(*[_fill(t, **values) for t in templates])


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(condition: Column, terms: Column) -> Column:
    return F.when(condition, terms).otherwise(_none())


def _each(cities: Column, most: int | None, make) -> Column:
    return F.flatten(F.transform(F.slice(cities, 1, most) if most else cities, make))


def once(terms: Column) -> Column:
    """Terms trimmed, without blanks, first of each."""
    return F.array_distinct(F.filter(F.transform(terms, lambda s: F.trim(s)), lambda s: s != ""))


def country_of_market(country: Column) -> Column:
    return F.when(F.lower(F.trim(text(country))) == "all countries", "").otherwise(F.trim(text(country)))


def cities_of(country: Column, cities: dict[str, list[str]] = dims.MAJOR_CITIES) -> Column:
    """The listed cities of a country, none where it is not listed."""
    table = F.create_map(*[x for k, v in cities.items() for x in (F.lit(k), lit_array(v))])
    return F.coalesce(F.try_element_at(table, country_of_market(country)), _none())


def primary_terms(industry: Column, country: Column, cities: Column, keywords: Column, keywords_only: Column | None = None) -> Column:
    """Industry by country (language industries have more), industry by city, then the user's own terms; countries alone
    where no industry is chosen; nothing but the user's terms where only those are wanted."""
    i, c = F.trim(text(industry)), country_of_market(country)
    own = F.coalesce(keywords, _none())
    language = i.isin(dims.LANGUAGE_INDUSTRIES)
    office = F.concat(_terms(dims.LANGUAGE_COUNTRY_TERMS[:-1], c=c), F.array(F.when(c == "Egypt", _fill(dims.EGYPT_OFFICE_TERM, c=c)).otherwise(_fill(dims.LANGUAGE_COUNTRY_TERMS[-1], c=c))))
    by_country = F.concat(_terms(dims.COUNTRY_TERMS, i=i, c=c), _if(language, office))
    last = lambda t: F.when(i.isin("localization", "translation"), _fill(dims.LANGUAGE_CITY_TERM, t=t)).otherwise(_fill(dims.CITY_TERMS[-1], i=i, t=t))
    by_city = _each(cities, None, lambda t: F.concat(_terms(dims.CITY_TERMS[:-1], i=i, t=t), F.array(last(t))))
    named = F.when(i != "", F.concat(_if(c != "", by_country), by_city)).otherwise(_if(c != "", _terms(dims.COUNTRY_ONLY_TERMS, c=c)))
    return once(F.concat(F.when(keywords_only, _none()).otherwise(named), own) if keywords_only is not None else F.concat(named, own))


def directory_terms(industry: Column, country: Column) -> Column:
    """Terms that find lists of companies; trade directories for language industries."""
    i, c = F.lower(F.trim(text(industry))), country_of_market(country)
    i = F.when(i == "", "localization").otherwise(i)
    label, g = F.when(i == "all", "companies").otherwise(i), F.when(c != "", F.concat(F.lit(" "), c)).otherwise("")
    trade = F.concat(_terms(dims.TRADE_TERMS, g=g), _if(c != "", _terms(dims.TRADE_COUNTRY_TERMS, c=c)))
    return once(F.concat(_terms(dims.DIRECTORY_TERMS, i=label, g=g), _if(i.isin(dims.TRADE_INDUSTRIES), trade)))


def expansion_terms(industry: Column, country: Column, cities: Column, shortfall: Column) -> Column:
    """Terms for when the first ones find the same sites again: the first max(25, min(80, 2 * shortfall))."""
    i, c = F.coalesce(F.nullif(text(industry), F.lit("")), F.lit("localization")), country_of_market(country)
    roles = [t for r in dims.EXPANSION_ROLES for t in (f"{{i}} {r} {{c}}", f"translation {r} {{c}}")]
    every = F.concat(_terms(roles, i=i, c=c), _each(cities, 6, lambda t: _terms(dims.EXPANSION_CITY_TERMS, t=t)), _if(c == "Egypt", lit_array(dims.EGYPT_EXPANSION_TERMS)))
    return F.slice(once(every), F.lit(1), F.greatest(F.lit(25), F.least(F.lit(80), 2 * shortfall)).cast("int"))


def rotation_terms(industry: Column, country: Column, cities: Column, tlds: dict[str, str] = dims.ROTATION_TLDS) -> Column:
    """Niches, directories, cities and sites of the country's domain, for runs that go on."""
    i, c = F.coalesce(F.nullif(text(industry), F.lit("")), F.lit("localization")), country_of_market(country)
    niches = F.concat(*[F.concat(_if(c != "", _terms([f"{n} company {{c}}", f"{n} agency {{c}}"], c=c)), _terms([f"{n} {{i}} {{c}}"], i=i, c=c)) for n in dims.ROTATION_NICHES])
    table = F.create_map(*[F.lit(x) for kv in tlds.items() for x in kv])
    d = F.try_element_at(table, c)
    return once(F.concat(
        niches, _terms(dims.ROTATION_TERMS, i=i, c=c), _each(cities, 8, lambda t: _terms(dims.ROTATION_CITY_TERMS, i=i, t=t)), _if(c == "Egypt", lit_array(dims.EGYPT_ROTATION_TERMS)),
        _if(d.isNotNull(), _terms(dims.ROTATION_TLD_TERMS, i=i, d=d)),
    ))


def term_bank(industry: Column, country: Column, cities: Column, keywords: Column, shortfall: Column) -> Column:
    """Directories, primary, expansion and rotation terms, first of each."""
    return once(F.concat(directory_terms(industry, country), primary_terms(industry, country, cities, keywords), expansion_terms(industry, country, cities, shortfall), rotation_terms(industry, country, cities)))


def explode_terms(markets: DataFrame, key: str, terms: str) -> DataFrame:
    """key, place (from 1), term."""
    return markets.select(key, F.posexplode(terms).alias("_at", "term")).select(key, (F.col("_at") + 1).alias("place"), "term")


def capped(terms: DataFrame, shortfall: DataFrame) -> DataFrame:
    """At most max(25, min(80, 2 * shortfall)) terms of a user's own bank per market, in order of priority, ord and term.
    terms: market_id, priority, ord, term.  shortfall: market_id, shortfall."""
    ranked = first_n(terms, ["market_id"], ["priority", "ord", "term"], 80, rank="place")
    return ranked.join(shortfall, "market_id").where(F.col("place") <= F.greatest(F.lit(25), F.least(F.lit(80), 2 * F.col("shortfall")))).drop("shortfall")


def profile_query(name: Column) -> Column:
    return F.concat(F.lit('site:linkedin.com/in/ "'), name, F.lit('"'))


def address_query(first: Column, last: Column, domain: Column) -> Column:
    """The search for a person's address; NULL where a part is missing."""
    ok = (text(first) != "") & (text(last) != "") & (text(domain) != "")
    return F.when(ok, F.concat(F.lit('"'), first, F.lit(" "), last, F.lit('" "@'), domain, F.lit('"')))
