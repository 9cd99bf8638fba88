"""Text expressions: figures, slugs, hosts, keys of names, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that stand for a withheld or missing figure.
CODES = ["SUPP", "NE", "NA", "LOWCOV", "NP", "NEW", "SP", "RE", "DNS", "NR", "X", "C", "Z", "U", "LOW", ":", "~", "..", "N/A", "N/S", "NULL", "[Z]", "[X]", "[C]", "[W]", "[U]", "REDACTED", "*", "#", "!", "-"]

#: Accented Latin letters and the letters they are written as.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def parse_value(c: Column) -> Column:
    """Struct (value, code): a figure without £, %, commas; a code of suppression as itself; other text as code ``?``; blank as nulls."""
    t = F.trim(c)
    figure = F.regexp_replace(t, "[£$%,\\s]", "").try_cast("double")
    code = F.when(F.upper(t).isin(CODES), F.upper(t)).when(t != "", F.when(figure.isNull(), F.lit("?")))
    return F.struct(F.when(~F.upper(t).isin(CODES), figure).alias("value"), code.alias("code"))


def human_number(c: Column) -> Column:
    """(1,234) as a negative, a unicode minus, k, m and bn at the end."""
    t = F.lower(F.regexp_replace(F.trim(c), "[£$,\\s]", ""))
    t = F.replace(t, F.lit("−"), F.lit("-"))
    negative = t.rlike(r"^\(.*\)$")
    t = F.regexp_replace(t, "[()]", "")
    unit = F.regexp_extract(t, r"(k|m|bn)$", 1)
    base = F.regexp_replace(t, r"(k|m|bn)$", "").try_cast("double")
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "bn", 1e9).otherwise(1.0)
    return base * scale * F.when(negative, -1.0).otherwise(1.0)


def slug(c: Column, most: int = 80, joiner: str = "-") -> Column:
    """Lower case without accents, & as and, other characters as one joiner, at most ``most`` characters."""
    t = F.translate(F.lower(c), *ACCENTS)
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", joiner)
    return F.regexp_replace(F.left(F.regexp_replace(t, f"^{joiner}+|{joiner}+$", ""), F.lit(most)), f"{joiner}+$", "")


def registrable_host(url: Column, second_level: tuple[str, ...] = ("co", "org", "ac", "sch", "gov")) -> Column:
    """The registrable domain of a web or mail address: two labels, or three under a known second level."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^[a-z]+://", ""), "^[^/]*@", "")
    h = F.regexp_replace(F.regexp_extract(h, r"^([a-z0-9.-]+)", 1), r"^www\.", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    take = F.when((n >= 3) & F.element_at(labels, -2).isin(*second_level), 3).otherwise(2)
    return F.when(h.contains("."), F.array_join(F.slice(labels, F.greatest(n - take + 1, F.lit(1)), take), "."))


def authority_key(c: Column) -> Column:
    """The name of an authority without its form: city of, county, borough, council and the like."""
    t = F.regexp_replace(F.lower(c), "&", " and ")
    t = F.regexp_replace(t, r"\b(london borough of|royal borough of|city of|county of|county council|county|borough council|borough|council|unitary authority|city)\b", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def shorten(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after a whole word, with an ellipsis."""
    cut = F.regexp_replace(F.left(c, F.lit(limit - 1)), r"\s+\S*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def full_stops(c: Column) -> Column:
    """Ligatures as letters, soft hyphens and zero-width characters gone."""
    t = F.replace(F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("ﬀ"), F.lit("ff"))
    return F.regexp_replace(t, "[\\u00ad\\u200b-\\u200d\\ufeff]", "")


def is_initialism(token: Column, name: Column) -> Column:
    """Whether the letters of a token occur in order in a name's letters."""
    letters = F.split(F.lower(token), "")
    pattern = F.array_join(F.filter(letters, lambda x: x.rlike("[a-z0-9]")), ".*")
    return F.when((token == "") | token.isNull(), F.lit(False)).otherwise(F.regexp_like(F.lower(name), pattern))


def year_label(start: Column, joiner: str = "-") -> Column:
    """2018 as 2018-19."""
    return F.concat(start.cast("string"), F.lit(joiner), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def label_of_month(period_end: Column, first_month: Column) -> Column:
    """The start year of the year that a period ending in YYYY-MM belongs to, for years that begin with ``first_month``."""
    y, m = F.substring(period_end, 1, 4).try_cast("int"), F.substring(period_end, 6, 2).try_cast("int")
    return F.when(m >= first_month, y).otherwise(y - 1)


def ratio(part: Column, whole: Column, scale: float = 100.0, digits: int = 2) -> Column:
    """part / whole, null where either is missing or the whole is 0."""
    return F.round(F.try_divide(part * scale, whole), digits)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def half_away(c: Column, digits: int = 0) -> Column:
    return F.round(c, digits)


def half_up(c: Column) -> Column:
    """To whole numbers, halves towards plus infinity."""
    return F.floor(c + 0.5)


def dotted(doc: Column, path: str, kind: str = "string") -> Column:
    """A value inside a JSON text by its dotted path; null where the text can't be read or holds nothing there."""
    return F.try_variant_get(F.try_parse_json(doc), "$." + path, kind)


def web_address(c: Column) -> Column:
    """A web address with scheme, lower-case host and no slash at the end; null for texts that hold no host."""
    t = F.trim(c)
    bare = F.regexp_replace(t, "(?i)^[a-z]+://", "")
    name = F.lower(F.regexp_extract(bare, "^([^/?#]+)", 1))
    rest = F.regexp_replace(F.regexp_replace(bare, "^[^/?#]+", ""), "/+$", "")
    scheme = F.when(t.rlike("(?i)^https://"), "https://").when(t.rlike("(?i)^http://"), "http://").otherwise("https://")
    return F.when(name.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), F.concat(scheme, name, rest))


def host_entitled(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or lies under one; null is not."""
    h = F.lower(host)
    hit = F.lit(False)
    for d in domains:
        hit = hit | (h == d) | h.endswith(f".{d}")
    return F.coalesce(hit, F.lit(False))


def first_json(text: Column) -> Column:
    """The first JSON object without nested ones inside a text, as text; null where none can be read."""
    found = F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def share_or_null(c: Column) -> Column:
    """A confidence: a finite number from 0 to 1, else null."""
    return F.when(c.between(0.0, 1.0), c)


def id_or_code(c: Column, codes: dict[str, str]) -> Column:
    """Struct (category, lead) of one messy column: a code of a small vocabulary, or a number of five to seven digits."""
    t = F.upper(F.trim(c))
    category = F.lit(None).cast("string")
    for code, name in codes.items():
        category = F.when(t == code, F.lit(name)).otherwise(category)
    lead = F.when(t.rlike(r"^\d{5,7}$"), t)
    return F.struct(F.when(lead.isNotNull(), F.lit("member")).otherwise(category).alias("category"), lead.alias("lead"))


def without_suffix(c: Column, suffixes: list[str]) -> Column:
    """A name without the first of the suffixes it ends in, in any case."""
    return F.trim(F.regexp_replace(c, r"(?i)[\s,]+(" + "|".join(suffixes) + r")\s*$", ""))


def dated_band(d: Column, starts: dict[str, str], before: str) -> Column:
    """The name of the band that a date lies in: the last of ``starts`` (name -> first day) that has begun."""
    out = F.lit(before)
    for name, start in sorted(starts.items(), key=lambda x: x[1]):
        out = F.when(d >= F.lit(start).cast("date"), F.lit(name)).otherwise(out)
    return F.when(d.isNotNull(), out)


def working_day(d: Column) -> Column:
    """A date, or the Monday after it where it is a Saturday or Sunday."""
    return F.when(F.dayofweek(d) == 7, F.date_add(d, 2)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)


def entry_year(birth: Column, age: int, first_month: int = 9) -> Column:
    """The year in which a child of a birth date starts the school year after turning ``age``."""
    return F.year(birth) + age + F.when(F.month(birth) >= first_month, 1).otherwise(0)


def odds_words(p: Column) -> Column:
    """A chance in words."""
    return (
        F.when(p >= 0.95, "almost certain").when(p >= 0.75, "likely").when(p >= 0.5, "more likely than not").when(p >= 0.25, "possible")
        .when(p > 0.05, "unlikely").when(p.isNotNull(), "very unlikely")
    )


def nice_step(top: Column, steps: int = 5) -> Column:
    """A step of 1, 2 or 5 times a power of ten that divides an axis up to ``top`` into at most ``steps`` parts."""
    raw = top / steps
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / power
    return power * F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 5, 5.0).otherwise(10.0)


def without_empty(m: Column) -> Column:
    """A map without null values; null where nothing stays."""
    kept = F.map_filter(m, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def code_between(c: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a code is a whole number inside one of the ranges; anything else is not."""
    n = F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).try_cast("int"))
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | n.between(lo, hi)
    return F.coalesce(hit, F.lit(False))
