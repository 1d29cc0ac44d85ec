"""Column functions of the statistical graph: ids, dates, names, places. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Place types in order of dominance, the special ones first.
SPECIAL_TYPES = ["City", "County"]
TYPE_PRIORITY = ["Continent", "Country", "State", "County", "City", "Town", "Village", "Borough", "CensusZipCodeTabulationArea", "Supplier", "Customer", "Place"]


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, of a string's UTF-8 bytes, as a long."""
    data = F.hex(F.encode(text, "utf-8"))
    n = (F.length(data) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(data, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def facet_id(import_name: Column, method: Column, period: Column, scaling: Column, unit: Column, is_aggregate: Column | None = None) -> Column:
    """The decimal hash that names a facet."""
    key = F.concat_ws("-", *[F.coalesce(c, F.lit("")) for c in (import_name, method, period, scaling, unit)])
    if is_aggregate is not None:
        key = F.when(is_aggregate, F.concat(key, F.lit("-IsDcAggregate"))).otherwise(key)
    return fnv1a(key).cast("string")


def literal_id(value: Column) -> Column:
    """The id of a long literal: up to 16 bytes of it, cut between characters, and its digest."""
    prefix = F.aggregate(
        F.split(F.substring(value, 1, 16), ""), F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda a, c: F.struct(F.when(a["full"] | (F.octet_length(F.concat(a["s"], c)) > 16), a["s"]).otherwise(F.concat(a["s"], c)).alias("s"), (a["full"] | (F.octet_length(F.concat(a["s"], c)) > 16)).alias("full")),
        lambda a: a["s"],
    )
    return F.concat(prefix, F.lit(":"), F.base64(F.unhex(F.sha2(value, 256))))


def date_bounds(date: Column) -> Column:
    """struct(start, end) of the day, month or year that a date string names; null parts for other strings."""
    n = F.length(date)
    start = F.when(n == 4, F.try_to_date(F.concat(date, F.lit("-01-01")), "yyyy-MM-dd")).when(n == 7, F.try_to_date(F.concat(date, F.lit("-01")), "yyyy-MM-dd")).when(n == 10, F.try_to_date(date, "yyyy-MM-dd"))
    end = F.when(n == 4, F.date_sub(F.add_months(start, 12), 1)).when(n == 7, F.last_day(start)).otherwise(start)
    return F.struct(start.alias("start"), end.alias("end"))


def month_of(date: Column) -> Column:
    return F.substring(date, 1, 7)


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4)


def domain_of(url: Column) -> Column:
    """The last two labels of a URL's host; null where there is no host."""
    labels = F.split(F.try_parse_url(url, F.lit("HOST")), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def dominant_type(types: Column, special: list[str] = SPECIAL_TYPES, priority: list[str] = TYPE_PRIORITY) -> Column:
    """The first of the special types, else of the priority list, that a place has; empty if none."""
    order = F.array(*[F.lit(t) for t in [*special, *priority]])
    return F.coalesce(F.get(F.filter(order, lambda t: F.array_contains(types, t)), 0), F.lit(""))


def preferred_type(types: Column) -> Column:
    """The last type that replaces an empty, administrative or Place one, going through the list once."""
    weak = lambda t: (t == "") | t.startswith("AdministrativeArea") | (t == "Place")
    return F.aggregate(types, F.lit(""), lambda now, t: F.when(weak(now), t).otherwise(now))


def split_pascal(s: Column) -> Column:
    """Spaces between the words of a PascalCase name, at acronyms' ends, and between letters and digits."""
    for pattern, new in ((r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z])([A-Z][a-z])", "$1 $2"), (r"([A-Za-z])([0-9])", "$1 $2"), (r"([0-9])([A-Za-z])", "$1 $2")):
        s = F.regexp_replace(s, pattern, new)
    return s


def snake_to_camel(s: Column) -> Column:
    parts = F.split(s, "_")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000)))), "")


def camel_to_snake(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"(?<=.)([A-Z])", "_$1"))


def recon_name(s: Column) -> Column:
    """A name as it is compared: lower case, without commas and carets."""
    return F.trim(F.lower(F.regexp_replace(s, r" ,|,|\^", "")))


def complex_value_id(s: Column) -> Column:
    """The id of a bracketed quantity or range, such as [Years 10 20], [Years - 5], [Years 5 -], [5 Years]."""
    inner = F.regexp_extract(F.trim(s), r"^\[(.*)\]$", 1)
    p = F.filter(F.split(F.trim(inner), r"\s+"), lambda x: x != "")
    number = lambda x: x.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    unit = F.filter(p, lambda x: ~number(x) & (x != "-"))[0]
    rest = F.filter(p, lambda x: number(x) | (x == "-"))
    a, b = F.get(rest, 0), F.get(rest, 1)
    two = F.when((a == "-") & number(b), F.concat(unit, F.lit("Upto"), b)).when(number(a) & (b == "-"), F.concat(unit, a, F.lit("Onwards"))).when(number(a) & number(b), F.concat(unit, a, F.lit("To"), b))
    ok = F.size(F.filter(p, lambda x: ~number(x) & (x != "-"))) == 1
    return F.when(ok & (F.size(rest) == 1) & number(a), F.concat(unit, a)).when(ok & (F.size(rest) == 2), two)


def latlong_id(lat: Column, lng: Column) -> Column:
    e5 = lambda x: F.round(x * 1e5).cast("long").cast("string")
    return F.concat(F.lit("latLong/"), e5(lat), F.lit("_"), e5(lng))


def parse_latlong_id(s: Column) -> Column:
    parts = F.split(F.regexp_extract(s, r"^latLong/(-?[0-9]+_-?[0-9]+)$", 1), "_")
    number = lambda i: F.get(parts, i).try_cast("double") / 1e5
    return F.struct(number(0).alias("lat"), number(1).alias("lng"))


def magnitude(s: Column, unit: str) -> Column:
    """The number after a unit prefix; 0 where there is none."""
    return F.coalesce(F.trim(F.regexp_replace(s, f"^{unit}", "")).try_cast("double"), F.lit(0.0))


def grid_key(lat: Column, lng: Column, size: float) -> Column:
    """The south-west corner of the tile that holds a point, with one decimal."""
    corner = lambda x: F.format_string("%.1f", F.floor(x / size) * size)
    return F.concat(corner(lat), F.lit("^"), corner(lng))


def parse_coordinate(s: Column) -> Column:
    """struct(lat, lng) of ``lat#lng``; null unless there are two numbers."""
    parts = F.split(s, "#")
    lat, lng = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def tokenize(s: Column) -> Column:
    """Words apart at spaces; a comma is a token of its own."""
    return F.regexp_extract_all(s, F.lit(r"([^ ,]+|,)"), F.lit(1))


def word_ngrams(s: Column, longest: int = 10) -> Column:
    """All runs of one to ``longest`` words."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)), lambda n: F.array_join(F.slice(words, i + 1, n), " ")))
    return F.flatten(runs)


def split_by_span(query: Column, span: Column) -> Column:
    """The parts of a query around a whole-word span."""
    mark = F.lit("\u0001")
    around = F.concat(F.lit(" "), query, F.lit(" "))
    return F.filter(F.transform(F.split(F.replace(around, F.concat(F.lit(" "), span, F.lit(" ")), F.concat(F.lit(" "), mark, F.lit(" "))), "\u0001"), lambda p: F.trim(p)), lambda p: p != "")


def entity_kind(id_: Column) -> Column:
    """source, topic, group or place, by the prefix of an id."""
    source = id_.startswith("dc/s/") | id_.startswith("source/")
    group = id_.startswith("dc/g/") | id_.startswith("g/")
    return F.when(source, "source").when(id_.startswith("dc/topic/"), "topic").when(group, "group").otherwise("place")


def default_provenance(provenance: Column, import_name: Column) -> Column:
    """A series without a provenance id is named after its import."""
    empty = F.coalesce(provenance, F.lit("")) == ""
    return F.when(empty & (F.coalesce(import_name, F.lit("")) != ""), F.concat(F.lit("dc/base/"), import_name)).otherwise(provenance)


def host_ends_with(url: Column, domains: list[str]) -> Column:
    host = F.try_parse_url(url, F.lit("HOST"))
    return reduce(lambda a, b: a | b, [host.endswith(d) for d in domains], F.lit(False))
