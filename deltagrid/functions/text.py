"""Streets, addresses, numbers in tags, search and labels, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directions and street types with their postal abbreviations.
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
TYPES = {
    "STREET": "ST", "STR": "ST", "AVENUE": "AVE", "AV": "AVE", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "PLACE": "PL", "BOULEVARD": "BLVD",
    "TRAIL": "TRL", "TERRACE": "TER", "CIRCLE": "CIR", "WAY": "WAY", "HIGHWAY": "HWY", "PARKWAY": "PKWY", "LOOP": "LOOP", "POINT": "PT", "RIDGE": "RDG", "SQUARE": "SQ",
    "CROSSING": "XING", "EXPRESSWAY": "EXPY", "FREEWAY": "FWY", "ALLEY": "ALY", "COVE": "CV", "HEIGHTS": "HTS", "HILL": "HL", "RUN": "RUN", "PATH": "PATH", "PIKE": "PIKE",
    "ROW": "ROW", "VIEW": "VW", "VISTA": "VIS", "WALK": "WALK", "ESTATES": "ESTS", "MEADOWS": "MDWS", "GLEN": "GLN", "GROVE": "GRV", "HOLLOW": "HOLW", "BEND": "BND",
}


def _short(table: dict[str, str]) -> Column:
    """Long and short forms to the short one, as a map literal."""
    return F.create_map(*[F.lit(x) for k, v in ({v: v for v in table.values()} | table).items() for x in (k, v)])


def street_words(name: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]", " "), " "), "")


def street_normal(name: Column) -> Column:
    """Upper case, a direction shortened at either end, a street type at the end of two words or more."""
    w = street_words(name)
    return F.array_join(
        F.transform(
            w,
            lambda x, i: F.coalesce(
                F.when((i == 0) | (i == F.size(w) - 1), F.try_element_at(_short(DIRECTIONS), x)),
                F.when((i == F.size(w) - 1) & (F.size(w) > 1), F.try_element_at(_short(TYPES), x)),
                x,
            ),
        ),
        " ",
    )


def _bound(step, which: Column, head: bool):
    return lambda w: step(w, which, head)


def street_base(name: Column) -> Column:
    """The normal form without directions at the ends and the type at its end, as long as a word is left."""
    parts = F.array_remove(F.split(street_normal(name), " "), "")
    ways, kinds = F.array(*map(F.lit, DIRECTIONS.values())), F.array_distinct(F.array(*map(F.lit, TYPES.values())))

    def drop(w: Column, which: Column, head: bool) -> Column:
        edge = F.get(w, F.lit(0)) if head else F.get(w, F.size(w) - 1)
        rest = F.slice(w, F.lit(2), F.size(w) - 1) if head else F.slice(w, F.lit(1), F.size(w) - 1)
        return F.when((F.size(w) > 1) & F.array_contains(which, edge), rest).otherwise(w)

    # one step after another over a one-element array, so that each result is named once
    steps = F.array(parts)
    for which, head in ((ways, True), (ways, False), (kinds, False)):
        steps = F.transform(steps, _bound(drop, which, head))
    return F.array_join(F.get(steps, F.lit(0)), " ")


def house_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\d{1,9})", 1).try_cast("int")


def typed_address(text: Column) -> Column:
    """(number, street, zip) of an address as typed, or null: a number first (no '.' or '-' in it), a ZIP last if there is one, and between them a street whose first word has a letter."""
    words = F.array_remove(F.split(F.regexp_replace(F.trim(text), ",", " "), r"\s+"), "")
    first, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    zipped = (F.size(words) > 2) & last.rlike(r"^\d{5}(-\d{4})?$")
    street = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1 - zipped.cast("int"), F.lit(0)))
    good = first.rlike(r"^\d") & ~first.rlike(r"[.\-]") & F.get(street, F.lit(0)).rlike(r"\p{L}")
    return F.when(good, F.struct(house_number(first).alias("number"), F.array_join(street, " ").alias("street"), F.when(zipped, F.substring(last, 1, 5).cast("int")).alias("zip")))


def speed_kmh(text: Column) -> Column:
    """The first of a list; miles an hour converted; 0 for what is no number."""
    first = F.trim(F.get(F.split(text, ";"), F.lit(0)))
    mph = first.rlike("mph$")
    number = F.trim(F.regexp_replace(first, "(mph|(km/h)+)$", "")).try_cast("double")
    return F.least(F.greatest(F.coalesce(F.round(F.when(mph, number * 1.609344).otherwise(number)), F.lit(0.0)), F.lit(0.0)), F.lit(255.0)).cast("int")


def elevation_m(text: Column) -> Column:
    t = F.regexp_replace(F.trim(text), ",", "")
    feet = t.rlike("(ft|')$")
    number = F.trim(F.regexp_replace(t, "(ft|'|m+)$", "")).try_cast("double")
    return F.when(feet, number * 0.3048).otherwise(number)


def population(text: Column) -> Column:
    return F.regexp_replace(text, "[, ]", "").try_cast("bigint")


def max_number(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, ";"), lambda x: F.trim(x).try_cast("double")))


def fit(query: Column, text: Column) -> Column:
    """0 equal, 1 at the start, 2 at a word's start, 3 inside; null for none or an empty query. Only the first place it occurs counts."""
    q, t = F.lower(query), F.lower(text)
    at = F.call_function("locate", q, t)
    before = F.substr(t, at - 1, F.lit(1))
    return F.when(q == "", None).when(t == q, 0).when(at == 1, 1).when((at > 1) & ~before.rlike(r"[\p{L}\p{N}]"), 2).when(at > 1, 3)


def label(kind: Column, name: Column, reference: Column, exit_kind: int = 77) -> Column:
    """An exit's number before its name; a point's name; else the name with its reference unless it holds it already, or the one of them there is."""
    held = (reference == "") | name.contains(reference)
    return F.when(kind == exit_kind, F.trim(F.concat_ws(" ", reference, name))).when((kind >= 64) & (name != ""), name).when(name == "", reference).when(held, name).otherwise(F.concat(name, F.lit(" ("), reference, F.lit(")")))


def one_decimal(x: Column) -> Column:
    """A number from 0 up with one decimal; the exact binary value decides, and of two equally near the even one is taken."""
    f = F.floor(x * 10)
    high = F.floor(x * (1 << 20)) / (1 << 20)
    over = (20 * high - (2 * f + 1)) + 20 * (x - high)
    tenths = f + F.when((over > 0) | ((over == 0) & (f % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def rounded_length(m: Column) -> Column:
    """Metres in tens, from 100 in fifties, from 1 km in kilometres with a decimal."""
    metres = lambda step: F.concat((F.round(m / step) * step).cast("int").cast("string"), F.lit(" m"))
    return F.when(m < 100, metres(10)).when(m < 1000, metres(50)).otherwise(F.concat(one_decimal(m / 1000), F.lit(" km")))


def duration(seconds: Column) -> Column:
    """Minutes; from an hour hours and minutes of two digits."""
    minutes = F.round(seconds / 60).cast("int")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min")))


def short_hash(data: Column) -> Column:
    """The first 16 bytes of a content hash, in hex."""
    return F.substring(F.sha2(data.cast("binary"), 256), 1, 32)


def version(text: Column) -> Column:
    """Three numbers that compare as a struct, what follows a plus sign left out; null for any other form."""
    core = F.substring_index(text, "+", 1)
    parts = F.split(core, r"\.")
    v = F.struct(*(F.get(parts, F.lit(i)).try_cast("bigint").alias(n) for i, n in enumerate(("major", "minor", "patch"))))
    return F.when(core.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$") & v["major"].isNotNull() & v["minor"].isNotNull() & v["patch"].isNotNull(), v)


def unix_ms(time: Column) -> Column:
    return F.unix_millis(time)


def from_unix_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)
