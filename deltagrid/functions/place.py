"""Coordinates as people type them: decimal degrees, degrees and minutes, or minutes and seconds; hemispheres as letters or words before or after, or signs; marks, letters or nothing between the parts; a comma, slash, semicolon or space between the two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"\d[\d.]*|\.\d[\d.]*|[-+][\d.][\d.]*"
#: Before a run of letters that follows something without a space.
_GLUE = "\x01"
_ITEM = rf"(?:{_NUMBER})|{_GLUE}?\p{{L}}+|[,/;]"
_WORDS = ("n", "s", "e", "w", "north", "south", "east", "west")
_PARTS = "array<struct<v:double,minus:boolean>>"
_GROUP = f"struct<parts:{_PARTS},side:string>"


def _spelled(text: Column) -> Column:
    """Lower case, with d, m and s for the marks of degrees, minutes and seconds and for their short words."""
    t = F.translate(F.lower(F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))), "°′'’″\"”", "dmmmsss")
    for word in ("deg", "min", "sec"):
        t = F.replace(t, F.lit(word), F.lit(word[0]))
    return F.regexp_replace(t, r"(?<=[^\s\p{L}])(\p{L}+)", f"{_GLUE}$1")


def _items(t: Column) -> Column:
    """The numbers, separators, hemisphere words and single letters of a text, in order: (kind, text, glued)."""

    def letters(word: Column) -> Column:
        run, glued = F.replace(word, F.lit(_GLUE), F.lit("")), word.startswith(_GLUE)
        one = F.transform(F.split(run, ""), lambda c, k: F.struct(F.lit("l").alias("kind"), c.alias("text"), (glued | (k > 0)).alias("glued")))
        return F.when(run.isin(*_WORDS), F.array(F.struct(F.lit("l").alias("kind"), run.alias("text"), glued.alias("glued")))).otherwise(F.filter(one, lambda x: x["text"] != ""))

    def item(token: Column) -> Column:
        plain = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), token.alias("text"), F.lit(False).alias("glued")))
        return F.when(token.rlike(r"\p{L}"), letters(token)).when(token.rlike(r"\d|\."), plain("n")).otherwise(plain(","))

    return F.flatten(F.transform(F.regexp_extract_all(t, F.lit(f"({_ITEM})"), 1), item))


def _group(parts: Column, side: Column) -> Column:
    return F.struct(parts.alias("parts"), side.alias("side"))


def _groups(items: Column) -> Column:
    """(done, open, good): numbers by coordinate with the hemisphere that closes or opens them. A fourth number begins the next one; s right after a third number is seconds, else south."""
    none = F.lit(None).cast(_GROUP)
    state = lambda done, now, good: F.struct(done.alias("done"), now.alias("open"), good.alias("good"))
    begin = state(F.array().cast(f"array<{_GROUP}>"), none, F.lit(True))

    def step(s: Column, i: Column) -> Column:
        now, held = s["open"], F.coalesce(F.size(s["open"]["parts"]), F.lit(0))
        shut = F.when(now.isNull(), s["done"]).otherwise(F.array_append(s["done"], now))
        text = i["text"]
        number = F.regexp_replace(text, "^[-+]", "").try_cast("double")
        part = F.struct(number.alias("v"), text.startswith("-").alias("minus"))
        full, empty = held == 3, F.array().cast(_PARTS)
        counted = state(
            F.when(full, shut).otherwise(s["done"]),
            _group(F.array_append(F.when(full | now.isNull(), empty).otherwise(now["parts"]), part), F.when(full, F.lit(None).cast("string")).otherwise(now["side"])),
            s["good"] & number.isNotNull(),
        )
        side, mark = text.isin(*_WORDS), text.isin("d", "m") | ((text == "s") & i["glued"] & full)
        closes = (held > 0) & side & now["side"].isNull()
        lettered = (
            F.when((held > 0) & mark, s)
            .when(closes, state(F.array_append(s["done"], _group(now["parts"], F.substring(text, 1, 1))), none, s["good"]))
            .when(side, state(shut, _group(empty, F.substring(text, 1, 1)), s["good"]))
            .when(text.isin("d", "m", "s"), s)
            .otherwise(state(s["done"], now, F.lit(False)))
        )
        return F.when(i["kind"] == "n", counted).when(i["kind"] == "l", lettered).otherwise(state(shut, none, s["good"]))

    return F.aggregate(items, begin, step, lambda s: F.struct(F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])).alias("groups"), s["good"].alias("good")))


def _degrees(g: Column) -> Column:
    """The value of one to three numbers, the later ones without a minus and below 60; a minus and a southern or western letter cancel."""
    parts, first = g["parts"], F.get(g["parts"], F.lit(0))
    right = F.size(parts).between(1, 3) & F.forall(F.slice(parts, 2, 3), lambda p: ~p["minus"] & (p["v"] >= 0) & (p["v"] < 60))
    value = F.aggregate(F.transform(parts, lambda p, k: p["v"] / F.pow(F.lit(60.0), k)), F.lit(0.0), lambda a, x: a + x)
    return F.when(right, F.when(first["minus"] != F.coalesce(g["side"].isin("s", "w"), F.lit(False)), -value).otherwise(value))


def typed_place(text: Column) -> Column:
    """(lat, lon) of a text, or null if it is no place."""
    t = _spelled(text)
    plain = F.regexp_replace(t, rf"(?:{_NUMBER})|\p{{L}}+|[,/;\s{_GLUE}+-]", "") == ""

    def place(found: Column) -> Column:
        gs = found["groups"]
        only, n = F.get(gs, F.lit(0)), F.size(F.get(gs, F.lit(0))["parts"])
        bare = lambda parts: _group(parts, F.lit(None).cast("string"))
        shared = F.when((n > 0) & (n % 2 == 0), F.array(bare(F.slice(only["parts"], F.lit(1), (n / 2).cast("int"))), bare(F.slice(only["parts"], (n / 2).cast("int") + 1, n))))
        two = F.when((F.size(gs) == 1) & only["side"].isNull(), shared).when(F.size(gs) == 2, gs)
        a, b = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        # the latitude is the one lettered n or s, else the first
        swap = F.coalesce(a["side"].isin("e", "w"), F.lit(False)) | F.coalesce(b["side"].isin("n", "s"), F.lit(False))
        lat, lon = (F.when(swap, _degrees(p)).otherwise(_degrees(q)) for p, q in ((b, a), (a, b)))
        return F.when(found["good"] & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon")))

    return F.when(plain, F.get(F.transform(F.array(_groups(_items(t))), place), F.lit(0)))
