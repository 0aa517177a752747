"""Classes of ways, areas, points, owners and travel from tags (MAP<STRING, STRING>), as Columns.

Tag order has no meaning here: where several keys could decide, their order is pinned as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line classes (id: name, width in metres, default uses, magnitude, coarsest depth drawn, coarsest depth routed, car speed).
LINES = {
    1: ("motorway", 28.0, 80, 1.0, 0, 8, 105), 2: ("trunk", 20.0, 19, 0.85, 2, 8, 90), 3: ("primary", 14.0, 19, 0.7, 4, 8, 70), 4: ("secondary", 11.0, 19, 0.6, 6, 9, 60),
    5: ("tertiary", 9.0, 19, 0.5, 7, 10, 50), 6: ("residential", 7.0, 19, 0.35, 9, 12, 40), 7: ("service", 4.0, 19, 0.25, 10, 13, 20), 8: ("track", 3.0, 55, 0.2, 9, 11, 20), 9: ("path", 1.5, 3, 0.15, 9, 11, None),
    10: ("rail", 4.0, 0, 0.5, 4, None, None), 11: ("power", 2.0, 0, 0.3, 8, None, None), 12: ("waterway", None, 0, 0.0, None, None, None), 13: ("national park", 6.0, 0, 0.9, 5, None, None), 14: ("wilderness", 6.0, 0, 0.8, 5, None, None),
    15: ("national forest", 6.0, 0, 0.7, 5, None, None), 16: ("protected", 5.0, 0, 0.5, 5, None, None), 17: ("admin", 8.0, 0, 1.0, 3, None, None), 18: ("ferry", 6.0, 19, 0.4, 6, 8, None), 19: ("aerialway", 3.0, 0, 0.3, 9, None, None),
    20: ("ridge", 4.0, 0, 0.3, 9, None, None), 21: ("cliff", 3.0, 0, 0.3, 10, None, None),
}
FOOT, BIKE, HORSE, SKI, MOTOR, UNPAVED, FREEWAY, RESTRICTED = (1 << i for i in range(8))
# Which tag value makes which line class, in order of precedence.
WAYS = [
    ("highway", {1: "motorway motorway_link", 2: "trunk trunk_link", 3: "primary primary_link", 4: "secondary secondary_link", 5: "tertiary tertiary_link", 6: "residential unclassified living_street", 7: "service", 8: "track", 9: "path footway cycleway bridleway steps"}),
    ("waterway", {12: "river stream canal ditch drain"}),
    ("railway", {10: "rail light_rail narrow_gauge preserved"}),
    ("power", {11: "line minor_line"}),
    ("route", {18: "ferry"}),
    ("aerialway", {19: "cable_car gondola mixed_lift chair_lift drag_lift t-bar j-bar platter rope_tow magic_carpet"}),
    ("natural", {20: "ridge arete", 21: "cliff"}),
]
# Area classes; the highest that matches wins.
AREAS = {
    1: {"natural": "grassland", "landuse": "grass meadow recreation_ground cemetery", "leisure": "park golf_course pitch"}, 2: {"landuse": "farmland farmyard"}, 3: {"landuse": "orchard vineyard"}, 4: {"natural": "scrub heath"},
    5: {"natural": "wood", "landuse": "forest"}, 6: {"natural": "wetland mud"}, 7: {"natural": "sand beach shoal"}, 8: {"natural": "bare_rock scree shingle"}, 9: {"natural": "glacier"}, 10: {"landuse": "quarry"},
    11: {"landuse": "industrial railway military"}, 12: {"landuse": "residential commercial retail"}, 13: {"natural": "water bay strait", "landuse": "reservoir basin"},
}
# Owners by manager, then by the manager's type.
OWNERS = {"Forest Service": 1, "Bureau of Land Management": 2, "National Park Service": 3, "U.S. Fish and Wildlife Service": 4, "State Department of Natural Resources": 6, "State Land Board": 6, "Other or Unknown State Land": 6, "State Park and Recreation": 7, "State Fish and Wildlife": 8, "Tribal": 9, "Non-Governmental Organization": 11}
OWNER_TYPES = {"Federal": 5, "State": 6, "American Indian Lands": 9, "Tribal": 9, "Local Government": 10, "Regional Agency Special District": 10, "Non-Governmental Organization": 11, "Private": 11}
# Hiking difficulty and roughness.
DIFFICULTY = {"hiking": 1, "mountain_hiking": 2, "demanding_mountain_hiking": 3, "alpine_hiking": 4, "demanding_alpine_hiking": 5, "difficult_alpine_hiking": 6}
ROUGH = {"surface": {1: "gravel fine_gravel compacted unpaved dirt ground earth grass pebblestone", 2: "rock mud sand stone rocks"}, "tracktype": {1: "grade2", 2: "grade3 grade4", 3: "grade5"}, "smoothness": {1: "bad", 2: "very_bad", 3: "horrible very_horrible impassable"}}
UNPAVED_SURFACES = "gravel dirt ground unpaved compacted fine_gravel sand grass earth mud rock pebblestone wood"
PAVED_SURFACES = "asphalt paved concrete paving_stones"
# Land-cover bytes to (land class, whether water).
LAND_COVER = {10: 5, 20: 4, 30: 1, 40: 2, 50: 12, 60: 8, 70: 9, 80: 13, 90: 6, 95: 6, 100: 1}


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _cases(value: Column, table: dict[int, str]) -> Column:
    out = F.lit(None).cast("int")
    for k, names in table.items():
        out = F.when(value.isin(*names.split()), k).otherwise(out)
    return out


def way_class(tags: Column) -> Column:
    """The line class of a way: the first classifying key; then a border."""
    return F.coalesce(*(_cases(tag(tags, k), t) for k, t in WAYS), border_class(tags))


def border_class(tags: Column) -> Column:
    boundary, level = tag(tags, "boundary"), tag(tags, "admin_level")
    return F.when((boundary == "territorial") | ((boundary == "administrative") & level.isin("2", "4", "6") & (F.coalesce(tag(tags, "maritime"), F.lit("no")) != "yes")), 17)


def boundary_class(tags: Column) -> Column:
    """Of a boundary relation."""
    b, p = tag(tags, "boundary"), F.coalesce(tag(tags, "protect_class"), F.lit(""))
    forest = F.lower(F.coalesce(tag(tags, "operator"), F.lit(""))).contains("forest service")
    protected = F.when(p.isin("1", "1a", "1b"), 14).when(p == "2", 13).when((p == "6") | forest, 15).otherwise(16)
    admin = F.when(tag(tags, "admin_level").try_cast("int").isin(2, 4, 6), 17)
    return F.when(b == "national_park", 13).when(b == "protected_area", protected).when(b == "administrative", admin).when(tag(tags, "leisure") == "nature_reserve", 16)


def area_class(tags: Column) -> Column:
    found = [F.when(tag(tags, k).isin(*names.split()), c) for c, keys in AREAS.items() for k, names in keys.items()]
    return F.when(F.coalesce(tag(tags, "area"), F.lit("")) != "no", F.greatest(*found))


def lookup(value: Column, table: dict, default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)
    return found if default is None else F.coalesce(found, default)


def width_m(cls: Column, weight: Column) -> Column:
    return F.when(cls == 12, 1.5 + 18 * weight * weight * weight).otherwise(lookup(cls, {k: v[1] for k, v in LINES.items() if v[1] is not None}))


def cov_max(cls: Column, weight: Column) -> Column:
    return F.when(cls == 12, (120 + 135 * weight).cast("int")).otherwise(255)


def mag_byte(weight: Column) -> Column:
    return 1 + (F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)) * 254).cast("int")


def uses(cls: Column, tags: Column) -> Column:
    """Use bits: the class's own, then each tag's edit in the order foot, bicycle, horse, ski, motor vehicle, highway, surface, tracktype, access."""
    t = lambda k: F.coalesce(tag(tags, k), F.lit(""))
    no, yes = lambda v: v.isin("no", "private", "discouraged"), lambda v: v.isin("yes", "designated", "permissive", "official")
    add, drop = F.lit(0), F.lit(0)
    edits = [
        (FOOT, yes(t("foot")), no(t("foot"))),
        (BIKE, yes(t("bicycle")) | (t("highway") == "cycleway"), no(t("bicycle")) | t("highway").isin("footway", "steps")),
        (HORSE, yes(t("horse")) | (t("highway") == "bridleway"), no(t("horse"))),
        (SKI, yes(t("ski")) | (t("piste:type") != ""), F.lit(False)),
        (MOTOR, F.lit(False), no(t("motor_vehicle")) | no(t("motorcar"))),
        (UNPAVED, t("surface").isin(*UNPAVED_SURFACES.split()) | ~t("tracktype").isin("", "grade1"), t("surface").isin(*PAVED_SURFACES.split())),
        (RESTRICTED, no(t("access")) | ~t("seasonal").isin("", "no") | (t("barrier") == "gate"), F.lit(False)),
    ]
    for bit, plus, minus in edits:
        add, drop = add.bitwiseOR(F.when(plus, bit).otherwise(0)), drop.bitwiseOR(F.when(minus & ~plus, bit).otherwise(0))
    own = lookup(cls, {k: v[2] for k, v in LINES.items()}, F.lit(0))
    return own.bitwiseAND(F.bitwise_not(drop)).bitwiseOR(add)


def magnitude(cls: Column, tags: Column) -> Column:
    """The class's own, a power line's by its highest voltage, a railway's by usage; lanes blended in for roads."""
    volts = F.array_max(F.transform(F.split(tag(tags, "voltage"), ";"), lambda x: F.trim(x).try_cast("double")))
    own = F.coalesce(
        F.when((cls == 11) & volts.isNotNull(), F.least(F.greatest((F.log10(F.greatest(volts, F.lit(400.0))) - 2.6) / 3.3, F.lit(0.0)), F.lit(1.0))),
        F.when((cls == 10) & tag(tags, "usage").isNotNull(), F.when(tag(tags, "usage") == "main", 1.0).when(tag(tags, "usage") == "branch", 0.6).when(tag(tags, "usage").isin("industrial", "military"), 0.4).otherwise(0.3)),
        lookup(cls, {k: v[3] for k, v in LINES.items()}),
    )
    lanes = F.get(F.split(tag(tags, "lanes"), ";"), F.lit(0)).try_cast("double")
    blended = F.least(F.greatest(own * 0.6 + F.log2(F.least(F.greatest(lanes, F.lit(1.0)), F.lit(8.0))) / 3 * 0.4, F.lit(0.0)), F.lit(1.0))
    return F.when(lanes.isNotNull() & ~cls.isin(10, 11, 12), blended).otherwise(own)


def travel(cls: Column, tags: Column) -> Column:
    """(speed_kmh, oneway, layer, difficulty, rough) of a way."""
    from .text import speed_kmh

    t = lambda k: F.coalesce(tag(tags, k), F.lit(""))
    oneway = F.when(t("oneway") == "", F.when(cls == 1, 1).otherwise(0)).when(t("oneway").isin("yes", "true", "1"), 1).when(t("oneway").isin("-1", "reverse"), -1).otherwise(0)
    oneway = F.when(t("junction").isin("roundabout", "circular"), F.greatest(oneway, F.lit(1))).otherwise(oneway)
    flag = lambda k: ~t(k).isin("", "no")
    layer = F.coalesce(F.trim(tag(tags, "layer")).try_cast("int"), F.when(flag("bridge"), 1).when(flag("tunnel"), -1).otherwise(0))
    rough = F.greatest(*(F.coalesce(_cases(tag(tags, k), v), F.lit(0)) for k, v in ROUGH.items()))
    speed = F.when(tag(tags, "maxspeed").isNotNull(), speed_kmh(tag(tags, "maxspeed"))).when(cls == 18, 20).otherwise(0)
    return F.struct(speed.alias("speed_kmh"), oneway.alias("oneway"), F.least(F.greatest(layer, F.lit(-5)), F.lit(5)).alias("layer"), lookup(t("sac_scale"), DIFFICULTY, F.lit(0)).alias("difficulty"), rough.alias("rough"))


def routable(cls: Column) -> Column:
    return (cls <= 9) | (cls == 18)


def grade(difficulty: Column, rough: Column) -> Column:
    return F.least(difficulty, F.lit(15)).bitwiseOR(F.shiftleft(F.least(rough, F.lit(15)), 4))


def travel_speed(mode: str, cls: Column, use: Column, speed: Column, grade: Column) -> Column:
    """Metres a second on a way by car, bike or foot; null where that way of travelling may not go."""
    hard, rough = grade.bitwiseAND(15), F.least(F.shiftright(grade, 4), F.lit(3))
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), rough)
    has = lambda bit: use.bitwiseAND(bit) != 0
    if mode == "car":
        own = F.when(speed > 0, speed.cast("double")).otherwise(lookup(cls, {k: float(v[6]) for k, v in LINES.items() if v[6]}, F.lit(20.0)))
        kmh = F.when(has(MOTOR), own * F.when(has(UNPAVED), 0.6).otherwise(1.0) * F.when(has(RESTRICTED), 0.2).otherwise(1.0) * pick(1.0, 0.8, 0.5, 0.15))
    elif mode == "bike":
        kmh = F.when(has(BIKE) & (hard < 4), F.when(hard == 3, 5.0).otherwise(F.when(has(UNPAVED) | (cls >= 8), 12.0).otherwise(18.0) * pick(1.0, 0.9, 0.6, 0.4)))
    else:
        kmh = F.when(has(FOOT), F.get(F.array(*map(F.lit, (4.8, 4.8, 4.0, 3.0, 2.0, 1.5, 1.0))), F.least(hard, F.lit(6))))
    return F.when(cls == 18, F.when(speed > 0, speed.cast("double")).otherwise(20.0)).otherwise(kmh) / 3.6


def owner_class(manager: Column, kind: Column) -> Column:
    return F.coalesce(lookup(manager, OWNERS), lookup(kind, OWNER_TYPES), F.lit(12))


def motor_use_class(symbol: Column, kind: Column, seasonal: Column) -> Column:
    """Odd for all year, one more if seasonal."""
    s = F.lower(symbol)
    base = F.when(s.contains("special designation"), 13).when(s.startswith("roads open to highway legal"), 1).when(s.startswith("roads open to all"), 3).when(s.startswith("trails open to all"), 5).when(s.contains("motorcycle"), 9).when(s.contains('50" or less') | s.contains("<50"), 7).when(kind == "road", 3).otherwise(11)
    return base + (s.contains("seasonal") | (F.lower(seasonal) == "seasonal")).cast("int")


def line_min_depth(cls: Column, mag: Column) -> Column:
    """The coarsest depth at which a line shows; a river's by its magnitude."""
    return F.when(cls == 12, F.when(mag >= 200, 0).when(mag >= 128, 3).when(mag >= 64, 6).otherwise(8)).otherwise(lookup(cls, {k: v[4] for k, v in LINES.items() if v[4] is not None}))


def class_floor(cls: Column) -> Column:
    """The coarsest depth at which a way stays in the route pyramid; 14 for those that route at the base only."""
    return lookup(cls, {k: v[5] for k, v in LINES.items() if v[5] is not None}, F.lit(14))


# Point kinds (64 + place in the list) and the tags that make them; the first four overrule, the rest apply in this order.
POINTS = {
    64: {"place": "city"}, 65: {"place": "town"}, 66: {"place": "village"}, 67: {"place": "hamlet"}, 68: {"natural": "peak"}, 69: {"natural": "volcano"},
    77: {"highway": "motorway_junction"}, 78: {"place": "island"}, 79: {"place": "islet"}, 80: {"natural": "bay"}, 81: {"natural": "strait"}, 82: {"place": "sea ocean"}, 83: {"natural": "cape peninsula"}, 84: {"place": "suburb quarter neighbourhood"}, 85: {"place": "locality"},
    86: {"amenity": "drinking_water", "man_made": "drinking_fountain"}, 87: {"amenity": "toilets"}, 88: {"amenity": "shelter"}, 89: {"amenity": "ranger_station"}, 90: {"man_made": "fire_lookout"}, 91: {"natural": "hot_spring", "leisure": "hot_spring"}, 92: {"natural": "cave_entrance"}, 93: {"barrier": "gate lift_gate"}, 94: {"ford": "yes stepping_stones"},
    70: {"natural": "saddle", "mountain_pass": "yes"}, 71: {"tourism": "viewpoint"}, 72: {"highway": "trailhead"}, 73: {"waterway": "waterfall", "natural": "waterfall"}, 74: {"natural": "spring"}, 75: {"tourism": "camp_site"}, 76: {"tourism": "alpine_hut wilderness_hut"},
}
# Businesses (95 is the first), and amenities that are none.
BUSINESSES = {
    95: {"amenity": "cafe"}, 96: {"amenity": "restaurant"}, 97: {"amenity": "fast_food food_court ice_cream"}, 98: {"amenity": "bar pub biergarten nightclub"}, 99: {"amenity": "fuel charging_station"}, 100: {"shop": "supermarket convenience greengrocer bakery butcher deli grocery health_food"},
    102: {"tourism": "hotel motel hostel guest_house apartment chalet"}, 103: {"amenity": "bank atm bureau_de_change"}, 104: {"amenity": "pharmacy", "shop": "chemist"}, 105: {"amenity": "hospital clinic doctors dentist veterinary"}, 106: {"amenity": "post_office"}, 107: {"amenity": "library"}, 108: {"amenity": "school college university kindergarten"}, 109: {"amenity": "place_of_worship"},
}
NO_BUSINESS = "parking parking_space parking_entrance bicycle_parking bench waste_basket waste_disposal recycling vending_machine post_box telephone loading_dock motorcycle_parking grave_yard fountain clock hunting_stand bbq drinking_water toilets shelter ranger_station"


def _matches(tags: Column, keys: dict[str, str]) -> Column:
    hit = F.lit(False)
    for k, names in keys.items():
        hit = hit | F.coalesce(tag(tags, k).isin(*names.split()), F.lit(False))
    return hit


def business(tags: Column) -> Column:
    """The lowest kind of business that a feature's tags make it, else the general one, else null."""
    t = lambda k: F.coalesce(tag(tags, k), F.lit(""))
    shop = F.when((t("shop") != "") & ~_matches(tags, {"shop": BUSINESSES[100]["shop"] + " chemist"}), 101)
    seen = F.when(t("tourism").isin("museum", "attraction", "zoo", "aquarium", "theme_park", "gallery"), 110)
    found = F.least(*(F.when(_matches(tags, m), k) for k, m in BUSINESSES.items()), F.when(t("healthcare") != "", 105))
    other = ((t("amenity") != "") & ~t("amenity").isin(*NO_BUSINESS.split())) | (t("office") != "") | (t("craft") != "") | t("leisure").isin("fitness_centre", "sports_centre", "bowling_alley", "golf_course", "marina")
    return F.coalesce(F.least(found, shop, seen), F.when(other, 111))


def point_kind(tags: Column) -> Column:
    """(kind, rank) of a node: settlements and summits first, then the others in order; a tower only where it is for looking out."""
    from .text import elevation_m, population

    tower = F.when((tag(tags, "man_made") == "tower") & tag(tags, "tower:type").isin("observation", "fire_lookout"), 90)
    kind = F.coalesce(*(F.when(_matches(tags, m), k) for k, m in POINTS.items()), tower)
    people, ele = population(tag(tags, "population")), F.greatest(elevation_m(tag(tags, "ele")), F.lit(0.0))
    height = lambda times: F.coalesce(F.floor(ele * times), F.lit(0))
    rank = F.when(kind == 64, F.coalesce(people, F.lit(100_000))).when(kind == 65, F.coalesce(people, F.lit(10_000))).when(kind == 66, F.coalesce(people, F.lit(1_000))).when(kind == 67, F.coalesce(people, F.lit(100)))
    rank = rank.when(kind.isin(68, 69), height(25)).when(kind == 70, height(2)).when(kind == 73, 50).when(kind == 82, 10_000_000).when(kind.isin(80, 81), 100_000).when(kind == 78, 50_000).when(kind == 84, F.coalesce(people, F.lit(5_000))).when(kind == 90, F.greatest(height(1), F.lit(20))).otherwise(10)
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), rank).alias("rank"))


# Kinds marked with or without a name, and their words.
MARKED = {77: "Exit", 86: "Drinking water", 87: "Toilets", 88: "Shelter", 89: "Ranger station", 90: "Lookout", 91: "Hot spring", 92: "Cave", 93: "Gate", 94: "Ford"}
# The kind that a closed outline names.
OUTLINES = {78: {"place": "island"}, 79: {"place": "islet"}, 83: {"natural": "cape peninsula"}, 85: {"place": "locality"}}
# Who is lettered first, lower first; by kind.
TIERS = {0: (64, 65), 1: (68, 69), 2: (44, 78, 80, 81, 82), 3: (1, 2, 3), 4: (12,), 5: (66, 67, 84), 6: (4, 5, 8, 9, 13, 14, 15, 16, 17, 18, 20), 7: (6, 7, 10, 77), 8: (79, 83, 85, 19, 21)}
# Kilometres an hour at most, and seconds a turn costs.
MODES = {"car": (130.0, 4.0), "bike": (30.0, 2.0), "foot": (6.0, 0.0)}


def outline_kind(tags: Column) -> Column:
    """The kind of a closed outline: island, islet, cape or locality, else the business drawn there."""
    return F.coalesce(*(F.when(_matches(tags, m), k) for k, m in OUTLINES.items()), business(tags))


def marks_unnamed(kind: Column) -> Column:
    return kind.isin(*MARKED)


def _list(text: Column, keep_empty: bool) -> Column:
    parts = F.transform(F.split(text, ";"), lambda x: F.trim(x))
    return F.array_join(parts if keep_empty else F.filter(parts, lambda x: x != ""), ", ")


def feature_names(tags: Column) -> Column:
    """(name, reference); an unnamed ramp goes by where it leads."""
    t = lambda k: F.coalesce(tag(tags, k), F.lit(""))
    ramp = t("highway").endswith("_link") & (t("name") == "")
    to = _list(t("destination"), False)
    name = F.when(ramp & (to != ""), F.concat(F.lit("toward "), to)).otherwise(t("name"))
    reference = F.when(ramp & (t("ref") == ""), _list(t("destination:ref"), True)).otherwise(t("ref"))
    return F.struct(name.alias("name"), reference.alias("reference"))


def business_names(tags: Column) -> Column:
    """(name, reference): the brand stands for a missing name, and is the reference where the name does not hold it."""
    t = lambda k: F.coalesce(tag(tags, k), F.lit(""))
    name = F.when(t("name") == "", t("brand")).otherwise(t("name"))
    return F.struct(name.alias("name"), F.when((t("name") == "") | t("name").contains(t("brand")), "").otherwise(t("brand")).alias("reference"))


def point_label(kind: Column, name: Column, reference: Column) -> Column:
    """(name, reference) of a marked point: named ones and numbered exits as they are, taps, gates and the like by their kind's word; null for the rest."""
    named = (name != "") | ((kind == 77) & (reference != ""))
    word = lookup(kind, {k: v for k, v in MARKED.items() if k != 77})
    return F.when(named, F.struct(name.alias("name"), reference.alias("reference"))).when(word.isNotNull(), F.struct(F.lit("").alias("name"), word.alias("reference")))


def furniture(tags: Column) -> Column:
    """Sidewalks, crossings and islands drawn as footways of their own."""
    return F.coalesce(tag(tags, "footway").isin("sidewalk", "crossing", "traffic_island", "access_aisle"), F.lit(False))


def seaward(tags: Column) -> Column:
    """A boundary's member that runs along the coast or at sea."""
    return F.coalesce(tag(tags, "maritime") == "yes", F.lit(False)) | F.coalesce(tag(tags, "natural") == "coastline", F.lit(False))


def closed(refs: Column) -> Column:
    """Four references at least, the last one the first."""
    return (F.size(refs) >= 4) & (F.get(refs, F.lit(0)) == F.try_element_at(refs, F.lit(-1)))


def top_speed(mode: Column) -> Column:
    """Metres a second at most."""
    return lookup(mode, {k: v[0] / 3.6 for k, v in MODES.items()})


def turn_seconds(mode: Column) -> Column:
    return lookup(mode, {k: v[1] for k, v in MODES.items()})


def keeps_one_ways(mode: Column) -> Column:
    return mode != "foot"


def against_one_way(du: Column, dv: Column, direction: Column) -> Column:
    """Whether a step runs against a way's direction (radians)."""
    return du * F.cos(direction) + dv * F.sin(direction) <= -0.05


def tier(kind: Column) -> Column:
    """Who is lettered first: lower first, null for power lines; businesses after everything else."""
    out = F.when(kind == 11, None)
    for t, kinds in TIERS.items():
        out = out.when(kind.isin(*kinds), t)
    return out.when(kind >= 95, 20).when(kind >= 64, 9).when(kind >= 32, 8).otherwise(7)


def tier_limit(density: Column) -> Column:
    """The deepest tier that a density (0 to 1) lets through."""
    return F.round(F.least(F.greatest(density, F.lit(0.0)), F.lit(1.0)) * 9).cast("int")


def rank_group(kind: Column) -> Column:
    """Kinds lettered by rank among their own: places, summits, rivers, lakes."""
    return F.when(kind.between(64, 67), 0).when(kind.isin(68, 69), 1).when(kind == 12, 2).when(kind == 44, 3)
