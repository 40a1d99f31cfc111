"""Semantic penalty rules of the cluster-to-material mapping, as a rule table."""

from __future__ import annotations

from .palette import PRESET

ALL = [name for name, _, _ in PRESET]
# Material sets used by the rules.
SETS = {
    "veg": ["BM_LAND_GRASS", "BM_LAND_DRY_GRASS", "BM_VEGETATION", "BM_FOLIAGE"],
    "lush": ["BM_LAND_GRASS", "BM_VEGETATION", "BM_FOLIAGE"],
    "canopy": ["BM_VEGETATION", "BM_FOLIAGE"],
    "grasses": ["BM_LAND_DRY_GRASS", "BM_LAND_GRASS"],
    "roads": ["BM_ASPHALT", "BM_CONCRETE", "BM_PAINT_ASPHALT"],
    "asphalts": ["BM_ASPHALT", "BM_PAINT_ASPHALT"],
    "pavement": ["BM_ASPHALT", "BM_PAINT_ASPHALT", "BM_CONCRETE"],
    "metals": ["BM_METAL", "BM_METAL_STEEL"],
    "veg_road": ["BM_LAND_GRASS", "BM_LAND_DRY_GRASS", "BM_VEGETATION", "BM_FOLIAGE", "BM_ASPHALT", "BM_CONCRETE", "BM_PAINT_ASPHALT"],
}

# Weight of each score axis and the materials whose target is 1 (or the given value).
AXES = [
    ("veg", 0.70, {m: 1.0 for m in SETS["veg"]}),
    ("road", 1.05, {m: 1.0 for m in SETS["roads"]}),
    ("asphalt", 0.95, {m: 1.0 for m in SETS["asphalts"]}),
    ("line", 0.75, {"BM_PAINT_ASPHALT": 1.0, "BM_ASPHALT": 0.30, "BM_CONCRETE": 0.15}),
    ("water", 1.35, {"BM_WATER": 1.0}),
    ("dry", 0.95, {"BM_LAND_DRY_GRASS": 1.0, "BM_SOIL": 1.0, "BM_ROCK": 1.0}),
    ("sand", 0.90, {"BM_SAND": 1.0}),
]

# The rule chains, (materials, [(SQL condition, delta, damped)]). In a chain the
# first condition that holds counts; all chains of a material add up. A damped delta is
# weakened by the vegetation score (see DAMPING).
RULES = [
    (["BM_WATER"], [("road>=0.40", 2.5, False), ("road>=0.25", 1.2, False)]),
    (["BM_WATER"], [("water<0.25", 2.0, False)]),
    (["BM_WATER"], [("freq<0.02", 1.0, False)]),
    (["BM_WATER"], [("water_conf<0.20", 2.5, False)]),
    (["BM_WATER"], [("water_conf<0.12", 3.5, False)]),
    (["BM_WATER"], [("achro>=0.30", 5.0, False), ("achro>=0.18", 3.0, False), ("achro>=0.10", 1.5, False)]),
    (["BM_WATER"], [("dark_gray>=0.30", 4.0, False), ("dark_gray>=0.18", 2.5, False), ("dark_gray>=0.10", 1.2, False)]),
    (["BM_WATER"], [("achro>=0.12 AND dark_gray>=0.10", 3.0, False)]),
    (["BM_WATER"], [("gray>=0.40", 2.5, False), ("gray>=0.25", 1.2, False)]),
    (["BM_WATER"], [("asphalt>=0.35", 3.0, False), ("asphalt>=0.20", 1.5, False)]),
    (["BM_WATER"], [("blue_dom<0.08 AND water_conf<0.40", 3.0, False), ("blue_dom<0.15 AND water_conf<0.30", 1.5, False)]),
    (["BM_WATER"], [("size<0.005 AND water_conf<0.45", 2.0, False), ("size<0.015 AND water_conf<0.35", 1.0, False)]),
    (["BM_WATER"], [("warm>=0.40", 5.0, False), ("warm>=0.28", 3.0, False), ("warm>=0.18", 1.5, False)]),
    (["BM_WATER"], [("dry>=0.35", 3.5, False), ("dry>=0.20", 1.8, False)]),
    (["BM_WATER"], [("warm>=0.20 AND dry>=0.15", 2.5, False)]),
    (["BM_WATER"], [("sand>=0.30", 2.0, False)]),
    (["BM_WATER"], [("veg>=0.15 AND water<0.50", 1.5, False)]),
    (["BM_WATER"], [("veg>=0.25 AND water<0.65", 1.5, False)]),
    (SETS["veg"], [("water>=0.20 AND veg>=0.10", -0.8, False)]),
    (SETS["veg"], [("veg<0.04", 2.0, False), ("veg<0.10", 0.4, False)]),
    (SETS["veg"], [("road>=0.45 AND veg<0.30", 2.0, False)]),
    (SETS["veg"], [("asphalt>=0.40 AND veg<0.30", 2.0, False)]),
    (SETS["veg"], [("road>=0.35 AND gray>=0.25 AND veg<0.20", 2.5, False)]),
    (SETS["veg"], [("asphalt>=0.30 AND gray>=0.25 AND veg<0.20", 2.5, False)]),
    (SETS["veg"], [("achro>=0.45 AND veg<0.20", 4.0, False), ("achro>=0.30 AND veg<0.15", 2.5, False), ("achro>=0.18 AND veg<0.10", 1.5, False)]),
    (SETS["veg"], [("water>=0.50", 2.0, False)]),
    (SETS["lush"], [("dry>=0.50", 1.5, False)]),
    (SETS["veg"], [("gray>=0.55", 4.0, True), ("gray>=0.40", 2.5, True), ("gray>=0.25", 1.5, True), ("gray>=0.15", 0.5, True)]),
    (SETS["veg"], [("dark_gray>=0.45", 5.0, True), ("dark_gray>=0.30", 3.0, True), ("dark_gray>=0.15", 1.0, True)]),
    (SETS["veg"], [("dark_gray>=0.25 AND asphalt>=0.20 AND veg<0.20", 3.0, False)]),
    (SETS["veg"], [("gray>=0.30 AND asphalt>=0.20 AND veg<0.20", 2.0, False)]),
    (SETS["veg"], [("gray>=0.25 AND veg<0.10 AND grass<0.08", 2.5, False)]),
    (SETS["veg"], [("gray>=0.40 AND veg<0.08", 2.5, False)]),
    (SETS["veg"], [("gray>=0.22 AND road>=0.35 AND veg<0.15", 2.0, False), ("gray>=0.22 AND asphalt>=0.28 AND veg<0.15", 2.0, False)]),
    (["BM_LAND_GRASS"], [("gray>=0.25 AND veg<0.20", 3.0, False), ("dark_gray>=0.15 AND veg<0.20", 3.0, False)]),
    (["BM_LAND_GRASS"], [("road>=0.35 AND veg<0.15", 2.5, False), ("asphalt>=0.30 AND veg<0.15", 2.5, False)]),
    (["BM_LAND_DRY_GRASS"], [("gray>=0.25 AND veg<0.20", 2.5, False), ("dark_gray>=0.15 AND veg<0.20", 2.5, False)]),
    (["BM_LAND_DRY_GRASS"], [("road>=0.35 AND veg<0.15", 2.0, False), ("asphalt>=0.30 AND veg<0.15", 2.0, False)]),
    (SETS["canopy"], [("gray>=0.22 AND veg<0.15", 3.5, False), ("dark_gray>=0.15 AND veg<0.15", 3.5, False)]),
    (SETS["canopy"], [("road>=0.30 AND veg<0.20", 3.0, False), ("asphalt>=0.25 AND veg<0.20", 3.0, False)]),
    (SETS["canopy"], [("gray>=0.30 AND road>=0.28 AND veg<0.15", 3.0, False), ("gray>=0.30 AND asphalt>=0.22 AND veg<0.15", 3.0, False)]),
    (["BM_LAND_DRY_GRASS"], [("veg>=0.62 AND dry<0.20", 0.8, False)]),
    (SETS["veg"], [("veg>=0.08 AND gray<0.40", -3.0, False)]),
    (SETS["veg"], [("veg>=0.15 AND gray<0.35", -4.5, False)]),
    (SETS["veg"], [("veg>=0.30 AND gray<0.30", -5.0, False)]),
    (SETS["veg"], [("veg>=0.45 AND gray<0.25", -4.5, False)]),
    (SETS["veg"], [("veg>=0.60 AND gray<0.20", -4.0, False)]),
    (SETS["veg"], [("grass>=0.06 AND gray<0.30", -3.5, False)]),
    (SETS["veg"], [("grass>=0.15 AND gray<0.25", -3.5, False)]),
    (SETS["veg"], [("grass>=0.30 AND gray<0.20", -3.0, False)]),
    (SETS["asphalts"], [("veg>=0.35", 4.0, False), ("veg>=0.22", 2.5, False), ("veg>=0.12", 1.0, False)]),
    (SETS["asphalts"], [("grass>=0.20", 2.5, False)]),
    (SETS["asphalts"], [("grass>=0.35", 2.5, False)]),
    (SETS["asphalts"], [("gray>=0.50", -2.5, False), ("gray>=0.35", -1.8, False), ("gray>=0.20", -1.2, False), ("gray>=0.12", -0.5, False)]),
    (SETS["asphalts"], [("dark_gray>=0.40", -4.0, False), ("dark_gray>=0.20", -2.5, False), ("dark_gray>=0.10", -1.0, False)]),
    (SETS["asphalts"], [("dark_gray>=0.25 AND warm<0.15", -2.5, False)]),
    (SETS["asphalts"], [("gray>=0.20 AND veg<0.15 AND grass<0.10", -2.0, False)]),
    (SETS["asphalts"], [("gray>=0.35 AND veg<0.10 AND grass<0.08", -2.0, False)]),
    (SETS["asphalts"], [("gray>=0.18 AND road>=0.28 AND veg<0.18", -1.8, False), ("gray>=0.18 AND asphalt>=0.22 AND veg<0.18", -1.8, False)]),
    (["BM_ASPHALT"], [("gray>=0.20 AND veg<0.18", -2.0, False), ("dark_gray>=0.12 AND veg<0.18", -2.0, False)]),
    (["BM_ASPHALT"], [("road>=0.28 AND veg<0.20", -1.8, False), ("asphalt>=0.22 AND veg<0.20", -1.8, False)]),
    (SETS["asphalts"], [("achro>=0.45 AND veg<0.20", -3.5, False), ("achro>=0.30 AND veg<0.15", -2.5, False), ("achro>=0.18 AND veg<0.12", -1.5, False)]),
    (SETS["asphalts"], [("sand>=0.35", 1.8, False)]),
    (SETS["asphalts"], [("sand>=0.55", 1.5, False)]),
    (SETS["pavement"], [("warm>=0.55", 5.0, False), ("warm>=0.40", 3.5, False), ("warm>=0.25", 2.0, False), ("warm>=0.12", 0.8, False)]),
    (SETS["pavement"], [("warm>=0.20 AND gray<0.20", 2.5, False)]),
    (["BM_SAND"], [("dark_gray>=0.30", 2.5, False)]),
    (["BM_SAND"], [("asphalt>=0.40", 1.8, False)]),
    (["BM_SAND"], [("gray>=0.40 AND warm<0.20", 4.0, False), ("gray>=0.25 AND warm<0.20", 2.0, False)]),
    (["BM_SAND"], [("warm>=0.35", -1.0, False)]),
    (["BM_SOIL"], [("road>=0.52", 1.4, False)]),
    (["BM_SOIL"], [("asphalt>=0.48", 1.3, False)]),
    (["BM_SOIL"], [("line>=0.45", 0.8, False)]),
    (["BM_SOIL"], [("gray>=0.45 AND warm<0.15", 5.0, False), ("gray>=0.30 AND warm<0.20", 3.0, False), ("gray>=0.20 AND warm<0.20", 1.5, False)]),
    (["BM_SOIL"], [("dark_gray>=0.35", 5.0, False), ("dark_gray>=0.20", 3.0, False), ("dark_gray>=0.10", 1.5, False)]),
    (["BM_SOIL"], [("dark_gray>=0.20 AND warm<0.15", 3.0, False)]),
    (["BM_SOIL"], [("achro>=0.35 AND warm<0.15", 4.0, False), ("achro>=0.20 AND warm<0.20", 2.0, False)]),
    (["BM_SOIL"], [("gray>=0.25 AND dry<0.15", 2.5, False)]),
    (["BM_SOIL"], [("warm>=0.30 AND dry>=0.20", -1.5, False), ("warm>=0.20", -0.6, False)]),
    (SETS["veg"], [("water>=0.55", 1.5, False)]),
    (SETS["lush"], [("water_conf>=0.40", 1.5, False)]),
    (SETS["asphalts"], [("road>=0.30", -1.4, False)]),
    (SETS["asphalts"], [("asphalt>=0.30", -1.2, False)]),
    (["BM_CONCRETE"], [("road>=0.30", -1.1, False)]),
    (["BM_CONCRETE"], [("road>=0.50", -1.0, False)]),
    (["BM_CONCRETE"], [("gray>=0.50 AND veg<0.15", -2.0, False), ("gray>=0.35 AND veg<0.18", -1.5, False), ("gray>=0.20 AND veg<0.20", -1.0, False)]),
    (["BM_CONCRETE"], [("dark_gray>=0.15 AND veg<0.15", -0.6, False)]),
    (["BM_CONCRETE"], [("gray>=0.20 AND veg<0.15 AND grass<0.10", -2.0, False)]),
    (["BM_CONCRETE"], [("gray>=0.35 AND veg<0.10 AND grass<0.08", -2.0, False)]),
    (["BM_CONCRETE"], [("achro>=0.35 AND veg<0.15", -2.0, False), ("achro>=0.20 AND veg<0.12", -1.2, False)]),
    (["BM_CONCRETE"], [("veg>=0.25", 3.0, False)]),
    (["BM_CONCRETE"], [("veg>=0.40", 2.5, False)]),
    (["BM_CONCRETE"], [("grass>=0.15", 2.0, False)]),
    (["BM_CONCRETE"], [("grass>=0.30", 2.0, False)]),
    (["BM_PAINT_ASPHALT"], [("line>=0.30", -1.0, False)]),
    (["BM_SOIL"], [("dry>=0.30", -1.2, False)]),
    (["BM_SOIL"], [("warm>=0.30 AND dry>=0.20", -0.8, False)]),
    (["BM_ROCK"], [("dry>=0.30", -1.0, False)]),
    (["BM_ROCK"], [("gray>=0.18", -2.0, False)]),
    (["BM_ROCK"], [("dark_gray>=0.12", -1.4, False)]),
    (["BM_ROCK"], [("road>=0.28", -1.6, False)]),
    (["BM_ROCK"], [("asphalt>=0.22", -1.4, False)]),
    (["BM_ROCK"], [("gray>=0.18 AND veg<0.35", -2.2, False)]),
    (["BM_ROCK"], [("veg>=0.45 AND gray<0.15", 2.0, False)]),
    (["BM_WATER"], [("water_conf>=0.22", -1.5, False)]),
    (["BM_WATER"], [("water_conf>=0.45", -1.5, False)]),
    (SETS["metals"], [("true", 2.5, False)]),
    (["BM_SAND"], [("sand>=0.35", -1.2, False)]),
    (["BM_SAND"], [("sand>=0.50", -1.2, False)]),
    (["BM_SAND"], [("sand>=0.65", -0.8, False)]),
    (["BM_SAND"], [("grass>=0.20", 2.5, False), ("veg>=0.25", 2.0, False)]),
    (SETS["grasses"], [("sand>=0.45 AND sand>dry", 1.8, False), ("sand>=0.35", 0.9, False)]),
    (["BM_LAND_GRASS"], [("grass<0.08", 1.5, False)]),
    (["BM_LAND_DRY_GRASS"], [("grass<0.04 AND sand>=0.30", 1.0, False)]),
    (SETS["grasses"], [("gray>=0.55 AND veg<0.15", 4.0, False), ("gray>=0.35 AND veg<0.15", 2.5, False), ("gray>=0.20 AND veg<0.10", 1.5, False)]),
    (SETS["grasses"], [("achro>=0.40 AND veg<0.15", 3.5, False), ("achro>=0.25 AND veg<0.10", 2.0, False)]),
    (SETS["veg_road"], [("water>=0.55", 1.5, False)]),
]
# Damping of the gray rules by the vegetation score.
DAMPING = [(0.35, 0.10), (0.20, 0.30), (0.12, 0.55)]
