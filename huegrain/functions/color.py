"""Colour arithmetic as expression text that any SQL engine takes; ``F.expr`` of it stays inside code generation."""

from __future__ import annotations

from pyspark.sql import functions as F


def to(x: str, digits: int = 4) -> str:
    """Rounding that is the same in every engine."""
    return f"(floor(({x}) * {10**digits}e0 + 0.5e0) / {10**digits}e0)"


def staged(df, steps: list[tuple[str, str]], keep: dict[str, str]):
    """``df`` with the columns ``keep`` (column -> name of a step); steps are columns over those before them, so that each is worked
    out once a row, whatever uses it."""
    for name, text in steps:
        df = df.withColumn(name, F.expr(text))
    for column, name in keep.items():
        df = df.withColumn(column, F.col(name))
    return df.drop(*(name for name, _ in steps))


def rgb_steps(l: str, a: str, b: str) -> list[tuple[str, str]]:
    """sRGB 0..1 of CIELAB under D65 (IEC 61966-2-1) as the steps _r, _g and _b."""
    finv = lambda t: f"CASE WHEN {t} > 6.0e0 / 29 THEN {t} * {t} * {t} ELSE ({t} - 16.0e0 / 116) / 7.787e0 END"
    # fixed values: the matrix of the standard
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    steps = [("_fy", f"({l} + 16) / 116.0e0"), ("_fx", f"_fy + {a} / 500.0e0"), ("_fz", f"_fy - {b} / 200.0e0")]
    steps += [("_x", f"0.95047e0 * ({finv('_fx')})"), ("_y", finv("_fy")), ("_z", f"1.08883e0 * ({finv('_fz')})")]
    steps += [(f"_l{c}", f"{m[0]}e0 * _x + {m[1]}e0 * _y + {m[2]}e0 * _z") for c, m in zip("rgb", rows)]
    return steps + [(f"_{c}", f"greatest(0.0e0, least(1.0e0, CASE WHEN _l{c} <= 0.0031308e0 THEN 12.92e0 * _l{c} ELSE 1.055e0 * power(greatest(_l{c}, 0.0e0), 1 / 2.4e0) - 0.055e0 END))") for c in "rgb"]


def with_rgb(df, l: str = "lab_l", a: str = "lab_a", b: str = "lab_b"):
    """``df`` with r, g and b between 0 and 1."""
    return staged(df, rgb_steps(l, a, b), {"r": "_r", "g": "_g", "b": "_b"})


def with_saturation(df, l: str = "lab_l", a: str = "lab_a", b: str = "lab_b", name: str = "sat"):
    """``df`` with the HSB saturation of a colour in percent; 0 for black."""
    steps = [*rgb_steps(l, a, b), ("_most", "greatest(_r, _g, _b)"), ("_least", "least(_r, _g, _b)"), ("_sat", "CASE WHEN _most <= 0 THEN 0.0e0 ELSE (_most - _least) / _most * 100 END")]
    return staged(df, steps, {name: "_sat"})


def hsb_class(sat: str, saturated: float = 50, muted: float = 12) -> str:
    return f"(CASE WHEN {sat} >= {saturated} THEN 'saturated' WHEN {sat} >= {muted} THEN 'muted' ELSE 'neutral' END)"


def byte_of(channel: str, rounding: bool = False) -> str:
    """A channel of 0..1 as 0..255: truncated, or rounded half to even."""
    return f"cast(bround({channel} * 255, 0) as int)" if rounding else f"cast(floor({channel} * 255) as int)"


def hex_of(r: str = "r", g: str = "g", b: str = "b", rounding: bool = False) -> str:
    return "lower(concat('#', " + ", ".join(f"lpad(hex({byte_of(c, rounding)}), 2, '0')" for c in (r, g, b)) + "))"


def chroma(a: str, b: str) -> str:
    return f"sqrt({a} * {a} + {b} * {b})"


def hue(a: str, b: str, neutral: float = 8) -> str:
    angle = f"degrees(atan2({b}, {a}))"
    return f"(CASE WHEN {chroma(a, b)} < {neutral} THEN NULL WHEN {angle} < 0 THEN {angle} + 360 ELSE {angle} END)"


def hue_difference(h1: str, h2: str) -> str:
    """To nine digits, so that angles of 25, 45 or 90 degrees compare alike in every engine."""
    return to(f"least(abs({h1} - {h2}), 360 - abs({h1} - {h2}))", 9)


def de00_steps(l1: str, a1: str, b1: str, l2: str, a2: str, b2: str) -> list[tuple[str, str]]:
    """CIEDE2000 (Sharma, Wu and Dalal, 2005) as named steps, each over the columns before it; the last is ``de00``."""
    deg = lambda x: f"radians({x})"
    return [
        ("cb7", f"power((sqrt({a1}*{a1}+{b1}*{b1}) + sqrt({a2}*{a2}+{b2}*{b2})) / 2, 7)"),
        ("g1", "1 + 0.5e0 * (1 - sqrt(cb7 / (cb7 + 6103515625.0e0)))"),
        ("ap1", f"g1 * {a1}"), ("ap2", f"g1 * {a2}"),
        ("cp1", f"sqrt(ap1*ap1 + {b1}*{b1})"), ("cp2", f"sqrt(ap2*ap2 + {b2}*{b2})"),
        ("hr1", f"CASE WHEN cp1 = 0 THEN 0.0e0 ELSE degrees(atan2({b1}, ap1)) END"), ("hr2", f"CASE WHEN cp2 = 0 THEN 0.0e0 ELSE degrees(atan2({b2}, ap2)) END"),
        ("hp1", "CASE WHEN hr1 < 0 THEN hr1 + 360 ELSE hr1 END"), ("hp2", "CASE WHEN hr2 < 0 THEN hr2 + 360 ELSE hr2 END"),
        ("dh", "CASE WHEN cp1 * cp2 = 0 THEN 0.0e0 WHEN abs(hp2 - hp1) <= 180 THEN hp2 - hp1 WHEN hp2 - hp1 > 180 THEN hp2 - hp1 - 360 ELSE hp2 - hp1 + 360 END"),
        ("hm", "CASE WHEN cp1 * cp2 = 0 THEN hp1 + hp2 WHEN abs(hp1 - hp2) <= 180 THEN (hp1 + hp2) / 2 WHEN hp1 + hp2 < 360 THEN (hp1 + hp2 + 360) / 2 ELSE (hp1 + hp2 - 360) / 2 END"),
        ("dhh", f"2 * sqrt(cp1 * cp2) * sin({deg('dh / 2')})"),
        ("lm", f"({l1} + {l2}) / 2 - 50"), ("cm", "(cp1 + cp2) / 2"),
        ("tt", f"1 - 0.17e0 * cos({deg('hm - 30')}) + 0.24e0 * cos({deg('2 * hm')}) + 0.32e0 * cos({deg('3 * hm + 6')}) - 0.20e0 * cos({deg('4 * hm - 63')})"),
        ("rt", f"-sin({deg('60 * exp(-power((hm - 275) / 25, 2))')}) * 2 * sqrt(power(cm, 7) / (power(cm, 7) + 6103515625.0e0))"),
        ("dl", f"({l2} - {l1}) / (1 + 0.015e0 * lm * lm / sqrt(20 + lm * lm))"), ("dc", "(cp2 - cp1) / (1 + 0.045e0 * cm)"), ("dq", "dhh / (1 + 0.015e0 * cm * tt)"),
        ("de00", "sqrt(greatest(0.0e0, dl*dl + dc*dc + dq*dq + rt*dc*dq))"),
    ]


def with_de00(df, *lab: str):
    """``df`` with a ``de00`` column between the two colours named by six columns."""
    steps = de00_steps(*lab)
    for name, text in steps:
        df = df.withColumn(name, F.expr(text))
    return df.drop(*(n for n, _ in steps[:-1]))


def de00_sql(source: str, *lab: str) -> str:
    """A query of ``source`` with the steps' columns added, one sub-query a step."""
    for name, text in de00_steps(*lab):
        source = f"(SELECT *, {text} AS {name} FROM {source})"
    return source
