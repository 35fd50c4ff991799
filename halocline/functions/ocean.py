"""Sea-water and sensor column expressions, from published formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Coefficients v_ijk of the 75-term specific volume polynomial (Roquet et al., 2015), by powers of salinity,
# temperature and pressure.
SPECIFIC_VOLUME = """
000:1.0769995862e-3  001:-6.0799143809e-5  002:9.9856169219e-6  003:-1.1309361437e-6  004:1.0531153080e-7  005:-1.2647261286e-8  006:1.9613503930e-9
010:-1.5649734675e-5  011:1.8505765429e-5  012:-1.1736386731e-6  013:-3.6527006553e-7  014:3.1454099902e-7  020:2.7762106484e-5  021:-1.1716606853e-5
022:2.1305028740e-6  023:2.8695905159e-7  030:-1.6521159259e-5  031:7.9279656173e-6  032:-4.6132540037e-7  040:6.9111322702e-6  041:-3.4102187482e-6
042:-6.3352916514e-8  050:-8.0539615540e-7  051:5.0736766814e-7  060:2.0543094268e-7  100:-3.1038981976e-4  101:2.4262468747e-5  102:-5.8484432984e-7
103:3.6310188515e-7  104:-1.1147125423e-7  110:3.5009599764e-5  111:-9.5677088156e-6  112:-5.5699154557e-6  113:-2.7295696237e-7  120:-3.7435842344e-5
121:-2.3678308361e-7  122:3.9137387080e-7  130:2.4141479483e-5  131:-3.4558773655e-6  132:7.7618888092e-9  140:-8.7595873154e-6  141:1.2956717783e-6
150:-3.3052758900e-7  200:6.6928067038e-4  201:-3.4792460974e-5  202:-4.8122251597e-6  203:1.6746303780e-8  210:-4.3592678561e-5  211:1.1100834765e-5
212:5.4620748834e-6  220:3.5907822760e-5  221:2.9283346295e-6  222:-6.5731104067e-7  230:-1.4353633048e-5  231:3.1655306078e-7  240:4.3703680598e-6
300:-8.5047933937e-4  301:3.7470777305e-5  302:4.9263106998e-6  310:3.4532461828e-5  311:-9.8447117844e-6  312:-1.3544185627e-6  320:-1.8698584187e-5
321:-4.8826139200e-7  330:2.2863324556e-6  400:5.8086069943e-4  401:-1.7322218612e-5  402:-1.7811974727e-6  410:-1.1959409788e-5  411:2.5909225260e-6
420:3.8595339244e-6  500:-2.1092370507e-4  501:3.0927427253e-6  510:1.3864594581e-6  600:3.1932457305e-5
"""
TERMS = {tuple(map(int, key)): float(value) for key, value in (term.split(":") for term in SPECIFIC_VOLUME.split())}
#: Reference salinity per practical salinity; scale and offset of the salinity root; heat capacity of conservative temperature.
SALT_RATIO, SALT_SCALE, SALT_OFFSET, HEAT = 35.16504 / 35, 0.0248826675584615, 0.5971840214030754, 3991.86795711963


def _poly(x: Column, coefficients) -> Column:
    """Horner's rule, lowest power first."""
    out = F.lit(0.0)
    for k, c in enumerate(reversed(list(coefficients))):
        out = (c if isinstance(c, Column) else F.lit(c)) if k == 0 else (c if isinstance(c, Column) else F.lit(c)) + x * out
    return out


def _nested(terms: dict[tuple[int, int, int], float], x: Column, y: Column, z: Column) -> Column:
    def pick(prefix):
        return max(k[len(prefix)] for k in terms if k[: len(prefix)] == prefix)

    def inner(prefix, args):
        if len(prefix) == 3:
            return F.lit(terms.get(prefix, 0.0))
        return _poly(args[0], [inner((*prefix, p), args[1:]) for p in range(pick(prefix) + 1) if any(k[: len(prefix) + 1] == (*prefix, p) for k in terms)])

    return inner((), (x, y, z))


def depth_of(pressure: Column, lat: Column) -> Column:
    """Depth in metres of a pressure in dbar at a latitude."""
    s = F.pow(F.sin(F.radians(lat)), 2)
    b = F.lit(9.780327) * (1 + (F.lit(5.2792e-3) + F.lit(2.32e-5) * s) * s)
    a = F.lit(-0.5 * 2.26e-7) * b
    q = pressure * F.lit(1e-4)
    c = 1e8 * q * _poly(q, (9.726613854843870e-4, -2.252956605630465e-5, 2.376909655387404e-6, -1.664294869986011e-7, -5.988108894465758e-9, -2.1078768810e-9, 2.8019291329e-10))
    return 2 * c / (b + F.sqrt(b * b - 4 * a * c))


def pressure_of(depth: Column, lat: Column) -> Column:
    """Pressure of a depth: a published closed estimate (within 0.1 dbar), then one Newton step on depth_of."""
    c = 1 - (F.lit(5.92e-3) + F.lit(5.25e-3) * F.pow(F.sin(F.radians(lat)), 2))
    p = (c - F.sqrt(c * c - F.lit(8.84e-6) * depth)) / F.lit(4.42e-6)
    slope = (depth_of(p + 1.0, lat) - depth_of(p - 1.0, lat)) / 2.0
    return p - (depth_of(p, lat) - depth) / slope


def absolute_salinity(practical: Column, anomaly: Column | None = None) -> Column:
    return practical * F.lit(SALT_RATIO) + (anomaly if anomaly is not None else F.lit(0.0))


def conservative_temperature(t: Column, sa: Column, p: Column) -> Column:
    """From in-situ temperature: published potential temperature estimate, then potential enthalpy; within 6e-4 degC over 0 to 1000 dbar."""
    s1 = sa * F.lit(1 / SALT_RATIO)
    pt = t + p * (
        F.lit(8.65483913395442e-6) - s1 * 1.41636299744881e-6 - p * 7.38286467135737e-9 + t * (F.lit(-8.38241357039698e-6) + s1 * 2.83933368585534e-8 + t * 1.77803965218656e-8 + p * 1.71155619208233e-10)
    )
    x2 = sa * SALT_SCALE
    x, y = F.sqrt(x2), pt / 40.0
    pure = _poly(y, (61.01362420681071, 168776.46138048015, -2735.2785605119625, 2574.2164453821433, -1536.6644434977543, 545.7340497931629, -50.91091728474331, -18.30489878927802))
    first = _poly(y, (268.5520265845071, -12019.028203559312, 3734.858026725145, -2046.7671145057618, 465.28655623826234, -0.6370820302376359, -10.650848542359153))
    second = _poly(y, (937.2099110620707, 588.1802812170108, 248.39476522971285, -3.871557904936333, -2.6268019854268356))
    rest = _poly(y, (936.3206544460336, -942.7827304544439, 369.4389437509002, -33.83664947895248, -9.987880382780322))
    third = F.lit(-1687.914374187449) + x * (F.lit(246.9598888781377) + x * (F.lit(123.59576582457964) - 48.5891069025409 * x)) + y * rest
    return (pure + x2 * (first + x * (second + x * third))) / HEAT


def specific_volume(sa: Column, ct: Column, p: Column) -> Column:
    x, y, z = F.sqrt(SALT_SCALE * sa + SALT_OFFSET), ct / 40.0, p * 1e-4
    return _nested(TERMS, x, y, z)


def sigma0(sa: Column, ct: Column) -> Column:
    """Potential density anomaly at the surface."""
    return 1 / specific_volume(sa, ct, F.lit(0.0)) - 1000


def sound_speed(sa: Column, ct: Column, p: Column) -> Column:
    x, y, z = F.sqrt(SALT_SCALE * sa + SALT_OFFSET), ct / 40.0, p * 1e-4
    slope = {(i, j, k - 1): v * k for (i, j, k), v in TERMS.items() if k > 0}
    v = _nested(TERMS, x, y, z)
    return 10000.0 * F.sqrt(-v * v / _nested(slope, x, y, z))


def speed(u: Column, v: Column) -> Column:
    return F.round(F.hypot(u, v), 4)


def qc_code(c: Column) -> Column:
    """Flag digit of a character; 9 (missing) for anything else."""
    return F.coalesce(F.when(F.trim(c).rlike("^[0-9]$"), F.trim(c).try_cast("int")), F.lit(9))


def unmasked(v: Column, fills: tuple[float, ...], tolerance: float = 1e-6) -> Column:
    """Null where the value is a declared fill, NaN or infinite."""
    bad = F.isnan(v) | (F.abs(v) == math.inf)
    for f in fills:
        bad = bad | (F.abs(v - f) <= tolerance * abs(f))
    return F.when(~bad, v)


def unpacked(v: Column, scale: float, offset: float, fill: float | None) -> Column:
    """value * scale + offset, the fill recognised before scaling."""
    return (F.when(v != fill, v) if fill is not None else v) * F.lit(scale) + F.lit(offset)


def profile_name(platform: Column, time: Column) -> Column:
    return F.concat_ws("_", platform, F.date_format(time, "yyyyMMdd'T'HHmmss"))
