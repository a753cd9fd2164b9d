"""Column expressions: calendar, bins, angles, units and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MERCATOR_M = 6378137.0
KM_PER_DEGREE = 111.0
CELL_DEGREES = 0.1
# Months of the seasons.
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
OCEAN_WORDS = ("Ocean", "Sea", "Mediterranean")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def season(month: Column | str) -> Column:
    """DJF, MAM, JJA or SON of a month's number; anything else counts as SON."""
    m = col(month)
    out = F.when(m.isin(*SEASONS["DJF"]), "DJF").when(m.isin(*SEASONS["MAM"]), "MAM")
    return out.when(m.isin(*SEASONS["JJA"]), "JJA").otherwise("SON")


def month_start(ts: Column | str) -> Column:
    return F.date_trunc("month", col(ts)).cast("timestamp_ntz")


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance in km; null if a coordinate is."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2), F.lit(2))
    return F.lit(EARTH_KM) * 2 * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def bearing(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Initial bearing in degrees, clockwise from north, 0 to 360."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    d = F.radians(col(lon2) - col(lon1))
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def sector(angle: Column, n: int) -> Column:
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(angle / (360.0 / n)))).cast("int")


def cell_centre(v: Column | str, low: float, step: float) -> Column:
    return F.lit(low) + F.floor((col(v) - low) / step) * step + step / 2


def wrap_longitude(lon: Column | str) -> Column:
    """To [-180, 180)."""
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def quadrant_id(lon: Column | str, lat: Column | str, step: float = 10.0, lon_min: float = -180.0, lon_max: float = 180.0, lat_min: float = -60.0, lat_max: float = 60.0) -> Column:
    """Cells numbered by rows from the north-west; null outside the half-open window (longitudes are wrapped first)."""
    x, y = wrap_longitude(lon), col(lat)
    n_cols, n_rows = int(round((lon_max - lon_min) / step)), int(round((lat_max - lat_min) / step))
    row = F.floor((y - lat_min) / step)
    inside = (x >= lon_min) & (x < lon_max) & (y >= lat_min) & (y < lat_max)
    return F.when(inside, (n_rows - 1 - row) * n_cols + F.floor((x - lon_min) / step)).cast("int")


def is_day(ts: Column | str, lon: Column | str, wrap: bool = False) -> Column:
    """Day if the local solar hour is 6 to 17. The longitude's hours are rounded half to even; a negative hour is night
    unless it is wrapped."""
    hours = F.hour(col(ts)) + F.rint(col(lon) / 15).cast("int")
    local = F.pmod(hours, F.lit(24)) if wrap else hours % 24
    return F.when(local.between(6, 17), "Day").otherwise("Night")


def is_ocean(region: Column | str) -> Column:
    out = F.lit(False)
    for word in OCEAN_WORDS:
        out = out | col(region).ilike(f"%{word}%")
    return out


def pixel_speed(pixels: Column | str, step_minutes: float) -> Column:
    """Pixels of 0.1 degrees for each time step, as m/s."""
    return col(pixels) * 0.1 * 111000.0 / (step_minutes * 60.0)


def speed_and_direction(u: Column | str, v: Column | str, most: float | None = None) -> Column:
    """Struct of speed (at most `most`) and the unit vector (null for a calm)."""
    size = F.sqrt(col(u) * col(u) + col(v) * col(v))
    return F.struct((F.least(size, F.lit(float(most))) if most is not None else size).alias("speed"), F.try_divide(col(u), size).alias("ux"), F.try_divide(col(v), size).alias("uy"))


def cell_area_km2(lat: Column | str, d_lat: float, d_lon: float) -> Column:
    """Area of a cell of a regular grid, degrees."""
    return F.lit(EARTH_KM**2) * F.radians(F.lit(d_lat)) * F.radians(F.lit(d_lon)) * F.cos(F.radians(col(lat)))


def point_rectangle(lat: Column | str, lon: Column | str, dx_km: float, dy_km: float) -> Column:
    """Struct of south, north, west, east: dy and dx to either side of a point."""
    half_y = F.lit(dy_km / KM_PER_DEGREE)
    half_x = F.lit(dx_km) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(col(lat))))
    return F.struct((col(lat) - half_y).alias("south"), (col(lat) + half_y).alias("north"), (col(lon) - half_x).alias("west"), (col(lon) + half_x).alias("east"))


def human_number(x: Column | str) -> Column:
    """1.2M, 3.4k, or the number."""
    v = col(x)
    return F.when(F.abs(v) >= 1e6, F.format_string("%.1fM", v / 1e6)).when(F.abs(v) >= 1e3, F.format_string("%.1fk", v / 1e3)).otherwise(F.format_string("%.0f", v.cast("double")))


def round_up_nicely(x: Column) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that is not below x; null unless x > 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    m = x / power
    return F.when(x > 0, F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 2.5, 2.5).when(m <= 5, 5.0).otherwise(10.0) * power)


def clamp_unit(v: Column | str, low: float, high: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(v) - low) / (high - low)))


def finite(v: Column | str) -> Column:
    return col(v).isNotNull() & ~F.isnan(col(v)) & (F.abs(col(v)) < float("inf"))


def file_time(path: Column | str) -> Column:
    """Time of a file from its name: YYYYMMDD_HHMM, dotted YYYYMMDD.HHMM, or YYYYMMDD-SHHMMSS; null if there is none."""
    name = F.element_at(F.split(col(path), "/"), -1)
    day = F.regexp_extract(name, r"(\d{8})[_.](\d{4})", 1)
    at = F.regexp_extract(name, r"(\d{8})[_.](\d{4})", 2)
    plain = F.try_to_timestamp(F.concat(day, at), F.lit("yyyyMMddHHmm"))
    half = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(name, r"(\d{8}-S\d{6})", 1), "-S", ""), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.when(day != "", plain), half).cast("timestamp_ntz")


def file_time_at(path: Column | str, start: int, stop: int, pattern: str) -> Column:
    """Time from the characters start .. stop - 1 of a file's name, by a pattern; null if they are no such time."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.try_to_timestamp(F.substring(name, start + 1, stop - start), F.lit(pattern)).cast("timestamp_ntz")


def file_time_parts(path: Column | str, parts: tuple[int, ...], pattern: str) -> Column:
    """Time from the dotted parts of a file's name, put together in order."""
    bits = F.split(F.element_at(F.split(col(path), "/"), -1), r"\.")
    return F.try_to_timestamp(F.concat(*[F.try_element_at(bits, F.lit(k + 1)) for k in parts]), F.lit(pattern)).cast("timestamp_ntz")


def frame_label(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm 'UTC'")


def frame_key(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyyMMdd_HHmm")
