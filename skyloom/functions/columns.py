"""Column expressions for frame metadata, headers and star measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full width at a tenth of the maximum of a Gaussian profile, in units of its FWHM.
TENTH_MAX = math.sqrt(math.log(10.0) / math.log(2.0))
#: 1.4826 turns a median absolute deviation into a standard deviation for normal data.
MAD_SIGMA = 1.4826
LUMA = (0.2126, 0.7152, 0.0722)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value where it is a finite number, else NULL: the reference skips NaN, Spark would order it."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def lower_median(c: Column | str) -> Column:
    """The lower of two middle values, an aggregate; NULLs are skipped."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c if isinstance(c, str) else c._jc.toString()})")


def lower_median_over(name: str, by: list[str]) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name}) OVER (PARTITION BY {', '.join(by)})")


def spread(sum_sq: Column, n: Column) -> Column:
    """Standard deviation from squares about a given centre, with divisor max(n, 2) - 1."""
    return F.sqrt(F.greatest(sum_sq, F.lit(0.0)) / (F.greatest(n, F.lit(2)) - 1))


def exposure_key(exposure: Column | str) -> Column:
    """Seconds to two decimals; NULL where unknown or not positive, a group of its own."""
    e = finite(exposure)
    return F.when(e > 0, F.round(e, 2))


def header_number(header: Column | str, *aliases: str) -> Column:
    """The first of the aliases that parses as a number."""
    return F.coalesce(*[F.expr(f"try_cast({_at(header, a)} AS DOUBLE)") for a in aliases])


def header_text(header: Column | str, *aliases: str) -> Column:
    """The first of the aliases that is not blank."""
    return F.coalesce(*[F.expr(f"nullif(trim({_at(header, a)}), '')") for a in aliases])


def _at(header: Column | str, key: str) -> str:
    name = header if isinstance(header, str) else header._jc.toString()
    return f"try_element_at({name}, '{key}')"


def focal_length(header: str) -> Column:
    f = header_number(header, "FOCALLEN", "FOCAL", "FOCALLENGTH")
    return F.when(f > 0, f)


def pixel_scale(header: str) -> Column:
    """Arcseconds a pixel to three decimals: as stated, or from pixel size and focal length of unbinned square
    pixels."""
    stated = header_number(header, "PIXSCALE", "SECPIX")
    px, py = header_number(header, "XPIXSZ", "PIXSIZE1"), header_number(header, "YPIXSZ", "PIXSIZE2")
    bx, by = header_number(header, "XBINNING"), header_number(header, "YBINNING")
    square = (px > 0) & (F.coalesce(py, px) == px) & (F.coalesce(bx, F.lit(1.0)) == 1) & (F.coalesce(by, F.lit(1.0)) == 1)
    derived = F.when(square, F.lit(206.264806) * px / focal_length(header))
    return F.round(F.when(stated > 0, stated).otherwise(derived), 3)


def camera_identity(header: str) -> Column:
    """Camera name, white space collapsed, in lower case; NULL where unknown."""
    name = header_text(header, "INSTRUME", "CAMERA")
    return F.nullif(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), F.lit(""))


def camera_label(header: str) -> Column:
    """Camera and pixel scale, as in ``seestar s50, 2.301"/px``; the camera alone where the scale is not known."""
    name, scale = F.coalesce(camera_identity(header), F.lit("unknown camera")), pixel_scale(header)
    return F.when(scale > 0, F.concat(name, F.lit(", "), plain_number(scale), F.lit('"/px'))).otherwise(name)


def plain_number(value: Column) -> Column:
    """A number as text, whole ones without a decimal point."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def beside(path: Column | str, mark: Column) -> Column:
    """A file's name with ``mark`` before its suffix: results of trial runs and of other weightings stand beside
    the full result."""
    name, suffix = F.regexp_replace(col(path), r"\.[^./]*$", ""), F.regexp_extract(col(path), r"(\.[^./]*)$", 1)
    return F.concat(name, mark, suffix)


#: Names that weightings had once, and the names of now.
FORMER_WEIGHTINGS = {"psfsw": "psfsnr", "psfsw+fwhm": "psfsnr+fwhm", "psfsw+field": "psfsnr+field", "psfsw-pi": "psfsw"}


def current_weighting(name: Column | str) -> Column:
    """The present name of a weighting of old settings."""
    known = F.create_map(*[F.lit(x) for pair in FORMER_WEIGHTINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, col(name)), col(name))


def night(stamp: Column | str) -> Column:
    """The date of the evening: twelve hours before the exposure."""
    return F.date_format(col(stamp) - F.expr("INTERVAL 12 HOURS"), "yyyy-MM-dd")


def slug(text: Column | str) -> Column:
    """White space becomes an underscore; only letters, digits, underscore and hyphen stay."""
    return F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"\s+", "_"), r"[^0-9A-Za-z_\-]", "")


def evening(text: Column | str) -> Column:
    """``night`` of an ISO stamp as headers hold it; its first ten characters where it is none, NULL where empty."""
    stamp = F.nullif(F.trim(col(text)), F.lit(""))
    return F.coalesce(night(F.replace(stamp, F.lit("Z"), F.lit("")).try_cast("timestamp_ntz")), F.substring(stamp, 1, 10))


def short_number(value: Column) -> Column:
    """A number in six digits without trailing zeros, with an exponent below 0.0001 and from a million on."""
    told = F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(told, r"\.(e|$)", "$1")


def group_value(key: str, header: Column | str = "header", path: Column | str = "path") -> Column:
    """What a file has for a grouping key: a header card as text (numbers with a point in six digits), or NIGHT, FOLDER
    (the one it lies in) or SIZE. UNKNOWN where there is none."""
    at = lambda k: F.try_element_at(col(header), F.lit(k))
    if key == "NIGHT":
        value = F.coalesce(evening(at("DATE-OBS")), evening(at("DATE")))
    elif key == "FOLDER":
        value = F.element_at(F.split(col(path), "/"), -2)
    elif key == "SIZE":
        value = F.concat(F.coalesce(at("NAXIS1"), F.lit("?")), F.lit("x"), F.coalesce(at("NAXIS2"), F.lit("?")))
    else:
        text = F.trim(at(key))
        value = F.when(text.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?$"), short_number(text.try_cast("double"))).otherwise(text)
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("UNKNOWN"))


def file_part(text: Column) -> Column:
    """White space becomes an underscore; only letters, digits, ``_``, ``-`` and ``.`` stay, without outer underscores."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "_"), r"[^\p{L}\p{N}_.\-]", ""), "^_+|_+$", "")


def sexagesimal(text: Column | str, hours: bool = False) -> Column:
    """Degrees of "dd mm ss" or "dd:mm:ss"; hours are fifteen degrees each. NULL where it does not parse."""
    parts = F.split(F.regexp_replace(F.trim(col(text)), "[: ]+", " "), " ")
    value = [F.abs(F.coalesce(F.get(parts, F.lit(k)).try_cast("double"), F.lit(None if k == 0 else 0.0).cast("double"))) for k in range(3)]
    sign = F.when(F.substring(F.trim(col(text)), 1, 1) == "-", -1.0).otherwise(1.0)
    return sign * (value[0] + value[1] / 60 + value[2] / 3600) * (15.0 if hours else 1.0)


def duration_text(seconds: Column | str) -> Column:
    s = F.floor(col(seconds)).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def bytes_text(size: Column | str) -> Column:
    v = col(size).cast("double")
    out = F.format_string("%.0f B", v)
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(v >= 1024.0**k, F.format_string(f"%.1f {unit}", v / 1024.0**k)).otherwise(out)
    return out


def measurement_area(fwhm: Column | str, growth: float = 1.0) -> Column:
    """Area of a circle as wide as the profile at a tenth of its maximum, times ``growth``."""
    r = F.lit(0.5 * growth * TENTH_MAX) * col(fwhm)
    return F.lit(math.pi) * r * r


def psf_signal(flux: Column | str, fwhm: Column | str, noise: Column | str, sky: Column | str, growth: float = 1.0) -> Column:
    """flux^2 / (noise * sky) / area; NULL unless all are positive and finite."""
    f, n, m, a = finite(flux), finite(noise), finite(sky), measurement_area(finite(fwhm), growth)
    return F.when((f > 0) & (n > 0) & (m > 0) & (a > 0), f * f / (n * m) / a)


def psf_signal_normalised(flux, fwhm, noise, sky, scale, offset, growth: float = 1.0) -> Column:
    """The same after a frame is normalised by scale and offset."""
    s = F.when(finite(scale) > 0, finite(scale))
    return psf_signal(s * col(flux), fwhm, s * col(noise), s * col(sky) + col(offset), growth)


def luma(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return F.lit(LUMA[0]) * col(r) + F.lit(LUMA[1]) * col(g) + F.lit(LUMA[2]) * col(b)


def lanczos(t: Column | str, a: int = 3) -> Column:
    x = col(t) * F.lit(math.pi)
    inner = F.sin(x) / x * F.sin(x / a) / (x / a)
    return F.when(F.abs(col(t)) < 1e-8, 1.0).when(F.abs(col(t)) >= a, 0.0).otherwise(inner)


def cubic_terms(x: Column | str, y: Column | str) -> list[Column]:
    """The ten terms of a cubic polynomial in two variables."""
    x, y = col(x), col(y)
    return [F.lit(1.0), x, y, x * x, x * y, y * y, x * x * x, x * x * y, x * y * y, y * y * y]


def polynomial(coefficients: list[float], x, y) -> Column:
    return sum((F.lit(float(c)) * t for c, t in zip(coefficients, cubic_terms(x, y), strict=True)), F.lit(0.0))


def similarity(matrix: list[list[float]], x, y) -> tuple[Column, Column]:
    """A point under a 3x3 matrix."""
    (a, b, c), (d, e, f), (g, h, i) = matrix
    x, y = col(x), col(y)
    w = F.lit(g) * x + F.lit(h) * y + F.lit(i)
    return (F.lit(a) * x + F.lit(b) * y + F.lit(c)) / w, (F.lit(d) * x + F.lit(e) * y + F.lit(f)) / w


def bayer_colour(pattern: str, y: Column | str, x: Column | str) -> Column:
    """R, G or B of a site of a 2x2 colour filter pattern such as RGGB."""
    site = (col(y) % 2) * 2 + col(x) % 2
    out = F.lit(pattern[3])
    for k in (2, 1, 0):
        out = F.when(site == k, pattern[k]).otherwise(out)
    return out
