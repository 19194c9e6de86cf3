"""Scalar functions of one row: numbers, text, dates, JSON."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(x: Column) -> Column:
    """-1, 0 or 1; 0 for null."""
    return F.coalesce(F.signum(x), F.lit(0.0)).cast("int")


def choose(long: Column, short: Column) -> Column:
    """1 where ``long`` holds, else -1 where ``short`` does, else 0; an unknown condition doesn't hold."""
    return F.when(long, 1).when(short, -1).otherwise(0)


def ratio(x: Column, y: Column) -> Column:
    return x / F.nullif(y, F.lit(0.0))


def finite(x: Column, default: float = 0.0) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(x)


def positive_part(x: Column) -> Column:
    """max(x, 0), null for null (greatest alone would give 0)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


# Fixed coefficients of the rational approximation to the inverse normal distribution (Acklam).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_TAIL = 0.02425
EULER = 0.5772156649015329


def horner(coefficients, x):
    """c0 * x**k + c1 * x**(k - 1) + … + ck, for numbers and for columns."""
    out = coefficients[0] * x
    for c in coefficients[1:-1]:
        out = (out + c) * x
    return out + coefficients[-1]


def norm_ppf(p: Column) -> Column:
    """The inverse of the standard normal distribution; infinite outside (0, 1)."""
    tail = lambda q: horner(PPF_C, q) / horner((*PPF_D, 1.0), q)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    middle = horner(PPF_A, q * q) * q / horner((*PPF_B, 1.0), q * q)
    return F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).when(p < PPF_TAIL, tail(low)).when(p > 1 - PPF_TAIL, -tail(high)).otherwise(middle)


def ppf(p: float) -> float:
    """The same for one number."""
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    if PPF_TAIL <= p <= 1 - PPF_TAIL:
        q = p - 0.5
        return horner(PPF_A, q * q) * q / horner((*PPF_B, 1.0), q * q)
    q = math.sqrt(-2 * math.log(min(p, 1 - p)))
    return math.copysign(1, p - 0.5) * -1 * horner(PPF_C, q) / horner((*PPF_D, 1.0), q)


def cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def norm_cdf(x: Column) -> Column:
    """The standard normal distribution: 1/2 plus the density times x + x**3/3 + x**5/15 + …, whose terms are all of one sign."""
    near = F.greatest(F.least(x, F.lit(9.0)), F.lit(-9.0))
    start = F.struct(near.alias("term"), near.alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, lambda s, k: F.struct((s["term"] * near * near / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * near * near / (2 * k + 1)).alias("total")), lambda s: s["total"])
    return 0.5 + F.exp(-near * near / 2) / math.sqrt(2 * math.pi) * series


def round_exact(x: Column, digits: int) -> Column:
    """``x`` to so many decimals, by its exact binary value: 2.675 is a little less than it reads and goes down, true ties go to the even
    digit; a zero keeps the sign of ``x``, so that -0.03 is shown as -0.0. The product with the power of ten is taken with its rounding
    error (both factors split in halves of 26 bits)."""
    scale = 10.0**digits
    halves = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)
    product, high, top = x * scale, halves(x), scale * 134217729.0 - (scale * 134217729.0 - scale)
    low, bottom = x - high, scale - top
    error = ((high * top - product) + high * bottom + low * top) + low * bottom
    below = F.floor(product).cast("double")
    over = product - below
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (below % 2 != 0))))
    rounded = (below + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(rounded == 0, x * 0.0).otherwise(rounded)


def unescape(text: Column) -> Column:
    """HTML character references decoded, numeric ones and the named ones of the standard."""
    from html.entities import html5

    named = {k.rstrip(";"): v for k, v in sorted(html5.items()) if k.endswith(";")}
    names = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    pattern = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern, -1)

    def char(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("long")
        spelt = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), spelt), F.get(F.transform(F.array(name), lambda n: F.try_element_at(names, n)), 0), F.concat(F.lit("&"), name, F.lit(";")))

    decoded = F.array_join(F.zip_with(between, F.concat(F.transform(found, char), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


# ---------------------------------------------------------------- text


def normal_title(title: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(title, "\\s+", " ")))


def publisher(title: Column) -> tuple[Column, Column]:
    """(headline, publisher): what follows the last `` - `` if it is shorter than 60 characters and something comes before it,
    else an empty publisher."""
    tail = F.substring_index(title, " - ", -1)
    head = F.left(title, F.greatest(F.length(title) - F.length(tail) - 3, F.lit(0)))
    named = title.contains(" - ") & (F.length(tail) < 60) & (head != "")
    return F.trim(F.when(named, head).otherwise(title)), F.when(named, F.trim(tail)).otherwise(F.lit(""))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1), F.lit("")), "^www\\.", "")


def age_label(seconds: Column) -> Column:
    """``2d ago``, ``3h ago``, ``5m ago`` or ``just now``."""
    unit = lambda size, mark: F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{mark} ago"))
    return F.when(seconds >= 86400, unit(86400, "d")).when(seconds >= 3600, unit(3600, "h")).when(seconds >= 60, unit(60, "m")).otherwise("just now")


def json_object(text: Column) -> Column:
    """The JSON object that a noisy text is, inside code fences perhaps, or else the outermost {...} in it; null without one, and
    null for a text that is another JSON value, as an array of objects is."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*```[a-zA-Z]*\n?", ""), r"\n?```\s*$", ""))
    body = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    other = F.coalesce(F.json_array_length(plain), F.lit(-1)) >= 0
    return F.when(~other & F.json_object_keys(body).isNotNull() & (body != ""), body)


def slug(title: Column) -> Column:
    """Safe in file names and in links: marks of links, paths and headings become blanks, and a comma is followed by one."""
    plain = F.replace(F.regexp_replace(title, r"[\[\]#^|:\\/]+", " "), F.lit(","), F.lit(", "))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def days_since(day: Column, now: Column) -> Column:
    """Days from a date given as text; a very large number if it is none."""
    return F.coalesce(F.datediff(now, F.try_to_date(day)).cast("double"), F.lit(1e9))
