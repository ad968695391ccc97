"""Column functions on names, units and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings and their canonical key, after lower-casing and translating µ, μ and ².
UNIT_ALIASES = {
    "org/g": "copies/g", "organisms/g": "copies/g", "mcg/dl": "ug/dl", "mcg/g": "ug/g", "mcg/ml": "ug/ml",
    "mg/dl (calc)": "mg/dl", "g/dl (calc)": "g/dl", "iu/l": "u/l", "nanomol/l": "nmol/l", "ml/min/1.73m2": "ml/min/1.73",
    "uiu/ml": "miu/l", "x10e3/ul": "k/ul", "thousand/ul": "k/ul", "x10e6/ul": "m/ul", "million/ul": "m/ul", "% by wt": "%",
}


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\s ﻿]+|[\s ﻿]+$", "")


def normalize_name(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)), F.lit(""))


def canonical_unit(c: Column) -> Column:
    """The canonical key of a unit; null for null and blank."""
    key = F.translate(F.lower(trimmed(c)), "µμ²", "uu2")
    known = F.create_map(*[F.lit(x) for kv in UNIT_ALIASES.items() for x in kv])
    return F.nullif(F.coalesce(F.element_at(known, key), key), F.lit(""))


def in_order(c: Column) -> Column:
    """A text to sort by as its readers would: letters before accents before case, small letters first; ties by code point are
    for the caller to settle."""
    return F.collate(c, "UNICODE")


def format_range(low: Column, high: Column, fmt) -> Column:
    return let(
        F.struct(fmt(low).alias("low"), fmt(high).alias("high")),
        lambda p: F.when(low.isNotNull() & high.isNotNull(), F.concat(p["low"], F.lit("–"), p["high"]))
        .when(low.isNotNull(), F.concat(F.lit("≥ "), p["low"])).when(high.isNotNull(), F.concat(F.lit("≤ "), p["high"])).otherwise("—"),
    )


def provider_display(c: Column) -> Column:
    words = F.filter(F.split(c, r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def csv_cell(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), "").when(c.rlike(r'[,"\r\n]'), quoted).otherwise(c)


def trend(history: Column) -> Column:
    """up or down if the last value is over 5 % above or below the mean of those before it; else flat."""
    n = F.size(history)
    prior = F.aggregate(F.slice(history, 1, F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x) / (n - 1)
    change = (F.element_at(history, -1) - prior) / F.abs(prior)
    return F.when(n < 2, "flat").when(F.abs(prior) < 1e-9, "flat").when(change > 0.05, "up").when(change < -0.05, "down").otherwise("flat")


def trend_of(n: Column, total: Column, last: Column) -> Column:
    """The same from a count, a sum and the last value, so that no history is collected."""
    prior = (total - last) / F.nullif(n - 1, F.lit(0))
    change = (last - prior) / F.abs(F.nullif(prior, F.lit(0.0)))
    return F.when((n < 2) | (F.abs(prior) < 1e-9), "flat").when(change > 0.05, "up").when(change < -0.05, "down").otherwise("flat")


def let(value: Column, then) -> Column:
    """then(value), where value is worked out once however often `then` names it."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def _parts(x: Column) -> Column:
    """Digits d, without zeros at either end, and point n of a positive double: 0.d times ten to the n."""
    s = x.cast("string")
    part = lambda i: F.regexp_extract(s, r"^(\d+)\.(\d+)(?:E(-?\d+))?$", i)
    every = F.concat(part(1), part(2))
    bare = F.regexp_replace(every, "^0+", "")
    point = F.length(part(1)) + F.coalesce(part(3).try_cast("int"), F.lit(0)) - F.length(every) + F.length(bare)
    return F.struct(_bare_end(bare).alias("d"), point.alias("n"))


def _bare_end(digits: Column) -> Column:
    return F.regexp_replace(digits, "0+$", "")


def _nearest(x: Column, p: Column) -> Column:
    """Of whole numbers that a long holds the digits that come nearest, where older Java prints others that read as the same."""
    whole = F.when((x >= float(2**53)) & (x < float(2**63)), x.cast("long").cast("decimal(19,0)"))
    out = p
    for left in (1, 2, 3):
        near = F.bround(whole, -left).cast("decimal(20,0)").cast("string")
        fits = whole.isNotNull() & (F.length(p["d"]) >= 16) & (F.length(near) == F.length(p["d"]) + left) & (near.try_cast("double") == x)
        out = F.when(fits, F.struct(_bare_end(near).alias("d"), p["n"].alias("n"))).otherwise(out)
    return out


def _shorter(x: Column, p: Column) -> Column:
    """The same with a digit less where that still reads as x: older Java prints some doubles with more digits than they need."""
    digits = p["d"].try_cast("decimal(20,0)")
    less = F.floor(digits / 10).cast("decimal(20,0)")
    near = F.floor((digits + 5) / 10).cast("decimal(20,0)")
    power = (p["n"] - F.length(p["d"]) + 1).cast("string")

    def cut(whole: Column) -> Column:
        s = whole.cast("string")
        return F.struct(_bare_end(s).alias("d"), (p["n"] + F.length(s) - F.length(p["d"]) + 1).alias("n"))

    reads = lambda whole: (whole > 0) & (F.concat(whole.cast("string"), F.lit("E"), power).try_cast("double") == x)
    other = less + less + 1 - near
    return F.when((F.length(p["d"]) < 16) & (x > 1e-300), p).when(reads(near), cut(near)).when(reads(other), cut(other)).otherwise(p)


#: Numbers below this with three places at most have 15 digits at most, so no shorter digits read as the same double.
PLAIN = 1e12


def _thousandths(k: Column) -> Column:
    """k thousandths, a long that isn't negative, as a decimal without trailing zeros."""
    whole, part = F.call_function("div", k, F.lit(1000)).cast("string"), k % 1000
    return F.when(part == 0, whole).otherwise(F.concat(whole, F.lit("."), F.rtrim(F.lpad(part.cast("string"), 3, "0"), F.lit("0"))))


def js_number(c: Column) -> Column:
    """A double as a browser prints it: the shortest digits that read as the same number; an exponent from 1e21 on and below
    1e-6; whole numbers without a point, a negative zero without a sign."""
    x = F.abs(c)
    near = F.rint(x * 1000.0).cast("long")

    def text(p: Column) -> Column:
        d, n, k = p["d"], p["n"], F.length(p["d"])
        power = F.concat(F.when(n > 0, "+").otherwise("-"), F.abs(n - 1).cast("string"))
        tail = F.when(k > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), k))).otherwise("")
        return (
            F.when((k <= n) & (n <= 21), F.rpad(d, n, F.lit("0"))).when((n > 0) & (n <= 21), F.concat(F.substring(d, F.lit(1), n), F.lit("."), F.substring(d, n + 1, k)))
            .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d)).otherwise(F.concat(F.substring(d, 1, 1), tail, F.lit("e"), power))
        )

    digits = _parts(x)
    for better in (_shorter, _shorter, _nearest):
        digits = let(digits, lambda p, better=better: better(x, p))
    printed = let(digits, text)
    sign = F.when(c < 0, "-").otherwise("")
    plain = (x < PLAIN) & (near / F.lit(1000.0) == x)
    return F.when(c.isNull(), None).when(F.isnan(c), "NaN").when(c == 0, "0").when(plain, F.concat(sign, _thousandths(near))).when(x == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, printed))


def rounded(c: Column) -> Column:
    """A double at three places, ties of its exact value away from zero, as a double again.

    The fraction times 2 ** 62 is a whole number (only in fractions below 2 ** -10, where no tie is, something is cut off), so
    what follows is exact."""
    x = F.abs(c)
    whole = F.floor(x)
    fraction = ((x - whole) * float(2**62)).cast("long").cast("decimal(19,0)")
    half, one = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (62, 63))
    thousandths = F.call_function("div", fraction * F.lit(2000).cast("decimal(4,0)") + half, one)
    near = F.concat((whole + F.when(thousandths == 1000, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, F.lit("0"))).cast("double")
    return F.when(x >= float(2**52), c).when(c < 0, -near).otherwise(near)


def format_value(c: Column) -> Column:
    """Whole numbers from 100 on as they are, others to three places without trailing zeros; a dash if it isn't finite."""
    x = F.abs(c)
    # The fraction times 2 ** 62 in two halves of 31 bits, so that the products stay in a long; see `rounded`.
    bits = ((x - F.floor(x)) * float(2**62)).cast("long")
    upper, lower = F.shiftright(bits, 31) * 2000, F.shiftright(bits.bitwiseAND(F.lit(2**31 - 1)) * 2000, 31)
    k = F.floor(x) * 1000 + F.shiftright(upper + lower + F.lit(2**31), 32)
    plain = F.concat(F.when((c < 0) & (k > 0), "-").otherwise(""), _thousandths(k))
    return F.when(c.isNull(), None).when(F.isnan(c) | (x == float("inf")), "—").when(x < PLAIN, plain).otherwise(let(F.when(c == F.floor(c), c).otherwise(rounded(c)), js_number))


def format_bytes(c: Column) -> Column:
    return (
        F.when(c.isNull(), "—").when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, F.format_string("%.1f KB", c / 1024.0))
        .otherwise(F.format_string("%.1f MB", c / 1048576.0))
    )


def point_key(report: Column, provider: Column, day: Column) -> Column:
    """Names a chart point: report, provider and milliseconds of its date."""
    return F.concat_ws("-", report.cast("string"), provider, F.unix_millis(day.cast("timestamp")).cast("string"))


def percent_change(old: Column, new: Column) -> Column:
    """Signed change in percent to one place, as text; a dash if either is null or the old value is 0."""
    change = (new - old) / F.nullif(old, F.lit(0.0)) * 100
    return F.when(change.isNull(), "—").otherwise(F.concat(F.when(change >= 0, "+").otherwise(""), F.format_string("%.1f", change), F.lit("%")))


# Labels of categories; others are shown as they are.
LABELS = {
    "cbc": "CBC", "cmp": "Comprehensive metabolic", "lipids": "Lipids", "inflammation": "Inflammation", "thyroid": "Thyroid", "hormones": "Hormones", "nutrients": "Nutrients",
    "kidney": "Kidney", "liver": "Liver", "glycemic": "Glycemic", "gi-microbiome": "GI · microbiome", "gi-pathogens": "GI · pathogens", "gi-inflammation": "GI · inflammation",
    "gi-digestion": "GI · digestion", "sibo": "SIBO", "aging": "Aging", "imaging": "Imaging", "organic-acids": "Organic acids", "mycotoxins": "Mycotoxins", "other": "Other",
}
LABEL_SQL = "case category " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items()) + " else category end"


def category_label(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), c), c)


def text_or_null(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(trimmed(c), F.lit(""))


def coerce_tags(c: Column) -> Column:
    """The strings of a JSON array; other items are left out, and what can't be read is an empty array."""
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    words = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(words, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))
