"""Scalar text functions as Column expressions."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_text(value: Column, limit: int = 500) -> Column:
    """NUL to space, trimmed, cut to the limit with an ellipsis."""
    t = F.trim(F.regexp_replace(value, "\\x00", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def flat_text(value: Column, limit: int = 500) -> Column:
    """A JSON value as text: of an object the first filled name, title, value, label or text, else the whole."""
    inner = [F.nullif(F.trim(F.get_json_object(value, f"$.{k}")), F.lit("")) for k in ("name", "title", "value", "label", "text")]
    return F.substring(F.coalesce(*inner, value, F.lit("")), 1, limit)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def terms_in(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur anywhere in the text, sorted: substring matching, so 'seed' is in 'linseed'."""
    some = F.array(*[F.lit(t) for t in sorted(set(terms))])
    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(some, lambda t: F.contains(low, t)))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}._-]", "_")


def orientation(width: Column, height: Column, low: float = 0.95, high: float = 1.05) -> Column:
    aspect = F.try_divide(width.cast("double"), height.cast("double"))
    return F.when(aspect.isNull() | (width <= 0), "?").when(aspect.between(low, high), "square").when(aspect > high, "landscape").otherwise("portrait")


def resolution_tier(width: Column, height: Column) -> Column:
    side = F.least(width, height)
    return F.when(side <= 64, "low").when(side <= 320, "medium").otherwise("high")


def region_name(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Where the middle of a box lies on a 3 by 3 grid."""
    cx, cy = (x + w / 2) / width, (y + h / 2) / height
    row = F.when(cy < 1 / 3, "top").when(cy > 2 / 3, "bottom").otherwise("middle")
    col = F.when(cx < 1 / 3, "left").when(cx > 2 / 3, "right").otherwise("center")
    return F.concat(row, F.lit("-"), col)


def format_bytes(n: Column) -> Column:
    """Bytes in the largest binary unit that keeps the number at 1 or more: whole bytes and kilobytes (cut off), two
    decimals from megabytes on."""
    out = F.format_string("%d B", n.cast("long"))
    for i, u in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = n / float(1024**i)
        out = F.when(n >= 1024**i, F.format_string("%d KB", F.floor(value)) if i == 1 else F.format_string(f"%.2f {u}", value)).otherwise(out)
    return out


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def percent(value: Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(F.format_number(value * 100, digits), F.lit("%")), F.lit("—"))


def hashed_choice(sha: Column, options: Sequence[int], at: int = 1) -> Column:
    """One of the options by 8 hex digits of a hash."""
    n = F.conv(F.substring(sha, at, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def crop_boxes(width: Column, height: Column, size: int = 224) -> Column:
    """Five native crops (corners and center) as structs x, y; none where the short side is under 1.25 sizes."""
    right, low = width - size, height - size
    box = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero = F.lit(0)
    boxes = F.array(box(zero, zero), box(right, zero), box(zero, low), box(right, low), box(F.floor(right / 2), F.floor(low / 2)))
    return F.when(F.least(width, height) >= 1.25 * size, boxes).otherwise(F.filter(boxes, lambda b: F.lit(False)))
