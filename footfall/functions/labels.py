"""Display labels: resolutions with a terminal name, times in a viewer's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width, height and name of classic terminals. Anonymised screens
# take one of these sizes, and reports show the name beside the size.
TERMINALS = (
    (40, 24, "Commodore 64"),
    (80, 24, "VT100"),
    (80, 25, "IBM PC"),
    (80, 43, "EGA"),
    (80, 50, "VGA"),
    (132, 24, "VT100 wide"),
    (132, 43, "VT220 wide"),
    (128, 48, "Wyse 60"),
    (160, 50, "Sun console"),
    (80, 34, "Atari ST"),
    (64, 32, "ZX Spectrum"),
    (40, 25, "Apple II"),
    (80, 48, "Amiga"),
    (80, 60, "SVGA"),
    (120, 50, "DEC VT320"),
    (80, 30, "xterm"),
)


def resolution_label(size: Column) -> Column:
    names = F.create_map(
        *[F.lit(x) for w, h, name in TERMINALS for x in (f"{w}x{h}", f"{w}×{h} ({name})")]
    )
    return F.coalesce(F.try_element_at(names, size), size)


def display_time(ts: Column, zone: str = "UTC", pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A UTC time in the viewer's zone; '-' when there is none."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    return F.coalesce(F.date_format(local, pattern), F.lit("-"))


def display_date(ts: Column, zone: str = "UTC") -> Column:
    return display_time(ts, zone, "yyyy-MM-dd")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def hour_text(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "HH"), F.lit(":00"))
