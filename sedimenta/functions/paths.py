"""Archive paths as columns: sort keys, safety, and the depth that a link target reaches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that no component's stem may have.
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)))


def little_endian_hex(n: Column) -> Column:
    """16 hex digits of a non-negative long, lowest byte first."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.concat(*[F.substring(h, k, 2) for k in range(15, 0, -2)])


def sort_key(path: Column) -> Column:
    """Bytes that order paths: for each component its encoding (0: UTF-8), its length as a
    little-endian long, and its bytes. Shorter components come before longer ones.
    """
    return F.unhex(F.array_join(F.transform(F.split(path, "/"), lambda c: F.concat(F.lit("00"), little_endian_hex(F.octet_length(c)), F.hex(F.encode(c, "UTF-8")))), ""))


def path_problem(path: Column, devices: bool = True) -> Column:
    """Why a relative path is unsafe: empty, absolute, a parent, a separator or NUL inside, a device name; null if it's safe.

    Empty components and `.` are dropped, as walking a path drops them.
    """
    parts = F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))
    stem = lambda c: F.upper(F.split(F.regexp_replace(c, r"[. ]+$", ""), r"\.")[0])
    out = (
        F.when(path.isNull(), "empty")
        .when(path.startswith("/"), "absolute")
        .when(F.size(parts) == 0, "empty")
        .when(F.exists(parts, lambda c: c == ".."), "parent")
        .when(F.exists(parts, lambda c: c.contains("\\") | c.contains("\0")), "separator")
    )
    if devices:
        out = out.when(F.exists(parts, lambda c: stem(c).isin(*DEVICES) | c.rlike(r"[. ]$") | c.contains(":")), "device")
    return out


def resolves_within(path: Column, target: Column) -> Column:
    """Whether a relative link target, read from the link's folder, never climbs above the root."""
    steps = F.filter(F.split(target, "/"), lambda c: (c != "") & (c != "."))
    depth = F.aggregate(steps, (F.size(F.split(path, "/")) - 1).cast("int"), lambda d, c: F.when(d < 0, d).when(c == "..", d - 1).otherwise(d + 1))
    return ~target.startswith("/") & (F.size(steps) > 0) & (depth >= 0)


def link_target(target: Column) -> Column:
    """The components of a relative link target: `..` stays, `.` and empty ones go. Null for absolute targets and those without components."""
    steps = F.filter(F.split(target, "/"), lambda c: (c != "") & (c != "."))
    return F.when(~target.startswith("/") & (F.size(steps) > 0), steps)


def path_within(path: Column, root: Column) -> Column:
    """Whether a normalised path is the root or lies below it, component by component."""
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
