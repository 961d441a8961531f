"""Names and paths as column expressions: base-name normalisation, name checks, relative paths, display forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that a component's stem may not have, and the directional control characters.
RESERVED_STEMS = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
BIDI = "[‎‏؜‪-‮⁦-⁩]"
PASSES = 8


def _suffix_rule(suffix: str) -> tuple[str, str]:
    """A literal at the end of the stem; the stem ends at the last dot that isn't the first character."""
    s = re.escape(suffix)
    return rf"(?s)^(?:(.+){s}(\.[^.]*)|(\.[^.]*|[^.]+){s})\z", "$1$3$2"


#: In order within a pass: copy suffix, host suffix, two counters, backup tilde, lock prefix, sync-backup suffix.
RULES: tuple[tuple[str, str], ...] = (
    _suffix_rule(" (conflicted copy)"),
    (r"(?s)^(?:(.+)-DESKTOP-[0-9A-Za-z]{6,12}(\.(?![^.]*-DESKTOP-)[^.]*)|(\.[^.]*|[^.]+)-DESKTOP-[0-9A-Za-z]{6,12})\z", "$1$3$2"),
    _suffix_rule(" (1)"),
    _suffix_rule(" (2)"),
    (r"(?s)^(.+)~\z", "$1"),
    (r"(?s)^~\$(.+)\z", "$1"),
    (r"(?s)^(.+)\.sb-[0-9a-f]{1,32}(\.(?!sb-)[^.]*)\z", "$1$2"),
)
#: A name without any of these is its own base name, whatever the passes.
MARKED = r"\(conflicted copy\)|-DESKTOP-| \([12]\)|~|\.sb-"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalize_base_name(name: Column) -> Column:
    """The name without what sync tools add to copies: the rules in order, until nothing changes or PASSES times.

    A pass is one lambda body over an array of pass numbers, so the plan holds seven replacements, not fifty-six.
    """

    def once(value: Column, _: Column) -> Column:
        for pattern, to in RULES:
            value = F.regexp_replace(value, pattern, to)
        return value

    return F.when(name.rlike(MARKED), F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), name, once)).otherwise(name)


def is_valid_name(path: Column) -> Column:
    """A safe relative path: no control character, empty, dot, reserved or rewritten component, extension of at most 255."""
    parts = F.split(F.translate(path, "\\", "/"), "/", -1)
    stem = lambda x: F.upper(F.substring_index(x, ".", 1))
    good = lambda x: (x != "") & ~x.isin(".", "..") & ~x.rlike(r"[. ]\z") & ~stem(x).isin(*RESERVED_STEMS)
    extension = F.element_at(F.split(F.element_at(parts, -1), r"\.", -1), -1)
    fits = ~F.element_at(parts, -1).contains(".") | (F.char_length(extension) <= 255)
    return F.coalesce((path != "") & ~path.rlike(r"[\x00-\x1f\x7f]") & F.forall(parts, good) & fits, F.lit(False))


def canonical_name(path: Column) -> Column:
    """``path`` with / separators; an extension over 255 characters is cut; null for any other name that isn't valid."""
    p = F.translate(path, "\\", "/")
    cut = F.regexp_replace(p, r"(?s)(\.[^./]{255})[^./]+\z", "$1")
    return F.when(is_valid_name(p), p).when(is_valid_name(cut), cut)


def has_bidi(path: Column) -> Column:
    return F.coalesce(path.rlike(BIDI), F.lit(False))


def relative(path: Column, root: str) -> Column:
    p, base = F.translate(path, "\\", "/"), root.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substr(p, F.lit(len(base) + 1))).otherwise(p)


def depth(path: Column, root: str) -> Column:
    """Components below ``root``; 0 outside it."""
    base = root.rstrip("/") + "/"
    rest = F.regexp_replace(F.substr(path, F.lit(len(base) + 1)), "/+$", "")
    return F.when(path.startswith(base) & (rest != ""), F.size(F.filter(F.split(rest, "/"), lambda x: x != ""))).otherwise(0)


def contained(path: Column, root: str) -> Column:
    """Under ``root`` at a component boundary."""
    base = root.rstrip("/")
    return path.startswith(base + "/") | (path == base)


def path_identity(path: Column) -> Column:
    """A file identity where the volume has none."""
    return F.concat(F.lit("path:"), F.sha2(F.lower(path).cast("binary"), 256))


def hash_path(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB of 1024, with up to two decimals."""

    def scaled(by: int, unit: str) -> Column:
        text = F.format_string("%.2f", F.round(n.cast("decimal(38,10)") / F.lit(by), 2).cast("double"))
        return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit(f" {unit}"))

    return F.when(n >= 1 << 30, scaled(1 << 30, "GB")).when(n >= 1 << 20, scaled(1 << 20, "MB")).when(n >= 1 << 10, scaled(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_ticks(ticks: Column) -> Column:
    """UTC with milliseconds; the session's time zone plays no part."""
    ms = F.floor((ticks - 621_355_968_000_000_000) / 10_000).cast("long")
    day, rest = F.floor(ms / 86_400_000).cast("int"), F.pmod(ms, F.lit(86_400_000))
    clock = F.format_string("T%02d:%02d:%02d.%03dZ", F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60, rest % 1000)
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd"), clock)
