"""Column expressions that take file names, paths and text fields apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of exported clip names and recording names.
CLIP = r"^(.+?)__(.+)__t?(\d+)s__conf(?:<)?([0-9.]+?)>?\.wav$"
STARTED = r"S?(\d{8}T\d{6})"
COORDS = r"([+-]\d+\.\d+)([+-]\d+\.\d+)"
SCORED_PREFIX = r"^\d+\.\d+_\d+_"
WINDOW_SUFFIX = r"(__t\d+(?:\.\d+)?s(?:__conf[\d.]+)?|__\d+s__conf[\d.]+|__pulse\d+|__chunk\d+|__bout\d+_\d+p|_\d+\.\d+s_\d+\.\d+s)$"
#: Reviewers' tags for anything that is not the target.
JUNK_TAGS = ("noise", "noize", "n", "false", "fp", "junk", "unknown", "insect", "bird", "wind", "rain")
TRUE_TEXT, FALSE_TEXT = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def clip_species(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(name, CLIP, 1))


def clip_recording(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(name, CLIP, 2))


def clip_start(name: Column) -> Column:
    """The start second; -1 where the name is of another shape."""
    return F.coalesce(blank_to_null(F.regexp_extract(name, CLIP, 3)).cast("int"), F.lit(-1))


def clip_confidence(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(name, CLIP, 4)).cast("double")


def recording_start(name: Column) -> Column:
    """When a recording began, from its name; any zone offset that follows is ignored, as in the field notes."""
    return F.try_to_timestamp(blank_to_null(F.regexp_extract(name, STARTED, 1)), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")


def detected_at(started: Column, start_s: Column) -> Column:
    return started + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), start_s.cast("decimal(18,6)"))


def hour_fraction(at: Column) -> Column:
    return F.hour(at) + F.minute(at) / 60


def latitude(name: Column) -> Column:
    """Null without coordinates and where the receiver had no fix (all zeros)."""
    return _fixed(name, 1)


def longitude(name: Column) -> Column:
    return _fixed(name, 2)


def _fixed(name: Column, k: int) -> Column:
    pair = [blank_to_null(F.regexp_extract(name, COORDS, i)).cast("double") for i in (1, 2)]
    return F.when((F.abs(pair[0]) > 1e-6) | (F.abs(pair[1]) > 1e-6), pair[k - 1])


def station_from_path(path: Column, prefix: str) -> Column:
    """The first path part that begins with ``prefix``."""
    return F.get(F.filter(F.split(path, r"[/\\]"), lambda x: F.startswith(x, F.lit(prefix))), F.lit(0))


def recording_stem(path: Column) -> Column:
    """The name without a real extension: a coordinate's decimals are none."""
    return F.regexp_replace(base_name(path), r"(?i)\.(wav|csv)$", "")


def source_group(path: Column) -> Column:
    """The recording that a clip was cut from."""
    stem = F.regexp_replace(base_name(path), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(stem, SCORED_PREFIX, ""), WINDOW_SUFFIX, "")


def _parts(indir: Column) -> Column:
    return F.filter(F.split(indir, r"[\\/]"), lambda x: x != "")


def site_from_indir(indir: Column) -> Column:
    return F.coalesce(F.try_element_at(_parts(indir), F.lit(-1)), F.lit(""))


def species_from_indir(indir: Column, name: Column) -> Column:
    return F.coalesce(F.try_element_at(_parts(indir), F.lit(-2)), clip_species(name), F.lit(""))


def verdict(tag: Column, blank_is_confirmed: bool = True) -> Column:
    t = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    return F.when(t == "", "call" if blank_is_confirmed else "unreviewed").when(t.isin(*JUNK_TAGS), "false_positive").otherwise("call")


def period(name: Column) -> Column:
    """YYYY-MM of the first date in a name; null without one."""
    day = F.regexp_extract(name, r"(\d{4})(\d{2})\d{2}T\d{6}", 0)
    return F.when(day != "", F.concat(F.substring(day, 1, 4), F.lit("-"), F.substring(day, 5, 2)))


def possible_stations(folder: Column, name: Column, by_coord: Column, no_fix: Sequence[str], no_fix_mark: str, no_fix_period: str, folder_station: str) -> Column:
    """Folder evidence (the first group of the pattern ``folder_station``), else the stations of the name's coordinates, else those without a receiver, else none."""
    number = F.regexp_extract(folder, folder_station, 1)
    coords = F.regexp_extract(name, COORDS, 0)
    none = F.array().cast("array<string>")
    return (
        F.when(number != "", F.array(F.upper(number)))
        .when(coords != "", F.coalesce(by_coord, none))
        .when((period(name) == no_fix_period) & F.contains(name, F.lit(no_fix_mark)), F.array(*(F.lit(x) for x in no_fix)))
        .otherwise(none)
    )


def only_station(stations: Column) -> Column:
    return F.when(F.size(stations) == 1, stations[0]).otherwise("")


def canonical_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(path), r"\\", "/"))


def to_flag(text: Column) -> Column:
    """True, false, or null for text that is neither."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin(*TRUE_TEXT), True).when(t.isin(*FALSE_TEXT), False)


def to_count(text: Column) -> Column:
    """A whole number from 0, else null."""
    return F.when(F.trim(text.cast("string")).rlike(r"^\d+$"), F.expr("0") + F.trim(text.cast("string")).cast("bigint"))


def station_list(text: Column) -> Column:
    """A ;-joined list as a sorted array without blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ";"), F.trim), lambda x: x != "")))


def clip_name(recording: Column, start_s: Column, confidence: Column) -> Column:
    return F.format_string("%s__t%05ds__conf%.2f.wav", recording, start_s.cast("int"), confidence)


def clip_lower(start_s: Column, padding: float) -> Column:
    return F.greatest(F.lit(0.0), start_s - padding)


def clip_upper(end_s: Column, length_s: Column, padding: float) -> Column:
    return F.least(length_s, end_s + padding)


def analysis_offset(start_s: Column, padding: float) -> Column:
    """Where the window begins inside its padded clip."""
    return F.least(start_s, F.lit(padding))


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance."""
    dy = (lat1 - lat2) * 110.574
    dx = (lon1 - lon2) * 111.320 * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def disagreement(verdict_col: Column, cleanup: Column) -> Column:
    return F.when((verdict_col == "call") & (cleanup == "suspicious"), "wrongly_flagged").when((verdict_col == "false_positive") & (cleanup == "clean"), "missed").otherwise("none")


def fold_label(label: Column, drop: Sequence[str] = (), into_background: Sequence[str] = (), background: str = "Background") -> Column:
    """Null for classes to drop; classes to fold become background."""
    return F.when(label.isin(*drop), F.lit(None)).when(label.isin(*into_background), F.lit(background)).otherwise(label) if drop or into_background else label
