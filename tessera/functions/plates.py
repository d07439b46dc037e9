"""License plates, vehicle types and lanes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plate_compact(c: Column) -> Column:
    """Upper case, no white space."""
    return F.regexp_replace(F.upper(F.trim(c)), r"\s+", "")


def plate_upper(c: Column) -> Column:
    return F.upper(F.trim(c))


def plate_key(c: Column) -> Column:
    """Upper case without spaces, dashes and dots: equal for all spellings of a plate."""
    return F.translate(F.upper(F.trim(c)), " -.", "")


# Words on signs that are no plates.
SIGN_WORDS = [
    "NUMBER", "PLATE", "CAMERA", "SAFEPRO", "AUTOMATIC", "RECOGNITION", "TRANSIT", "STOP", "SYSTEM", "STAY", "LOCAL",
    "APPLY", "NOW", "HOME", "ALPERTON", "LONDON", "STAGECOACH", "ARRIVA", "BUS", "ROUTE", "METROLINE", "GOAHEAD", "COM",
    "WWW", "HTTP", "TEL", "HOTLINE", "WELCOME", "POLICE", "EMERGENCY", "SPEED", "LIMIT", "ZONE", "LANE", "KEEP", "CLEAR",
    "EXIT", "STALL6A", "1WYLC94L",
]


def _digits_for(c: Column) -> Column:
    return F.translate(c, "OIS", "015")


def _letters_for(c: Column) -> Column:
    return F.translate(c, "01", "OI")


def _let(value: Column, then) -> Column:  # noqa: ANN001
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def plate_format(raw: Column) -> Column:
    """The plate in its national spelling, or null where the text cannot be one."""

    def repaired(t: Column) -> Column:
        return F.concat(_letters_for(F.substring(t, 1, 2)), _digits_for(F.substring(t, 3, 2)), F.lit(" "), _letters_for(F.substring(t, 5, 3)))

    def spelled(t: Column) -> Column:
        made = F.when((F.length(t) == 7) & repaired(t).rlike("^[A-Z]{2}[0-9]{2} [A-Z]{3}$"), repaired(t))
        for pattern, spelling in _SPELLINGS:
            if spelling:
                made = made.when(t.rlike(pattern), F.regexp_replace(t, pattern, spelling))
            else:
                part = lambda k, p=pattern: F.regexp_extract(t, p, k)
                made = made.when(t.rlike(pattern), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), part(3), part(4)))
        made = made.when(F.length(t) == 7, F.concat(F.substring(t, 1, 4), F.lit(" "), F.substring(t, 5, 3)))
        return made.when(F.length(t).between(6, 8), t)

    def prefixed(t: Column) -> Column:
        return F.when(t.startswith("02") & (F.length(t) >= 8), F.concat(F.lit("KA"), t)).otherwise(t)

    def stripped(t: Column) -> Column:
        """Without a stray first stroke before a seven-character plate."""
        return F.when(t.rlike("^[LIT1][A-Z0-9]{2}[0-9]{2}[A-Z]{3}$"), F.substring(t, 2, 12)).otherwise(t)

    def whole(clean: Column) -> Column:
        usable = F.length(clean).between(5, 12) & clean.rlike("[0-9]") & clean.rlike("[A-Z]") & ~clean.rlike("|".join(SIGN_WORDS))
        state_fixed = _let(F.regexp_replace(stripped(clean), "^(IXA|1XA|XA|4A)", "KA"), prefixed)
        return F.when(usable, _let(state_fixed, spelled))

    return _let(F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", "")), whole)


# National forms in the order in which they are tried.
_SPELLINGS = [
    (r"^([0-9]{2}[A-Z]{1,2})([0-9]{3})([0-9]{2})$", "$1-$2.$3"),
    (r"^([0-9]{2}[A-Z]{1,2})([0-9]{4})$", "$1-$2"),
    (r"^([A-Z]{2})0?([1-9]|0[1-9]|[1-9][0-9])([A-Z]{1,3})([0-9]{3,4})$", ""),
    (r"^([A-Z0-9]{3,4})([0-9]{3,4})$", "$1-$2"),
]


def vehicle_type(plate: Column) -> Column:
    return F.when(plate.rlike("[RH]"), "Container").when(plate.contains("C"), "Xe tải").otherwise("Xe con")


def lane_of_zone(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("2") | low.contains("phụ") | low.contains("b"), "IN_2").otherwise("IN_1")


def normal_status(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up.isin("LA", "STRANGER"), "STRANGER").otherwise("KNOWN")


# Other names of the two cameras.
CAMERA_NAMES = {"GATE": "GATE-01", "GATE1": "GATE-01", "GATE_01": "GATE-01", "AREA": "BAI-KIEM", "BAIKIEM": "BAI-KIEM", "BAI_KIEM": "BAI-KIEM"}


def camera(c: Column) -> Column:
    up = F.upper(F.trim(c))
    names = F.create_map(*[F.lit(x) for pair in CAMERA_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, up), up)
