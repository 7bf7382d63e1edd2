"""Dates found in free text. Results are ISO text; ``as_date`` gives a checked DATE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curul.functions.text import as_col, clean_text, extract, extract_all, let, matches, normalize_text, rx, strip

# --- fixed values: month and weekday spellings ------------------------------------------------
MONTHS = {
    "enero": "01",
    "febrero": "02",
    "marzo": "03",
    "abril": "04",
    "mayo": "05",
    "junio": "06",
    "julio": "07",
    "agosto": "08",
    "septiembre": "09",
    "setiembre": "09",
    "octubre": "10",
    "noviembre": "11",
    "diciembre": "12",
}
SHORT_MONTHS = {
    "ENE": "01",
    "FEB": "02",
    "MAR": "03",
    "ABR": "04",
    "MAY": "05",
    "JUN": "06",
    "JUL": "07",
    "AGO": "08",
    "SEP": "09",
    "OCT": "10",
    "NOV": "11",
    "DIC": "12",
}
WEEKDAYS = "lunes|martes|miércoles|miercoles|jueves|viernes|sábado|sabado|domingo"
SLASH_DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
LONG_DATE = r"\d{1,2} de [a-záéíóú]+ de \d{4}"
# --- end of fixed values ----------------------------------------------------------------------


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key)


def _spelled(text: Column) -> Column:
    """``12 de marzo de 2025`` to ISO; null for a month nobody knows."""
    piece = lambda parts, i: F.get(parts, F.lit(i))
    # A null month makes the whole date null.
    return let(
        F.split(text, rx(" de ")),
        lambda p: F.concat(
            piece(p, 2),
            F.lit("-"),
            _lookup(MONTHS, normalize_text(piece(p, 1))),
            F.lit("-"),
            F.lpad(piece(p, 0), 2, "0"),
        ),
    )


def iso_date(value: Column | str) -> Column:
    return extract(value, r"\b(\d{4}-\d{2}-\d{2})\b")


def slash_date(value: Column | str) -> Column:
    """d/m/yyyy anywhere in the text."""
    padded = lambda parts, i: F.lpad(F.get(parts, F.lit(i)), 2, "0")
    return let(
        F.split(extract(value, SLASH_DATE), "/"),
        lambda p: F.concat(F.get(p, F.lit(2)), F.lit("-"), padded(p, 1), F.lit("-"), padded(p, 0)),
    )


def has_slash_date(value: Column | str) -> Column:
    return matches(value, SLASH_DATE)


def any_date(value: Column | str) -> Column:
    """ISO if there is one, else d/m/yyyy."""
    return F.coalesce(iso_date(value), slash_date(value))


def exact_slash_date(value: Column | str) -> Column:
    """The whole text is dd/MM/yyyy."""
    text = as_col(value)
    return F.when(
        text.rlike(r"^\d{2}/\d{2}/\d{4}\z"),
        F.concat_ws("-", text.substr(7, 4), text.substr(4, 2), text.substr(1, 2)),
    )


def exact_iso_date(value: Column | str) -> Column:
    """The whole cleaned text is an ISO date other than the all-zero one."""
    text = clean_text(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (text != "0000-00-00"), text)


def long_date(value: Column | str) -> Column:
    """First spelled-out Spanish date."""
    return _spelled(extract(value, rf"\b({LONG_DATE})\b"))


def weekday_date(value: Column | str) -> Column:
    """Spelled-out date, one that follows a weekday preferred."""
    named = extract(value, rf"\b(?:{WEEKDAYS})\s+({LONG_DATE})\b")
    return _spelled(F.coalesce(named, extract(value, rf"\b({LONG_DATE})\b")))


def block_date(value: Column | str) -> Column:
    """Date of a gazette block: three preferred places, else the earliest date of the block."""
    places = (
        rf"Gaceta Parlamentaria,[^.]*?\b({LONG_DATE})\b",
        rf"Presentad[ao] por [^.]*?\b(?:el|la)\s+(?:{WEEKDAYS}),?\s+({LONG_DATE})\b",
        rf"Presentad[ao] por [^.]*?\b({LONG_DATE})\b",
    )
    found = [extract(value, place) for place in places]
    every = F.transform(extract_all(value, rf"\b({LONG_DATE})\b", 1), _spelled)
    earliest = F.array_min(F.filter(every, lambda d: d.isNotNull()))
    return let(
        F.coalesce(*found), lambda place: F.when(place.isNotNull(), _spelled(place)).otherwise(earliest)
    )


def status_date(value: Column | str) -> Column:
    """``DD-MON-YYYY`` with an upper-case Spanish month, inside a raw status."""
    piece = lambda parts, i: F.get(parts, F.lit(i))
    return let(
        F.split(extract(value, r"\b(\d{2}-[A-Z]{3}-\d{4})\b", ignore_case=False), "-"),
        lambda p: F.concat(
            piece(p, 2), F.lit("-"), _lookup(SHORT_MONTHS, piece(p, 1)), F.lit("-"), piece(p, 0)
        ),
    )


def url_date(value: Column | str) -> Column:
    """``/YYYY_MM_DD/`` inside an address."""
    return F.replace(extract(value, r"/(\d{4}_\d{2}_\d{2})/"), F.lit("_"), F.lit("-"))


def file_year(value: Column | str) -> Column:
    """Year of a yearly dump file, ``unknown`` if the name has none."""
    return F.coalesce(extract(value, r"iniciativas_proposiciones_(\d{4})\.json"), F.lit("unknown"))


def as_date(value: Column | str) -> Column:
    """ISO text to DATE; null for a day that does not exist."""
    return F.try_to_date(strip(value), "yyyy-MM-dd")


def date_or_run(date: Column | str, presented_at: Column | str, run_ts: str) -> Column:
    """Event date, else presentation date, else the run's own time, which is a parameter."""
    return F.coalesce(
        as_col(date).cast("timestamp"), as_col(presented_at).cast("timestamp"), F.lit(run_ts).cast("timestamp")
    )
