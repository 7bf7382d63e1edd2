"""Chat logs: flags told by the wording, and the recent history of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.functions.text import as_col, matches, strip, strip_diacritics, truncate
from curul.operators.keyed import best_per_key

# --- fixed values: words of date limits, search requests and "nothing found" answers ----------
YEAR = r"\b(?:19|20)\d{2}\b"
MONTH_WORDS = (
    "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre"
)
PERIOD_WORDS = (
    "desde|hasta|entre|periodo|legislatura|fecha|ano|anio|mes|dia|hoy|ayer|reciente|recientes|actual"
)
SEARCH_WORDS = (
    "busca|buscar|encuentra|encontrar|lista|listar|cuantas|cuantos|filtra|filtrar|presentadas?|iniciativas?"
)
SUBJECT_WORDS = (
    "iniciativa|iniciativas|autor|autores|proponente|proponentes|ejecutivo|senador|senadora|diputado|diputada"
)
NOTHING_FOUND = "no se encontraron|no encontre|no se han registrado|no hay iniciativas"
HISTORY_ROLES = ("user", "assistant")
HISTORY_LENGTH, MESSAGE_LENGTH = 10, 4000
# --- end of fixed values ----------------------------------------------------------------------


def _plain(text: Column | str) -> Column:
    return F.lower(strip_diacritics(text))


def has_date_limit(text: Column | str) -> Column:
    plain = _plain(text)
    words = rf"{YEAR}|\b(?:{MONTH_WORDS})\b|\b(?:{PERIOD_WORDS})\b"
    return matches(plain, words, ignore_case=False)


def needs_search(text: Column | str) -> Column:
    plain = _plain(text)
    return matches(plain, rf"\b(?:{SEARCH_WORDS})\b", ignore_case=False) & matches(
        plain, rf"\b(?:{SUBJECT_WORDS})\b", ignore_case=False
    )


def contradicts_results(text: Column | str, result_count: Column | str) -> Column:
    """An answer that claims nothing was found although there were results."""
    return matches(_plain(text), NOTHING_FOUND, ignore_case=False) & (F.coalesce(as_col(result_count), F.lit(0)) > 0)


def message_flags(messages: DataFrame, text: str = "text", result_count: str | None = None) -> DataFrame:
    out = messages.withColumn("date_limited", has_date_limit(text)).withColumn("search_needed", needs_search(text))
    if result_count:
        out = out.withColumn("contradicts_results", contradicts_results(text, result_count))
    return out


def recent_history(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ten user and assistant messages that are not blank, shortened for the prompt."""
    spoken = messages.filter(F.col("role").isin(*HISTORY_ROLES) & (strip("text") != ""))
    return best_per_key(spoken, [conversation], [F.col(turn).desc()], k=HISTORY_LENGTH).withColumn(
        "text", truncate("text", MESSAGE_LENGTH)
    )
