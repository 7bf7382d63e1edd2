"""Status and event columns: rules from raw status text, the status order, chamber names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curul.functions.text import as_col, let, normalize_text
from curul.schema import EVENT_STATUS, STATUS_RANK

# --- fixed values: per source, the phrases that give an event type, first rule wins -----------
# A rule is (event type, alternatives); an alternative holds when all of its phrases occur.
STATUS_RULES: dict[str, tuple[tuple[str, tuple[tuple[str, ...], ...]], ...]] = {
    "sil": (
        ("dof_publication", (("publicado en dof",), ("publicad", "diario oficial"))),
        ("approved_origin", (("aprob",),)),
        ("turn_to_commission", (("pendiente en comision",),)),
        ("rejection", (("desechad",),)),
        ("returned_with_changes", (("devuelto",),)),
        ("withdrawal", (("retirad",),)),
        ("archival", (("archivad",),)),
    ),
    "gaceta_diputados": (
        ("turn_to_commission", (("turnada a",),)),
        ("dof_publication", (("publicado en el diario oficial de la federacion",), ("publicado en dof",))),
        ("withdrawal", (("retirada",),)),
        ("rejection", (("desechad",),)),
        ("archival", (("archivad",),)),
        ("approved_origin", (("dictaminada y aprobada en la camara de diputados",),)),
        ("approved_reviser", (("dictaminada y aprobada en la camara de senadores",),)),
    ),
    "gaceta_senado": (
        ("dof_publication", (("publicad", "diario oficial"),)),
        ("approved_origin", (("aprob",),)),
        ("turn_to_commission", (("se turno",), ("turno directamente",))),
        ("withdrawal", (("retirad",),)),
    ),
    "senado_transparencia": (
        ("dof_publication", (("publicad", "diario oficial"),)),
        ("approved_origin", (("aprob",),)),
        ("turn_to_commission", (("se turno",), ("turnado",), ("comision",))),
        ("withdrawal", (("retirad",),)),
    ),
}

EVENT_TITLES = {
    "presentation": "Presentación de iniciativa",
    "gaceta_publication": "Publicación en Gaceta Parlamentaria",
    "turn_to_commission": "Turnado a comisión",
    "extension": "Prórroga legislativa",
    "withdrawal": "Retiro de iniciativa",
    "approved_origin": "Aprobación en cámara de origen",
    "approved_reviser": "Aprobación en cámara revisora",
    "dof_publication": "Publicación en DOF",
    "rejection": "Desechamiento",
    "archival": "Archivo legislativo",
    "status": "Estatus legislativo",
}
# --- end of fixed values ----------------------------------------------------------------------


def mapped(table: dict, key: Column, default) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def event_status(event_type: Column | str) -> Column:
    """Status an event leads to."""
    return mapped(EVENT_STATUS, as_col(event_type), "unknown")


def event_from_status(raw_status: Column | str, source: str) -> Column:
    """Event type that a source's raw status text speaks of."""


    def by_rule(text: Column) -> Column:
        outcome = F.lit("other")
        for event_type, alternatives in reversed(STATUS_RULES[source]):
            holds = F.lit(False)
            for phrases in alternatives:
                every = F.lit(True)
                for phrase in phrases:
                    every = every & F.contains(text, F.lit(phrase))
                holds = holds | every
            outcome = F.when(holds, event_type).otherwise(outcome)
        return outcome

    return let(normalize_text(raw_status), by_rule)


def record_status(raw_status: Column | str, presented_at: Column | str, source: str) -> Column:
    """Initiative status of a single record."""
    raw = as_col(raw_status)
    from_raw = event_status(event_from_status(raw, source))
    return (
        F.when(raw.isNotNull() & (raw != ""), from_raw)
        .when(as_col(presented_at).isNotNull(), "presented")
        .otherwise("unknown")
    )


def status_rank(status: Column | str) -> Column:
    return mapped(STATUS_RANK, as_col(status), -1)


def compare_status(current: Column | str, latest: Column | str) -> Column:
    """Where the current status stands against the latest event; equal rank counts as behind."""
    mine, theirs = status_rank(current), status_rank(latest)
    return (
        F.when((mine == -1) | (theirs == -1), "incomparable").when(mine > theirs, "ahead").otherwise("behind")
    )


def chamber_wide(text: Column | str) -> Column:
    """Chamber named in free text; anything else that is not blank is ``otro``."""
    name = normalize_text(text)
    return (
        F.when(F.contains(name, F.lit("diput")), "diputados")
        .when(F.contains(name, F.lit("senad")), "senado")
        .when(F.contains(name, F.lit("ejecut")), "ejecutivo")
        .when(name != "", "otro")
    )


def chamber_narrow(text: Column | str) -> Column:
    """Chamber only where its members are named; the bare word ``senado`` gives null."""
    name = normalize_text(text)
    return F.when(F.contains(name, F.lit("senador")), "senado").when(
        F.contains(name, F.lit("diputad")), "diputados"
    )
