"""Data model: enumerations, status order, natural keys, foreign keys and in-flight row types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values of the data model ---------------------------------------------------------
CHAMBERS = ("diputados", "senado", "congreso_union", "ejecutivo", "otro")

INITIATIVE_STATUSES = (
    "draft",
    "presented",
    "in_commissions",
    "opinion_issued",
    "approved_origin",
    "approved_reviser",
    "approved_congress",
    "sent_executive",
    "published_dof",
    "rejected",
    "archived",
    "withdrawn",
    "expired",
    "unknown",
)

EVENT_TYPES = (
    "presentation",
    "gaceta_publication",
    "turn_to_commission",
    "commission_opinion",
    "commission_vote",
    "plenary_discussion",
    "plenary_vote",
    "approved_origin",
    "approved_reviser",
    "returned_with_changes",
    "sent_executive",
    "executive_observation",
    "dof_publication",
    "archival",
    "rejection",
    "withdrawal",
    "other",
)

DOCUMENT_KINDS = (
    "initiative_text",
    "gaceta_entry",
    "commission_opinion",
    "dictamen",
    "decree",
    "transcript",
    "html_snapshot",
    "pdf",
    "other",
)

SOURCE_SYSTEMS = ("sil", "gaceta_diputados", "gaceta_senado", "senado_transparencia", "manual")

SOURCES_SEED = (
    ("sil", "Sistema de Informacion Legislativa", "https://sil.gobernacion.gob.mx", 10),
    ("gaceta_diputados", "Gaceta Parlamentaria - Camara de Diputados", "https://gaceta.diputados.gob.mx", 20),
    ("gaceta_senado", "Gaceta del Senado", "https://www.senado.gob.mx", 20),
    ("senado_transparencia", "Senado Transparencia", "https://www.senado.gob.mx/transparencia", 30),
    ("manual", "Carga manual", None, 100),
)

# Order of progress; the last five are terminal and equal, unknown lies below everything.
STATUS_RANK = {
    "unknown": -1,
    "draft": 0,
    "presented": 1,
    "in_commissions": 2,
    "opinion_issued": 3,
    "approved_origin": 4,
    "approved_reviser": 5,
    "approved_congress": 6,
    "sent_executive": 7,
    "published_dof": 8,
    "rejected": 8,
    "archived": 8,
    "withdrawn": 8,
    "expired": 8,
}

EVENT_STATUS = {
    "presentation": "presented",
    "gaceta_publication": "presented",
    "turn_to_commission": "in_commissions",
    "commission_opinion": "opinion_issued",
    "approved_origin": "approved_origin",
    "approved_reviser": "approved_reviser",
    "sent_executive": "sent_executive",
    "dof_publication": "published_dof",
    "rejection": "rejected",
    "archival": "archived",
    "withdrawal": "withdrawn",
}

DEFAULT_PRIORITY = 999
DEFAULT_LINK_CONFIDENCE = 0.8
# --- end of fixed values ----------------------------------------------------------------------


NATURAL_KEYS: dict[str, tuple[str, ...]] = {
    "sources": ("system",),
    "initiative_aliases": ("initiative_id", "alias_normalized"),
    "source_records": ("source_id", "record_type", "source_record_key", "content_hash"),
    "initiative_authors": ("initiative_id", "author_id", "role"),
    "commissions": ("name_normalized", "chamber"),
    "initiative_commissions": ("initiative_id", "commission_id", "relation_type", "assigned_at"),
    "legislative_events": ("initiative_id", "event_hash"),
    "documents": ("source_id", "sha256"),
    "document_chunks": ("document_id", "chunk_index"),
    "initiative_source_links": ("initiative_id", "source_record_id"),
    "event_source_links": ("legislative_event_id", "source_record_id"),
    "document_source_links": ("document_id", "source_record_id"),
    "rejected_inputs": ("source_id", "source_url", "source_record_key", "content_hash"),
}


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` points to ``parent.id``; ``on_delete`` is cascade, set_null or restrict."""

    child: str
    column: str
    parent: str
    on_delete: str = "cascade"


FOREIGN_KEYS = (
    ForeignKey("initiative_aliases", "initiative_id", "initiatives"),
    ForeignKey("source_records", "source_id", "sources", "restrict"),
    ForeignKey("initiative_authors", "initiative_id", "initiatives"),
    ForeignKey("initiative_authors", "author_id", "authors"),
    ForeignKey("initiative_authors", "source_record_id", "source_records", "set_null"),
    ForeignKey("initiative_commissions", "initiative_id", "initiatives"),
    ForeignKey("initiative_commissions", "commission_id", "commissions"),
    ForeignKey("legislative_events", "initiative_id", "initiatives"),
    ForeignKey("documents", "initiative_id", "initiatives", "set_null"),
    ForeignKey("documents", "legislative_event_id", "legislative_events", "set_null"),
    ForeignKey("documents", "source_id", "sources", "restrict"),
    ForeignKey("document_chunks", "document_id", "documents"),
    ForeignKey("affected_norms", "initiative_id", "initiatives"),
    ForeignKey("initiative_source_links", "initiative_id", "initiatives"),
    ForeignKey("initiative_source_links", "source_record_id", "source_records"),
    ForeignKey("event_source_links", "legislative_event_id", "legislative_events"),
    ForeignKey("event_source_links", "source_record_id", "source_records"),
    ForeignKey("document_source_links", "document_id", "documents"),
    ForeignKey("document_source_links", "source_record_id", "source_records"),
)

AUTHOR = T.StructType(
    [T.StructField("full_name", T.StringType()), T.StructField("role", T.StringType())]
)

# What every extraction job emits; the mapped form renames title/date/status/description.
PARSED_RECORD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("source_record_key", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("title_normalized", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("presentation_date", T.StringType()),
        T.StructField("status_raw", T.StringType()),
        T.StructField("chamber", T.StringType()),
        T.StructField("initiative_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("dedupe_hash", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("parent_url", T.StringType()),
        T.StructField("session_date", T.StringType()),
    ]
)
