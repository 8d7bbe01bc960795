"""Status vocabularies, visibility, expiry and other small decisions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Status by index, colours by index and the labels shown for them.
STATUSES = ("available", "sold", "reserved", "blocked")
INGEST_COLORS = ("#26d07c", "#6e6d67", "#e0613b", "#7c838b")
LIVE_COLORS = ("#26d07c", "#6e6d67", "#e0613b", "#7c8594")
STATUS_LABELS = ("Disponivel", "Vendido", "Reservado", "Bloqueado")

# Phrases of the audit feed.
AUDIT_PHRASES = {
    "organization_created": "cadastrou um cliente",
    "organization_updated": "atualizou o cadastro do cliente",
    "organization_user_invited": "convidou um usuario",
    "project_created": "criou um projeto",
    "project_updated": "atualizou um projeto",
    "project_version_published": "publicou uma versao",
    "project_version_validated": "rodou a validacao de uma versao",
    "processing_job_created": "iniciou um processamento",
    "processing_job_succeeded": "concluiu um processamento",
    "processing_job_cancelled": "cancelou um processamento",
    "file_uploaded": "enviou um arquivo",
    "lot_updated": "editou um lote",
    "lots_batch_updated": "editou lotes em lote",
    "share_link_created": "criou um link de compartilhamento",
    "share_link_updated": "atualizou um link de compartilhamento",
    "share_link_revoked": "revogou um link de compartilhamento",
    "edit_proposal_created": "enviou uma proposta de edicao",
    "edit_proposal_accepted": "aceitou uma proposta de edicao",
    "edit_proposal_rejected": "recusou uma proposta de edicao",
}

BACKOFF_BASE_SECONDS = 5
BACKOFF_MAX_SECONDS = 3600


def by_index(values: tuple[str, ...], index: Column, fallback: str) -> Column:
    """``values[index]``, with the fallback for null and out-of-range indexes."""
    return F.coalesce(F.when(index >= 0, F.get(F.array(*[F.lit(v) for v in values]), index)), F.lit(fallback))


def index_of(values: tuple[str, ...], value: Column, fallback: int) -> Column:
    position = F.array_position(F.array(*[F.lit(v) for v in values]), value)
    return F.when(position > 0, position - 1).otherwise(fallback).cast("int")


def ingest_status(index: Column) -> Column:
    """Ingest reads a bad index as available."""
    return by_index(STATUSES, index, "available")


def editor_status(index: Column) -> Column:
    """An editor save reads a bad index as blocked."""
    return by_index(STATUSES, index, "blocked")


def audit_phrase(action: Column) -> Column:
    phrases = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in AUDIT_PHRASES.items()))
    return F.coalesce(F.try_element_at(phrases, action), F.concat(F.lit("executou "), action))


def visibility(access_mode: Column, has_password: Column) -> Column:
    return (
        F.when(access_mode.isin("link", "token"), F.when(has_password, "password").otherwise("unlisted"))
        .when(access_mode.isin("private", "password", "unlisted", "public"), access_mode)
        .otherwise("private")
    )


def is_expired(expires_at: Column, now: Column) -> Column:
    """A null expiry never expires; the instant itself counts as expired."""
    return F.coalesce(expires_at <= now, F.lit(False))


def backoff_seconds(attempts: Column) -> Column:
    # The exponent is bounded first: anything above it is at the ceiling already.
    exponent = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(20))
    return F.least(F.lit(BACKOFF_MAX_SECONDS), F.lit(BACKOFF_BASE_SECONDS) * F.pow(F.lit(2.0), exponent)).cast("bigint")


def plus_seconds(moment: Column, seconds: Column) -> Column:
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
