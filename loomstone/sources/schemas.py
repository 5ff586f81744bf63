"""Schemas of the six sources' payloads; fields beyond these pass through in the raw JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

# Field names and types of the sources.
PAYLOADS = {
    "gupy": "id string, name string, careerPageName string, description string, publishedDate string, applicationDeadline string, city string, state string, country string, workplaceType string, jobUrl string, isRemoteWork boolean",
    "ciee": "codigoVaga string, nomeEmpresa string, tipoVaga string, areaProfissional string, nivelEscolar string, descricao string, atividades array<string>, requisitos struct<semestreInicio: bigint, semestreFinal: bigint>, bolsaAuxilio double, local struct<bairro: string, cidade: string, uf: string>",
    "solides": "id string, title string, companyName string, description string, createdAt string, homeOffice boolean, jobType string, city struct<id: string, name: string, state_id: string>, redirectLink string",
    "indeed": "id string, title string, company string, location string, job_type string, is_remote boolean, date_posted string, job_url string, description string",
    "linkedin": "title string, company string, location string, link string",
    "catho": "id string, url string, pageTitle string, jobPosting struct<title: string, description: string, datePosted: string, employmentType: string, hiringOrganization: struct<name: string>, jobLocationType: string>",
}
#: Where the items lie in a source's envelope, and the field of their id.
ENVELOPES = {"gupy": ("data", "id"), "ciee": ("content", "codigoVaga"), "solides": ("data.data", "id"), "indeed": ("", "id"), "linkedin": ("", "link"), "catho": ("", "id")}
POSTINGS = (
    "source string, source_id string, fingerprint string, company string, title string, location_kind string, location_city string, work_mode string, seniority string, experience_years int, application_deadline timestamp, "
    "published_at timestamp, description string, source_url string, first_seen_at timestamp, last_seen_at timestamp, raw_payload string, duplicate_of string, notified_at timestamp, discarded_at timestamp, discard_reason string, "
    "score_failures int, last_score_failed_at timestamp, claimed_at timestamp, claimed_by string"
)


@dataclass(frozen=True)
class Paging:
    """How a paged source is scanned: items a page, the default cap on items, where an item's title, city and mode are.

    asks_rest: its last request asks for as many items as the cap leaves. filtered_here: it can't filter, its items are
    filtered while they are read. cities: names that it wants otherwise.
    """

    size: int
    cap: int
    title: str
    city: str
    mode: str | None
    asks_rest: bool = False
    filtered_here: bool = False
    cities: dict[str, str] = field(default_factory=dict)


# Page sizes, caps, fields and place names of the paged sources.
PAGES = {
    "gupy": Paging(10, 50, "name", "city", "workplaceType", asks_rest=True),
    "ciee": Paging(100, 6000, "areaProfissional", "local.cidade", None, filtered_here=True),
    "solides": Paging(10, 50, "title", "city.name", "jobType", cities={"Rio de Janeiro": "Rio de Janeiro - RJ", "Niterói": "Niterói - RJ", "São Gonçalo": "São Gonçalo - RJ"}),
}
# Kinds of the sources' fields; "!" marks required ones, "?" those that may be null.
CHECKED = {
    "gupy": {
        "id": "id!", "name": "text!", "description": "text", "careerPageName": "text", "type": "text", "publishedDate": "text", "applicationDeadline": "text?", "isRemoteWork": "flag",
        "city": "text?", "state": "text?", "country": "text?", "jobUrl": "text", "workplaceType": "text",
    },
    "ciee": {
        "codigoVaga": "id!", "tipoVaga": "text", "nomeEmpresa": "text", "nivelEscolar": "text", "areaProfissional": "text?", "descricao": "text?", "atividades": "texts", "bolsaAuxilio": "number?",
        "local": "object?", "local.cidade": "text?", "local.bairro": "text?", "local.uf": "text?", "requisitos": "object?", "requisitos.semestreInicio": "number?", "requisitos.semestreFinal": "number?",
    },
    "solides": {
        "id": "id!", "title": "text!", "companyName": "text", "description": "text", "createdAt": "text", "homeOffice": "flag", "jobType": "text", "city": "object?", "city.name": "text!", "redirectLink": "text",
    },
}
