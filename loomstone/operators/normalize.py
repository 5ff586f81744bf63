"""Source payloads to postings; what lacks a required field gives no row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.dates import tolerant_timestamp
from ..functions.identity import fingerprint
from ..functions.text import strip_markup, trimmed
from ..sources.schemas import PAYLOADS

#: Columns of a posting, in order.
POSTING = ("source", "source_id", "fingerprint", "company", "title", "location_kind", "location_city", "work_mode", "seniority", "experience_years", "application_deadline", "published_at", "description", "source_url", "first_seen_at", "last_seen_at", "raw_payload")


def _filled(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    t = trimmed(c.cast("string"))
    return F.when(t != "", t)


def create_posting(df: DataFrame, now: Column, carry: Sequence[str] = (), **fields: Column) -> DataFrame:
    """Postings of the given fields: the four keys trimmed and not empty, the rest null by default. Columns to carry come last."""
    get = lambda name, kind: fields.get(name, F.lit(None).cast(kind))
    city = _filled(get("city", "string"))
    keyed = df.select(
        *(_filled(fields[c]).alias(c) for c in ("source", "source_id", "company", "title")),
        F.when(city.isNull(), "unknown").otherwise("known").alias("location_kind"),
        city.alias("location_city"),
        F.coalesce(get("work_mode", "string"), F.lit("unknown")).alias("work_mode"),
        get("seniority", "string").alias("seniority"),
        get("experience_years", "int").alias("experience_years"),
        get("deadline", "timestamp").alias("application_deadline"),
        get("published_at", "timestamp").alias("published_at"),
        get("description", "string").alias("description"),
        get("url", "string").alias("source_url"),
        now.alias("first_seen_at"),
        now.alias("last_seen_at"),
        fields["raw"].alias("raw_payload"),
        *carry,
    ).dropna(subset=["source", "source_id", "company", "title"])
    return keyed.withColumn("fingerprint", fingerprint(F.col("company"), F.col("title"), F.col("location_city"))).select(*POSTING, *carry)


def _gupy(p: Column) -> dict[str, Column]:
    mode = F.when(p["workplaceType"].isin("remote", "hybrid"), p["workplaceType"]).when(p["workplaceType"] == "on-site", "onsite")
    return dict(id=p["id"], company=p["careerPageName"], title=p["name"], city=p["city"], work_mode=mode, deadline=tolerant_timestamp(p["applicationDeadline"]), published_at=tolerant_timestamp(p["publishedDate"]), description=p["description"], url=p["jobUrl"])


def _ciee(p: Column) -> dict[str, Column]:
    area = _filled(p["areaProfissional"])
    internship = F.coalesce(F.upper(p["tipoVaga"]) == "ESTAGIO", F.lit(False))
    title = F.when(internship, F.concat(F.lit("Estágio"), F.coalesce(F.concat(F.lit(" em "), area), F.lit("")))).otherwise(area)
    activities = F.filter(F.transform(F.coalesce(p["atividades"], F.array().cast("array<string>")), trimmed), lambda a: a != "")
    semesters = [F.coalesce(p["requisitos"][c].cast("string"), F.lit("?")) for c in ("semestreInicio", "semestreFinal")]
    asked = p["requisitos"]["semestreInicio"].isNotNull() | p["requisitos"]["semestreFinal"].isNotNull()
    pay = F.when(p["bolsaAuxilio"] == F.floor(p["bolsaAuxilio"]), p["bolsaAuxilio"].cast("long").cast("string")).otherwise(p["bolsaAuxilio"].cast("string"))
    parts = F.concat_ws(
        " ",
        F.when(F.size(activities) > 0, F.concat(F.lit("Atividades: "), F.array_join(activities, "; "), F.lit("."))),
        F.concat(F.lit("Setor da empresa: "), _filled(p["descricao"]), F.lit(".")),
        F.when(asked, F.concat(F.lit("Semestre exigido: "), semesters[0], F.lit(" a "), semesters[1], F.lit("."))),
        F.concat(F.lit("Bolsa-auxílio: R$ "), pay, F.lit(".")),
    )
    return dict(id=p["codigoVaga"], company=p["nomeEmpresa"], title=title, city=p["local"]["cidade"], description=_filled(parts))


def _indeed(p: Column) -> dict[str, Column]:
    return dict(id=p["id"], company=p["company"], title=p["title"], city=F.split_part(p["location"], F.lit(","), F.lit(1)), work_mode=F.when(p["is_remote"], "remote"), published_at=tolerant_timestamp(p["date_posted"]), description=p["description"], url=p["job_url"])


def _linkedin(p: Column) -> dict[str, Column]:
    form = r"^(.*)\(([^)]+)\)\s*$"
    place, label = _filled(F.regexp_extract(p["location"], form, 1)), F.lower(F.regexp_extract(p["location"], form, 2))
    mode = F.when(F.contains(label, F.lit("remoto")), "remote").when(label.rlike("h[íi]brido"), "hybrid").when(F.contains(label, F.lit("presencial")), "onsite")
    city = F.when(F.lower(place) != "brasil", F.split_part(place, F.lit(","), F.lit(1)))
    return dict(id=p["link"], company=p["company"], title=p["title"], city=city, work_mode=mode, url=p["link"])


def _solides(p: Column) -> dict[str, Column]:
    mode = F.when(p["homeOffice"], "remote").when(p["jobType"] == "presencial", "onsite")
    return dict(id=p["id"], company=p["companyName"], title=p["title"], city=p["city"]["name"], work_mode=mode, published_at=tolerant_timestamp(p["createdAt"]), description=p["description"], url=p["redirectLink"])


def _catho(p: Column) -> dict[str, Column]:
    job = p["jobPosting"]
    city = _filled(F.regexp_extract(p["pageTitle"], r"^Vaga de Emprego de .+, ([^,/]+?)\s*/\s*$", 1))
    return dict(id=p["id"], company=job["hiringOrganization"]["name"], title=job["title"], city=city, work_mode=F.when(job["jobLocationType"] == "TELECOMMUTE", "remote"), published_at=tolerant_timestamp(job["datePosted"]), description=job["description"], url=p["url"])


NORMALIZERS: dict[str, Callable[[Column], dict[str, Column]]] = {"gupy": _gupy, "ciee": _ciee, "indeed": _indeed, "linkedin": _linkedin, "solides": _solides, "catho": _catho}
_FIELDS = {"id": "string", "company": "string", "title": "string", "city": "string", "work_mode": "string", "deadline": "timestamp", "published_at": "timestamp", "description": "string", "url": "string"}


def _struct(made: dict[str, Column]) -> Column:
    return F.struct(*(made.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in _FIELDS.items()))


def normalize_all(raw: DataFrame, now: Column, sources: Sequence[str] = tuple(NORMALIZERS)) -> DataFrame:
    """Postings of all known sources, in one pass over the rows.

    raw: source, source_id, payload (JSON). Other columns (a position, say) stay, at the end.
    """
    carry = [c for c in raw.columns if c not in ("source", "source_id", "payload")]
    own = lambda s: F.col("source") == s
    # parsed in a projection of its own, once for all fields
    parsed = raw.filter(F.col("source").isin(*sources)).withColumns({f"__{s}": F.when(own(s), F.from_json("payload", PAYLOADS[s], {"mode": "PERMISSIVE"})) for s in sources})
    made = F.coalesce(*(F.when(own(s), _struct(NORMALIZERS[s](F.col(f"__{s}")))) for s in sources))
    rows = parsed.select("source", "source_id", "payload", *carry, made.alias("__f"))
    fields = {n: F.col(f"__f.{n}") for n in _FIELDS if n != "id"}
    return create_posting(rows, now, carry, source=F.col("source"), source_id=F.coalesce("source_id", "__f.id"), raw=F.col("payload"), **fields)


def normalize_source(raw: DataFrame, source: str, now: Column) -> DataFrame:
    """Postings of one source."""
    return normalize_all(raw, now, [source])


def without_normalizer(raw: DataFrame) -> DataFrame:
    """Events for rows of unknown sources."""
    return raw.filter(~F.col("source").isin(*NORMALIZERS)).select("source", "source_id", F.lit("normalizer_missing").alias("reason"))


def backfill_description(postings: DataFrame) -> DataFrame:
    """Description from the raw payload where it is missing."""
    found = F.get_json_object("raw_payload", "$.description")
    return postings.withColumn("description", F.coalesce("description", F.when(trimmed(found) != "", found)))


def plain_description(c: Column) -> Column:
    """Description without tags (entities kept)."""
    return strip_markup(c)
