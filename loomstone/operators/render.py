"""Digest and study plan as text. Labels are output values, in the readers' language."""

from __future__ import annotations

from collections.abc import Mapping

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions.text import percent

# Labels of the output.
VERDICTS = {"apply": "candidatar", "review": "avaliar", "discard": "descartar"}
WORK_MODES = {"remote": "Remoto", "hybrid": "Híbrido", "onsite": "Presencial", "unknown": "Local não informado"}
FAILURES = {
    "invalid_output": "o modelo não retornou uma resposta válida",
    "extraction_failed": "falha ao extrair requisitos da vaga",
    "matching_failed": "falha ao avaliar os requisitos contra o perfil",
    "max_retries_exceeded": "falhou repetidamente e não será mais tentada automaticamente — descarte manual ou correção do problema necessários",
}
SECTIONS = {"recommended": "Recomendadas", "review": "Vale avaliar", "opening_later": "Abrem para você em breve"}
NOTHING, RULE = "(nenhuma vaga)", "\n\n---\n\n"
NO_LINK = "(link não informado pela fonte)"
MANUAL = "⚠ Não foi possível pontuar automaticamente ({}) — avaliação manual necessária"
UNSURE = "⚠ Confiança baixa — poucos requisitos verificáveis extraídos da vaga"
CUT = "⚠ Conteúdo da vaga foi reduzido ao limite de segurança antes da avaliação"


def _labelled(c: Column, labels: Mapping[str, str]) -> Column:
    return F.coalesce(*(F.when(c == k, v) for k, v in labels.items()), c)


def half_up(c: Column) -> Column:
    """A number rounded to an integer, halves upwards."""
    return F.floor(c + 0.5).cast("long")


def _named(label: str, items: Column, joint: str) -> Column:
    """A line of items; null without any."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, joint)))


def posting_entry(df: DataFrame) -> Column:
    """An entry of a scored posting.

    df: company, title, score, verdict, location_kind, location_city, work_mode, source, source_url, failure,
    low_confidence, input_truncated, variant, highlights, missing_terms and critical_gaps (arrays, the last of structs
    with a text). Lines that don't apply are left out; a missing link is told.
    """
    c = lambda name: F.col(name)
    strings = lambda name: F.coalesce(c(name), F.array().cast("array<string>"))
    mode = _labelled(c("work_mode"), WORK_MODES)
    city = F.when(c("location_kind") == "known", c("location_city"))
    place = F.when(F.coalesce(city, F.lit("")) != "", F.concat(city, F.lit(" · "), mode)).otherwise(mode)
    warning = F.when(c("failure").isNotNull(), F.format_string(MANUAL.replace("{}", "%s"), _labelled(c("failure"), FAILURES))).when(c("low_confidence"), UNSURE)
    gaps = F.coalesce(F.transform("critical_gaps", lambda r: r["text"]), F.array().cast("array<string>"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Empresa: "), c("company")),
        F.concat(F.lit("Cargo: "), c("title")),
        F.concat(F.lit("Compatibilidade: "), half_up(c("score")).cast("string"), F.lit("% · "), _labelled(c("verdict"), VERDICTS)),
        F.concat(F.lit("Local: "), place),
        F.concat(F.lit("Fonte: "), c("source")),
        F.concat(F.lit("→ "), F.coalesce("source_url", F.lit(NO_LINK))),
        warning,
        F.when(c("input_truncated"), CUT),
        F.when(F.coalesce(c("variant"), F.lit("")) != "", F.concat(F.lit("Currículo recomendado: "), c("variant"))),
        _named("Pontos fortes", strings("highlights"), "; "),
        _named("Termos ausentes no currículo", strings("missing_terms"), ", "),
        _named("Lacunas", gaps, "; "),
    )


def opening_entry(company: Column, title: Column, opens_at: Column) -> Column:
    """An entry of a posting that opens later."""
    return F.concat(company, F.lit(" — "), title, F.lit("\nAbre para você em "), opens_at)


def section_texts(entries: DataFrame) -> DataFrame:
    """(section, text) of all sections, empty ones too. entries: section, pos, entry; by pos within a section."""
    found = entries.groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda e: e["entry"]).alias("e"))
    spark = entries.sparkSession
    every = spark.createDataFrame(list(SECTIONS.items()), "section string, title string")
    body = F.when(F.col("e").isNull(), F.lit(NOTHING)).otherwise(F.array_join("e", "\n\n"))
    return every.join(found, "section", "left").select("section", F.concat("title", F.lit("\n\n"), body).alias("text"))


def run_summary(collected: Column, new: Column, filtered: Column, scored: Column, failed: Column, truncated: Column) -> Column:
    """The digest's last section, from counts and arrays of sources."""
    names = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("nenhuma")
    labels = ("Coletadas", "Novas após deduplicação", "Após pré-filtro", "Pontuadas", "Fontes com falha", "Fontes truncadas pelo limite")
    values = (*(x.cast("string") for x in (collected, new, filtered, scored)), names(failed), names(truncated))
    return F.concat_ws("\n", F.lit("Resumo da execução"), F.lit(""), *(F.concat(F.lit(f"{n}: "), v) for n, v in zip(labels, values, strict=True)))


def ranked_lines(counts: DataFrame, total: Column, of: str, most: int = 10, by: str = "n", tie: str = "skill") -> Column:
    """Lines of the most frequent skills, as a scalar: place, skill, count of total, share. counts: skill, n, share."""
    first = counts.orderBy(F.desc(by), tie).limit(most).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(by), tie)))
    line = F.concat(F.col("place").cast("string"), F.lit(". "), "skill", F.lit(" — "), F.col("n").cast("string"), F.lit(" de "), total.cast("string"), F.lit(f" {of} ("), percent(F.col("share")), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return first.select("place", line.alias("line")).select(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n")).scalar()


def study_plan_text(postings: Column, extracted: Column, high: Column, gaps: Column, demand: Column, weeks: Column) -> Column:
    """The study plan from its counts and the lines of its parts (null or empty where there are none)."""
    part = lambda title, lines, none, empty=None: F.when(F.coalesce(lines, F.lit("")) == "", F.lit(f"{empty or title}\n\n{none}")).otherwise(F.concat(F.lit(f"{title}\n\n"), lines))
    first = F.concat(F.lit("Corpus: "), postings.cast("string"), F.lit(" vagas · "), extracted.cast("string"), F.lit(" com extração completa · "), high.cast("string"), F.lit(" de alta compatibilidade"))
    return F.concat_ws(
        RULE,
        first,
        part("Lacunas mais frequentes (não cobertas pelo perfil)", gaps, "(nenhuma lacuna identificada)", "Lacunas mais frequentes"),
        part("Tecnologias mais pedidas no mercado", demand, "(sem dados suficientes)"),
        part("Volume por semana", weeks, "(sem dados)"),
    )


def week_lines(weekly: DataFrame) -> Column:
    """Lines of the weeks' volumes, as a scalar. weekly: week, n."""
    ordered = F.array_sort(F.collect_list(F.struct("week", "n")))
    return weekly.select(F.array_join(F.transform(ordered, lambda w: F.concat(w["week"], F.lit(": "), w["n"].cast("string"), F.lit(" vagas"))), "\n")).scalar()
