"""The profile's evidence catalogue, and the guard that admits only real and applicable quotes.

A profile is one small configuration, so its catalogue is a literal of the plan: no join.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column

from ..functions.text import SPACES, normalized_words, plain_words, strip_evidence_tag

# Fixed value: what a field holds that isn't answered yet.
UNVERIFIED = "⚠ VERIFY"
# Tags of entries that aren't competencies, with the words of which a requirement must have one.
TAG_TERMS = {
    "Academic enrollment": ("curso", "cursando", "faculdade", "graduacao", "periodo", "semestre", "formacao", "conclusao"),
    "English level": ("ingles", "english"),
    "Availability": ("disponibilidade", "horas semanais", "carga horaria", "horario", "availability"),
    "Compensation": ("bolsa", "remuneracao", "salario", "stipend", "compensation"),
}


@dataclass(frozen=True)
class Competency:
    name: str
    aliases: Sequence[str] = ()
    evidence: Sequence[str] = ()


@dataclass(frozen=True)
class Profile:
    """Who applies: the course, declared fields, and competencies with their evidence."""

    course_name: str
    institution: str
    course_start: dt.date
    course_end: dt.date
    competencies: Sequence[Competency]
    english_level: str = UNVERIFIED
    max_weekly_hours: str = UNVERIFIED
    work_availability: str = UNVERIFIED
    minimum_stipend: str = UNVERIFIED

    def __post_init__(self) -> None:
        names = [c.name for c in self.competencies]
        problems = [f"competencies.{n}: named twice" for n in sorted({n for n in names if names.count(n) > 1})]
        problems += [f"{f}: empty" for f in ("course_name", "institution", "english_level", "max_weekly_hours", "work_availability", "minimum_stipend") if not getattr(self, f)]
        if not names:
            problems.append("competencies: at least one")
        if problems:
            raise ValueError("; ".join(problems))


def profile_keywords(profile: Profile) -> list[str]:
    """Names and aliases of all competencies."""
    return [k for c in profile.competencies for k in (c.name, *c.aliases)]


def _half_years(day: dt.date) -> int:
    return day.year * 2 + (day.month >= 7)


def catalogue(profile: Profile, today: dt.date) -> list[tuple[str, str]]:
    """(tag, text) of every line that may be quoted: enrollment, declared fields, then each competency's evidence."""
    course = f"{profile.course_name} na {profile.institution}"
    end = f"{profile.course_end.year}.{2 if profile.course_end.month >= 7 else 1}"
    period = _half_years(today) - _half_years(profile.course_start) + 1
    # The lines' wording, which quotes must equal.
    if period < 1:
        academic = f"Ingressa em {course} e ainda não iniciou o curso; conclusão prevista para {end}."
    elif period > 8:
        academic = f"Concluiu {course}."
    else:
        academic = f"Cursando o {period}º período de {course}, com conclusão prevista para {end}."
    declared = (
        ("English level", profile.english_level, f"Nível de inglês: {profile.english_level}."),
        ("Availability", profile.max_weekly_hours, f"Disponibilidade de até {profile.max_weekly_hours} horas semanais."),
        ("Work availability", profile.work_availability, profile.work_availability),
        ("Compensation", profile.minimum_stipend, f"Bolsa-auxílio mínima aceita: {profile.minimum_stipend}."),
    )
    return [("Academic enrollment", academic), *((tag, line) for tag, value, line in declared if value != UNVERIFIED), *((c.name, e) for c in profile.competencies for e in c.evidence)]


def catalogue_text(profile: Profile, today: dt.date) -> str:
    """The catalogue as it is shown: a line ``- [tag] text`` each."""
    return "\n".join(f"- [{tag}] {line}" for tag, line in catalogue(profile, today))


def _bare_tag(line: str) -> str:
    """A constant without a leading ``- [tag]`` and white space at its ends."""
    return re.sub(rf"^[{SPACES}]*-?[{SPACES}]*\[[^\]]+\][{SPACES}]*", "", line).strip(SPACES)


def _is_known(bare: Column, profile: Profile, today: dt.date) -> Column:
    return bare.isin(*sorted({_bare_tag(line) for _, line in catalogue(profile, today)}))


def _is_applicable(bare: Column, asked: Column, profile: Profile, today: dt.date) -> Column:
    """For a quote without its tag, and the words asked for."""
    aliases = {c.name: (c.name, *c.aliases) for c in profile.competencies}
    about: dict[str, Sequence[str]] = {}
    for tag, line in catalogue(profile, today):
        about.setdefault(line, TAG_TERMS.get(tag) or aliases.get(tag, ()))
    out = F.lit(False)
    for line, terms in about.items():
        named = [F.contains(asked, F.lit(words)) for words in map(plain_words, terms) if len(words.strip()) >= 2]
        if named:
            out = out | ((bare == line) & functools.reduce(lambda a, b: a | b, named))
    return out


def known_evidence(quote: Column, profile: Profile, today: dt.date) -> Column:
    """Whether a quote (with or without its tag) is exactly a line of the catalogue."""
    return F.coalesce(_is_known(strip_evidence_tag(quote), profile, today), F.lit(False))


def applicable_evidence(quote: Column, text: Column, category: Column, profile: Profile, today: dt.date) -> Column:
    """Whether the requirement (text and category) names what the quoted line is about, as whole words.

    That is one of its tag's fixed words, or the name or an alias of its competency. A line under another tag never is.
    """
    return F.coalesce(_is_applicable(strip_evidence_tag(quote), normalized_words(F.concat_ws(" ", text, category)), profile, today), F.lit(False))


def admitted(matches: Column, profile: Profile, today: dt.date) -> Column:
    """An array of matches, of which those whose evidence isn't admissible lose it, and so aren't met."""
    # quotes without tags and the words asked for are made once for each match
    read = F.transform(matches, lambda m: F.struct(m.alias("m"), strip_evidence_tag(m["evidence"]).alias("bare"), F.when(m["evidence"].isNotNull(), normalized_words(F.concat_ws(" ", m["requirement"]["text"], m["requirement"]["category"]))).alias("asked")))

    def judged(x: Column) -> Column:
        real = F.coalesce(_is_known(x["bare"], profile, today) & _is_applicable(x["bare"], x["asked"], profile, today), F.lit(False))
        m = x["m"]
        return F.struct(m["requirement"].alias("requirement"), F.when(real, m["status"]).otherwise(F.lit("not_met")).alias("status"), F.when(real, m["evidence"]).alias("evidence"))

    return F.transform(read, judged)


def guard(matches: Column, profile: Profile, today: dt.date) -> Column:
    """Struct of the admitted matches and of the number of those whose evidence was rejected."""
    given = lambda some: F.size(F.filter(some, lambda m: m["evidence"].isNotNull()))
    # bound once
    bound = F.transform(F.array(admitted(matches, profile, today)), lambda kept: F.struct(kept.alias("matches"), (given(matches) - given(kept)).alias("rejected")))
    return F.element_at(bound, 1)
