"""Extraction and matching by an injected model, behind caches.

A model is a callable on the executors: extraction takes (title, description), matching (requirement, profile evidence).
It is only called for what the caches lack, after the filter; failures are values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Row

from .model_output import EXTRACTION_SCHEMA, MATCH_SCHEMA, Answer, checked
from .scoring import MATCH, REQUIREMENT

IN_FLIGHT, RETRIES = 8, 3
_EXTRACTED = f"fingerprint string, content_hash string, requirements array<{REQUIREMENT}>, seniority string, experience_years int, failure string"
_MATCHED = f"fingerprint string, requirements_hash string, matches array<{MATCH}>, failure string, finished array<struct<requirement_index: int, match: {MATCH}>>"


def extraction(model: Callable[[str, str], dict | Answer], title: str | None, description: str | None) -> tuple[list[dict] | None, str | None, int | None, str | None, int]:
    """(requirements, seniority, experience_years, failure, attempts) of a posting.

    A blank description gives no requirements, without asking (its failure is "blank"). An answer that doesn't fit
    ``EXTRACTION_SCHEMA`` (kinds, weights, lengths, number of requirements) is asked for again, up to RETRIES times.
    """
    if not (description or "").strip():
        return [], None, None, "blank", 0
    got, failure, attempts = checked(model, (title, description), EXTRACTION_SCHEMA, RETRIES)
    if got is None:
        return None, None, None, failure, attempts
    found = [{"text": r["text"], "category": r["category"], "weight": r["weight"], "verifiable": r.get("verifiable", True)} for r in got["requirements"]]
    return found, got.get("seniority"), got.get("experience_years"), None, attempts


def extract(postings: DataFrame, cache: DataFrame, model: Callable[[str, str], dict], version: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(cached, fresh) extractions of postings (fingerprint, content_hash, title, description); see ``extraction``.

    What is "blank" isn't for the cache.
    """
    known = cache.filter((F.col("prompt_version") == version) & (F.col("model") == name)).select("fingerprint", "content_hash", "requirements", "seniority", "experience_years")
    cached = postings.select("fingerprint", "content_hash").join(known, ["fingerprint", "content_hash"])
    misses = postings.join(known.select("fingerprint", "content_hash"), ["fingerprint", "content_hash"], "left_anti").select("fingerprint", "content_hash", "title", "description")

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p.fingerprint, p.content_hash, *extraction(model, p.title, p.description)[:4]) for p in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["fingerprint", "content_hash", "requirements", "seniority", "experience_years", "failure"])

    return cached, misses.mapInPandas(call, _EXTRACTED)


REQUIREMENTS = "fingerprint string, requirement_index int, text string, category string, weight string, verifiable boolean, seniority string, experience_years int, failure string, attempts int"


def requirements_table(model: Callable[[str, str], dict | Answer]) -> object:
    """A table function of postings: a row for each requirement that the model finds, or one without for a posting that has none or has failed.

    Its table argument has fingerprint, title and description; partition it to spread the postings. Register it for SQL:
    ``spark.udtf.register("requirements", requirements_table(model))``, then
    ``SELECT * FROM requirements(TABLE(postings) PARTITION BY fingerprint)``.
    """

    class Requirements:
        def eval(self, row: Row) -> Iterator[tuple]:
            found, seniority, years, failure, attempts = extraction(model, row["title"], row["description"])
            rest = (seniority, years, failure, attempts)
            for i, r in enumerate(found or []):
                yield (row["fingerprint"], i, r["text"], r["category"], r["weight"], r["verifiable"], *rest)
            if not found:
                yield (row["fingerprint"], None, None, None, None, None, *rest)

    return F.udtf(Requirements, returnType=REQUIREMENTS)


def requirements_of(postings: DataFrame, model: Callable[[str, str], dict], by: Sequence[str] = ("fingerprint",)) -> DataFrame:
    """``requirements_table`` over postings, spread by columns."""
    return requirements_table(model)(postings.asTable().partitionBy(*by))


def match(postings: DataFrame, cache: DataFrame, partial: DataFrame, model: Callable[[dict], dict], version: str, name: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """(cached, fresh) matches of postings (fingerprint, requirements_hash, requirements).

    All requirements of a posting or none: the first call goes alone, the rest up to IN_FLIGHT at a time, and the first
    failure ends them. Requirements that an earlier try finished (partial: with requirement_index and match) aren't asked
    again. What a failed try did finish is in ``finished`` (requirement_index, match), for the partial table
    (``finished_matches``).
    """
    own = lambda df: df.filter((F.col("prompt_version") == version) & (F.col("model") == name) & (F.col("profile_hash") == profile))
    keys = ["fingerprint", "requirements_hash"]
    known = own(cache).select(*keys, "matches")
    cached = postings.select(*keys).join(known, keys)
    done = own(partial).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("requirement_index", "match"))).alias("done"))
    misses = postings.join(known.select(*keys), keys, "left_anti").join(done, keys, "left").select(*keys, "requirements", F.to_json("done").alias("done"))

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def one(item: tuple[int, dict]) -> tuple[int, dict | None, str | None]:
            i, requirement = item
            got, failure, _ = checked(model, (requirement,), MATCH_SCHEMA, 1)
            if got is None:
                return i, None, failure
            status = got.get("status") if got.get("evidence") is not None else "not_met"
            return i, {"requirement": requirement, "status": status, "evidence": got.get("evidence")}, None

        for part in parts:
            rows = []
            for p in part.itertuples(index=False):
                before = json.loads(p.done) if isinstance(p.done, str) else {}
                todo = [(i, dict(r)) for i, r in enumerate(p.requirements) if str(i) not in before]
                fresh: dict[int, dict] = {}
                failure = None
                # the first call alone, then IN_FLIGHT at a time, until one fails
                for group in [todo[:1], *(todo[k : k + IN_FLIGHT] for k in range(1, len(todo), IN_FLIGHT))]:
                    with ThreadPoolExecutor(IN_FLIGHT) as pool:
                        for i, got, failed in pool.map(one, group):
                            failure = failure or failed
                            if got is not None:
                                fresh[i] = got
                    if failure:
                        break
                out = {int(i): m for i, m in before.items()} | fresh
                finished = [{"requirement_index": i, "match": m} for i, m in sorted(fresh.items())] if failure else []
                rows.append((p.fingerprint, p.requirements_hash, None if failure else [out[i] for i in sorted(out)], failure, finished))
            yield pd.DataFrame(rows, columns=[*keys, "matches", "failure", "finished"])

    return cached, misses.mapInPandas(call, _MATCHED)


def finished_matches(fresh: DataFrame, version: str, name: str, profile: str) -> DataFrame:
    """Rows for the partial table from fresh matches: what failed tries finished."""
    each = fresh.filter(F.col("failure").isNotNull()).select("fingerprint", "requirements_hash", F.explode("finished").alias("f"))
    stamped = {"prompt_version": F.lit(version), "model": F.lit(name), "profile_hash": F.lit(profile)}
    return each.select("fingerprint", "requirements_hash", "f.requirement_index", "f.match").withColumns(stamped)


def partial_resume(requirements: DataFrame, partial: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Each requirement with its finished match of the same place and text, or null.

    requirements: key, requirements (array). partial: key, requirement_index, match.
    """
    each = requirements.select(key, F.posexplode("requirements").alias("requirement_index", "requirement"))
    known = partial.select(key, "requirement_index", F.col("match").alias("m"))
    joined = each.join(known, [key, "requirement_index"], "left")
    return joined.select(key, "requirement_index", "requirement", F.when(F.col("m.requirement.text").eqNullSafe(F.col("requirement.text")), F.col("m")).alias("match"))
