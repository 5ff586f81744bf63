"""The model of the registered queries; by itself, as executors import it."""

from __future__ import annotations

import json

from ..operators import model_output


def answer(prompt: str) -> str:
    """A model that answers by the number that a prompt begins with: well, fenced, with a wrong weight, in prose at first, late, with too many requirements, or not at all."""
    number, kind = int(prompt.split("\n", 1)[0]), int(prompt.split("\n", 1)[0]) % 8
    found = [{"text": f"r{i} of {number}", "category": "skill", "weight": ("mandatory", "desirable")[i % 2]} for i in range(2)]
    if kind == 2:
        found[1]["weight"] = "urgent"
    if kind == 3 and model_output.REPAIR not in prompt:
        return "I would rather talk about it."
    if kind == 4:
        raise model_output.TransportError("timeout")
    if kind == 5:
        found = found * 21
    if kind == 6:
        raise model_output.TransportError("authError")
    if kind == 7:
        found = []
    told = json.dumps({"requirements": found, "seniority": "junior" if number % 3 else None, "experience_years": number % 5})
    return f"```json\n{told}\n```" if kind == 1 else told
