"""The language-model steps behind one interface, with a deterministic offline default.

A provider is a picklable object whose methods work on plain Python values; the pipeline calls them in
Arrow batches on the executors. ``RuleProvider`` reads headings, quantities and names by rules.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol

from tidemark.operators.units import _NUMBER, _UNIT, read_number, unit_code

_HEADING = re.compile(r"\s*(ingredients|you will need|for the dish|directions|instructions|method)\s*:?\s*$", re.I)
_LABEL = re.compile(r"\s*(servings?|serves|prep(?:aration)? time|cook(?:ing)? time)\s*:\s*(.+?)\s*$", re.I)
_QUANTITY = re.compile(rf"\s*(?P<n>{_NUMBER})\s*(?P<u>{_UNIT})?(?:\s+of)?\s+(?P<name>.+)$")
#: Grams in one cup of a few ingredients, for conversion to weights.
CUP_GRAMS = {"flour": 125.0, "sugar": 200.0, "butter": 227.0, "milk": 245.0, "water": 237.0, "rice": 185.0, "honey": 340.0}
_CUPS = {"cup": 1.0, "tbsp": 1 / 16, "tsp": 1 / 48, "pint": 2.0, "quart": 4.0, "ml": 1 / 236.5882365, "l": 1000 / 236.5882365}


class Provider(Protocol):
    def extract(self, text: str, plain: bool) -> list[dict]: ...
    def refine(self, raw: dict, weights: bool) -> dict: ...
    def classify(self, record: dict, axes: dict[str, list[str]]) -> dict[str, list[str]]: ...
    def embed(self, text: str) -> list[float]: ...
    def normalise_table(self, text: str) -> str: ...


class RuleProvider:
    """Rules only: same input, same output, no network."""

    dimensions = 1536

    def normalise_table(self, text: str) -> str:
        return text

    def extract(self, text: str, plain: bool = False) -> list[dict]:
        """Recipes of a text: the last line before each ingredient heading is the name; none without a section."""
        recipes: list[dict] = []
        current, section, before = None, None, []
        for line in text.splitlines():
            heading = _HEADING.match(line)
            if heading:
                kind = "directions" if heading[1].lower() in ("directions", "instructions", "method") else "ingredients"
                if current is None or (kind == "ingredients" and (current["ingredients"] or current["directions"])):
                    head = [b for b in before if b.strip()] if current is None else [b for b in before if b.strip()][-1:]
                    current = {"name": head[0].strip() if head else "", "servings": None, "prep_time": None, "cook_time": None, "ingredients": [], "directions": []}
                    for b in before:
                        if m := _LABEL.match(b):
                            current[_label_key(m[1])] = m[2]
                    recipes.append(current)
                section, before = kind, []
            elif current is None or section is None:
                before.append(line)
            elif m := _LABEL.match(line):
                current[_label_key(m[1])] = m[2]
            elif line.strip():
                if section == "directions" and not re.match(r"\s*(?:\d+[.)]|[-*•])\s", line) and current["directions"] and not line.rstrip().endswith((".", "!", "?")):
                    before.append(line)
                else:
                    current[section].append(re.sub(r"^\s*(?:\d+[.)]|[-*•])\s+", "", line).strip() if section == "directions" else re.sub(r"^\s*[-*•]\s+", "", line).strip())
        return [r for r in recipes if r["name"]]

    def refine(self, raw: dict, weights: bool = False) -> dict:
        """Numbered ingredients with amount, unit and name, and directions that refer to them."""
        ingredients = []
        for i, line in enumerate(raw["ingredients"] or [], 1):
            m = _QUANTITY.match(line)
            amount, unit, name = (read_number(m["n"]), m["u"], m["name"]) if m else (0.0, None, line)
            name = re.split(r"[,(]", name)[0].strip() or name.strip()
            item = {
                "id": f"ing_{i:02d}", "amount": float(amount) if math.isfinite(amount) else 0.0, "unit": unit, "name": name, "fallback_string": line,
                "converted_amount": None, "converted_unit": None, "is_ai_converted": False,
            }
            code = unit_code(unit) if unit else None
            if weights and code in _CUPS:
                grams = next((g for word, g in CUP_GRAMS.items() if word in name.lower()), None)
                if grams:
                    item.update(converted_amount=round(amount * _CUPS[code] * grams, 1), converted_unit="g", is_ai_converted=True)
            ingredients.append(item)
        longest = sorted((x for x in ingredients if x["name"]), key=lambda x: -len(x["name"]))
        directions = []
        for step, text in enumerate(raw["directions"] or [], 1):
            for item in longest:
                at = re.search(rf"(?<!\w){re.escape(item['name'])}(?!\w)", text, re.I)
                if at and "}" not in item["fallback_string"] and "|" not in item["fallback_string"]:
                    text = f"{text[: at.start()]}{{{{{item['id']}|{item['fallback_string']}}}}}{text[at.end():]}"
                    break
            directions.append({"step": step, "text": text})
        servings = re.search(r"\d+", raw.get("servings") or "")
        return {
            "title": raw["name"], "base_servings": int(servings[0]) if servings and len(servings[0]) < 9 else None,
            "prep_time": raw.get("prep_time"), "cook_time": raw.get("cook_time"), "ingredients": ingredients, "directions": directions,
        }

    def classify(self, record: dict, axes: dict[str, list[str]]) -> dict[str, list[str]]:
        """Tags named in the title or an ingredient, two an axis at most, in the order of the axes."""
        text = " ".join([record["title"], *(i["name"] for i in record["ingredients"])]).lower()
        return {a: [t for t in tags if t.lower() in text][:2] for a, tags in axes.items()}

    def embed(self, text: str) -> list[float]:
        """Signed hashing of the words into the vector, at unit length."""
        sums: dict[int, float] = {}
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            sums[h % self.dimensions] = sums.get(h % self.dimensions, 0.0) + (1.0 if h >> 63 else -1.0)
        norm, vector = math.sqrt(sum(v * v for v in sums.values())), [0.0] * self.dimensions
        for i, v in sums.items():
            vector[i] = v / norm if norm else v
        return vector


def _label_key(label: str) -> str:
    label = label.lower()
    return "servings" if label.startswith("serv") else "prep_time" if label.startswith("prep") else "cook_time"
