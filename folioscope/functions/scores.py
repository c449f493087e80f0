"""Scores of graph items and summaries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import terms

#: Terms that make an item fully specific, evidence dense, a quotation dense; fixed values.
SPECIFIC, DENSE, QUOTED = 18, 28, 42
#: Weights of coverage, faithfulness, density and rubric; fixed values.
BLEND = (0.45, 0.35, 0.10, 0.10)


def _share(text: Column, most: int) -> Column:
    return F.least(F.lit(1.0), F.size(terms(text)) / most)


def claim_score(grounding: Column, claim: Column, evidence: Column) -> Column:
    return F.round(grounding + _share(claim, SPECIFIC) + _share(evidence, DENSE), 4)


def concept_score(name_fit: Column, evidence_fit: Column, definition: Column, evidence: Column) -> Column:
    return F.round(F.greatest(name_fit, evidence_fit) + _share(definition, SPECIFIC) + _share(evidence, DENSE), 4)


def passage_score(grounding: Column, passage: Column, why: Column) -> Column:
    return F.round(grounding + _share(why, SPECIFIC) + _share(passage, QUOTED), 4)


def rubric_normal(grades: list[Column]) -> Column:
    """The mean of grades from 1 to 5, from 0 to 1."""
    return (sum(grades[1:], grades[0]) / len(grades) - 1) / 4


def density_score(covered: Column, words: Column, target: float = 1.0) -> Column:
    """Covered facts per hundred words against a target, 1 at most."""
    return F.least(F.lit(1.0), covered / F.greatest(words, F.lit(1)) * 100 / target)


def blended(coverage: Column, faithfulness: Column, density: Column, rubric: Column) -> Column:
    return BLEND[0] * coverage + BLEND[1] * faithfulness + BLEND[2] * density + BLEND[3] * rubric
