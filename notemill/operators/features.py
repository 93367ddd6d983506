"""Features of clinical notes with the default lexicons: symptoms, labels, context, laboratory marks, coverage, complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions import lexicons, text
from notemill.operators import cohort, profile


def sections(body: Column) -> Column:
    """All sections of a note, as a map; give it to the functions below to cut a note only once."""
    return text.sections(body, lexicons.SECTIONS)


def _section(body: Column, name: str, cut: Column | None) -> Column:
    return text.section(body, *lexicons.SECTIONS[name]) if cut is None else F.try_element_at(cut, F.lit(name))


def symptoms(body: Column, cut: Column | None = None) -> dict[str, Column]:
    """A flag for each symptom in the history of present illness; null without that section."""
    return text.flags(_section(body, "hpi", cut), lexicons.SYMPTOMS)


def alert(flags: dict[str, Column]) -> Column:
    """The case definition: fever with at least one of four further symptoms."""
    return flags["fever"] & profile.any_of(*[flags[k] for k in ("headache", "myalgia", "arthralgia", "rash")])


def labels(body: Column, cut: Column | None = None) -> dict[str, Column]:
    """A flag for each disease in the discharge diagnosis; null without that section."""
    return text.flags(_section(body, "diagnosis", cut), lexicons.LABELS, "diag_")


def context(body: Column, cut: Column | None = None) -> dict[str, Column]:
    """Travel, medication on admission, the first temperature of the exam and whether it is a fever (over 100.4)."""
    history, medication, exam = (_section(body, k, cut) for k in ("hpi", "admission_context", "exam_context"))
    measured = text.capture(exam, "(?i)" + lexicons.TEMPERATURE).try_cast("double")
    return {
        "travel": text.has(history, lexicons.TRAVEL),
        "antipyretic": text.has(medication, lexicons.ANTIPYRETIC),
        "antimalarial": text.has(medication, lexicons.ANTIMALARIAL),
        "measured": measured,
        "objective_fever": measured > 100.4,
    }


def laboratory(body: Column, cut: Column | None = None) -> dict[str, Column]:
    """Diabetes and hypertension in the past history, low platelets anywhere."""
    past = _section(body, "past_history", cut)
    return {"diabetes": text.has(past, lexicons.DIABETES), "hypertension": text.has(past, lexicons.HYPERTENSION), "platelets": text.has(body, lexicons.PLATELETS)}


def target_mentions(body: Column, target: Column) -> Column:
    """How often the row's target (or an alias of it) is mentioned outside the first header block; 0 for unknown ones."""
    return cohort.mentions(text.without_first_block(body), text.canonical(target, lexicons.ALIASES), lexicons.MENTIONS)


def complexity(body: Column) -> Column:
    """The score of a note that is hard to read."""
    counted = {k: text.count(body, lexicons.COMPLEXITY[k]) for k in ("negations", "pending", "differentials", "medications")}
    present = {k: text.has(body, lexicons.COMPLEXITY[k]) for k in ("haart", "tb_tests")}
    return cohort.complexity(counted, present, F.length(body))
