"""Text columns: normal form and the answer rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accents that are folded, the answer rules' phrases in order of their priority, and the scores.
ACCENTS = "áàäâÁÀÄÂéèëêÉÈËÊíìïîÍÌÏÎóòöôÓÒÖÔúùüûÚÙÜÛñÑ"
PLAIN = "aaaaaaaaeeeeeeeeiiiiiiiioooooooouuuuuuuunn"
QUESTION_BACK = (
    "cual es", "cuales son", "que es eso", "que es esto", "que es esa", "a que se refiere", "no entiendo", "podria repetir",
    "puede repetir", "como dice", "perdon cual", "disculpe cual",
)
DENIAL = ("no tengo", "no cuento con", "no se", "no lo se", "no existe", "no me aparece", "no manejo", "no cuento", "ninguna", "ningun", "no cual")
HEDGE = (
    "creo que", "creo qie", "no estoy segur", "no estoy muy segur", "me imagino", "mas o menos", "tal vez", "talvez", "quizas",
    "supongo", "posiblemente", "puede que",
)
PRODUCT = (
    "nomina plus", "no mina plus", "no mine plus", "no mine a plus", "no minea plus", "no me ena plus", "no me na plus", "no mi no plus",
    "nomina fluz", "nomina flus", "nominaplus", "credito verde", "credito berde", "creditoverde", "redito verde", "decreto verde", "creto verde",
)
NAME_INTRO = r"\b(?:me llamo|mi nombre es|soy)\b\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+"
INVENTION = {"assertion_numeric": 0.90, "assertion_product": 0.85, "assertion_name": 0.80, "other": 0.50, "hedge": 0.35, "question_back": 0.15, "denial": 0.05}


def normalize_text(text: Column) -> Column:
    """Lower case without accents or punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, ACCENTS, PLAIN)), "[^a-z0-9]+", " "))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def any_of(phrases: tuple[str, ...]) -> str:
    """A pattern that finds any of the phrases, folded by common beginnings, so that most places of a text are left at their first letter."""
    tails: dict[str, list[str]] = {}
    for p in phrases:
        tails.setdefault(p[:1], []).append(p[1:])
    if "" in tails:  # a phrase ends here: longer ones add nothing
        return ""
    parts = [re.escape(head) + any_of(tuple(rest)) for head, rest in tails.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def classify_answer(text: Column, ignore_case: bool = False) -> Column:
    """The first rule that fits; an empty answer is 'other'."""
    name = ("(?i)" if ignore_case else "") + NAME_INTRO

    def rules(norm: Column) -> Column:
        return (
            F.when(norm.rlike(any_of(QUESTION_BACK)), "question_back")
            .when(norm.rlike(any_of(DENIAL)), "denial")
            .when(norm.rlike(any_of(HEDGE)), "hedge")
            .when(text.rlike("[0-9][^0-9]*+[0-9][^0-9]*+[0-9]"), "assertion_numeric")
            .when(norm.rlike(any_of(PRODUCT)), "assertion_product")
            .when(text.rlike(name), "assertion_name")
            .otherwise("other")
        )

    return F.when(text.isNull() | ~text.rlike(r"\S"), "other").otherwise(once(normalize_text(text), rules))


def invention_score(answer_type: Column) -> Column:
    """The fixed score of an answer type, null for any other string."""
    return once(answer_type, lambda kind: F.create_map(*[F.lit(x) for pair in INVENTION.items() for x in pair])[kind])


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))
