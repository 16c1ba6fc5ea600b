"""Tracked changes in CriticMarkup: marks, accept-all and reject-all views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INS, _DEL, _SUB, _NOTE, _MARK = (
    r"(?s)\{\+\+(.*?)\+\+\}", r"(?s)\{--(.*?)--\}", r"(?s)\{~~(.*?)~>(.*?)~~\}", r"(?s)\{>>(.*?)<<\}", r"(?s)\{==(.*?)==\}",
)


def accept(text: Column) -> Column:
    """The text with every change accepted and comments gone."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _NOTE, ""), _SUB, "$2"), _DEL, "")
    return F.regexp_replace(F.regexp_replace(out, _INS, "$1"), _MARK, "$1")


def reject(text: Column) -> Column:
    """The text with every change rejected and comments gone."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _NOTE, ""), _SUB, "$1"), _INS, "")
    return F.regexp_replace(F.regexp_replace(out, _DEL, "$1"), _MARK, "$1")


def changes(text: Column) -> Column:
    """struct<insertions, deletions, substitutions, comments, highlights>: how many of each."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct(count(_INS).alias("insertions"), count(_DEL).alias("deletions"), count(_SUB).alias("substitutions"), count(_NOTE).alias("comments"), count(_MARK).alias("highlights"))


def comment(author: Column, date: Column, text: Column) -> Column:
    """'Author (date): text', without what is missing."""
    head = F.concat_ws(" ", author, F.when(date.isNotNull(), F.concat(F.lit("("), date, F.lit(")"))))
    return F.when(head != "", F.concat(head, F.lit(": "), text)).otherwise(text)


def change_kind(local_name: Column) -> Column:
    """'insertion', 'deletion' or null by the element's name."""
    return F.when(local_name.isin("ins", "moveTo"), "insertion").when(local_name.isin("del", "moveFrom"), "deletion")
