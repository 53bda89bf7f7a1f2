"""What differs between the source languages; everything else is one implementation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from .functions import text as T


@dataclass(frozen=True)
class SlotSpec:
    """One source language: its normaliser, how its lines are cleaned, its counts and filters, its split."""

    name: str
    normalize: Callable[[Column], Column]
    clean: Callable[[Column], Column]
    min_count: int = 5
    alternates: Callable[[Column], Column] | None = None
    keep_gloss: Callable[[Column], Column] = T.keep_sumerian_gloss
    filter_first: bool = False
    negators: tuple[str, ...] = T.NEGATORS
    split_fallback: str = "gloss"
    subwords_for_training: bool = False
    miss_buckets: int = 7
    projects: tuple[str, ...] = field(default=())


#: The project archives that each source is built from.
SUMERIAN_PROJECTS = ("epsd2/admin/ur3", "epsd2/admin/ed3b", "epsd2/admin/ed3a", "epsd2/literary", "etcsri", "dcclt")
OLD_BABYLONIAN_PROJECTS = ("hbtin", "saao/saa", "blms", "rinap/rinap1")
LETTER_PROJECTS = ("saao/saa01", "saao/saa17")
#: Later Akkadian, for training vectors only, never for anchors.
STANDARD_BABYLONIAN_PROJECTS = (
    "rinap/rinap1", "rinap/rinap3", "rinap/rinap4", "rinap/rinap5", "saao/saa01", "saao/saa17", "saao/saa18", "saao/saa19", "cams/akklove", "cams/anzu", "cams/gkab",
    "rinap/rinap2", "rinap/rinap5p1", "saao/saa02", "saao/saa03", "saao/saa04", "saao/saa05", "saao/saa06", "saao/saa07", "saao/saa08", "saao/saa09", "saao/saa10",
    "saao/saa11", "saao/saa12", "saao/saa13", "saao/saa14", "saao/saa15", "saao/saa16", "saao/saa20", "saao/saa21", "ribo/babylon2", "ribo/babylon3", "ribo/babylon4",
    "ribo/babylon5", "ribo/babylon6", "ribo/babylon7", "cmawro/cmawr1", "cmawro/cmawr2", "cmawro/maqlu", "asbp/ninmed", "asbp/rlasb", "adsd/adart1", "adsd/adart2",
    "adsd/adart3", "atae/assur", "atae/kalhu", "atae/nineveh", "atae/tushhan", "borsippa", "suhu", "btmao", "btto", "iraq/iraq85", "glass", "amgg", "ario",
    "contrib/amarna", "contrib/lambert", "cams/barutu", "cams/ludlul", "cams/selbi", "cams/tlab",
)


def _atf(normalize, capitals_first: bool = True):
    return lambda c: T.clean_atf_line(c, normalize, capitals_first)


SLOTS = {
    s.name: s
    for s in (
        SlotSpec("sumerian", T.normalize_sumerian, _atf(None, False), miss_buckets=6, projects=SUMERIAN_PROJECTS),
        SlotSpec("akkadian", T.normalize_akkadian, _atf(T.normalize_akkadian), alternates=T.mimation_alternates, filter_first=True, subwords_for_training=True, projects=OLD_BABYLONIAN_PROJECTS + LETTER_PROJECTS),
        SlotSpec("hittite", T.normalize_hittite, _atf(T.normalize_hittite), alternates=T.clitic_alternates, keep_gloss=T.keep_german_gloss, negators=T.NEGATORS + T.GERMAN_NEGATORS, subwords_for_training=True),
        SlotSpec("greek", T.normalize_greek, _atf(T.normalize_greek), subwords_for_training=True),
        SlotSpec("egyptian", T.normalize_egyptian, _atf(T.normalize_egyptian), split_fallback="surface_casefold"),
        SlotSpec("sanskrit", T.normalize_sanskrit, T.clean_line, min_count=2, subwords_for_training=True),
    )
}
