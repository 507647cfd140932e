"""The thin queries of the check contract and their SQL. Each gets its rows through its operator."""

from __future__ import annotations

from ..session import table
from .collocations import ORACLE as _collocations
from .decontaminate import ORACLE as _decontaminate
from .exactdedup import ORACLE as _exactdedup
from .infill import ORACLE as _infill
from .licenses import ORACLE as _licenses
from .neardup import ORACLE as _neardup
from .substring import ORACLE as _substring


def op9_fingerprint(spark, sf_dir):
    from .fingerprint import edited_neighbours

    return edited_neighbours(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    from .decontaminate import digests

    return digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_brown(spark, sf_dir):
    from .brown import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    from .toxicity import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substrings(spark, sf_dir):
    from .substring import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_neardup(spark, sf_dir):
    from .neardup import digests

    return digests(table(spark, sf_dir, "documents"))


def op6_licenses(spark, sf_dir):
    from .licenses import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_html(spark, sf_dir):
    from .htmltext import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_packing(spark, sf_dir):
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_infill(spark, sf_dir):
    from .infill import digests

    return digests(table(spark, sf_dir, "documents"))


def op13_exactdedup(spark, sf_dir):
    from .exactdedup import digests

    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_brown": op1_brown, "op2_toxicity": op2_toxicity, "op3_substrings": op3_substrings, "op7_bpe": op7_bpe, "op4_neardup": op4_neardup, "op5_html": op5_html, "op6_licenses": op6_licenses, "op8_decontamination": op8_decontamination, "op9_fingerprint": op9_fingerprint, "op10_packing": op10_packing, "op11_collocations": op11_collocations, "op12_infill": op12_infill, "op13_exactdedup": op13_exactdedup}
ORACLE: dict[str, str] = {"op3_substrings": _substring, "op4_neardup": _neardup, "op6_licenses": _licenses, "op8_decontamination": _decontaminate, "op11_collocations": _collocations, "op12_infill": _infill, "op13_exactdedup": _exactdedup}
