"""Unicode normal forms of columns."""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


@cache
def _form(form: str):
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "string")


def normal_form(c: Column, form: str = "NFKC") -> Column:
    """c in a normal form. ASCII texts, which are in all of them, stay in Spark; the others go to Python in batches."""
    if form not in FORMS:
        raise ValueError(f"no such form: {form}")
    beyond = F.octet_length(c) != F.char_length(c)
    return F.when(beyond, _form(form)(F.when(beyond, c))).otherwise(c)


def plain_name(c: Column) -> Column:
    """Lower-case letters a-z and digits of a name without accents, other runs a blank; null is empty."""
    bare = F.regexp_replace(normal_form(F.coalesce(c, F.lit("")), "NFD"), "[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))
