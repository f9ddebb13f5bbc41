"""TOML files as JSON text, so that the JSON functions read them."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def as_json(text: str | None) -> str | None:
    """JSON of a TOML document; dates and times are strings. Null for text that isn't TOML."""
    try:
        return None if text is None else json.dumps(tomllib.loads(text.replace("\r\n", "\n")), default=str)
    except (ValueError, RecursionError):  # TOMLDecodeError is a ValueError
        return None


@pandas_udf(StringType())
def toml_json(texts: pd.Series) -> pd.Series:
    return texts.map(as_json, na_action="ignore").astype(object)
