"""Places where a caller's own function comes in: importers, encoders, scorers, token counters, batch maps. All move Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import chat

Importer = Callable[[SparkSession, str], DataFrame]
#: Importers by suffix; ``register`` adds more.
IMPORTERS: dict[str, Importer] = {".txt": chat.txt_messages, ".csv": chat.csv_rows, ".json": chat.json_messages, ".jsonl": chat.json_messages}


def register(suffix: str, importer: Importer) -> None:
    IMPORTERS[suffix.lower()] = importer


def imported(spark: SparkSession, path: str) -> DataFrame:
    """The messages of a file, by the importer of its suffix; paths may not leave their folder by ``..``."""
    suffix = path[path.rfind(".") :].lower()
    if ".." in path.split("/"):
        raise ValueError("the path leaves its folder")
    if suffix not in IMPORTERS:
        raise ValueError(f"unsupported format: {suffix}")
    return IMPORTERS[suffix](spark, path)


def encoded(text: Column, make: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]) -> Column:
    """Vectors of texts by a model that ``make`` loads once a worker, not once a batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(text)


def scored(query: Column, content: Column, scorer: Callable[[str, str], float]) -> Column:
    """A caller's (query, content) score of each pair."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(scorer(x or "", y or "")) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, T.DoubleType())(query, content)


def words(text: str) -> int:
    """The default token counter: runs of anything but ASCII white space."""
    return len(text.encode().split())


def request_tokens(text: Column, prompt: str, schema: str, count: Callable[[str], int] = words, overhead: int = 96) -> Column:
    """Tokens of a request: prompt, schema, the text itself and what every request costs."""
    fixed = count(prompt) + count(schema) + overhead

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fixed + count(t or "")).astype("int64")

    return F.pandas_udf(run, T.LongType())(text)


def mapped(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` over the rows, a batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return df.mapInPandas(run, schema)
