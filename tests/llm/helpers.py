"""Small hand-made tables for the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row int"
SHARED = "This very line is found in many of the documents"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "Über", "señor", "río", "the", "of", "and", "to", "in"]


def story(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(n)) + "."


def rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, exact and near
    copies, repeated rows, shared lines, symbols, a literal piece mark."""
    base = story(1, 120)
    near = base.replace("alpha", "alpha", 1)
    texts: list[str | None] = [
        base, base, near + "", None, "", "   \t ", "one", "one two", "ONE TWO", "# $ %", "▁ mark ▁▁ and \x00 zero",
        f"{SHARED}\nfirst own line here, long enough", f"  {SHARED.upper()} \nsecond", f"{SHARED}\n{SHARED}\nthird\n",
        f"x\r\n{SHARED}\r\n", "日本語のテキスト 漢字", "\n\n\n", story(2, 4000), "a " * 300, "🙂 smile  two   spaces",
    ]
    texts += [story(k, 60) + "\nCommon closing sentence of the site" for k in range(3, 15)]
    out = [(i, t, ["en", "de", None][i % 3], ["web", "books", None, "a"][i % 4], None if t is None else len(t), 0.5,
            "x", i) for i, t in enumerate(texts)]
    out += [out[0], out[4], out[12], (None, base, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None), (7, "another text of the same id", "en", "web", 3, 1.0, "y", 9)]
    return out


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def save(spark: SparkSession, frame: DataFrame, folder, name: str = "documents") -> str:
    frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
