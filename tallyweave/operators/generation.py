"""Personas, prompt batches, pluggable scoring and repair of scored batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A provider maps one batch row (a dict) to the text that a model would answer.
Provider = Callable[[dict], str]


def code_label(df: DataFrame, code: str, labels: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the code's label, the code as text if it has none, ``unknown`` if it is null.  labels: code, label."""
    looked = labels.select(F.col("code").alias("code_"), F.col("label").alias("label_"))
    joined = df.join(looked, F.col(code) == F.col("code_"), "left")
    return joined.withColumn(out, F.when(F.col(code).isNull(), "unknown").otherwise(F.coalesce("label_", F.col(code).cast("string")))).drop("code_", "label_")


def batches(df: DataFrame, key: str, size: int, by: list[str]) -> DataFrame:
    """Adds batch and position: consecutive slices of ``size`` rows in key order within each group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1
    return df.withColumn("batch", F.floor(n / size)).withColumn("position", (n % size) + 1)


def item_lines(df: DataFrame, text: str, separator: str = "\n") -> DataFrame:
    """Rows with item_no, item and kind in the place of ``text``: its lines without outer spaces, blank ones left out, kind ``likert``.

    item_no counts all lines from 0, so items keep their order; a null text gives none.
    """
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.posexplode(F.split(text, separator)).alias("item_no", "item"))
    return lines.withColumn("item", F.trim("item")).where("item <> ''").withColumn("kind", F.lit("likert"))


def item_table(likert: DataFrame, binary: DataFrame) -> DataFrame:
    """(item_no, item, kind): likert items, then binary ones, each in their own order; both have item_no and item."""
    both = likert.select("item_no", "item", F.lit("likert").alias("kind"), F.lit(0).alias("k_")).unionByName(binary.select("item_no", "item", F.lit("binary").alias("kind"), F.lit(1).alias("k_")))
    return both.withColumn("item_no", F.row_number().over(Window.orderBy("k_", "item_no", "item")) - 1).drop("k_")


#: Limits of one request: items, respondents, and the scales on offer.
MOST_ITEMS, LEAST_PEOPLE, MOST_PEOPLE, SCALES = 50, 10, 1000, (4, 5, 7, 9)


def check_request(n_items: int, n_people: int, scale: int, confirmed: bool = False) -> None:
    """Raises a ValueError for a request without items or people, off the scales, or over the limits without ``confirmed``."""
    if n_items < 1 or n_people < 1:
        raise ValueError("a request needs items and respondents")
    if scale not in SCALES:
        raise ValueError(f"the scale has to be one of {SCALES}")
    if not confirmed and (n_items > MOST_ITEMS or not LEAST_PEOPLE <= n_people <= MOST_PEOPLE):
        raise ValueError(f"over {MOST_ITEMS} items, or respondents outside {LEAST_PEOPLE} to {MOST_PEOPLE}, need a confirmation")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The table itself; a ValueError if it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def persona(fields: dict[str, Column], age: Column) -> Column:
    """A struct of the labelled fields (null becomes ``unknown``) and the age in whole years."""
    named = [F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in fields.items()]
    return F.struct(F.floor(age).cast("int").alias("age"), *named)


def dummy_personas(spark, n: int, choices: dict[str, list[str]], seed: int = 0, ages: tuple[int, int] = (18, 89)) -> DataFrame:
    """(person, age, the fields): n made-up people, uniform and reproducible."""
    fields = [F.element_at(F.array(*map(F.lit, values)), (F.floor(_unit(seed, name) * len(values)) + 1).cast("int")).alias(name) for name, values in choices.items()]
    age = (F.floor(_unit(seed, "age") * (ages[1] - ages[0] + 1)) + ages[0]).cast("int")
    return spark.range(n).select(F.col("id").alias("person"), age.alias("age"), *fields)


def _unit(seed: int, name: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def prompt_text(df: DataFrame, by: list[str], persona: Column, position: str) -> DataFrame:
    """(by, prompt): numbered persona lines of each batch in order."""
    line = F.format_string("Person %d: %s", F.col(position), persona)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("line"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("prompt"))


def with_items(prompts: DataFrame, items: DataFrame) -> DataFrame:
    """Prompts led by the request's items as numbered lines, what is asked, and the form of the answer; items has item and text."""
    line = F.struct("item", F.format_string("%d. %s", F.col("item"), F.col("text")).alias("line"))
    listed = items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "\n").alias("items_"), F.count("*").alias("n_"))
    whole = F.concat(
        F.lit("Estimate how survey respondents answer these items.\n\nItems:\n"), "items_",
        F.lit("\n\nGive each person below a score from 0.0 (rejects it) to 1.0 (agrees fully) for each item, as it fits that person; let people differ.\n\nPeople:\n"), "prompt",
        F.format_string("\n\nAnswer with a JSON array alone: one object a person, in order, with the numbers item_1 to item_%d.", F.col("n_")),
    )
    return prompts.crossJoin(F.broadcast(listed)).withColumn("prompt", whole).drop("items_", "n_")


def parsed_scores(answer: Column) -> Column:
    """array<map<string,double>> of a JSON answer without code fences; empty for anything else."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(answer, r"(?s)^\s*```(json)?\s*", ""), r"(?s)\s*```\s*$", ""))
    return F.coalesce(F.from_json(bare, "array<map<string,double>>"), F.array().cast("array<map<string,double>>"))


def repaired(scores: Column, m: Column, neutral: float = 0.5) -> Column:
    """m scores: neutral ones for none, the first m of more, the last repeated for fewer."""
    n = F.size(scores)
    padded = F.concat(scores, F.array_repeat(F.try_element_at(scores, F.lit(-1)), F.greatest(m - n, F.lit(0))))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.array_repeat(F.lit(neutral), m)).otherwise(F.slice(padded, F.lit(1), m))


def offline_provider(seed: int = 0) -> Provider:
    """A deterministic stand-in: scores from a checksum of seed, person and item; no network."""

    def answer(batch: dict) -> str:
        import json
        import zlib

        people, items = range(int(batch["n_people"])), range(1, int(batch["n_items"]) + 1)
        score = lambda p, i: zlib.crc32(f"{seed}/{batch['batch']}/{p}/{i}".encode()) % 10007 / 10006
        return json.dumps([{f"item_{i}": score(p, i) for i in items} for p in people])

    return answer


def answer_list(answer: str | None) -> list | None:
    """The list that a JSON answer states, with or without code fences; None for scalars, objects and anything that doesn't parse."""
    import json
    import re

    bare = re.sub(r"\s*```\s*\Z", "", re.sub(r"\A\s*```(json)?\s*", "", answer or ""))
    try:
        found = json.loads(bare)
    except ValueError:
        return None
    return found if isinstance(found, list) else None


def asked_again(provider: Provider, batch: dict, attempts: int) -> str:
    """The provider's answer; lost connections and timeouts are tried again, at most ``attempts`` calls, other errors are not."""
    for left in range(attempts - 1, -1, -1):
        try:
            return provider(batch)
        except (ConnectionError, TimeoutError):
            if not left:
                raise
    raise ValueError("attempts must be positive")


def score_batches(prompts: DataFrame, provider: Provider, attempts: int = 3) -> DataFrame:
    """Prompts (batch, n_people, n_items, prompt, ...) with ``answer``: the first answer that lists n_people results, else the last.

    Fences don't matter, as in ``parsed_scores``.  Lost connections and
    timeouts are tried again, ``attempts`` times in each attempt at most.  Task
    retries ask again, so a provider has to be idempotent for a batch.
    """
    columns = prompts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for row in frame.to_dict("records"):
                text = ""
                for _ in range(attempts):
                    text = asked_again(provider, row, attempts)
                    found = answer_list(text)
                    if found is not None and len(found) == row["n_people"]:
                        break
                answers.append(text)
            yield frame.assign(answer=answers)[[*columns, "answer"]]

    return prompts.mapInPandas(run, prompts.withColumn("answer", F.lit("")).schema)


def long_scores(answers: DataFrame, by: list[str], n_people: str = "n_people", n_items: str = "n_items") -> DataFrame:
    """(by, person, item, raw): repaired scores in long form; a missing or null score is null."""
    item = F.explode(F.sequence(F.lit(1), F.col(n_items).cast("int"))).alias("item")
    parsed = answers.select(*by, F.col(n_people).cast("int").alias("n_"), item, parsed_scores(F.col("answer")).alias("maps"))
    raw = F.transform("maps", lambda m: F.try_element_at(m, F.concat(F.lit("item_"), F.col("item").cast("string"))))
    return parsed.select(*by, "item", F.posexplode(repaired(raw, F.col("n_"))).alias("person", "raw"))


def wide(df: DataFrame, by: list[str], item: str, value: str, items: list) -> DataFrame:
    """One column per item; the items are named, so no pass collects them."""
    return df.groupBy(*by).pivot(item, items).agg(F.first(value))
