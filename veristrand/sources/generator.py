"""The boundary to a text generator, and a deterministic one for tests and oracles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import KINDS


class Generator(Protocol):
    """Answers a prompt with a model. Runs on executors, so it must pickle."""

    def __call__(self, model: str, prompt: str) -> str: ...


class EmptyAnswer(RuntimeError):
    """The model answered nothing: it may hang, so it is loaded anew before the next try."""


class AnswerTimeout(RuntimeError):
    """The model did not answer in time; asking again at once would only wait again."""


class ModelsMissing(RuntimeError):
    """A batch asks for models that the generator doesn't have."""


def missing_models(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """model, each once: those of wanted (model) that available (model) hasn't; null models ask for nothing."""
    return wanted.where("model is not null").select("model").distinct().join(available.select("model"), "model", "left_anti")


def check_models(wanted: DataFrame, generator: Generator) -> None:
    """Raise, naming them, if models are missing; a generator that can't list its models (``models()``) or reach them is believed."""
    try:
        names = list(generator.models()) if hasattr(generator, "models") else None
    except Exception:  # whoever is asked next will tell
        names = None
    if names is None:
        return
    lacking = missing_models(wanted, wanted.sparkSession.createDataFrame([(n,) for n in names], "model string")).orderBy("model").limit(20).collect()
    if lacking:
        raise ModelsMissing("models not found: " + ", ".join(r[0] for r in lacking))


def generate(prompts: DataFrame, generator: Generator, check: Callable[..., str | None] | None = None, retries: int = 1) -> DataFrame:
    """prompts (model, prompt, other columns) with answer, error, attempts.

    check names what is wrong with an answer, or None; a wrong one is asked for again with a
    repair prompt. Where prompts have a column ``allowed``, check gets its value as well. After
    an empty answer the generator's ``reload(model)``, if it has one, comes before the next try;
    a timeout isn't tried again. Failures are told in error, never raised, so one paper stops
    no other.
    """
    bound = "allowed" in prompts.columns

    def one(model: str, prompt: str, *allowed) -> tuple[str | None, str | None, int]:
        answer, error = None, None
        for attempt in range(retries + 1):
            try:
                ask = prompt if attempt == 0 else repair_prompt(prompt, answer or "", error or "")
                answer = generator(model, ask)
                if not answer.strip():
                    raise EmptyAnswer("empty answer")
                error = check(answer, *allowed) if check else None
            except EmptyAnswer as e:
                error = str(e)
                if attempt < retries and hasattr(generator, "reload"):
                    generator.reload(model)
            except AnswerTimeout as e:
                return answer, f"AnswerTimeout: {e}", attempt + 1
            except Exception as e:  # told in its row
                error = f"{type(e).__name__}: {e}"
            if error is None:
                return answer, None, attempt + 1
        return answer, error, retries + 1

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = [one(*x) for x in zip(*(pdf[c] for c in ["model", "prompt", *["allowed"] * bound]), strict=True)]
            yield pdf.assign(answer=[x[0] for x in out], error=[x[1] for x in out], attempts=[x[2] for x in out])

    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    return prompts.mapInPandas(run, schema)


def repair_prompt(prompt: str, answer: str, error: str) -> str:
    return f"{prompt}\n\nThe last response failed validation. Return a corrected JSON object only.\nError: {error}\nLast response:\n{answer[:8000]}"


def extractive_proposals(members: DataFrame, every: int = 3) -> DataFrame:
    """Proposals that quote a chunk's pages: paper, chunk_index, ord, kind, statement, support, page.

    Each page whose number is divisible by every gives its first sixty characters, with a
    kind by its number; each divisible by twice that a quote that is not there.
    """
    kinds = F.array(*map(F.lit, KINDS))
    rows = members.where((F.col("number") % every == 0) & (F.col("part") == 0))
    kind = F.get(kinds, F.col("number") % len(KINDS))
    true = F.struct(F.lit(0).alias("side"), F.substring("text", 1, 60).alias("support"))
    false = F.when(F.col("number") % (2 * every) == 0, F.struct(F.lit(1).alias("side"), F.concat(F.lit("never said: "), F.substring("text", 1, 40)).alias("support")))
    both = rows.select("paper", "chunk_index", "number", kind.alias("kind"), F.explode(F.filter(F.array(true, false), lambda x: x.isNotNull())).alias("x"))
    return both.select("paper", "chunk_index", (F.col("number") * 2 + F.col("x.side")).cast("int").alias("ord"), "kind", F.concat(F.lit("page "), F.col("number").cast("string")).alias("statement"), F.col("x.support").alias("support"), F.col("number").cast("string").alias("page"))


def repair_of(prompt: Column, answer: Column, error: Column) -> Column:
    """``repair_prompt`` over columns."""
    none = F.lit("")
    return F.concat(prompt, F.lit("\n\nThe last response failed validation. Return a corrected JSON object only.\nError: "), F.coalesce(error, none), F.lit("\nLast response:\n"), F.substring(F.coalesce(answer, none), 1, 8000))


def map_prompt(content: Column, chunk: Column | None = None, numbers: Column | None = None) -> Column:
    """Asks for evidence out of a chunk; with its number and pages where they are given."""
    ask = F.lit("Quote evidence from these pages as a JSON object with chunk_summary and evidence (kind, statement, support, page).\n\n")
    which = F.lit("") if chunk is None else F.format_string("Chunk: %d; allowed pages: [%s]\n\n", chunk, F.array_join(numbers, ", "))
    return F.concat(ask, which, content)


def stream_answer(lines: DataFrame) -> DataFrame:
    """Answers out of line-delimited JSON (request, seq, line): request, text, thinking_chars, done.

    Response pieces are joined in order up to the line that says done; thinking is only counted.
    """
    schema = "response string, thinking string, done boolean"
    rows = lines.withColumn("x", F.from_json("line", schema)).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("seq", "x"))).alias("rows"))
    end = F.coalesce(F.array_position(F.transform("rows", lambda r: F.coalesce(r["x"]["done"], F.lit(False))), True), F.lit(0))
    kept = F.when(end > 0, F.slice("rows", 1, end.cast("int"))).otherwise(F.col("rows"))
    text = F.array_join(F.transform(kept, lambda r: F.coalesce(r["x"]["response"], F.lit(""))), "")
    thinking = F.aggregate(kept, F.lit(0), lambda a, r: a + F.coalesce(F.length(r["x"]["thinking"]), F.lit(0)))
    return rows.select("request", text.alias("text"), thinking.alias("thinking_chars"), (end > 0).alias("done"))


def rendered(dot: Column, render: Callable[[str], str | None]) -> Column:
    """SVG of DOT source by a renderer on the executors; null where it fails."""
    def safe(src: str | None) -> str | None:
        try:
            return None if src is None else render(src)
        except Exception:  # a failed picture is no failed paper
            return None

    @F.pandas_udf(T.StringType())
    def svg(src: pd.Series) -> pd.Series:
        return src.map(safe)

    return svg(dot)
