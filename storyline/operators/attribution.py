"""Attribution: requests to a language model for the quotes that rules left open, its answers folded in, and the lines that result."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, prompts
from ..functions.folds import context_windows
from ..functions.text import approx_tokens, tokens_of  # noqa: F401
from ..providers import PromptTooLong
from .cast import Character, names_for_chapter, resolver

ANSWERS = "struct<speakers:array<struct<quote_id:int,speaker:string,confidence:double,style:string>>>"
LINE = ["id", "chapter", "para", "kind", "speaker", "text", "lang", "style", "confidence", "locked"]


def prompt_budget(num_ctx: int = 16384) -> int:
    return num_ctx - fixed.OUTPUT_RESERVE


def window_budget(overhead: int, num_ctx: int = 16384) -> int:
    """Tokens left for text beside a fixed part of `overhead` tokens."""
    left = prompt_budget(num_ctx) - overhead
    if left < fixed.LEAST_WINDOW:
        raise PromptTooLong(f"the fixed part of {overhead} tokens leaves {left} of a context of {num_ctx}")
    return left


def over_budget(prompts: DataFrame, num_ctx: int = 16384) -> DataFrame:
    """Prompts (system, prompt) that must not be sent."""
    need = approx_tokens(F.coalesce("system", F.lit(""))) + approx_tokens(F.col("prompt"))
    return prompts.withColumn("tokens", need).where(F.col("tokens") > prompt_budget(num_ctx))


def rendered(kind: Column, text: Column, quote_id: Column, speaker: Column) -> Column:
    """A span as a request shows it."""
    who = F.concat(F.lit("("), F.coalesce(speaker, F.lit("?")), F.lit(")"))
    return F.when(kind == "dialogue", F.concat(F.lit("[q"), quote_id.cast("string"), F.lit("]"), who, F.lit(' "'), text, F.lit('"'))).otherwise(text)


def paragraphs_shown(spans: DataFrame) -> DataFrame:
    """(chapter, para, passage, cost, pending, quotes): each paragraph as shown."""
    one = F.struct("span", rendered(F.col("kind"), F.col("text"), F.col("quote_id"), F.col("speaker")).alias("t"))
    out = spans.groupBy("chapter", "para").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), " ").alias("passage"),
        F.count_if((F.col("kind") == "dialogue") & F.col("speaker").isNull()).alias("pending"),
        F.count_if(F.col("kind") == "dialogue").alias("quotes"),
    )
    return out.withColumn("cost", approx_tokens(F.col("passage")) + 2)


def requests(spans: DataFrame, budget: int, styled: bool = False) -> DataFrame:
    """(chapter, window, first, last, passage): what to send. Windows without open quotes (with styles: without quotes) aren't sent."""
    shown = paragraphs_shown(spans)
    chapter = shown.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("para", "cost", "passage", "pending", "quotes"))).alias("ps"))
    chapter = chapter.withColumn("of", context_windows(F.transform("ps", lambda p: p["cost"]), budget))
    rows = chapter.select("chapter", "ps", F.posexplode("of").alias("place", "window"))
    rows = rows.groupBy("chapter", "window").agg(F.min("place").alias("a"), F.max("place").alias("z"), F.first("ps").alias("ps"))
    own = F.slice("ps", F.col("a") + 1, F.col("z") - F.col("a") + 1)
    start = F.greatest(F.col("a") - fixed.CONTEXT_PARAGRAPHS, F.lit(0))
    text = F.array_join(F.transform(F.slice("ps", start + 1, F.col("z") - start + 1), lambda p: p["passage"]), "\n\n")
    asked = F.exists(own, lambda p: (p["quotes" if styled else "pending"]) > 0)
    return rows.where(asked).select("chapter", "window", F.get("ps", F.col("a"))["para"].alias("first"), F.get("ps", F.col("z"))["para"].alias("last"), text.alias("passage"))


def exchanges(rows: DataFrame, model: str, num_ctx: int = 16384) -> DataFrame:
    """(model, num_ctx, tokens, prompt, response) of rows (prompt, response): a log of what was asked and answered, to be appended as JSON lines."""
    return rows.select(F.lit(model).alias("model"), F.lit(num_ctx).alias("num_ctx"), approx_tokens(F.col("prompt")).alias("tokens"), "prompt", "response")


def answer_schema(names: Sequence[str], styles: Sequence[str] = ()) -> dict:
    """The JSON schema of a chapter's answers: its speakers' names, and the book's styles."""
    fields: dict[str, dict] = {"quote_id": {"type": "integer"}, "speaker": {"enum": [*names, "unknown"]}, "confidence": {"type": "number"}}
    if styles:
        fields["style"] = {"enum": list(styles)}
    item = {"type": "object", "properties": fields, "required": list(fields)}
    return {"type": "object", "properties": {"speakers": {"type": "array", "items": item}}, "required": ["speakers"]}


def with_instructions(requests: DataFrame, cast: Sequence[Character], lang: str = "en", styles: Sequence[str] = ()) -> DataFrame:
    """requests with `passage` as it is sent, under an instruction with the names that the chapter may have, and `schema`, what an answer
    must look like. A book's cast and its chapters' numbers are small."""
    style = prompts.STYLED[lang].replace("{styles}", ", ".join(styles)) if styles else ""
    template = prompts.ATTRIBUTE[lang].replace("{style}", style)
    known = {c.name: c for c in cast}
    shown = lambda name: f"- {name}" + (f" ({', '.join(known[name].aliases)})" if known[name].aliases else "")
    spark = requests.sparkSession
    # names differ from the main cast's only in the chapters that minor characters were found in
    minor = sorted({n for c in cast if not c.main for n in c.chapters})
    of = {n: names_for_chapter(cast, n) for n in [-1, *minor]}
    table = spark.createDataFrame([(n, template.replace("{names}", "\n".join(map(shown, names))), json.dumps(answer_schema(names, styles), ensure_ascii=False)) for n, names in of.items()], "of int, template string, schema string")
    key = F.when(F.col("chapter").isin(minor), F.col("chapter")).otherwise(-1) if minor else F.lit(-1)
    return requests.withColumn("of", key).join(table, "of").withColumn("passage", F.replace("template", F.lit("{text}"), F.col("passage"))).drop("of", "template")


def instruction_cost(cast: Sequence[Character], lang: str = "en", styles: Sequence[str] = ()) -> int:
    """Tokens of the longest instruction that a chapter may have, with the system's."""
    names = "\n".join(f"- {c.name} ({', '.join(c.aliases)})" for c in cast)
    return tokens_of(prompts.ROLE[lang] + prompts.ATTRIBUTE[lang] + prompts.STYLED[lang] + ", ".join(styles) + names)


def answers_of(responses: DataFrame) -> DataFrame:
    """responses with `speakers`, what they say, and `corrupt`: the response where it isn't of the form that was asked for. A response that
    is no object of speakers is corrupt as a whole, and none of it counts."""
    form = f"struct<{ANSWERS.removeprefix('struct<').removesuffix('>')},_corrupt:string>"
    parsed = F.from_json("response", form, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = responses.withColumn("_a", parsed)
    bad = F.col("_a").isNull() | F.col("_a._corrupt").isNotNull() | F.col("_a.speakers").isNull()
    return rows.withColumn("corrupt", F.when(bad, F.coalesce("response", F.lit("")))).withColumn("speakers", F.when(~bad, F.col("_a.speakers"))).drop("_a")


def parse_answers(responses: DataFrame) -> DataFrame:
    """(chapter, pos, quote_id, speaker, confidence, style) of responses (chapter, window, response); corrupt ones say nothing."""
    items = answers_of(responses).select("chapter", "window", F.posexplode("speakers").alias("k", "a"))
    return items.select("chapter", F.struct("window", "k").alias("pos"), "a.*")


def fold_answers(spans: DataFrame, answers: DataFrame, cast: Sequence[Character], styles: Sequence[str] = ()) -> DataFrame:
    """spans with the model's speakers and styles. The first answer that resolves gives the speaker, with its confidence capped; the last
    with a known style gives the style; quotes without either are unknown. Answers to quotes that rules resolved only give styles."""
    name = resolver(cast)(F.coalesce("speaker", F.lit("")))
    given = answers.select("chapter", "quote_id", "pos", name.alias("named"), F.coalesce("confidence", F.lit(fixed.MODEL_DEFAULT)).alias("sure"), F.when(F.col("style").isin(list(styles)) if styles else F.lit(False), F.col("style")).alias("toned"))
    best = given.groupBy("chapter", "quote_id").agg(
        F.min_by(F.struct("named", "sure"), F.when(F.col("named").isNotNull(), F.col("pos"))).alias("who"),
        F.max_by("toned", F.when(F.col("toned").isNotNull(), F.col("pos"))).alias("style"),
    )
    joined = spans.join(best, ["chapter", "quote_id"], "left")
    pending = (F.col("kind") == "dialogue") & F.col("speaker").isNull()
    speaker = F.when(pending, F.coalesce("who.named", F.lit("unknown"))).otherwise(F.col("speaker"))
    sure = F.when(pending, F.when(F.col("who.named").isNotNull(), F.least("who.sure", F.lit(fixed.MODEL_MOST))).otherwise(0.0)).otherwise(F.col("confidence"))
    return joined.select("chapter", "para", "span", "kind", "text", speaker.alias("speaker"), sure.alias("confidence"), "quote_id", F.col("style").alias("style"))


def line_id(chapter: Column, para: Column, span: Column) -> Column:
    return F.format_string("c%03dp%04ds%02d", chapter, para, span)


def lines(spans: DataFrame, lang: str = "en", locked: DataFrame | None = None) -> DataFrame:
    """One row per utterance. Spans without a word character give none, but count for the identifiers. A locked line of old with the same
    identifier and text stays as it was."""
    style = F.col("style") if "style" in spans.columns else F.lit(None).cast("string")
    out = spans.where(F.col("text").rlike(r"(?U)\w")).select(
        line_id(F.col("chapter"), F.col("para"), F.col("span")).alias("id"), "chapter", "para", "kind", F.coalesce("speaker", F.lit("unknown")).alias("speaker"),
        "text", F.lit(lang).alias("lang"), style.alias("style"), "confidence", F.lit(False).alias("locked"),
    )
    if locked is None:
        return out
    old = locked.where("locked").select(F.col("id").alias("old_id"), F.col("text").alias("old_text"), F.struct(*LINE).alias("old"))
    both = out.join(old, (F.col("id") == F.col("old_id")) & (F.col("text") == F.col("old_text")), "left")
    return both.select(*(F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in LINE))


def statistic_columns() -> list[Column]:
    """Aggregates over lines, to be taken or observed."""
    fresh = ~F.col("locked")
    talk = F.col("kind") == "dialogue"
    return [
        F.count_if(fresh & ~talk).alias("narration"),
        F.count_if(fresh & talk & (F.col("confidence") >= fixed.RULES)).alias("rules"),
        F.count_if(fresh & talk & (F.col("confidence") < fixed.RULES) & (F.col("speaker") != "unknown")).alias("model"),
        F.count_if(fresh & talk & (F.col("speaker") == "unknown")).alias("unknown"),
        F.count_if("locked").alias("locked"),
        F.count_if(F.col("style").isNotNull()).alias("styled"),
    ]


def statistics(lines: DataFrame) -> DataFrame:
    return lines.agg(*statistic_columns())


def low_confidence(lines: DataFrame) -> DataFrame:
    """What a person should look at: dialogue that no rule resolved."""
    low = lines.where((F.col("kind") == "dialogue") & (F.col("confidence") < fixed.RULES))
    return low.select("id", "speaker", F.format_string("%.2f", F.col("confidence")).alias("confidence"), F.substring("text", 1, 100).alias("text"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the last."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
