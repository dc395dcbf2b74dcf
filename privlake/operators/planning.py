"""Plans of actions: made from fields and saved values by rules, or read from an answer in JSON; where to submit; what a run came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privlake.functions.text import B
from privlake.operators import intents
from privlake.operators.forms import field_categories

#: Input types that a plan doesn't fill, words that make a button the one that submits, and words that rule it out.
UNFILLED = ("submit", "button", "hidden")
SUBMITS = r"(submit|send|confirm|proceed|continue)"
DOES_NOT = r"(save\s*draft|cancel|reset|back)"
_ACTION = "type string, target string, element string, value string"
_STEP = f"struct<action: struct<{_ACTION}>, {_ACTION}, reasoning string, confidence double, risk string>"
_PLAN = f"steps array<{_STEP}>, actions array<{_STEP}>, reasoning string"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _saved_by_page(saved: DataFrame) -> DataFrame:
    """Per page, a map from sources to the least value saved; fields are joined with it by page alone, so tables that lie by page needn't move. A page's values are gathered, never more."""
    known = saved.where((_text("value") != "") & F.col("key").isNotNull()).groupBy("page_id", "key").agg(F.min("value").alias("value"))
    return known.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_saved"))


def fill_plan(fields: DataFrame, saved: DataFrame) -> DataFrame:
    """Steps that fill the empty fields of each page: `select` where a value is one of the options, else `click` and `type`.

    What a field wants is told by its label, name, id and, if there is such a column, placeholder. `saved` has page_id, key (a data source) and value. Result: page_id, step (from 0), ord (of the field), action, target, value, confidence, risk.
    A step that types into a field with a category has risk `high`.
    """
    open_ = fields.where(~F.lower(_text("type")).isin(*UNFILLED) & (F.trim(_text("value")) == ""))
    source = intents.data_source(F.col("label"), F.col("name"), F.col("id"), F.col("placeholder") if "placeholder" in fields.columns else None)
    rows = open_.withColumn("_s", source).where("_s is not null").select("page_id", "form_id", "ord", "name", "id", "type", "options", "_s.source", "_s.confidence", (F.size(field_categories()) > 0).alias("private"))
    rows = rows.join(_saved_by_page(saved), "page_id").withColumn("saved", F.try_element_at("_saved", F.col("source"))).where("saved is not null").drop("_saved")
    option = F.get(F.filter("options", lambda o: F.lower(o) == F.lower("saved")), 0)
    place = F.concat(F.lit("["), F.col("ord"), F.lit("]"))
    named = F.nullif(F.col("name"), F.lit(""))
    step = lambda action, target, value, risk: F.struct(F.lit(action).alias("action"), target.alias("target"), value.alias("value"), risk.alias("risk"))
    low, none = F.lit("low"), F.lit(None).cast("string")
    typed = F.when(_text("id") != "", place).otherwise(F.coalesce(named, place))
    chosen = F.array(step("select", F.coalesce(F.nullif(F.col("id"), F.lit("")), named, place), F.col("option"), low))
    written = F.array(step("click", typed, none, low), step("type", typed, F.col("saved"), F.when(F.col("private"), "high").otherwise(low)))
    rows = rows.withColumn("option", F.when(F.lower("type") == "select", option))
    steps = rows.select("page_id", "form_id", "ord", "confidence", F.posexplode(F.when(F.col("option").isNotNull(), chosen).otherwise(written)).alias("k", "s"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("form_id", "ord", "k")) - 1
    return steps.select("page_id", number.alias("step"), "ord", "s.action", "s.target", "s.value", "confidence", "s.risk")


def unmapped_fields(fields: DataFrame, saved: DataFrame) -> DataFrame:
    """Required fields that are empty and that fill_plan() can't fill, as nothing is saved for what they want, or nothing tells what that is: page_id, form_id, ord, field_name. Null pages are left out of the match, so their fields are unmapped."""
    open_ = fields.where(~F.lower(_text("type")).isin(*UNFILLED) & (F.trim(_text("value")) == "") & F.coalesce("required", F.lit(False)))
    hint = F.col("placeholder") if "placeholder" in fields.columns else None
    wants = intents.data_source(F.col("label"), F.col("name"), F.col("id"), hint)["source"]
    left = open_.join(_saved_by_page(saved), "page_id", "left").where(F.try_element_at("_saved", wants).isNull())
    return left.select("page_id", "form_id", "ord", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.col("id")).alias("field_name"))


def submit_targets(fields: DataFrame, elements: DataFrame) -> DataFrame:
    """Per page, what submits it: its first field of type submit, by id, name or label; else the first button whose words say so, by id or text."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    own = fields.where(F.lower(_text("type")) == "submit").groupBy("page_id").agg(F.min_by(F.coalesce(blank("id"), blank("name"), "label"), F.struct("form_id", "ord")).alias("by_field"))
    said = F.lower(F.concat_ws(" ", _text("text"), _text("label")))
    buttons = elements.where(((F.col("tag") == "button") | (F.col("role") == "button")) & said.rlike(B + SUBMITS + B) & ~said.rlike(B + DOES_NOT + B))
    other = buttons.groupBy("page_id").agg(F.min_by(F.coalesce(blank("id"), "text"), "ord").alias("by_text"))
    return own.join(other, "page_id", "full").select("page_id", F.coalesce("by_field", "by_text").alias("target"))


def outcome_line(done: Column, total: Column, needs: Column, missing: Column) -> Column:
    """What a run came to: steps done, and the required fields that are still empty, of which `missing` have no saved value."""
    head = F.when(total > 0, F.concat(done, F.lit("/"), total, F.lit(" steps done"))).otherwise("nothing to do")
    field = F.concat(needs, F.when(needs == 1, " required field still ").otherwise(" required fields still "))
    tail = F.when(needs == 0, "nothing outstanding.").when(missing > 0, F.concat(field, F.when(needs == 1, "needs").otherwise("need"), F.lit(" a value from you."))).otherwise(F.concat(field, F.lit("empty.")))
    return F.concat(head, F.lit(" — "), tail)


def plan_steps(answer: Column) -> Column:
    """The steps in an answer that holds JSON, perhaps fenced or within other text: an array of action, target, value, confidence, risk; null without JSON.

    Steps stand under `steps` or `actions`, their action nested or flat. `fill` and `input` mean `type`; a target with a number in brackets is that number.
    """
    body = F.regexp_extract(F.regexp_replace(answer, r"```(json)?\n?", ""), r"(?s)\{.*\}", 0)
    plan = F.from_json(F.nullif(body, F.lit("")), _PLAN)

    def step(s: Column) -> Column:
        nested = s["action"]
        pick = lambda f: F.when(nested.isNotNull(), nested[f]).otherwise(s[f])
        kind, target = F.coalesce(pick("type"), F.lit("wait")), F.coalesce(pick("target"), pick("element"), F.lit(""))
        number = F.regexp_extract(target, r"\[[0-9]+\]", 0)
        return F.struct(F.when(kind.isin("fill", "input"), "type").otherwise(kind).alias("action"), F.when(number != "", number).otherwise(target).alias("target"), pick("value").alias("value"), F.coalesce(F.nullif(s["confidence"], F.lit(0.0)), F.lit(0.8)).alias("confidence"), F.coalesce(s["risk"], F.lit("low")).alias("risk"))

    return F.transform(F.coalesce(plan["steps"], plan["actions"]), step)


def prompt_lines(fields: DataFrame, most: int = 30) -> DataFrame:
    """Per page, the text that describes its first `most` fields to a planner: label, type, whether filled and required, and the category; never a value."""
    state = F.when(F.trim(_text("value")) != "", "FILLED").otherwise("EMPTY")
    tags = F.array_compact(F.array(state, F.when(F.col("required"), "REQUIRED"), F.when(F.size("cats") > 0, F.concat(F.lit("[PII:"), F.col("cats")[0], F.lit("]")))))
    line = F.concat(F.lit("["), F.col("ord"), F.lit("] "), _text("label"), F.lit(" ("), _text("type"), F.lit(") "), F.array_join(tags, " "))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("form_id", "ord"))
    rows = fields.withColumn("cats", field_categories()).select("page_id", place.alias("place"), line.alias("line")).where(F.col("place") <= most)
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
