"""Reading what models answer: column functions over free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCED = r"(?is)```(?:json)?\s*(.*?)\s*```"
BRACES = r"(?s)\{.*\}"


def whole_json(text: Column) -> Column:
    """text as a variant where all of it is one JSON value, else null.

    The parser stops after the first value and doesn't mind what follows; inside an array and inside an object it does.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}"))).isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def first_object(response: Column) -> Column:
    """The first JSON object (variant) of a response: in fenced blocks first, then from the first to the last brace."""
    fenced = F.regexp_extract_all(response, F.lit(FENCED), F.lit(1))
    whole = F.regexp_extract_all(response, F.lit(BRACES), F.lit(0))
    texts = F.filter(F.transform(F.concat(fenced, whole), lambda x: F.trim(x)), lambda x: x.startswith("{"))
    # whole_json(), each text parsed twice and not once for every mention
    both = F.transform(texts, lambda x: F.struct(F.try_parse_json(F.concat(F.lit('{"w":'), x, F.lit("}"))).alias("o"), F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).alias("l")))
    alone = F.filter(both, lambda x: x["o"].isNotNull() & F.try_variant_get(x["l"], "$[0]", "variant").isNotNull() & F.try_variant_get(x["l"], "$[1]", "variant").isNull())
    return F.try_variant_get(F.get(alone, F.lit(0))["l"], "$[0]", "variant")


def server_answer(response: Column) -> Column:
    """A response's first object as JSON text with all its values; {"raw_response": text} without one, null for no text."""
    found = first_object(response)
    bare = F.regexp_replace(response, r"(?U)^\s+|\s+$", "")
    return F.when(F.coalesce(response, F.lit("")) != "", F.coalesce(F.to_json(found), F.to_json(F.struct(bare.alias("raw_response")))))


def grades(responses: DataFrame, *keys: str, response_col: str = "response") -> DataFrame:
    """(keys, dimension, grade): the numbers of a response's first object, truncated; true and false count as 1 and 0.

    Strings, even of digits, nulls and nested values give no row; nor do numbers that are not finite.
    """
    entries = responses.select(*keys, first_object(F.col(response_col)).alias("o"))  # a filter would parse all once more; of null there are no entries
    entries = entries.lateralJoin(responses.sparkSession.tvf.variant_explode(F.col("o").outer())).select(
        *keys, F.col("key").alias("dimension"), "value", F.schema_of_variant("value").alias("kind")
    )
    number = F.try_variant_get("value", "$", "double")
    return entries.filter(F.col("kind").rlike("^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)")).select(
        *keys, "dimension", F.when(F.col("kind") == "BOOLEAN", F.try_variant_get("value", "$", "boolean").cast("int")).otherwise(number.cast("int")).alias("grade")
    )


def sanitize(response: Column) -> Column:
    """struct(json, error): the response as JSON text, or what lies between its last opening and last closing brace.

    error is no_text for null, no_json_found without such braces, parse_failed where they hold no JSON.
    """
    start = F.length(response) - F.locate("{", F.reverse(response)) + 1
    end = F.length(response) - F.locate("}", F.reverse(response)) + 1
    has = F.contains(response, F.lit("{")) & F.contains(response, F.lit("}")) & (end > start)
    inner = F.when(has, F.substring(response, start, end - start + 1))
    whole, part = whole_json(response), whole_json(inner)
    return F.struct(
        F.to_json(F.coalesce(whole, part)).alias("json"),
        F.when(response.isNull(), "no_text").when(whole.isNotNull() | part.isNotNull(), None).when(has, "parse_failed").otherwise("no_json_found").alias("error"),
    )


def confidence(json: Column) -> Column:
    """0 for what is no object or has a true error, else the first number among four keys, else 1."""
    value = F.try_parse_json(json)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    error = F.try_variant_get(value, "$.error", "variant")
    kind = F.schema_of_variant(error)
    nothing = (
        F.coalesce(kind == "VOID", F.lit(True))
        | F.coalesce((kind != "STRING") & (F.try_variant_get(error, "$", "double") == 0), F.lit(False))
        | F.to_json(error).isin('""', "[]", "{}", "false")
    )
    known = [F.get_json_object(json, f"$.{k}").try_cast("double") for k in ("confidence", "logprob", "prob", "score")]
    return (
        F.when(~F.coalesce(is_object, F.lit(False)), 0.0).when(~nothing, 0.0).otherwise(F.coalesce(*known, F.lit(1.0)))
    )
